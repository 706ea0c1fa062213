"""Queries that write given tables in a source's format into the shared folder and scan them back."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..fixtures import table
from ..functions.columns import to_number
from ..sources import archives, scans
from ..sources.shared import new_dir
from .registry import query


def _yearly(spark, d, stmt: str) -> str:
    """Orders as yearly archives: from 1995 on there is a column more, before the others."""
    root = new_dir(spark, "archive")
    o = table(spark, d, "orders").select(
        F.col("o_orderkey").alias("DOC"), (F.col("o_custkey") % 3 + 1).alias("VERSAO"), F.col("o_orderpriority").alias("CONTA"), F.col("o_totalprice").alias("VALOR"), F.year("o_orderdate").alias("year"), F.lit(stmt).alias("stmt"),
    )
    for part in (o.where("year < 1995").drop("VERSAO"), o.where("year >= 1995").select("VERSAO", "CONTA", "DOC", "VALOR", "year", "stmt")):
        part.repartition("year").write.mode("append").partitionBy("year", "stmt").csv(root, sep=";", header=True, encoding="ISO-8859-1")
    return root


@query("scan_filing_archive", "SELECT CAST(year(o_orderdate) AS INTEGER) AS year, o_orderkey AS doc, CASE WHEN year(o_orderdate) >= 1995 THEN o_custkey % 3 + 1 END AS version, o_orderpriority AS account, o_totalprice AS value FROM orders WHERE year(o_orderdate) BETWEEN 1993 AND 1997")
def scan_filing_archive(spark, d):
    """Years with two headers, and one that is missing."""
    rows = archives.filing_member(spark, _yearly(spark, d, "DRE_con"), "DRE_con", [1993, 1994, 1995, 1996, 1997, 2050])
    return rows.select("year", F.col("DOC").cast("long").alias("doc"), F.col("VERSAO").cast("long").alias("version"), F.col("CONTA").alias("account"), to_number("VALOR").alias("value"))


@query("scan_issuer_index", "SELECT CAST(year(o_orderdate) AS INTEGER) AS year, o_orderpriority AS category, count(*) AS n, count(CASE WHEN year(o_orderdate) >= 1995 THEN 1 END) AS versions FROM orders GROUP BY 1, 2")
def scan_issuer_index(spark, d):
    rows = archives.issuer_index(spark, _yearly(spark, d, "index"), list(range(1990, 2031)))
    return rows.groupBy("year", F.col("CONTA").alias("category")).agg(F.count("*").alias("n"), F.count("VERSAO").alias("versions"))


@query("scan_nested_first_array", "SELECT s_suppkey AS id, s_acctbal AS balance, CASE s_nationkey % 3 WHEN 0 THEN 'raiz' WHEN 1 THEN 'items' ELSE 'rows' END AS via FROM supplier")
def scan_nested_first_array(spark, d):
    """A file a nation: an array at the root, under a usual key, or under another one behind a key that holds none."""
    one = F.to_json(F.collect_list(F.struct(F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("balance"))))
    files = table(spark, d, "supplier").groupBy("s_nationkey").agg(one.alias("a"))
    k = F.col("s_nationkey") % 3
    text = F.when(k == 0, F.col("a")).when(k == 1, F.concat(F.lit('{"other":[1],"items":'), "a", F.lit("}"))).otherwise(F.concat(F.lit('{"meta":1,"rows":'), "a", F.lit(',"a_later":[2]}')))
    root = new_dir(spark, "json")
    files.select("s_nationkey", text.alias("value")).write.partitionBy("s_nationkey").text(root)
    got = scans.first_array(spark, root)
    return got.select(F.variant_get("item", "$.id", "long").alias("id"), F.variant_get("item", "$.balance", "double").alias("balance"), "via")


@query("scan_curated_csv", """WITH t AS (SELECT p_brand AS brand, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) + 1 AS row, p_size, p_partkey, p_name FROM part)
 SELECT brand, row, CASE WHEN p_size >= 5 THEN DATE '2026-01-01' + CAST(p_size AS INTEGER) END AS data_ref, CASE WHEN p_size < 45 THEN CAST(p_partkey + 0.5 AS DOUBLE) END AS rate, p_name || ', x' AS source, CASE WHEN p_size < 5 OR p_size >= 45 THEN 'invalid_row_' || row END AS error FROM t""")
def scan_curated_csv(spark, d):
    """A file a brand, some rows without a date, some without a finite number; rows are named by their place in the file."""
    root = new_dir(spark, "curated")
    day = F.when(F.col("p_size") >= 5, F.date_format(F.date_add(F.lit("2026-01-01").cast("date"), F.col("p_size").cast("int")), "yyyy-MM-dd")).otherwise("soon")
    rate = F.when(F.col("p_size") < 45, F.concat("p_partkey", F.lit(".5"))).otherwise("NaN")
    rows = table(spark, d, "part").select(F.regexp_replace("p_brand", "#", "_").alias("brand"), "p_partkey", F.concat_ws(",", day, rate, F.concat(F.lit('"'), "p_name", F.lit(', x"'))).alias("value"))
    head = rows.select("brand").distinct().select("brand", F.lit(-1).cast("long").alias("p_partkey"), F.lit("data_ref,rate,source").alias("value"))
    rows.unionByName(head).repartition("brand").sortWithinPartitions("brand", "p_partkey").drop("p_partkey").write.partitionBy("brand").text(root)
    got = scans.curated_rows(spark, root, {"data_ref": "date", "rate": "double", "source": "string"})
    return got.select(F.regexp_replace(F.regexp_extract("file", "brand=([^/]*)/", 1), "_", "#").alias("brand"), "row", "data_ref", "rate", "source", "error")


@query("scan_context_package", """WITH t AS (SELECT s_nationkey AS id, max(s_acctbal) AS top, min(s_acctbal) AS low, count(*) AS n FROM supplier GROUP BY 1)
 SELECT CAST(CASE WHEN top >= 1500 THEN id END AS BIGINT) AS id, CASE WHEN top < 1500 THEN 'invalid_json' WHEN n % 5 = 0 THEN 'incompatible' WHEN low < -900 THEN 'invalid_contract' WHEN low < 0 THEN 'seed' ELSE 'available' END AS state FROM t UNION ALL SELECT NULL, 'missing'""")
def scan_context_package(spark, d):
    """A package a nation, and a place where there is none."""
    root = new_dir(spark, "packages")
    t = table(spark, d, "supplier").groupBy("s_nationkey").agg(F.max("s_acctbal").alias("top"), F.min("s_acctbal").alias("low"), F.count("*").alias("n"))
    version = F.when(F.col("n") % 5 == 0, "2.0").otherwise("1.3")
    body = F.to_json(F.struct(F.col("s_nationkey").alias("id"), "low", version.alias("contextSchemaVersion"), (F.col("low") < 0).alias("is_seed_mode")))
    t.select("s_nationkey", F.when(F.col("top") < 1500, F.concat(F.lit("{"), body)).otherwise(body).alias("value")).write.partitionBy("s_nationkey").text(root)
    read = lambda path: scans.context_package(spark, path, "id long, low double", "1.2", {"low": F.col("low") < -900}).select("id", "state")
    return read(root).unionByName(read(root + "-none"))


@query("scan_investor_bulletin", """SELECT o_orderpriority AS file, CAST(count(*) * 1000 AS DOUBLE) AS buys, CAST(count(DISTINCT o_custkey) * 1000 AS DOUBLE) AS sells, CAST((count(*) - count(DISTINCT o_custkey)) * 1000 AS DOUBLE) AS balance, CAST(count(*) * 10.5 AS DOUBLE) AS blocks, CAST(5.25 AS DOUBLE) AS blocks_share FROM orders GROUP BY 1""")
def scan_investor_bulletin(spark, d):
    """A bulletin a priority: a line of flows and, later, one of volumes, of the same investors."""
    root = new_dir(spark, "bulletin")
    o = table(spark, d, "orders").groupBy("o_orderpriority").agg(F.count("*").alias("n"), F.count_distinct("o_custkey").alias("c"))
    br = lambda c: F.translate(F.format_number(c, 2), ",.", ".,")
    flows = F.concat(F.lit("Pessoas  Físicas "), br(F.col("n")), F.lit(" 1,00 "), br(F.col("c")), F.lit(" 2,00"))
    volumes = F.concat(F.lit("PESSOAS FÍSICAS "), *[x for k in range(6) for x in (br(F.col("n") * (10.5 if k == 4 else 1.0)), F.lit(" 5,25 " if k == 4 else " 1,50 "))])
    o.select("o_orderpriority", F.concat_ws("\n", F.lit("Fluxo"), flows, F.lit("Volume"), volumes).alias("value")).write.partitionBy("o_orderpriority").text(root)
    # Spark names the files; the folder tells which bulletin a line is of.
    found = []
    for p in [r[0] for r in o.select("o_orderpriority").orderBy("o_orderpriority").collect()]:  # five priorities
        path = f"{root}/o_orderpriority={p}"
        flow, volume = scans.investor_bulletin(spark, path).where("error IS NULL"), scans.market_volumes(spark, path).where("market = 'blocos'")
        found.append(flow.join(volume, ["file", "category"]).select(F.lit(p).alias("file"), "buys", "sells", "balance", F.col("value").alias("blocks"), F.col("share").alias("blocks_share")))
    return reduce(DataFrame.unionByName, found)
