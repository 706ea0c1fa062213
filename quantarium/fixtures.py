"""Views of the test tables in the shapes of the operators' inputs, in Spark and as SQL that DuckDB runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import metrics


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ticks(spark, d) -> DataFrame:
    """Trades: ticker, ts, price, volume and their order."""
    return table(spark, d, "lineitem").select(
        F.col("l_suppkey").alias("ticker"), F.col("l_shipdate").alias("ts"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"), F.col("l_quantity").alias("volume"),
        F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice").alias("seq"),
    )


def candles(spark, d) -> DataFrame:
    return metrics.ohlcv_daily_rollup(ticks(spark, d))


def candles_step(spark, d) -> DataFrame:
    """Smooth series with one step of a ratio by ticker modulo 4: none, 2, 0.1 (both clean) and 6.5 (not clean)."""
    day = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("ticker"), F.to_date("l_shipdate").alias("date")).distinct()
    ratio = F.element_at(F.array(F.lit(1.0), F.lit(2.0), F.lit(0.1), F.lit(6.5)), (F.col("ticker") % 4 + 1).cast("int"))
    base = 100.0 + F.pmod(F.datediff("date", F.lit("1970-01-01").cast("date")), F.lit(7))
    close = F.when(F.col("date") >= F.lit("1998-06-01").cast("date"), base / ratio).otherwise(base)
    return day.select("ticker", "date", close.alias("open"), close.alias("high"), close.alias("low"), close.alias("close"), F.lit(1000.0).alias("volume"))


def curve(spark, d) -> DataFrame:
    p = table(spark, d, "part")
    brand = F.regexp_extract("p_brand", r"(\d+)", 1).cast("int")
    return p.groupBy(F.date_add(F.lit("2026-01-01").cast("date"), brand).alias("data_ref"), F.col("p_size").cast("double").alias("vertex")).agg((F.floor(F.avg("p_retailprice") / 200 * 1e4 + 0.5) / 1e4).alias("rate"))


def investments(spark, d) -> DataFrame:
    return table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), (F.col("s_acctbal") / 1000).alias("irr"), ((F.col("s_suppkey") % 60) + 0.5).alias("horizon"))


def flow(spark, d) -> DataFrame:
    """Monthly signed flow by segment, dated at month end; the last month keeps its last day seen, so it is partial."""
    o = table(spark, d, "orders").select(F.col("o_orderpriority").alias("segment"), F.to_date("o_orderdate").alias("day"), F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice")).otherwise(-F.col("o_totalprice")).alias("v"))
    per = o.groupBy("segment", F.last_day("day").alias("month")).agg(F.max("day").alias("last_day"), F.sum("v").alias("flow"))
    newest = per.groupBy().agg(F.max("month").alias("newest"))
    return per.join(F.broadcast(newest)).select("segment", F.when(F.col("month") == F.col("newest"), F.col("last_day")).otherwise(F.col("month")).alias("data_ref"), "flow")


def facts(spark, d) -> DataFrame:
    """Versioned yearly facts by ticker, metric and scope, with the day each became known."""
    o, li = table(spark, d, "orders"), table(spark, d, "lineitem")
    j = li.join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    metric = F.element_at(F.array(*map(F.lit, ("revenue", "gross_profit", "ebit", "working_capital", "net_income"))), (F.col("l_linenumber") % 5 + 1).cast("int"))
    scope = F.when(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), F.lit("individual")).otherwise(F.lit("consolidado"))
    return j.groupBy(F.col("l_suppkey").alias("ticker"), F.year("o_orderdate").alias("fiscal_year"), metric.alias("metric"), scope.alias("scope"), (F.col("l_partkey") % 2 + 1).alias("version")).agg(
        F.max(F.to_date("l_shipdate")).alias("known_at"), F.sum("l_extendedprice").alias("value")
    )


def observations(spark, d) -> DataFrame:
    o, c = table(spark, d, "orders"), table(spark, d, "customer")
    j = o.join(c, F.col("o_custkey") == F.col("c_custkey"))
    return j.groupBy(F.col("c_mktsegment").alias("series"), F.trunc(F.to_date("o_orderdate"), "month").alias("date")).agg(F.avg("o_totalprice").alias("value"))


#: The same views for DuckDB.
SQL = {
    "ticks": "SELECT l_suppkey AS ticker, l_shipdate AS ts, l_extendedprice / l_quantity AS price, l_quantity AS volume, l_orderkey AS s1, l_linenumber AS s2, l_partkey AS s3, l_extendedprice AS s4 FROM lineitem",
    "candles": "SELECT ticker, CAST(ts AS DATE) AS date, first(price ORDER BY s1, s2, s3, s4) AS open, max(price) AS high, min(price) AS low, last(price ORDER BY s1, s2, s3, s4) AS close, sum(volume) AS volume FROM ticks GROUP BY 1, 2",
    "candles_step": """SELECT ticker, date, CASE WHEN date >= DATE '1998-06-01' THEN (100.0 + (date_diff('day', DATE '1970-01-01', date) % 7)) / ratio ELSE CAST(100.0 + (date_diff('day', DATE '1970-01-01', date) % 7) AS DOUBLE) END AS close, 1000.0::DOUBLE AS volume
        FROM (SELECT DISTINCT l_suppkey AS ticker, CAST(l_shipdate AS DATE) AS date, CASE l_suppkey % 4 WHEN 0 THEN 1.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE WHEN 2 THEN 0.1::DOUBLE ELSE 6.5::DOUBLE END AS ratio FROM lineitem)""",
    "curve": "SELECT DATE '2026-01-01' + CAST(regexp_extract(p_brand, '(\\d+)', 1) AS INTEGER) AS data_ref, CAST(p_size AS DOUBLE) AS vertex, floor(avg(p_retailprice) / 200 * 1e4 + 0.5) / 1e4 AS rate FROM part GROUP BY 1, 2",
    "investments": "SELECT s_suppkey AS id, s_acctbal / 1000 AS irr, CAST((s_suppkey % 60) + 0.5 AS DOUBLE) AS horizon FROM supplier",
    "flow": """SELECT segment, CASE WHEN month = max(month) OVER () THEN ld ELSE month END AS data_ref, flow FROM (SELECT o_orderpriority AS segment, last_day(CAST(o_orderdate AS DATE)) AS month, max(CAST(o_orderdate AS DATE)) AS ld,
        sum(CASE WHEN o_orderstatus = 'F' THEN o_totalprice ELSE -o_totalprice END) AS flow FROM orders GROUP BY 1, 2)""",
    "facts": """SELECT l_suppkey AS ticker, CAST(year(o_orderdate) AS INTEGER) AS fiscal_year, CASE l_linenumber % 5 WHEN 0 THEN 'revenue' WHEN 1 THEN 'gross_profit' WHEN 2 THEN 'ebit' WHEN 3 THEN 'working_capital' ELSE 'net_income' END AS metric,
        CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'individual' ELSE 'consolidado' END AS scope, l_partkey % 2 + 1 AS version, max(CAST(l_shipdate AS DATE)) AS known_at, sum(l_extendedprice) AS value FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2, 3, 4, 5""",
    "observations": "SELECT c_mktsegment AS series, CAST(date_trunc('month', o_orderdate) AS DATE) AS date, avg(o_totalprice) AS value FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2",
}
_NEEDS = {"candles": ("ticks",)}


def with_views(sql: str, *views: str) -> str:
    """``sql`` after the definitions of these views, for DuckDB."""
    names: list[str] = []
    for v in views:
        names += [n for n in (*_NEEDS.get(v, ()), v) if n not in names]
    return "WITH " + ", ".join(f"{n} AS ({SQL[n]})" for n in names) + " " + sql
