"""Scans of the source formats into typed frames, and sinks. Bad rows become nulls or go to reject columns; files are
read by Spark's readers only, so any store they know will do."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.columns import date_br, parse_number_br, plain_text, to_number


def sgs_json(spark: SparkSession, path: str, end: str | None = None, tolerant: bool = False) -> DataFrame:
    """(code, date, value) from arrays of {data: dd/mm/yyyy, valor: text}; code is the file's name. No row after ``end``;
    the last value of a date wins, by the files' names and inside a file by its order. Strict: a bad date or value raises; tolerant: bad dates go, bad values are null."""
    raw = spark.read.schema("data string, valor string").option("multiLine", True).json(path).withColumn("code", F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.json$", 1))
    value = parse_number_br("valor") if tolerant else to_number("valor")
    if tolerant:
        value = F.coalesce(to_number("valor"), value)
    rows = raw.select("code", date_br("data").alias("date"), value.alias("value"), F.struct(F.col("_metadata.file_path").alias("f"), F.monotonically_increasing_id().alias("i")).alias("_i"))
    if tolerant:
        rows = rows.where("date IS NOT NULL")
    else:
        bad = F.col("date").isNull() | F.col("value").isNull()
        rows = rows.withColumn("value", F.when(bad, F.raise_error(F.lit("bad date or value in a series")).cast("double")).otherwise(F.col("value")))
    if end:
        rows = rows.where(F.col("date") <= F.lit(end).cast("date"))
    return rows.groupBy("code", "date").agg(F.max_by("value", "_i").alias("value"))


def fred_csv(spark: SparkSession, path: str) -> DataFrame:
    """(date, value): a point or blank is null, rows without a date go."""
    raw = spark.read.csv(path, header=True, schema="date string, value string")
    return raw.select(F.try_to_date("date", "yyyy-MM-dd").alias("date"), to_number(F.when(F.trim("value") != ".", F.col("value"))).alias("value")).where("date IS NOT NULL")


def worldbank_json(spark: SparkSession, path: str) -> DataFrame:
    """(date, value) of the second element of [meta, rows]: known values, at July 1 of their year."""
    raw = spark.read.text(path, wholetext=True)
    rows = raw.select(F.explode(F.from_json(F.get_json_object("value", "$[1]"), "array<struct<date: string, value: double>>")).alias("r"))
    return rows.where("r.value IS NOT NULL").select(F.make_date(F.col("r.date").cast("int"), F.lit(7), F.lit(1)).alias("date"), F.col("r.value").alias("value"))


def semicolon_csv(spark: SparkSession, path: str, encoding: str = "ISO-8859-1") -> DataFrame:
    """All-text frame with the header's names; quotes double inside quotes."""
    return spark.read.csv(path, sep=";", header=True, quote='"', escape='"', encoding=encoding)


def treasury_csv(spark: SparkSession, path: str) -> DataFrame:
    """Principal inflation-linked bonds: (maturity, base_date, buy, sell, offered, available_at)."""
    raw = spark.read.csv(path, sep=";", header=True, encoding="ISO-8859-1")
    bond, maturity, base, buy, sell, *_ = raw.columns
    name = plain_text(bond)
    keep = name.contains("ipca") & ~name.contains("juros") & ~name.contains("educa") & ~name.contains("renda")
    return raw.where(keep).select(
        date_br(maturity).alias("maturity"), date_br(base).alias("base_date"), parse_number_br(buy).alias("buy"), parse_number_br(sell).alias("sell"), (parse_number_br(buy) > 0).alias("offered"),
        F.to_timestamp(F.concat(F.date_format(date_br(base), "yyyy-MM-dd"), F.lit("T09:30:00-03:00"))).alias("available_at"),
    ).where("maturity IS NOT NULL AND base_date IS NOT NULL")


def source_manifest(spark: SparkSession, path: str) -> DataFrame:
    """(path, bytes, sha256) of each file."""
    return spark.read.format("binaryFile").load(path).select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def curve_report(spark: SparkSession, path: str) -> DataFrame:
    """(file, vertex years, rate) from a report text: the rows after the header with vertices, up to the first that is no
    number; business days are 252 a year."""
    lines = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), F.posexplode(F.split("value", r"\r?\n")).alias("pos", "line"))
    t = lines.withColumn("head", plain_text("line").contains("vertices") & plain_text("line").contains("ettj ipca")).withColumn("cell", F.split("line", ";"))
    t = t.withColumn("days", parse_number_br(F.get("cell", F.lit(0)))).withColumn("rate", parse_number_br(F.get("cell", F.lit(1))))
    marks = t.groupBy("file").agg(F.min(F.when(F.col("head"), F.col("pos"))).alias("start"))
    body = t.join(marks, "file").where("pos > start")
    stop = body.where("days IS NULL").groupBy("file").agg(F.min("pos").alias("stop"))
    return body.join(stop, "file", "left").where("stop IS NULL OR pos < stop").select("file", (F.col("days") / 252).alias("vertex"), "rate")


def anchor_block(spark: SparkSession, path: str, anchors: str, following: int) -> DataFrame:
    """(file, pos, line): the first line that matches any anchor (accent-free) and so many lines after it."""
    lines = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), F.posexplode(F.split("value", r"\r?\n")).alias("pos", "line"))
    first = lines.where(plain_text("line").rlike(anchors)).groupBy("file").agg(F.min("pos").alias("at"))
    return lines.join(first, "file").where((F.col("pos") >= F.col("at")) & (F.col("pos") <= F.col("at") + following)).select("file", "pos", "line")


#: Fixed: keys under which envelopes usually hold their rows, in order of preference.
ENVELOPE = ("conteudo", "value", "data", "items", "resultado")


def first_array(spark: SparkSession, path: str) -> DataFrame:
    """(item, via): one VARIANT row an element of each file's array: at the root (via: raiz), under a usual envelope key, or
    else under the first key, in the file's own order, that holds one. A file without an array, or that is no JSON, has no
    rows."""
    raw = spark.read.text(path, wholetext=True)
    v = F.try_parse_json("value")
    holds = lambda key: F.try_variant_get(F.col("v"), key, "array<variant>")
    named = F.coalesce(F.when(holds("$").isNotNull(), "raiz"), *[F.when(holds(f"$.{k}").isNotNull(), k) for k in ENVELOPE])
    # A variant sorts its keys: their order comes from the text, what they hold from the variant as a map.
    own = F.expr("try_variant_get(v, '$', 'map<string, variant>')")
    first = F.get(F.filter(F.json_object_keys("value"), lambda k: F.substring(F.schema_of_variant(F.element_at("m", k)), 1, 5) == "ARRAY"), F.lit(0))
    found = raw.select("value", v.alias("v")).withColumn("m", own).withColumn("via", F.coalesce(named, first))
    usual = F.coalesce(*[F.when(F.col("via") == k, holds("$" if k == "raiz" else f"$.{k}")) for k in ("raiz", *ENVELOPE)])
    other = F.try_variant_get(F.element_at("m", F.col("via")), "$", "array<variant>")
    return found.where("via IS NOT NULL").select(F.explode(F.coalesce(usual, other)).alias("item"), "via")


def provider_candles(spark: SparkSession, path: str) -> DataFrame:
    """(ticker, date, open, high, low, close, volume) from envelopes of text numbers, newest first; no close, no row."""
    raw = spark.read.schema("symbol string, values array<struct<datetime: string, open: string, high: string, low: string, close: string, volume: string>>").option("multiLine", True).json(path)
    rows = raw.select(F.upper("symbol").alias("ticker"), F.explode("values").alias("c"))
    out = rows.select("ticker", F.try_to_date(F.substring("c.datetime", 1, 10), "yyyy-MM-dd").alias("date"), *[to_number(f"c.{k}").alias(k) for k in ("open", "high", "low", "close", "volume")])
    return out.where("close IS NOT NULL AND date IS NOT NULL")


#: Fixed: the second provider's names of a candle's fields, and the keys of its envelopes.
CODED = {"open": "PREABE", "high": "PREMAX", "low": "PREMIN", "close": "PREULT"}
CODED_ENVELOPE = ("data", "results", "historico")


def coded_candles(spark: SparkSession, path: str) -> DataFrame:
    """(ticker, date, open, high, low, close, volume) of the provider with coded field names: an array at the root or in an
    envelope, one file a ticker (the file's name). Dates are yyyymmdd, yyyy-mm-dd or dd/mm/yyyy; the volume is VOLTOT, or
    else QUATOT; no close, no row."""
    raw = spark.read.text(path, wholetext=True).select(F.upper(F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)(\.[^.]*)?$", 1)).alias("ticker"), F.try_parse_json("value").alias("v"))
    arrays = F.coalesce(*[F.try_variant_get("v", k, "array<variant>") for k in ("$", *[f"$.{k}" for k in CODED_ENVELOPE])])
    text = lambda k: F.try_variant_get("c", f"$.{k}", "string")
    day = F.coalesce(F.try_to_date(F.substring(text("DATPRG"), 1, 10), "yyyy-MM-dd"), date_br(text("DATPRG")), F.try_to_date(text("DATPRG"), "yyyyMMdd"))
    rows = raw.select("ticker", F.explode(arrays).alias("c"))
    out = rows.select("ticker", day.alias("date"), *[to_number(text(k)).alias(name) for name, k in CODED.items()], to_number(F.coalesce(text("VOLTOT"), text("QUATOT"))).alias("volume"))
    return out.where("close IS NOT NULL AND date IS NOT NULL")


def curated_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A curated file: header and types must be these, or reading fails."""
    return spark.read.csv(path, header=True, schema=schema, enforceSchema=False, mode="FAILFAST")


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, row, line): the lines that aren't blank, numbered from 1 in each file, in its order.

    A file may be cut into many parts that are read apart: each part counts its lines, and the counts of a file's earlier parts
    are added to a line's place in its own, so that no task holds more than a part. Only the counts are sorted."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("part"))
    lines = lines.where(F.trim("value") != "").withColumn("id", F.monotonically_increasing_id())  # without gaps inside a part
    parts = lines.groupBy("file", "part").agg(F.count("*").alias("n"), F.min("id").alias("first"))
    before = F.sum("n").over(Window.partitionBy("file").orderBy("part")) - F.col("n")
    parts = parts.select("file", "part", "first", before.alias("before"))
    return lines.join(parts, ["file", "part"]).select("file", (F.col("before") + F.col("id") - F.col("first") + 1).alias("row"), F.col("value").alias("line"))


def curated_rows(spark: SparkSession, path: str, fields: dict[str, str], required: tuple[str, ...] | None = None) -> DataFrame:
    """The fields (name: string, double or date), with ``file``, ``row`` and ``error``: good and rejected rows of curated files.

    The error is invalid_header for a file's first row if it doesn't begin with these names, and invalid_row_<row> where a
    required field (all, unless given) is blank, no finite number or no date. Good rows have none; the header's row only comes
    back when it is wrong. Texts may be quoted; values are trimmed."""
    names = list(fields)
    raw = F.from_csv(F.regexp_replace("line", "^\ufeff|\\r$", ""), ", ".join(f"`{n}` string" for n in names), {"quote": '"', "escape": '"'})
    t = numbered_lines(spark, path).select("file", "row", raw.alias("r"))
    text = {n: F.nullif(F.trim(F.col("r")[n]), F.lit("")) for n in names}
    read = {"string": lambda c: c, "double": to_number, "date": lambda c: F.try_to_date(F.when(c.rlike(r"^\d{4}-\d{2}-\d{2}$"), c), "yyyy-MM-dd")}
    value = {n: read[kind](text[n]) for n, kind in fields.items()}
    head = F.forall(F.array(*[F.struct(F.coalesce(text[n], F.lit("")).alias("a"), F.lit(n).alias("b")) for n in names]), lambda x: x["a"] == x["b"])
    bad = F.exists(F.array(*[value[n].isNull() for n in (names if required is None else required)]), lambda x: x)
    error = F.when(F.col("row") == 1, "invalid_header").when(bad, F.concat(F.lit("invalid_row_"), "row"))
    return t.where((F.col("row") > 1) | ~head).select("file", "row", *[v.alias(n) for n, v in value.items()], error.alias("error"))


def strict(rows: DataFrame) -> DataFrame:
    """Rows without their error; reading one that has one fails, and names it."""
    first = rows.columns[0]
    return rows.withColumn(first, F.when(F.col("error").isNotNull(), F.raise_error(F.col("error")).cast(rows.schema[first].dataType)).otherwise(F.col(first))).drop("error")


def context_package(spark: SparkSession, path: str, schema: str, version: str | None = None, rules: dict | None = None) -> DataFrame:
    """Packages as rows, one a file, with ``state``: missing (no file; the fields are null), invalid_json, incompatible (by
    ``contextSchemaVersion`` against ``version``), invalid_contract (a rule of {name: broken, a Column} is broken), seed
    (is_seed_mode) or available. Without ``version`` and ``rules`` these two are not checked. A file of no bytes, which Spark
    passes over, gives no row."""
    from ..operators.contracts import compatibility
    from .shared import exists

    if not exists(spark, path):
        return spark.createDataFrame([("missing",)], "state string").select(F.from_json(F.lit(None).cast("string"), schema).alias("p"), "state").select("p.*", "state")
    raw = spark.read.text(path, wholetext=True)
    v = F.try_parse_json("value")
    is_object = F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False))
    t = raw.select(F.from_json("value", schema).alias("p"), is_object.alias("_json"), F.try_variant_get(v, "$.contextSchemaVersion", "string").alias("_version"), F.try_variant_get(v, "$.is_seed_mode", "boolean").alias("_seed"))
    t = t.select("p.*", "_json", "_version", "_seed")
    state = F.when(~F.col("_json"), "invalid_json")
    if version:
        state = state.when(compatibility("_version", version) == "incompatible", "incompatible")
    for broken in (rules or {}).values():
        state = state.when(F.coalesce(broken, F.lit(False)), "invalid_contract")
    return t.withColumn("state", state.when(F.coalesce("_seed", F.lit(False)), "seed").otherwise("available")).drop("_json", "_version", "_seed")


def write_csv(df: DataFrame, path: str, compression: str | None = None) -> None:
    """A whole new version or none: Spark's committer moves finished files only."""
    df.write.mode("overwrite").csv(path, header=True, quote='"', escape='"', compression=compression)


def write_gated_json(df: DataFrame, errors: str, path: str) -> bool:
    """Write the rows as JSON unless one has errors."""
    if df.where(F.size(errors) > 0).isEmpty():
        df.drop(errors).write.mode("overwrite").json(path)
        return True
    return False


def manifest(df: DataFrame, date: str, status: str) -> DataFrame:
    """Rows, span and the share of each status, in one aggregate."""
    g = df.groupBy(status).agg(F.count("*").alias("n"), F.min(date).alias("first_date"), F.max(date).alias("last_date"))
    return g.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy()))


def write_run(df: DataFrame, path: str, date: str, maturity: str, added, restated, revisions: DataFrame, log: DataFrame, keys: list[str]) -> dict:
    """Write the merged table as Parquet, and tell of the run: rows, first and last date, rows added and restated (boolean columns;
    null counts as no) and the share restated in percent, revisions that the log doesn't hold yet and those that it does (by keys,
    nulls being equal, each once), and distinct maturities.

    Counts and dates are observed while the rows are written; maturities, which no such metric can count, come from that one
    column of the files. An empty table has no dates and no share."""
    from pyspark.sql import Observation

    seen, count = Observation(), lambda c: F.count(F.when(c, 1))
    df.observe(seen, F.count(F.lit(1)).alias("rows"), count(added).alias("added"), count(restated).alias("restated"), F.min(date).alias("first"), F.max(date).alias("last")).write.mode("overwrite").parquet(path)
    out = dict(seen.get)
    out["restated_pct"] = 100 * out["restated"] / out["rows"] if out["rows"] else None
    both = revisions.select(*keys).distinct().withColumn("_new", F.lit(1)).unionByName(log.select(*keys).distinct().withColumn("_new", F.lit(0)))
    met = both.groupBy(*keys).agg(F.min("_new").alias("low"), F.max("_new").alias("high")).where("high = 1").agg(count(F.col("low") == 1).alias("new"), count(F.col("low") == 0).alias("known")).head()
    stored = df.sparkSession.read.parquet(path)
    return out | {"revisions_new": met.new, "revisions_known": met.known, "maturities": stored.agg(F.count_distinct(maturity)).head()[0]}


#: Month names of the flow reports, and the bulletin's investor categories (accent-free).
MONTHS = ("jan", "fev", "mar", "abr", "mai", "jun", "jul", "ago", "set", "out", "nov", "dez")
CATEGORIES = ("pessoas fisicas", "institucionais", "investidores estrangeiros", "empresas", "instituicoes financeiras", "outros")


def foreign_flow_report(spark: SparkSession, path: str, anchor: str, cutoff: str) -> DataFrame:
    """(file, data_ref, flow): rows ``Mon/Mon/YYYY;..;balance`` after the anchor, in millions. A month ends at its last
    day, the cut-off day's month at that day."""
    lines = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), F.posexplode(F.split("value", r"\r?\n")).alias("pos", "line"))
    first = lines.where(plain_text("line").rlike(anchor)).groupBy("file").agg(F.min("pos").alias("at"))
    rows = lines.join(first, "file").where("pos > at")
    month = F.array_position(F.array(*map(F.lit, MONTHS)), F.lower(F.regexp_extract("line", r"^\s*([A-Za-z]{3})/", 1))).cast("int")
    year = F.regexp_extract("line", r"^\s*[A-Za-z]{3}/[A-Za-z]{3}/(\d{4});", 1).try_cast("int")
    rows = rows.select("file", "pos", month.alias("m"), year.alias("y"), (parse_number_br(F.element_at(F.split("line", ";"), -1)) * 1e6).alias("flow")).where("m > 0 AND y IS NOT NULL AND flow IS NOT NULL")
    end, cut = F.last_day(F.make_date("y", "m", F.lit(1))), F.lit(cutoff).cast("date")
    dated = rows.select("file", "pos", F.when(F.last_day(cut) == end, cut).otherwise(end).alias("data_ref"), "flow")
    return dated.groupBy("file", "data_ref").agg(F.min_by("flow", "pos").alias("flow"))


def investor_bulletin(spark: SparkSession, path: str) -> DataFrame:
    """(file, category, buys, sells, balance, error): lines with a category and four numbers (buys, %, sells, %), in
    thousands; another count of numbers is an error row; the first line of a category counts."""
    lines = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), F.posexplode(F.split("value", r"\r?\n")).alias("pos", "line"))
    t = lines.withColumn("p", plain_text("line")).withColumn("category", F.coalesce(*[F.when(F.col("p").startswith(c), F.lit(c)) for c in CATEGORIES])).where("category IS NOT NULL")
    n = F.transform(F.regexp_extract_all("line", F.lit(r"(-?\d[\d.,]*)"), 1), parse_number_br)
    t = t.withColumn("n", n).withColumn("_r", F.row_number().over(Window.partitionBy("file", "category").orderBy("pos"))).where("_r = 1")
    ok = F.size("n") == 4
    buys, sells = F.get("n", F.lit(0)) * 1000, F.get("n", F.lit(2)) * 1000
    return t.select("file", "category", F.when(ok, buys).alias("buys"), F.when(ok, sells).alias("sells"), F.when(ok, buys - sells).alias("balance"), F.when(~ok, F.concat(F.lit("numbers: "), F.size("n"))).alias("error"))


#: The markets of the bulletin's volume table, in its order.
MARKETS = ("a_vista", "a_termo", "opcoes", "exercicios", "blocos", "total_geral")


def market_volumes(spark: SparkSession, path: str) -> DataFrame:
    """(file, category, market, value, share): the bulletin's volumes by market. Only lines with a category and twelve numbers
    count: six pairs of a value and its share in percent. It is volume, and never a balance."""
    lines = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), F.posexplode(F.split("value", r"\r?\n")).alias("pos", "line"))
    t = lines.withColumn("p", plain_text("line")).withColumn("category", F.coalesce(*[F.when(F.col("p").startswith(c), F.lit(c)) for c in CATEGORIES])).where("category IS NOT NULL")
    n = F.filter(F.transform(F.regexp_extract_all("line", F.lit(r"(\d[\d.]*,\d{1,2}|\d[\d.]{2,})"), 1), parse_number_br), lambda x: x.isNotNull())
    pairs = F.array(*[F.struct(F.lit(m).alias("market"), F.get("n", F.lit(2 * k)).alias("value"), F.get("n", F.lit(2 * k + 1)).alias("share")) for k, m in enumerate(MARKETS)])
    return t.withColumn("n", n).where(F.size("n") == 12).select("file", "category", F.inline(pairs))


def account_facts(members: dict[tuple[str, str], DataFrame], accounts: DataFrame, tickers: DataFrame) -> DataFrame:
    """(ticker, metric, fiscal_year, value, scope, version) of statement members {(statement, scope): frame with company,
    code, value, period_end, order, version}, by the account map (statement, code, metric) and the ticker map."""
    frames = [df.withColumn("statement", F.lit(s)).withColumn("scope", F.lit(scope)) for (s, scope), df in members.items()]
    rows = frames[0]
    for f in frames[1:]:
        rows = rows.unionByName(f)
    rows = rows.where(plain_text("order").isin("ultimo", "penultimo"))
    return rows.join(accounts, ["statement", "code"]).join(tickers, "company").select("ticker", "metric", F.year("period_end").alias("fiscal_year"), to_number("value").alias("value"), "scope", "version")


def bulk_upsert(stored: DataFrame, payload: DataFrame, schema: str, keys: list[str]) -> DataFrame:
    """Rows of a JSON recordset column (payload.body) into a table: insert or take over by key."""
    from ..operators.pit import upsert

    rows = payload.select(F.inline(F.from_json("body", f"array<struct<{schema}>>")))
    return upsert(stored, rows, keys)
