"""Joins and lookups: as-of, bracket, tolerant and preference joins as equi-joins, windows and aggregates.

As-of joins are a union and one window per key (no pairs are made). Range joins go through buckets of the bound, so
that they are equi-joins too. Small sides are left to Spark's size-checked broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Days of one bucket of a series: a window of an as-of join holds one bucket, and a row a bucket carries on.
BUCKET_DAYS = 90


def _neighbours(targets: DataFrame, series: DataFrame, key: str, at: str, date: str, value: str, ahead: bool = False) -> DataFrame:
    """targets with ``_found``, the (d, v) of their key's last observation on or before ``at``; with ``ahead``, the first
    on or after it.

    One sorted pass over the union of both inside each (key, bucket of days); where a bucket has no such observation,
    that of the nearest bucket that has one is carried, from one row a bucket.
    """
    cols = [c for c in targets.columns if c not in (key, at)]
    seen = F.struct(F.col(date).alias("d"), F.col(value).alias("v"))
    right = series.where(F.col(value).isNotNull() & F.col(date).isNotNull()).select(key, F.col(date).alias("_t"), F.lit(0).alias("_target"), seen.alias("_seen"))
    left = targets.select(key, F.col(at).alias("_t"), F.lit(1).alias("_target"), F.struct(at, *cols).alias("_row"))
    both = left.unionByName(right, allowMissingColumns=True).withColumn("_b", F.floor(F.datediff(F.col("_t"), F.lit("1970-01-01").cast("date")) / BUCKET_DAYS))
    pick, turn = (F.min, F.desc) if ahead else (F.max, F.asc)
    heads = both.groupBy(key, "_b").agg(pick("_seen").alias("_own"))
    carried = F.last("_own", ignorenulls=True).over(Window.partitionBy(key).orderBy(turn("_b")).rowsBetween(Window.unboundedPreceding, -1))
    heads = heads.select(key, "_b", carried.alias("_carried"))
    order = [F.desc("_t"), "_target"] if ahead else ["_t", "_target"]
    inside = F.last("_seen", ignorenulls=True).over(Window.partitionBy(key, "_b").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    met = both.withColumn("_inside", inside).where("_target = 1")
    joined = met.alias("x").join(heads.alias("y"), F.col(f"x.{key}").eqNullSafe(F.col(f"y.{key}")) & F.col("x._b").eqNullSafe(F.col("y._b")), "left")
    return joined.select(f"x.{key}", "_row.*", F.coalesce("_inside", "_carried").alias("_found"))


def asof_latest(targets: DataFrame, series: DataFrame, key: str, at: str = "at", date: str = "date", value: str = "value") -> DataFrame:
    """targets (key, at) with the last observation of the key on or before ``at``: found_date, found_value.

    Distinct (key, at) are looked up, however many targets share them, and the targets take what was found."""
    found = _neighbours(targets.select(key, at).distinct(), series, key, at, date, value)
    found = found.select(F.col(key).alias("_k"), F.col(at).alias("_a"), F.col("_found")["d"].alias("found_date"), F.col("_found")["v"].alias("found_value"))
    both = targets.join(found, F.col(key).eqNullSafe(F.col("_k")) & F.col(at).eqNullSafe(F.col("_a")))
    return both.select(key, at, *[c for c in targets.columns if c not in (key, at)], "found_date", "found_value")


def asof_nearest(targets: DataFrame, series: DataFrame, key: str, max_gap_days: int = 140, at: str = "at", date: str = "date", value: str = "value") -> DataFrame:
    """For each distinct (key, at), the last observation on or before ``at``; without one, the first after it; null beyond
    ``max_gap_days``."""
    back = _neighbours(targets.select(key, at).distinct(), series, key, at, date, value).withColumnRenamed("_found", "_back")
    both = _neighbours(back, series, key, at, date, value, ahead=True)
    pick = F.coalesce("_back", "_found")
    near = F.abs(F.datediff(pick["d"], F.col(at))) <= max_gap_days
    return both.select(key, at, F.when(near, pick["d"]).alias("found_date"), F.when(near, pick["v"]).alias("found_value"))


def event_boundary(events: DataFrame, candles: DataFrame, radius: int = 4) -> DataFrame:
    """events (ticker, boundary) with the last candle before the boundary and the first on or after it, how many there are on
    each side, and ``around``: (date, close) of the first on or after with ``radius`` candles on each side (none without one
    on or after). Candles without a close take no part; an event without any candle gives no row.

    Candles are numbered by date inside (ticker, bucket of days), on from the numbers of earlier buckets; an event gets the
    number of the last candle before it in the same pass, and its rows are fetched by number. No event meets all candles.
    """
    day = F.floor(F.datediff(F.col("_t"), F.lit("1970-01-01").cast("date")) / BUCKET_DAYS)
    known = candles.where("close IS NOT NULL AND date IS NOT NULL").select("ticker", F.col("date").alias("_t"), F.lit(1).alias("_candle"), F.struct("date", "close").alias("_c"))
    asked = events.distinct().where("boundary IS NOT NULL").select("ticker", F.col("boundary").alias("_t"), F.lit(0).alias("_candle"), F.struct(*events.columns).alias("_e"))
    both = known.unionByName(asked, allowMissingColumns=True).withColumn("_b", day)
    heads = both.groupBy("ticker", "_b").agg(F.sum("_candle").alias("_n"))
    by = Window.partitionBy("ticker")
    earlier = F.coalesce(F.sum("_n").over(by.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    heads = heads.select("ticker", "_b", earlier.alias("_earlier"), F.sum("_n").over(by).alias("_all"))
    inside = F.sum("_candle").over(Window.partitionBy("ticker", "_b").orderBy("_t", "_candle", F.col("_c.close")).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    numbered = both.withColumn("_inside", inside).join(heads, ["ticker", "_b"]).withColumn("_no", F.col("_inside") + F.col("_earlier"))
    rows = numbered.where("_candle = 1").select("ticker", "_no", "_c")
    met = numbered.where("_candle = 0 AND _all > 0").select("ticker", "_e", F.col("_no").alias("_before"), "_all")
    wanted = met.select("*", F.explode(F.sequence(F.col("_before") - (radius - 1), F.col("_before") + radius + 1)).alias("_no"))
    c, before, after = F.col("_c"), F.col("_no") == F.col("_before"), F.col("_no") == F.col("_before") + 1
    near = wanted.join(rows, ["ticker", "_no"], "left").groupBy("_e", "_before", "_all").agg(
        F.max(F.when(before, c)).alias("_x"), F.max(F.when(after, c)).alias("_y"), F.sort_array(F.collect_list(c)).alias("_around")
    )
    around = F.when(F.col("_y").isNull(), F.slice("_around", 1, 0)).otherwise(F.col("_around"))
    return near.select(
        "_e.*", F.col("_x.date").alias("before_date"), F.col("_x.close").alias("before_close"), F.col("_y.date").alias("after_date"), F.col("_y.close").alias("after_close"),
        F.col("_before").alias("n_before"), (F.col("_all") - F.col("_before")).alias("n_after"), around.alias("around"),
    )


def bracket(points: DataFrame, curve: DataFrame, at: str = "horizon") -> DataFrame:
    """points with the neighbours of ``at`` among the curve's vertices (one curve of a few dozen vertices).

    lo, lo_rate, hi, hi_rate; lo is null below the first vertex, hi above the last; both equal on a vertex. The curve
    is folded into one sorted array, a row whose size is that of one curve, and looked up per point.
    """
    one = curve.groupBy().agg(F.sort_array(F.collect_list(F.struct(F.col("vertex").alias("v"), F.col("rate").alias("r")))).alias("_c"))
    j = points.join(F.broadcast(one))
    hi = F.get(F.filter("_c", lambda x: x["v"] >= F.col(at)), F.lit(0))
    lo = F.get(F.reverse(F.filter("_c", lambda x: x["v"] <= F.col(at))), F.lit(0))
    ends = (F.get("_c", F.lit(0))["v"].alias("first"), F.get("_c", F.lit(0))["r"].alias("first_rate"), F.element_at("_c", -1)["v"].alias("last"), F.element_at("_c", -1)["r"].alias("last_rate"))
    return j.select(*points.columns, lo["v"].alias("lo"), lo["r"].alias("lo_rate"), hi["v"].alias("hi"), hi["r"].alias("hi_rate"), *ends)


def interpolate(at: str = "horizon") -> Column:
    """Between the neighbours of :func:`bracket`; the vertex's own rate on a vertex; null outside."""
    share = F.try_divide(F.col(at) - F.col("lo"), F.col("hi") - F.col("lo"))
    return F.when(F.col("lo").isNull() | F.col("hi").isNull(), None).when(F.col("hi") == F.col("lo"), F.col("lo_rate")).otherwise(F.col("lo_rate") + share * (F.col("hi_rate") - F.col("lo_rate")))


def align_inner(df: DataFrame, names: list[str], key: str = "series") -> DataFrame:
    """One row for each date on which every named series has a value."""
    return df.where(F.col(key).isin(*names) & F.col("value").isNotNull()).groupBy("date").pivot(key, names).agg(F.first("value")).dropna()


def latest_curve(curve: DataFrame) -> DataFrame:
    """Rows of the newest reference date."""
    newest = curve.groupBy().agg(F.max("data_ref").alias("data_ref"))
    return curve.join(F.broadcast(newest), "data_ref")


def filing_index(filings: DataFrame, index: DataFrame, keys: list[str], version: str) -> DataFrame:
    """filings with the receipt date of their index row, and the first receipt over all versions of the period."""
    first = Window.partitionBy(*keys)
    return filings.join(index.select(*keys, version, "received"), [*keys, version], "left").withColumn("first_received", F.min("received").over(first))


def disjunctive(documents: DataFrame, assets: DataFrame) -> DataFrame:
    """documents (doc_id, issuer, ticker_hint) with the assets (ticker, issuer) of their issuer or their hint: two
    equi-joins and a union, no nested loop."""
    a = documents.join(assets, "issuer").select("doc_id", "ticker")
    b = documents.where("ticker_hint IS NOT NULL").join(assets.select("ticker"), F.col("ticker_hint") == F.col("ticker")).select("doc_id", "ticker")
    return a.unionByName(b).distinct()


def prefer(official: DataFrame, other: DataFrame, key: str, values: list[str]) -> DataFrame:
    """Rows of both by key; the official row's values win where it has them."""
    o = other.select(key, *[F.col(v).alias(f"_{v}") for v in values])
    return official.join(o, key, "full_outer").select(key, *[F.coalesce(v, f"_{v}").alias(v) for v in values], F.when(F.col(values[0]).isNotNull(), F.lit("official")).otherwise(F.lit("supplementary")).alias("origin"))


def tolerant_match(witnesses: DataFrame, events: DataFrame, days: int = 5, ratio: float = 1.15) -> DataFrame:
    """For each witness (id, ticker, date, ratio) the nearest event of its ticker within the tolerances, by
    days + 10 x distance of logarithms. Dates meet by buckets of ``days`` + 1, so this is an equi-join."""
    size = days + 1
    day = lambda c: F.floor(F.datediff(c, F.lit("1970-01-01").cast("date")) / size)
    w = witnesses.withColumn("_b", F.explode(F.array(day(F.col("date")) - 1, day(F.col("date")), day(F.col("date")) + 1)))
    e = events.select("ticker", F.col("date").alias("event_date"), F.col("ratio").alias("event_ratio"), day(F.col("date")).alias("_b"))
    far = F.abs(F.ln(F.col("event_ratio") / F.col("ratio")))
    gap = F.abs(F.datediff("event_date", "date"))
    j = w.join(e, ["ticker", "_b"]).where((gap <= days) & (far <= F.ln(F.lit(ratio)))).withColumn("score", gap + 10 * far)
    best = j.groupBy("id").agg(F.min_by(F.struct("event_date", "event_ratio", "score"), F.struct("score", "event_date")).alias("m"))
    return witnesses.join(best, "id", "left").select(*witnesses.columns, "m.event_date", "m.event_ratio", "m.score")


def _rarest(rows: DataFrame, own: str, n: str, frequency: DataFrame, least: float) -> DataFrame:
    """The tokens of each set that it must share one of with any larger set that it overlaps enough: of its known tokens,
    rarest first, all but as many as a score of ``least`` needs, less one. A set with fewer known tokens has none."""
    ranked = rows.join(frequency, "token").withColumns(
        {"_r": F.row_number().over(Window.partitionBy(own).orderBy("_df", "token")), "_k": F.count("*").over(Window.partitionBy(own))}
    )
    return ranked.where(F.col("_r") <= F.col("_k") - F.ceil(F.col(n) * least - 1e-9) + 1).drop("_r", "_k", "_df")


def best_text_match(expected: DataFrame, candidates: DataFrame, least: float = 0.2) -> DataFrame:
    """For each expected row (id, tokens) the candidate (cand, tokens) with the largest overlap of at least ``least``: shared
    tokens over those of the smaller set.

    A prefix filter: pairs meet on the rarest tokens of the smaller set that it must share one of, so that words which most
    texts hold bring no pair together; only pairs met are compared in full. Empty sets match nothing.
    """
    e = expected.select("id", F.size("tokens").alias("n_e"), F.explode("tokens").alias("token"))
    c = candidates.select("cand", F.size("tokens").alias("n_c"), F.explode("tokens").alias("token")).join(e.select("token").distinct(), "token", "left_semi")
    frequency = c.groupBy("token").agg(F.count("*").alias("_df"))
    small_e, small_c = _rarest(e, "id", "n_e", frequency, least), _rarest(c, "cand", "n_c", frequency, least)
    pairs = small_e.join(c, "token").where("n_e <= n_c").select("id", "cand").unionByName(e.join(small_c, "token").where("n_c < n_e").select("id", "cand")).distinct()
    sets = c.groupBy("cand").agg(F.first("n_c").alias("n_c"), F.collect_list("token").alias("c_tokens"))
    met = pairs.join(expected.select("id", F.col("tokens").alias("e_tokens")), "id").join(sets, "cand")
    score = F.size(F.array_intersect("e_tokens", "c_tokens")) / F.least(F.size("e_tokens"), F.col("n_c"))
    w = Window.partitionBy("id").orderBy(F.desc("score"), "cand")
    return met.select("id", "cand", score.alias("score")).where(F.col("score") >= least).withColumn("_r", F.row_number().over(w)).where("_r = 1").select("id", "cand", "score")


def preferred_listing(df: DataFrame) -> DataFrame:
    """One row a symbol: exact home listing in the home currency, then the currency, then the first."""
    rank = F.when((F.col("country") == "US") & (F.col("currency") == "USD"), 0).when(F.col("currency") == "USD", 1).otherwise(2)
    return df.withColumn("_r", F.row_number().over(Window.partitionBy("symbol").orderBy(rank, "idx"))).where("_r = 1").drop("_r")
