"""Price-series aggregates and windows. All work on one layout: partition by ticker, order by date.

A daily series of one ticker is small; ticks are rolled up first (with partial aggregation), so a ticker with a third
of all trades costs no more than others. Metrics of one series share a single shuffle and sort.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import round_half_up

DAYS = 252


def by_date(*key: str):
    return Window.partitionBy(*(key or ("ticker",))).orderBy("date")


def ohlcv_daily_rollup(ticks: DataFrame) -> DataFrame:
    """Daily candles from trades (ticker, ts, price, volume, seq): first, highest, lowest, last price and the volume.

    Rows without a price are left out; a missing volume adds nothing.
    """
    t = ticks.where(F.col("price").isNotNull())
    return t.groupBy("ticker", F.to_date("ts").alias("date")).agg(
        F.min_by("price", F.struct("seq", "price")).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", F.struct("seq", "price")).alias("close"), F.sum(F.coalesce("volume", F.lit(0.0))).alias("volume")
    )


def with_returns(candles: DataFrame) -> DataFrame:
    """previous close, simple and log return."""
    before = F.lag("close").over(by_date())
    ok = (before > 0) & (F.col("close") > 0)
    return candles.withColumn("prev_close", before).withColumn("ret", F.when(ok, F.col("close") / before - 1)).withColumn("log_ret", F.when(ok, F.ln(F.col("close") / before)))


def with_peak(candles: DataFrame) -> DataFrame:
    """Running peak of the close, its date, and the fall from it in percent."""
    w = by_date().rowsBetween(Window.unboundedPreceding, Window.currentRow)
    peak = F.max("close").over(w)
    return candles.withColumn("peak", peak).withColumn("drawdown", (F.col("close") / F.col("peak") - 1) * 100).withColumn("peak_date", F.max(F.when(F.col("close") == F.col("peak"), F.col("date"))).over(w))


def with_ranks(candles: DataFrame) -> DataFrame:
    """n: the place from the first date; back: from the last; both from 1."""
    return candles.withColumn("n", F.row_number().over(by_date())).withColumn("back", F.row_number().over(Window.partitionBy("ticker").orderBy(F.desc("date"))))


def moving_average(candles: DataFrame, lengths: tuple[int, ...] = (20, 50, 200)) -> DataFrame:
    """sma_n of the close, null before n closes, and the price's distance from it in percent."""
    out = candles
    for k in lengths:
        w = by_date().rowsBetween(-(k - 1), 0)
        out = out.withColumn(f"sma_{k}", F.when(F.count("close").over(w) == k, F.avg("close").over(w)))
        out = out.withColumn(f"from_sma_{k}", F.try_divide(F.col("close"), F.col(f"sma_{k}")) * 100 - 100)
    return out


def close_n_ago(candles: DataFrame, lengths: tuple[int, ...] = (30, 90, 180, 252)) -> DataFrame:
    return candles.select("*", *[F.lag("close", k).over(by_date()).alias(f"close_{k}_ago") for k in lengths])


def series_summary(df: DataFrame, key: str = "series") -> DataFrame:
    """Rows, nulls, span, extremes and the inferred periodicity of each series (series, date, value)."""
    gap = F.datediff("date", F.lag("date").over(Window.partitionBy(key).orderBy("date")))
    g = df.withColumn("gap", gap).groupBy(key).agg(
        F.count("*").alias("n"), F.count_if(F.col("value").isNull()).alias("nulls"), F.min("date").alias("first_date"), F.max("date").alias("last_date"), F.min("value").alias("low"), F.max("value").alias("high"), F.percentile("gap", 0.5).alias("gap")
    )
    kind = F.when(F.col("gap") <= 4, F.lit("daily")).when(F.col("gap") <= 10, F.lit("weekly")).when(F.col("gap") <= 45, F.lit("monthly")).when(F.col("gap") <= 120, F.lit("quarterly")).when(F.col("gap").isNotNull(), F.lit("annual")).otherwise(F.lit("unknown"))
    return g.withColumn("periodicity", kind).drop("gap")


def volatility(log_ret: Column, back: Column, length: int) -> Column:
    """Annualised sample deviation of the log returns among the last ``length`` candles; null if too few (aggregate)."""
    inside = F.when((back < length) & log_ret.isNotNull(), log_ret)
    return F.when((F.max(back) >= min(length, 20)) & (F.count(inside) >= 2), F.stddev_samp(inside) * F.sqrt(F.lit(float(DAYS))) * 100)


def market_metrics(candles: DataFrame, risk_free: float = 0.0) -> DataFrame:
    """All price metrics of every ticker in one row, from one windowed frame."""
    frame = with_ranks(with_peak(with_returns(candles.where("close > 0"))))
    r, c, back, n = F.col("log_ret"), F.col("close"), F.col("back"), F.col("n")
    top, bottom = F.coalesce("high", "close"), F.coalesce("low", "close")
    last = F.max_by("close", "date")
    agg = frame.groupBy("ticker").agg(
        F.count("*").alias("n_candles"), F.min("date").alias("first_date"), F.max("date").alias("last_date"), last.alias("price"), F.min_by("close", "date").alias("first_close"),
        F.max(top).alias("range_high"), F.min_by("date", F.struct(-top, "date")).alias("range_high_date"), F.min(bottom).alias("range_low"), F.min_by("date", F.struct(bottom, "date")).alias("range_low_date"),
        F.avg("volume").alias("avg_volume"), F.avg(F.when((c > 0) & (F.col("volume") >= 0), c * F.col("volume"))).alias("avg_financial_volume"),
        *[F.avg(F.when(back <= k, c)).alias(f"mean_{k}") for k in (20, 50, 200)], *[F.max(F.when(back == k + 1, c)).alias(f"close_{k}_ago") for k in (30, 90, 180, 252)],
        *[volatility(r, back, k).alias(f"volatility_{k}") for k in (30, 90, 252)], F.avg(r).alias("mean_r"), F.stddev_samp(r).alias("sd_r"), F.count(r).alias("n_r"),
        F.sqrt(F.avg(F.when(r < 0, r * r))).alias("down_r"), F.sqrt(F.avg(F.col("drawdown") * F.col("drawdown"))).alias("ulcer_index"), F.min("drawdown").alias("max_drawdown"),
        F.min_by("date", F.struct("drawdown", "date")).alias("trough_date"), F.min_by("peak_date", F.struct("drawdown", "date")).alias("peak_date"), (F.avg(F.when(F.col("ret").isNotNull(), (F.col("ret") > 0).cast("double"))) * 100).alias("positive_share"),
        F.avg(F.when(n <= 5, c)).alias("anchor_start"), F.avg(F.when(back <= 5, c)).alias("anchor_end"),
    )
    years = F.col("n_candles") / float(DAYS)
    vol, mean = F.col("sd_r") * F.sqrt(F.lit(float(DAYS))) * 100, F.col("mean_r") * DAYS * 100
    down = F.col("down_r") * F.sqrt(F.lit(float(DAYS))) * 100
    growth = lambda a, b, y: F.when((a > 0) & (b > 0) & (y > 0), (F.pow(b / a, 1.0 / y) - 1) * 100)
    out = agg.withColumns(
        {
            "cagr": growth(F.col("first_close"), F.col("price"), F.datediff("last_date", "first_date") / 365.25),
            "cagr_smoothed": growth(F.col("anchor_start"), (F.col("anchor_end") + F.col("price")) / 2, years),
            "period_return": (F.col("price") / F.col("first_close") - 1) * 100,
            "amplitude": F.try_divide(F.col("range_high") - F.col("range_low"), F.col("range_low")) * 100,
            "position_in_range": F.try_divide(F.col("price") - F.col("range_low"), F.col("range_high") - F.col("range_low")) * 100,
            "from_high": (F.col("price") / F.col("range_high") - 1) * 100,
            "sharpe": F.when(F.col("n_r") >= 2, F.try_divide(mean - risk_free, vol)),
            "sortino": F.try_divide(mean - risk_free, down),
        }
    )
    fall = F.abs(F.col("max_drawdown"))
    out = out.withColumn("calmar", F.try_divide(F.col("cagr_smoothed"), fall)).withColumn("recovery", F.try_divide(F.col("period_return"), fall))
    for k in (20, 50, 200):
        out = out.withColumn(f"sma_{k}", F.when(F.col("n_candles") >= k, F.col(f"mean_{k}"))).drop(f"mean_{k}")
    return out.drop("mean_r", "sd_r", "n_r", "down_r", "anchor_start", "anchor_end")


def rounded(df: DataFrame, digits: int = 4) -> DataFrame:
    """All doubles rounded half up, for comparison between engines."""
    return df.select(*[round_half_up(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


# -- jumps and step series ----------------------------------------------------

#: Ratios that splits have, and the tolerances for jumps and for the nearest ratio.
CLEAN_RATIOS = (0.1, 0.125, 0.2, 0.25, 1 / 3, 0.5, 2.0, 3.0, 4.0, 5.0, 8.0, 10.0)
JUMP_LOW, JUMP_HIGH, RATIO_TOLERANCE = 0.6, 1.4, 1.08


def detect_jumps(candles: DataFrame) -> DataFrame:
    """Days whose close leaves [0.6, 1.4] of the day before, with the nearest clean ratio; accepted if near enough."""
    c = candles.where("close > 0")
    j = c.withColumn("prev_close", F.lag("close").over(by_date())).withColumn("observed", F.col("close") / F.col("prev_close"))
    j = j.where(~F.col("observed").between(JUMP_LOW, JUMP_HIGH)).withColumn("raw_ratio", 1 / F.col("observed"))
    options = F.array(*[F.struct(F.abs(F.ln(F.col("raw_ratio") / r)).alias("far"), F.lit(r).alias("ratio")) for r in CLEAN_RATIOS])
    best = F.array_min(options)
    j = j.withColumn("best", best)
    ok = F.col("best.far") <= F.ln(F.lit(RATIO_TOLERANCE))
    return j.select("ticker", "date", "prev_close", "close", "raw_ratio", F.when(ok, F.col("best.ratio")).alias("ratio"), F.when(ok, F.lit("accepted")).otherwise(F.lit("rejected")).alias("status"))


def duplicate_close(candles: DataFrame, apart: int = 20) -> DataFrame:
    """Candles whose close, to four decimals, is found again more than ``apart`` rows away."""
    same = Window.partitionBy("ticker", "close4")
    r = candles.withColumn("n", F.row_number().over(by_date())).withColumn("close4", round_half_up("close", 4))
    far = (F.max("n").over(same) - F.col("n") > apart) | (F.col("n") - F.min("n").over(same) > apart)
    return r.withColumn("suspicious", far).drop("close4", "n")


def detect_changes(df: DataFrame, key: str = "series") -> DataFrame:
    """Rows where a step series takes a new value; nulls are passed over."""
    before = F.last("value", ignorenulls=True).over(Window.partitionBy(key).orderBy("date").rowsBetween(Window.unboundedPreceding, -1))
    return df.withColumn("before", before).where(F.col("value").isNotNull() & F.col("before").isNotNull() & (F.col("value") != F.col("before")))


def flow_from_accumulated(df: DataFrame, key: str = "segment") -> DataFrame:
    """Daily flow from a month-to-date balance: the difference inside a month, the balance itself on its first day."""
    w = Window.partitionBy(key, F.trunc("date", "month")).orderBy("date")
    return df.withColumn("flow", F.coalesce(F.col("acc") - F.lag("acc").over(w), F.col("acc")))


def cadence(df: DataFrame, key: str = "segment") -> DataFrame:
    """Whether three consecutive values look accumulated (one sign, growing in size) or daily; null for the first two."""
    w = Window.partitionBy(key).orderBy("date")
    a, b, c = F.lag("acc", 2).over(w), F.lag("acc", 1).over(w), F.col("acc")
    grows = (F.abs(a) <= F.abs(b)) & (F.abs(b) <= F.abs(c)) & (F.signum(a) == F.signum(b)) & (F.signum(b) == F.signum(c))
    return df.withColumn("cadence", F.when(a.isNull(), None).when(grows, F.lit("accumulated")).otherwise(F.lit("daily")))


def rolling_sum_months(df: DataFrame, months: int, key: str = "segment") -> DataFrame:
    """Sum of the last ``months`` closed months (data_ref at month end), on full frames only."""
    closed = df.where(F.col("data_ref") == F.last_day("data_ref"))
    w = Window.partitionBy(key).orderBy("data_ref").rowsBetween(-(months - 1), 0)
    return closed.withColumn("window_sum", F.when(F.count("*").over(w) == months, F.sum("flow").over(w)))


def percentile_of_last(df: DataFrame, length: int = 24, key: str = "segment") -> DataFrame:
    """The last window_sum's rank among the last ``length``: (below + max(0, equal - 1) / 2) / (n - 1); canonical at
    full length, else provisional."""
    f = df.where("window_sum IS NOT NULL")
    f = f.withColumn("back", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("data_ref")))).where(F.col("back") <= length)
    f = f.withColumn("cur", F.first("window_sum").over(Window.partitionBy(key).orderBy("back")))
    g = f.groupBy(key).agg(F.max("data_ref").alias("data_ref"), F.max("cur").alias("window_sum"), F.count("*").alias("n"), F.count_if(F.col("window_sum") < F.col("cur")).alias("below"), F.count_if(F.col("window_sum") == F.col("cur")).alias("equal"))
    rank = F.try_divide(F.col("below") + F.greatest(F.lit(0), F.col("equal") - 1) / 2.0, F.col("n") - 1)
    return g.select(key, "data_ref", "window_sum", "n", rank.alias("percentile"), F.when(F.col("n") >= length, F.lit("canonical")).otherwise(F.lit("provisional")).alias("kind"))


def cumulative_inflation(rates: DataFrame, years: list[int]) -> DataFrame:
    """Product of 1 + rate / 100 over the years; null if one is missing. One row."""
    r = rates.where(F.col("year").isin(*years))
    return r.groupBy().agg(F.when(F.count("rate") == len(years), F.product(1 + F.col("rate") / 100)).alias("factor"))


def weighted_score(df: DataFrame, key: str) -> DataFrame:
    """Sum of score times weight over applicable, known dimensions, by their weight."""
    ok = F.col("applicable") & F.col("score").isNotNull()
    return df.groupBy(key).agg(F.try_divide(F.sum(F.when(ok, F.col("score") * F.col("weight"))), F.sum(F.when(ok, F.col("weight")))).alias("score"))


def presence_score(*columns: str) -> Column:
    return sum((F.col(c).isNotNull().cast("int") for c in columns), F.lit(0)) * 100.0 / len(columns)
