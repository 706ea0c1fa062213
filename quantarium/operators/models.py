"""Composed models: hurdles, flow pressure, inflation defence, splits, quality scores, ledgers and verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import band, plain_text, reasons
from ..functions.columns import round_half_up as rnd
from . import joins as J
from . import metrics as M

# -- curves -------------------------------------------------------------------


def hurdle_alpha(investments: DataFrame, curve: DataFrame) -> DataFrame:
    """Expected return over the latest curve's rate at the horizon. Below the first vertex its rate is the floor; beyond
    the last there is no hurdle. Alpha is taken from the rounded hurdle."""
    b = J.bracket(investments, J.latest_curve(curve))
    h, irr = F.col("horizon"), F.col("irr")
    status = (
        F.when(h.isNull() | irr.isNull(), "missing_input").when((h <= 0) | (irr <= -100), "invalid").when(F.col("last").isNull(), "no_curve").when(h > F.col("last"), "out_of_curve")
        .when(h == F.col("first"), "exact").when(h < F.col("first"), "floor").when(F.abs(h - F.col("lo")) <= 1e-9, "exact").otherwise("interpolated")
    )
    x = b.withColumn("status", status)
    rate = F.when(F.col("status") == "floor", F.col("first_rate")).when(F.col("status").isin("exact", "interpolated"), J.interpolate())
    x = x.withColumn("hurdle", rnd(rate, 4)).withColumn("alpha", rnd(F.col("irr") - F.col("hurdle"), 4))
    return x.select("id", "irr", "horizon", "status", "hurdle", "alpha", (F.col("alpha") > 0).alias("beats"))


def real_rate_flat(points: DataFrame, curve: DataFrame) -> DataFrame:
    """The rate at ``horizon`` of the latest curve: linear inside, flat outside; rates and vertices above zero only."""
    b = J.bracket(points, J.latest_curve(curve.where("rate > 0 AND vertex > 0")))
    rate = F.when(F.col("lo").isNull(), F.col("first_rate")).when(F.col("hi").isNull(), F.col("last_rate")).otherwise(J.interpolate())
    return b.select(*points.columns, rnd(rate, 4).alias("rate"))


def flow_pressure(flow: DataFrame, days: int = 90) -> DataFrame:
    """Window flow of each segment, its percentile among the last 24, the pressure and, at 24 months, the extreme."""
    k = -(-days // 30)
    p = M.percentile_of_last(M.rolling_sum_months(flow, k))
    last = flow.groupBy("segment").agg((F.max("data_ref") != F.last_day(F.max("data_ref"))).alias("pending"))
    q = F.col("percentile")
    pressure = F.when(q > 0.6, "buying").when(q < 0.4, "selling").when(q.isNotNull(), "neutral")
    extreme = F.when(F.col("kind") == "canonical", F.when(q > 0.9, "high").when(q < 0.1, "low"))
    return p.join(last, "segment").select("segment", "data_ref", rnd("window_sum", 2).alias("window_sum"), rnd(q, 4).alias("percentile"), "kind", pressure.alias("pressure"), extreme.alias("extreme"), "pending")


# -- inflation defence --------------------------------------------------------


def defence_window(facts: DataFrame, base: int, stress_end: int, factor: float) -> DataFrame:
    """Scores of one stress window by ticker from yearly facts (one version each): real revenue growth, the change of
    gross and operating margins, and of working capital to revenue; each 1, 0.5 or 0. Null where a figure is missing."""
    wide = facts.where(F.col("fiscal_year").isin(base, stress_end)).groupBy("ticker").agg(
        *[F.max(F.when((F.col("metric") == m) & (F.col("fiscal_year") == y), F.col("value"))).alias(f"{m}_{k}") for m in ("revenue", "gross_profit", "ebit", "working_capital") for k, y in (("a", base), ("b", stress_end))]
    )
    share = lambda m, k: F.try_divide(F.col(f"{m}_{k}"), F.col(f"revenue_{k}")) * 100
    real = (F.try_divide(F.col("revenue_b"), F.col("revenue_a")) / factor - 1) * 100
    step = lambda x, good, fair: F.when(x >= good, 1.0).when(x >= fair, 0.5).when(x.isNotNull(), 0.0)
    capital = share("working_capital", "b") - share("working_capital", "a")
    return wide.select(
        "ticker", step(real, 0, -5).alias("s_revenue"), step(share("gross_profit", "b") - share("gross_profit", "a"), -1, -3).alias("s_gross"), step(share("ebit", "b") - share("ebit", "a"), -1, -3).alias("s_operating"),
        F.when(capital <= 1, 1.0).when(capital <= 3, 0.5).when(capital.isNotNull(), 0.0).alias("s_capital"),
    )


def inflation_defence(facts: DataFrame, windows: list[tuple[int, int, float]]) -> DataFrame:
    """Mean of all windows' scores times five; real from 3.75, nominal to 2, else mixed; incomplete if a figure lacks."""
    parts = [defence_window(facts, *w) for w in windows]
    cols = ["s_revenue", "s_gross", "s_operating", "s_capital"]
    out = parts[0].select("ticker", F.array(*cols).alias("s0"))
    for i, p in enumerate(parts[1:], 1):
        out = out.join(p.select("ticker", F.array(*cols).alias(f"s{i}")), "ticker")
    every = F.flatten(F.array(*[f"s{i}" for i in range(len(parts))]))
    mean = F.aggregate(every, F.lit(0.0), lambda a, x: a + x) / F.size(every) * 5
    score = rnd(mean, 2)
    return out.select("ticker", score.alias("score"), F.when(mean.isNull(), "incomplete").when(score >= 3.75, "real").when(score <= 2, "nominal").otherwise("mixed").alias("verdict"))


# -- splits -------------------------------------------------------------------


def split_adjust(candles: DataFrame, events: DataFrame) -> DataFrame:
    """Prices before an event divided by, volumes multiplied with, the product of all later ratios (ticker, date, ratio)."""
    e = events.select("ticker", "date", F.ln("ratio").alias("_l"))
    j = candles.join(e, ["ticker", "date"], "left")
    later = Window.partitionBy("ticker").orderBy(F.desc("date")).rowsBetween(Window.unboundedPreceding, -1)
    j = j.withColumn("factor", F.exp(F.coalesce(F.sum("_l").over(later), F.lit(0.0)))).drop("_l")
    prices = [c for c in ("open", "high", "low", "close") if c in candles.columns]
    return j.select("ticker", "date", *[(F.col(c) / F.col("factor")).alias(c) for c in prices], (F.col("volume") * F.col("factor")).alias("volume"), "factor")


def split_engine(candles: DataFrame) -> DataFrame:
    """Detect, adjust by accepted events, detect again: per ticker the events found, left and rejected, and the status.

    A rejected raw jump withdraws the adjustment: nothing is adjusted by half.
    """
    jumps = M.detect_jumps(candles)
    tally = jumps.groupBy("ticker").agg(F.count_if(F.col("status") == "accepted").alias("accepted"), F.count_if(F.col("status") == "rejected").alias("rejected"))
    adjusted = split_adjust(candles, jumps.where("status = 'accepted'"))
    left = M.detect_jumps(adjusted).groupBy("ticker").agg(F.count_if(F.col("status") == "accepted").alias("remaining"))
    mm = M.market_metrics(adjusted.withColumn("open", F.col("close"))).select("ticker", "cagr", "max_drawdown")
    z = lambda c: F.coalesce(F.col(c), F.lit(0))
    out = mm.join(tally, "ticker", "left").join(left, "ticker", "left").select("ticker", z("accepted").alias("accepted"), z("rejected").alias("rejected"), z("remaining").alias("remaining"), "cagr", "max_drawdown")
    sane_dd, sane_cagr = F.col("max_drawdown") > -95, F.abs("cagr") <= 80
    status = (
        F.when(F.col("rejected") > 0, "rejected_jump").when(~sane_dd, "drawdown_implausible").when(~sane_cagr, "cagr_implausible").when(F.col("remaining") > 0, "validation_failed")
        .when(F.col("accepted") > 0, "adjusted").otherwise("clean")
    )
    return out.withColumn("status", status)


def series_integrity(engine: DataFrame) -> DataFrame:
    """100 less 40 a rejected or remaining event, 30 for a failed validation, 25 for a retreat; the band, and the cap it
    puts on the quality index."""
    retreat = F.col("status").isin("rejected_jump", "drawdown_implausible", "cagr_implausible", "validation_failed")
    score = F.lit(100) - 40 * F.col("rejected") - 40 * F.col("remaining") - F.when(F.col("status") == "validation_failed", 30).otherwise(0) - F.when(retreat, 25).otherwise(0)
    s = F.greatest(F.lit(0), F.least(F.lit(100), score)).cast("int")
    x = engine.withColumn("integrity", s)
    return x.withColumn("band", band("integrity", (85, "clean"), (60, "minor"), (40, "contaminated"), otherwise="severe")).withColumn("cap", F.when(F.col("band") == "severe", 40).when(F.col("band") == "contaminated", 50).when(F.col("band") == "minor", 75))


def continuity(observed: Column, ratio: Column) -> Column:
    """continuous, raw step (the series still holds the step), or inconsistent."""
    return F.when(F.abs(F.ln(observed)) < F.ln(F.lit(1.10)), "continuous").when(F.abs(F.ln(observed * ratio)) < F.ln(F.lit(1.20)), "raw_step").otherwise("inconsistent")


def adjustment_plan(verdicts: DataFrame) -> DataFrame:
    """Per ticker: blocked by any inconsistent event, else apply the raw steps, else done."""
    g = verdicts.groupBy("ticker").agg(F.bool_or(F.col("verdict") == "inconsistent").alias("bad"), F.bool_or(F.col("verdict") == "raw_step").alias("raw"), F.count("*").alias("n"))
    return g.select("ticker", F.when(F.col("bad"), "blocked").when(F.col("raw"), "apply").otherwise("done").alias("plan"), "n")


# -- scores -------------------------------------------------------------------


def history_depth(n) -> Column:
    return band(n, (2000, 100), (1260, 95), (756, 85), (504, 70), (252, 50), (126, 35), (60, 20), (1, 10), otherwise=0)


#: Classes of liquidity with their least volume in the currency and in others, and of the quality index.
LIQUIDITY = {"USD": (("alta", 10e6), ("média", 1e6)), None: (("alta", 5e6), ("média", 3e5))}
RATINGS = ((85, "alta"), (70, "boa"), (50, "média"))


def liquidity_class(volume, currency) -> Column:
    v, usd = F.col(volume), F.upper(currency) == "USD"
    by = lambda c: F.when(v >= LIQUIDITY[c][0][1], LIQUIDITY[c][0][0]).when(v >= LIQUIDITY[c][1][1], LIQUIDITY[c][1][0]).otherwise("baixa")
    return F.when(v.isNull(), "indefinida").when(usd, by("USD")).otherwise(by(None))


def quality_rating(score) -> Column:
    return F.when(F.col(score).isNull(), "indefinido").otherwise(band(score, *RATINGS, otherwise="baixa"))


#: Weights of the quality index's dimensions.
WEIGHTS = {"quote": 20, "history": 25, "fundamental": 25, "statements": 20, "macro": 10, "consistency": 20}


def data_quality_index(scores: DataFrame, cap: str | None = None) -> DataFrame:
    """The weighted mean of the dimensions that apply (null: not applicable), at most ``cap``, with its rating."""
    total = sum((F.when(F.col(k).isNotNull(), F.col(k) * w).otherwise(0) for k, w in WEIGHTS.items()), F.lit(0.0))
    weight = sum((F.when(F.col(k).isNotNull(), w).otherwise(0) for k, w in WEIGHTS.items()), F.lit(0))
    raw = F.try_divide(total, weight)
    score = rnd(F.least(raw, F.col(cap)) if cap else raw, 1)
    return scores.withColumn("score", score).withColumn("rating", quality_rating("score"))


def economic_profile(text) -> Column:
    t = plain_text(text)
    return F.when(t.rlike("fundo|fund|etf|fii"), "fund").when(t.rlike("segur|insur"), "insurance").when(t.rlike("banc|bank"), "bank").otherwise("industrial")


# -- regimes ------------------------------------------------------------------


def regime_labels(df: DataFrame) -> DataFrame:
    """Labels of a term from real_rate, rate_change, inflation, credit_change, currency_change, growth_start, growth_end;
    country picks the target and the currency band."""
    br = F.col("country") == "BR"
    target = F.when(br, 3.0).otherwise(2.0)
    moved = lambda c, up, down, flat, by: F.when(F.col(c) > by, up).when(F.col(c) < -by, down).when(F.col(c).isNotNull(), flat)
    level = F.when(F.col("real_rate") >= 4, "alto").when(F.col("real_rate") >= 1, "neutro").when(F.col("real_rate").isNotNull(), "baixo").otherwise("?")
    i, a, b = F.col("inflation"), F.col("growth_start"), F.col("growth_end")
    return df.withColumns(  # fixed values: the labels
        {
            "rate_regime": F.concat_ws("/", level, F.coalesce(moved("rate_change", "subindo", "caindo", "estável", 0.5), F.lit("estável"))),
            "inflation_regime": F.when(i < 0, "deflação").when(i <= target + 1.5, "ancorada").when(i <= target + 5, "pressionada").when(i.isNotNull(), "desancorada"),
            "credit_regime": moved("credit_change", "expansão", "contração", "neutro", 0.5),
            "currency_regime": F.when(br, moved("currency_change", "BRL depreciou", "BRL apreciou", "estável", 5)).otherwise(moved("currency_change", "dólar fortaleceu", "dólar enfraqueceu", "estável", 3)),
            "cycle": F.when(b < 0, F.when(a < 0, "contração").otherwise("entrando em contração")).when(a < 0, "recuperação").when(b < a, "desaceleração").when(b.isNotNull(), "expansão"),
        }
    )


def context_regime(policy, inflation) -> Column:
    p, i = F.col(policy), F.col(inflation)
    return F.when(p.isNull() | i.isNull(), "insufficient").when((p >= 10) & (i > 4.5), "tight_and_pressured").when(p >= 10, "tight").when(i > 4.5, "pressured").otherwise("near_band")


def freshness(df: DataFrame, as_of: str, key: str) -> DataFrame:
    """Mean freshness max(0, 1 - age / max_age), share of official sources, and the confidence from both."""
    age = F.datediff(F.lit(as_of).cast("date"), F.col("observed"))
    g = df.groupBy(key).agg(F.avg(F.greatest(F.lit(0.0), 1 - age / F.col("max_age"))).alias("fresh"), F.avg((F.col("status") == "official").cast("double")).alias("coverage"))
    return g.select(key, rnd("fresh", 2).alias("freshness"), rnd("coverage", 2).alias("coverage"), rnd(F.greatest(F.lit(0.0), 0.55 * F.col("fresh") + 0.45 * F.col("coverage") - 0.1), 2).alias("confidence"))


def unit_inference(x) -> Column:
    v = F.abs(F.col(x))
    return F.when(v >= 1e9, "unit").when(v >= 1e6, "thousand").when(v.isNotNull(), "million").otherwise("unknown")


def market_scope(volume, spot, total, tolerance: float = 0.02) -> Column:
    near = lambda x: F.abs(F.try_divide(F.col(volume), F.col(x)) - 1) <= tolerance
    return F.when(near(spot), "spot").when(near(total), "total").otherwise("undefined")


# -- verdicts and ledgers -----------------------------------------------------

#: Rank of each verdict.
VERDICTS = {"VETADO": 0, "EVITAR": 1, "AGUARDAR": 2, "WATCHLIST": 2, "MONITORAR": 3, "APROVADO": 4, "COMPRAR": 4}


def verdict_rank(v) -> Column:
    return F.coalesce(*[F.when(F.col(v) == k, r) for k, r in VERDICTS.items()])


def verdict_transition(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """better, worse, kept or first against the entity's verdict before; unknown verdicts give unknown."""
    x = df.withColumn("rank", verdict_rank("verdict"))
    before = F.lag("rank").over(Window.partitionBy(key).orderBy(*order))
    first = F.row_number().over(Window.partitionBy(key).orderBy(*order)) == 1
    return x.withColumn("was", before).withColumn("change", F.when(first, "first").when(F.col("rank").isNull() | F.col("was").isNull(), "unknown").when(F.col("rank") > F.col("was"), "better").when(F.col("rank") < F.col("was"), "worse").otherwise("kept"))


def edge_guardrail(df: DataFrame) -> DataFrame:
    """The verdict that an edge's state allows in its phase (scan, deep or final), and whether it was lowered."""
    v, scan = F.col("verdict"), F.col("phase") == "scan"
    expired, undeclared = F.col("edge") == "expired", F.col("edge") == "undeclared"
    out = (
        F.when(scan & (expired | undeclared) & (v == "APROVADO"), "WATCHLIST").when(~scan & expired & v.isin("COMPRAR", "MONITORAR", "AGUARDAR"), "EVITAR").when(~scan & undeclared & (v == "COMPRAR"), "MONITORAR").otherwise(v)
    )
    return df.withColumn("allowed", out).withColumn("lowered", F.col("allowed") != v)


def edge_ledger(df: DataFrame, as_of: str) -> DataFrame:
    """Errors of a ledger record (type, evidence, input, expiry, declared_on, status), its completeness and its state."""
    need = ("type", "evidence", "input", "expiry", "declared_on", "status")
    blank = lambda c: F.coalesce(F.trim(F.col(c)), F.lit("")) == ""
    rules = [(f"missing_{c}", blank(c)) for c in need]
    rules += [("bad_type", ~blank("type") & ~F.col("type").isin("informational", "analytical", "behavioural", "structural")), ("bad_date", ~blank("declared_on") & F.try_to_date("declared_on", "yyyy-MM-dd").isNull()), ("vague_expiry", ~blank("expiry") & (F.length("expiry") < 20))]
    x = df.withColumn("errors", reasons(*rules))
    share = sum((F.when(blank(c), 0).otherwise(1) for c in need), F.lit(0)) / len(need)
    state = F.when(F.size("errors") > 0, "undeclared").when(F.col("status") == "expired", "expired").otherwise("declared")
    return x.withColumn("completeness", rnd(share, 2)).withColumn("state", state)


def price_zone(df: DataFrame) -> DataFrame:
    """Targets (array) against 75 to 85 % of a zone: valid if all lie in the band and below the zone; else corrected."""
    lo, hi = F.col("zone_low") * 0.75, F.col("zone_high") * 0.85
    ok = F.forall("targets", lambda p: (p >= lo) & (p <= hi) & (p < F.col("zone_low")))
    return df.withColumn("status", F.when(F.col("zone_low").isNull() | (F.size("targets") == 0), "unverifiable").when(ok, "valid").otherwise("corrected")).withColumn("band_low", rnd(lo, 2)).withColumn("band_high", rnd(F.least(hi, F.col("zone_low")), 2))


def lookup_outcome(attempts: DataFrame) -> DataFrame:
    """found if one attempt found it; unavailable if one failed; else not_found."""
    g = attempts.groupBy("ticker").agg(F.bool_or(F.col("result") == "found").alias("f"), F.bool_or(F.col("result") == "error").alias("e"))
    return g.select("ticker", F.when(F.col("f"), "found").when(F.col("e"), "unavailable").otherwise("not_found").alias("outcome"))
