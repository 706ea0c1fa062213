"""Projections that bring providers' and filings' rows into the library's shapes, and rules over stages and terms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import col, finite, free_cash_flow, pct_change, plain_text, safe_divide
from ..functions.columns import round_half_up as rnd


def bond_class(name) -> Column:
    """Zero-coupon inflation bonds by name: no coupon, education or retirement lines."""
    n = plain_text(name)
    return n.contains("ipca") & ~n.rlike("juros semestrais|educa|renda")


def parent_income_line(code, description) -> Column:
    """Net income of the period: an account 3.NN whose text says so; lines of operations are other things."""
    t = plain_text(description)
    return col(code).rlike(r"^3\.\d{2}$") & t.rlike("(lucro|prejuizo).*(periodo|exercicio|consolidado)") & ~t.rlike("operac")


def controller_line(code, parent, description) -> Column:
    """A child of the parent line that is the controller's share."""
    t = plain_text(description)
    return col(code).startswith(F.concat(col(parent), F.lit("."))) & t.contains("controlador") & ~t.rlike(r"nao\W*controlador")


def capital_structure(df: DataFrame) -> DataFrame:
    """net_debt, leverage, cash flow and margins from debt, cash, ebitda, operating_cf, capex, revenue, market_cap."""
    fcf, net = free_cash_flow("operating_cf", "capex"), F.col("debt") - F.col("cash")
    return df.withColumns(
        {
            "net_debt": net, "free_cash_flow": fcf, "net_debt_to_ebitda": safe_divide(net, "ebitda"), "fcf_yield": safe_divide(fcf, "market_cap") * 100, "fcf_conversion": safe_divide(fcf, "ebitda") * 100,
            "ocf_margin": safe_divide("operating_cf", "revenue") * 100,
        }
    )


def value_item(label: Column, value, date, source, scale: float = 1.0) -> Column:
    """(label, value, date, source, ok, mode); without a value it is for manual entry."""
    v = finite(value)
    return F.struct(label.alias("label"), (v * scale).alias("value"), col(date).alias("date"), col(source).alias("source"), v.isNotNull().alias("ok"), F.when(v.isNotNull(), "automatic").otherwise("manual_fallback").alias("mode"))


def observation(value, transform: str, unit: str) -> Column:
    """Official with its transform and unit, or unavailable with nulls."""
    v = finite(value)
    known = v.isNotNull()
    return F.struct(F.when(known, "official").otherwise("unavailable").alias("status"), v.alias("value"), F.when(known, transform).alias("transform"), F.when(known, unit).alias("unit"))


def latest_two(df: DataFrame, key: str, order: str, fields: list[str]) -> DataFrame:
    """Per key the latest and the previous row's fields, the count, and the change in percent."""
    w = Window.partitionBy(key).orderBy(F.desc(order))
    r = df.withColumn("_r", F.row_number().over(w)).where("_r <= 2")
    n = df.groupBy(key).agg(F.count("*").alias("n"))
    g = r.groupBy(key).agg(*[F.max(F.when(F.col("_r") == k, F.col(f))).alias(f"{f}_{name}") for f in [order, *fields] for k, name in ((1, "latest"), (2, "previous"))])
    return g.join(n, key).select("*", *[pct_change(f"{f}_latest", f"{f}_previous").alias(f"{f}_growth") for f in fields])


def current_term(terms: DataFrame) -> DataFrame:
    """The term with the greatest start of each country."""
    return terms.withColumn("_r", F.row_number().over(Window.partitionBy("country").orderBy(F.desc("start"), "id"))).where("_r = 1").drop("_r")


def latest_indicator(df: DataFrame) -> DataFrame:
    """Per indicator the newest known value of the best source (least priority that has one)."""
    known = df.where("value IS NOT NULL")
    per = known.groupBy("indicator", "priority").agg(F.max("date").alias("date"), F.max_by("value", "date").alias("value"))
    return per.withColumn("_r", F.row_number().over(Window.partitionBy("indicator").orderBy("priority"))).where("_r = 1").drop("_r")


def term_sheet(terms: DataFrame, series: DataFrame, names: list[str], max_gap: int = 140) -> DataFrame:
    """terms (id, start, stop) with each series' value at both ends (nearest within the gap) and its change in percent."""
    from . import joins

    ends = terms.select("id", F.explode(F.array(F.struct(F.lit("start").alias("end"), F.col("start").alias("at")), F.struct(F.lit("stop").alias("end"), F.col("stop").alias("at")))).alias("e")).select("id", "e.end", "e.at")
    grid = ends.withColumn("series", F.explode(F.array(*map(F.lit, names))))
    found = joins.asof_nearest(grid.select("series", "at").distinct(), series.where(F.col("series").isin(*names)), "series", max_gap)
    wide = grid.join(found, ["series", "at"]).groupBy("id", "series").agg(*[F.max(F.when(F.col("end") == e, F.col("found_value"))).alias(f"v_{e}") for e in ("start", "stop")])
    return wide.select("id", "series", rnd("v_start", 4).alias("v_start"), rnd("v_stop", 4).alias("v_stop"), rnd(pct_change("v_stop", "v_start"), 2).alias("change"))


def adjustment_sum(df: DataFrame, most: float = 10.0) -> DataFrame:
    """Per key, the first valid adjustment of each dimension (by ordinal); their changes added up and clamped to 0..most."""
    ok = df.where(F.col("accepted") & F.col("before").isNotNull() & F.col("after").isNotNull())
    one = ok.groupBy("key", "dimension").agg(F.min_by(F.col("after") - F.col("before"), "ordinal").alias("d"))
    return one.groupBy("key").agg(F.greatest(F.lit(0.0), F.least(F.lit(most), F.sum("d"))).alias("total"), F.count("*").alias("n"))


def lineage(packages: DataFrame) -> DataFrame:
    """Version and superseded id of packages (id, market_date, created): versions count within a market date; a package
    whose market date is older than one before it is refused."""
    w = Window.partitionBy("market_date").orderBy("created", "id")
    firsts = packages.where("market_date IS NOT NULL").groupBy("market_date").agg(F.min(F.struct("created", "id")).alias("_first"))
    later = Window.orderBy(F.desc("market_date")).rowsBetween(Window.unboundedPreceding, -1)  # one row a date
    firsts = firsts.select("market_date", F.min("_first").over(later).alias("_newer"))
    numbered = packages.withColumns({"version": F.row_number().over(w), "supersedes": F.lag("id").over(w)}).join(firsts, "market_date", "left")
    refused = F.coalesce(F.col("_newer") < F.struct("created", "id"), F.lit(False))
    return numbered.select(*packages.columns, "version", "supersedes", refused.alias("refused"))


def reindex(have: DataFrame, wanted: DataFrame, parser: int, most: int = 16) -> DataFrame:
    """Sources to parse again (id, terms): another parser version, or terms that are not indexed; with the union of terms."""
    j = have.join(wanted.withColumnRenamed("terms", "asked"), "id")
    missing = F.size(F.array_except("asked", "terms")) > 0
    return j.where((F.col("parser") != parser) | missing).select("id", F.slice(F.sort_array(F.array_union("terms", "asked")), 1, most).alias("terms"))


def seed_honesty(sources: Column, mode: Column, penalty: Column, confidence: Column) -> Column:
    """Error of a package with a seed source that does not say so, or the reverse; null if honest."""
    seeded = F.exists(sources, lambda s: s == "seed")
    honest = (mode == "seed") & (penalty > 0) & (confidence <= 0.35)
    return F.when(seeded & ~honest, "seed_not_declared").when(~seeded & (mode == "seed"), "seed_without_source")


def final_stage(additions, deep, scan) -> Column:
    """The latest analytical stage that is there, and its name."""
    a, d, s = col(additions), col(deep), col(scan)
    return F.struct(F.coalesce(a, d, s).alias("verdict"), F.when(a.isNotNull(), "additions").when(d.isNotNull(), "deep").when(s.isNotNull(), "scan").alias("stage"))
