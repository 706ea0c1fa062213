"""Queries over shapes of providers' rows, terms, statements and stages."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..fixtures import candles_step, investments, observations, table, with_views
from ..functions.columns import round_half_up as rnd
from ..operators import joins as J
from ..operators import metrics as M
from ..operators import models as Q
from ..operators import shaping as S
from .lookups import _split_events
from .registry import query, r4


@query("filter_bond_class", "SELECT p_partkey, p_partkey % 3 = 0 AS keep FROM part")
def filter_bond_class(spark, d):
    m = F.col("p_partkey") % 3
    return table(spark, d, "part").select("p_partkey", S.bond_class(F.when(m == 0, "Tesouro IPCA+").when(m == 1, "Tesouro IPCA+ com Juros Semestrais").otherwise("Tesouro Renda+ Aposentadoria")).alias("keep"))


@query("filter_net_income_parent", "SELECT p_partkey, p_partkey % 2 = 0 AS keep FROM part")
def filter_net_income_parent(spark, d):
    even = F.col("p_partkey") % 2 == 0
    return table(spark, d, "part").select("p_partkey", S.parent_income_line(F.lit("3.11"), F.when(even, "Lucro/Prejuízo Consolidado do Período").otherwise("Lucro das Operações do Período")).alias("keep"))


@query("filter_controller_child", "SELECT p_partkey, p_partkey % 3 = 0 AS keep FROM part")
def filter_controller_child(spark, d):
    m = F.col("p_partkey") % 3
    return table(spark, d, "part").select("p_partkey", S.controller_line(F.when(m == 2, "3.10.01").otherwise("3.11.01"), F.lit("3.11"), F.when(m == 1, "Sócios não Controladores").otherwise("Atribuído a Sócios da Controladora")).alias("keep"))


@query("derive_capital_structure", f"SELECT c_custkey, {r4('c_acctbal - c_nationkey * 100')} AS net_debt, {r4('(c_acctbal - c_nationkey * 100) / nullif(c_nationkey, 0)')} AS net_debt_to_ebitda, {r4('(c_acctbal - 50.0) / nullif(c_nationkey, 0) * 100')} AS fcf_conversion, {r4('c_acctbal / 2000 * 100')} AS ocf_margin FROM customer")
def capital_structure(spark, d):
    c = table(spark, d, "customer").select("c_custkey", F.col("c_acctbal").alias("debt"), (F.col("c_nationkey") * 100).alias("cash"), F.col("c_nationkey").alias("ebitda"), F.col("c_acctbal").alias("operating_cf"), F.lit(-50.0).alias("capex"), F.lit(2000.0).alias("revenue"), F.lit(1e4).alias("market_cap"))
    return M.rounded(S.capital_structure(c).select("c_custkey", "net_debt", "net_debt_to_ebitda", "fcf_conversion", "ocf_margin"))


@query("project_legacy_envelope", "SELECT c_custkey, 'balance' AS label, CASE WHEN c_custkey % 3 > 0 THEN c_acctbal * 10 END AS value, c_custkey % 3 > 0 AS ok, CASE WHEN c_custkey % 3 > 0 THEN 'automatic' ELSE 'manual_fallback' END AS mode FROM customer")
def legacy_envelope(spark, d):
    c = table(spark, d, "customer").withColumn("v", F.when(F.col("c_custkey") % 3 > 0, F.col("c_acctbal"))).select("c_custkey", S.value_item(F.lit("balance"), "v", F.lit("2026-01-01").cast("date"), "c_mktsegment", 10.0).alias("i"))
    return c.select("c_custkey", "i.label", "i.value", "i.ok", "i.mode")


@query("observation_envelope", "SELECT c_custkey, CASE WHEN c_custkey % 4 > 0 THEN 'official' ELSE 'unavailable' END AS status, CASE WHEN c_custkey % 4 > 0 THEN c_acctbal END AS value, CASE WHEN c_custkey % 4 > 0 THEN 'percent' END AS unit FROM customer")
def observation_envelope(spark, d):
    c = table(spark, d, "customer").withColumn("v", F.when(F.col("c_custkey") % 4 > 0, F.col("c_acctbal"))).select("c_custkey", S.observation("v", "none", "percent").alias("o"))
    return c.select("c_custkey", "o.status", "o.value", "o.unit")


@query("join_sector_matrix", "SELECT p_partkey, CASE WHEN p_type = 'PROMO' THEN 'not_applicable' WHEN p_size % 2 = 0 THEN 'mode_' || p_size % 5 ELSE 'unknown' END AS mode FROM part")
def sector_matrix(spark, d):
    p = table(spark, d, "part").select("p_partkey", "p_type", "p_size")
    sizes = p.select("p_size").distinct().where("p_size % 2 = 0").select("p_size", F.concat(F.lit("mode_"), F.col("p_size") % 5).alias("m"))
    return p.join(sizes, "p_size", "left").select("p_partkey", F.when(F.col("p_type") == "PROMO", "not_applicable").otherwise(F.coalesce("m", F.lit("unknown"))).alias("mode"))


_TERMS = "terms AS (SELECT n_nationkey AS id, r_name AS country, DATE '1995-06-15' + CAST(n_nationkey * 40 AS INTEGER) AS start, DATE '1997-06-15' + CAST(n_nationkey * 40 AS INTEGER) AS stop FROM nation JOIN region ON n_regionkey = r_regionkey)"


def _terms(spark, d):
    n = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    at = lambda day: F.date_add(F.lit(day).cast("date"), F.col("n_nationkey") * 40)
    return n.select(F.col("n_nationkey").alias("id"), F.col("r_name").alias("country"), at("1995-06-15").alias("start"), at("1997-06-15").alias("stop"))


@query("current_term_per_country", f"WITH {_TERMS} SELECT id, country, start, stop FROM terms QUALIFY row_number() OVER (PARTITION BY country ORDER BY start DESC, id) = 1")
def current_term(spark, d):
    return S.current_term(_terms(spark, d))


_SHEET = with_views("", "observations") + f""", {_TERMS}, g AS (SELECT id, s.series, e.k, CASE WHEN e.k = 'start' THEN start ELSE stop END AS day FROM terms, (VALUES ('BUILDING'), ('MACHINERY')) s(series), (VALUES ('start'), ('stop')) e(k)), f AS (SELECT g.*, o.value FROM g ASOF LEFT JOIN observations o ON g.series = o.series AND g.day >= o.date),
 w AS (SELECT id, series, max(value) FILTER (k = 'start') AS a, max(value) FILTER (k = 'stop') AS b FROM f GROUP BY 1, 2)"""


@query("macro_term_sheet", f"{_SHEET} SELECT id, series, {r4('a')} AS v_start, {r4('b')} AS v_stop, floor((b - a) / a * 1e4 + 0.5) / 100 AS change FROM w")
def macro_term_sheet(spark, d):
    return S.term_sheet(_terms(spark, d), observations(spark, d), ["BUILDING", "MACHINERY"])


@query("split_term_series_join", f"{_SHEET} SELECT series, k, count(*) AS n, count(value) AS found FROM f GROUP BY 1, 2")
def split_term_series(spark, d):
    s = S.term_sheet(_terms(spark, d), observations(spark, d), ["BUILDING", "MACHINERY"])
    long = s.select("series", F.explode(F.array(F.struct(F.lit("start").alias("k"), F.col("v_start").alias("v")), F.struct(F.lit("stop").alias("k"), F.col("v_stop").alias("v")))).alias("e"))
    return long.groupBy("series", F.col("e.k").alias("k")).agg(F.count("*").alias("n"), F.count("e.v").alias("found"))


@query("term_completeness", f"{_SHEET} SELECT id, count(a) + count(b) AS filled, count(a) + count(b) < 3 AS few FROM w GROUP BY 1")
def term_completeness(spark, d):
    s = S.term_sheet(_terms(spark, d), observations(spark, d), ["BUILDING", "MACHINERY"])
    g = s.groupBy("id").agg((F.count("v_start") + F.count("v_stop")).alias("filled"))
    return g.withColumn("few", F.col("filled") < 3)


_ST = "st AS (SELECT o_custkey AS company, CAST(year(o_orderdate) AS INTEGER) AS fy, sum(o_totalprice) AS revenue FROM orders GROUP BY 1, 2), rk AS (SELECT *, row_number() OVER (PARTITION BY company ORDER BY fy DESC) AS r, count(*) OVER (PARTITION BY company) AS n FROM st)"


def _statements(spark, d):
    return table(spark, d, "orders").groupBy(F.col("o_custkey").alias("company"), F.year("o_orderdate").alias("fy")).agg(F.sum("o_totalprice").alias("revenue"))


@query("latest_previous_statement", f"WITH {_ST} SELECT company, max(n) AS n, max(fy) FILTER (r = 1) AS fy_latest, max(fy) FILTER (r = 2) AS fy_previous, {r4('max(revenue) FILTER (r = 1)')} AS revenue_latest, {r4('max(revenue) FILTER (r = 2)')} AS revenue_previous FROM rk WHERE r <= 2 GROUP BY 1")
def latest_previous(spark, d):
    return M.rounded(S.latest_two(_statements(spark, d), "company", "fy", ["revenue"]).drop("revenue_growth"))


@query("growth_vs_previous", f"WITH {_ST} SELECT company, {r4('(max(revenue) FILTER (r = 1) - max(revenue) FILTER (r = 2)) / max(revenue) FILTER (r = 2) * 100')} AS growth FROM rk WHERE r <= 2 GROUP BY 1")
def growth(spark, d):
    return S.latest_two(_statements(spark, d), "company", "fy", ["revenue"]).select("company", rnd("revenue_growth", 4).alias("growth"))


@query("latest_period_pick", f"WITH {_ST} SELECT company, fy AS period, {r4('revenue')} AS revenue FROM rk WHERE r = 1")
def latest_period(spark, d):
    return M.rounded(S.latest_two(_statements(spark, d), "company", "fy", ["revenue"]).select("company", F.col("fy_latest").alias("period"), F.col("revenue_latest").alias("revenue")))


@query("latest_value_per_indicator", """WITH i AS (SELECT event_type AS indicator, user_id % 2 AS priority, ts AS date, event_id, CASE WHEN user_id % 2 = 0 AND event_type = 'view' THEN NULL ELSE value END AS value FROM events)
 SELECT indicator, priority, date, value FROM i WHERE value IS NOT NULL QUALIFY row_number() OVER (PARTITION BY indicator ORDER BY priority, date DESC) = 1""")
def latest_indicator(spark, d):
    e = table(spark, d, "events").select(F.col("event_type").alias("indicator"), (F.col("user_id") % 2).alias("priority"), F.col("ts").alias("date"), F.when(~((F.col("user_id") % 2 == 0) & (F.col("event_type") == "view")), F.col("value")).alias("value"))
    return S.latest_indicator(e)


@query("adjustment_sum", f"""WITH o AS (SELECT user_id AS key, event_type AS dimension, arg_min(value - 20, event_id) AS d FROM events WHERE event_id % 3 <> 0 GROUP BY 1, 2) SELECT key, {r4('greatest(0.0, least(10.0, sum(d)))')} AS total, count(*) AS n FROM o GROUP BY 1""")
def adjustment_sum(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").alias("key"), F.col("event_type").alias("dimension"), F.col("event_id").alias("ordinal"), (F.col("event_id") % 3 != 0).alias("accepted"), F.lit(20.0).alias("before"), F.col("value").alias("after"))
    return M.rounded(S.adjustment_sum(e))


@query("package_lineage", """WITH p AS (SELECT o_orderkey AS id, o_custkey AS created, CAST(o_orderdate AS DATE) AS m FROM orders)
 SELECT id, row_number() OVER w AS version, lag(id) OVER w AS supersedes, coalesce(m < max(m) OVER (ORDER BY created, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS refused FROM p WINDOW w AS (PARTITION BY m ORDER BY created, id)""")
def package_lineage(spark, d):
    p = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.to_date("o_orderdate").alias("market_date"), F.col("o_custkey").alias("created"))
    return S.lineage(p).select("id", "version", "supersedes", "refused")


@query("reindex_by_terms", "SELECT s_suppkey AS id, CASE WHEN s_suppkey % 2 = 0 THEN 'debt,margin' ELSE 'debt' END AS terms FROM supplier WHERE s_suppkey % 2 = 0 OR s_suppkey % 3 = 0")
def reindex_by_terms(spark, d):
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"))
    have = s.select("id", F.array(F.lit("debt")).alias("terms"), F.when(F.col("id") % 3 == 0, 1).otherwise(2).alias("parser"))
    want = s.select("id", F.when(F.col("id") % 2 == 0, F.array(F.lit("debt"), F.lit("margin"))).otherwise(F.array(F.lit("debt"))).alias("terms"))
    return S.reindex(have, want, 2).select("id", F.array_join("terms", ",").alias("terms"))


@query("seed_honesty", "SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN 'seed_not_declared' WHEN c_custkey % 4 = 1 THEN 'seed_without_source' END AS error FROM customer")
def seed_honesty(spark, d):
    m = F.col("c_custkey") % 4
    src = F.array(F.lit("official"), F.when(m.isin(0, 2), "seed").otherwise("official"))
    return table(spark, d, "customer").select("c_custkey", S.seed_honesty(src, F.when(m.isin(1, 2), "seed").otherwise("live"), F.lit(0.1), F.lit(0.3)).alias("error"))


@query("final_consolidation", "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'COMPRAR' WHEN o_orderkey % 2 = 0 THEN 'EVITAR' ELSE 'APROVADO' END AS verdict, CASE WHEN o_orderkey % 3 = 0 THEN 'additions' WHEN o_orderkey % 2 = 0 THEN 'deep' ELSE 'scan' END AS stage FROM orders")
def final_consolidation(spark, d):
    k = F.col("o_orderkey")
    return table(spark, d, "orders").select("o_orderkey", S.final_stage(F.when(k % 3 == 0, "COMPRAR"), F.when(k % 2 == 0, "EVITAR"), F.lit("APROVADO")).alias("f")).select("o_orderkey", "f.verdict", "f.stage")


@query("event_witness_analysis", with_views(f"""SELECT ticker, CASE WHEN nb < 20 OR na < 5 THEN 'insufficient_coverage' WHEN abs(ln(a / b)) < ln(1.10) THEN 'continuous' WHEN abs(ln(a / b * r)) < ln(1.20) THEN 'raw_step' ELSE 'inconsistent' END AS verdict FROM (SELECT ticker, arg_max(close, date) FILTER (date < DATE '1998-06-01') AS b, arg_min(close, date) FILTER (date >= DATE '1998-06-01') AS a,
 count(*) FILTER (date < DATE '1998-06-01') AS nb, count(*) FILTER (date >= DATE '1998-06-01') AS na, CASE ticker % 4 WHEN 1 THEN 2.0 WHEN 2 THEN 0.1 ELSE 3.0 END AS r FROM candles_step WHERE ticker % 4 <> 0 GROUP BY ticker)""", "candles_step"))
def event_witness(spark, d):
    b = J.event_boundary(_split_events(spark, d), candles_step(spark, d))
    ratio = F.element_at(F.array(F.lit(2.0), F.lit(0.1), F.lit(3.0)), (F.col("ticker") % 4).cast("int"))
    few = (F.col("n_before") < 20) | (F.col("n_after") < 5)
    return b.select("ticker", F.when(few, "insufficient_coverage").otherwise(Q.continuity(F.col("after_close") / F.col("before_close"), ratio)).alias("verdict"))


@query("module_availability_gate", with_views("SELECT id, CASE WHEN horizon <= 0 OR irr <= -100 THEN 'hurdle_invalid' WHEN horizon > (SELECT max(vertex) FROM curve WHERE data_ref = (SELECT max(data_ref) FROM curve)) THEN 'hurdle_out_of_curve' END AS reject FROM investments", "curve", "investments"))
def module_gate(spark, d):
    from ..fixtures import curve

    h = Q.hurdle_alpha(investments(spark, d), curve(spark, d))
    ok = F.col("status").isin("exact", "floor", "interpolated")
    return h.select("id", F.when(~ok, F.concat(F.lit("hurdle_"), F.col("status"))).alias("reject"))


@query("governance_chain", """WITH e AS (SELECT event_id, user_id, ts, CASE event_type WHEN 'purchase' THEN 'COMPRAR' WHEN 'view' THEN 'MONITORAR' WHEN 'click' THEN 'AGUARDAR' WHEN 'error' THEN 'EVITAR' ELSE 'APROVADO' END AS verdict, event_id % 5 = 0 AS expired FROM events),
 g AS (SELECT *, CASE WHEN expired AND verdict IN ('COMPRAR', 'MONITORAR', 'AGUARDAR') THEN 'EVITAR' ELSE verdict END AS allowed FROM e), r AS (SELECT *, CASE allowed WHEN 'EVITAR' THEN 1 WHEN 'AGUARDAR' THEN 2 WHEN 'MONITORAR' THEN 3 ELSE 4 END AS rk FROM g), w AS (SELECT *, lag(rk) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS was FROM r)
 SELECT event_id, allowed, CASE WHEN was IS NULL THEN 'first' WHEN rk > was THEN 'better' WHEN rk < was THEN 'worse' ELSE 'kept' END AS change FROM w""")
def governance_chain(spark, d):
    from .models import _events_verdict

    e = _events_verdict(spark, d).withColumns({"phase": F.lit("final"), "edge": F.when(F.col("event_id") % 5 == 0, "expired").otherwise("declared")})
    chained = e.transform(Q.edge_guardrail).withColumn("verdict", F.col("allowed")).transform(Q.verdict_transition, "user_id", ["ts", "event_id"])
    return chained.select("event_id", "allowed", "change")
