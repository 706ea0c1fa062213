"""Queries over the composed models and the rules on tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..fixtures import candles, candles_step, curve, facts, flow, investments, table, with_views
from ..functions import columns as C
from ..operators import contracts as K
from ..operators import joins as J
from ..operators import metrics as M
from ..operators import models as Q
from ..operators import pit as P
from .lookups import _BR, _LIN, _split_events
from .prices import JUMPS_SQL, PCT_SQL
from .registry import query, r4

rnd = C.round_half_up
_CV = ", e AS (SELECT min(vertex) AS first, max(vertex) AS last, arg_min(rate, vertex) AS first_rate, arg_max(rate, vertex) AS last_rate FROM cv)"


@query("hurdle_alpha", with_views("", "curve", "investments") + f""", {_BR}{_CV}, s AS (SELECT *, CASE WHEN horizon <= 0 OR irr <= -100 THEN 'invalid' WHEN horizon > last THEN 'out_of_curve' WHEN horizon = first THEN 'exact' WHEN horizon < first THEN 'floor' WHEN horizon = lo THEN 'exact' ELSE 'interpolated' END AS status FROM ip, e),
 h AS (SELECT *, {r4(f"CASE WHEN status = 'floor' THEN first_rate WHEN status IN ('exact', 'interpolated') THEN {_LIN} END")} AS hurdle FROM s) SELECT id, irr, horizon, status, hurdle, {r4('irr - hurdle')} AS alpha, {r4('irr - hurdle')} > 0 AS beats FROM h""")
def hurdle_alpha(spark, d):
    return Q.hurdle_alpha(investments(spark, d), curve(spark, d))


@query("real_rate_flat", with_views("", "curve", "investments") + f", {_BR}{_CV} SELECT id, horizon, {r4(f'CASE WHEN lo IS NULL THEN first_rate WHEN hi IS NULL THEN last_rate ELSE {_LIN} END')} AS rate FROM ip, e")
def real_rate_flat(spark, d):
    return Q.real_rate_flat(investments(spark, d).select("id", "horizon"), curve(spark, d))


@query("flow_pressure", with_views("", "flow") + f""", {PCT_SQL}, l AS (SELECT segment, max(data_ref) <> last_day(max(data_ref)) AS pending FROM flow GROUP BY 1)
 SELECT segment, data_ref, floor(window_sum * 100 + 0.5) / 100 AS window_sum, {r4('percentile')} AS percentile, CASE WHEN n >= 24 THEN 'canonical' ELSE 'provisional' END AS kind, CASE WHEN percentile > 0.6 THEN 'buying' WHEN percentile < 0.4 THEN 'selling' WHEN percentile IS NOT NULL THEN 'neutral' END AS pressure,
 CASE WHEN n >= 24 THEN CASE WHEN percentile > 0.9 THEN 'high' WHEN percentile < 0.1 THEN 'low' END END AS extreme, pending FROM pct JOIN l USING (segment)""")
def flow_pressure(spark, d):
    return Q.flow_pressure(flow(spark, d))


def _yearly(spark, d):
    return P.pit_select(facts(spark, d), "2002-01-01").where("scope = 'consolidado'")


_YEARLY = """known AS (SELECT * FROM facts QUALIFY row_number() OVER (PARTITION BY ticker, scope, fiscal_year, metric ORDER BY known_at DESC, version DESC) = 1), best AS (SELECT ticker, arg_max(scope, (n, scope = 'consolidado')) AS scope FROM (SELECT ticker, scope, count(*) AS n FROM known GROUP BY 1, 2) GROUP BY 1),
 yr AS (SELECT known.* FROM known JOIN best USING (ticker, scope) WHERE scope = 'consolidado')"""


def _window_sql(name: str, a: int, b: int, factor: float) -> str:
    v = lambda m, y: f"max(value) FILTER (metric = '{m}' AND fiscal_year = {y})"
    margin = lambda m: f"({v(m, b)} / {v('revenue', b)} * 100 - {v(m, a)} / {v('revenue', a)} * 100)"
    step = lambda x, good, fair: f"CASE WHEN {x} >= {good} THEN 1.0 WHEN {x} >= {fair} THEN 0.5 WHEN {x} IS NOT NULL THEN 0.0 END"
    real = f"(({v('revenue', b)} / {v('revenue', a)} / {factor} - 1) * 100)"
    cap = margin("working_capital")
    return f"{name} AS (SELECT ticker, CAST({step(real, 0, -5)} + {step(margin('gross_profit'), -1, -3)} + {step(margin('ebit'), -1, -3)} + CASE WHEN {cap} <= 1 THEN 1.0 WHEN {cap} <= 3 THEN 0.5 WHEN {cap} IS NOT NULL THEN 0.0 END AS DOUBLE) AS s FROM yr WHERE fiscal_year IN ({a}, {b}) GROUP BY ticker)"


@query("inflation_defence", with_views("", "facts") + f", {_YEARLY}, {_window_sql('w1', 1995, 1997, 1.08)}, {_window_sql('w2', 1998, 2000, 1.12)}, t AS (SELECT ticker, floor((w1.s + w2.s) / 8 * 5 * 100 + 0.5) / 100 AS score FROM w1 JOIN w2 USING (ticker)) SELECT ticker, score, CASE WHEN score IS NULL THEN 'incomplete' WHEN score >= 3.75 THEN 'real' WHEN score <= 2 THEN 'nominal' ELSE 'mixed' END AS verdict FROM t")
def inflation_defence(spark, d):
    return Q.inflation_defence(_yearly(spark, d), [(1995, 1997, 1.08), (1998, 2000, 1.12)])


_ADJ = JUMPS_SQL + """, ev AS (SELECT ticker, date, best AS ratio FROM judged WHERE far <= ln(1.08)), adj AS (SELECT c.ticker, c.date, c.close / coalesce((SELECT product(ratio) FROM ev WHERE ev.ticker = c.ticker AND ev.date > c.date), 1) AS close, coalesce((SELECT product(ratio) FROM ev WHERE ev.ticker = c.ticker AND ev.date > c.date), 1) AS factor FROM candles_step c)"""


@query("split_adjust", with_views("", "candles_step") + f", {_ADJ} SELECT ticker, date, {r4('close')} AS close, {r4('factor')} AS factor FROM adj")
def split_adjust(spark, d):
    c = candles_step(spark, d)
    return M.rounded(Q.split_adjust(c, M.detect_jumps(c).where("status = 'accepted'")).select("ticker", "date", "close", "factor"))


@query("split_validate_post", with_views("", "candles_step") + f", {_ADJ} SELECT ticker, count(*) FILTER (close / p < 0.6 OR close / p > 1.4) AS jumps_left FROM (SELECT *, lag(close) OVER (PARTITION BY ticker ORDER BY date) AS p FROM adj) GROUP BY 1")
def split_validate(spark, d):
    c = candles_step(spark, d)
    left = M.detect_jumps(Q.split_adjust(c, M.detect_jumps(c).where("status = 'accepted'"))).groupBy("ticker").agg(F.count("*").alias("n"))
    return c.select("ticker").distinct().join(left, "ticker", "left").select("ticker", F.coalesce("n", F.lit(0)).alias("jumps_left"))


_ENGINE = "SELECT DISTINCT ticker, CASE ticker % 4 WHEN 0 THEN 'clean' WHEN 3 THEN 'rejected_jump' ELSE 'adjusted' END AS status, CASE WHEN ticker % 4 IN (1, 2) THEN 1 ELSE 0 END AS accepted, CASE WHEN ticker % 4 = 3 THEN 1 ELSE 0 END AS rejected, 0 AS remaining FROM candles_step"


@query("split_engine", with_views(_ENGINE, "candles_step"))
def split_engine(spark, d):
    return Q.split_engine(candles_step(spark, d)).select("ticker", "status", "accepted", "rejected", "remaining")


@query("series_integrity", with_views("", "candles_step") + f", en AS ({_ENGINE}) SELECT ticker, CASE WHEN rejected > 0 THEN 35 ELSE 100 END AS integrity, CASE WHEN rejected > 0 THEN 'severe' ELSE 'clean' END AS band, CASE WHEN rejected > 0 THEN 40 END AS cap FROM en")
def series_integrity(spark, d):
    return Q.series_integrity(Q.split_engine(candles_step(spark, d))).select("ticker", "integrity", "band", "cap")




def _verdicts(spark, d):
    b = J.event_boundary(_split_events(spark, d), candles_step(spark, d))
    ratio = F.element_at(F.array(F.lit(2.0), F.lit(0.1), F.lit(3.0)), (F.col("ticker") % 4).cast("int"))
    return b.select("ticker", (F.col("after_close") / F.col("before_close")).alias("observed"), ratio.alias("ratio")).withColumn("verdict", Q.continuity(F.col("observed"), F.col("ratio")))


_VER = f"""b AS (SELECT ticker, arg_min(close, date) FILTER (date >= DATE '1998-06-01') / arg_max(close, date) FILTER (date < DATE '1998-06-01') AS observed, CASE ticker % 4 WHEN 1 THEN 2.0 WHEN 2 THEN 0.1 ELSE 3.0 END AS ratio FROM candles_step WHERE ticker % 4 <> 0 GROUP BY ticker),
 ver AS (SELECT *, CASE WHEN abs(ln(observed)) < ln(1.10) THEN 'continuous' WHEN abs(ln(observed * ratio)) < ln(1.20) THEN 'raw_step' ELSE 'inconsistent' END AS verdict FROM b)"""


@query("event_continuity", with_views("", "candles_step") + f", {_VER} SELECT ticker, {r4('observed')} AS observed, verdict FROM ver")
def event_continuity(spark, d):
    return _verdicts(spark, d).select("ticker", rnd("observed", 4).alias("observed"), "verdict")


@query("boundary_plan", with_views("", "candles_step") + f", {_VER} SELECT ticker, CASE WHEN bool_or(verdict = 'inconsistent') THEN 'blocked' WHEN bool_or(verdict = 'raw_step') THEN 'apply' ELSE 'done' END AS plan, count(*) AS n FROM ver GROUP BY 1")
def boundary_plan(spark, d):
    return Q.adjustment_plan(_verdicts(spark, d))


@query("witness_tally", with_views("", "candles_step") + f", {_VER} SELECT ticker % 2 AS source, count(*) AS n, CASE WHEN count(*) < 3 THEN 'insufficient' WHEN bool_and(verdict = 'raw_step') THEN 'raw' WHEN bool_and(verdict = 'continuous') THEN 'already_adjusted' ELSE 'mixed' END AS decision FROM ver GROUP BY 1")
def witness_tally(spark, d):
    g = _verdicts(spark, d).groupBy((F.col("ticker") % 2).alias("source")).agg(F.count("*").alias("n"), F.bool_and(F.col("verdict") == "raw_step").alias("r"), F.bool_and(F.col("verdict") == "continuous").alias("c"))
    return g.select("source", "n", F.when(F.col("n") < 3, "insufficient").when(F.col("r"), "raw").when(F.col("c"), "already_adjusted").otherwise("mixed").alias("decision"))


@query("witness_quality", "SELECT s_suppkey, array_to_string(list_filter([CASE WHEN s_nationkey % 3 = 0 THEN 'status' END, CASE WHEN s_acctbal <= 0 THEN 'ratio' END, CASE WHEN abs(s_acctbal) < 1500 THEN 'magnitude' END], lambda x: x IS NOT NULL), ',') AS reasons FROM supplier")
def witness_quality(spark, d):
    why = C.reasons(("status", F.col("s_nationkey") % 3 == 0), ("ratio", F.col("s_acctbal") <= 0), ("magnitude", F.abs("s_acctbal") < 1500))
    return table(spark, d, "supplier").select("s_suppkey", F.array_join(why, ",").alias("reasons"))


@query("split_event_status", "SELECT user_id, CASE WHEN count(*) FILTER (event_type = 'purchase') > 0 THEN 'confirmed' ELSE 'no_events' END AS status, count(*) FILTER (event_type = 'purchase') AS n FROM events GROUP BY 1")
def split_event_status(spark, d):
    n = F.count_if(F.col("event_type") == "purchase")
    return table(spark, d, "events").groupBy("user_id").agg(F.when(n > 0, "confirmed").otherwise("no_events").alias("status"), n.alias("n"))


_LADDER = "CASE WHEN n >= 2000 THEN 100 WHEN n >= 1260 THEN 95 WHEN n >= 756 THEN 85 WHEN n >= 504 THEN 70 WHEN n >= 252 THEN 50 WHEN n >= 126 THEN 35 WHEN n >= 60 THEN 20 WHEN n >= 1 THEN 10 ELSE 0 END"


@query("history_depth", with_views(f"SELECT ticker, n, {_LADDER} AS depth FROM (SELECT ticker, count(*) AS n FROM candles GROUP BY 1)", "candles"))
def history_depth(spark, d):
    g = candles(spark, d).groupBy("ticker").agg(F.count("*").alias("n"))
    return g.withColumn("depth", Q.history_depth("n"))


@query("liquidity_class", with_views("SELECT ticker, CASE WHEN v >= 5e6 THEN 'alta' WHEN v >= 3e5 THEN 'média' ELSE 'baixa' END AS class FROM (SELECT ticker, avg(close * volume) AS v FROM candles GROUP BY 1)", "candles"))
def liquidity_class(spark, d):
    g = candles(spark, d).groupBy("ticker").agg(F.avg(F.col("close") * F.col("volume")).alias("v")).withColumn("cur", F.lit("BRL"))
    return g.select("ticker", Q.liquidity_class("v", "cur").alias("class"))


@query("data_quality_index", with_views(f"""SELECT ticker, floor(((90.0 * 20 + {_LADDER} * 25.0 + CASE WHEN ticker % 3 = 0 THEN 0 ELSE 60.0 * 25 END + CASE WHEN ticker % 3 = 0 THEN 0 ELSE 70.0 * 20 END + 50.0 * 10 + 100.0 * 20) / CASE WHEN ticker % 3 = 0 THEN 75 ELSE 120 END) * 10 + 0.5) / 10 AS score,
 CASE WHEN floor(((90.0 * 20 + {_LADDER} * 25.0 + CASE WHEN ticker % 3 = 0 THEN 0 ELSE 60.0 * 25 END + CASE WHEN ticker % 3 = 0 THEN 0 ELSE 70.0 * 20 END + 50.0 * 10 + 100.0 * 20) / CASE WHEN ticker % 3 = 0 THEN 75 ELSE 120 END) * 10 + 0.5) / 10 >= 85 THEN 'alta' WHEN floor(((90.0 * 20 + {_LADDER} * 25.0 + CASE WHEN ticker % 3 = 0 THEN 0 ELSE 60.0 * 25 END + CASE WHEN ticker % 3 = 0 THEN 0 ELSE 70.0 * 20 END + 50.0 * 10 + 100.0 * 20) / CASE WHEN ticker % 3 = 0 THEN 75 ELSE 120 END) * 10 + 0.5) / 10 >= 70 THEN 'boa' ELSE 'média' END AS rating FROM (SELECT ticker, count(*) AS n FROM candles GROUP BY 1)""", "candles"))
def data_quality_index(spark, d):
    g = history_depth(spark, d)
    fund = F.col("ticker") % 3 == 0
    s = g.select("ticker", F.lit(90.0).alias("quote"), F.col("depth").cast("double").alias("history"), F.when(~fund, 60.0).alias("fundamental"), F.when(~fund, 70.0).alias("statements"), F.lit(50.0).alias("macro"), F.lit(100.0).alias("consistency"))
    return Q.data_quality_index(s).select("ticker", "score", "rating")


@query("quality_index_capped", "SELECT s_suppkey, floor(least(80.0, CASE WHEN s_suppkey % 2 = 0 THEN 50.0 ELSE 100.0 END) * 10 + 0.5) / 10 AS score, CASE WHEN s_suppkey % 2 = 0 THEN 'média' ELSE 'boa' END AS rating FROM supplier")
def quality_index_capped(spark, d):
    s = table(spark, d, "supplier").select("s_suppkey", *[F.lit(80.0).alias(k) for k in Q.WEIGHTS], F.when(F.col("s_suppkey") % 2 == 0, 50.0).otherwise(100.0).alias("cap"))
    return Q.data_quality_index(s, "cap").select("s_suppkey", "score", "rating")


@query("economic_profile", "SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'fund' WHEN 1 THEN 'insurance' WHEN 2 THEN 'bank' ELSE 'industrial' END AS profile FROM part")
def economic_profile(spark, d):
    m = F.col("p_partkey") % 4
    t = F.when(m == 0, "Fundo Imobiliário").when(m == 1, "Seguradora ABC").when(m == 2, "Bánco do Sul").otherwise(F.col("p_name"))
    return table(spark, d, "part").select("p_partkey", Q.economic_profile(t).alias("profile"))


_REGIME_IN = "SELECT s_suppkey AS id, CASE WHEN s_suppkey % 2 = 0 THEN 'BR' ELSE 'US' END AS country, s_acctbal / 1000 AS x FROM supplier"


@query("regime_labels", f"""WITH r AS ({_REGIME_IN}) SELECT id, (CASE WHEN x >= 4 THEN 'alto' WHEN x >= 1 THEN 'neutro' ELSE 'baixo' END) || '/' || (CASE WHEN x - 3 > 0.5 THEN 'subindo' WHEN x - 3 < -0.5 THEN 'caindo' ELSE 'estável' END) AS rate_regime,
 CASE WHEN x < 0 THEN 'deflação' WHEN x <= t + 1.5 THEN 'ancorada' WHEN x <= t + 5 THEN 'pressionada' ELSE 'desancorada' END AS inflation_regime, CASE WHEN x - 3 > 0.5 THEN 'expansão' WHEN x - 3 < -0.5 THEN 'contração' ELSE 'neutro' END AS credit_regime,
 CASE WHEN x > b THEN CASE WHEN country = 'BR' THEN 'BRL depreciou' ELSE 'dólar fortaleceu' END WHEN x < -b THEN CASE WHEN country = 'BR' THEN 'BRL apreciou' ELSE 'dólar enfraqueceu' END ELSE 'estável' END AS currency_regime, CASE WHEN x - 4 < 0 THEN CASE WHEN x < 0 THEN 'contração' ELSE 'entrando em contração' END WHEN x < 0 THEN 'recuperação' WHEN x - 4 < x THEN 'desaceleração' ELSE 'expansão' END AS cycle FROM (SELECT *, CASE WHEN country = 'BR' THEN 3.0 ELSE 2.0 END AS t, CASE WHEN country = 'BR' THEN 5 ELSE 3 END AS b FROM r)""")
def regime_labels(spark, d):
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.when(F.col("s_suppkey") % 2 == 0, "BR").otherwise("US").alias("country"), (F.col("s_acctbal") / 1000).alias("x"))
    x = F.col("x")
    s = s.select("id", "country", x.alias("real_rate"), (x - 3).alias("rate_change"), x.alias("inflation"), (x - 3).alias("credit_change"), x.alias("currency_change"), x.alias("growth_start"), (x - 4).alias("growth_end"))
    return Q.regime_labels(s).select("id", "rate_regime", "inflation_regime", "credit_regime", "currency_regime", "cycle")


@query("context_regime", "SELECT s_suppkey, CASE WHEN s_suppkey % 9 = 0 THEN 'insufficient' WHEN p >= 10 AND i > 4.5 THEN 'tight_and_pressured' WHEN p >= 10 THEN 'tight' WHEN i > 4.5 THEN 'pressured' ELSE 'near_band' END AS regime FROM (SELECT s_suppkey, s_nationkey AS p, s_acctbal / 1000 AS i FROM supplier)")
def context_regime(spark, d):
    s = table(spark, d, "supplier").select("s_suppkey", F.when(F.col("s_suppkey") % 9 != 0, F.col("s_nationkey")).alias("p"), (F.col("s_acctbal") / 1000).alias("i"))
    return s.select("s_suppkey", Q.context_regime("p", "i").alias("regime"))


@query("freshness_coverage", "SELECT user_id, floor(f * 100 + 0.5) / 100 AS freshness, floor(c * 100 + 0.5) / 100 AS coverage, floor(greatest(0, 0.55 * f + 0.45 * c - 0.1) * 100 + 0.5) / 100 AS confidence FROM (SELECT user_id, avg(greatest(0.0, 1 - date_diff('day', CAST(ts AS DATE), DATE '2024-02-05') / 100.0)) AS f, avg(CASE WHEN event_type = 'error' THEN 0.0 ELSE 1.0 END) AS c FROM events GROUP BY 1)")
def freshness_coverage(spark, d):
    e = table(spark, d, "events").select("user_id", F.to_date("ts").alias("observed"), F.lit(100.0).alias("max_age"), F.when(F.col("event_type") == "error", "unavailable").otherwise("official").alias("status"))
    return Q.freshness(e, "2024-02-05", "user_id")


@query("unit_inference", "SELECT o_orderkey, CASE WHEN abs(v) >= 1e9 THEN 'unit' WHEN abs(v) >= 1e6 THEN 'thousand' ELSE 'million' END AS unit FROM (SELECT o_orderkey, o_totalprice * (o_orderkey % 10000) AS v FROM orders)")
def unit_inference(spark, d):
    return table(spark, d, "orders").select("o_orderkey", (F.col("o_totalprice") * (F.col("o_orderkey") % 10000)).alias("v")).select("o_orderkey", Q.unit_inference("v").alias("unit"))


@query("market_scope_class", "SELECT p_partkey, CASE WHEN abs(v / p_retailprice - 1) <= 0.02 THEN 'spot' WHEN abs(v / (2 * p_retailprice) - 1) <= 0.02 THEN 'total' ELSE 'undefined' END AS scope FROM (SELECT *, p_retailprice * (1 + (p_partkey % 3) * 0.5) AS v FROM part)")
def market_scope(spark, d):
    p = table(spark, d, "part").select("p_partkey", (F.col("p_retailprice") * (1 + (F.col("p_partkey") % 3) * 0.5)).alias("v"), F.col("p_retailprice").alias("spot"), (2 * F.col("p_retailprice")).alias("total"))
    return p.select("p_partkey", Q.market_scope("v", "spot", "total").alias("scope"))


_VD = "CASE event_type WHEN 'purchase' THEN 'COMPRAR' WHEN 'view' THEN 'MONITORAR' WHEN 'click' THEN 'AGUARDAR' WHEN 'error' THEN 'EVITAR' ELSE 'APROVADO' END"


def _events_verdict(spark, d):
    v = F.when(F.col("event_type") == "purchase", "COMPRAR").when(F.col("event_type") == "view", "MONITORAR").when(F.col("event_type") == "click", "AGUARDAR").when(F.col("event_type") == "error", "EVITAR").otherwise("APROVADO")
    return table(spark, d, "events").select("user_id", "ts", "event_id", v.alias("verdict"))


@query("verdict_transition", f"""SELECT event_id, verdict, CASE WHEN w IS NULL THEN 'first' WHEN r > w THEN 'better' WHEN r < w THEN 'worse' ELSE 'kept' END AS change FROM (SELECT *, lag(r) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS w FROM
 (SELECT event_id, user_id, ts, {_VD} AS verdict, CASE event_type WHEN 'error' THEN 1 WHEN 'click' THEN 2 WHEN 'view' THEN 3 ELSE 4 END AS r FROM events))""")
def verdict_transition(spark, d):
    return Q.verdict_transition(_events_verdict(spark, d), "user_id", ["ts", "event_id"]).select("event_id", "verdict", "change")


@query("edge_guardrail", f"""WITH e AS (SELECT event_id, {_VD} AS verdict, CASE event_id % 3 WHEN 0 THEN 'scan' WHEN 1 THEN 'deep' ELSE 'final' END AS phase, CASE event_id % 5 WHEN 0 THEN 'expired' WHEN 1 THEN 'undeclared' ELSE 'declared' END AS edge FROM events),
 g AS (SELECT *, CASE WHEN phase = 'scan' AND edge <> 'declared' AND verdict = 'APROVADO' THEN 'WATCHLIST' WHEN phase <> 'scan' AND edge = 'expired' AND verdict IN ('COMPRAR', 'MONITORAR', 'AGUARDAR') THEN 'EVITAR' WHEN phase <> 'scan' AND edge = 'undeclared' AND verdict = 'COMPRAR' THEN 'MONITORAR' ELSE verdict END AS allowed FROM e)
 SELECT event_id, verdict, phase, edge, allowed, allowed <> verdict AS lowered FROM g""")
def edge_guardrail(spark, d):
    e = _events_verdict(spark, d).select("event_id", "verdict", F.element_at(F.array(F.lit("scan"), F.lit("deep"), F.lit("final")), (F.col("event_id") % 3 + 1).cast("int")).alias("phase"), F.when(F.col("event_id") % 5 == 0, "expired").when(F.col("event_id") % 5 == 1, "undeclared").otherwise("declared").alias("edge"))
    return Q.edge_guardrail(e)


@query("edge_ledger_score", """SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'bad_type' WHEN 1 THEN 'missing_evidence' WHEN 2 THEN 'vague_expiry' ELSE '' END AS errors, CASE WHEN c_custkey % 4 = 1 THEN 0.83 ELSE 1.0 END AS completeness, CASE WHEN c_custkey % 4 <> 3 THEN 'undeclared' WHEN c_custkey % 8 = 7 THEN 'expired' ELSE 'declared' END AS state FROM customer""")
def edge_ledger(spark, d):
    m = F.col("c_custkey") % 4
    l = table(spark, d, "customer").select("c_custkey", F.when(m == 0, "magic").otherwise("analytical").alias("type"), F.when(m == 1, " ").otherwise("margin history of ten years").alias("evidence"), F.lit("flow").alias("input"), F.when(m == 2, "some day").otherwise("margin below 10 % for two quarters").alias("expiry"), F.lit("2026-01-02").alias("declared_on"), F.when(F.col("c_custkey") % 8 == 7, "expired").otherwise("active").alias("status"))
    return Q.edge_ledger(l, "2026-02-01").select("c_custkey", F.array_join("errors", ",").alias("errors"), "completeness", "state")


@query("price_zone_rule", "SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'unverifiable' WHEN p_partkey % 3 = 1 THEN 'valid' ELSE 'corrected' END AS status FROM part")
def price_zone(spark, d):
    m = F.col("p_partkey") % 3
    p = table(spark, d, "part").select("p_partkey", F.when(m != 0, F.col("p_retailprice")).alias("zone_low"), (F.col("p_retailprice") * 1.1).alias("zone_high"), F.array(F.when(m == 1, F.col("p_retailprice") * 0.8).otherwise(F.col("p_retailprice") * 1.2)).alias("targets"))
    return Q.price_zone(p).select("p_partkey", "status")


@query("lookup_outcome", "SELECT user_id AS ticker, CASE WHEN bool_or(event_type = 'purchase' AND value > 20) THEN 'found' WHEN bool_or(event_type = 'error') THEN 'unavailable' ELSE 'not_found' END AS outcome FROM events GROUP BY 1")
def lookup_outcome(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").alias("ticker"), F.when((F.col("event_type") == "purchase") & (F.col("value") > 20), "found").when(F.col("event_type") == "error", "error").otherwise("none").alias("result"))
    return Q.lookup_outcome(e)


@query("package_rules", "SELECT o_orderkey, array_to_string(list_filter([CASE WHEN o_totalprice > 400000 THEN 'range' END, CASE WHEN o_orderstatus NOT IN ('F', 'O') THEN 'enum' END, CASE WHEN o_orderdate > TIMESTAMP '2001-06-01' THEN 'date' END], lambda x: x IS NOT NULL), ',') AS errors FROM orders")
def package_rules(spark, d):
    o = K.check(table(spark, d, "orders"), range=F.col("o_totalprice") > 400000, enum=~F.col("o_orderstatus").isin("F", "O"), date=F.col("o_orderdate") > F.lit("2001-06-01").cast("timestamp"))
    return o.select("o_orderkey", F.array_join("errors", ",").alias("errors"))


@query("contract_compat", "SELECT n_nationkey, CASE WHEN n_nationkey % 3 <> 1 THEN 'incompatible' WHEN n_nationkey = 4 THEN 'exact' WHEN n_nationkey > 4 THEN 'forward_ok' ELSE 'degraded' END AS compat FROM nation")
def contract_compat(spark, d):
    n = table(spark, d, "nation").withColumn("v", F.concat_ws(".", F.col("n_nationkey") % 3, "n_nationkey"))
    return n.select("n_nationkey", K.compatibility("v", "1.4").alias("compat"))


@query("table_constraints", "SELECT 'unique' AS rule, count(*) AS n FROM (SELECT l_orderkey, l_linenumber FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1) UNION ALL SELECT 'foreign', count(*) FROM lineitem WHERE l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_nationkey <> 3)")
def table_constraints(spark, d):
    li = table(spark, d, "lineitem")
    a = K.unique_violations(li, ["l_orderkey", "l_linenumber"]).groupBy().agg(F.count("*").alias("n")).select(F.lit("unique").alias("rule"), "n")
    b = K.foreign_violations(li, {"l_suppkey": "s_suppkey"}, table(spark, d, "supplier").where("s_nationkey <> 3")).groupBy().agg(F.count("*").alias("n")).select(F.lit("foreign").alias("rule"), "n")
    return a.unionByName(b)


@query("health_summary", "SELECT 'orders' AS dataset, count(*) AS n, max(CAST(o_orderdate AS DATE)) AS as_of, 'ok' AS status FROM orders UNION ALL SELECT 'events', count(*), max(CAST(ts AS DATE)), 'ok' FROM events UNION ALL SELECT 'none', 0, NULL, 'empty'")
def health_summary(spark, d):
    o, e = table(spark, d, "orders"), table(spark, d, "events")
    return K.health({"orders": (o, "o_orderdate"), "events": (e, "ts"), "none": (e.where("event_id < 0"), "ts")})


@query("schema_conformance", "SELECT event_id, event_id % 4 <> 0 AS ok FROM events")
def schema_conformance(spark, d):
    t = F.when(F.col("event_id") % 8 == 0, "{").when(F.col("event_id") % 4 == 0, '{"x": 1}').otherwise(F.col("props"))
    return table(spark, d, "events").select("event_id", K.conforms(t, "k int", ["k"]).alias("ok"))


@query("acceptance_checklist", with_views("SELECT ticker, count(*) >= 400 AND min(close) > 0 AND max(date) >= DATE '2001-06-01' AS approved FROM candles GROUP BY 1", "candles"))
def acceptance_checklist(spark, d):
    g = candles(spark, d).groupBy("ticker").agg((F.count("*") >= 400).alias("long"), (F.min("close") > 0).alias("positive"), (F.max("date") >= F.lit("2001-06-01").cast("date")).alias("recent"))
    return g.select("ticker", (F.col("long") & F.col("positive") & F.col("recent")).alias("approved"))
