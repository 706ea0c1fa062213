"""Queries over joins, point-in-time merges, top-k and set operations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..fixtures import candles, candles_step, curve, facts, investments, observations, table, with_views
from ..functions import columns as C
from ..operators import joins as J
from ..operators import metrics as M
from ..operators import pit as P
from ..operators.sums import running_sum
from .prices import JUMPS_SQL
from .registry import query, r4

rnd = C.round_half_up


def _targets(spark, d):
    o = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return o.select(F.col("c_mktsegment").alias("series"), F.to_date("o_orderdate").alias("at"), F.col("o_orderkey").alias("id"))


_TARGETS = "targets AS (SELECT c_mktsegment AS series, CAST(o_orderdate AS DATE) AS at, o_orderkey AS id FROM orders JOIN customer ON o_custkey = c_custkey)"


@query("asof_latest_on_or_before", with_views("", "observations") + f", {_TARGETS} SELECT t.series, t.at, t.id, o.date AS found_date, {r4('o.value')} AS found_value FROM targets t ASOF LEFT JOIN observations o ON t.series = o.series AND t.at >= o.date")
def asof_latest(spark, d):
    return M.rounded(J.asof_latest(_targets(spark, d), observations(spark, d), "series"))


@query("asof_nearest_with_gap", with_views("", "observations") + f""", {_TARGETS}, p AS (SELECT DISTINCT t.series, t.at, o.date AS pd, o.value AS pv FROM targets t ASOF LEFT JOIN observations o ON t.series = o.series AND t.at >= o.date),
 q AS (SELECT p.*, o.date AS nd, o.value AS nv FROM p ASOF LEFT JOIN observations o ON p.series = o.series AND p.at <= o.date)
 SELECT q.series, q.at, CASE WHEN abs(date_diff('day', q.at, coalesce(pd, nd))) <= 140 THEN coalesce(pd, nd) END AS found_date, CASE WHEN abs(date_diff('day', q.at, coalesce(pd, nd))) <= 140 THEN {r4('CASE WHEN pd IS NULL THEN nv ELSE pv END')} END AS found_value FROM q""")
def asof_nearest(spark, d):
    return M.rounded(J.asof_nearest(_targets(spark, d).select("series", "at"), observations(spark, d), "series", 140))


def _split_events(spark, d):
    return candles_step(spark, d).select("ticker").distinct().where("ticker % 4 <> 0").select("ticker", F.lit("1998-06-01").cast("date").alias("boundary"))


@query("asof_event_boundary", with_views(f"""SELECT b.*, n.n_around, n.first_around, n.last_around, n.sum_around FROM (SELECT ticker, DATE '1998-06-01' AS boundary, max(date) FILTER (date < DATE '1998-06-01') AS before_date, {r4("arg_max(close, date) FILTER (date < DATE '1998-06-01')")} AS before_close, min(date) FILTER (date >= DATE '1998-06-01') AS after_date,
 {r4("arg_min(close, date) FILTER (date >= DATE '1998-06-01')")} AS after_close, count(*) FILTER (date < DATE '1998-06-01') AS n_before, count(*) FILTER (date >= DATE '1998-06-01') AS n_after FROM k GROUP BY ticker) b
 JOIN (SELECT ticker, count(*) FILTER (near) AS n_around, min(date) FILTER (near) AS first_around, max(date) FILTER (near) AS last_around, {r4("sum(close) FILTER (near)")} AS sum_around FROM (SELECT *, max(no) FILTER (date >= DATE '1998-06-01') OVER (PARTITION BY ticker) IS NOT NULL
 AND no - (count(*) FILTER (date < DATE '1998-06-01') OVER (PARTITION BY ticker)) BETWEEN -3 AND 5 AS near FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY date) AS no FROM k)) GROUP BY ticker) n USING (ticker)""", "candles_step").replace(" SELECT b.*", ", k AS (SELECT ticker, date, close FROM candles_step WHERE ticker % 4 <> 0 AND (day(date) + ticker) % 5 <> 0) SELECT b.*", 1))
def event_boundary(spark, d):
    """Each fifth candle of a ticker has no close."""
    c = candles_step(spark, d).withColumn("close", F.when((F.dayofmonth("date") + F.col("ticker")) % 5 != 0, F.col("close")))
    found = M.rounded(J.event_boundary(_split_events(spark, d), c))
    total = F.aggregate("around", F.lit(0.0), lambda acc, x: acc + x["close"])
    some = F.size("around") > 0
    return found.select(
        *[x for x in found.columns if x != "around"], F.size("around").cast("long").alias("n_around"), F.when(some, F.array_min("around")["date"]).alias("first_around"), F.when(some, F.array_max("around")["date"]).alias("last_around"),
        F.when(some, rnd(total, 4)).alias("sum_around"),
    )


_BR = "cv AS (SELECT vertex, rate FROM curve WHERE data_ref = (SELECT max(data_ref) FROM curve)), br AS (SELECT i.*, (SELECT max(vertex) FROM cv WHERE vertex <= horizon) AS lo, (SELECT min(vertex) FROM cv WHERE vertex >= horizon) AS hi FROM investments i), ip AS (SELECT br.*, a.rate AS lo_rate, b.rate AS hi_rate FROM br LEFT JOIN cv a ON a.vertex = lo LEFT JOIN cv b ON b.vertex = hi)"
_LIN = "CASE WHEN lo IS NULL OR hi IS NULL THEN NULL WHEN lo = hi THEN lo_rate ELSE lo_rate + (horizon - lo) / (hi - lo) * (hi_rate - lo_rate) END"


@query("bracket_interpolation_join", with_views("", "curve", "investments") + f", {_BR} SELECT id, horizon, lo, hi, {r4(_LIN)} AS rate FROM ip")
def bracket_interpolation(spark, d):
    b = J.bracket(investments(spark, d), J.latest_curve(curve(spark, d)))
    return b.select("id", "horizon", "lo", "hi", rnd(J.interpolate(), 4).alias("rate"))


@query("align_inner_multi", with_views(f"SELECT a.date, {r4('a.value')} AS BUILDING, {r4('b.value')} AS MACHINERY, {r4('c.value')} AS HOUSEHOLD FROM observations a JOIN observations b USING (date) JOIN observations c USING (date) WHERE a.series = 'BUILDING' AND b.series = 'MACHINERY' AND c.series = 'HOUSEHOLD'", "observations"))
def align_inner(spark, d):
    return M.rounded(J.align_inner(observations(spark, d), ["BUILDING", "MACHINERY", "HOUSEHOLD"]))


@query("latest_curve_date", with_views("SELECT data_ref, vertex, rate FROM curve WHERE data_ref = (SELECT max(data_ref) FROM curve)", "curve"))
def latest_curve_date(spark, d):
    return J.latest_curve(curve(spark, d)).select("data_ref", "vertex", "rate")


@query("join_filing_index", """SELECT *, min(received) OVER (PARTITION BY company, period) AS first_received FROM (SELECT DISTINCT o_custkey AS company, CAST(date_trunc('quarter', o_orderdate) AS DATE) AS period, o_orderkey % 2 AS version FROM orders) f
 LEFT JOIN (SELECT o_custkey AS company, CAST(date_trunc('quarter', o_orderdate) AS DATE) AS period, o_orderkey % 2 AS version, min(CAST(o_orderdate AS DATE)) AS received FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1, 2, 3) i USING (company, period, version)""")
def join_filing_index(spark, d):
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("company"), F.trunc(F.to_date("o_orderdate"), "quarter").alias("period"), (F.col("o_orderkey") % 2).alias("version"), F.to_date("o_orderdate").alias("day"), "o_orderstatus")
    index = o.where("o_orderstatus <> 'P'").groupBy("company", "period", "version").agg(F.min("day").alias("received"))
    return J.filing_index(o.select("company", "period", "version").distinct(), index, ["company", "period"], "version")


@query("join_universe_discovery", "SELECT doc_id, lang, source FROM documents WHERE source IN (SELECT 'src' || n_nationkey FROM nation WHERE n_regionkey = 1) AND lang IN ('en', 'fr')")
def join_universe_discovery(spark, d):
    universe = table(spark, d, "nation").where("n_regionkey = 1").select(F.concat(F.lit("src"), "n_nationkey").alias("source"))
    return table(spark, d, "documents").where(F.col("lang").isin("en", "fr")).join(universe, "source", "left_semi").select("doc_id", "lang", "source")


@query("join_documents_assets", "SELECT doc_id, n_name AS asset FROM documents JOIN nation ON doc_id % 25 = n_nationkey WHERE n_regionkey <> 0 AND lang = 'de' ORDER BY doc_id DESC LIMIT 100")
def join_documents_assets(spark, d):
    docs = table(spark, d, "documents").where("lang = 'de'").select("doc_id", (F.col("doc_id") % 25).cast("int").alias("issuer"))
    assets = table(spark, d, "nation").where("n_regionkey <> 0").select(F.col("n_nationkey").alias("issuer"), F.col("n_name").alias("asset"))
    return docs.join(assets, "issuer").select("doc_id", "asset").orderBy(F.desc("doc_id")).limit(100)


@query("join_disjunctive_ticker", "SELECT DISTINCT doc_id, n_name AS ticker FROM documents, nation WHERE doc_id % 25 = n_nationkey OR (doc_id % 7 = 0 AND doc_id % 11 = n_nationkey)")
def join_disjunctive(spark, d):
    assets = table(spark, d, "nation").select(F.col("n_name").alias("ticker"), F.col("n_nationkey").alias("issuer"))
    hints = assets.select(F.col("ticker").alias("ticker_hint"), F.col("issuer").alias("hint"))
    docs = table(spark, d, "documents").select("doc_id", (F.col("doc_id") % 25).cast("int").alias("issuer"), F.when(F.col("doc_id") % 7 == 0, F.col("doc_id") % 11).cast("int").alias("hint")).join(hints, "hint", "left")
    return J.disjunctive(docs.select("doc_id", "issuer", "ticker_hint"), assets)


@query("join_asset_issuer", "SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey % 5 <> 0 AND r_regionkey <> 4")
def join_asset_issuer(spark, d):
    a, i = table(spark, d, "nation").where("n_nationkey % 5 <> 0"), table(spark, d, "region").where("r_regionkey <> 4")
    return a.join(i, F.col("n_regionkey") == F.col("r_regionkey")).select("n_name", "r_name")


@query("join_facts_assets", with_views(f"SELECT ticker, fiscal_year, metric, scope, version, known_at, {r4('value')} AS value FROM facts JOIN supplier ON ticker = s_suppkey WHERE s_acctbal > 0 AND fiscal_year IN (1996, 1998)", "facts"))
def join_facts_assets(spark, d):
    active = table(spark, d, "supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("ticker"))
    return M.rounded(facts(spark, d).where(F.col("fiscal_year").isin(1996, 1998)).join(active, "ticker", "left_semi"))


@query("semi_anti_dedup", "SELECT doc_id, 'src:' || doc_id AS dedup_key FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def semi_anti_dedup(spark, d):
    key = F.concat(F.lit("src:"), F.col("doc_id")).alias("dedup_key")
    have = table(spark, d, "labels").select(key)
    return table(spark, d, "documents").select("doc_id", key).join(have, "dedup_key", "left_anti").select("doc_id", "dedup_key")


@query("join_preference_merge", """SELECT coalesce(a.k, b.k) AS k, coalesce(a.v, b.v) AS v, CASE WHEN a.v IS NOT NULL THEN 'official' ELSE 'supplementary' END AS origin FROM (SELECT s_nationkey AS k, max(s_acctbal) AS v FROM supplier GROUP BY 1 HAVING s_nationkey < 15) a
 FULL JOIN (SELECT c_nationkey AS k, max(c_acctbal) AS v FROM customer GROUP BY 1 HAVING c_nationkey > 5) b ON a.k = b.k""")
def join_preference(spark, d):
    a = table(spark, d, "supplier").where("s_nationkey < 15").groupBy(F.col("s_nationkey").alias("k")).agg(F.max("s_acctbal").alias("v"))
    b = table(spark, d, "customer").where("c_nationkey > 5").groupBy(F.col("c_nationkey").alias("k")).agg(F.max("c_acctbal").alias("v"))
    return J.prefer(a, b, "k", ["v"])


@query("match_event_tolerant", with_views("", "candles_step") + f", {JUMPS_SQL}" + f""", ev AS (SELECT ticker, date, best AS ratio FROM judged WHERE far <= ln(1.08)), wi AS (SELECT DISTINCT ticker AS id, ticker, DATE '1998-06-01' + CAST(ticker % 3 AS INTEGER) AS date, CASE ticker % 4 WHEN 1 THEN 2.1::DOUBLE ELSE 0.1::DOUBLE END AS ratio FROM candles_step WHERE ticker % 4 <> 0),
 m AS (SELECT wi.id, arg_min((e.date, e.ratio, abs(date_diff('day', wi.date, e.date)) + 10 * abs(ln(e.ratio / wi.ratio))), (abs(date_diff('day', wi.date, e.date)) + 10 * abs(ln(e.ratio / wi.ratio)), e.date)) AS b FROM wi JOIN ev e ON e.ticker = wi.ticker AND abs(date_diff('day', wi.date, e.date)) <= 5 AND abs(ln(e.ratio / wi.ratio)) <= ln(1.15) GROUP BY 1)
 SELECT wi.id, wi.ticker, wi.date, wi.ratio, b[1] AS event_date, b[2] AS event_ratio, {r4('b[3]')} AS score FROM wi LEFT JOIN m USING (id)""")
def match_event_tolerant(spark, d):
    ev = M.detect_jumps(candles_step(spark, d)).where("status = 'accepted'").select("ticker", "date", "ratio")
    t = candles_step(spark, d).select("ticker").distinct().where("ticker % 4 <> 0")
    w = t.select(F.col("ticker").alias("id"), "ticker", F.date_add(F.lit("1998-06-01").cast("date"), (F.col("ticker") % 3).cast("int")).alias("date"), F.when(F.col("ticker") % 4 == 1, 2.1).otherwise(0.1).alias("ratio"))
    return M.rounded(J.tolerant_match(w, ev))


@query("best_text_match_join", """WITH e AS (SELECT item_id AS id, list_distinct(list_filter(string_split_regex(lower(text), '[^a-z]+'), lambda x: length(x) >= 6)) AS t FROM benchmark), c AS (SELECT doc_id AS cand, list_distinct(list_filter(string_split_regex(lower(text), '[^a-z]+'), lambda x: length(x) >= 6)) AS t FROM documents),
 m AS (SELECT id, cand, count(*) / least(any_value(ne), any_value(nc)) AS score FROM (SELECT id, len(t) AS ne, unnest(t) AS w FROM e) JOIN (SELECT cand, len(t) AS nc, unnest(t) AS w FROM c) USING (w) GROUP BY 1, 2)
 SELECT id, cand, floor(score * 1e4 + 0.5) / 1e4 AS score FROM m WHERE score >= 0.2 QUALIFY row_number() OVER (PARTITION BY id ORDER BY score DESC, cand) = 1""")
def best_text_match(spark, d):
    tok = F.array_distinct(F.filter(F.split(F.lower("text"), "[^a-z]+"), lambda x: F.length(x) >= 6)).alias("tokens")
    e = table(spark, d, "benchmark").select(F.col("item_id").alias("id"), tok)
    c = table(spark, d, "documents").select(F.col("doc_id").alias("cand"), tok)
    return M.rounded(J.best_text_match(e, c))


@query("registry_preferred_match", "SELECT symbol, country, currency, idx FROM (SELECT p_brand AS symbol, CASE WHEN p_size % 3 = 0 THEN 'US' ELSE 'XX' END AS country, CASE WHEN p_partkey % 2 = 0 THEN 'USD' ELSE 'EUR' END AS currency, p_partkey AS idx FROM part) QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY CASE WHEN country = 'US' AND currency = 'USD' THEN 0 WHEN currency = 'USD' THEN 1 ELSE 2 END, idx) = 1")
def registry_preferred(spark, d):
    p = table(spark, d, "part").select(F.col("p_brand").alias("symbol"), F.when(F.col("p_size") % 3 == 0, "US").otherwise("XX").alias("country"), F.when(F.col("p_partkey") % 2 == 0, "USD").otherwise("EUR").alias("currency"), F.col("p_partkey").alias("idx"))
    return J.preferred_listing(p)


@query("pit_select_facts", with_views(f""", known AS (SELECT * FROM facts WHERE known_at <= DATE '2000-06-30' QUALIFY row_number() OVER (PARTITION BY ticker, scope, fiscal_year, metric ORDER BY known_at DESC, version DESC) = 1),
 best AS (SELECT ticker, arg_max(scope, (n, scope = 'consolidado')) AS scope FROM (SELECT ticker, scope, count(*) AS n FROM known GROUP BY 1, 2) GROUP BY 1) SELECT ticker, scope, fiscal_year, metric, version, known_at, {r4('value')} AS value FROM known JOIN best USING (ticker, scope)""", "facts"))
def pit_select_facts(spark, d):
    return M.rounded(P.pit_select(facts(spark, d), "2000-06-30"))


def _snapshots(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.col("o_totalprice").alias("v"), F.to_date("o_orderdate").alias("day"))
    new = o.withColumn("v", F.when(F.col("o_orderkey") % 50 == 0, F.col("v") + 1).otherwise(F.col("v")))
    return o.where(F.col("day") < F.lit("2001-01-01").cast("date")), new


_OLD, _NEW = "(SELECT o_orderkey, o_totalprice AS v, CAST(o_orderdate AS DATE) AS day FROM orders WHERE o_orderdate < DATE '2001-01-01')", "(SELECT o_orderkey, CASE WHEN o_orderkey % 50 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS v, CAST(o_orderdate AS DATE) AS day FROM orders)"


@query("pit_merge_first_wins", f"SELECT * FROM {_OLD} UNION ALL SELECT * FROM {_NEW} WHERE o_orderkey NOT IN (SELECT o_orderkey FROM {_OLD})")
def pit_merge(spark, d):
    return P.pit_merge_first_wins(*_snapshots(spark, d), ["o_orderkey"], ["v"])[0]


@query("revision_log_dedup", f"SELECT a.o_orderkey, a.v, b.v AS new_v FROM {_OLD} a JOIN {_NEW} b USING (o_orderkey) WHERE a.v <> b.v AND o_orderkey % 100 <> 0")
def revision_log(spark, d):
    rev = P.pit_merge_first_wins(*_snapshots(spark, d), ["o_orderkey"], ["v"])[1]
    return rev.join(rev.where("o_orderkey % 100 = 0").select("o_orderkey"), "o_orderkey", "left_anti")


@query("versioned_merge", f"SELECT o_orderkey, 'v' AS changed FROM {_OLD} a JOIN {_NEW} b USING (o_orderkey) WHERE a.v <> b.v")
def versioned_merge(spark, d):
    return P.versioned_diff(*_snapshots(spark, d), ["o_orderkey"], ["v"])


@query("last_wins_merge", f"SELECT * FROM {_NEW}")
def last_wins_merge(spark, d):
    return P.last_wins(list(_snapshots(spark, d)), ["o_orderkey"])


@query("frozen_merge", f"SELECT o_orderkey, coalesce(b.v, a.v) AS v, a.day FROM {_OLD} a LEFT JOIN (SELECT * FROM {_NEW} WHERE day >= DATE '2000-10-01') b USING (o_orderkey)")
def frozen_merge(spark, d):
    old, new = _snapshots(spark, d)
    return P.frozen_merge(old, new.where(F.col("day") >= F.lit("2000-10-01").cast("date")), "o_orderkey")


@query("keyed_upsert", f"SELECT * FROM {_OLD} WHERE o_orderkey % 50 <> 0 UNION ALL SELECT * FROM {_NEW} WHERE o_orderkey % 50 = 0")
def keyed_upsert(spark, d):
    old, new = _snapshots(spark, d)
    return P.upsert(old, new.where("o_orderkey % 50 = 0"), ["o_orderkey"])


@query("status_update", "SELECT doc_id, CASE WHEN doc_id IN (SELECT doc_id FROM labels WHERE quality = 0) THEN 'failed' WHEN doc_id IN (SELECT doc_id FROM labels) THEN 'ok' ELSE 'pending' END AS state FROM documents")
def status_update(spark, d):
    l = table(spark, d, "labels").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    return table(spark, d, "documents").select("doc_id").join(l, "doc_id", "left").select("doc_id", F.when(F.col("quality") == 0, "failed").when(F.col("quality").isNotNull(), "ok").otherwise("pending").alias("state"))


@query("queue_oldest_pending", "SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day FROM orders WHERE o_orderstatus = 'P' ORDER BY day, o_orderkey LIMIT 100")
def queue_oldest(spark, d):
    return table(spark, d, "orders").where("o_orderstatus = 'P'").select("o_orderkey", F.to_date("o_orderdate").alias("day")).orderBy("day", "o_orderkey").limit(100)


@query("idempotency_proof", "SELECT count(*) AS first_count, count(*) AS second_count, CAST(0 AS BIGINT) AS added_again FROM orders")
def idempotency_proof(spark, d):
    old, new = _snapshots(spark, d)
    once = P.pit_merge_first_wins(old, new, ["o_orderkey"], ["v"])[0]
    twice = P.pit_merge_first_wins(once, new, ["o_orderkey"], ["v"])[0]
    a, b = once.groupBy().agg(F.count("*").alias("first_count")), twice.groupBy().agg(F.count("*").alias("second_count"))
    return a.join(F.broadcast(b)).withColumn("added_again", F.col("second_count") - F.col("first_count"))


_FIL = """fil AS (SELECT o_custkey % 50 AS company, CAST(year(o_orderdate) AS INTEGER) AS fiscal_year, q.months, sum(o_totalprice) AS ytd, max(CAST(o_orderdate AS DATE)) AS available_at FROM orders, (VALUES (3), (6), (9), (12)) q(months) WHERE month(o_orderdate) <= q.months AND NOT (o_custkey % 50 = 7 AND year(o_orderdate) = 1997) GROUP BY 1, 2, 3)"""


def _filings(spark, d):
    o = table(spark, d, "orders").select((F.col("o_custkey") % 50).alias("company"), F.year("o_orderdate").alias("fiscal_year"), F.month("o_orderdate").alias("m"), "o_totalprice", F.to_date("o_orderdate").alias("day"))
    o = o.where(~((F.col("company") == 7) & (F.col("fiscal_year") == 1997))).withColumn("months", F.explode(F.array(*map(F.lit, (3, 6, 9, 12))))).where("m <= months")
    return o.groupBy("company", "fiscal_year", "months").agg(F.sum("o_totalprice").alias("ytd"), F.max("day").alias("available_at"))


@query("ttm_earnings", f"""WITH {_FIL}, j AS (SELECT f.*, p.ytd AS py, p.available_at AS pa, a.ytd AS an, a.available_at AS aa FROM fil f LEFT JOIN fil p ON p.company = f.company AND p.fiscal_year = f.fiscal_year - 1 AND p.months = f.months LEFT JOIN fil a ON a.company = f.company AND a.fiscal_year = f.fiscal_year - 1 AND a.months = 12),
 s AS (SELECT *, CASE WHEN months = 12 THEN 'ok' WHEN py IS NULL THEN 'sem_ytd_anterior' WHEN an IS NULL THEN 'sem_anual_anterior' ELSE 'ok' END AS status FROM j)
 SELECT company, fiscal_year, months, {r4('CASE WHEN months = 12 THEN ytd ELSE ytd + an - py END')} AS ttm, status, CASE WHEN status = 'ok' THEN CASE WHEN months = 12 THEN available_at ELSE greatest(available_at, pa, aa) END END AS available_at FROM s""")
def ttm_earnings(spark, d):
    return M.rounded(P.ttm(_filings(spark, d)))


@query("join_ttm_prior_annual", f"WITH {_FIL} SELECT f.company, f.fiscal_year, f.months, {r4('p.ytd')} AS prior_ytd, {r4('a.ytd')} AS annual FROM fil f LEFT JOIN fil p ON p.company = f.company AND p.fiscal_year = f.fiscal_year - 1 AND p.months = f.months LEFT JOIN fil a ON a.company = f.company AND a.fiscal_year = f.fiscal_year - 1 AND a.months = 12")
def join_ttm_prior(spark, d):
    f = _filings(spark, d)
    p = f.select("company", (F.col("fiscal_year") + 1).alias("fiscal_year"), "months", F.col("ytd").alias("prior_ytd"))
    a = f.where("months = 12").select("company", (F.col("fiscal_year") + 1).alias("fiscal_year"), F.col("ytd").alias("annual"))
    return M.rounded(f.join(p, ["company", "fiscal_year", "months"], "left").join(a, ["company", "fiscal_year"], "left").select("company", "fiscal_year", "months", "prior_ytd", "annual"))


@query("net_income_resolve", f"""WITH v AS (SELECT l_suppkey AS company, CAST(date_trunc('quarter', l_shipdate) AS DATE) AS period, CASE WHEN l_linestatus = 'F' THEN 'consolidado' ELSE 'individual' END AS scope, CASE WHEN l_linenumber = 1 THEN 'controller' ELSE 'total' END AS line,
 CASE WHEN l_returnflag = 'N' THEN l_extendedprice * 1000 WHEN l_returnflag = 'R' THEN l_extendedprice END AS v FROM lineitem), p AS (SELECT company, period, scope, coalesce(max(v) FILTER (line = 'controller'), max(v) FILTER (line = 'total')) AS value FROM v GROUP BY 1, 2, 3)
 SELECT company, period, scope, value FROM p WHERE value IS NOT NULL QUALIFY row_number() OVER (PARTITION BY company, period ORDER BY CASE WHEN scope = 'consolidado' THEN 0 ELSE 1 END) = 1""")
def net_income_resolve(spark, d):
    li = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("company"), F.trunc(F.to_date("l_shipdate"), "quarter").alias("period"), F.when(F.col("l_linestatus") == "F", "consolidado").otherwise("individual").alias("scope"), F.when(F.col("l_linenumber") == 1, "controller").otherwise("total").alias("line"), F.when(F.col("l_returnflag") == "N", "MIL").when(F.col("l_returnflag") == "R", "UNIDADE").alias("scale"), F.col("l_extendedprice").alias("value"))
    return P.net_income(li)


@query("no_regression_guard", "SELECT c_mktsegment || c_custkey AS series, CASE WHEN c_custkey % 7 = 0 THEN 'regressed_to_unavailable' ELSE 'date_moved_back' END AS violation FROM customer WHERE c_custkey % 7 = 0 OR c_custkey % 11 = 0")
def no_regression(spark, d):
    c = table(spark, d, "customer").select(F.concat("c_mktsegment", "c_custkey").alias("series"), F.col("c_custkey").alias("k"))
    day = F.lit("2026-01-10").cast("date")
    prev = c.select("series", F.lit("official").alias("status"), day.alias("observed"))
    cur = c.select("series", F.when(F.col("k") % 7 == 0, "unavailable").otherwise("official").alias("status"), F.when(F.col("k") % 11 == 0, F.date_sub(day, 1)).otherwise(day).alias("observed"))
    return P.no_regression(prev, cur)


# -- top-k, samples, sets -----------------------------------------------------


@query("stratified_sample", "SELECT doc_id, lang FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY sha256(CAST(doc_id AS VARCHAR))) AS rn FROM documents) ORDER BY rn, lang LIMIT 60")
def stratified_sample(spark, d):
    w = Window.partitionBy("lang").orderBy(F.sha2(F.col("doc_id").cast("string").cast("binary"), 256))
    return table(spark, d, "documents").select("doc_id", "lang", F.row_number().over(w).alias("rn")).where("rn <= 60").orderBy("rn", "lang").limit(60).select("doc_id", "lang")


@query("topk_documents", "SELECT source, doc_id, n_chars FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) <= 6")
def topk_documents(spark, d):
    w = Window.partitionBy("source").orderBy(F.desc("n_chars"), "doc_id")
    return table(spark, d, "documents").select("source", "doc_id", "n_chars", F.row_number().over(w).alias("rn")).where("rn <= 6").drop("rn")


@query("running_char_budget", "SELECT source, doc_id, greatest(0, least(n, 28000 - before)) AS used FROM (SELECT source, doc_id, length(text) AS n, coalesce(sum(length(text)) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM documents)".replace("greatest(0, least(n, 28000 - before))", "CAST(greatest(0, least(n, 28000 - before)) AS BIGINT)"))
def running_char_budget(spark, d):
    t = running_sum(table(spark, d, "documents").select("source", "doc_id", F.length("text").alias("n")), "source", "doc_id", "n")
    return t.select("source", "doc_id", F.greatest(F.lit(0), F.least(F.col("n"), 28000 - F.col("before"))).cast("long").alias("used"))


@query("stable_multi_key_sort", "SELECT l_suppkey, l_shipdate, l_orderkey, l_linenumber, l_extendedprice FROM lineitem ORDER BY l_suppkey, l_shipdate, l_orderkey, l_linenumber, l_extendedprice")
def stable_sort(spark, d):
    keys = ["l_suppkey", "l_shipdate", "l_orderkey", "l_linenumber", "l_extendedprice"]
    return table(spark, d, "lineitem").select(*keys).orderBy(*keys)


@query("last_status_run", "SELECT event_type, max(ts) AS ts, arg_max(event_id, (ts, event_id)) AS event_id FROM events GROUP BY 1")
def last_status_run(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(F.max("ts").alias("ts"), F.max_by("event_id", F.struct("ts", "event_id")).alias("event_id"))


@query("union_all_sources", "SELECT s_suppkey AS id, s_name AS name, NULL AS segment FROM supplier UNION ALL SELECT c_custkey, c_name, c_mktsegment FROM customer")
def union_all(spark, d):
    s, c = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name")), table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))
    return s.unionByName(c, allowMissingColumns=True)


@query("distinct_by_key", "SELECT DISTINCT lower(p_type) || '|' || p_size AS k FROM part")
def distinct_by_key(spark, d):
    return table(spark, d, "part").select(F.concat_ws("|", F.lower("p_type"), "p_size").alias("k")).distinct()


@query("set_difference_missing", "SELECT user_id, list_sort(list_filter(['click', 'error', 'purchase', 'signup', 'view'], lambda x: NOT list_contains(list(DISTINCT event_type), x))) AS m FROM events GROUP BY 1".replace("list_sort(", "array_to_string(list_sort(").replace(") AS m", "), ',') AS missing"))
def set_difference(spark, d):
    e = table(spark, d, "events").groupBy("user_id").agg(F.collect_set("event_type").alias("have"))
    return e.select("user_id", F.array_join(F.sort_array(F.array_except(F.array(*map(F.lit, ("click", "error", "purchase", "signup", "view"))), F.col("have"))), ",").alias("missing"))


@query("set_intersection_evidence", "SELECT user_id, array_to_string(list_sort(list_intersect(list(DISTINCT event_type), ['click', 'purchase'])), ',') AS allowed FROM events GROUP BY 1")
def set_intersection(spark, d):
    e = table(spark, d, "events").groupBy("user_id").agg(F.collect_set("event_type").alias("have"))
    return e.select("user_id", F.array_join(F.sort_array(F.array_intersect("have", F.array(F.lit("click"), F.lit("purchase")))), ",").alias("allowed"))


@query("frames_identical", "SELECT true AS same_self, false AS same_other")
def frames_identical(spark, d):
    def differ(a, b):
        return a.exceptAll(b).unionByName(b.exceptAll(a)).groupBy().agg((F.count("*") == 0).alias("same"))

    a, b = candles(spark, d).select("ticker", "date", "close"), candles_step(spark, d).select("ticker", "date", "close")
    x, y = differ(a, a).withColumnRenamed("same", "same_self"), differ(a, b).withColumnRenamed("same", "same_other")
    return x.join(F.broadcast(y))
