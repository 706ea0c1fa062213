"""Queries over price series: aggregates and windows of candles."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..fixtures import candles, candles_step, facts, flow, observations, table, with_views
from ..functions.columns import round_half_up as rnd
from ..operators import metrics as M
from .registry import query, r4

_RET = "r AS (SELECT *, lag(close) OVER w AS prev, close / lag(close) OVER w - 1 AS ret, ln(close / lag(close) OVER w) AS lr, max(close) OVER (PARTITION BY ticker ORDER BY date) AS peak, row_number() OVER w AS n, row_number() OVER (PARTITION BY ticker ORDER BY date DESC) AS back FROM candles WHERE close > 0 WINDOW w AS (PARTITION BY ticker ORDER BY date))"
_DD = "d AS (SELECT *, (close / peak - 1) * 100 AS dd FROM r)"


def _metrics_sql(body: str) -> str:
    return with_views("", "candles") + f", {_RET}, {_DD} " + body


_GROWTH = lambda a, b, y: f"CASE WHEN {y} > 0 THEN (pow({b} / {a}, 1.0 / ({y})) - 1) * 100 END"
_MM = f"""SELECT ticker, count(*) AS n_candles, min(date) AS first_date, max(date) AS last_date, {r4('arg_max(close, date)')} AS price, {r4('max(high)')} AS range_high, arg_min(date, (-high, date)) AS range_high_date, {r4('min(low)')} AS range_low, arg_min(date, (low, date)) AS range_low_date,
 {r4('avg(volume)')} AS avg_volume, {r4('avg(close * volume)')} AS avg_financial_volume, {r4('CASE WHEN count(*) >= 20 THEN avg(CASE WHEN back <= 20 THEN close END) END')} AS sma_20, {r4('CASE WHEN count(*) >= 200 THEN avg(CASE WHEN back <= 200 THEN close END) END')} AS sma_200,
 {r4('max(CASE WHEN back = 91 THEN close END)')} AS close_90_ago, {r4('stddev_samp(CASE WHEN back < 90 THEN lr END) * sqrt(252.0) * 100')} AS volatility_90, {r4('avg(lr) * 252 * 100 / (stddev_samp(lr) * sqrt(252.0) * 100)')} AS sharpe, {r4('avg(lr) * 252 * 100 / (sqrt(avg(CASE WHEN lr < 0 THEN lr * lr END)) * sqrt(252.0) * 100)')} AS sortino,
 {r4('sqrt(avg(dd * dd))')} AS ulcer_index, {r4('min(dd)')} AS max_drawdown, arg_min(date, (dd, date)) AS trough_date, {r4('avg(CASE WHEN ret > 0 THEN 1.0 WHEN ret IS NOT NULL THEN 0.0 END) * 100')} AS positive_share,
 {r4(_GROWTH('arg_min(close, date)', 'arg_max(close, date)', "date_diff('day', min(date), max(date)) / 365.25"))} AS cagr, {r4(_GROWTH('avg(CASE WHEN n <= 5 THEN close END)', '((avg(CASE WHEN back <= 5 THEN close END) + arg_max(close, date)) / 2)', 'count(*) / 252.0'))} AS cagr_smoothed,
 {r4('(arg_max(close, date) / arg_min(close, date) - 1) * 100')} AS period_return, {r4('(arg_max(close, date) - min(low)) / (max(high) - min(low)) * 100')} AS position_in_range FROM d GROUP BY ticker"""
_MM_COLS = "ticker n_candles first_date last_date price range_high range_high_date range_low range_low_date avg_volume avg_financial_volume sma_20 sma_200 close_90_ago volatility_90 sharpe sortino ulcer_index max_drawdown trough_date positive_share cagr cagr_smoothed period_return position_in_range".split()


@query("market_metrics", _metrics_sql(_MM))
def market_metrics(spark, d):
    return M.rounded(M.market_metrics(candles(spark, d)).select(*_MM_COLS))


def _one(name: str, columns: list[str], sql: str):
    query(name, _metrics_sql(sql))(lambda spark, d: M.rounded(M.market_metrics(candles(spark, d)).select("ticker", *columns)))


_one("volatility_annualised", ["volatility_30", "volatility_252"], f"SELECT ticker, {r4('stddev_samp(CASE WHEN back < 30 THEN lr END) * sqrt(252.0) * 100')} AS volatility_30, {r4('stddev_samp(CASE WHEN back < 252 THEN lr END) * sqrt(252.0) * 100')} AS volatility_252 FROM d GROUP BY ticker")
_one("sharpe", ["sharpe"], f"SELECT ticker, {r4('avg(lr) * sqrt(252.0) / stddev_samp(lr)')} AS sharpe FROM d GROUP BY ticker")
_one("sortino", ["sortino"], f"SELECT ticker, {r4('avg(lr) * sqrt(252.0) / sqrt(avg(CASE WHEN lr < 0 THEN lr * lr END))')} AS sortino FROM d GROUP BY ticker")
_one("ulcer_index", ["ulcer_index"], f"SELECT ticker, {r4('sqrt(avg(dd * dd))')} AS ulcer_index FROM d GROUP BY ticker")
_one("max_drawdown", ["max_drawdown", "peak_date", "trough_date"], f"""SELECT a.ticker, {r4('any_value(a.m)')} AS max_drawdown, max(c.date) AS peak_date, any_value(a.t) AS trough_date
 FROM (SELECT ticker, min(dd) AS m, arg_min(date, (dd, date)) AS t, arg_min(peak, (dd, date)) AS p FROM d GROUP BY ticker) a JOIN candles c ON c.ticker = a.ticker AND c.close = a.p AND c.date <= a.t GROUP BY a.ticker""")
_one("cagr_plain", ["cagr"], f"SELECT ticker, {r4(_GROWTH('arg_min(close, date)', 'arg_max(close, date)', "date_diff('day', min(date), max(date)) / 365.25"))} AS cagr FROM d GROUP BY ticker")
_one("cagr_smoothed", ["cagr_smoothed"], f"SELECT ticker, {r4(_GROWTH('avg(CASE WHEN n <= 5 THEN close END)', '((avg(CASE WHEN back <= 5 THEN close END) + arg_max(close, date)) / 2)', 'count(*) / 252.0'))} AS cagr_smoothed FROM d GROUP BY ticker")
_one("calmar_recovery", ["recovery"], f"SELECT ticker, {r4('(arg_max(close, date) / arg_min(close, date) - 1) * 100 / abs(min(dd))')} AS recovery FROM d GROUP BY ticker")
_one("positive_period_share", ["positive_share"], f"SELECT ticker, {r4('avg(CASE WHEN ret > 0 THEN 1.0 WHEN ret IS NOT NULL THEN 0.0 END) * 100')} AS positive_share FROM d GROUP BY ticker")
_one("range_extremes", ["range_high", "range_high_date", "range_low", "range_low_date", "amplitude", "from_high"], f"SELECT ticker, {r4('max(high)')} AS range_high, arg_min(date, (-high, date)) AS range_high_date, {r4('min(low)')} AS range_low, arg_min(date, (low, date)) AS range_low_date, {r4('(max(high) - min(low)) / min(low) * 100')} AS amplitude, {r4('(arg_max(close, date) / max(high) - 1) * 100')} AS from_high FROM d GROUP BY ticker")
_one("mean_price_volume", ["avg_volume", "avg_financial_volume"], f"SELECT ticker, {r4('avg(volume)')} AS avg_volume, {r4('avg(close * volume)')} AS avg_financial_volume FROM d GROUP BY ticker")


@query("ohlcv_daily_rollup", with_views(f"SELECT ticker, date, {r4('open')} AS open, {r4('high')} AS high, {r4('low')} AS low, {r4('close')} AS close, volume FROM candles", "candles"))
def ohlcv_daily_rollup(spark, d):
    return M.rounded(candles(spark, d))


@query("series_summary", with_views(f"""SELECT series, count(*) AS n, count(*) FILTER (value IS NULL) AS nulls, min(date) AS first_date, max(date) AS last_date, {r4('min(value)')} AS low, {r4('max(value)')} AS high,
 CASE WHEN median(gap) <= 4 THEN 'daily' WHEN median(gap) <= 10 THEN 'weekly' WHEN median(gap) <= 45 THEN 'monthly' WHEN median(gap) <= 120 THEN 'quarterly' WHEN median(gap) IS NOT NULL THEN 'annual' ELSE 'unknown' END AS periodicity
 FROM (SELECT *, date_diff('day', lag(date) OVER (PARTITION BY series ORDER BY date), date) AS gap FROM observations) GROUP BY series""", "observations"))
def series_summary(spark, d):
    return M.rounded(M.series_summary(observations(spark, d)))


@query("lag_log_return", with_views("", "candles") + f", {_RET} SELECT ticker, date, {r4('ret')} AS ret, {r4('lr')} AS log_ret FROM r")
def lag_log_return(spark, d):
    return M.rounded(M.with_returns(candles(spark, d).where("close > 0")).select("ticker", "date", "ret", "log_ret"))


@query("sma_n", with_views(f"SELECT ticker, date, {r4('CASE WHEN count(*) OVER w = 20 THEN avg(close) OVER w END')} AS sma_20 FROM candles WINDOW w AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)", "candles"))
def sma_n(spark, d):
    return M.rounded(M.moving_average(candles(spark, d), (20,)).select("ticker", "date", "sma_20"))


@query("close_n_ago", with_views(f"SELECT ticker, date, {r4('lag(close, 30) OVER w')} AS close_30_ago, {r4('lag(close, 252) OVER w')} AS close_252_ago FROM candles WINDOW w AS (PARTITION BY ticker ORDER BY date)", "candles"))
def close_n_ago(spark, d):
    return M.rounded(M.close_n_ago(candles(spark, d), (30, 252)).select("ticker", "date", "close_30_ago", "close_252_ago"))


@query("running_peak", with_views(f"SELECT ticker, date, {r4('max(close) OVER (PARTITION BY ticker ORDER BY date)')} AS peak FROM candles", "candles"))
def running_peak(spark, d):
    return M.rounded(M.with_peak(candles(spark, d)).select("ticker", "date", "peak"))


_RATIOS = "(VALUES (0.1), (0.125), (0.2), (0.25), (1.0 / 3), (0.5), (2.0), (3.0), (4.0), (5.0), (8.0), (10.0))"
JUMPS_SQL = f"""jumps AS (SELECT ticker, date, prev_close, close, prev_close / close AS raw_ratio FROM (SELECT *, lag(close) OVER (PARTITION BY ticker ORDER BY date) AS prev_close FROM candles_step WHERE close > 0) WHERE close / prev_close < 0.6 OR close / prev_close > 1.4),
 judged AS (SELECT j.*, (SELECT min(abs(ln(j.raw_ratio / CAST(c AS DOUBLE)))) FROM {_RATIOS} t(c)) AS far, (SELECT arg_min(CAST(c AS DOUBLE), abs(ln(j.raw_ratio / CAST(c AS DOUBLE)))) FROM {_RATIOS} t(c)) AS best FROM jumps j)"""


@query("detect_jumps", with_views("", "candles_step") + f", {JUMPS_SQL} SELECT ticker, date, {r4('raw_ratio')} AS raw_ratio, CASE WHEN far <= ln(1.08) THEN {r4('best')} END AS ratio, CASE WHEN far <= ln(1.08) THEN 'accepted' ELSE 'rejected' END AS status FROM judged")
def detect_jumps(spark, d):
    return M.rounded(M.detect_jumps(candles_step(spark, d)).drop("prev_close", "close"))


@query("duplicate_close_suspicion", with_views("""SELECT ticker, count(*) AS n, CAST(sum(CASE WHEN hi - n > 20 OR n - lo > 20 THEN 1 ELSE 0 END) AS BIGINT) AS suspicious FROM (SELECT ticker, n, max(n) OVER (PARTITION BY ticker, c4) AS hi, min(n) OVER (PARTITION BY ticker, c4) AS lo
 FROM (SELECT ticker, floor(close * 1e4 + 0.5) / 1e4 AS c4, row_number() OVER (PARTITION BY ticker ORDER BY date) AS n FROM candles_step)) GROUP BY ticker""", "candles_step"))
def duplicate_close_suspicion(spark, d):
    return M.duplicate_close(candles_step(spark, d)).groupBy("ticker").agg(F.count("*").alias("n"), F.count_if("suspicious").alias("suspicious"))


@query("detect_changes", with_views("SELECT ticker AS series, date, value, before FROM (SELECT ticker, date, close AS value, lag(close) OVER (PARTITION BY ticker ORDER BY date) AS before FROM candles_step) WHERE value <> before", "candles_step").replace("value, before FROM (SELECT", f"{r4('value')} AS value, {r4('before')} AS before FROM (SELECT", 1))
def detect_changes(spark, d):
    return M.rounded(M.detect_changes(candles_step(spark, d).select(F.col("ticker").alias("series"), "date", F.col("close").alias("value"))))


def _accumulated(spark, d):
    o = table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("segment"), F.to_date("o_orderdate").alias("date")).agg(F.sum("o_totalprice").alias("v"))
    return o.select("segment", "date", F.sum("v").over(Window.partitionBy("segment", F.trunc("date", "month")).orderBy("date")).alias("acc"))


_ACC = "acc AS (SELECT segment, date, sum(v) OVER (PARTITION BY segment, date_trunc('month', date) ORDER BY date) AS acc FROM (SELECT o_orderpriority AS segment, CAST(o_orderdate AS DATE) AS date, sum(o_totalprice) AS v FROM orders GROUP BY 1, 2))"


@query("flow_from_accumulated", f"WITH {_ACC} SELECT segment, date, {r4("coalesce(acc - lag(acc) OVER (PARTITION BY segment, date_trunc('month', date) ORDER BY date), acc)")} AS flow FROM acc")
def flow_from_accumulated(spark, d):
    return M.flow_from_accumulated(_accumulated(spark, d)).select("segment", "date", rnd("flow", 4).alias("flow"))


@query("cadence_classifier", f"""WITH {_ACC} SELECT segment, date, CASE WHEN a IS NULL THEN NULL WHEN abs(a) <= abs(b) AND abs(b) <= abs(acc) AND sign(a) = sign(b) AND sign(b) = sign(acc) THEN 'accumulated' ELSE 'daily' END AS cadence
 FROM (SELECT *, lag(acc, 2) OVER (PARTITION BY segment ORDER BY date) AS a, lag(acc) OVER (PARTITION BY segment ORDER BY date) AS b FROM acc)""")
def cadence_classifier(spark, d):
    return M.cadence(_accumulated(spark, d)).select("segment", "date", "cadence")


_ROLL = "rolled AS (SELECT segment, data_ref, CASE WHEN count(*) OVER w = 3 THEN sum(flow) OVER w END AS s FROM flow WHERE data_ref = last_day(data_ref) WINDOW w AS (PARTITION BY segment ORDER BY data_ref ROWS BETWEEN 2 PRECEDING AND CURRENT ROW))"


@query("rolling_sum_months", with_views("", "flow") + f", {_ROLL} SELECT segment, data_ref, {r4('s')} AS window_sum FROM rolled")
def rolling_sum_months(spark, d):
    return M.rolling_sum_months(flow(spark, d), 3).select("segment", "data_ref", rnd("window_sum", 4).alias("window_sum"))


PCT_SQL = f"""{_ROLL}, b AS (SELECT *, row_number() OVER (PARTITION BY segment ORDER BY data_ref DESC) AS back FROM rolled WHERE s IS NOT NULL), f AS (SELECT *, first_value(s) OVER (PARTITION BY segment ORDER BY back) AS cur FROM b WHERE back <= 24),
 pct AS (SELECT segment, max(data_ref) AS data_ref, max(cur) AS window_sum, count(*) AS n, (count(*) FILTER (s < cur) + greatest(0, count(*) FILTER (s = cur) - 1) / 2.0) / (count(*) - 1) AS percentile FROM f GROUP BY segment)"""


@query("percentile_rank_last24", with_views("", "flow") + f", {PCT_SQL} SELECT segment, data_ref, {r4('window_sum')} AS window_sum, n, {r4('percentile')} AS percentile, CASE WHEN n >= 24 THEN 'canonical' ELSE 'provisional' END AS kind FROM pct")
def percentile_rank_last24(spark, d):
    return M.rounded(M.percentile_of_last(M.rolling_sum_months(flow(spark, d), 3)))


@query("flow_month_close", with_views("SELECT segment, count(*) FILTER (data_ref = last_day(data_ref)) AS closed, count(*) FILTER (data_ref <> last_day(data_ref)) AS partial, max(data_ref) AS latest, max(data_ref) <> last_day(max(data_ref)) AS latest_partial FROM flow GROUP BY segment", "flow"))
def flow_month_close(spark, d):
    end = F.col("data_ref") == F.last_day("data_ref")
    return flow(spark, d).groupBy("segment").agg(F.count_if(end).alias("closed"), F.count_if(~end).alias("partial"), F.max("data_ref").alias("latest"), F.max_by(~end, "data_ref").alias("latest_partial"))


@query("cumulative_inflation", f"SELECT CASE WHEN count(*) = 3 THEN {r4('product(1 + rate / 100)')} END AS factor FROM (SELECT year(l_shipdate) AS year, 100 * avg(l_tax) AS rate FROM lineitem GROUP BY 1) WHERE year IN (1996, 1997, 1998)")
def cumulative_inflation(spark, d):
    rates = table(spark, d, "lineitem").groupBy(F.year("l_shipdate").alias("year")).agg((100 * F.avg("l_tax")).alias("rate"))
    return M.rounded(M.cumulative_inflation(rates, [1996, 1997, 1998]))


@query("coverage_distinct", with_views("""SELECT ticker, arg_max(scope, (n, scope = 'consolidado')) AS scope, max(n) AS coverage FROM (SELECT ticker, scope, count(DISTINCT (fiscal_year, metric)) AS n FROM facts GROUP BY 1, 2) GROUP BY 1""", "facts"))
def coverage_distinct(spark, d):
    per = facts(spark, d).groupBy("ticker", "scope").agg(F.count_distinct("fiscal_year", "metric").alias("n"))
    return per.groupBy("ticker").agg(F.max_by("scope", F.struct("n", F.col("scope") == "consolidado")).alias("scope"), F.max("n").alias("coverage"))


@query("count_by_status", "SELECT o_orderstatus AS status, count(*) AS n, count(*) FILTER (o_totalprice > 200000) AS n_large FROM orders GROUP BY 1")
def count_by_status(spark, d):
    return table(spark, d, "orders").groupBy(F.col("o_orderstatus").alias("status")).agg(F.count("*").alias("n"), F.count_if(F.col("o_totalprice") > 200000).alias("n_large"))


@query("identity_check", f"""WITH p AS (SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS date, sum(o_totalprice) AS total, sum(CASE WHEN o_orderstatus = 'F' THEN o_totalprice ELSE 0 END) AS f, sum(CASE WHEN o_orderstatus <> 'F' THEN o_totalprice ELSE 0 END) AS g FROM orders GROUP BY 1)
 SELECT count(*) AS n, count(*) FILTER (abs(total - f - g) <= 0.01) AS ok, {r4('avg(CASE WHEN abs(total - f - g) <= 0.01 THEN 1.0 ELSE 0.0 END)')} AS coverage FROM p""")
def identity_check(spark, d):
    o = table(spark, d, "orders")
    is_f = F.col("o_orderstatus") == "F"
    p = o.groupBy(F.trunc(F.to_date("o_orderdate"), "month").alias("date")).agg(F.sum("o_totalprice").alias("total"), F.sum(F.when(is_f, F.col("o_totalprice")).otherwise(0)).alias("f"), F.sum(F.when(~is_f, F.col("o_totalprice")).otherwise(0)).alias("g"))
    ok = F.abs(F.col("total") - F.col("f") - F.col("g")) <= 0.01
    return p.groupBy().agg(F.count("*").alias("n"), F.count_if(ok).alias("ok"), rnd(F.avg(ok.cast("int")), 4).alias("coverage"))


@query("series_compare", with_views(f"""SELECT count(*) AS n, count(*) FILTER (a.value = b.value) AS n_equal, {r4('avg(abs(a.value - b.value))')} AS mean_diff, {r4('max(abs(a.value - b.value))')} AS max_diff FROM observations a JOIN observations b USING (date) WHERE a.series = 'BUILDING' AND b.series = 'MACHINERY'""", "observations"))
def series_compare(spark, d):
    o = observations(spark, d)
    a, b = o.where("series = 'BUILDING'").select("date", F.col("value").alias("a")), o.where("series = 'MACHINERY'").select("date", F.col("value").alias("b"))
    j = a.join(b, "date")
    return M.rounded(j.groupBy().agg(F.count("*").alias("n"), F.count_if(F.col("a") == F.col("b")).alias("n_equal"), F.avg(F.abs(F.col("a") - F.col("b"))).alias("mean_diff"), F.max(F.abs(F.col("a") - F.col("b"))).alias("max_diff")))


@query("zero_sum_check", with_views(f"SELECT data_ref, {r4('abs(sum(flow)) / sum(abs(flow))')} AS imbalance, abs(sum(flow)) / sum(abs(flow)) <= 0.05 AS balanced FROM flow GROUP BY data_ref", "flow"))
def zero_sum_check(spark, d):
    part = F.try_divide(F.abs(F.sum("flow")), F.sum(F.abs("flow")))
    return flow(spark, d).groupBy("data_ref").agg(rnd(part, 4).alias("imbalance"), (part <= 0.05).alias("balanced"))


@query("weighted_score", """SELECT ticker, floor(sum(CASE WHEN ok THEN score * weight END) / sum(CASE WHEN ok THEN weight END) * 1e4 + 0.5) / 1e4 AS score FROM (SELECT l_suppkey AS ticker, CAST(l_linenumber AS DOUBLE) AS weight, l_discount * 1000 AS score, l_returnflag <> 'R' AS ok FROM lineitem) GROUP BY 1""")
def weighted_score(spark, d):
    li = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("ticker"), F.col("l_linenumber").cast("double").alias("weight"), (F.col("l_discount") * 1000).alias("score"), (F.col("l_returnflag") != "R").alias("applicable"))
    return M.rounded(M.weighted_score(li, "ticker"))


@query("presence_score", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, ((l_discount > 0)::INT + (l_tax > 0)::INT + (l_returnflag = 'A')::INT) * 100.0::DOUBLE / 3 AS raw FROM lineitem".replace("((l_discount", "floor((((l_discount").replace("/ 3 AS raw", "/ 3) * 1e4 + 0.5) / 1e4 AS score"))
def presence_score(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.when(F.col("l_discount") > 0, 1).alias("a"), F.when(F.col("l_tax") > 0, 1).alias("b"), F.when(F.col("l_returnflag") == "A", 1).alias("c"))
    return li.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", rnd(M.presence_score("a", "b", "c"), 4).alias("score"))


@query("group_events_by_key", "SELECT user_id, count(*) AS n, list(event_id ORDER BY ts, event_id)[1] AS first_event, list(event_id ORDER BY ts, event_id)[-1] AS last_event FROM events GROUP BY 1")
def group_events_by_key(spark, d):
    e = table(spark, d, "events").groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct("ts", "event_id"))).alias("e"))
    return e.select("user_id", F.size("e").cast("long").alias("n"), F.element_at("e", 1)["event_id"].alias("first_event"), F.element_at("e", -1)["event_id"].alias("last_event"))


@query("shares_outstanding", "SELECT s_suppkey, floor(s_acctbal) + 1000 - coalesce(CASE WHEN s_nationkey > 5 THEN s_nationkey END, 0) AS on_out, coalesce(CASE WHEN s_nationkey > 10 THEN CAST(s_nationkey AS DOUBLE) END, 0) AS pn_out FROM supplier")
def shares_outstanding(spark, d):
    s = table(spark, d, "supplier").select("s_suppkey", (F.floor("s_acctbal") + 1000).cast("double").alias("on_paid"), F.when(F.col("s_nationkey") > 5, F.col("s_nationkey")).alias("on_treasury"), F.when(F.col("s_nationkey") > 10, F.col("s_nationkey").cast("double")).alias("pn_paid"), F.lit(None).cast("double").alias("pn_treasury"))
    z = lambda c: F.coalesce(c, F.lit(0))
    return s.select("s_suppkey", (z("on_paid") - z("on_treasury")).alias("on_out"), (z("pn_paid") - z("pn_treasury")).alias("pn_out"))


@query("document_frequency", "SELECT token, count(DISTINCT doc_id) AS df FROM (SELECT doc_id, unnest(list_distinct(string_split_regex(lower(text), '[^a-z]+'))) AS token FROM documents) WHERE length(token) >= 3 GROUP BY 1")
def document_frequency(spark, d):
    words = table(spark, d, "documents").select("doc_id", F.explode(F.array_distinct(F.split(F.lower("text"), "[^a-z]+"))).alias("token")).where(F.length("token") >= 3)
    return words.groupBy("token").agg(F.count_distinct("doc_id").alias("df"))
