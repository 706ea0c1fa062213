"""Queries over providers' nested rows. Both engines build the same JSON texts from the tables and read them by themselves."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..fixtures import table
from ..operators import profiles as P
from .registry import query

#: A part as the domestic provider's answer, in three shapes, and none for large sizes.
LOCAL = """CASE WHEN p_size < 15 THEN '{"ticker":"B3:' || p_name || '","kind":"' || p_type || '","quote":{"price":"' || p_size || ',50","change":' || p_partkey || ',"volume":"x"},"market":{"close":1,"volume":' || (p_partkey + 7) || ',"is_open":true},"classification":{"sector":"' || p_brand || '"},"dividends":{"yield_12m":null,"yield_percent":"3,25"}}'
 WHEN p_size < 30 THEN '{"market":{"close":' || p_size || ',"open":"9.5"},"type":"","asset_type":"fund","sector":"","segment":"' || p_type || '","market_cap":"' || p_partkey || '","name":" ' || p_name || ' "}'
 WHEN p_size < 40 THEN '{"price":' || p_partkey || ',"currency":"USD","quote":[1],"full_name":"' || p_name || '"}'
 WHEN p_size < 45 THEN '{"status":"error","price":1}' END"""
#: A customer as the foreign provider's quote and profile.
QUOTE = """CASE WHEN c_mktsegment IN ('BUILDING', 'FURNITURE') THEN '{"symbol":"' || c_name || '","close":"' || c_nationkey || '.25","percent_change":-' || c_custkey || ',"is_market_open":false,"previous_close":""}' WHEN c_nationkey < 12 THEN '{"code":404,"message":"no"}' ELSE '{"name":"n","currency":"EUR","volume":' || c_custkey || '}' END"""
PROFILE = """CASE WHEN c_nationkey > 5 THEN '{"sector":"' || c_mktsegment || '","industry":"","type":"Stock","name":"Full ' || c_name || '"}' END"""


def _sql_text(v: str, *paths: str) -> str:
    return "coalesce(" + ", ".join(f"nullif(trim(json_extract_string({v}, '$.{p}')), '')" for p in paths) + ")"


def _sql_number(v: str, *paths: str) -> str:
    return "coalesce(" + ", ".join(f"try_cast(replace(trim(json_extract_string({v}, '$.{p}')), ',', '.') AS DOUBLE)" for p in paths) + ")"


_ASSET = ["ok", "ticker", "full_ticker", "symbol", "name", "full_name", "asset_type", "currency", "sector", "price", "change_value", "market_cap", "is_open", "open", "close", "volume", "dividend_yield"]
_QUOTE_SQL = f"""WITH r AS (SELECT 'P' || p_partkey AS t, ({LOCAL})::JSON AS j FROM part), b AS (SELECT t, j, j IS NOT NULL AND coalesce(j ->> 'status', '') <> 'error' AS ok,
 CASE WHEN json_type(j, '$.quote') = 'OBJECT' THEN j -> 'quote' WHEN json_type(j, '$.market') = 'OBJECT' THEN j -> 'market' END AS q, CASE WHEN json_type(j, '$.market') = 'OBJECT' THEN j -> 'market' WHEN json_type(j, '$.quote') = 'OBJECT' THEN j -> 'quote' END AS m FROM r),
 a AS (SELECT *, coalesce({_sql_number("q", "price", "close")}, {_sql_number("m", "close")}, {_sql_number("j", "price", "close")}) AS p FROM b)
SELECT ok, t AS ticker, CASE WHEN ok THEN coalesce(j ->> 'ticker', 'B3:' || t) END AS full_ticker, CASE WHEN ok THEN t END AS symbol, CASE WHEN ok THEN {_sql_text("j", "name")} END AS name, CASE WHEN ok THEN {_sql_text("j", "full_name")} END AS full_name,
 CASE WHEN ok THEN {_sql_text("j", "kind", "type", "asset_type")} END AS asset_type, CASE WHEN ok THEN coalesce(j ->> 'currency', 'BRL') END AS currency, CASE WHEN ok THEN {_sql_text("j", "classification.sector", "sector", "segment")} END AS sector, CASE WHEN ok THEN p END AS price,
 CASE WHEN ok THEN {_sql_number("q", "change")} END AS change_value, CASE WHEN ok THEN {_sql_number("j", "market_cap")} END AS market_cap, CASE WHEN ok THEN CAST(coalesce(m ->> 'is_open', q ->> 'is_open') AS BOOLEAN) END AS is_open,
 CASE WHEN ok THEN coalesce({_sql_number("q", "open")}, {_sql_number("m", "open")}) END AS open, CASE WHEN ok THEN coalesce({_sql_number("q", "close")}, {_sql_number("m", "close")}, p) END AS close,
 CASE WHEN ok THEN coalesce({_sql_number("q", "volume")}, {_sql_number("m", "volume")}, {_sql_number("j", "volume")}) END AS volume, CASE WHEN ok THEN {_sql_number("j", "dividends.yield_12m", "dividends.yield_percent")} END AS dividend_yield FROM a
UNION ALL SELECT q IS NOT NULL, t, t, coalesce({_sql_text("q", "symbol")}, t), coalesce({_sql_text("q", "name")}, p ->> 'name', CASE WHEN q IS NOT NULL THEN t END), p ->> 'name', p ->> 'type', coalesce(q ->> 'currency', CASE WHEN q IS NOT NULL THEN 'USD' END), p ->> 'sector',
 {_sql_number("q", "close")}, {_sql_number("q", "change")}, NULL, CAST(q ->> 'is_market_open' AS BOOLEAN), NULL, {_sql_number("q", "close")}, {_sql_number("q", "volume")}, NULL
FROM (SELECT t, p, CASE WHEN (j ->> 'code') IS NULL THEN j END AS q FROM (SELECT 'C' || c_custkey AS t, ({QUOTE})::JSON AS j, ({PROFILE})::JSON AS p FROM customer))"""


@query("shape_quote_profile", _QUOTE_SQL)
def quote_profile(spark, d):
    """Assets of two providers as rows of one shape."""
    ticker = lambda letter, key: F.concat(F.lit(letter), F.col(key))
    parts = table(spark, d, "part").select(ticker("P", "p_partkey").alias("t"), F.try_parse_json(F.expr(LOCAL)).alias("v"))
    customers = table(spark, d, "customer").select(ticker("C", "c_custkey").alias("t"), F.try_parse_json(F.expr(QUOTE)).alias("q"), F.try_parse_json(F.expr(PROFILE)).alias("p"))
    rows = [parts.select(*[c.alias(k) for k, c in P.local_asset("t", "v").items()]), customers.select(*[c.alias(k) for k, c in P.foreign_asset("t", "q", "p").items()])]
    return rows[0].unionByName(rows[1]).select(*_ASSET)


STATEMENT = """CASE WHEN p_size < 20 THEN '{"valuation":{"price_to_earnings_ratio":"' || p_size || ',5","earnings_per_share":' || p_partkey || '},"margins":{"gross_margin":"","grossMargin":' || p_size || ',"netMargin":2},"dividends":{"yieldPercent":4},"leverage":{"current_ratio":"n/a"}}'
 WHEN p_size < 40 THEN '{"margins":{"net_profit_margin":1.5,"profit_margin":' || p_size || ',"margem_bruta":7},"profitability":{"return_on_equity":' || p_partkey || '},"dividends":{"yield_percent":' || p_size || '},"valuation":[]}' END"""
STATISTICS = """CASE WHEN c_nationkey < 20 THEN '{"statistics":{"valuations_metrics":{"trailing_pe":"' || c_nationkey || '.5"},"financials":{"gross_margin":0.5,"profit_margin":"' || c_custkey || '","return_on_equity_ttm":0.25,"income_statement":{"diluted_eps_ttm":' || c_custkey || '},"balance_sheet":{"current_ratio_mrq":1.25}},"dividends_and_splits":{"trailing_annual_dividend_yield":"0.0625"}}}' ELSE '{"status":"error"}' END"""
_INDICATORS = ["pe", "eps", "gross_margin", "net_margin", "roe", "current_ratio", "dividend_yield"]


def _indicator_sql(v: str, paths: list[tuple[str, ...]]) -> str:
    return ", ".join(f"{_sql_number(v, *p)} AS {k}" for k, p in zip(_INDICATORS, paths))


_FUNDAMENTALS_SQL = f"""SELECT 'P' || p_partkey AS ticker, {_indicator_sql("j", [("valuation.price_to_earnings_ratio",), ("valuation.earnings_per_share",), ("margins.gross_margin", "margins.grossMargin", "margins.margem_bruta"),
 ("margins.net_profit_margin", "margins.profit_margin", "margins.netMargin"), ("profitability.return_on_equity",), ("leverage.current_ratio",), ("dividends.yield_percent", "dividends.yieldPercent")])} FROM (SELECT p_partkey, ({STATEMENT})::JSON AS j FROM part)
UNION ALL SELECT 'C' || c_custkey, pe, eps, gross_margin, net_margin, roe * 100, current_ratio, dividend_yield * 100 FROM (SELECT c_custkey, {_indicator_sql("j", [("statistics.valuations_metrics.trailing_pe",), ("statistics.financials.income_statement.diluted_eps_ttm",),
 ("statistics.financials.gross_margin",), ("statistics.financials.profit_margin",), ("statistics.financials.return_on_equity_ttm",), ("statistics.financials.balance_sheet.current_ratio_mrq",), ("statistics.dividends_and_splits.trailing_annual_dividend_yield",)])} FROM (SELECT c_custkey, ({STATISTICS})::JSON AS j FROM customer))"""


@query("shape_fundamentals", _FUNDAMENTALS_SQL)
def fundamentals(spark, d):
    """Indicators of two providers' nested statements as rows of one shape."""
    parts = table(spark, d, "part").select(F.concat(F.lit("P"), "p_partkey").alias("ticker"), F.try_parse_json(F.expr(STATEMENT)).alias("v"))
    customers = table(spark, d, "customer").select(F.concat(F.lit("C"), "c_custkey").alias("ticker"), F.try_parse_json(F.expr(STATISTICS)).alias("v"))
    pick = lambda columns: [columns[k].alias(k) for k in _INDICATORS]
    return parts.select("ticker", *pick(P.local_indicators("v"))).unionByName(customers.select("ticker", *pick(P.foreign_indicators("v"))))


#: A part's price models: an array of objects and plain values, or an object that names them.
MODELS = """CASE WHEN p_size < 25 THEN '{"preco":[{"camada":"' || p_brand || '","vj":' || p_size || ',"met":"' || p_type || '"},"' || p_name || '",null,"",{"nome":"Graham ' || p_brand || '","valor":"' || p_partkey || '","nota":[1]}],"valuations_classicos":[{"modelo":"GRAHAM ' || p_brand || '","preco":' || p_partkey || '}]}'
 ELSE '{"modelo_preco":{"z ' || p_type || '":' || p_size || ',"a":{"valor_justo":" ' || p_partkey || ' ","premissas":"' || p_name || '"}},"classic_valuations":{"Bazin":{"valor":1}}}' END"""
_ENTRY_SQL = f"""WITH t AS (SELECT *, p_size < 25 AS many FROM part),
 e AS (SELECT p_partkey, 'layer' AS kind, 0 AS at, p_brand AS label, CAST(p_size AS VARCHAR) AS value, p_type AS methodology, '' AS premises FROM t WHERE many
 UNION ALL SELECT p_partkey, CASE WHEN regexp_matches(p_name, '{P.CLASSIC}') THEN 'classic' ELSE 'layer' END, 1, 'Valuation 2', p_name, '', '' FROM t WHERE many
 UNION ALL SELECT p_partkey, 'classic', 4, 'Graham ' || p_brand, CAST(p_partkey AS VARCHAR), '', '' FROM t WHERE many
 UNION ALL SELECT p_partkey, 'layer', 0, 'z ' || p_type, CAST(p_size AS VARCHAR), '', '' FROM t WHERE NOT many
 UNION ALL SELECT p_partkey, 'layer', 1, 'a', CAST(p_partkey AS VARCHAR), '', p_name FROM t WHERE NOT many
 UNION ALL SELECT p_partkey, 'classic', 0, 'Bazin', '1', '', '' FROM t WHERE NOT many)
SELECT * FROM e"""


@query("valuation_entry_normalize", _ENTRY_SQL)
def valuation_entries(spark, d):
    return P.price_models(table(spark, d, "part").select("p_partkey", F.expr(MODELS).alias("body")), "p_partkey", "body").select("p_partkey", "kind", "at", "label", "value", "methodology", "premises")


_FLAGS_SQL = f"""WITH t AS (SELECT doc_id, CASE WHEN n_chars > 400 THEN 'deep' ELSE 'triage' END AS phase, CASE WHEN lang = 'en' THEN 'not_applicable' ELSE 'ok' END AS status, coalesce(trim(CASE WHEN n_chars > 3000 THEN 'Apesar do RISCO, ' || source || ' fica' || lang WHEN n_chars > 1000 THEN 'A premissa vale: ' || source || ' ' || lang || ' ' || source WHEN n_chars > 700 THEN '  ' || source || '  ' END), '') AS c, lang IN ('de', 'fr') AS wants, lang FROM documents),
 f AS (SELECT *, phase = 'deep' AND status = 'ok' AS required FROM t), g AS (SELECT *, required AND wants AS jr FROM f),
 h AS (SELECT *, NOT jr OR (length(c) >= 36 AND regexp_matches(c, '(?i){P.JUSTIFIES}')) AS jp FROM g)
SELECT doc_id, required AS conclusion_required, length(c) >= 20 AS conclusion_present, jr AS justification_required, jp AS justification_present, NOT required OR (length(c) >= 20 AND jp) AS complete, NOT required OR length(c) >= 24 AS nominal_complete, CASE WHEN status = 'not_applicable' THEN 1 ELSE 3 END AS gaps FROM h"""


@query("model_integrity_flags", _FLAGS_SQL)
def model_integrity_flags(spark, d):
    """Conclusions made from documents' sizes and sources, with three gaps of which two are on the nominal test."""
    text = """CASE WHEN n_chars > 3000 THEN 'Apesar do RISCO, ' || source || ' fica' || lang WHEN n_chars > 1000 THEN 'A premissa vale: ' || source || ' ' || lang || ' ' || source WHEN n_chars > 700 THEN '  ' || source || '  ' END"""
    t = table(spark, d, "documents").select("doc_id", F.when(F.col("n_chars") > 400, "deep").otherwise("triage").alias("phase"), F.when(F.col("lang") == "en", "not_applicable").otherwise("ok").alias("status"), F.expr(text).alias("c"), F.col("lang").isin("de", "fr").alias("wants"))
    flags = P.integrity_flags("phase", "status", "c", 20, "wants")
    gaps = P.without_nominal_gaps(F.array(F.lit("Falta o TDN de 2024"), F.lit("Caixa"), F.lit("Teste de Defésa Nominal sem série")), "status")
    return t.select("doc_id", *[c.alias(k) for k, c in flags.items() if k != "conclusion"], P.integrity_flags("phase", "status", "c", 24)["complete"].alias("nominal_complete"), F.size(gaps).alias("gaps"))
