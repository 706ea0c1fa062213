"""Providers' nested rows (VARIANT) in one typed shape: quotes, profiles, indicators and price models.

A provider names a field in several ways and leaves out what it doesn't know. Each output column has a list of paths, the
preferred one first: a text is the first that isn't empty (trimmed), a number the first that can be read (JSON nulls, empty texts and
other shapes are passed over).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import col, plain_text, to_number


def _text(v: Column, *paths: str) -> Column:
    return F.coalesce(*[F.nullif(F.trim(F.try_variant_get(v, f"$.{p}", "string")), F.lit("")) for p in paths])


def _number(v: Column, *paths: str) -> Column:
    return F.coalesce(*[to_number(F.try_variant_get(v, f"$.{p}", "string")) for p in paths])


def _object(v: Column, *keys: str) -> Column:
    """The first of these keys that holds an object."""
    return F.coalesce(*[F.when(F.schema_of_variant(F.try_variant_get(v, f"$.{k}", "variant")).startswith("OBJECT"), F.try_variant_get(v, f"$.{k}", "variant")) for k in keys])


def failed(v) -> Column:
    """Whether a provider's answer is none: null, no object, or one that says that it is an error."""
    v = col(v)
    code = _number(v, "code")
    error = F.coalesce(~F.coalesce(F.try_variant_get(v, "$.error", "string"), F.lit("")).isin("", "false", "0"), F.lit(False))
    return error | ~F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False)) | F.coalesce(F.lower(_text(v, "status")) == "error", F.lit(False)) | F.coalesce(code >= 400, F.lit(False))


def local_asset(ticker, raw) -> dict[str, Column]:
    """Columns of an asset from the domestic provider's quote. A quote block that is missing is replaced by the market block
    and the other way round. Without an answer all but ``ok`` and ``ticker`` are null."""
    v, known = col(raw), ~failed(raw)
    q, m = _object(v, "quote", "market"), _object(v, "market", "quote")
    price = F.coalesce(_number(q, "price", "close"), _number(m, "close"), _number(v, "price", "close"))
    out = {
        "full_ticker": F.coalesce(_text(v, "ticker"), F.concat(F.lit("B3:"), col(ticker))),
        "symbol": F.coalesce(_text(v, "symbol"), col(ticker)),
        "name": _text(v, "name"),
        "full_name": _text(v, "full_name", "fullName"),
        "tax_id": _text(v, "tax_id"),
        "isin": _text(v, "isin"),
        "asset_type": _text(v, "kind", "type", "asset_type", "classification.kind", "classification.type"),
        "currency": F.coalesce(_text(v, "currency"), F.lit("BRL")),
        "shares_outstanding": _number(v, "shares_outstanding"),
        "sector": _text(v, "classification.sector", "sector", "segment", "subsector"),
        "subsector": _text(v, "classification.subsector", "subsector"),
        "segment": _text(v, "classification.segment", "segment"),
        "price": price,
        "change_value": _number(q, "change", "change_value"),
        "change_percent": _number(q, "change_percent", "percent_change", "changePercent"),
        "market_cap": _number(v, "market_cap", "marketCap"),
        "updated_at": F.coalesce(_text(q, "updated_at"), _text(m, "updated_at"), _text(v, "updated_at", "updatedAt")),
        "is_open": F.coalesce(F.try_variant_get(m, "$.is_open", "boolean"), F.try_variant_get(q, "$.is_open", "boolean")),
        "previous_close": F.coalesce(_number(q, "previous_close"), _number(m, "previous_close"), _number(v, "previous_close")),
        "open": F.coalesce(_number(q, "open"), _number(m, "open")),
        "close": F.coalesce(_number(q, "close"), _number(m, "close"), price),
        "high": F.coalesce(_number(q, "high"), _number(m, "high")),
        "low": F.coalesce(_number(q, "low"), _number(m, "low")),
        "volume": F.coalesce(_number(q, "volume"), _number(m, "volume"), _number(v, "volume")),
        "dividend_yield": _number(v, "dividends.yield_12m", "dividends.yield12mPercent", "dividends.yield_percent"),
        "dividend_cash": _number(v, "dividends.cash_12m", "dividends.yield_12m_cash", "dividends.yield_currency"),
    }
    return {"ok": known, "ticker": col(ticker), **{k: F.when(known, c) for k, c in out.items()}}


def foreign_asset(ticker, quote, profile) -> dict[str, Column]:
    """The same columns from the foreign provider's quote and profile; either may be missing or an error, and what it would
    have said is null then. Without a quote ``ok`` is false."""
    q, p = F.when(~failed(quote), col(quote)), F.when(~failed(profile), col(profile))
    known = q.isNotNull()
    out = {
        "full_ticker": col(ticker),
        "symbol": F.coalesce(_text(q, "symbol"), _text(p, "symbol"), col(ticker)),
        "name": F.coalesce(_text(q, "name"), _text(p, "name"), F.when(known, col(ticker))),
        "full_name": _text(p, "name"),
        "tax_id": F.lit(None).cast("string"),
        "isin": F.lit(None).cast("string"),
        "asset_type": _text(p, "type"),
        "currency": F.coalesce(_text(q, "currency"), F.when(known, "USD")),
        "shares_outstanding": F.lit(None).cast("double"),
        "sector": _text(p, "sector"),
        "subsector": _text(p, "industry"),
        "segment": F.lit(None).cast("string"),
        "price": _number(q, "close"),
        "change_value": _number(q, "change"),
        "change_percent": _number(q, "percent_change"),
        "market_cap": F.lit(None).cast("double"),
        "updated_at": _text(q, "datetime"),
        "is_open": F.try_variant_get(q, "$.is_market_open", "boolean"),
        "previous_close": _number(q, "previous_close"),
        "open": _number(q, "open"),
        "close": _number(q, "close"),
        "high": _number(q, "high"),
        "low": _number(q, "low"),
        "volume": _number(q, "volume"),
        "dividend_yield": F.lit(None).cast("double"),
        "dividend_cash": F.lit(None).cast("double"),
    }
    return {"ok": known, "ticker": col(ticker), **out}


#: Names of an indicator in the domestic provider's statement, the preferred one first.
LOCAL_INDICATORS = {
    "pe": ("valuation.price_to_earnings_ratio",),
    "pb": ("valuation.price_to_book_ratio",),
    "ev_ebitda": ("valuation.ev_to_ebitda",),
    "eps": ("valuation.earnings_per_share",),
    "book_value_per_share": ("valuation.book_value_per_share",),
    "gross_margin": ("margins.gross_profit_margin", "margins.gross_margin", "margins.gross_margin_percent", "margins.grossMargin", "margins.margem_bruta"),
    "operating_margin": ("margins.ebit_margin", "margins.operating_margin", "margins.operating_margin_percent", "margins.operatingMargin", "margins.margem_operacional"),
    "net_margin": ("margins.net_profit_margin", "margins.net_margin", "margins.net_margin_percent", "margins.profit_margin", "margins.netMargin", "margins.margem_liquida"),
    "roe": ("profitability.return_on_equity",),
    "roa": ("profitability.return_on_assets",),
    "current_ratio": ("leverage.current_ratio",),
    "debt_to_equity": ("leverage.debt_to_equity_ratio",),
    "ev_ebit": ("valuation.ev_to_ebit",),
    "price_to_ebitda": ("valuation.price_to_ebitda",),
    "price_to_fcf": ("valuation.price_to_free_cash_flow_ratio",),
    "ebitda_margin": ("margins.ebitda_margin", "margins.ebitda_margin_percent", "margins.ebitdaMargin", "margins.margem_ebitda"),
    "roic": ("profitability.return_on_invested_capital",),
    "roce": ("profitability.return_on_capital_employed",),
    "net_debt_to_ebitda": ("leverage.net_debt_to_ebitda_ratio",),
    "net_debt_to_ebit": ("leverage.net_debt_to_ebit_ratio",),
    "dividend_yield": ("dividends.yield_percent", "dividends.yieldPercent"),
    "dividend_cash": ("dividends.yield_currency", "dividends.yieldCurrency"),
}
#: Where the foreign provider's statistics hold an indicator, and those that it gives as a share of one.
FOREIGN_INDICATORS = {
    "pe": "valuations_metrics.trailing_pe",
    "pb": "valuations_metrics.price_to_book_mrq",
    "ev_ebitda": "valuations_metrics.enterprise_to_ebitda",
    "eps": "financials.income_statement.diluted_eps_ttm",
    "book_value_per_share": "financials.balance_sheet.book_value_per_share_mrq",
    "gross_margin": "financials.gross_margin",
    "operating_margin": "financials.operating_margin",
    "net_margin": "financials.profit_margin",
    "roe": "financials.return_on_equity_ttm",
    "roa": "financials.return_on_assets_ttm",
    "current_ratio": "financials.balance_sheet.current_ratio_mrq",
    "debt_to_equity": "financials.balance_sheet.total_debt_to_equity_mrq",
    "market_cap": "valuations_metrics.market_capitalization",
    "enterprise_value": "valuations_metrics.enterprise_value",
    "forward_pe": "valuations_metrics.forward_pe",
    "peg_ratio": "valuations_metrics.peg_ratio",
    "ps": "valuations_metrics.price_to_sales_ttm",
    "ev_revenue": "valuations_metrics.enterprise_to_revenue",
    "dividend_yield": "dividends_and_splits.trailing_annual_dividend_yield",
    "forward_dividend_yield": "dividends_and_splits.forward_annual_dividend_yield",
    "dividend_cash": "dividends_and_splits.trailing_annual_dividend_rate",
    "forward_dividend_cash": "dividends_and_splits.forward_annual_dividend_rate",
    "beta": "stock_price_summary.beta",
    "low_52_weeks": "stock_price_summary.fifty_two_week_low",
    "high_52_weeks": "stock_price_summary.fifty_two_week_high",
    "sma_50": "stock_price_summary.day_50_ma",
    "sma_200": "stock_price_summary.day_200_ma",
}
SHARES_OF_ONE = ("roe", "roa", "dividend_yield", "forward_dividend_yield")


def local_indicators(statement, dividend_yield=None, dividend_cash=None) -> dict[str, Column]:
    """Indicators from a nested statement. The asset's own dividends (columns) come before the statement's."""
    v = F.when(~failed(statement), col(statement))
    out = {k: _number(v, *paths) for k, paths in LOCAL_INDICATORS.items()}
    for k, own in (("dividend_yield", dividend_yield), ("dividend_cash", dividend_cash)):
        out[k] = out[k] if own is None else F.coalesce(col(own), out[k])
    return out


def foreign_indicators(answer) -> dict[str, Column]:
    """Indicators from nested statistics; returns and yields are in percent, like the domestic provider's."""
    v = F.when(~failed(answer), col(answer))
    return {k: _number(v, f"statistics.{p}") * (100 if k in SHARES_OF_ONE else 1) for k, p in FOREIGN_INDICATORS.items()}


#: Names of an entry's fields and of the collections, and what marks a classic model's label.
ENTRY = {
    "label": ("c", "camada", "modelo", "metodo", "nome", "titulo"),
    "value": ("vj", "valor_justo", "preco_justo", "preco", "valor", "resultado"),
    "methodology": ("met", "metodologia", "descricao", "calculo"),
    "premises": ("prem", "premissas", "observacao", "nota"),
}
EMBEDDED = ("preco", "modelo_preco")
CLASSICS = ("valuations_classicos", "valuation_classicos", "valuationsClassicos", "classic_valuations", "valuation_classico")
CLASSIC = "(?i)buffett|lynch|graham|bazin|cl[aáÁ]ssic"


def _scalar(v: Column) -> Column:
    """A text or number as trimmed text; '' for anything else."""
    kind = F.schema_of_variant(v)
    return F.coalesce(F.when((kind == "STRING") | kind.rlike("^(BIGINT|DECIMAL|DOUBLE)"), F.trim(F.try_variant_get(v, "$", "string"))), F.lit(""))


def _given(v: Column, key: str) -> Column:
    x = F.try_variant_get(v, f"$.{key}", "variant")
    return F.when(~F.is_variant_null(x), x)


def _entries(text: Column) -> Column:
    """array<(at, key, v)> of a collection's JSON text: of an array without keys, of an object in the text's own order."""
    v = F.try_parse_json(text)
    items = F.transform(F.try_variant_get(v, "$", "array<variant>"), lambda x, i: F.struct(i.alias("at"), F.lit("").alias("key"), x.alias("v")))
    held = F.try_variant_get(v, "$", "map<string, variant>")
    named = F.transform(F.json_object_keys(text), lambda k, i: F.struct(i.alias("at"), k.alias("key"), F.element_at(held, k).alias("v")))
    return F.coalesce(items, named)


def price_models(df: DataFrame, key: str, text: str, classic: bool = True) -> DataFrame:
    """(key, kind, at, label, value, methodology, premises): one row an entry of the price models in a result's JSON text.

    The models stand in an array or an object; an entry is a text or number (its value), or an object whose fields have
    several names (the first that isn't null counts; one that is neither text nor number is ''). Without a name the label is
    the object's key, else 'Valuation' and its place. kind: classic by the label, or layer. With ``classic`` the separate
    collections of classic models follow, and of equal classic (label, value), but for case, the first stays; without, only
    layers. Null and empty entries, and texts that are no JSON, give no rows.
    """
    t = F.col(text)
    groups = [F.coalesce(*[F.get_json_object(t, f"$.{k}") for k in EMBEDDED])] + ([F.get_json_object(t, f"$.{k}") for k in CLASSICS] if classic else [])
    sources = F.array(*[F.struct(F.lit(n).alias("source"), g.alias("body")) for n, g in enumerate(groups)])
    bodies = df.select(key, F.inline(sources)).where("body IS NOT NULL")
    rows = bodies.select(key, "source", F.inline(_entries(F.col("body")))).where("v IS NOT NULL AND NOT is_variant_null(v)")
    v, kind = F.col("v"), F.schema_of_variant("v")
    plain = ~kind.startswith("OBJECT")
    field = lambda name: F.coalesce(*[_given(v, k) for k in ENTRY[name]])
    label = F.when(plain, F.lit("")).otherwise(F.when(field("label").isNotNull(), _scalar(field("label"))).otherwise(F.trim("key")))
    label = F.when(plain, F.col("key")).otherwise(label)
    label = F.when(label == "", F.concat(F.lit("Valuation "), F.col("at") + 1)).otherwise(label)
    rows = rows.where(~((kind == "STRING") & (F.try_variant_get(v, "$", "string") == ""))).select(
        key, "source", "at", label.alias("label"), F.when(plain, _scalar(v)).otherwise(_scalar(field("value"))).alias("value"),
        *[F.when(plain, F.lit("")).otherwise(_scalar(field(k))).alias(k) for k in ("methodology", "premises")],
    )
    rows = rows.withColumn("kind", F.when((F.col("source") > 0) | F.col("label").rlike(CLASSIC), "classic").otherwise("layer"))
    if not classic:
        return rows.where("kind = 'layer'").drop("source")
    same = Window.partitionBy(key, "kind", F.lower(F.concat_ws("|", "label", "value"))).orderBy("source", "at")
    return rows.withColumn("_r", F.row_number().over(same)).where("kind = 'layer' OR _r = 1").drop("_r", "source")


#: What makes a conclusion a justification (accents and case apart), and a gap one on the nominal test.
JUSTIFIES = "porque|apesar|justific|risco|premissa|catalis|assimetr|nao supera|inferior|soberan|hurdle"
NOMINAL_GAP = r"\btdn\b|teste de defesa nominal|defesa nominal"


def integrity_flags(phase, status, conclusion, least: int, requires_justification=None) -> dict[str, Column]:
    """Whether a module's conclusion is wanted, there and justified. It is wanted in the deep phase of a module that is ok,
    and is there from ``least`` characters on; a justification, where wanted, has 36 of them and a word that gives reasons."""
    text = F.coalesce(F.trim(col(conclusion)), F.lit(""))
    required = F.coalesce((col(phase) == "deep") & (col(status) == "ok"), F.lit(False))
    present = F.length(text) >= least
    out = {"conclusion": F.nullif(text, F.lit("")), "conclusion_required": required, "conclusion_present": present}
    if requires_justification is None:
        return out | {"complete": ~required | present}
    wanted = required & F.coalesce(col(requires_justification), F.lit(False))
    justified = ~wanted | ((F.length(text) >= 36) & plain_text(text).rlike(JUSTIFIES))
    return out | {"justification_required": wanted, "justification_present": justified, "complete": ~required | (present & justified)}


def without_nominal_gaps(gaps, status) -> Column:
    """The gaps (array of texts), without those on the nominal test where that test isn't applicable; null stays null."""
    return F.when(F.coalesce(col(status) == "not_applicable", F.lit(False)), F.filter(col(gaps), lambda g: ~F.coalesce(plain_text(g).rlike(NOMINAL_GAP), F.lit(False)))).otherwise(col(gaps))
