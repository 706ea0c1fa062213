"""Goldens of providers' rows, price models and conclusions."""

from pyspark.sql import functions as F

from quantarium.operators import profiles as P


def _one(spark, columns, **texts):
    df = spark.createDataFrame([tuple(texts.values())], ", ".join(f"{k} string" for k in texts))
    df = df.select(*[F.col(k) if k in ("t", "s", "c") else F.try_parse_json(k).alias(k) for k in texts])
    return df.select(*[c.alias(k) for k, c in columns.items()]).head().asDict()


def test_answers_that_are_none(spark):
    texts = [None, "null", "[1]", "no json", '{"status":"ERROR"}', '{"code":"429"}', '{"error":{"m":1}}', ""]
    df = spark.createDataFrame([("ABC", t) for t in texts], "t string, v string").select("t", F.try_parse_json("v").alias("v"))
    for row in df.select(*[c.alias(k) for k, c in P.local_asset("t", "v").items()]).collect():
        row = row.asDict()
        assert row.pop("ok") is False and row.pop("ticker") == "ABC" and set(row.values()) == {None}
    row = _one(spark, P.local_asset("t", "v"), t="ABC", v='{"error":false,"code":200}')
    assert row["ok"] and row["full_ticker"] == "B3:ABC" and row["currency"] == "BRL" and row["price"] is None


def test_preferred_names(spark):
    row = _one(spark, P.local_asset("t", "v"), t="A", v='{"quote":{"price":"","close":0},"market":{"close":9,"volume":"1,5"},"marketCap":2,"type":"x"}')
    assert (row["price"], row["close"], row["volume"], row["market_cap"], row["asset_type"]) == (0.0, 0.0, 1.5, 2.0, "x")
    row = _one(spark, P.foreign_asset("t", "q", "p"), t="A", q=None, p='{"sector":"S","name":"N"}')
    assert row["ok"] is False and row["sector"] == "S" and row["name"] == "N" and row["price"] is None and row["currency"] is None


def test_indicators(spark):
    row = _one(spark, P.foreign_indicators("v"), v='{"statistics":{"financials":{"return_on_assets_ttm":0.5},"stock_price_summary":{"beta":"1.25"}}}')
    assert row["roa"] == 50 and row["beta"] == 1.25 and row["roe"] is None
    row = _one(spark, P.local_indicators("v", dividend_yield=F.lit(None).cast("double")), v='{"dividends":{"yield_percent":"3"},"margins":{"margem_ebitda":"8,5"}}')
    assert row["dividend_yield"] == 3 and row["ebitda_margin"] == 8.5
    assert set(_one(spark, P.local_indicators("v"), v=None).values()) == {None}


def test_price_models(spark):
    rows = [
        (1, '{"preco":{"b":5,"a":{"c":null,"camada":" X ","vj":{"no":1},"valor":3}},"classic_valuations":["7",{"nome":"Lynch","valor":1},{"nome":"LYNCH","preco":1}]}'),
        (2, '{"preco":[true,[1],{}]}'), (3, "no json"), (4, None), (5, '{"preco":"text"}'),
    ]
    df = spark.createDataFrame(rows, "id int, body string")
    got = sorted((r.id, r.kind, r["at"], r.label, r.value) for r in P.price_models(df, "id", "body").collect())
    assert got == [
        (1, "classic", 0, "Valuation 1", "7"), (1, "classic", 1, "Lynch", "1"), (1, "layer", 0, "b", "5"), (1, "layer", 1, "X", ""),
        (2, "layer", 0, "Valuation 1", ""), (2, "layer", 1, "Valuation 2", ""), (2, "layer", 2, "Valuation 3", ""),
    ]
    assert P.price_models(df, "id", "body", classic=False).where("kind = 'classic'").count() == 0


def test_conclusions(spark):
    flags = P.integrity_flags(F.lit("deep"), F.lit("ok"), "c", 20, F.lit(True))
    assert not _one(spark, flags, c=None)["complete"] and not _one(spark, flags, c="Risco")["complete"]
    assert _one(spark, flags, c="Não supera o soberano, e por isso não entra na carteira.")["complete"]
    assert not _one(spark, flags, c="Uma conclusão longa que nada explica de fato aqui.")["justification_present"]
    df = spark.createDataFrame([(["x TDN", "xtdn", None], "not_applicable"), (None, "not_applicable"), (["TDN"], None)], "g array<string>, s string")
    assert [r[0] for r in df.select(P.without_nominal_gaps("g", "s")).collect()] == [["xtdn", None], None, ["TDN"]]
