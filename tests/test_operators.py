"""Goldens of single operators."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from quantarium.functions import columns as C
from quantarium.operators import documents as D
from quantarium.operators import joins as J
from quantarium.operators import metrics as M
from quantarium.operators import models as Q
from quantarium.operators import pit as P

DAY = dt.date(2026, 1, 1)


def one(spark, column):
    return spark.range(1).select(column.alias("x")).head().x


@pytest.mark.parametrize(("text", "value"), [("1.234,56", 1234.56), ("(12,5)", -12.5), ("-3", -3.0), ("--", None), ("-", None), ("abc", None), ("1.234", 1234.0), ("", None), ("R$ 7,10", 7.1)])
def test_parse_number_br(spark, text, value):
    assert one(spark, C.parse_number_br(F.lit(text))) == value


@pytest.mark.parametrize(("text", "value"), [("1.234,5", 1234.5), ("1,234.5", 1234.5), ("12", 12.0), ("x", None)])
def test_parse_localized_number(spark, text, value):
    assert one(spark, C.parse_localized_number(F.lit(text))) == value


def test_rounding_and_numbers(spark):
    assert one(spark, C.round_half_up(F.lit(-2.5))) == -2.0
    assert one(spark, C.round_half_up(F.lit(2.5))) == 3.0
    assert one(spark, C.to_number(F.lit(" "))) is None
    assert one(spark, C.pct_change(F.lit(1.0), F.lit(0.0))) is None


def test_dates(spark):
    assert one(spark, C.date_br(F.lit("31/02/2001"))) is None
    assert one(spark, C.date_br(F.lit("28/02/2001"))) == dt.date(2001, 2, 28)
    friday, monday = F.lit("2026-01-02").cast("date"), F.lit("2026-01-05").cast("date")
    assert one(spark, C.business_days_between(friday, monday)) == 1
    assert one(spark, C.business_days_between(monday, friday)) is None


@pytest.mark.parametrize(("url", "ok"), [("https://example.com/a", True), ("http://example.com", False), ("https://192.168.1.1/", False), ("https://8.8.8.8/", True), ("https://u:p@example.com", False), ("https://localhost", False), (None, False)])
def test_public_url(spark, url, ok):
    assert one(spark, C.is_public_https(F.lit(url).cast("string"))) is ok


def test_asof_and_bracket(spark):
    s = spark.createDataFrame([("a", DAY, 1.0), ("a", DAY + dt.timedelta(9), 2.0), ("a", DAY + dt.timedelta(3), None)], "key string, date date, value double")
    t = spark.createDataFrame([("a", DAY + dt.timedelta(5)), ("a", DAY - dt.timedelta(1)), ("b", DAY)], "key string, at date")
    got = {(r.key, r["at"]): r.found_value for r in J.asof_latest(t, s, "key").collect()}
    assert got == {("a", DAY + dt.timedelta(5)): 1.0, ("a", DAY - dt.timedelta(1)): None, ("b", DAY): None}
    near = {(r.key, r["at"]): r.found_value for r in J.asof_nearest(t, s, "key", 3).collect()}
    assert near[("a", DAY - dt.timedelta(1))] == 1.0 and near[("a", DAY + dt.timedelta(5))] is None
    curve = spark.createDataFrame([(DAY, 1.0, 5.0), (DAY, 3.0, 7.0)], "data_ref date, vertex double, rate double")
    inv = spark.createDataFrame([(1, 9.0, 0.5), (2, 9.0, 2.0), (3, 9.0, 3.0), (4, 9.0, 4.0), (5, None, 1.0)], "id int, irr double, horizon double")
    r = {x.id: (x.status, x.hurdle) for x in Q.hurdle_alpha(inv, curve).collect()}
    assert r == {1: ("floor", 5.0), 2: ("interpolated", 6.0), 3: ("exact", 7.0), 4: ("out_of_curve", None), 5: ("missing_input", None)}


def test_split_engine(spark):
    rows = [(t, DAY + dt.timedelta(k), c) for t, ratio in (("ok", 1.0), ("split", 2.0), ("odd", 6.5)) for k in range(60) for c in [(100.0 + k % 5) / (ratio if k >= 30 else 1.0)]]
    c = spark.createDataFrame(rows, "ticker string, date date, close double").select("*", *[F.col("close").alias(x) for x in ("open", "high", "low")], F.lit(10.0).alias("volume"))
    got = {r.ticker: r.status for r in Q.split_engine(c).collect()}
    assert got == {"ok": "clean", "split": "adjusted", "odd": "rejected_jump"}
    adj = Q.split_adjust(c, M.detect_jumps(c).where("status = 'accepted'")).where("ticker = 'split'").agg(F.max("close"), F.max("volume"), F.min("volume")).head()
    assert adj[0] < 60 and adj[1] == pytest.approx(20) and adj[2] == pytest.approx(10)


def test_merges_are_idempotent(spark):
    old = spark.createDataFrame([(1, 5.0), (2, None)], "k int, v double")
    new = spark.createDataFrame([(1, 6.0), (2, None), (3, 1.0)], "k int, v double")
    rows, revisions = P.pit_merge_first_wins(old, new, ["k"], ["v"])
    assert sorted((r.k, r.v) for r in rows.where("v IS NOT NULL").collect()) == [(1, 5.0), (3, 1.0)] and [r.k for r in revisions.collect()] == [1]
    again, _ = P.pit_merge_first_wins(rows, new, ["k"], ["v"])
    assert again.exceptAll(rows).count() == rows.exceptAll(again).count() == 0
    assert {r.k: r.v for r in P.upsert(old, new, ["k"]).collect()} == {1: 6.0, 2: None, 3: 1.0}


def test_ttm(spark):
    f = spark.createDataFrame([("c", 2024, 3, 10.0, DAY), ("c", 2024, 12, 50.0, DAY), ("c", 2025, 3, 12.0, DAY), ("d", 2025, 3, 1.0, DAY)], "company string, fiscal_year int, months int, ytd double, available_at date")
    got = {(r.company, r.fiscal_year, r.months): (r.ttm, r.status) for r in P.ttm(f).collect()}
    assert got[("c", 2025, 3)] == (52.0, "ok") and got[("d", 2025, 3)] == (None, "sem_ytd_anterior") and got[("c", 2024, 12)] == (50.0, "ok")


def test_html_and_json(spark):
    assert one(spark, D.html_to_text(F.lit("<p>a &amp; b<br>c</p><script>x()</script><p>d</p>"))) == "a & b\nc\nd"
    assert one(spark, D.json_from_text(F.lit('say ```json {"a": [1,],} ``` end'))) == '{"a": [1]}'
    assert one(spark, D.json_from_text(F.lit("none"))) is None
