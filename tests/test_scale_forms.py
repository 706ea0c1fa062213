"""Operators whose groups are split, against plain loops: one hot key must not be one task."""

import datetime as dt
import random

from pyspark.sql import functions as F

from quantarium.operators import joins as J
from quantarium.operators.sums import running_sum

DAY = dt.date(2020, 1, 1)


def test_running_sum(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["hot"] * 8 + ["a", None]), rng.randint(-500, 500) * 7919, rng.choice([None, 1, 2, 3, 10])) for _ in range(3000)]
    rows = list({(g, k): (g, k, v) for g, k, v in rows}.values()) + [("hot", None, 5), ("x", 10**15, 4)]
    want, sums = {}, {}
    for g, k, v in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0)):
        want[(g, k)] = sums.get(g, 0)
        sums[g] = sums.get(g, 0) + (v or 0)
    df = spark.createDataFrame(rows, "g string, k long, v long")
    for ranges in (1, 2, 64):
        assert {(r.g, r.k): r.before for r in running_sum(df, "g", "k", "v", ranges=ranges).collect()} == want
    assert running_sum(df.limit(0), "g", "k", "v").count() == 0
    groups = running_sum(df.withColumn("one", F.lit("same")), "one", "k", "v", ranges=16)
    window = [line for line in groups._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Window" in line and "_inside" in line]
    assert window and all("_part" in line for line in window)  # no window over a whole group


def test_event_boundary_rows_around(spark):
    rng = random.Random(2)
    candles = [(t, DAY + dt.timedelta(days=k), None if rng.random() < 0.2 else float(k)) for t in "ab" for k in range(0, 900, 3)] + [("c", DAY, 1.0)]
    events = [(t, DAY + dt.timedelta(days=k)) for t in "abcz" for k in (-5, 0, 1, 90, 450, 899, 5000)] + [("a", DAY)]
    got = {(r.ticker, r.boundary): r for r in J.event_boundary(spark.createDataFrame(events, "ticker string, boundary date"), spark.createDataFrame(candles, "ticker string, date date, close double")).collect()}
    assert {t for t, _ in got} == set("abc") and len(got) == 21
    for (t, at), r in got.items():
        own = sorted((d, c) for x, d, c in candles if x == t and c is not None)
        before, after = [x for x in own if x[0] < at], [x for x in own if x[0] >= at]
        assert (r.n_before, r.n_after) == (len(before), len(after))
        assert (r.before_date, r.before_close) == (before[-1] if before else (None, None)) and (r.after_date, r.after_close) == (after[0] if after else (None, None))
        assert [tuple(x) for x in r.around] == ([*before[-4:], *after[:5]] if after else [])


def test_best_text_match_by_rare_words(spark):
    rng = random.Random(3)
    words = [f"w{k}" for k in range(60)]
    draw = lambda n: sorted(set(rng.choices(words, weights=[1 / (k + 1) for k in range(60)], k=n)))
    expected = [(k, draw(rng.randint(0, 12))) for k in range(60)] + [(99, ["none", "such"])]
    cands = [(k, draw(rng.randint(0, 30))) for k in range(150)]
    score = lambda a, b: len(set(a) & set(b)) / min(len(a), len(b)) if a and b else 0
    for least in (0.2, 0.5, 1.0):
        want = {}
        for i, a in expected:
            best = max(((score(a, b), -c) for c, b in cands), default=(0, 0))
            if best[0] >= least - 1e-9 and best[0] > 0:
                want[i] = (-best[1], round(best[0], 9))
        got = J.best_text_match(spark.createDataFrame(expected, "id long, tokens array<string>"), spark.createDataFrame(cands, "cand long, tokens array<string>"), least)
        assert {r.id: (r.cand, round(r.score, 9)) for r in got.collect()} == want


def test_asof_latest_of_a_hot_key(spark):
    """Targets that share key and day, null keys and days, extra columns."""
    targets = [("s", DAY, k) for k in range(500)] + [("s", None, -1), (None, DAY, -2), ("s", DAY + dt.timedelta(days=400), -3), ("t", DAY, -4)]
    series = [("s", DAY - dt.timedelta(days=200), 1.0), ("s", DAY, None), ("s", DAY + dt.timedelta(days=1), 2.0), (None, DAY, 3.0)]
    got = J.asof_latest(spark.createDataFrame(targets, "k string, at date, id long"), spark.createDataFrame(series, "k string, date date, value double"), "k").collect()
    found = {r.id: r.found_value for r in got}
    assert len(got) == len(targets) and all(found[k] == 1.0 for k in range(500)) and (found[-2], found[-3], found[-4]) == (3.0, 2.0, None)
