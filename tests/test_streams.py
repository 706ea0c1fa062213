"""Streams that write tables: restarts, repeated and killed batches."""

import datetime as dt

import pytest

from quantarium.streaming import forms
from quantarium.streaming.tables import BatchTable

ROWS = "k int, v double"


@pytest.fixture
def table(spark, tmp_path):
    return BatchTable(spark, f"file://{tmp_path}/table")


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


def test_batches_count_once(spark, table):
    merge = forms.pit_log(table, ROWS, ["k"], ["v"], ["v"])
    batch = lambda *rows: spark.createDataFrame(list(rows), ROWS)
    revisions = "k int, v double, new_v double"
    assert rows_of(table.read("rows", ROWS)) == []
    for _ in range(2):  # the same batch twice
        merge(batch((1, 5.0), (1, 6.0), (2, 1.0), (3, None)), 0)
    assert rows_of(table.read("rows", ROWS).where("v IS NOT NULL")) == [(1, 5.0), (2, 1.0)] and table.read("rows", ROWS).count() == 3
    folder = table.write({"rows": batch((9, 9.0)), "revisions": spark.createDataFrame([], revisions)})  # killed before its line in the log
    assert table.read("rows", ROWS).where("k = 9").count() == 0
    merge(batch((1, 7.0), (2, 1.0), (4, 2.0), (3, 1.0)), 1)
    merge(batch((1, 7.0), (1, 8.0), (4, 2.0)), 2)  # a revision that is known
    assert rows_of(table.read("rows", ROWS).where("k <> 3")) == [(1, 5.0), (2, 1.0), (4, 2.0)]
    assert sorted(map(repr, rows_of(table.read("revisions", revisions)))) == ["(1, 5.0, 7.0)", "(3, None, 1.0)"]
    assert folder not in {c.folder for c in table.commits()} and [c.batch_id for c in table.commits()] == [0, 1, 2]


def test_change_points_go_on_after_a_stop(spark, tmp_path):
    """A stopped and restarted stream gives the rows of one that ran through, and no row twice."""
    schema = "series long, ts timestamp, value double"
    at = lambda k: dt.datetime(2026, 1, 1) + dt.timedelta(hours=k)
    parts = [[(1, at(0), 1.0), (2, at(0), 5.0), (1, at(1), 1.0), (1, at(2), None)], [(1, at(3), 2.0), (2, at(1), 5.0)], [(1, at(5), 1.0), (1, at(4), 2.0), (2, at(2), 6.0)]]
    source, found = f"file://{tmp_path}/in", None
    for part in [*parts, []]:
        if part:
            spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(source)
        changes = forms.change_points(spark.readStream.schema(schema).parquet(source))
        found = forms.append_to(changes, f"file://{tmp_path}/out", f"file://{tmp_path}/checkpoint")
    assert rows_of(found) == [(1, at(3), 2.0, 1.0), (1, at(5), 1.0, 2.0), (2, at(2), 6.0, 5.0)]
