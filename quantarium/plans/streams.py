"""Queries that run a stream over a table's files to the end and return what it made."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..fixtures import table
from ..sources.shared import new_dir
from ..streaming import forms
from ..streaming.tables import BatchTable
from .registry import query, r4


def _events(spark, d):
    schema = spark.read.parquet(f"{d}/events.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events*.parquet").parquet(d).withColumn("ts", F.col("ts").cast("timestamp"))


def _run(df, mode):
    root = new_dir(df.sparkSession, "stream")
    if mode == "complete":
        return forms.whole_to(df, BatchTable(df.sparkSession, f"{root}/table"), f"{root}/checkpoint")
    return forms.append_to(df, f"{root}/out", f"{root}/checkpoint")


@query("stream_candle_rollup", f"SELECT user_id AS ticker, CAST(ts AS DATE) AS date, arg_min(value, ts) AS open, max(value) AS high, min(value) AS low, arg_max(value, ts) AS close, {r4('sum(1.0)')} AS volume FROM events GROUP BY 1, 2")
def stream_candle_rollup(spark, d):
    ticks = _events(spark, d).select(F.col("user_id").alias("ticker"), "ts", F.col("value").alias("price"), F.lit(1.0).alias("volume"))
    return _run(forms.candle_rollup(ticks), "complete")


@query("stream_dedup_documents", "SELECT count(*) AS n FROM (SELECT DISTINCT event_id FROM events)")
def stream_dedup(spark, d):
    e = _events(spark, d).select(F.col("event_id").alias("dedup_key"), "ts")
    return _run(forms.dedup_documents(e.unionByName(_events(spark, d).select(F.col("event_id").alias("dedup_key"), "ts")), "60 days"), "append").groupBy().agg(F.count("*").alias("n"))


@query("stream_change_points", "SELECT user_id AS series, ts, value, before FROM (SELECT user_id, ts, floor(value / 10) AS value, lag(floor(value / 10)) OVER (PARTITION BY user_id ORDER BY ts) AS before FROM events) WHERE value <> before")
def stream_change_points(spark, d):
    return _run(forms.change_points(_events(spark, d).select(F.col("user_id").alias("series"), "ts", F.floor(F.col("value") / 10).cast("double").alias("value"))), "append")


@query("stream_freshness", "SELECT event_type AS source, max(ts) AS newest, count(*) AS n FROM events GROUP BY 1")
def stream_freshness(spark, d):
    return _run(forms.freshness(_events(spark, d).withColumnRenamed("event_type", "source")), "complete")


#: Fixed: the parts of the events that come as batches of their own, by the end of their days.
_SLICES = ("2024-01-08", "2024-01-15", "2024-01-22", "2100-01-01")
_PIT = "user_id long, event_type string, value double, ts timestamp"


@query("stream_pit_merge", """WITH s AS (SELECT user_id, event_type, value, ts, event_id, CASE WHEN ts < TIMESTAMP '{0}' THEN 0 WHEN ts < TIMESTAMP '{1}' THEN 1 WHEN ts < TIMESTAMP '{2}' THEN 2 ELSE 3 END AS part FROM events),
 f AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY user_id, event_type, part ORDER BY ts, event_id) = 1),
 o AS (SELECT *, first_value(value) OVER (PARTITION BY user_id, event_type ORDER BY part) AS kept, first_value(ts) OVER (PARTITION BY user_id, event_type ORDER BY part) AS seen_at FROM f)
 SELECT user_id, event_type, kept AS value, seen_at AS ts, count(DISTINCT value) FILTER (value IS DISTINCT FROM kept) AS revisions FROM o GROUP BY 1, 2, 3, 4""".format(*_SLICES))
def stream_pit_merge(spark, d):
    """Four batches, the stream restarted before each; then the last batch once more."""
    root = new_dir(spark, "pit")
    store, began = BatchTable(spark, f"{root}/table"), "1900-01-01"
    merge = forms.pit_log(store, _PIT, ["user_id", "event_type"], ["value"], ["ts", "event_id"])
    events = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    for end in _SLICES:
        events.where((F.col("ts") >= F.lit(began)) & (F.col("ts") < F.lit(end))).write.mode("append").parquet(f"{root}/in")
        incoming = spark.readStream.schema(events.schema).parquet(f"{root}/in")
        incoming.writeStream.foreachBatch(merge).option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start().awaitTermination()
        began = end
    merge(events, len(_SLICES) - 1)
    revised = store.read("revisions", "user_id long, event_type string, new_value double").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    rows = store.read("rows", _PIT).join(revised, ["user_id", "event_type"], "left")
    return rows.select("user_id", "event_type", "value", "ts", F.coalesce("n", F.lit(0)).alias("revisions"))
