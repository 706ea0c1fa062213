"""Structured Streaming forms. Each keeps its batch operator's meaning on inputs that grow."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.pit import first_wins_delta, pit_merge_first_wins
from .tables import BatchTable


def candle_rollup(ticks: DataFrame, late: str = "1 day") -> DataFrame:
    """Daily candles of ticks (ticker, ts, price, volume) by event time."""
    return ticks.where("price IS NOT NULL").withWatermark("ts", late).groupBy(F.window("ts", "1 day"), "ticker").agg(
        F.min_by("price", "ts").alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", "ts").alias("close"), F.sum(F.coalesce("volume", F.lit(0.0))).alias("volume")
    ).select("ticker", F.to_date("window.start").alias("date"), "open", "high", "low", "close", "volume")


def dedup_documents(docs: DataFrame, late: str = "7 days", key: str = "dedup_key", ts: str = "ts") -> DataFrame:
    """The first row of each key; state goes with the watermark."""
    return docs.withWatermark(ts, late).dropDuplicatesWithinWatermark([key])


def pit_merge(read_stored: Callable[[], DataFrame], write_stored: Callable[[DataFrame, int], None], keys: list[str], fields: list[str]) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: the first-wins merge. The table is the state, so a batch that runs again adds nothing."""

    def merge(batch: DataFrame, batch_id: int) -> None:
        one = batch.dropDuplicates(keys)
        write_stored(pit_merge_first_wins(read_stored(), one, keys, fields)[0], batch_id)

    return merge


def pit_log(table: BatchTable, schema: str, keys: list[str], fields: list[str], order: list[str]) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: the first-wins merge into ``table``, whose frames are rows and revisions.

    Per key of a batch its first row by ``order`` counts. New keys are added; a known key whose fields differ is a revision
    (keys, fields, new_..), added once however often it is seen. Stored rows are never written again.
    """
    revision = f"{schema_of(schema, keys + fields)}, {', '.join(f'new_{f} {_type_of(schema, f)}' for f in fields)}"

    def merge(batch: DataFrame, batch_id: int) -> None:
        if table.has(batch_id):
            return
        first = batch.groupBy(*keys).agg(F.min_by(F.struct(*batch.columns), F.struct(*order)).alias("_r")).select("_r.*").persist()
        try:
            adds, differ = first_wins_delta(table.read("rows", schema), first, keys, fields)
            known = table.read("revisions", revision)
            same = [differ[c].eqNullSafe(known[c]) for c in known.columns]
            table.commit(batch_id, {"rows": adds, "revisions": differ.join(known, same, "left_anti")})
        finally:
            first.unpersist()

    return merge


def _type_of(schema: str, name: str) -> str:
    return next(t for n, t in (c.split() for c in schema.split(", ")) if n == name)


def schema_of(schema: str, names: list[str]) -> str:
    return ", ".join(f"{n} {_type_of(schema, n)}" for n in names)


def _changes(key, frames, state: GroupState):
    if state.hasTimedOut:
        state.remove()
        return
    own = pd.concat(list(frames), ignore_index=True).dropna(subset=["value"]).sort_values("ts", kind="stable")
    if len(own):
        before = own["value"].shift(1)
        if state.exists:
            before.iloc[0] = state.get[0]
        state.update((float(own["value"].iloc[-1]),))
        state.setTimeoutTimestamp(int(own["ts"].iloc[-1].timestamp() * 1000) + 1)
        new = before.notna() & (before != own["value"])
        yield pd.DataFrame({"series": key[0], "ts": own["ts"], "value": own["value"], "before": before})[new]


def change_points(observations: DataFrame, late: str = "400 days") -> DataFrame:
    """Rows at which a step series (series, ts, value) takes a new value; the state is one value a series, which goes when the
    watermark, ``late`` behind the newest row, passes the series' last one. A batch's rows of one series are sorted in one
    task. (Timeouts by processing time would keep a run to the end of what is there from ending.)"""
    schema = "series long, ts timestamp, value double, before double"
    return observations.withWatermark("ts", late).groupBy("series").applyInPandasWithState(_changes, schema, "last double", "append", GroupStateTimeout.EventTimeTimeout)


def append_to(df: DataFrame, out: str, checkpoint: str, **options):
    """Run ``df`` to the end of what is there, into Parquet files under ``out`` with their own commit log; nothing passes
    through the driver. Run again with the same folders, it goes on where it stopped."""
    writer = df.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True)
    writer.start().awaitTermination()
    return df.sparkSession.read.schema(df.schema).parquet(out)


def whole_to(df: DataFrame, table: BatchTable, checkpoint: str) -> DataFrame:
    """Run an aggregation to the end of what is there; each batch's whole result is a batch of ``table``, the last one counts."""
    writer = df.writeStream.foreachBatch(lambda batch, n: table.commit(n, {"rows": batch})).option("checkpointLocation", checkpoint).outputMode("complete").trigger(availableNow=True)
    writer.start().awaitTermination()
    return table.read("rows", df.schema, last=True)


def freshness(rows: DataFrame, source: str = "source", ts: str = "ts") -> DataFrame:
    """Newest time of each source; rows dated after now are refused."""
    return rows.where(F.col(ts) <= F.current_timestamp()).groupBy(source).agg(F.max(ts).alias("newest"), F.count("*").alias("n"))
