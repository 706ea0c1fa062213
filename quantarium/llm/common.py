"""Shared pieces of the text operators: the shared folder, written intermediate tables and normalised inputs."""

from __future__ import annotations

import atexit
import contextlib
import functools
import tempfile
import uuid

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed value: the six ASCII white-space characters that separate words, as a Java and Python pattern.
SPACE = r"[\x20\x09-\x0D]+"

_OWN_DIR: list[str] = []
_MADE: dict[str, str] = {}  # intermediate tables so far, and what they belong to
_OWNER: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from spark.checkpoint.dir. Where that is unset, a local one if driver and executors
    are one process (tests), else an error: executors would write to their own disks."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if where:
        return where.rstrip("/")
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _OWN_DIR:
        _OWN_DIR.append(tempfile.mkdtemp(prefix="spark-"))
    return "file://" + _OWN_DIR[0]


def _forget(spark: SparkSession, path: str, table: str | None = None) -> None:
    with contextlib.suppress(Exception):
        if table:
            spark.sql(f"DROP TABLE IF EXISTS {table}")
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def stored(df: DataFrame, name: str, compression: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    This cuts the lineage and keeps a lost executor from recomputing the rows. The files go when the driver's
    Python ends, because the returned frame is lazy and still needs them.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/llm-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=compression)
    atexit.register(_forget, spark, path)
    _MADE[path] = _OWNER[-1] if _OWNER else ""
    return spark.read.schema(df.schema).parquet(path)


def stored_by(df: DataFrame, name: str, key: str) -> DataFrame:
    """As :func:`stored`, in buckets of ``key``, as many as there are shuffle partitions: what is joined by ``key`` later is
    not shuffled again. The session's catalog knows the files by a name of their own until the driver's Python ends."""
    spark = df.sparkSession
    table = f"llm_{name}_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/{table}"
    df.write.bucketBy(parts(spark), key).option("path", path).option("compression", "zstd").saveAsTable(table)
    atexit.register(_forget, spark, path, table)
    _MADE[path] = _OWNER[-1] if _OWNER else ""
    return spark.table(table)


#: Documented bound: bytes of the batches of rows that small_batches sends to Python at a time; a larger row goes alone.
BATCH_BYTES = 8 << 20


@contextlib.contextmanager
def small_batches(spark: SparkSession):
    """Jobs inside send texts to Python in batches of 8 MB at most, not of 10,000 rows whatever their length: a worker holds
    a batch several times over (as sent, as strings, as results)."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(BATCH_BYTES))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def gives_back(step):
    """A step over batches at whose end the worker gives the memory of the batches it has let go back to the system: Spark
    keeps workers for a minute, and Arrow's pool keeps what it freed (70 of 210 MB behind 49 MB of texts)."""

    @functools.wraps(step)
    def run(batches, *args, **kw):
        try:
            yield from step(batches, *args, **kw)
        finally:
            pa.default_memory_pool().release_unused()

    return run


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id long, text) of every row; a null text is empty. Other columns, whatever their names, are left out."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


#: Documented bound: bits of an id filter, 2 MB whatever the number of ids. A fuller filter only passes more rows.
FILTER_BITS = 1 << 24


def _id_bits(ids: np.ndarray) -> list[np.ndarray]:
    z = ids.astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    z ^= z >> np.uint64(32)
    z *= np.uint64(0xD6E8FEB86659FD93)
    return [(z >> np.uint64(shift)) & np.uint64(FILTER_BITS - 1) for shift in (40, 16)]


def _word_batches(batches):
    for b in batches:
        ids = b.column(0).drop_null().to_numpy(zero_copy_only=False)
        at = np.unique(np.concatenate(_id_bits(ids))) if len(ids) else np.zeros(0, np.uint64)
        yield pa.RecordBatch.from_arrays([pa.array((at >> np.uint64(6)).astype(np.int64)), pa.array((np.uint64(1) << (at & np.uint64(63))).view(np.int64))], ["word", "bits"])


def split_by_ids(docs: DataFrame, ids: DataFrame, id_col: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """(rows that may have one of ``ids``, rows that surely have none, null ids among them).

    A Bloom filter of fixed size tells them apart before a join, so that rows with long texts that no join needs are
    not shuffled. Only ids pass through Python. The first part still needs the join.
    """
    spark = docs.sparkSession
    words = np.zeros(FILTER_BITS // 64, np.int64)
    for r in ids.select(id_col).mapInArrow(_word_batches, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).collect():
        words[r.word] = r.bits
    shared = spark.sparkContext.broadcast(words)

    @F.pandas_udf("boolean")
    def may(values: pd.Series) -> pd.Series:
        known = values.notna().to_numpy()
        out = known.copy()
        held = shared.value.view(np.uint64)
        for at in _id_bits(values[known].to_numpy().astype(np.int64)):
            out[known] &= ((held[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1)).astype(bool)
        return pd.Series(out)

    marked = docs.withColumn("_may", may(F.col(id_col).cast("long")))
    return marked.where("_may").drop("_may"), marked.where("NOT _may").drop("_may")


def repeated_batches(batches):
    """Of rows sorted by their first column, a long, those whose value another row has too. One row is held back."""
    held, seen = None, False  # the last row, and whether the one before it is its equal
    for b in batches:
        if not b.num_rows:
            continue
        t = pa.table([b.column(k) for k in range(b.num_columns)], names=b.schema.names) if held is None else pa.concat_tables([held, pa.Table.from_batches([b]).rename_columns(held.schema.names)])
        key = t.column(0).to_numpy()
        same = key[1:] == key[:-1]
        keep = np.concatenate([[seen], same]) | np.concatenate([same, [False]])
        held, seen = t.slice(len(key) - 1), bool(keep[-1])
        yield from t.slice(0, len(key) - 1).filter(pa.array(keep[:-1], pa.bool_())).combine_chunks().to_batches()
    if held is not None and seen:
        yield from held.combine_chunks().to_batches()


@contextlib.contextmanager
def tables_of(name: str):
    """Intermediate tables made inside belong to ``name``, for :func:`drop_stored`."""
    _OWNER.append(name)
    try:
        yield
    finally:
        _OWNER.pop()


def drop_stored(spark: SparkSession, name: str, docs: DataFrame) -> None:
    """Delete the tables that belong to ``name``, for a chain of steps whose input ``docs`` has been written: all but
    those that ``docs`` itself reads."""
    read = docs.inputFiles()
    for path in [p for p, owner in _MADE.items() if owner == name]:
        if not any(path.rpartition("/")[2] in f for f in read):
            _forget(spark, path)
            del _MADE[path]


def new_dir(spark: SparkSession, name: str) -> str:
    """A new folder in the shared one, which goes when the driver's Python ends."""
    path = f"{shared_dir(spark)}/llm-{name}-{uuid.uuid4().hex}"
    atexit.register(_forget, spark, path)
    return path


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
