"""Rules on tables: packages, constraints, conformance and health."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import reasons


def check(df: DataFrame, **rules: Column) -> DataFrame:
    """``errors``: the names of broken rules, in order; a rule that can't be told (null) is not broken."""
    return df.withColumn("errors", reasons(*[(k, F.coalesce(v, F.lit(False))) for k, v in rules.items()]))


def compatibility(found, wanted: str) -> Column:
    """Of MAJOR.MINOR versions: exact, forward_ok (newer minor), degraded (older minor), incompatible."""
    major, minor = (int(x) for x in wanted.split("."))
    a, b = F.split_part(F.col(found), F.lit("."), F.lit(1)).try_cast("int"), F.split_part(F.col(found), F.lit("."), F.lit(2)).try_cast("int")
    return F.when(a.isNull() | b.isNull() | (a != major), "incompatible").when(b == minor, "exact").when(b > minor, "forward_ok").otherwise("degraded")


def unique_violations(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def foreign_violations(df: DataFrame, keys: dict[str, str], parent: DataFrame) -> DataFrame:
    """Rows whose non-null key is not in the parent."""
    on = reduce(lambda a, b: a & b, [F.col(c) == F.col(f"_p_{p}") for c, p in keys.items()])
    there = parent.select(*[F.col(p).alias(f"_p_{p}") for p in keys.values()])
    return df.where(reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in keys])).join(there, on, "left_anti")


def health(datasets: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """Per dataset (frame, date column): rows, newest date and status; each is one aggregate."""
    each = [df.groupBy().agg(F.count("*").alias("n"), F.max(F.col(c).cast("date")).alias("as_of")).select(F.lit(name).alias("dataset"), "n", "as_of") for name, (df, c) in datasets.items()]
    return reduce(DataFrame.unionByName, each).withColumn("status", F.when(F.col("n") > 0, "ok").otherwise("empty"))


def conforms(text, schema: str, required: list[str]) -> Column:
    """Whether a JSON text has this shape and all required fields."""
    s = F.from_json(text, schema + ", _corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    return reduce(lambda a, b: a & b, [s[c].isNotNull() for c in required], s["_corrupt"].isNull())
