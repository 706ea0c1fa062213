"""Point in time, versions and upserts. A merge is an anti-join, a union and a keyed comparison; run twice, it adds nothing."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def pit_select(facts: DataFrame, as_of: str) -> DataFrame:
    """Facts known by ``as_of``: per (ticker, year, metric) the newest known date, then version; one scope a ticker,
    consolidated unless the other covers more (year, metric) cells."""
    known = facts.where(F.col("known_at") <= F.lit(as_of).cast("date"))
    w = Window.partitionBy("ticker", "scope", "fiscal_year", "metric").orderBy(F.desc("known_at"), F.desc("version"))
    one = known.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")
    cover = one.groupBy("ticker", "scope").agg(F.count("*").alias("n"))
    best = cover.groupBy("ticker").agg(F.max_by("scope", F.struct("n", F.col("scope") == "consolidado")).alias("scope"))
    return one.join(best, ["ticker", "scope"])


def first_wins_delta(stored: DataFrame, incoming: DataFrame, keys: list[str], fields: list[str]) -> tuple[DataFrame, DataFrame]:
    """(rows of new keys, revisions: keys whose fields differ, old and new values)."""
    adds = incoming.join(stored.select(*keys), keys, "left_anti")
    new = incoming.select(*keys, *[F.col(f).alias(f"new_{f}") for f in fields])
    differ = reduce(lambda a, b: a | b, [~F.col(f).eqNullSafe(F.col(f"new_{f}")) for f in fields])
    return adds.select(*stored.columns), stored.select(*keys, *fields).join(new, keys).where(differ)


def pit_merge_first_wins(stored: DataFrame, incoming: DataFrame, keys: list[str], fields: list[str]) -> tuple[DataFrame, DataFrame]:
    """(rows: stored ones unchanged and new keys, revisions: keys whose fields differ, old and new values)."""
    adds, revisions = first_wins_delta(stored, incoming, keys, fields)
    return stored.unionByName(adds), revisions


def versioned_diff(stored: DataFrame, incoming: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """Keys whose fields differ as numbers, with the list of changes."""
    new = incoming.select(*keys, *[F.col(f).alias(f"new_{f}") for f in fields])
    changed = F.array_compact(F.array(*[F.when(~F.col(f).eqNullSafe(F.col(f"new_{f}")), F.lit(f)) for f in fields]))
    return stored.select(*keys, *fields).join(new, keys).select(*keys, F.concat_ws(" | ", changed).alias("changed")).where("changed <> ''")


def last_wins(batches: list[DataFrame], keys: list[str]) -> DataFrame:
    """Union in order; per key the row of the last batch that has it."""
    u = reduce(DataFrame.unionByName, [b.withColumn("_batch", F.lit(i)) for i, b in enumerate(batches)])
    return u.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("_batch")))).where("_r = 1").drop("_r", "_batch")


def frozen_merge(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Old rows unchanged, but for the keys in ``new``, which take its values; keys only in ``new`` are left out."""
    n = new.select(key, F.lit(True).alias("_hit"), *[F.col(c).alias(f"_{c}") for c in old.columns if c != key])
    return old.join(n, key, "left").select(*[F.col(c) if c == key else F.when(F.col("_hit"), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) for c in old.columns])


def upsert(stored: DataFrame, incoming: DataFrame, keys: list[str], update: bool = True) -> DataFrame:
    """Insert new keys; on a known key take the incoming row, or with update=False keep the stored one."""
    kept = stored.join(incoming.select(*keys), keys, "left_anti") if update else stored
    added = incoming if update else incoming.join(stored.select(*keys), keys, "left_anti")
    return kept.unionByName(added.select(*stored.columns))


def ttm(filings: DataFrame) -> DataFrame:
    """Trailing twelve months of (company, fiscal_year, months, ytd, available_at): YTD plus the prior year less its YTD.

    A filing of 12 months is its own value. Statuses: ok, sem_ytd_anterior, sem_anual_anterior.
    """
    prior = filings.select("company", (F.col("fiscal_year") + 1).alias("fiscal_year"), "months", F.col("ytd").alias("prior_ytd"), F.col("available_at").alias("prior_at"))
    annual = filings.where("months = 12").select("company", (F.col("fiscal_year") + 1).alias("fiscal_year"), F.col("ytd").alias("annual"), F.col("available_at").alias("annual_at"))
    j = filings.join(prior, ["company", "fiscal_year", "months"], "left").join(annual, ["company", "fiscal_year"], "left")
    full = F.col("months") == 12
    status = F.when(full, "ok").when(F.col("prior_ytd").isNull(), "sem_ytd_anterior").when(F.col("annual").isNull(), "sem_anual_anterior").otherwise("ok")
    value = F.when(full, F.col("ytd")).otherwise(F.col("ytd") + F.col("annual") - F.col("prior_ytd"))
    at = F.when(full, F.col("available_at")).otherwise(F.greatest("available_at", "prior_at", "annual_at"))
    return j.select("company", "fiscal_year", "months", value.alias("ttm"), status.alias("status"), F.when(status == "ok", at).alias("available_at"))


def net_income(rows: DataFrame) -> DataFrame:
    """Per (company, period) the parent's share: the controller line if there is one, else the total; in units; the
    consolidated statement if it has a value, else the individual one."""
    v = F.when(F.col("scale") == "MIL", F.col("value") * 1000).when(F.col("scale") == "UNIDADE", F.col("value"))
    per = rows.groupBy("company", "period", "scope").agg(F.coalesce(F.max(F.when(F.col("line") == "controller", v)), F.max(F.when(F.col("line") == "total", v))).alias("value"))
    w = Window.partitionBy("company", "period").orderBy(F.when(F.col("scope") == "consolidado", 0).otherwise(1))
    return per.where("value IS NOT NULL").withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def no_regression(previous: DataFrame, current: DataFrame, key: str = "series") -> DataFrame:
    """Violations: an official value that became unavailable, or an observed date that moved back."""
    p = previous.select(key, F.col("status").alias("was"), F.col("observed").alias("was_observed"))
    lost, back = (F.col("was") == "official") & (F.col("status") == "unavailable"), F.col("observed") < F.col("was_observed")
    return current.join(p, key).where(lost | back).select(key, F.when(lost, "regressed_to_unavailable").otherwise("date_moved_back").alias("violation"))
