"""Tables that change: insert-ignore, upsert, expiring cache and append-only archive as DataFrame operations.

Parquet has no MERGE: an operation takes the present table and the change and gives the next table, which the caller
writes beside the old one and swaps in. Each is one equi-join or one aggregate by key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def first_by(df: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """First row of each key. One aggregate with partial results, no sort of whole groups."""
    rest = [c for c in df.columns if c not in key]
    rank = F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)])
    return df.groupBy(*key).agg(F.min_by(F.struct(*rest), rank).alias("_r")).select(*key, "_r.*").select(*df.columns)


def insert_ignore(present: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """present and the rows of new whose key it lacks (the first of each key)."""
    fresh = new.join(present.select(key), key, "left_anti").dropDuplicates([key])
    return present.unionByName(fresh.select(present.columns))


def unseen(new: DataFrame, seen: DataFrame, key: str) -> DataFrame:
    return new.join(seen.select(key), key, "left_anti")


def upsert_seen(seen: DataFrame, sightings: DataFrame) -> DataFrame:
    """seen (dedup_hash, first_seen_at, last_seen_at, times_seen) after sightings (dedup_hash, at)."""
    old = seen.select("dedup_hash", "first_seen_at", "last_seen_at", F.coalesce("times_seen", F.lit(1)).cast("bigint").alias("times_seen"))
    new = sightings.select("dedup_hash", F.col("at").alias("first_seen_at"), F.col("at").alias("last_seen_at"), F.lit(1).cast("bigint").alias("times_seen"))
    return old.unionByName(new).groupBy("dedup_hash").agg(F.min("first_seen_at").alias("first_seen_at"), F.max("last_seen_at").alias("last_seen_at"), F.sum("times_seen").alias("times_seen"))


def upsert_latest(cache: DataFrame, new: DataFrame, key: str, order: str) -> DataFrame:
    """The latest row of each key of both."""
    both = cache.unionByName(new)
    rest = [c for c in both.columns if c != key]
    return both.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("_r")).select(key, "_r.*")


def alive(cache: DataFrame, at: Column) -> DataFrame:
    return cache.where(F.col("expires_at") > at)


def evict(cache: DataFrame, at: Column) -> tuple[DataFrame, DataFrame]:
    """(cache without expired rows, number of rows evicted)."""
    gone = F.col("expires_at") <= at
    return cache.where(~gone), cache.agg(F.count_if(gone).alias("evicted"))


def set_score(table: DataFrame, scores: DataFrame, key: str) -> DataFrame:
    """Scores replace; a missing variant keeps the old one."""
    s = scores.select(key, F.col("overall_score").alias("_s"), F.col("cv_variant").alias("_v"))
    return table.join(s, key, "left").withColumns({"overall_score": F.coalesce("_s", "overall_score"), "cv_variant": F.coalesce("_v", "cv_variant")}).drop("_s", "_v")


def run_state(events: DataFrame) -> DataFrame:
    """Latest known value of each field of a run, from append-only start and complete events (run_id, at, fields)."""
    fields = [c for c in events.columns if c not in ("run_id", "at")]
    return events.groupBy("run_id").agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), F.col("at"))).alias(c) for c in fields])
