"""Percentiles of very large numeric columns per group: exact order statistics by distributed multi-select, and a
mergeable summary with a stated error bound.

Multi-select. Every group and rank is a target with a range of values that may still hold it. In each round every
partition proposes, for each target, the weighted median of its values in range with their number; the weighted median of
the proposals is the pivot; the values below, at and above it are counted, and the side that cannot hold the rank is
discarded. At least a quarter of the values in range go each round, mostly half. Targets with at most LIMIT different
values in range are finished by a sort of those. The error is zero: the result is the value of that rank.

Summary. Values fall into logarithmic buckets of relative width 2*ALPHA/(1-ALPHA); their counts per group and slice add
up across slices, partitions or days, and any percentile read from them is within a relative ALPHA of the exact one
(zeros are exact; negative values mirror). The summary of all slices also gives multi-select its first ranges, so only
the buckets that hold a rank are ever looked at again.

Targets, ranges, pivots and results are tables, joined on the target; the driver sees only how many targets are left.
Equal values in range are one row with their count, so ties and hot groups shrink before anything is shuffled. A table
of targets is broadcast as long as it has at most BROADCAST rows; more are joined by a shuffle.

Defined cases: NULL and NaN values are left out, infinite ones count as the largest and smallest; a NULL group is a group
of its own, groups without a value give no row; ties and repeated rows count as often as they occur; an empty table gives
no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postlode.session import cut

ALPHA = 0.01
LIMIT = 4
BROADCAST = 500_000
_GAMMA = (1 + ALPHA) / (1 - ALPHA)


def bucket(x: Column) -> Column:
    """Number of the value's bucket, ascending with the value: sign times a shifted logarithm; 0 for zero."""
    log = F.greatest(F.ceil(F.least(F.ln(F.abs(x)) / float(np.log(_GAMMA)), F.lit(40000.0))), F.lit(-40000)) + 40001
    return F.when(x == 0, F.lit(0)).when(x > 0, log).otherwise(-log).cast("int")


def summary(df: DataFrame, group: list[Column], value: Column) -> DataFrame:
    """(g..., bucket, n): mergeable counts. Group columns are named by the caller's aliases."""
    x = df.select(*group, value.cast("double").alias("_x")).where("_x is not null and not isnan(_x)")
    names = x.columns[:-1]
    return x.groupBy(*names, bucket(F.col("_x")).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def merge(parts: DataFrame, group: list[str]) -> DataFrame:
    """Summaries of several slices as one."""
    return parts.groupBy(*group, "bucket").agg(F.sum("n").alias("n"))


def read_summary(merged: DataFrame, group: list[str], qs: tuple[float, ...]) -> DataFrame:
    """(group..., n, q, value) within a relative ALPHA of the value of rank ceil(q*n)."""
    up = merged.withColumns({"total": F.sum("n").over(Window.partitionBy(*group)), "upto": F.sum("n").over(Window.partitionBy(*group).orderBy("bucket"))})
    targets = up.withColumn("q", F.explode(F.array(*[F.lit(q) for q in qs])))
    hit = targets.where((F.col("upto") >= F.greatest(F.ceil(F.col("q") * F.col("total")), F.lit(1))) & (F.col("upto") - F.col("n") < F.greatest(F.ceil(F.col("q") * F.col("total")), F.lit(1))))
    magnitude = F.pow(F.lit(_GAMMA), F.abs("bucket") - 40001) * 2 / (1 + _GAMMA)
    return hit.select(*group, F.col("total").alias("n"), "q", F.when(F.col("bucket") == 0, 0.0).when(F.col("bucket") > 0, magnitude).otherwise(-magnitude).alias("value"))


def _small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST else df


def _local_medians(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(k, m, w): of the rows (k, x, c) of one partition, each target's weighted median and its weight."""
    got = [b for b in batches if b.num_rows]
    if not got:
        return
    k, x, c = (np.concatenate([b.column(i).to_numpy(zero_copy_only=False) for b in got]) for i in range(3))
    by = np.lexsort((x, k))
    k, x, c = k[by], x[by], c[by]
    first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
    total = np.add.reduceat(c, first)
    upto = np.cumsum(c)
    before = upto[first] - c[first]
    # the first row of each target at which half of its weight is reached
    at = np.searchsorted(upto, before + (total + 1) // 2)
    yield pa.RecordBatch.from_arrays([pa.array(k[first]), pa.array(x[at]), pa.array(total)], names=["k", "m", "w"])


def select_ranks(values: DataFrame, targets: DataFrame, limit: int = LIMIT) -> DataFrame:
    """(k, value) of all targets. values: (k, x, c), the different values in range of each target and how often they
    occur, written out; targets: (k, r), the 0-based rank of each among them."""
    found: list[DataFrame] = []
    state = cut(targets.join(values.groupBy("k").agg(F.count(F.lit(1)).alias("different")), "k"))
    live, brief = values, F.col("different") <= max(limit, 0)
    while left := state.where(~brief).count():
        if limit > 0:
            found.append(_sorted(live, state.where(brief)))
        live = live.join(_small(state.where(~brief).select("k", "r"), left), "k")
        pivots = live.select("k", "x", "c").mapInArrow(_local_medians, "k bigint, m double, w bigint").groupBy("k").agg(F.percentile("m", F.lit(0.5), F.col("w")).alias("p"))
        beside = live.join(_small(pivots, left), "k")
        below, at = (F.sum(F.when(x, F.col("c")).otherwise(0)) for x in (F.col("x") < F.col("p"), F.col("x") == F.col("p")))
        after = cut(beside.groupBy("k").agg(F.first("r").alias("r"), F.first("p").alias("p"), below.alias("below"), at.alias("at")))
        hit = (F.col("r") >= F.col("below")) & (F.col("r") < F.col("below") + F.col("at"))
        found.append(after.where(hit).select("k", F.col("p").alias("value")))
        lower = F.col("r") < F.col("below")
        ranges = after.where(~hit).select("k", "p", lower.alias("lower"), F.when(lower, F.col("r")).otherwise(F.col("r") - F.col("below") - F.col("at")).alias("rank"))
        inside = live.join(_small(ranges, left), "k").where(F.when(F.col("lower"), F.col("x") < F.col("p")).otherwise(F.col("x") > F.col("p")))
        inside = cut(inside.select("k", "x", "c", "rank"))
        state = cut(inside.groupBy("k").agg(F.first("rank").alias("r"), F.count(F.lit(1)).alias("different")))
        live = inside.drop("rank")
    if limit > 0:
        found.append(_sorted(live, state))
    if not found:
        return state.select("k", F.lit(None).cast("double").alias("value"))
    whole = found[0]
    for f in found[1:]:
        whole = whole.unionByName(f)
    return whole


def _sorted(values: DataFrame, state: DataFrame) -> DataFrame:
    """(k, value) of the targets of `state`, which have few different values."""
    upto = F.sum("c").over(Window.partitionBy("k").orderBy("x"))
    short = values.join(state.select("k", "r"), "k").withColumn("upto", upto)
    return short.where((F.col("upto") > F.col("r")) & (F.col("upto") - F.col("c") <= F.col("r"))).select("k", F.col("x").alias("value"))


def percentiles(df: DataFrame, group: Column, value: Column, qs: tuple[float, ...] = (0.25, 0.5, 0.75, 0.9), limit: int = LIMIT) -> DataFrame:
    """(g, n, q, value) with linear interpolation between the two exact order statistics around q*(n-1)."""
    return _percentiles(df, group, value, qs, limit, F.col("q") * (F.col("n") - 1))


def percentiles_by_rank(df: DataFrame, group: Column, value: Column, qs: tuple[float, ...], limit: int = LIMIT) -> DataFrame:
    """(g, n, q, value): the value of rank ceil(q*n), which the summary's bound is stated for."""
    return _percentiles(df, group, value, qs, limit, F.greatest(F.ceil(F.col("q") * F.col("n")), F.lit(1)) - 1)


def _percentiles(df: DataFrame, group: Column, value: Column, qs: tuple[float, ...], limit: int, at_rank: Column) -> DataFrame:
    values = df.select(group.cast("string").alias("g"), value.cast("double").alias("x")).where("x is not null and not isnan(x)")
    # a NULL group needs a key to join on
    values = values.select(F.coalesce(F.concat(F.lit("="), F.col("g")), F.lit("")).alias("g"), "x")
    counts = cut(summary(values, [F.col("g")], F.col("x")))
    sizes = counts.groupBy("g").agg(F.sum("n").alias("n"))
    asked = sizes.withColumn("q", F.explode(F.array(*[F.lit(float(q)) for q in qs]))).withColumn("at", at_rank.cast("double"))
    asked = cut(asked.withColumn("low", F.floor("at")).select("g", "n", "q", "low", F.least(F.col("low") + 1, F.col("n") - 1).alias("high"), (F.col("at") - F.col("low")).alias("part")))
    ranks = asked.select("g", F.explode(F.array("low", "high")).alias("rank")).groupBy("g").agg(F.collect_set("rank").alias("ranks"))
    ladder = counts.withColumn("upto", F.sum("n").over(Window.partitionBy("g").orderBy("bucket")))
    held = ladder.join(ranks, "g").select("g", "bucket", (F.col("upto") - F.col("n")).alias("below"), F.explode(F.filter("ranks", lambda r: (r < F.col("upto")) & (r >= F.col("upto") - F.col("n")))).alias("rank"))
    targets = cut(held.select(F.monotonically_increasing_id().alias("k"), "g", "bucket", "rank", (F.col("rank") - F.col("below")).alias("r")))
    many = targets.count()
    inside = values.withColumn("bucket", bucket(F.col("x"))).join(_small(targets.select("g", "bucket", "k"), many), ["g", "bucket"])
    found = select_ranks(cut(inside.groupBy("k", "x").agg(F.count(F.lit(1)).alias("c"))), targets.select("k", "r"), limit)
    at = targets.join(found, "k").select("g", "rank", "value")
    low, high = at.select("g", F.col("rank").alias("low"), F.col("value").alias("a")), at.select("g", F.col("rank").alias("high"), F.col("value").alias("b"))
    both = asked.join(low, ["g", "low"]).join(high, ["g", "high"])
    between = F.when(F.col("a") == F.col("b"), F.col("a")).otherwise(F.col("a") + (F.col("b") - F.col("a")) * F.col("part"))
    return both.select(F.when(F.col("g") != "", F.expr("substring(g, 2)")).alias("g"), "n", "q", between.alias("value"))
