"""Exact quantiles of groups of any size, without a task that holds a group.

One pass counts values in logarithmic buckets of relative width WIDTH; running sums per group tell which bucket holds each
rank. A second pass keeps the values of those buckets alone, and equal values as one row with their count; running sums
within a bucket find the value. Both passes pre-aggregate before they shuffle.

Defined cases: NULL and NaN values are left out; a NULL group is a group of its own; groups without a value, and an empty
table, give no row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WIDTH = 0.001


def _bucket(x: Column) -> Column:
    """Number of the value's bucket, ascending with the value."""
    size = F.floor(F.greatest(F.least(F.ln(F.abs(x)), F.lit(750.0)), F.lit(-750.0)) / F.lit(WIDTH)) + int(800 / WIDTH)
    return F.when(x == 0, F.lit(0)).when(x > 0, size).otherwise(-size).cast("int")


def quantiles(df: DataFrame, key: Column | None, value: Column, qs: tuple[float, ...]) -> DataFrame:
    """(key, n, p): for each group the number of values and the quantiles qs, linear between neighbouring ranks."""
    g = F.coalesce(F.concat(F.lit("="), key.cast("string")), F.lit("")) if key is not None else F.lit("")
    v = df.select(g.alias("g"), value.cast("double").alias("x")).where("x is not null and not isnan(x)").withColumn("b", _bucket(F.col("x")))
    ladder = v.groupBy("g", "b").agg(F.count(F.lit(1)).alias("n"))
    ladder = ladder.withColumns({"upto": F.sum("n").over(Window.partitionBy("g").orderBy("b")), "total": F.sum("n").over(Window.partitionBy("g"))})
    wanted = []
    for i, q in enumerate(qs):
        at = F.lit(q) * (F.col("total") - 1)
        low = F.floor(at)
        for side, rank in ((0, low), (1, F.least(low + 1, F.col("total") - 1))):
            wanted.append(F.struct(F.lit(i).alias("i"), F.lit(side).alias("side"), rank.alias("rank"), (at - low).alias("part")))
    here = F.filter(F.array(*wanted), lambda w: (w["rank"] < F.col("upto")) & (w["rank"] >= F.col("upto") - F.col("n")))
    hit = ladder.select("g", "b", "total", (F.col("upto") - F.col("n")).alias("below"), here.alias("ws")).where(F.size("ws") > 0)
    inside = v.join(hit.select("g", "b"), ["g", "b"]).groupBy("g", "b", "x").agg(F.count(F.lit(1)).alias("c"))
    inside = inside.withColumn("cum", F.sum("c").over(Window.partitionBy("g", "b").orderBy("x")))
    spots = inside.join(hit, ["g", "b"]).select("g", "total", "x", "c", "cum", "below", F.explode("ws").alias("w"))
    spots = spots.where((F.col("w.rank") - F.col("below") < F.col("cum")) & (F.col("w.rank") - F.col("below") >= F.col("cum") - F.col("c")))
    ends = spots.groupBy("g", "total", "w.i").agg(F.max(F.when(F.col("w.side") == 0, F.col("x"))).alias("a"), F.max(F.when(F.col("w.side") == 1, F.col("x"))).alias("z"), F.max("w.part").alias("part"))
    between = F.when(F.col("a") == F.col("z"), F.col("a")).otherwise(F.col("a") + (F.col("z") - F.col("a")) * F.col("part"))
    whole = ends.groupBy("g", "total").agg(F.sort_array(F.collect_list(F.struct("i", between.alias("v")))).alias("p"))
    return whole.select(F.when(F.col("g") != "", F.expr("substring(g, 2)")).alias("key"), F.col("total").alias("n"), F.col("p.v").alias("p"))


def beside(one: DataFrame, found: DataFrame) -> DataFrame:
    """A single row with the quantiles of the whole table, NULL if it has no value."""
    return one.withColumn("_one", F.lit(1)).join(found.select(F.lit(1).alias("_one"), "p"), "_one", "left").drop("_one")
