"""Market metrics over the fact table: each is (fact, parameters) -> DataFrame, scanned once with only its columns.

Top-N results have a total order (count descending, key ascending). Windows end at a given time, never at the clock's.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postlode.operators.quantiles import beside, quantiles

LEAST_SAMPLE = 5
DIVERGENCE = 0.15
R2, FLAT = 0.8, 0.3


def latest(fact: DataFrame) -> datetime:
    """The end of the data, for callers that have no other time to report at."""
    return fact.agg(F.max("scraped_at")).first()[0]


def since(df: DataFrame, at: datetime, days: int) -> DataFrame:
    return df.where(F.col("scraped_at") >= F.lit(at) - F.expr(f"INTERVAL {days} DAYS"))


def between(df: DataFrame, start: Column, end: Column) -> DataFrame:
    return df.where((F.col("scraped_at") >= start) & (F.col("scraped_at") < end))


def skills() -> Column:
    """Skills of a posting; NULL where the JSON is broken."""
    return F.from_json("matched_skills_json", "array<string>")


def week(c: str = "scraped_at") -> Column:
    """Monday of the week."""
    return F.to_date(F.date_trunc("week", c))


def midpoint() -> Column:
    """Mean of the annual bounds present, for postings paid by the year."""
    a, b = F.col("salary_annual_min"), F.col("salary_annual_max")
    return F.when(F.col("salary_period") == "annual", (F.coalesce(a, b) + F.coalesce(b, a)) / 2)


def half_filled_midpoint() -> Column:
    """Mean with a missing bound as 0, and 0 as missing."""
    return F.nullif((F.coalesce("salary_annual_min", F.lit(0.0)) + F.coalesce("salary_annual_max", F.lit(0.0))) / 2, F.lit(0.0))


def histogram(df: DataFrame, key: Column, name: str) -> DataFrame:
    return df.groupBy(key.alias(name)).agg(F.count(F.lit(1)).alias("n"))


def top(df: DataFrame, key: str, n: int) -> DataFrame:
    return df.orderBy(F.desc("n"), F.asc(key)).limit(n)


def top_skills(fact: DataFrame, n: int = 10) -> DataFrame:
    """Mentions, repeats within a posting counted."""
    return top(histogram(fact.select(F.explode(skills()).alias("skill")), F.col("skill"), "skill"), "skill", n)


def salary_stats(fact: DataFrame) -> DataFrame:
    paid = fact.where("salary_period = 'annual' and (salary_annual_min is not null or salary_annual_max is not null)")
    one = paid.agg(F.count(F.lit(1)).alias("n"), F.bround(F.avg("salary_annual_min"), 0).alias("avg_min"), F.bround(F.avg("salary_annual_max"), 0).alias("avg_max"))
    return beside(one, quantiles(paid, None, half_filled_midpoint(), (0.5,))).select("n", "avg_min", "avg_max", F.bround(F.col("p")[0], 0).alias("median"))


def percentile_groups(df: DataFrame, key: Column | None, name: str = "key", least: int = 0) -> DataFrame:
    """n and quartiles of the annual midpoint; under `least` values the quartiles are withheld and flagged."""
    r = quantiles(df, key, midpoint(), (0.25, 0.5, 0.75))
    r = r.withColumnRenamed("key", name) if key is not None else beside(df.agg(F.count(midpoint()).alias("n")), r)
    quartile = lambda i: F.when(F.col("n") >= least, F.round(F.col("p")[i], 2))
    out = r.select(*([name] if key is not None else []), "n", quartile(0).alias("p25"), quartile(1).alias("p50"), quartile(2).alias("p75"))
    return out.withColumn("suppressed", F.col("n") < least) if least else out


def divergence(fact: DataFrame, at: datetime, threshold: float = DIVERGENCE) -> DataFrame:
    """Median of the last week against the median of the whole window."""
    recent = F.col("scraped_at") >= F.lit(at) - F.expr("INTERVAL 7 DAYS")
    window = F.explode(F.filter(F.array(F.lit("rolling"), F.when(recent, F.lit("weekly"))), lambda w: w.isNotNull()))
    q = quantiles(fact.select(midpoint().alias("m"), window.alias("w")), F.col("w"), F.col("m"), (0.5,))
    r = q.agg(*[F.max(F.when(F.col("key") == k, F.col("p")[0])).alias(k) for k in ("weekly", "rolling")])
    ratio = F.abs(F.col("weekly") - F.col("rolling")) / F.nullif(F.col("rolling"), F.lit(0.0))
    return r.select("weekly", "rolling", F.round(ratio, 4).alias("ratio"), F.coalesce(ratio > threshold, F.lit(False)).alias("diverged"))


def rate(df: DataFrame, column: str, yes: str, no: str) -> DataFrame:
    """Counts of 1, 0 and unknown, and the share of 1 in percent."""
    r = df.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col(column) == 1).alias(yes), F.count_if(F.col(column) == 0).alias(no))
    return r.select("total", yes, F.bround(100 * F.col(yes) / F.col("total"), 1).alias(f"{yes}_pct"), no, (F.col("total") - F.col(yes) - F.col(no)).alias("unknown"))


def deltas(fact: DataFrame, at: datetime, skill_names: list[str], weeks: int = 1) -> DataFrame:
    """Each metric in the last window against the one before, in one pass: current, previous, change and direction."""
    end, span = F.lit(at), F.expr(f"INTERVAL {7 * weeks} DAYS")
    t = F.col("scraped_at")
    now, before = (t >= end - span) & (t < end), (t >= end - span - span) & (t < end - span)
    share = lambda w, c: F.bround(100 * F.count_if(w & (F.col(c) == 1)) / F.nullif(F.count_if(w), F.lit(0)), 1)
    any_ = lambda w, c: F.when(F.count_if(w) > 0, c.cast("double"))
    metrics = {
        "total_volume": lambda w: any_(w, F.count_if(w)),
        "sponsorship_rate": lambda w: share(w, "offers_sponsorship"),
        "startup_share": lambda w: share(w, "is_startup"),
        "salary_median": lambda w: F.lit(None).cast("double"),
        **{s: (lambda w, s=s: any_(w, F.count_if(w & F.array_contains(skills(), s)))) for s in skill_names},
    }
    one = fact.agg(*[f(w).alias(f"{i}_{k}") for i, f in enumerate(metrics.values()) for k, w in (("c", now), ("p", before))])
    # medians are found by group and take their place in the row
    pay = list(metrics).index("salary_median")
    medians = quantiles(fact.where(now | before), F.when(now, "c").otherwise("p"), midpoint(), (0.5,)).agg(*[F.max(F.when(F.col("key") == k, F.col("p")[0])).alias(k) for k in ("c", "p")])
    one = one.drop(f"{pay}_c", f"{pay}_p").withColumn("_one", F.lit(1)).join(medians.select(F.lit(1).alias("_one"), F.col("c").alias(f"{pay}_c"), F.col("p").alias(f"{pay}_p")), "_one", "left").drop("_one")
    rows = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(f"{i}_c").cast("double").alias("current"), F.col(f"{i}_p").cast("double").alias("previous")) for i, m in enumerate(metrics)])
    r = one.select(F.explode(rows).alias("r")).select("r.*")
    change = F.bround(F.col("current") - F.col("previous"), 2)
    r = r.withColumn("abs_change", change)
    direction = F.when(F.col("abs_change").isNull(), "unknown").when(F.col("abs_change") > 0, "up").when(F.col("abs_change") < 0, "down").otherwise("flat")
    return r.select("metric", "current", "previous", "abs_change", F.bround(100 * F.col("abs_change") / F.nullif(F.col("previous"), F.lit(0.0)), 1).alias("pct_change"), direction.alias("direction"))


def dense_weeks(mentions: DataFrame, key: str, n: int | None) -> DataFrame:
    """(key, week, n) for the n most mentioned keys and all weeks with any mention, zeros filled in. mentions: (week, key)."""
    counts = mentions.groupBy("week", key).agg(F.count(F.lit(1)).alias("n"))
    totals = counts.groupBy(key).agg(F.sum("n").alias("n"))
    keys = (top(totals, key, n) if n else totals).select(key)
    # calendar weeks of the window: a few dozen dates, as literals
    weeks = sorted(r[0] for r in counts.select("week").distinct().collect())
    grid = keys.select(key, F.explode(F.array(*[F.lit(w) for w in weeks]) if weeks else F.array().cast("array<date>")).alias("week"))
    return grid.join(counts, [key, "week"], "left").select(key, "week", F.coalesce("n", F.lit(0)).alias("n"))


def skill_weeks(fact: DataFrame, at: datetime, weeks: int, n: int) -> DataFrame:
    recent = fact.where(F.col("scraped_at") >= F.lit(at) - F.expr(f"INTERVAL {7 * weeks} DAYS"))
    return dense_weeks(recent.select(week().alias("week"), F.explode(skills()).alias("skill")), "skill", n)


def trend(grid: DataFrame, key: str) -> DataFrame:
    """Slope, fit and label of each key's weekly series: New, Accelerating, Cooling or Stable."""
    at = F.row_number().over(Window.partitionBy(key).orderBy("week")) - 1
    last = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("week"))) == 1
    s = grid.withColumns({"x": at, "last": last}).groupBy(key).agg(
        F.count(F.lit(1)).alias("weeks"), F.sum("n").alias("total"), F.max(F.when(F.col("last"), F.col("n"))).alias("now"),
        F.when((F.count(F.lit(1)) < 2) | (F.min("n") == F.max("n")), 0.0).otherwise(F.regr_slope("n", "x")).alias("slope"),
        F.when((F.count(F.lit(1)) < 2) | (F.min("n") == F.max("n")), 0.0).otherwise(F.regr_r2("n", "x")).alias("r2"),
    )
    new = (F.col("weeks") > 2) & (F.col("total") == F.col("now")) & (F.col("now") > 0)
    label = (
        F.when(new, "New").when((F.col("r2") > R2) & (F.col("slope") > 0), "Accelerating").when((F.col("r2") > R2) & (F.col("slope") < 0), "Cooling")
        .when(F.abs("slope") < FLAT, "Stable").when(F.col("slope") < 0, "Cooling").otherwise("Accelerating")
    )
    keep = lambda c: F.when(new, 0.0).otherwise(F.round(c, 3))
    return s.select(key, "weeks", label.alias("trend"), keep(F.col("slope")).alias("slope"), keep(F.col("r2")).alias("r_squared"))


def rising(grid: DataFrame, key: str, window: int = 3) -> DataFrame:
    """Rising, Cooling or Stable by the slope over the last weeks and the last value against their mean."""
    back = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("week")))
    tail = grid.withColumn("back", back).where(F.col("back") <= window)
    s = tail.groupBy(key).agg(F.count(F.lit(1)).alias("k"), F.avg("n").alias("mean"), F.max(F.when(F.col("back") == 1, F.col("n"))).alias("now"), F.regr_slope("n", -F.col("back")).alias("slope"))
    label = F.when(F.col("k") < window, "Stable").when((F.col("slope") > 1e-9) & (F.col("now") >= F.col("mean")), "Rising").when((F.col("slope") < -1e-9) & (F.col("now") <= F.col("mean")), "Cooling").otherwise("Stable")
    return s.select(key, label.alias("label"))


def skill_pairs(fact: DataFrame, n: int = 15, least: int = 3) -> DataFrame:
    """Pairs of different skills of one posting: the n most frequent, then those with at least `least`."""
    own = fact.select(F.array_sort(F.array_distinct(skills())).alias("s")).where("size(s) > 1")
    pairs = own.select(F.explode(F.expr("flatten(transform(s, (x, i) -> transform(slice(s, i + 2, size(s)), y -> struct(x as a, y as b))))")).alias("p"))
    counts = pairs.groupBy(F.col("p.a").alias("skill_a"), F.col("p.b").alias("skill_b")).agg(F.count(F.lit(1)).alias("n"))
    return counts.orderBy(F.desc("n"), "skill_a", "skill_b").limit(n).where(F.col("n") >= least)


def persistence(fact: DataFrame, seen: DataFrame) -> DataFrame:
    """Median days between first and last sight, by category."""
    j = fact.select("dedup_hash", F.coalesce("role_category", F.lit("Other")).alias("category")).join(seen.select("dedup_hash", "first_seen_at", "last_seen_at"), "dedup_hash")
    days = (F.unix_micros("last_seen_at") - F.unix_micros("first_seen_at")) / 86400000000.0
    median = quantiles(j, F.col("category"), days, (0.5,)).select(F.col("key").alias("category"), F.round(F.col("p")[0], 4).alias("median_days"))
    return j.groupBy("category").agg(F.count(F.lit(1)).alias("n")).join(median, "category", "left").select("category", "median_days", "n")


def pay_by_skill(fact: DataFrame, least: int = 15) -> DataFrame:
    paid = fact.select(midpoint().alias("m"), F.array_distinct(skills()).alias("s")).where("m is not null")
    market = quantiles(paid, None, F.col("m"), (0.5,)).select(F.col("p")[0].alias("market"))
    per = quantiles(paid.select("m", F.explode("s").alias("skill")), F.col("skill"), F.col("m"), (0.5,)).where(F.col("n") >= least)
    per = per.select(F.lit(1).alias("_one"), F.col("key").alias("skill"), "n", F.col("p")[0].alias("median")).join(F.broadcast(market.withColumn("_one", F.lit(1))), "_one")
    return per.select("skill", "n", F.round("median", 2).alias("median_salary"), F.round("market", 2).alias("market_median"), F.bround(100 * (F.col("median") - F.col("market")) / F.col("market"), 1).alias("premium_pct"))


STAGES = ("total_scraped", "total_after_dedup", "total_after_prescreen", "total_scored", "total_qualified")


def funnel(runs: DataFrame, n: int = 10) -> DataFrame:
    """Latest complete runs with the share lost between stages; NULL where a stage is unknown or its base is 0."""
    last = runs.where("status = 'complete'").orderBy(F.desc("started_at"), "run_id").limit(n)
    drop = lambda a, b: F.bround(100 * (F.col(a) - F.col(b)) / F.nullif(F.col(a), F.lit(0)), 1).alias(f"{a}_to_{b}")
    return last.select("run_id", *STAGES, *[drop(a, b) for a, b in zip(STAGES, STAGES[1:], strict=False)])


def funnel_averages(runs: DataFrame, n: int = 10) -> DataFrame:
    f = funnel(runs, n)
    return f.agg(F.count(F.lit(1)).alias("n_runs"), *[F.bround(F.avg(c), 1).alias(c) for c in f.columns if c != "run_id"])


def ranked(counts: DataFrame, most: int | None) -> DataFrame:
    """(r, k, n): counts (k, n) numbered from the most frequent; the first `most`, found before they are numbered, or all
    of a short list."""
    from pyspark.sql import Window

    top = counts.orderBy(F.desc("n"), "k").limit(most) if most else counts
    return top.withColumn("r", F.row_number().over(Window.orderBy(F.desc("n"), "k")))
