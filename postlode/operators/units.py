"""Quantities recorded in different units: find the unit each figure is in and convert to pounds per year.

Evidence is taken in this order: a mention in the text (number and unit alias pulled out with one regular expression,
the alias normalised by a join with a small alias table) whose number matches a recorded figure under some scale; the
recorded unit, if the size of the figure does not contradict it; the unit whose usual range holds the figure.

Everything is built-in expressions. Only the short mentions are shuffled, never the text.

Defined cases: rows without a positive figure give no row; a NULL title, description or period counts as absent; texts
of any length are read whole; redelivered rows of one id give one row per id; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Alias -> (unit, factor of the number written before it). The factors to pounds a year are in FACTORS.
ALIASES: tuple[tuple[str, str, float], ...] = (
    ("an hour", "hourly", 1.0), ("per hour", "hourly", 1.0), ("/hour", "hourly", 1.0), ("/hr", "hourly", 1.0),
    ("ph", "hourly", 1.0), ("p/h", "hourly", 1.0), ("hourly", "hourly", 1.0), ("hour rate", "hourly", 1.0),
    ("a day", "daily", 1.0), ("per day", "daily", 1.0), ("/day", "daily", 1.0), ("pd", "daily", 1.0), ("p/d", "daily", 1.0),
    ("for each day worked", "daily", 1.0), ("daily", "daily", 1.0), ("day rate", "daily", 1.0), ("per diem", "daily", 1.0),
    ("a week", "weekly", 1.0), ("per week", "weekly", 1.0), ("/week", "weekly", 1.0), ("pw", "weekly", 1.0), ("p/w", "weekly", 1.0),
    ("weekly", "weekly", 1.0), ("each week", "weekly", 1.0),
    ("a month", "monthly", 1.0), ("per month", "monthly", 1.0), ("/month", "monthly", 1.0), ("pcm", "monthly", 1.0),
    ("pm", "monthly", 1.0), ("p/m", "monthly", 1.0), ("monthly", "monthly", 1.0), ("each calendar month", "monthly", 1.0),
    ("each month", "monthly", 1.0),
    ("a year", "annual", 1.0), ("per year", "annual", 1.0), ("/year", "annual", 1.0), ("per annum", "annual", 1.0),
    ("pa", "annual", 1.0), ("annual", "annual", 1.0), ("annually", "annual", 1.0), ("/annum", "annual", 1.0),
    ("k", "annual", 1000.0), ("thousand pounds", "annual", 1000.0), ("thousand", "annual", 1000.0),
)
# Pounds a year for one unit (220 working days of 7.5 hours, as the pipeline's own conversion).
FACTORS = {"hourly": 1650.0, "daily": 220.0, "weekly": 52.0, "monthly": 12.0, "annual": 1.0, "thousands": 1000.0, "pence": 0.01}
# Usual ranges of a figure by recorded unit; outside, its size contradicts the record.
PLAUSIBLE = {"hourly": (5.0, 250.0), "daily": (60.0, 3000.0), "weekly": (150.0, 8000.0), "monthly": (600.0, 30000.0), "annual": (8000.0, 600000.0)}

NUMBER = r"([0-9][0-9,]*(?:\.[0-9]+)?)"
AFTER = (
    r"(?i)" + NUMBER + r"(?: ?(?:gbp|pounds|sterling))? ?"
    r"(an hour|per hour|/ ?hour|/ ?hr|p/?h\b|a day|per day|per diem|/ ?day|p/?d\b|for each day worked|"
    r"a week|per week|each week|/ ?week|p/?w\b|a month|per month|each calendar month|each month|/ ?month|pcm|p/?m\b|"
    r"a year|per year|per annum|/ ?year|/ ?annum|p\.? ?a\b|thousand pounds|thousand|k\b)"
    r"([ -]+[a-z-]+ (?:supplement|allowance|bonus|voucher|stipend|budget|contribution|fund))?"
)
BEFORE = (
    r"(?i)\b(hourly|daily|day rate|hour rate|weekly|monthly|annual|annually)(?: (?:rate|pay|wage|wages|salary|fee|figure))?"
    r"(?: (?:of|up to|from|is|at))?:? ?£? ?" + NUMBER + r"( ?k\b)?(?: ?(?:to|-|–) ?£? ?" + NUMBER + r"( ?k\b)?)?"
)


def _num(c: Column) -> Column:
    return F.regexp_replace(c, ",", "").try_cast("double") if hasattr(Column, "try_cast") else F.regexp_replace(c, ",", "").cast("double")


def mentions(df: DataFrame, key: str, *figures: str) -> DataFrame:
    """One row per number with a unit in the text: key, figures, alias, value as written."""
    clean = lambda c: F.regexp_replace(F.coalesce(F.col(c), F.lit("")), r"<[^>]*>", " ")
    text = F.concat(clean("title"), F.lit(" \n "), clean("description"))
    base = df.select(key, *figures, text.alias("_t")).where(F.col("_t").rlike(r"[0-9]"))
    both = base.select(
        key, *figures,
        F.concat(
            F.transform(F.regexp_extract_all("_t", F.lit(AFTER), F.lit(0)), lambda m: F.concat(F.lit("A"), m)),
            F.transform(F.regexp_extract_all("_t", F.lit(BEFORE), F.lit(0)), lambda m: F.concat(F.lit("B"), m)),
        ).alias("_m"),
    )
    m = both.select(key, *figures, F.explode("_m").alias("_s")).withColumns({"_side": F.substring("_s", 1, 1), "_s": F.expr("substr(_s, 2)")})
    a = F.col("_side") == "A"
    alias = F.when(a, F.regexp_extract("_s", AFTER, 2)).otherwise(F.regexp_extract("_s", BEFORE, 1))
    alias = F.regexp_replace(F.regexp_replace(F.lower(alias), r"[. ]*\bp\.? ?a$", "pa"), r"/ ", "/")
    kilo = ~a & (F.concat(F.regexp_extract("_s", BEFORE, 3), F.regexp_extract("_s", BEFORE, 5)) != "")
    numbers = F.when(a, F.array(F.regexp_extract("_s", AFTER, 1))).otherwise(F.array(F.regexp_extract("_s", BEFORE, 2), F.regexp_extract("_s", BEFORE, 4)))
    m = m.where(~a | (F.regexp_extract("_s", AFTER, 3) == "")).select(
        key, *figures, alias.alias("alias"), kilo.alias("_kilo"), F.explode(numbers).alias("_n")
    ).where(F.col("_n") != "")
    return m.select(key, *figures, "alias", (_num(F.col("_n")) * F.when(F.col("_kilo"), 1000.0).otherwise(1.0)).alias("value"))


def by_size(f: Column, whole: Column) -> Column:
    """The unit whose usual range holds the figure. whole: no quarter pounds, as hourly rates have."""
    return (
        F.when(f >= 600000, "pence").when(f >= 12000, "annual").when(f >= 1600, "monthly").when(f >= 1000, "weekly")
        .when(f >= 200, "daily").when((f >= 15) & whole, "thousands").otherwise("hourly")
    )


def detect_units(df: DataFrame, key: str = "job_id") -> DataFrame:
    """(key, salary_min, salary_max, unit) for every key with a positive figure; unit is one of FACTORS."""
    spark = df.sparkSession
    pos = lambda c: F.when(F.col(c) > 0, F.col(c))
    rows = df.select(key, pos("salary_min").alias("lo"), pos("salary_max").alias("hi"), F.lower(F.trim("salary_period")).alias("period"), "title", "description").where(
        "lo is not null or hi is not null"
    )
    aliases = spark.createDataFrame(list(ALIASES), "alias string, u string, mult double")
    m = mentions(rows, key, "lo", "hi", "period").join(F.broadcast(aliases), "alias")
    v = F.col("value") * F.col("mult")
    # how far the written number is from a recorded figure under the scales pounds, thousands and pence
    tie = lambda c, s: F.abs(F.ln(v / (F.col(c) * s)))
    near = lambda s: F.least(tie("lo", s), tie("hi", s))
    m = m.where(v > 0).select(
        key, "lo", "hi", "period", "u", near(1.0).alias("one"), near(1000.0).alias("thou"), near(0.01).alias("penny")
    )
    annual = F.col("u") == "annual"
    best = F.when(annual, F.least("one", "thou", "penny")).otherwise(F.col("one"))
    unit = (
        F.when(~annual, F.col("u")).when(F.col("thou") == best, "thousands").when(F.col("penny") == best, "pence").otherwise("annual")
    )
    told = m.select(key, "lo", "hi", "period", best.alias("far"), unit.alias("unit")).where("far < 0.9")
    told = told.groupBy(key, "lo", "hi", "period").agg(F.min(F.struct("far", "unit")).alias("b"))
    # rows with the same key have the same values, so the mention and the record meet in one aggregate
    plain = rows.select(key, "lo", "hi", "period", F.lit(None).cast("struct<far:double,unit:string>").alias("b"))
    both = plain.unionByName(told).groupBy(key, "lo", "hi", "period").agg(F.min("b").alias("b"))
    f = F.greatest("lo", "hi")
    whole = (F.coalesce(F.col("lo"), F.lit(0.0)) * 2 % 1 == 0) & (F.coalesce(F.col("hi"), F.lit(0.0)) * 2 % 1 == 0)
    held = F.lit(None).cast("string")
    for p, (a, b) in PLAUSIBLE.items():
        held = F.when((F.col("period") == p) & f.between(a, b), p).otherwise(held)
    return both.select(
        key, F.col("lo").alias("salary_min"), F.col("hi").alias("salary_max"),
        F.coalesce(F.col("b.unit"), held, by_size(f, whole)).alias("unit"),
    )


def to_annual(df: DataFrame) -> DataFrame:
    """Adds annual_min and annual_max in pounds a year to the rows of detect_units (factor; all offsets are 0)."""
    factor = F.lit(None).cast("double")
    for u, x in FACTORS.items():
        factor = F.when(F.col("unit") == u, x).otherwise(factor)
    return df.withColumns({"annual_min": F.col("salary_min") * factor, "annual_max": F.col("salary_max") * factor})
