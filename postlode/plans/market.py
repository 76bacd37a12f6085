"""Registered market metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postlode.functions import rules
from postlode.operators import metrics as m
from postlode.registry import query
from postlode.tables import table

DAYS = 90
FACT = "WITH latest AS (SELECT max(scraped_at) AS t_end FROM job_analytics), f AS (SELECT j.*, t_end FROM job_analytics j, latest WHERE j.scraped_at >= t_end - INTERVAL 90 DAY)"
SKILLS = "CASE WHEN json_valid(matched_skills_json) THEN from_json(matched_skills_json, '[\"VARCHAR\"]') END"
MID = "CASE WHEN salary_period = 'annual' THEN (coalesce(salary_annual_min, salary_annual_max) + coalesce(salary_annual_max, salary_annual_min)) / 2 END"
WEEK = "CAST(date_trunc('week', scraped_at AT TIME ZONE 'UTC') AS DATE)"
SENIORITY = "CASE " + " ".join(f"WHEN regexp_matches(coalesce(title, ''), '{p}') THEN '{n}'" for n, p in rules.SENIORITY) + " ELSE 'Unspecified' END"


def fact(spark: SparkSession, sf_dir: str) -> DataFrame:
    jobs = table(spark, sf_dir, "job_analytics")
    return m.since(jobs, m.latest(jobs), DAYS)


@query("ref_s01_lookback_scan", FACT + " SELECT job_id FROM f")
def lookback(spark, d):
    return fact(spark, d).select("job_id")


@query("ref_s02_range_scan", "SELECT job_id FROM job_analytics WHERE scraped_at >= TIMESTAMPTZ '2026-02-01 00:00:00+00' AND scraped_at < TIMESTAMPTZ '2026-03-01 00:00:00+00'")
def range_scan(spark, d):
    return m.between(table(spark, d, "job_analytics"), F.lit("2026-02-01 00:00:00").cast("timestamp"), F.lit("2026-03-01 00:00:00").cast("timestamp")).select("job_id")


@query("ref_s03_recent_runs", "SELECT run_id, total_scraped FROM run_history WHERE status = 'complete' ORDER BY started_at DESC, run_id LIMIT 20")
def recent_runs(spark, d):
    return table(spark, d, "run_history").where("status = 'complete'").orderBy(F.desc("started_at"), "run_id").limit(20).select("run_id", "total_scraped")


@query("ref_a01_top_skills", FACT + f" SELECT skill, count(*) AS n FROM (SELECT unnest({SKILLS}) AS skill FROM f) GROUP BY skill ORDER BY n DESC, skill LIMIT 10")
def a01(spark, d):
    return m.top_skills(fact(spark, d))


def _hist(name: str, column: str, fill: str | None) -> None:
    expr = f"coalesce({column}, '{fill}')" if fill else column

    @query(name, FACT + f" SELECT {expr} AS {column}, count(*) AS n FROM f GROUP BY 1")
    def run(spark, d):
        return m.histogram(fact(spark, d), F.coalesce(column, F.lit(fill)) if fill else F.col(column), column)


_hist("ref_a02_work_models", "work_model", "unknown")
_hist("ref_a08_role_categories", "role_category", "Other")
_hist("ref_a10_company_stages", "company_stage", "unknown")
_hist("ref_a20_sources", "source", None)


@query(
    "ref_a03_salary_stats",
    FACT + """ SELECT count(*) AS n, round_even(avg(salary_annual_min), 0) AS avg_min, round_even(avg(salary_annual_max), 0) AS avg_max,
    round_even(quantile_cont(nullif((coalesce(salary_annual_min, 0) + coalesce(salary_annual_max, 0)) / 2, 0), 0.5), 0) AS median
    FROM f WHERE salary_period = 'annual' AND (salary_annual_min IS NOT NULL OR salary_annual_max IS NOT NULL)""",
)
def a03(spark, d):
    return m.salary_stats(fact(spark, d))


_Q = "count(m) AS n, round(quantile_cont(m, 0.25), 2) AS p25, round(quantile_cont(m, 0.5), 2) AS p50, round(quantile_cont(m, 0.75), 2) AS p75"


@query("ref_a04_salary_percentiles", FACT + f" SELECT {_Q} FROM (SELECT {MID} AS m FROM f) WHERE m IS NOT NULL")
def a04(spark, d):
    return m.percentile_groups(fact(spark, d), None)


@query("ref_a05_salary_by_category", FACT + f" SELECT category, {_Q} FROM (SELECT coalesce(role_category, 'Other') AS category, {MID} AS m FROM f) WHERE m IS NOT NULL GROUP BY category")
def a05(spark, d):
    return m.percentile_groups(fact(spark, d), F.coalesce("role_category", F.lit("Other")), "category")


@query("ref_a06_salary_by_seniority", FACT + f" SELECT level, {_Q} FROM (SELECT {SENIORITY} AS level, {MID} AS m FROM f) WHERE m IS NOT NULL GROUP BY level")
def a06(spark, d):
    return m.percentile_groups(fact(spark, d), rules.seniority(F.col("title")), "level")


@query(
    "ref_p32_suppressed_percentiles",
    FACT + f""" , q AS (SELECT region, count(m) AS n, quantile_cont(m, [0.25, 0.5, 0.75]) AS p FROM (SELECT company AS region, {MID} AS m FROM f) WHERE m IS NOT NULL GROUP BY region)
    SELECT region AS company, n, CASE WHEN n >= 5 THEN round(p[1], 2) END AS p25, CASE WHEN n >= 5 THEN round(p[2], 2) END AS p50, CASE WHEN n >= 5 THEN round(p[3], 2) END AS p75, n < 5 AS suppressed FROM q""",
)
def p32(spark, d):
    return m.percentile_groups(fact(spark, d), F.col("company"), "company", least=m.LEAST_SAMPLE)


@query(
    "ref_a07_salary_divergence",
    FACT + f""", q AS (SELECT quantile_cont({MID}, 0.5) FILTER (WHERE scraped_at >= t_end - INTERVAL 7 DAY) AS weekly, quantile_cont({MID}, 0.5) AS rolling FROM f)
    SELECT weekly, rolling, round(abs(weekly - rolling) / nullif(rolling, 0), 4) AS ratio, coalesce(abs(weekly - rolling) / nullif(rolling, 0) > 0.15, false) AS diverged FROM q""",
)
def a07(spark, d):
    jobs = table(spark, d, "job_analytics")
    return m.divergence(fact(spark, d), m.latest(jobs))


@query(
    "ref_a09_top_regions",
    FACT + """ SELECT region, count(*) AS n FROM (SELECT coalesce(region, CASE WHEN trim(coalesce(location, '')) = '' THEN 'Unknown' WHEN regexp_matches(location, '(?i)\\bremote\\b|\\bwfh\\b') THEN 'Remote' ELSE 'Other UK' END) AS region FROM f)
    GROUP BY region ORDER BY n DESC, region LIMIT 10""",
)
def a09(spark, d):
    loc = F.coalesce("location", F.lit(""))
    live = F.when(F.trim(loc) == "", "Unknown").when(loc.rlike(r"(?i)\bremote\b|\bwfh\b"), "Remote").otherwise("Other UK")
    return m.top(m.histogram(fact(spark, d), F.coalesce("region", live), "region"), "region", 10)


@query(
    "ref_a12_metric_deltas",
    FACT + f""", w AS (SELECT *, scraped_at >= t_end - INTERVAL 7 DAY AND scraped_at < t_end AS c, scraped_at >= t_end - INTERVAL 14 DAY AND scraped_at < t_end - INTERVAL 7 DAY AS p, {MID} AS m, {SKILLS} AS s FROM f),
    v AS (
      SELECT 'total_volume' AS metric, nullif(count_if(c), 0)::DOUBLE AS current, nullif(count_if(p), 0)::DOUBLE AS previous FROM w
      UNION ALL SELECT 'sponsorship_rate', round_even(100 * count_if(c AND offers_sponsorship = 1) / nullif(count_if(c), 0), 1), round_even(100 * count_if(p AND offers_sponsorship = 1) / nullif(count_if(p), 0), 1) FROM w
      UNION ALL SELECT 'startup_share', round_even(100 * count_if(c AND is_startup = 1) / nullif(count_if(c), 0), 1), round_even(100 * count_if(p AND is_startup = 1) / nullif(count_if(p), 0), 1) FROM w
      UNION ALL SELECT 'salary_median', quantile_cont(m, 0.5) FILTER (WHERE c), quantile_cont(m, 0.5) FILTER (WHERE p) FROM w
      UNION ALL SELECT 'Python', CASE WHEN count_if(c) > 0 THEN count_if(c AND list_contains(s, 'Python')) END, CASE WHEN count_if(p) > 0 THEN count_if(p AND list_contains(s, 'Python')) END FROM w)
    SELECT metric, current, previous, round_even(current - previous, 2) AS abs_change, round_even(100 * round_even(current - previous, 2) / nullif(previous, 0), 1) AS pct_change,
    CASE WHEN current IS NULL OR previous IS NULL THEN 'unknown' WHEN current > previous THEN 'up' WHEN current < previous THEN 'down' ELSE 'flat' END AS direction FROM v""",
)
def a12(spark, d):
    jobs = table(spark, d, "job_analytics")
    return m.deltas(fact(spark, d), m.latest(jobs), ["Python"])


_GRID = (
    FACT + f""", e AS (SELECT {WEEK} AS week, unnest({SKILLS}) AS skill FROM f WHERE scraped_at >= t_end - INTERVAL 84 DAY),
    t AS (SELECT skill FROM e GROUP BY skill ORDER BY count(*) DESC, skill LIMIT 20), g AS (
    SELECT t.skill, w.week, coalesce(n, 0) AS n FROM t CROSS JOIN (SELECT DISTINCT week FROM e) w
    LEFT JOIN (SELECT skill, week, count(*) AS n FROM e GROUP BY 1, 2) k ON k.skill = t.skill AND k.week = w.week)"""
)


@query("ref_a13_skill_weekly_grid", _GRID + " SELECT skill, week, n FROM g")
def a13(spark, d):
    jobs = table(spark, d, "job_analytics")
    return m.skill_weeks(fact(spark, d), m.latest(jobs), 12, 20)


_TREND = """ , x AS (SELECT *, row_number() OVER (PARTITION BY skill ORDER BY week) - 1 AS x, row_number() OVER (PARTITION BY skill ORDER BY week DESC) AS b FROM g),
    s AS (SELECT skill, count(*) AS weeks, sum(n) AS total, max(n) FILTER (WHERE b = 1) AS now, CASE WHEN count(*) < 2 OR min(n) = max(n) THEN 0.0 ELSE regr_slope(n, x) END AS slope,
    CASE WHEN count(*) < 2 OR min(n) = max(n) THEN 0.0 ELSE regr_r2(n, x) END AS r2, weeks > 2 AND total = now AND now > 0 AS new FROM x GROUP BY skill)
    SELECT skill, weeks, CASE WHEN new THEN 'New' WHEN r2 > 0.8 AND slope > 0 THEN 'Accelerating' WHEN r2 > 0.8 AND slope < 0 THEN 'Cooling' WHEN abs(slope) < 0.3 THEN 'Stable' WHEN slope < 0 THEN 'Cooling' ELSE 'Accelerating' END AS trend,
    CASE WHEN new THEN 0.0 ELSE round(slope, 3) END AS slope, CASE WHEN new THEN 0.0 ELSE round(r2, 3) END AS r_squared FROM s"""


@query("ref_a14_skill_trajectories", _GRID + _TREND)
def a14(spark, d):
    return m.trend(a13(spark, d), "skill")


@query(
    "ref_a15_rising_cooling",
    _GRID + """, x AS (SELECT *, row_number() OVER (PARTITION BY skill ORDER BY week DESC) AS b FROM g),
    s AS (SELECT skill, count(*) AS k, avg(n) AS mean, max(n) FILTER (WHERE b = 1) AS now, regr_slope(n, -b) AS slope FROM x WHERE b <= 3 GROUP BY skill)
    SELECT skill, CASE WHEN k < 3 THEN 'Stable' WHEN slope > 1e-9 AND now >= mean THEN 'Rising' WHEN slope < -1e-9 AND now <= mean THEN 'Cooling' ELSE 'Stable' END AS label FROM s""",
)
def a15(spark, d):
    return m.rising(a13(spark, d), "skill")


_hist("ref_a22_periods", "salary_period", "unknown")


def _rate(name: str, column: str, yes: str, no: str) -> None:
    @query(name, FACT + f""", c AS (SELECT count(*) AS total, count_if({column} = 1) AS y, count_if({column} = 0) AS z FROM f)
    SELECT total, y AS {yes}, round_even(100 * y / total, 1) AS {yes}_pct, z AS {no}, total - y - z AS unknown FROM c""")
    def run(spark, d):
        return m.rate(fact(spark, d), column, yes, no)


_rate("ref_a16_sponsorship_rate", "offers_sponsorship", "sponsoring", "citizens_only")
_rate("ref_a17_register_rate", "employer_is_licensed_sponsor", "licensed", "not_licensed")
_rate("ref_a18_startup_ratio", "is_startup", "startup", "other")


@query("ref_a19_top_companies", FACT + " SELECT company, count(*) AS n FROM f WHERE company IS NOT NULL GROUP BY company ORDER BY n DESC, company LIMIT 10")
def a19(spark, d):
    return m.top(m.histogram(fact(spark, d).where("company is not null"), F.col("company"), "company"), "company", 10)


@query(
    "ref_a23_skill_pairs",
    FACT + f""", s AS (SELECT job_id, unnest(list_distinct({SKILLS})) AS skill FROM f)
    SELECT * FROM (SELECT a.skill AS skill_a, b.skill AS skill_b, count(*) AS n FROM s a JOIN s b ON a.job_id = b.job_id AND a.skill < b.skill GROUP BY 1, 2 ORDER BY n DESC, skill_a, skill_b LIMIT 15) WHERE n >= 3""",
)
def a23(spark, d):
    return m.skill_pairs(fact(spark, d))


@query(
    "ref_a24_persistence",
    FACT + """ SELECT coalesce(role_category, 'Other') AS category, round(quantile_cont((epoch_us(last_seen_at) - epoch_us(first_seen_at)) / 86400000000.0, 0.5), 4) AS median_days, count(*) AS n
    FROM f JOIN seen_jobs USING (dedup_hash) GROUP BY 1""",
)
def a24(spark, d):
    return m.persistence(fact(spark, d), table(spark, d, "seen_jobs"))


@query(
    "ref_a25_salary_by_skill",
    FACT + f""", p AS (SELECT {MID} AS m, list_distinct({SKILLS}) AS s FROM f), k AS (SELECT quantile_cont(m, 0.5) AS market FROM p),
    u AS (SELECT m, unnest(s) AS skill FROM p WHERE m IS NOT NULL), g AS (SELECT skill, count(*) AS n, quantile_cont(m, 0.5) AS md FROM u GROUP BY skill HAVING count(*) >= 15)
    SELECT skill, n, round(md, 2) AS median_salary, round(market, 2) AS market_median, round_even(100 * (md - market) / market, 1) AS premium_pct FROM g, k""",
)
def a25(spark, d):
    return m.pay_by_skill(fact(spark, d))


@query(
    "ref_a26_work_model_trend",
    FACT + f""", e AS (SELECT {WEEK} AS week, coalesce(work_model, 'unknown') AS work_model FROM f WHERE scraped_at >= t_end - INTERVAL 84 DAY)
    SELECT k.work_model, w.week, coalesce(n, 0) AS n FROM (SELECT DISTINCT work_model FROM e) k CROSS JOIN (SELECT DISTINCT week FROM e) w
    LEFT JOIN (SELECT work_model, week, count(*) AS n FROM e GROUP BY 1, 2) c ON c.work_model = k.work_model AND c.week = w.week""",
)
def a26(spark, d):
    jobs = table(spark, d, "job_analytics")
    recent = fact(spark, d).where(F.col("scraped_at") >= F.lit(m.latest(jobs)) - F.expr("INTERVAL 84 DAYS"))
    return m.dense_weeks(recent.select(m.week().alias("week"), F.coalesce("work_model", F.lit("unknown")).alias("work_model")), "work_model", None)


_DROPS = ", ".join(f"round_even(100 * ({a} - {b}) / nullif({a}, 0), 1) AS {a}_to_{b}" for a, b in zip(m.STAGES, m.STAGES[1:], strict=False))
_FUNNEL = f"SELECT run_id, {', '.join(m.STAGES)}, {_DROPS} FROM (SELECT * FROM run_history WHERE status = 'complete' ORDER BY started_at DESC, run_id LIMIT 10)"


@query("ref_a27_funnel", _FUNNEL)
def a27(spark, d):
    return m.funnel(table(spark, d, "run_history"))


@query("ref_a27_funnel_averages", f"SELECT count(*) AS n_runs, {', '.join(f'round_even(avg({c}), 1) AS {c}' for c in [*m.STAGES, *[f'{a}_to_{b}' for a, b in zip(m.STAGES, m.STAGES[1:], strict=False)]])} FROM ({_FUNNEL})")
def a27_averages(spark, d):
    return m.funnel_averages(table(spark, d, "run_history"))


@query("ref_t05_weekly_series", f"SELECT {WEEK} AS week, count(*) AS n, sum(salary_annual_min) AS pay FROM job_analytics GROUP BY 1")
def t05(spark, d):
    return table(spark, d, "job_analytics").groupBy(m.week().alias("week")).agg(F.count(F.lit(1)).alias("n"), F.sum("salary_annual_min").alias("pay"))


@query("ref_w03_weekly_windows", f"SELECT source, {WEEK} AS week, count(*) AS n FROM job_analytics GROUP BY 1, 2")
def w03(spark, d):
    w = F.window("scraped_at", "7 days", "7 days", "4 days")
    return table(spark, d, "job_analytics").groupBy("source", w.alias("w")).agg(F.count(F.lit(1)).alias("n")).select("source", F.to_date("w.start").alias("week"), "n")


@query(
    "ref_p33_finite_values",
    "SELECT count(*) AS rows_checked, bool_and(salary_annual_min IS NULL OR isfinite(salary_annual_min)) AS finite FROM job_analytics",
)
def p33(spark, d):
    x = F.col("salary_annual_min")
    fine = x.isNull() | ~(F.isnan(x) | (F.abs(x) == float("inf")))
    return table(spark, d, "job_analytics").agg(F.count(F.lit(1)).alias("rows_checked"), F.bool_and(fine).alias("finite"))
