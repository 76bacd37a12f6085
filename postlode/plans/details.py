"""Registered smaller operators: projections, scalar functions, thread and page filters, run states and quotas."""

from __future__ import annotations

from pyspark.sql import functions as F

from postlode.functions import rules
from postlode.operators import metrics as m
from postlode.operators import stores
from postlode.plans.market import MID, SKILLS
from postlode.registry import query
from postlode.sources import parsers as ps
from postlode.tables import table

_STARTUP = "|".join(f"(?:{p})" for p in rules.STARTUP)


@query(
    "ref_p04_enrich",
    f"""SELECT DISTINCT job_id, regexp_matches(lower(coalesce(company, '') || ' ' || coalesce(description, '')), '{_STARTUP}') AS is_startup,
    CASE {" ".join(f"WHEN regexp_matches(coalesce(title, ''), '{p}') THEN '{n}'" for n, p in rules.SENIORITY)} ELSE 'Unspecified' END AS level, upper(coalesce(source, '')) AS source FROM raw_job""",
)
def enrich(spark, d):
    """Signals as columns; the flag of the feed is overwritten."""
    j = table(spark, d, "raw_job").withColumns({"is_startup": rules.startup(F.col("description"), F.col("company")), "level": rules.seniority(F.col("title")), "source": F.upper(F.coalesce("source", F.lit("")))})
    return j.select("job_id", "is_startup", "level", "source").distinct()


@query("ref_p07_u02_keyword_set", "SELECT DISTINCT w AS keyword FROM (SELECT unnest(string_split(lower(role_title), ' ')) AS w FROM role_titles UNION ALL SELECT unnest(['machine learning', 'data', 'nlp'])) WHERE length(w) > 2")
def keyword_set(spark, d):
    own = table(spark, d, "role_titles").select(F.explode(F.array_union(F.array(F.lit("machine learning"), F.lit("data"), F.lit("nlp")), F.split(F.lower("role_title"), " "))).alias("keyword"))
    return own.where("length(keyword) > 2").distinct()


@query("ref_p19_p20_p21_midpoints", f"SELECT job_id, {MID} AS midpoint, nullif((coalesce(salary_annual_min, 0) + coalesce(salary_annual_max, 0)) / 2, 0) AS half_filled FROM job_analytics WHERE salary_period = 'annual' AND (salary_annual_min IS NOT NULL OR salary_annual_max IS NOT NULL)")
def midpoints(spark, d):
    paid = table(spark, d, "job_analytics").where("salary_period = 'annual' and (salary_annual_min is not null or salary_annual_max is not null)")
    return paid.select("job_id", m.midpoint().alias("midpoint"), m.half_filled_midpoint().alias("half_filled"))


@query("ref_p23_tristate", "SELECT DISTINCT job_id, CAST(offers_sponsorship AS INT) AS offers, CAST(employer_is_licensed_sponsor AS INT) AS licensed FROM raw_job")
def tristate(spark, d):
    return table(spark, d, "raw_job").select("job_id", F.col("offers_sponsorship").cast("int").alias("offers"), F.col("employer_is_licensed_sponsor").cast("int").alias("licensed")).distinct()


@query("ref_p27_has_skill", f"SELECT job_id, len(list_filter({SKILLS}, lambda s: contains(lower(s), 'sql'))) > 0 AS has_sql FROM job_analytics WHERE json_valid(matched_skills_json) AND {SKILLS} IS NOT NULL")
def has_skill(spark, d):
    j = table(spark, d, "job_analytics").select("job_id", m.skills().alias("s")).where("s is not null")
    return j.select("job_id", F.exists("s", lambda x: F.contains(F.lower(x), F.lit("sql"))).alias("has_sql"))


@query("ref_p30_fenced_json", "SELECT job_id, length(title) % 101 AS score FROM job_analytics WHERE length(title) % 101 BETWEEN 0 AND 100 AND company IS NOT NULL")
def fenced_json(spark, d):
    """Answers of a model: code fences stripped, parsed, and held to the schema's ranges; others are left to quarantine."""
    j = table(spark, d, "job_analytics")
    good = F.format_string("```json\n{\"overall_score\": %d}\n```", F.length("title") % 101)
    answer = F.when(F.col("company").isNull(), F.lit("no answer")).otherwise(good)
    body = F.regexp_replace(F.trim(answer), r"^```(?:json)?\s*|\s*```$", "")
    parsed = j.select("job_id", F.from_json(body, "overall_score int").alias("p"))
    return parsed.where("p.overall_score between 0 and 100").select("job_id", F.col("p.overall_score").alias("score"))


@query("ref_p31_j10_watchlist_anti", "SELECT DISTINCT company FROM incoming_job WHERE company IS NOT NULL AND company NOT IN (SELECT company FROM seen_jobs WHERE company IS NOT NULL)")
def watchlist_anti(spark, d):
    return table(spark, d, "incoming_job").where("company is not null").select("company").distinct().join(table(spark, d, "seen_jobs").select("company"), "company", "left_anti")


_KEYS = ("engineer", "data")


@query(
    "ref_s22_thread_comments",
    "SELECT seq FROM incoming_job WHERE seq <= 500 AND length(coalesce(description, '')) >= 40 AND NOT coalesce(is_startup, false) AND (contains(lower(coalesce(description, '')), 'engineer') OR contains(lower(coalesce(description, '')), 'data'))",
)
def thread_comments(spark, d):
    """A thread of the incoming postings; the limit of 500 comments is the feed's own."""
    items = table(spark, d, "incoming_job").select("seq", F.col("seq").alias("position"), F.coalesce("description", F.lit("")).alias("text"), F.col("is_startup").alias("deleted"), F.lit(False).alias("dead"))
    return ps.thread_comments(items, list(_KEYS)).select("seq")


@query("ref_k06_append_scores", "SELECT job_id, 1 AS batch FROM job_analytics UNION ALL SELECT job_id, 2 FROM incoming_job")
def append_scores(spark, d):
    return table(spark, d, "job_analytics").select("job_id", F.lit(1).alias("batch")).unionByName(table(spark, d, "incoming_job").select("job_id", F.lit(2).alias("batch")))


@query("ref_k07_run_state", "SELECT run_id, status, total_scraped FROM run_history")
def run_state(spark, d):
    """Runs as append-only start and completion events, and their latest state."""
    r = table(spark, d, "run_history")
    start = r.select("run_id", F.lit(1).alias("at"), F.lit("running").alias("status"), F.lit(None).cast("int").alias("total_scraped"))
    end = r.select("run_id", F.lit(2).alias("at"), "status", "total_scraped")
    return stores.run_state(start.unionByName(end))


@query("ref_k14_vector_upsert", "SELECT vec_id, CAST(label AS VARCHAR) || '|' || CAST(len(embedding) AS VARCHAR) AS metadata FROM embeddings")
def vector_upsert(spark, d):
    """Vectors by key, stored twice: the later metadata, joined by a bar, stays."""
    v = table(spark, d, "embeddings")
    old = v.select("vec_id", F.lit(1).alias("version"), F.lit("old").alias("metadata"))
    new = v.select("vec_id", F.lit(2).alias("version"), F.concat_ws("|", F.col("label").cast("string"), F.size("embedding").cast("string")).alias("metadata"))
    return stores.upsert_latest(old, new, "vec_id", "version").select("vec_id", "metadata")


@query("ref_t01_week_start", "SELECT job_id, CAST(date_trunc('week', scraped_at AT TIME ZONE 'UTC') AS DATE) AS week FROM job_analytics")
def week_start(spark, d):
    return table(spark, d, "job_analytics").select("job_id", m.week().alias("week"))


@query("ref_t09_week_over_week", "WITH w AS (SELECT source, CAST(date_trunc('week', scraped_at AT TIME ZONE 'UTC') AS DATE) AS week, count(*) AS n FROM job_analytics GROUP BY 1, 2) SELECT source, week, n, n - lag(n) OVER (PARTITION BY source ORDER BY week) AS change FROM w")
def week_over_week(spark, d):
    from pyspark.sql import Window

    w = table(spark, d, "job_analytics").groupBy("source", m.week().alias("week")).agg(F.count(F.lit(1)).alias("n"))
    return w.withColumn("change", F.col("n") - F.lag("n").over(Window.partitionBy("source").orderBy("week")))


@query("ref_f09_skill_tokens", "SELECT DISTINCT t AS token FROM (SELECT unnest(string_split_regex(lower(role_title), '[\\s,/+#.-]+')) AS t FROM role_titles UNION ALL SELECT lower(role_title) FROM role_titles) WHERE length(t) > 2")
def skill_tokens(spark, d):
    r = F.lower("role_title")
    return table(spark, d, "role_titles").select(F.explode(F.array_union(F.split(r, r"[\s,/+#.-]+"), F.array(r))).alias("token")).where("length(token) > 2").distinct()


@query("ref_f12_days_seen", "SELECT dedup_hash, (epoch_us(last_seen_at) - epoch_us(first_seen_at)) / 86400000000.0 AS days FROM seen_jobs WHERE last_seen_at IS NOT NULL")
def days_seen(spark, d):
    return table(spark, d, "seen_jobs").where("last_seen_at is not null").select("dedup_hash", ((F.unix_micros("last_seen_at") - F.unix_micros("first_seen_at")) / 86400000000.0).alias("days"))


@query("ref_f20_map_lookup", "SELECT job_id, CASE role_category WHEN 'Data' THEN 1 WHEN 'AI' THEN 2 ELSE 0 END AS code FROM job_analytics")
def map_lookup(spark, d):
    codes = F.create_map(F.lit("Data"), F.lit(1), F.lit("AI"), F.lit(2))
    return table(spark, d, "job_analytics").select("job_id", F.coalesce(F.try_element_at(codes, F.coalesce("role_category", F.lit(""))), F.lit(0)).alias("code"))


@query("ref_f27_file_slug", "SELECT DISTINCT job_id, substr(replace(coalesce(company, ''), ' ', '_'), 1, 20) AS slug FROM raw_job")
def file_slug(spark, d):
    return table(spark, d, "raw_job").select("job_id", F.substring(F.replace(F.coalesce("company", F.lit("")), F.lit(" "), F.lit("_")), 1, 20).alias("slug")).distinct()


@query("ref_f29_quota", "SELECT source, CAST(scraped_at AT TIME ZONE 'UTC' AS DATE) AS day, count(*) AS used, count(*) > 20 AS over FROM job_analytics GROUP BY 1, 2")
def quota(spark, d):
    g = table(spark, d, "job_analytics").groupBy("source", F.to_date("scraped_at").alias("day")).agg(F.count(F.lit(1)).alias("used"))
    return g.withColumn("over", F.col("used") > 20)
