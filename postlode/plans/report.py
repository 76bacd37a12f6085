"""Report assembly, archive, plans of searches, and the streaming forms as registered queries."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postlode.functions import rules
from postlode.functions import text as tx
from postlode.operators import metrics as m
from postlode.operators.quantiles import quantiles
from postlode.plans.market import SKILLS, WEEK, fact
from postlode.registry import query
from postlode.session import ensure_checkpoint_dir
from postlode.streaming import incremental as inc
from postlode.tables import table


def section(name: str, df: DataFrame) -> DataFrame:
    """A metric's few rows as one JSON array, in a fixed order."""
    rows = F.sort_array(F.collect_list(F.struct(*df.columns)))
    return df.agg(F.to_json(rows).alias("json")).select(F.lit(name).alias("section"), "json")


def market_report(spark, d) -> DataFrame:
    """(section, json): the whole report. Every section is a top-n, a week grid of a top-n or a group per category."""
    f = fact(spark, d)
    at = m.latest(table(spark, d, "job_analytics"))
    parts = {
        "top_skills": m.top_skills(f),
        "work_models": m.histogram(f, F.coalesce("work_model", F.lit("unknown")), "work_model"),
        "role_categories": m.histogram(f, F.coalesce("role_category", F.lit("Other")), "role_category"),
        "salary": m.salary_stats(f),
        "salary_by_category": m.percentile_groups(f, F.coalesce("role_category", F.lit("Other")), "category", least=m.LEAST_SAMPLE),
        "divergence": m.divergence(f, at),
        "deltas": m.deltas(f, at, ["Python"]),
        "trends": m.trend(m.skill_weeks(f, at, 12, 20), "skill"),
        "pairs": m.skill_pairs(f),
        "persistence": m.persistence(f, table(spark, d, "seen_jobs")),
        "pay_by_skill": m.pay_by_skill(f),
        "sponsorship": m.rate(f, "offers_sponsorship", "sponsoring", "citizens_only"),
        "funnel": m.funnel_averages(table(spark, d, "run_history")),
    }
    whole = None
    for name, df in parts.items():
        whole = section(name, df) if whole is None else whole.unionByName(section(name, df))
    return whole


@query("ref_a32_market_report")
def report(spark, d):
    return market_report(spark, d)


@query("ref_k05_archive", "SELECT max(id) + 1 AS id, count(*) + 1 AS reports FROM market_report")
def archive(spark, d):
    """The new report appended to the archive, in a copy of it in the shared folder."""
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/archive/{uuid.uuid4().hex}"
    old = table(spark, d, "market_report").select("id", "report_json")
    old.write.parquet(path)
    body = market_report(spark, d).agg(F.to_json(F.map_from_entries(F.sort_array(F.collect_list(F.struct("section", "json"))))).alias("report_json"))
    last = old.agg(F.max("id")).first()[0] or 0
    body.select(F.lit(last + 1).cast("bigint").alias("id"), "report_json").write.mode("append").parquet(path)
    return spark.read.parquet(path).agg(F.max("id").alias("id"), F.count(F.lit(1)).alias("reports"))


@query("ref_f28_search_plan", "SELECT role_title, city FROM role_titles CROSS JOIN (SELECT DISTINCT city FROM postcode_areas)")
def search_plan(spark, d):
    """Every role with every place of a short list."""
    cities = sorted({c for _, c in rules.area_list(table(spark, d, "postcode_areas"))})
    return table(spark, d, "role_titles").select("role_title", F.explode(F.array(*[F.lit(c) for c in cities])).alias("city"))


@query("ref_p26_metric_claims", "SELECT DISTINCT doc_id, len(list_filter(list_transform(regexp_extract_all(coalesce(text, ''), '([0-9]{1,3})%', 1), lambda x: CAST(x AS INT)), lambda x: x > 50)) AS claims FROM documents")
def metric_claims(spark, d):
    """Percentages above 50 that a text claims."""
    found = F.transform(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit("([0-9]{1,3})%"), F.lit(1)), lambda x: x.cast("int"))
    return table(spark, d, "documents").select("doc_id", F.size(F.filter(found, lambda x: x > 50)).alias("claims")).distinct()


@query(
    "ref_f24_document_text",
    f"""WITH t AS (SELECT job_id, max(description) AS description FROM raw_job GROUP BY 1)
    SELECT job_id, concat_ws(chr(10), title, company, array_to_string(list_slice({SKILLS}, 1, 6), ', '), substr(description, 1, 800)) AS text FROM job_analytics LEFT JOIN t USING (job_id)""",
)
def document_text(spark, d):
    """Text of a posting for an index: title, company, up to six skills and the head of the description, as long as the
    index takes it."""
    t = table(spark, d, "raw_job").groupBy("job_id").agg(F.max("description").alias("description"))
    return table(spark, d, "job_analytics").join(t, "job_id", "left").select("job_id", F.concat_ws("\n", "title", "company", F.array_join(F.slice(m.skills(), 1, 6), ", "), F.substring("description", 1, 800)).alias("text"))


@query("ref_w01_stream_dedup", "SELECT DISTINCT job_id FROM raw_job WHERE job_id IS NOT NULL")
def stream_dedup(spark, d):
    return inc.settle(inc.first_of_key(inc.read(spark, d, "raw_job").select("job_id", "scraped_at"), "job_id", "scraped_at", "3650 days"), "append").select("job_id")


@query("ref_w03_w04_stream_weeks", f"SELECT source, {WEEK} AS week, count(*) AS n FROM job_analytics GROUP BY 1, 2")
def stream_weeks(spark, d):
    return inc.settle(inc.weekly(inc.read(spark, d, "job_analytics"), "source", "scraped_at"), "complete").select("source", F.to_date("week").alias("week"), "n")


_H = "substr(sha256(" + " || '|' || ".join(f"regexp_replace(lower(coalesce({c}, '')), '^\\s+|\\s+$', '', 'g')" for c in ("title", "company", "location")) + "), 1, 16)"


@query("ref_w05_stream_sightings", f"SELECT {_H} AS dedup_hash, epoch_us(min(scraped_at)) AS first_us, epoch_us(max(scraped_at)) AS last_us, count(*) AS times_seen FROM raw_job GROUP BY 1")
def stream_sightings(spark, d):
    s = inc.read(spark, d, "raw_job").select(tx.dedup_hash(F.col("title"), F.col("company"), F.col("location")).alias("dedup_hash"), "scraped_at")
    r = inc.settle(inc.sightings(s, "dedup_hash", "scraped_at"), "complete")
    return r.select("dedup_hash", F.unix_micros("first_seen_at").alias("first_us"), F.unix_micros("last_seen_at").alias("last_us"), "times_seen")


_DAY = "CAST(scraped_at AT TIME ZONE 'UTC' AS DATE)"


def _look_back(days: int) -> str:
    return f"SELECT source, {_DAY} + CAST(k AS INTEGER) AS until, count(*) AS n FROM job_analytics, range(1, {days + 1}) x(k) GROUP BY 1, 2"


@query("ref_w04_stream_look_back_7", _look_back(7))
def look_back_7(spark, d):
    """Postings of a source in the seven days before every midnight."""
    return inc.settle(inc.sliding(inc.read(spark, d, "job_analytics"), "source", "scraped_at", 7), "complete").select("source", F.to_date("until").alias("until"), "n")


@query("ref_w04_stream_look_back_90", _look_back(90))
def look_back_90(spark, d):
    return inc.settle(inc.sliding(inc.read(spark, d, "job_analytics"), "source", "scraped_at", 90), "complete").select("source", F.to_date("until").alias("until"), "n")


@query("ref_j04_w02_stream_against_seen", "SELECT DISTINCT job_id FROM incoming_job WHERE job_id IS NOT NULL AND job_id NOT IN (SELECT job_id FROM seen_jobs WHERE job_id IS NOT NULL)")
def stream_against_seen(spark, d):
    """New postings checked against the seen table and against the batches before."""
    ensure_checkpoint_dir(spark)
    base = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/streams/{uuid.uuid4().hex}"
    inc.against_seen(inc.read(spark, d, "incoming_job").where("job_id is not null").select("job_id", "scraped_at"), table(spark, d, "seen_jobs"), "job_id", f"{base}/out", f"{base}/state")
    return spark.read.parquet(f"{base}/out").select("job_id")


_TOP = "row_number() OVER (ORDER BY n DESC, k) AS r"


@query(
    "ref_k11_o09_text_report",
    f"""WITH s AS (SELECT 1 AS part, k, n, {_TOP} FROM (SELECT unnest({SKILLS}) AS k, count(*) AS n FROM job_analytics WHERE json_valid(matched_skills_json) GROUP BY 1) WHERE k IS NOT NULL),
    w AS (SELECT 2 AS part, k, n, {_TOP} FROM (SELECT coalesce(work_model, 'unknown') AS k, count(*) AS n FROM job_analytics GROUP BY 1)),
    c AS (SELECT 3 AS part, k, n, {_TOP} FROM (SELECT company AS k, count(*) AS n FROM job_analytics WHERE company IS NOT NULL GROUP BY 1)),
    o AS (SELECT 4 AS part, k, n, {_TOP} FROM (SELECT source AS k, count(*) AS n FROM job_analytics WHERE source IS NOT NULL GROUP BY 1)),
    p AS (SELECT 5 AS part, k, n, {_TOP} FROM (SELECT company_stage AS k, count(*) AS n FROM job_analytics WHERE company_stage IS NOT NULL GROUP BY 1))
    SELECT part, r AS line, CASE part WHEN 1 THEN printf('  %2d. %-30s %d mentions', r, k, n) WHEN 2 THEN printf('  %-12s %d', k, n) WHEN 3 THEN printf('  %-35s %d roles', k, n) ELSE printf('  %-20s %d', k, n) END AS text
    FROM (SELECT * FROM s WHERE r <= 10 UNION ALL SELECT * FROM w UNION ALL SELECT * FROM c WHERE r <= 8 UNION ALL SELECT * FROM o UNION ALL SELECT * FROM p)""",
)
def text_report(spark, d):
    """Lines of the printed report, most frequent first: skills, work models, companies, sources, stages."""
    f = table(spark, d, "job_analytics")
    counts = lambda df, c: df.select(c.alias("k")).where("k is not null").groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    form = {1: ("  %2d. %-30s %d mentions", True, 10), 2: ("  %-12s %d", False, None), 3: ("  %-35s %d roles", False, 8), 4: ("  %-20s %d", False, None), 5: ("  %-20s %d", False, None)}
    parts = {1: counts(f, F.explode(m.skills())), 2: counts(f, F.coalesce("work_model", F.lit("unknown"))), 3: counts(f, F.col("company")), 4: counts(f, F.col("source")), 5: counts(f, F.col("company_stage"))}
    whole = None
    for part, df in parts.items():
        fmt, numbered, most = form[part]
        # a part is a top-n, or one row for each value of a short list
        lines = m.ranked(df, most).select(F.lit(part).alias("part"), F.col("r").alias("line"), F.format_string(fmt, *(["r", "k", "n"] if numbered else ["k", "n"])).alias("text"))
        whole = lines if whole is None else whole.unionByName(lines)
    return whole


@query(
    "ref_o08_slide_pay",
    "SELECT category, n, median FROM (SELECT coalesce(role_category, 'Other') AS category, count(*) AS n, CASE WHEN count(x) >= 5 THEN median(x) END AS median FROM (SELECT role_category, (coalesce(salary_annual_min, salary_annual_max) + coalesce(salary_annual_max, salary_annual_min)) / 2 AS x FROM job_analytics) GROUP BY 1) ORDER BY median DESC NULLS LAST, category LIMIT 8",
)
def slide_pay(spark, d):
    """The eight categories of highest median pay; those with too few figures have none and come last."""
    x = (F.coalesce("salary_annual_min", "salary_annual_max") + F.coalesce("salary_annual_max", "salary_annual_min")) / 2
    f = table(spark, d, "job_analytics").withColumn("category", F.coalesce("role_category", F.lit("Other")))
    median = quantiles(f, F.col("category"), x, (0.5,)).where("n >= 5").select(F.col("key").alias("category"), F.col("p")[0].alias("median"))
    g = f.groupBy("category").agg(F.count(F.lit(1)).alias("n")).join(median, "category", "left")
    return g.orderBy(F.desc_nulls_last("median"), "category").limit(8)
