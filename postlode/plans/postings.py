"""Registered rules, stores, deduplication and scores over postings."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from postlode.functions import rules
from postlode.functions import text as tx
from postlode.operators import similarity as sim
from postlode.operators import stores
from postlode.registry import query
from postlode.tables import JOB_ANALYTICS, conform, table


def _case(pairs, subject: str, otherwise: str) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches({subject}, '{p}') THEN {v}" for p, v in pairs) + f" ELSE {otherwise} END"


_D = "lower(coalesce(description, ''))"
_GOOD = "CASE " + " ".join(f"WHEN regexp_matches({_D}, '{p}') AND NOT regexp_matches({_D}, '{rules.NEGATION}{p}') THEN regexp_extract({_D}, '{p}', 0)" for p in rules.SPONSOR_POSITIVE) + " END"
_BAD = "CASE " + " ".join(f"WHEN regexp_matches({_D}, '{p}') THEN regexp_extract({_D}, '{p}', 0)" for p in rules.SPONSOR_NEGATIVE) + " END"
_SIGNAL_TEXT = "concat_ws(' ', description, array_to_string(sponsorship_signals, '. '))"


@query(
    "ref_p01_p02_sponsorship",
    f"SELECT job_id, {_GOOD} IS NOT NULL AS offers, {_BAD} IS NOT NULL AS citizens_only, coalesce({_GOOD}, '') || '|' || coalesce({_BAD}, '') AS phrases FROM (SELECT DISTINCT job_id, {_SIGNAL_TEXT} AS description FROM raw_job)",
)
def sponsorship(spark, d):
    jobs = table(spark, d, "raw_job").select("job_id", F.concat_ws(" ", "description", F.array_join("sponsorship_signals", ". ")).alias("t")).distinct()
    good, bad, phrases = rules.sponsorship(F.col("t"))
    first = F.when(good.isNotNull(), phrases[0]).otherwise("")
    second = F.when(bad.isNotNull(), F.element_at(phrases, -1)).otherwise("")
    return jobs.select("job_id", good.isNotNull().alias("offers"), bad.isNotNull().alias("citizens_only"), F.concat(first, F.lit("|"), second).alias("phrases"))


@query("ref_p03_startup", "SELECT DISTINCT job_id, regexp_matches(lower(coalesce(company, '') || ' ' || coalesce(description, '')), '" + "|".join(f"(?:{p})" for p in rules.STARTUP) + "') AS startup FROM raw_job")
def startup(spark, d):
    return table(spark, d, "raw_job").select("job_id", rules.startup(F.col("description"), F.col("company")).alias("startup")).distinct()


@query(
    "ref_p05_work_model",
    f"""SELECT DISTINCT job_id, CASE WHEN contains(t, 'remote') THEN 'remote' WHEN contains(t, 'hybrid') THEN 'hybrid'
    WHEN regexp_matches(t, CASE WHEN source = 'adzuna' THEN '{rules.ONSITE["adzuna"]}' WHEN source = 'hn_who_is_hiring' THEN '{rules.ONSITE["hn_who_is_hiring"]}' ELSE 'on-?site' END) THEN 'onsite' ELSE 'unknown' END AS model
    FROM (SELECT job_id, source, lower(concat_ws(' ', title, location, description)) AS t FROM raw_job)""",
)
def work_model(spark, d):
    return table(spark, d, "raw_job").select("job_id", rules.work_model(F.concat_ws(" ", "title", "location", "description"), F.col("source")).alias("model")).distinct()


_KEYWORDS = ("machine learning", "data", "engineer", "c++", "nlp")


@query("ref_p06_keyword_filter", "SELECT DISTINCT job_id FROM raw_job WHERE " + " OR ".join(f"contains(lower(concat_ws(' ', title, description)), '{k}')" for k in _KEYWORDS))
def keywords(spark, d):
    t = F.lower(F.concat_ws(" ", "title", "description"))
    return table(spark, d, "raw_job").where(F.exists(F.array(*[F.lit(k) for k in _KEYWORDS]), lambda k: F.contains(t, k))).select("job_id").distinct()


@query("ref_p08_role_category", "SELECT DISTINCT job_id, " + _case([(p, f"'{n}'") for n, p in rules.ROLES], "coalesce(title, '')", _case([(p, f"'{n}'") for n, p in rules.ROLES], "coalesce(description, '')", "'Other'")) + " AS category FROM raw_job")
def role_category(spark, d):
    return table(spark, d, "raw_job").select("job_id", rules.role_category(F.col("title"), F.col("description")).alias("category")).distinct()


@query("ref_p09_seniority", "SELECT DISTINCT job_id, " + _case([(p, f"'{n}'") for n, p in rules.SENIORITY], "coalesce(title, '')", "'Unspecified'") + " AS level FROM raw_job")
def seniority(spark, d):
    return table(spark, d, "raw_job").select("job_id", rules.seniority(F.col("title")).alias("level")).distinct()


@query(
    "ref_p10_place",
    f"""WITH c AS (SELECT DISTINCT city FROM postcode_areas), l AS (SELECT DISTINCT location FROM raw_job),
    n AS (SELECT l.location, arg_min(city, struct_pack(a := -length(city), b := city)) AS city FROM l JOIN c ON contains(lower(l.location), lower(c.city)) GROUP BY 1),
    p AS (SELECT l.location, CASE WHEN trim(coalesce(l.location, '')) = '' THEN 'Unknown' ELSE coalesce(a.city, n.city, CASE WHEN regexp_matches(l.location, '{rules.REMOTE}') THEN 'Remote' ELSE 'Other UK' END) END AS place
    FROM l LEFT JOIN postcode_areas a ON a.area = upper(regexp_extract(l.location, '{rules.POSTCODE}', 1)) LEFT JOIN n ON n.location = l.location)
    SELECT DISTINCT job_id, place FROM raw_job r JOIN p ON p.location IS NOT DISTINCT FROM r.location""",
)
def place(spark, d):
    areas = rules.area_list(table(spark, d, "postcode_areas"))
    return table(spark, d, "raw_job").select("job_id", rules.place(F.col("location"), areas).alias("place")).distinct()


_PERIOD = f"""CASE WHEN salary_min IS NULL AND salary_max IS NULL THEN 'unknown' WHEN regexp_matches(t, '{rules.DAILY}') THEN 'daily' WHEN regexp_matches(t, '{rules.HOURLY}') THEN 'hourly'
    WHEN regexp_matches(t, '{rules.ANNUAL}') THEN 'annual' WHEN greatest(salary_min, salary_max) < 5000 THEN 'unknown' ELSE 'annual' END"""


@query("ref_p11_salary_period", f"SELECT DISTINCT job_id, {_PERIOD} AS period FROM (SELECT *, concat_ws(' ', title, description) AS t FROM raw_job)")
def salary_period(spark, d):
    return table(spark, d, "raw_job").select("job_id", rules.salary_period(F.concat_ws(" ", "title", "description"), F.col("salary_min"), F.col("salary_max")).alias("period")).distinct()


def _year(c: str) -> str:
    y = f"CASE WHEN p = 'annual' THEN {c} WHEN p = 'daily' AND {c} <= 3000 THEN {c} * 220 WHEN p = 'hourly' AND {c} <= 500 THEN {c} * 1650 END"
    return f"CASE WHEN {y} >= 5000 THEN {y} END"


@query("ref_p12_annualise", f"SELECT DISTINCT job_id, {_year('salary_min')} AS annual_min, {_year('salary_max')} AS annual_max FROM (SELECT *, {_PERIOD} AS p FROM (SELECT *, concat_ws(' ', title, description) AS t FROM raw_job))")
def annualise(spark, d):
    p = rules.salary_period(F.concat_ws(" ", "title", "description"), F.col("salary_min"), F.col("salary_max"))
    j = table(spark, d, "raw_job").withColumn("p", p)
    return j.select("job_id", rules.annualise(F.col("salary_min"), F.col("p")).alias("annual_min"), rules.annualise(F.col("salary_max"), F.col("p")).alias("annual_max")).distinct()


_HASH = "substr(sha256(" + " || '|' || ".join(f"regexp_replace(lower(coalesce({c}, '')), '^\\s+|\\s+$', '', 'g')" for c in ("title", "company", "location")) + "), 1, 16)"


@query("ref_p13_dedup_hash", f"SELECT DISTINCT job_id, {_HASH} AS dedup_hash FROM raw_job")
def dedup_hash(spark, d):
    return table(spark, d, "raw_job").select("job_id", tx.dedup_hash(F.col("title"), F.col("company"), F.col("location")).alias("dedup_hash")).distinct()


@query(
    "ref_p14_salary_display",
    """SELECT DISTINCT job_id, CASE WHEN coalesce(salary_min, 0) <> 0 AND coalesce(salary_max, 0) <> 0 THEN '£' || format('{:,.0f}', salary_min) || ' - £' || format('{:,.0f}', salary_max)
    WHEN coalesce(salary_min, 0) <> 0 THEN '£' || format('{:,.0f}', salary_min) || '+' ELSE 'Not disclosed' END AS display FROM raw_job""",
)
def salary_display(spark, d):
    has = lambda c: F.coalesce(F.col(c), F.lit(0.0)) != 0
    money = lambda c: F.concat(F.lit("£"), F.format_number(c, 0))
    show = F.when(has("salary_min") & has("salary_max"), F.concat(money("salary_min"), F.lit(" - "), money("salary_max"))).when(has("salary_min"), F.concat(money("salary_min"), F.lit("+"))).otherwise("Not disclosed")
    return table(spark, d, "raw_job").select("job_id", show.alias("display")).distinct()


_INVENTORY = ("Python", "SQL", "Docker", "Kafka", "Spark", "dbt", "Kubernetes", "Machine Learning")


@query(
    "ref_p22_matched_skills",
    "SELECT DISTINCT job_id, array_to_string(list_filter([" + ", ".join(f"'{s}'" for s in _INVENTORY) + "], lambda s: list_contains(w, lower(s))), ',') AS skills FROM (SELECT job_id, string_split_regex(lower(concat_ws(' ', title, description)), '\\s+') AS w FROM raw_job)",
)
def matched_skills(spark, d):
    w = tx.words(F.concat_ws(" ", "title", "description"))
    j = table(spark, d, "raw_job").select("job_id", w.alias("w"))
    return j.select("job_id", F.array_join(F.filter(F.array(*[F.lit(s) for s in _INVENTORY]), lambda s: F.array_contains(F.col("w"), F.lower(s))), ",").alias("skills")).distinct()


# \\b and \\s of the two engines differ beyond ASCII: other signs are read as blanks on both sides.
_ASCII = "regexp_replace(coalesce({c}, ''), '[^ -~]', ' ', 'g')"


def _ascii(c: str):
    return F.regexp_replace(F.coalesce(c, F.lit("")), "[^ -~]", " ")


@query(
    "ref_f06_company_key",
    f"""SELECT DISTINCT job_id, trim(regexp_replace(regexp_replace(regexp_replace(lower({_ASCII.format(c='company')}),
    '\\b(limited|ltd|llp|plc|inc|incorporated|corp|corporation|t\\s*/\\s*a|trading\\s+as)\\b\\.?', ' ', 'g'), '[^a-z0-9\\s]', ' ', 'g'), '\\s+', ' ', 'g')) AS key FROM raw_job""",
)
def company_key(spark, d):
    return table(spark, d, "raw_job").select("job_id", tx.company_key(_ascii("company")).alias("key")).distinct()


@query("ref_f08_tokens", f"SELECT DISTINCT job_id, len(t) AS n, len(list_distinct(t)) AS different FROM (SELECT job_id, regexp_extract_all(lower({_ASCII.format(c='title')}), '\\b[a-z][a-z0-9+#.\\-]{{1,}}\\b') AS t FROM raw_job)")
def tokens(spark, d):
    j = table(spark, d, "raw_job").select("job_id", tx.tokens(_ascii("title")).alias("t"))
    return j.select("job_id", F.size("t").alias("n"), F.size(F.array_distinct("t")).alias("different")).distinct()


@query(
    "ref_f04_s10_shingles",
    """WITH t AS (SELECT DISTINCT job_id, list_filter(string_split(trim(regexp_replace(regexp_replace(lower(coalesce(company, '') || ' ' || substr(coalesce(description, ''), 1, 200)), '[^a-z0-9\\s]', ' ', 'g'), '\\s+', ' ', 'g')), ' '), lambda x: x <> '') AS w FROM raw_job)
    SELECT job_id, CASE WHEN len(w) = 0 THEN 0 WHEN len(w) < 4 THEN 1 ELSE len(list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')))) END AS shingles FROM t""",
)
def shingles(spark, d):
    j = table(spark, d, "raw_job").select("job_id", tx.shingle_text(F.col("company"), F.col("description")).alias("t")).distinct()
    return j.select("job_id", F.size(tx.word_shingles(F.col("t"))).alias("shingles"))


@query("ref_t07_first_by_hash", f"WITH h AS (SELECT job_id, scraped_at, {_HASH} AS h FROM raw_job) SELECT h AS dedup_hash, arg_min(job_id, struct_pack(a := scraped_at, b := job_id)) AS job_id FROM h GROUP BY 1")
def first_by_hash(spark, d):
    j = table(spark, d, "raw_job").select(tx.dedup_hash(F.col("title"), F.col("company"), F.col("location")).alias("dedup_hash"), "job_id", "scraped_at")
    return stores.first_by(j, ["dedup_hash"], [F.col("scraped_at"), F.col("job_id")]).select("dedup_hash", "job_id")


_INC = f"SELECT job_id, scraped_at, {_HASH} AS dedup_hash FROM incoming_job"


def incoming(spark, d) -> DataFrame:
    return table(spark, d, "incoming_job").select("job_id", "scraped_at", tx.dedup_hash(F.col("title"), F.col("company"), F.col("location")).alias("dedup_hash"))


@query("ref_j04_u05_unseen", f"WITH i AS ({_INC}) SELECT job_id FROM i WHERE dedup_hash NOT IN (SELECT dedup_hash FROM seen_jobs)")
def unseen(spark, d):
    return stores.unseen(incoming(spark, d), table(spark, d, "seen_jobs"), "dedup_hash").select("job_id")


@query("ref_s05_is_seen", f"WITH i AS ({_INC}) SELECT i.job_id, s.dedup_hash IS NOT NULL AS seen FROM i LEFT JOIN seen_jobs s USING (dedup_hash)")
def is_seen(spark, d):
    s = table(spark, d, "seen_jobs").select("dedup_hash", F.lit(True).alias("seen"))
    return incoming(spark, d).join(s, "dedup_hash", "left").select("job_id", F.coalesce("seen", F.lit(False)).alias("seen"))


@query("ref_s09_total_seen", "SELECT count(*) AS total FROM seen_jobs")
def total_seen(spark, d):
    return table(spark, d, "seen_jobs").agg(F.count(F.lit(1)).alias("total"))


@query(
    "ref_k01_insert_ignore",
    "SELECT job_id, source, 0 AS fresh FROM job_analytics UNION ALL SELECT DISTINCT job_id, source, 1 FROM raw_job WHERE job_id NOT IN (SELECT job_id FROM job_analytics)",
)
def insert_ignore(spark, d):
    present = table(spark, d, "job_analytics").select("job_id", "source", F.lit(0).alias("fresh"))
    new = table(spark, d, "raw_job").select("job_id", "source", F.lit(1).alias("fresh"))
    return stores.insert_ignore(present, new, "job_id")


@query(
    "ref_k02_w05_upsert_seen",
    f"""SELECT dedup_hash, epoch_us(min(a)) AS first_us, epoch_us(max(b)) AS last_us, sum(n)::BIGINT AS times_seen FROM (
    SELECT dedup_hash, first_seen_at AS a, last_seen_at AS b, coalesce(times_seen, 1) AS n FROM seen_jobs UNION ALL SELECT dedup_hash, scraped_at, scraped_at, 1 FROM ({_INC})) GROUP BY dedup_hash""",
)
def upsert_seen(spark, d):
    r = stores.upsert_seen(table(spark, d, "seen_jobs"), incoming(spark, d).select("dedup_hash", F.col("scraped_at").alias("at")))
    return r.select("dedup_hash", F.unix_micros("first_seen_at").alias("first_us"), F.unix_micros("last_seen_at").alias("last_us"), "times_seen")


_CACHE = "SELECT dedup_hash, times_seen AS score, first_seen_at AS cached_at, first_seen_at + INTERVAL 14 DAY AS expires_at FROM seen_jobs"
_AT = "TIMESTAMPTZ '2026-05-01 00:00:00+00'"


def cache(spark, d) -> DataFrame:
    return table(spark, d, "seen_jobs").select("dedup_hash", F.col("times_seen").alias("score"), F.col("first_seen_at").alias("cached_at"), (F.col("first_seen_at") + F.expr("INTERVAL 14 DAYS")).alias("expires_at"))




@query("ref_s06_j09_cache_lookup", f"WITH c AS ({_CACHE}), i AS ({_INC}) SELECT i.job_id, c.score FROM i LEFT JOIN c ON c.dedup_hash = i.dedup_hash AND c.expires_at > {_AT}")
def cache_lookup(spark, d):
    alive = stores.alive(cache(spark, d), F.lit("2026-05-01 00:00:00").cast("timestamp"))
    return incoming(spark, d).join(alive, "dedup_hash", "left").select("job_id", "score")


@query("ref_k04_w02_evict", f"WITH c AS ({_CACHE}) SELECT count_if(expires_at <= {_AT}) AS evicted FROM c")
def evict(spark, d):
    return stores.evict(cache(spark, d), F.lit("2026-05-01 00:00:00").cast("timestamp"))[1]


@query("ref_k03_upsert_cache", f"WITH c AS ({_CACHE}), u AS (SELECT dedup_hash, 0 AS score, scraped_at AS cached_at FROM ({_INC}) UNION ALL SELECT dedup_hash, score, cached_at FROM c) SELECT dedup_hash, epoch_us(max(cached_at)) AS us FROM u GROUP BY 1")
def upsert_cache(spark, d):
    old = cache(spark, d).select("dedup_hash", "score", "cached_at")
    new = incoming(spark, d).select("dedup_hash", F.lit(0).alias("score"), F.col("scraped_at").alias("cached_at"))
    return stores.upsert_latest(old, new, "dedup_hash", "cached_at").select("dedup_hash", F.unix_micros("cached_at").alias("us"))


@query("ref_s07_latest_report", "SELECT id, window_days FROM market_report ORDER BY id DESC LIMIT 1")
def latest_report(spark, d):
    return table(spark, d, "market_report").orderBy(F.desc("id")).limit(1).select("id", "window_days")


@query("ref_s08_archive_list", "SELECT id, CAST(report_json->>'total_jobs' AS INT) AS total_jobs, CAST(report_json->'salary_by_category'->'Data'->>'p50' AS DOUBLE) AS data_p50 FROM market_report")
def archive_list(spark, d):
    r = table(spark, d, "market_report")
    return r.orderBy("id").select("id", F.get_json_object("report_json", "$.total_jobs").try_cast("int").alias("total_jobs"), F.get_json_object("report_json", "$.salary_by_category.Data.p50").try_cast("double").alias("data_p50"))


@query("ref_k15_conform", "SELECT job_id, source, CAST(NULL AS VARCHAR) AS run_id, CAST(NULL AS INTEGER) AS is_startup FROM raw_job")
def conformed(spark, d):
    """Columns that an older file lacks come as typed NULLs."""
    return conform(table(spark, d, "raw_job").drop("is_startup"), JOB_ANALYTICS).select("job_id", "source", "run_id", "is_startup")


# Scores of a matcher are no table here: a figure derived from each posting stands for them.
_SCORES = "SELECT job_id, run_id, company, is_startup, offers_sponsorship, scraped_at, (length(title) * 37 + length(coalesce(company, '')) * 11) % 101 AS score, CASE (length(title) % 4) WHEN 0 THEN 'ml' WHEN 1 THEN 'data' WHEN 2 THEN 'platform' END AS cv_variant FROM job_analytics"


def scores(spark, d) -> DataFrame:
    j = table(spark, d, "job_analytics")
    n = F.length("title") % 4
    return j.select("job_id", "run_id", "company", "is_startup", "offers_sponsorship", "scraped_at", ((F.length("title") * 37 + F.length(F.coalesce("company", F.lit(""))) * 11) % 101).alias("score"),
                    F.when(n == 0, "ml").when(n == 1, "data").when(n == 2, "platform").alias("cv_variant"))


@query("ref_s04_j01_scores_of_runs", f"SELECT s.job_id, s.score FROM ({_SCORES}) s JOIN run_history r USING (run_id) WHERE r.status = 'complete'")
def scores_of_runs(spark, d):
    runs = table(spark, d, "run_history").where("status = 'complete'").select("run_id")
    return scores(spark, d).join(runs, "run_id").select("job_id", "score")


@query("ref_a21_score_trend", f"SELECT run_id, strftime(r.started_at AT TIME ZONE 'UTC', '%Y-%m-%d') AS day, round_even(avg(score), 1) AS average, count(*) AS n, max(score) AS best FROM ({_SCORES}) JOIN run_history r USING (run_id) GROUP BY run_id, r.started_at ORDER BY r.started_at DESC LIMIT 10")
def score_trend(spark, d):
    runs = table(spark, d, "run_history").select("run_id", "started_at")
    g = scores(spark, d).join(runs, "run_id").groupBy("run_id", "started_at").agg(F.bround(F.avg("score"), 1).alias("average"), F.count(F.lit(1)).alias("n"), F.max("score").alias("best"))
    return g.orderBy(F.desc("started_at"), "run_id").limit(10).select("run_id", F.date_format("started_at", "yyyy-MM-dd").alias("day"), "average", "n", "best")


@query("ref_a22_variants", f"SELECT cv_variant, count(*) AS n FROM ({_SCORES}) WHERE cv_variant IS NOT NULL GROUP BY 1")
def variants(spark, d):
    return scores(spark, d).where("cv_variant is not null").groupBy("cv_variant").agg(F.count(F.lit(1)).alias("n"))


@query("ref_a28_j03_recent_scores", f"SELECT count(*) AS n, round_even(coalesce(avg(score), 0), 1) AS average, coalesce(min(score), 0) AS lowest, coalesce(max(score), 0) AS best FROM ({_SCORES}) WHERE run_id IN (SELECT run_id FROM run_history ORDER BY started_at DESC, run_id LIMIT 5)")
def recent_scores(spark, d):
    last = table(spark, d, "run_history").orderBy(F.desc("started_at"), "run_id").limit(5).select("run_id")
    s = scores(spark, d).join(last, "run_id", "left_semi")
    return s.agg(F.count(F.lit(1)).alias("n"), F.bround(F.coalesce(F.avg("score"), F.lit(0.0)), 1).alias("average"), F.coalesce(F.min("score"), F.lit(0)).alias("lowest"), F.coalesce(F.max("score"), F.lit(0)).alias("best"))


@query(
    "ref_a29_p24_run_summary",
    f"""SELECT run_id, count(*) AS n, round_even(avg(score), 1) AS average, max(score) AS best, arg_min(company, struct_pack(a := -score, b := job_id)) AS top_company,
    count_if(score >= 90) AS s90, count_if(score >= 80 AND score < 90) AS s80, count_if(score >= 70 AND score < 80) AS s70, count_if(score < 70) AS rest, count_if(is_startup = 1) AS startups FROM ({_SCORES}) GROUP BY run_id""",
)
def run_summary(spark, d):
    s = F.col("score")
    return scores(spark, d).groupBy("run_id").agg(
        F.count(F.lit(1)).alias("n"), F.bround(F.avg("score"), 1).alias("average"), F.max("score").alias("best"), F.min_by("company", F.struct(-s, F.col("job_id"))).alias("top_company"),
        F.count_if(s >= 90).alias("s90"), F.count_if((s >= 80) & (s < 90)).alias("s80"), F.count_if((s >= 70) & (s < 80)).alias("s70"), F.count_if(s < 70).alias("rest"), F.count_if(F.col("is_startup") == 1).alias("startups"),
    )


@query("ref_a30_score_checks", f"SELECT run_id, count_if(score > 90) / count(*) > 0.8 AS inflated, count(*) > 10 AND count_if(score >= 70) = 0 AS none_good FROM ({_SCORES}) GROUP BY run_id")
def score_checks(spark, d):
    n = F.count(F.lit(1))
    return scores(spark, d).groupBy("run_id").agg((F.count_if(F.col("score") > 90) / n > 0.8).alias("inflated"), ((n > 10) & (F.count_if(F.col("score") >= 70) == 0)).alias("none_good"))


@query("ref_a31_source_checks", "WITH g AS (SELECT run_id, source, count(*) AS n FROM job_analytics GROUP BY 1, 2) SELECT run_id, count(*) AS sources, sum(n)::BIGINT AS total, max(n) / sum(n) > 0.8 AS dominated, sum(n) < 5 AS thin FROM g GROUP BY run_id")
def source_checks(spark, d):
    g = table(spark, d, "job_analytics").groupBy("run_id", "source").agg(F.count(F.lit(1)).alias("n"))
    return g.groupBy("run_id").agg(F.count(F.lit(1)).alias("sources"), F.sum("n").alias("total"), (F.max("n") / F.sum("n") > 0.8).alias("dominated"), (F.sum("n") < 5).alias("thin"))


@query("ref_k08_set_score", f"WITH s AS ({_SCORES}) SELECT job_id, CASE WHEN score >= 50 THEN score ELSE 0 END AS overall_score, coalesce(CASE WHEN score >= 50 THEN cv_variant END, 'none') AS cv_variant FROM s")
def set_score(spark, d):
    base = table(spark, d, "job_analytics").select("job_id", F.lit(0).alias("overall_score"), F.lit("none").alias("cv_variant"))
    return stores.set_score(base, scores(spark, d).where("score >= 50").select("job_id", F.col("score").alias("overall_score"), "cv_variant"), "job_id")


@query(
    "ref_t08_k09_digest",
    f"""SELECT row_number() OVER (ORDER BY score DESC, job_id) AS rank, job_id, CASE WHEN left(company, 1) IN ('=', '+', '-', '@') THEN '''' || company ELSE company END AS company, score
    FROM (SELECT * FROM ({_SCORES}) WHERE score >= 70 QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY score DESC, job_id) <= 20)""",
)
def digest(spark, d):
    per_run = F.row_number().over(Window.partitionBy("run_id").orderBy(F.desc("score"), "job_id"))
    best = scores(spark, d).where("score >= 70").withColumn("r", per_run).where("r <= 20")
    # the digest holds 20 rows a run: a global rank is over a report's rows, not over the table
    return best.select(F.row_number().over(Window.orderBy(F.desc("score"), "job_id")).alias("rank"), "job_id", tx.sheet_safe(F.col("company")).alias("company"), "score")


@query("ref_u02_u03_skill_overlap", "SELECT DISTINCT job_id, round(len(list_intersect(['docker', 'kafka', 'python', 'sql'], regexp_extract_all(lower(coalesce(description, '')), '\\b[a-z][a-z0-9+#.\\-]{1,}\\b'))) / 4, 4) AS overlap FROM raw_job")
def skill_overlap(spark, d):
    return table(spark, d, "raw_job").select("job_id", F.round(sim.skill_share(["Python", "SQL", "Docker", "Kafka"], F.col("description")), 4).alias("overlap")).distinct()


@query("ref_j07_left_outer", f"SELECT s.job_id, v.cv_variant FROM ({_SCORES}) s LEFT JOIN (SELECT job_id, cv_variant FROM ({_SCORES}) WHERE score >= 70) v USING (job_id)")
def left_outer(spark, d):
    s = scores(spark, d)
    return s.select("job_id").join(s.where("score >= 70").select("job_id", "cv_variant"), "job_id", "left")


@query("ref_u01_union_sources", "SELECT job_id, source, batch_id FROM incoming_job UNION ALL SELECT job_id, source, NULL FROM raw_job")
def union_sources(spark, d):
    return table(spark, d, "incoming_job").select("job_id", "source", "batch_id").unionByName(table(spark, d, "raw_job").select("job_id", "source"), allowMissingColumns=True)


@query("ref_o07_capped_groups", "SELECT source, job_id FROM (SELECT DISTINCT source, job_id FROM raw_job) QUALIFY row_number() OVER (PARTITION BY source ORDER BY job_id) <= 30")
def capped_groups(spark, d):
    r = F.row_number().over(Window.partitionBy("source").orderBy("job_id"))
    return table(spark, d, "raw_job").select("source", "job_id").distinct().withColumn("r", r).where("r <= 30").drop("r")


