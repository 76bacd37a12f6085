"""Registered source parsers. Postings are put into each board's payload and read back, so whole tables go through."""

from __future__ import annotations

from pyspark.sql import functions as F

from postlode.registry import query
from postlode.sources import parsers as ps
from postlode.tables import table


def _jobs(spark, d):
    return table(spark, d, "raw_job").select("job_id", "title", "company", "location", "salary_min", "salary_max", "description", "url", "posted_date").distinct()


_COLS = "title, company, location, salary_min, salary_max, url, posted_date"


@query("ref_s16_f18_adzuna_json", f"SELECT 'adzuna_' || job_id AS job_id, {_COLS} FROM (SELECT DISTINCT job_id, title, company, location, salary_min, salary_max, description, url, posted_date FROM raw_job)")
def adzuna(spark, d):
    body = F.to_json(F.struct(
        F.col("job_id").alias("id"), "title", "description", F.col("url").alias("redirect_url"), F.date_format("posted_date", "yyyy-MM-dd'T'00:00:00'Z'").alias("created"), "salary_min", "salary_max",
        F.struct(F.col("company").alias("display_name")).alias("company"), F.struct(F.col("location").alias("display_name")).alias("location")))
    return ps.adzuna(_jobs(spark, d).select(body.alias("payload"))).drop("description")


@query("ref_s17_f11_reed_json", f"SELECT 'reed_' || job_id AS job_id, {_COLS} FROM (SELECT DISTINCT job_id, title, company, location, salary_min, salary_max, description, url, posted_date FROM raw_job)")
def reed(spark, d):
    body = F.to_json(F.struct(
        F.col("job_id").alias("jobId"), F.col("title").alias("jobTitle"), F.col("company").alias("employerName"), F.col("location").alias("locationName"), F.col("salary_min").alias("minimumSalary"),
        F.col("salary_max").alias("maximumSalary"), F.date_format("posted_date", "dd/MM/yyyy").alias("date"), F.col("url").alias("jobUrl"), F.col("description").alias("jobDescription")))
    return ps.reed(_jobs(spark, d).select(body.alias("payload"))).drop("description")


@query("ref_s25_greenhouse_lever_json", "SELECT DISTINCT 'greenhouse_' || job_id AS job_id, title, location FROM raw_job UNION ALL SELECT DISTINCT 'lever_' || job_id, title, location FROM raw_job")
def ats(spark, d):
    j = _jobs(spark, d)
    g = j.select(F.concat(F.lit('{"jobs":'), F.to_json(F.array(F.struct(F.col("job_id").alias("id"), "title", F.col("url").alias("absolute_url"), F.col("description").alias("content"), F.struct(F.col("location").alias("name")).alias("location")))), F.lit("}")).alias("payload"))
    v = j.select(F.to_json(F.array(F.struct(F.col("job_id").alias("id"), F.col("title").alias("text"), F.col("description").alias("descriptionPlain"), F.struct(F.col("location").alias("location")).alias("categories")))).alias("payload"))
    return ps.greenhouse(g, F.lit("some-firm")).select("job_id", "title", "location").union(ps.lever(v, F.lit("some-firm")).select("job_id", "title", "location"))


@query("ref_s18_s39_search_results", "SELECT DISTINCT 'wellfound_' || substr(sha256(url), 1, 8) AS job_id, title, url FROM raw_job WHERE contains(url, 'wellfound.example')")
def search_results(spark, d):
    r = table(spark, d, "raw_job").select("title", "url", F.col("description").alias("content")).distinct()
    return ps.search_result(r, "wellfound.example", "wellfound").select("job_id", "title", "url").distinct()


@query("ref_s26_ats_token", "SELECT DISTINCT job_id, regexp_extract(u, 'jobs\\.lever\\.co/([A-Za-z0-9_-]+)', 1) AS token FROM (SELECT job_id, 'https://jobs.lever.co/' || regexp_extract(url, '/([a-z0-9-]+)/', 1) || '/1' AS u FROM raw_job WHERE regexp_matches(url, '/[a-z0-9-]+/'))")
def ats_token(spark, d):
    u = F.concat(F.lit("https://jobs.lever.co/"), F.regexp_extract("url", "/([a-z0-9-]+)/", 1), F.lit("/1"))
    return table(spark, d, "raw_job").where(F.col("url").rlike("/[a-z0-9-]+/")).select("job_id", F.coalesce(ps.ats_token(u, "lever"), F.lit("")).alias("token")).distinct()


@query("ref_s24_unix_date", "SELECT job_id, CAST(make_timestamp(CAST(floor(epoch(scraped_at)) AS BIGINT) * 1000000) AS DATE) AS day FROM job_analytics")
def unix_date(spark, d):
    return table(spark, d, "job_analytics").select("job_id", ps.unix_date(F.unix_seconds("scraped_at")).alias("day"))


@query("ref_s34_strip_html", "SELECT DISTINCT job_id, CASE WHEN contains(d, '<') THEN trim(regexp_replace(regexp_replace(d, '<[^>]*>', ' ', 'g'), '\\s+', ' ', 'g')) ELSE d END AS text FROM (SELECT job_id, regexp_replace(coalesce(description, ''), '[^ -~\\n]', ' ', 'g') AS d FROM raw_job)")
def strip_html(spark, d):
    from postlode.functions.text import strip_html as strip

    # white space beyond ASCII differs between the engines
    j = table(spark, d, "raw_job").select("job_id", F.regexp_replace(F.coalesce("description", F.lit("")), "[^ -~\\n]", " ").alias("d"))
    return j.select("job_id", strip(F.col("d")).alias("text")).distinct()


@query("ref_f21_url_parts", "SELECT DISTINCT job_id, regexp_extract(url, '^https?://([^/?#]+)', 1) AS host FROM raw_job WHERE url IS NOT NULL")
def url_parts(spark, d):
    return table(spark, d, "raw_job").where("url is not null").select("job_id", F.try_parse_url(F.col("url"), F.lit("HOST")).alias("host")).distinct()


@query(
    "ref_f22_title_of_slug",
    "SELECT DISTINCT job_id, array_to_string(list_transform(string_split(regexp_replace(regexp_extract(url, '//[^/]+/([a-z0-9-]+)', 1), '[-_]+', ' ', 'g'), ' '), lambda w: upper(w[1:1]) || lower(w[2:])), ' ') AS name FROM raw_job",
)
def title_of_slug(spark, d):
    from postlode.functions.text import title_of_slug as titled

    return table(spark, d, "raw_job").select("job_id", titled(F.regexp_extract("url", r"//[^/]+/([a-z0-9-]+)", 1)).alias("name")).distinct()


@query("ref_f18_json_props", "SELECT event_id, CAST(props->>'k' AS INTEGER) AS k FROM events")
def json_props(spark, d):
    return table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").try_cast("int").alias("k"))


@query("ref_s11_s13_register_csv", "SELECT DISTINCT city AS town FROM postcode_areas")
def register_csv(spark, d):
    """A register of one organisation a city, written as CSV lines with a header and a byte order mark, read back."""
    cities = table(spark, d, "postcode_areas").select("city").distinct()
    line = F.concat(F.lit('"Firm of '), F.col("city"), F.lit(' Ltd", '), F.col("city"), F.lit(",County,Worker (A rating),Skilled Worker"))
    lines = cities.select(F.lit(1).alias("line"), line.alias("value")).union(spark.createDataFrame([(0, "﻿Organisation Name,Town/City,County,Type & Rating,Route")], "line int, value string"))
    return ps.register_csv(lines).select("town")


@query("ref_s12_register_copy", "SELECT status, epoch_us(max(completed_at)) AS us, epoch_us((SELECT max(started_at) FROM run_history)) - epoch_us(max(completed_at)) < 7 * 86400000000 AS fresh FROM run_history WHERE completed_at IS NOT NULL GROUP BY 1")
def register_copy(spark, d):
    """Landed files, here one a status of runs, with the age of the latest at the last start."""
    r = table(spark, d, "run_history")
    now = r.agg(F.max("started_at")).first()[0]
    copies = ps.landed_copy(r, "status", "completed_at", F.lit(now).cast("timestamp"))
    return copies.select("status", F.unix_micros("completed_at").alias("us"), "fresh")


@query("ref_s14_inventory", "SELECT DISTINCT role_category AS category, role_title AS skill FROM role_titles")
def inventory(spark, d):
    """An inventory document of the roles by category, with blanks and repeats, read back."""
    r = table(spark, d, "role_titles").groupBy("role_category").agg(F.concat(F.collect_list("role_title"), F.collect_list(F.concat(F.lit(" "), "role_title")), F.array(F.lit(" "))).alias("s"))
    return ps.inventory(r.select(F.to_json(F.create_map("role_category", "s")).alias("payload")))
