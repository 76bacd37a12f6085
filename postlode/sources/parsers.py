"""Postings from landed payloads of job boards, search results, ATS feeds, threads and pages.

Network access is the caller's: responses are landed as text and parsed here. A payload that does not parse gives no
row; `quarantine` lists those. JSON goes through from_json with a declared schema; HTML pages are read in pages.py.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postlode.functions.text import strip, strip_html

# Patterns of feeds and pages.
ATS_TOKEN = {
    "greenhouse": r"(?:boards\.greenhouse\.io|boards-api\.greenhouse\.io/v1/boards)/([A-Za-z0-9_-]+)",
    "lever": r"(?:jobs\.lever\.co|api\.lever\.co/v0/postings)/([A-Za-z0-9_-]+)",
    "ashby": r"jobs\.ashbyhq\.com/([A-Za-z0-9_-]+)",
}
# Marks of feeds that a page embeds.
ATS_EMBED = {
    "greenhouse": r"boards\.greenhouse\.io/embed/job_board\?for=([a-zA-Z0-9_-]+)",
    "lever": r"jobs\.lever\.co/([a-zA-Z0-9_-]+)",
    "ashby": r"jobs\.ashbyhq\.com/([a-zA-Z0-9_-]+)",
    "workable": r"([a-zA-Z0-9_-]+)\.workable\.com",
}
# Author and title of the monthly hiring thread.
THREAD_AUTHOR = "whoishiring"
THREAD_TITLE = r"(?i)who\s+is\s+hiring"
SCRIPT_JSONLD = r"(?is)<script[^>]*application/ld\+json[^>]*>(.*?)</script>"

ADZUNA = "struct<id:string,title:string,description:string,redirect_url:string,created:string,salary_min:double,salary_max:double,company:struct<display_name:string>,location:struct<display_name:string>>"
REED = "struct<jobId:string,jobTitle:string,employerName:string,locationName:string,minimumSalary:double,maximumSalary:double,date:string,jobUrl:string,jobDescription:string>"
LEVER = "struct<id:string,text:string,hostedUrl:string,descriptionPlain:string,categories:struct<location:string>,lists:array<struct<text:string,content:string>>>"
GREENHOUSE = "struct<id:string,title:string,absolute_url:string,content:string,location:struct<name:string>>"
JSONLD = "struct<`@type`:string,title:string,description:string,url:string,datePosted:string,jobLocationType:string,hiringOrganization:struct<name:string>,jobLocation:struct<address:struct<addressLocality:string,addressRegion:string>>>"


GOOGLE_JOBS = "struct<title:string,company_name:string,location:string,description:string,related_links:array<struct<link:string>>>"


def surrogate(source: str, url: Column) -> Column:
    """Stable id from the address."""
    return F.concat(F.lit(f"{source}_"), F.substring(F.sha2(url, 256), 1, 8))


def quarantine(payloads: DataFrame, body: str, schema: str, required: str) -> DataFrame:
    """Payloads that do not parse, or lack the required field."""
    return payloads.where(F.from_json(body, schema)[required].isNull())


def adzuna(payloads: DataFrame, body: str = "payload") -> DataFrame:
    """One posting a payload; ISO-8601 dates with a Z."""
    p = payloads.select(F.from_json(body, ADZUNA).alias("p")).where("p.id is not null")
    return p.select(
        F.concat(F.lit("adzuna_"), F.col("p.id")).alias("job_id"), "p.title", F.col("p.company.display_name").alias("company"), F.col("p.location.display_name").alias("location"),
        "p.salary_min", "p.salary_max", "p.description", F.col("p.redirect_url").alias("url"), F.to_date(F.try_to_timestamp("p.created")).alias("posted_date"),
    )


def reed(payloads: DataFrame, body: str = "payload") -> DataFrame:
    """One posting a payload; dates as dd/MM/yyyy."""
    p = payloads.select(F.from_json(body, REED).alias("p")).where("p.jobId is not null")
    return p.select(
        F.concat(F.lit("reed_"), F.col("p.jobId")).alias("job_id"), F.col("p.jobTitle").alias("title"), F.col("p.employerName").alias("company"), F.col("p.locationName").alias("location"),
        F.col("p.minimumSalary").alias("salary_min"), F.col("p.maximumSalary").alias("salary_max"), F.col("p.jobDescription").alias("description"), F.col("p.jobUrl").alias("url"),
        F.to_date(F.try_to_timestamp("p.date", F.lit("dd/MM/yyyy"))).alias("posted_date"),
    )


def greenhouse(payloads: DataFrame, token: Column, body: str = "payload") -> DataFrame:
    p = payloads.select(F.explode(F.from_json(F.get_json_object(body, "$.jobs"), f"array<{GREENHOUSE}>")).alias("p"), token.alias("token"))
    return p.select(F.concat(F.lit("greenhouse_"), F.col("p.id")).alias("job_id"), "p.title", F.initcap(F.regexp_replace("token", "[-_]+", " ")).alias("company"), F.col("p.location.name").alias("location"), F.col("p.content").alias("description"), F.col("p.absolute_url").alias("url"))


def lever(payloads: DataFrame, token: Column, body: str = "payload") -> DataFrame:
    """Description followed by the lists, a line each."""
    p = payloads.select(F.explode(F.from_json(body, f"array<{LEVER}>")).alias("p"), token.alias("token"))
    parts = F.transform(F.coalesce("p.lists", F.array()), lambda x: F.concat_ws("\n", x["text"], x["content"]))
    return p.select(F.concat(F.lit("lever_"), F.col("p.id")).alias("job_id"), F.col("p.text").alias("title"), F.initcap(F.regexp_replace("token", "[-_]+", " ")).alias("company"), F.col("p.categories.location").alias("location"),
                    F.concat_ws("\n", F.col("p.descriptionPlain"), F.array_join(parts, "\n")).alias("description"), F.col("p.hostedUrl").alias("url"))


def ats_token(url: Column, platform: str) -> Column:
    return F.nullif(F.regexp_extract(url, ATS_TOKEN[platform], 1), F.lit(""))


def ats_embed(html: Column) -> Column:
    """All feeds that a page embeds, as an array of (platform, token), the first token of each."""
    found = [F.struct(F.lit(k).alias("platform"), F.nullif(F.regexp_extract(html, p, 1), F.lit("")).alias("token")) for k, p in ATS_EMBED.items()]
    return F.filter(F.array(*found), lambda x: x["token"].isNotNull())


def search_result(results: DataFrame, domain: str, source: str) -> DataFrame:
    """Postings from web search results (title, url, content): only the domain's; company from the address."""
    slug = F.regexp_extract("url", r"/(?:company|companies|jobs)/([A-Za-z0-9_-]+)", 1)
    return results.where(F.contains("url", F.lit(domain))).select(surrogate(source, F.col("url")).alias("job_id"), "title", F.nullif(F.initcap(F.regexp_replace(slug, "[-_]+", " ")), F.lit("")).alias("company"), F.col("content").alias("description"), "url")


def json_ld(pages: DataFrame, html: str = "html", most: int = 8000) -> DataFrame:
    """JobPosting objects of a page's JSON-LD scripts, single or in lists. Place: locality before region of the address,
    else UK; an object whose jobLocation is a list counts as remote if its type says so."""
    blocks = pages.select("url", F.explode(F.regexp_extract_all(html, F.lit(SCRIPT_JSONLD), F.lit(1))).alias("b"))
    items = F.when(F.ltrim("b").startswith("["), F.from_json("b", "array<string>")).otherwise(F.array("b"))
    raw = blocks.select(F.col("url").alias("page"), F.explode(items).alias("b"))
    p = raw.select("page", F.from_json("b", JSONLD).alias("p"), F.coalesce(F.get_json_object("b", "$.jobLocation"), F.lit("{}")).alias("l"))
    p = p.where(F.col("p.`@type`").isin("JobPosting", "jobPosting") & (F.coalesce("p.title", F.lit("")) != ""))
    part = lambda k: F.nullif(F.get_json_object("l", f"$.address.{k}"), F.lit(""))
    remote = F.when(F.col("p.jobLocationType") == "TELECOMMUTE", "Remote (UK)").otherwise("UK")
    where = F.when(F.col("l").startswith("{"), F.coalesce(part("addressLocality"), part("addressRegion"), F.lit("UK"))).otherwise(remote)
    text = F.substring(strip_html(F.coalesce("p.description", F.lit(""))), 1, most)
    return p.select(
        "page", surrogate("cp", F.concat("page", F.col("p.title"))).alias("job_id"), "p.title", F.col("p.hiringOrganization.name").alias("company"), where.alias("location"), text.alias("description"),
        F.coalesce("p.url", "page").alias("url"), F.to_date(F.try_to_timestamp("p.datePosted")).alias("posted_date"),
    )


def google_jobs(payloads: DataFrame, body: str = "payload", most: int = 8000) -> DataFrame:
    """Postings of a job search payload; the address is that of the first related link."""
    p = payloads.select(F.explode(F.from_json(F.get_json_object(body, "$.jobs_results"), f"array<{GOOGLE_JOBS}>")).alias("p"))
    url = F.coalesce(F.try_element_at("p.related_links", F.lit(1))["link"], F.lit(""))
    return p.select(surrogate("indeed", F.concat_ws("|", "p.title", "p.company_name", url)).alias("job_id"), "p.title", F.col("p.company_name").alias("company"), "p.location", F.substring(F.coalesce("p.description", F.lit("")), 1, most).alias("description"), url.alias("url"))


def hiring_thread(stories: DataFrame) -> DataFrame:
    """(id): the latest story of the thread's author and title. stories: (id, author, title, created)."""
    mine = stories.where((F.col("author") == THREAD_AUTHOR) & F.coalesce("title", F.lit("")).rlike(THREAD_TITLE))
    return mine.agg(F.max(F.struct("created", "id")).alias("m")).where("m is not null").select("m.id")


def thread_comments(items: DataFrame, keywords: list[str], most: int = 500) -> DataFrame:
    """Top-level comments of a hiring thread that may be postings: not deleted or dead, 40 letters, a keyword."""
    t = F.lower("text")
    kept = items.where("not coalesce(deleted, false) and not coalesce(dead, false) and length(text) >= 40 and position <= " + str(most))
    return kept.where(F.exists(F.array(*[F.lit(k) for k in keywords]), lambda k: F.contains(t, k)))


def first_line(text: Column) -> tuple[Column, Column]:
    """(title, company) of a comment's first line: 'company | title | ...', 'company - title' or 'company (title)', or a
    line of 5 to 200 letters without a question mark for both."""
    line = strip(F.element_at(F.split(F.coalesce(text, F.lit("")), "\n"), 1))
    parts = F.filter(F.split(line, r"\s*\|\s*"), lambda x: x != "")
    # Fixed value: company, then a dash or bracket, then the title.
    dash = r"^([^\-(:]{2,80}?)\s*[-(]\s*(.{2,150}?)\)?\s*$"
    whole = F.when(F.length(line).between(5, 200) & ~F.contains(line, F.lit("?")), line).otherwise("")
    piped = F.contains(line, F.lit("|")) & (F.size(parts) >= 2)
    title = F.when(piped, strip(F.try_element_at(parts, F.lit(2)))).when(line.rlike(dash), strip(F.regexp_extract(line, dash, 2))).otherwise(whole)
    company = F.when(piped, strip(F.try_element_at(parts, F.lit(1)))).when(line.rlike(dash), strip(F.regexp_extract(line, dash, 1))).otherwise(whole)
    return title, company


def unix_date(seconds: Column) -> Column:
    return F.to_date(F.timestamp_seconds(seconds))


def result_title(title: Column) -> Column:
    """Part of a search result's title before the first separator; the whole title if that is under five letters."""
    first = strip(F.element_at(F.split(strip(title), r"\s*[|\-—]\s*"), 1))
    return F.when(F.length(first) < 5, strip(title)).otherwise(first)


def result_company(title: Column, agency: str) -> Column:
    """Company of a search result's title: after 'at', else its second part unless that is the agency."""
    at = F.regexp_extract(title, r"\bat\s+([A-Z][A-Za-z0-9\s&]+?)(?:\s*[|\-]|$)", 1)
    second = strip(F.coalesce(F.try_element_at(F.split(title, r"\s*[|\-—]\s*"), F.lit(2)), F.lit("")))
    return F.when(at != "", strip(at)).when((F.lower(second) != agency.lower()) & (F.length(second) > 2), second).otherwise(f"Via {agency}")


def recruiter_results(results: DataFrame, agency: str, most: int = 8000) -> DataFrame:
    """Postings from an agency's search results (title, url, content): place and pay as the content names them first."""
    r = results.select(strip("title").alias("t"), "url", F.coalesce("content", F.lit("")).alias("c")).where("t <> '' and url <> ''")
    # Places and the form of pay.
    place = F.regexp_extract("c", r"(?i)\b(London|Manchester|Edinburgh|Remote|Hybrid|UK\s+Remote)\b", 1)
    pay = F.regexp_extract("c", r"(?i)£[\d,]+(?:\s*[-–]\s*£[\d,]+)?(?:\s*(?:per\s+annum|pa|k))?", 0)
    text = F.when(pay != "", F.concat(F.lit("Salary: "), pay, F.lit("\n\n"), F.col("c"))).otherwise(F.col("c"))
    return r.select(surrogate("rec", F.col("url")).alias("job_id"), result_title(F.col("t")).alias("title"), result_company(F.col("t"), agency).alias("company"), F.when(place == "", "London, UK").otherwise(place).alias("location"), F.substring(text, 1, most).alias("description"), "url")


# Fixed value: address of the register's file on its publication page.
REGISTER_FILE = r'https://assets\.publishing\.service\.gov\.uk/media/[^"]+\.csv'


def register_link(html: Column) -> Column:
    """Address of the register's present file, from its publication page."""
    return F.nullif(F.regexp_extract(html, REGISTER_FILE, 0), F.lit(""))


def landed_copy(files: DataFrame, name: str, at: str, now: Column, days: int = 7) -> DataFrame:
    """(name, at, fresh): the latest landed copy of each file, and whether it is younger than `days` days."""
    last = files.where(F.col(at).isNotNull()).groupBy(name).agg(F.max(at).alias(at))
    return last.select(name, at, (F.unix_micros(now) - F.unix_micros(at) < days * 86_400_000_000).alias("fresh"))


def inventory(documents: DataFrame, body: str = "payload") -> DataFrame:
    """(category, skill) of skill inventories: JSON objects of category -> list of skills; blank and repeated ones left out."""
    by = documents.select(F.explode(F.from_json(body, "map<string,array<string>>")).alias("category", "skills"))
    return by.select("category", F.explode("skills").alias("skill")).select("category", strip("skill").alias("skill")).where("skill <> ''").distinct()


def register_csv(lines: DataFrame, column: str = "value") -> DataFrame:
    """Register of organisations from CSV lines: BOM dropped, fields trimmed, first row of each normalised name."""
    from postlode.functions.text import company_key

    clean = F.regexp_replace(column, "^﻿", "")
    row = F.from_csv(clean, F.lit("name string, town string, county string, rating string, route string"))
    parsed = lines.select("line", row.alias("r")).select("line", *[F.trim(f"r.{c}").alias(c) for c in ("name", "town", "county", "rating", "route")]).where("name is not null and name <> '' and name <> 'Organisation Name'")
    keyed = parsed.withColumn("key", company_key(F.col("name")))
    return keyed.groupBy("key").agg(F.min_by(F.struct("name", "town", "route"), "line").alias("r")).select("key", "r.*")


# Hosts that a funding article links to without naming a company, and endings of company hosts.
NOT_COMPANIES = (
    "techcrunch.com", "sifted.eu", "twitter.com", "x.com", "linkedin.com",
    "crunchbase.com", "bloomberg.com", "reuters.com", "ft.com",
    "theguardian.com", "bbc.co.uk", "google.com", "youtube.com",
    "facebook.com", "instagram.com", "medium.com", "substack.com",
    "github.com", "notion.so", "docs.google.com", "angel.co",
    "wellfound.com", "glassdoor.com", "indeed.com", "adzuna.co.uk",
    "pitchbook.com", "beauhurst.com", "businessinsider.com",
)
COMPANY_ENDING = r"\.(ai|io|co\.uk|com)$"


def funded_companies(articles: DataFrame, text: str = "text", most: int = 4) -> DataFrame:
    """(domain, name, article): companies by their addresses in articles; the first article of each domain. An article
    names at most `most`, repeated ones counted."""
    links = F.regexp_extract_all(F.lower(text), F.lit(r"https?://(?:www\.)?([a-z0-9.\-]+)"), F.lit(1))
    plain = F.transform(links, lambda x: F.regexp_replace(x, r"^\.+|\.+$", ""))
    skip = F.array(*[F.lit(x) for x in NOT_COMPANIES])
    ok = lambda x: ~F.exists(skip, lambda k: F.contains(x, k)) & x.rlike(COMPANY_ENDING) & (F.length(F.substring_index(x, ".", 1)) > 2)
    found = articles.select("article", F.explode(F.slice(F.filter(plain, ok), 1, most)).alias("domain"))
    first = found.groupBy("domain").agg(F.min("article").alias("article"))
    return first.select("domain", F.initcap(F.replace(F.substring_index("domain", ".", 1), F.lit("-"), F.lit(" "))).alias("name"), "article")
