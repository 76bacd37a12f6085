"""Registered page and search sources. Postings are put into each kind of page or result and read back, so whole tables go
through; the SQL says what must come back."""

from __future__ import annotations

from pyspark.sql import functions as F

from postlode.registry import query
from postlode.sources import pages as pg
from postlode.sources import parsers as ps
from postlode.tables import table

_KEYS = ["engineer", "data", "developer", "analyst"]
_HAS_KEY = "(contains({t}, 'engineer') OR contains({t}, 'data') OR contains({t}, 'developer') OR contains({t}, 'analyst'))"
_TRIM = "regexp_replace({c}, '^\\s+|\\s+$', '', 'g')"


def _escaped(c):
    x = F.coalesce(F.col(c), F.lit(""))
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        x = F.replace(x, F.lit(a), F.lit(b))
    return x


def _ascii(*cols):
    """Signs beyond ASCII as blanks: the engines differ in what white space they trim."""
    return [F.regexp_replace(F.coalesce(c, F.lit("")), "[^ -~]", " ").alias(c) for c in cols]


_A = ", ".join(f"regexp_replace(coalesce({c}, ''), '[^ -~]', ' ', 'g') AS {c}" for c in ("title", "company", "location", "description"))


def _postings(spark, d, *more):
    return table(spark, d, "raw_job").where("url is not null").select("job_id", *_ascii("title", "company", "location", "description"), "url", *more).distinct()


@query(
    "ref_s21_board_cards",
    f"""WITH r AS (SELECT DISTINCT job_id, {_A}, url, salary_min AS a, salary_max AS b, posted_date, coalesce(work_model, '') AS w FROM raw_job WHERE url IS NOT NULL),
    e AS (SELECT *, {_TRIM.format(c="title")} AS t, CASE WHEN {_TRIM.format(c="company")} = '' THEN '?' ELSE {_TRIM.format(c="company")} END || ' - ' || CASE WHEN {_TRIM.format(c="location")} = '' THEN '?' ELSE {_TRIM.format(c="location")} END AS e FROM r),
    s AS (SELECT *, lower(t || ' ' || description || ' ' || w) AS said FROM e WHERE t <> '')
    SELECT 'ukgov_' || job_id AS job_id, t AS title, {_TRIM.format(c="split_part(e, ' - ', 1)")} AS company, {_TRIM.format(c="substr(e, instr(e, ' - ') + 3)")} AS location, CASE WHEN a IS NULL OR b IS NULL THEN round(coalesce(a, b), 2) ELSE round(least(a, b), 2) END AS salary_min,
    CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN round(greatest(a, b), 2) END AS salary_max, posted_date, CASE WHEN contains(said, 'remote') THEN 'remote' WHEN contains(said, 'hybrid') THEN 'hybrid' WHEN contains(said, 'on-site') OR contains(said, 'onsite') THEN 'onsite' ELSE 'unknown' END AS work_model FROM s""",
)
def board_cards(spark, d):
    j = _postings(spark, d, "salary_min", "salary_max", "posted_date", "work_model")
    named = lambda c: F.when(F.trim(c) == "", "?").otherwise(F.trim(_escaped(c)))
    pay = F.concat_ws(" - ", F.when(F.col("salary_min").isNotNull(), F.format_string("£%,.2f", "salary_min")), F.when(F.col("salary_max").isNotNull(), F.format_string("£%,.2f", "salary_max")))
    item = lambda x: F.when(x != "", F.concat(F.lit("<li>"), x, F.lit("</li>"))).otherwise("")
    card = F.concat(
        F.lit('<div class="search-result" data-aid="'), "job_id", F.lit('"><h3><a href="'), _escaped("url"), F.lit('">'), _escaped("title"), F.lit('</a></h3><ul class="search-result-details"><li><strong>'), named("company"), F.lit("</strong> - "), named("location"), F.lit("</li>"),
        item(pay), item(F.coalesce(F.date_format("posted_date", "d MMMM yyyy"), F.lit(""))), item(F.coalesce("work_model", F.lit(""))), F.lit('</ul><p class="search-result-description">'), _escaped("description"), F.lit("</p></div>"),
    )
    pages = j.select(F.concat(F.lit("https://board.example/?page="), "job_id").alias("url"), F.concat(F.lit("<html><body><div>results</div>"), card, F.lit("</body></html>")).alias("html"))
    return pg.board_cards(pages).select("job_id", "title", "company", "location", "salary_min", "salary_max", "posted_date", "work_model")


@query("ref_s28_json_ld", f"SELECT DISTINCT title, company, CASE length(title) % 3 WHEN 0 THEN 'Remote (UK)' ELSE CASE WHEN location = '' THEN 'UK' ELSE location END END AS location, url FROM (SELECT DISTINCT {_A}, url FROM raw_job WHERE url IS NOT NULL) WHERE title <> ''")
def json_ld(spark, d):
    """Objects, lists of objects, places by locality or region, and remote ones with a list of places."""
    j = _postings(spark, d).select("title", "company", "location", "url").distinct()
    n = F.length("title") % 3
    address = F.when(n == 1, F.to_json(F.struct(F.col("location").alias("addressLocality")))).otherwise(F.to_json(F.struct(F.lit("").alias("addressLocality"), F.col("location").alias("addressRegion"))))
    place = F.when(n == 0, F.lit('[],"jobLocationType":"TELECOMMUTE"')).otherwise(F.concat(F.lit('{"address":'), address, F.lit("}")))
    thing = F.concat(F.regexp_replace(F.to_json(F.struct(F.lit("JobPosting").alias("@type"), "title", "url", F.struct(F.col("company").alias("name")).alias("hiringOrganization"))), r"\}$", ""), F.lit(',"jobLocation":'), place, F.lit("}"))
    thing = F.when(F.length("company") % 2 == 0, F.concat(F.lit("["), thing, F.lit("]"))).otherwise(thing)
    pages = j.select("url", F.concat(F.lit('<html><script type="application/ld+json">'), thing, F.lit("</script></html>")).alias("html"))
    return ps.json_ld(pages).select("title", "company", "location", "url").distinct()


_R = f"SELECT DISTINCT job_id, {_A}, url, regexp_extract(url, '^(https?://[^/]+)', 1) AS root FROM raw_job WHERE url IS NOT NULL"


@query(
    "ref_s27_s33_career_postings",
    f"""WITH r AS ({_R}), t AS (SELECT *, {_TRIM.format(c="title")} AS t, length(title) % 3 AS k, length({_TRIM.format(c="description")}) AS n, trim(CASE WHEN contains(description, '<') THEN regexp_replace(regexp_replace(description, '<[^>]*>', ' ', 'g'), '\\s+', ' ', 'g') ELSE description END) AS plain FROM r)
    SELECT DISTINCT job_id, CASE k WHEN 0 THEN title ELSE t END AS title, CASE WHEN k = 0 THEN 'jsonld' WHEN k = 1 AND n >= 80 THEN 'page' ELSE 'link' END AS kind FROM t
    WHERE (k = 0 AND title <> '' AND {_HAS_KEY.format(t="lower(title || ' ' || plain)")}) OR (k > 0 AND length(t) BETWEEN 5 AND 120 AND {_HAS_KEY.format(t="lower(t)")})""",
)
def career_postings(spark, d):
    """A career page for every posting: structured data, a link to a page that landed, or a link alone."""
    j = _postings(spark, d).withColumns({"k": F.length("title") % 3, "page": F.concat(F.regexp_extract("url", r"^(https?://[^/]+)", 1), F.lit("/careers/"), "job_id")})
    thing = F.to_json(F.struct(F.lit("JobPosting").alias("@type"), "title", F.regexp_replace("description", "(?i)</script", "").alias("description"), "url"))
    body = F.when(F.col("k") == 0, F.concat(F.lit('<script type="application/ld+json">'), thing, F.lit("</script>"))).otherwise(F.concat(F.lit('<nav>menu</nav><a href="'), _escaped("url"), F.lit('">'), _escaped("title"), F.lit("</a>")))
    pages = j.select(F.col("page").alias("url"), F.concat(F.lit("<html><body>"), body, F.lit("</body></html>")).alias("html"), F.coalesce("company", F.lit("?")).alias("company"))
    landed = j.where("k = 1").select("url", F.concat(F.lit("<html><body><header>top</header><main>"), _escaped("description"), F.lit("</main></body></html>")).alias("html"))
    found = pg.career_postings(pages, landed, _KEYS)
    return found.select(F.substring_index("page", "/", -1).alias("job_id"), "title", "kind").distinct()


@query("ref_s30_s31_page_links", f"SELECT job_id, t AS text, url AS href FROM (SELECT *, {_TRIM.format(c='title')} AS t FROM ({_R})) WHERE length(t) BETWEEN 5 AND 120 AND {_HAS_KEY.format(t='lower(t)')}")
def page_links(spark, d):
    """Pages with the same link twice, one in their navigation, and a link to another host."""
    j = _postings(spark, d)
    link = F.concat(F.lit('<a href="'), _escaped("url"), F.lit('">'), _escaped("title"), F.lit("</a>"))
    html = F.concat(F.lit("<html><body><nav>"), link, F.lit("</nav><main>"), link, F.lit('<a href="https://elsewhere.test/x">data engineer</a></main></body></html>'))
    pages = j.select(F.concat(F.regexp_extract("url", r"^(https?://[^/]+)", 1), F.lit("/jobs/"), "job_id").alias("url"), html.alias("html"))
    return pg.job_links(pg.page_content(pages), _KEYS).select(F.substring_index("url", "/", -1).alias("job_id"), "text", "href")


_PLACES = "(?i)\\b(London|Manchester|Edinburgh|Cambridge|Oxford|Bristol|Remote|Hybrid|UK Remote|United Kingdom)\\b"


@query("ref_s32_page_place", f"SELECT DISTINCT job_id, CASE WHEN regexp_extract(x, '{_PLACES}', 1) = '' THEN 'UK' ELSE regexp_extract(x, '{_PLACES}', 1) END AS place FROM (SELECT job_id, title || ' ' || location || ' ' || description AS x FROM ({_R}))")
def page_place(spark, d):
    j = _postings(spark, d)
    pages = j.select(F.col("job_id").alias("url"), F.concat(F.lit("<html><body><p>"), _escaped("title"), F.lit("</p><p>"), _escaped("location"), F.lit("</p>"), _escaped("description"), F.lit("</body></html>")).alias("html"))
    return pg.page_content(pages).select(F.col("url").alias("job_id"), "place").distinct()


@query(
    "ref_s36_s37_funded_postings",
    f"""WITH t AS (SELECT *, {_TRIM.format(c="title")} AS t, length(title) % 3 AS k FROM ({_R}))
    SELECT DISTINCT 'https://c' || job_id || '.example' || CASE k WHEN 0 THEN '/jobs' ELSE '/join' END AS careers_url, CASE k WHEN 0 THEN title ELSE t END AS title FROM t
    WHERE (k = 0 AND {_HAS_KEY.format(t="lower(title)")}) OR (k = 1 AND length(t) BETWEEN 5 AND 120 AND {_HAS_KEY.format(t="lower(t)")})""",
)
def funded_postings(spark, d):
    """Every posting's firm has an empty page at one path and its posting at a later one, or none at all."""
    j = _postings(spark, d).withColumns({"k": F.length("title") % 3, "domain": F.concat(F.lit("c"), "job_id", F.lit(".example"))})
    thing = F.to_json(F.struct(F.lit("JobPosting").alias("@type"), "title", "url"))
    link = F.concat(F.lit('<a href="'), _escaped("url"), F.lit('">'), _escaped("title"), F.lit("</a>"))
    at = lambda path, html: (F.concat(F.lit("https://"), "domain", F.lit(path)).alias("url"), F.concat(F.lit("<html><body>"), html, F.lit("</body></html>")).alias("html"))
    landed = j.where("k < 2").select(*at("/careers", F.lit("nothing here")))
    landed = landed.union(j.where("k = 0").select(*at("/jobs", F.concat(F.lit('<script type="application/ld+json">'), thing, F.lit("</script>"), link)))).union(j.where("k = 1").select(*at("/join", link))).union(j.where("k < 2").select(*at("/hiring", link)))
    return pg.funded_postings(j.select("domain", F.col("company").alias("name")), landed, _KEYS).select("careers_url", "title").distinct()


@query("ref_s20_google_jobs", f"SELECT DISTINCT title, company, location, url FROM ({_R})")
def google_jobs(spark, d):
    j = _postings(spark, d)
    body = F.to_json(F.struct(F.array(F.struct("title", F.col("company").alias("company_name"), "location", "description", F.array(F.struct(F.col("url").alias("link"))).alias("related_links"))).alias("jobs_results")))
    return ps.google_jobs(j.select(body.alias("payload"))).select("title", "company", "location", "url").distinct()


@query("ref_s19_search_results", "SELECT DISTINCT 'linkedin_proxy_' || substr(sha256(url), 1, 8) AS job_id, url FROM raw_job WHERE contains(url, 'linkedin')")
def linkedin_results(spark, d):
    r = table(spark, d, "raw_job").select("title", "url", F.col("description").alias("content")).distinct()
    return ps.search_result(r, "linkedin", "linkedin_proxy").select("job_id", "url").distinct()


_SPLIT = "regexp_split_to_array({t}, '\\s*[|\\-—]\\s*')"


@query(
    "ref_s38_recruiter_results",
    f"""WITH r AS (SELECT DISTINCT url, {_TRIM.format(c="title || CASE length(description) % 3 WHEN 0 THEN ' at Acme Partners' WHEN 1 THEN ' - Borough Works | Agency' ELSE '' END")} AS t, description AS c FROM ({_R})),
    x AS (SELECT *, {_TRIM.format(c=_SPLIT.format(t="t") + "[1]")} AS f, regexp_extract(t, '\\bat\\s+([A-Z][A-Za-z0-9\\s&]+?)(?:\\s*[|\\-]|$)', 1) AS firm, {_TRIM.format(c="coalesce(" + _SPLIT.format(t="t") + "[2], '')")} AS s,
      regexp_extract(c, '(?i)\\b(London|Manchester|Edinburgh|Remote|Hybrid|UK\\s+Remote)\\b', 1) AS p FROM r WHERE t <> '' AND url <> '')
    SELECT DISTINCT url, CASE WHEN length(f) < 5 THEN t ELSE f END AS title, CASE WHEN firm <> '' THEN {_TRIM.format(c="firm")} WHEN lower(s) <> 'agency' AND length(s) > 2 THEN s ELSE 'Via Agency' END AS company, CASE WHEN p = '' THEN 'London, UK' ELSE p END AS location FROM x""",
)
def recruiter_results(spark, d):
    n = F.length("description") % 3
    title = F.concat("title", F.when(n == 0, " at Acme Partners").when(n == 1, " - Borough Works | Agency").otherwise(""))
    r = _postings(spark, d).select(title.alias("title"), "url", F.col("description").alias("content"))
    return ps.recruiter_results(r, "Agency").select("url", "title", "company", "location").distinct()


@query("ref_s22_hiring_thread", "SELECT arg_max(job_id, struct_pack(a := scraped_at, b := job_id)) AS id FROM raw_job WHERE length(title) % 5 = 0 AND length(title) % 2 = 0")
def hiring_thread(spark, d):
    """The latest story of the thread's author under the thread's title, among stories of others and under other titles."""
    n = F.length("title")
    stories = table(spark, d, "raw_job").select(F.col("job_id").alias("id"), F.when(n % 5 == 0, "whoishiring").otherwise("someone").alias("author"), F.when(n % 2 == 0, "Ask HN: Who  is hiring?").otherwise("Who wants to be hired?").alias("title"), F.col("scraped_at").alias("created"))
    return ps.hiring_thread(stories)


_DASH = "^([^\\-(:]{2,80}?)\\s*[-(]\\s*(.{2,150}?)\\)?\\s*$"


@query(
    "ref_s23_first_line",
    f"""WITH l AS (SELECT DISTINCT job_id, {_TRIM.format(c="CASE length(description) % 4 WHEN 0 THEN company || ' | ' || title || ' | ' || location WHEN 1 THEN company || ' - ' || title WHEN 2 THEN company || ' (' || title || ')' ELSE title END")} AS line FROM ({_R})),
    p AS (SELECT *, list_filter(regexp_split_to_array(line, '\\s*\\|\\s*'), lambda x: x <> '') AS parts, regexp_matches(line, '{_DASH}') AS dash, length(line) BETWEEN 5 AND 200 AND NOT contains(line, '?') AS short FROM l)
    SELECT DISTINCT job_id, CASE WHEN contains(line, '|') AND len(parts) >= 2 THEN {_TRIM.format(c="parts[2]")} WHEN dash THEN {_TRIM.format(c=f"regexp_extract(line, '{_DASH}', 2)")} WHEN short THEN line ELSE '' END AS title,
    CASE WHEN contains(line, '|') AND len(parts) >= 2 THEN {_TRIM.format(c="parts[1]")} WHEN dash THEN {_TRIM.format(c=f"regexp_extract(line, '{_DASH}', 1)")} WHEN short THEN line ELSE '' END AS company FROM p""",
)
def first_line(spark, d):
    """First lines in each of the forms, made of every posting."""
    n = F.length("description") % 4
    line = F.when(n == 0, F.concat_ws(" | ", "company", "title", "location")).when(n == 1, F.concat_ws(" - ", "company", "title")).when(n == 2, F.concat("company", F.lit(" ("), "title", F.lit(")"))).otherwise(F.col("title"))
    title, company = ps.first_line(F.concat(line, F.lit("\nmore text | with bars")))
    return _postings(spark, d).select("job_id", title.alias("title"), company.alias("company")).distinct()


@query(
    "ref_s29_ats_embed",
    """WITH r AS (SELECT DISTINCT job_id, length(title) % 5 AS k, CASE WHEN regexp_extract(url, '/([A-Za-z0-9_-]+)/', 1) = '' THEN 'x' ELSE regexp_extract(url, '/([A-Za-z0-9_-]+)/', 1) END AS t FROM raw_job WHERE url IS NOT NULL AND title IS NOT NULL)
    SELECT job_id, unnest(CASE k WHEN 0 THEN ['greenhouse'] WHEN 1 THEN ['lever'] WHEN 2 THEN ['ashby'] WHEN 3 THEN ['greenhouse', 'workable'] ELSE [] END) AS platform, t AS token FROM r""",
)
def ats_embed(spark, d):
    j = table(spark, d, "raw_job").where("url is not null and title is not null").select("job_id", (F.length("title") % 5).alias("k"), F.regexp_extract("url", "/([A-Za-z0-9_-]+)/", 1).alias("t")).distinct()
    j = j.withColumn("t", F.when(F.col("t") == "", "x").otherwise(F.col("t")))
    board = F.concat(F.lit('<iframe src="https://boards.greenhouse.io/embed/job_board?for='), "t", F.lit('&b=1"></iframe>'))
    page = F.when(F.col("k") == 0, board).when(F.col("k") == 1, F.concat(F.lit('<a href="https://jobs.lever.co/'), "t", F.lit('/1">'))).when(F.col("k") == 2, F.concat(F.lit("jobs.ashbyhq.com/"), "t", F.lit("?x"))).when(F.col("k") == 3, F.concat(board, F.lit(' <a href="https://'), "t", F.lit('.workable.com/">'))).otherwise(F.lit("https://boards.greenhouse.io/firm"))
    return j.select("job_id", F.explode(ps.ats_embed(page)).alias("e")).select("job_id", "e.platform", "e.token")


@query(
    "ref_s35_funded_companies",
    """WITH a AS (SELECT job_id, list_filter(list_transform(regexp_extract_all(lower('see https://www.' || replace(regexp_extract(url, '^https?://([^/]+)', 1), '.example', '.io') || ', https://t.co/x http://blog.medium.com https://' || regexp_extract(url, '^https?://([^/.]+)', 1) || '.co.uk.'), 'https?://(?:www\\.)?([a-z0-9.\\-]+)', 1),
      lambda x: regexp_replace(x, '^\\.+|\\.+$', '', 'g')), lambda x: regexp_matches(x, '\\.(ai|io|co\\.uk|com)$') AND NOT regexp_matches(x, 'techcrunch\\.com|sifted\\.eu|twitter\\.com|x\\.com|linkedin\\.com|crunchbase\\.com|bloomberg\\.com|reuters\\.com|ft\\.com|theguardian\\.com|bbc\\.co\\.uk|google\\.com|youtube\\.com|facebook\\.com|instagram\\.com|medium\\.com|substack\\.com|github\\.com|notion\\.so|docs\\.google\\.com|angel\\.co|wellfound\\.com|glassdoor\\.com|indeed\\.com|adzuna\\.co\\.uk|pitchbook\\.com|beauhurst\\.com|businessinsider\\.com')
      AND length(split_part(x, '.', 1)) > 2)[1:4] AS ds FROM raw_job WHERE url IS NOT NULL), e AS (SELECT job_id, unnest(ds) AS domain FROM a)
    SELECT domain, min(job_id) AS article FROM e GROUP BY 1""",
)
def funded_companies(spark, d):
    """Companies by the addresses in articles: two of the posting's host, one too short, one of a site that is none."""
    host = F.regexp_extract("url", "^https?://([^/]+)", 1)
    text = F.concat(F.lit("see https://www."), F.replace(host, F.lit(".example"), F.lit(".io")), F.lit(", https://t.co/x http://blog.medium.com https://"), F.regexp_extract("url", "^https?://([^/.]+)", 1), F.lit(".co.uk."))
    return ps.funded_companies(table(spark, d, "raw_job").where("url is not null").select(F.col("job_id").alias("article"), text.alias("text"))).select("domain", "article")
