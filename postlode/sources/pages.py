"""Postings from landed pages: cards of a job board, career pages with their job pages, pages of funded companies.

Pages come as a table (url, html); fetching them is the caller's. HTML is read by the standard library's parser in Arrow
batches; everything after it is column expressions and joins. A page that does not parse gives what was read of it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postlode.functions.text import strip
from postlode.sources.parsers import json_ld, surrogate

LEAST_CONTENT = 80
MOST_CONTENT = 8000
# Hosts of feeds that a career page may link to.
FEED_HOSTS = ("greenhouse.io", "lever.co", "ashbyhq.com", "workable.com")
# Paths at which career pages are tried, in order.
CAREER_PATHS = ("/careers", "/jobs", "/work-with-us", "/join", "/join-us", "/about/careers", "/company/jobs", "/careers/open-roles", "/hiring", "/open-positions")
# Fixed value: places that a page may name.
PAGE_PLACE = r"(?i)\b(London|Manchester|Edinburgh|Cambridge|Oxford|Bristol|Remote|Hybrid|UK Remote|United Kingdom)\b"


def _parsed(pages: DataFrame, make: Callable[[str], object], schema: str, columns: list[str]) -> DataFrame:
    """Rows (url, ...) that `make` gives for each page's HTML."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = [(url, *row) for url, html in zip(b["url"], b["html"], strict=True) for row in make(html or "")]
            yield pd.DataFrame(out, columns=["url", *columns])

    return pages.select("url", "html").mapInPandas(run, f"url string, {schema}")


class _Text:
    """Pieces of text of one element, and the depth of equal tags inside it."""

    def __init__(self) -> None:
        self.pieces: list[str] = []
        self.depth = 1

    def text(self, by: str = " ") -> str:
        return by.join(p for p in (x.strip() for x in self.pieces) if p)


class _Reader(HTMLParser):
    """Text of the elements that `wanted` names: the first of each name, or every one of the names in `every`."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, str, _Text]] = []

    def begin(self, name: str, tag: str) -> _Text:
        t = _Text()
        self.open.append((name, tag, t))
        return t

    def handle_starttag(self, tag: str, attrs: list) -> None:
        for _, at, t in self.open:
            t.depth += at == tag
        self.start(tag, {k: v or "" for k, v in attrs})

    def handle_endtag(self, tag: str) -> None:
        still = []
        for entry in self.open:
            entry[2].depth -= entry[1] == tag
            if entry[2].depth:
                still.append(entry)
            else:
                self.end(entry[0], entry[2])
        self.open = still

    def handle_data(self, data: str) -> None:
        for _, _, t in self.open:
            t.pieces.append(data)

    def start(self, tag: str, attrs: dict[str, str]) -> None: ...

    def end(self, name: str, t: _Text) -> None: ...


class _Cards(_Reader):
    """Search result cards of a job board: title link, detail items, description."""

    def __init__(self) -> None:
        super().__init__()
        self.cards: list[dict] = []
        self.title: list[bool] = []

    def start(self, tag: str, attrs: dict[str, str]) -> None:
        names = attrs.get("class", "").split()
        inside = {name for name, _, _ in self.open}
        if tag == "div" and "search-result" in names:
            self.cards.append({"aid": attrs.get("data-aid"), "href": None, "title": "", "items": [], "strong": [], "body": ""})
            self.begin("card", tag)
        if "card" not in inside:
            return
        card = self.cards[-1]
        if tag == "h3":
            self.begin("h3", tag)
        elif tag == "a" and "h3" in inside and card["href"] is None:
            card["href"] = attrs.get("href", "").strip()
            self.begin("title", tag)
        elif tag == "ul" and "search-result-details" in names:
            self.begin("details", tag)
        elif tag == "li" and "details" in inside and "item" not in inside:
            self.strong = False
            self.begin("item", tag)
        elif tag == "strong" and "item" in inside:
            self.strong = True
        elif tag == "p" and "search-result-description" in names:
            self.begin("body", tag)

    def end(self, name: str, t: _Text) -> None:
        card = self.cards[-1]
        if name in ("title", "body"):
            card[name] = t.text("" if name == "title" else " ")
        elif name == "item" and t.text():
            card["items"].append({"text": t.text(), "strong": self.strong})


def board_cards(pages: DataFrame) -> DataFrame:
    """Postings from the cards of result pages: employer and place from the item in bold, pay and date by their form, other
    items added to the description."""

    def make(html: str) -> list[tuple]:
        p = _Cards()
        p.feed(html)
        return [(c["aid"], c["href"], c["title"], c["items"], c["body"]) for c in p.cards]

    c = _parsed(pages, make, "aid string, href string, title string, items array<struct<text:string,strong:boolean>>, body string", ["aid", "href", "title", "items", "body"])
    c = c.where("title <> '' and href <> ''")
    employer = lambda x: x["strong"] & F.contains(x["text"], F.lit(" - "))
    paid = lambda x: ~employer(x) & F.contains(x["text"], F.lit("£"))
    dated = lambda x: ~employer(x) & ~F.contains(x["text"], F.lit("£")) & x["text"].rlike(r"^\d{1,2}\s+\w+\s+\d{4}$")
    last = lambda test: F.try_element_at(F.filter("items", test), F.lit(-1))["text"]
    c = c.withColumns({"e": last(employer), "pay": last(paid), "day": last(dated), "more": F.transform(F.filter("items", lambda x: ~employer(x) & ~paid(x) & ~dated(x)), lambda x: x["text"])})
    name, place = strip(F.substring_index("e", " - ", 1)), strip(F.expr("substring(e, instr(e, ' - ') + 3)"))
    sums = F.transform(F.regexp_extract_all(F.coalesce("pay", F.lit("")), F.lit(r"£\s?([\d,]+(?:\.\d+)?)"), F.lit(1)), lambda x: F.replace(x, F.lit(","), F.lit("")).try_cast("double"))
    text = F.concat_ws(" ", F.nullif("body", F.lit("")), F.array_join("more", " "))
    text = F.when(strip(text) == "", F.col("title")).otherwise(strip(text))
    c = c.withColumns({"description": text, "sums": sums})
    said = F.lower(F.concat_ws(" ", "title", "description"))
    model = F.when(F.contains(said, F.lit("remote")), "remote").when(F.contains(said, F.lit("hybrid")), "hybrid").when(said.rlike("on-?site"), "onsite").otherwise("unknown")
    return c.select(
        F.concat(F.lit("ukgov_"), F.coalesce(F.nullif("aid", F.lit("")), "href")).alias("job_id"), "title", F.coalesce(F.nullif(name, F.lit("")), F.lit("Unknown")).alias("company"), F.coalesce(F.nullif(place, F.lit("")), F.lit("UK")).alias("location"),
        F.when(F.size("sums") > 1, F.array_min("sums")).otherwise(F.try_element_at("sums", F.lit(1))).alias("salary_min"), F.when(F.size("sums") > 1, F.array_max("sums")).alias("salary_max"), F.substring("description", 1, MOST_CONTENT).alias("description"), F.col("href").alias("url"),
        F.to_date(F.try_to_timestamp("day", F.lit("d MMMM yyyy"))).alias("posted_date"), model.alias("work_model"),
    )


class _Page(_Reader):
    """Links, whole text and main text of a page."""

    DROP = frozenset(["nav", "header", "footer", "aside", "script", "style"])

    def __init__(self) -> None:
        super().__init__()
        self.found: dict[str, _Text] = {}
        self.links: list[dict] = []
        self.dropped = 0
        self.href: str | None = None
        self.whole = _Text()

    def start(self, tag: str, attrs: dict[str, str]) -> None:
        self.dropped += tag in self.DROP
        names = attrs.get("class", "").lower()
        # Parts of class names of job descriptions.
        if tag == "div" and any(x in names for x in ("jobdesc", "job-desc", "job_desc", "job desc", "jd", "content", "posting")):
            self.take("div", tag)
        if tag == "section" and any(x in names for x in ("job", "description", "content")):
            self.take("section", tag)
        if tag in ("article", "main", "body"):
            self.take(tag, tag)
        if tag == "a" and "href" in attrs:
            self.href = attrs["href"]
            self.begin("link", tag)

    def take(self, name: str, tag: str) -> None:
        if name not in self.found:
            self.found[name] = self.begin(name, tag)

    def handle_endtag(self, tag: str) -> None:
        self.dropped -= tag in self.DROP and self.dropped > 0
        super().handle_endtag(tag)

    def handle_data(self, data: str) -> None:
        for name, _, t in self.open:
            if name == "link" or not self.dropped:
                t.pieces.append(data)
        if "script" not in (self.lasttag or "") and "style" not in (self.lasttag or ""):
            self.whole.pieces.append(data)

    def end(self, name: str, t: _Text) -> None:
        if name == "link" and self.href is not None:
            self.links.append({"href": self.href, "text": t.text("")})
            self.href = None

    def main(self) -> str:
        for name in ("div", "section", "article", "main"):
            if name in self.found and len(text := self.found[name].text("\n")) > LEAST_CONTENT:
                return text
        return self.found["body"].text("\n") if "body" in self.found else ""


def page_content(pages: DataFrame, most: int = MOST_CONTENT) -> DataFrame:
    """(url, content, links, place): text of the job description's container without navigation, else the body's; links as
    they stand (href, text); the first place that the page names, else UK."""

    def make(html: str) -> list[tuple]:
        p = _Page()
        p.feed(html)
        return [(p.main()[:most], p.links, p.whole.text())]

    read = _parsed(pages, make, "content string, links array<struct<href:string,text:string>>, whole string", ["content", "links", "whole"])
    place = F.regexp_extract("whole", PAGE_PLACE, 1)
    return read.select("url", "content", "links", F.when(place == "", "UK").otherwise(place).alias("place"))


def job_links(content: DataFrame, keywords: list[str], most: int | None = 30, feeds_only: bool = True) -> DataFrame:
    """(url, at, href, text): links of a page whose text of 5 to 120 letters holds a keyword, resolved, each address once;
    on other hosts only known feeds, unless feeds_only is off. The first `most` of a page are the crawler's limit."""
    host = lambda c: F.coalesce(F.try_parse_url(c, F.lit("HOST")), F.lit(""))
    root = F.regexp_extract("url", r"^(https?://[^/]+)", 1)
    rows = content.select("url", F.posexplode("links").alias("at", "l")).select("url", "at", strip("l.text").alias("text"), F.when(F.startswith("l.href", F.lit("/")), F.concat(root, "l.href")).otherwise(F.col("l.href")).alias("href"))
    rows = rows.where(F.length("text").between(5, 120) & F.startswith("href", F.lit("http")) & mentions(F.col("text"), keywords))
    if feeds_only:
        rows = rows.where((host(F.col("href")) == host(F.col("url"))) | F.exists(F.array(*[F.lit(h) for h in FEED_HOSTS]), lambda h: F.contains(host(F.col("href")), h)))
    once = rows.groupBy("url", "href").agg(F.min_by("text", "at").alias("text"), F.min("at").alias("at"))
    if most is None:
        return once
    return once.withColumn("r", F.row_number().over(Window.partitionBy("url").orderBy("at"))).where(F.col("r") <= most).drop("r")


def mentions(text: Column, keywords: list[str]) -> Column:
    return F.exists(F.array(*[F.lit(k) for k in keywords]), lambda k: F.contains(F.lower(text), k))


def career_postings(pages: DataFrame, landed: DataFrame, keywords: list[str]) -> DataFrame:
    """(page, job_id, title, company, location, description, url, kind) of career pages (url, html, company): structured
    data if a page has any that mentions a keyword; else the job pages it links to, as far as they landed with enough
    text; else the links alone. landed: (url, html) of all fetched job pages."""
    jobs = json_ld(pages).join(pages.select(F.col("url").alias("page"), F.col("company").alias("firm")), "page").withColumn("company", F.col("firm"))
    structured = jobs.where(mentions(F.concat_ws(" ", "title", "description"), keywords)).select("page", "job_id", "title", "company", "location", "description", "url", F.lit("jsonld").alias("kind"))
    rest = pages.join(jobs.select(F.col("page").alias("url")).distinct(), "url", "left_anti")
    content = page_content(rest).join(rest.select("url", "company"), "url")
    links = job_links(content, keywords).select(F.col("url").alias("page"), "href", "text")
    named = links.join(rest.select(F.col("url").alias("page"), "company"), "page")
    own = json_ld(landed).groupBy(F.col("page").alias("href")).agg(F.min(F.struct("job_id", "title", "location", "description", "url")).alias("own"))
    read = page_content(landed).select(F.col("url").alias("href"), "content", "place")
    followed = named.join(read, "href").join(own, "href", "left").where(F.col("own").isNotNull() | (F.length("content") >= LEAST_CONTENT))
    job_pages = followed.select(
        "page", F.coalesce("own.job_id", surrogate("cp", F.col("href"))).alias("job_id"), F.coalesce("own.title", "text").alias("title"), "company", F.coalesce("own.location", "place").alias("location"),
        F.coalesce("own.description", "content").alias("description"), F.coalesce("own.url", "href").alias("url"), F.lit("page").alias("kind"),
    )
    last = rest.join(job_pages.select(F.col("page").alias("url")).distinct(), "url", "left_anti")
    bare = job_links(content.join(last.select("url"), "url", "left_semi"), keywords, most=None, feeds_only=False).join(rest.select("url", "company"), "url")
    text = F.concat(F.col("text"), F.lit(" at "), F.col("company"), F.lit(". Visit the job page for full details."))
    fallback = bare.select(F.col("url").alias("page"), surrogate("cp", F.col("href")).alias("job_id"), F.col("text").alias("title"), "company", F.lit("UK").alias("location"), text.alias("description"), F.col("href").alias("url"), F.lit("link").alias("kind"))
    return structured.unionByName(job_pages).unionByName(fallback)


def funded_postings(companies: DataFrame, landed: DataFrame, keywords: list[str], paths: tuple[str, ...] = CAREER_PATHS, most: int = 15) -> DataFrame:
    """(domain, careers_url, job_id, title, location, url) of funded companies (domain, name): the first career path whose
    landed page yields postings, structured ones before links; roles by their title, at most `most` links a page."""
    order = F.array(*[F.lit(p) for p in paths])
    tried = companies.select("domain", "name", F.posexplode(order).alias("at", "path")).select("domain", "name", "at", F.concat(F.lit("https://"), "domain", "path").alias("url"))
    pages = tried.join(landed, "url")
    jobs = json_ld(pages).where(mentions(F.col("title"), keywords)).select(F.col("page"), "title", "location", "url", F.lit(0).alias("kind"))
    linked = job_links(page_content(pages), keywords, most=most, feeds_only=False).select(F.col("url").alias("page"), F.col("text").alias("title"), F.lit("UK").alias("location"), F.col("href").alias("url"), F.lit(1).alias("kind"))
    found = jobs.unionByName(linked).join(pages.select(F.col("url").alias("page"), "domain", "at"), "page")
    best = found.groupBy("domain").agg(F.min(F.struct("at", "kind")).alias("b"))
    kept = found.join(best, "domain").where((F.col("at") == F.col("b.at")) & (F.col("kind") == F.col("b.kind")))
    return kept.select("domain", F.col("page").alias("careers_url"), surrogate("fn", F.concat("page", "title")).alias("job_id"), "title", "location", "url").distinct()
