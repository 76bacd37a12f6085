"""Ordered text rules (signals, roles, seniority, work model, pay period, place) as CASE expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Patterns and their order decide the results.
SPONSOR_POSITIVE = (
    r"visa\s+sponsorship\s+(available|offered|provided)?",
    r"willing\s+to\s+sponsor",
    r"skilled\s+worker\s+visa",
    r"sponsor(ship)?\s+for\s+the\s+right\s+candidate",
    r"we\s+can\s+sponsor",
    r"tier\s*2\s+sponsor",
    r"sponsorship\s+available",
)
SPONSOR_NEGATIVE = (
    r"uk\s+citizen(s)?(\s+only)?",
    r"must\s+have\s+(the\s+)?right\s+to\s+work.*without\s+sponsorship",
    r"no\s+(visa\s+)?sponsorship",
    r"cannot\s+offer\s+sponsorship",
    r"not\s+able\s+to\s+sponsor",
    r"without\s+sponsorship",
    r"sc\s+clearance",
    r"dv\s+clearance",
    r"security\s+clearance",
)
NEGATION = r"(?:no|cannot|without|not)\s+"
STARTUP = (
    r"seed\s+(stage|funded|round)",
    r"series\s+[ab]\b",
    r"early[\s-]stage",
    r"pre[\s-]series",
    r"backed\s+by\s+(y\s*combinator|yc|a16z|sequoia)",
    r"founding\s+(engineer|team|member)",
    r"\bstartup\b",
    r"we.?re\s+building\s+from\s+(the\s+)?ground",
)
ROLES = (
    ("MLOps", r"(?i)\bmlops\b|\bml\s*ops\b|\bml\s*platform\b|\bmachine\s*learning\s*platform\b|\bml\s*infra"),
    ("Computer Vision", r"(?i)\bcomputer\s*vision\b|\bcv\s*engineer\b|\bvision\s*engineer\b|\bimage\s*recognition\b"),
    ("NLP", r"(?i)\bnlp\b|\bnatural\s*language\s*processing\b"),
    ("Research", r"(?i)\bresearch\s*(scientist|engineer|associate)\b|\bapplied\s*scientist\b"),
    ("AI/LLM Engineer", r"(?i)\bai\s*engineer\b|\bllm\s*engineer\b|\bgenerative\s*ai\b|\bgen\s*ai\b|\bprompt\s*engineer\b|\bai\s*/\s*ml\s*engineer\b|\bartificial\s*intelligence\s*engineer\b"),
    ("ML Engineer", r"(?i)\bmachine\s*learning\s*engineer\b|\bml\s*engineer\b"),
    ("Data Scientist", r"(?i)\bdata\s*scientist\b"),
    ("Data Engineer", r"(?i)\bdata\s*engineer\b"),
)
SENIORITY = (
    ("Principal", r"(?i)\bprincipal\b"),
    ("Staff", r"(?i)\bstaff\b"),
    ("Lead", r"(?i)\blead\b"),
    ("Senior", r"(?i)\bsenior\b|\bsr\.?\b"),
    ("Junior", r"(?i)\bjunior\b|\bjr\.?\b|\bgraduate\b|\bentry\s*level\b"),
    ("Mid", r"(?i)\bmid\s*-?\s*level\b"),
)
DAILY = r"(?i)\bper\s*day\b|\bper\s*diem\b|\bday\s*rate\b|\bp\s*/\s*day\b|/\s*day\b"
HOURLY = r"(?i)\bper\s*hour\b|\bhourly\s*rate\b|\bp\s*/\s*h\b|/\s*h(?:ou)?r\b"
ANNUAL = r"(?i)\bper\s*annum\b|\bper\s*year\b|\bannual\s*salary\b|\bp\.?a\.?\b|/\s*year\b|/\s*annum\b"
POSTCODE = r"(?i)\b([A-Z]{1,2})\d[A-Z\d]?\s?\d[A-Z]{2}\b"
REMOTE = r"(?i)\bremote\b|\bwork\s*from\s*home\b|\bwfh\b"
LEAST_ANNUAL, MOST_DAILY, MOST_HOURLY = 5000, 3000, 500
DAYS_A_YEAR, HOURS_A_YEAR = 220, 1650
# Cues of working on site by source; the others have none but "on-site".
ONSITE = {"adzuna": r"on-?site|in-office", "hn_who_is_hiring": r"on-?site|in office"}


def cases(pairs: list[tuple[Column, object]], otherwise: object) -> Column:
    c = None
    for cond, value in pairs:
        value = value if isinstance(value, Column) else F.lit(value)
        c = F.when(cond, value) if c is None else c.when(cond, value)
    return c.otherwise(otherwise)  # type: ignore[union-attr]


def sponsorship(text: Column) -> tuple[Column, Column, Column]:
    """(offers: true or NULL, citizens only: true or NULL, matched phrases)."""
    t = F.lower(F.coalesce(text, F.lit("")))
    hits = [(t.rlike(p) & ~t.rlike(NEGATION + p), F.regexp_extract(t, p, 0)) for p in SPONSOR_POSITIVE]
    none = F.lit(None).cast("string")
    good = cases(hits, none)
    bad = cases([(t.rlike(p), F.regexp_extract(t, p, 0)) for p in SPONSOR_NEGATIVE], none)
    return F.when(good.isNotNull(), F.lit(True)), F.when(bad.isNotNull(), F.lit(True)), F.array_compact(F.array(good, bad))


def startup(text: Column, company: Column) -> Column:
    t = F.lower(F.concat_ws(" ", F.coalesce(company, F.lit("")), F.coalesce(text, F.lit(""))))
    return t.rlike("|".join(f"(?:{p})" for p in STARTUP))


def work_model(text: Column, source: Column) -> Column:
    """Remote before hybrid before on site; the cue of the last differs by source."""
    t = F.lower(F.coalesce(text, F.lit("")))
    site = reduce(lambda acc, kv: F.when(F.coalesce(source, F.lit("")) == kv[0], t.rlike(kv[1])).otherwise(acc), ONSITE.items(), t.rlike(r"on-?site"))
    return F.when(t.contains("remote"), "remote").when(t.contains("hybrid"), "hybrid").when(site, "onsite").otherwise("unknown")


def role_category(title: Column, description: Column) -> Column:
    """By the title; by the description only if no rule holds for the title."""
    a, b = F.coalesce(title, F.lit("")), F.coalesce(description, F.lit(""))
    return cases([(a.rlike(p), n) for n, p in ROLES], cases([(b.rlike(p), n) for n, p in ROLES], "Other"))


def seniority(title: Column) -> Column:
    t = F.coalesce(title, F.lit(""))
    return cases([(t.rlike(p), n) for n, p in SENIORITY], "Unspecified")


def salary_period(text: Column, lo: Column, hi: Column) -> Column:
    t = F.coalesce(text, F.lit(""))
    return (
        F.when(lo.isNull() & hi.isNull(), "unknown").when(t.rlike(DAILY), "daily").when(t.rlike(HOURLY), "hourly").when(t.rlike(ANNUAL), "annual")
        .when(F.greatest(lo, hi) < LEAST_ANNUAL, "unknown").otherwise("annual")
    )


def annualise(value: Column, period: Column) -> Column:
    """Pounds a year; NULL for an unknown period, an implausible rate or a result below LEAST_ANNUAL."""
    year = (
        F.when(period == "annual", value).when((period == "daily") & (value <= MOST_DAILY), value * DAYS_A_YEAR)
        .when((period == "hourly") & (value <= MOST_HOURLY), value * HOURS_A_YEAR)
    )
    return F.when(year >= LEAST_ANNUAL, year)


def place(location: Column, areas: list[tuple[str, str]]) -> Column:
    """Known postcode area, else the longest city that occurs, else Remote, Other or Unknown."""
    loc = F.coalesce(location, F.lit(""))
    lookup = F.create_map(*[F.lit(x) for a, c in sorted(areas) for x in (a.upper(), c)])
    by_code = F.try_element_at(lookup, F.upper(F.regexp_extract(loc, POSTCODE, 1)))
    cities = sorted({c for _, c in areas}, key=lambda c: (-len(c), c))
    first = F.try_element_at(F.filter(F.array(*[F.lit(c) for c in cities]), lambda c: F.contains(F.lower(loc), F.lower(c))), F.lit(1))
    return F.when(F.regexp_replace(loc, r"\s", "") == "", "Unknown").otherwise(F.coalesce(by_code, first, F.when(loc.rlike(REMOTE), "Remote").otherwise("Other UK")))


def area_list(areas: DataFrame, most: int = 10_000) -> list[tuple[str, str]]:
    """The postcode areas as literals; a list beyond `most` does not belong into an expression."""
    rows = areas.select("area", "city").where("area is not null and city is not null").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} postcode areas")
    return [(r[0], r[1]) for r in rows]
