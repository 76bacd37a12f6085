"""Mapping free-entered values to a canonical list: places to cities, job titles to role titles.

A value is cut into the parts that may name an entry (frames such as "Hybrid - X", "X, county", seniority, references
and pay are left aside), abbreviations are spelt out by a table of fixed values or by rule, and each part is looked up in
a symmetric-delete dictionary of bounded edit distance. Candidates rank by weighted Damerau-Levenshtein distance, then
by how often the entry occurs letter for letter among all values, then by code point. Values that match nothing are
reported with a NULL entry.

The dictionary is broadcast, MOST_ENTRIES entries of the reference list at a time: a longer list goes in several rounds over
the distinct values, and the best candidate of all rounds stays. Values are mapped once per distinct value and task;
nothing is shuffled but the counts of the entries and, with several rounds, the distinct values.

Abbreviations and the words around a name are parameters (Lexicon); another reference list brings its own.

Defined cases: a NULL or blank value gives no row; a value equal to an entry letter for letter gives that entry with
distance 0; repeated rows give repeated results; empty tables give none; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postlode.llm.blobs import share
from postlode.llm.edits import Dictionary, fold
from postlode.session import cut

MOST_ENTRIES = 100_000
MEMO = 200_000
POSTCODE = re.compile(r"(?<![a-z0-9])([a-z]{1,2})\d[a-z\d]?\s?\d[a-z]{2}(?![a-z0-9])")
PLACE_SPLIT = re.compile(r"\s*[,;|()\[\]]\s*|\s+[-–—/]\s+|\s+or\s+|\s+and\s+")
# Words around a place that are no part of its name.
PLACE_FRAME = re.compile(
    r"^(?:hybrid|remote|onsite|on-site|central|greater|inner|outer|near|nr\.?|close to|commutable to|commutable from|based in|in|around|city of)\b[\s:.-]*"
    r"|[\s-]*\b(?:city centre|town centre|centre|area|region|based|hybrid|remote|united kingdom|uk|england|gb)$"
)
# Abbreviations in place names.
PLACE_WORDS = {"st": "saint", "gt": "great", "grt": "great", "pt": "port", "n": "north", "s": "south", "e": "east", "w": "west", "x": "cross", "nth": "north", "sth": "south", "lit": "little", "lt": "little", "up": "upper", "o": "on"}
# Abbreviations in job titles.
TITLE_WORDS = {
    "eng": "engineer", "engr": "engineer", "engnr": "engineer", "dev": "developer", "devs": "developer", "mgr": "manager", "mngr": "manager", "arch": "architect",
    "admin": "administrator", "des": "designer", "sci": "scientist", "anl": "analyst", "tech": "technical", "sys": "systems", "system": "systems", "prod": "product",
    "proj": "project", "bus": "business", "biz": "business", "sec": "security", "mstr": "master", "pen": "penetration", "pentest": "penetration test", "lang": "language",
    "db": "database", "sw": "software", "fe": "frontend", "be": "backend", "qa": "quality assurance", "nlp": "natural language processing", "cv": "computer vision",
    "ml": "machine learning", "sre": "site reliability engineer", "swe": "software engineer", "mle": "machine learning engineer", "ba": "business analyst",
    "dba": "database administrator", "sysadmin": "systems administrator", "fullstack": "full stack", "solution": "solutions", "games": "game", "prompts": "prompt",
    "projects": "project", "products": "product", "int": "interaction", "ux": "interaction", "ntwk": "network", "comp": "computer", "pentester": "penetration tester", "del": "delivery", "net": "network", "sd": "software developer", "pm": "project manager",
}
# A second reading of an abbreviation before another word.
TITLE_WORDS_BEFORE = {"eng": "engineering", "dev": "development", "qa": "quality assurance", "admin": "administration"}
SENIORITY = re.compile(r"(?<![\w-])(?:graduate|grad|trainee|apprentice|junior|jnr|jr|mid[ -]?level|mid|senior|snr|sr|lead|principal|staff|chief|head|entry[ -]?level)(?![\w-])\.?")
TITLE_NOISE = re.compile(
    r"£\s?[\d,.]+\s?(?:k|pd|ph|p/h|p/d)?(?:\s?(?:per|/|a|an)\s?(?:day|hour|annum|year))?|\b(?:ref|req|id|job|jr|jn)\.?\s?(?:no\.?)?\s?[#:]?\s?\d+|\b\d+\s*month\s*ftc\b|\*+\s*new\s*\*+|"
    r"^\W*(?:urgent|immediate start|new|hiring|now hiring)\b[\s:!-]*|\b(?:apply today|second round|repost|perm|permanent|contract|hybrid|remote|ftc)\b|#?\d{3,}"
)
TITLE_SPLIT = re.compile(r"\s*[,;|()\[\]:!*]+\s*|\s+[-–—/]+\s*|\s*[-–—/]+\s+|\s*/\s*")
LETTERS = re.compile(r"[a-z0-9]+")
# Place among the candidates of a value: how it was found, distance, part of the value, minus frequency, entry.
Rank = tuple[int, float, int, int, str]
NONE = (9, 0.0, 0, 0, "")


@dataclass(frozen=True)
class Lexicon:
    """What a list's values are read with: abbreviations of places and titles, and the words that stand around a name."""

    places: dict[str, str] = field(default_factory=lambda: PLACE_WORDS)
    place_frame: re.Pattern[str] = PLACE_FRAME
    titles: dict[str, str] = field(default_factory=lambda: TITLE_WORDS)
    titles_before: dict[str, str] = field(default_factory=lambda: TITLE_WORDS_BEFORE)
    seniority: re.Pattern[str] = SENIORITY
    title_noise: re.Pattern[str] = TITLE_NOISE


USUAL = Lexicon()


def squeeze(text: str) -> str:
    return "".join(LETTERS.findall(text))


def _spelt(words: list[str], table: dict[str, str]) -> str:
    return squeeze("".join(table.get(w, w) for w in words))


def place_keys(city: str) -> list[str]:
    """Keys of a city: its letters, and its first word if long enough to stand alone."""
    words = LETTERS.findall(fold(city))
    keys = [squeeze(fold(city))]
    if len(words) > 1 and len(words[0]) >= 6:
        keys.append(words[0])
    if len(words) > 1:
        keys.append("".join(words[:-1]) + words[-1][0])
    return keys


def place_matcher(areas: list[tuple[str, str]], counts: dict[str, int], lexicon: Lexicon = USUAL) -> Callable[[str], Rank]:
    cities = sorted({c for _, c in areas})
    of_area = {a.lower(): c for a, c in areas}
    book = Dictionary((k, c, counts.get(c, 0)) for c in cities for k in place_keys(c))
    # beginnings and ends around an apostrophe that stands for what lies between
    ends: dict[tuple[str, str], str] = {}
    for c in sorted(cities, key=lambda c: (counts.get(c, 0), c)):
        k = squeeze(fold(c))
        ends.update(((k[:i], k[j:]), c) for i in (1, 2, 3) for j in range(i + 1, len(k) - 1))

    def match(value: str) -> Rank:
        text = " ".join(fold(value).split())
        m = POSTCODE.search(text)
        if m and m[1] in of_area:
            return 0, 0.0, 0, 0, of_area[m[1]]
        best: Rank | None = None
        for i, part in enumerate(PLACE_SPLIT.split(text)):
            for _ in range(3):
                shorter = lexicon.place_frame.sub("", part).strip(" .-")
                if shorter == part:
                    break
                part = shorter
            if not part:
                continue
            brief = re.fullmatch(r"([a-z]{1,3})['’`]([a-z]{2,})", part.replace(" ", ""))
            city = ends.get((brief[1], brief[2])) if brief else None
            if city:
                return 1, 0.0, i, -counts.get(city, 0), city
            words = LETTERS.findall(part.replace("'", "").replace("’", ""))
            for key in dict.fromkeys((squeeze("".join(words)), _spelt(words, lexicon.places))):
                hit = book.lookup(key)
                if hit and (best is None or (2, hit[0], i, hit[1], hit[2]) < best):
                    best = (2, hit[0], i, hit[1], hit[2])
        return best or NONE

    return match


def _shortened(short: str, word: str) -> bool:
    if short == word:
        return True
    if len(short) < 3 or short[0] != word[0] or len(short) > len(word):
        return False
    rest = iter(word)
    return all(c in rest for c in short)


def title_matcher(roles: list[str], counts: dict[str, int], lexicon: Lexicon = USUAL) -> Callable[[str], Rank]:
    TITLE_WORDS, TITLE_WORDS_BEFORE = lexicon.titles, lexicon.titles_before
    book = Dictionary((squeeze(fold(r)), r, counts.get(r, 0)) for r in roles)
    # roles by the first letters of their words
    role_words: dict[str, dict[tuple[str, ...], str]] = {}
    for r in sorted(roles, key=lambda r: (-counts.get(r, 0), r)):
        w = tuple(LETTERS.findall(fold(r)))
        role_words.setdefault("".join(x[0] for x in w), {})[w] = r

    most_words = max((len(w) for ws in role_words.values() for w in ws), default=0)

    @lru_cache(maxsize=50_000)
    def part(words: tuple[str, ...]) -> tuple[float, int, str] | None:
        """Best entry of some words, as they stand and with the head word moved to the end."""
        best = None
        plain = [w for w in words if w]
        if not plain:
            return None
        spelt = LETTERS.findall(" ".join(TITLE_WORDS.get(w, w) for w in plain))
        orders = [plain, spelt]
        other = LETTERS.findall(" ".join(TITLE_WORDS_BEFORE.get(w, TITLE_WORDS.get(w, w)) for w in plain[:-1]) + " " + TITLE_WORDS.get(plain[-1], plain[-1]))
        if other != spelt:
            orders.append(other)
        turned = len(orders)
        if len(spelt) > 1:
            orders += [spelt[1:] + spelt[:1], plain[1:] + plain[:1]]
        tried: set[str] = set()
        for k, o in enumerate(orders):
            key = squeeze("".join(o))
            if key in tried:
                continue
            tried.add(key)
            hit = book.lookup(key)
            if hit:
                hit = (hit[0] + (0.1 if k >= turned else 0.0), hit[1], hit[2])
                if best is None or hit < best:
                    best = hit
                if best[0] == 0:
                    break
        return best

    def match(value: str) -> Rank:
        text = " ".join(fold(value).split())
        text = lexicon.title_noise.sub(" , ", text)
        text = lexicon.seniority.sub(" ", text).replace("'", "")
        text = re.sub(r"\bs/w\b", "sw", re.sub(r"\bdev[ -]ops\b", "devops", re.sub(r"\bq\.\s?a\b", "qa", text)))
        parts = [tuple(LETTERS.findall(p)) for p in TITLE_SPLIT.split(text)]
        parts = [p for p in parts if p]
        best: tuple[float, int, int, str] | None = None
        for i, p in enumerate(parts):
            tries = [p, parts[i + 1] + p if i + 1 < len(parts) else (), p + parts[i + 1] if i + 1 < len(parts) else ()]
            for j, words in enumerate(tries):
                hit = part(words) if words else None
                # the earliest part, then two parts together, then later ones
                if hit and (best is None or (hit[0], 2 * i + j, hit[1], hit[2]) < best):
                    best = (hit[0], 2 * i + j, hit[1], hit[2])
            if best and best[0] == 0 and i == 0:
                break
        if best is not None:
            return 2, *best
        # words shortened by leaving letters out: each begins as its word does and keeps the order of its letters
        for p in parts:
            spelt = LETTERS.findall(" ".join(TITLE_WORDS.get(w, w) for w in p))
            for w, r in role_words.get("".join(x[0] for x in spelt), {}).items():
                if all(_shortened(a, b) for a, b in zip(spelt, w, strict=True)):
                    return 3, 1.5, 0, -counts.get(r, 0), r
        # an entry spelt out among other words
        longest: Rank | None = None
        for p in parts:
            spelt = LETTERS.findall(" ".join(TITLE_WORDS.get(w, w) for w in p))
            for n in range(min(most_words, len(spelt) - 1), 1, -1):
                for a in range(len(spelt) - n + 1):
                    key = "".join(spelt[a : a + n])
                    if key in book.exact and (longest is None or (4, 0.5, -len(key)) < longest[:3]):
                        longest = (4, 0.5, -len(key), *book.exact[key][0])
        return longest or NONE

    return match


def reference_counts(df: DataFrame, column: str, entries: list[str]) -> dict[str, int]:
    """How often each entry occurs letter for letter; at most one row an entry comes back."""
    listed = df.sparkSession.createDataFrame([(e,) for e in entries], f"{column} string")
    rows = df.select(column).join(F.broadcast(listed), column).groupBy(column).count().collect()
    return {r[0]: r[1] for r in rows}


SCHEMA = "key string, field string, value string, entry string, distance double, rank struct<how:int,distance:double,part:int,often:bigint,entry:string>"


def map_values(df: DataFrame, key: str, fields: dict[str, tuple[list, dict[str, int], str]], lexicon: Lexicon = USUAL) -> DataFrame:
    """(key, field, value, entry, distance, rank) of every non-blank value of the fields: field -> (reference, counts, kind)."""
    spark = df.sparkSession
    shared = share(spark, fields)
    names = list(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        match = {f: (place_matcher if kind == "place" else title_matcher)(ref, counts, lexicon) for f, (ref, counts, kind) in shared.value.items()}
        memo: dict[tuple[str, str], Rank] = {}
        kinds = [pa.string()] * 4 + [pa.float64(), pa.struct([("how", pa.int32()), ("distance", pa.float64()), ("part", pa.int32()), ("often", pa.int64()), ("entry", pa.string())])]
        for b in batches:
            out: list[tuple] = []
            ids = b.column(0).to_pylist()
            for c, f in enumerate(names, 1):
                for i, v in zip(ids, b.column(c).to_pylist(), strict=True):
                    if v is None or not v.strip():
                        continue
                    got = memo.get((f, v))
                    if got is None:
                        if len(memo) > MEMO:
                            memo.clear()
                        got = memo[f, v] = match[f](v)
                    out.append((i, f, v, None if got == NONE else got[4], got[1], dict(zip(("how", "distance", "part", "often", "entry"), got, strict=True))))
            cols = list(zip(*out, strict=True)) if out else [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["key", "field", "value", "entry", "distance", "rank"])

    return df.select(F.col(key).cast("string"), *names).mapInArrow(run, SCHEMA)


def map_column(df: DataFrame, key: str, column: str, reference: DataFrame, kind: str, lexicon: Lexicon = USUAL, most_entries: int = MOST_ENTRIES) -> DataFrame:
    """(key, field, value, entry, distance) of every non-blank value of a column. reference: (area, city) for places,
    (entry) for titles; rows with a NULL are left out."""
    listed = reference.dropna().distinct()
    rounds = max(1, -(-listed.count() // most_entries))
    if rounds == 1:
        rows = sorted(tuple(r) for r in listed.collect())
        return map_values(df, key, {column: _reference(df, column, rows, kind)}, lexicon).drop("rank")
    values = cut(df.select(F.col(column)).where(F.col(column).isNotNull()).distinct().withColumn("_none", F.lit(None).cast("string")))
    best = None
    for r in range(rounds):
        rows = sorted(tuple(x) for x in listed.where(F.pmod(F.xxhash64(*reference.columns), F.lit(rounds)) == r).collect())
        part = cut(map_values(values, "_none", {column: _reference(df, column, rows, kind)}, lexicon).select("value", "rank"))
        best = part if best is None else best.unionByName(part)
    chosen = best.groupBy("value").agg(F.min("rank").alias("rank"))
    found = df.select(F.col(key).cast("string").alias("key"), F.col(column).alias("value")).join(chosen, "value")
    return found.select("key", F.lit(column).alias("field"), "value", F.when(F.col("rank.how") < NONE[0], F.col("rank.entry")).alias("entry"), F.col("rank.distance").alias("distance"))


def _reference(df: DataFrame, column: str, rows: list[tuple], kind: str) -> tuple[list, dict[str, int], str]:
    if kind == "place":
        return rows, reference_counts(df, column, sorted({c for _, c in rows})), kind
    titles = [r[0] for r in rows]
    return titles, reference_counts(df, column, titles), kind


def map_postings(raw: DataFrame, areas: DataFrame, roles: DataFrame, lexicon: Lexicon = USUAL, most_entries: int = MOST_ENTRIES) -> DataFrame:
    """Location and title of postings: (key, field, value, entry, distance). Short lists share one pass over the postings."""
    area_list, role_list = areas.select("area", "city").dropna().distinct(), roles.select("role_title").dropna().distinct()
    if area_list.count() <= most_entries and role_list.count() <= most_entries:
        places, titles = (sorted(tuple(r) for r in x.collect()) for x in (area_list, role_list))
        return map_values(raw, "job_id", {"location": _reference(raw, "location", places, "place"), "title": _reference(raw, "title", titles, "title")}, lexicon).drop("rank")
    return map_column(raw, "job_id", "location", area_list, "place", lexicon, most_entries).unionByName(map_column(raw, "job_id", "title", role_list, "title", lexicon, most_entries))
