"""Variant spellings of names typed by people: link the spellings of one organisation.

1. The distinct spellings of all tables are parsed into tokens (accents and case folded, "trading as" parts left out).
2. A symmetric-delete neighbourhood index over the distinct tokens finds tokens one weighted edit apart; each rare token
   follows its most frequent neighbour, to the end of the chain, so that a typo meets the usual form. Tokens under
   EDITED letters have no neighbours: one edit turns too many of them into another name.
3. Spellings meet on their core tokens (neither legal form, trade word, given name nor the acronym of the others), in any
   order. Cores that share all tokens but one meet too, over a deletion index of that token (two edits), its prefixes
   (abbreviations) or its absence; where an abbreviation or a missing token could mean several cores, it means none.
4. In each meeting the most frequent form is the centre, and every other is aligned with it: core tokens are assigned one
   to one at least total cost (Hungarian method), with initials for given names, nicknames and abbreviated trade words
   permitted. What the centre does not accept meets again under the next centre, until nothing is left.

Meetings hold forms (core, given name, trade), not spellings: their number is bounded by the lists of given names and
trades, however many spellings or rows a name has. Links are stars around the centre. A pair of spellings is written out
only in the final result. The lists of words are parameters (Words).

Defined cases: NULL, blank and placeholder values, and values without a core token, name nobody and are linked to
nothing; spellings that differ only by case or blanks are different spellings of one name; an empty table gives no
rows; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postlode.llm.edits import deletes, fold, weighted_distance
from postlode.session import cut

# Legal forms and fillers.
LEGAL = frozenset("ltd limited llp plc inc incorporated corp corporation co company cic gmbh uk group the and of lp sa bv".split())
# Trade words; their abbreviations are recognised by rule.
TRADES = tuple("associates laboratories insurance recruitment consulting energy analytics health technologies systems international logistics finance services robotics manufacturing solutions engineering holdings software media partners capital group digital".split())
# Values that name nobody.
NOBODY = frozenset(["", "-", "na", "n a", "none", "unknown", "confidential", "company confidential", "tbc", "tba", "not disclosed", "undisclosed", "private", "client", "confidential client", "our client", "various", "null", "anonymous", "test", "recruiter", "employer"])
# Given names with their short forms.
GIVEN = {
    "elizabeth": "liz lizzie beth betty eliza betsy libby", "edward": "ed eddie ted teddy ned", "margaret": "maggie meg peggy marge madge greta", "katherine": "kate kathy katie kat kitty kath",
    "william": "will bill billy willy liam", "richard": "rick dick rich ricky richie", "frederick": "fred freddie freddy", "thomas": "tom tommy", "theodora": "dora theo thea",
    "robert": "rob bob bobby robbie bert", "michael": "mike mick mickey micky", "susannah": "sue susie suki suzy susan", "james": "jim jimmy jamie", "john": "jack johnny", "charles": "charlie chuck",
    "alexander": "alex sandy", "alexandra": "alex sandra sasha", "anthony": "tony", "catherine": "cathy cath", "daniel": "dan danny", "david": "dave", "henry": "harry hal", "joseph": "joe joey",
    "nicholas": "nick nicky", "patricia": "pat patsy tricia", "samuel": "sam sammy", "stephen": "steve", "victoria": "vicky tori", "jennifer": "jenny jen", "rebecca": "becky becca",
}
EDITED = 5
# Least letters of the two halves of words written together, and of a token that two edits may change.
HALF = 4
TWICE_EDITED = 8
# Costs of one token for another: two edits of which one is light, an abbreviation, a token that one side lacks.
MOST_COST = 1.8
SHORTENED = 0.5
LACKING = 1.0
ALIAS = re.compile(r"\b(?:t/a|trading as|d/b/a|dba|formerly|a\.?k\.?a\.?)\b.*")
TOKEN = re.compile(r"[a-z0-9]+")
RUN_ON = re.compile(r"(?<=[a-zß-ÿ]{4})(?=[A-Z][a-zß-ÿ]{3})")


@dataclass(frozen=True)
class Words:
    """Lists that parsing goes by: legal forms, trade words, values that name nobody, given names with short forms."""

    legal: frozenset[str] = LEGAL
    trades: tuple[str, ...] = TRADES
    nobody: frozenset[str] = NOBODY
    given: tuple[tuple[str, str], ...] = tuple(GIVEN.items())

    @cached_property
    def given_of(self) -> dict[str, str]:
        return {s: g for g, short in self.given for s in [g, *short.split()]}


USUAL = Words()


def tokens(value: str, words: Words = USUAL) -> list[str]:
    text = ALIAS.sub("", fold(RUN_ON.sub(" ", " ".join(value.split()))))
    text = text.replace("s/w", "software").replace("'", "").replace("’", "")
    found = TOKEN.findall(text)
    return [] if " ".join(found) in words.nobody else found


def trade_of(token: str, words: Words = USUAL) -> str:
    """The trade words, in one string, that a token is, begins like, or else abbreviates by leaving letters out."""
    if token in words.trades:
        return token
    alike = [t for t in words.trades if (len(token) >= 6 and token[:6] == t[:6]) or (len(token) >= 3 and t.startswith(token))]
    if not alike and 2 <= len(token) <= 8:
        for t in words.trades:
            rest = iter(t)
            if token[0] == t[0] and all(c in rest for c in token):
                alike.append(t)
    return " ".join(sorted(alike))


def parse(found: list[str], words: Words = USUAL) -> tuple[list[str], str, str]:
    """(core tokens sorted, given name or initial, trade) of a spelling's tokens."""
    core, given, trade, brief = [], "", "", []
    for i, t in enumerate(found):
        if t in words.legal:
            continue
        if t in words.given_of and len(found) > 2:
            given = given or words.given_of[t]
        elif len(t) == 1 and i < 2:
            given = given or t
        elif w := trade_of(t, words):
            trade = trade or w
            if t not in words.trades:
                brief.append(t)
        elif len(t) > 1 and not _acronym(t, found):
            core.append(t)
    if not core and brief:
        # a name of short tokens alone is no abbreviation of a trade
        core, trade = brief[:1], trade_of(brief[1], words) if len(brief) > 1 else next((t for t in found if t in words.trades and t not in words.legal), "")
    return sorted(set(core)), given, trade


def _acronym(token: str, found: list[str]) -> bool:
    """Whether a token is made of the initials of other tokens, in their order."""
    initials = iter([t[0] for t in found if t != token])
    return 2 <= len(token) <= len(found) - 1 and all(c in initials for c in token)


def token_cost(p: str, q: str) -> float:
    """Cost of one core token for another, above MOST_COST if they cannot be the same."""
    if p == q:
        return 0.0
    short, long = sorted((p, q), key=len)
    if len(short) >= 3 and len(short) < len(long) and long.startswith(short):
        return SHORTENED
    most = 0.0 if len(short) < EDITED else 1.0 if len(short) < TWICE_EDITED else MOST_COST
    d = weighted_distance(p, q, most)
    return d if d <= most else MOST_COST + 1


def assignment(cost: list[list[float]]) -> list[int]:
    """Column of each row in the one-to-one assignment of least total cost; no more rows than columns (Hungarian method)."""
    n, m = len(cost), len(cost[0])
    u, v, row_of, way = [0.0] * (n + 1), [0.0] * (m + 1), [0] * (m + 1), [0] * (m + 1)
    for i in range(1, n + 1):
        row_of[0], j = i, 0
        least, used = [float("inf")] * (m + 1), [False] * (m + 1)
        while True:
            used[j] = True
            at, delta, to = row_of[j], float("inf"), 0
            for k in range(1, m + 1):
                if not used[k]:
                    c = cost[at - 1][k - 1] - u[at] - v[k]
                    if c < least[k]:
                        least[k], way[k] = c, j
                    if least[k] < delta:
                        delta, to = least[k], k
            for k in range(m + 1):
                if used[k]:
                    u[row_of[k]] += delta
                    v[k] -= delta
                else:
                    least[k] -= delta
            j = to
            if not row_of[j]:
                break
        while j:
            row_of[j] = row_of[way[j]]
            j = way[j]
    out = [0] * n
    for k in range(1, m + 1):
        if row_of[k]:
            out[row_of[k] - 1] = k - 1
    return out


def align(a: tuple[list[str], str, str], b: tuple[list[str], str, str]) -> float | None:
    """Cost of the best one-to-one assignment of two parsed spellings' tokens, None if they cannot name the same. One
    token may have no counterpart, if at least one other has."""
    (x, ga, ta), (y, gb, tb) = a, b
    if ga and gb and ga != gb and not (len(ga) == 1 and gb.startswith(ga)) and not (len(gb) == 1 and ga.startswith(gb)):
        return None
    if ta and tb and not set(ta.split()) & set(tb.split()):
        return None
    if len(x) > len(y):
        x, y = y, x
    if not x or len(y) - len(x) > 1:
        return None
    cells = [[token_cost(p, q) for q in y] for p in x]
    found = [cells[i][j] for i, j in enumerate(assignment(cells))]
    if max(found) > MOST_COST or (len(y) > 1 and min(found) > 0):
        return None
    return sum(found) + LACKING * (len(y) - len(x))


def spellings(frames: list[tuple[DataFrame, str]]) -> DataFrame:
    """(value, n): distinct non-NULL spellings of all columns and the rows that have them."""
    parts = [df.select(F.col(c).alias("value")).where(F.col(c).isNotNull()).groupBy("value").agg(F.count(F.lit(1)).alias("n")) for df, c in frames]
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    return whole.groupBy("value").agg(F.sum("n").alias("n"))


def token_roots(parsed: DataFrame) -> DataFrame:
    """(token, root): rare tokens and the frequent neighbour they are taken for."""
    counts = cut(parsed.select("n", F.explode(F.array_distinct("tokens")).alias("token")).where(f"length(token) >= {EDITED}").groupBy("token").agg(F.sum("n").alias("n")))

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            k, t, n = [], [], []
            for token, count in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                for d in deletes(token, 1):
                    k.append(d)
                    t.append(token)
                    n.append(count)
            yield pa.RecordBatch.from_arrays([pa.array(k, pa.string()), pa.array(t, pa.string()), pa.array(n, pa.int64())], names=["k", "token", "n"])

    index = counts.mapInArrow(keys, "k string, token string, n bigint")
    a, b = index.select("k", "token", "n"), index.select("k", F.col("token").alias("other"), F.col("n").alias("m"))
    # only from the rarer to the more frequent one, so roots are reached and never circular
    near = a.join(b, "k").where("m > n or (m = n and other > token)").select("token", "other", "m").distinct()

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            ok = [weighted_distance(p, q, 1.0) <= 1.0 for p, q in zip(x.column(0).to_pylist(), x.column(1).to_pylist(), strict=True)]
            yield x.filter(pa.array(ok, pa.bool_()))

    best = near.mapInArrow(check, "token string, other string, m bigint").groupBy("token").agg(F.max_by("other", F.struct("m", "other")).alias("root"))
    best = cut(best)
    while True:
        # a typo of a typo follows on: each round doubles the steps
        onward = best.select(F.col("token").alias("root"), F.col("root").alias("next"))
        after = cut(best.join(onward, "root", "left").select("token", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        best = after.select("token", "root")
        if not after.where("moved").limit(1).count():
            return best


def run_on(parsed: DataFrame) -> DataFrame:
    """(token, parts): tokens that are two other tokens written together, split where both parts are most frequent."""
    counts = cut(parsed.select(F.explode(F.array_distinct("tokens")).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n")))
    long = counts.where(f"length(token) >= {2 * HALF}").select("token", F.explode(F.expr(f"sequence({HALF}, length(token) - {HALF})")).alias("i"))
    halves = long.select("token", F.expr("substr(token, 1, i)").alias("p"), F.expr("substr(token, i + 1)").alias("q"))
    p, q = counts.select(F.col("token").alias("p"), F.col("n").alias("np")), counts.select(F.col("token").alias("q"), F.col("n").alias("nq"))
    return halves.join(p, "p").join(q, "q").groupBy("token").agg(F.max_by(F.array("p", "q"), F.struct(F.least("np", "nq"), "p")).alias("parts"))


def place_roots(places: DataFrame) -> DataFrame:
    """(place, root): cores (sorted tokens in one string) and the more frequent one they are taken for, which shares all
    tokens but one. places: (place, n)."""

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple[str, str, str, int]] = []
            for place, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ts = place.split()
                out.append((place, "whole", place, n))
                for i, t in enumerate(ts):
                    rest = " ".join(ts[:i] + ts[i + 1 :])
                    if not rest:
                        continue
                    out.append((rest, "more", place, n))
                    if len(t) >= TWICE_EDITED:
                        out.extend((f"{rest}|{d}", "typo", place, n) for d in deletes(t, 2))
                    out.append((f"{rest}|{t}", "short", place, n))
                    out.extend((f"{rest}|{t[:k]}", "long", place, n) for k in range(3, len(t)))
            cols = list(zip(*out, strict=True)) if out else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.string()), pa.array(cols[3], pa.int64())], names=["k", "kind", "place", "n"])

    index = cut(places.mapInArrow(keys, "k string, kind string, place string, n bigint"))
    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            costs = [align((p.split(), "", ""), (q.split(), "", "")) for p, q in zip(x.column(0).to_pylist(), x.column(1).to_pylist(), strict=True)]
            ok = pa.array([c is not None for c in costs], pa.bool_())
            yield pa.RecordBatch.from_arrays([*x.columns, pa.array(costs, pa.float64())], names=["place", "other", "m", "cost"]).filter(ok)

    def nearest(near: DataFrame) -> DataFrame:
        fits = near.distinct().mapInArrow(check, "place string, other string, m bigint, cost double")
        best = cut(fits.groupBy("place").agg(F.min_by("other", F.struct("cost", -F.col("m"), "other")).alias("root")))
        # a root that itself follows another stays where it is
        return best.join(best.select(F.col("place").alias("root")), "root", "left_anti").select("place", "root")

    side = lambda kind: F.col("kind") == kind
    others = index.where(side("typo")).select("k", F.col("place").alias("other"), F.col("n").alias("m"))
    typos = cut(nearest(index.where(side("typo")).join(others, "k").where("m > n or (m = n and other > place)").select("place", "other", "m")))
    # an abbreviation or a missing token must have one reading, typos aside
    free = index.join(typos, "place", "left_anti")
    only = lambda kind: free.where(side(kind)).groupBy("k").agg(F.first("place").alias("other"), F.first("n").alias("m"), F.count(F.lit(1)).alias("readings")).where("readings = 1").drop("readings")
    shortened = free.where(side("short")).join(only("long"), "k").select("place", "other", "m")
    lacking = free.where(side("whole")).join(only("more"), "k").select("place", "other", "m")
    brief = nearest(shortened.union(lacking))
    # what follows a brief core follows its root
    return typos.join(brief.select(F.col("place").alias("root"), F.col("root").alias("next")), "root", "left").select("place", F.coalesce("next", "root").alias("root")).union(brief)


PARSED = "value string, n bigint, tokens array<string>"
MEET = "value string, n bigint, core string, given string, trade string"


def centres(forms: list[dict]) -> list[str]:
    """The centre's spelling of each form: the most frequent of the fullest forms takes all that align with it, then the
    same again for what is left."""
    parsed = [(f["core"].split(), f["given"], f["trade"]) for f in forms]
    rank = [(int(len(f["given"]) > 1) + int(f["trade"] != ""), f["n"], f["value"]) for f in forms]
    out = [""] * len(forms)
    left = sorted(range(len(forms)), key=lambda i: rank[i], reverse=True)
    while left:
        centre = left[0]
        mine = {i for i in left if i == centre or align(parsed[i], parsed[centre]) is not None}
        for i in mine:
            out[i] = forms[centre]["value"]
        left = [i for i in left if i not in mine]
    return out


def entities(frames: list[tuple[DataFrame, str]], words: Words = USUAL) -> DataFrame:
    """(value, entity): each spelling that names somebody and the centre of its links, itself a spelling."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([tokens(v, words) for v in b.column(0).to_pylist()], pa.list_(pa.string()))], names=["value", "n", "tokens"])

    parsed = cut(spellings(frames).mapInArrow(split, PARSED).where("size(tokens) > 0"))
    apart = run_on(parsed)
    spelt = parsed.select("value", "n", F.posexplode("tokens").alias("i", "token")).join(apart, "token", "left")
    spelt = spelt.groupBy("value", "n").agg(F.flatten(F.expr("transform(sort_array(collect_list(struct(i, coalesce(parts, array(token)) as p))), x -> x.p)")).alias("tokens"))
    parsed = cut(spelt)
    roots = token_roots(parsed)
    spelt = parsed.select("value", "n", F.posexplode("tokens").alias("i", "token")).join(roots, "token", "left")
    spelt = spelt.groupBy("value", "n").agg(F.sort_array(F.collect_list(F.struct("i", F.coalesce("root", "token").alias("t")))).alias("ts"))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            for v, n, ts in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                core, given, trade = parse([x["t"] for x in ts], words)
                if core:
                    out.append((v, n, " ".join(core), given, trade))
            cols = list(zip(*out, strict=True)) if out else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int64()), *[pa.array(c, pa.string()) for c in cols[2:]]], names=["value", "n", "core", "given", "trade"])

    met = cut(spelt.mapInArrow(meet, MEET))
    forms = cut(met.groupBy("core", "given", "trade").agg(F.sum("n").alias("n"), F.max_by("value", F.struct("n", "value")).alias("value")))
    follows = place_roots(forms.groupBy(F.col("core").alias("place")).agg(F.sum("n").alias("n")))
    placed = forms.join(follows.select(F.col("place").alias("core"), "root"), "core", "left").withColumn("place", F.coalesce("root", "core"))
    meetings = placed.groupBy("place").agg(F.sort_array(F.collect_list(F.struct("core", "given", "trade", "n", "value"))).alias("forms"))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [(f["core"], f["given"], f["trade"], c) for fs in b.column(1).to_pylist() for f, c in zip(fs, centres(fs), strict=True)]
            cols = list(zip(*out, strict=True)) if out else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in cols], names=["core", "given", "trade", "entity"])

    judged = meetings.select("place", "forms").mapInArrow(judge, "core string, given string, trade string, entity string")
    return met.join(judged, ["core", "given", "trade"]).select("value", "entity")


def variant_pairs(frames: list[tuple[DataFrame, str]]) -> DataFrame:
    """(value_a, value_b), value_a < value_b: all pairs of spellings of one entity."""
    e = cut(entities(frames))
    a, b = e.select("entity", F.col("value").alias("value_a")), e.select("entity", F.col("value").alias("value_b"))
    return a.join(b, "entity").where("value_a < value_b").select("value_a", "value_b")
