from __future__ import annotations

import random

import pytest

from postlode.llm import near_duplicates as nd
from tests.llm.test_tokens import plain_words

SCHEMA = "id string, text string, fp string, kind int, fa string"


def brute(rows, k, num, den, least):
    sets = {}
    for i, t in rows:
        w = plain_words(t)
        if i is not None and len(w) >= least:
            sets.setdefault(i, []).append({tuple(w[j : j + k]) for j in range(len(w) - k + 1)})
    out = set()
    for a in sets:
        for b in sets:
            if a < b and any(len(x & y) * den >= num * len(x | y) for x in sets[a] for y in sets[b]):
                out.add((a, b))
    return out


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", 7, "y") for i, t in rows], SCHEMA)


def texts(seed, n=160):
    rng = random.Random(seed)
    phrase = [" ".join(rng.choice("abcdefgh") * rng.randint(1, 3) for _ in range(6)) for _ in range(25)]
    base = [" ".join(rng.sample(phrase, 6)) for _ in range(20)]
    rows = []
    for i in range(n):
        w = rng.choice(base).split()
        for _ in range(rng.randint(0, 8)):
            at = rng.randrange(len(w))
            w[at : at + rng.randint(0, 2)] = [rng.choice(["new", "word", "a"])] * rng.randint(0, 2)
        rows.append((f"j{i:03}", " ".join(w)))
    return rows


@pytest.mark.parametrize(("k", "num", "den", "least"), [(3, 1, 2, 25), (5, 4, 5, 5), (3, 1, 2, 5)])
def test_against_brute_force(spark, k, num, den, least):
    rows = texts(k * 10 + least)
    got = nd.agreeing_pairs(frame(spark, rows), "id", "text", k, num, den, least).collect()
    assert len(got) == len(set(got))
    assert {tuple(r) for r in got} == brute(rows, k, num, den, least)


def test_long_lists_and_hot_copies(spark):
    """More texts than SMALL_LIST share shingles, a third of the rows are copies of one text."""
    rng = random.Random(5)
    common = "we look for someone who likes to work in a small team near the old harbour office and enjoys good coffee every day"
    rows = [(f"c{i:03}", common + " " + " ".join(f"t{rng.randint(0, 400)}" for _ in range(12))) for i in range(120)]
    rows += [(f"h{i:03}", common + " and nothing else at all") for i in range(60)]
    got = {tuple(r) for r in nd.agreeing_pairs(frame(spark, rows), "id", "text", 3, 1, 2, 5).collect()}
    assert got == brute(rows, 3, 1, 2, 5)
    assert sum(a[0] == b[0] == "h" for a, b in got) == 60 * 59 // 2


def test_edges(spark):
    long = " ".join(f"w{i}" for i in range(3000))
    rows = [("a", None), ("b", ""), ("c", "   "), ("d", "too short"), ("e", long), ("f", long + " tail"), ("g", long.upper()), ("g", long.upper()), (None, long), ("h", "<p>" + long + "</p>"), ("i", "same " * 40), ("j", "same " * 90)]
    got = {tuple(r) for r in nd.agreeing_pairs(frame(spark, rows), "id", "text", 3, 1, 2, 25).collect()}
    assert got == brute(rows, 3, 1, 2, 25) and ("i", "j") in got and ("e", "h") in got


def test_empty(spark):
    assert nd.agreeing_pairs(spark.createDataFrame([], SCHEMA), "id", "text").collect() == []


def test_members_and_links(spark):
    rows = texts(77, 80)
    members, links = nd.near_duplicates(frame(spark, rows), "id", "text", 3, 1, 2, 10)
    m = {r["id"]: bytes(r["fp"]) for r in members.collect()}
    assert set(m) == {i for i, t in rows if len(plain_words(t)) >= 10}
    for r in links.collect():
        assert bytes(r["fa"]) < bytes(r["fb"]) or bytes(r["fa"]) != bytes(r["fb"])
        assert 2 * r["shared"] >= r["total"]


def test_recurring_sentences_share_a_bucket(spark):
    """Of texts made of recurring sentences, headers go to about as many buckets as they have sentences, not shingles."""
    rng = random.Random(8)
    pool = [" ".join(f"s{k}w{i}" for i in range(14)) for k in range(10)]
    rows = [(f"j{i:03}", " ".join([*rng.sample(pool, 6), f"end{i}"])) for i in range(200)]
    df = frame(spark, rows).repartition(2)
    order = nd.share(spark, nd.rarity(df, "text", 3, 5))
    packed = nd.postings(df, "id", "text", order, list(range(64)), 3, 5, nd.Threshold(1, 2)).select("blob").collect()
    found = [x for x in (nd.unpack(bytes(r["blob"])) for r in packed) if x.column("what")[0].as_py() == 0]
    assert sum(len(nd._take(x, "n", nd.np.int32)) for x in found) < 15 * len(rows)
    assert {tuple(r) for r in nd.agreeing_pairs(df, "id", "text", 3, 1, 2, 5).collect()} == brute(rows, 3, 1, 2, 5)
