from __future__ import annotations

import hashlib
import random
from datetime import datetime

from postlode.llm import history as hs
from postlode.llm.near_duplicates import Threshold
from tests.llm.test_near_duplicates import texts
from tests.llm.test_tokens import plain_words

T = Threshold(1, 2)
AT = datetime(2026, 1, 1)


def h(*parts):
    return hashlib.sha256("|".join((p or "").lower().strip() for p in parts).encode()).hexdigest()[:16]


def shingles(t):
    w = plain_words(t)
    return {tuple(w[i : i + 3]) for i in range(len(w) - 2)} if len(w) >= 25 else set()


def sequential(old, new):
    accepted = [(x, shingles(t)) for x, t in old]
    out = {}
    for i, x, t in new:
        s = shingles(t)
        if any(x == y for y, _ in accepted):
            out[i] = {x}
            continue
        agree = {y for y, z in accepted if s and 2 * len(s & z) >= len(s | z)}
        if agree:
            out[i] = agree
        else:
            accepted.append((x, s))
    return out


def tables(spark, old, new):
    raw = spark.createDataFrame([(f"r{k}", t, "extra") for k, (_, t) in enumerate(old)], "job_id string, description string, fp string")
    seen = spark.createDataFrame([(x, f"r{k}", AT, None, None) for k, (x, _) in enumerate(old)], "dedup_hash string, job_id string, first_seen_at timestamp, last_seen_at timestamp, times_seen int")
    inc = spark.createDataFrame([(i, s, a, b, c, t, AT, 1) for s, (i, a, b, c, t) in enumerate(new)], "job_id string, seq int, title string, company string, location string, description string, scraped_at timestamp, kind int")
    return raw, seen, inc


def check(spark, old, new):
    store, batch, resolved = hs.incoming_against_seen(*tables(spark, old, new), 3, T, 25)
    got = {r["id"]: r["repeats"] for r in resolved.where("repeats is not null").collect()}
    want = sequential(old, [(i, h(a, b, c), t) for i, a, b, c, t in new])
    assert set(got) == set(want)
    assert all(got[i] in want[i] for i in got)
    return store, batch, resolved


def test_against_sequential(spark):
    rows = texts(9, 240)
    old = [(f"old{i}", t) for i, (_, t) in enumerate(rows[:80])]
    new = [(f"n{k:03}", f"title {k % 50}", "firm", None, t) for k, (_, t) in enumerate(rows[80:])]
    check(spark, old, new)


def test_chains_and_hot_group(spark):
    """A repeat is not accepted, so it makes no later posting a repeat; a third of the batch is one text."""
    w = [f"w{i}" for i in range(60)]
    step = lambda a: " ".join(w[: 60 - a] + [f"x{a}{i}" for i in range(a)])
    chain = [(f"c{a:02}", f"t{a}", "f", "l", step(a)) for a in (0, 10, 20, 30, 40)]
    hot = [(f"h{i:02}", f"u{i}", "f", "l", " ".join(f"hot{j}" for j in range(40))) for i in range(30)]
    same_hash = [(f"s{i}", " Same ", "FIRM", None, None) for i in range(3)]
    store, batch, resolved = check(spark, [], chain + hot + same_hash)
    assert resolved.where("id like 'h%' and repeats is null").count() == 1
    after = hs.update(store, batch, "id", "text", resolved, batch.select("id", batch["scraped_at"].alias("at"))).seen.collect()
    assert sum(r["times_seen"] for r in after) == len(chain + hot + same_hash)


def test_short_texts_that_share_few_fingerprints(spark):
    """Of short texts that agree, some share under two fifths of the larger one's fingerprints of window 4."""
    from postlode.llm.tokens import winnowed_sets

    def prints(t):
        (_, f), *_ = winnowed_sets([t], 3, 25, 4)
        return set(f.flat.tolist())

    rng = random.Random(5)
    old, new = [], []
    for k in range(20_000):
        w = [f"a{k}x{i}" for i in range(rng.choice([30, 40, 50]))]
        v = w[: rng.randint(len(w) * 3 // 5, len(w))]
        for _ in range(rng.randint(0, 2)):
            v[rng.randrange(len(v))] = "other"
        a, b = " ".join(w), " ".join(v)
        s, z = shingles(a), shingles(b)
        if not z or 2 * len(s & z) < len(s | z):
            continue
        p, q = prints(a), prints(b)
        if 5 * len(p & q) < 2 * max(len(p), len(q)):
            # what both hold is in history twice, so it sorts behind what only one holds
            old += [(f"old{k}", a), (f"same{k}", a)]
            new.append((f"n{k:05}", f"title {k}", "firm", None, b))
        if len(new) == 12:
            break
    assert len(new) > 3
    check(spark, old, new)


def test_store_carries_over_batches(spark):
    rows = texts(21, 120)
    new = [(f"n{k:03}", f"t{k}", "f", "l", t) for k, (_, t) in enumerate(rows)]
    raw, seen, inc = tables(spark, [("old", "nothing of the kind")], new)
    whole = {r["id"]: r["repeats"] is None for r in hs.incoming_against_seen(raw, seen, inc, 3, T, 25)[2].collect()}
    first, second = inc.where("seq < 60"), inc.where("seq >= 60")
    store, batch, resolved = hs.incoming_against_seen(raw, seen, first, 3, T, 25)
    store = hs.update(store, batch, "id", "text", resolved, batch.select("id", batch["scraped_at"].alias("at")))
    history = raw.select(raw["job_id"].alias("id"), raw["description"].alias("text")).union(batch.select("id", "text"))
    b2 = second.select(second["job_id"].alias("id"), second["description"].alias("text"), "seq", hs.dedup_hash(second["title"], second["company"], second["location"]).alias("hash"))
    members, links = hs.links(store, history, b2, "id", "text", T)
    later = {r["id"]: r["repeats"] is None for r in hs.resolve(store, b2.select("id", "seq", "hash"), members, links).collect()}
    assert later == {i: v for i, v in whole.items() if i >= "n060"}


def test_store_is_read_back_by_another_session(spark, tmp_path):
    """A second session loads the written store and checks a batch against it, without fingerprinting history again."""
    rows = texts(33, 120)
    old, new = rows[:60], rows[60:]
    frame = lambda s, part: s.createDataFrame([(f"r{i:03}", t, k, f"hash{i}") for k, (i, t) in enumerate(part)], "id string, text string, seq int, hash string")
    history = frame(spark, old)
    seen = history.select("id", history["hash"].alias("dedup_hash"), hs.F.lit(AT).alias("first_seen_at"), hs.F.lit(1).alias("times_seen"), hs.F.lit(AT).alias("last_seen_at"))
    path = str(tmp_path / "store")
    whole = hs.build(history, "id", "text", seen, 3, 25, T, path=path)
    hs.save_seen(whole)
    other = spark.newSession()
    store = hs.load(other, path)
    assert store.parts == 1 and store.window == hs.WINDOW and store.rows.where("what = 0").count() > 0 and store.filters.count() > 0
    first, second = frame(other, new[:30]), frame(other, new[30:])
    texts_so_far = frame(other, old)
    repeats = {}
    for batch in (first, second):
        members, links = hs.links(store, texts_so_far, batch, "id", "text", T)
        resolved = hs.resolve(store, batch.select("id", "seq", "hash"), members, links)
        repeats |= {r["id"]: r["repeats"] for r in resolved.where("repeats is not null").collect()}
        store = hs.update(store, batch, "id", "text", resolved, batch.select("id", hs.F.lit(AT).alias("at")))
        hs.save_seen(store)
        texts_so_far = texts_so_far.union(batch)
        store = hs.load(other, path)
    want = sequential([(f"hash{i}", t) for i, t in old], [(f"r{i:03}", f"hash{i}", t) for i, t in new])
    assert set(repeats) == set(want) and all(repeats[i] in want[i] for i in repeats) and store.parts == 3


def test_fingerprints_that_no_filter_has_go_no_further(spark, tmp_path):
    rows = [("old", " ".join(f"o{i}" for i in range(60)))]
    frame = lambda part: spark.createDataFrame(part, "id string, text string")
    seen = frame(rows).selectExpr("id", "id as dedup_hash", "timestamp'2026-01-01' as first_seen_at", "1 as times_seen", "timestamp'2026-01-01' as last_seen_at")
    store = hs.build(frame(rows), "id", "text", seen, 3, 25, T, path=str(tmp_path / "store"))
    batch = frame([("new", " ".join(f"n{i}" for i in range(60))), ("same", " ".join(f"o{i}" for i in range(50)))])
    mine = hs._postings(batch, "id", "text", store.order, 1, 3, 25, T, store.window)
    left = hs._screened(mine, store.filters, store.keys)
    assert mine.where("what = 0").agg({"n": "sum"}).first()[0] > left.agg({"n": "sum"}).first()[0] > 0


def test_many_buckets_go_in_rounds(spark, monkeypatch):
    """With many buckets no shuffle copies the texts' headers more than a few times, and the links are the same."""
    rows = texts(41, 200)
    old = [(f"old{i}", t) for i, (_, t) in enumerate(rows[:100])]
    new = [(f"n{k:03}", f"title {k}", "firm", None, t) for k, (_, t) in enumerate(rows[100:])]
    copies, compare = [], hs._candidates

    def watched(packed, *rest):
        copies.append(sum(len(hs._unpack_postings(hs.unpack(bytes(r["blob"])))[0][1]) for r in packed.select("blob").collect()))
        return compare(packed, *rest)

    monkeypatch.setattr(hs, "_candidates", watched)
    spark.conf.set("spark.sql.shuffle.partitions", "32")
    try:
        check(spark, old, new)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert sum(copies) > 8 * len(rows) >= max(copies)


def test_buckets_follow_the_postings():
    """A bucket names no more texts than its bound, however few partitions a shuffle has."""
    for texts_, posted in ((0, 0), (1, 1), (200_000, 11_000_000), (15_000_000, 860_000_000)):
        n = hs._n_buckets(6, texts_, posted)
        assert n >= 6 and texts_ * hs._copies(n, posted / max(1, texts_)) / n <= hs.MOST_HEADERS
    assert hs._n_buckets(6, 200_000, 11_000_000) == 6


def test_empty(spark):
    raw, seen, inc = tables(spark, [("old", "x " * 30)], [("n", "t", "c", "l", "x " * 30)])
    assert hs.incoming_against_seen(raw, seen, inc.limit(0), 3, T, 25)[2].collect() == []
    only = hs.incoming_against_seen(raw.limit(0), seen.limit(0), inc, 3, T, 25)[2].collect()
    assert [(r["id"], r["repeats"]) for r in only] == [("n", None)]
