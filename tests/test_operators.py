from __future__ import annotations

import math
import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from postlode.functions import rules
from postlode.functions import text as tx
from postlode.operators import metrics as m
from postlode.operators import similarity as sim
from postlode.operators import stores
from postlode.sources import pages as pg
from postlode.sources import parsers as ps

T0 = datetime(2026, 5, 4)


def one(spark, c, **cols):
    return spark.createDataFrame([tuple(cols.values())], " , ".join(f"{k} string" for k in cols)).select(c.alias("r")).first()["r"]


@pytest.mark.parametrize(("text", "offers", "only"), [("Visa sponsorship available here", True, None), ("no visa sponsorship", None, True), ("SC clearance needed", None, True), ("", None, None), (None, None, None)])
def test_sponsorship(spark, text, offers, only):
    a, b, _ = rules.sponsorship(F.col("t"))
    r = spark.createDataFrame([(text,)], "t string").select(a.alias("a"), b.alias("b")).first()
    assert (r["a"], r["b"]) == (offers, only)


@pytest.mark.parametrize(("title", "category"), [("MLOps Engineer", "MLOps"), ("NLP Engineer", "NLP"), ("Prompt Engineer", "AI/LLM Engineer"), ("Plumber", "Other"), (None, "Other")])
def test_role(spark, title, category):
    df = spark.createDataFrame([(title, None)], "t string, d string")
    assert df.select(rules.role_category(F.col("t"), F.col("d"))).first()[0] == category


@pytest.mark.parametrize(("place", "want"), [("VX1 2AB", "Orm"), ("near orm", "Orm"), ("WFH", "Remote"), ("  ", "Unknown"), (None, "Unknown"), ("Elsewhere", "Other UK")])
def test_place(spark, place, want):
    df = spark.createDataFrame([(place,)], "p string")
    assert df.select(rules.place(F.col("p"), [("VX", "Orm"), ("QB", "Hollowmere")])).first()[0] == want


def test_annualise(spark):
    df = spark.createDataFrame([(300.0, "daily"), (4000.0, "daily"), (10.0, "hourly"), (1.0, "hourly"), (4000.0, "annual"), (50000.0, "unknown"), (None, "annual")], "v double, p string")
    got = [r[0] for r in df.select(rules.annualise(F.col("v"), F.col("p"))).collect()]
    assert got == [66000.0, None, 16500.0, None, None, None, None]


def test_shingles(spark):
    df = spark.createDataFrame([("a b c d e",), ("a b",), ("",), ("a b c d a b c d",)], "t string")
    got = [sorted(r[0]) for r in df.select(tx.word_shingles(F.col("t"))).collect()]
    assert got[0] == ["a b c d", "b c d e"] and got[1] == ["a b"] and got[2] == [] and len(got[3]) == 4


def test_trend_labels(spark):
    series = {"new": [0, 0, 0, 4], "up": [1, 2, 3, 4, 5], "down": [9, 7, 5, 3], "flat": [3, 3, 3], "one": [5]}
    rows = [(k, i, n) for k, v in series.items() for i, n in enumerate(v)]
    got = {r["key"]: r["trend"] for r in m.trend(spark.createDataFrame(rows, "key string, week int, n int"), "key").collect()}
    assert got == {"new": "New", "up": "Accelerating", "down": "Cooling", "flat": "Stable", "one": "Stable"}
    near = {r["key"]: r["label"] for r in m.rising(spark.createDataFrame(rows, "key string, week int, n int"), "key").collect()}
    assert near == {"new": "Rising", "up": "Rising", "down": "Cooling", "flat": "Stable", "one": "Stable"}


def test_divergence_is_strict(spark):
    rows = [(datetime(2026, 5, 3), 115.0, 115.0, "annual"), (datetime(2026, 4, 1), 85.0, 85.0, "annual")]
    df = spark.createDataFrame(rows, "scraped_at timestamp, salary_annual_min double, salary_annual_max double, salary_period string")
    r = m.divergence(df, T0).first()
    assert r["rolling"] == 100.0 and r["weekly"] == 115.0 and r["ratio"] == 0.15 and r["diverged"] is False


def test_stores(spark):
    seen = spark.createDataFrame([("h", T0, None, None)], "dedup_hash string, first_seen_at timestamp, last_seen_at timestamp, times_seen int")
    more = spark.createDataFrame([("h", datetime(2026, 6, 1)), ("n", T0)], "dedup_hash string, at timestamp")
    got = {r["dedup_hash"]: (r["times_seen"], r["last_seen_at"]) for r in stores.upsert_seen(seen, more).collect()}
    assert got == {"h": (2, datetime(2026, 6, 1)), "n": (1, T0)}
    present = spark.createDataFrame([("a", 1)], "k string, v int")
    new = spark.createDataFrame([("a", 2), ("b", 3), ("b", 3)], "k string, v int")
    assert sorted(stores.insert_ignore(present, new, "k").collect()) == [("a", 1), ("b", 3)]
    events = spark.createDataFrame([("r", 1, "running", None), ("r", 2, "complete", 7), ("r", 3, None, None)], "run_id string, at int, status string, total int")
    assert stores.run_state(events).first().asDict() == {"run_id": "r", "status": "complete", "total": 7}
    cache = spark.createDataFrame([("a", T0)], "k string, expires_at timestamp")
    assert stores.alive(cache, F.lit(T0)).count() == 0 and stores.evict(cache, F.lit(T0))[1].first()[0] == 1


def test_shingle_pairs_against_brute_force(spark):
    rng = random.Random(3)
    base = [[rng.choice("abcdefghij") + str(rng.randint(0, 3)) for _ in range(30)] for _ in range(12)]
    rows = []
    for i in range(60):
        w = list(rng.choice(base))
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(len(w))] = "x"
        rows.append((i, sorted(set(w))))
    rows += [(100, []), (101, rows[0][1]), (102, rows[0][1])]
    want = set()
    for i, a in rows:
        for j, b in rows:
            if i < j and a and b and len(set(a) & set(b)) / len(set(a) | set(b)) >= 0.85:
                want.add((i, j))
    df = spark.createDataFrame(rows, "i int, s array<string>")
    got = {(r["a"], r["b"]) for r in sim.shingle_pairs(df, "i", F.col("s")).collect()}
    assert got == want


def test_shingles_travel_as_hashes(spark):
    """No shuffle or checkpoint of the pairs holds the text of a shingle; sets of a whole number of least shared ones meet."""
    many = [f"shingle number {i}" for i in range(23)]
    df = spark.createDataFrame([(1, many[:20]), (2, many[:17] + ["x"] * 3), (3, many[:17]), (3, many[:17]), (4, [])], "i int, s array<string>")
    made = sim._hashed(df, [F.col("i").alias("k")], F.col("s"))
    assert dict(made.dtypes) == {"k": "int", "h": "array<bigint>", "n": "int", "c": "bigint", "b": "bigint"}
    assert {tuple(r) for r in sim.shingle_pairs(df, "i", F.col("s")).collect()} == {(1, 3, 0.85), (2, 3, 17 / 18)}


def test_keep_new_compares_classes(spark):
    """Copies of one text are compared with the earliest alone; the plan makes no pairs of keys of a class."""
    w = [f"w{i}" for i in range(40)]
    near = w[:38] + ["x", "y"]
    rows = [("b", 2, "h1", w), ("b", 5, "h1", w), ("a", 2, "h2", w), ("c", 1, "h3", near), ("d", 9, "h4", []), ("e", 3, "h4", ["z"]), ("f", 4, "h5", []), ("g", 0, "h1", ["q"])]
    rows += [(f"m{i}", 10 + i, f"k{i}", ["one", "text"]) for i in range(300)]
    df = spark.createDataFrame(rows, "i string, at int, h string, s array<string>")
    kept = sim.keep_new(df, "i", "at", "h", F.col("s"))
    assert sorted(r[0] for r in kept.collect()) == ["c", "e", "f", "g", "m0"]
    assert "p#" not in kept._jdf.queryExecution().optimizedPlan().toString()


def test_bm25_against_plain(spark):
    docs = [(1, "python data python"), (2, "data engineer"), (3, "painter"), (4, None)]
    terms = ["python", "data", "data"]
    tok = {i: (t or "").split() for i, t in docs}
    n, avg = len(docs), sum(map(len, tok.values())) / len(docs)
    df = {w: sum(w in t for t in tok.values()) for t in tok.values() for w in t}
    idf = {w: math.log(n - d + 0.5) - math.log(d + 0.5) for w, d in df.items()}
    floor = 0.25 * sum(idf.values()) / len(idf)
    idf = {w: v if v >= 0 else floor for w, v in idf.items()}
    raw = {i: sum(idf[w] * t.count(w) * 2.5 / (t.count(w) + 1.5 * (0.25 + 0.75 * len(t) / avg)) for w in terms if w in idf) for i, t in tok.items()}
    top = max(raw.values())
    got = {r["i"]: r["score"] for r in sim.bm25(spark.createDataFrame(docs, "i int, t string"), "i", F.col("t"), terms).collect()}
    assert got == pytest.approx({i: v / top for i, v in raw.items()})


def test_register_match(spark):
    register = spark.createDataFrame([("Acme Widgets Limited",), ("Northern Light Robotics",)], "o string")
    names = spark.createDataFrame([("ACME WIDGETS LTD",), ("Northern Light Robotic",), ("Other Firm",), ("Ltd",)], "c string")
    got = {r["name"]: r["licensed"] for r in sim.register_match(names, "c", register, "o").collect()}
    assert got == {"ACME WIDGETS LTD": True, "Northern Light Robotic": True, "Other Firm": False, "Ltd": False}


def test_parsers(spark):
    bad = spark.createDataFrame([("{broken",), ('{"id":"1","title":"T","created":"2026-03-01T00:00:00Z"}',)], "payload string")
    assert [r["job_id"] for r in ps.adzuna(bad).collect()] == ["adzuna_1"]
    assert [r["payload"] for r in ps.quarantine(bad, "payload", ps.ADZUNA, "id").collect()] == ["{broken"]
    page = spark.createDataFrame([('<a href="https://assets.publishing.service.gov.uk/media/65a/2026-01_Worker.csv">CSV</a>',), ("none",)], "h string")
    assert [r[0] for r in page.select(ps.register_link(F.col("h"))).collect()] == ["https://assets.publishing.service.gov.uk/media/65a/2026-01_Worker.csv", None]
    lines = [("Firm | Engineer | Remote", "Engineer", "Firm"), ("Firm - Engineer", "Engineer", "Firm"), ("Hello there", "Hello there", "Hello there"), ("Anyone hiring?", "", ""), ("", "", "")]
    t, c = ps.first_line(F.col("x"))
    for text, title, company in lines:
        r = spark.createDataFrame([(text,)], "x string").select(t.alias("t"), c.alias("c")).first()
        assert (r["t"], r["c"]) == (title, company)
    html = '<html><body><nav><a href="/x">menu entry</a></nav><main><a href="/jobs/1">Data Engineer</a> ' + "word " * 30 + "in Bristol</main></body></html>"
    content = pg.page_content(spark.createDataFrame([("https://firm.example/careers", html), ("https://e.example", None)], "url string, html string"))
    links = pg.job_links(content, ["engineer"]).collect()
    assert [(r["href"], r["text"]) for r in links] == [("https://firm.example/jobs/1", "Data Engineer")]
    assert {r["url"]: r["place"] for r in content.collect()} == {"https://firm.example/careers": "Bristol", "https://e.example": "UK"}
    art = spark.createDataFrame([(1, "See https://www.acme.io/x and https://techcrunch.com and https://acme.io"), (2, "https://acme.io https://ab.io")], "article int, text string")
    assert [(r["domain"], r["article"]) for r in ps.funded_companies(art).collect()] == [("acme.io", 1)]
    emb = spark.createDataFrame([('<iframe src="https://boards.greenhouse.io/embed/job_board?for=acme">',), ("none",), ("https://boards.greenhouse.io/acme",)], "h string").select(ps.ats_embed(F.col("h")).alias("e")).collect()
    assert [[(x["platform"], x["token"]) for x in r["e"]] for r in emb] == [[("greenhouse", "acme")], [], []]


@pytest.mark.parametrize(("name", "key"), [("Acme Ltd.", "acme"), ("ACME LIMITED", "acme"), ("Acme Ltd T/A Acme Foods", "acme acme foods"), ("Acme Holdings", "acme holdings"), ("Acme Group trading  as Foods & Co", "acme group foods co"), (None, "")])
def test_company_key(spark, name, key):
    assert spark.createDataFrame([(name,)], "c string").select(tx.company_key(F.col("c"))).first()[0] == key


@pytest.mark.parametrize(
    ("line", "title", "company"),
    [("Firm (Data Engineer)", "Data Engineer", "Firm"), ("Firm | ", "Firm |", "Firm |"), ("| Firm | Engineer", "Engineer", "Firm"), ("Who | What?", "What?", "Who"), ("Hey?", "", ""), ("Tiny", "", "")],
)
def test_first_line_forms(spark, line, title, company):
    t, c = ps.first_line(F.col("x"))
    r = spark.createDataFrame([(line,)], "x string").select(t.alias("t"), c.alias("c")).first()
    assert (r["t"], r["c"]) == (title, company)


def test_register_match_against_all_pairs(spark):
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdeo") for _ in range(rng.randint(1, 9)))
    register = [" ".join(word() for _ in range(rng.randint(1, 3))) for _ in range(150)] + ["microsoft", "aaaaaaaaaaaaaaaa"]
    names = ["mmicrosoft", "aaaaaaaaaaaaaaa"]
    for r in register:
        x = list(r)
        for _ in range(rng.randint(0, 2)):
            at = rng.randrange(len(x))
            x[at : at + rng.randint(0, 1)] = rng.choice("abcdeo")
        names.append(" ".join(reversed("".join(x).split())))
    got = {r["name"]: r["licensed"] for r in sim.register_match(spark.createDataFrame([(n,) for n in names], "c string"), "c", spark.createDataFrame([(r,) for r in register], "o string"), "o").collect()}
    key = lambda v: " ".join(sorted(v.split()))
    want = {n: bool(n.strip()) and any(sim._indel(key(n), key(r)) >= 92 for r in register) for n in names}
    assert got == want and 20 < sum(want.values()) < len(want)


def test_stream_against_seen_is_replay_safe(spark, tmp_path):
    """A batch that failed after its write, before its commit, is run again and loses nothing."""
    from postlode.streaming import incremental as inc

    source = str(tmp_path / "in")
    spark.createDataFrame([("a", 1), ("b", 2), ("b", 3)], "k string, v int").write.parquet(source)
    seen = spark.createDataFrame([("a",)], "k string")
    run = lambda: inc.against_seen(spark.readStream.schema("k string, v int").parquet(source), seen, "k", str(tmp_path / "out"), str(tmp_path / "state"))
    run()
    commit = next((tmp_path / "state" / "commits").glob("0"))
    commit.unlink()
    for crc in (tmp_path / "state" / "commits").glob(".0.crc"):
        crc.unlink()
    run()
    assert [r["k"] for r in spark.read.parquet(str(tmp_path / "out")).collect()] == ["b"]
    spark.createDataFrame([("b", 4), ("c", 5)], "k string, v int").write.mode("append").parquet(source)
    run()
    assert sorted(r["k"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["b", "c"]


def test_late_rows_are_dropped_after_the_watermark(spark, tmp_path):
    """Rows older than the watermark no longer count; those within it do."""
    from datetime import timedelta

    from postlode.streaming import incremental as inc

    schema = "k string, at timestamp"
    rows = [[("a", T0), ("a", T0 + timedelta(days=40))], [("a", T0 + timedelta(days=1)), ("a", T0 + timedelta(days=35))], [("a", T0 + timedelta(days=80))], [("z", T0 + timedelta(days=81))]]
    source, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    for part in rows:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(source)
        w = inc.weekly(spark.readStream.schema(schema).parquet(source), "k", "at", "14 days")
        w.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    got = {r["week"]: r["n"] for r in spark.read.parquet(out).where("k = 'a'").collect()}
    assert got == {datetime(2026, 5, 4): 1, datetime(2026, 6, 8): 2}


def test_funnel_nulls(spark):
    rows = [("r1", "complete", T0, 10, 5, None, 2, 0), ("r2", "failed", T0, 1, 1, 1, 1, 1), ("r3", "complete", datetime(2026, 5, 5), 0, 0, 0, 0, 0)]
    df = spark.createDataFrame(rows, "run_id string, status string, started_at timestamp, total_scraped int, total_after_dedup int, total_after_prescreen int, total_scored int, total_qualified int")
    got = {r["run_id"]: r for r in m.funnel(df).collect()}
    assert set(got) == {"r1", "r3"} and got["r1"]["total_scraped_to_total_after_dedup"] == 50.0
    assert got["r1"]["total_after_dedup_to_total_after_prescreen"] is None and got["r3"]["total_scraped_to_total_after_dedup"] is None


def test_quantiles_against_numpy(spark):
    import numpy as np

    from postlode.operators.quantiles import quantiles

    rng = np.random.default_rng(3)
    data = {"normal": rng.normal(0, 1000, 500), "ties": rng.integers(0, 4, 400).astype(float), "one": np.array([5.0]), "tail": rng.pareto(1.1, 300) * 1e4, "zeros": np.zeros(50), "negative": -rng.random(101), "close": 1e6 + rng.random(200)}
    rows = [(g, float(x), 1) for g, v in data.items() for x in v] + [("normal", None, 1), ("none", None, 1), (None, 2.0, 1), (None, 4.0, 1), ("normal", float("nan"), 1)]
    df = spark.createDataFrame(rows, "g string, x double, b int")
    qs = (0.0, 0.25, 0.5, 0.9, 1.0)
    got = {r["key"]: r for r in quantiles(df, F.col("g"), F.col("x"), qs).collect()}
    for g, v in [*data.items(), (None, np.array([2.0, 4.0]))]:
        assert got[g]["n"] == len(v) and got[g]["p"] == pytest.approx(list(np.quantile(v, qs)), rel=1e-12, abs=1e-9)
    assert "none" not in got and quantiles(df.limit(0), None, F.col("x"), qs).collect() == []
    every = np.concatenate([*data.values(), [2.0, 4.0]])
    assert quantiles(df, None, F.col("x"), (0.5,)).first()["p"][0] == pytest.approx(np.median(every))
