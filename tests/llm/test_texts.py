"""Leaks, garbled text, truncation, canonical values, names, packing, percentiles: brute force, round trips and edges."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from postlode.llm import canonical as cn
from postlode.llm import garbled as gb
from postlode.llm import leaks as lk
from postlode.llm import names as nm
from postlode.llm import packing as pk
from postlode.llm import percentiles as pc
from postlode.llm import truncation as tr
from postlode.llm.edits import Dictionary, weighted_distance
from postlode.llm.tokens import words
from tests.llm.test_tokens import plain_words

DOC = "doc_id bigint, text string, item_id bigint, windows int, key string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, 1, 1, "x") for i, t in rows], DOC)


# leaks


def leak_tables():
    rng = random.Random(4)
    word = lambda: "w" + str(rng.randint(0, 60))
    items = [(i, " ".join(word() for _ in range(rng.randint(5, 40)))) for i in range(15)]
    rows = []
    for d in range(120):
        w = [word() for _ in range(rng.randint(0, 60))]
        if rng.random() < 0.4:
            source = rng.choice(items)[1].split()
            a = rng.randrange(len(source))
            w[rng.randint(0, len(w)) : 0] = source[a : a + rng.randint(4, 12)]
        rows.append((d, "&nbsp;".join(w) if d % 7 == 0 else " <b>".join(w) if d % 5 == 0 else " ".join(w)))
    return rows, items


def test_leaks_against_brute_force(spark):
    rows, items = leak_tables()
    want = set()
    for d, t in rows:
        w = plain_words(t, True)
        for i, x in items:
            v = plain_words(x, True)
            g = {tuple(v[k : k + 8]) for k in range(len(v) - 7)}
            if any(tuple(w[k : k + 8]) in g for k in range(len(w) - 7)):
                want.add((d, i))
    it = spark.createDataFrame(items, "item_id bigint, text string")
    got = {(r["doc_id"], r["item_id"]) for r in lk.leaks(docs(spark, rows), it, 8, 0).collect()}
    assert got == want and want


def test_near_leaks_recall(spark):
    rng = random.Random(8)
    items = [(i, " ".join(f"i{i}w{j}" for j in range(40))) for i in range(30)]
    rows = []
    for i, x in items:
        w = x.split()[10:26]
        for _ in range(2):
            at = rng.randrange(len(w))
            w[at] = "changed"
        rows.append((i, "before it " + " ".join(w) + " after it"))
    got = {(r["doc_id"], r["item_id"]) for r in lk.leaks(docs(spark, rows), spark.createDataFrame(items, "item_id bigint, text string"), 16, 2).collect()}
    assert all(a == b for a, b in got) and len(got) >= 0.9 * len(items)


def test_leak_edges(spark):
    it = spark.createDataFrame([(1, "a b c d e f g h"), (2, None), (3, "short"), (None, "a b c d e f g h")], "item_id bigint, text string")
    rows = [(1, "A b, C d. e f g H"), (1, "A b, C d. e f g H"), (2, None), (3, ""), (None, "a b c d e f g h"), (4, "z " * 100_000 + "a b c d e f g h")]
    got = sorted((r["doc_id"], r["item_id"]) for r in lk.leaks(docs(spark, rows), it).collect())
    assert got == [(1, 1), (4, 1)]
    assert lk.leaks(docs(spark, []), it).collect() == [] and lk.leaks(docs(spark, rows), it.limit(0)).collect() == []


def test_leaks_in_several_rounds(spark):
    rows, items = leak_tables()
    it = spark.createDataFrame(items, "item_id bigint, text string")
    one, many = (sorted(tuple(r) for r in lk.leaks(docs(spark, rows), it, 8, 1, most_windows=m).collect()) for m in (10**6, 150))
    assert one == many and one


@pytest.mark.parametrize(("window", "edits", "recall"), [(8, 1, 0.95), (16, 2, 0.95), (12, 1, 0.9)])
def test_repeats_reach_the_target_recall(window, edits, recall):
    rng = random.Random(window)
    items = [f"i{i}w{{}}" for i in range(400)]
    ix = lk.Index(list(range(400)), [" ".join(t.format(j) for j in range(window)) for t in items], window, edits, lk.repeats_for(window, edits, recall))
    found = true = 0
    for i, t in enumerate(items):
        own = [t.format(j) for j in range(window)]
        w = list(own)
        for _ in range(edits):
            at = rng.randrange(len(w))
            w[at : at + rng.randint(0, 1)] = ["changed"] * rng.randint(0, 1)
        text = ["before", "it", *w, "after", "it", "and", "more"]
        near = any(lk.edit_distance(text[k : k + window], own, edits) <= edits for k in range(len(text) - window + 1))
        h, o = words([" ".join(text)])
        hit = any(item == i for _, _, item, _ in ix.hits(h, o))
        assert near or not hit
        true += near
        found += hit
    assert true > 150 and found >= (recall - 0.05) * true


def test_short_items_are_windows_of_their_own(spark):
    it = spark.createDataFrame([(1, "a b c d e f g h i"), (2, "a b c")], "item_id bigint, text string")
    rows = [(1, "x y a b c d e f g h i z"), (2, "a b c d X f g h i"), (3, "a b c")]
    got = sorted((r["doc_id"], r["item_id"], r["distance"]) for r in lk.leaks(docs(spark, rows), it, 16, 2, least=8).collect())
    assert got == [(1, 1, 0), (2, 1, 1)]


# garbled text

CLEAN = [
    "Le salaire s’élève à 4 000 € par an. L’équipe compte 19 ingénieurs.", "NÃO É NECESSÁRIA FORMAÇÃO. Até “AMANHÃ”…", "Zespół liczy 26 osób i wciąż się rozwija.", "Die Vergütung beträgt 33.000 € jährlich. Größe",
    "Ищем разработчика со знанием Figma, и возможна удалённая работа.", "ОПЫТ РАБОТЫ", "Plain ASCII only", "A café • naïve — “quoted” 5 m² ½", "¿Te gustaría diseñar? ¡Sí! Él dijo: «Ñandú».", "Δοκιμή και άλλα", "日本語のテキスト",
]


@pytest.mark.parametrize("text", CLEAN)
def test_clean_text_is_left_alone(text):
    assert gb.restore(text) == (text, 0)


@pytest.mark.parametrize("codec", ["cp1252", "latin-1", "mac_roman", "cp437", "cp1250"])
@pytest.mark.parametrize("text", ["My résumé was two pages", "It’s about £40 – a naïve view", "Für unser Büro jährlich"])
def test_round_trip(text, codec):
    wrong = bytes(text, "utf-8")
    bad = "".join(gb._HIGH[codec][b - 128] if b > 127 else chr(b) for b in wrong)
    assert gb.restore(bad)[0] == text


@pytest.mark.parametrize("codec", ["cp1252", "latin-1", "mac_roman"])
@pytest.mark.parametrize("text", ["Great team \u2605 apply", "\u25cf Python \u25aa SQL \u2714 done", "Join us \U0001f680 today", "日本語の求人", "Lương cao và hồ sơ tiếng Việt", "דרוש מפתח תוכנה", "مطلوب مهندس برمجيات في المدينة", "รับสมัครงาน"])
def test_any_script_comes_back(text, codec):
    bad = "".join(gb._HIGH[codec][b - 128] if b > 127 else chr(b) for b in text.encode())
    assert gb.restore(bad)[0] == text


def read_as_western(text, meant):
    return "".join(gb._HIGH["cp1252"][b - 128] if b > 127 else chr(b) for b in text.encode(meant))


@pytest.mark.parametrize(
    ("meant", "text"),
    [("cp1253", "Ελληνική γλώσσα και κείμενο για εργασία"), ("gb2312", "我们正在寻找一名软件工程师"), ("euc_kr", "한국어 문장을 잘못 읽었습니다"), ("euc_jp", "日本語の文章を間違えて読みました"),
     ("cp1254", "Takım çalışmasına yatkın, iş deneyimi olan çalışanlar arıyoruz"), ("cp1250", "Hledáme zkušeného vývojáře, který má zájem o práci v týmu a umí řídit"), ("iso8859-2", "Poszukujemy osoby, która będzie odpowiedzialna za obsługę klientów"),
     ("cp1251", "Ищем разработчика"), ("cp1255", "שלום לכולם אנחנו מחפשים"), ("cp1250", "Munkatársat keresünk, aki szívesen dolgozik velünk és jól tűri a terhelést, erős")],
)
def test_legacy_encodings_of_any_script(meant, text):
    assert gb.restore(read_as_western(text, meant))[0] == text
    assert gb.restore(text) == (text, 0)


@pytest.mark.parametrize("codec", ["cp1252", "latin-1"])
@pytest.mark.parametrize("text", ["The α level", "नमस्ते दुनिया आप कैसे हैं", "안녕하세요 세계", "こんにちは世界", "→ apply ✓ ★ ok", "Ελληνικά κείμενα", "İstanbul’da çalışma", "Příliš žluťoučký kůň"])
def test_utf8_of_any_script(codec, text):
    bad = "".join(gb._HIGH[codec][b - 128] if b > 127 else chr(b) for b in text.encode())
    assert gb.restore(bad)[0] == text


@pytest.mark.parametrize(
    "text",
    ["Fróðlegt er að þýða íslenskan texta á önnur tungumál, það er gaman", "Blåbærgrød på fløde er godt til æbler", "Não há informação disponível, são João e irmão", "Crème brûlée à la carte, où êtes-vous, élève, naïve, Noël",
     "Però è così, perché può, città, più, già", "Zażółć gęślą jaźń", "m² and m³ – 5 µm ± 2 ¼", "El niño comió piñas ¿qué? ¡sí!", "Türkçe çalışma ığdır", "Ünlü ÀÉÈ", "Їжак і її друзі прийшли", "Нова работа за програмист", "“«Été»” … – Žižkov café"],
)
def test_clean_text_of_other_languages(text):
    assert gb.restore(text) == (text, 0)


@pytest.mark.parametrize("text", ["Il dit «\xa0voilà\xa0» et “un café”…", "On passe à\xa0«\xa0plus\xa0»", "“naïveté”…"])
def test_marks_after_accents_are_left_alone(text):
    assert gb.restore(text) == (text, 0)


def test_nested_and_partial():
    text = "Send a résumé to the café. It’s “small”."
    bad = text
    for _ in range(3):
        bad = "".join(gb._HIGH["cp1252"][b - 128] if b > 127 else chr(b) for b in bad.encode())
    assert gb.restore(bad) == (text, 3)
    assert gb.restore("Déjà vu in the cafÃ© and at £5")[0] == "Déjà vu in the café and at £5"


def test_legacy_pairs():
    ru = "Ищем разработчика со знанием, начало работы осенью"
    assert gb.restore(ru.encode("cp1251").decode("cp1252"))[0] == ru
    assert gb.restore(ru.encode("koi8-r").decode("cp1251"))[0] == ru
    pl = "Każdy nowy pracownik, początek współpracy"
    assert gb.restore(pl.encode("cp1250").decode("cp1252"))[0] == pl


def test_garbled_rows(spark):
    rows = [(1, "cafÃ©"), (1, "cafÃ©"), (2, None), (3, ""), (4, "r�sum�"), (5, "x" * 300_000 + "Ã©"), (6, "fine – really"), (None, "cafÃ©")]
    got = {r["doc_id"]: (r["layers"], r["restorable"]) for r in gb.garbled(docs(spark, rows)).collect()}
    assert got == {1: (1, True), 4: (0, False), 5: (1, True)}
    assert gb.garbled(docs(spark, [])).collect() == []


# truncation


def truncated_table(spark, n=400):
    rng = random.Random(2)
    nouns = ["warehouse", "ledger", "portal", "network", "screen", "registry"]
    sentence = lambda: rng.choice(["We look after the {}.", "You would own the {} and share what you learn about it.", "Our clients rely on a {} every morning."]).format(rng.choice(nouns))
    rows, cut = [], set()
    for i in range(n):
        text = " ".join(sentence() for _ in range(rng.randint(4, 9)))
        if i % 4 == 0:
            text += rng.choice(["\nApply now", "\n* Kafka", "\nTools: Kafka, Spark and more...", "\n* Spark"])
        source = "limited" if i % 2 else "open"
        if source == "limited" and len(text) > 200:
            text = text[:200]
            if not text.rstrip().endswith((".", "Apply now", "Kafka", "Spark", "more...")):
                cut.add(f"j{i}")
        rows.append((f"j{i}", text, source, "x", 3))
    return spark.createDataFrame(rows, "job_id string, description string, source string, opening string, n int"), cut


def test_truncation(spark):
    df, cut = truncated_table(spark)
    lengths = {(r["source"], r["length"]) for r in tr.significant_lengths(df, "description", "source").collect()}
    assert ("limited", 200) in lengths and all(s == "limited" for s, _ in lengths)
    got = {r["id"] for r in tr.endings(df, "job_id", "description", "source").where("cut").collect()}
    assert len(got & cut) >= 0.9 * len(cut) and len(got - cut) <= 0.03 * 400
    # hazards tell field limits from cuts in transfer
    kinds = {(r["source"], r["length"] == 200, r["kind"]) for r in tr.endings(df, "job_id", "description", "source").where("cut").collect()}
    assert ("limited", True, "limit") in kinds and all((k == "limit") == (s == "limited" and at) for s, at, k in kinds)
    rates = {r["source"]: r["share"] for r in tr.by_source(tr.endings(df, "job_id", "description", "source")).collect()}
    assert rates["limited"] > 0.3 > rates["open"]


def test_truncation_edges(spark):
    rows = [("a", None, "s"), ("b", "", "s"), ("c", "-", "s"), ("d", "Whole sentence.", None), ("d", "Whole sentence.", None), ("e", "We look after the <p", "s"), ("f", "<p></p>", "s"), (None, "x", "s"), ("g", "word " * 200_000 + "end.", "s"), ("h", "Ends with a list,", "s")]
    df = spark.createDataFrame(rows, "job_id string, description string, source string")
    got = {r["id"]: r["cut"] for r in tr.endings(df, "job_id", "description", "source").collect()}
    assert got["d"] is False and got["e"] is True and got["g"] is False and got["h"] is True and not {"a", "b", "c"} & set(got)
    assert tr.endings(df.limit(0), "job_id", "description", "source").collect() == []


def test_hazard_of_a_length_is_counted_over_distinct_texts(spark):
    """A stub that many rows share makes no length significant; a limit near the longest texts does."""
    rng = random.Random(9)
    rows = [(f"s{i}", "Please phone us about this post.", "a") for i in range(500)]
    rows += [(f"t{i}", "".join(rng.choice("abcdef ") for _ in range(min(rng.randint(50, 400), 300))), "a") for i in range(900)]
    df = spark.createDataFrame(rows, "job_id string, description string, source string")
    found = {r["length"]: r for r in tr.significant_lengths(df, "description", "source").collect()}
    assert set(found) == {300} and found[300]["at_risk"] == found[300]["n"] and found[300]["n"] > 20 * found[300]["expected"]


def test_open_tag_longer_than_the_tail(spark):
    rows = [("a", 'We look after the ledger. See <a href="https://example.org/' + "x" * 200, "s"), ("b", "Five < six. Done.", "s"), ("c", "<p>Whole.</p>", "s")]
    got = {r["id"]: r["cut"] for r in tr.endings(spark.createDataFrame(rows, "job_id string, description string, source string"), "job_id", "description", "source").collect()}
    assert got == {"a": True, "b": False, "c": False}


def test_copies_of_a_cut_text_do_not_confirm_its_end(spark):
    """Nor do they when they are a fifth of the table; a short stub that several sources have is complete."""
    df, _ = truncated_table(spark)
    hot = "We look after the ledger. Our clients rely on a portal every morning. Zebra crossings are painted by the"
    rows = [(f"hot{i}", hot, ("limited", "open")[i % 2], "x", 3) for i in range(80)] + [(f"stub{i}", "Kindly phone us", f"s{i % 3}", "x", 3) for i in range(9)]
    got = {r["id"]: r["cut"] for r in tr.endings(df.unionByName(spark.createDataFrame(rows, df.schema)), "job_id", "description", "source").collect()}
    assert all(got[f"hot{i}"] for i in range(80)) and not any(got[f"stub{i}"] for i in range(9))


# canonical values and names

AREAS = [("QB", "Hollowmere"), ("VX", "Orm"), ("XV", "Stow-on-Marl"), ("QZ", "Saint Aldern"), ("VW", "Oldcastle Fen")]
ROLES = ["Data Engineer", "Data Analyst", "Full Stack Developer", "Site Reliability Engineer", "Quality Assurance Engineer", "Engineering Manager", "Project Manager"]


@pytest.mark.parametrize(
    ("value", "city"),
    [("hollowmere", "Hollowmere"), ("Hybrid - Holowmere", "Hollowmere"), ("H'wmere", "Hollowmere"), ("QB1 2CD, Remote", "Hollowmere"), ("St. Aldern", "Saint Aldern"), ("Stow o/Marl", "Stow-on-Marl"), ("Orm, Norshire", "Orm"),
     ("Ormskell Green", None), ("Remote", None), ("TBC", None), ("ZZ9 9ZZ", None), ("Om", None)],
)
def test_places(value, city):
    assert (cn.place_matcher(AREAS, {})(value)[4] or None) == city


@pytest.mark.parametrize(
    ("value", "role"),
    [("Senior Data Engneer", "Data Engineer"), ("Engineer, Data [00123456]", "Data Engineer"), ("Developer (Full Stack)", "Full Stack Developer"), ("Fullstack Dev - £400pd", "Full Stack Developer"), ("Lead SRE", "Site Reliability Engineer"),
     ("Data Pipeline Engineer (Data Eng)", "Data Engineer"), ("Jr QA Eng | Hybrid", "Quality Assurance Engineer"), ("Eng Manager", "Engineering Manager"), ("Manager - Projects", "Project Manager"), ("Night Porter", None), ("Data Analyst - Clinical Data", "Data Analyst")],
)
def test_titles(value, role):
    assert (cn.title_matcher(ROLES, {})(value)[4] or None) == role


def test_dictionary_against_brute_force():
    rng = random.Random(6)
    keys = ["".join(rng.choice("abcde") for _ in range(rng.randint(3, 12))) for _ in range(40)]
    book = Dictionary((k, k, rng.randint(0, 5)) for k in keys)
    from postlode.llm.edits import bound

    for _ in range(300):
        q = list(rng.choice(keys))
        for _ in range(rng.randint(0, 2)):
            q[rng.randrange(len(q))] = rng.choice("abcde")
        q = "".join(q)
        got = book.lookup(q)
        near = [(weighted_distance(q, k, float(min(bound(len(q)), bound(len(k))))), k) for k in keys]
        near = [x for x in near if x[0] <= min(bound(len(q)), bound(len(x[1])))]
        assert (got is None) == (not near)
        if got and got[0] > 0:
            assert got[0] == min(x[0] for x in near)


def test_canonical_rows(spark):
    raw = spark.createDataFrame([("a", "Orm", "Data Engineer", "x"), ("b", " ", None, "x"), ("c", "ORM", "data engineer", "x"), ("c", "ORM", "data engineer", "x"), ("d", "nowhere " * 2000, "boss " * 3000, "x")], "job_id string, location string, title string, entry string")
    areas = spark.createDataFrame([*AREAS, (None, "Orm"), ("XX", None)], "area string, city string")
    roles = spark.createDataFrame([(r,) for r in ROLES], "role_title string")
    got = {(r["key"], r["field"]): r["entry"] for r in cn.map_postings(raw, areas, roles).collect()}
    assert got == {("a", "location"): "Orm", ("a", "title"): "Data Engineer", ("c", "location"): "Orm", ("c", "title"): "Data Engineer", ("d", "location"): None, ("d", "title"): None}
    assert cn.map_postings(raw.limit(0), areas, roles).collect() == []


def test_names(spark):
    groups = [
        ["Margaret Spoxonyard-Luvveryard Logistics Ltd", "Maggie Spoxonyard Luvveryard Logistics", "M. Spoxonyard-Luvveryard Logistics Ltd", "MARGARET  SPOXONYARD-LUVVERYARD LOGISTICS LTD", "Margaret Spoxonyard-Luvveryard Logistics Ltd T/A Spoxonyardluvveryard"],
        ["Brozzthorpe Clumbeldale Engineering Limited", "Brozzthorpe + Clumbeldale Eng. Limited", "Clumbeldale & Brozzthorpe Engineering", "BrozzthorpeClumbeldale Engineering", "Brozzth0rpe Clumbeldale Engineering"],
        ["Drilvmere Stovverpool Solutions", "Drilvmere Stovveprool Solutions", "Drilvmere Stovverpool PLC"],
        ["Cluggerridge Drilvmere Solutions"], ["Robert Spoxonyard-Luvveryard Logistics Ltd"],
    ]
    rows = [(v, 1) for g in groups for v in g for _ in range(5 if v == g[0] else 1)] + [(v, 1) for v in (None, "", "-", "Confidential", "n/a", "Ltd")]
    df = spark.createDataFrame(rows, "company string, entity int")
    got = {(r["value_a"], r["value_b"]) for r in nm.variant_pairs([(df, "company"), (df.limit(3), "company")]).collect()}
    want = {(min(a, b), max(a, b)) for g in groups for a in g for b in g if a != b}
    assert got == want
    assert nm.variant_pairs([(df.limit(0), "company")]).collect() == []


def test_long_lists_go_in_rounds(spark):
    """A list that goes in many rounds maps as it does in one."""
    rng = random.Random(2)
    titles = ["Data Engineer", "Data Enginer", "Senior Data Analyst", "Analyst (Data)", "Proj Mgr", "Night Porter", "Site Rel Eng", "The Full Stack Developer Post", " "]
    places = ["Hollowmere", "H'wmere", "holowmere", "VX1 2AB", "Stow o Marl", "Nowhere", None, "Oldcastle"]
    raw = spark.createDataFrame([(f"j{i}", rng.choice(places), rng.choice(titles)) for i in range(60)], "job_id string, location string, title string")
    areas, roles = spark.createDataFrame(AREAS, "area string, city string"), spark.createDataFrame([(r,) for r in ROLES], "role_title string")
    one, many = ({(r["key"], r["field"]): (r["entry"], r["distance"]) for r in cn.map_postings(raw, areas, roles, most_entries=m).collect()} for m in (100, 2))
    assert one == many and any(e for e, _ in one.values())


def test_lexicon_is_a_parameter():
    plain = cn.Lexicon(titles={}, titles_before={})
    assert cn.title_matcher(["Project Manager"], {}, plain)("PM") is cn.NONE and cn.title_matcher(["Project Manager"], {})("PM")[4] == "Project Manager"


def test_a_list_of_150000_entries(spark):
    """Every misspelt entry of a list longer than one broadcast comes back."""
    rng = np.random.default_rng(5)
    words_ = ["".join(w) for w in rng.choice(list("abcdefghijklmnopqrstuvwxyz"), size=(150_000, 12))]
    roles = spark.createDataFrame([(w,) for w in words_], "role_title string")
    asked = [(str(i), w[:5] + w[6:]) for i, w in enumerate(words_[::10_000])]
    got = {r["key"]: r["entry"] for r in cn.map_column(spark.createDataFrame(asked, "job_id string, title string"), "job_id", "title", roles, "title").collect()}
    assert got == {str(i): w for i, w in enumerate(words_[::10_000])}


def test_short_and_brief_names(spark):
    groups = [
        ["ARM Ltd", "Arm Limited", "arm"], ["IBM", "IBM UK", "ibm ltd"], ["BT Group plc", "BT"], ["SAP UK", "SAP"], ["3M", "3M UK Ltd"], ["EY", "EY LLP"], ["Robert Hartwell Software", "R. Hartwell Software", "Bob Hartwell Software Ltd"],
        ["William Hartwell Software", "W. Hartwell Software", "Hartwell Software"], ["Brozzthorpe Clumbeldale Engineering Ltd", "Brozzthorpe Clumb. Engineering", "Brozzthorpe Clumbleedale Engineering"], ["Old Flindbury Luvvermoor Health", "Flindbury Luvvermoor Health Ltd (FLH)"],
    ]
    rows = [(v, 1) for g in groups for v in g for _ in range(5 if v == g[0] else 1)] + [("William Hartwell Software", 1)] * 5
    df = spark.createDataFrame(rows, "company string, root int")
    got = {(r["value_a"], r["value_b"]) for r in nm.variant_pairs([(df, "company")]).collect()}
    assert got == {(min(a, b), max(a, b)) for g in groups for a in g for b in g if a != b}


def test_brief_cores_of_several_readings_are_not_linked(spark):
    names = ["Flindbury Luvvermoor Health", "Flindbury Luvverdale Health", "Flindbury Luv. Health", "Flindbury Health"]
    assert nm.variant_pairs([(spark.createDataFrame([(v,) for v in names], "company string"), "company")]).collect() == []


def test_assignment_against_all_permutations():
    from itertools import permutations

    rng = random.Random(3)
    for _ in range(300):
        n = rng.randint(1, 5)
        m = rng.randint(n, 6)
        cost = [[rng.choice([0.0, 0.5, 1.0, 1.8, 2.8]) for _ in range(m)] for _ in range(n)]
        got = nm.assignment(cost)
        assert len(set(got)) == n
        assert abs(sum(cost[i][j] for i, j in enumerate(got)) - min(sum(cost[i][j] for i, j in enumerate(p)) for p in permutations(range(m), n))) < 1e-9


def test_lists_of_words_are_parameters(spark):
    df = spark.createDataFrame([("Zorb Werke GmbH",), ("Zorb Werke AG",), ("Zorb Anlagen AG",)], "company string")
    words = nm.Words(legal=frozenset({"gmbh", "ag"}), trades=("werke", "anlagen"))
    assert [(r[0], r[1]) for r in nm.entities([(df, "company")], words).where("value like '%Werke%' and entity like '%Werke%'").orderBy("value").select("entity", "value").collect()] == [("Zorb Werke GmbH", "Zorb Werke AG"), ("Zorb Werke GmbH", "Zorb Werke GmbH")]


# packing


def test_packing(spark):
    rng = random.Random(1)
    items = [(i, rng.choice([0, rng.randint(1, 40), rng.randint(1, 100), rng.randint(90, 350)])) for i in range(3000)] + [(7, 100), (7, 100), (None, 5)]
    df = spark.createDataFrame(items, "id bigint, tokens bigint")
    packed = pk.pack(df, [(1, 100), (2, 64)], block_items=700).collect()
    for cid, cap in ((1, 100), (2, 64)):
        mine = [r for r in packed if r["capacity_id"] == cid]
        load: dict[str, int] = {}
        for r in mine:
            assert (r["container"] is None) == (r["tokens"] == 0)
            if r["container"] is not None:
                load[r["container"]] = load.get(r["container"], 0) + r["tokens"]
        assert max(load.values()) <= cap
        assert sum(r["tokens"] for r in mine) == sum(n for _, n in items)
        parts: dict = {}
        for r in mine:
            parts.setdefault(r["doc_id"], []).append((r["part"], r["first_token"], r["tokens"]))
        for i, n in items:
            if n <= cap and i not in (7,):
                assert len(parts[i]) == 1
        assert sum(load.values()) / (len(load) * cap) > 0.95


def optimum(sizes, cap):
    """Least containers by dynamic programming over subsets: (full containers, load of the open one)."""
    best = [(0, cap)] + [(len(sizes), cap)] * ((1 << len(sizes)) - 1)
    for m in range(1 << len(sizes)):
        used, load = best[m]
        for i, s in enumerate(sizes):
            if not m >> i & 1:
                after = (used, load + s) if load + s <= cap else (used + 1, s)
                best[m | 1 << i] = min(best[m | 1 << i], after)
    return best[-1][0]


def test_dominance_keeps_the_optimum():
    rng = random.Random(11)
    by_dominance = 0
    for k in range(5000):
        low, high = ((2, 12), (1, 20), (5, 11))[k % 3]
        sizes = sorted((rng.randint(low, high) for _ in range(rng.randint(0, 9))), reverse=True)
        fixed, rest = pk.reduce_dominated(sizes, 20)
        assert sorted([i for b in fixed for i in b] + rest) == list(range(len(sizes)))
        by_dominance += len(sizes) - len(rest)
        if fixed and rest:
            assert len(fixed) + optimum([sizes[i] for i in rest], 20) == optimum(sizes, 20), sizes
        elif fixed:
            assert len(fixed) == optimum(sizes, 20), sizes
    assert by_dominance > 5000
    # three that fit together beat the pair: nothing may be fixed for the 10
    sizes = [10, 9, 9, 4, 3, 3, 2]
    fixed, rest = pk.reduce_dominated(sizes, 20)
    assert len(fixed) + optimum([sizes[i] for i in rest], 20) == optimum(sizes, 20) == 2


def test_packing_empty_and_tokens(spark):
    df = spark.createDataFrame([], "id bigint, tokens bigint")
    assert pk.pack(df, [(1, 10)]).collect() == []
    got = {r["id"]: r["tokens"] for r in pk.token_counts(docs(spark, [(1, "Hello world"), (2, None), (3, ""), (4, "<|endoftext|>")])).collect()}
    assert got[1] == 2 and got[2] == got[3] == 0 and got[4] > 1


# percentiles


@pytest.mark.parametrize("limit", [0, 3, 1000])
def test_multi_select_against_numpy(spark, limit):
    rng = np.random.default_rng(3)
    data = {"normal": rng.normal(0, 1000, 500), "ties": rng.integers(0, 4, 400).astype(float), "one": np.array([5.0]), "tail": rng.pareto(1.1, 300) * 1e4, "zeros": np.zeros(50), "negative": -rng.random(101)}
    rows = [(g, float(x), 1) for g, v in data.items() for x in v] + [("normal", None, 1), ("none", None, 1), (None, 2.0, 1), (None, 4.0, 1), ("normal", float("nan"), 1)]
    df = spark.createDataFrame(rows, "g string, x double, q int").repartition(7)
    got = {(r["g"], r["q"]): (r["n"], r["value"]) for r in pc.percentiles(df, F.col("g"), F.col("x"), (0.0, 0.25, 0.5, 0.9, 1.0), limit).collect()}
    for g, v in [*data.items(), (None, np.array([2.0, 4.0]))]:
        for q in (0.0, 0.25, 0.5, 0.9, 1.0):
            assert got[g, q][0] == len(v) and got[g, q][1] == pytest.approx(np.quantile(v, q), rel=1e-12, abs=1e-9)
    assert not any(g == "none" for g, _ in got)


def test_summaries_combine(spark):
    rng = np.random.default_rng(4)
    v = rng.lognormal(10, 1, 2000)
    df = spark.createDataFrame([("a", i % 5, float(x)) for i, x in enumerate(v)], "g string, day int, x double")
    daily = pc.summary(df, [F.col("g"), F.col("day")], F.col("x"))
    for r in pc.read_summary(pc.merge(daily, ["g"]), ["g"], (0.1, 0.5, 0.99)).collect():
        exact = np.sort(v)[max(0, int(np.ceil(r["q"] * len(v))) - 1)]
        assert r["n"] == 2000 and abs(r["value"] / exact - 1) <= pc.ALPHA
    assert pc.percentiles(df.limit(0), F.col("g"), F.col("x")).collect() == []


