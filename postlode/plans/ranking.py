"""Registered similarity and ranking queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from postlode.functions import text as tx
from postlode.operators import similarity as sim
from postlode.registry import query
from postlode.tables import table

_TEXT = "trim(regexp_replace(regexp_replace(lower(coalesce(company, '') || ' ' || substr(coalesce(description, ''), 1, 200)), '[^a-z0-9\\s]', ' ', 'g'), '\\s+', ' ', 'g'))"
_SETS = f"""WITH r AS (SELECT DISTINCT job_id, list_filter(string_split({_TEXT}, ' '), lambda x: x <> '') AS w FROM raw_job),
    s AS (SELECT job_id, CASE WHEN len(w) < 4 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) END AS s FROM r WHERE len(w) > 0),
    e AS (SELECT job_id, len(s) AS n, unnest(s) AS g FROM s), p AS (SELECT a.job_id AS a, b.job_id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS o FROM e a JOIN e b ON a.g = b.g AND a.job_id < b.job_id GROUP BY 1, 2),
    q AS (SELECT a, b, o / (na + nb - o) AS j FROM p WHERE o / (na + nb - o) >= 0.85)"""


def _shingled(df):
    """(..., s): shingles, with text and words as columns of their own so that each is computed once."""
    t = df.withColumn("_t", tx.shingle_text(F.col("company"), F.col("description"))).drop("company", "description")
    w = t.withColumn("_w", F.when(F.col("_t") == "", F.array().cast("array<string>")).otherwise(F.split("_t", " ")))
    return w.withColumn("s", tx.shingles_of(F.col("_w"))).drop("_t", "_w")


def _rows(spark, d):
    return _shingled(table(spark, d, "raw_job").select("job_id", "company", "description"))


@query("ref_j05_shingle_pairs", _SETS + " SELECT a, b, round(j, 6) AS jaccard FROM q")
def shingle_pairs(spark, d):
    return sim.shingle_pairs(_rows(spark, d), "job_id", F.col("s")).select("a", "b", F.round("jaccard", 6).alias("jaccard"))


_H = "substr(sha256(" + " || '|' || ".join(f"regexp_replace(lower(coalesce({c}, '')), '^\\s+|\\s+$', '', 'g')" for c in ("title", "company", "location")) + "), 1, 16)"


@query(
    "ref_j05_keep_new",
    _SETS + f""", h AS (SELECT job_id, min(scraped_at) AS t, any_value({_H}) AS h FROM raw_job GROUP BY job_id), f AS (SELECT arg_min(job_id, struct_pack(a := t, b := job_id)) AS job_id, min(struct_pack(a := t, b := job_id)) AS o FROM h GROUP BY h)
    SELECT job_id FROM f WHERE job_id NOT IN (SELECT CASE WHEN x.o > y.o THEN a ELSE b END FROM q JOIN f x ON x.job_id = q.a JOIN f y ON y.job_id = q.b)""",
)
def keep_new(spark, d):
    h = tx.dedup_hash(F.col("title"), F.col("company"), F.col("location"))
    return sim.keep_new(_shingled(table(spark, d, "raw_job").select("job_id", "scraped_at", h.alias("h"), "company", "description")), "job_id", "scraped_at", "h", F.col("s"))


_TERMS = ("python", "data", "engineer", "data", "kafka")


@query(
    "ref_f15_bm25",
    """WITH t AS (SELECT doc_id, regexp_extract_all(lower(regexp_replace(coalesce(text, ''), '[^ -~]', ' ', 'g')), '\\b[a-z][a-z0-9+#.\\-]{1,}\\b') AS w FROM documents), c AS (SELECT count(*) AS corpus, avg(len(w)) AS avgdl FROM t),
    d AS (SELECT w, ln(any_value(corpus) - count(*) + 0.5) - ln(count(*) + 0.5) AS idf FROM (SELECT doc_id, unnest(list_distinct(w)) AS w FROM t), c GROUP BY w), a AS (SELECT avg(idf) AS mean FROM d),
    q AS (SELECT d.w, qn, CASE WHEN idf < 0 THEN 0.25 * mean ELSE idf END AS idf FROM (SELECT w, count(*) AS qn FROM (SELECT unnest(['python', 'data', 'engineer', 'data', 'kafka']) AS w) GROUP BY w) k JOIN d USING (w), a),
    f AS (SELECT doc_id, dl, w, count(*) AS tf FROM (SELECT doc_id, len(w) AS dl, unnest(w) AS w FROM t) GROUP BY 1, 2, 3),
    s AS (SELECT doc_id, sum(qn * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS s FROM f JOIN q USING (w), c GROUP BY doc_id), z AS (SELECT doc_id, coalesce(s, 0) AS s FROM t LEFT JOIN s USING (doc_id))
    SELECT doc_id, round(s / (SELECT CASE WHEN max(s) > 0 THEN max(s) ELSE 1 END FROM z), 6) AS score FROM z""",
)
def bm25(spark, d):
    docs = table(spark, d, "documents")
    ascii_ = F.regexp_replace(F.coalesce("text", F.lit("")), "[^ -~]", " ")
    return sim.bm25(docs, "doc_id", ascii_, list(_TERMS)).select("doc_id", F.round("score", 6).alias("score"))


@query(
    "ref_f14_o10_j12_cosine_topk",
    "WITH q AS (SELECT embedding AS v FROM embeddings ORDER BY vec_id LIMIT 1), s AS (SELECT vec_id, list_cosine_similarity(embedding::DOUBLE[], v::DOUBLE[]) AS c FROM embeddings, q) SELECT vec_id, round(c, 3) AS similarity FROM s WHERE c >= 0.2 ORDER BY c DESC, vec_id LIMIT 10",
)
def cosine_topk(spark, d):
    v = table(spark, d, "embeddings")
    first = v.orderBy("vec_id").limit(1).select("embedding").first()
    return sim.nearest(v, "vec_id", "embedding", list(first[0]) if first else [0.0], 10).select("vec_id", F.round("similarity", 3).alias("similarity"))


_PROFILE = ("docker", "kafka", "python", "sql")


@query(
    "ref_f16_f17_ensemble_gate",
    """WITH t AS (SELECT job_id, regexp_extract_all(lower(regexp_replace(coalesce(max(description), ''), '[^ -~]', ' ', 'g')), '\\b[a-z][a-z0-9+#.\\-]{1,}\\b') AS w FROM raw_job GROUP BY job_id), c AS (SELECT count(*) AS corpus, avg(len(w)) AS avgdl FROM t),
    d AS (SELECT w, ln(any_value(corpus) - count(*) + 0.5) - ln(count(*) + 0.5) AS idf FROM (SELECT job_id, unnest(list_distinct(w)) AS w FROM t), c GROUP BY w), a AS (SELECT avg(idf) AS mean FROM d),
    q AS (SELECT d.w, CASE WHEN idf < 0 THEN 0.25 * mean ELSE idf END AS idf FROM (SELECT unnest(['docker', 'kafka', 'python', 'sql']) AS w) k JOIN d USING (w), a),
    f AS (SELECT job_id, dl, w, count(*) AS tf FROM (SELECT job_id, len(w) AS dl, unnest(w) AS w FROM t) GROUP BY 1, 2, 3),
    s AS (SELECT job_id, sum(idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS s FROM f JOIN q USING (w), c GROUP BY job_id), z AS (SELECT job_id, coalesce(s, 0) AS s FROM t LEFT JOIN s USING (job_id)),
    v AS (SELECT job_id, list_transform(['docker', 'kafka', 'python', 'sql'], lambda x: len(list_filter(w, lambda y: y = x))) AS v FROM t),
    p AS (SELECT job_id, len(list_filter(v, lambda x: x > 0)) / 4 AS overlap, CASE WHEN list_sum(v) > 0 THEN list_sum(v) / (2 * sqrt(list_sum(list_transform(v, lambda x: x * x)))) ELSE 0 END AS emb FROM v)
    SELECT job_id, round(0.5 * emb + 0.3 * s / (SELECT CASE WHEN max(s) > 0 THEN max(s) ELSE 1 END FROM z) + 0.2 * overlap, 6) AS score FROM z JOIN p USING (job_id) WHERE round(0.5 * emb + 0.3 * s / (SELECT CASE WHEN max(s) > 0 THEN max(s) ELSE 1 END FROM z) + 0.2 * overlap, 9) >= 0.30""",
)
def ensemble_gate(spark, d):
    """Postings that pass the gate: cosine of their vectors of profile words, BM25 rank and overlap with the profile. A
    sentence model's vectors would take the place of the word counts."""
    j = table(spark, d, "raw_job").groupBy("job_id").agg(F.regexp_replace(F.coalesce(F.max("description"), F.lit("")), "[^ -~]", " ").alias("text"))
    rank = sim.bm25(j, "job_id", F.col("text"), list(_PROFILE)).withColumnRenamed("score", "rank")
    times = lambda w: F.size(F.filter(tx.tokens(F.col("text")), lambda t: t == w))
    counted = j.select("job_id", sim.skill_share(list(_PROFILE), F.col("text")).alias("overlap"), F.array(*[times(w) for w in _PROFILE]).alias("v"))
    near = F.coalesce(sim.cosine(F.col("v"), F.array(*[F.lit(1.0)] * len(_PROFILE))), F.lit(0.0))
    both = rank.join(counted.select("job_id", "overlap", F.when(F.array_max("v") > 0, near).otherwise(0.0).alias("near")), "job_id")
    score = sim.ensemble(F.col("near"), F.col("rank"), F.col("overlap"))
    return both.where(F.round(score, 9) >= sim.GATE).select("job_id", F.round(score, 6).alias("score"))


@query("ref_j06_f07_register_match")
def register_match(spark, d):
    """Employers of new postings against the employers of licensed ones, exact after normalising, then fuzzy."""
    register = table(spark, d, "job_analytics").where("employer_is_licensed_sponsor = 1").select("company").where("company is not null")
    return sim.register_match(table(spark, d, "incoming_job").where("company is not null"), "company", register, "company")


@query("ref_p35_j08_overlapping_boxes", "WITH b AS (SELECT label, vec_id AS id, embedding[1] AS x, embedding[2] AS y FROM embeddings) SELECT p.id AS a, q.id AS b FROM b p JOIN b q ON p.label = q.label AND p.id < q.id AND abs(p.x - q.x) < 0.05 AND abs(p.y - q.y) < 0.05")
def overlapping_boxes(spark, d):
    """Boxes of 0.05 by 0.05 that overlap on their sheet: each meets only the cells of the grid around it."""
    b = table(spark, d, "embeddings").select("label", F.col("vec_id").alias("id"), F.col("embedding")[0].alias("x"), F.col("embedding")[1].alias("y"))
    cell = lambda c: F.floor(F.col(c) / F.lit(0.05))
    home = b.withColumns({"cx": cell("x"), "cy": cell("y")})
    cells = F.expr("flatten(transform(array(-1, 0, 1), i -> transform(array(-1, 0, 1), j -> struct(cx + i as cx, cy + j as cy))))")
    around = home.select("label", F.col("id").alias("id2"), F.col("x").alias("x2"), F.col("y").alias("y2"), F.explode(cells).alias("c")).select("label", "id2", "x2", "y2", "c.cx", "c.cy")
    close = lambda a, b: F.abs(F.col(a) - F.col(b)) < F.lit(0.05)
    return home.join(around, ["label", "cx", "cy"]).where((F.col("id") < F.col("id2")) & close("x", "x2") & close("y", "y2")).select(F.col("id").alias("a"), F.col("id2").alias("b"))
