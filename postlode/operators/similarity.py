"""Rankings and similarities: shingle joins, BM25, cosine, overlap, name matching and their ensemble."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postlode.functions import text as tx
from postlode.session import cut

FUZZY = 0.85
K1, B, EPSILON = 1.5, 0.75, 0.25
WEIGHTS = (0.5, 0.3, 0.2)
GATE = 0.30
NAME_RATIO = 92.0
# Cells of the table of shingle counts (a power of two), most classes of sets that are broadcast, and what a bound gives way to rounding.
ORDER_BITS = 17
BROADCAST = 200_000
SLACK = 1e-6


def _hashed(df: DataFrame, keep: list[Column], shingles: Column) -> DataFrame:
    """(keep, h, n, c, b): 64-bit hashes of the shingles, their number, and the class of equal sets: a hash of the set and
    the parities of its shingles in 64 cells. The class of an empty set is NULL."""
    # shingles are made once and read several times; written out before anything filters on them
    made = df.select(*keep, F.array_distinct(shingles).alias("s")).select(*[F.col(c) for c in df.select(*keep).columns], F.expr("array_sort(array_distinct(transform(s, x -> xxhash64(x))))").alias("h"))
    parity = F.expr("aggregate(h, 0L, (a, x) -> a ^ shiftleft(1L, cast(pmod(shiftrightunsigned(x, 20), 64) as int)))")
    some = F.size("h") > 0
    return cut(made.withColumns({"n": F.size("h"), "c": F.when(some, F.xxhash64("h")), "b": F.when(some, parity)}))


def _class_links(made: DataFrame, threshold: float) -> DataFrame:
    """(ca, ba, cb, bb, j) of the pairs of different classes that reach the threshold.

    Prefix filter: only the rarest n - ceil(t n) + 1 shingles of each set are posted, in an order by counts in a table of
    fixed size. Postings meet under the length, positional and parity filters (two sets differ in at least as many shingles
    as their parities), and every pair that is left is verified once on its whole sets."""
    spark = made.sparkSession
    cells = 1 << ORDER_BITS
    counts = made.select(F.explode("h").alias("w")).groupBy(F.pmod("w", F.lit(cells)).alias("cell")).agg(F.count(F.lit(1)).alias("f"))
    every = spark.range(cells).select(F.col("id").alias("cell"), F.lit(0).cast("bigint").alias("f")).union(counts).groupBy("cell").agg(F.sum("f").alias("f"))
    # one byte a cell (four steps a doubling), as Spark copies the table to every row that it is read for
    order = cut(every.agg(F.expr("transform(array_sort(collect_list(struct(cell, f))), x -> cast(floor(4 * log2(x.f + 1)) as tinyint))").alias("f")))
    ranked = made.where("n > 0").crossJoin(F.broadcast(order)).select("n", "c", "b", F.expr(f"array_sort(transform(h, x -> struct(element_at(f, cast(pmod(x, {cells}) as int) + 1) as f, x as w)))").alias("r"))
    # less a little, so that a product that is a whole number isn't rounded up
    prefix = F.col("n") - F.ceil(F.col("n") * threshold - SLACK) + 1
    posted = ranked.select("n", "c", "b", F.posexplode(F.slice("r", F.lit(1), prefix.cast("int"))).alias("p", "x")).select(F.col("x.w").alias("w"), "c", "b", "n", "p")
    # dealt by shingle before copies are dropped, so that postings are shuffled once
    posted = posted.repartition("w").dropDuplicates(["w", "c", "b"])
    x, y = (posted.select("w", *[F.col(c).alias(c + side) for c in ("c", "b", "n", "p")]) for side in "ab")
    total = F.col("na") + F.col("nb")
    needed = total * (threshold / (1 + threshold)) - SLACK
    room = F.least(F.col("na") - F.col("pa"), F.col("nb") - F.col("pb")) >= needed
    apart = F.bit_count(F.col("ba").bitwiseXOR(F.col("bb"))) <= total - 2 * needed
    near = (F.least("na", "nb") >= threshold * F.greatest("na", "nb") - SLACK) & room & apart
    first = (F.col("ca") < F.col("cb")) | ((F.col("ca") == F.col("cb")) & (F.col("ba") < F.col("bb")))
    met = cut(x.join(y, "w").where(first & near).select("ca", "ba", "cb", "bb").distinct())
    wanted = met.select(F.col("ca").alias("c"), F.col("ba").alias("b")).union(met.select("cb", "bb")).distinct()
    # few classes are sent to the sets, many are met by a shuffle
    wanted = F.broadcast(wanted) if wanted.count() <= BROADCAST else wanted
    sets = made.join(wanted, ["c", "b"], "left_semi").select("c", "b", "h").dropDuplicates(["c", "b"])
    both = met.join(sets.select(F.col("c").alias("ca"), F.col("b").alias("ba"), F.col("h").alias("sa")), ["ca", "ba"]).join(sets.select(F.col("c").alias("cb"), F.col("b").alias("bb"), F.col("h").alias("sb")), ["cb", "bb"])
    shared = F.size(F.array_intersect("sa", "sb"))
    return both.withColumn("j", shared / (F.size("sa") + F.size("sb") - shared)).where(F.col("j") >= threshold).select("ca", "ba", "cb", "bb", "j")


def shingle_pairs(df: DataFrame, key: str, shingles: Column, threshold: float = FUZZY) -> DataFrame:
    """(a, b, jaccard), a < b: pairs of keys whose shingle sets reach the threshold; keys with equal sets included.

    Links are found between classes of equal sets, so copies are joined as one; repeated rows of a key count once."""
    made = _hashed(df, [F.col(key).alias("k")], shingles)
    members = made.where("c is not null").groupBy("k").agg(F.min(F.struct("c", "b")).alias("m")).select("k", "m.*")
    p, q = members.select(F.col("k").alias("p"), F.col("c").alias("ca"), F.col("b").alias("ba")), members.select(F.col("k").alias("q"), F.col("c").alias("cb"), F.col("b").alias("bb"))
    across = _class_links(made, threshold).join(p, ["ca", "ba"]).join(q, ["cb", "bb"]).select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b"), F.col("j").alias("jaccard"))
    own = p.join(q, (F.col("ca") == F.col("cb")) & (F.col("ba") == F.col("bb")) & (F.col("p") < F.col("q"))).select(F.col("p").alias("a"), F.col("q").alias("b"), F.lit(1.0).alias("jaccard"))
    return across.union(own)


def keep_new(df: DataFrame, key: str, order: str, hash_: str, shingles: Column, threshold: float = FUZZY) -> DataFrame:
    """Keys to keep: the first of its hash with no earlier first occurrence of a similar text. A key stands where its first
    row does, ties by key.

    What is compared are classes: a key goes if its own class or a linked one has an earlier member, so no pairs of members
    are made."""
    made = _hashed(df, [F.col(key).alias("k"), F.col(order).alias("o"), F.col(hash_).alias("h0")], shingles)
    keys = made.groupBy("k").agg(F.min("o").alias("o"), F.min("h0").alias("h0"), F.min(F.when(F.col("c").isNotNull(), F.struct("c", "b"))).alias("m"))
    first = cut(keys.withColumn("o", F.struct("o", "k")).groupBy("h0").agg(F.min_by(F.struct("o", "m"), "o").alias("r")).select("r.o", "r.m.*"))
    least = first.where("c is not null").groupBy("c", "b").agg(F.min("o").alias("o"))
    links = _class_links(made, threshold)
    both = links.select("ca", "ba", "cb", "bb").union(links.select("cb", "bb", "ca", "ba"))
    near = both.join(least.select(F.col("c").alias("cb"), F.col("b").alias("bb"), "o"), ["cb", "bb"]).select(F.col("ca").alias("c"), F.col("ba").alias("b"), "o")
    earliest = least.union(near).groupBy("c", "b").agg(F.min("o").alias("earliest"))
    return first.join(earliest, ["c", "b"], "left").where("earliest is null or earliest >= o").select(F.col("o.k").alias(key))


def bm25(docs: DataFrame, key: str, text: Column, terms: list[str]) -> DataFrame:
    """(key, score): Okapi BM25 of every document for the query terms (repeats count), divided by the corpus' largest.

    Only postings of query terms are aggregated; corpus statistics are single rows."""
    base = docs.select(F.col(key).alias("k"), tx.tokens(text).alias("t"))
    # corpus figures are single numbers
    corpus, avgdl = base.agg(F.count(F.lit(1)), F.avg(F.size("t"))).first()
    every = base.select("k", F.explode(F.array_distinct("t")).alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("df"))
    weights = cut(every.select("w", (F.ln(F.lit(corpus) - F.col("df") + 0.5) - F.ln(F.col("df") + 0.5)).alias("idf")))
    mean = F.lit(weights.agg(F.avg("idf")).first()[0]).cast("double")
    query = docs.sparkSession.createDataFrame([(t,) for t in terms], "w string").groupBy("w").agg(F.count(F.lit(1)).alias("qn"))
    q = query.join(weights, "w").select("w", "qn", F.when(F.col("idf") < 0, EPSILON * mean).otherwise(F.col("idf")).alias("idf"))
    tf = base.select("k", F.size("t").alias("dl"), F.explode("t").alias("w")).join(F.broadcast(q), "w").groupBy("k", "dl", "w", "qn", "idf").agg(F.count(F.lit(1)).alias("tf"))
    part = F.col("qn") * F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.lit(avgdl)))
    score = tf.groupBy("k").agg(F.sum(part).alias("s"))
    all_ = cut(base.select("k").join(score, "k", "left").select("k", F.coalesce("s", F.lit(0.0)).alias("s")))
    top = all_.agg(F.max("s")).first()[0]
    return all_.select(F.col("k").alias(key), (F.col("s") / F.lit(top if top and top > 0 else 1.0)).alias("score"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def nearest(vectors: DataFrame, key: str, vector: str, query: list[float], k: int, furthest: float = 0.8) -> DataFrame:
    """(key, similarity) of the k nearest by cosine, those beyond the distance dropped."""
    q = F.array(*[F.lit(float(x)) for x in query])
    return vectors.select(key, cosine(F.col(vector), q).alias("similarity")).where(F.col("similarity") >= 1 - furthest).orderBy(F.desc("similarity"), key).limit(k)


def skill_share(profile: list[str], text: Column) -> Column:
    """Share of the profile's skills among the tokens; 0.5 for an empty profile."""
    if not profile:
        return F.lit(0.5)
    p = F.array(*[F.lit(s.lower()) for s in sorted(set(profile))])
    return F.size(F.array_intersect(p, tx.tokens(text))) / len(set(profile))


def ensemble(embedding: Column, rank: Column, overlap: Column) -> Column:
    return WEIGHTS[0] * embedding + WEIGHTS[1] * rank + WEIGHTS[2] * overlap


def _indel(a: str, b: str) -> float:
    """200 * longest common subsequence / both lengths."""
    if not a and not b:
        return 100.0
    last = [0] * (len(b) + 1)
    for x in a:
        row = [0]
        for j, y in enumerate(b, 1):
            row.append(last[j - 1] + 1 if x == y else max(last[j], row[j - 1]))
        last = row
    return 200.0 * last[-1] / (len(a) + len(b))


def token_sort_ratio(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """pairs with `ratio`: similarity of the names with their words sorted, 0 to 100."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            key = lambda s: " ".join(sorted((s or "").split()))
            yield x.assign(ratio=[_indel(key(p), key(q)) for p, q in zip(x[a], x[b], strict=True)])

    return pairs.mapInPandas(run, pairs.schema.simpleString()[7:-1] + ",ratio:double")


def _grams(c: str) -> Column:
    """Distinct pairs of neighbouring letters of a name with its words sorted."""
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - 1, F.lit(1))), lambda i: F.substring(c, i, F.lit(2))))


def register_match(names: DataFrame, name: str, register: DataFrame, entry: str, cutoff: float = NAME_RATIO) -> DataFrame:
    """(name, licensed): names equal to a register entry after normalising, or with a token-sort ratio of the cutoff.

    The fuzzy step is exact. A ratio of the cutoff leaves at most d = (1 - cutoff/100) * (both lengths) insertions and
    deletions, and each of them removes at most two letter pairs; so of two such names, the 2d + 1 rarest letter pairs of
    each hold the rarest one they share (prefix filter). Names of so few pairs that they might share none meet by a mark.
    Candidates must pass the length bound and the built-in edit distance, which is never above d, before they are aligned."""
    n = names.select(F.col(name).alias("name")).distinct().select("name", tx.company_key(F.col("name")).alias("key"))
    e = register.select(tx.company_key(F.col(entry)).alias("key")).where("key <> ''").distinct()
    exact = n.where("key <> ''").join(e, "key", "left_semi").select("name")
    by_words = F.array_join(F.array_sort(F.filter(F.split("key", " "), lambda w: w != "")), " ")
    rest = n.where("key <> ''").join(e, "key", "left_anti").select(by_words.alias("k")).distinct()
    entries = e.select(by_words.alias("k")).distinct()
    slack = 1 - cutoff / 100
    # most edits with any partner that the length bound admits
    edits = F.floor(F.length("k") * F.lit(slack * (1 + (1 + slack) / (1 - slack))))
    both = rest.select("k", F.lit(True).alias("mine")).unionByName(entries.select("k", F.lit(False).alias("mine"))).select("k", "mine", edits.alias("d"), _grams("k").alias("gs"))
    pairs = both.select("k", "mine", "d", F.size("gs").alias("size"), F.explode("gs").alias("g"))
    often = pairs.groupBy("g").agg(F.count(F.lit(1)).alias("df"))
    ranked = pairs.join(often, "g").groupBy("k", "mine", "d", "size").agg(F.array_sort(F.collect_list(F.struct("df", "g"))).alias("r"))
    keys = F.concat(F.transform(F.slice("r", F.lit(1), (2 * F.col("d") + 1).cast("int")), lambda x: x["g"]), F.when(F.col("size") <= 4 * F.col("d"), F.array(F.lit("few"))).otherwise(F.array().cast("array<string>")))
    posted = ranked.select("k", "mine", F.explode(keys).alias("g"))
    most = slack * (F.length("k") + F.length("r"))
    met = posted.where("mine").select("k", "g").join(posted.where("not mine").select(F.col("k").alias("r"), "g"), "g").where((F.abs(F.length("k") - F.length("r")) <= most) & (F.levenshtein("k", "r") <= most)).select("k", "r").distinct()
    close = token_sort_ratio(met, "k", "r").where(F.col("ratio") >= cutoff).select("k").distinct()
    fuzzy = n.where("key <> ''").withColumn("k", by_words).join(close, "k", "left_semi").select("name")
    hit = exact.union(fuzzy).distinct().withColumn("hit", F.lit(True))
    return n.select("name").join(hit, "name", "left").select("name", F.coalesce("hit", F.lit(False)).alias("licensed"))
