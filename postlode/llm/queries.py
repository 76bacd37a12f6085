"""Registered queries of this subpackage; each takes (spark, sf_dir) and runs over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from postlode.llm import canonical as cn
from postlode.llm import garbled as gb
from postlode.llm import history as hs
from postlode.llm import leaks as lk
from postlode.llm import names as nm
from postlode.llm import near_duplicates as nd
from postlode.llm import packing as pk
from postlode.llm import percentiles as pc
from postlode.llm import truncation as tr
from postlode.session import cut
from postlode.tables import table

Query = Callable[[SparkSession, str], DataFrame]


AGREE = nd.Threshold(1, 2)


def _incoming(spark: SparkSession, sf_dir: str) -> tuple[hs.Store, DataFrame, DataFrame]:
    t = lambda n: table(spark, sf_dir, n)
    return hs.incoming_against_seen(t("raw_job"), t("seen_jobs"), t("incoming_job"), 3, AGREE, 25)


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _incoming(spark, sf_dir)[2].where("repeats is not null").select(F.col("id").alias("job_id"), F.col("repeats").alias("dedup_hash"))


def p1_seen_after(spark: SparkSession, sf_dir: str) -> DataFrame:
    """seen_jobs after all incoming batches: new hashes, raised counts and last dates."""
    store, batch, resolved = _incoming(spark, sf_dir)
    after = hs.update(store, batch, "id", "text", resolved, batch.select("id", F.col("scraped_at").alias("at")))
    return after.seen.select("dedup_hash", F.col("id").alias("job_id"), "first_seen_at", "last_seen_at", "times_seen")


def annual_pay() -> Column:
    """Mean of the annual bounds that are present."""
    return (F.coalesce("salary_annual_min", "salary_annual_max") + F.coalesce("salary_annual_max", "salary_annual_min")) / 2


def _wide(rows: DataFrame, name: str) -> DataFrame:
    at = lambda q: F.max(F.when(F.col("q") == q, F.round("value", 4)))
    return rows.groupBy(F.col("g").alias(name), "n").agg(at(0.25).alias("p25"), at(0.5).alias("p50"), at(0.75).alias("p75"), at(0.9).alias("p90"))


def p3_pay_by_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Annual pay of every slice: category, source and day."""
    slice_ = F.concat_ws("|", F.coalesce("role_category", F.lit("Other")), F.coalesce("source", F.lit("")), F.date_format("scraped_at", "yyyy-MM-dd"))
    return _wide(pc.percentiles(table(spark, sf_dir, "job_analytics"), slice_, annual_pay()), "slice")


def p3_salary_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _wide(pc.percentiles(table(spark, sf_dir, "raw_job"), F.col("source"), F.col("salary_min")), "source")


def p3_pay_by_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _wide(pc.percentiles(table(spark, sf_dir, "job_analytics"), F.coalesce("role_category", F.lit("Other")), annual_pay()), "category")


def p3_pay_by_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _wide(pc.percentiles(table(spark, sf_dir, "job_analytics"), F.date_format("scraped_at", "yyyy-MM-dd"), annual_pay()), "day")


def p3_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mergeable summaries of annual pay, one a category and day."""
    group = [F.coalesce("role_category", F.lit("Other")).alias("category"), F.to_date("scraped_at").alias("day")]
    return pc.summary(table(spark, sf_dir, "job_analytics"), group, annual_pay())


def p3_from_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentiles of annual pay per category read from the merged daily summaries, and whether each is within 1% of the
    exact value, which multi-select finds."""
    read = pc.read_summary(pc.merge(p3_summary(spark, sf_dir), ["category"]), ["category"], (0.25, 0.5, 0.75))
    x = table(spark, sf_dir, "job_analytics").select(F.coalesce("role_category", F.lit("Other")).alias("c"), annual_pay().alias("x"))
    near = pc.percentiles_by_rank(x, F.col("c"), F.col("x"), (0.25, 0.5, 0.75)).select(F.col("g").alias("category"), "q", F.col("value").alias("exact"))
    return read.join(near, ["category", "q"]).select("category", "n", "q", (F.abs(F.col("value") - F.col("exact")) <= pc.ALPHA * F.abs("exact") * 1.000001).alias("within"))


def p4_mapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda n: table(spark, sf_dir, n)
    return cn.map_postings(t("raw_job"), t("postcode_areas"), t("role_titles"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    other = p4_mapped(spark, sf_dir).where("key is not null and (entry is null or value <> entry)")
    return other.select(F.col("key").alias("job_id"), "field", F.coalesce("entry", F.lit("none")).alias("entry")).distinct()


def _companies(spark: SparkSession, sf_dir: str) -> list[tuple[DataFrame, str]]:
    return [(table(spark, sf_dir, t), "company") for t in ("raw_job", "incoming_job", "seen_jobs")]


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nm.variant_pairs(_companies(spark, sf_dir)).select(F.col("value_a").alias("company_a"), F.col("value_b").alias("company_b"))


def p5_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nm.entities(_companies(spark, sf_dir))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = nd.agreeing_pairs(table(spark, sf_dir, "raw_job"), "job_id", "description", k=3, num=1, den=2, least_words=25)
    return pairs.select(F.col("id_a").alias("job_id_a"), F.col("id_b").alias("job_id_b"))


def p6_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every posting with a usable description, the class of its text, and how many other classes agree with it."""
    members, links = nd.near_duplicates(table(spark, sf_dir, "raw_job"), "job_id", "description", k=3, num=1, den=2, least_words=25)
    links = cut(links)
    degree = links.select(F.col("fa").alias("fp")).union(links.select("fb")).groupBy("fp").agg(F.count(F.lit(1)).alias("links"))
    return members.join(degree, "fp", "left").select(F.col("id").alias("job_id"), F.lower(F.hex("fp")).alias("class_id"), F.coalesce("links", F.lit(0)).alias("links"))


def p7_endings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tr.endings(table(spark, sf_dir, "raw_job"), "job_id", "description", "source")


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p7_endings(spark, sf_dir).where("cut").select(F.col("id").alias("job_id"))


def p7_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tr.by_source(p7_endings(spark, sf_dir))


def p7_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tr.significant_lengths(table(spark, sf_dir, "raw_job"), "description", "source").select("source", "length", "n")


def _packed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    capacities = table(spark, sf_dir, "pack_capacity")
    rows = capacities.where("capacity_tokens > 0").select("capacity_id", "capacity_tokens").orderBy("capacity_id").limit(1001).collect()
    if len(rows) > 1000:
        raise ValueError("more than 1000 capacities")
    items = cut(pk.token_counts(table(spark, sf_dir, "documents")))
    return pk.pack(items, [(r[0], r[1]) for r in rows]), capacities


def p8_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _packed(spark, sf_dir)[0]


def p8_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed, capacities = _packed(spark, sf_dir)
    return pk.fill(cut(packed), capacities)


def _leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of eight words up to one word edit away."""
    return lk.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"), window=8, edits=1)


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _leaks(spark, sf_dir).where("distance = 0").select("doc_id", "item_id")


def p9_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of 16 words up to 2 word edits away, and whole items of 8 to 15 words in proportion."""
    return lk.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"), window=16, edits=2, least=8)


def p9_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lk.leaked_items(_leaks(spark, sf_dir).where("distance = 0")).select("item_id", "documents")


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gb.garbled(table(spark, sf_dir, "documents")).select("doc_id").distinct()


def p10_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gb.garbled(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Query] = {
    "p1_found": p1_found,
    "p1_seen_after": p1_seen_after,
    "p3_pay_by_slice": p3_pay_by_slice,
    "p3_salary_by_source": p3_salary_by_source,
    "p3_pay_by_category": p3_pay_by_category,
    "p3_pay_by_day": p3_pay_by_day,
    "p3_summary": p3_summary,
    "p3_from_summaries": p3_from_summaries,
    "p4_found": p4_found,
    "p4_mapped": p4_mapped,
    "p5_found": p5_found,
    "p5_entities": p5_entities,
    "p6_found": p6_found,
    "p6_classes": p6_classes,
    "p7_found": p7_found,
    "p7_sources": p7_sources,
    "p7_lengths": p7_lengths,
    "p8_packed": p8_packed,
    "p8_fill": p8_fill,
    "p9_found": p9_found,
    "p9_near": p9_near,
    "p9_items": p9_items,
    "p10_found": p10_found,
    "p10_restored": p10_restored,
}
