"""Text cut off by field limits or in transfer: which texts stop before their end, and how often each source cuts.

Lengths. The discrete hazard of a length is the share of a source's distinct texts that end at it among those that reach
it. Window functions set it against the hazard around it (the ends there over the lengths lived through there): a length
is significant if its ends exceed what the neighbours' hazard makes of its texts at risk by an exact (Chernoff) bound of
the Poisson tail, with the false discovery rate of each source's lengths held at Q (Benjamini-Hochberg). A significant
length is a field limit if most of its texts have an incomplete ending; others are lengths of stubs.

Endings. A text is a row of units (sentences or lines), each closed by a stop, by an ellipsis or by nothing. How an
opening (first two words) is normally closed is counted over all units of all texts, so "Apply now" or a list item is
known to end without a stop, "Tools we like: ... and more..." with an ellipsis, and a sentence with a stop. The last
unit is incomplete if it is closed otherwise than its opening is, or breaks off inside a word, tag or entity. Equal texts
count once, and a text is judged by the others, so that copies of a cut text don't confirm its end.

A text is cut off in one of two ways, told by `kind`:
* limit: its length is a field limit, and it ends without a stop. That is more than the ending alone would say: a list
  item or a short line is a usual end elsewhere, but not where the hazard says that texts are cut;
* transfer: its ending is incomplete at any other length.
A text that ends with a stop at a field limit stays complete: other texts end there too. All counts are aggregates with
partial sums; texts are not shuffled, only the opening, closing and last word of their units; the last unit of each goes on.

Defined cases: NULL, blank and letterless descriptions are no case; a NULL source is a source of its own; repeated rows
of one id give one row; NULL ids give none; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postlode.session import cut as cut_lineage

NEIGHBOURS = 25
Q = 0.001
SHARE = 0.1
# Marks that only a cut leaves.
MARK = r"(?i)(\[\s*(\.{2,}|…)?\s*\]?|\[\s*(con|more|read|trunc|\+)[^\]\s]*\s*\]?|\(\s*(more|cont)[a-z.]*\)?|read more|&[a-z#0-9]{0,8}|<(/?[a-z!][^<>]*)?)$"
# A tag that is opened and not closed.
OPEN_TAG = r"(?i)^/?(a|p|b|i|u|em|br|li|ul|ol|hr|tr|td|th|div|img|pre|span|code|table|strong|section|h[1-6])\b[^>]*$"
# Signs that may follow the last word of a unit.
TRAIL = " .…!?,;:)]\"'”’"


def units(text: Column) -> Column:
    """Sentences and lines of a text, the empty ones left out; tags of blocks end a line."""
    blocks = F.regexp_replace(text, r"(?i)</?(p|li|br|ul|ol|div|h[1-6]|tr|td|table)\b[^<>]*>", "\n")
    plain = F.when(F.contains(text, F.lit("<")), F.regexp_replace(blocks, r"<[^<>]*>", " ")).otherwise(text)
    return F.filter(F.split(plain, r"(?<=[.!?])\s+|\n"), lambda u: F.length(F.trim(u)) > 0)


def _once(df: DataFrame, name: str, c: Column) -> DataFrame:
    """df with a column that is evaluated once a row, however often it is used: projections are not merged across."""
    return df.select("*", F.explode(F.array(c)).alias(name))


def _opening(unit: Column) -> Column:
    """First two words, digits as #, without an ellipsis after them."""
    two = F.substring_index(F.translate(F.lower(F.trim(unit)), "0123456789", "##########"), " ", 2)
    return F.when(F.right(two, F.lit(1)).isin("…") | (F.right(two, F.lit(2)) == ".."), F.rtrim(two, F.lit(" .…"))).otherwise(two)


def _last_word(unit: Column) -> Column:
    return F.lower(F.substring_index(F.rtrim(unit, F.lit(TRAIL)), " ", -1))


def _closing(unit: Column) -> Column:
    u = F.rtrim(unit)
    end = F.right(u, F.lit(1))
    bare = F.right(F.rtrim(u, F.lit("\"'”’)")), F.lit(1))
    dots = (end == "…") | (F.right(u, F.lit(2)) == "..")
    return F.when(dots, "ellipsis").when(bare.isin(".", "!", "?") | end.isin(")", "”", '"'), "stop").otherwise("none")


def significant_lengths(df: DataFrame, text: str, source: str, q: float = Q) -> DataFrame:
    """(source, length, n, at_risk, expected, log_p): lengths whose hazard far exceeds the hazard around them."""
    once = df.where(F.col(text).isNotNull() & (F.col(text) != "")).select(F.col(source).alias("source"), F.length(text).alias("length"), F.xxhash64(text).alias("h")).distinct()
    per = once.groupBy("source", "length").agg(F.count(F.lit(1)).alias("n"))
    by_length = Window.partitionBy("source").orderBy("length")
    near = by_length.rangeBetween(-NEIGHBOURS, NEIGHBOURS)
    per = per.withColumns({"at_risk": F.sum("n").over(Window.partitionBy("source").orderBy(F.desc("length"))), "gap": F.least(F.coalesce(F.col("length") - F.lag("length").over(by_length), F.lit(1)), F.lit(2 * NEIGHBOURS))})
    per = per.withColumns({"hazard": F.col("n") / F.col("at_risk"), "lived": F.col("gap") * F.col("at_risk")})
    per = per.withColumns({"ends_around": F.sum("n").over(near) - F.col("n"), "lived_around": F.sum("lived").over(near) - F.col("at_risk"), "median": F.percentile("hazard", F.lit(0.5)).over(near)})
    # one very common length must not hide another close to it: the hazard around is capped by the median of those around
    around = F.least(F.col("ends_around") / F.greatest("lived_around", F.lit(1)), F.col("median"))
    per = per.withColumn("expected", F.greatest(around * F.col("at_risk"), F.lit(0.5)))
    log_p = F.when(F.col("n") > F.col("expected"), -(F.col("n") * F.ln(F.col("n") / F.col("expected")) - F.col("n") + F.col("expected"))).otherwise(0.0)
    per = per.withColumn("log_p", log_p)
    whole = Window.partitionBy("source")
    per = per.withColumns({"rank": F.row_number().over(whole.orderBy("log_p")), "tests": F.count(F.lit(1)).over(whole)})
    per = per.withColumn("cut", F.max(F.when(F.col("log_p") <= F.ln(F.lit(q) * F.col("rank") / F.col("tests")), F.col("rank"))).over(whole))
    return per.where("rank <= cut").select("source", "length", "n", "at_risk", "expected", "log_p")


def endings(df: DataFrame, ids: str, text: str, source: str) -> DataFrame:
    """(id, source, length, cut, kind): every text with letters, whether it is cut off, and how (limit or transfer)."""
    base = df.where(F.col(ids).isNotNull() & F.col(text).rlike(r"\w")).select(F.col(ids).alias("id"), F.col(source).alias("source"), F.col(text).alias("_t"))
    base = _once(base, "_n", units(F.col("_t")))
    parts = F.transform("_n", lambda u: F.struct(_opening(u).alias("opening"), _closing(u).alias("closing"), _last_word(u).alias("last")))
    # equal texts count once, and every text once for each of its ways to open and close a unit; a text of a single unit
    # counts once for each source, as a stub that several sources have is no cut
    kinds = _once(base.select(F.xxhash64("_t").alias("h"), F.length("_t").alias("length"), "source", "_n"), "p", parts).where("size(p) > 0")
    texts = kinds.groupBy("h", "length", F.when(F.size("p") == 1, F.col("source"))).agg(F.first("p").alias("p"))
    every = texts.select(F.explode(F.array_distinct(F.concat(F.transform("p", lambda x: x.withField("end", F.lit(False))), F.array(F.element_at("p", -1).withField("end", F.lit(True)))))).alias("u")).select("u.*")
    counted = cut_lineage(every.groupBy("opening", "closing", "last", "end").agg(F.count(F.lit(1)).alias("n")))
    ends, counted = counted.where("end and closing = 'none'"), counted.where("not end")
    of = lambda c: F.sum(F.when(F.col("closing") == c, F.col("n")).otherwise(0))
    by_opening = counted.groupBy("opening").agg(F.sum("n").alias("all"), of("none").alias("none"), of("ellipsis").alias("ellipsis"))
    by_first = counted.groupBy(F.substring_index("opening", " ", 1).alias("first")).agg(F.sum("n").alias("all1"), of("none").alias("none1"))
    by_last = counted.where("closing = 'stop'").groupBy("last").agg(F.sum("n").alias("stopped"))
    # known cuts: ends of texts without a stop where the opening has one
    by_end = ends.join(by_opening, "opening").where(F.col("none") < 0.5 * F.col("all")).groupBy("last").agg(F.sum("n").alias("cuts"))
    by_pair = counted.where("closing = 'none'").groupBy("opening", "last").agg(F.sum("n").alias("alike"))
    # what a short unit may be the beginning of: the most frequent longer opening
    stems = by_opening.where("length(opening) between 2 and 40").select(F.explode(F.transform(F.sequence(F.lit(1), F.length("opening") - 1), lambda i: F.substring("opening", F.lit(1), i))).alias("opening"), F.col("all").alias("longer"))
    by_stem = stems.groupBy("opening").agg(F.max("longer").alias("longer"))
    after_tag = F.substring_index("_t", "<", -1)
    open_tag = F.contains("_t", F.lit("<")) & after_tag.rlike(OPEN_TAG)
    tail = base.select("id", "source", F.length("_t").alias("length"), F.rtrim(F.right("_t", F.lit(40))).alias("_e"), open_tag.alias("_open"), "_n")
    tail = tail.select("id", "source", "length", "_e", "_open", "_n", F.try_element_at("_n", F.lit(-1)).alias("_u"), (F.size("_n") > 1).alias("more")).where("_u is not null")
    tail = tail.select(
        "id", "source", "length", "more", "_n", (F.col("_open") | F.col("_e").rlike(MARK)).alias("mark"), _opening(F.col("_u")).alias("opening"), _closing(F.col("_u")).alias("closing"), _last_word(F.col("_u")).alias("last"),
        F.right(F.rtrim("_u"), F.lit(1)).isin(*",;:/&(£$[<–—-").alias("open_end"), (F.when(_closing(F.col("_u")) == "ellipsis", F.rtrim(F.lower(F.trim("_u")), F.lit(" .…"))).otherwise(F.lower(F.trim("_u"))) == _opening(F.col("_u"))).alias("short"), F.col("_e").rlike(r"(?i)</[a-z0-9]+>$").alias("closed"),
    )
    # a stop needs no counts; for the others, what the text itself has in the counts
    done = tail.where("closing = 'stop'").drop("_n").distinct()
    open_ = _once(tail.where("closing <> 'stop'"), "p", F.array_distinct(parts)).withColumn("first", F.substring_index("opening", " ", 1))
    same, same1 = F.filter("p", lambda x: x["opening"] == F.col("opening")), F.filter("p", lambda x: F.substring_index(x["opening"], " ", 1) == F.col("first"))
    closed_by = lambda xs, c: F.size(F.filter(xs, lambda x: x["closing"] == c))
    open_ = _once(_once(open_, "same", same), "same1", same1).select(
        *[c for c in tail.columns if c != "_n"], "first",
        F.size("same").alias("own_all"), closed_by("same", "none").alias("own_none"), closed_by("same", "ellipsis").alias("own_ellipsis"), F.size("same1").alias("own_all1"), closed_by("same1", "none").alias("own_none1"),
        F.size(F.filter("same", lambda x: (x["closing"] == "none") & (x["last"] == F.col("last")))).alias("own_alike"), F.size(F.filter("p", lambda x: (x["closing"] == "stop") & (x["last"] == F.col("last")))).alias("own_stopped"),
    ).distinct()
    seen = open_.join(by_opening, "opening", "left").join(by_pair, ["opening", "last"], "left").join(by_stem, "opening", "left").join(by_first, "first", "left").join(by_last, "last", "left").join(by_end, "last", "left")
    z = lambda c: F.coalesce(F.col(c), F.lit(0)) - F.col(f"own_{c}")
    # share of the opening's units without a stop; the fewer other texts have it, the more its first word's share counts
    bare1 = (z("none1") + 0.5) / (z("all1") + 1)
    bare_share, dots_share = (z("none") + bare1) / (z("all") + 1), z("ellipsis") / (z("all") + 1)
    # its last word ends sentences at least as often as cut ones, or is how units of this opening usually end
    usual_end = ((z("stopped") > 0) & (z("stopped") >= F.coalesce("cuts", F.lit(0)))) | ((z("alike") > 0) & (z("alike") >= SHARE * z("none")))
    begun = F.col("short") & F.col("more") & (F.coalesce("longer", F.lit(0)) >= 2 * F.coalesce("all", F.lit(0)))
    bare = F.when(begun, True).when(bare_share < 0.5, True).otherwise(~usual_end)
    dots = begun | ~(dots_share >= 0.5)
    judged = seen.select("id", "source", "length", F.when(F.col("closed"), False).otherwise(F.col("mark") | F.when(F.col("open_end"), True).when(F.col("closing") == "ellipsis", dots).otherwise(bare)).alias("cut"), (~F.col("closed")).alias("loose"))
    whole = cut_lineage(judged.unionByName(done.select("id", "source", "length", (F.col("mark") & ~F.col("closed")).alias("cut"), F.lit(False).alias("loose"))))
    lengths = significant_lengths(df.where(F.col(ids).isNotNull()), text, source).select(F.col("source").alias("s2"), F.col("length").alias("l2"))
    # significant lengths at which most texts are cut, and no others, are field limits
    here = F.col("source").eqNullSafe(F.col("s2")) & (F.col("length") == F.col("l2"))
    limits = whole.join(lengths, here).groupBy("s2", "l2").agg(F.avg(F.col("cut").cast("int")).alias("share")).where("share > 0.5").select("s2", "l2", F.lit(True).alias("limit"))
    told = whole.join(limits, here, "left").select("id", "source", "length", (F.col("cut") | (F.col("loose") & F.col("limit").isNotNull())).alias("cut"), F.col("limit").isNotNull().alias("limit"))
    one = told.groupBy("id").agg(F.first("source").alias("source"), F.max("length").alias("length"), F.max("cut").alias("cut"), F.max(F.col("cut") & F.col("limit")).alias("at_limit"))
    return one.select("id", "source", "length", "cut", F.when(F.col("at_limit"), "limit").when(F.col("cut"), "transfer").alias("kind"))


def by_source(judged: DataFrame) -> DataFrame:
    """(source, texts, cut_off, at_limits, share): how often each source truncates, and how much of it at field limits."""
    return judged.groupBy("source").agg(F.count(F.lit(1)).alias("texts"), F.count_if("cut").alias("cut_off"), F.count_if(F.col("kind") == "limit").alias("at_limits")).withColumn("share", F.col("cut_off") / F.col("texts"))
