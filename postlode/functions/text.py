"""Text functions as native column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The tokenizer's pattern for skill and ranking tokens.
TOKEN = r"\b[a-z][a-z0-9+#.\-]{1,}\b"
# What a register's names are compared without; what follows a trading mark stays.
COMPANY_SUFFIX = r"\b(limited|ltd|llp|plc|inc|incorporated|corp|corporation|t\s*/\s*a|trading\s+as)\b\.?"


def strip(c: Column) -> Column:
    """Trim all white space, not only blanks."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def tokens(c: Column) -> Column:
    """Lower-case tokens with repeats; + # . - may stand inside a token."""
    return F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(TOKEN), F.lit(0))


def words(c: Column) -> Column:
    """White-space separated words without empty ones."""
    return F.filter(F.split(F.lower(F.coalesce(c, F.lit(""))), r"\s+"), lambda w: w != "")


def shingle_text(company: Column, description: Column, chars: int = 200) -> Column:
    """Company and the head of the description, lower case, other signs as blanks, squeezed."""
    text = F.concat(F.coalesce(company, F.lit("")), F.lit(" "), F.substring(F.coalesce(description, F.lit("")), 1, chars))
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(text), r"[^a-z0-9\s]", " "), r"\s+", " "))


def word_shingles(c: Column, k: int = 4) -> Column:
    """Distinct k-word shingles of a squeezed text; the whole text if shorter, none if empty."""
    return shingles_of(F.when(c == "", F.array().cast("array<string>")).otherwise(F.split(c, " ")), k)


def shingles_of(w: Column, k: int = 4) -> Column:
    """Distinct k-word shingles of an array of words. Give it a column: an expression would be evaluated many times."""
    n = F.size(w)
    # the words side by side with themselves shifted
    rows = F.arrays_zip(*[F.slice(w, F.lit(i + 1), F.greatest(n - k + 1, F.lit(0))).alias(f"w{i}") for i in range(k)])
    many = F.array_distinct(F.transform(rows, lambda z: F.concat_ws(" ", *[z[f"w{i}"] for i in range(k)])))
    return F.when(n == 0, F.array().cast("array<string>")).when(n < k, F.array(F.array_join(w, " "))).otherwise(many)


def strip_html(c: Column) -> Column:
    """Tags as blanks and squeezed, only where there are any."""
    return F.when(c.contains("<"), F.trim(F.regexp_replace(F.regexp_replace(c, r"<[^>]*>", " "), r"\s+", " "))).otherwise(c)


def title_of_slug(c: Column) -> Column:
    return F.initcap(F.regexp_replace(c, "[-_]+", " "))


def company_key(c: Column) -> Column:
    """Company name without legal forms, trading marks and punctuation, for comparison with a register."""
    x = F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), COMPANY_SUFFIX, " ")
    return F.trim(F.regexp_replace(F.regexp_replace(x, r"[^a-z0-9\s]", " "), r"\s+", " "))


def sheet_safe(c: Column) -> Column:
    """A leading = + - @ would be read as a formula by a spreadsheet."""
    return F.when(F.substring(c, 1, 1).isin("=", "+", "-", "@"), F.concat(F.lit("'"), c)).otherwise(c)


def dedup_hash(title: Column, company: Column, location: Column) -> Column:
    part = lambda c: strip(F.lower(F.coalesce(c, F.lit(""))))
    return F.substring(F.sha2(F.concat_ws("|", part(title), part(company), part(location)), 256), 1, 16)
