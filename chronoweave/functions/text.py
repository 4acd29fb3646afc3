"""Text predicates, snippets, tokens and date patterns as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def found_at(text: Column, keyword: Column, case_sensitive: bool = False) -> Column:
    """1-based place of the keyword's first occurrence, 0 if none."""
    return F.position(keyword, text) if case_sensitive else F.position(F.lower(keyword), F.lower(text))


def snippet(text: Column, at: Column, length: Column, around: int) -> Column:
    """The match with `around` characters on each side; '...' where text was cut."""
    first = F.greatest(at - around, F.lit(1))
    last = F.least(at + length - 1 + around, F.length(text))
    return F.concat(F.when(first > 1, F.lit("...")).otherwise(F.lit("")), F.substring(text, first, last - first + 1), F.when(last < F.length(text), F.lit("...")).otherwise(F.lit("")))


def keyword_hits(df: DataFrame, text: str, keywords: list[str], around: int = 150, case_sensitive: bool = False, word: bool = False) -> DataFrame:
    """One row for each row and keyword it holds: keyword, kw_seq, at (1-based place of the first occurrence) and snippet; with `word` the
    keyword must stand alone, and its place is that of the first such occurrence.

    The keyword list is an array literal, exploded after one alternation test, so rows without any keyword are dropped in one pass.
    """
    pattern = "|".join(r"\Q" + k + r"\E" for k in keywords)
    flags = "" if case_sensitive else "(?iu)"
    some = F.col(text).rlike(flags + (rf"(?<!\w)(?:{pattern})(?!\w)" if word else pattern))
    table = F.array(*[F.struct(F.lit(i).alias("kw_seq"), F.lit(k).alias("keyword")) for i, k in enumerate(keywords)])
    each = df.where(some).select("*", F.explode(table).alias("_k")).select(*df.columns, "_k.kw_seq", "_k.keyword")
    place = found_at(F.col(text), F.col("keyword"), case_sensitive)
    if word:
        place = F.regexp_instr(F.col(text), F.concat(F.lit(flags + r"(?<!\w)\Q"), F.col("keyword"), F.lit(r"\E(?!\w)")))
    each = each.withColumn("at", place).where("at > 0")
    return each.withColumn("snippet", snippet(F.col(text), F.col("at"), F.length("keyword"), around))


def sentence_with(text: Column, keyword: str, longest: int = 200) -> Column:
    """The first sentence that holds the keyword, else the text's beginning."""
    sentences = F.filter(F.split(text, r"\.\s+"), lambda s: F.locate(keyword.lower(), F.lower(s)) > 0)
    return F.coalesce(F.get(sentences, 0), F.substring(text, 1, longest))


def truncated(text: Column, longest: int) -> Column:
    return F.when(F.length(text) > longest, F.concat(F.substring(text, 1, longest), F.lit("..."))).otherwise(text)


def tail(text: Column, n: int) -> Column:
    return F.right(text, F.lit(n))


def normalized(text: Column) -> Column:
    """Lower case; runs of anything but ASCII letters and digits become one space."""
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "))


def tokens(text: Column) -> Column:
    """Runs of ASCII letters and digits of the lower-cased text."""
    return F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9]+)"), F.lit(1))


def us_date(text: Column) -> Column:
    """The first M/D/YYYY as YYYY-MM-DD, without a calendar check; null if none."""
    part = lambda i: F.regexp_extract(text, r"(\d{1,2})/(\d{1,2})/(\d{4})", i)
    return F.when(part(3) != "", F.concat_ws("-", part(3), F.lpad(part(1), 2, "0"), F.lpad(part(2), 2, "0")))


def any_date(text: Column, formats: tuple[str, ...] = ("yyyy-MM-dd", "M/d/yyyy", "yyyy/M/d", "M-d-yyyy")) -> Column:
    """The text as a date by the first format that reads it."""
    return F.coalesce(*[F.try_to_date(F.trim(text), f) for f in formats])


def first_class(text: Column, classes: list[tuple[str, list[str]]], otherwise: str | None = None) -> Column:
    """The name of the first class of which the lower-cased text holds a keyword."""
    chain = None
    for name, keywords in classes:
        hit = F.lit(False)
        for k in keywords:
            hit = hit | F.lower(text).contains(k)
        chain = F.when(hit, F.lit(name)) if chain is None else chain.when(hit, F.lit(name))
    return chain.otherwise(F.lit(otherwise)) if otherwise is not None else chain


def labels_in(text: Column, labels: list[str], otherwise: str = "unspecified", sep: str = "/") -> Column:
    """All labels the lower-cased text holds, in list order."""
    held = F.filter(F.array(*map(F.lit, labels)), lambda x: F.position(x, F.lower(text)) > 0)
    return F.when(F.size(held) > 0, F.array_join(held, sep)).otherwise(F.lit(otherwise))


def chunks(df: DataFrame, text: str, size: int) -> DataFrame:
    """Fixed slices of the text: chunk_no from 0 and chunk; an empty text has none."""
    n = F.ceil(F.length(text) / F.lit(size)).cast("int")
    each = df.where(F.length(text) > 0).withColumn("chunk_no", F.explode(F.sequence(F.lit(0), n - 1)))
    return each.withColumn("chunk", F.substring(F.col(text), F.col("chunk_no") * size + 1, F.lit(size)))
