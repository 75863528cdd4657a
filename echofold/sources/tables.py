"""Tables as sources of candidate regions: documents by word shingles or line windows, pages by tags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: White space that every regular-expression dialect agrees on.
BLANK = r"[ \t\n\f\r]+"


def spread(df: DataFrame) -> DataFrame:
    """df in at least as many partitions as cores: a table of one file is one task otherwise."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def once(value: Column) -> Column:
    """value as a generated column: projections aren't collapsed across it, so it is evaluated once a row."""
    return F.explode(F.array(value))


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), BLANK), lambda w: w != "")


def shingles(tokens: Column, size: int) -> Column:
    """Runs of size tokens, joined by a space; none from fewer tokens.

    Built from shifted copies of the array: a lambda that indexed tokens would evaluate the whole array,
    text and all, for each of its elements once projections are collapsed.
    """
    runs = tokens
    for shift in range(1, size):
        runs = F.zip_with(runs, F.slice(tokens, shift + 1, F.greatest(F.size(tokens), F.lit(1))), lambda a, b: F.concat(a, F.lit(" "), b))
    return F.filter(runs, lambda run: run.isNotNull())


def fingerprint_set(tokens: Column) -> Column:
    """The sorted distinct hashes of tokens."""
    return F.array_sort(F.array_distinct(F.transform(tokens, lambda t: F.xxhash64(t))))


def document_entries(documents: DataFrame, size: int = 3) -> DataFrame:
    """One entry a document: its word shingles. nodes counts shingles with repeats, lines are the text's."""
    given = spread(documents.select("doc_id", "text"))
    held = given.select("doc_id", F.size(F.split("text", "\n")).alias("lines"), once(words(F.col("text"))).alias("words"))
    runs = held.select("doc_id", "lines", once(shingles(F.col("words"), size)).alias("runs")).where("size(runs) > 0")
    return runs.select(
        F.col("doc_id").alias("entry_id"),
        F.col("doc_id").cast("string").alias("file"),
        F.lit(1).alias("start_line"),
        F.col("lines").alias("end_line"),
        F.size("runs").alias("nodes"),
        once(fingerprint_set(F.col("runs"))).alias("fingerprints"),
    )


def window_entries(documents: DataFrame, lines: int = 4, size: int = 3) -> DataFrame:
    """One entry for each run of lines in a document: its word shingles.

    An id is the document's times 2^31, more than an array can have lines, plus the place; ids from 2^32 on raise.
    """
    cut = spread(documents.select("doc_id", "text")).select("doc_id", once(F.split("text", "\n")).alias("all")).where(F.size("all") >= lines)
    # The text of each window is built from shifted copies of the array, so a row carries its own lines only.
    joined = F.col("all")
    for shift in range(1, lines):
        joined = F.zip_with(joined, F.slice("all", shift + 1, F.size("all")), lambda a, b: F.concat(a, F.lit("\n"), b))
    windows = cut.select("doc_id", F.posexplode(F.slice(joined, F.lit(1), F.size("all") - lines + 1)).alias("at", "lines")).select("doc_id", "at", once(words(F.col("lines"))).alias("words"))
    runs = windows.select("doc_id", "at", once(shingles(F.col("words"), size)).alias("runs")).where("size(runs) > 0")
    return runs.select(
        (F.col("doc_id") * F.lit(1 << 31) + F.col("at")).alias("entry_id"),
        F.col("doc_id").cast("string").alias("file"),
        (F.col("at") + 1).alias("start_line"),
        (F.col("at") + lines).alias("end_line"),
        F.size("runs").alias("nodes"),
        once(fingerprint_set(F.col("runs"))).alias("fingerprints"),
    )


def page_entries(pages: DataFrame, size: int = 3) -> DataFrame:
    """One entry a page: runs of its tags, without attributes or text."""
    tags = F.transform(F.regexp_extract_all("html", F.lit("<(/?[a-zA-Z][a-zA-Z0-9]*)"), 1), lambda t: F.lower(t))
    held = spread(pages.select("page_id", "html")).select("page_id", once(F.coalesce(tags, F.array().cast("array<string>"))).alias("tags"))
    return held.select(
        F.col("page_id").alias("entry_id"),
        F.col("page_id").cast("string").alias("file"),
        F.lit(1).alias("start_line"),
        F.lit(1).alias("end_line"),
        F.size("tags").alias("nodes"),
        once(fingerprint_set(shingles(F.col("tags"), size))).alias("fingerprints"),
    ).where("size(fingerprints) > 0")
