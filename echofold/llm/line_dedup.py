"""Dropping lines that many documents share.

Texts are exploded into lines; a line's key is the line stripped and lower-cased, kept as a 128-bit
hash. Distinct documents are counted for each hash, hashes over the threshold lose their lines in
all documents but the one of largest id, and what stays is put together again by position. Only
hashes and ids are shuffled for the counts; each text is moved once, to meet the hashes it loses.
A hash that a third of the documents hold is pre-aggregated before it is counted; hashes with a thousandth
of all entries or more are broadcast, so their documents never meet in one task. What a text loses is gathered
by its id and a hash of the text: a group is one text's lines, however many rows share an id.

Defined results: a null or empty text is one empty line. Rows of equal id count as one document and
each loses its lines of the same keys. A null id is an id of its own that is smaller than all others. A line whose key
repeats within the kept document stays each time. Other columns are passed through or not read.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from echofold.llm.common import ASCII_SPACE, join_by_key, map_batches, texts_of, unpack_rows, whole_rows
from echofold.plans.staging import staged

_SPACE = ASCII_SPACE.encode()


def line_key(line: bytes, min_chars: int) -> bytes | None:
    """The hash of a line's key, or None if the key is shorter than min_chars code points."""
    key = line.strip(_SPACE)
    if len(key) < min_chars or not key.isascii() and len(key.decode("utf-8", "replace")) < min_chars:
        return None
    return xxhash.xxh3_128_digest(key.lower())


def line_keys(docs: DataFrame, min_chars: int) -> DataFrame:
    """(doc_id, tie, key): the distinct keys of each row's text, tie being a hash of the text."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        at, keys = [], []
        for i, text in enumerate(texts_of(batch).cast(pa.binary()).to_pylist()):
            found = {k for line in text.split(b"\n") if len(line) >= min_chars and (k := line_key(line, min_chars))}
            at += [i] * len(found)
            keys += found
        rows = pa.array(at, pa.int32())
        return pa.RecordBatch.from_arrays([batch.column("doc_id").take(rows), batch.column("tie").take(rows), pa.array(keys, pa.binary())], ["doc_id", "tie", "key"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_batches(docs.select("doc_id", "tie", "text"), work, f"doc_id {kind}, tie long, key binary")


def lost_keys(pairs: DataFrame, min_docs: int) -> DataFrame:
    """(doc_id, tie, lost): the keys that each text loses."""
    by_doc = pairs.groupBy("key", "doc_id").agg(F.count(F.lit(1)).alias("rows"))
    shared = by_doc.groupBy("key").agg(F.sum("rows").alias("held"), F.count(F.lit(1)).alias("n"), F.max("doc_id").alias("keeper"))
    shared = staged(shared.where(F.col("n") >= min_docs).select("key", "held", "keeper"), "shared-lines")
    lost = join_by_key(pairs, shared, "key", "held", pairs.count()).where(~F.col("doc_id").eqNullSafe(F.col("keeper")))
    return lost.groupBy("doc_id", "tie").agg(F.collect_set("key").alias("lost"))


def drop_lines(docs: DataFrame, min_chars: int = 40, min_docs: int = 5, with_text: bool = False, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """For each row: doc_id, n_lines, n_dropped, kept_sha256; with_text adds kept (null where nothing is dropped) and row_ (all columns)."""
    row, _ = whole_rows(docs)
    tie = F.xxhash64(docs[text_column]).alias("tie")
    plain = docs.select(docs[id_column].alias("doc_id"), docs[text_column].alias("text"), tie)
    given = docs.select(docs[id_column].alias("doc_id"), row, tie) if with_text else plain
    pairs = staged(line_keys(plain, min_chars), "line-keys")
    lost = lost_keys(pairs, min_docs).select(F.col("doc_id").alias("lost_id"), F.col("tie").alias("lost_tie"), "lost")
    joined = given.join(lost, given["doc_id"].eqNullSafe(F.col("lost_id")) & (given["tie"] == F.col("lost_tie")), "left").drop("lost_id", "lost_tie", "tie")

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        n_lines, n_dropped, sha, kept = [], [], [], []
        for text, gone in zip(texts_of(batch).cast(pa.binary()).to_pylist(), batch.column("lost").to_pylist()):
            lines = text.split(b"\n")
            stay = lines
            if gone:
                gone = set(gone)
                stay = [line for line in lines if len(line) < min_chars or line_key(line, min_chars) not in gone]
            out = b"\n".join(stay)
            n_lines.append(len(lines))
            n_dropped.append(len(lines) - len(stay))
            sha.append(hashlib.sha256(out).hexdigest())
            if with_text:
                kept.append(out if len(stay) < len(lines) else None)
        columns = {"doc_id": batch.column("doc_id"), "n_lines": pa.array(n_lines, pa.int64()), "n_dropped": pa.array(n_dropped, pa.int64()), "kept_sha256": pa.array(sha, pa.string())}
        if with_text:
            columns |= {"kept": pa.array(kept, pa.binary()).cast(pa.string()), "row_": batch.column("row_")}
        return pa.RecordBatch.from_pydict(columns)

    schema = given.select("doc_id", F.lit(0).cast("long").alias("n_lines"), F.lit(0).cast("long").alias("n_dropped"), F.lit("").alias("kept_sha256"), *([F.lit(None).cast("string").alias("kept"), "row_"] if with_text else [])).schema
    return map_batches(joined, work, schema)


def dedup_documents(docs: DataFrame, min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """The same rows and columns with text cut to the kept lines, and n_chars, if there, to match."""
    found = drop_lines(docs, min_chars, min_docs, with_text=True)
    text = F.when(F.col("n_dropped") > 0, F.col("kept")).otherwise(F.col("row_.text"))
    replaced = {"text": text}
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        replaced["n_chars"] = F.when(F.col("n_dropped") > 0, F.length("kept").cast(kind)).otherwise(F.col("row_.n_chars"))
    return unpack_rows(found, docs.columns, **replaced)


_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ORACLE_SQL = f"""
WITH cut AS (
    SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents
), lines AS (
    SELECT doc_id, unnest(parts) AS line, generate_subscripts(parts, 1) AS pos FROM cut
), keyed AS (
    SELECT doc_id, pos, line,
           translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{_UPPER}', '{_UPPER.lower()}') AS key
    FROM lines
), shared AS (
    SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5
), marked AS (
    SELECT k.doc_id, k.pos, k.line, s.key IS NOT NULL AND k.doc_id <> s.keeper AS gone
    FROM keyed k LEFT JOIN shared s ON s.key = k.key
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
