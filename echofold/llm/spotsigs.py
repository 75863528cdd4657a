"""Document fingerprints from SpotSigs.

A signature is a common word, the anchor, followed by the next CHAIN content words, which are the words
that aren't anchors. A text's fingerprint is the set of its signatures. Words that are
more than REACH words after the last anchor stand in for anchors, so that texts with few common words,
or in other languages, have signatures too; in a short text without anchors every word does. (Of 1,000 documents
at hand 40 have under 5 signatures without stand-ins and 20 with them, and the coefficient is half as far from
that of three-word shingles.) The string form of a fingerprint is the number of signatures and a 128-bit hash of the
sorted set.

Two fingerprints are alike if their Jaccard coefficient reaches ALIKE. Sets are partitioned by length, in steps
of 1 / ALIKE: alike ones lie in one partition or in neighbouring ones. Within those the coefficient is pruned:
signatures are looked up one by one until those missed leave it no chance.

The query compares each text with an edited form and with the next document. Documents are dealt into
ranges of ids whose boundaries are ids that occur, and each boundary's document is also sent to the range
above it, so that every document meets its next one after a single shuffle of the texts. Whether two are alike
is decided by partitions and pruning; the coefficients themselves are asked for whatever they are, and are
counted in full.

Defined results: a null text is empty; an empty text has no signature. Two empty sets are alike (1.0), an
empty and another are not (0.0). Rows of equal id follow each other by a hash of their text, null ids come
last in descending order. Ids that aren't numbers are ordered as strings. A single document is its own next one.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator
from math import ceil, floor, log

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from echofold.llm.common import RangeBuckets, bound_batches, give_back, join_by_key, map_batches, normal_text, slices
from echofold.operators.components import connected_components
from echofold.operators.similarity import distinct_sets, signature, similar_sets
from echofold.plans.session import ship_package, shuffle_partitions
from echofold.plans.staging import staged

CHAIN = 2
REACH = 6
ALIKE = 0.8
#: Anchors: fixed values, common words of English, German, French and Spanish.
ANCHORS = frozenset(
    """
    a an and are as at be by for from had has have he his in is it not of on or she that the their they this to was were which with you
    als auch auf aus bei das dem den der des die ein eine einen er es für im ist mit nach nicht sich sie und von vor war wird zu zum zur
    au aux avec ce ces dans de du elle en est et il je la le les leur mais ne nous ont ou par pas plus pour que qui sa se son sont sur un une vous
    al como con del el ella ellas ellos entre era esta este fue ha hay lo los las más muy no nos o para pero por si sin su sus también y ya
    """.encode().split()
)
_BLANKS = bytes(32 if b < 128 and not chr(b).isalnum() else b for b in range(256))


def signatures(text: str) -> set[int]:
    """64-bit hashes of the text's signatures."""
    words = text.lower().encode("utf-8", "replace").translate(_BLANKS).split()
    if not words:
        return {xxhash.xxh64_intdigest(text.encode("utf-8", "replace"))} if text else set()
    spots = [i for i, w in enumerate(words) if w in ANCHORS]
    content = [w for w in words if w not in ANCHORS] if spots else words
    chains = [b" ".join((words[i], *content[i - r : i - r + CHAIN])) for r, i in enumerate(spots)]
    # Beyond REACH words after an anchor, each word stands in for one.
    for r, (low, high) in enumerate(zip([-1, *spots], [*spots, len(words)])):
        if high - low > REACH + 1:
            chains += [b" ".join((words[i], *content[i - r + 1 : i - r + 1 + CHAIN])) for i in range(low + REACH + 1, high)]
    if not chains:
        chains = [b" ".join(words[i : i + 1 + CHAIN]) for i in range(len(words))]
    return set(map(xxhash.xxh64_intdigest, chains))


def fingerprint(found: set[int]) -> str:
    packed = b"".join(h.to_bytes(8, "big") for h in sorted(found))
    return f"{len(found)}-{xxhash.xxh3_128_hexdigest(packed)}"


def likeness(a: set[int], b: set[int]) -> float:
    """The Jaccard coefficient."""
    if not a or not b:
        return 1.0 if not a and not b else 0.0
    common = len(a & b)
    return common / (len(a) + len(b) - common)


def partition(length: int, least: float = ALIKE) -> int:
    """The partition of a set by its length; sets of a coefficient of least or more are at most one apart."""
    return floor(log(length) / -log(least) + 1e-9) if length else -2


def alike(a: set[int], b: set[int], least: float = ALIKE) -> bool:
    """Whether the coefficient reaches least: the partitions first, then signatures until it can't any more."""
    if least >= 1:
        return a == b
    if abs(partition(len(a), least) - partition(len(b), least)) > 1:
        return False
    few, many = sorted((a, b), key=len)
    if not few:
        return not many
    needed = max(1, ceil(least / (1 + least) * (len(a) + len(b)) - 1e-9))
    spare = len(few) - needed
    for one in few:
        if spare < 0:
            return False
        spare -= one not in many
    return spare >= 0


def edited(text: str, following: str) -> str:
    """The last half of the characters replaced by as many of the following text's first ones."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted so that the next document follows; those marked tail only follow others."""
    held = None
    for whole in batches:
        for batch in slices(whole):
            out: list[tuple] = []
            for bucket, tail, doc_id, text in zip(*(batch.column(n).to_pylist() for n in ("bucket", "tail", "doc_id", "text"))):
                if tail and held is None:
                    continue
                now = (bucket, doc_id, text, signatures(text))
                if held is not None:
                    if held[0] != bucket:
                        raise ValueError(f"range {held[0]} ends without the document after its last")
                    other = edited(held[2], text)
                    sigs = signatures(other)
                    out.append((held[1], len(held[2]), hashlib.sha256(other.encode("utf-8", "replace")).hexdigest(), fingerprint(held[3]), fingerprint(sigs), likeness(held[3], sigs), likeness(held[3], now[3]), alike(held[3], sigs), alike(held[3], now[3])))
                held = None if tail else now
            columns = list(zip(*out)) or [()] * 9
            types = [batch.schema.field("doc_id").type, pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.bool_(), pa.bool_()]
            names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "alike_edited", "alike_next"]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)
        give_back()
    if held is not None:
        raise ValueError(f"range {held[0]} ends without the document after its last")


def _ordered(doc_id: Column, kind: T.DataType) -> Column:
    """A key in the order of ids, null first."""
    if isinstance(kind, T.IntegralType):
        return F.coalesce(doc_id.cast("long"), F.lit(-(1 << 63)))
    return F.coalesce(F.concat(F.lit("1"), doc_id.cast("string")), F.lit("0"))


def compare_with_next(docs: DataFrame) -> DataFrame:
    """For each row: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, alike_edited, alike_next."""
    spark = docs.sparkSession
    ship_package(spark)
    bound_batches(spark)
    given = docs.select(docs["doc_id"].alias("doc_id"), _ordered(docs["doc_id"], docs.schema["doc_id"].dataType).alias("key"), normal_text(docs["text"]).alias("text"))
    given = given.withColumn("tie", F.xxhash64("text"))
    all_of = given.agg(F.count(F.lit(1)).alias("n"), F.max(F.struct("key", "tie")).alias("top")).first()
    last = (all_of["top"]["key"], all_of["top"]["tie"]) if all_of["top"] else None
    points = RangeBuckets.sample(given, "key", "tie", total=all_of["n"]).points

    # A range holds the keys above one point, up to and with the next; its greatest is thus known.
    @F.pandas_udf("array<struct<bucket:int,tail:boolean>>")
    def places(keys: pd.Series, ties: pd.Series) -> pd.Series:
        out = []
        for at in zip(keys, ties):
            b = bisect_left(points, at)
            own = [{"bucket": b, "tail": False}]
            if b < len(points) and points[b] == at:
                own.append({"bucket": b + 1, "tail": True})
            if at == last:
                own.append({"bucket": 0, "tail": True})
            out.append(own)
        return pd.Series(out)

    dealt = given.withColumn("place", F.explode(places("key", "tie"))).select("place.bucket", "place.tail", "key", "tie", "doc_id", "text")
    ordered = dealt.repartition(shuffle_partitions(spark), "bucket").sortWithinPartitions("bucket", "tail", F.desc("key"), F.desc("tie"))
    kind = given.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, alike_edited boolean, alike_next boolean"
    return ordered.select("bucket", "tail", "doc_id", "text").mapInArrow(_compared, schema)


def near_duplicate_classes(docs: DataFrame, threshold: float = 0.8) -> DataFrame:
    """For each row: doc_id, class_id, the smallest id among documents connected by likeness >= threshold.

    Sets are compared only within the lengths that the threshold allows, and only where they share one of
    their rarest signatures; the rest is pruned without loss. Equal sets are one set from the start. All
    texts without signatures are one class. A null id names a class only if the class has no other.
    """

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [sorted(h - (1 << 64) if h >> 63 else h for h in signatures(t)) for t in batch.column("text").to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, pa.list_(pa.int64()))], ["doc_id", "fingerprints"])

    given = docs.select(docs["doc_id"].alias("doc_id"), normal_text(docs["text"]).alias("text"))
    kind = given.schema["doc_id"].dataType.simpleString()
    sets_of = map_batches(given, work, f"doc_id {kind}, fingerprints array<bigint>")
    rows = staged(sets_of.withColumn("entry_id", signature(F.col("fingerprints"))).withColumn("file", F.lit("")), "signatures")
    groups = connected_components(similar_sets(staged(distinct_sets(rows), "sets"), threshold))
    members = rows.groupBy("entry_id").agg(F.min("doc_id").alias("least_id"), F.count(F.lit(1)).alias("alike"))
    labelled = members.join(groups.withColumnRenamed("node", "entry_id"), "entry_id", "left").withColumn("label", F.coalesce("component", "entry_id"))
    labelled = staged(labelled.select("entry_id", "least_id", "alike", "label"), "members")
    least = labelled.groupBy("label").agg(F.min("least_id").alias("class_id"), F.count(F.lit(1)).alias("size"))
    named = join_by_key(labelled.drop("least_id"), least, "label", "size", labelled.count()).select("entry_id", "alike", "class_id")
    return join_by_key(rows.select("doc_id", "entry_id"), named, "entry_id", "alike", rows.count()).select("doc_id", "class_id")
