"""SimHash fingerprints and near-duplicate groups of fingerprints at a small Hamming distance.

A fingerprint is eight positional bytes. Two that differ in at most BITS = 2 bits differ in at most two bytes,
so they share at least six positional bytes. An inverted index has a list of fingerprints for each position and
byte. A list of one byte holds 1/256 of the corpus, so a list of over LIST_MOST members isn't paired but refined
by a further position, and so on, up to six. Of the positions after those of a list only as many are skipped as
a pair may differ in: as the first six positions that a pair shares skip two at most, the pair is in one list at
least at every depth. (Depths at which even evenly spread fingerprints would fill the lists are left out.)

For the pairs of a list its positions count as shared. They are tallied for each pair over all its lists, bytes
at positions that no list of the pair has are compared, pairs of fewer shared bytes than the guaranteed six go,
and the rest are verified by their exact distance. A list of six positions can't grow beyond the 65,536 values
of the two bytes left. If it is long, each member looks up the words within reach in the list instead of meeting
every member, and what hangs together is linked to its least. No link is lost and no list is cut.

Equal fingerprints are one node from the start, so copies are never paired. Groups are the connected
components of the links, found by star contractions without gathering any of it on the driver.

Defined results: a text without words (null, empty, white space) has fingerprint zero and is linked
like any other; of fewer words than a shingle, the whole sequence is hashed. A null id never becomes a
component's id unless all ids of the component are null. Repeated rows give repeated results.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations, repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from echofold.llm.common import join_by_key, map_batches, normal_text, split_by, unpack_rows, whole_rows
from echofold.operators.components import connected_components
from echofold.plans.staging import discard, staged

SHINGLE = 3
SEED = 42
BITS = 2
BYTES = 8
LIST_MOST = 24


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


BYTE_MASKS = [_signed(0xFF << (8 * i)) for i in range(BYTES)]


def shingle_hashes(text: bytes, shingle: int = SHINGLE) -> np.ndarray:
    """The XXH64 of each shingle of a UTF-8 text, repeats included; of fewer words the sequence is one, of none there is none."""
    words = text.lower().split()
    if len(words) < shingle:
        words = [b" ".join(words)] if words else []
        return np.array([xxhash.xxh64_intdigest(w, SEED) for w in words], np.uint64)
    shingles = map(b" ".join, zip(*(words[i:] for i in range(shingle))))
    return np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), np.uint64, len(words) - shingle + 1)


def folded(hashes: np.ndarray) -> int:
    """The SimHash of hashes, unsigned: bits that are set in over half of them."""
    if not len(hashes):
        return 0
    ones = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """The SimHash of a UTF-8 text, unsigned."""
    return folded(shingle_hashes(text, shingle))


def fingerprints(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", tie: bool = False, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp) for each row, fp as a signed long; tie adds a hash of the text."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = np.fromiter((fingerprint(t, shingle) for t in batch.column("text").cast(pa.binary()).to_pylist()), np.uint64, batch.num_rows)
        columns = {n: batch.column(n) for n in names} | {"fp": pa.array(found.view(np.int64))}
        return pa.RecordBatch.from_pydict(columns)

    given = docs.select(docs[id_column].alias("doc_id"), normal_text(docs[text_column]).alias("text"))
    if tie:
        given = given.withColumn("tie", F.xxhash64("text"))
    names = [n for n in given.columns if n != "text"]
    return map_batches(given, work, given.select(*names, F.lit(0).cast("long").alias("fp")).schema)


def masks(depth: int, bits: int = BITS) -> list[int]:
    """The sets of depth positions, as bits of an int, that skip no more positions than a pair may differ in."""
    return [sum(1 << p for p in chosen) for chosen in combinations(range(BYTES), depth) if chosen[-1] + 1 - depth <= bits]


def _wide(mask: int) -> int:
    return _signed(sum(0xFF << (8 * p) for p in range(BYTES) if mask >> p & 1))


def _lists(depth: int, bits: int) -> Column:
    """The lists of a depth: their positions, the same as a mask of bits, and the positions of the list that they refine."""
    before = lambda mask: mask ^ (1 << (mask.bit_length() - 1))
    kinds = [F.struct(F.lit(m).alias("mask"), F.lit(_wide(m)).alias("wide"), F.lit(before(m)).alias("before")) for m in masks(depth, bits)]
    return F.array(*kinds)


def _entries(rows: DataFrame, lists: Column) -> DataFrame:
    """(fp, list): entries of the index; a list is known by its positions and their bytes."""
    each = rows.select("fp", F.explode(lists).alias("kind"))
    return each.select("fp", F.struct(F.col("kind.mask").alias("mask"), F.col("fp").bitwiseAND(F.col("kind.wide")).alias("bytes")).alias("list"))


def _paired(short: DataFrame) -> DataFrame:
    side = lambda name: short.select("list", F.col("fp").alias(name))
    return side("a").join(side("b"), "list").where("a < b").select("a", "b", F.col("list.mask").alias("mask"))


def tallied(pairs: DataFrame, least: int) -> DataFrame:
    """(a, b): pairs (a, b, mask) that share at least so many positional bytes."""
    found = pairs.groupBy("a", "b").agg(F.bit_or("mask").alias("seen"))
    difference = F.col("a").bitwiseXOR(F.col("b"))
    unseen = [((F.col("seen").bitwiseAND(F.lit(1 << p)) == 0) & (difference.bitwiseAND(F.lit(m)) == 0)).cast("int") for p, m in enumerate(BYTE_MASKS)]
    shared = reduce(lambda x, y: x + y, unseen, F.bit_count("seen"))
    return found.where(shared >= least).select("a", "b")


def _reach(mask: int, bits: int) -> np.ndarray:
    """The differences of at most bits bits outside the positions of mask, but for none."""
    free = [8 * p + i for p in range(BYTES) if not mask >> p & 1 for i in range(8)]
    return np.array([_signed(sum(1 << b for b in chosen)) for n in range(1, bits + 1) for chosen in combinations(free, n)], np.int64)


def _forest(members: np.ndarray, reach: np.ndarray) -> np.ndarray:
    """For each of the sorted members the place of one that it hangs together with; of each group the same, its least."""
    root = np.arange(len(members))
    edges = []
    for difference in reach:
        other = members ^ difference
        at = np.minimum(np.searchsorted(members, other), len(members) - 1)
        here = np.nonzero((members[at] == other) & (members < other))[0]
        edges.append(np.stack([here, at[here]]))
    a, b = np.concatenate(edges, axis=1)
    while True:
        before = root.copy()
        low = np.minimum(root[a], root[b])
        np.minimum.at(root, root[a], low)
        np.minimum.at(root, root[b], low)
        while (root[root] != root).any():
            root = root[root]
        if (root == before).all():
            return root


def _dense(full: DataFrame, bits: int) -> DataFrame:
    """(a, b): links that connect what lies within reach in lists of all guaranteed positions."""

    def link(rows: pd.DataFrame) -> pd.DataFrame:
        members = np.sort(rows["fp"].to_numpy(np.int64))
        root = _forest(members, _reach(int(rows["mask"].iloc[0]), bits))
        tied = root != np.arange(len(members))
        return pd.DataFrame({"a": members[root[tied]], "b": members[tied]})

    given = full.select(F.col("list.mask").alias("mask"), F.col("list.bytes").alias("bytes"), "fp")
    return given.groupBy("mask", "bytes").applyInPandas(link, "a long, b long")


def links(nodes: DataFrame, list_most: int = LIST_MOST, bits: int = BITS) -> DataFrame:
    """(a, b): links between different fingerprints that connect all at distance bits or less."""
    least, held = BYTES - bits, nodes.count()
    depth = next((d for d in range(1, least) if held <= list_most * 256**d), least)
    entries, pairs, dense = staged(_entries(nodes, _lists(depth, bits)), "entries"), [], None
    while True:
        lengths = staged(entries.groupBy("list").agg(F.count(F.lit(1)).alias("held")).where("held > 1"), "lengths")
        index = staged(join_by_key(entries, lengths, "list", "held", entries.count()), "lists")
        pairs.append(_paired(index.where(F.col("held") <= list_most)))
        long = index.where(F.col("held") > list_most)
        if depth == least:
            dense = _dense(long, bits)
        if depth == least or long.isEmpty():
            break
        depth += 1
        next_ = F.filter(_lists(depth, bits), lambda kind: kind["before"] == F.col("list.mask"))
        discard(entries)
        entries = staged(_entries(long, next_), "entries")
    near = tallied(reduce(DataFrame.unionByName, pairs), least)
    near = near.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= bits)
    return near if dense is None else near.unionByName(dense).distinct()


def labelled(found: DataFrame, list_most: int = LIST_MOST, near: DataFrame | None = None, bits: int = BITS) -> DataFrame:
    """found (doc_id, fp, ...) with label, the fingerprint that stands for the row's component.

    near gives links (a, b) between values of fp instead of those by distance.
    """
    nodes = staged(found.groupBy("fp").agg(F.count(F.lit(1)).alias("alike"), F.min("doc_id").alias("least_id")), "fingerprints")
    groups = connected_components(links(nodes, list_most, bits) if near is None else near)
    members = nodes.join(groups.select(F.col("node").alias("fp"), "component"), "fp", "left")
    members = staged(members.select("fp", "alike", "least_id", F.coalesce("component", "fp").alias("label")), "members")
    # A component may hold a third of all fingerprints: its least id is found by a pre-aggregated
    # minimum, and goes back to its members by a join that spreads heavy labels.
    least = members.groupBy("label").agg(F.min("least_id").alias("component_id"), F.count(F.lit(1)).alias("size"))
    named = join_by_key(members.drop("least_id"), least, "label", "size", members.count()).drop("size")
    return join_by_key(found, named, "fp", "alike", found.count()).drop("alike")


def near_duplicates(docs: DataFrame, list_most: int = LIST_MOST, shingle: int = SHINGLE, bits: int = BITS) -> DataFrame:
    """For each row: doc_id, fingerprint (16 hex digits), component_id (smallest id of the group)."""
    found = staged(fingerprints(docs, shingle=shingle), "simhash")
    named = labelled(found, list_most, bits=bits)
    return named.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, list_most: int = LIST_MOST, shingle: int = SHINGLE, bits: int = BITS) -> DataFrame:
    """The rows of docs that stand for their group: its smallest id, one row where ids repeat."""
    found = staged(fingerprints(docs, tie=True, shingle=shingle), "simhash")
    return representatives(docs, labelled(found, list_most, bits=bits))


def representatives(docs: DataFrame, named: DataFrame) -> DataFrame:
    """The row of smallest id of each label in named (doc_id, tie, label)."""
    key = lambda doc_id, tie: [F.coalesce(doc_id.cast("string"), F.lit("")).alias("id_"), tie.alias("tie_")]
    first = named.groupBy("label").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "tie")).alias("first"))
    stay = first.select(*key(F.col("first.doc_id"), F.col("first.tie")))
    held = named.select(*key(F.col("doc_id"), F.col("tie"))).groupBy("id_", "tie_").agg(F.count(F.lit(1)).alias("alike"))
    # Fewer rows go than stay, as a rule: those that surely neither go nor repeat stay where they are.
    gone = staged(held.join(stay, ["id_", "tie_"], "left_anti").select("id_", "tie_"), "gone")
    special = staged(gone.unionByName(held.where("alike > 1").select("id_", "tie_")), "special")
    row, names = whole_rows(docs)
    given = docs.select(*key(docs["doc_id"], F.xxhash64(normal_text(docs["text"]))), row)
    among, plain = split_by(given, special, "id_", "tie_")
    kept = among.join(gone, ["id_", "tie_"], "left_anti")
    # Of rows that are one text under one id a single one stays.
    nth = F.row_number().over(Window.partitionBy("id_", "tie_").orderBy(F.xxhash64("row_")))
    return unpack_rows(plain.select("row_").unionByName(kept.withColumn("nth", nth).where("nth = 1").select("row_")), names)
