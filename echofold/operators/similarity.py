"""Exact set-similarity self-join of candidate regions.

Entries are rows (entry_id, file, start_line, end_line, nodes, fingerprints), the last a sorted array of
distinct longs. Two entries match if the Jaccard coefficient of their sets reaches the threshold and they
don't overlap as regions of one file.

Defined results: an entry with a null id, file, line or set, or an empty set, matches nothing. Rows that repeat
an entry count once; different entries have different ids. Tables without rows have no edges and no clusters.

Plan. Entries of equal sets are collapsed first, so copies cost one row each and never a pair. Distinct
sets are joined on their prefix tokens: with tokens ordered by rarity, two sets of coefficient t or more
share one of the first n - ceil(t n) + 1 tokens of each. The size bound and the bound on what can be shared
from a token on are checked in the join, candidates are verified by their intersection. No step is approximate
and none forms a cross product. A token that very many sets share is a skewed key of an equi-join whose
output is dealt anew: adaptive execution cuts it into blocks on both sides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from echofold.plans.staging import staged

#: Slack on the two size bounds (never on the final test): 0.81 of 500 is 405, which binary doubles miss.
BOUND_SLACK = 1e-9


def prefix_length(size: Column, threshold: float) -> Column:
    """How many of a set's rarest tokens any match must share one of."""
    needed = F.ceil(size * F.lit(float(threshold)) - F.lit(BOUND_SLACK))
    return F.greatest(size - needed + 1, F.lit(0)).cast("int")


def within_size_window(a: Column, b: Column, threshold: float) -> Column:
    """Whether two set sizes leave the coefficient a chance."""
    return F.greatest(a, b) <= F.floor(F.least(a, b) / F.lit(float(threshold)) + F.lit(BOUND_SLACK))


def large_enough(entries: DataFrame, min_lines: int = 4, min_nodes: int = 20) -> DataFrame:
    """The candidates with at least so many lines and nodes."""
    return entries.where((F.col("nodes") >= min_nodes) & (F.col("end_line") - F.col("start_line") + 1 >= min_lines))


def signature(fingerprints: Column) -> Column:
    """128 bits that stand for a set."""
    return F.concat(F.hex(F.xxhash64(fingerprints)), F.lit("-"), F.hex(F.xxhash64(F.lit(1), F.reverse(fingerprints))))


def with_signature(entries: DataFrame) -> DataFrame:
    """Entries that can match, with their sets' signatures."""
    needed = [c for c in ("entry_id", "file", "start_line", "end_line") if c in entries.columns]
    return entries.where(F.size("fingerprints") > 0).dropna(subset=needed).withColumn("sig", signature(F.col("fingerprints")))


def distinct_sets(entries: DataFrame) -> DataFrame:
    """(sig, fingerprints, n, members, set_id, first, other): one row for each distinct set.

    set_id is its smallest entry_id, by which the set is known; first is the member of the smallest (file, entry_id), other that of
    the greatest.
    """
    member = F.struct("file", "entry_id")
    return with_signature(entries).groupBy("sig").agg(
        F.first("fingerprints").alias("fingerprints"),
        F.first(F.size("fingerprints")).alias("n"),
        F.count(F.lit(1)).alias("members"),
        F.min("entry_id").alias("set_id"),
        F.min(member).alias("first"),
        F.max(member).alias("other"),
    )


def token_frequency(sets: DataFrame) -> DataFrame:
    """(f, frequency): in how many of the sets each fingerprint occurs."""
    return sets.select(F.explode("fingerprints").alias("f")).groupBy("f").agg(F.count(F.lit(1)).alias("frequency"))


def prefix_tokens(sets: DataFrame, threshold: float) -> DataFrame:
    """(f, set_id, n, place): prefix tokens that occur in two sets or more, with their places in the set's order.

    A token of one set only comes first in the order by rarity and can't meet another: such tokens take up
    their places of the prefix by their number alone and are dropped before anything is sorted.
    """
    exploded = sets.select("set_id", "n", F.explode("fingerprints").alias("f"))
    shared = exploded.join(token_frequency(sets).where("frequency > 1"), "f")
    own = Window.partitionBy("set_id")
    alone = F.col("n") - F.count(F.lit(1)).over(own)
    placed = shared.withColumn("place", alone + F.row_number().over(own.orderBy("frequency", "f")))
    return placed.where(F.col("place") <= prefix_length(F.col("n"), threshold)).select("f", "set_id", "n", "place")


def enough_left(a_size: Column, a_place: Column, b_size: Column, b_place: Column, threshold: float) -> Column:
    """Whether a token can be the first that two sets share, by what follows it in both.

    The first shared token of any match passes; at a later one the match may fail, having been found already.
    """
    needed = F.ceil((a_size + b_size) * F.lit(threshold / (1 + threshold)) - F.lit(BOUND_SLACK))
    return F.least(a_size - a_place, b_size - b_place) + 1 >= needed


def jaccard(a: Column, b: Column) -> Column:
    common = F.size(F.array_intersect(a, b))
    return common.cast("double") / (F.size(a) + F.size(b) - common).cast("double")


def similar_sets(sets: DataFrame, threshold: float) -> DataFrame:
    """(a, b, score): ids of different sets with score >= threshold, each pair once."""
    tokens = staged(prefix_tokens(sets, threshold), "prefixes")
    side = lambda name: tokens.select("f", F.col("set_id").alias(name), F.col("n").alias(f"{name}n"), F.col("place").alias(f"{name}p"))
    an, ap, bn, bp = (F.col(c) for c in ("an", "ap", "bn", "bp"))
    close = (F.col("a") < F.col("b")) & within_size_window(an, bn, threshold) & enough_left(an, ap, bn, bp, threshold)
    candidates = side("a").join(side("b"), "f").where(close).select("a", "b").distinct()
    held = sets.select("set_id", "fingerprints")
    scored = candidates.join(held.withColumnsRenamed({"set_id": "a", "fingerprints": "fa"}), "a").join(held.withColumnsRenamed({"set_id": "b", "fingerprints": "fb"}), "b")
    return scored.select("a", "b", jaccard(F.col("fa"), F.col("fb")).alias("score")).where(F.col("score") >= F.lit(float(threshold)))


def _edge(l: Column, r: Column, score: Column) -> list[Column]:
    return [F.least(l, r).alias("l"), F.greatest(l, r).alias("r"), score.alias("score")]


def identical_edges(entries: DataFrame) -> DataFrame:
    """(l, r, score 1.0): a spanning forest of the non-overlapping pairs among entries of equal sets.

    Members in several files: those outside the first member's file are linked to it, those inside to a
    member elsewhere. All in one file: with e the member that ends first and s the one that starts last,
    whatever lies behind e is linked to e, whatever else lies before s to s; a member that does neither
    overlaps all others, since each of them ends behind e's end and starts before s's start.
    """
    own = with_signature(entries).select("sig", "entry_id", "file", "start_line", "end_line")
    groups = own.groupBy("sig").agg(
        F.count(F.lit(1)).alias("members"),
        F.min(F.struct("file", "entry_id")).alias("first"),
        F.max(F.struct("file", "entry_id")).alias("other"),
        F.min(F.struct("end_line", "entry_id")).alias("ends"),
        F.max(F.struct("start_line", "entry_id")).alias("starts"),
    )
    both = own.join(groups.where("members > 1"), "sig")
    elsewhere = F.when(F.col("file") != F.col("first.file"), F.col("first.entry_id")).otherwise(F.col("other.entry_id"))
    within = F.when(F.col("start_line") > F.col("ends.end_line"), F.col("ends.entry_id")).when(F.col("end_line") < F.col("starts.start_line"), F.col("starts.entry_id"))
    hub = F.when(F.col("first.file") != F.col("other.file"), elsewhere).otherwise(within)
    linked = both.withColumn("hub", hub).where("hub is not null and hub <> entry_id")
    return linked.select(*_edge(F.col("entry_id"), F.col("hub"), F.lit(1.0))).distinct()


def similar_edges(entries: DataFrame, sets: DataFrame, pairs: DataFrame) -> DataFrame:
    """(l, r, score): edges between members of different sets, enough to connect what all would connect.

    Sets with members in several files are connected inside, so one edge between two such sets does. A set
    within one file has each member linked to a member of the other set in another file; only two sets
    within the same file are paired member by member, where they don't overlap.
    """
    facts = sets.select("set_id", "sig", "first", "other", (F.col("first.file") != F.col("other.file")).alias("spread"))
    of = lambda side: facts.select(F.col("set_id").alias(side), F.struct("sig", "first", "other", "spread").alias(f"{side}_set"))
    known = pairs.join(of("a"), "a").join(of("b"), "b")
    away = lambda file, side: F.when(F.col(f"{side}_set.first.file") != file, F.col(f"{side}_set.first.entry_id")).otherwise(F.col(f"{side}_set.other.entry_id"))
    a_spread, b_spread = F.col("a_set.spread"), F.col("b_set.spread")
    one_file = ~a_spread & ~b_spread & (F.col("a_set.first.file") == F.col("b_set.first.file"))
    single = known.where(a_spread & b_spread).select(*_edge(F.col("a_set.first.entry_id"), away(F.col("a_set.first.file"), "b"), F.col("score")))
    own = with_signature(entries).select("sig", "entry_id", "file", "start_line", "end_line")
    # Every member of a one-file set against the other set, unless that lies in the same file.
    flat = known.where(~one_file)
    turned = flat.where(~a_spread).select(F.col("a_set.sig").alias("sig"), F.col("b_set").alias("to_set"), "score").unionByName(
        flat.where(~b_spread).select(F.col("b_set.sig").alias("sig"), F.col("a_set").alias("to_set"), "score")
    )
    reach = turned.join(own, "sig")
    linked = reach.select(*_edge(F.col("entry_id"), away(F.col("file"), "to"), F.col("score")))
    side = lambda name: own.select(F.col("sig").alias(name), F.struct("entry_id", "start_line", "end_line").alias(f"{name}_row"))
    meeting = known.where(one_file).select(F.col("a_set.sig").alias("a"), F.col("b_set.sig").alias("b"), "score").join(side("a"), "a").join(side("b"), "b")
    overlap = (F.col("a_row.start_line") <= F.col("b_row.end_line")) & (F.col("b_row.start_line") <= F.col("a_row.end_line"))
    inside = meeting.where(~overlap).select(*_edge(F.col("a_row.entry_id"), F.col("b_row.entry_id"), F.col("score")))
    return single.unionByName(linked).unionByName(inside).distinct()


def matching_edges(entries: DataFrame, threshold: float) -> DataFrame:
    """(l, r, score): edges whose components, score ranges and entries are those of all matching pairs."""
    sets = staged(distinct_sets(entries), "sets")
    pairs = staged(similar_sets(sets, threshold), "set-pairs")
    return identical_edges(entries).unionByName(similar_edges(entries, sets, pairs))
