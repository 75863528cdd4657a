"""Mixing sources to target weights by systematic sampling.

Sources take weights by their order and share a budget of words in proportion, none above a cap;
what a capped source can't take is shared again by weight until no source is above its cap. Each
source's documents are then laid out by size, every document expecting target / source size copies.
With the expected copies summed from the source's start and one random offset added, a document is
emitted once for each integer boundary that its stretch crosses. Laying out by size keeps the words
taken within about one document of the target.

The prefix sums are exact: copies are counted in units of 2^-31, and a document's place is its rank in
the order (source, size, id), found from a range partitioning, so that no source meets in one task.
The offset depends on the seed and the source's name alone; reruns agree.

Defined results: a null or empty text has size 0. A null source is a source of its own, last in order.
A source of no words has target 0 and takes no copy. Rows that are equal in the ranking columns share
their copies in any order, which changes no result. An empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from echofold.llm.common import join_by_key, unpack_rows, whole_rows
from echofold.operators.ranking import ranked
from echofold.plans.session import shuffle_partitions
from echofold.plans.staging import staged

#: Fixed values of the production mix.
WEIGHTS = (5, 2, 1)
SHARE = 1.5
CAP = 2.0
SEED = "mix-1"
UNIT_BITS = 31
UNIT = 1 << UNIT_BITS


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(sources: DataFrame, share: float = SHARE, weights: tuple[float, ...] = WEIGHTS, cap: float = CAP) -> DataFrame:
    """sources (no_source, source_key, n, source_size) with target, the excess of capped sources shared again.

    Sources reach their caps in the order of cap / weight. With caps and weights summed up in that order, each source
    gives the rate at which it would be the first one below its cap; the first that is, is right. The sums are made
    within ranges and over the ranges, so that no task sees all sources.
    """
    order = ["ratio", "no_source", "source_key"]
    table = ranked(sources, [], ["no_source", "source_key"])
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.col("k") - 1, F.lit(len(weights))) + 1).cast("int"))
    table = table.select("no_source", "source_key", "n", "source_size", weight.alias("weight"), (F.col("source_size") * F.lit(cap)).alias("most"))
    table = table.withColumn("ratio", F.col("most") / F.col("weight"))
    table = staged(table.repartitionByRange(shuffle_partitions(sources.sparkSession), *order).withColumn("part", F.spark_partition_id()), "sources")
    all_of = table.agg(F.sum("source_size").alias("size"), F.sum("weight").alias("weight")).first()
    budget = share * (all_of["size"] or 0)
    ahead = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    held = table.groupBy("part").agg(F.sum("most").alias("part_most"), F.sum("weight").alias("part_weight"))
    earlier = held.select("part", *[F.coalesce(F.sum(f"part_{c}").over(ahead), F.lit(0.0)).alias(f"ahead_{c}") for c in ("most", "weight")])
    within = Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    summed = lambda c: F.col(f"ahead_{c}") + F.coalesce(F.sum(c).over(within), F.lit(0.0))
    rate = (F.lit(budget) - summed("most")) / (F.lit(all_of["weight"] or 0.0) - summed("weight"))
    below = table.join(earlier, "part").select(*order, "weight", "most", rate.alias("rate")).where(F.col("rate") * F.col("weight") <= F.col("most"))
    first = below.agg(F.min(F.struct(*order, "rate")).alias("first")).first()["first"]
    # None is below its cap if the budget is more than all caps.
    rate = first["rate"] if first else float("inf")
    return table.select("no_source", "source_key", "n", "source_size", F.least(F.col("most"), F.col("weight") * F.lit(rate)).alias("target"))


def mix_plan(rows: DataFrame, share: float = SHARE, weights: tuple[float, ...] = WEIGHTS, cap: float = CAP, seed: str = SEED) -> DataFrame:
    """rows (doc_id, source, size, tie) with source_size, target, copies, taken."""
    keyed = rows.select("doc_id", F.col("source").isNull().alias("no_source"), F.coalesce("source", F.lit("")).alias("source_key"), "size", "tie")
    keyed = staged(keyed, "sizes")
    sources = keyed.groupBy("no_source", "source_key").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("source_size"))
    targets = source_targets(sources, share, weights, cap)
    total = keyed.count()
    name = F.concat(F.lit(seed + "|"), F.col("no_source").cast("string"), F.lit("|"), F.col("source_key"))
    offset = F.conv(F.substring(F.md5(name.cast("binary")), 1, 7), 16, 10).cast("long") * F.lit(UNIT >> 28)
    per_copy = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size") * F.lit(float(UNIT)))).otherwise(F.lit(0)).cast("long")
    facts = targets.select(F.struct("no_source", "source_key").alias("src"), "n", "source_size", "target", offset.alias("u"), per_copy.alias("step"))
    placed = staged(ranked(keyed, ["no_source", "source_key"], ["size", "doc_id", "tie"]).withColumn("src", F.struct("no_source", "source_key")), "ranks")
    found = join_by_key(placed.drop("no_source", "source_key"), facts, "src", "n", total)
    start = F.pmod(F.col("u") + F.pmod(F.col("k") - 1, F.lit(UNIT)) * F.pmod(F.col("step"), F.lit(UNIT)), F.lit(UNIT))
    copies = F.shiftright(start + F.col("step"), UNIT_BITS)
    return found.select(
        "doc_id", "tie", F.when(~F.col("src.no_source"), F.col("src.source_key")).alias("source"), "size", "source_size", "target",
        copies.alias("copies"), (copies * F.col("size")).alias("taken"),
    )


def mix(docs: DataFrame, **how) -> DataFrame:
    """For each row: doc_id, source, size, source_size, target, copies, taken."""
    rows = docs.select(docs["doc_id"].alias("doc_id"), docs["source"].cast("string").alias("source"), word_count(docs["text"]).alias("size"), F.lit(0).cast("long").alias("tie"))
    return mix_plan(rows, **how).drop("tie")


def mixed_documents(docs: DataFrame, **how) -> DataFrame:
    """The mix itself: each row of docs as many times as the mix takes it, all columns kept."""
    row, names = whole_rows(docs)
    given = docs.select(docs["doc_id"].alias("doc_id"), docs["source"].cast("string").alias("source"), word_count(docs["text"]).alias("size"), row)
    given = given.withColumn("tie", F.xxhash64("row_"))
    plan = mix_plan(given.drop("row_"), **how)
    shares = plan.groupBy("doc_id", "tie").agg(F.sum("copies").alias("copies"), F.count(F.lit(1)).alias("alike"))
    key = [F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id_"), F.col("tie").alias("tie_")]
    nth = F.row_number().over(Window.partitionBy("id_", "tie_").orderBy("id_"))
    left = given.select(*key, "row_").withColumn("nth", nth)
    both = left.join(shares.select(*key, "copies", "alike"), ["id_", "tie_"])
    own = F.floor(F.col("copies") / F.col("alike")) + (F.col("nth") <= F.col("copies") % F.col("alike")).cast("long")
    emitted = both.withColumn("own", own.cast("int")).where("own > 0").withColumn("copy", F.explode(F.array_repeat(F.lit(1), F.col("own"))))
    return unpack_rows(emitted, names)


ORACLE_SQL = """
WITH sized AS (
    SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size FROM documents
), sources AS (
    SELECT source, sum(size)::BIGINT AS source_size,
           [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS weight
    FROM sized GROUP BY source
), ordered AS (
    SELECT *, source_size * 2.0::DOUBLE AS most, 1.5::DOUBLE * sum(source_size) OVER () AS budget,
           row_number() OVER (ORDER BY source_size * 2.0::DOUBLE / weight, source) AS nth FROM sources
), filled AS (
    SELECT nth, coalesce(sum(most) OVER w, 0) AS capped, sum(weight) OVER () - coalesce(sum(weight) OVER w, 0) AS rest, most, weight, budget
    FROM ordered WINDOW w AS (ORDER BY nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), level AS (
    SELECT (budget - capped) / rest AS rate FROM filled WHERE (budget - capped) / rest * weight <= most ORDER BY nth LIMIT 1
), targets AS (
    SELECT source, source_size, least(most, weight * rate) AS target,
           ('0x' || substr(md5('mix-1|' || (source IS NULL)::VARCHAR || '|' || coalesce(source, '')), 1, 7))::BIGINT * 8 AS u
    FROM ordered, level
), placed AS (
    SELECT s.doc_id, s.size, t.source_size, t.target, t.source, t.u::HUGEINT AS u,
           CASE WHEN t.source_size > 0 THEN floor(t.target / t.source_size * 2147483648.0::DOUBLE) ELSE 0 END::HUGEINT AS step,
           row_number() OVER (PARTITION BY s.source ORDER BY s.size, s.doc_id)::HUGEINT AS k
    FROM sized s JOIN targets t ON t.source IS NOT DISTINCT FROM s.source
)
SELECT doc_id, source, size, source_size, target, copies, copies * size AS taken FROM (
    SELECT *, ((u + k * step) // 2147483648 - (u + (k - 1) * step) // 2147483648)::BIGINT AS copies FROM placed)
"""
