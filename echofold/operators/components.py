"""Connected components over an edge table.

Alternating large-star and small-star contractions: each half-round is one grouped minimum and
one equi-join, no neighbour list is ever gathered, and the edge set shrinks to one star for each
component. Rounds grow with the logarithm of the longest path.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from echofold.plans.staging import discard, staged


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _large_star(edges: DataFrame) -> DataFrame:
    near = _both_ways(edges)
    least = near.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return near.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def _round(edges: DataFrame) -> tuple[DataFrame, tuple]:
    """One round, written out, and a digest of its edges that the writing tasks sum up on their way."""
    seen = Observation()
    after = _small_star(_large_star(edges))
    digest = F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))
    found = staged(after.observe(seen, F.count(F.lit(1)).alias("n"), digest.alias("h")), "star")
    return found, (seen.get["n"], seen.get["h"])


def _union_find(pairs: list[tuple[int, int]]) -> dict[int, int]:
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        parent.setdefault(x, x)
        top = x
        while parent[top] != top:
            top = parent[top]
        while parent[x] != top:
            parent[x], x = top, parent[x]
        return top

    for a, b in pairs:
        ra, rb = root(a), root(b)
        if ra != rb:
            parent[max(ra, rb)] = min(ra, rb)
    return {x: root(x) for x in parent}


def connected_components(edges: DataFrame, src: str = "a", dst: str = "b", max_rounds: int = 60, driver_limit: int = 0) -> DataFrame:
    """(node, component) for every node that occurs in an edge between two different nodes.

    component is the smallest node reachable. Nulls and self-loops are ignored. Up to
    driver_limit edges may be resolved on the driver (0: never). Raises if max_rounds pass
    without a fixpoint.
    """
    now = edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).where("a is not null and b is not null and a <> b")
    if driver_limit:
        held = now.limit(driver_limit + 1).collect()
        if len(held) <= driver_limit:
            found = _union_find([(r["a"], r["b"]) for r in held])
            kind = now.schema["a"].dataType.simpleString()
            return edges.sparkSession.createDataFrame(list(found.items()), f"node {kind}, component {kind}")
    # The first round may read what is written out already.
    now = now if hasattr(edges, "staged_path") else staged(now, "edges")
    seen = None
    for _ in range(max_rounds):
        before = now
        now, digest = _round(before)
        discard(before)
        if digest == seen:
            break
        seen = digest
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    leaves = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return leaves.unionByName(leaves.select(F.col("component").alias("node"), "component").distinct())
