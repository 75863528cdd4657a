"""Clusters of locations from matching edges.

Vertices are locations (file, start_line, end_line), not entries: entries of one location are one vertex,
whose nodes are the most that any matched entry there has. A cluster is a connected component; its score
range covers all its edges.

Defined results: entries with a null id or location are in no cluster; rows that repeat an entry count once; a
null number of nodes is less than any other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from echofold.operators.components import connected_components
from echofold.operators.ranking import ranked
from echofold.plans.staging import staged

LOCATION = ["file", "start_line", "end_line"]


def collated(file: Column) -> list[Column]:
    """Sort keys of file names as people read them, with the binary order for ties."""
    return [F.collate(file, "UNICODE"), file]


def cluster_members(entries: DataFrame, edges: DataFrame, min_locations: int = 2, driver_limit: int = 0) -> DataFrame:
    """(cluster_id, file, start_line, end_line, nodes, score_min, score_max, location_count), a row a location.

    cluster_id is the least entry_id of the component's locations. This form holds clusters of any size.
    """
    slim = entries.select("entry_id", "nodes", *LOCATION).dropna(subset=["entry_id", *LOCATION])
    spots = slim.groupBy(*LOCATION).agg(F.min("entry_id").alias("spot"))
    ends = edges.select(F.col("l").alias("entry_id")).unionByName(edges.select(F.col("r").alias("entry_id"))).distinct()
    matching = slim.join(ends, "entry_id", "left_semi").groupBy("entry_id", *LOCATION).agg(F.max("nodes").alias("nodes"))
    placed = staged(matching.join(spots, LOCATION), "placed")
    matched = placed.groupBy("spot", *LOCATION).agg(F.max("nodes").alias("nodes"))
    at = lambda end, name: placed.select(F.col("entry_id").alias(end), F.col("spot").alias(name))
    joined = staged(edges.join(at("l", "a"), "l").join(at("r", "b"), "r").select("a", "b", "score"), "spot-edges")
    groups = connected_components(joined, "a", "b", driver_limit=driver_limit)
    # An edge between entries of one location belongs to that location's component, if it has one.
    of_edge = joined.join(groups.withColumnsRenamed({"node": "a"}), "a", "left").withColumn("component", F.coalesce("component", "a"))
    ranges = of_edge.groupBy("component").agg(F.min("score").alias("score_min"), F.max("score").alias("score_max"))
    members = matched.join(groups.withColumnsRenamed({"node": "spot"}), "spot", "left").withColumn("component", F.coalesce("component", "spot"))
    counts = members.groupBy("component").agg(F.count(F.lit(1)).alias("location_count")).where(F.col("location_count") >= min_locations)
    found = members.join(counts, "component").join(ranges, "component")
    return found.select(F.col("component").alias("cluster_id"), *LOCATION, "nodes", "score_min", "score_max", "location_count")


def clusters(members: DataFrame) -> DataFrame:
    """(cluster_id, score, locations): one row a cluster, locations in report order; for report-sized results."""
    key = F.struct(*[c.alias(f"k{i}") for i, c in enumerate(collated(F.col("file")))], "start_line", "end_line", "nodes")
    listed = members.groupBy("cluster_id", "score_min", "score_max").agg(F.array_sort(F.collect_list(key)).alias("keys"))
    locations = F.transform("keys", lambda k: F.struct(k["k1"].alias("file"), k["start_line"].alias("start_line"), k["end_line"].alias("end_line"), k["nodes"].alias("nodes")))
    return listed.select("cluster_id", F.struct(F.col("score_min").alias("min"), F.col("score_max").alias("max")).alias("score"), locations.alias("locations"))


def report_order(found: DataFrame) -> DataFrame:
    """Clusters by highest score, then by first location."""
    first = F.col("locations")[0]
    return found.orderBy(F.desc("score.max"), *collated(first["file"]), first["start_line"], first["end_line"])


def numbered(members: DataFrame) -> DataFrame:
    """(rank, cluster_id, ...): each cluster with its 1-based place in the report order."""
    first = F.min(F.struct(*[c.alias(f"k{i}") for i, c in enumerate(collated(F.col("file")))], "start_line", "end_line"))
    heads = members.groupBy("cluster_id", "score_min", "score_max", "location_count").agg(first.alias("first"))
    flat = heads.select("cluster_id", "score_min", "score_max", "location_count", "first.*", (-F.col("score_max")).alias("falling"))
    placed = ranked(flat, [], ["falling", "k0", "k1", "start_line", "end_line"])
    return placed.select(F.col("k").alias("rank"), "cluster_id", "score_min", "score_max", "location_count", F.col("k1").alias("first_file"))
