"""Changed regions and the status they give to clusters.

Defined results: locations and regions with a null file or line touch nothing; repeated regions count once; without
locations there is no status and the gate passes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

REGION_SCHEMA = "file string, start bigint, end bigint, source string"


def touched(locations: DataFrame, regions: DataFrame) -> DataFrame:
    """The locations that share a line with a region of the same file, bounds included."""
    near = (
        (locations["file"] == regions["file"])
        & (regions["start"] <= locations["end_line"].cast("bigint"))
        & (locations["start_line"].cast("bigint") <= regions["end"])
    )
    return locations.join(regions, near, "left_semi")


def cluster_status(members: DataFrame, regions: DataFrame | None) -> DataFrame:
    """(cluster_id, status): new if any location is touched, else known; unscoped without regions."""
    all_of = members.select("cluster_id").distinct()
    if regions is None:
        return all_of.withColumn("status", F.lit("unscoped"))
    hit = touched(members, regions).select("cluster_id").distinct().withColumn("hit", F.lit(True))
    joined = all_of.join(hit, "cluster_id", "left")
    return joined.select("cluster_id", F.when(F.col("hit"), "new").otherwise("known").alias("status"))


def untracked(scanned: DataFrame, indexed: DataFrame) -> DataFrame:
    """Whole-file regions of the scanned files (file) that the index (file) lacks."""
    from echofold.sources.diff import WHOLE_FILE_END

    missing = scanned.select("file").distinct().join(indexed.select("file"), "file", "left_anti")
    return missing.select("file", F.lit(1).cast("bigint").alias("start"), F.lit(WHOLE_FILE_END).cast("bigint").alias("end"), F.lit("untracked").alias("source"))


def membership(listed: DataFrame, scanned: DataFrame) -> DataFrame:
    """(file, scanned): for each listed file whether it is among the scanned ones; a null name never is."""
    here = scanned.select(F.col("file").alias("here")).where("here is not null").distinct()
    named = listed.select("file").distinct()
    return named.join(here, named["file"] == here["here"], "left").select("file", F.col("here").isNotNull().alias("scanned"))


def gate_fails(status: DataFrame, scoped: bool) -> DataFrame:
    """(fails): whether the gate finds a new cluster, or without a scope any cluster."""
    failing = F.col("status") == "new" if scoped else F.lit(True)
    return status.agg(F.coalesce(F.max(failing), F.lit(False)).alias("fails"))
