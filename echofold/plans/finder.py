"""The whole scan: files to entries, matches, clusters."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from echofold.functions.options import Options
from echofold.operators.clusters import cluster_members, clusters, report_order
from echofold.operators.similarity import matching_edges
from echofold.plans.staging import staged
from echofold.sources.listing import source_files
from echofold.sources.typescript import ScanError, listed_sources, source_entries

#: Up to so many edges, components are found on the driver: a source tree needs no cluster for them.
DRIVER_EDGES = 200_000


@dataclass
class ScanResult:
    """files: (file); entries, members: see operators; clusters: one row each, in no order, without status."""

    files: list[str]
    entries: DataFrame
    members: DataFrame
    clusters: DataFrame


def cluster_entries(entries: DataFrame, threshold: float, min_locations: int = 2, driver_limit: int = 0) -> DataFrame:
    """Cluster members of any entries; the path for tables, at any size."""
    held = staged(entries, "entries")
    edges = staged(matching_edges(held, threshold), "matches")
    return cluster_members(held, edges, min_locations, driver_limit)


def _unwrap(error: Exception) -> Exception:
    """The scanner's own error inside one that a Python worker raised."""
    for line in str(error).splitlines():
        name, found, message = line.partition(": ")
        if found and name.rpartition(".")[2] in ("ScanError", "FileNotFoundError", "PermissionError"):
            return ScanError(message)
    return error


def scan(spark: SparkSession, options: Options | dict | None = None, **more) -> ScanResult:
    """Read and match the files that options name. Errors in any file end the scan.

    Entries are written out before matching, so nothing is reported of a scan that fails.
    """
    options = Options.of(options, **more)
    files = source_files(options.paths, options.respect_gitignore)
    entries = source_entries(listed_sources(spark, files), options.min_lines, options.min_nodes)
    try:
        entries = staged(entries, "entries")
    except Exception as error:
        raise _unwrap(error) from None
    edges = staged(matching_edges(entries, options.threshold), "matches")
    members = cluster_members(entries, edges, options.min_locations, DRIVER_EDGES)
    return ScanResult(files, entries, members, clusters(members))


def find_clusters(spark: SparkSession, options: Options | dict | None = None, **more) -> DataFrame:
    """(score, locations) of each cluster in report order."""
    found = scan(spark, options, **more).clusters
    return report_order(found).select("score", "locations")


def find_clusters_in_table(sources: DataFrame, threshold: float = 0.82, min_lines: int = 4, min_nodes: int = 20, min_locations: int = 2) -> DataFrame:
    """Cluster members of a table of sources (file, text): the same scan for corpora of any size."""
    given = sources.select(F.lit(0).alias("ordinal"), "file", F.coalesce("text", F.lit("")).alias("text"), F.lit(None).cast("string").alias("path"))
    # Numbered within each file: file and number together are the id.
    entries = source_entries(given, min_lines, min_nodes).withColumn("entry_id", F.struct("file", F.col("entry_id").alias("nth")))
    return cluster_entries(entries, threshold, min_locations)
