"""TypeScript and JavaScript files as a source of candidate regions."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from echofold.functions.structure import candidates
from echofold.plans.session import ship_package, shuffle_partitions
from echofold.sources.script import ParseError, parse
from echofold.sources.script.tree import LineMap

ENTRY_SCHEMA = "entry_id bigint, file string, start_line int, end_line int, nodes int, fingerprints array<bigint>"
#: Entries of one file are numbered below this.
ENTRIES_PER_FILE = 1 << 24


class ScanError(ValueError):
    """A file that can't be read or parsed; it ends the whole scan."""


def allows_jsx(file: str) -> bool:
    return file.endswith((".js", ".jsx", ".tsx"))


def scan_text(file: str, text: str, min_lines: int, min_nodes: int) -> list[tuple[int, int, int, list[int]]]:
    text = text.removeprefix("\ufeff")
    try:
        tree = parse(text, allows_jsx(file))
    except ParseError as error:
        raise ScanError(f"Unable to parse {file}: {error} (line {LineMap(text).line(error.offset)})") from None
    return list(candidates(tree, text, min_lines, min_nodes))


def scan_file(file: str, min_lines: int, min_nodes: int, path: str | None = None) -> list[tuple[int, int, int, list[int]]]:
    with open(path or file, encoding="utf-8", errors="replace", newline="") as source:
        return scan_text(file, source.read(), min_lines, min_nodes)


def source_entries(sources: DataFrame, min_lines: int = 4, min_nodes: int = 20) -> DataFrame:
    """Entries of a table of sources (ordinal, file, text, path), parsed where its partitions lie.

    A null text is read from path, which then must be reachable from every executor.
    """
    ship_package(sources.sparkSession)

    def scan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for ordinal, file, text, path in zip(frame["ordinal"], frame["file"], frame["text"], frame["path"]):
                found = scan_file(file, min_lines, min_nodes, path) if text is None else scan_text(file, text, min_lines, min_nodes)
                rows += [(ordinal * ENTRIES_PER_FILE + i, file, *entry) for i, entry in enumerate(found)]
            yield pd.DataFrame(rows, columns=["entry_id", "file", "start_line", "end_line", "nodes", "fingerprints"])

    return sources.select(F.col("ordinal").cast("bigint").alias("ordinal"), "file", "text", "path").mapInPandas(scan, ENTRY_SCHEMA)


def listed_sources(spark: SparkSession, files: list[str]) -> DataFrame:
    """The sources table of files by path, spread over the cluster."""
    rows = spark.createDataFrame([(i, file, None, os.path.abspath(file)) for i, file in enumerate(files)], "ordinal bigint, file string, text string, path string")
    return rows.repartition(max(1, min(len(files), 4 * shuffle_partitions(spark))), "ordinal") if len(files) > 8 else rows
