"""The command line: scan, report, gate.

Exit codes: 0 without findings under the gate, 1 with findings under it, 2 for any error.
"""

from __future__ import annotations

import os
import sys
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from echofold.functions.options import Options
from echofold.functions.paths import canonical_path
from echofold.operators.clusters import report_order
from echofold.operators.regions import cluster_status
from echofold.plans.finder import ScanResult, scan
from echofold.plans.report import FORMATTERS, collect
from echofold.plans.session import local_session
from echofold.sources.diff import ChangedRegions, parse_unified_diff
from echofold.sources.git import GitProvider

USAGE = """Usage: python -m echofold [options] [paths...]

Finds structurally similar regions of TypeScript and JavaScript sources. Paths default to src.

Matching:
  --threshold N          least similarity, over 0 and up to 1 (default 0.82)
  --min-lines N          least lines of a region (default 4)
  --min-nodes N          least syntax nodes of a region (default 20)
  --min-locations N      least locations of a cluster (default 2)
  --no-gitignore         scan what .gitignore leaves out

Output:
  --format F             text, edn or json (default text)
  --text, --edn, --json  the same
  --explain-changed      write the changed regions to standard error

Gate:
  --changed-from REF     clusters that touch lines changed since REF are new
  --changed FILE         clusters that touch FILE are new; repeatable
  --fail-on-duplicates   exit 1 for new clusters, without a scope for any

  -h, --help             this text"""


@dataclass
class ChangedScope:
    root: str
    regions: ChangedRegions


def git_scope(options: Options, files: list[str]) -> ChangedScope:
    """Lines changed since the merge base; scanned files that the index lacks are changed as a whole."""
    root = GitProvider().repo_root()
    git = GitProvider(root)
    git.verify_ref(options.changed_from)
    regions = parse_unified_diff(git.diff_since(git.merge_base(options.changed_from)))
    indexed = git.indexed_files([canonical_path(root, p) or "." for p in options.paths])
    for file in (canonical_path(root, f) for f in files):
        if file not in indexed:
            regions.add_whole_file(file, "untracked")
    return ChangedScope(root, regions)


def _ungateable(path: str, canonical: str, scanned: set[str]) -> str | None:
    if not os.path.exists(path):
        return f"{path}: no such file"
    if os.path.isdir(path):
        return f"{path}: a directory, where --changed takes files"
    if canonical not in scanned:
        return f"{path}: not among the files scanned"
    return None


def listed_scope(options: Options, files: list[str]) -> ChangedScope:
    """The listed files as a whole. One that the gate can't see is an error under the gate, else a warning."""
    root = os.getcwd()
    scanned = {canonical_path(root, f) for f in files}
    regions, problems = ChangedRegions(), []
    for path in options.changed:
        canonical = canonical_path(root, path)
        if problem := _ungateable(path, canonical, scanned):
            problems.append(problem)
        else:
            regions.add_whole_file(canonical, "listed")
    if problems and options.fail_on_duplicates:
        raise ValueError("\n".join(problems))
    for problem in problems:
        print(f"warning: {problem}; no cluster can be new by it", file=sys.stderr)
    return ChangedScope(root, regions)


def changed_scope(options: Options, files: list[str]) -> ChangedScope | None:
    if options.changed_from is not None:
        return git_scope(options, files)
    return listed_scope(options, files) if options.changed else None


def statuses(spark: SparkSession, result: ScanResult, scope: ChangedScope | None) -> dict[int, str]:
    """The status of each cluster. Files are few here, so their canonical forms are made on the driver."""
    if scope is None:
        found = cluster_status(result.members, None)
    else:
        names = spark.createDataFrame([(f, canonical_path(scope.root, f)) for f in result.files] or [("", "")], "file string, canonical string")
        at = result.members.join(names, "file").withColumn("file", F.col("canonical")).drop("canonical")
        found = cluster_status(at, scope.regions.to_df(spark))
    return {r["cluster_id"]: r["status"] for r in found.collect()}


def run(options: Options, spark: SparkSession | None = None) -> int:
    if spark is None:
        spark = local_session(shuffle_partitions=4)
        spark.sparkContext.setLogLevel("OFF")
    result = scan(spark, options)
    if options.fail_on_duplicates and not result.files:
        raise ValueError("No files were scanned, so the gate has nothing to pass")
    scope = changed_scope(options, result.files)
    if options.explain_changed:
        print("Changed regions (--explain-changed):", file=sys.stderr)
        print(scope.regions.describe() if scope else "  (no changed scope active)", file=sys.stderr)
    found = collect(report_order(result.clusters), statuses(spark, result, scope))
    print(FORMATTERS[options.format](found))
    failing = any(c.status == "new" for c in found) if scope else bool(found)
    return int(options.fail_on_duplicates and failing)


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    try:
        options = Options.parse(*(sys.argv[1:] if argv is None else argv))
        if options.help:
            print(USAGE)
            return 0
        return run(options, spark)
    except Exception as error:
        print(error, file=sys.stderr)
        return 2
