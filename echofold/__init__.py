"""echofold: structural-duplicate analytics on Spark DataFrames.

The names below are imported on first use, so that Python workers load only what they run.
"""

from importlib import import_module

__version__ = "0.1.0"

_EXPORTS = {
    "echofold.cli": ("USAGE", "main"),
    "echofold.functions.numbers": ("plain", "two_places"),
    "echofold.functions.options": ("Options",),
    "echofold.functions.paths": ("canonical_path",),
    "echofold.functions.structure": ("CANDIDATE_KINDS", "NormalizedNode", "candidates", "fingerprints", "keeps_structural_child", "markers", "node_count", "normalize", "post_order", "subtree_hash", "tag"),
    "echofold.operators.clusters": ("cluster_members", "clusters", "numbered", "report_order"),
    "echofold.operators.components": ("connected_components",),
    "echofold.operators.regions": ("cluster_status", "gate_fails", "membership", "touched", "untracked"),
    "echofold.operators.similarity": ("distinct_sets", "large_enough", "matching_edges", "similar_sets"),
    "echofold.plans.finder": ("ScanResult", "cluster_entries", "find_clusters", "find_clusters_in_table", "scan"),
    "echofold.plans.report": ("Cluster", "Location", "cluster_of", "format_cluster", "in_order", "to_edn", "to_json", "to_text"),
    "echofold.sources.diff": ("ChangedRange", "ChangedRegions", "parse_unified_diff"),
    "echofold.sources.git": ("GitProvider",),
    "echofold.sources.listing": ("source_files",),
    "echofold.sources.script": ("ParseError", "parse"),
    "echofold.sources.typescript": ("ScanError", "scan_file", "scan_text", "source_entries"),
}
_HOME = {name: module for module, names in _EXPORTS.items() for name in names}
__all__ = sorted(_HOME)


def __getattr__(name: str):
    if name in _HOME:
        return getattr(import_module(_HOME[name]), name)
    raise AttributeError(name)
