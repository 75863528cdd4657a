"""Reports of clusters as text, EDN and JSON. Report-sized results only; they pass through the driver."""

from __future__ import annotations

import json
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame

from echofold.functions.numbers import collation_key, plain, two_places

NOTHING = "No duplicate clusters found."


@dataclass(frozen=True)
class Location:
    file: str
    start_line: int
    end_line: int
    nodes: int


@dataclass(frozen=True)
class Cluster:
    score_min: float
    score_max: float
    locations: tuple[Location, ...]
    status: str | None = None

    @property
    def shown_status(self) -> str:
        return self.status or "unscoped"


def _place(location: Location) -> tuple:
    return collation_key(location.file), location.start_line, location.end_line


def cluster_of(score_min: float, score_max: float, locations: Iterable[Location], status: str | None = None) -> Cluster:
    return Cluster(score_min, score_max, tuple(sorted(locations, key=_place)), status)


def in_order(found: Iterable[Cluster]) -> list[Cluster]:
    return sorted(found, key=lambda c: (-c.score_max, _place(c.locations[0])))


def collect(clusters: DataFrame, status: dict[int, str] | None = None) -> list[Cluster]:
    """Clusters (cluster_id, score, locations), already in report order, with a status for each id."""
    rows = clusters.toLocalIterator()
    return [
        Cluster(r["score"]["min"], r["score"]["max"], tuple(Location(l["file"], l["start_line"], l["end_line"], l["nodes"]) for l in r["locations"]), (status or {}).get(r["cluster_id"]))
        for r in rows
    ]


def format_cluster(found: Cluster, index: int) -> str:
    low, high = two_places(found.score_min), two_places(found.score_max)
    score = low if low == high else f"{low}-{high}"
    note = " (intersects your change)" if found.status == "new" else ""
    head = f"CLUSTER {index} score={score} locations={len(found.locations)} status={found.shown_status}{note}"
    return "\n".join([head, *(f"  {l.file}:{l.start_line}-{l.end_line} nodes={l.nodes}" for l in found.locations)])


def to_text(found: list[Cluster]) -> str:
    return "\n\n".join(format_cluster(c, i) for i, c in enumerate(found, 1)) or NOTHING


def _edn_string(text: str) -> str:
    escaped = text.replace("\\", "\\\\").replace('"', '\\"')
    return f'"{escaped}"'


def _edn_location(l: Location) -> str:
    return f"{{:file {_edn_string(l.file)}, :start-line {l.start_line}, :end-line {l.end_line}, :nodes {l.nodes}}}"


def _edn_cluster(c: Cluster) -> str:
    fields = {
        "score-min": plain(c.score_min),
        "score-max": plain(c.score_max),
        "status": f":{c.shown_status}",
        "location-count": str(len(c.locations)),
    }
    listed = ("\n" + " " * 15).join(map(_edn_location, c.locations))
    lines = [f":{name} {value}" for name, value in fields.items()] + [f":locations [{listed}]"]
    return "{" + "\n   ".join(lines) + "}"


def to_edn(found: list[Cluster]) -> str:
    if not found:
        return "{:clusters []}"
    return "{:clusters\n [" + "\n  ".join(map(_edn_cluster, found)) + "]}"


def _json_cluster(c: Cluster) -> dict:
    number = lambda x: int(x) if x == int(x) else x
    return {
        "score": {"min": number(c.score_min), "max": number(c.score_max)},
        "status": c.shown_status,
        "locationCount": len(c.locations),
        "locations": [{"file": l.file, "startLine": l.start_line, "endLine": l.end_line, "nodes": l.nodes} for l in c.locations],
    }


def to_json(found: list[Cluster]) -> str:
    return json.dumps({"clusters": [_json_cluster(c) for c in found]}, indent=2, ensure_ascii=False) + "\n"


FORMATTERS = {"text": to_text, "edn": to_edn, "json": to_json}
