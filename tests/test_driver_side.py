"""Options, listing, diff reader, regions, formats."""

import json
import os

import pytest

from echofold.functions.numbers import _approximate_key, collation_key, plain, two_places
from echofold.functions.options import Options
from echofold.functions.paths import canonical_path
from echofold.plans import report
from echofold.sources.diff import ChangedRegions, parse_unified_diff
from echofold.sources.gitignore import GitIgnore
from echofold.sources.listing import source_files


def test_options_are_parsed():
    found = Options.parse("--threshold", "0.9", "--min-lines", "5", "--min-nodes", "30", "--min-locations", "4", "--json", "--fail-on-duplicates", "spec")
    assert (found.paths, found.threshold, found.min_lines, found.min_nodes, found.min_locations) == (("spec",), 0.9, 5, 30, 4)
    assert found.format == "json" and found.fail_on_duplicates and found.respect_gitignore
    assert Options.parse().paths == ("src",) and not Options.parse("--no-gitignore").respect_gitignore
    assert Options.parse("--json", "--text").format == "text"
    assert Options.parse("--threshold", "0.9abc", "--min-lines", "5.9").min_lines == 5
    assert Options.of({"paths": [], "format": "json"}) == Options(format="json")


@pytest.mark.parametrize(
    "args, message",
    [
        (["--threshold", "high"], "Invalid number"),
        (["--min-lines", "many"], "Invalid integer"),
        (["--threshold"], "Missing value"),
        (["--format", "xml"], "Unknown format: xml"),
        (["--frm"], "Unknown option: --frm"),
        (["--threshold", "0"], "threshold must be"),
        (["--threshold", "1.5"], "threshold must be"),
        (["--min-lines", "0"], "minLines must be"),
        (["--min-nodes", "-1"], "minNodes must be"),
        (["--min-locations", "1"], "minLocations must be"),
        (["--changed-from", "a", "--changed", "b"], "cannot be combined"),
    ],
)
def test_options_are_checked(args, message):
    with pytest.raises(ValueError, match=message):
        Options.parse(*args)


def tree(tmp_path, **files):
    for name, text in files.items():
        path = tmp_path / name.replace("__", "/").replace("_DOT_", ".")
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)


def test_listing(tmp_path, monkeypatch):
    monkeypatch.chdir(tmp_path)
    tree(tmp_path, **{"a_DOT_ts": "", "b_DOT_d_DOT_ts": "", "c_DOT_txt": "", "sub__d_DOT_tsx": "", "ignored__e_DOT_ts": "", "_DOT_gitignore": "ignored/\n"})
    os.symlink(tmp_path / "a.ts", tmp_path / "link.ts")
    assert source_files(["."]) == ["a.ts", "sub/d.tsx"]
    assert source_files(["."], respect_gitignore=False) == ["a.ts", "ignored/e.ts", "sub/d.tsx"]
    assert source_files(["ignored/e.ts"]) == ["ignored/e.ts"] and source_files(["ignored"]) == []
    assert source_files(["sub", ".", "a.ts", "missing", "link.ts"]) == ["a.ts", "link.ts", "sub/d.tsx"]
    assert source_files([str(tmp_path / "sub"), "sub"]) == [str(tmp_path / "sub" / "d.tsx")]
    monkeypatch.chdir(tmp_path / "sub")
    assert source_files([str(tmp_path / "ignored")]) == [str(tmp_path / "ignored" / "e.ts")]


@pytest.mark.parametrize(
    "rules, path, ignored",
    [
        ("*.log", "a/b.log", True), ("/a.ts", "b/a.ts", False), ("/a.ts", "a.ts", True), ("doc/*.ts", "doc/a.ts", True), ("doc/*.ts", "doc/x/a.ts", False),
        ("**/gen/*.ts", "a/b/gen/c.ts", True), ("gen/**", "gen/a/b.ts", True), ("*.ts\n!keep.ts", "keep.ts", False), ("out/\n!out/a.ts", "out/a.ts", True),
        ("out/", "out", False), ("[ab].ts", "b.ts", True), ("# x\n\n", "x", False), ("\\#x", "#x", True), ("a?.ts", "ab.ts", True),
    ],
)
def test_gitignore(rules, path, ignored):
    assert GitIgnore(rules).ignores(path) is ignored


HEAD = ["diff --git a/f.ts b/f.ts", "index 1..2 100644", "--- a/f.ts", "+++ b/f.ts"]


@pytest.mark.parametrize(
    "lines, expected",
    [
        ([*HEAD, "@@ -3,2 +3,3 @@", "-a", "-b", "+a", "+b", "+c"], [("f.ts", 3, 5)]),
        ([*HEAD, "@@ -3 +4 @@ function x", "-a", "+b"], [("f.ts", 4, 4)]),
        ([*HEAD, "@@ -10,2 +9,0 @@", "-a", "-b"], [("f.ts", 9, 9)]),
        ([*HEAD, "@@ -1,2 +0,0 @@", "-a", "-b"], [("f.ts", 1, 1)]),
        ([*HEAD[:2], "new file mode 100644", "--- /dev/null", "+++ b/f.ts", "@@ -0,0 +1,2 @@", "+a", "+b"], [("f.ts", 1, 2)]),
        ([HEAD[0], "deleted file mode 100644", "--- a/f.ts", "+++ /dev/null", "@@ -1 +0,0 @@", "-a"], []),
        ([HEAD[0], "Binary files a/f.ts and b/f.ts differ"], []),
        ([HEAD[0], "old mode 100644", "new mode 100755"], []),
        (["Submodule sub 1..2:"], []),
        ([HEAD[0], "similarity index 90%", "rename from f.ts", "rename to g.ts", "--- a/f.ts", "+++ b/g.ts", "@@ -5,1 +5,1 @@", "-a", "+b"], [("g.ts", 5, 5)]),
        ([*HEAD, "@@ -1 +1 @@", "-a", "\\ No newline at end of file", "+b", "\\ No newline at end of file"], [("f.ts", 1, 1)]),
        ([*HEAD[:3], "+++ b/a file.ts\t", "@@ -1 +1 @@", "-a", "+b"], [("a file.ts", 1, 1)]),
        ([*HEAD[:3], '+++ "b/t\\tq\\"\\303.ts"', "@@ -1 +1 @@", "-a", "+b"], [('t\tq"Ã.ts', 1, 1)]),
    ],
)
def test_diffs(lines, expected):
    assert [(f, s, e) for f, s, e, _ in parse_unified_diff("\n".join(lines) + "\n").rows()] == expected


@pytest.mark.parametrize("lines", [["what is this"], [*HEAD, "@@ -1,2 +1,2 @@", "-a"], ["@@ -1 +1 @@", "-a", "+b"], [*HEAD, "@@ -1,2 +1,2 @@", " context"]])
def test_bad_diffs_raise(lines):
    with pytest.raises(ValueError):
        parse_unified_diff("\n".join(lines))


def test_regions():
    regions = ChangedRegions()
    assert regions.describe() == "  (no changed regions)"
    regions.add_whole_file("b.ts", "listed")
    regions.add_range("a.ts", 3, 5, "hunk")
    assert regions.describe() == "  a.ts:3-5 (hunk)\n  b.ts (entire file, listed)"
    assert [regions.intersects_location("a.ts", *at) for at in ((1, 2), (1, 3), (5, 9), (6, 9))] == [False, True, True, False]
    assert regions.intersects_location("b.ts", 10**9, 10**9) and not regions.intersects_location("c.ts", 1, 1)


def test_numbers_and_names():
    assert [two_places(x) for x in (1.005, 0.845, 0.625, 1.0, 0.6875)] == ["1.00", "0.84", "0.63", "1.00", "0.69"]
    assert [plain(x) for x in (1.0, 0.625, 1 / 3)] == ["1", "0.625", "0.3333333333333333"]
    names = ["oak-b", "oak_a", "Main", "main", "c12", "c3", "D", "ü", "u", "oak/c"]
    for key in (collation_key, _approximate_key):
        assert sorted(names, key=key) == ["c12", "c3", "D", "main", "Main", "oak_a", "oak-b", "oak/c", "u", "ü"]


def test_canonical_paths(tmp_path, monkeypatch):
    monkeypatch.chdir(tmp_path)
    assert [canonical_path(str(tmp_path), p) for p in ("a/b.ts", "./a/../c.ts", ".")] == ["a/b.ts", "c.ts", ""]


def loc(file):
    return report.Location(file, 6, 19, 41)


def test_formats():
    trio = report.cluster_of(0.635, 0.775, map(loc, ("kiwi.ts", "fig.ts", "date.ts")))
    assert report.to_text([trio]) == "CLUSTER 1 score=0.64-0.78 locations=3 status=unscoped\n" + "\n".join(f"  {f}.ts:6-19 nodes=41" for f in ("date", "fig", "kiwi"))
    assert report.to_text([]) == "No duplicate clusters found." and report.to_edn([]) == "{:clusters []}"
    duo = report.cluster_of(0.9375, 0.9375, map(loc, ("fig.ts", "plum.ts")), "new")
    assert report.to_text([duo, trio]).split("\n\n")[0].startswith("CLUSTER 1 score=0.94 locations=2 status=new (intersects your change)")
    assert report.to_edn([report.cluster_of(0.9375, 0.9375, map(loc, ("fig.ts", "plum.ts")))]) == (
        '{:clusters\n [{:score-min 0.9375\n   :score-max 0.9375\n   :status :unscoped\n   :location-count 2\n'
        '   :locations [{:file "fig.ts", :start-line 6, :end-line 19, :nodes 41}\n               {:file "plum.ts", :start-line 6, :end-line 19, :nodes 41}]}]}'
    )
    assert json.loads(report.to_json([trio])) == {"clusters": [{"score": {"min": 0.635, "max": 0.775}, "status": "unscoped", "locationCount": 3, "locations": [{"file": f"{f}.ts", "startLine": 6, "endLine": 19, "nodes": 41} for f in ("date", "fig", "kiwi")]}]}
    assert report.to_json([]).startswith('{\n  "clusters": []') and '"min": 1,' in report.to_json([report.cluster_of(1.0, 1.0, [loc("a")])])
    assert 'C:\\\\new \\"one\\".ts' in report.to_edn([report.cluster_of(1, 1, [loc('C:\\new "one".ts')])])
    assert [c.score_max for c in report.in_order([trio, report.cluster_of(0.81, 0.81, [loc("d")])])] == [0.81, 0.775]


def test_names_sort_as_in_the_engine(spark):
    """The driver's order of names is that of the UNICODE collation, with bytes for ties."""
    from pyspark.sql import functions as F

    from echofold.operators.clusters import collated

    letters = [chr(c) for c in [*range(0x20, 0x7F), *range(0xC0, 0x180)] if chr(c) not in "×÷ŉ/\\"]
    names = [*letters, *(f"a{c}b" for c in letters), "src/Æther.ts", "src/aether.ts", "src/af.ts", "Ølet.ts", "olet.ts", "om.ts", "łan.ts", "lan.ts", "lb.ts"]
    found = [r["file"] for r in spark.createDataFrame([(n,) for n in names], "file string").orderBy(*collated(F.col("file"))).collect()]
    mine = sorted(names, key=collation_key)
    assert [(a, b) for a, b in zip(found, mine) if a != b] == []
