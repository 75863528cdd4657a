"""Registered queries of the engine's own operators, each with SQL that gives the same rows.

The tables hold no source code, so documents stand in for files and their lines for source lines; the
TypeScript queries run on the fixtures below, whose expected rows are derived by hand.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from echofold.operators import regions as R
from echofold.operators import similarity as S
from echofold.operators.clusters import clusters, numbered
from echofold.plans import report
from echofold.plans.finder import cluster_entries
from echofold.plans.staging import staged
from echofold.sources.diff import WHOLE_FILE_END, parse_unified_diff
from echofold.sources.tables import document_entries, page_entries, window_entries
from echofold.sources.typescript import source_entries

THRESHOLD = 0.82
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str):
    def register(run: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name], ORACLES[name] = run, sql
        return run

    return register


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_entries(_table(spark, sf_dir, "documents"))


def _windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return window_entries(_table(spark, sf_dir, "documents"))


# SQL that the oracles share

_WORDS = "list_filter(string_split_regex(lower({text}), '[ \\t\\n\\f\\r]+'), lambda x: x <> '')"
_RUNS = "list_transform(range(1, len({w}) - 1), lambda i: {w}[i] || ' ' || {w}[i + 1] || ' ' || {w}[i + 2])"

_DOCUMENT_ENTRIES = f"""
words AS (SELECT doc_id, text, {_WORDS.format(text="coalesce(text, '')")} AS w FROM documents),
runs AS (SELECT doc_id, text, {_RUNS.format(w="w")} AS runs FROM words WHERE len(w) >= 3),
entries AS (
    SELECT doc_id AS entry_id, doc_id::VARCHAR AS file, 1::BIGINT AS start_line, len(string_split(text, chr(10))) AS end_line,
           len(runs) AS nodes, list_sort(list_distinct(runs)) AS fps FROM runs)"""

_WINDOW_ENTRIES = f"""
parts AS (SELECT doc_id, string_split(text, chr(10)) AS part FROM documents),
places AS (SELECT doc_id, part, unnest(range(0, len(part) - 3)) AS k FROM parts WHERE len(part) >= 4),
words AS (SELECT doc_id, k, {_WORDS.format(text="part[k + 1] || chr(10) || part[k + 2] || chr(10) || part[k + 3] || chr(10) || part[k + 4]")} AS w FROM places),
runs AS (SELECT doc_id, k, {_RUNS.format(w="w")} AS runs FROM words WHERE len(w) >= 3),
entries AS (
    SELECT doc_id * 2147483648 + k AS entry_id, doc_id::VARCHAR AS file, k + 1 AS start_line, k + 4 AS end_line,
           len(runs) AS nodes, list_sort(list_distinct(runs)) AS fps FROM runs)"""

_SETS = """
sets AS (SELECT fps, len(fps) AS n, min(entry_id) AS rep, count(*) AS members FROM entries GROUP BY fps)"""

_SET_PAIRS = """
tokens AS (SELECT rep, n, unnest(fps) AS f FROM sets),
common AS (
    SELECT x.rep AS a, y.rep AS b, any_value(x.n) AS an, any_value(y.n) AS bn, count(*) AS c
    FROM tokens x JOIN tokens y ON x.f = y.f AND x.rep < y.rep GROUP BY x.rep, y.rep),
pairs AS (
    SELECT a, b, c::DOUBLE / (an + bn - c)::DOUBLE AS score FROM common
    WHERE c::DOUBLE / (an + bn - c)::DOUBLE >= {t}::DOUBLE)"""

# All pairs of entries, not of sets, without those that overlap in one file.
_ENTRY_EDGES = """
ids AS (SELECT e.entry_id, e.file, e.start_line, e.end_line, e.nodes, s.rep FROM entries e JOIN sets s ON s.fps = e.fps),
alike AS (SELECT rep AS a, rep AS b, 1.0::DOUBLE AS score FROM sets WHERE members > 1 UNION ALL SELECT a, b, score FROM pairs),
edges AS (
    SELECT x.entry_id AS l, y.entry_id AS r, p.score
    FROM alike p JOIN ids x ON x.rep = p.a JOIN ids y ON y.rep = p.b
    WHERE (p.a <> p.b OR x.entry_id < y.entry_id)
      AND NOT (x.file = y.file AND x.start_line <= y.end_line AND y.start_line <= x.end_line))"""

_COMPONENTS = """
steps AS (SELECT l AS x, r AS y FROM edges UNION SELECT r, l FROM edges),
reach(node, root) AS (SELECT DISTINCT x, x FROM steps UNION SELECT s.y, r.root FROM reach r JOIN steps s ON s.x = r.node),
comp AS (SELECT node, min(root) AS cluster_id FROM reach GROUP BY node),
ranges AS (SELECT c.cluster_id, min(e.score) AS score_min, max(e.score) AS score_max FROM edges e JOIN comp c ON c.node = e.l GROUP BY c.cluster_id),
counts AS (SELECT cluster_id, count(*) AS location_count FROM comp GROUP BY cluster_id)"""


def _cluster_sql(entries: str, threshold: float, select: str) -> str:
    return f"WITH RECURSIVE {entries}, {_SETS}, {_SET_PAIRS.format(t=threshold)}, {_ENTRY_EDGES}, {_COMPONENTS} {select}"


# Entries and their statistics


@query("doc_fingerprints", f"WITH {_DOCUMENT_ENTRIES} SELECT entry_id AS doc_id, nodes, len(fps) AS distinct_fingerprints FROM entries")
def doc_fingerprints(spark, sf_dir):
    return _documents(spark, sf_dir).select(F.col("entry_id").alias("doc_id"), F.col("nodes").cast("bigint").alias("nodes"), F.size("fingerprints").cast("bigint").alias("distinct_fingerprints"))


@query("candidate_filter", f"WITH {_DOCUMENT_ENTRIES} SELECT entry_id AS doc_id, nodes, end_line - start_line + 1 AS lines FROM entries WHERE nodes >= 20 AND end_line - start_line + 1 >= 4")
def candidate_filter(spark, sf_dir):
    kept = S.large_enough(_documents(spark, sf_dir), min_lines=4, min_nodes=20)
    return kept.select(F.col("entry_id").alias("doc_id"), F.col("nodes").cast("bigint").alias("nodes"), (F.col("end_line") - F.col("start_line") + 1).cast("bigint").alias("lines"))


@query("fingerprint_frequency", f"WITH {_DOCUMENT_ENTRIES}, f AS (SELECT f, count(*) AS frequency FROM (SELECT unnest(fps) AS f FROM entries) GROUP BY f) SELECT frequency, count(*) AS fingerprints FROM f GROUP BY frequency")
def fingerprint_frequency(spark, sf_dir):
    return S.token_frequency(_documents(spark, sf_dir)).groupBy("frequency").agg(F.count(F.lit(1)).alias("fingerprints"))


@query("identical_groups", f"WITH {_DOCUMENT_ENTRIES}, {_SETS} SELECT rep AS first_doc, members, n AS size FROM sets WHERE members > 1")
def identical_groups(spark, sf_dir):
    sets = S.distinct_sets(_documents(spark, sf_dir)).where("members > 1")
    return sets.select(F.col("set_id").alias("first_doc"), "members", F.col("n").cast("bigint").alias("size"))


@query(
    "prefix_lengths",
    f"WITH {_DOCUMENT_ENTRIES} SELECT entry_id AS doc_id, len(fps) AS size, greatest(len(fps) - ceil({THRESHOLD}::DOUBLE * len(fps) - 1e-9::DOUBLE)::BIGINT + 1, 0) AS prefix FROM entries",
)
def prefix_lengths(spark, sf_dir):
    size = F.size("fingerprints")
    return _documents(spark, sf_dir).select(F.col("entry_id").alias("doc_id"), size.cast("bigint").alias("size"), S.prefix_length(size, THRESHOLD).cast("bigint").alias("prefix"))


# The similarity join


def _similar_pairs(threshold: float):
    sql = f"WITH {_DOCUMENT_ENTRIES}, {_SETS}, {_SET_PAIRS.format(t=threshold)} SELECT a, b, score FROM pairs"

    @query(f"similar_pairs_t{round(100 * threshold):03d}", sql)
    def run(spark, sf_dir):
        sets = staged(S.distinct_sets(_documents(spark, sf_dir)), "sets")
        return S.similar_sets(sets, threshold)


for _t in (0.2, 0.5, THRESHOLD, 1.0):
    _similar_pairs(_t)


@query("similar_pages", f"""
WITH tags AS (SELECT page_id AS entry_id, list_transform(regexp_extract_all(coalesce(html, ''), '<(/?[a-zA-Z][a-zA-Z0-9]*)', 1), lambda t: lower(t)) AS w FROM pages),
entries AS (SELECT entry_id, list_sort(list_distinct({_RUNS.format(w="w")})) AS fps FROM tags WHERE len(w) >= 3),
{_SETS}, {_SET_PAIRS.format(t=THRESHOLD)} SELECT a, b, score FROM pairs""")
def similar_pages(spark, sf_dir):
    sets = staged(S.distinct_sets(page_entries(_table(spark, sf_dir, "pages"))), "sets")
    return S.similar_sets(sets, THRESHOLD)


# Clusters


def _members(spark, sf_dir, least: int = 2) -> DataFrame:
    return cluster_entries(_documents(spark, sf_dir), THRESHOLD, least)


def _summary(members: DataFrame) -> DataFrame:
    return members.select("cluster_id", "location_count", "score_min", "score_max").distinct()


_SUMMARY = "SELECT cluster_id, location_count, score_min, score_max FROM counts JOIN ranges USING (cluster_id)"


@query("cluster_members", _cluster_sql(_DOCUMENT_ENTRIES, THRESHOLD, "SELECT c.cluster_id, i.file, i.start_line, i.end_line, i.nodes FROM comp c JOIN ids i ON i.entry_id = c.node"))
def cluster_members(spark, sf_dir):
    wide = lambda c: F.col(c).cast("bigint").alias(c)
    return _members(spark, sf_dir).select("cluster_id", "file", wide("start_line"), wide("end_line"), wide("nodes"))


@query("cluster_scores", _cluster_sql(_DOCUMENT_ENTRIES, THRESHOLD, _SUMMARY))
def cluster_scores(spark, sf_dir):
    return _summary(_members(spark, sf_dir))


@query("clusters_min_locations_3", _cluster_sql(_DOCUMENT_ENTRIES, THRESHOLD, f"{_SUMMARY} WHERE location_count >= 3"))
def clusters_min_locations_3(spark, sf_dir):
    return _summary(_members(spark, sf_dir, 3))


@query(
    "cluster_ranking",
    _cluster_sql(
        _DOCUMENT_ENTRIES,
        THRESHOLD,
        ", heads AS (SELECT c.cluster_id, min(i.file) AS first_file FROM comp c JOIN ids i ON i.entry_id = c.node GROUP BY c.cluster_id) "
        "SELECT row_number() OVER (ORDER BY score_max DESC, first_file) AS rank, cluster_id, first_file FROM heads JOIN ranges USING (cluster_id)",
    ),
)
def cluster_ranking(spark, sf_dir):
    return numbered(_members(spark, sf_dir)).select(F.col("rank").cast("bigint").alias("rank"), "cluster_id", "first_file")


# Names that sort otherwise by bytes; the places in this order are derived by hand.
NAMES = ["_a.ts", "-a.ts", "2.ts", "10.ts", "a.ts", "A.ts", "á.ts", "æ.ts", "b.ts", "B.ts", "ł.ts", "M.ts", "o.ts", "ø.ts", "z.ts", "Ж.ts", "漢.ts"]
_PLACES = ["_a.ts", "-a.ts", "10.ts", "2.ts", "a.ts", "A.ts", "á.ts", "æ.ts", "b.ts", "B.ts", "ł.ts", "M.ts", "o.ts", "ø.ts", "z.ts", "Ж.ts", "漢.ts"]


@query("name_order", "SELECT * FROM (VALUES " + ", ".join(f"({i}, '{name}')" for i, name in enumerate(_PLACES, 1)) + ") t(place, file)")
def name_order(spark, sf_dir):
    from echofold.operators.clusters import collated
    from echofold.operators.ranking import ranked

    names = spark.createDataFrame([(n,) for n in sorted(NAMES)], "file string")
    keys = names.select("file", *[k.alias(f"k{i}") for i, k in enumerate(collated(F.col("file")))])
    return ranked(keys, [], ["k0", "k1"]).select(F.col("k").cast("int").alias("place"), "file")


def _window_clusters(threshold: float) -> Callable:
    return lambda spark, sf_dir: _summary(cluster_entries(_windows(spark, sf_dir), threshold))


query("window_clusters_no_overlap", _cluster_sql(_WINDOW_ENTRIES, THRESHOLD, _SUMMARY))(_window_clusters(THRESHOLD))
query("identical_overlap_forest", _cluster_sql(_WINDOW_ENTRIES, 1.0, _SUMMARY))(_window_clusters(1.0))

# Regions, status, gate. The changed files are the documents of low quality.

_CHANGED = "changed AS (SELECT DISTINCT doc_id::VARCHAR AS file FROM labels WHERE quality = 0)"


def _regions(spark, sf_dir) -> DataFrame:
    low = _table(spark, sf_dir, "labels").where("quality = 0").select(F.col("doc_id").cast("string").alias("file")).distinct()
    return low.select("file", F.lit(1).cast("bigint").alias("start"), F.lit(WHOLE_FILE_END).cast("bigint").alias("end"), F.lit("listed").alias("source"))


@query("changed_intersection", f"""WITH {_WINDOW_ENTRIES}, hunks AS (SELECT doc_id::VARCHAR AS file, 2 AS lo, 3 AS hi FROM labels WHERE quality = 0)
SELECT entry_id, start_line, end_line FROM entries e WHERE EXISTS (SELECT 1 FROM hunks h WHERE h.file = e.file AND h.lo <= e.end_line AND e.start_line <= h.hi)""")
def changed_intersection(spark, sf_dir):
    hunks = _regions(spark, sf_dir).select("file", F.lit(2).cast("bigint").alias("start"), F.lit(3).cast("bigint").alias("end"), F.lit("hunk").alias("source"))
    hit = R.touched(_windows(spark, sf_dir), hunks)
    return hit.select("entry_id", F.col("start_line").cast("bigint").alias("start_line"), F.col("end_line").cast("bigint").alias("end_line"))


_STATUS = "status AS (SELECT c.cluster_id, CASE WHEN bool_or(h.file IS NOT NULL) THEN 'new' ELSE 'known' END AS status FROM comp c JOIN ids i ON i.entry_id = c.node LEFT JOIN changed h ON h.file = i.file GROUP BY c.cluster_id)"


@query("cluster_status", _cluster_sql(_DOCUMENT_ENTRIES, THRESHOLD, f", {_CHANGED}, {_STATUS} SELECT cluster_id, status FROM status"))
def cluster_status(spark, sf_dir):
    return R.cluster_status(_members(spark, sf_dir), _regions(spark, sf_dir))


@query("gate_exit_code", _cluster_sql(_DOCUMENT_ENTRIES, THRESHOLD, f", {_CHANGED}, {_STATUS} SELECT CASE WHEN coalesce(bool_or(status = 'new'), FALSE) THEN 1 ELSE 0 END AS exit_code FROM status"))
def gate_exit_code(spark, sf_dir):
    return R.gate_fails(cluster_status(spark, sf_dir), scoped=True).select(F.col("fails").cast("int").alias("exit_code"))


@query("untracked_files", "SELECT DISTINCT d.doc_id::VARCHAR AS file, 1::BIGINT AS start, 9007199254740991 AS \"end\", 'untracked' AS source FROM documents d WHERE d.doc_id NOT IN (SELECT doc_id FROM labels)")
def untracked_files(spark, sf_dir):
    scanned = _table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("file"))
    indexed = _table(spark, sf_dir, "labels").select(F.col("doc_id").cast("string").alias("file"))
    return R.untracked(scanned, indexed)


@query("listed_membership", "SELECT l.doc_id::VARCHAR AS file, d.doc_id IS NOT NULL AS scanned FROM (SELECT DISTINCT doc_id FROM labels WHERE quality = 0) l LEFT JOIN documents d ON d.doc_id = l.doc_id")
def listed_membership(spark, sf_dir):
    scanned = _table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("file"))
    return R.membership(_regions(spark, sf_dir), scanned)


# Fixtures: expected rows are derived by hand, not from this engine's output

DIFF = """diff --git a/one.ts b/one.ts
index 1..2 100644
--- a/one.ts
+++ b/one.ts
@@ -3,2 +3,3 @@
-a
-b
+c
+d
+e
@@ -10,2 +9,0 @@
-x
-y
diff --git a/gone.ts b/gone.ts
deleted file mode 100644
--- a/gone.ts
+++ /dev/null
@@ -1 +0,0 @@
-x
diff --git a/old.ts b/new name.ts
rename from old.ts
rename to new name.ts
--- a/old.ts
+++ b/new name.ts\t
@@ -5,1 +5,1 @@
-x
\\ No newline at end of file
+y
diff --git "a/t\\tab.ts" "b/t\\tab.ts"
--- "a/t\\tab.ts"
+++ "b/t\\tab.ts"
@@ -0,0 +1,2 @@
+x
+y
"""


@query("diff_regions", "SELECT * FROM (VALUES ('one.ts', 3::BIGINT, 5::BIGINT, 'hunk'), ('one.ts', 9, 9, 'hunk'), ('new name.ts', 5, 5, 'hunk'), ('t' || chr(9) || 'ab.ts', 1, 2, 'hunk')) t(file, start, \"end\", source)")
def diff_regions(spark, sf_dir):
    return parse_unified_diff(DIFF).to_df(spark)


TYPESCRIPT = {
    "clamp.ts": "function clamp(level: number, top: number): boolean {\n  let rest = top - level;\n  if (rest) {\n    rest++;\n  }\n  return !rest;\n}\n",
    "gauge.ts": "export class Gauge {\n  peak(levels: string[]): boolean {\n    return levels.length > 9;\n  }\n}\n",
    "limit.ts": "function limit(size: number, most: number): boolean {\n  let left = most - size;\n  if (left) {\n    left++;\n  }\n  return !left;\n}\n",
    "route-a.ts": "export type RouteA = Pair<string, boolean> | null;\n",
    "route-b.ts": "export type RouteB = Table<string, boolean> | null;\n",
}


def typescript_entries(spark: SparkSession, sources: dict[str, str], min_lines: int = 1, min_nodes: int = 1) -> DataFrame:
    rows = [(i, file, text, None) for i, (file, text) in enumerate(sorted(sources.items()))]
    return source_entries(spark.createDataFrame(rows, "ordinal bigint, file string, text string, path string"), min_lines, min_nodes)


# clamp: FunctionDeclaration, Parameter and NumberKeyword (twice), BooleanKeyword, Block, VariableStatement,
# VariableDeclarationList, variable:let, VariableDeclaration, BinaryExpression, operator and MinusToken, IfStatement,
# Block, ExpressionStatement, PostfixUnaryExpression, its operator, ReturnStatement, PrefixUnaryExpression, its operator
# = 22 nodes, of which Parameter and NumberKeyword repeat; its variable statement alone is 7.
# Gauge: ClassDeclaration, modifier and ExportKeyword, MethodDeclaration, Parameter, ArrayType, StringKeyword,
# BooleanKeyword, Block, ReturnStatement, BinaryExpression, operator, PropertyAccessExpression, GreaterThanToken = 14.
# RouteA: TypeAliasDeclaration, modifier and ExportKeyword, UnionType, TypeReference, StringKeyword, BooleanKeyword,
# LiteralType = 8.
@query("ts_entries", """SELECT * FROM (VALUES
    ('clamp.ts', 1, 7, 22, 20), ('clamp.ts', 2, 2, 7, 7), ('gauge.ts', 1, 5, 14, 14), ('gauge.ts', 2, 4, 11, 11),
    ('limit.ts', 1, 7, 22, 20), ('limit.ts', 2, 2, 7, 7), ('route-a.ts', 1, 1, 8, 8), ('route-b.ts', 1, 1, 8, 8)
    ) t(file, start_line, end_line, nodes, distinct_fingerprints)""")
def ts_entries(spark, sf_dir):
    return _shown(typescript_entries(spark, TYPESCRIPT))


def _shown(entries: DataFrame) -> DataFrame:
    return entries.select("file", "start_line", "end_line", "nodes", F.size("fingerprints").alias("distinct_fingerprints"))


@query("ts_clusters", """SELECT * FROM (VALUES
    (1, 'clamp.ts', 1, 7, 22), (1, 'limit.ts', 1, 7, 22), (2, 'clamp.ts', 2, 2, 7), (2, 'limit.ts', 2, 2, 7),
    (3, 'route-a.ts', 1, 1, 8), (3, 'route-b.ts', 1, 1, 8)) t(rank, file, start_line, end_line, nodes)""")
def ts_clusters(spark, sf_dir):
    members = cluster_entries(typescript_entries(spark, TYPESCRIPT), 0.95)
    ranks = numbered(members).select("rank", "cluster_id")
    return members.join(ranks, "cluster_id").select(F.col("rank").cast("int").alias("rank"), "file", "start_line", "end_line", "nodes")


MARKED = {
    "accessor.ts": "class Dial {\n  get level() {\n    return this;\n  }\n  set level(to) {\n  }\n}\n",
    "decorated.ts": "@seal\n@log()\nabstract class Box {\n}\n",
    "definite.ts": "class Lamp {\n  watts!: number;\n  volts?: number;\n  amps: number;\n}\n",
    "heritage.ts": "class Oak extends Tree implements Plant, Thing {\n}\n",
    "lists.ts": "var a = 1;\nlet b = 2;\nconst c = 3;\n",
    "optional.ts": "interface Knob {\n  turn?(by?: number): void;\n  readonly size?: string;\n}\n",
    "ternary.ts": "const pick = (a) => a ? -a : a++;\n",
}


# accessor: ClassDeclaration, GetAccessor, Block, ReturnStatement, ThisKeyword, SetAccessor, Parameter, Block = 8, all different
# (the empty block isn't the other one); get is 4, set 3.
# decorated: ClassDeclaration, decorator (twice), modifier:AbstractKeyword, Decorator, Decorator, CallExpression,
# AbstractKeyword = 8, of which the marker repeats; a decorated declaration begins at its decorators.
# definite: PropertyDeclaration, definite, ExclamationToken, NumberKeyword = 4; the same with optional, QuestionToken;
# PropertyDeclaration, NumberKeyword = 2; with ClassDeclaration 11, of which NumberKeyword is there three times.
# heritage: ClassDeclaration, HeritageClause, heritage:ExtendsKeyword, ExpressionWithTypeArguments, HeritageClause,
# heritage:ImplementsKeyword, ExpressionWithTypeArguments (twice) = 8, of which that one is there three times.
# lists: VariableStatement, VariableDeclarationList, variable:..., VariableDeclaration = 4 each.
# optional: MethodSignature, optional, QuestionToken, Parameter, optional, QuestionToken, NumberKeyword, VoidKeyword = 8;
# PropertySignature, modifier:ReadonlyKeyword, optional, ReadonlyKeyword, QuestionToken, StringKeyword = 6; with
# InterfaceDeclaration 15, of which optional and QuestionToken are there three times.
# ternary: VariableStatement, VariableDeclarationList, variable:const, VariableDeclaration, ArrowFunction, Parameter,
# EqualsGreaterThanToken, ConditionalExpression, optional, QuestionToken, PrefixUnaryExpression, operator:MinusToken,
# ColonToken, PostfixUnaryExpression, operator:PlusPlusToken = 15; the arrow function is 11 of them.
@query("ts_markers", """SELECT * FROM (VALUES
    ('accessor.ts', 1, 7, 8, 8), ('accessor.ts', 2, 4, 4, 4), ('accessor.ts', 5, 6, 3, 3),
    ('decorated.ts', 1, 4, 8, 7),
    ('definite.ts', 1, 5, 11, 9), ('definite.ts', 2, 2, 4, 4), ('definite.ts', 3, 3, 4, 4), ('definite.ts', 4, 4, 2, 2),
    ('heritage.ts', 1, 2, 8, 6),
    ('lists.ts', 1, 1, 4, 4), ('lists.ts', 2, 2, 4, 4), ('lists.ts', 3, 3, 4, 4),
    ('optional.ts', 1, 4, 15, 11), ('optional.ts', 2, 2, 8, 6), ('optional.ts', 3, 3, 6, 6),
    ('ternary.ts', 1, 1, 15, 15), ('ternary.ts', 1, 1, 11, 11)
    ) t(file, start_line, end_line, nodes, distinct_fingerprints)""")
def ts_markers(spark, sf_dir):
    return _shown(typescript_entries(spark, MARKED))


KINDS = {
    "kinds.ts": """class Shelf {
  size: number;
  constructor() {
  }
  fill() {
  }
}
interface Shape {
  side: number;
  grow(): void;
  (by: number): void;
  new (of: string): Shape;
  [name: string]: number;
}
type Both = Shape & Shelf;
enum Tone {
  Low,
  High = 5,
}
namespace Tools {
}
function run() {
}
const walk = function () {
};
"""
}


# Every candidate kind that the other fixtures lack, one to a line: class and enum bodies, members of types, functions.
@query("ts_candidate_kinds", """SELECT * FROM (VALUES
    ('kinds.ts', 1, 7, 7, 6), ('kinds.ts', 2, 2, 2, 2), ('kinds.ts', 3, 4, 2, 2), ('kinds.ts', 5, 6, 2, 2),
    ('kinds.ts', 8, 14, 17, 12), ('kinds.ts', 9, 9, 2, 2), ('kinds.ts', 10, 10, 2, 2), ('kinds.ts', 11, 11, 4, 4),
    ('kinds.ts', 12, 12, 4, 4), ('kinds.ts', 13, 13, 4, 4),
    ('kinds.ts', 15, 15, 4, 3),
    ('kinds.ts', 16, 19, 3, 2), ('kinds.ts', 17, 17, 1, 1), ('kinds.ts', 18, 18, 1, 1),
    ('kinds.ts', 20, 21, 2, 2), ('kinds.ts', 22, 23, 2, 2), ('kinds.ts', 24, 25, 6, 6), ('kinds.ts', 24, 25, 2, 2)
    ) t(file, start_line, end_line, nodes, distinct_fingerprints)""")
def ts_candidate_kinds(spark, sf_dir):
    return _shown(typescript_entries(spark, KINDS))


FLAVOURS = {
    "cart.js": "export function spend(rows) {\n  const open = rows.filter((row) => !row.paid);\n  return open.map((row) => row.cost - 1).join();\n}\n",
    "cost.jsx": "export function owed(items) {\n  const due = items.filter((item) => !item.done);\n  return due.map((item) => item.price - 2).join();\n}\n",
    "page.tsx": "export const page = (text: string) => (\n  <p class=\"x\">\n    {text}<br/>\n  </p>\n);\n",
    "pane.jsx": "export const pane = (node) => (\n  <b id=\"k\">\n    {node}<wbr/>\n  </b>\n);\n",
    "view.jsx": "export const view = (body) => (\n  <i lang=\"en\">\n    {body}<hr/>\n  </i>\n);\n",
    "bare.mts": "interface Seat {\n  row: number;\n  free?: boolean;\n}\n",
    "chair.cts": "interface Stool {\n  legs: number;\n  soft?: boolean;\n}\n",
    "few.ts": "enum Few {\n  One = 1,\n  Two = 2,\n  Many,\n}\n",
    "lot.ts": "enum Lot {\n  A = 10,\n  B = 20,\n  C,\n}\n",
}


# JavaScript, JSX, TSX and modules together; a type annotation is structure, so page.tsx stays apart at this threshold.
@query("ts_flavours", """SELECT * FROM (VALUES
    ('bare.mts', 1, 4), ('chair.cts', 1, 4), ('cart.js', 1, 4), ('cost.jsx', 1, 4), ('few.ts', 1, 5), ('lot.ts', 1, 5),
    ('pane.jsx', 1, 5), ('view.jsx', 1, 5)
    ) t(file, start_line, end_line)""")
def ts_flavours(spark, sf_dir):
    return cluster_entries(typescript_entries(spark, FLAVOURS, 3, 3), 1.0).select("file", "start_line", "end_line")


# A statement and its arrow function share their lines: two entries, one location, nodes of the larger, which are
# VariableStatement, VariableDeclarationList, variable:const, VariableDeclaration, ArrowFunction,
# EqualsGreaterThanToken, Block, ReturnStatement, ThisKeyword.
@query("ts_overlap", "SELECT * FROM (VALUES ('a.ts', 1, 3, 9), ('b.ts', 1, 3, 9)) t(file, start_line, end_line, nodes)")
def ts_overlap(spark, sf_dir):
    source = "const {} = () => {{\n  return this;\n}};\n"
    members = cluster_entries(typescript_entries(spark, {"a.ts": source.format("f"), "b.ts": source.format("g")}), THRESHOLD)
    return members.select("file", "start_line", "end_line", "nodes")


_FIXED = [
    report.cluster_of(0.6875, 0.8125, [report.Location(f, 31, 38, 77) for f in ("Wren.ts", "owl.ts", "æon.ts")]),
    report.cluster_of(1.0, 1.0, [report.Location(f, 2, 9, 33) for f in ('q"x.ts', "z\\y.ts")], "new"),
]


def _rendered(render: Callable[[list], str]):
    return lambda spark, sf_dir: spark.createDataFrame([(render(report.in_order(_FIXED)),)], "report string")


_TEXT = """CLUSTER 1 score=1.00 locations=2 status=new (intersects your change)
  q"x.ts:2-9 nodes=33
  z\\y.ts:2-9 nodes=33

CLUSTER 2 score=0.69-0.81 locations=3 status=unscoped
  æon.ts:31-38 nodes=77
  owl.ts:31-38 nodes=77
  Wren.ts:31-38 nodes=77"""
_EDN = r"""{:clusters
 [{:score-min 1
   :score-max 1
   :status :new
   :location-count 2
   :locations [{:file "q\"x.ts", :start-line 2, :end-line 9, :nodes 33}
               {:file "z\\y.ts", :start-line 2, :end-line 9, :nodes 33}]}
  {:score-min 0.6875
   :score-max 0.8125
   :status :unscoped
   :location-count 3
   :locations [{:file "æon.ts", :start-line 31, :end-line 38, :nodes 77}
               {:file "owl.ts", :start-line 31, :end-line 38, :nodes 77}
               {:file "Wren.ts", :start-line 31, :end-line 38, :nodes 77}]}]}"""
_JSON = r"""{
  "clusters": [
    {
      "score": {
        "min": 1,
        "max": 1
      },
      "status": "new",
      "locationCount": 2,
      "locations": [
        {
          "file": "q\"x.ts",
          "startLine": 2,
          "endLine": 9,
          "nodes": 33
        },
        {
          "file": "z\\y.ts",
          "startLine": 2,
          "endLine": 9,
          "nodes": 33
        }
      ]
    },
    {
      "score": {
        "min": 0.6875,
        "max": 0.8125
      },
      "status": "unscoped",
      "locationCount": 3,
      "locations": [
        {
          "file": "æon.ts",
          "startLine": 31,
          "endLine": 38,
          "nodes": 77
        },
        {
          "file": "owl.ts",
          "startLine": 31,
          "endLine": 38,
          "nodes": 77
        },
        {
          "file": "Wren.ts",
          "startLine": 31,
          "endLine": 38,
          "nodes": 77
        }
      ]
    }
  ]
}
"""


def _quoted(text: str) -> str:
    return "SELECT '" + text.replace("'", "''") + "' AS report"


query("report_text", _quoted(_TEXT))(_rendered(report.to_text))
query("report_edn", _quoted(_EDN))(_rendered(report.to_edn))
query("report_json", _quoted(_JSON))(_rendered(report.to_json))


@query("clusters", _cluster_sql(_DOCUMENT_ENTRIES, THRESHOLD, """, listed AS (
    SELECT c.cluster_id, string_agg(i.file || ':' || i.start_line || '-' || i.end_line || ' nodes=' || i.nodes, ' ' ORDER BY i.file) AS locations
    FROM comp c JOIN ids i ON i.entry_id = c.node GROUP BY c.cluster_id)
SELECT cluster_id, score_min, score_max, locations FROM listed JOIN ranges USING (cluster_id)"""))
def cluster_rows(spark, sf_dir):
    found = clusters(_members(spark, sf_dir))
    shown = F.transform("locations", lambda l: F.format_string("%s:%d-%d nodes=%d", l["file"], l["start_line"], l["end_line"], l["nodes"]))
    return found.select("cluster_id", F.col("score.min").alias("score_min"), F.col("score.max").alias("score_max"), F.array_join(shown, " ").alias("locations"))
