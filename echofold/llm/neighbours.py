"""Approximate nearest neighbours with a hierarchical k-means tree.

The top of the tree is fitted on a bounded sample (SAMPLE_ROWS rows of least hash) and every row goes to one of
its leaves, the cells. Cells of over SPLIT_ROWS rows are split again, each by a tree of its own that a task
fits on a bounded sample of the cell, and so on: a cell holds about CELL_ROWS rows however many rows there
are, and no tree, centre or count of all cells is ever in one place but the top's.

A query visits cells best bin first: a priority queue holds the branches met so far by the distance of their
centres. At each level the visits are calibrated: for CALIBRATION queries the true neighbours are computed
against all rows, and visits are widened until they hold the target share of them. Cells that were split are
entered with the queue of their own tree; of all cells that a query has then, the nearest ones stay. A query
goes on beyond the calibrated visits while the top's leaves visited hold fewer rows than it needs neighbours.

Only the k + 1 smallest ids of equal vectors can be among anyone's nearest k, so the others of a vector, which
may be a third of all rows, are left behind before rows are placed; a row that repeats is one with a number.
Neighbouring cells make blocks of about BLOCK_ROWS rows, and queries come to a block once, in chunks of
CHUNK_QUERIES; a block that is still larger is cut into chunks of rows. In a block each cell is scored by one
matrix product with the queries that visit it; what may be among the nearest is measured exactly, and the
nearest of all blocks follow from a ranking.

Defined results: vectors that are null, all zero, of another length than the most frequent one, or with
null or non-finite components take no part, neither as queries nor as candidates; nor do null ids. Rows
that share an id are separate candidates, but none for a query of that id; such a query is searched once,
with its least vector. With fewer candidates than k, all are returned.
"""

from __future__ import annotations

import heapq
import pickle
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from echofold.llm.common import join_by_key, least_hashed
from echofold.plans.session import ship_package
from echofold.plans.staging import staged

BRANCHES = 8
#: Rows that a tree is fitted on, at most, and those of them that a leaf holds at least.
SAMPLE_ROWS, LEAF_SAMPLE = 40_000, 24
#: Rows that a cell is meant to hold, and more than which it is split again.
CELL_ROWS, SPLIT_ROWS = 160, 640
CALIBRATION = 128
TARGET = 0.96
BLOCK_ROWS = 16_000
CHUNK_QUERIES = 2_000
MOST_LEVELS = 12
_INF = float("inf")


@dataclass
class KMeansTree:
    """Nodes by number, 0 the root: centre, children (none in a leaf), number of the leaf or -1."""

    centres: np.ndarray
    children: list[list[int]]
    leaf_of: list[int]
    leaves: list[int] = field(default_factory=list)

    def assign(self, vectors: np.ndarray) -> np.ndarray:
        """The leaf of each vector."""
        out = np.zeros(len(vectors), np.int32)
        waiting = [(0, np.arange(len(vectors)))]
        while waiting:
            node, rows = waiting.pop()
            below = self.children[node]
            if not below:
                out[rows] = self.leaf_of[node]
                continue
            nearest = _squares(vectors[rows], self.centres[below]).argmin(axis=1)
            waiting += [(child, rows[nearest == k]) for k, child in enumerate(below) if (nearest == k).any()]
        return out

    def best_bins(self, query: np.ndarray):
        """(leaf, squared distance of its centre) in the order in which a priority queue over branches reaches them."""
        queue = [(0.0, 0)]
        while queue:
            away, node = heapq.heappop(queue)
            below = self.children[node]
            if not below:
                yield self.leaf_of[node], away
                continue
            far = ((self.centres[below] - query) ** 2).sum(axis=1)
            for d, child in zip(far.tolist(), below):
                heapq.heappush(queue, (d, child))


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a**2).sum(axis=1)[:, None] + (b**2).sum(axis=1)[None, :] - 2 * a @ b.T


def _split(vectors: np.ndarray, rng: np.random.Generator, rounds: int = 12) -> np.ndarray:
    """k-means labels of at most BRANCHES groups; vectors aren't all equal."""
    centres = vectors[rng.choice(len(vectors), min(BRANCHES, len(vectors)), replace=False)]
    labels = None
    for _ in range(rounds):
        new = _squares(vectors, centres).argmin(axis=1)
        if labels is not None and (new == labels).all():
            break
        labels = new
        centres = np.stack([vectors[labels == k].mean(axis=0) if (labels == k).any() else centres[k] for k in range(len(centres))])
    return labels


def fit_tree(sample: np.ndarray, leaf_sample: int = LEAF_SAMPLE, seed: int = 5) -> KMeansTree:
    rng = np.random.default_rng(seed)
    tree = KMeansTree(np.zeros((0, sample.shape[1])), [], [])
    centres: list[np.ndarray] = []
    waiting = [(-1, np.arange(len(sample)))]
    while waiting:
        parent, rows = waiting.pop()
        node = len(centres)
        centres.append(sample[rows].mean(axis=0))
        tree.children.append([])
        tree.leaf_of.append(-1)
        if parent >= 0:
            tree.children[parent].append(node)
        labels = _split(sample[rows], rng) if len(rows) > leaf_sample and np.ptp(sample[rows], axis=0).any() else np.zeros(1)
        groups = [rows[labels == k] for k in np.unique(labels)] if len(labels) > 1 else []
        if len(groups) > 1:
            waiting += [(node, g) for g in groups]
        else:
            tree.leaf_of[node] = len(tree.leaves)
            tree.leaves.append(node)
    tree.centres = np.stack(centres)
    return tree


@dataclass(frozen=True)
class Sizes:
    """The module's bounds as they are on the driver, which tasks go by."""

    least: int
    cell: int
    block: int

    def leaf_sample(self, sample: int, rows: int) -> int:
        """Sample rows of a leaf so that it stands for about cell of all rows."""
        return max(self.least, self.cell * sample // max(1, rows))

    def block_of(self, leaf: int, leaves: int, rows: int) -> int:
        """The block of a leaf, where all leaves in order make blocks of about block rows."""
        return leaf * max(1, -(-rows // self.block)) // leaves


def nearest_in_block(queries: np.ndarray, query_ids: np.ndarray, rows: np.ndarray, row_ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row, score) as positions and exact distances: for each query at least its k nearest rows of other ids."""
    found = []
    for at in range(0, len(queries), 256):
        q, ids = queries[at : at + 256], query_ids[at : at + 256]
        rough = _squares(q, rows)
        rough[ids[:, None] == row_ids[None, :]] = _INF
        nth = min(k, rough.shape[1]) - 1
        kth = np.partition(rough, nth, axis=1)[:, nth]
        # The product rounds otherwise than the difference: whatever may be among the k is measured.
        slack = 1e-9 * (1 + (q**2).sum(axis=1) + (rows**2).sum(axis=1).max())
        near_q, near_row = np.nonzero((rough <= (kth + slack)[:, None]) & (rough < _INF))
        found.append((at + near_q, near_row, np.sqrt(((rows[near_row] - q[near_q]) ** 2).sum(axis=1))))
    return tuple(np.concatenate(part) for part in zip(*found))


def _nearest(found: pd.DataFrame, k: int) -> pd.DataFrame:
    return found.sort_values(["query_id", "score", "vec_id"], kind="stable").groupby("query_id").head(k)


def _matrix(column) -> np.ndarray:
    if isinstance(column, (pa.ListArray, pa.ChunkedArray)):
        flat = column.flatten() if isinstance(column, pa.ListArray) else column.combine_chunks().flatten()
        return flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1) if len(column) else np.zeros((0, 1))
    return np.stack(column.to_list()).astype(np.float64)


def usable(vector: Column, dims: int) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(_INF)))
    return F.coalesce((F.size(vector) == dims) & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def _top(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def exact_neighbours(rows: DataFrame, query_ids: np.ndarray, queries: np.ndarray, k: int) -> DataFrame:
    """(query_id, vec_id, score, vec, rank) for a bounded set of queries against all rows, in blocks."""

    def work(batches):
        best = None
        for batch in batches:
            if batch.num_rows == 0:
                continue
            vectors, ids = _matrix(batch.column("vec")), batch.column("vec_id").to_numpy()
            at, row, score = nearest_in_block(queries, query_ids, vectors, ids, k)
            found = _nearest(pd.DataFrame({"query_id": query_ids[at], "vec_id": ids[row], "score": score, "row": row}), k)
            found["vec"] = list(vectors[found["row"].to_numpy(np.int64)])
            best = found if best is None else _nearest(pd.concat([best, found]), k)
        if best is not None and len(best):
            yield pa.RecordBatch.from_pydict({"query_id": pa.array(best["query_id"], pa.int64()), "vec_id": pa.array(best["vec_id"], pa.int64()), "score": pa.array(best["score"], pa.float64()), "vec": pa.array(list(best["vec"]), pa.list_(pa.float64()))})

    return _top(rows.mapInArrow(work, "query_id long, vec_id long, score double, vec array<double>"), k)


def visits_needed(ranks: list[int | None], target: float) -> int | None:
    """The fewest visits that hold the target share of true neighbours, of which ranks has the visit (None: none of them)."""
    needed = sorted(r for r in ranks if r is not None)
    at = int(np.ceil(target * len(ranks))) - 1
    return 1 if not ranks else needed[at] if 0 <= at < len(needed) else None


def candidates(rows: DataFrame, k: int) -> DataFrame:
    """(vec_id, vec, times): of each vector the k + 1 smallest ids, and how often (k at most) each row occurs."""
    kinds = rows.groupBy("vec", "vec_id").agg(F.least(F.count(F.lit(1)), F.lit(k)).cast("int").alias("times"))
    place = F.row_number().over(Window.partitionBy("vec").orderBy("vec_id"))
    return kinds.withColumn("place", place).where(F.col("place") <= k + 1).select("vec_id", "vec", "times")


class _Search:
    """Rows placed in cells and the cells that queries visit, split level by level."""

    def __init__(self, rows: DataFrame, queries: DataFrame, k: int, target: float):
        self.k, self.target = k, target
        self.sizes = Sizes(LEAF_SAMPLE, CELL_ROWS, BLOCK_ROWS)
        self.spark, self.queries = rows.sparkSession, queries
        self.total = rows.count()
        hashed = F.xxhash64("vec_id", F.lit(3))
        tried = {r["vec_id"]: np.array(r["vec"], np.float64) for r in least_hashed(queries, hashed, CALIBRATION, "vec_id", "vec").collect()}
        self.tried = tried
        self.truth = exact_neighbours(rows, np.array(list(tried)), np.stack(list(tried.values())), k).collect() if tried else []
        sample = _matrix(least_hashed(rows, hashed, SAMPLE_ROWS, "vec_id", "vec").select("vec").toArrow().column("vec"))
        self.tree = fit_tree(sample, self.sizes.leaf_sample(len(sample), self.total))
        self.shared = self.spark.sparkContext.broadcast(self.tree)
        self.placed = self._top_cells(rows)
        self.asking = self._top_visits()

    def _top_cells(self, rows: DataFrame) -> DataFrame:
        shared, total, leaves, sizes = self.shared, self.total, len(self.tree.leaves), self.sizes

        def assign(batches):
            for batch in batches:
                leaf = shared.value.assign(_matrix(batch.column("vec"))).tolist() if batch.num_rows else []
                block = [str(sizes.block_of(i, leaves, total)) for i in leaf]
                more = [pa.array(list(map(str, leaf)), pa.string()), pa.array(block, pa.string())]
                yield pa.RecordBatch.from_arrays([*batch.columns, *more], [*batch.schema.names, "cell", "block"])

        given = candidates(rows, self.k)
        return staged(given.mapInArrow(assign, given.select("*", F.lit("").alias("cell"), F.lit("").alias("block")).schema), "cells")

    def _top_visits(self) -> DataFrame:
        tree, total, k, sizes = self.tree, self.total, self.k, self.sizes
        # One number for each leaf of a tree of bounded size.
        held = {int(r["cell"]): r["n"] for r in self.placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()}
        orders = {q: {leaf: i + 1 for i, (leaf, _) in enumerate(tree.best_bins(v))} for q, v in self.tried.items()}
        where = tree.assign(np.array([r["vec"] for r in self.truth])).tolist() if self.truth else []
        # The levels below lose some again.
        target = self.target if max(held.values(), default=0) <= SPLIT_ROWS else 1 - (1 - self.target) / 2
        visits = visits_needed([orders[r["query_id"]][leaf] for r, leaf in zip(self.truth, where)], target) or len(tree.leaves)
        shared = self.shared

        def visit(batches):
            tree = shared.value
            for batch in batches:
                out = []
                for q, vec in zip(batch.column("vec_id").to_pylist(), _matrix(batch.column("vec"))):
                    met = 0
                    for n, (leaf, away) in enumerate(tree.best_bins(vec)):
                        if n >= visits and met > 4 * k:
                            break
                        if leaf in held:
                            met += held[leaf]
                            out.append((q, str(leaf), str(sizes.block_of(leaf, len(tree.leaves), total)), away))
                yield _visit_rows(out)

        self.visits = visits
        return staged(self.queries.select("vec_id", "vec").mapInArrow(visit, VISITS), "visits")

    def split(self) -> bool:
        """Split the cells that hold too many rows; False if there are none, or none can be."""
        large = self.placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > SPLIT_ROWS)
        large = staged(large, "large-cells")
        trees = staged(self._trees(large).where("leaves > 1"), "cell-trees")
        if trees.isEmpty():
            return False
        self.placed = self._split_rows(trees)
        self.asking = self._split_visits(trees)
        return True

    def _trees(self, large: DataFrame) -> DataFrame:
        place = F.pmod(F.xxhash64("vec_id", "vec", F.lit(11)), F.lit(1 << 40)).cast("double") / F.lit(float(1 << 40))
        drawn = join_by_key(self.placed, large, "cell", "n", self.total).where(place < F.lit(float(SAMPLE_ROWS)) / F.col("n"))

        sizes = self.sizes

        def fit(rows: pd.DataFrame) -> pd.DataFrame:
            rows = rows.sort_values("vec_id", kind="stable")
            tree = fit_tree(_matrix(rows["vec"]), sizes.leaf_sample(len(rows), int(rows["n"].iloc[0])))
            return pd.DataFrame({"cell": [rows["cell"].iloc[0]], "n": [int(rows["n"].iloc[0])], "leaves": [len(tree.leaves)], "tree": [pickle.dumps(tree)]})

        return drawn.select("cell", "n", "vec_id", "vec").groupBy("cell").applyInPandas(fit, "cell string, n long, leaves int, tree binary")

    def _split_rows(self, trees: DataFrame) -> DataFrame:
        columns, sizes = self.placed.columns, self.sizes
        chunks = F.ceil(F.col("n") / F.lit(BLOCK_ROWS)).cast("int")
        facts = trees.select("cell", F.col("n").alias("held"), chunks.alias("chunks"))
        known = join_by_key(self.placed, facts, "cell", "held", self.total, how="left")
        stay = known.where("held is null").select(*columns)
        go = known.where("held is not null").select("cell", F.pmod(F.xxhash64("vec_id", "vec"), F.col("chunks")).cast("int").alias("c"), "vec_id", "vec", "times", "block")
        each = trees.withColumn("c", F.explode(F.sequence(F.lit(0), chunks - 1)))

        def place(rows: pd.DataFrame, of: pd.DataFrame) -> pd.DataFrame:
            n, leaves, tree = int(of["n"].iloc[0]), int(of["leaves"].iloc[0]), pickle.loads(of["tree"].iloc[0])
            leaf = tree.assign(_matrix(rows["vec"]))
            rows = rows[columns].copy()
            if n > sizes.block:
                rows["block"] = [f"{c}:{sizes.block_of(int(i), leaves, n)}" for c, i in zip(rows["cell"], leaf)]
            rows["cell"] = [f"{c}/{i}" for c, i in zip(rows["cell"], leaf)]
            return rows

        gone = go.groupBy("cell", "c").cogroup(each.groupBy("cell", "c")).applyInPandas(lambda a, b: place(a, b) if len(a) else a[columns], self.placed.schema)
        return staged(stay.unionByName(gone), "cells")

    def _entered(self, asking: DataFrame, trees: DataFrame, most: int) -> DataFrame:
        """asking with the cells of trees replaced by up to most of their own, and of each query the most nearest."""
        asked = asking.groupBy("cell").agg(F.count(F.lit(1)).alias("asked"))
        parts = F.ceil(F.col("asked") / F.lit(CHUNK_QUERIES)).cast("int")
        facts = staged(trees.select("cell").join(asked, "cell").withColumn("parts", parts), "asked-cells")
        known = join_by_key(asking, facts, "cell", "asked", asking.count(), how="left")
        stay = known.where("parts is null").select(*asking.columns)
        go = known.where("parts is not null").withColumn("c", F.pmod(F.xxhash64("query_id"), F.col("parts")).cast("int"))
        go = go.join(self.queries.select(F.col("vec_id").alias("query_id"), F.col("vec").alias("query")), "query_id")
        go = go.select("cell", "c", "query_id", "block", "query")
        each = trees.join(facts.select("cell", F.col("parts").alias("of")), "cell").select("cell", "n", "leaves", "tree", F.explode(F.sequence(F.lit(0), F.col("of") - 1)).alias("c"))

        sizes = self.sizes

        def enter(asking: pd.DataFrame, of: pd.DataFrame) -> pd.DataFrame:
            out = []
            if len(asking) and len(of):
                n, leaves, tree = int(of["n"].iloc[0]), int(of["leaves"].iloc[0]), pickle.loads(of["tree"].iloc[0])
                for q, cell, block, vec in zip(asking["query_id"], asking["cell"], asking["block"], _matrix(asking["query"])):
                    for i, (leaf, away) in enumerate(tree.best_bins(vec)):
                        if i >= most:
                            break
                        out.append((q, f"{cell}/{leaf}", f"{cell}:{sizes.block_of(leaf, leaves, n)}" if n > sizes.block else block, away))
            return _visit_rows(out).to_pandas()

        inner = go.groupBy("cell", "c").cogroup(each.groupBy("cell", "c")).applyInPandas(enter, VISITS)
        nth = F.row_number().over(Window.partitionBy("query_id").orderBy("away", "cell"))
        return stay.unionByName(inner).withColumn("nth", nth).where(F.col("nth") <= most)

    def _split_visits(self, trees: DataFrame) -> DataFrame:
        """Calibrated anew: visits of the tried queries are widened until they hold enough of their true neighbours."""
        ids = self.spark.createDataFrame([(q,) for q in self.tried], "query_id long")
        true = self.spark.createDataFrame([(r["query_id"], r["vec_id"]) for r in self.truth], "query_id long, vec_id long")
        some = staged(self.asking.join(F.broadcast(ids), "query_id", "left_semi"), "tried")
        where = staged(self.placed.join(F.broadcast(true), "vec_id").select("query_id", "vec_id", "cell").distinct(), "true-cells")
        most, reached = max(16, 2 * self.visits), -1
        while True:
            found = self._entered(some, trees, most).select("query_id", "cell", "nth")
            # One row for each true neighbour of a bounded number of queries.
            ranks = [r["nth"] for r in where.join(found, ["query_id", "cell"], "left").groupBy("query_id", "vec_id").agg(F.min("nth").alias("nth")).collect()]
            held = sum(r is not None for r in ranks)
            needed = visits_needed(ranks, self.target)
            if needed is None and held == reached:  # the others lie in cells that the levels above don't visit
                needed = max(r for r in ranks if r is not None) if held else most
            if needed is not None:
                break
            reached, most = held, 4 * most
        self.visits = needed
        return staged(self._entered(self.asking, trees, needed).drop("nth"), "visits")

    def found(self) -> DataFrame:
        k, total = self.k, self.total
        met = self.asking.groupBy("query_id", "block").agg(F.collect_list("cell").alias("cells"))
        met = met.join(self.queries.select(F.col("vec_id").alias("query_id"), F.col("vec").alias("query")), "query_id")
        met = staged(met, "met")
        asked = met.groupBy("block").agg(F.count(F.lit(1)).alias("asked"))
        held = self.placed.groupBy("block").agg(F.count(F.lit(1)).alias("held"))
        parts = lambda n, most: F.ceil(F.col(n) / F.lit(most)).cast("int")
        facts = staged(asked.join(held, "block").select("block", "asked", "held", parts("asked", CHUNK_QUERIES).alias("parts"), parts("held", 2 * BLOCK_ROWS).alias("chunks")), "blocks")
        chunk = lambda count, *of: F.pmod(F.xxhash64(*of), F.col(count)).cast("int")
        all_of = lambda count: F.explode(F.sequence(F.lit(0), F.col(count) - 1))
        left = join_by_key(met, facts, "block", "asked", met.count()).withColumn("q", chunk("parts", "query_id")).withColumn("c", all_of("chunks"))
        right = join_by_key(self.placed, facts, "block", "held", total).withColumn("c", chunk("chunks", "vec_id", "vec")).withColumn("q", all_of("parts"))

        def pair(asking: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
            out = []
            if len(asking) and len(rows):
                rows = rows.sort_values(["cell", "vec_id"], kind="stable")
                vectors, ids, times = _matrix(rows["vec"]), rows["vec_id"].to_numpy(), rows["times"].to_numpy()
                known, first = np.unique(rows["cell"].to_numpy(), return_index=True)
                at = dict(zip(known, zip(first.tolist(), [*first[1:].tolist(), len(rows)])))
                queries, query_ids = _matrix(asking["query"]), asking["query_id"].to_numpy()
                visitors: dict[str, list[int]] = {}
                for i, cells in enumerate(asking["cells"]):
                    for cell in cells:
                        visitors.setdefault(cell, []).append(i)
                for cell, who in visitors.items():
                    if cell in at:
                        start, stop = at[cell]
                        i, row, score = nearest_in_block(queries[who], query_ids[who], vectors[start:stop], ids[start:stop], k)
                        out.append(pd.DataFrame({"query_id": query_ids[who][i], "vec_id": ids[start:stop][row], "score": score, "times": times[start:stop][row]}))
            if not out:
                return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
            found = _nearest(pd.concat(out), k)
            return _nearest(found.iloc[np.repeat(np.arange(len(found)), found["times"])], k)[["query_id", "vec_id", "score"]]

        keys = ["block", "c", "q"]
        left = left.select(*keys, "query_id", "query", "cells")
        right = right.select(*keys, "vec_id", "vec", "times", "cell")
        near = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(pair, "query_id long, vec_id long, score double")
        return _top(near, k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


VISITS = "query_id long, cell string, block string, away double"


def _visit_rows(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * 4
    types = [pa.int64(), pa.string(), pa.string(), pa.float64()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["query_id", "cell", "block", "away"])


def search(vectors: DataFrame, k: int = 10, every: int = 100, target: float = TARGET, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): neighbours of each row whose id every divides."""
    spark = vectors.sparkSession
    ship_package(spark)
    given = vectors.select(vectors[id_column].cast("long").alias("vec_id"), vectors[vector_column].alias("vec")).where("vec_id is not null and vec is not null")
    lengths = given.groupBy(F.size("vec").alias("dims")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "dims").first()
    schema = "query_id long, rank int, vec_id long, score double"
    if lengths is None:
        return spark.createDataFrame([], schema)
    rows = given.where(usable(F.col("vec"), lengths["dims"]))
    queries = staged(rows.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("vec").alias("vec")), "queries")
    if queries.isEmpty():
        return spark.createDataFrame([], schema)
    searching = _Search(rows, queries, k, target)
    for _ in range(MOST_LEVELS):
        if not searching.split():
            break
    return searching.found()
