"""URL filters, neighbours, and the pipeline."""

import math
import random

import duckdb
import numpy as np
import pytest

import corpus_pipeline
from echofold.llm import neighbours, queries, url_filter

# 4


def brute_verdict(url, rules):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
        path = rest[cut:]
        path = path[: min([path.find(c) for c in "?#" if c in path] or [len(path)])]
    fits = [(len(h + p), len(h), v == "allow", h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best[3] if best else None, best[4] if best else "allow"


URLS = [
    None, "", "no scheme", "http://", "://com/en/", "http://COM/en/1", "http://a.Example.com/en/7x?q#f", "http://xexample.com/en/7", "http://example.com", "http://example.com?x/en/", "http://n.net/de/8", "ftp://example.net/de/8",
    "http://a..com/en/", "http://com./en/", "http://org/es", "http://u@org/es/é🙂", "http://b.org:80/es/", "http://a.b.c.d.com/en/\nnext", "x://y://com/en/",
]


def test_urls(spark, as_rows):
    rows = [(i, u) for i, u in enumerate(URLS)] + [(None, "http://com/en/"), (6, URLS[6]), (6, URLS[6])]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    found = as_rows(url_filter.judge(pages, url_filter.rule_table(spark, url_filter.RULES)), "page_id", "host", "path", "rule", "verdict")
    assert found == sorted(((i, *brute_verdict(u, url_filter.RULES)) for i, u in rows), key=repr)


def test_many_nested_rules_over_many_ranges(spark, as_rows):
    rnd = random.Random(8)
    hosts = ["com", "a.com", "b.a.com", "org", "x.org"]
    rules = list({(h, p): (rnd.choice(["allow", "block"]), h, p) for h in hosts for p in ["/", "/x", "/x/", "/x/y", "/z"] if rnd.random() < 0.6}.values())
    rows = [(i, f"http://{rnd.choice(['', 'w.'])}{rnd.choice(hosts)}{rnd.choice(['/', '/x', '/x/y', '/x/yz', '/zz', '/q'])}{i % 7}") for i in range(600)]
    rows += [(1000 + i, "http://w.a.com/x/y") for i in range(300)]
    found = as_rows(url_filter.judge(spark.createDataFrame(rows, "page_id long, url string"), url_filter.rule_table(spark, rules)), "page_id", "host", "path", "rule", "verdict")
    assert found == sorted(((i, *brute_verdict(u, rules)) for i, u in rows), key=repr)


def test_pages_with_clashing_columns_and_last_code_points(spark, as_rows):
    from pyspark.sql import functions as F

    last = "\U0010ffff"
    urls = [*URLS, f"http://com/en/{last}", f"http://a.com/en/{last}{last}x", f"http://example.com/en/7{last}"] * 3
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    clashing = pages.select("*", *[F.lit("x").alias(c) for c in ("host", "path", "key", "rule", "verdict", "level", "tie", "bucket", "labels")])
    found = as_rows(url_filter.judge(clashing, url_filter.rule_table(spark, url_filter.RULES)), "page_id", "host", "path", "rule", "verdict")
    assert found == sorted(((i, *brute_verdict(u, url_filter.RULES)) for i, u in enumerate(urls)), key=repr)


def test_ranges_hold_whole_prefixes():
    from echofold.llm.common import RangeBuckets

    last = "\U0010ffff"
    points = sorted((k, t) for k in ["a", "ab", f"ab{last}", f"ab{last}{last}", "ac", "b"] for t in (1, 2))
    ranges = RangeBuckets(points)
    for key in ["", "a", "ab", f"ab{last}", "ac", "abz"]:
        for text in [key + x for x in ("", "a", last, last + last, last * 3 + "z")]:
            assert ranges.of(key, -(1 << 63)) <= ranges.of(text, 7) <= ranges.after_prefix(key)


def test_no_pages_no_rules(spark):
    pages = spark.createDataFrame([], "page_id long, url string, key string")
    assert url_filter.judge(pages, url_filter.rule_table(spark, url_filter.RULES)).count() == 0
    some = spark.createDataFrame([(1, "http://com/en/")], "page_id long, url string")
    assert [tuple(r) for r in url_filter.judge(some, url_filter.rule_table(spark, [])).collect()] == [(1, "com", "/en/", None, "allow")]


# 6


def brute_neighbours(rows, k=10, every=100, dims=8):
    usable = [(i, np.array(v, np.float64)) for i, v in rows if i is not None and v is not None and len(v) == dims and None not in v and np.isfinite(v).all() and any(v)]
    out = {}
    for i, q in usable:
        if i % every == 0:
            out[i] = sorted((float(np.sqrt(((q - v) ** 2).sum())), j) for j, v in usable if j != i)[:k]
    return out


def vectors(n, seed, copies=0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, 8))
    rows = [(i, (centres[rng.integers(12)] + 0.4 * rng.normal(size=8)).astype(np.float32).tolist()) for i in range(n)]
    same = rows[0][1]
    return rows + [(n + i, same) for i in range(copies)]


def test_recall_and_exact_scores(spark):
    rows = vectors(6000, 1, copies=3000)
    found = neighbours.search(spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(4)).collect()
    truth, got = brute_neighbours(rows), {}
    for r in found:
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    hits = 0
    exact = {i: np.array(v, np.float64) for i, v in rows}
    for q, near in truth.items():
        mine = sorted(got[q])
        assert [r for r, _, _ in mine] == list(range(1, 11)) and [(s, v) for _, v, s in mine] == sorted((s, v) for _, v, s in mine)
        assert all(s == np.sqrt(((exact[q] - exact[v]) ** 2).sum()) for _, v, s in mine)
        hits += len({v for _, v, _ in mine} & {v for _, v in near})
    assert hits >= 0.9 * 10 * len(truth)


def recall(found, truth):
    got = {(r.query_id, r.vec_id) for r in found}
    return sum((q, v) in got for q, near in truth.items() for _, v in near) / sum(map(len, truth.values()))


def test_recall_on_the_tables(spark, data):
    table = spark.read.parquet(f"{data.replace('sf0.001', 'sf0.1')}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in table.collect()]
    assert recall(neighbours.search(table).collect(), brute_neighbours(rows, dims=64)) >= 0.9


@pytest.fixture
def small_cells(monkeypatch):
    for name, value in {"SAMPLE_ROWS": 400, "LEAF_SAMPLE": 12, "CELL_ROWS": 24, "SPLIT_ROWS": 72, "BLOCK_ROWS": 500, "CHUNK_QUERIES": 7}.items():
        monkeypatch.setattr(neighbours, name, value)


def test_cells_split_level_by_level(spark, small_cells):
    rows = vectors(9000, 3, copies=4000)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(4)
    truth = brute_neighbours(rows)
    found = neighbours.search(df).collect()
    assert {r.query_id for r in found} == set(truth) and len(found) == 10 * len(truth)
    assert recall(found, truth) >= 0.9
    exact = {i: np.array(v, np.float64) for i, v in rows}
    assert all(r.score == np.sqrt(((exact[r.query_id] - exact[r.vec_id]) ** 2).sum()) for r in found)


def test_rows_scored_do_not_grow_with_the_table(spark, small_cells):
    scored = {}
    for n in (1500, 15_000):
        df = spark.createDataFrame(vectors(n, 5), "vec_id long, vec array<float>").repartition(4)
        queries = df.where("vec_id % 100 = 0")
        searching = neighbours._Search(df, queries, 10, 0.9)
        while searching.split():
            pass
        cells = {r["cell"]: r["count"] for r in searching.placed.groupBy("cell").count().collect()}
        assert max(cells.values()) <= 72
        scored[n] = sum(cells.get(r.cell, 0) for r in searching.asking.collect()) / queries.count()
    assert scored[15_000] < 2 * scored[1500], scored


def test_repeated_rows_and_ids(spark):
    rows = [(0, [0.0, 1.0])] * 3 + [(7, [0.0, 1.0])] * 15 + [(5, [0.0, 1.0])] + [(i, [0.0, 2.0 + i]) for i in range(20, 40)]
    found = neighbours.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert [(r.vec_id, r.score) for r in sorted(found, key=lambda r: r["rank"]) if r.query_id == 0] == [(5, 0.0)] + [(7, 0.0)] * 9


def test_awkward_vectors(spark):
    rows = vectors(150, 2) + [(200, None), (300, [0.0] * 8), (400, [1.0] * 7), (500, [math.nan] + [1.0] * 7), (600, [math.inf] * 8), (None, [1.0] * 8), (700, [None] + [1.0] * 7), (100, [5.0] * 8)]
    found = neighbours.search(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()
    assert {r.query_id for r in found} == {0, 100} and all(len([r for r in found if r.query_id == q]) == 10 for q in (0, 100))
    few = neighbours.search(spark.createDataFrame([(0, [1.0, 0.0], 1), (5, [1.0, 1.0], 1), (6, [1.0, 1.0], 1)], "vec_id long, embedding array<float>, leaf int")).collect()
    assert [(r.query_id, r.rank, r.vec_id, r.score) for r in sorted(few, key=lambda r: r["rank"])] == [(0, 1, 5, 1.0), (0, 2, 6, 1.0)]
    for given in ([], [(1, None)], [(1, [1.0, 2.0])]):
        assert neighbours.search(spark.createDataFrame(given, "vec_id long, embedding array<float>")).count() == 0


# Queries with SQL, and the pipeline


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, data, as_rows, name):
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    found = queries.QUERIES[name](spark, data)
    expected = con.execute(f"SELECT {', '.join(found.columns)} FROM ({queries.ORACLES[name]})").fetchall()
    assert as_rows(found, *found.columns) == sorted(expected, key=repr)


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLES)))
def test_query_runs_on_all_rows(spark, data, name):
    found = queries.QUERIES[name](spark, data)
    if name != "op6_neighbours":
        assert found.count() == spark.read.parquet(f"{data}/documents.parquet").count()
    else:
        assert found.groupBy("query_id").count().where("count <> 10").count() == 0


def test_pipeline_stage_by_stage(spark, data, as_rows):
    """Every stage against the operator's own decisions or brute force, on what its predecessor kept.

    Near copies are those of five words and a coefficient of 0.8, as the job has it for stages.
    """
    from echofold.llm import mixing, toxicity
    from tests.llm.test_near_copies import brute_labels
    from tests.llm.test_texts import ENCODING, brute_lines, sha

    docs = spark.read.parquet(f"{data}/documents.parquet")
    columns = docs.columns
    (_, toxic), (_, lines), (_, near), (_, mix), (_, encode) = corpus_pipeline.STAGES
    kept = toxic(spark, docs, data).cache()
    labels = spark.read.parquet(f"{data}/labels.parquet")
    rejected = {r.doc_id for r in toxicity.score(docs, toxicity.train(docs, labels)).where("predicted = 1").collect()}
    assert as_rows(kept, *columns) == [r for r in as_rows(docs, *columns) if r[0] not in rejected]
    cut = lines(spark, kept, data).cache()
    assert cut.columns == columns
    expected = {d: s for d, _, _, s in brute_lines([(r.doc_id, r.text) for r in kept.collect()])}
    assert {r.doc_id: sha(r.text) for r in cut.collect()} == expected
    one = near(spark, cut, data).cache()
    groups = brute_labels([(r.doc_id, r.text) for r in cut.collect()])
    assert as_rows(one, *columns) == [r for r in as_rows(cut, *columns) if r[0] in groups]
    mixed = mix(spark, one, data).cache()
    copies = {r.doc_id: r.copies for r in mixing.mix(one).collect()}
    assert as_rows(mixed, *columns) == sorted((r for r in as_rows(one, *columns) for _ in range(copies[r[0]])), key=repr)
    final = encode(spark, mixed, data)
    ids = {r.doc_id: ENCODING.encode_ordinary(r.text) for r in mixed.collect()}
    assert all(r.ids == ids[r.doc_id] and r.n_tokens == len(r.ids) for r in final.collect())
    assert as_rows(corpus_pipeline.run(spark, data), "doc_id", "ids_sha256") == as_rows(final, "doc_id", "ids_sha256")


def test_pipeline_on_awkward_and_empty_tables(spark, tmp_path, awkward, nothing, clashing):
    """Nulls, empty and long texts, repeated rows and ids, clashing names; then no documents, no labels."""
    labels = [(1, 0, 1), (None, 1, 1), (2, 1, None), (3, 0, 0), (99, 0, 1)]
    for name, docs, marks in (("awkward", awkward, labels), ("clashing", clashing, labels), ("nothing", nothing, []), ("unlabelled", awkward, [])):
        folder = tmp_path / name
        docs.write.parquet(f"file://{folder}/documents.parquet")
        spark.createDataFrame(marks, "doc_id long, quality int, toxic int").write.parquet(f"file://{folder}/labels.parquet")
        found = corpus_pipeline.run(spark, f"file://{folder}").collect()
        assert bool(found) == (name != "nothing")
        assert {r.doc_id for r in found} <= {r.doc_id for r in docs.collect()}
        assert all(r.n_tokens == len(r.ids) for r in found)
