"""Near copies by word shingles against brute force."""

import random

import pytest

import corpus_pipeline
from echofold.llm import near_copies, simhash


def brute_set(text, size=5):
    words = (text or "").encode().lower().split()
    return {b" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))} if words else set()


def brute_labels(rows, least=0.8):
    """The smallest id of each row's component; ids are there and differ."""
    sets = [brute_set(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] | sets[j])
            if not both or len(sets[i] & sets[j]) / both >= least:
                parent[root(i)] = root(j)
    named = {}
    for i, (d, _) in enumerate(rows):
        named[root(i)] = min(named.get(root(i), d), d)
    return {named[root(i)] for i in range(len(rows))}


def texts():
    """Families of texts, with up to a word in twelve changed, some opening with one long common passage."""
    rnd = random.Random(11)
    word = lambda: f"w{rnd.randrange(5000)}"
    common = [word() for _ in range(60)]
    found = ["", " \n", None, "one two", "ONE  two", "one two three four five", "a b c d e f"]
    for family in range(14):
        base = [word() for _ in range(rnd.choice([12, 60, 200]))]
        if family % 3 == 0:
            base = common + base[:20]
        for _ in range(rnd.choice([1, 3, 30])):
            now = list(base)
            for _ in range(rnd.randrange(1 + len(now) // 12)):
                now[rnd.randrange(len(now))] = word()
            found.append(" ".join(now))
    rnd.shuffle(found)
    return list(enumerate(found))


@pytest.mark.parametrize("list_most", [1, 2, 4, 24])
def test_one_of_each_loses_no_link(spark, list_most):
    rows = texts()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = [r.doc_id for r in near_copies.one_of_each(docs, list_most=list_most).collect()]
    assert sorted(kept) == sorted(brute_labels(rows))


def test_no_result_depends_on_the_sample(spark, monkeypatch):
    monkeypatch.setattr(near_copies, "SAMPLE_TEXTS", 1)
    monkeypatch.setattr(near_copies, "PART_ENTRIES", 700)
    monkeypatch.setattr(near_copies, "CHUNK_PAIRS", 5)
    rows = texts()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id for r in near_copies.one_of_each(docs, list_most=4).collect()} == brute_labels(rows)


def test_stage_links_what_few_bits_miss(spark):
    """Two words of a hundred changed: five-word coefficient over 0.8, fingerprints several bits apart."""
    words = [f"word{i}" for i in range(100)]
    other = words[:30] + ["another"] + words[31:99] + ["last"]
    docs = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(other)), (3, "something else altogether is written here")], "doc_id long, text string")
    assert sorted(r.doc_id for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect()) == [1, 3]


def test_awkward_rows(spark, awkward, nothing, clashing):
    assert near_copies.one_of_each(nothing).count() == 0
    kept = near_copies.one_of_each(clashing)
    assert kept.columns == clashing.columns
    found = [r.doc_id for r in kept.collect()]
    rows = [(r.doc_id, r.text) for r in awkward.collect()]
    sets = [brute_set(t) for _, t in rows]
    assert {d for d in found if d is not None} <= {d for d, _ in rows}
    for d, t in rows:
        assert any(not (a | brute_set(t)) or len(a & brute_set(t)) / len(a | brute_set(t)) >= 0.8 for a in [brute_set(x) for y, x in rows if y in found])
    assert len(found) <= len({frozenset(s) for s in sets})


def test_unlike_texts_of_common_passages_are_not_compared(spark, monkeypatch):
    """Texts of ten of twenty passages: all lists are long, next to no pair shares enough of them."""
    rnd = random.Random(5)
    passages = [" ".join(f"p{i}w{j}" for j in range(12)) for i in range(20)]
    rows = [(i, "\n".join(rnd.sample(passages, 10))) for i in range(150)]
    rows += [(200 + i, rows[i][1] + " end") for i in range(20)]
    compared, scored = [], near_copies._scored

    def counted(pairs, *rest):
        compared.append(pairs.count())
        return scored(pairs, *rest)

    monkeypatch.setattr(near_copies, "_scored", counted)
    monkeypatch.setattr(near_copies, "HUB_BLOCK", 16, raising=False)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in near_copies.one_of_each(docs).collect()) == sorted(brute_labels(rows))
    assert sum(compared) < 1500


def test_stage_takes_pairs_from_fingerprints(spark, monkeypatch):
    """The pairs of op5's index over five-word fingerprints connect what brute force does at two bits, and are compared."""
    found, compared, links, scored = [], [], simhash.links, near_copies._scored

    def indexed(nodes, *rest, **more):
        found.append(links(nodes, *rest, **more))
        return found[-1]

    def checked(pairs, *rest):
        compared.extend({r.a, r.b} for r in pairs.collect())
        return scored(pairs, *rest)

    monkeypatch.setattr(simhash, "links", indexed)
    monkeypatch.setattr(near_copies, "_scored", checked)
    words = [f"word{i}" for i in range(2000)]
    rows = [(1, " ".join(words)), (2, " ".join(words[:1000] + ["another"] + words[1001:])), (3, "something else altogether is written here"), (4, " ".join(words[::-1]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect()) == [1, 3, 4]
    sims = {d: simhash.fingerprint(t.encode(), 5) for d, t in rows}
    near = {frozenset((sims[x], sims[y])) for x in sims for y in sims if x < y and 0 < (sims[x] ^ sims[y]).bit_count() <= 2}
    assert near and len(found) == 1
    assert {frozenset((r.a % 2**64, r.b % 2**64)) for r in found[0].collect()} == near
    assert {near_copies._set_id(near_copies.tokens_of(t.encode())) for _, t in rows[:2]} in compared
