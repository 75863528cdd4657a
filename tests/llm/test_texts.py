"""Operators on documents, against brute force and on awkward rows."""

import base64
import hashlib
import itertools
import random
import re
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
import tiktoken
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from echofold.llm import bpe, language, line_dedup, mixing, simhash, spotsigs, token_counts, toxicity

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
PATTERN = public_tokenizers.PATTERN
SPACE = "\x20\x09-\x0D"
ENCODING = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=bpe.read_ranks(RANKS), special_tokens={})
TOKENIZER = Tokenizer.from_file(VOCABULARY)


def sha(data):
    return hashlib.sha256(data.encode() if isinstance(data, str) else data).hexdigest()


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def words(text):
    return re.findall(f"[^{SPACE}]+", text or "")


OPERATORS = {
    "mix": lambda docs: mixing.mix(docs),
    "mixed_documents": lambda docs: mixing.mixed_documents(docs),
    "drop_lines": lambda docs: line_dedup.drop_lines(docs, 40, 5),
    "dedup_documents": lambda docs: line_dedup.dedup_documents(docs, 40, 5),
    "identify": lambda docs: language.identify(docs, language.train(docs)),
    "near_duplicates": lambda docs: simhash.near_duplicates(docs),
    "one_of_each": lambda docs: simhash.one_of_each(docs),
    "count_tokens": lambda docs: token_counts.count_tokens(docs, VOCABULARY, 2048),
    "compare_with_next": lambda docs: spotsigs.compare_with_next(docs),
    "near_duplicate_classes": lambda docs: spotsigs.near_duplicate_classes(docs),
    "encode": lambda docs: bpe.encode(docs, RANKS, PATTERN),
    "score": lambda docs: toxicity.score(docs, toxicity.train(docs, docs.selectExpr("doc_id", "cast(doc_id % 2 as int) as toxic"))),
    "accepted": lambda docs: toxicity.accepted_documents(docs, docs.selectExpr("doc_id", "cast(doc_id % 2 as int) as toxic")),
}
#: Those that return the columns they got, and those that keep every row.
SAME_COLUMNS = {"mixed_documents", "dedup_documents", "one_of_each", "accepted"}
ALL_ROWS = set(OPERATORS) - {"mixed_documents", "one_of_each", "accepted"}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_awkward_rows_empty_tables_and_clashing_names(awkward, nothing, clashing, as_rows, name):
    plain = OPERATORS[name](awkward)
    extra = OPERATORS[name](clashing)
    assert OPERATORS[name](nothing).count() == 0
    if name in ALL_ROWS:
        assert plain.count() == awkward.count()
    if name in SAME_COLUMNS:
        assert plain.columns == awkward.columns and extra.columns == clashing.columns
        assert plain.schema.simpleString() == awkward.schema.simpleString()
    columns = [c for c in plain.columns if c in extra.columns]
    assert as_rows(plain, *columns) == as_rows(extra, *columns)


# 1


def test_mix_meets_targets(spark):
    rnd = random.Random(2)
    rows = [(i, "w " * int(rnd.lognormvariate(3, 1)), None, rnd.choice(["a"] * 8 + ["b", "c", "d", None])) for i in range(3000)]
    found = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()
    assert all(r.taken <= 2 * r.size and r.copies in (0, 1, 2) for r in found)
    totals = defaultdict(lambda: [0, 0, 0])
    for r in found:
        t = totals[r.source]
        t[0], t[1], t[2] = t[0] + r.taken, r.target, r.source_size
    sizes = {s: sum(len(words(t)) for _, t, _, x in rows if x == s) for s in totals}
    assert {s: t[2] for s, t in totals.items()} == sizes
    assert sum(t[1] for t in totals.values()) == pytest.approx(1.5 * sum(sizes.values()))
    for s, (taken, target, size) in totals.items():
        assert target <= 2 * size and abs(taken - target) <= 0.02 * target + 50
    assert sorted(map(tuple, found), key=repr) == sorted(map(tuple, mixing.mix(spark.createDataFrame(rows[::-1], "doc_id long, text string, lang string, source string").repartition(5)).collect()), key=repr)


@pytest.mark.parametrize("share", [0.3, 1.5, 1.99, 2.0, 5.0])
def test_targets_by_sharing_again_round_by_round(spark, share):
    rnd = random.Random(int(100 * share))
    sizes = {f"s{i:03d}": rnd.choice([0, 1, rnd.randrange(50), rnd.randrange(100_000)]) for i in range(90)} | {None: 700}
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sorted(sizes, key=lambda s: (s is None, s)))}
    budget, capped = share * sum(sizes.values()), set()
    while len(capped) < len(sizes):
        rate = (budget - sum(2 * sizes[s] for s in capped)) / sum(weight[s] for s in sizes if s not in capped)
        above = {s for s in sizes if s not in capped and weight[s] * rate > 2 * sizes[s]}
        if not above:
            break
        capped |= above
    expected = {s: 2.0 * sizes[s] if s in capped else weight[s] * rate for s in sizes}
    table = spark.createDataFrame([(s is None, s or "", 1, n) for s, n in sizes.items()], "no_source boolean, source_key string, n long, source_size long").repartition(3)
    found = {None if r.no_source else r.source_key: r.target for r in mixing.source_targets(table, share=share).collect()}
    assert found == pytest.approx(expected)


def test_mixed_documents_are_the_plan(awkward):
    plan = mixing.mix(awkward).collect()
    assert mixing.mixed_documents(awkward).count() == sum(r.copies for r in plan)


# 2


def brute_lines(docs):
    def keys(text):
        for part in (text or "").split("\n"):
            key = lower(part.strip("\x20\t\n\x0b\x0c\r"))
            yield part, key if len(key) >= 40 else None

    holders = defaultdict(set)
    for d, text in docs:
        for _, key in keys(text):
            if key:
                holders[key].add(d)
    out = []
    for d, text in docs:
        parts = list(keys(text))
        kept = [p for p, k in parts if not (k and len(holders[k]) >= 5 and d != max(x for x in holders[k] if x is not None))]
        out.append((d, len(parts), len(parts) - len(kept), sha("\n".join(kept))))
    return sorted(out, key=repr)


def test_lines(awkward, as_rows):
    docs = [(r.doc_id, r.text) for r in awkward.collect()]
    found = as_rows(line_dedup.drop_lines(awkward, 40, 5), "doc_id", "n_lines", "n_dropped", "kept_sha256")
    assert found == brute_lines(docs) and any(r[2] for r in found)
    texts = {r.doc_id: r.text for r in line_dedup.dedup_documents(awkward, 40, 5).collect()}
    assert texts[40] is None and len(texts[1].split("\n")) == 2


# 3


def test_language(spark, data, as_rows):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    model = language.train(docs)
    found = {r.doc_id: r for r in language.identify(docs, model).collect()}
    truth = {r.doc_id: r.lang for r in docs.collect()}
    held = [d for d, r in found.items() if r.held_out]
    assert sum(found[d].lang_pred == truth[d] for d in held) / len(held) > 0.95
    assert all(0 <= r.score <= 1 for r in found.values())
    import zlib

    assert all(r.held_out == (zlib.crc32(str(d).encode()) % 3 == 1) for d, r in found.items())
    assert model.predict([None, "", "12 !", " \n"])[0] == ["und"] * 4


def plain_grams(text):
    text = re.sub(" +", " ", "".join(c if c.isalpha() else " " for c in text.lower()))
    return {text[i : i + n] for n in (1, 2, 3) for i in range(len(text) - n + 1)}


def test_grams():
    grams = language.Grams()
    for t in ["the river walks", "Der Fluß -- geht  weiter!", "漢字 漢", "a", " ", "12 !"]:
        assert grams.distinct(grams.ids(t)) == len(plain_grams(t)) == len(set(grams.ids(t).tolist()))
    assert all(len(grams.set_of(t)) == 0 for t in (None, "", "12 !"))


def test_kernel_ridge_by_definition(spark):
    """Nyström ridge regression from sets of n-grams, against the trained model's regressions of whole texts."""
    rnd = random.Random(21)
    plain = {"en": "the river walks under stone bright morning and of in".split(), "de": "der fluss geht weiter das haus am schöne straße und".split(), "fr": "la rivière est très belle où le matin çà et là".split()}
    docs = [(i, " ".join(rnd.choices(plain[lang], k=rnd.randrange(3, 25))), lang) for i in range(60) for lang in [rnd.choice(sorted(plain))]]
    table = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    model = language.train(table, landmarks=12, ridge=1e-3)
    taken = [(r.lang, r.nth, docs[r.doc_id][1]) for r in language.training_ids(table).collect()]
    sets = {(lang, nth): plain_grams(t) for lang, nth, t in taken}
    alike = lambda x, y: len(x & y) / (len(x) * len(y)) ** 0.5
    keys = sorted(sets)
    marks = sorted(sets, key=lambda k: (k[1], k[0]))[:12]
    values, vectors = np.linalg.eigh(np.array([[alike(sets[a], sets[b]) for b in marks] for a in marks]))
    keep = values > 1e-6 * values[-1]
    lift = lambda s: np.append(np.array([alike(s, sets[m]) for m in marks]) @ vectors[:, keep] / np.sqrt(values[keep]), 1.0)
    phi = np.array([lift(sets[k]) for k in keys])
    signs = np.array([[1.0 if k[0] == lang else -1.0 for lang in sorted(plain)] for k in keys])
    penalty = np.diag([1e-3 * len(keys)] * (phi.shape[1] - 1) + [1e-9])
    beta = np.linalg.solve(phi.T @ phi + penalty, phi.T @ signs)
    texts = [t for _, t, _ in docs]
    expected = np.array([lift(plain_grams(t)) @ beta for t in texts])
    assert model.languages == ["de", "en", "fr"] and np.abs(model.margins(texts) - expected).max() < 2e-2
    assert [model.languages[i] for i in expected.argmax(axis=1)] == model.predict(texts)[0]


def test_languages_of_other_scripts_and_rare_ones(spark):
    kinds = {"zh": "我们在河边走路看书山水", "ja": "これはとても美しい川です", "ru": "река течёт под мостом", "hi": "नदी पुल के नीचे बहती है"}
    rnd = random.Random(5)
    docs = [(i, "".join(rnd.choices(kinds[lang], k=60)), lang) for i in range(80) for lang in [sorted(kinds)[i % 4]]] + [(500 + i, "qxz wvk jjq", "xx") for i in range(2)]
    model = language.train(spark.createDataFrame(docs, "doc_id long, text string, lang string"))
    fresh = ["".join(rnd.choices(kinds[lang], k=60)) for lang in sorted(kinds)] + ["wvk qxz"]
    assert model.predict(fresh)[0] == [*sorted(kinds), "xx"]


def test_held_out_accuracy_on_the_tables(spark, data):
    docs = spark.read.parquet(f"{data.replace('sf0.001', 'sf0.1')}/documents.parquet")
    found = language.identify(docs, language.train(docs)).where("held_out").join(docs.select("doc_id", "lang").where("lang is not null"), "doc_id")
    right, n = found.selectExpr("count_if(lang = lang_pred)", "count(*)").first()
    assert n > 3000 and right / n >= 0.995


# 5


def brute_fingerprint(text):
    w = words(lower(text or ""))
    if not w:
        return 0
    runs = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or [" ".join(w)]
    hashes = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_roots(pairs):
    parent = list(range(len(pairs)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(pairs)):
        for j in range(i):
            if bin(pairs[i][1] ^ pairs[j][1]).count("1") <= 2:
                parent[root(i)] = root(j)
    return [root(i) for i in range(len(pairs))]


def brute_components(pairs):
    roots, least = brute_roots(pairs), {}
    for (d, _), r in zip(pairs, roots):
        if d is not None:
            least[r] = min(least.get(r, d), d)
    return sorted(((d, least.get(r)) for (d, _), r in zip(pairs, roots)), key=repr)


def test_fingerprints(awkward, as_rows):
    docs = [(r.doc_id, brute_fingerprint(r.text)) for r in awkward.collect()]
    assert as_rows(simhash.near_duplicates(awkward), "doc_id", "fingerprint") == sorted(((d, f"{f:016x}") for d, f in docs), key=repr)
    assert as_rows(simhash.near_duplicates(awkward), "doc_id", "component_id") == brute_components(docs)


@pytest.mark.parametrize("list_most", [2, 24, 10_000])
def test_links_lose_nothing(spark, as_rows, list_most):
    rnd = random.Random(4)
    found = []
    for _ in range(25):
        base = rnd.getrandbits(64)
        for _ in range(rnd.choice([1, 2, 5, 30])):
            x = base
            for _ in range(rnd.choice([0, 1, 1, 2, 3])):
                x ^= 1 << rnd.randrange(64)
            found.append((len(found), x))
    rnd.shuffle(found)
    df = spark.createDataFrame([(d, simhash._signed(x)) for d, x in found], "doc_id long, fp long")
    assert as_rows(simhash.labelled(df, list_most), "doc_id", "component_id") == brute_components(found)


def test_dense_lists_lose_nothing(spark, as_rows):
    """Most of them share six bytes, so that their lists are long at every depth."""
    rnd = random.Random(11)
    base = rnd.getrandbits(64)
    found = list({base ^ (rnd.getrandbits(16) << rnd.choice([0, 16, 40])) for _ in range(2500)} | {rnd.getrandbits(64) for _ in range(200)})
    place, parent = {x: i for i, x in enumerate(found)}, list(range(len(found)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    reach = [1 << i for i in range(64)] + [1 << i | 1 << j for i in range(64) for j in range(i)]
    for x, i in place.items():
        for r in reach:
            if (j := place.get(x ^ r)) is not None and root(i) != root(j):
                parent[max(root(i), root(j))] = min(root(i), root(j))
    df = spark.createDataFrame([(i, simhash._signed(x)) for x, i in place.items()], "doc_id long, fp long")
    assert as_rows(simhash.labelled(df), "doc_id", "component_id") == sorted(((i, root(i)) for i in range(len(found))), key=repr)


def test_lists_of_positions():
    for bits in (1, 2, 3):
        for depth in range(1, 9 - bits):
            for shared in itertools.combinations(range(8), 8 - bits):
                assert any(all(m >> p & 1 == 0 or p in shared for p in range(8)) for m in simhash.masks(depth, bits))


def test_one_of_each_group_stays(awkward):
    docs = [(r.doc_id, brute_fingerprint(r.text)) for r in awkward.collect()]
    groups = {c for _, c in brute_components(docs)}
    kept = [r.doc_id for r in simhash.one_of_each(awkward).collect()]
    assert set(kept) == groups and len(kept) == len(set(brute_roots(docs)))


# 7


@pytest.mark.parametrize("text", ["", "don't it's I'LL 12345", "x<|endoftext|>y<|startoftext|>", "ΟΔΟΣ İstanbul é \x1c\x85\u3000", "漢字 🙂🙂", "a" * 700, "!?" * 200, "Á ß ﬁ \x00"])
def test_token_counts(text):
    assert token_counts.counter(VOCABULARY).count(text) == len(TOKENIZER.encode(text, add_special_tokens=False).ids)


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60))
def test_token_counts_of_any_text(text):
    assert token_counts.counter(VOCABULARY).count(text) == len(TOKENIZER.encode(text, add_special_tokens=False).ids)


@pytest.mark.parametrize("form", ["%s", "ê%sê", "a 1%s!%s'%st"])
def test_token_counts_of_every_code_point(form):
    count, every = token_counts.counter(VOCABULARY).count, token_counts.code_points()
    assert len(every) == 0x110000 - 0x800
    for at in range(0, len(every), 100_000):
        texts = [form.replace("%s", c) for c in every[at : at + 100_000]]
        found = TOKENIZER.encode_batch(texts, add_special_tokens=False)
        assert [t for t, e in zip(texts, found) if count(t) != len(e.ids)] == []


def test_prefix_counts_equal_encoding_each_prefix():
    count = token_counts.counter(VOCABULARY)
    text = "they're unbelievable, wörld 12 i'd o'clock 'tis"
    assert count.prefix_counts(text) == [count.count(text[:i]) for i in range(len(text) + 1)]
    best = count.longest_prefix(text, 5)
    assert count.count(text[:best]) <= 5 < count.count(text[: best + 1])


# 8


def test_compare_with_next(awkward, as_rows):
    docs = sorted(((r.doc_id, r.text or "") for r in awkward.collect()), key=lambda r: (-(1 << 63) if r[0] is None else r[0], r[1]), reverse=True)
    found = spotsigs.compare_with_next(awkward).collect()
    unique = {d: t for d, t in docs if d is not None and sum(x == d for x, _ in docs) == 1}
    order = [d for d, _ in docs]
    for r in found:
        if r.doc_id in unique and unique.get(order[(order.index(r.doc_id) + 1) % len(order)]) is not None:
            own, following = unique[r.doc_id], docs[(order.index(r.doc_id) + 1) % len(docs)][1]
            half = len(own) // 2
            text = own[: len(own) - half] + following[:half]
            assert (r.n_chars, r.edited_sha256) == (len(own), sha(text))
            a, b, c = (spotsigs.signatures(t) for t in (own, text, following))
            assert r.near_edited == spotsigs.likeness(a, b) and r.near_next == spotsigs.likeness(a, c)
            assert (r.alike_edited, r.alike_next) == (r.near_edited >= 0.8, r.near_next >= 0.8)
            assert (r.fingerprint, r.edited_fingerprint) == (spotsigs.fingerprint(a), spotsigs.fingerprint(b))


def test_alike_is_the_coefficient_against_the_bound():
    rnd = random.Random(3)
    for _ in range(4000):
        a = set(rnd.sample(range(60), rnd.randrange(0, 40)))
        b = (a - set(rnd.sample(range(60), rnd.randrange(0, 12)))) | set(rnd.sample(range(60), rnd.randrange(0, 8)))
        for least in (0.5, 0.8, 1.0) if rnd.random() < 0.1 else (0.8,):
            assert spotsigs.alike(a, b, least) == (spotsigs.likeness(a, b) >= least - 1e-12), (a, b)


def spots(text):
    """Signatures by their definition, word by word: an anchor or a stand-in, and the next two content words."""
    found, words = set(), re.sub(r"[\x00-/:-@\[-`{-\x7f]", " ", text.lower()).split()
    anchors = [w.encode() in spotsigs.ANCHORS for w in words]
    for i, word in enumerate(words):
        last = max((j for j in range(i) if anchors[j]), default=-1)
        if anchors[i] or i - last > spotsigs.REACH:
            follow = [w for w, a in zip(words[i + 1 :], anchors[i + 1 :]) if not a]
            found.add(" ".join([word, *follow[:2]]))
    return found or {" ".join(words[i : i + 3]) for i in range(len(words))}


def test_signatures_by_definition():
    rnd = random.Random(14)
    for _ in range(300):
        text = " ".join(rnd.choice(["the", "of", "und", "river", "Stone", "glass", "paper", "x1", "seven,", "a-b"][: rnd.choice([5, 10])]) for _ in range(rnd.randrange(1, 40)))
        assert spotsigs.signatures(text) == {xxhash.xxh64_intdigest(x.encode()) for x in spots(text)}, text


def test_ids_that_are_not_numbers(spark):
    rows = [("b", "the river stone"), ("a", "of glass paper"), (None, "x"), ("c", None)]
    found = {r.doc_id: r for r in spotsigs.compare_with_next(spark.createDataFrame(rows, "doc_id string, text string")).collect()}
    assert found["b"].edited_sha256 == sha("the rive" + "of glas") and found["a"].edited_sha256 == sha("of glas" + "x") and found["c"].n_chars == 0
    assert found[None].edited_sha256 == sha("x")


def test_near_duplicate_classes(spark, as_rows):
    rnd = random.Random(12)
    plain = "the of and to in stone river green walks under bright morning glass paper window quiet number seven".split()
    docs = []
    for g in range(12):
        base = [rnd.choice(plain) for _ in range(120)]
        for _ in range(rnd.choice([1, 2, 6])):
            text = list(base)
            for _ in range(rnd.choice([0, 0, 1, 2, 8])):
                text[rnd.randrange(120)] = rnd.choice(plain)
            docs.append((len(docs), " ".join(text)))
    docs += [(500, ""), (501, None)]
    sigs = {d: spotsigs.signatures(t or "") for d, t in docs}
    parent = {d: d for d, _ in docs}

    def root(x):
        return x if parent[x] == x else root(parent[x])

    for a, _ in docs:
        for b, _ in docs:
            if a < b and spotsigs.likeness(sigs[a], sigs[b]) >= 0.8 and root(a) != root(b):
                parent[max(root(a), root(b))] = min(root(a), root(b))
    found = spotsigs.near_duplicate_classes(spark.createDataFrame(docs, "doc_id long, text string"))
    assert as_rows(found, "doc_id", "class_id") == sorted(((d, root(d)) for d, _ in docs), key=repr)


def test_signatures():
    text = "the quick fox of a forest runs"
    expected = {b"the quick fox", b"of forest runs", b"a forest runs"}
    assert spotsigs.signatures(text) == {xxhash.xxh64_intdigest(s) for s in expected}
    assert spotsigs.likeness(set(), set()) == 1.0 and spotsigs.likeness({1}, set()) == 0.0
    assert spotsigs.likeness({1, 2}, {2, 3}) == 1 / 3 and not spotsigs.alike({1}, set(range(9)), 0.5)


# 9


def encoded(text):
    return next(iter(bpe.encode_texts([text], RANKS, PATTERN)))


@pytest.mark.parametrize("text", ["", "a" * 3000, "ab" * 900, "don't  stop\n\n\tnow ", "漢字 🙂\x1c\x85\u3000", "!" * 500, "".join(random.Random(1).choice("etaoinshr") for _ in range(3000))])
def test_encoding(text):
    ids, joined, decoded = encoded(text)
    assert ids.tolist() == ENCODING.encode_ordinary(text) and decoded == text.encode() and joined == ",".join(map(str, ids.tolist()))
    assert bpe.decode(ids.tolist(), RANKS, PATTERN) == text.encode()


LETTERS = "abcdefghijklmnopqrstuvwxyz"
LONG = {
    "one letter": lambda rnd: "a" * 5_000_000,
    "random letters": lambda rnd: "".join(rnd.choices(LETTERS, k=2_000_000)),
    "base64": lambda rnd: base64.b64encode(rnd.randbytes(3_750_000)).decode(),
    "runs": lambda rnd: "".join(rnd.choice(["a" * rnd.randrange(1, 90), "b", "the"]) for _ in range(5000)),
    "one character of three bytes": lambda rnd: "漢" * 100_001,
    "signs": lambda rnd: "=" * 300_007 + "-=" * 90_000,
}


@pytest.mark.parametrize("kind", LONG)
def test_long_pieces(kind):
    text = LONG[kind](random.Random(8))
    ids, _, decoded = encoded(text)
    assert ids.tolist() == ENCODING.encode_ordinary(text) and decoded == text.encode()


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="ab \n'é漢=", min_size=90, max_size=700))
def test_pieces_put_together_from_chunks(text):
    ids, _, decoded = encoded(text.replace(" ", "a"))
    assert ids.tolist() == ENCODING.encode_ordinary(text.replace(" ", "a")) and decoded == text.replace(" ", "a").encode()


@settings(max_examples=60, deadline=None)
@given(st.text(max_size=80))
def test_round_trip_of_any_text(text):
    ids, _, decoded = encoded(text)
    assert decoded == text.encode() and ids.tolist() == ENCODING.encode_ordinary(text)


def test_encode_query(awkward):
    texts = {r.doc_id: r.text or "" for r in awkward.collect()}
    for r in bpe.encode(awkward, RANKS, PATTERN, with_ids=True).collect():
        if r.doc_id not in (None, 3, 5):
            ids = ENCODING.encode_ordinary(texts[r.doc_id])
            assert (r.n_tokens, r.ids_sha256, r.decoded_sha256, r.ids) == (len(ids), sha(",".join(map(str, ids))), sha(texts[r.doc_id]), ids)


# 10


def test_toxicity(spark):
    rnd = random.Random(6)
    plain = "the of and to in stone river green walks under bright morning glass paper window quiet number seven".split()
    rows, labels = [], []
    for i in range(2000):
        toxic = rnd.random() < 0.15
        text = [rnd.choice(plain) for _ in range(rnd.randrange(5, 60))]
        if toxic:
            text.insert(rnd.randrange(len(text)), rnd.choice(["scumbag", "worthless", "idiotic"]))
        rows.append((i, " ".join(text), "en", "s", 0))
        if i % 2:
            labels.append((i, int(toxic)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    model = toxicity.train(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    found = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    held = [(found[d].predicted, t) for d, t in labels if found[d].held_out]
    assert sum(p == t for p, t in held) / len(held) > 0.97
    assert all((r.score >= 0.3) == bool(r.predicted) and 0 <= r.score <= 1 for r in found.values())


def test_risk_and_its_slope():
    """The risk by its definition, and the slope by finite differences of what it stands for on either side of 0."""
    rnd = np.random.default_rng(2)
    xp, xu = (rnd.random((n, 5)) < share for n, share in ((7, 0.8), (30, 0.2)))
    seen = set()
    for prior in (0.05, 0.3, 0.9):
        for shift in (-3.0, 0.0, 3.0):
            theta = np.append(rnd.normal(size=5) + abs(shift) / 2, shift)
            sig = lambda x, t: 1 / (1 + np.exp(-(x @ t[:-1] + t[-1])))
            part = lambda t: sig(xu, t).mean() - prior * sig(xp, t).mean()
            goal = (lambda t: prior * (1 - sig(xp, t)).mean() + part(t)) if part(theta) >= 0 else (lambda t: -part(t))
            risk, slope, negative = toxicity.nnpu_risk(theta, xp.astype(np.float32), xu.astype(np.float32), prior)
            step = 1e-6 * np.eye(6)
            expected = [(goal(theta + s) - goal(theta - s)) / 2e-6 for s in step]
            assert np.allclose(slope, expected, atol=1e-7) and np.isclose(negative, part(theta))
            assert np.isclose(risk, prior * (1 - sig(xp, theta)).mean() + max(0.0, part(theta)))
            seen.add(negative >= 0)
    assert seen == {True, False}


def test_features_by_their_shares(spark):
    texts = [("P", "a bad word", 40), ("P", "a good one", 5), ("U", "a good one", 90), ("U", "a bad word", 3)]
    rows = [(role, sorted({f for w in toxicity.words_of(t) for f in toxicity.features_of(w)})) for role, t, n in texts for _ in range(n)]
    found = toxicity.choose_features(spark.createDataFrame(rows, "role string, features array<long>"), 45, 93, 10)
    assert sorted(found) == sorted(map(toxicity.feature, ["bad", "word"]))


def test_held_out_toxicity_on_the_tables(spark, data):
    folder = data.replace("sf0.001", "sf0.1")
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.train(docs, labels)
    found = toxicity.score(docs, model).where("held_out").join(labels.where("toxic is not null"), "doc_id").collect()
    pos, neg = ([r.score for r in found if r.toxic == t] for t in (1, 0))
    auc = np.mean([(p > n) + 0.5 * (p == n) for p in pos for n in neg])
    caught, called = sum(p >= 0.3 for p in pos), sum(r.predicted for r in found)
    assert len(pos) > 100 and auc >= 0.97 and caught / len(pos) >= 0.9 and caught / called >= 0.9


def test_toxicity_without_positives(awkward, spark):
    model = toxicity.train(awkward, spark.createDataFrame([(1, 0), (None, 1), (2, None)], "doc_id long, toxic int"))
    assert {r.score for r in toxicity.score(awkward, model).collect()} == {0.0}
