"""Toxicity by non-negative positive-unlabelled learning.

A linear numpy classifier is trained from confirmed toxic texts (P) and unlabelled texts (U) with the
risk  prior * R_P(+) + max(0, R_U(-) - prior * R_P(-)) : the share of toxic text that U is bound to hold
is taken off its negative risk, and where the estimate turns negative the step is reversed. The prior is
the share of toxic rows among the labelled training rows. Features are the presence of words and of word
beginnings, chosen by how far their share of P exceeds their share of U.

The order of scores comes from that alone. A last logistic scaling of two numbers, which is supervised (it is
fitted on labelled training rows, toxic or not), turns margins into scores, so that a cut has a meaning.

Training takes a bounded sample: at most POSITIVES, LABELLED and UNLABELLED rows with the least hashes of
their ids among those with a text, each by its whole text. Texts become sets of features where they lie; the
driver gets the FEATURES chosen ones and, of each sampled row, which of those it has. Every row is scored by
its whole text.

Defined results: a null or empty text, or one without any chosen feature, gets the score of no evidence.
Contradicting labels of one id cancel; labels of null ids, or null, aren't used. Without any toxic
training row that has a text all scores are 0. Of rows that share an id the least text is learned from. Rows
with null ids are scored and count as not held out.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from echofold.llm.common import fold_of, held_out, least_hashed, map_batches, sampled_texts, texts_of, unpack_rows, whole_rows
from echofold.plans.staging import staged

FOLDS, HELD_FOLD = 4, 2
POSITIVES, UNLABELLED, LABELLED = 3000, 9000, 6000
FEATURES = 1500
LEAST_DOCS = 3
LEAST_GAIN = 4.0
BEGINNINGS = (4, 5, 6)
CUT = 0.3
EPOCHS, BATCH, RATE, DECAY = 40, 600, 0.02, 1e-4
CACHE_WORDS = 100_000

_BLANKS = bytes(32 if b < 128 and not chr(b).isalnum() else b for b in range(256))


def words_of(text: str) -> set[bytes]:
    return set(text.lower().encode("utf-8", "replace").translate(_BLANKS).split())


def feature(name: str) -> int:
    """A word, or a beginning of words with a star, is known by a hash of 64 bits."""
    found = xxhash.xxh64_intdigest(name.encode())
    return found - (1 << 64) if found >> 63 else found


def features_of(word: bytes) -> list[int]:
    plain = word.decode("utf-8", "replace")
    return [feature(plain), *(feature(f"{plain[:n]}*") for n in BEGINNINGS if len(plain) > n)]


@dataclass
class ToxicModel:
    index: dict[int, int]
    weights: np.ndarray
    bias: float
    scale: float = 1.0
    shift: float = 0.0

    def __post_init__(self):
        self.cache: dict[bytes, tuple[int, ...]] = {}

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "cache"}

    def __setstate__(self, state):
        self.__dict__.update(state, cache={})

    def present(self, text: str) -> list[int]:
        cache, index, found = self.cache, self.index, set()
        if len(cache) > CACHE_WORDS:
            cache.clear()
        for word in words_of(text):
            hits = cache.get(word)
            if hits is None:
                hits = cache[word] = tuple(index[f] for f in features_of(word) if f in index)
            if hits:
                found.update(hits)
        return sorted(found)

    def margins(self, present: list[list[int]]) -> np.ndarray:
        return np.array([self.weights[p].sum() + self.bias for p in present], np.float64)

    def scores(self, texts: list[str]) -> np.ndarray:
        if not self.index:
            return np.zeros(len(texts))
        return _sigmoid(self.scale * self.margins([self.present(t) for t in texts]) + self.shift)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -40, 40)))


def _log_likelihood(k: Column, n: Column, share: Column) -> Column:
    share = F.least(F.greatest(share, F.lit(1e-12)), F.lit(1 - 1e-12))
    return k * F.log(share) + (n - k) * F.log(1 - share)


def choose_features(found: DataFrame, n: int, m: int, most: int) -> list[int]:
    """The features more frequent in P (n rows) than in U (m rows), by the log-likelihood ratio of the two shares.

    found (role, features): the features of each sampled row.
    """
    each = found.select("role", F.explode("features").alias("feature"))
    counts = each.groupBy("feature").agg(F.count_if(F.col("role") == "P").cast("double").alias("p"), F.count_if(F.col("role") == "U").cast("double").alias("u"))
    p, u, n, m = F.col("p"), F.col("u"), F.lit(float(n)), F.lit(float(m))
    joint = (p + u) / (n + m)
    gain = _log_likelihood(p, n, p / n) + _log_likelihood(u, m, u / m) - _log_likelihood(p, n, joint) - _log_likelihood(u, m, joint)
    useful = counts.where((p >= LEAST_DOCS) & (p / n > u / m)).select("feature", F.round(gain, 9).alias("gain")).where(F.col("gain") >= LEAST_GAIN)
    return [r["feature"] for r in useful.orderBy(F.desc("gain"), "feature").limit(most).collect()]


def _matrix(present: list[list[int]], width: int) -> np.ndarray:
    out = np.zeros((len(present), width), np.float32)
    for i, columns in enumerate(present):
        out[i, columns] = 1.0
    return out


def nnpu_risk(theta: np.ndarray, xp: np.ndarray, xu: np.ndarray, prior: float) -> tuple[float, np.ndarray, float]:
    """The risk with the sigmoid loss, the slope of the step to take, and the negative part before it is cut at 0.

    theta holds the weights and, last, the bias. Where the negative part is below 0 the step climbs out of it.
    """
    sp, su = _sigmoid(xp @ theta[:-1] + theta[-1]), _sigmoid(xu @ theta[:-1] + theta[-1])
    dp, du = sp * (1 - sp) / len(xp), su * (1 - su) / len(xu)
    negative = su.mean() - prior * sp.mean()
    gp, gu = (-2 * prior * dp, du) if negative >= 0 else (prior * dp, -du)
    slope = np.append(gp @ xp + gu @ xu, gp.sum() + gu.sum())
    return prior * (1 - sp.mean()) + max(0.0, negative), slope, negative


def train_nnpu(xp: np.ndarray, xu: np.ndarray, prior: float, seed: int = 7) -> tuple[np.ndarray, float]:
    """Weights and bias by Adam on the non-negative risk."""
    rng = np.random.default_rng(seed)
    theta = np.zeros(xp.shape[1] + 1)
    mean, square, t = np.zeros_like(theta), np.zeros_like(theta), 0
    theta[-1] = -1.0
    for _ in range(EPOCHS):
        order = rng.permutation(len(xu))
        for at in range(0, len(order), BATCH):
            bp = xp[rng.integers(0, len(xp), min(len(xp), BATCH // 2))]
            slope = nnpu_risk(theta, bp, xu[order[at : at + BATCH]], prior)[1] + DECAY * theta
            t += 1
            mean = 0.9 * mean + 0.1 * slope
            square = 0.999 * square + 0.001 * slope**2
            theta -= RATE * (mean / (1 - 0.9**t)) / (np.sqrt(square / (1 - 0.999**t)) + 1e-8)
    return theta[:-1], float(theta[-1])


def fit_scale(margins: np.ndarray, toxic: np.ndarray) -> tuple[float, float]:
    """Slope and intercept of the logistic curve of labels over margins, by Newton steps."""
    a, b = 1.0, 0.0
    for _ in range(50):
        p = _sigmoid(a * margins + b)
        w = p * (1 - p) + 1e-9
        ga, gb = ((p - toxic) * margins).sum() + 1e-2 * (a - 1), (p - toxic).sum()
        haa, hab, hbb = (w * margins**2).sum() + 1e-2, (w * margins).sum(), w.sum() + 1e-6
        det = haa * hbb - hab**2
        da, db = (hbb * ga - hab * gb) / det, (haa * gb - hab * ga) / det
        a, b = a - np.clip(da, -1, 1), b - np.clip(db, -1, 1)
        if abs(da) + abs(db) < 1e-9:
            break
    return (float(a), float(b)) if a > 0 else (1.0, 0.0)


def train(docs: DataFrame, labels: DataFrame) -> ToxicModel:
    """A model from labels of rows outside the held-out fold and the texts of such rows."""
    usable = F.coalesce(fold_of(F.col("doc_id"), FOLDS) != HELD_FOLD, F.lit(False))
    marked = (
        labels.select(labels["doc_id"].alias("doc_id"), labels["toxic"].cast("int").alias("toxic"))
        .where(usable & F.col("toxic").isin(0, 1))
        .groupBy("doc_id").agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("also"))
        .where("toxic = also").select("doc_id", "toxic")
    )
    shares = {r["toxic"]: r["n"] for r in marked.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    model = ToxicModel({}, np.zeros(0), 0.0)
    if not shares.get(1):
        return model
    prior = min(0.9, shares[1] / sum(shares.values()))
    rows = docs.select(docs["doc_id"].alias("doc_id"), F.length(docs["text"]).alias("chars")).where(usable & (F.col("chars") > 0))
    known = staged(rows.select("doc_id").distinct().join(marked, "doc_id", "left"), "toxicity-ids")
    ids = []
    for role, of_role, most in (("P", known.where("toxic = 1"), POSITIVES), ("L", known.where("toxic is not null"), LABELLED), ("U", known, UNLABELLED)):
        ids += [(r["doc_id"], role, r["toxic"]) for r in least_hashed(of_role, F.xxhash64("doc_id"), most, "doc_id").collect()]
    sample = docs.sparkSession.createDataFrame(ids, f"doc_id {known.schema['doc_id'].dataType.simpleString()}, role string, toxic int")

    def described(batch: pa.RecordBatch) -> pa.RecordBatch:
        known: dict[bytes, list[int]] = {}
        found = []
        for text in texts_of(batch).to_pylist():
            words = words_of(text)
            known |= {w: features_of(w) for w in words if w not in known}
            found.append(np.unique(np.fromiter((f for w in words for f in known[w]), np.int64)))
        return pa.RecordBatch.from_pydict({n: batch.column(n) for n in ("doc_id", "role", "toxic")} | {"features": pa.array(found, pa.list_(pa.int64()))})

    texts = sampled_texts(docs, sample)
    found = staged(map_batches(texts, described, sample.withColumn("features", F.array(F.lit(0).cast("long"))).schema), "toxicity-features")
    count = {r["role"]: r["n"] for r in found.groupBy("role").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not count.get("P"):
        return model
    model.index = {f: i for i, f in enumerate(choose_features(found, count["P"], count["U"], FEATURES))}
    chosen = np.array(sorted(model.index), np.int64)
    columns = np.array([model.index[f] for f in chosen.tolist()], np.int32)

    def placed(batches):
        for batch in batches:
            held = []
            for features in batch.column("features"):
                own = features.values.to_numpy() if features.is_valid else chosen[:0]
                held.append(columns[np.isin(chosen, own)])
            yield pa.RecordBatch.from_pydict({n: batch.column(n) for n in ("doc_id", "role", "toxic")} | {"present": pa.array(held, pa.list_(pa.int32()))})

    of: dict[str, list] = {role: [] for role in "PLU"}
    # Of at most POSITIVES + LABELLED + UNLABELLED rows, the places of at most FEATURES features.
    for r in found.mapInArrow(placed, sample.withColumn("present", F.array(F.lit(0))).schema).collect():
        of[r["role"]].append((r["doc_id"], r["toxic"], r["present"]))
    for rows in of.values():
        rows.sort(key=lambda r: r[0])
    xp, xu = (_matrix([r[2] for r in of[role]], len(model.index)) for role in "PU")
    model.weights, model.bias = train_nnpu(xp, xu, prior)
    margins = model.margins([r[2] for r in of["L"]])
    model.scale, model.shift = fit_scale(margins, np.array([r[1] for r in of["L"]], np.float64))
    return model


def score(docs: DataFrame, model: ToxicModel, with_rows: bool = False) -> DataFrame:
    """For each row: doc_id, held_out, score, predicted; with_rows adds row_ (all columns)."""
    row, _ = whole_rows(docs)
    given = docs.select(docs["doc_id"].alias("doc_id"), row if with_rows else docs["text"].alias("text"))
    carrier = given.sparkSession.sparkContext.broadcast(model)
    names = [n for n in given.columns if n != "text"]

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = carrier.value.scores(texts_of(batch).to_pylist())
        return pa.RecordBatch.from_pydict({n: batch.column(n) for n in names} | {"score": pa.array(found, pa.float64())})

    # Workers outlive the stage, and with them what they remember of words.
    scored = map_batches(given, work, given.select(*names, F.lit(0.0).alias("score")).schema, lambda: carrier.value.cache.clear())
    return scored.select("doc_id", held_out(F.col("doc_id"), FOLDS, HELD_FOLD).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"), *names[1:])


def accepted_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that are predicted not toxic."""
    return unpack_rows(score(docs, train(docs, labels), with_rows=True).where("predicted = 0"), docs.columns)
