"""Language identification with string kernels.

The kernel of two texts is the blended spectrum of presence bits: the number of distinct character
n-grams, for n from 1 to ORDER, that occur in both, divided by the geometric mean of their own numbers.
A bounded labelled sample gives landmarks; the Nyström map built from the landmarks' kernel matrix turns
texts into vectors, and one-versus-rest kernel ridge regression is solved on them. Since landmarks see
only n-grams that occur in some landmark, presence vectors are kept over those, and a batch of texts is
scored by one matrix product with the landmarks' n-grams already multiplied into the coefficients.

Texts are lower-cased; characters that aren't letters become one space each run. An n-gram of any letters of
any script is known by a hash of GRAM_BITS bits; the few that share one count as one.

Training takes rows with a language outside the held-out fold that have a text: for each language those with
the least hashes of their ids, at most ROWS_PER_LANGUAGE each and, but for LEAST_ROWS of each language,
TRAIN_ROWS in all. Of more than MOST_LANGUAGES languages the most frequent ones are learned. Texts become sets
of n-grams and kernel values where they lie; the driver gets the landmarks' n-grams and, of each row, its
kernel with the landmarks. Training and prediction read whole texts.

Defined results: a null text, or one without letters, is "und" with score 0; so is every text if there
is nothing to learn from. Of rows that share an id and a language the least text is learned from. Rows with
null ids are predicted and count as not held out.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from echofold.llm.common import fold_of, held_out, map_batches, sampled_texts
from echofold.plans.staging import staged

FOLDS, HELD_FOLD = 3, 1
ORDER = 3
GRAM_BITS = 20
LANDMARKS = 320
ROWS_PER_LANGUAGE, LEAST_ROWS, TRAIN_ROWS, MOST_LANGUAGES = 400, 10, 6000, 2000
RIDGE = 1e-4
UNKNOWN = "und"
#: Odd multipliers of the n-gram hashes, and what tells lengths apart.
NEXT, MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
OF_LENGTH = [np.uint64(n * 0xC2B2AE3D27D4EB4F % (1 << 64)) for n in range(ORDER + 1)]

has_letter = regex.compile(r"\p{L}").search


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Each code point if it is a letter, else 0."""
    return np.array([c if chr(c).isalpha() else 0 for c in range(0x110000)], np.uint64)


class Grams:
    """The n-gram ids of texts, and the number of distinct ones."""

    size = 1 << GRAM_BITS

    def __init__(self):
        self.seen = np.zeros(self.size, np.int32)

    def ids(self, text: str) -> np.ndarray:
        """Ids of all n-grams, repeats included."""
        code = _letters()[np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)]
        blank = code == 0
        code = code[~(blank & np.concatenate(([False], blank[:-1])))]
        parts, gram = [], code
        for n in range(1, ORDER + 1):
            if n > 1:
                gram = gram[:-1] * NEXT + code[n - 1 :]
            if len(gram) == 0:
                break
            parts.append(((gram + OF_LENGTH[n]) * MIX >> np.uint64(64 - GRAM_BITS)).astype(np.int32))
        return np.concatenate(parts) if parts else np.zeros(0, np.int32)

    def distinct(self, ids: np.ndarray) -> int:
        """Each id keeps its last place; as many places are kept as there are distinct ids."""
        places = np.arange(1, len(ids) + 1, dtype=np.int32)
        self.seen[ids] = places
        return int((self.seen[ids] == places).sum())

    def set_of(self, text: str | None) -> np.ndarray:
        """The sorted distinct ids of a text with letters, else none."""
        return np.unique(self.ids(text)) if text and has_letter(text) else np.zeros(0, np.int32)


@dataclass
class Landmarks:
    """The distinct n-grams of each landmark."""

    sets: list[np.ndarray]

    def __post_init__(self):
        self.used = np.unique(np.concatenate(self.sets)) if self.sets else np.zeros(0, np.int32)
        self.own = np.sqrt([max(1, len(s)) for s in self.sets])
        self.table = None

    def __getstate__(self):
        return self.__dict__ | {"table": None}

    def kernel(self, sets: list[np.ndarray]) -> np.ndarray:
        """The kernel of other sets (rows) with the landmarks (columns): one matrix product."""
        if self.table is None:
            column = np.full(Grams.size, len(self.used), np.int32)
            column[self.used] = np.arange(len(self.used), dtype=np.int32)
            marks = np.zeros((len(self.used) + 1, len(self.sets)), np.float32)
            for k, s in enumerate(self.sets):
                marks[column[s], k] = 1.0
            self.table = column, marks
        column, marks = self.table
        present = np.zeros((len(sets), len(self.used) + 1), np.float32)
        for k, s in enumerate(sets):
            present[k, column[s]] = 1.0
        present[:, -1] = 0.0
        return (present @ marks).astype(np.float64) / np.sqrt([max(1, len(s)) for s in sets])[:, None] / self.own[None, :]


@dataclass
class LanguageModel:
    languages: list[str]
    grams: np.ndarray  # the ids of the n-grams that occur in landmarks
    weights: np.ndarray  # (n-grams, languages): landmarks' presence times Nyström coefficients
    bias: np.ndarray

    def __post_init__(self):
        self.tools = None

    def __getstate__(self):
        return self.__dict__ | {"tools": None}

    def margins(self, texts: list[str]) -> np.ndarray:
        """The ridge regressions of texts with letters: one matrix product."""
        if self.tools is None:
            column = np.full(Grams.size, len(self.grams), np.int32)
            column[self.grams] = np.arange(len(self.grams), dtype=np.int32)
            self.tools = Grams(), column
        grams, column = self.tools
        present = np.zeros((len(texts), len(self.grams) + 1), np.float32)
        own = np.ones(len(texts), np.float32)
        for k, text in enumerate(texts):
            ids = grams.ids(text)
            own[k] = max(1, grams.distinct(ids))
            present[k, column[ids]] = 1.0
        return present[:, :-1] @ self.weights / np.sqrt(own)[:, None] + self.bias

    def predict(self, texts: list[str | None], batch: int = 128) -> tuple[list[str], np.ndarray]:
        names, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
        known = [i for i, t in enumerate(texts) if t and has_letter(t)] if self.languages else []
        for at in range(0, len(known), batch):
            rows = known[at : at + batch]
            margins = self.margins([texts[i] for i in rows])
            best = margins.argmax(axis=1)
            for k, i in enumerate(rows):
                names[i] = self.languages[best[k]]
                scores[i] = np.clip((margins[k, best[k]] + 1) / 2, 0.0, 1.0)
        return names, scores


def solve(landmarks: Landmarks, among: np.ndarray, kernel: np.ndarray, langs: list[str], ridge: float = RIDGE) -> LanguageModel:
    """Nyström kernel ridge regression; among is the landmarks' own kernel matrix, kernel that of the rows with them."""
    languages = sorted(set(langs))
    values, vectors = np.linalg.eigh(among)
    keep = values > 1e-6 * values[-1]
    root = vectors[:, keep] / np.sqrt(values[keep])
    phi = np.hstack([kernel @ root, np.ones((len(langs), 1))])
    target = np.where(np.array(langs)[:, None] == np.array(languages)[None, :], 1.0, -1.0)
    penalty = ridge * len(langs) * np.eye(phi.shape[1])
    penalty[-1, -1] = 1e-9
    beta = np.linalg.solve(phi.T @ phi + penalty, phi.T @ target)
    share = root @ beta[:-1] / landmarks.own[:, None]
    weights = np.zeros((len(landmarks.used), len(languages)), np.float32)
    for k, s in enumerate(landmarks.sets):
        weights[np.searchsorted(landmarks.used, s)] += share[k].astype(np.float32)
    return LanguageModel(languages, landmarks.used, weights, beta[-1])


def training_ids(docs: DataFrame) -> DataFrame:
    """(doc_id, lang, nth) of the training sample, nth the place among its language's."""
    usable = F.coalesce(fold_of(F.col("doc_id"), FOLDS) != HELD_FOLD, F.lit(False)) & F.col("lang").isNotNull()
    rows = docs.select(docs["doc_id"].alias("doc_id"), docs["lang"].cast("string").alias("lang"), F.length(docs["text"]).alias("chars"))
    rows = staged(rows.where(usable & (F.col("chars") > 0)).select("doc_id", "lang").distinct(), "language-ids")
    sizes = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(MOST_LANGUAGES).collect()
    each = max(LEAST_ROWS, min(ROWS_PER_LANGUAGE, TRAIN_ROWS // max(1, len(sizes))))
    # Four times as many as are taken pass a hash threshold first, so that ranking sees few rows.
    table = rows.sparkSession.createDataFrame([(r["lang"], min(1.0, 4.0 * each / r["n"])) for r in sizes], "lang string, rate double")
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30))
    drawn = rows.join(F.broadcast(table), "lang").withColumn("place", place).where(F.col("place") < F.col("rate") * F.lit(float(1 << 30)))
    nth = F.row_number().over(Window.partitionBy("lang").orderBy("place", "doc_id"))
    found = drawn.withColumn("nth", nth).where(F.col("nth") <= each).select("doc_id", "lang", "nth")
    return docs.sparkSession.createDataFrame(found.collect(), found.schema)


def train(docs: DataFrame, landmarks: int = LANDMARKS, ridge: float = RIDGE) -> LanguageModel:
    def described(batch: pa.RecordBatch) -> pa.RecordBatch:
        grams = Grams()
        found = [grams.set_of(t) for t in batch.column("text").to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column("lang"), batch.column("nth"), pa.array(found, pa.list_(pa.int32()))], ["lang", "nth", "grams"])

    texts = sampled_texts(docs, training_ids(docs))
    rows = staged(map_batches(texts, described, "lang string, nth int, grams array<int>").where("size(grams) > 0"), "language-grams")
    # Landmarks are dealt to the languages in turn.
    chosen = rows.orderBy("nth", "lang").limit(landmarks).collect()
    if not chosen:
        return LanguageModel([], np.zeros(0, np.int32), np.zeros((0, 0), np.float32), np.zeros(0))
    marks = Landmarks([np.array(r["grams"], np.int32) for r in chosen])
    carrier = docs.sparkSession.sparkContext.broadcast(marks)

    def compared(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                part = batch.slice(at, 128)
                sets = [np.array(s.values if s.is_valid else [], np.int32) for s in part.column("grams")]
                kernel = carrier.value.kernel(sets)
                yield pa.RecordBatch.from_arrays([part.column("lang"), part.column("nth"), pa.array(list(kernel), pa.list_(pa.float64()))], ["lang", "nth", "kernel"])

    found = sorted(rows.mapInArrow(compared, "lang string, nth int, kernel array<double>").collect(), key=lambda r: (r["lang"], r["nth"]))
    at = {(r["lang"], r["nth"]): i for i, r in enumerate(found)}
    kernel = np.array([r["kernel"] for r in found])
    return solve(marks, kernel[[at[r["lang"], r["nth"]] for r in chosen]], kernel, [r["lang"] for r in found], ridge)


def identify(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """For each row: doc_id, held_out, lang_pred, score."""
    given = docs.select(docs["doc_id"].alias("doc_id"), docs["text"].alias("text"))
    carrier = given.sparkSession.sparkContext.broadcast(model)

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        names, scores = carrier.value.predict(batch.column("text").to_pylist())
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "lang_pred", "score"])

    found = map_batches(given, work, given.select("doc_id", F.lit("").alias("lang_pred"), F.lit(0.0).alias("score")).schema)
    return found.select("doc_id", held_out(F.col("doc_id"), FOLDS, HELD_FOLD).alias("held_out"), "lang_pred", "score")
