"""Shared by the operators: table access, Arrow batches of bounded size, range buckets."""

from __future__ import annotations

import ctypes
from bisect import bisect_right
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from echofold.plans.session import ship_package, shuffle_partitions

#: Text bytes in one slice of an Arrow batch that a Python operator works on at once.
SLICE_BYTES = 2 << 20

#: The six ASCII white-space characters, [\x20\x09-\x0D].
ASCII_SPACE = " \t\n\x0b\f\r"


try:
    _trim = ctypes.CDLL("libc.so.6").malloc_trim
except (OSError, AttributeError):  # another C library
    _trim = None


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Most rows and bytes of the Arrow batches that executors exchange with Python.
BATCH_ROWS, BATCH_BYTES = 2000, 8 << 20


def texts_of(batch: pa.RecordBatch) -> pa.Array:
    """The text column, or the text inside whole rows (row_), with "" for null."""
    found = batch.column("text") if "text" in batch.schema.names else batch.column("row_").field("text")
    return found.fill_null("")


def slices(batch: pa.RecordBatch, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that each piece holds about limit bytes of text, one row at least."""
    if batch.num_rows == 0:
        return
    sizes = pc.binary_length(texts_of(batch)).to_pylist()
    start = held = 0
    for i, size in enumerate(sizes):
        if held and held + size > limit:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += size
    yield batch.slice(start)


def bound_batches(spark: SparkSession) -> None:
    """Lower the session's limits on Arrow batches to those that bounded memory asks for."""
    for name, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        key = f"spark.sql.execution.arrow.{name}"
        now = int(spark.conf.get(key).rstrip("b"))
        if not 0 < now <= most:
            spark.conf.set(key, str(most))


def give_back() -> None:
    """Return freed memory to the system: Python workers outlive their tasks, and so would its peak."""
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


def map_batches(df: DataFrame, work: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str | T.StructType, finish: Callable[[], None] = lambda: None) -> DataFrame:
    """work over slices of Arrow batches, one of which is in memory at a time; finish ends each partition."""
    ship_package(df.sparkSession)
    bound_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch):
                yield work(piece)
            give_back()
        finish()
        give_back()

    return df.mapInArrow(run, schema)


def fold_of(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo folds; null stays null."""
    return F.crc32(doc_id.cast("string").cast("binary")) % F.lit(folds)


def held_out(doc_id: Column, folds: int, fold: int) -> Column:
    """Whether an id belongs to the fold kept out of training; a null id does not."""
    return F.coalesce(fold_of(doc_id, folds) == fold, F.lit(False))


def normal_text(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def least_hashed(df: DataFrame, hashed: Column, most: int, *ties: str | Column, total: int | None = None) -> DataFrame:
    """The rows of least hash, most of them at most; ties settle equal hashes. total is the number of rows, if known.

    Of a large table only about four times as many rows pass a threshold on the hash before they are
    ordered, so that what tasks send on for ordering doesn't grow with their number.
    """
    place = F.pmod(hashed, F.lit(1 << 40))
    total = df.count() if total is None else total
    if total > 8 * most:
        df = df.where(place < (1 << 40) * 4 * most // total)
    return df.orderBy(place, *ties).limit(most)


#: Ranges of a table at most: the sample that finds them comes to the driver.
MOST_RANGES = 32_768


class RangeBuckets:
    """Split points of a total order (key, tie), found from a bounded hash sample.

    The points are fixed on the driver before any row is dealt, so a recomputed task deals its rows
    alike. The tie column splits a key that holds many rows. At most per_bucket * buckets sample
    rows come to the driver, whatever the size of the table.
    """

    def __init__(self, points: list[tuple]):
        self.points = points

    @classmethod
    def sample(cls, df: DataFrame, key: str, tie: str, buckets: int | None = None, per_bucket: int = 12, total: int | None = None) -> "RangeBuckets":
        buckets = buckets or min(4 * shuffle_partitions(df.sparkSession), MOST_RANGES)
        keys = df.select(F.col(key).alias("k"), F.col(tie).alias("t")).where("k is not null")
        rows = least_hashed(keys, F.xxhash64("k", "t"), buckets * per_bucket, "k", "t", total=total).collect()
        ordered = sorted({(r["k"], r["t"]) for r in rows})
        step = max(1, len(ordered) // buckets)
        return cls(ordered[step::step])

    def of(self, key, tie) -> int:
        return bisect_right(self.points, (key, tie))

    def after_prefix(self, key: str) -> int:
        """The last range that may hold a text beginning with key."""
        return bisect_right(self.points, key, key=lambda point: point[0][: len(key)])

    @property
    def count(self) -> int:
        return len(self.points) + 1


def whole_rows(docs: DataFrame) -> tuple[Column, list[str]]:
    """All columns as one struct, so that columns of any name can't clash with an operator's own."""
    names = docs.columns
    return F.struct(*[F.col(f"`{n}`") for n in names]).alias("row_"), names


def unpack_rows(df: DataFrame, names: list[str], **replaced: Column) -> DataFrame:
    """The columns of row_ again; replaced gives new values for some that are there."""
    return df.select(*[replaced[n].alias(n) if n in replaced else F.col(f"row_.`{n}`").alias(n) for n in names])


def join_by_key(rows: DataFrame, facts: DataFrame, key: str, weight: str, total: int, how: str = "inner", heavy: int = 1000) -> DataFrame:
    """rows joined with facts (one row for each key; weight: the rows that have the key).

    Keys with over total / heavy rows number fewer than heavy, whatever the data: those facts are
    broadcast, so no key's rows meet in one task. All other keys go through a shuffled join.
    """
    limit = max(1, total // heavy)
    hot = F.broadcast(facts.where(F.col(weight) > limit))
    cold = facts.where(F.col(weight) <= limit)
    of_hot = rows.join(hot, key, "inner")
    of_cold = rows.join(F.broadcast(facts.where(F.col(weight) > limit).select(key)), key, "left_anti").join(cold, key, how)
    return of_hot.unionByName(of_cold)


#: Words of 64 bits that hashes fall into, at most so many rows wherever they are broadcast.
BUCKETS = 1 << 20


def bucket_of(hashed: Column) -> Column:
    return F.pmod(hashed, F.lit(BUCKETS)).cast("int").alias("bucket_")


def split_by(rows: DataFrame, wanted: DataFrame, *names: str) -> tuple[DataFrame, DataFrame]:
    """rows that may have their names in a row of wanted, and those that surely don't.

    wanted is broadcast as a bitmap of bounded size, 64 bits in each of BUCKETS words. Rows whose bit isn't set can't
    meet any of wanted, and need not be shuffled to find out.
    """
    hashed = F.xxhash64(*names)
    bit = F.expr(f"shiftleft(1L, cast(pmod(shiftright(xxhash64({', '.join(names)}), 40), 64) as int))")
    words = F.broadcast(wanted.select(bucket_of(hashed), bit.alias("bit_")).groupBy("bucket_").agg(F.bit_or("bit_").alias("bits_")))
    given = rows.withColumn("word_", bucket_of(hashed)).withColumn("bit_", bit)
    met = (F.col("word_") == F.col("bucket_")) & (F.col("bits_").bitwiseAND(F.col("bit_")) != 0)
    among, apart = (given.join(words, met, how).drop("word_", "bit_") for how in ("left_semi", "left_anti"))
    return among, apart


def sampled_texts(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """ids (doc_id and other columns, a bounded number of rows) with the whole text of each id.

    Texts that are null or empty take no part; of rows with equal ids the least text counts. ids is small by its
    parameters, so it is broadcast and only the texts sampled are shuffled.
    """
    texts = docs.select(docs["doc_id"].alias("doc_id"), docs["text"].alias("text")).where(F.length("text") > 0)
    return texts.join(F.broadcast(ids), "doc_id").groupBy(*ids.columns).agg(F.min("text").alias("text"))
