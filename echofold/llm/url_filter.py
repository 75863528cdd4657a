"""URL filters as a sort-merge range join with a sweep over nested rules.

A rule (host, path) fits a URL if the URL's host is the rule's or lies below it and the URL's path starts
with the rule's. Hosts are turned round by label into canonical keys, "com.example", so that a rule becomes
the key interval of all texts that begin with "com.example" NUL path. A URL stands in the sweep once for
each of its host's suffixes that is no longer than the longest rule's, as only those can equal a rule's
host. Rules and URLs are dealt by key into the same ranges and sorted; the sweep keeps a stack of the rules
whose interval holds the current key, which are nested, so the top of the stack is the longest that fits.

Range boundaries come from a bounded sample of keys and carry a hash of the row as tie-break, so a common
URL is spread over several ranges. A rule whose interval spans ranges is sent to each of them: as such
rules are nested, no more than the length of a boundary's key are sent across it.

The longest rule wins: the one with the longest host and path together, of equal ones the one with the
longer host, then the allowing one. URLs that no rule fits get DEFAULT.

Defined results: a null URL, or one without "://", has empty host and path. Repeated rows come out as
often as they came in. Rules of equal host and path count as one, which allows if any of them does; rules
with a null are left out. An empty table of pages or rules is no special case.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from echofold.llm.common import RangeBuckets
from echofold.plans.session import ship_package, shuffle_partitions

DEFAULT = "allow"
#: (verdict, host, path): fixed values of the production rules.
RULES = [
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
]
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, _URL, 1), F.lit("")), _UPPER, _UPPER.lower())


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _URL, 2), F.lit(""))


def key_of(labels: Column, path: Column) -> Column:
    return F.concat(F.array_join(F.reverse(labels), "."), F.lit("\0"), path)


def rule_table(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    return spark.createDataFrame(rules, "verdict string, host string, path string")


def _rule_rows(rules: DataFrame) -> DataFrame:
    """(key, tie, is_page, ...): a row for each distinct rule."""
    named = rules.select(F.translate("host", _UPPER, _UPPER.lower()).alias("host"), "path", "verdict").dropna()
    one = named.groupBy("host", "path").agg(F.min("verdict").alias("verdict"))
    return one.select(key_of(F.split("host", r"\."), F.col("path")).alias("key"), F.concat("host", "path").alias("rule"), F.length("host").alias("host_length"), "verdict")


def _sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (bucket, key, is_page): each page row with the innermost rule that holds it."""
    bucket, stack = None, []
    for batch in batches:
        names = ("bucket", "key", "is_page", "rule", "verdict", "host_length")
        columns = [batch.column(n).to_pylist() for n in names]
        at, rules, verdicts, lengths = [], [], [], []
        for i, (b, key, is_page, rule, verdict, host_length) in enumerate(zip(*columns)):
            if b != bucket:
                bucket, stack = b, []
            while stack and not key.startswith(stack[-1][0]):
                stack.pop()
            if not is_page:
                stack.append((key, rule, verdict, host_length))
                continue
            top = stack[-1] if stack else (None, None, None, None)
            at.append(i)
            rules.append(top[1])
            verdicts.append(top[2])
            lengths.append(top[3])
        taken = batch.take(pa.array(at, pa.int32()))
        yield pa.RecordBatch.from_pydict({n: taken.column(n) for n in ("page_id", "host", "path", "level")} | {"rule": pa.array(rules, pa.string()), "verdict": pa.array(verdicts, pa.string()), "host_length": pa.array(lengths, pa.int32())})


def judge(pages: DataFrame, rules: DataFrame, default: str = DEFAULT) -> DataFrame:
    """For each row of pages (page_id, url): page_id, host, path, rule, verdict."""
    spark = pages.sparkSession
    ship_package(spark)
    wanted = _rule_rows(rules)
    most_labels = rules.agg(F.max(F.size(F.split("host", r"\.")))).first()[0] or 1
    given = pages.select(pages["page_id"].alias("page_id"), host_of(pages["url"]).alias("host"), path_of(pages["url"]).alias("path"))
    labels = F.split("host", r"\.")
    # A suffix of one label every host has: its row stands for the page as well and always stays.
    levels = F.sequence(F.lit(1), F.least(F.size(labels), F.lit(most_labels)))
    spread = given.withColumn("level", F.explode(levels))
    suffix = F.slice(labels, F.size(labels) - F.col("level") + 1, F.col("level"))
    keyed = spread.withColumn("key", key_of(suffix, F.col("path"))).withColumn("tie", F.xxhash64("page_id", "host", "path"))
    ranges = RangeBuckets.sample(keyed, "key", "tie")
    least = -(1 << 63)

    @F.pandas_udf("int")
    def bucket_of(keys, ties):
        return keys.combine(ties, ranges.of).astype("int32")

    @F.pandas_udf("array<int>")
    def buckets_of(keys):
        return keys.map(lambda k: list(range(ranges.of(k, least), ranges.after_prefix(k) + 1)))

    page_rows = keyed.withColumn("bucket", bucket_of("key", "tie"))
    rule_rows = wanted.withColumn("bucket", F.explode(buckets_of("key")))
    both = page_rows.select("bucket", "key", F.lit(True).alias("is_page"), "page_id", "host", "path", "level", F.lit(None).cast("string").alias("rule"), F.lit(None).cast("string").alias("verdict"), F.lit(None).cast("int").alias("host_length")).unionByName(
        rule_rows.select("bucket", "key", F.lit(False).alias("is_page"), "rule", "verdict", "host_length"), allowMissingColumns=True
    )
    dealt = both.repartition(shuffle_partitions(spark), "bucket").sortWithinPartitions("bucket", "key", "is_page")
    schema = dealt.select("page_id", "host", "path", "level", "rule", "verdict", "host_length").schema
    hits = dealt.mapInArrow(_sweep, schema).where("rule is not null or level = 1")
    # A hit comes once for each level of a page; equal rows of pages are counted at the first.
    rank = F.struct(F.length("rule"), "host_length", (F.col("verdict") == "allow"), "rule", "verdict")
    judged = hits.groupBy("page_id", "host", "path").agg(
        F.count(F.when(F.col("level") == 1, 1)).alias("times"), F.max(F.when(F.col("rule").isNotNull(), rank)).alias("best")
    )
    again = judged.withColumn("copy", F.explode(F.array_repeat(F.lit(1), F.col("times").cast("int"))))
    return again.select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))


ORACLE_SQL = """
WITH rules(verdict, host, path) AS (
    VALUES ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('allow', 'net', '/de/'),
           ('block', 'example.net', '/de/8'), ('block', 'org', '/es/')
), cut AS (
    SELECT page_id, instr(coalesce(url, ''), '://') AS found, url FROM pages
), rest AS (
    SELECT page_id, CASE WHEN found > 0 THEN substr(url, found + 3) ELSE '' END AS rest FROM cut
), parts AS (
    SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
           regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
    FROM rest
), ranked AS (
    SELECT p.page_id, p.host, p.path, r.host || r.path AS rule, r.verdict,
           row_number() OVER (PARTITION BY p.page_id ORDER BY length(r.host || r.path) DESC NULLS LAST, length(r.host) DESC) AS nth
    FROM parts p LEFT JOIN rules r ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path)
)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM ranked WHERE nth = 1
"""
