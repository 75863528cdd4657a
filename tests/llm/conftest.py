import random

import pytest

CLASHING = ["key", "n", "size", "fp", "bucket", "row_", "id_", "rank", "tie", "taken", "lost", "kept", "label"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "the of and to in stone river green walks under bright morning glass paper window quiet number seven".split()


def line(rnd, n=12):
    return " ".join(rnd.choice(WORDS) for _ in range(n))


def awkward_rows():
    """Nulls in every column, empty and blank texts, a long one, ties, repeated rows and ids, odd characters."""
    rnd = random.Random(9)
    shared = line(rnd, 15)
    rows = [(i, "\n".join([line(rnd), shared if i % 2 else line(rnd), line(rnd, 3)]), "en", f"s{i % 4}", None) for i in range(30)]
    rows += [
        (40, None, "en", "s1", None), (41, "", None, None, None), (None, "no id here at all", "en", "s0", None), (None, None, None, None, None),
        (42, " \t\n\x0b\x0c\r", "de", "s0", None), (43, "x" * 60_000, "de", "s2", None), (44, "word " * 20_000, "fr", "s3", None),
        (45, "Ünï 漢字 🙂 \u2028 \x85\xa0", "fr", None, None), (46, "\n\n\n", "es", "", None), (47, "A\r\nB", "es", "s1", None),
        (3, rows[3][1], "en", "s3", None), (3, rows[3][1], "en", "s3", None), (5, "another text of an id that repeats", "en", "s1", None),
    ]
    return [(d, t, lang, s, None if t is None else len(t)) for d, t, lang, s, _ in rows]


@pytest.fixture(scope="session")
def awkward(spark):
    return spark.createDataFrame(awkward_rows(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def clashing(spark, awkward):
    """The same with extra columns whose names operators might use inside."""
    from pyspark.sql import functions as F

    return awkward.select("*", *[F.lit(1).alias(c) for c in CLASHING])


def table(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


@pytest.fixture(scope="session")
def as_rows():
    return table
