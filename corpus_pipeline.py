"""A training corpus from raw documents, in five stages.

Each stage takes what its predecessor kept, as a table with the columns of documents; the last one returns
token ids. run() writes every stage's rows to the shared folder and reads them again, so a lost executor
never costs more than the tasks it was running.

Near copies are those of five words and a coefficient of 0.8. They come from SimHash fingerprints by op5's operator,
checked by their coefficient. A SimHash of 64 bits can't promise to find all of those; near_copies adds the others by
an exact join.

Defined results: a null or empty text is kept unless its score says otherwise, as one group with all texts that
have no words, and has no tokens; it has no words to be taken for, and the mix may leave it out. Rows that share an
id are separate documents; rows that repeat a text under one id come out of the near-copy stage once. Null ids pass.
Further columns go along whatever their names. No documents give no rows; without labels nothing is toxic.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from echofold.llm import bpe, line_dedup, mixing, near_copies, toxicity
from echofold.llm.common import table
from echofold.llm.queries import BPE_RANKS
from echofold.plans.staging import staged


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose predicted toxicity is under the cut; the model learns from docs and labels."""
    return toxicity.accepted_documents(docs, table(spark, sf_dir, "labels"))


def drop_shared_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines of 40 characters or more that five or more of them share."""
    return line_dedup.dedup_documents(docs, min_chars=40, min_docs=5)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of smallest id, of each group linked by 0.8 or more of their five-word shingles."""
    return near_copies.one_of_each(docs, shingle=5, least=0.8)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.mixed_documents(docs)


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, with digests of the ids and of the text decoded from them."""
    return bpe.encode(docs, public_tokenizers.path(BPE_RANKS), public_tokenizers.PATTERN, with_ids=True)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_shared_lines),
    ("simhash_near_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("bpe", tokenise),
]

#: Learned scores, XXH64 shingles and BPE merges have no SQL form; tests hold the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = staged(docs, name)
    return docs
