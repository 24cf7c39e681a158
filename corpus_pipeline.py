"""The corpus pipeline: documents of quality, one of each near-duplicate group, without personal data,
mixed by source and packed into token sequences.

Each stage takes (spark, docs, sf_dir), works on all rows of docs, and is written as Parquet and read
again before the next. All but the last return the columns of documents, extra ones included, whatever their names.

Nulls, in every stage: a null text counts as empty; a null source is a source of its own; documents with a null doc_id are
never labelled rows and never near copies of one another, so all of them stay. Repeated rows are kept, but for near copies,
of which those with the least doc_id stay. Empty texts are near copies of one another. Ties are broken by values of the rows,
never by their place, so reruns agree. Texts of any length are read whole. Empty tables give empty tables; without labels
every score is one half, and every document stays.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm import classifier, mixing, near_copies, packing, pii
from siltstone.llm.common import let_go, staged, table


def _begun(stage: Callable) -> Callable:
    """stage, before which the driver lets go what the one before it held."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        let_go(spark)
        return stage(spark, docs, sf_dir)

    return run


@_begun
def of_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on the labelled rows among them, scores at 0.3 or more."""
    return classifier.accepted(docs, table(spark, sf_dir, "labels"))


@_begun
def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least doc_id of each group linked by similarities of 0.8 or more on 5-word shingles."""
    return near_copies.kept_ones(docs)


@_begun
def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with pseudonyms in place of personal data; n_chars follows the text (null for a null text)."""
    return pii.pseudonymised(docs).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


@_begun
def mixed_by_source(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target weight asks for; copies are equal rows, and a source without words gives none."""
    return mixing.mixed(docs)


@_begun
def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row for each piece of a document in a sequence."""
    import public_tokenizers

    return packing.packed(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality", of_quality),
    ("near_copies", without_near_copies),
    ("personal_data", without_personal_data),
    ("mix", mixed_by_source),
    ("pack", packed_sequences),
]

#: No SQL for it: the stages train a model, encode tokens and follow links; tests/llm checks them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
