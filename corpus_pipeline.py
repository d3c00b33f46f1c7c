"""The corpus pipeline: quality, near duplicates, personal data, source mix, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and
read again as the next stage's documents.  All but the last return the columns of documents.

In every stage an empty table stays empty, texts of any length are worked on whole, and further
columns, whatever their names, come along; what becomes of nulls, ties and repeated rows is said
with each.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from umbra.llm import mixing, neardup, packing, pii, quality
from umbra.llm.common import materialise, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the fertility rules reject go.

    Null, blank and short texts go by the base rules; a null language is judged with its script;
    null ids stay; repeated rows, and texts that tie, are judged alike.
    """
    return quality.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class stays, that with the smallest id.

    Rows without an id are copies of others by their text alone; repeated rows stay once; of one
    id with several texts of a class the text with the smallest digest stays; null and blank
    texts all stay.
    """
    return neardup.keep_one(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans of personal data give way to their kinds.

    Every row stays, repeated rows and those without an id or a text too; of spans that overlap
    the earliest, then the longest is named.
    """
    return pii.mask(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are mixed by temperature; every document stays, those of small sources are repeated at most twice as often as others.

    The rows lie in order of block in every file.  A null source is a source of its own; null
    texts stay once; repeated rows are taken together; ties of the hash are ordered by key.
    """
    return mixing.mix(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 2048 tokens.

    A null text is its closing id; null ids are kept; repeated rows are packed once each; pieces
    that tie for a place are equal.
    """
    return packing.pack(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("personal_data", personal_data),
    ("source_mix", source_mix),
    ("pack_sequences", pack_sequences),
]

#: Tokenisers, signatures and the linear program are beyond SQL; the tests compare the stages' rows with plain versions of them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
