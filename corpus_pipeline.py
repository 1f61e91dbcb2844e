"""A training-corpus pipeline: quality filter, line dedup, near-dedup, source mixing, packing.

Each stage takes (spark, docs, sf_dir), docs having the columns of `documents`, and works on every row that its predecessor kept.
All stages but the last return those columns again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from oxbow.llm import linededup, mixing, packing, quality_zstd, simhash
from oxbow.llm.common import cut, learning_share, load


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression classifier predicts to be good; labels come from the input's own table."""
    model = quality_zstd.fit(docs.where(~learning_share("doc_id", 5, 0)), load(spark, sf_dir, "labels"))
    return quality_zstd.keep_good(docs, model)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without lines that nearly equal an earlier one; n_chars follows the new text."""
    return linededup.dedup_lines(docs).selectExpr(
        *("cast(char_length(text) as bigint) as n_chars" if c == "n_chars" else f"`{c}`" for c in docs.columns)
    )


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component: that of the smallest doc_id."""
    return simhash.representatives(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target takes it."""
    return mixing.apply_mix(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of training sequences."""
    return packing.pack(docs)


STAGES = [
    ("quality classifier", quality),
    ("line dedup", lines),
    ("simhash near-dedup", near_duplicates),
    ("source mixing", mix),
    ("packing", pack),
]

#: Learned scores, 64-bit hashes and tokenizers have no SQL twin.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; what one keeps is written to the checkpoint folder before the next reads it, some of them several times."""
    docs = load(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
