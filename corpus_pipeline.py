"""The corpus pipeline: five stages over ``documents``, each written as Parquet and read again by the next.

language      documents go that have no letter or fit no learned language
near dedup    of each group of near duplicates (five-word shingles, similarity 0.8) the least doc_id stays
repeats       50-word passages that an earlier document has are cut; documents of which nothing is left go
mix           documents are taken 0, 1 or 2 times so that sources meet their target weights
pack          token pieces packed into sequences of 4096: one row per piece
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from lumenfold.llm._spark import materialize
from lumenfold.llm.language import accepted
from lumenfold.llm.minhash import deduplicated
from lumenfold.llm.mixing import mixed
from lumenfold.llm.packing import pack
from lumenfold.llm.substring import without_repeats

TOKENIZER = "word_bpe_49k.json"


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known.

    Null texts and texts without a letter go; a null doc_id or lang only teaches nothing.  Repeated rows share one fate, columns stay
    as they are whatever their names, long texts are read whole, an empty table gives one.
    """
    return accepted(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, that of the least doc_id.

    Null and wordless texts have no duplicates; rows with a null doc_id stay.  Different texts under one doc_id are documents of their own, of
    equal ones one stays.  Columns stay as they are, an empty table gives one.
    """
    return deduplicated(docs, width=5, percent=80)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of 50 words that ones with a smaller doc_id have.

    Documents of which nothing is left go; null and short texts and rows with a null doc_id stay as they are, and rows of one doc_id
    take nothing from one another.  Other columns than text and n_chars stay as they are, an empty table gives one.
    """
    return without_repeats(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, 0 to 2 times.

    A null source is a source of its own, a null text has no words; repeated rows are drawn each.  Columns stay as they are, an
    empty table gives one.
    """
    return mixed(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece lies in which sequence, a row per piece.

    A null or empty text is the end sign alone; every row is a document, doc_id may be null or repeated; longer documents than a sequence are
    cut.  Other columns are ignored, an empty table gives no rows.
    """
    return pack(docs, public_tokenizers.path(TOKENIZER), end_id=1, capacity=4096)


STAGES = [("language", language), ("near dedup", near_dedup), ("repeats", repeats), ("mix", mix), ("pack", packed)]

#: The language models, the sampling draw and the tokenizer are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; the last one's rows."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = materialize(docs, f"stage{k}")
    return docs
