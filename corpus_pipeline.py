"""From raw documents to packed sequences: language, quality, near-duplicates, packing.

Every stage works on all that the one before kept. Its result is written to the shared scratch folder
and read again, so that lost executors cost no more than one stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tradeweft.llm import lang_id, near_dedup, packing, quality
from tradeweft.llm.common import table
from tradeweft.session import written_table

#: Documents whose language is recognised with less than this are rejected, as are texts without a letter.
LEAST_LANGUAGE = 0.3
#: Packing runs in workers that other stages have used before: small token caches and groups of text.
PACKING_HELD, PACKING_GROUP = 24 << 20, 1 << 20


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return lang_id.keep_known(docs, lang_id.train(docs), LEAST_LANGUAGE)


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.keep_first(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"),
                                  held=PACKING_HELD, group=PACKING_GROUP)


STAGES = [("language", language), ("quality", good_quality), ("near_duplicates", near_duplicates), ("packing", packed)]

#: SQL states neither the models nor the packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written_table(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
