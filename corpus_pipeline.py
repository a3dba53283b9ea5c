"""From raw documents to token ids: each stage works on all that the one before kept and is written before the next reads it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from meterloom.llm import decontam, idstore, mixing, repetition, simhash
from meterloom.llm.common import table
from meterloom.session import cut


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return repetition.keep(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.one_of_each(docs, simhash.similar(docs))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed(docs)


#: Units that a worker remembers in the last stage: workers of the stages before still hold memory then.
REMEMBERED = 1 << 17


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return idstore.stored(docs, remembered=REMEMBERED)


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("mix", mix), ("token_ids", token_ids)]

#: No SQL: fingerprints, alignment, the tokenizer and the quality rules are not expressible in it.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
