"""From raw documents to a mixed, sharded corpus: five stages, each written as Parquet and read by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from scenetab.llm import decontamination, jaccard, langid, mixing, sharding
from scenetab.llm.common import stored

SOURCE_WEIGHTS = [5.0, 2.0, 1.0]
SHARD_WEIGHTS = [1.0] * 24


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told; those without letters or in doubt between languages go.

    Null and empty texts go; equal rows stay or go together; whole texts are read, however long; an empty table stays empty;
    all columns are kept, whatever their names.
    """
    return langid.kept_languages(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies: five-word shingles, similarity 0.8 or more.

    The least id stays, a null id only where there is no other; of repeated rows one stays. Texts without words are in no class and all
    stay; whole texts count, however long; an empty table stays empty; all columns are kept, whatever their names.
    """
    return jaccard.one_of_each(docs, n=5, percent=80)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth is benchmark text.

    Texts that are null or have no words stay; repeated rows stay or go together; whole texts are compared, however long; an empty
    table stays empty, and without benchmark items all rows stay; all columns are kept, whatever their names.
    """
    return decontamination.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's share of the mix asks for.

    Null and empty texts weigh nothing and are taken like the others of their source; a null source comes last; rows of one id share a
    draw; whole texts are counted, however long; an empty table stays empty; all columns are kept, whatever their names.
    """
    return mixing.mix(docs, SOURCE_WEIGHTS)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row with the number of its shard, which its id decides.

    Repeated ids share a shard, as do all rows without id; texts are not looked at; an empty table stays empty; a column ``shard`` is
    replaced, all others are kept.
    """
    return sharding.with_shard(docs, SHARD_WEIGHTS)


STAGES = [
    ("language ID", language),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontaminate),
    ("mixing sources to target weights", mix),
    ("sharding", shard),
]

# a trained classifier and hash draws have no SQL; tests/llm/test_pipeline.py compares every stage with a plain version on its own input
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
