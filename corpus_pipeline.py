"""The corpus pipeline: five stages over ``documents``, each written and read again.

toxicity (rejected documents go), exact dedup, SimHash near-dedup (one of each group stays),
mixing sources to target weights (documents come as often as the mix takes them), packing.
All but the last return the columns of ``documents``. A stage sees all that the one before kept.

Defined cases: a null text counts as empty, scores as the classifier's intercept, and of all empty
texts one stays; it has no words, so the mixture never takes it. A null id is not named by near-dedup
and stays there; a null source is a source. Of repeated rows one stays. An empty table, or one that
loses all rows on the way, gives an empty table; extra columns are carried to the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from faultline.llm import exact_dedup, mixing, packing, simhash, toxicity
from faultline.llm.common import materialize


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.keep_clean(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.keep_exact(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_near(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_copies),
    ("simhash near-dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)


#: The trained classifier and the sampling are beyond SQL.
ORACLE_SQL = None
