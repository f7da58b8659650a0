"""The corpus pipeline: five stages over documents, each reading what the last one wrote.

Every stage takes (spark, docs, sf_dir) and works on all rows it is given. All but the last return
the columns of their input. ``docs`` is a plain scan: what the last stage wrote, read again.

Null and empty texts are clean and have no words: they pass the filters as one group of
near-duplicates, and the mix takes nothing of them. Repeated rows are near-duplicates of each other.
An empty table passes through all stages. Columns beyond those of documents are kept, except that
the last stage replaces ``shard`` and ``slot``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from covertile.llm import decontaminate, mixing, sharding, simhash, toxicity
from covertile.plans.workspace import Workspace


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity of one half or more go; the model is fitted to ``labels``."""
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return docs.where(toxicity.scorer(model)(F.col("text"))["score"] < 0.5)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest id of each group of near-duplicates stays."""
    return simhash.keep_one(docs, scan=True)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain an item of ``benchmark`` go."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate.clean(docs, items)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of their sources takes them."""
    return mixing.mixed_rows(docs, scan=True)


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their shard and their slot in it."""
    return sharding.shard_documents(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminated),
    ("mix", mixed),
    ("shard", sharded),
]

#: The toxicity model and the near-duplicate groups have no SQL form; tests use plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over ``documents``."""
    ws = Workspace(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = ws.write(stage(spark, docs, sf_dir), name)
    return docs
