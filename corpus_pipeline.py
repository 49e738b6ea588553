"""From documents to token ids: toxic, repeated and leaked documents go, the rest is encoded."""

from pyspark.sql import DataFrame, SparkSession

from palimpsest.llm import stages
from palimpsest.session import stage

STAGES = [
    ("toxicity", stages.drop_toxic),
    ("near_duplicates", stages.drop_near_duplicates),
    ("decontamination", stages.drop_leaks),
    ("byte_bpe", stages.encode),
]

#: The first stage is a fitted model, which SQL cannot express; tests compare with a version without Spark.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, step in STAGES:
        docs = stage(step(spark, docs, sf_dir))
    return docs
