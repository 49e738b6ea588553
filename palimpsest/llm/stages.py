"""Stages of a corpus pipeline: each takes documents and gives those it keeps, or what becomes of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm import dart_minhash, fm_decontaminate, monoid_bpe, toxicity
from palimpsest.llm.common import table
from palimpsest.session import stage


def _wrapped(docs: DataFrame) -> DataFrame:
    """The text beside a struct of all other columns, so that no name an operator adds can meet one of ``docs``."""
    return docs.select("text", F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("row"))


def _unwrapped(docs: DataFrame, columns: list[str]) -> DataFrame:
    return docs.select(*[F.col("text") if c == "text" else F.col(f"row.`{c}`") for c in columns])


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the threshold; the model learns from the labelled ones among ``docs``."""
    model = toxicity.learn(docs, table(spark, sf_dir, "labels"))
    return _unwrapped(toxicity.score_documents(_wrapped(docs), model).filter(F.col("_score") < toxicity.THRESHOLD), docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: that of the smallest id, documents without an id last, then of the smallest row.

    Groups are those of texts, so documents without an id, and different texts that share an id, are judged like all others.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.shiftrightunsigned(F.xxhash64(text), 2).alias("_t"), text.alias("_text"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    first = F.struct(F.col("row.doc_id").isNull().alias("nameless"), F.col("row.doc_id").alias("id"))
    texts = stage(rows.groupBy("_t").agg(F.first("_text").alias("text"), F.min(first).alias("first")))  # combined in the tasks: copies are one row
    groups = dart_minhash.near_duplicates(texts.select(F.col("_t").alias("doc_id"), "text"))
    kept = texts.select("_t", "first").join(groups.select(F.col("doc_id").alias("_t"), "class_id"), "_t")
    kept = kept.groupBy("class_id").agg(F.min(F.struct("first", "_t"))["_t"].alias("_t")).select("_t")
    one = rows.join(kept, "_t", "left_semi").groupBy("_t").agg(F.min_by("row", F.struct(first, F.to_json("row"))).alias("row"))
    return one.select("row.*")


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of a benchmark item."""
    found = fm_decontaminate.find_leaks(_wrapped(docs), table(spark, sf_dir, "benchmark"))
    return _unwrapped(found.filter(F.size("_spans") == 0), docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, with digests of the ids and of what they decode to."""
    coded = monoid_bpe.encode_texts(_wrapped(docs), ids=True)
    return coded.select(F.col("row.doc_id").alias("doc_id"), F.col("_n_tokens").alias("n_tokens"), F.col("_ids").alias("ids"),
                        F.col("_ids_sha256").alias("ids_sha256"), F.col("_decoded_sha256").alias("decoded_sha256"))
