"""Best stored workflow for each query text by token overlap."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window as W, functions as F

from palimpsest.functions.scoring import as_score
from palimpsest.functions.text import content_key, tokenize
from palimpsest.operators.skew import BROADCAST_ROWS, split_hot_join


def workflow_match(queries: DataFrame, workflows: DataFrame, *, threshold: float = 0.6,
                   min_chars: int = 3) -> DataFrame:
    """``query_id, workflow_id, similarity``: the best workflow with overlap >= ``threshold``.

    A bounded set of workflows goes to the texts, which stay where they lie.  With many workflows equal texts
    are matched once, and only the query's rarest words generate
    candidates, which are then scored exactly: a pair can only reach the threshold if it shares one
    of the rarest ``(1 - threshold)`` share of words.  Ties go to the first workflow.
    """
    def words(c: str):
        return F.filter(tokenize(F.col(c)), lambda w: F.length(w) >= min_chars)

    wf = (workflows.select("id", "text", content_key(F.col("text")).alias("k")).groupBy("k")
          .agg(F.min("id").alias("workflow_id"), F.first("text").alias("text"))
          .select("workflow_id", words("text").alias("pattern")))
    wf_words = wf.select("workflow_id", F.size("pattern").alias("n_pattern"), F.explode_outer(F.array_distinct("pattern")).alias("w"))
    if wf_words.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        return _matched_in_place(queries.select(F.col("id").alias("query_id"), words("text").alias("said")), wf, threshold)
    keyed = queries.select(F.col("id").alias("query_id"), content_key(F.col("text")).alias("k"), "text")
    q = keyed.groupBy("k").agg(F.first("text").alias("text")).select("k", words("text").alias("said"))
    q_words = (q.select("k", F.size("said").alias("n_said"), F.explode_outer("said").alias("w"))
               .groupBy("k", "n_said", "w").agg(F.count("*").alias("n")))
    pairs = _candidates(q_words, wf_words, threshold)
    shared = pairs.join(wf_words, "workflow_id").join(q_words, ["k", "w"])
    scored = shared.groupBy("k", "workflow_id").agg(as_score(
        F.sum("n") / F.max(F.greatest("n_said", "n_pattern"))).alias("similarity"))
    best = scored.filter(F.col("similarity") >= threshold).groupBy("k").agg(
        F.min_by(F.struct("workflow_id", "similarity"), F.struct((-F.col("similarity")).alias("s"), F.col("workflow_id"))).alias("b"))
    return split_hot_join(keyed.select("query_id", "k"), best, ["k"]).select(
        "query_id", "b.workflow_id", "b.similarity")


#: Cells of one step: words of texts times the workflows that hold them, or texts times workflows.
STEP_CELLS = 2_000_000


def _matched_in_place(said: DataFrame, wf: DataFrame, threshold: float) -> DataFrame:
    """The answer for rows ``query_id, said``: counting needs numpy only, no row moves.

    Hits are whole numbers; each text keeps the workflows within a rounding of its best, among which the rounded scores decide.
    """
    spark = said.sparkSession
    known = [(r["workflow_id"], r["pattern"]) for r in wf.orderBy("workflow_id").collect()]  # BROADCAST_ROWS words at most
    vocabulary = sorted({w for _, pattern in known for w in pattern})
    number = {w: i for i, w in enumerate(vocabulary)}
    held = sorted((number[w], i) for i, (_, pattern) in enumerate(known) for w in set(pattern))
    holders = np.array([i for _, i in held], np.int64)
    first = np.searchsorted(np.array([w for w, _ in held], np.int64), np.arange(len(vocabulary) + 1))
    state = spark.sparkContext.broadcast((vocabulary, first, holders, np.array([len(p) for _, p in known], np.int64)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, first, holders, lengths = state.value
        values = pa.array(vocabulary, pa.string())
        for batch in batches:
            said = batch.column(1)
            n_said = pc.list_value_length(said).to_numpy(zero_copy_only=False).astype(np.int64)
            word = pc.fill_null(pc.index_in(said.flatten().cast(pa.string()), value_set=values), -1).to_numpy(zero_copy_only=False).astype(np.int64)
            row = np.repeat(np.arange(len(n_said)), n_said)[word >= 0]
            pair, times = np.unique(row * len(vocabulary) + word[word >= 0], return_counts=True)
            row, word = np.divmod(pair, max(len(vocabulary), 1))
            cost = np.concatenate([[0], np.cumsum(np.maximum(np.bincount(row, first[word + 1] - first[word], len(n_said)), len(lengths)))])
            at, lo, found = np.searchsorted(row, np.arange(len(n_said) + 1)), 0, []
            while lo < len(n_said):  # texts of one step
                hi = max(lo + 1, int(np.searchsorted(cost, cost[lo] + STEP_CELLS, side="right")) - 1)
                r, w, t = (x[at[lo]:at[hi]] for x in (row, word, times))
                many = first[w + 1] - first[w]
                each = np.repeat(first[w] - np.cumsum(many) + many, many) + np.arange(many.sum())
                hits = np.bincount(np.repeat(r - lo, many) * len(lengths) + holders[each], np.repeat(t, many), (hi - lo) * len(lengths)).reshape(hi - lo, -1)
                share = hits / np.maximum(np.maximum(n_said[lo:hi, None], lengths[None, :]), 1)
                best = share.max(axis=1, keepdims=True, initial=0)
                i, j = np.nonzero((hits > 0) & (share >= np.maximum(best, threshold) - 2e-6))
                found.append((i + lo, j, hits[i, j].astype(np.int64)))
                lo = hi
            i, j, hits = (np.concatenate(x) for x in zip(*found)) if found else (np.empty(0, np.int64),) * 3
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(i)), pa.array(j), pa.array(hits), pa.array(np.maximum(n_said[i], lengths[j])), pa.array(np.diff(i, prepend=-1) != 0)],
                                             ["query_id", "workflow", "hits", "longest", "new"])

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in run(batches):
            start = np.append(np.flatnonzero(batch.column(4).to_numpy(zero_copy_only=False)), batch.num_rows)
            near = pa.StructArray.from_arrays([batch.column(i) for i in (1, 2, 3)], ["workflow", "hits", "longest"])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(start[:-1])), pa.ListArray.from_arrays(pa.array(start, pa.int32()), near)], ["query_id", "near"])

    found = said.mapInArrow(best, f"query_id {dict(said.dtypes)['query_id']}, near array<struct<workflow:long,hits:long,longest:long>>")
    top = F.array_min(F.transform("near", lambda n: F.struct((-as_score(n["hits"] / n["longest"])).alias("s"), n["workflow"].alias("workflow"))))
    found = found.select("query_id", top.alias("top")).select("query_id", (-F.col("top.s")).alias("similarity"), F.col("top.workflow").alias("workflow"))
    ids = spark.createDataFrame([(i, w) for i, (w, _) in enumerate(known)], f"workflow long, workflow_id {dict(wf.dtypes)['workflow_id']}")
    return found.filter(F.col("similarity") >= threshold).join(F.broadcast(ids), "workflow").select("query_id", "workflow_id", "similarity")


def _candidates(q_words: DataFrame, wf_words: DataFrame, threshold: float) -> DataFrame:
    """Pairs ``k, workflow_id`` that can reach the threshold: they share a rare word of the query,
    and the workflow is not too long."""
    rarity = wf_words.groupBy("w").agg(F.count("*").alias("df"))
    ranked = q_words.join(rarity, "w", "left")
    before = F.sum("n").over(W.partitionBy("k").orderBy(F.coalesce("df", F.lit(0)), "w")
                             .rowsBetween(W.unboundedPreceding, -1))
    # A rounded score may pass from just below, so the bounds use a slightly lower threshold.
    floor = threshold - 1e-6
    prefix = ranked.withColumn("before", F.coalesce(before, F.lit(0))).filter(
        F.col("df").isNotNull() & (F.col("before") <= F.col("n_said") - F.ceil(F.col("n_said") * floor)))
    return (prefix.select("k", "n_said", "w").join(wf_words, "w")
            .filter(F.col("n_pattern") * floor <= F.col("n_said")).select("k", "workflow_id").distinct())
