"""Cosine joins.

``similarity_topk`` answers a table of query vectors against a corpus.  A bounded query table is
sent to every task once and each task keeps a running top list, so the corpus is never shuffled.
A larger one meets the corpus in a grid of chunks of bounded size.  Both are exact.

``greedy_keep`` is order-dependent thinning: a row is dropped if an earlier *kept* row of its
block lies within the threshold (and time window).
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from palimpsest.functions.scoring import SCORE_DIGITS, as_score, dot
from palimpsest.operators.aggregates import top_per_group
from palimpsest.operators.skew import broadcast_if_small
from palimpsest.session import cut

MAX_BROADCAST_QUERIES = 2048
CHUNK_ROWS = 8192


def _unit(m: np.ndarray) -> np.ndarray:
    """Rows scaled to length one; rows without length stay zero, so their cosine is 0."""
    m = np.asarray(m, dtype=np.float64)
    norm = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, norm, out=np.zeros_like(m), where=norm > 0)


def _matrix(series) -> np.ndarray:
    return _unit(np.stack([np.asarray(v, dtype=np.float64) for v in series])) if len(series) else np.zeros((0, 1))


def _cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.round(a @ b.T, SCORE_DIGITS)


HITS = "query_id {qt}, uuid string, score double, created_at timestamp"


def similarity_topk(corpus: DataFrame, queries: DataFrame, *, vector: str, threshold: float,
                    limit: int | None = 10, max_queries: int = MAX_BROADCAST_QUERIES,
                    chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Top ``limit`` corpus rows per query with cosine >= ``threshold``.

    corpus: ``uuid, <vector>, user_id, created_at``; queries: ``query_id, embedding, user_id``
    (a null or empty user searches all).  Order: score, newest, uuid.
    """
    qtype = dict(queries.dtypes)["query_id"]
    schema = HITS.format(qt=qtype)
    q = queries.filter(F.size("embedding") > 0).select(
        "query_id", "embedding", F.coalesce("user_id", F.lit("")).alias("user_id"))
    # Same-size test and the length filter drop rows without a vector before they leave the JVM.
    c = corpus.filter(F.size(vector) > 0).select(
        "uuid", F.col(vector).alias("vec"), F.coalesce("user_id", F.lit("")).alias("user_id"),
        F.unix_micros("created_at").alias("t"))
    head = q.limit(max_queries + 1).collect()
    if not head:
        hits = c.sparkSession.createDataFrame([], schema)
    elif len(head) <= max_queries:
        hits = _broadcast_hits(c, head, schema, threshold, limit)
    else:
        hits = _grid_hits(c, q, schema, threshold, limit, chunk_rows)
    if limit is None:
        return hits
    return top_per_group(hits, ["query_id"], [F.desc("score"), F.desc_nulls_last("created_at"), "uuid"], limit)


def _broadcast_hits(corpus: DataFrame, head: list, schema: str, threshold: float, limit: int | None) -> DataFrame:
    state = corpus.sparkSession.sparkContext.broadcast((
        [r["query_id"] for r in head], _unit(np.array([r["embedding"] for r in head], dtype=np.float64)),
        [r["user_id"] for r in head]))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, mat, owners = state.value
        users = sorted(set(owners) - {""})
        code = {u: i for i, u in enumerate(users)}
        owner = np.array([code.get(u, -1) for u in owners])
        floor = np.full(len(ids), threshold)
        best: list[list] = [[] for _ in ids]
        for batch in batches:
            if not batch.num_rows:
                continue
            flat = batch.column("vec").flatten().to_numpy(zero_copy_only=False)
            dim = mat.shape[1]
            if len(flat) != batch.num_rows * dim:
                raise ValueError(f"corpus vectors do not all have {dim} dimensions")
            scores = _cosines(_unit(flat.reshape(-1, dim)), mat)
            ok = scores >= floor
            if users:
                who = pc.index_in(batch.column("user_id"), value_set=pa.array(users, pa.string()))
                who = pc.fill_null(who, -2).to_numpy(zero_copy_only=False)
                ok &= (owner == -1)[None, :] | (who[:, None] == owner[None, :])
            rows, cols = np.nonzero(ok)
            if not len(rows):
                continue
            uuids = batch.column("uuid").take(pa.array(rows)).to_pylist()
            times = batch.column("t").take(pa.array(rows)).to_pylist()
            touched = set()
            for r, q, u, t in zip(rows, cols, uuids, times):
                best[q].append((-scores[r, q], -(t if t is not None else -(1 << 62)), u, t))
                touched.add(q)
            if limit is None:
                yield _hit_batch(ids, best)
                best = [[] for _ in ids]
                continue
            for q in touched:
                if len(best[q]) > limit:
                    best[q] = heapq.nsmallest(limit, best[q])
                    floor[q] = -best[q][-1][0]
        yield _hit_batch(ids, best)

    id_type = pa.int64() if "query_id bigint" in schema else pa.int32() if "query_id int" in schema else pa.string()

    def _hit_batch(ids, best) -> pa.RecordBatch:
        flat = [(ids[q], e) for q, es in enumerate(best) for e in es]
        return pa.RecordBatch.from_arrays([
            pa.array([f[0] for f in flat], id_type), pa.array([f[1][2] for f in flat], pa.string()),
            pa.array([-f[1][0] for f in flat], pa.float64()),
            pa.array([f[1][3] for f in flat], pa.timestamp("us", tz="UTC")),
        ], names=["query_id", "uuid", "score", "created_at"])

    return corpus.mapInArrow(scan, schema)


def _grid_hits(corpus: DataFrame, q: DataFrame, schema: str, threshold: float, limit: int | None,
               chunk_rows: int) -> DataFrame:
    def meet(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame({"query_id": [], "uuid": [], "score": [], "created_at": []})
        scores = _cosines(_matrix(left["vec"]), _matrix(right["vec"]))
        own, who = left["user_id"].to_numpy(str), right["user_id"].to_numpy(str)
        ok = (scores >= threshold) & ((own[:, None] == "") | (own[:, None] == who[None, :]))
        a, b = np.nonzero(ok)
        out = pd.DataFrame({"query_id": left["id"].to_numpy()[a], "uuid": right["id"].to_numpy()[b],
                            "score": scores[a, b], "t": right["t"].to_numpy()[b]})
        if limit is not None:
            out = out.sort_values(["score", "t", "uuid"], ascending=[False, False, True]).groupby("query_id").head(limit)
        out["created_at"] = pd.to_datetime(out.pop("t"), unit="us")
        return out

    left = q.select(F.col("query_id").alias("id"), F.col("embedding").alias("vec"), "user_id")
    right = corpus.select(F.col("uuid").alias("id"), "vec", "user_id", "t")
    # A query with a user meets that user's rows only; one without has to meet them all.
    owned = grid(left.filter("user_id <> ''"), right, ["user_id"], meet, schema, chunk_rows)
    return owned.unionByName(grid(left.filter("user_id = ''"), right, [], meet, schema, chunk_rows))


def grid(left: DataFrame, right: DataFrame, block: list[str], kernel: Callable, schema: str,
         chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Run ``kernel(left_chunk, right_chunk)`` so that every pair of a block meets exactly once.

    A block larger than ``chunk_rows`` on a side is split by the hash of ``id`` into chunks of
    about that size, and the other side is repeated once per chunk; so no task holds more than
    about ``chunk_rows`` rows of a side however large the block.
    """
    keys = block or ["_all"]
    right = right.select(*[F.col(c).alias(c) for c in right.columns])  # the sides may share lineage
    if not block:
        left, right = left.withColumn("_all", F.lit(0)), right.withColumn("_all", F.lit(0))

    def hot(df: DataFrame, name: str) -> DataFrame:
        n = df.groupBy(*keys).agg(F.count("*").alias("n")).filter(F.col("n") > chunk_rows)
        return broadcast_if_small(n.select(*keys, F.ceil(F.col("n") / chunk_rows).cast("int").alias(name)))

    nl, nr = hot(left, "nl"), hot(right, "nr")

    def spread(df: DataFrame, own: str, mine: str, other: str, theirs: str) -> DataFrame:
        df = df.join(nl, keys, "left").join(nr, keys, "left")
        many = F.coalesce(F.col(own), F.lit(1))
        rest = F.coalesce(F.col(other), F.lit(1))
        return df.withColumns({
            mine: F.pmod(F.xxhash64("id"), many).cast("int"),
            theirs: F.explode(F.sequence(F.lit(0), rest - 1))}).drop("nl", "nr")

    lhs = spread(left, "nl", "lc", "nr", "rc").groupBy(*keys, "lc", "rc")
    rhs = spread(right, "nr", "rc", "nl", "lc").groupBy(*keys, "lc", "rc")

    def run(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        out = kernel(a, b)
        # Plain object columns: Arrow-backed strings may arrive in no or several pieces.
        plain = [c for c in out.columns if out.empty or pd.api.types.is_string_dtype(out[c].dtype)]
        return out.astype({c: object for c in plain})

    return lhs.cogroup(rhs).applyInPandas(run, schema)


# ---- greedy thinning ----------------------------------------------------------------------------

def _greedy(vecs: np.ndarray, t: np.ndarray, ids: np.ndarray, threshold: float, window: int | None,
            best: bool) -> tuple[list, list]:
    """Keeper and score per row of one block, rows sorted by (t, id)."""
    kept: list[int] = []
    keeper, score = [], []
    for i in range(len(ids)):
        while window is not None and kept and t[i] - t[kept[0]] >= window:
            kept.pop(0)
        if kept:
            s = np.round(vecs[kept] @ vecs[i], SCORE_DIGITS)
            ok = np.nonzero(s >= threshold)[0]
            if len(ok):
                pick = ok[0]
                if best:  # highest score, then the newest, then the smallest id
                    pick = min(ok, key=lambda j: (-s[j], -t[kept[j]], ids[kept[j]]))
                keeper.append(ids[kept[pick]])
                score.append(float(s[pick]))
                continue
        kept.append(i)
        keeper.append(ids[i])
        score.append(1.0)
    return keeper, score


def greedy_keep(df: DataFrame, *, block: list[str], ident: str, ts: str, vector: str, threshold: float,
                window_hours: float | None = None, best: bool = False,
                chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """``id, keeper, score`` for every row; kept rows are their own keeper.

    ``best`` assigns a dropped row to its most similar keeper, else to the earliest.  Rows without
    a vector are kept.  Blocks up to ``chunk_rows`` are thinned inside one task.  Larger blocks are cut in time
    into chunks of whole windows (``_greedy_in_time``).  Those with a window of more rows, or without windows, go
    through rounds in which all rows without an undecided earlier neighbour are kept at once and
    their neighbours dropped: the same result, with every task bounded.
    """
    window = None if window_hours is None else int(window_hours * 3_600_000_000)
    has_vec = F.coalesce(F.exists(F.col(vector), lambda x: x != 0), F.lit(False))
    rows = df.select(*block, F.col(ident).alias("id"), F.unix_micros(ts).alias("t"),
                     F.when(has_vec, F.col(vector)).alias("vec"))
    bare = rows.filter(F.col("vec").isNull()).select("id", F.col("id").alias("keeper"), F.lit(1.0).alias("score"))
    rows = rows.filter(F.col("vec").isNotNull())
    sizes = rows.groupBy(*block).agg(F.count("*").alias("n"))
    hot = sizes.filter(F.col("n") > chunk_rows).select(*block)
    total = sizes.agg(F.sum("n"), F.max("n")).first()
    schema = f"id {dict(rows.dtypes)['id']}, keeper {dict(rows.dtypes)['id']}, score double"

    def one_task(pdf: pd.DataFrame) -> pd.DataFrame:
        """Many small blocks at once: one matrix, one sort, then a walk block by block."""
        pdf = pdf.sort_values([*block, "t", "id"], ignore_index=True)
        vecs, t, ids = _matrix(pdf["vec"]), pdf["t"].to_numpy(), pdf["id"].to_numpy()
        new = np.zeros(len(pdf), dtype=bool)
        for c in block:
            v = pdf[c].to_numpy()
            new[1:] |= v[1:] != v[:-1]
        cuts = [0, *np.nonzero(new)[0].tolist(), len(pdf)]
        keeper, score = [], []
        for lo, hi in zip(cuts, cuts[1:]):
            k, s = _greedy(vecs[lo:hi], t[lo:hi], ids[lo:hi], threshold, window, best)
            keeper += k
            score += s
        return pd.DataFrame({"id": ids, "keeper": keeper, "score": score})

    def in_tasks(df: DataFrame) -> DataFrame:
        # Whole blocks share a task until about a chunk of rows is reached.
        many = max(1, -(-int(total[0] or 0) // chunk_rows))
        shared = df.withColumn("_task", F.pmod(F.xxhash64(*block), F.lit(many)))
        return shared.groupBy("_task").applyInPandas(lambda pdf: one_task(pdf.drop(columns="_task")), schema)

    if not total[1] or total[1] <= chunk_rows:
        return bare.unionByName(in_tasks(rows))
    flag = broadcast_if_small(hot)
    out, large = bare.unionByName(in_tasks(rows.join(flag, block, "left_anti"))), rows.join(flag, block, "left_semi")
    if window is not None:
        large = large.withColumn("b", F.floor(F.col("t") / window).cast("long"))
        counts = cut(large.groupBy(*block, "b").agg(F.count("*").alias("n")))
        dense = counts.filter(F.col("n") > chunk_rows).select(*block).distinct()
        crowded = not dense.isEmpty()
        if crowded:
            dense = broadcast_if_small(dense)
            thin, counts = large.join(dense, block, "left_anti"), counts.join(dense, block, "left_anti")
        out = out.unionByName(_greedy_in_time(thin if crowded else large, counts, block, threshold, window, best, chunk_rows))
        if not crowded:
            return out
        large = large.join(dense, block, "left_semi").drop("b")
    return out.unionByName(_greedy_rounds(large, block, threshold, window, best, chunk_rows))


#: What is known of a row: nothing yet, kept, dropped.
_OPEN, _KEPT, _DROPPED = 0, 1, 2


def _greedy_in_time(rows: DataFrame, counts: DataFrame, block: list[str], threshold: float, window: int, best: bool, chunk_rows: int) -> DataFrame:
    """``greedy_keep`` of rows ``*block, id, t, vec, b`` whose windows ``b`` have few rows each (``counts``).

    Windows of a block are packed in order into chunks of about ``chunk_rows`` rows.  A task walks one chunk, after the rows
    of the window before it.  What is not known of these leaves some of the chunk's rows open, as far as neighbours reach; chunks with
    open rows are walked again with what the first walk found.  The earliest open chunk of a block is settled by every round.
    """
    order = W.partitionBy(*block).orderBy("b")  # a row for each window of a block
    chunks = counts.withColumn("chunk", F.floor((F.sum("n").over(order) - F.col("n")) / chunk_rows))
    chunks = chunks.withColumn("goes_on", (F.lead("b").over(order) == F.col("b") + 1) & (F.lead("chunk").over(order) > F.col("chunk")))
    next_chunk = F.when(F.col("goes_on"), F.lead("chunk").over(order)).alias("next_chunk")
    chunks = cut(chunks.select(*block, "b", "chunk", next_chunk))
    placed = cut(rows.join(broadcast_if_small(chunks), [*block, "b"]).select(*block, "chunk", "next_chunk", "id", "t", "vec"))
    id_type = dict(rows.dtypes)["id"]
    schema = f"id {id_type}, state int, keeper {id_type}, score double, done boolean"

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["t", "id"], ignore_index=True)
        vecs, t, ids, own = _matrix(pdf["vec"]), pdf["t"].to_numpy(), pdf["id"].to_numpy(), pdf["own"].to_numpy(bool)
        state, live = pdf["state"].to_numpy().copy(), []
        keeper, score, done = ids.astype(object), np.ones(len(ids)), np.ones(len(ids), bool)
        for i in range(len(ids)):
            while live and t[i] - t[live[0]] >= window:
                live.pop(0)
            if own[i]:
                s = np.round(vecs[live] @ vecs[i], SCORE_DIGITS)
                near = np.nonzero(s >= threshold)[0]
                kept = [j for j in near if state[live[j]] == _KEPT]
                done[i] = len(kept) == len(near)
                state[i] = _DROPPED if kept else _KEPT if done[i] else _OPEN
                if kept:
                    j = min(kept, key=lambda j: (-s[j], -t[live[j]], ids[live[j]])) if best else kept[0]
                    keeper[i], score[i] = ids[live[j]], s[j]
            if state[i] != _DROPPED:
                live.append(i)
        out = pd.DataFrame({"id": ids.astype(object), "state": state.astype(np.int32), "keeper": keeper, "score": score, "done": done})
        return out[own]

    def walked(work: DataFrame) -> DataFrame:
        own = work.filter("own").drop("next_chunk")
        before = work.filter("next_chunk IS NOT NULL").withColumn("chunk", F.col("next_chunk")).drop("next_chunk").withColumn("own", F.lit(False))
        return own.unionByName(before).groupBy(*block, "chunk").applyInPandas(walk, schema)

    found = cut(walked(placed.withColumns({"state": F.lit(_OPEN), "own": F.lit(True)})))
    while True:
        left = cut(placed.join(found.filter("NOT done").select("id"), "id", "left_semi").select(*block, "chunk").distinct())
        if left.isEmpty():
            return found.select("id", "keeper", "score")
        known = placed.join(found.select("id", "state"), "id")
        again = known.join(broadcast_if_small(left.withColumn("own", F.lit(True))), [*block, "chunk"], "left").withColumn("own", F.coalesce("own", F.lit(False)))
        ahead = left.select(*block, F.col("chunk").alias("next_chunk"), F.lit(True).alias("wanted"))
        again = again.join(broadcast_if_small(ahead), [*block, "next_chunk"], "left")
        again = again.withColumn("next_chunk", F.when(F.col("wanted"), F.col("next_chunk"))).drop("wanted").filter("own OR next_chunk IS NOT NULL")
        settled = cut(walked(again))
        found = cut(found.join(settled.select("id"), "id", "left_anti").unionByName(settled))


def nearest_in_block(left: DataFrame, right: DataFrame, block: list[str], *, threshold: float,
                     chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """``id, other, score``: the nearest ``right`` row of the same block, if within ``threshold``.

    Both sides: block columns, ``id``, ``vec``.  Small blocks are joined and scored in the JVM;
    blocks too large for that meet in chunks.
    """
    best = F.struct((-F.col("score")).alias("s"), F.col("other"))
    lu, ru = left.withColumn("vec", unit_vector(F.col("vec"))), right.withColumn("vec", unit_vector(F.col("vec")))
    hot = (right.groupBy(*block).agg(F.count("*").alias("n")).filter(F.col("n") > chunk_rows).select(*block)
           .join(left.select(*block).distinct(), block, "left_semi"))

    def joined(a: DataFrame, b: DataFrame) -> DataFrame:
        pairs = a.select(*block, "id", F.col("vec").alias("v")).join(b.select(*block, F.col("id").alias("other"), F.col("vec").alias("w")), block)
        return pairs.select("id", "other", as_score(dot(F.col("v"), F.col("w"))).alias("score")).filter(F.col("score") >= threshold)

    def meet(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if a.empty or b.empty:
            return pd.DataFrame({"id": [], "other": [], "score": []})
        b = b.sort_values("id")  # the first maximum is then the smallest id
        s = _cosines(_matrix(a["vec"]), _matrix(b["vec"]))
        at = s.argmax(axis=1)
        top = s[np.arange(len(a)), at]
        out = pd.DataFrame({"id": a["id"].to_numpy(), "other": b["id"].to_numpy()[at], "score": top})
        return out[out["score"] >= threshold]

    if hot.isEmpty():
        hits = joined(lu, ru)
    else:
        flag = broadcast_if_small(hot)
        schema = f"id {dict(left.dtypes)['id']}, other {dict(right.dtypes)['id']}, score double"
        hits = joined(lu.join(flag, block, "left_anti"), ru).unionByName(grid(
            left.join(flag, block, "left_semi"), right.join(flag, block, "left_semi"), block, meet, schema, chunk_rows))
    return hits.groupBy("id").agg(F.min_by(F.struct("other", "score"), best).alias("b")).select("id", "b.other", "b.score")


def nearest_kept(rows: DataFrame, kept: DataFrame, *, block: list[str], ident: str, ts: str, vector: str, threshold: float,
                 window_hours: float, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """``id, kid, kt, score``: for each row the best kept row of its block that lies less than the window before it.

    Best is the highest score, then the newest, then the smallest id.  ``kept`` has a column ``old``: rows that were stored before, which
    come before all others of their time.  Both sides meet by block and window, in chunks of bounded size.
    """
    width = int(window_hours * 3_600_000_000)

    def side(df: DataFrame, *more: str) -> DataFrame:
        some = F.coalesce(F.exists(F.col(vector), lambda x: x != 0), F.lit(False))
        t = F.unix_micros(ts)
        return df.filter(some).select(*block, F.col(ident).alias("id"), t.alias("t"), F.col(vector).alias("vec"), F.floor(t / width).alias("b"), *more)

    def meet(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if a.empty or b.empty:
            return pd.DataFrame({"id": [], "kid": [], "kt": [], "score": []})
        b = b.sort_values(["t", "id"], ascending=[False, True])  # the first of equal scores is then the newest, smallest id
        s = _cosines(_matrix(a["vec"]), _matrix(b["vec"]))
        ta, tb = a["t"].to_numpy()[:, None], b["t"].to_numpy()[None, :]
        first = b["old"].to_numpy(bool)[None, :] | (b["id"].to_numpy(str)[None, :] < a["id"].to_numpy(str)[:, None])
        s = np.where((s >= threshold) & (ta - tb < width) & ((tb < ta) | ((tb == ta) & first)), s, -2.0)
        at = s.argmax(axis=1)
        top = s[np.arange(len(a)), at]
        out = pd.DataFrame({"id": a["id"].to_numpy(), "kid": b["id"].to_numpy()[at], "kt": b["t"].to_numpy()[at], "score": top})
        return out[out["score"] >= threshold]

    right = side(kept, "old")
    right = right.unionByName(right.withColumn("b", F.col("b") + 1))
    hits = grid(side(rows), right, [*block, "b"], meet, "id string, kid string, kt long, score double", chunk_rows)
    order = F.struct((-F.col("score")).alias("s"), (-F.col("kt")).alias("t"), "kid")
    return hits.groupBy("id").agg(F.min_by(F.struct("kid", "kt", "score"), order).alias("p")).select("id", "p.kid", "p.kt", "p.score")


def _greedy_rounds(rows: DataFrame, block: list[str], threshold: float, window: int | None, best: bool,
                   chunk_rows: int) -> DataFrame:
    # Copies of one vector in one window-wide bucket form a group `g`; only groups meet.  Inside a
    # bucket any two rows are within the window, so a group's first row stands for it.
    bucket = F.lit(0) if window is None else F.floor(F.col("t") / window)
    vec_text = F.array_join(F.transform("vec", lambda x: x.cast("string")), ",")
    rows = cut(rows.withColumn("b", bucket.cast("long"))
               .withColumn("vk", F.sha2(vec_text, 256)).withColumn("o", F.struct("t", "id")))
    group = [*block, "b", "vk"]
    gid = F.sha2(F.concat_ws("|", *[F.col(c).cast("string") for c in group]), 256)

    def groups(df: DataFrame) -> DataFrame:
        return df.groupBy(*group).agg(F.min("o").alias("lo"), F.max("o").alias("hi"),
                                      F.first("vec").alias("vec")).select(
            *block, "b", gid.alias("id"), "vec", F.col("lo.t").alias("t"), F.col("lo.id").alias("rid"),
            F.col("hi.t").alias("t_hi"))

    def meets(df: DataFrame) -> DataFrame:
        """The right side, placed in its own bucket and in the next one."""
        out = df.withColumn("own", F.lit(True))
        if window is None:
            return out
        return out.unionByName(df.withColumns({"b": F.col("b") + 1, "own": F.lit(False)}))

    def near(a: pd.DataFrame, b: pd.DataFrame) -> np.ndarray:
        return _cosines(_matrix(a["vec"]), _matrix(b["vec"])) >= threshold

    def blocked(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        """Groups of ``a`` whose first row has an earlier undecided neighbour."""
        if a.empty or b.empty:
            return pd.DataFrame({"id": []}, dtype=str)
        ta, tb, hb = a["t"].to_numpy()[:, None], b["t"].to_numpy()[None, :], b["t_hi"].to_numpy()[None, :]
        ia, ib = a["rid"].to_numpy(str)[:, None], b["rid"].to_numpy(str)[None, :]
        own = b["own"].to_numpy()[None, :]
        first = (tb < ta) | ((tb == ta) & (ib < ia))
        late = np.ones_like(first) if window is None else hb > ta - window
        ok = near(a, b) & np.where(own, first, late)
        return pd.DataFrame({"id": a["id"].to_numpy()[ok.any(axis=1)]})

    pair_schema = "id string, kid string, kt long, score double"

    def pairs(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        """Groups of ``a`` against kept rows of ``b``: all within the threshold."""
        if a.empty or b.empty:
            return pd.DataFrame({"id": [], "kid": [], "kt": [], "score": []})
        s = _cosines(_matrix(a["vec"]), _matrix(b["vec"]))
        i, j = np.nonzero(s >= threshold)
        return pd.DataFrame({"id": a["id"].to_numpy()[i], "kid": b["rid"].to_numpy()[j],
                             "kt": b["t"].to_numpy()[j], "score": s[i, j]})

    def covered(df: DataFrame, keepers: DataFrame) -> DataFrame:
        """Rows of ``df`` after a keeper and inside its window, with that keeper."""
        near_pairs = grid(groups(df).select(*block, "b", "id", "vec"), meets(keepers), [*block, "b"], pairs,
                          pair_schema, chunk_rows)
        got = df.withColumn("gid", gid).join(near_pairs.withColumnRenamed("id", "gid"), "gid")
        ok = (F.col("kt") < F.col("t")) | ((F.col("kt") == F.col("t")) & (F.col("kid") < F.col("id").cast("string")))
        if window is not None:
            ok = ok & (F.col("t") - F.col("kt") < window)
        return got.filter(ok)

    open_rows, kept = rows, None
    while not open_rows.isEmpty():
        g = groups(open_rows)
        stop = grid(g, meets(g), [*block, "b"], blocked, "id string", chunk_rows).distinct()
        lead = cut(g.join(stop, "id", "left_anti"))
        kept = lead if kept is None else kept.unionByName(lead)
        done = covered(open_rows, lead).select("id").union(lead.select(F.col("rid").alias("id"))).distinct()
        open_rows = cut(open_rows.join(done, "id", "left_anti"))
    dropped = rows.join(kept.select(F.col("rid").alias("id")), "id", "left_anti")
    hits = covered(dropped, kept)
    order = (F.struct((-F.col("score")).alias("s"), (-F.col("kt")).alias("k"), F.col("kid")) if best
             else F.struct(F.col("kt").alias("k"), F.col("kid")))
    picked = hits.groupBy("id").agg(F.min_by(F.struct("kid", "score"), order).alias("p"))
    return (picked.select("id", F.col("p.kid").alias("keeper"), F.col("p.score").alias("score"))
            .unionByName(kept.select(F.col("rid").alias("id"), F.col("rid").alias("keeper"), F.lit(1.0).alias("score"))))


def unit_vector(v: Column) -> Column:
    """The vector scaled to length one (zeros stay).  A lambda over one element binds the length,
    which would otherwise be computed again for every component."""
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    one = F.array(F.struct(v.cast("array<double>").alias("v"), norm.alias("n")))
    return F.element_at(F.transform(one, lambda b: F.transform(
        b["v"], lambda x: F.when(b["n"] > 0, x / b["n"]).otherwise(F.lit(0.0)))), 1)
