"""De-duplication against kept rows of a sliding window.

A row is a duplicate if a *kept* row of the same key lies less than the window before it.  A
dropped row never makes another row a duplicate, so the result depends on order: (time, id).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window as W, functions as F

from palimpsest.functions.text import content_key
from palimpsest.operators import bm25, filters
from palimpsest.operators.skew import HOT_ROWS, broadcast_if_small
from palimpsest.operators.vectors import CHUNK_ROWS, greedy_keep, grid, nearest_kept
from palimpsest.session import stage


def kept_anchors(times: DataFrame, keys: list[str], width: int, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Kept times per key from distinct times ``keys, t``.

    Keys with few distinct times are folded in one expression.  Hot keys go by pointer doubling over
    written tables, so neither a task nor the driver ever holds a hot key.
    """
    sizes = times.groupBy(*keys).agg(F.count("*").alias("n"))
    hot = sizes.filter(F.col("n") > hot_rows).select(*keys)
    is_hot = not hot.isEmpty()
    flag = broadcast_if_small(hot) if is_hot else None
    cold = times.join(flag, keys, "left_anti") if is_hot else times
    none = F.array().cast("array<bigint>")

    def step(acc, t):
        return F.when((F.size(acc) == 0) | (t - F.try_element_at(acc, F.lit(-1)) >= width), F.concat(acc, F.array(t))).otherwise(acc)

    folded = cold.groupBy(*keys).agg(F.array_sort(F.collect_list("t")).alias("ts"))
    kept = folded.select(*keys, F.explode(F.aggregate("ts", none, step)).alias("t"))
    return kept.unionByName(_kept_by_doubling(times.join(flag, keys, "left_semi"), keys, width)) if is_hot else kept


#: Cells that one window is cut into when the next time after a window is looked for.
CELLS = 64


def _following(times: DataFrame, keys: list[str], width: int) -> DataFrame:
    """``keys, t, nxt``: of every time the first one that lies a window or more behind it (null: none).

    The goal ``t + width`` is looked for among the times of its own cell, a small part of a window; if that has
    none left, the first time of the next filled cell is taken.  No task sees more than a cell of times,
    or one row for each cell, of a key.
    """
    size = max(1, width // CELLS)
    event, goal = F.col("t"), F.col("t") + width
    marks = times.select(*keys, event.alias("x"), F.lit(1).alias("kind"), event.alias("t")).unionByName(
        times.select(*keys, goal.alias("x"), F.lit(0).alias("kind"), event.alias("t")))
    marks = stage(marks.withColumn("cell", F.floor(F.col("x") / size)))
    here = W.partitionBy(*keys, "cell").orderBy("x", "kind").rowsBetween(W.currentRow, W.unboundedFollowing)
    inside = marks.withColumn("hit", F.min(F.when(F.col("kind") == 1, F.col("t"))).over(here)).filter("kind = 0")
    cells = marks.groupBy(*keys, "cell").agg(F.min(F.when(F.col("kind") == 1, F.col("t"))).alias("first"))
    later = W.partitionBy(*keys).orderBy("cell").rowsBetween(1, W.unboundedFollowing)
    cells = cells.select(*keys, "cell", F.first("first", ignorenulls=True).over(later).alias("then"))
    return inside.join(cells, [*keys, "cell"]).select(*keys, "t", F.coalesce("hit", "then").alias("nxt"))


def _kept_by_doubling(times: DataFrame, keys: list[str], width: int) -> DataFrame:
    """Kept times of hot keys.  From the first time on, each kept one gives the next by the same step, so steps are put together.

    After round n the first 2^n kept times are known and ``jumps`` leads 2^n kept times ahead; so rounds grow with the
    logarithm of the kept times of a key, and every round is two joins on (key, time), written and read again.
    """
    jumps = stage(_following(times, keys, width))
    kept = stage(times.groupBy(*keys).agg(F.min("t").alias("t")))
    while True:
        more = stage(kept.join(jumps, [*keys, "t"]).filter("nxt IS NOT NULL").select(*keys, F.col("nxt").alias("t")))
        if more.isEmpty():
            return kept
        kept = kept.unionByName(more)
        far = jumps.select(*keys, F.col("t").alias("nxt"), F.col("nxt").alias("far"))
        jumps = stage(jumps.join(far, [*keys, "nxt"]).filter("far IS NOT NULL").select(*keys, "t", F.col("far").alias("nxt")))


def dedup_within(df: DataFrame, *, keys: list[str], ts: str, ident: str, window_hours: float = 24,
                 existing: DataFrame | None = None, hot_rows: int = HOT_ROWS) -> DataFrame:
    """``input_id, canonical_uuid, is_new`` for rows of ``df``; ``existing`` rows are already kept."""
    width = int(window_hours * 3_600_000_000)
    rows = df.select(*keys, F.col(ident).alias("id"), F.unix_micros(ts).alias("t"))
    if existing is not None:
        old = existing.select(*keys, F.col(ident).alias("id"), F.unix_micros(ts).alias("t")).join(
            rows.select(*keys).distinct(), keys, "left_semi")
        gate = old.select(*keys, "t")
        rows_all = rows.withColumn("old", F.lit(False)).unionByName(old.withColumn("old", F.lit(True)))
    else:
        gate, rows_all = None, rows.withColumn("old", F.lit(False))
    # Rows of one key and time collapse first: only the smallest id can be kept.
    first = rows_all.groupBy(*keys, "t").agg(F.min(F.struct((~F.col("old")).alias("new"), "id"))["id"].alias("kid"))
    times = first.select(*keys, "t")
    if gate is not None:
        # Times already covered by a stored row cannot be kept; stored rows are kept by definition.
        stored = gate.distinct().withColumn("b", F.floor(F.col("t") / width))
        near = stored.select(*keys, F.col("t").alias("st"), F.explode(F.array("b", F.col("b") + 1)).alias("b"))
        times = times.withColumn("b", F.floor(F.col("t") / width)).join(near, [*keys, "b"], "left")
        covered = (F.col("st") <= F.col("t")) & (F.col("t") - F.col("st") < width)
        times = times.groupBy(*keys, "t").agg(F.max(F.coalesce(covered, F.lit(False))).alias("c")).filter(~F.col("c")).select(*keys, "t")
    kept = kept_anchors(times, keys, width, hot_rows)
    if gate is not None:
        kept = kept.unionByName(gate).distinct()
    anchors = kept.join(first, [*keys, "t"]).select(*keys, F.col("t").alias("at"), "kid",
                                                     F.floor(F.col("t") / width).alias("b"))
    # A row's anchor lies in its own bucket or the one before: an equi join, never a range join.
    reach = anchors.withColumn("b", F.explode(F.array("b", F.col("b") + 1)))
    cand = rows.withColumn("b", F.floor(F.col("t") / width)).join(reach, [*keys, "b"])
    cand = cand.filter((F.col("at") <= F.col("t")) & (F.col("t") - F.col("at") < width))
    best = cand.groupBy("id").agg(F.max_by("kid", "at").alias("kid"))
    return best.select(F.col("id").alias("input_id"), F.col("kid").alias("canonical_uuid"),
                       (F.col("id") == F.col("kid")).alias("is_new"))


def dedup_exact(episodes: DataFrame, *, window_hours: float = 24, existing: DataFrame | None = None,
                hot_rows: int = HOT_ROWS) -> DataFrame:
    """Same user, same whole text.  Both travel as one hash, in 32 bytes."""
    def keyed(df: DataFrame) -> DataFrame:
        user = F.coalesce("user_id", F.lit(""))
        key = content_key(F.octet_length(user).cast("string"), user, F.coalesce("content", F.lit("")))
        return df.select("uuid", "created_at", F.unhex(key).alias("ck"))

    return dedup_within(keyed(episodes), keys=["ck"], ts="created_at", ident="uuid",
                        window_hours=window_hours, hot_rows=hot_rows,
                        existing=None if existing is None else keyed(existing))


def dedup_semantic(episodes: DataFrame, *, threshold: float = 0.95, window_hours: float = 24,
                   existing: DataFrame | None = None, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Same user, cosine >= ``threshold`` to a kept episode of the window; the best match wins.

    ``existing`` episodes are kept already: rows near one of them go first, the others are thinned among
    themselves, and a dropped row's best match is looked for among both.  Equal texts have equal vectors, so this
    covers the exact rule where texts are embedded.
    """
    def shaped(df: DataFrame) -> DataFrame:
        return df.select("uuid", "created_at", "content_embedding", F.coalesce("user_id", F.lit("")).alias("user_id"))

    rows = shaped(episodes)
    if existing is None:
        out = _thinned(rows, threshold, window_hours, chunk_rows)
    else:
        rows, old = stage(rows), shaped(existing).withColumn("old", F.lit(True))
        near = dict(block=["user_id"], ident="uuid", ts="created_at", vector="content_embedding", threshold=threshold,
                    window_hours=window_hours, chunk_rows=chunk_rows)
        stored = stage(nearest_kept(rows, old, **near))
        covered = stored.select(F.col("id").alias("uuid"))
        rest = stage(_thinned(rows.join(covered, "uuid", "left_anti"), threshold, window_hours, chunk_rows))
        kept = rows.join(rest.filter("id = keeper").select(F.col("id").alias("uuid")), "uuid", "left_semi").withColumn("old", F.lit(False))
        fresh = nearest_kept(rows.join(covered, "uuid", "left_semi"), kept, **near)
        best = stored.unionByName(fresh).groupBy("id").agg(F.min_by(
            F.struct("kid", "score"), F.struct((-F.col("score")).alias("s"), (-F.col("kt")).alias("t"), "kid")).alias("b"))
        out = rest.unionByName(best.select("id", F.col("b.kid").alias("keeper"), F.col("b.score").alias("score")))
    return out.select(F.col("id").alias("input_id"), F.col("keeper").alias("canonical_uuid"),
                      (F.col("id") == F.col("keeper")).alias("is_new"), "score")


def _thinned(rows: DataFrame, threshold: float, window_hours: float, chunk_rows: int) -> DataFrame:
    return greedy_keep(rows, block=["user_id"], ident="uuid", ts="created_at", vector="content_embedding",
                       threshold=threshold, window_hours=window_hours, best=True, chunk_rows=chunk_rows)


def dedup_bm25(new: DataFrame, index: bm25.Bm25Index, *, threshold: float = 0.7, window_hours: float = 24,
               reference_time=None) -> DataFrame:
    """For new texts ``query_id, text, user_id``: the newest recent episode of the user that scores enough."""
    cutoff = F.lit(reference_time).cast("timestamp") - F.expr(f"INTERVAL {int(window_hours)} HOURS")
    recent = filters.after(index.docs, cutoff)
    hits = bm25.score(index, new, candidates=recent).filter(F.col("score") >= threshold)
    newest = hits.groupBy("query_id").agg(
        F.max_by(F.struct("uuid", "score"), F.struct("created_at", "score", "uuid")).alias("h"))
    return new.select("query_id").join(newest, "query_id", "left").select(
        F.col("query_id").alias("input_id"), F.col("h.uuid").alias("canonical_uuid"), F.col("h.uuid").isNull().alias("is_new"))


def dedup_bm25_batch(new: DataFrame, index: bm25.Bm25Index, *, threshold: float = 0.7, window_hours: float = 24) -> DataFrame:
    """``input_id, canonical_uuid, is_new`` for episodes ``uuid, user_id, created_at, content`` that also meet each other.

    A row is a duplicate if a kept row of its user, stored or new, lies less than the window before it and has the same text
    (new rows) or a BM25 score of at least ``threshold`` for the row's text; of several the newest wins, then the
    smallest id.  Statistics are those of the index with the batch in it, as it stands afterwards.

    Documents of a user and window meet in chunks of bounded size, where a matrix product gives their scores, so that no
    row for a pair and token exists.  Windows are then decided in order, many in one step (``_dropped_in_order``).
    """
    width = int(window_hours * 3_600_000_000)
    fresh = stage(bm25.documents(new, F.col("content"), content_key(F.col("content")).alias("text_key")))
    both = index.add(bm25.of_written(fresh.select(*bm25.DOC_COLUMNS, "tokens")))
    both = bm25.Bm25Index(both.docs, stage(both.terms), both.totals)
    matches = _bm25_matches(fresh, index.docs, both, threshold, width)
    user, t = F.coalesce("user_id", F.lit("")).alias("user_id"), F.unix_micros("created_at").alias("t")
    rows = fresh.select(F.col("uuid").alias("id"), user, t)
    matches = stage(matches.withColumn("b", F.floor(F.col("t") / width)))
    dropped = _dropped_in_order(matches, MATCHES)
    anchors = matches.join(dropped.select(F.col("id").alias("kid"), F.lit(True).alias("off")), "kid", "left").filter("stored OR off IS NULL")
    best = anchors.groupBy("id").agg(F.min_by("kid", F.struct((-F.col("kt")).alias("k"), "kid")).alias("kid"))
    return rows.select("id").join(best, "id", "left").select(F.col("id").alias("input_id"), F.coalesce("kid", "id").alias("canonical_uuid"), F.col("kid").isNull().alias("is_new"))


#: Documents of a user and window that meet in one task at once, on each side, and words that a product takes at once.
SIDE, WORDS = 1024, 4096
#: Matches of one user that are decided in one step, in one task.
MATCHES = 1_000_000
#: Words of at least two documents that may go to every task (16 bytes each).
WORDS_SENT = 4_000_000


def _bm25_matches(fresh: DataFrame, old: DataFrame, both: bm25.Bm25Index, threshold: float, width: int) -> DataFrame:
    """``id, user_id, t, kid, kt, stored``: earlier documents of the window that score enough for a new row's text, or new ones with the same text."""
    average = both.totals.select(F.try_divide("total_len", "n")).first()[0]
    span = fresh.agg((F.min(F.unix_micros("created_at")) - width).alias("a"), F.max(F.unix_micros("created_at")).alias("b"))
    again = fresh.select("uuid", F.lit(True).alias("again"))
    stored = old.select(*bm25.DOC_COLUMNS, "tokens", F.lit(None).cast("string").alias("text_key")).join(again, "uuid", "left")
    docs = fresh.select(*bm25.DOC_COLUMNS, "tokens", "text_key", F.lit(True).alias("again")).unionByName(stored)
    docs = docs.select("uuid", F.coalesce("user_id", F.lit("")).alias("user_id"), F.unix_micros("created_at").alias("t"), "text_key",
                       F.coalesce("again", F.lit(False)).alias("new"), "tokens").crossJoin(F.broadcast(span)).filter("t > a AND t <= b").drop("a", "b")
    words = _words_sent(both)
    if words is None or not docs.groupBy("uuid").count().filter("count > 1").isEmpty():
        held, flat = _weighed_by_joins(docs, both, average), _flat_weights
        asking, answering = ["toks", F.col("asked").alias("w")], ["toks", F.col("held").alias("w")]
    else:
        held, flat = _weighed(docs, words), _unpacked(words, average)
        asking, answering = ["dl", "vec", F.lit(True).alias("asks")], ["dl", "vec", F.lit(False).alias("asks")]
    held = stage(held.withColumn("b", F.floor(F.col("t") / width)))

    def meet(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if a.empty or b.empty:
            return pd.DataFrame({"id": [], "user_id": [], "t": [], "kid": [], "kt": [], "stored": []})
        ia, ib, ta, tb = a["id"].to_numpy(str), b["id"].to_numpy(str), a["t"].to_numpy(), b["t"].to_numpy()
        same = pd.factorize(pd.concat([a["text_key"], b["text_key"]]))[0]  # -1: stored rows
        equal = same[: len(a), None] == same[None, len(a):]
        ok = (_shared_weight(flat(a), flat(b), len(a), len(b), threshold) | equal) & (ta[:, None] - tb[None, :] < width)
        ok &= (tb[None, :] < ta[:, None]) | ((tb[None, :] == ta[:, None]) & (ib[None, :] < ia[:, None]))
        i, j = np.nonzero(ok)
        return pd.DataFrame({"id": ia[i].astype(object), "user_id": a["user_id"].to_numpy()[i], "t": ta[i], "kid": ib[j].astype(object), "kt": tb[j],
                             "stored": ~b["new"].to_numpy(bool)[j]})

    left = held.filter("new AND text_key IS NOT NULL").select("id", "user_id", "t", "text_key", *asking, "b")
    right = held.select("id", "user_id", "t", "text_key", "new", *answering, F.explode(F.array("b", F.col("b") + 1)).alias("b"))
    return grid(left, right, ["user_id", "b"], meet, "id string, user_id string, t long, kid string, kt long, stored boolean", SIDE)


def _weighed_by_joins(docs: DataFrame, both: bm25.Bm25Index, average: float | None) -> DataFrame:
    """``id, user_id, t, text_key, new, toks, asked, held``: the words of each document, what they weigh as the query's and as the document's."""
    weights = broadcast_if_small(bm25.term_weights(both))
    key = ["uuid", "user_id", "t", "text_key", "new", "dl"]
    # placed by document once, for both counts
    posted = docs.repartition("uuid").select(*key[:-1], F.size("tokens").alias("dl"), F.explode_outer("tokens").alias("tok"))
    posted = posted.groupBy(*key, "tok").agg(F.count("*").alias("tf")).join(weights, "tok", "left")
    norm = F.col("tf") + bm25.K1 * (1 - bm25.B + bm25.B * F.col("dl") / F.lit(average))
    word = F.when(F.col("tok").isNotNull(), F.struct(F.xxhash64("tok").alias("tok"), (F.col("tf") * F.col("idf")).alias("asked"), (F.col("tf") * (bm25.K1 + 1) / norm).alias("held")))
    held = posted.groupBy(*key).agg(F.collect_list(word).alias("ws"))
    return held.select(F.col("uuid").alias("id"), "user_id", "t", F.unhex("text_key").alias("text_key"), "new", F.col("ws.tok").alias("toks"),
                       F.col("ws.asked").alias("asked"), F.col("ws.held").alias("held"))


def _words_sent(both: bm25.Bm25Index) -> Broadcast | None:
    """Hashes of the words of at least two documents, in order; their numbers, frequent words first; the weights by number.  None if they are too many.

    A word of one document is shared by no pair.
    """
    shared = bm25.term_weights(both).join(both.terms.filter("df > 1"), "tok").select(F.xxhash64("tok").alias("h"), "df", "idf")
    if both.terms.filter("df > 1").limit(WORDS_SENT + 1).count() > WORDS_SENT:
        return None
    found = shared.toArrow()
    h, df, idf = (found.column(c).to_numpy() for c in ("h", "df", "idf"))
    order = np.lexsort((h, -df))
    by_hash = np.argsort(h[order], kind="stable")
    return both.terms.sparkSession.sparkContext.broadcast((h[order][by_hash], by_hash.astype(np.int32), idf[order]))


def _weighed(docs: DataFrame, words: Broadcast) -> DataFrame:
    """``id, user_id, t, text_key, new, dl, vec``: words are counted in their document; ``vec`` packs their numbers and counts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, number, _ = words.value
        for batch in batches:
            lists = batch.column(5)
            toks = lists.flatten().to_numpy(zero_copy_only=False)
            dl = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
            owner = np.repeat(np.arange(batch.num_rows), dl)
            at = np.minimum(np.searchsorted(hashes, toks), max(len(hashes) - 1, 0))
            known = hashes[at] == toks if len(hashes) else np.zeros(len(toks), bool)
            pairs, tf = np.unique((owner[known] << 32) | number[at[known]], return_counts=True)
            ends = np.searchsorted(pairs, np.arange(batch.num_rows + 1) << 32)
            vec = [_packed(pairs[i:j] & 0xFFFFFFFF, tf[i:j]) for i, j in zip(ends[:-1], ends[1:])]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(dl.astype(np.int32)), pa.array(vec, pa.binary())], names)

    names = ["id", "user_id", "t", "text_key", "new", "dl", "vec"]
    hashed = docs.select("uuid", "user_id", "t", F.unhex("text_key").alias("text_key"), "new", F.transform("tokens", lambda x: F.xxhash64(x)).alias("toks"))
    return hashed.mapInArrow(run, "id string, user_id string, t long, text_key binary, new boolean, dl int, vec binary")


def _packed(ids: np.ndarray, tf: np.ndarray) -> bytes:
    """Steps between ascending numbers, and counts; bytes of the same place stand together, so that what is small is compressed well."""
    return np.concatenate([np.diff(ids, prepend=0), tf]).astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def _unpacked(words: Broadcast, average: float) -> Callable:
    def flat(df: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        rows = [np.frombuffer(x, np.uint8).reshape(4, -1).T.copy().view("<u4").astype(np.int64).reshape(2, -1) for x in df["vec"]]
        n = [x.shape[1] for x in rows]
        toks, tf = np.concatenate([np.cumsum(x[0]) for x in rows]), np.concatenate([x[1] for x in rows])
        row = np.repeat(np.arange(len(df)), n)
        if df["asks"].iloc[0]:
            return row, toks, tf * words.value[2][toks]
        return row, toks, tf * (bm25.K1 + 1) / (tf + (bm25.K1 * (1 - bm25.B + bm25.B * df["dl"].to_numpy() / average))[row])

    return flat


def _flat_weights(df: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, word and weight of every word of ``toks, w``."""
    n = [len(x) for x in df["toks"]]
    return np.repeat(np.arange(len(df)), n), np.concatenate([np.asarray(x, np.int64) for x in df["toks"]]), np.concatenate([np.asarray(x, np.float64) for x in df["w"]])


def _shared_weight(asked: tuple, held: tuple, n: int, m: int, threshold: float) -> np.ndarray:
    """Whether the products of the weights of the words that ``n`` and ``m`` rows share add up to the threshold; a side: row, word, weight."""
    sides = asked, held
    common = np.intersect1d(sides[0][1], sides[1][1])
    total, share = np.zeros((n, m)), np.zeros((n, m), bool)
    for lo in range(0, len(common), WORDS):
        some, parts = common[lo:lo + WORDS], []
        for (row, tok, w), rows in zip(sides, (n, m)):
            at = np.minimum(np.searchsorted(some, tok), len(some) - 1)
            hit = some[at] == tok
            part = np.zeros((rows, len(some)))
            part[row[hit], at[hit]] = w[hit]
            parts.append(part)
        total += parts[0] @ parts[1].T
        if threshold <= 0:  # then rows that share no word must be told from those whose words weigh nothing
            share |= (parts[0] != 0).astype(np.float32) @ (parts[1] != 0).astype(np.float32).T > 0
    return (np.round(total, 6) >= threshold) & (share if threshold <= 0 else True)


def _dropped_in_order(matches: DataFrame, limit: int) -> DataFrame:
    """``id`` of the rows that a kept row matches, of ``matches(id, user_id, t, kid, kt, stored, b)`` with earlier rows; ``stored`` ones are kept already.

    Windows ``b`` of a user are packed in order into steps of about ``limit`` matches.  A step knows what became of all earlier ones
    and is walked row by row in one task for each user; a step with a window that has more goes by rounds.
    """
    sizes = matches.groupBy("user_id", "b").agg(F.count("*").alias("n"))
    upto = F.sum("n").over(W.partitionBy("user_id").orderBy("b"))
    steps = stage(sizes.withColumn("step", F.floor((upto - F.col("n")) / limit)).select("user_id", "b", "n", "step"))
    most = {r.step: r.n for r in steps.groupBy("user_id", "step").agg(F.sum("n").alias("n")).groupBy("step").agg(F.max("n").alias("n")).collect()}
    work = stage(matches.join(broadcast_if_small(steps.select("user_id", "b", "step")), ["user_id", "b"]).drop("b"), "step")

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["t", "id"], ignore_index=True)
        rows, start = np.unique(pdf["id"].to_numpy(str), return_index=True)
        rows, start = rows[np.argsort(start)], np.append(np.sort(start), len(pdf))
        kid = pd.Index(rows).get_indexer(pdf["kid"].to_numpy(str))
        held = np.where(kid < 0, pdf["held"].to_numpy(bool), False)  # rows before the step
        kept = np.ones(len(rows), bool)
        for i in range(len(rows)):
            part = slice(start[i], start[i + 1])
            near = kid[part]
            kept[i] = not (held[part].any() or kept[near[near >= 0]].any())
        return pd.DataFrame({"id": rows[~kept].astype(object)})

    dropped = matches.select("id").limit(0)
    for step in sorted(most):
        now = work.filter(F.col("step") == step).join(dropped.select(F.col("id").alias("kid"), F.lit(True).alias("off")), "kid", "left")
        now = now.withColumn("held", F.col("stored") | F.col("off").isNull())
        gone = (now.groupBy("user_id").applyInPandas(walk, "id string") if most[step] <= 4 * limit else _dropped_by_rounds(now))
        dropped = dropped.unionByName(stage(gone))
    return dropped


def _dropped_by_rounds(matches: DataFrame) -> DataFrame:
    """``id`` as of ``_dropped_in_order`` for one step: rows without an undecided earlier match are kept at once and their matches dropped."""
    rows = stage(matches.select("id").distinct())
    inner = stage(matches.select("id", "kid").join(rows.select(F.col("id").alias("kid")), "kid", "left_semi"))
    outer = matches.join(rows.select(F.col("id").alias("kid")), "kid", "left_anti")
    gone = stage(outer.filter("held").select("id").distinct())
    open_rows = stage(rows.join(gone, "id", "left_anti"))
    while not open_rows.isEmpty():
        waits = inner.join(open_rows.select(F.col("id").alias("kid")), "kid", "left_semi").select("id").distinct()
        lead = stage(open_rows.join(waits, "id", "left_anti"))
        more = inner.join(lead.select(F.col("id").alias("kid")), "kid", "left_semi").select("id").distinct()
        more = stage(more.join(open_rows, "id", "left_semi"))
        gone = gone.unionByName(more)
        open_rows = stage(open_rows.join(lead, "id", "left_anti").join(more, "id", "left_anti"))
    return gone


def resolve_duplicates_report(resolved: DataFrame) -> DataFrame:
    """Inputs per canonical row."""
    return resolved.groupBy("canonical_uuid").agg(
        F.count("*").alias("inputs"), F.count_if(~F.col("is_new")).alias("duplicates"))
