"""Benchmark passages in training texts, found by an FM-index over each shard of words."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest.llm.common import ALNUM, bound_batches, steps, table, words
from palimpsest.llm.registry import query

WINDOW = 10
#: Words of one index; a longer run of texts is cut, with an overlap of a window.
SHARD_WORDS = 1 << 20
#: Text positions kept in the index: every so many.
SAMPLE = 8
#: Bytes of benchmark text that are sent to all tasks at a time; a larger benchmark takes several passes.
BLOCK_BYTES = 16 << 20
#: Windows searched at a time, and rows of the index located at a time.
WINDOWS_AT_ONCE, ROWS_AT_ONCE = 1 << 16, 1 << 18


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Order of all suffixes, by doubling; only suffixes that still tie are sorted again.

    Symbols are below 2**21, and the last one occurs once.
    """
    n = len(symbols)
    padded = np.concatenate([symbols, [0, 0]]).astype(np.int64)
    key = padded[:n] << 42 | padded[1:n + 1] << 21 | padded[2:]
    order = np.argsort(key, kind="stable")
    key = key[order]
    fresh = np.concatenate([[True], key[1:] != key[:-1]])
    heads = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
    rank = np.empty(n + 1, np.int64)
    rank[order], rank[n] = heads, -1
    alone = fresh & np.concatenate([fresh[1:], [True]])
    slots, step = np.flatnonzero(~alone), 3
    while len(slots):
        tied = order[slots]
        key = rank[tied] * (n + 2) + rank[np.minimum(tied + step, n)] + 1
        by = np.argsort(key, kind="stable")
        tied, key = tied[by], key[by]
        order[slots] = tied
        fresh = np.concatenate([[True], key[1:] != key[:-1]])
        rank[tied] = slots[np.maximum.accumulate(np.where(fresh, np.arange(len(slots)), 0))]
        slots, step = slots[~(fresh & np.concatenate([fresh[1:], [True]]))], 2 * step
    return order


class FMIndex:
    """Counts and places of phrases in a sequence of symbols: the Burrows-Wheeler transform in a wavelet matrix."""

    def __init__(self, symbols: np.ndarray, sample: int = SAMPLE):
        order, n = suffix_array(symbols), len(symbols)
        column = symbols[order - 1]  # the symbol before each suffix
        self.below = np.concatenate([[0], np.cumsum(np.bincount(symbols))])
        self.levels: list[tuple[int, np.ndarray, int]] = []
        for level in reversed(range(max(1, int(symbols.max()).bit_length()))):
            bit = (column >> level & 1).astype(bool)
            ones = np.zeros(n + 1, np.int32)
            np.cumsum(bit, out=ones[1:])
            self.levels.append((level, ones, n - int(ones[-1])))
            column = np.concatenate([column[~bit], column[bit]])
        kept = order % sample == 0
        self.kept = np.zeros(n + 1, np.int32)
        np.cumsum(kept, out=self.kept[1:])
        self.places = order[kept]

    def rank(self, symbol: np.ndarray, *rows: np.ndarray) -> list[np.ndarray]:
        """How often the symbols stand before the rows of the transform."""
        at = [np.zeros_like(rows[0]), *rows]
        for level, ones, zeros in self.levels:
            bit = symbol >> level & 1
            at = [np.where(bit, zeros + ones[i], i - ones[i]) for i in at]
        return [i - at[0] for i in at[1:]]

    def before(self, rows: np.ndarray) -> np.ndarray:
        """Rows of the suffixes that are longer by one symbol."""
        symbol, at, base = np.zeros_like(rows), rows, np.zeros_like(rows)
        for level, ones, zeros in self.levels:
            bit = ones[at + 1] - ones[at]
            symbol |= bit.astype(rows.dtype) << level
            at = np.where(bit, zeros + ones[at], at - ones[at])
            base = np.where(bit, zeros + ones[base], base - ones[base])
        return self.below[symbol] + at - base

    def search(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and last row (exclusive) of the suffixes that begin with each phrase, by backward search."""
        low, high = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.below[-1])
        alive = np.flatnonzero(lengths > 0)
        low[lengths <= 0] = high[0] if len(high) else 0
        for step in range(phrases.shape[1]):
            alive = alive[(lengths[alive] > step) & (low[alive] < high[alive])]
            if not len(alive):
                break
            symbol = phrases[alive, lengths[alive] - 1 - step]
            a, b = self.rank(symbol, low[alive], high[alive])
            low[alive], high[alive] = self.below[symbol] + a, self.below[symbol] + b
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of rows: backwards to the next position that is kept."""
        found, todo, steps_back = np.empty(len(rows), np.int64), np.arange(len(rows)), 0
        while len(todo):
            kept = self.kept[rows + 1] > self.kept[rows]
            found[todo[kept]] = self.places[self.kept[rows[kept]]] + steps_back
            todo, rows = todo[~kept], self.before(rows[~kept])
            steps_back += 1
        return found


class Phrases:
    """Windows of the items of a benchmark block, equal ones once, and the items of each."""

    def __init__(self, texts: list[str | None], ids: list[str | None], window: int = WINDOW):
        hashes, offsets = words(pa.array(texts, pa.string()), ALNUM)
        n = np.diff(offsets)
        count = np.where(n == 0, 0, np.maximum(n - window + 1, 1))
        item = np.repeat(np.arange(len(n)), count)
        start = offsets[:-1][item] + np.arange(len(item)) - np.repeat(np.cumsum(count) - count, count)
        size = np.minimum(n[item], window)
        rows = np.concatenate([hashes, np.zeros(window, np.uint64)])[start[:, None] + np.arange(window)]
        rows[np.arange(window) >= size[:, None]] = 0
        keyed = np.column_stack([rows, size.astype(np.uint64)])
        unique, which = np.unique(keyed, axis=0, return_inverse=True) if len(keyed) else (keyed, item)
        self.rows, self.lengths = unique[:, :window], unique[:, window].astype(np.int64)
        self.longest = int(self.lengths.max()) if len(unique) else 0
        self.ids = sorted({i for i in ids if i is not None})
        number = {x: k for k, x in enumerate(self.ids)}
        named = np.array([number.get(x, -1) for x in ids], np.int64)[item] if len(item) else item
        pairs = np.unique(np.column_stack([which.reshape(-1), named]), axis=0)[:, :] if len(item) else np.empty((0, 2), np.int64)
        pairs = pairs[pairs[:, 1] >= 0]
        self.item_at = np.searchsorted(pairs[:, 0], np.arange(len(unique) + 1))
        self.items = pairs[:, 1]

    def hits(self, hashes: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether each word is in an occurrence, and the (text, item) pairs with occurrences."""
        n, texts = len(hashes), len(offsets) - 1
        inside, pairs = np.zeros(n + 1, np.int64), [np.empty((0, 2), np.int64)]
        if not self.longest:
            return inside[:n] > 0, pairs[0]
        step = max(SHARD_WORDS - self.longest + 1, 1)
        for first in range(0, max(n - self.longest + 1, 1), step):
            last = min(first + SHARD_WORDS, n)
            if last <= first:
                continue
            for start, window in self._occurrences(hashes[first:last], offsets[(offsets > first) & (offsets < last)] - first):
                start += first
                np.add.at(inside, start, 1)
                np.add.at(inside, start + self.lengths[window], -1)
                text = np.searchsorted(offsets, start, side="right") - 1
                both = np.unique(text * len(self.rows) + window)
                text, window = both // len(self.rows), both % len(self.rows)
                many = self.item_at[window + 1] - self.item_at[window]
                at = np.repeat(self.item_at[window] - np.cumsum(many) + many, many) + np.arange(many.sum())
                pairs.append(np.unique(np.column_stack([np.repeat(text, many), self.items[at]]), axis=0))
        return np.cumsum(inside)[:n] > 0, np.unique(np.concatenate(pairs), axis=0)

    def _occurrences(self, hashes: np.ndarray, borders: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Start and window of every occurrence, in blocks. Texts are parted by symbols that occur once."""
        known, symbols = np.unique(hashes, return_inverse=True)
        cuts = np.append(np.unique(borders), len(hashes))
        place = np.arange(len(hashes)) + np.searchsorted(cuts, np.arange(len(hashes)), side="right")
        whole = np.empty(len(hashes) + len(cuts), np.int64)
        whole[place] = symbols + len(cuts)
        whole[cuts + np.arange(len(cuts))] = len(cuts) - 1 - np.arange(len(cuts))
        back = np.zeros(len(whole), np.int64)
        back[place] = np.arange(len(hashes))
        at = np.minimum(np.searchsorted(known, self.rows), len(known) - 1)
        there = (known[at] == self.rows) | (np.arange(self.rows.shape[1]) >= self.lengths[:, None])
        windows = np.flatnonzero(there.all(axis=1))
        if not len(windows):
            return
        index = FMIndex(whole)
        for i in range(0, len(windows), WINDOWS_AT_ONCE):
            some = windows[i:i + WINDOWS_AT_ONCE]
            low, high = index.search(at[some] + len(cuts), self.lengths[some])
            some, low, high = some[high > low], low[high > low], high[high > low]
            ends = np.cumsum(high - low)
            for a in range(0, int(ends[-1]) if len(ends) else 0, ROWS_AT_ONCE):
                nth = np.arange(a, min(a + ROWS_AT_ONCE, int(ends[-1])))
                which = np.searchsorted(ends, nth, side="right")
                yield back[index.locate(low[which] + nth - (ends - high + low)[which])], some[which]


STATE = [T.StructField("_words", T.LongType()),
         T.StructField("_spans", T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))),
         T.StructField("_items", T.ArrayType(T.StringType()))]
_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))


def _merge(old, inside: np.ndarray, offsets: np.ndarray) -> list[list[dict]]:
    """Runs of hit words per text, with the spans found before."""
    out = []
    for k, (a, b) in enumerate(zip(offsets[:-1], offsets[1:])):
        hit = inside[a:b].copy()
        for s in old[k] if old is not None else ():
            hit[s["start"]:s["end"]] = True
        if not hit.any():
            out.append([])
            continue
        edge = np.flatnonzero(np.diff(np.concatenate([[0], hit.astype(np.int8), [0]])))
        out.append([{"start": int(x), "end": int(y)} for x, y in zip(edge[::2], edge[1::2])])
    return out


def find_leaks(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """All columns of ``docs`` (text among them), and ``_words``, ``_spans`` of hit words, and ``_items`` that occur.

    Columns of ``docs`` by these names are replaced.

    ``benchmark``: item_id, text. Items without words have no windows; an item of fewer words than a window is
    one; repeated items count once; an item without an id marks words but is not listed. A null text has no
    words. The benchmark is a query set: it is read in blocks of about ``block_bytes``, whose sizes are summed first,
    and each block is searched in one pass over all documents. Each task cuts its documents into shards, indexes a
    shard and drops it: nothing is shuffled, memory is that of one index.
    """
    bound_batches(docs.sparkSession)
    docs = docs.drop("_words", "_spans", "_items")
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = -(-size // block_bytes) or 1
    out, kept = docs, docs.columns
    for k in range(blocks):
        rows = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k).collect()
        sent = docs.sparkSession.sparkContext.broadcast(([r.text for r in rows], [r.item_id for r in rows]))

        def run(batches: Iterator[pa.RecordBatch], sent=sent, later=k > 0) -> Iterator[pa.RecordBatch]:
            phrases = Phrases(*sent.value, window)
            for batch in steps(batches, "text"):
                names = batch.schema.names
                hashes, offsets = words(batch.column(names.index("text")), ALNUM)
                inside, pairs = phrases.hits(hashes, offsets)
                columns = batch.columns[:-3] if later else batch.columns
                old = batch.column(names.index("_spans")).to_pylist() if later else None
                found = batch.column(names.index("_items")).to_pylist() if later else [[] for _ in range(batch.num_rows)]
                for text, item in pairs.tolist():
                    found[text].append(phrases.ids[item])
                found = [sorted(set(x)) for x in found]
                yield pa.RecordBatch.from_arrays(
                    [*columns, pa.array(np.diff(offsets)), pa.array(_merge(old, inside, offsets), _SPANS), pa.array(found, pa.list_(pa.string()))],
                    [*kept, "_words", "_spans", "_items"])

        out = out.mapInArrow(run, T.StructType([*docs.schema.fields, *STATE]))
    return out


_WORDS_SQL = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""


@query("op5_fm_decontaminate", f"""
with d as (select doc_id, {_WORDS_SQL} as w from documents),
b as (select item_id, {_WORDS_SQL} as w from benchmark),
pats as (select distinct item_id, array_to_string(w[i:i + {WINDOW} - 1], ' ') as p, least(len(w), {WINDOW}) as n
         from (select item_id, w, unnest(range(1, greatest(len(w) - {WINDOW} + 1, 1) + 1)) as i from b where len(w) > 0)),
sizes as (select distinct n from pats),
grams as (select doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') as p
          from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) as i from d, sizes where len(w) >= n)),
hits as (select doc_id, item_id, i, grams.n from grams join pats using (p, n)),
marked as (select doc_id, count(distinct k) as n_hit from (select doc_id, unnest(range(i, i + n)) as k from hits) group by doc_id),
named as (select doc_id, count(*) as n_items, string_agg(item_id::varchar, ',' order by item_id::varchar) as ids
          from (select distinct doc_id, item_id from hits) group by doc_id)
select d.doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
       sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join marked using (doc_id) left join named using (doc_id)""")
def op5_fm_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_leaks(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate("_spans", F.lit(0), lambda n, s: n + s["end"] - s["start"]).cast("long")
    return found.select(
        "doc_id", F.col("_words").alias("n_words"), n_hit.alias("n_hit"), F.size("_items").cast("long").alias("n_items"),
        F.sha2(F.array_join("_items", ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))
