"""Exact token counts of every prefix of a text, by dynamic programming over the prefixes of its pieces."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm.common import bound_batches, span_hashes, steps, table, utf8
from palimpsest.llm.pretokens import CONTRACTIONS, SPACE, classes, code_points, compiled, encoding, piece_starts
from palimpsest.llm.registry import query

LIMIT = 1024
#: A string that the library takes as one token wherever it stands.
SPECIAL = "<|endoftext|>"
#: Pieces and prefixes a worker remembers; beyond that it starts anew (only speed depends on it).
REMEMBERED = 300_000


class Prefixes:
    """Token counts of all prefixes of a piece.

    The last token of a prefix is the one suffix of it that is a token and that, behind the last token of
    what comes before, is left as it is by the merges; its count is one more than that of what comes before.
    """

    def __init__(self, path: str):
        self.encoding, self.ids = encoding(path, public_tokenizers.PATTERN)
        self.longest = max(map(len, self.ids))
        self.known: dict[bytes, tuple[int, bytes]] = {}
        self.pairs: dict[tuple[bytes, bytes], bool] = {}
        self.rows: dict[int, bytes] = {}
        self.runs: dict[str, int] = {}

    def stays(self, left: bytes, right: bytes) -> bool:
        """Whether the two tokens are the encoding of their bytes."""
        ok = self.pairs.get((left, right))
        if ok is None:
            if len(self.pairs) > REMEMBERED:
                self.pairs.clear()
            ids = self.encoding._encode_single_piece(left + right)
            ok = self.pairs[left, right] = ids == ([self.ids[left], self.ids[right]] if left else [self.ids[right]])
        return ok

    def of_bytes(self, piece: bytes) -> list[int]:
        """Counts of the prefixes of 0, 1, ... bytes."""
        counts, last, ids, longest, known = [0], [b""], self.ids, self.longest, self.known
        if len(known) > REMEMBERED:
            known.clear()
        for i in range(1, len(piece) + 1):
            prefix = piece[:i] if i <= 32 else b""
            found = known.get(prefix) if prefix else None
            if found is None:
                for k in range(max(0, i - longest), i):
                    token = piece[k:i]
                    if token in ids and self.stays(last[k], token):
                        found = counts[k] + 1, token
                        break
                else:
                    raise ValueError(f"no token ends {piece[:i]!r}")
                if prefix:
                    known[prefix] = found
            counts.append(found[0])
            last.append(found[1])
        return counts

    def of_piece(self, piece: str) -> list[int]:
        """Counts of the prefixes of 1, 2, ... characters of a piece."""
        data = piece.encode()
        counts = self.of_bytes(data)
        if len(data) != len(piece):
            counts = [0] + [c for i, c in enumerate(counts[1:], 1) if i == len(data) or data[i] & 0xC0 != 0x80]
        if len(piece) == 3 and piece in CONTRACTIONS:  # cut before its end it is two pieces
            counts[2] = self.of_bytes(data[:1])[1] + self.of_bytes(data[1:2])[1]
        return counts[1:]

    def total(self, piece: str) -> int:
        found = self.runs.get(piece)
        if found is None:
            if len(self.runs) > REMEMBERED // 10:
                self.runs.clear()
            found = self.runs[piece] = self.of_piece(piece)[-1]
        return found

    def tables(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Counts of the prefixes of 1, 2, ... characters of every text, and the texts' offsets in them."""
        points, offsets = code_points(data, offsets)
        starts = piece_starts(points, offsets)
        if not len(starts):
            return np.empty(0, np.int64), offsets
        ends = np.append(starts[1:], len(points))
        keys, first, which = np.unique(span_hashes(points, starts, ends), return_index=True, return_inverse=True)
        if len(self.rows) + len(keys) > REMEMBERED:
            self.rows.clear()
        text, rows, pool = points.tobytes(), self.rows, []
        for key, a, b in zip(keys.tolist(), starts[first].tolist(), ends[first].tolist()):
            row = rows.get(key)
            if row is None:
                row = rows[key] = np.array(self.of_piece(text[4 * a:4 * b].decode("utf-32-le")), np.uint32).tobytes()
            pool.append(row)
        lengths = (ends - starts)[first]
        pool, at = np.frombuffer(b"".join(pool), np.uint32), np.concatenate([[0], np.cumsum(lengths)[:-1]])
        totals = pool[at + lengths - 1].astype(np.int64)[which]
        before = np.cumsum(totals) - totals
        text_of = np.searchsorted(offsets, starts, side="right") - 1
        begins = np.searchsorted(starts, offsets[:-1])
        before -= np.append(before, 0)[begins][text_of]
        inside = np.arange(len(points)) - np.repeat(starts, ends - starts)
        counts = pool[np.repeat(at[which], ends - starts) + inside] + np.repeat(before, ends - starts)
        # white characters at the end of a prefix are one piece, though more text would split them
        white = classes()[points] == SPACE
        j = np.flatnonzero(white[starts[1:]] & white[starts[1:] - 1] & (text_of[1:] == text_of[:-1])) + 1
        for k, a, b in zip(j.tolist(), starts[j - 1].tolist(), starts[j].tolist()):
            counts[b] = before[k - 1] + self.total(text[4 * a:4 * b + 4].decode("utf-32-le"))
        return counts, offsets

    def of_text(self, text: str) -> list[int]:
        """As ``tables`` for one text, with special strings taken as single tokens."""
        counts: list[int] = []
        done = 0
        for n, segment in enumerate(text.split(SPECIAL)):
            if n:  # a special string, first cut short and so plain text
                tail = pieces[-1] if pieces else ""
                head = done - (self.total(tail) if tail else 0)
                for i in range(1, len(SPECIAL)):
                    counts.append(head + sum(map(self.total, _split(tail + SPECIAL[:i]))))
                done += 1
                counts.append(done)
            pieces = _split(segment)
            data = np.frombuffer(segment.encode(), np.uint8)
            own, _ = self.tables(data, np.array([0, len(data)]))
            counts += (own + done).tolist()
            done += int(own[-1]) if len(own) else 0
        return counts


def _split(text: str) -> list[str]:
    return compiled(public_tokenizers.PATTERN).findall(text)


@functools.lru_cache(maxsize=2)
def prefixes(path: str) -> Prefixes:
    return Prefixes(path)


def prefix_counts(docs: DataFrame, ranks_path: str | None = None, limit: int = LIMIT, keep_table: bool = False) -> DataFrame:
    """Per document: doc_id, n_bytes, n_tokens, over_limit, and fit_chars, the longest prefix within ``limit`` tokens.

    ``keep_table`` adds the counts of the prefixes of 1, 2, ... characters as ``counts``, for ``tokens_at`` and
    ``longest_within``. A null text is empty: no bytes, no tokens. Other columns are not looked at. Documents
    stay where they are; a task holds one step of texts and its remembered pieces.
    """
    bound_batches(docs.sparkSession)
    path = ranks_path or public_tokenizers.path("byte_bpe_50k.tiktoken")
    special = np.frombuffer(SPECIAL.encode(), np.uint8)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = prefixes(path)
        for batch in steps(batches, "text", 1 << 20):
            data, offsets = utf8(batch.column(1))
            counts, at = counter.tables(data, offsets)
            if special.tobytes() in data.tobytes():
                texts = [x or "" for x in batch.column(1).to_pylist()]
                counts = np.concatenate([np.array(counter.of_text(t), np.int64) if SPECIAL in t else counts[a:b]
                                         for t, a, b in zip(texts, at[:-1], at[1:])])
            full = at[1:] > at[:-1]
            n_tokens = np.zeros(batch.num_rows, np.int64)
            n_tokens[full] = counts[at[1:][full] - 1]
            fit = np.zeros(batch.num_rows, np.int64)
            if full.any():
                within = np.where(counts <= limit, np.arange(1, len(counts) + 1), 0)
                fit[full] = np.maximum.reduceat(within, at[:-1][full])
                fit = np.maximum(fit - at[:-1], 0)
            out = [batch.column(0), pa.array(np.diff(offsets)), pa.array(n_tokens), pa.array(n_tokens > limit), pa.array(fit)]
            if keep_table:
                out.append(pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(counts, pa.int64())))
            yield pa.RecordBatch.from_arrays(out, names)

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean, fit_chars long" + ", counts array<long>" * keep_table
    names = [x.split()[0] for x in schema.split(", ")]
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def tokens_at(counts: Column, n_chars: Column) -> Column:
    """Tokens of the prefix of so many characters, from a stored table."""
    return F.coalesce(F.get(counts, F.least(n_chars, F.size(counts)).cast("int") - 1), F.lit(0).cast("long"))


def longest_within(counts: Column, budget: Column) -> Column:
    """Characters of the longest prefix of at most ``budget`` tokens, from a stored table."""
    places = F.filter(F.transform(counts, lambda c, i: F.when(c <= budget, i + 1)), lambda i: i.isNotNull())
    return F.coalesce(F.array_max(places), F.lit(0)).cast("long")


@query("op3_prefix_counts")
def op3_prefix_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_counts(table(spark, sf_dir, "documents"))
