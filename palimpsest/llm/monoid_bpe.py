"""Byte-level BPE as a reduction over a tree: encode halves, join neighbours by re-encoding where they meet."""

from __future__ import annotations

import functools
import hashlib
from array import array
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from palimpsest.llm.common import bound_batches, steps, table
from palimpsest.llm.pretokens import compiled, encoding
from palimpsest.llm.registry import query

#: Characters of text encoded without further halving, and bytes of one piece that are merged at once.
LEAF_CHARS, LEAF_BYTES = 4096, 512
#: No piece depends on more characters behind its start or end than this (a contraction; one character of look-ahead).
REACH = 3
#: Pieces a worker remembers; beyond that it starts anew (only speed depends on it).
REMEMBERED = 400_000

#: A part of a text: its pieces, and the ids of each as little-endian 32-bit integers.
Part = tuple[list[str], list[bytes]]


class TreeCoder:
    def __init__(self, path: str, pattern: str):
        self.encoding, ranks = encoding(path, pattern)
        self.bytes_of = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.bytes_of[rank] = token
        self.pattern = compiled(pattern)
        self.known: dict[str, bytes] = {}

    def encode(self, text: str) -> bytes:
        """Ids of a whole text as little-endian 32-bit integers."""
        return b"".join(self._part(text)[1])

    def decode(self, ids: array) -> bytes:
        """Bytes of the ids, concatenated up the tree."""
        if len(ids) <= LEAF_CHARS:
            return b"".join(map(self.bytes_of.__getitem__, ids))
        half = len(ids) // 2
        return self.decode(ids[:half]) + self.decode(ids[half:])

    def _part(self, text: str) -> Part:
        if len(text) <= LEAF_CHARS:
            pieces = self.pattern.findall(text)
            return pieces, [self._piece(p) for p in pieces]
        half = len(text) // 2
        return self._join(self._part(text[:half]), self._part(text[half:]))

    def _join(self, a: Part, b: Part) -> Part:
        """The part of both texts together.

        A boundary of ``a`` with REACH characters of ``a`` behind it stays one, whatever follows. From there
        the pattern is matched anew over a window into ``b`` that grows until a match begins where a piece of
        ``b`` does: what follows depends only on text from there on, and so is as ``b`` has it.
        """
        first, tail = len(a[0]), 0
        while first and tail < REACH:
            first -= 1
            tail += len(a[0][first])
        left, taken = "".join(a[0][first:]), 2
        while True:
            right = b[0][:taken]
            window, whole, places = left + "".join(right), taken >= len(b[0]), {}
            at = len(left)
            for k, piece in enumerate(right):
                places[at] = k
                at += len(piece)
            pieces, meets = [], len(b[0]) if whole else None
            for m in self.pattern.finditer(window):
                if m.start() in places:
                    meets = places[m.start()]
                    break
                if not whole and m.end() > len(window) - REACH:
                    break
                pieces.append(m.group())
            if meets is not None:
                return (a[0][:first] + pieces + b[0][meets:], a[1][:first] + [self._piece(p) for p in pieces] + b[1][meets:])
            taken *= 2

    def _piece(self, piece: str) -> bytes:
        found = self.known.get(piece)
        if found is None:
            data = piece.encode()
            if len(data) > LEAF_BYTES:
                return array("I", self._tokens(data)).tobytes()
            if len(self.known) > REMEMBERED:
                self.known.clear()
            found = self.known[piece] = array("I", self.encoding._encode_single_piece(data)).tobytes()
        return found

    def _tokens(self, data: bytes) -> list[int]:
        """Tokens of one piece, however long, by halves."""
        if len(data) <= LEAF_BYTES:
            return self.encoding._encode_single_piece(data)
        half = len(data) // 2
        left, right = self._tokens(data[:half]), self._tokens(data[half:])
        n = 2
        while True:
            i, j = max(0, len(left) - n), min(len(right), n)
            middle = self.encoding._encode_single_piece(b"".join(self.bytes_of[t] for t in left[i:] + right[:j]))
            # tokens are an encoding if and only if every two neighbours are one
            if (not i or self._stays(left[i - 1], middle[0])) and (j == len(right) or self._stays(middle[-1], right[j])):
                return left[:i] + middle + right[j:]
            n *= 2

    def _stays(self, a: int, b: int) -> bool:
        return self.encoding._encode_single_piece(self.bytes_of[a] + self.bytes_of[b]) == [a, b]


@functools.lru_cache(maxsize=2)
def coder(path: str, pattern: str) -> TreeCoder:
    return TreeCoder(path, pattern)


def encode_texts(docs: DataFrame, ranks_path: str | None = None, ids: bool = False) -> DataFrame:
    """All columns of ``docs``, and for the column text: ``_n_tokens``, ``_ids_sha256`` and ``_decoded_sha256``.

    With ``ids``, also ``_ids``, an array of the token ids. A null text is an empty one: no tokens. Columns of ``docs`` by
    these names are replaced. Documents stay where they are; a task holds a step of texts and its remembered pieces.
    """
    bound_batches(docs.sparkSession)
    path = ranks_path or public_tokenizers.path("byte_bpe_50k.tiktoken")
    pattern = public_tokenizers.PATTERN
    extra = [T.StructField("_n_tokens", T.LongType()), T.StructField("_ids_sha256", T.StringType()), T.StructField("_decoded_sha256", T.StringType()),
             *[T.StructField("_ids", T.ArrayType(T.IntegerType()))] * ids]
    names = [f.name for f in extra]
    docs = docs.drop(*names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = coder(path, pattern)
        for batch in steps(batches, "text"):
            codes, rows = [], []
            for text in batch.column(batch.schema.get_field_index("text")).to_pylist():
                code = tree.encode(text or "")
                tokens = array("I", code)
                rows.append((len(tokens), hashlib.sha256(code).hexdigest(), hashlib.sha256(tree.decode(tokens)).hexdigest()))
                codes.append(code)
            columns = [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.string(), pa.string()))]
            if ids:
                at = np.concatenate([[0], np.cumsum([r[0] for r in rows])])
                columns.append(pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(np.frombuffer(b"".join(codes), np.int32))))
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], [*batch.schema.names, *names])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, *extra]))


@query("op6_monoid_bpe")
def op6_monoid_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = encode_texts(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return docs.selectExpr("doc_id", "_n_tokens as n_tokens", "_ids_sha256 as ids_sha256", "_decoded_sha256 as decoded_sha256")
