"""Interpolated modified Kneser-Ney model of word pairs, counted in Spark, kept as sorted hash arrays that workers map."""

from __future__ import annotations

import functools
import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm.common import NONSPACE, STEP_BYTES, bound_batches, mix, steps, table, words
from palimpsest.llm.registry import query
from palimpsest.session import ensure_checkpoint_dir, stage

HELD_OUT, FOLDS = 2, 7
#: Stands for the end of a text; no word has a hash that is set by hand.
END = np.uint64(0x5DEECE66D1234567)
#: Tokens of a task that are counted together before they are shuffled, and tokens (all together) for one file of pairs.
TOGETHER, FILE_TOKENS = 6_000_000, 4_000_000
#: Word ids of one file of per-word numbers.
ID_BITS = 18


def unmix(h: np.ndarray) -> np.ndarray:
    """The inverse of ``mix``."""
    h = h.astype(np.uint64, copy=True)
    for shift, factor in ((31, 0x94D049BB133111EB), (27, 0xBF58476D1CE4E5B9), (30, None)):
        h ^= h >> np.uint64(shift) ^ h >> np.uint64(2 * shift)
        if factor:
            h *= np.uint64(pow(factor, -1, 1 << 64))
    return h


def shared_folder(spark: SparkSession) -> str:
    """A new folder that driver and workers reach by the same path, so that workers can map its files."""
    ensure_checkpoint_dir(spark)
    url = urlparse(spark.sparkContext.getCheckpointDir())
    if url.scheme not in ("", "file"):
        raise ValueError(f"files in {url.scheme}: can't be mapped; name a mounted folder in spark.checkpoint.dir")
    path = f"{url.path}/model-{uuid.uuid4().hex}"
    os.makedirs(path, exist_ok=True)
    return path


def _save(path: str, array: np.ndarray) -> None:
    """Whole or not at all: a task that is run again, or twice at once, leaves the same file."""
    mine = f"{path}.{uuid.uuid4().hex}"
    with open(mine, "wb") as f:
        np.save(f, array)
    os.replace(mine, path)


def _tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of each text, END after each, and the offsets."""
    hashes, offsets = words(texts, NONSPACE)
    return np.insert(hashes, offsets[1:], END), offsets + np.arange(len(offsets))


def _summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    key, which = np.unique(np.concatenate(keys), return_inverse=True)
    return key, np.bincount(which, weights=np.concatenate(counts)).astype(np.int64)


def _rows(key: np.ndarray, count: np.ndarray, bits: int) -> Iterator[pa.RecordBatch]:
    bucket = (key >> np.uint64(64 - bits)).astype(np.int32)
    for a in range(0, len(key), 1 << 18):
        cut = slice(a, a + (1 << 18))
        yield pa.RecordBatch.from_arrays([pa.array(bucket[cut]), pa.array(key[cut].view(np.int64)), pa.array(count[cut])], ["bucket", "key", "n"])


def _counted(batches: Iterator[pa.RecordBatch], keys_of, bits: int) -> Iterator[pa.RecordBatch]:
    """Counts of the keys of all texts, summed over many texts before they leave the task."""
    keys, counts, size = [], [], 0
    for batch in steps(batches, "text"):
        key, n = np.unique(keys_of(batch.column(0)), return_counts=True)
        keys.append(key)
        counts.append(n)
        size += len(key)
        if size > TOGETHER:
            keys, counts = ([x] for x in _summed(keys, counts))
            size = len(keys[0])
            if size > TOGETHER // 2:
                yield from _rows(keys[0], counts[0], bits)
                keys, counts, size = [], [], 0
    if keys:
        yield from _rows(*_summed(keys, counts), bits)


def _by_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """The summed keys of every bucket of a partition, which holds few of them, whole."""
    parts = [tuple(np.asarray(c) for c in b.columns) for b in batches if b.num_rows]
    if not parts:
        return
    bucket, key, n = map(np.concatenate, zip(*parts))
    order = np.argsort(bucket, kind="stable")
    bucket, key, n = bucket[order], key[order].view(np.uint64), n[order]
    cuts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])).tolist() + [len(bucket)]
    for a, b in zip(cuts, cuts[1:]):
        yield int(bucket[a]), *_summed([key[a:b]], [n[a:b]])


class Sorted:
    """Sorted 64-bit hashes in files by their top bits, mapped, with a number for each."""

    def __init__(self, folder: str, name: str, bits: int):
        load = lambda kind, b: np.load(p, mmap_mode="r") if os.path.exists(p := f"{folder}/{name}-{b}-{kind}.npy") else np.empty(0, np.uint64)
        self.bits = bits
        self.files = [(load("key", b), load("n", b)) for b in range(1 << bits)]
        self.before = np.concatenate([[0], np.cumsum([len(k) for k, _ in self.files])])

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place among all keys (-1 if it isn't there) and number of each of the sorted ``keys``."""
        place, number = np.full(len(keys), -1), np.zeros(len(keys), np.int64)
        cuts = np.searchsorted(keys >> np.uint64(64 - self.bits), np.arange((1 << self.bits) + 1, dtype=np.uint64))
        for b in np.flatnonzero(np.diff(cuts)):
            (known, n), part = self.files[b], slice(cuts[b], cuts[b + 1])
            if len(known):
                at = np.minimum(np.searchsorted(known, keys[part]), len(known) - 1)
                hit = known[at] == keys[part]
                place[part] = np.where(hit, at + self.before[b], -1)
                number[part] = np.where(hit, n[at], 0)
        return place, number


@dataclass(frozen=True)
class Model:
    """Where the arrays are, and the numbers of the whole corpus."""

    folder: str
    word_bits: int
    pair_bits: int
    tokens: int
    words: int
    texts: int
    kinds: int
    pair_discounts: tuple[float, float, float]
    word_discounts: tuple[float, float, float]
    word_mass: float


@functools.lru_cache(maxsize=4)
def _words_of(folder: str, bits: int) -> Sorted:
    return Sorted(folder, "word", bits)


def _ids(hashes: np.ndarray, vocabulary: Sorted) -> tuple[np.ndarray, np.ndarray]:
    unique, which = np.unique(hashes, return_inverse=True)
    place, number = vocabulary.find(unique)
    return place[which], number[which]


def _pair_keys(ids: np.ndarray, offsets: np.ndarray, begin: int) -> np.ndarray:
    """A key for every token and the one before it (``begin`` before the first of a text)."""
    left = np.empty_like(ids)
    left[1:] = ids[:-1]
    left[offsets[:-1]] = begin
    return left, mix(left.astype(np.uint64) << np.uint64(32) | ids.astype(np.uint64))


def discounts(n: list[int]) -> tuple[float, float, float]:
    """Discounts for counts of 1, 2 and more, from how many things were counted 1, 2, 3 and 4 times."""
    if min(n) <= 0:
        return 0.5, 1.0, 1.5
    y = n[0] / (n[0] + 2 * n[1])
    return tuple(min(max(k - (k + 1) * y * n[k] / n[k - 1], 0.0), float(k)) for k in (1, 2, 3))


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id as text leaves HELD_OUT modulo FOLDS; not for a null id."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(FOLDS)) == HELD_OUT, F.lit(False))


def train(texts: DataFrame) -> Model:
    """Counts words, then pairs, of the column ``text`` (null: empty), and writes the arrays.

    Words get ids by the order of their hashes. Pairs are dealt by a hash of both words, so that a word that is a
    third of all tokens is spread, and come summed from each task. A task writes the sorted files of its buckets
    and passes on what its pairs say of their words; that is summed by word, and written by id. The driver sees
    only sizes and sums.
    """
    spark = texts.sparkSession
    bound_batches(spark)
    folder = shared_folder(spark)
    texts = texts.select("text")
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    word_bits = max(4, (partitions - 1).bit_length())

    def count_words(batches):
        return _counted(batches, lambda t: _tokens(t)[0], word_bits)

    def write_words(batches):
        for bucket, key, n in _by_bucket(batches):
            _save(f"{folder}/word-{bucket}-key.npy", key)
            _save(f"{folder}/word-{bucket}-n.npy", n)
            yield pa.RecordBatch.from_arrays([pa.array([len(key)]), pa.array([int(n.sum())])], ["words", "tokens"])

    rows = texts.mapInArrow(count_words, "bucket int, key long, n long").repartition(1 << word_bits, "bucket")
    n_words, n_tokens = rows.mapInArrow(write_words, "words long, tokens long").agg(F.sum("words"), F.sum("tokens")).first()
    n_words, n_tokens = n_words or 0, n_tokens or 0
    if n_words >= 1 << 31:
        raise ValueError("more different words than ids")
    pair_bits = max(word_bits, (n_tokens // FILE_TOKENS).bit_length())

    def count_pairs(batches):
        def keys_of(text):
            hashes, offsets = _tokens(text)
            return _pair_keys(_ids(hashes, _words_of(folder, word_bits))[0], offsets, n_words)[1]
        return _counted(batches, keys_of, pair_bits)

    def write_pairs(batches):
        for bucket, key, n in _by_bucket(batches):
            _save(f"{folder}/pair-{bucket}-key.npy", key)
            _save(f"{folder}/pair-{bucket}-n.npy", np.minimum(n, 2**32 - 1).astype(np.uint32))
            pair = unmix(key)
            left, which = np.unique((pair >> np.uint64(32)).astype(np.int64), return_inverse=True)
            ones, twos, more = (np.bincount(which[m], minlength=len(left)) for m in (n == 1, n == 2, n > 2))
            right, times = np.unique((pair & np.uint64(0xFFFFFFFF)).astype(np.int64), return_counts=True)
            none = np.zeros(len(right), np.int64)
            yield _numbers(0, left, ones, twos, more)
            yield _numbers(1, right, times, none, none)
            yield _numbers(2, np.arange(1, 5), np.array([(n == k).sum() for k in range(1, 5)]), none[:4] if len(none) > 3 else np.zeros(4, np.int64), np.zeros(4, np.int64))

    rows = texts.mapInArrow(count_pairs, "bucket int, key long, n long").repartition(1 << pair_bits, "bucket")
    said = rows.mapInArrow(write_pairs, "kind int, id long, a long, b long, c long")
    said = stage(said.groupBy("kind", "id").agg(*[F.sum(x).alias(x) for x in "abc"]))
    of_pairs = {r.id: r.a for r in said.filter("kind = 2").collect()}
    of_words = {r.a: r.n for r in said.filter("kind = 1 and a <= 4").groupBy("a").agg(F.count("*").alias("n")).collect()}
    kinds, known, many = said.filter("kind = 1").agg(F.sum("a"), F.count("*"), F.sum((F.col("a") > 2).cast("long"))).first()
    pair_d, word_d = (discounts([x.get(k, 0) for k in range(1, 5)]) for x in (of_pairs, of_words))

    def write_numbers(batches):
        parts = [tuple(np.asarray(c) for c in b.columns) for b in batches if b.num_rows]
        if parts:
            file, kind, id_, value = map(np.concatenate, zip(*parts))
            for k in np.unique(file):
                for kind_, name in ((0, "mass"), (1, "times")):
                    mine = (file == k) & (kind == kind_)
                    dense = np.zeros(1 << ID_BITS)
                    dense[id_[mine] & ((1 << ID_BITS) - 1)] = value[mine]
                    _save(f"{folder}/{name}-{k}.npy", dense)
        yield pa.RecordBatch.from_arrays([pa.array([len(parts)], pa.int64())], ["n"])

    mass = sum((F.col(x) * d for x, d in zip("abc", pair_d)), F.lit(0.0))
    numbers = said.filter("kind < 2").select((F.shiftright("id", ID_BITS)).cast("int").alias("file"), "kind", "id", F.when(F.col("kind") == 0, mass).otherwise(F.col("a").cast("double")).alias("value"))
    numbers.repartition(max(1, min(1 << pair_bits, (n_words >> ID_BITS) + 1)), "file").mapInArrow(write_numbers, "n long").agg(F.sum("n")).collect()
    word_mass = word_d[0] * of_words.get(1, 0) + word_d[1] * of_words.get(2, 0) + word_d[2] * (many or 0)
    n_texts = texts.count()
    return Model(folder, word_bits, pair_bits, n_tokens, n_words, n_texts, kinds or 0, pair_d, word_d, float(word_mass))


def _numbers(kind: int, ids: np.ndarray, a: np.ndarray, b: np.ndarray, c: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), kind, np.int32)), *(pa.array(x.astype(np.int64)) for x in (ids, a, b, c))], ["kind", "id", "a", "b", "c"])


class Scorer:
    def __init__(self, model: Model):
        self.model = model
        self.vocabulary, self.pairs = Sorted(model.folder, "word", model.word_bits), Sorted(model.folder, "pair", model.pair_bits)
        files = (model.words >> ID_BITS) + 1
        load = lambda name, k: np.load(p, mmap_mode="r") if os.path.exists(p := f"{model.folder}/{name}-{k}.npy") else np.zeros(1 << ID_BITS)
        self.mass, self.times = ([load(name, k) for k in range(files)] for name in ("mass", "times"))

    @staticmethod
    def _take(files: list[np.ndarray], ids: np.ndarray) -> np.ndarray:
        out = np.zeros(len(ids))
        for k in np.unique(ids[ids >= 0] >> ID_BITS):
            mine = (ids >> ID_BITS == k) & (ids >= 0)
            out[mine] = files[k][ids[mine] & ((1 << ID_BITS) - 1)]
        return out

    def score(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Tokens, known tokens, base score and model score of every text."""
        m = self.model
        hashes, offsets = _tokens(texts)
        unique, which = np.unique(hashes, return_inverse=True)
        ids, count = self.vocabulary.find(unique)
        # of each different word: probability by the lower order
        times = self._take(self.times, ids)
        d = np.choose(np.clip(times, 0, 3).astype(int), [0.0, *m.word_discounts])
        lower = np.full(len(ids), 1.0 / (m.words + 1))
        if m.kinds:
            lower = np.maximum(times - d, 0) / m.kinds + m.word_mass / m.kinds * lower
        ids, count_of, lower = ids[which], count[which], lower[which]
        left, key = _pair_keys(ids, offsets, m.words)
        both = (left >= 0) & (ids >= 0)
        keys, back = np.unique(key[both], return_inverse=True)
        pair = np.zeros(len(ids))
        pair[both] = self.pairs.find(keys)[1][back]
        total = np.empty(len(ids))
        total[1:] = count_of[:-1]
        total[offsets[:-1]] = m.texts
        mass = np.zeros(len(ids))
        lefts, back = np.unique(left, return_inverse=True)
        mass = self._take(self.mass, lefts)[back]
        d = np.choose(np.clip(pair, 0, 3).astype(int), [0.0, *m.pair_discounts])
        seen = (left >= 0) & (total > 0)
        p = np.where(seen, (np.maximum(pair - d, 0) + mass * lower) / np.where(seen, total, 1), lower)
        first = offsets[:-1]
        add = lambda x: np.add.reduceat(x, first) if len(first) else x[:0]
        base = np.log10((count_of + 1) / (m.tokens + m.words + 1))
        return np.diff(offsets), add((count_of > 0).astype(np.int64)), add(base), add(np.log10(p))


@functools.lru_cache(maxsize=2)
def scorer(model: Model) -> Scorer:
    return Scorer(model)


def score_texts(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and text in; doc_id, n_tokens, n_known, train_tokens, base_score and score out. Documents stay where they are."""
    bound_batches(docs.sparkSession)
    names = ["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, "text", STEP_BYTES // 2):
            n, known, base, score = scorer(model).score(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n), pa.array(known), pa.array(np.full(len(n), model.tokens, np.int64)),
                                              pa.array(base), pa.array(score)], names)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_tokens long, n_known long, train_tokens long, base_score double, score double")


@query("op9_kneser_ney")
def op9_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learns from the documents that are not held out, and scores all. Null texts are empty: one token, the end."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs.filter(~held_out(F.col("doc_id"))))
    return score_texts(docs, model).withColumn("held_out", held_out(F.col("doc_id"))).select(
        "doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
