"""Toxicity: a support vector machine over a gapped subsequence kernel, with Nyström landmarks."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest.llm.common import bound_batches, mix, span_hashes, steps, table, utf8
from palimpsest.llm.pretokens import LETTER, NUMBER, SPACE, classes, code_points
from palimpsest.llm.registry import query

#: Labelled documents used to fit the model, for each of the two labels: those with the smallest hash of their id.
FIT_DOCS = 3000
#: A document is called toxic from this score on.
THRESHOLD = 0.3
#: The kernel compares subsequences of 4 letters within a stretch of 8, each weighing DECAY for every place it spans.
SPAN, DECAY = 8, 0.75
LANDMARKS, BACKGROUND = 160, 96
#: Letters of one piece of text; longer words are cut in overlapping ones.
PIECE, STRIDE = 24, 12
#: Places for subsequences' weights; rounds of fitting; no value of the machine counts as lower.
SLOTS = 1 << 20
ROUNDS = 4
#: Each round fits on at most so many pieces of clean texts: the highest so far, and those with the smallest hash of their number.
HARDEST, DRAWN = 6000, 12000
#: Pieces that stand for each toxic text in a round; landmarks are chosen anew in the first rounds only.
WITNESSES, LANDMARK_ROUNDS = 2, 2
FLOOR = -1.0
_GAPS = [(a, b, c) for c in range(3, SPAN) for b in range(2, c) for a in range(1, b)]
#: Digits and signs that stand for letters.
LOOKALIKES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s"}
_BEGIN, _END = 27, 28


@cache
def letter_codes() -> np.ndarray:
    """A code from 1 to 63 for every letter or digit without its case, 0 for white space, 255 for what is skipped."""
    kind = classes()
    codes = np.full(len(kind), 255, np.uint8)
    codes[kind == SPACE] = 0
    for point in [*np.flatnonzero((kind == LETTER) | (kind == NUMBER)).tolist(), *map(ord, LOOKALIKES)]:
        small = ord(LOOKALIKES.get(chr(point), chr(point)).lower()[0])
        codes[point] = small - 96 if 97 <= small <= 122 else 29 + small % 35
    return codes


def pieces(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Different pieces of the texts as one array of codes, their bounds, and which pieces each text has.

    Words are parted by white space, without other signs; letters that stand alone one after another are
    one word. Returns codes, bounds (rows of start and end), and a (piece, text) row for every occurrence.
    """
    data, offsets = utf8(texts)
    points, offsets = code_points(data, offsets)
    codes = letter_codes()[points]
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    kept = codes != 255
    codes, text = codes[kept], text[kept]
    n = len(codes)
    if not n:
        return codes, np.empty((0, 2), np.int64), np.empty((0, 2), np.int64)
    # blanks between letters that stand alone go
    space = np.concatenate([[True, True], codes == 0, [True, True]])
    border = np.concatenate([[True], text[1:] != text[:-1], [True]])
    gap = (codes == 0) & ~space[1:-3] & ~space[3:-1] & (space[:-4] | _at(border, n, -1)) & (space[4:] | _at(border, n, 2))
    gap &= ~(border[:-1] | border[1:])
    codes, text = codes[~gap], text[~gap]
    inside = codes != 0
    new = np.concatenate([[True], text[1:] != text[:-1]])
    start = inside & np.concatenate([[True], ~inside[:-1] | new[1:]])
    end = inside & np.concatenate([~inside[1:] | new[1:], [True]])
    starts, ends = np.flatnonzero(start), np.flatnonzero(end) + 1
    if not len(starts):
        return codes, np.empty((0, 2), np.int64), np.empty((0, 2), np.int64)
    many = np.maximum(1, -(-(ends - starts - PIECE) // STRIDE) + 1)
    nth = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    starts, ends = np.repeat(starts, many) + nth * STRIDE, np.repeat(ends, many)
    ends = np.minimum(ends, starts + PIECE)
    _, first, which = np.unique(span_hashes(codes, starts, ends), return_index=True, return_inverse=True)
    return codes, np.column_stack([starts[first], ends[first]]), np.column_stack([which, text[starts]])


def _at(border: np.ndarray, n: int, shift: int) -> np.ndarray:
    """Whether a text begins right before the letter beside a blank (-1), or right behind the letter after it (2)."""
    at = np.clip(np.arange(n) + shift, 0, n)
    return border[at]


def padded(codes: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pieces in a row, each between marks and followed by zeros, and where each begins."""
    length = bounds[:, 1] - bounds[:, 0]
    room = length + 2 + SPAN
    begins = np.cumsum(room) - room
    flat = np.zeros(int(room.sum()) + SPAN, np.uint32)
    at = np.repeat(begins + 1, length) + np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length)
    flat[at] = codes[np.repeat(bounds[:, 0], length) + at - np.repeat(begins + 1, length)]
    flat[begins], flat[begins + 1 + length] = _BEGIN, _END
    return flat, begins


def subsequences(flat: np.ndarray) -> Iterator[tuple[np.ndarray, float]]:
    """For every form of gaps: the slot of the subsequence that begins at each place (0: none), and its weight."""
    n = len(flat) - SPAN
    for a, b, c in _GAPS:
        x = ((flat[:n] << 18) | (flat[a:n + a] << 12) | (flat[b:n + b] << 6) | flat[c:n + c]) * np.uint32(2654435761) >> np.uint32(12)
        yield np.where((flat[:n] > 0) & (flat[c:n + c] > 0), np.maximum(x, 1), 0), DECAY ** (c + 1)


@cache
def norms() -> np.ndarray:
    """Root of the kernel of a piece with itself, as if no subsequence came twice, by length with marks."""
    total = np.ones(PIECE + 3)
    for n in range(4, PIECE + 3):
        total[n] = sum(max(0, n - c) * DECAY ** (2 * (c + 1)) for _, _, c in _GAPS)
    return np.sqrt(total)


def scores(codes: np.ndarray, bounds: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Value of the machine for every piece, from its weights for subsequences."""
    if not len(bounds):
        return np.empty(0)
    out = []
    for part in np.array_split(bounds, len(bounds) // 20_000 + 1):
        flat, begins = padded(codes, part)
        total = np.zeros(len(flat) - SPAN, np.float32)
        for slot, weight in subsequences(flat):
            total += weights[slot] * np.float32(weight)
        out.append(np.add.reduceat(total, begins) / norms()[part[:, 1] - part[:, 0] + 2])
    return np.concatenate(out)


def kernel_to(codes: np.ndarray, bounds: np.ndarray, marks: Landmarks) -> np.ndarray:
    """Kernel of every piece with every landmark."""
    out = []
    for part in np.array_split(bounds, len(bounds) // 5_000 + 1):
        flat, begins = padded(codes, part)
        owner = np.searchsorted(begins, np.arange(len(flat) - SPAN), side="right") - 1
        k = np.zeros((len(part), marks.table.shape[1]), np.float32)
        for slot, weight in subsequences(flat):
            row = marks.row_of[slot]
            hit = row > 0
            np.add.at(k, owner[hit], marks.table[row[hit]] * np.float32(weight))
        out.append(k / norms()[part[:, 1] - part[:, 0] + 2][:, None].astype(np.float32))
    return np.concatenate(out) if out else np.empty((0, marks.table.shape[1]), np.float32)


class Landmarks:
    """Subsequences of the landmarks, and the map to the Nyström features."""

    def __init__(self, codes: np.ndarray, bounds: np.ndarray):
        flat, begins = padded(codes, bounds)
        owner = np.searchsorted(begins, np.arange(len(flat) - SPAN), side="right") - 1
        root = norms()[bounds[:, 1] - bounds[:, 0] + 2]
        slots, owners, values = [], [], []
        for slot, weight in subsequences(flat):
            at = np.flatnonzero(slot)
            slots.append(slot[at])
            owners.append(owner[at])
            values.append(weight / root[owner[at]])
        slots, owners, values = map(np.concatenate, (slots, owners, values))
        self.slots, row = np.unique(slots, return_inverse=True)
        self.row_of = np.zeros(SLOTS, np.int32)
        self.row_of[self.slots] = np.arange(1, len(self.slots) + 1)
        self.table = np.zeros((len(self.slots) + 1, len(bounds)), np.float32)
        np.add.at(self.table, (row + 1, owners), values)
        gram = self.table.T.astype(np.float64) @ self.table
        value, vector = np.linalg.eigh(gram)
        good = value > 1e-6 * value[-1]
        self.map = vector[:, good] / np.sqrt(value[good])

    def weights(self, beta: np.ndarray) -> np.ndarray:
        """The machine as one weight for each subsequence."""
        out = np.zeros(SLOTS, np.float32)
        out[self.slots] = self.table[1:] @ (self.map @ beta)
        return out


def fit_svm(x: np.ndarray, y: np.ndarray, c: np.ndarray, steps_: int = 25) -> tuple[np.ndarray, float]:
    """Linear machine with squared hinge loss, by Newton steps; ``c`` is the cost of each row."""
    x = np.column_stack([x, np.ones(len(x))]).astype(np.float64)
    w, ridge = np.zeros(x.shape[1]), np.append(np.ones(x.shape[1] - 1), 1e-3)

    def loss(w):
        return 0.5 * (ridge * w) @ w + (c * np.maximum(0, 1 - y * (x @ w)) ** 2).sum()

    for _ in range(steps_):
        out = y * (x @ w) < 1
        xo, yo, co = x[out], y[out], c[out]
        gradient = ridge * w + 2 * xo.T @ (co * (xo @ w - yo))
        step = np.linalg.solve(np.diag(ridge) + 2 * (xo * co[:, None]).T @ xo, gradient)
        size, now = 1.0, loss(w)
        while size > 1e-3 and loss(w - size * step) > now:
            size /= 2
        w -= size * step
        if np.abs(size * step).max() < 1e-6:
            break
    return w[:-1], float(w[-1])


def best_of(value: np.ndarray, occurrences: np.ndarray, texts: int) -> np.ndarray:
    """For each text the highest two values among its pieces, repeats counted (FLOOR where there are none), and how
    many different pieces it has, on a log scale: among many, one may be high by chance."""
    best = np.full((texts, 3), FLOOR)
    best[:, 2] = 0
    if len(occurrences):
        pairs, times = np.unique(occurrences[:, 1] * len(value) + occurrences[:, 0], return_counts=True)
        text, piece = pairs // len(value), pairs % len(value)
        order = np.lexsort([-value[piece], text])
        text, times, v = text[order], times[order], np.maximum(value[piece[order]], FLOOR)
        first = np.flatnonzero(np.concatenate([[True], text[1:] != text[:-1]]))
        best[text[first], 0] = v[first]
        again = first[times[first] > 1]
        second = first[times[first] == 1] + 1
        second = second[second < len(text)]
        second = second[text[second] == text[second - 1]]
        best[text[again], 1], best[text[second], 1] = v[again], v[second]
        best[:, 2] = np.log1p(np.bincount(text, minlength=texts)) / 4
    return best


@dataclass
class Model:
    weights: np.ndarray | None
    bias: float
    scale: np.ndarray

    def of_texts(self, texts: pa.Array) -> np.ndarray:
        """Score of every text, from its two highest pieces and their number; 0 for a model that saw one label only."""
        if self.weights is None:
            return np.zeros(len(texts))
        codes, bounds, occurrences = pieces(texts)
        best = best_of(scores(codes, bounds, self.weights) + self.bias, occurrences, len(texts))
        value = np.where(best[:, 2] > 0, best @ self.scale[:-1] + self.scale[-1], -30)  # a text without pieces says nothing
        return 1 / (1 + np.exp(-np.clip(value, -30, 30)))


def fit(texts: list[str], labels: np.ndarray) -> Model:
    """Fits on labelled texts: a text is toxic because of one of its pieces, which is not known.

    First the piece with the most telling letters stands for each toxic text; then, by turns, the machine is fitted to the
    texts' pieces so far (WITNESSES of each) and finds better ones. Against them stand pieces found in clean texts, but not all:
    the HARDEST highest and DRAWN by hash, so that a round takes bounded time and memory however many pieces there are.
    All pieces have a say in which letters are telling, and all are valued after each round.
    Every fourth text is kept apart to turn values into scores.
    """
    labels = np.asarray(labels).astype(bool)
    if not len(labels) or labels.all() or not labels.any():
        return Model(None, 0.0, np.zeros(4))
    codes, bounds, occurrences = _pieces_of_many(texts)
    if not len(bounds):
        return Model(None, 0.0, np.zeros(4))
    apart = mix(np.arange(len(labels), dtype=np.uint64)) % np.uint64(4) == 0
    piece, text = np.unique(occurrences, axis=0).T
    used = ~apart[text]
    piece, text = piece[used], text[used]
    toxic = labels[text]
    flat, begins = padded(codes, bounds)
    n = len(flat) - SPAN
    # how much oftener the most telling few letters of a piece are in toxic texts
    in_toxic, in_clean = np.bincount(piece[toxic], minlength=len(bounds)), np.bincount(piece[~toxic], minlength=len(bounds))
    owner = np.searchsorted(begins, np.arange(n), side="right") - 1
    value, gram = np.full(len(bounds), -np.inf), flat.astype(np.uint64)
    for size in range(2, 8):
        gram[:n] = gram[:n] * np.uint64(64) + flat[size - 1:n + size - 1]  # zeros past the piece's end are dropped below
        whole = np.flatnonzero((flat[:n] > 0) & (flat[size - 1:n + size - 1] > 0))
        if size < 4:
            continue
        _, which = np.unique(gram[whole], return_inverse=True)
        t, c = (np.bincount(which, weights=x[owner[whole]]) for x in (in_toxic, in_clean))
        telling = np.log((t + 0.5) / (c + 0.5)) * np.log1p(t)
        np.maximum.at(value, owner[whole], telling[which])
    rate = in_toxic * (~labels[~apart]).sum() > 5 * in_clean * labels[~apart].sum()
    clean = np.flatnonzero(in_clean)
    marks, weights, bias = None, None, 0.0
    for turn in range(ROUNDS):
        may = toxic & rate[piece]
        order = np.lexsort([-value[piece[may]], text[may]])
        owner_text, chosen = text[may][order], piece[may][order]
        new = np.concatenate([[True], owner_text[1:] != owner_text[:-1]])
        place = np.arange(len(new)) - np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))
        chosen = chosen[place < WITNESSES]
        if not len(chosen):
            return Model(None, 0.0, np.zeros(4))
        witness, times = np.unique(chosen, return_counts=True)
        hard = clean[np.argsort(-value[clean], kind="stable")[:HARDEST]]
        some = clean[np.argsort(mix(clean.astype(np.uint64)))[:DRAWN]]
        negative = np.setdiff1d(np.union1d(hard, some), witness)
        if turn < LANDMARK_ROUNDS:
            mark = witness[np.argsort(-times * np.maximum(value[witness], 0), kind="stable")[:LANDMARKS]]
            marks = Landmarks(codes, bounds[np.union1d(mark, negative[np.argsort(mix(negative.astype(np.uint64)))[:BACKGROUND]])])
        rows = np.concatenate([witness, negative])
        features = kernel_to(codes, bounds[rows], marks) @ marks.map
        y = np.concatenate([np.ones(len(witness)), -np.ones(len(negative))])
        cost = np.concatenate([np.sqrt(times) * 2.0, np.full(len(negative), 1.0)])
        beta, bias = fit_svm(features, y, cost)
        weights = marks.weights(beta)
        value = scores(codes, bounds, weights) + bias
    best = best_of(value, occurrences, len(labels))
    return Model(weights, bias, _logistic(best[apart], labels[apart]) if len(set(labels[apart])) == 2 else _logistic(best, labels))


def _pieces_of_many(texts: list[str], at_once: int = 200) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As ``pieces``, some texts at a time, with the codes of each different piece once."""
    codes, lengths, occurrences, n = [], [], [], 0
    for first in range(0, len(texts), at_once):
        c, b, o = pieces(pa.array(texts[first:first + at_once], pa.string()))
        size = b[:, 1] - b[:, 0]
        codes.append(c[np.repeat(b[:, 0], size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)])
        lengths.append(size)
        occurrences.append(np.unique(o + [n, first], axis=0))
        n += len(b)
    codes, lengths, occurrences = map(np.concatenate, (codes, lengths, occurrences))
    if not len(lengths):
        return codes, np.empty((0, 2), np.int64), occurrences
    ends = np.cumsum(lengths)
    _, kept, which = np.unique(span_hashes(codes, ends - lengths, ends), return_index=True, return_inverse=True)
    return codes, np.column_stack([ends - lengths, ends])[kept], np.column_stack([which[occurrences[:, 0]], occurrences[:, 1]])


def _logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Logistic regression of labels on some values, slightly drawn to 0, by Newton steps."""
    x, w = np.column_stack([x, np.ones(len(x))]), np.zeros(x.shape[1] + 1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        ridge = np.array([1e-1, 1e-1, 3.0, 1e-3])  # the number of pieces is to correct, not to decide
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(ridge), x.T @ (p - y) + ridge * w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fold(doc_id: Column, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``; null for a null id."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(parts))


def learn(docs: DataFrame, labels: DataFrame, fit_docs: int = FIT_DOCS) -> Model:
    """Fits the model on at most ``fit_docs`` documents of each label, by the smallest hashes of their ids, none of fold 2 of 4.

    A document with several labels counts as toxic if one is; null labels and ids are left out. Of the sample
    each different text of an id goes once to one task, which returns the model: rows that repeat an id and its text are
    put together before, in many tasks. That task reads all text of each, and so is bound by the different texts of
    2 * ``fit_docs`` ids, not by their length; ``fit`` bounds the pieces it fits on.
    """
    known = (labels.filter("toxic in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
             .filter(fold(F.col("doc_id"), 4) != 2))
    drawn = [known.filter(F.col("toxic") == t).orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_docs) for t in (0, 1)]
    sample = drawn[0].unionByName(drawn[1])  # 2 * fit_docs rows at most
    rows = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select(
        F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"), F.col("toxic").cast("int")).distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = sorted(row for b in batches for row in zip(*(c.to_pylist() for c in b.columns)))
        model = fit([text for _, text, _ in read], np.array([toxic for *_, toxic in read]))
        slots = np.flatnonzero(model.weights) if model.weights is not None else None
        values = None if slots is None else model.weights[slots].tolist()
        yield pa.RecordBatch.from_arrays(
            [pa.array([None if slots is None else slots.tolist()], pa.list_(pa.int64())), pa.array([values], pa.list_(pa.float32())),
             pa.array([model.bias], pa.float64()), pa.array([model.scale.tolist()], pa.list_(pa.float64()))], ["slots", "values", "bias", "scale"])

    got = rows.repartition(1).mapInArrow(run, "slots array<long>, values array<float>, bias double, scale array<double>").first()
    if got is None or got.slots is None:
        return Model(None, 0.0, np.zeros(4))
    weights = np.zeros(SLOTS, np.float32)
    weights[got.slots] = got["values"]
    return Model(weights, got.bias, np.array(got.scale))


def score_documents(docs: DataFrame, model: Model) -> DataFrame:
    """All columns of ``docs`` and ``_score`` (a column by that name is replaced). Only the text is looked at; a null text is an empty one, and gets a score too.

    Each distinct piece of a step of texts is valued once. Documents stay where they are.
    """
    bound_batches(docs.sparkSession)
    docs = docs.drop("_score")
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, "text", 3 << 20):
            score = sent.value.of_texts(batch.column(batch.schema.get_field_index("text")))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score)], [*batch.schema.names, "_score"])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("_score", T.DoubleType())]))


@query("op7_toxicity")
def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score_documents(docs, learn(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", F.coalesce(fold(F.col("doc_id"), 4) == 2, F.lit(False)).alias("held_out"),
                         F.col("_score").alias("score"), (F.col("_score") >= THRESHOLD).cast("int").alias("predicted"))
