"""Near-duplicate documents: DartMinHash signatures of weighted word shingles, banded joining, exact checks."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm.common import ALNUM, bits_apart, bound_batches, mix, parities, span_hashes, steps, table, utf8, words
from palimpsest.llm.registry import query
from palimpsest.session import stage

SHINGLE = 5
SIMILAR = 0.8
#: 36 bands of 5: two documents that are alike to 0.8 share no band with a chance of 6e-7.
BANDS, ROWS = 36, 5
#: Times that documents alike to none are looked for; any number gives the same classes.
PRUNINGS = 3
#: A table of ids is sent to all tasks if it has at most so many rows of 16 bytes.
BROADCAST_ROWS = 2_000_000
_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)
#: Chances that a cell of area 1 holds at most 0, 1, ... darts, as 64-bit numbers.
_DARTS = np.array([int(min(sum(math.exp(-1) / math.factorial(i) for i in range(n + 1)), 1 - 2**-53) * 2**64) for n in range(14)], np.uint64)


def shingles(hashes: np.ndarray, offsets: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of ``size`` words of each text, and the texts' offsets; fewer words, but not none, are one run."""
    n = np.diff(offsets)
    count = np.where(n == 0, 0, np.maximum(n - size + 1, 1))
    out = np.concatenate([[0], np.cumsum(count)])
    text = np.repeat(np.arange(len(n)), count)
    at = offsets[:-1][text] + np.arange(len(text)) - out[text]
    padded = np.concatenate([hashes, np.zeros(size, np.uint64)])
    left = (n[text] if len(text) else np.empty(0, np.int64)) - (at - offsets[:-1][text])
    total = np.zeros(len(text), np.uint64)
    for k in range(size):
        total = total * np.uint64(0x9E3779B97F4A7C15) + np.where(k < left, padded[at + k], np.uint64(k + 1))
    return mix(total), out


def weighted(elements: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """An element that stands n times in a text becomes n different ones, the same n in every text.

    Equal parts of weighted sets are then equal parts of plain sets.
    """
    text = np.repeat(np.arange(len(offsets) - 1, dtype=np.uint64), np.diff(offsets))
    order = np.argsort(mix(elements + text * np.uint64(0xD6E8FEB86659FD93)), kind="stable")
    e, t = elements[order], text[order]
    fresh = np.concatenate([[True], (e[1:] != e[:-1]) | (t[1:] != t[:-1])]) if len(e) else np.empty(0, bool)
    nth = np.arange(len(e)) - np.maximum.accumulate(np.where(fresh, np.arange(len(e)), 0)) if len(e) else np.empty(0, np.int64)
    out = np.empty_like(elements)
    out[order] = mix(e + nth.astype(np.uint64) * np.uint64(0xA0761D6478BD642F))
    return out


def dart_signatures(columns: np.ndarray, offsets: np.ndarray, k: int) -> np.ndarray:
    """Signatures of ``k`` darts for the texts that have columns; the others' rows are all _EMPTY.

    ``columns`` are units of weight. Over each stands a strip of cells of area 1 that reaches up without end; a cell's hash
    says how many darts it holds (Poisson, mean 1), where they stand and which coordinate each belongs to. Of a text
    only the cells below t / weight are looked at, so that about t darts come for any weight, enough for all coordinates to
    get one; for the few texts where one is left empty, the height is doubled. The lowest dart of a coordinate is
    the same in two texts with the chance of their weighted likeness.
    """
    texts = len(offsets) - 1
    found = np.full(texts * k, _EMPTY)
    weight = np.diff(offsets)
    height = np.where(weight > 0, (k * math.log(k) + 2 * k) / np.maximum(weight, 1), 0)
    todo = np.flatnonzero(weight)
    while len(todo):
        for some in np.array_split(todo, max(1, int((weight[todo] * np.ceil(height[todo])).sum() // 2_000_000) + 1)):
            _throw(found, columns, offsets, some, height, k)
        empty = (found.reshape(texts, k)[todo] == _EMPTY).any(axis=1)
        todo = todo[empty]
        height[todo] *= 2
    return found.reshape(texts, k)


def _throw(found: np.ndarray, columns: np.ndarray, offsets: np.ndarray, some: np.ndarray, height: np.ndarray, k: int) -> None:
    if not len(some):
        return
    n = np.diff(offsets)[some]
    text = np.repeat(some, n)
    column = columns[np.repeat(offsets[some], n) + np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n)]
    cells = np.ceil(height[text]).astype(np.int64)
    level = np.arange(cells.sum()) - np.repeat(np.cumsum(cells) - cells, cells)
    text, column = np.repeat(text, cells), np.repeat(column, cells)
    cell = mix(column + level.astype(np.uint64) * np.uint64(0xE7037ED1A0B428DB))
    darts = np.searchsorted(_DARTS, cell, side="right")
    text, cell, level = np.repeat(text, darts), np.repeat(cell, darts), np.repeat(level, darts)
    nth = np.arange(len(cell)) - np.repeat(np.cumsum(darts) - darts, darts)
    dart = mix(cell ^ (nth.astype(np.uint64) + np.uint64(1)) * np.uint64(0x8EBC6AF09C88C6E3))
    low = level + (dart >> np.uint64(32)) / 2.0**32 < height[text]
    text, dart, level = text[low], dart[low], level[low]
    place = text * k + ((dart & np.uint64(0xFFFFFFFF)) * np.uint64(k) >> np.uint64(32)).astype(np.int64)
    # height of the dart in its strip: whole cells, then 32 bits; the low bits only tell darts of one height apart
    np.minimum.at(found, place, level.astype(np.uint64) << np.uint64(40) | (dart >> np.uint64(32)) << np.uint64(8) | mix(dart & np.uint64(0xFFFFFFFF)) & np.uint64(255))


def band_hashes(signatures: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """A hash for every band of a signature, with the band's number in it."""
    texts, k = signatures.shape
    parts = signatures.reshape(texts, k // rows, rows)
    total = np.arange(1, k // rows + 1, dtype=np.uint64)[None, :] * np.uint64(0x9E3779B97F4A7C15)
    for r in range(rows):
        total = mix(total ^ parts[:, :, r])
    return total


def _columns(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Two 64-bit keys of each text's words, and the weighted shingles with their offsets."""
    hashes, offsets = words(texts, ALNUM)
    data, at = utf8(texts)
    first = span_hashes(hashes, offsets[:-1], offsets[1:])
    second = span_hashes(mix(hashes), offsets[:-1], offsets[1:])
    wordless = offsets[1:] == offsets[:-1]
    own = span_hashes(data, at[:-1], at[1:])
    first, second = np.where(wordless, own, first), np.where(wordless, mix(own), second)
    runs, offsets = shingles(hashes, offsets)
    return first, second, weighted(runs, offsets), offsets


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, the keys k1 and k2 of the sequence of words, the number of shingles n, and the bands."""
    bound_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, "text", 1 << 20):
            first, second, columns, offsets = _columns(batch.column(1))
            bands = band_hashes(dart_signatures(columns, offsets, BANDS * ROWS))
            n = np.diff(offsets)
            at = np.concatenate([[0], np.cumsum(np.where(n > 0, BANDS, 0))])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.int64()), pa.array(first.view(np.int64)), pa.array(second.view(np.int64)), pa.array(n),
                 pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(bands[n > 0].reshape(-1).view(np.int64)))],
                ["doc_id", "k1", "k2", "n", "bands"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, k1 long, k2 long, n long, bands array<long>")


def features(docs: DataFrame) -> DataFrame:
    """doc_id, the keys of its words, and its weighted shingles as an array of 32-bit hashes and as parity bits."""
    bound_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, "text", 1 << 20):
            first, second, columns, offsets = _columns(batch.column(1))
            short = (columns >> np.uint64(32)).astype(np.uint32).view(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.int64()), pa.array(first.view(np.int64)), pa.array(second.view(np.int64)),
                 pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(short)), parities(columns, offsets)], ["doc_id", "k1", "k2", "items", "bits"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, k1 long, k2 long, items array<int>, bits array<long>")


def _small(df: DataFrame) -> DataFrame:
    """A written table of few columns: broadcast if its rows are counted to be few, joined by a shuffle otherwise."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def _alike(a: Column, b: Column) -> Column:
    """Whether sizes allow the similarity at all."""
    return F.least(a, b) >= SIMILAR * F.greatest(a, b)


def _near(n_a: Column, n_b: Column, bits_a: Column, bits_b: Column) -> Column:
    """Whether sizes and parity bits allow the similarity: two sets differ in at least as many shingles as their bits do."""
    return _alike(n_a, n_b) & ((1 + SIMILAR) * bits_apart(bits_a, bits_b) <= (1 - SIMILAR) * (n_a + n_b) + 1e-6)


def checked(pairs: DataFrame, items: DataFrame) -> DataFrame:
    """Of the pairs (a, b), those whose weighted shingles are alike to SIMILAR or more."""
    a = items.select(F.col("node").alias("a"), F.col("items").alias("items_a"))
    b = items.select(F.col("node").alias("b"), F.col("items").alias("items_b"))
    both = F.size(F.array_intersect("items_a", "items_b"))
    either = F.size("items_a") + F.size("items_b") - both
    # hashes of a text are made distinct by array_intersect; repeats among 32-bit hashes of one text are negligible
    return pairs.join(a, "a").join(b, "b").filter(both >= SIMILAR * either).select("a", "b").distinct()


def components(links: DataFrame) -> DataFrame:
    """node and class, the smallest node that links lead to, for every node with links.

    Stars are turned to their smallest neighbour, large and small by turns, until no link changes. Each turn is two
    grouped minima and joins, written and read again; nothing is collected.
    """
    edges = stage(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u != v").distinct())
    before = None
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = stage(large.filter("u != v").distinct())
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        turned = large.join(least, "u")
        small = turned.select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        edges = stage(small.filter("u != v").distinct())
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("class"))
        before = now


def _open_members(shared: DataFrame, classes: DataFrame, items: DataFrame) -> DataFrame:
    """Rows (bucket, node, n, met, class, bits) of the buckets in which documents of several classes are left."""
    member = shared.join(classes, "node", "left").select("bucket", "node", "n", "met", F.coalesce("class", "node").alias("class"))
    open_ = member.groupBy("bucket").agg(F.min("class").alias("low"), F.max("class").alias("high")).filter("low != high").select("bucket")
    return stage(member.join(open_, "bucket").join(items.select("node", "bits"), "node"))


def _pairs_with(member: DataFrame, order: Column) -> DataFrame:
    """In each open bucket, all documents of other classes with the one that is first in ``order``, as far as they can be alike with it."""
    pick = F.min(F.struct(order.alias("h"), "node", "n", "class", "bits")).alias("pick")
    both = member.join(member.groupBy("bucket").agg(pick), "bucket")
    both = both.filter((F.col("class") != F.col("pick.class")) & _near(F.col("n"), F.col("pick.n"), F.col("bits"), F.col("pick.bits")))
    return both.select(F.least("node", "pick.node").alias("a"), F.greatest("node", "pick.node").alias("b")).distinct()


def _head_pairs(member: DataFrame, items: DataFrame) -> DataFrame:
    """With the best-met document of each bucket."""
    return _pairs_with(member, -F.col("met"))


def _chance_pairs(member: DataFrame, items: DataFrame) -> DataFrame:
    """With one that chance picks, another one in every bucket."""
    return _pairs_with(member, F.xxhash64("node", "bucket"))


def _last_pairs(member: DataFrame, items: DataFrame) -> DataFrame:
    """All pairs of different classes in open buckets that can be alike at all, each once.

    Shingles that no other class has are in no such pair's common part. A document with too many of them
    is alike to none and goes, by which more shingles become one class's own; so this is done PRUNINGS times. Of others,
    each pair must leave room for the likeness, and its parity bits must allow it. Near copies of one text that are not alike to each other differ by
    just such shingles, and so are not compared.
    """
    node = member.select("node", "class").distinct()
    each = stage(node.join(items, "node").select("node", "class", F.explode("items").alias("item")))
    sizes = member.select("node", "n").distinct()
    for _ in range(PRUNINGS):
        own = each.groupBy("item").agg(F.min("class").alias("low"), F.max("class").alias("high")).filter("low = high").select("item")
        own = each.join(own, "item").groupBy("node").agg(F.count("*").alias("own"))
        sizes = sizes.select("node", "n").join(own, "node", "left").withColumn("room", F.col("n") - F.coalesce("own", F.lit(0)))
        sizes = stage(sizes.filter(F.col("room") >= SIMILAR * F.col("n")).select("node", "n", "room"))
        each = each.join(sizes.select("node"), "node", "left_semi")
    left = member.join(sizes.select("node", "room"), "node")
    buckets = left.groupBy("node").agg(F.collect_set("bucket").alias("buckets"))  # one for each band at most
    left = stage(left.join(buckets, "node").select("bucket", "node", "n", "class", "room", "buckets", "bits"))
    a, b = (left.select("bucket", *[F.col(c).alias(f"{c}_{x}") for c in left.columns[1:]]) for x in "ab")
    most = F.least("room_a", "room_b")
    possible = (F.col("class_a") < F.col("class_b")) & (most >= SIMILAR * (F.col("n_a") + F.col("n_b") - most))
    first = F.array_min(F.array_intersect("buckets_a", "buckets_b")) == F.col("buckets.bucket")
    near = _near(F.col("n_a"), F.col("n_b"), F.col("bits_a"), F.col("bits_b"))
    a, b = a.alias("buckets"), b.alias("others")
    return a.join(b, (F.col("buckets.bucket") == F.col("others.bucket")) & possible & first & near).select(
        F.col("node_a").alias("a"), F.col("node_b").alias("b"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, class_id (smallest doc_id of its group of near-duplicates), copies (documents of the same words).

    Words are runs of letters, digits and bytes beyond ASCII, A-Z lowered; shingles of five words are weighted by how often
    they occur; a shorter text is one shingle; a text without words is like equal texts only, as is a null one, which is empty.
    Two documents are linked if the weighted Jaccard likeness is SIMILAR or more, and a class is what links lead to.
    A document without an id has its class; where no document of its words has an id, the class has a number from 2**62.
    Rows that share an id share a class. Other columns of ``docs`` are not looked at.

    Documents of the same words are one from the start, so that a group of copies of any size costs a grouped
    minimum. A document is first checked against one only, of the heads of its buckets the one that meets most others in all
    of its own; a head is the document of a bucket that does so, by which the text that near copies were made of comes first,
    whatever its id. Where several classes are left in a bucket, all are then checked against its head, then against one
    picked by chance, then all of different classes that can still be alike with each other.
    So a group of near copies takes a few checks for each of its documents, not one for each pair.
    """
    sketch = stage(sketches(docs))
    node = F.coalesce(F.min("doc_id"), F.shiftleft(F.lit(1).cast("long"), 62).bitwiseOR(F.shiftrightunsigned(F.first("k1"), 2)))
    texts = stage(sketch.groupBy("k1", "k2").agg(node.alias("node"), F.count("*").alias("copies"), F.min("doc_id").alias("doc_id")))
    # one row for each text: that of its smallest id; texts without any id have theirs by their keys alone
    same = ["k1", "k2"]
    one = texts.filter("doc_id is not null").select("k1", "k2", "doc_id", "node")
    bucketed = sketch.filter("n > 0").join(one, ["k1", "k2", "doc_id"])
    nameless = sketch.filter("n > 0 and doc_id is null").join(texts.filter("doc_id is null").select(*same, "node"), same)
    rows = bucketed.select("node", "n", "bands").unionByName(nameless.select("node", "n", "bands"))
    rows = rows.select(F.explode("bands").alias("bucket"), "node", "n")
    sizes = rows.groupBy("bucket").agg(F.count("*").alias("size"), F.min("node").alias("low"), F.max("node").alias("high")).filter("low != high")
    rows = stage(rows.join(sizes.select("bucket", "size"), "bucket"))
    shared = stage(rows.join(rows.groupBy("node").agg(F.sum("size").alias("met")), "node").select("bucket", "node", "n", "met"))
    heads = shared.groupBy("bucket").agg(F.min(F.struct((-F.col("met")).alias("h"), "node", "n")).alias("head"))
    nearest = shared.join(heads, "bucket").filter((F.col("node") != F.col("head.node")) & _alike(F.col("n"), F.col("head.n")))
    nearest = nearest.groupBy("node").agg(F.min("head")["node"].alias("head"))
    pairs = nearest.select(F.least("node", "head").alias("a"), F.greatest("node", "head").alias("b")).distinct()
    wanted = stage(shared.select("node").distinct().join(texts.select(*same, "node", "doc_id"), "node"))
    ids = _small(stage(wanted.filter("doc_id is not null").select("doc_id").distinct()))
    texts_of = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    named = features(texts_of.join(ids, "doc_id", "left_semi"))
    unnamed = features(texts_of.filter("doc_id is null"))
    items = stage(named.unionByName(unnamed).join(wanted.select(*same, "node"), same).select("node", "items", "bits"))
    links = stage(checked(pairs, items))
    classes = components(links)
    for pairs_of in (_head_pairs, _chance_pairs, _last_pairs):
        more = stage(checked(pairs_of(_open_members(shared, classes, items), items), items))
        if not more.isEmpty():
            links = links.union(more)
            classes = components(links)
    of_text = texts.join(classes, "node", "left").select(*same, F.coalesce("class", "node").alias("class_id"), "copies")
    return sketch.select("doc_id", *same).join(of_text, same).select("doc_id", "class_id", "copies")


@query("op2_dart_minhash")
def op2_dart_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
