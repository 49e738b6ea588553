"""Exact self-join of shingle sets by Jaccard likeness: a partitioned universe, pigeonhole, one-deletion neighbours, exact checks.

Sets that differ in at most H elements agree in one of any H + 1 segments into which a hash cuts the universe. A scheme is
such a cut for one band of sizes; a set takes part in its own band's scheme and, where smaller partners may be, in
the band's below. Of a scheme's segments a set of s elements indexes the first H(s) + 1 + Z(H(s)): Z more than needed,
so that up to Z segments may go unused (allocation 0): those that are empty, which nobody indexes, and then those whose
buckets cost most pairs, in which a set is found by others but does not look for partners. Sets with more empty and
costly segments than Z are indexed again among themselves: with all elements of a segment but one (allocation 2)
beside the segment itself (allocation 1), and if that is still too little, with all segments. So no
pair is lost, whatever is costly.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palimpsest.llm.common import NONSPACE, bits_apart, bound_batches, mix, parities, steps, table, words
from palimpsest.llm.dart_minhash import components, shingles
from palimpsest.llm.registry import query
from palimpsest.operators.skew import broadcast_if_small, split_hot_join
from palimpsest.session import stage

#: Sets are linked when PERCENT * size of the union <= 100 * size of the intersection.
SHINGLE, PERCENT = 5, 80
#: Pairs of different classes above which a bucket is costly; any number gives the same links. They are compared by parity bits where they
#: meet and only few become rows, so that many cost less than a second index.
COSTLY = 1_000_000
#: Sets in a bucket from which it is crowded: one drawn by chance is then checked before pairs are compared. Any number gives the same links.
CROWDED = 16
#: Tables of ids up to so many rows may be sent to all tasks, after they are counted and measured.
BROADCAST_ROWS = 2_000_000
#: Copies of one text from which its rows are joined where they lie.
HOT_ROWS = 10_000
_SEGMENT, _BAND, _ITEM, _NEAR, _ALL = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0x8EBC6AF09C88C6E3, 0xE7037ED1A0B428DB))


def _low_sizes() -> np.ndarray:
    """The smallest size of every band, each half as large again as the one before; sets below 4 elements are like equal ones only."""
    lows = [4]
    while lows[-1] < 1 << 40:
        lows.append(lows[-1] * 3 // 2 + 1)
    return np.array(lows)


LOWS = _low_sizes()
HIGHS = LOWS[1:] - 1


def most_apart(size: np.ndarray) -> np.ndarray:
    """H: elements in which a set can differ from a linked one that is not smaller."""
    return (size + size * 100 // PERCENT) * (100 - PERCENT) // (100 + PERCENT)


def unused(apart: np.ndarray) -> np.ndarray:
    """Z: segments that may go unused."""
    return (apart + 8) // 8 + 1


def indexed(size: np.ndarray) -> np.ndarray:
    """Segments that a set of this size indexes."""
    apart = most_apart(size)
    return apart + 1 + unused(apart)


def shingle_sets(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of each text as sorted 64-bit hashes, and the texts' offsets."""
    runs, offsets = shingles(*words(texts, NONSPACE), SHINGLE)
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    runs = mix(runs ^ _ITEM)
    order = np.lexsort((runs, text))
    runs, text = runs[order], text[order]
    fresh = np.ones(len(runs), bool)
    fresh[1:] = (runs[1:] != runs[:-1]) | (text[1:] != text[:-1])
    return runs[fresh], np.searchsorted(text[fresh], np.arange(len(offsets)))


def _sums(items: np.ndarray) -> np.ndarray:
    """Prefix sums of the items' hashes: a stretch is a set, and its sum stands for it in any order."""
    return np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(items + _ITEM), dtype=np.uint64)])


def _bucket(total: np.ndarray, segment: np.ndarray, band: np.ndarray, tag: int = 0) -> np.ndarray:
    return mix(total + mix(segment.astype(np.uint64) * _SEGMENT + band.astype(np.uint64) * _BAND + np.uint64(tag)))


def scheme(size: np.ndarray, lower: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For sets of these sizes in their own or the lower scheme: band (-1: none), segments, indexed segments, and the smallest partner's size."""
    band = np.searchsorted(LOWS, size, side="right") - 1 - lower
    at = np.maximum(band, 0)
    band = np.where((band >= 0) & (100 * HIGHS[at] >= PERCENT * size), band, -1)
    least = np.maximum(-(-PERCENT * size // 100), LOWS[at])
    return band, indexed(HIGHS[at]), indexed(np.minimum(size, HIGHS[at])), least


def segments(items: np.ndarray, offsets: np.ndarray, lower: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of the filled segments that the sets index, their offsets by set, and how many more may go unused (negative: too few are left)."""
    size = np.diff(offsets)
    band, parts, used, least = scheme(size, lower)
    text = np.repeat(np.arange(len(size)), size)
    segment = ((items >> np.uint64(32)) * parts[text].astype(np.uint64) >> np.uint64(32)).astype(np.int64)
    kept = (segment < used[text]) & (band[text] >= 0)
    first = kept.copy()
    first[1:] &= (segment[1:] != segment[:-1]) | (text[1:] != text[:-1])
    starts = np.flatnonzero(first)
    last = kept.copy()
    last[:-1] &= (segment[1:] != segment[:-1]) | (text[1:] != text[:-1])
    ends = np.flatnonzero(last) + 1
    sums, owner = _sums(items), text[starts]
    buckets = _bucket(sums[ends] - sums[starts], segment[starts], band[owner])
    at = np.searchsorted(owner, np.arange(len(offsets)))
    spare = np.where(band >= 0, unused(most_apart(least)) - (used - np.diff(at)), 1 << 40)
    return buckets, at, spare


def _node(items: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    sums = _sums(items)
    return mix(sums[offsets[1:]] - sums[offsets[:-1]] + np.diff(offsets).astype(np.uint64)).view(np.int64)


def _lists(values: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values.view(np.int64)))


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, node (stands for the set), n, buckets of the own and the lower scheme, and thin, whether too few segments are filled."""
    bound_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, "text", 1 << 20):
            items, offsets = shingle_sets(batch.column(1))
            own, own_at, own_spare = segments(items, offsets, False)
            low, low_at, low_spare = segments(items, offsets, True)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.int64()), pa.array(_node(items, offsets)), pa.array(np.diff(offsets)), _lists(own, own_at), _lists(low, low_at),
                 pa.array((own_spare < 0) | (low_spare < 0))], ["doc_id", "node", "n", "own", "low", "thin"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, node long, n long, own array<long>, low array<long>, thin boolean")


def features(docs: DataFrame) -> DataFrame:
    """node, n, the set's items and parity bits, and the segments that may still go unused in either scheme."""
    bound_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, "text", 1 << 20):
            items, offsets = shingle_sets(batch.column(0))
            spare = [segments(items, offsets, lower)[2] for lower in (False, True)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(_node(items, offsets)), pa.array(np.diff(offsets)), _lists(items, offsets), parities(items, offsets), pa.array(spare[0]), pa.array(spare[1])],
                ["node", "n", "items", "bits", "spare_own", "spare_low"])

    return docs.select("text").mapInArrow(run, "node long, n long, items array<long>, bits array<long>, spare_own long, spare_low long")


def second_buckets(items: np.ndarray, lower: bool, costly: np.ndarray) -> np.ndarray:
    """Buckets of a set that has more than Z empty or costly segments: one-deletion neighbours, and all segments if these do not suffice."""
    size = np.array([len(items)])
    band, parts, used, least = scheme(size, lower)
    segment = ((items >> np.uint64(32)) * np.uint64(parts[0]) >> np.uint64(32)).astype(np.int64)
    items, segment = items[segment < used[0]], segment[segment < used[0]]
    filled, starts, count = np.unique(segment, return_index=True, return_counts=True)
    sums = _sums(items)
    total = sums[starts + count] - sums[starts]
    allowed = np.where(np.isin(_bucket(total, filled, band), costly), 0, np.where(count > 1, 2, 1))
    several = np.repeat(count > 1, count)
    without = np.repeat(total, count)[several] - mix(items[several] + _ITEM)
    out = [_bucket(total, filled, band, int(_NEAR)), _bucket(without, segment[several], band, int(_NEAR))]
    if allowed[filled < indexed(least)[0]].sum() <= most_apart(np.minimum(size, HIGHS[band]))[0]:
        every = np.zeros(used[0], np.uint64)
        every[filled] = total
        out.append(_bucket(every, np.arange(used[0]), band, int(_ALL)))
    return np.unique(np.concatenate(out))


def second_entries(needy: DataFrame) -> DataFrame:
    """Rows (bucket, node, n) of the second index for rows (node, items, lower, costly)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                node, items, lower, costly = (batch.column(i).slice(row, 1) for i in range(4))
                items, costly = (np.asarray(x.flatten(), np.int64).view(np.uint64) for x in (items, costly))
                buckets = second_buckets(items, bool(lower[0].as_py()), costly).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(buckets), pa.repeat(node[0], len(buckets)), pa.array(np.full(len(buckets), len(items)))], ["bucket", "node", "n"])

    return needy.select("node", "items", "lower", "costly").mapInArrow(run, "bucket long, node long, n long")


def _alike(a: Column | str, b: Column | str) -> Column:
    """Whether sizes allow a link at all."""
    return 100 * F.least(a, b) >= PERCENT * F.greatest(a, b)


def _near(n_a: str, n_b: str, bits_a: str, bits_b: str) -> Column:
    """False where the parity bits rule a link out: linked sets differ in at most (n_a + n_b) (100 - PERCENT) / (100 + PERCENT) elements."""
    return (100 + PERCENT) * bits_apart(F.col(bits_a), F.col(bits_b)) <= (100 - PERCENT) * (F.col(n_a) + F.col(n_b))


def checked(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Of the pairs (a, b), those that are linked: first by the parity bits, which rule out most of the others, then by the items."""
    def side(name: str, *columns: str) -> DataFrame:
        return sets.select(F.col("node").alias(name), *[F.col(c).alias(f"{c}_{name}") for c in columns])

    both = pairs.join(side("a", "n", "bits"), "a").join(side("b", "n", "bits"), "b").filter(_alike("n_a", "n_b"))
    left = both.filter(_near("n_a", "n_b", "bits_a", "bits_b")).select("a", "b")
    return compared(left, sets)


def compared(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Of the pairs (a, b), those whose items make a link."""
    a, b = (sets.select(F.col("node").alias(x), F.col("items").alias(f"items_{x}")) for x in "ab")
    left = pairs.join(a, "a").join(b, "b")
    common = F.size(F.array_intersect("items_a", "items_b"))
    return left.filter(100 * common >= PERCENT * (F.size("items_a") + F.size("items_b") - common)).select("a", "b")


def _ordered(a: str, b: str) -> list[Column]:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def _heads(rows: DataFrame) -> DataFrame:
    """The smallest node of every bucket that holds several."""
    ends = rows.groupBy("bucket").agg(F.min("node").alias("head"), F.max("node").alias("last"))
    return broadcast_if_small(stage(ends.filter("head != last").select("bucket", "head")), BROADCAST_ROWS)


def _open(shared: DataFrame, classes: DataFrame) -> DataFrame:
    """Rows (bucket, node, n, class) of the buckets in which nodes of several classes are left."""
    member = shared.join(classes, "node", "left").select("bucket", "node", "n", F.coalesce("class", "node").alias("class"), "lower")
    ends = member.groupBy("bucket").agg(F.min("class").alias("low"), F.max("class").alias("high"))
    return stage(member.join(ends.filter("low != high").select("bucket"), "bucket"))


def _with_one(member: DataFrame, order: Column, least: int = 0) -> DataFrame:
    """In each bucket of at least so many sets, nodes of other classes with the node that is first in ``order``."""
    pick = F.min(F.struct(order.alias("h"), "node", "n", "class")).alias("pick")
    both = member.join(member.groupBy("bucket").agg(pick, F.count("*").alias("size")).filter(F.col("size") >= least), "bucket")
    return both.filter((F.col("class") != F.col("pick.class")) & _alike("n", "pick.n")).select(*_ordered("node", "pick.node")).distinct()


def _costs(member: DataFrame) -> DataFrame:
    """Pairs of different classes in each bucket."""
    of_class = member.groupBy("bucket", "class").agg(F.count("*").cast("double").alias("c"))
    return of_class.groupBy("bucket").agg(((F.pow(F.sum("c"), 2) - F.sum(F.col("c") * F.col("c"))) / 2).alias("pairs"))


def _pairs_of(used: DataFrame, member: DataFrame, twice: Column) -> DataFrame:
    """Pairs of different classes that meet in a bucket which the first of them uses, and that can be linked by their sizes and parity bits.

    The bits are compared inside the join, so that pairs they rule out make no rows: near copies of one text that are not linked with each
    other meet in many buckets, however many they are. Two sets of which both look for partners meet once, the smaller node
    looks; ``twice`` says which partners (columns of ``b``) do not look.
    """
    a = used.select("bucket", *[F.col(c).alias(f"{c}_a") for c in ("node", "n", "class", "bits")])
    b = member.select("bucket", *[F.col(c).alias(f"{c}_b") for c in ("node", "n", "class", "bits", "needy")])
    once = twice | (F.col("node_a") < F.col("node_b"))
    met = (F.col("class_a") != F.col("class_b")) & once & _alike("n_a", "n_b") & _near("n_a", "n_b", "bits_a", "bits_b")
    a, b = a.alias("looking"), b.alias("others")
    return a.join(b, (F.col("looking.bucket") == F.col("others.bucket")) & met).select(*_ordered("node_a", "node_b")).distinct()


class _Links:
    """Links found so far and the classes they make (node and class, the smallest node, which has no row of its own): written tables."""

    def __init__(self, sets: DataFrame) -> None:
        self.sets, self.links, self.classes = sets, None, sets.select("node", F.col("node").alias("class")).limit(0)

    def add(self, pairs: DataFrame, by: Callable[[DataFrame, DataFrame], DataFrame] = checked) -> None:
        found = stage(by(pairs, self.sets))
        if not found.isEmpty():
            self.links = found if self.links is None else self.links.union(found)
            self.classes = stage(components(self.links))


def _merge_heads(shared: DataFrame, links: _Links) -> DataFrame:
    """Adds links with a bucket's smallest node and with one by chance; gives the rows of the buckets in which several classes are left.

    Each node is first checked with one node only, the smallest of all its buckets; then, where its class is still another one, with
    the smallest of each bucket, then with one that chance picks. So a group of near copies costs a few checks for each of
    its nodes, not one for each pair.
    """
    links.add(shared.groupBy("node").agg(F.min("head").alias("head")).filter("node != head").select(*_ordered("node", "head")).distinct())
    links.add(_with_one(_open(shared, links.classes), F.col("node")))
    links.add(_with_one(_open(shared, links.classes), F.xxhash64("node", "bucket"), CROWDED))
    return _open(shared, links.classes)


def _compare(shared: DataFrame, links: _Links, costly: int) -> DataFrame:
    """Adds the links of all sets that can do without their costly buckets; gives the others' rows (node, lower, costly buckets).

    A set leaves its costliest buckets unused, as many as it may.
    """
    member = _merge_heads(shared, links)
    spare = F.when(F.col("lower"), F.col("spare_low")).otherwise(F.col("spare_own"))
    costs = stage(_costs(member))
    member = member.join(costs, "bucket").join(links.sets.select("node", "spare_own", "spare_low"), "node").withColumn("spare", spare)
    by_cost = Window.partitionBy("node", "lower").orderBy(F.desc("pairs"), "bucket")  # at most the segments of the set
    whole = Window.partitionBy("node", "lower")
    member = member.withColumn("nth", F.row_number().over(by_cost)).withColumn("needy", F.count_if(F.col("pairs") > costly).over(whole) > F.col("spare"))
    member = stage(member.select("bucket", "node", "n", "class", "lower", "pairs", "needy", (F.col("nth") > F.col("spare")).alias("used")))
    with_bits = member.join(links.sets.select("node", "bits"), "node")
    links.add(_pairs_of(with_bits.filter("used AND NOT needy"), with_bits, F.col("needy_b")), compared)
    return member.filter(F.col("needy") & (F.col("pairs") > costly)).groupBy("node", "lower").agg(F.collect_set("bucket").alias("costly"))


def _of_either(rows: DataFrame, *columns: str) -> DataFrame:
    """One row for each bucket of both schemes."""
    return rows.select(F.explode("own").alias("bucket"), *columns, F.lit(False).alias("lower")).unionByName(
        rows.select(F.explode("low").alias("bucket"), *columns, F.lit(True).alias("lower")))


def linked_documents(docs: DataFrame, costly: int = COSTLY) -> DataFrame:
    """Per document: doc_id, n_shingles (size of its set), component_id (smallest doc_id that links lead to, itself included).

    Words are runs of anything but white space, A-Z lowered; a set has the distinct runs of five words, a shorter text one
    run; null and empty texts, and those without words, have none and are linked with nothing. Documents of equal sets are one from the
    start, so copies cost nothing more. Rows without an id take part; their component is the smallest id it has, null if none. Rows that share
    an id are documents of their own. Other columns of ``docs`` are not looked at.
    """
    # what a finished job has shuffled is not needed again: every table that is read twice is written
    docs.sparkSession.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")
    sketch = stage(sketches(docs))
    sets = stage(sketch.filter("n > 0").groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"), F.max("thin").alias("thin")))
    several = broadcast_if_small(sets.filter("copies > 1").select(F.col("node").alias("twin"), F.col("doc_id").alias("first")), BROADCAST_ROWS)
    once = sketch.filter("n > 3").join(several, F.col("node") == F.col("twin"), "left").filter(F.col("twin").isNull() | F.col("doc_id").eqNullSafe(F.col("first")))
    entries = _of_either(once, "node", "n")
    shared = stage(entries.join(_heads(entries), "bucket").distinct())
    thin = sets.filter("thin").select("node")
    wanted = stage(shared.select("node").union(thin).distinct().join(sets.select("node", "doc_id"), "node"))
    ids = broadcast_if_small(stage(wanted.filter("doc_id is not null").select("doc_id").distinct()), BROADCAST_ROWS)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    texts_of = texts.join(ids, "doc_id", "left_semi")
    if not wanted.filter("doc_id is null").isEmpty():
        texts_of = texts_of.unionByName(texts.filter("doc_id is null"))
    found = stage(features(texts_of).join(broadcast_if_small(wanted.select("node"), BROADCAST_ROWS), "node", "left_semi"))
    if found.count() != wanted.count():  # rows that share id and text
        found = stage(found.dropDuplicates(["node"]))
    links = _Links(found)
    _compare_needy(_compare(shared, links, costly), links)
    return _answers(sketch, sets, links)


def _compare_needy(of_set: DataFrame, links: _Links) -> None:
    """Adds the links of sets that have more than Z empty or costly segments in a scheme, by a second index among these alone."""
    thin = F.array(F.struct(F.lit(False).alias("lower"), F.col("spare_own").alias("spare")), F.struct(F.lit(True).alias("lower"), F.col("spare_low").alias("spare")))
    thin = links.sets.select("node", F.explode(thin).alias("s")).filter("s.spare < 0").select("node", "s.lower")
    every = of_set.select("node", "lower").union(thin).distinct().join(of_set, ["node", "lower"], "left")
    every = every.select("node", "lower", F.coalesce("costly", F.array().cast("array<long>")).alias("costly"))
    needy = stage(every.join(links.sets.select("node", "items"), "node"))
    if needy.isEmpty():
        return
    entries = stage(second_entries(needy)).withColumn("lower", F.lit(False))
    member = _merge_heads(stage(entries.join(_heads(entries), "bucket")), links).withColumn("needy", F.lit(False))
    member = member.join(links.sets.select("node", "bits"), "node")
    links.add(_pairs_of(member, member, F.lit(False)), compared)


def _answers(sketch: DataFrame, sets: DataFrame, links: _Links) -> DataFrame:
    heads = links.classes.select(F.col("class").alias("node"), "class").distinct()
    linked = stage(links.classes.unionByName(heads).join(sets.select("node", "doc_id"), "node"))
    least = linked.groupBy("class").agg(F.min("doc_id").alias("component_id"))
    component = split_hot_join(linked.select("node", "class"), least, ["class"], hot_rows=HOT_ROWS).select("node", "component_id")
    of_set = sets.select("node", "doc_id").join(component, "node", "left").select("node", F.coalesce("component_id", "doc_id").alias("component_id"))
    answers = split_hot_join(sketch.filter("n > 0").select("doc_id", "n", "node"), stage(of_set), ["node"], hot_rows=HOT_ROWS)
    alone = sketch.filter("n = 0").select("doc_id", "n", F.col("doc_id").alias("component_id"))
    return answers.select("doc_id", "n", "component_id").unionByName(alone).withColumnRenamed("n", "n_shingles")


@query("op11_jaccard_join")
def op11_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linked_documents(table(spark, sf_dir, "documents"))
