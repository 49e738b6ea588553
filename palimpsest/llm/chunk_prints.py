"""Document fingerprints: content-defined chunks by a normalised gear hash, and containment of chunk sets."""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palimpsest.llm.common import bound_batches, mix, span_hashes, steps, table
from palimpsest.llm.registry import query

#: Bytes of a chunk: none is shorter (but a text's last), cuts are rare up to the usual size and frequent beyond, none is longer.
LEAST, USUAL, MOST = 16, 32, 128
#: Top bits of the 16-bit gear hash that are 0 at a cut, up to the usual size and beyond it.
RARE, FREQUENT = np.uint16(0xFC00), np.uint16(0xF000)
#: Bits of a chunk's digest.
DIGEST_BITS = 40
#: UTF-8 bytes of text for one partition of the sort by id.
PARTITION_BYTES = 64 << 20
#: A random 16-bit number for every byte, made from a rule.
GEAR = (mix(np.arange(1, 257, dtype=np.uint64)) >> np.uint64(48)).astype(np.uint16)


def gear_hashes(data: np.ndarray) -> np.ndarray:
    """Gear hash at every byte: over the last 16 bytes, the older the higher; by doubling the stretch summed."""
    h = GEAR[data]
    for shift in (1, 2, 4, 8):
        h[shift:] += h[:-shift] << np.uint16(shift)
    return h


def chunk_ends(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the chunks of all texts.

    A chunk is no shorter than the hash's stretch, so a cut depends on the chunk's own bytes alone.
    """
    h = gear_hashes(data)
    rare, frequent = (np.append(np.flatnonzero((h & m) == 0) + 1, len(data) + MOST + 1).tolist() for m in (RARE, FREQUENT))
    starts, ends = [], []
    for at, end in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
        i, j = bisect_left(rare, at), bisect_left(frequent, at)
        while at < end:
            starts.append(at)
            while rare[i] < at + LEAST:
                i += 1
            if rare[i] < at + USUAL:
                at = min(rare[i], end)
            else:
                while frequent[j] < at + USUAL:
                    j += 1
                at = min(frequent[j], at + MOST, end)
            ends.append(at)
    return np.array(starts, np.int64), np.array(ends, np.int64)


def fingerprints(texts: list[bytes]) -> list[dict[int, int]]:
    """For each text its chunks' digests and lengths, equal chunks once."""
    data = np.frombuffer(b"".join(texts), np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    starts, ends = chunk_ends(data, offsets)
    if not len(starts):
        return [{} for _ in texts]
    digests = (span_hashes(data, starts, ends) >> np.uint64(64 - DIGEST_BITS)).tolist()
    lengths, at = (ends - starts).tolist(), np.searchsorted(starts, offsets).tolist()
    return [dict(zip(digests[a:b], lengths[a:b])) for a, b in zip(at, at[1:])]


def containment(a: dict[int, int], b: dict[int, int]) -> float:
    """Share of the bytes in the chunks of ``a`` that are in chunks of ``b`` too; 1 if both have none."""
    if not a:
        return float(not b)
    return sum(map(a.__getitem__, a.keys() & b.keys())) / sum(a.values())


def spelled(print_: dict[int, int]) -> str:
    """A fingerprint as text: 10 hex digits of digest and 2 of length for each chunk, sorted."""
    return b"".join(sorted((d << 8 | n).to_bytes(6) for d, n in print_.items())).hex()


def edited(text: str, following: str) -> str:
    """The last third of the text replaced by as many of the first characters of another."""
    n = len(text) // 3
    return text[:len(text) - n] + following[:n]


SCHEMA = "n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[str], list[str]]]:
    """Blocks of (ids, texts, following texts). Rows come by part; a part ends in rows that only follow."""
    part, waiting = None, None
    for batch in steps(batches, "text", 1 << 20):
        ids, texts, after = [], [], []
        for p, follows, id_, text in zip(*(c.to_pylist() for c in batch.columns)):
            if waiting is not None and p == part:
                ids.append(waiting[0])
                texts.append(waiting[1])
                after.append(text)
            part, waiting = p, None if follows else (id_, text)
        if ids:
            yield ids, texts, after


def fingerprint_rows(docs: DataFrame, parts: int | None = None) -> DataFrame:
    """Fingerprints of every document and of its edited text, and how near they are.

    Documents (doc_id, text; others are not looked at) stand in a ring by descending id, null ids last, ties by a
    digest of the text; a null text is empty; a single document is its own next. Ids alone are read first, for the
    borders of parts of about equal size. Then every text moves once, to its part, and the first text of each part
    moves to the part before it as well. A task streams over its part in order. Without rows there are none.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    if parts is None:
        size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // PARTITION_BYTES))
    turn = -F.col("doc_id")
    probes = [q / parts for q in range(1, parts)]
    borders = rows.agg(F.percentile_approx(turn, probes, max(10_000, 10 * parts)).alias("b")).first()["b"] if probes else None
    borders = np.array(sorted(set(borders or [])), np.int64)  # fewer than there are parts

    @F.arrow_udf("int")
    def part_of(turns: pa.Array) -> pa.Array:
        return pa.array(np.searchsorted(borders, turns.to_numpy(zero_copy_only=False), side="right"), pa.int32())

    keyed = rows.withColumn("turn", turn).withColumn(
        "part", F.when(turn.isNull(), F.lit(len(borders))).otherwise(part_of(F.coalesce(turn, F.lit(0)))))
    ring = Window.orderBy("part")
    firsts = keyed.groupBy("part").agg(F.min("turn").alias("first"))
    firsts = firsts.select("part", "first", F.coalesce(F.lag("part").over(ring), F.max("part").over(Window.partitionBy())).alias("earlier"))
    placed = keyed.join(F.broadcast(firsts), "part")  # one row per part
    is_first = F.col("turn").eqNullSafe(F.col("first"))
    own = F.struct(F.col("part"), F.lit(False).alias("follows"))
    also = F.struct(F.col("earlier").alias("part"), F.lit(True).alias("follows"))
    places = F.when(is_first, F.array(own, also)).otherwise(F.array(own))
    ordered = (
        placed.select(F.explode(places).alias("at"), "turn", "doc_id", "text")
        .select("at.part", "at.follows", "turn", "doc_id", "text")
        .repartition(parts, "part")
        .sortWithinPartitions("part", "follows", F.col("turn").asc_nulls_last(), F.md5(F.col("text").cast("binary")))
        .select("part", "follows", "doc_id", "text")
    )
    names = ["doc_id", *(x.split()[0] for x in SCHEMA.split(", "))]
    id_type = pa.int32() if kind == "int" else pa.int64()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts, after in _neighbours(batches):
            changed = [edited(t, n).encode() for t, n in zip(texts, after)]
            plain = [t.encode() for t in texts]
            prints = fingerprints([*plain, *changed, after[-1].encode()])
            own, other = prints[:len(ids)], prints[len(ids):-1]
            # a row is its predecessor's next, but where a part ends
            nexts = [own[k + 1] if k + 1 < len(ids) and texts[k + 1] == n else prints[-1] if k + 1 == len(ids) else fingerprints([n.encode()])[0]
                     for k, n in enumerate(after)]
            yield pa.RecordBatch.from_arrays([
                pa.array(ids, id_type), pa.array([len(t) for t in texts], pa.int64()), pa.array([hashlib.sha256(t).hexdigest() for t in changed]),
                pa.array(map(spelled, own), pa.string()), pa.array(map(spelled, other), pa.string()),
                pa.array(map(containment, own, other), pa.float64()), pa.array(map(containment, own, nexts), pa.float64())], names)

    return ordered.mapInArrow(run, f"doc_id {kind}, {SCHEMA}")


@query("op10_chunk_prints")
def op10_chunk_prints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_rows(table(spark, sf_dir, "documents"))
