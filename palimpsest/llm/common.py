"""Reading tables, bounded Arrow batches, and the words of a batch as numpy arrays."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: UTF-8 bytes of text that one numpy step looks at; a longer text is a step of its own.
STEP_BYTES = 4 << 20
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bound_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Arrow batches for Python tasks hold at most so many rows and about STEP_BYTES."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(STEP_BYTES))


def steps(batches: Iterator[pa.RecordBatch], column: str, limit: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of all batches in order, cut so that ``column`` has about ``limit`` bytes in each cut."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, offsets = utf8(batch.column(batch.schema.get_field_index(column)))
        first = 0
        while first < batch.num_rows:
            last = int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1
            last = min(max(last, first + 1), batch.num_rows)
            yield batch.slice(first, last - first)
            first = last


def utf8(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts in a row and their n + 1 offsets; a null is an empty text."""
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    texts = texts.cast(pa.large_binary())
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64)[texts.offset:texts.offset + len(texts) + 1]
    data = np.frombuffer(data, np.uint8)[offsets[0]:offsets[-1]] if data is not None else np.empty(0, np.uint8)
    return data, offsets - offsets[0]


def spans(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the longest runs of ``inside`` that cross no text's border."""
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    at = offsets[:-1][offsets[:-1] < len(inside)]
    first[at] = inside[at]
    at = offsets[1:][offsets[1:] > 0] - 1
    last[at] = inside[at]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits that spreads every bit over all."""
    h = h.astype(np.uint64, copy=True)
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def span_hashes(units: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of ``units[start:end]``, the same wherever a span stands.

    A polynomial hash by differences of prefix sums modulo 2**64, then mixed with the length.
    """
    powers = np.full(len(units) + 1, _MULTIPLIER)
    powers[0] = 1
    np.multiply.accumulate(powers, out=powers)
    sums = np.zeros(len(units) + 1, np.uint64)
    np.cumsum((units.astype(np.uint64) + np.uint64(1)) * powers[:-1], out=sums[1:])
    powers[1:] = _INVERSE
    np.multiply.accumulate(powers, out=powers)
    return mix((sums[ends] - sums[starts]) * powers[starts] + (ends - starts).astype(np.uint64))


def byte_class(separators: str) -> np.ndarray:
    """True for bytes that are inside words, given the ASCII characters that are not."""
    inside = np.ones(256, bool)
    inside[list(separators.encode())] = False
    return inside


#: A-Z to a-z, all other bytes as they are.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Fixed values of the word patterns: [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ and [^\x20\x09-\x0D]+
ALNUM = byte_class("".join(map(chr, [*range(0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)])))
NONSPACE = byte_class(" \t\n\v\f\r")


def words(texts: pa.Array, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word of the texts with A-Z lowered, and n + 1 offsets of the texts in the words."""
    data, offsets = utf8(texts)
    data = LOWER[data]
    starts, ends = spans(inside[data], offsets)
    return span_hashes(data, starts, ends), np.searchsorted(starts, offsets)


def parities(items: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """For each set a power of two of bits, twice its size or more; each element turns the bit of its low digits.

    Two sets differ in at least as many elements as their bits do.
    """
    out, at = [], [0]
    for a, b in zip(offsets[:-1], offsets[1:]):
        n = 1 << max(6, int(2 * (b - a) - 1).bit_length())
        odd = np.bincount((items[a:b] & np.uint64(n - 1)).astype(np.int64), minlength=n) & 1
        out.append(np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64))
        at.append(at[-1] + n // 64)
    return pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(np.concatenate(out) if out else np.empty(0, np.int64)))


def bits_apart(a: Column, b: Column) -> Column:
    """Bits in which two lists of ``parities`` differ; the longer one is folded until both have the length of the shorter."""
    def folded(bits: Column, to: Column) -> Column:
        half = F.size(bits) / 2
        return F.when(F.size(bits) > F.size(to), F.zip_with(F.slice(bits, F.lit(1), half.cast("int")), F.slice(bits, (half + 1).cast("int"), half.cast("int")),
                                                            lambda x, y: x.bitwiseXOR(y))).otherwise(bits)

    odd = F.zip_with(folded(a, b), folded(b, a), lambda x, y: F.bit_count(x.bitwiseXOR(y)))
    return F.aggregate(odd, F.lit(0), lambda s, x: s + x)
