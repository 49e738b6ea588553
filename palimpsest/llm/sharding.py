"""Contiguous shards of equal bytes, by a global prefix sum built from per-partition totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palimpsest.llm.common import table
from palimpsest.llm.registry import query
from palimpsest.session import stage

SHARDS = 40
ROW_BYTES = 16


def contiguous_shards(rows: DataFrame, size: str, order: list[str], shards: int, partitions: int | None = None) -> DataFrame:
    """Adds ``shard`` (0 to shards - 1) and ``slot`` (0, 1, ... in each shard) to ``rows``.

    Rows are taken in the total order of the columns ``order``. A row goes to the shard in which the middle
    of its ``size`` bytes falls on the line of all bytes, so that shards differ by a row's size at most and
    each is one stretch of the order. Rows are sorted by range (a key with very many rows is spread, since
    ``order`` ends in a unique column), each partition is summed, the totals, one row per partition, are
    summed again, and every row adds the sum of all partitions before its own. Rows that tie in all of
    ``order`` may swap places. No rows give no rows. Sizes must not be null or negative; when all are 0,
    everything is in shard 0.
    """
    spark = rows.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    names = rows.columns
    ranged = rows.select(F.struct(*names).alias("_row"), F.col(size).alias("_size"), *[F.col(c).alias(f"_o{i}") for i, c in enumerate(order)])
    keys = [f"_o{i}" for i in range(len(order))]
    ranged = stage(ranged.repartitionByRange(n, *keys).withColumn("_pid", F.spark_partition_id()))
    before = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    totals = ranged.groupBy("_pid").agg(F.sum("_size").alias("_bytes"), F.count("*").alias("_rows"))
    totals = totals.select(
        "_pid",
        F.coalesce(F.sum("_bytes").over(before), F.lit(0)).alias("_bytes0"),
        F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_rows0"),
        F.sum("_bytes").over(Window.partitionBy()).alias("_total"),
    )
    running = Window.partitionBy("_pid").orderBy(*keys).rowsBetween(Window.unboundedPreceding, 0)
    placed = (
        ranged.withColumn("_ends", F.sum("_size").over(running)).withColumn("_nth", F.row_number().over(running))
        .join(F.broadcast(totals), "_pid")  # one row per partition of the sort
        .withColumn("_twice", 2 * (F.col("_bytes0") + F.col("_ends")) - F.col("_size"))
        .withColumn("shard", _cut(F.col("_twice"), F.col("_total"), shards))
        .withColumn("_index", F.col("_rows0") + F.col("_nth") - 1)
        .select("_row", "shard", "_index")
    )
    placed = stage(placed)
    starts = placed.groupBy("shard").agg(F.min("_index").alias("_first"))
    return (
        placed.join(F.broadcast(starts), "shard")  # one row per shard
        .select("_row.*", "shard", (F.col("_index") - F.col("_first")).alias("slot"))
    )


def _cut(twice: Column, total: Column, shards: int) -> Column:
    """The shard of the point ``twice / 2`` on a line of ``total`` bytes, in whole numbers."""
    exact = F.call_function("div", twice.cast("decimal(30,0)") * F.lit(shards).cast("decimal(6,0)"), F.greatest(2 * total, F.lit(1)).cast("decimal(30,0)"))
    return F.least(exact, F.lit(shards - 1)).cast("int")


#: CRC-32 of a text's bytes, given as the hex string ``hx``; ``tab`` is the usual table, made from its polynomial.
CRC_TABLE_SQL = """select list(v order by i) as tab from (select i, list_reduce(list_prepend(i, range(8)),
  lambda c, k: xor(c >> 1, 3988292384 * (c & 1))) as v from range(256) r(i))"""
CRC_SQL = """xor(list_reduce(list_prepend(4294967295::bigint, list_transform(regexp_extract_all(hx, '..'),
  lambda b: ('0x' || b)::bigint)), lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295)"""


@query("op8_sharding", f"""
with crc as ({CRC_TABLE_SQL}),
r as (select doc_id, octet_length(encode(coalesce(text, ''))) + {ROW_BYTES} as size, md5(coalesce(text, '')) as h,
             hex(encode(coalesce(text, ''))) as hx from documents),
s as (select *, sum(size) over (order by h, doc_id rows unbounded preceding) as ends, sum(size) over () as total,
             row_number() over (order by h, doc_id) as n from r),
p as (select *, least((2 * ends - size) * {SHARDS} // (2 * total), {SHARDS - 1})::int as shard from s)
select doc_id, size::bigint as size, {CRC_SQL} as text_crc32, h as text_md5, 'bytes' as law, shard,
       (n - min(n) over (partition by shard))::bigint as slot, null::int as grown_shard from p, crc""")
def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharded_documents(table(spark, sf_dir, "documents"), SHARDS)


def sharded_documents(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """Documents by the law ``bytes``, equal texts side by side (a group is cut only where a shard ends).

    Size: UTF-8 bytes of the text plus 16; a null text counts as an empty one, with the CRC of no bytes. Only the id, the size and two
    digests of a text are moved. A null id sorts first. Other columns of ``docs`` are not looked at.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        "doc_id",
        (F.octet_length(text) + ROW_BYTES).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.md5(text.cast("binary")).alias("text_md5"),
    )
    return contiguous_shards(rows, "size", ["text_md5", "doc_id"], shards).select(
        "doc_id", "size", "text_crc32", "text_md5", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
