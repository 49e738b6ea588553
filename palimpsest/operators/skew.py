"""Joins whose big side may have keys that hold a large share of its rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

BROADCAST_ROWS = 100_000
BROADCAST_BYTES = 64 << 20
HOT_ROWS = 1_000_000


def row_bytes(df: DataFrame) -> Column:
    """About how many bytes a row takes: texts by their length, lists by their elements, nested values as JSON."""
    def one(f: T.StructField) -> Column:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.StringType, T.BinaryType)):
            return F.octet_length(c)
        if isinstance(f.dataType, T.ArrayType) and not isinstance(f.dataType.elementType, (T.ArrayType, T.StructType, T.MapType, T.StringType)):
            return 8 * F.size(c)
        if isinstance(f.dataType, (T.ArrayType, T.StructType, T.MapType)):
            return F.octet_length(F.to_json(c))
        return F.lit(8)
    return sum((F.coalesce(one(f), F.lit(0)) for f in df.schema.fields), F.lit(16)).cast("long")


def is_small(df: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES) -> bool:
    """Whether all rows, counted and measured, are within both bounds."""
    n, size = df.limit(max_rows + 1).agg(F.count("*"), F.sum(row_bytes(df))).first()
    return n <= max_rows and (size or 0) <= max_bytes


def broadcast_if_small(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast only after counting and measuring; a larger side is left to adaptive execution."""
    return F.broadcast(df) if is_small(df, max_rows) else df


def split_hot_join(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner",
                   hot_rows: int = HOT_ROWS) -> DataFrame:
    """``left JOIN right`` for a ``right`` with unique keys and a ``left`` with hot keys.

    Keys with more than ``hot_rows`` rows are few (at most rows / hot_rows), so their right rows
    meet the left rows where these lie; the other keys shuffle as usual.
    """
    hot = left.groupBy(*on).agg(F.count("*").alias("n")).filter(F.col("n") > hot_rows).select(*on)
    if hot.isEmpty():
        return left.join(right, on, how)
    hot_right = broadcast_if_small(right.join(hot, on, "left_semi"))
    flag = broadcast_if_small(hot)
    return (left.join(flag, on, "left_semi").join(hot_right, on, how)
            .unionByName(left.join(flag, on, "left_anti").join(right, on, how)))
