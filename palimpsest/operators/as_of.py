"""Facts at many pairs of times at once.

Few points go to the facts.  Many meet them by an equi join: intervals are cut into dyadic pieces, and a point of valid
time lies in just one piece of an interval, which has at most two pieces of each length, as a point has one cell of each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from palimpsest.operators.skew import broadcast_if_small, is_small
from palimpsest.session import stage

#: Points up to this number are held against every fact where it lies, which moves no fact.
FEW_POINTS = 1000
#: Micro-seconds of the smallest piece; ends inside one are compared exactly after the join.
GRAIN = 86_400_000_000


def _cell(t: Column, grain: int) -> Column:
    return F.floor(F.unix_micros(t) / grain)


def _pieces(lo: Column, hi: Column, levels: int) -> Column:
    """(level, node) of the dyadic pieces of the cells lo, ..., hi - 1, numbered from 0."""
    none = F.array().cast("array<struct<level:int,node:bigint>>")
    start = F.struct(lo.cast("bigint").alias("lo"), hi.cast("bigint").alias("hi"), none.alias("out"))

    def up(s: Column, level: Column) -> Column:
        def piece(node: Column) -> Column:
            return F.array(F.struct(level.cast("int").alias("level"), node.cast("bigint").alias("node")))

        open_ = s["lo"] < s["hi"]
        left, right = open_ & (s["lo"] % 2 == 1), open_ & (s["hi"] % 2 == 1)
        # an interval of one odd-ended cell gives it once
        right = right & ~(left & (s["lo"] + 1 >= s["hi"]))
        out = F.concat(s["out"], F.when(left, piece(s["lo"])).otherwise(none), F.when(right, piece(s["hi"] - 1)).otherwise(none))
        lo_, hi_ = s["lo"] + F.when(left, 1).otherwise(0), s["hi"] - F.when(right, 1).otherwise(0)
        return F.struct(F.shiftright(lo_ + F.lit(0).cast("bigint"), 1).alias("lo"), F.shiftright(hi_ + F.lit(0).cast("bigint"), 1).alias("hi"), out.alias("out"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(levels)), start, up, lambda s: s["out"])


def facts_as_of_many(edges: DataFrame, points: DataFrame, *, grain: int = GRAIN, few_points: int = FEW_POINTS) -> DataFrame:
    """``point_id`` and the facts that held at ``valid_time`` as they were known at ``system_time``, for every point.

    Points: ``point_id, valid_time, system_time``.  A fact holds from ``valid_at`` to before ``invalid_at`` and is known from
    ``created_at`` to before ``expired_at``; a missing end is open, a missing start is never.
    """
    held = (F.col("valid_at") <= F.col("valid_time")) & (F.col("invalid_at").isNull() | (F.col("invalid_at") > F.col("valid_time")))
    known = (F.col("created_at") <= F.col("system_time")) & (F.col("expired_at").isNull() | (F.col("expired_at") > F.col("system_time")))
    points = stage(points.select("point_id", "valid_time", "system_time"))
    if is_small(points, few_points):
        return edges.join(F.broadcast(points), held & known).select("point_id", *edges.columns)
    first, last = points.select(_cell(F.col("valid_time"), grain).alias("c")).agg(F.min("c"), F.max("c")).first()
    if first is None:
        return points.select("point_id").limit(0).join(edges.limit(0), F.lit(True))
    levels = max(1, int(last - first + 1).bit_length())
    start = F.greatest(_cell(F.col("valid_at"), grain), F.lit(first)) - first
    end = F.least(F.coalesce(_cell(F.col("invalid_at"), grain) + 1, F.lit(last + 1)), F.lit(last + 1)) - first
    cut = edges.filter("valid_at IS NOT NULL").withColumn("_p", F.explode(_pieces(start, end, levels)))
    cut = cut.withColumns({"_level": F.col("_p.level"), "_node": F.col("_p.node")}).drop("_p")
    level = F.explode(F.sequence(F.lit(0), F.lit(levels))).alias("_level")
    cells = points.select("point_id", "valid_time", "system_time", (_cell(F.col("valid_time"), grain) - first).alias("_c"), level)
    cells = cells.select("point_id", "valid_time", "system_time", "_level", F.expr("shiftright(_c, _level)").alias("_node"))
    both = cut.join(broadcast_if_small(cells), ["_level", "_node"])
    return both.filter(held & known).select("point_id", *edges.columns)
