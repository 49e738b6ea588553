"""Few points are held against facts where these lie; the rows are the same as by dyadic pieces."""

import datetime as dt
import random

import pytest

from palimpsest.operators.as_of import facts_as_of_many

T0 = dt.datetime(2024, 1, 1)


@pytest.mark.parametrize("few", [0, 1000])
def test_points_at_the_facts(spark, few):
    rng = random.Random(4)

    def time(share=0.0):
        return None if rng.random() < share else T0 + dt.timedelta(hours=rng.randrange(24 * 60))

    edges = [(f"e{i}", time(0.1), time(0.4), time(), time(0.5)) for i in range(100)]
    points = [(i, time(), time()) for i in range(40)]
    df = spark.createDataFrame(edges, "uuid string, valid_at timestamp, invalid_at timestamp, created_at timestamp, expired_at timestamp")
    asked = spark.createDataFrame(points, "point_id long, valid_time timestamp, system_time timestamp")
    found = facts_as_of_many(df, asked, few_points=few)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert ("NestedLoop" in plan) == (few > 0) and ("Generate" in plan) == (few == 0)
    assert sorted((r.point_id, r.uuid) for r in found.collect()) == sorted(
        (p, u) for p, v, s in points for u, a, b, c, e in edges if a is not None and a <= v and (b is None or b > v) and c <= s and (e is None or e > s))
