"""Facts at many points against a row-by-row rule, with ends inside cells, open ends and empty intervals."""

import datetime as dt
import random

import pytest

from palimpsest.operators.as_of import facts_as_of_many

T0 = dt.datetime(2024, 1, 1)


@pytest.mark.parametrize("grain", [3_600_000_000, 86_400_000_000, 40 * 86_400_000_000])
def test_every_point(spark, grain):
    rng = random.Random(2)

    def time(share=0.0):
        return None if rng.random() < share else T0 + dt.timedelta(hours=rng.randrange(24 * 90), microseconds=rng.randrange(3))

    edges = [(f"e{i}", time(0.05), time(0.4), time(), time(0.5)) for i in range(120)]
    edges += [("same", T0, T0, T0, None), ("reversed", T0 + dt.timedelta(days=9), T0, T0, None), ("always", T0 - dt.timedelta(days=999), None, T0 - dt.timedelta(days=999), None)]
    points = [(i, time(), time()) for i in range(60)] + [(99, T0, T0)]
    df = spark.createDataFrame(edges, "uuid string, valid_at timestamp, invalid_at timestamp, created_at timestamp, expired_at timestamp")
    asked = spark.createDataFrame(points, "point_id long, valid_time timestamp, system_time timestamp")
    got = sorted((r.point_id, r.uuid) for r in facts_as_of_many(df, asked, grain=grain).collect())
    assert got == sorted((p, u) for p, v, s in points for u, a, b, c, e in edges
                         if a is not None and a <= v and (b is None or b > v) and c <= s and (e is None or e > s))
    assert facts_as_of_many(df, asked.limit(0)).collect() == []
    assert facts_as_of_many(df.limit(0), asked).collect() == []
