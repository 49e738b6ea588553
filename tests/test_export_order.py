"""Exported facts of one vector lie together in their file, so that it is packed well, and say the same as one conversion of the row."""

import json

from pyspark.sql import functions as F

from palimpsest.sources import tables
from palimpsest.sources.standins import Standins


def test_facts_of_a_vector_lie_together(spark):
    s = Standins(spark, "/root/testdata/sf0.001")
    parts = {"entities": s.entities(), "edges": s.plain_edges().drop("user_id")}
    rows = tables.export_documents(parts, wide={"edges": s.with_vectors})["edges"].select(F.spark_partition_id(), "value").collect()
    seen = [(p, str(json.loads(v).get("fact_embedding"))) for p, v in rows]
    runs = 1 + sum(a != b for a, b in zip(seen, seen[1:]))
    assert runs == len(set(seen)) < len(seen)


def test_spliced_documents(spark):
    df = spark.createDataFrame([("a", 'x"}', '{"v":[1.0]}'), ("é", None, '{}'), ("c", "y", None), (None, None, '{"v":[]}'), (None, None, None)], "uuid string, n string, _json string")
    assert [r.value for r in tables.export_documents({"other": df})["other"].collect()] == [
        '{"uuid":"a","n":"x\\"}","v":[1.0]}', '{"uuid":"é"}', '{"uuid":"c","n":"y"}', '{"v":[]}', '{}']
