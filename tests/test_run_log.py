"""The run log against the same changes made to nested documents."""

import random

from pyspark.sql import functions as F

from palimpsest import schema
from palimpsest.operators import metadata
from palimpsest.operators.joins import metadata_struct
from palimpsest.operators.run_log import RunLog
from palimpsest.streaming.incremental import fresh_path

RUN = schema.RUN_DDL


def run_batch(spark, rng, n):
    rows = [(f"e{rng.randrange(4)}", f"s{rng.randrange(3)}", 1000 * k, f"r{rng.randrange(3)}", f"q{k}") for k in range(n)]
    df = spark.createDataFrame(rows, "episode_uuid string, session_id string, at long, run_id string, query string")
    run = F.struct("run_id", F.lit("u").alias("user_id"), F.lit("t").alias("timestamp"), "query", F.lit(None).cast("string").alias("augmented_query"),
                   F.lit("").alias("agent_response"), F.array().cast(f"array<{schema.TOOL_CALL_DDL}>").alias("tools_used"), F.lit(None).cast("string").alias("llm_saved_memory"))
    return df.select("episode_uuid", "session_id", F.timestamp_millis("at").alias("run_at"), run.cast(RUN).alias("run"))


def call_batch(spark, rng, n):
    rows = [(f"e{rng.randrange(4)}", f"s{rng.randrange(4)}", rng.randrange(3), f"c{k:02d}") for k in range(n)]
    df = spark.createDataFrame(rows, "episode_uuid string, session_id string, at long, call_id string")
    call = F.struct(F.col("call_id").alias("tool_name"), F.lit(True).alias("success"), F.lit(5).alias("duration_ms"), F.lit("t").alias("timestamp"),
                    F.create_map(F.lit("k"), F.col("call_id")).alias("input_params"), F.lit("o").alias("output_summary"), F.lit(None).cast("string").alias("error"),
                    F.lit(None).cast("string").alias("parent_tool_name"))
    return df.select("episode_uuid", "session_id", F.timestamp_millis("at").alias("called_at"), "call_id", call.cast(schema.TOOL_CALL_DDL).alias("call"))


def part_batch(spark, rng, n):
    rows = sorted({(f"e{rng.randrange(4)}", f"s{rng.randrange(4)}", k % 2, f"a{k}") for k in range(n)})
    return spark.createDataFrame(rows, "episode_uuid string, session_id string, part_no long, part string")


def memory_batch(spark, rng, n):
    rows = [(f"e{rng.randrange(4)}", k, f"m{k}", "u", "s0", "agent") for k in range(n)]
    df = spark.createDataFrame(rows, "episode_uuid string, at long, content string, user_id string, session_id string, source string")
    return df.select("episode_uuid", F.timestamp_millis("at").alias("created_at"), "content", "user_id", "session_id", "source")


def appended(log, runs):
    return log.append(runs=runs.select("episode_uuid", "session_id", "run_at", "run.*"))


def plain(df):
    def value(v):
        if isinstance(v, dict):
            return {k: value(x) for k, x in v.items()}
        if isinstance(v, (list, tuple)):
            return [value(x) for x in v]
        return v
    return {r[0]: (value(r[1] or {}), value(r[2] or [])) for r in df.collect() if r[1] or r[2]}


def nested(episodes):
    return plain(metadata_struct(episodes).select("uuid", "meta.sessions", "meta.memories"))


def test_equals_nested_documents(spark):
    rng = random.Random(2)
    eps = spark.createDataFrame([(f"e{k}", '{"sessions":{}}') for k in range(5)], "uuid string, metadata string").withColumn(
        "created_at", F.lit("2024-01-01").cast("timestamp")).withColumn("user_id", F.lit("u"))
    log = RunLog.create(spark, fresh_path(spark, "runs"))
    for step in range(3):
        runs, calls, parts, memories = run_batch(spark, rng, 9), call_batch(spark, rng, 12), part_batch(spark, rng, 5), memory_batch(spark, rng, 4)
        for df, change in ((runs, metadata.append_run), (calls, metadata.append_tool_execution), (parts, metadata.set_agent_response), (memories, metadata.append_memory)):
            eps = spark.createDataFrame(change(eps, df).select("uuid", "metadata", "created_at", "user_id").collect(), "uuid string, metadata string, created_at timestamp, user_id string")
        log = appended(log, runs).append(calls=calls, answers=parts, memories=memories)
    expected = nested(eps)
    assert plain(log.documents()) == expected
    again = RunLog.load(spark, log.root)
    assert again.entries == log.entries
    flat = {(r.episode_uuid, r.session_id, r.run_no): (r.run_id, r.agent_response, r.n_calls) for r in again.flat().collect()}
    assert flat == {(e, s, k + 1): (r[0], r[5], len(r[6])) for e, (sessions, _) in expected.items() for s, runs in sessions.items() for k, r in enumerate(runs)}
    # documents that exist already are taken over once, and give themselves back
    taken = RunLog.create(spark, fresh_path(spark, "runs")).import_episodes(eps)
    assert plain(taken.documents()) == expected


def test_an_append_reads_nothing(spark):
    log = RunLog.create(spark, fresh_path(spark, "runs"))
    assert plain(log.documents()) == {} and log.flat().collect() == []
    rng = random.Random(1)
    one = appended(log, run_batch(spark, rng, 4))
    two = one.append(calls=call_batch(spark, rng, 3))
    assert [e["kind"] for e in two.entries] == ["runs", "calls"] and one.flat().count() == one.runs().count()
    assert RunLog.load(spark, log.root, one.version).calls().count() == 0
