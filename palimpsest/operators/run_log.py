"""Runs, tool calls, answers and memories as a log beside the episodes: appended as rows, nested only on export.

An append writes its rows and a version, and reads nothing; which run a call or an answer belongs to (the last one its
session had when it was appended) is settled when the log is read, per session.  The nested document of an
episode is built for readers that want it, so no stored document is parsed or rewritten.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from palimpsest import schema
from palimpsest.operators.joins import metadata_struct
from palimpsest.sources.manifest import Manifest

SESSION = ["episode_uuid", "session_id"]
_RUN_TEXTS = ("user_id", "timestamp", "query", "augmented_query", "agent_response", "llm_saved_memory")
#: What rows of each kind hold.  ``of`` names the run of a call that is not its session's last one.
KINDS = {
    "runs": "episode_uuid string, session_id string, run_id string, run_at timestamp, " + ", ".join(f"{c} string" for c in _RUN_TEXTS),
    "calls": f"episode_uuid string, session_id string, called_at timestamp, call_id string, call {schema.TOOL_CALL_DDL}, of string",
    "answers": "episode_uuid string, session_id string, part_no bigint, part string",
    "memories": "episode_uuid string, created_at timestamp, content string, user_id string, session_id string, source string",
}


@dataclass(frozen=True)
class RunLog:
    """One version of a log.  Appends return the next version."""

    spark: SparkSession
    root: str
    version: int
    entries: list

    @staticmethod
    def create(spark: SparkSession, root: str) -> "RunLog":
        Manifest(spark, root).commit(1, {"entries": []})
        return RunLog(spark, root, 1, [])

    @staticmethod
    def load(spark: SparkSession, root: str, version: int | None = None) -> "RunLog":
        version, state = Manifest(spark, root).read(version)
        if not version:
            raise ValueError(f"{root} holds no log")
        return RunLog(spark, root, version, state["entries"])

    def append(self, **rows: DataFrame) -> "RunLog":
        """Appends rows of any kinds as one version; columns that a kind does not name are left out, missing ones are null."""
        order, written = self.version + 1, []
        for kind, df in rows.items():
            name = f"{kind}/{order:08d}-{uuid.uuid4().hex[:12]}"
            types = dict(self.spark.createDataFrame([], KINDS[kind]).dtypes)
            df.select(*[(F.col(c) if c in df.columns else F.lit(None)).cast(t).alias(c) for c, t in types.items()]).write.parquet(f"{self.root}/{name}")
            written.append({"kind": kind, "name": name, "order": order})
        Manifest(self.spark, self.root).commit(order, {"entries": self.entries + written})
        return RunLog(self.spark, self.root, order, self.entries + written)

    def import_episodes(self, episodes: DataFrame) -> "RunLog":
        """Appends what the nested metadata of ``episodes`` hold, once."""
        meta = metadata_struct(episodes).select(F.col("uuid").alias("episode_uuid"), "created_at", "meta")
        runs = meta.select("episode_uuid", F.explode("meta.sessions").alias("session_id", "rs")).select(*SESSION, F.posexplode("rs").alias("pos", "run"))
        # positions stand in for times, so that equal times keep the document's order
        at = F.timestamp_micros("pos")
        flat = runs.select(*SESSION, "run.run_id", at.alias("run_at"), *[F.col(f"run.{c}").alias(c) for c in _RUN_TEXTS])
        log = self.append(runs=flat, memories=meta.select("episode_uuid", F.posexplode("meta.memories").alias("n", "m")).select(
            "episode_uuid", F.timestamp_micros("n").alias("created_at"), "m.*"))
        calls = runs.select(*SESSION, F.col("run.run_id").alias("of"), F.posexplode("run.tools_used").alias("n", "call"))
        return log.append(calls=calls.select(*SESSION, F.timestamp_micros("n").alias("called_at"), "call", "of"))

    def rows(self, kind: str) -> DataFrame:
        """All rows of a kind with ``_order``, the version that appended them."""
        out = None
        for e in self.entries:
            if e["kind"] == kind:
                part = self.spark.read.schema(KINDS[kind]).parquet(f"{self.root}/{e['name']}").withColumn("_order", F.lit(e["order"]))
                out = part if out is None else out.unionByName(part)
        return self.spark.createDataFrame([], KINDS[kind] + ", _order int") if out is None else out

    def runs(self) -> DataFrame:
        """Runs by session with ``run_no``; a run that repeats the id of its session's last run is that run."""
        inside = W.partitionBy(*SESSION).orderBy("_order", "run_at", "run_id")
        repeats = F.lag("run_id").over(inside).eqNullSafe(F.col("run_id")) & (F.row_number().over(inside) > 1)
        kept = self.rows("runs").withColumn("_again", repeats).filter("NOT _again").drop("_again")
        return kept.withColumn("run_no", F.row_number().over(inside).cast("int"))

    def _placed(self, rows: DataFrame) -> DataFrame:
        """Rows with the number of their session's last run when they were appended; those of sessions without a run are left out."""
        mine = rows.select(*SESSION, "_order", F.struct(*rows.columns).alias("_row"), F.lit(None).cast("int").alias("run_no"))
        marks = self.runs().select(*SESSION, "_order", F.lit(None).cast(mine.schema["_row"].dataType).alias("_row"), "run_no")
        # of one version, runs come first
        seen = W.partitionBy(*SESSION).orderBy("_order", F.col("_row").isNotNull()).rowsBetween(W.unboundedPreceding, W.currentRow)
        both = marks.unionByName(mine).withColumn("at", F.max("run_no").over(seen))
        return both.filter("_row IS NOT NULL AND at IS NOT NULL").select("_row.*", F.col("at").alias("run_no"))

    def calls(self) -> DataFrame:
        """Calls with the number of their run, in order ``call_no``."""
        rows = self.rows("calls")
        numbers = self.runs().groupBy(*SESSION, F.col("run_id").alias("of")).agg(F.max("run_no").alias("run_no"))
        old = rows.filter("of IS NOT NULL").join(numbers, [*SESSION, "of"]).select(*rows.columns, "run_no")
        new = self._placed(rows.filter("of IS NULL"))
        nth = W.partitionBy(*SESSION, "run_no").orderBy("_order", "called_at", "call_id")
        return old.unionByName(new).withColumn("call_no", F.row_number().over(nth).cast("int"))

    def answers(self) -> DataFrame:
        """The last answer that was set on each run: its parts joined by blanks."""
        placed = self._placed(self.rows("answers"))
        one = placed.groupBy(*SESSION, "run_no", "_order").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part_no", "part"))), lambda p: p["part"]), " ").alias("answer"))
        return one.groupBy(*SESSION, "run_no").agg(F.max_by("answer", "_order").alias("answer"))

    def flat(self) -> DataFrame:
        """One row per run: its texts, the answer as set last, and its number of calls."""
        counts = self.calls().groupBy(*SESSION, "run_no").agg(F.count("*").alias("n_calls"))
        out = self.runs().join(self.answers(), [*SESSION, "run_no"], "left").join(counts, [*SESSION, "run_no"], "left")
        return out.withColumns({"agent_response": F.coalesce("answer", "agent_response"), "n_calls": F.coalesce("n_calls", F.lit(0).cast("long"))}).drop("answer", "_order")

    def documents(self) -> DataFrame:
        """``episode_uuid, sessions, memories`` as in an episode's metadata (see ``schema.METADATA``)."""
        # calls and runs hold maps, which cannot be sorted: their numbers are, and fetch them
        tools = self.calls().groupBy(*SESSION, "run_no").agg(F.sort_array(F.collect_list("call_no")).alias("_k"), F.map_from_entries(F.collect_list(F.struct("call_no", "call"))).alias("_c"))
        tools = tools.select(*SESSION, "run_no", F.transform("_k", lambda n: F.element_at("_c", n)).alias("tools_used"))
        runs = self.runs().drop("_order").join(self.answers(), [*SESSION, "run_no"], "left").join(tools, [*SESSION, "run_no"], "left")
        none = F.array().cast(f"array<{schema.TOOL_CALL_DDL}>")
        run = F.struct("run_id", "user_id", "timestamp", "query", "augmented_query", F.coalesce("answer", "agent_response").alias("agent_response"),
                       F.coalesce("tools_used", none).alias("tools_used"), "llm_saved_memory").cast(schema.RUN_DDL)
        lists = runs.groupBy(*SESSION).agg(F.sort_array(F.collect_list("run_no")).alias("k"), F.map_from_entries(F.collect_list(F.struct("run_no", run.alias("run")))).alias("m"))
        lists = lists.select(*SESSION, F.transform("k", lambda n: F.element_at("m", n)).alias("runs"))
        sessions = lists.groupBy("episode_uuid").agg(F.map_from_entries(F.collect_list(F.struct("session_id", "runs"))).alias("sessions"))
        memory = F.struct("_order", "created_at", F.struct("content", "user_id", "session_id", "source").cast(schema.MEMORY_DDL).alias("m"))
        memories = self.rows("memories").groupBy("episode_uuid").agg(F.transform(F.array_sort(F.collect_list(memory)), lambda x: x["m"]).alias("memories"))
        return sessions.join(memories, "episode_uuid", "full_outer")
