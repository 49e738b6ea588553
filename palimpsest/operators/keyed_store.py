"""A stored table with keyed upserts as a log: a batch writes only the buckets it touches.

Rows are dealt into buckets by a hash of their key.  A batch, reduced to one row per key, is appended as one
entry; nothing stored is read or rewritten.  Readers merge the entries of a bucket by key and column rule,
and compaction replaces a bucket's entries by one when there are many.  Each change is a version of the
table's manifest, which names every entry with the buckets it holds.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from palimpsest.sources.manifest import Manifest

BUCKETS = 64
#: Tasks of a shuffle, for each bucket, up to which a bucket's rows go to one task.
BUCKET_TASKS = 4
#: Entries of a bucket from which ``apply`` compacts it.
MOST_ENTRIES = 8
#: What a key's later rows do to a column: the first row stays, the last replaces it (also by null), the last that is
#: set replaces it, numbers add up, lists unite.
RULES = ("keep", "new", "new_if_set", "sum", "union")


@dataclass(frozen=True)
class KeyedStore:
    """One version of a table.  Changes return the next version and leave this one readable."""

    spark: SparkSession
    root: str
    version: int
    state: dict

    @staticmethod
    def create(spark: SparkSession, root: str, rows: DataFrame, keys: list[str], rules: dict[str, str], *, buckets: int = BUCKETS) -> "KeyedStore":
        """A table that starts with ``rows``, one for each key.  Columns without a rule keep their first value."""
        unknown = {r for r in rules.values() if r not in RULES} | {c for c in [*rules, *keys] if c not in rows.columns} | (set(rules) & set(keys))
        if unknown:
            raise ValueError(f"unknown rules or columns: {sorted(unknown)}")
        state = {"ddl": ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema), "columns": rows.columns,
                 "keys": keys, "rules": rules, "buckets": buckets, "entries": [], "batches": {}}
        return KeyedStore(spark, root, 0, state)._append(rows, None)

    @staticmethod
    def load(spark: SparkSession, root: str, version: int | None = None) -> "KeyedStore":
        version, state = Manifest(spark, root).read(version)
        if not version:
            raise ValueError(f"{root} holds no table")
        return KeyedStore(spark, root, version, state)

    def _next(self, **changes) -> "KeyedStore":
        state = {**self.state, **changes}
        Manifest(self.spark, self.root).commit(self.version + 1, state)
        return KeyedStore(self.spark, self.root, self.version + 1, state)

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.state["keys"]), F.lit(self.state["buckets"])).cast("int")

    def _by_bucket(self) -> bool:
        """Whether there are buckets enough to be the tasks; a task for each of a few buckets would hold too many rows."""
        return BUCKET_TASKS * self.state["buckets"] >= int(self.spark.conf.get("spark.sql.shuffle.partitions"))

    def placed(self, rows: DataFrame) -> DataFrame:
        """Rows with their ``_bucket``, moved to where it is written; updates reduced there to one for each bucket and key are not moved again.

        If there are few buckets, a bucket's rows are dealt by key to many tasks, each of which writes a file of it.
        """
        rows = rows.withColumn("_bucket", self._bucket())
        return rows.repartition("_bucket") if self._by_bucket() else rows.repartition(*self.state["keys"])

    def _write(self, rows: DataFrame) -> tuple[str, list[int]]:
        """A new folder with a file for each bucket that ``rows`` touch, or, if buckets are few, one from each task."""
        name = f"entry-{uuid.uuid4().hex}"
        path = f"{self.root}/data/{name}"
        types = {c: t for c, t in self.spark.createDataFrame([], self.state["ddl"]).dtypes}
        if "_bucket" not in rows.columns:
            rows = self.placed(rows) if self._by_bucket() else rows.withColumn("_bucket", self._bucket())
        rows = rows.select(*[(F.col(c) if c in rows.columns else F.lit(None)).cast(types[c]).alias(c) for c in self.state["columns"]], "_bucket")
        rows.write.option("compression", "zstd").partitionBy("_bucket").parquet(path)
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        listed = folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).listStatus(folder)
        names = [f.getPath().getName() for f in listed]
        return name, sorted(int(n.split("=")[1]) for n in names if n.startswith("_bucket="))

    def _append(self, rows: DataFrame, batch: tuple[str, int] | None) -> "KeyedStore":
        name, touched = self._write(rows)
        entries = self.state["entries"] + ([{"name": name, "order": self.version + 1, "buckets": touched}] if touched else [])
        return self._next(entries=entries, batches={**self.state["batches"], **dict([batch] if batch else [])})

    def apply(self, updates: DataFrame, *, batch: tuple[str, int] | None = None, most_entries: int = MOST_ENTRIES) -> "KeyedStore":
        """Adds ``updates``, one row for each key (see ``upserts.latest``).

        Rows that carry their ``_bucket`` must lie as ``placed`` has put them.
        ``batch`` is a source and its batch's number, which only grows: a number that was applied before changes nothing.
        Buckets that then have more than ``most_entries`` entries are compacted.
        """
        if batch is not None and batch[1] <= self.state["batches"].get(batch[0], batch[1] - 1):
            return self
        after = self._append(updates, batch)
        full = [b for b, n in after.entries_by_bucket().items() if n > most_entries]
        return after.compact(full) if full else after

    def entries_by_bucket(self) -> dict[int, int]:
        counts: dict[int, int] = {}
        for e in self.state["entries"]:
            for b in e["buckets"]:
                counts[b] = counts.get(b, 0) + 1
        return counts

    def compact(self, buckets: list[int] | None = None) -> "KeyedStore":
        """Replaces all entries of the given buckets (default: all with several) by one."""
        buckets = [b for b, n in self.entries_by_bucket().items() if n > 1] if buckets is None else buckets
        if not buckets:
            return self
        gone = set(buckets)
        name, touched = self._write(self._merged(self.placed(self.log(buckets)), ["_bucket"]))
        rest = [{**e, "buckets": [b for b in e["buckets"] if b not in gone]} for e in self.state["entries"]]
        order = max(e["order"] for e in self.state["entries"])
        return self._next(entries=[e for e in rest if e["buckets"]] + [{"name": name, "order": order, "buckets": touched}])

    def log(self, buckets: list[int] | None = None) -> DataFrame:
        """All stored rows with ``_order``, of some buckets or all; only their files are listed and read."""
        rows = None
        for e in self.state["entries"]:
            wanted = [b for b in e["buckets"] if buckets is None or b in buckets]
            if not wanted:
                continue
            base = f"{self.root}/data/{e['name']}"
            paths = [f"{base}/_bucket={b}" for b in wanted]
            part = self.spark.read.schema(self.state["ddl"]).parquet(*paths).withColumn("_order", F.lit(e["order"]))
            rows = part if rows is None else rows.unionByName(part)
        return self.spark.createDataFrame([], self.state["ddl"] + ", _order int") if rows is None else rows

    def read(self, buckets: list[int] | None = None) -> DataFrame:
        """The table: every key's rows, few as they are, merged in order by one aggregation.

        An entry has a key once, so nothing can be combined before the shuffle: plain rows move, which are narrower than half-merged ones.
        """
        return self._merged(self.log(buckets).repartition(*self.state["keys"]))

    def _merged(self, rows: DataFrame, place: list[str] | None = None) -> DataFrame:
        """Rows of the log merged by key, where they lie together by key or by the columns ``place``, which stay."""
        keys, rules = self.state["keys"], self.state["rules"]
        merged = []
        for c in self.state["columns"]:
            if c in keys:
                continue
            value, set_ = F.col(f"`{c}`"), F.col(f"`{c}`").isNotNull()
            if rules.get(c) == "new":
                merged.append(F.max_by(F.struct(value), "_order")[c].alias(c))
            elif rules.get(c) == "new_if_set":
                merged.append(F.max_by(F.when(set_, F.struct(value)), F.when(set_, F.col("_order")))[c].alias(c))
            elif rules.get(c) == "sum":
                merged.append(F.sum(value).alias(c))
            elif rules.get(c) == "union":
                merged.append(F.when(F.count(value) > 0, F.array_sort(F.array_distinct(F.flatten(F.collect_list(value))))).alias(c))
            else:
                merged.append(F.min_by(F.struct(value), "_order")[c].alias(c))
        out = rows.groupBy(*(place or []), *keys).agg(*merged)
        types = dict(self.spark.createDataFrame([], self.state["ddl"]).dtypes)
        return out.select(*[F.col(f"`{c}`").cast(types[c]).alias(c) for c in self.state["columns"]], *(place or []))

    def changes(self, since: int) -> DataFrame:
        """Rows that versions after ``since`` have added (compacted buckets show as they are now)."""
        return self.log().filter(F.col("_order") > since).drop("_order")

    def vacuum(self) -> int:
        """Deletes entries that only older versions name, and those versions; returns how many entries."""
        manifest, used, gone = Manifest(self.spark, self.root), {e["name"] for e in self.state["entries"]}, set()
        for version in manifest.versions():
            if version < self.version:
                gone |= {e["name"] for e in manifest.read(version)[1]["entries"]} - used
                manifest.forget(version)
        for name in sorted(gone):
            manifest.delete(f"data/{name}")
        return len(gone)
