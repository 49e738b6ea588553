"""A keyword index that is kept between searches: Okapi BM25 over stored postings.

The index lies in a folder as segments, one for each batch of documents.  A segment's postings are dealt
by token into buckets; inside a bucket, a token's postings are ordered by impact and cut in blocks, each a
row with the largest term frequency and the smallest document length in it.  These bound the score a block
can give whatever the corpus statistics have become since, so a search with a limit skips blocks that
cannot reach its result list.  Adding documents writes one segment, removing writes tombstones and what they
take from the statistics, merging writes one segment without the dead; each is a new version.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from palimpsest.functions.scoring import as_score
from palimpsest.functions.text import tokenize
from palimpsest.operators.aggregates import top_per_group
from palimpsest.operators.bm25 import B, DOC_COLUMNS, EPSILON, K1, once_per_text
from palimpsest.operators.skew import BROADCAST_ROWS, broadcast_if_small, split_hot_join
from palimpsest.session import stage
from palimpsest.sources.manifest import Manifest

BUCKETS = 64
BLOCK_ROWS = 128
#: Documents whose words are counted at once.
COUNTED_ROWS = 1000
#: Postings of one token that one task orders; a more frequent token is dealt to several tasks.
CHAIN_ROWS = 1_000_000
#: Postings that a search may meet before it looks for blocks to skip; any number gives the same rows.
SKIP_FROM = 5_000_000
#: Tokens up to this number are also given to the scan as a list, so that row groups are skipped.
LISTED_TOKENS = 500


def _norm(dl: Column, average: float | None) -> Column:
    return K1 * (1 - B + B * dl / F.lit(average))


def _impact(tf: Column, dl: Column, average: float | None) -> Column:
    """What an occurrence count gives per unit of a token's weight: grows with ``tf``, falls with ``dl``."""
    return tf * (K1 + 1) / (tf + _norm(dl, average))


def _word_counts(docs: DataFrame, kept: list[str]) -> DataFrame:
    """``kept``, dl, tok and tf: a row for each different word of a document, counted where the document lies."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, COUNTED_ROWS):
                part = batch.slice(at, COUNTED_ROWS)
                lists = part.column(part.num_columns - 1)
                words, owner = pc.list_flatten(lists).dictionary_encode(), pc.list_parent_indices(lists).to_numpy(zero_copy_only=False)
                if not len(words):
                    continue
                known = len(words.dictionary)
                pairs, tf = np.unique(owner.astype(np.int64) * known + words.indices.to_numpy(), return_counts=True)
                rows = pa.array(pairs // known)
                columns = [part.column(i).take(rows) for i in range(len(kept))]
                dl = pc.list_value_length(lists).take(rows)
                yield pa.RecordBatch.from_arrays([*columns, dl, words.dictionary.take(pa.array(pairs % known)), pa.array(tf.astype(np.int32))], [*kept, "dl", "tok", "tf"])

    types = dict(docs.dtypes)
    return docs.select(*kept, "tokens").mapInArrow(run, ", ".join(f"`{c}` {types[c]}" for c in kept) + ", dl int, tok string, tf int")


def _blocks(rows: DataFrame, keys: list[str]) -> DataFrame:
    """tok, block, max_tf, min_dl, docs of rows in which those with the same ``keys`` stand together, by impact; the last block, which may go on, waits for more."""
    names = rows.columns
    docs = [c for c in names if c not in keys]

    def cut(table: pa.Table, done: int, last: bool) -> tuple[pa.RecordBatch, pa.Table, int]:
        """The table's full blocks, the rows left for later, and how many blocks of their run were cut; ``done``: of the first run."""
        columns = [table.column(c).combine_chunks() for c in names]
        first = np.zeros(len(table), bool)
        first[0] = True
        for column in columns[:len(keys)]:
            first[1:] |= pc.not_equal(column.slice(1), column.slice(0, len(table) - 1)).to_numpy(zero_copy_only=False)
        runs = np.flatnonzero(first)
        run = np.cumsum(first) - 1
        nth = np.arange(len(table)) - runs[run]
        starts = np.flatnonzero(nth % BLOCK_ROWS == 0)
        ends = np.append(starts[1:], len(table))
        block = nth[starts] // BLOCK_ROWS + np.where(run[starts] == 0, done, 0)
        left = starts[-1] if not last else len(table)
        if not last:
            starts, ends, begun = starts[:-1], ends[:-1], int(block[-1])
            block = block[:-1]
        else:
            begun = 0
        of = dict(zip(names, columns))
        offsets = np.append(starts, left).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays([of[c].slice(0, left) for c in docs], docs))
        tf, dl = of["tf"].to_numpy()[:left], of["dl"].to_numpy()[:left]
        most, least = (np.maximum.reduceat(tf, starts), np.minimum.reduceat(dl, starts)) if len(starts) else (tf[:0], dl[:0])
        at = pa.array(starts)
        out = [of["tok"].take(at), pa.array(block.astype(np.int32)), pa.array(most), pa.array(least), lists]
        return pa.RecordBatch.from_arrays(out, ["tok", "block", "max_tf", "min_dl", "docs"]), table.slice(left), begun

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest, done = None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            found, rest, done = cut(table if rest is None else pa.concat_tables([rest, table]), done, False)
            yield found
        if rest is not None:
            yield cut(rest, done, True)[0]

    types = dict(rows.dtypes)
    doc = ", ".join(f"`{c}`: {types[c]}" for c in docs)
    return rows.mapInArrow(run, f"tok string, block int, max_tf int, min_dl int, docs array<struct<{doc}>>")


@dataclass(frozen=True)
class KeywordStore:
    """One version of an index.  Changes return the next version and leave this one readable."""

    spark: SparkSession
    root: str
    version: int
    state: dict

    # ---- versions ---------------------------------------------------------------------------

    @staticmethod
    def create(spark: SparkSession, root: str, *, buckets: int = BUCKETS, carried: dict[str, str] | None = None) -> "KeywordStore":
        """An empty index.  ``carried`` names further columns of documents (and their types) that searches filter by."""
        state = {"buckets": buckets, "carried": carried or {}, "next": 0, "segments": [], "terms": [], "removed": [], "n": 0, "total_len": 0, "mean_idf": None}
        Manifest(spark, root).commit(1, state)
        return KeywordStore(spark, root, 1, state)

    @staticmethod
    def load(spark: SparkSession, root: str, version: int | None = None) -> "KeywordStore":
        version, state = Manifest(spark, root).read(version)
        if not version:
            raise ValueError(f"{root} holds no index")
        return KeywordStore(spark, root, version, state)

    def _next(self, **changes) -> "KeywordStore":
        state = {**self.state, **changes, "next": self.state["next"] + 1}
        state["mean_idf"] = _mean_idf(self._counts(state["terms"]), state["n"]) if state["terms"] else None
        Manifest(self.spark, self.root).commit(self.version + 1, state)
        return KeywordStore(self.spark, self.root, self.version + 1, state)

    def _folder(self) -> str:
        """A new folder's name: its number tells the order, the rest keeps writers that fail and try again apart."""
        return f"{self.state['next']:06d}-{uuid.uuid4().hex[:12]}"

    def vacuum(self) -> int:
        """Deletes the folders of older versions that this one does not use, and those versions; returns how many folders."""
        manifest, used, gone = Manifest(self.spark, self.root), set(self._folders(self.state)), set()
        for version in manifest.versions():
            if version < self.version:
                gone |= set(self._folders(manifest.read(version)[1])) - used
                manifest.forget(version)
        for folder in sorted(gone):
            manifest.delete(folder)
        return len(gone)

    @staticmethod
    def _folders(state: dict) -> list[str]:
        return [f"{kind}/{s}" for s in state["segments"] for kind in ("docs", "postings")] + [f"terms/{t}" for t in state["terms"]] + [f"removed/{r}" for r in state["removed"]]

    # ---- stored tables ----------------------------------------------------------------------

    @property
    def _carried(self) -> str:
        return "".join(f", {c} {t}" for c, t in self.state["carried"].items())

    def _read(self, kind: str, names: list[str], schema: str) -> DataFrame:
        """The named folders of one kind, with the folder's number as ``segment``."""
        if not names:
            return self.spark.createDataFrame([], f"{schema}, segment int")
        reader = self.spark.read.schema(schema)
        parts = [reader.parquet(f"{self.root}/{kind}/{n}").withColumn("segment", F.lit(int(n[:6]))) for n in names]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    def postings(self) -> DataFrame:
        """tok, block, max_tf, min_dl, docs (an array of postings), bucket, segment."""
        doc = "array<struct<" + ", ".join(["uuid:string", "user_id:string", "created_at:timestamp", "dl:int", "tf:int", *[f"{c}:{t}" for c, t in self.state["carried"].items()]]) + ">>"
        return self._read("postings", self.state["segments"], f"tok string, block int, max_tf int, min_dl int, docs {doc}, bucket int")

    def documents(self) -> DataFrame:
        """Live documents: uuid, user_id, created_at, tokens, carried columns, segment."""
        docs = self._read("docs", self.state["segments"], f"uuid string, user_id string, created_at timestamp, tokens array<string>{self._carried}")
        return self._alive(docs)

    def _alive(self, rows: DataFrame) -> DataFrame:
        if not self.state["removed"]:
            return rows
        dead = self._read("removed", self.state["removed"], "uuid string, of int").select("uuid", F.col("of").alias("segment"))
        return rows.join(broadcast_if_small(dead), ["uuid", "segment"], "left_anti")

    def _counts(self, names: list[str]) -> DataFrame:
        """tok and df of all live documents."""
        return self._read("terms", names, "tok string, df bigint").groupBy("tok").agg(F.sum("df").alias("df")).filter("df > 0")

    def stats(self) -> dict:
        return {"documents": self.state["n"], "tokens": self.state["total_len"], "segments": len(self.state["segments"]), "tombstones": len(self.state["removed"])}

    # ---- changes ----------------------------------------------------------------------------

    def add(self, docs: DataFrame) -> "KeywordStore":
        """Adds documents ``uuid, user_id, created_at, tokens`` and the carried columns (as of ``bm25.documents``) as one segment."""
        name, n, total = self._write(docs)
        return self._next(segments=self.state["segments"] + [name], terms=self.state["terms"] + [name], n=self.state["n"] + n, total_len=self.state["total_len"] + total)

    def _write(self, docs: DataFrame) -> tuple[str, int, int]:
        name = self._folder()
        docs.select(*DOC_COLUMNS, "tokens", *self.state["carried"]).write.option("compression", "zstd").parquet(f"{self.root}/docs/{name}")
        docs = self._read("docs", [name], f"uuid string, user_id string, created_at timestamp, tokens array<string>{self._carried}")
        posted = docs.select(F.size("tokens").cast("long").alias("dl"), F.explode(F.array_append(F.array_distinct("tokens"), F.lit(""))).alias("tok"))
        counts = stage(posted.groupBy("tok").agg(F.count("*").alias("df"), F.sum("dl").alias("total_len")))
        totals = counts.filter("tok = ''").select("df", "total_len").first()
        n, total = (totals["df"], totals["total_len"]) if totals else (0, 0)
        counts.filter("tok <> ''").select("tok", "df").coalesce(max(1, min(self.state["buckets"], counts.rdd.getNumPartitions()))).write.parquet(f"{self.root}/terms/{name}")
        self._write_postings(docs, counts, n, total, name)
        return name, n, total

    def _write_postings(self, docs: DataFrame, counts: DataFrame, n: int, total: int, name: str) -> None:
        """One shuffle by (bucket, chain) of one row for each word of a document; where it puts them they are sorted once and cut into blocks."""
        kept = [*DOC_COLUMNS, "dl", *self.state["carried"]]
        words = _word_counts(docs, [*DOC_COLUMNS, *self.state["carried"]])
        if not docs.groupBy("uuid").count().filter("count > 1").isEmpty():  # rows of one document under one id
            words = words.groupBy("tok", *kept).agg(F.sum("tf").cast("int").alias("tf"))
        words = words.withColumn("bucket", F.pmod(F.xxhash64("tok"), F.lit(self.state["buckets"])).cast("int"))
        often = counts.filter((F.col("tok") != "") & (F.col("df") > CHAIN_ROWS)).select("tok", F.ceil(F.col("df") / CHAIN_ROWS).alias("chains"))
        chain = []
        if not often.isEmpty():
            words = words.join(broadcast_if_small(often), "tok", "left").withColumn("chain", F.pmod(F.xxhash64("uuid"), F.coalesce("chains", F.lit(1))).cast("int"))
            chain = ["chain"]
        # a number is sorted faster than words are; blocks are few and are sorted by their words
        impact = _impact(F.col("tf"), F.col("dl"), total / n if total else 1.0)
        rows = words.repartition("bucket", *chain).withColumn("hash", F.xxhash64("tok")).withColumn("impact", impact)
        rows = rows.sortWithinPartitions("hash", *chain, "tok", F.desc("impact"), "uuid").select(*chain, "tok", *kept, "tf")
        blocks = _blocks(rows, [*chain, "tok"]).withColumn("bucket", F.pmod(F.xxhash64("tok"), F.lit(self.state["buckets"])).cast("int"))
        blocks.sortWithinPartitions("bucket", "tok", "block").write.option("compression", "zstd").partitionBy("bucket").parquet(f"{self.root}/postings/{name}")

    def remove(self, uuids: DataFrame) -> "KeywordStore":
        """Removes all live documents whose ``uuid`` is in ``uuids``; statistics are as if they had never been added."""
        gone = stage(self.documents().join(uuids.select("uuid").distinct(), "uuid", "left_semi"))
        n, total = gone.agg(F.count("*"), F.coalesce(F.sum(F.size("tokens")), F.lit(0))).first()
        if not n:
            return self
        name = self._folder()
        gone.select("uuid", F.col("segment").alias("of")).write.parquet(f"{self.root}/removed/{name}")
        taken = gone.select(F.explode(F.array_distinct("tokens")).alias("tok")).groupBy("tok").agg((-F.count("*")).alias("df"))
        taken.write.parquet(f"{self.root}/terms/{name}")
        return self._next(removed=self.state["removed"] + [name], terms=self.state["terms"] + [name], n=self.state["n"] - n, total_len=self.state["total_len"] - total)

    def merge(self) -> "KeywordStore":
        """All live documents as one segment, without tombstones."""
        name, n, total = self._write(self.documents())
        return self._next(segments=[name], terms=[name], removed=[], n=n, total_len=total)

    # ---- search -----------------------------------------------------------------------------

    def score(self, queries: DataFrame, *, where: Callable[[DataFrame], DataFrame] | None = None, candidates: DataFrame | None = None,
              limit: int | None = None, min_score: float | None = None, skip_from: int = SKIP_FROM) -> DataFrame:
        """``query_id, uuid, created_at, score`` of documents that share a token with a query and pass the filters.

        ``where`` filters rows by carried columns, ``candidates`` by ``uuid``; a query with a user meets that
        user's documents only.  With a ``limit`` blocks that cannot reach a query's best ``limit``
        documents (or ``min_score``) are not opened, so rows that cannot be in that list may be missing.
        """
        q = queries.select("query_id", F.coalesce("user_id", F.lit("")).alias("q_user"), F.explode(tokenize(F.col("text"))).alias("tok"))
        q = stage(q.groupBy("query_id", "q_user", "tok").agg(F.count("*").alias("qtf")))
        size = q.count()
        small = size <= BROADCAST_ROWS
        weights = stage(self._weights(q.select("tok").distinct(), small))
        low, met = weights.agg(F.min("idf"), F.sum("df")).first()
        if low is None:
            return self.spark.createDataFrame([], q.select("query_id").schema).select("query_id", F.lit("").alias("uuid"), F.lit(None).cast("timestamp").alias("created_at"), F.lit(0.0).alias("score"))
        weighted = q.join(F.broadcast(weights) if small else weights, "tok").select("query_id", "q_user", "tok", "bucket", (F.col("qtf") * F.col("idf")).alias("w"))
        weighted = stage(weighted)
        blocks = self._blocks_of(weights, small)

        def opened(blocks: DataFrame, *kept: str) -> DataFrame:
            """The postings in the given rows that pass the filters."""
            rows = self._alive(blocks.select(*kept, "segment", F.explode("docs").alias("d")).select(*kept, "segment", "d.*"))
            rows = rows if where is None else where(rows)
            return rows if candidates is None else rows.join(candidates.select("uuid").distinct(), "uuid", "left_semi")

        def summed(rows: DataFrame) -> DataFrame:
            rows = rows.filter((F.col("q_user") == "") | (F.col("q_user") == F.col("user_id")))
            return rows.groupBy("query_id", "uuid", "created_at").agg(F.sum(F.col("w") * _impact(F.col("tf"), F.col("dl"), self._average)).alias("score"))

        def partial(blocks: DataFrame) -> DataFrame:
            """Sums over the given (query, block) rows."""
            return summed(opened(blocks, "query_id", "q_user", "w"))

        met_by = F.broadcast(weighted) if small else weighted
        join = blocks.join(met_by, ["bucket", "tok"]) if small else split_hot_join(blocks, met_by, ["bucket", "tok"])
        skipped = limit is not None and low >= 0 and met > skip_from
        if skipped:
            join = self._without_skipped(join, weighted, partial, limit, min_score)
        if not small:
            return partial(join).withColumn("score", as_score(F.col("score")))
        # A posting moves once, to its document, and meets there the queries that ask for its word.
        tokens = weights.select("tok", "bucket", F.monotonically_increasing_id().alias("number"))
        tokens = stage(tokens)
        named = weighted.join(F.broadcast(tokens), ["tok", "bucket"]).select("query_id", "q_user", "w", "number")
        blocks = blocks.join(F.broadcast(tokens), ["bucket", "tok"])
        if skipped:  # a word's blocks from its best to the last that any query needs
            last = join.groupBy("bucket", "tok", "segment").agg(F.max("block").alias("last"))
            blocks = blocks.join(broadcast_if_small(stage(last)), ["bucket", "tok", "segment"]).filter(F.col("block") <= F.col("last"))
        owner = F.when(F.lit(not weighted.filter("q_user <> ''").isEmpty()), F.col("user_id")).alias("user_id")
        rows = opened(blocks, "number").select("number", "uuid", owner, "created_at", "dl", "tf").repartition("uuid")
        return summed(rows.join(F.broadcast(named), "number")).withColumn("score", as_score(F.col("score")))

    @property
    def _average(self) -> float | None:
        return self.state["total_len"] / self.state["n"] if self.state["n"] else None

    def _weights(self, vocabulary: DataFrame, small: bool) -> DataFrame:
        """tok, bucket, df, idf of the vocabulary's known tokens; negative weights become EPSILON times the mean weight."""
        counts = self._read("terms", self.state["terms"], "tok string, df bigint").join(F.broadcast(vocabulary) if small else vocabulary, "tok", "left_semi")
        counts = counts.groupBy("tok").agg(F.sum("df").alias("df")).filter("df > 0")
        raw = F.log(self.state["n"] - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)
        idf = F.when(raw < 0, F.lit(self.state["mean_idf"]) * EPSILON).otherwise(raw)
        return counts.select("tok", F.pmod(F.xxhash64("tok"), F.lit(self.state["buckets"])).cast("int").alias("bucket"), "df", idf.alias("idf"))

    def _blocks_of(self, weights: DataFrame, small: bool) -> DataFrame:
        """The stored blocks; a short list of tokens reaches the scan, a longer one prunes buckets by the join."""
        rows = self.postings()
        if small:
            known = weights.limit(LISTED_TOKENS + 1).select("tok", "bucket").collect()
            if len(known) <= LISTED_TOKENS:
                rows = rows.filter(F.col("bucket").isin(sorted({r["bucket"] for r in known})) & F.col("tok").isin([r["tok"] for r in known]))
        return rows

    def _without_skipped(self, join: DataFrame, weighted: DataFrame, partial: Callable[[DataFrame], DataFrame], limit: int, min_score: float | None) -> DataFrame:
        """(query, block) rows without those that cannot lift a document into the query's list.

        The first blocks give documents scores that can only grow; the ``limit``-th best of them is a bound.
        A document in a block has at most that block's best plus the best of every other token of the query.
        """
        found = partial(join.filter("block = 0"))
        nth = top_per_group(found, ["query_id"], [F.desc("score")], limit).filter(F.col("rank") == limit)
        floor = F.greatest(F.coalesce("bound", F.lit(0.0)), F.lit(min_score or 0.0)) - 1e-5  # scores are rounded later
        best = F.col("w") * _impact(F.col("max_tf"), F.col("min_dl"), self._average)
        most = stage(join.groupBy("query_id", "tok").agg(F.max(best).alias("most")))
        total = most.groupBy("query_id").agg(F.sum("most").alias("total"))
        bounds = stage(total.join(nth.select("query_id", F.col("score").alias("bound")), "query_id", "left").select("query_id", "total", floor.alias("floor")))
        limits = broadcast_if_small(stage(most.join(bounds, "query_id").select("query_id", "tok", (F.col("total") - F.col("most")).alias("others"), "floor")))
        return join.join(limits, ["query_id", "tok"]).filter(best + F.col("others") >= F.col("floor")).select(*join.columns)

    def search(self, queries: DataFrame, *, where: Callable[[DataFrame], DataFrame] | None = None, candidates: DataFrame | None = None,
               min_score: float = 0.01, limit: int = 10, skip_from: int = SKIP_FROM) -> DataFrame:
        """The best ``limit`` documents of every query: score, then newest, then id."""
        def lists(asked: DataFrame) -> DataFrame:
            hits = self.score(asked, where=where, candidates=candidates, limit=limit, min_score=min_score, skip_from=skip_from)
            return top_per_group(hits.filter(F.col("score") >= min_score), ["query_id"], [F.desc("score"), F.desc_nulls_last("created_at"), "uuid"], limit)

        return once_per_text(queries, lists)


def _mean_idf(counts: DataFrame, n: int) -> float | None:
    return counts.agg(F.avg(F.log(n - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))).first()[0]
