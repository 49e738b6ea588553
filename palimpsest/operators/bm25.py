"""Okapi BM25 over a table of documents, for a table of queries.

Corpus statistics always cover every document; filters only limit which documents are scored.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from palimpsest.functions.scoring import as_score
from palimpsest.functions.text import tokenize
from palimpsest.operators.aggregates import top_per_group
from palimpsest.operators.skew import BROADCAST_ROWS, broadcast_if_small, is_small, split_hot_join
from palimpsest.session import stage

# The customary Okapi constants; a negative idf becomes EPSILON times the mean idf.
K1, B, EPSILON = 1.5, 0.75, 0.25

DOC_COLUMNS = ("uuid", "user_id", "created_at")
#: Words of queries (within ``BROADCAST_BYTES``) that may go to the documents.
VOCABULARY = 2_000_000
#: Pairs of a query and a document that share a word, above which the word is looked up once for queries that share it.
HOT_PAIRS = 1_000_000
#: Documents for each different text from which on equal ones are scored once.
SAME_TEXTS = 4


def documents(df: DataFrame, text, *carried: str, user: str = "user_id", created: str = "created_at") -> DataFrame:
    """``uuid, user_id, created_at, tokens`` from any table with a text expression, and columns to filter by later."""
    return df.select("uuid", F.col(user).alias("user_id"), F.col(created).alias("created_at"),
                     tokenize(text).alias("tokens"), *carried)


@dataclass
class Bm25Index:
    """Term and corpus statistics (small) beside the tokenised documents."""

    docs: DataFrame    # uuid, user_id, created_at, tokens
    terms: DataFrame   # tok, df
    totals: DataFrame  # n, total_len

    def save(self, path: str) -> None:
        self.docs.write.mode("overwrite").parquet(f"{path}/docs")
        self.terms.write.mode("overwrite").parquet(f"{path}/terms")
        self.totals.write.mode("overwrite").parquet(f"{path}/totals")

    @staticmethod
    def load(spark: SparkSession, path: str) -> "Bm25Index":
        return Bm25Index(*(spark.read.parquet(f"{path}/{t}") for t in ("docs", "terms", "totals")))

    def add(self, new: "Bm25Index") -> "Bm25Index":
        """Statistics are additive: adding documents costs only the new ones and the vocabulary."""
        terms = self.terms.unionByName(new.terms).groupBy("tok").agg(F.sum("df").alias("df"))
        totals = self.totals.unionByName(new.totals).agg(F.sum("n").alias("n"), F.sum("total_len").alias("total_len"))
        return Bm25Index(self.docs.unionByName(new.docs), terms, totals)


def build(docs: DataFrame) -> Bm25Index:
    """Documents are tokenised and written once; one pass over them gives every statistic, written as well."""
    return of_written(stage(docs))


def of_written(docs: DataFrame) -> Bm25Index:
    """The index of documents that are written already.

    Each document adds its distinct tokens and one empty token; the empty token's row therefore
    counts documents and sums their lengths.
    """
    posted = docs.select(F.size("tokens").cast("long").alias("dl"),
                         F.explode(F.array_append(F.array_distinct("tokens"), F.lit(""))).alias("tok"))
    stats = stage(posted.groupBy("tok").agg(F.count("*").alias("df"), F.sum("dl").alias("total_len")))
    totals = stats.filter("tok = ''").agg(F.coalesce(F.sum("df"), F.lit(0)).alias("n"),
                                          F.coalesce(F.sum("total_len"), F.lit(0)).alias("total_len"))
    return Bm25Index(docs, stats.filter("tok <> ''").select("tok", "df"), totals)


def term_weights(index: Bm25Index) -> DataFrame:
    """``tok, idf`` with negative values replaced."""
    n = index.totals.select(F.col("n").cast("double")).scalar()
    raw = index.terms.select("tok", (F.log(n - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)).alias("idf"))
    mean = raw.agg(F.avg("idf").alias("m")).scalar()
    return raw.select("tok", F.when(F.col("idf") < 0, mean * EPSILON).otherwise(F.col("idf")).alias("idf"))


def score(index: Bm25Index, queries: DataFrame, candidates: DataFrame | None = None) -> DataFrame:
    """``query_id, uuid, created_at, score`` of every document sharing a token with a query.

    ``candidates`` (same columns as ``index.docs``) limits what is scored.  A query with a user
    scores only that user's documents.
    """
    q = _query_tokens(queries)
    small = q.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    return _paired(_word_weights(index, q, small, candidates), F.broadcast(q) if small else q)


def _word_weights(index: Bm25Index, q: DataFrame, small: bool, candidates: DataFrame | None) -> DataFrame:
    """``DOC_COLUMNS, tok, w``: what the words of the queries ``q`` weigh in the documents that hold them, placed by document."""
    # A bounded query vocabulary goes to the documents, so that only its postings are shuffled.
    # A larger one meets them by token, with tokens of very many documents handled apart.
    vocab = q.select("tok").distinct()
    weights = term_weights(index).join(F.broadcast(vocab) if small else vocab, "tok", "left_semi")
    if not small:
        weights = stage(weights)
        small = is_small(weights, VOCABULARY)
    avgdl = index.totals.select(F.try_divide("total_len", "n").alias("a")).scalar()  # null if empty
    docs = index.docs if candidates is None else candidates
    posted = docs.select(*DOC_COLUMNS, F.size("tokens").alias("dl"), F.explode_outer("tokens").alias("tok"))
    hits = posted.join(F.broadcast(weights), "tok") if small else split_hot_join(posted, weights, ["tok"])
    # One placement by document serves both the term count and the sum per (query, document).
    tf = hits.repartition("uuid").groupBy(*DOC_COLUMNS, "dl", "tok", "idf").agg(F.count("*").alias("tf"))
    norm = F.col("tf") + K1 * (1 - B + B * F.col("dl") / avgdl)
    return tf.select(*DOC_COLUMNS, "tok", (F.col("idf") * F.col("tf") * (K1 + 1) / norm).alias("w"))


def _paired(words: DataFrame, q: DataFrame) -> DataFrame:
    paired = words.join(q, "tok").filter((F.col("q_user") == "") | (F.col("q_user") == F.col("user_id")))
    return paired.groupBy("query_id", "uuid", "created_at").agg(as_score(F.sum(F.col("qtf") * F.col("w"))).alias("score"))


def _listed(hits: DataFrame, limit: int) -> DataFrame:
    return top_per_group(hits, ["query_id"], [F.desc("score"), F.desc_nulls_last("created_at"), "uuid"], limit)


def search(index: Bm25Index, queries: DataFrame, *, candidates: DataFrame | None = None,
           min_score: float = 0.01, limit: int = 10, hot_pairs: int = HOT_PAIRS) -> DataFrame:
    """The best ``limit`` documents of every query: score, then newest, then id.

    If most documents share user and text with others, one of each is scored and the lists are then filled with the others.
    """
    docs = index.docs if candidates is None else candidates
    text = F.md5(F.concat_ws(" ", F.coalesce(F.octet_length("user_id"), F.lit(-1)).cast("string"), "user_id", "tokens"))  # words hold no white space
    named = docs.select("uuid", "created_at", text.alias("text"))
    n, texts = named.agg(F.count("*"), F.approx_count_distinct("text")).first()
    alike = SAME_TEXTS * texts <= n and named.groupBy("uuid").count().filter("count > 1").isEmpty()
    if alike:
        members = stage(top_per_group(named, ["text"], [F.desc_nulls_last("created_at"), "uuid"], limit))
        first = members.filter("rank = 1").select("text", F.col("uuid").alias("first"))
        docs = docs.join(broadcast_if_small(first.select(F.col("first").alias("uuid"))), "uuid", "left_semi")

    def lists(asked: DataFrame) -> DataFrame:
        found = _listed(_scored_lists(index, asked, docs, min_score, limit, hot_pairs), limit)
        if not alike:
            return found
        others = members.join(first, "text").select("first", "uuid", "created_at")
        found = stage(found.select("query_id", F.col("uuid").alias("first"), "score"))
        return _listed(found.join(others, "first").select("query_id", "uuid", "created_at", "score"), limit)

    return once_per_text(queries, lists)


def _scored_lists(index: Bm25Index, asked: DataFrame, docs: DataFrame, min_score: float, limit: int, hot_pairs: int) -> DataFrame:
    """``query_id, uuid, created_at, score`` with at least each query's best ``limit`` documents.

    Words that many queries share with many documents would give a row for each such pair.  Queries of a user that
    share all such words share the list of the best documents by these alone; only documents that also hold another
    word of a query are scored for it.  As no word weighs less than nothing, a document without another word
    that is not in the shared list has ``limit`` documents before it.
    """
    q = _query_tokens(asked)
    asks = q.groupBy("tok").agg(F.count("*").alias("nq"))
    hot = asks.filter("nq > 1").join(index.terms, "tok").filter(F.col("nq") * F.col("df") > hot_pairs).select("tok")
    hot = stage(hot)
    if hot.isEmpty():
        return score(index, asked, docs).filter(F.col("score") >= min_score)
    q = stage(q.join(F.broadcast(hot.withColumn("hot", F.lit(True))), "tok", "left"))
    shared = F.array_sort(F.collect_list(F.struct("tok", "qtf")))
    group = F.md5(F.concat_ws(" ", F.octet_length("q_user").cast("string"), "q_user", F.to_json("words")))
    groups = q.filter("hot").groupBy("query_id", "q_user").agg(shared.alias("words")).withColumn("group", group)
    groups = stage(groups)
    n, kinds, least = *groups.agg(F.count("*"), F.count_distinct("group")).first(), term_weights(index).agg(F.min("idf")).first()[0]
    if 2 * kinds > n or least < 0:
        return score(index, asked, docs).filter(F.col("score") >= min_score)
    small = q.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    words = stage(_word_weights(index, q, small, docs))
    together = groups.groupBy("group", "q_user").agg(F.first("words").alias("words")).select(
        F.col("group").alias("query_id"), "q_user", F.explode("words").alias("x")).select("query_id", "q_user", "x.tok", "x.qtf")
    common = words.join(F.broadcast(hot), "tok", "left_semi")
    lists = _listed(_paired(common, broadcast_if_small(together, VOCABULARY)), limit).select(F.col("query_id").alias("group"), "uuid", "created_at", "score")
    by_group = groups.select("query_id", "group").join(broadcast_if_small(stage(lists)), "group").drop("group")
    # documents with the hot words they hold beside each other word; queries with their hot words likewise
    held = words.join(F.broadcast(hot.withColumn("hot", F.lit(True))), "tok", "left").groupBy(*DOC_COLUMNS).agg(
        F.collect_list(F.when(F.col("hot"), F.struct("tok", "w"))).alias("common"), F.collect_list(F.when(F.col("hot").isNull(), F.struct("tok", "w"))).alias("other"))
    held = held.select(*DOC_COLUMNS, "common", F.explode("other").alias("x")).select(*DOC_COLUMNS, "common", "x.tok", "x.w")
    other = q.filter("hot IS NULL").drop("hot").join(groups.select("query_id", F.map_from_entries("words").alias("words")), "query_id", "left")
    met = held.join(broadcast_if_small(stage(other), VOCABULARY), "tok").filter((F.col("q_user") == "") | (F.col("q_user") == F.col("user_id")))
    plus = F.aggregate("common", F.lit(0.0), lambda acc, x: acc + F.coalesce(F.try_element_at("words", x["tok"]) * x["w"], F.lit(0.0)))
    own = met.select("query_id", "uuid", "created_at", (F.col("qtf") * F.col("w")).alias("s"), plus.alias("plus"))
    own = own.groupBy("query_id", "uuid", "created_at").agg(as_score(F.sum("s") + F.max("plus")).alias("score"))
    own = _listed(own, limit).drop("rank")
    best = own.unionByName(by_group).groupBy("query_id", "uuid", "created_at").agg(F.max("score").alias("score"))
    return best.filter(F.col("score") >= min_score)


def once_per_text(queries: DataFrame, lists: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``lists(queries)``, where queries of the same user and text are asked once and share the list they get.

    A null and an empty user are the same.  Queries that share an id are one query to a search, so they are left as they are.
    """
    who = F.coalesce("user_id", F.lit(""))
    name = F.sha2(F.concat(F.octet_length(who).cast("string"), F.lit(":"), who, F.col("text")), 256)
    named = queries.filter(F.col("text").isNotNull()).select("query_id", who.alias("user_id"), "text", name.alias("asked"))
    n, ids, texts = named.agg(F.count("*"), F.count_distinct("query_id"), F.count_distinct("asked")).first()
    if ids < n or 2 * texts > n:
        return lists(queries)
    asked = named.groupBy(F.col("asked").alias("query_id")).agg(F.first("user_id").alias("user_id"), F.first("text").alias("text"))
    found = stage(lists(stage(asked)))
    columns = [c for c in found.columns if c != "query_id"]
    # Few lists go to those who asked; of many, adaptive execution splits a text that very many asked.
    return named.select("query_id", "asked").join(broadcast_if_small(found.withColumnRenamed("query_id", "asked")), "asked").select("query_id", *columns)


def search_parts(docs: DataFrame, part: str, queries: DataFrame, *, candidates=None, min_score: float = 0.01, limit: int = 10) -> DataFrame:
    """Top lists of every query in each part of a corpus: parts have statistics of their own, but are read and scored together.

    ``docs``: as of ``documents``, with the column ``part`` (a handful of values); ``candidates`` filters the written
    documents that are scored.  The queries' vocabulary must be small enough to be broadcast (``is_short``).
    """
    docs = stage(docs)
    posted = docs.select(part, F.size("tokens").cast("long").alias("dl"), F.explode(F.array_append(F.array_distinct("tokens"), F.lit(""))).alias("tok"))
    stats = stage(posted.groupBy(part, "tok").agg(F.count("*").alias("df"), F.sum("dl").alias("total_len")))
    totals = stats.filter("tok = ''").select(part, F.col("df").alias("n"), F.try_divide("total_len", "df").alias("avgdl"))  # a row for each part
    idf = F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)
    raw = stats.filter("tok <> ''").join(F.broadcast(totals), part).select(part, "tok", "avgdl", idf.alias("idf"))
    mean = raw.groupBy(part).agg(F.avg("idf").alias("mean"))
    q = _query_tokens(queries)
    weights = raw.join(F.broadcast(q.select("tok").distinct()), "tok", "left_semi").join(F.broadcast(mean), part)
    weights = weights.select(part, "tok", "avgdl", F.when(F.col("idf") < 0, F.col("mean") * EPSILON).otherwise(F.col("idf")).alias("idf"))
    scored = docs if candidates is None else candidates(docs)
    keys = [part, *DOC_COLUMNS, "dl", "tok", "idf", "avgdl"]
    hits = scored.select(part, *DOC_COLUMNS, F.size("tokens").alias("dl"), F.explode("tokens").alias("tok")).join(F.broadcast(weights), [part, "tok"])
    tf = hits.repartition("uuid").groupBy(*keys).agg(F.count("*").alias("tf"))
    norm = F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl"))
    tf = tf.select(part, *DOC_COLUMNS, "tok", (F.col("idf") * F.col("tf") * (K1 + 1) / norm).alias("w"))
    paired = tf.join(F.broadcast(q), "tok").filter((F.col("q_user") == "") | (F.col("q_user") == F.col("user_id")))
    found = paired.groupBy("query_id", part, "uuid", "created_at").agg(as_score(F.sum(F.col("qtf") * F.col("w"))).alias("score"))
    return top_per_group(found.filter(F.col("score") >= min_score), ["query_id", part], [F.desc("score"), F.desc_nulls_last("created_at"), "uuid"], limit)


def _query_tokens(queries: DataFrame) -> DataFrame:
    q = queries.select("query_id", F.coalesce("user_id", F.lit("")).alias("q_user"), F.explode(tokenize(F.col("text"))).alias("tok"))
    return q.groupBy("query_id", "q_user", "tok").agg(F.count("*").alias("qtf"))


def is_short(queries: DataFrame) -> bool:
    """Whether the queries' words are few enough to go to every task."""
    return _query_tokens(queries).limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
