"""Token counts, prefixes and ids against the libraries themselves."""

import hashlib
from array import array

import numpy as np
import public_tokenizers
import pytest

from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from palimpsest.llm import monoid_bpe, prefix_counts, pretokens

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
LIBRARY = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
TIKTOKEN, _ = pretokens.encoding(RANKS, public_tokenizers.PATTERN)
ODD = st.text(alphabet=st.sampled_from(list("aabeslltvrdm''  \n\t\r.,!<|>19éüñ中ｂ²Ⅷ 　́\x1c\x85😀_")), max_size=60)
SPECIALS = st.lists(st.one_of(ODD, st.sampled_from(["<|endoftext|>", "<|endof", "it's", "we'll", "  \n  x"])), max_size=6).map("".join)
CASES = ["", " ", "  ", "\n\n b", "don't we've 'sun ''s 'r 're're", "a" * 3000, " " * 500 + "x", "x<|endoftext|> y", "!<|endoftext|><|endoftext|>",
         "  <|endoftext|>  z", "'l", "naïve café 東京 ñjaosñ", "thndones erwhtion " * 50, "'''re", " 's 't", "\r\n \r\n x"]


def n_library(text):
    return len(LIBRARY.encode(text, add_special_tokens=False).ids)


@given(ODD)
@settings(max_examples=400, deadline=None)
def test_pieces_are_the_patterns(text):
    data = np.frombuffer(text.encode(), np.uint8)
    points, offsets = pretokens.code_points(data, np.array([0, len(data)]))
    starts = [*pretokens.piece_starts(points, offsets).tolist(), len(text)]
    assert [text[a:b] for a, b in zip(starts, starts[1:])] == pretokens.compiled(public_tokenizers.PATTERN).findall(text)


@given(SPECIALS)
@settings(max_examples=300, deadline=None)
def test_every_prefix_is_counted(text):
    counts = prefix_counts.prefixes(RANKS).of_text(text)
    assert counts == [n_library(text[:i]) for i in range(1, len(text) + 1)]


@given(ODD, st.integers(1, 7))
@settings(max_examples=400, deadline=None)
def test_tree_gives_the_librarys_ids(text, leaf):
    tree = monoid_bpe.TreeCoder(RANKS, public_tokenizers.PATTERN)
    old = monoid_bpe.LEAF_CHARS
    monoid_bpe.LEAF_CHARS = leaf
    try:
        ids = array("I", tree.encode(text))
        assert ids.tolist() == TIKTOKEN.encode_ordinary(text)
        assert tree.decode(ids) == text.encode()
    finally:
        monoid_bpe.LEAF_CHARS = old


@pytest.mark.parametrize("text", ["ab" * 5000, "the" * 3001 + "xq" * 2000, "é" * 4000, "aAbB" * 1000 + " " * 3000 + "\n" * 2999 + "!?" * 3000])
def test_long_pieces(text):
    tree = monoid_bpe.TreeCoder(RANKS, public_tokenizers.PATTERN)
    assert array("I", tree.encode(text)).tolist() == TIKTOKEN.encode_ordinary(text)
    assert prefix_counts.prefixes(RANKS).of_text(text)[-1] == n_library(text)


DOCS = "doc_id long, text string, n_tokens int, counts string"


def test_queries_on_odd_rows(spark):
    rows = [(i, t, i, "clash") for i, t in enumerate(CASES)] + [(None, None, 0, ""), (99, "again", 0, ""), (99, "again", 0, "")]
    docs = spark.createDataFrame(rows, DOCS).repartition(3)
    got = prefix_counts.prefix_counts(docs, limit=5, keep_table=True)
    texts = lambda t: t or ""
    want = sorted((str(i), len(texts(t).encode()), n_library(texts(t)), n_library(texts(t)) > 5) for i, t, *_ in rows)
    assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens, r.over_limit) for r in got.collect()) == want
    from pyspark.sql import functions as F
    got = got.filter("n_bytes < 100").withColumn("at", prefix_counts.tokens_at(F.col("counts"), F.lit(4)))
    got = got.withColumn("fit2", prefix_counts.longest_within(F.col("counts"), F.lit(5)))
    by_id = {i: t for i, t, *_ in rows if i is not None}
    for r in got.collect():
        text = texts(by_id.get(r.doc_id))
        assert r.fit_chars == r.fit2 == max([0, *(i for i in range(1, len(text) + 1) if n_library(text[:i]) <= 5)])
        assert r["at"] == n_library(text[:4])
    coded = monoid_bpe.encode_texts(docs, ids=True).collect()
    assert len(coded) == len(rows)
    for r in coded:
        ids = TIKTOKEN.encode_ordinary(texts(r.text))
        assert r._ids == ids and r._n_tokens == len(ids)
        assert r._ids_sha256 == hashlib.sha256(array("I", ids).tobytes()).hexdigest()
        assert r._decoded_sha256 == hashlib.sha256(texts(r.text).encode()).hexdigest()
    assert prefix_counts.prefix_counts(docs.limit(0)).collect() == monoid_bpe.encode_texts(docs.limit(0)).collect() == []


def test_queries_on_documents(spark):
    sf = "/root/testdata/sf0.001"
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = {r.doc_id: r for r in prefix_counts.op3_prefix_counts(spark, sf).collect()}
    ids = {r.doc_id: r for r in monoid_bpe.op6_monoid_bpe(spark, sf).collect()}
    assert got.keys() == ids.keys() == docs.keys()
    for i, text in docs.items():
        assert (got[i].n_tokens, got[i].n_bytes) == (n_library(text), len(text.encode()))
        assert ids[i].ids_sha256 == hashlib.sha256(array("I", TIKTOKEN.encode_ordinary(text)).tobytes()).hexdigest()
        assert ids[i].decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
        assert got[i].fit_chars == len(text) or n_library(text[:got[i].fit_chars]) <= 1024
