"""Archives and shards against plain Python, with nulls, ties, blank lines, repeated and missing rows."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from palimpsest.llm import sharding, warc

PAGES = "page_id long, url string, html string, digest string"


def pages(spark, rows):
    return spark.createDataFrame(rows, PAGES)


def through(spark, df):
    first, second = warc.fresh_folder(spark), warc.fresh_folder(spark)
    warc.write_archives(warc.page_records(df), first)
    warc.write_archives(warc.resolve_revisits(warc.read_archives(spark, first)), second)
    return warc.follow_revisits(warc.read_archives(spark, second)).collect(), warc.read_archives(spark, second).collect()


def test_archives_round_trip(spark):
    long = "x" * 120
    texts = ["", None, "a\r\n\r\nb", "ends\r\n", "ends\r\n\r\n", "\r\n\r\n", "\r\n", "ü" * 60, long, long, "WARC/1.1\r\n\r\n" * 20,
             "y" * 3_000_000, "short", "short", "a\n\n\r\n\r\n\r\n\r\nb\r\n\r\n\r\n"]
    rows = [(i, None if i == 3 else f"http://x/{i}\r\nX: y", t, "clash") for i, t in enumerate(texts)]
    rows += [(None, "u", long, ""), (8, "http://x/8", long, ""), (9, "u9", long, "")]
    out, records = through(spark, pages(spark, rows))
    assert len(out) == len(rows)
    want = sorted((str(p), len((t or "").encode()), hashlib.sha256((t or "").encode()).hexdigest()) for p, _, t, _ in rows)
    assert sorted((str(r.page_id), r.payload_bytes, r.payload_digest) for r in out) == want
    again = sorted((str(r.page_id), r.refers_to) for r in out if r.record_type == "revisit")
    assert again == [("8", 8), ("9", 8), ("9", 8), ("None", 8)]
    assert len({r.record_id for r in records}) == len(rows)
    assert all(r.payload_bytes == 0 and r.digest == hashlib.sha256(long.encode()).hexdigest() for r in records if r.record_type == "revisit")


def test_archives_without_rows(spark):
    assert through(spark, pages(spark, []))[0] == []


def test_originals_are_joined_by_shuffle_beyond_the_bound(spark, monkeypatch):
    rows = [(i, "u", "same " * 30 if i % 3 else f"own {i} " * 20, "") for i in range(60)]
    few = sorted(map(str, through(spark, pages(spark, rows))[0]))
    monkeypatch.setattr(warc, "BROADCAST_ROWS", 0)
    assert sorted(map(str, through(spark, pages(spark, rows))[0])) == few


DOCS = "doc_id long, text string, shard string, size int"


@pytest.mark.parametrize("rows", [
    [],
    [(1, None, "a", 1)],
    [(i % 50, "same text", "a", 1) for i in range(300)] + [(None, "", "b", 2), (7, "z" * 5000, None, None), (7, "z" * 5000, None, None)],
    [(i, "é" * (i % 17), "a", 1) for i in range(500)],
])
def test_shards(spark, rows):
    got = sharding.sharded_documents(spark.createDataFrame(rows, DOCS), 7).collect()
    order = sorted(rows, key=lambda r: (hashlib.md5((r[1] or "").encode()).hexdigest(), r[0] is not None, r[0] or 0))
    sizes = [len((r[1] or "").encode()) + 16 for r in order]
    total, at, want, slots = sum(sizes), 0, [], {}
    for r, s in zip(order, sizes):
        shard = min(6, (2 * at + s) * 7 // (2 * total))
        slots[shard] = slots.get(shard, -1) + 1
        want.append((r[0], s, zlib.crc32((r[1] or "").encode()), shard, slots[shard]))
        at += s
    assert sorted((str(r.doc_id), r["size"], r.text_crc32, r.shard, r.slot) for r in got) == sorted((str(w[0]), *w[1:]) for w in want)


def test_shards_of_size_nought(spark):
    rows = spark.range(5).withColumn("size", F.lit(0).cast("long"))
    assert [r.shard for r in sharding.contiguous_shards(rows, "size", ["id"], 3).collect()] == [0] * 5
