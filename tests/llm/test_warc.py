import base64
import glob
import gzip
import hashlib

import pytest
from pyspark.sql import functions as F

from playframe.llm import warc as W
from playframe.llm.common import Scratch, qualified


def digest(t):
    return base64.b32encode(hashlib.sha1((t or "").encode()).digest()).decode()


def brute(rows, least=0):
    first = {}
    for i, _, t in rows:
        if i is not None:
            first[t or ""] = max(i, first.get(t or "", i))
    out = []
    for i, _, t in rows:
        size = len((t or "").encode())
        to = first.get(t or "") if sum((x[2] or "") == (t or "") for x in rows) > 1 and size >= least else None
        revisit = to is not None and i != to
        out.append((i, size, digest(t), "revisit" if revisit else "response", to if revisit else None))
    return sorted(out, key=str)


def taken(df):
    return sorted((tuple(r) for r in df.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()), key=str)


ROWS = [(1, "http://a/1", "same"), (2, "http://a/2", "same"), (9, "http://a/9", "same"), (3, None, None), (4, "u", ""), (5, "u", "é😀\r\n\r\n\x00"),
        (6, "u", "big " * 300000), (7, "x y", "WARC/1.1\r\n\r\n"), (None, "u", "same"), (None, "u", "alone"), (8, "v", "other"), (8, "v", "other")]


@pytest.mark.parametrize("least", [0, 5, 1 << 40])
def test_round_trip(spark, least):
    pages = spark.createDataFrame(ROWS, "page_id long, url string, html string").withColumn("digest", F.lit(1))
    out = W.round_trip(pages, W.Warc(least_payload=least, archive_bytes=200, gap=10, run=500, range_bytes=1000)).cache()
    assert taken(out) == brute(ROWS, least)
    texts = {(i, digest(t)): t or "" for i, _, t in ROWS}
    for r in out.collect():
        if r["record_type"] == "response":
            assert r["payload"] == texts[r["page_id"], r["payload_digest"]]
        else:
            assert r["payload"] is None
    assert W.round_trip(pages.limit(0)).count() == 0


def test_sample_pages(spark, sf, rows):
    got = taken(W.round_trip(spark.read.parquet(f"{sf}/pages.parquet")))
    assert got == brute([(r["page_id"], r["url"], r["html"]) for r in rows("pages")])


def test_archives_are_warc_and_reads_are_selective(spark, tmp_path):
    pages = spark.createDataFrame([(i, f"http://x/{i}", f"<p>{i}</p>" * 50) for i in range(200)], "page_id long, url string, html string")
    folder, scratch = str(tmp_path / "w"), Scratch(spark, "warc-test")
    index = W.write(pages, folder, scratch)
    files = glob.glob(f"{folder}/*.warc.gz")
    raw = {f.rsplit("/", 1)[1]: open(f, "rb").read() for f in files}
    assert sum(gzip.decompress(x).count(b"WARC/1.1\r\n") for x in raw.values()) == 200
    for r in index.collect():
        one = gzip.decompress(raw[r["file"]][r["offset"]:r["offset"] + r["length"]])
        assert one.startswith(b"WARC/1.1\r\n") and one.endswith(b"\r\n\r\n") and r["url"].encode() in one and r["digest"].encode() in one
    some = W.read(index.filter(F.col("url").isin("http://x/7", "http://x/150")), folder).collect()
    assert sorted(r["page_id"] for r in some) == [7, 150]


def test_reads_are_coalesced():
    opt = W.Warc(gap=10, run=100)
    assert W.ranges([(0, 10), (10, 10), (29, 5), (60, 10), (200, 500)], opt) == [(0, 3, 0, 34), (3, 4, 60, 70), (4, 5, 200, 700)]
    assert W.ranges([(0, 60), (60, 60)], opt) == [(0, 1, 0, 60), (1, 2, 60, 120)]
    assert W.ranges([], opt) == []


def test_a_broken_record_is_an_error():
    raw = W.record(1, "u", b"abc", digest("abc"), None, 3)
    assert W.parse(raw)["payload"] == b"abc"
    with pytest.raises(ValueError):
        W.parse(raw[:-1])
    with pytest.raises(ValueError):
        W._records(gzip.compress(raw.replace(b"abc", b"abd")), 0, [(0, 10_000)])


def test_base32_digest(spark):
    texts = ["", "a", "é", "x" * 1000]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(W.base32_sha1(F.col("t")))
    assert [r[0] for r in df.collect()] == [digest(t) for t in texts]


def test_null_and_empty_urls_are_told_apart(spark):
    pages = spark.createDataFrame([(1, None, "a"), (2, "", "b"), (3, "u\nv", "c")], "page_id long, url string, html string")
    assert {r["page_id"]: r["url"] for r in W.round_trip(pages).collect()} == {1: None, 2: "", 3: "u%0Av"}


def test_folders_without_a_scheme_are_on_the_default_file_system(spark, tmp_path):
    assert qualified(spark, str(tmp_path)) == f"file:{tmp_path}"
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    before = conf.get("fs.defaultFS")
    conf.set("fs.viewfs.mounttable.shared.link./data", f"file:{tmp_path}")
    conf.set("fs.defaultFS", "viewfs://shared/")
    try:
        assert qualified(spark, "/data/w") == "viewfs://shared/data/w"
    finally:
        conf.set("fs.defaultFS", before)
