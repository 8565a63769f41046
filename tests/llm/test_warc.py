import hashlib

import pytest
from helpers import write_tables
from pyspark.sql import functions as F

from plinth.llm.warc import op3_warc, plan_revisits, read_chunks, read_records, write_warc

MARK = "\r\n\r\nWARC/1.0\r\n"
BIG = "".join(f"{i}é" for i in range(40_000))
PAGES = [
    (1, "http://a", "x" * 99), (2, "http://a", "x" * 99), (3, "http://b", "y" * 100), (4, None, "y" * 100), (5, "http://c\r\nd", "y" * 100), (6, "http://d", None), (7, "http://e", ""), (8, "", MARK * 60), (9, "u", BIG), (10, "u", BIG),
    (11, "u", "WARC/1.0\r\n" * 30), (12, "u", "\r\n\r\n" * 50), (None, "u", "y" * 100), (3, "http://b", "y" * 100), (13, "u", "a" * 50 + MARK + "b" * 80), (14, "u", BIG + MARK), (15, "u", "\r\nWARC"),
]


def brute(pages):
    texts = [(p, (h or "").encode()) for p, _, h in pages]
    out = []
    for p, t in texts:
        ids = [q for q, u in texts if u == t and q is not None] if len(t) >= 100 else []
        refers = min(ids) if ids and p != min(ids) else None
        out.append((p, len(t), hashlib.sha256(t).hexdigest(), "response" if refers is None else "revisit", refers))
    return sorted(out, key=repr)


def test_query(spark, tmp_path):
    path = write_tables(tmp_path, pages=spark.createDataFrame([(*p, 1) for p in PAGES], "page_id long, url string, html string, digest int"))
    assert sorted(map(tuple, op3_warc(spark, path).collect()), key=repr) == brute(PAGES)


@pytest.mark.parametrize("chunk_bytes", [7, 64, 1000])
def test_chunks_give_whole_payloads_back(spark, tmp_path, chunk_bytes):
    pages = [(p, u, h) for p, u, h in PAGES if h is None or len(h) < 5000]
    frame = spark.createDataFrame(pages, "page_id long, url string, html string").select("page_id", "url", F.coalesce("html", F.lit("")).cast("binary").alias("payload"))
    write_warc(plan_revisits(frame), f"{tmp_path}/warc", chunk_bytes=chunk_bytes)
    chunks = read_chunks(spark, f"{tmp_path}/warc")
    assert sorted(map(tuple, read_records(chunks).collect()), key=repr) == brute(pages)
    assert chunks.agg(F.max(F.octet_length("bytes"))).first()[0] <= chunk_bytes


def test_a_lost_chunk_is_an_error(spark, tmp_path):
    frame = spark.createDataFrame([(1, "u", "z" * 500)], "page_id long, url string, html string").select("page_id", "url", F.col("html").cast("binary").alias("payload"))
    write_warc(plan_revisits(frame), f"{tmp_path}/warc", chunk_bytes=100)
    chunks = read_chunks(spark, f"{tmp_path}/warc")
    for lost in (2, 5):
        with pytest.raises(Exception, match="chunk"):
            read_records(chunks.where(F.col("chunk") != lost)).collect()


def test_empty_table(spark, tmp_path):
    path = write_tables(tmp_path, pages=spark.createDataFrame([], "page_id long, url string, html string"))
    assert op3_warc(spark, path).count() == 0


@pytest.mark.parametrize("chunk_bytes", [16, 100, 1 << 16])
def test_payloads_that_end_like_a_separator(spark, tmp_path, chunk_bytes):
    end = MARK[:-2]
    texts = [end, end[2:], end[4:], "a" + end, "a" + end[2:], "\r\n" + end, end + end, end[4:] * 2, "b" * 88 + end, "b" * 88 + end + "c" * 30, "b" * 88 + end + "\r", "b" * 88 + end + "\r\n", "b" * (88 + 4) + end[4:] + "\r\nc"]
    pages = [(i, "u", x) for i, x in enumerate(texts)]
    frame = spark.createDataFrame(pages, "page_id long, url string, html string").select("page_id", "url", F.col("html").cast("binary").alias("payload"))
    write_warc(plan_revisits(frame).coalesce(1), f"{tmp_path}/warc", chunk_bytes=chunk_bytes)  # one part, so that a record follows each
    chunks = read_chunks(spark, f"{tmp_path}/warc")
    assert sorted(map(tuple, read_records(chunks).collect()), key=repr) == brute(pages)
    assert (chunks.agg(F.max(F.octet_length("bytes"))).first()[0] or 0) <= chunk_bytes


def test_revisits_name_a_record(spark, tmp_path):
    pages = [(1, "u", BIG), (2, "v", BIG), (2, "v", BIG), (3, "w", "y" * 200), (4, "w", "y" * 200)]
    frame = spark.createDataFrame(pages, "page_id long, url string, html string").select("page_id", "url", F.col("html").cast("binary").alias("payload"))
    write_warc(plan_revisits(frame), f"{tmp_path}/warc")
    fields = [dict(x.split(": ", 1) for x in r[0].split("\r\n\r\n")[0].split("\r\n") if ": " in x) for r in spark.read.option("lineSep", MARK).text(f"{tmp_path}/warc").collect() if r[0]]
    responses = {f["WARC-Record-ID"] for f in fields if f["WARC-Type"] == "response"}
    revisits = [f["WARC-Refers-To"] for f in fields if f["WARC-Type"] == "revisit"]
    assert len(revisits) == 3 and set(revisits) == responses
