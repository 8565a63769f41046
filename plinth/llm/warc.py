"""WARC archives as chunked record tables.

A payload over chunk_bytes is written as segments of the WARC standard: a first record and `continuation` records that
carry its record identifier and a segment number. Nothing but one segment is ever a row, on the way out or back in.
Reading gives the chunk table (record, chunk, bytes); chunks are sorted by record and chunk number, and a digest is
carried from chunk to chunk, across batches, so no task holds a whole oversized record.

Archives are written and read by Spark's text source with the record separator as line separator. A payload
that holds the separator's own bytes, or ends so that the blank line after it completes them, is cut inside them, so they never show within a segment; a record whose length
disagrees with its Content-Length raises an error instead of being dropped. Part files are gzip-compressed whole.

Of pages with equal payloads of at least REVISIT_BYTES bytes, those with the smallest page_id are responses and the others revisit it.

Cases: a null payload is empty; null page ids are kept, and are revisits of any equal page with an id; rows with equal ids and
payloads are responses, all of them, if theirs is the smallest id. CR and LF in URLs become spaces. An empty table makes an archive without records.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_dir, table

CHUNK_BYTES, REVISIT_BYTES = 64 << 10, 100
_MAGIC, _END = b"WARC/1.0\r\n", b"\r\n\r\n"
_MARKER = _END + _MAGIC
CHUNKS = "record string, chunk int, last boolean, type string, page_id long, refers_to long, digest string, n_bytes long, own_digest string, bytes binary"


def plan_revisits(pages: DataFrame) -> DataFrame:
    """pages (page_id, url, payload binary) with digest, n_bytes, type and refers_to."""
    digested = pages.withColumn("digest", F.sha2("payload", 256)).withColumn("n_bytes", F.octet_length("payload").cast("long"))
    groups = digested.where(F.col("n_bytes") >= REVISIT_BYTES).groupBy("digest").agg(F.min("page_id").alias("response"), F.count("*").alias("n")).where("n > 1").drop("n")
    again = F.col("response").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("response"))
    joined = digested.join(groups, "digest", "left")
    return joined.withColumn("type", F.when(again, "revisit").otherwise("response")).withColumn("refers_to", F.when(again, F.col("response"))).drop("response")


def _cuts(payload: memoryview, chunk_bytes: int):
    """Chunks of at most chunk_bytes that neither hold the separator nor complete it with the blank lines before and after them. Only a chunk is ever copied."""
    at = 0
    while True:
        piece = bytes(payload[at : at + chunk_bytes])
        found = (_END + piece + _END).find(_MARKER)
        if found >= 0:
            piece = piece[: found + 4]  # WARC/1.0 starts at piece[found]
        at += len(piece)
        yield piece, at == len(payload)
        if at == len(payload):
            return


def _record(page: int | None, digest: str) -> str:
    """The identifier of a page's record: that of a revisit's response follows from the revisit's own digest. Only rows equal in id and payload share one."""
    return f"urn:page:{page}:{digest[:32]}"


def write_warc(planned: DataFrame, path: str, date: str = "1970-01-01T00:00:00Z", chunk_bytes: int = CHUNK_BYTES) -> None:
    """planned: page_id, url, payload, digest, n_bytes, type, refers_to."""

    def run(batches):
        out: list[bytes] = []
        size = 0

        def flush():
            nonlocal out, size
            made = pa.RecordBatch.from_arrays([pa.array(out, pa.binary()).view(pa.string())], ["value"])  # payloads need not be valid UTF-8
            out, size = [], 0
            return made

        for batch in batches:
            columns = [batch.column(x) for x in ("page_id", "url", "payload", "digest", "n_bytes", "type", "refers_to")]
            for i in range(batch.num_rows):
                page, url, payload, digest, n_bytes, kind, refers = (c[i].as_buffer() if c is columns[2] else c[i].as_py() for c in columns)
                record = _record(page, digest)
                http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n_bytes}\r\n\r\n".encode()
                pieces = [(b"", True)] if kind == "revisit" else _cuts(memoryview(payload), chunk_bytes)
                for number, (piece, last) in enumerate(pieces, 1):
                    head = [("WARC-Type", kind if number == 1 else "continuation"), ("WARC-Date", date), ("WARC-Target-URI", " ".join((url or "").split()) or "urn:none")]
                    head += [("WARC-Record-ID", f"<{record}>" if number == 1 else f"<{record};segment={number}>"), ("Content-Type", "application/http; msgtype=response")]
                    if number == 1:
                        head += [("WARC-Payload-Digest", f"sha256:{digest}"), *([] if page is None else [("WARC-Page", str(page))])]
                    if kind == "revisit":
                        head += [("WARC-Profile", "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"), ("WARC-Refers-To", f"<{_record(refers, digest)}>")]
                    if number > 1 or not last:
                        head += [("WARC-Segment-Number", str(number)), *([("WARC-Segment-Origin-ID", f"<{record}>")] if number > 1 else []), *([("WARC-Segment-Total-Length", str(n_bytes + len(http)))] if last else [])]
                    block = http + piece if number == 1 else piece
                    head += [("Content-Length", str(len(block)))]
                    out.append(_MAGIC + "\r\n".join(f"{k}: {v}" for k, v in head).encode() + _END + block)
                    size += len(out[-1])
                    if size >= 4 << 20:
                        yield flush()
        if out:
            yield flush()

    planned.mapInArrow(run, "value string").write.option("lineSep", _END.decode()).option("compression", "gzip").text(path)


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    """The chunk table of an archive. A record of one chunk is digested on the spot and carries no bytes on."""

    def parse(raw: bytes):
        raw = raw[len(_MAGIC) :] if raw.startswith(_MAGIC) else raw
        head, _, block = raw.partition(_END)
        fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n"))
        length = int(fields["Content-Length"])
        if len(block) - length not in (0, len(_END)):
            raise ValueError(f"record {fields.get('WARC-Record-ID')}: {len(block)} bytes, Content-Length {length}")
        block = block[:length]
        number, total = int(fields.get("WARC-Segment-Number", 1)), None
        if fields["WARC-Type"] != "continuation":
            http, _, block = block.partition(_END)
            total = int(http.rpartition(b"Content-Length: ")[2].split(b"\r\n")[0])
        whole = "WARC-Segment-Number" not in fields
        record = fields.get("WARC-Segment-Origin-ID", fields["WARC-Record-ID"])
        page, refers = fields.get("WARC-Page"), fields.get("WARC-Refers-To")
        revisit = fields["WARC-Type"] == "revisit"
        digest = fields.get("WARC-Payload-Digest", "").removeprefix("sha256:")
        own = digest if revisit else hashlib.sha256(block).hexdigest() if whole else None
        last = whole or "WARC-Segment-Total-Length" in fields
        return record, number, last, fields["WARC-Type"], None if page is None else int(page), None if refers is None else int(refers.split(":")[2]), digest, total if revisit else len(block), own, None if whole else block

    def run(batches):
        kinds = (pa.string(), pa.int32(), pa.bool_(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.binary())
        names = [x.split()[0] for x in CHUNKS.split(", ")]
        for batch in batches:
            column = batch.column("value")
            for at in range(0, len(column), 1000):
                rows = [parse(x) for x in column.slice(at, 1000).to_pylist() if x]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return spark.read.option("lineSep", _MARKER.decode()).text(path).select(F.col("value").cast("binary").alias("value")).mapInArrow(run, CHUNKS)


def read_records(chunks: DataFrame) -> DataFrame:
    """One row per record: page_id, payload_bytes, payload_digest (both of what was read), record_type, refers_to."""

    def run(batches):
        digest, n, first, at, copies, again = None, 0, None, 0, 1, 1
        for batch in batches:
            out = []
            for row in zip(*(c.to_pylist() if c.type != pa.binary() else c for c in batch.columns), strict=True):
                record, number, last, kind, page, refers, told, n_bytes, own, piece = row
                count = 1
                if own is None:
                    inside = digest is not None and first[0] == record
                    if inside and number == at:  # the same chunk of an equal row
                        again += 1
                        copies = copies if number > 1 else again
                        if again > copies:
                            raise ValueError(f"record {record}: chunk {number} stands too often")
                    elif number != (at + 1 if inside else 1) or (digest is not None and not inside) or (inside and again != copies):
                        raise ValueError(f"record {record}: chunk {number} out of order")
                    else:
                        if number == 1:
                            digest, n, first, copies = hashlib.sha256(), 0, row, 1
                        digest.update(piece.as_buffer())
                        n, at, again = n + n_bytes, number, 1
                    if not last or again < copies:
                        continue
                    own, n_bytes, (_, _, _, kind, page, refers, told, *_), count = digest.hexdigest(), n, first, copies
                    digest = None
                if own != told:
                    raise ValueError(f"record {record}: its digest is {own}, its header says {told}")
                out += [(page, n_bytes, own, kind, refers)] * count
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()), strict=True)], ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])
        if digest is not None:
            raise ValueError(f"record {first[0]}: its last chunk is missing")

    ordered = chunks.repartition("record").sortWithinPartitions("record", "chunk")
    return ordered.mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("payload"))
    path = shared_dir(spark)
    write_warc(plan_revisits(pages), path)
    return read_records(read_chunks(spark, path))


ORACLE = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS payload FROM pages),
d AS (SELECT page_id, strlen(payload)::BIGINT AS payload_bytes, sha256(payload) AS payload_digest FROM p),
m AS (SELECT *, CASE WHEN payload_bytes >= {REVISIT_BYTES} THEN min(page_id) OVER (PARTITION BY payload_digest) END AS response FROM d)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN response IS NOT NULL AND page_id IS DISTINCT FROM response THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id IS DISTINCT FROM response THEN response END AS refers_to
FROM m
"""
