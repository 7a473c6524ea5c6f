"""WARC archives: one request, response (or revisit) and metadata record per page, and back.

Writing: pages with an equal payload share one response; the others become revisit records
that refer to it.  Records are the lines of a text file whose line end is the blank line that
closes a WARC record, so Spark's own text writer makes gzipped archives with its commit
protocol.  Reading inflates all gzip members of a file (others write one for each record), parses
records by Content-Length as they come, and joins the records of a capture through
WARC-Concurrent-To.

Scale: payloads are shuffled once, by page (no key is hot); the choice of responses and the
assembly move only identifiers and digests.  A written file has at most ``PER_FILE`` records.
Of a file that is read, the packed bytes and one record are held.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import chunks, fresh, prepare, settle

PER_FILE = 15_000
DATE = "2024-01-01T00:00:00Z"
_SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # fixed value: the URL name space


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _digests(batches):
    for b in chunks(batches, "html"):
        load = [(x or "").encode() for x in b.column("html").to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column("page_id"), pa.array([digest(x) for x in load]), pa.array([len(x) for x in load], pa.int64())], names=["page_id", "digest", "size"])


def _id(page, sha: str, kind: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(_SPACE, f'{page}/{sha}/{kind}')}>"


def _record(kind: str, rid: str, uri: str, block: str, type_: str, **more) -> str:
    head = {"WARC-Type": kind, "WARC-Record-ID": rid, "WARC-Date": DATE, "WARC-Target-URI": uri, **{k.replace("_", "-"): v for k, v in more.items() if v is not None}, "Content-Type": type_, "Content-Length": len(block.encode())}
    return "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items()) + "\r\n" + block


def _records(batches):
    for b in chunks(batches, "html"):
        out = []
        for page, url, html, sha, size, first in zip(*(b.column(c).to_pylist() for c in ("page_id", "url", "html", "digest", "size", "first"))):
            uri = quote(url, safe="%/:=&?~#+!$,;'@()*[]") if url else "urn:page:unknown"
            rid = _id(page, sha, "response")
            http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n"
            more = {"WARC_Payload_Digest": f"sha1:{sha}"}
            if first is None or first == page:
                out.append(_record("response", rid, uri, http + (html or ""), "application/http;msgtype=response", **more))
            else:
                out.append(_record("revisit", rid, uri, http, "application/http;msgtype=response", WARC_Profile="http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", WARC_Refers_To=_id(first, sha, "response"), **more))
            host, _, path = uri.split("://", 1)[-1].partition("/")
            out.append(_record("request", _id(page, sha, "request"), uri, f"GET /{path} HTTP/1.1\r\nHost: {host}\r\n\r\n", "application/http;msgtype=request", WARC_Concurrent_To=rid))
            note = "" if page is None else f"page-id: {page}\r\n"
            out.append(_record("metadata", _id(page, sha, "metadata"), uri, note, "application/warc-fields", WARC_Concurrent_To=rid))
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], names=["value"])


def write_archives(pages: DataFrame, path: str, least: int = 0) -> None:
    """Archives of ``pages`` (page_id, url, html; null html is an empty payload) under ``path``.

    Of pages with equal payloads of at least ``least`` bytes, the one with the largest page_id
    is the response.  Rows that repeat both are written each.  Without a page_id a page
    revisits its copies' response, or is one.
    """
    n = F.col
    pages = pages.select(n("page_id").cast("long").alias("page_id"), n("url").cast("string").alias("url"), n("html").cast("string").alias("html"))
    sums = settle(pages.select("page_id", "html").mapInArrow(_digests, "page_id long, digest string, size long"), "digests")
    first = settle(sums.where(n("size") >= least).groupBy("digest", "size").agg(F.max("page_id").alias("first")), "responses")
    choice = sums.dropDuplicates().join(first, ["digest", "size"], "left").withColumnRenamed("page_id", "pid")
    # sha1 of the text joins a row with its own digest where a page_id repeats
    hexed = F.sha1(F.coalesce("html", F.lit("")).cast("binary"))
    left = pages.withColumn("hex", hexed)
    choice = settle(choice.mapInArrow(_hexed, "pid long, digest string, size long, first long, code string"), "choice")
    both = left.join(choice, n("page_id").eqNullSafe(n("pid")) & (n("hex") == n("code")))
    lines = both.select("page_id", "url", "html", "digest", "size", "first").mapInArrow(_records, "value string")
    lines.write.option("compression", "gzip").option("lineSep", "\r\n\r\n").option("maxRecordsPerFile", PER_FILE).text(path)


def _hexed(batches):
    for b in batches:
        code = [base64.b32decode(x).hex() for x in b.column("digest").to_pylist()]
        yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("pid", "digest", "size", "first")), pa.array(code, pa.string())], names=["pid", "digest", "size", "first", "code"])


def inflated(raw, step: int = 1 << 20):
    """Plain bytes, piece by piece, of all gzip or zlib members of ``raw`` (one for each record, or
    one for many); zero bytes after a member are padding."""
    raw, at = memoryview(raw), 0
    while at < len(raw):
        member = zlib.decompressobj(47)
        while not member.eof:
            # what a call has not used yet comes first
            data = member.unconsumed_tail
            if not data:
                data = raw[at : at + step]
                at += len(data)
            out = member.decompress(data, step)
            if out:
                yield out
            elif not len(data):
                raise ValueError("the last gzip member is cut short")
        at -= len(member.unused_data)
        while at < len(raw) and raw[at] == 0:
            at += 1


def parse(pieces):
    """(headers with lower-case names, block) of every record of ``pieces``, bytes that come one after
    another (or all at once).  Only the record that is being read is held."""
    pieces = iter([pieces] if isinstance(pieces, (bytes, bytearray)) else pieces)
    held, at, done = bytearray(), 0, 0

    def more() -> bool:
        nonlocal at, done
        piece = next(pieces, None)
        if piece is None:
            return False
        del held[:at]
        done, at = done + at, 0
        held.extend(piece)
        return True

    while True:
        # blank lines end a record
        while True:
            while at < len(held) and held[at] in b"\r\n":
                at += 1
            if at < len(held):
                break
            if not more():
                return
        begun = 0
        while (end := held.find(b"\r\n\r\n", at + begun)) < 0:
            begun = max(0, len(held) - at - 3)
            if not more():
                raise ValueError(f"headers at byte {done + at} have no end")
        lines = held[at:end].decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no record at byte {done + at}")
        head = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        size, top = int(head["content-length"]), end + 4 - at
        while len(held) < at + top + size:
            if not more():
                raise ValueError(f"the record at byte {done + at} is cut short")
        yield head, bytes(held[at + top : at + top + size])
        at += top + size


SHAPE = "warc_type string, record_id string, target_uri string, concurrent_to string, refers_to string, payload_digest string, payload_bytes long, fields map<string,string>, payload binary"


def _read(payloads: bool):
    def run(batches):
        for b in batches:
            for content in b.column("content"):
                raw = content.as_buffer()
                cols: list[list] = [[] for _ in range(9)]
                held = 0
                for head, block in parse(inflated(raw)):
                    kind = head["warc-type"]
                    sha, size, fields, load = head.get("warc-payload-digest", "").removeprefix("sha1:") or None, None, None, None
                    if kind in ("response", "revisit"):
                        top, _, load = block.partition(b"\r\n\r\n")
                        if kind == "response":
                            size, sha = len(load), digest(load)
                        else:
                            size = next((int(x.split(b":")[1]) for x in top.split(b"\r\n") if x.lower().startswith(b"content-length:")), None)
                            load = None
                    else:
                        fields = [(k.strip(), v.strip()) for k, s, v in (x.partition(":") for x in block.decode(errors="replace").split("\r\n")) if s]
                    row = [kind, head["warc-record-id"], head.get("warc-target-uri"), head.get("warc-concurrent-to"), head.get("warc-refers-to"), sha, size, fields, load if payloads else None]
                    for c, x in zip(cols, row):
                        c.append(x)
                    held += len(block)
                    if held > 4 << 20:
                        yield _batch(cols)
                        cols, held = [[] for _ in range(9)], 0
                if cols[0]:
                    yield _batch(cols)

    return run


def _batch(cols) -> pa.RecordBatch:
    kinds = [pa.string()] * 6 + [pa.int64(), pa.map_(pa.string(), pa.string()), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=[x.split()[0] for x in SHAPE.split(", ")])


def read_archives(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """One row a record."""
    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(_read(payloads), SHAPE)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row a capture: its response or revisit, with the request and metadata that
    name it in WARC-Concurrent-To, and for a revisit the capture that it refers to."""
    n = F.col
    main = records.where(n("warc_type").isin("response", "revisit"))
    part = lambda kind: records.where((n("warc_type") == kind) & n("concurrent_to").isNotNull()).dropDuplicates(["concurrent_to"]).select(n("concurrent_to").alias("record_id"), F.struct(n("record_id").alias("id"), "target_uri", "fields").alias(kind))
    out = main.join(part("request"), "record_id", "left").join(part("metadata"), "record_id", "left")
    page = n("metadata.fields")["page-id"].cast("long")
    return out.select(
        "record_id", page.alias("page_id"), n("target_uri"),
        F.struct("warc_type", "payload_digest", "payload_bytes", "payload", "refers_to").alias("response"), "request", "metadata",
    )


def captures(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """Assembled captures of the archives under ``path``, with ``refers_to_page``."""
    n = F.col
    whole = settle(assemble(settle(read_archives(spark, path, payloads), "records")), "captures")
    index = settle(whole.where(n("response.warc_type") == "response").dropDuplicates(["record_id"]).select(n("record_id").alias("to"), n("page_id").alias("refers_to_page")), "index")
    return whole.withColumn("to", n("response.refers_to")).join(index, "to", "left").drop("to")


def round_trip(pages: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of pages written and read back."""
    spark, n = prepare(pages.sparkSession), F.col
    path = fresh(spark, "warc")
    write_archives(pages, path)
    c = captures(spark, path, payloads=False)
    return c.select("page_id", n("response.payload_bytes").alias("payload_bytes"), n("response.payload_digest").alias("payload_digest"), n("response.warc_type").alias("record_type"), n("refers_to_page").alias("refers_to"))
