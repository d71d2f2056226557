"""WARC: records in monolithic gzip archives, normalised to one gzip member per record with an offset index."""

from __future__ import annotations

import hashlib
import io
import json
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, load

#: Records with shorter payloads are never revisits.
LEAST_PAYLOAD = 100
CHUNK = 1 << 20
#: Fixed values of the format.
VERSION, CRLF = b"WARC/1.1", b"\r\n"


def record(kind: str, name: str, place: str, url: str, payload: bytes, digest: str, size: int, refers_to: str | None) -> bytes:
    """One WARC record, with an id of its page and its place. A revisit has no payload; its headers tell digest and size of the full one."""
    body = b"" if kind == "revisit" else payload
    head = {
        "WARC-Type": kind, "WARC-Record-ID": f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{name} {place}')}>", "WARC-Date": "2020-01-01T00:00:00Z",
        "WARC-Target-URI": "".join(c if c.isprintable() else f"%{ord(c):02X}" for c in url), "WARC-Payload-Digest": f"sha256:{digest}", "X-Payload-Length": str(size), "X-Page-ID": name,
        "Content-Type": "text/html; charset=utf-8", "Content-Length": str(len(body)),
    }
    if kind == "revisit":
        head |= {"WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", "X-Refers-To-Page": str(refers_to)}
    lines = [VERSION, *(f"{k}: {v}".encode() for k, v in head.items()), b"", b""]
    return CRLF.join(lines) + body + CRLF + CRLF


def records(stream: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes, bytes]]:
    """Headers, body and raw bytes of each record of an inflated stream."""
    buffer = bytearray()
    ended = False

    def more() -> bool:
        nonlocal ended
        got = next(stream, None)
        if got is None:
            ended = True
            return False
        buffer.extend(got)
        return True

    while True:
        while (at := buffer.find(CRLF + CRLF)) < 0 and not ended:
            more()
        if at < 0:
            if buffer.strip():
                raise ValueError("the archive ends inside a record")
            return
        head = bytes(buffer[:at]).split(CRLF)
        if head[0] != VERSION:
            raise ValueError(f"no record starts with {bytes(head[0][:20])!r}")
        fields = dict(x.decode().split(": ", 1) for x in head[1:])
        end = at + 4 + int(fields["Content-Length"])
        while len(buffer) < end + 4 and more():
            pass
        if bytes(buffer[end : end + 4]) != CRLF + CRLF:
            raise ValueError("a record's length is wrong")
        yield fields, bytes(buffer[at + 4 : end]), bytes(buffer[: end + 4])
        del buffer[: end + 4]


def inflated(source) -> Iterator[bytes]:
    """The bytes of a gzip file of one or more members, in pieces of at most CHUNK however well they compress; a file that ends inside a member raises."""
    one, within = zlib.decompressobj(31), False
    while data := source.read(CHUNK):
        while data:
            if piece := one.decompress(data, CHUNK):
                yield piece
            within = not one.eof
            data = one.unconsumed_tail
            if one.eof:
                data, one = one.unused_data, zlib.decompressobj(31)
    if within:
        yield one.flush()
        if not one.eof:
            raise ValueError("the archive is cut off")


def gzipped(data: bytes) -> bytes:
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def planned(pages: DataFrame, scratch: Scratch, least: int = LEAST_PAYLOAD) -> DataFrame:
    """page_id, url, html, digest, size, refers_to of every row: which record is the response is found by digest, from narrow rows.

    Hashes are grouped with partial sums, so that a payload of a third of all pages is no hot
    task. Only the digests that occur more than once are joined back; they are written first, so
    that Spark knows their size (payloads are shuffled only if they are too many to broadcast) and
    splits the rows of a hot digest.
    """
    body = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    p = pages.select("page_id", F.coalesce("url", F.lit("")).alias("url"), body.alias("html"), F.sha2(body, 256).alias("digest"), F.length(body).cast("long").alias("size"))
    first = p.where(F.col("size") >= least).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").select("digest", "first")
    first = scratch.save("first", first)
    return p.join(first, "digest", "left").withColumn("refers_to", F.when(F.col("page_id") != F.col("first"), F.col("first"))).drop("first")


def _filesystem(uri: str):
    return pafs.FileSystem.from_uri(uri)


ARCHIVES = "path string, n long"


def written(plan: DataFrame, folder: str) -> DataFrame:
    """Monolithic archives: a gzip stream for each task, under a name of its attempt's own. Returns path and number of records."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sink = None
        n = 0
        for batch in batches:
            for r in batch.to_pylist():
                if sink is None:
                    fs, base = _filesystem(folder)
                    fs.create_dir(base, recursive=True)
                    task = TaskContext.get().partitionId()
                    path = f"{base}/{task:06d}-{uuid.uuid4().hex}.warc.gz"
                    sink = fs.open_output_stream(path, compression=None)
                    z = zlib.compressobj(6, zlib.DEFLATED, 31)
                kind = "response" if r["refers_to"] is None else "revisit"
                sink.write(z.compress(record(kind, json.dumps(r["page_id"]), f"{task}/{n}", r["url"], r["html"], r["digest"], r["size"], json.dumps(r["refers_to"]))))
                n += 1
        if sink is not None:
            sink.write(z.flush())
            sink.close()
            yield pa.RecordBatch.from_pydict({"path": [path], "n": [n]})

    return plan.mapInArrow(run, ARCHIVES)


def normalised(archives: DataFrame) -> DataFrame:
    """Rewrites each archive with one gzip member per record, and beside it an index of lines (offset, length, page, type). Returns path and number of records."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                fs, base = _filesystem(r["root"])
                fs.create_dir(base, recursive=True)
                to = f"{base}/" + r["path"].rsplit("/", 1)[1].removesuffix(".warc.gz") + f".{uuid.uuid4().hex}.members.warc.gz"
                at = n = 0
                with fs.open_input_stream(r["path"], compression=None) as source, fs.open_output_stream(to, compression=None) as sink, fs.open_output_stream(f"{to}.idx", compression=None) as index:
                    for fields, _, raw in records(inflated(source)):
                        member = gzipped(raw)
                        sink.write(member)
                        index.write(f"{at}\t{len(member)}\t{fields['X-Page-ID']}\t{fields['WARC-Type']}\n".encode())
                        at, n = at + len(member), n + 1
                if n != r["n"]:
                    raise ValueError(f"{r['path']} has {n} of {r['n']} records")
                yield pa.RecordBatch.from_pydict({"path": [to], "n": [n]})

    return archives.mapInArrow(run, ARCHIVES)


def read_back(archives: DataFrame) -> DataFrame:
    """Every record of normalised archives, each member found through the index and inflated alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                fs, _ = _filesystem(r["root"])
                with fs.open_input_stream(f"{r['path']}.idx", compression=None) as f:
                    index = [x.split("\t") for x in f.read().decode().splitlines()]
                out: list[tuple] = []
                with fs.open_input_file(r["path"]) as f:
                    for offset, length, _, _ in index:
                        f.seek(int(offset))
                        (fields, body, _), = records(inflated(io.BytesIO(f.read(int(length)))))
                        digest, size = fields["WARC-Payload-Digest"].removeprefix("sha256:"), int(fields["X-Payload-Length"])
                        kind = fields["WARC-Type"]
                        if kind == "response" and (len(body) != size or hashlib.sha256(body).hexdigest() != digest):
                            raise ValueError(f"a payload of {r['path']} has changed")
                        out.append((json.loads(fields["X-Page-ID"]), size, digest, kind, json.loads(fields["X-Refers-To-Page"]) if kind == "revisit" else None))
                        if len(out) == 4096:
                            yield _answers(out)
                            out = []
                if out:
                    yield _answers(out)

    def _answers(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(zip(*rows), kinds)], names=[k for k, _ in kinds])

    return archives.mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def round_trip(pages: DataFrame) -> DataFrame:
    """Writes, normalises and reads the archives of `pages` (page_id, url, html).

    Null html or url is empty. Pages with a null id come last when a response is chosen; rows that
    repeat the smallest id are responses too, with record ids of their own; there are no other ties.
    A page of any size is held whole, one at a time; other columns are not looked at. An empty
    table makes no archive. Archives are written where all executors see them, under names of their
    attempt's own: what a lost or repeated task has left is never read. The monolithic form is
    deleted once normalised.
    """
    spark = pages.sparkSession
    scratch = Scratch(spark, "warc")
    plan = planned(pages.select(F.col("page_id").cast("long"), "url", "html"), scratch)
    raw = scratch.save("raw", written(plan, f"{scratch.base}/archives"))
    root = F.lit(f"{scratch.base}/members").alias("root")
    tasks = max(1, raw.count())
    done = scratch.save("done", normalised(raw.select("path", "n", root).repartition(tasks)))
    scratch.drop("archives")
    return read_back(done.select("path", "n", root).repartition(tasks))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(load(spark, sf_dir, "pages"))


SQL = """
WITH p AS (
  SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
), f AS (
  SELECT payload_digest, min(page_id) AS first FROM p WHERE payload_bytes >= 100 GROUP BY payload_digest
)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN first IS NULL OR page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to
FROM p LEFT JOIN f USING (payload_digest)
"""
