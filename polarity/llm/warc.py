"""Web archives (WARC 1.1): writing captures, reading records, assembling them.

Writing. Each capture becomes three records: a request, a response (or a
revisit of an earlier equal payload) and metadata, linked by record ids and
WARC-Concurrent-To. Spark's text sink writes them, a record a row: its line
separator is the blank line pair that ends a WARC record, so the files are
plain WARC under gzip and need no file access beside Spark's. Payloads of at
least ``least`` bytes that are equal are stored once, in the capture with the
largest key (of several, the row that comes first). Only digests, keys and row
numbers are compared, never payloads.

Reading. Files are read whole and cut into records by their Content-Length;
``FILE_ROWS`` and ``FILE_BYTES`` bound a file. Assembly joins the records of a
capture through their concurrent-to ids: those that name a request or metadata
record are followed to the response that one names, over chains of any length,
then all records of one root are gathered in one nested row.

A null payload is written as an empty one, a null url as an empty target. A null
key is written as no key, and is smaller than the others. Every row is a capture
of its own, also equal rows and rows of one key.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from polarity.llm.scratch import materialise, numbered, scratch_scope
from polarity.llm.words import pieces

END = "\r\n\r\n"
FILE_ROWS = 1500      # records in a file at most
FILE_BYTES = 512 << 20  # bytes of records in a file at most, unless one is longer
LARGE = 256 << 10     # bytes of a payload from which captures are written by themselves, fewer a file
DATE = "2025-01-01T00:00:00Z"
_SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # the public namespace for URLs


def _record(kind: str, record_id: str, body: bytes, headers: dict[str, str], content: str) -> str:
    head = {"WARC-Type": kind, "WARC-Record-ID": f"<urn:uuid:{record_id}>", "WARC-Date": DATE, **headers, "Content-Type": content, "Content-Length": str(len(body))}
    lines = "\r\n".join(f"{k}: {v}" for k, v in head.items())
    return f"WARC/1.1\r\n{lines}{END}{body.decode()}"


def _digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _one_line(value: str) -> str:
    return " ".join((value or "").split())


def _write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, _, _ in pieces(batches, "payload", 4 << 20):
        out = []
        for key, url, page, copy, master, revisit in zip(*(batch.column(c).to_pylist() for c in ("key", "url", "payload", "row", "master", "revisit"))):
            payload, url = (page or "").encode(), _one_line(url)
            ids = [str(uuid.uuid5(_SPACE, f"{kind} {key} {copy} {url} {_digest(payload)}")) for kind in ("request", "response", "metadata")]
            target = {"WARC-Target-URI": url, "WARC-Payload-Digest": f"sha1:{_digest(payload)}"}
            linked = {"WARC-Target-URI": url, "WARC-Concurrent-To": f"<urn:uuid:{ids[1]}>"}
            out.append(_record("request", ids[0], f"GET {url or '/'} HTTP/1.1{END}".encode(), linked, "application/http; msgtype=request"))
            if not revisit:
                body = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}{END}".encode() + payload
                out.append(_record("response", ids[1], body, target, "application/http; msgtype=response"))
            else:
                profile = {"WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"}
                out.append(_record("revisit", ids[1], f"HTTP/1.1 200 OK{END}".encode(), target | profile, "application/http; msgtype=response"))
            fields = {"key": key, "payload-bytes": len(payload), "refers-to-key": master}
            body = "".join(f"{k}: {v}\r\n" for k, v in fields.items() if v is not None).encode()
            # metadata names the request, which names the response
            out.append(_record("metadata", ids[2], body, linked | {"WARC-Concurrent-To": f"<urn:uuid:{ids[0]}>"}, "application/warc-fields"))
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], names=["value"])


def mark_revisits(rows: DataFrame, least: int = 0) -> DataFrame:
    """(row, master, revisit): rows (row, key, payload) whose payload of ``least``
    bytes or more another row stores, with that row's key."""
    prints = rows.select("row", "key", F.coalesce("payload", F.lit("")).cast("binary").alias("p")).filter(F.octet_length("p") >= least)
    prints = prints.select("row", "key", F.sha2("p", 256).alias("digest"))
    stored = prints.groupBy("digest").agg(F.max(F.struct("key", (-F.col("row")).alias("row"))).alias("m"), F.count("*").alias("n")).filter("n > 1")
    stored = materialise(stored.select("digest", F.col("m.key").alias("master"), (-F.col("m.row")).alias("own")))
    return prints.join(stored, "digest").filter("row != own").select("row", "master", F.lit(True).alias("revisit"))


def write_warc(df: DataFrame, path: str, key_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least: int = 0) -> None:
    """Write the captures of ``df`` as gzipped WARC files under ``path``."""
    with scratch_scope(df.sparkSession):
        rows = numbered(df, "__row").select(F.col("__row").alias("row"), F.col(key_col).cast("long").alias("key"), F.col(url_col).cast("string").alias("url"),
                                            F.col(payload_col).cast("string").alias("payload"))
        marked = rows.join(mark_revisits(rows, least), "row", "left")
        size = F.coalesce(F.octet_length("payload"), F.lit(0))
        longest = rows.agg(F.coalesce(F.max(size), F.lit(0))).first()[0]
        parts = [(marked.filter(size < LARGE), FILE_ROWS)]
        if longest >= LARGE:
            parts.append((marked.filter(size >= LARGE), min(FILE_ROWS, 3 * max(1, FILE_BYTES // (longest + 4096)))))
        for mode, (part, most) in zip(("errorifexists", "append"), parts):
            records = part.mapInArrow(_write, "value string")
            records.write.mode(mode).option("lineSep", END).option("compression", "gzip").option("maxRecordsPerFile", most).text(path)


def _records(data: bytes) -> Iterator[tuple[dict, bytes]]:
    stream = io.BufferedReader(gzip.GzipFile(fileobj=io.BytesIO(data))) if data[:2] == b"\x1f\x8b" else io.BytesIO(data)
    while True:
        line = stream.readline()
        if not line:
            return
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not the start of a WARC record: {line[:40]!r}")
        headers = {}
        while (line := stream.readline()) not in (b"\r\n", b"\n", b""):
            name, _, value = line.decode().partition(":")
            headers[name.strip().lower()] = value.strip()
        size = int(headers["content-length"])
        body = stream.read(size)
        if len(body) != size:
            raise ValueError("a WARC record is cut off")
        yield headers, body


def _urn(value: str | None) -> str | None:
    return value.strip("<>").removeprefix("urn:uuid:") if value else None


_READ = pa.schema([("record_id", pa.string()), ("record_type", pa.string()), ("concurrent_to", pa.string()), ("target_uri", pa.string()),
                   ("digest", pa.string()), ("payload_bytes", pa.int64()), ("payload", pa.binary()), ("fields", pa.map_(pa.string(), pa.string()))])
_READ_SQL = ("record_id string, record_type string, concurrent_to string, target_uri string, digest string, payload_bytes long, "
             "payload binary, fields map<string,string>")


def _read(payloads: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column("content"):
                rows = []
                for h, body in _records(data.as_py()):
                    kind = h["warc-type"]
                    payload = body.partition(END.encode())[2] if "application/http" in h.get("content-type", "") else body
                    digest = _digest(payload) if kind == "response" else _urn(h.get("warc-payload-digest", "").removeprefix("sha1:"))
                    fields = [tuple(x.split(": ", 1)) for x in body.decode().split("\r\n") if ": " in x] if kind == "metadata" else []
                    rows.append((_urn(h["warc-record-id"]), kind, _urn(h.get("warc-concurrent-to")), h.get("warc-target-uri"), digest,
                                 len(payload) if kind == "response" else None, payload if payloads and kind == "response" else None, fields))
                    if len(rows) >= 500:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _READ)], schema=_READ)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _READ)], schema=_READ)

    return run


def read_warc(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """One row per record. A response's digest and size are computed from its
    payload; those of a revisit are what its records state."""
    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(_read(payloads), _READ_SQL)


def assemble(records: DataFrame, hops: int | None = None) -> DataFrame:
    """One nested row per capture: ``capture_id`` (the id of its response or
    revisit) and ``request``, ``response``, ``metadata`` structs. Chains of
    concurrent-to ids are followed to their end; ``hops`` says that none is
    longer, which saves looking. Chains without an end are an error."""
    rows = records.withColumn("root", F.coalesce("concurrent_to", "record_id"))
    links = records.filter("concurrent_to IS NOT NULL").select(F.col("record_id").alias("named"), F.col("concurrent_to").alias("next"))
    if hops is None:
        # each round doubles what a link reaches
        links = materialise(links)
        for _ in range(40):
            far = links.alias("a").join(links.alias("b"), F.col("a.next") == F.col("b.named"), "left")
            far = materialise(far.select("a.named", F.coalesce("b.next", "a.next").alias("next"), F.col("b.next").isNotNull().alias("moved")))
            links = far.select("named", "next")
            if far.filter("moved").isEmpty():
                break
        else:
            raise ValueError("concurrent-to ids name each other in a ring")
    for _ in range(1 if hops is None else hops - 1):
        rows = rows.join(links, rows.root == links.named, "left").withColumn("root", F.coalesce("next", "root")).drop("named", "next")

    def of(*kinds: str) -> Column:
        return F.min_by(F.struct(*records.columns), F.when(F.col("record_type").isin(*kinds), F.col("record_id")))

    return rows.groupBy(F.col("root").alias("capture_id")).agg(of("request").alias("request"), of("response", "revisit").alias("response"), of("metadata").alias("metadata"))
