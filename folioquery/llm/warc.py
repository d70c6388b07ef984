"""WARC archives of web pages: writing with segments, chunked transfer framing and revisits, and reassembly.

Records are written by Spark's text sink, gzip-compressed, a row per record, so any store that Spark
writes to will do. Records over SEGMENT bytes are cut: the first piece keeps its type and has segment
number 1, the others are `continuation` records that name the first one's id; the last states the total.
Readers group continuations by that id, order them, check the total, and undo the chunked framing.
"""

from __future__ import annotations

import uuid
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh_path, written

#: Bytes of a record's block, and of one chunk of its payload; payloads from LEAST bytes on are stored once.
SEGMENT, CHUNK, LEAST = 32 << 10, 8 << 10, 100
RECORDS_PER_FILE = 2000
NAMES = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"


def record_id(page_id: int | None, url: str | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMES, f'{page_id}|{url}|{digest}')}>"


def to_chunks(payload: bytes) -> bytes:
    parts = [payload[k : k + CHUNK] for k in range(0, len(payload), CHUNK)]
    return b"".join(b"%x\r\n%s\r\n" % (len(p), p) for p in parts) + b"0\r\n\r\n"


def from_chunks(data: bytes) -> bytes:
    """Payload of a chunked body; chunk extensions and trailers are skipped. A body cut short is an error."""
    parts, at = [], 0
    while True:
        end = data.index(b"\r\n", at)
        size = int(data[at:end].split(b";")[0], 16)
        if size == 0:
            return b"".join(parts)
        parts.append(data[end + 2 : end + 2 + size])
        if len(parts[-1]) != size or data[end + 2 + size : end + 4 + size] != b"\r\n":
            raise ValueError("chunk cut short")
        at = end + 4 + size


def payload_of(block: bytes) -> bytes:
    head, _, body = block.partition(b"\r\n\r\n")
    return from_chunks(body) if b"transfer-encoding: chunked" in head.lower() else body


def record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    told = "".join(f"{k}: {v}\r\n" for k, v in headers)
    return f"WARC/1.1\r\n{told}Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"


def records_of(page_id, url, html: str, digest: str, refers_id, refers_url) -> list[bytes]:
    """The records of one page."""
    own = record_id(page_id, url, digest)
    told = [("WARC-Record-ID", own), ("WARC-Date", "1970-01-01T00:00:00Z"), ("WARC-Payload-Digest", f"sha256:{digest}")]
    if page_id is not None:
        told.append(("Page-ID", str(page_id)))
    if url is not None:
        told.append(("WARC-Target-URI", "".join(c if c > " " else f"%{ord(c):02X}" for c in url)))
    if refers_id is not None:
        told += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", record_id(refers_id, refers_url, digest))]
        return [record([("WARC-Type", "revisit"), *told], HTTP)]
    block = HTTP + to_chunks(html.encode())
    told.append(("Content-Type", "application/http; msgtype=response"))
    if len(block) <= SEGMENT:
        return [record([("WARC-Type", "response"), *told], block)]
    pieces = [block[k : k + SEGMENT] for k in range(0, len(block), SEGMENT)]
    out = [record([("WARC-Type", "response"), ("WARC-Segment-Number", "1"), *told], pieces[0])]
    for k, piece in enumerate(pieces[1:], 2):
        head = [("WARC-Type", "continuation"), ("WARC-Record-ID", record_id(page_id, f"{url}#{k}", digest)), ("WARC-Date", "1970-01-01T00:00:00Z")]
        head += [("WARC-Segment-Origin-ID", own), ("WARC-Segment-Number", str(k))]
        out.append(record(head + [("WARC-Segment-Total-Length", str(len(block)))] * (k == len(pieces)), piece))
    return out


def write_warc(pages: DataFrame, path: str) -> None:
    """Write page_id, url, html rows. Of equal payloads of LEAST bytes or more the smallest page_id is the response.

    A null html is an empty payload; a null url has no target header; a null page_id is larger than any other.
    Rows that repeat the smallest page_id with the same url are responses alike.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("html"))
    rows = rows.withColumn("digest", F.sha2("html", 256))
    large = rows.where(F.octet_length("html") >= LEAST)
    first = large.groupBy("digest").agg(F.min(F.struct(F.col("page_id").isNull().alias("n"), F.col("page_id"), F.col("url"))).alias("first"), F.count("*").alias("n"))
    first = first.where("n > 1").select("digest", "first.page_id", "first.url").toDF("digest", "first_id", "first_url")
    joined = rows.join(first, "digest", "left")
    # a response keeps its own html; a revisit's isn't needed any more
    is_response = F.col("first_id").isNull() | (F.octet_length("html") < LEAST) | F.coalesce(F.col("page_id") == F.col("first_id"), F.lit(False))
    told = joined.select("page_id", "url", F.when(is_response, F.col("html")).alias("html"), "digest", F.when(~is_response, F.col("first_id")).alias("refers_id"), "first_url")

    def build(batches):
        for batch in batches:
            out = []
            for page_id, url, html, digest, refers_id, refers_url in zip(*(c.to_pylist() for c in batch.columns)):
                out += [r[:-1] for r in records_of(page_id, url, html or "", digest, refers_id, refers_url)]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["record"])

    records = told.mapInArrow(build, "record binary").select(F.col("record").cast("string").alias("value"))
    records.write.option("compression", "gzip").option("maxRecordsPerFile", RECORDS_PER_FILE).text(path)


def parse(data) -> list[tuple[dict[str, str], bytes]]:
    """Records of one file's bytes, gzip members or plain."""
    raw = bytes(data)
    while raw[:2] == b"\x1f\x8b":
        reader = zlib.decompressobj(31)
        plain, rest = [], raw
        while rest:
            plain.append(reader.decompress(rest) + reader.flush())
            rest = reader.unused_data
            reader = zlib.decompressobj(31)
        raw = b"".join(plain)
    at = 0
    while at < len(raw):
        end = raw.index(b"\r\n\r\n", at)
        version, *lines = raw[at:end].decode("utf-8").split("\r\n")
        if not version.startswith("WARC/"):
            raise ValueError("not a record")
        headers = {k.lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}
        start = end + 4
        stop = start + int(headers["content-length"])
        yield headers, raw[start:stop]
        at = stop + 4


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """record_id, page_id, record_type, refers_to_id, declared, payload: one row per logical record of the files of path.

    Segments of a record are put together; one that lacks a piece, or whose length isn't the stated one, is an error.
    """

    def read(batches):
        for batch in batches:
            for data in batch.column(0):
                rows = []
                for h, block in parse(data.as_buffer()):
                    number = int(h.get("warc-segment-number", 0))
                    total = h.get("warc-segment-total-length")
                    rows.append((h.get("warc-segment-origin-id", h["warc-record-id"]), int(h["page-id"]) if "page-id" in h else None, h["warc-type"], h.get("warc-refers-to"), h.get("warc-payload-digest", "").removeprefix("sha256:") or None, number, int(total) if total else None, b"" if h["warc-type"] == "revisit" else block if number else payload_of(block)))
                    if len(rows) == 500:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    names = ["record_id", "page_id", "record_type", "refers_to_id", "declared", "number", "total", "data"]
    types = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.int64(), pa.binary()]
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    pieces = files.mapInArrow(read, "record_id string, page_id long, record_type string, refers_to_id string, declared string, number int, total long, data binary")
    whole = pieces.where("number = 0")
    # equal rows of the input have equal ids and pieces: they are put together once and then repeated
    cut = pieces.where("number > 0").groupBy("record_id", "number").agg(F.count("*").alias("copies"), *[F.max(c).alias(c) for c in ("page_id", "refers_to_id", "declared", "total", "data")])
    cut = cut.groupBy("record_id").agg(
        F.max("page_id").alias("page_id"), F.max("refers_to_id").alias("refers_to_id"), F.max("declared").alias("declared"), F.max("total").alias("total"), F.max("copies").alias("copies"),
        F.sort_array(F.collect_list(F.struct("number", "data"))).alias("parts"),
    )

    def join(batches):
        for batch in batches:
            out = []
            for total, parts in zip(batch.column("total").to_pylist(), batch.column("parts").to_pylist()):
                if [p["number"] for p in parts] != list(range(1, len(parts) + 1)):
                    raise ValueError("a segment is missing")
                block = b"".join(p["data"] for p in parts)
                if len(block) != total:
                    raise ValueError("segments do not add up to the stated length")
                out.append(payload_of(block))
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in kept] + [pa.array(out, pa.binary())], names=[*kept, "data"])

    kept = ["record_id", "page_id", "refers_to_id", "declared", "copies"]
    joined = cut.mapInArrow(join, "record_id string, page_id long, refers_to_id string, declared string, copies long, data binary")
    joined = joined.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).withColumn("record_type", F.lit("response"))
    columns = ["record_id", "page_id", "record_type", "refers_to_id", "declared", "data"]
    return whole.select(*columns).union(joined.select(*columns)).withColumnRenamed("data", "payload")


def round_trip(pages: DataFrame) -> DataFrame:
    """Write pages into the shared folder, read the archives back, and tell what each record holds.

    A revisit takes its payload's size, digest and page from the response that it names. An empty table gives
    no rows; other columns of pages are not used.
    """
    spark = pages.sparkSession
    path = fresh_path(spark, "warc")
    write_warc(pages, path)
    read = read_warc(spark, path).select("record_id", "page_id", "record_type", "refers_to_id", "declared", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_digest"))
    read = written(read, "records")
    good = F.when(F.col("payload_digest") == F.col("declared"), F.col("payload_digest"))
    responses = read.where("record_type = 'response'").withColumn("payload_digest", good)
    held = responses.groupBy("record_id").agg(F.min("page_id").alias("refers_to"), F.max("payload_bytes").alias("payload_bytes"), F.max("payload_digest").alias("payload_digest"))
    revisits = read.where("record_type = 'revisit'").select("page_id", "record_type", F.col("refers_to_id").alias("record_id")).join(held, "record_id", "left")
    own = responses.select("page_id", "payload_bytes", "payload_digest", "record_type", F.lit(None).cast("long").alias("refers_to"))
    return own.union(revisits.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"))
