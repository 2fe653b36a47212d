"""WARC archives of pages, and the assembly of their records into captures.

Each page gives three gzip members: a ``request`` record, a ``response`` (or ``revisit``) record
and a ``metadata`` record; request and metadata name the response in ``WARC-Concurrent-To``. Of
pages with equal payloads of at least ``least_bytes``, the one with the largest page_id is the
response and the others revisit it. Assembly brings the records that name one another together,
whatever files they are in, in one shuffle without payloads unless these are asked for, and gives
one nested row per capture.

Archives are binary values of a Parquet table written by Spark's committer: no half files after
a lost executor, any Hadoop file system; each value is a complete ``.warc.gz`` file.

Null html is the empty payload. A null page_id is written without a page-id field and never is
what others revisit, unless all its equals are null: then each is a response. Rows that repeat a
page_id with the same payload share its verdict; each is written and assembled by itself. An
empty table gives no archives.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tonewright.llm.common import arrow_map, fresh_path, raw, saved, slices
from tonewright.llm.graph import components

DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Bytes at which an archive is closed.
FILE_BYTES = 16_000_000


def b32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(run: str, page_id: int | None, place: str) -> str:
    """Identifier of a page's response; a page without a number gets one from its place."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{run}/{place if page_id is None else page_id}')}>"


def record(kind: str, own_id: str, block: bytes, content_type: str, uri: str, date: str = DATE, **more: str) -> bytes:
    """One WARC/1.1 record as a gzip member; keywords are header names with _ for -."""
    head = {"WARC-Type": kind, "WARC-Record-ID": own_id, "WARC-Date": date}
    if uri:
        head["WARC-Target-URI"] = uri
    head |= {k.replace("_", "-"): v for k, v in more.items()}
    head |= {"Content-Type": content_type, "Content-Length": str(len(block))}
    lines = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items()) + "\r\n"
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    return pack.compress(lines.encode() + block + b"\r\n\r\n") + pack.flush()


def members(data: bytes, step: int = 16_384) -> Iterator[bytes]:
    """The inflated gzip members of a file; what follows a member is looked at in small steps."""
    view, at = memoryview(data), 0
    while at < len(view):
        unpack, out = zlib.decompressobj(31), []
        while not unpack.eof:
            part = view[at : at + step]
            if not len(part):
                raise ValueError("a gzip member is cut short")
            out.append(unpack.decompress(part))
            at += len(part) - len(unpack.unused_data)
        yield b"".join(out)


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (names in lower case) and block of each record of a .warc.gz file."""
    for member in members(data):
        at = 0
        while at < len(member):
            end = member.index(b"\r\n\r\n", at)
            lines = member[at:end].decode().split("\r\n")
            if not lines[0].startswith("WARC/"):
                raise ValueError("not a WARC record")
            head: dict[str, str] = {}
            for k, _, v in (x.partition(":") for x in lines[1:]):
                k, v = k.lower(), v.strip()
                # the one field that may be repeated: identifiers hold no spaces
                head[k] = f"{head[k]} {v}" if k == "warc-concurrent-to" and k in head else v
            start, n = end + 4, int(head["content-length"])
            if member[start + n : start + n + 4] != b"\r\n\r\n":
                raise ValueError("a record's block has another length than it says")
            yield head, member[start : start + n]
            at = start + n + 4


def one_line(text: str) -> str:
    """A header value: line breaks and other control characters percent-encoded."""
    return "".join(c if c >= " " and c != "\x7f" else f"%{ord(c):02X}" for c in text).strip()


def page_records(run: str, page_id: int | None, url: str, payload: bytes, revisits: int | None, place: str) -> bytes:
    """The three members of one page; ``revisits``: page_id of the response with its payload."""
    uri = one_line(url)
    own = record_id(run, page_id, place)
    child = lambda kind: f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{run}/{place}/{kind}')}>"
    parts = urlsplit(uri) if "[" not in uri else urlsplit("")
    path = (parts.path or "/") + (f"?{parts.query}" if parts.query else "")
    ask = f"GET {path.replace(' ', '%20')} HTTP/1.1\r\nHost: {parts.netloc}\r\n\r\n".encode()
    digest = "sha1:" + b32_sha1(payload)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    notes = {} if page_id is None else {"page-id": page_id}
    if revisits is None:
        main = record("response", own, http + payload, "application/http;msgtype=response", uri, WARC_Payload_Digest=digest)
    else:
        notes["refers-to-page"] = revisits
        main = record(
            "revisit", own, http, "application/http;msgtype=response", uri,
            WARC_Payload_Digest=digest, WARC_Profile=PROFILE, WARC_Refers_To=record_id(run, revisits, ""),
        )
    fields = "".join(f"{k}: {v}\r\n" for k, v in notes.items()).encode()
    return b"".join([
        record("request", child("request"), ask, "application/http;msgtype=request", uri, WARC_Concurrent_To=own),
        main,
        record("metadata", child("metadata"), fields, "application/warc-fields", uri, WARC_Concurrent_To=own),
    ])


def write_archives(pages: DataFrame, path: str | None = None, least_bytes: int = 0) -> str:
    """Write (page_id, url, html) as archives; returns the path of their table."""
    pages = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"),
        F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"),
    ).withColumn("digest", F.expr("sha1(CAST(html AS BINARY))"))
    # who revisits whom is decided on digests and numbers alone; a hot payload's html stays where it is
    marks = pages.select("digest", "page_id", (F.octet_length("html") >= least_bytes).alias("counts"))
    keepers = marks.groupBy("digest").agg(F.max("page_id").alias("keeper"), F.count(F.lit(1)).alias("n")).where("n > 1 AND keeper IS NOT NULL").drop("n")
    again = marks.join(keepers, "digest").where("counts AND NOT page_id <=> keeper").select("digest", "page_id", "keeper").distinct()
    # a table of known size: Spark sends it to the pages if it is below the session's threshold
    again = saved(again, "revisits").select(F.col("digest").alias("d"), F.col("page_id").alias("p"), F.col("keeper").alias("revisits"))
    judged = pages.join(again, (F.col("digest") == F.col("d")) & F.col("page_id").eqNullSafe(F.col("p")), "left").select("page_id", "url", "html", "revisits")
    run_id = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        held: list[bytes] = []
        size = n = part = 0

        def close() -> pa.RecordBatch:
            nonlocal size, part
            data = b"".join(held)
            held.clear()
            size, part = 0, part + 1
            return pa.RecordBatch.from_arrays([pa.array([f"{task:06d}-{part:05d}.warc.gz"]), pa.array([data], pa.binary())], ["file", "archive"])

        for batch in batches:
            for piece in slices(batch, "html"):
                cols = [piece.column(c).to_pylist() for c in ("page_id", "url", "revisits")]
                for page_id, url, revisits, html in zip(*cols, raw(piece, "html"), strict=True):
                    n += 1
                    held.append(page_records(run_id, page_id, url, html, revisits, f"{task}/{n}"))
                    size += len(held[-1])
                    if size >= FILE_BYTES:
                        yield close()
        if held:
            yield close()

    path = path or fresh_path(pages.sparkSession, "warc")
    arrow_map(judged, run, "file string, archive binary").write.option("compression", "uncompressed").parquet(path)
    return path


_RECORD = "file string, place int, concurrent array<string>, kind string, record_id string, uri string, date string, refers_to string, page_id long, refers_to_page long, payload_bytes long, payload_digest string"
_MAIN = ["response", "revisit"]


def read_records(archives: DataFrame, with_payload: bool = False) -> DataFrame:
    """One row per record of (file, archive), with its place in the file and the identifiers of
    all records it is concurrent to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in _RECORD.split(", ")]
        kinds = [pa.string(), pa.int32(), pa.list_(pa.string()), *[pa.string()] * 5, pa.int64(), pa.int64(), pa.int64(), pa.string()]
        if with_payload:
            names, kinds = [*names, "payload"], [*kinds, pa.binary()]
        for batch in batches:
            for file, data in zip(batch.column("file").to_pylist(), batch.column("archive").to_pylist(), strict=True):
                rows, held = [], 0

                def out():
                    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)

                for place, (head, block) in enumerate(parse(data)):
                    kind, own = head["warc-type"], head["warc-record-id"]
                    page = refers = size = digest = payload = None
                    if kind in _MAIN:
                        http, _, payload = block.partition(b"\r\n\r\n")
                        digest = head["warc-payload-digest"].removeprefix("sha1:")
                        if kind == "response":
                            size = len(payload)
                            if b32_sha1(payload) != digest:
                                raise ValueError(f"{file}: the payload of {own} has another digest")
                        else:
                            size = int(http.lower().rpartition(b"content-length:")[2].split(b"\r\n")[0])
                            payload = None
                    elif kind == "metadata":
                        notes = dict(x.split(": ", 1) for x in block.decode().split("\r\n") if x)
                        page, refers = (int(notes[k]) if k in notes else None for k in ("page-id", "refers-to-page"))
                    row = (file, place, head.get("warc-concurrent-to", "").split(), kind, own, head.get("warc-target-uri"), head["warc-date"], head.get("warc-refers-to"), page, refers, size, digest)
                    rows.append((*row, payload) if with_payload else row)
                    held += len(payload or b"") if with_payload else 300
                    if held > 4_000_000:
                        yield out()
                        rows, held = [], 0
                if rows:
                    yield out()

    return arrow_map(archives, run, _RECORD + (", payload binary" if with_payload else ""))


def _captures(links: DataFrame) -> DataFrame | None:
    """(record_id, capture) of records that (record_id, kind, concurrent) tie together over any
    number of steps; None if every link leads from another record to a response, which then
    names the capture."""
    edges = links.select("record_id", "kind", F.explode("concurrent").alias("other"))
    mains = links.where(F.col("kind").isin(_MAIN)).select(F.col("record_id").alias("other")).distinct()
    others = edges.where(~F.col("kind").isin(_MAIN))
    straight = edges.where(F.col("kind").isin(_MAIN)).isEmpty() and links.where("size(concurrent) > 1").isEmpty() and others.join(mains, "other", "left_anti").isEmpty()
    if straight:
        return None
    parts = components(edges.select(F.xxhash64("record_id").alias("a"), F.xxhash64("other").alias("b")))
    known = links.join(parts, F.xxhash64("record_id") == F.col("node"), "left").withColumn("part", F.coalesce("component", F.xxhash64("record_id")))
    name = F.coalesce(F.min(F.when(F.col("kind").isin(_MAIN), F.col("record_id"))), F.min(F.array_min("concurrent")), F.min("record_id"))
    return known.select("record_id", "part").distinct().join(known.groupBy("part").agg(name.alias("capture")), "part").select("record_id", "capture")


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture: request, response (or revisit) and metadata side by side.

    Records belong together that name one another in any concurrent-to field, in either direction,
    over any number of steps and in any files. The capture is named by its response's identifier.
    Where an identifier is repeated, the n-th request, response and metadata by file and place
    make the n-th capture. A record without partners gives a capture whose other parts are null.
    """
    common = ["record_id", "uri", "date"]
    payload = ["payload"] if "payload" in records.columns else []
    main = [*common, "kind", "refers_to", "payload_bytes", "payload_digest", *payload]
    if not payload:
        records = saved(records, "records")  # archives are parsed once
    links = records.select("record_id", "kind", "concurrent") if not payload else saved(records.select("record_id", "kind", "concurrent"), "records")
    captures = _captures(links)
    if captures is None:
        named = records.withColumn("capture", F.coalesce(F.get("concurrent", F.lit(0)), F.col("record_id")))
    else:
        named = records.join(captures, "record_id")
    role = F.when(F.col("kind").isin(_MAIN), "response").otherwise(F.col("kind"))
    # one shuffle by capture serves the numbering and the grouping
    dealt = named.withColumn("role", role).repartition("capture")
    nth = F.row_number().over(Window.partitionBy("capture", "role").orderBy("file", "place"))

    def part(of: str, fields: list[str]):
        return F.first(F.when(F.col("role") == of, F.struct(*fields)), ignorenulls=True).alias(of)

    return dealt.withColumn("nth", nth).groupBy("capture", "nth").agg(part("request", common), part("response", main), part("metadata", [*common, "page_id", "refers_to_page"]))


def capture_digest(pages: DataFrame) -> DataFrame:
    """Write the pages, read the archives back and give a flat row per capture."""
    spark = pages.sparkSession
    captures = assemble(read_records(spark.read.parquet(write_archives(pages))))
    return captures.select(
        F.col("metadata.page_id").alias("page_id"),
        F.col("response.payload_bytes").alias("payload_bytes"),
        F.col("response.payload_digest").alias("payload_digest"),
        F.col("response.kind").alias("record_type"),
        F.col("metadata.refers_to_page").alias("refers_to"),
    )
