"""WARC archives: writing records, and reading them back with segment reassembly.

Writer: each page becomes a record; the payload sits in an HTTP response with chunked transfer framing. Of equal
payloads the smallest key is a response, the others are revisits that hold the HTTP head only. A record longer than
``segment_bytes`` is cut: the first segment keeps the record's type, the rest are continuation records that name their
origin, the last one with the total length. Each task writes gzip members to archives of bounded size, named by its
attempt, and returns a manifest; only archives of a manifest are read, so files of lost attempts don't count.

Reader: archives are parsed record by record. Segments, which may lie in different archives, are grouped by origin
identifier, put in order of segment number, verified against the total length, joined, and only then is the chunked
framing decoded and the payload digest verified. Revisits get size and digest from the response they refer to.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import documents_of, materialize, scratch_path
from .skew import skew_join

DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
FRAME = 4096
BATCH_BYTES = 1 << 20


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def framed(payload: bytes) -> bytes:
    """Chunked transfer framing."""
    return b"".join(b"%x\r\n%b\r\n" % (len(payload[i : i + FRAME]), payload[i : i + FRAME]) for i in range(0, len(payload), FRAME)) + b"0\r\n\r\n"


def unframed(body: bytes) -> bytes:
    """Decodes chunked transfer framing (extensions and trailers are skipped); ValueError if it is broken."""
    out, at = [], 0
    while True:
        end = body.index(b"\r\n", at)
        size = int(body[at:end].split(b";")[0], 16)
        at = end + 2
        if size == 0:
            return b"".join(out)
        if body[at + size : at + size + 2] != b"\r\n":
            raise ValueError("a chunk doesn't end where it says")
        out.append(body[at : at + size])
        at += size + 2


def record(kind: str, identifier: str, block: bytes, fields: dict[str, str | None]) -> bytes:
    lines = {"WARC-Type": kind, "WARC-Record-ID": f"<{identifier}>", "WARC-Date": DATE} | {k: v for k, v in fields.items() if v is not None} | {"Content-Length": str(len(block))}
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in lines.items()).encode() + b"\r\n" + block + b"\r\n\r\n"


def page_records(page_id: int | None, url: str | None, payload: bytes, keep: int | None, revisit: bool, tag: str, segment_bytes: int) -> Iterator[bytes]:
    """The record of a page, in segments where it is long."""
    identifier = f"urn:page:{page_id}:{tag}"
    fields = {"WARC-Target-URI": quote(url, safe=":/?#[]@!$&'()*+,;=%") if url else None, "WARC-Payload-Digest": f"sha1:{digest_of(payload)}", "Content-Type": "application/http;msgtype=response"}
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
    if revisit:
        yield record("revisit", identifier, head + b"Content-Length: %d\r\n\r\n" % len(payload), fields | {"WARC-Profile": PROFILE, "WARC-Refers-To": f"<urn:page:{keep}>"})
        return
    block = head + b"Transfer-Encoding: chunked\r\n\r\n" + framed(payload)
    parts = [block[i : i + segment_bytes] for i in range(0, len(block), segment_bytes)]
    if len(parts) == 1:
        yield record("response", identifier, block, fields)
        return
    yield record("response", identifier, parts[0], fields | {"WARC-Segment-Number": "1"})
    for number, part in enumerate(parts[1:], 2):
        total = str(len(block)) if number == len(parts) else None
        yield record("continuation", f"{identifier}:{number}", part, {"WARC-Segment-Origin-ID": f"<{identifier}>", "WARC-Segment-Number": str(number), "WARC-Segment-Total-Length": total})


def write_archives(pages: DataFrame, folder: str, archive_bytes: int, segment_bytes: int) -> DataFrame:
    """pages (page_id, url, html, keep_id) -> manifest (path, records), one row per archive."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        tag = f"{context.stageId()}-{context.partitionId()}"
        store, root = pafs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        out, path, written, count, n, number = None, "", 0, 0, 0, 0
        for batch in batches:
            for page_id, url, html, keep in zip(*(batch[c] for c in ("page_id", "url", "html", "keep_id")), strict=True):
                page_id, keep, n = page_id.as_py(), keep.as_py(), n + 1
                for raw in page_records(page_id, url.as_py(), (html.as_py() or "").encode(), keep, page_id != keep, f"{tag}.{n}", segment_bytes):
                    if out is None:
                        path, written, count = f"{root}/{tag}-{context.taskAttemptId()}-{number:06d}.warc.gz", 0, 0
                        out, number = store.open_output_stream(path, compression=None), number + 1
                    member = zlib.compress(raw, 1, 31)
                    out.write(member)
                    written, count = written + len(member), count + 1
                    if written >= archive_bytes:
                        out.close()
                        out = None
                        yield pa.RecordBatch.from_pydict({"path": [path], "records": [count]})
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pydict({"path": [path], "records": [count]})

    return pages.mapInArrow(task, "path string, records long")


def parsed(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """(lower-cased fields, block) of each record of a gzip archive, read in bounded pieces."""
    buffer, unzip = b"", zlib.decompressobj(31)

    def more() -> bytes:
        nonlocal unzip
        while True:
            raw = unzip.unused_data or stream.read(1 << 18)
            if not raw:
                return b""
            if unzip.eof:
                unzip = zlib.decompressobj(31)
            got = unzip.decompress(raw)
            if got:
                return got

    while True:
        while (end := buffer.find(b"\r\n\r\n")) < 0:
            if not (got := more()):
                if buffer.strip():
                    raise ValueError("an archive ends within a record")
                return
            buffer += got
        lines = buffer[:end].decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"not a record: {lines[0][:40]!r}")
        fields = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}
        at, size = end + 4, int(fields["content-length"])
        pieces, have = [buffer[at:]], len(buffer) - at
        while have < size + 4:
            if not (got := more()):
                raise ValueError("an archive ends within a record")
            pieces.append(got)
            have += len(got)
        rest = b"".join(pieces)
        yield fields, rest[:size]
        buffer = rest[size + 4 :]


RECORDS = "kind string, origin string, segment int, total long, url string, refers_to string, digest string, block binary"


def read_records(manifest: DataFrame, root_uri: str) -> DataFrame:
    """All records of the manifest's archives, segments apart."""
    schema = pa.schema([("kind", pa.string()), ("origin", pa.string()), ("segment", pa.int32()), ("total", pa.int64()), ("url", pa.string()), ("refers_to", pa.string()), ("digest", pa.string()), ("block", pa.binary())])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = pafs.FileSystem.from_uri(root_uri)
        for batch in batches:
            for path in batch["path"].to_pylist():
                rows, held = [], 0
                with store.open_input_stream(path, compression=None) as stream:
                    for f, block in parsed(stream):
                        total = f.get("warc-segment-total-length")
                        rows.append({
                            "kind": f["warc-type"], "origin": f.get("warc-segment-origin-id", f["warc-record-id"]).strip("<>"), "segment": int(f.get("warc-segment-number", 0)), "total": int(total) if total else None,
                            "url": f.get("warc-target-uri"), "refers_to": f["warc-refers-to"].strip("<>") if "warc-refers-to" in f else None, "digest": f["warc-payload-digest"].removeprefix("sha1:") if "warc-payload-digest" in f else None, "block": block,
                        })
                        held += len(block)
                        if held >= BATCH_BYTES:
                            yield pa.RecordBatch.from_pylist(rows, schema)
                            rows, held = [], 0
                yield pa.RecordBatch.from_pylist(rows, schema)

    return manifest.select("path").mapInArrow(task, RECORDS)


DECODED = "record_id string, record_type string, refers_to string, url string, payload binary, payload_digest string, fault string"


def decode(records: DataFrame) -> DataFrame:
    """Whole records (origin, kind, refers_to, url, digest, total, blocks: segments in order) -> DECODED; broken ones carry a fault."""
    schema = pa.schema([(n, pa.binary() if n == "payload" else pa.string()) for n in ("record_id", "record_type", "refers_to", "url", "payload", "payload_digest", "fault")])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                segments, fault, payload = r["blocks"], None, b""
                numbers, block = [s["segment"] for s in segments], b"".join(s["block"] for s in segments)
                if numbers != [0] and numbers != list(range(1, len(numbers) + 1)):
                    fault = "segments are missing or repeated"
                elif numbers != [0] and r["total"] != len(block):
                    fault = "the segments' length isn't the total length"
                else:
                    head, found, body = block.partition(b"\r\n\r\n")
                    try:
                        payload = unframed(body) if re.search(rb"(?i)^transfer-encoding:\s*chunked\s*$", head, re.M) else body
                    except ValueError:
                        fault = "broken transfer framing"
                    if not fault and r["kind"] != "revisit" and r["digest"] != digest_of(payload):
                        fault = "the payload doesn't match its digest"
                rows.append({"record_id": r["origin"], "record_type": r["kind"], "refers_to": r["refers_to"], "url": r["url"], "payload": payload, "payload_digest": r["digest"], "fault": fault})
            yield pa.RecordBatch.from_pylist(rows, schema)

    return records.select("origin", "kind", "refers_to", "url", "digest", "total", "blocks").mapInArrow(task, DECODED)


def reassembled(records: DataFrame) -> DataFrame:
    """Groups segments by origin; unsegmented records pass without a shuffle."""
    one = F.array(F.struct("segment", "block")).alias("blocks")
    whole = records.where("segment = 0").select("origin", "kind", "refers_to", "url", "digest", "total", one)
    parts = records.where("segment > 0").groupBy("origin").agg(
        F.min(F.when(F.col("kind") != "continuation", F.col("kind"))).alias("kind"), F.min("refers_to").alias("refers_to"), F.min("url").alias("url"), F.min("digest").alias("digest"),
        F.max("total").alias("total"), F.array_sort(F.collect_list(F.struct("segment", "block"))).alias("blocks"),
    )
    return decode(whole.unionByName(parts))


def round_trip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_payload: int = 0, archive_bytes: int = 32 << 20, segment_bytes: int = 16 << 10, folder: str | None = None) -> DataFrame:
    """Writes pages as archives, reads them back: page_id, payload_bytes, payload_digest, record_type, refers_to, payload (responses only).

    Null payloads are empty. Rows with one id and one payload are all responses (or all revisits); a null id never is
    the response of another's; URLs are percent-encoded where they hold other than URL characters and left out where null. An
    empty table writes nothing and gives no rows; other columns are ignored. A broken record raises.
    """
    spark = pages.sparkSession
    folder = folder or scratch_path(spark, "warc")
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.coalesce(payload_col, F.lit("")).alias("html"))
    rows = rows.withColumn("digest", F.sha2(F.col("html").cast("binary"), 256))
    first = rows.where(F.octet_length("html") >= min_payload).groupBy("digest").agg(F.min("page_id").alias("keep_id"), F.count("*").alias("n")).where("n > 1")
    # only payloads met twice need their response's id; where they are few, no payload moves for it
    marked = skew_join(rows, materialize(first, "repeated"), "digest", "n", rows.count(), "left")
    marked = marked.select("page_id", "url", "html", F.coalesce("keep_id", "page_id").alias("keep_id"))
    manifest = materialize(write_archives(marked, folder, archive_bytes, segment_bytes), "manifest")
    archives = max(1, manifest.count())
    records = read_records(manifest.repartition(min(archives, 10 * spark.sparkContext.defaultParallelism), "path"), folder)
    found = reassembled(records)
    found = found.select(
        F.when(F.col("fault").isNotNull(), F.raise_error(F.concat(F.col("record_id"), F.lit(": "), F.col("fault")))).otherwise(F.regexp_extract("record_id", r"^urn:page:(-?\d+|None):", 1)).alias("page"),
        F.octet_length("payload").cast("long").alias("payload_bytes"), "payload_digest", "record_type", F.regexp_extract("refers_to", r"^urn:page:(-?\d+|None)$", 1).alias("target"), "payload",
    )
    return found


def resolved(found: DataFrame) -> DataFrame:
    """Gives revisits the size and digest of the response they refer to; without payloads."""
    found = materialize(found.drop("payload"), "records")
    responses = found.where("record_type = 'response'").groupBy(F.col("page").alias("target"), "payload_digest").agg(F.max("payload_bytes").alias("full_bytes"))
    revisits = found.where("record_type = 'revisit'").select("page", "target", "payload_digest", "record_type")
    # one row for each response that has revisits, with their number
    asked = materialize(revisits.groupBy("target", "payload_digest").agg(F.count("*").alias("n")).join(responses, ["target", "payload_digest"], "left"), "asked")
    revisits = skew_join(revisits, asked, ["target", "payload_digest"], "n", found.count())
    revisits = revisits.select("page", F.col("full_bytes").alias("payload_bytes"), "payload_digest", "record_type", F.col("target").cast("long").alias("refers_to"))
    whole = found.where("record_type = 'response'").select("page", "payload_bytes", "payload_digest", "record_type", F.lit(None).cast("long").alias("refers_to"))
    return whole.unionByName(revisits).select(F.expr("try_cast(page AS bigint)").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


def op6_warc_segments(spark, sf_dir: str) -> DataFrame:
    return resolved(round_trip(documents_of(spark, sf_dir, "pages")))
