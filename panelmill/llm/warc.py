"""WARC archives: a writer with revisit records and a reader that salvages damaged files.

Writing: each page is a response record in a gzip member of its own; pages whose payload repeats an
earlier one's (at least ``LEAST_BYTES`` long) become revisit records that name it. Members are
compressed before anything moves, so no page's text is shuffled. Spark's text sink
writes them, which gives task commits and any store that Spark knows; the separator between two
records is an empty gzip member, so a file is a plain sequence of members.

Reading: files are walked member by member (or version line by version line where they are not
compressed). A member that fails to inflate, a header that does not parse, a length or a digest that does
not fit sends the reader to the next place where a gzip magic or a version line stands and
a record can be read; what lies between is logged as a quarantined gap with its reason.

Edge cases: a null html is an empty payload; among equal (page_id, payload) rows one is the response;
a null page_id sorts last and is written as no id; a null or odd url is percent-encoded or left out; an
empty table writes no records, and an empty or wholly damaged file gives gaps only.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelmill.session import scratch_path

from .common import MAX_BROADCAST_IDS, hot_join, map_batches, ship, stored

LEAST_BYTES = 100
FILE_BYTES = 16 << 20
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_MAX_ID = (1 << 63) - 1
_START = re.compile(rb"\x1f\x8b\x08|WARC/1\.[01]\r?\n")
RECORDS = (
    "path string, start bigint, stop bigint, reason string, page_id bigint, url string, record_type string, "
    "payload_bytes bigint, payload_digest string, refers_to bigint, payload binary"
)


def _member(data: bytes) -> bytes:
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def _record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}/{digest}')}>"


def _record(kind: str, page_id: int | None, url: str | None, n: int, digest: str, block: bytes, extra: list[str]) -> bytes:
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {_record_id(page_id, digest)}", f"WARC-Date: {DATE}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + quote(url, safe="!#$%&'()*+,/:;=?@[]~"))
    if page_id is not None:
        lines.append(f"X-Page-Id: {page_id}")
    lines += [f"WARC-Payload-Digest: sha256:{digest}", f"X-Payload-Length: {n}", *extra, "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def response_record(page_id: int | None, url: str | None, payload: bytes, digest: str) -> bytes:
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    return _record("response", page_id, url, len(payload), digest, head + payload, [])


def revisit_record(page_id: int | None, url: str | None, n: int, digest: str, keep: int | None) -> bytes:
    extra = [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {_record_id(keep, digest)}"] + ([f"X-Refers-To-Page: {keep}"] if keep is not None else [])
    return _record("revisit", page_id, url, n, digest, b"HTTP/1.1 200 OK\r\n\r\n", extra)


def _compress(batch: pa.RecordBatch) -> pa.RecordBatch:
    sizes, digests, members = [], [], []
    for page_id, url, html in zip(*(c.to_pylist() for c in batch.columns), strict=True):
        payload = (html or "").encode("utf-8", "surrogatepass")
        sizes.append(len(payload))
        digests.append(hashlib.sha256(payload).hexdigest())
        members.append(_member(response_record(page_id, url, payload, digests[-1])))
    return pa.record_batch([batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(digests, pa.string()), pa.array(members, pa.binary())], ["page_id", "url", "n", "digest", "member"])


def write_archives(pages: DataFrame, path: str, file_bytes: int = FILE_BYTES) -> None:
    """Write *pages* (page_id, url, html) as gzip WARC files under *path*."""
    rows = map_batches(pages.select(F.col("page_id").cast("bigint"), F.col("url").cast("string"), "html"), _compress, "page_id bigint, url string, n bigint, digest string, member binary")
    rows = stored(rows.withColumn("row", F.monotonically_increasing_id()), "members")
    total, mean = rows.agg(F.count("*"), F.avg(F.length("member"))).first()
    light = rows.where(F.col("n") >= LEAST_BYTES).select("row", F.coalesce("page_id", F.lit(_MAX_ID)).alias("page"), "digest")
    groups = light.groupBy("digest").agg(F.min(F.struct("page", "row")).alias("first"), F.count("*").alias("_n")).where("_n > 1")
    again = hot_join(light, groups, ["digest"], "_n", max(1, total)).where("row <> first.row")
    again = stored(again.select(F.col("row").alias("_row"), F.nullif(F.col("first.page"), F.lit(_MAX_ID)).alias("keep")), "again")
    side = F.broadcast(again) if again.count() <= MAX_BROADCAST_IDS else again
    both = rows.join(side, rows["row"] == side["_row"], "left").select("page_id", "url", "n", "digest", "member", F.col("_row").isNotNull().alias("again"), "keep")

    def finish(batch: pa.RecordBatch) -> pa.RecordBatch:
        page, url, n, digest, member, twice, keep = (c.to_pylist() for c in batch.columns)
        out = [_member(revisit_record(page[i], url[i], n[i], digest[i], keep[i])) if twice[i] else member[i] for i in range(len(page))]
        return pa.record_batch([pa.array(out, pa.binary())], ["value"])

    lines = map_batches(both, finish, "value binary").select(F.expr("CAST(value AS STRING)").alias("value"))
    per_file = max(1, int(file_bytes // max(1.0, mean or 1.0)))
    (lines.write.option("lineSep", _member(b"").decode("latin-1")).option("encoding", "ISO-8859-1").option("maxRecordsPerFile", per_file).text(path))


class Damaged(Exception):
    """A record that fails a check."""


def _parse(data: bytes, at: int) -> tuple[dict, int]:
    """The record at *at* of *data* as a row, and where it ends; Damaged if a check fails."""
    if not re.compile(rb"WARC/1\.[01]\r\n").match(data, at):
        raise Damaged("no version line")
    end = data.find(b"\r\n\r\n", at)
    if end < 0:
        raise Damaged("header without end")
    try:
        fields = {k.strip().lower(): v.strip() for k, v in (line.split(":", 1) for line in data[at:end].decode("utf-8").split("\r\n")[1:])}
        length, stop = int(fields["content-length"]), end + 4 + int(fields["content-length"])
    except (ValueError, KeyError):
        raise Damaged("header does not parse") from None
    if length < 0 or data[stop : stop + 4] != b"\r\n\r\n":
        raise Damaged("length does not fit")
    block = data[end + 4 : stop]
    payload = block.partition(b"\r\n\r\n")[2] if fields.get("content-type", "").startswith("application/http") else block
    digest, kind = fields.get("warc-payload-digest", "").removeprefix("sha256:"), fields.get("warc-type")
    if kind == "response" and digest != hashlib.sha256(payload).hexdigest():
        raise Damaged("digest does not fit")
    number = lambda name: int(fields[name]) if fields.get(name, "").lstrip("-").isdigit() else None
    row = {"page_id": number("x-page-id"), "url": fields.get("warc-target-uri"), "record_type": kind,
           "payload_bytes": len(payload) if kind == "response" else number("x-payload-length"), "payload_digest": digest or None,
           "refers_to": number("x-refers-to-page"), "payload": payload if kind == "response" else None}
    return row, stop + 4


def salvage(data: bytes):
    """Rows (start, stop, reason, record) of a file; a row with a reason is a quarantined gap."""
    at, gap, why = 0, None, None
    while at < len(data):
        try:
            if data.startswith(b"\x1f\x8b\x08", at):
                member = zlib.decompressobj(31)
                try:
                    # A slice keeps the bytes behind the member from being copied for each one.
                    size, text = 1 << 16, b""
                    stop = at
                    while not member.eof and stop < len(data):
                        text += member.decompress(data[stop : stop + size])
                        stop += size
                        size *= 2
                except zlib.error:
                    raise Damaged("member does not inflate") from None
                if not member.eof:
                    raise Damaged("member is cut off")
                stop = min(stop, len(data)) - len(member.unused_data)
                found, inner = [], 0
                while inner < len(text):
                    row, inner = _parse(text, inner)
                    found.append(row)
            else:
                row, stop = _parse(data, at)
                found = [row]
        except Damaged as e:
            gap, why = (at, str(e)) if gap is None else (gap, why)
            after = _START.search(data, at + 1)
            at = after.start() if after else len(data)
            continue
        if gap is not None:
            yield gap, at, why, None
            gap = None
        for row in found:
            yield at, stop, None, row
        at = stop
    if gap is not None:
        yield gap, len(data), why, None


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """Records and gaps (``reason`` not null) of all files under *path*."""
    ship(spark)
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    names = [c.split()[0] for c in RECORDS.split(", ")]
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()]

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                name, out, held = batch.column(0)[i].as_py(), [], 0
                for start, stop, why, row in salvage(batch.column(1)[i].as_py()):
                    out.append({"path": name, "start": start, "stop": stop, "reason": why, **(row or {})})
                    held += len((row or {}).get("payload") or b"")
                    if held > 8 << 20:
                        yield pa.record_batch([pa.array([r.get(n) for r in out], t) for n, t in zip(names, kinds, strict=True)], names)
                        out, held = [], 0
                if out:
                    yield pa.record_batch([pa.array([r.get(n) for r in out], t) for n, t in zip(names, kinds, strict=True)], names)

    return files.mapInArrow(run, RECORDS)


def write_and_read(pages: DataFrame) -> DataFrame:
    """Write *pages* to the scratch folder and read the archives back."""
    path = scratch_path(pages.sparkSession, "warc")
    write_archives(pages, path)
    return read_archives(pages.sparkSession, path)
