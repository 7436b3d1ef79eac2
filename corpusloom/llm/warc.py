"""WARC archives: a writer with revisit records, and a splittable reader.

Every record is a gzip member of its own; a file begins with a warcinfo record. The reader
deals byte ranges of the archives to tasks. A task scans its range for the gzip magic, tries
each place as a member by decoding the start of a WARC header from it, and owns the records
that start inside its range, reading past its end for the last one. No index or side file
is needed, and archives that others wrote a member per record are read as well.
"""

from __future__ import annotations

import hashlib
import posixpath
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.plans.scratch import Scratch, partitions

#: Fixed by the gzip format: magic, deflate.
MAGIC = b"\x1f\x8b\x08"
VERSION = b"WARC/1."
DATE = "1970-01-01T00:00:00Z"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

#: An archive is closed after so many bytes, a range has so many, and reads fetch so many at once.
FILE_BYTES = 256 << 20
SPLIT_BYTES = 16 << 20
READ_BYTES = 1 << 20


def _store(uri: str):
    """File system and path of a URI, as pyarrow opens it on executors."""
    from pyarrow import fs

    if "://" not in uri and not uri.startswith("file:"):
        return fs.LocalFileSystem(), uri
    scheme, rest = uri.split(":", 1)
    try:
        return fs.FileSystem.from_uri({"s3a": "s3", "s3n": "s3"}.get(scheme, scheme) + ":" + rest)
    except (pa.ArrowInvalid, pa.ArrowNotImplementedError) as error:
        raise ValueError(f"archives can't be kept at {uri}: their tasks open files through pyarrow, which does not know {scheme}") from error


def _record(fields: list[tuple[str, str]], block: bytes) -> bytes:
    """A WARC record as a gzip member."""
    head = "\r\n".join(["WARC/1.1", *(f"{name}: {value}" for name, value in fields), f"Content-Length: {len(block)}"])
    packer = zlib.compressobj(1, zlib.DEFLATED, 31)
    return packer.compress(head.encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + packer.flush()


def info_record(name: str) -> bytes:
    """The record that a file begins with."""
    fields = [("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, name)}>"), ("WARC-Date", DATE), ("WARC-Filename", name), ("Content-Type", "application/warc-fields")]
    return _record(fields, b"software: corpusloom\r\nformat: WARC File Format 1.1\r\n")


def page_record(place: str, page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, refers_to_url: str | None) -> bytes:
    """The record of a page: its payload behind an HTTP header, or, for a revisit, only digest and length.

    place: what no other record has, the file's name and the record's number there.
    """
    kind = "response" if refers_to is None else "revisit"
    one_line = lambda text: " ".join((text or "").split())
    fields = [("WARC-Type", kind), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, place)}>"), ("WARC-Date", DATE), ("WARC-Target-URI", one_line(url)), ("WARC-Payload-Digest", f"sha256:{digest}")]
    fields += [("X-Page-ID", "" if page_id is None else str(page_id)), ("X-Payload-Length", str(len(payload)))]
    fields.append(("Content-Type", "application/http; msgtype=response"))
    if kind == "revisit":
        fields += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To-Target-URI", one_line(refers_to_url)), ("WARC-Refers-To-Date", DATE), ("X-Refers-To-Page-ID", str(refers_to))]
        return _record(fields, b"")
    return _record(fields, b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload) + payload)


def plan_records(pages: DataFrame, scratch: Scratch, id_col: str, url_col: str, text_col: str, least: int) -> DataFrame:
    """(page_id, digest, refers_to, refers_to_url) of the pages that revisit another: same payload of at least ``least`` bytes, smallest id first."""
    payload = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.unhex(F.sha2(payload, 256)).alias("digest"), F.octet_length(payload).alias("size"))
    rows = scratch.table(rows.where((F.col("size") >= least) & F.col("page_id").isNotNull()), "digests")
    first = rows.groupBy("digest").agg(F.min(F.struct("page_id", "url")).alias("first"), F.count("*").alias("n")).where("n > 1")
    first = scratch.table(first.select("digest", F.col("first.page_id").alias("refers_to"), F.col("first.url").alias("refers_to_url")), "first")
    return scratch.table(rows.join(first, "digest").where("page_id <> refers_to").select("page_id", "digest", "refers_to", "refers_to_url").distinct(), "revisits")


def write_archives(pages: DataFrame, root: str, scratch: Scratch, id_col: str = "page_id", url_col: str = "url", text_col: str = "html", least: int = 100) -> DataFrame:
    """Writes the pages below ``root`` and returns the manifest (path, bytes) of the archives that hold them.

    Tasks write files of their own and name them only when they are whole, so archives of
    failed or repeated attempts are in no manifest. A null url or html counts as empty. A
    page without an id is a response and nothing revisits it. Rows that share an id but not
    the payload are judged each by its own payload; of repeated ids with equal payloads all
    rows that carry the smallest id are responses. An empty table gives an empty manifest.
    Other columns are ignored.
    """
    revisits = plan_records(pages, scratch, id_col, url_col, text_col, least)
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.coalesce(F.col(text_col), F.lit("")).alias("html"))
    rows = rows.withColumn("digest", F.unhex(F.sha2(F.col("html").cast("binary"), 256)))
    rows = rows.join(revisits, ["page_id", "digest"], "left").select("page_id", "url", "html", "digest", "refers_to", "refers_to_url")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, folder = _store(root)
        store.create_dir(folder, recursive=True)
        out, name, size, number = None, "", 0, 0
        done: list[tuple[str, int]] = []
        for batch in batches:
            for page_id, url, html, digest, refers_to, refers_to_url in zip(*(column.to_pylist() for column in batch.columns), strict=True):
                if out is None:
                    name, number = f"{uuid.uuid4().hex}.warc.gz", 0
                    out = store.open_output_stream(posixpath.join(folder, name), compression=None)
                    member = info_record(name)
                    out.write(member)
                    size = len(member)
                number += 1
                member = page_record(f"{name}/{number}", page_id, url, html.encode(), digest.hex(), refers_to, refers_to_url)
                out.write(member)
                size += len(member)
                if size >= FILE_BYTES:
                    out.close()
                    done.append((f"{root}/{name}", size))
                    out = None
        if out is not None:
            out.close()
            done.append((f"{root}/{name}", size))
        yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in done], pa.string()), pa.array([n for _, n in done], pa.int64())], names=["path", "bytes"])

    return scratch.table(rows.mapInArrow(run, "path string, bytes long"), "manifest")


class _Window:
    """Bytes of a file around a moving position, fetched READ_BYTES at a time."""

    def __init__(self, file, size: int):
        self.file, self.size, self.start, self.data = file, size, 0, b""

    def at(self, position: int, length: int) -> bytes:
        """Up to ``length`` bytes from ``position``; fewer at the end of the file."""
        length = min(length, self.size - position)
        if length <= 0:
            return b""
        if position < self.start or position + length > self.start + len(self.data):
            self.start = position
            self.data = bytes(self.file.read_at(min(max(length, READ_BYTES), self.size - position), position))
        return self.data[position - self.start : position - self.start + length]


def _member(window: _Window, at: int) -> tuple[bytes, int] | None:
    """Content and end of the gzip member at a place, or None where there is none of a WARC record."""
    unpack = zlib.decompressobj(31)
    parts: list[bytes] = []
    position, head = at, b""
    while not unpack.eof:
        chunk = window.at(position, 64 << 10)
        if not chunk:
            return None
        try:
            part = unpack.decompress(chunk)
        except zlib.error:
            return None
        parts.append(part)
        position += len(chunk)
        if len(head) < len(VERSION):
            head = (head + part)[: len(VERSION)]
            if not VERSION.startswith(head):
                return None
    return (b"".join(parts), position - len(unpack.unused_data)) if head == VERSION else None


def records_of(window: _Window, start: int, end: int) -> Iterator[bytes]:
    """The records that start in [start, end)."""
    at = start
    while at < end:
        if window.at(at, 3) != MAGIC:
            span = window.at(at, min(READ_BYTES, end + len(MAGIC) - 1 - at))
            found = span.find(MAGIC, 1)
            at = at + found if found > 0 else at + max(1, len(span) - len(MAGIC) + 1)
            if found <= 0:
                continue
            if at >= end:
                return
        got = _member(window, at)
        if got is None:
            at += 1
        else:
            yield got[0]
            at = got[1]


def whole_number(text: str | None) -> int | None:
    """The number that a header field states; None where that is no number of 64 bits."""
    return int(text) if re.fullmatch(r"-?[0-9]{1,18}", text or "") else None


def parse(data: bytes) -> tuple[dict[str, str], bytes] | None:
    """Header fields (names in lower case) and block of a record; None where the stated length is no length."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = {}
    for line in head.split(b"\r\n")[1:]:
        name, _, value = line.partition(b":")
        fields[name.strip().lower().decode("utf-8", "replace")] = value.strip().decode("utf-8", "replace")
    length = whole_number(fields.get("content-length", "0"))
    return None if length is None or length < 0 else (fields, rest[:length])


def payload_of(fields: dict[str, str], block: bytes) -> bytes:
    """What a record holds without the header of HTTP, if it has one, and without its chunk marks."""
    if not fields.get("content-type", "").replace(" ", "").startswith("application/http"):
        return block
    head, _, rest = block.partition(b"\r\n\r\n")
    if not re.search(rb"(?im)^transfer-encoding:[^\r\n]*\bchunked\b", head):
        return rest
    parts, at = [], 0
    while (end := rest.find(b"\r\n", at)) >= 0:
        size = re.match(rb"\s*([0-9a-fA-F]+)", rest[at:end])
        if size is None:
            return rest  # says that it is chunked, but is not
        n = int(size[1], 16)
        if not n:
            break
        parts.append(rest[end + 2 : end + 2 + n])
        at = end + 2 + n + 2
    return b"".join(parts)


def read_archives(spark: SparkSession, manifest: DataFrame, split_bytes: int = SPLIT_BYTES, payloads: bool = False, kinds: tuple[str, ...] = ("response", "revisit")) -> DataFrame:
    """One row per record of ``kinds`` in the archives of the manifest (path, bytes).

    page_id and refers_to are null where the header names none, as in archives of other
    writers. payload_bytes and payload_digest are of the full payload, without HTTP's header:
    measured from a record that has it, as stated in the header of a revisit (null if it
    states none; a digest that is not SHA-256 in hex is given as it stands). With
    ``payloads`` the payload comes too. Bytes that are no WARC member, and records whose
    length is not stated as a number, are passed over. An
    empty manifest gives no rows.
    """
    ranges = manifest.select("path", "bytes", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("bytes") - 1, F.lit(0)), F.lit(split_bytes).cast("long"))).alias("start"))
    ranges = ranges.repartition(partitions(spark), "path", "start")
    types = {"page_id": pa.int64(), "record_id": pa.string(), "url": pa.string(), "record_type": pa.string(), "refers_to": pa.int64(), "payload_bytes": pa.int64(), "payload_digest": pa.string()}
    schema = "page_id long, record_id string, url string, record_type string, refers_to long, payload_bytes long, payload_digest string"
    if payloads:
        types["payload"] = pa.binary()
        schema += ", payload binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(rows: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True)) or [()] * len(types)
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, types.values(), strict=True)], names=list(types))

        for batch in batches:
            for path, size, start in zip(*(column.to_pylist() for column in batch.columns), strict=True):
                store, inside = _store(path)
                rows: list[tuple] = []
                held = 0
                with store.open_input_file(inside) as file:
                    for data in records_of(_Window(file, size), start, min(start + split_bytes, size)):
                        parsed = parse(data)
                        if parsed is None:
                            continue
                        fields, block = parsed
                        kind = fields.get("warc-type", "")
                        if kind not in kinds:
                            continue
                        payload = payload_of(fields, block)
                        if kind == "revisit":
                            length, digest = whole_number(fields.get("x-payload-length")), fields.get("warc-payload-digest", "").removeprefix("sha256:") or None
                        else:
                            length, digest = len(payload), hashlib.sha256(payload).hexdigest()
                        row = (whole_number(fields.get("x-page-id")), fields.get("warc-record-id"), fields.get("warc-target-uri"), kind, whole_number(fields.get("x-refers-to-page-id")), length, digest)
                        rows.append((*row, payload) if payloads else row)
                        held += len(payload) * payloads
                        if len(rows) >= 4096 or held >= 16 << 20:
                            yield flush(rows)
                            rows, held = [], 0
                yield flush(rows)

    return ranges.mapInArrow(run, schema)
