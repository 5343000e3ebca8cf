"""WARC archives with a two-level capture index.

Archives. Pages are sorted by a reversed-host URL key (``com,example,www)/path``) and page_id over
range partitions; each task writes one archive, a gzip member a record. Of pages with equal payloads
the one with the smallest page_id is a response, the others are revisits that refer to it and hold
no payload. Smaller payloads than ``least`` are always responses.

Index. The task's captures, already in order, go to blocks of BLOCK lines, each compressed by itself
(first level). One row a block, with its first and last capture and its place, is the sparse directory
(second level), a Parquet table in order of keys. Look-ups are sorted and dealt to tasks by ranges of
keys. A task reads the part of the directory between its batch's ends, searches it by bisection, then
each block that is hit, and reads only that block's and the records' ranges of bytes. ``query`` looks
up every page so, by key and page_id.

A task writes under a name of its own, and only directory rows of tasks that ended well are used, so
that lost or repeated tasks leave nothing that is read.

Defined results
  null html         the empty payload
  null url          the key of an empty URL
  null page_id      a response if its payload has no page with an id; else a revisit
  repeated rows     rows that share the smallest page_id of a payload are all responses
  very long html    written and read whole
  empty table       no archives, no rows
  extra columns     not read
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import re
import uuid
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.dataset as pads
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

BLOCK = 512
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Repeated digests are sent to all executors up to this number (about 100 bytes each), else joined by a shuffle.
BROADCAST_DIGESTS = 200_000
DIRECTORY = "first_key binary, first_page long, last_key binary, last_page long, cdx string, warc string, offset long, length long, captures int"
#: A capture's place in the order of an index: its key, and its page_id with null first.
Place = tuple[bytes, bool, int]


def key_of(url: Column) -> Column:
    """Reversed host, then path and query; fragments, users and ports are left out."""
    url = F.coalesce(url, F.lit(""))
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]*)", 1))
    rest = F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)?([^#]*)", 1)
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), F.when(rest == "", "/").otherwise(rest))


def file_of(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith(("file:", "/")) else f"/{uri}")


def base32(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


# Records


def name_of(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def number_of(name: str) -> int | None:
    text = name.removeprefix("<urn:page:").removesuffix(">")
    return int(text) if text else None


def place_of(key: bytes, page_id: int | None) -> Place:
    return key, page_id is not None, page_id or 0


def record(page_id: int | None, url: str | None, payload: bytes, digest: bytes, refers_to: int | None, revisit: bool) -> bytes:
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    if not revisit:
        block += payload
    uri = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m.group()):02X}", url or "")
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {name_of(page_id)}",
        f"WARC-Target-URI: {uri}",
        f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha1:{base32(digest)}",
        *([f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {name_of(refers_to)}"] if revisit else []),
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def gzip_member(data: bytes) -> bytes:
    pack = zlib.compressobj(1, zlib.DEFLATED, 31)
    return pack.compress(data) + pack.flush()


def parse_record(member: bytes) -> dict:
    """A gzip member -> headers, and the payload's size, digest and bytes (None for revisits)."""
    data = zlib.decompress(member, 31)
    head, _, rest = data.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines)
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    revisit = fields["WARC-Type"] == "revisit"
    size = int(re.search(rb"Content-Length: (\d+)", http)[1])
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if not revisit and (len(payload) != size or base32(hashlib.sha1(payload).digest()) != digest):
        raise ValueError(f"the payload of {fields['WARC-Record-ID']} is damaged")
    return {"fields": fields, "payload": None if revisit else payload, "size": size, "digest": digest}


def archive(path: str, raw: bytes) -> list[bytes]:
    """All members of an archive's bytes, read one after another."""
    out = []
    while raw:
        unpack = zlib.decompressobj(31)
        unpack.decompress(raw)
        used = len(raw) - len(unpack.unused_data)
        out.append(raw[:used])
        raw = unpack.unused_data
    return out


# Writing


def typed(pages: DataFrame, least: int = 0) -> DataFrame:
    """pages -> (page_id, url, html, key, sha1, refers_to, revisit)."""
    html = F.coalesce("html", F.lit(""))
    full = pages.select("page_id", "url", html.alias("html"), key_of(F.col("url")).alias("key"), F.sha1(html.cast("binary")).alias("sha1"))
    repeated = (
        full.where(F.octet_length("html") >= least).groupBy("sha1").agg(F.count(F.lit(1)).alias("n"), F.min("page_id").alias("first")).where("n > 1").select("sha1", "first")
    )
    repeated = common.written(repeated, "digests")
    if repeated.count() <= BROADCAST_DIGESTS:
        repeated = F.broadcast(repeated)
    joined = full.join(repeated, "sha1", "left")
    revisit = F.col("first").isNotNull() & (F.col("page_id").isNull() | (F.col("page_id") > F.col("first")))
    return joined.withColumn("revisit", revisit).withColumn("refers_to", F.when(revisit, F.col("first"))).drop("first")


def write(pages: DataFrame, least: int = 0) -> str:
    """Writes archives and index to the shared folder -> the directory's folder."""
    spark = pages.sparkSession
    folder = common.scratch_path(spark, "warc")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = file_of(folder)
        store.create_dir(root, recursive=True)
        name = uuid.uuid4().hex
        warc = cdx = None
        at = cdx_at = 0
        lines: list[bytes] = []
        ends: list[tuple[bytes, int | None]] = []
        rows: list[tuple] = []

        def flush():
            nonlocal cdx_at, lines, ends
            packed = zlib.compress(b"\n".join(lines), 6)
            cdx.write(packed)
            rows.append((*ends[0], *ends[-1], f"{folder}/{name}.cdx", f"{folder}/{name}.warc.gz", cdx_at, len(packed), len(lines)))
            cdx_at += len(packed)
            lines, ends = [], []

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("page_id", "url", "key", "sha1", "refers_to", "revisit")]
            for html, page_id, url, key, sha1, refers_to, revisit in zip(common.texts(batch, "html"), *columns, strict=True):
                if warc is None:
                    warc, cdx = (store.open_output_stream(f"{root}/{name}.{x}", compression=None) for x in ("warc.gz", "cdx"))
                member = gzip_member(record(page_id, url, html, bytes.fromhex(sha1), refers_to, revisit))
                warc.write(member)
                lines.append(f"{key.encode().hex()} {'' if page_id is None else page_id} {at} {len(member)}".encode())
                ends.append((key.encode(), page_id))
                at += len(member)
                if len(lines) >= BLOCK:
                    flush()
        if warc is not None:
            if lines:
                flush()
            warc.close()
            cdx.close()
            kinds = [pa.binary(), pa.int64(), pa.binary(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int32()]
            names = ["first_key", "first_page", "last_key", "last_page", "cdx", "warc", "offset", "length", "captures"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    common.ship(spark)
    common.small_batches(spark)
    ordered = typed(pages, least).repartitionByRange("key", "page_id").sortWithinPartitions("key", "page_id")
    directory = common.scratch_path(spark, "warc-directory")
    ordered.mapInArrow(run, DIRECTORY).write.parquet(directory)
    return directory


# Reading


def block_lines(row: dict) -> list[tuple[Place, int | None, int, int]]:
    """A directory row -> its captures (place, page_id, offset, length), by a range read."""
    store, path = file_of(row["cdx"])
    with store.open_input_file(path) as file:
        packed = file.read_at(row["length"], row["offset"])
    out = []
    for line in zlib.decompress(packed).split(b"\n"):
        key, page, offset, length = line.split(b" ")
        page_id = int(page) if page else None
        out.append((place_of(bytes.fromhex(key.decode()), page_id), page_id, int(offset), int(length)))
    return out


class Directory:
    """The sparse directory, read by ranges of keys."""

    def __init__(self, folder: str):
        store, root = file_of(folder)
        self.table = pads.dataset(root, filesystem=store, format="parquet")

    def between(self, low: bytes, high: bytes) -> list[dict]:
        """Blocks that may hold keys from low to high, in order; Parquet statistics spare the rest."""
        held = (pc.field("first_key") <= pa.scalar(high, pa.binary())) & (pc.field("last_key") >= pa.scalar(low, pa.binary()))
        return sorted(self.table.to_table(filter=held).to_pylist(), key=lambda r: (place_of(r["first_key"], r["first_page"]), place_of(r["last_key"], r["last_page"]), r["offset"]))


def search(blocks: list[dict], wanted: list[tuple[Place, Place]]) -> Iterator[tuple[int, int | None, dict]]:
    """(number of the look-up, page_id, record) of all captures from one place to another, for sorted look-ups.

    Blocks are in order and do not overlap but at equal captures, so both their first and their last
    places are sorted; a block is read for the first look-up that hits it and kept for the next.
    """
    firsts = [place_of(r["first_key"], r["first_page"]) for r in blocks]
    lasts = [place_of(r["last_key"], r["last_page"]) for r in blocks]
    held: dict[int, tuple] = {}
    for number, (low, high) in enumerate(wanted):
        hit = range(bisect.bisect_left(lasts, low), bisect.bisect_right(firsts, high))
        held = {i: x for i, x in held.items() if i in hit}
        for i in hit:
            if i not in held:
                lines = block_lines(blocks[i])
                held[i] = lines, [x[0] for x in lines], file_of(blocks[i]["warc"])
            lines, places, (store, path) = held[i]
            inside = lines[bisect.bisect_left(places, low) : bisect.bisect_right(places, high)]
            if inside:
                with store.open_input_file(path) as file:
                    for _, page_id, offset, length in inside:
                        yield number, page_id, parse_record(file.read_at(length, offset))


def looked_up(folder: str, sought: DataFrame, order: list[str], bounds: Callable, row: Callable, fields: list[tuple[str, pa.DataType]], schema) -> DataFrame:
    """sought, dealt by ranges of the order and sorted -> row(sought row, page_id, record) for each capture
    between the bounds of a sought row. Rows of sought that are equal in the order count once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        directory, last = Directory(folder), None
        for batch in batches:
            rows = []
            for item in batch.to_pylist():
                mark = [item[c] for c in order]
                if mark != last:
                    rows.append(item)
                last = mark
            if not rows:
                continue
            wanted = [bounds(item) for item in rows]
            blocks = directory.between(wanted[0][0][0], wanted[-1][1][0])
            found = [row(rows[number], page_id, record_) for number, page_id, record_ in search(blocks, wanted)]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(zip(*found, strict=True), fields, strict=True)], names=[n for n, _ in fields])

    spark = sought.sparkSession
    common.ship(spark)
    common.small_batches(spark)
    # The number is given because a plan that merges small partitions would read all archives in one task.
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return sought.repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(run, schema)


def captures(folder: str, pages: DataFrame) -> DataFrame:
    """The captures of pages (page_id, url), each looked up by key and page_id: page_id, payload_bytes,
    payload_digest, record_type, refers_to. Pages that are equal in both have a capture each."""
    sought = pages.select(key_of(F.col("url")).cast("binary").alias("key"), "page_id")

    def bounds(item: dict) -> tuple[Place, Place]:
        place = place_of(item["key"], item["page_id"])
        return place, place

    def row(item: dict, page_id: int | None, found: dict) -> tuple:
        headers = found["fields"]
        if number_of(headers["WARC-Record-ID"]) != page_id:
            raise ValueError("index and archive disagree")
        refers = number_of(headers["WARC-Refers-To"]) if "WARC-Refers-To" in headers else None
        return page_id, found["size"], found["digest"], headers["WARC-Type"], refers

    fields = [("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())]
    return looked_up(folder, sought, ["key", "page_id"], bounds, row, fields, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def find(folder: str, urls: DataFrame) -> DataFrame:
    """All captures of some URLs (url) -> (url, page_id, record_type, payload); the payload of a revisit is null."""
    sought = urls.select(key_of(F.col("url")).cast("binary").alias("key"), "url")

    def bounds(item: dict) -> tuple[Place, Place]:
        return (item["key"], False, 0), (item["key"], True, 1 << 63)

    def row(item: dict, page_id: int | None, found: dict) -> tuple:
        return item["url"], page_id, found["fields"]["WARC-Type"], found["payload"]

    fields = [("url", pa.string()), ("page_id", pa.int64()), ("record_type", pa.string()), ("payload", pa.binary())]
    return looked_up(folder, sought, ["key", "url"], bounds, row, fields, "url string, page_id long, record_type string, payload binary")


def query(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return captures(write(pages), pages)
