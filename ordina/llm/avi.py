"""Media columns: AVI with motion-JPEG frames.

Reader. The RIFF tree gives the stream header and the index (idx1, or else an OpenDML ix00 index, or
else a walk over the movi list). A frame is a baseline JPEG: its segments are parsed, the scan is
Huffman-decoded, and the luma plane is rebuilt by an inverse DCT. Shots are cut where the difference
of two frames' 16-bin luma histograms exceeds an adaptive threshold, the mean plus CUT_SPREADS
standard deviations of the differences in the window before it (and MIN_CUT at least, which alone decides at the first); each shot is
a clip row with its times.

Storing a payload. One byte is one 8x8 block of constant luma, the format's own unit: with a DC
quantiser of 8 and no AC terms a block of constant value v has the coefficient v - 128 exactly, so
any JPEG decoder gets v back. The frame's Huffman table gives the DC category c a code of 9 - c
bits, so that each block takes 9 bits and one bit that ends it: such scans decode without a loop,
and all others take the general decoder.

Defined results
  null text       the empty text
  empty text      a payload of 64 zero bytes, one frame, one clip
  very long text  stored whole; work goes frame block by frame block
  equal texts     equal media, digests and features
  empty table     no rows
  extra columns   not read
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import common

SIDE = 16  # blocks on a frame's side
SAMPLES = SIDE * SIDE
FPS = 25
BINS = 16
WINDOW = 8
CUT_SPREADS, MIN_CUT = 2.0, 0.30
FRAMES = 2048  # frames handled at once
#: Files that a batch of the media column has at the most.
STORED_ROWS = 64

# Coefficient order of a scan.
ZIGZAG = np.array(sorted(range(64), key=lambda k: (k // 8 + k % 8, k // 8 if (k // 8 + k % 8) % 2 else k % 8)))


# JPEG


def segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def jpeg_header(width: int, height: int) -> bytes:
    quantiser = bytes([0]) + bytes([8] + [1] * 63)
    frame = struct.pack(">BHHB", 8, height, width, 1) + bytes([1, 0x11, 0])
    dc = bytes([0x00]) + bytes([1] * 9 + [0] * 7) + bytes(range(8, -1, -1))
    ac = bytes([0x10]) + bytes([1] + [0] * 15) + bytes([0])
    scan = bytes([1, 1, 0x00, 0, 63, 0])
    return b"\xff\xd8" + segment(0xDB, quantiser) + segment(0xC0, frame) + segment(0xC4, dc) + segment(0xC4, ac) + segment(0xDA, scan)


@lru_cache(maxsize=1)
def dc_codes() -> tuple[np.ndarray, np.ndarray]:
    """Difference + 255 -> its 9 bits; 9 bits -> difference."""
    codes, back = np.zeros(511, np.uint64), np.zeros(512, np.int16)
    for diff in range(-255, 256):
        size = abs(diff).bit_length()
        rank = 8 - size
        prefix = ((1 << rank) - 1) << 1  # rank ones and a zero
        extra = diff if diff >= 0 else diff + (1 << size) - 1
        code = prefix << size | extra
        codes[diff + 255], back[code] = code, diff
    return codes, back


def encode_frames(samples: np.ndarray) -> list[bytes]:
    """(frames, SAMPLES) bytes -> JPEG files."""
    n = len(samples)
    diff = np.diff(samples.astype(np.int16), axis=1, prepend=np.int16(128))
    ten = (dc_codes()[0][diff + 255] << np.uint64(1)).reshape(n, -1, 4)  # 9 bits and the end of the block
    forty = ten[..., 0] << np.uint64(30) | ten[..., 1] << np.uint64(20) | ten[..., 2] << np.uint64(10) | ten[..., 3]
    packed = forty.astype(">u8").view(np.uint8).reshape(n, -1, 8)[..., 3:].reshape(n, -1)
    head = jpeg_header(8 * SIDE, 8 * SIDE)
    return [head + row.tobytes().replace(b"\xff", b"\xff\x00") + b"\xff\xd9" for row in packed]


class Header(NamedTuple):
    width: int
    height: int
    components: tuple  # (id, h, v, quantiser)
    scan: tuple  # (component id, dc table, ac table)
    quantisers: dict
    tables: dict
    restart: int
    constant: bool  # one component, DC only, ten bits a block


def huffman(counts: bytes, values: bytes) -> dict:
    table, code, at = {}, 0, 0
    for length in range(1, 17):
        for _ in range(counts[length - 1]):
            table[length, code] = values[at]
            code, at = code + 1, at + 1
        code <<= 1
    return table


@lru_cache(maxsize=64)
def parse_header(head: bytes) -> Header:
    """The segments up to the scan's first byte."""
    quantisers, tables, at, restart = {}, {}, 2, 0
    width = height = 0
    components: tuple = ()
    scan: tuple = ()
    while at < len(head):
        marker, size = head[at + 1], int.from_bytes(head[at + 2 : at + 4], "big")
        body = head[at + 4 : at + 2 + size]
        at += 2 + size
        if marker == 0xDB:
            while body:
                wide = body[0] >> 4
                quantisers[body[0] & 15] = np.frombuffer(body[1 : 1 + 64 * (1 + wide)], ">u2" if wide else np.uint8).astype(np.int64)
                body = body[1 + 64 * (1 + wide) :]
        elif marker in (0xC0, 0xC1):
            height, width = struct.unpack(">HH", body[1:5])
            components = tuple((body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(body[5]))
        elif marker == 0xC4:
            while body:
                total = sum(body[1:17])
                tables[body[0]] = huffman(body[1:17], body[17 : 17 + total])
                body = body[17 + total :]
        elif marker == 0xDD:
            restart = int.from_bytes(body[:2], "big")
        elif marker == 0xDA:
            scan = tuple((body[1 + 2 * i], body[2 + 2 * i] >> 4, body[2 + 2 * i] & 15) for i in range(body[0]))
        elif marker in (0xC2, 0xC3, *range(0xC5, 0xC8), *range(0xC9, 0xD0)):
            raise ValueError("only baseline frames are decoded")
    own = dict(((9 - c, (1 << (9 - c)) - 2), c) for c in range(9))
    plain = len(components) == 1 and not restart and quantisers[components[0][3]][0] == 8 and tables.get(scan[0][1]) == own and tables.get(16 + scan[0][2]) == {(1, 0): 0}
    return Header(width, height, components, scan, quantisers, tables, restart, plain)


def split_jpeg(data: bytes) -> tuple[Header, bytes]:
    """Header, and the scan with byte stuffing removed (restart markers stay)."""
    at = 2
    while data[at + 1] != 0xDA:
        at += 2 + int.from_bytes(data[at + 2 : at + 4], "big")
    at += 2 + int.from_bytes(data[at + 2 : at + 4], "big")
    end = data.rindex(b"\xff\xd9")
    return parse_header(data[:at]), data[at:end]


@lru_cache(maxsize=1)
def cosines() -> np.ndarray:
    k = np.arange(8)
    basis = np.cos((2 * k[:, None] + 1) * k[None] * np.pi / 16) / 2
    basis[:, 0] /= np.sqrt(2)
    return basis


def decode_general(header: Header, scan: bytes) -> np.ndarray:
    """Luma plane of a baseline frame; other components are decoded and dropped."""
    wide, high = max(c[1] for c in header.components), max(c[2] for c in header.components)
    per_row, rows = -(-header.width // (8 * wide)), -(-header.height // (8 * high))
    luma = header.components[0]
    plane = np.zeros((rows * luma[2] * 8, per_row * luma[1] * 8))
    chunks, at = [], 0
    while True:  # restart markers part the scan
        found = next((i for i in range(at, len(scan) - 1) if scan[i] == 0xFF and 0xD0 <= scan[i + 1] <= 0xD7), -1) if header.restart else -1
        chunks.append(scan[at : found if found >= 0 else len(scan)].replace(b"\xff\x00", b"\xff"))
        if found < 0:
            break
        at = found + 2
    by_id = {c[0]: c for c in header.components}
    basis, unit, total = cosines(), 0, per_row * rows
    for chunk in chunks:
        bits, length, place = int.from_bytes(chunk, "big"), 8 * len(chunk), 0
        last = dict.fromkeys(by_id, 0)

        def take(n, bits=bits, length=length):
            nonlocal place
            place += n
            return bits >> (length - place) & ((1 << n) - 1) if place <= length else (1 << n) - 1

        def symbol(table):
            code = 0
            for size in range(1, 17):
                code = code << 1 | take(1)
                if (size, code) in table:
                    return table[size, code]
            raise ValueError("no such code")

        def signed(size):
            value = take(size) if size else 0
            return value if not size or value >> (size - 1) else value - (1 << size) + 1

        for _ in range(min(header.restart or total, total - unit)):
            for name, dc, ac in header.scan:
                _, h, v, q = by_id[name]
                for block in range(h * v):
                    terms = np.zeros(64)
                    last[name] += signed(symbol(header.tables[dc]))
                    terms[0], k = last[name], 1
                    while k < 64:
                        both = symbol(header.tables[16 + ac])
                        if not both:
                            break
                        k += both >> 4
                        if both & 15:
                            terms[k] = signed(both & 15)
                        k += 1
                    if name == luma[0]:
                        square = np.zeros(64)
                        square[ZIGZAG] = terms * header.quantisers[q]
                        y, x = (unit // per_row * v + block // h) * 8, (unit % per_row * h + block % h) * 8
                        plane[y : y + 8, x : x + 8] = basis @ square.reshape(8, 8) @ basis.T + 128
            unit += 1
    return np.clip(np.rint(plane[: header.height, : header.width]), 0, 255).astype(np.uint8)


def decode_frames(frames: list[bytes]) -> list[np.ndarray]:
    """Per frame, the luma value of each 8x8 block's first sample where blocks are constant; else the plane."""
    parts, out = [split_jpeg(f) for f in frames], [None] * len(frames)
    plain = [i for i, (h, _) in enumerate(parts) if h.constant]
    groups: dict[int, list[int]] = {}
    for i in plain:
        groups.setdefault(-(-parts[i][0].width // 8) * -(-parts[i][0].height // 8), []).append(i)
    for blocks, members in groups.items():
        size = -(-blocks * 10 // 8)
        packed = np.frombuffer(b"".join(parts[i][1].replace(b"\xff\x00", b"\xff")[:size].ljust(size, b"\0") for i in members), np.uint8).reshape(len(members), size)
        at = np.arange(blocks) * 10
        padded = np.concatenate((packed, np.zeros((len(members), 2), np.uint8)), axis=1)
        two = padded[:, at // 8].astype(np.uint16) << 8 | padded[:, at // 8 + 1]
        nine = two >> (7 - at % 8).astype(np.uint16) & 511
        values = (np.cumsum(dc_codes()[1][nine], axis=1) + 128).astype(np.uint8)
        for row, i in enumerate(members):
            out[i] = values[row]
    for i, (header, scan) in enumerate(parts):
        if out[i] is None:
            out[i] = decode_general(header, scan)
    return out


# RIFF


def chunk(name: bytes, body: bytes) -> bytes:
    return name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) & 1)


def write_avi(payload: bytes) -> bytes:
    """An AVI file whose frames hold the payload, a byte a block; the last frame is filled with zeros."""
    frames: list[bytes] = []
    for at in range(0, len(payload), FRAMES * SAMPLES):
        part = np.frombuffer(payload[at : at + FRAMES * SAMPLES], np.uint8)
        part = np.pad(part, (0, -len(part) % SAMPLES)).reshape(-1, SAMPLES)
        frames += encode_frames(part)
    side, largest = 8 * SIDE, max(map(len, frames))
    avih = struct.pack("<14I", 1_000_000 // FPS, largest * FPS, 0, 0x10, len(frames), 0, 1, largest, side, side, 0, 0, 0, 0)
    strh = b"vidsMJPG" + struct.pack("<IHHIIIIIIIIHHHH", 0, 0, 0, 0, 1, FPS, 0, len(frames), largest, 0xFFFFFFFF, 0, 0, 0, side, side)
    strf = struct.pack("<IiiHH4sIiiII", 40, side, side, 1, 24, b"MJPG", side * side * 3, 0, 0, 0, 0)
    header = chunk(b"LIST", b"hdrl" + chunk(b"avih", avih) + chunk(b"LIST", b"strl" + chunk(b"strh", strh) + chunk(b"strf", strf)))
    info = chunk(b"LIST", b"INFO" + chunk(b"ICMT", b"payload %d\0" % len(payload)))
    movi, index, at = [], [], 4
    for frame in frames:
        body = chunk(b"00dc", frame)
        index.append(struct.pack("<4sIII", b"00dc", 0x10, at, len(frame)))
        movi.append(body)
        at += len(body)
    return chunk(b"RIFF", b"AVI " + header + info + chunk(b"LIST", b"movi" + b"".join(movi)) + chunk(b"idx1", b"".join(index)))


class Media(NamedTuple):
    frames: list[bytes]
    seconds_per_frame: float
    payload_bytes: int | None


def walk(data: bytes, start: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    """(name, start, end) of the chunks in a range; a chunk that runs over the end is cut there."""
    while start + 8 <= end:
        name, size = data[start : start + 4], int.from_bytes(data[start + 4 : start + 8], "little")
        yield name, start + 8, min(start + 8 + size, end)
        start += 8 + size + (size & 1)


def read_avi(data: bytes) -> Media:
    """Video frames by the file's index."""
    if data[:4] != b"RIFF" or data[8:12] != b"AVI ":
        raise ValueError("not an AVI file")
    movi, index, seconds, payload, standard = None, None, 1 / FPS, None, None
    for name, a, b in walk(data, 12, len(data)):
        kind = data[a : a + 4] if name == b"LIST" else b""
        if kind == b"hdrl":
            for sub, c, d in walk(data, a + 4, b):
                if sub == b"avih":
                    seconds = int.from_bytes(data[c : c + 4], "little") / 1e6 or seconds
                elif sub == b"LIST" and data[c : c + 4] == b"strl":
                    for leaf, e, _ in walk(data, c + 4, d):
                        if leaf == b"strh" and data[e : e + 4] == b"vids":
                            scale, rate = struct.unpack("<II", data[e + 20 : e + 28])
                            seconds = scale / rate if scale and rate else seconds
        elif kind == b"INFO":
            for leaf, c, d in walk(data, a + 4, b):
                if leaf == b"ICMT" and data[c:d].startswith(b"payload "):
                    payload = int(data[c + 8 : d].rstrip(b"\0"))
        elif kind == b"movi":
            movi = (a, b)
            standard = next(((c, d) for leaf, c, d in walk(data, a + 4, b) if leaf[:2] == b"ix"), None) if b"ix00" in data[a : a + 16] else None
        elif name == b"idx1":
            index = (a, b)
    if movi is None:
        raise ValueError("no movi list")
    video = lambda name: name[2:] in (b"dc", b"db")
    if index:
        entries = [(n, o, s) for n, _, o, s in struct.iter_unpack("<4sIII", data[index[0] : index[0] + (index[1] - index[0]) // 16 * 16]) if video(n)]
        base = movi[0]  # offsets count from the list's kind, or from the start of the file
        if entries and data[base + entries[0][1] : base + entries[0][1] + 4] != entries[0][0]:
            base = 0
        frames = [data[base + o + 8 : base + o + 8 + s] for _, o, s in entries]
    elif standard:
        count, _, base = struct.unpack("<I4sQ", data[standard[0] + 4 : standard[0] + 20])
        frames = [data[base + o : base + o + (s & 0x7FFFFFFF)] for o, s in struct.iter_unpack("<II", data[standard[0] + 24 : standard[0] + 24 + 8 * count])]
    else:
        frames = [data[a:b] for name, a, b in walk(data, movi[0] + 4, movi[1]) if video(name)]
    return Media(frames, seconds, payload)


# Shots


def shots(histograms: np.ndarray) -> list[tuple[int, int]]:
    """Frames' histograms (rows sum to 1) -> [start, end) of each shot."""
    n = len(histograms)
    if n < 2:
        return [(0, n)] if n else []
    diff = np.abs(np.diff(histograms, axis=0)).sum(axis=1) / 2
    sums, squares = (np.concatenate(([0.0], np.cumsum(x))) for x in (diff, diff * diff))
    at = np.arange(n - 1)
    low = np.maximum(0, at - WINDOW)
    size = np.maximum(1, at - low)
    mean = (sums[at] - sums[low]) / size
    spread = np.sqrt(np.maximum(0, (squares[at] - squares[low]) / size - mean * mean))
    cuts = np.flatnonzero(diff > np.maximum(MIN_CUT, mean + CUT_SPREADS * spread)) + 1
    edges = [0, *cuts.tolist(), n]
    return list(zip(edges, edges[1:], strict=False))


def analysed(data: bytes) -> tuple[bytes, list[tuple[int, int]], Media]:
    """An AVI file -> samples in frame order, shots, and what the file says of itself."""
    media = read_avi(data)
    samples, hists = [], []
    for at in range(0, len(media.frames), FRAMES):
        part = decode_frames(media.frames[at : at + FRAMES])
        if len({p.size for p in part}) == 1:
            flat = np.stack([p.ravel() for p in part])
            bins = (flat >> 4).astype(np.int64) + np.arange(len(part))[:, None] * BINS
            hists.append(np.bincount(bins.ravel(), minlength=len(part) * BINS).reshape(-1, BINS) / flat.shape[1])
        else:
            hists.append(np.stack([np.bincount(p.ravel() >> 4, minlength=BINS) / p.size for p in part]))
        samples += [p.tobytes() for p in part]
    stored = b"".join(samples)
    return stored if media.payload_bytes is None else stored[: media.payload_bytes], shots(np.concatenate(hists) if hists else np.empty((0, BINS))), media


def clips(media: DataFrame) -> DataFrame:
    """(doc_id, avi binary) -> one row per clip: doc_id, clip, frames and times. A null file has none."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        rows = []
        for key, data in zip(batch.column("doc_id").to_pylist(), batch.column("avi").to_pylist(), strict=True):
            if data is not None:
                _, found, of = analysed(data)
                rows += [(key, i, a, b, a * of.seconds_per_frame, b * of.seconds_per_frame) for i, (a, b) in enumerate(found)]
        names, kinds = ["doc_id", "clip", "start_frame", "end_frame", "start_s", "end_s"], [batch.column("doc_id").type] + [pa.int64()] * 3 + [pa.float64()] * 2
        columns = list(zip(*rows, strict=True)) if rows else [[]] * 6
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    return common.map_arrow(media.select("doc_id", "avi"), run, common.with_id(media, "clip long, start_frame long, end_frame long, start_s double, end_s double"))


def payload_of(raw: bytes | None) -> bytes:
    raw = raw or b""
    return raw.ljust(max(64, -(-len(raw) // 64) * 64), b"\0")


def stored(docs: DataFrame) -> DataFrame:
    """docs -> (doc_id, n_bytes, avi): each text's length in bytes, and its payload as an AVI file."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for at in range(0, batch.num_rows, STORED_ROWS):
            part = batch.slice(at, STORED_ROWS)
            texts = common.texts(part)
            columns = [part.column("doc_id"), pa.array([len(x or b"") for x in texts], pa.int64()), pa.array([write_avi(payload_of(x)) for x in texts], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_bytes", "avi"])

    return common.map_arrow(docs.select("doc_id", "text"), run, common.with_id(docs, "n_bytes long, avi binary"))


def digests(docs: DataFrame) -> DataFrame:
    """Reads the media column of ``stored`` back and returns digests of what was read, with the clips as the feature."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        rows = []
        for avi in batch.column("avi"):
            avi = avi.as_py()
            payload, found, of = analysed(avi)
            feature = f"frames={len(of.frames)};clips=" + ",".join(f"{a * of.seconds_per_frame:.2f}-{b * of.seconds_per_frame:.2f}" for a, b in found)
            rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(avi), hashlib.sha256(avi).hexdigest(), feature))
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), *columns], names=["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    schema = common.with_id(docs, "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
    return common.map_arrow(stored(docs), run, schema)


def query(spark, sf_dir: str) -> DataFrame:
    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet"))
