"""Byte-level BPE encoding and decoding with tiktoken and a local rank file.

tiktoken's regular expression engine overflows its stack on very long runs, and a caller may have
texts of any length. Long texts are therefore cut first, only where a match of the pattern always
ends: after a letter before anything else than a letter, after a digit before anything else than a
digit, and after any other visible character before white space. The pieces' ids, joined, are those of the whole text. A
run that such cuts leave too long for the engine (one match in itself, like a million spaces) is
given to the merges as the matches that the pattern makes of it.

Defined results
  null text       encoded as the empty text: no ids
  empty text      no ids
  very long text  as above; never shortened
  repeated rows   each encoded
  empty table     no rows
  extra columns   not read; ``encoded`` keeps all input columns and refuses clashes
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from . import common

#: Texts beyond this many characters are cut at safe boundaries into pieces of about this length.
PIECE = 20_000
#: A match beyond this many characters is merged by itself, without tiktoken's own splitting.
LONG_MATCH = 20_000
SAFE = regex.compile(r"(?<=\p{L})(?=\P{L})|(?<=\p{N})(?=\P{N})|(?<=[^\s\p{L}\p{N}])(?=\s)")


@lru_cache(maxsize=4)
def encoding(path: str | None = None, pattern: str | None = None):
    """A tiktoken encoding from a rank file; the public 50k byte-level ranks by default."""
    import public_tokenizers
    import tiktoken

    with open(path or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as file:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
    return tiktoken.Encoding("local", pat_str=pattern or public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def pieces(text: str, length: int = PIECE) -> Iterator[str]:
    """text in pieces that are cut at safe boundaries; longer ones where there is no boundary."""
    start = 0
    while len(text) - start > length:
        found = SAFE.search(text, start + length)
        if not found:
            break
        yield text[start : found.start()]
        start = found.start()
    yield text[start:]


def encode(text: str, path: str | None = None, pattern: str | None = None) -> list[int]:
    """The ids that tiktoken gives for the whole text, special tokens off."""
    enc = encoding(path, pattern)
    if len(text) <= PIECE:
        return enc.encode_ordinary(text)
    ids: list[int] = []
    for piece in pieces(text):
        if len(piece) <= 2 * PIECE:
            ids += enc.encode_ordinary(piece)
        else:  # no boundary for long: the pattern's matches one by one
            for match in regex.finditer(enc._pat_str, piece):
                ids += encode_match(enc, match.group())
    return ids


def encode_match(enc, match: str) -> list[int]:
    return enc.encode_ordinary(match) if len(match) <= LONG_MATCH else enc._encode_single_piece(match.encode("utf-8"))


def decode(ids: list[int], path: str | None = None) -> bytes:
    """The bytes that the ids stand for; they need not be valid UTF-8."""
    return encoding(path).decode_bytes(ids)


@lru_cache(maxsize=1)
def decimal(size: int) -> list[bytes]:
    return [b"%d" % i for i in range(size)]


def digest(batch: pa.RecordBatch, path: str | None = None) -> Iterator[pa.RecordBatch]:
    names, rows = decimal(encoding(path).n_vocab), ([], [], [])
    for raw in common.texts(batch):
        ids = encode(common.decoded(raw), path)
        rows[0].append(len(ids))
        rows[1].append(hashlib.sha256(b" ".join([names[i] for i in ids])).hexdigest())
        rows[2].append(hashlib.sha256(decode(ids, path)).hexdigest())
    yield pa.RecordBatch.from_arrays(
        [batch.column("doc_id"), pa.array(rows[0], pa.int64()), pa.array(rows[1], pa.string()), pa.array(rows[2], pa.string())],
        names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
    )


def encoded(docs: DataFrame, path: str | None = None, column: str = "token_ids") -> DataFrame:
    """docs with the ids of their text as an array<int> in a new last column, whose name gets underscores
    as long as the input has one of that name."""
    while column.lower() in {c.lower() for c in docs.columns}:
        column += "_"
    schema = common.extended(docs.schema, f"{column} array<int>")

    def run(batch):
        ids = pa.array([encode(common.decoded(raw), path) for raw in common.texts(batch)], pa.list_(pa.int32()))
        yield pa.RecordBatch.from_arrays([*batch.columns, ids], names=[*batch.schema.names, column])

    return common.map_arrow(docs, run, schema)


def digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Per document: number of ids, digest of the ids, digest of the decoded bytes."""
    return common.map_arrow(
        docs.select("doc_id", "text"), lambda batch: digest(batch, path), common.with_id(docs, "n_tokens long, ids_sha256 string, decoded_sha256 string")
    )


def query(spark, sf_dir: str) -> DataFrame:
    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet"))
