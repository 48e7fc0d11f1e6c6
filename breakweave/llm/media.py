"""Media columns: texts stored losslessly as WebP pixels and read back.

A payload is the UTF-8 text and bytes 255 up to a positive multiple of 576, so each row of an image is 144 R, G, B, A
pixels. A payload is one WebP file, which any reader of the format opens, up to the format's 16,383 rows (9.4 MB); a
longer one is as many files as it takes, one after the other, and ``n_files`` says how many. Reading takes any lossless
WebP file, and refuses one that ends early or whose prefix codes don't fit.

Defined results: null and empty texts have a payload of 576 bytes 255; equal texts give equal values; repeated rows
and repeated or null ids give as many rows; an empty table gives an empty table; a very long text is a step by itself,
its stream is decoded window by window, and beside its pixels and bytes it needs some 20 times its size to encode;
other columns, clashing names too, are ignored.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import by_steps, joined_bytes, text_rows
from .webp_lossless import decode_stream, encode, encode_rows, files, samples

ROW, WIDTH, ROWS = 576, 144, 16_383


def payload_of(text: np.ndarray) -> np.ndarray:
    """The bytes and 255 up to a positive multiple of a row."""
    n = max(1, -(-len(text) // ROW)) * ROW
    out = np.full(n, 255, np.uint8)
    out[: len(text)] = text
    return out


def store_rows(payload: np.ndarray) -> bytes:
    """One WebP file: literals under a fixed book, or, where pixels repeat much, a palette or colour cache and
    back-references if that is shorter."""
    plain = encode_rows(payload, WIDTH)
    px = payload.view(np.uint32)
    colours = len(np.unique(px)) if len(px) > WIDTH else len(px)
    if colours * 8 > len(px):
        return plain
    rgba = payload.reshape(-1, WIDTH, 4)
    packed = encode(rgba, (("palette",),), references=True) if colours <= 256 else encode(rgba, cache_bits=8, references=True)
    return min(plain, packed, key=len)


def store(payload: np.ndarray) -> bytes:
    """The payload's WebP files, one after the other."""
    return b"".join(store_rows(payload[i : i + ROWS * ROW]) for i in range(0, len(payload), ROWS * ROW))


def load(media: bytes) -> np.ndarray:
    """The samples of all files, as rows of pixels one below the other."""
    return np.concatenate([samples(decode_stream(f)) for f in files(media)])


def feature(px: np.ndarray) -> str:
    """Mean and deviation of each channel, the share of equal neighbours across and down, and the darkest and brightest sample."""
    flat = px.reshape(-1, 4).astype(np.int64)
    n = len(flat)
    mean = flat.sum(axis=0) / n
    dev = np.sqrt(np.maximum((flat**2).sum(axis=0) / n - mean**2, 0))
    across = (px[:, 1:] == px[:, :-1]).all(axis=2).mean() if px.shape[1] > 1 else 0.0
    down = (px[1:] == px[:-1]).all(axis=2).mean() if px.shape[0] > 1 else 0.0
    return ",".join(f"{x:.3f}" for x in (*mean, *dev, across, down)) + f",{flat.min()},{flat.max()}"


def encode_column(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_bytes, media): the stored form of every text."""

    def run(piece):
        data, at = joined_bytes(piece.column(1))
        media = [store(payload_of(data[a:b])) for a, b in zip(at[:-1], at[1:], strict=True)]
        return pa.RecordBatch.from_arrays([piece.column(0), pa.array(np.diff(at)), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])

    return text_rows(docs, text, doc_id).mapInArrow(by_steps("text", run, 1 << 20), "doc_id long, n_bytes long, media binary")


def decode_column(media: DataFrame, column: str = "media") -> DataFrame:
    """All columns, and pixels (bytes, row by row), width, height and feature of the stored images. Null: null."""

    def run(piece):
        out = []
        for m in piece.column(piece.schema.get_field_index(column)).to_pylist():
            out.append(load(m) if m else None)
        more = [
            pa.array([x if x is None else x.tobytes() for x in out], pa.binary()), pa.array([x if x is None else x.shape[1] for x in out], pa.int32()),
            pa.array([x if x is None else x.shape[0] for x in out], pa.int32()), pa.array([x if x is None else feature(x) for x in out], pa.string()),
        ]
        return pa.RecordBatch.from_arrays([*piece.columns, *more], [*piece.schema.names, "pixels", "width", "height", "feature"])

    schema = T.StructType([*media.schema.fields, T.StructField("pixels", T.BinaryType()), T.StructField("width", T.IntegerType()), T.StructField("height", T.IntegerType()), T.StructField("feature", T.StringType())])
    return media.mapInArrow(by_steps(column, run, 1 << 20), schema)


def digests(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature, n_files: encoded,
    stored form read back, and digests of what was read."""

    def run(piece):
        data, at = joined_bytes(piece.column(1))
        rows = []
        for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
            media = store(payload_of(data[a:b]))
            px = load(media)
            back = px.tobytes()
            rows.append((b - a, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-32:]), len(media), hashlib.sha256(media).hexdigest(), feature(px), len(files(media))))
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int32())
        names = ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "n_files"]
        columns = zip(*rows, strict=True) if rows else [()] * 8
        return pa.RecordBatch.from_arrays([piece.column(0), *[pa.array(c, t) for c, t in zip(columns, kinds, strict=True)]], ["doc_id", *names])

    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_files int"
    return text_rows(docs, text, doc_id).mapInArrow(by_steps("text", run, 1 << 20), schema)
