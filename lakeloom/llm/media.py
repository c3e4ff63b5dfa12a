"""Texts as lossless media columns: payloads stored as WebP images, read back and described."""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, webp

#: Payloads are padded to a multiple of ALIGN bytes, which is one row of COLUMNS pixels of four samples.
ALIGN, COLUMNS = 64, 16
#: Bytes of one image: the format's most rows. A longer payload becomes several files one after the other.
MOST = ALIGN << 14


def payload(text: bytes | None) -> bytes:
    text = text or b""
    return text + bytes(-len(text) % ALIGN if text else ALIGN)


def to_media(data: bytes) -> bytes:
    """WebP files, one after the other, that hold the payload's bytes as samples (blue, green, red, alpha)."""
    return b"".join(webp.encode_best(np.frombuffer(data, np.uint8, len(data[i : i + MOST]), i).reshape(-1, COLUMNS, 4)) for i in range(0, len(data), MOST))


def files(media: bytes) -> list[bytes]:
    """Concatenated WebP files one by one."""
    out, at = [], 0
    while at < len(media):
        end = at + 8 + int.from_bytes(media[at + 4 : at + 8], "little")
        out.append(media[at:end])
        at = end
    return out


def images(stored: list[bytes]) -> list[list[np.ndarray]]:
    """The pixel arrays of each entry's files; all are decoded together."""
    parts = [files(m) for m in stored]
    pixels = iter(webp.decode_many([f for p in parts for f in p]))
    return [[next(pixels) for _ in p] for p in parts]


def feature(pixels: list[np.ndarray]) -> str:
    """Size, mean of each channel and entropy of the samples, from the pixel arrays."""
    flat = [p.reshape(-1, 4) for p in pixels]
    rows = sum(p.shape[0] for p in pixels)
    n = sum(len(p) for p in flat)
    mean = sum(p.sum(0, dtype=np.int64) for p in flat) / n
    share = sum(np.bincount(p.reshape(-1), minlength=256) for p in flat) / (4 * n)
    share = share[share > 0]
    return f"{pixels[0].shape[1]}x{rows};bgra=" + ",".join(f"{m:.3f}" for m in mean) + f";entropy={abs(-(share * np.log2(share)).sum()):.4f}"


def encoder():
    """A UDF: text -> struct(n_bytes, media)."""

    def start():
        def run(texts: list[bytes | None]):
            return pa.array([len(t or b"") for t in texts], pa.int64()), pa.array([to_media(payload(t)) for t in texts], pa.binary())

        return run

    return common.text_udf(start, "n_bytes bigint, media binary", raw=True)


def reader():
    """A UDF: stored media -> struct(payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature)."""

    def start():
        def run(stored: list[bytes]):
            rows = []
            for m, pixels in zip(stored, images(stored), strict=True):
                data = b"".join(p.tobytes() for p in pixels)
                rows.append((len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-ALIGN:]), len(m), hashlib.sha256(m).hexdigest(), feature(pixels)))
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            return [pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)]

        return run

    return common.text_udf(start, "payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string", raw=True)


def write(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A written table (id, n_bytes, media) of docs; a null text is an empty one."""
    common.prepare(docs.sparkSession)
    coded = docs.select(F.col(id_col).alias("id"), encoder()(F.col(text_col)).alias("m"))
    return common.stored(coded.select("id", "m.n_bytes", "m.media"), "media", compression="zstd")


def describe(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, n_bytes, and what reader() finds in the stored bytes. Equal texts give equal values.

    A null text is an empty one, which is a payload of 64 zeros. Repeated rows have rows of their own; an empty table gives an
    empty one; no other column is read. A payload over 1 MiB is stored as several WebP files, one after the other.
    """
    stored = write(docs, id_col, text_col)
    read = stored.select(F.col("id").alias(id_col), "n_bytes", reader()(F.col("media")).alias("r"))
    return read.select(id_col, "n_bytes", "r.*")
