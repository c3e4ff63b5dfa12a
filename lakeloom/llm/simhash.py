"""Near-duplicates by SimHash fingerprints with Golay-code fuzzy hashing.

A 64-bit fingerprint is cut into four blocks of 16 bits. Of at most 3 differing bits, some block has none;
the other 48 bits hold two segments of 23, of which one has at most one (pigeonhole). The keys are therefore:
block number and segment number, the block's bits, and the indices of the Golay codewords near the segment
(one or six, see golay). Fingerprints that share a key meet in a bucket and are verified. A bucket yields the
edges of a spanning forest, never its pairs: each fingerprint that is reached is compared with those that are
not yet reached.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, golay
from .graph import components

SEED, MAX_BITS = 42, 3
#: Shingle hashes that are spread into bits at once.
HASHES = 1 << 16
#: Bits of each block, and of the two segments among the bits outside it.
BLOCK, SEGMENTS = 16, ((0, 23), (23, 23))


def fingerprints(texts: list[bytes | None], shingle: int) -> np.ndarray:
    """Unsigned 64-bit fingerprints of lower-cased word shingles; 0 for a text without words."""
    from xxhash import xxh64_intdigest

    ones, counts = np.zeros((len(texts), 64), np.int64), np.zeros(len(texts), np.int64)
    hashes: list[int] = []
    owner: list[tuple[int, int]] = []

    def add() -> None:
        bits = np.unpackbits(np.array(hashes, np.uint64).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        sizes = np.array([c for _, c in owner])
        np.add.at(ones, [n for n, _ in owner], np.add.reduceat(bits, np.cumsum(sizes) - sizes, axis=0, dtype=np.int64))
        hashes.clear()
        owner.clear()

    for n, t in enumerate(texts):
        words = (t or b"").lower().split()
        if not words:
            continue
        flat = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate([[0], ends[:-1] + 1])
        counts[n] = max(1, len(words) - shingle + 1)
        last = ends[shingle - 1 :] if len(words) > shingle else ends[-1:]
        for a in range(0, int(counts[n]), HASHES):
            spans = map(slice, starts[a : min(a + HASHES, int(counts[n]))].tolist(), last[a : a + HASHES].tolist())
            before = len(hashes)
            hashes.extend(map(xxh64_intdigest, map(flat.__getitem__, spans), repeat(SEED)))
            owner.append((n, len(hashes) - before))
            if len(hashes) >= HASHES:
                add()
    if owner:
        add()
    return np.packbits(ones * 2 > counts[:, None], axis=1, bitorder="little").view(np.uint64).reshape(-1)


def fingerprint(shingle: int):
    """A UDF: text -> struct(bits), the fingerprint as a signed 64-bit number."""

    def start():
        def run(texts: list[bytes | None]):
            return (fingerprints(texts, shingle).view(np.int64),)

        return run

    return common.text_udf(start, "bits bigint")


def bucket_keys(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(fingerprint's place, key) of every key: 8 to 48 a fingerprint."""
    places, out = [], []
    for block in range(64 // BLOCK):
        at = np.uint64(block * BLOCK)
        own = (prints >> at).astype(np.int64) & ((1 << BLOCK) - 1)
        low = prints & np.uint64((1 << (block * BLOCK)) - 1)
        high = (prints >> np.uint64(min(63, (block + 1) * BLOCK))) if block < 3 else np.zeros_like(prints)
        rest = (low | (high << at)).astype(np.int64)
        for k, (shift, bits) in enumerate(SEGMENTS):
            near = golay.keys((rest >> shift) & ((1 << bits) - 1))
            row, col = np.nonzero(near >= 0)
            places.append(row)
            out.append(((block * len(SEGMENTS) + k) << 28) | (own[row] << 12) | near[row, col])
    return np.concatenate(places), np.concatenate(out)


def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        bits = batch.column(0).to_numpy(zero_copy_only=False)
        row, key = bucket_keys(bits.view(np.uint64))
        yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(bits[row])], names=["key", "bits"])


def forest(prints: np.ndarray, max_bits: int) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the links within a bucket. Each place that is reached is compared with the unreached ones only."""
    edges: list[tuple[int, int]] = []
    left = np.arange(len(prints))
    while len(left) > 1:
        stack, left = [int(left[0])], left[1:]
        while stack and len(left):
            u = stack.pop()
            near = np.bitwise_count(prints[left] ^ prints[u]) <= max_bits
            if near.any():
                found = left[near].tolist()
                edges.extend((u, v) for v in found)
                stack += found
                left = left[~near]
    return edges


def linked(max_bits: int):
    """Edges of the buckets of rows (key, bits) that are sorted by key."""

    def edges_of(key: np.ndarray, bits: np.ndarray) -> pa.RecordBatch:
        first = np.flatnonzero(np.diff(key, prepend=key[0] - 1 if len(key) else 0))
        size = np.diff(first, append=len(key))
        prints = bits.view(np.uint64)
        two = first[size == 2]
        two = two[np.bitwise_count(prints[two] ^ prints[two + 1]) <= max_bits]
        us, vs = [bits[two]], [bits[two + 1]]
        for a, n in zip(first[size > 2].tolist(), size[size > 2].tolist(), strict=True):
            if pairs := forest(prints[a : a + n], max_bits):
                e = np.array(pairs) + a
                us.append(bits[e[:, 0]])
                vs.append(bits[e[:, 1]])
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(us)), pa.array(np.concatenate(vs))], names=["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, bits = [], []
        for batch in batches:
            k, b = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            if not len(k):
                continue
            cut = int(np.searchsorted(k, k[-1]))  # the last bucket may go on in the next batch
            keys.append(k[:cut])
            bits.append(b[:cut])
            if cut or len(k) and keys and len(keys[0]) and k[0] != keys[0][0]:
                yield edges_of(np.concatenate(keys), np.concatenate(bits))
                keys, bits = [], []
            keys.append(k[cut:])
            bits.append(b[cut:])
        if keys:
            yield edges_of(np.concatenate(keys), np.concatenate(bits))

    return run


def links(distinct: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """Edges (u, v) between different fingerprints of a column bits that differ in at most max_bits (3 at most), up to what connectivity needs."""
    if not 0 <= max_bits <= MAX_BITS:
        raise ValueError(f"the keys find up to {MAX_BITS} differing bits")
    buckets = distinct.select("bits").mapInArrow(keyed, "key bigint, bits bigint")
    return buckets.repartition("key").sortWithinPartitions("key").mapInArrow(linked(max_bits), "u bigint, v bigint").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, max_bits: int = MAX_BITS) -> DataFrame:
    """One row per row of docs: id, fingerprint (16 hex digits), component_id (least id that can be reached).

    A null or empty text has fingerprint zero and is linked like any other. A null id joins its component but is never its
    least id; a component of null ids only has a null component_id. An empty table gives an empty one; other columns are
    not read. A text of any length is read as a whole, in slices. Equal fingerprints are one node, so a large group of
    copies costs one row; the way back from fingerprints to rows is a join whose skewed side Spark may split.
    """
    common.prepare(docs.sparkSession)
    coded = docs.select(F.col(id_col).alias("id"), fingerprint(shingle)(F.col(text_col)).alias("f"))
    rows = common.stored(coded.select("id", "f.bits"), "fingerprints")
    classes = common.stored(rows.groupBy("bits").agg(F.min("id").alias("least")), "classes")
    groups = components(links(classes, max_bits))
    grouped = classes.join(groups.withColumnRenamed("node", "bits"), "bits", "left").withColumn("component", F.coalesce("component", "bits"))
    least = grouped.groupBy("component").agg(F.min("least").alias("component_id"))
    known = common.stored(grouped.join(least, "component").select("bits", "component_id"), "members")
    return rows.join(known, "bits").select(F.col("id").alias(id_col), F.lpad(F.lower(F.hex("bits")), 16, "0").alias("fingerprint"), "component_id")
