"""Token ids of whole texts, and their output as Parquet list columns that can be read selectively.

Encoding: a tokenizer that drops white space and never merges letters with marks reads the words and the marks
between blanks independently. Their ids are remembered in a table with vectorized lookups, so the tokenizer itself
only encodes what a worker has not met yet. The file: int32 lists, dictionary or
delta encoding, row groups and pages of a controlled size and Parquet's page indexes, so a reader can take
one document's tokens or the metadata alone.
"""

from __future__ import annotations

import uuid
import zlib
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common
from .bytetable import LONGEST, ByteTable, distinct, lanes, padded, spread

END_ID = 1
#: Units whose ids a worker remembers (a bound on its memory); then it starts afresh.
ROOM = 400_000
#: Classes of bytes: blanks, marks that end a word without being read together with its letters, and all others.
MARKS = b"!\"#$%&()*+,-./:;<=>?@[]^_`{|}~"
CLASS = np.array([0 if c in b"\t\n\v\f\r " else 2 if c in MARKS else 1 for c in range(256)], np.uint8)
LOWER = bytes(c + 32 if 0x41 <= c <= 0x5A else c for c in range(256))
ALNUM = np.array([chr(c).isalnum() and c < 128 for c in range(256)])


class Ragged(NamedTuple):
    """Ids of texts, one text after the other; pieces are the runs of characters between blanks."""

    ids: np.ndarray
    piece_tokens: np.ndarray
    piece_start: np.ndarray
    piece_end: np.ndarray
    text_pieces: np.ndarray
    text_tokens: np.ndarray
    #: The texts in ASCII lower case with a blank after each, which piece_start and piece_end refer to.
    data: bytes


class Encoder:
    """Ids of texts, equal to those that the tokenizer gives each whole text.

    A unit is a run of marks or of other characters between blanks. A run that begins or ends, next to marks, with anything
    but an ASCII letter, a digit or a Latin-1 letter makes its whole piece one unit. Whether the tokenizer reads units
    independently is probed at the start; if not, and for texts with the tokenizer's special strings, whole texts are encoded.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.ends = np.zeros(self.tokenizer.get_vocab_size() + 1, bool)
        for token, i in self.tokenizer.get_vocab().items():
            self.ends[i] = token.endswith("</w>")
        self.special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        probe = ["Straightforward", "b", "\u00e9lan", "\u00c7a", "xylophonequark", "?!", "x3"]
        apart = [self._ids(w) for w in probe]
        self.by_unit = self._ids(" ".join(probe)) == self._ids("\n".join(probe)) == sum(apart, []) and self._ids("Ab?!c3") == self._ids("ab") + self._ids("?!") + self._ids("C3")
        self.by_end = all(self.ends[i[-1]] and not self.ends[i[:-1]].any() for i in apart[:5])
        self._clear()

    def _clear(self) -> None:
        self.table = ByteTable(ROOM)
        self.first, self.count = np.zeros(ROOM, np.int64), np.zeros(ROOM, np.int64)
        self.pool: list[np.ndarray] = []
        self.pooled = 0

    def _ids(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _each(self, units: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of units, one after the other, and their numbers."""
        count = np.zeros(len(units), np.int64)
        plain = [i for i, u in enumerate(units) if u.isalpha() or u[0] in MARKS and not u.translate(None, MARKS)] if self.by_end else []
        flat = np.array(self._ids(b" ".join([units[i] for i in plain]).decode()), np.int32)
        last = np.flatnonzero(self.ends[flat]) if len(flat) else np.zeros(0, np.int64)
        if len(last) != len(plain):
            plain, flat, last = [], np.zeros(0, np.int32), np.zeros(0, np.int64)
        count[plain] = np.diff(last, prepend=-1)
        rest = sorted(set(range(len(units))) - set(plain))
        got = [e.ids for e in self.tokenizer.encode_batch_fast([units[i].decode() for i in rest], add_special_tokens=False)]
        count[rest] = [len(x) for x in got]
        start = np.cumsum(count) - count
        out = np.empty(int(count.sum()), np.int32)
        out[spread(start[plain], count[plain])] = flat
        out[spread(start[rest], count[rest])] = np.fromiter(chain.from_iterable(got), np.int32)
        return out, count

    def ragged(self, texts: list[bytes]) -> Ragged:
        data = b" ".join([*texts, b""])
        if self.by_unit and not any(s in data for s in self.special):
            return self._by_unit(texts, data.translate(LOWER))
        if len(texts) > 1:  # only the texts that need it are read whole
            parts = [self.ragged([t]) for t in texts]
            shift = np.cumsum([0, *(len(p.data) for p in parts)])
            joined = [np.concatenate([getattr(p, f) + (s if f in ("piece_start", "piece_end") else 0) for p, s in zip(parts, shift, strict=False)]) for f in Ragged._fields[:-1]]
            return Ragged(*joined, b"".join(p.data for p in parts))
        return self._whole(texts, data)

    def _whole(self, texts: list[bytes], data: bytes) -> Ragged:
        """One text, encoded at once; its ids go to the pieces by where they start."""
        e = self.tokenizer.encode(texts[0].decode(), add_special_tokens=False) if texts else None
        cls = CLASS[np.frombuffer(data, np.uint8)] > 0
        edge = np.flatnonzero(np.diff(cls, prepend=False, append=False))
        start, end = edge[::2], edge[1::2]
        if e is None:
            none = np.zeros(0, np.int64)
            return Ragged(none.astype(np.int32), none, none, none, none, none, data)
        bytes_at = np.cumsum([0, *(len(c.encode()) for c in texts[0].decode())])
        place = np.searchsorted(start, bytes_at[[a for a, _ in e.offsets]], "right") - 1 if len(e.ids) else np.zeros(0, np.int64)
        return Ragged(np.array(e.ids, np.int32), np.bincount(np.maximum(place, 0), minlength=len(start))[: len(start)], start, end, np.array([len(start)]), np.array([len(e.ids)]), data.translate(LOWER))

    def _by_unit(self, texts: list[bytes], data: bytes) -> Ragged:
        buffer = padded(data)
        cls = CLASS[buffer[: len(data)]]
        edge = np.empty(len(cls), bool)
        edge[:1], edge[1:] = cls[:1] != 0, cls[1:] != cls[:-1]
        change = np.flatnonzero(edge)
        start, end = change, np.append(change[1:], len(data))
        kind = cls[start]
        inside = kind > 0
        start, end, kind = start[inside], end[inside], kind[inside]
        glued = np.zeros(len(start), bool)  # to the unit before
        glued[1:] = start[1:] == end[:-1]
        piece = np.cumsum(~glued) - 1
        # what stands next to marks must be a letter or digit that is known to stand apart from them
        head, tail = buffer[start], buffer[end - 1]
        latin = lambda lead, trail: (lead == 0xC3) & (trail != 0x97) & (trail != 0xB7)
        safe_head = ALNUM[head] | latin(head, buffer[start + 1])
        safe_tail = ALNUM[tail] | latin(buffer[np.maximum(end - 2, 0)], tail)
        next_glued = np.append(glued[1:], False)
        bad = (kind == 1) & (glued & ~safe_head | next_glued & ~safe_tail)
        if bad.any():
            bad_piece = np.zeros(piece[-1] + 1, bool)
            bad_piece[piece[bad]] = True
            whole = bad_piece[piece]
            piece_last = np.append(piece[1:] != piece[:-1], True)
            last_end = np.zeros(piece[-1] + 1, np.int64)
            last_end[piece[piece_last]] = end[piece_last]
            end = np.where(whole, last_end[piece], end)
            keep = ~(whole & glued)
            start, end, piece = start[keep], end[keep], piece[keep]
        length = end - start
        first, count = np.zeros(len(start), np.int64), np.zeros(len(start), np.int64)
        short = np.flatnonzero(length <= LONGEST)
        keys = lanes(buffer, start[short], length[short])
        entry = self.table.find(keys)
        missing = np.flatnonzero(entry < 0)
        extra: list[np.ndarray] = []
        if len(missing):
            one = missing[distinct(keys[missing])]
            if self.table.size + len(one) > ROOM:
                self._clear()
                entry[:] = -1
                one = distinct(keys)
                missing = np.arange(len(keys))
            if len(one) <= ROOM:
                at = short[one]
                ids, n = self._each([data[a:b] for a, b in zip(start[at].tolist(), end[at].tolist(), strict=True)])
                new = self.table.add(keys[one])
                self.first[new], self.count[new] = self.pooled + np.cumsum(n) - n, n
                self.pool.append(ids)
                self.pooled += len(ids)
                entry[missing] = self.table.find(keys[missing])
            else:  # more units in one batch than a worker remembers
                short, entry = short[:0], entry[:0]
        first[short], count[short] = self.first[entry], self.count[entry]
        long = np.ones(len(start), bool)
        long[short] = False
        long = np.flatnonzero(long)
        if len(self.pool) > 1:
            self.pool = [np.concatenate(self.pool)]
        if len(long):
            ids, n = self._each([data[a:b] for a, b in zip(start[long].tolist(), end[long].tolist(), strict=True)])
            first[long], count[long] = self.pooled + np.cumsum(n) - n, n
            extra = [ids]
        pool = np.concatenate([*self.pool, *extra, np.zeros(0, np.int32)]) if extra or not self.pool else self.pool[0]
        flat = pool[spread(first, count)]
        pieces = int(piece[-1]) + 1 if len(piece) else 0
        new_piece = np.flatnonzero(np.diff(piece, prepend=-1))
        piece_start = start[new_piece]
        piece_end = end[np.append(new_piece[1:], len(piece)) - 1] if pieces else piece_start
        piece_tokens = np.add.reduceat(count, new_piece) if pieces else count
        text_end = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)
        upto = np.searchsorted(piece_start, text_end)
        total = np.concatenate([[0], np.cumsum(piece_tokens)])
        return Ragged(flat, piece_tokens, piece_start, piece_end, np.diff(upto, prepend=0), np.diff(total[upto], prepend=0), data)

    def encode(self, texts: list[bytes]) -> list[np.ndarray]:
        """The ids of each text."""
        r = self.ragged(texts)
        return np.split(r.ids, np.cumsum(r.text_tokens)[:-1]) if texts else []


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One per worker and file; it outlives a task."""
    if path not in _ENCODERS:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def token_ids(path: str, end_id: int = END_ID):
    """A UDF: text -> struct(ids) with the end id appended; a null text is an empty one."""

    def start():
        ragged = encoder(path).ragged

        def run(texts: list[bytes | None]):
            r = ragged([t or b"" for t in texts])
            lens = r.text_tokens + 1
            ends = np.cumsum(lens)
            flat = np.full(int(ends[-1]) if len(ends) else 0, end_id, np.int32)
            flat[spread(ends - lens, lens - 1)] = r.ids
            offsets = np.concatenate([[0], ends]).astype(np.int32)
            return (pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat)),)

        return run

    return common.text_udf(start, "ids array<int>")


def write(docs: DataFrame, target: str, path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID, delta: bool = False, row_group_mb: int = 16, page_kb: int = 64) -> None:
    """Token ids in ascending id order (nulls first, ties by text) as Parquet files under target.

    Columns: the id, n_tokens, tokens. delta: DELTA_BINARY_PACKED pages instead of a dictionary. The files follow
    each other in the order of their names, rows are sorted in each, and the pages carry min and max of the id.
    """
    common.prepare(docs.sparkSession)
    ids = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    ranged = ids.repartitionByRange(F.col("doc_id").asc_nulls_first(), F.xxhash64("text")).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
    coded = ranged.withColumn("coded", token_ids(path, end_id)(F.col("text")))
    coded.select("doc_id", F.size("coded.ids").alias("n_tokens"), F.col("coded.ids").alias("tokens")).write.options(
        **{
            "compression": "zstd",
            "parquet.writer.version": "v2" if delta else "v1",
            "parquet.enable.dictionary": str(not delta).lower(),
            "parquet.block.size": str(row_group_mb << 20),
            "parquet.page.size": str(page_kb << 10),
            "parquet.page.row.count.limit": "2000",
        }
    ).parquet(target)


def read(spark: SparkSession, target: str) -> DataFrame:
    """The written table; a reader that selects doc_id and n_tokens never touches the tokens."""
    return spark.read.schema("doc_id bigint, n_tokens int, tokens array<int>").parquet(target)


@F.arrow_udf(T.LongType())
def ids_crc32(ids: pa.Array) -> pa.Array:
    """Unsigned crc32 of the ids as little-endian unsigned 32-bit integers."""
    flat, ends = ids.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False), ids.offsets.to_numpy()
    return pa.array([zlib.crc32(flat[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)], pa.int64())


def digest(spark: SparkSession, target: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, from the files.

    start is a running sum: first over the rows of each slice (files of one writer task hold a range of ids), then
    over the slices' totals, of which there are as many as files.
    """
    rows = read(spark, target).select("doc_id", F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("row"), F.size("tokens").cast("long").alias("n_tokens"), ids_crc32("tokens").alias("ids_crc32"))
    slices = common.stored(rows.withColumn("slice", (F.col("row") / 4096).cast("long")), "digests")  # the tokens are read once
    totals = slices.groupBy("file", "slice").agg(F.sum("n_tokens").alias("total"))
    totals = totals.withColumn("before", F.sum("total").over(Window.partitionBy("file").orderBy("slice")) - F.col("total"))
    files = totals.groupBy("file").agg(F.sum("total").alias("in_file"))
    files = files.withColumn("earlier", F.sum("in_file").over(Window.orderBy(F.regexp_extract("file", r"part-(\d+)", 1).cast("bigint"), "file")) - F.col("in_file"))  # by number: names stop sorting at 100,000 files
    within = Window.partitionBy("file", "slice").orderBy("row")
    placed = slices.withColumn("inside", F.sum("n_tokens").over(within) - F.col("n_tokens"))
    return placed.join(totals.select("file", "slice", "before"), ["file", "slice"]).join(files.select("file", "earlier"), "file").select("doc_id", (F.col("inside") + F.col("before") + F.col("earlier")).cast("long").alias("start"), "n_tokens", "ids_crc32")


def export(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", **kw) -> DataFrame:
    """write() into the shared folder and the digest of what was written: one row per row of docs, repeated ones too.

    A null or empty text is its end id alone. An empty table gives an empty one; other columns are not read.
    """
    target = f"{common.shared_dir(docs.sparkSession)}/tokens-{uuid.uuid4().hex}"
    write(docs, target, path, id_col, text_col, **kw)
    return digest(docs.sparkSession, target)
