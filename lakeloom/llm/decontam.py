"""Benchmark decontamination with a generalised suffix automaton of the test items.

The automaton accepts every run of words of every item. A document's words are streamed through it; the length of
the longest match that ends at a word tells which windows of items end there. A window is ``window`` consecutive
words of an item, or a whole shorter item. Runs of words that no item has are skipped.
"""

from __future__ import annotations

import re
from functools import reduce
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

WINDOW = 10
#: Most words of one automaton (about 140 MB). More items are handled in blocks of this size, each with a pass over the documents.
BLOCK_WORDS = 200_000
#: ASCII letters in lower case, digits and all other bytes of UTF-8 letters stay; the rest separates words.
NORMAL = bytes(c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else c + 32 if 0x41 <= c <= 0x5A else 32 for c in range(256))


def words(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(NORMAL).split()


class Automaton:
    """Suffix automaton of word sequences with, for each state, what the search reports there."""

    def __init__(self, items: list[tuple[str | None, list[bytes]]], window: int = WINDOW):
        self.window = window
        self.vocabulary: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        ends: list[tuple[int, int]] = []
        wholes: list[tuple[int, int]] = []
        items = list({(name, tuple(ws)): None for name, ws in items})  # a repeated item is one
        self.names = [name for name, _ in items]
        self.shortest = window
        for k, (_, ws) in enumerate(items):
            last = 0
            for w in ws:
                last = self._extend(last, self.vocabulary.setdefault(w, len(self.vocabulary)))
                ends.append((last, k))
            if 0 < len(ws) < window:
                wholes.append((last, k))
                self.shortest = min(self.shortest, len(ws))
        n = len(self.next)
        # The state on the way to the root that holds the last ``window`` words, and the items with these words.
        self.at_window = [-1] * n
        self.items: dict[int, set[int]] = {}
        for s in sorted(range(1, n), key=self.length.__getitem__):
            if self.length[s] >= window:
                up = self.link[s]
                self.at_window[s] = s if self.length[up] < window else self.at_window[up]
        for s, k in ends:
            if (q := self.at_window[s]) >= 0:
                self.items.setdefault(q, set()).add(k)
        # Whole short items that are suffixes of a state's words: those of its link, and the set of its own, one entry a length.
        own: dict[int, set[int]] = {}
        for s, k in wholes:
            own.setdefault(s, set()).add(k)
        self.whole: list[tuple[tuple[int, frozenset[int]], ...]] = [()] * n
        if own:
            for s in sorted(range(1, n), key=self.length.__getitem__):
                self.whole[s] = self.whole[self.link[s]] + (((self.length[s], frozenset(own[s])),) if s in own else ())

    def _new(self, length: int, link: int, edges: dict[int, int]) -> int:
        self.next.append(edges)
        self.link.append(link)
        self.length.append(length)
        return len(self.next) - 1

    def _split(self, p: int, c: int) -> int:
        """The state of the words of p followed by c, split off its class if the class also has longer ones."""
        q = self.next[p][c]
        if self.length[q] == self.length[p] + 1:
            return q
        copy = self._new(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = copy
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = copy
            p = self.link[p]
        return copy

    def _extend(self, last: int, c: int) -> int:
        if c in self.next[last]:
            return self._split(last, c)
        made, p = self._new(self.length[last] + 1, 0, {}), last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = made
            p = self.link[p]
        if p >= 0:
            self.link[made] = self._split(p, c)
        return made

    def search(self, ws: list[bytes]) -> tuple[list[tuple[int, int]], set[int]]:
        """Spans (first, last word) of the occurring windows, in the order of their ends, and the items they are of."""
        spans: list[tuple[int, int]] = []
        found: set[int] = set()
        if len(ws) < self.shortest or not self.vocabulary:
            return spans, found
        ids = np.fromiter(map(self.vocabulary.get, ws, repeat(-1)), np.int64, len(ws))
        edge = np.flatnonzero(np.diff(ids >= 0, prepend=False, append=False))
        nxt, link, length, window = self.next, self.link, self.length, self.window
        for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
            if b - a < self.shortest:
                continue
            s = size = 0
            for i, w in enumerate(ids[a:b].tolist(), a):
                while s and w not in nxt[s]:
                    s = link[s]
                    size = length[s]
                if w in nxt[s]:
                    s = nxt[s][w]
                    size += 1
                if size >= window:
                    spans.append((i - window + 1, i))
                    found |= self.items[self.at_window[s]]
                for n, items in self.whole[s]:
                    if n <= size:
                        spans.append((i - n + 1, i))
                        found |= items
        return spans, found


def covered(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The union of spans as disjoint ones in order."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def automata(items: DataFrame, id_col: str = "item_id", text_col: str = "text", window: int = WINDOW, block_words: int = BLOCK_WORDS):
    """Automata of all items, each of at most block_words words (one longer item excepted), made one after the other.

    Items arrive through a local iterator, so the driver holds one block. A null or wordless text has no windows.
    """
    block: list[tuple[str | None, list[bytes]]] = []
    size = 0
    for r in items.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text")).filter(F.col("text").isNotNull()).toLocalIterator():
        ws = words(r["text"].encode())
        if size and size + len(ws) > block_words:
            yield Automaton(block, window)
            block, size = [], 0
        if ws:
            block.append((r["id"], ws))
            size += len(ws)
    if block:
        yield Automaton(block, window)


def searcher(spark, machine: Automaton):
    """A UDF, and what it broadcasts: text -> struct(n_words, spans, items); spans: disjoint, of hit words; items: their ids, distinct, without null."""
    shared = spark.sparkContext.broadcast(machine)

    def start():
        m = shared.value

        def run(texts: list[bytes | None]):
            n, spans, items = [], [], []
            for t in texts:
                ws = words(t)
                s, found = m.search(ws)
                n.append(len(ws))
                spans.append([{"first": a, "last": b} for a, b in covered(s)])
                items.append(sorted({m.names[k] for k in found} - {None}))
            return pa.array(n, pa.int64()), pa.array(spans, pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))), pa.array(items, pa.list_(pa.string()))

        return run

    return common.text_udf(start, "n_words bigint, spans array<struct<first: int, last: int>>, items array<string>"), shared


def search(docs: DataFrame, items: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, out: str = "hits", block_words: int = BLOCK_WORDS) -> DataFrame:
    """docs with a struct column ``out`` (n_words, spans, items).

    An item with a null id counts for the spans and isn't listed. Repeated items count once. Without items nothing is hit.
    Where the items fill several blocks, each block is searched by itself and the rows that it hits are written, so the
    driver and the workers hold one block at a time; the spans of a row are then united.
    """
    spark = docs.sparkSession
    common.prepare(spark)
    blocks = automata(items, item_id, item_text, window, block_words)
    first, second = next(blocks, None) or Automaton([], window), next(blocks, None)
    if second is None:
        return docs.withColumn(out, searcher(spark, first)[0](F.col(text_col)))
    number, found = common.fresh("row_number", docs), common.fresh("found", docs)
    rows = common.numbered(docs, number)
    hits = []
    for machine in chain([first, second], blocks):
        find, shared = searcher(spark, machine)
        hit = rows.select(number, find(F.col(text_col)).alias(found)).filter(F.size(F.col(found)["spans"]) > 0)
        hits.append(common.stored(hit.select(number, F.col(found)["spans"].alias("s"), F.col(found)["items"].alias("i")), "hits"))
        shared.destroy()
        first = second = machine = None
    met = reduce(DataFrame.unionByName, hits).groupBy(number).agg(F.array_sort(F.flatten(F.collect_list("s"))).alias("s"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("i")))).alias("i"))  # one entry a block
    united = F.aggregate(
        "s",
        F.expr("cast(array() as array<struct<first:int,last:int>>)"),
        lambda acc, s: F.when((F.size(acc) > 0) & (s["first"] <= F.try_element_at(acc, F.lit(-1))["last"] + 1),
                              F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(F.struct(F.try_element_at(acc, F.lit(-1))["first"].alias("first"), F.greatest(F.try_element_at(acc, F.lit(-1))["last"], s["last"]).alias("last")))))
        .otherwise(F.concat(acc, F.array(s))),
    )
    met = met.select(F.col(number).alias("n"), F.struct(united.alias("spans"), F.col("i").alias("items")).alias("m"))
    none = searcher(spark, Automaton([], window))[0](F.col(text_col))
    joined = rows.withColumn(found, none).join(met, rows[number] == met["n"], "left")
    whole = F.struct(F.col(found)["n_words"].alias("n_words"), F.coalesce(met["m"]["spans"], F.col(found)["spans"]).alias("spans"), F.coalesce(met["m"]["items"], F.col(found)["items"]).alias("items"))
    return joined.select(*[rows[c] for c in docs.columns if c != out], whole.alias(out))


def report(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **kw) -> DataFrame:
    """One row per row of docs: id, n_words, n_hit, n_items, items_sha256, contaminated.

    A null or empty text has no words and no hits. Repeated rows, and null ids, have rows of their own; repeated items count
    once. No other column is read. Without items nothing is hit; an empty table gives an empty one.
    """
    hits = search(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), items, "text", out="h", **kw)
    n_hit = F.aggregate("h.spans", F.lit(0).cast("bigint"), lambda a, s: a + s["last"] - s["first"] + 1)
    return hits.select(
        F.col("id").alias(id_col), F.col("h.n_words").alias("n_words"), n_hit.alias("n_hit"), F.size("h.items").cast("bigint").alias("n_items"), F.sha2(F.array_join("h.items", ","), 256).alias("items_sha256"), (F.size("h.spans") > 0).alias("contaminated")
    )


def _cut(text: bytes, spans: list[dict]) -> bytes:
    at = [m.span() for m in re.finditer(rb"[^ ]+", text.translate(NORMAL))]
    keep, end = [], 0
    for s in spans:
        keep.append(text[end : at[s["first"]][0]])
        end = at[s["last"]][1]
    return b"".join([*keep, text[end:]])


def _cut_all(texts: pa.Array, spans: pa.Array) -> pa.Array:
    return pa.array([t if t is None or not s else _cut(t.encode(), s).decode() for t, s in zip(texts.to_pylist(), spans.to_pylist(), strict=True)], pa.string())


def cleaner(spark, machine: Automaton, max_coverage: float, min_span: int):
    """A UDF: text -> struct(keep, text): whether coverage is within the limit, and the text without its hit spans, null if nothing is cut."""
    shared = spark.sparkContext.broadcast(machine)

    def start():
        m = shared.value

        def run(texts: list[bytes | None]):
            keep, cut = [], []
            for t in texts:
                ws = words(t)
                spans = covered(m.search(ws)[0])
                keep.append(sum(b - a + 1 for a, b in spans) <= max_coverage * max(1, len(ws)))
                long = [{"first": a, "last": b} for a, b in spans if b - a + 1 >= min_span]
                cut.append(_cut(t, long).decode() if t and long else None)
            return pa.array(keep, pa.bool_()), pa.array(cut, pa.string())

        return run

    return common.text_udf(start, "keep boolean, text string")


def decontaminate(docs: DataFrame, items: DataFrame, text_col: str = "text", max_coverage: float = 0.5, min_span: int = 1, item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """docs without test items: hit spans of at least min_span words are cut out of a text; a text of which more than max_coverage is hit goes.

    A document without hits, an empty or null one too, stays as it is; so do repeated rows and other columns, whatever their
    names. Without items all documents stay. With one block of items a single UDF searches and cuts.
    """
    common.prepare(docs.sparkSession)
    blocks = automata(items, item_id, item_text, window, block_words)
    first = next(blocks, None) or Automaton([], window)
    if next(blocks, None) is None:
        udf = cleaner(docs.sparkSession, first, max_coverage, min_span)
        clean = common.fresh("clean", docs)
        done = docs.withColumn(clean, udf(F.col(text_col))).filter(F.col(clean)["keep"])
        return done.withColumn(text_col, F.coalesce(F.col(clean)["text"], text_col)).drop(clean)
    found, long = common.fresh("hits", docs), common.fresh("spans", docs)
    hits = search(docs, items, text_col, item_id, item_text, window, found, block_words)
    spans = F.filter(F.col(found)["spans"], lambda s: s["last"] - s["first"] + 1 >= min_span)
    share = F.aggregate(F.col(found)["spans"], F.lit(0), lambda a, s: a + s["last"] - s["first"] + 1) / F.greatest(F.col(found)["n_words"], F.lit(1))
    cut = F.arrow_udf(_cut_all, T.StringType())
    kept = hits.withColumn(long, spans).filter(share <= max_coverage)
    return kept.withColumn(text_col, F.when(F.size(long) > 0, cut(F.col(text_col), F.col(long))).otherwise(F.col(text_col))).drop(found, long)
