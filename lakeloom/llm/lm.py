"""Language-model scores: a causal self-attention model over subword ids, trained in numpy.

Corpus statistics cover every training row: word counts (for the unigram base) and, through them, subword
counts. The model predicts the class of the next subword from attention over overlapping windows and takes
the subword within its class from those counts, so the probabilities of all ids sum to one. A window holds
2 x STRIDE positions of which the last STRIDE are scored; each subword is scored once. A word's probability is
that of its subwords, interpolated with its smoothed corpus frequency (weight MIXED). The attention weights learn
from every subword of all training rows: each task carries on from a common start, which a sample gives, over all
windows of its rows, and the mean of the tasks' weights, by their windows, is the model. Each text is encoded once;
its ids are kept in a table that the counts of subwords, the pass over all rows and the scores read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common
from .bytetable import LONGEST, ByteTable, lanes, padded
from .tokens import encoder

STRIDE, WIDTH = 16, 16
#: Output classes of one id, of a band of ids; ids with an input vector of their own.
SINGLES, BANDS, OWN = 112, 16, 1024
#: The start: pieces drawn from the training rows (more with the corpus, see train), characters of a piece, steps, windows a step.
SAMPLE_ROWS, SAMPLE_CHARS, STEPS, WINDOWS = 1500, 1500, 1000, 96
DOUBLES_FROM = 200_000
#: The pass over all rows: windows a step, bytes of text whose windows are shuffled at once, and the first step's share of the rate.
PASS_WINDOWS, PASS_BYTES, PASS_RATE = 512, 4 << 20, 0.3
#: Neighbouring windows that learn in the same step, so that what they share is computed once.
RUN = 8
#: Weights are summed as whole multiples of this, so that sums don't depend on their order.
GRAIN = 2.0**-24
#: Words of which all workers hold the counts (a bound on what is broadcast), and their longest.
HOT_WORDS, HOT_BYTES = 200_000, LONGEST
#: Counts below are told apart where the hot words are chosen.
EXACT = 4096
#: Share of the corpus frequency in a word's probability.
MIXED = 0.5


class Counts:
    """What is gathered from the corpus: n tokens, v distinct ones, the hot words' counts, all words' counts as a table."""

    def __init__(self, n: int, v: int, ends: int, hot: dict[bytes, int], table: DataFrame, path: str):
        self.n, self.v, self.ends, self.hot, self.table, self.path = n, v, ends, hot, table, path

    @cached_property
    def pieces(self) -> np.ndarray:
        """A number for each subword id and, last, the end of a text: from the words, unless count_ids has set it from the texts."""
        path = self.path

        def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(encoder(path).tokenizer.get_vocab_size(), np.int64)
            for batch in batches:
                words, counts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
                r = encoder(path).ragged([" ".join(words).encode()])
                total += np.bincount(r.ids, np.repeat(np.array(counts, np.float64), r.piece_tokens), len(total)).astype(np.int64)
            yield numbers(total)

        return self._collected(self.table.filter(F.col("word").isNotNull()).select("word", "c").mapInArrow(split, "at bigint, v bigint"))

    def count_ids(self, ids: DataFrame) -> None:
        """Set pieces from the encoded training texts (ids); no word is encoded again."""
        path = self.path

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            size = encoder(path).tokenizer.get_vocab_size()
            total = np.zeros(size, np.int64)
            for batch in batches:
                total += np.bincount(unpacked(batch.column(0), id_type(size))[0], minlength=size)
            yield numbers(total)

        self.pieces = self._collected(ids.select("ids").mapInArrow(run, "at bigint, v bigint"))

    def _collected(self, partial: DataFrame) -> np.ndarray:
        pieces = np.zeros(encoder(self.path).tokenizer.get_vocab_size() + 1, np.int64)
        for r in partial.groupBy("at").agg(F.sum("v").alias("v")).collect():
            pieces[r["at"]] = r["v"]
        pieces[-1] = self.ends
        return pieces


def numbers(values: np.ndarray) -> pa.RecordBatch:
    """Places and values that aren't zero."""
    at = np.flatnonzero(values)
    return pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(values[at], pa.int64())], names=["at", "v"])


def id_type(size: int) -> type:
    """What holds the ids of a vocabulary of this size."""
    return np.uint16 if size <= 1 << 16 else np.int32


def packed(values: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """Runs of these lengths as binary values."""
    cuts = np.concatenate([[0], np.cumsum(lengths) * values.itemsize])
    return pa.Array.from_buffers(pa.binary(), len(lengths), [None, pa.py_buffer(cuts.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(values))])


def unpacked(array: pa.Array, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """The values of packed runs, one after the other, and the runs' lengths."""
    data = array.cast(pa.large_binary())
    cuts = np.frombuffer(data.buffers()[1], np.int64, len(data) + 1, data.offset * 8)
    held = np.frombuffer(data.buffers()[2] or b"", np.uint8)[cuts[0] : cuts[-1]]
    return np.frombuffer(held.tobytes(), kind), np.diff(cuts) // np.dtype(kind).itemsize


def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial counts of a task's words; the null word stands for the ends of texts."""
    counts: Counter = Counter()
    ends = 0

    def out() -> pa.RecordBatch:
        words = [*(w.decode() for w in counts), None]
        return pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array([*counts.values(), ends], pa.int64())], names=["word", "c"])

    for batch in batches:
        for text in batch.column(0).cast(pa.binary()).to_pylist():
            counts.update((text or b"").lower().split())
        ends += batch.num_rows
        if len(counts) > 400_000:
            yield out()
            counts, ends = Counter(), 0
    yield out()


def count_class(c: Column) -> Column:
    """The least count of a class of counts: each below EXACT is its own, above they double. So the most frequent words are always found, however many there are."""
    power = F.floor(F.log2(c / F.lit(EXACT)) + 1e-12).cast("int")
    return F.when(c < EXACT, c).otherwise((F.lit(EXACT) * F.pow(F.lit(2.0), power)).cast("bigint"))


def gather(train: DataFrame, path: str, text_col: str = "text") -> Counts:
    """Counts over all rows of train. The tables behind it are written once; the driver gets HOT_WORDS words."""
    common.prepare(train.sparkSession)
    partial = train.select(F.col(text_col).alias("text")).mapInArrow(count_words, "word string, c bigint")
    table = common.stored(partial.groupBy("word").agg(F.sum("c").alias("c")).filter("c > 0"), "words")
    row = table.agg(F.sum("c"), F.count(F.lit(1)), F.max(F.when(F.col("word").isNull(), F.col("c")))).first()
    short = table.filter(F.col("word").isNotNull() & (F.octet_length("word") <= HOT_BYTES))
    left, least = HOT_WORDS, None
    for r in short.groupBy(count_class(F.col("c")).alias("c")).count().orderBy(F.desc("c")).collect():
        left -= r["count"]
        if left < 0:
            break
        least = r["c"]
    hot = {} if least is None else {r["word"].encode(): r["c"] for r in short.filter(F.col("c") >= least).toLocalIterator()}
    return Counts(row[0] or 0, row[1], row[2] or 0, hot, table, path)


def summed(at: np.ndarray, values: np.ndarray, size: int) -> np.ndarray:
    """The sums of values (n, width) that go to each place."""
    width = values.shape[1]
    return np.bincount((at[:, None] * width + np.arange(width)).reshape(-1), values.reshape(-1), size * width).reshape(size, width)


def windows(rows: np.ndarray) -> np.ndarray:
    """Runs of rows (n, length + 1, STRIDE, width) -> a view of each two neighbours as one (n, length, 2 * STRIDE, width)."""
    n, length, _, width = rows.shape
    return np.lib.stride_tricks.as_strided(rows, (n, length - 1, 2 * STRIDE, width), rows.strides, writeable=False)


class Model:
    """Attention with tables: queries, keys and values of an input symbol don't depend on its place, so they are looked up."""

    def __init__(self, pieces: np.ndarray, seed: int = 3):
        order = np.argsort(-pieces, kind="stable")
        self.size, self.end = len(pieces), len(pieces) - 1
        smooth = pieces + 0.5
        cls = np.empty(self.size, np.int64)
        cls[order[:SINGLES]] = np.arange(SINGLES)
        rest = order[SINGLES:]
        mass = np.cumsum(smooth[rest])
        cls[rest] = SINGLES + np.minimum(BANDS - 1, (mass / mass[-1] * BANDS).astype(np.int64))
        total = np.bincount(cls, smooth, SINGLES + BANDS)
        self.cls = cls
        self.within = np.log(smooth / total[cls])
        self.symbol = OWN + cls
        self.symbol[order[:OWN]] = np.arange(min(OWN, self.size))
        self.pad = OWN + SINGLES + BANDS
        rng = np.random.default_rng(seed)
        d, c = WIDTH, SINGLES + BANDS
        shape = {"e": (self.pad + 1, d), "q": (d, d), "k": (d, d), "v": (d, d), "near": (2 * STRIDE,), "w1": (2 * d, 2 * d), "b1": (2 * d,), "w2": (2 * d, c), "b2": (c,)}
        self.parts = {n: (rng.standard_normal(s) * (0.5 if n == "e" else 0.2)).astype(np.float32) for n, s in shape.items()}
        self.parts["b2"][:] = np.log(total / total.sum())
        self.parts["near"][:] = -0.2 * np.arange(2 * STRIDE)
        i, j = np.arange(STRIDE)[:, None] + STRIDE, np.arange(2 * STRIDE)[None, :]
        self.far, self.seen = np.maximum(0, i - j), (j <= i)

    def laid_out(self, ids: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Input ids in rows of STRIDE, a row of padding before each text; targets (-1: none); rows that are scored; their texts.

        A text's inputs are the end id, then its ids; its targets are its ids, then the end id.
        """
        lens = np.array([len(x) + 1 for x in ids], np.int64)
        rows = -(-lens // STRIDE)
        first = np.cumsum(rows + 1) - rows
        x = np.full((int((rows + 1).sum()) if len(ids) else 0, STRIDE), -1, np.int64)
        y = x.copy()
        flat_x, flat_y = x.reshape(-1), y.reshape(-1)
        for at, i in zip((first * STRIDE).tolist(), ids, strict=True):
            n = len(i)
            flat_x[at], flat_x[at + 1 : at + 1 + n] = self.end, i
            flat_y[at : at + n], flat_y[at + n] = i, self.end
        owner = np.repeat(np.arange(len(ids)), rows)
        scored = np.arange(len(owner)) + owner + 1
        return x, y, scored, owner

    def forward(self, x: np.ndarray, scored: np.ndarray) -> tuple:
        """Symbols (row, STRIDE) -> the exponentials of the scored rows' class logits without their bias, and what the gradient needs.

        scored: rows, or runs (n, length) of consecutive rows, whose keys and values are looked up once for the windows that share them.
        """
        p, d = self.parts, WIDTH
        bias = np.where(self.seen, p["near"][self.far], -1e9).astype(np.float32)
        e = p["e"]
        runs = scored if scored.ndim == 2 else scored[:, None]
        n = runs.size
        sx = x[np.concatenate([runs[:, :1] - 1, runs], axis=1)]
        table = np.concatenate([e @ p["w1"][:d] + p["b1"], e @ p["q"] / np.float32(math.sqrt(d))], axis=1).take(sx[:, 1:], axis=0)
        kv = np.concatenate([e @ p["k"], e @ p["v"]], axis=1).take(sx, axis=0)
        q, both = table[..., 2 * d :], windows(sx[..., None])[..., 0].reshape(n, -1)
        kx, vx = windows(kv[..., :d]), windows(kv[..., d:])
        a = np.matmul(q, kx.swapaxes(2, 3)).reshape(n, STRIDE, 2 * STRIDE)
        a += bias
        padded_at = both == self.pad
        first = np.flatnonzero(padded_at.any(1))
        a[first] -= padded_at[first][:, None, :] * np.float32(1e9)
        np.exp(a, out=a)
        every = (a @ np.ones((2 * STRIDE, 1), np.float32)) + np.float32(1e-30)
        o = np.matmul(a.reshape(*runs.shape, STRIDE, 2 * STRIDE), vx).reshape(n, STRIDE, d)
        o /= every
        u = o.reshape(-1, d) @ p["w1"][d:]
        u += table[..., : 2 * d].reshape(-1, 2 * d)
        np.tanh(u, out=u)
        # |u| <= 1, so the logits stay within the sums of the weights: no shift is needed before exp
        # The bias is a factor of the exponentials, which callers apply where they need it.
        g = u @ p["w2"]
        np.exp(g, out=g)
        return g, (sx, q, kx, vx, a, every, o, u)

    def step(self, x: np.ndarray, y: np.ndarray, scored: np.ndarray, sx: np.ndarray | None = None) -> tuple[float, dict[str, np.ndarray]]:
        """Mean cross entropy of the classes and its gradient. sx: the symbols of x, where they are known; scored: as in forward."""
        p, d = self.parts, WIDTH
        g, (sx, q, kx, vx, a, every, o, u) = self.forward(self.inputs(x) if sx is None else sx, scored)
        factor = np.exp(p["b2"])
        target = y[scored].reshape(-1)
        there = np.flatnonzero(target >= 0)
        c = self.cls[target[there]]
        total = (g @ factor)[there]
        loss = -float(np.log(g[there, c] * factor[c] / total + 1e-9).mean())
        # The logits' gradient is g times factor (by class) times share (by position): both go to the narrow sides of the products.
        g[there, c] -= total / factor[c]
        share = np.zeros((len(g), 1), g.dtype)
        share[there, 0] = 1 / (total * len(there))
        dw2, db2 = ((u * share).T @ g) * factor, (share[:, 0] @ g) * factor
        du = g @ (p["w2"] * factor).T
        du *= share
        du *= 1 - u * u
        flat_o, grid = o.reshape(-1, d), (*sx[:, 1:].shape[:2], STRIDE)
        do = du @ p["w1"][d:].T
        back = (do * flat_o) @ np.ones((d, 1), do.dtype)
        do /= every.reshape(-1, 1)
        back /= every.reshape(-1, 1)
        do = do.reshape(*grid, d)
        ds = np.matmul(do, vx.swapaxes(2, 3)).reshape(a.shape)
        ds -= back.reshape(every.shape)
        ds *= a
        near = np.bincount(self.far[self.seen], ds.sum(0)[self.seen], 2 * STRIDE).astype(np.float32)
        ds, a = ds.reshape(*grid, 2 * STRIDE), a.reshape(*grid, 2 * STRIDE)
        # What reaches a position's input vector, as a symbol itself, a query, a key and a value; keys and values are those of two windows.
        dq = np.matmul(ds, kx).reshape(-1, d) / np.float32(math.sqrt(d))
        dk, dv = np.empty((2, *sx.shape, d), g.dtype)
        for out, of_keys in ((dk, np.matmul(ds.swapaxes(2, 3), q)), (dv, np.matmul(a.swapaxes(2, 3), do))):
            out[:, 0] = 0
            out[:, 1:] = of_keys[:, :, STRIDE:]
            out[:, :-1] += of_keys[:, :, :STRIDE]
        dk, dv = dk.reshape(-1, d), dv.reshape(-1, d)
        de = dk @ p["k"].T
        de += dv @ p["v"].T
        own = du @ p["w1"][:d].T
        own += dq @ p["q"].T
        de = de.reshape(*sx.shape, d)
        de[:, 1:] += own.reshape(*grid, d)
        de = summed(sx.reshape(-1), de.reshape(-1, d), len(p["e"])).astype(p["e"].dtype)
        e, e_own = p["e"].take(sx.reshape(-1), axis=0).T, p["e"].take(sx[:, 1:].reshape(-1), axis=0).T
        return loss, {"e": de, "q": e_own @ dq, "k": e @ dk, "v": e @ dv, "near": near, "w2": dw2, "b2": db2, "w1": np.concatenate([e_own @ du, flat_o.T @ du]), "b1": np.ones(len(du), du.dtype) @ du}

    def inputs(self, x: np.ndarray) -> np.ndarray:
        return np.where(x < 0, self.pad, self.symbol[x])

    def fit(self, ids: list[np.ndarray], steps: int = STEPS, seed: int = 9) -> None:
        x, y, scored, _ = self.laid_out(ids)
        if not len(scored):
            return
        rng, adam = np.random.default_rng(seed), common.Adam(self.parts, 0.01)
        for t in range(steps):
            _, grads = self.step(x, y, rng.choice(scored, min(len(scored), WINDOWS), replace=False))
            norm = math.sqrt(sum(float((v * v).sum()) for v in grads.values()))
            adam.step({k: v / max(1.0, norm) for k, v in grads.items()}, 1 - t / (steps + 1))

    def learn(self, ids: list[np.ndarray], adam: common.Adam, rng: np.random.Generator) -> int:
        """One step for every PASS_WINDOWS windows of these texts, each window once, in runs of RUN neighbours in random order; the number of windows.

        The rows of padding between texts are in the runs too; they have no targets.
        """
        x, y, scored, _ = self.laid_out(ids)
        if not len(scored):
            return 0
        more = np.full((-(len(x) - 1) % RUN, STRIDE), -1)
        x, y = np.concatenate([x, more]), np.concatenate([y, more])
        runs, sx = 1 + rng.permutation((len(x) - 1) // RUN)[:, None] * RUN + np.arange(RUN), self.inputs(x)
        for i in range(0, len(runs), PASS_WINDOWS // RUN):
            at = runs[i : i + PASS_WINDOWS // RUN]
            _, grads = self.step(x, y, at, sx)
            norm = math.sqrt(sum(float((v * v).sum()) for v in grads.values()))
            adam.step({k: v / max(1.0, norm) for k, v in grads.items()}, PASS_RATE * at.size / PASS_WINDOWS / math.sqrt(1 + adam.t / 100))
        return len(scored)

    def flat(self) -> np.ndarray:
        return np.concatenate([v.reshape(-1) for v in self.parts.values()]).astype(np.float64)

    def unflatten(self, flat: np.ndarray) -> None:
        ends = np.cumsum([v.size for v in self.parts.values()])
        self.parts = {k: a.reshape(v.shape).astype(np.float32) for (k, v), a in zip(self.parts.items(), np.split(flat, ends[:-1]), strict=True)}

    def log_probabilities(self, ids: list[np.ndarray], rows: int = 512) -> np.ndarray:
        """Natural logarithms for all subwords and the end of each text, one text after the other."""
        x, y, _, _ = self.laid_out(ids)
        sx, out, factor = self.inputs(x), [], np.exp(self.parts["b2"])
        for i in range(1, len(x), rows):
            at = np.arange(i, min(i + rows, len(x)))[None]
            g, _ = self.forward(sx, at)
            target = y[at].reshape(-1)
            there = np.flatnonzero(target >= 0)
            t = target[there]
            every = (g @ factor)[there]
            c = self.cls[t]
            out.append(np.log(g.reshape(-1)[there * g.shape[1] + c] * factor[c] / every) + self.within[t])
        return np.concatenate(out) if out else np.zeros(0)


def train(docs: DataFrame, counts: Counts, path: str, id_col: str = "doc_id", text_col: str = "text", rows: int = SAMPLE_ROWS, ids: DataFrame | None = None) -> Model:
    """A model that has learned from all windows of all training rows.

    It starts from pieces drawn from them: ``rows`` for each doubling of the corpus beyond DOUBLES_FROM texts, and ``rows`` before.
    ids: the same rows encoded (size, ids), where they are at hand.
    """
    model = Model(counts.pieces)
    rows = int(rows * (1 + math.log2(1 + counts.ends / DOUBLES_FROM)))
    key = F.xxhash64(F.lit(29), F.col(id_col), F.length(text_col))
    share = common.share_of(docs.filter(F.length(text_col) > 0), 1.3 * rows / max(1, counts.ends), 31, id_col, text_col)
    drawn = share.select(key.alias("k"), common.slices(F.col(text_col), key, SAMPLE_CHARS).alias("t")).orderBy("k", "t").limit(rows).collect()
    model.fit(encoder(path).encode([r["t"].encode() for r in drawn]))
    return learned_from_all(model, docs.select(words_and_ids(counts, path, docs.sparkSession)(text_col).alias("s")).select("s.*") if ids is None else ids)


def learned_from_all(model: Model, texts: DataFrame) -> Model:
    """The mean of the models that tasks get from this one over all windows of their texts (size, ids), by their numbers of windows."""
    shared = texts.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.keep_freed()
        net = Model.__new__(Model)
        net.__dict__ = shared.value.__dict__ | {"parts": {k: v.copy() for k, v in shared.value.parts.items()}}
        adam, rng, held, size, learned = common.Adam(net.parts, 0.01), np.random.default_rng(17), [], 0, 0
        for batch in batches:
            ids, lengths = unpacked(batch.column(1), id_type(net.end))
            held += np.split(ids, np.cumsum(lengths)[:-1]) if len(lengths) else []
            size += batch.column(0).to_numpy().sum()
            if size > PASS_BYTES:
                learned += net.learn(held, adam, rng)
                held, size = [], 0
        learned += net.learn(held, adam, rng)
        if learned:
            whole = np.append(np.rint(net.flat() * (learned / GRAIN)), learned).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(whole)), pa.int64()), pa.array(whole)], names=["at", "v"])

    sums = texts.select("size", "ids").mapInArrow(run, "at bigint, v bigint").groupBy("at").agg(F.sum("v").alias("v")).toPandas().sort_values("at")["v"].to_numpy(np.float64)
    if len(sums):
        model.unflatten(sums[:-1] * GRAIN / sums[-1])
    return model


def words_and_ids(counts: Counts, path: str, spark):
    """A UDF: text -> struct(size, n_tokens, hot_known, hot_base, ids, parts, hot, rare).

    hot_known and hot_base are over the hot words and the end. ids: the text's subwords; parts: how many each word has; hot: each
    word's place among the hot words, -1 for the rare ones, which follow by name.
    """
    words = list(counts.hot)
    buffer = padded(b"".join(words))
    size = np.array([len(w) for w in words], np.int64)
    table = ByteTable(max(1, len(words)))
    table.add(lanes(buffer, np.cumsum(size) - size, size))
    shared = spark.sparkContext.broadcast((table, np.array([*counts.hot.values(), -1], np.int64)))
    end = counts.ends

    def start():
        table, count = shared.value

        def run(texts: list[bytes | None]):
            r = encoder(path).ragged([t or b"" for t in texts])
            owner = np.repeat(np.arange(len(texts)), r.text_pieces)
            hot = np.full(len(owner), -1, np.int32)
            length = r.piece_end - r.piece_start
            short = np.flatnonzero(length <= LONGEST)
            hot[short] = table.find(lanes(padded(r.data), r.piece_start[short], length[short]))
            known, rare = np.flatnonzero(hot >= 0), np.flatnonzero(hot < 0)
            base = np.bincount(owner[known], np.log10(count[hot[known]] + 1.0), len(texts)) + math.log10(end + 1)
            names = [r.data[a:b].decode() for a, b in zip(r.piece_start[rare].tolist(), r.piece_end[rare].tolist(), strict=True)]
            cuts = np.concatenate([[0], np.cumsum(np.bincount(owner[rare], minlength=len(texts)))]).astype(np.int32)
            return (
                pa.array([len(t or b"") for t in texts], pa.int64()), pa.array(r.text_pieces + 1, pa.int64()), pa.array(np.bincount(owner[known], minlength=len(texts)) + 1, pa.int64()), base,
                packed(r.ids.astype(id_type(encoder(path).tokenizer.get_vocab_size())), r.text_tokens), packed(r.piece_tokens.astype(np.int32), r.text_pieces), packed(hot, r.text_pieces), pa.ListArray.from_arrays(pa.array(cuts), pa.array(names, pa.string())),
            )

        return run

    return common.text_udf(start, "size bigint, n_tokens bigint, hot_known bigint, hot_base double, ids binary, parts binary, hot binary, rare array<string>")


def scorer(model: Model, counts: Counts, spark):
    """A UDF: ids, parts, hot, rare (see words_and_ids) -> struct(hot_score, rare).

    hot_score is the sum over the hot words and the end; rare: the other words, each with the model's log10 probability.
    """
    shared = spark.sparkContext.broadcast((model, np.array([*counts.hot.values(), -1], np.int64)))
    n, v, end = counts.n, counts.v, counts.ends

    def mixed(c: np.ndarray, own: np.ndarray) -> np.ndarray:
        return np.log10(MIXED * (c + 1.0) / (n + v + 1) + (1 - MIXED) * 10.0**own)

    @F.arrow_udf("struct<hot_score: double, rare: array<struct<word: string, p: double>>>")
    def apply(columns: Iterator[tuple[pa.Array, pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        common.keep_freed()
        net, count = shared.value
        for packed_ids, packed_parts, packed_hot, names in columns:
            ids, text_tokens = unpacked(packed_ids, id_type(net.end))
            parts, text_pieces = unpacked(packed_parts, np.int32)
            hot, texts = unpacked(packed_hot, np.int32)[0], len(text_tokens)
            logs = np.concatenate([[0.0], np.cumsum(net.log_probabilities(np.split(ids, np.cumsum(text_tokens)[:-1]) if texts else []))]) / math.log(10)
            owner = np.repeat(np.arange(texts), text_pieces)
            to = np.cumsum(parts) + owner  # an end comes after each text
            # A word that the tokenizer drops has no subwords: its probability is its frequency alone.
            own = np.where(parts > 0, logs[to] - logs[to - parts], -300.0)
            last = np.cumsum(text_tokens + 1)
            own_end = logs[last] - logs[last - 1]
            known, rare = np.flatnonzero(hot >= 0), np.flatnonzero(hot < 0)
            score = np.bincount(owner[known], mixed(count[hot[known]], own[known]), texts) + mixed(np.full(texts, end), own_end)
            pairs = pa.StructArray.from_arrays([names.flatten(), pa.array(own[rare], pa.float64())], names=["word", "p"])
            cuts = np.concatenate([[0], np.cumsum(np.bincount(owner[rare], minlength=texts))]).astype(np.int32)
            yield pa.StructArray.from_arrays([pa.array(score), pa.ListArray.from_arrays(pa.array(cuts), pairs)], names=["hot_score", "rare"])

    return apply.asNondeterministic()


def score(docs: DataFrame, train_rows, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    train_rows: a condition for the rows to learn from. A null text is an empty one: it has one token, its end. Repeated
    ids keep their own rows. Rare words meet their counts in a join by word, so no table of all words is broadcast.
    """
    spark = docs.sparkSession
    base = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), train_rows.alias("learned"))
    learned = base.filter("learned")
    counts = gather(learned, path)
    texts = base.select("id", "learned", F.monotonically_increasing_id().alias("row"), words_and_ids(counts, path, spark)("text").alias("s"))
    texts = common.stored(texts.select("id", "learned", "row", "s.*"), "ids", compression="zstd")
    counts.count_ids(texts.filter("learned"))
    model = train(learned, counts, path, "id", "text", ids=texts.filter("learned"))
    scored = texts.select("id", "learned", "row", "n_tokens", "hot_known", "hot_base", scorer(model, counts, spark)("ids", "parts", "hot", "rare").alias("s"))
    rows = common.stored(scored.select(*scored.columns[:-1], "s.*"), "scored", compression="zstd")
    common.release(texts)
    n, v = counts.n, counts.v
    c = F.coalesce("c", F.lit(0)) + 1.0
    found = rows.select("row", F.explode("rare").alias("r")).select("row", "r.word", "r.p")
    met = found.join(counts.table.filter(F.col("word").isNotNull()), "word", "left")
    mixed = F.log10(MIXED * c / F.lit(float(n + v + 1)) + (1 - MIXED) * F.pow(F.lit(10.0), F.col("p")))
    rare = met.groupBy("row").agg(F.count("c").alias("known"), F.sum(F.log10(c)).alias("base"), F.sum(mixed).alias("mixed"))
    zero = F.lit(0.0)
    return rows.drop("rare").join(rare, "row", "left").select(
        F.col("id").alias(id_col), (~F.col("learned")).alias("held_out"), "n_tokens", (F.col("hot_known") - F.lit(int(counts.ends == 0)) + F.coalesce("known", F.lit(0))).alias("n_known"), F.lit(n).cast("bigint").alias("train_tokens"),
        (F.col("hot_base") + F.coalesce("base", zero) - F.col("n_tokens") * F.lit(math.log10(n + v + 1))).alias("base_score"), (F.col("hot_score") + F.coalesce("mixed", zero)).alias("score"),
    )
