"""Language identification: a bidirectional gated recurrent network over bytes, trained in numpy.

Both directions use one update gate: with pre-activations ``s = X[byte] + h U``, ``z = sigmoid(s_z)``,
``c = tanh(s_c)``, the state becomes ``h + z (c - h)``. A softmax over both states labels every byte
position; a document's probability of a language is the mean over all its positions. Texts are cut into
segments of SEGMENT bytes, each read from both ends, so that memory is bounded for any length and no byte
is left out. Training is backpropagation through time on a bounded sample of labelled rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

HIDDEN, SEGMENT, LANES = 8, 256, 512
#: Fitting: rows a language and in all (bounded sample), bytes of one piece, pieces a step, steps.
ROWS_PER_LANG, ROWS, PIECE, PIECES, STEPS = 400, 20_000, 48, 96, 500
#: Bytes of texts that are laid out at once.
AT_ONCE = 1 << 20
LETTER = re.compile(r"[^\W\d_]")
UNDETERMINED = "und"


def pieces(texts: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes (position, segment), lengths and text numbers of the segments, longest first."""
    sizes = np.array([len(t) for t in texts], np.int64)
    count = -(-sizes // length)
    owner = np.repeat(np.arange(len(texts)), count)
    first = np.cumsum(count) - count
    start = (np.arange(len(owner)) - first[owner]) * length
    lens = np.minimum(length, sizes[owner] - start)
    flat = np.frombuffer(b"".join(texts) + bytes(length), np.uint8)
    base = (np.cumsum(sizes) - sizes)[owner] + start
    order = np.argsort(-lens, kind="stable")
    return flat[base[order] + np.arange(length)[:, None]], lens[order], owner[order]


def portions(texts: list[bytes], most: int) -> Iterator[tuple[np.ndarray, list[bytes]]]:
    """Texts in groups of about ``most`` bytes, with their numbers; a longer text is cut at whole segments, so its segments stay the same."""
    numbers, group, size = [], [], 0
    for i, t in enumerate(texts):
        for at in range(0, len(t), most):
            if size and size + len(t) - at > most:
                yield np.array(numbers), group
                numbers, group, size = [], [], 0
            numbers.append(i)
            group.append(t[at : at + most])
            size += len(group[-1])
    if group:
        yield np.array(numbers), group


class Network:
    """The parameters, and what is computed with them."""

    def __init__(self, langs: list[str], parts: dict[str, np.ndarray]):
        self.langs, self.parts = langs, parts

    @classmethod
    def fresh(cls, langs: list[str], seed: int = 5) -> Network:
        rng = np.random.default_rng(seed)
        shape = {"xf": (256, 2 * HIDDEN), "xb": (256, 2 * HIDDEN), "uf": (HIDDEN, 2 * HIDDEN), "ub": (HIDDEN, 2 * HIDDEN), "w": (2 * HIDDEN, len(langs)), "b": (len(langs),)}
        return cls(langs, {k: (rng.standard_normal(s) * 0.3).astype(np.float32) for k, s in shape.items()})

    def states(self, codes: np.ndarray, active: list[int], way: str, keep: list | None = None) -> np.ndarray:
        """All states of one direction; active[t]: segments that reach position t. keep gets what the gradient needs."""
        x, u = self.parts["x" + way], self.parts["u" + way]
        x, u = x.copy(), u.copy()
        x[:, :HIDDEN] *= 0.5  # sigmoid(s) = (1 + tanh(s / 2)) / 2: one tanh serves gate and candidate
        u[:, :HIDDEN] *= 0.5
        steps, lanes = codes.shape
        out = np.zeros((steps, lanes, HIDDEN), np.float32)
        h = np.zeros((lanes, HIDDEN), np.float32)
        for t in range(steps) if way == "f" else range(steps - 1, -1, -1):
            n = active[t]
            if n == 0:
                continue
            s = h[:n] @ u
            s += x.take(codes[t, :n], axis=0)
            np.tanh(s, out=s)
            z = s[:, :HIDDEN] * 0.5
            z += 0.5
            if keep is not None:
                keep.append((t, n, h[:n].copy(), z, s[:, HIDDEN:]))
            z2 = s[:, HIDDEN:] - h[:n]
            z2 *= z
            h[:n] += z2
            out[t, :n] = h[:n]
        return out

    def positions(self, codes: np.ndarray, lens: np.ndarray) -> np.ndarray:
        """Probabilities (position, segment, language)."""
        active = np.searchsorted(-lens, -np.arange(len(codes)), side="left").tolist()
        hf, hb = (self.states(codes, active, way) for way in "fb")
        logits = hf.reshape(-1, HIDDEN) @ self.parts["w"][:HIDDEN]
        logits += hb.reshape(-1, HIDDEN) @ self.parts["w"][HIDDEN:]
        logits += self.parts["b"]
        np.exp(np.clip(logits, -60, 60, out=logits), out=logits)
        logits /= logits.sum(1, keepdims=True)
        return logits.reshape(*codes.shape, -1)

    def pooled(self, texts: list[bytes]) -> np.ndarray:
        """Mean probabilities (text, language) over all bytes; zeros for an empty text."""
        total = np.zeros((len(texts), len(self.langs)))
        for numbers, group in portions(texts, AT_ONCE):
            codes, lens, owner = pieces(group, SEGMENT)
            for i in range(0, len(lens), LANES):
                n = lens[i : i + LANES]
                p = self.positions(codes[: n[0], i : i + LANES], n)
                p *= (np.arange(n[0])[:, None] < n)[:, :, None]
                np.add.at(total, numbers[owner[i : i + LANES]], p.sum(0))
        return total / np.maximum(1, [[len(t)] for t in texts])

    def gradients(self, codes: np.ndarray, lens: np.ndarray, label: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Cross entropy of the positions and its gradient by backpropagation through time."""
        active = np.searchsorted(-lens, -np.arange(len(codes)), side="left").tolist()
        kept: dict[str, list] = {"f": [], "b": []}
        hidden = {way: self.states(codes, active, way, kept[way]) for way in "fb"}
        both = np.concatenate([hidden["f"], hidden["b"]], axis=2)
        logits = both @ self.parts["w"] + self.parts["b"]
        logits -= logits.max(2, keepdims=True)
        p = np.exp(logits)
        p /= p.sum(2, keepdims=True)
        there = (np.arange(len(codes))[:, None] < lens).astype(np.float32)
        n = there.sum()
        rows = np.arange(len(lens))
        loss = float(-(np.log(p[:, rows, label] + 1e-9) * there).sum() / n)
        p[:, rows, label] -= 1
        p *= (there / n)[:, :, None]
        grads = {"w": np.einsum("tnh,tnl->hl", both, p), "b": p.sum((0, 1))}
        back = p @ self.parts["w"].T
        for k, way in enumerate("fb"):
            x, u = np.zeros_like(self.parts["x" + way]), np.zeros_like(self.parts["u" + way])
            carry = np.zeros((codes.shape[1], HIDDEN), np.float32)
            for t, m, h, z, c in reversed(kept[way]):
                dh = carry[:m] + back[t, :m, k * HIDDEN : (k + 1) * HIDDEN]
                ds = np.concatenate([dh * (c - h) * z * (1 - z), dh * z * (1 - c * c)], axis=1)
                np.add.at(x, codes[t, :m], ds)
                u += h.T @ ds
                carry[:m] = dh * (1 - z) + ds @ self.parts["u" + way].T
            grads["x" + way], grads["u" + way] = x, u
        return loss, grads


def fit(rows: list[tuple[bytes, str]], steps: int = STEPS, seed: int = 11) -> Network | None:
    """A network for labelled texts; None if there are none."""
    rows = [(t, lang) for t, lang in rows if t]
    if not rows:
        return None
    langs = sorted({lang for _, lang in rows})
    net = Network.fresh(langs)
    codes, lens, owner = pieces([t for t, _ in rows], PIECE)
    label = np.array([langs.index(lang) for _, lang in rows])[owner]
    by_lang = [np.flatnonzero(label == k) for k in range(len(langs))]
    rng, adam = np.random.default_rng(seed), common.Adam(net.parts, 0.02)
    for step in range(steps):
        pick = np.sort(np.concatenate([rng.choice(x, max(1, PIECES // len(langs))) for x in by_lang]))
        _, grads = net.gradients(codes[:, pick], lens[pick], label[pick])
        norm = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
        adam.step({k: g / max(1.0, norm) for k, g in grads.items()}, 1 - step / (steps + 1))
    return net


def sample(docs: DataFrame, id_col: str, text_col: str, lang_col: str, per_lang: int) -> list[tuple[bytes, str]]:
    """About per_lang labelled rows of each language, a piece of each; ROWS in all, but one of each language at least."""
    known = docs.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    counts = known.groupBy(F.col(lang_col).alias("lang")).count().orderBy("lang").collect()  # one row a language
    if not counts:
        return []
    per_lang = max(1, min(per_lang, ROWS // len(counts)))
    rate = F.element_at(F.create_map(*(x for r in counts for x in (F.lit(r["lang"]), F.lit(int(min(1.0, 1.2 * per_lang / r["count"]) * (1 << 40)))))), F.col(lang_col))
    key = F.xxhash64(F.lit(17), F.col(id_col), F.length(text_col))
    drawn = known.filter(F.pmod(key, F.lit(1 << 40)) < rate).select(key.alias("k"), common.slices(F.col(text_col), F.xxhash64(F.lit(3), key), 4 * PIECE).alias("t"), F.col(lang_col).alias("lang"))
    drawn = drawn.groupBy("k", "t", "lang").count().orderBy("k", "t").limit(2 * per_lang * len(counts)).collect()  # repeated rows count once
    seen: dict[str, int] = {}
    out = []
    for r in drawn:
        seen[r["lang"]] = seen.get(r["lang"], 0) + 1
        if seen[r["lang"]] <= per_lang:
            out.append((r["t"].encode(), r["lang"]))
    return out


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_lang: int = ROWS_PER_LANG) -> Network | None:
    """A network fitted to a bounded sample of each language; None if no row has a text and a language."""
    return fit(sample(docs, id_col, text_col, lang_col, per_lang))


def predictor(net: Network | None):
    """A UDF: text -> struct(lang_pred, score). A text that is null or has no letter gets ``und`` and score 0, as does every text if nothing was learned."""

    def start():
        def run(texts: list[bytes | None]):
            usable = [net is not None and t is not None and LETTER.search(t.decode()) is not None for t in texts]
            pred, score = [UNDETERMINED] * len(texts), np.zeros(len(texts))
            if any(usable):
                p = net.pooled([t for t, ok in zip(texts, usable, strict=True) if ok])
                for i, q in zip(np.flatnonzero(usable), p, strict=True):
                    pred[i], score[i] = net.langs[int(q.argmax())], min(1.0, float(q.max()))
            return pred, score

        return run

    return common.text_udf(start, "lang_pred string, score double")


def identify(docs: DataFrame, net: Network | None, text_col: str = "text", out: str = "language") -> DataFrame:
    """docs with a struct column ``out`` (lang_pred, score); every other column passes through.

    A null, empty or letterless text is ``und`` with score 0. Equal texts, repeated rows too, get equal values; of languages
    that tie the first by name wins. An empty table gives an empty one. A text of any length is read as a whole.
    """
    common.prepare(docs.sparkSession)
    return docs.withColumn(out, predictor(net)(F.col(text_col)))
