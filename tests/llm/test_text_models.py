"""Language ID, language-model scores and toxicity."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lakeloom.llm import common, langid, lm, queries, toxicity


def rest(doc_id, mod):
    return zlib.crc32(str(doc_id).encode()) % mod


@pytest.fixture(scope="module")
def docs(spark, sf):
    return {r["doc_id"]: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}


def test_recurrent_gradient_is_that_of_the_loss():
    net = langid.Network.fresh(["a", "b", "c"])
    codes, lens, owner = langid.pieces([b"abcdefgh", b"xyz", b"hello world"], 6)
    label = np.arange(len(lens)) % 3
    net.parts = {k: v.astype(np.float64) for k, v in net.parts.items()}
    _, grads = net.gradients(codes, lens, label)
    rng = np.random.default_rng(0)
    for name, g in grads.items():
        at = np.unravel_index(np.abs(g).argmax(), g.shape) if name[0] == "x" else tuple(rng.integers(0, n) for n in g.shape)
        at, keep = tuple(at), net.parts[name][tuple(at)]
        loss = []
        for d in (1e-2, -1e-2):
            net.parts[name][at] = keep + d
            loss.append(net.gradients(codes, lens, label)[0])
        net.parts[name][at] = keep
        assert (loss[0] - loss[1]) / 2e-2 == pytest.approx(g[at], rel=0.05, abs=2e-4), name


def test_segments_cover_all_bytes():
    texts = [b"", b"abc", bytes(range(256)) * 3, b"z" * 9]
    codes, lens, owner = langid.pieces(texts, 4)
    assert list(lens) == sorted(lens, reverse=True)
    for k, t in enumerate(texts):
        assert sum(lens[owner == k]) == len(t)
        assert sorted(b for j in np.flatnonzero(owner == k) for b in codes[: lens[j], j]) == sorted(t)


def test_language_of_held_out_documents(spark, sf, docs):
    got = queries.op1_language_id(spark, sf).collect()
    assert len(got) == len(docs) and all(r["held_out"] == (rest(r["doc_id"], 5) == 0) and 0 <= r["score"] <= 1 for r in got)
    held = [r for r in got if r["held_out"]]
    assert np.mean([r["lang_pred"] == docs[r["doc_id"]]["lang"] for r in held]) > 0.95


def test_language_of_odd_rows(spark, odd_docs, no_docs):
    net = langid.train(odd_docs, per_lang=50)
    got = langid.identify(odd_docs, net, out="found").select("doc_id", "text", "found.*", "language").collect()
    assert len(got) == 15 and {r["language"] for r in got} == {"y"}
    for r in got:
        assert (r["lang_pred"] == "und") == (r["text"] is None or not re.search(r"[^\W\d_]", r["text"]))
    assert langid.train(no_docs) is None and langid.identify(no_docs, None).count() == 0
    assert {r["lang_pred"] for r in langid.identify(odd_docs, None, out="f").select("f.lang_pred").collect()} == {"und"}


def test_pooled_probabilities_equal_a_plain_loop():
    net = langid.Network.fresh(["a", "b", "c"])
    p = {k: v.astype(np.float64) for k, v in net.parts.items()}
    texts = [b"hello", bytes(range(256)) * 3 + b"tail", b"x"]

    def run(seg, way):
        h, out = np.zeros(langid.HIDDEN), []
        for b in seg if way == "f" else seg[::-1]:
            s = p["x" + way][b] + h @ p["u" + way]
            z = 1 / (1 + np.exp(-s[: langid.HIDDEN]))
            h = h + z * (np.tanh(s[langid.HIDDEN :]) - h)
            out.append(h)
        return out if way == "f" else out[::-1]

    want = []
    for t in texts:
        probs = []
        for i in range(0, len(t), langid.SEGMENT):
            for f, b in zip(run(t[i : i + langid.SEGMENT], "f"), run(t[i : i + langid.SEGMENT], "b"), strict=True):
                e = np.exp(np.concatenate([f, b]) @ p["w"] + p["b"])
                probs.append(e / e.sum())
        want.append(np.mean(probs, axis=0))
    assert np.allclose(net.pooled(texts), want, atol=1e-5)


def test_long_texts_are_read_in_portions(monkeypatch):
    net, texts = langid.Network.fresh(["a", "b"]), [b"abc" * 900, b"", b"z" * 3000, b"q"]
    whole = net.pooled(texts)
    monkeypatch.setattr(langid, "AT_ONCE", 512)
    assert np.allclose(net.pooled(texts), whole, atol=1e-6)


def test_every_language_is_sampled_and_repeats_count_once(spark):
    rows = [(n, f"text number {n}", f"l{n % 150}") for n in range(600)] + [(9999, "the same", "l0")] * 500
    got = langid.sample(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"), "doc_id", "text", "lang", 400)
    assert len({lang for _, lang in got}) == 150 and sum(t == b"the same" for t, _ in got) <= 1


def test_attention_gradient_is_that_of_the_loss():
    pieces = np.random.default_rng(1).integers(0, 50, 300)
    model = lm.Model(pieces)
    model.parts = {k: v.astype(np.float64) for k, v in model.parts.items()}
    x, y, scored, _ = model.laid_out([np.arange(40), np.array([5, 5, 7]), np.zeros(0, int)])
    _, grads = model.step(x, y, scored)
    for name, g in grads.items():
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        keep, loss = model.parts[name][at], []
        for d in (1e-2, -1e-2):
            model.parts[name][at] = keep + d
            loss.append(model.step(x, y, scored)[0])
        model.parts[name][at] = keep
        assert (loss[0] - loss[1]) / 2e-2 == pytest.approx(g[at], rel=0.05, abs=2e-4), name


def test_each_subword_is_scored_once_and_probabilities_sum_to_one():
    model = lm.Model(np.random.default_rng(1).integers(0, 50, 300))
    x, y, scored, owner = model.laid_out([np.arange(40), np.array([5, 5, 7]), np.zeros(0, int)])
    assert sorted(y[y >= 0]) == sorted([*range(40), 5, 5, 7, *[model.end] * 3])
    g, _ = model.forward(model.inputs(x), scored)
    g = g * np.exp(model.parts["b2"])
    p = g / g.sum(1, keepdims=True)
    assert np.allclose((p[:, model.cls] * np.exp(model.within)).sum(1), 1, atol=1e-4)
    ids = [np.arange(100) % 37, np.arange(5)]
    both = model.log_probabilities(ids)
    assert len(both) == 107 and np.allclose(both, np.concatenate([model.log_probabilities([i]) for i in ids]), rtol=1e-4)
    # what comes later has no influence on what was scored before
    a, b = (model.log_probabilities([np.array(i)]) for i in ([1, 2, 3], [1, 2, 3, 4]))
    assert np.allclose(a[:3], b[:3], rtol=1e-5)


def test_log_probabilities_equal_a_plain_loop():
    model = lm.Model(np.random.default_rng(1).integers(0, 50, 300))
    p = {k: v.astype(np.float64) for k, v in model.parts.items()}
    texts = [np.arange(37) * 7 % 300, np.array([5, 5, 7]), np.zeros(0, int)]
    want = []
    for ids in texts:
        inputs, targets = [model.end, *ids], [*ids, model.end]
        e = p["e"][model.symbol[np.array(inputs)]]
        for i, target in enumerate(targets):
            first = max(0, i // lm.STRIDE * lm.STRIDE - lm.STRIDE)  # the window: its own row and the one before
            a = np.array([e[i] @ p["q"] @ (e[j] @ p["k"]) / math.sqrt(lm.WIDTH) + p["near"][i - j] for j in range(first, i + 1)])
            a = np.exp(a - a.max())
            o = (a / a.sum()) @ (e[first : i + 1] @ p["v"])
            g = np.tanh(np.concatenate([e[i], o]) @ p["w1"] + p["b1"]) @ p["w2"] + p["b2"]
            classes = g - np.log(np.exp(g).sum())
            want.append(classes[model.cls[target]] + model.within[target])
    assert np.allclose(model.log_probabilities(texts), want, rtol=1e-3, atol=1e-3)


def test_attention_learns_from_every_row(spark, monkeypatch):
    monkeypatch.setattr(lm.Model, "fit", lambda self, ids: None)  # no start: what is learned comes from the pass over all rows
    path, rng = queries.tokenizer_path(), np.random.default_rng(4)
    rows = [(i, " ".join(["red house by the old river"] * int(rng.integers(1, 60)))) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3, "doc_id")
    counts = lm.gather(docs, path)
    net, start = lm.train(docs, counts, path), lm.Model(counts.pieces)
    ids = lm.encoder(path).encode([t.encode() for _, t in rows])
    assert net.log_probabilities(ids).mean() > start.log_probabilities(ids).mean() + 0.1  # after three steps a task
    other = docs.withColumn("text", F.when(F.col("doc_id") == 299, F.array_join(F.reverse(F.split("text", " ")), " ")).otherwise(F.col("text")))
    assert (lm.train(other, counts, path).flat() != net.flat()).any()  # the same counts, one row in another order
    assert (lm.train(docs, counts, path).flat() == net.flat()).all()


def test_runs_of_windows_have_the_gradient_of_single_ones():
    model = lm.Model(np.random.default_rng(1).integers(0, 50, 300))
    x, y, _, _ = model.laid_out([np.arange(200) % 300, np.arange(40), np.array([5, 5, 7]), np.zeros(0, int)])
    rows = np.arange(1, 1 + (len(x) - 1) // 4 * 4)
    one, apart = model.step(x, y, rows)
    runs, together = model.step(x, y, rows.reshape(-1, 4)[::-1])
    assert one == pytest.approx(runs, rel=1e-5)
    assert all(np.allclose(apart[k], together[k], rtol=1e-3, atol=1e-6) for k in apart)


def test_each_window_is_learned_once(monkeypatch):
    model, seen = lm.Model(np.random.default_rng(1).integers(0, 50, 300)), []
    monkeypatch.setattr(lm, "PASS_WINDOWS", 2 * lm.RUN)
    step = lm.Model.step
    monkeypatch.setattr(lm.Model, "step", lambda self, x, y, at, sx: (seen.extend(at.reshape(-1)), step(self, x, y, at, sx))[1])
    ids = [np.arange(n) % 300 for n in (700, 3, 0, 90)]
    _, _, scored, _ = model.laid_out(ids)
    assert model.learn(ids, common.Adam(model.parts, 0.01), np.random.default_rng(2)) == len(scored)
    assert len(set(seen)) == len(seen) and set(scored) <= set(seen)
    assert model.learn([], common.Adam(model.parts, 0.01), np.random.default_rng(2)) == 0


def test_ids_are_encoded_once_and_kept(spark, odd_docs):
    path = queries.tokenizer_path()
    counts = lm.gather(odd_docs, path)
    kept = odd_docs.select("text", lm.words_and_ids(counts, path, spark)("text").alias("s")).select("text", "s.*")
    tokenizer = lm.encoder(path).tokenizer
    for r in kept.collect():
        ids = tokenizer.encode(r["text"] or "", add_special_tokens=False).ids
        assert np.frombuffer(r["ids"], lm.id_type(tokenizer.get_vocab_size())).tolist() == ids
        parts, hot = np.frombuffer(r["parts"], np.int32), np.frombuffer(r["hot"], np.int32)
        assert parts.sum() == len(ids) and len(parts) == len(hot) == r["n_tokens"] - 1 and (hot < 0).sum() == len(r["rare"])
    from_words = counts.pieces.copy()
    counts.count_ids(kept)
    assert (counts.pieces == from_words).all()
    for kind in (np.uint16, np.int32):
        array = lm.packed(np.arange(7).astype(kind), np.array([3, 0, 4])).slice(1)
        assert [x.tolist() for x in lm.unpacked(array, kind)] == [[3, 4, 5, 6], [0, 4]]


def test_hot_words_are_found_where_all_are_frequent(spark, monkeypatch):
    monkeypatch.setattr(lm, "HOT_WORDS", 3)
    monkeypatch.setattr(lm, "EXACT", 2)
    words = [w for k, w in enumerate("abcdefgh") for _ in range(2 ** (k + 2))]
    counts = lm.gather(spark.createDataFrame([(" ".join(words),)], "text string"), queries.tokenizer_path())
    assert set(counts.hot) == {b"f", b"g", b"h"} and counts.hot[b"h"] == 512


def brute_base(rows, learned):
    counts, words = Counter(), {}
    for d, t in rows:
        words[d] = (t or "").encode().lower().split()
        if learned(d):
            counts.update(words[d])
            counts[None] += 1
    n, v = sum(counts.values()), len(counts)
    return {d: (len(w) + 1, sum(counts[x] > 0 for x in [*w, None]), n, sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in [*w, None])) for d, w in words.items()}


@pytest.mark.parametrize("hot", [None, 100])
def test_lm_base_equals_brute_force(spark, sf, docs, monkeypatch, hot):
    if hot:
        monkeypatch.setattr(lm, "HOT_WORDS", hot)
    want = brute_base([(d, r["text"]) for d, r in docs.items()], lambda d: rest(d, 7) != 2)
    got = queries.op2_lm_scoring(spark, sf).collect()
    assert len(got) == len(want)
    for r in got:
        n, known, total, base = want[r["doc_id"]]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"], r["held_out"]) == (n, known, total, rest(r["doc_id"], 7) == 2)
        assert r["base_score"] == pytest.approx(base, rel=1e-9) and r["score"] < 0
    held = [r for r in got if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_lm_odd_rows(spark, odd_docs, no_docs):
    path = queries.tokenizer_path()
    got = lm.score(odd_docs, common.crc_mod("doc_id", 7) != 2, path).collect()
    assert len(got) == 15 and {r["n_tokens"] for r in got if r["doc_id"] in (0, 1, 2)} == {1}
    assert lm.score(no_docs, common.crc_mod("doc_id", 7) != 2, path).count() == 0
    none = lm.score(odd_docs, common.crc_mod("doc_id", 7) > 99, path).collect()
    assert {(r["n_known"], r["train_tokens"], r["base_score"]) for r in none} == {(0, 0, 0.0)}


def test_toxicity_of_held_out_labels(spark, small, sf, docs):
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    got = queries.op4_toxicity(spark, sf).collect()
    assert len(got) == len(docs) and all(r["held_out"] == (rest(r["doc_id"], 3) == 1) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in got)
    clean = [r["score"] for r in got if r["held_out"] and labels.get(r["doc_id"]) == 0]
    toxic = [r["score"] for r in got if r["held_out"] and labels.get(r["doc_id"]) == 1]
    assert np.mean([t > c for t in toxic for c in clean]) > 0.8


def test_non_negative_risk_learns_from_unlabelled():
    rng = np.random.default_rng(2)
    text = lambda bad: " ".join([*rng.choice(["alpha", "beta", "gamma", "delta"], 6), *(["scoundrel"] if bad else [])]).encode()
    seen = lambda bad: toxicity.features(text(bad))
    model = toxicity.fit([seen(True) for _ in range(200)], [seen(i % 10 == 0) for i in range(2000)], 0.1)
    texts = [text(True), text(False), None, b"", b"Scoundrel, SCOUNDREL!"]
    got = model.scores(texts)
    assert got[0] > 0.7 > 0.3 > got[1]
    for t, score in zip(texts, got, strict=True):
        words = set(re.findall("[a-z]+", (t or b"").decode().lower()))
        marks = words | {w[:n] + "-" for w in words for n in (4, 5) if len(w) > n}
        assert score == pytest.approx(1 / (1 + math.exp(-model.bias - sum(model.weights.get(f, 0) for f in marks))))
    assert toxicity.fit([], [{"a"}], 0.2).scores([b"anything"])[0] == pytest.approx(0.2)


def test_long_texts_teach_toxicity(spark):
    rng = np.random.default_rng(4)
    long = lambda bad: " ".join([*rng.choice([f"word{i}" for i in range(300)], 2000), *(["scoundrel"] if bad else [])])
    rows = [(i, long(i % 4 == 0)) for i in range(400)]
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(0, 400, 2)], "doc_id bigint, toxic int")
    model = toxicity.train(spark.createDataFrame(rows, "doc_id bigint, text string"), labels, lambda c: common.crc_mod(c, 3) < 9)
    assert model.weights["scoundrel"] > 0.5


def test_toxicity_odd_rows(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(3, 1), (3, 1), (4, None), (None, 1), (7, 0)], "doc_id bigint, toxic int")
    model = toxicity.train(odd_docs, labels, lambda c: common.crc_mod(c, 3) < 9)
    got = toxicity.score(odd_docs, model).select("doc_id", "toxicity.score").collect()
    assert len(got) == 15 and all(0 <= r["score"] <= 1 for r in got) and len({r["score"] for r in got if r["doc_id"] in (0, 1, 2)}) == 1
    assert toxicity.score(no_docs, toxicity.train(no_docs, labels.filter("false"), lambda c: common.crc_mod(c, 3) < 9)).count() == 0
