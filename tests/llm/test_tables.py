"""Mixing, token files, media columns, URL filters and personal data."""

import datetime
import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from lakeloom.llm import media, mixing, pii, queries, tokens, urlfilter, webp


def brute_targets(size_of, weights=(1, 2, 3)):
    names = sorted((s for s in size_of if s is not None), key=lambda s: s.encode()) + [s for s in size_of if s is None]
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    target, capped, total = {}, set(), sum(size_of.values())
    while True:
        left = total - sum(3 * size_of[s] for s in capped)
        free = [s for s in names if s not in capped]
        target = {s: 3.0 * size_of[s] for s in capped} | {s: left * w[s] / sum(w[x] for x in free) for s in free}
        over = {s for s in free if target[s] > 3 * size_of[s] + 1e-9}
        if not over:
            return target
        capped |= over


def held_against_brute_force(rows, docs):
    size_of, most = {}, {}
    for d, t, s in docs:
        n = len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
        size_of[s] = size_of.get(s, 0) + n
        most[s] = max(most.get(s, 0), n)
    target = brute_targets(size_of)
    taken = dict.fromkeys(size_of, 0)
    source = {}
    for d, t, s in docs:
        source.setdefault(d, set()).add(s)
    assert len(rows) == len(docs)
    for r in rows:
        s = next(x for x in source[r["doc_id"]] if size_of[x] == r["source_size"] and target[x] == pytest.approx(r["target"]))
        taken[s] += r["taken"]
        assert r["size"] == 0 and r["taken"] == 0 or r["taken"] % r["size"] == 0 and r["taken"] <= 3 * r["size"]
    for s in size_of:
        assert abs(taken[s] - target[s]) <= most[s] + 1e-6, s


def test_mix_meets_its_targets(spark, sf):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "source").collect()]
    rows = queries.op7_source_mixing(spark, sf).collect()
    held_against_brute_force(rows, docs)
    assert sorted(rows) == sorted(queries.op7_source_mixing(spark, sf).collect())


def test_mix_odd_rows(spark, odd_docs, no_docs):
    rows = mixing.mix(odd_docs).collect()
    held_against_brute_force(rows, [(r["doc_id"], r["text"], r["source"]) for r in odd_docs.collect()])
    assert mixing.mix(no_docs).count() == 0
    assert [r["taken"] for r in mixing.mix(odd_docs.filter("text is null")).collect()] == [0]


def test_token_files_equal_whole_texts(spark, sf):
    from tokenizers import Tokenizer

    tk = Tokenizer.from_file(queries.tokenizer_path())
    start = 0
    got = {r["doc_id"]: r for r in queries.op8_token_ids(spark, sf).collect()}
    for r in sorted(spark.read.parquet(f"{sf}/documents.parquet").collect(), key=lambda r: r["doc_id"]):
        ids = [*tk.encode(r["text"], add_special_tokens=False).ids, 1]
        g = got[r["doc_id"]]
        assert (g["start"], g["n_tokens"], g["ids_crc32"]) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


@pytest.mark.parametrize("delta", [False, True])
def test_token_files_of_odd_rows(spark, odd_docs, no_docs, tmp_path, delta):
    import pyarrow.parquet as pq
    from tokenizers import Tokenizer

    path = queries.tokenizer_path()
    tk = Tokenizer.from_file(path)
    tokens.write(odd_docs, f"file://{tmp_path}/t", path, delta=delta)
    want = sorted((-1 if r["doc_id"] is None else r["doc_id"], [*tk.encode(r["text"] or "", add_special_tokens=False).ids, 1]) for r in odd_docs.collect())
    assert sorted((-1 if r["doc_id"] is None else r["doc_id"], r["tokens"]) for r in tokens.read(spark, f"file://{tmp_path}/t").collect()) == want
    files = sorted((tmp_path / "t").glob("*.parquet"))
    column = [c for f in files if (m := pq.read_metadata(f)).num_row_groups for c in [m.row_group(0).column(2)]]
    assert all(("DELTA_BINARY_PACKED" in c.encodings) == delta for c in column) and all(c.has_column_index and c.has_offset_index for c in column)
    got = sorted((r["start"], -1 if r["doc_id"] is None else r["doc_id"], r["n_tokens"]) for r in tokens.digest(spark, f"file://{tmp_path}/t").collect())
    starts = np.cumsum([0, *(g[2] for g in got)])[:-1].tolist()
    assert [g[0] for g in got] == starts and [g[1] for g in got] == sorted(g[1] for g in got)
    tokens.write(no_docs, f"file://{tmp_path}/e", path)
    assert tokens.digest(spark, f"file://{tmp_path}/e").count() == 0


def test_webp_features_round_trip():
    rng = np.random.default_rng(1)
    noise = rng.integers(0, 256, (9, 13, 4), np.uint8)
    few = rng.choice(np.array([[1, 2, 3, 255], [9, 9, 9, 255], [200, 1, 7, 128]], np.uint8), (7, 10))
    many = rng.choice(rng.integers(0, 256, (40, 4), np.uint8), (12, 11))
    flat = np.zeros((5, 6, 4), np.uint8)
    tile = np.tile(rng.integers(0, 256, (3, 8, 4), np.uint8), (6, 2, 1))
    options = [{}, {"subtract": True}, {"cross": (30, 250, 17)}, {"cache_bits": 5}, {"references": True}, {"references": True, "cache_bits": 3, "subtract": True, "cross": (5, 9, 200)}]
    options += [{"predictor": k} for k in range(14)] + [{"predictor": 3, "subtract": True, "cross": (1, 2, 3), "block_bits": 3, "references": True}]
    for image in (noise, few, many, flat, tile, noise[:1, :1]):
        for o in options:
            assert np.array_equal(webp.decode(webp.encode(image, **o)), image), o
        assert all(np.array_equal(webp.decode(f(image)), image) for f in (webp.encode_fitted, webp.encode_best))
    for image in (few, many, flat, few[:, :3]):
        for o in ({"palette": True}, {"palette": True, "references": True}, {"palette": True, "predictor": 0, "cache_bits": 2}):
            assert np.array_equal(webp.decode(webp.encode(image, **o)), image), o
    two = np.where(rng.random((4, 21, 1)) < 0.5, np.array([[[0, 0, 0, 255]]], np.uint8), np.array([[[255, 255, 255, 255]]], np.uint8))
    assert np.array_equal(webp.decode(webp.encode(two, palette=True)), two)
    assert len(webp.NEAR) == 120 and webp.NEAR[:6] == [(0, 1), (1, 0), (1, 1), (-1, 1), (0, 2), (2, 0)] and webp.NEAR[-1] == (8, 7)


def test_files_are_read_side_by_side_as_one_by_one():
    rng = np.random.default_rng(2)
    texts = [b"", b"a", b"ab", "été 東京 🎉 ".encode() * 700, b"word " * 9000, bytes(rng.integers(0, 256, 20_000, np.uint8)), bytes(rng.integers(97, 105, 30_000, np.uint8)), bytes(rng.integers(97, 101, 9_000, np.uint8)), bytes(rng.choice([97, 98, 99], 50_000, p=[0.9, 0.05, 0.05]).astype(np.uint8))]
    texts += [" ".join(f"w{x}" for x in rng.zipf(1.3, n) % 5000).encode() for n in (3, 30, 300, 9000)]
    payloads = [media.payload(t) for t in texts]
    stored = [media.to_media(p) for p in payloads]
    together = [b"".join(p.tobytes() for p in pixels) for pixels in media.images(stored)]
    assert together == payloads == [b"".join(webp.decode(f).tobytes() for f in media.files(m)) for m in stored]
    assert any(webp.opened(m).body.alike() for m in stored) and any(webp.opened(m).transforms for m in stored) and any(webp.opened(m).body.cache_bits for m in stored)
    assert all(len(m) < len(p) for m, p in zip(stored, payloads, strict=True) if len(p) > 1000 and len(set(p)) < 250)
    data = stored[-1]
    for bad in (data[:-99], b"RIFFxxxxWEBPVP8 ", b"\x00abc"):
        for read in (webp.decode, lambda f: webp.decode_many([stored[-2], f])):
            with pytest.raises(ValueError):
                read(bad)


def test_media_round_trip(spark, sf, odd_docs, no_docs):
    for docs, got in ((spark.read.parquet(f"{sf}/documents.parquet"), queries.op9_media_columns(spark, sf)), (odd_docs, media.describe(odd_docs))):
        want = []
        for r in docs.collect():
            b = (r["text"] or "").encode()
            p = b + bytes(max(64, -(-len(b) // 64) * 64) - len(b))
            want.append((str(r["doc_id"]), len(b), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:])))
        rows = got.collect()
        assert sorted((str(r["doc_id"]), r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) for r in rows) == sorted(want)
        assert len({(r["payload_sha256"], r["media_sha256"], r["feature"], r["media_bytes"]) for r in rows}) == len({r["payload_sha256"] for r in rows})
    assert media.describe(no_docs).count() == 0
    big = media.payload(b"ab" * 1_500_000)
    assert b"".join(p.tobytes() for p in media.images([media.to_media(big)])[0]) == big


def test_url_rules_and_list(spark):
    urls = [None, "no scheme", "http://Example.ORG/es/x", "https://a.example.org:80/en/12?q", "http://example.org/en/2", "http://x.com/fr/", "http://x.com/de/1#f", "http://x.com/de", "http://xcom/de/", "http://n.net/a/?b=2&a=1&utm_x=3", "https://www.N.net/a?a=1&b=2#top", "http://n.net/a", "x://", "http://n.net?a=1", "http://n.net/a?b=2&a=1", "http://n.net/a?b=2&a=1"]
    pages = spark.createDataFrame([(i if i else None, u, 0) for i, u in enumerate(urls)], "page_id bigint, url string, name int")
    listed = spark.createDataFrame([("http://n.net/a?a=1&b=2",), (None,), ("http://n.net/a?a=1&b=2",), ("junk",)], "url string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in urlfilter.judge(pages, listed).collect()}
    assert len(got) == len(urls)
    assert got[None] == ("", "", None, "allow") and got[1] == ("", "", None, "allow") and got[12] == ("", "", None, "allow")
    assert got[2] == ("example.org", "/es/x", "example.org/es/", "block") and got[3] == ("a.example.org:80", "/en/12", None, "allow")
    assert got[4] == ("example.org", "/en/2", "org/", "allow") and got[5][2:] == ("com/fr/", "allow") and got[6][1:] == ("/de/1", "com/de/", "block") and got[7][2:] == (None, "allow") and got[8][2] is None
    assert [got[i][3] for i in (9, 10, 11, 13, 14, 15)] == ["block", "block", "allow", "allow", "block", "block"]
    assert urlfilter.judge(pages.filter("false"), listed).count() == 0 and urlfilter.judge(pages, listed.filter("false")).filter("listed").count() == 0


def test_bloom_filter_has_no_false_negative(spark):
    names = spark.createDataFrame([(f"h{i}.net/p/{i}",) for i in range(3000)], "name string")
    words = urlfilter.bloom(names, "name")
    probe = names.union(spark.createDataFrame([(f"x{i}",) for i in range(3000)], "name string"))
    got = probe.select("name", urlfilter.may_have(words, spark, probe["name"]).alias("hit")).collect()
    assert all(r["hit"] for r in got if r["name"].startswith("h")) and sum(r["hit"] for r in got if r["name"].startswith("x")) < 100


def luhn(d):
    return sum(int(c) if i % 2 == 0 else (int(c) * 2 - 9 * (int(c) > 4)) for i, c in enumerate(reversed(d))) % 10 == 0


def test_pseudonyms_keep_format_validity_and_links(spark):
    rng = random.Random(3)
    cards = []
    for _ in range(60):
        body = "".join(rng.choice("0123456789") for _ in range(rng.choice([12, 14, 15, 18])))
        cards.append(next(body + c for c in "0123456789" if luhn(body + c)))
    days = [(datetime.date(1950, 1, 1) + datetime.timedelta(rng.randrange(30000))) for _ in range(60)]
    values = {"card": cards + [f"{c[:4]}-{c[4:8]}-{c[8:12]}-{c[12:]}" for c in cards if len(c) == 16], "iso": [d.isoformat() for d in days], "dot": [d.strftime("%d.%m.%Y") for d in days], "us": [d.strftime("%m/%d/%Y") for d in days]}
    values["ip"] = [".".join(str(rng.randrange(256)) for _ in range(4)) for _ in range(60)]
    values["ssn"] = [f"{rng.choice([1, 77, 665, 667, 899]):03d}-{rng.randrange(1, 100):02d}-{rng.randrange(1, 10000):04d}" for _ in range(60)]
    values["phone"] = [f"+1 ({rng.randrange(200, 1000)}) 555-{rng.randrange(10000):04d}" for _ in range(60)] + [f"{rng.randrange(200, 1000)}-{rng.randrange(200, 1000)}-{rng.randrange(10000):04d}" for _ in range(30)]
    values["mail"] = [f"a{i}.b@mail{i}.example.com" for i in range(30)]
    rows = [(i, k, f"Text, {v}; again {v}.") for i, (k, v) in enumerate((k, v) for k, vs in values.items() for v in vs)]
    docs = spark.createDataFrame(rows, "doc_id int, kind string, text string")
    seen: dict = {}
    for r in pii.pseudonymise(docs, out="new").collect():
        a, b = re.fullmatch(r"Text, (.*); again (.*)\.", r["new"]).groups()
        old = re.fullmatch(r"Text, (.*); again .*", r["text"])[1]
        assert a == b and (a != old or r["kind"] != "card") and seen.setdefault((r["kind"], old), a) == a
        if r["kind"] != "mail":
            assert re.sub(r"\d+" if r["kind"] == "ip" else r"\d", "9", a) == re.sub(r"\d+" if r["kind"] == "ip" else r"\d", "9", old)
        if r["kind"] == "card":
            assert luhn(re.sub(r"\D", "", a))
        if r["kind"] in ("iso", "dot", "us"):
            datetime.datetime.strptime(a, {"iso": "%Y-%m-%d", "dot": "%d.%m.%Y", "us": "%m/%d/%Y"}[r["kind"]])
        if r["kind"] == "ip":
            assert all(int(x) < 256 for x in a.split("."))
        if r["kind"] == "ssn":
            assert re.fullmatch(r"(?!666|000|9)\d{3}-(?!00)\d\d-(?!0000)\d{4}", a)
    for kind in values:
        assert len({v for (k, _), v in seen.items() if k == kind}) == len({o for (k, o) in seen if k == kind}), kind


def test_invalid_values_and_odd_rows_stay(spark, odd_docs, no_docs):
    texts = ["4041894974608796 no card", "2024-02-30", "31.02.2020", "300.1.2.3", "666-12-1234 and 000-11-1111", "1.2.3.4.5", "v1.2.3", "a@b", None, "", "12345", "order 2024-13-01"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id int, text string")
    assert [r["text"] for r in pii.pseudonymise(docs).orderBy("doc_id").collect()] == texts
    before, after = ({r["doc_id"]: r["text"] for r in d.collect()} for d in (odd_docs, pii.pseudonymise(odd_docs)))
    assert before == after and pii.pseudonymise(no_docs).count() == 0
    long = spark.createDataFrame([(1, "a" * 100_000 + " 1" * 30_000 + " x@y.com")], "doc_id int, text string")
    assert pii.pseudonymise(long).first()["text"].endswith("@y.com")


def test_small_feistel_is_a_permutation(spark):
    pair = pii.feistel("x div 7", "x % 7", "5", "7", "t", "key")
    got = [(r[0], r[1]) for r in spark.range(35).selectExpr("id as x").selectExpr(f"{pair} as p").select("p.a", "p.b").collect()]
    assert sorted(got) == [(a, b) for a in range(5) for b in range(7)] and got != sorted(got)


def test_digest_reads_the_tokens_once(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"some words {i}") for i in range(50)], "doc_id bigint, text string")
    tokens.write(docs, f"file://{tmp_path}/t", queries.tokenizer_path())
    got = tokens.digest(spark, f"file://{tmp_path}/t")
    assert "tokens:array" not in got._jdf.queryExecution().executedPlan().toString()
    assert sorted(r["doc_id"] for r in got.collect()) == list(range(50))
