"""Golay keys, SimHash links and components."""

import numpy as np
import pytest
from xxhash import xxh64_intdigest

from lakeloom.llm import common, golay, graph, nearcopies, queries, simhash


def brute_print(text, k=3):
    w = (text or "").encode().lower().split()
    sh = [b" ".join(w[i : i + k]) for i in range(max(1, len(w) - k + 1))] if w else []
    h = [xxh64_intdigest(s, 42) for s in sh]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def brute_components(prints):
    """prints: [(id, fingerprint)]; id -> least id that can be reached at 3 bits."""
    distinct = sorted({f for _, f in prints})
    parent = list(range(len(distinct)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    a = np.array(distinct, np.uint64)
    for i in range(len(a)):
        for j in np.flatnonzero(np.bitwise_count(a[i] ^ a[i + 1 :]) <= 3) + i + 1:
            parent[root(int(j))] = root(i)
    where = {f: root(i) for i, f in enumerate(distinct)}
    least = {}
    for d, f in prints:
        if d is not None:
            least[where[f]] = min(d, least.get(where[f], d))
    return [(d, f"{f:016x}", least.get(where[f])) for d, f in prints]


def test_code_is_perfect_and_near_words_share_a_key():
    _, errors = golay.tables()
    assert set((errors >= 0).sum(1)) == {1, 6} and errors[:, 0].min() >= 0
    rng = np.random.default_rng(3)
    w = rng.integers(0, 1 << 23, 3000)
    for a, b in zip(golay.keys(w), golay.keys(w ^ (1 << rng.integers(0, 23, 3000))), strict=True):
        assert set(a[a >= 0]) & set(b[b >= 0])


def test_keys_of_all_distances_up_to_three_meet():
    rng = np.random.default_rng(4)
    a = rng.integers(0, 1 << 63, 4000, dtype=np.uint64) * 2
    b = a.copy()
    for i in range(len(b)):
        for bit in rng.choice(64, i % 4, replace=False):
            b[i] ^= np.uint64(1) << np.uint64(bit)
    (ra, ka), (rb, kb) = simhash.bucket_keys(a), simhash.bucket_keys(b)
    pairs = set(zip(ra.tolist(), ka.tolist(), strict=True))
    met = {r for r, k in zip(rb.tolist(), kb.tolist(), strict=True) if (r, k) in pairs}
    assert met == set(range(len(a)))


def test_fingerprints_equal_brute_force(spark, odd_docs):
    texts = [r["text"] for r in odd_docs.collect()]
    got = simhash.fingerprints([t.encode() if t is not None else None for t in texts], 3)
    assert got.tolist() == [brute_print(t) for t in texts]


def test_query_equals_brute_force(spark, sf):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    want = brute_components([(d, brute_print(t)) for d, t in docs])
    got = [tuple(r) for r in queries.op3_simhash_near_dedup(spark, sf).select("doc_id", "fingerprint", "component_id").collect()]
    assert sorted(got) == sorted(want)


def test_odd_rows(spark, odd_docs, no_docs):
    want = brute_components([(r["doc_id"], brute_print(r["text"])) for r in odd_docs.collect()])
    got = [tuple(r) for r in simhash.near_duplicates(odd_docs).collect()]
    key = lambda r: (str(r[0]), r[1], str(r[2]))
    assert sorted(got, key=key) == sorted(want, key=key)
    assert simhash.near_duplicates(no_docs).count() == 0
    with pytest.raises(ValueError):
        simhash.links(odd_docs.select("bits"), 4)


def test_dense_and_chained_links_keep_components(spark):
    rng = np.random.default_rng(5)
    prints, now = [], 0x0123456789ABCDEF
    for _ in range(300):  # a chain of steps of three bits
        for b in rng.choice(64, 3, replace=False):
            now ^= 1 << int(b)
        prints.append(now)
    for _ in range(1500):  # a dense ball
        x = 0x5555AAAA00FF00FF
        for b in rng.choice(64, rng.integers(0, 3), replace=False):
            x ^= 1 << int(b)
        prints.append(x)
    prints += [int(x) for x in rng.integers(0, 1 << 63, 500)]
    signed = sorted({p - (1 << 64) if p >> 63 else p for p in prints})
    edges = simhash.links(spark.createDataFrame([(p,) for p in signed], "bits bigint"))
    got = {r["node"]: r["component"] for r in graph.components(edges).collect()}
    want = {d: c for d, _, c in brute_components([(p, p % (1 << 64)) for p in signed])}
    assert {d: got.get(d, d) for d in signed} == want
    assert edges.count() < 48 * len(signed)


def test_components_of_paths_loops_and_nothing(spark):
    edges = [(i, i + 1) for i in range(100, 200)] + [(7, 7), (5, 3), (3, 5), (3, 4)]
    got = {r["node"]: r["component"] for r in graph.components(spark.createDataFrame(edges, "u bigint, v bigint")).collect()}
    assert got == {**{i: 100 for i in range(100, 201)}, 7: 7, 3: 3, 4: 3, 5: 3}
    assert graph.components(spark.createDataFrame([], "u bigint, v bigint")).count() == 0


def brute_near_copies(docs, similarity=0.8):
    """docs: [(id, text)], ids not null; id -> least id reached by links of whole texts' sets of five-word shingles."""

    def words(text):
        w = (text or "").encode().lower().split()
        return frozenset(b" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()

    sets = [(d, words(t)) for d, t in docs]
    distinct = list({s for _, s in sets})
    parent = list(range(len(distinct)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    holders = {}
    for i, s in enumerate(distinct):
        shared = {}
        for x in s:
            for j in holders.setdefault(x, []):
                shared[j] = shared.get(j, 0) + 1
            holders[x].append(i)
        for j, n in shared.items():
            if n >= similarity * (len(s) + len(distinct[j]) - n):
                parent[root(j)] = root(i)
    where = {s: root(i) for i, s in enumerate(distinct)}
    least = {}
    for d, s in sets:
        if d is not None:
            least[where[s]] = min(d, least.get(where[s], d))
    return {(d, least.get(where[s])) for d, s in sets}


def test_near_copies_equal_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    assert {tuple(r) for r in nearcopies.near_copies(docs).collect()} == brute_near_copies([tuple(r) for r in docs.collect()])


def edited(base, edits, rng):
    w = list(base)
    for at in rng.choice(len(w), edits, replace=False):
        w[at] = f"changed{rng.integers(1 << 40)}"
    return " ".join(w)


def test_near_copies_of_many_edits_and_a_large_group(spark):
    rng = np.random.default_rng(6)
    docs = []
    for n in range(150):  # pairs of 300 words with up to 12 changed words: similarities from 0.67 to 1
        base = [f"w{x}" for x in rng.integers(0, 5000, 300)]
        docs += [(2 * n, " ".join(base)), (2 * n + 1, edited(base, n % 13, rng))]
    hot = [f"h{x}" for x in rng.integers(0, 5000, 400)]
    docs += [(1000 + n, edited(hot, 2, rng)) for n in range(200)]
    got = {tuple(r) for r in nearcopies.near_copies(spark.createDataFrame(docs, "doc_id bigint, text string").repartition(4)).collect()}
    assert got == brute_near_copies(docs) and all(c == 1000 for d, c in got if d >= 1000)


def test_ties_are_the_same_however_rows_come(monkeypatch):
    import pyarrow as pa

    rng = np.random.default_rng(7)
    origins = rng.integers(0, 1 << 63, (3, 4), dtype=np.uint64)
    ids = np.arange(30_000)
    wide = origins[ids % 3] ^ (np.uint64(1) << rng.integers(0, 64, (len(ids), 4), dtype=np.uint64))  # members differ from what they are tied to
    parts = [pa.array(wide[:, i].view(np.int64)) for i in range(4)]
    rows = pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), 4)), pa.array(ids), pa.nulls(len(ids), pa.int64()), pa.array(np.full(len(ids), 9, np.int32)), *parts], names=["key", "id", "to", "n", *nearcopies.WIDE])
    got = []
    for held in (50, 7_000, 100_000):
        monkeypatch.setattr(nearcopies, "ROWS", held)
        got.append({e for b in nearcopies.close(0.8)([rows.slice(a, 40) for a in range(0, len(ids), 40)]) for e in zip(b["u"].to_pylist(), b["v"].to_pylist(), strict=True)})
    assert got[0] == got[1] == got[2] == {(i % 3, i) for i in range(3, len(ids))}


def test_a_bucket_sends_few_rows_through_the_shuffle():
    import pyarrow as pa

    n = 4000
    wide = np.full((n, 4), 77, np.uint64)
    wide[:, 0] ^= np.uint64(1) << np.arange(n, dtype=np.uint64) % np.uint64(23)
    names = ["id", "n", *nearcopies.WIDE, *nearcopies.LEAST]
    columns = [pa.array(np.arange(n)), pa.array(np.full(n, 5, np.int32)), *(pa.array(wide[:, i].view(np.int64)) for i in range(4)), *[pa.array(np.zeros(n, np.int64))] * 9]
    sent = list(nearcopies.keyed(0.8)([pa.RecordBatch.from_arrays(columns, names=names)]))
    assert sum(b["to"].null_count for b in sent) < 500 and {v for b in sent for v in b["id"].to_pylist()} == set(range(n))


def test_odd_rows_of_near_copies(spark, odd_docs, no_docs):
    key = lambda r: tuple(map(str, r))
    want = brute_near_copies([(r["doc_id"], r["text"]) for r in odd_docs.collect()])
    got = [tuple(r) for r in nearcopies.near_copies(odd_docs).collect()]
    assert sorted(set(got), key=key) == sorted(want, key=key) and len(got) == odd_docs.count()
    assert nearcopies.near_copies(no_docs).count() == 0
    with pytest.raises(ValueError):
        nearcopies.near_copies(odd_docs, similarity=0.5)


def test_copies_that_only_their_base_links(spark):
    rng = np.random.default_rng(8)
    base = [f"b{x}" for x in rng.integers(0, 5000, 300)]
    docs = [(n, edited(base, 6, rng)) for n in range(300)]  # base and copy 0.82, copy and copy about 0.70
    docs[150] = (150, " ".join(base))
    got = {tuple(r) for r in nearcopies.near_copies(spark.createDataFrame(docs, "doc_id bigint, text string").repartition(4)).collect()}
    assert got == brute_near_copies(docs) and {c for _, c in got} == {0}


def test_short_texts_of_exactly_this_similarity(spark):
    rng = np.random.default_rng(9)
    docs = []
    for n in range(500):
        words = [f"s{x}" for x in rng.integers(0, 100_000, 9)]
        docs += [(2 * n, " ".join(words[:8])), (2 * n + 1, " ".join(words))]  # 4 and 5 shingles
    got = {tuple(r) for r in nearcopies.near_copies(spark.createDataFrame(docs, "doc_id bigint, text string").repartition(4)).collect()}
    assert got == brute_near_copies(docs) and len({c for _, c in got}) == 500


def test_chains_in_which_only_neighbours_are_similar(spark):
    rng = np.random.default_rng(10)
    words = [f"c{x}" for x in rng.integers(0, 5000, 300)]
    texts = []
    for n in range(150):  # each text differs in four words from the one before
        words[2 * n : 2 * n + 1] = [f"new{n}"]
        for at in rng.choice(300, 3, replace=False):
            words[at] = f"new{n}-{at}"
        texts.append(" ".join(words))
    docs = list(zip(rng.permutation(150).tolist(), texts, strict=True))
    got = {tuple(r) for r in nearcopies.near_copies(spark.createDataFrame(docs, "doc_id bigint, text string").repartition(4)).collect()}
    assert got == brute_near_copies(docs) and {c for _, c in got} == {0}


def test_the_exact_pass_alone_finds_all(spark, sf, monkeypatch):
    monkeypatch.setattr(nearcopies, "close", lambda similarity: lambda batches: (b.select(["id", "to"]).rename_columns(["u", "v"]).slice(0, 0) for b in batches))
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    assert {tuple(r) for r in nearcopies.near_copies(docs).collect()} == brute_near_copies([tuple(r) for r in docs.collect()])


def test_tables_are_numbered_alike_and_released(spark, sf):
    before = common.tables()
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    one, two = (common.numbered(d, "n").select("n", "doc_id") for d in (docs, docs.repartition(3)))
    assert one.exceptAll(common.numbered(docs, "n").select("n", "doc_id")).count() == 0
    assert all(d.select("n").distinct().count() == docs.count() for d in (one, two))
    assert common.tables() != before
    common.sweep(before)
    assert common.tables() == before


def test_similar_sets_share_a_part_and_others_seldom_do():
    rng = np.random.default_rng(8)
    frequent, sets = np.sort(rng.integers(0, 1 << 63, 300, dtype=np.uint64)), []
    for n in [*range(1, 60), *rng.integers(60, 3000, 240)]:
        h = np.unique(np.concatenate([rng.integers(0, 1 << 63, n, dtype=np.uint64), rng.choice(frequent, rng.choice([0, min(n, 250)]), replace=False)]))
        least = int(np.ceil(0.8 * len(h) - 1e-9))
        swaps = int(rng.integers(0, (len(h) - least) // 2 + 1))  # of each kind: shingles that are others, and that are more or less
        while 0.8 * (len(h) + swaps) > len(h) - swaps + 1e-9:
            swaps -= 1
        sets += [h, np.concatenate([h[swaps:], rng.integers(0, 1 << 63, swaps, dtype=np.uint64)]), h[rng.permutation(len(h))[:least]]]
    owner, key, sparse = nearcopies.part_keys(sets, 0.8, frequent)
    held = [set(key[owner == i].tolist()) for i in range(len(sets))]
    for i in range(0, len(sets), 3):
        for j in (i + 1, i + 2):
            assert held[i] & held[j] or sparse[i] and sparse[j]
    assert sparse.mean() < 0.2
    others = [len(held[i] & held[j]) for i in range(0, len(sets), 3) for j in range(i + 3, len(sets), 3)]
    assert not any(others)


def test_meetings_grow_no_faster_than_texts(spark):
    """Chance meetings of unlike texts with few distinct words: by single shingles of prefixes they grew with the square."""
    rng = np.random.default_rng(9)
    rows = [(i, " ".join(f"w{x}" for x in rng.integers(0, 9, 300))) for i in range(600)]  # 9 ** 5 shingles in all
    texts = spark.createDataFrame(rows, "id bigint, text string").select("text")
    parts = texts.mapInArrow(nearcopies.part_rows(5, 0.8, np.zeros(0, np.uint64), 4), "bucket int, rows binary")
    met = parts.repartition(4, "bucket").mapInArrow(nearcopies.part_meetings, "key bigint, w0 bigint, size bigint")
    found = [nearcopies.hashes(t.encode(), 5) for _, t in rows]
    first = np.concatenate([nearcopies.prefix(h, 0.8, np.zeros(0, np.uint64), np.zeros(0, np.int64)) for h in found])
    _, sizes = np.unique(first, return_counts=True)
    pairs = sum(r["n"] for r in met.groupBy("key").count().selectExpr("count * (count - 1) div 2 as n").collect())
    assert pairs * 10 < (sizes * (sizes - 1) // 2).sum()
