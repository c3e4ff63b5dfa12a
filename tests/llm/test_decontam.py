"""The suffix automaton against brute force."""

import hashlib
import random
import re

from lakeloom.llm import decontam, queries

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")


def brute(text, items, window=10):
    words = WORD.findall(lower(text))
    hit, found = set(), set()
    for item, t in items:
        w = WORD.findall(lower(t))
        windows = [w[i : i + window] for i in range(len(w) - window + 1)] if len(w) >= window else [w] if w else []
        for x in windows:
            for i in range(len(words) - len(x) + 1):
                if words[i : i + len(x)] == x:
                    hit.update(range(i, i + len(x)))
                    if item is not None:
                        found.add(str(item))
    return len(words), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)


def test_many_copies_of_an_item_cost_one():
    m = decontam.Automaton([(str(k), [b"fox", b"den"]) for k in range(3)] + [("0", [b"fox", b"den"])] * 20_000, 10)
    spans, found = m.search([b"fox", b"den"] * 2000)
    assert len(spans) == 2000 and sorted(m.names[k] for k in found) == ["0", "1", "2"]


def test_random_words_equal_brute_force():
    rng = random.Random(1)
    for _ in range(150):
        alphabet = "abcde"[: rng.randint(2, 5)]
        item = lambda: " ".join(rng.choice(alphabet) for _ in range(rng.randint(0, 14)))
        items = [(k, item()) for k in range(rng.randint(1, 6))]
        text, window = " ".join(rng.choice(alphabet + "z") for _ in range(60)), rng.randint(2, 10)
        m = decontam.Automaton([(str(k), decontam.words(t.encode())) for k, t in items], window)
        spans, found = m.search(decontam.words(text.encode()))
        got = sum(b - a + 1 for a, b in decontam.covered(spans)), len(found)
        assert got == brute(text, items, window)[1:3], (items, text, window)


def test_query_equals_brute_force(spark, small):
    items = [tuple(r) for r in spark.read.parquet(f"{small}/benchmark.parquet").select("item_id", "text").collect()]
    want = {r["doc_id"]: brute(r["text"], items) for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    got = {r[0]: tuple(r[1:]) for r in queries.op6_decontamination(spark, small).collect()}
    assert got == want and any(w[4] for w in want.values())


def test_odd_rows_in_one_block_and_in_many(spark, odd_docs, no_docs, items):
    want = sorted((str(r["doc_id"]), *brute(r["text"] if r["doc_id"] not in (7, 8) else "", [tuple(i) for i in items.collect()])) for r in odd_docs.collect() if r["doc_id"] not in (7, 8))
    for block in (1_000_000, 5):
        got = decontam.report(odd_docs, items, block_words=block).collect()
        assert len(got) == 15
        assert sorted((str(r[0]), *r[1:]) for r in got if r["doc_id"] not in (7, 8)) == want
    assert decontam.report(no_docs, items).count() == 0
    assert {r["contaminated"] for r in decontam.report(odd_docs, items.filter("false")).collect()} == {False}


def test_spans_are_cut_and_clean_texts_stay(spark, items):
    docs = spark.createDataFrame([(1, "Before it, A quiet: PLACE! after that we leave for good"), (2, "a quiet place"), (3, "nothing here\n at all"), (4, None)], "doc_id int, text string")
    for block in (1_000_000, 5):
        got = {r["doc_id"]: r["text"] for r in decontam.decontaminate(docs, items, block_words=block).collect()}
        assert got == {1: "Before it, ! after that we leave for good", 3: "nothing here\n at all", 4: None}
