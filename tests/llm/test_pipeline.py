"""The pipeline against brute force, stage by stage, and without the subpackage."""

import re
import shutil
import subprocess
import sys
from pathlib import Path

import corpus_pipeline
from pyspark.sql import functions as F

from lakeloom.llm import common

ROOT = Path(__file__).resolve().parents[2]


def test_stages_on_the_smallest_tables(spark, small):
    from test_decontam import brute
    from test_duplicates import brute_near_copies

    docs = spark.read.parquet(f"{small}/documents.parquet")
    columns = docs.columns
    before = docs.collect()
    items = [tuple(r) for r in spark.read.parquet(f"{small}/benchmark.parquet").select("item_id", "text").collect()]
    for name, stage in corpus_pipeline.STAGES:
        docs = common.stored(stage(spark, docs, small), "test")
        after = docs.collect()
        if name != "token_output":
            assert docs.columns == columns
        ids = [r["doc_id"] for r in after]
        if name == "language_id":
            assert sorted(ids) == sorted(r["doc_id"] for r in before if r["text"] and re.search(r"[^\W\d_]", r["text"]))
        elif name == "near_dedup":
            assert sorted(ids) == sorted({c for _, c in brute_near_copies([(r["doc_id"], r["text"]) for r in before])})
        elif name == "decontamination":
            share = {r["doc_id"]: brute(r["text"], items) for r in before}
            assert sorted(ids) == sorted(d for d, w in share.items() if w[1] <= 0.5 * w[0])
            texts = {r["doc_id"]: r["text"] for r in before}
            assert all((r["text"] == texts[r["doc_id"]]) == (not share[r["doc_id"]][4]) and r["n_chars"] == len(r["text"]) or not share[r["doc_id"]][4] for r in after)
        elif name == "source_mixing":
            assert set(ids) <= {r["doc_id"] for r in before} and max(ids.count(i) for i in set(ids)) <= 3
        else:
            assert sorted(ids) == sorted(r["doc_id"] for r in before) and sorted(r["start"] for r in after)[0] == 0
        before = after


def test_odd_rows_pass_all_stages(spark, odd_docs, small):
    clash = ("copies", "times", "each", "row_number", "path", "id", "component", "clean", "hash_here", "language_found", "row_hash", "taken", "key")
    docs = odd_docs.withColumns({c: F.lit(f"mine {c}") for c in clash})
    columns, before = docs.columns, common.tables()
    for name, stage in corpus_pipeline.STAGES:
        docs = common.stored(stage(spark, docs, small), "test")
        if name != "token_output":
            assert docs.columns == columns and docs.filter(" or ".join(f"{c} <> 'mine {c}'" for c in clash)).count() == 0
    assert docs.count() > 0
    common.sweep(before)
    docs = odd_docs.select("doc_id", "text", "lang", "source", "n_chars").filter("false")
    for _, stage in corpus_pipeline.STAGES:
        docs = common.stored(stage(spark, docs, small), "test")
    assert docs.count() == 0


def test_rows_without_an_id_or_with_one_id_stay(spark):
    texts = [(None, "alpha beta gamma delta epsilon zeta"), (None, "one two three four five six seven"), (5, "red green blue white black grey"), (5, "north south east west up down"), (6, "RED green blue white black grey")]
    docs = spark.createDataFrame([(d, t, "en", "a", len(t)) for d, t in texts], "doc_id bigint, text string, lang string, source string, n_chars bigint").repartition(2)
    got = corpus_pipeline.near_dedup(spark, docs, None)
    assert sorted((r["text"] for r in got.collect())) == sorted(t for _, t in texts[:4])
    of_row = lambda df: sorted(tuple(r) for r in df.groupBy(F.xxhash64(F.lit(23), "doc_id", "text").alias("h")).count().collect())
    copies = corpus_pipeline.mixing.mix(docs).filter("copies > 0").select("row_hash", "copies").collect()
    assert of_row(corpus_pipeline.source_mixing(spark, docs, None)) == sorted(tuple(r) for r in copies)


def test_the_rest_imports_without_the_subpackage(tmp_path):
    shutil.copytree(ROOT, tmp_path / "r", ignore=shutil.ignore_patterns(".git", "__pycache__", "llm", "corpus_pipeline.py"))
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; assert not any(k.startswith('op') for k in e.queries()); print('fine')"], cwd=tmp_path / "r", env={"PATH": "/usr/bin"}, capture_output=True, text=True)
    assert said.stdout.strip() == "fine", said.stderr


def test_language_scores_decide_and_nothing_learned_keeps_all(spark, small, monkeypatch):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    found = corpus_pipeline.langid.identify(docs, corpus_pipeline.langid.train(docs.filter(common.crc_mod("doc_id", 5) != 0)), out="f").select("doc_id", "f.*").collect()
    middle = sorted(r["score"] for r in found)[len(found) // 2]
    monkeypatch.setattr(corpus_pipeline, "LEAST_SCORE", middle)
    kept = {r["doc_id"] for r in corpus_pipeline.language_id(spark, docs, small).collect()}
    assert kept == {r["doc_id"] for r in found if r["score"] >= middle and r["lang_pred"] != "und"} and 0 < len(kept) < len(found)
    assert corpus_pipeline.language_id(spark, docs.withColumn("lang", F.lit(None).cast("string")), small).count() == docs.count()
