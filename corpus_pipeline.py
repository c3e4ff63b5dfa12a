"""A training corpus in five stages: language ID, near-dedup, decontamination, mixing, token ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes it as Parquet and reads it again as the
next one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeloom.llm import common, decontam, langid, mixing, nearcopies, queries, tokens


#: The least mean probability of a document's language; see the README for what it rejects.
LEAST_SCORE = 0.4


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is determined: a text that is null or without a letter goes, and one whose best language has a mean probability under LEAST_SCORE. Where no row has a language to learn from, all documents stay."""
    net = langid.train(docs.filter(common.crc_mod("doc_id", 5) != 0))
    if net is None:
        return docs
    found = common.fresh("language_found", docs)
    known = (F.col(found)["lang_pred"] != langid.UNDETERMINED) & (F.col(found)["score"] >= LEAST_SCORE)
    return langid.identify(docs, net, out=found).filter(known).drop(found)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, similarity 0.8 or more), that with the least id; one without an id only where none has an id. Different texts with one id all stay; texts without words are one group."""
    row = common.fresh("row_number", docs)
    rows = common.numbered(docs, row)
    groups = nearcopies.row_components(rows.select(F.col(row).alias("id"), "text")).withColumnRenamed("id", row)
    members = common.stored(rows.select(row, F.col("doc_id").alias("doc")).join(groups, row), "groups")
    least = F.min(F.struct(F.col("doc").isNull().alias("none"), "doc", row))[row]
    kept = members.groupBy("component").agg(least.alias(row))
    dropped = members.select(row).join(kept, row, "left_anti")
    return rows.join(common.stored(dropped, "dropped"), row, "left_anti").select(docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Test passages are cut out; documents of which more than half is a test item go."""
    clean = decontam.decontaminate(docs, queries.table(spark, sf_dir, "benchmark"))
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(docs.columns)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, from none to three times; rows with equal id and text count alike. A null text is never taken."""
    mine, theirs, times, each = (common.fresh(x, docs) for x in ("hash_here", "id_there", "times", "each"))
    copies = mixing.mix(docs).filter("copies > 0").groupBy(F.col("doc_id").alias(theirs), F.col("row_hash").alias("hash_there")).agg(F.max("copies").alias(times))
    rows = docs.withColumn(mine, F.xxhash64(F.lit(23), "doc_id", "text"))
    taken = rows.join(copies, (rows[mine] == copies["hash_there"]) & rows["doc_id"].eqNullSafe(copies[theirs]))
    return taken.withColumn(each, F.explode(F.sequence(F.lit(1), times))).select(*(rows[c] for c in docs.columns))


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix as token ids in files; doc_id, start, n_tokens and ids_crc32 of each of its documents, from the files."""
    return tokens.export(docs, queries.tokenizer_path())


STAGES = [("language_id", language_id), ("near_dedup", near_dedup), ("decontamination", decontamination), ("source_mixing", source_mixing), ("token_output", token_output)]

#: SQL can't express a trained network or Golay decoding; tests hold the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another; what a stage stored for itself is deleted once its result is written, and so is its input."""
    docs, others = queries.table(spark, sf_dir, "documents"), common.tables()
    for name, stage in STAGES:
        docs = common.stored(stage(spark, docs, sf_dir), f"stage-{name}")
        common.sweep({*others, docs._stored_at})
    return docs
