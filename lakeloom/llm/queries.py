"""The ten operators with production parameters over their whole tables, as registered in __spark_entry__."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, decontam, langid, lm, media, mixing, pii, simhash, tokens, toxicity, urlfilter

TOKENIZER = "word_bpe_49k.json"


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The predicted language of every document; see langid.identify for nulls, empty texts and ties."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held = common.crc_mod("doc_id", 5) == 0
    net = langid.train(docs.filter(~held))
    return langid.identify(docs.select("doc_id", held.alias("held_out"), "text"), net).select("doc_id", "held_out", "language.*")


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word-frequency and model scores of every document; see lm.score."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return lm.score(docs, common.crc_mod("doc_id", 7) != 2, tokenizer_path())


def op3_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints within 3 bits of each other, as components; see simhash.near_duplicates."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity scores of every document, empty ones included; see toxicity.train and toxicity.score."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held = common.crc_mod("doc_id", 3) == 1
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), lambda name: common.crc_mod(name, 3) != 1)
    scored = toxicity.score(docs.select("doc_id", held.alias("held_out"), "text"), model)
    return scored.select("doc_id", "held_out", "toxicity.score").withColumn("predicted", (F.col("score") >= toxicity.THRESHOLD).cast("int"))


def op5_pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts with pseudonyms for personal data, and how many values were found and replaced; see pii.pseudonymise."""
    docs = pii.pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text"), found="found")
    return docs.select("doc_id", "text", F.greatest(F.size("found"), F.lit(0)).alias("n_found"), F.coalesce(F.size(F.filter("found", lambda p: p["value"] != p["pseudonym"])), F.lit(0)).alias("n_replaced"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of each document inside benchmark windows, and the items; see decontam.report."""
    return decontam.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of each document; see mixing.mix."""
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op8_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids in files, and what is read back from them; see tokens.export."""
    return tokens.export(table(spark, sf_dir, "documents"), tokenizer_path())


def op9_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts as stored images, and what is read back from them; see media.describe."""
    return media.describe(table(spark, sf_dir, "documents"))


def op10_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tables hold no list of URLs; the canonical forms of the addresses that carry a feed's tracking parameter stand for one."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return urlfilter.judge(pages, pages.filter(F.contains("url", F.lit("utm_source=")))).select("page_id", "host", "path", "rule", "verdict")


QUERIES = {f.__name__: f for f in (op1_language_id, op2_lm_scoring, op3_simhash_near_dedup, op4_toxicity, op5_pii_pseudonyms, op6_decontamination, op7_source_mixing, op8_token_ids, op9_media_columns, op10_url_filters)}

#: SQL for DuckDB where it can express a query. The others are tested against brute force, exact round trips or held-out accuracy.
ORACLE_SQL = {
    "op10_url_filters": r"""
with u as (select page_id, url, case when instr(url, '://') > 0 then substr(url, instr(url, '://') + 3) else '' end as rest from pages),
p as (select page_id, url, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path, regexp_extract(rest, '^[^?#]*\?([^#]*)', 1) as query from u),
c as (select *, regexp_replace(regexp_replace(host, '^www\.', ''), ':(80|443)$', '') || regexp_replace(path, '/+$', '') as base,
    array_to_string(list_sort(list_filter(string_split(query, '&'), lambda x: x <> '' and not starts_with(x, 'utm_'))), '&') as kept from p),
n as (select *, case when kept <> '' then base || '?' || kept else base end as name from c),
listed as (select distinct name from n where contains(url, 'utm_source=') and name <> ''),
r as (select n.*, case
    when (host = 'example.org' or host like '%.example.org') and starts_with(path, '/en/1') then 'example.org/en/1'
    when (host = 'example.org' or host like '%.example.org') and starts_with(path, '/es/') then 'example.org/es/'
    when (host = 'com' or host like '%.com') and starts_with(path, '/fr/') then 'com/fr/'
    when (host = 'com' or host like '%.com') and starts_with(path, '/de/') then 'com/de/'
    when (host = 'org' or host like '%.org') and starts_with(path, '/') then 'org/' end as rule from n)
select page_id, host, path, rule, case when rule in ('org/', 'com/fr/') then 'allow' when rule is not null then 'block'
    when name in (select name from listed) then 'block' else 'allow' end as verdict from r""",
}
