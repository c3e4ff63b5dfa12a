"""URL filtering: host and path rules, then a list of canonical URLs behind a blocked Bloom filter.

The filter has blocks of eight 64-bit words; a URL sets one bit in each word of one block. It is built by a distributed
bitwise-or, is never larger than MAX_BLOCKS, and is broadcast; what it lets pass is joined with the list by the exact
canonical URL, so its false positives cost a join row and no wrong verdict.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

#: 32 MB at most, whatever the list's length; bits a listed URL as long as that suffices.
MAX_BLOCKS, BITS_PER_URL = 1 << 19, 20


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


#: The rules that the production query applies.
RULES = (Rule("allow", "org", "/"), Rule("block", "example.org", "/es/"), Rule("block", "example.org", "/en/1"), Rule("allow", "com", "/fr/"), Rule("block", "com", "/de/"))


def _after(url: Column) -> Column:
    """What follows the first ``://``; empty for null or none."""
    return F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise("")


def host(url: Column) -> Column:
    return F.translate(F.regexp_extract(_after(url), r"^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path(url: Column) -> Column:
    return F.regexp_extract(_after(url), r"^[^/?#]*([^?#]*)", 1)


def canonical(url: Column) -> Column:
    """Host without ``www.`` and default port, path without trailing slashes, query without utm_ parameters in sorted order; no scheme, no fragment."""
    query = F.regexp_extract(_after(url), r"^[^?#]*\?([^#]*)", 1)
    kept = F.array_join(F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.startswith("utm_"))), "&")
    base = F.concat(F.regexp_replace(F.regexp_replace(host(url), r"^www\.", ""), r":(80|443)$", ""), F.regexp_replace(path(url), "/+$", ""))
    return F.when(kept != "", F.concat(base, F.lit("?"), kept)).otherwise(base)


def rule(h: Column, p: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """struct(name, verdict) of the longest rule that fits the host or a parent domain of it and the start of the path; else null.

    Longest by host and path together; of equally long rules the one that is named first.
    """
    out = F.lit(None).cast("struct<name:string,verdict:string>")
    for r in sorted(reversed(rules), key=lambda r: len(r.name)):
        fits = ((h == r.host) | h.endswith("." + r.host)) & p.startswith(r.path)
        out = F.when(fits, F.struct(F.lit(r.name).alias("name"), F.lit(r.verdict).alias("verdict"))).otherwise(out)
    return out


def bloom(listed: DataFrame, url_col: str) -> np.ndarray:
    """Words (block, 8) of the filter of a column of canonical URLs."""
    n = listed.count()
    blocks = int(min(MAX_BLOCKS, max(1, 1 << int(np.ceil(np.log2(max(1, n * BITS_PER_URL / 512)))))))
    bits = [F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), _bit(F.col("b"), j))).alias(f"w{j}") for j in range(8)]
    rows = listed.select(F.pmod(_place(F.col(url_col)), F.lit(blocks)).alias("block"), _bits(F.col(url_col)).alias("b")).groupBy("block").agg(*bits)
    out = np.zeros((blocks, 8), np.int64)
    for r in rows.toLocalIterator():  # at most MAX_BLOCKS rows
        out[r["block"]] = r[1:]
    return out.view(np.uint64)


def _place(url: Column) -> Column:
    return F.xxhash64(url)


def _bits(url: Column) -> Column:
    return F.xxhash64(F.lit(1), url)


def _bit(b: Column, j: int) -> Column:
    """The j-th six bits of a hash."""
    return F.shiftrightunsigned(b, 6 * j).bitwiseAND(F.lit(63).cast("bigint")).cast("int")


def may_have(words: np.ndarray, spark, url: Column) -> Column:
    """True for every URL in the filter and for a small share of the others."""
    shared = spark.sparkContext.broadcast(words)

    def probe(place: pa.Array, bits: pa.Array) -> pa.Array:
        w = shared.value
        p, b = (x.to_numpy(zero_copy_only=False) for x in (place, bits))
        block, b = w[np.mod(p, len(w))], b.view(np.uint64)
        hit = np.ones(len(b), bool)
        for j in range(8):
            hit &= (block[:, j] >> (b >> np.uint64(6 * j) & np.uint64(63)) & np.uint64(1)).astype(bool)
        return pa.array(hit)

    return F.arrow_udf(probe, T.BooleanType()).asNondeterministic()(_place(url), _bits(url))


def judge(pages: DataFrame, listed: DataFrame, id_col: str = "page_id", url_col: str = "url", listed_col: str = "url", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row per row of pages: id, host, path, rule, verdict, listed.

    A rule's verdict wins; else a URL whose canonical form is that of a listed URL is blocked and any other is allowed. A
    null URL, or one without ``://``, has an empty host and path and is on no list. Repeated rows and null ids are kept.
    """
    spark = pages.sparkSession
    common.prepare(spark)
    names = common.stored(listed.select(canonical(F.col(listed_col)).alias("name")).filter(F.col("name").isNotNull() & (F.col("name") != "")).distinct(), "listed")
    words = bloom(names, "name")
    url = F.col("url")
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"))
    rows = rows.select("id", F.coalesce(host(url), F.lit("")).alias("host"), F.coalesce(path(url), F.lit("")).alias("path"), F.coalesce(canonical(url), F.lit("")).alias("name"))
    rows = rows.withColumn("hit", may_have(words, spark, F.col("name")))
    # Only possible hits carry their URL into the join, so a URL that many pages share and the list lacks makes no large group.
    rows = rows.withColumn("possible", F.when(F.col("hit") & (F.col("name") != ""), F.col("name")))
    hits = rows.filter("possible is not null")
    joined = hits.join(names.withColumnRenamed("name", "found"), F.col("possible") == F.col("found"), "left").withColumn("listed", F.col("found").isNotNull()).drop("found")
    both = joined.unionByName(rows.filter("possible is null").withColumn("listed", F.lit(False)))
    both = both.withColumn("r", rule(F.col("host"), F.col("path"), rules))
    return both.select(F.col("id").alias(id_col), "host", "path", F.col("r.name").alias("rule"), F.coalesce("r.verdict", F.when(F.col("listed"), "block").otherwise("allow")).alias("verdict"), "listed")
