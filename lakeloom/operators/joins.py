"""Joins that Spark doesn't plan on its own."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def salted_join(big: DataFrame, small: DataFrame, key: str, hot: Sequence[Any], buckets: int, how: str = "inner", seed: int = 7) -> DataFrame:
    """A join of which the hot keys are dealt over buckets: a salt on the big side, copies on the small one.

    The salt is a hash of the row, so a task that runs again deals alike. Only inner, left, left_semi and left_anti joins keep their
    meaning; others are rejected, as copies without a partner would be returned once for each bucket.
    """
    if buckets < 2:
        raise ValueError("salting needs two buckets at least")
    if how not in ("inner", "left", "left_outer", "left_semi", "left_anti"):
        raise ValueError(f"a {how} join can't be salted")
    heated = F.col(key).isin(list(hot)) if hot else F.lit(False)
    salt = F.when(heated, F.pmod(F.xxhash64(F.lit(seed), *big.columns), F.lit(buckets)).cast("int")).otherwise(0)
    copies = F.when(heated, F.sequence(F.lit(0), F.lit(buckets - 1))).otherwise(F.array(F.lit(0)))
    left, right = big.withColumn("__salt", salt), small.withColumn("__salt", F.explode(copies))
    return left.join(right, [key, "__salt"], how).drop("__salt")


def hot_keys(df: DataFrame, key: str, share: float = 0.05, most: int = 100) -> list[Any]:
    """Keys that hold at least a share of all rows; no more than ``most`` are returned."""
    counts = df.filter(F.col(key).isNotNull()).groupBy(key).count()
    total = counts.agg(F.sum("count")).first()[0] or 0
    return [r[0] for r in counts.filter(F.col("count") >= share * total).orderBy(F.desc("count"), key).limit(most).collect()]


def dictionary_attack(hashes: DataFrame, hashed: str, candidates: DataFrame, candidate: str) -> DataFrame:
    """(hash, value) of the hashes that are the plain sha256 of a candidate."""
    book = candidates.select(F.col(candidate).alias("value")).filter("value is not null").distinct().withColumn(hashed, F.sha2("value", 256))
    return hashes.select(hashed).distinct().join(book, hashed)


def interval_join(left: DataFrame, right: DataFrame, keys: Sequence[str], left_ts: str, right_ts: str, seconds: int) -> DataFrame:
    """Pairs of equal keys whose right time follows the left one by at most seconds; the times are cut into bins of that length, which makes it an equi-join."""
    bin_of = lambda c: F.floor(F.unix_timestamp(c) / seconds)
    a = left.withColumn("__bin", F.explode(F.array(bin_of(left_ts), bin_of(left_ts) + 1)))
    b = right.withColumn("__bin", bin_of(right_ts))
    apart = F.unix_timestamp(right_ts) - F.unix_timestamp(left_ts)
    return a.join(b, [*keys, "__bin"]).filter((F.col(right_ts) >= F.col(left_ts)) & (apart <= seconds)).drop("__bin")
