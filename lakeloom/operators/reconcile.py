"""Comparing two tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def checksums(df: DataFrame, partition: str, columns: Sequence[str]) -> DataFrame:
    """Rows and a sum of row hashes for each partition; the sum is a decimal, so it can't overflow."""
    return df.groupBy(partition).agg(F.count(F.lit(1)).alias("rows"), F.sum(F.xxhash64(*columns).cast("decimal(38,0)")).alias("checksum"))


def divergent(a: DataFrame, b: DataFrame, partition: str, columns: Sequence[str]) -> DataFrame:
    """Partitions whose rows or checksums differ, null-safe: the first level of a reconciliation."""
    left, right = (checksums(x, partition, columns).select(F.col(partition).alias(f"p{n}"), F.col("rows").alias(f"rows_{n}"), F.col("checksum").alias(f"sum_{n}")) for n, x in (("a", a), ("b", b)))
    both = left.join(right, F.col("pa").eqNullSafe(F.col("pb")), "full")
    differs = ~(F.col("rows_a").eqNullSafe(F.col("rows_b")) & F.col("sum_a").eqNullSafe(F.col("sum_b")))
    return both.filter(differs).select(F.coalesce("pa", "pb").alias(partition), "rows_a", "rows_b")


def compare_keys(a: DataFrame, b: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """(key, status) of keys that are missing in b, extra in b, duplicated or changed: the second level, for divergent partitions."""

    def side(df: DataFrame, n: str) -> DataFrame:
        return df.groupBy(F.col(key).alias(f"k{n}")).agg(F.count(F.lit(1)).alias(f"n{n}"), F.sum(F.xxhash64(*columns).cast("decimal(38,0)")).alias(f"h{n}"))

    both = side(a, "a").join(side(b, "b"), F.col("ka").eqNullSafe(F.col("kb")), "full")
    status = F.when(F.col("nb").isNull(), "missing").when(F.col("na").isNull(), "extra").when(F.col("na") != F.col("nb"), "duplicated").when(F.col("ha") != F.col("hb"), "changed")
    return both.select(F.coalesce("ka", "kb").alias(key), status.alias("status")).filter("status is not null")


def same_rows(a: DataFrame, b: DataFrame) -> bool:
    """Equal bags of rows, in any order; nulls equal nulls."""
    return a.columns == b.columns and a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()
