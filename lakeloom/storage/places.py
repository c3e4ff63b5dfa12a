"""Places of rows in an order, for keys that have more rows than one task should sort."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .table import SORT_ROWS


def sorted_files(df: DataFrame, by: Sequence[str], folder: str, rows: int = SORT_ROWS) -> DataFrame:
    """df written in ranges of about so many rows, sorted inside: with __part, the number of a row's range, and __at, its place there from 0 on."""
    parts = max(1, -(-df.count() // rows))
    df.repartitionByRange(parts, *by).sortWithinPartitions(*by).write.parquet(folder)
    part = F.regexp_extract(F.col("_metadata.file_name"), r"^part-(\d+)", 1).cast("bigint")
    return df.sparkSession.read.schema(df.schema).parquet(folder).select("*", part.alias("__part"), F.col("_metadata.row_index").alias("__at"))


def numbered(df: DataFrame, keys: Sequence[str], order: Sequence[str], folder: str, column: str, rows: int = SORT_ROWS) -> DataFrame:
    """row_number() of each key's rows, where keys are few and have very many rows each.

    The rows are dealt in ranges of key and order and written sorted, so no task gets all rows of a key. A place follows from
    the place in the file and the rows that the key has in files before; these counts, one for a key and file, come to the driver.
    """
    stored = sorted_files(df, [*keys, *order], folder, rows)
    counts = stored.groupBy(*keys, "__part").agg(F.count(F.lit(1)).alias("__n"), F.min("__at").alias("__from"))
    before = F.sum("__n").over(Window.partitionBy(*keys).orderBy("__part")) - F.col("__n")  # one row a key and file
    starts = counts.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], F.col("__part").alias("__of"), (before - F.col("__from") + 1).alias("__start"))
    schema = StructType([*starts.schema.fields[: len(keys)], StructField("__of", LongType()), StructField("__start", LongType())])
    same = F.col("__part") == F.col("__of")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"__k{i}"))
    placed = stored.join(F.broadcast(df.sparkSession.createDataFrame(starts.collect(), schema)), same)
    return placed.select(*df.columns, (F.col("__start") + F.col("__at")).alias(column))
