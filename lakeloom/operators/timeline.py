"""Sessions, streaks, intervals and moving statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def sessionize(df: DataFrame, user: str, ts: str, gap_seconds: int = 1800, tie: Sequence[str] = (), split_seconds: int | None = None) -> DataFrame:
    """Adds session_number and session_id (user#number). A gap of exactly gap_seconds stays in the session.

    split_seconds: a user's rows are sorted in stretches of this length and the numbers carried from one to the next, so that
    no task gets all rows of a user who has very many. It costs two aggregations and a join.
    """
    if split_seconds:
        return _sessionize_split(df, user, ts, gap_seconds, tie, split_seconds)
    w = Window.partitionBy(user).orderBy(ts, *tie)
    apart = F.unix_timestamp(ts) - F.unix_timestamp(F.lag(ts).over(w))
    starts = df.withColumn("__start", F.when(apart.isNull() | (apart > gap_seconds), 1).otherwise(0))
    numbered = starts.withColumn("session_number", F.sum("__start").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return numbered.withColumn("session_id", F.concat_ws("#", F.col(user).cast("string"), F.col("session_number").cast("string"))).drop("__start")


def _sessionize_split(df: DataFrame, user: str, ts: str, gap_seconds: int, tie: Sequence[str], split_seconds: int) -> DataFrame:
    rows = df.withColumn("__part", F.floor(F.unix_timestamp(ts) / split_seconds))
    last = rows.groupBy(F.col(user).alias("__user"), F.col("__part").alias("__of")).agg(F.max(ts).alias("__last"))
    over = Window.partitionBy("__user").orderBy("__of")  # one row a stretch
    last = last.withColumn("__last", F.lag("__last").over(over))
    here = lambda other: F.col(user).eqNullSafe(F.col("__user")) & F.col("__part").eqNullSafe(F.col("__of"))
    w = Window.partitionBy(user, "__part").orderBy(ts, *tie)
    known = rows.join(last, here(last)).drop("__user", "__of")
    apart = F.unix_timestamp(ts) - F.unix_timestamp(F.coalesce(F.lag(ts).over(w), "__last"))
    starts = known.withColumn("__start", F.when(apart.isNull() | (apart > gap_seconds), 1).otherwise(0)).drop("__last")
    before = starts.groupBy(F.col(user).alias("__user"), F.col("__part").alias("__of")).agg(F.sum("__start").alias("__in"))
    before = before.withColumn("__before", F.sum("__in").over(over) - F.col("__in")).drop("__in")
    numbered = starts.withColumn("__inside", F.sum("__start").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    numbered = numbered.join(before, here(before)).withColumn("session_number", F.col("__before") + F.col("__inside"))
    return numbered.withColumn("session_id", F.concat_ws("#", F.col(user).cast("string"), F.col("session_number").cast("string"))).select(*df.columns, "session_number", "session_id")


def streaks(df: DataFrame, user: str, day: str) -> DataFrame:
    """Runs of consecutive days of each user: start, end, days. Repeated days count once."""
    days = df.select(user, F.to_date(day).alias("d")).distinct()
    island = F.date_sub("d", F.row_number().over(Window.partitionBy(user).orderBy("d")))
    return days.withColumn("island", island).groupBy(user, "island").agg(F.min("d").alias("start"), F.max("d").alias("end"), F.count(F.lit(1)).alias("days")).drop("island")


def merge_intervals(df: DataFrame, keys: Sequence[str], start: str, end: str) -> DataFrame:
    """The union of closed intervals of each key; those that overlap or touch become one."""
    w = Window.partitionBy(*keys).orderBy(start, end)
    reach = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = df.withColumn("__new", F.when(F.col(start) <= reach, 0).otherwise(1))
    island = marked.withColumn("__island", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return island.groupBy(*keys, "__island").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("__island")


def rolling_z(df: DataFrame, keys: Sequence[str], order: str, value: str, rows: int = 30) -> DataFrame:
    """Adds z: the distance from the mean of the rows before in their standard deviations; null without spread."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(-rows, -1)
    spread = F.stddev_samp(value).over(w)
    return df.withColumn("z", F.when(spread > 0, (F.col(value) - F.avg(value).over(w)) / spread))


def share(value: Column, *keys: str) -> Column:
    """A value as a percentage of its group's total."""
    return 100 * value / F.sum(value).over(Window.partitionBy(*keys))


def cohorts(df: DataFrame, user: str, day: str) -> DataFrame:
    """Weekly retention: cohort, week, users, size of the cohort and percentage."""
    weeks = df.select(user, F.to_date(F.date_trunc("week", day)).alias("active")).distinct()
    first = weeks.withColumn("cohort", F.min("active").over(Window.partitionBy(user)))
    counts = first.withColumn("week", (F.datediff("active", "cohort") / 7).cast("int")).groupBy("cohort", "week").agg(F.countDistinct(user).alias("users"))
    size = F.first("users").over(Window.partitionBy("cohort").orderBy("week"))
    return counts.withColumn("size", size).withColumn("pct", F.round(100 * F.col("users") / F.col("size"), 2))
