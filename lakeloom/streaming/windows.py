"""Event-time windows, bounded deduplication and idempotent sinks."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupStateTimeout
from pyspark.sql.streaming.listener import StreamingQueryListener

from ..operators.history import dedup_latest
from ..storage.table import Table


def counts_per_window(events: DataFrame, ts: str, window: str = "1 minute", slide: str | None = None, watermark: str = "1 minute", by: Sequence[str] = ()) -> DataFrame:
    """window_start, window_end, keys, events: tumbling windows, or sliding ones with slide. ts must be a timestamp with time zone."""
    w = F.window(ts, window, slide) if slide else F.window(ts, window)
    counted = events.withWatermark(ts, watermark).groupBy(w.alias("w"), *by).agg(F.count(F.lit(1)).alias("events"))
    return counted.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *by, "events")


def sessions(events: DataFrame, ts: str, gap: str, by: Sequence[str], watermark: str = "1 minute") -> DataFrame:
    """Session windows; a stream needs at least one key."""
    counted = events.withWatermark(ts, watermark).groupBy(F.session_window(ts, gap).alias("w"), *by).agg(F.count(F.lit(1)).alias("events"))
    return counted.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *by, "events")


def dedup_within(events: DataFrame, key: str, ts: str, watermark: str = "10 minutes") -> DataFrame:
    """One row of each key, with state that the watermark bounds."""
    return events.withWatermark(ts, watermark).dropDuplicatesWithinWatermark([key])


def interval_pairs(left: DataFrame, right: DataFrame, key: str, left_ts: str, right_ts: str, within: str, watermark: str = "10 minutes") -> DataFrame:
    """A stream-stream join: right rows of the same key that follow a left row within an interval."""
    a, b = left.withWatermark(left_ts, watermark), right.withWatermark(right_ts, watermark)
    return a.join(b, (a[key] == b[key]) & (b[right_ts] >= a[left_ts]) & (b[right_ts] <= a[left_ts] + F.expr(f"INTERVAL {within}")))


def merge_sink(path: str, keys: Sequence[str], app: str, insert_only: bool = False, order_by: Sequence[str] = (), on_batch: Callable[[int, dict[str, int]], None] | None = None) -> Callable[[DataFrame, int], None]:
    """A foreachBatch sink that may see a batch twice: its number is part of the commit, and keys are compared with <=>.

    Several rows of a key in a batch: the last by order_by; without an order, the greatest by all columns, so a replay picks the same.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        order = [F.desc(c) for c in (order_by or [c for c, t in batch.dtypes if c not in keys and not t.startswith("map")])] or [F.lit(0)]
        rows = dedup_latest(batch, keys, order).persist()
        try:
            table = Table(spark, path)
            table.create(rows.schema)
            metrics = table.merge(rows, keys, update_if=None if insert_only else "true", null_safe=True, txn=(app, number))
            if on_batch:
                on_batch(number, metrics)
        finally:
            rows.unpersist()

    return write


def append_sink(path: str, app: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch sink that appends each batch exactly once."""
    return lambda batch, number: Table(batch.sparkSession, path).append(batch, txn=(app, number)) and None


@dataclass(frozen=True)
class TableStream:
    """The rows that commits add to a table, for drain(). Only committed files count: nothing is read from writers that lost or died.

    Commits that only rearrange files are passed over. One that changes or deletes rows is refused, or passed over too with
    skip_changes. A transformation is applied to each batch.
    """

    spark: SparkSession
    path: str
    skip_changes: bool = False
    steps: tuple[Callable[[DataFrame], DataFrame], ...] = ()

    def transform(self, step: Callable[[DataFrame], DataFrame]) -> TableStream:
        return replace(self, steps=(*self.steps, step))

    def commits(self) -> DataFrame:
        """The table's log as a stream: one row a commit."""
        log = self.spark.readStream.schema("value string").option("wholetext", True).option("pathGlobFilter", "*.json").text(f"{self.path}/_log")
        return log.select(F.from_json("value", "version bigint, operation string, data_change boolean, remove array<string>, add array<struct<path: string>>").alias("c")).select("c.*")

    def rows(self, commits: DataFrame) -> DataFrame:
        """The rows that a batch of commits added."""
        table, paths = Table(self.spark, self.path), []
        for c in sorted(commits.filter("data_change").collect(), key=lambda c: c["version"]):  # one row a commit
            if c["remove"]:
                if self.skip_changes:
                    continue
                raise ValueError(f"version {c['version']} of {self.path} ({c['operation']}) changed rows; a stream takes appended ones")
            paths += [a["path"] for a in c["add"]]
        df = table.rows_of(paths)
        for step in self.steps:
            df = step(df)
        return df


def table_stream(spark: SparkSession, path: str, skip_changes: bool = False) -> TableStream:
    return TableStream(spark, path, skip_changes)


def drain(df: DataFrame | TableStream, checkpoint: str, sink: Callable[[DataFrame, int], None], mode: str = "append") -> StreamingQuery:
    """Process all that is there, then stop."""
    source, each = (df.commits(), lambda commits, n: sink(df.rows(commits), n)) if isinstance(df, TableStream) else (df, sink)
    q = source.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(each).start()
    q.awaitTermination()
    return q


def running_totals(events: DataFrame, key: str, value: str) -> DataFrame:
    """(key, events, highest) after each batch for the keys that it holds, from state of our own: a count and the greatest value."""
    kind = events.schema[key].dataType.simpleString()

    def update(keys, frames, state):
        count, highest = state.get if state.exists else (0, float("-inf"))
        for frame in frames:
            count, highest = count + len(frame), max(highest, float(frame[value].max()))
        state.update((count, highest))
        yield pd.DataFrame({key: [keys[0]], "events": [count], "highest": [highest]})

    return events.select(key, F.col(value).cast("double").alias(value)).groupBy(key).applyInPandasWithState(update, f"{key} {kind}, events bigint, highest double", "events bigint, highest double", "update", GroupStateTimeout.NoTimeout)


def progress_summary(p: dict[str, Any]) -> dict[str, Any]:
    """The health figures of a progress record; a stream without state has zeros."""
    state = p.get("stateOperators") or []
    total = lambda k: sum(s.get(k, 0) for s in state)
    return {
        "batch": p.get("batchId"), "rows": p.get("numInputRows", 0), "rows_per_s_in": p.get("inputRowsPerSecond", 0.0), "rows_per_s_out": p.get("processedRowsPerSecond", 0.0), "duration_ms": (p.get("durationMs") or {}).get("triggerExecution"),
        "watermark": (p.get("eventTime") or {}).get("watermark"), "state_rows": total("numRowsTotal"), "state_bytes": total("memoryUsedBytes"), "late_rows": total("numRowsDroppedByWatermark"),
    }


class ProgressCollector(StreamingQueryListener):
    """Keeps the progress records and the ends of queries."""

    def __init__(self) -> None:
        self.progress: list[Any] = []
        self.ended: list[tuple[str, str | None]] = []

    def onQueryStarted(self, event) -> None:  # noqa: N802
        pass

    def onQueryProgress(self, event) -> None:  # noqa: N802
        self.progress.append(event.progress)

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        self.ended.append((str(event.id), event.exception))
