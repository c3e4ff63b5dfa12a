"""A consumer of a table's change feed, and typed appends."""

from __future__ import annotations

import json
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import SparkSession

from ..functions.files import atomic_write
from ..operators.history import last_change_per_key
from .table import Table


@dataclass(frozen=True)
class FeedRun:
    start: int
    end: int
    changes: int
    metrics: dict[str, int]

    @property
    def skipped(self) -> bool:
        return self.end < self.start


def read_watermark(state: Path) -> int | None:
    return json.loads(state.read_text(encoding="utf-8"))["version"] if state.exists() else None


def write_watermark(state: Path, version: int) -> None:
    with atomic_write(state) as f:
        json.dump({"version": version}, f)


def apply_changes(spark: SparkSession, source: str, target: str, key: str, state: str | Path | None = None, first_version: int = 0) -> FeedRun:
    """Bring a replica up to date. How far it is stands in the replica's own commits, or in a file ``state``.

    A file is written after the merge, which does no harm when it runs again.
    """
    src, out = Table(spark, source), Table(spark, target)
    feed, state = f"changes of {source}", Path(state) if state else None
    done = read_watermark(state) if state else out.state()["txn"].get(feed) if out.exists() else None
    start, end = first_version if done is None else done + 1, src.version()
    if end < start:
        return FeedRun(start, end, 0, {})
    last = last_change_per_key(src.read_changes(start, end), key).persist()
    try:
        n = last.count()
        out.create(src.schema())
        names = src.schema().names
        gone = last.filter("_change_type = 'delete'").select(names)
        kept = last.filter("_change_type != 'delete'").select(names)
        removed = out.merge(gone, [key], update_if=None, delete_if="true", insert_if=None)
        merged = out.merge(kept, [key], txn=None if state else (feed, end))
        metrics = {k: removed[k] + merged[k] for k in merged}
    finally:
        last.unpersist()
    if state:
        write_watermark(state, end)
    return FeedRun(start, end, n, metrics)
