"""Batched calls of an external model: bounded concurrency, a rate limit, a replay cache and aligned results."""

from __future__ import annotations

import json
import threading
import time
from collections import deque
from collections.abc import Callable, Iterable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from itertools import groupby, islice
from pathlib import Path
from typing import Any, Protocol

import pandas as pd
from pyspark.sql import DataFrame

from .titles import request_key


class Client(Protocol):
    def complete(self, request: dict[str, Any]) -> dict[str, Any]: ...


class ModelError(Exception):
    """A call that won't succeed."""


class TransientModelError(ModelError):
    """A call that may succeed later."""


class InvalidOutput(ModelError):
    """An answer that doesn't have the form asked for."""


class CacheMiss(ModelError):
    """A request that isn't recorded, in replay mode."""


class TokenBucket:
    """Lets ``rate`` calls a second through, with bursts of at most ``burst``."""

    def __init__(self, rate: float, burst: float = 1.0, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep):
        self.rate, self.burst, self.clock, self.sleep = rate, burst, clock, sleep
        self.level, self.at, self.lock = burst, clock(), threading.Lock()

    def take(self) -> float:
        """Waits until a call may go; the time waited."""
        with self.lock:
            now = self.clock()
            self.level = min(self.burst, self.level + (now - self.at) * self.rate) - 1
            self.at = now
            wait = max(0.0, -self.level / self.rate)
        if wait:
            self.sleep(wait)
        return wait


class CachedClient:
    """Answers from a JSON-lines file; asks ``inner`` for others and records them, or raises CacheMiss without one."""

    def __init__(self, path: str | Path, inner: Client | None = None):
        self.path, self.inner, self.lock = Path(path), inner, threading.Lock()
        lines = self.path.read_text(encoding="utf-8").splitlines() if self.path.exists() else []
        self.known: dict[str, dict[str, Any]] = {r["key"]: r["response"] for r in map(json.loads, lines)}

    def complete(self, request: dict[str, Any]) -> dict[str, Any]:
        key = request_key(request)
        if key in self.known:
            return self.known[key]
        if self.inner is None:
            raise CacheMiss(key)
        response = self.inner.complete(request)
        with self.lock:
            self.known[key] = response
            with self.path.open("a", encoding="utf-8") as f:
                f.write(json.dumps({"key": key, "response": response}, ensure_ascii=False) + "\n")
        return response


def complete_as(client: Client, request: dict[str, Any], check: Callable[[dict[str, Any]], Any]) -> Any:
    """An answer that passes a check (a pydantic model's validator, say)."""
    response = client.complete(request)
    try:
        return check(response)
    except (ValueError, TypeError, KeyError) as e:
        raise InvalidOutput(str(e)) from e


Ask = Callable[[list[dict[str, Any]]], dict[str, Any]]
Answer = Callable[[dict[str, Any], list[dict[str, Any]]], Iterable[dict[str, Any]]]


def run_sorted(rows: Iterable[dict[str, Any]], batch: str, ask: Ask, answer: Answer, client: Client, concurrency: int = 4, limiter: TokenBucket | None = None) -> Iterator[dict[str, Any]]:
    """Answers for rows that are sorted by batch, in their order. At most 2 x concurrency batches are held."""

    def call(group: list[dict[str, Any]]) -> list[dict[str, Any]]:
        if limiter:
            limiter.take()
        return list(answer(client.complete(ask(group)), group))

    with ThreadPoolExecutor(concurrency) as pool:
        due: deque = deque()
        for _, group in groupby(rows, key=lambda r: r[batch]):
            due.append(pool.submit(call, list(group)))
            if len(due) == 2 * concurrency:
                yield from due.popleft().result()
        while due:
            yield from due.popleft().result()


def run_batches(rows: Iterable[dict[str, Any]], batch: str, order: str, ask: Ask, answer: Answer, client: Client, concurrency: int = 4, limiter: TokenBucket | None = None) -> Iterator[dict[str, Any]]:
    """The same for rows in any order, which are sorted first."""
    return run_sorted(sorted(rows, key=lambda r: (r[batch], r[order])), batch, ask, answer, client, concurrency, limiter)


def infer(df: DataFrame, batch: str, order: str, ask: Ask, answer: Answer, client_factory: Callable[[], Client], schema: str, partitions: int | None = None, concurrency: int = 2, per_second: float = 0.0) -> DataFrame:
    """run_sorted in each partition; a batch is never split, and a task holds a few batches only.

    Rows go to the session's number of partitions, or to a given one. A rate is shared out between them.
    """
    spread = int(partitions or df.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        limiter = TokenBucket(per_second / spread) if per_second else None
        rows = (r for f in frames for r in f.to_dict("records"))
        out = run_sorted(rows, batch, ask, answer, client_factory(), concurrency, limiter)
        while some := list(islice(out, 1000)):
            yield pd.DataFrame(some)

    return df.repartition(spread, batch).sortWithinPartitions(batch, order).mapInPandas(run, schema)


def aligned(n: int, answers: Iterable[dict[str, Any]], labels: Sequence[str], index: str = "i", label: str = "label") -> list[str | None]:
    """One answer for each of n inputs: missing, repeated out of range or invented ones are None."""
    out: list[str | None] = [None] * n
    for a in answers:
        if 0 <= a.get(index, -1) < n and a.get(label) in labels:
            out[a[index]] = a[label]
    return out
