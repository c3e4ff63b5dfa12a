"""Small files on the driver: atomic writes, JSON lines, watermarks."""

from __future__ import annotations

import contextlib
import gzip
import json
import os
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from pathlib import Path
from typing import IO, Any, Literal


class BadLine(ValueError):
    def __init__(self, path: str | Path, number: int, reason: str):
        super().__init__(f"{path}:{number}: {reason}")
        self.path, self.number = str(path), number


@contextlib.contextmanager
def atomic_write(path: str | Path, mode: Literal["w", "wb"] = "w") -> Iterator[IO[Any]]:
    """A file that appears whole or not at all."""
    path = Path(path)
    path.parent.mkdir(parents=True, exist_ok=True)
    part = path.with_name(f"{path.name}.tmp")
    try:
        with open(part, mode, encoding=None if "b" in mode else "utf-8") as f:
            yield f
            f.flush()
            os.fsync(f.fileno())
        os.replace(part, path)
    except BaseException:
        part.unlink(missing_ok=True)
        raise


def _open(path: str | Path) -> IO[str]:
    return gzip.open(path, "rt", encoding="utf-8") if str(path).endswith(".gz") else open(path, encoding="utf-8")


def json_lines(path: str | Path, on_error: Literal["raise", "skip"] = "raise", bad: list[int] | None = None) -> Iterator[dict[str, Any]]:
    """Objects of a JSON-lines file, one at a time; a line that can't be read raises, or is skipped and its number noted."""
    with _open(path) as f:
        for number, line in enumerate(f, 1):
            if not line.strip():
                continue
            try:
                yield json.loads(line)
            except json.JSONDecodeError as e:
                if on_error == "raise":
                    raise BadLine(path, number, e.msg) from e
                if bad is not None:
                    bad.append(number)


def json_lines_many(paths: Iterable[str | Path], on_error: Literal["raise", "skip"] = "raise") -> Iterator[dict[str, Any]]:
    for p in paths:
        yield from json_lines(p, on_error)


def count_field(path: str | Path, field: str = "type") -> dict[str, int]:
    return dict(Counter(r.get(field) for r in json_lines(path)))


def count_lines(path: str | Path) -> int:
    with _open(path) as f:
        return sum(1 for _ in f)


class WatermarkStore:
    """A value for each key in one JSON file, replaced as a whole."""

    def __init__(self, path: str | Path):
        self.path = Path(path)

    def all(self) -> dict[str, str]:
        return json.loads(self.path.read_text(encoding="utf-8")) if self.path.exists() else {}

    def get(self, key: str) -> str | None:
        return self.all().get(key)

    def set(self, key: str, value: str) -> None:
        with atomic_write(self.path) as f:
            json.dump({**self.all(), key: value}, f, indent=1, sort_keys=True)


def commit_level(message: str) -> str | None:
    """major, minor or patch by a conventional commit message; None for one that releases nothing."""
    head = re.match(r"(\w+)(\([^)]*\))?(!)?:", message)
    if "BREAKING CHANGE" in message or head and head[3]:
        return "major"
    return {"feat": "minor", "fix": "patch", "perf": "patch"}.get(head[1]) if head else None


def next_version(current: str, messages: Iterable[str]) -> str:
    levels = {commit_level(m) for m in messages}
    major, minor, patch = map(int, current.split("."))
    if "major" in levels:
        return f"{major + 1}.0.0"
    if "minor" in levels:
        return f"{major}.{minor + 1}.0"
    return f"{major}.{minor}.{patch + 1}" if "patch" in levels else current
