"""Versioned prompt templates, and records of what models were asked and said."""

from __future__ import annotations

import os
import string
import tomllib
from dataclasses import dataclass, field
from pathlib import Path
from typing import Any, Literal

from pydantic import BaseModel, ConfigDict

from .inference import CachedClient, Client
from .titles import cost_usd


@dataclass(frozen=True)
class Prompt:
    """A template with its name and version; fields are written as $name."""

    name: str
    version: str
    system: str
    template: str

    def fill(self, **values: Any) -> str:
        """The text for some values; a field without a value is an error."""
        return string.Template(self.template).substitute({k: str(v) for k, v in values.items()})


def load_prompt(folder: str | Path, name: str) -> Prompt:
    data = tomllib.loads((Path(folder) / f"{name}.toml").read_text(encoding="utf-8"))
    return Prompt(name, str(data["version"]), data.get("system", ""), data["template"])


def list_prompts(folder: str | Path) -> list[Prompt]:
    """All prompts of a folder, by name."""
    return [load_prompt(folder, p.stem) for p in sorted(Path(folder).glob("*.toml"))]


@dataclass(frozen=True)
class Price:
    """US dollars for a million tokens in and out."""

    tokens_in: float
    tokens_out: float


@dataclass(frozen=True)
class Usage:
    tokens_in: int = 0
    tokens_out: int = 0

    def __add__(self, other: Usage) -> Usage:
        return Usage(self.tokens_in + other.tokens_in, self.tokens_out + other.tokens_out)

    def cost(self, price: Price, batch_discount: float = 0.0) -> float:
        return cost_usd(self.tokens_in, self.tokens_out, price.tokens_in, price.tokens_out, batch_discount)


@dataclass(frozen=True)
class Response:
    """A model's answer: parsed content, the model, what it took, and whether it came from the cache."""

    content: dict[str, Any]
    model: str
    usage: Usage = Usage()
    cached: bool = False


def cached_client(path: str | Path, providers: dict[str, type[Client]] | None = None, variable: str = "LAKELOOM_MODEL_PROVIDER") -> CachedClient:
    """The provider that the environment names, behind a cache; without one, replay alone."""
    name = os.environ.get(variable, "")
    if name and name not in (providers or {}):
        raise ValueError(f"no provider {name}")
    return CachedClient(path, (providers or {})[name]() if name else None)


@dataclass
class Predictions:
    """Labels aligned with their inputs (None: no valid answer) and what they took."""

    labels: list[str | None] = field(default_factory=list)
    usage: Usage = Usage()

    @property
    def missing(self) -> int:
        return sum(x is None for x in self.labels)


class TableDoc(BaseModel):
    """A table's documentation as a model proposes it and a person reviews it."""

    model_config = ConfigDict(extra="forbid")
    about: str
    columns: dict[str, str]


class ColumnVerdict(BaseModel):
    """Whether a column is personal, and why."""

    model_config = ConfigDict(extra="forbid")
    column: str
    personal: bool
    kind: str = "none"
    reason: str = ""


class Triage(BaseModel):
    """What a failed job needs, by an error's normal form."""

    model_config = ConfigDict(extra="forbid")
    cause: str
    category: Literal["data", "code", "resources", "access", "other"]
    retry: bool
    next_step: str
