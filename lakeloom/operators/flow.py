"""Declared tables: functions that name what they read and what must hold; the order of work follows."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from graphlib import TopologicalSorter

from pyspark.sql import DataFrame, SparkSession

from ..storage.table import Table
from . import quality


@dataclass(frozen=True)
class Declared:
    name: str
    make: Callable[..., DataFrame]
    reads: tuple[str, ...]
    rules: tuple[quality.Expectation, ...]


@dataclass
class Flow:
    """Tables of a pipeline. Each is replaced in one commit; rows that a rule drops are kept in ``<name>_rejected``."""

    spark: SparkSession
    root: str
    declared: dict[str, Declared] = field(default_factory=dict)

    def table(self, reads: Sequence[str] = (), rules: Sequence[quality.Expectation] = ()) -> Callable[[Callable[..., DataFrame]], Callable[..., DataFrame]]:
        """Declare a table by a function of the tables that it reads, in their order."""

        def wrap(make: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
            if make.__name__ in self.declared:
                raise ValueError(f"{make.__name__} is declared twice")
            self.declared[make.__name__] = Declared(make.__name__, make, tuple(reads), tuple(rules))
            return make

        return wrap

    def order(self) -> list[str]:
        """Names, each after what it reads; a cycle or an unknown name is an error."""
        unknown = {r for d in self.declared.values() for r in d.reads} - self.declared.keys()
        if unknown:
            raise ValueError(f"not declared: {', '.join(sorted(unknown))}")
        return list(TopologicalSorter({n: d.reads for n, d in self.declared.items()}).static_order())

    def read(self, name: str) -> DataFrame:
        return Table(self.spark, f"{self.root}/{name}").read()

    def run(self) -> dict[str, int]:
        """Make all tables; rows written, by name."""
        written = {}
        for name in self.order():
            d = self.declared[name]
            rows = d.make(*[self.read(r) for r in d.reads])
            if d.rules:
                rows, rejected = quality.split_rows(rows, d.rules)
                written[f"{name}_rejected"] = Table(self.spark, f"{self.root}/{name}_rejected").overwrite(rejected, schema_too=True)["inserted"]
            written[name] = Table(self.spark, f"{self.root}/{name}").overwrite(rows, schema_too=True)["inserted"]
        return written
