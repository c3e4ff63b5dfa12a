"""Column profiles, anonymity measures and schema comparison."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

from .privacy import mask_format


def profile(df: DataFrame, personal: Sequence[str] = (), max_top: int = 20, approximate: bool = False) -> list[dict[str, Any]]:
    """For each column: rows, nulls, distinct values, least and greatest, lengths of text, and all values if there are at most max_top.

    One pass for the figures and one for all value lists. approximate: sketches instead of one expanded row for each distinct count.
    Values of personal columns are shown as formats only.
    """
    count = F.approx_count_distinct if approximate else F.countDistinct
    flat = [f for f in df.schema if f.dataType.typeName() not in ("array", "map", "struct", "variant")]
    wanted = [F.count(F.lit(1)).alias("rows")]
    for i, f in enumerate(flat):
        c = F.col(f"`{f.name}`")
        shown = mask_format(c) if f.name in personal else c.cast("string")
        wanted += [F.count_if(c.isNull()).alias(f"n{i}"), count(c).alias(f"d{i}"), F.min(shown).alias(f"a{i}") if f.name in personal else F.min(c).cast("string").alias(f"a{i}"), (F.max(shown) if f.name in personal else F.max(c).cast("string")).alias(f"b{i}")]
        if isinstance(f.dataType, StringType):
            wanted += [F.min(F.length(c)).alias(f"s{i}"), F.max(F.length(c)).alias(f"l{i}")]
    row = df.agg(*wanted).first().asDict()
    few = [(i, f) for i, f in enumerate(flat) if 0 < row[f"d{i}"] <= max_top]
    top: dict[int, list[tuple[str | None, int]]] = {}
    if few:
        pairs = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), (mask_format(F.col(f"`{f.name}`")) if f.name in personal else F.col(f"`{f.name}`").cast("string")).alias("v")) for i, f in few]))
        for r in df.select(pairs.alias("p")).groupBy("p.i", "p.v").count().orderBy("i", F.desc("count"), F.asc_nulls_last("v")).collect():
            top.setdefault(r["i"], []).append((r["v"], r["count"]))
    return [
        {"column": f.name, "type": f.dataType.simpleString(), "rows": row["rows"], "nulls": row[f"n{i}"], "distinct": row[f"d{i}"], "min": row[f"a{i}"], "max": row[f"b{i}"], "min_length": row.get(f"s{i}"), "max_length": row.get(f"l{i}"), "top": top.get(i, [])}
        for i, f in enumerate(flat)
    ]


def k_anonymity(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row: k (the smallest group), groups, unique_groups, rows; zeros for an empty table."""
    groups = df.groupBy(*columns).count()
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("bigint")
    return groups.agg(zero(F.min("count")).alias("k"), F.count(F.lit(1)).alias("groups"), F.count_if(F.col("count") == 1).alias("unique_groups"), zero(F.sum("count")).alias("rows"))


def suppress_small(df: DataFrame, columns: Sequence[str], least: int) -> DataFrame:
    """Rows of groups of at least ``least`` rows."""
    return df.withColumn("__n", F.count(F.lit(1)).over(Window.partitionBy(*columns))).filter(F.col("__n") >= least).drop("__n")


def flatten(df: DataFrame) -> DataFrame:
    """One level of structs as columns parent_child."""
    out = []
    for f in df.schema:
        if isinstance(f.dataType, StructType):
            out += [F.col(f"`{f.name}`.`{g.name}`").alias(f"{f.name}_{g.name}") for g in f.dataType]
        else:
            out.append(F.col(f"`{f.name}`"))
    return df.select(out)


def drift(expected: StructType, actual: StructType) -> dict[str, list[str]]:
    """New, gone and retyped columns."""
    a, b = ({f.name: f.dataType.simpleString() for f in s} for s in (expected, actual))
    return {"new": sorted(b.keys() - a.keys()), "gone": sorted(a.keys() - b.keys()), "retyped": sorted(n for n in a.keys() & b.keys() if a[n] != b[n])}


def contract_change(old: StructType, new: StructType) -> tuple[str, list[str]]:
    """The semantic-version level of a schema change and its reasons: what breaks readers or writers is major, a new nullable column minor."""
    a, b = {f.name: f for f in old}, {f.name: f for f in new}
    major = [f"{n}: removed" for n in a if n not in b]
    minor = []
    for n, f in b.items():
        if n not in a:
            (minor if f.nullable else major).append(f"{n}: added as {'nullable' if f.nullable else 'not null'}")
        elif f.dataType != a[n].dataType:
            major.append(f"{n}: {a[n].dataType.simpleString()} became {f.dataType.simpleString()}")
        elif a[n].nullable and not f.nullable:
            major.append(f"{n}: became not null")
    return ("major" if major else "minor" if minor else "patch", major + minor)
