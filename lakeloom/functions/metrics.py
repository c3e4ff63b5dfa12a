"""Classification metrics, over columns of a DataFrame."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def accuracy(df: DataFrame, gold: str, pred: str) -> DataFrame:
    """One row: rows, right, accuracy; no answer counts as wrong."""
    right = F.coalesce(F.col(gold) == F.col(pred), F.lit(False))
    return df.agg(F.count(F.lit(1)).alias("rows"), F.count_if(right).alias("right"), F.avg(right.cast("int")).alias("accuracy"))


def wilson(right: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """The Wilson interval of a share."""
    p = right / n
    middle, width = p + z * z / (2 * n), z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    below = 1 + z * z / n
    return F.greatest((middle - width) / below, F.lit(0.0)), F.least((middle + width) / below, F.lit(1.0))


def confusion(df: DataFrame, gold: str, pred: str, labels: Sequence) -> DataFrame:
    """Counts by gold label, a column for each predicted label and no_answer for null or an unknown one."""
    known = F.when(F.col(pred).isin(list(labels)), F.col(pred).cast("string")).otherwise("no_answer")
    return df.withColumn("__p", known).groupBy(gold).pivot("__p", [*map(str, labels), "no_answer"]).agg(F.count(F.lit(1))).na.fill(0)


def per_class(df: DataFrame, gold: str, pred: str, labels: Sequence) -> DataFrame:
    """label, precision, recall, f1, support; nothing over nothing is 0."""
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    rows = df.select(F.col(gold).alias("g"), F.col(pred).alias("p"))
    long = rows.select(F.explode(F.array(*map(F.lit, labels))).alias("label"), "g", "p").groupBy("label").agg(
        F.count_if((F.col("g") == F.col("label")) & (F.col("p") == F.col("label"))).alias("tp"), F.count_if(F.col("p") == F.col("label")).alias("predicted"), F.count_if(F.col("g") == F.col("label")).alias("support")
    )
    p, r = ratio(F.col("tp"), F.col("predicted")), ratio(F.col("tp"), F.col("support"))
    return long.select("label", p.alias("precision"), r.alias("recall"), ratio(2 * p * r, p + r).alias("f1"), "support")


def macro_f1(df: DataFrame, gold: str, pred: str, labels: Sequence) -> DataFrame:
    return per_class(df, gold, pred, labels).agg(F.avg("f1").alias("macro_f1"))


def binary(df: DataFrame, gold: str, pred: str) -> DataFrame:
    """One row: tp, fp, fn, tn of two boolean columns."""
    g, p = F.col(gold), F.col(pred)
    return df.agg(F.count_if(g & p).alias("tp"), F.count_if(~g & p).alias("fp"), F.count_if(g & ~p).alias("fn"), F.count_if(~g & ~p).alias("tn"))


def kappa(df: DataFrame, a: str, b: str) -> DataFrame:
    """Cohen's kappa; raters who both use one label only agree fully."""
    n = df.agg(F.count(F.lit(1)).alias("n"), F.avg((F.col(a) == F.col(b)).cast("int")).alias("seen"))
    left, right = df.groupBy(F.col(a).alias("l")).agg(F.count(F.lit(1)).alias("x")), df.groupBy(F.col(b).alias("l")).agg(F.count(F.lit(1)).alias("y"))
    chance = left.join(right, "l").agg(F.coalesce(F.sum(F.col("x").cast("double") * F.col("y")), F.lit(0.0)).alias("xy"))
    both = n.join(chance).withColumn("expected", F.col("xy") / (F.col("n").cast("double") * F.col("n")))  # one row each
    return both.select(F.when(F.col("expected") == 1, 1.0).otherwise((F.col("seen") - F.col("expected")) / (1 - F.col("expected"))).alias("kappa"))


def matrix_text(cells: Sequence[Sequence[int]], labels: Sequence[str]) -> str:
    """A confusion matrix as text: a row for each true label, a column for each predicted one."""
    width = max(len(str(x)) for x in [*labels, *(c for row in cells for c in row)])
    lines = [" ".join(str(x).rjust(width) for x in ["", *labels])]
    return "\n".join([*lines, *(" ".join(str(x).rjust(width) for x in [label, *row]) for label, row in zip(labels, cells, strict=True))])


def gate(name: str, value: float, least: float) -> tuple[bool, str]:
    return value >= least, f"{name}: {value:.3f} (at least {least:.3f})"
