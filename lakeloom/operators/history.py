"""Deduplication, version histories and point-in-time views."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

UNKNOWN = -1


def dedup_latest(df: DataFrame, keys: str | Sequence[str], order_by: Sequence[Column]) -> DataFrame:
    """The first row of each key in the given order. A rank filter, so Spark limits each group before the shuffle."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    ranked = df.withColumn("__rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order_by)))
    return ranked.filter("__rank = 1").drop("__rank")


def latest_by_struct(df: DataFrame, keys: Sequence[str], order_by: Sequence[str]) -> DataFrame:
    """The row with the greatest order values of each key in one hash aggregation, without a sort."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order_by)).alias("__row")).select(*keys, "__row.*").select(df.columns)


def content_hash(*columns: str) -> Column:
    """sha256 of the columns as JSON. Names tell nulls apart, which joined values would not."""
    return F.sha2(F.to_json(F.struct(*columns)), 256)


def scd2_history(observations: DataFrame, keys: Sequence[str], tracked: Sequence[str], effective: str, existing: DataFrame | None = None, surrogate: str | None = "sk") -> DataFrame:
    """Versions [valid_from, valid_to) of the tracked attributes of each key.

    Observations without a key or time are dropped. On the same key and time a new observation beats a stored version,
    and among new ones the greatest hash wins. A version that repeats the one before is merged into it, so late data
    may also remove a version. The three windows share one partitioning by key.
    """
    keys, tracked = list(keys), list(tracked)
    new = observations.select(*keys, *tracked, F.col(effective).alias("valid_from"), F.lit(1).alias("__new"))
    if existing is not None:
        new = new.unionByName(existing.select(*keys, *tracked, "valid_from", F.lit(0).alias("__new")))
    present = new.dropna(subset=[*keys, "valid_from"]).withColumn("row_hash", content_hash(*tracked))
    by_key = Window.partitionBy(*keys).orderBy("valid_from")
    # One row a moment: of equal times the last in this order is kept, seen from the row that follows it.
    ties = Window.partitionBy(*keys).orderBy("valid_from", "__new", "row_hash")
    last = present.withColumn("__next", F.lead("valid_from").over(ties)).filter(~F.coalesce(F.col("__next") == F.col("valid_from"), F.lit(False)))
    changed = last.withColumn("__before", F.lag("row_hash").over(by_key)).filter(~F.coalesce(F.col("__before") == F.col("row_hash"), F.lit(False)))
    out = changed.withColumn("valid_to", F.lead("valid_from").over(by_key)).withColumn("is_current", F.col("valid_to").isNull())
    columns = [*keys, *tracked, "valid_from", "valid_to", "is_current", "row_hash"]
    if surrogate:
        out = out.withColumn(surrogate, F.xxhash64(*keys, "valid_from"))
        columns = [surrogate, *columns]
    return out.select(columns)


def scd2_as_of(history: DataFrame, moment: Column) -> DataFrame:
    """The versions that held at a moment; the end of a version is exclusive."""
    return history.filter((F.col("valid_from") <= moment) & (F.col("valid_to").isNull() | (F.col("valid_to") > moment)))


def as_of_join(facts: DataFrame, history: DataFrame, keys: Sequence[str], moment: str, take: Sequence[str], unknown: dict[str, object] | None = None) -> DataFrame:
    """Each fact once, with columns of the version that held at its moment; unknown: values where there is none.

    Keys equal by name, the interval as a residual condition: a shuffled equi-join, never a nested loop.
    """
    h = history.select(*[F.col(k).alias(f"__{k}") for k in keys], F.col("valid_from").alias("__from"), F.col("valid_to").alias("__to"), *take)
    on = [F.col(k) == F.col(f"__{k}") for k in keys] + [F.col(moment) >= F.col("__from"), F.col("__to").isNull() | (F.col(moment) < F.col("__to"))]
    condition = on[0]
    for c in on[1:]:
        condition = condition & c
    joined = facts.join(h, condition, "left").drop("__from", "__to", *[f"__{k}" for k in keys])
    for name, value in (unknown or {}).items():
        joined = joined.withColumn(name, F.coalesce(name, F.lit(value)))
    return joined


def as_of_latest(facts: DataFrame, changes: DataFrame, keys: Sequence[str], moment: str, changed_at: str, value: str, split_seconds: int | None = None) -> DataFrame:
    """The last change at or before each fact's moment, without intervals: facts and changes are merged in one sorted pass by key.

    A union and a running last value replace the join of each fact with all earlier changes of its key. split_seconds: a key's
    rows are sorted in stretches of this length, and the last change of each is carried to those after it, so that no task
    gets all rows of a hot key.
    """
    f = facts.withColumn("__at", F.col(moment)).withColumn("__fact", F.lit(1)).withColumn(value, F.lit(None).cast(changes.schema[value].dataType))
    c = changes.select(*keys, value, F.col(changed_at).alias("__at"), F.lit(0).alias("__fact"))
    both = f.unionByName(c, allowMissingColumns=True)
    change = F.when(F.col("__fact") == 0, F.struct(F.col(value).alias("v")))
    parts = [*keys, "__part"] if split_seconds else list(keys)
    if split_seconds:
        both = both.withColumn("__part", F.floor(F.unix_timestamp("__at") / split_seconds))
    order = Window.partitionBy(*parts).orderBy("__at", "__fact").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = F.last(change, ignorenulls=True).over(order)
    if split_seconds:
        names = {p: f"__k{i}" for i, p in enumerate(parts)}
        last = both.groupBy(*[F.col(p).alias(n) for p, n in names.items()]).agg(F.max_by(change, F.when(F.col("__fact") == 0, F.col("__at"))).alias("__carried"))
        over = Window.partitionBy(*[names[k] for k in keys]).orderBy(names["__part"]).rowsBetween(Window.unboundedPreceding, -1)  # one row a stretch
        last = last.withColumn("__carried", F.last("__carried", ignorenulls=True).over(over))
        on = F.lit(True)
        for p, n in names.items():
            on = on & F.col(p).eqNullSafe(F.col(n))
        both = both.withColumn("__seen", seen).filter("__fact = 1").join(last, on)
        return both.withColumn(value, F.coalesce("__seen", "__carried")["v"]).select(*facts.columns, value)
    return both.withColumn(value, seen["v"]).filter("__fact = 1").select(*facts.columns, value)


def attribute_changes(df: DataFrame, keys: Sequence[str], value: str, order: str) -> DataFrame:
    """Rows at which a value differs from the one before, with ``previous``."""
    w = Window.partitionBy(*keys).orderBy(order)
    return df.withColumn("previous", F.lag(value).over(w)).filter(F.col("previous").isNotNull() & (F.col("previous") != F.col(value)))


def rename_or_transfer(df: DataFrame, key: str, name: str, owner: str, order: str) -> DataFrame:
    """Each change of a name: a transfer if the owner changes, else a rename."""
    w = Window.partitionBy(key).orderBy(order)
    both = df.withColumn("old_name", F.lag(name).over(w)).withColumn("old_owner", F.lag(owner).over(w)).filter(F.col("old_name") != F.col(name))
    return both.withColumn("kind", F.when(F.col("old_owner") != F.col(owner), "transfer").otherwise("rename"))


def scd3(df: DataFrame, key: str, value: str, order: Sequence[str]) -> DataFrame:
    """One row a key: the current value and the last one that differed from it."""
    w = Window.partitionBy(key).orderBy(*order)
    moved = df.withColumn("previous", F.lag(value).over(w)).filter(F.col("previous").isNull() | (F.col("previous") != F.col(value)))
    return moved.groupBy(key).agg(F.max_by(value, F.struct(*order)).alias("current"), F.max_by("previous", F.struct(*order)).alias("previous"))


def last_change_per_key(changes: DataFrame, key: str) -> DataFrame:
    """The final change of each key of a change feed: images before an update are dropped; within a commit a surviving row beats a delete.

    A sequence column ``_change_seq`` decides between changes of the same kind, where the feed has one.
    """
    after = changes.filter(F.col("_change_type") != "update_preimage")
    order = [F.desc("_commit_version"), F.when(F.col("_change_type") == "delete", 1).otherwise(0)]
    if "_change_seq" in changes.columns:
        order.append(F.desc("_change_seq"))
    return dedup_latest(after, key, order)


def cdc_reduce(target: DataFrame, changes: DataFrame, key: str, sequence: str = "lsn", op: str = "op") -> DataFrame:
    """A target after changes with op I, U or D, by increasing sequence numbers.

    Late and repeated changes are ignored. A deleted key stays as a tombstone (``deleted``), so an update that arrives late
    can't bring it back. target has the columns of changes without op, and ``deleted``.
    """
    columns = [c for c in changes.columns if c != op]
    incoming = changes.withColumn("deleted", F.col(op) == "D").select(*columns, "deleted")
    return latest_by_struct(target.select(*columns, "deleted").unionByName(incoming), [key], [sequence])
