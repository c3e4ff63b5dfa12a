"""Mixing sources to target weights by entropy balancing, with DataFrame functions only.

Each source's documents get rates r = min(3, exp(lambda x)), x being the size over the source's mean size: the rates
closest to 1 in relative entropy whose tokens sum to the target, none above MOST. The multipliers solve the convex dual
by Newton steps on the table of (source, size, number of documents), kept inside a bracket; one step for all sources is
one distributed aggregation. Rates become whole copies by a running total in the order of size, so a source's tokens
miss its target by about one document at most. The order within a size is that of a hash of the id: reruns agree.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

MOST = 3.0
WEIGHTS = (1, 2, 3)
#: Newton steps at most (more is an error), and the relative error of a source's tokens at which they end.
STEPS, TOLERANCE = 200, 1e-7
#: Parts into which documents of one source and size are dealt before they are numbered.
DEALS = 512


def sizes(text: Column) -> Column:
    """Number of runs of characters other than blanks; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")


def targets(sources: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = MOST) -> DataFrame:
    """sources (source, source_size, ...) with rank, weight and target. One row per source; the ranks follow the sources' code points, null last.

    The total is shared by weight; a target stops at most x its source's size and the excess is shared again. This is water
    filling: with the sources in the order of cap / weight, a prefix is capped, and the level of the rest follows from sums.
    """
    ranked = sources.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), ((F.col("rank") - 1) % len(weights) + 1).cast("int"))
    w = ranked.withColumn("weight", weight).withColumn("cap", F.lit(most) * F.col("source_size"))
    order = Window.orderBy(F.col("cap") / F.col("weight"), "rank").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    filled = w.withColumn("level", (F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(order), F.lit(0.0))) / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(order), F.lit(0.0))))
    # The first source in this order that its level leaves below its cap ends the capped prefix.
    level = F.min(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct(F.col("cap") / F.col("weight"), "rank", "level"))).over(everything)["level"]
    return filled.withColumn("common", level).withColumn("target", F.coalesce(F.least("cap", F.col("common") * F.col("weight")), F.col("cap")).cast("double")).drop("level", "common", "cap")


def _rate(multiplier: Column, x: Column, most: float) -> Column:
    return F.exp(F.least(multiplier * x, F.lit(math.log(most))))


def balance(histogram: DataFrame, sources: DataFrame, most: float = MOST) -> DataFrame:
    """(rank, multiplier) for each source with tokens and a target. histogram: (rank, size, docs); sources: (rank, source_size, source_docs, target)."""
    mean = F.col("source_size") / F.col("source_docs")
    full = histogram.filter("size > 0").join(sources.filter("source_size > 0").select("rank", mean.alias("mean"), "target"), "rank")
    full = common.stored(full.select("rank", "target", (F.col("size") / F.col("mean")).alias("x"), (F.col("size") * F.col("docs")).cast("double").alias("tokens")), "histogram")
    start = full.groupBy("rank", "target").agg(F.min("x").alias("low"), F.sum("tokens").alias("all"))
    # At hi all rates are at the bound or the target is met; at lo the tokens are below the target.
    hi = F.when(F.col("target") >= F.col("all"), math.log(most) / F.col("low")).otherwise(0.0)
    lo = F.when(F.col("target") < F.col("all"), F.log(F.greatest(F.col("target") / F.col("all"), F.lit(1e-12))) / F.col("low")).otherwise(0.0)
    state = common.stored(start.select("rank", lo.alias("lo"), hi.alias("hi"), F.when(F.col("target") >= F.col("all") * most * (1 - 1e-12), hi).otherwise(F.lit(0.0)).alias("multiplier")), "multipliers")
    for _ in range(STEPS):
        state_now = state.select("rank", "lo", "hi", "multiplier")
        rate = _rate(F.col("multiplier"), F.col("x"), most)
        free = F.col("multiplier") * F.col("x") < math.log(most)
        sums = full.join(state_now, "rank").groupBy("rank", "lo", "hi", "multiplier", "target").agg(F.sum(rate * F.col("tokens")).alias("got"), F.sum(F.when(free, rate * F.col("tokens") * F.col("x")).otherwise(0.0)).alias("slope"))
        miss = F.col("got") - F.col("target")
        lo, hi = F.when(miss <= 0, F.col("multiplier")).otherwise(F.col("lo")), F.when(miss >= 0, F.col("multiplier")).otherwise(F.col("hi"))
        newton = F.col("multiplier") - miss / F.when(F.col("slope") > 0, F.col("slope"))
        moved = F.when((newton > F.col("lo")) & (newton < F.col("hi")), newton).otherwise((F.col("lo") + F.col("hi")) / 2)
        error = F.abs(miss) / F.greatest("target", F.lit(1.0))
        stepped = sums.withColumn("error", error).withColumns({"lo": lo, "hi": hi}).withColumn("multiplier", F.when(F.col("error") < TOLERANCE, F.col("multiplier")).otherwise(moved))
        before, state = state, common.stored(stepped.select("rank", "lo", "hi", "multiplier", "error"), "multipliers")
        common.release(before)
        worst = state.agg(F.max("error")).first()[0]
        if worst is None or worst < TOLERANCE:
            break
    else:
        raise RuntimeError(f"the multipliers did not settle in {STEPS} steps")
    return state.select("rank", "multiplier")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = WEIGHTS, most: float = MOST) -> DataFrame:
    """One row per row of docs: id, size, source_size, target, copies, taken.

    A null text has size 0 and is never taken; a null source is a source of its own, the last. Repeated rows are rows of
    their own. An empty table gives an empty one.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), sizes(F.col(text_col)).alias("size"), F.xxhash64(F.lit(23), F.col(id_col), F.col(text_col)).alias("h"))
    rows = common.stored(rows, "sizes")
    by_source = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("source_docs"))
    sources = common.stored(targets(by_source, weights, most), "sources")
    deal = F.pmod("h", F.lit(DEALS)).cast("int")
    dealt = rows.withColumn("deal", deal).groupBy("source", "size", "deal").agg(F.count(F.lit(1)).alias("n"))
    named = sources.select(F.col("source").alias("s"), "rank", "source_size", "source_docs", "target")
    dealt = common.stored(dealt.join(named, F.col("source").eqNullSafe(F.col("s"))).drop("s"), "deals")
    histogram = dealt.groupBy("rank", "size").agg(F.sum("n").alias("docs"))
    multipliers = balance(histogram, sources, most)
    # rates, and the sum of the rates before each size of a source, then before each deal of a size
    rate = F.when(F.col("size") > 0, _rate(F.coalesce("multiplier", F.lit(0.0)), F.col("size") * F.col("source_docs") / F.col("source_size"), most)).otherwise(0.0)
    rated = histogram.join(multipliers, "rank", "left").join(sources.select("rank", "source_size", "source_docs"), "rank").withColumn("rate", rate)
    by_size = Window.partitionBy("rank").orderBy("size").rowsBetween(Window.unboundedPreceding, -1)
    rated = rated.select("rank", "size", "rate", F.coalesce(F.sum(F.col("rate") * F.col("docs")).over(by_size), F.lit(0.0)).alias("before"))
    by_deal = Window.partitionBy("rank", "size").orderBy("deal").rowsBetween(Window.unboundedPreceding, -1)
    placed = dealt.withColumn("earlier", F.coalesce(F.sum("n").over(by_deal), F.lit(0))).join(rated, ["rank", "size"])
    placed = placed.select(F.col("source").alias("s"), F.col("size").alias("z"), F.col("deal").alias("d"), "source_size", "target", "rate", (F.col("before") + F.col("earlier") * F.col("rate")).alias("start"))
    number = F.row_number().over(Window.partitionBy("source", "size", "deal").orderBy("h", "id"))
    numbered = rows.withColumn("deal", deal).withColumn("number", number)
    full = numbered.join(placed, F.col("source").eqNullSafe(F.col("s")) & (F.col("size") == F.col("z")) & (F.col("deal") == F.col("d")))
    upto = lambda n: F.floor(F.col("start") + n * F.col("rate") + 0.5)
    copies = F.least(upto(F.col("number")) - upto(F.col("number") - 1), F.lit(math.floor(most)))
    out = full.withColumn("copies", F.when(F.col("size") > 0, copies).otherwise(0).cast("int"))
    return out.select(F.col("id").alias(id_col), "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).cast("bigint").alias("taken"), F.col("h").alias("row_hash"))
