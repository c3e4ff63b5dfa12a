"""Queries through versioned tables and streams: their final state is compared."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..registry import query, read
from ..storage.table import Table
from ..streaming import windows


def scratch(spark: SparkSession) -> str:
    """A new folder in the shared one that the cluster names; on one machine without it, a temporary folder."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = tempfile.mkdtemp(prefix="lakeloom-")
        atexit.register(shutil.rmtree, root, True)
    return f"{root.rstrip('/')}/{uuid.uuid4().hex}"


def _events(spark, d) -> DataFrame:
    return read(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def _stream(spark, d, parts: int = 3) -> DataFrame:
    """The events as a stream of files in the order of their times."""
    path = scratch(spark)
    _events(spark, d).repartitionByRange(parts, "ts").sortWithinPartitions("ts").write.parquet(path)
    return spark.readStream.schema(_events(spark, d).schema).option("maxFilesPerTrigger", parts).parquet(path)


def _ntz(df: DataFrame) -> DataFrame:
    return df.select(*[F.col(c).cast("timestamp_ntz").alias(c) if k == "timestamp" else F.col(c) for c, k in df.dtypes])


@query("select event_id, user_id, case when event_id % 3 = 0 then value + 1 else value end as value from events where event_id % 5 <> 1 or event_id % 2 = 1")
def merge_upsert(spark, d):
    """SNK3, SNK6, SNK7, DIM4: delete, update and insert in one merge, which changes nothing when it runs again"""
    e = read(spark, d, "events").select("event_id", "user_id", "value")
    t = Table(spark, scratch(spark))
    t.append(e.filter("event_id % 5 != 2"))
    source = e.filter("event_id % 3 = 0 or event_id % 5 = 2 or (event_id % 5 = 1 and event_id % 2 = 0)").withColumn("value", F.when(F.col("event_id") % 3 == 0, F.col("value") + 1).otherwise(F.col("value")))
    for _ in range(2):
        t.merge(source, ["event_id"], update_if="not (s.value <=> t.value)", delete_if="s.event_id % 5 = 1 and s.event_id % 2 = 0", insert_if="not (s.event_id % 5 = 1 and s.event_id % 2 = 0)")
    return t.read()


@query("select event_id, event_type, value from events where event_type <> 'error'")
def time_travel(spark, d):
    """SRC9, SNK13, SNK15: the version before a later delete"""
    e = read(spark, d, "events").select("event_id", "event_type", "value")
    t = Table(spark, scratch(spark))
    t.append(e)
    t.delete("event_type = 'error'")
    kept = t.version()
    t.delete("event_type = 'view'")
    return t.read(version=kept)


@query("select user_id, max(value) as value from events group by user_id")
def cdf_replica(spark, d):
    """SRC8, SNK8: a replica kept up to date from the change feed"""
    from ..storage.feed import apply_changes

    e = read(spark, d, "events")
    base, half = scratch(spark), F.col("event_id") % 8 < 4
    t = Table(spark, f"{base}/source")
    t.create("user_id bigint, value double", properties={"change_feed": "true"})
    for part in (e.filter(half), e.filter(~half)):
        t.merge(part.groupBy("user_id").agg(F.max("value").alias("value")), ["user_id"], update_if="s.value > t.value")
        apply_changes(spark, t.path, f"{base}/replica", "user_id")
    return Table(spark, f"{base}/replica").read()


@query("select o_orderkey, o_orderstatus, round(o_totalprice, 2) as o_totalprice from orders where o_orderstatus <> 'F' union all select o_orderkey, 'F', 0.0 from orders where o_orderstatus = 'F'")
def replace_where(spark, d):
    """SNK10"""
    o = read(spark, d, "orders").select("o_orderkey", "o_orderstatus", F.round("o_totalprice", 2).alias("o_totalprice"))
    t = Table(spark, scratch(spark))
    t.create(o.schema, ["o_orderstatus"])
    t.append(o)
    t.replace_where(o.filter("o_orderstatus = 'F'").withColumn("o_totalprice", F.lit(0.0)), "o_orderstatus = 'F'")
    return t.read()


@query("select event_id from events")
def idempotent_append(spark, d):
    """SNK11, STR12"""
    e, t = read(spark, d, "events").select("event_id"), Table(spark, scratch(spark))
    for _ in range(2):
        t.append(e, txn=("load", 1))
    return t.read()


def _drained(spark, df: DataFrame, keys: list[str], mode: str) -> DataFrame:
    base = scratch(spark)
    windows.drain(df, f"{base}/checkpoint", windows.merge_sink(f"{base}/out", keys, "query"), mode)
    return _ntz(Table(spark, f"{base}/out").read())


@query("select time_bucket(interval 1 hour, ts) as window_start, time_bucket(interval 1 hour, ts) + interval 1 hour as window_end, event_type, count(*) as events from events group by all")
def stream_tumbling(spark, d):
    """STR1, STR6, SNK5: a stream drained into a table"""
    return _drained(spark, windows.counts_per_window(_stream(spark, d), "ts", "1 hour", by=["event_type"], watermark="40 days"), ["window_start", "event_type"], "update")


@query("select w as window_start, w + interval 2 hours as window_end, count(*) as events from (select unnest([time_bucket(interval 1 hour, ts), time_bucket(interval 1 hour, ts) - interval 1 hour]) as w from events) group by 1")
def stream_sliding(spark, d):
    """STR1"""
    return _drained(spark, windows.counts_per_window(_stream(spark, d), "ts", "2 hours", "1 hour", watermark="40 days"), ["window_start"], "update")


@query("select event_id, user_id from events")
def stream_dedup(spark, d):
    """STR2, STR3: files that arrive twice"""
    path, base = scratch(spark), scratch(spark)
    rows = _events(spark, d).select("event_id", "user_id", "ts")
    rows.unionByName(rows.filter("event_id % 3 = 0")).write.parquet(path)
    stream = spark.readStream.schema(rows.schema).parquet(path)
    windows.drain(windows.dedup_within(stream, "event_id", "ts", "40 days"), f"{base}/checkpoint", windows.append_sink(f"{base}/out", "dedup"))
    return Table(spark, f"{base}/out").read().select("event_id", "user_id")
