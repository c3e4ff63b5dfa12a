"""Queries through the sources and streams: landing files are made from the tables, read back and compared."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators.profile import flatten
from ..registry import query, read
from ..session import scoped_conf
from ..sources import files
from ..storage.table import Table
from ..streaming import windows
from .storage import _events, _ntz, _stream, scratch
from .tables import facts, table

ISO = "yyyy-MM-dd'T'HH:mm:ss'Z'"


def landed_events(spark, d, copies: int = 1) -> str:
    """The events as gzipped JSON files in the form of an event feed."""
    e = read(spark, d, "events")
    actor = F.struct(F.col("user_id").alias("id"), F.concat(F.lit("user"), F.col("user_id").cast("string"), F.when(F.col("user_id") % 5 == 0, "[bot]").otherwise("")).alias("login"))
    repo = F.struct((F.col("user_id") % 10).alias("id"), F.concat(F.lit("org/repo"), (F.col("user_id") % 10).cast("string")).alias("name"))
    payload = F.to_json(F.struct(F.col("event_type").alias("action"), F.col("event_id").alias("push_id")))
    rows = e.select(F.to_json(F.struct(F.col("event_id").cast("string").alias("id"), F.col("event_type").alias("type"), actor.alias("actor"), repo.alias("repo"), payload.alias("payload"), F.lit(True).alias("public"), F.date_format("ts", ISO).alias("created_at"))).alias("value"))
    path = scratch(spark)
    for i in range(copies):
        rows.write.option("compression", "gzip").text(f"{path}/hour={i}")
    return path


def bronze(spark, d, copies: int = 1) -> DataFrame:
    out = table(spark)
    windows.drain(files.with_lineage(files.event_stream(spark, f"{landed_events(spark, d, copies)}/hour=*")), scratch(spark), windows.append_sink(out.path, "bronze"))
    return out.read()


@query("select event_id::varchar as id, event_type as type, user_id as actor_id, true as has_file, cast(ts as date) as event_date from events")
def bronze_events(spark, d):
    """SRC1, SRC2, SNK1: JSON files streamed into a table with their lineage"""
    return bronze(spark, d).select("id", "type", F.col("actor.id").alias("actor_id"), F.col("_source_file").isNotNull().alias("has_file"), "event_date")


@query("""select event_id, event_type, hour(ts)::int as event_hour, user_id as actor_id, user_id % 5 = 0 as is_bot, 'org' as repo_owner, (user_id % 10)::bigint as repo_id, event_id as push_id, event_type as action from events""")
def typed_event_rows(spark, d):
    """PRJ1, PRJ4: events flattened and cast, with the fields of the payload"""
    return files.typed_events(bronze(spark, d)).select("event_id", "event_type", "event_hour", "actor_id", "is_bot", "repo_owner", "repo_id", "push_id", "action")


@query("select event_id, event_type, user_id as actor_id from events")
def dedup_ingested(spark, d):
    """WIN2: files that land twice; the copy of the last file stays"""
    return files.dedup_events(files.typed_events(bronze(spark, d, 2))).select("event_id", "event_type", "actor_id")


@query("""select repo, actors, events from (select 'org/repo' || (user_id % 10) as repo, count(distinct user_id) as actors, count(*) as events from events where user_id % 5 <> 0 group by 1)
    order by actors desc, events desc, repo limit 3""")
def active_repositories(spark, d):
    """SRC34, SRT1: a top-k report of the repositories with most human actors"""
    return files.active_repos(bronze(spark, d), 3)


@query("select event_id::varchar as event_id, cast(ts as date) as day, event_type as type, event_type = 'error' as is_bot, (event_id % 100)::bigint as bytes_delta from events")
def edit_stream_rows(spark, d):
    """SRC3, SRC4: an edit stream's files, typed; unfinished files don't count"""
    e, path = read(spark, d, "events"), scratch(spark)
    n = F.col("event_id") % 100
    row = F.struct(F.struct(F.col("event_id").cast("string").alias("id"), F.date_format("ts", ISO).alias("dt")).alias("meta"), F.col("event_type").alias("type"), F.lit("enwiki").alias("wiki"), F.when(F.col("event_type") == "error", True).alias("bot"), F.struct(F.lit(7).alias("old"), (n + 7).alias("new")).alias("length"))
    e.select(F.to_json(row).alias("value")).write.option("compression", "gzip").text(f"{path}/raw")
    log = Table(spark, path).log
    for name in [n for n in log.files("raw") if n.endswith(".gz")]:  # the feed's own suffix, and one file still being written
        _renamed(spark, f"{path}/{name}", f"{path}/landing/{name.rsplit('/', 1)[1].replace('.txt.gz', '.jsonl.gz')}")
    spark.createDataFrame([("half a li",)], "value string").write.mode("append").option("compression", "gzip").text(f"{path}/landing/.tmp")
    out = table(spark)
    windows.drain(files.parse_edits(files.edit_stream(spark, f"{path}/landing", 100)), scratch(spark), windows.append_sink(out.path, "edits"))
    return out.read().select("event_id", F.to_date("event_time").alias("day"), "type", "is_bot", "bytes_delta")


def _renamed(spark, old: str, new: str) -> None:
    jvm = spark._jvm.org.apache.hadoop.fs
    a, b = jvm.Path(old), jvm.Path(new)
    fs = a.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(b.getParent())
    fs.rename(a, b)


@query("select n_nationkey::bigint as repo_id, 'org/' || n_name as full_name, (n_regionkey + 10)::bigint as stars from nation where n_regionkey <> 2")
def repos_latest_capture(spark, d):
    """SRC5: of several captures the newest good one counts; failed requests don't"""
    path = scratch(spark)
    n = read(spark, d, "nation").filter("n_regionkey != 2")
    good = n.select(F.lit(200).alias("_status"), F.col("n_nationkey").alias("id"), F.concat(F.lit("org/"), F.col("n_name")).alias("full_name"), "n_regionkey")
    runs = ((0, good), (10, good), (99, read(spark, d, "nation").select(F.lit(404).alias("_status"), F.col("n_nationkey").alias("id"), F.col("n_name").alias("full_name"), "n_regionkey")))
    for k, (more, rows) in enumerate(runs):
        data = F.struct("id", "full_name", (F.col("n_regionkey") + more).alias("stargazers_count"))
        one = rows.select(F.struct(F.lit(f"2024-01-0{k + 1}T00:00:00Z").alias("_fetched_at"), "_status", data.alias("data")).alias("r"))
        one.agg(F.to_json(F.collect_list("r")).alias("value")).write.text(f"{path}/repos/run={k}/x.json")  # one small page of captures
    return files.repos_from_landing(spark, f"{path}/repos/../") .select("repo_id", "full_name", "stars")


@query("select r_regionkey::bigint as id, r_name as name from region")
def exploded_page_rows(spark, d):
    """SRC6: the elements of paged API answers"""
    path = scratch(spark)
    r = read(spark, d, "region").select(F.col("r_regionkey").alias("id"), F.col("r_name").alias("name"))
    r.agg(F.to_json(F.struct(F.collect_list(F.struct("id", "name")).alias("data"))).alias("value")).write.text(path)  # one page: the regions
    return files.exploded_pages(spark, path, "id: bigint, name: string")


@query("select (count(*) filter (event_type <> 'error'))::bigint as good, (count(*) filter (event_type = 'error'))::bigint as bad, true as failfast from events")
def corrupt_records(spark, d):
    """SRC11: broken lines are kept apart with their text, or stop the read"""
    path, e = scratch(spark), read(spark, d, "events")
    line = F.to_json(F.struct("event_id", "event_type"))
    e.select(F.when(F.col("event_type") == "error", F.substring(line, 1, 9)).otherwise(line).alias("value")).write.text(path)
    schema = StructType.fromDDL("event_id bigint, event_type string")
    rows = files.json_records(spark, path, schema).cache()  # a corrupt-record column can't be read alone
    good, bad = files.split_corrupt(rows)
    try:
        files.json_records(spark, path, schema, "FAILFAST").write.format("noop").mode("overwrite").save()
        stopped = False
    except Exception:
        stopped = True
    out = facts(spark, "good bigint, bad bigint, failfast boolean", (good.count(), bad.count(), stopped))
    rows.unpersist()
    return out


@query("select count(*) as lines, (count(distinct o_orderstatus))::bigint as files from orders")
def lines_of_files(spark, d):
    """SRC12: lines counted by the file they are in"""
    path = scratch(spark)
    o = read(spark, d, "orders").select("o_orderstatus", F.col("o_orderkey").cast("string").alias("value"))
    o.repartition(3, "o_orderstatus").write.partitionBy("o_orderstatus").text(path)
    return files.lines_per_file(spark, path).agg(F.sum("count").alias("lines"), F.count(F.lit(1)).alias("files"))


@query("select strftime(t, '%Y-%m-%d') || '-' || hour(t) as key from (select unnest(generate_series(timestamp '2024-02-28 22:00:00', timestamp '2024-03-01 03:00:00', interval 1 hour)) as t)")
def hour_key_range(spark, d):
    """SRC18"""
    return files.hour_keys(spark, "2024-02-28 22:00:00", "2024-03-01 03:00:00")


@query("select sum(range)::bigint as total, count(*) as n from range(0, 100000, 7)")
def number_range(spark, d):
    """SRC15: a range made on the executors"""
    return spark.range(0, 100_000, 7).agg(F.sum("id").alias("total"), F.count(F.lit(1)).alias("n"))


@query("select event_id, user_id as who_id, event_type as what_type, value as what_value from events")
def flattened(spark, d):
    """PRJ3: one level of structs as columns"""
    return flatten(read(spark, d, "events").select("event_id", F.struct(F.col("user_id").alias("id")).alias("who"), F.struct(F.col("event_type").alias("type"), "value").alias("what")))


@query("select event_type, count(*) as events, max(value) as highest from events group by 1")
def stream_complete(spark, d):
    """STR6: complete mode; each batch replaces the result"""
    out = table(spark)
    counts = _stream(spark, d).groupBy("event_type").agg(F.count(F.lit(1)).alias("events"), F.max("value").alias("highest"))
    windows.drain(counts, scratch(spark), lambda batch, n: out.overwrite(batch) and None, "complete")
    return out.read()


@query("select user_id, count(*) as events from events group by 1")
def stream_rocksdb(spark, d):
    """STR9: state in RocksDB, off the heap"""
    with scoped_conf(spark, {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}):
        base = scratch(spark)
        windows.drain(_stream(spark, d).groupBy("user_id").agg(F.count(F.lit(1)).alias("events")), f"{base}/c", windows.merge_sink(f"{base}/out", ["user_id"], "q"), "update")
    return Table(spark, f"{base}/out").read()


@query("""with s as (select user_id, ts, case when ts - lag(ts) over (partition by user_id order by ts) < interval 12 hours then 0 else 1 end as first from events),
    n as (select *, sum(first) over (partition by user_id order by ts rows unbounded preceding) as k from s)
    select user_id, min(ts) as window_start, max(ts) + interval 12 hours as window_end, count(*) as events from n group by user_id, k""")
def stream_sessions(spark, d):
    """STR14: session windows of a stream"""
    out = table(spark)
    windows.drain(windows.sessions(_stream(spark, d), "ts", "12 hours", ["user_id"], "40 days"), scratch(spark), lambda batch, n: out.overwrite(batch) and None, "complete")
    return _ntz(out.read())


@query("select count(*) as rows from events")
def stream_continuous(spark, d):
    """STR10: micro-batches by a processing-time trigger until all input is processed"""
    out = table(spark)
    q = _stream(spark, d).select("event_id").writeStream.option("checkpointLocation", scratch(spark)).trigger(processingTime="100 milliseconds").foreachBatch(windows.append_sink(out.path, "continuous")).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    return out.read().agg(F.count(F.lit(1)).alias("rows"))


@query("select user_id, count(*) as events, max(value) as highest from events group by 1")
def stream_own_state(spark, d):
    """STR15: state of one's own for each key, kept by Arrow batches"""
    base = scratch(spark)
    windows.drain(windows.running_totals(_stream(spark, d), "user_id", "value"), f"{base}/c", windows.merge_sink(f"{base}/out", ["user_id"], "q", order_by=["events"]), "update")
    return Table(spark, f"{base}/out").read()


@query("select 0::bigint as behind, count(*) as processed from events")
def stream_lag(spark, d):
    """STR13, STR4, STR5: rows that a query has not processed yet, by its progress records"""
    path = scratch(spark)
    _events(spark, d).repartition(4).write.parquet(path)
    stream = spark.readStream.schema(_events(spark, d).schema).option("maxFilesPerTrigger", 1).parquet(path)
    q = windows.drain(stream.select("event_id"), scratch(spark), lambda batch, n: batch.write.format("noop").mode("overwrite").save())
    done = [windows.progress_summary(p)["rows"] for p in q.recentProgress]
    total = spark.read.parquet(path).count()
    behind = [total - sum(done[: i + 1]) for i in range(len(done))]
    assert behind == sorted(behind, reverse=True)
    return facts(spark, "behind bigint, processed bigint", (behind[-1], sum(done)))
