"""Queries through what runs on the driver: API clients with a scripted server, captures, files, model clients, retries, and the whole pipeline.

Their inputs are small tables (nations, regions) or a stream of events that is read row by row, as such clients do, in shards by tasks.
"""

from __future__ import annotations

import gzip
import io
import json
import logging
import shutil
import tempfile
from collections.abc import Iterator
from contextlib import contextmanager
from itertools import chain, islice
from pathlib import Path
from urllib.parse import parse_qsl, urlsplit

import pyarrow as pa
from pyspark.sql import functions as F

from .. import pipeline
from ..functions import files as small
from ..functions import inference, titles
from ..operators import privacy, reconcile
from ..ops import retry, tracking
from ..registry import query, read
from ..session import scoped_conf
from ..sources import rest
from ..storage.table import Table
from ..streaming import windows
from .ingest import landed_events
from .storage import _events, scratch
from .tables import facts, table

#: Events of a captured stream that one client takes.
SHARD_EVENTS = 250_000


@contextmanager
def folder() -> Iterator[Path]:
    """Files of the driver alone."""
    path = Path(tempfile.mkdtemp(prefix="lakeloom-"))
    try:
        yield path
    finally:
        shutil.rmtree(path, True)


class Pages:
    """A server that answers in pages of ten and asks for patience once."""

    def __init__(self, items: list[dict]):
        self.items, self.calls = items, 0

    def get(self, url, headers):
        self.calls += 1
        if self.calls == 2:
            return rest.Response(url, 429, {"Retry-After": "1"}, "{}")
        at = int(dict(parse_qsl(urlsplit(url).query)).get("page", 0))
        more = {"Link": f'<http://h/repos/o/r/issues?page={at + 1}>; rel="next"'} if 10 * (at + 1) < len(self.items) else {}
        return rest.Response(url, 200, {**more, "ETag": f"t{at}"}, json.dumps(self.items[10 * at : 10 * at + 10]))


@query("select n_nationkey::bigint as id, n_name as title, 3::bigint as pages, '2024-01-25T00:00:00Z' as watermark from nation")
def api_pages(spark, d):
    """SRC19 to SRC22, SRC25, SRC26, SNK32, REM35 to REM37, REM42: pages by their links, with a wait; the watermark moves last"""
    rows = read(spark, d, "nation").select("n_nationkey", "n_name").orderBy("n_nationkey").collect()  # 25 nations
    items = [{"id": r["n_nationkey"], "title": r["n_name"], "updated_at": f"2024-01-{r['n_nationkey'] + 1:02d}T00:00:00Z"} for r in rows]
    with folder() as f:
        marks = small.WatermarkStore(f / "marks.json")
        report = rest.fetch_issues(rest.ApiClient("http://h", Pages(items), sleep=lambda s: None), "o/r", f, marks, "1", "2023-01-01T00:00:00Z")
        got = [x for p in sorted(f.glob("issues/**/*.json")) for x in json.loads(p.read_text())["data"]]
        return facts(spark, "id bigint, title string, pages bigint, watermark string", *[(x["id"], x["title"], report.pages, marks.get("o/r")) for x in got])


@query("select r_regionkey::bigint as id, r_name as name, r_regionkey = 4 as missing from region")
def api_repositories(spark, d):
    """SRC24, SRC27, REM39, REM40: repositories from a replayed tape; one that is gone is a finding"""
    rows = {r["r_name"].replace(" ", "_"): r for r in read(spark, d, "region").collect()}  # five regions

    class Server:
        def get(self, url, headers):
            r = rows[url.rsplit("/", 1)[1]]
            return rest.Response(url, 404 if r["r_regionkey"] == 4 else 200, {}, json.dumps({"id": r["r_regionkey"], "name": r["r_name"]}))

    with folder() as f:
        for run, inner in (("1", Server()), ("2", None)):  # the second run has the tape alone
            report = rest.fetch_repos(rest.ApiClient("http://h", rest.Cassette(f / "tape", inner)), [f"o/{n}" for n in rows], f, run)
        seen = [json.loads(p.read_text()) for p in f.glob("repos/run=2/*.json")]
        return facts(spark, "id bigint, name string, missing boolean", *[(x["data"]["id"], x["data"]["name"], f"o/{x['data']['name'].replace(' ', '_')}" in report.missing) for x in seen])


@query("select event_id::varchar as id, event_type as type from events")
def captured_events(spark, d):
    """SRC28 to SRC33, SRC35, SNK33, REM43 to REM48: a stream of server-sent events captured into files over a lost connection, and read back; the stream comes in shards of ids, each with a client, a connection and a state of its own"""
    rows, out = read(spark, d, "events").select("event_id", "event_type"), scratch(spark)

    def captured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches = (b for b in batches if b.num_rows)
        if (first := next(batches, None)) is None:
            return
        waiting, total = (e for b in chain([first], batches) for e in zip(b["event_id"].to_pylist(), b["event_type"].to_pylist())), 0

        def connect(last):
            nonlocal total
            for event_id, event_type in waiting:
                assert last is None or event_id > int(last)
                total += 1
                yield from (f"id: {event_id}", "data: " + json.dumps({"meta": {"id": str(event_id), "domain": "d"}, "type": event_type}), "")
                if last is None and total > first.num_rows // 2:
                    yield from ("data: " + json.dumps({"meta": {"domain": "canary"}}), "")
                    raise ConnectionError

        with tempfile.TemporaryDirectory(prefix="lakeloom-") as f:
            landing, state = Path(f) / "landing", Path(f) / "state.json"
            report = rest.capture(connect, landing, state, max_seconds=1e9, batch_events=500, sleep=lambda s: None)
            paths = sorted(landing.glob("*.jsonl.gz"))
            assert (report.events, report.canaries, report.reconnects) == (total, 1, 1) and sum(map(small.count_lines, paths)) == total
            assert rest.load_last_event_id(state) == report.last_id
            back = ((x["meta"]["id"], x["type"]) for x in small.json_lines_many(paths))
            while some := list(islice(back, 10_000)):
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*some)], ["id", "type"])

    shards = max(1, -(-rows.count() // SHARD_EVENTS))
    rows.repartitionByRange(shards, "event_id").sortWithinPartitions("event_id").mapInArrow(captured, "id string, type string").write.parquet(out)
    return spark.read.schema("id string, type string").parquet(out)


@query("select 4::bigint as good, 1::bigint as bad, 'm2' as mark, 2::bigint as clicks")
def driver_files(spark, d):
    """SRC26, SRC32, ML14, SNK33, REM48: JSON lines with a broken one, and a store of marks"""
    with folder() as f:
        path, bad = f / "x.jsonl.gz", []
        with small.atomic_write(path, "wb") as out:
            out.write(gzip.compress(b'{"type": "click"}\n{"type": "view"}\nbroken\n{"type": "click"}\n{"type": "buy"}\n'))
        good = sum(1 for _ in small.json_lines(path, "skip", bad))
        marks = small.WatermarkStore(f / "m.json")
        for m in ("m1", "m2"):
            marks.set("k", m)
        clicks = sum(r["type"] == "click" for r in small.json_lines(path, "skip"))
        mark = marks.get("k")
    return facts(spark, "good bigint, bad bigint, mark string, clicks bigint", (good, len(bad), mark, clicks))


@query("select n_name as name, length(n_name)::bigint as answer, 25::bigint as asked from nation")
def cached_answers(spark, d):
    """UDF4, UDF5, ML20 to ML22, REM51, REM54 to REM57: answers through a rate limit and a cache; a second run asks nobody"""
    names = [{"name": r["n_name"], "b": i // 5, "i": i} for i, r in enumerate(read(spark, d, "nation").orderBy("n_nationkey").collect())]  # 25 nations
    asked: list[str] = []

    class Model:
        def complete(self, request):
            asked.extend(request["names"])
            return {"lengths": [len(n) for n in request["names"]]}

    waits: list[float] = []
    with folder() as f:
        for inner in (Model(), None):
            client = inference.CachedClient(f / "cache.jsonl", inner)
            limit = inference.TokenBucket(1000.0, clock=lambda: 0.0, sleep=waits.append)
            out = list(inference.run_batches(names, "b", "i", lambda g: {"names": [r["name"] for r in g]}, lambda a, g: ({"name": r["name"], "answer": n} for r, n in zip(g, a["lengths"], strict=True)), client, 2, limit))
        try:
            inference.complete_as(client, {"names": [r["name"] for r in names[:5]]}, lambda a: a["absent"])
            raise AssertionError("an answer without the field passed")
        except inference.InvalidOutput:
            pass
    assert titles.request_key({"a": 1, "b": 2}) == titles.request_key({"b": 2, "a": 1}) and waits
    return facts(spark, "name string, answer bigint, asked bigint", *[(r["name"], r["answer"], len(asked)) for r in out])


@query("select 3::bigint as calls, 'done' as result, 'timed' as message, 3::bigint as runs, true as table_has_rows")
def retries_and_timers(spark, d):
    """OPS5, OPS6, OPS15, OPS22 to OPS24, REM17, REM18, REM49, REM50: retries, timers, JSON logs and tables as text"""
    calls, text = [], io.StringIO()

    @retry.retry((ValueError,), attempts=4, sleep=lambda s: None)
    def flaky():
        calls.append(1)
        if len(calls) < 3:
            raise ValueError("not yet")
        return "done"

    result = flaky()
    logger = retry.json_logger(f"q{id(text)}", text)
    logger.log(logging.INFO, "timed")
    logged = json.loads(text.getvalue().splitlines()[0])
    timing = retry.time_it(lambda: None, 3, "nothing")
    shown = retry.compare_timings([timing])
    return facts(spark, "calls bigint, result string, message string, runs bigint, table_has_rows boolean", (len(calls), result, next(v for v in logged.values() if v == "timed"), len(timing.runs), "nothing" in shown))


@query("select n_regionkey as region, count(*) as nations, true as labelled, true as planned from nation group by 1")
def labelled_jobs(spark, d):
    """OPS8, OPS9, OPS11 to OPS14, REM20: a job group, settings for a block, plans, and figures of the UI's interface (here scripted)"""
    counts = read(spark, d, "nation").groupBy(F.col("n_regionkey").alias("region")).agg(F.count(F.lit(1)).alias("nations"))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    with tracking.job_group(spark, "g1", "counts"), scoped_conf(spark, {"spark.sql.shuffle.partitions": "3"}):
        labelled = spark.sparkContext.getLocalProperty("spark.jobGroup.id") == "g1" and spark.conf.get("spark.sql.shuffle.partitions") == "3"
    labelled = labelled and spark.conf.get("spark.sql.shuffle.partitions") == before
    answers = {"jobs": [{"jobId": 1, "jobGroup": "g1", "stageIds": [4]}], "stages": [{"stageId": 4, "numTasks": 2, "inputRecords": 25, "shuffleReadBytes": 0, "shuffleWriteBytes": 7, "diskBytesSpilled": 0, "executorRunTime": 5, "status": "COMPLETE"}], "sql?details=true&length=10000": [{"successJobIds": [1], "nodes": [{"metrics": [{"name": "number of files read", "value": "1"}]}]}]}
    ui = tracking.SparkUI(spark, lambda url: answers[url.split("/", url.count("/") - (1 if "sql" in url else 0))[-1].rsplit("/", 1)[-1]])
    assert ui.stages("g1")[0].input_records == 25 and ui.files_read("g1") == 1
    planned = bool(tracking.grep_plan(counts, "Exchange")) and "nation" in tracking.plan_text(counts)
    return counts.withColumn("labelled", F.lit(labelled)).withColumn("planned", F.lit(planned))


@query("select true as same, false as other, 'Xxxx9-x' as masked, 'key' as key_name")
def small_helpers(spark, d):
    """DIM7, GOV9, GOV18, REM1, REM2, REM24: equal results whatever the order, a mask in Python, keys and settings from the environment"""
    n = read(spark, d, "nation").select("n_nationkey", "n_name")
    same, other = reconcile.same_rows(n, n.orderBy(F.desc("n_name"))), reconcile.same_rows(n, n.unionByName(n))
    try:
        privacy.key_from_env("LAKELOOM_NO_SUCH_KEY")
        name = "none"
    except RuntimeError:
        name = "key"
    assert tracking.Settings(data_root="/r").path("gold", "t") == "/r/gold/t"
    return facts(spark, "same boolean, other boolean, masked string, key_name string", (same, other, privacy.mask_format_python("Abcd1-e"), name))


@query("select event_type, count(*) as events from events group by 1")
def replayed_batches(spark, d):
    """STR8, STR11, SNK29: the same micro-batch twice changes nothing"""
    out = table(spark)
    sink = windows.merge_sink(out.path, ["event_id"], "replay")
    e = _events(spark, d).select("event_id", "event_type")
    for number in (0, 0, 1):
        sink(e, number)
    return out.read().groupBy("event_type").agg(F.count(F.lit(1)).alias("events"))


@query("select count(*) as kept, 2::bigint as late from events")
def late_rows(spark, d):
    """STR7: rows behind the watermark are dropped from windows that are closed"""
    path, out = scratch(spark), scratch(spark)
    e = _events(spark, d).select("event_id", "ts")
    e.write.parquet(f"{path}/in")
    stream = spark.readStream.schema(e.schema).parquet(f"{path}/in")
    sink = windows.merge_sink(f"{out}/t", ["window_start"], "q")
    run = lambda: windows.drain(windows.counts_per_window(stream, "ts", "1 hour", watermark="1 hour"), f"{out}/c", sink, "update")
    run()
    first = e.agg(F.min("ts").alias("ts"))
    old = first.select(F.explode(F.expr("array(-1L, -2L)")).alias("event_id"), "ts").withColumn("ts", F.col("ts") + F.col("event_id") * F.expr("interval 1 day"))
    old.write.mode("append").parquet(f"{path}/in")
    q = run()
    late = sum(windows.progress_summary(p)["late_rows"] for p in q.recentProgress)
    kept = Table(spark, f"{out}/t").read().agg(F.sum("events").alias("kept"))
    return kept.withColumn("late", F.lit(late).cast("bigint"))


@query("""select event_type, (count(*))::bigint as events from events group by 1 union all select 'repositories', count(distinct user_id % 10) from events""")
def medallion_run(spark, d):
    """OPS16 to OPS21, SNK1, SNK2, SNK4, REM5, REM9: landed files through bronze, silver, gold and quality"""
    root = scratch(spark)
    jvm = spark._jvm.org.apache.hadoop.fs
    landed, target = jvm.Path(f"{landed_events(spark, d)}/hour=0"), jvm.Path(f"{root}/landing/events")
    fs = landed.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(target.getParent())
    fs.rename(landed, target)
    settings = tracking.Settings(data_root=root)
    for step in pipeline.STEPS.values():
        step(spark, settings)
    facts_table = Table(spark, settings.path("gold", "fct_events")).read()
    repos = Table(spark, settings.path("gold", "dim_repo")).read().filter("sk <> -1").select("repo_id").distinct().agg(F.lit("repositories").alias("event_type"), F.count(F.lit(1)).alias("events"))
    return facts_table.groupBy("event_type").agg(F.count(F.lit(1)).alias("events")).unionByName(repos)
