"""Versioned tables, change feed, streams, sources and the pipeline."""

import gzip
import json
from datetime import UTC, datetime

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from lakeloom import pipeline
from lakeloom.functions import files as small
from lakeloom.functions import inference
from lakeloom.operators.reconcile import same_rows
from lakeloom.ops import retry, tracking
from lakeloom.plans import drivers
from lakeloom.sources import files, rest
from lakeloom.storage import places
from lakeloom.storage import table as table_module
from lakeloom.storage.feed import apply_changes
from lakeloom.storage.table import AmbiguousMerge, ConflictError, ConstraintViolation, SchemaMismatch, Table, retry_on_conflict
from lakeloom.streaming import windows


def rows(spark, *r):
    return spark.createDataFrame(list(r), "id int, v string")


@pytest.fixture
def table(spark, tmp_path):
    t = Table(spark, str(tmp_path / "t"))
    t.create("id int, v string", properties={"change_feed": "true"})
    t.append(rows(spark, (1, "a"), (2, "b"), (3, "c")))
    return t


def content(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_merge_counts_and_does_nothing_twice(spark, table):
    source = rows(spark, (2, "B"), (3, "c"), (4, "d"))
    clauses = {"update_if": "not (s.v <=> t.v)"}
    assert table.merge(source, ["id"], **clauses) == {"inserted": 1, "updated": 1, "deleted": 0}
    version = table.version()
    assert table.merge(source, ["id"], **clauses) == {"inserted": 0, "updated": 0, "deleted": 0} and table.version() == version and table.metrics_since(version)["inserted"] == 0
    assert content(table.read()) == [(1, "a"), (2, "B"), (3, "c"), (4, "d")]
    changes = table.read_changes(version)
    assert sorted((r["id"], r["v"], r["_change_type"]) for r in changes.collect()) == [(2, "B", "update_postimage"), (2, "b", "update_preimage"), (4, "d", "insert")]
    with pytest.raises(AmbiguousMerge):
        table.merge(rows(spark, (1, "x"), (1, "y")), ["id"])
    assert table.merge(rows(spark, (None, "n")), ["id"], null_safe=True)["inserted"] == 1 and table.merge(rows(spark, (None, "m")), ["id"], null_safe=True)["updated"] == 1
    assert table.merge(rows(spark, (1, "")), ["id"], update_if=None, delete_if="s.v = ''", insert_if=None)["deleted"] == 1 and table.count() == 4


def test_time_travel_dml_restore_and_vacuum(spark, table):
    assert table.delete("id = 1 or v is null") == {"deleted": 1} and table.delete("id = 77") == {"deleted": 0}
    assert table.update({"v": "upper(v)"}, "id = 2") == {"updated": 1}
    assert content(table.read()) == [(2, "B"), (3, "c")] and content(table.read(version=1)) == [(1, "a"), (2, "b"), (3, "c")]
    assert content(table.read(timestamp=datetime.now(UTC))) == content(table.read())
    table.restore(1)
    assert table.count() == 3 and [r["operation"] for r in table.history().collect()] == ["CREATE", "APPEND", "DELETE", "UPDATE", "RESTORE"]
    assert table.detail().first()["rows"] == 3 and table.summaries(1)[0].operation == "RESTORE"
    assert table.count_in_all_files("v", "B") == 2  # a data file and the change feed
    table.erase("id = 3")
    assert table.count_in_all_files("v", "B") == 0 and table.count_in_all_files("id", "3") == 0 and content(table.read()) == [(1, "a"), (2, "b")]


def test_schema_constraints_generated_and_identity_columns(spark, tmp_path, table):
    with pytest.raises(SchemaMismatch):
        table.append(rows(spark, (4, "d")).withColumn("x", F.lit(1)))
    with pytest.raises(SchemaMismatch):
        table.append(spark.createDataFrame([("x", "y")], "id string, v string"))
    table.append(rows(spark, (4, "d")).withColumn("x", F.lit(1)), merge_schema=True)
    table.append(spark.createDataFrame([(5,)], "id int"))
    assert table.read().filter("x is null").count() == 4
    with pytest.raises(ConstraintViolation):
        table.add_constraint("few", "id < 5")
    table.add_constraint("many", "id < 50")
    with pytest.raises(ConstraintViolation):
        table.append(spark.createDataFrame([(99,)], "id int"))
    table.rename_column("v", "w")
    table.drop_column("x")
    table.add_column("x", "string")
    table.widen_column("id", "bigint")
    table.append(spark.createDataFrame([(6, "f", "new")], "id bigint, w string, x string"))
    assert [tuple(r) for r in table.read().filter("id in (1, 6)").orderBy("id").collect()] == [(1, "a", None), (6, "f", "new")] and table.schema()["id"].dataType.simpleString() == "bigint"
    g = Table(spark, str(tmp_path / "g"))
    g.create("at timestamp, d date, sk bigint", ["d"], generated={"d": ("date", "at")}, identity="sk")
    for day in ("2024-01-01 10:00:00", "2024-01-02 11:00:00"):
        g.append(spark.createDataFrame([(day,), (day,)], "at string").withColumn("at", F.col("at").cast("timestamp")))
    assert sorted(r["sk"] for r in g.read().collect()) == [1, 2, 3, 4]
    assert len(g.pruned(g.state(), [("d", "=", "2024-01-01")])) < len(g.active_files()) and g.read(where=[("d", "=", "2024-01-01")]).count() == 2
    assert table.classify({"id": "internal", "zz": "x"}) == ["id"] and table.classification() == {"id": "internal"}


def test_transactions_conflicts_and_maintenance(spark, table):
    assert table.append(rows(spark, (9, "z")), txn=("app", 1)) == {"inserted": 1} and table.append(rows(spark, (9, "z")), txn=("app", 1)) == {"inserted": 0}
    stale = table.state()
    table.delete("id = 9")
    with pytest.raises(ConflictError):
        table._commit(stale, "DELETE", [], list(stale["files"]))
    tried = []
    with pytest.raises(ConflictError):
        retry_on_conflict(lambda: tried.append(1) or (_ for _ in ()).throw(ConflictError()), attempts=3, sleep=lambda s: None)
    assert len(tried) == 3
    before = table.read().collect()
    table.compact(1, zorder_by=["id"])
    assert sorted(table.read().collect()) == sorted(before) and len(table.active_files()) == 1 and not table.summaries(1)[0].data_change
    for i in range(12):
        table.append(rows(spark, (100 + i, "x")))
    assert table.count() == len(before) + 12 and any(n.endswith(".checkpoint") for n in table.log.names("_log"))
    assert table.replace_where(rows(spark, (100, "new")), "id >= 100")["rows_written"] >= 1 and table.read().filter("id >= 100").count() == 1
    with pytest.raises(ConstraintViolation):
        table.replace_where(rows(spark, (1, "new")), "id >= 100")
    table.overwrite(spark.createDataFrame([(1.5,)], "z double"), schema_too=True)
    assert table.read().columns == ["z"]


def test_feed_consumer_runs_again(spark, table, tmp_path):
    replica, state = str(tmp_path / "r"), tmp_path / "state.json"
    assert apply_changes(spark, table.path, replica, "id", state).changes == 3
    table.merge(rows(spark, (1, "A"), (7, "g")), ["id"])
    table.delete("id = 2")
    assert apply_changes(spark, table.path, replica, "id", state).metrics["deleted"] == 1 and same_rows(Table(spark, replica).read(), table.read())
    assert apply_changes(spark, table.path, replica, "id", state).skipped
    state.unlink()
    apply_changes(spark, table.path, replica, "id", state)
    assert same_rows(Table(spark, replica).read(), table.read())


def test_late_rows_are_dropped_in_the_next_run_and_replays_change_nothing(spark, tmp_path):
    schema, landing = "t timestamp, k string", tmp_path / "in"
    put = lambda n, *r: spark.createDataFrame(list(r), "t string, k string").withColumn("t", F.col("t").cast("timestamp")).coalesce(1).write.parquet(str(landing / n))
    out, seen = str(tmp_path / "out"), []
    sink = windows.merge_sink(out, ["window_start", "k"], "q", on_batch=lambda n, m: seen.append(m))
    put("a", ("2024-01-01 00:00:10", "x"), ("2024-01-01 00:05:00", "x"))
    run = lambda: windows.drain(windows.counts_per_window(spark.readStream.schema(schema).option("recursiveFileLookup", True).parquet(str(landing)), "t", by=["k"]), str(tmp_path / "cp"), sink, "update")
    run()
    put("b", ("2024-01-01 00:00:20", "x"), ("2024-01-01 00:04:40", "x"))
    q = run()
    assert {(r["window_start"].minute, r["events"]) for r in Table(spark, out).read().collect()} == {(0, 1), (5, 1), (4, 1)}
    assert sum(windows.progress_summary(p)["late_rows"] for p in q.recentProgress) == 1
    before = Table(spark, out).version()
    batch = Table(spark, out).read()
    sink(batch, 0)
    assert Table(spark, out).version() == before


def event(i, kind="PushEvent", repo="o/r", at="2024-01-01T10:00:00Z", **payload):
    return {"id": str(i), "type": kind, "actor": {"id": i % 3, "login": "bot[bot]" if i % 3 else "ann"}, "repo": {"id": 5, "name": repo}, "payload": json.dumps(payload), "public": True, "created_at": at}


def test_pipeline_runs_twice_with_equal_results(spark, tmp_path):
    s = tracking.Settings(data_root=str(tmp_path))
    landing = tmp_path / "landing" / "events"
    landing.mkdir(parents=True)
    lines = [event(1), event(1), event(2, "IssuesEvent", action="opened", issue={"number": 3}), event(3, repo="o/new", at="2024-01-02T00:00:00Z")]
    with gzip.open(landing / "h.json.gz", "wt") as f:
        f.write("\n".join(json.dumps(x) for x in lines) + '\n{"id": "9", "trunc\n')
    for name, step in pipeline.STEPS.items():
        step(spark, s)
    silver = Table(spark, s.path("silver", "events"))
    assert silver.count() == 3 and Table(spark, s.path("quarantine", "events")).count() == 1
    assert [(r["repo_name"], r["is_current"]) for r in Table(spark, s.path("silver", "repo_history")).read().orderBy("valid_from").collect()] == [("o/r", False), ("o/new", True)]
    fact = Table(spark, s.path("gold", "fct_events")).read()
    assert fact.count() == 3 and fact.filter("sk = -1").count() == 0 and Table(spark, s.path("gold", "fct_repo_daily")).read().agg(F.sum("issues_opened")).first()[0] == 1
    version = silver.version()
    assert pipeline.run_bronze(spark, s)["rows_written"] == 0 and pipeline.run_silver(spark, s)["rows_written"] == 0 and silver.version() == version


def test_sources(spark, tmp_path):
    (tmp_path / "bad.json").write_text('{"a": 1}\n{"a": \n')
    good, bad = files.split_corrupt(files.json_records(spark, str(tmp_path / "bad.json"), spark.createDataFrame([(1,)], "a int").schema).cache())
    assert good.count() == 1 and bad.first()[0] == '{"a": '
    assert [r["key"] for r in files.hour_keys(spark, "2024-01-01 08:00:00", "2024-01-01 10:00:00").collect()] == ["2024-01-01-8", "2024-01-01-9", "2024-01-01-10"]
    run = tmp_path / "repos" / "run=1"
    run.mkdir(parents=True)
    for n, (status, at, stars) in enumerate([(200, "2024-01-01T00:00:00Z", 1), (200, "2024-01-02T00:00:00Z", 2), (404, "2024-01-03T00:00:00Z", 9)]):
        (run / f"{n}.json").write_text(json.dumps({"_status": status, "_fetched_at": at, "data": {"id": 7, "stargazers_count": stars}}))
    assert [r["stars"] for r in files.repos_from_landing(spark, str(tmp_path)).collect()] == [2]
    assert list(small.json_lines(tmp_path / "bad.json", "skip", found := [])) == [{"a": 1}] and found == [2]
    with pytest.raises(small.BadLine):
        list(small.json_lines(tmp_path / "bad.json"))
    with pytest.raises(RuntimeError), small.atomic_write(tmp_path / "x") as f:
        f.write("half")
        raise RuntimeError
    assert not (tmp_path / "x").exists() and small.next_version("1.2.3", ["feat: x", "fix: y"]) == "1.3.0" and small.next_version("1.2.3", ["feat!: x"]) == "2.0.0"


class Scripted:
    def __init__(self, *responses):
        self.responses, self.asked = list(responses), []

    def get(self, url, headers):
        self.asked.append((url, dict(headers)))
        status, head, body = self.responses.pop(0)
        return rest.Response(url, status, head, json.dumps(body))


def test_api_client_waits_retries_pages_and_moves_its_watermark_last(tmp_path):
    slept = []
    issues = [{"updated_at": "2024-01-02T00:00:00Z"}, {"updated_at": "2024-01-03T00:00:00Z"}]
    t = Scripted((429, {"Retry-After": "3"}, {}), (200, {"Link": '<http://h/p2>; rel="next"', "ETag": "e"}, issues[:1]), (502, {}, {}), (200, {}, issues[1:]))
    client = rest.ApiClient("http://h", t, sleep=slept.append)
    marks = small.WatermarkStore(tmp_path / "m.json")
    got = rest.fetch_issues(client, "o/r", tmp_path, marks, "1", "2023-01-01T00:00:00Z")
    assert (got.pages, got.items, marks.get("o/r")) == (2, 2, "2024-01-03T00:00:00Z") and slept[0] == 3.0
    gone = rest.fetch_repos(rest.ApiClient("http://h", Scripted((404, {}, {}))), ["a/b"], tmp_path, "1")
    assert gone.missing == ["a/b"] and rest.canonical_url("http://h/x?b=1#f", {"a": 2, "c": None}) == "http://h/x?a=2&b=1"
    with pytest.raises(rest.RateLimitExceeded):
        rest.ApiClient("http://h", Scripted((403, {"x-ratelimit-remaining": "0", "x-ratelimit-reset": "99999999999"}, {}))).get("x")
    tape = rest.Cassette(tmp_path / "c", Scripted((200, {}, [1])))
    assert tape.get("http://h/y", {}).json() == [1] and rest.Cassette(tmp_path / "c").get("http://h/y", {}).json() == [1]
    with pytest.raises(rest.CassetteMiss):
        rest.Cassette(tmp_path / "c").get("http://h/z", {})


def test_capture_resumes_and_skips_canaries(tmp_path):
    asked = []

    def connect(last):
        asked.append(last)
        if len(asked) == 1:
            def broken():
                yield from ["id: 1", 'data: {"meta": {"domain": "d"}, "id": 1, "junk": 2}', "", ": note", "id: 2", 'data: {"meta": {"domain": "canary"}}', ""]
                raise ConnectionError
            return broken()
        return ["id: 3", "data: {", 'data: "id": 3}']

    out = rest.capture(connect, tmp_path / "o", tmp_path / "s.json", sleep=lambda s: None)
    assert (out.events, out.canaries, out.reconnects, out.last_id) == (2, 1, 1, "3") and asked == [None, "2"]
    assert sorted(r["id"] for r in small.json_lines_many(sorted((tmp_path / "o").glob("*.gz")))) == [1, 3]


def test_tracking_and_helpers(spark, tmp_path):
    sink = tracking.MemorySink()
    with tracking.track_step("p", "s", sink, spark) as run:
        run.rows_written = 3
    with pytest.raises(KeyError), tracking.track_step("p", "s", sink):
        raise KeyError("x")
    assert [r.status for r in sink.runs] == ["ok", "failed"]
    tracking.TableSink(spark, str(tmp_path / "runs")).write(sink.runs[0])
    assert Table(spark, str(tmp_path / "runs")).read().first()["rows_written"] == 3
    assert tracking.grep_plan(spark.range(5).groupBy("id").count(), "HashAggregate") and [tracking.parse_metric(x) for x in ("1,234", "2.5 KiB", "10 ms", "?")] == [1234, 2560, 0.01, None]
    assert tracking.estimate_cost(2, 3, 1.5, 0.2, 1).total == pytest.approx(7.8)
    s = retry.spread([1, 2, 3, 4, 100])
    assert (s.median, s.p95, s.most_over_median) == (3, 100, 100 / 3)
    calls = []

    @retry.retry((ValueError,), attempts=3, sleep=lambda s: None)
    def flaky():
        calls.append(1)
        if len(calls) < 3:
            raise ValueError
        return "ok"

    assert flaky() == "ok" and retry.time_it(lambda: None, 3, "x").best >= 0


def test_batched_inference_is_cached_and_aligned(spark, tmp_path):
    class Echo:
        def complete(self, request):
            return {"answers": [{"i": i, "label": "a"} for i in request["ids"]]}

    df = spark.createDataFrame([(i, i // 4) for i in range(10)], "i int, b int")
    ask = lambda rows: {"ids": [r["i"] for r in rows]}
    answer = lambda response, rows: response["answers"]
    assert inference.infer(df, "b", "i", ask, answer, Echo, "i int, label string").count() == 10
    cache = inference.CachedClient(tmp_path / "c.jsonl", Echo())
    cache.complete({"ids": [1]})
    assert inference.CachedClient(tmp_path / "c.jsonl").complete({"ids": [1]})["answers"]
    with pytest.raises(inference.CacheMiss):
        inference.CachedClient(tmp_path / "c.jsonl").complete({"ids": [2]})
    assert inference.aligned(3, [{"i": 1, "label": "a"}, {"i": 9, "label": "a"}, {"i": 2, "label": "zz"}], ["a"]) == [None, "a", None]
    now = [0.0]
    bucket = inference.TokenBucket(2, 1, lambda: now[0], lambda s: now.__setitem__(0, now[0] + s))
    assert [bucket.take() for _ in range(3)] == [0.0, 0.5, 0.5]


def test_a_stream_over_a_table_gives_committed_rows_only(spark, tmp_path):
    t = Table(spark, str(tmp_path / "t"))
    t.create("id int, v string", properties={"change_feed": "true"})
    t.append(rows(spark, (1, "a"), (2, "b")))
    t._write(rows(spark, (7, "lost")), t.state())  # a writer that died before its commit
    t.compact()
    t.update({"v": "'c'"}, "id = 1")
    t.append(rows(spark, (3, "d")))
    got = []
    with pytest.raises(Exception, match="changed rows"):
        windows.drain(windows.table_stream(spark, t.path), str(tmp_path / "c0"), lambda df, n: got.append(df.count()))
    read = lambda df, n: got.extend(r["id"] for r in df.collect())
    got.clear()
    windows.drain(windows.table_stream(spark, t.path, skip_changes=True).transform(lambda df: df.filter("id < 3")), str(tmp_path / "c"), read)
    assert sorted(got) == [1, 2]
    t.append(rows(spark, (2, "e")))
    windows.drain(windows.table_stream(spark, t.path, skip_changes=True), str(tmp_path / "c"), read)
    assert sorted(got) == [1, 2, 2]


def test_pruning_with_nan_and_time_zones(spark, tmp_path):
    t = Table(spark, str(tmp_path / "n"))
    t.append(spark.createDataFrame([(1.0,), (float("nan"),)], "x double").coalesce(1))
    assert t.read(where=[("x", "=", 1.0)]).count() == 1 and t.read(where=[("x", ">", 5.0)]).count() == 1
    assert t.merge(spark.createDataFrame([(1.0,)], "x double"), ["x"], update_if=None)["inserted"] == 0
    z = Table(spark, str(tmp_path / "z"))
    z.create("at timestamp, n timestamp_ntz, d date", generated={"d": ("date", "at")})
    z.append(spark.sql("select timestamp'2024-01-01 23:30:00 UTC' as at, timestamp_ntz'2024-01-01 23:30:00' as n"))
    try:
        for zone in ("Asia/Tokyo", "America/Los_Angeles", "UTC"):
            spark.conf.set("spark.sql.session.timeZone", zone)
            at = z.read().select(F.col("at").cast("string")).first()[0]
            assert z.read(where=[("at", "=", at)]).count() == 1 and z.read(where=[("n", "=", "2024-01-01 23:30:00")]).count() == 1
            assert z.pruned(z.state(), [("at", "<", "2023-12-30")]) == [] and z.delete("at < timestamp'2023-12-30'") == {"deleted": 0}
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_one_transaction_commits_once_for_racing_writers(spark, tmp_path):
    t, slow = Table(spark, str(tmp_path / "r")), Table(spark, str(tmp_path / "r"))
    t.create("id int, v string")
    late = slow._commit

    def overtaken(*args, **kw):
        t.append(rows(spark, (1, "a")), txn=("app", 5))
        return late(*args, **kw)

    slow._commit = overtaken
    assert slow.append(rows(spark, (1, "a")), txn=("app", 5)) == {"inserted": 0}
    assert content(t.read()) == [(1, "a")] and t.state()["txn"] == {"app": 5}


def test_changes_read_only_files_that_statistics_leave(spark, tmp_path, monkeypatch):
    t = Table(spark, str(tmp_path / "p"))
    for i in range(4):
        t.append(rows(spark, (i, "a"), (i + 10, "b")))
    looked = []
    real = Table._with_file
    monkeypatch.setattr(Table, "_with_file", lambda self, state: looked.append(len(state["files"])) or real(self, state))
    assert t.delete("id >= 13 and v = 'b'") == {"deleted": 1} and t.update({"v": "'z'"}, "id = 0 or id = 1") == {"updated": 2}
    assert looked[0] == 1 < looked[1] and t.count() == 7


def test_names_in_the_log_appear_whole(spark, tmp_path):
    t = Table(spark, str(tmp_path / "l"))
    t.create("id int")
    t.log.local, t.log.root = False, f"file://{tmp_path / 'l'}"  # the way of other stores
    t.append(spark.createDataFrame([(1,)], "id int"))
    with pytest.raises(FileExistsError):
        t.log.create(f"_log/{1:020d}.json", "{}")
    assert t.read().count() == 1 and not [n for n in t.log.names("_log") if n.endswith(".tmp")]


def test_statistics_of_new_files_sort_no_rows(spark, tmp_path, monkeypatch):
    plans = []
    real = type(spark.range(1)).collect
    monkeypatch.setattr(type(spark.range(1)), "collect", lambda self: plans.append(self._jdf.queryExecution().executedPlan().toString()) or real(self))
    t = Table(spark, str(tmp_path / "s"))
    t.append(rows(spark, (2, "b"), (1, "a"), (3, None)).coalesce(1))
    found = [p for p in plans if "file_path" in p]
    assert found and not any("Sort" in p for p in found)
    f = t.active_files()[0]
    assert (f["rows"], f["stats"]["v"]["min"], f["stats"]["v"]["max"], f["stats"]["v"]["nulls"], f["stats"]["id"]["min"]) == (3, "a", "b", 1, "1")


@pytest.mark.parametrize("how", [{"cluster_by": ["id"]}, {"zorder_by": ["id"]}])
def test_compacted_files_are_in_order_without_a_task_that_sorts_a_whole_one(spark, tmp_path, monkeypatch, how):
    monkeypatch.setattr(table_module, "SORT_ROWS", 100)
    t = Table(spark, str(tmp_path / "o"))
    t.append(spark.range(1000).select(((F.col("id") * 7919) % 1000).cast("int").alias("id"), F.lit("a").alias("v")).repartition(3))
    sorted_rows = []
    real = Table._in_order
    monkeypatch.setattr(Table, "_in_order", lambda self, *a: (df := real(self, *a), sorted_rows.append(df._jdf.queryExecution().optimizedPlan().toString()))[0])
    t.compact(2, **how)
    assert sorted_rows and "Sort" not in sorted_rows[0]  # the sorts were done before, in ranges of a hundred rows
    parts = [[r["id"] for r in t.rows_of([f["path"]]).coalesce(1).collect()] for f in t.active_files()]
    assert len(parts) == 2 and all(p == sorted(p) for p in parts) and sorted(parts[0] + parts[1]) == list(range(1000))
    assert max(map(len, parts)) < 800 and (max(parts[0]) < min(parts[1]) or max(parts[1]) < min(parts[0]))
    assert not [p for p in t.log.files("_staging") if p.endswith(".parquet")]


def test_places_of_keys_that_no_task_sorts_alone(spark, tmp_path):
    df = spark.range(3000).select(F.when(F.col("id") % 3 == 0, None).otherwise(F.when(F.col("id") % 100 == 1, "a").otherwise("b")).alias("k"), ((F.col("id") * 7919) % 50).alias("q"), "id").repartition(5)
    got = places.numbered(df, ["k"], ["q", "id"], str(tmp_path / "f"), "place", rows=200)
    want = df.withColumn("place", F.row_number().over(Window.partitionBy("k").orderBy("q", "id")).cast("bigint"))
    assert content(got) == content(want) and len(list((tmp_path / "f").glob("*.parquet"))) == 15
    assert max(r["count"] for r in spark.read.parquet(str(tmp_path / "f")).groupBy(F.input_file_name()).count().collect()) < 500
    none = places.numbered(df.filter("false"), ["k"], ["q", "id"], str(tmp_path / "e"), "place")
    assert none.columns == want.columns and none.count() == 0


def test_a_stream_is_captured_by_tasks_in_shards(spark, monkeypatch):
    monkeypatch.setattr(drivers.rest, "capture", None)  # the driver's; workers have their own
    monkeypatch.setattr(drivers, "SHARD_EVENTS", 300)
    path = "/root/testdata/sf0.001"
    got = drivers.captured_events(spark, path)
    want = spark.read.parquet(f"{path}/events.parquet").select(F.col("event_id").cast("string").alias("id"), F.col("event_type").alias("type"))
    assert want.count() > 900 and content(got) == content(want)
