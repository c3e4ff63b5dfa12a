"""Boundary cases of the operators, on small frames with exact results."""

import hashlib
import hmac
import random
from datetime import UTC, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from lakeloom.functions import metrics, titles
from lakeloom.operators import history, joins, privacy, profile, quality, reconcile, star, timeline


def versions(spark, rows, existing=None):
    df = spark.createDataFrame(rows, "k int, name string, at string")
    out = history.scd2_history(df, ["k"], ["name"], "at", existing)
    return out, [(r["name"], r["valid_from"], r["valid_to"], r["is_current"]) for r in out.orderBy("k", "valid_from").collect()]


def test_history_merges_repeats_and_fits_late_data_in(spark):
    first, got = versions(spark, [(1, "a", "1"), (1, "a", "2"), (1, "b", "5"), (None, "x", "1"), (1, "z", None)])
    assert got == [("a", "1", "5", False), ("b", "5", None, True)]
    late, got = versions(spark, [(1, "c", "3")], first)
    assert got == [("a", "1", "3", False), ("c", "3", "5", False), ("b", "5", None, True)]
    assert versions(spark, [(1, "c", "3")], late)[1] == got
    assert versions(spark, [(1, "b", "4")], first)[1] == [("a", "1", "4", False), ("b", "4", None, True)]
    assert versions(spark, [(1, "n", "5")], first)[1][-1] == ("n", "5", None, True)


def test_as_of_is_half_open_and_keeps_the_grain(spark):
    h = versions(spark, [(1, "a", "1"), (1, "b", "5")])[0]
    facts = spark.createDataFrame([(1, "0"), (1, "1"), (1, "4"), (1, "5"), (2, "5"), (None, "5")], "k int, t string")
    got = history.as_of_join(facts, h.withColumnRenamed("name", "n"), ["k"], "t", ["n"], {"n": "?"})
    assert sorted((r["t"], r["n"]) for r in got.collect()) == [("0", "?"), ("1", "a"), ("4", "a"), ("5", "?"), ("5", "?"), ("5", "b")]
    changes = spark.createDataFrame([(1, "1", "a"), (1, "5", None)], "k int, at string, plan string")
    assert sorted((r["t"], r["plan"]) for r in history.as_of_latest(facts.filter("k = 1"), changes, ["k"], "t", "at", "plan").collect()) == [("0", None), ("1", "a"), ("4", "a"), ("5", None)]
    assert history.scd2_as_of(h, F.lit("5")).first()["name"] == "b"


def test_changes_of_a_key_and_tombstones(spark):
    rows = [(1, "a", "insert", 1), (1, "b", "update_preimage", 2), (1, "c", "update_postimage", 2), (2, "x", "delete", 3), (2, "y", "insert", 3), (3, "q", "insert", 1), (3, "q", "delete", 2)]
    got = history.last_change_per_key(spark.createDataFrame(rows, "id int, v string, _change_type string, _commit_version int"), "id")
    assert {r["id"]: (r["v"], r["_change_type"]) for r in got.collect()} == {1: ("c", "update_postimage"), 2: ("y", "insert"), 3: ("q", "delete")}
    change = lambda *r: spark.createDataFrame(list(r), "op string, id int, v string, lsn int")
    start = change(("I", 0, "", 0)).filter("false").drop("op").withColumn("deleted", F.lit(False))
    one = history.cdc_reduce(start, change(("I", 1, "a", 1), ("D", 1, None, 5), ("I", 2, "b", 2)), "id")
    two = history.cdc_reduce(one, change(("U", 1, "late", 3), ("U", 2, "c", 4), ("U", 2, "old", 1)), "id")
    assert [(r["id"], r["v"]) for r in two.filter("not deleted").collect()] == [(2, "c")]


def test_sessions_and_streaks_at_their_edges(spark):
    t = lambda m: f"2024-01-01 00:{m:02d}:00"
    df = spark.createDataFrame([("u", t(0)), ("u", t(30)), ("u", "2024-01-01 01:01:00")], "u string, t string").withColumn("t", F.col("t").cast("timestamp"))
    assert [r["session_number"] for r in timeline.sessionize(df, "u", "t").orderBy("t").collect()] == [1, 1, 2]
    days = spark.createDataFrame([("a", d) for d in ("2024-01-01", "2024-01-01", "2024-01-02", "2024-01-04")], "u string, d string").withColumn("d", F.to_date("d"))
    assert sorted((str(r["start"]), r["days"]) for r in timeline.streaks(days, "u", "d").collect()) == [("2024-01-01", 2), ("2024-01-04", 1)]
    spans = spark.createDataFrame([(1, 1, 3), (1, 3, 5), (1, 7, 8), (1, 2, 2)], "k int, a int, b int")
    assert sorted((r["a"], r["b"]) for r in timeline.merge_intervals(spans, ["k"], "a", "b").collect()) == [(1, 5), (7, 8)]


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_salted_join_equals_the_plain_one(spark, how):
    big = spark.createDataFrame([("hot", i) for i in range(50)] + [("x", 1), ("none", 2), (None, 3)], "k string, v int")
    small = spark.createDataFrame([("hot", "a"), ("hot", "b"), ("x", "c"), ("other", "d")], "k string, label string")
    assert reconcile.same_rows(joins.salted_join(big, small, "k", ["hot"], 4, how), big.join(small, "k", how))
    for bad in ((1, "inner"), (4, "full")):
        with pytest.raises(ValueError):
            joins.salted_join(big, small, "k", ["hot"], *bad)


def test_reconcile_with_null_keys(spark):
    a = spark.createDataFrame([(1, "p", 1), (2, "p", 2), (None, "q", 3), (4, None, 4)], "k int, p string, v int")
    b = spark.createDataFrame([(1, "p", 9), (None, "q", 3), (4, None, 4), (4, None, 4), (5, "r", 5)], "k int, p string, v int")
    assert {r["p"] for r in reconcile.divergent(a, b, "p", ["k", "v"]).collect()} == {"p", None, "r"}
    assert {(r["k"], r["status"]) for r in reconcile.compare_keys(a, b, "k", ["v"]).collect()} == {(1, "changed"), (2, "missing"), (4, "duplicated"), (5, "extra")}


def test_expectations(spark):
    df = spark.createDataFrame([(1, "a"), (None, "b"), (3, None)], "id int, t string")
    E = quality.Expectation
    r = quality.apply_expectations(df, [E("t_known", "t in ('a')", "warn"), E("id", "id > 0", "drop")])
    assert {m["rule"]: m["failed"] for m in r.metrics} == {"t_known": 2, "id": 1} and r.valid.count() == 2 and r.metrics_df().count() == 2
    assert r.quarantine.first()["_dq_failed_rules"] == ["t_known", "id"]
    with pytest.raises(quality.ExpectationFailed) as e:
        quality.apply_expectations(df, [E("id", "id > 0", "fail")])
    assert e.value.failures == {"id": 1}
    with pytest.raises(ValueError):
        quality.apply_expectations(df, [E("x", "true"), E("x", "true")])
    assert quality.apply_expectations(df.filter("false"), [E("x", "id > 0", "fail")]).valid.count() == 0


def test_contracts_freshness_and_volume(spark, tmp_path):
    path = tmp_path / "c.yaml"
    path.write_text("{name: t, version: '1', owner: o, grain: row, primary_key: [id], columns: [{name: id, type: int, nullable: false}, {name: v, type: string}], freshness: {column: at, max_delay_hours: 2}}")
    contract = quality.load_contract(path)
    quality.enforce_contract(spark.createDataFrame([(1, "a")], "id int, v string"), contract)
    with pytest.raises(quality.ContractViolation) as e:
        quality.enforce_contract(spark.createDataFrame([(1, "a")], "id bigint, w string"), contract)
    assert len(e.value.problems) == 3
    assert len(quality.data_problems(spark.createDataFrame([(1, "a"), (1, "b"), (None, "c")], "id int, v string"), contract)) == 3
    at = spark.createDataFrame([("2024-01-01 10:00:00",), (None,)], "at string").withColumn("at", F.col("at").cast("timestamp"))
    assert quality.check_freshness(at, "at", 2, datetime(2024, 1, 1, 12)).ok and not quality.check_freshness(at, "at", 2, datetime(2024, 1, 1, 12, 1, tzinfo=UTC)).ok
    assert not quality.check_freshness(at.filter("false"), "at", 2, datetime(2024, 1, 1)).ok
    z = {r["label"]: r for r in quality.volume_anomalies({"a": 10, "b": 10, "c": 10, "d": 1})}
    assert z["d"]["anomaly"] and not z["a"]["anomaly"]
    with pytest.raises(ValueError):
        quality.volume_anomalies({"a": 1, "b": 2})
    checks = [quality.check_age(datetime(2024, 1, 1), datetime(2024, 1, 2), timedelta(hours=1)), quality.check_volume(10, []), quality.check_volume(4, [10, 10])]
    said = []
    assert [c.ok for c in checks] == [False, True, False] and len(quality.raise_alerts(checks, said.append)) == 2 and said[0].startswith("page")


def test_rules_let_nulls_pass_and_are_approved_one_by_one(spark):
    R = quality.Rule
    rules = [R(name="n", column="s", kind="not_null"), R(name="u", column="i", kind="unique"), R(name="a", column="s", kind="accepted_values", values=["x"]), R(name="r", column="i", kind="range", least=2), R(name="m", column="s", kind="max_length", most=1), R(name="p", column="s", kind="regex", pattern="^x")]
    df = spark.createDataFrame([(1, "x"), (1, None), (3, "yy"), (None, "x")], "i int, s string")
    assert {r["rule"]: r["failed"] for r in quality.run_rules(df, rules).collect()} == {"n": 1, "u": 2, "a": 1, "r": 2, "m": 1, "p": 1}
    for bad in (R(name="b", column="zz", kind="not_null"), R(name="b", column="s", kind="range", least=1), R(name="b", column="s", kind="regex", pattern="("), R(name="b", column="s", kind="accepted_values")):
        with pytest.raises(quality.InvalidRule):
            quality.compile_rule(bad, dict(df.dtypes))
    done = quality.review_rules([*rules[:2], R(name="b", column="s", kind="range", least=1)], {"n": quality.Decision(True), "b": quality.Decision(True)}, dict(df.dtypes), "me")
    assert [r.name for r in done.approved] == ["n"] and [a["outcome"] for a in done.audit] == ["approved", "rejected", "invalid"]


def test_privacy(spark):
    df = spark.createDataFrame([("ana.silva@example.com", "123.456.789-09"), ("no address", "12"), (None, None), ("Ab3@x.io", "52998224725")], "m string, c string")
    for key in (b"k", b"long" * 40):
        got = df.select("m", privacy.hmac_sha256("m", key).alias("h"), F.expr(privacy.hmac_sql("m", key)).alias("s")).collect()
        assert all(r["h"] == r["s"] == (r["m"] and hmac.new(key, r["m"].encode(), hashlib.sha256).hexdigest()) for r in got)
    rows = df.select(privacy.mask_email("m"), privacy.mask_cpf("c"), privacy.mask_partial("m"), privacy.mask_format("m"), privacy.cpf_valid("c")).collect()
    assert [tuple(r)[:2] for r in rows] == [("a***@example.com", "***.456.789-**"), ("***", "***"), (None, None), ("A***@x.io", "***.982.247-**")]
    assert rows[3][2] == "******io" and rows[3][3] == "Xx9@x.xx" == privacy.mask_format_python("Ab3@x.io") and [r[4] for r in rows] == [True, False, False, True]
    assert spark.createDataFrame([(privacy.cpf_fake(random.Random(i)),) for i in range(20)], "c string").filter(privacy.cpf_valid("c")).count() == 20
    text = spark.createDataFrame([("mail a.b@c.com, 10.0.0.1, 123.456.789-09, (11) 91234-5678 and @bob",)], "t string").select(privacy.scrub("t")).first()[0]
    assert text == "mail <EMAIL>, <IP>, <CPF>, (<TELEFONE> and <USUARIO>" or text == "mail <EMAIL>, <IP>, <CPF>, <TELEFONE> and <USUARIO>"
    keys = privacy.subject_keys(df, "m").persist()
    locked = df.join(keys, "m").withColumn("x", privacy.encrypt("c", "key_hex")).persist()
    assert locked.filter(privacy.decrypt("x", "key_hex") == F.col("c")).count() == 3
    assert locked.filter(privacy.decrypt("x", F.lit("00" * 32)).isNull()).count() == 3
    vault = privacy.token_vault(df, "m").persist()
    assert vault.count() == 3 and privacy.tokenize(df, "m", vault).filter("m like 'tok%'").count() == 3


def test_policies(spark):
    P, L = privacy.ColumnPolicy, privacy.Level
    df = spark.createDataFrame([(1, "bob", "x", "secret")], "id int, login string, kind string, extra string")
    policy = [P("id", L.INTERNAL, False), P("login", L.RESTRICTED, True, "format"), P("kind", L.PUBLIC, False, "drop")]
    assert privacy.apply_policy(df, policy, "analyst", b"k").collect() == [(1, "xxx")] and privacy.apply_policy(df, policy, "owner", b"k").columns == df.columns
    with pytest.raises(ValueError):
        privacy.apply_policy(df, [P("id", L.PUBLIC, False, "token")], "analyst", b"k")
    df.createOrReplaceTempView("src_policy")
    spark.sql("declare or replace variable role string default 'analyst'")
    spark.sql(privacy.dynamic_view_sql("v_policy", "src_policy", policy, b"k"))
    assert tuple(spark.table("v_policy").first()) == (1, "xxx", None)
    spark.sql("set var role = 'owner'")
    assert tuple(spark.table("v_policy").first()) == (1, "bob", "x")
    assert privacy.personal_columns(policy) == ["login"] and len(privacy.tag_sql("t", policy)) == 3


def test_profiles_and_schema_changes(spark):
    df = spark.createDataFrame([(1, "Ana"), (2, "Bob"), (2, None)], "i int, s string")
    for approximate in (False, True):
        i, s = profile.profile(df, personal=["s"], approximate=approximate)
        assert (i["distinct"], i["min"], i["max"], i["top"]) == (2, "1", "2", [("2", 2), ("1", 1)]) and (s["nulls"], s["min"], s["max_length"]) == (1, "Xxx", 3)
    assert tuple(profile.k_anonymity(df.filter("false"), ["i"]).first()) == (0, 0, 0, 0) and tuple(profile.k_anonymity(df, ["i"]).first()) == (1, 2, 1, 3)
    new = df.select(F.col("i").cast("bigint").alias("i"), F.lit("n").alias("n"))
    assert profile.drift(df.schema, new.schema) == {"new": ["n"], "gone": ["s"], "retyped": ["i"]}
    assert profile.contract_change(df.schema, new.schema)[0] == "major" and profile.contract_change(df.schema, df.withColumn("x", F.col("s")).schema)[0] == "minor" and profile.contract_change(df.schema, df.schema) == ("patch", [])
    assert profile.flatten(df.select(F.struct("i", "s").alias("p"), "i")).columns == ["p_i", "p_s", "i"]


def test_classifier_metrics_and_errors(spark):
    cases = [("Bump deps from 1 to 2", "chore"), ("fix(core): x", "bug"), ("[docs] y", "docs"), ("README typo", "docs"), ("App crashes", "bug"), ("update ci", "chore"), ("Add thing", "feature"), ("hello", "outro"), (None, None)]
    got = spark.createDataFrame(cases, "t string, want string").withColumn("got", titles.keyword_class("t")).withColumn("sure", titles.confident_class("t")).collect()
    assert all(r["got"] == r["want"] for r in got) and [r["sure"] for r in got[:4]] == ["chore", "bug", "docs", None]
    df = spark.createDataFrame([("a", "a"), ("a", None), ("b", "b"), ("b", "zzz")], "g string, p string")
    assert tuple(metrics.accuracy(df, "g", "p").first()) == (4, 2, 0.5)
    assert {tuple(r) for r in metrics.confusion(df, "g", "p", ["a", "b"]).collect()} == {("a", 1, 0, 1), ("b", 0, 1, 1)}
    assert metrics.kappa(df.filter("g = p and g = 'a'"), "g", "p").first()[0] == 1.0 and metrics.gate("x", 0.5, 0.6)[0] is False
    error = "File '/home/me/x/y.py' failed: value 'abc' at #12L\n\tat org.x\n  at org.y\nid 123e4567-e89b-12d3-a456-426614174000"
    assert titles.normalize_error(error, ["/home/me"]) == "File [text] failed: value [text] at #[column]\nid [id]"
    assert titles.insert_attacks(["a", "b"], [(1, "x")]) == ([(0, "a"), (1, "x"), (2, "b")], [0, None, 1]) and titles.comment_sql("t", "it's", {"c": "d"})[0].endswith("'it\\'s'")


def test_dimensions(spark):
    d = star.dim_date(spark, "2024-02-28", "2024-03-03").orderBy("date").collect()
    assert [r["date_key"] for r in d][:2] == [20240228, 20240229] and d[-1]["day_name"] == "Sunday" and d[-1]["is_weekend"] and len(d) == 5
    e = spark.createDataFrame([(1, "old", 1, 1), (1, "new", 2, 2), (1, "tie", 2, 3), (None, "x", 9, 9)], "k int, n string, t int, id int")
    assert star.dim_latest(e, "k", ["n"], "t", "id").drop("sk").collect() == [(1, "tie", 1, 2)]


def test_keywords_anywhere_in_a_text_count(spark, tmp_path):
    import re

    from lakeloom.plans import relational

    late = "plain words " * 20
    texts = [None, "", late, late + "Crash", late + "readme", late + "été bump", "x" * 80 + " new", "docs: " + late, late + "été", late * 50 + "merge"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")

    def brute(text):
        if text is None:
            return None
        x = text.strip(" ").lower()
        if re.search(titles.DEPENDENCY, x, re.ASCII):
            return "chore"
        if m := re.search(titles.PREFIX, x, re.ASCII):
            return titles.PREFIX_CLASS.get(m[1], "chore")
        return next((n for n, p in titles.KEYWORDS if re.search(p, x, re.ASCII)), titles.OTHER)

    got = {r["doc_id"]: r["class"] for r in relational.keyword_classifier_text(spark, str(tmp_path)).collect()}
    assert got == {i: brute(x) for i, x in enumerate(texts)} and got[3] == "bug" and got[9] == "chore"


def test_crc_of_text_equals_zlib(spark, small):
    import zlib

    from lakeloom.plans import checks

    types = {r["event_id"]: r["event_type"] for r in spark.read.parquet(f"{small}/events.parquet").collect()}
    assert {r["event_id"]: r["crc"] for r in checks.crc_of_text(spark, small).collect()} == {i: zlib.crc32(t.encode()) for i, t in types.items()}


def test_text_scrub_of_all_patterns(spark):
    texts = ["mail a.b+c@x-y.org.", "cpf 123.456.789-01 or 12345678901", "at 10.0.0.1", "call (11) 91234-5678 now", "hi @some-one, a@b", "", None]
    want = ["mail <EMAIL>.", "cpf <CPF> or <CPF>", "at <IP>", "call <TELEFONE> now", "hi <USUARIO>, a@b", "", None]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", privacy.scrub("t").alias("s")).collect()
    assert [r["s"] for r in sorted(got)] == want


def test_pauses_double_up_to_a_bound():
    from lakeloom.ops import retry

    assert list(retry.pauses(1, 1, 9)) == [] and all(0 <= p <= min(4.0, 2.0**k) for k, p in enumerate(retry.pauses(6, 1.0, 4.0)))
    with pytest.raises(ValueError):
        retry.retry(attempts=0)


def test_prompts_usage_and_replay(tmp_path, monkeypatch):
    from lakeloom.functions import inference, prompts

    (tmp_path / "title.toml").write_text('version = 3\nsystem = "s"\ntemplate = "Classify $title"\n')
    (tmp_path / "a.toml").write_text('version = "1"\ntemplate = "x"\n')
    assert [(p.name, p.version) for p in prompts.list_prompts(tmp_path)] == [("a", "1"), ("title", "3")]
    assert prompts.load_prompt(tmp_path, "title").fill(title="y") == "Classify y"
    with pytest.raises(KeyError):
        prompts.load_prompt(tmp_path, "title").fill()
    assert (prompts.Usage(1, 2) + prompts.Usage(3, 4)).cost(prompts.Price(1.0, 5.0)) == pytest.approx((4 + 30) / 1e6)
    monkeypatch.setenv("LAKELOOM_MODEL_PROVIDER", "")
    with pytest.raises(inference.CacheMiss):
        prompts.cached_client(tmp_path / "c.jsonl").complete({"a": 1})
    monkeypatch.setenv("LAKELOOM_MODEL_PROVIDER", "other")
    with pytest.raises(ValueError):
        prompts.cached_client(tmp_path / "c.jsonl")
    assert prompts.Predictions(["a", None]).missing == 1 and prompts.Triage(cause="c", category="data", retry=False, next_step="n").category == "data"
    assert metrics.matrix_text([[1, 20], [3, 4]], ["a", "b"]) == "    a  b\n a  1 20\n b  3  4"


def test_declared_tables_know_their_order(spark, tmp_path):
    from lakeloom.operators import flow

    f = flow.Flow(spark, str(tmp_path))
    f.table(reads=["b"])(type("F", (), {"__name__": "a", "__call__": lambda s, b: b})())
    with pytest.raises(ValueError, match="not declared: b"):
        f.order()
    f.table()(type("F", (), {"__name__": "b", "__call__": lambda s: spark.range(3)})())
    assert f.order() == ["b", "a"] and f.run() == {"a": 3, "b": 3}
