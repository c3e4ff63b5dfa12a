"""Queries of contracts, alerts, privacy, run records, costs and titles, and of what plans do."""

from __future__ import annotations

from datetime import datetime, timedelta

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import files as small
from ..functions import inference, metrics, titles
from ..operators import flow, history, privacy, profile, quality
from ..ops import retry, tracking
from ..registry import query, read
from ..session import scoped_conf
from ..storage import places
from .relational import KEY, _hmac_sql
from .storage import scratch
from .tables import facts

CONTRACT = quality.DataContract(
    name="customers", version="1.0.0", owner="sales", grain="one row a customer", primary_key=["c_custkey"],
    columns=[quality.ColumnSpec(name="c_custkey", type="bigint", nullable=False), quality.ColumnSpec(name="c_name", type="string", nullable=False), quality.ColumnSpec(name="c_acctbal", type="decimal(12,2)"), quality.ColumnSpec(name="c_phone", type="string")],
)


# --- quality ---------------------------------------------------------------------


@query("select rule, failed from (select 'priced' as rule, count(*) filter (not o_totalprice > 1000) as failed from orders union all select 'known', count(*) filter (o_orderstatus not in ('O', 'F')) from orders)")
def rules_from_rows(spark, d):
    """DQ3: expectations that were read from rows"""
    rules = quality.expectations([{"name": "priced", "condition": "o_totalprice > 1000", "action": "warn"}, {"name": "known", "condition": "o_orderstatus in ('O', 'F')", "action": "drop"}])
    got = quality.rule_metrics(read(spark, d, "orders"), rules)
    return got.select(F.col("rule"), F.col("failed"))


@query("select unnest(['c_phone: missing', 'c_acctbal: double instead of decimal(12,2)', 'c_nationkey: not in the contract', 'c_mktsegment: not in the contract']) as problem")
def contract_schema(spark, d):
    """DQ5, REM13, REM14: columns that are missing, of another type or unknown"""
    return facts(spark, "problem string", *[(p,) for p in quality.schema_problems(read(spark, d, "customer").schema, CONTRACT)])


@query("""select (count(*) filter (c_custkey % 50 = 0)) || ' rows without a complete key' as problem from customer union all
    select (count(*) filter (c_custkey % 50 = 0)) || ' nulls of the key' from customer union all select (count(*) filter (c_custkey % 40 = 1 and c_custkey % 50 <> 0)) || ' duplicates of keys' from customer""")
def contract_data(spark, d):
    """DQ7, DIM5, REM12: null keys and duplicates of a batch with known faults"""
    c = read(spark, d, "customer").select("c_custkey", "c_name")
    dirty = quality.inject_faults(quality.repeated_rows(c, "c_custkey % 40 = 1"), {"no_key": ("c_custkey % 50 = 0", {"c_custkey": "null"})}).drop("fault")
    spec = CONTRACT.model_copy(update={"columns": CONTRACT.columns[:2]})
    try:
        quality.enforce_contract(dirty, spec)
        problems = []
    except quality.ContractViolation as e:
        problems = [p.replace("c_custkey: ", "").replace(" nulls", " nulls of the key") if p.startswith("c_custkey") else p for p in quality.data_problems(dirty, spec) if str(e)]
        problems = [f"{p.split()[0]} {' '.join(p.split()[1:])}" for p in problems]
    return facts(spark, "problem string", *[(p,) for p in problems])


@query("select o_orderkey, case when o_orderkey % 11 = 0 then -1.0 else o_totalprice end as o_totalprice, case when o_orderkey % 7 = 0 and o_orderkey % 11 <> 0 then null else o_orderstatus end as o_orderstatus, case when o_orderkey % 11 = 0 then 'negative' when o_orderkey % 7 = 0 then 'no status' end as fault from orders")
def dirty_sample(spark, d):
    """DIM6: rows with known faults, each named"""
    o = read(spark, d, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus")
    return quality.inject_faults(o, {"negative": ("o_orderkey % 11 = 0", {"o_totalprice": "-1.0"}), "no status": ("o_orderkey % 7 = 0", {"o_orderstatus": "null"})})


@query("select o_orderkey, o_custkey from orders union all select o_orderkey, o_custkey from orders where o_orderkey % 5 = 0")
def dirty_repeats(spark, d):
    """DIM5: a feed that delivers some rows twice"""
    return quality.repeated_rows(read(spark, d, "orders").select("o_orderkey", "o_custkey"), "o_orderkey % 5 = 0")


@query("select round(date_diff('microsecond', max(ts), timestamp '2024-02-01') / 3600e6, 6) as delay_hours, max(ts) >= timestamp '2024-02-01' - interval 36 hours as fresh from events")
def freshness(spark, d):
    """DQ8, REM15, REM16: the age of the last event at a given time"""
    r = quality.check_freshness(read(spark, d, "events"), "ts", 36, datetime(2024, 2, 1))
    return facts(spark, "delay_hours double, fresh boolean", (round(r.delay_hours, 6), r.ok))


def _daily(spark, d) -> list[int]:
    rows = read(spark, d, "events").groupBy(F.to_date("ts").alias("day")).count().orderBy("day").collect()  # one row a day
    return [r["count"] for r in rows]


@query("""with n as (select cast(ts as date) as day, count(*) as n from events group by 1), h as (select median(n) as m from n where day < (select max(day) from n)),
    l as (select n from n order by day desc limit 1) select 'volume' as name, n::double as value, abs(n - m) <= 0.5 * m as ok from l, h union all select 'volume of nothing', 0.0, false union all select 'first run', 5.0, true""")
def volume_checks(spark, d):
    """DQ11, DQ12, REM27: the last day against the median of those before; alerts name what failed"""
    *history, last = _daily(spark, d)
    results = [quality.check_volume(last, history), quality.check_volume(0, history, name="volume of nothing"), quality.check_volume(5, [], name="first run")]
    said: list[str] = []
    failed = quality.raise_alerts(results, said.append)
    assert len(failed) == len(said) == sum(not r.ok for r in results)
    return facts(spark, "name string, value double, ok boolean", *[(r.name, r.value, r.ok) for r in results])


@query("select * from (values ('old', 90000.0::double, false), ('new', 1800.0, true)) v(name, seconds, ok)")
def age_checks(spark, d):
    """DQ10"""
    now = datetime(2024, 1, 2, 1)
    results = [quality.check_age(now - age, now, timedelta(hours=1), name) for name, age in (("old", timedelta(hours=25)), ("new", timedelta(minutes=30)))]
    return facts(spark, "name string, seconds double, ok boolean", *[(r.name, r.value, r.ok) for r in results])


@query("select * from (values ('contract of orders', 'page'), ('freshness', 'page'), ('volume', 'ticket')) v(name, severity)")
def alert_severity(spark, d):
    """DQ18"""
    return facts(spark, "name string, severity string", *[(n, quality.severity(n)) for n in ("contract of orders", "freshness", "volume")])


@query("select * from (values ('1.4.2', '1.4.2'), ('1.4.2+fix', '1.4.3'), ('1.4.2+feat', '1.5.0'), ('1.4.2+breaking', '2.0.0')) v(change, version)")
def next_versions(spark, d):
    """DQ19, DQ20: versions by the kinds of commits"""
    cases = {"1.4.2": ["docs: x"], "1.4.2+fix": ["fix: y", "chore: z"], "1.4.2+feat": ["fix(core): y", "feat: n"], "1.4.2+breaking": ["feat!: new", "fix: y"]}
    return facts(spark, "change string, version string", *[(k, small.next_version("1.4.2", m)) for k, m in cases.items()])


@query("select * from (values ('same', 'patch', 0::bigint), ('nullable', 'minor', 1), ('required', 'major', 1), ('retyped', 'major', 1), ('removed', 'major', 2)) v(case_name, level, reasons)")
def contract_changes(spark, d):
    """DQ17: what a change of schema means for readers"""
    ddl = StructType.fromDDL
    old = ddl("a bigint not null, b string")
    new = {"same": "a bigint not null, b string", "nullable": "a bigint not null, b string, c int", "required": "a bigint not null, b string, c int not null", "retyped": "a bigint not null, b int", "removed": "c int"}
    return facts(spark, "case_name string, level string, reasons bigint", *[(k, *(lambda r: (r[0], len([x for x in r[1] if r[0] != "major" or "nullable" not in x])))(profile.contract_change(old, ddl(v)))) for k, v in new.items()])


@query("select * from (values ('gone', 'c_acctbal'), ('gone', 'c_mktsegment'), ('new', 'c_phone'), ('retyped', 'c_nationkey')) v(kind, \"column\")")
def schema_drift(spark, d):
    """DIM9: columns that came, went or changed their type"""
    c = read(spark, d, "customer")
    now = c.select("c_custkey", "c_name", F.col("c_nationkey").cast("bigint").alias("c_nationkey"), F.lit("x").alias("c_phone"))
    return facts(spark, "kind string, column string", *[(k, x) for k, v in profile.drift(c.schema, now.schema).items() for x in v])


@query("select 'segments' as rule, count(*) filter (c_mktsegment not in ('BUILDING', 'MACHINERY')) as failed from customer union all select 'balance', count(*) filter (c_acctbal < 0) from customer")
def approved_rules(spark, d):
    """DQ15, REM72, REM74: only rules that a person approved and that can run are run"""
    R = quality.Rule
    rules = [R(name="segments", column="c_mktsegment", kind="accepted_values", values=["BUILDING", "MACHINERY"]), R(name="balance", column="c_acctbal", kind="range", least=0.0), R(name="names", column="c_name", kind="range", least=0.0), R(name="extra", column="c_name", kind="not_null")]
    c = read(spark, d, "customer")
    review = quality.review_rules(rules, {n: quality.Decision(True) for n in ("segments", "balance", "names")}, dict(c.dtypes), "reviewer")
    assert [a["outcome"] for a in review.audit] == ["approved", "approved", "invalid", "rejected"]
    return quality.run_rules(c, review.approved)


# --- privacy ---------------------------------------------------------------------


@query("select count(*) as rows, count(distinct c_mktsegment) as tokens, 0::bigint as clear from customer")
def tokens_for_values(spark, d):
    """GOV4, JON17, FN33: random tokens from a stored vault, the same for equal values"""
    c, place = read(spark, d, "customer").select("c_custkey", "c_mktsegment"), scratch(spark)
    privacy.token_vault(c, "c_mktsegment").write.parquet(place)
    tokens = privacy.tokenize(c, "c_mktsegment", spark.read.parquet(place))
    return tokens.agg(F.count("c_mktsegment").alias("rows"), F.countDistinct("c_mktsegment").alias("tokens"), F.count_if(~F.startswith("c_mktsegment", F.lit("tok_"))).alias("clear"))


@query("select c_custkey, case when c_custkey % 10 <> 3 then c_name end as c_name from customer")
def crypto_shredding(spark, d):
    """GOV5, GOV6, GOV7, GOV23, JON18, FN32: a subject is forgotten with its key; the encrypted rows stay where they are"""
    c, place = read(spark, d, "customer").select("c_custkey", "c_name"), scratch(spark)
    privacy.subject_keys(c, "c_custkey").write.parquet(f"{place}/keys")
    keys = spark.read.parquet(f"{place}/keys")
    c.join(keys, "c_custkey").select("c_custkey", privacy.encrypt("c_name", "key_hex").alias("c_name")).write.parquet(f"{place}/rows")
    left = privacy.shred(keys, "c_custkey", c.filter("c_custkey % 10 = 3"))
    return privacy.decrypt_by_subject(spark.read.parquet(f"{place}/rows"), "c_custkey", "c_name", left)


FORMAT = "regexp_replace(regexp_replace(regexp_replace(c_name, '[A-Z]', 'X', 'g'), '[a-z]', 'x', 'g'), '[0-9]', '9', 'g')"
POLICIES = [privacy.ColumnPolicy(c, privacy.Level.RESTRICTED, c != "plain", t) for c, t in (("plain", "none"), ("hashed", "sha256"), ("keyed", "hmac"), ("form", "format"), ("part", "partial"), ("mail", "email"), ("number", "cpf"), ("out", "drop"))]


def _people(spark, d) -> DataFrame:
    name = F.col("c_name")
    number = F.lpad(F.col("c_custkey").cast("string"), F.lit(11), F.lit("7"))
    return read(spark, d, "customer").select(F.col("c_custkey").alias("plain"), name.alias("hashed"), name.alias("keyed"), name.alias("form"), name.alias("part"), F.concat(F.lower(F.regexp_replace(name, "#", ".")), F.lit("@example.org")).alias("mail"), number.alias("number"), name.alias("out"))


TREATED = f"""select c_custkey as plain, sha256(c_name) as hashed, {_hmac_sql("c_name")} as keyed, {FORMAT} as form, repeat('*', greatest(length(c_name) - 2, 0)) || right(c_name, 2) as part,
    left(lower(c_name), 1) || '***@example.org' as mail, '***.' || substr(n, 4, 3) || '.' || substr(n, 7, 3) || '-**' as number from (select *, lpad(c_custkey::varchar, 11, '7') as n from customer)"""


@query(TREATED)
def policy_treatments(spark, d):
    """PRJ9, REM21 to REM23: every treatment of a policy"""
    return privacy.apply_policy(_people(spark, d), POLICIES, "analyst", KEY)


@query(TREATED)
def dynamic_view(spark, d):
    """PRJ10, FN37: a view that looks at a session variable, here of an analyst"""
    name = f"v{abs(hash(scratch(spark)))}"
    _people(spark, d).createOrReplaceTempView(f"{name}_source")
    spark.sql(f"declare or replace variable role_{name} string default 'owner'")
    spark.sql(privacy.dynamic_view_sql(name, f"{name}_source", POLICIES, KEY, f"role_{name}"))
    assert not spark.table(name).filter("out is not null").isEmpty()
    spark.sql(f"set var role_{name} = 'analyst'")
    return spark.table(name).drop("out")


@query("select unnest(['hashed', 'keyed', 'form', 'part', 'mail', 'number', 'out']) as \"column\"")
def personal_column_list(spark, d):
    """GOV14, PRJ12: personal columns of a policy, each with a statement that tags it"""
    assert all("SET TAGS" in s for s in privacy.tag_sql("people", POLICIES))
    return facts(spark, "column string", *[(c,) for c in privacy.personal_columns(POLICIES)])


@query("""with c as (select c_custkey, lpad((c_custkey * 7919 % 1000000000)::varchar, 9, '0') as b, c_custkey % 3 as k from customer),
    v as (select *, list_sum(list_transform(range(1, 10), lambda i: substr(b, i::int, 1)::int * (11 - i))) % 11 as r1 from c),
    w as (select *, case when r1 < 2 then 0 else 11 - r1 end as d1 from v), x as (select *, (list_sum(list_transform(range(1, 10), lambda i: substr(b, i::int, 1)::int * (12 - i))) + d1 * 2) % 11 as r2 from w)
    select c_custkey, k < 2 and list_unique(string_split(b || d1 || case when r2 < 2 then 0 else 11 - r2 end, '')) > 1 as valid from x""")
def tax_numbers(spark, d):
    """DIM8, GOV22: check digits; of three numbers one has a wrong last digit"""
    b = F.lpad((F.col("c_custkey") * 7919 % 1_000_000_000).cast("string"), F.lit(9), F.lit("0"))
    digit = lambda text, i: F.substring(text, i, 1).cast("int")
    rest = lambda text, n: sum((digit(text, i) * (n + 2 - i) for i in range(1, n + 1)), F.lit(0)) % 11
    check = lambda r: F.when(r < 2, 0).otherwise(11 - r).cast("string")
    rows = read(spark, d, "customer").select("c_custkey", b.alias("b")).withColumn("b", F.concat("b", check(rest(F.col("b"), 9))))
    rows = rows.withColumn("b", F.concat("b", ((check(rest(F.col("b"), 10)).cast("int") + F.when(F.col("c_custkey") % 3 == 2, 1).otherwise(0)) % 10).cast("string")))
    return rows.select("c_custkey", privacy.cpf_valid("b").alias("valid"))


@query("select * from (values ('mail', 'email'), ('number', 'cpf'), ('user_id', 'name')) v(\"column\", reason)")
def personal_by_profile(spark, d):
    """GOV19, GOV20, REM68: columns that look personal, from figures and masked samples"""
    people = _people(spark, d).select(F.col("plain").alias("amount"), F.col("plain").alias("user_id"), "mail", "number")
    profiles = privacy.column_profiles(people)
    assert all(set(s) <= set("Xx9.@-_#") for p in profiles for s in p.samples)
    return facts(spark, "column string, reason string", *privacy.personal_by_rules(profiles).items())


# --- runs and costs ----------------------------------------------------------------


def _runs(spark, d) -> DataFrame:
    """Events as run records: an error is a failed run, the value its seconds."""
    e = read(spark, d, "events")
    return e.select(F.lit("medallion").alias("pipeline"), F.col("event_type").alias("step"), F.col("value").alias("duration_s"), F.when(F.col("event_type") == "error", "failed").otherwise("ok").alias("status"), (F.col("event_id") % 100).alias("rows_written"))


@query("""select 'medallion' as pipeline, event_type as step, count(*) as runs, count(*) filter (event_type = 'error') as failures, sum(event_id % 100)::bigint as rows_written,
    quantile_cont(value, 0.5) as median_s, quantile_cont(value, 0.95) as p95_s, max(value) as longest_s from events group by 2""")
def run_aggregates(spark, d):
    """AGG29: run records by step"""
    return tracking.run_figures(_runs(spark, d))


@query("""select 'medallion' as pipeline, count(*) as runs, count(*) filter (event_type <> 'error' and value <= 90) as good, good / runs as level, good / runs >= 0.75 as met, 1 - (1 - good / runs) / (1 - 0.75::double) as budget_left from events""")
def service_levels(spark, d):
    """AGG30: the share of good runs and the error budget"""
    return tracking.service_level(_runs(spark, d), 0.75, 90)


@query("select 12.0::double as units, 6.6::double as unit_cost, 4.0::double as machine_cost, 10.6::double as total")
def step_cost(spark, d):
    """OPS3, REM28"""
    c = tracking.estimate_cost(2, 4, 1.5, 0.55, 0.5)
    return facts(spark, "units double, unit_cost double, machine_cost double, total double", tuple(round(x, 6) for x in (c.units, c.unit_cost, c.machine_cost, c.total)))


@query("select * from (values ('cores', 2.0::double), ('events_per_s', 500.0), ('files', 2464.0), ('mb_per_s', 1.0), ('peak_mb_per_s', 5.0), ('stored_gb', 630.72)) v(figure, value)")
def capacity_figures(spark, d):
    """OPS25"""
    c = tracking.capacity(86.4, 2000, peak_over_mean=5, retention_days=36.5, headroom=2)
    return facts(spark, "figure string, value double", *[(k, round(v, 2) if k != "files" else float(round(v))) for k, v in c.items()])


@query("with n as (select c_nationkey, count(*) as n from customer group by 1) select count(*) as n, min(n)::double as least, quantile_disc(n, 0.5)::double as median, max(n)::double as most from n")
def spread_of_counts(spark, d):
    """OPS7, REM19: nearest-rank figures of a few values"""
    counts = [float(r["count"]) for r in read(spark, d, "customer").groupBy("c_nationkey").count().collect()]  # one row a nation
    s = retry.spread(counts)
    return facts(spark, "n bigint, least double, median double, most double", (s.n, s.least, s.median, s.most))


@query("select * from (values ('9.2 MiB', 9646899.2::double), ('1,234', 1234.0), ('2.5 s', 2.5)) v(metric, value)")
def metric_values(spark, d):
    """OPS10"""
    return facts(spark, "metric string, value double", *[(t, tracking.parse_metric(t)) for t in ("9.2 MiB", "1,234", "2.5 s")])


@query("select count(*) as rows, 'ok' as first, 'failed' as second from nation")
def tracked_steps(spark, d):
    """OPS1, OPS2, OPS8, SNK30, REM25, REM26: a step that ends well and one that fails are both on record"""
    sink = tracking.TableSink(spark, scratch(spark))
    with tracking.track_step("p", "good", sink, spark) as run:
        rows = run.rows_read = read(spark, d, "nation").count()
    try:
        with tracking.track_step("p", "bad", sink, spark):
            raise ValueError("wrong")
    except ValueError:
        pass
    from ..storage.table import Table

    kept = {r["step"]: r["status"] for r in Table(spark, sink.path).read().collect()}
    return facts(spark, "rows bigint, first string, second string", (rows, kept["good"], kept["bad"]))


# --- plans -------------------------------------------------------------------------


@query("select count(*) as rows, 'SortMergeJoin' as planned, 'BroadcastHashJoin' as run from lineitem join orders on l_orderkey = o_orderkey where o_orderkey % 1000 = 1")
def aqe_join_switch(spark, d):
    """JON13: sizes that only show while running turn a sort-merge join into a broadcast join"""
    with scoped_conf(spark, {"spark.sql.adaptive.enabled": "true", "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "10MB"}):
        joined = read(spark, d, "lineitem").select("l_orderkey").join(read(spark, d, "orders").select("o_orderkey").filter("o_orderkey % 1000 = 1"), F.col("l_orderkey") == F.col("o_orderkey"))
        planned = "SortMergeJoin" if tracking.grep_plan(joined, "SortMergeJoin") else "other"
        n, final = tracking.run_plan(joined)
    return facts(spark, "rows bigint, planned string, run string", (n, planned, "BroadcastHashJoin" if "BroadcastHashJoin" in final else "SortMergeJoin"))


@query("select l_returnflag, count(*) as rows, max(l_quantity) as most, 2::bigint as steps from lineitem group by 1")
def partial_and_final(spark, d):
    """AGG31: rows are aggregated before the shuffle and after it"""
    grouped = read(spark, d, "lineitem").groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("rows"), F.max("l_quantity").alias("most"))
    return grouped.withColumn("steps", F.lit(len(tracking.grep_plan(grouped, "HashAggregate"))).cast("bigint"))


@query("select count(*) as rows, true as split from lineitem join supplier on case when l_orderkey % 10 <> 0 then 1 else l_suppkey end = s_suppkey")
def aqe_skew_join(spark, d):
    """JON15: a partition with most of the rows is read in parts"""
    conf = {"spark.sql.adaptive.enabled": "true", "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "4KB", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "4KB", "spark.sql.adaptive.coalescePartitions.minPartitionSize": "1KB", "spark.sql.shuffle.partitions": "16"}
    with scoped_conf(spark, conf):
        lines = read(spark, d, "lineitem").repartition(8)
        big = lines.select(F.when(F.col("l_orderkey") % 10 != 0, F.lit(1)).otherwise(F.col("l_suppkey")).alias("k"), "l_orderkey", "l_partkey")
        joined = big.join(read(spark, d, "supplier").select(F.col("s_suppkey").alias("k")), "k")
        n, final = tracking.run_plan(joined)
    return facts(spark, "rows bigint, split boolean", (n, "skew=true" in final))


# --- titles and models ---------------------------------------------------------------


@query("select p_partkey, length(p_name) as a, length(p_name) as b, length(p_name) as c from part")
def udf_kinds(spark, d):
    """UDF1, UDF2: a Python function a row, a pandas function a batch and a built-in one give the same; the last stays in the JVM"""
    by_row = F.udf(lambda s: None if s is None else len(s), "bigint")
    by_batch = F.pandas_udf(_lengths, "bigint")
    return read(spark, d, "part").select("p_partkey", by_row("p_name").alias("a"), by_batch("p_name").alias("b"), F.length("p_name").cast("bigint").alias("c"))


def _lengths(names: pd.Series) -> pd.Series:
    return names.str.len().astype("Int64")


class _Lengths:
    """A model client that answers with the parity of titles' lengths."""

    def complete(self, request):
        return {"labels": [{"i": i, "label": "odd" if len(t) % 2 else "even"} for i, t in enumerate(request["titles"])]}


@query("select p_partkey, case when length(p_name) % 2 = 1 then 'odd' else 'even' end as label from part")
def batched_inference(spark, d):
    """UDF3, ML3, ML4, SRT6: titles in batches of 25 to a model, answers matched by their numbers"""
    ask = lambda group: {"titles": [r["p_name"] for r in group]}

    def answer(response, group):
        return ({"p_partkey": r["p_partkey"], "label": x} for r, x in zip(group, inference.aligned(len(group), response["labels"], ("odd", "even")), strict=True))

    rows = read(spark, d, "part").select("p_partkey", "p_name", titles.batch_number("p_partkey", 25).alias("batch"))
    return inference.infer(rows, "batch", "p_partkey", ask, answer, _Lengths, "p_partkey bigint, label string")


@query("select * from (values ('accuracy', true), ('recall', false)) v(gate, passed)")
def evaluation_gates(spark, d):
    """ML13"""
    return facts(spark, "gate string, passed boolean", *[(n, metrics.gate(n, v, 0.8)[0]) for n, v in (("accuracy", 0.875), ("recall", 0.7))])


@query("select * from (values ('one title', 0.000737::double), ('a million', 737.0), ('a million in batch', 368.5)) v(what, usd)")
def model_costs(spark, d):
    """ML16, ML17, REM71"""
    args = (112, 125, 1.0, 5.0)
    found = [("one title", titles.cost_usd(*args)), ("a million", titles.cost_per_million_items(*args)), ("a million in batch", titles.cost_per_million_items(*args, 0.5))]
    return facts(spark, "what string, usd double", *[(n, round(v, 9)) for n, v in found])


@query("select * from (values (0::bigint, 0::bigint), (1, null), (2, 1), (3, null)) v(place, origin)")
def attacks_in_a_batch(spark, d):
    """ML5: where the rows of a batch with planted ones come from"""
    _, origin = titles.insert_attacks(["a", "b"], [(1, "ignore"), (3, "all")])
    return facts(spark, "place bigint, origin bigint", *enumerate(origin))


@query("select * from (values ('COMMENT ON TABLE t IS ''it\\''s'''), ('ALTER TABLE t ALTER COLUMN a COMMENT ''x''')) v(statement)")
def comment_statements(spark, d):
    """ML18, ML19, REM63: reviewed comments as statements"""
    kept = titles.review_comments({"a": "y", "b": "z"}, {"a": "x", "b": None, "c": "new"}, ["a", "b"])
    return facts(spark, "statement string", *[(s,) for s in titles.comment_sql("t", "it's", kept)])


@query("select count(distinct name) as messages, 1::bigint as normal from (values ('x1'), ('x2'), ('x3')) v(name)")
def error_classes(spark, d):
    """ML15: errors that differ in values, ids and places only are one"""
    seen = [f"[CAST] The value '{v}' of column#{n}L in /data/run={n}/part-{n}.parquet can't be read (id {n}23e4567-e89b-12d3-a456-426614174000)\n  at x.y(Z.java:{n})" for n, v in ((1, "a"), (2, "b"), (3, "c"))]
    return facts(spark, "messages bigint, normal bigint", (len(set(seen)), len({titles.normalize_error(m) for m in seen})))


@query("select 'CAST_INVALID_INPUT' as error, count(*) as nulls from nation")
def ansi_casts(spark, d):
    """FN36: a cast that can't be done stops a query, or is null where that is asked for"""
    with scoped_conf(spark, {"spark.sql.ansi.enabled": "true"}):
        n = read(spark, d, "nation")
        try:
            n.select(F.col("n_name").cast("int")).collect()
            error = "none"
        except Exception as e:
            error = "CAST_INVALID_INPUT" if "CAST_INVALID_INPUT" in str(e) else type(e).__name__
        nulls = n.filter(F.col("n_name").try_cast("int").isNull()).count()
    return facts(spark, "error string, nulls bigint", (error, nulls))


@query("""select event_id, starts_with(event_type, 'c') as starts, contains(event_type, 'i') as has, replace(event_type, 'e', 'E') as replaced, minute(ts)::int as minute, abs(event_id - 500) as away, (event_id % 7)::bigint as rest,
    (((-event_id % 7) + 7) % 7)::bigint as positive, ends_with(event_type, 'w') as ends from events""")
def more_scalars(spark, d):
    """FN18, FN23, FN27, PRJ5"""
    e, n = read(spark, d, "events"), F.col("event_id")
    return e.select("event_id", F.startswith("event_type", F.lit("c")).alias("starts"), F.contains("event_type", F.lit("i")).alias("has"), F.replace("event_type", F.lit("e"), F.lit("E")).alias("replaced"), F.minute("ts").alias("minute"), F.abs(n - 500).alias("away"), (n % 7).alias("rest"), F.pmod(-n, F.lit(7)).cast("bigint").alias("positive"), F.endswith("event_type", F.lit("w")).alias("ends"))


@query()
def crc_of_text(spark, d):
    """FN28: crc32, which DuckDB lacks; a test holds it against zlib"""
    return read(spark, d, "events").select("event_id", F.crc32(F.col("event_type")).alias("crc"))


@query("""select event_type, count(*) as events, max(value) as highest from events where value > 5 and event_type <> 'error' group by 1
    union all select 'rejected', count(*), max(value) from events where not (value > 5 and event_type <> 'error')""")
def declared_tables(spark, d):
    """DQ16: bronze, silver with rules, gold and rejected rows from declarations in any order"""
    f = flow.Flow(spark, scratch(spark))

    @f.table(reads=["silver"])
    def gold(silver):
        return silver.groupBy("event_type").agg(F.count(F.lit(1)).alias("events"), F.max("value").alias("highest"))

    @f.table(reads=["bronze"], rules=[quality.Expectation("valued", "value > 5", "drop"), quality.Expectation("good", "event_type <> 'error'", "drop")])
    def silver(bronze):
        return bronze

    @f.table()
    def bronze():
        return read(spark, d, "events").select("event_id", "event_type", "value")

    f.run()
    rejected = f.read("silver_rejected").agg(F.lit("rejected").alias("event_type"), F.count(F.lit(1)).alias("events"), F.max("value").alias("highest"))
    return f.read("gold").unionByName(rejected)


@query("""select user_id as run_id, count(*) as steps, max((event_type = 'error')::int) as failed, date_diff('microsecond', min(ts), max(ts)) / 1e6 as wall_s, max(value) as longest from events group by 1""")
def run_wall_times(spark, d):
    """AGG29, AGG30: a run fails if a step of it failed; its time from the first start to the last end"""
    e = read(spark, d, "events").select(F.col("user_id").alias("run_id"), F.col("ts").alias("started_at"), F.col("ts").alias("finished_at"), F.when(F.col("event_type") == "error", "failed").otherwise("ok").alias("status"), F.col("value").alias("duration_s"))
    longest = e.groupBy("run_id").agg(F.max("duration_s").alias("longest"))
    return tracking.run_times(e).drop("steps_s").join(longest, "run_id")


@query("select count(*) as facts, (select count(*) from orders o join (select o_custkey as c from orders group by 1, o_orderstatus) h on o.o_custkey = h.c) as multiplied from orders")
def naive_history_join(spark, d):
    """JON10: facts joined to a history by the natural key alone are multiplied; joined by the moment they aren't"""
    o = read(spark, d, "orders").withColumn("at", F.lit("2024-01-01").cast("timestamp"))
    history_rows = o.select("o_custkey", "o_orderstatus").distinct().withColumn("valid_from", F.expr("timestamp'2023-01-01' + make_dt_interval(ascii(o_orderstatus))"))
    w = Window.partitionBy("o_custkey").orderBy("valid_from")
    versions = history_rows.withColumn("valid_to", F.lead("valid_from").over(w))
    once = history.as_of_join(o.select("o_orderkey", "o_custkey", "at"), versions, ["o_custkey"], "at", ["o_orderstatus"])
    return facts(spark, "facts bigint, multiplied bigint", (once.count(), o.join(versions.select("o_custkey"), "o_custkey").count()))


@query("select l_orderkey, l_linenumber, l_quantity, (row_number() over (partition by l_returnflag order by l_quantity, l_orderkey, l_linenumber))::bigint as place from lineitem")
def sorted_inside_partitions(spark, d):
    """SRT4, SRT5: rows dealt in ranges and sorted inside partitions, so that a flag's rows are no single task; places follow without a further shuffle of rows"""
    lines = read(spark, d, "lineitem").select("l_returnflag", "l_orderkey", "l_linenumber", "l_quantity")
    placed = places.numbered(lines, ["l_returnflag"], ["l_quantity", "l_orderkey", "l_linenumber"], scratch(spark), "place")
    assert len(tracking.grep_plan(placed, "Exchange")) == 1  # the counts before each file
    return placed.drop("l_returnflag")


@query("select o_orderkey, case when o_orderkey % 97 = 0 then null else o_custkey end as o_custkey from orders")
def rewritten_rows(spark, d):
    """PRJ15: a column rewritten where a condition holds"""
    return read(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 97 != 0, F.col("o_custkey")).alias("o_custkey"))


@query("select event_id % 4 as key, count(*) as events, count(distinct user_id) as users from events group by 1")
def counters_and_sets(spark, d):
    """DIM11: counts and sets of each key"""
    return read(spark, d, "events").groupBy((F.col("event_id") % 4).alias("key")).agg(F.count(F.lit(1)).alias("events"), F.countDistinct("user_id").alias("users"))
