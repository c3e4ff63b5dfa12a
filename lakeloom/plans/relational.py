"""Join, aggregation, set, quality, privacy and text queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import metrics, titles
from ..operators import joins, privacy, profile, quality, reconcile, star
from ..registry import query, read


def t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return read(spark, d, name)


def counted(df: DataFrame, *by) -> DataFrame:
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))


@query("select n_name, count(*) as n, round(sum(o_totalprice), 2) as total from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey group by n_name")
def star_join(spark, d):
    """JON1, JON21, JON11: sizes decide on broadcasts"""
    j = t(spark, d, "orders").join(t(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(t(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return j.groupBy("n_name").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("select c_custkey, count(o_orderkey) as n from customer left join orders on c_custkey = o_custkey group by c_custkey")
def left_join_counts(spark, d):
    """JON2: orders are counted before the join, so a hot customer is one row"""
    n = t(spark, d, "orders").groupBy("o_custkey").agg(F.count("o_orderkey").alias("n"))
    return t(spark, d, "customer").join(n, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", F.coalesce("n", F.lit(0)).alias("n"))


@query("select c_custkey from customer where exists (select 1 from orders where o_custkey = c_custkey and o_totalprice > 200000)")
def semi_join(spark, d):
    """JON4, JON20"""
    big = t(spark, d, "orders").filter("o_totalprice > 200000")
    return t(spark, d, "customer").join(big, F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey")


@query("select c_custkey from customer where not exists (select 1 from orders where o_custkey = c_custkey and o_totalprice > 200000)")
def anti_join(spark, d):
    """JON5"""
    big = t(spark, d, "orders").filter("o_totalprice > 200000")
    return t(spark, d, "customer").join(big, F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@query("select c_custkey from customer where c_custkey not in (select case when o_orderkey % 7 = 0 then null else o_custkey end from orders)")
def not_in_null(spark, d):
    """JON6: a null in the list leaves no row"""
    t(spark, d, "orders").createOrReplaceTempView("__orders")
    t(spark, d, "customer").createOrReplaceTempView("__customer")
    return spark.sql("select c_custkey from __customer where c_custkey not in (select case when o_orderkey % 7 = 0 then null else o_custkey end from __orders)")


@query("select p_brand, count(*) as n, round(sum(l_quantity), 2) as quantity from lineitem join part on l_partkey = p_partkey group by p_brand")
def salted_join(spark, d):
    """JON14"""
    big = t(spark, d, "lineitem").withColumnRenamed("l_partkey", "p_partkey")
    j = joins.salted_join(big, t(spark, d, "part"), "p_partkey", joins.hot_keys(big, "p_partkey", 0.0005, 5) or [1], 8)
    return j.groupBy("p_brand").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"))


@query("select o_orderpriority, count(*) as n from lineitem join orders on l_orderkey = o_orderkey group by 1")
def merge_join(spark, d):
    """JON12"""
    return counted(t(spark, d, "lineitem").join(t(spark, d, "orders").hint("merge"), F.col("l_orderkey") == F.col("o_orderkey")), "o_orderpriority")


@query("select user_id, count(*) as n from events join customer on user_id = c_custkey and c_mktsegment <> event_type group by 1")
def expression_key_join(spark, d):
    """JON19"""
    return counted(t(spark, d, "events").join(t(spark, d, "customer"), (F.col("user_id") == F.col("c_custkey")) & (F.col("c_mktsegment") != F.col("event_type"))), "user_id")


@query("select sha256(c_name) as h, c_name as value from customer where c_custkey % 2 = 0")
def dictionary_attack(spark, d):
    """JON16, GOV1"""
    c = t(spark, d, "customer")
    return joins.dictionary_attack(c.select(privacy.sha256("c_name").alias("h")), "h", c.filter("c_custkey % 2 = 0"), "c_name")


@query("""with b as (select * from orders where o_orderkey % 500 <> 1 union all select * from orders where o_orderkey % 700 = 2), a as (select o_orderpriority p, count(*) n, sum(hash(o_orderkey)) h from orders group by 1), c as (select o_orderpriority p, count(*) n, sum(hash(o_orderkey)) h from b group by 1)
    select coalesce(a.p, c.p) as o_orderpriority, a.n as rows_a, c.n as rows_b from a full join c on a.p = c.p where a.n is distinct from c.n or a.h is distinct from c.h""")
def full_reconcile(spark, d):
    """SET5, JON3, AGG26"""
    o = t(spark, d, "orders")
    other = o.filter("o_orderkey % 500 != 1").unionByName(o.filter("o_orderkey % 700 = 2"))
    return reconcile.divergent(o, other, "o_orderpriority", o.columns)


@query("""select o_orderkey, case when o_orderkey % 500 = 1 and o_orderkey % 700 <> 2 then 'missing' when o_orderkey % 700 = 2 and o_orderkey % 500 <> 1 then 'duplicated' when o_orderkey % 900 = 3 and o_orderkey % 500 <> 1 then 'changed' end as status from orders
    where (o_orderkey % 500 = 1 and o_orderkey % 700 <> 2) or (o_orderkey % 700 = 2 and o_orderkey % 500 <> 1) or (o_orderkey % 900 = 3 and o_orderkey % 500 <> 1)""")
def compare_keys(spark, d):
    """SET5"""
    o = t(spark, d, "orders")
    other = o.filter("o_orderkey % 500 != 1").unionByName(o.filter("o_orderkey % 700 = 2")).withColumn("o_totalprice", F.when(F.col("o_orderkey") % 900 == 3, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice")))
    return reconcile.compare_keys(o, other, "o_orderkey", o.columns)


@query("select o_custkey from orders where o_orderstatus = 'F' except all select o_custkey from orders where o_orderstatus = 'O'")
def except_all(spark, d):
    """SET3"""
    o = t(spark, d, "orders")
    return o.filter("o_orderstatus = 'F'").select("o_custkey").exceptAll(o.filter("o_orderstatus = 'O'").select("o_custkey"))


@query("select 'c' as kind, c_nationkey as k, c_acctbal as x, null::varchar as name from customer union all select 's', s_nationkey, null, s_name from supplier")
def union_by_name(spark, d):
    """SET1, SET2"""
    c = t(spark, d, "customer").select(F.lit("c").alias("kind"), F.col("c_nationkey").alias("k"), F.col("c_acctbal").alias("x"))
    s = t(spark, d, "supplier").select(F.lit("s").alias("kind"), F.col("s_nationkey").alias("k"), F.col("s_name").alias("name"))
    return c.unionByName(s, allowMissingColumns=True)


@query("select distinct o_custkey, o_orderstatus from orders")
def distinct_pairs(spark, d):
    """SET4"""
    return t(spark, d, "orders").select("o_custkey", "o_orderstatus").dropDuplicates()


FACT = ("select strftime(ts::date, '%Y%m%d')::int as date_key, user_id, count(*) as events, count(*) filter (event_type = 'view') as views, count(*) filter (event_type = 'purchase' and value > 50) as big_purchases, "
        "count(distinct event_type) as kinds from events group by all")  # fmt: skip


@query(FACT)
def fact_daily(spark, d):
    """AGG1, PRJ8, DIM1"""
    return star.daily_fact(t(spark, d, "events"), ["user_id"], "ts", {"views": "event_type = 'view'", "big_purchases": "event_type = 'purchase' and value > 50"}, {"kinds": "event_type"})


@query("select user_id, arg_max(event_type, struct_pack(t := ts, e := event_id)) as event_type, min(ts) as first_seen, max(ts) as last_seen from events group by user_id")
def scd1_dim(spark, d):
    """AGG2"""
    return star.dim_latest(t(spark, d, "events"), "user_id", ["event_type"], "ts", "event_id").drop("sk")


@query("""select strftime(d, '%Y%m%d')::int as date_key, d as date, year(d)::int as year, quarter(d)::int as quarter, month(d)::int as month, monthname(d) as month_name, day(d)::int as day, isodow(d)::int as day_of_week, dayname(d) as day_name, isodow(d) >= 6 as is_weekend
    from (select unnest(generate_series(date '2024-01-01', date '2024-12-31', interval 1 day))::date as d)""")
def dim_date(spark, d):
    """SRC14, DIM2"""
    return star.dim_date(spark, "2024-01-01", "2024-12-31")


@query("select n_nationkey, n_name from nation union all select -1, 'unknown'")
def dim_unknown(spark, d):
    """DIM3"""
    return star.with_unknown(t(spark, d, "nation").select("n_nationkey", "n_name"), n_nationkey=-1, n_name="unknown")


@query("""select user_id, v as viewed, c as clicked, p as purchased, ((floor(epoch(p)) - floor(epoch(v))) / 60.0)::double as minutes from (select user_id, min(case when event_type = 'view' then ts end) v, min(case when event_type = 'click' then ts end) c, min(case when event_type = 'purchase' then ts end) p from events group by 1)""")
def accumulating_snapshot(spark, d):
    """AGG17"""
    m = star.milestones(t(spark, d, "events"), "user_id", "ts", {"viewed": "event_type = 'view'", "clicked": "event_type = 'click'", "purchased": "event_type = 'purchase'"})
    return m.withColumn("minutes", (F.unix_timestamp("purchased") - F.unix_timestamp("viewed")) / 60.0)


def _grouping(spark, d, how):
    o = t(spark, d, "orders").withColumn("o_orderstatus", F.nullif("o_orderstatus", F.lit("P")))
    return o, [F.count(F.lit(1)).alias("n"), F.grouping("o_orderstatus").cast("int").alias("gs"), F.grouping("o_orderpriority").cast("int").alias("gp")]


def _grouping_sql(how: str) -> str:
    return f"select o_orderstatus, o_orderpriority, count(*) as n, grouping(o_orderstatus)::int as gs, grouping(o_orderpriority)::int as gp from (select nullif(o_orderstatus, 'P') as o_orderstatus, o_orderpriority from orders) group by {how}"


@query(_grouping_sql("rollup (o_orderstatus, o_orderpriority)"))
def rollup(spark, d):
    """AGG8"""
    o, a = _grouping(spark, d, "rollup")
    return o.rollup("o_orderstatus", "o_orderpriority").agg(*a)


@query(_grouping_sql("cube (o_orderstatus, o_orderpriority)") + " having grouping_id(o_orderstatus, o_orderpriority) < 3")
def cube(spark, d):
    """AGG9"""
    o, a = _grouping(spark, d, "cube")
    return o.cube("o_orderstatus", "o_orderpriority").agg(*a, F.grouping_id().alias("g")).filter("g < 3").drop("g")


@query(_grouping_sql("grouping sets ((o_orderstatus), (o_orderpriority))"))
def grouping_sets(spark, d):
    """AGG10"""
    o, a = _grouping(spark, d, "sets")
    return o.groupingSets([[F.col("o_orderstatus")], [F.col("o_orderpriority")]], F.col("o_orderstatus"), F.col("o_orderpriority")).agg(*a)


@query("select o_orderstatus, o_orderpriority, count(*) as n, round(sum(o_totalprice), 2) as total from orders group by all")
def group_by_all(spark, d):
    """AGG7"""
    t(spark, d, "orders").createOrReplaceTempView("__orders_all")
    return spark.sql("select o_orderstatus, o_orderpriority, count(*) as n, round(sum(o_totalprice), 2) as total from __orders_all group by all")


KINDS = ("click", "error", "purchase", "signup", "view")
PIVOT = "select hour(ts)::int as h, " + ", ".join(f"count(*) filter (event_type = '{k}') as {k}" for k in KINDS[:3]) + " from events group by 1"


@query(PIVOT)
def pivot(spark, d):
    """AGG11"""
    return t(spark, d, "events").groupBy(F.hour("ts").alias("h")).pivot("event_type", list(KINDS[:3])).agg(F.count(F.lit(1))).na.fill(0)


@query("select h, kind, n from (" + " union all ".join(f"select hour(ts)::int as h, '{k}' as kind, count(*) filter (event_type = '{k}') as n from events group by 1" for k in KINDS[:3]) + ")")
def unpivot(spark, d):
    """AGG12"""
    return pivot(spark, d).unpivot("h", list(KINDS[:3]), "kind", "n")


@query("select event_type, quantile_cont(value, 0.5) as p50, quantile_cont(value, 0.95) as p95 from events group by 1")
def percentile_exact(spark, d):
    """AGG13"""
    return t(spark, d, "events").groupBy("event_type").agg(F.percentile("value", 0.5).alias("p50"), F.percentile("value", 0.95).alias("p95"))


@query()
def percentile_sketch(spark, d):
    """AGG14: an element of the column, within 1/10000 of the rank"""
    return t(spark, d, "events").groupBy("event_type").agg(F.percentile_approx("value", 0.5, 10000).alias("p50"))


@query()
def approx_distinct(spark, d):
    """AGG15"""
    return t(spark, d, "events").groupBy("event_type").agg(F.approx_count_distinct("user_id", 0.02).alias("users"))


@query("select count(distinct user_id) as users, count(distinct (user_id, event_type)) filter (event_type is not null) as pairs from (select user_id, nullif(event_type, 'error') as event_type from events)")
def count_distinct_pairs(spark, d):
    """AGG6, AGG16: a pair with a null doesn't count"""
    return t(spark, d, "events").withColumn("event_type", F.nullif("event_type", F.lit("error"))).agg(F.count_distinct("user_id").alias("users"), F.count_distinct("user_id", "event_type").alias("pairs"))


@query("select o_custkey, o_orderpriority, count(*) as copies, case when count(distinct o_orderstatus) = 1 then 'copy' else 'conflict' end as kind from orders group by all having count(*) > 1")
def dup_classification(spark, d):
    """AGG5"""
    g = t(spark, d, "orders").groupBy("o_custkey", "o_orderpriority").agg(F.count(F.lit(1)).alias("copies"), F.count_distinct(F.struct("o_orderstatus")).alias("k")).filter("copies > 1")
    return g.select("o_custkey", "o_orderpriority", "copies", F.when(F.col("k") == 1, "copy").otherwise("conflict").alias("kind"))


@query("select hour(ts)::int as h, count(*) filter (user_id % 2 = 0) as human, count(*) filter (user_id % 2 = 1) as bots, count(distinct user_id) as users, round(count(*) filter (event_type = 'purchase') / nullif(count(*) filter (event_type = 'view'), 0), 6) as rate from events group by 1")
def ratio_with_guard(spark, d):
    """AGG18, AGG19, AGG27"""
    n = star.count_where
    views = F.nullif(n("event_type = 'view'"), F.lit(0))
    return t(spark, d, "events").groupBy(F.hour("ts").alias("h")).agg(n("user_id % 2 = 0").alias("human"), n("user_id % 2 = 1").alias("bots"), F.count_distinct("user_id").alias("users"), F.round(n("event_type = 'purchase'") / views, 6).alias("rate"))


@query("select o_orderkey, (select count(*) from lineitem where l_orderkey = o_orderkey) as lines from orders")
def correlated_scalar(spark, d):
    """AGG20"""
    t(spark, d, "orders").createOrReplaceTempView("__o")
    t(spark, d, "lineitem").createOrReplaceTempView("__l")
    return spark.sql("select o_orderkey, coalesce((select count(*) from __l where l_orderkey = o_orderkey), 0) as lines from __o")


@query("select min(n) as k, count(*) as groups, count(*) filter (n = 1) as unique_groups, sum(n)::bigint as rows from (select count(*) as n from customer group by c_nationkey, c_mktsegment, floor(c_acctbal / 1000))")
def k_anonymity(spark, d):
    """AGG23, AGG33"""
    c = t(spark, d, "customer").withColumn("band", F.floor(F.col("c_acctbal") / 1000))
    return profile.k_anonymity(c, ["c_nationkey", "c_mktsegment", "band"])


@query("select c_custkey from (select c_custkey, count(*) over (partition by c_nationkey, c_mktsegment) as n from customer) where n >= 10")
def suppress_small_groups(spark, d):
    """AGG24, WIN19"""
    return profile.suppress_small(t(spark, d, "customer"), ["c_nationkey", "c_mktsegment"], 10).select("c_custkey")


@query("select n as group_size, count(*) as groups from (select count(*) as n from orders group by o_custkey) group by 1")
def aggregate_of_aggregate(spark, d):
    """AGG33"""
    return counted(t(spark, d, "orders"), "o_custkey").groupBy(F.col("n").alias("group_size")).agg(F.count(F.lit(1)).alias("groups"))


@query("select n_name, count(distinct o_custkey) as customers, count(*) as orders from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey group by 1 order by 2 desc, 3 desc, 1 limit 8")
def distinct_over_star(spark, d):
    """AGG34, AGG32, SRT1"""
    j = t(spark, d, "orders").join(t(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(t(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return j.groupBy("n_name").agg(F.count_distinct("o_custkey").alias("customers"), F.count(F.lit(1)).alias("orders")).orderBy(F.desc("customers"), F.desc("orders"), "n_name").limit(8)


@query("select hour(ts)::int as h, event_type, count(*) as n from events where event_type in ('click', 'view') and value between 10 and 60 group by all")
def filtered_two_key_count(spark, d):
    """AGG35, PRJ14, SRC34"""
    return counted(t(spark, d, "events").filter(F.col("event_type").isin("click", "view") & F.col("value").between(10, 60)), F.hour("ts").alias("h"), "event_type")


@query("select time_bucket(interval 15 minutes, ts) as w, event_type, count(*) as n from events group by all")
def tumbling_batch(spark, d):
    """AGG36"""
    return counted(t(spark, d, "events"), F.window("ts", "15 minutes").alias("x"), "event_type").select(F.col("x.start").cast("timestamp_ntz").alias("w"), "event_type", "n")


@query("select w, count(*) as n from (select unnest([time_bucket(interval 10 minutes, ts), time_bucket(interval 10 minutes, ts) - interval 10 minutes]) as w from events) group by 1")
def sliding_batch(spark, d):
    """AGG37"""
    return counted(t(spark, d, "events"), F.window("ts", "20 minutes", "10 minutes").alias("x")).select(F.col("x.start").cast("timestamp_ntz").alias("w"), "n")


@query("select event_type, (props->>'$.k')::bigint as k, array_to_string(list_sort(json_keys(props)), ',') as keys from events")
def json_extract(spark, d):
    """FN1, FN2, FN4, AGG28"""
    return t(spark, d, "events").select("event_type", F.from_json("props", "k bigint")["k"].alias("k"), F.array_join(F.array_sort(F.json_object_keys("props")), ",").alias("keys"))


@query("select event_id, (props->>'$.k')::bigint as k from events")
def variant_extract(spark, d):
    """SRC10, FN5"""
    return t(spark, d, "events").select("event_id", F.try_variant_get(F.parse_json("props"), "$.k", "bigint").alias("k"))


@query("select l_partkey, count(*) as n from lineitem group by 1 order by 2 desc, 1 limit 20")
def topk(spark, d):
    """SRT7, SRT8"""
    return counted(t(spark, d, "lineitem"), "l_partkey").orderBy(F.desc("n"), "l_partkey").limit(20)


@query("select c_custkey, x from (select c_custkey, case when c_custkey % 3 = 0 then null else c_acctbal end as x from customer) order by x nulls last, c_custkey limit 50")
def nulls_last_limit(spark, d):
    """SRT1, SRT2"""
    x = F.when(F.col("c_custkey") % 3 != 0, F.col("c_acctbal"))
    return t(spark, d, "customer").select("c_custkey", x.alias("x")).orderBy(F.asc_nulls_last("x"), "c_custkey").limit(50)


@query("select o_orderkey, round(greatest(o_totalprice - 1000, 0), 2) as net, upper(o_orderpriority) as p, substr(o_orderpriority, 1, 1)::int as rank, date_diff('day', date '1992-01-01', o_orderdate::date) as days, strftime(o_orderdate, '%Y%m') as ym, year(o_orderdate)::int as y, coalesce(nullif(o_orderstatus, 'P'), '?') as s, split_part(o_orderpriority, '-', 2) as word from orders")
def scalar_functions(spark, d):
    """FN12, FN16 to FN27, FN34, FN35, PRJ16"""
    o, p = t(spark, d, "orders"), F.col("o_orderpriority")
    return o.select(
        "o_orderkey", F.round(F.greatest(F.col("o_totalprice") - 1000, F.lit(0.0)), 2).alias("net"), F.upper(p).alias("p"), F.substring(p, 1, 1).cast("int").alias("rank"), F.datediff(F.to_date("o_orderdate"), F.lit("1992-01-01")).cast("bigint").alias("days"), F.date_format("o_orderdate", "yyyyMM").alias("ym"),
        F.year("o_orderdate").alias("y"), F.coalesce(F.nullif("o_orderstatus", F.lit("P")), F.lit("?")).alias("s"), F.split_part(p, F.lit("-"), F.lit(2)).alias("word"),
    )


RULES = [quality.Expectation("positive", "x > 10", "warn"), quality.Expectation("known_flag", "l_returnflag in ('A', 'N')", "drop"), quality.Expectation("shipped", "l_shipdate >= timestamp_ntz'1993-01-01'", "drop")]
LINES = "(select *, case when l_orderkey % 5 = 0 then null else l_quantity end as x from lineitem)"


def _lines(spark, d):
    return t(spark, d, "lineitem").withColumn("x", F.when(F.col("l_orderkey") % 5 != 0, F.col("l_quantity")))


@query(f"""select 'positive' as rule, count(*) filter (not coalesce(x > 10, false)) as failed from {LINES} union all select 'known_flag', count(*) filter (not coalesce(l_returnflag in ('A', 'N'), false)) from {LINES}
    union all select 'shipped', count(*) filter (not coalesce(l_shipdate >= timestamp '1993-01-01', false)) from {LINES}""")
def expectation_metrics(spark, d):
    """DQ1, DQ2, SNK35"""
    return quality.rule_metrics(_lines(spark, d), RULES)


@query(f"""select l_orderkey, l_linenumber, concat_ws(',', case when not coalesce(x > 10, false) then 'positive' end, case when not l_returnflag in ('A', 'N') then 'known_flag' end, case when not l_shipdate >= timestamp '1993-01-01' then 'shipped' end) as rules
    from {LINES} where not l_returnflag in ('A', 'N') or not l_shipdate >= timestamp '1993-01-01'""")
def quarantine(spark, d):
    """DQ2, FN7"""
    return quality.split_rows(_lines(spark, d), RULES)[1].select("l_orderkey", "l_linenumber", F.array_join("_dq_failed_rules", ",").alias("rules"))


@query("""with o as (select case when o_orderkey % 9 = 0 then null else o_custkey end as a, o_orderpriority as b from orders), g as (select a, b, count(*) as n from o group by all)
    select sum(n)::bigint as rows, coalesce(sum(n) filter (a is null), 0)::bigint as null_keys, coalesce(sum(n - 1) filter (a is not null), 0)::bigint as duplicate_keys, coalesce(sum(n) filter (a is null), 0)::bigint as nulls_a from g""")
def contract_keys(spark, d):
    """DQ6"""
    o = t(spark, d, "orders").select(F.when(F.col("o_orderkey") % 9 != 0, F.col("o_custkey")).alias("a"), F.col("o_orderpriority").alias("b"))
    return quality.key_figures(o, ["a", "b"], ["a"])


@query("""with c as (select ts::date as d, count(*) as n from events group by 1), s as (select count(*) k, sum(n) s, sum(n * n) q from c)
    select d, n, round((n - (s - n) / (k - 1)) / sqrt((q - n * n - (k - 1) * ((s - n) / (k - 1)) ^ 2) / (k - 2)), 4) as z from c, s""")
def volume_leave_one_out(spark, d):
    """DQ9"""
    c = counted(t(spark, d, "events"), F.to_date("ts").alias("d"))
    return quality.leave_one_out_z(c, "n").withColumn("z", F.round("z", 4))


@query("""select 'acct' as rule, count(*) filter (c_acctbal < 0) as failed from customer union all select 'name', count(*) filter (not regexp_matches(c_name, '^Customer#[0-9]+$')) from customer
    union all select 'segment', count(*) filter (c_mktsegment not in ('BUILDING', 'MACHINERY')) from customer union all select 'short', count(*) filter (length(c_name) > 10) from customer union all select 'nation_unique', coalesce(sum(n), 0)::bigint from (select count(*) n from customer group by c_nationkey having count(*) > 1)""")
def rule_failures(spark, d):
    """DQ13, DQ14"""
    R = quality.Rule
    rules = [R(name="acct", column="c_acctbal", kind="range", least=0), R(name="name", column="c_name", kind="regex", pattern="^Customer#[0-9]+$"), R(name="segment", column="c_mktsegment", kind="accepted_values", values=["BUILDING", "MACHINERY"]), R(name="short", column="c_name", kind="max_length", most=10), R(name="nation_unique", column="c_nationkey", kind="unique")]
    return quality.run_rules(t(spark, d, "customer"), rules)


KEY = b"a key for tests"


def _hmac_sql(column: str) -> str:
    inner, outer = (p.hex() for p in privacy._pads(KEY))
    return f"sha256(unhex('{outer}') || unhex(sha256(unhex('{inner}') || {column}::blob)))"


@query(f"select c_custkey, {_hmac_sql('c_name')} as h from customer")
def hmac(spark, d):
    """GOV2, GOV3, PRJ11"""
    return t(spark, d, "customer").select("c_custkey", privacy.hmac_sha256("c_name", KEY).alias("h"))


@query("select c_custkey, repeat('*', greatest(length(c_name) - 2, 0)) || right(c_name, 2) as partial, regexp_replace(regexp_replace(regexp_replace(c_name, '[A-Z]', 'X', 'g'), '[a-z]', 'x', 'g'), '[0-9]', '9', 'g') as format from customer")
def masks(spark, d):
    """GOV8, GOV10, FN15"""
    return t(spark, d, "customer").select("c_custkey", privacy.mask_partial("c_name").alias("partial"), privacy.mask_format("c_name").alias("format"))


MAIL = r"regexp_extract(text, '[A-Za-z0-9._]+@[A-Za-z0-9.]+\.com')"


@query(f"select doc_id, case when regexp_matches(m, '^[^@]+@[^@]+$') then left(m, 1) || '***@' || split_part(m, '@', 2) when m is not null then '***' end as masked from (select doc_id, nullif({MAIL}, '') as m from documents)")
def mask_emails(spark, d):
    """GOV11"""
    m = F.nullif(F.regexp_extract("text", r"[A-Za-z0-9._]+@[A-Za-z0-9.]+\.com", 0), F.lit(""))
    return t(spark, d, "documents").select("doc_id", privacy.mask_email(m).alias("masked"))


@query("select c_custkey, case when c_custkey % 2 = 0 then '***.' || substr(n, 4, 3) || '.' || substr(n, 7, 3) || '-**' else '***' end as masked from (select c_custkey, lpad(c_custkey::varchar, 11, '7') as n from customer)")
def mask_digits(spark, d):
    """GOV12"""
    n = F.lpad(F.col("c_custkey").cast("string"), F.lit(11), F.lit("7"))
    return t(spark, d, "customer").select("c_custkey", privacy.mask_cpf(F.when(F.col("c_custkey") % 2 == 0, n).otherwise(F.lit("12"))).alias("masked"))


@query(f"select {_hmac_sql('c_name')} as c_name, c_mktsegment from customer")
def policy_projection(spark, d):
    """PRJ9, REM23: columns without a policy are left out"""
    P, L = privacy.ColumnPolicy, privacy.Level
    return privacy.apply_policy(t(spark, d, "customer"), [P("c_name", L.RESTRICTED, True, "hmac"), P("c_mktsegment", L.PUBLIC, False), P("c_acctbal", L.RESTRICTED, True, "drop")], "analyst", KEY)


@query(r"""select doc_id, sha256(regexp_replace(regexp_replace(text, '[\w.+-]+@[\w-]+(\.[\w-]+)+', '<EMAIL>', 'g'), '\b(?:\d{1,3}\.){3}\d{1,3}\b', '<IP>', 'g')) as h from documents""")
def text_scrub(spark, d):
    """GOV13, FN13: the two patterns that both regex dialects read alike"""
    text = F.regexp_replace(F.regexp_replace("text", *privacy.SCRUBS[0]), *privacy.SCRUBS[2])
    return t(spark, d, "documents").select("doc_id", F.sha2(text, 256).alias("h"))


def _re2(pattern: str) -> str:
    return pattern.replace("'", "''")


#: The two regex dialects see word boundaries alike in ASCII only, so other letters are replaced first.
TITLE = "lower(trim(regexp_replace(text, '[^\\x00-\\x7F]', 'x', 'g'), ' '))"
CLASSES = f"""(select doc_id, case when regexp_matches(x, '{_re2(titles.DEPENDENCY)}') then 'chore' {' '.join(f"when regexp_matches(x, '{_re2(p)}') then '{n}'" for n, p in titles.KEYWORDS)} else 'outro' end as class from (select doc_id, {TITLE} as x from documents))"""


def _titles(spark, d):
    title = F.regexp_replace("text", r"[^\x00-\x7F]", "x")
    return t(spark, d, "documents").select("doc_id", titles.keyword_class(title).alias("class"))


@query(f"select * from {CLASSES}")
def keyword_classifier(spark, d):
    """ML1 over whole texts; documents have no conventional prefixes (ML2), which keyword_classifier_text and the tests cover"""
    return _titles(spark, d)


@query()
def keyword_classifier_text(spark, d):
    """ML1, ML2 over whole texts as they are; the two regex dialects differ on other letters, so a test holds it against brute force"""
    return t(spark, d, "documents").select("doc_id", titles.keyword_class("text").alias("class"))


def _judged(spark, d):
    return t(spark, d, "labels").filter("toxic is not null and quality is not null").select("doc_id", F.col("quality").cast("string").alias("a"), F.when(F.col("doc_id") % 4 == 0, F.col("toxic")).otherwise(F.col("quality")).cast("string").alias("b"))


JUDGED = "(select doc_id, quality::varchar as a, (case when doc_id % 4 = 0 then toxic else quality end)::varchar as b from labels where toxic is not null and quality is not null)"


@query(f'select a, count(*) filter (b = \'0\') as "0", count(*) filter (b = \'1\') as "1", 0::bigint as no_answer from {JUDGED} group by a')
def confusion(spark, d):
    """ML8"""
    return metrics.confusion(_judged(spark, d), "a", "b", ["0", "1"])


@query(f"""with l as (select unnest(['0', '1']) as label), c as (select label, count(*) filter (a = label and b = label) tp, count(*) filter (b = label) p, count(*) filter (a = label) s from l, {JUDGED} group by label)
    select label, round(case when p > 0 then tp / p else 0 end, 6) as precision, round(case when s > 0 then tp / s else 0 end, 6) as recall, round(case when p + s > 0 then 2 * tp / (p + s) else 0 end, 6) as f1, s as support from c""")
def precision_recall(spark, d):
    """ML9, ML10, ML11"""
    m = metrics.per_class(_judged(spark, d), "a", "b", ["0", "1"])
    return m.select("label", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")], "support")


@query(f"""with j as (select * from {JUDGED}), n as (select count(*)::double n, avg((a = b)::int) po from j), e as (select sum(x.k::double * y.k) / any_value(n * n) pe from (select a, count(*) k from j group by 1) x join (select b, count(*) k from j group by 1) y on a = b, n)
    select round((po - pe) / (1 - pe), 6) as kappa from n, e""")
def kappa(spark, d):
    """ML12"""
    return metrics.kappa(_judged(spark, d), "a", "b").select(F.round("kappa", 6).alias("kappa"))


@query(f"""with x as (select count(*)::double n, count(*) filter (a = b)::double k from {JUDGED}), y as (select n, k / n p from x)
    select n::bigint as rows, round(p, 6) as accuracy, round((p + 3.8416 / (2 * n) - 1.96 * sqrt(p * (1 - p) / n + 3.8416 / (4 * n * n))) / (1 + 3.8416 / n), 6) as low, round((p + 3.8416 / (2 * n) + 1.96 * sqrt(p * (1 - p) / n + 3.8416 / (4 * n * n))) / (1 + 3.8416 / n), 6) as high from y""")
def wilson_interval(spark, d):
    """ML6, ML7"""
    a = metrics.accuracy(_judged(spark, d), "a", "b")
    low, high = metrics.wilson(F.col("right"), F.col("rows"))
    return a.select("rows", F.round("accuracy", 6).alias("accuracy"), F.round(low, 6).alias("low"), F.round(high, 6).alias("high"))


@query("select vec_id, round(list_cosine_similarity(embedding::double[], (select embedding::double[] from embeddings where vec_id = 0)), 5) as score from embeddings order by score desc, vec_id limit 10")
def embedding_topk(spark, d):
    """top-k by cosine of one stated vector"""
    e = t(spark, d, "embeddings")
    one = F.broadcast(e.filter("vec_id = 0").select(F.col("embedding").alias("q")).limit(1))  # one row
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda a, b: a.cast("double") * b), F.lit(0.0), lambda s, v: s + v)
    score = dot("embedding", "q") / F.sqrt(dot("embedding", "embedding") * dot("q", "q"))
    return e.join(one).select("vec_id", F.round(score, 5).alias("score")).orderBy(F.desc("score"), "vec_id").limit(10)


@query("select event_id from events where event_id % 10 = 3")
def deterministic_subset(spark, d):
    """PRJ6, PRJ7, SRT9: a stated sampling operator"""
    return t(spark, d, "events").filter(F.pmod("event_id", F.lit(10)) == 3).select("event_id")


@query("select 'c_nationkey' as column, count(*) as rows, count(*) filter (c_nationkey is null) as nulls, count(distinct c_nationkey) as distinct_values, min(c_nationkey)::varchar as low, max(c_nationkey)::varchar as high from customer union all select 'c_mktsegment', count(*), count(*) filter (c_mktsegment is null), count(distinct c_mktsegment), min(c_mktsegment), max(c_mktsegment) from customer")
def profile_columns(spark, d):
    """AGG25"""
    rows = profile.profile(t(spark, d, "customer").select("c_nationkey", "c_mktsegment"))
    return spark.createDataFrame([(r["column"], r["rows"], r["nulls"], r["distinct"], r["min"], r["max"]) for r in rows], "column string, rows bigint, nulls bigint, distinct_values bigint, low string, high string")


@query("select conv_id, turn, word, place::int as place from (select conv_id, turn, unnest(string_split(text, ' ')) as word, generate_subscripts(string_split(text, ' '), 1) - 1 as place from conversations)")
def explode_words(spark, d):
    """FN6, FN8, FN9"""
    return t(spark, d, "conversations").select("conv_id", "turn", F.posexplode_outer(F.split("text", " ")).alias("place", "word"))
