"""Window, session, cohort and history queries over events and orders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import history, timeline
from ..registry import query, read


def events(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "events")


def hourly(spark: SparkSession, d: str) -> DataFrame:
    h = F.date_trunc("hour", "ts").cast("timestamp_ntz")
    return events(spark, d).groupBy("event_type", h.alias("h")).agg(F.count(F.lit(1)).alias("n"))


def daily(spark: SparkSession, d: str) -> DataFrame:
    return events(spark, d).groupBy(F.to_date("ts").alias("d")).agg(F.count(F.lit(1)).alias("n"))


LATEST = "select user_id, event_type, event_id, ts, value from events qualify row_number() over (partition by user_id, event_type order by ts desc, event_id desc) = 1"


@query(LATEST)
def dedup_latest(spark, d):
    """WIN1, WIN3"""
    return history.dedup_latest(events(spark, d).select("user_id", "event_type", "event_id", "ts", "value"), ["user_id", "event_type"], [F.desc("ts"), F.desc("event_id")])


@query(LATEST)
def dedup_max_by_struct(spark, d):
    """AGG3"""
    return history.latest_by_struct(events(spark, d).select("user_id", "event_type", "event_id", "ts", "value"), ["user_id", "event_type"], ["ts", "event_id"])


@query("select user_id, min_by(struct_pack(e := event_id, t := event_type), struct_pack(t := ts, e := event_id)).e as event_id, min_by(struct_pack(e := event_id, t := event_type), struct_pack(t := ts, e := event_id)).t as event_type from events group by user_id")
def first_by_struct(spark, d):
    """AGG4"""
    first = F.min_by(F.struct("event_id", "event_type"), F.struct("ts", "event_id")).alias("f")
    return events(spark, d).groupBy("user_id").agg(first).select("user_id", "f.*")


def _ranked(fn: str, where: str) -> str:
    return f"""select c_mktsegment, o_custkey, spend, k from (select c_mktsegment, o_custkey, spend, {fn} over (partition by c_mktsegment order by spend desc{', o_custkey' if 'row' in fn else ''})::int as k
        from (select c_mktsegment, o_custkey, floor(sum(o_totalprice) / 100000)::bigint as spend from orders join customer on o_custkey = c_custkey group by all)) where {where}"""


def _spend(spark, d):
    j = read(spark, d, "orders").join(read(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return j.groupBy("c_mktsegment", "o_custkey").agg(F.floor(F.sum("o_totalprice") / 100000).alias("spend"))


def _top(spark, d, rank, *tie):
    w = Window.partitionBy("c_mktsegment").orderBy(F.desc("spend"), *tie)
    return _spend(spark, d).withColumn("k", rank.over(w)).filter("k <= 3")


@query(_ranked("rank()", "k <= 3"))
def topn_rank(spark, d):
    """WIN8, WIN22"""
    return _top(spark, d, F.rank())


@query(_ranked("dense_rank()", "k <= 3"))
def topn_dense(spark, d):
    """WIN8"""
    return _top(spark, d, F.dense_rank())


@query(_ranked("row_number()", "k <= 3"))
def topn_row_number(spark, d):
    """WIN8"""
    return _top(spark, d, F.row_number(), "o_custkey")


DAILY = "(select ts::date as d, count(*) as n from events group by 1)"


@query(f"select d, n, sum(n) over (order by d rows unbounded preceding)::bigint as total, avg(n) over (order by d rows 2 preceding) as mean3 from {DAILY}")
def running_total_and_mean(spark, d):
    """WIN9"""
    w = Window.orderBy("d")
    return daily(spark, d).select("d", "n", F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("total"), F.avg("n").over(w.rowsBetween(-2, 0)).alias("mean3"))


@query(f"select d, avg(n) over (order by d range between interval 2 days preceding and current row) as mean3 from {DAILY} where extract(day from d) % 5 <> 0")
def moving_mean_calendar(spark, d):
    """WIN9"""
    kept = daily(spark, d).filter(F.dayofmonth("d") % 5 != 0)
    return kept.select("d", F.avg("n").over(Window.orderBy(F.unix_date("d")).rangeBetween(-2, 0)).alias("mean3"))


@query("select event_id, count(*) over (partition by event_type order by ts::date) as upto from events")
def default_frame_counts_peers(spark, d):
    """WIN10: peers count together, so days are counted before the window"""
    by_day = events(spark, d).groupBy("event_type", F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    upto = by_day.select("event_type", "day", F.sum("n").over(Window.partitionBy("event_type").orderBy("day")).alias("upto"))  # one row a type and day
    return events(spark, d).withColumn("day", F.to_date("ts")).join(upto, ["event_type", "day"]).select("event_id", "upto")


@query("select ts::date as d, sum(count(*)) over (order by ts::date)::bigint as total from events group by ts::date")
def window_over_aggregate(spark, d):
    """WIN11"""
    return daily(spark, d).select("d", F.sum("n").over(Window.orderBy("d")).alias("total"))


@query("select event_id, (floor(epoch(ts)) - lag(floor(epoch(ts))) over w)::bigint as since, (lead(floor(epoch(ts))) over w - floor(epoch(ts)))::bigint as until from events window w as (partition by user_id order by ts, event_id)")
def lag_lead_gaps(spark, d):
    """WIN12"""
    w, t = Window.partitionBy("user_id").orderBy("ts", "event_id"), F.unix_timestamp("ts")
    return events(spark, d).select("event_id", (t - F.lag(t).over(w)).alias("since"), (F.lead(t).over(w) - t).alias("until"))


SESSIONS = """(select event_id, user_id, ts, sum(s) over (partition by user_id order by ts, event_id rows unbounded preceding)::bigint as session_number from (
    select event_id, user_id, ts, case when floor(epoch(ts)) - lag(floor(epoch(ts))) over (partition by user_id order by ts, event_id) <= 1800 then 0 else 1 end as s from events))"""


@query(f"select event_id, session_number, user_id::varchar || '#' || session_number::varchar as session_id from {SESSIONS}")
def sessionize_30m(spark, d):
    """WIN6"""
    return timeline.sessionize(events(spark, d), "user_id", "ts", tie=["event_id"]).select("event_id", "session_number", "session_id")


@query(f"select event_id, session_number, user_id::varchar || '#' || session_number::varchar as session_id from {SESSIONS}")
def sessionize_hot_users(spark, d):
    """WIN6: a user's rows in stretches of a day, so that a hot user is no single task"""
    return timeline.sessionize(events(spark, d), "user_id", "ts", tie=["event_id"], split_seconds=86_400).select("event_id", "session_number", "session_id")


@query("""with x as (select distinct user_id, ts::date as d from events), y as (select user_id, d, d - row_number() over (partition by user_id order by d)::int as island from x)
    select user_id, min(d) as "start", max(d) as "end", count(*) as days from y group by user_id, island""")
def activity_streaks(spark, d):
    """WIN7"""
    return timeline.streaks(events(spark, d), "user_id", "ts")


@query("""with x as (select o_custkey, o_orderdate::date as a, o_orderdate::date + 20 as b, o_orderkey from orders),
    y as (select *, case when a <= max(b) over (partition by o_custkey order by a, b rows between unbounded preceding and 1 preceding) then 0 else 1 end as n from x),
    z as (select *, sum(n) over (partition by o_custkey order by a, b rows unbounded preceding) as island from y) select o_custkey, min(a) as a, max(b) as b from z group by o_custkey, island""")
def merge_intervals(spark, d):
    """SRT10"""
    o = read(spark, d, "orders").select("o_custkey", F.to_date("o_orderdate").alias("a")).withColumn("b", F.date_add("a", 20))
    return timeline.merge_intervals(o, ["o_custkey"], "a", "b")


@query("""with h as (select event_type, date_trunc('hour', ts) as h, count(*) as n from events group by all), s as (select *, avg(n) over w as m, stddev_samp(n) over w as sd from h window w as (partition by event_type order by h rows between 30 preceding and 1 preceding))
    select event_type, h, n, case when sd > 0 then round((n - m) / sd, 6) end as z from s""")
def rolling_zscore(spark, d):
    """WIN17"""
    return timeline.rolling_z(hourly(spark, d), ["event_type"], "h", "n").withColumn("z", F.round("z", 6))


@query(f"select d, quantile_disc(n, 0.5) over (order by d rows between unbounded preceding and 1 preceding) as median_before from {DAILY}")
def trailing_median(spark, d):
    """WIN18"""
    return daily(spark, d).select("d", F.expr("percentile_approx(n, 0.5) over (order by d rows between unbounded preceding and 1 preceding)").alias("median_before"))


@query("select event_type, n, round(100.0 * n / sum(n) over (), 4) as pct from (select event_type, count(*) as n from events group by 1)")
def pct_of_total(spark, d):
    """WIN14"""
    return events(spark, d).groupBy("event_type").agg(F.count(F.lit(1)).alias("n")).withColumn("pct", F.round(timeline.share(F.col("n")), 4))


@query("select d, event_type, round(100.0 * n / sum(n) over (partition by d), 4) as pct from (select ts::date as d, event_type, count(*) as n from events group by all)")
def pct_of_group(spark, d):
    """WIN14"""
    g = events(spark, d).groupBy(F.to_date("ts").alias("d"), "event_type").agg(F.count(F.lit(1)).alias("n"))
    return g.select("d", "event_type", F.round(timeline.share(F.col("n"), "d"), 4).alias("pct"))


@query("""with w as (select distinct user_id, date_trunc('week', ts)::date as a from events), c as (select user_id, a, min(a) over (partition by user_id) as cohort from w),
    g as (select cohort, ((a - cohort) / 7)::int as week, count(distinct user_id) as users from c group by all)
    select cohort, week, users, first_value(users) over (partition by cohort order by week) as size, round(100.0 * users / first_value(users) over (partition by cohort order by week), 2) as pct from g""")
def cohort_retention(spark, d):
    """AGG21, WIN15, WIN16"""
    return timeline.cohorts(events(spark, d), "user_id", "ts")


@query("""with g as (select user_id, floor(epoch(ts)) - lag(floor(epoch(ts))) over (partition by user_id order by ts, event_id) as gap from events)
    select user_id, quantile_cont(gap, 0.5) as median_gap from g where gap is not null group by user_id""")
def median_gap(spark, d):
    """AGG22"""
    w, t = Window.partitionBy("user_id").orderBy("ts", "event_id"), F.unix_timestamp("ts")
    return events(spark, d).select("user_id", (t - F.lag(t).over(w)).alias("gap")).filter("gap is not null").groupBy("user_id").agg(F.expr("percentile(gap, 0.5)").alias("median_gap"))


def _scd2_sql(observations: str) -> str:
    """Versions of rows (o_custkey, o_orderpriority, valid_from, fresh)."""
    hashed = """sha256('{"o_orderpriority":"' || o_orderpriority || '"}')"""
    return f"""(with o as (select * from {observations} qualify row_number() over (partition by o_custkey, valid_from order by fresh desc, {hashed} desc) = 1),
    c as (select * from o qualify o_orderpriority is distinct from lag(o_orderpriority) over (partition by o_custkey order by valid_from))
    select o_custkey, o_orderpriority, valid_from, lead(valid_from) over (partition by o_custkey order by valid_from) as valid_to, lead(valid_from) over (partition by o_custkey order by valid_from) is null as is_current from c)"""


def _observed(where: str) -> str:
    return f"(select o_custkey, o_orderpriority, o_orderdate as valid_from, 1 as fresh from orders where {where})"


SCD2 = _scd2_sql(_observed("true"))
LATE = _scd2_sql(f"(select o_custkey, o_orderpriority, valid_from, 0 as fresh from {_scd2_sql(_observed('o_orderkey % 2 = 1'))} union all select * from {_observed('o_orderkey % 2 = 0')})")


def versions(spark, d):
    return history.scd2_history(read(spark, d, "orders"), ["o_custkey"], ["o_orderpriority"], "o_orderdate")


@query(f"select * from {SCD2}")
def scd2_history(spark, d):
    """WIN5, WIN13, REM4"""
    return versions(spark, d).select("o_custkey", "o_orderpriority", "valid_from", "valid_to", "is_current")


@query(f"select * from {LATE}")
def scd2_incremental(spark, d):
    """WIN5, SNK6: half of the orders first, then the late half"""
    o = read(spark, d, "orders")
    late = F.col("o_orderkey") % 2 == 0
    first = history.scd2_history(o.filter(~late), ["o_custkey"], ["o_orderpriority"], "o_orderdate")
    return history.scd2_history(o.filter(late), ["o_custkey"], ["o_orderpriority"], "o_orderdate", first).select("o_custkey", "o_orderpriority", "valid_from", "valid_to", "is_current")


@query(f"select o_custkey, o_orderpriority from {SCD2} where valid_from <= timestamp '1996-06-30' and (valid_to is null or valid_to > timestamp '1996-06-30')")
def scd2_as_of(spark, d):
    """PRJ13"""
    return history.scd2_as_of(versions(spark, d), F.lit("1996-06-30").cast("timestamp_ntz")).select("o_custkey", "o_orderpriority")


@query(f"select l.o_orderkey, coalesce(h.o_orderpriority, '-1') as priority_then from (select o_orderkey, o_custkey, o_orderdate - interval 100 days as t from orders) l left join {SCD2} h on l.o_custkey = h.o_custkey and l.t >= h.valid_from and (h.valid_to is null or l.t < h.valid_to)")
def asof_fact(spark, d):
    """JON7, JON8"""
    f = read(spark, d, "orders").select("o_orderkey", "o_custkey", (F.col("o_orderdate") - F.expr("interval 100 days")).alias("t"))
    h = versions(spark, d).withColumnRenamed("o_orderpriority", "priority_then")
    return history.as_of_join(f, h, ["o_custkey"], "t", ["priority_then"], {"priority_then": "-1"}).select("o_orderkey", "priority_then")


@query("""select e.event_id, p.value as last_purchase from events e asof left join (select user_id, ts, max(value) as value from events where event_type = 'purchase' group by all) p on e.user_id = p.user_id and e.ts >= p.ts where e.event_type <> 'purchase'""")
def asof_latest_change(spark, d):
    """JON9"""
    e = events(spark, d)
    p = e.filter("event_type = 'purchase'").groupBy("user_id", "ts").agg(F.max("value").alias("last_purchase")).withColumnRenamed("ts", "at")
    f = e.filter("event_type != 'purchase'").select("event_id", "user_id", "ts")
    return history.as_of_latest(f, p, ["user_id"], "ts", "at", "last_purchase").select("event_id", "last_purchase")


@query("""select e.event_id, p.value as last_purchase from events e asof left join (select user_id, ts, max(value) as value from events where event_type = 'purchase' group by all) p on e.user_id = p.user_id and e.ts >= p.ts where e.event_type <> 'purchase'""")
def asof_hot_keys(spark, d):
    """JON9: a key's rows in stretches of a day"""
    e = events(spark, d)
    p = e.filter("event_type = 'purchase'").groupBy("user_id", "ts").agg(F.max("value").alias("last_purchase")).withColumnRenamed("ts", "at")
    f = e.filter("event_type != 'purchase'").select("event_id", "user_id", "ts")
    return history.as_of_latest(f, p, ["user_id"], "ts", "at", "last_purchase", split_seconds=86_400).select("event_id", "last_purchase")


@query("""with m as (select *, lag(event_type) over (partition by user_id order by ts, event_id) as p from events), c as (select * from m where p is null or p <> event_type)
    select user_id, arg_max(event_type, struct_pack(t := ts, e := event_id)) as current, arg_max(coalesce(p, '~'), struct_pack(t := ts, e := event_id)) as previous from c group by user_id""")
def scd3_current_previous(spark, d):
    """WIN20"""
    return history.scd3(events(spark, d), "user_id", "event_type", ["ts", "event_id"]).withColumn("previous", F.coalesce("previous", F.lit("~")))


@query("""with m as (select event_id, event_type, user_id % 3 as g, lag(event_type) over w as p, lag(user_id % 3) over w as s from events window w as (partition by user_id // 10 order by event_id))
    select event_id, case when s <> g then 'transfer' else 'rename' end as kind from m where p <> event_type""")
def rename_or_transfer(spark, d):
    """WIN21"""
    e = events(spark, d).select("event_id", "event_type", F.floor(F.col("user_id") / 10).alias("key"), (F.col("user_id") % 3).alias("owner"))
    return history.rename_or_transfer(e, "key", "event_type", "owner", "event_id").select("event_id", "kind")


CDC = """(select user_id as id, value as v, event_id as lsn, case when event_type = 'error' then 'D' else 'U' end as op from events)"""


@query(f"select id, v, lsn from {CDC} qualify row_number() over (partition by id order by lsn desc) = 1 and op <> 'D'")
def cdc_apply(spark, d):
    """SNK14"""
    c = events(spark, d).select(F.col("user_id").alias("id"), F.col("value").alias("v"), F.col("event_id").alias("lsn"), F.when(F.col("event_type") == "error", "D").otherwise("U").alias("op"))
    empty = c.drop("op").withColumn("deleted", F.lit(False)).filter("false")
    early = history.cdc_reduce(empty, c.filter("lsn % 3 = 0"), "id")
    return history.cdc_reduce(early, c.filter("lsn % 3 != 0"), "id").filter("not deleted").drop("deleted")


@query("select user_id as id, event_id // 100 as v, event_type from events where event_type <> 'view' qualify row_number() over (partition by user_id order by event_id // 100 desc, (event_type = 'error')::int, event_id desc) = 1")
def latest_change_per_key(spark, d):
    """WIN4"""
    kind = F.when(F.col("event_type") == "view", "update_preimage").when(F.col("event_type") == "error", "delete").otherwise("insert")
    c = events(spark, d).select(F.col("user_id").alias("id"), F.floor(F.col("event_id") / 100).alias("_commit_version"), kind.alias("_change_type"), F.col("event_id").alias("_change_seq"), "event_type")
    return history.last_change_per_key(c, "id").select("id", F.col("_commit_version").alias("v"), "event_type")


@query("""with b as (select user_id, ts, event_id from events where event_type = 'purchase'), a as (select user_id, ts, event_id from events where event_type = 'click')
    select a.event_id as click_id, b.event_id as purchase_id from a join b on a.user_id = b.user_id and b.ts >= a.ts and floor(epoch(b.ts)) - floor(epoch(a.ts)) <= 3600""")
def click_to_purchase(spark, d):
    """JON7: an interval join in bins"""
    from ..operators.joins import interval_join

    e = events(spark, d)
    a = e.filter("event_type = 'click'").select("user_id", F.col("ts").alias("a_ts"), F.col("event_id").alias("click_id"))
    b = e.filter("event_type = 'purchase'").select("user_id", F.col("ts").alias("b_ts"), F.col("event_id").alias("purchase_id"))
    return interval_join(a, b, ["user_id"], "a_ts", "b_ts", 3600).select("click_id", "purchase_id")
