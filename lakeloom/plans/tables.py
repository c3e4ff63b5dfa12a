"""Queries through the table store: writes, schema changes, maintenance, and what its log says."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..registry import query, read
from ..storage.table import ConflictError, ConstraintViolation, SchemaMismatch, Table, retry_on_conflict
from ..streaming import windows
from .storage import scratch


def table(spark: SparkSession) -> Table:
    return Table(spark, scratch(spark))


def facts(spark: SparkSession, ddl: str, *rows: tuple) -> DataFrame:
    """A few rows that were found on the driver."""
    return spark.createDataFrame(list(rows), ddl)


def _orders(spark, d) -> DataFrame:
    return read(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")


def _events(spark, d) -> DataFrame:
    return read(spark, d, "events").select("event_id", "user_id", "event_type", "value")


@query("select o_orderkey, o_custkey, o_orderstatus, o_orderpriority from orders where o_orderstatus = 'O'")
def overwrite_rows(spark, d):
    """SNK9: all rows replaced in one commit"""
    t, o = table(spark), _orders(spark, d)
    t.append(o)
    t.overwrite(o.filter("o_orderstatus = 'O'"))
    return t.read()


@query("select o_custkey as customer, count(*) as orders from orders group by 1")
def overwrite_schema(spark, d):
    """SNK12: rows and schema replaced"""
    t, o = table(spark), _orders(spark, d)
    t.append(o)
    t.overwrite(o.groupBy(F.col("o_custkey").alias("customer")).agg(F.count(F.lit(1)).alias("orders")), schema_too=True)
    return t.read()


@query("select event_id, user_id, event_type, value from events")
def restore_version(spark, d):
    """SNK15: back to the version before a delete and an update"""
    t = table(spark)
    t.append(_events(spark, d))
    t.delete("event_type = 'error'")
    t.update({"value": "0.0"}, "event_type = 'view'")
    t.restore(1)
    return t.read()


@query("select count(*) filter (event_type <> 'error') as rows, true as only_active, true as fewer_files from events")
def vacuum_files(spark, d):
    """SNK16, LOG5, LOG9, REM7: no file stays that the last version doesn't read; the row count comes from the log"""
    t = table(spark)
    t.append(_events(spark, d))
    t.delete("event_type = 'error'")
    before = t.physical_files()["data"]
    t.vacuum()
    after = t.physical_files()["data"]
    return facts(spark, "rows bigint, only_active boolean, fewer_files boolean", (t.count(), after == len(t.active_files()), after < before))


@query("select count(*) filter (user_id <> 7) as rows, 0::bigint as left_in_files, (count(*) filter (user_id = 7))::bigint as deleted from events")
def erase_subject(spark, d):
    """SNK17, SRC13, GOV17: a subject's rows leave the table and all files"""
    t = table(spark)
    t.create(_events(spark, d).schema, properties={"change_feed": "true"})
    t.append(_events(spark, d))
    t.update({"value": "value + 1"}, "user_id = 7")
    deleted = t.erase("user_id = 7")["deleted"]
    return facts(spark, "rows bigint, left_in_files bigint, deleted bigint", (t.count(), t.count_in_all_files("user_id", "7"), deleted))


@query("select event_id, user_id, case when event_type = 'click' then value end as value from events")
def evolve_on_append(spark, d):
    """SNK18: a new column is refused, or added where that is allowed; earlier rows have null"""
    t, e = table(spark), _events(spark, d)
    t.append(e.filter("event_type <> 'click'").select("event_id", "user_id"))
    late = e.filter("event_type = 'click'").select("event_id", "user_id", "value")
    try:
        t.append(late)
    except SchemaMismatch:
        t.append(late, merge_schema=True)
    return t.read()


@query("select count(*) as rows, 2::bigint as refused from orders")
def constraint_guard(spark, d):
    """SNK19: a CHECK and a NOT NULL stop a write as a whole"""
    t, o = table(spark), _orders(spark, d)
    t.create("o_orderkey bigint not null, o_custkey bigint, o_orderstatus string, o_orderpriority string")
    t.append(o)
    t.add_constraint("known", "o_orderstatus in ('O', 'F', 'P')")
    refused = 0
    for bad in (o.withColumn("o_orderstatus", F.lit("X")), o.withColumn("o_orderkey", F.lit(None).cast("bigint"))):
        try:
            t.append(bad)
        except ConstraintViolation:
            refused += 1
    return facts(spark, "rows bigint, refused bigint", (t.count(), refused))


@query("select event_id, user_id as account, cast(null as varchar) as value from events")
def rename_drop_add(spark, d):
    """SNK22: renamed without a rewrite; a name used again doesn't bring old values back"""
    t = table(spark)
    t.append(_events(spark, d).select("event_id", "user_id", "value"))
    files = set(t.state()["files"])
    t.rename_column("user_id", "account")
    t.drop_column("value")
    t.add_column("value", "string")
    assert set(t.state()["files"]) == files
    return t.read()


@query("select n_nationkey::bigint as n_nationkey, n_name from nation union all select n_nationkey + 10000000000, n_name from nation")
def widen_column(spark, d):
    """SNK23: int to bigint; earlier files are read as they are"""
    t, n = table(spark), read(spark, d, "nation").select("n_nationkey", "n_name")
    t.append(n)
    t.widen_column("n_nationkey", "bigint")
    t.append(n.withColumn("n_nationkey", F.col("n_nationkey").cast("bigint") + F.lit(10_000_000_000)))
    return t.read()


@query("select event_type, count(*) as events, 2::bigint as files from events group by 1")
def compact_files(spark, d):
    """SNK25, SNK27: many files to two; rows don't change"""
    t, e = table(spark), _events(spark, d)
    for part in ("event_type < 'm'", "event_type >= 'm'"):
        t.append(e.filter(part).repartition(4))
    t.compact(2, cluster_by=["user_id"])
    return t.read().groupBy("event_type").agg(F.count(F.lit(1)).alias("events")).withColumn("files", F.lit(len(t.active_files())).cast("bigint"))


@query("select event_id, user_id, event_type, value from events where user_id = 7 and value > 50")
def zorder_skips_files(spark, d):
    """SNK26, SRT3: along a Z-curve of two columns; statistics skip files for conditions on either"""
    t = table(spark)
    t.append(_events(spark, d))
    t.compact(8, zorder_by=["user_id", "value"])
    where = [("user_id", "=", 7), ("value", ">", 50)]
    assert len(t.pruned(t.state(), where)) < len(t.active_files())
    return t.read(where=where)


@query("select event_id, cast(ts as date) as event_date from events where cast(ts as date) = date '2024-01-10'")
def generated_date(spark, d):
    """SNK20: a date column follows from the timestamp and prunes files"""
    t, e = table(spark), read(spark, d, "events").select("event_id", "ts")
    t.create("event_id bigint, ts timestamp_ntz, event_date date", ["event_date"], generated={"event_date": ("date", "ts")})
    t.append(e)
    assert len(t.pruned(t.state(), [("event_date", "=", "2024-01-10")])) < len(t.active_files())
    return t.read(where=[("event_date", "=", "2024-01-10")]).select("event_id", "event_date")


@query("select count(*) as rows, 1::bigint as first, count(*) as last, count(*) as numbers from orders")
def identity_numbers(spark, d):
    """SNK21: two appends are numbered without a gap"""
    t, o = table(spark), read(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    t.create("o_orderkey bigint, o_orderstatus string, sk bigint", identity="sk")
    for part in ("o_orderstatus = 'F'", "o_orderstatus <> 'F'"):
        t.append(o.filter(part))
    return t.read().agg(F.count(F.lit(1)).alias("rows"), F.min("sk").alias("first"), F.max("sk").alias("last"), F.countDistinct("sk").alias("numbers"))


@query("select l_orderkey, l_linenumber, l_discount from lineitem where l_discount = 0.05 and l_tax <> 0.0")
def prune_with_nan(spark, d):
    """LOG2, SNK24: NaN is no bound for skipping files"""
    t = table(spark)
    t.append(read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.when(F.col("l_tax") == 0.0, F.lit(float("nan"))).otherwise(F.col("l_discount")).alias("l_discount")))
    return t.read(where=[("l_discount", "=", 0.05)])


@query("""select * from (values (0::bigint, 'CREATE', false), (1, 'APPEND', true), (2, 'DELETE', true), (3, 'UPDATE', true), (4, 'OPTIMIZE', false)) v(version, operation, data_change)
    join (select 0::bigint as version, 0::bigint as rows_added union all select 1, count(*) from events union all select unnest([2, 3, 4]), count(*) from events where event_type <> 'error') using (version)""")
def log_summaries(spark, d):
    """LOG1, LOG2, LOG3, LOG4, LOG8, LOG10: what each commit did"""
    t = table(spark)
    t.append(_events(spark, d).coalesce(1))
    t.delete("event_type = 'error'")
    t.update({"value": "0.0"}, "event_type = 'view'")
    t.compact(1)
    return facts(spark, "version bigint, operation string, data_change boolean, rows_added bigint", *[(s.version, s.operation, s.data_change, s.rows_added) for s in t.summaries()])


@query("select * from (values (0::bigint, 'CREATE'), (1, 'APPEND'), (2, 'MERGE'), (3, 'SET PROPERTIES'), (4, 'RESTORE')) v(version, operation)")
def history_operations(spark, d):
    """LOG16: the history as a table"""
    t, n = table(spark), read(spark, d, "nation").select("n_nationkey", "n_name")
    t.append(n)
    t.merge(n.withColumn("n_name", F.lower("n_name")), ["n_nationkey"])
    t.set_properties(owner="data")
    t.restore(1)
    return t.history().select("version", "operation")


@query("select count(*) as rows, 1::bigint as files, 1::bigint as version from nation")
def table_detail(spark, d):
    """LOG16, REM29"""
    t = table(spark)
    t.append(read(spark, d, "nation").coalesce(1))
    return t.detail().select("rows", "files", "version")


@query("""select (count(*) filter (event_type = 'click'))::bigint as inserted, (count(*) filter (event_type = 'view'))::bigint as updated, (count(*) filter (event_type = 'error'))::bigint as deleted, 0::bigint as changed_again from events""")
def merge_metrics(spark, d):
    """LOG11, LOG12, REM6: figures of a merge, and zeros where it finds nothing to do"""
    t, e = table(spark), _events(spark, d)
    t.append(e.filter("event_type <> 'click'"))
    source = e.filter("event_type in ('click', 'view', 'error')").withColumn("value", F.lit(-1.0))
    clauses = {"update_if": "s.event_type = 'view' and not (s.value <=> t.value)", "delete_if": "s.event_type = 'error'", "insert_if": "s.event_type <> 'error'"}
    before = t.version()
    t.merge(source, ["event_id"], **clauses)
    m, then = t.metrics_since(before), t.version()
    t.merge(source.filter("event_type <> 'error'"), ["event_id"], **{**clauses, "update_if": "not (s.value <=> t.value)"})
    return facts(spark, "inserted bigint, updated bigint, deleted bigint, changed_again bigint", (m["inserted"], m["updated"], m["deleted"], sum(t.metrics_since(then).values())))


@query("select o_orderpriority, count(*) as orders, 22::bigint as version from orders group by 1")
def checkpointed_log(spark, d):
    """LOG13: a state that is read from a checkpoint and a few commits"""
    t, o = table(spark), _orders(spark, d)
    t.append(o)
    for i in range(21):
        t.set_properties(step=str(i))
    assert [n for n in t.log.names("_log") if n.endswith(".checkpoint")]
    return t.read().groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("orders")).withColumn("version", F.lit(t.version()).cast("bigint"))


@query("select * from (values ('c_name', 'restricted'), ('c_acctbal', 'internal')) v(\"column\", level)")
def classified_columns(spark, d):
    """GOV15, GOV16, LOG17: a classification kept as properties; columns that don't exist are left out"""
    t = table(spark)
    t.append(read(spark, d, "customer"))
    t.classify({"c_name": "restricted", "c_acctbal": "internal", "c_phone": "restricted"})
    return facts(spark, "column string, level string", *t.classification().items())


@query("select true as in_log, true as in_files, count(*) as rows from customer")
def values_in_statistics(spark, d):
    """DIM10, GOV17: least and greatest values of a column stand in the log"""
    t, c = table(spark), read(spark, d, "customer")
    t.append(c)
    name = c.agg(F.min("c_name")).first()[0]
    return facts(spark, "in_log boolean, in_files boolean, rows bigint", (t.logs_with(name) > 0, t.count_in_all_files("c_name", name) > 0, t.count()))


@query("select o_orderkey, o_custkey, o_orderstatus, o_orderpriority from orders where o_orderstatus not in ('F', 'P')")
def conflict_and_retry(spark, d):
    """LOG6, LOG7, LOG14: two deletes from one version; the second is refused and tried again"""
    t, other = table(spark), None
    t.append(_orders(spark, d).coalesce(1))
    other = Table(spark, t.path)
    stale, tried = [t.state()], []

    def second():
        base = stale.pop() if stale else t.state()
        rows = t._frame(base).filter("o_orderstatus <> 'P'")
        return t._commit(base, "DELETE", t._write(rows, base), list(base["files"]), {"deleted": 0})

    other.delete("o_orderstatus = 'F'")
    retry_on_conflict(second, sleep=lambda s: tried.append(s), retry_on=(ConflictError,))
    assert tried
    return t.read()


@query("select event_id, event_type from events")
def racing_transaction(spark, d):
    """SNK11, LOG14, STR12: of two writers with one batch number, one counts"""
    t, e = table(spark), read(spark, d, "events").select("event_id", "event_type")
    slow = Table(spark, t.path)
    t.create(e.schema)
    late = slow._commit

    def overtaken(*args, **kw):
        t.append(e, txn=("load", 1))
        return late(*args, **kw)

    slow._commit = overtaken
    slow.append(e, txn=("load", 1))
    return t.read()


@query("select event_id, user_id, event_type, value from events")
def table_stream_rows(spark, d):
    """SRC7: the rows of committed files, once, with a compaction and a lost writer in between"""
    t, out, e = table(spark), table(spark), _events(spark, d)
    place = scratch(spark)
    for part in ("event_type < 'm'", "event_type >= 'm'"):
        t.append(e.filter(part))
        t._write(e, t.state())  # files of a writer that never committed
        t.compact(1)
        windows.drain(windows.table_stream(spark, t.path), place, windows.append_sink(out.path, "copy"))
    return out.read()


@query("select event_id, user_id, event_type, value from events")
def table_stream_after_update(spark, d):
    """SRC7: commits that change rows are passed over where asked"""
    t, out, e = table(spark), table(spark), _events(spark, d)
    t.create(e.schema, properties={"change_feed": "true"})
    t.append(e)
    t.update({"value": "0.0"}, "event_type = 'view'")
    windows.drain(windows.table_stream(spark, t.path, skip_changes=True), scratch(spark), windows.append_sink(out.path, "copy"))
    return out.read()


@query("select o_orderkey, o_custkey, o_orderstatus, o_orderpriority from orders where o_orderpriority is not null")
def merge_null_keys(spark, d):
    """SNK5, REM6: keys compared with <=>, so rows with a null key aren't inserted twice"""
    t, o = table(spark), _orders(spark, d).withColumn("o_custkey", F.when(F.col("o_orderstatus") != "P", F.col("o_custkey")))
    t.append(o)
    t.merge(o, ["o_orderkey", "o_custkey"], update_if=None, null_safe=True)
    return t.read().join(_orders(spark, d).select("o_orderkey", F.col("o_custkey").alias("c")), "o_orderkey").withColumn("o_custkey", F.col("c")).drop("c")


@query("select n_nationkey, n_name, true as kept from nation")
def managed_and_external(spark, d):
    """SNK34: dropping a managed table deletes its files, dropping an external one doesn't"""
    name, place = f"t{abs(hash(scratch(spark)))}", scratch(spark)
    n = read(spark, d, "nation").select("n_nationkey", "n_name")
    n.createOrReplaceTempView(f"{name}_source")
    spark.sql(f"create table {name}_m using parquet as select * from {name}_source")
    spark.sql(f"create table {name}_e using parquet location '{place}' as select * from {name}_source")
    kinds = [spark.sql(f"describe extended {name}_{k}").filter("col_name = 'Type'").first()["data_type"] for k in "me"]
    for k in "me":
        spark.sql(f"drop table {name}_{k}")
    spark.catalog.dropTempView(f"{name}_source")
    return spark.read.parquet(place).withColumn("kept", F.lit(kinds == ["MANAGED", "EXTERNAL"]))
