"""The medallion pipeline over event files, and its commands."""

from __future__ import annotations

import argparse
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import history, quality, star
from .ops.tracking import Settings, TableSink, get_settings, track_step
from .session import get_spark
from .sources import files
from .storage.table import Table
from .streaming.windows import append_sink, drain, table_stream

RULES = (quality.Expectation("has_id", "event_id is not null", "drop"), quality.Expectation("has_date", "event_date is not null", "drop"), quality.Expectation("has_repo", "repo_id is not null", "warn"), quality.Expectation("not_in_future", "created_at <= current_timestamp()", "warn"))
COUNTS = {
    "pushes": "event_type = 'PushEvent'", "prs_opened": "event_type = 'PullRequestEvent' and action = 'opened'", "prs_merged": "event_type = 'PullRequestEvent' and action = 'merged'", "prs_closed_unmerged": "event_type = 'PullRequestEvent' and action = 'closed'",
    "issues_opened": "event_type = 'IssuesEvent' and action = 'opened'", "issues_closed": "event_type = 'IssuesEvent' and action = 'closed'", "stars": "event_type = 'WatchEvent'", "forks": "event_type = 'ForkEvent'", "releases": "event_type = 'ReleaseEvent'", "bot_events": "is_bot",
}


def run_bronze(spark: SparkSession, s: Settings) -> dict[str, int]:
    """Landed files to the bronze table, each once."""
    table = Table(spark, s.path("bronze", "events"))
    before = table.count() if table.exists() else 0
    drain(files.with_lineage(files.event_stream(spark, s.path("landing", "events"))), s.checkpoint("bronze_events"), append_sink(table.path, "bronze_events"))
    return {"rows_written": (table.count() if table.exists() else 0) - before}


def run_silver(spark: SparkSession, s: Settings) -> dict[str, int]:
    """New bronze rows, typed and deduplicated, merged by event id; rows without id or date go to quarantine first. Then the repositories' history."""
    events, repos, bad = Table(spark, s.path("silver", "events")), Table(spark, s.path("silver", "repo_history")), Table(spark, s.path("quarantine", "events"))
    written = {"rows_written": 0}

    def write(batch, number: int) -> None:
        good, rejected = quality.split_rows(files.typed_events(batch), RULES)
        rows = files.dedup_events(good).persist()
        try:
            events.create(rows.schema, ["event_date"])
            m = events.merge(rows, ["event_date", "event_id"], update_if="s._content_hash != t._content_hash", txn=("silver_events", number))
            written["rows_written"] += m["inserted"] + m["updated"]
            bad.append(rejected, merge_schema=True, txn=("silver_events", number))
            seen = rows.select("repo_id", "repo_name", "created_at")
            known = repos.read().join(seen.select("repo_id").distinct(), "repo_id", "left_semi") if repos.exists() else None
            apply_history(repos, history.scd2_history(seen, ["repo_id"], ["repo_name"], "created_at", known), known, ["repo_id"], ("silver_repos", number))
        finally:
            rows.unpersist()

    drain(table_stream(spark, s.path("bronze", "events")), s.checkpoint("silver_events"), write)
    return written


def apply_history(table: Table, versions: DataFrame, known: DataFrame | None, keys: list[str], txn: tuple[str, int] | None = None) -> dict[str, int]:
    """Bring a stored history to the versions computed for some keys: new ones in, changed ones updated, redundant ones out, in one commit."""
    table.create(versions.schema)
    at = [*keys, "valid_from"]
    marked = versions
    if known is not None:
        gone = known.join(versions.select(at), at, "left_anti").withColumn("row_hash", F.lit(None).cast("string"))
        marked = marked.unionByName(gone.select(versions.columns))
    return table.merge(marked, at, update_if="not (s.row_hash <=> t.row_hash and s.valid_to <=> t.valid_to)", delete_if="s.row_hash is null", txn=txn)


def run_gold(spark: SparkSession, s: Settings) -> dict[str, int]:
    """The star schema, each table replaced in one commit."""
    events, repos = Table(spark, s.path("silver", "events")).read(), Table(spark, s.path("silver", "repo_history")).read()
    low, high = events.agg(F.min("event_date"), F.max("event_date")).first()
    out: dict[str, Any] = {"dim_date": star.dim_date(spark, low, high)}
    out["dim_actor"] = star.dim_latest(events, "actor_id", ["actor_login", "is_bot"], "created_at", "event_id")
    out["dim_repo"] = star.with_unknown(repos, sk=history.UNKNOWN, repo_name="unknown", is_current=True, valid_from="1900-01-01")
    out["fct_events"] = star.fact_with_versions(events, repos, ["repo_id"], "created_at").select("event_id", star.date_key().alias("date_key"), "sk", F.coalesce(F.when(F.col("actor_id").isNotNull(), F.xxhash64("actor_id")), F.lit(history.UNKNOWN)).alias("actor_sk"), "repo_id", "event_type", "action", "event_date")
    out["fct_repo_daily"] = star.daily_fact(events, ["repo_id"], "event_date", COUNTS, {"distinct_actors": "actor_id"})
    rows = {}
    for name, df in out.items():
        rows[name] = Table(spark, s.path("gold", name)).overwrite(df, schema_too=True, cluster_by=["date_key"] if "date_key" in df.columns else [])["inserted"]
    return rows | {"rows_written": sum(rows.values())}


def run_quality(spark: SparkSession, s: Settings, contract: str | None = None) -> dict[str, Any]:
    """Rule metrics of the silver events, and a contract if there is one."""
    events = Table(spark, s.path("silver", "events")).read()
    if contract:
        quality.enforce_contract(events, quality.load_contract(contract))
    result = quality.apply_expectations(events, RULES)
    Table(spark, s.path("ops", "rule_metrics")).append(result.metrics_df().withColumn("checked_at", F.current_timestamp()))
    return {"metrics": result.metrics, "rows_read": result.metrics[0]["rows"]}


STEPS = {"bronze": run_bronze, "silver": run_silver, "gold": run_gold, "quality": run_quality}


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="lakeloom")
    parser.add_argument("step", choices=[*STEPS, "all"])
    step = parser.parse_args(argv).step
    s, spark = get_settings(), get_spark()
    for name in STEPS if step == "all" else [step]:
        with track_step("medallion", name, TableSink(spark, s.path("ops", "pipeline_runs")), spark) as run:
            out = STEPS[name](spark, s)
            run.rows_read, run.rows_written = out.get("rows_read"), out.get("rows_written")
            print(name, out)


if __name__ == "__main__":
    main()
