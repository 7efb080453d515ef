"""Run bookkeeping: opening runs, closing them from states and errors, history and events."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from harborlane import schemas
from harborlane.functions import text, trace
from harborlane.operators import audit, positions

# Fixed values.
ERRORS_PER_TASK = 20
FAILED_STATES = ["failed", "upstream_failed"]


def open_runs(requests: DataFrame, now: Column, first_id: int = 1, run: str = "dag_run_id") -> DataFrame:
    """Run rows for requests; a request without an integration opens none.

    Ids are dense from ``first_id``. They are numbered in ranges of a hash of the run id, so an
    integration with very many requests still spreads over all ranges.
    """
    wanted = requests.where(F.col("integration_id").isNotNull()).select(
        "integration_id", F.col(run).alias("dag_run_id"), F.crc32(F.col(run)).alias("_hash")
    )
    numbered = positions.with_position(wanted, "_hash", [F.col("dag_run_id")], width=2**20)
    return numbered.select(
        (F.col("position") + first_id).alias("run_id"),
        "integration_id",
        "dag_run_id",
        now.alias("started"),
        F.lit(None).cast("timestamp_ntz").alias("ended"),
        F.lit(False).alias("is_success"),
        now.alias("execution_date"),
    )


def prepare_errors(requests: DataFrame) -> DataFrame:
    """The first missing setting of each run's conf (JSON text), as a pushed error.

    The problem is a generated column, so the filter on it stays above the conf, which is made once a
    row; a filter on a plain column would be moved down to the joins, with all that makes the conf.
    """

    def missing(name: str) -> Column:
        return F.coalesce(F.get_json_object("conf", f"$.{name}"), F.lit("")) == ""

    problem = F.when(missing("s3_bucket"), F.lit("s3_bucket")).when(
        missing("mongo_collection"), F.lit("mongo_collection")
    )
    found = requests.select("run_id", F.explode(F.array(problem)).alias("_problem"))
    # Code and message users see.
    return found.where(F.col("_problem").isNotNull()).select(
        "run_id",
        F.lit("prepare").alias("task_id"),
        F.lit("PREPARE_ERROR").alias("error_code"),
        F.concat(
            F.lit("Prepare failed: "), F.col("_problem"), F.lit(" is required in configuration")
        ).alias("message"),
        F.lit(1).alias("seq"),
    )


def first_errors(pushed: DataFrame, most: int = ERRORS_PER_TASK) -> DataFrame:
    """The first errors of each run's task, with code and message cut to their limits.

    Texts are cut first, so no long message is shuffled. Spark applies the rank limit in every
    task before the shuffle too, so a task with very many errors sends at most ``most`` rows from
    each.
    """
    short = pushed.select(
        "run_id",
        "task_id",
        text.capped(F.coalesce("error_code", F.lit("UNKNOWN")), text.ERROR_CODE_LIMIT).alias(
            "error_code"
        ),
        text.capped(F.coalesce("message", F.lit("")), text.ERROR_MESSAGE_LIMIT).alias("message"),
        "seq",
    )
    order = W.partitionBy("run_id", "task_id").orderBy("seq", "error_code", "message")
    ranked = short.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= most)
    return ranked.drop("_n", "seq")


def state_errors(states: DataFrame, pushed: DataFrame) -> DataFrame:
    """An error for each failed task that pushed none itself."""
    covered = pushed.select("run_id", "task_id").distinct()
    failed = states.where(
        F.col("task_id").isin(schemas.RUN_TASKS) & F.col("state").isin(FAILED_STATES)
    )
    # Codes and messages users see.
    return failed.join(covered, ["run_id", "task_id"], "left_anti").select(
        "run_id",
        "task_id",
        F.concat(F.lit("TASK_"), F.upper("state")).alias("error_code"),
        F.concat(
            F.lit("Task '"), F.col("task_id"), F.lit("' ended in state '"), F.col("state"), F.lit("'")
        ).alias("message"),
    )


def run_errors(states: DataFrame, pushed: DataFrame, now: Column) -> DataFrame:
    """All errors to store for the runs."""
    return (
        first_errors(pushed)
        .unionByName(state_errors(states, pushed))
        .withColumn("timestamp", now)
    )


def close_runs(runs: DataFrame, errors: DataFrame, now: Column) -> DataFrame:
    """Runs with their end and success: a run without errors succeeded."""
    counts = errors.groupBy("run_id").agg(F.count(F.lit(1)).alias("error_count"))
    n = F.coalesce("error_count", F.lit(0)).cast("bigint")
    return runs.join(counts, "run_id", "left").select(
        *[c for c in runs.columns if c not in ("ended", "is_success")],
        now.alias("ended"),
        (n == 0).alias("is_success"),
        n.alias("error_count"),
    )


def with_run_id(rows: DataFrame, runs: DataFrame) -> DataFrame:
    """Rows that name a run by ``dag_run_id``, with its ``run_id``; of several the smallest.

    Rows of a run that was not recorded have nothing to close and go.
    """
    known = runs.groupBy("dag_run_id").agg(F.min("run_id").alias("run_id"))
    return rows.join(known, "dag_run_id").drop("dag_run_id")


def runs_with_errors(runs: DataFrame, errors: DataFrame) -> DataFrame:
    """Each run next to its errors; runs without any keep one row."""
    return runs.join(
        errors.select("run_id", "task_id", "error_code", "message"), "run_id", "left"
    )


_RUN_ID = r"^(.+?)_([a-z0-9]+(?:_[a-z0-9]+)*?_ondemand)_(manual|scheduled|cdc)_(\d{8}_\d{6}(?:_\d)?)"


def with_run_id_parts(runs: DataFrame, column: str = "dag_run_id") -> DataFrame:
    """Tenant, workflow and source out of the run id."""

    def part(n: int) -> Column:
        found = F.regexp_extract(column, _RUN_ID, n)
        return F.when(found != "", found)

    return runs.withColumns(
        {"run_tenant": part(1), "run_workflow": part(2), "run_source": part(3)}
    )


def history(
    runs: DataFrame,
    tenant: str | None = None,
    source: str | None = None,
    workflow: str | None = None,
) -> DataFrame:
    """Runs newest first, by tenant prefix, trigger source and workflow name in the run id."""
    run = F.col("dag_run_id")
    tests = []
    if tenant:
        tests.append(run.startswith(tenant))
    if source:
        tests.append(run.contains(f"_{source}_"))
    if workflow:
        tests.append(run.contains(workflow))
    found = runs.where(reduce(lambda a, b: a & b, tests)) if tests else runs
    return found.orderBy(F.desc("execution_date"), F.desc("run_id"))


def row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """One row per table with its number of rows."""
    counted = [
        df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("table_name"), "n")
        for name, df in tables.items()
    ]
    return reduce(DataFrame.unionByName, counted)


def is_ready(df: DataFrame, column: str, day: Column) -> DataFrame:
    """One row: whether the table has rows of that day; reading stops at the first."""
    return df.where(F.to_date(column) == day).limit(1).agg(
        (F.count(F.lit(1)) > 0).alias("ready")
    )


def run_events(dag_runs: DataFrame, now: Column, actor: str = "run-scheduler") -> DataFrame:
    """Audit events from run state changes of on-demand workflows.

    ``dag_runs`` has dag_id, dag_run_id, state, conf (JSON text) and message.
    """
    state = F.col("state")
    kind = (
        F.when(state == "running", "integration.run.started")
        .when(state == "success", "integration.run.completed")
        .when(state == "failed", "integration.run.failed")
    )
    watched = dag_runs.where(F.col("dag_id").endswith("_ondemand") & kind.isNotNull())
    value = _conf_value
    return audit.build_events(
        watched,
        now,
        identity=[F.col("dag_run_id"), state],
        customer_guid=F.coalesce(value("customer_guid"), F.lit("unknown")),
        event_type=kind,
        actor_id=F.lit(actor),
        actor_type=F.lit("system"),
        resource_type=F.lit("integration"),
        resource_id=F.coalesce(value("integration_id"), F.lit("")),
        action=F.when(state == "running", "start").otherwise("complete"),
        outcome=F.when(state == "failed", "failure").otherwise("success"),
        trace_id=trace.trace_id(value("traceparent")),
        metadata=F.struct(
            "dag_id",
            "dag_run_id",
            F.when(state == "running", F.coalesce(value("tenant_id"), F.lit(""))).alias("tenant_id"),
            F.when(state == "failed", F.col("message")).alias("error"),
        ),
    )


def _conf_value(name: str) -> Column:
    return F.get_json_object("conf", f"$.{name}")


# What a finished task means, as event, resource and action.
TASK_EVENTS = {
    "prepare": ("auth.accessed", "credentials", "access"),
    "execute": ("data.destination.written", "integration", "write"),
    "cleanup": ("auth.cleared", "credentials", "clear"),
    "find_due_integrations": ("integration.dispatched", "controller", "dispatch"),
}
DISPATCHER = "find_due_integrations"


def task_events(
    tasks: DataFrame, now: Column, worker: str = "run-worker", scheduler: str = "run-scheduler"
) -> DataFrame:
    """Audit events from finished tasks, by ``worker``, or by ``scheduler`` for the dispatcher.

    ``tasks`` has dag_id, dag_run_id, task_id, state, conf (JSON text) and message. A failed task
    gives ``task.{id}.failed``; a successful one the event of its kind, or none.
    """
    failed = F.col("state") == "failed"
    task = F.col("task_id")

    def mapped(position: int) -> Column:
        pairs = [F.lit(x) for key, row in TASK_EVENTS.items() for x in (key, row[position])]
        return F.element_at(F.create_map(*pairs), task)

    known = tasks.where(
        failed | ((F.col("state") == "success") & task.isin(list(TASK_EVENTS)))
    )
    value = _conf_value
    resource = (
        F.when(failed, task)
        .when(task == DISPATCHER, F.col("dag_id"))
        .when(task == "execute", F.coalesce(value("integration_id"), F.lit("")))
        .otherwise(F.coalesce(value("workspace_id"), F.lit("")))
    )
    return audit.build_events(
        known,
        now,
        identity=[F.col("dag_run_id"), task, F.col("state")],
        customer_guid=F.coalesce(value("customer_guid"), F.lit("unknown")),
        event_type=F.when(failed, F.concat(F.lit("task."), task, F.lit(".failed"))).otherwise(
            mapped(0)
        ),
        actor_id=F.when(~failed & (task == DISPATCHER), scheduler).otherwise(worker),
        actor_type=F.lit("system"),
        resource_type=F.when(failed, F.lit("task")).otherwise(mapped(1)),
        resource_id=resource,
        action=F.when(failed, F.lit("execute")).otherwise(mapped(2)),
        outcome=F.when(failed, F.lit("failure")).otherwise(F.lit("success")),
        trace_id=trace.trace_id(value("traceparent")),
        metadata=F.struct(
            "dag_id",
            F.when(failed, F.col("dag_run_id")).alias("dag_run_id"),
            "task_id",
            F.when(failed, text.capped(F.col("message"), text.AUDIT_ERROR_LIMIT)).alias("error"),
        ),
    )
