"""Workflow runs replayed against their journals, and the events they wait for."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def replay(requests: DataFrame, journal: DataFrame) -> DataFrame:
    """Where each run stands: completed, failed, suspended or mismatch, at which step, and the steps it newly asks for.

    `requests` is what a handler asks for in order (workflow_id, step_number, kind, name, args), `journal` what has been
    written (the same columns, state, result, error). A run goes on over steps that succeeded and stops at the first
    that did not: a journal entry of another kind, name or arguments is a mismatch, a failed step fails the run, a
    pending one suspends it, and a step that is not in the journal suspends it as new.
    """
    j = journal.select("workflow_id", "step_number", *[F.col(c).alias(f"_{c}") for c in ("kind", "name", "args", "state", "error")], F.lit(True).alias("_there"))
    met = requests.join(j, ["workflow_id", "step_number"], "left")
    same = F.col("kind").eqNullSafe(F.col("_kind")) & F.col("name").eqNullSafe(F.col("_name")) & F.col("args").eqNullSafe(F.col("_args"))
    stop = F.when(F.col("_there").isNull(), "new").when(~same, "mismatch").when(F.col("_state") == "failed", "failed").when(F.col("_state") != "success", "pending")
    stops = met.withColumn("_stop", stop)
    first = F.min(F.when(F.col("_stop").isNotNull(), F.struct("step_number", "_stop", "name", "_error"))).alias("s")
    ends = stops.groupBy("workflow_id").agg(first, F.max("step_number").alias("_last"))
    outcome = F.when(F.col("s").isNull(), "completed").when(F.col("s._stop").isin("new", "pending"), "suspended").otherwise(F.col("s._stop"))
    return ends.select(
        "workflow_id",
        outcome.alias("outcome"),
        F.col("s.step_number").alias("at_step"),
        F.when(F.col("s._stop") == "new", F.col("s.name")).alias("new_step"),
        F.when(F.col("s._stop") == "failed", F.coalesce("s._error", F.lit("step failed"))).alias("error"),
    )


def send_events(events: DataFrame, steps: DataFrame, sent: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(event rows, steps) after events (workflow_id, name, payload, seq) were sent.

    The first one to a waiting event of that name is received, and its pending step succeeds with the payload; others
    do nothing. Sends to runs that are not there, or not waiting, do nothing either.
    """
    keys = ["workflow_id", "name"]
    first = sent.groupBy(*keys).agg(F.min_by(F.struct("payload"), "seq").alias("_p"))
    waiting = events.where("state = 'waiting'").groupBy(*keys).agg(F.min("event_id").alias("event_id")).join(first, keys)
    hit = waiting.select("event_id", "_p", F.lit(True).alias("_hit"))
    got = events.join(hit, "event_id", "left")
    mine = F.coalesce("_hit", F.lit(False))
    done = got.withColumn("state", F.when(mine, "received").otherwise(F.col("state"))).withColumn("payload", F.when(mine, F.col("_p.payload")).otherwise(F.col("payload")))
    due = steps.where("kind = 'waitForEvent' and state = 'pending'").join(waiting.select(*keys), keys, "left_semi").groupBy(*keys).agg(F.min("step_number").alias("step_number"))
    due = due.join(waiting.select(*keys, "_p"), keys).select("workflow_id", "step_number", "_p", F.lit(True).alias("_due"))
    met = steps.join(due, ["workflow_id", "step_number"], "left")
    mine = F.coalesce("_due", F.lit(False))
    after = met.withColumn("state", F.when(mine, "success").otherwise(F.col("state"))).withColumn("result", F.when(mine, F.col("_p.payload")).otherwise(F.col("result")))
    return done.select(*events.columns), after.select(*steps.columns)


def with_args(jobs: DataFrame, args: DataFrame) -> DataFrame:
    """Jobs with their arguments, which lie in a table of their own; a job without any has null."""
    return jobs.join(args.groupBy("job_id").agg(F.first("args").alias("args")), "job_id", "left")


def status(workflows: DataFrame, workflow_id) -> DataFrame:
    """One run as a caller sees it."""
    return workflows.where(F.col("workflow_id") == workflow_id).select("workflow_id", "state", "result", "error")
