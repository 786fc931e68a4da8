"""The job queue as folds over events, in batch and as a stream.

Events are (job_id, seq, kind, at). A job is new, running, done, error or cancelled;
cancelled is final, a failure is retried ``attempts`` times with a delay that grows by a
minute each, and a deferral delays without using an attempt.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone import config

# Legal transitions.
EXPERIMENT = (("draft", "running"), ("running", "aggregated"), ("running", "failed"), ("aggregated", "concluded"))
INTEGRATION = (("draft", "active"), ("active", "unreachable"), ("unreachable", "active"), ("active", "disabled"), ("unreachable", "disabled"), ("disabled", "active"))

# Types of jobs.
HANDLERS = ("index_data", "embed_questions", "paraphrase_questions", "eval_run", "judge_answers", "pull_llm_model", "delete_llm_model", "check_mcp_health")

STATE = "status string, attempts int, wait_s long"


def _step(state: Column, kind: Column, most: int) -> Column:
    def to(status, attempts=None, wait=None):
        return F.struct(F.lit(status).alias("status") if isinstance(status, str) else status.alias("status"), (state["attempts"] if attempts is None else attempts).cast("int").alias("attempts"), (F.lit(0) if wait is None else wait).cast("long").alias("wait_s"))

    used = state["attempts"] + 1
    failed = F.when(used < most, to("new", used, used * config.BACKOFF_SECONDS)).otherwise(to("error", used))
    open_ = state["status"].isin("new", "running")
    return (
        F.when(state["status"] == "cancelled", state)
        .when((kind == "claim") & (state["status"] == "new"), to("running"))
        .when((kind == "complete") & (state["status"] == "running"), to("done"))
        .when((kind == "fail") & (state["status"] == "running"), failed)
        .when((kind == "defer") & (state["status"] == "running"), to("new", wait=F.lit(config.BACKOFF_SECONDS // 2)))
        .when((kind == "cancel") & open_, to("cancelled"))
        .otherwise(state)
    )


def job_states(events: DataFrame, most: int = config.WORKER_ATTEMPTS) -> DataFrame:
    """(job_id, status, attempts, wait_s) after all of a job's events in order."""
    start = F.struct(F.lit("new").alias("status"), F.lit(0).alias("attempts"), F.lit(0).cast("long").alias("wait_s"))
    kinds = F.array_sort(F.collect_list(F.struct("seq", "kind")))
    folded = events.groupBy("job_id").agg(F.aggregate(kinds, start, lambda s, e: _step(s, e["kind"], most)).alias("s"))
    return folded.select("job_id", "s.*")


def claim_next(jobs: DataFrame, now: Column, lane: str = "default") -> DataFrame:
    """The oldest due job of a lane."""
    due = jobs.filter((F.col("status") == "new") & (F.col("queue") == lane) & (F.col("apply_since") <= now))
    return due.orderBy("apply_since", "id").limit(1)


def claim_each_lane(jobs: DataFrame, now: Column) -> DataFrame:
    """The oldest due job of every lane, by partial minima."""
    due = jobs.filter((F.col("status") == "new") & (F.col("apply_since") <= now))
    first = F.min_by(F.struct(*jobs.columns), F.struct("apply_since", "id"))
    return due.groupBy(F.col("queue").alias("lane")).agg(first.alias("job")).select("job.*")


def claimed(jobs: DataFrame, now: Column) -> DataFrame:
    """jobs with the next one of each lane as running."""
    taken = claim_each_lane(jobs, now).select("id", F.lit("running").alias("now_"))
    return jobs.join(taken, "id", "left").withColumn("status", F.coalesce("now_", "status")).select(*jobs.columns)


def enqueue(jobs: DataFrame, fresh: DataFrame, now: Column) -> DataFrame:
    """jobs and fresh (type, queue, options) as new ones that are due at once. Ids are
    above all others and unequal, but not gapless, as tasks give them on their own."""
    top = jobs.agg(F.coalesce(F.max("id"), F.lit(0)).alias("top"))  # one row
    rows = fresh.select("type", "queue", "options").withColumn("n", F.monotonically_increasing_id()).join(F.broadcast(top), F.lit(True))
    rows = rows.select((F.col("top") + F.col("n") + 1).alias("id"), "type", "queue", F.lit("new").alias("status"), "options", now.alias("apply_since"))
    return jobs.unionByName(rows)


def unhandled(jobs: DataFrame, handlers=HANDLERS) -> DataFrame:
    """The jobs that fail as nothing handles their type: (id, error)."""
    return jobs.filter(~F.col("type").isin(*handlers)).select("id", F.concat(F.lit("no handler for type "), "type").alias("error"))


def readiness(jobs: DataFrame, models: DataFrame) -> DataFrame:
    """jobs with ``step``: run, or defer while the model in their options isn't ready, or
    pull where models (name, status) doesn't have it."""
    wanted = jobs.withColumn("model", F.get_json_object("options", "$.model"))
    known = models.select(F.col("name").alias("model"), F.col("status").alias("model_status"))
    step = F.when(F.col("model").isNull() | (F.col("model_status") == "ready"), "run").when(F.col("model_status").isNull(), "pull").otherwise("defer")
    return wanted.join(known, "model", "left").withColumn("step", step).select(*jobs.columns, "model", "step")


def pull_jobs(names: DataFrame) -> DataFrame:
    """(type, queue, options): a pull for every distinct model name."""
    named = names.select("name").distinct()
    return named.select(F.lit("pull_llm_model").alias("type"), F.lit("io").alias("queue"), F.to_json(F.struct("name")).alias("options"))


def pulled(models: DataFrame, name: str) -> DataFrame:
    """models after a pull: that one is ready."""
    return models.withColumn("status", F.when(F.col("name") == name, "ready").otherwise(F.col("status")))


def may_move(before: Column, after: Column, legal=INTEGRATION) -> Column:
    """Whether a status may follow another; staying is no move and always may be."""
    return (before == after) | F.concat_ws(">", before, after).isin(*[f"{a}>{b}" for a, b in legal])


def dependents(jobs: DataFrame) -> DataFrame:
    """(job, judge): the judging jobs of each evaluation's run that can still be stopped.
    A run names a handful of jobs; those without a run depend on nothing."""
    named = jobs.withColumn("_run", F.get_json_object("options", "$.run_name")).filter(F.col("_run").isNotNull())
    judges = named.filter((F.col("type") == "judge_answers") & F.col("status").isin("new", "running")).select(F.col("id").alias("judge"), "_run")
    return named.filter(F.col("type") == "eval_run").select(F.col("id").alias("job"), "_run").join(judges, "_run").select("job", "judge")


def cancelled(jobs: DataFrame, job_id: int) -> DataFrame:
    """jobs with one job cancelled and, for an evaluation, the judge of the same run;
    only what is new or running can be."""
    run = F.get_json_object("options", "$.run_name")
    own = jobs.filter((F.col("id") == job_id) & (F.col("type") == "eval_run")).select(run.alias("_run"))
    marked = jobs.withColumn("_name", run).join(F.broadcast(own.limit(1)), F.col("_name") == F.col("_run"), "left")
    hit = (F.col("id") == job_id) | ((F.col("type") == "judge_answers") & F.col("_run").isNotNull())
    open_ = F.col("status").isin("new", "running")
    return marked.withColumn("status", F.when(hit & open_, "cancelled").otherwise(F.col("status"))).select(*jobs.columns)


def illegal_transitions(history: DataFrame, legal=EXPERIMENT) -> DataFrame:
    """Steps of (entity, seq, status) that the machine doesn't allow."""
    pairs = F.array(*[F.lit(f"{a}>{b}") for a, b in legal])
    before = F.lag("status").over(Window.partitionBy("entity").orderBy("seq"))
    steps = history.withColumn("before", before).filter(F.col("before").isNotNull() & (F.col("before") != F.col("status")))
    return steps.filter(~F.array_contains(pairs, F.concat_ws(">", "before", "status")))


def probed(status: Column, error: Column) -> Column:
    """An integration's status after a probe: it flips between active and unreachable."""
    return F.when((status == "active") & error.isNotNull(), "unreachable").when((status == "unreachable") & error.isNull(), "active").otherwise(status)


def _folded(kinds: list[str], most: int) -> tuple[str, int, int]:
    """(status, attempts, delay) after a job's events in order, as job_states() has it."""
    status, attempts, wait = "new", 0, 0
    for kind in kinds:
        if status == "cancelled":
            break
        if kind == "claim" and status == "new":
            status, wait = "running", 0
        elif kind == "complete" and status == "running":
            status, wait = "done", 0
        elif kind == "fail" and status == "running":
            attempts += 1
            status, wait = ("new", attempts * config.BACKOFF_SECONDS) if attempts < most else ("error", 0)
        elif kind == "defer" and status == "running":
            status, wait = "new", config.BACKOFF_SECONDS // 2
        elif kind == "cancel" and status in ("new", "running"):
            status, wait = "cancelled", 0
    return status, attempts, wait


def job_state_stream(events: DataFrame, most: int = config.WORKER_ATTEMPTS) -> DataFrame:
    """job_states() of a stream: each trigger emits the jobs that had events. State is a
    job's own events, a few for each attempt, so that events which arrive in a later trigger
    than ones that follow them still count in their order."""

    def fold(key: tuple, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        held = list(zip(*state.get, strict=True)) if state.exists else []
        for part in parts:
            held += zip(part["seq"].tolist(), part["kind"].tolist(), strict=True)
        held.sort()
        state.update(([seq for seq, _ in held], [kind for _, kind in held]))
        status, attempts, wait = _folded([kind for _, kind in held], most)
        yield pd.DataFrame({"job_id": [key[0]], "status": [status], "attempts": [attempts], "wait_s": [wait]})

    return events.groupBy("job_id").applyInPandasWithState(fold, f"job_id long, {STATE}", "seqs array<long>, kinds array<string>", "update", "NoTimeout")
