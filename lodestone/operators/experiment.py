"""Experiments from draft to results, as a chain of stages over tables.

A state is three tables: questions, logs and experiments. Each stage makes the rows that
are owed and leaves the others as they are, so a stage can be run again at any point: a
chain that was broken off goes on where it stopped, and a finished one changes nothing.
Tables are written between stages; model calls are made for owed rows only.

* paraphrase: the paraphrased set of each base question, those not there yet;
* embed: vectors of questions without one;
* start: drafts become running, with a run for each value of the parameter;
* answer: a log for every question of a running experiment's set and every of its runs;
* judge: the axes that logs owe, up to the limit of attempts;
* aggregate: a running experiment whose runs have logs and none to judge gets its results
  and its finish time, once; only running ones move.

questions: (id, original_text, set_name, language, text_hash, reference_answer,
marked_sources, embedding). logs: (id, run_name, question_id, question, answered, answer,
context, sources array<struct<source>>, reference_answer, marked_sources, faithfulness,
relevance, completeness, metrics as JSON text). experiments: (id, name, set_name, param,
param_values, run_names, status, started_at, finished_at, elapsed, results).
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone import config, storage
from lodestone.functions import text
from lodestone.functions.numeric import exact_round
from lodestone.operators import evals, flows, models, stats
from lodestone.operators.searchindex import SearchIndex

#: What an experiment may vary, and the field of the search that it sets.
PARAMETERS: dict[str, Callable[[str], tuple[str, object]]] = {
    "k": lambda v: ("limit", int(v)),
    "distance_threshold": lambda v: ("distance_threshold", float(v)),
    "rerank": lambda v: ("rerank", v.lower() == "true"),
}
LOG = (
    "id long, run_name string, question_id long, question string, answered boolean, answer string, context string, sources array<struct<source:string>>, reference_answer string, "
    "marked_sources array<string>, faithfulness string, relevance string, completeness string, metrics string"
)
_METRICS = "map<string,struct<reason:string,error:string,attempts:int>>"


@dataclass(frozen=True)
class State:
    questions: DataFrame
    logs: DataFrame
    experiments: DataFrame


def _reply(score: Column) -> Column:
    return F.to_json(F.struct(F.lit("shared words").alias("reason"), score.alias("score")))


def offline_judge() -> dict[str, Column]:
    """A reply for each axis from shared words."""
    return {
        "faithfulness": _reply(models.overlap_judge(F.col("answer"), F.col("context"))),
        "relevance": _reply(models.overlap_judge(F.col("question"), F.col("answer"))),
        "completeness": _reply(models.overlap_judge(F.col("reference_answer"), F.col("answer"))),
    }


@dataclass(frozen=True)
class Services:
    """What the stages call: the index, the models and the clock (a timestamp column)."""

    index: SearchIndex
    now: Column
    embed: Callable[[Column], Column] = field(default_factory=models.embedder)
    rewrite: Callable[[Column], Column] = models.paraphrase
    generate: Callable[[Column], Column] = models.extractive_answer
    replies: Callable[[], dict[str, Column]] = offline_judge
    base: config.SearchConfig = field(default_factory=config.SearchConfig)
    paraphrases: tuple[tuple[str, str], ...] = ()  # (base set, its paraphrased set)


STAGES: dict[str, Callable[[State, Services], State]] = {}


def stage(function: Callable[[State, Services], State]) -> Callable[[State, Services], State]:
    """Register a stage; stages run in the order in which they are registered."""
    STAGES[function.__name__] = function
    return function


@stage
def paraphrase(state: State, with_: Services) -> State:
    held = state.questions
    for base, target in with_.paraphrases:
        own = held.filter(F.col("set_name") == base)
        made = own.select(with_.rewrite(F.col("original_text")).alias("original_text"), "language", "reference_answer", "marked_sources").filter("original_text is not null").withColumn("text_hash", text.text_hash(F.col("original_text")))
        fresh = made.groupBy("text_hash").agg(*[F.min_by(c, "original_text").alias(c) for c in ("original_text", "language", "reference_answer", "marked_sources")])
        fresh = fresh.join(held.select("text_hash"), "text_hash", "left_anti")
        rows = fresh.select(F.xxhash64("text_hash").alias("id"), "original_text", F.lit(target).alias("set_name"), "language", "text_hash", "reference_answer", "marked_sources", F.lit(None).cast("array<float>").alias("embedding"))
        held = held.unionByName(rows)
    return replace(state, questions=held)


@stage
def embed(state: State, with_: Services) -> State:
    return replace(state, questions=models.backfilled(state.questions, with_.embed).select(*state.questions.columns))


@stage
def start(state: State, with_: Services) -> State:
    draft = F.col("status") == "draft"
    runs = F.transform("param_values", lambda v: text.run_name(F.col("name"), F.col("param"), v))
    moved = {"run_names": F.when(draft, runs).otherwise(F.col("run_names")), "started_at": F.when(draft, with_.now).otherwise(F.col("started_at")), "status": F.when(draft, "running").otherwise(F.col("status"))}
    return replace(state, experiments=state.experiments.select(*[moved[c].alias(c) if c in moved else F.col(c) for c in state.experiments.columns]))


def owed_logs(state: State) -> DataFrame:
    """The questions of running experiments with each run that has no log of them:
    (run_name, param, value, question's columns)."""
    runs = state.experiments.filter("status = 'running'").select("set_name", "param", F.explode(F.arrays_zip("run_names", "param_values")).alias("r"))
    pairs = runs.select("set_name", "param", F.col("r.run_names").alias("run_name"), F.col("r.param_values").alias("value")).join(state.questions, "set_name")
    return pairs.join(state.logs.select("run_name", F.col("question_id").alias("id")), ["run_name", "id"], "left_anti")


@stage
def answer(state: State, with_: Services) -> State:
    owed = storage.cut(owed_logs(state), "owed")
    logs = state.logs
    for r in sorted(owed.select("param", "value").distinct().collect()):  # values, not questions
        key, value = PARAMETERS[r.param](r.value)
        cfg = replace(with_.base, **{key: value})
        mine = owed.filter((F.col("param") == r.param) & (F.col("value") == r.value)).withColumn("query_id", F.xxhash64("run_name", "id"))
        made = flows.answer(with_.index, mine.select("query_id", F.col("original_text").alias("question"), "language"), with_.embed, with_.generate, cfg)
        rows = made.drop("question").join(mine, "query_id")
        none = F.lit(None).cast("string")
        listed = F.transform("sources", lambda s: F.struct(s.alias("source")))
        fresh = rows.select(F.col("query_id").alias("id"), "run_name", F.col("id").alias("question_id"), F.col("original_text").alias("question"), "answered", "answer", "context", listed.alias("sources"), "reference_answer", "marked_sources", none.alias("faithfulness"), none.alias("relevance"), none.alias("completeness"), F.lit("{}").alias("metrics"))
        logs = logs.unionByName(fresh)
    return replace(state, logs=logs)


@stage
def judge(state: State, with_: Services) -> State:
    found = storage.cut(flows.judged(state.logs.withColumn("metrics", F.parse_json("metrics")), with_.replies()), "verdicts")
    by_log = found.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("axis", F.struct("score", "reason", "error", "attempts")))).alias("said"))  # an axis each
    rows = state.logs.join(by_log, "id", "left")
    now = F.transform_values("said", lambda k, v: F.struct(v["reason"].alias("reason"), v["error"].alias("error"), F.when(v["error"].isNotNull(), v["attempts"]).alias("attempts")))
    held = F.coalesce(F.from_json("metrics", _METRICS), F.create_map().cast(_METRICS))
    merged = F.map_concat(F.map_filter(held, lambda k, _: ~F.array_contains(F.map_keys("said"), k)), now)
    scores = {axis: F.coalesce(F.try_element_at("said", F.lit(axis))["score"].cast("string"), F.col(axis)) for axis in evals.AXES}
    changed = {**scores, "metrics": F.when(F.col("said").isNull(), F.col("metrics")).otherwise(F.to_json(merged))}
    return replace(state, logs=rows.select(*[changed[c].alias(c) if c in changed else F.col(c) for c in state.logs.columns]))


@stage
def aggregate(state: State, with_: Services) -> State:
    due = flows.complete(state.experiments, state.logs).join(state.experiments, "id").collect()  # the experiments that end now
    if not due:
        return state
    spark = state.experiments.sparkSession
    results = [(r.id, json.dumps(results_of(r.param, r.param_values, r.run_names, state.logs), ensure_ascii=False)) for r in sorted(due, key=lambda r: r.id)]
    made = F.broadcast(spark.createDataFrame(results, "id long, _results string"))
    rows = state.experiments.join(made, "id", "left")
    won = F.col("_results").isNotNull() & (F.col("status") == "running")
    seconds = (F.unix_micros(with_.now.cast("timestamp")) - F.unix_micros(F.col("started_at").cast("timestamp"))) / 1e6
    moved = {"status": F.when(won, "aggregated"), "results": F.when(won, F.col("_results")), "finished_at": F.when(won, with_.now), "elapsed": F.when(won, exact_round(seconds, 1))}
    return replace(state, experiments=rows.select(*[F.coalesce(moved[c], F.col(c)).alias(c) if c in moved else F.col(c) for c in state.experiments.columns]))


def results_of(param: str, values: list[str], runs: list[str], logs: DataFrame) -> dict:
    """The results document of one experiment: a few numbers for each run and test."""
    own = logs.filter(F.col("run_name").isin(runs))
    position = F.element_at(F.create_map(*[x for i, r in enumerate(runs) for x in (F.lit(r), F.lit(i))]), F.col("run_name"))
    metrics = storage.cut(evals.run_metrics(own).withColumn("position", position), "metrics")
    placed = stats.composite(metrics).orderBy("place").collect()
    by_run, value_of = {r.run_name: r for r in metrics.collect()}, dict(zip(runs, values, strict=True))
    tests = {(r.comparison, r.axis): r for r in stats.bonferroni(stats.pairwise(stats.winner_deltas(own, metrics))).collect()} if len(runs) > 1 else {}
    fields = (*evals.AXES, "hit_at_k", "mrr", "refusal_accuracy", "n_scored")
    winner = placed[0].run_name if placed else None

    def test(run: str, axis: str) -> dict | None:
        r = tests.get((f"{winner} vs {run}", axis))
        return r and {"mean_delta": r.delta, "ci95": [r.ci_low, r.ci_high], "p": r.p, "n": r.n, "significant_raw": r.significant_raw, "significant_bonferroni": r.significant_corrected}

    return {
        "param": param,
        "per_value": {v: {"run_name": r, **{f: getattr(by_run[r], f) for f in fields}} for v, r in zip(values, runs, strict=True)},
        "composite": {
            "method": "rrf",
            "k": config.RRF_K,
            "axes": list(evals.AXES),
            "ranking": [{"value": value_of[r.run_name], "rrf": round(r.rrf, 5)} for r in placed],
            "winner": value_of.get(winner),
            "pairwise": {
                "comparisons": {f"{value_of[winner]}_vs_{value_of[run]}": {axis: test(run, axis) for axis in evals.AXES} for run in runs if run != winner},
                "method": "bonferroni",
                "alpha": 0.05,
                "tests": len(tests),
                "threshold": next((r.threshold for r in tests.values()), None),
            },
        },
    }


def advance(state: State, with_: Services, upto: str | None = None) -> State:
    """The state after all stages, or after those up to one of them; each stage's tables
    are written before the next begins."""
    for name, run in STAGES.items():
        before, state = state, run(state, with_)
        state = State(*[after if after is held else storage.cut(after, f"{name}-{table}") for table, after, held in ((t, getattr(state, t), getattr(before, t)) for t in ("questions", "logs", "experiments"))])
        if name == upto:
            break
    return state
