"""The chain from draft to results against plain code, broken off and run again."""

from __future__ import annotations

import json
import random
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone import config
from lodestone.functions import text
from lodestone.operators import experiment, models, stats
from lodestone.plans import base

EXPERIMENTS = "id long, name string, set_name string, param string, param_values array<string>, run_names array<string>, status string, started_at timestamp, finished_at timestamp, elapsed double, results string"
QUESTIONS = "id long, original_text string, set_name string, language string, text_hash string, reference_answer string, marked_sources array<string>, embedding array<float>"


def state_of(spark, texts, experiments):
    rows = [(i, t, "base", "en", None, f"reference {i}" if i % 2 else None, ["src1"] if i % 3 else None, None) for i, t in enumerate(texts)]
    questions = spark.createDataFrame(rows, QUESTIONS).withColumn("text_hash", text.text_hash(F.col("original_text")))
    return experiment.State(questions, spark.createDataFrame([], experiment.LOG), spark.createDataFrame(experiments, EXPERIMENTS))


def rows_of(state):
    return {name: sorted(map(str, getattr(state, name).collect())) for name in ("questions", "logs", "experiments")}


@pytest.fixture
def services(spark, sf_dir):
    asked = spark.sparkContext.accumulator(0)

    def backend(texts):
        asked.add(len(texts))
        return models.hashed_embedding(texts)

    made = experiment.Services(base.index(spark, sf_dir), F.lit("2024-01-01 00:01:00").cast("timestamp"), models.embedder(backend), base=config.SearchConfig(distance_threshold=2.0), paraphrases=(("base", "para"),))
    return asked, made


def draft(i, values=("1", "2"), status="draft"):
    return (i, f"e{i}", "para", "k", list(values), None, status, None, None, None, None)


def test_a_chain_broken_off_goes_on(spark, services):
    asked, with_ = services
    start = state_of(spark, ["ti er one", "second question", "third one here"], [draft(1), draft(2, status="concluded")])
    whole = experiment.advance(start, with_)
    calls = asked.value
    assert calls == 6 + 2 * 3  # six vectors of questions; a search of each run for each question
    part = experiment.advance(start, with_, upto="answer")
    assert part.experiments.filter("id = 1").first().status == "running" and part.logs.count() == 6
    rest = experiment.advance(part, with_)
    assert rows_of(rest) == rows_of(whole)
    calls = asked.value
    later = replace(with_, now=F.lit("2025-05-05 00:00:00").cast("timestamp"))
    assert rows_of(experiment.advance(rest, later)) == rows_of(whole) and asked.value == calls  # no call is made again
    done = {r.id: r for r in whole.experiments.collect()}
    assert (done[1].status, done[1].run_names, done[2].status, done[2].results) == ("aggregated", ["e1_k_01", "e1_k_02"], "concluded", None)
    assert str(done[1].finished_at) == "2024-01-01 00:01:00" and json.loads(done[1].results)["param"] == "k"
    logs = whole.logs.collect()
    assert {(r.run_name, r.question_id) for r in logs} == {(run, q.id) for run in done[1].run_names for q in whole.questions.filter("set_name = 'para'").collect()}
    assert all(len(r.sources) <= int(r.run_name[-1]) and r.faithfulness is not None and (r.completeness is None) == (r.reference_answer is None) for r in logs)


def test_an_experiment_with_failing_judges_waits(spark, services):
    _, with_ = services
    state = state_of(spark, ["ti er one"], [draft(1, ("1",))])
    broken = replace(with_, replies=lambda: {axis: F.lit("no json") for axis in stats.AXES})
    for tried in (1, 2, 3, 3):
        state = experiment.advance(state, broken)
        log = state.logs.first()
        assert json.loads(log.metrics)["relevance"] == {"error": "invalid_json", "attempts": tried} and log.relevance is None
    assert state.experiments.first().status == "running"  # three attempts an axis, and no results without scores


def test_of_a_partly_judged_log_the_rest_is_judged(spark, services):
    _, with_ = services
    state = experiment.advance(state_of(spark, ["ti er one"], [draft(1, ("1",))]), with_, upto="answer")
    state = replace(state, logs=state.logs.withColumn("relevance", F.lit("9")).withColumn("metrics", F.lit('{"faithfulness":{"error":"invalid_json","attempts":2}}')))
    log = experiment.advance(state, with_).logs.first()
    assert log.relevance == "9" and log.faithfulness is not None
    assert json.loads(log.metrics)["faithfulness"] == {"reason": "shared words"}


def plain_results(values, runs, logs):
    """The document from the logs, in plain code; intervals and p apart."""

    def mean(xs):
        xs = [int(x) for x in xs if x is not None]
        return round(sum(xs) / len(xs), 2) if xs else None

    per = {}
    for v, run in zip(values, runs):
        own = [r for r in logs if r[1] == run]
        inside = [r for r in own if r[9]]
        ranks = [next((i for i, (s,) in enumerate(r[7], 1) if any(m in s for m in r[9])), None) for r in inside]
        pool = [r for r in own if not r[9]]
        right = [r for r in pool if (int(r[10]) if r[10] else 0) >= 7 or not r[4]]
        n = len(inside) or 1
        per[v] = {
            "run_name": run, "faithfulness": mean(r[10] for r in inside), "relevance": mean(r[11] for r in inside), "completeness": mean(r[12] for r in own),
            "hit_at_k": round(sum(x is not None for x in ranks) / n, 3), "mrr": round(sum(1 / x for x in ranks if x) / n, 3), "refusal_accuracy": f"{len(right)}/{len(pool)}", "n_scored": sum(r[10] is not None for r in inside),
        }
    scores = dict.fromkeys(values, 0.0)
    for axis in stats.AXES:
        for rank, v in enumerate(sorted((v for v in values if per[v][axis] is not None), key=lambda v: per[v][axis], reverse=True), 1):
            scores[v] += 1 / (60 + rank)
    ranking = sorted(scores.items(), key=lambda kv: kv[1], reverse=True)
    winner = ranking[0][0]
    last = {r[2]: r for r in logs if r[1] == per[winner]["run_name"]}
    deltas = {}
    for v, run in zip(values, runs):
        if v != winner:
            for k, axis in zip((10, 11, 12), stats.AXES):
                deltas[f"{winner}_vs_{v}", axis] = [int(last[r[2]][k]) - int(r[k]) for r in logs if r[1] == run and r[2] in last and r[k] is not None and last[r[2]][k] is not None]
    return per, [{"value": v, "rrf": round(s, 5)} for v, s in ranking], winner, deltas


def test_results_equal_plain_code(spark):
    rng = random.Random(11)
    values, runs, logs = ["a", "b", "c"], ["r_a", "r_b", "r_c"], []
    for run in runs:
        for q in range(40):
            score = lambda: rng.choice([None, *map(str, range(11))])
            logs.append((len(logs), run, q, "q", rng.random() < 0.9, "x", "c", [(f"s{rng.randint(0, 6)}.md",) for _ in range(3)], "ref", ["s1", "s2"] if q % 4 else None, score(), score(), score() if run != "r_c" else None, "{}"))
    per, ranking, winner, deltas = plain_results(values, runs, logs)
    got = experiment.results_of("p", values, runs, spark.createDataFrame(logs, experiment.LOG))
    assert got["per_value"] == per and got["composite"]["ranking"] == ranking and got["composite"]["winner"] == winner
    pairwise = got["composite"]["pairwise"]
    tested = {k: d for k, d in deltas.items() if d}
    assert pairwise["tests"] == len(tested) and pairwise["threshold"] == round(0.05 / len(tested), 5)
    for (name, axis), d in deltas.items():
        t = pairwise["comparisons"][name][axis]
        assert (t is None) == (not d)
        if d:
            assert (t["mean_delta"], t["n"], t["p"]) == (round(float(np.mean(d)), 3), len(d), round(stats.wilcoxon(np.array(d, float)), 4))
            assert t["ci95"][0] <= t["mean_delta"] <= t["ci95"][1] and t["significant_bonferroni"] == (t["p"] < 0.05 / len(tested))
