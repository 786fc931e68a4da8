from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from lodestone import config
from lodestone.functions import text
from lodestone.operators import agent, flows, models, retrieval
from lodestone.plans import base
from lodestone.streaming import queue

TURNS = "conv_id long, hop int, text string, n_calls int, sources array<string>, prompt_tokens long, completion_tokens long"


def scripted(spark, rows):
    return spark.createDataFrame([(*r, 10 * (r[1] + 1), 1) for r in rows], TURNS)


def folded(spark, rows, **more):
    return {r.conv_id: r for r in flows.agent_answers(scripted(spark, rows), **more).collect()}


def looped(spark, rows, most=config.MAX_HOPS):
    """The same through the loop: each call of a turn gives one of the turn's sources."""
    turns = scripted(spark, rows).withColumn("calls", F.expr("transform(sequence(1, greatest(n_calls, 1)), i -> struct(string(i) AS id, 'look' AS name, concat('{\"s\": \"', coalesce(get(sources, i - 1), ''), '\"}') AS arguments))"))
    turns = turns.withColumn("calls", F.when(F.col("n_calls") > 0, F.col("calls")))

    def model(asked):
        return asked.select("conv_id", "hop").join(turns, ["conv_id", "hop"])

    def look(calls):
        s = F.col("arguments")["s"]
        return calls.select("call_key", F.concat(F.lit("about "), s).alias("content"), F.when(s == "", F.array().cast("array<string>")).otherwise(F.array(s)).alias("sources"))

    questions = turns.select("conv_id").distinct().select("conv_id", F.lit("q").alias("question"), F.lit("ru").alias("language"))
    return {r.conv_id: r for r in agent.run(questions, model, agent.registry(agent.Tool("look", look)), "Help.", most).collect()}


CASES = [
    (1, 0, None, 2, ["a", "b"]), (1, 1, None, 1, ["a"]), (1, 2, "done", 0, []), (1, 3, "late", 0, []),
    (2, 0, "at once", 0, []),
    (3, 0, None, 1, ["s"]), (3, 1, "", 0, []), (3, 2, "asked again", 0, []),
    (4, 0, None, 1, ["s"]), (4, 1, None, 0, []),
    (5, 0, None, 1, []), (5, 1, "", 0, []),
    *[(6, h, f"t{h}" if h == 4 else None, 1, [f"s{h % 2}"]) for h in range(6)],
    *[(7, h, None, 1, []) for h in range(5)],
    (8, 0, None, 1, ["s"]), (8, 2, "after a failed call", 0, []),
    (9, 1, "first call fails", 0, []),
]
WANT = {
    1: ("done", ["a", "b"], 3, True, 60), 2: ("at once", [], 1, False, 10), 3: ("asked again", ["s"], 3, True, 60), 4: ("", ["s"], 2, False, 30), 5: (config.NO_RESULTS, [], 2, False, 30),
    6: ("t4", ["s0", "s1"], 5, True, 150), 7: (config.NO_RESULTS, [], 4, False, 100), 8: ("after a failed call", ["s"], 3, True, 40), 9: (config.NO_RESULTS, [], 1, False, 0),
}


def ended(rows):
    return {k: (r.text, r.sources, r.hops, r.success, r.prompt_tokens) for k, r in rows.items()}


def test_how_agents_end(spark):
    got = folded(spark, CASES)
    assert ended(got) == WANT
    assert got[1].max_prompt_tokens == 30 and got[1].completion_tokens == 3


def test_the_loop_equals_the_fold(spark):
    got = looped(spark, CASES)
    assert ended(got) == WANT
    assert [(m.role, m.content) for m in got[1].messages[:4]] == [("system", "Help.\n\nRespond in Russian."), ("user", "q"), ("assistant", None), ("tool", "about a")]
    assert [m.tool_call_id for m in got[1].messages] == [None, None, None, "1", "2", None, "1"]
    assert got[1].context == "about a\n\nabout b\n\nabout a" and got[2].context is None
    assert ended(looped(spark, CASES, 2)) == ended(folded(spark, CASES, most=2))


def test_tools_and_their_errors(spark):
    calls = [("1", "look", '{"q": "hi", "x": "1"}'), ("2", "none", "{}"), ("3", "look", "{broken"), ("4", "look", ""), ("5", "far__ask", '{"a": "1"}'), ("6", "far__ask", '{"a": "bad"}'), ("7", "mute", "{}")]
    frame = spark.createDataFrame(calls, "call_key string, tool string, arguments string")

    def look(asked):
        return asked.select("call_key", F.to_json("arguments").alias("content"), F.array(F.lit("s")).alias("sources"))

    def ask(asked):
        return asked.select("call_key", F.when(F.col("arguments")["a"] == "bad", "error: tool 'ask' failed").otherwise("answer text").alias("content"))

    tools = agent.registry(agent.Tool("look", look, ("q",)), agent.remote("far", "ask", ask), agent.Tool("mute", lambda asked: look(asked).limit(0)))
    got = {r.call_key: (r.content, r.sources) for r in agent.dispatched(frame, tools).collect()}
    assert got == {
        "1": ('{"q":"hi"}', ["s"]), "2": ("error: unknown tool 'none'", []), "3": ("error: tool 'look' got invalid arguments", []), "4": ("{}", ["s"]),
        "5": ("answer text", ["mcp:far__ask"]), "6": ("error: tool 'ask' failed", []), "7": ("error: tool 'mute' failed", []),
    }


def test_the_agent_searches_the_index(spark, sf_dir):
    """One hop with the corpus search, then the model repeats what it was shown."""
    index = base.index(spark, sf_dir)
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").limit(3).select(F.col("item_id").alias("conv_id"), F.col("text").alias("question"), F.lit("en").alias("language"))

    def model(asked):
        last = F.element_at("messages", -1)["content"]
        call = F.array(F.struct(F.lit("c").alias("id"), F.lit("search_corpus").alias("name"), F.to_json(F.struct(last.alias("query"))).alias("arguments")))
        return asked.select("conv_id", F.when(F.col("hop") > 0, last).alias("text"), F.when(F.col("hop") == 0, call).alias("calls"), F.lit(1).alias("prompt_tokens"), F.lit(1).alias("completion_tokens"))

    cfg = config.SearchConfig(distance_threshold=2.0)
    got = agent.run(items, model, agent.registry(agent.search_tool(index, models.embedder(), cfg))).collect()
    found = {r.query_id: r for r in retrieval.shown(retrieval.search_questions(index, items.select(F.col("conv_id").alias("query_id"), "question"), models.embedder(), cfg), cfg.limit).collect()}
    assert len(got) == 3 and all(r.success and r.hops == 2 for r in got)
    assert {r.conv_id: (r.text, r.sources) for r in got} == {k: (r.context, r.sources) for k, r in found.items()}


def test_an_answer_retrieves_and_reranks(spark, sf_dir):
    index = base.index(spark, sf_dir)
    asked = spark.createDataFrame([(1, "ti er", "en"), (2, "", None)], "query_id long, question string, language string")
    cfg = config.SearchConfig(distance_threshold=0.0, rerank=True, limit=3)
    got = {r.query_id: r for r in flows.answer(index, asked, models.embedder(), lambda prompt: prompt, cfg, score=lambda q, c: F.length(c)).collect()}
    ids = [r.id for r in retrieval.keyword_leg(index, ["ti", "er"], cfg).orderBy("keyword_rank").collect()]
    longest = index.chunks.filter(F.col("id").isin(ids)).orderBy(F.desc(F.length("content")), "id").limit(3).collect()
    assert got[1].answer == "\n\n".join(f"[{r.source}]\n{r.content}" for r in longest) + "\n\nQuestion: ti er\n\nRespond in English."
    assert (got[2].answer, got[2].answered) == (config.NO_RESULTS, False)


def test_no_model_is_asked_without_context(spark):
    questions = spark.createDataFrame([(1, "q", "en"), (2, "r", None)], "query_id long, question string, language string")
    found = spark.createDataFrame([(1, 1, "a.md", "First. Second."), (1, 2, "index.md", "x")], "query_id long, rank int, source string, content string")
    asked = {r.query_id: r for r in flows.answers(questions, found, lambda prompt: F.coalesce(prompt, F.lit("asked"))).collect()}
    assert asked[1].answer == "[a.md]\nFirst. Second.\n\nQuestion: q\n\nRespond in English."  # ignored files are no context
    assert asked[1].sources == ["a.md"] and asked[1].answered
    assert (asked[2].answer, asked[2].sources, asked[2].answered) == (config.NO_RESULTS, [], False)


def test_of_two_maps_the_second_wins(spark):
    row = spark.sql("SELECT map('a', '1', 'b', '2') AS x, map('b', '3') AS y, cast(null AS map<string,string>) AS z")
    got = row.select(flows.merged(F.col("x"), F.col("y")).alias("m"), flows.merged(F.col("z"), F.col("y")).alias("n"), flows.merged(F.col("x"), F.col("z")).alias("o")).first()
    assert (got.m, got.n, got.o) == ({"a": "1", "b": "3"}, {"b": "3"}, {"a": "1", "b": "2"})


def test_an_experiment_is_aggregated_once(spark):
    experiments = spark.createDataFrame([(1, "running", ["a"]), (2, "running", ["a", "b"]), (3, "draft", ["a"]), (4, "running", ["none"])], "id long, status string, run_names array<string>")
    logs = spark.createDataFrame([("a", True, "c", "5"), ("b", True, "c", None)], "run_name string, answered boolean, context string, faithfulness string")
    once = flows.aggregated(experiments, logs)
    assert {r.id: r.status for r in once.collect()} == {1: "aggregated", 2: "running", 3: "draft", 4: "running"}
    assert sorted(map(str, flows.aggregated(once, logs).collect())) == sorted(map(str, once.collect()))


def test_an_empty_table_of_ids_targets_nothing(spark):
    questions = spark.createDataFrame([(1, "s"), (2, "t")], "id long, set_name string")
    assert flows.eval_targets(questions, ids=questions.select("id").limit(0)).count() == 0
    assert flows.eval_targets(questions, "s").count() == 1 and flows.eval_targets(questions).count() == 2


@pytest.mark.parametrize("reply, error", [(None, "invalid_json"), ("{", "invalid_json"), ('{"reason": "r"}', "invalid_score"), ('{"reason": "r", "score": 11}', "invalid_score"), ('{"reason": "r", "score": 10}', None)])
def test_errors_of_verdicts_are_told_apart(spark, reply, error):
    rows = spark.createDataFrame([(reply,)], "reply string")
    assert rows.select(text.verdict_error(F.col("reply")).alias("e")).first().e == error


def test_enqueued_jobs_have_ids_of_their_own_even_in_an_empty_queue(spark):
    jobs = spark.createDataFrame([], "id long, type string, queue string, status string, options string, apply_since timestamp_ntz")
    fresh = spark.range(50).select(F.lit("t").alias("type"), F.lit("io").alias("queue"), F.lit("{}").alias("options"))
    got = queue.enqueue(jobs, fresh, F.lit("2024-01-01").cast("timestamp_ntz"))
    assert got.select("id").distinct().count() == 50 and got.agg(F.min("id")).first()[0] >= 1
