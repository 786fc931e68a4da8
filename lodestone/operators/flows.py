"""Answering, agent, judging and experiment flows over whole tables.

A flow takes tables of questions, turns, calls or logs and gives the rows that it writes.
Model calls are the pluggable column functions of ``models``; a backend is given null
where it isn't to be asked.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone import config
from lodestone.functions import text
from lodestone.operators import evals, listing, models, retrieval
from lodestone.operators.searchindex import SearchIndex
from lodestone.streaming import queue

# Names of languages in a directive.
LANGUAGES = {"ru": "Russian", "en": "English"}


def language_directive(language: Column) -> Column:
    """The sentence that asks for a language; unknown codes stand for themselves."""
    names = F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair])
    return F.concat(F.lit("Respond in "), F.coalesce(F.try_element_at(names, language), language), F.lit("."))


def merged(base: Column, override: Column) -> Column:
    """Both maps as one; where both have a key the second one's value counts."""
    base, override = (F.coalesce(m, F.create_map().cast("map<string,string>")) for m in (base, override))
    return F.map_concat(F.map_filter(base, lambda k, _: ~F.array_contains(F.map_keys(override), k)), override)


def declared_only(arguments: Column, declared: Column) -> Column:
    """The arguments whose names are declared; all of them where nothing is."""
    return F.when(declared.isNull(), arguments).otherwise(F.map_filter(arguments, lambda k, _: F.array_contains(declared, k)))


def remote_tools(integrations: DataFrame) -> DataFrame:
    """(name, integration, tool, description) of every allowed tool of the active
    integrations (name, status, allowed_tools, tool_schemas); tools without a cached
    schema are left out."""
    allowed = integrations.filter("status = 'active'").select(F.col("name").alias("integration"), "tool_schemas", F.explode("allowed_tools").alias("tool"))
    known = allowed.withColumn("description", F.try_element_at("tool_schemas", F.col("tool"))).filter(F.array_contains(F.map_keys("tool_schemas"), F.col("tool")))
    return known.select(F.concat_ws("__", "integration", "tool").alias("name"), "integration", "tool", "description")


def dispatched(calls: DataFrame, tools: DataFrame) -> DataFrame:
    """calls (call_id, tool, arguments as JSON text) with the arguments to pass, or with
    the error that goes back to the model. tools are (name, declared)."""
    known = tools.select(F.col("name").alias("tool"), "declared", F.lit(True).alias("known"))
    given = F.when(F.coalesce("arguments", F.lit("")) == "", F.lit("{}")).otherwise(F.col("arguments"))
    rows = calls.join(known, "tool", "left").withColumn("given", F.from_json(given, "map<string,string>"))
    wrong = F.when(F.col("known").isNull(), F.concat(F.lit(f"{config.ERROR_PREFIX}unknown tool '"), "tool", F.lit("'")))
    wrong = wrong.when(F.col("given").isNull(), F.concat(F.lit(f"{config.ERROR_PREFIX}tool '"), "tool", F.lit("' got invalid arguments")))
    return rows.select("call_id", "tool", F.when(wrong.isNull(), declared_only(F.col("given"), F.col("declared"))).alias("passed"), wrong.alias("error"))


def answers(questions: DataFrame, found: DataFrame, generate: Callable[[Column], Column] = models.extractive_answer, k: int = config.RESULTS_LIMIT) -> DataFrame:
    """One answer for each question (query_id, question, language) from the first k chunks
    found for it (query_id, rank, source, content); ignored files are neither context nor
    source. Without a context no model is asked."""
    rows = questions.join(retrieval.shown(found, k), "query_id", "left")
    asked = F.concat_ws("\n\n", "context", F.concat(F.lit("Question: "), "question"), language_directive(F.col("language")))
    rows = rows.withColumn("answered", F.coalesce(F.length("context"), F.lit(0)) > 0)
    reply = generate(F.when(F.col("answered"), asked))
    return rows.select("query_id", "question", "answered", F.when(F.col("answered"), reply).otherwise(F.lit(config.NO_RESULTS)).alias("answer"), "context", F.coalesce("sources", F.array().cast("array<string>")).alias("sources"))


def answer(index: SearchIndex, questions: DataFrame, embed: Callable[[Column], Column], generate: Callable[[Column], Column] = models.extractive_answer, cfg: config.SearchConfig = config.SearchConfig(), score: Callable[[Column, Column], Column] | None = None, active_sources: DataFrame | None = None) -> DataFrame:
    """Single-shot answers: retrieval, with ``cfg.rerank`` the rerank of its candidates by
    ``score``, context, generation, for questions (query_id, question, language)."""
    ranked = (score or retrieval.token_overlap) if cfg.rerank else None
    found = retrieval.search_questions(index, questions.select("query_id", "question"), embed, cfg, active_sources, ranked)
    return answers(questions, found, generate, cfg.limit)


def log_rows(answered: DataFrame, run_name: str | None, cfg: config.SearchConfig, used: dict[str, str], prompts: dict[str, int]) -> DataFrame:
    """answers() as log rows with a snapshot of what they were made with."""

    def held(values: dict) -> Column:
        return F.create_map(*[F.lit(x) for k, v in values.items() for x in (k, str(v))])

    snapshot = {"rerank": cfg.rerank, "distance_threshold": cfg.distance_threshold, "k": cfg.limit}
    return answered.select(F.lit(run_name).cast("string").alias("run_name"), "*", held(used).alias("models"), held(prompts).alias("prompts"), held(snapshot).alias("config"))


def judge_jobs(logged: DataFrame) -> DataFrame:
    """(type, queue, options): a judging job for each answered log without a run."""
    due = logged.filter(F.col("answered") & F.col("run_name").isNull())
    return due.select(F.lit("judge_answers").alias("type"), F.lit("default").alias("queue"), F.to_json(F.struct(F.array("id").alias("log_ids"))).alias("options"))


def agent_answers(turns: DataFrame, most: int = config.MAX_HOPS) -> DataFrame:
    """The end of each conversation of (conv_id, hop, text, n_calls, sources,
    prompt_tokens, completion_tokens), where (conv_id, hop) is a key and hop counts from 0.

    What ``agent.run`` ends with if the model's n-th call gives the turn of hop n. A
    missing turn is a failed call, which ends the loop. A turn that calls no tool is the
    last and gives the text; turns before it add their sources, each once. With sources
    and without a text the next turn is forced. An answer counts if it has text and a
    source; without either it is the no-results sentence."""
    counted = F.struct("hop", "n_calls", "text", "sources", "prompt_tokens", "completion_tokens")
    held = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(counted)).alias("turns"))  # a conversation's turns
    held = held.withColumn("seen", F.filter("turns", lambda t, i: (t["hop"] == i) & (t["hop"] < most)))
    held = held.withColumn("last", F.get(F.filter("seen", lambda t: t["n_calls"] == 0), F.lit(0)))
    held = held.withColumn("used", F.filter("seen", lambda t: (t["n_calls"] > 0) & (F.col("last").isNull() | (t["hop"] < F.col("last.hop")))))
    held = held.withColumn("sources", F.array_distinct(F.flatten(F.transform("used", lambda t: F.coalesce(t["sources"], F.array().cast("array<string>"))))))
    ended = F.col("last").isNotNull() | (F.size("used") < most)  # by the last turn, or by a failed call
    held = held.withColumn("hops", F.size("used") + ended.cast("int"))
    forced = F.get(F.filter("turns", lambda t: t["hop"] == F.col("hops")), F.lit(0))
    need = (F.coalesce("last.text", F.lit("")) == "") & (F.size("sources") > 0)
    held = held.withColumn("forced", F.when(need, forced))
    held = held.withColumn("made", F.filter(F.concat("used", F.array("last", "forced")), lambda t: t.isNotNull()))
    said = F.coalesce("forced.text", "last.text", F.lit(""))

    def total(name: str) -> Column:
        return F.aggregate("made", F.lit(0).cast("long"), lambda s, t: s + t[name])

    largest = F.coalesce(F.array_max(F.transform("made", lambda t: t["prompt_tokens"].cast("long"))), F.lit(0))
    return held.select(
        "conv_id",
        F.when((F.size("sources") == 0) & (said == ""), F.lit(config.NO_RESULTS)).otherwise(said).alias("text"),
        "sources",
        (F.col("hops") + F.col("forced").isNotNull().cast("int")).alias("hops"),
        ((said != "") & (F.size("sources") > 0)).alias("success"),
        total("prompt_tokens").alias("prompt_tokens"),
        total("completion_tokens").alias("completion_tokens"),
        largest.cast("long").alias("max_prompt_tokens"),
    )


def linked(rows: DataFrame) -> DataFrame:
    """rows as the outside sees them: source is called link."""
    return rows.withColumnRenamed("source", "link")


def insert_or_get(existing: DataFrame, fresh: DataFrame, key: str, identity: str = "id") -> DataFrame:
    """A row for each key of fresh: the one that the table has, else the fresh one with
    the least id; ``inserted`` tells which."""
    own = [c for c in fresh.columns if c != key]
    kept = existing.join(fresh.select(key).distinct(), key, "left_semi").select(key, *own, F.lit(False).alias("inserted"))
    new = fresh.join(existing.select(key), key, "left_anti").groupBy(key).agg(F.min_by(F.struct(*own), identity).alias("row"))
    return kept.unionByName(new.select(key, "row.*", F.lit(True).alias("inserted")))


def eval_targets(questions: DataFrame, set_name: str | None = None, ids: DataFrame | None = None) -> DataFrame:
    """The questions of a run: those with the ids, else a set's, else all. A table of ids
    without rows gives none."""
    if ids is not None:
        return questions.join(ids.select("id").distinct(), "id", "left_semi")
    return questions if set_name is None else questions.filter(F.col("set_name") == set_name)


def paraphrased(questions: DataFrame, existing: DataFrame, set_name: str, rewrite: Callable[[Column], Column] = models.paraphrase) -> DataFrame:
    """The paraphrases (question, set_name, text_hash) that existing doesn't have."""
    new = questions.select(rewrite(F.col("question")).alias("question")).filter("question is not null").distinct()
    return listing.insert_new(existing, new.select("question", F.lit(set_name).alias("set_name"), text.text_hash(F.col("question")).alias("text_hash")), "text_hash")


def judged(logs: DataFrame, replies: dict[str, Column], force: bool = False) -> DataFrame:
    """(id, axis, score, reason, error, attempts) for every axis that is owed. A reply
    that is no verdict leaves the score null and counts as one more attempt."""
    due = logs.withColumn("axis", F.explode(evals.owed_axes(force))).filter("answered")
    reply = F.coalesce(*[F.when(F.col("axis") == axis, asked) for axis, asked in replies.items()])
    got = due.withColumn("reply", reply).withColumn("verdict", text.verdict(F.col("reply"))).withColumn("error", text.verdict_error(F.col("reply")))
    used = F.coalesce(*[F.when(F.col("axis") == axis, evals.attempts(axis)) for axis in replies], F.lit(0))
    return got.select("id", "axis", F.col("verdict.score").alias("score"), F.col("verdict.reason").alias("reason"), "error", (used + F.col("error").isNotNull().cast("int")).alias("attempts"))


def sweep_jobs(experiments: DataFrame) -> DataFrame:
    """(experiment_id, run_name, type, queue, options): an evaluation for each value of
    each experiment (id, name, param, param_values)."""
    each = experiments.select(F.col("id").alias("experiment_id"), "name", "param", F.explode("param_values").alias("value"))
    run = text.run_name(F.col("name"), F.col("param"), F.col("value"))
    options = F.to_json(merged(F.create_map(F.lit("run_name"), run, F.lit("experiment_id"), F.col("experiment_id").cast("string")), F.create_map("param", F.col("value").cast("string"))))
    return each.select("experiment_id", run.alias("run_name"), F.lit("eval_run").alias("type"), F.lit("default").alias("queue"), options.alias("options"))


def experiments_with(experiments: DataFrame, runs: DataFrame) -> DataFrame:
    """(id, run_name) of the experiments that hold a run of runs (run_name)."""
    return experiments.select("id", F.explode("run_names").alias("run_name")).join(runs.select("run_name").distinct(), "run_name", "left_semi").select("id", "run_name")


def complete(experiments: DataFrame, logs: DataFrame) -> DataFrame:
    """(id) of the running experiments whose runs all have logs and none to judge."""
    runs = experiments.filter("status = 'running'").select("id", F.explode("run_names").alias("run_name"))
    counted = runs.join(evals.run_counts(logs), "run_name", "left")
    whole = counted.groupBy("id").agg(F.bool_and((F.coalesce("n", F.lit(0)) > 0) & (F.coalesce("pending", F.lit(0)) == 0)).alias("whole"))
    return whole.filter("whole").select("id")


def aggregated(experiments: DataFrame, logs: DataFrame) -> DataFrame:
    """experiments with those that are complete as aggregated. Done again it changes
    nothing, as only running ones move; ``experiment.aggregate`` adds their results."""
    done = complete(experiments, logs).withColumn("now", F.lit("aggregated"))
    return experiments.join(done, "id", "left").withColumn("status", F.coalesce("now", "status")).select(*experiments.columns)


def index_totals(chunks: DataFrame) -> DataFrame:
    """One row: the sources and chunks of an index run."""
    return chunks.agg(F.countDistinct("source").alias("sources"), F.count(F.lit(1)).alias("chunks"))


def bootstrap_jobs(wanted: DataFrame, present: DataFrame) -> DataFrame:
    """(type, queue, options): a pull for every wanted model (name) that isn't present,
    names compared with their tags."""
    tagged = [m.select(text.model_tag(F.col("name")).alias("name")).distinct() for m in (wanted, present)]
    return queue.pull_jobs(tagged[0].join(tagged[1], "name", "left_anti"))
