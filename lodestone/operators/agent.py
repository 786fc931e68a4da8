"""The agent's loop over many conversations at once.

The frontier is the table of conversations that are still open. Each hop is one batch of
model calls over it, one batch of tool calls of what the model asked for, and a written
cut, so that no call is made again when a later hop is computed or an executor is lost.
Conversations whose turn calls no tool leave; the frontier shrinks until it is empty or
the hops are used up. Those without a text that have found sources are asked once more,
without tools.

A model is a function of a DataFrame (conv_id, hop, messages, forced) that gives (conv_id,
text, calls array<struct<id, name, arguments>>, prompt_tokens, completion_tokens) for each
conversation that it answers; one that it leaves out counts as a failed call. A tool's
``run`` is a function of a DataFrame (call_key, arguments map<string,string>) that gives
(call_key, content, sources array<string>); a call that it leaves out has failed. A
message is a struct<role, content, tool_call_id>. conv_id is a key.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone import config, storage
from lodestone.functions import language
from lodestone.operators import flows, retrieval
from lodestone.operators.searchindex import SearchIndex

MESSAGES = "array<struct<role:string,content:string,tool_call_id:string>>"
CALLS = "array<struct<id:string,name:string,arguments:string>>"
STRINGS = "array<string>"

Model = Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class Tool:
    """A tool by its name; ``declared`` arguments are passed on, all of them where None."""

    name: str
    run: Callable[[DataFrame], DataFrame]
    declared: tuple[str, ...] | None = None
    description: str = ""


def registry(*tools: Tool) -> dict[str, Tool]:
    """Tools by name; of two with one name the last counts."""
    return {t.name: t for t in tools}


def remote(integration: str, tool: str, call: Callable[[DataFrame], DataFrame], declared: tuple[str, ...] | None = None) -> Tool:
    """A remote tool. Its text is evidence from the tool itself, unless it is an error."""
    name = f"{integration}__{tool}"

    def run(calls: DataFrame) -> DataFrame:
        said = F.coalesce("content", F.lit(""))
        source = F.when(~said.startswith(config.ERROR_PREFIX), F.array(F.lit(f"{config.REMOTE_PREFIX}{name}"))).otherwise(F.array().cast(STRINGS))
        return call(calls).select("call_key", "content", source.alias("sources"))

    return Tool(name, run, declared)


def search_tool(index: SearchIndex, embed: Callable[[Column], Column], cfg: config.SearchConfig = config.SearchConfig(), active_sources: DataFrame | None = None) -> Tool:
    """The corpus search: formatted chunks and their sources, or the no-results sentence."""

    def run(calls: DataFrame) -> DataFrame:
        asked = calls.select("call_key", F.coalesce(F.try_element_at("arguments", F.lit("query")), F.lit("")).alias("question"))
        found = retrieval.search_questions(index, asked.select(F.xxhash64("call_key").alias("query_id"), "question"), embed, cfg, active_sources)
        shown = retrieval.shown(found, cfg.limit)
        return asked.withColumn("query_id", F.xxhash64("call_key")).join(shown, "query_id", "left").select("call_key", F.coalesce("context", F.lit(config.NO_RESULTS)).alias("content"), F.coalesce("sources", F.array().cast(STRINGS)).alias("sources"))

    return Tool("search_corpus", run, ("query", "category"), "Search the corpus and return the most relevant chunks.")


def dispatched(calls: DataFrame, tools: Mapping[str, Tool]) -> DataFrame:
    """(call_key, content, sources) of calls (call_key, tool, arguments): every tool runs
    once, on the batch of its own calls. Unknown tools, arguments that aren't JSON and
    calls that a tool doesn't answer give an error text."""
    spark = calls.sparkSession
    declared = spark.createDataFrame([(t.name, None if t.declared is None else list(t.declared)) for t in tools.values()], "name string, declared array<string>")
    checked = flows.dispatched(calls.withColumnRenamed("call_key", "call_id"), declared).withColumnRenamed("call_id", "call_key")
    none = F.array().cast(STRINGS)
    done = checked.filter("error is not null").select("call_key", F.col("error").alias("content"), none.alias("sources"))
    for tool in tools.values():
        asked = checked.filter((F.col("tool") == tool.name) & F.col("error").isNull()).select("call_key", F.col("passed").alias("arguments"))
        failed = F.lit(f"{config.ERROR_PREFIX}tool '{tool.name}' failed")
        said = asked.select("call_key").join(tool.run(asked).select("call_key", "content", "sources"), "call_key", "left")
        done = done.unionByName(said.select("call_key", F.coalesce("content", failed).alias("content"), F.when(F.col("content").isNotNull(), F.coalesce("sources", none)).otherwise(none).alias("sources")))
    return done


def system_prompt(template: str, spoken: Column) -> Column:
    """The template, and where a language is given the sentence that asks for it."""
    return F.when(spoken.isNull(), F.lit(template)).otherwise(F.concat(F.lit(f"{template}\n\n"), flows.language_directive(spoken)))


def _message(role: str, content: Column, call: Column | None = None) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"), (F.lit(None).cast("string") if call is None else call).alias("tool_call_id"))


def opened(questions: DataFrame, template: str) -> DataFrame:
    """The frontier before the first hop, of questions (conv_id, question, language)."""
    start = F.array(_message("system", system_prompt(template, F.col("language"))), _message("user", F.col("question")))
    zero = {c: F.lit(0).cast("long") for c in ("prompt_tokens", "completion_tokens", "max_prompt_tokens")}
    return questions.select("conv_id", start.cast(MESSAGES).alias("messages"), F.array().cast(STRINGS).alias("sources"), F.lit("").alias("text"), F.lit(0).alias("hops"), *[v.alias(k) for k, v in zero.items()])


def _asked(frontier: DataFrame, model: Model, forced: bool) -> DataFrame:
    """frontier with the model's turn: _answered, _text, _calls and the added tokens."""
    turn = model(frontier.select("conv_id", F.col("hops").alias("hop"), "messages", F.lit(forced).alias("forced")))
    said = turn.select("conv_id", F.lit(True).alias("_answered"), F.col("text").alias("_text"), F.coalesce(F.col("calls").cast(CALLS), F.array().cast(CALLS)).alias("_calls"), F.coalesce("prompt_tokens", F.lit(0)).cast("long").alias("_prompt"), F.coalesce("completion_tokens", F.lit(0)).cast("long").alias("_completion"))
    rows = frontier.join(said, "conv_id", "left")
    prompt, completion = F.coalesce("_prompt", F.lit(0)), F.coalesce("_completion", F.lit(0))
    return rows.withColumns({
        "_answered": F.coalesce("_answered", F.lit(False)),
        "prompt_tokens": F.col("prompt_tokens") + prompt,
        "completion_tokens": F.col("completion_tokens") + completion,
        "max_prompt_tokens": F.greatest("max_prompt_tokens", prompt),
    })


def _hop(frontier: DataFrame, model: Model, tools: Mapping[str, Tool], hop: int) -> DataFrame:
    """One hop: the frontier's conversations after it, with ``_open`` for those that called
    tools."""
    turned = storage.cut(_asked(frontier, model, False).withColumn("hops", F.lit(hop)), "agent-turns")
    asking = F.col("_answered") & (F.size("_calls") > 0)
    calls = turned.filter(asking).select("conv_id", F.posexplode("_calls").alias("_n", "_c")).select("conv_id", "_n", F.concat_ws("#", F.col("conv_id").cast("string"), F.lit(str(hop)), F.col("_n").cast("string")).alias("call_key"), F.col("_c.id").alias("call_id"), F.col("_c.name").alias("tool"), F.col("_c.arguments").alias("arguments"))
    results = storage.cut(dispatched(calls.select("call_key", "tool", "arguments"), tools), "agent-tools")
    ordered = F.array_sort(F.collect_list(F.struct("_n", _message("tool", F.col("content"), F.col("call_id")).alias("m"), "sources")))  # a turn's calls
    said = calls.join(results, "call_key").groupBy("conv_id").agg(ordered.alias("_said"))
    rows = turned.join(said, "conv_id", "left")
    turn = F.array(_message("assistant", F.col("_text")))
    grown = F.concat("messages", turn, F.transform("_said", lambda s: s["m"])).cast(MESSAGES)
    return rows.select(
        "conv_id",
        F.when(asking, grown).otherwise(F.col("messages")).alias("messages"),
        F.when(asking, F.concat("sources", F.flatten(F.transform("_said", lambda s: s["sources"])))).otherwise(F.col("sources")).alias("sources"),
        F.when(F.col("_answered") & ~asking, F.coalesce("_text", F.lit(""))).otherwise(F.col("text")).alias("text"),
        "hops", "prompt_tokens", "completion_tokens", "max_prompt_tokens",
        asking.alias("_open"),
    )


def evidence(messages: Column) -> Column:
    """The tools' texts joined by blank lines, without errors and no-results sentences."""
    kept = F.filter(messages, lambda m: (m["role"] == "tool") & ~m["content"].startswith(config.ERROR_PREFIX) & (m["content"] != config.NO_RESULTS))
    return F.array_join(F.transform(kept, lambda m: m["content"]), "\n\n")


def run(questions: DataFrame, model: Model, tools: Mapping[str, Tool], template: str = "", most: int = config.MAX_HOPS) -> DataFrame:
    """(conv_id, text, success, hops, sources, messages, context, prompt_tokens,
    completion_tokens, max_prompt_tokens) of questions (conv_id, question, language)."""
    frontier, ended = opened(questions, template), []
    for hop in range(1, most + 1):
        after = storage.cut(_hop(frontier, model, tools, hop), "agent-hop")
        ended.append(after.filter(~F.col("_open")).drop("_open"))
        frontier = after.filter("_open").drop("_open")
        if frontier.isEmpty():
            break
    rows = frontier
    for part in ended:
        rows = rows.unionByName(part)
    rows = rows.withColumn("sources", F.array_distinct("sources"))
    again = (F.col("text") == "") & (F.size("sources") > 0)
    final = _asked(rows.filter(again), model, True)
    final = final.withColumns({"hops": F.col("hops") + F.col("_answered").cast("int"), "text": F.when(F.col("_answered"), F.coalesce("_text", F.lit(""))).otherwise(F.col("text"))}).select(*rows.columns)
    closed = storage.cut(rows.filter(~again).unionByName(final), "agent-end")
    found = F.size("sources") > 0
    said = F.when(~found & (F.col("text") == ""), F.lit(config.NO_RESULTS)).otherwise(F.col("text"))
    return closed.select("conv_id", said.alias("text"), (found & (F.col("text") != "")).alias("success"), "hops", "sources", "messages", F.nullif(evidence(F.col("messages")), F.lit("")).alias("context"), "prompt_tokens", "completion_tokens", "max_prompt_tokens")


def log_rows(ended: DataFrame, run_name: str | None, cfg: config.SearchConfig, used: dict[str, str], prompts: dict[str, int], integrations: tuple[str, ...] = ()) -> DataFrame:
    """run() as log rows with a snapshot of what they were made with."""
    rows = ended.select("conv_id", "text", F.col("success").alias("answered"), "context", "sources", "hops", (F.size("sources") == 0).alias("no_evidence"), "prompt_tokens", "completion_tokens", F.col("max_prompt_tokens").alias("context_tokens"), F.lit("agent").alias("pipeline"), F.lit(",".join(sorted(integrations))).alias("remote"))
    return flows.log_rows(rows, run_name, cfg, used, prompts)


def spoken_languages(questions: DataFrame, key: str, question: str) -> DataFrame:
    """(key, language): what each question is asked in, English where nothing is known."""
    found = language.detected(questions, key, question, language.seed_profiles(questions.sparkSession))
    return found.select(key, F.coalesce("language", F.lit("en")).alias("language"))

