"""Answer and retrieval quality over logged runs.

Logs have (id, run_name, question_id, answered, sources array<struct<source>>, scores as
text, marked_sources from the question or null). Scores are text and cast strictly: one
that is no whole number fails the query.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone import config
from lodestone.functions.numeric import exact_round

AXES = ("faithfulness", "relevance", "completeness")


def score(axis: str) -> Column:
    return F.col(axis).cast("int")


def in_corpus(marked: str = "marked_sources") -> Column:
    """The question exists and says which sources answer it."""
    return F.coalesce(F.size(marked), F.lit(0)) > 0


def has_remote(sources: str = "sources") -> Column:
    return F.coalesce(F.exists(sources, lambda s: s["source"].startswith(config.REMOTE_PREFIX)), F.lit(False))


def hit_rank(got: Column, expected: Column) -> Column:
    """1-based place of the first source that contains an expected one; null if none."""
    flags = F.transform(got, lambda s: F.exists(expected, lambda e: s.contains(e)))
    place = F.array_position(flags, True)
    return F.when(place > 0, place)


def source_places(logs: DataFrame) -> DataFrame:
    """(id, source, place): the sources of each log with their places from 1."""
    listed = logs.select("id", F.posexplode("sources").alias("_p", "_s"))
    return listed.select("id", F.col("_s.source").alias("source"), (F.col("_p") + 1).alias("place"))


def rounded_mean(value: Column) -> Column:
    """The mean of what isn't null, two digits."""
    return exact_round(F.avg(value), 2)


def generation_metrics(logs: DataFrame) -> DataFrame:
    """Per run: in-corpus means, the 0 to 1 scale, and refusal accuracy as ``c/n``."""
    inside, pool = in_corpus(), ~in_corpus() & ~has_remote()
    right = pool & ((F.coalesce(score("faithfulness"), F.lit(0)) >= config.REFUSAL_SCORE) | ~F.col("answered"))
    found = logs.groupBy("run_name").agg(
        F.count_if(inside & F.col("faithfulness").isNotNull()).alias("n_scored"),
        rounded_mean(F.when(inside, score("faithfulness"))).alias("faithfulness"),
        rounded_mean(F.when(inside, score("relevance"))).alias("relevance"),
        rounded_mean(score("completeness")).alias("completeness"),
        F.count_if(right).alias("right"),
        F.count_if(pool).alias("refusable"),
        F.count_if(~in_corpus() & has_remote() & F.col("answered")).alias("answered_via_remote"),
    )
    scaled = [exact_round(F.col(axis) / 10, 3).alias(f"{axis}_scaled") for axis in AXES]
    return found.select("run_name", "n_scored", *AXES, *scaled, F.concat_ws("/", F.col("right").cast("string"), F.col("refusable").cast("string")).alias("refusal_accuracy"), "answered_via_remote")


def retrieval_metrics(logs: DataFrame) -> DataFrame:
    """Per run over in-corpus logs: n, hits, hit@k, MRR and misses; remote sources are
    left out before places are counted."""
    own = F.transform(F.filter("sources", lambda s: ~s["source"].startswith(config.REMOTE_PREFIX)), lambda s: s["source"])
    ranked = logs.filter(in_corpus()).select("run_name", hit_rank(own, F.col("marked_sources")).alias("rank"))
    found = ranked.groupBy("run_name").agg(F.count(F.lit(1)).alias("n"), F.count("rank").alias("hits"), F.sum(F.coalesce(1.0 / F.col("rank"), F.lit(0.0))).alias("reciprocal"))
    n = F.greatest("n", F.lit(1))
    return found.select("run_name", "n", "hits", exact_round(F.col("hits") / n, 3).alias("hit_at_k"), exact_round(F.col("reciprocal") / n, 3).alias("mrr"), (F.col("n") - F.col("hits")).alias("misses"))


def misses(logs: DataFrame) -> DataFrame:
    """In-corpus logs none of whose sources, remote ones included, is expected."""
    got = F.transform("sources", lambda s: s["source"])
    return logs.filter(in_corpus() & hit_rank(got, F.col("marked_sources")).isNull())


def run_metrics(logs: DataFrame) -> DataFrame:
    return generation_metrics(logs).join(retrieval_metrics(logs), "run_name", "left")


def run_counts(logs: DataFrame) -> DataFrame:
    """Per run how many logs there are and how many wait for a judge."""
    waiting = F.col("answered") & (F.coalesce(F.length("context"), F.lit(0)) > 0) & F.col("faithfulness").isNull()
    return logs.groupBy("run_name").agg(F.count(F.lit(1)).alias("n"), F.count_if(waiting).alias("pending"))


def series_complete(runs: DataFrame, logs: DataFrame) -> DataFrame:
    """One row: whether every run of (run_name) has logs and none waits."""
    counted = runs.select("run_name").join(run_counts(logs), "run_name", "left")
    done = (F.coalesce("n", F.lit(0)) > 0) & (F.coalesce("pending", F.lit(0)) == 0)
    return counted.agg(F.coalesce(F.bool_and(done), F.lit(False)).alias("complete"))


def attempts(axis: str) -> Column:
    """How often judging an axis has failed; null if never tried."""
    return F.expr(f"try_variant_get(metrics, '$.{axis}.attempts', 'int')")


def owed_axes(force: bool = False) -> Column:
    """The axes that a judge still owes a log."""
    filled = {"faithfulness": F.coalesce(F.length("context"), F.lit(0)) > 0, "relevance": F.lit(True), "completeness": F.coalesce(F.length("reference_answer"), F.lit(0)) > 0}
    left = {axis: F.lit(True) if force else F.coalesce(attempts(axis), F.lit(0)) < config.JUDGE_ATTEMPTS for axis in filled}
    return F.array_compact(F.array(*[F.when(F.col(axis).isNull() & ready & left[axis], F.lit(axis)) for axis, ready in filled.items()]))


def judge_worklist(logs: DataFrame, force: bool = False) -> DataFrame:
    """Logs with the axes a judge still owes: (id, axes). ``metrics`` is a VARIANT with
    attempts by axis. ``force`` takes given logs whatever their attempts."""
    return logs.filter("answered").select("id", owed_axes(force).alias("axes")).filter(F.size("axes") > 0)


def evidence_context(messages: DataFrame) -> DataFrame:
    """The tool evidence of each conversation joined by blank lines, in turn order."""
    kept = messages.filter((F.col("role") == "tool") & ~F.col("text").startswith(config.ERROR_PREFIX) & (F.col("text") != config.NO_RESULTS))
    return joined_turns(kept, "context")


def joined_turns(messages: DataFrame, name: str = "text") -> DataFrame:
    """The texts of each conversation in turn order, joined by blank lines."""
    turns = F.array_sort(F.collect_list(F.struct("turn", "text")))
    return messages.groupBy("conv_id").agg(F.array_join(F.transform(turns, lambda t: t["text"]), "\n\n").alias(name))


def turn_totals(turns: DataFrame) -> DataFrame:
    """Hops, token sums and the largest prompt of each conversation."""
    return turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("hops"), F.sum("prompt_tokens").alias("prompt_tokens"), F.sum("completion_tokens").alias("completion_tokens"), F.max("prompt_tokens").alias("max_prompt_tokens"))
