"""Answer-quality and experiment-statistics queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators import evals, stats
from lodestone.plans import base
from lodestone.plans.base import LOGS
from lodestone.plans.catalog import query

_RANK = "list_position(list_transform({got}, lambda s: len(list_filter(marked_sources, lambda e: contains(s, e))) > 0), true)"
_GEN = f"""WITH {LOGS}, gen AS (SELECT run_name,
  count(*) FILTER (WHERE inside AND faithfulness IS NOT NULL) AS n_scored,
  format('{{:.2f}}', avg(faithfulness) FILTER (WHERE inside))::DOUBLE AS faithfulness, format('{{:.2f}}', avg(relevance) FILTER (WHERE inside))::DOUBLE AS relevance, format('{{:.2f}}', avg(completeness))::DOUBLE AS completeness,
  count(*) FILTER (WHERE NOT inside AND NOT remote AND (coalesce(faithfulness, 0) >= 7 OR NOT answered)) AS ok, count(*) FILTER (WHERE NOT inside AND NOT remote) AS pool,
  count(*) FILTER (WHERE NOT inside AND remote AND answered) AS answered_via_remote FROM judged GROUP BY run_name),
ret AS (SELECT run_name, count(*) AS n, count(r) AS hits, sum(coalesce(1.0::DOUBLE / r, 0)) AS rec FROM (SELECT run_name, nullif({_RANK.format(got="own")}, 0) AS r FROM judged WHERE inside) GROUP BY run_name)"""
_GEN_OUT = """run_name, n_scored, faithfulness, relevance, completeness, format('{:.3f}', faithfulness / 10)::DOUBLE AS faithfulness_scaled, format('{:.3f}', relevance / 10)::DOUBLE AS relevance_scaled,
  format('{:.3f}', completeness / 10)::DOUBLE AS completeness_scaled, ok || '/' || pool AS refusal_accuracy, answered_via_remote"""
_RET_OUT = "n, hits, format('{:.3f}', hits::DOUBLE / greatest(n, 1))::DOUBLE AS hit_at_k, format('{:.3f}', rec / greatest(n, 1))::DOUBLE AS mrr, n - hits AS misses"


@query("a9_generation_metrics", f"{_GEN} SELECT {_GEN_OUT} FROM gen")
def a9_generation_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evals.generation_metrics(base.logs(spark, sf_dir))


@query("a11_retrieval_metrics", f"{_GEN} SELECT run_name, {_RET_OUT} FROM ret")
def a11_retrieval_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evals.retrieval_metrics(base.logs(spark, sf_dir))


@query("x10_run_metrics", f"{_GEN} SELECT {_GEN_OUT}, {_RET_OUT} FROM gen LEFT JOIN ret USING (run_name)")
def x10_run_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evals.run_metrics(base.logs(spark, sf_dir))


@query("a12_misses", f"WITH {LOGS} SELECT id, run_name FROM judged WHERE inside AND coalesce({_RANK.format(got='sources')}, 0) = 0")
def a12_misses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evals.misses(base.logs(spark, sf_dir)).select("id", "run_name")


@query("a4_run_counts", f"WITH {LOGS} SELECT run_name, count(*) AS n, count(*) FILTER (WHERE answered AND length(context) > 0 AND faithfulness IS NULL) AS pending FROM logs GROUP BY run_name")
def a4_run_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evals.run_counts(base.logs(spark, sf_dir))


@query("a5_series_complete", f"WITH {LOGS} SELECT coalesce(bool_and(n > 0 AND pending = 0), false) AS complete FROM (SELECT count(*) AS n, count(*) FILTER (WHERE answered AND length(context) > 0 AND faithfulness IS NULL) AS pending FROM logs GROUP BY run_name)")
def a5_series_complete(spark: SparkSession, sf_dir: str) -> DataFrame:
    logs = base.logs(spark, sf_dir)
    return evals.series_complete(logs.select("run_name").distinct(), logs)


@query("p16_judge_worklist", f"""WITH {LOGS}, w AS (SELECT id, list_filter([
  CASE WHEN faithfulness IS NULL AND length(context) > 0 AND attempts < 3 THEN 'faithfulness' END, CASE WHEN relevance IS NULL THEN 'relevance' END,
  CASE WHEN completeness IS NULL AND length(reference_answer) > 0 THEN 'completeness' END], lambda x: x IS NOT NULL) AS a FROM logs WHERE answered)
SELECT id, array_to_string(a, ',') AS axes FROM w WHERE len(a) > 0""")
def p16_judge_worklist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evals.judge_worklist(base.logs(spark, sf_dir)).select("id", F.array_join("axes", ",").alias("axes"))


@query("p18_in_corpus", f"WITH {LOGS} SELECT id, inside FROM judged")
def p18_in_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return base.logs(spark, sf_dir).select("id", evals.in_corpus().alias("inside"))


@query("p19_remote_evidence", f"WITH {LOGS} SELECT id, remote FROM judged")
def p19_remote_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return base.logs(spark, sf_dir).select("id", evals.has_remote().alias("remote"))


@query("w5_source_places", f"WITH {LOGS} SELECT id, unnest(sources) AS source, unnest([1, 2, 3]) AS place FROM logs")
def w5_source_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evals.source_places(base.logs(spark, sf_dir))


def _metrics(spark, sf_dir):
    found = evals.generation_metrics(base.logs(spark, sf_dir))
    return found.withColumn("position", F.regexp_extract("run_name", r"(\d+)$", 1).cast("int"))


_COMPOSITE = f"""{_GEN}, m AS (SELECT run_name, regexp_extract(run_name, '(\\d+)$', 1)::INTEGER AS position, faithfulness, relevance, completeness FROM gen),
long AS (UNPIVOT m ON faithfulness, relevance, completeness INTO NAME axis VALUE value),
placed AS (SELECT *, row_number() OVER (PARTITION BY axis ORDER BY value DESC, position) AS rank FROM long)"""


@query("x3_composite", f"""{_COMPOSITE}, s AS (SELECT run_name, sum(1.0::DOUBLE / (60 + rank)) AS rrf FROM placed GROUP BY run_name),
t AS (SELECT m.run_name, m.position, round(coalesce(rrf, 0), 9) AS rrf FROM m LEFT JOIN s USING (run_name))
SELECT *, row_number() OVER (ORDER BY rrf DESC, position) AS place FROM t""")
def x3_composite(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.composite(_metrics(spark, sf_dir))


@query("w4_axis_ranks", f"{_COMPOSITE} SELECT run_name, axis, value, rank FROM placed")
def w4_axis_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.axis_ranks(_metrics(spark, sf_dir))


_PAIRS = f"""WITH {LOGS}, b AS (SELECT question_id, arg_max({{'f': faithfulness, 'r': relevance, 'c': completeness}}, id) AS v FROM logs WHERE run_name = 'src2' GROUP BY question_id),
pairs AS (SELECT a.question_id, a.id AS id_a, a.faithfulness AS faithfulness_a, a.relevance AS relevance_a, a.completeness AS completeness_a, v.f AS faithfulness_b, v.r AS relevance_b, v.c AS completeness_b
  FROM (SELECT * FROM logs WHERE run_name = 'src1') a JOIN b ON a.question_id IS NOT DISTINCT FROM b.question_id)"""


@query("j9_paired_runs", f"{_PAIRS} SELECT * FROM pairs")
def j9_paired_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.paired(base.logs(spark, sf_dir), "src1", "src2")


@query("x4_deltas", f"""{_PAIRS}, d AS (SELECT id_a, faithfulness_a - faithfulness_b AS faithfulness, relevance_a - relevance_b AS relevance, completeness_a - completeness_b AS completeness FROM pairs)
SELECT id_a, axis, delta::DOUBLE AS delta FROM (UNPIVOT d ON faithfulness, relevance, completeness INTO NAME axis VALUE delta)""")
def x4_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.deltas(stats.paired(base.logs(spark, sf_dir), "src1", "src2"))


#: Differences of the composite's winner against every other run.
_WINNER = f"""{_COMPOSITE}, s AS (SELECT run_name, sum(1.0::DOUBLE / (60 + rank)) AS rrf FROM placed GROUP BY run_name),
winner AS (SELECT m.run_name AS winner FROM m LEFT JOIN s USING (run_name) ORDER BY round(coalesce(rrf, 0), 9) DESC, m.position LIMIT 1),
own AS (SELECT winner, question_id, arg_max({{'f': faithfulness, 'r': relevance, 'c': completeness}}, id) AS v FROM logs JOIN winner ON run_name = winner GROUP BY ALL),
diff AS (SELECT winner || ' vs ' || run_name AS comparison, id, v.f - faithfulness AS faithfulness, v.r - relevance AS relevance, v.c - completeness AS completeness
  FROM logs JOIN own ON logs.question_id IS NOT DISTINCT FROM own.question_id WHERE run_name <> winner),
delta AS (SELECT comparison, axis, delta FROM (UNPIVOT diff ON faithfulness, relevance, completeness INTO NAME axis VALUE delta))"""


def _winner_deltas(spark, sf_dir):
    return stats.winner_deltas(base.logs(spark, sf_dir), _metrics(spark, sf_dir))


@query("a15_delta_histograms", f"{_WINNER} SELECT comparison, axis, delta::DOUBLE AS delta, count(*) AS n FROM delta GROUP BY ALL")
def a15_delta_histograms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.histograms(_winner_deltas(spark, sf_dir))


@query("x6_signed_ranks", f"""{_WINNER}, ranked AS (SELECT *, rank() OVER (PARTITION BY comparison, axis, delta <> 0 ORDER BY abs(delta)) AS first, count(*) OVER (PARTITION BY comparison, axis, abs(delta)) AS same FROM delta),
summed AS (SELECT comparison, axis, count(*) FILTER (delta <> 0) AS n, count(*) FILTER (delta = 0) AS zeros, coalesce(sum(first + (same - 1) / 2.0::DOUBLE) FILTER (delta > 0), 0)::DOUBLE AS w_plus,
  coalesce(sum(same * same - 1) FILTER (delta <> 0), 0)::DOUBLE AS ties FROM ranked GROUP BY ALL)
SELECT comparison, axis, n, zeros, w_plus, round((w_plus - n * (n + 1) / 4.0::DOUBLE) / nullif(sqrt(n * (n + 1.0::DOUBLE) * (2 * n + 1) / 24 - ties / 48), 0), 9) AS z FROM summed""")
def x6_signed_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the signed-rank test of every comparison and axis rests on."""
    return stats.signed_ranks(stats.histograms(_winner_deltas(spark, sf_dir)))


@query("x5_x6_pairwise")
def x5_x6_pairwise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bootstrap intervals and Wilcoxon p of the winner against every other run."""
    return stats.pairwise(_winner_deltas(spark, sf_dir))


@query("x7_bonferroni", """WITH t AS (SELECT vec_id AS id, label, CASE WHEN vec_id % 7 <> 0 THEN (vec_id % 100) / 1000.0::DOUBLE END AS p FROM embeddings)
SELECT *, format('{:.5f}', 0.05::DOUBLE / nullif(count(p) OVER (), 0))::DOUBLE AS threshold, p < 0.05::DOUBLE AS significant_raw, p < 0.05::DOUBLE / nullif(count(p) OVER (), 0) AS significant_corrected FROM t""")
def x7_bonferroni(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = base.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "label", F.when(F.col("vec_id") % 7 != 0, (F.col("vec_id") % 100) / F.lit(1000.0)).alias("p"))
    return stats.bonferroni(rows)


@query("x8_results_document")
def x8_results_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.results_document(_metrics(spark, sf_dir), x5_x6_pairwise(spark, sf_dir))


@query("x9_spearman", f"""WITH {LOGS}, r AS (SELECT faithfulness AS a, completeness AS b FROM logs WHERE faithfulness IS NOT NULL AND completeness IS NOT NULL),
p AS (SELECT a, b, rank() OVER (ORDER BY a) + (count(*) OVER (PARTITION BY a) - 1) / 2.0::DOUBLE AS ra, rank() OVER (ORDER BY b) + (count(*) OVER (PARTITION BY b) - 1) / 2.0::DOUBLE AS rb FROM r)
SELECT round(corr(ra, rb), 6) AS spearman, round(avg((a = b)::INTEGER), 6) AS exact_match FROM p""")
def x9_spearman(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = base.logs(spark, sf_dir).select(F.col("faithfulness").cast("int").alias("a"), F.col("completeness").cast("int").alias("b"))
    return stats.spearman(scores, "a", "b")
