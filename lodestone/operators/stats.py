"""Experiment statistics: fused ranks, paired deltas, bootstrap, Wilcoxon, Bonferroni."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone import config
from lodestone.functions import vector
from lodestone.functions.numeric import exact_round

AXES = ("faithfulness", "relevance", "completeness")


def axis_ranks(metrics: DataFrame, axes=AXES) -> DataFrame:
    """(run_name, axis, value, rank): the place of each run on each axis, largest first. A
    null value has no rank; ties keep ``position`` order."""
    long = metrics.select("run_name", "position", *axes).unpivot(["run_name", "position"], list(axes), "axis", "value").filter("value is not null")
    return long.withColumn("rank", F.row_number().over(Window.partitionBy("axis").orderBy(F.desc("value"), "position"))).drop("position")


def composite(metrics: DataFrame, axes=AXES, k: int = config.RRF_K) -> DataFrame:
    """(run_name, rrf, place): runs by the sum of reciprocal ranks over the axes; retrieval
    metrics take no part. Ties keep ``position`` order."""
    summed = axis_ranks(metrics, axes).groupBy("run_name").agg(F.sum(vector.rrf(F.col("rank"), k)).alias("rrf"))
    every = metrics.select("run_name", "position").join(summed, "run_name", "left").withColumn("rrf", F.round(F.coalesce("rrf", F.lit(0.0)), 9))
    return every.withColumn("place", F.row_number().over(Window.orderBy(F.desc("rrf"), "position")))


def paired(logs: DataFrame, left: str, right: str) -> DataFrame:
    """Log pairs of two runs by question. The left run keeps repeated questions, of the
    right run the last log counts, and missing questions pair with each other."""
    a = logs.filter(F.col("run_name") == left).select("question_id", *[F.col(x).cast("int").alias(f"{x}_a") for x in AXES], F.col("id").alias("id_a"))
    b = logs.filter(F.col("run_name") == right).groupBy("question_id").agg(*[F.max_by(F.struct(F.col(x).cast("int").alias("v")), "id").getField("v").alias(f"{x}_b") for x in AXES]).withColumnRenamed("question_id", "question_b")
    return a.join(b, F.col("question_id").eqNullSafe(F.col("question_b"))).drop("question_b")


def deltas(pairs: DataFrame) -> DataFrame:
    """(axis, id_a, delta) of every pair with both scores."""
    both = pairs.select("id_a", *[(F.col(f"{x}_a") - F.col(f"{x}_b")).cast("double").alias(x) for x in AXES])
    return both.unpivot(["id_a"], list(AXES), "axis", "delta").filter("delta is not null")


def winner_deltas(logs: DataFrame, metrics: DataFrame) -> DataFrame:
    """(comparison, axis, id_a, delta) of the composite's winner against every other run,
    the winner's score less the other's. The other run keeps repeated questions, of the
    winner the last log counts, and missing questions pair with each other."""
    first = composite(metrics).filter("place = 1").select(F.col("run_name").alias("winner"))
    own = logs.join(F.broadcast(first), F.col("run_name") == F.col("winner"))
    last = own.groupBy("winner", F.col("question_id").alias("question_b")).agg(*[F.max_by(F.struct(F.col(x).cast("int").alias("v")), "id").getField("v").alias(f"{x}_b") for x in AXES])
    others = logs.select("run_name", "question_id", F.col("id").alias("id_a"), *[F.col(x).cast("int").alias(f"{x}_a") for x in AXES])
    pairs = others.join(last, F.col("question_id").eqNullSafe(F.col("question_b"))).filter("run_name <> winner")
    both = pairs.select(F.concat_ws(" vs ", "winner", "run_name").alias("comparison"), "id_a", *[(F.col(f"{x}_b") - F.col(f"{x}_a")).cast("double").alias(x) for x in AXES])
    return both.unpivot(["comparison", "id_a"], list(AXES), "axis", "delta").filter("delta is not null")


def histograms(delta_rows: DataFrame, by: str = "comparison") -> DataFrame:
    """(comparison, axis, delta, n): how often each difference occurs. Scores are whole
    numbers of 0 to 10, so a test has 21 rows at most, whatever the number of questions;
    counts of parts of the questions add up."""
    return delta_rows.groupBy(by, "axis", "delta").agg(F.count(F.lit(1)).alias("n"))


def signed_ranks(counted: DataFrame, by: str = "comparison") -> DataFrame:
    """(comparison, axis, n, zeros, w_plus, z) of histograms(): the number of differences
    other than 0, the sum of the ranks of the positive ones (ties share their mean rank),
    and its standard score under the tie-corrected normal approximation."""
    sizes = counted.groupBy(by, "axis", F.abs("delta").alias("size")).agg(F.sum("n").alias("n"), F.sum(F.when(F.col("delta") > 0, F.col("n")).otherwise(0)).alias("plus"))
    below = F.sum(F.when(F.col("size") > 0, F.col("n")).otherwise(0)).over(Window.partitionBy(by, "axis").orderBy("size").rowsBetween(Window.unboundedPreceding, -1))
    ranked = sizes.withColumn("rank", F.coalesce(below, F.lit(0)) + (F.col("n") + 1) / F.lit(2.0))
    nonzero, n = F.col("size") > 0, F.col("n").cast("double")
    sums = ranked.groupBy(by, "axis").agg(
        F.sum(F.when(nonzero, F.col("n")).otherwise(0)).alias("n"),
        F.sum(F.when(nonzero, 0).otherwise(F.col("n"))).alias("zeros"),
        F.coalesce(F.sum(F.when(nonzero, F.col("rank") * F.col("plus"))), F.lit(0.0)).alias("w_plus"),
        F.coalesce(F.sum(F.when(nonzero, n * n * n - n)), F.lit(0.0)).alias("ties"),
    )
    m = F.col("n").cast("double")
    spread = F.sqrt(m * (m + 1) * (2 * m + 1) / 24 - F.col("ties") / 48)
    return sums.select(by, "axis", "n", "zeros", "w_plus", F.round((F.col("w_plus") - m * (m + 1) / 4) / F.nullif(spread, F.lit(0.0)), 9).alias("z"))


def wilcoxon(values: np.ndarray, counts: np.ndarray | None = None) -> float:
    """Two-sided signed-rank p of differences, each of which may stand for several: exact
    up to 50 differences without ties or zeros, else the normal approximation with tie
    correction; 1 if all are zero (Wilcoxon 1945)."""
    counts = np.ones(len(values), np.int64) if counts is None else counts
    zeros = bool(counts[values == 0].sum())
    sizes, place = np.unique(np.abs(values[values != 0]), return_inverse=True)
    held = counts[values != 0]
    ties = np.bincount(place, held, len(sizes)) if len(sizes) else np.zeros(0)
    n = float(ties.sum())
    if not n:
        return 1.0
    ranks = np.cumsum(ties) - (ties - 1) / 2
    plus, whole = float((ranks[place] * held)[values[values != 0] > 0].sum()), n * (n + 1) / 2
    if n <= 50 and not zeros and (ties == 1).all():
        ways = np.zeros(int(whole) + 1)
        ways[0] = 1
        for r in range(1, int(n) + 1):
            ways[r:] = ways[r:] + ways[:-r]
        tail = ways[: int(min(plus, whole - plus)) + 1].sum() / ways.sum()
        return float(min(1.0, 2 * tail))
    spread = math.sqrt(n * (n + 1) * (2 * n + 1) / 24 - (ties**3 - ties).sum() / 48)
    z = (plus - whole / 2) / spread if spread else 0.0
    return float(math.erfc(abs(z) / math.sqrt(2)))


def bootstrap_ci(values: np.ndarray, counts: np.ndarray, rng: np.random.Generator, samples: int = config.BOOTSTRAP_SAMPLES) -> tuple[float, float]:
    """2.5 and 97.5 percentiles of the means of resamples. A resample of n differences is
    a multinomial draw of how often each value occurs, so it costs the number of different
    values, not n."""
    n = int(counts.sum())
    drawn = rng.multinomial(n, counts / n, samples)
    low, high = np.percentile(drawn @ values / n, [2.5, 97.5])
    return float(low), float(high)


def pairwise(delta_rows: DataFrame, by: str = "comparison", samples: int = config.BOOTSTRAP_SAMPLES, seed: int = config.BOOTSTRAP_SEED) -> DataFrame:
    """(comparison, axis, n, delta, ci_low, ci_high, p) of each comparison and axis, from
    the histogram of its differences: one small group a test. Each axis has a generator of
    its own, so tests don't depend on each other's order."""

    def judged(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("delta")
        values, counts, axis = rows["delta"].to_numpy(float), rows["n"].to_numpy(), rows["axis"].iloc[0]
        low, high = bootstrap_ci(values, counts, np.random.default_rng([seed, AXES.index(axis)]), samples)
        n = int(counts.sum())
        out = (rows[by].iloc[0], axis, n, round(float(values @ counts) / n, 3), round(low, 3), round(high, 3), round(wilcoxon(values, counts), 4))
        return pd.DataFrame([out], columns=[by, "axis", "n", "delta", "ci_low", "ci_high", "p"])

    return histograms(delta_rows, by).groupBy(by, "axis").applyInPandas(judged, f"{by} string, axis string, n long, delta double, ci_low double, ci_high double, p double")


def bonferroni(tests: DataFrame, alpha: float = 0.05) -> DataFrame:
    """tests with ``threshold`` (5 digits), ``significant_raw`` and
    ``significant_corrected``; the comparison uses the exact threshold."""
    exact = (F.lit(alpha) / F.nullif(F.count("p"), F.lit(0))).alias("_exact")
    one = tests.agg(exact).select("_exact", exact_round(F.col("_exact"), 5).alias("threshold"))
    judged = tests.crossJoin(F.broadcast(one))  # one row, not a window over all tests
    return judged.select(*tests.columns, "threshold", (F.col("p") < alpha).alias("significant_raw"), (F.col("p") < F.col("_exact")).alias("significant_corrected"))


def spearman(rows: DataFrame, a: str, b: str) -> DataFrame:
    """Rank correlation with average ranks for ties, and the share of equal values. Ranks
    are made from the counts of the distinct pairs of scores, so no task sorts all rows."""
    pairs = rows.filter(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(F.col(a).alias("x"), F.col(b).alias("y")).agg(F.count(F.lit(1)).alias("n"))

    def ranked(name: str) -> DataFrame:
        held = pairs.groupBy(name).agg(F.sum("n").alias("n"))
        before = F.sum("n").over(Window.orderBy(name).rowsBetween(Window.unboundedPreceding, -1))
        return held.select(name, (F.coalesce(before, F.lit(0)) + (F.col("n") + 1) / 2.0).alias(f"r{name}"))

    placed = pairs.join(ranked("x"), "x").join(ranked("y"), "y")
    w, u, v = F.col("n").cast("double"), F.col("rx"), F.col("ry")
    sums = placed.agg(*[F.sum(c).alias(k) for k, c in {"n": w, "u": w * u, "v": w * v, "uu": w * u * u, "vv": w * v * v, "uv": w * u * v, "same": F.when(F.col("x") == F.col("y"), w).otherwise(0.0)}.items()])
    corr = F.expr("(n * uv - u * v) / nullif(sqrt(n * uu - u * u) * sqrt(n * vv - v * v), 0)")
    return sums.select(F.round(corr, 6).alias("spearman"), F.round(F.expr("same / nullif(n, 0)"), 6).alias("exact_match"))


def results_document(metrics: DataFrame, tests: DataFrame) -> DataFrame:
    """One row: the experiment's winner, ranked runs and tests as JSON."""
    runs = composite(metrics).join(metrics.drop("position"), "run_name")
    listed = runs.agg(F.array_sort(F.collect_list(F.struct("place", "run_name", "rrf", *AXES))).alias("runs"))
    judged = bonferroni(tests).agg(F.array_sort(F.collect_list(F.struct(*tests.columns, "threshold", "significant_raw", "significant_corrected"))).alias("tests"))
    return listed.crossJoin(judged).select(F.col("runs")[0]["run_name"].alias("winner"), F.to_json(F.struct("runs", "tests")).alias("results"))
