"""Findings of the third review, each with a case that failed before."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from lodestone.llm import linededup, packing, shared
from lodestone.llm.q10_packing import tokenizer_path


def words(rng, n):
    return ["".join(rng.choice("etaoinshrdlucmfwbgpy") for _ in range(rng.randint(3, 9))) for _ in range(n)]


def test_a_long_line_with_words_put_before_it_is_linked(spark):
    rng = random.Random(1)
    base, more, other = (" ".join(words(rng, n)) for n in (180, 25, 180))
    rows = [(1, base), (2, f"{more} {base}"), (3, other)]
    assert len(rows[1][1]) > linededup.WHOLE_TO
    texts = spark.createDataFrame(rows, "key long, norm string")
    pairs = spark.createDataFrame([(1, 2), (1, 3)], "a long, b long")
    assert {r.b: r.like for r in linededup._alike(pairs, texts, 0.8).collect()} == {2: True, 3: False}
    got = {r.key: r.group for r in linededup.groups(texts, 0.8).collect()}
    assert got == {1: 1, 2: 1}


def test_sizes_never_part_lines_that_may_be_alike(spark):
    """Equal signatures, sizes up to a quarter apart: all blocks are shared."""
    sizes = [(n, m) for n in range(5, 400) for m in (n, n + n // 8, n + n // 4)]
    places = [F.lit(7 * i).cast("long").alias(f"p{i}") for i in range(linededup.PLACES)]
    rows = spark.createDataFrame([(2 * i + j, s) for i, pair in enumerate(sizes) for j, s in enumerate(pair)], "key long, size int")
    blocks = linededup._blocks(rows.select("key", "size", F.lit(0).alias("kind"), *places), range(linededup.PLACES))
    held = {(r.key, r.n) for r in blocks.groupBy(F.floor(F.col("key") / 2).alias("key"), "block").agg(F.countDistinct(F.col("key")).alias("m")).filter("m = 2").groupBy("key").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert len(held) == len(sizes) and all(n >= linededup.PLACES for _, n in held)


def test_typing_errors_in_rare_and_in_many_words(spark):
    """One error in one of three words that aren't frequent, and errors in 3 of 100
    characters all over a line: at least 95 in 100 are linked."""
    rng = random.Random(2)
    vocabulary = words(rng, 300)
    rows = [(10_000 + i, " ".join(rng.choice(vocabulary) for _ in range(14))) for i in range(4000)]
    for i in range(300):
        if i < 150:
            x = [rng.choice(vocabulary) for _ in range(14)]
            x[::5] = [f"only{i}x{j}" for j in range(3)]
            y = ["z" + x[0], *x[1:]]
            x, y = " ".join(x), " ".join(y)
        else:
            x = " ".join(words(rng, 25))
            at = set(rng.sample(range(len(x)), 3 * len(x) // 100))
            y = "".join("0" if k in at and c != " " else c for k, c in enumerate(x))
        rows += [(2 * i, x), (2 * i + 1, y)]
    got = {r.key: r.group for r in linededup.groups(spark.createDataFrame(rows, "key long, norm string"), 0.8).collect()}
    found = [2 * i in got and got[2 * i] == got.get(2 * i + 1) for i in range(300)]
    assert sum(found[:150]) >= 0.95 * 150 and sum(found[150:]) >= 0.95 * 150


def test_packing_hands_few_rows_to_a_worker_at_once(spark, monkeypatch):
    name, seen, cut = "spark.sql.execution.arrow.maxRecordsPerBatch", {}, shared.cut

    def noted(df, what):
        seen[what] = int(spark.conf.get(name))
        return cut(df, what)

    monkeypatch.setattr(shared, "cut", noted)
    before = spark.conf.get(name)
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(30)], "doc_id long, text string")
    assert packing.pack(docs, tokenizer_path(), end_id=2, max_tokens=64).count() == 30
    assert seen["pieces"] <= 1000 and spark.conf.get(name) == before
