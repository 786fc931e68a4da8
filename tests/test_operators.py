from __future__ import annotations

import itertools
import math
import re
import time
from dataclasses import dataclass, replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone import config, timing
from lodestone.operators import checks, corpus, evals, listing, loglist, models, registry, retrieval, stats
from lodestone.sources import files, markdown, questions
from lodestone.streaming import queue


def test_bad_categories_are_refused():
    for bad in ("(", "*", "a|b", "!a", "a b", ""):
        with pytest.raises(ValueError):
            retrieval.checked_category(bad)


def test_limit_zero_is_refused():
    with pytest.raises(ValueError):
        config.SearchConfig(limit=0)


def test_rerank_orders_by_score(spark):
    rows = spark.createDataFrame([(1, "a", 0.1), (2, "b", 0.9), (3, "c", 0.5)], "id int, content string, s double")
    assert [r.content for r in retrieval.rerank(rows, F.col("s"), 2).collect()] == ["b", "c"]
    assert retrieval.rerank(rows.filter("id > 9"), F.col("s"), 2).collect() == []


def test_take_sources_keeps_order_and_leaves_ignored_out(spark):
    rows = spark.createDataFrame([(1, i, s) for i, s in enumerate(["b", "x/index.md", "a", "b", "c"])], "q int, pos int, source string")
    assert [r.source for r in retrieval.take_sources(rows, 2, ("q",), "pos").orderBy("pos").collect()] == ["b", "a"]


def test_source_rows_round(spark):
    rows = spark.createDataFrame([("a", 1, 2, 0.123456, 0.987654)], "source string, vector_rank int, keyword_rank int, vector_distance double, score double")
    r = retrieval.source_rows(rows).first()
    assert (r.vector_distance, r.score) == (0.123, 0.988)


def test_scores_that_are_no_numbers_fail(spark):
    rows = spark.createDataFrame([("r", True, "abc", "1", "1", None, ["s"])], "run_name string, answered boolean, faithfulness string, relevance string, completeness string, sources array<struct<source:string>>, marked_sources array<string>")
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        evals.generation_metrics(rows).collect()


def test_remote_sources_count_for_misses_only(spark):
    rows = spark.createDataFrame([(1, "r", [("mcp:s1",), ("a",), ("xs1.md",)], ["s1"])], "id int, run_name string, sources array<struct<source:string>>, marked_sources array<string>")
    r = evals.retrieval_metrics(rows).first()
    assert (r.hits, r.mrr) == (1, 0.5)
    assert evals.misses(rows).count() == 0


def test_judge_metrics_choose_the_winner(spark):
    rows = spark.createDataFrame([("good", 0, 9.0, 9.0, 9.0), ("other", 1, 5.0, 5.0, None)], "run_name string, position int, faithfulness double, relevance double, completeness double")
    assert [r.run_name for r in stats.composite(rows).orderBy("place").collect()] == ["good", "other"]


def exact_p(d):
    ranks = np.argsort(np.argsort(np.abs(d))) + 1
    low = min(ranks[d > 0].sum(), ranks[d < 0].sum())
    sums = [sum(r for r, s in zip(ranks, signs) if s) for signs in itertools.product((0, 1), repeat=len(d))]
    return min(1.0, 2 * np.mean([s <= low for s in sums]))


def test_wilcoxon():
    assert stats.wilcoxon(np.zeros(5)) == 1.0
    d = np.array([1.5, -0.5, 2.5, 3.5, -1.0, 4.0, 0.25])
    assert math.isclose(stats.wilcoxon(d), exact_p(d))
    assert stats.wilcoxon(np.full(20, 2.0)) < 0.05


def test_wilcoxon_of_counts_and_published_values():
    published = np.array([6, 8, 14, 16, 23, 24, 28, 29, 41, -48, 49, 56, 60, -67, 75.0])  # W = 24
    assert stats.wilcoxon(published) == pytest.approx(0.041259765625)
    rng = np.random.default_rng(1)
    for n in (3, 40, 400):
        d = rng.integers(-10, 11, n).astype(float)
        values, counts = np.unique(d, return_counts=True)
        assert stats.wilcoxon(values, counts) == pytest.approx(stats.wilcoxon(d))
        kept = d[d != 0]
        ranks = np.array([(np.abs(kept) < abs(x)).sum() + ((np.abs(kept) == abs(x)).sum() + 1) / 2 for x in kept])
        m, ties = len(kept), np.unique(np.abs(kept), return_counts=True)[1]
        z = (ranks[kept > 0].sum() - m * (m + 1) / 4) / math.sqrt(m * (m + 1) * (2 * m + 1) / 24 - (ties**3 - ties).sum() / 48)
        assert n < 51 or stats.wilcoxon(d) == pytest.approx(math.erfc(abs(z) / math.sqrt(2)))


def test_signed_ranks_of_tables(spark):
    rows = [("a vs b", "relevance", i, float(v)) for i, v in enumerate([3, -1, 2, 2, 0, -2, 5])] + [("a vs c", "relevance", 0, 0.0)]
    counted = stats.histograms(spark.createDataFrame(rows, "comparison string, axis string, id_a int, delta double"))
    got = {r.comparison: r for r in stats.signed_ranks(counted).collect()}
    r = got["a vs b"]
    assert (r.n, r.zeros, r.w_plus) == (6, 1, 3 + 3 + 5 + 6)
    assert r.z == pytest.approx((17 - 10.5) / math.sqrt(6 * 7 * 13 / 24 - (27 - 3) / 48))
    assert (got["a vs c"].n, got["a vs c"].zeros, got["a vs c"].z) == (0, 1, None)


def test_intervals_equal_plain_resampling():
    d = np.random.default_rng(3).integers(-4, 6, 300).astype(float)
    values, counts = np.unique(d, return_counts=True)
    low, high = stats.bootstrap_ci(values, counts, np.random.default_rng(42))
    means = np.random.default_rng(7).choice(d, (10_000, len(d))).mean(axis=1)
    plain = np.percentile(means, [2.5, 97.5])
    assert abs(low - plain[0]) < 0.02 and abs(high - plain[1]) < 0.02


def test_constant_difference_has_a_tight_interval(spark):
    rows = spark.createDataFrame([("a vs b", axis, i, v) for axis, v in (("faithfulness", 2.0), ("relevance", 0.0)) for i in range(20)], "comparison string, axis string, id_a int, delta double")
    got = {r.axis: r for r in stats.pairwise(rows).collect()}
    f, r = got["faithfulness"], got["relevance"]
    assert (f.delta, f.ci_low, f.ci_high) == (2.0, 2.0, 2.0) and f.p < 0.05
    assert (r.delta, r.ci_low, r.ci_high, r.p) == (0.0, 0.0, 0.0, 1.0)


def test_intervals_do_not_depend_on_partitions(spark):
    rows = [("a vs b", axis, i, float((i * 7 + len(axis)) % 11 - 5)) for axis in stats.AXES for i in range(200)]
    frame = spark.createDataFrame(rows, "comparison string, axis string, id_a int, delta double")
    assert sorted(stats.pairwise(frame.repartition(7)).collect()) == sorted(stats.pairwise(frame.coalesce(1)).collect())


def test_bonferroni(spark):
    rows = spark.createDataFrame([("a", 0.03), ("b", 0.001), ("c", 0.5), ("d", None)], "axis string, p double")
    got = {r.axis: r for r in stats.bonferroni(rows).collect()}
    assert got["a"].threshold == round(0.05 / 3, 5)
    assert got["a"].significant_raw and not got["a"].significant_corrected and got["b"].significant_corrected and got["d"].significant_raw is None


def test_pairs_keep_left_repeats_and_take_the_last_right(spark):
    logs = spark.createDataFrame([(1, "a", 1, "5"), (2, "a", 1, "6"), (3, "a", None, "7"), (4, "b", 1, "1"), (5, "b", 1, "2"), (6, "b", None, "3")], "id int, run_name string, question_id int, faithfulness string")
    logs = logs.withColumn("relevance", F.col("faithfulness")).withColumn("completeness", F.lit(None).cast("string"))
    got = sorted((r.id_a, r.faithfulness_b) for r in stats.paired(logs, "a", "b").collect())
    assert got == [(1, 2), (2, 2), (3, 3)]
    assert {r.axis for r in stats.deltas(stats.paired(logs, "a", "b")).collect()} == {"faithfulness", "relevance"}


def test_paging(spark):
    page = listing.Page()
    assert (page.limit, page.offset, page.sort_order, page.column) == (100, 0, "desc", "id")
    assert listing.Page(sort_by="nope", columns={"n": "name"}).column == "id"
    with pytest.raises(ValueError):
        listing.Page(limit=1001)
    rows = spark.createDataFrame([(1, None), (2, 5), (3, 7)], "id int, v int")
    assert [r.id for r in listing.paged(rows, listing.Page(sort_by="v", columns={"v": "v"})).collect()] == [1, 3, 2]
    assert [r.id for r in listing.paged(rows, listing.Page(sort_by="v", sort_order="asc", columns={"v": "v"})).collect()] == [2, 3, 1]


def test_of_equal_keys_the_first_is_new_and_the_last_replaces(spark):
    held = spark.createDataFrame([("a", 0, "old")], "k string, n int, v string")
    fresh = spark.createDataFrame([("b", 2, "second"), ("b", 1, "first"), ("a", 1, "x"), ("a", 3, "y")], "k string, n int, v string")
    assert [tuple(r) for r in listing.insert_new(held, fresh, "k", "n").collect()] == [("b", 1, "first")]
    assert sorted(tuple(r) for r in listing.upsert(held, fresh, "k", "n").collect()) == [("a", 3, "y"), ("b", 2, "second")]


def test_json_conditions(spark):
    rows = spark.createDataFrame([('["a","b"]', '{"k": 2}'), ("no", '{"k": 5}'), (None, None), ("[]", "{")], "a string, j string")
    assert [r.x for r in rows.select(listing.holds("a", "b").alias("x")).collect()] == [True, False, False, False]
    assert [r.x for r in rows.select(listing.absent_or_below("j", "k", 3).alias("x")).collect()] == [True, False, True, True]


def test_model_tables(spark):
    tables = spark.createDataFrame([(1, "m:latest", "ready"), (4, "n:1", "new")], "id long, name string, status string")
    roles = spark.createDataFrame([("judge", 1), ("none", 9)], "role string, model_id long")
    assert [tuple(r) for r in registry.role_models(roles, tables).collect()] == [("judge", "m:latest", "ready")]
    assert sorted(tuple(r) for r in registry.assign(roles, tables, "judge", "n:1").collect()) == [("judge", 4), ("none", 9)]
    with pytest.raises(LookupError):
        registry.assign(roles, tables, "judge", "absent")
    names = spark.createDataFrame([("m",), ("new",), ("new:latest",)], "name string")
    models_, pulls = registry.found_or_created(tables, names)
    got = {r.name: (r.id, r.status) for r in models_.collect()}
    assert set(got) == {"m:latest", "n:1", "new:latest"} and got["new:latest"][0] > 4 and got["new:latest"][1] == "new"
    assert [r.options for r in pulls.collect()] == ['{"name":"new:latest"}']
    left, job = registry.deleted(tables, roles, 4)
    assert [r.id for r in left.collect()] == [1] and job.first().options == '{"name":"n:1"}'
    with pytest.raises(ValueError):
        registry.deleted(tables, roles, 1)
    with pytest.raises(LookupError):
        registry.deleted(tables, roles, 7)


def test_integrations(spark):
    rows = spark.createDataFrame([(1, "a", "draft", ["x"])], "id long, name string, status string, tools array<string>")
    fresh = spark.createDataFrame([("b", 2, "draft", [])], "name string, id long, status string, tools array<string>")
    assert registry.created_integration(rows, fresh).count() == 2
    with pytest.raises(ValueError):
        registry.created_integration(rows, fresh.withColumn("name", F.lit("a")))
    moved = registry.replaced_integration(rows, 1, status="active", tools=["y", "z"]).first()
    assert (moved.status, moved.tools, moved.name) == ("active", ["y", "z"], "a")
    with pytest.raises(ValueError):
        registry.replaced_integration(rows, 1, status="unreachable")


def test_log_listing(spark):
    from datetime import datetime

    logs = spark.createDataFrame([(1, "r", "agent", 7, True, "x", "ctx", "5", None, None, datetime(2024, 1, 2)), (2, "s", "agent", None, False, None, None, None, None, None, datetime(2024, 1, 3))], "id long, run_name string, pipeline string, question_id long, answered boolean, answer string, context string, faithfulness string, relevance string, completeness string, created_at timestamp_ntz")
    asked = spark.createDataFrame([(7, "What is Redis?", "base")], "id long, original_text string, set_name string")
    every = loglist.page_of(logs, asked, loglist.LogFilter(), listing.Page(sort_by="created_at", columns=loglist.SORTED_BY)).collect()
    assert [(r.id, r.question_text) for r in every] == [(2, None), (1, "What is Redis?")] and "context" not in every[0].asDict()
    assert [r.id for r in loglist.items(logs, asked, loglist.LogFilter(text="redis")).collect()] == [1]
    assert loglist.items(logs, asked, loglist.LogFilter(set_name=("other",))).count() == 0
    assert [r.id for r in loglist.items(logs, asked, loglist.LogFilter(created_from=datetime(2024, 1, 3), answered=False, pipeline=("agent",))).collect()] == [2]
    assert loglist.detail(logs, asked, 1).first().context == "ctx"
    with pytest.raises(LookupError):
        loglist.detail(logs, asked, 3)


def test_commits_are_bounded(spark, tmp_path):
    held = corpus.committed(spark.range(25).coalesce(1), str(tmp_path / "c"), 10)
    assert sorted(r["count"] for r in held.groupBy(F.input_file_name()).count().collect()) == [5, 10, 10]


CONFIG = """
service:
  retrieval: {distance_threshold: 1, results_limit: 5, limit_vector: 20, limit_keywords: 21, rrf_k: 60}
  rerank: {enabled: true, top: 4}
  ingestion: {batch_size: 100, commit_size: 1000, chunk_max_size: 1024}
  ignored_sources: [index.md]
  repos_dir: /repos
  prompts_dir: prompts
  sources: {interview: {base_url: http://x, language: eng, repos: [a, b]}}
llm:
  base_url: http://y
  roles: {judging: {model: j, options: {temperature: 0}}, generation: {model: g}}
  candidates: [g, z]
postgres: {host: h}
mcp_integrations: {secret_env: [KNOWN]}
"""


def test_whole_configurations(tmp_path, monkeypatch):
    path = tmp_path / "c.yaml"
    path.write_text(CONFIG)
    got = config.Settings.from_yaml(str(path))
    assert got.search() == config.SearchConfig(1.0, 5, 20, 21, 60, True, 20) and got.rerank.top == 4 and got.agent.max_hops == 4
    assert got.sources.interview.repos == ("a", "b") and got.llm.pull_models == ["g", "j", "z"] and got.llm.roles["judging"].options == {"temperature": 0}
    monkeypatch.setenv("KNOWN", "s")
    monkeypatch.setenv("OTHER", "t")
    assert (got.mcp_integrations.secret("KNOWN"), got.mcp_integrations.secret("OTHER")) == ("s", "")
    for old, new, said in (("results_limit: 5", "results_limit: five", "retrieval.results_limit: int"), ("rrf_k: 60", "rrfk: 60", "retrieval.rrfk: unknown"), ("  repos_dir: /repos\n", "", "repos_dir: missing"), ("[index.md]", "index.md", "ignored_sources: a list"), ("enabled: true", "enabled: 1", "rerank.enabled: bool"), ("service:", "servce:", "service: a section")):
        path.write_text(CONFIG.replace(old, new))
        with pytest.raises(ValueError, match=re.escape(said)):
            config.Settings.from_yaml(str(path))


def test_request_checks(spark):
    names = {"llama3.1:8b": None, "hf.co/a/b:q4": None, "HF.co/a/b": None, "evil.io/a/b": "model registry host not allowed", "a/b/c/d": "invalid model name", "a//b": "invalid model name", "a/../b": "invalid model name", "-x": "name is invalid", "x" * 129: "name has over 128 characters", None: "name is missing"}
    rows = spark.createDataFrame([(n,) for n in names], "n string").select("n", checks.model_name_error(F.col("n")).alias("e")).collect()
    assert {r.n: r.e for r in rows} == names
    tried = [("k", ["1", "7"], None), ("k", ["0"], "k values must be positive integers"), ("k", ["x", "1"], "k values must be positive integers"), ("k", ["99999999999999999999"], "k values must be positive integers"), ("model", ["a:1", "b c"], "invalid model names: b c"), ("model", ["a"], None), ("k", [], "no values"), ("k", None, "no values"), ("model", [None], "invalid model names: null")]
    frame = spark.createDataFrame([(i, p, v) for i, (p, v, _) in enumerate(tried)], "i int, p string, v array<string>")
    got = {r.i: r.e for r in frame.select("i", checks.values_error(F.col("p"), F.col("v")).alias("e")).collect()}
    assert got == {i: e for i, (_, _, e) in enumerate(tried)}
    made = [("deep_wiki", "https://x/y", ["ask"], 30, 4000, None), ("Deep", "https://x", [], 30, 4000, "name is invalid"), ("d", "ftp://x", [], 30, 4000, "url is invalid"), ("d", "http://x", ["a b"], 30, 4000, "a tool is invalid"), ("d", "http://x", [], 0, 4000, "timeout_s is not 1 to 300"), ("d", "http://x", [], None, 99, "max_result_chars is not 100 to 100000")]
    frame = spark.createDataFrame([(i, *m[:-1]) for i, m in enumerate(made)], "i int, n string, u string, a array<string>, t int, m int")
    got = {r.i: r.e for r in frame.select("i", checks.integration_error(*map(F.col, "nuatm")).alias("e")).collect()}
    assert got == {i: m[-1] for i, m in enumerate(made)}


def test_fixed_pages(spark):
    rows = spark.range(60)
    assert [r.id for r in listing.experiments_page(rows, 2, 1).collect()] == [58, 57] and listing.experiments_page(rows).count() == 25
    assert [r.id for r in listing.misses_page(rows, 2).collect()] == [0, 1]
    with pytest.raises(ValueError):
        listing.experiments_page(rows, 201)


def test_results_say_how_long_they_took():
    @dataclass(frozen=True)
    class Result:
        elapsed: float = 0.0

    @timing.measured
    def slow():
        time.sleep(0.02)
        return Result()

    assert 0.02 <= slow().elapsed < 5 and slow.__name__ == "slow"


def test_guards(spark):
    rows = spark.createDataFrame([(1, "running", "")], "id int, status string, conclusion string")
    with pytest.raises(ValueError):
        listing.conclude(rows, 1, "x")
    with pytest.raises(LookupError):
        listing.lookup(rows, "id", 9)
    with pytest.raises(ValueError):
        listing.within("x", 2, 1)
    with pytest.raises(ValueError):
        listing.guarded_delete(rows, "id", 1, rows.withColumnRenamed("id", "ref"), "ref")


def test_question_import(spark):
    content = "# note\n\nq1 | a, b\nq2 | NONE\nq3\nq1 | c\r\n"
    got = {r.question: r.marked_sources for r in questions.parse_import(spark.createDataFrame([(content,)], "content string")).collect()}
    assert got == {"q1": ["a", "b"], "q2": [], "q3": []}


def test_question_files(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"question":"q","reference_answer":"old"}\n\n{"question":"q","reference_answer":"new","source":"s"}\n')
    assert [(r.question, r.reference_answer) for r in questions.read_jsonl(spark, str(tmp_path / "a.jsonl")).collect()] == [("q", "new")]
    (tmp_path / "b.tsv").write_text('set_name\tlanguage\tkind\tmarked_sources\toriginal_text\ns\teng\t\ta,,b\t"q"\n\nt\t\tk\t\tq2\nlate\t\t\tc\t"q"\nshort\n')
    read = questions.read_tsv(spark, str(tmp_path / "b.tsv"))
    rows = {r.set_name: r for r in read.collect()}
    assert rows["s"].marked_sources == ["a", "b"] and rows["s"].kind is None and rows["t"].marked_sources == [] and rows["short"].original_text is None
    made = {r.original_text: r for r in questions.question_rows(read.filter("original_text is not null"), spark.createDataFrame([("q2", "ref")], "question string, reference_answer string")).collect()}
    assert made['"q"'].set_name == "s" and made["q2"].reference_answer == "ref" and len(made) == 2


def test_datasets_are_written_and_read_back(spark, tmp_path):
    answers = spark.createDataFrame([("a 'b' \"c\" \\\\d", "x", "s.md"), (" padded ", None, None), ("é, #", "y", "")], "question string, reference_answer string, source string")
    questions.write_jsonl(answers.repartition(2), str(tmp_path / "j"))
    back = questions.read_jsonl(spark, str(tmp_path / "j"))
    assert sorted(map(tuple, back.collect()), key=str) == sorted(map(tuple, answers.collect()), key=str)
    questions.write_tsv(questions.dataset_rows(answers).repartition(2), str(tmp_path / "t"))
    got = {r.original_text: (r.set_name, r.language, r.kind, r.marked_sources) for r in questions.read_tsv(spark, str(tmp_path / "t")).collect()}
    assert got == {r.question: ("interview", "eng", "in_corpus", [r.source] if r.source else []) for r in answers.collect()}


def test_readme_pairs(spark):
    text = "intro\n## 1. First *one*?\nanswer a\n\n## 2. Second?\nanswer b\n## Other\nmore"
    got = questions.qa_pairs(spark.createDataFrame([("s", text)], "source string, text string")).orderBy("number").collect()
    assert [(r.question, r.answer) for r in got] == [("First one?", "answer a"), ("Second?", "answer b\n## Other\nmore")]


def test_markdown_corpora(spark, tmp_path):
    root = tmp_path / "sheets"
    root.mkdir()
    (root / "go.md").write_text("---\ncategory: Go\n---\n# Go\ntext")
    (root / "secret.md").write_text("---\ncategory: Hidden\n---\nx")
    (root / "drop.md").write_text("x")
    (root / "odd.md").write_bytes(b"caf\xff x")
    spec = markdown.cheatsheets(str(root), ("drop",), {"Go": "languages.go"}, {"odd": "misc.odd"})
    got = {r.source: r for r in markdown.documents(spark, spec).collect()}
    assert set(got) == {"sheets/go.md", "sheets/odd.md"}
    assert got["sheets/go.md"].category == "languages.go" and got["sheets/go.md"].title == "Go" and got["sheets/odd.md"].text == "caf x"
    docs = tmp_path / "redis"
    (docs / "commands").mkdir(parents=True)
    (docs / "docs" / "a").mkdir(parents=True)
    (docs / "commands" / "get.md").write_text("# GET")
    (docs / "docs" / "a" / "b c.md").write_text("# B")
    got = {r.source: r.category for r in markdown.documents(spark, markdown.redis_docs(str(docs))).collect()}
    assert got == {"redis/commands/get.md": "databases.redis.commands.get", "redis/docs/a/b c.md": "databases.redis.docs.a.b_c"}


def test_files_as_a_data_source(spark, tmp_path):
    root = tmp_path / "tree"
    (root / "a" / "deep").mkdir(parents=True)
    (root / "a" / "one.md").write_bytes(b"\xff\xfe# One\r\nline\rend\xc3\xa9")
    (root / "a" / "deep" / "two.md").write_text("---\ntitle: 'Two: it'\ntags: [x, 'y z']\nnested:\n  k: [1, 2]\ndate: 2020-01-02\nempty:\n---\n\nbody\n\n")
    (root / "a" / "skip.md").write_text("no")
    (root / "a" / "three.txt").write_text("no")
    files.register(spark)

    def read():
        return spark.read.format("markdown_files").option("frontMatter", "true").option("denied", '["skip"]')

    got = {r.path: r for r in read().load(f"file://{root}").collect()}
    assert set(got) == {"a/one.md", "a/deep/two.md"} and got["a/one.md"].text == "# One\nline\nendé"
    two = got["a/deep/two.md"]
    assert (two.text, two.tags, two.stem) == ("body", ["x", "y z"], "two")
    assert two.meta == {"title": "Two: it", "tags": '["x", "y z"]', "nested": '{"k": [1, 2]}', "date": "2020-01-02", "empty": ""}
    flat = read().option("scans", '[["a", "*.md", false]]').load(str(root))
    assert [r.path for r in flat.collect()] == ["a/one.md"]
    small = read().option("partitionFiles", "1").load(str(root))
    assert small.rdd.getNumPartitions() == 2 and small.count() == 2
    assert read().load(str(tmp_path / "none")).count() == 0


def test_unwanted_files_are_not_opened(spark, tmp_path):
    for i in range(6):
        (tmp_path / f"f{i}.md").write_text("---\n- no mapping\n---\n" if i == 5 else f"text {i}")
    files.register(spark)
    rows = spark.read.format("markdown_files").option("frontMatter", "true").option("partitionFiles", "1").option("stems", '["f1", "f2"]').load(str(tmp_path))
    assert rows.rdd.getNumPartitions() == 2 and sorted(r.path for r in rows.collect()) == ["f1.md", "f2.md"]
    every = spark.read.format("markdown_files").option("frontMatter", "true").option("denied", '["f5"]').load(str(tmp_path))
    assert every.filter("stem = 'f1'").count() == 1 and every.count() == 5  # a filter stays with its own query
    with pytest.raises(Exception, match="f5.md"):
        spark.read.format("markdown_files").option("frontMatter", "true").load(str(tmp_path)).collect()


def test_front_matters():
    assert files.front_matter("text\n") == ({}, "text")
    assert files.front_matter("---\n---\nx") == ({}, "x") and files.front_matter("--- x\na: 1\n---\n")[0] == {}
    assert files.front_matter("---\na: 1\n---") == ({"a": 1}, "")
    assert files._flat("a: 'x: y'\nb: [p, \"q r\"]\n  c: no\n# d") == {"a": "x: y", "b": ["p", "q r"]}
    for bad in ("---\n[1\n---\n", "---\njust text\n---\n"):
        with pytest.raises(ValueError):
            files.front_matter(bad)


def test_corpora_that_are_there(spark, tmp_path):
    for name in ("js-interview-questions", "notes"):
        (tmp_path / name).mkdir()
        (tmp_path / name / "README.md").write_text(f"# {name}\ntext")
    specs = [markdown.interview("go-interview-questions", str(tmp_path / "go-interview-questions")), markdown.notes(str(tmp_path / "notes"))]
    specs[0] = replace(specs[0], git_url="http://x/go")
    assert [s.name for s in markdown.available(spark, specs)] == ["notes"]
    found = markdown.readmes(spark, "http://x", ["js-interview-questions", "go-interview-questions"], str(tmp_path)).collect()
    assert [(r.corpus, r.category, r.title) for r in found] == [("js-interview-questions", "interview.js", "js-interview-questions")]
    both = markdown.corpora(spark, specs).collect()
    assert [(r.source, r.language) for r in both] == [("notes/README.md", "rus")] and markdown.corpora(spark, specs[:1]).count() == 0


def test_job_folds(spark):
    events = [(1, i, k) for i, k in enumerate(["claim", "fail", "claim", "fail", "claim", "fail"])] + [(2, 0, "claim"), (2, 1, "cancel"), (2, 2, "complete")] + [(3, 0, "claim"), (3, 1, "defer")]
    got = {r.job_id: (r.status, r.attempts, r.wait_s) for r in queue.job_states(spark.createDataFrame(events, "job_id long, seq long, kind string")).collect()}
    assert got == {1: ("error", 3, 0), 2: ("cancelled", 0, 0), 3: ("new", 0, 30)}


def test_job_stream_agrees_with_the_fold(spark, tmp_path):
    events = [(j, i, k) for j in range(5) for i, k in enumerate(["claim", "fail", "claim", "complete" if j % 2 else "cancel"])]
    frame = spark.createDataFrame(events, "job_id long, seq long, kind string")
    frame.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = queue.job_state_stream(spark.readStream.schema(frame.schema).parquet(str(tmp_path / "in")))
    run = stream.writeStream.outputMode("update").format("memory").queryName("jobs_out").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    assert run.awaitTermination(120)
    assert sorted(map(tuple, spark.table("jobs_out").collect())) == sorted(map(tuple, queue.job_states(frame).collect()))


def test_events_of_a_later_trigger_count_in_their_order(spark, tmp_path):
    schema = "job_id long, seq long, kind string"
    late = [(1, 1, "fail"), (1, 3, "complete"), (2, 0, "claim"), (2, 2, "complete"), (3, 0, "claim")]
    early = [(1, 0, "claim"), (1, 2, "claim"), (2, 1, "cancel"), (3, 1, "defer")]
    seen = {}
    for rows in (late, early):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = queue.job_state_stream(spark.readStream.schema(schema).parquet(str(tmp_path / "in")))
        run = stream.writeStream.outputMode("update").foreachBatch(lambda df, _: seen.update({r.job_id: tuple(r)[1:] for r in df.collect()})).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        assert run.awaitTermination(120)
    want = queue.job_states(spark.createDataFrame(late + early, schema)).collect()
    assert seen == {r.job_id: tuple(r)[1:] for r in want} and seen[1][0] == "done" and seen[2][0] == "cancelled"


def test_transitions(spark):
    rows = spark.createDataFrame([(1, 0, "draft"), (1, 1, "running"), (1, 2, "draft")], "entity int, seq int, status string")
    assert [(r.before, r.status) for r in queue.illegal_transitions(rows).collect()] == [("running", "draft")]


def test_probes(spark):
    rows = spark.createDataFrame([("active", "e"), ("unreachable", None), ("disabled", "e")], "s string, e string")
    assert [r.x for r in rows.select(queue.probed(F.col("s"), F.col("e")).alias("x")).collect()] == ["unreachable", "active", "disabled"]


def test_backfill_computes_missing_vectors_only(spark):
    rows = spark.createDataFrame([(1, "a b", None), (2, "c", [1.0])], "id int, original_text string, embedding array<float>")
    got = {r.id: r.embedding for r in models.backfilled(rows).collect()}
    assert len(got[1]) == models.WIDTH and got[2] == [1.0]


def test_the_winner_is_compared_with_every_other_run(spark, sf_dir):
    """Against plain code, over all runs, axes and tests."""
    import json
    from collections import defaultdict

    from lodestone.plans import base, q_evals

    document = q_evals.x8_results_document(spark, sf_dir).collect()[0]
    runs, tests = (json.loads(document.results)[k] for k in ("runs", "tests"))
    logs = defaultdict(list)
    for r in base.logs(spark, sf_dir).orderBy("id").collect():
        logs[r.run_name].append(r)
    want = {}
    last = {r.question_id: r for r in logs[document.winner]}
    for run in set(logs) - {document.winner}:
        for axis in stats.AXES:
            d = [int(last[r.question_id][axis]) - int(r[axis]) for r in logs[run] if r.question_id in last and None not in (r[axis], last[r.question_id][axis])]
            if d:
                want[f"{document.winner} vs {run}", axis] = (len(d), round(sum(d) / len(d), 3))
    assert len(runs) == len(logs) > 4
    assert {(t["comparison"], t["axis"]): (t["n"], t["delta"]) for t in tests} == want
    assert {t["threshold"] for t in tests} == {round(0.05 / len(want), 5)}
