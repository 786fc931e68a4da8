"""Question banks, prompts, table merges and small expressions over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone import storage
from lodestone.functions import text
from lodestone.operators import corpus, listing, loglist, models, retrieval
from lodestone.plans import base, q_listing
from lodestone.plans.catalog import query
from lodestone.sources import files, questions


def _sha(column) -> F.Column:
    return F.sha2(column.cast("binary"), 256)


@query("s11_readme_pairs", "SELECT 'b' || (item_id % 7) AS source, item_id::INTEGER AS number, 'Title ' || item_id AS question, sha256(trim(text, ' ' || chr(10) || chr(9) || chr(13))) AS answer FROM benchmark")
def s11_readme_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items as numbered sections of READMEs, taken apart again."""
    section = F.concat(F.lit("## "), F.col("item_id"), F.lit(". **Title** _"), F.col("item_id"), F.lit("_\n"), F.col("text"), F.lit("\n"))
    parts = F.array_sort(F.collect_list(F.struct("item_id", section.alias("s"))))  # a README's sections
    docs = base.table(spark, sf_dir, "benchmark").groupBy(F.concat(F.lit("b"), F.col("item_id") % 7).alias("source")).agg(F.concat(F.lit("intro\n"), F.array_join(F.transform(parts, lambda p: p["s"]), "\n")).alias("text"))
    return questions.qa_pairs(docs).select("source", "number", "question", _sha(F.col("answer")).alias("answer"))


def _answers(spark, sf_dir) -> DataFrame:
    d = F.col("doc_id")
    return base.table(spark, sf_dir, "documents").select(F.concat(F.lit('"q" '), d, F.lit(" ?")).alias("question"), F.when(d % 3 != 0, F.col("text")).alias("reference_answer"), F.when(d % 4 != 0, F.col("source")).alias("source"))


@query("k9_jsonl", """SELECT '"q" ' || doc_id || ' ?' AS question, sha256(CASE WHEN doc_id % 3 <> 0 THEN text END) AS reference_answer, CASE WHEN doc_id % 4 <> 0 THEN source END AS source FROM documents""")
def k9_jsonl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions and answers written as JSON lines and read back."""
    path = storage.fresh(spark, "answers")
    questions.write_jsonl(_answers(spark, sf_dir), path)
    return questions.read_jsonl(spark, path).select("question", _sha(F.col("reference_answer")).alias("reference_answer"), "source")


@query("k10_question_dataset", """SELECT '"q" ' || doc_id || ' ?' AS original_text, sha256('"q" ' || doc_id || ' ?') AS text_hash, 'interview' AS set_name, CASE WHEN doc_id % 4 <> 0 THEN source ELSE '' END AS marked_sources, sha256(CASE WHEN doc_id % 3 <> 0 THEN text END) AS reference_answer FROM documents""")
def k10_question_dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dataset of the answers written as TSV, read back and joined with them."""
    answers, path = _answers(spark, sf_dir), storage.fresh(spark, "dataset")
    questions.write_tsv(questions.dataset_rows(answers), path)
    rows = questions.question_rows(questions.read_tsv(spark, path), answers)
    return rows.select("original_text", "text_hash", "set_name", F.array_join("marked_sources", ",").alias("marked_sources"), _sha(F.col("reference_answer")).alias("reference_answer"))


@query("s15_prompts", f"SELECT [{', '.join(repr(p) for p in questions.PURPOSES)}][n_nationkey % 7 + 1] AS purpose, n_nationkey::INTEGER AS version, n_name || chr(10) AS template FROM nation")
def s15_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompt files of every purpose and version, written and read."""
    purpose = F.element_at(F.array(*[F.lit(p) for p in questions.PURPOSES]), (F.col("n_nationkey") % 7 + 1).cast("int"))
    path = storage.fresh(spark, "prompts")
    name = F.concat(purpose, F.lit(".v"), F.col("n_nationkey"), F.lit(".txt"))
    files.written(base.table(spark, sf_dir, "nation").select(name.alias("path"), F.concat("n_name", F.lit("\n")).alias("text")), path)
    return questions.read_prompts(spark, path)


@query("p22_source_rows", "SELECT 's' || vec_id AS source, format('{:.3f}', vec_id / 7.0::DOUBLE)::DOUBLE AS vector_distance, format('{:.3f}', (vec_id * 2 + 1) / 16.0::DOUBLE)::DOUBLE AS score FROM embeddings")
def p22_source_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    v, none = F.col("vec_id"), F.lit(None).cast("int")
    rows = base.table(spark, sf_dir, "embeddings").select(F.concat(F.lit("s"), v).alias("source"), none.alias("vector_rank"), none.alias("keyword_rank"), (v / F.lit(7.0)).alias("vector_distance"), ((v * 2 + 1) / F.lit(16.0)).alias("score"))
    return retrieval.source_rows(rows).select("source", "vector_distance", "score")


@query("k21_backfilled", "SELECT item_id, item_id % 2 = 0 AS had, CASE WHEN item_id % 2 = 0 THEN 1 ELSE 64 END AS width FROM benchmark")
def k21_backfilled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions of which every other one has a vector, of one component."""
    item = F.col("item_id")
    rows = base.table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("original_text"), F.when(item % 2 == 0, F.array(F.lit(1.0).cast("float"))).alias("embedding"), (item % 2 == 0).alias("had"))
    return models.backfilled(rows).select("item_id", "had", F.size("embedding").alias("width"))


@query("f17_configurations", "SELECT doc_id, CASE lang WHEN 'en' THEN 'english' WHEN 'de' THEN 'russian' ELSE 'simple' END AS configuration FROM documents")
def f17_configurations(spark: SparkSession, sf_dir: str) -> DataFrame:
    declared = F.when(F.col("lang") == "en", "eng").when(F.col("lang") == "de", "rus").otherwise(F.col("lang"))
    return base.table(spark, sf_dir, "documents").select("doc_id", text.search_configuration(declared).alias("configuration"))


@query("f21_without_emphasis", "SELECT p_partkey, trim(replace(replace(replace(' *' || p_name || '* _' || p_type || '_ `' || p_size || '` ', '*', ''), '_', ''), '`', '')) AS plain FROM part")
def f21_without_emphasis(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = F.concat(F.lit(" *"), "p_name", F.lit("* _"), "p_type", F.lit("_ `"), F.col("p_size").cast("string"), F.lit("` "))
    return base.table(spark, sf_dir, "part").select("p_partkey", text.without_emphasis(marked).alias("plain"))


@query("f30_judge_prompts", "SELECT p_partkey, 'Question:' || chr(10) || p_name || chr(10) || chr(10) || '---' || chr(10) || chr(10) || 'Answer:' || chr(10) || p_type AS prompt FROM part")
def f30_judge_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return base.table(spark, sf_dir, "part").select("p_partkey", text.labelled({"Question": F.col("p_name"), "Answer": F.col("p_type")}).alias("prompt"))


@query("f41_trimmed_items", "SELECT p_partkey, array_to_string(string_split(p_name, ' '), '|') AS items FROM part")
def f41_trimmed_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = F.concat(F.lit(" ,"), F.replace("p_name", F.lit(" "), F.lit(" ,, ")), F.lit(","))
    return base.table(spark, sf_dir, "part").select("p_partkey", F.array_join(text.trimmed_items(marked), "|").alias("items"))


@query("k5_truncated", "SELECT count(*) FILTER (n_nationkey < 0) AS left_, (SELECT count(*) FROM (SELECT * FROM nation LIMIT 0)) AS again FROM nation")
def k5_truncated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations written, and what is left of them."""
    path = storage.fresh(spark, "nations")
    base.table(spark, sf_dir, "nation").write.parquet(path)
    corpus.truncate(spark, path)
    count = F.count(F.lit(1))
    return spark.read.parquet(path).agg(count.alias("left_"), F.count("n_name").alias("again"))


@query("k8_cascade", "SELECT n_nationkey, n_name FROM nation WHERE n_regionkey <> 2")
def k8_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nations that still have a region once one is gone."""
    gone = listing.lookup(base.table(spark, sf_dir, "region"), "r_regionkey", 2)
    return listing.cascade(base.table(spark, sf_dir, "nation"), "n_regionkey", gone, "r_regionkey").select("n_nationkey", "n_name")


@query("k8_guarded_delete", "SELECT doc_id FROM labels WHERE doc_id <> (SELECT min(doc_id) FROM labels)")
def k8_guarded_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels without the first; no page refers to it, as pages refer to none."""
    rows = base.table(spark, sf_dir, "labels").select("doc_id")
    first = rows.agg(F.min("doc_id")).first()[0]
    references = base.table(spark, sf_dir, "pages").select((-1 - F.col("page_id")).alias("ref"))
    return listing.guarded_delete(rows, "doc_id", first, references, "ref")


@query("k20_concluded", "SELECT o_orderkey AS id, CASE WHEN o_orderkey = (SELECT min(o_orderkey) FROM orders WHERE o_orderstatus = 'F') THEN 'concluded' WHEN o_orderstatus = 'F' THEN 'aggregated' ELSE 'running' END AS status, CASE WHEN o_orderkey = (SELECT min(o_orderkey) FROM orders WHERE o_orderstatus = 'F') THEN 'k wins' END AS conclusion FROM orders")
def k20_concluded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as experiments, of which the first aggregated one is concluded."""
    rows = base.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderstatus") == "F", "aggregated").otherwise("running").alias("status"), F.lit(None).cast("string").alias("conclusion"))
    return listing.conclude(rows, rows.filter("status = 'aggregated'").agg(F.min("id")).first()[0], "k wins")


@query("o7_random_sample", "SELECT 25 AS n, 25 AS different, true AS known")
def o7_random_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A random sample changes from run to run; how many rows it has doesn't."""
    rows = base.table(spark, sf_dir, "documents").select("doc_id")
    held = listing.random_sample(rows, 25)
    marked = storage.cut(held, "sample").join(rows.distinct().withColumn("known", F.lit(True)), "doc_id", "left")
    return marked.agg(F.count(F.lit(1)).cast("int").alias("n"), F.countDistinct("doc_id").cast("int").alias("different"), F.bool_and(F.coalesce("known", F.lit(False))).alias("known"))


@query("o8_misses_page", f"WITH {base.LOGS}, m AS (SELECT id, run_name FROM judged WHERE inside AND coalesce(list_position(list_transform(sources, lambda s: len(list_filter(marked_sources, lambda e: contains(s, e))) > 0), true), 0) = 0) SELECT * FROM m ORDER BY id LIMIT 50 OFFSET 5")
def o8_misses_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.operators import evals

    return listing.misses_page(evals.misses(base.logs(spark, sf_dir)).select("id", "run_name"), offset=5)


@query("l2_log_detail", f"WITH {q_listing.QUESTION_LOGS} SELECT id, run_name, sha256(question_text) AS question, 'c' AS context FROM lg LEFT JOIN qs USING (question_id) WHERE id = (SELECT max(id) FROM lg)")
def l2_log_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    logs, asked = q_listing.question_logs(spark, sf_dir)
    last = logs.agg(F.max("id")).first()[0]
    return loglist.detail(logs, asked, last).select("id", "run_name", _sha(F.col("question_text")).alias("question"), "context")
