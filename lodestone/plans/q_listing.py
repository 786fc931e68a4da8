"""Listings, text functions, question banks and the job queue."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone import storage
from lodestone.functions import language, text
from lodestone.operators import checks, corpus, evals, listing, loglist, models, registry
from lodestone.plans import base
from lodestone.plans.catalog import query
from lodestone.sources import questions
from lodestone.streaming import queue


@query("o5_orders_page", "SELECT * FROM orders ORDER BY o_totalprice DESC NULLS FIRST, o_orderkey OFFSET 40 LIMIT 20")
def o5_orders_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    page = listing.Page(20, 40, "price", "desc", {"price": "o_totalprice"}, "o_orderkey")
    return listing.paged(base.table(spark, sf_dir, "orders"), page, "o_orderkey")


@query("p7_name_contains", "SELECT p_partkey, p_name FROM part WHERE p_name ILIKE '%RED%'")
def p7_name_contains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return base.table(spark, sf_dir, "part").filter(listing.substring("p_name", "RED")).select("p_partkey", "p_name")


@query("p8_one_of", "SELECT event_id, event_type FROM events WHERE event_type IN (SELECT DISTINCT event_type FROM events ORDER BY 1 LIMIT 2)")
def p8_one_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = base.table(spark, sf_dir, "events")
    kinds = [r[0] for r in rows.select("event_type").distinct().orderBy("event_type").limit(2).collect()]
    return rows.filter(listing.one_of("event_type", kinds)).select("event_id", "event_type")


@query("p9_is_flag", "SELECT o_orderkey FROM orders WHERE (o_orderstatus = 'F') IS TRUE")
def p9_is_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = base.table(spark, sf_dir, "orders").withColumn("final", F.col("o_orderstatus") == "F")
    return rows.filter(listing.is_flag("final", True)).select("o_orderkey")


@query("p10_time_range", "SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-05' AND ts <= TIMESTAMP '2024-01-09'")
def p10_time_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    from datetime import datetime

    return base.table(spark, sf_dir, "events").filter(listing.within("ts", datetime(2024, 1, 5), datetime(2024, 1, 9))).select("event_id")


@query("p11_open_range", "SELECT event_id FROM events WHERE ts > TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-09'")
def p11_open_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    from datetime import datetime

    return base.table(spark, sf_dir, "events").filter(listing.within("ts", datetime(2024, 1, 5), datetime(2024, 1, 9), strict=True)).select("event_id")


@query("p12_has_error", "SELECT doc_id FROM documents LEFT JOIN labels USING (doc_id) WHERE toxic IS NOT NULL")
def p12_has_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = base.table(spark, sf_dir, "documents").join(base.table(spark, sf_dir, "labels"), "doc_id", "left")
    return rows.filter(listing.has_error("toxic", True)).select("doc_id")


@query("p13_array_contains", "SELECT doc_id FROM documents WHERE list_contains([lang, source], 'en')")
def p13_array_contains(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = base.table(spark, sf_dir, "documents").withColumn("allowed", F.to_json(F.array("lang", "source")))
    return rows.filter(listing.holds("allowed", "en")).select("doc_id")


@query("p14_json_text", "SELECT event_id FROM events WHERE json_extract_string(props, '$.k') = '5'")
def p14_json_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return base.table(spark, sf_dir, "events").filter(listing.json_text("props", "k") == "5").select("event_id")


@query("p15_json_number", "SELECT event_id FROM events WHERE json_extract_string(props, '$.k') IS NULL OR json_extract_string(props, '$.k')::INTEGER < 3")
def p15_json_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    return base.table(spark, sf_dir, "events").filter(listing.absent_or_below("props", "k", 3)).select("event_id")


@query("p21_model_names", r"""WITH n AS (SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN p_brand WHEN 1 THEN 'hf.co/x/' || p_size WHEN 2 THEN 'other.co/x/' || p_size WHEN 3 THEN 'a//' || p_size WHEN 4 THEN lower(replace(p_type, ' ', '-')) || ':' || p_size ELSE 'a/b/c/' || p_size END AS name, CASE WHEN p_partkey % 2 = 0 THEN 'model' ELSE 'k' END AS param, (p_size - 2)::VARCHAR AS value FROM part),
e AS (SELECT *, regexp_full_match(name, '[a-zA-Z0-9][a-zA-Z0-9._/-]*(:[a-zA-Z0-9._-]+)?') AS good, string_split(name, '/') AS parts FROM n)
SELECT p_partkey, CASE WHEN NOT good THEN 'name is invalid' WHEN list_contains(parts, '') OR len(parts) > 3 THEN 'invalid model name' WHEN len(parts) = 3 AND parts[1] NOT IN ('hf.co', 'registry.ollama.ai') THEN 'model registry host not allowed' END AS name_error,
  CASE WHEN param = 'model' AND NOT good THEN 'invalid model names: ' || name WHEN param = 'k' AND value::INTEGER < 1 THEN 'k values must be positive integers' END AS values_error FROM e""")
def p21_model_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is wrong with names and values that parts ask for."""
    at, size = F.col("p_partkey") % 6, F.col("p_size").cast("string")
    typed = F.concat(F.lower(F.replace("p_type", F.lit(" "), F.lit("-"))), F.lit(":"), size)
    name = F.when(at == 0, F.col("p_brand")).when(at == 1, F.concat(F.lit("hf.co/x/"), size)).when(at == 2, F.concat(F.lit("other.co/x/"), size)).when(at == 3, F.concat(F.lit("a//"), size)).when(at == 4, typed).otherwise(F.concat(F.lit("a/b/c/"), size))
    rows = base.table(spark, sf_dir, "part").select("p_partkey", name.alias("name"), F.when(F.col("p_partkey") % 2 == 0, "model").otherwise("k").alias("param"), (F.col("p_size") - 2).cast("string").alias("value"))
    tried = F.when(F.col("param") == "model", F.array("name")).otherwise(F.array("value"))
    return rows.select("p_partkey", checks.model_name_error(F.col("name")).alias("name_error"), checks.values_error(F.col("param"), tried).alias("values_error"))


@query("l1_lookup", "SELECT * FROM customer WHERE c_custkey = 7")
def l1_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listing.lookup(base.table(spark, sf_dir, "customer"), "c_custkey", 7)


@query("o6_seeded_sample", "SELECT o_orderkey, o_custkey FROM orders ORDER BY md5(o_orderkey || '42'), o_orderkey LIMIT 100")
def o6_seeded_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listing.seeded_sample(base.table(spark, sf_dir, "orders"), 100, 42, "o_orderkey").select("o_orderkey", "o_custkey")


@query("k3_insert_new", "SELECT l_orderkey, first(mode ORDER BY line, mode) AS mode FROM (SELECT l_orderkey, l_returnflag || l_linestatus AS mode, min(l_linenumber) AS line FROM lineitem GROUP BY ALL) WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F') GROUP BY l_orderkey")
def k3_insert_new(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first line of each order that isn't closed yet."""
    held = base.table(spark, sf_dir, "orders").filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"))
    lines = base.table(spark, sf_dir, "lineitem").groupBy("l_orderkey", F.concat("l_returnflag", "l_linestatus").alias("mode")).agg(F.min("l_linenumber").alias("line"))
    return listing.insert_new(held, lines, "l_orderkey", F.struct("line", "mode")).select("l_orderkey", "mode")


@query("k13_upsert", "SELECT s_suppkey, CASE WHEN s_suppkey % 4 = 0 THEN 'moved' ELSE s_name END AS s_name FROM supplier")
def k13_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = base.table(spark, sf_dir, "supplier").select("s_suppkey", "s_name")
    return listing.upsert(rows, rows.filter("s_suppkey % 4 = 0").withColumn("s_name", F.lit("moved")), "s_suppkey")


def _prompts(spark, sf_dir):
    return base.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("purpose"), F.col("p_partkey").alias("version"), (F.col("p_partkey") == 5).alias("active"))


_PROMPTS = "WITH prompts AS (SELECT p_partkey AS id, p_brand AS purpose, p_partkey AS version, p_partkey = 5 AS active FROM part)"


@query("a7_freshest", f"{_PROMPTS} SELECT purpose, max(version) AS version, arg_max(id, version) AS id FROM prompts WHERE purpose NOT IN (SELECT purpose FROM prompts WHERE active) GROUP BY purpose")
def a7_freshest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listing.freshest(_prompts(spark, sf_dir))


@query("a6_next_version", f"{_PROMPTS} SELECT coalesce(max(version), 0) + 1 AS version FROM prompts WHERE purpose = 'Brand#11'")
def a6_next_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listing.next_version(_prompts(spark, sf_dir), "Brand#11")


@query("k7_activate", f"{_PROMPTS} SELECT id, purpose, version, CASE WHEN purpose = 'Brand#11' THEN id = 9 ELSE active END AS active FROM prompts")
def k7_activate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listing.activate(_prompts(spark, sf_dir), "Brand#11", 9)


@query("so2_difference", "SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels")
def so2_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without a label."""
    return listing.missing_from(base.table(spark, sf_dir, "documents").select("doc_id"), base.table(spark, sf_dir, "labels").select("doc_id"))


@query("so4_union", "SELECT CASE WHEN contains(n, ':') THEN n ELSE n || ':latest' END AS name FROM (SELECT c_mktsegment AS n FROM customer UNION SELECT s_name FROM supplier)")
def so4_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments as roles' models and suppliers as candidates."""
    roles, candidates = base.table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("name")), base.table(spark, sf_dir, "supplier").select(F.col("s_name").alias("name"))
    return registry.wanted_models(roles, candidates)


@query("so1_concatenate", "SELECT item_id AS id, text FROM benchmark UNION ALL SELECT doc_id, text FROM documents")
def so1_concatenate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listing.concatenated(base.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), "text"), base.table(spark, sf_dir, "documents").select("text", F.col("doc_id").alias("id")))


@query("j7_role_models", "SELECT 'c' || c_custkey AS role, n_name AS name, CASE n_regionkey WHEN 0 THEN 'ready' ELSE 'new' END AS status FROM customer JOIN nation ON c_nationkey = n_nationkey")
def j7_role_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as roles, nations as the models that they are given."""
    roles = base.table(spark, sf_dir, "customer").select(F.concat(F.lit("c"), F.col("c_custkey")).alias("role"), F.col("c_nationkey").alias("model_id"))
    models_ = base.table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"), F.when(F.col("n_regionkey") == 0, "ready").otherwise("new").alias("status"))
    return registry.role_models(roles, models_)


@query("k14_created_models", "SELECT s_name || ':latest' AS name, 'new' AS status, '{\"name\":\"' || s_name || ':latest\"}' AS options FROM supplier WHERE s_suppkey % 3 <> 0")
def k14_created_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The models that suppliers ask for and nobody has, with the pulls that they need."""
    rows = base.table(spark, sf_dir, "supplier")
    held = rows.filter("s_suppkey % 3 = 0").select(F.col("s_suppkey").alias("id"), text.model_tag(F.col("s_name")).alias("name"), F.lit("ready").alias("status"))
    models_, pulls = registry.found_or_created(held, rows.select(F.col("s_name").alias("name")))
    named = pulls.select(F.get_json_object("options", "$.name").alias("name"), "options")
    return models_.filter("status = 'new'").join(named, "name").select("name", "status", "options")


def question_logs(spark, sf_dir):
    """Assistants' turns as logs of the question that opens their conversation."""
    rows = base.table(spark, sf_dir, "conversations")
    turns = rows.groupBy("conv_id", "turn").agg(F.min_by("text", "text").alias("text"), F.min("role").alias("role"))
    none = F.lit(None).cast("string")
    stamp = F.timestamp_seconds(F.lit(1_700_000_000) + F.col("conv_id") * 60 + F.col("turn"))
    logs = turns.filter("turn > 0").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.concat(F.lit("run"), F.col("conv_id") % 3).alias("run_name"), F.when(F.col("turn") % 2 == 0, "agent").otherwise("single_shot").alias("pipeline"), F.when(F.col("conv_id") % 5 != 0, F.col("conv_id")).alias("question_id"), (F.length("text") > 200).alias("answered"), F.col("text").alias("answer"), F.lit("c").alias("context"), (F.col("turn") % 11).cast("string").alias("faithfulness"), none.alias("relevance"), none.alias("completeness"), stamp.cast("timestamp_ntz").alias("created_at"))
    questions_ = turns.filter("turn = 0").select(F.col("conv_id").alias("id"), F.col("text").alias("original_text"), F.concat(F.lit("set"), F.col("conv_id") % 2).alias("set_name"))
    return logs, questions_


QUESTION_LOGS = """turns AS (SELECT conv_id, turn, min(text) AS text FROM conversations GROUP BY conv_id, turn),
lg AS (SELECT conv_id * 1000 + turn AS id, 'run' || (conv_id % 3) AS run_name, CASE WHEN turn % 2 = 0 THEN 'agent' ELSE 'single_shot' END AS pipeline, CASE WHEN conv_id % 5 <> 0 THEN conv_id END AS question_id, length(text) > 200 AS answered, turn % 11 AS faithfulness, conv_id * 60 + turn AS at_ FROM turns WHERE turn > 0),
qs AS (SELECT conv_id AS question_id, text AS question_text, 'set' || (conv_id % 2) AS set_name FROM turns WHERE turn = 0)"""


@query("j5_question_logs", f"WITH {QUESTION_LOGS} SELECT id, run_name, answered, sha256(question_text) AS question, set_name FROM lg LEFT JOIN qs USING (question_id)")
def j5_question_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every log with its question, if it has one."""
    return loglist.items(*question_logs(spark, sf_dir)).select("id", "run_name", "answered", F.sha2(F.col("question_text").cast("binary"), 256).alias("question"), "set_name")


@query("j4_filtered_logs", f"WITH {QUESTION_LOGS} SELECT id, run_name, pipeline, set_name FROM lg JOIN qs USING (question_id) WHERE question_text ILIKE '%er%' AND set_name IN ('set0', 'set7') AND run_name IN ('run0', 'run2') AND answered AND faithfulness IN (1, 2, 3) AND at_ >= 600")
def j4_filtered_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The inner join that filters on the question ask for."""
    from datetime import datetime

    wanted = loglist.LogFilter(text="ER", set_name=("set0", "set7"), run_name=("run0", "run2"), answered=True, faithfulness=("1", "2", "3"), created_from=datetime(2023, 11, 14, 22, 23, 20))
    return loglist.items(*question_logs(spark, sf_dir), wanted).select("id", "run_name", "pipeline", "set_name")


def _run_jobs(spark, sf_dir):
    """Orders as jobs: an evaluation each, and a judge of the same run for most."""
    orders = base.table(spark, sf_dir, "orders")
    run = F.to_json(F.struct(F.concat(F.lit("r"), F.col("o_orderkey")).alias("run_name")))
    evaluations = orders.select((F.col("o_orderkey") * 2).alias("id"), F.lit("eval_run").alias("type"), F.when(F.col("o_orderstatus") == "F", "done").otherwise("running").alias("status"), run.alias("options"))
    judges = orders.filter("o_custkey % 3 <> 0").select((F.col("o_orderkey") * 2 + 1).alias("id"), F.lit("judge_answers").alias("type"), F.when(F.col("o_orderstatus") == "P", "done").otherwise("new").alias("status"), run.alias("options"))
    return evaluations.unionByName(judges)


@query("j13_dependents", "SELECT o_orderkey * 2 AS job, o_orderkey * 2 + 1 AS judge FROM orders WHERE o_custkey % 3 <> 0 AND o_orderstatus <> 'P'")
def j13_dependents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queue.dependents(_run_jobs(spark, sf_dir))


@query("f11_chunk_sizes", f"WITH t AS (SELECT doc_id AS key, text FROM documents), {base.chunk_ctes('t')} SELECT key AS doc_id, chunk_index, length(content)::INTEGER AS n_chars, sha256(content) AS text_hash FROM pieces")
def f11_chunk_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every chunk of every document."""
    docs = base.table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.posexplode(text.chunks(F.col("text"))).alias("chunk_index", "content")).select("doc_id", "chunk_index", F.length("content").alias("n_chars"), text.text_hash(F.col("content")).alias("text_hash"))


@query("f13_path_category", r"""SELECT page_id, array_to_string(list_transform(string_split(regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '\.[^./]*$', ''), '/'), lambda x: regexp_replace(x, '[^\p{L}\p{N}\p{M}_-]', '_', 'g')), '.') AS category FROM pages""")
def f13_path_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    return base.table(spark, sf_dir, "pages").select("page_id", text.category_of_path(F.regexp_replace("url", "^[a-z]+://", "")).alias("category"))


@query("f15_titles", "SELECT doc_id, nullif(trim(regexp_replace(string_split(text, chr(10))[1], '^#+', '')), '') AS title FROM documents")
def f15_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return base.table(spark, sf_dir, "documents").select("doc_id", text.title_of(F.col("text")).alias("title"))


@query("f18_lexemes", f"WITH {base.PLACED} SELECT d.doc_id, count(lexeme) AS n, md5(coalesce(string_agg(lexeme, ' ' ORDER BY pos), '')) AS digest FROM documents d LEFT JOIN placed ON id = doc_id GROUP BY d.doc_id")
def f18_lexemes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's lexemes: stems without stop words in English ones."""
    docs = base.table(spark, sf_dir, "documents").select("doc_id", "text", F.when(F.col("lang") == "en", "english").otherwise("simple").alias("configuration"))
    found = docs.select("doc_id", text.lexemes(F.col("text"), F.col("configuration")).alias("l"))
    return found.select("doc_id", F.size("l").cast("long").alias("n"), F.md5(F.array_join("l", " ").cast("binary")).alias("digest"))


@query("f16_detected_language", """WITH heard AS (SELECT doc_id, lang, unnest(regexp_extract_all(lower(text), '\\p{L}+')) AS word FROM documents),
counted AS (SELECT doc_id, lang, word, count(*) AS n FROM heard GROUP BY ALL),
grams AS (SELECT word, unnest([p[i:i] FOR i IN range(1, len(p) + 1) IF p[i:i] <> ' '] || [p[i:i + 1] FOR i IN range(1, len(p))] || [p[i:i + 2] FOR i IN range(1, len(p) - 1)]) AS gram FROM (SELECT DISTINCT word, ' ' || word || ' ' AS p FROM counted)),
profile AS (SELECT lang AS language, gram, sum(n) AS n FROM counted JOIN grams USING (word) WHERE lang IS NOT NULL GROUP BY ALL),
sized AS (SELECT *, sum(n) OVER (PARTITION BY language) AS total, (SELECT count(DISTINCT gram) FROM profile) AS kinds, (SELECT max(t) FROM (SELECT sum(n) AS t FROM profile GROUP BY language)) AS largest FROM profile),
weighed AS (SELECT language, gram, round(1000 * (ln((n + 0.5::DOUBLE) / (total + 0.5::DOUBLE * kinds)) - ln(0.5::DOUBLE / (largest + 0.5::DOUBLE * kinds))))::BIGINT AS weight FROM sized),
words AS (SELECT word, language, sum(weight) AS weight FROM grams JOIN weighed USING (gram) GROUP BY ALL),
scored AS (SELECT doc_id, language, sum(n * weight)::BIGINT AS score FROM counted JOIN words USING (word) GROUP BY ALL)
SELECT d.doc_id, s.language, s.score FROM documents d LEFT JOIN (SELECT * FROM scored WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, language) = 1) s USING (doc_id)""")
def f16_detected_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document by n-gram profiles of the labelled documents."""
    docs = base.table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    return language.detected(docs, "doc_id", "text", language.profiles(docs, "lang", "text"))


@query("f16_configuration", "SELECT item_id, 'english' AS configuration FROM benchmark")
def f16_configuration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The configuration of every benchmark item by the seed profiles; the tables hold no
    Russian, which any other language than Russian makes English."""
    found = language.detected(base.table(spark, sf_dir, "benchmark"), "item_id", "text", language.seed_profiles(spark))
    return found.select("item_id", language.configured(F.col("language")).alias("configuration"))


@query("f22_text_hash", "SELECT doc_id, sha256(text) AS text_hash FROM documents")
def f22_text_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return base.table(spark, sf_dir, "documents").select("doc_id", text.text_hash(F.col("text")).alias("text_hash"))


@query("f24_run_names", "SELECT p_partkey, 'sweep_size_' || CASE WHEN length(p_size::VARCHAR) < 2 THEN lpad(p_size::VARCHAR, 2, '0') ELSE p_size::VARCHAR END AS run_name, regexp_replace(p_type, '[^a-zA-Z0-9._-]', '_', 'g') AS suffix FROM part")
def f24_run_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = base.table(spark, sf_dir, "part")
    return rows.select("p_partkey", text.run_name(F.lit("sweep"), F.lit("size"), F.col("p_size")).alias("run_name"), text.value_suffix(F.col("p_type")).alias("suffix"))


@query("f26_model_tags", "SELECT s_suppkey, CASE WHEN contains(s_name, ':') THEN s_name ELSE s_name || ':latest' END AS tag FROM supplier")
def f26_model_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return base.table(spark, sf_dir, "supplier").select("s_suppkey", text.model_tag(F.col("s_name")).alias("tag"))


@query("f28_truncate", "SELECT doc_id, left(text, 500) AS shown FROM documents")
def f28_truncate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return base.table(spark, sf_dir, "documents").select("doc_id", text.truncated(F.col("text"), 500).alias("shown"))


@query("f6_elapsed", "SELECT user_id, format('{:.1f}', epoch(max(ts)) - epoch(min(ts)))::DOUBLE AS elapsed FROM events GROUP BY user_id")
def f6_elapsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    ends = base.table(spark, sf_dir, "events").groupBy("user_id").agg(F.min("ts").alias("first"), F.max("ts").alias("last"))
    return ends.select("user_id", listing.elapsed(F.col("first"), F.col("last")).alias("elapsed"))


@query("s14_question_import", """SELECT DISTINCT line AS question, sha256(line) AS text_hash FROM (SELECT trim(unnest(string_split(text, chr(10)))) AS line FROM benchmark) WHERE line <> '' AND line NOT LIKE '#%'""")
def s14_question_import(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = base.table(spark, sf_dir, "benchmark").select(F.col("text").alias("content"))
    return questions.parse_import(lines).select("question", "text_hash")


@query("s22_embedding", r"""WITH w AS (SELECT doc_id, md5(unnest(regexp_extract_all(lower(text), '[^ \t\n\r\f\v]+'))) AS h FROM documents),
v AS (SELECT doc_id, ('0x' || h[15:16])::INTEGER % 64 AS slot, sum(CASE WHEN h[1:1] IN ('8', '9', 'a', 'b', 'c', 'd', 'e', 'f') THEN 1 ELSE -1 END)::DOUBLE AS x FROM w GROUP BY ALL)
SELECT doc_id, slot, round((x / sqrt(sum(x * x) OVER (PARTITION BY doc_id)))::FLOAT::DOUBLE, 6) AS value FROM v WHERE x <> 0""")
def s22_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The components of every document's vector that aren't 0."""
    docs = base.table(spark, sf_dir, "documents")
    vectors = docs.select("doc_id", F.posexplode(models.embedder()(F.col("text"))).alias("slot", "x"))
    return vectors.filter("x <> 0").select("doc_id", "slot", F.round(F.col("x").cast("double"), 6).alias("value"))


@query("w6_first_of_equal", "SELECT min(doc_id) AS doc_id, sha256(text) AS text_hash FROM documents GROUP BY text")
def w6_first_of_equal(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = base.table(spark, sf_dir, "documents").select("doc_id", text.text_hash(F.col("text")).alias("text_hash"))
    return listing.first_of_equal(rows, "text_hash", "doc_id")


def _jobs(spark, sf_dir):
    e = base.table(spark, sf_dir, "events")
    return e.select(F.col("event_id").alias("id"), F.col("event_type").alias("type"), F.when(F.col("user_id") % 2 == 0, "default").otherwise("io").alias("queue"), F.when(F.col("event_id") % 3 == 0, "done").otherwise("new").alias("status"), F.col("props").alias("options"), F.col("ts").alias("apply_since"))


_JOBS = "WITH jobs AS (SELECT event_id AS id, event_type AS type, CASE WHEN user_id % 2 = 0 THEN 'default' ELSE 'io' END AS queue, CASE WHEN event_id % 3 = 0 THEN 'done' ELSE 'new' END AS status, props AS options, ts AS apply_since FROM events)"


@query("o10_claim_next", f"{_JOBS} SELECT id, queue FROM jobs WHERE status = 'new' AND queue = 'io' AND apply_since <= TIMESTAMP '2024-01-20' ORDER BY apply_since, id LIMIT 1")
def o10_claim_next(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queue.claim_next(_jobs(spark, sf_dir), F.lit("2024-01-20").cast("timestamp_ntz"), "io").select("id", "queue")


@query("t2_claim_each_lane", f"{_JOBS} SELECT id, queue FROM jobs WHERE status = 'new' AND apply_since <= TIMESTAMP '2024-01-20' QUALIFY row_number() OVER (PARTITION BY queue ORDER BY apply_since, id) = 1")
def t2_claim_each_lane(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queue.claim_each_lane(_jobs(spark, sf_dir), F.lit("2024-01-20").cast("timestamp_ntz")).select("id", "queue")


def _queue_events(spark, sf_dir):
    kinds = F.array(*[F.lit(k) for k in ("claim", "complete", "fail", "defer", "cancel", "claim", "fail")])
    return base.table(spark, sf_dir, "events").select(F.col("user_id").alias("job_id"), F.col("event_id").alias("seq"), F.element_at(kinds, (F.col("event_id") % 7 + 1).cast("int")).alias("kind"))


@query("t3_job_states", f"""WITH RECURSIVE ev AS (SELECT user_id AS job_id, ['claim','complete','fail','defer','cancel','claim','fail'][event_id % 7 + 1] AS kind, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events),
st AS (SELECT DISTINCT job_id, 0::BIGINT AS n, 'new' AS status, 0 AS attempts, 0::BIGINT AS wait_s FROM ev UNION ALL
SELECT e.job_id, e.n,
 CASE WHEN s.status = 'cancelled' THEN s.status WHEN e.kind = 'claim' AND s.status = 'new' THEN 'running' WHEN e.kind = 'complete' AND s.status = 'running' THEN 'done'
  WHEN e.kind = 'fail' AND s.status = 'running' THEN CASE WHEN s.attempts + 1 < 3 THEN 'new' ELSE 'error' END WHEN e.kind = 'defer' AND s.status = 'running' THEN 'new'
  WHEN e.kind = 'cancel' AND s.status IN ('new', 'running') THEN 'cancelled' ELSE s.status END,
 CASE WHEN e.kind = 'fail' AND s.status = 'running' THEN s.attempts + 1 ELSE s.attempts END,
 CASE WHEN s.status = 'cancelled' THEN s.wait_s WHEN e.kind = 'claim' AND s.status = 'new' THEN 0 WHEN e.kind = 'complete' AND s.status = 'running' THEN 0
  WHEN e.kind = 'fail' AND s.status = 'running' THEN CASE WHEN s.attempts + 1 < 3 THEN (s.attempts + 1) * 60 ELSE 0 END WHEN e.kind = 'defer' AND s.status = 'running' THEN 30
  WHEN e.kind = 'cancel' AND s.status IN ('new', 'running') THEN 0 ELSE s.wait_s END
FROM st s JOIN ev e ON e.job_id = s.job_id AND e.n = s.n + 1)
SELECT job_id, status, attempts, wait_s FROM st QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY n DESC) = 1""")
def t3_job_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queue.job_states(_queue_events(spark, sf_dir))


@query("t7_illegal_transitions", """WITH h AS (SELECT user_id AS entity, event_id AS seq, ['draft','running','aggregated','concluded'][event_id % 4 + 1] AS status FROM events),
s AS (SELECT *, lag(status) OVER (PARTITION BY entity ORDER BY seq) AS before FROM h)
SELECT * FROM s WHERE before IS NOT NULL AND before <> status AND before || '>' || status NOT IN ('draft>running', 'running>aggregated', 'running>failed', 'aggregated>concluded')""")
def t7_illegal_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    states = F.array(*[F.lit(k) for k in ("draft", "running", "aggregated", "concluded")])
    history = base.table(spark, sf_dir, "events").select(F.col("user_id").alias("entity"), F.col("event_id").alias("seq"), F.element_at(states, (F.col("event_id") % 4 + 1).cast("int")).alias("status"))
    return queue.illegal_transitions(history)


@query("t5_cancel", """WITH e AS (SELECT min(o_orderkey) AS k FROM orders WHERE o_custkey % 3 <> 0 AND o_orderstatus = 'O'),
j AS (SELECT o_orderkey * 2 AS id, o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'done' ELSE 'running' END AS status FROM orders UNION ALL SELECT o_orderkey * 2 + 1, o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'done' ELSE 'new' END FROM orders WHERE o_custkey % 3 <> 0)
SELECT id, CASE WHEN o_orderkey = k AND status IN ('new', 'running') THEN 'cancelled' ELSE status END AS status FROM j, e""")
def t5_cancel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An evaluation and the judge that waits for it, among all jobs."""
    first = base.table(spark, sf_dir, "orders").filter("o_custkey % 3 <> 0 AND o_orderstatus = 'O'").agg(F.min("o_orderkey")).first()[0]
    return queue.cancelled(_run_jobs(spark, sf_dir), first * 2).select("id", "status")


@query("k1_committed_chunks", f"WITH t AS (SELECT doc_id AS key, text FROM documents), {base.chunk_ctes('t')} SELECT count(*) AS chunks, sum(length(content))::BIGINT AS chars, true AS small FROM pieces")
def k1_committed_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All chunks, written at most a thousand rows a file."""
    docs = base.table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("source"), F.col("lang").alias("corpus"), F.col("lang").alias("category"), F.lit("unknown").alias("language"), "text")
    held = corpus.committed(corpus.chunk_rows(docs).drop("lexemes"), storage.fresh(spark, "chunks"), 1000)
    files = held.groupBy(F.input_file_name().alias("file")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("content")).alias("chars"))
    return files.agg(F.sum("n").alias("chunks"), F.sum("chars").alias("chars"), F.bool_and(F.col("n") <= 1000).alias("small"))


@query("a8_rounded_mean", "SELECT source, format('{:.2f}', avg(quality))::DOUBLE AS quality FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source")
def a8_rounded_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = base.table(spark, sf_dir, "documents").join(base.table(spark, sf_dir, "labels"), "doc_id", "left")
    return rows.groupBy("source").agg(evals.rounded_mean(F.col("quality").cast("string").cast("int")).alias("quality"))


@query("f20_formatted", "SELECT doc_id, '[' || source || ']' || chr(10) || text AS chunk FROM documents")
def f20_formatted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return base.table(spark, sf_dir, "documents").select("doc_id", text.formatted_chunk(F.col("source"), F.col("text")).alias("chunk"))


@query("f44_verdicts", """SELECT event_id, CASE WHEN json_extract_string(props, '$.k')::INTEGER BETWEEN 0 AND 10 THEN json_extract_string(props, '$.k')::INTEGER END AS score FROM events""")
def f44_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    reply = F.concat(F.lit('{"reason": "r", "score": '), listing.json_text("props", "k"), F.lit("}"))
    return base.table(spark, sf_dir, "events").select("event_id", text.verdict(reply)["score"].alias("score"))


@query("window_event_counts", "SELECT time_bucket(INTERVAL 1 DAY, ts) AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def window_event_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An extra beside the queue: tumbling day windows."""
    rows = base.table(spark, sf_dir, "events").groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"))
    return rows.select(F.col("w.start").cast("timestamp_ntz").alias("day"), "event_type", "n")

