"""Answering, agent, judging, experiment and queue-writing flows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone import config, storage
from lodestone.functions import text
from lodestone.operators import agent, experiment, flows, models
from lodestone.plans import base
from lodestone.plans.catalog import query
from lodestone.streaming import queue

DUE = "2024-01-20"
_NOW = f"TIMESTAMP '{DUE}'"


def _now() -> F.Column:
    return F.lit(DUE).cast("timestamp_ntz")


def _text(*parts) -> F.Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def _answers(spark, sf_dir) -> DataFrame:
    orders, lines = base.table(spark, sf_dir, "orders"), base.table(spark, sf_dir, "lineitem")
    questions = orders.select(F.col("o_orderkey").alias("query_id"), _text("Order ", F.col("o_orderkey")).alias("question"), F.when(F.col("o_custkey") % 2 == 0, "ru").otherwise("fr").alias("language"))
    content = _text("Line ", F.col("l_linenumber"), " of part ", F.col("l_partkey"), ". Flag ", F.col("l_returnflag"))
    name = F.when(F.col("l_partkey") % 11 == 0, "index").otherwise(_text("part", F.col("l_partkey") % 4))
    found = lines.select(F.col("l_orderkey").alias("query_id"), F.col("l_linenumber").alias("rank"), _text("d/", name, ".md").alias("source"), content.alias("content"))
    return flows.answers(questions, found)


_ANSWERS = r"""f AS (SELECT l_orderkey AS query_id, l_linenumber AS rank, 'd/part' || (l_partkey % 4) || '.md' AS source, 'Line ' || l_linenumber || ' of part ' || l_partkey || '. Flag ' || l_returnflag AS content FROM lineitem WHERE l_linenumber <= 5 AND l_partkey % 11 <> 0),
c AS (SELECT query_id, string_agg('[' || source || ']' || chr(10) || content, chr(10) || chr(10) ORDER BY rank, source, content) AS context FROM f GROUP BY query_id),
s AS (SELECT query_id, string_agg(source, ',' ORDER BY rank, source) AS sources FROM (SELECT query_id, source, min(rank) AS rank FROM f GROUP BY ALL) GROUP BY query_id),
answers AS (SELECT o_orderkey AS query_id, 'Order ' || o_orderkey AS question, context IS NOT NULL AS answered,
  CASE WHEN context IS NULL THEN 'No relevant documents found.' ELSE regexp_extract(context, '(?:^|\n)([^\[\n][^.\n]*\.?)', 1) END AS answer, context, coalesce(sources, '') AS sources
  FROM orders LEFT JOIN c ON c.query_id = o_orderkey LEFT JOIN s ON s.query_id = o_orderkey)"""


@query("c3_answers", f"WITH {_ANSWERS} SELECT * FROM answers")
def c3_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _answers(spark, sf_dir).withColumn("sources", F.array_join("sources", ","))


@query("c3_answered_questions")
def c3_answered_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items asked of the index: retrieval, rerank, context and answer."""
    questions = base.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("question"), F.lit("en").alias("language"))
    cfg = config.SearchConfig(distance_threshold=2.0, rerank=True)
    index = base.index(spark, sf_dir)
    return flows.answer(index, questions, models.embedder(), cfg=cfg, active_sources=base.active_sources(spark, sf_dir)).withColumn("sources", F.array_join("sources", ","))


def _logged(spark, sf_dir) -> DataFrame:
    return flows.log_rows(_answers(spark, sf_dir), None, config.SearchConfig(), {"generation": "offline"}, {"generate_answer": 3})


@query("k11_answer_log", f"WITH {_ANSWERS} SELECT query_id, NULL::VARCHAR AS run_name, answered, 'offline' AS generation, '3' AS prompt_version, '5' AS k, '0.55' AS threshold FROM answers")
def k11_answer_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _logged(spark, sf_dir)
    return rows.select("query_id", "run_name", "answered", rows["models"]["generation"].alias("generation"), rows["prompts"]["generate_answer"].alias("prompt_version"), rows["config"]["k"].alias("k"), rows["config"]["distance_threshold"].alias("threshold"))


@query("k23_judge_jobs", f"""WITH {_ANSWERS} SELECT 'judge_answers' AS type, 'default' AS queue, '{{"log_ids":[' || query_id || ']}}' AS options FROM answers WHERE answered""")
def k23_judge_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flows.judge_jobs(_logged(spark, sf_dir).withColumnRenamed("query_id", "id"))


#: The end of scripted conversations: rows ``b`` (conv_id, hop, text, n_calls, p, c) and what
#: their calls give, ``x`` (conv_id, hop, j, source, content).
_ENDS = """w AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY hop) - 1 = hop AS whole FROM b),
k AS (SELECT conv_id, min(hop) FILTER (whole AND hop < 4 AND n_calls = 0) AS stop, count(*) FILTER (whole AND hop < 4) AS reach FROM w GROUP BY conv_id),
e AS (SELECT conv_id, stop, coalesce(stop, reach) AS n, coalesce(stop, reach) + (stop IS NOT NULL OR reach < 4)::INTEGER AS calls FROM k),
o AS (SELECT conv_id, string_agg(source, ',' ORDER BY hop, j) AS sources FROM (SELECT x.conv_id, source, min(hop * 10 + j) // 10 AS hop, min(hop * 10 + j) % 10 AS j FROM x JOIN e ON e.conv_id = x.conv_id AND hop < n WHERE source IS NOT NULL GROUP BY x.conv_id, source) GROUP BY conv_id),
t AS (SELECT x.conv_id, string_agg(content, chr(10) || chr(10) ORDER BY hop, j) AS context FROM x JOIN e ON e.conv_id = x.conv_id AND hop < n WHERE content NOT LIKE 'error: %' GROUP BY x.conv_id),
g AS (SELECT e.*, coalesce(sources, '') AS sources, context, coalesce(l.text, '') AS said, coalesce(l.text, '') = '' AND sources IS NOT NULL AS need
  FROM e LEFT JOIN o ON o.conv_id = e.conv_id LEFT JOIN t ON t.conv_id = e.conv_id LEFT JOIN b l ON l.conv_id = e.conv_id AND l.hop = e.stop),
h AS (SELECT g.*, f.conv_id IS NOT NULL AS forced, coalesce(f.text, said) AS final FROM g LEFT JOIN b f ON need AND f.conv_id = g.conv_id AND f.hop = g.calls),
z AS (SELECT h.conv_id, coalesce(sum(p), 0)::BIGINT AS prompt_tokens, coalesce(sum(c), 0)::BIGINT AS completion_tokens, coalesce(max(p), 0)::BIGINT AS max_prompt_tokens
  FROM h LEFT JOIN b ON b.conv_id = h.conv_id AND (b.hop < n OR b.hop = stop OR forced AND b.hop = calls) GROUP BY h.conv_id)
SELECT conv_id, CASE WHEN final = '' AND sources = '' THEN 'No relevant documents found.' ELSE final END AS text, sources, (calls + forced::INTEGER)::INTEGER AS hops, final <> '' AND sources <> '' AS success,
  prompt_tokens, completion_tokens, max_prompt_tokens{more} FROM h JOIN z USING (conv_id)"""
_SCRIPT = """b AS (SELECT conv_id, turn // 2 AS hop, turn, CASE WHEN (conv_id + turn) % 6 = 0 THEN '' ELSE text END AS text, (conv_id + turn) % 3 AS n_calls, length(text) AS p, turn AS c FROM conversations WHERE role = 'assistant')"""


def _script(spark, sf_dir) -> DataFrame:
    """The assistants' turns of the conversations as a model's turns: how many tools each
    calls, and some without text."""
    rows = base.table(spark, sf_dir, "conversations").filter("role = 'assistant'")
    said = F.when((F.col("conv_id") + F.col("turn")) % 6 == 0, "").otherwise(F.col("text"))
    return rows.select("conv_id", "turn", F.expr("int(turn div 2)").alias("hop"), said.alias("text"), ((F.col("conv_id") + F.col("turn")) % 3).alias("n_calls"), F.length("text").alias("prompt_tokens"), F.col("turn").alias("completion_tokens"))


@query("c11_agent_answers", f"WITH {_SCRIPT}, x AS (SELECT conv_id, hop, 0 AS j, 's' || (turn % 5) AS source, NULL AS content FROM b WHERE n_calls > 0), {_ENDS.format(more='')}")
def c11_agent_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _script(spark, sf_dir).withColumn("sources", F.array(_text("s", F.col("turn") % 5)))
    return flows.agent_answers(turns).withColumn("sources", F.array_join("sources", ","))


@query("c4_agent_loop", f"""WITH {_SCRIPT}, y AS (SELECT *, unnest(range(n_calls)) AS j FROM b),
x AS (SELECT conv_id, hop, j, CASE WHEN (turn + j) % 4 <> 3 AND (conv_id + j) % 7 <> 0 AND turn % 5 <> 4 THEN 'q' || (turn % 5) || '.md' END AS source,
  CASE WHEN (turn + j) % 4 = 3 OR (conv_id + j) % 7 = 0 OR turn % 5 = 4 THEN 'error: any' ELSE 'about q' || (turn % 5) END AS content FROM y), {_ENDS.format(more=", context")}""")
def c4_agent_loop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation run by the loop: the script answers each batch of calls."""
    script = _script(spark, sf_dir)
    wrong = (F.col("conv_id") + F.col("j")) % 7 == 0
    arguments = F.when(wrong, "{broken").otherwise(_text('{"query": "q', F.col("turn") % 5, '", "odd": 1}'))
    call = F.struct(_text("c", F.col("j")).alias("id"), F.when((F.col("turn") + F.col("j")) % 4 == 3, "missing").otherwise("search_corpus").alias("name"), arguments.alias("arguments"))
    called = script.filter("n_calls > 0").withColumn("j", F.explode(F.sequence(F.lit(0), (F.col("n_calls") - 1).cast("int")))).groupBy("conv_id", "hop").agg(F.transform(F.array_sort(F.collect_list(F.struct("j", call.alias("call")))), lambda c: c["call"]).alias("calls"))
    turns = storage.cut(script.join(called, ["conv_id", "hop"], "left"), "script")

    def model(asked: DataFrame) -> DataFrame:
        return asked.select("conv_id", "hop").join(turns, ["conv_id", "hop"]).select("conv_id", "text", "calls", "prompt_tokens", "completion_tokens")

    def search(calls: DataFrame) -> DataFrame:
        asked = F.try_element_at("arguments", F.lit("query"))
        return calls.filter(asked != "q4").select("call_key", _text("about ", asked).alias("content"), F.array(_text(asked, ".md")).alias("sources"))

    questions = script.select("conv_id").distinct().select("conv_id", F.lit("what").alias("question"), F.lit(None).cast("string").alias("language"))
    ended = agent.run(questions, model, agent.registry(agent.Tool("search_corpus", search, ("query",))))
    return ended.drop("messages").withColumn("sources", F.array_join("sources", ","))


@query("j15_remote_tools", """WITH i AS (SELECT s_name AS integration, unnest(['a', 'b', 't' || (s_nationkey % 3)]) AS tool FROM supplier WHERE s_suppkey % 2 = 0)
SELECT integration || '__' || tool AS name, integration, tool, CASE tool WHEN 'a' THEN 'first' ELSE 'third' END AS description FROM i WHERE tool IN ('a', 't0')""")
def j15_remote_tools(spark: SparkSession, sf_dir: str) -> DataFrame:
    allowed = F.array(F.lit("a"), F.lit("b"), _text("t", F.col("s_nationkey") % 3))
    schemas = F.create_map(*[F.lit(x) for x in ("a", "first", "t0", "third")])
    status = F.when(F.col("s_suppkey") % 2 == 0, "active").otherwise("disabled")
    return flows.remote_tools(base.table(spark, sf_dir, "supplier").select(F.col("s_name").alias("name"), status.alias("status"), allowed.alias("allowed_tools"), schemas.alias("tool_schemas")))


@query("u3_dispatch", """WITH c AS (SELECT event_id AS call_id, event_type AS tool, CASE event_id % 5 WHEN 0 THEN '{broken' WHEN 1 THEN '' ELSE props END AS arguments FROM events),
e AS (SELECT *, CASE WHEN tool NOT IN ('click', 'purchase', 'signup') THEN 'error: unknown tool ''' || tool || '''' WHEN arguments = '{broken' THEN 'error: tool ''' || tool || ''' got invalid arguments' END AS error FROM c)
SELECT call_id, tool, error, CASE WHEN error IS NULL AND arguments <> '' AND tool <> 'purchase' THEN json_extract_string(CASE WHEN arguments LIKE '{"%' THEN arguments END, '$.k') END AS k FROM e""")
def u3_dispatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    place = F.col("event_id") % 5
    calls = base.table(spark, sf_dir, "events").select(F.col("event_id").alias("call_id"), F.col("event_type").alias("tool"), F.when(place == 0, "{broken").when(place == 1, "").otherwise(F.col("props")).alias("arguments"))
    tools = spark.createDataFrame([("click", ["k"]), ("purchase", ["z"]), ("signup", None)], "name string, declared array<string>")
    return flows.dispatched(calls, tools).select("call_id", "tool", "error", F.try_element_at("passed", F.lit("k")).alias("k"))


@query("f29_language_directive", "SELECT doc_id, 'Respond in ' || CASE lang WHEN 'en' THEN 'English' WHEN 'ru' THEN 'Russian' ELSE lang END || '.' AS directive FROM documents")
def f29_language_directive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return base.table(spark, sf_dir, "documents").select("doc_id", flows.language_directive(F.col("lang")).alias("directive"))


@query("f46_merged_options", """SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN p_type ELSE p_brand END AS brand, p_name AS name, p_size::VARCHAR AS attempts, 3 AS n FROM part""")
def f46_merged_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = F.create_map(F.lit("brand"), F.col("p_brand"), F.lit("name"), F.col("p_name"))
    more = F.create_map(F.lit("attempts"), F.col("p_size").cast("string"))
    second = F.when(F.col("p_size") % 2 == 0, F.create_map(F.lit("brand"), F.col("p_type"), F.lit("attempts"), F.col("p_size").cast("string"))).otherwise(more)
    rows = base.table(spark, sf_dir, "part").withColumn("m", flows.merged(first, second))
    return rows.select("p_partkey", *[F.try_element_at("m", F.lit(k)).alias(k) for k in ("brand", "name", "attempts")], F.size("m").alias("n"))


@query("k4_insert_or_get", "SELECT sha256(text) AS text_hash, coalesce(min(doc_id) FILTER (lang = 'en'), min(doc_id)) AS id, NOT bool_or(lang = 'en') AS inserted FROM documents GROUP BY text")
def k4_insert_or_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = base.table(spark, sf_dir, "documents").select(text.text_hash(F.col("text")).alias("text_hash"), F.col("doc_id").alias("id"), "lang")
    existing = rows.filter("lang = 'en'").groupBy("text_hash").agg(F.min("id").alias("id"))
    return flows.insert_or_get(existing, rows.drop("lang"), "text_hash")


@query("c7_eval_targets", "SELECT o_orderkey AS id, o_orderpriority AS set_name FROM orders WHERE o_orderkey IN (SELECT doc_id FROM labels)")
def c7_eval_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    questions = base.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("set_name"))
    return flows.eval_targets(questions, ids=base.table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id")))


@query("c6_paraphrased", """WITH p AS (SELECT array_to_string(list_reverse(string_split(text, ' ')), ' ') AS question, length(text) % 2 = 0 AS known FROM benchmark)
SELECT DISTINCT question, 'bench_para' AS set_name, sha256(question) AS text_hash FROM p WHERE question NOT IN (SELECT question FROM p WHERE known)""")
def c6_paraphrased(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = base.table(spark, sf_dir, "benchmark").select(F.col("text").alias("question"))
    existing = rows.filter(F.length("question") % 2 == 0).select(text.text_hash(flows.models.paraphrase(F.col("question"))).alias("text_hash"))
    return flows.paraphrased(rows, existing, "bench_para")


@query("c8_judged", f"""WITH {base.LOGS}, due AS (
SELECT id, 'faithfulness' AS axis, attempts AS used FROM logs WHERE answered AND faithfulness IS NULL AND context <> '' AND attempts < 3
UNION ALL SELECT id, 'relevance', 0 FROM logs WHERE answered AND relevance IS NULL
UNION ALL SELECT id, 'completeness', 0 FROM logs WHERE answered AND completeness IS NULL AND reference_answer IS NOT NULL)
SELECT id, axis, CASE WHEN id % 4 > 1 THEN (id % 11)::INTEGER END AS score, CASE WHEN id % 4 > 1 THEN axis END AS reason,
 CASE id % 4 WHEN 0 THEN 'invalid_json' WHEN 1 THEN 'invalid_score' END AS error, (used + CASE WHEN id % 4 > 1 THEN 0 ELSE 1 END)::INTEGER AS attempts FROM due""")
def c8_judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    def reply(axis: str) -> F.Column:
        place = F.col("id") % 4
        return F.when(place == 0, "not a verdict").when(place == 1, '{"reason": "r", "score": 42}').otherwise(_text('{"reason": "', F.lit(axis), '", "score": ', F.col("id") % 11, "}"))

    return flows.judged(base.logs(spark, sf_dir), {axis: reply(axis) for axis in ("faithfulness", "relevance", "completeness")})


@query("c9_sweep_jobs", """SELECT n_nationkey AS experiment_id, n_name || '_k_' || lpad(v, 2, '0') AS run_name, 'eval_run' AS type, 'default' AS queue,
'{"run_name":"' || n_name || '_k_' || lpad(v, 2, '0') || '","experiment_id":"' || n_nationkey || '","k":"' || v || '"}' AS options FROM nation, (SELECT unnest(['3', '5', '10']) AS v)""")
def c9_sweep_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = base.table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"), F.lit("k").alias("param"), F.array(F.lit(3), F.lit(5), F.lit(10)).alias("param_values"))
    return flows.sweep_jobs(rows)


def _experiments(spark, sf_dir) -> DataFrame:
    status = F.when(F.col("p_size") % 3 == 0, "draft").otherwise("running")
    runs = F.array(_text("src", F.col("p_size") % 20), _text("src", F.col("p_partkey") % 23))
    return base.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), status.alias("status"), runs.alias("run_names"))


_EXPERIMENTS = "x AS (SELECT p_partkey AS id, CASE WHEN p_size % 3 = 0 THEN 'draft' ELSE 'running' END AS status, ['src' || (p_size % 20), 'src' || (p_partkey % 23)] AS run_names FROM part)"


@query("j14_experiments_with", f"WITH {_EXPERIMENTS} SELECT id, run_name FROM (SELECT id, unnest(run_names) AS run_name FROM x) WHERE run_name IN (SELECT source FROM documents WHERE lang <> 'en')")
def j14_experiments_with(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flows.experiments_with(_experiments(spark, sf_dir), base.table(spark, sf_dir, "documents").filter("lang <> 'en'").select(F.col("source").alias("run_name")))


@query("t8_aggregated", f"""WITH {base.LOGS}, {_EXPERIMENTS}, n AS (SELECT run_name, count(*) AS n, count(*) FILTER (answered AND context <> '' AND faithfulness IS NULL) AS pending FROM logs GROUP BY run_name),
w AS (SELECT id, bool_and(coalesce(n, 0) > 0 AND coalesce(pending, 0) <= 0) AS whole FROM (SELECT id, unnest(run_names) AS run_name FROM x) LEFT JOIN n USING (run_name) GROUP BY id)
SELECT id, CASE WHEN status = 'running' AND whole THEN 'aggregated' ELSE status END AS status FROM x JOIN w USING (id)""")
def t8_aggregated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flows.aggregated(_experiments(spark, sf_dir), base.logs(spark, sf_dir)).select("id", "status")


@query("a17_index_totals", "SELECT count(DISTINCT source) AS sources, count(*) AS chunks FROM documents")
def a17_index_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flows.index_totals(base.table(spark, sf_dir, "documents"))


def _jobs(spark, sf_dir) -> DataFrame:
    kind = F.when(F.col("event_type") == "click", "eval_run").otherwise(F.col("event_type"))
    options = F.when(F.col("event_id") % 3 == 0, "{}").otherwise(_text('{"model":"m', F.col("user_id") % 40, '"}'))
    lane, status = F.when(F.col("user_id") % 2 == 0, "default").otherwise("io"), F.when(F.col("event_id") % 4 == 0, "done").otherwise("new")
    return base.table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), kind.alias("type"), lane.alias("queue"), status.alias("status"), options.alias("options"), F.col("ts").cast("timestamp_ntz").alias("apply_since"))


_JOBS = """jobs AS (SELECT event_id AS id, CASE WHEN event_type = 'click' THEN 'eval_run' ELSE event_type END AS type, CASE WHEN user_id % 2 = 0 THEN 'default' ELSE 'io' END AS queue,
CASE WHEN event_id % 4 = 0 THEN 'done' ELSE 'new' END AS status, CASE WHEN event_id % 3 = 0 THEN '{}' ELSE '{"model":"m' || (user_id % 40) || '"}' END AS options, ts AS apply_since FROM events)"""
_MODELS = "models AS (SELECT 'm' || n_nationkey AS name, CASE WHEN n_regionkey = 0 THEN 'pulling' ELSE 'ready' END AS status FROM nation)"
_STEPS = f"""{_JOBS}, {_MODELS}, steps AS (SELECT j.*, m.name AS known, json_extract_string(options, '$.model') AS model,
CASE WHEN json_extract_string(options, '$.model') IS NULL OR m.status = 'ready' THEN 'run' WHEN m.name IS NULL THEN 'pull' ELSE 'defer' END AS step FROM jobs j LEFT JOIN models m ON m.name = json_extract_string(options, '$.model'))"""


@query("t2_claimed", f"""WITH {_JOBS}, n AS (SELECT id FROM jobs WHERE status = 'new' AND apply_since <= {_NOW} QUALIFY row_number() OVER (PARTITION BY queue ORDER BY apply_since, id) = 1)
SELECT id, queue, CASE WHEN id IN (SELECT id FROM n) THEN 'running' ELSE status END AS status FROM jobs""")
def t2_claimed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queue.claimed(_jobs(spark, sf_dir), _now()).select("id", "queue", "status")


def _models(spark, sf_dir) -> DataFrame:
    return base.table(spark, sf_dir, "nation").select(_text("m", F.col("n_nationkey")).alias("name"), F.when(F.col("n_regionkey") == 0, "pulling").otherwise("ready").alias("status"))


@query("k14_readiness", f"WITH {_STEPS} SELECT id, model, step FROM steps")
def k14_readiness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queue.readiness(_jobs(spark, sf_dir), _models(spark, sf_dir)).select("id", "model", "step")


@query("t1_enqueue", f"""WITH {_STEPS} SELECT type, queue, status, count(*) AS n, count(DISTINCT id) AS ids FROM (SELECT id, type, queue, status FROM jobs
UNION ALL SELECT (SELECT max(id) FROM jobs) + row_number() OVER (), 'pull_llm_model', 'io', 'new' FROM (SELECT DISTINCT model FROM steps WHERE step = 'pull')) GROUP BY ALL""")
def t1_enqueue(spark: SparkSession, sf_dir: str) -> DataFrame:
    jobs = _jobs(spark, sf_dir)
    missing = queue.readiness(jobs, _models(spark, sf_dir)).filter("step = 'pull'").select(F.col("model").alias("name"))
    return queue.enqueue(jobs, queue.pull_jobs(missing), _now()).groupBy("type", "queue", "status").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("id").alias("ids"))


@query("u2_unhandled", f"WITH {_JOBS} SELECT id, 'no handler for type ' || type AS error FROM jobs WHERE type <> 'eval_run'")
def u2_unhandled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queue.unhandled(_jobs(spark, sf_dir))


@query("k16_pulled", f"WITH {_MODELS} SELECT name, CASE WHEN name = 'm0' THEN 'ready' ELSE status END AS status FROM models")
def k16_pulled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queue.pulled(_models(spark, sf_dir), "m0")


@query("k17_may_move", """WITH h AS (SELECT event_id, ['draft','active','unreachable','disabled'][event_id % 4 + 1] AS before, ['active','disabled','draft','unreachable'][user_id % 4 + 1] AS after FROM events)
SELECT event_id, before = after OR before || '>' || after IN ('draft>active', 'active>unreachable', 'unreachable>active', 'active>disabled', 'unreachable>disabled', 'disabled>active') AS allowed FROM h""")
def k17_may_move(spark: SparkSession, sf_dir: str) -> DataFrame:
    def state(names, at):
        return F.element_at(F.array(*[F.lit(n) for n in names]), (F.col(at) % 4 + 1).cast("int"))

    moved = queue.may_move(state(("draft", "active", "unreachable", "disabled"), "event_id"), state(("active", "disabled", "draft", "unreachable"), "user_id"))
    return base.table(spark, sf_dir, "events").select("event_id", moved.alias("allowed"))


@query("c10_bootstrap_jobs", """SELECT DISTINCT 'pull_llm_model' AS type, 'io' AS queue, '{"name":"' || s_name || ':latest"}' AS options FROM supplier WHERE s_name NOT IN (SELECT s_name FROM supplier WHERE s_acctbal > 0)""")
def c10_bootstrap_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = base.table(spark, sf_dir, "supplier")
    return flows.bootstrap_jobs(rows.select(F.col("s_name").alias("name")), rows.filter("s_acctbal > 0").select(F.concat("s_name", F.lit(":latest")).alias("name")))


@query("f44_verdict_errors", "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'invalid_json' WHEN json_extract_string(props, '$.k')::INTEGER NOT BETWEEN 0 AND 10 THEN 'invalid_score' END AS error FROM events")
def f44_verdict_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    reply = F.when(F.col("event_id") % 3 == 0, "score: 4").otherwise(_text('{"reason": "r", "score": ', F.get_json_object("props", "$.k"), "}"))
    return base.table(spark, sf_dir, "events").select("event_id", text.verdict_error(reply).alias("error"))


def _questions(spark, sf_dir) -> DataFrame:
    """Benchmark items as questions; the item is its own reference answer, and every
    third one isn't answered by the corpus."""
    item = F.col("item_id")
    marked = F.when(item % 3 != 0, F.array(_text("src", item % 5), _text("src", item % 7)))
    return base.table(spark, sf_dir, "benchmark").select(item.alias("id"), F.col("text").alias("original_text"), F.lit("bench").alias("set_name"), F.lit("en").alias("language"), text.text_hash(F.col("text")).alias("text_hash"), F.col("text").alias("reference_answer"), marked.alias("marked_sources"), F.lit(None).cast("array<float>").alias("embedding"))


@query("t8_experiment")
def t8_experiment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An experiment over paraphrased items from draft to results: three values of k. The
    chain is run twice, the second time a day later, and ``same`` says whether that has
    changed a row."""
    schema = "id long, name string, set_name string, param string, param_values array<string>, run_names array<string>, status string, started_at timestamp, finished_at timestamp, elapsed double, results string"
    drafts = spark.createDataFrame([(1, "sweep", "para", "k", ["1", "3", "5"], None, "draft", None, None, None, None)], schema)
    state = experiment.State(_questions(spark, sf_dir), spark.createDataFrame([], experiment.LOG), drafts)

    def services(day: str) -> experiment.Services:
        return experiment.Services(base.index(spark, sf_dir), F.lit(day).cast("timestamp"), base=config.SearchConfig(distance_threshold=2.0), paraphrases=(("bench", "para"),))

    ended = experiment.advance(state, services("2024-01-20 10:00:00"))
    again = experiment.advance(ended, services("2024-01-21 10:00:00"))
    tables = [(a, b) for a, b in zip(vars(ended).values(), vars(again).values(), strict=True)]
    same = all(a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty() for a, b in tables)
    logged = again.logs.groupBy().agg(F.count(F.lit(1)).alias("n_logs"), F.count_if("answered").alias("n_answered"))
    return again.experiments.crossJoin(logged).select("id", "status", "n_logs", "n_answered", F.get_json_object("results", "$.composite.winner").alias("winner"), "results", "elapsed", F.lit(same).alias("same"))
