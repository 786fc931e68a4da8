"""Retrieval queries: the flagship search and its parts."""

from __future__ import annotations

from dataclasses import astuple, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone import storage
from lodestone.config import SearchConfig
from lodestone.functions import blocks, language, stemming, text, vector
from lodestone.operators import corpus, evals, indexing, retrieval, searchindex
from lodestone.plans import base
from lodestone.plans.base import CHUNKS, PLACED, QUESTION, THRESHOLD, WORD, chunk_ctes, english_stems
from lodestone.plans.base import STOPS as _STOPS
from lodestone.plans.catalog import query
from lodestone.sources import files, markdown

CFG = SearchConfig(distance_threshold=THRESHOLD)
_TERMS = "[" + ", ".join(f"'{w}'" for w in QUESTION) + "]"
_OPEN = f"""WITH {CHUNKS}, {PLACED}, open AS (SELECT * FROM chunks WHERE source NOT LIKE '%3')"""
_VECTORS = f"""v AS (SELECT id, vector_distance, row_number() OVER (ORDER BY vector_distance, id) AS vector_rank FROM (
  SELECT id, round(list_cosine_distance(embedding, (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)), 9) + 0 AS vector_distance FROM open WHERE embedding IS NOT NULL)
  WHERE vector_distance <= {THRESHOLD} ORDER BY vector_distance, id LIMIT 20)"""


def _ranked(source: str, by: str = "") -> str:
    """``matched`` (id, keyword_score): ts_rank over (id, pos, lexeme, m) where all m lexemes of a question are held."""
    key = f"{by}id"
    return f"""hits AS ({source}),
full_ AS (SELECT {key}, any_value(m) AS m, count(*) AS places FROM hits GROUP BY {key} HAVING count(DISTINCT lexeme) = any_value(m)),
pairs AS (SELECT {", ".join(f"a.{c.strip()}" for c in key.split(","))}, sum(ln(1 - 0.1::DOUBLE * sqrt(1 / (1.005 + 0.05 * exp((b.pos - a.pos) / 1.5::DOUBLE - 2))))) AS logs
  FROM (SELECT h.* FROM hits h JOIN full_ USING ({key})) a JOIN (SELECT h.* FROM hits h JOIN full_ USING ({key})) b USING ({key}) WHERE a.lexeme <> b.lexeme AND b.pos > a.pos AND b.pos <= a.pos + 100 GROUP BY ALL),
matched AS (SELECT {key}, round(CASE WHEN m = 1 THEN 0.1::DOUBLE * list_sum(list_transform(range(1, places + 1), lambda j: 1 / (j * j)::DOUBLE)) / 1.64493406685::DOUBLE ELSE 1 - exp(coalesce(logs, 0)) END, 9) + 0 AS keyword_score FROM full_ LEFT JOIN pairs USING ({key}))"""


_KEYWORDS = f"""{_ranked(f"SELECT id, pos, lexeme, {len(QUESTION)} AS m FROM placed JOIN open USING (id) WHERE list_contains({_TERMS}, lexeme)")},
k AS (SELECT id, keyword_score, row_number() OVER (ORDER BY keyword_score DESC, id) AS keyword_rank FROM matched ORDER BY keyword_score DESC, id LIMIT 20)"""
_FUSED = """fused AS (SELECT coalesce(v.id, k.id) AS id, vector_distance, vector_rank, keyword_score, keyword_rank,
  round(coalesce(1.0::DOUBLE / (60 + vector_rank), 0) + coalesce(1.0::DOUBLE / (60 + keyword_rank), 0), 9) AS score FROM v FULL JOIN k ON v.id = k.id)"""


def _lexemes_of_question() -> list[str]:
    """The question's lexemes in the configuration of its language."""
    configuration = language.configuration_of(" ".join(QUESTION))
    return [stemming.lexeme(w, configuration) for w in QUESTION]


@query("c5_search_index", f"""WITH {CHUNKS}, {PLACED} SELECT (SELECT count(*) FROM chunks) AS chunks, (SELECT count(DISTINCT lexeme) FROM placed) AS lexemes, (SELECT count(*) FROM placed) AS places,
  (SELECT count(*) FROM chunks WHERE embedding IS NOT NULL) AS vectors, (SELECT count(DISTINCT category) + count(DISTINCT lang) FROM (SELECT category, language AS lang FROM chunks)) AS nodes""")
def c5_search_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index that the searches read, written on first use; what its tables hold."""
    index = base.index(spark, sf_dir)
    count = F.count(F.lit(1))
    held = index.postings.groupBy("lexeme").agg(F.sum(F.size("places")).alias("n")).agg(count.alias("lexemes"), F.sum("n").alias("places"))
    sizes = [index.chunks.agg(count.alias("chunks")), held, index.vectors.agg(count.alias("vectors")), index.nodes.agg(count.alias("nodes"))]
    return sizes[0].crossJoin(sizes[1]).crossJoin(sizes[2]).crossJoin(sizes[3])  # one row each


#: Some files have a front matter; hidden ones and one file name are left out.
_FILES = """f AS (SELECT lang || '/' || source || '/' || CASE WHEN doc_id % 13 = 0 THEN 'drafts' || doc_id ELSE 'd' || doc_id END || '.md' AS path, doc_id,
  CASE WHEN doc_id % 3 = 0 THEN 'T ' || doc_id END AS given, CASE doc_id % 4 WHEN 0 THEN 'Hidden' WHEN 1 THEN 'Odd' WHEN 2 THEN 'Even' END AS said, doc_id % 3 = 0 OR doc_id % 5 = 0 AS fronted, text FROM documents WHERE doc_id % 13 <> 0)"""


@query("s1_corpus_files", f"""WITH {_FILES}, kept AS (SELECT *, CASE WHEN fronted THEN said END AS category, CASE WHEN fronted THEN given END AS own, trim(replace(text, chr(13), chr(10)), ' ' || chr(9) || chr(10)) AS body FROM f)
SELECT 'corpus/' || path AS source, CASE category WHEN 'Odd' THEN 'numbers.odd' WHEN 'Even' THEN 'numbers.even' ELSE 'misc' END AS category,
  coalesce(own, nullif(trim(regexp_replace(string_split(body, chr(10))[1], '^#+', '')), '')) AS title, CASE WHEN fronted THEN 'a,b ' || doc_id ELSE '' END AS tags, sha256(body) AS text_hash FROM kept WHERE category IS DISTINCT FROM 'Hidden'""")
def s1_corpus_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents written as markdown files, some with a front matter, and read as a corpus."""
    d = F.col("doc_id")
    said = F.when(d % 4 == 0, "Hidden").when(d % 4 == 1, "Odd").when(d % 4 == 2, "Even")
    head = F.concat_ws("", F.lit("---\n"), F.when(d % 3 == 0, F.concat(F.lit("title: T "), d, F.lit("\n"))), F.concat(F.lit("category: "), said, F.lit("\n")), F.lit("tags:\n  - a\n  - 'b "), d, F.lit("'\n---\n"))
    name = F.concat(F.when(d % 13 == 0, "drafts").otherwise("d"), d)
    rows = base.table(spark, sf_dir, "documents").select(F.concat_ws("/", "lang", "source", F.concat(name, F.lit(".md"))).alias("path"), F.concat(F.when((d % 3 == 0) | (d % 5 == 0), head).otherwise(""), "text").alias("text"))
    root = f"{storage.fresh(spark, 'files')}/corpus"
    files.written(rows, root)
    named = {"Odd": "numbers.odd", "Even": "numbers.even"}
    spec = replace(markdown.cheatsheets(root, by_category=named), patterns=(("", "d[0-9]*.md", True),))
    found = markdown.documents(spark, spec)
    return found.select("source", "category", "title", F.array_join("tags", ",").alias("tags"), text.text_hash(F.col("text")).alias("text_hash"))


_CORPORA = """before AS (SELECT 'doc' || doc_id AS source, lang AS corpus, text FROM documents WHERE doc_id % 10 <> 7),
after_ AS (SELECT 'doc' || doc_id AS source, lang AS corpus, CASE WHEN doc_id % 10 = 5 THEN text || '!' ELSE text END AS text FROM documents WHERE doc_id % 10 <> 3)"""


@query("c5_incremental_build", f"""WITH {_CORPORA}, t AS (SELECT 1 AS build, * FROM before UNION ALL SELECT 2, * FROM after_), k AS (SELECT build || '#' || source AS key, text FROM t),
{chunk_ctes("k")}, held AS (SELECT key, count(*) AS n FROM pieces GROUP BY key),
rows AS (SELECT build, corpus, source, coalesce(n, 0) AS n, CASE WHEN build = 1 OR source IN (SELECT source FROM after_ EXCEPT SELECT source FROM before) THEN 'new' WHEN source LIKE '%5' THEN 'changed' ELSE 'same' END AS was FROM t LEFT JOIN held ON key = build || '#' || source),
counted AS (SELECT build, count(DISTINCT corpus) AS sources, sum(n) AS chunks, count(*) FILTER (was = 'new') AS new, count(*) FILTER (was = 'changed') AS changed, count(*) FILTER (was = 'same') AS same,
  CASE WHEN build = 2 THEN (SELECT count(*) FROM before WHERE source NOT IN (SELECT source FROM after_)) ELSE 0 END AS gone, coalesce(sum(n) FILTER (was <> 'same'), 0) AS embedded FROM rows GROUP BY build)
SELECT build, sources, chunks::BIGINT AS chunks, new, changed, same, gone, embedded::BIGINT AS embedded FROM counted
UNION ALL SELECT 3, sources, chunks::BIGINT, 0, 0, new + changed + same, 0, 0 FROM counted WHERE build = 2""")
def c5_incremental_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The languages as corpora, built three times: most documents; without some, with
    others changed and new; the same again, which embeds nothing."""
    docs = base.table(spark, sf_dir, "documents")
    rows = docs.select(F.concat(F.lit("doc"), F.col("doc_id")).alias("source"), F.col("lang").alias("corpus"), F.col("lang").alias("category"), F.lit("eng").alias("language"), F.lit(None).cast("string").alias("title"), "text", (F.col("doc_id") % 10).alias("d"))
    before = rows.filter("d <> 7").drop("d")
    after = rows.filter("d <> 3").withColumn("text", F.when(F.col("d") == 5, F.concat("text", F.lit("!"))).otherwise(F.col("text"))).drop("d")
    path = storage.fresh(spark, "store")
    entries = [indexing.Entry(r.lang) for r in docs.select("lang").distinct().collect()]  # one a corpus
    made = [indexing.build(d, path, entries) for d in (before, after, after)]
    return spark.createDataFrame([(i, *astuple(r)[:-1]) for i, r in enumerate(made, 1)], "build int, sources long, chunks long, new long, changed long, same long, gone long, embedded long")


@query("x1_hybrid_search", f"""{_OPEN}, {_VECTORS}, {_KEYWORDS}, {_FUSED}
SELECT f.*, c.source, c.category, length(c.content) AS n_chars FROM (SELECT * FROM fused ORDER BY score DESC, id LIMIT 5) f JOIN chunks c USING (id)""")
def x1_hybrid_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = retrieval.hybrid_search(base.index(spark, sf_dir), base.query_vector(spark, sf_dir), _lexemes_of_question(), CFG, base.active_sources(spark, sf_dir))
    return found.select("id", "vector_distance", "vector_rank", "keyword_score", "keyword_rank", "score", "source", "category", F.length("content").alias("n_chars"))


@query("o1_vector_leg", f"{_OPEN}, {_VECTORS} SELECT * FROM v")
def o1_vector_leg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.vector_leg(base.index(spark, sf_dir), base.query_vector(spark, sf_dir), CFG, base.active_sources(spark, sf_dir))


@query("s18_probed_neighbours")
def s18_probed_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest chunks of every vector whose id 20 divides, from as few cells as
    give a recall of 0.95 against the exact scan."""
    index, asked = base.index(spark, sf_dir), _asked(spark, sf_dir)
    return searchindex.probed_nearest(index, asked, 10, searchindex.calibrated(index, asked, 10)[0])


@query("o2_keyword_leg", f"{_OPEN}, {_KEYWORDS} SELECT * FROM k")
def o2_keyword_leg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.keyword_leg(base.index(spark, sf_dir), _lexemes_of_question(), CFG, base.active_sources(spark, sf_dir))


@query("p1_within_distance", """SELECT vec_id, d AS vector_distance FROM (SELECT vec_id, round(list_cosine_distance(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)), 9) + 0 AS d FROM embeddings) WHERE d <= 0.95""")
def p1_within_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = base.query_vector(spark, sf_dir)
    return base.table(spark, sf_dir, "embeddings").select("vec_id", vector.distance_to(F.col("embedding"), q).alias("vector_distance")).filter("vector_distance <= 0.95")


@query("p2_in_category", f"WITH {CHUNKS} SELECT id, category FROM chunks WHERE contains('.' || category || '.', '.src7.')")
def p2_in_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A range of the pre-order of categories, pushed down to the files."""
    index = base.index(spark, sf_dir)
    return retrieval.eligible(index.chunks, index, None, "src7").select("id", "category")


@query("s20_category_nodes", f"""WITH {CHUNKS}, p AS (SELECT DISTINCT unnest([string_split(category, '.')[1:i] FOR i IN range(1, len(string_split(category, '.')) + 1)]) AS l FROM chunks),
n AS (SELECT l, row_number() OVER (ORDER BY l) AS pre FROM p)
SELECT array_to_string(a.l, '.') AS category, a.pre, max(b.pre) AS last FROM n a JOIN n b ON b.l[1:len(a.l)] = a.l GROUP BY a.l, a.pre""")
def s20_category_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return base.index(spark, sf_dir).nodes


@query("p3_active_sources", f"WITH {CHUNKS} SELECT id, source FROM chunks WHERE source NOT LIKE '%3'")
def p3_active_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = base.index(spark, sf_dir)
    return retrieval.eligible(index.chunks, index, base.active_sources(spark, sf_dir)).select("id", "source")


@query("p4_full_text_match", f"WITH {PLACED} SELECT id FROM placed WHERE list_contains({_TERMS}, lexeme) GROUP BY id HAVING count(DISTINCT lexeme) = {len(QUESTION)}")
def p4_full_text_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = spark.createDataFrame([(0, w) for w in _lexemes_of_question()], "query_id long, lexeme string")
    return retrieval.matches_of_many(base.index(spark, sf_dir).postings, words).select("id")


_BATCH = f"""{_OPEN}, asked AS (SELECT item_id AS query_id, unnest(regexp_extract_all(lower(text), '{WORD}')) AS word FROM benchmark),
{english_stems("asked", "q")},
qw AS (SELECT DISTINCT query_id, coalesce(stem, word) AS lexeme FROM asked LEFT JOIN qstems USING (word) WHERE word NOT IN ({_STOPS})),
vv AS (SELECT query_id, id, vector_distance, row_number() OVER (PARTITION BY query_id ORDER BY vector_distance, id) AS vector_rank FROM (
  SELECT b.item_id AS query_id, o.id, round(list_cosine_distance(o.embedding, e.embedding::DOUBLE[]), 9) + 0 AS vector_distance FROM open o, benchmark b JOIN embeddings e ON e.vec_id = b.item_id WHERE o.embedding IS NOT NULL) WHERE vector_distance <= {THRESHOLD}),
{_ranked("SELECT q.query_id, p.id, p.pos, p.lexeme, m FROM (SELECT *, count(*) OVER (PARTITION BY query_id) AS m FROM qw) q JOIN placed p USING (lexeme) JOIN open USING (id)", "query_id, ")},
kk AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY keyword_score DESC, id) AS keyword_rank FROM matched),
ff AS (SELECT coalesce(v.query_id, k.query_id) AS query_id, coalesce(v.id, k.id) AS id, vector_distance, vector_rank, keyword_score, keyword_rank,
  round(coalesce(1.0::DOUBLE / (60 + vector_rank), 0) + coalesce(1.0::DOUBLE / (60 + keyword_rank), 0), 9) AS score
  FROM (SELECT * FROM vv WHERE vector_rank <= 20) v FULL JOIN (SELECT * FROM kk WHERE keyword_rank <= 20) k ON v.id = k.id AND v.query_id = k.query_id),
rr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM ff)
SELECT r.*, c.source, c.category FROM rr r JOIN chunks c USING (id) WHERE rank <= 5"""


def questions_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items as questions, their lexemes in the configuration of the language
    that the seed profiles give each."""
    items = base.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    spoken = language.detected(items, "query_id", "text", language.seed_profiles(spark)).select("query_id", language.configured(F.col("language")).alias("configuration"))
    asked = items.join(spoken, "query_id").select("query_id", "text", F.array_sort(F.array_distinct(text.lexemes(F.col("text"), F.col("configuration")))).alias("query_lexemes"))
    return asked.join(base.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_embedding")), "query_id", "left")


@query("x1_search_many", _BATCH)
def x1_search_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.search_many(base.index(spark, sf_dir), questions_of(spark, sf_dir), CFG, base.active_sources(spark, sf_dir))


@query("x2_rerank", f"""{_OPEN}, {_VECTORS}, {_KEYWORDS}, {_FUSED}, top AS (SELECT f.id, c.content FROM (SELECT * FROM fused ORDER BY score DESC, id LIMIT 20) f JOIN chunks c USING (id))
SELECT id, round(len(list_intersect({_TERMS}, list_distinct(regexp_extract_all(lower(content), '\\p{{L}}+'))))::DOUBLE / {len(QUESTION)}, 9) AS rerank_score FROM top ORDER BY rerank_score DESC, id LIMIT 5""")
def x2_rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    cfg = SearchConfig(distance_threshold=THRESHOLD, rerank=True)
    found = retrieval.hybrid_search(base.index(spark, sf_dir), base.query_vector(spark, sf_dir), _lexemes_of_question(), cfg, base.active_sources(spark, sf_dir))
    return retrieval.rerank(found, lambda content: retrieval.token_overlap(F.lit(" ".join(QUESTION)), content), 5).select("id", "rerank_score")


@query("s19_postings", f"WITH {PLACED} SELECT lexeme, id, count(*)::INTEGER AS tf, md5(string_agg(pos::VARCHAR, ',' ORDER BY pos)) AS places FROM placed GROUP BY lexeme, id")
def s19_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole inverted index; places as a digest."""
    return base.index(spark, sf_dir).postings.select("lexeme", "id", F.size("places").alias("tf"), F.md5(F.array_join(F.col("places").cast("array<string>"), ",").cast("binary")).alias("places"))


@query("w3_take_sources", """WITH r AS (SELECT conv_id, turn, 'd/' || role || (turn % 3) || '.md' AS source FROM conversations),
once AS (SELECT * FROM r WHERE source <> 'd/system0.md' QUALIFY row_number() OVER (PARTITION BY conv_id, source ORDER BY turn) = 1)
SELECT conv_id, turn, source FROM once QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn) <= 3""")
def w3_take_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = base.table(spark, sf_dir, "conversations").select("conv_id", "turn", F.concat(F.lit("d/"), "role", (F.col("turn") % 3).cast("string"), F.lit(".md")).alias("source"))
    return retrieval.take_sources(rows, 3, ("conv_id",), "turn", ("system0.md",)).select("conv_id", "turn", "source")


@query("a13_joined_turns", "SELECT conv_id, string_agg(text, chr(10) || chr(10) ORDER BY turn, text) AS text FROM conversations GROUP BY conv_id")
def a13_joined_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evals.joined_turns(base.table(spark, sf_dir, "conversations"))


@query("c2_context", """SELECT conv_id, string_agg('[' || role || ']' || chr(10) || text, chr(10) || chr(10) ORDER BY turn, '[' || role || ']' || chr(10) || text) AS context FROM conversations GROUP BY conv_id""")
def c2_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = base.table(spark, sf_dir, "conversations").withColumnsRenamed({"role": "source", "text": "content"})
    return retrieval.context_of(rows, ("conv_id",), "turn")


@query("p20_evidence_context", """SELECT conv_id, string_agg(text, chr(10) || chr(10) ORDER BY turn, text) AS context FROM (
SELECT conv_id, turn, CASE WHEN turn % 4 = 3 THEN 'error: ' || text ELSE text END AS text FROM conversations WHERE role = 'assistant') WHERE text NOT LIKE 'error: %' AND text <> 'No relevant documents found.' GROUP BY conv_id""")
def p20_evidence_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = base.table(spark, sf_dir, "conversations").withColumn("role", F.when(F.col("role") == "assistant", "tool").otherwise(F.col("role"))).withColumn("text", F.when(F.col("turn") % 4 == 3, F.concat(F.lit("error: "), "text")).otherwise(F.col("text")))
    return evals.evidence_context(rows)


@query("a14_turn_totals", """SELECT conv_id, count(*) AS hops, sum(length(text)) AS prompt_tokens, sum(turn) AS completion_tokens, max(length(text))::INTEGER AS max_prompt_tokens FROM conversations GROUP BY conv_id""")
def a14_turn_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evals.turn_totals(base.table(spark, sf_dir, "conversations").select("conv_id", F.length("text").alias("prompt_tokens"), F.col("turn").alias("completion_tokens")))


@query("a1_category_counts", f"WITH {CHUNKS} SELECT category, count(*) AS n FROM chunks GROUP BY category")
def a1_category_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.category_counts(base.chunks(spark, sf_dir)).orderBy("labels").select("category", "n")


@query("a2_top_counts", f"WITH {CHUNKS} SELECT split_part(category, '.', 1) AS category, count(*) AS n FROM chunks GROUP BY 1")
def a2_top_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.top_counts(base.chunks(spark, sf_dir))


@query("j8_source_counts", f"WITH {CHUNKS}, s AS (SELECT DISTINCT source FROM documents UNION ALL SELECT 'none') SELECT s.source, coalesce(n, 0) AS n FROM s LEFT JOIN (SELECT source, count(*) AS n FROM chunks GROUP BY source) c USING (source)")
def j8_source_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = base.table(spark, sf_dir, "documents")
    sources = docs.select("source").distinct().unionAll(spark.sql("SELECT 'none' AS source"))
    return corpus.source_counts(sources, base.chunks(spark, sf_dir))


@query("p24_category_levels", f"WITH {CHUNKS} SELECT id, len(string_split(category, '.')) - 1 AS level FROM chunks")
def p24_category_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return base.chunks(spark, sf_dir).select("id", text.category_level(F.col("category")).cast("long").alias("level"))


@query("w1_ranked_neighbours", """SELECT query_id, vec_id, d AS vector_distance, rank FROM (
SELECT q.vec_id AS query_id, e.vec_id, round(list_cosine_distance(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 9) + 0 AS d, row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_cosine_distance(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 9) + 0, e.vec_id) AS rank
FROM embeddings e, embeddings q WHERE q.vec_id % 20 = 0) WHERE rank <= 10""")
def w1_ranked_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest vectors of every vector whose id 20 divides, among all vectors."""
    rows = base.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    near = blocks.nearest(rows, _asked(spark, sf_dir), 10)
    return near.select("query_id", F.col("id").alias("vec_id"), "vector_distance", F.col("vector_rank").alias("rank"))


def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return base.table(spark, sf_dir, "embeddings").filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_embedding"))
