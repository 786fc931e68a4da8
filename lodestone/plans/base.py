"""Driver tables in the shape of the engine's own: as DataFrames and as DuckDB text."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone import storage
from lodestone.functions import stemming
from lodestone.operators import evals, searchindex
from lodestone.operators.searchindex import SearchIndex

#: The question that the single searches ask: two frequent words and vector 0.
QUESTION = ("ti", "er")
THRESHOLD = 0.9


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as chunks; the vector is the one of the same id, where there is one."""
    docs = table(spark, sf_dir, "documents")
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    language = F.when(F.col("lang") == "en", "eng").otherwise(F.col("lang"))
    rows = docs.select(F.col("doc_id").alias("id"), "source", F.col("text").alias("content"), F.concat_ws(".", "lang", "source").alias("category"), language.alias("language"), F.lit(0).alias("chunk_index"))
    return rows.join(vectors, "id", "left")


def index(spark: SparkSession, sf_dir: str) -> SearchIndex:
    """The search index of chunks(), which an application writes once."""
    return searchindex.load(spark, storage.once(spark, sf_dir, lambda path: searchindex.build(chunks(spark, sf_dir), path)))


def query_vector(spark: SparkSession, sf_dir: str, vec_id: int = 0) -> list[float]:
    return table(spark, sf_dir, "embeddings").filter(F.col("vec_id") == vec_id).first()["embedding"]


def active_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every source but the ones whose name ends in 3."""
    return table(spark, sf_dir, "documents").select("source").distinct().filter(~F.col("source").endswith("3"))


def logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A question log from documents and labels: a run a source, scores from the labels,
    the question's sources from the language."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    rows = docs.join(labels, "doc_id", "left")
    d = F.col("doc_id")
    marked = F.when(d % 5 == 0, F.lit(None)).when(d % 5 == 1, F.array().cast("array<string>")).otherwise(F.array(F.concat(F.lit("s"), (d % 7).cast("string")), F.concat(F.lit("s"), (d % 3).cast("string"))))
    got = F.array(*[F.struct(F.concat(F.when(d % 4 == i, F.lit("mcp:x/")).otherwise(F.lit("a/")), F.lit("s"), ((d * (i + 2)) % 11).cast("string"), F.lit(".md")).alias("source")) for i in range(3)])
    return rows.select(
        d.alias("id"),
        F.col("source").alias("run_name"),
        F.when(d % 9 != 0, F.expr("doc_id div 20 % 40")).alias("question_id"),
        (d % 6 != 0).alias("answered"),
        F.when(d % 8 != 0, F.lit("ctx")).otherwise(F.lit("")).alias("context"),
        F.when(d % 3 != 0, F.lit("ref")).alias("reference_answer"),
        (F.col("quality") * 7 + d % 3).cast("string").alias("faithfulness"),
        (F.lit(9) - F.col("toxic") * 5 - d % 2).cast("string").alias("relevance"),
        (F.col("quality") * 5 + d % 4).cast("string").alias("completeness"),
        got.alias("sources"),
        marked.alias("marked_sources"),
        F.parse_json(F.concat(F.lit('{"faithfulness":{"attempts":'), (d % 5).cast("string"), F.lit("}}"))).alias("metrics"),
    )


CHUNKS = """chunks AS (
  SELECT d.doc_id AS id, d.source, d.text AS content, d.lang || '.' || d.source AS category, d.lang AS language, e.embedding::DOUBLE[] AS embedding
  FROM documents d LEFT JOIN embeddings e ON e.vec_id = d.doc_id)"""


def _any(words) -> str:
    return "(?:" + "|".join(words) + ")$"


def _swap(before: str, name: str, table: dict[str, str], region: str, allowed: str) -> str:
    """A step that replaces the longest suffix of a table within a region."""
    to = " ".join(f"WHEN '{end}' THEN '{new}'" for end, new in table.items())
    return f"""{name}e AS (SELECT *, regexp_extract(w, '{_any(table)}') AS e FROM {before}),
{name} AS (SELECT * REPLACE (CASE WHEN e <> '' AND length(w) - length(e) >= {region} AND ({allowed}) THEN left(w, length(w) - length(e)) || CASE e {to} END ELSE w END AS w) FROM {name}e)"""


_R = "[^aeiouy]*[aeiouy]+[^aeiouy]"
_SHORT = "regexp_full_match({0}, '(.*[^aeiouy])?[aeiouy][^aeiouywxY]|[aeiouy][^aeiouy]')"


def english_stems(words: str, mark: str = "") -> str:
    """The published English stemmer as steps over a table of distinct words: the last,
    ``stems``, has (word, stem). ``mark`` begins the steps' names."""
    fixed = " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in stemming.WHOLE.items())
    stop = ", ".join(f"'{w}'" for w in sorted(stemming.AFTER_PLURAL))
    doubles = "|".join(sorted(stemming.DOUBLES))
    valid = f"CASE e WHEN 'ogi' THEN w LIKE '%logi' WHEN 'li' THEN regexp_matches(w, '[{stemming.LI_ENDS}]li$') ELSE true END"
    steps = [
        f"p0 AS (SELECT word, regexp_replace(regexp_replace(word, '^y', 'Y'), '([aeiouy])y', '\\1Y', 'g') AS w FROM (SELECT DISTINCT word FROM {words}) WHERE length(word) > 2 AND regexp_full_match(word, '\\p{{L}}+'))",
        f"p1 AS (SELECT *, CASE WHEN regexp_matches(w, '^(gener|commun|arsen)') THEN length(regexp_extract(w, '^(gener|commun|arsen)')) WHEN regexp_matches(w, '^{_R}') THEN length(regexp_extract(w, '^{_R}')) ELSE length(w) END AS r1 FROM p0)",
        f"p2 AS (SELECT *, CASE WHEN regexp_matches(substr(w, r1 + 1), '^{_R}') THEN r1 + length(regexp_extract(substr(w, r1 + 1), '^{_R}')) ELSE length(w) END AS r2 FROM p1)",
        """a1 AS (SELECT * REPLACE (CASE WHEN w LIKE '%sses' THEN left(w, -2) WHEN regexp_matches(w, 'ie[ds]$') THEN CASE WHEN length(w) > 4 THEN left(w, -2) ELSE left(w, -1) END
  WHEN regexp_matches(w, '(us|ss)$') THEN w WHEN w LIKE '%s' AND regexp_matches(left(w, -2), '[aeiouy]') THEN left(w, -1) ELSE w END AS w) FROM p2)""",
        f"a2 AS (SELECT *, w IN ({stop}) AS ready, regexp_extract(w, '(?:eedly|ingly|edly|eed|ing|ed)$') AS t FROM a1)",
        "a3 AS (SELECT *, left(w, length(w) - length(t)) AS l FROM a2)",
        f"""b1 AS (SELECT word, r1, r2, ready, CASE WHEN ready OR t = '' THEN w WHEN t LIKE 'eed%' THEN CASE WHEN length(l) >= r1 THEN l || 'ee' ELSE w END WHEN NOT regexp_matches(l, '[aeiouy]') THEN w
  WHEN regexp_matches(l, '(at|bl|iz)$') THEN l || 'e' WHEN regexp_matches(l, '({doubles})$') THEN left(l, -1) WHEN length(l) = r1 AND {_SHORT.format("l")} THEN l || 'e' ELSE l END AS w FROM a3)""",
        "c1 AS (SELECT * REPLACE (CASE WHEN NOT ready AND length(w) > 2 AND regexp_matches(w, '[^aeiouy][yY]$') THEN left(w, -1) || 'i' ELSE w END AS w) FROM b1)",
        _swap("c1", "d1", stemming.STEP_2, "r1", f"NOT ready AND {valid}").replace("d1e AS", "d0 AS").replace("FROM d1e", "FROM d0"),
        _swap("(SELECT * EXCLUDE (e) FROM d1)", "f1", stemming.STEP_3, "r1", "NOT ready AND (e <> 'ative' OR length(w) - 5 >= r2)"),
        _swap("(SELECT * EXCLUDE (e) FROM f1)", "g1", stemming.STEP_4, "r2", "NOT ready AND (e <> 'ion' OR regexp_matches(w, '[st]ion$'))"),
        f"""h1 AS (SELECT * REPLACE (CASE WHEN NOT ready AND w LIKE '%e' AND (length(w) - 1 >= r2 OR length(w) - 1 >= r1 AND NOT {_SHORT.format("left(w, -1)")}) OR NOT ready AND w LIKE '%ll' AND length(w) - 1 >= r2 THEN left(w, -1) ELSE w END AS w) FROM g1)""",
        f"stems AS (SELECT word, CASE word {fixed} ELSE replace(w, 'Y', 'y') END AS stem FROM h1)",
    ]
    return re.sub(r"\b(p0|p1|p2|a1|a2|a3|b1|c1|d0|d1|f1e|f1|g1e|g1|h1|stems)\b", rf"{mark}\1", ",\n".join(steps))


STOPS = ", ".join(f"'{w}'" for w in sorted(stemming.STOP_WORDS["english"]))
WORD = "[\\p{L}\\p{N}]+"

#: (id, pos, lexeme) of all documents; the English ones have stems and no stop words.
PLACED = f"""heard AS (SELECT doc_id AS id, lang = 'en' AS english, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS pos FROM (SELECT doc_id, lang, regexp_extract_all(lower(text), '{WORD}') AS w FROM documents)),
{english_stems("heard WHERE english")},
placed AS (SELECT id, pos, CASE WHEN english THEN coalesce(stem, word) ELSE word END AS lexeme FROM heard LEFT JOIN stems USING (word) WHERE NOT (english AND word IN ({STOPS})))"""

LOGS = """logs AS (
  SELECT d.doc_id AS id, d.source AS run_name, CASE WHEN d.doc_id % 9 <> 0 THEN d.doc_id // 20 % 40 END AS question_id,
         d.doc_id % 6 <> 0 AS answered, CASE WHEN d.doc_id % 8 <> 0 THEN 'ctx' ELSE '' END AS context,
         CASE WHEN d.doc_id % 3 <> 0 THEN 'ref' END AS reference_answer,
         l.quality * 7 + d.doc_id % 3 AS faithfulness, 9 - l.toxic * 5 - d.doc_id % 2 AS relevance, l.quality * 5 + d.doc_id % 4 AS completeness,
         [CASE WHEN d.doc_id % 4 = i THEN 'mcp:x/' ELSE 'a/' END || 's' || ((d.doc_id * (i + 2)) % 11) || '.md' FOR i IN [0, 1, 2]] AS sources,
         CASE WHEN d.doc_id % 5 = 0 THEN NULL WHEN d.doc_id % 5 = 1 THEN []::VARCHAR[] ELSE ['s' || (d.doc_id % 7), 's' || (d.doc_id % 3)] END AS marked_sources,
         d.doc_id % 5 AS attempts
  FROM documents d LEFT JOIN labels l USING (doc_id)),
judged AS (
  SELECT *, coalesce(len(marked_sources), 0) > 0 AS inside, len(list_filter(sources, lambda s: s[1:4] = 'mcp:')) > 0 AS remote,
         list_filter(sources, lambda s: s[1:4] <> 'mcp:') AS own
  FROM logs)"""


def in_corpus():
    return evals.in_corpus()


def _packed(piece: str, mark: str) -> str:
    """Neighbours at a separator joined while they fit, as one fold over the parts."""
    joined = f"CASE WHEN a.cur <> '' THEN a.cur || {mark} || b.cur ELSE b.cur END"
    closed = "CASE WHEN a.cur <> '' THEN list_append(a.out, a.cur) ELSE a.out END"
    step = f"""CASE WHEN length({joined}) <= 1024 THEN {{'out': a.out, 'cur': {joined}}} WHEN length(b.cur) > 1024 THEN {{'out': list_append({closed}, b.cur), 'cur': ''}} ELSE {{'out': {closed}, 'cur': b.cur}} END"""
    parts = f"list_transform(string_split({piece}, {mark}), lambda x: {{'out': []::VARCHAR[], 'cur': x}})"
    return f"list_reduce(list_prepend({{'out': []::VARCHAR[], 'cur': ''}}, {parts}), lambda a, b: {step})"


def chunk_ctes(texts: str) -> str:
    """``pieces`` (key, chunk_index, content): the chunks of the texts of (key, text)."""
    line = "^[^\\n\\r\\x0b\\x0c\\x1c-\\x1e\\x{85}\\x{2028}\\x{2029}]*"
    out = [
        f"""sections AS (SELECT key, title, unnest(parts) AS part, generate_subscripts(parts, 1) AS i FROM (SELECT key, regexp_extract(text, '{line}') AS title, string_split(text, chr(10) || '## ') AS parts FROM {texts} WHERE regexp_matches(text, '[^\\s\\x0b\\x1c-\\x1f\\x{{85}}\\x{{a0}}\\x{{1680}}\\x{{2000}}-\\x{{200a}}\\x{{2028}}\\x{{2029}}\\x{{202f}}\\x{{205f}}\\x{{3000}}]')))""",
        "cut0 AS (SELECT key, [i] AS place, CASE WHEN i = 1 THEN part ELSE title || chr(10) || '## ' || part END AS piece FROM sections)",
    ]
    for n, mark in enumerate(("chr(10) || chr(10)", "chr(10)", "'. '", "' '"), 1):
        out.append(f"packed{n} AS (SELECT key, place, CASE WHEN length(piece) <= 1024 THEN [piece] ELSE (SELECT CASE WHEN r.cur <> '' THEN list_append(r.out, r.cur) ELSE r.out END FROM (SELECT {_packed('piece', f'({mark})')} AS r)) END AS p FROM cut{n - 1})")
        out.append(f"cut{n} AS (SELECT key, list_append(place, i) AS place, piece FROM (SELECT key, place, unnest(p) AS piece, generate_subscripts(p, 1) AS i FROM packed{n}))")
    out.append("sliced AS (SELECT key, list_append(place, i) AS place, CASE WHEN length(piece) <= 1024 THEN piece ELSE substr(piece, (i - 1) * 1024 + 1, 1024) END AS piece FROM (SELECT *, unnest(range(1, greatest((length(piece) + 1023) // 1024, 1) + 1)) AS i FROM cut4))")
    out.append("pieces AS (SELECT key, (row_number() OVER (PARTITION BY key ORDER BY place) - 1)::INTEGER AS chunk_index, piece AS content FROM sliced)")
    return ",\n".join(out)
