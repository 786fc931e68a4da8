"""Hybrid retrieval over a search index.

Both legs read their own table of the index (vectors by cell, postings by lexeme), filter
before every top-N and carry ids and scores; content is looked up for the fused rows.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone import config, storage
from lodestone.config import SearchConfig
from lodestone.functions import blocks, keymap, language, ranking, text, vector
from lodestone.functions.numeric import exact_round
from lodestone.operators.searchindex import SearchIndex

_CATEGORY = re.compile(r"[a-zA-Z0-9_.-]+")


def checked_category(category: str) -> str:
    """A category filter without pattern characters, or ValueError."""
    if not _CATEGORY.fullmatch(category):
        raise ValueError(f"invalid category: {category!r}")
    return category


def eligible(rows: DataFrame, index: SearchIndex, active_sources: DataFrame | None = None, category: str | None = None) -> DataFrame:
    """The rows of a table of the index that are of active sources (a column ``source``)
    and within a category."""
    if category:
        rows = index.in_category(rows, checked_category(category))
    if active_sources is not None:
        rows = rows.join(active_sources.select("source").distinct(), "source", "left_semi")
    return rows


def vector_leg(index: SearchIndex, query, cfg: SearchConfig, active_sources: DataFrame | None = None, category: str | None = None) -> DataFrame:
    """(id, vector_distance, vector_rank) of the nearest chunks within the threshold.
    ``cfg.probes`` nearest cells are read; without it all that can hold such a chunk."""
    cells = index.probed(query, cfg.probes, cfg.distance_threshold)
    rows = eligible(index.vectors.filter(F.col("cell").isin(cells) if cells else F.lit(False)), index, active_sources, category)
    near = rows.select("id", vector.distance_to(F.col("embedding"), query, length=F.col("norm")).alias("vector_distance")).filter(F.col("vector_distance") <= cfg.distance_threshold)
    top = near.orderBy("vector_distance", "id").limit(cfg.limit_vector)
    return top.withColumn("vector_rank", F.row_number().over(Window.orderBy("vector_distance", "id")))


def _hits(word: Column) -> Column:
    """The places of all lexemes of a match in order, each with its lexeme."""
    return F.array_sort(F.flatten(F.collect_list(F.transform("places", lambda p: F.struct(p.alias("place"), word.alias("word"))))))


def keyword_leg(index: SearchIndex, wanted: list[str], cfg: SearchConfig, active_sources: DataFrame | None = None, category: str | None = None) -> DataFrame:
    """(id, keyword_score, keyword_rank) of the best chunks that hold every lexeme."""
    words = [w for w in dict.fromkeys(wanted) if w]
    held = eligible(index.postings.filter(F.col("lexeme").isin(words) if words else F.lit(False)), index, active_sources, category)
    found = held.groupBy("id").agg(F.count(F.lit(1)).alias("n"), _hits(F.col("lexeme")).alias("hits")).filter(F.col("n") == len(words))
    hits = found.select("id", ranking.ts_rank(F.col("hits"), F.col("n")).alias("keyword_score"))
    top = hits.orderBy(F.desc("keyword_score"), "id").limit(cfg.limit_keywords)
    return top.withColumn("keyword_rank", F.row_number().over(Window.orderBy(F.desc("keyword_score"), "id")))


def fuse(vectors: DataFrame, keywords: DataFrame, cfg: SearchConfig, by: tuple[str, ...] = ()) -> DataFrame:
    """Reciprocal rank fusion of two legs, keyed by ``by`` and id."""
    both = vectors.join(keywords, [*by, "id"], "full_outer")
    score = vector.rrf(F.col("vector_rank"), cfg.rrf_k) + vector.rrf(F.col("keyword_rank"), cfg.rrf_k)
    return both.withColumn("score", F.round(score, 9))


def hybrid_search(index: SearchIndex, query, wanted: list[str], cfg: SearchConfig = SearchConfig(), active_sources: DataFrame | None = None, category: str | None = None) -> DataFrame:
    """The ``limit`` best chunks of one question: vector leg, keyword leg, rank fusion."""
    fused = fuse(vector_leg(index, query, cfg, active_sources, category), keyword_leg(index, wanted, cfg, active_sources, category), cfg)
    best = fused.orderBy(F.desc("score"), "id").limit(cfg.candidates if cfg.rerank else cfg.limit)
    return index.chunks.select("id", "content", "source", "category", "chunk_index").join(F.broadcast(best), "id")  # a handful of rows


def matches_of_many(postings: DataFrame, words: DataFrame, allowed: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(query_id, id, n, hits) of the chunks that hold every lexeme of a question, from
    (query_id, lexeme). Candidates come from each question's rarest lexeme only, and
    ``allowed`` leaves out some of these by their postings; the other lexemes are looked up
    for them by lexeme and id, so that frequent ones cost no more than the candidates.
    Postings that none of them can meet aren't shuffled."""
    words = storage.cut(words, "words")
    rare = keymap.possible(postings.select("lexeme"), words, "lexeme").groupBy("lexeme").agg(F.count(F.lit(1)).alias("df"))
    sized = words.join(rare, "lexeme", "left").groupBy("query_id").agg(F.count(F.lit(1)).alias("needed"), F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "lexeme")).alias("rarest"))
    seeds = storage.cut(sized.filter("rarest.df > 0").select("query_id", "needed", F.col("rarest.lexeme").alias("lexeme")), "seeds")
    candidates = storage.cut(keymap.possible(postings.drop("places"), seeds, "lexeme").join(seeds, "lexeme"), "candidates")
    if allowed:  # after a cut, as Spark would look at the sources of all postings first
        candidates = storage.cut(allowed(candidates), "candidates")
    candidates = candidates.select("query_id", "needed", "id")
    wanted = candidates.join(words, "query_id")
    held = keymap.possible(postings.select("lexeme", "id", "places"), candidates, "id")
    found = wanted.join(keymap.possible(held, wanted, "lexeme", "id"), ["lexeme", "id"])
    return found.groupBy("query_id", "id").agg(F.first("needed").alias("needed"), F.count(F.lit(1)).alias("n"), _hits(F.col("lexeme")).alias("hits")).filter("n = needed").drop("needed")


def search_many(index: SearchIndex, questions: DataFrame, cfg: SearchConfig = SearchConfig(), active_sources: DataFrame | None = None, columns: tuple[str, ...] = ("source", "category")) -> DataFrame:
    """hybrid_search() for a table of questions (query_id, query_embedding,
    query_lexemes), with these columns of the chunks: one job for a whole evaluation. The
    vector leg compares blocks of questions with all vectors, the keyword leg joins posting
    lists."""
    vectors = blocks.nearest(eligible(index.vectors, index, active_sources), questions, cfg.limit_vector, cfg.distance_threshold)
    words = questions.select("query_id", F.explode(F.array_distinct("query_lexemes")).alias("lexeme")).filter("lexeme <> ''")
    matched = matches_of_many(index.postings, words, lambda rows: eligible(rows, index, active_sources))
    scored = matched.select("query_id", "id", ranking.ts_rank(F.col("hits"), F.col("n")).alias("keyword_score"))
    by_score = Window.partitionBy("query_id").orderBy(F.desc("keyword_score"), "id")
    keywords = scored.withColumn("keyword_rank", F.row_number().over(by_score)).filter(F.col("keyword_rank") <= cfg.limit_keywords)
    fused = fuse(vectors, keywords, cfg, ("query_id",))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    top = storage.cut(fused.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= cfg.limit), "found")
    return top.join(keymap.possible(index.chunks.select("id", *columns), top, "id"), "id")


def search_questions(index: SearchIndex, questions: DataFrame, embed: Callable[[Column], Column], cfg: SearchConfig = SearchConfig(), active_sources: DataFrame | None = None, score: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """(query_id, rank, source, content, ...) of the chunks found for questions (query_id,
    question): each is embedded and read in the configuration of its own language. With
    ``score`` the best candidates are ranked anew by it."""
    spoken = language.detected(questions, "query_id", "question", language.seed_profiles(questions.sparkSession))
    configuration = language.configured(F.col("language"))
    asked = questions.join(spoken.select("query_id", configuration.alias("configuration")), "query_id")
    ready = asked.select("query_id", "question", embed(F.col("question")).alias("query_embedding"), text.lexemes(F.col("question"), F.col("configuration")).alias("query_lexemes"))
    ready = storage.cut(ready, "questions")  # a question is embedded once
    wide = replace(cfg, limit=cfg.candidates) if score else cfg
    found = search_many(index, ready, wide, active_sources, ("source", "category", "content"))
    if score is None:
        return found
    scored = rerank(found.join(ready.select("query_id", "question"), "query_id"), score(F.col("question"), F.col("content")), cfg.limit, ("query_id",), ("rank",))
    place = Window.partitionBy("query_id").orderBy(F.desc("rerank_score"), "rank")
    return scored.withColumn("rank", F.row_number().over(place)).drop("question")


def shown(found: DataFrame, k: int, ignored=config.IGNORED_FILES) -> DataFrame:
    """(query_id, context, sources) of found chunks (query_id, rank, source, content): the
    first k in order are formatted, ignored files left out, each source listed once. A
    question without any such chunk has no row."""
    kept = found.filter((F.col("rank") <= k) & ~text.is_ignored(F.col("source"), ignored))
    parts = F.array_sort(F.collect_list(F.struct("rank", "source", text.formatted_chunk(F.col("source"), F.col("content")).alias("t"))))  # k a question
    rows = kept.groupBy("query_id").agg(parts.alias("p"))
    return rows.select("query_id", F.array_join(F.transform("p", lambda x: x["t"]), "\n\n").alias("context"), F.array_distinct(F.transform("p", lambda x: x["source"])).alias("sources"))


def token_overlap(query: Column, content: Column) -> Column:
    """Offline stand-in for a cross encoder: share of the question's words in the text."""
    asked, held = F.array_distinct(text.lexemes(query)), F.array_distinct(text.lexemes(content))
    return F.round(F.size(F.array_intersect(asked, held)).cast("double") / F.greatest(F.size(asked), F.lit(1)), 9)


def rerank(rows: DataFrame, score: Column | Callable[[Column], Column], k: int, by: tuple[str, ...] = (), order: tuple[str, ...] = ("id",)) -> DataFrame:
    """The k best rows of each group by a model's score, ties in the given order."""
    scored = rows.withColumn("rerank_score", score(F.col("content")) if callable(score) else score)
    if not by:
        return scored.orderBy(F.desc("rerank_score"), *order).limit(k)
    place = Window.partitionBy(*by).orderBy(F.desc("rerank_score"), *order)
    return scored.withColumn("_place", F.row_number().over(place)).filter(F.col("_place") <= k).drop("_place")


def take_sources(rows: DataFrame, k: int, by: tuple[str, ...], order: str, ignored=config.IGNORED_FILES) -> DataFrame:
    """The first row of each source in order, without ignored files, k a group."""
    wanted = rows.filter(~text.is_ignored(F.col("source"), ignored))
    first = Window.partitionBy(*by, "source").orderBy(order)
    place = Window.partitionBy(*by).orderBy(order)
    once = wanted.withColumn("_first", F.row_number().over(first)).filter("_first = 1").drop("_first")
    return once.withColumn("_place", F.row_number().over(place)).filter(F.col("_place") <= k).drop("_place")


def source_rows(rows: DataFrame) -> DataFrame:
    """What a result shows of its sources: distance and score with three digits."""
    return rows.select("source", "vector_rank", "keyword_rank", exact_round(F.col("vector_distance"), 3).alias("vector_distance"), exact_round(F.col("score"), 3).alias("score"))


def context_of(rows: DataFrame, by: tuple[str, ...], order: str) -> DataFrame:
    """The formatted chunks of each group joined by blank lines, in order."""
    parts = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), text.formatted_chunk(F.col("source"), F.col("content")).alias("t"))))
    return rows.groupBy(*by).agg(F.array_join(F.transform(parts, lambda p: p["t"]), "\n\n").alias("context"))
