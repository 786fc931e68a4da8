from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from lodestone import storage
from lodestone.operators import indexing, models, searchindex
from lodestone.sources import markdown

SCHEMA = "corpus string, source string, category string, language string, title string, text string"


def docs(spark, rows):
    return spark.createDataFrame([(c, s, f"{c}.x", "eng", None, t) for c, s, t in rows], SCHEMA)


@pytest.fixture
def counting(spark):
    """An embedder that counts the texts it is asked for."""
    asked = spark.sparkContext.accumulator(0)

    def backend(texts):
        asked.add(len(texts))
        return models.hashed_embedding(texts)

    return asked, models.embedder(backend)


def content(spark, path):
    return {(r.corpus, r.source, r.chunk_index): r.content for r in indexing.chunks(spark, path).collect()}


def test_only_what_changed_is_embedded(spark, counting):
    asked, embed = counting
    path, both = storage.fresh(spark, "store"), [indexing.Entry("a"), indexing.Entry("b", "git", "http://x", "/b")]
    first = docs(spark, [("a", "1.md", "# T\none\n## S\ntwo"), ("a", "2.md", "plain"), ("b", "1.md", "other"), ("b", "blank.md", " \n")])
    assert indexing.build(first, path, both, embed) == indexing.IndexResult(2, 4, 4, 0, 0, 0, 4)
    assert asked.value == 4 and content(spark, path)["a", "1.md", 1] == "# T\n## S\ntwo"
    before = indexing.manifest(spark, path)

    assert indexing.build(first, path, both, embed) == indexing.IndexResult(2, 4, 0, 0, 4, 0, 0)
    assert asked.value == 4 and indexing.manifest(spark, path) == before  # nothing embedded, nothing written

    second = docs(spark, [("a", "1.md", "# T\nONE"), ("a", "3.md", "new"), ("b", "1.md", "other"), ("b", "blank.md", " \n")])
    assert indexing.build(second, path, both, embed) == indexing.IndexResult(2, 3, 1, 1, 2, 1, 2)
    assert asked.value == 6
    assert content(spark, path) == {("a", "1.md", 0): "# T\nONE", ("a", "3.md", 0): "new", ("b", "1.md", 0): "other"}
    assert indexing.manifest(spark, path)["b"] == before["b"]  # an unchanged corpus keeps its tables


def test_a_build_of_one_corpus_leaves_the_others(spark, counting):
    _, embed = counting
    path = storage.fresh(spark, "store")
    rows = docs(spark, [("a/1 x", "1.md", "one"), ("b", "1.md", "two")])
    indexing.build(rows, path, [indexing.Entry("a/1 x"), indexing.Entry("b")], embed)
    indexing.build(docs(spark, [("b", "2.md", "three")]), path, [indexing.Entry("b")], embed)
    assert set(content(spark, path).values()) == {"one", "three"}
    indexing.build(docs(spark, []), path, [indexing.Entry("b")], embed)
    assert set(content(spark, path).values()) == {"one"}


def test_sources_are_registered_switched_and_cleaned_up(spark, counting):
    _, embed = counting
    path = storage.fresh(spark, "store")
    spec = markdown.SourceSpec("n", "/root/n", git_url="http://g")
    indexing.build(docs(spark, [("n", "1.md", "one"), ("m", "1.md", "two")]), path, [indexing.entry_of(spec), indexing.Entry("m")], embed)
    held = indexing.manifest(spark, path)
    assert (held["n"].kind, held["n"].git_url, held["n"].path, held["m"].kind) == ("git", "http://g", "/root/n", "local")
    assert indexing.toggle(spark, path, "n", False) == 1
    assert [r.content for r in indexing.chunks(spark, path, active_only=True).collect()] == ["two"]
    indexing.build(docs(spark, [("n", "1.md", "ONE"), ("m", "1.md", "two")]), path, [indexing.entry_of(spec), indexing.Entry("m")], embed)
    assert not indexing.manifest(spark, path)["n"].active  # a build doesn't switch it on again
    with pytest.raises(LookupError):
        indexing.toggle(spark, path, "none", True)
    before = content(spark, path)
    indexing.vacuum(spark, path)
    assert content(spark, path) == before and len(storage.children(spark, f"{path}/builds")) == 2


def test_a_failed_build_changes_nothing(spark, counting):
    _, embed = counting
    path = storage.fresh(spark, "store")
    indexing.build(docs(spark, [("a", "1.md", "one")]), path, [indexing.Entry("a")], embed)
    before = content(spark, path)

    def broken(texts):
        raise RuntimeError("no model")

    with pytest.raises(Exception, match="no model"):
        indexing.build(docs(spark, [("a", "1.md", "two")]), path, [indexing.Entry("a")], models.embedder(broken))
    assert content(spark, path) == before


def test_a_store_becomes_a_search_index(spark, counting):
    _, embed = counting
    store, path = storage.fresh(spark, "store"), storage.fresh(spark, "index")
    indexing.build(docs(spark, [("a", f"{i}.md", f"running item {i}") for i in range(5)]), store, [indexing.Entry("a")], embed)
    searchindex.build(indexing.chunks(spark, store).drop("lexemes", "build", "corpus"), path)
    index = searchindex.load(spark, path)
    assert index.postings.filter("lexeme = 'run'").count() == 5 and index.vectors.count() == 5
    rows = indexing.chunks(spark, store).select("lexemes", F.size("embedding").alias("n")).first()
    assert rows.lexemes[:2] == ["run", "item"] and rows.n == models.WIDTH
