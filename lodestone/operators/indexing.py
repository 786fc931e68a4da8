"""Index builds that only do what has changed.

A store is a folder with one manifest, a small JSON file that names the current tables of
every corpus and is replaced by one rename. A build compares the documents of its corpora
with those of the store by content hash; documents that are new or changed are cut into
chunks and embedded, chunks of unchanged ones are carried over as they are, and those of
documents that are gone are left out. Corpora in which nothing has changed aren't written
at all. Readers of an old manifest keep their tables until ``vacuum``; a build that fails
or loses executors leaves the store as it was.

Documents are (source, corpus, category, language, title, text), where (corpus, source) is
a key. Chunks are (id, source, corpus, category, language, chunk_index, content, embedding,
lexemes, build).
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone import config, storage
from lodestone.operators import corpus, models
from lodestone.sources.markdown import SourceSpec
from lodestone.timing import measured

KEY = ["corpus", "source"]
DOCUMENT = "corpus string, source string, digest string"
CHUNK = "id long, source string, corpus string, category string, language string, chunk_index int, content string, embedding array<float>, lexemes array<string>, build string"


@dataclass(frozen=True)
class Entry:
    """A corpus in the manifest: where it comes from and which tables are its own."""

    name: str
    kind: str = "local"
    git_url: str | None = None
    path: str | None = None
    active: bool = True
    documents: str = ""
    chunks: str = ""


@dataclass(frozen=True)
class IndexResult:
    """What a build found: corpora and chunks afterwards, documents by what became of
    them, and the chunks that were embedded."""

    sources: int
    chunks: int
    new: int
    changed: int
    same: int
    gone: int
    embedded: int
    elapsed: float = field(default=0.0, compare=False)


def entry_of(spec: SourceSpec) -> Entry:
    return Entry(spec.name, "git" if spec.git_url else "local", spec.git_url, spec.root)


def manifest(spark: SparkSession, path: str) -> dict[str, Entry]:
    """The corpora of a store by name; none where there is no store."""
    text = storage.read_text(spark, f"{path}/manifest.json")
    return {e["name"]: Entry(**e) for e in json.loads(text)} if text else {}


def _commit(spark: SparkSession, path: str, entries: dict[str, Entry]) -> None:
    storage.replace_text(spark, f"{path}/manifest.json", json.dumps([asdict(e) for e in entries.values()]))


def _tables(spark: SparkSession, paths: list[str], schema: str) -> DataFrame:
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def chunks(spark: SparkSession, path: str, active_only: bool = False) -> DataFrame:
    """The chunks of a store, of all corpora or of the active ones."""
    return _tables(spark, [e.chunks for e in manifest(spark, path).values() if e.chunks and (e.active or not active_only)], CHUNK)


def compared(documents: DataFrame, held: DataFrame) -> DataFrame:
    """(corpus, source, digest, was) of every document of either side: ``was`` is new,
    changed, same or gone. Texts stay where they are; digests are joined."""
    now = documents.select(*KEY, digest_of().alias("digest"))
    both = now.join(held.select(*KEY, F.col("digest").alias("_old")), KEY, "full_outer")
    was = F.when(F.col("_old").isNull(), "new").when(F.col("digest").isNull(), "gone").when(F.col("digest") == F.col("_old"), "same").otherwise("changed")
    return both.select(*KEY, F.coalesce("digest", "_old").alias("digest"), was.alias("was"))


def digest_of() -> Column:
    """What a document's chunks depend on, as one hash."""
    fields = [F.coalesce(F.col(c), F.lit("")) for c in ("category", "language", "text")]
    return F.sha2(F.concat_ws("\x1f", *fields).cast("binary"), 256)


@measured
def build(documents: DataFrame, path: str, entries: list[Entry], embed: Callable[[Column], Column] | None = None, size: int = config.CHUNK_SIZE) -> IndexResult:
    """Bring the corpora named by ``entries`` to what ``documents`` holds of them. Others
    stay. An entry that the store has keeps whether it is active; its other fields are
    those given."""
    spark, embed = documents.sparkSession, embed or models.embedder()
    held = manifest(spark, path)
    names = [e.name for e in entries]
    merged = {e.name: Entry(**{**asdict(e), **({k: getattr(held[e.name], k) for k in ("active", "documents", "chunks")} if e.name in held else {})}) for e in entries}
    mine = documents.filter(F.col("corpus").isin(names))
    old_documents = _tables(spark, [merged[n].documents for n in names if merged[n].documents], DOCUMENT)
    step = f"{path}/builds/{uuid.uuid4().hex}"
    compared(mine, old_documents).write.parquet(f"{step}/compared")
    found = spark.read.parquet(f"{step}/compared")
    counts = {n: dict.fromkeys(("new", "changed", "same", "gone"), 0) for n in names}
    for r in found.groupBy("corpus", "was").count().collect():  # four rows a corpus at most
        counts[r.corpus][r.was] = r["count"]
    moved = [n for n in names if counts[n]["new"] + counts[n]["changed"] + counts[n]["gone"] or not merged[n].documents]
    embedded = 0
    if moved:
        todo = found.filter(F.col("corpus").isin(moved))
        fresh = corpus.chunk_rows(mine.join(todo.filter("was IN ('new', 'changed')").select(*KEY), KEY, "left_semi"), size)
        fresh = fresh.select(chunk_id().alias("id"), "source", "corpus", "category", "language", "chunk_index", "content", embed(F.col("content")).cast("array<float>").alias("embedding"), "lexemes", F.lit(step).alias("build"))
        old_chunks = _tables(spark, [merged[n].chunks for n in moved if merged[n].chunks], CHUNK)
        kept = old_chunks.join(todo.filter("was = 'same'").select(*KEY), KEY, "left_semi").select(*fresh.columns)
        kept.unionByName(fresh).withColumn("_corpus", F.col("corpus")).write.partitionBy("_corpus").parquet(f"{step}/chunks")
        todo.filter("was <> 'gone'").select("corpus", "source", "digest").withColumn("_corpus", F.col("corpus")).write.partitionBy("_corpus").parquet(f"{step}/documents")
        for n in moved:
            at = {kind: storage.partition_of(spark, f"{step}/{kind}", "_corpus", n) for kind in ("documents", "chunks")}
            merged[n] = Entry(**{**asdict(merged[n]), **at})
        _commit(spark, path, {**held, **merged})
        embedded = chunks(spark, path).filter(F.col("build") == step).count()
    elif any(held.get(n) != merged[n] for n in names):
        _commit(spark, path, {**held, **merged})
    total = _tables(spark, [merged[n].chunks for n in names if merged[n].chunks], CHUNK).count()
    return IndexResult(len(names), total, *[sum(c[k] for c in counts.values()) for k in ("new", "changed", "same", "gone")], embedded)


def chunk_id() -> Column:
    """A chunk's number, from what names it: the same in every build."""
    return F.xxhash64("corpus", "source", "chunk_index")


def toggle(spark: SparkSession, path: str, name: str, active: bool) -> int:
    """Set whether a corpus takes part in searches; its number of chunks. LookupError for
    one that the store doesn't have."""
    held = manifest(spark, path)
    if name not in held:
        raise LookupError(f"no source {name!r}")
    _commit(spark, path, {**held, name: Entry(**{**asdict(held[name]), "active": active})})
    return _tables(spark, [held[name].chunks] if held[name].chunks else [], CHUNK).count()


def vacuum(spark: SparkSession, path: str) -> None:
    """Delete the tables that the manifest doesn't name."""
    held = manifest(spark, path)
    used = {p.rsplit("/builds/", 1)[1].split("/", 1)[0] for e in held.values() for p in (e.documents, e.chunks) if p}
    for at in storage.children(spark, f"{path}/builds"):
        if at.rsplit("/", 1)[1] not in used:
            storage.delete(spark, at)
