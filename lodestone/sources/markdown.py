"""Markdown corpora as DataFrames (source, path, text), and the registry of corpora."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone import storage
from lodestone.functions import text
from lodestone.sources import files

# What each known corpus scans and how it names categories.
REDIS_PREFIX = "databases.redis."
INTERVIEW_SUFFIX = "-interview-questions"
DESIGN_CATEGORY = "system-design"
FALLBACK_CATEGORY = "misc"
HIDDEN = "Hidden"


def exists(spark: SparkSession, root: str) -> bool:
    return storage.exists(spark, root)


def visible(files: DataFrame) -> DataFrame:
    return files.filter(F.coalesce(F.try_element_at("meta", F.lit("category")), F.lit("")) != HIDDEN)


@dataclass(frozen=True)
class SourceSpec:
    """One corpus: where its files are and how each becomes a document."""

    name: str
    root: str
    language: str = "eng"
    patterns: tuple[tuple[str, str, bool], ...] = (("", "*.md", True),)
    category: Callable[[Column, Column], Column] = lambda path, meta: text.category_of_path(path)
    denied: tuple[str, ...] = ()
    has_front_matter: bool = False
    git_url: str | None = None


REGISTRY: dict[str, SourceSpec] = {}


def is_git(spec: SourceSpec) -> bool:
    return spec.git_url is not None


def available(spark: SparkSession, specs: list[SourceSpec]) -> list[SourceSpec]:
    """Local corpora, then those of repositories that have been cloned to their root; a
    repository that isn't there is left out."""
    local = [s for s in specs if not is_git(s)]
    return local + [s for s in specs if is_git(s) and exists(spark, s.root)]


def register(spec: SourceSpec) -> SourceSpec:
    if spec.name in REGISTRY:
        raise ValueError(f"source {spec.name} is registered twice")
    REGISTRY[spec.name] = spec
    return spec


def notes(root: str) -> SourceSpec:
    return SourceSpec("notes", root, "rus")


def interview(name: str, root: str, language: str = "eng") -> SourceSpec:
    topic = name.removesuffix(INTERVIEW_SUFFIX)
    return SourceSpec(name, root, language, (("", "README.md", False),), lambda path, meta: F.lit(f"interview.{topic}"))


def redis_docs(root: str) -> SourceSpec:
    return SourceSpec("redis-doc", root, "eng", (("commands", "*.md", False), ("docs", "*.md", True)), lambda path, meta: F.concat(F.lit(REDIS_PREFIX), text.category_of_path(path)))


def _design_category(path: Column, meta: Column) -> Column:
    parts = F.split(path, "/")
    nested = (F.element_at(parts, 1) == "solutions") & (F.size(parts) > 3)
    return F.when(nested, F.concat(F.lit(f"{DESIGN_CATEGORY}."), F.regexp_replace(F.try_element_at(parts, F.lit(3)), r"(?U)[^\w-]", "_"))).otherwise(DESIGN_CATEGORY)


def system_design(root: str) -> SourceSpec:
    return SourceSpec("system-design-primer", root, "eng", (("", "README.md", True),), _design_category)


def cheatsheets(root: str, denied: tuple[str, ...] = (), by_category: dict[str, str] | None = None, by_file: dict[str, str] | None = None) -> SourceSpec:
    """Categories come from the front matter, else the file's stem, else ``misc``."""

    def category(path: Column, meta: Column) -> Column:
        stem = F.regexp_replace(text.basename(path), r"\.[^.]*$", "")
        out = F.lit(FALLBACK_CATEGORY)
        for key, table in ((stem, by_file), (F.try_element_at(meta, F.lit("category")), by_category)):
            if table:
                held = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
                out = F.coalesce(F.try_element_at(held, key), out)
        return out

    return SourceSpec("cheatsheets", root, "eng", (("", "*.md", False),), category, denied, True)


def format_of(spark: SparkSession, spec: SourceSpec) -> str:
    """Register a format by the corpus's name: ``spark.read.format(name).load(root)`` gives
    its files, with the corpus's own patterns, deny list and front matter."""
    held = {"scans": json.dumps(spec.patterns), "denied": json.dumps(spec.denied), "frontMatter": str(spec.has_front_matter)}

    class Corpus(files.MarkdownFiles):
        @classmethod
        def name(cls) -> str:
            return spec_name

        def reader(self, schema):
            return files.MarkdownReader({**held, **dict(self.options)})

    spec_name = spec.name
    files.register(spark, Corpus)
    return spec.name


def documents(spark: SparkSession, spec: SourceSpec) -> DataFrame:
    """(source, corpus, category, language, title, tags, text) of a corpus."""
    out = spark.read.format(format_of(spark, spec)).load(spec.root)
    if spec.has_front_matter:
        out = visible(out)
    root_name = spec.root.rstrip("/").rsplit("/", 1)[-1]
    title = F.coalesce(F.nullif(F.try_element_at("meta", F.lit("title")), F.lit("")), text.title_of(F.col("text")))
    return out.select(F.concat(F.lit(f"{root_name}/"), "path").alias("source"), F.lit(spec.name).alias("corpus"), spec.category(F.col("path"), F.col("meta")).alias("category"), F.lit(spec.language).alias("language"), title.alias("title"), "tags", "text")


def corpora(spark: SparkSession, specs: list[SourceSpec]) -> DataFrame:
    """The documents of all corpora that are there."""
    held = [documents(spark, s) for s in available(spark, specs)]
    if not held:
        return spark.createDataFrame([], "source string, corpus string, category string, language string, title string, tags array<string>, text string")
    return reduce(DataFrame.unionByName, held)


def readmes(spark: SparkSession, base_url: str, repositories: list[str], folder: str, language: str = "eng") -> DataFrame:
    """The READMEs of the interview repositories below ``folder``; those that aren't there
    are left out."""
    specs = [replace(interview(name, f"{folder.rstrip('/')}/{name}", language), git_url=f"{base_url}/{name}") for name in repositories]
    return corpora(spark, specs)
