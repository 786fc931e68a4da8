"""Markdown trees as a Spark data source.

``spark.read.format("markdown_files").load(root)`` gives a row a file. The driver lists
names only and plans partitions of bounded size; executors open the files. Which names are
wanted is said by options and settled before the plan, so other files are never opened.
The source doesn't take filters from Spark: in Spark 4.1.2 a filter that a Python source
has taken stays with its DataFrame, and the next query of it without the filter lacks rows.

Options: ``scans``, a JSON list of [folder, pattern, recursive] below the root; ``stems``,
a JSON list of the only file stems to read; ``denied``, one of stems to leave out;
``frontMatter``, whether files may begin with a block of metadata; ``partitionBytes`` and
``partitionFiles``, how large a task gets.

Bytes that aren't UTF-8 are dropped and line ends are line feeds. A root that isn't there
has no files. A front matter is a YAML mapping between two lines of dashes; a file with one
loses it, and white space around what is left. What it says is in ``meta``: scalars as
text, anything nested as JSON; ``tags`` is its list of that name.
"""

from __future__ import annotations

import fnmatch
import json
import posixpath
import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

FORMAT = "markdown_files"
SCHEMA = "path string, stem string, meta map<string,string>, tags array<string>, text string"
_ARROW = pa.schema([("path", pa.string()), ("stem", pa.string()), ("meta", pa.map_(pa.string(), pa.string())), ("tags", pa.list_(pa.string())), ("text", pa.string())])
_BLOCK = re.compile(r"\A\s*---[ \t]*\n(.*?\n)?---[ \t]*(?:\n|\Z)(.*)\Z", re.DOTALL)
_FLAT = re.compile(r"^([\w-]+):[ \t]*(.*?)[ \t]*$")
#: Rows of one Arrow batch.
AT_ONCE = 64


def opened(uri: str) -> tuple[pafs.FileSystem, str]:
    """(file system, path) of a folder's URI."""
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    if "://" not in uri:
        return pafs.LocalFileSystem(), uri
    return pafs.FileSystem.from_uri("s3://" + uri[6:] if uri.startswith("s3a://") else uri)


def stem_of(path: str) -> str:
    return posixpath.splitext(posixpath.basename(path))[0]


def _flat(block: str) -> dict:
    """Top-level keys with plain values or inline lists: what can be read without a YAML
    library."""
    out: dict = {}
    for line in block.splitlines():
        if found := _FLAT.match(line):
            value = found[2].strip("\"'")
            out[found[1]] = [x.strip().strip("\"'") for x in value[1:-1].split(",") if x.strip()] if value[:1] == "[" and value[-1:] == "]" else value
    return out


def parsed(block: str) -> dict:
    """A YAML block as a mapping; ValueError for anything else."""
    try:
        import yaml
    except ImportError:
        return _flat(block)
    try:
        found = yaml.safe_load(block)
    except yaml.YAMLError as e:
        raise ValueError(f"no YAML: {e}") from e
    if found is not None and not isinstance(found, dict):
        raise ValueError("a front matter is a mapping")
    return found or {}


def _as_text(value) -> str:
    return json.dumps(value, ensure_ascii=False, default=str) if isinstance(value, (dict, list)) else "" if value is None else str(value)


def front_matter(text: str) -> tuple[dict, str]:
    """The metadata of a text and what is left of it."""
    found = _BLOCK.match(text)
    return (parsed(found[1] or ""), found[2].strip()) if found else ({}, text.strip())


def clean(content: bytes) -> str:
    return re.sub("\r\n?", "\n", content.decode("utf-8", "ignore"))


class Files(InputPartition):
    """The files of one task: (path below the root, path in the file system)."""

    def __init__(self, files: list[tuple[str, str]]):
        self.files = files


class MarkdownReader(DataSourceReader):
    def __init__(self, options: dict):
        options = {k.lower(): v for k, v in options.items()}
        self.root = options["path"].rstrip("/")
        self.scans = json.loads(options.get("scans") or '[["", "*.md", true]]')
        self.denied = frozenset(json.loads(options.get("denied") or "[]"))
        self.front = str(options.get("frontmatter", "false")).lower() == "true"
        self.bytes = int(options.get("partitionbytes", 16 << 20))
        self.count = int(options.get("partitionfiles", 4096))
        self.stems = frozenset(json.loads(options["stems"])) if "stems" in options else None

    def _names(self) -> Iterator[tuple[str, str, int]]:
        fs, base = opened(self.root)
        for folder, pattern, recursive in self.scans:
            at = f"{base}/{folder}".rstrip("/")
            for info in fs.get_file_info(pafs.FileSelector(at, allow_not_found=True, recursive=recursive)):
                path = info.path[len(base) :].lstrip("/")
                stem = stem_of(path)
                wanted = stem not in self.denied and (self.stems is None or stem in self.stems)
                if wanted and info.type == pafs.FileType.File and fnmatch.fnmatchcase(posixpath.basename(path), pattern):
                    yield path, info.path, info.size

    def partitions(self) -> list[Files]:
        out, held, size = [], [], 0
        for path, full, n in sorted(set(self._names())):
            if held and (size + n > self.bytes or len(held) >= self.count):
                out.append(Files(held))
                held, size = [], 0
            held.append((path, full))
            size += n
        return [*out, Files(held)]

    def _row(self, fs: pafs.FileSystem, path: str, full: str) -> dict:
        with fs.open_input_stream(full, compression=None) as stream:
            text = clean(stream.read())
        try:
            meta, text = front_matter(text) if self.front else ({}, text)
        except ValueError as e:
            raise ValueError(f"{full}: {e}") from e
        tags = meta.get("tags")
        return {"path": path, "stem": stem_of(path), "meta": [(str(k), _as_text(v)) for k, v in meta.items()], "tags": [_as_text(t) for t in tags] if isinstance(tags, list) else [], "text": text}

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        fs, _ = opened(self.root)
        for i in range(0, len(partition.files), AT_ONCE):
            yield pa.RecordBatch.from_pylist([self._row(fs, *f) for f in partition.files[i : i + AT_ONCE]], schema=_ARROW)


class MarkdownFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> MarkdownReader:
        return MarkdownReader(dict(self.options))


def written(rows: DataFrame, root: str) -> int:
    """Write (path, text) as files below ``root`` and count them. A task that is run again
    writes the same bytes to the same names."""

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = opened(root)
        for batch in batches:
            for path, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                fs.create_dir(posixpath.dirname(f"{base}/{path}"), recursive=True)
                with fs.open_output_stream(f"{base}/{path}", compression=None) as out:
                    out.write((text or "").encode())
            yield pa.RecordBatch.from_pydict({"n": [batch.num_rows]})

    return rows.select("path", "text").mapInArrow(put, "n long").agg({"n": "sum"}).first()[0] or 0


def register(spark: SparkSession, source: type[DataSource] = MarkdownFiles) -> None:
    spark.dataSource.register(source)
