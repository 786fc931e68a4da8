"""Question banks: README, JSONL, TSV and plain-text readers, and their writers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.functions import text

# What a prompt file's name says.
PURPOSES = ("generate_answer", "agent_system", "judge_faithfulness", "judge_relevance", "judge_completeness", "paraphrase_question", "translate_question")
PROMPT_FILE = r"^([a-z_]+)\.v(\d+)\.txt$"
TSV_COLUMNS = ("set_name", "language", "kind", "marked_sources", "original_text")


def qa_pairs(documents: DataFrame) -> DataFrame:
    """(source, number, question, answer) of README sections ``## 1. title``; an answer
    is the text up to the next header of that kind."""
    parts = F.split("text", r"(?m)(?=^## \d+\. )")
    rows = documents.select("source", F.posexplode(parts).alias("pos", "part")).filter(F.col("part").rlike(r"^## \d+\. "))
    title = text.without_emphasis(F.regexp_extract("part", r"^## \d+\. ([^\n]*)", 1))
    return rows.select("source", F.regexp_extract("part", r"^## (\d+)\. ", 1).cast("int").alias("number"), title.alias("question"), F.trim(F.regexp_replace("part", r"^## \d+\. [^\n]*\n?", ""), F.lit(" \n\t\r")).alias("answer"))


def lines_of(content: Column) -> Column:
    return F.split(content, r"\r\n|\r|\n")


def parse_import(rows: DataFrame) -> DataFrame:
    """Import files (content): (question, marked_sources, text_hash), first of equal
    questions. Blank lines and comments go; ``NONE`` or no pipe means no sources."""
    lines = rows.select(F.posexplode(lines_of(F.col("content"))).alias("pos", "line")).select("pos", F.trim("line").alias("line")).filter((F.col("line") != "") & ~F.col("line").startswith("#"))
    at = F.locate("|", "line")
    question = F.trim(F.when(at > 0, F.expr("substring(line, 1, locate('|', line) - 1)")).otherwise(F.col("line")))
    marks = F.trim(F.when(at > 0, F.expr("substring(line, locate('|', line) + 1)")).otherwise(F.lit("")))
    none = (marks == "") | (F.upper(marks) == "NONE")
    parsed = lines.select("pos", question.alias("question"), F.when(none, F.array().cast("array<string>")).otherwise(text.trimmed_items(marks)).alias("marked_sources")).filter("question <> ''")
    hashed = parsed.withColumn("text_hash", text.text_hash(F.col("question")))
    first = Window.partitionBy("text_hash").orderBy("pos")
    return hashed.withColumn("_n", F.row_number().over(first)).filter("_n = 1").select("pos", "question", "marked_sources", "text_hash")


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """(line, at) of a file or of all files of a folder, blank lines left out; ``at`` sorts
    as the lines stand. Large files are read in splits."""
    where = F.struct("_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id().alias("n"))
    return spark.read.text(path).select(F.col("value").alias("line"), where.alias("at")).filter(F.trim("line") != "")


def read_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """(question, reference_answer, source); blank lines are skipped, and of repeated
    questions the last line counts."""
    rows = _lines(spark, path).select("at", F.from_json("line", "question string, reference_answer string, source string").alias("r")).select("at", "r.*")
    last = rows.groupBy("question").agg(F.max_by(F.struct("reference_answer", "source"), "at").alias("r"))
    return last.select("question", "r.*")


def read_tsv(spark: SparkSession, path: str) -> DataFrame:
    """Rows by the header's names, and ``at``, which sorts as they stand; quotes are plain,
    short rows end in nulls, blanks are null, and ``marked_sources`` is split at commas. In
    a folder every file begins with the same header."""
    header = spark.read.text(path).first()[0]
    names = header.split("\t")
    cells = F.split("line", "\t")
    rows = _lines(spark, path).filter(F.col("line") != header).select("at", *[F.nullif(F.get(cells, i), F.lit("")).alias(name) for i, name in enumerate(names)])
    listed = F.coalesce(F.filter(F.split("marked_sources", ","), lambda s: s != ""), F.array().cast("array<string>"))
    return rows.withColumn("marked_sources", listed) if "marked_sources" in names else rows


def question_rows(dataset: DataFrame, answers: DataFrame) -> DataFrame:
    """(text_hash, original_text, set_name, language, kind, marked_sources,
    reference_answer): the first of equal questions of read_tsv(), with the answers
    (question, reference_answer) of the same text."""
    own = ("original_text", "set_name", "language", "kind", "marked_sources")
    hashed = dataset.withColumn("text_hash", text.text_hash(F.col("original_text")))
    first = hashed.groupBy("text_hash").agg(F.min_by(F.struct(*own), "at").alias("r")).select("text_hash", "r.*")
    named = with_answers(first.withColumnRenamed("original_text", "question"), answers)
    return named.withColumnRenamed("question", "original_text").select("text_hash", *own, "reference_answer")


def dataset_rows(answers: DataFrame) -> DataFrame:
    """TSV_COLUMNS of the interview answers (question, reference_answer, source)."""
    marked = F.array_compact(F.array(F.nullif("source", F.lit(""))))
    return answers.select(F.lit("interview").alias("set_name"), F.lit("eng").alias("language"), F.lit("in_corpus").alias("kind"), marked.alias("marked_sources"), F.col("question").alias("original_text"))


def with_answers(questions: DataFrame, answers: DataFrame) -> DataFrame:
    """questions with the reference answer of the same text, if there is one."""
    return questions.join(answers.select("question", "reference_answer"), "question", "left")


def read_prompts(spark: SparkSession, folder: str) -> DataFrame:
    """(purpose, version, template) of prompt files; an unknown purpose fails."""
    files = spark.read.text(folder, wholetext=True).select(F.col("_metadata.file_name").alias("name"), F.col("value").alias("template"))
    purpose, version = F.regexp_extract("name", PROMPT_FILE, 1), F.regexp_extract("name", PROMPT_FILE, 2)
    known = F.when(purpose.isin(*PURPOSES), purpose).otherwise(F.raise_error(F.concat(F.lit("unknown prompt purpose: "), "name")))
    return files.select(known.alias("purpose"), version.cast("int").alias("version"), "template")


def write_jsonl(rows: DataFrame, path: str) -> None:
    """One JSON object a line, nulls as null."""
    rows.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def write_tsv(rows: DataFrame, path: str) -> None:
    """TSV_COLUMNS under a header, lists joined by commas, nulls empty, nothing quoted."""
    cells = [F.array_join(c, ",") if c == "marked_sources" else F.coalesce(F.col(c).cast("string"), F.lit("")) for c in TSV_COLUMNS]
    line = F.concat_ws("\t", *cells)
    plain = {"header": "true", "sep": "\x01", "quote": "", "emptyValue": "", "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}
    rows.select(line.alias("\t".join(TSV_COLUMNS))).write.mode("overwrite").options(**plain).csv(path)
