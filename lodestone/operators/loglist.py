"""The listing of question logs: filters, the joined question, pages and details.

Logs have (id, run_name, pipeline, question_id, answered, answer, context, ..., created_at)
and scores as text; questions (id, original_text, set_name).
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.operators import evals, listing

#: What a listing may be sorted by.
SORTED_BY = {"id": "id", "created_at": "created_at", "elapsed": "elapsed"}


@dataclass(frozen=True)
class LogFilter:
    """What a listing asks for; None asks for nothing."""

    question_id: int | None = None
    text: str | None = None
    set_name: tuple[str, ...] | None = None
    run_name: tuple[str, ...] | None = None
    pipeline: tuple[str, ...] | None = None
    answered: bool | None = None
    faithfulness: tuple[str, ...] | None = None
    relevance: tuple[str, ...] | None = None
    completeness: tuple[str, ...] | None = None
    created_from: datetime | None = None
    created_to: datetime | None = None

    def of_logs(self, logs: DataFrame) -> DataFrame:
        for column in ("run_name", "pipeline", *evals.AXES):
            if (wanted := getattr(self, column)) is not None:
                logs = logs.filter(listing.one_of(column, list(wanted)))
        if self.question_id is not None:
            logs = logs.filter(F.col("question_id") == self.question_id)
        if self.answered is not None:
            logs = logs.filter(listing.is_flag("answered", self.answered))
        if self.created_from is not None or self.created_to is not None:
            logs = logs.filter(listing.within("created_at", self.created_from, self.created_to))
        return logs

    def of_questions(self, questions: DataFrame) -> DataFrame:
        if self.text is not None:
            questions = questions.filter(listing.substring("original_text", self.text))
        return questions if self.set_name is None else questions.filter(listing.one_of("set_name", list(self.set_name)))

    @property
    def asks_questions(self) -> bool:
        return self.text is not None or self.set_name is not None


def items(logs: DataFrame, questions: DataFrame, wanted: LogFilter = LogFilter()) -> DataFrame:
    """The logs that are asked for with question_text and set_name, without contexts.
    Where the question itself is asked for the join is inner and its filters come first;
    else logs without a question stay."""
    own = wanted.of_questions(questions).select(F.col("id").alias("question_id"), F.col("original_text").alias("question_text"), "set_name")
    kept = wanted.of_logs(logs).drop("context")
    return kept.join(own, "question_id", "inner" if wanted.asks_questions else "left").select(*kept.columns, "question_text", "set_name")


def page_of(logs: DataFrame, questions: DataFrame, wanted: LogFilter, page: listing.Page) -> DataFrame:
    """A page of items()."""
    return listing.paged(items(logs, questions, wanted), page)


def detail(logs: DataFrame, questions: DataFrame, identity: int) -> DataFrame:
    """One log as an item with its context; LookupError if it isn't there."""
    one = listing.lookup(logs, "id", identity)
    return items(one, questions).join(one.select("id", "context"), "id")
