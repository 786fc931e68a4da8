"""Text expressions: chunking, categories, lexemes, names and prompts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestone.functions import stemming

#: From coarse to fine; what no separator cuts is sliced.
SEPARATORS = ("\n\n", "\n", ". ", " ")
SECTION = "\n## "
#: White space, and what doesn't end a line.
SPACE = r"[\s\x0b\x1c-\x1f\x85\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
NO_LINE_END = r"[^\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"

#: What full-text search takes for words.
WORD = r"[\p{L}\p{N}]+"


def is_blank(text: Column) -> Column:
    """Whether nothing but white space is there, by Unicode's notion of it."""
    return F.length(F.regexp_replace(text, SPACE + "+", "")) == 0


def header_chunks(text: Column) -> Column:
    """Sections at ``## `` headers; later ones repeat the document's first line, so that
    each section says what it belongs to. Blank documents have none."""
    parts = F.split(text, SECTION)
    title = F.regexp_extract(text, f"^{NO_LINE_END}*", 0)
    whole = F.transform(parts, lambda part, i: F.when(i == 0, part).otherwise(F.concat(title, F.lit(SECTION), part)))
    return F.when(~is_blank(text), whole).otherwise(F.array().cast("array<string>"))


def _sliced(piece: Column, size: int) -> Column:
    count = F.ceil(F.length(piece) / size).cast("int")
    return F.when(F.length(piece) == 0, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.substring(piece, i * size + 1, F.lit(size))))


def size_chunks(piece: Column, size: int = 1024, separators: tuple[str, ...] = SEPARATORS) -> Column:
    """Pieces of at most ``size`` characters: neighbours at the coarsest separator are
    joined while they fit; one that is too large alone is cut at the next separator. A
    piece begins with no separator, and none ends up empty unless ``piece`` is."""
    if not separators:
        return _sliced(piece, size)
    first, rest = separators[0], separators[1:]
    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit("").alias("open"))

    def closed(state: Column) -> Column:
        return F.when(state["open"] == "", state["out"]).otherwise(F.concat(state["out"], F.array(state["open"])))

    def step(state: Column, part: Column) -> Column:
        joined = F.when(state["open"] == "", part).otherwise(F.concat(state["open"], F.lit(first), part))
        return (
            F.when(F.length(joined) <= size, F.struct(state["out"].alias("out"), joined.alias("open")))
            .when(F.length(part) > size, F.struct(F.concat(closed(state), size_chunks(part, size, rest)).alias("out"), F.lit("").alias("open")))
            .otherwise(F.struct(closed(state).alias("out"), part.alias("open")))
        )

    cut = F.aggregate(F.split(piece, F.lit("\\Q" + first + "\\E")), start, step, closed)
    return F.when(F.length(piece) <= size, F.array(piece)).otherwise(cut)


def chunks(text: Column, size: int = 1024) -> Column:
    """All chunks of a markdown document in order."""
    return F.flatten(F.transform(header_chunks(text), lambda section: size_chunks(section, size)))


def category_of_path(path: Column) -> Column:
    """Dotted category of a relative path: no suffix, odd characters as underscores."""
    bare = F.regexp_replace(path, r"\.[^./]*$", "")
    return F.array_join(F.transform(F.split(bare, "/"), lambda part: F.regexp_replace(part, r"(?U)[^\w-]", "_")), ".")


def category_level(category: Column) -> Column:
    return F.size(F.split(category, r"\.")) - 1


def top_category(category: Column) -> Column:
    return F.split_part(category, F.lit("."), F.lit(1))


def in_category(category: Column, wanted: str) -> Column:
    """Whether ``wanted`` is a run of whole labels anywhere in the path."""
    return F.concat(F.lit("."), category, F.lit(".")).contains(f".{wanted}.")


def title_of(text: Column) -> Column:
    """First line without leading number signs; null if nothing is left."""
    line = F.regexp_extract(text, f"^{NO_LINE_END}*", 0)
    return F.nullif(F.regexp_replace(F.regexp_replace(line, "^#+", ""), f"^{SPACE}+|{SPACE}+$", ""), F.lit(""))


def words(text: Column) -> Column:
    """Small-letter runs of letters and digits in order."""
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def placed_lexemes(text: Column, configuration: str | Column = "simple") -> Column:
    """The lexeme of every word of a text at the word's place; stop words are empty. The
    ``simple`` configuration has neither stems nor stop words."""
    if isinstance(configuration, str):
        return words(text) if configuration == "simple" else stemming.placed_lexemes(words(text), F.lit(configuration))
    return stemming.placed_lexemes(words(text), configuration)


def lexemes(text: Column, configuration: str | Column = "simple") -> Column:
    """The lexemes of a text in order, without stop words."""
    return F.filter(placed_lexemes(text, configuration), lambda w: w != "")


def search_configuration(language: Column) -> Column:
    """The declared language of a document as a text-search configuration."""
    return F.when(language.startswith("rus"), "russian").when(language.startswith("eng"), "english").otherwise("simple")


def all_present(wanted: Column, held: Column) -> Column:
    """Whether every wanted lexeme is held; an empty query matches nothing."""
    return (F.size(wanted) > 0) & (F.size(F.array_except(wanted, held)) == 0)


def truncated(text: Column, size: int) -> Column:
    """The first characters of a text."""
    return F.left(text, F.lit(size))


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def is_ignored(source: Column, names=("index.md",)) -> Column:
    return basename(source).isin(*names)


def without_emphasis(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"[_*`]", ""))


def text_hash(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def value_suffix(value: Column) -> Column:
    """Whole numbers padded to two digits; odd characters as underscores."""
    text = value.cast("string")
    return F.when(text.rlike(r"^\d+$"), F.when(F.length(text) < 2, F.lpad(text, 2, "0")).otherwise(text)).otherwise(F.regexp_replace(text, r"[^a-zA-Z0-9._-]", "_"))


def run_name(base: Column, parameter: Column, value: Column) -> Column:
    return F.concat_ws("_", base, parameter, value_suffix(value))


def model_tag(name: Column) -> Column:
    """The model name with a tag, ``latest`` if it has none."""
    return F.when(name.contains(":"), name).otherwise(F.concat(name, F.lit(":latest")))


def formatted_chunk(source: Column, content: Column) -> Column:
    return F.concat(F.lit("["), source, F.lit("]\n"), content)


def labelled(sections: dict[str, Column]) -> Column:
    """Prompt sections under their labels, parted by a rule."""
    parts = [F.concat(F.lit(f"{name}:\n"), text) for name, text in sections.items()]
    return reduce(lambda a, b: F.concat(a, F.lit("\n\n---\n\n"), b), parts)


def trimmed_items(text: Column, mark: str = ",") -> Column:
    """Items between marks, trimmed, empty ones left out."""
    return F.filter(F.transform(F.split(text, mark), lambda x: F.trim(x)), lambda x: x != "")


def verdict(reply: Column) -> Column:
    """A judge's JSON reply as struct<reason, score>; null unless the score is 0 to 10."""
    got = F.from_json(reply, "reason string, score int")
    return F.when(got["score"].between(0, 10), got)


def verdict_error(reply: Column) -> Column:
    """Why a reply is no verdict: ``invalid_json`` or ``invalid_score``; null if it is one."""
    got = F.from_json(reply, "reason string, score int")
    broken = reply.isNull() | F.try_parse_json(reply).isNull()
    return F.when(broken, F.lit("invalid_json")).when(~F.coalesce(got["score"].between(0, 10), F.lit(False)), F.lit("invalid_score"))
