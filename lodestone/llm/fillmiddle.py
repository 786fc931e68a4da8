"""Fill-in-the-middle examples by lookaround splitting.

A unit grammar says what the units of a text are. It is translated to a regular
expression that matches nothing but the place between two characters: what stands before
has to be in one class and what follows in another. Splitting there loses no character,
so the units are the pieces of one split and their concatenation is the text.

Three kinds of grammar are known:

* ``Ended(c)``: units of ``[^c]*[c]|[^c]+`` (lines, for a line feed);
* ``Runs(a, b, ...)``: units of ``[a]+|[b]+|...``, a class each; characters of no class
  stand alone;
* ``SINGLE``: every code point.

Both ends of the middle are drawn from SHA-256 of a seed and the row's key, so that a
rerun of a lost task gives the same example. Everything is one projection of JVM
expressions over a row: no shuffle, no Python, memory in proportion to the row's text.

Defined results: a null text is the empty one; empty texts have no units and stay plain,
and so do texts that hold a sentinel. A null key is hashed as the empty string. Repeated
rows give equal examples; equal cuts give an empty middle. Very long texts are one array
of units while their row is projected. Other columns are kept; a column named like the
result is replaced. An empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SENTINELS = (PREFIX, SUFFIX, MIDDLE)


@dataclass(frozen=True)
class Ended:
    """Units that end after each character of a class; the last one may lack it."""

    mark: str

    def boundary(self) -> str:
        return rf"(?<=[{self.mark}])(?=[\s\S])"


class Runs:
    """Longest runs of characters of one class; others are units of their own."""

    def __init__(self, *classes: str):
        if not classes:
            raise ValueError("no classes")
        self.classes = classes

    def boundary(self) -> str:
        changes = [rf"(?<=[{c}])(?=[^{c}])" for c in self.classes]
        every = "".join(self.classes)
        return "|".join([*changes, rf"(?<=[^{every}])(?=[\s\S])"])


#: Every code point is a unit.
SINGLE = Ended(r"\s\S")
LINES = Ended(r"\n")
WORDS = Runs(r"\s", r"\S")
TOKENS = Runs(r"\p{L}\p{M}", r"\p{Nd}", r"\s")


def units(text: Column, grammar: Ended | Runs) -> Column:
    """The units of a text in order; none of an empty or null one."""
    cut = F.split(text, F.lit(grammar.boundary()), -1)
    return F.when(F.length(text) > 0, cut).otherwise(F.array().cast("array<string>"))


def draws(key: Column, seed: int, count: int) -> list[Column]:
    """Unsigned 32-bit numbers: the 8-digit groups of the digest of ``seed:key``."""
    if not 1 <= count <= 8:
        raise ValueError("a digest has 8 groups")
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(count)]


def _joined(pieces: Column, start: Column, end: Column) -> Column:
    return F.array_join(F.slice(pieces, start + 1, end - start), "")


def _holds_sentinel(text: Column) -> Column:
    found = F.lit(False)
    for mark in SENTINELS:
        found = found | F.contains(text, F.lit(mark))
    return found


def transform(docs: DataFrame, key: str, text: str, grammar: Ended | Runs = LINES, seed: int = 7, fim_percent: int = 100, spm_percent: int = 50, into: str = "fim") -> DataFrame:
    """docs with a struct ``into`` of n (units), form (plain, psm or spm), prefix, middle
    and suffix (null where plain) and output, the training text.

    ``fim_percent`` of the texts are cut, and of these ``spm_percent`` put the suffix first.
    """
    kept = [c for c in docs.columns if c != into]
    whole = F.coalesce(F.col(text), F.lit(""))
    h = draws(F.col(key), seed, 4)
    cut = docs.select(*[F.col(c) for c in docs.columns], whole.alias("_whole"), units(whole, grammar).alias("_units"))
    n = F.size("_units").cast("long")
    ends = [h[0] % (n + 1), h[1] % (n + 1)]
    plain = (F.col("_whole") == "") | _holds_sentinel(F.col("_whole")) | (h[2] % 100 >= fim_percent)
    form = F.when(plain, "plain").when(h[3] % 100 < spm_percent, "spm").otherwise("psm")
    placed = cut.select(*kept, "_whole", "_units", n.alias("_n"), form.alias("_form"), F.least(*ends).cast("int").alias("_from"), F.greatest(*ends).cast("int").alias("_to"))
    parts = {"prefix": _joined(F.col("_units"), F.lit(0), F.col("_from")), "middle": _joined(F.col("_units"), F.col("_from"), F.col("_to")), "suffix": _joined(F.col("_units"), F.col("_to"), F.col("_n").cast("int"))}
    parted = placed.select(*kept, "_whole", "_n", "_form", *[F.when(F.col("_form") != "plain", c).alias(f"_{name}") for name, c in parts.items()])
    prefix, middle, suffix = F.col("_prefix"), F.col("_middle"), F.col("_suffix")
    output = (
        F.when(F.col("_form") == "psm", F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), middle))
        .when(F.col("_form") == "spm", F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle))
        .otherwise(F.col("_whole"))
    )
    example = F.struct(F.col("_n").alias("n"), F.col("_form").alias("form"), prefix.alias("prefix"), middle.alias("middle"), suffix.alias("suffix"), output.alias("output"))
    return parted.select(*kept, example.alias(into))


def restored(output: Column, form: Column) -> Column:
    """The exact text of an example, from its output and form alone. The parts of a cut
    text hold no sentinel, and none can arise where a part meets one, as a sentinel's
    first character occurs in it only once."""
    parts = F.split(output, "|".join(SENTINELS), -1)
    second, third, last = F.get(parts, F.lit(1)), F.get(parts, F.lit(2)), F.get(parts, F.lit(3))
    return F.when(form == "psm", F.concat(second, last, third)).when(form == "spm", F.concat(third, last, second)).otherwise(output)
