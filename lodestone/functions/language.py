"""Language detection by character n-gram profiles.

A profile is the weight of each gram of one to three characters (words padded with a
blank) in a language. Weights are whole numbers above what an unseen gram has, so sums
don't depend on their order and a gram that no language knows says nothing. Profiles are
trained from any table of labelled texts; without one, the function words of a few
languages are the seed.

Texts are reduced to counts of distinct words first: grams are only made once for each
word, and every step is a partial aggregate.
"""

from __future__ import annotations

import functools
import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Frequent function words, the seed of a profile.
SEEDS = {
    "en": "the of and to in is that it was for on are as with his they be at one have this from or had by but what some we can out other were all there when up use your how",
    "ru": "и в не на я быть он с что а по это она этот к но они мы весь который из у то за свой что весь год от так о для ты же все тот мочь вы человек такой его сказать только или ещё как",
    "uk": "і в не на я бути він з що а по це вона цей до але вони ми весь який із у то за свій рік від так про для ти ж все той могти ви людина такий його сказати тільки або ще як є її",
    "bg": "и в не на да се че от с за е са по това като но той тя те ние който към или още до при през след само така ще съм беше има може много всички този една без",
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie",
    "fr": "de la le et les des en un du une que est pour qui dans a par plus pas au sur ne se ce il sont avec son aux d'un cette ont ses mais comme on tout nous sa",
    "es": "de la que el en y a los se del las un por con no una su para es al lo como más o pero sus le ha me si sin sobre este ya entre cuando todo esta ser son",
}
#: Text-search configurations of detected languages; any other text is read as English.
CONFIGURATIONS = {"en": "english", "ru": "russian"}
SIZES = (1, 2, 3)
SMOOTHING, SCALE = 0.5, 1000


def _weight(n: float, total: int, distinct: int, largest: int) -> int:
    """How much likelier a gram is than one that the largest profile hasn't seen."""
    return round(SCALE * (math.log((n + SMOOTHING) / (total + SMOOTHING * distinct)) - math.log(SMOOTHING / (largest + SMOOTHING * distinct))))


def _grams(word: str) -> list[str]:
    padded = f" {word} "
    return [g for n in SIZES for i in range(len(padded) - n + 1) if (g := padded[i : i + n]) != " "]


@functools.cache
def _seeded() -> dict[str, dict[str, int]]:
    counts = {name: Counter(g for w in re.findall(r"[^\W\d_]+", words.lower()) for g in _grams(w)) for name, words in SEEDS.items()}
    totals = {name: sum(c.values()) for name, c in counts.items()}
    distinct, largest = len(set().union(*counts.values())), max(totals.values())
    return {name: {g: _weight(n, totals[name], distinct, largest) for g, n in c.items()} for name, c in counts.items()}


def detect(question: str) -> str | None:
    """The language of one question by the seed profiles; None if no gram is known."""
    grams = [g for w in re.findall(r"[^\W\d_]+", question.lower()) for g in _grams(w)]
    scores = {name: sum(held.get(g, 0) for g in grams) for name, held in _seeded().items()}
    best = min(scores, key=lambda name: (-scores[name], name))
    return best if scores[best] > 0 else None


def configuration_of(question: str) -> str:
    return CONFIGURATIONS.get(detect(question), "english")


def seed_profiles(spark: SparkSession) -> DataFrame:
    """The seed as a profile table (language, gram, weight): some thousand rows."""
    return spark.createDataFrame([(name, g, w) for name, held in _seeded().items() for g, w in held.items()], "language string, gram string, weight long")


def _word_counts(texts: DataFrame, text: str, *by: str) -> DataFrame:
    words = F.regexp_extract_all(F.lower(F.col(text)), F.lit(r"\p{L}+"), F.lit(0))
    return texts.select(*by, F.explode(words).alias("word")).groupBy(*by, "word").agg(F.count(F.lit(1)).alias("n"))


def grams(word: Column) -> Column:
    padded = F.concat(F.lit(" "), word, F.lit(" "))

    def of_size(n: int) -> Column:
        return F.transform(F.sequence(F.lit(1), F.length(padded) - (n - 1)), lambda i: F.substring(padded, i, F.lit(n)))

    return F.filter(F.flatten(F.array(*[of_size(n) for n in SIZES])), lambda g: g != " ")


def profiles(texts: DataFrame, language: str, text: str) -> DataFrame:
    """(language, gram, weight) trained from labelled texts; a null label is left out."""
    words = _word_counts(texts.filter(F.col(language).isNotNull()).select(F.col(language).alias("language"), text), text, "language")
    counts = words.select("language", "n", F.explode(grams(F.col("word"))).alias("gram")).groupBy("language", "gram").agg(F.sum("n").alias("n"))
    totals = counts.groupBy("language").agg(F.sum("n").alias("total"))
    overall = totals.agg(F.max("total").alias("largest")).crossJoin(counts.select("gram").distinct().agg(F.count(F.lit(1)).alias("distinct")))  # one row
    sized = counts.join(totals, "language").crossJoin(F.broadcast(overall))
    smooth = SMOOTHING * F.col("distinct")
    weight = F.log((F.col("n") + SMOOTHING) / (F.col("total") + smooth)) - F.log(SMOOTHING / (F.col("largest") + smooth))
    return sized.select("language", "gram", F.round(SCALE * weight).cast("long").alias("weight"))


def detected(texts: DataFrame, key: str, text: str, profile: DataFrame) -> DataFrame:
    """(key, language, score) of each text; both null where no gram is known. Ties go to
    the language that sorts first. A language is a column here: there are a few."""
    names = sorted(r.language for r in profile.select("language").distinct().collect())
    columns = [f"w{i}" for i in range(len(names))]
    none = F.lit(None)
    if not names:
        return texts.select(key, none.cast("string").alias("language"), none.cast("long").alias("score"))
    weights = profile.groupBy("gram").agg(*[F.sum(F.when(F.col("language") == n, F.col("weight")).otherwise(0)).alias(c) for c, n in zip(columns, names, strict=True)])
    words = _word_counts(texts, text, key)
    known = words.select("word").distinct().select("word", F.explode(grams(F.col("word"))).alias("gram")).join(weights, "gram")
    scores = known.groupBy("word").agg(*[F.sum(c).alias(c) for c in columns])
    summed = words.join(scores, "word").groupBy(key).agg(*[F.sum(F.col("n") * F.col(c)).alias(c) for c in columns])
    best = F.array_min(F.array(*[F.struct((-F.col(c)).alias("minus"), F.lit(n).alias("language")) for c, n in zip(columns, names, strict=True)]))
    found = summed.select(key, best.alias("best")).filter("best.minus < 0")
    return texts.select(key).join(found, key, "left").select(key, F.col("best.language").alias("language"), (-F.col("best.minus")).alias("score"))


def configured(language: Column) -> Column:
    """The text-search configuration of a detected language."""
    chosen = F.lit("english")
    for name, configuration in CONFIGURATIONS.items():
        chosen = F.when(language == name, configuration).otherwise(chosen)
    return chosen
