"""Lexemes of full-text search: stop words and the published Snowball stemmers.

A stemmer is a fixed order of suffix tables. At each step the longest suffix of the table
that the word ends with is looked up, and its rule applies or the step does nothing.
Regions of a word (after the first vowel, after the first consonant behind a vowel) say
how far left a suffix may begin.

Words are stemmed in Arrow batches, each distinct word of a batch once.
"""

from __future__ import annotations

import functools
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

# The stop words of the two languages' published lists.
STOP_WORDS = {
    "english": frozenset(
        """i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its
        itself they them their theirs themselves what which who whom this that these those am is are was were be been being have has
        had having do does did doing a an the and but if or because as until while of at by for with about against between into
        through during before after above below to from up down in out on off over under again further then once here there when
        where why how all any both each few more most other some such no nor not only own same so than too very s t can will just
        don should now""".split()
    ),
    "russian": frozenset(
        """и в во не что он на я с со как а то все она так его но да ты к у же вы за бы по только ее мне было вот от меня еще нет о
        из ему теперь когда даже ну вдруг ли если уже или ни быть был него до вас нибудь опять уж вам ведь там потом себя ничего ей
        может они тут где есть надо ней для мы тебя их чем была сам чтоб без будто чего раз тоже себе под будет ж тогда кто этот
        того потому этого какой совсем ним здесь этом один почти мой тем чтобы нее сейчас были куда зачем всех никогда можно при
        наконец два об другой хоть после над больше тот через эти нас про всего них какая много разве три эту моя впрочем хорошо
        свою этой перед иногда лучше чуть том нельзя такой им более всегда конечно всю между""".split()
    ),
    "simple": frozenset(),
}

# The rules of the published English stemmer.
WHOLE = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl"} | {w: w for w in ("sky", "news", "howe", "atlas", "cosmos", "bias", "andes")}
AFTER_PLURAL = frozenset("inning outing canning herring earring proceed exceed succeed".split())
LONG_PREFIXES = ("gener", "commun", "arsen")
DOUBLES = frozenset("bb dd ff gg mm nn pp rr tt".split())
LI_ENDS = "cdeghkmnrt"
STEP_2 = {
    "tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize", "ization": "ize", "ational": "ate", "ation": "ate", "ator": "ate", "alism": "al", "aliti": "al", "alli": "al", "fulness": "ful",
    "ousli": "ous", "ousness": "ous", "iveness": "ive", "iviti": "ive", "biliti": "ble", "bli": "ble", "ogi": "og", "fulli": "ful", "lessli": "less", "li": "",
}
STEP_3 = {"tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": "", "ative": ""}
STEP_4 = dict.fromkeys("al ance ence er ic able ible ant ement ment ent ism ate iti ous ive ize ion".split(), "")

# The endings of the published Russian stemmer. Those of AFTER_A stand
# behind one of two letters only.
AFTER_A = "ая"
GERUND = {**dict.fromkeys("в вши вшись".split(), AFTER_A), **dict.fromkeys("ив ивши ившись ыв ывши ывшись".split(), "")}
ADJECTIVE = dict.fromkeys("ее ие ые ое ими ыми ей ий ый ой ем им ым ом его ого ему ому их ых ую юю ая яя ою ею".split(), "")
PARTICIPLE = {**dict.fromkeys("ем нн вш ющ щ".split(), AFTER_A), **dict.fromkeys("ивш ывш ующ".split(), "")}
REFLEXIVE = dict.fromkeys("ся сь".split(), "")
VERB = {**dict.fromkeys("ла на ете йте ли й л ем н ло но ет ют ны ть ешь нно".split(), AFTER_A), **dict.fromkeys("ила ыла ена ейте уйте ите или ыли ей уй ил ыл им ым ен ило ыло ено ят ует уют ит ыт ены ить ыть ишь ую ю".split(), "")}
NOUN = dict.fromkeys("а ев ов ие ье е иями ями ами еи ии и ией ей ой ий й иям ям ием ем ам ом о у ах иях ях ы ь ию ью ю ия ья я".split(), "")
DERIVED = dict.fromkeys("ост ость".split(), "")
SUPERLATIVE = dict.fromkeys("ейш ейше".split(), "")

_REGION = {"english": re.compile("[^aeiouy]*[aeiouy]+[^aeiouy]"), "russian": re.compile("[^аеиоуыэюя]*[аеиоуыэюя]+[^аеиоуыэюя]")}
_SHORT = re.compile("(?:.*[^aeiouy])?[aeiouy][^aeiouywxY]|[aeiouy][^aeiouy]")
_VOWEL = re.compile("[aeiouy]")
_FIRST_VOWEL = re.compile("[^аеиоуыэюя]*[аеиоуыэюя]")
_LETTERS = re.compile(r"[^\W\d_]+")


def _ending(word: str, table, least: int = 0) -> str:
    """The longest suffix in a table that begins at ``least`` or later; empty if none."""
    for size in range(min(max(map(len, table)), len(word) - least), 0, -1):
        if word[-size:] in table:
            return word[-size:]
    return ""


def _regions(word: str, language: str) -> tuple[int, int]:
    """Where R1 and R2 begin."""
    r1 = next((len(p) for p in LONG_PREFIXES if language == "english" and word.startswith(p)), 0)
    if not r1:
        found = _REGION[language].match(word)
        r1 = found.end() if found else len(word)
    found = _REGION[language].match(word, r1)
    return r1, found.end() if found else len(word)


def _short_end(word: str) -> bool:
    return bool(_SHORT.fullmatch(word))


def _without_plural(w: str) -> str:
    match _ending(w, ("sses", "ied", "ies", "us", "ss", "s")):
        case "sses":
            return w[:-2]
        case "ied" | "ies":
            return w[:-2] if len(w) > 4 else w[:-1]
        case "s" if _VOWEL.search(w[:-2]):
            return w[:-1]
    return w


def _without_tense(w: str, r1: int) -> str:
    end = _ending(w, ("eed", "eedly", "ed", "edly", "ing", "ingly"))
    if end.startswith("eed"):
        return w[: len(w) - len(end)] + "ee" if len(w) - len(end) >= r1 else w
    left = w[: len(w) - len(end)]
    if not end or not _VOWEL.search(left):
        return w
    if left.endswith(("at", "bl", "iz")):
        return left + "e"
    if left[-2:] in DOUBLES:
        return left[:-1]
    return left + "e" if len(left) == r1 and _short_end(left) else left


def _replaced(w: str, table: dict[str, str], region: int, allowed=lambda end, left: True) -> str:
    end = _ending(w, table)
    left = w[: len(w) - len(end)]
    return left + table[end] if end and len(left) >= region and allowed(end, left) else w


def english(word: str) -> str:
    if len(word) <= 2:
        return word
    if word in WHOLE:
        return WHOLE[word]
    w = re.sub("([aeiouy])y", r"\1Y", "Y" + word[1:] if word[0] == "y" else word)
    r1, r2 = _regions(w, "english")
    w = _without_plural(w)
    if w in AFTER_PLURAL:
        return w
    w = _without_tense(w, r1)
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in "aeiouy":
        w = w[:-1] + "i"
    w = _replaced(w, STEP_2, r1, lambda end, left: {"ogi": left.endswith("l"), "li": left[-1:] in tuple(LI_ENDS)}.get(end, True))
    w = _replaced(w, STEP_3, r1, lambda end, left: end != "ative" or len(left) >= r2)
    w = _replaced(w, STEP_4, r2, lambda end, left: end != "ion" or left.endswith(("s", "t")))
    left = w[:-1]
    if w.endswith("e") and (len(left) >= r2 or len(left) >= r1 and not _short_end(left)) or w.endswith("ll") and len(left) >= r2:
        w = left
    return w.replace("Y", "y")


def _cut(w: str, table: dict[str, str], least: int) -> str | None:
    """w without its ending; None if it has none, or the letter before it isn't there."""
    end = _ending(w, table, least)
    left = w[: len(w) - len(end)]
    if not end or table[end] and (len(left) <= least or left[-1] not in table[end]):
        return None
    return left


def russian(word: str) -> str:
    w = word.replace("ё", "е")
    found = _FIRST_VOWEL.match(w)
    rv, r2 = found.end() if found else len(w), _regions(w, "russian")[1]
    if (done := _cut(w, GERUND, rv)) is None:
        w = w if (base := _cut(w, REFLEXIVE, rv)) is None else base
        if (done := _cut(w, ADJECTIVE, rv)) is not None:
            done = done if (base := _cut(done, PARTICIPLE, rv)) is None else base
        elif (done := _cut(w, VERB, rv)) is None:
            done = _cut(w, NOUN, rv)
    w = w if done is None else done
    if len(w) > rv and w.endswith("и"):
        w = w[:-1]
    w = w if (done := _cut(w, DERIVED, max(rv, r2))) is None else done
    w = w if (done := _cut(w, SUPERLATIVE, rv)) is None else done
    if w.endswith("нн") and len(w) - 2 >= rv:
        return w[:-1]
    return w[:-1] if len(w) > rv and w.endswith("ь") else w


@functools.lru_cache(maxsize=1 << 18)
def lexeme(word: str, configuration: str) -> str:
    """A small-letter word as a lexeme; empty for a stop word. Words with digits stay as
    they are, and ASCII words are stemmed as English in the Russian configuration too."""
    if word in STOP_WORDS[configuration]:
        return ""
    if configuration == "simple" or not _LETTERS.fullmatch(word):
        return word
    return russian(word) if configuration == "russian" and not word.isascii() else english(word)


def lexemes_of(words: pa.Array, configurations: pa.Array) -> pa.Array:
    """Lists of words as lists of lexemes, each distinct word of a batch looked up once."""
    lists = pc.list_value_length(words).fill_null(0)
    offsets = pa.array([0]).to_pylist() + pc.cumulative_sum(lists).to_pylist()
    flat = words.flatten().dictionary_encode()
    held, codes = flat.dictionary.to_pylist(), flat.indices
    sizes = lists.to_numpy(zero_copy_only=False)
    names = configurations.dictionary_encode()
    of_row = names.indices.fill_null(-1).to_numpy(zero_copy_only=False)
    kinds = [k if k in STOP_WORDS else "simple" for k in names.dictionary.to_pylist()] + ["simple"]
    table = pa.array([lexeme(w, k) for k in kinds for w in held], pa.string())
    shift = (of_row % len(kinds)).repeat(sizes) * len(held)
    values = table.take(pa.array(codes.to_numpy(zero_copy_only=False) + shift))
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values, mask=words.is_null())


def placed_lexemes(words: Column, configuration: Column) -> Column:
    """Words as lexemes at the same places, stop words as empty texts."""
    stem = F.arrow_udf(lexemes_of, "array<string>")
    return stem(words, configuration)


def postings_of(words: pa.Array, configurations: pa.Array) -> pa.Array:
    """Lists of words as lists of (lexeme, its places from 1), sorted by lexeme. A place is
    that of the word in its text, stop words included."""
    placed = lexemes_of(words, configurations)
    sizes = pc.list_value_length(placed).fill_null(0).to_numpy(zero_copy_only=False)
    flat = placed.flatten()
    row = np.repeat(np.arange(len(sizes)), sizes)
    place = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + 1
    kept = np.flatnonzero(pc.not_equal(flat, "").to_numpy(zero_copy_only=False))
    coded = flat.take(pa.array(kept)).dictionary_encode()
    rank = np.argsort(np.argsort(np.array(coded.dictionary.to_pylist(), dtype=object))) if len(coded.dictionary) else np.zeros(0, int)
    code = rank[coded.indices.to_numpy(zero_copy_only=False)] if len(kept) else np.zeros(0, int)
    order = np.lexsort((place[kept], code, row[kept]))
    r, c = row[kept][order], code[order]
    first = np.flatnonzero(np.concatenate([[True], (r[1:] != r[:-1]) | (c[1:] != c[:-1])])) if len(r) else np.zeros(0, int)
    names = coded.dictionary.take(pa.array(np.argsort(rank)[c[first]] if len(r) else [], pa.int64()))
    lists = pa.ListArray.from_arrays(pa.array(np.append(first, len(r)), pa.int32()), pa.array(place[kept][order], pa.int32()))
    per_row = np.concatenate([[0], np.cumsum(np.bincount(r[first], minlength=len(sizes)))])
    return pa.ListArray.from_arrays(pa.array(per_row, pa.int32()), pa.StructArray.from_arrays([names.cast(pa.string()), lists], ["lexeme", "places"]))


def placed_postings(words: Column, configuration: Column) -> Column:
    """The inverted text: array<struct<lexeme, places>> sorted by lexeme."""
    invert = F.arrow_udf(postings_of, "array<struct<lexeme:string,places:array<int>>>")
    return invert(words, configuration)
