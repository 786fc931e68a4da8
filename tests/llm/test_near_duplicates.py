"""Jaccard join, suffix dedup and line dedup against brute force on small corpora."""

from __future__ import annotations

import hashlib
import itertools
import random
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest

from lodestone.llm import graph, linededup, ngramjoin, suffixes

SCHEMA = "doc_id long, text string, node long, label string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 5, "x") for i, t in rows], SCHEMA)


class Sets:
    """Union-find with the least member as name."""

    def __init__(self):
        self.up = {}

    def find(self, x):
        while self.up.setdefault(x, x) != x:
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = sorted((self.find(a), self.find(b)))
        self.up[b] = a


def shingles(text, k):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def near_corpus(seed, n=60):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    base = [[rng.choice(vocabulary) for _ in range(rng.randint(1, 120))] for _ in range(n // 4)]
    out = []
    for i in range(n):
        words = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 2, 5])):
            words[rng.randrange(len(words))] = rng.choice(vocabulary)
        out.append((i * 3, " ".join(words).upper() if i % 7 == 0 else "\t".join(words)))
    return out


@pytest.mark.parametrize("k,threshold", [(3, Fraction(9, 10)), (5, Fraction(4, 5))])
def test_components_match_brute_force(spark, k, threshold):
    rows = near_corpus(k) + [(1001, None), (1002, ""), (1003, " \n"), (1004, "two words"), (1005, "Two Words"), (1006, "two"), (None, "two words"), (0, near_corpus(k)[0][1]), (1007, "long " * 3000 + "tail"), (1008, "Long " * 2500 + "tail")]
    got = ngramjoin.join(frame(spark, rows), k, threshold).collect()
    named = [(i, shingles(t, k)) for i, t in rows if i is not None]
    parts = Sets()
    for x, (i, a) in enumerate(named):
        for j, b in named[:x]:
            if a and b and len(a & b) * threshold.denominator >= len(a | b) * threshold.numerator:
                parts.join(i, j)
    assert len(got) == len(rows)
    wanted = sorted([(i, len(s), parts.find(i)) for i, s in named] + [(None, 1 if k > 2 else 0, None)], key=str)
    assert sorted([(r.doc_id, r.n_shingles, r.component_id) for r in got], key=str) == wanted


def test_groups_whose_leader_is_unlike(spark):
    """A chain: each is like its neighbours only."""
    words = [f"v{i}" for i in range(300)]
    rows = [(i, " ".join(words[i * 3 : i * 3 + 150])) for i in range(40)]
    got = {r.doc_id: r.component_id for r in ngramjoin.join(frame(spark, rows), 3, Fraction(9, 10)).collect()}
    assert set(got.values()) == {0}


def test_join_of_nothing(spark):
    assert ngramjoin.join(frame(spark, []), 3, Fraction(9, 10)).count() == 0


def test_one_document_of_each_group_stays(spark):
    text = " ".join(f"t{i}" for i in range(60))
    rows = [(5, text), (3, text + " more"), (9, "other words entirely"), (9, "other words entirely"), (None, text), (7, None)]
    kept = ngramjoin.representatives(frame(spark, rows))
    assert sorted([r.doc_id for r in kept.collect()], key=str) == [3, 7, 9, None]
    assert kept.columns == ["doc_id", "text", "node", "label"]


def test_connected_components(spark):
    rng = random.Random(4)
    edges = [(rng.randint(0, 80), rng.randint(0, 80)) for _ in range(60)] + [(i, i + 1) for i in range(200, 260)] + [(500, i) for i in range(501, 560)] + [(7, 7)]
    parts = Sets()
    for a, b in edges:
        parts.join(a, b)
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: parts.find(x) for a, b in edges if a != b for x in (a, b)}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def plain_removal(rows, length):
    seen, out = set(), {}
    for i, t in sorted(((i, t) for i, t in rows if i is not None), key=lambda r: r[0]):
        body = (t or "").encode()
        gone = np.zeros(len(body) + 1, int)
        for p in range(len(body) - length + 1):
            w = body[p : p + length]
            if w in seen:
                gone[p] += 1
                gone[p + length] -= 1
            seen.add(w)
        gone = np.cumsum(gone)[:-1] > 0
        kept = bytes(b for b, g in zip(body, gone, strict=True) if not g)
        runs = int((gone & ~np.concatenate([[False], gone[:-1]])).sum()) if len(body) else 0
        out[i] = (len(body), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest(), kept)
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_suffix_dedup_matches_brute_force(spark, seed):
    rng = random.Random(seed)
    letters = "abcdefghé \n"
    passages = ["".join(rng.choice(letters) for _ in range(rng.randint(40, 260))) for _ in range(12)]
    rows = []
    for i in range(50):
        parts = [rng.choice(passages) if rng.random() < 0.5 else "".join(rng.choice(letters) for _ in range(rng.randint(0, 150))) for _ in range(rng.randint(0, 5))]
        parts = [p[rng.randint(0, 20) :] for p in parts]
        rows.append((i * 2, "".join(parts)))
    rows += [(1001, None), (1002, ""), (1003, "ab" * 400), (1004, "a" * 1000), (1005, rows[4][1]), (1006, "x" * 99), (1007, "x" * 100), (1008, "x" * 100)]
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256, bytes(r.kept)) for r in suffixes.dedup(frame(spark, rows), 100, texts=True).collect()}
    assert got == plain_removal(rows, 100)


def test_suffix_dedup_of_odd_rows(spark):
    same = "y" * 50 + "z" * 120
    got = suffixes.dedup(frame(spark, [(None, same), (1, same), (1, same), (None, None)]), 100).collect()
    assert sorted((str(r.doc_id), r.n_removed) for r in got) == sorted([("None", 0), ("None", 0), ("1", plain_removal([(1, same)], 100)[1][1])] + [("1", plain_removal([(1, same)], 100)[1][1])])
    assert suffixes.dedup(frame(spark, []), 100).count() == 0


def levenshtein(a, b):
    """Bit-parallel: the columns of the table are the bits of two numbers."""
    if not a or not b:
        return max(len(a), len(b))
    places = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    full, top = (1 << len(a)) - 1, 1 << (len(a) - 1)
    up, down, distance = full, 0, len(a)
    for c in b:
        same = places.get(c, 0)
        level = (((same & up) + up) ^ up) | same | down
        right, left = down | ~(level | up) & full, up & level
        distance += bool(right & top) - bool(left & top)
        right = (right << 1 | 1) & full
        up, down = (left << 1 | ~((same | down) | right)) & full, right & (same | down)
    return distance


def test_distances():
    plain = [("kitten", "sitting", 3), ("", "abc", 3), ("abc", "abc", 0), ("flaw", "lawn", 2), ("ab", "ba", 2), ("intention", "execution", 5)]
    assert all(levenshtein(a, b) == levenshtein(b, a) == n for a, b, n in plain)


def test_lines(spark):
    rng = random.Random(6)
    long = " ".join(rng.choice([f"q{i}" for i in range(500)]) for _ in range(90))
    near = long.replace(long.split()[40], "changed", 1)
    far = " ".join(reversed(long.split()))
    rows = [
        (1, f"{long}\nonly here\n\nshared line"),
        (2, f"Shared  LINE!\n***\n{near}\nown"),
        (3, f"shared line\n\n***\n{far}"),
        (4, None),
        (5, ""),
        (None, "own\nnull row"),
        (6, "again\nagain\nx"),
        (6, "again\nagain\nx"),
    ]
    found = linededup.dedup(frame(spark, rows), 0.8)
    assert found.columns == ["doc_id", "text", "node", "label", "n_lines", "n_removed"]
    got = sorted([(r.doc_id, r.text) for r in found.collect()], key=str)
    second = "***"  # near has one word of 90 changed
    wanted = [(1, f"{long}\nonly here\n\nshared line"), (2, second), (3, f"\n***\n{far}"), (4, None), (5, ""), (None, "own\nnull row"), (6, "again\nx"), (6, "again\nx")]
    assert got == sorted(wanted, key=str)
    assert linededup.dedup(frame(spark, []), 0.8).count() == 0


def typing_errors(rng, words, n):
    """n of the words with one character changed, added or taken out each."""
    out = list(words)
    for i in rng.sample(range(len(out)), n):
        w, at = out[i], rng.randrange(len(out[i]))
        out[i] = rng.choice([w[:at] + rng.choice("abcdefgh") + w[at + 1 :], w[:at] + rng.choice("abcdefgh") + w[at:], w[:at] + w[at + 1 :] or "z"])
    return out


def test_recall_of_near_lines(spark):
    """Against brute force: of all pairs of lines with edit similarity 0.8 by characters,
    short and medium ones included, at least 90 in 100 are in one group, and lines that
    no chain of such pairs connects are never."""
    rng = random.Random(12)
    vocabulary = ["".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(2, 9))) for _ in range(300)]
    lines = set()
    for n in [2, 3, 4, 5, 6, 8, 10, 12, 15, 20, 25, 28] * 5:
        base = [rng.choice(vocabulary) for _ in range(n)]
        other = list(base)
        other[rng.randrange(n)] = rng.choice(vocabulary)
        lines |= {" ".join(w) for w in (base, other, typing_errors(rng, base, 1), typing_errors(rng, base, max(1, n // 10)), typing_errors(rng, base, max(1, n // 5)))}
    text = dict(enumerate(sorted(lines)))
    got = {r.key: r.group for r in linededup.groups(spark.createDataFrame(list(text.items()), "key long, norm string"), 0.8).collect()}
    parts, near = Sets(), []
    for a, x in text.items():
        for b, y in text.items():
            longer = max(len(x), len(y))
            if a < b and abs(len(x) - len(y)) <= 0.2 * longer and levenshtein(x, y) <= longer * 0.2 + 1e-9:
                near.append((a, b))
                parts.join(a, b)
    assert len(near) > 300
    assert sum(a in got and got[a] == got.get(b) for a, b in near) >= 0.9 * len(near)
    assert all(parts.find(k) == parts.find(g) for k, g in got.items())


def test_long_lines_are_measured_by_characters(spark):
    rng = random.Random(3)
    words = ["".join(rng.choice("etaoinshrdlu") for _ in range(9)) for _ in range(40)]
    typos = [w[:4] + "x" + w[5:] if i % 4 == 0 and i < 40 else w for i, w in enumerate(words)]  # similarity 0.97
    token = [*words[:39], "y" * 200]  # one word apart, below 0.8
    rows = [(1, " ".join(words)), (2, " ".join(typos)), (3, " ".join(token))]
    texts = spark.createDataFrame(rows, "key long, norm string")
    pairs = spark.createDataFrame([(1, 2), (1, 3)], "a long, b long")
    assert {r.b: r.like for r in linededup._alike(pairs, texts, 0.8).collect()} == {2: True, 3: False}
    found = linededup.dedup(frame(spark, [(1, rows[0][1]), (2, rows[2][1])]), 0.8)
    assert {r.doc_id: r.n_removed for r in found.collect()} == {1: 0, 2: 0}


def test_rows_that_share_an_id_are_told_apart(spark):
    a, b = "a b c d e f g", "p q r s t u v"
    rows = [(5, a), (5, b), (3, a), (5, b), (None, a)]
    got = ngramjoin.join(frame(spark, rows), 3, Fraction(9, 10)).collect()
    assert sorted([(r.doc_id, r.component_id) for r in got], key=str) == sorted([(5, 3), (5, 5), (3, 3), (5, 5), (None, None)], key=str)
    kept = ngramjoin.representatives(frame(spark, rows), 3, Fraction(9, 10)).collect()
    assert sorted([(r.doc_id, r.text) for r in kept], key=str) == sorted([(5, b), (3, a), (None, a)], key=str)


def test_long_words_of_two_letters_have_names_of_their_own():
    word, other = "a", "b"
    for _ in range(10):
        word, other = word + other, other + word
    sets = list(ngramjoin.document_sets(pa.array([f"x {word} y", f"x {other} y", f"x {word.upper()} y"]), 3))
    assert sets[0].tolist() != sets[1].tolist() and sets[0].tolist() == sets[2].tolist()


def test_pigeonhole_of_blocks():
    """Any SURE places of a signature hold a whole block, and no two blocks share two."""
    blocks = [{(n + i) % linededup.PLACES for i in linededup.BLOCK} for n in range(linededup.PLACES)]
    assert all(any(b <= set(c) for b in blocks) for c in itertools.combinations(range(linededup.PLACES), linededup.SURE))
    assert not all(any(b <= set(c) for b in blocks) for c in itertools.combinations(range(linededup.PLACES), linededup.SURE - 1))
    assert all(len(x & y) <= 1 for x, y in itertools.combinations(blocks, 2))


@pytest.mark.parametrize("n,changed", [(6, 1), (10, 1), (29, 1), (60, 1), (30, 3), (60, 6)])
def test_recall_of_lines_with_changed_words(spark, n, changed):
    """300 pairs each; at least 90 in 100 of those with edit similarity 0.8 are linked."""
    rng = random.Random(n)
    word = lambda: "".join(rng.choice("etaoinshrdlucmfw") for _ in range(rng.randint(3, 9)))
    rows, pairs = [], []
    for i in range(300):
        base = [word() for _ in range(n)]
        other = list(base)
        for j in rng.sample(range(n), changed):
            other[j] = word()
        x, y = " ".join(base), " ".join(other)
        rows += [(2 * i, x), (2 * i + 1, y)]
        if levenshtein(x, y) <= 0.2 * max(len(x), len(y)) + 1e-9:
            pairs.append((2 * i, 2 * i + 1))
    got = {r.key: r.group for r in linededup.groups(spark.createDataFrame(rows, "key long, norm string"), 0.8).collect()}
    assert len(pairs) > 100
    assert sum(a in got and got[a] == got.get(b) for a, b in pairs) >= 0.9 * len(pairs)
    assert all(k // 2 == g // 2 for k, g in got.items())


def test_lines_with_clashing_names_and_a_long_line(spark):
    long = " ".join(f"w{i % 9973}" for i in range(60_000))
    rows = [(1, "some line here\nother line", "mine", 3, "f"), (2, "Some line, here!\n" + long, "mine", 4, "g"), (3, long.replace("w77 ", "w78 "), "mine", 5, "h"), (None, None, None, None, None)]
    found = linededup.dedup(spark.createDataFrame(rows, "doc_id long, text string, _row string, key int, gone string"), 0.8)
    assert found.columns == ["doc_id", "text", "_row", "key", "gone", "n_lines", "n_removed"]
    got = {r.doc_id: r for r in found.collect()}
    assert (got[1].text, got[1]._row, got[1].key, got[1].gone, got[1].n_removed) == ("some line here\nother line", "mine", 3, "f", 0)
    assert got[2].text == long and got[3].text == "" and got[3].n_removed == 1
    assert got[None].text is None


@pytest.mark.parametrize("rare", [0, 1, 2])
def test_one_typing_error_in_lines_of_frequent_words(spark, rare):
    """Every word of the vocabulary is frequent; an error makes one that is seen once."""
    rng = random.Random(rare)
    vocabulary = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(3, 9))) for _ in range(300)]
    lines, pairs = [], []
    for i in range(4000):
        words = [rng.choice(vocabulary) for _ in range(14)]
        for j in range(rare):
            words[rng.randrange(14)] = f"only{i}x{j}"
        lines.append((i, " ".join(words)))
        if i < 300:
            at = rng.choice([k for k, w in enumerate(words) if not w.startswith("only")])
            w = words[at]
            k = rng.randrange(len(w))
            words[at] = w[:k] + rng.choice("0123456789") + w[k + 1 :]
            lines.append((10_000 + i, " ".join(words)))
            pairs.append((i, 10_000 + i))
    frame = spark.createDataFrame(lines, "key long, norm string")
    assert linededup.frequent(frame).count() >= 250
    got = {r.key: r.group for r in linededup.groups(frame, 0.8).collect()}
    found = sum(a in got and got[a] == got.get(b) for a, b in pairs)
    print("linked", found)
    assert found >= 0.9 * len(pairs)
    assert len(got) <= 2 * len(pairs)  # lines without a copy are linked with nothing
