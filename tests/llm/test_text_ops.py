"""Packing, decontamination, sharding and the byte kernels against plain readings."""

from __future__ import annotations

import random
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from lodestone.llm import bytescan, decontamination, packing, sharding
from lodestone.llm.q10_packing import tokenizer_path

SCHEMA = "doc_id long, text string, n_chars long, piece int, spare string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 1, 2, "x") for i, t in rows], SCHEMA)


def test_words_are_runs_between_white_space():
    texts = ["ab  Cd\tE\x0b\x0c f", "", "cd e\r\nab", "\n", None, "é\xa0x É"]
    body, offsets = bytescan.buffers(pa.array(texts))
    names, bounds, starts, ends = bytescan.words(body, offsets)
    got = [[bytes(body[a:b]) for a, b in zip(starts[i:j], ends[i:j], strict=True)] for i, j in zip(bounds[:-1], bounds[1:], strict=True)]
    assert got == [(t or "").encode().split() for t in texts]
    folded = [w.lower() for t in got for w in t]
    assert all((names[i] == names[j]) == (folded[i] == folded[j]) for i in range(len(names)) for j in range(len(names)))


def test_window_names_are_equal_for_equal_bytes():
    body = np.frombuffer(b"abcabcabd" * 3, np.uint8)
    names = bytescan.window_names(body, 4)
    text = bytes(body)
    assert all((names[i] == names[j]) == (text[i : i + 4] == text[j : j + 4]) for i in range(len(names)) for j in range(len(names)))


def test_ids_equal_the_tokenizer():
    enc, rng = packing.encoder(tokenizer_path()), random.Random(5)
    cases = ["", " ", "a  b", "x \n y", "it's  they'll", "<|endoftext|> hi", "tab\tx", "a　b c", "\x1c x"]
    cases += ["".join(rng.choice("ab 'se\n\t1!é　") for _ in range(rng.randint(0, 40))) for _ in range(2000)]
    for text in cases:
        assert enc.encode(text) == np.array(enc.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def test_best_fit_takes_the_fullest_bin():
    assert packing.best_fit(np.array([6, 5, 4, 3, 2]), 10) == [[0, 2], [1, 3, 4]]
    assert packing.best_fit(np.array([], np.int64), 10) == []


def test_packing_is_whole_gapless_and_tight(spark):
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choice(["the", "word", "xyzzy", "a"]) for _ in range(rng.randint(0, 90)))) for i in range(120)]
    rows += [(500, "long " * 300), (None, "null id"), (501, None), (502, ""), (3, rows[3][1])]
    got = packing.pack(frame(spark, rows), tokenizer_path(), 2, 64, block=32).collect()
    enc, bins, pieces = packing.encoder(tokenizer_path()), defaultdict(list), defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
        pieces[r.doc_id].append((r.piece, r.start, r.length, r.ids_crc32))
    for held in bins.values():
        held.sort()
        assert [o for o, _ in held] == [sum(n for _, n in held[:i]) for i in range(len(held))]
        assert sum(n for _, n in held) <= 64
    wanted = defaultdict(list)
    for i, t in rows:
        ids = enc.encode(t or "") + (2).to_bytes(4, "little")
        for p, (a, n) in enumerate(packing.cuts(len(ids) // 4, 64)):
            wanted[i].append((p, a, n, zlib.crc32(ids[4 * a : 4 * (a + n)])))
    assert {k: sorted(v) for k, v in pieces.items()} == {k: sorted(v) for k, v in wanted.items()}
    tokens = sum(r.length for r in got)
    assert len(bins) <= -(-tokens // 64) + 3
    assert packing.pack(frame(spark, []), tokenizer_path(), 2, 64).count() == 0
    assert packing.cuts(64, 64) == [(0, 64)] and packing.cuts(130, 64) == [(0, 2), (2, 64), (66, 64)]


def plain_tiles(doc, item, least):
    """Greedy tiling by trying every pair of places."""
    used_d, used_i, out = set(), set(), []
    while True:
        best = (0, 0, 0)
        for i in range(len(doc)):
            for j in range(len(item)):
                n = 0
                while i + n < len(doc) and j + n < len(item) and doc[i + n] == item[j + n] and i + n not in used_d and j + n not in used_i:
                    n += 1
                if n > best[0]:
                    best = (n, i, j)
        n, i, j = best
        if n < least:
            return out
        used_d.update(range(i, i + n))
        used_i.update(range(j, j + n))
        out.append(n)


def test_tiles_cover_as_much_as_plain_tiling():
    rng = random.Random(2)
    for _ in range(60):
        item = [rng.randint(0, 12) for _ in range(rng.randint(1, 25))]
        doc = [rng.randint(0, 12) for _ in range(rng.randint(0, 40))] + item[len(item) // 2 :] + [99] + item[: len(item) // 2]
        got = decontamination.tile(np.array(doc, np.uint64), np.array(item, np.uint64), 3)
        assert sum(n for n, *_ in got) >= sum(plain_tiles(doc, item, min(3, len(item)))) - 2
        assert max(got, default=(0,))[0] == max(plain_tiles(doc, item, min(3, len(item))), default=0)


def test_reordered_passages_are_found_and_clean_ones_left(spark):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"
    words = item.split()
    turned = " ".join(words[6:] + ["stop"] + words[:6])
    rows = [(1, f"before {item} after"), (2, turned.upper() + "!"), (3, " ".join(words[:7])), (4, None), (5, ""), (None, item), (6, "nothing here at all to see " * 50)]
    bench = spark.createDataFrame([(7, item, "x"), (8, None, "x"), (9, "", "x")], "item_id long, text string, doc_id string")
    docs = frame(spark, rows)
    got = {(r.doc_id, r.item_id): r for r in decontamination.find(docs, bench).collect()}
    assert set(got) == {(1, 7), (2, 7), (None, 7)} and got[2, 7].tiles == 2 and got[1, 7].coverage == 1.0
    assert sorted(r.doc_id for r in decontamination.clean(docs, bench).collect()) == [3, 4, 5, 6]
    assert decontamination.clean(docs, bench).columns == docs.columns
    assert decontamination.find(frame(spark, []), bench).count() == 0
    assert decontamination.find(docs, bench.limit(0)).count() == 0


def plain_fill(shards, size):
    prefs = [[(sharding.hashed(f"{s}#first") + j * (sharding.hashed(f"{s}#step") % (size - 1) + 1)) % size for j in range(size)] for s in shards]
    out, turn = {}, 0
    while len(out) < size:
        slot = next(x for x in prefs[turn] if x not in out)
        out[slot] = turn
        turn = (turn + 1) % len(shards)
    return [out[i] for i in range(size)]


def test_lookup_table(spark):
    shards = [f"s{i}" for i in range(7)]
    table = sharding.fill(shards, 101)
    assert table == plain_fill(shards, 101)
    counts = np.bincount(table)
    assert counts.max() - counts.min() <= 1
    fewer = sharding.fill(shards[:-1], 101)
    assert sum(a != b for a, b in zip(table, fewer, strict=True) if a != 6) < 40
    with pytest.raises(ValueError):
        sharding.fill(shards, 100)
    rows = spark.createDataFrame([(1, "old", "x"), (None, "old", "y"), (1, "old", "x")], "doc_id long, slot string, v string")
    got = sharding.place(rows, rows["doc_id"], shards, 101)
    assert got.columns == ["doc_id", "v", "slot", "shard"] and got.count() == 3
    assert len({(r.doc_id, r.shard) for r in got.collect()}) == 2


def test_hot_groups_are_split(spark):
    rows = spark.createDataFrame([("hot", i) for i in range(300)] + [(f"g{i % 60}", i) for i in range(300)], "g string, i long")
    got = sharding.place_groups(rows, "g", "i", ["a", "b", "c", "d"], 401)
    by = defaultdict(set)
    for r in got.collect():
        by[r.g].add(r.shard)
    assert len(by["hot"]) == 4 and all(len(v) == 1 for k, v in by.items() if k != "hot")
    assert got.count() == 600


@pytest.mark.parametrize("places", [1 << 22, 5])
def test_every_pair_that_tiling_reports_is_found(spark, monkeypatch, places):
    """Runs of 3 and 4 words alone count too: every fifth word altered, pieces shuffled."""
    monkeypatch.setattr(decontamination, "PLACES", places)
    rng = random.Random(9)
    items = [(i, [f"w{rng.randrange(60)}" for _ in range(rng.choice([1, 2, 3, 4, 20, 40]))]) for i in range(30)]
    docs = [(100, "w1 w2"), (101, None), (102, "")]
    for i, words in items:
        docs.append((i, " ".join("altered" if j % 5 == 4 else w for j, w in enumerate(words))))
        cut = [words[j : j + 4] for j in range(0, len(words), 4)]
        rng.shuffle(cut)
        docs.append((50 + i, " and so ".join(" ".join(c) for c in cut)))
    rows = [(i, " ".join(w)) for i, w in items]
    names = {w: n for n, w in enumerate(sorted({w for _, t in docs + rows for w in (t or "").split()}))}
    coded = lambda t: np.array([names[w] for w in (t or "").split()], np.uint64)
    want = set()
    for d, t in docs:
        for i, item in rows:
            tiles = decontamination.tile(coded(t), coded(item), 3)
            if sum(n for n, *_ in tiles) >= 0.8 * len(item.split()):
                want.add((d, i))
    held = decontamination.Items(rows, 3)
    got = {(docs[n][0], i) for n, i, *_ in decontamination._hits(held, pa.array([t for _, t in docs]), 3, 0.8)}
    assert got == want and {(i, i) for i, w in items if len(w) >= 20} <= want
    if places > 5:
        bench = spark.createDataFrame(rows, "item_id long, text string")
        assert {(r.doc_id, r.item_id) for r in decontamination.find(frame(spark, docs), bench).collect()} == want


def test_units_have_the_ids_of_their_text():
    """Batches of texts with every kind of boundary, against the tokenizer on each text."""
    enc, rng = packing.Encoder(tokenizer_path(), most=50), random.Random(7)
    parts = [" ", " ", "\n", "a", "é", "’", "日", "1", "'s", ".", ",", "(", "×", "ll", "\t", "　", "😀", "Ж", "\x85", "\xa0", "B"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 40))) for _ in range(1500)] + ["", "don't (x) [y] z.w,v;é.ñ,×,a×b÷.c", ".", "a."]
    body, offsets = bytescan.buffers(pa.array(texts))
    for _ in range(2):  # the second time some units are known
        ids, bounds = enc.batch(body, offsets)
        for i, text in enumerate(texts):
            assert ids[bounds[i] : bounds[i + 1]].tolist() == enc.tokenizer.encode(text, add_special_tokens=False).ids


def test_layout_types_ids_and_a_long_text(spark):
    rows = [(1, "same row"), (1, "same row"), (1, "other text"), (None, "null id"), (2, "many words here " * 700_000)]
    laid = packing.pack(frame(spark, rows), tokenizer_path(), 2, 64, keep_ids=True)
    assert dict(laid.dtypes) == {"doc_id": "bigint", "piece": "int", "start": "bigint", "length": "bigint", "ids_crc32": "bigint", "sequence_id": "bigint", "offset": "bigint", "ids": "array<bigint>"}
    got = laid.collect()
    assert len([r for r in got if r.doc_id != 2]) == 4
    assert all(len(r.ids) == r.length and zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 for r in got)
    assert sum(r.length for r in got if r.doc_id == 2) > 2_000_000


def test_no_two_bins_are_left_that_fit_together(spark):
    rng = random.Random(9)
    rows = [(i, " ".join("a" for _ in range(rng.choice([5, 20, 33, 38, 60])))) for i in range(600)]
    fills = defaultdict(int)
    for r in packing.pack(frame(spark, rows), tokenizer_path(), 2, 64, block=32).collect():
        fills[r.sequence_id] += r.length
    assert sum(f <= 32 for f in fills.values()) <= 1
