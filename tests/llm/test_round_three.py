"""Filter audit, vector near duplicates and fill-in-the-middle against brute force."""

from __future__ import annotations

import hashlib
import itertools
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.llm import filteraudit, fillmiddle, q11_filter_audit, smallworld, vectordedup

# ---- filter audit -----------------------------------------------------------------


def mask_counts(seed, filters=5):
    rng = random.Random(seed)
    out = {}
    for m in range(1 << filters):
        if rng.random() < 0.7:
            n = rng.randint(1, 50)
            out[m] = (n, rng.randint(0, n), rng.randint(0, n))
    return out


def replay(letters, counts):
    """Every order applied document by document."""
    removed_in = {}
    for order in itertools.permutations(range(len(letters))):
        left = dict(counts)
        for step, i in enumerate(order, 1):
            gone = {m: c for m, c in left.items() if m >> i & 1}
            left = {m: c for m, c in left.items() if not m >> i & 1}
            fails = sum(c[0] for m, c in counts.items() if m >> i & 1)
            removed = sum(c[0] for c in gone.values())
            alone = counts.get(1 << i, (0, 0, 0))[0]
            removed_in[order, step] = (sum(c[0] for c in left.values()), removed, fails - removed, alone, sum(c[1] for c in gone.values()), sum(c[2] for c in gone.values()), i)
    shapley = [sum(v[1] for v in removed_in.values() if v[6] == i) for i in range(len(letters))]
    return {("".join(letters[j] for j in order), step): (*v[:6], shapley[v[6]]) for (order, step), v in removed_in.items()}


@pytest.mark.parametrize("seed,letters", [(1, "ABCDE"), (2, "ABCDE"), (3, "ABC"), (4, "A")])
def test_polynomials_equal_a_replay_of_every_order(seed, letters):
    counts = mask_counts(seed, len(letters))
    got = {(r["filter_order"], r["step"]): tuple(r[c] for c in filteraudit.COUNTS) for r in filteraudit.audit_rows("p", letters, counts)}
    assert got == replay(letters, counts)
    assert len(got) == math.factorial(len(letters)) * len(letters)


def failed(rows):
    """The masks of the query's filters, row by row."""
    out = []
    for doc_id, text, _ in rows:
        t = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        bits = [len(words) < 100, 100 * len(set(words)) < 80 * len(words), 100 * len(re.findall("[A-Z]", t)) > 10 * len(t), bool(re.search(r"[#$%&*|]", t))]
        bits.append(doc_id is not None and any(i is not None and i < doc_id and (x or "") == t for i, x, _ in rows))
        out.append(sum(b << i for i, b in enumerate(bits)))
    return out


def test_masks_of_nulls_copies_and_repeated_rows(spark, tmp_path):
    long = " ".join(f"w{i}" for i in range(150))
    rows = [(5, long, "en"), (9, long, "en"), (9, long, "en"), (2, long, None), (1, None, "en"), (3, "", "en"), (4, "AB#", ""), (None, long, "en"), (7, "x " * 20_000, "de"), (8, " A b" * 300, "de"), (2, long, None)]
    docs = spark.createDataFrame([(*r, 1, "x", "y") for r in rows], "doc_id long, text string, lang string, n long, part string, mask string")
    labels = spark.createDataFrame([(5, 1, 0), (9, 1, 1), (9, 0, 0), (None, 1, 1), (77, 1, 1)], "doc_id long, quality int, toxic int")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    got = {(r["part"], r["filter_order"], r["step"]): tuple(r[c] for c in filteraudit.COUNTS) for r in q11_filter_audit.op11_filter_audit(spark, str(tmp_path)).collect()}
    want, good, toxic = {}, {5, 9}, {9}
    for (i, _, lang), m in zip(rows, failed(rows), strict=True):
        c = want.setdefault(lang or "", {}).setdefault(m, [0, 0, 0])
        c[0], c[1], c[2] = c[0] + 1, c[1] + (i in good), c[2] + (i in toxic)
    assert got == {(p, *k): v for p, counts in want.items() for k, v in replay("ABCDE", counts).items()}


def test_an_empty_table_has_no_audit(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert q11_filter_audit.op11_filter_audit(spark, str(tmp_path)).count() == 0


# ---- vectors ----------------------------------------------------------------------


def clustered(seed, groups, noise, lone, width=16):
    rng = np.random.default_rng(seed)
    out = []
    for n in groups:
        base = rng.normal(size=width)
        base /= np.linalg.norm(base)
        out += [base + rng.normal(size=width) * noise / math.sqrt(width) for _ in range(n)]
    out += list(rng.normal(size=(lone, width)))
    return [v.astype(np.float32).astype(float).tolist() for v in rng.permutation(np.array(out))]


def brute(rows, least=0.93):
    """(links, component) of (id, vector, label) rows."""
    good = [i for i, (k, v, lab) in enumerate(rows) if k is not None and lab is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    links, up = [0] * len(rows), {r[0]: r[0] for r in rows}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    unit = {i: np.array(rows[i][1]) / np.linalg.norm(rows[i][1]) for i in good}
    for a, b in itertools.combinations(good, 2):
        if rows[a][2] == rows[b][2] and len(unit[a]) == len(unit[b]) and float(unit[a] @ unit[b]) >= least:
            links[a], links[b] = links[a] + 1, links[b] + 1
            x, y = sorted((root(rows[a][0]), root(rows[b][0])))
            up[y] = x
    return [(k, links[i], None if k is None else root(k)) for i, (k, _, _) in enumerate(rows)]


@pytest.mark.parametrize("noise,shard_rows", [(0.05, 16_384), (0.2, 40), (0.33, 60), (0.4, 16_384)])
def test_links_equal_brute_force(spark, noise, shard_rows):
    """Tight groups are balls, loose ones cross them: beams widen and members are verified."""
    vectors = clustered(7, [60, 25, 9, 2, 2], noise, 120)
    rows = [(i * 3, v, i % 2) for i, v in enumerate(vectors)]
    got = vectordedup.dedup(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"), shard_rows=shard_rows, recall=0.99).collect()
    want = {k: (n, c) for k, n, c in brute(rows)}
    assert len(got) == len(rows) and all(r.audit_recall >= 0.99 for r in got)
    linked = [r for r in got if want[r.vec_id][0]]
    assert sum((r.n_links, r.component_id) == want[r.vec_id] for r in linked) >= 0.97 * len(linked)
    assert all(r.n_links <= want[r.vec_id][0] and r.kept == (r.component_id == r.vec_id) for r in got)


def test_vectors_of_every_odd_kind(spark):
    e = [1.0, 0.0, 0.0]
    near = [math.cos(0.3), math.sin(0.3), 0.0]
    rows = [(1, e, 1), (2, e, 1), (2, e, 1), (3, e, 2), (4, e, None), (None, e, 1), (5, None, 1), (6, [], 1), (7, [0.0, 0.0, 0.0], 1), (8, [None, 1.0, 0.0], 1), (9, [float("nan"), 1.0, 0.0], 1), (10, [float("inf"), 0.0, 0.0], 1), (11, [1.0, 0.0], 1), (12, near, 1), (13, [3e-30, 0.0, 0.0], 1), (14, [-0.0, 1.0, -0.0], 1), (15, [0.0, 1.0, 0.0], 1)]
    frame = spark.createDataFrame([(*r, 5, "x", True) for r in rows], "vec_id long, embedding array<double>, label int, n_links long, total string, kept boolean")
    got = vectordedup.dedup(frame, recall=1.0)
    assert got.columns == ["vec_id", "embedding", "label", "total", "n_links", "component_id", "kept", "audit_beam", "audit_recall"]
    key = lambda r: tuple((x is None, x) for x in r)
    held = sorted(((r.vec_id, r.n_links, r.component_id) for r in got.collect()), key=key)
    assert held == sorted(brute(rows), key=key)
    assert vectordedup.dedup(frame.limit(0)).count() == 0


def test_a_graph_finds_the_nearest(spark):
    rng = np.random.default_rng(3)
    vectors = smallworld.unit(rng.normal(size=(1500, 24)))
    level = smallworld.levels(np.arange(1500), 12)
    order = np.argsort(-level, kind="stable")
    vectors = vectors[order]
    world, of_node, node_of = smallworld.build(vectors, level[order], ball=0.999)
    assert len(of_node) == 1500 and (of_node[node_of] == np.arange(1500)).all() and len(world.tables) > 1
    asked = smallworld.unit(rng.normal(size=(200, 24)))
    ids, sims = world.nearest(asked.astype(np.float32), 64)
    assert (np.diff(sims, axis=1) <= 0).all()
    assert (ids[:, 0] == (asked @ vectors[of_node].T).argmax(axis=1)).mean() >= 0.95


# ---- fill in the middle -----------------------------------------------------------


def cut_by(pattern, text):
    return re.findall(pattern, text)


@pytest.mark.parametrize("grammar,pattern", [(fillmiddle.LINES, r"[^\n]*\n|[^\n]+"), (fillmiddle.SINGLE, r"[\s\S]"), (fillmiddle.WORDS, r"[ \t\n\r\f\v]+|[^ \t\n\r\f\v]+"), (fillmiddle.Runs("a-z", "0-9"), r"[a-z]+|[0-9]+|[\s\S]"), (fillmiddle.Ended(".!?"), r"[^.!?]*[.!?]|[^.!?]+")])
def test_split_equals_matching(spark, grammar, pattern):
    rng = random.Random(5)
    texts = ["", "\n", "\n\n", "a\n", "\na", "a b  c\n\nd", "12ab--34", "😀é\n😀 x", "a😀b", "end. x!? y"] + ["".join(rng.choice("ab1 \n.!😀é") for _ in range(rng.randint(1, 60))) for _ in range(80)]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", fillmiddle.units(F.col("t"), grammar).alias("u")).collect()
    assert [r.u for r in rows] == [cut_by(pattern, r.t) for r in rows]


def example(doc_id, text, fim=100, spm=50):
    h = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * i : 8 * i + 8], 16) for i in range(4))
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    n = len(units)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= fim:
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    return (n, "spm", p, m, f"<S>{s}<P>{p}<M>{m}") if h4 % 100 < spm else (n, "psm", p, m, f"<P>{p}<S>{s}<M>{m}")


@pytest.mark.parametrize("fim,spm", [(100, 50), (60, 0), (0, 50)])
def test_examples_and_their_way_back(spark, fim, spm):
    texts = [None, "", "one", "a\nb\nc\n", "\n\n\n", "has <P> in it\nx", "< P>\nM>", "<\n<M\nS>\n", "😀\n" * 7 + "é", "line of words\n" * 50_000, "x" * 1_000_000]
    rows = [(i, t) for i, t in enumerate(texts * 3)] + [(None, "a\nb"), (0, "a\nb"), (0, "a\nb")]
    frame = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, fim int")
    made = fillmiddle.transform(frame, "doc_id", "text", fim_percent=fim, spm_percent=spm)
    assert made.columns == ["doc_id", "text", "fim"]
    for r in made.select("doc_id", "text", "fim", fillmiddle.restored(F.col("fim.output"), F.col("fim.form")).alias("back")).collect():
        assert (r.fim.n, r.fim.form, r.fim.prefix, r.fim.middle, r.fim.output) == example(r.doc_id, r.text, fim, spm)
        assert r.back == (r.text or "")
    assert fillmiddle.transform(frame.limit(0), "doc_id", "text").count() == 0


# ---- twins ------------------------------------------------------------------------


@pytest.mark.parametrize("name", ["op3_warc", "op5_ngram_jaccard_join", "op11_filter_audit", "op13_fill_in_middle"])
def test_queries_equal_their_twins(spark, sf_dir, name):
    import duckdb

    from lodestone.llm import catalog

    con = duckdb.connect()
    for table in ("documents", "labels", "pages"):
        con.execute(f"CREATE VIEW {table} AS FROM '{sf_dir}/{table}.parquet'")
    frame, twin = catalog.QUERIES[name](spark, sf_dir), con.sql(catalog.ORACLES[name])
    columns = sorted(frame.columns)
    assert columns == sorted(twin.columns)
    at = [twin.columns.index(c) for c in columns]
    assert sorted(map(str, ([r[c] for c in columns] for r in frame.collect()))) == sorted(map(str, ([r[i] for i in at] for r in twin.fetchall())))
