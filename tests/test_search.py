"""Stems, languages, ranks and the search index against plain readings."""

from __future__ import annotations

import math
import random
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone import config, storage
from lodestone.functions import blocks, keymap, language, ranking, stemming, text
from lodestone.operators import models, retrieval, searchindex
from lodestone.plans import base, q_retrieval

# Words and stems of the published English and Russian vocabularies.
ENGLISH = """consign consign consigned consign consigning consign consignment consign consist consist consistency consist
consistently consist consolation consol consolations consol consolatory consolatori console consol consolidate consolid
consolingly consol consonant conson conspicuously conspicu conspiracy conspiraci conspirator conspir constable constabl
constancy constanc constant constant knack knack knackeries knackeri knaves knave knavish knavish kneaded knead knightly
knight knitted knit indexes index running run hopping hop hoping hope happy happi happiness happi relational relat
generalizations general generate generat generic generic communism communism community communiti sensibility sensibl
rationalization ration national nation argument argument replacement replac adoption adopt controlling control roll roll
say say cry cri by by dying die news news proceed proceed inning inning ties tie cries cri gas gas this this kiwis kiwi
gaps gap agreed agre feed feed luxuriated luxuri possibly possibl skies sky analogously analog geology geolog youth youth""".split()
RUSSIAN = """в в вавиловка вавиловк вагнера вагнер вагон вагон вагона вагон вагонов вагон вагоном вагон важная важн важнее важн
важнейшие важн важнейшими важн важничал важнича важно важн важного важн важности важност важностию важност важностью важност
вазах ваз вакханка вакханк валандался валанда валериановых валерианов валерию валер валетами валет павел павел павильонам
павильон павлиний павлин павлиньи павлин павлович павлович павлыча павлыч пагубная пагубн падает пада падай пада падал пада
падаль падал падать пада падающего пада падеж падеж падение паден паденье паден падет падет падут падут падучая падуч
падчерицей падчериц падшая падш паек паек""".split()


@pytest.mark.parametrize("word,stem", list(zip(ENGLISH[::2], ENGLISH[1::2], strict=True)))
def test_english_stems(word, stem):
    assert stemming.english(word) == stem


@pytest.mark.parametrize("word,stem", list(zip(RUSSIAN[::2], RUSSIAN[1::2], strict=True)))
def test_russian_stems(word, stem):
    assert stemming.russian(word) == stem


def test_lexemes_by_configuration(spark):
    rows = [("The Indexes of B2 running", "english"), ("Важные индексы и running the", "russian"), ("The Indexes", "simple"), (None, "english"), ("", "english"), ("the of", "english"), ("odd", None)]
    frame = spark.createDataFrame(rows, "t string, c string")
    got = [r.l for r in frame.select(text.lexemes(F.col("t"), F.col("c")).alias("l")).collect()]
    assert got == [["index", "b2", "run"], ["важн", "индекс", "run", "the"], ["the", "indexes"], None, [], [], ["odd"]]
    placed = [r.l for r in frame.limit(2).select(text.placed_lexemes(F.col("t"), F.col("c")).alias("l")).collect()]
    assert placed[0] == ["", "index", "", "b2", "run"] and placed[1][2] == ""
    found = [r.p for r in frame.select(stemming.placed_postings(text.words(F.col("t")), F.col("c")).alias("p")).collect()]
    assert [(p.lexeme, p.places) for p in found[0]] == [("b2", [4]), ("index", [2]), ("run", [5])] and found[4] == []
    many = spark.createDataFrame([("b a b A c b", "simple")], "t string, c string").select(stemming.placed_postings(text.words(F.col("t")), F.col("c")).alias("p")).first().p
    assert [(p.lexeme, p.places) for p in many] == [("a", [2, 4]), ("b", [1, 3, 6]), ("c", [5])]


def test_seeds_tell_languages_apart():
    said = {"where is the index of this table and how do I use it": "en", "как мне создать индекс и что он делает": "ru", "як мені створити індекс і що він робить": "uk", "как мога да създам индекс и какво ще прави той": "bg", "wie kann ich einen Index für die Tabelle anlegen": "de", "1234 !!": None, "": None}
    assert {t: language.detect(t) for t in said} == said
    assert language.configuration_of("что это") == "russian" and language.configuration_of("що це є") == "english" and language.configuration_of("42") == "english"


def test_trained_profiles_find_the_labels(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2
    found = language.detected(docs.filter(fold == 1), "doc_id", "text", language.profiles(docs.filter(fold == 0), "lang", "text"))
    rows = found.join(docs, "doc_id").select("language", "lang", F.length("text").alias("n")).collect()
    long = [r for r in rows if r.n > 100]
    assert len(rows) == docs.filter(fold == 1).count() and sum(r.language == r.lang for r in long) >= 0.95 * len(long)
    odd = language.detected(spark.createDataFrame([(1, None), (2, ""), (3, "12")], "k int, t string"), "k", "t", language.seed_profiles(spark))
    assert sorted((r.k, r.language, r.score) for r in odd.collect()) == [(1, None, None), (2, None, None), (3, None, None)]


def plain_rank(places):
    """Rank of {word: places} by the published formula, over every pair."""
    if len(places) == 1:
        (own,) = places.values()
        return 0.1 * sum(1 / j**2 for j in range(1, len(own) + 1)) / 1.64493406685
    left = 1.0
    for a, b in combinations(places.values(), 2):
        for p in a:
            for q in b:
                d = abs(p - q)
                near = 1 / (1.005 + 0.05 * math.exp(d / 1.5 - 2)) if d <= 100 else 1e-30
                left *= 1 - 0.1 * math.sqrt(near)
    return 1 - left


def test_ranks_equal_the_formula(spark):
    rng = random.Random(2)
    cases = [{"a": [1], "b": [2]}, {"a": [1], "b": [102]}, {"a": [1, 5, 9]}, {"a": [3]}]
    for _ in range(40):
        spots = rng.sample(range(1, 400), rng.randint(3, 60))
        words = "abcd"[: rng.randint(1, 4)]
        cases.append({w: sorted(spots[i :: len(words)]) for i, w in enumerate(words) if spots[i :: len(words)]})
    rows = [(i, len(c), sorted((p, w) for w, ps in c.items() for p in ps)) for i, c in enumerate(cases)]
    frame = spark.createDataFrame(rows, "i int, n int, hits array<struct<place:int,word:string>>")
    got = frame.select("i", ranking.ts_rank(F.col("hits"), F.col("n")).alias("r"), ranking.ts_rank(F.col("hits"), F.col("n"), 63, F.lit(50), F.lit(20)).alias("s")).collect()
    for r in got:
        want = plain_rank(cases[r.i])
        assert math.isclose(r.r, want, abs_tol=2e-9)
        divided = want / (1 + math.log(50)) / 50 / 20 / (1 + math.log2(20))
        assert math.isclose(r.s, divided / (divided + 1), abs_tol=2e-9)
    assert got[0].r > got[1].r  # near words rank above far ones


@pytest.fixture(scope="module")
def built(spark):
    rng = np.random.default_rng(5)
    middles = rng.normal(size=(12, 16))
    rows = []
    for i in range(1500):
        labels = [f"c{rng.integers(4)}" for _ in range(rng.integers(1, 5))]
        vector = (middles[rng.integers(12)] + 0.35 * rng.normal(size=16)).astype(np.float32).tolist()
        rows.append((i, f"s{i % 7}", f"word{i % 5} indexing tables {'again ' * (i % 3)}", None if i % 50 == 0 else vector, None if i % 97 == 0 else ".".join(labels), "eng", 0))
    chunks = spark.createDataFrame(rows, "id long, source string, content string, embedding array<float>, category string, language string, chunk_index int")
    path = storage.fresh(spark, "index")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # several small files
    searchindex.build(chunks, path)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    return chunks, searchindex.load(spark, path)


@pytest.mark.parametrize("wanted", ["c1", "c0.c2", "c3.c3.c3", "nowhere"])
def test_category_ranges_equal_the_predicate(built, wanted):
    chunks, index = built
    want = {r.id for r in chunks.filter(text.in_category(F.col("category"), wanted)).collect()}
    got = retrieval.eligible(index.chunks, index, None, wanted)
    assert {r.id for r in got.collect()} == want
    many = searchindex.MOST_RANGES
    try:
        searchindex.MOST_RANGES = 0  # the join beyond the bound
        assert {r.id for r in retrieval.eligible(index.chunks, index, None, wanted).collect()} == want
    finally:
        searchindex.MOST_RANGES = many


def test_a_subtree_is_a_range_of_files(spark, built):
    _, index = built
    first = index.nodes.filter("category = 'c0'").first()
    plan = index.in_category(index.chunks.select("id", "place"), "c0.c0.c0.c0")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [" in plan and "GreaterThanOrEqual(place" in plan
    files = index.chunks.select("place", F.input_file_name().alias("f")).groupBy("f").agg(F.min("place").alias("a"), F.max("place").alias("z")).collect()
    assert len(files) > 1 and any(r.a is not None and r.a > first.last for r in files)  # files that the range doesn't touch


def test_the_exact_vector_leg_equals_a_scan(built):
    chunks, index = built
    query = chunks.filter("id = 3").first().embedding
    cfg = config.SearchConfig(distance_threshold=0.4, limit_vector=50)
    held = {r.id: np.array(r.embedding, float) for r in chunks.filter("embedding is not null and source <> 's2'").collect()}
    q = np.array(query, float)
    want = sorted((round(1 - float(v @ q) / float(np.linalg.norm(v) * np.linalg.norm(q)), 6), i) for i, v in held.items())
    want = [x for x in want if x[0] <= 0.4][:50]
    active = chunks.select("source").distinct().filter("source <> 's2'")
    got = sorted((round(r.vector_distance, 6), r.id) for r in retrieval.vector_leg(index, query, cfg, active).collect())
    assert got == want and len(index.probed(query, None, 0.05)) < len(index.centroids)


def test_few_cells_hold_the_nearest(built):
    chunks, index = built
    asked = chunks.filter("id % 20 = 1 and embedding is not null").select(F.col("id").alias("query_id"), F.col("embedding").alias("query_embedding"))
    probes, recall = searchindex.calibrated(index, asked, 10)
    assert recall >= 0.95 and probes <= len(index.centroids) / 3
    true = {(r.query_id, r.id) for r in blocks.nearest(chunks.select("id", "embedding"), asked, 10).collect()}
    found = {(r.query_id, r.id) for r in searchindex.probed_nearest(index, asked, 10, probes).collect()}
    assert len(found & true) / len(true) == pytest.approx(recall)
    plan = retrieval.vector_leg(index, chunks.filter("id = 3").first().embedding, config.SearchConfig(probes=2))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "cell#" in plan.split("PartitionFilters: [")[1].split("]")[0]


def test_probed_vectors_meet_queries_in_blocks(built):
    """Pairs of a query and a vector are never rows, and what is found equals a plain scan
    of the cells."""
    chunks, index = built
    asked = chunks.filter("id % 20 = 1 and embedding is not null").select(F.col("id").alias("query_id"), F.col("embedding").alias("query_embedding"))
    found = searchindex.probed_nearest(index, asked, 10, 3)
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()
    held = [(r.cell, r.id, np.array(r.embedding, float)) for r in index.vectors.collect()]
    want = set()
    for q in asked.collect():
        v = np.array(q.query_embedding, float)
        near = set(np.argsort(-(index.centroids @ v), kind="stable")[:3].tolist())
        far = sorted((round(1 - float(e @ v) / float(np.linalg.norm(e) * np.linalg.norm(v)), 9), i) for c, i, e in held if c in near)[:10]
        want |= {(q.query_id, i) for _, i in far}
    assert {(r.query_id, r.id) for r in found.collect()} == want


def test_blocked_neighbours_keep_ties_by_id(spark):
    rng = np.random.default_rng(3)
    v = rng.integers(-2, 3, size=(3000, 3)).astype(float)  # few directions, many ties, some zeros
    vectors = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, embedding array<double>").coalesce(2)
    queries = vectors.filter("id < 40 and array_max(transform(embedding, x -> abs(x))) > 0").selectExpr("id AS query_id", "embedding AS query_embedding")
    got = {(r.query_id, r.vector_rank, r.id) for r in blocks.nearest(vectors, queries, 7, 0.5).collect()}
    want = set()
    for q in queries.collect():
        a = np.array(q.query_embedding)
        sized = [(i, x) for i, x in enumerate(v) if np.linalg.norm(x)]
        near = sorted((round(1 - float(x @ a) / float(np.linalg.norm(x) * np.linalg.norm(a)), 9) + 0.0, i) for i, x in sized)
        want |= {(q.query_id, n, i) for n, (d, i) in enumerate(near[:7], 1) if d <= 0.5}
    assert got == want and len(want) > 200


def test_many_questions_equal_one_at_a_time(spark, sf_dir):
    index, cfg = base.index(spark, sf_dir), q_retrieval.CFG
    words = [["ti", "er"], ["en"], ["er", "nowhere"], []]
    vectors = [r.embedding for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").orderBy("vec_id").limit(3).collect()] + [None]
    asked = spark.createDataFrame([(i, v, w) for i, (v, w) in enumerate(zip(vectors, words, strict=True))], "query_id long, query_embedding array<float>, query_lexemes array<string>")
    got = {(r.query_id, r.id, r.vector_rank, r.keyword_rank, r.score) for r in retrieval.search_many(index, asked, cfg).collect()}
    want = {(i, r.id, r.vector_rank, r.keyword_rank, r.score) for i, (v, w) in enumerate(zip(vectors, words, strict=True)) if v for r in retrieval.hybrid_search(index, v, w, cfg).collect()}
    assert got == want and len(got) == 15


def _shuffled(spark, run):
    """The rows of the shuffles that ``run`` writes, a number a stage."""

    def stages():
        found = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0), None)
        return {(s.stageId(), s.attemptId()): s.shuffleWriteRecords() for s in map(found.apply, range(found.size()))}

    before = stages()
    run()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    return [n for key, n in stages().items() if key not in before]


def test_many_questions_shuffle_no_posting_list(spark, sf_dir):
    """Only postings that a question's candidates can meet are shuffled, and chunks that
    are among the results."""
    index, cfg = base.index(spark, sf_dir), q_retrieval.CFG
    active = base.active_sources(spark, sf_dir)
    rare = [r.lexeme for r in index.postings.groupBy("lexeme").count().filter("count between 2 and 3").orderBy("lexeme").limit(2).collect()]
    vector = base.query_vector(spark, sf_dir)
    asked = spark.createDataFrame([(i, vector, [w, "er"]) for i, w in enumerate(rare)], "query_id long, query_embedding array<float>, query_lexemes array<string>")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as with large tables
    try:
        written = _shuffled(spark, lambda: retrieval.search_many(index, asked, cfg, active).collect())
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert max(written) < index.postings.count() / 20


def test_the_contents_of_other_chunks_are_not_shuffled(spark, sf_dir, monkeypatch):
    index, cfg = base.index(spark, sf_dir), config.SearchConfig(distance_threshold=2.0, limit=1)
    looked = []
    monkeypatch.setattr(keymap, "possible", lambda rows, keys, *on, f=keymap.possible: looked.append((rows.columns, f(rows, keys, *on), keys)) or looked[-1][1])
    asked = spark.createDataFrame([(1, "er ti")], "query_id long, question string")
    found = retrieval.search_questions(index, asked, models.embedder(), cfg).collect()
    (near, keys), = [(near, keys) for columns, near, keys in looked if "content" in columns]
    assert len(found) == keys.count() == near.count() == 1


def test_a_key_map_lets_every_key_through(spark, monkeypatch):
    rows = spark.range(5000).select("id", F.col("id").cast("string").alias("name"))
    keys = rows.filter("id % 100 = 7")
    want = {r.id for r in keys.collect()}
    got = {r.id for r in keymap.possible(rows, keys, "id", "name").collect()}
    assert want <= got and len(got) < 60 and keymap.possible(rows, keys.limit(0), "id").count() == 0
    monkeypatch.setattr(keymap, "BITS", 7)  # a map that is too small lets more through, never less
    few = {r.id for r in keymap.possible(rows, keys, "id").collect()}
    assert want <= few and len(few) > 200 and keymap.possible(rows, keys, "id").columns == ["id", "name"]


def test_an_index_of_nothing(spark):
    chunks = spark.createDataFrame([], "id long, source string, content string, embedding array<float>, category string, language string, chunk_index int")
    path = storage.fresh(spark, "index")
    searchindex.build(chunks, path)
    index = searchindex.load(spark, path)
    assert retrieval.hybrid_search(index, [1.0, 0.0], ["a"]).count() == 0 and index.nodes.count() == 0


def test_a_cluster_without_a_shared_folder_is_refused(spark, monkeypatch):
    class Away:
        conf = spark.conf

        class sparkContext:  # noqa: N801
            master = "spark://host:7077"
            _jsc = spark.sparkContext._jsc

    if spark.conf.get("spark.checkpoint.dir", None) is None and not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        with pytest.raises(RuntimeError):
            storage.shared_dir(Away)
