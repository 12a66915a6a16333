"""The stored index against BM25 worked out in Python, with its defined cases; the exact vector search as well."""

import hashlib
import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.operators import evaluate, vector_index, vectors
from corpusloom.operators import index as index_module
from corpusloom.operators.index import Bm25Index
from corpusloom.operators.vector_index import VectorIndex
from corpusloom.plans import retrieval

DOCS = "doc_id long, text string, repo_id string"


def plain_top(docs, question, k):
    """(key, score) of the best k, ties by key, by the formula."""
    words = {i: (t or "").lower().split() for i, t in docs}
    n, mean = len(words), sum(map(len, words.values())) / len(words)
    df = Counter(w for ws in words.values() for w in set(ws))
    raw = {w: math.log(n - c + 0.5) - math.log(c + 0.5) for w, c in df.items()}
    floor = 0.25 * sum(raw.values()) / len(raw)
    idf = {w: floor if x < 0 else x for w, x in raw.items()}
    out = []
    for i, ws in words.items():
        tf = Counter(ws)
        s = sum(idf[w] * tf[w] * 2.5 / (tf[w] + 1.5 * (0.25 + 0.75 * len(ws) / mean)) for w in question.lower().split() if w in tf)
        out.append((i, round(s, 6)))
    return sorted((r for r in out if r[1] > 0), key=lambda r: (-r[1], r[0]))[:k]


def corpus(n=300, seed=3):
    rng = random.Random(seed)
    frequent, rare = [f"the{i}" for i in range(4)], [f"Word{i}" for i in range(400)]
    return [(i, " ".join(rng.choice(frequent) if rng.random() < 0.6 else rng.choice(rare) for _ in range(rng.randint(1, 60)))) for i in range(n)]


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    rows = [(i, t, "a") for i, t in corpus()] + [(900, None, "a"), (901, " ", "a"), (None, "word1", "a"), (902, "word1", None)] + [(i, t, "b") for i, t in corpus(40, 4)]
    at = Bm25Index(spark, str(tmp_path_factory.mktemp("bm25")))
    # small blocks, so that frequent words have many
    at.add(spark.createDataFrame(rows, DOCS), block=16)
    return at


QUESTIONS = [(1, "word1 word2 the0"), (2, "the0 the1 the2 the3"), (3, "WORD7 word7 nowhere"), (4, "nowhere"), (5, ""), (6, "word3 word5 word8 word13 word21 word34 word55 word89 word144 word233 word377 the1 the2"), (7, None)]


@pytest.mark.parametrize("k", [1, 5, 50])
def test_top_k_is_the_formula_with_and_without_skipping(spark, index, k):
    asked = spark.createDataFrame(QUESTIONS, "item_id long, question string")
    docs = [*corpus(), (900, ""), (901, "")]
    for skip in (True, False):
        got = {}
        for r in index.top_k(asked, "a", k, skip=skip).collect():
            got.setdefault(r.item_id, {})[r.rank] = (r.doc_id, r.score)
        for i, q in QUESTIONS:
            own, want = [got[i][n] for n in sorted(got.get(i, {}))], plain_top(docs, q or "", k)
            assert [x for x, _ in own] == [x for x, _ in want], (i, skip)
            assert [x for _, x in own] == pytest.approx([x for _, x in want], abs=2e-6), (i, skip)


def test_blocks_are_bounded_and_sorted_by_term(spark, index):
    blocks = spark.read.parquet(f"{index.root}/postings").where("repo_id = 'a'")
    assert blocks.agg({"n": "max"}).first()[0] < 16 * 3
    assert blocks.where("term = 'the0'").count() > 5
    stats = {r.repo_id: r for r in index.stats().collect()}
    assert stats["a"].n_docs == 302 and stats["b"].n_docs == 40


def test_small_pieces_and_lists_give_the_same_index(spark, tmp_path, monkeypatch):
    """A document of more words than a piece holds, empty ones beside it, repeats of a key, and lists of one posting."""
    rows = [*corpus(50, 6), (700, "word1 " * 40 + "the0"), (701, ""), (702, "word2"), (703, None), (704, "word1 word1")]
    df = spark.createDataFrame([(i, t, "a") for i, t in rows] + [(704, "word1 word1", "b"), (704, "word1 word1", "b")], DOCS).coalesce(1)
    got = []
    for n, (piece, words, block) in enumerate([(4096, 1 << 20, 512), (3, 25, 2)]):
        monkeypatch.setattr(index_module, "PIECE", piece)
        monkeypatch.setattr(index_module, "WORDS", words)
        at = Bm25Index(spark, str(tmp_path / f"i{n}"))
        at.add(df, block=block)
        got.append(sorted(map(tuple, at.postings("a").collect())))
        assert sorted(map(tuple, at.postings("b").collect())) == [("word1", 704, 2, 2)] * 2
        blocks = spark.read.parquet(f"{at.root}/postings").where("repo_id = 'a'").selectExpr("max(n)", "count(*)").first()
        assert blocks[1] > 100 and (n == 0 or blocks[0] < 10)
    want = sorted((w, i, c, len(t.split())) for i, t in rows if t for w, c in Counter(t.lower().split()).items())
    assert got[0] == want and got[1] == want


def _plans(spark, build):
    """The number of rows that the index's Python steps give on, and what was built."""
    rows, real = [], type(spark.range(1)).mapInArrow
    with pytest.MonkeyPatch.context() as m:
        m.setattr(type(spark.range(1)), "mapInArrow", lambda self, f, schema, *a: rows.append(out := real(self, f, schema, *a)) or out)
        return build(), [r.count() for r in rows]


def test_terms_are_shuffled_by_buckets_and_frequent_ones_dealt(spark, tmp_path):
    """A row of the shuffle holds many terms, and a term of most documents lies in several buckets, each with blocks of its own."""
    rows = corpus(3000, 5)
    df = spark.createDataFrame([(i, t, "a") for i, t in rows], DOCS).repartition(6)
    at = Bm25Index(spark, str(tmp_path / "i"))
    _, given = _plans(spark, lambda: at.add(df, block=32))
    assert given == [given[0]] and given[0] <= 6 * index_module.LEAST < 400
    blocks = spark.read.parquet(f"{at.root}/postings")
    the = blocks.where("term = 'the0'").collect()
    assert len({r.block_no % index_module.LEAST for r in the}) > 2 and len({r.block_no for r in the}) == len(the) and max(r.n for r in the) == 32
    assert sum(r.n for r in the) == sum("the0" in t.split() for _, t in rows) == at.weights("a").where("term = 'the0'").first().df


def test_questions_are_added_up_where_the_documents_are(spark, tmp_path, monkeypatch):
    """Parts of few postings, keys that are strings and repeated, equal scores, and one row a share and question at most ``k`` times."""
    monkeypatch.setattr(index_module, "SHARE", 200)
    rows = [(f"k{i % 250}", t) for i, t in corpus(300, 8)] + [(f"same{i:02}", "word1 the0 the1") for i in range(40)]
    at = Bm25Index(spark, str(tmp_path / "i"))
    at.add(spark.createDataFrame([(i, t, "a") for i, t in rows], "doc_id string, text string, repo_id string"), block=8)
    asked = spark.createDataFrame(QUESTIONS, "item_id long, question string")
    far, given = _plans(spark, lambda: sorted(map(tuple, at.top_k(asked, "a", 7).collect())))
    assert far == sorted(map(tuple, at.top_k(asked, "a", 7, skip=False).collect())) and len(far) > 20
    # postings travel as lists, not as rows of their own
    assert given[0] < at.postings("a").count() / 2


def test_a_collection_that_loses_its_words_has_no_terms(spark, tmp_path):
    at = Bm25Index(spark, str(tmp_path / "i"))
    at.add(spark.createDataFrame([(1, "alpha beta", "one"), (2, "alpha", "two"), (3, "gamma", "two"), (4, "delta", "two")], DOCS))
    at.add(spark.createDataFrame([(1, " ", "one"), (2, None, "one")], DOCS))
    stats = {r.repo_id: r for r in at.stats().collect()}
    assert (stats["one"].n_docs, stats["one"].mean_len, stats["one"].n_terms) == (2, 0, 0) and stats["two"].n_terms == 3
    assert at.top_k(spark.createDataFrame([(1, "alpha")], "item_id long, question string"), "one").collect() == []


def test_collections_are_replaced_and_dropped_alone(spark, tmp_path):
    at = Bm25Index(spark, str(tmp_path / "i"))
    one = [(i, t, "one") for i, t in corpus(30)]
    at.add(spark.createDataFrame(one + [(i, t, "two") for i, t in corpus(20, 9)], DOCS))
    asked = spark.createDataFrame([(1, "word1 word2 word3 the0")], "item_id long, question string")
    before = at.top_k(asked, "one").collect()
    at.add(spark.createDataFrame([(5, "word1 other", "two"), (6, "x", "two"), (7, "y", "two")], DOCS))
    again = Bm25Index(spark, at.root)  # read anew
    assert again.top_k(asked, "one").collect() == before
    assert {r.doc_id for r in again.top_k(asked, "two").collect()} == {5}
    at.drop("two")
    assert at.top_k(asked, "two").collect() == [] and at.top_k(asked, "one").collect() == before
    with pytest.raises(Exception):  # noqa: B017  nothing was ever built there
        Bm25Index(spark, str(tmp_path / "none")).stats()


def test_one_document_and_collections_without_words(spark, tmp_path):
    at = Bm25Index(spark, str(tmp_path / "i"))
    at.add(spark.createDataFrame([(1, "alpha beta", "one"), (2, None, "blank")], DOCS))
    asked = spark.createDataFrame([(1, "alpha"), (2, "gamma")], "item_id long, question string")
    # a single document's words weigh less than nothing
    assert at.top_k(asked, "one").collect() == [] and at.top_k(asked, "blank").collect() == []
    assert at.top_k(asked, "nowhere").columns == ["item_id", "doc_id", "score", "rank"]


def test_relevant_documents_hold_the_passage(spark, tmp_path):
    docs = [(1, "xx one two three yy"), (2, "one Two three"), (3, "pone two threeq"), (4, "one two"), (5, "zone twofold"), (6, None), (7, "two")]
    passages = [(1, "one two three"), (2, "one two"), (3, "two"), (4, "absent two words here"), (5, ""), (6, None), (7, "one Two three")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    at = Bm25Index(spark, str(tmp_path / "i"))
    at.add(df.selectExpr("*", "'all' as repo_id"))
    got = evaluate.relevant(at, "all", df, spark.createDataFrame(passages, "item_id long, passage string")).collect()
    want = [(i, d) for i, p in passages if p for d, t in docs if t and p in t]
    assert sorted(map(tuple, got)) == sorted(want)


def test_candidates_of_an_answer_come_from_its_own_blocks(spark, tmp_path):
    """Blocks of words that no passage asks for don't become rows of postings."""
    df = spark.createDataFrame([(i, t + (" mid needle end" if i == 7 else "")) for i, t in corpus(200, 12)], "doc_id long, text string")
    at = Bm25Index(spark, str(tmp_path / "i"))
    at.add(df.selectExpr("*", "'all' as repo_id"), block=16)
    asked = []
    whole = at.postings
    at.postings = lambda *a: asked.append(out := whole(*a)) or out
    got = evaluate.relevant(at, "all", df, spark.createDataFrame([(1, "mid needle end"), (2, "nowhere to be found")], "item_id long, passage string")).collect()
    assert [tuple(r) for r in got] == [(1, 7)] and [p.count() for p in asked] == [1]


def test_exact_vector_search(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(60, 5))
    rows = [(f"v{i:03}", [float(x) for x in base[i % 60]]) for i in range(300)] + [("null", None), ("hole", [1.0, None, 0.0, 0.0, 0.0]), ("nan", [float("nan")] * 5), ("short", [1.0, 2.0]), ("zero", [0.0] * 5)]
    df = spark.createDataFrame(rows, "vec_id string, embedding array<double>")
    asked = df.where("vec_id in ('v000', 'v017', 'short', 'null')").withColumnRenamed("vec_id", "query_id")
    got = vectors.top_k(df, asked, k=12, limit=2).collect()
    unit = {k: np.array(v) / (np.linalg.norm(v) or 1) for k, v in rows if v is not None and None not in v and np.isfinite(v).all()}
    for q in ("v000", "v017", "short"):
        want = sorted(((-round(float(v @ unit[q]), 6) + 0.0, k) for k, v in unit.items() if len(v) == len(unit[q])))[:12]
        assert [(r.vec_id, r.score) for r in sorted((r for r in got if r.query_id == q), key=lambda r: r["rank"])] == [(k, -s + 0.0) for s, k in want]
    assert not [r for r in got if r.query_id == "null"]


def test_embedding_counts_words_slice_by_slice(spark, monkeypatch):
    """The words of a batch aren't held at once, and give the vectors of the plain rule: any white space, lower case, null and blank texts."""
    texts = [*[t for _, t in corpus(60, 11)], None, "", " \u2003\x1c ", "É\u00a0é\x1fİx STRASSE", "long " * 500]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").coalesce(1)
    monkeypatch.setattr(vectors, "SLICE", 300)
    got = {r.doc_id: r.v for r in df.select("doc_id", vectors.embed(F.col("text")).alias("v")).collect()}
    lower = {r.doc_id: r.t for r in df.selectExpr("doc_id", "lower(text) as t").collect()}
    for i in range(len(texts)):
        n = np.zeros(64)
        for w in (lower[i] or "").split():
            n[int(hashlib.md5(w.encode()).hexdigest()[:2], 16) % 64] += 1
        assert got[i] == pytest.approx(n / (np.linalg.norm(n) or 1))
    assert got[60] == got[61] == got[62] == [0.0] * 64


def test_embedding_remembers_few_words(spark, monkeypatch):
    """A memo that is emptied again and again gives the same vectors."""
    df = spark.createDataFrame(corpus(60, 11), "doc_id int, text string").coalesce(1)
    rows = lambda: {r.doc_id: r.v for r in df.select("doc_id", vectors.embed(F.col("text")).alias("v")).collect()}
    want = rows()
    monkeypatch.setattr(vectors, "MEMO", 3)
    assert rows() == want


def test_search_embeds_a_text_once(spark):
    """No filter works a text's vector out a second time; a text without a vector is left out in the task."""
    df = spark.createDataFrame([*corpus(30, 5), (99, None)], "doc_id int, text string")
    v = df.select("doc_id", vectors.embed(F.col("text")).alias("v"))
    asked = v.where("doc_id = 0").withColumnRenamed("doc_id", "item_id").localCheckpoint()
    got = vectors.top_k(v, asked, key="doc_id", vector="v", by="item_id", positive=True)
    assert got._jdf.queryExecution().optimizedPlan().toString().count("ArrowEvalPython") == 1
    assert 99 not in {r.doc_id for r in got.collect()}
    holes = df.select("doc_id", F.when(F.col("doc_id") != 7, vectors.embed(F.col("text"))).alias("v"))
    assert {r.doc_id for r in vectors.top_k(holes, asked, key="doc_id", vector="v", by="item_id").collect()} == {*range(30), 99} - {7}


def test_reranking_leaves_the_documents_in_place(spark, monkeypatch):
    """Candidates go to the documents, not documents to the candidates; too many of them meet by shuffle and give the same rows."""
    d = "/root/testdata/sf0.001"
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "-1")
    try:
        sent = retrieval.QUERIES["rerank_softmax"](spark, d)
        assert "SortMergeJoin [doc_id" not in sent._jdf.queryExecution().executedPlan().toString()
        monkeypatch.setattr(retrieval, "BROADCAST", 0)
        dealt = retrieval.QUERIES["rerank_softmax"](spark, d)
        assert "SortMergeJoin [doc_id" in dealt._jdf.queryExecution().executedPlan().toString()
        assert sorted(sent.collect()) == sorted(dealt.collect())
    finally:
        spark.conf.set(key, before)


def _clustered(n=3000, dim=16, seed=8):
    rng = np.random.default_rng(seed)
    centers = rng.normal(size=(40, dim))
    return [(i, [float(x) for x in centers[i % 40] + 0.4 * rng.normal(size=dim)]) for i in range(n)]


def test_inverted_lists_find_what_exact_search_finds(spark, tmp_path):
    rows = _clustered()
    df = spark.createDataFrame(rows + [(9001, None), (9002, [1.0]), (9003, [float("nan")] * 16), (9004, [0.0] * 16)], "vec_id long, embedding array<float>")
    at = VectorIndex(spark, str(tmp_path / "v"))
    at.build(df, sample=1500)
    assert len(at.centroids()) == 55 and spark.read.parquet(f"{at.root}/vectors").count() == len(rows) + 1
    asked = df.where("vec_id % 20 = 0 and vec_id < 9000").withColumnRenamed("vec_id", "query_id")
    exact, near = at.top_k(asked, exact=True), at.top_k(asked)
    assert exact.orderBy("query_id", "rank").collect() == vectors.top_k(df, asked).orderBy("query_id", "rank").collect()
    r = vector_index.recall(near, exact).first()
    assert r.n == 150 and r.recall >= 0.9 and at.probes() < 20
    # all lists probed and enough candidates: the same rows
    whole = at.top_k(asked, k=5, probes=55, refine=40)
    assert whole.orderBy("query_id", "rank").collect() == at.top_k(asked, k=5, exact=True).orderBy("query_id", "rank").collect()


def test_vectors_are_added_and_rebuilt(spark, tmp_path):
    rows = _clustered(400)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    at = VectorIndex(spark, str(tmp_path / "v"))
    at.build(df.where("vec_id < 300"))
    at.add(df.where("vec_id >= 300"))
    asked = df.where("vec_id in (299, 301)").withColumnRenamed("vec_id", "query_id")
    assert {(r.query_id, r.vec_id) for r in at.top_k(asked, k=1).collect()} == {(299, 299), (301, 301)}
    at.build(df.where("vec_id < 5"))
    assert {r.vec_id for r in at.top_k(asked, k=50, probes=9).collect()} == set(range(5))
    with pytest.raises(ValueError, match="no vector"):
        at.build(df.limit(0))
