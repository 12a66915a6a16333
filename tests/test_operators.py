"""Operators on small fixtures: window edges, caps, probes, fusion, trims, trees, intents, definitions."""

import json
import random

import pytest
from pyspark.sql import functions as F

from corpusloom import config
from corpusloom.functions import text as X
from corpusloom.operators import bm25, catalog, chunking, evaluate, fusion, intent, manifest, prompt, vectors
from corpusloom.sources import files as S


@pytest.mark.parametrize("n", [1, 45, 46, 60, 61, 90, 91, 200])
def test_windows_at_their_edges(spark, n):
    df = spark.createDataFrame([("a.md", "\n".join(f"l{i}" for i in range(n)))], "rel_path string, text string")
    got = [(r.start_line, r.end_line) for r in chunking.windows(df).orderBy("chunk_no").collect()]
    assert got == [(i + 1, min(i + 60, n)) for i in range(0, n, 45)]


def test_blank_windows_do_not_count_toward_caps(spark):
    text = "\n".join([""] * 60 + ["x"] * 200)
    df = spark.createDataFrame([("a.html", text), ("b", None), ("c", "")], "rel_path string, text string")
    got = chunking.windows(df, caps=[2]).orderBy("chunk_no").collect()
    assert [(r.rel_path, r.start_line) for r in got] == [("a.html", 46), ("a.html", 91)]


def test_window_caps_by_kind(spark):
    names = ["a.py", "b.md", "README", "c.html", "d.foo", "e.jinja2"]
    got = spark.createDataFrame([(x,) for x in names], "p string").select(chunking.window_cap(F.col("p")).alias("c"))
    assert [r.c for r in got.collect()] == [40, 0, 0, 20, 20, 20]


def test_language_of_names(spark):
    want = {"x/a.py": "python", "x/.env": None, "x/prod.env": "plaintext", "Dockerfile": "plaintext", "README": "markdown", "a.ipynb": "notebook", "m.R": "plaintext", "a.foo": None}
    got = spark.createDataFrame([(x,) for x in want], "p string").select("p", S.language(F.col("p")).alias("l")).collect()
    assert {r.p: r.l for r in got} == want


def test_pruned_paths(spark):
    want = {"build": True, "a/node_modules/x.js": True, "a/buildings/x.js": False, ".git/config": True}
    got = spark.createDataFrame([(x,) for x in want], "p string").select("p", S.is_pruned(F.col("p")).alias("x")).collect()
    assert {r.p: r.x for r in got} == want


def test_text_probe(spark):
    rows = [(b"", True), (b"abc\n", True), (b"a\x00b", False), ("é".encode(), True), (b"\xff" + b"a" * 99, True), (b"\xff\xfe\xfd" * 9 + b"a", False), (b"\x10\x00", False), (b"\x01\x02abcdefgh", True), ("é" * 5000).encode() and (b"a" + "é".encode() * 5000, False)]
    got = spark.createDataFrame([(i, bytearray(b)) for i, (b, _) in enumerate(rows)], "i int, b binary").select("i", S.is_text(F.col("b")).alias("t")).orderBy("i").collect()
    assert [r.t for r in got] == [w for _, w in rows]


def test_capped_read_replaces_bad_bytes(spark):
    text, cut = S.read_capped(F.col("b"), 4)
    r = spark.createDataFrame([(bytearray(b"ab\xffcd"),)], "b binary").select(text.alias("t"), cut.alias("c")).first()
    assert (r.t, r.c) == ("ab�c", True)


def test_notebook_cells_and_long_cells(spark):
    rows = [(1, 1, "markdown", " hi "), (1, 2, "raw", "x"), (1, 3, "code", "a\nb"), (1, 4, "code", " \n "), (1, 5, "code", "\n".join("x" * 60 for _ in range(100)))]
    df = spark.createDataFrame(rows, "nb int, n int, k string, t string")
    got = chunking.notebook_cells(df, "t", F.col("k"), F.col("n"), ["nb"]).orderBy("cell_no", "end_line").collect()
    assert [(r.symbol_name, r.start_line, r.end_line) for r in got] == [("cell_1_markdown", 1, 1), ("cell_3_code", 3, 4), ("cell_5_code", 5, 14), ("cell_5_code", 5, 59), ("cell_5_code", 5, 64)]


def test_definitions_of_python():
    source = '"""é"""\nimport x\n\n@dec\ndef f():\n    return 1\n\nclass A:\n    y = 1\n    def m(self):\n        pass\n\nif __name__ == "__main__":\n    f()\n'
    got = [(c[0], c[1], c[2], c[3]) for c in chunking.code_chunks_of(source, "python")]
    assert got == [("decorated_definition", "f", 4, 6), ("function_definition", "m", 10, 11), ("main_guard", "__main__", 13, 14)]
    assert chunking.code_chunks_of("def f(:\n" * 3, "python")[0][0] == "sliding_window"
    long = "def f():\n" + "\n".join(f"    x{i} = {i} * 1000" for i in range(200))
    assert [c[2:4] for c in chunking.code_chunks_of(long, "python")][:2] == [(1, 60), (46, 105)]
    with pytest.raises(ValueError):
        chunking.code_chunks_of("x", "cobol")


def test_definitions_in_braces():
    js = 'class A {\n  m() { return "}"; }\n}\nfunction f(a) {\n  // }\n  return a\n}\nconst g = (x) => {\n  return x\n}\n'
    assert [(c[0], c[1], c[2], c[3]) for c in chunking.code_chunks_of(js, "javascript")] == [("function_declaration", "f", 4, 7), ("arrow_function", "g", 8, 10)]
    go = "func (r *T) M(a int) int {\n return 1\n}\nfunc F() {\n}\n"
    assert [(c[0], c[1]) for c in chunking.code_chunks_of(go, "go")] == [("method_declaration", "M"), ("function_declaration", "F")]
    rust = "impl T for U {\n fn a() {}\n}\nfn b() {\n}\n"
    assert [(c[0], c[1]) for c in chunking.code_chunks_of(rust, "rust")] == [("function_item", "a"), ("function_item", "b")]


def test_rrf_adds_up_repeats_and_keeps_first_seen(spark):
    s = "item_id int, doc_id string, rank int, score double"
    dense = spark.createDataFrame([(1, "a", 1, 0.9), (1, "b", 2, 0.8), (1, "b", 3, 0.7)], s)
    sparse = spark.createDataFrame([(1, "c", 1, 5.0), (1, "a", 2, 4.0)], s)
    got = fusion.rrf(dense, sparse).orderBy("rank").collect()
    assert [r.doc_id for r in got] == ["a", "b", "c"]
    assert got[1].rrf_score == pytest.approx(1 / 62 + 1 / 63)
    assert got[2].dense_score == 0.0
    assert [r.doc_id for r in fusion.shortcut(fusion.rrf(dense, sparse)).orderBy("rank").collect()] == ["a", "b", "c"]


def test_softmax(spark):
    df = spark.createDataFrame([(1, i, i + 1, x) for i, x in enumerate([1.0, 4.0, 2.0, 5.0, 3.0])] + [(2, 9, 1, -10.0)], "item_id int, doc_id int, rank int, l double")
    got = fusion.rerank(df, F.col("l")).orderBy("item_id", "rank").collect()
    assert [r.doc_id for r in got] == [3, 1, 4, 2, 0, 9]
    assert sum(r.score for r in got[:5]) == pytest.approx(1, abs=1e-5) and got[5].score == 1.0


def test_bm25_of_one_unrelated_document(spark):
    docs = spark.createDataFrame([(0, "alpha beta")], "doc_id int, text string")
    asked = spark.createDataFrame([(0, "gamma")], "item_id int, question string")
    assert bm25.top_k(docs, asked).count() == 0


def test_bm25_ranks_the_match_first(spark):
    docs = spark.createDataFrame([(0, "authenticate user with password"), (1, "render the page"), (2, "parse a file"), (3, "open a socket")], "doc_id int, text string")
    asked = spark.createDataFrame([(0, "authenticate user password")], "item_id int, question string")
    assert bm25.top_k(docs, asked).first().doc_id == 0


def test_greedy_trim_equals_a_loop(spark):
    rng = random.Random(5)
    groups = {i: [rng.randint(1, 400) for _ in range(12)] for i in range(20)}
    df = spark.createDataFrame([(i, k + 1, t) for i, ts in groups.items() for k, t in enumerate(ts)], "item_id int, rank long, t long")
    want = set()
    for i, ts in groups.items():
        total, new = 0, 0
        for k, t in enumerate(ts):
            if total + t <= config.PROMPT_BUDGET:
                total, new = total + t, new + 1
                want.add((i, k + 1, new))
    assert {tuple(r) for r in prompt.trim_greedy(df, "t").collect()} == want
    first = spark.createDataFrame([(1, 1, 900), (1, 2, 1)], "item_id int, rank long, t long")
    assert [r["rank"] for r in prompt.trim_prefix(first, "t").collect()] == [1]


@pytest.mark.parametrize(("scores", "size", "want"), [([0.05, 0.02], None, False), ([0.05, 0.30], None, True), ([0.01], 13, True), ([0.10], None, True), ([None], None, False)])
def test_guardrail(spark, scores, size, want):
    df = spark.createDataFrame([(1, s, 0.0, "snippet") for s in scores], "item_id int, score double, dense_score double, chunk_type string")
    assert prompt.sufficient(df, corpus_size=size).first().sufficient is want


def test_tree_puts_directories_first(spark):
    paths = ["a/b.py", "a-b/c.py", "a.py", "a/z/q.py", "a/c.py"]
    df = spark.createDataFrame([("r", p) for p in paths], "repo_id string, path string")
    assert manifest.tree_text(df, ["repo_id"]).first().text == "a-b/\n  c.py\na/\n  z/\n    q.py\n  b.py\n  c.py\na.py"
    assert manifest.folder_text(df, "nope").first().text == "(No indexed files under nope/)"
    assert manifest.folder_text(df, "A/").first().text == "A/\nz/\n  q.py\nb.py\nc.py"


def test_intents(spark):
    rows = {"what is in the backend folder?": (True, "backend"), "file structure": (True, None), "explain config.json": (False, None), "whare are inside the backend folder": (True, "backend"), "what is in readme": (False, None), "how does login work": (False, None), "what's in the repo": (True, None)}
    df = spark.createDataFrame([(q,) for q in rows], "q string").select("q", intent.is_structure(F.col("q")).alias("s"), intent.folder_prefix(F.col("q")).alias("f"))
    got = {r.q: (r.s, r.f) for r in df.collect()}
    assert {q: got[q][0] for q in rows} == {q: s for q, (s, _) in rows.items()}
    assert all(got[q][1] == f for q, (s, f) in rows.items() if s)


def test_target_files(spark):
    paths = spark.createDataFrame([(p,) for p in ["src/app.py", "lib/app.py", "README.md", "conf/config.json", "readme"]], "rel_path string")
    asked = spark.createDataFrame([(q,) for q in ["open APP.py", "see src/app.py", "config.json file", "the readme", "nothing.py", "README.md"]], "question string")
    got = {r.question: r.target for r in intent.target_files(asked, paths).collect()}
    assert got == {"open APP.py": "src/app.py", "see src/app.py": "src/app.py", "config.json file": "conf/config.json", "the readme": "readme", "README.md": "README.md"}


def test_vectors(spark):
    v = spark.createDataFrame([(0, [3.0, 4.0]), (1, [0.0, 0.0]), (2, [4.0, 3.0]), (3, None)], "vec_id int, embedding array<float>")
    assert [tuple(r) for r in vectors.validate(v, 2).orderBy("vec_id").collect()] == [(0, 2, True), (1, 2, True), (2, 2, True), (3, 0, False)]
    q = v.where("vec_id = 0").withColumnRenamed("vec_id", "query_id")
    assert [r.vec_id for r in vectors.top_k(v, q, 2).orderBy("rank").collect()] == [0, 2]
    many = v.where("vec_id < 3").withColumnRenamed("vec_id", "query_id")
    whole, parts = vectors.top_k(v, many, 2), vectors.top_k(v, many, 2, limit=2)
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, parts.collect()))


def test_quality_measures(spark):
    res = spark.createDataFrame([(1, "a", 3), (2, "b", 1)], "item_id int, doc_id string, rank long")
    rel = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "item_id int, doc_id string")
    first = evaluate.first_hits(res, rel)
    assert {r.k: r.recall for r in evaluate.recall(first, [1, 5]).collect()} == {1: pytest.approx(1 / 3, abs=1e-6), 5: pytest.approx(2 / 3, abs=1e-6)}
    assert evaluate.mrr(first).first().mrr == pytest.approx((1 / 3 + 1) / 3, abs=1e-6)
    r = spark.createDataFrame([("The Cat", ["cat", "dog"]), ("x", [])], "a string, k array<string>").select(X.keyword_rate(F.col("a"), F.col("k")).alias("r")).collect()
    assert [x.r for x in r] == [0.5, 1.0]


def test_repo_ids_and_caps(spark):
    u = spark.createDataFrame([(" https://github.com/a/b.git ",), ("https://github.com/a/b/",)], "u string").select(X.normalize_url(F.col("u")).alias("n"))
    assert {r.n for r in u.collect()} == {"https://github.com/a/b"}
    chunks = spark.createDataFrame([("r", f"f{i}", k) for i in range(5) for k in range(2)], "repo_id string, rel_path string, chunk_no int")
    got = catalog.total_cap(chunks, 6)
    assert got.count() == 6 and got.select("rel_path").distinct().count() == 3


R1, R2 = "0000000a", "0000000b"


def test_engine_round_trip(spark, tmp_path):
    from corpusloom.engine import Engine

    nb = json.dumps({"cells": [{"cell_type": "markdown", "source": ["# T\n", "x"]}, {"cell_type": "raw", "source": "no"}, {"cell_type": "code", "source": "print(1)"}]})
    files = [(R1, "src/app.py", b"def login(user):\n    return user\n\ndef logout():\n    return None\n"), (R1, "README.md", b"# Demo\nlogin and logout"), (R1, "n.ipynb", nb.encode()), (R1, "x.png", b"\x89PNG"), (R2, "a.txt", b"other")]
    df = spark.createDataFrame([(a, b, bytearray(c)) for a, b, c in files], "repo_id string, rel_path string, content binary")
    e = Engine(spark, str(tmp_path))
    got = {r.repo_id: (r.files_indexed, r.files_skipped, r.chunks_indexed) for r in e.ingest(df).collect()}
    assert got == {R1: (3, 1, 6), R2: (1, 0, 2)}
    q = spark.createDataFrame([(1, "what does src/app.py do"), (2, "list files"), (3, "how to login")], "item_id int, question string")
    routes = {r.item_id: r.route for r in e.retrieve(R1, q).collect()}
    assert routes == {1: "file", 2: "structure", 3: "whole"}
    answers = {r.item_id: r for r in e.query(R1, q).collect()}
    assert all(a.sufficient for a in answers.values()) and "def login" in answers[1].answer
    more = spark.createDataFrame([(4, "hello!"), (5, "how to login")], "item_id int, question string")
    said = {r.item_id: r for r in e.query(R1, more).collect()}
    assert not said[4].sufficient and said[4].prompt is None and said[4].answer.startswith("Hello") and said[5].sufficient
    e.ingest(df.where(F.col("repo_id") == R2))
    assert {r.repo_id for r in e.list_repos().collect()} == {R1, R2}
    e.delete_repo(R2)
    assert [r.repo_id for r in e.list_repos().collect()] == [R1] and e.health()["status"] == "ok"
    with pytest.raises(KeyError):
        e.delete_repo(R2)


def test_judging(spark):
    a = spark.createDataFrame([(1, "yes")], "item_id int, answer string")
    c = spark.createDataFrame([(1, i, f"{i}" * 500) for i in range(1, 10)], "item_id int, rank int, text string")
    p = evaluate.judge_prompts(a, c).first().prompt
    assert p.count("---") == 7 and "9" not in p and "1" * 400 in p and "1" * 401 not in p
    v = spark.createDataFrame([(" Faithful ",), ("unfaithful",), ("faithful.",), (None,)], "r string").select(evaluate.verdict(F.col("r")).alias("v"))
    assert [r.v for r in v.collect()] == [True, False, False, None]


def test_sources_that_exhaust_the_parser_and_unclosed_braces():
    deep = "(" * 5000 + ")" * 5000
    assert chunking.code_chunks_of(deep, "python")[0][0] == "sliding_window"
    open_ended = "func A() {\n  x{\n}\n}\nfunc B() {\n  y\n"
    assert [(c[1], c[2]) for c in chunking.code_chunks_of(open_ended, "go")] == [("A", 1), ("B", 5)]
    many = "\n".join(f"func F{i}() {{" for i in range(3000))
    assert chunking.code_chunks_of(many, "go")[0][1] == "F0"


def test_engine_cache_index_and_log(spark, tmp_path):
    from corpusloom.engine import Engine

    body = lambda i: "\n".join(f"word{i} line {n} of file {i}" for n in range(70)).encode()
    df = spark.createDataFrame([(R1, f"docs/f{i:02}.md", bytearray(body(i))) for i in range(40)] + [(R2, "a.txt", bytearray(b"other"))], "repo_id string, rel_path string, content binary")
    asked = []

    def embed(text):
        asked.append(1)
        return vectors.embed(text)

    e = Engine(spark, str(tmp_path), embed=embed)
    first = {r.repo_id: r.chunks_indexed for r in e.ingest(df, job="one").collect()}
    vectors_stored = spark.read.parquet(f"{tmp_path}/cache").count()
    assert first == {R1: 81, R2: 2} and vectors_stored == 83 == e.chunks().where("embedding is not null").count()
    # the same again: every text is in the cache
    e.ingest(df, job="two")
    assert spark.read.parquet(f"{tmp_path}/cache").count() == vectors_stored
    log = {(r.job_id, r.phase, r.progress): r for r in e.job_log().collect()}
    assert log["one", "embedding", 0.9].rows == 83 and log["two", "embedding", 0.9].rows == 0 and log["one", "bm25", 1.0].rows_per_second > 0
    assert e.job_status("two")["status"] == "completed" and [r.phase for r in e.job_events("one").orderBy("at").collect()][::2] == ["chunking", "embedding", "bm25", "done"]
    assert e.job_events("none").first().event == "not_found"
    with pytest.raises(KeyError):
        e.job_status("none")
    # another model has vectors of its own
    Engine(spark, str(tmp_path), model="other").ingest(df.where(F.col("repo_id") == R2))
    assert spark.read.parquet(f"{tmp_path}/cache").count() == vectors_stored + 2
    q = spark.createDataFrame([(1, "word7 word7 file"), (2, "file structure")], "item_id int, question string")
    got = e.retrieve(R1, q).where("item_id = 1").orderBy("rank").collect()
    assert {r.route for r in got} == {"full"} and got[0].rel_path == "docs/f07.md"
    prompt_ = {r.item_id: r.prompt for r in e.query(R1, q).collect()}[2]
    assert "Repository file index:\nRepository file index — searchable text files (40 total):\ndocs/" in prompt_ and "[Chunk" not in prompt_
    with pytest.raises(ValueError):
        e.delete_repo("../x")
    e.delete_repo(R2)
    assert {r.repo_id for r in e.index.stats().collect()} == {R1}


def test_a_stopped_ingest_keeps_the_old_collection_and_is_logged(spark, tmp_path):
    from corpusloom.engine import Engine

    df = spark.createDataFrame([(R1, "a.md", bytearray(b"one")), (R2, "b.md", bytearray(b"two"))], "repo_id string, rel_path string, content binary")
    e = Engine(spark, str(tmp_path))
    e.ingest(df)
    before = sorted(r.chunk_id for r in e.chunks().collect())
    broken = Engine(spark, str(tmp_path), embed=lambda t: F.raise_error(F.lit("no service")).cast("array<double>"), model="down")
    with pytest.raises(Exception, match="no service"):
        broken.ingest(df, job="bad")
    assert sorted(r.chunk_id for r in e.chunks().collect()) == before and e.job_status("bad")["status"] == "failed"
    assert [p.name for p in (tmp_path / "staged").iterdir() if not p.name.startswith(".")] == []


def test_manifests_tell_truncated_and_skipped_files(spark):
    paths = spark.createDataFrame([("r", "a/b.py"), ("r", "c.md")], "repo_id string, path string")
    skipped = spark.createDataFrame([("r", "  x/ — 2 file(s) (2 .png)"), ("s", "  y/ — 1 file(s) (1 .so)"), ("t", "")], "repo_id string, summary string")
    cut = spark.createDataFrame([("r", "c.md"), ("r", "a/b.py"), ("r", "c.md")], "repo_id string, path string")
    got = {r.repo_id: r.text for r in manifest.manifest_chunks(paths, skipped=skipped, truncated=cut).collect()}
    assert got["r"] == "Repository file index — searchable text files (2 total):\na/\n  b.py\nc.md\n\nPartially indexed (first 2 file(s) truncated to size limit):\n  a/b.py\n  c.md\n\nExcluded from search (binary/non-text — on disk only):\n  x/ — 2 file(s) (2 .png)"
    assert got["s"] == "Repository file index — searchable text files (0 total):\n(no searchable files)\n\nExcluded from search (binary/non-text — on disk only):\n  y/ — 1 file(s) (1 .so)"
    assert set(got) == {"r", "s"}


def test_notebooks_of_all_kinds(spark):
    books = [("n1", json.dumps({"cells": [{"cell_type": "code", "source": "[1, 2]"}, {"cell_type": "markdown", "source": ["a\n", "b"]}, "odd", {"cell_type": "code", "source": 5}, {"cell_type": "code"}, {"cell_type": "raw", "source": "x"}, {"cell_type": "code", "source": " \n"}, {"cell_type": "code", "source": "é"}]})), ("n2", "not json"), ("n3", "[1]"), ("n4", '{"cells": 3}'), ("n5", None), ("n6", json.dumps({"cells": [{"cell_type": "code", "source": f"x{i}"} for i in range(120)]}))]
    df = spark.createDataFrame([("r", p, t) for p, t in books], "repo_id string, rel_path string, text string")
    got = chunking.notebook_chunks(df).collect()
    assert sorted((r.symbol_name, r.text) for r in got if r.rel_path == "n1") == [("cell_1_code", "[1, 2]"), ("cell_2_markdown", "a\nb"), ("cell_8_code", "é")]
    assert {r.rel_path for r in got} == {"n1", "n6"} and sum(r.rel_path == "n6" for r in got) == 100


def test_golden_sets(spark, tmp_path):
    from corpusloom.sources.golden import read_golden

    (tmp_path / "a.json").write_text(json.dumps([{"question": "q1", "expected_file": "f.py", "match_mode": "file", "answer_keywords": ["a", "b"], "min_chunks_in_context": 2}, {"question": "q2", "expected_symbol": "s"}, {"expected_file": "no question"}]))
    (tmp_path / "b.json").write_text("no json")
    got = {r.question: r for r in read_golden(spark, str(tmp_path)).collect()}
    assert set(got) == {"q1", "q2"} and got["q1"].answer_keywords == ["a", "b"] and got["q1"].min_chunks_in_context == 2
    assert (got["q2"].expected_file, got["q2"].match_mode, got["q2"].answer_keywords) == ("", "either", []) and len({r.item_id for r in got.values()}) == 2


def test_vocabulary_counts_are_plain_merges(spark):
    import base64

    import regex

    from corpusloom.functions import vocabulary

    path = "/opt/tokenizers/byte_bpe_50k.tiktoken"
    ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in open(path, "rb"))}

    def merged(piece):
        parts = [bytes([b]) for b in piece]
        while len(parts) > 1:
            best = min(range(len(parts) - 1), key=lambda i: ranks.get(parts[i] + parts[i + 1], 1 << 60))
            if parts[best] + parts[best + 1] not in ranks:
                break
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        return len(parts)

    texts = ["", None, "hello world's 123  end", "<|endoftext|>", "naïve ß 日本語 😀\n\n\ttabs", *(r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(20).collect())]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", vocabulary.counter(spark, path)(F.col("t")).alias("n"))
    want = {i: None if t is None else sum(merged(p.encode()) for p in regex.findall(vocabulary.PATTERN, t)) for i, t in enumerate(texts)}
    assert {r.i: r.n for r in df.collect()} == want
