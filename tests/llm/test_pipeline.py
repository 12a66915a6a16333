"""The pipeline's stages against plain versions, on a small corpus."""

import pytest
import sentencepiece
from pyspark.sql import functions as F
from test_llm_dedup import plain_components, plain_left
from test_llm_filters import plain_contamination

import corpus_pipeline
from oracle import DATA
from corpusloom.llm import sentencepiece_codec


@pytest.fixture(scope="module")
def sf(spark, documents, tmp_path_factory):
    d = tmp_path_factory.mktemp("sf")
    documents.where("doc_id is not null").dropDuplicates(["doc_id"]).write.parquet(f"{d}/documents.parquet")
    text = documents.where("doc_id = 30").first().text
    spark.createDataFrame([(1, text), (2, "w1 w2 w3 w4 w5 w6 w7 w8 w9 w10 w11 w12 w13 w14")], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(40)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return str(d)


def test_stages_by_their_own_inputs(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "line dedup", "n-gram Jaccard join", "benchmark decontamination", "SentencePiece encoding"]
    clean = stages["toxicity"](spark, docs, sf)
    assert clean.columns == columns and clean.count() == docs.count()  # no label here is toxic

    lines = stages["line dedup"](spark, clean, sf)
    assert lines.columns == columns
    assert sorted(((r.doc_id, r.text) for r in lines.collect()), key=str) == plain_left([(r.doc_id, r.text) for r in clean.collect()], 20)
    got = {r.doc_id: r.text or "" for r in lines.collect()}

    unique = stages["n-gram Jaccard join"](spark, lines, sf)
    assert unique.columns == columns
    keep = {d for d, _, c in plain_components(sorted(got.items())) if d == c}
    assert {r.doc_id for r in unique.collect()} == keep

    free = stages["benchmark decontamination"](spark, unique, sf)
    assert free.columns == columns
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    own = [(r.doc_id, r.text) for r in unique.collect()]
    bad = {d for d, n, hit, _ in plain_contamination(own, items) if hit and 20 * len(hit) >= n}
    assert {r.doc_id for r in free.collect()} == keep - bad and bad

    lib = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_codec.MODEL)
    texts = {r.doc_id: r.text for r in free.collect()}
    for r in stages["SentencePiece encoding"](spark, free, sf).collect():
        assert r.ids == (None if texts[r.doc_id] is None else lib.encode(texts[r.doc_id])) and r.round_trip


def test_run_is_the_stages_in_order(spark):
    d = f"{DATA}/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, d)
    digest = lambda df: sorted((r.doc_id, r.n_tokens) for r in df.select("doc_id", F.col("n_tokens")).collect())
    assert digest(corpus_pipeline.run(spark, d)) == digest(docs)


def test_null_and_repeated_ids_and_an_empty_table(spark, documents, sf, tmp_path):
    rows = documents.unionByName(documents.where("doc_id is null or doc_id in (2, 55)")).unionByName(documents.where("doc_id = 4").withColumn("doc_id", F.lit(None).cast("long")))
    for name, docs in (("all", rows), ("none", documents.limit(0))):
        docs.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        for table in ("benchmark", "labels"):
            spark.read.parquet(f"{sf}/{table}.parquet").write.parquet(f"{tmp_path}/{name}/{table}.parquet")
    out = corpus_pipeline.run(spark, f"{tmp_path}/all").collect()
    ids = [r.doc_id for r in out]
    # the rows without an id copy 2 and 4; the other text under id 5 has nothing in common with the first
    assert None not in ids and ids.count(2) == ids.count(4) == 1 and ids.count(5) == 2
    assert all(r.round_trip for r in out) and any(r.ids is None for r in out)
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0


def test_further_columns_keep_their_values(spark, documents, sf, tmp_path):
    names = ["decoded", "n_words", "score", "predicted", "kept", "component", "home", "gone", "hit_words", "items", "h", "doc", "parity"]
    docs = documents.where("doc_id < 20").withColumns({c: F.col("doc_id") + k for k, c in enumerate(names)}).withColumns({c: F.lit(-1) for c in ("ids", "n_tokens", "round_trip")})
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    for table in ("benchmark", "labels"):
        spark.read.parquet(f"{sf}/{table}.parquet").write.parquet(f"{tmp_path}/{table}.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.columns == ["doc_id", "lang", "source", "n_chars", *names, "n_tokens", "ids", "round_trip"]
    rows = out.collect()
    assert rows and all(r[c] == r.doc_id + k for r in rows for k, c in enumerate(names)) and all(r.round_trip and r.n_tokens == len(r.ids) for r in rows)


def test_toxic_documents_go(spark):
    d = f"{DATA}/sf0.01"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    kept = corpus_pipeline.drop_toxic(spark, docs, d).select("doc_id")
    labels = spark.read.parquet(f"{d}/labels.parquet")
    rate = {r.toxic: r.k for r in labels.join(kept.withColumn("k", F.lit(1)), "doc_id", "left").groupBy("toxic").agg(F.avg(F.coalesce("k", F.lit(0))).alias("k")).collect()}
    assert rate[0] > 0.99 and rate[1] < 0.1


@pytest.mark.parametrize("name", ["op4_suffix_array_dedup", "op7_benchmark_decontamination", "op8_ngram_jaccard_join", "op9_line_dedup"])
def test_queries_match_their_sql(spark, name):
    from oracle import duck, spark_rows

    from corpusloom.llm import queries

    sf = f"{DATA}/sf0.01"
    assert spark_rows(queries.QUERIES[name](spark, sf)) == duck(sf, queries.SQL[name])
