"""The jobs on copies of tables: growing input, reruns, batches that run again, defined cases, the command line."""

import json
import shutil
from pathlib import Path

import pytest
from oracle import DATA, duck, spark_rows
from pyspark.sql import functions as F

from corpusloom.functions import text as X
from corpusloom.plans import registry
from jobs import common, evaluate_retrieval, index_documents

SF = f"{DATA}/sf0.001"


def _rows(df, *cols):
    return sorted(map(tuple, df.select(*cols).collect()))


@pytest.fixture
def grown(spark, tmp_path):
    """(folder of the table, a function that adds a part of the documents to it)."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    at = tmp_path / "in" / "documents.parquet"

    def add(rows):
        rows.coalesce(1).write.mode("append").parquet(str(at))

    return docs, str(at), add


def test_two_runs_over_growing_input_are_one_over_all(spark, grown, tmp_path):
    docs, at, add = grown
    half = docs.where("doc_id % 2 = 0")
    add(half)
    out, ck = str(tmp_path / "out"), str(tmp_path / "ck")
    first = _rows(index_documents.run(spark, at, out, ck), "rel_path", "chunk_no", "content_hash")
    add(docs.where("doc_id % 2 = 1"))
    second = index_documents.run(spark, at, out, ck)
    log = {r.batch: r for r in spark.read.parquet(f"{out}/log").collect()}
    assert len(log) == 2 and sum(r.rows_read for r in log.values()) == docs.count() and log[0].rows_read == half.count()
    assert spark_rows(second) == duck(SF, registry.SQL["job1_index_documents"])
    assert set(first) < set(_rows(second, "rel_path", "chunk_no", "content_hash"))
    again = _rows(index_documents.run(spark, at, out, ck), *second.columns)
    assert again == _rows(second, *second.columns) and spark.read.parquet(f"{out}/log").count() == 2


def test_a_batch_that_runs_again_replaces_itself(spark, grown, tmp_path):
    docs, at, add = grown
    add(docs.where("doc_id % 2 = 0"))
    out, ck = str(tmp_path / "out"), tmp_path / "ck"
    index_documents.run(spark, at, out, str(ck))
    add(docs.where("doc_id % 2 = 1"))
    want = index_documents.run(spark, at, out, str(ck))
    want = _rows(want, *want.columns)
    # as if the second batch had been written, but its commit lost
    (ck / "commits" / "1").unlink()
    (ck / "commits" / ".1.crc").unlink(missing_ok=True)
    got = index_documents.run(spark, at, out, str(ck))
    assert _rows(got, *got.columns) == want
    assert spark.read.parquet(f"{out}/vectors").groupBy("content_hash").count().where("count > 1").count() == 0


def test_a_lost_checkpoint_embeds_nothing_twice_for_a_reader(spark, grown, tmp_path):
    docs, at, add = grown
    add(docs)
    out = str(tmp_path / "out")
    want = index_documents.run(spark, at, out, str(tmp_path / "one"))
    want = _rows(want, *want.columns)
    got = index_documents.run(spark, at, out, str(tmp_path / "two"))
    assert _rows(got, *got.columns) == want


def test_changed_files_nulls_repeats_and_empty_batches(spark, tmp_path):
    kind = "doc_id long, text string, lang string, source string, n_chars long, batch string"
    at, out, ck = str(tmp_path / "in" / "documents.parquet"), str(tmp_path / "out"), str(tmp_path / "ck")

    def run(*rows):
        spark.createDataFrame(rows, kind).coalesce(1).write.mode("append").parquet(at)
        return {(r.rel_path, r.chunk_no): r for r in index_documents.run(spark, at, out, ck).collect()}

    long = "\n".join(f"line {i}" for i in range(100))
    got = run((6, long, "en", "s", 1, "x"), (6, long, "en", "s", 1, "x"), (7, None, "en", "s", 1, "x"), (None, "no id", "en", "s", 1, "x"), (12, " \n ", "en", "s", 0, "x"), (18, "a\nb", None, None, 3, "x"))
    assert set(got) == {("s/en/doc_6.md", 0), ("s/en/doc_6.md", 1), ("s/en/doc_6.md", 2), ("unknown/unknown/doc_18.md", 0)}
    assert all(r.n_vectors == 1 for r in got.values())
    log = spark.read.parquet(f"{out}/log").first()
    assert (log.rows_read, log.left_out, log.files, log.chunks, log.embedded) == (6, 2, 3, 7, 4)
    # the file comes again, shorter, next to an unchanged one
    got = run((6, "new", "en", "s", 1, "x"), (18, "a\nb", None, None, 3, "x"))
    assert set(got) == {("s/en/doc_6.md", 0), ("unknown/unknown/doc_18.md", 0)} and got["s/en/doc_6.md", 0].end_line == 1
    assert {r.batch: r.embedded for r in spark.read.parquet(f"{out}/log").collect()} == {0: 4, 1: 1}
    # it comes again, blank: no chunk is left of it
    assert set(run((6, "  ", "en", "s", 1, "x"))) == {("unknown/unknown/doc_18.md", 0)}
    assert set(run()) == {("unknown/unknown/doc_18.md", 0)}


def test_an_empty_table(spark, tmp_path):
    at = str(tmp_path / "in" / "documents.parquet")
    spark.read.parquet(f"{SF}/documents.parquet").limit(0).write.parquet(at)
    for _ in range(2):
        out = index_documents.run(spark, at, str(tmp_path / "out"), str(tmp_path / "ck"))
        assert out.count() == 0 and "content_hash" in out.columns


def test_another_embedding_service(spark, grown, tmp_path):
    docs, at, add = grown
    add(docs.limit(5))
    index_documents.run(spark, at, str(tmp_path / "out"), str(tmp_path / "ck"), embed=lambda t: F.array(F.length(t).cast("double")))
    assert {len(r.embedding) for r in spark.read.parquet(f"{tmp_path}/out/vectors").collect()} == {1}


def test_evaluation_reruns_with_other_questions(spark, tmp_path):
    docs, bench, out = str(tmp_path / "documents.parquet"), str(tmp_path / "benchmark.parquet"), str(tmp_path / "out")
    shutil.copy(f"{SF}/documents.parquet", docs)
    rows = spark.read.parquet(f"{SF}/benchmark.parquet")
    rows.write.parquet(bench)
    first = evaluate_retrieval.run(spark, docs, bench, out)
    assert spark_rows(first) == duck(SF, registry.SQL["job2_evaluate_retrieval"])
    assert {r.measure for r in spark.read.parquet(f"{out}/summary").collect()} == {"recall@1", "recall@5", "recall@10", "mrr"}
    # all questions become unanswerable: no other outcome may be left over
    none = rows.select("item_id", F.concat(F.lit("nowhere to be found "), X.content_hash(F.col("text"))).alias("text")).unionByName(spark.createDataFrame([(None, "x"), (777, None), (778, "")], "item_id long, text string"))
    none.write.mode("overwrite").parquet(bench)
    second = evaluate_retrieval.run(spark, docs, bench, out, ks=[3])
    assert {r.outcome for r in second.collect()} == {"unanswerable"} and second.count() == rows.count() + 2


def test_evaluation_of_empty_tables(spark, tmp_path):
    docs, bench = str(tmp_path / "documents.parquet"), str(tmp_path / "benchmark.parquet")
    spark.read.parquet(f"{SF}/documents.parquet").limit(0).write.parquet(docs)
    spark.read.parquet(f"{SF}/benchmark.parquet").write.parquet(bench)
    assert {r.outcome for r in evaluate_retrieval.run(spark, docs, bench, str(tmp_path / "a")).collect()} == {"unanswerable"}


def test_configuration_and_command_line(spark, tmp_path, monkeypatch):
    for name in ("index_documents", "evaluate_retrieval"):
        file = Path(common.__file__).with_name(f"{name}.json")
        assert common.configured(spark, str(file)) == json.loads(file.read_text())
    took = {}

    def job(session, documents, output, **options):
        took.update(documents=documents, output=output, **options)
        return session.range(3)

    class Kept:  # the test's session isn't the command's to stop
        def __getattr__(self, name):
            return (lambda: None) if name == "stop" else getattr(spark, name)

    monkeypatch.setattr("corpusloom.session.session", lambda name: Kept())
    config = tmp_path / "c.json"
    config.write_text('{"ks": [2]}')
    assert common.command("x", "", ["documents", "output"], job, ["in", "out", "--config", str(config)]) == 0
    assert took == {"documents": "in", "output": "out", "ks": [2]}
