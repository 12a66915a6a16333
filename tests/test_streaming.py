"""Streams give what their batches give."""

from oracle import DATA
from pyspark.sql import functions as F

from corpusloom.sources.tables import files
from corpusloom.streaming import jobs


def _stream(spark, sf, tmp_path, name, df, mode):
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name)


def _events(spark, sf, tmp_path):
    src = tmp_path / "events"
    src.mkdir()
    (src / "e.parquet").symlink_to(f"{sf}/events.parquet")
    batch = spark.read.parquet(str(src))
    return batch, spark.readStream.schema(batch.schema).parquet(str(src))


def test_latest_state(spark, tmp_path):
    batch, stream = _events(spark, f"{DATA}/sf0.001", tmp_path)
    got = _stream(spark, None, tmp_path, "latest", jobs.latest_state(jobs.with_event_time(stream)), "complete")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, jobs.latest_state(jobs.with_event_time(batch)).collect()))


def test_window_counts(spark, tmp_path):
    batch, stream = _events(spark, f"{DATA}/sf0.001", tmp_path)
    got = _stream(spark, None, tmp_path, "counts", jobs.window_counts(jobs.with_event_time(stream)), "update")
    want = jobs.window_counts(jobs.with_event_time(batch))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_ingest_stream_twice_gives_each_chunk_once(spark, tmp_path):
    from corpusloom.operators.chunking import windows

    batch = files(spark, f"{DATA}/sf0.001").select("repo_id", "rel_path", "text")
    batch.limit(40).write.parquet(str(tmp_path / "in"))
    for _ in range(2):
        stream = spark.readStream.schema(batch.schema).parquet(str(tmp_path / "in"))
        jobs.ingest_stream(stream, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out"))
    want = windows(spark.read.parquet(str(tmp_path / "in")))
    key = [F.col("rel_path"), F.col("chunk_no").cast("long")]
    assert sorted(map(tuple, got.select(*key).collect())) == sorted(map(tuple, want.select(*key).collect()))


def test_tokens_stop_after_done(spark):
    lines = ['{"message":{"content":"a"}}', "", "oops", '{"message":{"content":""}}', '{"message":{"content":"b"},"done":true}', '{"message":{"content":"c"}}']
    df = spark.createDataFrame([(1, i, x) for i, x in enumerate(lines)], "request_id int, seq int, line string")
    assert [r.token for r in jobs.token_stream(df).orderBy("seq").collect()] == ["a", "b"]
    assert jobs.answers(jobs.token_stream(df)).first().answer == "ab"
