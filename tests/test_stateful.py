"""Keyed state against the batch forms: late and repeated rows, silent jobs, restarts from the checkpoint."""

import datetime

import pytest
from oracle import DATA
from pyspark.sql import Window
from pyspark.sql import functions as F

from corpusloom.streaming import jobs, stateful


def _all(path, spark, schema):
    return sorted(map(tuple, spark.read.schema(schema).parquet(path).select(*[x.split()[0] for x in schema.split(", ")]).collect()), key=str)


def _rows(df, schema):
    return sorted(map(tuple, df.select(*[x.split()[0] for x in schema.split(", ")]).collect()), key=str)


@pytest.fixture(scope="module")
def events(spark):
    e = jobs.with_event_time(spark.read.parquet(f"{DATA}/sf0.001/events.parquet")).select("event_id", "ts", "user_id", "event_type", "value")
    return e.where("user_id % 5 = 0").persist()


def _parts(spark, events, folder):
    """Three files by time, in which each row may be up to an hour late, with rows that come twice, and a last one far ahead."""
    lo, hi = events.agg(F.unix_seconds(F.min("ts")), F.unix_seconds(F.max("ts"))).first()
    late = F.unix_seconds("ts") + F.pmod(F.xxhash64("event_id"), F.lit(3600))
    part = F.least(F.floor((late - lo) * 3 / (hi - lo + 1)), F.lit(2)).cast("int")
    split = events.withColumn("p", part)
    again = split.where("event_id % 4 = 0").withColumn("p", F.least(F.col("p") + (F.col("event_id") % 8 == 0).cast("int"), F.lit(2)))
    rows = split.unionByName(again)

    def put(p):
        rows.where(F.col("p") == p).drop("p").coalesce(1).write.mode("append").parquet(folder)

    def end():
        spark.createDataFrame([(-1, datetime.datetime(2199, 1, 1), -1, "click", 0.0)], events.schema).coalesce(1).write.mode("append").parquet(folder)

    return put, end


@pytest.mark.parametrize("kind", ["jobs", "limits"])
def test_streams_of_events_are_their_batches(spark, events, tmp_path, kind):
    folder, out, ck = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "ck")
    put, end = _parts(spark, events, folder)
    schema = stateful.HISTORY if kind == "jobs" else stateful.LIMITED
    build = (lambda s: stateful.job_history_stream(s, 6 * 3600)) if kind == "jobs" else (lambda s: stateful.limited_stream(s, 1, 86_400))
    seen = 0
    for step in range(4):
        put(step) if step < 3 else end()
        stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(folder)
        stateful.start(build(stream), out, ck).awaitTermination()  # each time from the checkpoint
        now = len(_all(out, spark, schema)) if step else 0
        assert now >= seen
        seen = now
    got = [r for r in _all(out, spark, schema) if r[0] != -1]
    if kind == "jobs":
        want = _rows(stateful.job_history(events, 6 * 3600), schema)
        assert any(r[1] is None for r in want) and any(r[4] is False for r in want)
    else:
        w = jobs.limited(events, 1, "24 hours").join(events.select("event_id", F.unix_micros("ts").alias("at")), "event_id")
        want = _rows(w, schema)
        assert {r[3] for r in want} == {True, False}
    assert got == want


def test_batch_history_refuses_while_a_job_runs(spark):
    t = lambda h: datetime.datetime(2024, 1, 1, h)
    rows = [(1, t(0), 7, "click"), (2, t(1), 7, "view"), (3, t(2), 7, "purchase"), (4, t(3), 7, "click"), (5, t(9), 7, "click"), (6, t(10), 7, "error")]
    df = jobs.with_event_time(spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string"))
    got = {(r.event_id, r.status): r.accepted for r in stateful.job_history(df, 3 * 3600).collect()}
    assert got == {(1, "running"): True, (2, "running"): False, (3, "completed"): False, (4, "running"): True, (None, "failed"): None, (5, "running"): True, (6, "failed"): False}


def test_answers_are_sent_in_order_whatever_order_lines_come_in(spark, tmp_path):
    folder, out, ck = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "ck")
    c = spark.read.parquet(f"{DATA}/sf0.001/conversations.parquet").where("conv_id < 30").select(F.col("conv_id").alias("request_id"), "turn", "text")
    w = Window.partitionBy("request_id").orderBy("turn")
    c = c.withColumn("seq", (F.row_number().over(w) - 1).cast("long")).withColumn("last", F.max("seq").over(Window.partitionBy("request_id")))
    body = F.to_json(F.struct(F.struct(F.col("text").alias("content")).alias("message"), (F.col("seq") == F.least(F.lit(3), F.col("last"))).alias("done")))
    lines = c.select("request_id", "seq", F.when(F.col("seq") == 1, "{broken").when(F.col("seq") == 2, " ").otherwise(body).alias("line"), "last")
    lines = lines.where("last not in (1, 2)").drop("last").persist()
    part = F.pmod(F.xxhash64("request_id", "seq"), F.lit(3)).cast("int")
    for p in range(3):  # a third at a time, by hash, and the third before once more
        lines.where((part == p) | (part == p - 1)).coalesce(1).write.mode("append").parquet(folder)
        stream = spark.readStream.schema(lines.schema).parquet(folder)
        stateful.start(stateful.answer_stream(stream), out, ck).awaitTermination()
    got = spark.read.schema(stateful.MESSAGES).parquet(out)
    tokens = jobs.token_stream(lines)
    assert _rows(got, "request_id long, seq long, type string") == _rows(jobs.messages(tokens), "request_id long, seq long, type string")
    said = got.where("type = 'token'").groupBy("request_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "token"))), lambda x: x["token"]), "").alias("answer"))
    assert _rows(said, "request_id long, answer string") == _rows(jobs.answers(tokens), "request_id long, answer string")
