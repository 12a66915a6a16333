"""Jobs, rate limits, answer tokens and incremental ingestion; each works on a stream or on a table of the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import config
from ..operators.chunking import windows


def with_event_time(events: DataFrame, ts: str = "ts") -> DataFrame:
    """Zoneless times as instants: a watermark takes no others."""
    return events.withColumn(ts, F.col(ts).cast("timestamp"))


def status_of(event_type: Column) -> Column:
    return F.when(event_type == "error", "failed").when(event_type == "purchase", "completed").otherwise("running")


def latest_state(events: DataFrame, by: str = "user_id") -> DataFrame:
    """by, status, progress, event_id of the last event of each job; on a stream in update or complete mode."""
    last = F.max_by(F.struct(status_of(F.col("event_type")).alias("status"), F.round("value", 6).alias("progress"), F.col("event_id").alias("event_id")), F.struct("ts", "event_id"))
    return events.groupBy(by).agg(last.alias("s")).select(by, "s.*")


def accepted_jobs(events: DataFrame, by: str = "user_id") -> DataFrame:
    """event_id, accepted of the events that ask for a job: refused while the last event of that user left one running."""
    w = Window.partitionBy(by).orderBy("ts", "event_id")
    before = F.lag(status_of(F.col("event_type"))).over(w)
    return events.select("event_id", F.coalesce(before != "running", F.lit(True)).alias("accepted"))


def limited(events: DataFrame, limit: int, width: str = "1 hour", by: str = "user_id") -> DataFrame:
    """by, window_start, event_id, allowed: the first ``limit`` events of each user in each window."""
    start = F.window("ts", width)["start"]
    rows = events.select(by, start.alias("window_start"), "event_id", "ts")
    rank = F.row_number().over(Window.partitionBy(by, "window_start").orderBy("ts", "event_id"))
    return rows.select(by, "window_start", "event_id", (rank <= limit).alias("allowed"))


def window_counts(events: DataFrame, width: str = "1 hour", late: str = "2 hours", by: str = "user_id") -> DataFrame:
    """by, window_start, n with a watermark: what a limiter needs to keep of a stream."""
    counts = events.withWatermark("ts", late).groupBy(F.window("ts", width), by).agg(F.count("*").alias("n"))
    return counts.select(by, F.col("window.start").alias("window_start"), "n")


_TOKEN = T.StructType([T.StructField("message", T.StructType([T.StructField("content", T.StringType())])), T.StructField("done", T.BooleanType())])


def parsed_lines(lines: DataFrame, by: str = "request_id", seq: str = "seq", line: str = "line") -> DataFrame:
    """by, seq, token, done of every line; blank and broken ones have no token and aren't the last."""
    j = F.from_json(line, _TOKEN)
    return lines.select(by, seq, j["message"]["content"].alias("token"), F.coalesce(j["done"], F.lit(False)).alias("done"))


def token_stream(lines: DataFrame, by: str = "request_id", seq: str = "seq", line: str = "line") -> DataFrame:
    """by, seq, token of each request's JSON lines up to the one that is done; blank and broken lines are skipped."""
    rows = lines.where(F.trim(F.col(line)) != "").select(by, seq, F.from_json(line, _TOKEN).alias("j")).where("j.message is not null or j.done is not null")
    w = Window.partitionBy(by).orderBy(seq).rowsBetween(Window.unboundedPreceding, -1)
    open_ = rows.withColumn("_done", F.coalesce(F.bool_or(F.coalesce("j.done", F.lit(False))).over(w), F.lit(False))).where("not _done")
    return open_.where("j.message.content <> ''").select(by, seq, F.col("j.message.content").alias("token"))


def answers(tokens: DataFrame, by: str = "request_id", seq: str = "seq") -> DataFrame:
    """by, answer: the tokens in order."""
    return tokens.groupBy(by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(seq, "token"))), lambda x: x["token"]), "").alias("answer"))


def messages(tokens: DataFrame, by: str = "request_id", seq: str = "seq") -> DataFrame:
    """by, seq, type: what a chat client is sent - four statuses with the sources before the last, tokens, done."""
    head = ["status:loading_index", "status:embedding", "status:ranking", "sources", "status:generating"]
    lead = tokens.select(by).distinct().select(by, F.posexplode(F.array(*map(F.lit, head))).alias("seq", "type"))
    n = F.row_number().over(Window.partitionBy(by).orderBy(seq))
    body = tokens.select(by, (n + len(head) - 1).alias("seq"), F.lit("token").alias("type"))
    tail = tokens.groupBy(by).agg((F.count("*") + len(head)).alias("seq")).withColumn("type", F.lit("done"))
    return lead.unionByName(body).unionByName(tail).withColumn("seq", F.col("seq").cast("long"))


def progress(files: DataFrame, by: str = "repo_id", order: str = "rel_path", seen: str = "seen") -> DataFrame:
    """by, file_no, phase, progress while files are chunked; ``seen`` is the chunks that a file has."""
    w = Window.partitionBy(by).orderBy(order)
    n = F.count("*").over(Window.partitionBy(by))
    i = F.row_number().over(w)
    total = F.sum(seen).over(w.rowsBetween(Window.unboundedPreceding, 0))
    share = 0.5 * i / n + 0.5 * F.least(total / F.greatest(15 * n, F.lit(1)), F.lit(1.0))
    return files.select(by, i.cast("long").alias("file_no"), F.lit("chunking").alias("phase"), F.round(0.2 * share, 6).alias("progress"))


def progress_later(chunks: DataFrame, by: str = "repo_id", order: tuple[str, ...] = ("rel_path", "chunk_no"), flush: int = config.FLUSH) -> DataFrame:
    """by, chunks_done, phase, progress while a repository's chunks are embedded in parts of ``flush``, and of its index.

    The part of each number of chunks is told; a part that isn't full is the last.
    """
    w = Window.partitionBy(by)
    i = F.row_number().over(w.orderBy(*order)).cast("long")
    rows = chunks.select(by, i.alias("chunks_done"), F.count("*").over(w).alias("_n")).where((F.col("chunks_done") % flush == 0) | (F.col("chunks_done") == F.col("_n")))
    share = 0.2 + 0.7 * F.col("chunks_done") / F.greatest("_n", "chunks_done", F.lit(1))
    embedding = rows.select(by, "chunks_done", F.lit("embedding").alias("phase"), F.round(share, 6).alias("progress"))
    ends = rows.where("chunks_done = _n").select(by, "chunks_done", F.lit("bm25").alias("phase"), F.explode(F.array(F.lit(0.9), F.lit(1.0))).alias("progress"))
    return embedding.unionByName(ends)


def ingest_stream(files: DataFrame, path: str, checkpoint: str, chunk: Callable[[DataFrame], DataFrame] = windows):
    """Starts a query that chunks files as they arrive and appends them, by repository; a batch that is retried replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        out = chunk(batch).withColumn("batch", F.lit(number))
        out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("repo_id", "batch").parquet(path)

    return files.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


