"""Queries over repositories, jobs, rate limits and answer streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import catalog, chunking
from ..sources import files as S
from ..sources.tables import FILES_SQL, files, table
from ..streaming import jobs, stateful
from .text import FILE_WINDOWS_SQL

QUERIES, SQL = {}, {}


def _q(name: str, sql: str | None):
    def put(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return put


@_q("list_repos", f"WITH {FILE_WINDOWS_SQL} SELECT repo_id, 'repo_' || repo_id AS collection, count(*) AS chunks FROM windows GROUP BY 1")
def _(spark, d):
    return catalog.list_repos(chunking.windows(files(spark, d)))


@_q("delete_repo_antijoin", f"WITH {FILE_WINDOWS_SQL} SELECT repo_id, count(*) AS chunks FROM windows WHERE repo_id <> 'src3' GROUP BY 1")
def _(spark, d):
    return catalog.list_repos(catalog.without_repo(chunking.windows(files(spark, d)), "src3")).select("repo_id", "chunks")


@_q("ingest_total_cap", f"WITH {FILE_WINDOWS_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY rel_path, chunk_no) AS k FROM windows) SELECT repo_id, count(DISTINCT rel_path) AS files_indexed, count(*) AS chunks_indexed FROM r WHERE k <= 30 GROUP BY 1")
def _(spark, d):
    capped = catalog.total_cap(chunking.windows(files(spark, d)), 30)
    return capped.groupBy("repo_id").agg(F.count_distinct("rel_path").alias("files_indexed"), F.count("*").alias("chunks_indexed"))


_SKIPPED = "regexp_matches(rel_path, '\\.foo$')"


@_q("ingest_summary", f"WITH {FILE_WINDOWS_SQL}, s AS (SELECT repo_id, count(CASE WHEN {_SKIPPED} THEN 1 END) AS files_skipped FROM files GROUP BY 1), c AS (SELECT repo_id, count(DISTINCT rel_path) AS files_indexed, count(*) AS chunks_indexed FROM windows WHERE NOT {_SKIPPED} GROUP BY 1) SELECT repo_id, files_indexed, files_skipped, chunks_indexed FROM s JOIN c USING (repo_id)")
def _(spark, d):
    f = S.classify(files(spark, d))
    chunks = chunking.windows(f.where("status = 'indexed'")).groupBy("repo_id").agg(F.count_distinct("rel_path").alias("files_indexed"), F.count("*").alias("chunks_indexed"))
    skipped = f.groupBy("repo_id").agg(F.count_if(F.col("status") == "skipped").alias("files_skipped"))
    return chunks.join(skipped, "repo_id").select("repo_id", "files_indexed", "files_skipped", "chunks_indexed")


@_q(
    "ingest_progress",
    f"""WITH {FILES_SQL}, s AS (SELECT repo_id, rel_path, CAST(ceil(len(string_split(text, chr(10))) / 45.0) AS BIGINT) AS seen FROM files),
r AS (SELECT repo_id, row_number() OVER w AS file_no, count(*) OVER (PARTITION BY repo_id) AS n, sum(seen) OVER w AS total FROM s WINDOW w AS (PARTITION BY repo_id ORDER BY rel_path))
SELECT repo_id, file_no, 'chunking' AS phase, round(0.2::DOUBLE * (0.5::DOUBLE * file_no / n + 0.5::DOUBLE * least(total::DOUBLE / greatest(15 * n, 1), 1.0)), 6) AS progress FROM r""",
)
def _(spark, d):
    seen = F.ceil(F.size(F.split("text", "\n")) / 45).cast("long")
    return jobs.progress(files(spark, d).select("repo_id", "rel_path", seen.alias("seen")))


@_q(
    "ingest_progress_later",
    f"""WITH {FILE_WINDOWS_SQL}, r AS (SELECT repo_id, row_number() OVER (PARTITION BY repo_id ORDER BY rel_path, chunk_no) AS i, count(*) OVER (PARTITION BY repo_id) AS n FROM windows)
SELECT repo_id, i AS chunks_done, 'embedding' AS phase, round(0.2::DOUBLE + 0.7::DOUBLE * i / n, 6) AS progress FROM r WHERE i % 32 = 0 OR i = n UNION ALL SELECT repo_id, n, 'bm25', unnest([0.9::DOUBLE, 1.0::DOUBLE]) FROM r WHERE i = n""",
)
def _(spark, d):
    return jobs.progress_later(chunking.windows(files(spark, d)))


_STATUS = "CASE event_type WHEN 'error' THEN 'failed' WHEN 'purchase' THEN 'completed' ELSE 'running' END"


@_q("job_latest_state", f"SELECT user_id, status, round(value, 6) AS progress, event_id FROM (SELECT *, {_STATUS} AS status, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k = 1")
def _(spark, d):
    return jobs.latest_state(jobs.with_event_time(table(spark, d, "events")))


@_q("active_job_guard", f"WITH s AS (SELECT event_id, lag({_STATUS}) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events) SELECT event_id, coalesce(before <> 'running', true) AS accepted FROM s")
def _(spark, d):
    return jobs.accepted_jobs(jobs.with_event_time(table(spark, d, "events")))


_SILENT = 6 * 3600


@_q(
    "job_history",
    f"""WITH e AS (SELECT DISTINCT user_id, event_id, epoch_us(ts) AS t, {_STATUS} AS status FROM events),
w AS (SELECT *, lag(status) OVER o AS b, lag(t) OVER o AS b_t, lead(t) OVER o AS n_t FROM e WINDOW o AS (PARTITION BY user_id ORDER BY t, event_id))
SELECT user_id, event_id, t AS "at", status, NOT coalesce(b = 'running' AND t - b_t <= {_SILENT * 1_000_000}, false) AS accepted FROM w
UNION ALL SELECT user_id, NULL, t + {_SILENT * 1_000_000}, 'failed', NULL FROM w WHERE status = 'running' AND (n_t IS NULL OR n_t - t > {_SILENT * 1_000_000})""",
)
def _(spark, d):
    """What the stream of the same name in ``streaming.stateful`` gives, with jobs that are silent for six hours."""
    return stateful.job_history(jobs.with_event_time(table(spark, d, "events")), _SILENT)


@_q("rate_limit_tumbling", "SELECT user_id, time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_id, row_number() OVER (PARTITION BY user_id, time_bucket(INTERVAL 1 HOUR, ts) ORDER BY ts, event_id) <= 1 AS allowed FROM events")
def _(spark, d):
    out = jobs.limited(jobs.with_event_time(table(spark, d, "events")), 1)
    return out.withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


def _lines(spark, d):
    """Each conversation as a stream of JSON lines: blank, broken, done at turn 4 and more behind it."""
    c = table(spark, d, "conversations").select(F.col("conv_id").alias("request_id"), F.col("turn").alias("seq"), F.col("text").alias("t"))
    line = F.when(F.col("seq") % 7 == 6, " ").when(F.col("seq") % 7 == 5, "{broken").otherwise(F.to_json(F.struct(F.struct(F.col("t").alias("content")).alias("message"), (F.col("seq") == 4).alias("done"))))
    return c.select("request_id", "seq", line.alias("line"))


_TOKENS = "tokens AS (SELECT conv_id AS request_id, turn AS seq, text AS token FROM conversations WHERE turn <= 4 AND text <> '')"


@_q("ndjson_token_stream", f"WITH {_TOKENS} SELECT * FROM tokens")
def _(spark, d):
    return jobs.token_stream(_lines(spark, d))


@_q("answer_assembly", f"WITH {_TOKENS} SELECT request_id, string_agg(token, '' ORDER BY seq) AS answer FROM tokens GROUP BY 1")
def _(spark, d):
    return jobs.answers(jobs.token_stream(_lines(spark, d)))


@_q(
    "ws_message_sequence",
    f"""WITH {_TOKENS}, n AS (SELECT request_id, count(*) AS n FROM tokens GROUP BY 1)
SELECT request_id, i AS seq, ['status:loading_index', 'status:embedding', 'status:ranking', 'sources', 'status:generating'][i + 1] AS type FROM n, (SELECT unnest(range(0, 5)) AS i)
UNION ALL SELECT request_id, row_number() OVER (PARTITION BY request_id ORDER BY seq) + 4, 'token' FROM tokens UNION ALL SELECT request_id, n + 5, 'done' FROM n""",
)
def _(spark, d):
    return jobs.messages(jobs.token_stream(_lines(spark, d)))
