"""The two jobs as queries: each runs its function twice into one new folder and returns what stands there then."""

from __future__ import annotations

import uuid

from ..sources.storage import shared_folder
from .retrieval import RELEVANT_SQL
from .text import FILE_WINDOWS_SQL

QUERIES, SQL = {}, {}


def _q(name: str, sql: str | None):
    def put(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return put


def _folder(spark, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


@_q(
    "job1_index_documents",
    f"WITH {FILE_WINDOWS_SQL} SELECT repo_id, rel_path, chunk_no, start_line, end_line, CAST(ceil(length(text) / 4.0) AS BIGINT) AS n_tokens, sha256('File: ' || rel_path || chr(10) || text) AS content_hash, 1::BIGINT AS n_vectors FROM windows WHERE repo_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY rel_path ORDER BY chunk_no) <= 80",
)
def _(spark, d):
    from jobs import index_documents

    at = _folder(spark, "job1")
    for _ in range(2):  # the second run finds nothing new
        out = index_documents.run(spark, f"{d}/documents.parquet", f"{at}/out", f"{at}/checkpoint")
    return out


@_q(
    "job2_evaluate_retrieval",
    f"""WITH {RELEVANT_SQL}, n AS (SELECT item_id, count(*) AS n_answers FROM relevant GROUP BY 1), f AS (SELECT item_id, coalesce(n_answers, 0) AS n_answers, CASE WHEN first_rank <= 10 THEN first_rank END AS first_rank FROM questions LEFT JOIN n USING (item_id) LEFT JOIN first USING (item_id))
SELECT *, CASE WHEN n_answers = 0 THEN 'unanswerable' WHEN first_rank <= 1 THEN 'hit@1' WHEN first_rank <= 5 THEN 'hit@5' WHEN first_rank <= 10 THEN 'hit@10' ELSE 'miss' END AS outcome FROM f""",
)
def _(spark, d):
    from jobs import evaluate_retrieval

    at = _folder(spark, "job2")
    for _ in range(2):
        out = evaluate_retrieval.run(spark, f"{d}/documents.parquet", f"{d}/benchmark.parquet", at)
    return out
