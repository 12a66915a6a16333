"""Queries over the BM25 and vector indexes, fusion, prompts and their evaluation."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from .. import config
from ..functions import text as X
from ..operators import bm25, chunking, evaluate, fusion, prompt, vector_index, vectors
from ..operators.index import Bm25Index
from ..operators.vector_index import VectorIndex
from ..sources.golden import read_golden
from ..sources.storage import shared_folder
from ..sources.tables import FILES_SQL, QUESTIONS_SQL, files, questions, table
from .text import FILE_WINDOWS_SQL, TOKENS_SQL

QUERIES, SQL = {}, {}
#: Candidates that are sent to all tasks that read documents, at about 200 bytes each; joined by shuffle beyond.
BROADCAST = 1 << 18


def _q(name: str, sql: str | None):
    def put(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return put


_INDEX = f"""tok AS MATERIALIZED (SELECT doc_id, unnest({TOKENS_SQL}) AS term FROM documents),
tf AS MATERIALIZED (SELECT doc_id, term, count(*) AS tf FROM tok GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
raw AS MATERIALIZED (SELECT term, df, ln(n - df + 0.5) - ln(df + 0.5) AS raw FROM df, (SELECT count(*) AS n FROM documents)),
fl AS (SELECT 0.25 * avg(raw) AS floor FROM raw),
w AS (SELECT term, df, CASE WHEN raw < 0 THEN floor ELSE raw END AS idf FROM raw, fl)"""


def _bm25(where: str) -> str:
    return f"""{QUESTIONS_SQL}, {_INDEX},
dl AS (SELECT doc_id, len({TOKENS_SQL}) AS doc_len FROM documents),
st AS (SELECT avg(doc_len) AS mean FROM dl),
qt AS (SELECT item_id, term, count(*) AS c FROM (SELECT item_id, unnest({TOKENS_SQL.replace('text', 'question')}) AS term FROM questions WHERE {where}) GROUP BY ALL),
sc AS (SELECT item_id, doc_id, round(sum(c * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * doc_len / mean))), 6) AS score FROM qt JOIN w USING (term) JOIN tf USING (term) JOIN dl USING (doc_id), st GROUP BY ALL),
sparse AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM sc WHERE score > 0) WHERE rank <= 50)"""




def _hashed(name: str, k: str, t: str, column: str) -> str:
    tok = TOKENS_SQL.replace("text", column)
    return f"{name}0 AS (SELECT {k}, CAST(('0x' || left(md5(term), 2)) AS BIGINT) % 64 AS bucket, count(*) AS n FROM (SELECT {k}, unnest({tok}) AS term FROM {t}) GROUP BY ALL), {name} AS (SELECT {k}, bucket, n / sqrt(sum(n * n) OVER (PARTITION BY {k})) AS weight FROM {name}0)"


_DENSE = f"""{_hashed('dv', 'doc_id', 'documents', 'text')}, {_hashed('qv', 'item_id', "questions", 'question')},
dsc AS (SELECT item_id, doc_id, round(sum(q.weight * d.weight), 6) AS score FROM qv q JOIN dv d USING (bucket) GROUP BY ALL),
dense AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM dsc) WHERE rank <= 50)"""
_FUSED = f"""{_bm25('true')}, {_DENSE},
seen AS (SELECT item_id, doc_id, rank, rank AS ord, score AS d FROM dense UNION ALL SELECT item_id, doc_id, rank, rank + 1000000, NULL FROM sparse),
fu AS (SELECT item_id, doc_id, round(sum(1.0::DOUBLE / (rank + 60)), 9) AS rrf_score, min(ord) AS ord, coalesce(max(d), 0.0) AS dense_score FROM seen GROUP BY ALL),
fused AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY rrf_score DESC, ord) AS rank FROM fu) WHERE rank <= 100)"""
_RERANKED = f"""{_FUSED},
lx AS (SELECT f.item_id, f.doc_id, f.rank AS r0, f.dense_score,
  4.0::DOUBLE * len(list_filter(list_distinct({TOKENS_SQL.replace('text', 'question')}), lambda x: list_contains({TOKENS_SQL.replace('text', 'left(d.text, 1920)')}, x))) / greatest(len(list_distinct({TOKENS_SQL.replace('text', 'question')})), 1) AS l
  FROM fused f JOIN questions q USING (item_id) JOIN documents d USING (doc_id)),
ex AS (SELECT *, exp(l - max(l) OVER (PARTITION BY item_id)) AS e FROM lx),
so AS (SELECT item_id, doc_id, dense_score, r0, round(e / sum(e) OVER (PARTITION BY item_id), 6) AS score FROM ex),
reranked AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, r0) AS rank FROM so) WHERE rank <= 8)"""


def _docs(spark, d):
    return table(spark, d, "documents").select("doc_id", "text")


_STORED: dict[tuple, str] = {}


def _stored(spark, d, name: str, build) -> str:
    """The folder of an index of a table, in the session's shared folder: built when it is first asked for, and again if the table's files have changed."""
    rows = table(spark, d, name)
    at = rows.select("_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time").distinct()
    mark = (spark.sparkContext.applicationId, name, d, *at.agg(F.count("*"), F.bit_xor(F.xxhash64("*"))).first())
    if mark not in _STORED:
        path = f"{shared_folder(spark)}/{name}-index-{uuid.uuid4().hex}"
        build(path, rows)
        _STORED[mark] = path
    return _STORED[mark]


def stored_index(spark, d) -> Bm25Index:
    return Bm25Index(spark, _stored(spark, d, "documents", lambda path, docs: Bm25Index(spark, path).add(docs.select("doc_id", "text", F.lit("all").alias("repo_id")))))


def stored_vectors(spark, d) -> VectorIndex:
    return VectorIndex(spark, _stored(spark, d, "embeddings", lambda path, rows: VectorIndex(spark, path).build(rows)))


def _sparse(spark, d, asked=None, k=config.SPARSE_K):
    return stored_index(spark, d).top_k(questions(spark, d) if asked is None else asked, "all", k)


def _dense(spark, d):
    asked = questions(spark, d).select("item_id", vectors.embed(F.col("question")).alias("v"))
    return vectors.top_k(_docs(spark, d).select("doc_id", vectors.embed(F.col("text")).alias("v")), asked, key="doc_id", vector="v", by="item_id", positive=True)


def _fused(spark, d):
    return fusion.rrf(_dense(spark, d), _sparse(spark, d))


def _coverage(question, text):
    """Four times the share of the question's words in the text: the default logit where no model is at hand."""
    words = F.array_distinct(X.tokens(question))
    return 4.0 * F.size(F.array_intersect(words, X.tokens(F.left(text, F.lit(config.RERANK_TEXT_CHARS))))) / F.greatest(F.size(words), F.lit(1))


def _reranked(spark, d):
    asked = questions(spark, d)
    candidates = _fused(spark, d).join(asked, "item_id")
    # few candidates go to the documents, which then stay where they are; of a text only what is read travels otherwise
    candidates = F.broadcast(candidates) if asked.count() * config.RRF_TOP <= BROADCAST else candidates
    candidates = candidates.join(_docs(spark, d).withColumn("text", F.left("text", F.lit(config.RERANK_TEXT_CHARS))), "doc_id")
    return fusion.rerank(candidates, _coverage(F.col("question"), F.col("text")))


@_q("bm25_topk", f"WITH {_bm25('item_id = 0')} SELECT doc_id, score, rank FROM sparse")
def _(spark, d):
    return _sparse(spark, d, questions(spark, d).where("item_id = 0")).select("doc_id", "score", "rank")


@_q("bm25_topk_batch", f"WITH {_bm25('true')} SELECT item_id, doc_id, score, rank FROM sparse")
def _(spark, d):
    return _sparse(spark, d).select("item_id", "doc_id", "score", "rank")


@_q("bm25_index_build", f"SELECT term, doc_id, tf, len({TOKENS_SQL}) AS doc_len FROM (SELECT doc_id, text, unnest(list_distinct({TOKENS_SQL})) AS term FROM documents) JOIN (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({TOKENS_SQL}) AS term FROM documents) GROUP BY ALL) USING (doc_id, term)")
def _(spark, d):
    """The postings as they are stored, read back."""
    return stored_index(spark, d).postings("all").select("term", F.col("key").alias("doc_id"), "tf", F.col("len").alias("doc_len"))


@_q("bm25_index_stats", f"WITH {_INDEX} SELECT 'all' AS repo_id, n AS n_docs, round(mean, 6) AS mean_len, round(floor, 6) AS floor, n_terms FROM fl, (SELECT count(*) AS n, avg(len({TOKENS_SQL})) AS mean FROM documents), (SELECT count(*) AS n_terms FROM df)")
def _(spark, d):
    return stored_index(spark, d).stats().select("repo_id", "n_docs", F.round("mean_len", 6).alias("mean_len"), F.round("floor", 6).alias("floor"), "n_terms")


@_q("bm25_idf", f"WITH {_INDEX} SELECT term, df, round(idf, 6) AS idf FROM w")
def _(spark, d):
    return stored_index(spark, d).weights("all").select("term", "df", F.round("idf", 6).alias("idf"))


@_q("bm25_doclen", f"SELECT doc_id, len({TOKENS_SQL}) AS doc_len FROM documents")
def _(spark, d):
    return bm25.lengths(_docs(spark, d))


@_q("l2_normalize", "WITH n AS (SELECT vec_id, sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) AS n, embedding FROM embeddings) SELECT vec_id, round(n, 6) AS norm_before, round(sqrt(list_sum(list_transform(embedding, lambda x: (x::DOUBLE / n) * (x::DOUBLE / n)))), 6) AS norm_after FROM n")
def _(spark, d):
    return vectors.norms(table(spark, d, "embeddings"))


@_q("vector_validate", "SELECT vec_id, len(embedding) AS dim, len(embedding) = 64 AS valid FROM embeddings")
def _(spark, d):
    return vectors.validate(table(spark, d, "embeddings"), 64)


def _dense_sql(where: str) -> str:
    return f"""WITH s AS (SELECT q.vec_id AS query_id, e.vec_id, round(list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) AS score FROM embeddings e, (SELECT * FROM embeddings WHERE {where}) q)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 50"""


@_q("dense_topk", f"SELECT vec_id, score, rank FROM ({_dense_sql('vec_id = 0')})")
def _(spark, d):
    v = table(spark, d, "embeddings")
    return vectors.top_k(v, v.where("vec_id = 0").withColumnRenamed("vec_id", "query_id")).select("vec_id", "score", "rank")


@_q("dense_topk_batch", _dense_sql("vec_id % 20 = 0"))
def _(spark, d):
    v = table(spark, d, "embeddings")
    return vectors.top_k(v, v.where("vec_id % 20 = 0").withColumnRenamed("vec_id", "query_id"))


@_q("dense_topk_stored", _dense_sql("vec_id % 20 = 0"))
def _(spark, d):
    """The exact way of the stored vectors: every list is read and every vector scored."""
    v = table(spark, d, "embeddings")
    return stored_vectors(spark, d).top_k(v.where("vec_id % 20 = 0").withColumnRenamed("vec_id", "query_id"), exact=True)


@_q("dense_topk_lists", None)
def _(spark, d):
    """The lists nearest to each query only; what that finds of the exact results is ``dense_recall``."""
    v = table(spark, d, "embeddings")
    return stored_vectors(spark, d).top_k(v.where("vec_id % 20 = 0").withColumnRenamed("vec_id", "query_id"))


@_q("dense_recall", "SELECT count(*) AS n, true AS recall_is_090 FROM embeddings WHERE vec_id % 20 = 0")
def _(spark, d):
    at, asked = stored_vectors(spark, d), table(spark, d, "embeddings").where("vec_id % 20 = 0").withColumnRenamed("vec_id", "query_id")
    return vector_index.recall(at.top_k(asked), at.top_k(asked, exact=True)).select("n", (F.col("recall") >= 0.9).alias("recall_is_090"))


@_q("hashed_embedding", f"WITH {_hashed('dv', 'doc_id', 'documents', 'text')} SELECT doc_id, bucket, round(weight, 6) AS weight FROM dv")
def _(spark, d):
    return vectors.hashed(_docs(spark, d)).withColumn("weight", F.round("weight", 6))


@_q("rrf_fusion", f"WITH {_FUSED} SELECT item_id, doc_id, round(rrf_score, 6) AS rrf_score, rank FROM fused")
def _(spark, d):
    return _fused(spark, d).select("item_id", "doc_id", F.round("rrf_score", 6).alias("rrf_score"), "rank")


@_q(
    "rrf_small_shortcut",
    f"""WITH {_bm25('true')}, {_DENSE},
seen AS (SELECT item_id, doc_id, rank, rank AS ord, score AS d FROM dense WHERE rank <= 4 UNION ALL SELECT item_id, doc_id, rank, rank + 1000000, NULL FROM sparse WHERE rank <= 4),
fu AS (SELECT item_id, doc_id, round(sum(1.0::DOUBLE / (rank + 60)), 9) AS rrf_score, min(ord) AS ord, coalesce(max(d), 0.0) AS dense_score FROM seen GROUP BY ALL),
fr AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY rrf_score DESC, ord) AS r0, count(*) OVER (PARTITION BY item_id) AS n FROM fu)
SELECT item_id, doc_id, dense_score AS score, row_number() OVER (PARTITION BY item_id ORDER BY dense_score DESC, r0) AS rank FROM fr WHERE n <= 8""",
)
def _(spark, d):
    few = fusion.rrf(_dense(spark, d).where("rank <= 4"), _sparse(spark, d, k=4))
    return fusion.shortcut(few).select("item_id", "doc_id", "score", "rank")


@_q("rerank_softmax", f"WITH {_RERANKED} SELECT item_id, doc_id, score, rank FROM reranked")
def _(spark, d):
    return _reranked(spark, d).select("item_id", "doc_id", "score", "rank")


@_q("hybrid_retrieve", f"WITH {_RERANKED} SELECT item_id, doc_id, score, rank, dense_score FROM reranked")
def _(spark, d):
    return _reranked(spark, d).select("item_id", "doc_id", "score", "rank", "dense_score")


@_q("context_guardrail", f"WITH {_RERANKED} SELECT item_id, count(*) AS n, max(score) AS max_score, max(score) >= 0.10 OR max(dense_score) >= 0.35 AS sufficient FROM reranked GROUP BY 1")
def _(spark, d):
    return prompt.sufficient(_reranked(spark, d).withColumn("chunk_type", F.lit("sliding_window")))


#: The windows that a question is given, by rank: the documents are dealt to the questions in turn, in the order of path.
_RANKED = f"""{FILE_WINDOWS_SQL}, {QUESTIONS_SQL}, ranked AS (SELECT q.item_id, w.*, row_number() OVER (PARTITION BY q.item_id ORDER BY rel_path, chunk_no) AS rank
FROM questions q JOIN windows w ON w.doc_id % (SELECT greatest(count(*), 1) FROM benchmark) = q.item_id),
toks AS (SELECT *, CAST(ceil(length(text) / 4.0) AS BIGINT) AS t FROM ranked)"""


def _ranked(spark, d):
    from pyspark.sql import Window

    asked = questions(spark, d)
    n = asked.agg(F.greatest(F.count("*"), F.lit(1)).alias("n"))
    w = chunking.windows(files(spark, d)).withColumn("item_id", F.col("doc_id") % n.scalar())
    joined = w.join(asked, "item_id")
    rank = F.row_number().over(Window.partitionBy("item_id").orderBy("rel_path", "chunk_no"))
    return joined.withColumn("rank", rank.cast("long")).withColumn("t", X.token_count(F.col("text")))


_BLOCK = "'[Chunk ' || {i} || '] File: ' || rel_path || ' Lines ' || start_line || '-' || end_line || ' (sliding_window)' || chr(10) || '```' || lang || chr(10) || text || chr(10) || '```'"


def _block(index):
    return prompt.format_chunk(index, F.col("rel_path"), F.col("start_line"), F.col("end_line"), F.lit("sliding_window"), F.col("lang"), F.col("text"))


@_q("format_chunks", f"WITH {_RANKED} SELECT item_id, rank, md5({_BLOCK.format(i='rank')}) AS block_md5, length({_BLOCK.format(i='rank')}) AS block_len FROM ranked")
def _(spark, d):
    b = _block(F.col("rank"))
    return _ranked(spark, d).select("item_id", "rank", F.md5(b).alias("block_md5"), F.length(b).cast("long").alias("block_len"))


_GREEDY = f"""WITH RECURSIVE {_RANKED}, fold AS (SELECT item_id, 0::BIGINT AS rank, 0::BIGINT AS total, false AS kept FROM toks WHERE rank = 1
UNION ALL SELECT f.item_id, t.rank, CASE WHEN f.total + t.t <= 848 THEN f.total + t.t ELSE f.total END, f.total + t.t <= 848 FROM fold f JOIN toks t ON t.item_id = f.item_id AND t.rank = f.rank + 1),
kept AS (SELECT item_id, rank, row_number() OVER (PARTITION BY item_id ORDER BY rank) AS new_rank FROM fold WHERE kept)"""


@_q("budget_trim_greedy", f"{_GREEDY} SELECT * FROM kept")
def _(spark, d):
    return prompt.trim_greedy(_ranked(spark, d), "t")


@_q("budget_trim_prefix", f"WITH {_RANKED}, s AS (SELECT item_id, rank, sum(t) OVER (PARTITION BY item_id ORDER BY rank) AS total FROM toks) SELECT item_id, rank FROM s WHERE total <= 848 OR rank = 1")
def _(spark, d):
    return prompt.trim_prefix(_ranked(spark, d), "t").select("item_id", "rank")


@_q(
    "prompt_build",
    f"{_GREEDY}, b AS (SELECT item_id, string_agg({_BLOCK.format(i='new_rank')}, chr(10) || chr(10) ORDER BY new_rank) AS blocks FROM kept JOIN ranked USING (item_id, rank) GROUP BY 1), "
    "p AS (SELECT item_id, 'Using the following code context, please answer the question.' || chr(10) || chr(10) || coalesce(blocks, '') || chr(10) || chr(10) || 'Question: ' || question AS p FROM questions LEFT JOIN b USING (item_id)) "
    "SELECT item_id, length(p) AS prompt_len, md5(p) AS prompt_md5 FROM p",
)
def _(spark, d):
    ranked = _ranked(spark, d)
    kept = prompt.trim_greedy(ranked, "t").join(ranked, ["item_id", "rank"])
    blocks = kept.select("item_id", F.col("new_rank").alias("rank"), _block(F.col("new_rank")).alias("block"))
    return prompt.prompt(blocks, questions(spark, d)).select("item_id", F.length("prompt").cast("long").alias("prompt_len"), F.md5("prompt").alias("prompt_md5"))


@_q(
    "source_projection",
    f"WITH {FILE_WINDOWS_SQL} SELECT CASE WHEN doc_id % 5 = 0 THEN '' ELSE rel_path END AS file_path, CASE WHEN doc_id % 3 = 0 THEN 0 ELSE start_line END AS start_line, end_line, CASE WHEN doc_id % 4 = 0 THEN 'snippet' ELSE 'sliding_window' END AS chunk_type, lang AS language, 0.0::DOUBLE AS score FROM windows",
)
def _(spark, d):
    w = chunking.windows(files(spark, d))
    holes = w.select(F.when(F.col("doc_id") % 5 != 0, F.col("rel_path")).alias("file_path"), F.when(F.col("doc_id") % 3 != 0, F.col("start_line")).alias("start_line"), "end_line", F.when(F.col("doc_id") % 4 != 0, "sliding_window").alias("chunk_type"), F.col("lang").alias("language"), F.lit(None).cast("double").alias("score"))
    return holes.select(*prompt.source_fields(holes))


RELEVANT_SQL = f"{_bm25('true')}, relevant AS (SELECT item_id, doc_id FROM questions q JOIN documents d ON contains(d.text, q.passage)), first AS (SELECT r.item_id, min(s.rank) AS first_rank FROM (SELECT DISTINCT item_id FROM relevant) i JOIN relevant r USING (item_id) LEFT JOIN sparse s ON s.item_id = r.item_id AND s.doc_id = r.doc_id GROUP BY 1)"


def _relevant(spark, d):
    return evaluate.relevant(stored_index(spark, d), "all", _docs(spark, d), questions(spark, d))


def _first(spark, d):
    return evaluate.first_hits(_sparse(spark, d), _relevant(spark, d))


@_q("first_hit_rank", f"WITH {RELEVANT_SQL} SELECT item_id, first_rank FROM first")
def _(spark, d):
    return _first(spark, d)


@_q("recall_at_k", f"WITH {RELEVANT_SQL}, k AS (SELECT unnest([1, 5, 10])::BIGINT AS k) SELECT k, round(avg(CASE WHEN first_rank <= k THEN 1.0 ELSE 0.0 END), 6) AS recall FROM first, k GROUP BY 1")
def _(spark, d):
    return evaluate.recall(_first(spark, d), [1, 5, 10])


@_q("mrr", f"WITH {RELEVANT_SQL} SELECT round(avg(coalesce(1.0::DOUBLE / first_rank, 0)), 6) AS mrr, count(*) AS n FROM first")
def _(spark, d):
    return evaluate.mrr(_first(spark, d))


_GOLDEN = f"""{RELEVANT_SQL}, {FILES_SQL}, golden AS (SELECT item_id, CASE WHEN item_id % 5 = 4 OR o IS NULL THEN '' ELSE '/doc_' || o || '.' END AS ef, CASE WHEN item_id % 3 = 0 THEN 'de' ELSE '' END AS es, ['file', 'symbol', 'coverage', 'either'][CAST(1 + item_id % 4 AS INTEGER)] AS mode
  FROM questions LEFT JOIN (SELECT item_id, min(doc_id) AS o FROM relevant GROUP BY 1) USING (item_id)),
found AS (SELECT item_id, rank, ef <> '' AND contains(rel_path, ef) AS f, es <> '' AND lang = es AS s, mode FROM golden JOIN sparse USING (item_id) JOIN files USING (doc_id) WHERE rank <= 10)"""


@_q("golden_hits", f"WITH {_GOLDEN} SELECT g.item_id, min(CASE WHEN CASE g.mode WHEN 'file' THEN f WHEN 'symbol' THEN s ELSE f OR s END THEN rank END) AS first_rank FROM golden g LEFT JOIN found USING (item_id) GROUP BY 1")
def _(spark, d):
    """A golden set written as JSON and read by its source; a hit is the expected file, the language as the symbol, or either."""
    oldest = _relevant(spark, d).groupBy("item_id").agg(F.min("doc_id").alias("o"))
    i = F.col("item_id")
    file = F.when((i % 5 != 4) & F.col("o").isNotNull(), F.concat(F.lit("/doc_"), F.col("o").cast("string"), F.lit(".")))
    mode = F.when(i % 4 == 0, "file").when(i % 4 == 1, "symbol").when(i % 4 == 2, "coverage")
    golden = questions(spark, d).join(oldest, "item_id", "left").select("item_id", "question", file.alias("expected_file"), F.when(i % 3 == 0, "de").alias("expected_symbol"), mode.alias("match_mode"))
    path = f"{shared_folder(spark)}/golden-{uuid.uuid4().hex}"
    golden.write.json(path)
    golden = read_golden(spark, path, lines=True).withColumn("item_id", F.col("item_id").cast("long"))
    found = _sparse(spark, d, golden.select("item_id", "question"), 10).join(files(spark, d).select("doc_id", "rel_path", "lang"), "doc_id")
    hit = evaluate.hit(F.col("match_mode"), F.col("expected_file"), F.col("expected_symbol"), F.col("rel_path"), F.col("lang"))
    hits = found.join(golden, "item_id").where(hit).groupBy("item_id").agg(F.min("rank").alias("first_rank"))
    return golden.select("item_id").join(hits, "item_id", "left")


_KEYS = "list_distinct(list_slice(list_filter(regexp_split_to_array(b.text, '\\s+'), lambda x: length(x) > 5), 1, 4))"


@_q("keyword_hit_rate", f"WITH a AS (SELECT b.item_id, d.text AS answer, {_KEYS} AS keys FROM benchmark b JOIN documents d ON d.doc_id = b.item_id) SELECT item_id, round(CASE WHEN len(keys) = 0 THEN 1.0 ELSE len(list_filter(keys, lambda k: contains(lower(answer), lower(k)))) / len(keys) END, 6) AS rate FROM a")
def _(spark, d):
    keys = F.array_distinct(F.slice(F.filter(F.split("passage", r"\s+"), lambda x: F.length(x) > 5), 1, 4))
    answers = questions(spark, d).select("item_id", keys.alias("keywords")).join(_docs(spark, d).withColumnRenamed("doc_id", "item_id"), "item_id")
    return evaluate.keyword_rates(answers, "text", "keywords")


@_q("faithfulness_rate", "SELECT source, round(avg(quality), 6) AS rate, count(quality) AS judged, count(*) - count(quality) AS skipped FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1")
def _(spark, d):
    judged = table(spark, d, "documents").select("doc_id", "source").join(table(spark, d, "labels").select("doc_id", "quality"), "doc_id", "left")
    return evaluate.faithfulness(judged, "quality", "source")
