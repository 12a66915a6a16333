"""The engine's verbs: ingest, query, list_repos, delete_repo and health, over tables partitioned by repository."""

from __future__ import annotations

import re
import time
import uuid
from collections.abc import Callable
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import config
from .functions import text as X
from .operators import catalog, chunking, evaluate, fusion, intent, manifest, prompt, vectors
from .operators.index import Bm25Index
from .sources import files as S
from .sources.storage import drop_folder, folder_exists

Logit = Callable[..., object]
GREETING_REPLY = "Hello! Ask me about the files, functions or structure of an indexed repository."
_TABLES = {
    "cache": "content_hash string, embedding array<double>, model string",
    "job_log": "job_id string, status string, phase string, progress double, seconds double, rows long, rows_per_second double, at long",
}
NO_CONTEXT_REPLY = "The indexed files hold too little about this to answer."


class Engine:
    """Collections below ``root``: chunks with their vectors, one partition a repository, their BM25 index, a cache of vectors and a log of jobs.

    ``logit(question, text)`` gives the reranker's column, ``generate(prompt)`` the answer's, ``embed(text)`` the vector's
    and ``count(text)`` the number of tokens; the defaults are a lexical coverage, an extract, hashed words and four
    characters a token, which stand in for models and are no match for them.  ``model`` names the embedding in the cache.
    """

    def __init__(self, spark: SparkSession, root: str, logit: Logit | None = None, generate: Logit | None = None, embed: Logit | None = None, count: Logit | None = None, model: str = "hashed-64"):
        self.spark, self.root = spark, root.rstrip("/")
        self.logit = logit or _coverage
        self.generate = generate or (lambda p: F.regexp_extract(p, r"(?s)```[^\n]*\n(.*?)\n```", 1))
        self.embed, self.count, self.model = embed or vectors.embed, count or X.token_count, model
        self.index = Bm25Index(spark, f"{self.root}/bm25")

    @property
    def _chunks(self) -> str:
        return f"{self.root}/chunks"

    def _read(self, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        return self.spark.read.schema(_TABLES[name]).parquet(path) if folder_exists(self.spark, path) else self.spark.createDataFrame([], _TABLES[name])

    def chunks(self) -> DataFrame:
        return self.spark.read.parquet(self._chunks)

    def _cut(self, files: DataFrame, cap: int) -> tuple[DataFrame, DataFrame]:
        """(chunks and manifests, files with their status)."""
        content = F.col("content")
        text, truncated = S.read_capped(content)
        seen = S.classify(files.withColumn("_text", S.is_text(content)), text=F.col("_text"))
        own = seen.where("status = 'indexed'").select("repo_id", "rel_path", "language", text.alias("text"), truncated.alias("truncated"))
        code = chunking.code_chunks(own.where(~F.col("language").isin("notebook", "plaintext", "markdown")))
        plain = chunking.windows(own.where(F.col("language").isin("plaintext", "markdown")), caps=[chunking.window_cap(F.col("rel_path")), config.MAX_CHUNKS_PER_FILE])
        plain = plain.select("repo_id", "rel_path", "language", "text", "start_line", "end_line", F.lit("sliding_window").alias("chunk_type"), F.lit("").alias("symbol_name"))
        cells = chunking.notebook_chunks(own.where("language = 'notebook'")).withColumn("chunk_type", F.lit("notebook_cell"))
        both = plain.unionByName(code.select(*plain.columns)).unionByName(cells.select(*plain.columns))
        kept = catalog.total_cap(both, cap, order="start_line")
        skipped = manifest.skipped_lines(S.skipped_summary(seen.where("status = 'skipped'")))
        paths = manifest.distinct_paths(seen.where("status = 'indexed'"))
        listed = manifest.manifest_chunks(paths, skipped=skipped, truncated=own.where("truncated").select("repo_id", F.col("rel_path").alias("path"))).select("repo_id", F.lit(f"{config.MANIFEST_PREFIX}repo_tree.txt").alias("rel_path"), F.lit("plaintext").alias("language"), "text", F.lit(1).cast("long").alias("start_line"), "end_line", F.lit("file_manifest").alias("chunk_type"), F.col("batch_no").cast("string").alias("symbol_name"))
        return kept.unionByName(listed), seen

    def ingest(self, files: DataFrame, cap: int = config.INGEST_MAX_TOTAL_CHUNKS, job: str | None = None) -> DataFrame:
        """Chunks ``files`` (repo_id, rel_path, content) and replaces their repositories; returns the summary.

        Chunks are worked out once, into a folder of their own; texts that the cache doesn't know are embedded once each
        and added to it; then the chunks take the old ones' place and are indexed.  A run that stops on the way leaves the
        old collections, or new chunks that the next run writes again, and never loses a vector.  ``job_log`` has
        the phases of each run, by its job's id, with their seconds and chunks a second.
        """
        job, staged = job or uuid.uuid4().hex, f"{self.root}/staged/{uuid.uuid4().hex}"
        try:
            rows, seen = self._cut(files, cap)
            body = X.embed_text(F.col("rel_path"), F.col("text"))
            rows = rows.withColumns({"embed_text": body, "content_hash": X.content_hash(body), "chunk_id": F.sha2(F.concat_ws("|", "repo_id", "rel_path", "start_line", "end_line", "chunk_type", "symbol_name", F.md5("text")), 256)})
            with self._phase(job, "chunking", 0.0, 0.2) as seen_chunks:
                rows.write.parquet(f"{staged}/chunks")
                rows = self.spark.read.schema(rows.schema).parquet(f"{staged}/chunks")
                seen_chunks(rows)
            with self._phase(job, "embedding", 0.2, 0.9) as embedded:
                new = catalog.missing(rows.select("content_hash", "embed_text"), self.cache().select("content_hash"))
                new = new.select("content_hash", self.embed(F.col("embed_text")).cast("array<double>").alias("embedding"), F.lit(self.model).alias("model"))
                # written aside and then added, so that nothing is read while it is written
                new.write.parquet(f"{staged}/vectors")
                fresh = self.spark.read.schema(new.schema).parquet(f"{staged}/vectors")
                fresh.write.mode("append").partitionBy("model").parquet(f"{self.root}/cache")
                embedded(fresh)
                rows.join(self.cache(), "content_hash", "left").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("repo_id").parquet(self._chunks)
            with self._phase(job, "bm25", 0.9, 1.0) as indexed:
                stored = self.chunks().join(files.select("repo_id").distinct(), "repo_id", "left_semi")
                self.index.add(stored.select("chunk_id", "embed_text", "repo_id"), key="chunk_id", text="embed_text")
                indexed(stored)
        except Exception:
            self._logged(job, "failed", "failed", 1.0, 0.0, 0)
            raise
        finally:
            drop_folder(self.spark, staged)
        self._logged(job, "completed", "done", 1.0, 0.0, 0)
        counts = stored.groupBy("repo_id").agg(F.count_distinct(F.when(F.col("chunk_type") != "file_manifest", F.col("rel_path"))).alias("files_indexed"), F.count("*").alias("chunks_indexed"))
        lost = seen.groupBy("repo_id").agg(F.count_if(F.col("status") == "skipped").alias("files_skipped"))
        return counts.join(lost, "repo_id", "left").select("repo_id", F.concat(F.lit("repo_"), "repo_id").alias("collection"), "files_indexed", F.coalesce("files_skipped", F.lit(0)).alias("files_skipped"), "chunks_indexed")

    def cache(self) -> DataFrame:
        """content_hash, embedding of this model's vectors; one that two runs have added counts once."""
        return self._read("cache").where(F.col("model") == self.model).groupBy("content_hash").agg(F.first("embedding").alias("embedding"))

    @contextmanager
    def _phase(self, job: str, phase: str, begins: float, ends: float):
        """Logs a phase of a job when it begins and when it has ended, with the rows that the caller tells of."""
        self._logged(job, "running", phase, begins, 0.0, 0)
        told: list[DataFrame] = []
        began = time.monotonic()
        yield told.append
        self._logged(job, "running", phase, ends, time.monotonic() - began, sum(d.count() for d in told))

    def _logged(self, job: str, status: str, phase: str, progress: float, seconds: float, rows: int) -> None:
        line = [(job, status, phase, progress, round(seconds, 3), rows, round(rows / seconds, 3) if seconds else None, time.time_ns() // 1000)]
        self.spark.createDataFrame(line, _TABLES["job_log"]).coalesce(1).write.mode("append").parquet(f"{self.root}/job_log")

    def job_log(self, job: str | None = None) -> DataFrame:
        """job_id, status, phase, progress, seconds, rows, rows_per_second, at of all jobs or one, in order of ``at``."""
        rows = self._read("job_log")
        return rows if job is None else rows.where(F.col("job_id") == job)

    def job_status(self, job: str) -> dict:
        """The last line of a job; one that is not known is an error."""
        last = self.job_log(job).orderBy(F.desc("at")).first()
        if last is None:
            raise KeyError(job)
        return last.asDict()

    def job_events(self, job: str) -> DataFrame:
        """event, status, phase, progress, at of a job for a client that follows it; a single not_found for an unknown one."""
        rows = self.job_log(job).select(F.lit("progress").alias("event"), "status", "phase", "progress", "at")
        return rows if rows.count() else self.spark.createDataFrame([("not_found", None, None, None, None)], "event string, status string, phase string, progress double, at long")

    def list_repos(self) -> DataFrame:
        return catalog.list_repos(self.chunks())

    def delete_repo(self, repo: str, pattern: str = config.REPO_ID) -> None:
        """Drops a repository's index and chunks; an id that isn't one, or a repository that isn't there, is an error."""
        if not re.fullmatch(pattern, repo):
            raise ValueError(f"{repo!r} is no repository's id")
        if not folder_exists(self.spark, f"{self._chunks}/repo_id={repo}"):
            raise KeyError(repo)
        self.index.drop(repo)
        drop_folder(self.spark, f"{self._chunks}/repo_id={repo}")

    def health(self) -> dict[str, str]:
        try:
            self.chunks().limit(1).count()
            return {"status": "ok"}
        except Exception as e:  # noqa: BLE001  any failure to read is the answer
            return {"status": "degraded", "error": str(e).split("\n")[0][:200]}

    def retrieve(self, repo: str, questions: DataFrame, k: int = config.FINAL_K) -> DataFrame:
        """item_id, route, rank, score, dense_score and the chunk, for each of ``questions`` (item_id, question).

        What the two searches found stays in a folder below ``asked``.
        """
        chunks = self.chunks().where(F.col("repo_id") == repo)
        size = chunks.count()
        content = chunks.where("chunk_type <> 'file_manifest'")
        found = intent.target_files(questions, content)
        routed = questions.join(found, "question", "left").withColumn("repo_id", F.lit(repo)).withColumn("route", intent.route(F.col("question"), F.col("target").isNotNull(), F.lit(size)))
        files = routed.where("route = 'file'").join(content, (F.lower("rel_path") == F.lower("target")) & (routed["repo_id"] == content["repo_id"]))
        trees = routed.where("route = 'structure'").join(chunks.where("chunk_type = 'file_manifest'"), "repo_id")
        whole = routed.where("route = 'whole'").join(chunks, "repo_id") if size <= config.SMALL_CORPUS else None
        same = ["item_id", "question", "route", "chunk_id", "rel_path", "language", "chunk_type", "start_line", "end_line", "text"]
        given = files.select(*same).unionByName(trees.select(*same))
        given = given if whole is None else given.unionByName(whole.select(*same))
        rank = F.row_number().over(_order("item_id", *manifest.overview_rank(F.col("rel_path")), "start_line", "chunk_id"))
        given = given.withColumns({"rank": rank.cast("long"), "score": F.lit(1.0), "dense_score": F.lit(1.0)})
        asked = routed.where("route = 'full'").select("item_id", "question", "route")
        docs = chunks.select(F.col("chunk_id").alias("doc_id"), F.col("embed_text").alias("text"))
        stored = chunks.select(F.col("chunk_id").alias("doc_id"), F.col("embedding").alias("v"))
        dense = vectors.top_k(stored, asked.select("item_id", self.embed(F.col("question")).alias("v")), key="doc_id", vector="v", by="item_id", positive=True)
        # each search is worked out once, and what follows is planned from a few rows a question
        at = f"{self.root}/asked/{uuid.uuid4().hex}"
        both = {}
        for name, found in (("dense", dense), ("sparse", self.index.top_k(asked, repo))):
            found.write.parquet(f"{at}/{name}")
            both[name] = self.spark.read.schema(found.schema).parquet(f"{at}/{name}")
        fused = fusion.rrf(both["dense"], both["sparse"].withColumn("doc_id", F.col("doc_id").cast("string")))
        few = fusion.shortcut(fused, k).select("item_id", "doc_id", "score", "rank", "dense_score")
        many = fused.join(few.select("item_id").distinct(), "item_id", "left_anti").join(asked, "item_id").join(docs, "doc_id")
        many = fusion.rerank(many, self.logit(F.col("question"), F.col("text")), k).select("item_id", "doc_id", "score", "rank", "dense_score")
        ranked = few.unionByName(many).join(asked, "item_id").join(chunks, F.col("doc_id") == F.col("chunk_id"))
        cols = ["item_id", "question", "route", "rank", "score", "dense_score", "chunk_id", "rel_path", "language", "chunk_type", "start_line", "end_line", "text"]
        return given.select(*cols).unionByName(ranked.select(*cols))

    def query(self, repo: str, questions: DataFrame) -> DataFrame:
        """item_id, sufficient, prompt, answer; greetings and questions without enough context get a fixed answer and no prompt.

        A question about structure is given the manifests that were found, as far as they fit, and no chunk beside them.
        What was retrieved is worked out once, into a folder of its own.
        """
        size = self.chunks().where(F.col("repo_id") == repo).count()
        found, at = self.retrieve(repo, questions), f"{self.root}/asked/{uuid.uuid4().hex}/all"
        found.write.parquet(at)
        got = self.spark.read.schema(found.schema).parquet(at)
        enough = prompt.sufficient(got, corpus_size=size)
        block = lambda i: prompt.format_chunk(F.col(i), F.col("rel_path"), F.col("start_line"), F.col("end_line"), F.col("chunk_type"), F.col("language"), F.col("text"))
        tree = prompt.format_structure(F.col("text"))
        chunks = got.where("route <> 'structure'")
        kept = prompt.trim_greedy(chunks.withColumn("t", self.count(block("rank"))), "t").join(chunks, ["item_id", "rank"])
        trees = prompt.trim_prefix(got.where("route = 'structure'").withColumn("t", self.count(tree)), "t")
        blocks = kept.select("item_id", F.col("new_rank").alias("rank"), block("new_rank").alias("block")).unionByName(trees.select("item_id", "rank", tree.alias("block")))
        built = prompt.prompt(blocks, questions)
        greets = intent.is_conversational(F.col("question"))
        out = questions.select("item_id", greets.alias("greets")).join(enough, "item_id", "left").join(built, "item_id")
        good = F.coalesce("sufficient", F.lit(False)) & ~F.col("greets")
        answer = F.when(F.col("greets"), GREETING_REPLY).when(good, self.generate(F.col("prompt"))).otherwise(NO_CONTEXT_REPLY)
        return out.select("item_id", good.alias("sufficient"), F.when(good, F.col("prompt")).alias("prompt"), answer.alias("answer"))

    def evaluate(self, repo: str, golden: DataFrame, k: int = 5) -> DataFrame:
        """recall and mrr over ``golden`` (item_id, question, expected_file, expected_symbol, match_mode)."""
        got = self.retrieve(repo, golden.select("item_id", "question"), k).join(golden.drop("question"), "item_id").join(self.chunks().select("chunk_id", "symbol_name"), "chunk_id")
        hits = got.where(evaluate.hit(F.col("match_mode"), F.col("expected_file"), F.col("expected_symbol"), F.col("rel_path"), F.col("symbol_name"))).groupBy("item_id").agg(F.min("rank").alias("first_rank"))
        first = golden.select("item_id").join(hits, "item_id", "left")
        return evaluate.recall(first, [k]).withColumns({"mrr": evaluate.mrr(first).select("mrr").scalar()})


def _order(by: str, *keys):
    from pyspark.sql import Window

    return Window.partitionBy(by).orderBy(*keys)


def _coverage(question, text):
    words = F.array_distinct(X.tokens(question))
    return 4.0 * F.size(F.array_intersect(words, X.tokens(F.left(text, F.lit(config.RERANK_TEXT_CHARS))))) / F.greatest(F.size(words), F.lit(1))
