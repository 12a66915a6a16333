"""Incremental index of a growing table of documents: chunks, and one embedding for each distinct chunk.

    python -m jobs.index_documents DOCUMENTS OUTPUT CHECKPOINT --config jobs/index_documents.json

DOCUMENTS is a Parquet table (doc_id, text, lang, source, ...) that other jobs add files to.  Each run takes the files
that no run has taken yet, as the checkpoint knows them, and ends.  A document's source is its repository, and its
path is made of source, language and id.  OUTPUT holds

- ``chunks``, by repo_id and batch: line windows that aren't blank, with the hash of the text that is embedded;
- ``files``, by batch: every file that a batch brought, with the hash of its text and the number of its chunks;
- ``vectors``, by batch: the embedding of every chunk hash that no batch before has embedded;
- ``log``, by batch: rows read, left out, files, chunks, embedded.

A batch that is run again replaces its own partitions and nothing else, so a job that is stopped at any point can
be started again.  A file that comes again is replaced as a whole: ``current`` reads the last version of each.

Rows without an id or a text are left out and counted.  Of several texts that one batch brings for one path, that with
the greatest hash stands; copies of one row count once.  A null source or language is written as ``unknown``.
"""

from __future__ import annotations

import sys
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom import config
from corpusloom.functions import text as X
from corpusloom.operators import chunking, vectors
from corpusloom.sources.storage import folder_exists
from corpusloom.sources.tables import as_files
from jobs.common import command, log


TABLES = {
    "chunks": "doc_id long, rel_path string, lang string, text_hash string, chunk_no long, start_line long, end_line long, text string, content_hash string, n_tokens long, repo_id string, batch int",
    "files": "repo_id string, rel_path string, text_hash string, n_chunks long, batch int",
    "vectors": "content_hash string, embedding array<double>, batch int",
    "log": "rows_read long, left_out long, files long, chunks long, embedded long, batch int",
}


def _read(spark: SparkSession, output: str, name: str) -> DataFrame:
    """A table as it stands, with its own types whatever its partitions look like; empty before the first batch."""
    path = f"{output}/{name}"
    return spark.read.schema(TABLES[name]).parquet(path) if folder_exists(spark, path) else spark.createDataFrame([], TABLES[name])


def _put(rows: DataFrame, path: str, *by: str) -> None:
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def _batch(output: str, cut: Callable[[DataFrame], DataFrame], embed: Callable[[Column], Column]):
    def write(rows: DataFrame, number: int) -> None:
        spark = rows.sparkSession
        known = rows.where("doc_id is not null and text is not null").withColumns({c: F.coalesce(c, F.lit("unknown")) for c in ("source", "lang")})
        files = as_files(known).withColumn("text_hash", F.sha2("text", 256))
        body = X.embed_text(F.col("rel_path"), F.col("text"))
        chunks = cut(files).withColumns({"content_hash": X.content_hash(body), "n_tokens": X.token_count(F.col("text")), "batch": F.lit(number)})
        _put(chunks, f"{output}/chunks", "repo_id", "batch")
        # empty batches leave no partition, so what was written is read by the batch's own number
        written = _read(spark, output, "chunks").where(F.col("batch") == number)
        counts = written.groupBy("repo_id", "rel_path", "text_hash").agg(F.count_distinct("chunk_no").alias("n_chunks"))
        listed = files.select("repo_id", "rel_path", "text_hash").distinct().join(counts, ["repo_id", "rel_path", "text_hash"], "left")
        _put(listed.select("repo_id", "rel_path", "text_hash", F.coalesce("n_chunks", F.lit(0)).cast("long").alias("n_chunks"), F.lit(number).alias("batch")), f"{output}/files", "batch")
        fresh = written.select("content_hash", X.embed_text(F.col("rel_path"), F.col("text")).alias("body"))
        if number:  # a batch that runs again doesn't take its own vectors for old ones
            old = _read(spark, output, "vectors").where(F.col("batch") < number)
            fresh = fresh.join(old.select("content_hash"), "content_hash", "left_anti")
        fresh = fresh.groupBy("content_hash").agg(F.first("body").alias("body"))
        _put(fresh.select("content_hash", embed(F.col("body")).cast("array<double>").alias("embedding"), F.lit(number).alias("batch")), f"{output}/vectors", "batch")
        took = rows.agg(F.count("*").alias("rows_read"), F.count_if(F.col("doc_id").isNull() | F.col("text").isNull()).alias("left_out"))
        own = [_read(spark, output, t).where(F.col("batch") == number).agg(F.count("*").alias("n")) for t in ("files", "chunks", "vectors")]
        # one row each
        line = took.select("*", *(t.scalar().alias(n) for t, n in zip(own, ("files", "chunks", "embedded"), strict=True)), F.lit(number).alias("batch"))
        _put(line, f"{output}/log", "batch")
        r = _read(spark, output, "log").where(F.col("batch") == number).first()
        log.info("batch %d: read %d rows, left out %d; wrote %d files, %d chunks, %d vectors", number, r.rows_read, r.left_out, r.files, r.chunks, r.embedded)

    return write


def run(
    spark: SparkSession, documents: str, output: str, checkpoint: str, window_lines: int = config.WINDOW_LINES, stride_lines: int = config.STRIDE_LINES, max_chunks_per_file: int = config.MAX_CHUNKS_PER_FILE, files_per_batch: int = 1000,
    embed: Callable[[Column], Column] | None = None,
) -> DataFrame:
    """Takes what is new in ``documents`` into ``output`` and returns the current chunks; ``embed`` gives the vector of a text."""
    cut = lambda files: chunking.windows(files, caps=[max_chunks_per_file], size=window_lines, stride=stride_lines)
    # a pattern may match one file as well as a folder; a plain path must be a folder
    matched = documents if any(c in documents for c in "*?[{") else f"{documents.rstrip('/')[:-1]}[{documents.rstrip('/')[-1]}]"
    source = spark.readStream.schema(spark.read.parquet(documents).schema).option("maxFilesPerTrigger", files_per_batch).parquet(matched)
    log.info("reading %s, writing %s, checkpoint %s", documents, output, checkpoint)
    query = source.writeStream.foreachBatch(_batch(output.rstrip("/"), cut, embed or vectors.embed)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return current(spark, output)


def current(spark: SparkSession, output: str) -> DataFrame:
    """The chunks of the last version of each file, once each, with the number of vectors stored for them (one)."""
    chunks, files, stored = (_read(spark, output.rstrip("/"), t) for t in ("chunks", "files", "vectors"))
    last = files.groupBy("repo_id", "rel_path").agg(F.max(F.struct("batch", "text_hash")).alias("v")).select("repo_id", "rel_path", "v.*")
    rows = chunks.join(last, ["repo_id", "rel_path", "batch", "text_hash"], "left_semi").dropDuplicates(["repo_id", "rel_path", "chunk_no"])
    counts = stored.groupBy("content_hash").agg(F.count("*").alias("n_vectors"))
    return rows.join(counts, "content_hash", "left").select("repo_id", "rel_path", "chunk_no", "start_line", "end_line", "n_tokens", "content_hash", "n_vectors")


if __name__ == "__main__":
    sys.exit(command("index_documents", __doc__.split("\n")[0], ["documents", "output", "checkpoint"], run))
