"""Files of a directory tree: scan, classification, text probe and capped read."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import config


def scan(spark: SparkSession, root: str) -> DataFrame:
    """rel_path, content and length of every file below ``root``."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = F.regexp_replace(F.lit(root.rstrip("/")), "^file:/+", "/")
    path = F.regexp_replace("path", "^file:/+", "/")
    return raw.select(F.substr(path, F.length(base) + 2).alias("rel_path"), "content", "length")


def basename(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def suffix(path: Column) -> Column:
    """The lower-case ending with its dot; a name that only starts with a dot has none."""
    return F.lower(F.regexp_extract(basename(path), r"^.+(\.[^.]+)$", 1))


def language(path: Column) -> Column:
    """By ending, then by the names that have none; null if neither is known."""
    table = F.create_map(*(F.lit(x) for kv in config.LANGUAGES.items() for x in kv))
    names = F.create_map(*(F.lit(x) for kv in config.FILENAMES.items() for x in kv))
    name = F.lower(basename(path))
    return F.coalesce(F.try_element_at(table, suffix(path)), F.when(name.endswith(".r"), "plaintext"), F.try_element_at(names, name))


def is_binary_name(path: Column) -> Column:
    return suffix(path).isin(config.BINARY_EXTENSIONS)


def is_pruned(path: Column) -> Column:
    """Whether a component of the path, the name included, is a directory that is never walked."""
    return F.arrays_overlap(F.split(path, "/"), F.array(*map(F.lit, config.SKIP_DIRS)))


@F.pandas_udf(T.BooleanType())
def _mostly_printable(content: pd.Series) -> pd.Series:
    """The rare branch of the probe: bytes that are no UTF-8."""
    good = set(range(32, 127)) | {9, 10, 13}
    return content.map(lambda b: sum(x in good for x in b) / len(b) >= config.PRINTABLE_RATIO if b else True)


def is_text(content: Column) -> Column:
    """From the first bytes: empty or UTF-8 without NUL is text, other bytes if most are printable."""
    head = F.substring(content, 1, config.PROBE_BYTES)
    valid = F.is_valid_utf8(head.cast("string"))
    has_nul = F.contains(F.hex(head), F.lit("00")) & F.regexp_like(F.hex(head), F.lit("^(..)*?00"))
    # only what is neither empty, nor NUL, nor UTF-8 goes to Python
    odd = F.when(~has_nul & ~valid, head)
    return F.when(F.length(head) == 0, True).when(has_nul, False).when(valid, True).otherwise(_mostly_printable(odd))


def read_capped(content: Column, cap: int = config.MAX_INDEX_FILE_BYTES) -> tuple[Column, Column]:
    """(text of the first ``cap`` bytes with bad bytes replaced, whether more follow)."""
    return F.make_valid_utf8(F.substring(content, 1, cap).cast("string")), F.length(content) > cap


def classify(files: DataFrame, path: str = "rel_path", text: Column | None = None) -> DataFrame:
    """``files`` less pruned paths, with language and status; ``text`` says whether a file of unknown name is text."""
    known = language(F.col(path))
    readable = F.lit(False) if text is None else text
    status = F.when(is_binary_name(F.col(path)), "skipped").when(known.isNotNull() | readable, "indexed").otherwise("skipped")
    kept = files.where(~is_pruned(F.col(path)))
    return kept.withColumn("status", status).withColumn("language", F.when(F.col("status") == "indexed", F.coalesce(known, F.lit("plaintext"))))


def skipped_summary(paths: DataFrame, path: str = "rel_path", repo: str = "repo_id") -> DataFrame:
    """repo, folder, n_files and the four commonest endings of each top folder."""
    from pyspark.sql import Window

    ext = F.when(suffix(F.col(path)) == "", "(no ext)").otherwise(suffix(F.col(path)))
    by = paths.groupBy(F.col(repo), F.split_part(F.col(path), F.lit("/"), F.lit(1)).alias("folder"), ext.alias("ext")).agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy(repo, "folder").orderBy(F.desc("n"), "ext"))
    ranked = by.withColumn("k", rank)
    top = F.array_sort(F.collect_list(F.when(F.col("k") <= 4, F.struct("k", F.concat_ws(" ", F.col("n").cast("string"), "ext").alias("s")))))
    return ranked.groupBy(repo, "folder").agg(F.sum("n").alias("n_files"), F.array_join(F.transform(top, lambda x: x["s"]), ", ").alias("ext_parts"))
