"""File trees, folder listings and manifest chunks, repository by repository."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import config
from ..functions.text import line_count
from .intent import under_prefix


def distinct_paths(chunks: DataFrame, path: str = "rel_path", by: str = "repo_id") -> DataFrame:
    """by, path of chunks that are no manifests."""
    clean = F.translate(F.col(path), "\\", "/")
    return chunks.where((F.col(path) != "") & ~F.startswith(F.col(path), F.lit(config.MANIFEST_PREFIX))).select(by, clean.alias("path")).distinct()


def tree_lines(paths: DataFrame, by: list[str], path: str = "path") -> DataFrame:
    """by, key, line: the entries of each group's tree; ``key`` sorts them depth first, directories before files.

    Sorting is left to the reader: a group's tree is as long as its listing, and groups are independent.
    """
    steps = F.split(F.col(path), "/")
    n = F.size(steps)
    entry = lambda i: F.struct(F.when(i < n - 1, 0).otherwise(1).alias("isfile"), F.concat(F.get(steps, i), F.when(i < n - 1, "/").otherwise("")).alias("name"))
    prefixes = F.transform(F.sequence(F.lit(1), n), lambda d: F.transform(F.sequence(F.lit(0), d - 1), entry))
    keys = paths.select(*by, F.explode(prefixes).alias("key")).distinct()
    return keys.select(*by, "key", F.concat(F.repeat(F.lit("  "), F.size("key") - 1), F.element_at("key", -1)["name"]).alias("line"))


def tree(paths: DataFrame, by: str = "repo_id", path: str = "path") -> DataFrame:
    """by, line_no, line."""
    number = F.row_number().over(Window.partitionBy(by).orderBy("key"))
    return tree_lines(paths, [by], path).select(by, number.cast("long").alias("line_no"), "line")


def tree_text(paths: DataFrame, by: list[str], path: str = "path") -> DataFrame:
    """by, text: the tree as one text."""
    lines = F.array_sort(F.collect_list(F.struct("key", "line")))
    return tree_lines(paths, by, path).groupBy(*by).agg(F.array_join(F.transform(lines, lambda x: x["line"]), "\n").alias("text"))


def folder_text(paths: DataFrame, prefix: str, by: str = "repo_id", path: str = "path") -> DataFrame:
    """by, n_files, text of a folder in each repository, with a line of its own where it is empty or unknown."""
    root = prefix.replace("\\", "/").strip("/")
    scoped = paths.where(under_prefix(F.col(path), prefix))
    inner = scoped.where(F.lower(path) != root.lower()).select(by, F.substr(F.col(path), F.lit(len(root) + 2)).alias("path"))
    counts = paths.groupBy(by).agg(F.count_if(under_prefix(F.col(path), prefix)).alias("n_files"))
    body = F.when(F.col("n_files") == 0, F.lit(f"(No indexed files under {root}/)")).otherwise(F.concat(F.lit(f"{root}/\n"), F.coalesce("text", F.lit("(no files)"))))
    return counts.join(tree_text(inner, [by]), by, "left").select(by, "n_files", body.alias("text"))


def structure_listing(paths: DataFrame, prefix: str | None, by: str = "repo_id") -> DataFrame:
    """by, text, n_files, end_line of the synthetic chunk that answers a structure question."""
    if prefix:
        out = folder_text(paths, prefix, by)
        head = F.format_string(f"Indexed files under {prefix}/ (%d file(s)):\n", "n_files")
    else:
        out = paths.groupBy(by).agg(F.count("*").alias("n_files")).join(tree_text(paths, [by]), by)
        head = F.format_string("Indexed files in repository (%d file(s)):\n", "n_files")
    out = out.withColumn("text", F.concat(head, "text"))
    return out.select(by, "text", "n_files", line_count(F.col("text")).alias("end_line"))


def skipped_lines(summary: DataFrame, by: str = "repo_id") -> DataFrame:
    """by, summary: the folders of a skipped summary (by, folder, n_files, ext_parts) as lines, one row a repository."""
    line = F.concat(F.lit("  "), F.col("folder"), F.lit("/ — "), F.col("n_files").cast("string"), F.lit(" file(s) ("), F.col("ext_parts"), F.lit(")"))
    rows = F.array_sort(F.collect_list(F.struct("folder", line.alias("line"))))
    return summary.groupBy(by).agg(F.array_join(F.transform(rows, lambda x: x["line"]), "\n").alias("summary"))


def manifest_chunks(paths: DataFrame, by: str = "repo_id", size: int = config.MANIFEST_PATHS, skipped: DataFrame | None = None, truncated: DataFrame | None = None) -> DataFrame:
    """by, batch_no, n_paths, text, end_line: a repository's paths in batches.

    Under the first go the paths of ``truncated`` (by, path), which were read in part, and ``skipped`` (by, summary).  A
    repository that has nothing but skipped files gets one chunk that says so.
    """
    ranked = paths.withColumn("batch_no", F.floor((F.row_number().over(Window.partitionBy(by).orderBy("path")) - 1) / size).cast("long"))
    total = paths.groupBy(by).agg(F.count("*").alias("total"))
    batches = ranked.groupBy(by, "batch_no").agg(F.count("*").alias("n_paths")).join(tree_text(ranked, [by, "batch_no"]), [by, "batch_no"]).join(total, by)
    body = F.concat(F.format_string("Repository file index — searchable text files (%d total):\n", "total"), "text")
    first = F.col("batch_no") == 0
    if truncated is not None:
        named = F.array_join(F.transform(F.array_sort(F.collect_set("path")), lambda p: F.concat(F.lit("  "), p)), "\n")
        head = F.format_string("\n\nPartially indexed (first %d file(s) truncated to size limit):\n", F.count_distinct("path"))
        cut = truncated.groupBy(by).agg(F.concat(head, named).alias("cut"))
        batches = batches.join(cut, by, "left")
        body = F.concat(body, F.when(first, F.coalesce("cut", F.lit(""))).otherwise(""))
    if skipped is not None:
        empty = skipped.join(total, by, "left_anti").where("summary <> ''")
        columns = {"batch_no": F.lit(0).cast("long"), "n_paths": F.lit(0).cast("long"), "text": F.lit("(no searchable files)"), "total": F.lit(0).cast("long")}
        batches = batches.unionByName(empty.select(by).withColumns(columns), allowMissingColumns=True).join(skipped, by, "left")
        body = F.concat(body, F.when(first & (F.col("summary") != ""), F.concat(F.lit("\n\nExcluded from search (binary/non-text — on disk only):\n"), "summary")).otherwise(""))
    return batches.withColumn("text", body).select(by, "batch_no", "n_paths", "text", line_count(F.col("text")).alias("end_line"))


def overview_rank(path: Column) -> list[Column]:
    """Sort keys of a whole small corpus: README first, then path."""
    return [F.when(F.contains(F.lower(path), F.lit("readme")), 0).otherwise(1), F.lower(path)]
