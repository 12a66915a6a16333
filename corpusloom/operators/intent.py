"""What a question asks for: greeting, structure, a folder, a file; and the route that follows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import config

#: Longest endings first, so that config.json is not read as config.js.
_TARGET = r"([\w./\\-]+\.(?:" + "|".join(sorted(config.TARGET_EXTENSIONS, key=lambda e: (-len(e), e))) + r"))\b"
_README = r"\breadme\b(?!\s+(?:folder|directory|dir)\b)"


def _like(q: Column, pattern: str) -> Column:
    return F.rlike(F.trim(q), F.lit(f"(?i){pattern}"))


def is_conversational(q: Column) -> Column:
    return _like(q, config.GREETING)


def mentions_file(q: Column) -> Column:
    return _like(q, _TARGET) | _like(q, _README)


def is_structure(q: Column) -> Column:
    return (F.trim(q) != "") & ~mentions_file(q) & _like(q, config.STRUCTURE)


def folder_prefix(q: Column) -> Column:
    """The folder that a question names, or null."""
    text = F.trim(q)
    stripped = F.regexp_replace(text, f"(?i){config.STRUCTURE_PHRASES}", " ")
    name = F.replace(F.trim(F.regexp_replace(F.trim(F.regexp_extract(stripped, f"(?i){config.FOLDER}", 1)), "^/+|/+$", "")), F.lit("\\"), F.lit("/"))
    whole = (stripped != text) & ~F.rlike(text, F.lit(f"(?i){config.FOLDER_CUE}"))
    bad = whole | (name == "") | F.lower(name).isin(config.NOT_FOLDERS) | F.contains(F.regexp_extract(name, r"([^/]*)$", 1), F.lit("."))
    return F.when(~bad, name)


def normalize_path(p: Column) -> Column:
    return F.regexp_replace(F.trim(F.translate(p, "\\", "/")), "^/+|/+$", "")


def under_prefix(path: Column, prefix: str) -> Column:
    """Whether a path is a folder or lies below it, without case; an empty prefix holds all."""
    x = prefix.replace("\\", "/").strip().strip("/").lower()
    return F.lit(True) if not x else (F.lower(path) == x) | F.startswith(F.lower(path), F.lit(f"{x}/"))


def target_files(questions: DataFrame, paths: DataFrame, question: str = "question", path: str = "rel_path") -> DataFrame:
    """question, target: the first file name of a question that a known path has.

    A name is tried as a whole path, then as a base name (the last path with it), then as a path's end; each rule is
    an equality join on a key that paths are exploded to, not a comparison of all questions with all paths.
    """
    q = F.trim(F.col(question))
    names = F.transform(F.regexp_extract_all(q, F.lit(f"(?i){_TARGET}"), F.lit(1)), lambda n: F.lower(normalize_path(n)))
    names = F.concat(names, F.when(_like(F.col(question), _README), F.array(F.lit("readme"))).otherwise(F.array().cast("array<string>")))
    asked = questions.select(question, F.posexplode(names).alias("pos", "name"))
    base = lambda p: F.regexp_extract(p, r"([^/]*)$", 1)
    probes = asked.select(question, "pos", F.explode(F.array(F.struct(F.lit(0).alias("rule"), F.col("name").alias("key")), F.struct(F.lit(1).alias("rule"), base(F.col("name")).alias("key")), F.struct(F.lit(2).alias("rule"), F.col("name").alias("key")))).alias("p")).select(question, "pos", "p.*")
    known = paths.select(F.col(path).alias("path")).distinct().withColumn("low", F.lower(normalize_path(F.col("path"))))
    steps = F.split("low", "/")
    ends = F.transform(F.sequence(F.lit(1), F.size(steps)), lambda i: F.array_join(F.slice(steps, i, F.size(steps)), "/"))
    whole = known.select(F.lit(0).alias("rule"), F.col("low").alias("key"), "path").groupBy("rule", "key").agg(F.max("path").alias("path"))
    named = known.select(F.lit(1).alias("rule"), base(F.col("low")).alias("key"), "path").groupBy("rule", "key").agg(F.max("path").alias("path"))
    ended = known.select(F.lit(2).alias("rule"), F.explode(ends).alias("key"), "path").groupBy("rule", "key").agg(F.min("path").alias("path"))
    hits = probes.join(whole.unionByName(named).unionByName(ended), ["rule", "key"])
    return hits.groupBy(question).agg(F.min_by("path", F.struct("pos", "rule")).alias("target"))


def route(question: Column, has_target: Column, corpus_size: Column, small: int = config.SMALL_CORPUS) -> Column:
    """Greeting, file, structure, whole (small corpora) or full."""
    return F.when(is_conversational(question), "conversational").when(has_target, "file").when(is_structure(question), "structure").when(corpus_size <= small, "whole").otherwise("full")
