"""Folders of tables: where they may lie, and removing them."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import SparkSession


def drop_folder(spark: SparkSession, path: str) -> bool:
    """Removes a folder by Spark's own file systems; False if it wasn't there."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def folder_exists(spark: SparkSession, path: str) -> bool:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder)


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share, as the session names it; one of our own only where a single machine is all there is."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    return tempfile.mkdtemp(prefix="corpusloom")
