"""Directory trees as rows: one per file, pruned by name before contents are read."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import paths as P
from ..functions.source_text import is_valid_file


def scan_tree(spark: SparkSession, root: str, repo: str, branch: str = "", commit: str = "", keep_all: bool = False) -> DataFrame:
    """(repo, branch, commit, path, content) of the files below ``root``; paths are absolute within the repository.

    Only file names are looked at before the filter; contents are read by executors. ``keep_all`` leaves the filter out, for detection, which
    looks at Helm charts and all manifests.
    """
    if not os.path.isdir(root):
        raise NotADirectoryError(f"{root} must exist and be a directory")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load("file://" + os.path.abspath(root))
    prefix = "file:" + os.path.abspath(root)
    files = files.select("path", "content").withColumn("path", P.absolute(F.substr(F.regexp_replace("path", "^file:/+", "file:/"), F.lit(len(prefix) + 1))))
    files = files if keep_all else files.where(is_valid_file(F.col("path")))
    return files.select(F.lit(repo).alias("repo"), F.lit(branch).alias("branch"), F.lit(commit).alias("commit"), "path", F.decode("content", "UTF-8").alias("content"))
