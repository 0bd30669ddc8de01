"""The system configuration: which repositories, branches and commits."""

from __future__ import annotations

import json
import re
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import CONFIG
from ..functions.paths import repo_name


def validate(config: dict) -> dict:
    """The configuration itself, or ValueError that names what is wrong. It is always checked, wherever it was read."""
    if not (config.get("systemName") or "").strip():
        raise ValueError("systemName must not be blank")
    repos = config.get("systemRepositories")
    if not repos:
        raise ValueError("systemRepositories must name at least one repository")
    for r in repos:
        pair = (r or {}).get("repoBranchPair") or {}
        url = pair.get("repositoryURL")
        if not url or pair.get("branchName") is None or r.get("commitID") is None:
            raise ValueError("a repository needs repositoryURL, branchName and commitID")
        if not re.fullmatch(r"https://github\.com/.+\.git", url):
            raise ValueError(f"{url} must begin with https://github.com/ and end with .git")
    return config


def read_config_string(text: str) -> dict:
    return validate(json.loads(text))


def read_config_file(path: str) -> dict:
    return read_config_string(Path(path).read_text(encoding="utf-8"))


def config_frame(spark: SparkSession, path: str) -> DataFrame:
    """One row a repository: system, url, branch, commit, repo."""
    c = spark.read.schema(CONFIG).json(path, multiLine=True)
    r = c.select(F.col("systemName").alias("system"), F.explode("systemRepositories").alias("r"))
    r = r.select("system", F.col("r.repoBranchPair.repositoryURL").alias("url"), F.col("r.repoBranchPair.branchName").alias("branch"), F.col("r.commitID").alias("commit"))
    return r.withColumn("repo", repo_name(F.col("url")))
