"""Entry points: build a system's tables, take the difference of two commits, merge it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import git
from ..sources.files import scan_tree
from . import boundary, delta, io, tables


def create_from_files(files: DataFrame, filter_unknown: bool = False) -> dict[str, DataFrame]:
    """Tables of any number of repositories from (repo, branch, commit, path, content)."""
    found = boundary.detect(files).select("repo", "branch", "commit", F.col("root").alias("path"), F.col("service_name").alias("name"))
    return tables.extract(files, found, filter_unknown)


def create_from_trees(spark: SparkSession, trees: dict[str, str], branch: str = "", commit: str = "") -> dict[str, DataFrame]:
    """Tables of local directory trees, repository name -> path."""
    files = None
    for repo, path in trees.items():
        one = scan_tree(spark, path, repo, branch, commit, keep_all=True)
        files = one if files is None else files.unionByName(one)
    return create_from_files(files)


def create(spark: SparkSession, config: dict, base: str | None = None, token: str | None = None, work: str = f"./{git.WORK_DIR}") -> dict[str, DataFrame]:
    """Tables of the configured repositories at their commits. Snapshots that are stored below ``base`` are read instead of extracted.

    ``work`` is where the clones lie; on a cluster a folder that all executors share.
    """
    clones = git.prepare(spark, config, work, token)
    names = git.repository_names([r["repoBranchPair"]["repositoryURL"] for r in config["systemRepositories"]])
    files, asked = None, []
    for r in config["systemRepositories"]:
        url, branch = r["repoBranchPair"]["repositoryURL"], r["repoBranchPair"]["branchName"]
        path = clones[(url, branch)]
        key = (names[url], branch, r["commitID"] or git.head(path, branch))
        asked.append(key)
        if base and io.has_snapshot(spark, base, *key):
            continue
        one = git.snapshot(spark, path, key[0], key[2], branch)
        files = one if files is None else files.unionByName(one)
    if base is None:
        return create_from_files(files)
    if files is not None:
        io.write_tables(create_from_files(files), base)
    return io.read_tables(spark, base, asked)


def create_deltas(spark: SparkSession, steps: list[tuple[str, str, str, str, str]]) -> tuple[DataFrame, DataFrame]:
    """(file changes, component changes) of many steps (clone, repo, branch, old commit, new commit) at once, each row with the new commit of its step.

    Trees are compared by blob first; only the contents of files that differ are read.
    """
    changes = None
    for clone, repo, branch, old, new in steps:
        one = git.commit_changes(spark, clone, repo, branch, old, new)
        changes = one if changes is None else changes.unionByName(one)
    return delta.delta_of(changes, ["commit"])


def create_delta(old_files: DataFrame, new_files: DataFrame) -> tuple[DataFrame, DataFrame]:
    return delta.delta(old_files, new_files)


def merge(base_components: DataFrame, component_delta: DataFrame) -> DataFrame:
    return delta.merge_components(base_components, component_delta)


def write_delta(file_changes: DataFrame, components: DataFrame, base: str) -> None:
    """Both tables of a delta as Parquet."""
    file_changes.write.mode("overwrite").parquet(f"{base}/files")
    components.write.mode("overwrite").parquet(f"{base}/components")


def read_delta(spark: SparkSession, base: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{base}/files"), spark.read.parquet(f"{base}/components")


def create_delta_and_write(old_files: DataFrame, new_files: DataFrame, base: str) -> tuple[DataFrame, DataFrame]:
    write_delta(*create_delta(old_files, new_files), base)
    return read_delta(old_files.sparkSession, base)


def merge_and_write(base_components: DataFrame, component_delta: DataFrame, target: str) -> DataFrame:
    """The merged components, written to ``target``, which must be another folder than the base's."""
    merge(base_components, component_delta).write.mode("overwrite").parquet(target)
    return base_components.sparkSession.read.parquet(target)
