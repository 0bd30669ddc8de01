"""Git as a source. Only the control plane runs on the driver: clone, log, and listing what two commits differ in.

Working trees are never switched: a snapshot is read from the object store by commit, so two commits can be read at once.
"""

from __future__ import annotations

import os
import shutil
import subprocess
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.roles import change_type
from ..functions.source_text import stripped

WORK_DIR = "clone"
ENV = {"GIT_TERMINAL_PROMPT": "0", "GIT_ASKPASS": "true"}


class GitError(RuntimeError):
    pass


def _git(*args: str, cwd: str | None = None, token: str | None = None) -> str:
    env = os.environ | ENV
    if token:  # in the environment, so that it is in no process list and no Spark configuration
        env |= {"GIT_CONFIG_COUNT": "1", "GIT_CONFIG_KEY_0": "http.https://github.com/.extraheader", "GIT_CONFIG_VALUE_0": f"Authorization: Bearer {token}"}
    done = subprocess.run(["git", *args], cwd=cwd, env=env, capture_output=True, text=True, errors="replace")
    if done.returncode:
        raise GitError(first_lines(done.stderr, token))
    return done.stdout


def first_lines(text: str, secret: str | None = None, n: int = 3) -> str:
    lines = [x.strip() for x in text.splitlines() if x.strip()][:n]
    joined = " ".join(lines)
    return joined.replace(secret, "***") if secret else joined


def fetch_token(variable: str = "GIT_ACCESS_TOKEN") -> str | None:
    """The access token from the driver's environment; None if there is none."""
    return os.environ.get(variable) or None


def is_repository(path: str) -> bool:
    try:
        return _git("rev-parse", "--git-dir", cwd=path).strip() in (".git", ".")
    except (GitError, OSError):
        return False


def check_access(urls: list[str], token: str | None = None) -> None:
    """One error that names all repositories that can't be read."""
    failed = []
    for url in urls:
        try:
            _git("ls-remote", "--heads", url, token=token)
        except GitError as e:
            failed.append(f"{url}: {e}")
    if failed:
        raise GitError("; ".join(failed))


def clone(url: str, path: str, token: str | None = None) -> str:
    """A clone at ``path``: an existing valid one stays, an invalid one is replaced."""
    if os.path.exists(path) and not is_repository(path):
        remove_tree(path)
    if not os.path.exists(path):
        _git("clone", "--quiet", "--no-checkout", url, path, token=token)
    return path


def remove_tree(path: str, inside: str = WORK_DIR) -> None:
    """Delete a tree, but only inside a folder of the given name."""
    if inside not in os.path.abspath(path).split(os.sep):
        raise ValueError(f"{path} isn't inside a folder named {inside}")
    shutil.rmtree(path, ignore_errors=True)


def prepare(spark: SparkSession, config: dict, base: str = f"./{WORK_DIR}", token: str | None = None) -> dict[tuple[str, str], str]:
    """(url, branch) -> path of the clone, for every repository of the configuration."""
    pairs = [r["repoBranchPair"] for r in config["systemRepositories"]]
    urls = sorted({p["repositoryURL"] for p in pairs})
    names = repository_names(urls)
    try:
        check_access(urls, token)
    except GitError:
        for u in urls:
            remove_tree(os.path.join(base, names[u]))
        raise
    made = {u: clone(u, os.path.join(base, names[u]), token) for u in urls}
    return {(p["repositoryURL"], p["branchName"]): made[p["repositoryURL"]] for p in pairs}


def repository_names(urls: list[str]) -> dict[str, str]:
    """The last part of each address, with as many parts before it as it takes to tell all addresses apart."""
    parts = {u: [x for x in u.rstrip("/").removesuffix(".git").replace(":", "/").split("/") if x] for u in set(urls)}
    out = {}
    for u, own in parts.items():
        n = 1
        while n < len(own) and any(v != u and other[-n:] == own[-n:] for v, other in parts.items()):
            n += 1
        out[u] = "_".join(own[-n:])
    return out


def head(path: str, branch: str = "") -> str:
    """The newest commit of a branch, as the remote has it before a local one; without branch, of what HEAD names."""
    for name in [f"refs/remotes/origin/{branch}", f"refs/heads/{branch}"] if branch else ["HEAD"]:
        try:
            return _git("rev-parse", "--verify", "--quiet", name, cwd=path).strip()
        except GitError:
            continue
    raise GitError(f"no branch {branch} in {path}")


def log(spark: SparkSession, path: str, repo: str, revision: str = "HEAD") -> DataFrame:
    """(repo, ordinal, commit, parent, time, subject), newest first."""
    lines = _git("log", "--format=%H%x1f%P%x1f%ct%x1f%s", revision, cwd=path).splitlines()
    rows = [(repo, i, *line.split("\x1f", 3)) for i, line in enumerate(lines)]
    d = spark.createDataFrame(rows, "repo string, ordinal int, commit string, parents string, time string, subject string")
    return d.select("repo", "ordinal", "commit", F.regexp_extract("parents", "^([0-9a-f]+)", 1).alias("parent"), F.timestamp_seconds(F.col("time").cast("long")).alias("time"), "subject")


def tree(spark: SparkSession, path: str, repo: str, commit: str, branch: str = "") -> DataFrame:
    """(repo, branch, commit, path, blob) of all files of a commit."""
    rows = []
    for line in _git("ls-tree", "-r", "-z", "--full-tree", commit, cwd=path).split("\0"):
        if line:
            meta, name = line.split("\t", 1)
            rows.append((repo, branch, commit, "/" + name, meta.split()[2]))
    return spark.createDataFrame(rows, "repo string, branch string, commit string, path string, blob string")


def with_content(files: DataFrame, clone_path: str) -> DataFrame:
    """``files`` (with blob) plus content: each task asks one git process for the blobs of its rows. Clones must be on a shared folder."""
    from pyspark.sql import types as T

    schema = T.StructType([*files.schema.fields, T.StructField("content", T.StringType())])
    at = files.columns.index("blob")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with subprocess.Popen(["git", "cat-file", "--batch"], cwd=clone_path, stdin=subprocess.PIPE, stdout=subprocess.PIPE) as p:
            for b in batches:
                made = []
                for blob in b[at].to_pylist():
                    if blob is None:
                        made.append(None)
                        continue
                    p.stdin.write(blob.encode() + b"\n")
                    p.stdin.flush()
                    header = p.stdout.readline().split()
                    if header[-1] == b"missing":
                        made.append("")
                        continue
                    raw = p.stdout.read(int(header[2]))
                    p.stdout.read(1)
                    made.append(raw.decode("utf-8", "replace"))
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(made, pa.string())], schema.names)
            p.stdin.close()

    return files.mapInArrow(run, schema)


def snapshot(spark: SparkSession, clone_path: str, repo: str, commit: str, branch: str = "", keep=None) -> DataFrame:
    """Files of a commit with contents; ``keep`` is a condition on the path that is applied before contents are read."""
    files = tree(spark, clone_path, repo, commit, branch)
    files = files if keep is None else files.where(keep)
    return with_content(files, clone_path).select("repo", "branch", "commit", "path", "content")


def tree_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """(repo, branch, path, change_type) of files that differ between two trees, by blob."""
    o, n = old.select("repo", "branch", "path", F.col("blob").alias("old_blob")), new.select("repo", "branch", "path", F.col("blob").alias("new_blob"))
    both = o.join(n, ["repo", "branch", "path"], "full_outer").where(~F.col("old_blob").eqNullSafe(F.col("new_blob")))
    letter = F.when(F.col("old_blob").isNull(), "A").when(F.col("new_blob").isNull(), "D").otherwise("M")
    return both.select("repo", "branch", "path", change_type(letter).alias("change_type"), "old_blob", "new_blob")


def code_changes(old: DataFrame, new: DataFrame, string_aware: bool = False) -> DataFrame:
    """(repo, branch, path, change_type, old_content, new_content) of files that differ, without Java files that differ in comments and white space only."""
    o = old.select("repo", "branch", "path", F.col("content").alias("old_content"))
    n = new.select("repo", "branch", "path", F.col("content").alias("new_content"))
    both = o.join(n, ["repo", "branch", "path"], "full_outer").where(~F.col("old_content").eqNullSafe(F.col("new_content")))
    kind = F.when(F.col("old_content").isNull(), "ADD").when(F.col("new_content").isNull(), "DELETE").otherwise("MODIFY")
    return _code_only(both.withColumn("change_type", kind), string_aware).select("repo", "branch", "path", "change_type", "old_content", "new_content")


def _code_only(changes: DataFrame, string_aware: bool) -> DataFrame:
    cosmetic = (F.col("change_type") == "MODIFY") & F.endswith("path", F.lit(".java")) & (stripped(F.col("old_content"), string_aware) == stripped(F.col("new_content"), string_aware))
    return changes.where(~cosmetic)


def commit_changes(spark: SparkSession, clone_path: str, repo: str, branch: str, old: str, new: str, string_aware: bool = False) -> DataFrame:
    """As ``code_changes`` between two commits, with the column commit (the new one): the trees are compared by blob, and only contents that differ are read."""
    differ = tree_diff(tree(spark, clone_path, repo, old, branch), tree(spark, clone_path, repo, new, branch))
    sides = differ.withColumnRenamed("old_blob", "blob")
    sides = with_content(sides, clone_path).withColumnsRenamed({"blob": "old_blob", "content": "old_content", "new_blob": "blob"})
    sides = with_content(sides, clone_path).withColumnRenamed("content", "new_content")
    out = _code_only(sides, string_aware)
    return out.select("repo", "branch", F.lit(new).alias("commit"), "path", "change_type", "old_content", "new_content")
