"""Which path belongs to which root. Containment is never a theta join: paths are taken apart and joined by equality.

A path has as many prefixes as segments, so the rows grow with the depth of paths, not with the number of roots.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import paths as P


def longest_prefix_owner(files: DataFrame, roots: DataFrame, path: str, root: str, by: list[str] | None = None, owner: str = "owner", with_root: bool = True) -> DataFrame:
    """``files`` with ``owner``: the longest root that is the path or one of its directories; null for orphans.

    ``by`` are columns that must agree as well, such as the repository. Rows of ``files`` must differ in (by, path).
    """
    by = by or []
    exploded = files.select(*by, path, F.explode(P.prefixes(F.col(path), with_root)).alias("__prefix"))
    r = roots.select(*by, F.col(root).alias("__prefix")).distinct()
    # A semi-join: only the roots can be broadcast, and not by an estimate, as they are shuffled first.
    best = exploded.join(r, [*by, "__prefix"], "left_semi").groupBy(*by, path).agg(F.max_by("__prefix", F.length("__prefix")).alias(owner))
    return files.join(best.hint("merge"), [*by, path], "left")  # as many rows as files: nothing to broadcast


def adopt(orphans: DataFrame, roots: DataFrame, path: str, root: str, by: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows that a root now owns, with owner; rows that stay orphans)."""
    owned = longest_prefix_owner(orphans, roots, path, root, by)
    return owned.where("owner IS NOT NULL"), owned.where("owner IS NULL").drop("owner")


def orphanize(rows: DataFrame, removed: DataFrame, owner: str, key: str) -> DataFrame:
    """Rows whose owner is among the removed lose it; nothing else of them is lost."""
    gone = removed.select(F.col(key).alias("__gone")).distinct()
    return rows.join(gone, rows[owner] == gone["__gone"], "left").withColumn(owner, F.when(F.col("__gone").isNull(), F.col(owner))).drop("__gone")


def suffix_matches(stored: DataFrame, queries: DataFrame, stored_path: str, query_path: str, by: list[str] | None = None) -> DataFrame:
    """Pairs (stored path, query path) that are equal or of which one ends with the other at a segment border; ``exact`` tells equal ones."""
    by = by or []
    s = stored.select(*by, F.col(stored_path).alias("stored")).distinct()
    q = queries.select(*by, F.col(query_path).alias("query")).distinct()
    longer_s = s.select(*by, "stored", F.explode(P.suffixes(F.col("stored"))).alias("query")).join(q, [*by, "query"])
    longer_q = q.select(*by, "query", F.explode(P.suffixes(F.col("query"))).alias("stored")).join(s, [*by, "stored"])
    both = longer_s.select(*by, "stored", "query").union(longer_q.select(*by, "stored", "query")).distinct()
    return both.withColumn("exact", F.col("stored") == F.col("query"))


def lookup(stored: DataFrame, queries: DataFrame, stored_path: str, query_path: str, by: list[str] | None = None, rank: str | None = None) -> DataFrame:
    """For every query path one stored path: an exact one first, then the lowest rank, then the smallest path."""
    by = by or []
    found = suffix_matches(stored, queries, stored_path, query_path, by)
    order = [(~F.col("exact")).alias("a")]
    if rank:
        found = found.join(stored.select(*by, F.col(stored_path).alias("stored"), F.col(rank).alias("__rank")), [*by, "stored"])
        order.append(F.col("__rank").alias("b"))
    return found.groupBy(*by, "query").agg(F.min_by("stored", F.struct(*order, F.col("stored").alias("c"))).alias("stored"))


def leaf_roots(candidates: DataFrame, root: str, by: list[str] | None = None) -> DataFrame:
    """Candidates that contain no other candidate: the ancestors of all candidates are taken off with an anti join."""
    by = by or []
    below = candidates.where(F.col(root) != "/")
    above = below.select(*by, F.explode(P.prefixes(F.col(root), with_self=False)).alias(root)).distinct()
    return candidates.join(above, [*by, root], "left_anti")
