"""Paths as columns. Paths are normalised once, at ingest; all joins then compare plain strings."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

CLONE_DIR = "clone"


def normalize(path: Column) -> Column:
    """Trim, forward slashes, no file: scheme, no leading ./, no doubled or trailing slash (but a lone / stays)."""
    p = F.translate(F.trim(path), "\\", "/")
    p = F.regexp_replace(p, r"^file:(//)?", "")
    p = F.regexp_replace(p, r"^(\./)+", "")
    p = F.regexp_replace(p, "/+", "/")
    return F.when(F.length(p) > 1, F.regexp_replace(p, "/$", "")).otherwise(p)


def absolute(path: Column) -> Column:
    """A normalised path with a leading slash; blank and '.' are the root."""
    p = normalize(path)
    return F.when(F.trim(p).isin("", "."), "/").when(p.startswith("/"), p).otherwise(F.concat(F.lit("/"), p))


def repo_relative(path: Column, repo: Column | str) -> Column:
    """What follows ``clone/<repo>`` in the path, as an absolute path within the repository; other paths only get normalised.

    A null path stays null and a blank one stays blank.
    """
    repo = F.lit(repo) if isinstance(repo, str) else repo
    p = normalize(path)
    marker = F.concat(F.lit(f"{CLONE_DIR}/"), repo)
    at = F.instr(p, F.concat(F.lit("/"), marker))
    inside = F.when(at > 0, F.substr(p, at + F.length(marker) + 1)).when(
        (p == marker) | p.startswith(F.concat(marker, F.lit("/"))), F.substr(p, F.length(marker) + 1)
    )
    return F.when(F.trim(p) == "", p).otherwise(absolute(F.coalesce(inside, p)))


def local_path(path: Column, repo: Column | str, base: str = f"./{CLONE_DIR}") -> Column:
    """The place of a repository path in the local clone."""
    return F.concat(F.lit(f"{base}/"), F.lit(repo) if isinstance(repo, str) else repo, absolute(path))


def parts(path: Column) -> Column:
    return F.filter(F.split(path, "/"), lambda x: x != "")


def suffixes(path: Column) -> Column:
    """All suffixes at segment borders, longest first, each with a leading slash."""
    p = parts(path)
    whole = F.transform(F.sequence(F.lit(1), F.size(p)), lambda i: F.concat(F.lit("/"), F.array_join(F.slice(p, i, F.size(p)), "/")))
    return F.when(F.size(p) > 0, whole).otherwise(F.array().cast("array<string>"))


def prefixes(path: Column, with_root: bool = True, with_self: bool = True) -> Column:
    """All prefixes at segment borders, shortest first; the root is /."""
    p = parts(path)
    last = F.size(p) if with_self else F.size(p) - 1
    inner = F.when(last >= 1, F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.concat(F.lit("/"), F.array_join(F.slice(p, F.lit(1), i), "/")))).otherwise(F.array().cast("array<string>"))
    return F.concat(F.array(F.lit("/")), inner) if with_root else inner


def last_segment(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def service_name(path: Column) -> Column:
    """The last segment of a path below the clone folder; null for any other path."""
    inside = normalize(path).rlike(rf"(^|/){CLONE_DIR}/[^/]+")
    return F.when(inside, last_segment(normalize(path)))


def directory(path: Column) -> Column:
    return F.regexp_replace(path, r"/[^/]*$", "")


def node_name(path: Column) -> Column:
    """The file's name without .java."""
    return F.regexp_replace(last_segment(path), r"\.java$", "")


def has_segment(path: Column, names: list[str]) -> Column:
    return F.arrays_overlap(F.split(path, "/"), F.array(*[F.lit(n) for n in names]))


def repo_name(url: Column) -> Column:
    """Between the last slash and the last dot of a repository address."""
    return F.regexp_extract(url, r"([^/]+)\.[^./]*$", 1)


def normalize_text(path: str | None) -> str | None:
    """``normalize`` for driver-side code."""
    if path is None:
        return None
    p = re.sub(r"^file:(//)?", "", path.strip(" ").replace("\\", "/"))
    p = re.sub("/+", "/", re.sub(r"^(\./)+", "", p))
    return p[:-1] if len(p) > 1 and p.endswith("/") else p
