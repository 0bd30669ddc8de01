"""Text of source and configuration files as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

VALID_SUFFIXES = ".java pom.xml build.gradle build.gradle.kts settings.gradle settings.gradle.kts .properties .yml .yaml Dockerfile DockerFile".split()
IGNORED_DIRS = "target build out node_modules .git .idea .gradle .mvn".split()


def is_valid_file(path: Column, suffixes: list[str] | None = None, excluded: str = ".github") -> Column:
    """Not under the excluded name, and of a known kind."""
    found = F.lit(False)
    for s in VALID_SUFFIXES if suffixes is None else suffixes:
        found = found | F.endswith(path, F.lit(s))
    return ~F.contains(path, F.lit(excluded)) & found


def is_config_file(path: Column) -> Column:
    return is_valid_file(path) & ~F.endswith(path, F.lit(".java"))


def in_ignored_dir(path: Column, names: list[str] | None = None) -> Column:
    """Does a directory of a repository-relative path have an ignored name? The file's own name doesn't count, nor does the root's."""
    dirs = F.split(F.regexp_replace(path, "/?[^/]*$", ""), "/")
    return F.arrays_overlap(dirs, F.array(*[F.lit(n) for n in (IGNORED_DIRS if names is None else names)]))


def stripped(text: Column, string_aware: bool = False) -> Column:
    """The text without comments and white space, for telling cosmetic changes.

    Comment marks inside string literals count as comments, too, unless ``string_aware``.
    """
    if string_aware:
        text = F.regexp_replace(text, r"""("(?:\\.|[^"\\\n])*"|'(?:\\.|[^'\\\n])*')|//[^\n]*|/\*(?s:.*?)\*/""", "$1")
        return F.regexp_replace(text, r"\s+", "")
    return F.regexp_replace(text, r"//[^\n]*|/\*(?s:.*?)\*/|\s+", "")


def count_occurrences(text: Column, part: str) -> Column:
    """How often the pattern ``part`` splits the text."""
    return (F.size(F.split(text, part, -1)) - 1).cast("long")


def unquoted(text: Column) -> Column:
    """Without one pair of outer double quotes."""
    quoted = F.startswith(text, F.lit('"')) & F.endswith(text, F.lit('"')) & (F.length(text) >= 2)
    return F.when(quoted, F.substr(text, F.lit(2), F.length(text) - 2)).otherwise(text)


def non_blank(text: Column) -> Column:
    return F.nullif(F.trim(text), F.lit(""))


def first_lines(text: Column, n: int = 3, secret: Column | None = None) -> Column:
    """The first non-blank lines, trimmed, joined by a space; a secret is replaced by ***."""
    lines = F.slice(F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: x != ""), 1, n)
    joined = F.array_join(lines, " ")
    return joined if secret is None else F.when(F.length(secret) > 0, F.replace(joined, secret, F.lit("***"))).otherwise(joined)


def import_package(name: Column) -> Column:
    return F.regexp_extract(name, r"^(.*)\.[^.]+$", 1)


def import_object(name: Column) -> Column:
    return F.regexp_extract(name, r"([^.]+)$", 1)


def imports_whole_package(name: Column) -> Column:
    return import_object(name) == "*"


def annotation_contents(attributes: Column) -> Column:
    """k=v,... in the order of the keys."""
    entries = F.array_sort(F.map_entries(attributes))
    return F.array_join(F.transform(entries, lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",")


def has_deployment_kind(text: Column) -> Column:
    """A line of its own that says kind: Deployment."""
    return F.exists(F.split(text, "\n"), lambda line: line.rlike(r"^\s*kind\s*:\s*Deployment\s*$"))
