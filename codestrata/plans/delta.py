"""Differences between two snapshots of a system, by file and by component, and their application."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import paths as P
from ..operators import diff as D
from ..operators.ownership import longest_prefix_owner
from .boundary import BUILD_FILES, detect
from .tables import parse_sources

COMPONENT_KEY = ["repo", "branch", "path", "kind", "component_id", "copy"]


def component_rows(parsed: DataFrame, more: list[str] | None = None) -> DataFrame:
    """(repo, branch, path, kind, component_id, copy, parent_component_id, payload): every component of a snapshot, flat. ``more`` names columns that are kept beside the branch.

    ``copy`` numbers components that share an id (overloads, repeated calls) in their order, so that none is lost. The payload
    is canonical JSON without places, so that moved code doesn't count as changed.
    """
    at = ["repo", "branch", *(more or [])]
    p = parsed.where("class.parse_error IS NULL")
    top = F.concat_ws(".", F.nullif("class.package", F.lit("")), "class.name")
    header = ["package", "name", "class_type", "protection", "is_static", "is_final", "is_abstract", "extended_types", "implemented_types", "enum_constants", "class_annotations"]
    out = p.select(*at, "path", F.lit("class").alias("kind"), top.alias("component_id"), F.lit(0).alias("ordinal"), F.lit(None).cast("string").alias("parent_component_id"), F.to_json(F.struct(*[F.col(f"class.{h}") for h in header])).alias("payload"))
    kinds = {
        "method": ("methods", F.col("c.component_id"), F.col("c.parent_component_id"), ["name", "return_type", "protection", "is_static", "is_final", "is_abstract", "thrown", "parameters", "annotations"]),
        "call": ("calls", F.col("c.component_id"), F.col("c.parent_component_id"), ["name", "object_name", "object_type", "called_from", "arguments", "url_argument"]),
        "field": ("fields", F.col("c.component_id"), top, ["name", "field_type", "protection", "is_static", "is_final", "initializer"]),
        "import": ("imports", F.concat(top, F.lit("&"), F.col("c.package"), F.lit("."), F.col("c.object")), top, ["package", "object", "is_static"]),
        "annotation": ("annotations", F.concat(top, F.lit("&"), F.col("c.owner_id"), F.lit("@"), F.col("c.name")), top, ["name", "attributes", "owner_kind", "owner_id"]),
    }
    for kind, (column, cid, parent, fields) in kinds.items():
        d = p.select("*", F.explode(f"class.{column}").alias("c"))
        out = out.unionByName(d.select(*at, "path", F.lit(kind).alias("kind"), cid.alias("component_id"), F.col("c.ordinal").alias("ordinal"), parent.alias("parent_component_id"), F.to_json(F.struct(*[F.col(f"c.{x}") for x in fields])).alias("payload")))
    # Components of one id are within one file: the group is as small as the file.
    g = out.groupBy(*at, "path", "kind", "component_id").agg(F.array_sort(F.collect_list(F.struct("ordinal", "parent_component_id", "payload"))).alias("all"))
    return g.select(*at, "path", "kind", "component_id", F.posexplode("all").alias("copy", "x")).select(*at, "path", "kind", "component_id", "copy", "x.parent_component_id", "x.payload")


def file_changes(changes: DataFrame) -> DataFrame:
    """Of ``git.code_changes``: files that count, without a root pom.xml."""
    from ..functions.source_text import is_valid_file

    return changes.where(is_valid_file(F.col("path")) & (F.col("path") != "/pom.xml"))


def component_delta(old_components: DataFrame, new_components: DataFrame, more: list[str] | None = None) -> DataFrame:
    """(repo, branch, path, kind, component_id, copy, change_type, old_*, new_*) of all repositories and branches at once."""
    return D.diff(old_components, new_components, [*(more or []), *COMPONENT_KEY], ["parent_component_id", "payload"])


def delta(old_files: DataFrame, new_files: DataFrame, string_aware: bool = False) -> tuple[DataFrame, DataFrame]:
    """(file changes, component changes) between two snapshots; only files that changed in more than comments and space are parsed."""
    from ..sources.git import code_changes

    return delta_of(code_changes(old_files, new_files, string_aware))


def delta_of(changes: DataFrame, more: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(file changes, component changes) from (repo, branch, path, change_type, old_content, new_content) and the columns ``more``, which tell steps apart."""
    more = more or []
    changed = file_changes(changes)
    commit = [] if "commit" in more else [F.lit("").alias("commit")]
    side = lambda name: changed.where(f"{name}_content IS NOT NULL").select("repo", "branch", *more, *commit, "path", F.col(f"{name}_content").alias("content"))
    old, new = (component_rows(parse_sources(side(name)), more) for name in ("old", "new"))
    return changed.select("repo", "branch", *more, "path", "change_type"), component_delta(old, new, more)


def merge_components(base: DataFrame, components: DataFrame) -> DataFrame:
    """``base`` after the component changes."""
    return D.apply(base, components, COMPONENT_KEY)


def build_changes(changes: DataFrame, services: DataFrame) -> DataFrame:
    """Added and deleted build files that can change the set of services: one per directory, deletions only of known services."""
    b = changes.where("change_type <> 'MODIFY'").where(P.last_segment(F.col("path")).isin(BUILD_FILES)).withColumn("root", F.when(P.directory(F.col("path")) == "", "/").otherwise(P.directory(F.col("path"))))
    once = b.groupBy("repo", "branch", "root").agg(F.min(F.struct("path", "change_type")).alias("x")).select("repo", "branch", "root", "x.*")
    known = services.select("repo", "branch", F.col("path").alias("root"), F.lit(True).alias("known"))
    return once.join(known, ["repo", "branch", "root"], "left").where("change_type = 'ADD' OR known").select("repo", "branch", "root", "change_type", "path")


def merge_services(services: DataFrame, new_files: DataFrame, changes: DataFrame) -> DataFrame:
    """Services after the changes: branches of repositories with build-file changes are detected anew, the others keep theirs."""
    touched = build_changes(changes, services).select("repo", "branch").distinct()
    kept = services.join(touched, ["repo", "branch"], "left_anti")
    found = detect(new_files.join(touched, ["repo", "branch"], "left_semi")).select("repo", "branch", "commit", F.col("root").alias("path"), F.col("service_name").alias("name"))
    return kept.select("repo", "branch", "commit", "path", "name").unionByName(found)


def reassign(rows: DataFrame, services: DataFrame) -> DataFrame:
    """Ownership recomputed for all rows (repo, branch, path): files of removed services become orphans, orphans under new services are adopted."""
    d = rows.drop("service_path")
    return longest_prefix_owner(d, services.select("repo", "branch", F.col("path").alias("__root")), "path", "__root", ["repo", "branch"], "service_path")


def update_commits(services: DataFrame, new_commits: DataFrame) -> DataFrame:
    """Commit ids of (repo, branch) that moved; the others keep theirs."""
    n = new_commits.select("repo", "branch", F.col("commit").alias("__new"))
    return services.join(n, ["repo", "branch"], "left").withColumn("commit", F.coalesce("__new", "commit")).drop("__new").select(*services.columns)


def system_change(old_commits: DataFrame, new_commits: DataFrame, file_delta: DataFrame) -> DataFrame:
    """One row: maps of old and new commits by repository and branch and the number of changes by type."""
    as_map = lambda d: d.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.concat_ws(":", "repo", "branch"), "commit")))).alias("m"))
    n = file_delta.groupBy("change_type").count()
    return as_map(old_commits).select(F.col("m").alias("old_commits")).join(as_map(new_commits).select(F.col("m").alias("new_commits"))).join(n.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("change_type", "count")))).alias("changes")))


def remove_components(base: DataFrame, keys: DataFrame) -> DataFrame:
    """``base`` without the components of ``keys``; KeyError if it lacks one of them."""
    absent = keys.select(*COMPONENT_KEY).join(base.select(*COMPONENT_KEY), COMPONENT_KEY, "left_anti").limit(3).collect()
    if absent:
        raise KeyError(f"no such component: {[r['component_id'] for r in absent]}")
    return D.remove_by_key(base, keys, COMPONENT_KEY)


def children(base: DataFrame, parents: DataFrame) -> DataFrame:
    """Components of ``base`` below ``parents`` (repo, branch, path, component_id), at any depth: the tree is class, member, call."""
    at = ["repo", "branch", "path", "parent_component_id"]
    p = parents.select(*at[:3], F.col("component_id").alias(at[3]))
    direct = base.join(p, at, "left_semi")
    below = base.join(direct.select(*at[:3], F.col("component_id").alias(at[3])), at, "left_semi")
    return direct.unionByName(below).distinct()
