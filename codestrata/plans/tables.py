"""Extraction: files and services to flat tables of classes, methods, fields, imports, annotations, parameters, calls and configuration."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .. import schema as S
from ..functions import roles as R
from ..functions import urls as U
from ..functions.source_text import is_config_file, is_valid_file
from ..operators.ownership import longest_prefix_owner
from ..sources.config_files import parse_config_files
from ..sources.java_parser import parse_java

KEY = ["repo", "branch", "commit"]
OWNER = ["service_path", "service_name"]
TABLES: dict[str, T.StructType] = {"files": S.FILES, "services": S.SERVICES, "class": S.CLASS, "method": S.METHOD, "field": S.FIELD, "import": S.IMPORT, "annotation": S.ANNOTATION, "call": S.CALL, "rest_call": S.REST_CALL, "endpoint": S.ENDPOINT, "config_file": S.CONFIG_FILE, "file_change": S.FILE_CHANGE, "component_change": S.COMPONENT_CHANGE}


def parse_sources(files: DataFrame) -> DataFrame:
    """Java files with one struct ``class`` each; a file that can't be parsed has parse_error and nothing else. Columns of the owner are kept."""
    keep = [*KEY, "path", *[x for x in OWNER if x in files.columns]]
    java = files.where(F.endswith("path", F.lit(".java"))).select(*keep, "content")
    out = T.StructType([*[T.StructField(c, T.StringType()) for c in keep], T.StructField("class", S.CLASS)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = to_arrow_type(S.CLASS)
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array([parse_java(x or "") for x in b.columns[-1].to_pylist()], kind)], out.names)

    return java.mapInArrow(run, out)


def with_owner(files: DataFrame, services: DataFrame) -> DataFrame:
    """Files with service_path and service_name; null for orphans. The snapshot is part of the join key."""
    owned = longest_prefix_owner(files, services.select(*KEY, "path").withColumnRenamed("path", "__root"), "path", "__root", KEY, "service_path")
    return owned.join(services.select(*KEY, F.col("path").alias("service_path"), F.col("name").alias("service_name")), [*KEY, "service_path"], "left")


def role_of_class() -> Column:
    return R.class_role(F.transform("class.class_annotations", lambda a: a["name"]), F.col("class.extended_types"))


def class_mapping() -> Column:
    """Attributes of the class's own @RequestMapping."""
    return F.get(F.filter("class.class_annotations", lambda a: a["name"] == "RequestMapping"), 0)["attributes"]


def classes(parsed: DataFrame, filter_unknown: bool = False) -> DataFrame:
    """One row a file: header columns, role and bucket. ``filter_unknown`` leaves classes without role out."""
    c = parsed.where("class.parse_error IS NULL")
    role = role_of_class()
    out = c.select(
        *KEY, "path", *[x for x in OWNER if x in parsed.columns],
        F.concat_ws(".", F.nullif("class.package", F.lit("")), "class.name").alias("class_id"),
        *[F.col(f"class.{x}") for x in ("package", "name", "class_type", "protection", "is_static", "is_final", "is_abstract", "extended_types", "implemented_types", "enum_constants", "class_annotations")],
        role.alias("role"), R.bucket(role).alias("role_bucket"), class_mapping().alias("class_mapping"),
    )
    return out.where("role <> 'UNKNOWN'") if filter_unknown else out


def components(parsed: DataFrame, what: str) -> DataFrame:
    """Flat rows of one kind of component: methods, fields, imports, annotations or calls."""
    keep = [*KEY, "path", *[x for x in ("service_path", "service_name") if x in parsed.columns]]
    return parsed.where("class.parse_error IS NULL").select(*keep, F.explode(f"class.{what}").alias("c")).select(*keep, "c.*")


def methods(parsed: DataFrame, filter_unknown: bool = False) -> DataFrame:
    """Methods with url and http_method where they are endpoints, and required request parameters. The class is the same row's: nothing is joined.

    Mapped methods of any class are endpoints, those of Feign clients are calls instead. Methods of repository resources are endpoints of
    their own: GET /<name>s/search/<method>, or below the path that @RepositoryRestResource gives, unless marked as not exported.
    """
    keep = [*KEY, "path", *[x for x in OWNER if x in parsed.columns]]
    of_class = [role_of_class().alias("role"), class_mapping().alias("class_mapping"), F.col("class.class_annotations").alias("class_annotations"), F.col("class.name").alias("class_name")]
    m = parsed.where("class.parse_error IS NULL").select(*keep, *of_class, F.explode("class.methods").alias("c"))
    m = (m.where("role <> 'UNKNOWN'") if filter_unknown else m).select(*keep, "c.*", "role", "class_mapping", "class_annotations", "class_name")
    first = F.get(F.filter("annotations", lambda a: a["name"].isin(U.MAPPINGS)), 0)
    # Map lookups of a null map give null: only the marker annotation of an empty map has no value at all.
    own = F.when(first["name"].isNotNull(), F.coalesce(first["attributes"], F.create_map().cast("map<string,string>")))
    mapped = F.col("role") != "REP_REST_RSC"
    url = F.when(first["name"].isNotNull() & mapped, U.endpoint_url(F.coalesce("class_mapping", F.create_map().cast("map<string,string>")), own))
    method = F.when(first["name"].isNotNull() & mapped, U.endpoint_method(own, first["name"]))
    rest = F.get(F.filter("annotations", lambda a: a["name"] == "RestResource"), 0)["attributes"]
    exported = F.coalesce(rest["exported"], F.lit("true")) != "false"
    # The class's own path (or value), else its name without "repository" in the plural.
    named = F.get(F.filter("class_annotations", lambda a: a["name"] == "RepositoryRestResource"), 0)["attributes"]
    own_path = F.nullif(F.regexp_replace(F.coalesce(named["path"], named["default"]), "^/+|/+$", ""), F.lit(""))
    base = F.concat(F.lit("/"), F.coalesce(own_path, F.concat(F.replace(F.lower("class_name"), F.lit("repository"), F.lit("")), F.lit("s"))), F.lit("/search/"))
    resource = F.concat(base, F.coalesce(F.regexp_replace(rest["path"], "^/", ""), F.col("name")))
    is_resource = (F.col("role") == "REP_REST_RSC") & exported
    return m.select(
        *[c for c in m.columns if c not in ("class_mapping", "class_annotations", "class_name")],
        F.when(is_resource, resource).otherwise(url).alias("url"), F.when(is_resource, "GET").otherwise(method).alias("http_method"), required_parameters(F.col("parameters")).alias("required"),
    )


def _request_param(p):
    return F.get(F.filter(p["annotations"], lambda a: a["name"] == "RequestParam"), 0)


def _param_name(p):
    a = _request_param(p)["attributes"]
    return F.coalesce(a["default"], a["value"], a["name"], p["name"])


def required_parameters(parameters):
    """Names of the request parameters that a call must name."""
    needed = F.filter(parameters, lambda p: _request_param(p)["name"].isNotNull() & (F.coalesce(_request_param(p)["attributes"]["required"], F.lit("true")) != "false"))
    return F.transform(needed, _param_name)


def endpoints(method_table: DataFrame, include_repositories: bool = False) -> DataFrame:
    """Endpoints of services: those of controllers, on request those of repository resources, too."""
    roles = ["CONTROLLER", "REP_REST_RSC"] if include_repositories else ["CONTROLLER"]
    return method_table.where(F.col("role").isin(roles) & F.col("http_method").isNotNull())


def rest_calls(parsed: DataFrame, method_table: DataFrame) -> DataFrame:
    """Calls of REST clients with url and http_method, and one call for every mapped method of a Feign client."""
    keep = [*KEY, "path", *[x for x in ("service_path", "service_name") if x in parsed.columns]]
    c = components(parsed, "calls").where(F.col("object_type").isin(U.REST_TYPES) & F.col("name").isin(U.REST_METHODS) & (F.col("url_argument") != ""))
    direct = c.select(*keep, "component_id", "parent_component_id", "ordinal", "called_from", F.col("object_type"), "arguments", U.template(F.col("url_argument")).alias("url"), U.http_from_call(F.col("name"), F.col("arguments")).alias("http_method"))
    feign = method_table.where("role = 'FEIGN_CLIENT' AND url IS NOT NULL")
    asked = F.filter("parameters", lambda p: _request_param(p)["name"].isNotNull())
    synthetic = feign.select(
        *keep, F.concat("component_id", F.lit("&exchange")).alias("component_id"), F.col("component_id").alias("parent_component_id"), "ordinal", F.col("name").alias("called_from"),
        F.lit("RestCallTemplate").alias("object_type"), F.lit("").alias("arguments"), F.concat("url", U.query_string(F.transform(asked, _param_name))).alias("url"), "http_method",
    )
    return direct.unionByName(synthetic)


def config_tables(files: DataFrame) -> DataFrame:
    return parse_config_files(files.where(is_config_file(F.col("path")))).drop("content")


def extract(files: DataFrame, services: DataFrame, filter_unknown: bool = False) -> dict[str, DataFrame]:
    """All tables of a snapshot. The parsed files are written nowhere; persist the result's 'parsed' if several tables are used."""
    # Contents can be many times as large as the input that Spark estimates them by: never broadcast by that estimate.
    owned = with_owner(files.where(is_valid_file(F.col("path"))).select(*KEY, "path"), services).hint("merge")
    java = files.where(F.endswith("path", F.lit(".java"))).select(*KEY, "path", "content")
    parsed = parse_sources(java.join(owned, [*KEY, "path"])).persist()
    c = classes(parsed, filter_unknown)
    m = methods(parsed, filter_unknown)
    return {
        "parsed": parsed, "services": services, "classes": c, "methods": m, "fields": components(parsed, "fields"), "imports": components(parsed, "imports"), "annotations": components(parsed, "annotations"),
        "calls": components(parsed, "calls"), "rest_calls": rest_calls(parsed, m), "endpoints": endpoints(m), "config_files": config_tables(files).join(owned, [*KEY, "path"]),
        "errors": parsed.where("class.parse_error IS NOT NULL").select(*KEY, "path", "class.parse_error"),
    }


def call_graph(tables: dict[str, DataFrame], exclude_by: str = "service", snapshots: DataFrame | None = None) -> DataFrame:
    """Which service calls which endpoint of which other service, within one snapshot of the system.

    ``snapshots`` (snapshot, repo, branch, commit) says which commits belong together; both sides then have the column snapshot. Without it, rows of one repository
    match within one (branch, commit) and those of two repositories if both have one (branch, commit) each, or equal ones.
    """
    from ..operators.matching import match_calls

    c = tables["rest_calls"].select(*KEY, "path", "component_id", F.col("service_name").alias("service"), F.col("service_path").alias("service_id"), "url", "http_method")
    e = tables["endpoints"].select(*KEY, "path", "component_id", F.col("service_name").alias("service"), F.col("service_path").alias("service_id"), "url", "http_method", "required")
    if snapshots is not None:
        named = snapshots.select("snapshot", *KEY).distinct()
        return match_calls(c.join(named, KEY), e.join(named, KEY), exclude_by, within=("snapshot",))
    versions = tables["services"].groupBy("repo").agg(F.countDistinct("branch", "commit").alias("versions"))
    c, e = (x.join(versions, "repo", "left").persist() for x in (c, e))  # counted before they are matched
    same = (F.col("call_branch") == F.col("endpoint_branch")) & (F.col("call_commit") == F.col("endpoint_commit"))
    single = (F.col("call_repo") != F.col("endpoint_repo")) & (F.col("call_versions") == 1) & (F.col("endpoint_versions") == 1)
    return match_calls(c, e, exclude_by).where(same | single).drop("call_versions", "endpoint_versions")


def all_files(tables: dict[str, DataFrame]) -> DataFrame:
    """Classes and configuration files of all services and orphans: (repo, branch, commit, path, service_path, kind)."""
    cols = [*KEY, "path", "service_path"]
    return tables["classes"].select(*cols, F.lit("class").alias("kind")).unionByName(tables["config_files"].select(*cols, F.lit("config").alias("kind"))).distinct()


def totals(tables: dict[str, DataFrame]) -> DataFrame:
    """Per service: classes by bucket, endpoints, REST calls and method calls."""
    key = [*KEY, "service_path", "service_name"]
    c = tables["classes"].groupBy(*key).pivot("role_bucket", [*dict.fromkeys(R.BUCKETS.values()), "unknowns"]).count().na.fill(0)
    for name in ("endpoints", "rest_calls", "calls"):
        n = tables[name].groupBy(*KEY, "service_path").agg(F.count("*").alias(f"n_{name}"))
        on = [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in (*KEY, "service_path")]
        c = c.alias("l").join(n.alias("r"), on, "left").select("l.*", F.coalesce(f"r.n_{name}", F.lit(0)).alias(f"n_{name}"))
    return c
