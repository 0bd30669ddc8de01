"""Storage: Parquet partitioned by snapshot, nested JSON as a view, schema export."""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import paths as P
from ..functions import roles as R

KEY = ["repo", "branch", "commit"]
#: Tables that are stored; the others follow from them.
STORED = ["services", "classes", "methods", "fields", "imports", "annotations", "calls", "rest_calls", "endpoints", "config_files", "errors"]


def write_tables(tables: dict[str, DataFrame], base: str, mode: str = "overwrite") -> None:
    """One Parquet table a kind; only the partitions of the snapshots at hand are replaced. Schemas are kept beside, for tables without rows."""
    for name in STORED:
        if name in tables:
            d = tables[name].drop("data")  # parsed anew from the JSON text when read
            d.write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy(*KEY).parquet(f"{base}/{name}")
            _write_text(d.sparkSession, f"{base}/schemas/{name}.json", d.schema.json())


def read_tables(spark: SparkSession, base: str, snapshots: list[tuple[str, str, str]] | None = None) -> dict[str, DataFrame]:
    """The stored tables; only the partitions of the given (repo, branch, commit), if any are given."""
    out = {}
    wanted = None
    if snapshots is not None:
        wanted = F.lit(False)
        for key in snapshots:
            one = F.lit(True)
            for column, value in zip(KEY, key, strict=True):
                # An empty name is stored as the default partition, which reads as null.
                one = one & (F.coalesce(F.col(column), F.lit("")) == value if value == "" else F.col(column) == value)
            wanted = wanted | one
    for n in STORED:
        if _exists(spark, f"{base}/{n}"):
            # The stored schema also keeps a commit such as 123e4567 from being read as a number.
            schema = T.StructType.fromJson(json.loads(_read_text(spark, f"{base}/schemas/{n}.json")))
            d = spark.read.schema(schema).parquet(f"{base}/{n}")
            d = d if wanted is None else d.where(wanted)
            out[n] = d.withColumn("data", F.try_parse_json("json")) if n == "config_files" else d
    return out


def _file_system(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def _write_text(spark: SparkSession, path: str, text: str) -> None:
    fs, p = _file_system(spark, path)
    out = fs.create(p, True)
    out.write(bytearray(text.encode()))
    out.close()


def _read_text(spark: SparkSession, path: str) -> str:
    fs, p = _file_system(spark, path)
    source = fs.open(p)
    try:
        return bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(source)).decode()
    finally:
        source.close()


def _exists(spark: SparkSession, path: str) -> bool:
    fs, p = _file_system(spark, path)
    return fs.exists(p)


def has_snapshot(spark: SparkSession, base: str, repo: str, branch: str, commit: str) -> bool:
    """Is this snapshot stored already? Then it needn't be extracted again."""
    return _exists(spark, f"{base}/services/" + _partition(spark, repo, branch, commit))


def _partition(spark: SparkSession, *values: str) -> str:
    names = spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils
    return "/".join(f"{k}={names.escapePathName(v) if v else names.DEFAULT_PARTITION_NAME()}" for k, v in zip(KEY, values, strict=True))


def read_snapshot(spark: SparkSession, base: str, repo: str, branch: str, commit: str) -> dict[str, DataFrame]:
    """The tables of one stored (repo, branch, commit); KeyError if it isn't stored."""
    if not has_snapshot(spark, base, repo, branch, commit):
        raise KeyError(f"no stored snapshot of {repo}, {branch}, {commit}")
    return read_tables(spark, base, [(repo, branch, commit)])


def _in_order(key, value):
    """Values of a group as an array in the order of the keys."""
    by = lambda a, b: F.when(a["k"] < b["k"], -1).when(a["k"] > b["k"], 1).otherwise(0)
    return F.transform(F.array_sort(F.collect_list(F.struct(key.alias("k"), value.alias("v"))), by), lambda x: x["v"])


def nested(tables: dict[str, DataFrame]) -> DataFrame:
    """One row a service, and one without path a snapshot for orphans: classes by bucket with their members, and configuration files as JSON texts.

    Groups are as large as a service's sources.
    """
    inside = {"fields": "fields", "imports": "imports", "annotations": "annotations", "methods": "methods", "calls": "methodCalls", "rest_calls": "restCalls"}
    ids = [*KEY, "path", "service_path", "service_name"]
    cls = tables["classes"]
    own = [F.col(c) for c in cls.columns if c not in ids]
    for kind, shown in inside.items():
        d = tables[kind]
        member = F.struct(*[c for c in d.columns if c not in ids and c != "role"])
        place = F.struct("ordinal", F.col("component_id") if "component_id" in d.columns else F.lit(""))
        cls = cls.join(d.groupBy(*KEY, "path").agg(_in_order(place, member).alias(shown)), [*KEY, "path"], "left")
    cls = cls.withColumn("owner", F.coalesce("service_path", F.lit("")))
    by = cls.groupBy(*KEY, "owner").agg(_in_order(F.col("path"), F.struct("path", *own, *inside.values())).alias("classes"))
    config = tables["config_files"].groupBy(*KEY, F.coalesce("service_path", F.lit("")).alias("owner")).agg(_in_order(F.col("path"), F.struct("path", "json")).alias("configFiles"))
    services = tables["services"].select(*KEY, F.col("path").alias("owner"), "name")
    s = services.join(by, [*KEY, "owner"], "full_outer").join(config, [*KEY, "owner"], "full_outer")
    of = lambda name: F.coalesce(F.filter("classes", lambda x: x["role_bucket"] == name), F.array().cast(by.schema["classes"].dataType)).alias(name)
    buckets = [*dict.fromkeys(R.BUCKETS.values()), "unknowns"]
    return s.select(*KEY, F.nullif("owner", F.lit("")).alias("path"), "name", *[of(x) for x in buckets], F.coalesce("configFiles", F.array().cast(config.schema["configFiles"].dataType)).alias("configFiles"))


def components_of(nested_rows: DataFrame, shown: str) -> DataFrame:
    """(repo, branch, commit, path, service_path, ...) of one kind of member ("methods", "restCalls"...) from nested rows, as they were before nesting."""
    buckets = [*dict.fromkeys(R.BUCKETS.values()), "unknowns"]
    c = nested_rows.select(*KEY, F.col("path").alias("service_path"), F.explode(F.concat(*buckets)).alias("c"))
    return c.select(*KEY, "service_path", F.col("c.path").alias("path"), F.explode(f"c.{shown}").alias("m")).select(*KEY, "service_path", "path", "m.*")


#: Rows of several lines each are told apart by a line of the record separator.
_BETWEEN = "\n\x1e\n"


def write_json(df: DataFrame, path: str, pretty: bool = True) -> None:
    """One JSON object a row: over several lines each, or one line each."""
    rows = df.select(F.to_json(F.struct("*"), {"pretty": str(pretty).lower()}).alias("value"))
    rows.write.mode("overwrite").text(path, lineSep=_BETWEEN if pretty else "\n")


def read_json(spark: SparkSession, path: str, schema, pretty: bool = True) -> DataFrame:
    rows = spark.read.text(path, lineSep=_BETWEEN if pretty else "\n")
    return rows.select(F.from_json("value", schema).alias("r")).select("r.*")


def normalise_paths(df: DataFrame, column: str = "path") -> DataFrame:
    """Repository-relative paths for a table that has clone paths."""
    return df.withColumn(column, P.repo_relative(F.col(column), F.col("repo")))


def write_schemas(target: str = "./schemas") -> list[str]:
    """One JSON file a table."""
    from ..schema import json_schemas

    os.makedirs(target, exist_ok=True)
    out = []
    for name, text in json_schemas().items():
        out.append(os.path.join(target, f"{name}.json"))
        with open(out[-1], "w", encoding="utf-8") as f:
            json.dump(json.loads(text), f, indent=2)
    return out
