"""Service boundaries: evidence rows by possible root, weighted sum, threshold, leaf-most roots, inferred names.

Everything is a join by equality or an aggregation over the file list: the cost is a few rows per file. Contents are looked at once, for the few
files whose names ask for it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import paths as P
from ..functions.source_text import has_deployment_kind, in_ignored_dir
from ..operators.evidence import THRESHOLD, WEIGHTS, accepted, score
from ..operators.ownership import leaf_roots
from ..sources import config_files as C

BUILD_FILES = "pom.xml build.gradle build.gradle.kts".split()
DOCKER_FILES = ["dockerfile"]
COMPOSE_FILES = [f"docker-compose.{x}" for x in ("yml", "yaml")]
CONFIG_FILES = [f"application.{x}" for x in ("yml", "yaml", "properties")]
GRADLE_FILES = [f"{x}.gradle{y}" for x in ("settings", "build") for y in ("", ".kts")]
DEPLOYMENT_DIRS = "k8s kubernetes helm charts chart deployments deployment deploy".split()
KEY = ["repo", "branch", "commit"]


def _root(path: Column) -> Column:
    """'' is the repository's root; shown as /."""
    return F.when(path == "", "/").otherwise(path)


def _in(name: Column, known: list[str]) -> Column:
    return F.lower(name).isin([x.lower() for x in known])


def file_facts(files: DataFrame) -> DataFrame:
    """Files outside ignored directories with directory, name and what their contents show.

    One pass without a join: configuration is read beside the other files, whose contents stay behind.
    """
    f = files.where(~in_ignored_dir(F.substr("path", F.lit(2)))).withColumn("dir", P.directory(F.col("path"))).withColumn("name", P.last_segment(F.col("path")))
    yaml = F.col("name").rlike(r"\.ya?ml$")
    config = F.col("name").isin(CONFIG_FILES) | (F.col("name") == "pom.xml") | F.col("name").isin(COMPOSE_FILES)
    java = F.endswith("name", F.lit(".java"))
    deployment_place = F.col("name").isin("deployment.yml", "deployment.yaml") | F.arrays_overlap(F.split("dir", "/"), F.array(*[F.lit(x) for x in DEPLOYMENT_DIRS]))
    shown = f.select(
        *KEY, "path", "dir", "name", F.when(config, F.col("content")).alias("content"), F.when(F.col("name").isin(GRADLE_FILES), F.col("content")).alias("gradle"),
        (yaml & deployment_place & has_deployment_kind(F.col("content"))).alias("is_deployment"),
        (java & F.contains("content", F.lit("@SpringBootApplication"))).alias("is_boot"),
        (java & (F.contains("content", F.lit("@RestController")) | F.contains("content", F.lit("@Controller")))).alias("is_controller"),
        (java & F.contains("content", F.lit("@RequestMapping"))).alias("is_mapping"),
        F.when(java, F.regexp_extract("path", r"^(.*?)/src/main/java/", 1)).alias("java_root"),
        (java & F.contains("path", F.lit("/src/main/java/"))).alias("in_source_tree"),
    )
    services = F.try_variant_get("data", "$.services", "map<string, variant>")
    return C.parse_config_files(shown).drop("content", "json").withColumn("has_services", F.col("name").isin(COMPOSE_FILES) & (F.size(services) > 0))


def signals(facts: DataFrame) -> DataFrame:
    """(repo, branch, commit, root, signal, detail, weight): every piece of evidence of every possible root, '' for the repository's.

    One pass: a file makes an array of what it shows, and one aggregation keeps the first detail of each signal.
    """
    name, at, path = F.col("name"), F.col("dir"), F.col("path")

    def place(known: list[str]) -> Column:
        """Order of the name among the known ones; exact spelling before any other case."""
        exact = F.array_position(F.array(*[F.lit(x) for x in known]), name)
        any_case = F.array_position(F.array(*[F.lit(x.lower()) for x in known]), F.lower(name))
        return F.when(exact > 0, exact).otherwise(any_case + 100).cast("int")

    def shows(signal: str, condition: Column, root: Column, detail: Column, rank: Column | None = None) -> Column:
        row = F.struct(root.alias("root"), F.lit(signal).alias("signal"), (F.lit(0) if rank is None else rank.cast("int")).alias("r"), detail.alias("d"), F.lit(WEIGHTS[signal]).alias("weight"))
        return F.when(condition, row)

    inside = lambda root: F.substr(path, F.length(root) + 2)
    resources = F.endswith("dir", F.lit("/src/main/resources"))
    config_root = F.when(resources, F.regexp_replace("dir", "/src/main/resources$", "")).otherwise(at)
    dirs = "|".join(DEPLOYMENT_DIRS)
    deploy_root = F.regexp_extract("dir", rf"^(.*?)/(?:{dirs})(?:/|$)", 1)
    under = F.col("dir").rlike(rf"/({dirs})(/|$)")
    java = F.col("java_root")
    manifest, chart = F.col("is_deployment"), name == "Chart.yaml"
    found = F.array(
        shows("build file", _in(name, BUILD_FILES), at, name, place(BUILD_FILES)),
        shows("source tree", F.col("in_source_tree"), java, F.lit("src/main/java")),
        shows("application config", name.isin(CONFIG_FILES), config_root, inside(config_root), place(CONFIG_FILES) + F.when(resources, 0).otherwise(10)),
        shows("dockerfile", _in(name, DOCKER_FILES), at, name, place(["Dockerfile", "DockerFile"])),
        shows("docker-compose services", F.col("has_services"), at, name, place(COMPOSE_FILES)),
        shows("SpringBootApplication", F.col("is_boot") & F.col("in_source_tree"), java, inside(java)),
        shows("controller annotation", F.col("is_controller") & F.col("in_source_tree"), java, inside(java)),
        shows("RequestMapping", F.col("is_mapping") & F.col("in_source_tree"), java, inside(java)),
        # A manifest or chart counts for the directory it lies in and for the one above a deployment directory.
        shows("kubernetes deployment", manifest & name.isin("deployment.yml", "deployment.yaml"), at, inside(at)),
        shows("kubernetes deployment", manifest & under, deploy_root, inside(deploy_root)),
        shows("helm chart", chart, at, inside(at)),
        shows("helm chart", chart & under, deploy_root, inside(deploy_root)),
    )
    rows = facts.select(*KEY, F.inline(F.array_compact(found)))
    return rows.groupBy(*KEY, "root", "signal").agg(F.min_by("d", F.struct("r", "d")).alias("detail"), F.max("weight").alias("weight"))


def names(facts: DataFrame, roots: DataFrame) -> DataFrame:
    """(repo, branch, commit, root, service_name): application name, artifact, Gradle project, folder, repository, whichever is first not blank."""
    config_place = F.when(F.endswith("dir", F.lit("/src/main/resources")), 0).otherwise(3) + F.array_position(F.array(*[F.lit(x) for x in CONFIG_FILES]), F.col("name"))
    config = facts.where(F.col("name").isin(CONFIG_FILES)).select(*KEY, F.regexp_replace("dir", "/src/main/resources$", "").alias("root"), config_place.alias("rank"), C.app_name(F.col("data")).alias("found"))
    pom = facts.where("name = 'pom.xml'").select(*KEY, F.col("dir").alias("root"), F.lit(10).alias("rank"), C.artifact_id(F.col("data")).alias("found"))
    gradle = facts.where(F.col("name").isin(GRADLE_FILES)).select(*KEY, F.col("dir").alias("root"), (F.lit(20) + F.array_position(F.array(*[F.lit(x) for x in GRADLE_FILES]), F.col("name"))).alias("rank"), C.gradle_name(F.col("gradle")).alias("found"))
    found = config.unionByName(pom).unionByName(gradle).where("found IS NOT NULL")
    best = found.groupBy(*KEY, "root").agg(F.min_by("found", "rank").alias("found"))
    folder = F.nullif(P.last_segment(F.col("root")), F.lit(""))
    return roots.join(best, [*KEY, "root"], "left").withColumn("service_name", F.coalesce("found", folder, "repo")).drop("found")


def detect(files: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """(repo, branch, commit, root, service_name, score, evidence) in the order of repo and root, from (repo, branch, commit, path, content)."""
    facts = file_facts(files).persist()
    good = accepted(score(signals(facts), [*KEY, "root"]), threshold).withColumn("root", _root(F.col("root")))
    leaf = leaf_roots(good, "root", KEY)
    named = names(facts, leaf.withColumn("root", F.when(F.col("root") == "/", "").otherwise(F.col("root"))))
    return named.select(*KEY, _root(F.col("root")).alias("root"), "service_name", "score", "evidence").orderBy(*KEY, "root")
