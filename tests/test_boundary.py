import pytest

from codestrata.plans.boundary import detect

POM = "<project><parent><artifactId>parent</artifactId></parent><artifactId>{}</artifactId></project>"
BOOT = "package a;\n@SpringBootApplication\npublic class App {}\n"
CONTROLLER = "@RestController\n@RequestMapping(\"/x\")\nclass C {}\n"
YML = "spring:\n  application:\n    name: {}\n"


def found(df):
    return {r["root"]: (r["score"], r["service_name"], list(r["evidence"])) for r in df.collect()}


def tree(root, **kinds):
    known = {
        "pom": ("pom.xml", POM.format("art")), "gradle": ("build.gradle", "plugins {\n}\n"), "yml": ("src/main/resources/application.yml", YML.format("named")), "boot": ("src/main/java/a/App.java", BOOT),
        "controller": ("src/main/java/a/C.java", CONTROLLER), "docker": ("Dockerfile", "FROM x"), "compose": ("docker-compose.yml", "services:\n  web:\n    image: x\n"), "plain": ("src/main/java/a/P.java", "class P {}"),
        "props": ("src/main/resources/application.properties", "spring.application.name=fromprops\n"),
    }
    return {f"{root}/{known[k][0]}": v if isinstance(v, str) else known[k][1] for k, v in kinds.items()}


def test_scores_and_names(files):
    t = tree("/a", pom=1, yml=1, boot=1) | tree("/b", gradle=1, props=1, boot=1) | tree("/lib", pom=1, plain=1) | tree("/c", pom=1, boot=1) | tree("/d", pom=1, docker=1) | tree("/e", pom=1, compose=1) | tree("/f", pom=1, controller=1)
    r = found(detect(files(t)))
    assert {k: v[:2] for k, v in r.items()} == {"/a": (13, "named"), "/b": (13, "fromprops"), "/c": (10, "art"), "/d": (9, "art"), "/e": (7, "art"), "/f": (7, "art")}
    assert r["/a"][2] == ["SpringBootApplication: src/main/java/a/App.java", "application config: src/main/resources/application.yml", "build file: pom.xml", "source tree: src/main/java"]
    assert r["/f"][2] == ["RequestMapping: src/main/java/a/C.java", "build file: pom.xml", "controller annotation: src/main/java/a/C.java", "source tree: src/main/java"]


def test_root_of_repository_and_several_repositories(files):
    t = {("one", k): v for k, v in tree("", pom=1, boot=1).items()} | {("two", k): v for k, v in tree("", gradle=1, boot=1).items()}
    rows = detect(files(t)).collect()
    assert [(r["repo"], r["root"], r["service_name"], r["score"]) for r in rows] == [("one", "/", "art", 10), ("two", "/", "two", 10)]


@pytest.mark.parametrize("compose", ["version: '3'\n", "services: [\n", "", "services: {}\n"])
def test_compose_without_services(files, compose):
    assert found(detect(files(tree("/e", pom=1, compose=compose)))) == {}


@pytest.mark.parametrize("name", ["Dockerfile", "DockerFile", "dockerfile"])
def test_docker_spellings(files, name):
    assert found(detect(files(tree("/d", pom=1) | {f"/d/{name}": "FROM x"})))["/d"][0] == 9


@pytest.mark.parametrize("path,signal", [("k8s/web.yaml", "kubernetes deployment"), ("deployment.yml", "kubernetes deployment"), ("helm/Chart.yaml", "helm chart"), ("Chart.yaml", "helm chart")])
def test_manifests(files, path, signal):
    content = "apiVersion: v2\n" if "Chart" in path else "apiVersion: v1\nkind: Deployment\n"
    r = found(detect(files(tree("/m", pom=1) | {f"/m/{path}": content})))
    score, _, evidence = r["/m"]
    assert f"{signal}: {path}" in evidence and score == 8


def test_other_kind_is_no_deployment(files):
    score, _, evidence = found(detect(files(tree("/m", pom=1, docker=1) | {"/m/k8s/s.yaml": "kind: Service\n"})))["/m"]
    assert score == 9 and not any("kubernetes" in e for e in evidence)


def test_parent_gives_way_to_child_and_ignored_directories(files):
    t = tree("/p", pom=1, yml=1) | tree("/p/child", pom=1, yml=1, boot=1) | tree("/build/x", pom=1, yml=1, boot=1)
    assert set(found(detect(files(t)))) == {"/p/child"}


def test_names_in_order(files):
    t = tree("/y", pom=1, yml="spring.application.name: flat\n", boot=1) | tree("/bad", pom=1, yml="spring: [\n") | tree("/blank", gradle=1, props="spring.application.name=\n", docker=1)
    t |= {"/g/build.gradle.kts": '  rootProject.name = "gname"\n', "/g/Dockerfile": "FROM x"}
    r = found(detect(files(t)))
    assert {k: v[:2] for k, v in r.items()} == {"/y": (13, "flat"), "/bad": (8, "art"), "/blank": (12, "blank"), "/g": (9, "gname")}


def test_empty(files):
    assert found(detect(files({"/x": ""}).where("false"))) == {}


def test_files_are_never_broadcast(spark, files):
    """Spark's estimate of a small input doesn't hold for the files made of it: neither contents nor paths go through the driver."""
    from codestrata.plans import boundary, tables

    few = files(tree("/a", pom=1, yml=1, boot=1))
    services = few.selectExpr("repo", "branch", "commit", "'/a' AS path", "'a' AS name").distinct()
    facts = boundary.file_facts(few)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in facts
    owned = tables.with_owner(few.select("repo", "branch", "commit", "path"), services)._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi" in owned
    parsed = tables.extract(few, services)["parsed"]
    assert {r["path"]: r["service_name"] for r in parsed.collect()} == {"/a/src/main/java/a/App.java": "a"}
    plan = parsed._jdf.queryExecution().logical().toString()
    assert "strategy=merge" in plan


def test_system_files_are_spread(spark):
    """A supplier table of one split makes its files in many tasks."""
    from codestrata.queries import system_files

    made = system_files(spark, "/root/testdata/sf0.001").selectExpr("spark_partition_id() AS p").distinct().count()
    assert made > 1
