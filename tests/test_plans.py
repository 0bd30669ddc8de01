import subprocess

import pytest
from pyspark.sql import functions as F

from codestrata.operators import diff as D
from codestrata.plans import delta, io, system
from codestrata.plans.tables import parse_sources
from codestrata.schema import json_schemas
from codestrata.sources import git
from codestrata.sources.files import scan_tree
from codestrata.streaming.incremental import merge_stream

POM = "<project><artifactId>{}</artifactId></project>"
V1 = {"/pom.xml": POM.format("root"), "/a/pom.xml": POM.format("a"), "/a/src/main/java/App.java": "package x;\n@SpringBootApplication\nclass App { void f() { g(); g(); } int k = 1; }\n", "/a/src/main/java/B.java": "class B { void one() {} void one(int i) {} }\n", "/a/src/main/java/C.java": "class C { }\n"}
V2 = V1 | {"/pom.xml": POM.format("other"), "/a/src/main/java/App.java": V1["/a/src/main/java/App.java"].replace("g(); }", "g(); h(); }").replace("int k = 1", "int k = 2"), "/a/src/main/java/C.java": "// only a comment\nclass C {   }\n", "/b/pom.xml": POM.format("b"), "/b/src/main/java/Z.java": "@SpringBootApplication class Z {}\n"}
del V2["/a/src/main/java/B.java"]


def test_delta_and_merge(files):
    old, new = files(V1), files(V2, "c2")
    changed, components = delta.delta(old, new)
    assert {(r["path"], r["change_type"]) for r in changed.collect()} == {("/a/src/main/java/App.java", "MODIFY"), ("/a/src/main/java/B.java", "DELETE"), ("/b/pom.xml", "ADD"), ("/b/src/main/java/Z.java", "ADD")}
    got = {(r["kind"], r["component_id"], r["copy"], r["change_type"]) for r in components.where("path LIKE '%App.java'").collect()}
    assert got == {("call", "x.App&f&h", 0, "ADD"), ("field", "x.App&k", 0, "MODIFY")}
    before, after = delta.component_rows(parse_sources(old)), delta.component_rows(parse_sources(new))
    assert D.equivalent(delta.merge_components(before, components), after).first()["equal"]
    assert {(r["component_id"], r["copy"]) for r in components.where("kind = 'method' AND path LIKE '%B.java'").collect()} == {("B&one", 0), ("B&one", 1)}


def test_services_follow_build_files(files, spark):
    old, new = files(V1), files(V2, "c2")
    t = system.create_from_files(old)
    assert [r["name"] for r in t["services"].collect()] == ["a"]
    changed, _ = delta.delta(old, new)
    services = delta.merge_services(t["services"], new, changed)
    assert sorted(r["name"] for r in services.collect()) == ["a", "b"]
    rows = delta.reassign(new.select("repo", "branch", "path"), services)
    assert {r["path"]: r["service_path"] for r in rows.collect()}["/b/src/main/java/Z.java"] == "/b"
    commits = spark.createDataFrame([("shop", "main", "c9")], "repo string, branch string, commit string")
    assert {r["commit"] for r in delta.update_commits(services, commits).collect()} == {"c9"}
    head = delta.system_change(spark.createDataFrame([("shop", "main", "c1")], "repo string, branch string, commit string"), commits, changed).first()
    assert head["old_commits"] == {"shop:main": "c1"} and head["new_commits"] == {"shop:main": "c9"} and head["changes"]["ADD"] == 2


def test_storage_round_trip(files, spark, tmp_path):
    t = system.create_from_files(files(V1))
    io.write_tables(t, str(tmp_path / "t"))
    back = io.read_tables(spark, str(tmp_path / "t"))
    for name in ("services", "classes", "methods", "calls"):
        assert D.equivalent(t[name].select(F.to_json(F.struct(*sorted(t[name].columns))).alias("j")), back[name].select(F.to_json(F.struct(*sorted(t[name].columns))).alias("j"))).first()["equal"]
    assert io.has_snapshot(spark, str(tmp_path / "t"), "shop", "main", "c1") and not io.has_snapshot(spark, str(tmp_path / "t"), "shop", "main", "c7")
    n = io.nested(t).cache()
    for pretty in (True, False):
        io.write_json(n, str(tmp_path / "j"), pretty)
        again = io.read_json(spark, str(tmp_path / "j"), n.schema, pretty)
        assert D.equivalent(n.select(F.to_json(F.struct("*")).alias("j")), again.select(F.to_json(F.struct("*")).alias("j"))).first()["equal"]
    rows = {r["path"]: r for r in n.collect()}
    assert len(rows["/a"]["unknowns"]) == 3 and [c["path"] for c in rows["/a"]["configFiles"]] == ["/a/pom.xml"] and [c["path"] for c in rows[None]["configFiles"]] == ["/pom.xml"]
    for kind, shown in (("methods", "methods"), ("fields", "fields"), ("calls", "methodCalls"), ("annotations", "annotations")):
        want = t[kind].select(*[c for c in t[kind].columns if c not in ("service_name", "role")])
        flat = lambda d: d.select(F.to_json(F.struct(*sorted(want.columns))).alias("j"))
        assert D.equivalent(flat(want), flat(io.components_of(n, shown))).first()["equal"], kind
    assert len(io.write_schemas(str(tmp_path / "s"))) == len(json_schemas()) == 13


def test_snapshots_are_told_apart(files, spark, tmp_path):
    """Two stored commits of one system: each is read alone, calls match within one, and configuration files come back."""
    from codestrata.plans.tables import all_files, call_graph
    from test_java import APP, CLIENT, CONTROLLER

    texts = {"/users/pom.xml": POM.format("users"), "/users/src/main/java/App.java": APP, "/users/src/main/java/C.java": CONTROLLER, "/orders/pom.xml": POM.format("orders"), "/orders/src/main/java/App.java": APP, "/orders/src/main/java/F.java": CLIENT}
    base = str(tmp_path / "t")
    for commit in ("c1", "c2"):
        io.write_tables(system.create_from_files(files(texts, commit)), base)
    one, both = io.read_snapshot(spark, base, "shop", "main", "c1"), io.read_tables(spark, base)
    assert {r["commit"] for r in one["services"].collect()} == {"c1"} and both["services"].count() == 2 * one["services"].count() == 4
    assert call_graph(one).count() == 2 and call_graph(both).count() == 4
    labels = spark.createDataFrame([("s1", "shop", "main", "c1")], "snapshot string, repo string, branch string, commit string")
    assert {r["call_commit"] for r in call_graph(both, snapshots=labels).collect()} == {"c1"} and call_graph(both, snapshots=labels).count() == 2
    assert {(r["path"], r["kind"]) for r in all_files(one).collect()} == {(p, "config" if p.endswith("xml") else "class") for p in texts}
    assert one["config_files"].selectExpr("variant_get(data, '$.project.artifactId', 'string') AS a").orderBy("a").collect()[0]["a"] == "orders"
    with pytest.raises(KeyError):
        io.read_snapshot(spark, base, "shop", "main", "c7")
    slash = files(texts).selectExpr("repo", "'feature/x' AS branch", "'c3' AS commit", "path", "content")
    io.write_tables(system.create_from_files(slash), base)
    assert io.read_snapshot(spark, base, "shop", "feature/x", "c3")["services"].count() == 2


def test_branches_are_told_apart(files):
    """Two unchanged branches of one repository differ in nothing; a change of one is no change of the other."""
    both = lambda a, b: files(a).unionByName(files(b).selectExpr("repo", "'dev' AS branch", "commit", "path", "content"))
    changed, components = delta.delta(both(V1, V2), both(V1, V2))
    assert changed.isEmpty() and components.isEmpty()
    changed, components = delta.delta(both(V1, V1), both(V1, V2))
    assert {r["branch"] for r in changed.collect()} == {r["branch"] for r in components.collect()} == {"dev"}


def test_names_of_clones():
    assert git.repository_names(["https://h/a/x.git", "https://h/b/x.git", "git@h:c/y.git"]) == {"https://h/a/x.git": "a_x", "https://h/b/x.git": "b_x", "git@h:c/y.git": "y"}


def sh(path, *args):
    subprocess.run(["git", "-c", "user.name=t", "-c", "user.email=t@t", *args], cwd=path, check=True, capture_output=True)


@pytest.fixture
def repo(tmp_path):
    path = tmp_path / "clone" / "shop"
    path.mkdir(parents=True)
    sh(path, "init", "-q", "-b", "main")
    for version, message in ((V1, "one"), (V2, "two")):
        for p in V1:
            if p not in version:
                (path / p[1:]).unlink()
        for p, text in version.items():
            (path / p[1:]).parent.mkdir(parents=True, exist_ok=True)
            (path / p[1:]).write_text(text)
        sh(path, "add", "-A")
        sh(path, "commit", "-q", "-m", message)
    return str(path)


def test_git_source(spark, repo, tmp_path):
    log = git.log(spark, repo, "shop").orderBy("ordinal").collect()
    assert [r["subject"] for r in log] == ["two", "one"] and log[0]["parent"] == log[1]["commit"] and git.head(repo) == log[0]["commit"]
    old, new = [git.snapshot(spark, repo, "shop", r["commit"], "main") for r in (log[1], log[0])]
    assert {r["path"]: r["content"] for r in old.collect()} == V1 and {r["path"]: r["content"] for r in new.collect()} == V2
    trees = [git.tree(spark, repo, "shop", r["commit"]) for r in (log[1], log[0])]
    kinds = {r["path"]: r["change_type"] for r in git.tree_diff(*trees).collect()}
    assert kinds["/b/pom.xml"] == "ADD" and kinds["/a/src/main/java/B.java"] == "DELETE" and kinds["/a/src/main/java/C.java"] == "MODIFY"
    assert "/a/src/main/java/C.java" not in {r["path"] for r in git.code_changes(old, new).collect()}
    changes, components = system.create_deltas(spark, [(repo, "shop", "main", log[1]["commit"], log[0]["commit"])])
    want, want_components = delta.delta(old, new)
    assert {(r["path"], r["change_type"], r["commit"]) for r in changes.collect()} == {(r["path"], r["change_type"], log[0]["commit"]) for r in want.collect()}
    assert D.equivalent(components.drop("commit"), want_components).first()["equal"]
    assert git.head(repo, "main") == log[0]["commit"]
    with pytest.raises(git.GitError, match="no branch"):
        git.head(repo, "gone")
    config = {"systemName": "s", "systemRepositories": [{"repoBranchPair": {"repositoryURL": "file://" + repo, "branchName": "main"}, "commitID": c} for c in (log[1]["commit"],)]}
    clones = str(tmp_path / "stored")
    first = system.create(spark, config, clones, work=str(tmp_path / "work" / "clone"))
    config["systemRepositories"][0]["commitID"] = ""
    second = system.create(spark, config, clones, work=str(tmp_path / "work" / "clone"))
    assert {r["commit"] for r in first["services"].collect()} == {log[1]["commit"]} and {r["commit"] for r in second["services"].collect()} == {log[0]["commit"]}
    assert git.is_repository(repo) and git.clone("unused", repo) == repo and not git.is_repository(str(tmp_path))
    scanned = {r["path"]: r["content"] for r in scan_tree(spark, repo, "shop").collect()}
    assert scanned == V2
    with pytest.raises(NotADirectoryError):
        scan_tree(spark, repo + "/pom.xml", "shop")
    with pytest.raises(git.GitError, match="no-such-place"):
        git.check_access([str(tmp_path / "no-such-place"), repo])
    with pytest.raises(ValueError):
        git.remove_tree("/etc/nothing")
    git.remove_tree(repo)
    assert not git.is_repository(repo)
    assert git.first_lines("a tok\n\n b\nc\nd", "tok") == "a *** b c"


def test_stream_of_deltas(spark, tmp_path):
    base, src = str(tmp_path / "base"), str(tmp_path / "deltas")
    spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string").write.parquet(f"{base}/v=-1")
    rows = [(1, "MODIFY", "x", 1), (1, "MODIFY", "y", 2), (2, "DELETE", None, 3), (3, "ADD", "z", 4)]
    spark.createDataFrame(rows, "k long, change_type string, new_v string, at long").coalesce(1).write.parquet(src)
    stream = spark.readStream.schema("k long, change_type string, new_v string, at long").parquet(src)
    q = merge_stream(stream, base, ["k"], "at", str(tmp_path / "check"))
    assert q.awaitTermination(120)
    assert {tuple(r) for r in spark.read.parquet(f"{base}/v=0").collect()} == {(1, "y"), (3, "z")}


def test_totals_and_component_tree(files, spark, tmp_path):
    from codestrata.plans.tables import all_files, totals

    t = system.create_from_files(files(V1))
    row = {r["service_name"]: r.asDict() for r in totals(t).collect()}["a"]
    assert (row["unknowns"], row["controllers"], row["n_calls"], row["n_endpoints"]) == (3, 0, 2, 0)
    assert sorted((r["path"], r["kind"]) for r in all_files(t).collect()) == sorted([("/pom.xml", "config"), ("/a/pom.xml", "config")] + [(f"/a/src/main/java/{n}.java", "class") for n in "BC"] + [("/a/src/main/java/App.java", "class")])
    base = delta.component_rows(parse_sources(files(V1)))
    app = base.where("kind = 'class' AND component_id = 'x.App'")
    assert sorted((r["kind"], r["component_id"], r["copy"]) for r in delta.children(base, app).where("kind <> 'annotation'").collect()) == [("call", "x.App&f&g", 0), ("call", "x.App&f&g", 1), ("field", "x.App&k", 0), ("method", "x.App&f", 0)]
    assert delta.remove_components(base, app).count() == base.count() - 1
    with pytest.raises(KeyError):
        delta.remove_components(base, app.withColumn("component_id", F.lit("none")))
    _, c = system.create_delta_and_write(files(V1), files(V2, "c2"), str(tmp_path / "d"))
    merged = system.merge_and_write(base, c, str(tmp_path / "m"))
    assert D.equivalent(merged, delta.component_rows(parse_sources(files(V2)))).first()["equal"]


@pytest.mark.parametrize("name,parsed", [("source_endpoints", 1), ("feign_calls", 2)])
def test_sources_are_not_parsed_for_a_join(spark, name, parsed):
    """Methods know their class from their own row; calls of clients and of Feign interfaces are two passes."""
    from codestrata.queries import QUERIES

    plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == parsed and "Join" not in plan


def test_methods_of_classes_without_role(files):
    texts = {"/a/pom.xml": POM.format("a"), "/a/src/main/java/App.java": V1["/a/src/main/java/App.java"], "/a/src/main/java/C.java": "@RestController class C { @GetMapping(\"/x\") void x() {} }\n"}
    names = lambda **k: sorted(r["name"] for r in system.create_from_files(files(texts), **k)["methods"].collect())
    assert names() == ["f", "x"] and names(filter_unknown=True) == ["x"]
