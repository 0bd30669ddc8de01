import json

import pytest
from pyspark.sql import functions as F

from codestrata.sources import config_files as C
from codestrata.sources import system_config as SC


def test_readers():
    assert json.loads(C.read_config("a/x.yml", "server:\n  port: 80\n")) == {"server": {"port": 80}}
    assert C.read_config("x.yaml", "") == "{}" and C.read_config("x.yml", "a: [") is None
    assert json.loads(C.read_config("Dockerfile", "FROM a\n  RUN b \n")) == {"instructions": ["FROM a", "RUN b"]}
    assert json.loads(C.read_config("DOCKERFILE", "FROM a")) == {"instructions": ["FROM a"]}
    pom = json.loads(C.read_config("pom.xml", "<project xmlns='u'><a>1</a><m><b>x</b><b>y</b></m></project>"))
    assert pom == {"project": {"a": 1, "m": {"b": ["x", "y"]}}}
    assert C.read_config("pom.xml", " ") == "{}" and C.read_config("pom.xml", "<a>") is None
    g = json.loads(C.read_config("build.gradle", "plugins {\n  id 'java'\n}\nversion = '1.0.0'\n}\n"))
    assert g == {"plugins": {"plugins": ['id "java"']}, "version": '"1.0.0"'}
    p = json.loads(C.read_config("a.properties", "# c\na.b = 1\nlong=x\\\n   y\nu\\:v:w\\u0041\n! no\nempty\n"))
    assert p == {"a.b": "1", "long": "xy", "u:v": "wA", "empty": ""}
    assert C.read_config("a.txt", "x") is None and C.read_config("a.yml", None) is None


def test_frame(spark):
    d = C.parse_config_files(spark.createDataFrame([("a.yml", "spring:\n  application:\n    name: n"), ("b.properties", "spring.application.name= m"), ("c.yml", "a: [")], "path string, content string"))
    assert {r["path"]: r["n"] for r in d.select("path", C.app_name(d["data"]).alias("n")).collect()} == {"a.yml": "n", "b.properties": "m", "c.yml": None}


def test_docker_column_agrees(spark):
    text = "FROM a \n\n RUN b\n"
    got = spark.createDataFrame([(text,)], "t string").select(C.docker_json(F.col("t"))).first()[0]
    assert json.loads(got) == C.read_docker(text)


def system_config(name="s", **repo):
    pair = {k: v for k, v in (("branchName", repo.get("branch")), ("repositoryURL", repo.get("url"))) if v is not None}
    return {"systemName": name, "systemRepositories": [{"commitID": repo.get("commit"), "repoBranchPair": pair}] if repo else []}


GOOD = system_config(url="https://github.com/a/b.git", branch="main", commit="x")


def test_system_config(spark, tmp_path):
    assert SC.read_config_string(json.dumps(GOOD)) == GOOD
    (tmp_path / "c.json").write_text(json.dumps(GOOD, indent=1))
    assert SC.read_config_file(str(tmp_path / "c.json")) == GOOD
    assert [tuple(r) for r in SC.config_frame(spark, str(tmp_path / "c.json")).collect()] == [("s", "https://github.com/a/b.git", "main", "x", "b")]


@pytest.mark.parametrize("bad", [system_config(" ", url="https://github.com/a/b.git", branch="m", commit=""), system_config(), system_config(url="http://x/b.git", branch="m", commit=""), system_config(branch="m", commit=""), system_config(url="https://github.com/a/b.git", branch="m")])
def test_bad_config(bad):
    with pytest.raises(ValueError):
        SC.validate(bad)
