from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from codestrata.operators import diff as D
from codestrata.operators import ownership as O
from codestrata.operators.evidence import accepted, score
from codestrata.operators.matching import match_calls

FEW = settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
rows = st.dictionaries(st.integers(0, 8), st.tuples(st.sampled_from(["a", "b", None]), st.integers(0, 2)), max_size=8)
segments = st.lists(st.sampled_from("abc"), min_size=1, max_size=4).map(lambda x: "/" + "/".join(x))


def frame(spark, d):
    return spark.createDataFrame([(k, *v) for k, v in d.items()], "k long, p string, q long")


@FEW
@given(rows, rows)
def test_apply_of_diff_is_new(spark, old, new):
    o, n = frame(spark, old), frame(spark, new)
    d = D.diff(o, n, ["k"])
    assert {tuple(r) for r in D.apply(o, d, ["k"]).collect()} == {(k, *v) for k, v in new.items()}
    kinds = {r["k"]: r["change_type"] for r in d.collect()}
    assert kinds == {k: "ADD" if k not in old else "DELETE" if k not in new else "MODIFY" for k in {*old, *new} if old.get(k) != new.get(k)}
    assert D.missing_keys(o, d, ["k"]).isEmpty()


@FEW
@given(st.sets(segments, max_size=8))
def test_leaf_roots_equal_the_loop(spark, roots):
    want: set[str] = set()
    for r in sorted(roots, key=lambda x: -x.count("/")):
        if not any(w.startswith(r + "/") for w in want):
            want.add(r)
    got = O.leaf_roots(spark.createDataFrame([(r,) for r in roots], "root string"), "root")
    assert {r["root"] for r in got.collect()} == want


@FEW
@given(st.sets(segments, max_size=6), st.sets(segments, max_size=6))
def test_owner_is_the_longest_prefix(spark, files, roots):
    got = O.longest_prefix_owner(spark.createDataFrame([(f,) for f in files], "path string"), spark.createDataFrame([(r,) for r in roots], "root string"), "path", "root")
    want = {f: max((r for r in roots if f == r or f.startswith(r + "/")), key=len, default=None) for f in files}
    assert {r["path"]: r["owner"] for r in got.collect()} == want


def test_root_owns_all_and_repository_is_part_of_the_key(spark):
    files = spark.createDataFrame([("r1", "/a/x"), ("r2", "/a/x"), ("r3", "/a/x")], "repo string, path string")
    roots = spark.createDataFrame([("r1", "/a"), ("r2", "/")], "repo string, root string")
    assert {r["repo"]: r["owner"] for r in O.longest_prefix_owner(files, roots, "path", "root", ["repo"]).collect()} == {"r1": "/a", "r2": "/", "r3": None}
    assert {(r["repo"], r["root"]) for r in O.leaf_roots(roots.union(spark.createDataFrame([("r2", "/b")], roots.schema)), "root", ["repo"]).collect()} == {("r1", "/a"), ("r2", "/b")}


def test_suffix_matches_and_lookup(spark):
    stored = spark.createDataFrame([("/clone/r/a/X", 1), ("/a/X", 2), ("/b/X", 0)], "p string, rank int")
    q = spark.createDataFrame([("/a/X",), ("/deep/b/X",), ("/aX",)], "q string")
    assert {tuple(r) for r in O.suffix_matches(stored, q, "p", "q").collect()} == {("/clone/r/a/X", "/a/X", False), ("/a/X", "/a/X", True), ("/b/X", "/deep/b/X", False)}
    assert {tuple(r) for r in O.lookup(stored, q, "p", "q", rank="rank").select("query", "stored").collect()} == {("/a/X", "/a/X"), ("/deep/b/X", "/b/X")}


def test_orphans(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "id int, owner string")
    assert {tuple(r) for r in O.orphanize(rows, spark.createDataFrame([("b",)], "x string"), "owner", "x").collect()} == {(1, "a"), (2, None), (3, None)}


def test_evidence(spark):
    d = spark.createDataFrame([(1, "x", "b", 5), (1, "x", "a", 5), (1, "y", None, 2), (2, "x", "", 5)], "id int, signal string, detail string, weight int")
    got = {r["id"]: (r["score"], r["evidence"]) for r in score(d, ["id"]).collect()}
    assert got == {1: (7, ["x: a", "y"]), 2: (5, ["x"])} and [r["id"] for r in accepted(score(d, ["id"])).collect()] == [1]


def test_dedupe_and_equivalence(spark):
    d = spark.createDataFrame([(1, "b", 2), (1, "a", 1), (2, "c", 9)], "k int, v string, at int")
    assert {tuple(r) for r in D.dedupe_first(d, ["k"], ["at"]).collect()} == {(1, "a", 1), (2, "c", 9)} == {tuple(r) for r in D.first_by(d, ["k"], ["at"]).collect()}
    e = D.equivalent(d, d.union(d.limit(1))).first()
    assert (e["only_left"], e["only_right"], e["equal"]) == (0, 1, False) and D.equivalent(d, d.repartition(3)).first()["equal"]
    assert {(r["k"], r["side"]) for r in D.both_ways(d, d.where("k = 1")).collect()} == {(2, "left")}


def test_match_uses_an_equi_join(spark):
    c = spark.createDataFrame([("/a/{?}?q={?}", "GET", "s1"), ("/a/{?}", "PUT", "s1")], "url string, http_method string, service string")
    e = spark.createDataFrame([("/a/{?}", "ALL", "s2", ["q"]), ("/a/{?}", "PUT", "s2", None), ("/a/{?}", "PUT", "s1", None)], "url string, http_method string, service string, required array<string>")
    m = match_calls(c, e)
    assert sorted((r["call_http_method"], r["endpoint_http_method"]) for r in m.collect()) == [("GET", "ALL"), ("PUT", "PUT")]
    plan = m._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_pairs_of_one_address_are_made_by_many_tasks(spark, monkeypatch):
    """An address of many calls and endpoints is cut into blocks: every pair comes once, and no task makes most of them."""
    monkeypatch.setattr("codestrata.operators.matching.BLOCK", 10, raising=False)
    calls = [(i, f"/a/{{?}}?q{i % 2}={{?}}", "GET", f"s{i % 3}") for i in range(90)] + [(90, "/b", "GET", "s1"), (91, None, "GET", "s1")]
    ends = [(i, "/a/{?}", ["GET", "ALL", "PUT"][i % 3], f"s{i % 4}", [None, ["q1"], []][i % 5 % 3]) for i in range(70)] + [(70, "/b", "ALL", "s2", []), (71, None, "ALL", "s2", [])]
    c = spark.createDataFrame(calls, "id int, url string, http_method string, service string").coalesce(1)
    e = spark.createDataFrame(ends, "id int, url string, http_method string, service string, required array<string>").coalesce(1)
    m = match_calls(c, e)
    assert m.columns == [f"call_{x}" for x in c.columns] + [f"endpoint_{x}" for x in e.columns]
    got = m.select("call_id", "endpoint_id", F.spark_partition_id().alias("p")).collect()
    want = [(i, j) for i, u, h, s in calls for j, v, g, t, r in ends if u and u.split("?q")[0] == v and (h == g or g == "ALL") and s != t and all(f"{x}=" in u for x in r or [])]
    assert sorted((r["call_id"], r["endpoint_id"]) for r in got) == sorted(want)
    by = [sum(r["p"] == p for r in got) for p in {r["p"] for r in got}]
    assert len(by) > 1 and max(by) < 0.7 * len(got)


def test_prefix_join_has_no_nested_loop(spark):
    files = spark.range(10).select(F.concat(F.lit("/a/"), F.col("id").cast("string")).alias("path"))
    plan = O.longest_prefix_owner(files, files.withColumnRenamed("path", "root"), "path", "root")._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
