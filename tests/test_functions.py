import pytest
from pyspark.sql import functions as F

from codestrata.functions import paths as P
from codestrata.functions import roles as R
from codestrata.functions import source_text as S
from codestrata.functions import urls as U


def one(spark, column):
    return spark.range(1).select(column).first()[0]


@pytest.mark.parametrize("path,want", [("/app/clone/shop/service/A.java", "/service/A.java"), ("file:///app/clone/shop/service/A.java", "/service/A.java"), ("C:\\w\\clone\\shop\\service\\A.java", "/service/A.java"), (".\\clone\\shop\\service\\A.java", "/service/A.java"), ("clone/shop", "/"), ("./a//b/", "/a/b"), ("", ""), (None, None), (" . ", "/"), ("/other/x", "/other/x")])
def test_repo_relative(spark, path, want):
    assert one(spark, P.repo_relative(F.lit(path).cast("string"), "shop")) == want


@pytest.mark.parametrize("path", ["././a//b/", "/", "//", "file:x/", "a\\b\\", "", "  /x ", "./"])
def test_normalize_agrees(spark, path):
    assert one(spark, P.normalize(F.lit(path))) == P.normalize_text(path)


def test_path_parts(spark):
    assert one(spark, P.suffixes(F.lit("/a/b/c"))) == ["/a/b/c", "/b/c", "/c"] and one(spark, P.suffixes(F.lit("/"))) == []
    assert one(spark, P.prefixes(F.lit("/a/b"))) == ["/", "/a", "/a/b"] and one(spark, P.prefixes(F.lit("/a/b"), with_self=False)) == ["/", "/a"] and one(spark, P.prefixes(F.lit("/"), with_root=False)) == []
    assert one(spark, P.node_name(F.lit("/x/Foo.java"))) == "Foo" and one(spark, P.directory(F.lit("/x/y/Foo.java"))) == "/x/y"
    assert one(spark, P.repo_name(F.lit("https://github.com/o/my.repo.git"))) == "my.repo" and one(spark, P.local_path(F.lit("a/b"), "r")) == "./clone/r/a/b"
    assert one(spark, P.service_name(F.lit("./clone/r/svc"))) == "svc" and one(spark, P.service_name(F.lit("/else/svc"))) is None


@pytest.mark.parametrize("pre,own,want", [("/x", None, "/x"), (None, None, "/"), ("x", "y", "/xy"), ("/x", "y/{id}/", "/x/y/{?}"), (None, "a", "/a"), ("/x/", "/y", "/x/y")])
def test_endpoint_url(spark, pre, own, want):
    m = lambda v: F.create_map(F.lit("value"), F.lit(v)) if v else F.create_map().cast("map<string,string>")
    assert one(spark, U.endpoint_url(m(pre), m(own))) == want


def test_urls(spark):
    m = F.create_map(F.lit("value"), F.lit("x"))
    assert one(spark, U.endpoint_url(m, F.create_map(F.lit("path"), F.lit("y")), fix_both_slashes=True)) == "/x/y"
    assert one(spark, U.template(F.lit("/a/{id}/{b}"))) == "/a/{?}/{?}"
    assert [one(spark, U.clean(F.lit(u))) for u in ("http://h:1/a/", "https://h", "/a\"", "h/b")] == ["/a", "h", "/a", "/b"]
    assert one(spark, U.base(F.lit("/a/{?}/b?x={?}"))) == "/a/{?}/b" and one(spark, U.query(F.lit("/a/{?}/b?x={?}"))) == "x={?}" and one(spark, U.query(F.lit("/a/{?}"))) == ""
    assert one(spark, U.http_from_exchange(F.lit("u, HttpMethod.PUT, HttpMethod.POST"))) == "POST" and one(spark, U.http_from_exchange(F.lit("u"))) == "GET"
    assert [one(spark, U.http_from_call(F.lit(n), F.lit("HttpMethod.DELETE"))) for n in ("exchange", "put", "options", "getForObject")] == ["DELETE", "PUT", "NONE", "GET"]
    assert one(spark, U.literal_url(F.lit('String.format("http://h/y/%s/z", id)'))) == "/y/{?}/z"
    assert one(spark, U.query_string(F.array(F.lit("a"), F.lit("b")))) == "?a={?}&b={?}" and one(spark, U.query_string(F.array().cast("array<string>"))) == ""
    need = F.array(F.lit("q"))
    assert one(spark, U.has_parameters(F.lit("/a/{?}?q={?}"), need)) and not one(spark, U.has_parameters(F.lit("/q=/{?}"), need)) and one(spark, U.has_parameters(F.lit("/a"), F.array().cast("array<string>")))
    assert one(spark, U.endpoint_method(F.create_map(F.lit("method"), F.lit("RequestMethod.PUT")), F.lit("RequestMapping"))) == "PUT"


def test_source_text(spark):
    code = 'int a = 1; // one\nString s = "http://x"; /* two\n lines */ b();'
    assert one(spark, S.stripped(F.lit(code))) == 'inta=1;Strings="http:lines*/b();'
    assert one(spark, S.stripped(F.lit(code), string_aware=True)) == 'inta=1;Strings="http://x";b();'
    assert one(spark, S.is_valid_file(F.lit("/a/B.java"))) and not one(spark, S.is_valid_file(F.lit("/.github/x.yml"))) and one(spark, S.is_config_file(F.lit("/a/pom.xml"))) and not one(spark, S.is_config_file(F.lit("/a/B.java")))
    assert one(spark, S.in_ignored_dir(F.lit("a/build/x.yml"))) and not one(spark, S.in_ignored_dir(F.lit("a/build")))
    assert one(spark, S.unquoted(F.lit('"a"'))) == "a" and one(spark, S.unquoted(F.lit('"'))) == '"'
    assert one(spark, S.first_lines(F.lit(" a \n\n b tok\nc\nd"), 3, F.lit("tok"))) == "a b *** c"
    assert one(spark, S.count_occurrences(F.lit("axbxc"), "x")) == 2 and one(spark, S.imports_whole_package(F.lit("a.b.*")))
    assert one(spark, S.has_deployment_kind(F.lit("x\n kind : Deployment \n"))) and not one(spark, S.has_deployment_kind(F.lit("kind:\nDeployment")))


def test_roles(spark):
    names = lambda *x: F.array(*[F.lit(n) for n in x]) if x else F.array().cast("array<string>")
    assert [one(spark, R.class_role(names(*a), names(*e))) for a, e in ((("Slf4j", "Service", "RestController"), ()), ((), ("CrudRepository",)), (("X",), ()), (("Embeddable",), ()))] == ["SERVICE", "REPOSITORY", "UNKNOWN", "ENTITY"]
    assert one(spark, R.bucket(F.lit("REP_REST_RSC"))) == "repositories" and one(spark, R.access_modifier(F.lit(""))) == "PACKAGE_PRIVATE" and one(spark, R.change_type(F.lit("R"))) is None and one(spark, R.class_type_of_role(F.lit("FEIGN_CLIENT"))) == "INTERFACE"
