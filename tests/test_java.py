from codestrata.plans.system import create_from_files
from codestrata.plans.tables import call_graph, endpoints
from codestrata.sources.java_parser import parse_java
from codestrata.sources.javascript import rest_calls

POM = "<project><artifactId>{}</artifactId></project>"
APP = "package x;\n@SpringBootApplication\nclass App {}\n"
CONTROLLER = """
package users.web;
import org.x.*;
@RestController
@RequestMapping("/users")
public class UserController {
    @GetMapping public List<User> all() { return repo.findAll(); }
    @GetMapping("search") public User find(@RequestParam("email") String mail) { return null; }
    @GetMapping("/{id}") public User one(@PathVariable long id) { return null; }
    @RequestMapping(value = "/{id}/status", method = RequestMethod.PUT) void status() {}
    @PostMapping(path = "/") void add() {}
    void helper() {}
}
"""
CLIENT = """
package orders.client;
@FeignClient(name = "users")
public interface UserClient {
    @RequestMapping(value = "/users/{userId}", method = RequestMethod.GET) User get(@PathVariable("userId") long id);
    @GetMapping("/users/search") User search(@RequestParam(name = "email") String e);
    @GetMapping("/users/search") User wrong(@RequestParam String other);
}
"""
CALLER = """
package orders;
@Service
class Caller {
    private final RestTemplate rest;
    static final String BASE = "http://users:8080";
    void a(long id) {
        rest.exchange(BASE_url + "/users/" + id + "/status", HttpMethod.PUT, null, X.class);
        rest.getForObject(new String("http://users/" + "users"), X.class);
        rest.postForObject(String.format("http://users/users/%s", id), null, X.class);
        rest.delete(("http://users/" + "nothing/"));
        other.getForObject("/users", X.class);
        var client = WebClient.create();
        client.get().uri("/users/" + id).retrieve();
    }
}
"""
RESOURCE = "package r;\n@RepositoryRestResource\npublic interface ItemRepository extends CrudRepository<Item, Long> { List<Item> findByName(String n); @RestResource(exported = false) void gone(); }\n"


def system(files):
    return create_from_files(files({
        "/users/pom.xml": POM.format("users"), "/users/src/main/java/x/App.java": APP, "/users/src/main/java/users/web/UserController.java": CONTROLLER, "/users/src/main/java/r/ItemRepository.java": RESOURCE,
        "/orders/pom.xml": POM.format("orders"), "/orders/src/main/java/x/App.java": APP, "/orders/src/main/java/orders/client/UserClient.java": CLIENT, "/orders/src/main/java/orders/Caller.java": CALLER,
        "/orders/src/main/java/Broken.java": "class Broken { void f() { ", "/orders/src/main/resources/application.yml": "a: 1\n", "/stray/Thing.java": "class Thing {}",
    }))


def test_system(files):
    t = system(files)
    got = {(r["name"], r["http_method"], r["url"]) for r in t["endpoints"].collect()}
    assert got == {("all", "GET", "/users"), ("find", "GET", "/users/search"), ("one", "GET", "/users/{?}"), ("status", "PUT", "/users/{?}/status"), ("add", "POST", "/users")}
    both = {r["url"] for r in endpoints(t["methods"], include_repositories=True).collect()} - {u for _, _, u in got}
    assert both == {"/items/search/findByName"}
    calls = sorted((r["called_from"], r["http_method"], r["url"]) for r in t["rest_calls"].collect())
    assert calls == sorted([("get", "GET", "/users/{?}"), ("search", "GET", "/users/search?email={?}"), ("wrong", "GET", "/users/search?other={?}"), ("a", "PUT", "/users/{?}/status"), ("a", "GET", "/users"), ("a", "POST", "/users/{?}"), ("a", "DELETE", "/nothing"), ("a", "GET", "/users/{?}")])
    graph = sorted((r["call_url"], r["endpoint_url"]) for r in call_graph(t).collect())
    assert graph == sorted([("/users/{?}", "/users/{?}"), ("/users/{?}", "/users/{?}"), ("/users/search?email={?}", "/users/search"), ("/users/{?}/status", "/users/{?}/status"), ("/users", "/users")])
    roles = {(r["name"], r["role"], r["role_bucket"], r["service_name"]) for r in t["classes"].collect()}
    assert ("UserController", "CONTROLLER", "controllers", "users") in roles and ("ItemRepository", "REP_REST_RSC", "repositories", "users") in roles and ("Thing", "UNKNOWN", "unknowns", None) in roles
    assert [r["path"] for r in t["errors"].collect()] == ["/orders/src/main/java/Broken.java"]
    assert {r["path"] for r in t["config_files"].collect()} == {"/users/pom.xml", "/orders/pom.xml", "/orders/src/main/resources/application.yml"}


def test_parser_details():
    r = parse_java('package p;\nimport a.b.C;\nimport static d.E.*;\n/** doc } */\npublic final class X<T extends Y> extends Base<T> implements I, J<K> {\n'
                   ' private static int a = 1, b[] = {2, 3}; String s = """\n text " block""";\n'
                   ' X() { this.go(); }\n <R> Map<String, List<R>> m(final int... xs) throws E1, E2 { return a < b && c > d ? f(x -> { g(x); }) : null; }\n enum In { A, B(1) { void z() {} }; }\n record Rec(int q) {} }\n')  # fmt: skip
    assert r["parse_error"] is None
    assert (r["package"], r["name"], r["class_type"], r["extended_types"], r["implemented_types"], r["is_final"]) == ("p", "X", "CLASS", ["Base"], ["I", "J"], True)
    assert [(i["package"], i["object"], i["is_static"]) for i in r["imports"]] == [("a.b", "C", False), ("d.E", "*", True)]
    assert [(f["name"], f["field_type"], f["initializer"]) for f in r["fields"]][:2] == [("a", "int", "1"), ("b", "int[]", "{2, 3}")]
    m = r["methods"][0]
    assert (m["name"], m["return_type"], m["thrown"], m["parameters"][0]["is_varargs"]) == ("m", "Map<String, List<R>>", ["E1", "E2"], True)
    assert sorted(c["name"] for c in r["calls"]) == ["f", "g", "go"]
    e = parse_java("enum E implements I { A, B }")
    assert (e["class_type"], e["enum_constants"], e["implemented_types"], e["is_final"], e["is_static"]) == ("ENUM", ["A", "B"], ["I"], True, True)
    assert parse_java("record R(int a, String b) implements Z {}")["is_final"]
    assert parse_java("class {")["parse_error"] and parse_java("")["parse_error"] and parse_java('class A { String s = "x; }')["parse_error"]
    after = parse_java("class Ok {}")
    assert after["package"] == "" and after["parse_error"] is None


def test_annotation_values():
    r = parse_java('@A @B("x") @C(k = "v", n = 3, l = {"one"}) @D(X.class) class T {}')
    assert [(a["name"], a["attributes"]) for a in r["class_annotations"]] == [("A", {}), ("B", {"default": "x"}), ("C", {"k": "v", "n": "3", "l": "one"}), ("D", {})]


def test_javascript():
    js = 'const base = "http://h/api";\nconst url = base + "/users";\nfetch(url + "/1", {method: "POST"});\naxios.get(`${base}/x`);\naxios.delete(unknown + "/y");\n'
    assert [(c["url"], c["http_method"], c["line"]) for c in rest_calls(js)] == [("http://h/api/users/1", "POST", 3), ("http://h/api/x", "GET", 4), ("{?}/y", "DELETE", 5)]
    assert rest_calls('let a = "x/";\nfetch(a + "/b");', slash_join=True)[0]["url"] == "x/b"
