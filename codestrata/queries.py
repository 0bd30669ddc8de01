"""The engine's operators applied to ordinary tables, each with the SQL that states the same result.

Pages stand for files and endpoints (their addresses have hosts, paths and queries), orders for snapshots that change, events for
annotated classes, documents and conversations for source text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import paths as P
from .functions import roles as R
from .functions import source_text as S
from .functions import urls as U
from .operators import diff as D
from .operators import evidence as E
from .operators import ownership as O
from .operators.matching import match_calls

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(sql: str):
    """Register a query under its function's name with the SQL that gives the same rows."""

    def add(f):
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = sql
        return f

    return add


# Address parts, in Spark and in SQL. Expressions of both must stay in the common subset of Java's and RE2's patterns.
def url_path(url: Column) -> Column:
    """Path without scheme, host, query and fragment; numbers as placeholders."""
    p = F.regexp_replace(F.regexp_replace(url, "[?#].*$", ""), "^https?://[^/]+", "")
    return F.regexp_replace(P.normalize(p), "[0-9]+", "{?}")


PATH_SQL = "regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(url, '[?#].*$', ''), '^https?://[^/]+', ''), '/+', '/', 'g'), '(.)/$', '\\1'), '[0-9]+', '{?}', 'g')"
RAW_PATH_SQL = "regexp_replace(regexp_replace(regexp_replace(regexp_replace(url, '[?#].*$', ''), '^https?://', '/'), '/+', '/', 'g'), '(.)/$', '\\1')"


def raw_path(url: Column) -> Column:
    """Host and path as one absolute path."""
    return P.absolute(F.regexp_replace(F.regexp_replace(url, "[?#].*$", ""), "^https?://", "/"))


# -- scalar functions


@query(f"SELECT page_id, {PATH_SQL} AS template FROM pages")
def url_template(spark, sf):
    return table(spark, sf, "pages").select("page_id", url_path(F.col("url")).alias("template"))


@query("""
SELECT page_id, regexp_replace(regexp_replace(CASE WHEN strpos(u, '/') > 1 THEN substr(u, strpos(u, '/')) ELSE u END, '"$', ''), '/$', '') AS cleaned
FROM (SELECT page_id, regexp_replace(url, 'https?://', '', 'g') AS u FROM pages)
""")
def url_clean(spark, sf):
    return table(spark, sf, "pages").select("page_id", U.clean(F.col("url")).alias("cleaned"))


@query("""
SELECT page_id, CASE WHEN length(p) > 1 THEN regexp_replace(p, '/$', '') ELSE p END AS path
FROM (SELECT page_id, regexp_replace(regexp_replace(replace(trim('./' || substr(url, 7) || '//'), '\\', '/'), '^(\\./)+', ''), '/+', '/', 'g') AS p FROM pages)
""")
def path_normalize(spark, sf):
    return table(spark, sf, "pages").select("page_id", P.normalize(F.concat(F.lit("./"), F.substr("url", F.lit(7)), F.lit("//"))).alias("path"))


@query(f"SELECT page_id, regexp_extract({RAW_PATH_SQL}, '([^/]*)$', 1) AS segment, regexp_replace({RAW_PATH_SQL}, '/[^/]*$', '') AS directory FROM pages")
def path_last_segment(spark, sf):
    p = raw_path(F.col("url"))
    return table(spark, sf, "pages").select("page_id", P.last_segment(p).alias("segment"), P.directory(p).alias("directory"))


@query(f"""
SELECT page_id, '/' || array_to_string(list_slice(parts, 1, i), '/') AS prefix
FROM (SELECT page_id, list_filter(string_split({RAW_PATH_SQL}, '/'), lambda x: x <> '') AS parts FROM pages) AS t, unnest(range(1, len(parts) + 1)) AS u(i)
""")
def path_prefixes(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.explode(P.prefixes(raw_path(F.col("url")), with_root=False)).alias("prefix"))


@query(f"""
SELECT page_id, '/' || array_to_string(list_slice(parts, i, len(parts)), '/') AS suffix
FROM (SELECT page_id, list_filter(string_split({RAW_PATH_SQL}, '/'), lambda x: x <> '') AS parts FROM pages) AS t, unnest(range(1, len(parts) + 1)) AS u(i)
""")
def path_suffixes(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.explode(P.suffixes(raw_path(F.col("url")))).alias("suffix"))


@query(f"""
SELECT page_id, CASE WHEN trim(r) IN ('', '.') THEN '/' WHEN starts_with(r, '/') THEN r ELSE '/' || r END AS path
FROM (SELECT page_id, substr(p, length('/app/clone/shop') + 1) AS r FROM (SELECT page_id, '/app/clone/shop' || {RAW_PATH_SQL} AS p FROM pages))
""")
def path_repo_relative(spark, sf):
    full = F.concat(F.lit("/app/clone/shop"), raw_path(F.col("url")))
    return table(spark, sf, "pages").select("page_id", P.repo_relative(full, "shop").alias("path"))


@query("""
SELECT page_id, ends_with(p, '/index.html') OR ends_with(p, '.yml') OR ends_with(p, '0') OR ends_with(p, '5') AS valid,
       list_has_any(string_split(regexp_replace(p, '/?[^/]*$', ''), '/'), ['fr', 'de']) AS ignored
FROM (SELECT page_id, regexp_replace(url, '[?#].*$', '') AS p FROM pages)
""")
def valid_file_filter(spark, sf):
    p = F.regexp_replace("url", "[?#].*$", "")
    return table(spark, sf, "pages").select("page_id", S.is_valid_file(p, ["/index.html", ".yml", "0", "5"]).alias("valid"), S.in_ignored_dir(p, ["fr", "de"]).alias("ignored"))


@query("""
SELECT event_id, CASE event_type WHEN 'click' THEN 'GET' WHEN 'view' THEN 'POST' ELSE 'ALL' END AS mapped,
       CASE WHEN contains(a, 'HttpMethod.POST') THEN 'POST' WHEN contains(a, 'HttpMethod.PUT') THEN 'PUT' WHEN contains(a, 'HttpMethod.DELETE') THEN 'DELETE' WHEN contains(a, 'HttpMethod.PATCH') THEN 'PATCH' ELSE 'GET' END AS exchanged
FROM (SELECT event_id, event_type, 'url, HttpMethod.' || ['GET', 'POST', 'PUT', 'DELETE', 'PATCH'][(user_id % 5 + 1)::INT] || ', null' AS a FROM events)
""")
def http_method_case(spark, sf):
    e = table(spark, sf, "events")
    name = F.when(F.col("event_type") == "click", "GetMapping").when(F.col("event_type") == "view", "RequestMethod.POST").otherwise("RequestMapping")
    args = F.concat(F.lit("url, HttpMethod."), F.element_at(F.array(*[F.lit(m) for m in ("GET", "POST", "PUT", "DELETE", "PATCH")]), (F.col("user_id") % 5 + 1).cast("int")), F.lit(", null"))
    return e.select("event_id", U.http_from_mapping(name).alias("mapped"), U.http_from_exchange(args).alias("exchanged"))


@query("""
WITH a AS (SELECT o_orderkey, 'orders' || o_orderkey % 7 AS pre, ['', '/{id}', 'list/', '/a//b'][(o_custkey % 4 + 1)::INT] AS own FROM orders),
j AS (SELECT o_orderkey, replace('/' || pre || own, '//', '/') AS u FROM a)
SELECT o_orderkey, regexp_replace(CASE WHEN length(u) > 1 AND ends_with(u, '/') THEN left(u, length(u) - 1) ELSE u END, '\\{[^{}]*\\}', '{?}', 'g') AS url FROM j
""")
def endpoint_urls(spark, sf):
    own = F.element_at(F.array(*[F.lit(x) for x in ("", "/{id}", "list/", "/a//b")]), (F.col("o_custkey") % 4 + 1).cast("int"))
    of_class = F.create_map(F.lit("value"), F.concat(F.lit('"orders'), (F.col("o_orderkey") % 7).cast("string"), F.lit('"')))
    return table(spark, sf, "orders").select("o_orderkey", U.endpoint_url(of_class, F.create_map(F.lit("path"), own)).alias("url"))


@query("""
SELECT doc_id, (length(text) - length(replace(text, 'the', ''))) // 3 AS n FROM documents
""")
def count_occurrences(spark, sf):
    return table(spark, sf, "documents").select("doc_id", S.count_occurrences(F.col("text"), "the").alias("n"))


@query("""
SELECT conv_id, turn, CASE WHEN length(t) >= 2 AND starts_with(t, '"') AND ends_with(t, '"') THEN substr(t, 2, length(t) - 2) ELSE t END AS bare
FROM (SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN '"' || role || '"' ELSE role || '"' END AS t FROM conversations)
""")
def strip_quotes(spark, sf):
    t = F.when(F.col("turn") % 2 == 0, F.concat(F.lit('"'), "role", F.lit('"'))).otherwise(F.concat("role", F.lit('"')))
    return table(spark, sf, "conversations").select("conv_id", "turn", S.unquoted(t).alias("bare"))


@query("""
SELECT page_id, regexp_extract(h, '^(.*)\\.[^.]+$', 1) AS package, regexp_extract(h, '([^.]+)$', 1) AS object
FROM (SELECT page_id, regexp_extract(url, '^https?://([^/:?#]+)', 1) AS h FROM pages)
""")
def import_split(spark, sf):
    h = F.regexp_extract("url", "^https?://([^/:?#]+)", 1)
    return table(spark, sf, "pages").select("page_id", S.import_package(h).alias("package"), S.import_object(h).alias("object"))


@query("""
SELECT conv_id, turn, replace(array_to_string(list_slice(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> ''), 1, 3), ' '), role, '***') AS head FROM conversations
""")
def first_three_lines(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", S.first_lines(F.col("text"), 3, F.col("role")).alias("head"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def config_json_lookup(spark, sf):
    return table(spark, sf, "events").select("event_id", F.try_variant_get(F.parse_json("props"), "$.k", "long").alias("k"))


@query("""
SELECT doc_id, coalesce(nullif(trim(CASE WHEN doc_id % 3 = 0 THEN '  ' ELSE split_part(text, chr(10), 1) END), ''), nullif(trim(CASE WHEN doc_id % 2 = 0 THEN ' ' ELSE source END), ''), lang) AS name FROM documents
""")
def name_priority(spark, sf):
    first = F.when(F.col("doc_id") % 3 == 0, "  ").otherwise(F.split_part(F.col("text"), F.lit("\n"), F.lit(1)))
    second = F.when(F.col("doc_id") % 2 == 0, " ").otherwise(F.col("source"))
    return table(spark, sf, "documents").select("doc_id", F.coalesce(S.non_blank(first), S.non_blank(second), F.col("lang")).alias("name"))


@query("""
SELECT conv_id, turn, '{"instructions":[' || array_to_string(list_transform(string_split(regexp_replace(role || chr(10) || ' x y ' || turn || ' ' || chr(10), '\n$', ''), chr(10)), lambda x: '"' || trim(x) || '"'), ',') || ']}' AS json FROM conversations
""")
def docker_json(spark, sf):
    from .sources.config_files import docker_json as as_json

    text = F.concat("role", F.lit("\n x y "), F.col("turn").cast("string"), F.lit(" \n"))
    return table(spark, sf, "conversations").select("conv_id", "turn", as_json(text).alias("json"))


@query("""
SELECT conv_id, turn, 'a=' || role || ',z=' || turn AS contents FROM conversations
""")
def annotation_contents(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", S.annotation_contents(F.create_map(F.lit("z"), F.col("turn").cast("string"), F.lit("a"), F.col("role"))).alias("contents"))


# -- ownership


def _pages(spark, sf) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", raw_path(F.col("url")).alias("path"))


def _roots(pages: DataFrame) -> DataFrame:
    """Directories that hold two or more pages, at any depth."""
    d = pages.select("page_id", F.explode(P.prefixes(F.col("path"), with_root=False, with_self=False)).alias("root"))
    return d.groupBy("root").agg(F.count("*").alias("n")).where("n >= 2")


ROOTS_SQL = f"""
p AS (SELECT page_id, {RAW_PATH_SQL} AS path FROM pages),
x AS (SELECT page_id, path, list_filter(string_split(path, '/'), lambda x: x <> '') AS parts FROM p),
r AS (SELECT '/' || array_to_string(list_slice(parts, 1, i), '/') AS root FROM x, unnest(range(1, len(parts))) AS u(i) GROUP BY 1 HAVING count(*) >= 2)
"""


@query(f"""
WITH {ROOTS_SQL},
m AS (SELECT path, root, row_number() OVER (PARTITION BY path ORDER BY length(root) DESC) AS rn FROM (SELECT DISTINCT path FROM p) AS d JOIN r ON path = root OR starts_with(path, root || '/'))
SELECT page_id, p.path, m.root AS owner FROM p LEFT JOIN m ON p.path = m.path AND rn = 1
""")
def owner_longest_prefix(spark, sf):
    pages = _pages(spark, sf)
    distinct = pages.select("path").distinct()
    owned = O.longest_prefix_owner(distinct, _roots(pages), "path", "root", with_root=False)
    return pages.join(owned, "path").select("page_id", "path", "owner")


@query(f"""
WITH {ROOTS_SQL} SELECT root FROM r WHERE NOT EXISTS (SELECT 1 FROM r AS o WHERE starts_with(o.root, r.root || '/'))
""")
def leaf_candidates(spark, sf):
    return O.leaf_roots(_roots(_pages(spark, sf)).select("root"), "root")


@query(f"""
WITH p AS (SELECT DISTINCT {RAW_PATH_SQL} AS stored FROM pages),
q AS (SELECT DISTINCT regexp_replace({RAW_PATH_SQL}, '^/[^/]*', '') AS query FROM pages)
SELECT stored, query, stored = query AS exact FROM p JOIN q ON query <> '' AND (stored = query OR ends_with(stored, query) OR ends_with(query, stored))
""")
def suffix_match(spark, sf):
    pages = _pages(spark, sf)
    q = pages.select(F.regexp_replace("path", "^/[^/]*", "").alias("query")).where("query <> ''")
    return O.suffix_matches(pages, q, "path", "query").select("stored", "query", "exact")


@query(f"""
WITH p AS (SELECT DISTINCT {RAW_PATH_SQL} AS stored FROM pages),
q AS (SELECT DISTINCT regexp_replace({RAW_PATH_SQL}, '^/[^/]*', '') AS query FROM pages)
SELECT query, min(stored) AS stored FROM p JOIN q ON query <> '' AND ends_with(stored, query) GROUP BY query
""")
def path_lookup(spark, sf):
    pages = _pages(spark, sf)
    q = pages.select(F.regexp_replace("path", "^/[^/]*", "").alias("query")).where("query <> ''")
    return O.lookup(pages, q, "path", "query").select("query", "stored")


@query("""
WITH s AS (SELECT s_suppkey, '/n' || s_nationkey || '/s' || s_suppkey AS path FROM supplier), n AS (SELECT '/n' || n_nationkey AS root FROM nation JOIN region ON n_regionkey = r_regionkey AND length(r_name) < 7)
SELECT s_suppkey, path, root AS owner FROM s LEFT JOIN n ON starts_with(path, root || '/')
""")
def adopt_orphans(spark, sf):
    s = table(spark, sf, "supplier").select("s_suppkey", F.concat(F.lit("/n"), F.col("s_nationkey").cast("string"), F.lit("/s"), F.col("s_suppkey").cast("string")).alias("path"))
    n = table(spark, sf, "nation").join(table(spark, sf, "region").where("length(r_name) < 7"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.concat(F.lit("/n"), F.col("n_nationkey").cast("string")).alias("root"))
    owned, orphans = O.adopt(s, n, "path", "root")
    return owned.unionByName(orphans.withColumn("owner", F.lit(None).cast("string"))).select("s_suppkey", "path", "owner")


@query("""
SELECT s_suppkey, CASE WHEN n_nationkey IS NULL THEN s_nationkey::VARCHAR END AS owner FROM supplier LEFT JOIN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1) ON s_nationkey = n_nationkey
""")
def orphan_rows(spark, sf):
    gone = table(spark, sf, "nation").where("n_regionkey = 1")
    return O.orphanize(table(spark, sf, "supplier").select("s_suppkey", F.col("s_nationkey").cast("string").alias("owner")), gone.withColumn("n_nationkey", F.col("n_nationkey").cast("string")), "owner", "n_nationkey")


# -- evidence, roles

TAGS = {"article": ("<article", 5), "nav": ("<nav", 3), "ad": ('class="ad"', 2), "heading": ("<h2", 4), "table": ("<table", 3), "script": ("<script", 0)}
TAG_SQL = " UNION ALL ".join(f"SELECT page_id, '{k}' AS signal, {w} AS weight FROM pages WHERE contains(html, '{t}')" for k, (t, w) in TAGS.items())


def _signals(spark, sf) -> DataFrame:
    found = F.array_compact(F.array(*[F.when(F.contains("html", F.lit(t)), F.struct(F.lit(k).alias("signal"), F.lit(w).alias("weight"))) for k, (t, w) in TAGS.items()]))
    return table(spark, sf, "pages").select("page_id", F.inline(found))


@query(TAG_SQL)
def evidence_rows(spark, sf):
    return _signals(spark, sf)


@query(f"""
SELECT page_id, sum(weight)::INT AS score, string_agg(signal, ',' ORDER BY signal) AS evidence FROM ({TAG_SQL}) GROUP BY page_id HAVING sum(weight) >= 7
""")
def evidence_score(spark, sf):
    scored = E.score(_signals(spark, sf).withColumn("detail", F.lit("")), ["page_id"])
    return E.accepted(scored).select("page_id", "score", F.array_join("evidence", ",").alias("evidence"))


ROLE_SQL = "CASE event_type WHEN 'click' THEN 'CONTROLLER' WHEN 'view' THEN 'SERVICE' WHEN 'purchase' THEN 'REP_REST_RSC' WHEN 'signup' THEN 'ENTITY' ELSE 'UNKNOWN' END"
BUCKET_SQL = f"CASE {ROLE_SQL} WHEN 'CONTROLLER' THEN 'controllers' WHEN 'SERVICE' THEN 'services' WHEN 'REP_REST_RSC' THEN 'repositories' WHEN 'ENTITY' THEN 'entities' ELSE 'unknowns' END"


def _role() -> Column:
    name = R.mapped(F.col("event_type"), {"click": "RestController", "view": "Service", "purchase": "RepositoryRestResource", "signup": "Entity"}, "Other")
    return R.class_role(F.array(F.lit("Slf4j"), name), F.array(F.lit("Base")))


@query(f"SELECT {ROLE_SQL} AS role, {BUCKET_SQL} AS bucket, count(*) AS n FROM events GROUP BY ALL")
def role_bucket(spark, sf):
    return table(spark, sf, "events").select(_role().alias("role")).groupBy("role", R.bucket(F.col("role")).alias("bucket")).agg(F.count("*").alias("n"))


@query(f"""
SELECT user_id, count(*) FILTER ({BUCKET_SQL} = 'controllers') AS controllers, count(*) FILTER ({BUCKET_SQL} = 'services') AS services, count(*) FILTER ({BUCKET_SQL} = 'repositories') AS repositories, count(*) AS all_classes FROM events GROUP BY user_id
""")
def role_pivot_counts(spark, sf):
    e = table(spark, sf, "events").select("user_id", R.bucket(_role()).alias("b"))
    return e.groupBy("user_id").agg(*[F.count(F.when(F.col("b") == b, 1)).alias(b) for b in ("controllers", "services", "repositories")], F.count("*").alias("all_classes"))


# -- matching


@query(f"""
WITH p AS (SELECT page_id, regexp_extract(url, '^https?://([^/:?#]+)', 1) AS service, {PATH_SQL} AS template, regexp_extract(url, '[?]([^#]*)', 1) AS q, ['GET', 'ALL'][(page_id % 2 + 1)::INT] AS m FROM pages),
c AS (SELECT * FROM p WHERE q <> ''), e AS (SELECT * FROM p WHERE q = '')
SELECT c.page_id AS call_id, e.page_id AS endpoint_id, c.template AS template FROM c JOIN e ON c.template = e.template AND c.service <> e.service AND (e.m = 'GET' OR e.m = 'ALL')
WHERE e.page_id % 3 <> 0 OR contains(c.q, 'page=')
""")
def call_endpoint_match(spark, sf):
    p = table(spark, sf, "pages").select(F.col("page_id").alias("id"), F.regexp_extract("url", "^https?://([^/:?#]+)", 1).alias("service"), url_path(F.col("url")).alias("template"), F.regexp_extract("url", "[?]([^#]*)", 1).alias("q"))
    c = p.where("q <> ''").select("id", "service", "template", F.concat("template", F.lit("?"), "q").alias("url"), F.lit("GET").alias("http_method"))
    required = F.when(F.col("id") % 3 == 0, F.array(F.lit("page"))).otherwise(F.array().cast("array<string>"))
    e = p.where("q = ''").select("id", "service", F.col("template").alias("url"), F.when(F.col("id") % 2 == 0, "GET").otherwise("ALL").alias("http_method"), required.alias("required"))
    return match_calls(c, e).select("call_id", "endpoint_id", F.col("call_template").alias("template"))


@query("""
SELECT page_id, contains(q, 'page=') AS has_page, contains(q, 'page=') AND contains(q, 'ref=') AS has_both FROM (SELECT page_id, regexp_extract(url, '[?](.*)$', 1) AS q FROM pages)
""")
def required_params(spark, sf):
    p = table(spark, sf, "pages")
    return p.select("page_id", U.has_parameters(F.col("url"), F.array(F.lit("page"))).alias("has_page"), U.has_parameters(F.col("url"), F.array(F.lit("page"), F.lit("ref"))).alias("has_both"))


@query("""
SELECT l_orderkey, '?' || string_agg('p' || l_partkey || '={?}', '&' ORDER BY l_linenumber, l_partkey) AS query FROM lineitem GROUP BY l_orderkey
""")
def feign_query_string(spark, sf):
    g = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))).alias("p"))
    return g.select("l_orderkey", U.query_string(F.transform("p", lambda x: F.concat(F.lit("p"), x["l_partkey"].cast("string")))).alias("query"))


# -- difference and merge

ORDER_SQL = """
o AS (SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders),
n AS (SELECT CASE WHEN o_orderkey % 7 = 0 THEN -o_orderkey ELSE o_orderkey END AS o_orderkey, CASE WHEN o_orderkey % 11 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus, o_totalprice FROM orders)
"""
DIFF_SQL = f"""{ORDER_SQL},
d AS (
  SELECT o_orderkey, CASE WHEN o.o_orderstatus IS NULL THEN 'ADD' WHEN n.o_orderstatus IS NULL THEN 'DELETE' WHEN o.o_orderstatus <> n.o_orderstatus OR o.o_totalprice <> n.o_totalprice THEN 'MODIFY' END AS change_type,
         o.o_orderstatus AS old_o_orderstatus, n.o_orderstatus AS new_o_orderstatus, o.o_totalprice AS old_o_totalprice, n.o_totalprice AS new_o_totalprice
  FROM o FULL OUTER JOIN n USING (o_orderkey))
"""


def _snapshots(spark, sf) -> tuple[DataFrame, DataFrame]:
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    edited = F.when(F.col("o_orderkey") % 11 == 0, "X").otherwise(F.col("o_orderstatus"))
    moved = F.when(F.col("o_orderkey") % 7 == 0, -F.col("o_orderkey")).otherwise(F.col("o_orderkey"))
    return o, o.withColumn("o_orderstatus", edited).withColumn("o_orderkey", moved)


@query(f"WITH {DIFF_SQL} SELECT * FROM d WHERE change_type IS NOT NULL")
def component_diff(spark, sf):
    return D.diff(*_snapshots(spark, sf), ["o_orderkey"])


@query(f"WITH {DIFF_SQL} SELECT change_type, count(*) AS n FROM d WHERE change_type IS NOT NULL GROUP BY change_type")
def delta_summary(spark, sf):
    return D.summary(D.diff(*_snapshots(spark, sf), ["o_orderkey"]))


@query(f"WITH {ORDER_SQL} SELECT * FROM n")
def merge_apply(spark, sf):
    old, new = _snapshots(spark, sf)
    return D.apply(old, D.diff(old, new, ["o_orderkey"]), ["o_orderkey"])


@query("SELECT 0::BIGINT AS only_left, 0::BIGINT AS only_right, true AS equal")
def system_equivalence(spark, sf):
    old, new = _snapshots(spark, sf)
    return D.equivalent(D.apply(old, D.diff(old, new, ["o_orderkey"]), ["o_orderkey"]), new)


@query(f"WITH {ORDER_SQL} SELECT o_orderkey FROM o WHERE o_orderkey NOT IN (SELECT o_orderkey FROM n)")
def remove_by_key(spark, sf):
    old, new = _snapshots(spark, sf)
    return D.remove_by_key(old, new, ["o_orderkey"]).select("o_orderkey")


@query("""
WITH c AS (SELECT c_custkey AS k FROM customer), o AS (SELECT DISTINCT o_custkey + 10 AS k FROM orders)
SELECT k, 'left' AS side FROM c WHERE k NOT IN (SELECT k FROM o) UNION ALL SELECT k, 'right' FROM o WHERE k NOT IN (SELECT k FROM c)
""")
def set_diff_both(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("k"))
    o = table(spark, sf, "orders").select((F.col("o_custkey") + 10).alias("k")).distinct()
    return D.both_ways(c, o)


@query("SELECT md5(text) AS text_md5, min(doc_id) AS doc_id, arg_min(source, doc_id) AS source FROM documents GROUP BY md5(text)")
def dedupe_first(spark, sf):
    d = table(spark, sf, "documents").select(F.md5("text").alias("text_md5"), "doc_id", "source")
    return D.dedupe_first(d, ["text_md5"], ["doc_id"])


@query("""
SELECT md5(regexp_replace(text, '//[^\n]*|\\s+', '', 'g')) AS code, count(*) AS versions, count(DISTINCT text) AS texts FROM documents GROUP BY ALL
""")
def cosmetic_filter(spark, sf):
    d = table(spark, sf, "documents").select(F.md5(S.stripped(F.col("text"))).alias("code"), "text")
    return d.groupBy("code").agg(F.count("*").alias("versions"), F.countDistinct("text").alias("texts"))


@query("""
SELECT o_orderkey, coalesce(c_mktsegment, o_orderpriority) AS commit FROM orders LEFT JOIN customer ON o_custkey = c_custkey + 10 AND o_orderstatus = CASE WHEN c_acctbal < 0 THEN 'F' ELSE 'O' END
""")
def commit_coalesce(spark, sf):
    from .plans.delta import update_commits

    o = table(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").alias("repo"), F.col("o_orderstatus").alias("branch"), F.col("o_orderpriority").alias("commit"))
    branch = F.when(F.col("c_acctbal") < 0, "F").otherwise("O").alias("branch")
    c = table(spark, sf, "customer").select((F.col("c_custkey") + 10).alias("repo"), branch, F.col("c_mktsegment").alias("commit"))
    return update_commits(o, c).select("o_orderkey", "commit")


# -- a system of source files, made of the suppliers: one directory each, one repository a nation

REST = "/src/main/java/p/"


def system_files(spark, sf) -> DataFrame:
    """(repo, branch, commit, path, content): pom everywhere, configuration, Dockerfile, application class and controller for some; a client of the next supplier's controller."""
    key, following = F.col("s_suppkey").cast("string"), (F.col("s_suppkey") + 1).cast("string")
    text = lambda *parts: F.concat(*[x if isinstance(x, Column) else F.lit(x) for x in parts])
    file = lambda name, content, condition=None: F.when(F.lit(True) if condition is None else condition, F.struct(text(*name).alias("name"), content.alias("content")))
    controller = text(
        "package p;\nimport java.util.List;\n/** Supplier } */\n@RestController\n@RequestMapping(\"/s", key, "\")\npublic class C", key, " {\n  private static int nation = ", F.col("s_nationkey").cast("string"),
        ";\n  @GetMapping(\"/{id}\") public List<String> one(@PathVariable long id) { return helper.find(id); }\n  @PostMapping public void add(@RequestParam(\"n\") String n) { run(n); }\n  void plain() {}\n}\n",
    )
    client = text("package p;\n@FeignClient(name = \"next\")\ninterface F", key, " {\n  @GetMapping(\"/s", following, "/{x}\") String get(@PathVariable long x);\n  @PostMapping(\"/s", following, "\") void put(@RequestParam(\"n\") String v);\n}\n")
    resource = text("package p;\n@RepositoryRestResource", F.when(F.col("s_suppkey") % 2 == 1, "(path = \"own\")").otherwise(""), "\npublic interface R", key, "Repository extends CrudRepository<X, Long> {\n  List<X> findByName(String n);\n  @RestResource(exported = false) void gone();\n}\n")
    even = F.col("s_suppkey") % 2 == 0
    made = F.array_compact(F.array(
        file(["pom.xml"], text("<project><parent><artifactId>no</artifactId></parent><artifactId>art", key, "</artifactId></project>")),
        file(["src/main/resources/application.yml"], text("spring:\n  application:\n    name: svc", key, "\n"), even),
        file(["Dockerfile"], text("FROM x\n"), F.col("s_suppkey") % 3 == 0),
        file(["src/main/java/App.java"], text("@SpringBootApplication\nclass App {}\n"), F.col("s_acctbal") > 0),
        file(["src/main/java/p/C", key, ".java"], controller, F.col("s_suppkey") % 5 != 0),
        file(["src/main/java/p/F", key, ".java"], client), file(["src/main/java/p/R", key, "Repository.java"], resource),
        file(["build/x/pom.xml"], text("<project><artifactId>copy</artifactId></project>")), file(["src/main/java/p/Broken.java"], text("class Broken { void f() { "), F.col("s_suppkey") % 7 == 0),
    ))
    # A supplier makes some kB of files: a few MB of suppliers, which Spark reads in one task, are spread over all.
    rows = table(spark, sf, "supplier").repartition(4 * spark.sparkContext.defaultParallelism, "s_suppkey").select(F.concat(F.lit("nation"), F.col("s_nationkey").cast("string")).alias("repo"), key.alias("key"), F.explode(made).alias("f"))
    return rows.select("repo", F.lit("main").alias("branch"), F.lit("c1").alias("commit"), F.concat(F.lit("/s"), "key", F.lit("/"), "f.name").alias("path"), "f.content")


SYSTEM_SQL = """
x AS (
  SELECT *, s_suppkey AS k, 'nation' || s_nationkey AS repo, '/s' || s_suppkey AS root, s_suppkey % 2 = 0 AS conf, s_suppkey % 3 = 0 AS docker, s_acctbal > 0 AS boot, s_suppkey % 5 <> 0 AS ctl FROM supplier),
sc AS (
  SELECT *, 5 + CASE WHEN conf THEN 3 ELSE 0 END + CASE WHEN docker THEN 4 ELSE 0 END + CASE WHEN boot THEN 5 ELSE 0 END + CASE WHEN ctl THEN 2 ELSE 0 END AS score FROM x),
svc AS (SELECT *, CASE WHEN conf THEN 'svc' ELSE 'art' END || k AS name FROM sc WHERE score >= 7)
"""


def _system(spark, sf) -> dict[str, DataFrame]:
    from .plans.system import create_from_files

    return create_from_files(system_files(spark, sf))


@query(f"""
WITH {SYSTEM_SQL}
SELECT repo, root, name AS service_name, score::INT AS score,
       concat_ws('; ', CASE WHEN ctl THEN 'RequestMapping: src/main/java/p/C' || k || '.java' END, CASE WHEN boot THEN 'SpringBootApplication: src/main/java/App.java' END,
                 CASE WHEN conf THEN 'application config: src/main/resources/application.yml' END, 'build file: pom.xml', CASE WHEN ctl THEN 'controller annotation: src/main/java/p/C' || k || '.java' END,
                 CASE WHEN docker THEN 'dockerfile: Dockerfile' END, 'source tree: src/main/java') AS evidence
FROM svc
""")
def service_boundaries(spark, sf):
    from .plans.boundary import detect

    return detect(system_files(spark, sf)).select("repo", "root", "service_name", "score", F.array_join("evidence", "; ").alias("evidence"))


@query(f"WITH {SYSTEM_SQL} SELECT root, CASE WHEN conf THEN 'svc' ELSE 'art' END || k AS service_name FROM x")
def names_by_directory(spark, sf):
    from .plans import boundary as B

    files = system_files(spark, sf)
    roots = table(spark, sf, "supplier").select(F.concat(F.lit("nation"), F.col("s_nationkey").cast("string")).alias("repo"), F.lit("main").alias("branch"), F.lit("c1").alias("commit"), F.concat(F.lit("/s"), F.col("s_suppkey").cast("string")).alias("root"))
    return B.names(B.file_facts(files), roots).select("root", "service_name")


@query(f"""
WITH {SYSTEM_SQL}, m AS (
  SELECT root || '{REST}C' || k || '.java' AS path, unnest([('one', 'List<String>', 'PUBLIC', 1), ('add', 'void', 'PUBLIC', 1), ('plain', 'void', 'PACKAGE_PRIVATE', 0)]) AS m, 'p.C' || k AS c FROM x WHERE ctl
  UNION ALL SELECT root || '{REST}F' || k || '.java', unnest([('get', 'String', 'PACKAGE_PRIVATE', 1), ('put', 'void', 'PACKAGE_PRIVATE', 1)]), 'p.F' || k FROM x
  UNION ALL SELECT root || '{REST}R' || k || 'Repository.java', unnest([('findByName', 'List<X>', 'PACKAGE_PRIVATE', 1), ('gone', 'void', 'PACKAGE_PRIVATE', 0)]), 'p.R' || k || 'Repository' FROM x)
SELECT path, c || '&' || m[1] AS component_id, m[1] AS name, m[2] AS return_type, m[3] AS protection, m[4]::INT AS n_parameters FROM m
""")
def source_methods(spark, sf):
    from .plans.tables import components, parse_sources

    m = components(parse_sources(system_files(spark, sf)), "methods")
    return m.select("path", "component_id", "name", "return_type", "protection", F.size("parameters").alias("n_parameters"))


@query(f"""
WITH {SYSTEM_SQL}
SELECT root || '{REST}C' || k || '.java' AS path, 'field' AS kind, 'nation' AS name, s_nationkey::VARCHAR AS detail FROM x WHERE ctl
UNION ALL SELECT root || '{REST}C' || k || '.java', 'import', 'List', 'java.util' FROM x WHERE ctl
UNION ALL SELECT root || '{REST}C' || k || '.java', 'call', 'find', 'helper' FROM x WHERE ctl
UNION ALL SELECT root || '{REST}C' || k || '.java', 'call', 'run', '' FROM x WHERE ctl
UNION ALL SELECT root || '{REST}Broken.java', 'error', '', '' FROM x WHERE k % 7 = 0
""")
def source_members(spark, sf):
    from .plans.tables import components, parse_sources

    p = parse_sources(system_files(spark, sf))
    row = lambda d, kind, name, detail: d.select("path", F.lit(kind).alias("kind"), name.alias("name"), detail.alias("detail"))
    out = row(components(p, "fields"), "field", F.col("name"), F.col("initializer"))
    out = out.unionByName(row(components(p, "imports"), "import", F.col("object"), F.col("package"))).unionByName(row(components(p, "calls"), "call", F.col("name"), F.coalesce("object_name", F.lit(""))))
    return out.unionByName(row(p.where("class.parse_error IS NOT NULL"), "error", F.lit(""), F.lit("")))


@query(f"""
WITH {SYSTEM_SQL}
SELECT root || '{REST}C' || k || '.java' AS path, 'CONTROLLER' AS role, 'controllers' AS role_bucket, svc.name AS service_name FROM x LEFT JOIN svc USING (k, root) WHERE x.ctl
UNION ALL SELECT root || '{REST}F' || k || '.java', 'FEIGN_CLIENT', 'feignClients', svc.name FROM x LEFT JOIN svc USING (k, root)
UNION ALL SELECT root || '{REST}R' || k || 'Repository.java', 'REP_REST_RSC', 'repositories', svc.name FROM x LEFT JOIN svc USING (k, root)
UNION ALL SELECT root || '/src/main/java/App.java', 'UNKNOWN', 'unknowns', svc.name FROM x LEFT JOIN svc USING (k, root) WHERE x.boot
""")
def source_classes(spark, sf):
    return _system(spark, sf)["classes"].select("path", "role", "role_bucket", "service_name")


@query(f"""
WITH {SYSTEM_SQL}
SELECT root, 'one' AS name, '/s' || k || '/{{?}}' AS url, 'GET' AS http_method, '' AS required FROM x WHERE ctl
UNION ALL SELECT root, 'add', '/s' || k, 'POST', 'n' FROM x WHERE ctl
UNION ALL SELECT root, 'findByName', CASE WHEN k % 2 = 1 THEN '/own' ELSE '/r' || k || 's' END || '/search/findByName', 'GET', '' FROM x
""")
def source_endpoints(spark, sf):
    from .plans.tables import endpoints, methods, parse_sources

    p = parse_sources(system_files(spark, sf))
    e = endpoints(methods(p), include_repositories=True)
    return e.select(F.regexp_extract("path", "^(/s[0-9]+)/", 1).alias("root"), "name", "url", "http_method", F.array_join("required", ",").alias("required"))


@query(f"""
WITH {SYSTEM_SQL}
SELECT root, 'get' AS called_from, '/s' || (k + 1) || '/{{?}}' AS url, 'GET' AS http_method FROM x
UNION ALL SELECT root, 'put', '/s' || (k + 1) || '?n={{?}}', 'POST' FROM x
""")
def feign_calls(spark, sf):
    from .plans.tables import methods, parse_sources, rest_calls

    p = parse_sources(system_files(spark, sf))
    return rest_calls(p, methods(p)).select(F.regexp_extract("path", "^(/s[0-9]+)/", 1).alias("root"), "called_from", "url", "http_method")


@query(f"""
WITH {SYSTEM_SQL}
SELECT a.name AS caller, b.name AS called, unnest(['/s' || b.k || '/{{?}}', '/s' || b.k]) AS endpoint_url FROM svc a JOIN svc b ON b.k = a.k + 1 AND b.ctl
""")
def system_call_graph(spark, sf):
    from .plans.tables import call_graph

    return call_graph(_system(spark, sf)).select(F.col("call_service").alias("caller"), F.col("endpoint_service").alias("called"), "endpoint_url")


@query(f"WITH {SYSTEM_SQL} SELECT repo, count(*) AS services, string_agg(name, ',' ORDER BY name) AS names FROM svc GROUP BY repo")
def services_per_repo(spark, sf):
    from .plans.tables import totals

    t = totals(_system(spark, sf)).where("service_name IS NOT NULL")
    return t.groupBy("repo").agg(F.count("*").alias("services"), F.array_join(F.array_sort(F.collect_list("service_name")), ",").alias("names"))


@query(f"""
WITH {SYSTEM_SQL}
SELECT name AS service_name, ctl::INT::BIGINT AS controllers, 1::BIGINT AS feign_clients, boot::INT::BIGINT AS unknowns, 2 * ctl::INT::BIGINT AS n_endpoints, 2::BIGINT AS n_rest_calls, 2 * ctl::INT::BIGINT AS n_calls FROM svc
""")
def total_endpoints(spark, sf):
    from .plans.tables import totals

    t = totals(_system(spark, sf)).where("service_name IS NOT NULL")
    return t.select("service_name", "controllers", F.col("feignClients").alias("feign_clients"), "unknowns", F.col("n_endpoints").cast("long"), F.col("n_rest_calls").cast("long"), F.col("n_calls").cast("long"))


@query(f"""
WITH {SYSTEM_SQL}, f AS (
  SELECT repo, k, 'class' AS kind, (ctl::INT + boot::INT + 2)::BIGINT AS n FROM x UNION ALL SELECT repo, k, 'config', (2 + conf::INT + docker::INT)::BIGINT FROM x)
SELECT repo, kind, sum(n)::BIGINT AS files FROM f GROUP BY ALL
""")
def multi_repo_union(spark, sf):
    from .plans.tables import all_files

    return all_files(_system(spark, sf)).groupBy("repo", "kind").agg(F.count("*").alias("files"))


@query(f"""
WITH {SYSTEM_SQL}
SELECT svc.root AS service_path, x.k, unnest(CASE WHEN x.ctl THEN ['one', 'add', 'plain', 'get', 'put', 'findByName', 'gone'] ELSE ['get', 'put', 'findByName', 'gone'] END) AS name FROM x LEFT JOIN svc USING (k)
""")
def nested_roundtrip(spark, sf):
    from .plans import io

    n = io.nested(_system(spark, sf))
    back = n.select(F.from_json(F.to_json(F.struct("*")), n.schema).alias("r")).select("r.*")
    return io.components_of(back, "methods").select("service_path", F.regexp_extract("path", "^/s([0-9]+)/", 1).cast("long").alias("k"), "name")


@query(f"""
WITH {SYSTEM_SQL}
SELECT 'C' || k AS class_name, 'MODIFY' AS change_type, 'field' AS kind FROM x WHERE ctl AND k % 4 = 0
UNION ALL SELECT 'F' || k, 'DELETE', unnest(['class', 'method', 'method', 'annotation', 'annotation', 'annotation', 'annotation', 'annotation']) FROM x WHERE k % 9 = 0
""")
def source_delta(spark, sf):
    """A field's initializer changes, comments do everywhere, and some clients go."""
    from .plans.system import create_delta

    old = system_files(spark, sf)
    key = F.regexp_extract("path", "^/s([0-9]+)/", 1).cast("long")
    new = old.where(~(F.col("path").rlike("/F[0-9]+[.]java$") & (key % 9 == 0)))
    edited = F.when(F.col("path").rlike("/C[0-9]+[.]java$"), F.replace(F.when(key % 4 == 0, F.replace("content", F.lit("nation = "), F.lit("nation = 1"))).otherwise(F.col("content")), F.lit("Supplier"), F.lit("  Any supplier"))).otherwise(F.col("content"))
    _, components = create_delta(old, new.withColumn("content", edited))
    return components.select(F.regexp_extract("path", "([CF][0-9]+)[.]java$", 1).alias("class_name"), "change_type", "kind")
