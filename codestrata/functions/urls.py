"""Endpoint addresses and REST call addresses as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UNKNOWN = "{?}"
MAPPINGS = [f"{x}Mapping" for x in "Get Post Put Patch Delete Request".split()]
REST_TYPES = "WebClient RestTemplate OAuth2RestTemplate OAuth2RestOperations".split()
REST_METHODS = "exchange get post put patch delete options getForObject postForObject patchForObject".split()
_BY_MAPPING = {"Get": "GET", "Post": "POST", "Delete": "DELETE", "Put": "PUT", "Patch": "PATCH"}
_BY_CALL = {"getForObject": "GET", "get": "GET", "postForObject": "POST", "post": "POST", "patchForObject": "PATCH", "patch": "PATCH", "put": "PUT", "delete": "DELETE"}


def template(url: Column) -> Column:
    """Every {...} becomes {?}."""
    return F.regexp_replace(url, r"\{[^{}]*\}", UNKNOWN)


def clean(url: Column) -> Column:
    """No scheme, no host, no trailing quote or slash."""
    u = F.regexp_replace(url, "https?://", "")
    u = F.when(F.instr(u, "/") > 1, F.substr(u, F.instr(u, "/"))).otherwise(u)
    return F.regexp_replace(F.regexp_replace(u, '"$', ""), "/$", "")


def base(url: Column) -> Column:
    """The address before its query; the ? of a placeholder is none."""
    return F.regexp_extract(url, r"^((?:\{[^{}]*\}|[^?{]|\{)*)", 1)


def query(url: Column) -> Column:
    """What follows the query mark, '' if there is none."""
    return F.substr(url, F.length(base(url)) + 2)


def http_from_mapping(name: Column) -> Column:
    out = F.lit("ALL")
    for k, v in _BY_MAPPING.items():
        out = F.when(name.isin(f"{k}Mapping", f"RequestMethod.{v}"), v).otherwise(out)
    return out


def http_from_exchange(arguments: Column) -> Column:
    """The first of POST, PUT, DELETE, PATCH that the argument text names; GET if none."""
    out = F.lit("GET")
    for m in ("PATCH", "DELETE", "PUT", "POST"):
        out = F.when(arguments.contains(f"HttpMethod.{m}"), m).otherwise(out)
    return out


def http_from_call(name: Column, arguments: Column) -> Column:
    out = F.when(name == "exchange", http_from_exchange(arguments)).otherwise(F.lit("NONE"))
    for k, v in _BY_CALL.items():
        out = F.when(name == k, v).otherwise(out)
    return out


def attribute_path(attributes: Column) -> Column:
    """path, else value, else the single unnamed value of a mapping annotation."""
    return F.coalesce(attributes["path"], attributes["value"], attributes["default"], F.lit(""))


def endpoint_url(class_attributes: Column, attributes: Column, fix_both_slashes: bool = False) -> Column:
    """Address of an endpoint from its class's and its own mapping attributes (null maps count as empty).

    The class prefix is read from value alone. A missing slash is added to the prefix, or, only if the prefix needs none, to the method's
    part; ``fix_both_slashes`` adds both.
    """
    pre = F.regexp_replace(F.coalesce(class_attributes["value"], class_attributes["default"], F.lit("")), '"', "")
    own = F.regexp_replace(attribute_path(attributes), '"', "")
    bad_pre, bad_own = (pre != "") & ~pre.startswith("/"), (own != "") & ~own.startswith("/")
    fixed_own = F.when(bad_own & (F.lit(fix_both_slashes) | ~bad_pre), F.concat(F.lit("/"), own)).otherwise(own)
    joined = F.concat(F.when(bad_pre, F.concat(F.lit("/"), pre)).otherwise(pre), fixed_own)
    joined = F.regexp_replace(F.when(joined == "", "/").otherwise(joined), "//", "/")
    return template(F.when((F.length(joined) > 1) & joined.endswith("/"), F.substr(joined, F.lit(1), F.length(joined) - 1)).otherwise(joined))


def endpoint_method(attributes: Column, mapping: Column) -> Column:
    own = http_from_mapping(F.coalesce(attributes["method"], F.lit("")))
    return F.when(own != "ALL", own).otherwise(http_from_mapping(mapping))


def literal_url(text: Column) -> Column:
    """Fallback for an expression that can't be folded: its string literal that holds a slash, with format marks as placeholders."""
    found = F.regexp_replace(F.regexp_extract(text, '".*(/.+?)"', 0), '"', "")
    return clean(F.regexp_replace(found, "%[sdif]", UNKNOWN))


def query_string(names: Column) -> Column:
    """?a={?}&b={?} of an array of parameter names; '' of none."""
    made = F.array_join(F.transform(names, lambda n: F.concat(n, F.lit(f"={UNKNOWN}"))), "&")
    return F.when(F.size(names) > 0, F.concat(F.lit("?"), made)).otherwise("")


def has_parameters(url: Column, required: Column) -> Column:
    """Does the query name every required parameter? Without a query only if none is required."""
    return names_parameters(query(url), required)


def names_parameters(q: Column, required: Column) -> Column:
    """``has_parameters`` of a query that was cut off before."""
    return F.forall(required, lambda p: F.contains(q, F.concat(p, F.lit("="))))
