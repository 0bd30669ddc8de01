"""REST calls of JavaScript sources: constants are propagated through assignments and concatenation, then fetch and axios calls are listed."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

_ASSIGN = re.compile(r"(?:\b(?:const|let|var)\s+|^\s*)([A-Za-z_$][\w$]*)\s*=\s*([^;\n]+)", re.M)
_CALL = re.compile(r"\b(fetch|axios(?:\.(get|post|put|delete|patch|options|head))?|\$\.(get|post))\s*\(\s*([^,)]+(?:\([^)]*\))?[^,)]*)(?:,\s*(\{.*?\}))?", re.S)
_LITERAL = re.compile(r"""^(?:"([^"]*)"|'([^']*)'|`([^`]*)`)$""")


def fold(expression: str, known: dict[str, str], slash_join: bool = False) -> str:
    """The text an expression makes; unknown parts are {?}. ``slash_join`` puts exactly one slash between joined parts."""
    out: list[str] = []
    for part in re.split(r"\s*\+\s*", expression.strip()):
        m = _LITERAL.match(part)
        if m:
            text = next(x for x in m.groups() if x is not None)
            out.append(re.sub(r"\$\{\s*([^}]*)\}", lambda v: known.get(v[1].strip(), "{?}"), text))
        else:
            out.append(known.get(part, "{?}"))
    if not slash_join:
        return "".join(out)
    joined = out[0]
    for x in out[1:]:
        joined = joined.rstrip("/") + "/" + x.lstrip("/")
    return joined


def rest_calls(source: str, slash_join: bool = False) -> list[dict]:
    """url, http_method and line of every call, in order."""
    known: dict[str, str] = {}
    events = sorted([(m.start(), "set", m) for m in _ASSIGN.finditer(source)] + [(m.start(), "call", m) for m in _CALL.finditer(source)], key=lambda e: e[0])
    out = []
    for at, kind, m in events:
        if kind == "set":
            value = fold(m[2], known, slash_join)
            if value != "{?}":
                known[m[1]] = value
            continue
        method = (m[2] or m[3] or "").upper()
        if not method:
            said = re.search(r"method\s*:\s*['\"](\w+)", m[5] or "")
            method = said[1].upper() if said else "GET"
        out.append({"url": fold(m[4], known, slash_join), "http_method": method, "line": source.count("\n", 0, at) + 1})
    return out


def extract_rest_calls(files: DataFrame, slash_join: bool = False) -> DataFrame:
    """(repo, path, url, http_method, line) of all JavaScript and TypeScript files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(r, p, c["url"], c["http_method"], c["line"]) for r, p, t in zip(*[x.to_pylist() for x in b.columns], strict=True) for c in rest_calls(t or "", slash_join)]
            columns = list(zip(*rows, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, (pa.string(),) * 4 + (pa.int32(),), strict=True)], ["repo", "path", "url", "http_method", "line"])

    return files.where("path RLIKE '[.](js|jsx|ts|tsx|mjs)$'").select("repo", "path", "content").mapInArrow(run, "repo string, path string, url string, http_method string, line int")
