"""Configuration files as JSON text: YAML, Dockerfile, pom.xml, Gradle, .properties. One reader by file name; null if it can't be read."""

from __future__ import annotations

import json
import re
import xml.etree.ElementTree as ET
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

GRADLE = {f"{x}.gradle{y}" for x in ("build", "settings") for y in ("", ".kts")}


def _plain(value):
    """YAML values as JSON ones: keys as text, dates as text."""
    if isinstance(value, dict):
        return {str(k): _plain(v) for k, v in value.items()}
    if isinstance(value, (list, tuple, set)):
        return [_plain(v) for v in value]
    return value if value is None or isinstance(value, (str, int, float, bool)) else str(value)


def read_yaml(text: str) -> dict | list | None:
    """The first document; {} if it is empty, None if it is malformed."""
    import yaml

    try:
        value = next(iter(yaml.safe_load_all(text)), None)
    except yaml.YAMLError:
        return None
    return {} if value is None else _plain(value)


def read_docker(text: str) -> dict:
    lines = text.split("\n")
    return {"instructions": [x.strip() for x in (lines[:-1] if lines[-1] == "" else lines)]}


def _element(e: ET.Element):
    """An XML element as JSON: text if it has nothing else; repeated children as an array; attributes as members; mixed text as 'content'."""
    name = lambda tag: tag.rsplit("}", 1)[-1]
    out: dict = {name(k): _number(v) for k, v in e.attrib.items()}
    for child in e:
        value = _element(child)
        key = name(child.tag)
        if key in out:
            out[key] = [*(out[key] if isinstance(out[key], list) else [out[key]]), value]
        else:
            out[key] = value
    text = (e.text or "").strip()
    if not out:
        return _number(text)
    if text:
        out["content"] = _number(text)
    return out


def _number(text: str):
    """JSON's reading of a bare word."""
    if text in ("true", "false"):
        return text == "true"
    if re.fullmatch(r"-?(0|[1-9]\d*)", text):
        return int(text)
    if re.fullmatch(r"-?(0|[1-9]\d*)\.\d+", text):
        return float(text)
    return text


def read_pom(text: str) -> dict | None:
    if not text.strip():
        return {}
    if re.search(r"<!DOCTYPE|<!ENTITY", text):
        return None
    try:
        root = ET.fromstring(text)
    except ET.ParseError:
        return None
    return {root.tag.rsplit("}", 1)[-1]: _element(root)}


def read_gradle(text: str) -> dict:
    """Blocks as nested objects; ``k = v`` as members, single quotes as double ones; other lines of a block in an array under its name."""
    root: dict = {}
    stack: list[tuple[str, dict]] = [("", root)]
    for line in text.splitlines():
        line = line.strip()
        if not line or line.startswith("//"):
            continue
        name, here = stack[-1]
        if line.endswith("{"):
            block: dict = {}
            key = line[:-1].strip()
            here[key] = block
            stack.append((key, block))
        elif line == "}":
            if len(stack) > 1:
                stack.pop()
        elif "=" in line:
            k, _, v = line.partition("=")
            here[k.strip()] = v.strip().replace("'", '"')
        elif len(stack) > 1:
            here.setdefault(name, []).append(line.replace("'", '"'))
    return root


def read_properties(text: str) -> dict:
    """Keys and values as text, by the rules of .properties files: = : or space between them, # and ! comments, \\ escapes and continuation."""
    out, lines = {}, iter(text.splitlines())
    for line in lines:
        line = line.lstrip()
        if not line or line[0] in "#!":
            continue
        while re.search(r"(?<!\\)(\\\\)*\\$", line):
            line = line[:-1] + next(lines, "").lstrip()
        m = re.match(r"((?:\\.|[^\\=:\s])*)\s*[=:]?\s*(.*)", line, re.S)
        decode = lambda s: re.sub(r"\\(u[0-9a-fA-F]{4}|.)", lambda x: chr(int(x[1][1:], 16)) if len(x[1]) == 5 else {"n": "\n", "t": "\t", "r": "\r", "f": "\f"}.get(x[1], x[1]), s)
        out[decode(m[1])] = decode(m[2])
    return out


def read_config(path: str, text: str | None) -> str | None:
    """JSON text of a configuration file; None for other files, malformed and missing ones."""
    name = path.replace("\\", "/").rsplit("/", 1)[-1]
    if text is None:
        return None
    if name.endswith((".yml", ".yaml")):
        value = read_yaml(text)
    elif name.lower() == "dockerfile":
        value = read_docker(text)
    elif name == "pom.xml":
        value = read_pom(text)
    elif name in GRADLE:
        value = read_gradle(text)
    elif name.endswith(".properties"):
        value = read_properties(text)
    else:
        return None
    return None if value is None else json.dumps(value, ensure_ascii=False)


def parse_config_files(files: DataFrame) -> DataFrame:
    """``files`` (path, content and others) with ``json`` (text) and ``data`` (variant)."""
    schema = T.StructType([*files.schema.fields, T.StructField("json", T.StringType())])
    p, c = files.columns.index("path"), files.columns.index("content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [read_config(x or "", y) for x, y in zip(b[p].to_pylist(), b[c].to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(made, pa.string())], schema.names)

    return files.mapInArrow(run, schema).withColumn("data", F.try_parse_json("json"))


def docker_json(text: Column) -> Column:
    """``read_docker`` as a column, for Dockerfiles alone: no Python."""
    lines = F.split(F.regexp_replace(text, "\n$", ""), "\n")
    return F.to_json(F.struct(F.transform(lines, lambda x: F.trim(x)).alias("instructions")))


def app_name(data: Column) -> Column:
    """spring.application.name of parsed YAML or properties: the flat key before the nested ones; null if blank."""
    flat = F.try_variant_get(data, "$['spring.application.name']", "string")
    nested = F.try_variant_get(data, "$.spring.application.name", "string")
    return F.coalesce(F.nullif(F.trim(flat), F.lit("")), F.nullif(F.trim(nested), F.lit("")))


def artifact_id(text: Column) -> Column:
    """The project's own artifactId, a direct child of the root element; null if blank."""
    return F.nullif(F.trim(F.try_variant_get(text, "$.project.artifactId", "string")), F.lit(""))


def gradle_name(text: Column) -> Column:
    """The first line rootProject.name = 'x'."""
    return F.nullif(F.trim(F.regexp_extract(text, r"(?m)^[ \t]*rootProject\.name[ \t]*=[ \t]*['\"]([^'\"\n]+)['\"]", 1)), F.lit(""))
