"""Chat formatting with tool-call linking.

Method: calls and results are read out of the turns; a hash join by (conversation, identifier) links every result to its call; calls and
results are put in topological order (a result follows its call, a call follows the results to which its arguments refer); arguments are
validated against the tools' schemas; each turn is serialised as canonical JSON (sorted keys, no spaces, UTF-8).

In a turn a call is ``<tool_call>{"id":..., "name":..., "arguments": {...}}</tool_call>`` and a result is
``<tool_result>{"id":..., "content":...}</tool_result>``; a turn of role "tool" may be the result object itself. Arguments refer to a
result as ``{"$ref": "<id>"}`` at any depth.

Scale: one row a turn from start to end. Nothing is grouped by conversation, so a conversation of any length is spread over tasks; joins
are by (conversation, identifier), whose owner is found with a partial minimum. Levels of calls that refer to others are found by conversation
where it has at most ``LOCAL_EDGES`` references; in longer ones by rounds of joins, written to the shared folder each round, until no call
becomes ready. Chains may have any depth either way.

Edge cases: null texts and roles become empty strings in the JSON; null conversations or turns are kept and match only themselves;
malformed blocks stay in the text and are counted; of calls with one identifier the earliest (turn, then place, then content) owns
it, the others are duplicates; results without call are orphans; cyclic references get level null; rows that repeat a turn are linked and
serialised alike; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialise

_BLOCK = re.compile(r"<tool_(call|result)>(.*?)</tool_\1>", re.S)
TYPES = {"string": str, "integer": int, "number": (int, float), "boolean": bool, "object": dict, "array": list, "null": type(None)}
#: A conversation of at most so many references between calls is put in order by one task.
LOCAL_EDGES = 200_000
#: Tools known to the query over ``conversations``.
SCHEMAS: dict[str, dict] = {
    "search": {"type": "object", "properties": {"query": {"type": "string"}, "limit": {"type": "integer", "minimum": 1}}, "required": ["query"], "additionalProperties": False},
    "calculate": {"type": "object", "properties": {"expression": {"type": "string"}}, "required": ["expression"]},
}


def canonical(value) -> str:
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def validate(value, schema: dict, path: str = "$") -> str | None:
    """The first violation of a JSON schema (type, enum, required, properties, additionalProperties, items, minimum, maximum), or None."""
    kind = schema.get("type")
    if kind:
        kinds = kind if isinstance(kind, list) else [kind]
        fits = any(isinstance(value, TYPES[k]) and not (isinstance(value, bool) and k in ("integer", "number")) or (k == "integer" and isinstance(value, float) and value.is_integer()) for k in kinds)
        if not fits:
            return f"{path}: not of type {'/'.join(kinds)}"
    if "enum" in schema and value not in schema["enum"]:
        return f"{path}: not in enum"
    if isinstance(value, (int, float)) and not isinstance(value, bool) and not schema.get("minimum", value) <= value <= schema.get("maximum", value):
        return f"{path}: out of range"
    if isinstance(value, dict):
        for name in schema.get("required", []):
            if name not in value:
                return f"{path}.{name}: missing"
        own = schema.get("properties", {})
        for name in sorted(value):
            if name in own:
                if said := validate(value[name], own[name], f"{path}.{name}"):
                    return said
            elif schema.get("additionalProperties", True) is False:
                return f"{path}.{name}: not allowed"
    if isinstance(value, list) and "items" in schema:
        for i, x in enumerate(value):
            if said := validate(x, schema["items"], f"{path}[{i}]"):
                return said
    return None


def references(value) -> set[str]:
    if isinstance(value, dict):
        if set(value) == {"$ref"} and isinstance(value["$ref"], str):
            return {value["$ref"]}
        return set().union(*map(references, value.values())) if value else set()
    return set().union(*map(references, value)) if isinstance(value, list) and value else set()


def parse_turn(role: str | None, text: str | None, schemas: dict[str, dict]) -> tuple[str, list[dict], int]:
    """(text without blocks, calls and results in order, malformed blocks)."""
    text = text or ""
    events, malformed = [], 0

    def take(kind: str, raw: str) -> bool:
        try:
            value = json.loads(raw)
        except (ValueError, RecursionError):
            return False
        if not isinstance(value, dict) or not isinstance(value.get("tool_call_id", value.get("id")), str):
            return False
        if kind == "call":
            name, arguments = value.get("name"), value.get("arguments", {})
            if not isinstance(name, str):
                return False
            error = validate(arguments, schemas[name]) if name in schemas else "unknown tool"
            events.append({"kind": "call", "id": value["id"], "place": len(events), "body": canonical({"arguments": arguments, "name": name}), "error": error, "refs": sorted(references(arguments))})
        else:
            events.append({"kind": "result", "id": value.get("tool_call_id", value.get("id")), "place": len(events), "body": canonical(value.get("content")), "error": None, "refs": []})
        return True

    if (role or "") == "tool" and text.lstrip().startswith("{") and take("result", text):
        return "", events, 0

    def replace(found: re.Match) -> str:
        nonlocal malformed
        if "id" in found[2] and take(found[1], found[2]):
            return ""
        malformed += 1
        return found[0]

    return _BLOCK.sub(replace, text), events, malformed


EVENT = T.StructType([T.StructField("kind", T.StringType()), T.StructField("id", T.StringType()), T.StructField("place", T.IntegerType()), T.StructField("body", T.StringType()), T.StructField("error", T.StringType()), T.StructField("refs", T.ArrayType(T.StringType()))])
TURN = T.StructType([T.StructField("conv_id", T.LongType()), T.StructField("turn", T.LongType()), T.StructField("role", T.StringType()), T.StructField("content", T.StringType()), T.StructField("malformed", T.LongType()), T.StructField("events", T.ArrayType(EVENT))])


def _levels_of(edges: pa.Table) -> pa.Table:
    """Levels of one conversation's calls (conv_id, id, ref); a null ref is one to no call."""
    refs: dict[str, set[str]] = {}
    for i, r in zip(edges.column("id").to_pylist(), edges.column("ref").to_pylist(), strict=True):
        refs.setdefault(i, set()).update(() if r is None else (r,))
    users: dict[str, list[str]] = {}
    for i, own in refs.items():
        for r in own:
            users.setdefault(r, []).append(i)
    n_open = {i: sum(r in refs for r in own) for i, own in refs.items()}
    level = {i: int(bool(own)) for i, own in refs.items()}
    ready = [i for i, n in n_open.items() if not n]
    for i in ready:
        for u in users.get(i, ()):
            level[u] = max(level[u], level[i] + 1)
            n_open[u] -= 1
            if not n_open[u]:
                ready.append(u)
    conv = edges.column("conv_id")[0].as_py()
    return pa.table([pa.array([conv] * len(ready), pa.int64()), pa.array(ready, pa.string()), pa.array([level[i] for i in ready], pa.int32())], ["conv_id", "id", "level"])


def levels(calls: DataFrame, local_edges: int = LOCAL_EDGES) -> DataFrame:
    """(conv_id, id, level) of owned calls: 0 without references, else one more than the deepest call referred to; null in a cycle."""
    known = calls.where(F.size("refs") == 0).select("conv_id", "id", F.lit(0).alias("level"))
    waiting = calls.where(F.size("refs") > 0).select("conv_id", "id", "refs")
    if waiting.isEmpty():
        return known
    known, waiting = materialise(known, "chat-levels"), materialise(waiting, "chat-waiting")
    ids = materialise(calls.select("conv_id", "id"), "chat-ids")
    # At most one conversation in local_edges references is long.
    sizes = waiting.groupBy("conv_id").agg(F.sum(F.size("refs")).alias("n")).where(F.col("n") > local_edges)
    long = [r["conv_id"] for r in sizes.select("conv_id").collect()]
    is_long = F.coalesce(F.col("conv_id").isin([c for c in long if c is not None]), F.lit(None in long))
    short = waiting.where(~is_long).select("conv_id", "id", F.explode("refs").alias("ref"))
    i = ids.select(F.col("conv_id").alias("k2"), F.col("id").alias("ref2"))
    short = short.join(i, F.col("conv_id").eqNullSafe(F.col("k2")) & (F.col("ref") == F.col("ref2")), "left").select("conv_id", "id", F.col("ref2").alias("ref"))
    known = materialise(known.union(short.groupBy("conv_id").applyInArrow(_levels_of, "conv_id long, id string, level int")), "chat-levels")
    if not long:
        return known
    waiting = materialise(waiting.where(is_long), "chat-waiting")
    while True:
        needs = waiting.select("conv_id", "id", F.explode("refs").alias("ref"))
        r = known.select(F.col("conv_id").alias("k"), F.col("id").alias("ref"), F.col("level").alias("ref_level"))
        found = needs.join(r, F.col("conv_id").eqNullSafe(F.col("k")) & (needs["ref"] == r["ref"]), "left").join(i, F.col("conv_id").eqNullSafe(F.col("k2")) & (needs["ref"] == i["ref2"]), "left")
        # A reference to no call at all binds nothing.
        state = found.groupBy("conv_id", "id").agg(F.max("ref_level").alias("deepest"), F.count(F.when(F.col("ref_level").isNull() & F.col("ref2").isNotNull(), 1)).alias("open"))
        ready = materialise(state.where("open = 0").select("conv_id", "id", (F.coalesce("deepest", F.lit(-1)) + 1).alias("level")), "chat-ready")
        if ready.isEmpty():
            return known
        done = ready.select(F.col("conv_id").alias("k"), F.col("id").alias("done"))
        waiting = materialise(waiting.join(done, F.col("conv_id").eqNullSafe(F.col("k")) & (F.col("id") == F.col("done")), "left_anti"), "chat-waiting")
        known = materialise(known.union(ready), "chat-levels")


def format_chats(conversations: DataFrame, schemas: dict[str, dict] | None = None) -> DataFrame:
    """One row a turn: conv_id, turn, role, n_calls, n_results, n_linked, n_invalid, n_malformed, first_level, json, json_sha256.

    ``json`` lists the turn's calls and results by topological level, then place; each with its status.
    """
    schemas = SCHEMAS if schemas is None else schemas

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        kinds = to_arrow_schema(TURN)
        for batch in batches:
            made = [parse_turn(r, t, schemas) for r, t in zip(batch[2].to_pylist(), batch[3].to_pylist(), strict=True)]
            columns = [batch[0], batch[1], batch[2], pa.array([m[0] for m in made], pa.string()), pa.array([m[2] for m in made], pa.int64()), pa.array([m[1] for m in made], kinds.field("events").type)]
            yield pa.RecordBatch.from_arrays(columns, names=kinds.names)

    turns = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text").mapInArrow(parse, TURN)
    turns = materialise(turns.withColumn("key", F.xxhash64("conv_id", "turn", "role", "content", F.to_json("events"))), "chat-turns")
    events = turns.select("conv_id", "turn", "key", F.explode("events").alias("e")).select("conv_id", "turn", "key", "e.*").distinct()
    rank = F.struct(F.col("turn").isNull().alias("none"), "turn", "place", "key", "body", "error", "refs")
    first = events.groupBy("conv_id", "kind", "id").agg(F.min(rank).alias("own"))
    calls = materialise(first.where("kind = 'call'").select("conv_id", "id", "own.*"), "chat-calls")
    results = first.where("kind = 'result'").select(F.col("conv_id").alias("r_conv"), F.col("id").alias("r_id"), F.col("own.key").alias("r_key"), F.col("own.place").alias("r_place"))
    depth = levels(calls).select(F.col("conv_id").alias("l_conv"), F.col("id").alias("l_id"), "level")
    linked = calls.select("conv_id", "id", F.col("key").alias("c_key"), F.col("place").alias("c_place"))
    linked = linked.join(depth, F.col("conv_id").eqNullSafe(F.col("l_conv")) & (F.col("id") == F.col("l_id")), "left")
    linked = linked.join(results, F.col("conv_id").eqNullSafe(F.col("r_conv")) & (F.col("id") == F.col("r_id")), "left").select(F.col("conv_id").alias("o_conv"), F.col("id").alias("o_id"), "c_key", "c_place", "level", "r_key", "r_place")
    e = events.join(linked, F.col("conv_id").eqNullSafe(F.col("o_conv")) & (F.col("id") == F.col("o_id")), "left")
    is_call = F.col("kind") == "call"
    owns = F.when(is_call, (F.col("key") == F.col("c_key")) & (F.col("place") == F.col("c_place"))).otherwise((F.col("key") == F.col("r_key")) & (F.col("place") == F.col("r_place")))
    status = F.when(F.col("c_key").isNull(), "orphan").when(~owns, "duplicate").when(F.col("r_key").isNull(), "unanswered").otherwise("linked")
    e = e.select("key", F.struct((F.col("level") * 2 + F.when(is_call, 0).otherwise(1)).alias("level"), "place", "kind", "id", "body", "error", status.alias("status")).alias("event"))
    own = e.groupBy(F.col("key").alias("e_key")).agg(F.sort_array(F.collect_list("event")).alias("linked"))
    d = turns.join(own, F.col("key") == F.col("e_key"), "left").select("conv_id", "turn", "role", "content", "malformed", "linked")
    schema = T.StructType([T.StructField(n, t) for n, t in (("conv_id", T.LongType()), ("turn", T.LongType()), ("role", T.StringType()), ("n_calls", T.LongType()), ("n_results", T.LongType()), ("n_linked", T.LongType()), ("n_invalid", T.LongType()), ("n_malformed", T.LongType()), ("first_level", T.LongType()), ("json", T.StringType()), ("json_sha256", T.StringType()))])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                found = r["linked"] or []
                out = [{k: x[k] for k in ("kind", "id", "level", "status")} | {"value": json.loads(x["body"])} | ({"error": x["error"]} if x["error"] else {}) for x in found]
                text = canonical({"content": r["content"], "conversation": r["conv_id"], "events": out, "role": r["role"] or "", "turn": r["turn"]})
                n = [sum(x["kind"] == k for x in found) for k in ("call", "result")]
                at = [x["level"] for x in found if x["level"] is not None]
                rows.append((r["conv_id"], r["turn"], r["role"], *n, sum(x["status"] == "linked" for x in found), sum(bool(x["error"]) for x in found), r["malformed"], min(at) if at else None, text, hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()))
            columns = list(zip(*rows, strict=True)) or [[]] * len(schema)
            kinds = [pa.int64(), pa.int64(), pa.string(), *[pa.int64()] * 6, pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, kinds, strict=True)], schema.names)

    return d.mapInArrow(write, schema)
