"""Chat formatting with linked tool calls.

A message's text may hold calls and one result as JSON, by itself or in tags:

* ``{"tool_calls": [{"id": ..., "name": ..., "arguments": {...}}, ...]}`` or
  ``<tool_call>{"id", "name", "arguments"}</tool_call>``, any number;
* in role ``tool``: ``{"tool_call_id": ..., "content": ...}``.

Calls and results are joined by (conversation, identifier), hashed, so a
conversation's size doesn't matter.  An argument ``"$id"`` refers to the result
of another call; a call's depth is one more than the deepest call it refers
to, found level by level until a level settles no call, and messages are ordered by turn, calls of a message
by depth and identifier.  Calls that refer to each other in a circle have no
depth and are invalid.  Arguments are checked against the tool's schema
(``type``, one or a list, ``properties``, ``required``, ``enum``, ``items``,
``additionalProperties``).  Messages are written as canonical JSON: keys by
code point, no white space, non-ASCII as it is.

Nulls: a null text is an empty content, a null role "user"; a null
conversation is one of its own.  A call whose id another call of the
conversation has (in an earlier turn, or before it in its message) is a
duplicate and invalid; of several results for a call the earliest counts.
Repeated rows are messages each.  No rows give no rows.  Extra columns are
ignored.  JSON with NaN, infinities or numbers too large for a double (1e400),
or nested deeper than ``MAX_NESTING``, is content; lone surrogates are written
as escapes.  Numbers stay as they are written: 1.0 isn't the integer 1, and is
serialised as 1.0.  No value has a type that the schema language doesn't know.
Time is linear in a text's length.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .kernel import freed, rows
from .storage import discard, materialize

_OPEN, _CLOSE = "<tool_call>", "</tool_call>"

_SURROGATE = re.compile("[\ud800-\udfff]")
#: A string that isn't closed runs to the end, so that no place is looked at twice.
_BRACKET = re.compile(r'"(?:[^"\\]|\\.)*+"?|[\[\]{}]', re.DOTALL)

_TYPES = {"object": dict, "array": list, "string": str, "boolean": bool, "null": type(None), "number": (int, float), "integer": int}

_TEXT, _WHOLE, _FLAG = {"type": "string"}, {"type": "integer"}, {"type": "boolean"}
_OR_NULL = lambda kind: {"type": [kind, "null"]}


def _tool(required: dict[str, dict], **optional: dict) -> dict:
    known = {"repo_url": _TEXT, **required}
    return {"type": "object", "properties": {**known, **optional, "force_reindex": _FLAG}, "required": list(known), "additionalProperties": False}


#: The arguments of the tools of the surveyed code server, by name; a call of another tool has no schema to break.
TOOLS: dict[str, dict] = {
    "get_repo_summary": _tool({}, question=_OR_NULL("string")),
    "query_dependencies": _tool({"symbol_name": _TEXT}, direction={"enum": ["both", "callers", "callees", "imports"]}, limit=_WHOLE),
    "analyze_impact": _tool({"symbol_name": _TEXT}, depth=_WHOLE, direction={"enum": ["affected", "depends_on", "both"]}, limit=_WHOLE),
    "suggest_refactor": _tool({"file_path": _TEXT}, focus=_OR_NULL("string"), max_suggestions=_WHOLE),
    "trace_flow": _tool({"question": _TEXT}, entry_hint=_OR_NULL("string"), max_depth=_WHOLE),
    "analyze_architecture": _tool({}),
    "search_code": _tool({"query": _TEXT}, top_k=_WHOLE, graph_expand=_FLAG),
    "view_source": _tool({"file_path": _TEXT}, symbol_name=_OR_NULL("string"), start_line=_OR_NULL("integer"), end_line=_OR_NULL("integer")),
    "get_initial_context": _tool({}, top_k_modules=_WHOLE, top_k_core_files=_WHOLE),
    "context_explore": _tool({"query": _TEXT}, top_k=_WHOLE, blast_depth=_WHOLE, include_flow=_OR_NULL("boolean")),
}


#: Objects and arrays inside each other; a text nested deeper is content, not a call.
MAX_NESTING = 200


def canonical(value: object) -> str:
    """Keys by code point, no white space, non-ASCII as it is; a lone surrogate, which UTF-8 can't hold, stays an escape."""
    out = json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    return _SURROGATE.sub(lambda m: f"\\u{ord(m[0]):04x}", out)


def _writable(text: str) -> str:
    """``text`` for an Arrow string: a lone surrogate as its escape."""
    return _SURROGATE.sub(lambda m: f"\\u{ord(m[0]):04x}", text)


def _nesting(text: str) -> int:
    """How deep brackets outside of strings stand inside each other, at most."""
    deep = most = 0
    for m in _BRACKET.finditer(text):
        if m[0] in "{[":
            deep += 1
            most = max(most, deep)
        elif m[0] in "}]":
            deep -= 1
    return most


def _no_constant(name: str) -> object:
    raise ValueError(f"{name} is no JSON")


def _finite(digits: str) -> float:
    value = float(digits)
    if math.isinf(value):
        raise ValueError(f"{digits} is no number that JSON can write again")
    return value


def _tagged(text: str) -> tuple[list[str], str]:
    """What stands in closed tags, and the text around them."""
    inside, around, at = [], [], 0
    while (lo := text.find(_OPEN, at)) >= 0 and (hi := text.find(_CLOSE, lo + len(_OPEN))) >= 0:
        around.append(text[at:lo])
        inside.append(text[lo + len(_OPEN) : hi])
        at = hi + len(_CLOSE)
    return inside, "".join([*around, text[at:]])


def errors(value: object, schema: dict, at: str = "$") -> list[str]:
    """Where a value breaks its schema."""
    out = []
    kinds = schema.get("type") or []
    kinds = [kinds] if isinstance(kinds, str) else kinds
    if kinds and not any(isinstance(value, _TYPES.get(k, ())) and not (k in ("number", "integer") and isinstance(value, bool)) for k in kinds):
        return [f"{at}: not {' or '.join(kinds)}"]
    if "enum" in schema and value not in schema["enum"]:
        out.append(f"{at}: not in enum")
    if isinstance(value, dict):
        known = schema.get("properties", {})
        out += [f"{at}.{k}: missing" for k in schema.get("required", []) if k not in value]
        for k, v in value.items():
            if k in known:
                out += errors(v, known[k], f"{at}.{k}")
            elif schema.get("additionalProperties") is False:
                out.append(f"{at}.{k}: unknown")
    if isinstance(value, list) and "items" in schema:
        for i, v in enumerate(value):
            out += errors(v, schema["items"], f"{at}[{i}]")
    return out


def _object(text: str) -> dict | None:
    text = text.strip()
    if not text.startswith("{"):
        return None
    if text.count("[") + text.count("{") > MAX_NESTING and _nesting(text) > MAX_NESTING:
        return None
    try:
        value = json.loads(text, parse_constant=_no_constant, parse_float=_finite)
    except ValueError:
        return None
    return value if isinstance(value, dict) else None


def _references(value: object) -> set[str]:
    if isinstance(value, str):
        return {value[1:]} if value[:1] == "$" and len(value) > 1 else set()
    inner = value.values() if isinstance(value, dict) else value if isinstance(value, list) else ()
    return set().union(*map(_references, inner))


def parse(role: str, text: str) -> tuple[str, list[dict], str | None]:
    """Content, calls, and the id of the call that the message answers."""
    whole = _object(text)
    if role == "tool":
        if whole and isinstance(whole.get("tool_call_id"), str):
            content = whole.get("content", "")
            return content if isinstance(content, str) else canonical(content), [], _writable(whole["tool_call_id"])
        return text, [], None
    found = whole.get("tool_calls") if whole else None
    if isinstance(found, list):
        content = whole.get("content", "")
        content = content if isinstance(content, str) else canonical(content)
    else:
        inside, content = _tagged(text)
        found = [_object(x) for x in inside]
    calls = [c for c in found if isinstance(c, dict) and isinstance(c.get("id"), str) and isinstance(c.get("name"), str)]
    return content, [{"id": _writable(c["id"]), "name": _writable(c["name"]), "arguments": c.get("arguments", {})} for c in calls], None


MESSAGE = "turn long, role string, content string, answers string, calls array<struct<id:string,name:string,arguments:string,valid:boolean,refs:array<string>,json:string>>, json string"
_CALL = pa.list_(pa.struct([("id", pa.string()), ("name", pa.string()), ("arguments", pa.string()), ("valid", pa.bool_()), ("refs", pa.list_(pa.string())), ("json", pa.string())]))


def messages(conversations: DataFrame, schemas: dict[str, dict] | None = None) -> DataFrame:
    """One row a message: its number, its parts, and its canonical JSON without the calls, whose order isn't known yet."""
    body = conversations.select(F.col("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("user")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    known = schemas or {}

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            conv, turn, role, text = rows(batch, ["conv_id", "turn", "role", "text"])
            out: dict[str, list] = {k: [] for k in ("content", "answers", "calls", "json")}
            for r, t in zip(role.to_pylist(), text.to_pylist(), strict=True):
                content, calls, answers = parse(r, t)
                message: dict[str, object] = {"content": content, "role": r}
                if answers is not None:
                    message["tool_call_id"] = answers
                out["content"].append(_writable(content))
                out["answers"].append(answers)
                out["calls"].append([{"id": c["id"], "name": c["name"], "arguments": canonical(c["arguments"]), "valid": not errors(c["arguments"], known.get(c["name"], {})), "refs": sorted(map(_writable, _references(c["arguments"]))), "json": canonical(c)} for c in calls])
                out["json"].append(canonical(message))
            arrays = [conv, turn, role, pa.array(out["content"], pa.string()), pa.array(out["answers"], pa.string()), pa.array(out["calls"], _CALL), pa.array(out["json"], pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, names=["conv_id", "turn", "role", "content", "answers", "calls", "json"])

    # Conversations may be named by numbers or by texts.
    kind = body.schema["conv_id"].dataType.simpleString()
    return body.mapInArrow(freed(read), f"conv_id {kind}, {MESSAGE}").withColumn("message", F.monotonically_increasing_id())


def links(msgs: DataFrame) -> DataFrame:
    """One row a call: message, conv_id, turn, place, call_id, name, arguments, schema_ok, duplicate, depth, result, result_turn, json, valid.

    A call is valid if its arguments are, it is no duplicate, has a depth, and
    its result, if any, doesn't come before it.
    """
    calls = msgs.select("message", "conv_id", "turn", F.posexplode("calls").alias("place", "c")).select("message", "conv_id", "turn", "place", F.col("c.id").alias("call_id"), F.col("c.name").alias("name"), F.col("c.arguments").alias("arguments"), F.col("c.valid").alias("schema_ok"), F.col("c.refs").alias("refs"), F.col("c.json").alias("json"))
    first = calls.groupBy("conv_id", "call_id").agg(F.min(F.struct("turn", "place")).alias("first"))
    key = F.col("l.conv_id").eqNullSafe(F.col("r.conv_id")) & (F.col("l.call_id") == F.col("r.call_id"))
    calls = calls.alias("l").join(first.alias("r"), key).select("l.*", (~F.struct("l.turn", "l.place").eqNullSafe(F.col("r.first"))).alias("duplicate"))
    results = msgs.where("answers is not null").groupBy("conv_id", F.col("answers").alias("call_id")).agg(F.min(F.struct("turn", "content")).alias("got"))
    calls = calls.alias("l").join(results.alias("r"), key, "left").select("l.*", F.col("r.got.content").alias("result"), F.col("r.got.turn").alias("result_turn"))
    calls, _ = materialize(calls, "chat-calls")
    # A call's own references, only to calls that exist; level by level from those without any.
    own = calls.where("not duplicate").select("conv_id", "call_id").distinct()
    edges = calls.where("not duplicate").select("conv_id", F.col("call_id").alias("by"), F.explode(F.array_distinct("refs")).alias("call_id"))
    edges = edges.alias("l").join(own.alias("r"), key, "left_semi")
    depth = own.alias("l").join(edges.select("conv_id", F.col("by").alias("call_id")).distinct().alias("r"), key, "left_anti").withColumn("depth", F.lit(0))
    if not edges.isEmpty():
        spark = msgs.sparkSession
        now, path = materialize(depth, "chat-depth")
        left, waiting = materialize(edges, "chat-left")
        settled, kind, level = [path], depth.schema, 0
        # What is left once a level settles no call depends on a circle.
        while not now.isEmpty() and not left.isEmpty():
            level += 1
            rest, path = materialize(left.alias("l").join(now.alias("r"), key, "left_anti"), "chat-left")
            by = lambda e: e.select("conv_id", F.col("by").alias("call_id")).distinct()
            # Calls all of whose references have a depth.
            done = by(left).alias("l").join(by(rest).alias("r"), key, "left_anti").withColumn("depth", F.lit(level))
            now, at = materialize(done, "chat-depth")
            discard(spark, waiting)
            settled.append(at)
            left, waiting = rest, path
        depth = spark.read.schema(kind).parquet(*settled)
    calls = calls.alias("l").join(depth.alias("r"), key, "left").select("l.*", "r.depth")
    in_time = F.coalesce(F.col("result_turn") > F.col("turn"), F.lit(True))
    return calls.withColumn("valid", F.col("schema_ok") & ~F.col("duplicate") & F.col("depth").isNotNull() & in_time)


def ordered_calls(linked: DataFrame) -> DataFrame:
    """Adds ``position``: the call's place in its message, by depth and identifier."""
    return linked.withColumn("position", F.row_number().over(Window.partitionBy("message").orderBy(F.col("depth").asc_nulls_last(), "call_id", "place")))


def formatted(conversations: DataFrame, schemas: dict[str, dict] | None = None) -> DataFrame:
    """One row a message: conv_id, turn, role, json, n_calls, n_valid, n_answered, linked (a result: whether its call is known)."""
    msgs, _ = materialize(messages(conversations, schemas), "chat-messages")
    linked = ordered_calls(links(msgs))
    own = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", "json"))), lambda c: c["json"]), ",").alias("own")
    per = linked.groupBy("message").agg(F.count("*").alias("n_calls"), F.sum(F.col("valid").cast("long")).alias("n_valid"), F.count("result_turn").alias("n_answered"), own)
    known = linked.select("conv_id", "call_id").distinct()
    same = lambda a, b: F.col(a).eqNullSafe(F.col(b))
    # "tool_calls" is the last key by code point.
    whole = F.concat(F.expr("left(json, length(json) - 1)"), F.lit(',"tool_calls":['), "own", F.lit("]}")).alias("json")
    out = msgs.where("size(calls) > 0").join(per, "message").select("conv_id", "turn", "role", whole, "n_calls", "n_valid", "n_answered", F.lit(None).cast("boolean").alias("linked"))
    answers = msgs.where("answers is not null").alias("m").join(known.withColumn("known", F.lit(True)).alias("k"), same("m.conv_id", "k.conv_id") & (F.col("m.answers") == F.col("k.call_id")), "left")
    zero = [F.lit(0).cast("long").alias(c) for c in ("n_calls", "n_valid", "n_answered")]
    answers = answers.select("m.conv_id", "m.turn", "role", "json", *zero, F.coalesce("known", F.lit(False)).alias("linked"))
    plain = msgs.where("size(calls) = 0 and answers is null").select("conv_id", "turn", "role", "json", *zero, F.lit(None).cast("boolean").alias("linked"))
    return plain.unionByName(out).unionByName(answers)
