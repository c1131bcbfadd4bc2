"""Chat formatting with linked tool calls.

A message may carry tool calls, ``<tool_call>{"id":...,"name":...,"arguments":{...}}
</tool_call>``, and, in the role ``tool``, results,
``<tool_result>{"id":...,"content":...}</tool_result>``. Calls and results of a
conversation are hash-joined by identifier. Messages are ordered topologically: a
result follows its call, and where it stands before it, its message is placed after
the call's message, wherever that one is placed. Arguments are checked against the
schema of the called tool, as the conversation's system messages define it in
``<tools>[{"name":...,"parameters":{...}}, ...]</tools>`` (also one object a line, or
each as the ``function`` of an object), or else as the caller gives it. Each message
becomes canonical JSON: sorted keys, no white space, text as it is.

Rows stay messages, with the keys that order them: a conversation of any length is
never gathered in one task. The order takes one pass over the links between messages
that carry results and are waited for by others, and one more for each message of the
longest chain of these that has to move; without such links there is no pass.

Defined cases: of several calls with one identifier the first counts; a result
whose identifier has no call is not linked; messages that wait for each other in a
circle stand together at the place of their last one, by turn; of several definitions
of a tool the first counts, and one that can't be read accepts all arguments; where a
conversation defines tools, all others are unknown in it; JSON that can't be read, is nested too
deeply, or holds a number that JSON lacks stays text; a call whose name is no text
is one of an unknown tool; lone surrogates become U+FFFD;
null text is empty; null roles and turns are kept, null turns come last; messages
with equal conversation and turn are ordered by role, then text; repeated rows are
kept; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelcast.session import stage

CALL = re.compile(r"<tool_call>(.*?)</tool_call>", re.DOTALL)
RESULT = re.compile(r"<tool_result>(.*?)</tool_result>", re.DOTALL)
TOOLS = re.compile(r"<tools>(.*?)</tools>", re.DOTALL)

_KINDS = {
    "object": lambda v: isinstance(v, dict),
    "array": lambda v: isinstance(v, list),
    "string": lambda v: isinstance(v, str),
    "boolean": lambda v: isinstance(v, bool),
    "integer": lambda v: (isinstance(v, int) and not isinstance(v, bool)) or (isinstance(v, float) and v.is_integer()),
    "number": lambda v: isinstance(v, (int, float)) and not isinstance(v, bool),
    "null": lambda v: v is None,
}


_LONE = re.compile("[\ud800-\udfff]")


def canonical(value) -> str:
    """JSON with sorted keys and without white space; numbers as Python writes them. A
    lone half of a surrogate pair becomes U+FFFD; numbers that JSON lacks raise."""
    found = json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)
    return _LONE.sub("\ufffd", found)


def _refused(name: str):
    raise ValueError(f"{name} is no JSON")


def problems(value, schema: dict, path: str = "$") -> list[str]:
    """What of ``value`` breaks a JSON schema of types, properties, items, enums and bounds."""
    out = []
    kinds = schema.get("type")
    kinds = [kinds] if isinstance(kinds, str) else kinds
    if kinds and not any(_KINDS[k](value) for k in kinds):
        return [f"{path}: not {'/'.join(kinds)}"]
    if "enum" in schema and value not in schema["enum"]:
        out.append(f"{path}: not in enum")
    if isinstance(value, (int, float)) and not isinstance(value, bool):
        if "minimum" in schema and value < schema["minimum"]:
            out.append(f"{path}: below minimum")
        if "maximum" in schema and value > schema["maximum"]:
            out.append(f"{path}: above maximum")
    if isinstance(value, dict):
        known = schema.get("properties", {})
        out += [f"{path}.{k}: missing" for k in schema.get("required", []) if k not in value]
        if schema.get("additionalProperties") is False:
            out += [f"{path}.{k}: unknown" for k in sorted(value) if k not in known]
        for k in sorted(value):
            if k in known:
                out += problems(value[k], known[k], f"{path}.{k}")
    if isinstance(value, list) and "items" in schema:
        for i, v in enumerate(value):
            out += problems(v, schema["items"], f"{path}[{i}]")
    return out


def readable(schema) -> bool:
    """Whether :func:`problems` can check values by a schema that comes from data."""
    if not isinstance(schema, dict):
        return False
    kinds = schema.get("type", [])
    kinds = [kinds] if isinstance(kinds, str) else kinds
    known = schema.get("properties", {})
    required, items = schema.get("required", []), schema.get("items")
    return (
        isinstance(kinds, list) and all(isinstance(k, str) and k in _KINDS for k in kinds)
        and isinstance(schema.get("enum", []), list)
        and all(_KINDS["number"](schema.get(k, 0)) for k in ("minimum", "maximum"))
        and isinstance(required, list) and all(isinstance(k, str) for k in required)
        and isinstance(known, dict) and all(map(readable, known.values()))
        and ("items" not in schema or readable(items))
    )


def definitions(text: str) -> list[dict]:
    """Name and schema, as JSON, of the tools that a system message defines."""
    found = []
    for marked in TOOLS.findall(text):
        try:
            values = json.loads(marked, parse_constant=_refused)
        except (ValueError, RecursionError):
            values = []
            for line in marked.splitlines():
                try:
                    values.append(json.loads(line, parse_constant=_refused))
                except (ValueError, RecursionError):
                    continue
        for v in values if isinstance(values, list) else [values]:
            v = v.get("function", v) if isinstance(v, dict) else None
            if not isinstance(v, dict) or not isinstance(v.get("name"), str):
                continue
            schema = v.get("parameters", {})
            try:
                found.append({"name": _LONE.sub("\ufffd", v["name"]), "schema": canonical(schema if readable(schema) else {})})
            except (ValueError, RecursionError):
                found.append({"name": _LONE.sub("\ufffd", v["name"]), "schema": "{}"})
    return found


def _parse(pattern: re.Pattern, text: str) -> tuple[list[dict], str]:
    """The objects with an identifier that a pattern marks, and the rest of the text."""
    found = []

    def take(m: re.Match) -> str:
        try:
            value = json.loads(m[1], parse_constant=_refused)
            canonical(value)
        except (ValueError, RecursionError):
            return m[0]
        if not isinstance(value, dict) or value.get("id") is None:
            return m[0]
        found.append(value)
        return ""

    rest = pattern.sub(take, text)
    return found, rest.strip() if found else rest


def _identifier(value: dict) -> str:
    """The identifier as text; of one that is no text, its JSON."""
    i = value["id"]
    return _LONE.sub("\ufffd", i) if isinstance(i, str) else canonical(i)


def format_message(role: str | None, text: str | None, schemas: dict[str, dict]) -> tuple[str, list[dict], list[str], int]:
    """Canonical JSON, calls as (id, valid, name, arguments), identifiers of results,
    and the number of problems of the arguments."""
    body = text or ""
    calls, results = [], []
    message: dict = {"role": role}
    if "<tool_call>" in body:
        calls, body = _parse(CALL, body)
    if role == "tool" and "<tool_result>" in body:
        results, body = _parse(RESULT, body)
    message["content"] = body
    wrong, listed = 0, []
    for c in calls:
        name = c.get("name")
        schema = schemas.get(name) if isinstance(name, str) else None
        unknown = not isinstance(name, str) or (schema is None and bool(schemas))
        bad = ["unknown tool"] if unknown else problems(c.get("arguments", {}), schema or {})
        wrong += len(bad)
        called = _LONE.sub("\ufffd", name) if isinstance(name, str) else None
        listed.append({"id": _identifier(c), "valid": not bad, "name": called, "arguments": canonical(c.get("arguments", {}))})
    if calls:
        message["tool_calls"] = [{"id": _identifier(c), "name": c.get("name"), "arguments": c.get("arguments", {})} for c in calls]
    if results:
        message["tool_results"] = [{"id": _identifier(r), "content": r.get("content")} for r in results]
    return canonical(message), listed, [_identifier(r) for r in results], wrong


def format_chats(
    messages: DataFrame, schemas: dict[str, dict] | None = None,
    conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
) -> DataFrame:
    """One row per message, in the order of :func:`in_order`; ``n_linked`` of its
    calls have a result, or of its results have a call. ``schemas`` are those of
    conversations that define no tools."""
    schemas = dict(schemas or {})
    rows = messages.select(
        F.col(conversation).alias("conv_id"), F.col(turn).cast("long").alias("turn"), F.col(role).alias("role"), F.col(text).alias("text")
    )
    kind = rows.schema["conv_id"].dataType.simpleString()
    schema = (
        f"conv_id {kind}, turn long, role string, message string, "
        "calls array<struct<id: string, valid: boolean, name: string, arguments: string>>, results array<string>, "
        "n_problems long, tools array<struct<name: string, schema: string>>"
    )
    call_type = pa.struct([("id", pa.string()), ("valid", pa.bool_()), ("name", pa.string()), ("arguments", pa.string())])
    tool_type = pa.struct([("name", pa.string()), ("schema", pa.string())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            roles = b.column(2).to_pylist()
            found = [format_message(r, x.as_py(), schemas) for r, x in zip(roles, b.column(3))]
            tools = [definitions(x.as_py() or "") if r == "system" else [] for r, x in zip(roles, b.column(3))]
            yield pa.RecordBatch.from_arrays(
                [
                    *b.columns[:3], pa.array([f[0] for f in found], pa.string()),
                    pa.array([f[1] for f in found], pa.list_(call_type)),
                    pa.array([f[2] for f in found], pa.list_(pa.string())), pa.array([f[3] for f in found], pa.int64()),
                    pa.array(tools, pa.list_(tool_type)),
                ],
                names=["conv_id", "turn", "role", "message", "calls", "results", "n_problems", "tools"],
            )

    parsed = rows.mapInArrow(run, schema)
    carries = (F.size("calls") > 0) | (F.size("results") > 0)
    named = F.xxhash64("message")
    # Links need only identifiers and the places of messages, not their texts.
    nodes = stage(
        parsed.where(carries | (F.size("tools") > 0)).select("conv_id", "turn", "role", named.alias("row"), "calls", "results", "tools"), "linked_messages"
    )
    calls = (
        nodes.select("conv_id", "turn", "role", "row", F.size("results").alias("k"), F.explode("calls").alias("c"))
        .groupBy("conv_id", F.col("c.id").alias("id"))
        .agg(F.min(F.struct(_place("turn"), "role", "row", (F.col("k") > 0).alias("waits"))).alias("first"))
    )
    answered = nodes.select(F.col("conv_id").alias("in_conv"), F.explode("results").alias("in_id")).distinct()
    links = calls.join(answered, F.col("conv_id").eqNullSafe(F.col("in_conv")) & (F.col("id") == F.col("in_id")), "left").select(
        F.col("conv_id").alias("of_conv"), F.col("id").alias("of_id"), "first", F.col("in_id").isNotNull().alias("answered")
    )
    plain = parsed.where(~carries).select(
        "conv_id", "turn", "role", "message", F.lit(0).cast("long").alias("n_calls"), F.lit(0).cast("long").alias("n_results"),
        F.lit(0).cast("long").alias("n_linked"), "n_problems", F.col("turn").alias("after_turn"), F.lit(0).cast("long").alias("depth"),
    )
    ids = F.concat(F.transform("calls", lambda c: F.struct(c["id"].alias("id"), F.lit(True).alias("call"))),
                   F.transform("results", lambda r: F.struct(r.alias("id"), F.lit(False).alias("call"))))
    each = nodes.where(carries).dropDuplicates(["conv_id", "turn", "role", "row"]).withColumn("one", F.explode(ids)).join(
        links, F.col("conv_id").eqNullSafe(F.col("of_conv")) & (F.col("one.id") == F.col("of_id")), "left"
    )
    hit = F.when(F.col("one.call"), F.col("answered")).otherwise(F.col("of_id").isNotNull())
    counted = each.groupBy("conv_id", "turn", "role", "row").agg(F.count_if(hit).alias("n_linked"))
    placed = _in_places(each.where(~F.col("one.call") & F.col("of_id").isNotNull()).select("conv_id", "turn", "role", "row", "first"))
    extra = _same(_same(counted, placed, "left"), _checked(nodes), "left")
    extra = extra.select(
        F.col("conv_id").alias("x_conv"), F.col("turn").alias("x_turn"), F.col("role").alias("x_role"), F.col("row").alias("x_row"),
        "n_linked", "place", "depth", "n_found",
    )
    key = [("conv_id", "x_conv"), ("turn", "x_turn"), ("role", "x_role"), ("row", "x_row")]
    linked = parsed.where(carries).withColumn("row", named).join(extra, [F.col(a).eqNullSafe(F.col(b)) for a, b in key]).select(
        "conv_id", "turn", "role", "message", F.size("calls").cast("long").alias("n_calls"), F.size("results").cast("long").alias("n_results"),
        "n_linked", F.coalesce("n_found", "n_problems").alias("n_problems"),
        F.when(F.col("place").isNull(), F.col("turn")).otherwise(F.col("place.turn")).alias("after_turn"),
        F.coalesce("depth", F.lit(0)).cast("long").alias("depth"),
    )
    return plain.unionByName(linked)


NODE = ("conv_id", "turn", "role", "row")


def _place(turn: str) -> Column:
    """A turn that compares as it is ordered: null comes last."""
    return F.struct(F.col(turn).isNull().alias("none"), F.col(turn).alias("turn")).alias("place")


def _same(a: DataFrame, b: DataFrame, how: str) -> DataFrame:
    """Join on equal messages, null being equal to null."""
    b = b.select(*[F.col(c).alias(f"of_{c}") for c in NODE], *[c for c in b.columns if c not in NODE])
    joined = a.join(b, [F.col(c).eqNullSafe(F.col(f"of_{c}")) for c in NODE], how)
    return joined.drop(*[f"of_{c}" for c in NODE])


def _in_places(waits: DataFrame) -> DataFrame:
    """Per message with linked results its place, the latest of its own turn and of the
    places of the calls' messages, and its depth among those of one place.

    Only calls in messages that carry results themselves can move; their places are
    passed on until nothing changes.
    """
    first = F.col("first")
    itself = first["place"]["turn"].eqNullSafe(F.col("turn")) & first["role"].eqNullSafe(F.col("role")) & (first["row"] == F.col("row"))
    # A result without a turn is placed by its calls alone.
    latest = F.max("first.place")
    start = waits.groupBy(*NODE).agg(F.when(F.first("turn").isNull(), latest).otherwise(F.greatest(F.first(_place("turn")), latest)).alias("place"))
    edges = stage(
        waits.where(~itself & F.col("first.waits"))
        .select(*NODE, F.col("first.place.turn").alias("c_turn"), F.col("first.role").alias("c_role"), F.col("first.row").alias("c_row")).distinct(),
        "chains",
    )
    if edges.isEmpty():
        return start.withColumn("depth", F.lit(0))
    places = stage(start, "places")

    def calls_of(known: DataFrame, *columns: str) -> DataFrame:
        """The edges with columns of the message that holds the call."""
        turned = edges.select("conv_id", *[F.col(f"c_{c}").alias(c) for c in NODE[1:]], *[F.col(c).alias(f"r_{c}") for c in NODE[1:]])
        back = _same(turned, known.select(*NODE, *columns), "inner")
        return back.select("conv_id", *[F.col(f"r_{c}").alias(c) for c in NODE[1:]], *[F.col(c).alias(f"c_{c}") for c in NODE[1:]], *columns)

    while True:
        later = calls_of(places, "place").groupBy(*NODE).agg(F.max("place").alias("later"))
        moved = stage(_same(places, later, "left").select(*NODE, F.greatest("place", "later").alias("place"), (F.col("later") > F.col("place")).alias("moves")), "places")
        places = moved.drop("moves")
        if moved.where("moves").isEmpty():
            break
    # Depths matter only where call and result share a place; a round takes the
    # messages off whose calls all have a depth.
    tight = _same(calls_of(places.withColumnRenamed("place", "c_place"), "c_place"), places, "inner").where("place = c_place").drop("place", "c_place")
    tight, depth, deep = stage(tight, "tight"), 0, places.select(*NODE).limit(0).withColumn("depth", F.lit(0))
    while not tight.isEmpty():
        depth += 1
        callers = tight.select("conv_id", *[F.col(f"c_{c}").alias(c) for c in NODE[1:]]).distinct()
        waiting = tight.select(*NODE).distinct()
        free = stage(_same(callers, waiting.withColumn("waits", F.lit(True)), "left").where("waits is null").drop("waits"), "free")
        deep = stage(deep.unionByName(waiting.withColumn("depth", F.lit(depth))).groupBy(*NODE).agg(F.max("depth").alias("depth")), "depths")
        if free.isEmpty():
            break  # The rest are circles and what waits for them.
        gone = free.select("conv_id", *[F.col(c).alias(f"g_{c}") for c in NODE[1:]])
        tight = stage(
            tight.alias("t").join(
                gone.withColumnRenamed("conv_id", "g_conv"),
                F.col("conv_id").eqNullSafe(F.col("g_conv")) & F.col("c_turn").eqNullSafe(F.col("g_turn")) & F.col("c_role").eqNullSafe(F.col("g_role"))
                & (F.col("c_row") == F.col("g_row")), "left_anti",
            ), "tight",
        )
    return _same(places, deep, "left").withColumn("depth", F.coalesce("depth", F.lit(0)))


def _checked(nodes: DataFrame) -> DataFrame:
    """Per message with calls, in conversations that define tools, the number of
    problems of its calls by these definitions."""
    defined = (
        nodes.select(F.col("conv_id").alias("of_conv"), "turn", F.explode("tools").alias("t"))
        .groupBy("of_conv", F.col("t.name").alias("of_name")).agg(F.min(F.struct(_place("turn"), F.col("t.schema"))).alias("d"))
        .select("of_conv", "of_name", F.col("d.schema").alias("schema"))
    )
    having = defined.select(F.col("of_conv").alias("in_conv")).distinct()
    calls = nodes.dropDuplicates(list(NODE)).select(*NODE, F.explode("calls").alias("c")).select(*NODE, "c.name", "c.arguments")
    calls = calls.join(having, F.col("conv_id").eqNullSafe(F.col("in_conv"))).drop("in_conv").join(
        defined, F.col("conv_id").eqNullSafe(F.col("of_conv")) & (F.col("name") == F.col("of_name")), "left"
    ).select(*NODE, "arguments", "schema")
    kind = nodes.schema["conv_id"].dataType.simpleString()

    def check(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [1 if s is None else len(problems(json.loads(a), json.loads(s))) for a, s in zip(b.column(4).to_pylist(), b.column(5).to_pylist())]
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(found, pa.int64())], names=[*NODE, "n_found"])

    counts = calls.mapInArrow(check, f"conv_id {kind}, turn long, role string, row long, n_found long")
    return counts.groupBy(*NODE).agg(F.sum("n_found").alias("n_found"))


def in_order() -> list:
    """Sort columns that put the messages of a conversation in order: a result that
    was moved comes after its call's message."""
    return [F.col("conv_id"), F.col("after_turn").asc_nulls_last(), F.col("n_results") > 0, F.col("depth"), F.col("turn").asc_nulls_last(), F.col("role"), F.col("message")]
