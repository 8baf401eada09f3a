"""Chat formatting: tool calls linked to their results, put in order and serialised as canonical JSON.

Method.  Calls and results are hash-joined by (conversation, identifier).  They are ordered topologically: a
result comes after its call, and a call after the results of the calls that it names in ``after``.  An
event's ``order_turn`` is the latest turn among it and all that it depends on, its ``order_level`` the longest
path of dependencies that leads to it, so both grow along each dependency; levels are worked out in rounds
of pointer doubling, so that a chain of ``after`` takes the logarithm of its length (``levels``); what can't be
contracted, as where each call names the two before it, takes a round for each step.  The order is (order_turn, order_level, turn, order_item,
json), with order_item the place within the message: a key of each row instead of a number within the
conversation, so that no conversation is ever gathered into one task.  The arguments of a call are parsed and
checked against the tool's schema, and every message is serialised as JSON with sorted keys, no spaces and
no null members.

Messages are rows (conv_id, turn, role, text).  An assistant text that is a JSON object
``{"tool_calls": [{"id": .., "name": .., "arguments": {..}, "after": [..]}]}`` makes calls; a text of role tool
``{"tool_call_id": .., "content": ..}`` is a result.  With ``turns=True`` a plain user message counts
as a call of the tool ``reply`` with arguments {"prompt": text, "turn": turn} and its turn as
identifier, after the user message two turns before it if there is one, and a plain assistant message as the
result of the turn before it.

Schemas are JSON schemas with the members type (object, array, string, integer, number, boolean, null),
properties, required, additionalProperties (false), items and enum, to any depth.

Defined results
* null conv_id, turn or role: a plain message, linked with nothing; null text: JSON without a text
  member, and a ``reply`` call without prompt, which is not valid;
* an empty prompt is valid; a tool without schema: any JSON object is valid; arguments that don't
  parse as an object are not;
* repeated rows each give a row, with equal keys; an identifier used by several calls is one call for linking,
  placed at the first of them, and needs what any of them names;
* identifiers in ``after`` that no call has are ignored; calls on a cycle, or behind one, can't be put
  after each other: they are ``cyclic``, at level 0 of their own turns, and their results follow them;
* a message with several calls gives a row for each; no rows: no rows; other columns are not read.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import dropped, stored

#: For each tool the JSON schema of its arguments.
Schemas = dict[str, dict]
REPLY: Schemas = {"reply": {"type": "object", "properties": {"prompt": {"type": "string"}, "turn": {"type": "integer"}}, "required": ["prompt", "turn"], "additionalProperties": False}}
#: What Spark calls the JSON types.
_KINDS = {"string": "^STRING$", "integer": r"^(BIGINT|DECIMAL\(\d+,0\))$", "number": "^(BIGINT|DOUBLE|DECIMAL)", "boolean": "^BOOLEAN$", "null": "^VOID$", "array": "^ARRAY", "object": "^OBJECT"}


def canonical(text: Column) -> Column:
    """A JSON text with sorted keys and no spaces, at all depths; null where it doesn't parse."""
    return F.to_json(F.try_parse_json(text))


def fits(value: Column, schema: dict) -> Column:
    """Whether a variant fits a JSON schema; null where there is no value."""
    ok = F.lit(True)
    if "type" in schema:
        wanted = schema["type"] if isinstance(schema["type"], list) else [schema["type"]]
        ok = ok & F.schema_of_variant(value).rlike("|".join(_KINDS[w] for w in wanted))
    if "enum" in schema:
        ok = ok & F.to_json(value).isin([json.dumps(e, ensure_ascii=False, sort_keys=True, separators=(",", ":")) for e in schema["enum"]])
    members = schema.get("properties", {})
    is_object, is_array = F.schema_of_variant(value).startswith("OBJECT"), F.schema_of_variant(value).startswith("ARRAY")
    for name, part in members.items():
        found = F.try_variant_get(value, f"$['{name}']", "variant")
        ok = ok & (~is_object | F.when(found.isNotNull(), fits(found, part)).otherwise(name not in schema.get("required", [])))
    for name in schema.get("required", []):
        if name not in members:
            ok = ok & (~is_object | F.try_variant_get(value, f"$['{name}']", "variant").isNotNull())
    if schema.get("additionalProperties") is False:
        known = F.array(*[F.lit(m) for m in members]).cast("array<string>")
        ok = ok & (~is_object | (F.size(F.array_except(F.json_object_keys(F.to_json(value)), known)) == 0))
    if "items" in schema:
        ok = ok & (~is_array | F.forall(F.coalesce(F.try_variant_get(value, "$", "array<variant>"), F.array().cast("array<variant>")), lambda v: fits(v, schema["items"])))
    return ok


def valid_arguments(name: Column, arguments: Column, schemas: Schemas) -> Column:
    """Whether a JSON text is an object that fits the schema of a tool."""
    value = F.try_parse_json(arguments)
    out = F.lit(True)
    for tool, schema in schemas.items():
        out = F.when(name == tool, F.coalesce(fits(value, schema), F.lit(False))).otherwise(out)
    return F.coalesce(F.schema_of_variant(value).startswith("OBJECT"), F.lit(False)) & out


def events(messages: DataFrame, turns: bool) -> DataFrame:
    """Messages as (conv_id, turn, role, text, kind, call_id, name, arguments, after, order_item): one row for each call, result or plain message."""
    call = "struct<id:string,name:string,arguments:string,after:array<string>>"
    looks_json = F.col("text").rlike(r"^[ \t\r\n]*\{")
    calls = F.from_json(F.get_json_object(F.when((F.col("role") == "assistant") & looks_json, F.col("text")), "$.tool_calls"), f"array<{call}>")
    result = F.get_json_object(F.when((F.col("role") == "tool") & looks_json, F.col("text")), "$.tool_call_id")
    turn_id = lambda back: F.concat(F.lit("turn:"), (F.col("turn") - back).cast("string"))
    none, nothing, first = F.lit(None).cast("string"), F.lit(None).cast("array<string>").alias("after"), F.lit(0).alias("order_item")
    keyed = F.col("conv_id").isNotNull() & F.col("turn").isNotNull()
    asked = F.to_json(F.struct(F.col("text").alias("prompt"), F.col("turn").alias("turn")))
    plain = F.struct(F.lit("message").alias("kind"), none.alias("call_id"), none.alias("name"), none.alias("arguments"), nothing, first)
    if turns:
        plain = (
            F.when(keyed & (F.col("role") == "user"), F.struct(F.lit("call").alias("kind"), turn_id(0).alias("call_id"), F.lit("reply").alias("name"), asked.alias("arguments"), F.array(turn_id(2)).alias("after"), first))
            .when(keyed & (F.col("role") == "assistant"), F.struct(F.lit("result").alias("kind"), turn_id(1).alias("call_id"), none.alias("name"), none.alias("arguments"), nothing, first))
            .otherwise(plain)
        )
    made = F.transform("_calls", lambda c, i: F.struct(F.lit("call").alias("kind"), c["id"].alias("call_id"), c["name"].alias("name"), c["arguments"].alias("arguments"), c["after"].alias("after"), i.alias("order_item")))
    answered = F.struct(F.lit("result").alias("kind"), F.col("_result").alias("call_id"), none.alias("name"), none.alias("arguments"), nothing, first)
    out = messages.select("conv_id", "turn", "role", "text").withColumns({"_calls": calls, "_result": result})
    event = F.when(F.size("_calls") > 0, made).when(F.col("_result").isNotNull(), F.array(answered)).otherwise(F.array(plain))
    return out.select("conv_id", "turn", "role", "text", F.explode(event).alias("e")).select("conv_id", "turn", "role", "text", "e.*")


#: Steps that a dependency stands for at most: those on a cycle double without end.
_MOST_STEPS = 1 << 40


def levels(ids: DataFrame, after: DataFrame) -> DataFrame | None:
    """(conv, id, level, call_at, cyclic) of identifiers that depend on others, or None.

    ``ids`` (conv, id, call_turn, result_turn) are all identifiers, ``after`` (conv, id, needs) which calls need which results.
    An edge says what ``id`` gets from ``needs``: a level of at least ``least`` and that of ``needs`` plus ``steps``, a turn of at
    least ``turn`` and that of ``needs``.  A round settles the identifiers that need nothing open, and lets each edge to an
    identifier with one open need go on to that one; edges between the same two become one.  So a chain of n calls takes
    log2(n) rounds, as does what branches off one and comes together again; edges only get fewer.
    """
    same = lambda id_: (F.col("conv") == F.col("_c")) & (F.col(id_) == F.col("_i"))
    keys = lambda df: df.select(F.col("conv").alias("_c"), F.col("id").alias("_i")).distinct()
    known = keys(ids.where("call_turn is not null"))
    none = F.lit(None).cast("long")
    edges = after.join(known, same("needs"), "left_semi").select("conv", "id", "needs").distinct().withColumns({"steps": F.lit(1).cast("long"), "least": none, "turn": none})
    edges = stored(edges, "chat-edges")
    if edges.isEmpty():
        return None
    own = ids.select(F.col("conv").alias("_c"), F.col("id").alias("_i"), F.col("call_turn").cast("long").alias("first_turn"), F.col("call_turn").cast("long").alias("call_at"), F.col("result_turn").cast("long").alias("result_turn"))
    node = ["conv", "id", "level", "first_turn", "call_at", "result_turn"]
    waiting = stored(edges.select("conv", "id").distinct().join(own, same("id")).withColumn("level", none).select(node), "chat-waiting")
    free = edges.select("conv", F.col("needs").alias("id")).distinct().join(keys(waiting), same("id"), "left_anti").join(own, same("id"))
    fresh, settled = stored(free.withColumn("level", F.lit(0).cast("long")).select(node), "chat-settled"), None
    while not fresh.isEmpty():
        settled = fresh if settled is None else settled.unionByName(fresh)
        done = fresh.select(F.col("conv").alias("_c"), F.col("id").alias("_i"), F.col("level").alias("_level"), F.greatest("result_turn", "call_at").alias("_at"))
        got = edges.join(done, same("needs")).groupBy(F.col("conv").alias("_conv"), F.col("id").alias("_id")).agg(F.max(F.greatest("least", F.col("_level") + F.col("steps"))).alias("_least"), F.max(F.greatest("turn", "_at")).alias("_turn"))
        nodes = waiting.join(got, (F.col("conv") == F.col("_conv")) & (F.col("id") == F.col("_id")), "left").withColumns({"level": F.greatest("level", "_least"), "call_at": F.greatest("call_at", "_turn")}).select(node)
        left = edges.join(keys(fresh), same("needs"), "left_anti")
        open_ = left.groupBy(F.col("conv").alias("_c"), F.col("id").alias("_i")).agg(F.count("*").alias("n"), *[F.min(c).alias(f"_{c}") for c in ("needs", "steps", "least", "turn")])
        counted = stored(nodes.join(open_, same("id"), "left"), "chat-nodes")
        nodes = counted.drop("_c", "_i")
        # what an edge to the only open need of its end goes on to
        on = nodes.where("n = 1").select(
            F.col("conv").alias("_c"), F.col("id").alias("_i"), "_needs", "_steps", F.greatest("level", "_least").alias("_least"), F.greatest("call_at", "result_turn", "_turn").alias("_turn"),
        )
        moved = left.join(on, same("needs"), "left")
        goes = F.col("_needs").isNotNull()
        moved = moved.select(
            "conv", "id", F.coalesce("_needs", "needs").alias("needs"), F.when(goes, F.least(F.col("steps") + F.col("_steps"), F.lit(_MOST_STEPS))).otherwise(F.col("steps")).alias("steps"),
            F.greatest("least", F.col("_least") + F.col("steps")).alias("least"), F.greatest("turn", "_turn").alias("turn"),
        )
        old = (edges, waiting)
        edges = stored(moved.groupBy("conv", "id", "needs").agg(F.max("steps").alias("steps"), F.max("least").alias("least"), F.max("turn").alias("turn")), "chat-edges")
        fresh, waiting = stored(nodes.where("n is null").select(node), "chat-settled"), stored(nodes.where("n is not null").select(node), "chat-waiting")
        dropped(*old, counted)
    stuck = waiting.select("conv", "id", F.lit(0).alias("level"), F.col("first_turn").alias("call_at"), F.lit(True).alias("cyclic"))
    if settled is None:
        return stuck
    return settled.select("conv", "id", F.col("level").cast("int").alias("level"), "call_at", F.lit(False).alias("cyclic")).unionByName(stuck)


def link(messages: DataFrame, schemas: Schemas = REPLY, turns: bool = False) -> DataFrame:
    """The operator: every event with ``linked``, ``valid`` (calls), ``cyclic``, the order (order_turn, order_level, turn, order_item, json) and ``json``."""
    rows = events(messages, turns)
    named = rows.where("call_id is not null and conv_id is not null and kind <> 'message'")
    is_call, is_result = F.col("kind") == "call", F.col("kind") == "result"
    # one row for each identifier, so that repeated messages don't multiply in the join
    ids = named.groupBy(F.col("conv_id").alias("conv"), F.col("call_id").alias("id")).agg(F.min(F.when(is_call, F.col("turn"))).alias("call_turn"), F.min(F.when(is_result, F.col("turn"))).alias("result_turn"), F.count_if(is_call).alias("calls"), F.count_if(is_result).alias("results"))
    ids = stored(ids, "chat-ids")
    after = named.where(is_call & (F.size("after") > 0)).select(F.col("conv_id").alias("conv"), F.col("call_id").alias("id"), F.explode("after").alias("needs"))
    deep = levels(ids, after)
    if deep is None:
        ids = ids.withColumns({"level": F.lit(0), "call_at": F.col("call_turn"), "cyclic": F.lit(False)})
    else:
        deep = deep.withColumnsRenamed({"conv": "_c", "id": "_i"})
        ids = ids.join(deep, (F.col("conv") == F.col("_c")) & (F.col("id") == F.col("_i")), "left").drop("_c", "_i").withColumns({"level": F.coalesce("level", F.lit(0)), "call_at": F.coalesce("call_at", "call_turn"), "cyclic": F.coalesce("cyclic", F.lit(False))})
    ids = ids.select(F.col("conv").alias("_conv"), F.col("id").alias("_id"), "call_at", "calls", "results", "level", "cyclic")
    out = rows.join(ids, (F.col("conv_id") == F.col("_conv")) & (F.col("call_id") == F.col("_id")), "left")
    linked = F.coalesce(F.when(is_call, F.col("results") > 0).when(is_result, F.col("calls") > 0), F.lit(False))
    order_turn = F.when(is_call & ~F.col("cyclic"), F.greatest("turn", "call_at")).when(is_result, F.greatest("turn", "call_at")).otherwise(F.col("turn"))
    # each identifier that another one needs adds its call and its result to the path
    order_level = F.when(is_call, 2 * F.col("level")).when(is_result & (F.col("calls") > 0), 2 * F.col("level") + 1).otherwise(F.lit(0))
    valid = F.when(is_call, valid_arguments(F.col("name"), F.col("arguments"), schemas)).otherwise(True)  # there is nothing to check
    body = F.to_json(F.struct(F.when(is_call, F.try_parse_json("arguments")).alias("arguments"), F.col("call_id").alias("call_id"), F.col("kind").alias("kind"), F.col("name").alias("name"), F.col("role").alias("role"), F.when(~is_call | F.col("arguments").isNull(), F.col("text")).alias("text"), F.col("turn").alias("turn")))
    return out.select("conv_id", "turn", "role", "kind", "call_id", linked.alias("linked"), valid.alias("valid"), F.coalesce("cyclic", F.lit(False)).alias("cyclic"), order_turn.alias("order_turn"), F.coalesce(order_level, F.lit(0)).cast("int").alias("order_level"), F.coalesce("order_item", F.lit(0)).alias("order_item"), body.alias("json"))


#: DuckDB equivalent of ``link(conversations, turns=True)`` for plain messages.
ORACLE_SQL = """
WITH rows AS (
  SELECT conv_id, turn, role, text,
    CASE WHEN conv_id IS NULL OR turn IS NULL THEN 'message' WHEN role = 'user' THEN 'call' WHEN role = 'assistant' THEN 'result' ELSE 'message' END AS kind
  FROM conversations
), named AS (
  SELECT *, CASE kind WHEN 'call' THEN 'turn:' || turn WHEN 'result' THEN 'turn:' || (turn - 1) END AS call_id FROM rows
), ids AS (
  SELECT conv_id, call_id, min(turn) FILTER (kind = 'call') AS call_turn, count(*) FILTER (kind = 'call') AS calls, count(*) FILTER (kind = 'result') AS results
  FROM named WHERE call_id IS NOT NULL GROUP BY conv_id, call_id
), chains AS (
  SELECT conv_id, call_id, row_number() OVER (PARTITION BY conv_id, turn - 2 * k ORDER BY turn) - 1 AS level FROM (
    SELECT conv_id, call_id, call_turn AS turn, row_number() OVER (PARTITION BY conv_id, call_turn % 2 ORDER BY call_turn) AS k FROM ids WHERE calls > 0)
)
SELECT n.conv_id, n.turn, n.role, n.kind, n.call_id,
  coalesce(CASE n.kind WHEN 'call' THEN results > 0 WHEN 'result' THEN calls > 0 END, false) AS linked,
  CASE WHEN n.kind = 'call' THEN text IS NOT NULL ELSE true END AS valid,
  false AS cyclic, CASE WHEN n.kind = 'result' THEN greatest(n.turn, call_turn) ELSE n.turn END AS order_turn,
  CAST(CASE WHEN n.kind = 'call' THEN 2 * level WHEN n.kind = 'result' AND calls > 0 THEN 2 * level + 1 ELSE 0 END AS INTEGER) AS order_level, CAST(0 AS INTEGER) AS order_item,
  '{' || concat_ws(',',
    CASE WHEN n.kind = 'call' THEN '"arguments":{' || concat_ws(',', '"prompt":' || CAST(to_json(text) AS VARCHAR), '"turn":' || n.turn) || '}' END,
    '"call_id":' || CAST(to_json(n.call_id) AS VARCHAR), '"kind":"' || n.kind || '"',
    CASE WHEN n.kind = 'call' THEN '"name":"reply"' END,
    '"role":' || CAST(to_json(role) AS VARCHAR),
    CASE WHEN n.kind <> 'call' THEN '"text":' || CAST(to_json(text) AS VARCHAR) END,
    '"turn":' || n.turn) || '}' AS json
FROM named n LEFT JOIN ids i ON n.conv_id = i.conv_id AND n.call_id = i.call_id LEFT JOIN chains c ON n.conv_id = c.conv_id AND n.call_id = c.call_id"""
