"""Chat formatting: linking tool calls with their results.

Calls and results are hash-joined by identifier, ordered topologically,
validated against the schemas of their tools, and written as canonical JSON:
keys sorted at every depth, no blanks, one line a message.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import materialize

CALL, RESULT, MESSAGE = "call", "result", "message"

#: Schemas of the tools that the query's turns use: tool, argument, JSON type, required.
TURN_SCHEMA = (("reply", "text", "string", True), ("reply", "turn", "number", True))


def json_text(value: Column) -> Column:
    """A string as a JSON literal; null is null. Escapes quotes, backslashes and control characters only."""
    quoted = F.to_json(F.struct(value.alias("v")))
    return F.when(value.isNull(), F.lit("null")).otherwise(F.substr(quoted, F.lit(6), F.char_length(quoted) - 6))


def canonical(literal: Column) -> Column:
    """A JSON literal in canonical form, or null if it is not valid JSON.

    The parser stops behind the first value. So the literal is read inside an
    array and inside an object: what closes one early, or adds to it, breaks the
    other. An object that repeats a key, and a number beyond a double's range,
    do not count as valid. Whole numbers and decimals of up to 38 digits keep
    their value; longer ones, and those with an exponent, become doubles.
    """
    listed = F.to_json(F.try_parse_json(F.concat(F.lit("["), literal, F.lit("]"))))
    held = F.try_parse_json(F.concat(F.lit('{"v":'), literal, F.lit("}")))
    value = F.substr(listed, F.lit(2), F.char_length(listed) - 2)
    beyond = F.contains(value, F.lit('Infinity"')) & ~F.contains(literal, F.lit("Infinity"))
    return F.when(held.isNotNull() & ~beyond, value)


def json_type(literal: Column) -> Column:
    """Type of a canonical literal; null for null."""
    first = F.substring(literal, 1, 1)
    return F.when(literal.isNull(), None).when(first == '"', "string").when(first == "{", "object").when(first == "[", "array").when(literal.isin("true", "false"), "boolean").when(literal == "null", "null").otherwise("number")


def arguments(args: Column) -> Column:
    """A map<string,string> of JSON literals as array<struct<key, given, made>> sorted by key; made is canonical, null if the literal is not valid. A null literal is JSON null."""
    entries = F.transform(F.map_entries(args), lambda e: F.struct(e["key"].alias("key"), F.coalesce(e["value"], F.lit("null")).alias("given")))
    return F.transform(F.array_sort(entries), lambda e: F.struct(e["key"].alias("key"), e["given"].alias("given"), canonical(e["given"]).alias("made")))


def canonical_object(entries: Column) -> Column:
    """The arguments as an object; a literal that is not valid JSON is written as a string, so that the line stays JSON."""
    return F.concat(F.lit("{"), F.array_join(F.transform(entries, lambda e: F.concat(json_text(e["key"]), F.lit(":"), F.coalesce(e["made"], json_text(e["given"])))), ","), F.lit("}"))


def tool_shapes(schemas: DataFrame) -> DataFrame:
    """``tool, shape``: map of argument -> allowed types and whether it is required. Rows without tool or argument are left out; of repeated ones all types are allowed, and one that requires is enough."""
    known = schemas.where("tool is not null and arg is not null").groupBy("tool", "arg").agg(F.collect_set("type").alias("types"), F.coalesce(F.bool_or("required"), F.lit(False)).alias("required"))
    named = schemas.where("tool is not null").select("tool").distinct()
    made = known.groupBy("tool").agg(F.map_from_entries(F.collect_list(F.struct("arg", F.struct("types", "required")))).alias("shape"))
    empty = F.create_map().cast("map<string,struct<types:array<string>,required:boolean>>")
    return named.join(made, "tool", "left").select("tool", F.coalesce("shape", empty).alias("shape"))


def link_tool_calls(messages: DataFrame, schemas: DataFrame) -> DataFrame:
    """One row for each message, linked, ordered and serialised.

    messages: ``conv`` (any id), ``seq`` (place in the conversation), ``kind``
    (call, result or message), ``role``, ``call_id``, ``tool``, ``args``
    (map<string,string> of JSON literals, of calls), ``content``, ``after``
    (array<string> of call ids whose results a call needs).
    schemas: ``tool, arg, type, required``.

    Returns conv, seq, kind, call_id, ``linked`` (a call has a result, a result
    has a call; null for messages), ``valid`` (arguments are JSON and fit the
    schema: known tool, all required there, types right, none unknown; null but
    for calls), ``level`` (0, a result one above its call, a call one above the
    highest result it needs; -1 in a cycle or behind one) and ``json``. Sorted
    by (conv, level, seq) each result follows its call.

    Identifiers count within a conversation; of repeated ones the smallest seq
    is the call, or the result, and the rows that repeat it are not linked
    (rows equal in seq too share its link). A null conv or call_id links
    nothing, and needs that are null or not linked are met. Null content is JSON
    null. Empty tables are fine. Other columns are ignored. The joins run on
    (conv, call_id), so one long conversation is spread over all tasks.
    """
    base = materialize(messages.select("conv", "seq", "kind", "role", "call_id", "tool", "args", "content", "after"), "messages")
    ends = base.where(F.col("kind").isin(CALL, RESULT) & F.col("call_id").isNotNull())
    firsts = ends.groupBy("conv", "call_id", "kind").agg(F.min("seq").alias("seq"))
    calls = firsts.where(F.col("kind") == CALL).select("conv", "call_id", F.col("seq").alias("call_seq"))
    results = firsts.where(F.col("kind") == RESULT).select("conv", "call_id", F.col("seq").alias("result_seq"))
    links = materialize(calls.join(results, ["conv", "call_id"]), "links")

    levels = _levels(base, links)
    shapes = tool_shapes(schemas)
    out = base.join(links, ["conv", "call_id"], "left").join(F.broadcast(shapes) if shapes.count() <= 100_000 else shapes, "tool", "left")
    out = out.join(levels, ["conv", "call_id"], "left")
    linked = F.when(F.col("kind") == CALL, F.coalesce(F.col("seq") == F.col("call_seq"), F.lit(False))).when(F.col("kind") == RESULT, F.coalesce(F.col("seq") == F.col("result_seq"), F.lit(False)))
    out = out.withColumn("given", arguments(F.coalesce("args", F.create_map().cast("map<string,string>"))))
    args = F.col("given")
    missing = F.exists(F.map_entries("shape"), lambda e: e["value"]["required"] & ~F.exists(args, lambda a: a["key"] == e["key"]))
    wrong = F.exists(args, lambda a: F.coalesce(~F.array_contains(F.element_at("shape", a["key"])["types"], json_type(a["made"])), F.lit(True)))
    valid = F.when(F.col("kind") == CALL, F.col("shape").isNotNull() & ~F.coalesce(missing, F.lit(False)) & ~F.coalesce(wrong, F.lit(True)))
    level = F.when(F.col("kind") == CALL, F.coalesce("level", F.lit(0))).when((F.col("kind") == RESULT) & linked, F.when(F.col("level") < 0, -1).otherwise(F.coalesce("level", F.lit(0)) + 1)).otherwise(F.lit(0))
    body = F.when(F.col("kind") == CALL, F.concat(F.lit('{"arguments":'), canonical_object(args), F.lit(',"id":'), json_text(F.col("call_id")), F.lit(',"name":'), json_text(F.col("tool")), F.lit(',"role":'), json_text(F.col("role")), F.lit(',"type":"call"}')))
    body = body.when(F.col("kind") == RESULT, F.concat(F.lit('{"content":'), json_text(F.col("content")), F.lit(',"id":'), json_text(F.col("call_id")), F.lit(',"role":'), json_text(F.col("role")), F.lit(',"type":"result"}')))
    body = body.otherwise(F.concat(F.lit('{"content":'), json_text(F.col("content")), F.lit(',"role":'), json_text(F.col("role")), F.lit(',"type":"message"}')))
    return out.select("conv", "seq", "kind", "call_id", linked.alias("linked"), valid.alias("valid"), level.cast("int").alias("level"), body.alias("json"))


def _levels(base: DataFrame, links: DataFrame) -> DataFrame:
    """``conv, call_id, level`` of calls that need others.

    Calls that need one other form chains, and those are shortened first: each
    call points to what it needs, then to what that points to, so a chain of n
    calls takes log n rounds. What is left are calls with several needs, whose
    needs now point to calls without any or to others of their kind; those are
    peeled off layer by layer, as Kahn does, until none is ready.
    """
    key = ["conv", "call_id"]
    needs = base.where((F.col("kind") == CALL) & (F.size("after") > 0)).join(links, key).where("seq = call_seq")
    edges = needs.select(*key, F.explode("after").alias("need")).join(links.select("conv", F.col("call_id").alias("need")), ["conv", "need"])
    edges = materialize(edges.select(*key, "need").distinct(), "needs")
    count = edges.groupBy(*key).agg(F.count("*").alias("n"))
    single = edges.join(count.where("n = 1"), key).select(*key, F.col("need").alias("to"), F.lit(1).cast("long").alias("hops"))
    single = materialize(single, "chains")
    reach, most = 1, single.count()
    while reach <= most:
        ahead = single.select("conv", F.col("call_id").alias("to"), F.col("to").alias("next"), F.col("hops").alias("more"))
        moved = single.join(ahead, ["conv", "to"], "left")
        moved = materialize(moved.select(*key, F.coalesce("next", "to").alias("to"), (F.col("hops") + F.coalesce("more", F.lit(0))).alias("hops"), F.col("next").isNotNull().alias("moved")), "chains")
        single = moved.drop("moved")
        if moved.where("moved").isEmpty():
            break
        reach *= 2
    # Whoever still points into a chain after so many rounds is in a cycle or behind one.
    chained = single.select("conv", F.col("call_id").alias("at"))
    several = edges.join(count.where("n > 1"), key).join(single.select("conv", F.col("call_id").alias("need"), "to", "hops"), ["conv", "need"], "left")
    open_ = materialize(several.select(*key, F.coalesce("to", "need").alias("at"), (F.coalesce("hops", F.lit(0)) + 1).alias("steps")), "several")
    done = open_.limit(0).select(*key, F.lit(0).cast("long").alias("level"))
    while not open_.isEmpty():
        unknown = open_.select("conv", F.col("call_id").alias("at")).union(chained).distinct()
        waiting = open_.join(unknown, ["conv", "at"], "left_semi").select(*key).distinct()
        ready = open_.join(waiting, key, "left_anti").join(done.select("conv", F.col("call_id").alias("at"), "level"), ["conv", "at"], "left")
        ready = materialize(ready.groupBy(*key).agg(F.max(F.coalesce("level", F.lit(0)) + 2 * F.col("steps")).alias("level")), "level")
        if ready.isEmpty():
            break
        done = materialize(done.unionByName(ready), "levels")
        open_ = materialize(open_.join(ready, key, "left_anti"), "several")
    several = done.unionByName(open_.select(*key, F.lit(-1).cast("long").alias("level")).distinct())
    ends = several.select("conv", F.col("call_id").alias("to"), "level")
    stuck = chained.select("conv", F.col("at").alias("to")).withColumn("stuck", F.lit(True))
    level = F.when(F.col("stuck") | (F.col("level") < 0), F.lit(-1)).otherwise(F.coalesce("level", F.lit(0)) + 2 * F.col("hops"))
    return several.unionByName(single.join(ends, ["conv", "to"], "left").join(stuck, ["conv", "to"], "left").select(*key, level.cast("long").alias("level")))


#: Turns of a conversation that are looked through at once for the last user turn.
TURNS = 1024


def turns_as_calls(conversations: DataFrame) -> DataFrame:
    """conversations(conv_id, turn, role, text) as messages: a user turn calls ``reply``, an assistant turn answers the last call before it, and a call needs the reply to the call before it.

    The call id is the user turn's number. Other turns are messages. A turn
    without number follows no call. Conversations are cut into stretches of
    ``TURNS`` numbers; the last call of the stretches before is carried into
    each, so a long conversation is spread over many tasks.
    """
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv"), F.col("turn").cast("long").alias("seq"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("content"))
    rows = rows.withColumn("stretch", F.coalesce(F.floor(F.col("seq") / TURNS), F.lit(-(2**62))))
    call = F.when(F.col("role") == "user", F.col("seq"))
    ends = rows.groupBy("conv", "stretch").agg(F.max(call).alias("end"))
    carried = ends.withColumn("carried", F.max("end").over(W.partitionBy("conv").orderBy("stretch").rowsBetween(W.unboundedPreceding, -1))).select(F.col("conv").alias("c"), F.col("stretch").alias("s"), "carried")
    within = W.partitionBy("conv", "stretch").orderBy("seq")
    rows = rows.withColumn("here", F.max(call).over(within.rangeBetween(W.unboundedPreceding, W.currentRow))).withColumn("before", F.max(call).over(within.rangeBetween(W.unboundedPreceding, -1)))
    rows = rows.join(carried, F.col("conv").eqNullSafe(F.col("c")) & (F.col("stretch") == F.col("s")), "left")
    rows = rows.withColumn("asked", F.coalesce("here", "carried")).withColumn("earlier", F.coalesce("before", "carried"))
    is_call, is_result = F.col("role") == "user", F.col("role") == "assistant"
    return rows.select(
        "conv",
        "seq",
        F.when(is_call, CALL).when(is_result, RESULT).otherwise(MESSAGE).alias("kind"),
        "role",
        F.when(is_call | is_result, F.col("asked").cast("string")).alias("call_id"),
        F.when(is_call, F.lit("reply")).alias("tool"),
        F.when(is_call, F.create_map(F.lit("text"), json_text(F.col("content")), F.lit("turn"), F.col("seq").cast("string"))).alias("args"),
        F.when(~is_call | is_call.isNull(), F.col("content")).alias("content"),
        F.when(is_call & F.col("earlier").isNotNull(), F.array(F.col("earlier").cast("string"))).otherwise(F.array().cast("array<string>")).alias("after"),
    )


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    schemas = spark.createDataFrame(list(TURN_SCHEMA), "tool string, arg string, type string, required boolean")
    out = link_tool_calls(turns_as_calls(spark.read.parquet(f"{sf_dir}/conversations.parquet")), schemas)
    return out.select(F.col("conv").alias("conv_id"), F.col("seq").alias("turn"), "kind", "call_id", "linked", "valid", "level", "json")


ORACLE = r"""
WITH turns AS (
  SELECT conv_id, turn, role, text,
    last_value(CASE WHEN role = 'user' THEN turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS asked
  FROM conversations),
ends AS (
  SELECT conv_id, asked, min(CASE WHEN role = 'user' THEN turn END) AS c, min(CASE WHEN role = 'assistant' THEN turn END) AS r
  FROM turns WHERE role IN ('user', 'assistant') AND asked IS NOT NULL GROUP BY conv_id, asked),
linked AS (
  SELECT turns.*, CASE WHEN role = 'user' THEN coalesce(turn = c AND r IS NOT NULL, false)
    WHEN role = 'assistant' THEN coalesce(turn = r AND c IS NOT NULL, false) END AS linked
  FROM turns LEFT JOIN ends ON turns.conv_id = ends.conv_id AND turns.asked = ends.asked),
calls AS (
  SELECT conv_id, asked, count(*) FILTER (NOT linked) OVER (PARTITION BY conv_id ORDER BY turn) AS part FROM linked WHERE role = 'user'),
levels AS (
  -- A call needs the reply to the call before it, so levels count up within an unbroken run of answered calls.
  SELECT calls.conv_id, calls.asked, 2 * (row_number() OVER (PARTITION BY calls.conv_id, part ORDER BY calls.asked) - 1) AS level
  FROM calls JOIN linked ON calls.conv_id = linked.conv_id AND calls.asked = linked.turn WHERE linked.linked)
SELECT linked.conv_id, turn, CASE role WHEN 'user' THEN 'call' WHEN 'assistant' THEN 'result' ELSE 'message' END AS kind,
  CASE WHEN role IN ('user', 'assistant') THEN CAST(linked.asked AS VARCHAR) END AS call_id, linked,
  CASE WHEN role = 'user' THEN text IS NOT NULL AND turn IS NOT NULL END AS valid,
  CAST(CASE WHEN linked THEN coalesce(level, 0) + CASE role WHEN 'assistant' THEN 1 ELSE 0 END ELSE 0 END AS INTEGER) AS level,
  CASE role WHEN 'user' THEN '{"arguments":{"text":' || CAST(to_json(text) AS VARCHAR) || ',"turn":' || turn || '},"id":' || CAST(to_json(CAST(linked.asked AS VARCHAR)) AS VARCHAR) || ',"name":"reply","role":"user","type":"call"}'
    WHEN 'assistant' THEN '{"content":' || CAST(to_json(text) AS VARCHAR) || ',"id":' || coalesce(CAST(to_json(CAST(linked.asked AS VARCHAR)) AS VARCHAR), 'null') || ',"role":"assistant","type":"result"}'
    ELSE '{"content":' || CAST(to_json(text) AS VARCHAR) || ',"role":' || CAST(to_json(role) AS VARCHAR) || ',"type":"message"}' END AS json
FROM linked LEFT JOIN levels ON linked.conv_id = levels.conv_id AND linked.asked = levels.asked
"""
