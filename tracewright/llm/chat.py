"""Chat formatting with linked tool calls, in DataFrame functions only.

A message whose text is a JSON object may hold `tools` (a system message: name, and parameters with properties and
required), `tool_calls` (an assistant message: id, name, arguments, depends_on) or `tool_call_id` and `content` (a tool
message). Calls meet their results in a hash join by conversation and identifier, are ordered so that each comes after
the calls it depends on, are validated against the tool's schema, and each message is written as canonical JSON: keys in
order, no white space; of an assistant's object the keys `content` and `tool_calls`, of a tool's `tool_call_id` and
`content`, and other keys are left out. Nothing is gathered by conversation, so one conversation may hold any number of
messages.

Schemas are walked level by level, value beside schema, as rows. What counts: type (a name or a list of names; an integer
is a number without a fraction part in the text), enum and const (by JSON text), required, properties,
additionalProperties when it is false, items, minimum, maximum, minLength, maxLength. Other keywords are passed over.

Defined cases: a text that is no JSON object is plain content; null texts, roles, turns and conversations are kept as
null; each row is a message of its own, also where rows repeat or share a turn; a call without id is never linked; of
calls, results or schemas that repeat an identifier the first by turn (then by text) counts, and later calls are in error
(duplicate_id); a result before its call, a call without result, an unknown tool, a missing or unknown argument, a value of
another type, outside its enum or range, and a circular dependency are errors, listed in order of their names; dependencies
on unknown calls order nothing; arguments that are no object count as none; an empty table gives no rows; extra columns never clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: JSON-schema types and what the engine calls the types of values that fit them.
TYPES = {"string": "STRING", "integer": "BIGINT", "number": "BIGINT|DOUBLE|DECIMAL.*|FLOAT", "boolean": "BOOLEAN", "array": "ARRAY.*", "object": "OBJECT.*", "null": "VOID"}


def _get(v: Column, path: str, kind: str) -> Column:
    return F.try_variant_get(v, path, kind)


def _messages(chats: DataFrame) -> DataFrame:
    text = F.col("text").cast("string")
    rows = chats.select("conv_id", F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), text.alias("text"))
    return _parsed(rows)


def _parsed(rows: DataFrame) -> DataFrame:
    return rows.withColumn("body", F.when(F.ltrim("text").startswith("{"), F.try_parse_json("text")))


def _holds() -> Column:
    """Whether a message has calls."""
    return F.coalesce(F.size(_get(F.col("body"), "$.tool_calls", "array<variant>")) > 0, F.lit(False)) & F.coalesce(F.col("role") == "assistant", F.lit(False))


def _callers(rows: DataFrame) -> DataFrame:
    """The messages with calls, each under a number `msg` of its own, written once so that all who read it see the same."""
    own = rows.where(_holds()).select("conv_id", "turn", "role", "text", F.monotonically_increasing_id().alias("msg"))
    return _parsed(materialize(own, "callers"))


def _schemas(rows: DataFrame) -> DataFrame:
    """conv_id, name, schema (JSON): the tools that system messages declare, the first of a name."""
    tool = rows.where("role = 'system'").select("conv_id", "turn", F.explode(_get(F.col("body"), "$.tools", "array<variant>")).alias("t"))
    schema = F.coalesce(F.to_json(_get(F.col("t"), "$.parameters", "variant")), F.lit("{}"))
    named = tool.select("conv_id", _get(F.col("t"), "$.name", "string").alias("name"), F.struct("turn", schema.alias("schema")).alias("s"))
    return named.where("name is not null").groupBy("conv_id", "name").agg(F.min_by("s", "s").alias("s")).select("conv_id", "name", "s.schema")


def _calls(callers: DataFrame) -> DataFrame:
    own = callers.select("conv_id", "turn", "msg", F.xxhash64("text").alias("hash"), F.posexplode(_get(F.col("body"), "$.tool_calls", "array<variant>")).alias("pos", "c"))
    c = F.col("c")
    given = F.coalesce(_get(c, "$.arguments", "variant"), _get(c, "$.function.arguments", "variant"))
    packed = F.coalesce(_get(c, "$.arguments", "string"), _get(c, "$.function.arguments", "string"))
    arguments = F.coalesce(F.when(F.ltrim(packed).startswith("{"), F.try_parse_json(packed)), given)
    return own.select("conv_id", "turn", "msg", "pos", F.struct("turn", "hash", "msg", "pos").alias("place"), _get(c, "$.id", "string").alias("id"), F.coalesce(_get(c, "$.name", "string"), _get(c, "$.function.name", "string")).alias("name"), arguments.alias("args"), F.coalesce(_get(c, "$.depends_on", "array<string>"), F.array().cast("array<string>")).alias("needs"))


def _levels(calls: DataFrame) -> DataFrame:
    """conv_id, id, level for calls with an id: 0 without dependencies, else one more than the deepest of them; calls
    in or behind a circle have none. One round for each level."""
    nodes = materialize(calls.where("id is not null").groupBy("conv_id", "id").agg(F.min_by("needs", "place").alias("needs")), "calls")
    known = nodes.select(F.col("conv_id").alias("kc"), F.col("id").alias("k"))
    edges = nodes.select("conv_id", "id", F.explode(F.array_distinct("needs")).alias("need"))
    edges = materialize(edges.join(known, F.col("conv_id").eqNullSafe(F.col("kc")) & (F.col("need") == F.col("k"))).select("conv_id", "id", "need"), "needs")
    behind = edges.groupBy(F.col("conv_id").alias("ec"), F.col("id").alias("e")).agg(F.count("*").alias("n"))
    same = F.col("conv_id").eqNullSafe(F.col("ec")) & (F.col("id") == F.col("e"))
    done = nodes.join(behind, same, "left_anti").select("conv_id", "id", F.lit(0).alias("level"))
    if edges.limit(1).count() == 0:
        return done
    # each round writes the calls that it reached and the dependencies that it met, once; earlier rounds are only read
    last, met = materialize(done, "levels"), None
    every = last
    while last.limit(1).count():
        at = last.select(F.col("conv_id").alias("dc"), F.col("id").alias("d"), F.col("level").alias("below"))
        now = materialize(edges.join(at, F.col("conv_id").eqNullSafe(F.col("dc")) & (F.col("need") == F.col("d"))).groupBy("conv_id", "id").agg(F.count("*").alias("met"), (F.max("below") + 1).alias("level")), "met")
        met = now if met is None else met.union(now)
        touched = now.select(F.col("conv_id").alias("tc"), F.col("id").alias("t"))
        sums = met.join(touched, F.col("conv_id").eqNullSafe(F.col("tc")) & (F.col("id") == F.col("t")), "left_semi").groupBy("conv_id", "id").agg(F.sum("met").alias("met"), F.max("level").alias("level"))
        last = materialize(sums.join(behind, same & (F.col("met") == F.col("n"))).select("conv_id", "id", "level"), "levels")
        every = every.union(last)
    return every


def _fits(kinds: Column, value: Column) -> Column:
    """Whether a value is of one of the named types; unknown names fit all."""
    found = F.schema_of_variant(value)
    return F.exists(kinds, lambda k: F.coalesce(*[F.when(k == name, found.rlike(f"^({pattern})$")) for name, pattern in TYPES.items()], F.lit(True)))


def _faults(schema: Column, value: Column, path: Column) -> Column:
    """What is wrong with one value by its own schema, children left out."""
    name = F.when(path == "", F.lit("$")).otherwise(path)
    text = F.to_json(value)
    number, size = _get(value, "$", "double"), F.length(F.when(F.schema_of_variant(value) == "STRING", _get(value, "$", "string")))
    bound = lambda key: _get(schema, f"$.{key}", "double")
    kinds = F.coalesce(_get(schema, "$.type", "array<string>"), F.array(_get(schema, "$.type", "string")))
    own = F.when(F.schema_of_variant(value).startswith("OBJECT"), F.map_keys(_get(value, "$", "map<string,variant>")))
    asked = F.array_except(F.coalesce(_get(schema, "$.required", "array<string>"), F.array().cast("array<string>")), F.coalesce(own, F.array().cast("array<string>")))
    known = F.coalesce(F.map_keys(_get(schema, "$.properties", "map<string,variant>")), F.array().cast("array<string>"))
    extra = F.when(_get(schema, "$.additionalProperties", "boolean") == F.lit(False), F.array_except(own, known))
    below = lambda keys: F.transform(F.coalesce(keys, F.array().cast("array<string>")), lambda k: F.when(path == "", k).otherwise(F.concat(path, F.lit("."), k)))
    tag = lambda code, keys: F.transform(keys, lambda k: F.concat(F.lit(code + ":"), k))
    one = lambda code, test: F.when(F.coalesce(test, F.lit(False)), F.array(F.concat(F.lit(code + ":"), name))).otherwise(F.array().cast("array<string>"))
    is_object = own.isNotNull()
    return F.concat(
        tag("missing_argument", F.when(is_object, below(asked)).otherwise(F.array().cast("array<string>"))),
        tag("unknown_argument", below(extra)),
        one("wrong_type", ~_fits(F.filter(kinds, lambda k: k.isNotNull()), value) & F.exists(kinds, lambda k: k.isNotNull())),
        one("not_in_enum", ~F.exists(_get(schema, "$.enum", "array<variant>"), lambda e: F.to_json(e) == text)),
        one("not_in_enum", F.to_json(_get(schema, "$.const", "variant")) != text),
        one("out_of_range", (number < bound("minimum")) | (number > bound("maximum")) | (size < bound("minLength")) | (size > bound("maxLength"))),
    )


def _validated(asked: DataFrame) -> DataFrame:
    """msg, pos, faults from calls with their tool's schema (msg, pos, schema, value; both JSON). Each round takes the values
    of one level and hands on their children beside their own schemas; rounds are as many as values are nested."""
    level = asked.select("msg", "pos", F.lit("").alias("path"), "schema", "value")
    found = []
    while True:
        seen = level.select("msg", "pos", "path", F.parse_json("schema").alias("s"), F.parse_json("value").alias("v"))
        s, v, path = F.col("s"), F.col("v"), F.col("path")
        kind = F.schema_of_variant(v)
        fields = F.map_entries(F.when(kind.startswith("OBJECT"), _get(v, "$", "map<string,variant>")))
        of_field = F.transform(fields, lambda e: F.struct(F.when(path == "", e["key"]).otherwise(F.concat(path, F.lit("."), e["key"])).alias("path"), F.to_json(F.element_at(_get(s, "$.properties", "map<string,variant>"), e["key"])).alias("schema"), F.to_json(e["value"]).alias("value")))
        items = F.when(kind.startswith("ARRAY"), _get(v, "$", "array<variant>"))
        of_item = F.transform(items, lambda x, i: F.struct(F.concat(path, F.lit("["), i.cast("string"), F.lit("]")).alias("path"), F.to_json(_get(s, "$.items", "variant")).alias("schema"), F.to_json(x).alias("value")))
        none = F.array().cast("array<struct<path:string,schema:string,value:string>>")
        below = F.filter(F.concat(F.coalesce(of_field, none), F.coalesce(of_item, none)), lambda c: c["schema"].isNotNull())
        done = materialize(seen.select("msg", "pos", _faults(s, v, path).alias("faults"), below.alias("below")), "checked")
        found.append(done.select("msg", "pos", F.explode("faults").alias("fault")))
        level = done.select("msg", "pos", F.explode("below").alias("b")).select("msg", "pos", "b.*")
        if level.limit(1).count() == 0:
            break
    every = found[0]
    for rows in found[1:]:
        every = every.union(rows)
    return every.groupBy("msg", "pos").agg(F.array_sort(F.collect_set("fault")).alias("faults"))  # of one call


def link_calls(chats: DataFrame) -> DataFrame:
    """One row per call: conv_id, turn, pos, id, name, arguments (JSON), level, result (JSON), errors."""
    rows = _messages(chats)
    return _linked(rows, _callers(rows)).drop("msg")


def _linked(rows: DataFrame, callers: DataFrame) -> DataFrame:
    """The rows of link_calls with the number of each call's message, msg."""
    calls = _calls(callers)
    results = rows.where("role = 'tool'").select(F.col("conv_id").alias("rc"), "turn", _get(F.col("body"), "$.tool_call_id", "string").alias("rid"), F.to_json(_get(F.col("body"), "$.content", "variant")).alias("content"))
    results = results.where("rid is not null").groupBy("rc", "rid").agg(F.min_by(F.struct("turn", "content"), F.when(F.col("turn").isNotNull(), F.struct("turn", "content"))).alias("r"))
    firsts = calls.where("id is not null").groupBy(F.col("conv_id").alias("fc"), F.col("id").alias("f")).agg(F.min("place").alias("first"), F.count("*").alias("times"))
    levels = _levels(calls).select(F.col("conv_id").alias("lc"), F.col("id").alias("l"), "level")
    schemas = _schemas(rows).select(F.col("conv_id").alias("sc"), F.col("name").alias("s"), "schema")
    by = lambda c, i: F.col("conv_id").eqNullSafe(F.col(c)) & (F.col("id") == F.col(i))
    out = calls.join(firsts, by("fc", "f"), "left").join(levels, by("lc", "l"), "left").join(results, by("rc", "rid"), "left")
    tool = calls.join(schemas, F.col("conv_id").eqNullSafe(F.col("sc")) & (F.col("name") == F.col("s")))
    value = F.when(F.schema_of_variant(F.col("args")).startswith("OBJECT"), F.to_json("args"))
    tool = materialize(tool.select("msg", "pos", "schema", F.coalesce(value, F.lit("{}")).alias("value")), "asked")
    faults = _validated(tool).select(F.col("msg").alias("fm"), F.col("pos").alias("fp"), "faults")
    known = tool.select(F.col("msg").alias("tm"), F.col("pos").alias("tp"))
    out = out.join(known, (F.col("msg") == F.col("tm")) & (F.col("pos") == F.col("tp")), "left").join(faults, (F.col("msg") == F.col("fm")) & (F.col("pos") == F.col("fp")), "left")
    repeat = (F.col("times") > 1) & ((F.col("msg") != F.col("first.msg")) | (F.col("pos") != F.col("first.pos")))
    one = lambda test, name: F.when(F.coalesce(test, F.lit(False)), F.array(F.lit(name))).otherwise(F.array().cast("array<string>"))
    errors = F.concat(
        one(F.col("level").isNull() & F.col("id").isNotNull(), "circular_dependency"),
        one(repeat, "duplicate_id"),
        one(F.col("id").isNull(), "no_id"),
        one(F.col("r").isNull() | repeat, "no_result"),
        one(F.col("r.turn") < F.col("turn"), "result_before_call"),
        one(F.col("tm").isNull(), "unknown_tool"),
        F.coalesce("faults", F.array().cast("array<string>")),
    )
    errors = F.array_sort(errors)
    result = F.when(~F.coalesce(repeat, F.lit(False)), F.col("r.content"))
    return out.select("msg", "conv_id", "turn", "pos", "id", "name", F.to_json("args").alias("arguments"), F.coalesce("level", F.lit(2**31 - 1)).alias("level"), result.alias("result"), errors.alias("errors"))


def _string(c: Column) -> Column:
    """A string as JSON, null as null."""
    return F.when(c.isNull(), F.lit("null")).otherwise(F.regexp_extract(F.to_json(F.struct(c.alias("v"))), r"(?s)^\{\"v\":(.*)\}$", 1))


def format_chats(chats: DataFrame) -> DataFrame:
    """One row per message: conv_id, turn, role, n_calls, n_linked, n_errors, chat_json."""
    rows = _messages(chats)
    callers = _callers(rows)
    calls = _linked(rows, callers)
    listed = F.concat(F.lit("["), F.concat_ws(",", F.transform("errors", _string)), F.lit("]"))
    whole = F.concat(F.lit('{"arguments":'), F.coalesce("arguments", F.lit("null")), F.lit(',"errors":'), listed, F.lit(',"id":'), _string(F.col("id")), F.lit(',"name":'), _string(F.col("name")), F.lit(',"result":'), F.coalesce("result", F.lit("null")), F.lit("}"))
    each = calls.select("msg", "result", "errors", F.struct("level", "pos", whole.alias("j")).alias("call"))
    each = each.groupBy("msg").agg(F.array_sort(F.collect_list("call")).alias("calls"), F.count("*").alias("n"), F.count("result").alias("linked"), F.sum(F.size("errors")).alias("bad"))  # the calls of one message
    plain = rows.where(~_holds())
    joined = callers.join(each, "msg", "left")
    none = plain.select("*", F.lit(None).cast("array<struct<level:int,pos:int,j:string>>").alias("calls"), *[F.lit(0).cast("long").alias(c) for c in ("n", "linked", "bad")])
    both = joined.select(none.columns).union(none)
    content = F.when(_get(F.col("body"), "$.tool_call_id", "string").isNotNull() & (F.col("role") == "tool"), F.coalesce(F.to_json(_get(F.col("body"), "$.content", "variant")), F.lit("null")))
    content = content.when(F.size("calls") > 0, _string(_get(F.col("body"), "$.content", "string"))).otherwise(_string(F.col("text")))
    named = F.when((F.col("role") == "tool") & _get(F.col("body"), "$.tool_call_id", "string").isNotNull(), F.concat(F.lit(',"tool_call_id":'), _string(_get(F.col("body"), "$.tool_call_id", "string")))).otherwise("")
    within = F.when(F.size("calls") > 0, F.concat(F.lit(',"tool_calls":['), F.concat_ws(",", F.transform("calls", lambda c: c["j"])), F.lit("]"))).otherwise("")
    chat = F.concat(F.lit('{"content":'), content, F.lit(',"role":'), _string(F.col("role")), named, within, F.lit(',"turn":'), F.coalesce(F.col("turn").cast("string"), F.lit("null")), F.lit("}"))
    return both.select("conv_id", "turn", "role", F.coalesce("n", F.lit(0)).alias("n_calls"), F.coalesce("linked", F.lit(0)).alias("n_linked"), F.coalesce("bad", F.lit(0)).alias("n_errors"), chat.alias("chat_json"))
