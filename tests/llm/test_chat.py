"""Chat formatting: links, order, validation and canonical JSON."""

import json
import random

from tracewright.llm import chat

TOOLS = {"tools": [{"name": "add", "parameters": {"properties": {"a": {"type": "integer"}, "b": {"type": "number"}, "s": {"type": "string"}}, "required": ["a"]}}, {"name": "plain"}]}


def call(i, name="add", args=None, needs=()):
    return {"id": i, "name": name, "arguments": {"a": 1} if args is None else args, "depends_on": list(needs)}


def frame(spark, rows):
    return spark.createDataFrame([(c, t, r, x if isinstance(x, str) or x is None else json.dumps(x), "e") for c, t, r, x in rows], "conv_id long, turn long, role string, text string, errors string")


def test_links_order_and_errors(spark):
    rows = [
        (1, 0, "system", TOOLS),
        (1, 1, "assistant", {"content": "hm", "tool_calls": [call("c", needs=["b"]), call("b", needs=["a"]), call("a")]}),
        (1, 2, "tool", {"tool_call_id": "a", "content": {"z": 1, "y": [True, None]}}),
        (1, 3, "tool", {"tool_call_id": "b", "content": "ok"}),
        (1, 4, "assistant", {"tool_calls": [call("x", needs=["y"]), call("y", needs=["x"]), call(None), call("a"), call("t", args={"a": "no", "s": 3}), call("m", args={}), call("u", name="none")]}),
        (2, 5, "tool", {"tool_call_id": "late", "content": 1}),
        (2, 6, "assistant", {"tool_calls": [call("late", name="plain", args='{"q":1}')]}),
    ]
    got = {(r["conv_id"], r["turn"], r["pos"]): r for r in chat.link_calls(frame(spark, rows)).collect()}
    assert [got[1, 1, p]["level"] for p in (0, 1, 2)] == [2, 1, 0]
    assert json.loads(got[1, 1, 2]["result"]) == {"z": 1, "y": [True, None]}
    assert got[1, 1, 0]["errors"] == ["no_result"]
    assert got[1, 1, 2]["errors"] == [] and got[1, 1, 1]["errors"] == []
    assert got[1, 4, 0]["errors"][0] == "circular_dependency" and got[1, 4, 1]["errors"][0] == "circular_dependency"
    assert "no_id" in got[1, 4, 2]["errors"]
    assert got[1, 4, 3]["errors"][0] == "duplicate_id" and got[1, 4, 3]["result"] is None
    assert got[1, 4, 4]["errors"][-2:] == ["wrong_type:a", "wrong_type:s"]
    assert "missing_argument:a" in got[1, 4, 5]["errors"] and "unknown_tool" in got[1, 4, 6]["errors"]
    assert got[2, 6, 0]["errors"] == ["result_before_call", "unknown_tool"]
    assert got[1, 4, 2]["errors"] == ["no_id", "no_result"]
    whole = chat.format_chats(frame(spark, rows))
    line = {(r["conv_id"], r["turn"]): r for r in whole.collect()}
    made = json.loads(line[1, 1]["chat_json"])
    assert [c["id"] for c in made["tool_calls"]] == ["a", "b", "c"]
    assert list(made) == sorted(made) and '": ' not in line[1, 1]["chat_json"]
    assert (line[1, 1]["n_calls"], line[1, 1]["n_linked"], line[1, 1]["n_errors"]) == (3, 2, 1)
    assert json.loads(line[1, 2]["chat_json"])["tool_call_id"] == "a"


def test_plain_rows(spark):
    rows = [(None, None, None, None), (3, 1, "user", 'say "hi"\n{'), (3, 2, "assistant", "{broken"), (3, 3, "user", ""), (3, 3, "user", "")]
    got = [r for r in chat.format_chats(frame(spark, rows)).collect()]
    assert len(got) == 5
    texts = sorted(json.loads(r["chat_json"])["content"] or "" for r in got)
    assert texts == sorted(["", 'say "hi"\n{', "{broken", "", ""])
    assert all(r["n_calls"] == 0 for r in got)
    assert chat.format_chats(frame(spark, rows).where("false")).count() == 0


def test_many_messages_of_one_conversation(spark):
    rows = [(1, t, "user", f"m{t}") for t in range(3000)] + [(1, 3000, "assistant", {"tool_calls": [call(f"k{i}", needs=[f"k{i-1}"] if i else []) for i in range(6)]})]
    got = chat.format_chats(frame(spark, rows))
    assert got.count() == 3001
    assert got.where("turn = 3000").first()["n_calls"] == 6


def test_no_python_in_plan(spark, small):
    df = chat.format_chats(spark.read.parquet(f"{small}/conversations.parquet"))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not any(w in plan for w in ("Python", "Arrow", "Pandas"))


def test_repeated_and_tied_rows_with_calls(spark):
    """Each row is a message of its own: its calls are not those of rows that share its conversation and turn."""
    twice = (1, 1, "assistant", {"tool_calls": [call("a"), call("b")]})
    rows = [
        (1, 0, "system", TOOLS), twice, twice, (1, 1, "assistant", {"tool_calls": [call("c")]}),
        (1, 2, "tool", {"tool_call_id": "a", "content": 1}),
        (None, None, "assistant", {"tool_calls": [call("x")]}), (None, None, "assistant", {"tool_calls": [call("y"), call("z")]}),
    ]
    got = [r for r in chat.format_chats(frame(spark, rows)).collect() if r["n_calls"]]
    made = sorted([c["id"] for c in json.loads(r["chat_json"])["tool_calls"]] for r in got)
    assert made == [["a", "b"], ["a", "b"], ["c"], ["x"], ["y", "z"]]
    assert sorted(r["n_calls"] for r in got) == [1, 1, 2, 2, 2] and sum(r["n_linked"] for r in got) == 1
    links = chat.link_calls(frame(spark, rows)).where("id = 'a'").collect()
    assert sorted("duplicate_id" in r["errors"] for r in links) == [False, True]


def plain_faults(schema, value, path=""):
    """The schema check as plain recursion."""
    kinds = {"string": str, "integer": int, "number": (int, float), "boolean": bool, "array": list, "object": dict, "null": type(None)}
    name, out = path or "$", []
    below = lambda k: f"{path}.{k}" if path else k
    asked = schema.get("type")
    asked = asked if isinstance(asked, list) else [asked] if asked else []
    fits = lambda k: k not in kinds or (isinstance(value, kinds[k]) and (k == "boolean" or not isinstance(value, bool)))
    if asked and not any(fits(k) for k in asked):
        out.append(f"wrong_type:{name}")
    text = json.dumps(value, separators=(",", ":"))
    if "enum" in schema and text not in [json.dumps(e, separators=(",", ":")) for e in schema["enum"]]:
        out.append(f"not_in_enum:{name}")
    number = value if isinstance(value, (int, float)) and not isinstance(value, bool) else None
    if number is not None and (number < schema.get("minimum", number) or number > schema.get("maximum", number)):
        out.append(f"out_of_range:{name}")
    if isinstance(value, str) and not schema.get("minLength", 0) <= len(value) <= schema.get("maxLength", 99):
        out.append(f"out_of_range:{name}")
    if isinstance(value, dict):
        own = schema.get("properties", {})
        out += [f"missing_argument:{below(k)}" for k in schema.get("required", []) if k not in value]
        if schema.get("additionalProperties") is False:
            out += [f"unknown_argument:{below(k)}" for k in value if k not in own]
        for k, v in value.items():
            if k in own:
                out += plain_faults(own[k], v, below(k))
    if isinstance(value, list) and "items" in schema:
        for i, v in enumerate(value):
            out += plain_faults(schema["items"], v, f"{path}[{i}]")
    return out


def plain_links(rows):
    """Per conversation, turn and place: level, linked, errors; rows have turns of their own."""
    tools, calls, results, out = {}, {}, {}, {}
    for c, t, role, x in rows:
        if role == "system" and isinstance(x, dict):
            for tool in x.get("tools", []):
                tools.setdefault((c, tool["name"]), tool.get("parameters", {}))
        if role == "tool" and isinstance(x, dict) and "tool_call_id" in x:
            results.setdefault((c, x["tool_call_id"]), t)
        if role == "assistant" and isinstance(x, dict):
            for k, one in enumerate(x.get("tool_calls", [])):
                if one["id"] is not None:
                    calls.setdefault((c, one["id"]), (t, k, one))

    levels = {}
    while True:
        new = {}
        for (c, i), (_, _, one) in calls.items():
            needs = [(c, n) for n in one["depends_on"] if (c, n) in calls]
            if (c, i) not in levels and all(n in levels for n in needs):
                new[c, i] = max((levels[n] + 1 for n in needs), default=0)
        if not new:
            break
        levels |= new
    for c, t, role, x in rows:
        if role != "assistant" or not isinstance(x, dict):
            continue
        for k, one in enumerate(x.get("tool_calls", [])):
            i, errors = one["id"], []
            first = i is not None and calls[c, i][:2] == (t, k)
            linked = i is not None and first and (c, i) in results
            if i is None:
                errors.append("no_id")
            elif (c, i) not in levels:
                errors.append("circular_dependency")
            if i is not None and not first:
                errors.append("duplicate_id")
            if not linked:
                errors.append("no_result")
            if i is not None and (c, i) in results and results[c, i] < t:
                errors.append("result_before_call")
            if (c, one["name"]) in tools:
                errors += set(plain_faults(tools[c, one["name"]], one["arguments"]))
            else:
                errors.append("unknown_tool")
            out[c, t, k] = (levels.get((c, i), 2**31 - 1), linked, sorted(errors))
    return out


def test_calls_against_plain_version(spark):
    rng = random.Random(4)
    schema = {"type": "object", "required": ["a"], "additionalProperties": False, "properties": {
        "a": {"type": ["integer", "null"], "minimum": 0}, "s": {"type": "string", "maxLength": 3, "enum": ["x", "yy", "toolong"]},
        "o": {"type": "object", "required": ["in"], "properties": {"in": {"type": "array", "items": {"type": "number", "maximum": 9}}}}}}
    value = lambda: rng.choice([1, -2, None, "x", "toolong", True, 2.5, [], {"in": [1, 99, "q"]}, {"in": 3}, {}])
    rows = []
    for c in range(25):
        ids = [f"k{i}" for i in range(6)]
        rows.append((c, 0, "system", {"tools": [{"name": "f", "parameters": schema}, {"name": "g"}]}))
        for t in range(1, 12):
            if rng.random() < 0.5:
                made = [call(rng.choice([*ids, None]), rng.choice("ffgh"), {k: value() for k in rng.sample(["a", "s", "o", "z"], rng.randrange(4))}, rng.sample(ids, rng.randrange(3))) for _ in range(rng.randrange(1, 3))]
                rows.append((c, t, "assistant", {"content": "c", "tool_calls": made}))
            else:
                rows.append((c, t, "tool", {"tool_call_id": rng.choice(ids), "content": rng.choice([1, "r", {"b": 1, "a": 2}])}))
    want = plain_links(rows)
    got = {(r["conv_id"], r["turn"], r["pos"]): (r["level"], r["result"] is not None, r["errors"]) for r in chat.link_calls(frame(spark, rows)).collect()}
    assert got == want
    assert len({e.split(":")[0] for _, _, errors in want.values() for e in errors}) == 11


def test_long_chain_of_calls(spark):
    made = [call(f"k{i}", needs=[f"k{i-1}"] if i else []) for i in range(12)]
    got = chat.link_calls(frame(spark, [(1, 0, "assistant", {"tool_calls": made})])).collect()
    assert sorted((r["pos"], r["level"]) for r in got) == [(i, i) for i in range(12)]
