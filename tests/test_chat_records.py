"""Chat records: every format, every code, arguments against a plain checker, and several builds of one plan in a session."""

import json
import random

import pytest

from wattlore.operators import chat_records

MESSAGES = "array<struct<role:string,text:string,tool_calls:array<struct<name:string,arguments:string>>>>"


def samples(spark):
    m = [("system", "be kind", None), ("user", "q", None), ("assistant", None, [("look", '{"q":1}'), ("find", "{")]), ("tool", "r1", None), ("tool", "r2", None), ("assistant", "so", [("look", None)]), ("tool", "r3", None)]
    tools = json.dumps([{"type": "function", "function": {"name": n}} for n in ("look", "find")])
    return spark.createDataFrame([(1, m, "done", "train", tools, "x"), (2, m[1:2], "a", "dev", None, "y"), (3, m[1:2], "a", "test", None, "z")], f"k int, messages {MESSAGES}, target string, split string, tools string, meta string")


def records(spark, fmt):
    return {r.k: json.loads(r.record) for r in chat_records.export_chat(samples(spark), fmt).collect()}


def test_messages_format(spark):
    got = records(spark, "messages")
    assert set(got) == {1, 2} and set(got[1]) == {"messages", "tools"} and got[2] == {"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "a"}]}
    m = got[1]["messages"]
    assert [x["role"] for x in m] == ["system", "user", "assistant", "tool", "tool", "assistant", "tool", "assistant"]
    assert m[2]["tool_calls"] == [{"id": "call_1", "type": "function", "function": {"name": "look", "arguments": '{"q":1}'}}, {"id": "call_2", "type": "function", "function": {"name": "find", "arguments": "{"}}]
    assert [x.get("tool_call_id") for x in m[3:7]] == ["call_1", "call_2", None, "call_3"] and m[5]["tool_calls"][0]["function"]["arguments"] == "{}" and m[-1] == {"role": "assistant", "content": "done"}


def test_conversations_and_text_formats(spark):
    got = records(spark, "conversations")[1]
    assert got["system"] == "be kind" and [t["from"] for t in got["conversations"]] == ["human", "function_call", "observation", "observation", "function_call", "observation", "gpt"]
    assert json.loads(got["conversations"][1]["value"]) == [{"name": "look", "arguments": {"q": 1}}, {"name": "find", "arguments": "{"}] and json.loads(got["conversations"][4]["value"]) == {"name": "look", "arguments": {}}
    assert json.loads(got["tools"]) == [{"name": "look"}, {"name": "find"}]
    assert records(spark, "text")[1] == {"messages": [{"role": "system", "content": "be kind"}, {"role": "user", "content": "q"}, {"role": "assistant", "content": "done"}]}
    with pytest.raises(ValueError):
        chat_records.export_chat(samples(spark), "other")


U, A = {"role": "user", "content": "q"}, {"role": "assistant", "content": "a"}
CALL = {"id": "1", "type": "function", "function": {"name": "f", "arguments": "{}"}}


def calls(*cs, **more):
    return {"role": "assistant", "content": "", "tool_calls": list(cs), **more}


def result(i):
    return {"role": "tool", "tool_call_id": i, "content": "r"}


CODES = [
    ([U, A], []), ([U], ["no_messages"]), ([A, U], ["bad_first", "last_not_assistant"]), ([{"role": "system", "content": "s"}, A], ["no_user"]), ([U, {"role": "x"}, A], ["bad_role"]), ([U, "text", A], ["bad_role"]), ([U, A | {"name": "n"}], ["extra_field"]),
    ([U, A | {"content": 3}], ["bad_content"]), ([U, A | {"content": None}], ["bad_content"]), ([U | {"content": ""}, A], ["empty_content"]), ([U, {"role": "assistant"}], ["empty_answer"]), ([U, calls()], ["bad_calls"]), ([U, calls() | {"tool_calls": {}}], ["bad_calls"]),
    ([U, calls() | {"tool_calls": None}, A], ["empty_answer"]), ([U, calls(CALL), result("1"), A], []), ([U, calls(CALL | {"id": ""}), A], ["no_id"]), ([U, calls(CALL, CALL), result("1"), A], ["repeated_id"]), ([U, calls(CALL | {"type": "x"}), A], ["bad_type"]),
    ([U, calls(CALL | {"function": {"name": "g", "arguments": "{}"}}), A], ["unknown_function"]), ([U, calls(CALL | {"function": {"name": "f", "arguments": "{"}}), A], ["bad_arguments"]), ([U, calls(CALL | {"function": {"name": "f", "arguments": {}}}), A], ["bad_arguments"]),
    ([U, calls(CALL), {"role": "tool", "content": "r"}, A], ["no_result_id"]), ([U, calls(CALL), result("2"), A], ["unmatched_id"]), ([U, calls(CALL), result("1"), result("1"), A], ["bad_order", "unmatched_id"]), ([U, calls(CALL), U, result("1"), A], ["bad_order"]),
    ([U, calls(CALL), A, result("1"), A], ["bad_order", "unmatched_id"]),
]


def test_every_code(spark):
    rows = [(k, json.dumps({"messages": m})) for k, (m, _) in enumerate(CODES)] + [(90, "{"), (91, None), (92, "[]"), (93, "{}"), (94, json.dumps({"messages": [U, U], "chosen": "x", "id": 1})), (95, "")]
    df = spark.createDataFrame(rows, "k int, record string")
    got = {r.k: r.errors for r in chat_records.validate_chat(df, tools=["f"]).collect()}
    assert got == {k: v for k, (_, v) in enumerate(CODES)} | {90: ["invalid_json"], 91: ["invalid_json"], 92: ["invalid_json"], 93: ["no_messages"], 94: ["extra_field"], 95: ["invalid_json"]}
    totals = {r.code: r.records for r in chat_records.chat_totals(chat_records.validate_chat(df, tools=["f"])).collect()}
    assert totals["ok"] == 2 and totals["invalid_json"] == 4


def test_names_of_the_records_own_tools(spark):
    record = {"messages": [U, calls(CALL, CALL | {"id": "2", "function": {"name": "g", "arguments": "1"}}), A], "tools": [{"type": "function", "function": {"name": "f"}}, {"type": "other", "function": {"name": "g"}}]}
    df = spark.createDataFrame([(json.dumps(record),), (json.dumps({**record, "tools": []}),)], "record string")
    assert [r.errors for r in chat_records.validate_chat(df).collect()] == [["unknown_function"], []]


def test_export_and_check_can_be_built_again(spark):
    for _ in range(3):
        out = chat_records.validate_chat(chat_records.export_chat(samples(spark)), tools=["look", "find"])
        assert {r.k: r.errors for r in out.collect()} == {1: ["bad_arguments"], 2: []}
        assert "python" not in out._jdf.queryExecution().optimizedPlan().toString().lower()


SCHEMA = {
    "t": {"required": ["q", "n"], "properties": {"q": {"type": "string"}, "n": {"type": "integer"}, "x": {"type": "number", "enum": [1, 2.5]}, "m": {"type": "string", "enum": ["a", "b"]}, "l": {"type": "array", "items": {"type": "string", "enum": ["a", "b"]}}, "o": {"type": "object"}, "f": {"type": "boolean"}, "any": {}}},
    "bare": {},
}


def plain_arguments(tool, args):
    fits = {"string": lambda v: isinstance(v, str), "integer": lambda v: isinstance(v, int) and not isinstance(v, bool), "number": lambda v: isinstance(v, (int, float)) and not isinstance(v, bool), "boolean": lambda v: isinstance(v, bool), "array": lambda v: isinstance(v, list), "object": lambda v: isinstance(v, dict)}
    if tool not in SCHEMA:
        return {("", "unknown_tool")}
    props = SCHEMA[tool].get("properties", {})
    out = {(f, "missing_required") for f in SCHEMA[tool].get("required", []) if args.get(f) is None}
    for f, v in args.items():
        rule = props.get(f)
        if rule is None:
            out.add((f, "unknown_field"))
        elif v is not None:
            if not fits.get(rule.get("type"), lambda _: True)(v):
                out.add((f, "type_mismatch"))
                continue
            if "enum" in rule and v not in rule["enum"]:
                out.add((f, "invalid_enum"))
            item = rule.get("items", {})
            if item and not all(map(fits[item["type"]], v)):
                out.add((f, "invalid_item_type"))
            if item and any(x not in item["enum"] for x in v):
                out.add((f, "invalid_item_enum"))
    return out


def test_arguments_against_a_plain_checker(spark):
    rng = random.Random(1)
    values = ["a", "z", "", 1, 2.5, -3, 10**20, 1.5e300, True, None, [], ["a"], ["a", 1], ["z"], {}, {"a": 1}]
    rows = [(k, rng.choice(["t", "t", "t", "bare", "no", None]), json.dumps({f: rng.choice(values) for f in rng.sample([*SCHEMA["t"]["properties"], "zz"], rng.randrange(9))})) for k in range(400)]
    df = spark.createDataFrame(rows, "k int, tool string, args string")
    for r in chat_records.validate_arguments(df, "tool", "args", SCHEMA).collect():
        assert {(e.field, e.code) for e in r.errors} == plain_arguments(r.tool, json.loads(r.args)), r
    odd = spark.createDataFrame([("t", x) for x in ("[]", "{", "3")] + [("bare", None), ("bare", " ")], "tool string, args string")
    assert [[e.code for e in r.errors] for r in chat_records.validate_arguments(odd, "tool", "args", SCHEMA).collect()] == [["invalid_json"]] * 3 + [[], []]
