"""Tool arguments against a schema, chat records written and checked: column expressions over VARIANT, no Python per row."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

ERRORS = "array<struct<field:string,code:string>>"
ROLES = ("system", "user", "assistant", "tool")
#: Fields that a record and each role's messages may have.
RECORD_FIELDS = ("messages", "tools", "chosen", "rejected")
FIELDS = {"system": ("role", "content"), "user": ("role", "content"), "assistant": ("role", "content", "tool_calls"), "tool": ("role", "content", "tool_call_id")}
#: JSON types as VARIANT says them.
KINDS = {"string": "STRING", "number": "BIGINT|DOUBLE|FLOAT|DECIMAL", "integer": r"BIGINT|DECIMAL\(\d+,0\)", "boolean": "BOOLEAN", "array": "ARRAY<", "object": "OBJECT<"}


def _kind(v: Column) -> Column:
    return F.schema_of_variant(v)


def _is(v: Column, kind: str | None) -> Column:
    """Whether a VARIANT is of a JSON type; any is of a type that has no name here."""
    return _kind(v).rlike(f"^(?:{KINDS[kind]})") if kind in KINDS else F.lit(True)


def _members(v: Column) -> Column:
    return F.when(_is(v, "object"), v.cast("map<string,variant>"))


def _elements(v: Column) -> Column:
    return F.when(_is(v, "array"), v.cast("array<variant>"))


def _text(v: Column) -> Column:
    return F.when(_is(v, "string"), v.cast("string"))


def _listed(v: Column, values: Sequence) -> Column:
    """Whether a VARIANT is one of some stated scalars."""
    strings, flags = [x for x in values if isinstance(x, str)], [x for x in values if isinstance(x, bool)]
    numbers = [float(x) for x in values if isinstance(x, (int, float)) and not isinstance(x, bool)]
    parts = [(strings, "string", "string"), (numbers, "number", "double"), (flags, "boolean", "boolean")]
    return reduce(lambda a, p: a | (_is(v, p[1]) & F.when(_is(v, p[1]), v.cast(p[2])).isin(*p[0])) if p[0] else a, parts, F.lit(False))


def _field_errors(members: Column, field: str, rule: Mapping) -> list[Column]:
    v = F.try_element_at(members, F.lit(field))
    given = v.isNotNull() & ~F.is_variant_null(v)
    error = lambda on, code: F.when(on, F.struct(F.lit(field).alias("field"), F.lit(code).alias("code")))
    fits = _is(v, rule.get("type"))
    out = [error(given & ~fits, "type_mismatch")]
    if rule.get("enum"):
        out.append(error(given & fits & ~_listed(v, rule["enum"]), "invalid_enum"))
    item = rule.get("items") or {}
    if item.get("type") in KINDS:
        out.append(error(given & fits & F.exists(_elements(v), lambda x: ~_is(x, item["type"])), "invalid_item_type"))
    if item.get("enum"):
        out.append(error(given & fits & F.exists(_elements(v), lambda x: ~_listed(x, item["enum"])), "invalid_item_enum"))
    return out


def argument_errors(tool: Column, members: Column, schema: Mapping[str, dict]) -> Column:
    """The schema of every tool as one expression over the map of given arguments; null members: no JSON object."""
    one = lambda field, code: F.array(F.struct(F.lit(field).alias("field"), F.lit(code).alias("code")))
    out = F.when(tool.isNull() | ~tool.isin(*schema), one("", "unknown_tool")).when(members.isNull(), one("", "invalid_json"))
    for name, spec in schema.items():
        props, checks = spec.get("properties", {}), []
        for field in spec.get("required") or []:
            v = F.try_element_at(members, F.lit(field))
            checks.append(F.when(v.isNull() | F.is_variant_null(v), F.struct(F.lit(field).alias("field"), F.lit("missing_required").alias("code"))))
        for field, rule in props.items():
            checks += _field_errors(members, field, rule)
        unknown = F.transform(F.array_sort(F.filter(F.map_keys(members), lambda k: ~k.isin(*props) if props else F.lit(True))), lambda k: F.struct(k.alias("field"), F.lit("unknown_field").alias("code")))
        out = out.when(tool == name, F.concat(F.array_compact(F.array(*checks)).cast(ERRORS) if checks else F.array().cast(ERRORS), unknown))
    return out


def validate_arguments(df: DataFrame, tool: str, args: str, schema: Mapping[str, dict]) -> DataFrame:
    """Add errors (field, code) of JSON arguments against the stated schema of tools (properties with type, enum and items; required).

    Codes: unknown_tool, invalid_json (anything but an object; nothing counts as an empty one), missing_required, type_mismatch,
    invalid_enum, invalid_item_type, invalid_item_enum, unknown_field. A boolean is no number; null stands for no value.
    """
    given = F.when(F.coalesce(F.trim(args), F.lit("")) == "", F.lit("{}")).otherwise(F.col(args))
    rows = df.withColumn("_members", _members(F.try_parse_json(given)))
    return rows.withColumn("errors", argument_errors(F.col(tool), F.col("_members"), schema)).drop("_members")


# ---- writing ------------------------------------------------------------------------------------------------------------

def _calls_before(every: Column) -> Column:
    """For each message the number of calls in earlier ones."""
    sizes = F.transform(every, lambda m: F.coalesce(F.size(m["tool_calls"]), F.lit(0)))
    sizes = F.transform(sizes, lambda n: F.greatest(n, F.lit(0)))
    return F.transform(sizes, lambda n, i: F.aggregate(F.slice(sizes, F.lit(1), i), F.lit(0), lambda a, x: a + x))


def _with_calls(every: Column) -> Column:
    """Messages with calls as chat records say them: running ids, arguments as text, tool results by their call's id."""
    before = _calls_before(every)
    has = lambda j: F.coalesce(F.size(every[j]["tool_calls"]), F.lit(0)) > 0
    call_id = lambda j, k: F.concat(F.lit("call_"), (F.get(before, j) + k + 1).cast("string"))

    def one(m: Column, i: Column) -> Column:
        calls = F.transform(m["tool_calls"], lambda c, k: F.struct(call_id(i, k).alias("id"), F.lit("function").alias("type"), F.struct(c["name"].alias("name"), F.coalesce(c["arguments"], F.lit("{}")).alias("arguments")).alias("function")))
        asked = F.array_max(F.filter(F.sequence(F.lit(0), i), has))  # the last message with calls; a result's place after it tells which
        own = F.when(m["role"] == "tool", call_id(asked, i - asked - 1))
        return F.struct(m["role"].alias("role"), F.coalesce(m["text"], F.lit("")).alias("content"), F.when(F.size(m["tool_calls"]) > 0, calls).alias("tool_calls"), own.alias("tool_call_id"))

    return F.transform(every, one)


def _called(m: Column) -> Column:
    """A call (or a list of several) as JSON with its arguments as JSON, or as text where they are none."""
    args = lambda c: F.coalesce(F.try_parse_json(F.coalesce(c["arguments"], F.lit("{}"))), c["arguments"].cast("variant"))
    calls = F.transform(m["tool_calls"], lambda c: F.struct(c["name"].alias("name"), args(c).alias("arguments")))
    return F.when(F.size(m["tool_calls"]) == 1, F.to_json(F.get(calls, F.lit(0)))).otherwise(F.to_json(calls))


def export_chat(samples: DataFrame, fmt: str = "messages", keep_splits: Sequence[str] = ("train", "dev")) -> DataFrame:
    """Add record: JSON text of a sample, as messages, conversations or text.

    samples: messages array<struct<role, text[, tool_calls array<struct<name, arguments>>]>>, target, and perhaps split (other
    splits are left out) and tools (JSON list of functions). In messages calls get running ids and arguments as text, and the tool
    messages after them answer one call after another. In conversations the first message of a system is a field of its
    own, a call is a function_call turn with its JSON, a tool's result an observation. In text the target is the only
    message of the assistant and calls stay out. Other columns aren't part of a record.
    """
    rows = samples.filter(F.col("split").isin(*keep_splits)) if "split" in samples.columns else samples
    kind = samples.schema["messages"].dataType.elementType
    calls = "tool_calls" in kind.fieldNames()
    last = [F.lit("assistant").alias("role"), F.col("target").alias("text")]
    if calls:
        last.append(F.lit(None).cast(kind["tool_calls"].dataType).alias("tool_calls"))
    rows = rows.withColumn("_every", F.concat("messages", F.array(F.struct(*last))))
    every, said = F.col("_every"), lambda m: F.coalesce(m["text"], F.lit(""))
    tools = [F.try_parse_json("tools").alias("tools")] if "tools" in samples.columns else []
    plain = lambda ms: F.transform(ms, lambda m: F.struct(m["role"].alias("role"), said(m).alias("content")))
    if fmt == "messages":
        body = [(_with_calls(every) if calls else plain(every)).alias("messages"), *tools]
    elif fmt == "text":
        body = [plain(F.filter(every, lambda m, i: m["role"].isin("system", "user") | (i == F.size(every) - 1))).alias("messages")]
    elif fmt == "conversations":
        called = (lambda m: F.coalesce(F.size(m["tool_calls"]), F.lit(0)) > 0) if calls else (lambda m: F.lit(False))
        name = lambda m: F.when(called(m), "function_call").when(m["role"] == "user", "human").when(m["role"] == "assistant", "gpt").when(m["role"] == "tool", "observation").otherwise(m["role"])
        value = lambda m: F.when(called(m), _called(m)).otherwise(said(m)) if calls else said(m)
        system = F.get(every, F.lit(0))["role"] == "system"
        turns = F.when(system, F.slice(every, F.lit(2), F.size(every) - 1)).otherwise(every)
        body = [F.transform(turns, lambda m: F.struct(name(m).alias("from"), value(m).alias("value"))).alias("conversations"), F.when(system, said(F.get(every, F.lit(0)))).alias("system")]
        if tools:
            functions = F.transform(_elements(F.try_parse_json("tools")), lambda t: F.coalesce(F.variant_get(t, "$.function", "variant"), t))
            body.append(F.to_json(functions).alias("tools"))
    else:
        raise ValueError(f"no such format: {fmt}")
    return rows.withColumn("record", F.to_json(F.struct(*body))).drop("_every")


# ---- checking -----------------------------------------------------------------------------------------------------------

def _parsed(m: Column) -> Column:
    """What the rules ask of a message."""
    has = _members(m)
    field = lambda f: F.try_element_at(has, F.lit(f))
    content, calls = field("content"), field("tool_calls")
    calls = F.when(~F.is_variant_null(calls), calls)

    def call(c: Column) -> Column:
        own = _members(c)
        part = lambda f: F.try_element_at(own, F.lit(f))
        function = _members(part("function"))
        return F.struct(_text(part("id")).alias("id"), _text(part("type")).alias("type"), _text(F.try_element_at(function, F.lit("name"))).alias("name"), _text(F.try_element_at(function, F.lit("arguments"))).alias("arguments"))

    return F.struct(
        _text(field("role")).alias("role"), F.coalesce(F.map_keys(has), F.array().cast("array<string>")).alias("fields"), _text(content).alias("content"), (content.isNotNull() & ~_is(content, "string")).alias("odd"),
        calls.isNotNull().alias("has_calls"), F.transform(_elements(calls), call).alias("calls"), _text(field("tool_call_id")).alias("result_of"),
    )


def _message_errors(names: Column):
    """One step of the fold over a record's messages: state is open call ids, errors and the role before."""
    code = lambda on, name: F.when(F.coalesce(on, F.lit(False)), name)
    none = F.array().cast("array<string>")

    def step(acc: Column, m: Column) -> Column:
        role, calls = m["role"], F.coalesce(m["calls"], F.array().cast("array<struct<id:string,type:string,name:string,arguments:string>>"))
        legal = F.coalesce(role.isin(*ROLES), F.lit(False))
        allowed = reduce(lambda a, r: F.when(role == r, F.array(*map(F.lit, FIELDS[r]))).otherwise(a), ROLES, none)
        is_a, is_t = legal & (role == "assistant"), legal & (role == "tool")
        ids = F.filter(F.transform(calls, lambda c: c["id"]), lambda i: F.coalesce(i != "", F.lit(False)))
        answers = F.array_contains(acc["open"], m["result_of"])
        found = F.array_compact(F.array(
            code(~legal, "bad_role"), code(legal & (F.size(F.array_except(m["fields"], allowed)) > 0), "extra_field"), code(legal & m["odd"], "bad_content"),
            code(role.isin("system", "user") & (F.coalesce(m["content"], F.lit("")) == "") & ~m["odd"], "empty_content"), code(is_a & ~m["has_calls"] & (F.coalesce(m["content"], F.lit("")) == "") & ~m["odd"], "empty_answer"),
            code(is_a & m["has_calls"] & (F.size(calls) < 1), "bad_calls"), code(is_a & (F.size(ids) < F.size(calls)), "no_id"), code(is_a & (F.size(F.array_distinct(ids)) < F.size(ids)), "repeated_id"),
            code(is_a & F.exists(calls, lambda c: F.coalesce(c["type"] != "function", F.lit(True))), "bad_type"), code(is_a & names.isNotNull() & F.exists(calls, lambda c: F.coalesce(~F.array_contains(names, c["name"]), F.lit(True))), "unknown_function"),
            code(is_a & F.exists(calls, lambda c: c["arguments"].isNull() | F.try_parse_json(c["arguments"]).isNull()), "bad_arguments"), code(is_t & (F.coalesce(m["result_of"], F.lit("")) == ""), "no_result_id"),
            code(is_t & (F.coalesce(m["result_of"], F.lit("")) != "") & ~F.coalesce(answers, F.lit(False)), "unmatched_id"), code(is_t & ((F.size(acc["open"]) < 1) | ~acc["before"].isin("assistant", "tool")), "bad_order"),
        ))
        now = F.when(is_a, F.array_distinct(ids)).when(is_t & F.coalesce(answers, F.lit(False)), F.filter(acc["open"], lambda i: i != m["result_of"])).otherwise(acc["open"])
        return F.struct(now.alias("open"), F.concat(acc["errors"], found).alias("errors"), F.coalesce(role, F.lit("")).alias("before"))

    return step


def validate_chat(df: DataFrame, record: str = "record", tools: Sequence[str] | None = None) -> DataFrame:
    """Add errors: the sorted codes of what is wrong with each chat record, none if nothing is.

    Of records: invalid_json (no object), no_messages (under two), extra_field, bad_first (neither system nor user), last_not_assistant
    (unless there is a chosen answer), no_user. Of messages: bad_role, extra_field, bad_content (no text), empty_content, empty_answer (no
    content and no calls), bad_calls (no list, or an empty one). Of calls: no_id, repeated_id, bad_type, unknown_function (not among
    tools, by default the record's own), bad_arguments (not JSON as text). Of results: no_result_id, unmatched_id (no call of
    the last assistant message that is still open), bad_order (no open call, or behind another message than an assistant's or a
    tool's). The protocol is a fold over the messages of a record.
    """
    none = F.array().cast("array<string>")
    has = F.col("_has")
    rows = df.withColumn("_has", _members(F.try_parse_json(record)))
    listed = _elements(F.try_element_at(has, F.lit("messages")))
    rows = rows.withColumn("_said", F.transform(listed, _parsed))
    said = F.col("_said")
    if tools is not None:
        names = F.array(*map(F.lit, tools)).cast("array<string>")
    else:
        own = F.transform(_elements(F.try_element_at(has, F.lit("tools"))), lambda t: F.when(F.try_variant_get(t, "$.type", "string") == "function", F.try_variant_get(t, "$.function.name", "string")))
        names = F.when(F.size(F.array_compact(own)) > 0, F.array_compact(own))
    rows = rows.withColumn("_names", names)
    start = F.struct(none.alias("open"), none.alias("errors"), F.lit("").alias("before"))
    of_messages = F.aggregate(said, start, _message_errors(F.col("_names")), lambda acc: acc["errors"])
    role = lambda i: F.coalesce(F.element_at(said, i)["role"], F.lit(""))
    extra = F.when(F.size(F.array_except(F.map_keys(has), F.array(*map(F.lit, RECORD_FIELDS)))) > 0, "extra_field")
    of_record = F.array_compact(F.array(
        extra, F.when(~role(1).isin("system", "user"), "bad_first"), F.when((role(-1) != "assistant") & ~F.array_contains(F.map_keys(has), "chosen"), "last_not_assistant"), F.when(~F.exists(said, lambda m: F.coalesce(m["role"] == "user", F.lit(False))), "no_user"),
    ))
    few = F.coalesce(F.size(said) < 2, F.lit(True))
    errors = F.when(has.isNull(), F.array(F.lit("invalid_json"))).when(few, F.array_compact(F.array(extra, F.lit("no_messages")))).otherwise(F.array_sort(F.array_distinct(F.concat(of_record, of_messages))))
    return rows.withColumn("errors", errors).drop("_has", "_said", "_names")


def chat_totals(checked: DataFrame) -> DataFrame:
    """code, records: how many records have each error of validate_chat; ``ok`` for those without."""
    codes = F.when(F.size("errors") > 0, F.col("errors")).otherwise(F.array(F.lit("ok")))
    return checked.select(F.explode(codes).alias("code")).groupBy("code").agg(F.count(F.lit(1)).alias("records"))
