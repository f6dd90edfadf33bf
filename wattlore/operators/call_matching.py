"""Predicted calls against gold calls: greedy assignment as a fold over arrays, parameters compared as VARIANT. No Python per row."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .chat_records import _elements, _is, _members

CALLS = "array<struct<name:string,arguments:string>>"


def _same(a: Column, b: Column) -> Column:
    """Whether two VARIANTs say the same: numbers to 1e-6, lists as multisets, texts by half of their words or containment, others exactly."""
    both = lambda kind: _is(a, kind) & _is(b, kind)
    as_ = lambda v, kind, to: F.when(_is(v, kind), v.cast(to))
    listed = lambda v: F.array_sort(F.transform(_elements(v), lambda x: F.coalesce(F.when(_is(x, "array") | _is(x, "object"), F.to_json(x)).otherwise(F.try_variant_get(x, "$", "string")), F.lit("null"))))
    x, y = as_(a, "string", "string"), as_(b, "string", "string")
    words = lambda s: F.array_distinct(F.regexp_extract_all(F.lower(s), F.lit(r"(?U)\w+"), F.lit(0)))
    wx, wy = words(x), words(y)
    near = (F.size(wx) > 0) & (F.size(wy) > 0) & (F.contains(x, y) | F.contains(y, x) | (2 * F.size(F.array_intersect(wx, wy)) >= F.size(F.array_union(wx, wy))))
    exact = F.to_json(a) == F.to_json(b)
    strip = lambda s: F.regexp_replace(s, r"(?U)^\s+|\s+\z", "")
    return F.coalesce(
        F.when(both("number"), F.abs(as_(a, "number", "double") - as_(b, "number", "double")) <= 1e-6).when(both("array"), listed(a) == listed(b)).when(both("string"), (strip(x) == strip(y)) | near)
        .when(F.is_variant_null(a) | F.is_variant_null(b), F.is_variant_null(a) & F.is_variant_null(b)).otherwise(exact), F.lit(False),
    )


def params_match(gold: Column, pred: Column) -> Column:
    """Share of the gold call's parameters (maps of VARIANTs) that the prediction has; 1 without parameters, 0 where either is no object."""
    hits = F.size(F.filter(F.map_keys(gold), lambda k: F.map_contains_key(pred, k) & _same(F.try_element_at(gold, k), F.try_element_at(pred, k))))
    return F.when(gold.isNull() | pred.isNull(), 0.0).when(F.size(gold) == 0, 1.0).otherwise(hits / F.size(gold))


def _parsed(calls: Column) -> Column:
    """Calls with their arguments as maps; null arguments count as none."""
    given = lambda c: F.when(F.coalesce(c["arguments"], F.lit("")) == "", F.lit("{}")).otherwise(c["arguments"])
    return F.transform(F.coalesce(calls, F.array().cast(CALLS)), lambda c: F.struct(c["name"].alias("name"), _members(F.try_parse_json(given(c))).alias("members")))


def shares(gold: Column, pred: Column) -> Column:
    """For each gold call the parameter share of the best predicted call of its tool that is still free; the first on ties; 0 if none is left.

    gold, pred: arrays of (name, arguments). The fold carries the predicted calls, parsed once, the places that are taken and the shares so far.
    """
    def step(acc: Column, g: Column) -> Column:
        free = F.transform(acc["known"], lambda p, i: F.when((p["name"] == g["name"]) & ~F.array_contains(acc["used"], i), F.struct(params_match(g["members"], p["members"]).alias("share"), (-i).alias("place"))))
        best = F.array_max(F.array_compact(free))
        used = F.when(best.isNull(), acc["used"]).otherwise(F.concat(acc["used"], F.array(-best["place"])))
        return F.struct(acc["known"].alias("known"), used.alias("used"), F.concat(acc["shares"], F.array(F.coalesce(best["share"], F.lit(0.0)))).alias("shares"))

    start = F.struct(_parsed(pred).alias("known"), F.array().cast("array<int>").alias("used"), F.array().cast("array<double>").alias("shares"))
    return F.aggregate(_parsed(gold), start, step, lambda acc: acc["shares"])
