"""Field-by-field comparison of two tables, and leaf-by-leaf comparison of nested payloads."""

from __future__ import annotations

import json
from functools import reduce
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

TOLERANCE = 1e-9


def differences(left: DataFrame, right: DataFrame, key: str, tolerance: float = TOLERANCE) -> DataFrame:
    """key, field, left_value, right_value for each number that differs; field `row` where one side lacks the key.

    Rows are matched by key, never by position.
    """
    fields = [c for c in left.columns if c != key]
    side = lambda df, p: df.select(F.col(key).alias(f"{p}_key"), F.lit(1.0).alias(f"{p}_row"), *(F.col(c).cast("double").alias(f"{p}_{c}") for c in fields))
    j = side(left, "l").join(side(right, "r"), F.col("l_key").eqNullSafe(F.col("r_key")), "full_outer")
    j = j.withColumns({"l_row": F.coalesce("l_row", F.lit(0.0)), "r_row": F.coalesce("r_row", F.lit(0.0))})
    pairs = [F.struct(F.lit(c).alias("field"), F.col(f"l_{c}").alias("a"), F.col(f"r_{c}").alias("b")) for c in ["row", *fields]]
    each = j.select(F.coalesce("l_key", "r_key").alias(key), (F.col("l_row") == F.col("r_row")).alias("both"), F.explode(F.array(*pairs)).alias("x"))
    off = F.when(F.col("x.a").isNull() | F.col("x.b").isNull(), ~F.col("x.a").eqNullSafe(F.col("x.b"))).otherwise(F.abs(F.col("x.a") - F.col("x.b")) > tolerance)
    return each.filter(off & (F.col("both") | (F.col("x.field") == "row"))).select(key, F.col("x.field").alias("field"), F.col("x.a").alias("left_value"), F.col("x.b").alias("right_value"))


DEPTH = 8  #: of containers in containers; what is deeper is compared as text
#: of arrays, by their name: the keys that tell their elements apart. Elements of others are told apart by their position.
KEYS = {"models": ("key",), "days": ("d",), "dayModel": ("d", "key"), "hours": ("h",), "projects": ("name",), "sessionsAll": ("id",), "tools": ("name",), "raw_usage": ("rid",), "statuses": ("status",), "pricing": ("key",), "external": ("tool",), "externalDays": ("tool", "d"), "roles": ("name",), "yield": ("root",)}


def _text(value: Column) -> Column:
    """A leaf as text."""
    return F.try_variant_get(value, "$", "string")


def _element(value: Column, keys: tuple[str, ...], place: Column) -> Column:
    """What names an element: its keys, or its place (from 0) if it lacks one."""
    own = [F.try_variant_get(value, f"$.{k}", "string") for k in keys]
    return F.when(reduce(Column.__and__, (o.isNotNull() for o in own)), F.concat_ws("|", *own)).otherwise(place.cast("string")) if keys else place.cast("string")


def _named(array: Column, value: Column, place: Column, keys: dict[str, tuple[str, ...]]) -> Column:
    """_element by the array's name."""
    out = place.cast("string")
    for name, k in keys.items():
        out = F.when(array == name, _element(value, k, place)).otherwise(out)
    return out


def _below(path: Column, name: Column, value: Column, keys: dict[str, tuple[str, ...]]) -> Column:
    """What a container holds, an array of path, name and value; null where value is none."""
    array, fields = F.try_variant_get(value, "$", "array<variant>"), F.try_variant_get(value, "$", "map<string,variant>")
    elements = F.transform(array, lambda x, k: F.struct(F.concat(path, F.lit("["), _named(name, x, k, keys), F.lit("]")).alias("path"), F.lit("").alias("name"), x.alias("value")))
    members = F.transform(F.map_entries(fields), lambda x: F.struct(F.when(path == "", x["key"]).otherwise(F.concat(path, F.lit("."), x["key"])).alias("path"), x["key"].alias("name"), x["value"].alias("value")))
    return F.coalesce(elements, members)


def _closed(path: Column) -> Column:
    """How many brackets a path closes."""
    return F.length(path) - F.length(F.replace(path, F.lit("]")))


def _units(entries: DataFrame, keys: dict[str, tuple[str, ...]], cut: int) -> DataFrame:
    """Entries opened until their paths close `cut` brackets or stand for a leaf: path, name, value, and left, the levels that may still be opened."""

    def opened(path: Column, name: Column, value: Column, left: int) -> Column:
        this = F.array(F.struct(path.alias("path"), name.alias("name"), value.alias("value"), F.lit(left).alias("left")))
        if left == 0:
            return this
        below = F.flatten(F.transform(_below(path, name, value, keys), lambda x: opened(x["path"], x["name"], x["value"], left - 1)))
        return F.when(_closed(path) >= cut, this).otherwise(F.coalesce(below, this))

    named = entries.select("path", F.regexp_extract("path", r"([^.\[\]]*)(\[[^\]]*\])?$", 1).alias("name"), "value")
    return named.select(F.inline(opened(F.col("path"), F.col("name"), F.col("value"), DEPTH)))


def _leaves(unit: Column, keys: dict[str, tuple[str, ...]], side: Column | None = None) -> Column:
    """A unit's leaves that aren't null, an array of path, side and value."""
    side = F.lit(0) if side is None else side

    def leaf(path: Column, value: Column, text: Column) -> Column:
        return F.when(value.isNotNull() & ~F.is_variant_null(value), F.array(F.struct(path.alias("path"), side.alias("side"), text.alias("value")))).otherwise(F.array().cast("array<struct<path:string,side:int,value:string>>"))

    def opened(path: Column, name: Column, value: Column, depth: int) -> Column:
        last = leaf(path, value, F.to_json(value))
        if depth == DEPTH:
            return last
        below = F.flatten(F.transform(_below(path, name, value, keys), lambda x: opened(x["path"], x["name"], x["value"], depth + 1)))
        return F.when(unit["left"] == depth, last).otherwise(F.coalesce(below, leaf(path, value, _text(value))))

    return opened(unit["path"], unit["name"], unit["value"], 0)


def leaves(entries: DataFrame, keys: dict[str, tuple[str, ...]] = KEYS) -> DataFrame:
    """path and value (text) of every leaf that isn't null.

    entries: path (text, of where value stands) and value (a variant). A path has names with dots between them and what
    names an element in brackets: models[m-1].raw_usage[x].total. Each entry is opened once, down to its leaves, in one projection.
    """
    return _units(entries, keys, 1).select(F.struct("path", "name", "value", "left").alias("unit")).select(F.inline(_leaves(F.col("unit"), keys))).drop("side")


class _Number(str):
    """A number as JSON writes it."""


_PARSE = json.JSONDecoder(parse_int=_Number, parse_float=_Number).decode
_ESCAPES = {c: f"\\u{c:04X}" for c in range(32)} | {ord(c): e for c, e in {'"': '\\"', "\\": "\\\\", "\b": "\\b", "\t": "\\t", "\n": "\\n", "\f": "\\f", "\r": "\\r"}.items()}


def _json(value) -> str:
    """What to_json writes."""
    if isinstance(value, dict):
        return "{" + ",".join(f"{_json(k)}:{_json(v)}" for k, v in value.items()) + "}"
    if isinstance(value, list):
        return "[" + ",".join(map(_json, value)) + "]"
    if isinstance(value, str) and not isinstance(value, _Number):
        return f'"{value.translate(_ESCAPES)}"'
    return "null" if value is None else "true" if value is True else "false" if value is False else str(value)


def _open(path: str, name: str, value, left: int, keys: dict[str, tuple[str, ...]], found: dict[str, list[str]]) -> None:
    """Adds to found what _leaves() gives, of a parsed value."""
    if value is None:
        return
    if left == 0:
        found.setdefault(path, []).append(_json(value))
    elif isinstance(value, dict):
        for k, v in value.items():
            _open(f"{path}.{k}" if path else k, k, v, left - 1, keys, found)
    elif isinstance(value, list):
        own = keys.get(name)
        for k, v in enumerate(value):
            names = [v.get(x) for x in own] if own and isinstance(v, dict) else [None]
            place = k if None in names else "|".join(x if isinstance(x, str) else _json(x) for x in names)
            _open(f"{path}[{place}]", "", v, left - 1, keys, found)
    else:
        found.setdefault(path, []).append(value if isinstance(value, str) else _json(value))


def _parts(lists: pa.ListArray):
    """Each list's elements, as tuples of their fields; none where it is null."""
    elements = zip(*(f.to_pylist() for f in lists.flatten().flatten()))
    for n in lists.value_lengths().fill_null(0).to_pylist():
        yield islice(elements, n)


def _differing(batches, keys: dict[str, tuple[str, ...]]):
    """path, left_value and right_value where the text differs, of rows with the units or the leaves of one head."""
    for batch in batches:
        out = []
        for units, rows in zip(_parts(batch.column("units")), _parts(batch.column("rows"))):
            sides: tuple[dict[str, list[str]], ...] = ({}, {})
            for side, path, name, left, text in units:
                if text is not None:
                    _open(path, name, _PARSE(text), left, keys, sides[side])
            for path, side, text in rows:
                sides[side].setdefault(path, []).extend([] if text is None else [text])
            a, b = sides
            for path in a if a == b else {**a, **b}:
                # leaves of one path, such as those of elements with the same key, are compared as a whole
                x, y = ("|".join(sorted(s[path])) if path in s else None for s in sides)
                if x != y:
                    out.append((path, x, y))
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*out)] if out else [pa.array([], pa.string())] * 3, ["path", "left_value", "right_value"])


def nested_differences(left: DataFrame, right: DataFrame, keys: dict[str, tuple[str, ...]] = KEYS, tolerance: float = TOLERANCE, cut: int = 1) -> DataFrame:
    """path, left_value and right_value of every leaf that differs or that one side lacks (null there). Numbers are equal within the tolerance, everything else as text; null is the same as absent. Both sides as leaves() takes them.

    What is moved are not leaves but units, values whose path closes `cut` brackets: all leaves below such a beginning, of both sides, are
    compared in one task's memory, so take a larger cut where many entries share the beginning. Units are opened as JSON, in batches;
    those of types that JSON writes in another way than a leaf's text are opened by _leaves().
    """
    side = lambda df, k: _units(df, keys, cut).select(F.substring_index("path", "]", cut).alias("head"), F.struct(F.lit(k).alias("side"), "path", "name", "value", "left").alias("unit"))
    units = side(left, 0).unionByName(side(right, 1)).groupBy("head").agg(F.collect_list("unit").alias("units"))

    # arrays of different types are VARIANT; TIMESTAMP_NTZ and keys of such names go the longer way too
    special = lambda u: F.coalesce(F.schema_of_variant(u["value"]).rlike("TIMESTAMP|BINARY|VARIANT"), F.lit(False))
    units = units.withColumn("special", F.exists("units", special))
    plain = F.transform("units", lambda u: F.struct(u["side"].alias("side"), u["path"].alias("path"), u["name"].alias("name"), u["left"].alias("left"), F.to_json(u["value"]).alias("text")))
    leaves_ = F.flatten(F.transform("units", lambda u: _leaves(u, keys, u["side"])))
    found = units.select(F.when(~F.col("special"), plain).alias("units"), F.when(F.col("special"), leaves_).alias("rows")).mapInArrow(lambda batches: _differing(batches, keys), "path string, left_value string, right_value string")
    a, b = (F.col(f"{s}_value").try_cast("double") for s in ("left", "right"))
    return found.filter(~F.coalesce(F.abs(a - b) <= tolerance, F.lit(False)))


def payload_entries(rows: DataFrame, keys: dict[str, tuple[str, ...]] = KEYS) -> DataFrame:
    """Entries for leaves() of a payload's rows (block, place, value): those of blocks with keys by these, others by their place."""
    place = F.col("place") - 1
    name = _named(F.col("block"), F.col("value"), place, keys)
    return rows.select(F.concat("block", F.lit("["), name, F.lit("]")).alias("path"), "value")


def prefix_broken(rows: DataFrame, head: str = "sessions", whole: str = "sessionsAll", most: int = 40) -> DataFrame:
    """place and what stands there (as JSON text) where the head block isn't the first `most` entries of the whole one, field by field."""
    side = lambda block, name: rows.filter((F.col("block") == block) & (F.col("place") <= most)).select(F.col("place").alias(f"{name}_place"), F.to_json("value").alias(name))
    more = rows.filter((F.col("block") == head) & (F.col("place") > most)).select(F.col("place").alias("head_place"), F.to_json("value").alias("head"), F.lit(None).cast("long").alias("whole_place"), F.lit(None).cast("string").alias("whole"))
    j = side(head, "head").join(side(whole, "whole"), F.col("head_place") == F.col("whole_place"), "full_outer").select("head_place", "head", "whole_place", "whole")
    return j.filter(~F.col("head").eqNullSafe(F.col("whole"))).unionByName(more).select(F.coalesce("head_place", "whole_place").alias("place"), "head", "whole")
