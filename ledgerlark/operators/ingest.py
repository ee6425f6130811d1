"""The manifest language compiled to columns: from decoded records to canonical usage records."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ledgerlark.functions.models import iso_millis
from ledgerlark.operators.drivers import DRIVERS

KINDS = ("jsonl", "json", "zstd-jsonl", "sqlite")
# What a nested record takes from its parent where it has no such key.
INHERITED = ("sessionId", "session_id", "id", "model", "modelVersion", "timestamp", "startTime", "createTime")


@dataclass(frozen=True)
class Manifest:
    id: str
    label: str = ""
    kind: str = "jsonl"
    paths: tuple[str, ...] = ()
    db: str = ""
    query: str = ""
    json_column: str = ""
    json_rows: str = ""
    prefilter: tuple[str, ...] = ()
    require: tuple[str, ...] = ()
    where: dict = field(default_factory=dict)
    driver: str = ""
    dedup: tuple[str, ...] = ()
    fields: dict[str, tuple[str, ...]] = field(default_factory=dict)
    input_subtract: tuple[str, ...] = ()
    output_add: tuple[str, ...] = ()
    reasoning_in_output: bool = True
    enabled: bool = True
    file_name: str = ""

    @classmethod
    def of(cls, raw: dict, file_name: str = "") -> Manifest:
        many = lambda x: tuple(v for v in ([x] if isinstance(x, str) else x or ()) if isinstance(v, str) and v)
        return cls(
            id=raw.get("id", ""), label=raw.get("label", ""), kind=raw.get("kind") or "jsonl", paths=many(raw.get("paths")), db=raw.get("db", ""), query=raw.get("query", ""),
            json_column=raw.get("json_column", ""), json_rows=raw.get("json_rows", ""), prefilter=many(raw.get("prefilter")), require=many(raw.get("require")), where=dict(raw.get("where") or {}),
            driver=raw.get("driver", ""), dedup=many(raw.get("dedup")), fields={k: many(v) for k, v in (raw.get("fields") or {}).items()}, input_subtract=many(raw.get("inputSubtract")),
            output_add=many(raw.get("outputAdd")), reasoning_in_output=raw.get("reasoningIsSubsetOfOutput") is not False, enabled=raw.get("enabled") is not False, file_name=file_name,
        )

    def problems(self) -> list[str]:
        out = [] if self.id else ["no id"]
        if self.kind not in KINDS:
            out.append(f"unknown kind {self.kind}")
        if self.kind == "sqlite" and not (self.db and self.query):
            out.append("a sqlite manifest needs db and query")
        if self.kind != "sqlite" and not self.paths:
            out.append("no paths")
        if self.driver and self.driver not in DRIVERS:
            out.append(f"unknown driver {self.driver}")
        return out + [f"no field {f}" for f in ("model", "input", "output") if not self.fields.get(f)]


# Fixed value: what counts as white space around a line.
WHITE = " \t\n\v\f\r\u0085\u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def trimmed(value: Column) -> Column:
    return F.btrim(value, F.lit(WHITE))


def _path(path: str) -> str:
    """A dotted path as a JSON path."""
    out = "$"
    for part in path.split("."):
        name, *indexes = re.split(r"\[(\d+)\]", part)
        if name:
            out += f".{name}" if re.fullmatch(r"[A-Za-z_][A-Za-z0-9_]*", name) else "['" + name.replace("'", "\\'") + "']"
        out += "".join(f"[{i}]" for i in indexes if i)
    return out


def dig(obj: Column, path: str, kind: str = "string") -> Column:
    """The value at a path, null where there is none or it has another kind. Paths that begin with $ name no value."""
    return F.lit(None).cast(kind) if path.startswith("$") else F.try_variant_get(obj, _path(path), kind)


def first_of(obj: Column, paths: tuple[str, ...]) -> Column:
    """The first value that is there and not empty; 0 and false are values."""
    tries = [F.nullif(dig(obj, p), F.lit("")) for p in paths]
    return F.coalesce(*tries) if tries else F.lit(None).cast("string")


def to_int(value: Column) -> Column:
    """Whole part of a number or of a string with one; booleans are 0 and 1; all else is 0."""
    s = F.trim(value)
    flag = F.when(s == "true", 1).when(s == "false", 0)
    return F.coalesce(s.try_cast("bigint"), s.try_cast("double").try_cast("bigint"), flag.cast("bigint"), F.lit(0).cast("bigint"))


def shown(value: Column) -> Column:
    """A value as text: whole numbers have no fraction, booleans are True and False."""
    return F.when(value == "true", "True").when(value == "false", "False").otherwise(F.regexp_replace(value, r"^(-?[0-9]+)\.0+$", "$1"))


def contains_any(text: Column, patterns: tuple[str, ...]) -> Column:
    hit = text.contains(patterns[0])
    for p in patterns[1:]:
        hit |= text.contains(p)
    return hit


def prefiltered(lines: DataFrame, patterns: tuple[str, ...], column: str = "value") -> DataFrame:
    """Lines with any of the patterns, looked for in the raw text before it is decoded."""
    return lines.filter(contains_any(F.col(column), patterns)) if patterns else lines


def allow_duplicate_keys(spark: SparkSession) -> None:
    """Of repeated keys of an object the last counts, as logs have them; by default Spark gives up on such a line."""
    spark.conf.set("spark.sql.variant.allowDuplicateKeys", "true")


def decoded(lines: DataFrame, column: str = "value") -> DataFrame:
    """Lines that hold a JSON object, as a variant `obj`."""
    allow_duplicate_keys(lines.sparkSession)
    text = trimmed(F.col(column))
    objects = lines.withColumn("text_", text).filter(F.col("text_").startswith("{") & F.col("text_").endswith("}"))
    return parsed_once(objects, F.try_parse_json("text_"), "obj").drop(column, "text_").filter("obj is not null")


def parsed_once(rows: DataFrame, value: Column, name: str) -> DataFrame:
    """rows with a value that is computed once for each row, however many columns are made from it: the optimiser copies an expression into every place that uses it, but not a generator's output."""
    return rows.select("*", F.explode(F.array(value)).alias(name))


def required(m: Manifest, obj: Column, get=None) -> Column:
    """Whether a record has what the manifest asks for. get(path, kind) gives a value, by default from obj."""
    get = get or (lambda path, kind="string": dig(obj, path, kind))
    ok = F.lit(True)
    for p in m.require:
        v = get(p, "variant")
        ok &= v.isNotNull() & ~F.is_variant_null(v) & ~F.to_json(v).isin("null", '""', "{}", "[]")
    for p, want in m.where.items():
        if isinstance(want, bool):
            ok &= get(p, "boolean").eqNullSafe(want)
        elif isinstance(want, (int, float)):
            ok &= get(p, "double").eqNullSafe(float(want))
        elif want is None:
            ok &= get(p).isNull()
        elif isinstance(want, str):
            ok &= get(p).eqNullSafe(want)
        else:
            # objects and arrays as a whole; variants keep their keys sorted
            ok &= F.to_json(get(p, "variant")).eqNullSafe(F.to_json(F.parse_json(F.lit(json.dumps(want)))))
    return F.coalesce(ok, F.lit(False))


def time_text(value: Column) -> Column:
    """A time stamp as text: epoch milliseconds in UTC with milliseconds, text as it is, other numbers nothing."""
    n = value.try_cast("double")
    iso = F.concat(F.date_format(F.expr("timestamp_ntz '1970-01-01 00:00:00'") + F.make_interval(secs=(n / 1000).cast("decimal(18,3)")), "yyyy-MM-dd'T'HH:mm:ss.SSS"), F.lit("Z"))
    return F.when(n > 1e12, iso).when(n.isNull(), value)


def normalized(records: DataFrame, m: Manifest) -> DataFrame:
    """Canonical records of a manifest, with dedup_key and has_usage.

    records: file, dir, line, obj. A record that doesn't meet the requirements, or has no tokens, still claims its key.
    """
    obj = F.col("obj")
    found: dict[tuple[str, str], str] = {}

    def get(path: str, kind: str = "string") -> Column:
        """A column of its own for each value, so that each is looked for once in a record."""
        return F.col(found.setdefault((path, kind), f"v{len(found)}_"))

    def first(paths: tuple[str, ...]) -> Column:
        return F.coalesce(*(F.nullif(get(p), F.lit("")) for p in paths)) if paths else F.lit(None).cast("string")

    number = lambda name: to_int(first(m.fields.get(name, ())))
    tokens_in = number("input")
    for p in m.input_subtract:
        tokens_in = tokens_in - to_int(get(p))
    tokens_out = number("output")
    for p in m.output_add:
        tokens_out = tokens_out + to_int(first((p,)))
    identity = [F.coalesce(shown(first((p,))), F.lit("")) for p in m.dedup]
    place = F.concat_ws("", F.col("file"), F.lit("#"), F.col("line"))
    key = F.when(F.concat(*identity) != "", F.concat_ws(":", *identity)).otherwise(place) if identity else place
    columns = [
        F.lit(m.id).alias("tool"), "file", "line", F.concat(F.lit(f"{m.id}:"), key).alias("dedup_key"), required(m, obj, get).alias("qualified"),
        F.coalesce(F.nullif(shown(first(m.fields.get("model", ()))), F.lit("")), F.lit("(unknown)")).alias("model"),
        F.coalesce(F.nullif(shown(first(m.fields.get("session", ()))), F.lit("")), F.nullif("dir", F.lit("")), F.lit("?")).alias("session"),
        time_text(first(m.fields.get("time", ()))).alias("ts"),
        F.greatest(tokens_in, F.lit(0)).alias("input"), number("cacheRead").alias("cache_read"), number("cacheWrite").alias("cache_write"), tokens_out.alias("output"), number("reasoning").alias("reasoning"),
    ]
    values = records.select("file", "dir", "line", *(dig(obj, p, kind).alias(name) for (p, kind), name in found.items()))
    out = values.select(*columns)
    if m.reasoning_in_output:
        out = out.withColumn("reasoning", F.least("reasoning", "output"))
    return out.withColumn("has_usage", F.col("qualified") & (F.col("input") + F.col("cache_read") + F.col("cache_write") + F.col("output") != 0)).drop("qualified")


def deduplicated(records: DataFrame) -> DataFrame:
    """The first record of each key in (file, line) order, then only those with usage."""
    from ledgerlark.operators.external import first_wins

    return first_wins(records, ["tool", "dedup_key"], ["file", "line"]).filter("has_usage").drop("has_usage")


def flattened(documents: DataFrame, rows: str) -> DataFrame:
    """Elements of the array at `rows` of each document, with what they inherit. Lines are numbered parent * 1000 + index."""
    parts = documents.withColumn("items", F.try_variant_get("obj", _path(rows), "array<variant>")).filter("items is not null")
    each = parts.select("file", "dir", "line", F.col("obj").alias("parent"), F.posexplode("items").alias("i", "item"))
    text = F.to_json("item")
    own = F.from_json(text, "map<string,string>")
    extra = [F.when(~F.map_contains_key(own, F.lit(k)) & dig(F.col("parent"), k).isNotNull(), F.concat(F.lit(f'"{k}":'), F.to_json(F.try_variant_get("parent", f"$.{k}", "variant")))) for k in INHERITED]
    inherited = F.array_join(F.array_compact(F.array(*extra)), ",")
    merged = F.when(inherited == "", text).when(text == "{}", F.concat(F.lit("{"), inherited, F.lit("}"))).otherwise(F.concat(F.lit("{"), inherited, F.lit(","), F.substring(text, F.lit(2), F.length(text))))
    return each.filter(text.startswith("{")).select("file", "dir", (F.col("line") * 1000 + F.col("i")).alias("line"), F.try_parse_json(merged).alias("obj"))


def claimed(files: DataFrame) -> DataFrame:
    """path, tool of the first manifest (by rank) that names each file; the others are listed as losers."""
    owner = files.groupBy("path").agg(F.min_by("tool", F.struct("rank", "tool")).alias("owner"), F.array_sort(F.collect_set("tool")).alias("tools"))
    return owner.select("path", "owner", F.array_join(F.array_remove("tools", F.col("owner")), "|").alias("losers"))


def hours_of(records: DataFrame, zone: str = "UTC") -> DataFrame:
    """Records with their source day and local hour."""
    from ledgerlark.functions.models import source_day, source_hour

    return records.withColumns({"d": source_day(F.col("ts")), "h": F.when(iso_millis(F.col("ts")) > 0, source_hour(F.col("ts"), zone))})
