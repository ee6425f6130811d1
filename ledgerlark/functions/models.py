"""Column functions on model ids, projects, statuses and times."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

# Vendor prefixes that aren't part of a model's name. None is a prefix of another.
VENDOR_PREFIXES = (
    "azure-", "openai/", "kimi/", "moonshotai/", "moonshot-", "x-ai/", "z-ai/", "google/", "anthropic/", "deepseek/",
    "qwen/", "zai-org/", "minimax/", "xiaomi/", "stepfun/", "subconscious/", "bothub/", "modelis/", "greenpt/",
)
# Suffixes that mark a release state, a date, a state with a date, and a route; a name may end in one of each, in this order.
MODEL_SUFFIXES = (r"-(?:preview|exp)", r"-[0-9]{6}", r"--?(?:ga|preview|exp|latest|beta)[-_]?[0-9]*", r"--?int")
UNKNOWN_MODEL = "(unknown)"
NO_PROJECT = "(无项目)"
# Stop reasons that end a turn badly.
ERROR_STOPS = ("error", "failed", "refusal")
ABORT_STOPS = ("aborted", "abort")


def canonical_model(model: Column) -> Column:
    """The name under which usage of a model is added up. One pattern for each end of the id, as this runs on every record."""
    low = F.lower(F.btrim(model, F.lit(" \t\n\r\x0b\x0c")))
    out = F.regexp_replace(low, "^(?:" + "|".join(re.escape(p) for p in VENDOR_PREFIXES) + ")+", "")
    out = F.regexp_replace(out, "".join(f"(?:{s})?" for s in MODEL_SUFFIXES) + r"\z", "")
    return F.when(F.coalesce(model, F.lit("")) == "", UNKNOWN_MODEL).otherwise(F.coalesce(F.nullif(out, F.lit("")), low))


def project_name(cwd: Column) -> Column:
    """Last part of a working directory, of either kind of slash."""
    leaf = F.regexp_extract(F.regexp_replace(F.translate(cwd, "\\", "/"), "/+$", ""), "([^/]*)$", 1)
    return F.coalesce(F.nullif(leaf, F.lit("")), F.lit(NO_PROJECT))


def status_for(stop: Column) -> Column:
    return F.when(stop.isin(*ERROR_STOPS), "error").when(stop.isin(*ABORT_STOPS), "aborted").otherwise("completed")


def _local(ms: Column, zone: str) -> Column:
    """Wall-clock time (no zone) in `zone`; null where the time is unknown. Doesn't depend on the session's zone."""
    at = F.when(ms > 0, ms)
    wall = F.expr("timestamp_ntz '1970-01-01 00:00:00'") + F.make_interval(secs=(at / 1000).cast("decimal(18,6)"))
    return wall if zone == "UTC" else F.convert_timezone(F.lit("UTC"), F.lit(zone), wall)


def local_day(ms: Column, zone: str = "UTC") -> Column:
    return F.date_format(_local(ms, zone), "yyyy-MM-dd")


def local_hour(ms: Column, zone: str = "UTC") -> Column:
    return F.date_format(_local(ms, zone), "yyyy-MM-dd HH")


def source_day(ts: Column) -> Column:
    """The day that a source's own time stamp names, whatever its zone."""
    return F.when(F.length(ts) >= 10, F.substring(ts, 1, 10))


def iso_millis(ts: Column) -> Column:
    """Epoch milliseconds of an ISO time stamp (UTC where it names no zone) or of digits; 0 where neither."""
    zoned = F.when(ts.rlike(r"(Z|[+-][0-9]{2}:?[0-9]{2})$"), ts).otherwise(F.concat(ts, F.lit("Z")))
    at = F.unix_millis(F.try_to_timestamp(F.when(ts.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}T"), zoned)))
    return F.coalesce(F.trim(ts).try_cast("bigint"), at, F.lit(0)).cast("bigint")


def source_hour(ts: Column, zone: str = "UTC") -> Column:
    """Local hour of a source's time stamp, with a T before the hour."""
    return F.date_format(_local(iso_millis(ts), zone), "yyyy-MM-dd'T'HH")


def redact_home(path: Column, home: str) -> Column:
    """The home folder at the start of a path as ~; case and kind of slash don't matter."""
    norm = lambda c: F.lower(F.translate(c, "\\", "/"))
    base = re.sub(r"/+$", "", home.replace("\\", "/")).lower()
    rest = F.substring(path, F.lit(len(base) + 1), F.length(path))
    inside = norm(path).startswith(base) & (F.length(path).eqNullSafe(len(base)) | norm(rest).startswith("/"))
    return F.when(inside, F.concat(F.lit("~"), F.translate(rest, "\\", "/"))).otherwise(path)


def half_up(x: Column) -> Column:
    """Rounds halves towards positive infinity."""
    return F.floor(x + 0.5)


def one_decimal(x: Column) -> Column:
    return F.floor(x * 10 + 0.5).cast("double") / 10
