"""Where logs are: path patterns, their variables, and which manifest owns a file. Planning only, on the driver."""

from __future__ import annotations

import glob
import json
import os
import re
import sys
from collections.abc import Iterable, Mapping
from typing import NamedTuple

from pyspark.sql import SparkSession

from ledgerlark.operators.ingest import Manifest

# Variables that say the same elsewhere as one of Windows does, the most specific first.
INSTEAD = {"APPDATA": ("XDG_DATA_HOME", "XDG_CONFIG_HOME"), "LOCALAPPDATA": ("XDG_STATE_HOME", "XDG_DATA_HOME", "XDG_CONFIG_HOME"), "USERPROFILE": ("HOME",), "HOMEDRIVE": (), "HOMEPATH": (), "PROGRAMDATA": ("XDG_DATA_HOME",), "PROGRAMDATA32": ("XDG_DATA_HOME",)}
# Those that name a folder of applications' data, and that folder on each platform where none of the above is set.
DATA_FOLDERS = ("APPDATA", "LOCALAPPDATA", "PROGRAMDATA", "PROGRAMDATA32")
PLATFORM_DATA = {"darwin": "Library/Application Support", "linux": ".local/share"}
VARIABLE = re.compile(r"%%|%([A-Za-z_][A-Za-z0-9_]*)%|\$\{([A-Za-z_][A-Za-z0-9_]*)\}|\$([A-Za-z_][A-Za-z0-9_]*)")


def variable(name: str, home: str, env: Mapping[str, str], platform: str = sys.platform) -> str | None:
    """The value of a variable, or of what stands for it on this platform; None where nothing does. Names of Windows' variables have no case."""
    if name in env:
        return env[name]
    known = name.upper()
    if platform == "win32" or known not in INSTEAD:
        return None
    for other in INSTEAD[known]:
        if env.get(other):
            return env[other]
    return os.path.join(home, PLATFORM_DATA.get(platform, PLATFORM_DATA["linux"])) if known in DATA_FOLDERS and home else None


def expand(pattern: str, home: str, env: Mapping[str, str] | None = None, platform: str = sys.platform) -> str:
    """A pattern with ~, {home} and variables put in. An unknown %NAME% stays, an unknown $NAME is empty, %% is a per cent sign."""
    env = os.environ if env is None else env

    def value(m: re.Match) -> str:
        if m[0] == "%%":
            return "%"
        if m[1]:
            found = variable(m[1], home, env, platform)
            return m[0] if found is None else found
        return env.get(m[2] or m[3], "")

    out = VARIABLE.sub(value, pattern.replace("{home}", home))
    return home + out[1:] if out == "~" or out.startswith(("~/", "~\\")) else out


def unresolved(manifest: Manifest, home: str, env: Mapping[str, str] | None = None) -> list[str]:
    """Variables without which no path of the manifest can be found."""
    missing = [{m[1] for m in VARIABLE.finditer(expand(p, home, env)) if m[1]} for p in manifest.paths or (manifest.db,)]
    return sorted(set.intersection(*missing)) if missing and all(missing) else []


def _found(pattern: str) -> Iterable[str]:
    """Files that a pattern of * and ? names. One without a folder behind its first wildcard is looked for at any depth, and a folder stands for all files below it."""
    if not re.search(r"[*?]", pattern):
        return [pattern] if os.path.isfile(pattern) else [os.path.join(d, n) for d, _, names in os.walk(pattern) for n in names]
    base, rest = re.fullmatch(r"((?:[^*?]*/)?)(.*)", pattern, re.DOTALL).groups()
    rest = rest.replace("**/", "").replace("**", "*")
    deep = f"{glob.escape(base)}{'' if '/' in rest else '**/'}{rest.replace('[', '[[]')}"
    also = pattern.replace("[", "[[]")
    return {f for g in (deep, also) for f in glob.glob(g, recursive=True, include_hidden=True) if os.path.isfile(f)}


def files(manifest: Manifest, home: str, env: Mapping[str, str] | None = None) -> list[str]:
    """The manifest's files, sorted, each once; a database comes with its log and shared memory."""
    found: set[str] = set()
    for p in manifest.paths:
        found.update(_found(expand(p, home, env)))
    if manifest.db:
        found.update(p for s in ("", "-wal", "-shm") if os.path.isfile(p := expand(manifest.db, home, env) + s))
    return sorted(found)


def load_manifests(folder: str, only: Iterable[str] = ()) -> list[Manifest]:
    """The manifests of a folder in the order of their file names."""
    wanted = {x.strip() for x in only} - {""}
    out = []
    for name in sorted(os.listdir(folder)):
        if name.endswith(".json"):
            with open(os.path.join(folder, name), encoding="utf-8") as f:
                manifest = Manifest.of(json.load(f), name)
            if not wanted or manifest.id in wanted:
                out.append(manifest)
    return out


def claim(lists: Iterable[tuple[Manifest, list[str]]]) -> tuple[dict[str, list[str]], dict[str, list[tuple[str, str]]]]:
    """Files of each manifest id, every path given to the first that names it, and (path, owner) of what each lost."""
    owner: dict[str, str] = {}
    owned: dict[str, list[str]] = {}
    lost: dict[str, list[tuple[str, str]]] = {}
    for m, paths in lists:
        owned.setdefault(m.id, [])
        for p in paths:
            if owner.setdefault(p, m.id) == m.id:
                owned[m.id].append(p)
            else:
                lost.setdefault(m.id, []).append((p, owner[p]))
    return owned, lost


class Stamp(NamedTuple):
    """A file as it was found: its path, bytes, and when it was changed, in milliseconds."""

    path: str
    size: int
    changed: int


def stamp(path: str) -> Stamp | None:
    """None if the file is gone."""
    try:
        s = os.stat(path)
    except OSError:
        return None
    return Stamp(path, s.st_size, s.st_mtime_ns // 1_000_000)


def listed(spark: SparkSession, folder: str) -> list[Stamp]:
    """All files below a folder of any file system, sorted by path; local ones have plain paths."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    found, each = [], fs.listFiles(path, True)
    while each.hasNext():
        f = each.next()
        found.append(Stamp(re.sub("^file:/+", "/", f.getPath().toString()), f.getLen(), f.getModificationTime()))
    return sorted(found)


def fingerprint(paths: Iterable[str]) -> tuple[int, int, int]:
    """Files, latest change in seconds, and bytes."""
    stats = [os.stat(p) for p in paths]
    return len(stats), max((int(s.st_mtime) for s in stats), default=0), sum(s.st_size for s in stats)
