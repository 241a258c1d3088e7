"""Nested events to one wide log table.

Pass one flattens each event to keyed values (leaves of a level first, nested objects afterwards, the last one first;
later leaves win), renaming, excluding, splitting and aliasing on the way, in Arrow batches, and hands back only the keys
and whether every value of a key is an integer. Pass two does so again for the values and projects one column a key: bigint if all are integers, text
otherwise; spellings that differ only in case share a column. Where the set of paths is known beforehand,
flatten_known does it all with variant expressions.
"""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Iterator
from itertools import islice

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import Mapping
from ..functions import transforms
from .rules import EventFilter

_OTHER = re.compile(r"[^a-zA-Z0-9]")
_MOST = 2**63 - 1
_SCAN = json.JSONDecoder().scan_once
#: Values held at once by the second pass, in rows of as many columns as there are.
CELLS = 1_000_000


def sanitize(name: str) -> str:
    return _OTHER.sub("", name)


def split_pairs(value: str, separator: str, equal: str) -> list[tuple[str, str]]:
    """k=v pairs up to the first part that is none."""
    out = []
    for part in value.split(separator):
        kv = part.split(equal)
        if len(kv) != 2:
            break
        out.append((kv[0], kv[1]))
    return out


def split_column(c: Column, separator: str, equal: str) -> Column:
    """The same as a map column."""
    quote = lambda s: re.sub(r"([^A-Za-z0-9])", r"\\\1", s)
    parts = F.transform(F.split(c, quote(separator)), lambda p: F.split(p, quote(equal)))
    good = F.transform(F.array(parts), lambda ps: F.filter(ps, lambda p, i: ~F.exists(F.slice(ps, 1, i + 1), lambda q: F.size(q) != 2)))[0]
    return F.map_from_entries(F.transform(good, lambda p: F.struct(p[0].alias("key"), p[1].alias("value"))))


class Level(dict):
    """What becomes of the keys below a path, worked out once a key: None if excluded, else the column's name, split rule, aliases, and whether the value itself stays."""

    def __init__(self, paths: Paths, path: str) -> None:
        super().__init__()
        self.paths, self.path, self.below = paths, path, {}

    def full(self, key: str) -> str:
        return f"{self.path}.{key}" if self.path else key

    def __missing__(self, key: str) -> tuple | None:
        m, full = self.paths.m, self.full(key)
        raw = full.rsplit(".", 1)[-1]
        name = m.fields.get(full) or sanitize(raw)
        rule = m.split.get(name) or m.split.get(raw)
        aliases = m.alias.get(name) or m.alias.get(raw) or []
        self[key] = None if any(x in full for x in m.exclusions) else (name, rule, aliases, not rule or bool(aliases) or name in m.keep_split)
        self.paths.held += 1
        return self[key]

    def level(self, key: str) -> Level:
        """The keys of the object under key."""
        found = self.below.get(key)
        if found is None:
            found = self.below[key] = Level(self.paths, self.full(key))
            self.paths.held += 1
        return found


class Paths:
    """The levels of all paths seen, at most about so many keys; begun anew beyond that, for keys that are data."""

    def __init__(self, m: Mapping, most: int = 100_000) -> None:
        self.m, self.most = m, most
        # A value is useless if it equals one of these and is of its type; lists are text by then, so none is.
        self.useless = {(type(u), u) for u in m.useless if not isinstance(u, (list, dict))}
        self.looked_at = any(u for _, u in self.useless)  # values that are not empty too
        self.clear()

    def clear(self) -> None:
        self.held, self.top = 0, Level(self, "")


def flatten_event(event: dict, m: Mapping, paths: Paths | None = None) -> dict[str, object]:
    """Column to value of one event."""
    paths = Paths(m) if paths is None else paths
    if paths.held >= paths.most:
        paths.clear()
    useless, looked_at = paths.useless, paths.looked_at
    out: dict[str, object] = {}
    stack: list[tuple[Level, dict]] = [(paths.top, event)]
    while stack:
        level, node = stack.pop()
        for key, value in node.items():
            kind = type(value)
            if kind is dict:
                stack.append((level.level(key), value))
                continue
            plan = level[key]
            if plan is None:
                continue
            if kind is list:
                value, kind = str(value), str
            if (looked_at or not value) and (kind, value) in useless:
                continue
            name, rule, aliases, stays = plan
            if kind is int and not -_MOST <= value <= _MOST:
                value, kind = str(value), str
            if rule and kind is str:
                out.update({sanitize(k): v for k, v in split_pairs(value, *rule)})
            if stays:
                out[name] = value
            for a in aliases:
                out[a] = value
    return out


def _get(raw: Column, path: str) -> Column:
    steps = "".join(f"['{p}']" for p in path.split("."))
    return F.try_variant_get(raw, "$" + steps, "string")


def early_filter(events: DataFrame, f: EventFilter, m: Mapping) -> DataFrame:
    """Keep the events that some rule may match, before flattening (raw as JSON text)."""
    if not f.enabled:
        return events
    v = F.try_parse_json("raw")
    channel = F.coalesce(*[_get(v, p) for p in m.channel_paths])
    eventid = F.coalesce(*[_get(v, p + ".#text") for p in m.eventid_paths], *[_get(v, p) for p in m.eventid_paths])
    return events.where(f.keeps(channel, eventid))


def time_range(c: Column, after: str, before: str) -> Column:
    """Strictly between, on the first 19 characters; what is no time is kept."""
    t = F.substring(c, 1, 19)
    known = t.rlike(r"^\d{4}-\d{2}-\d{2}.\d{2}:\d{2}:\d{2}$")
    return F.coalesce(~known | ((t > F.lit(after[:19])) & (t < F.lit(before[:19]))), F.lit(True))


def _event(raw: str) -> object:
    """json.loads, by a shorter way for a text that is one value and nothing else."""
    try:
        event, end = _SCAN(raw, 0)
        if end == len(raw):
            return event
    except (StopIteration, ValueError, TypeError):
        pass
    return json.loads(raw)


def _flat(batch: pd.DataFrame | dict[str, list], m: Mapping, paths: Paths) -> Iterator[tuple[str, str, dict[str, object]]]:
    """File, raw text and columns of the events of a batch; what is no JSON object is left out."""
    last = name = None
    for file, raw in zip(batch["source_file"], batch["raw"]):
        try:
            event = _event(raw)
        except ValueError:
            continue
        if isinstance(event, dict):
            if name is None or file != last:
                last, name = file, str(file).rsplit("/", 1)[-1]
            flat = flatten_event(event, m, paths)
            flat.setdefault("OriginalLogfile", name)
            yield file, raw, flat


def _text(value: object) -> str:
    return value if type(value) is str else str(int(value)) if type(value) is bool else str(value)  # type: ignore[call-overload]


def keyed(events: DataFrame, m: Mapping, hashes: bool = False) -> DataFrame:
    """source_file, row_hash, and entries: array of (key, value as text, whether it is an integer)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        paths = Paths(m)
        for b in batches:
            files, marks, entries = [], [], []
            for file, raw, flat in _flat(b, m, paths):
                files.append(file)
                marks.append(xxhash.xxh64(raw.encode()).hexdigest() if hashes else None)
                entries.append([{"key": k, "value": _text(v), "whole": isinstance(v, int)} for k, v in flat.items() if v is not None])
            yield pd.DataFrame({"source_file": files, "row_hash": marks, "entries": entries}, dtype=object)

    return events.mapInPandas(run, "source_file string, row_hash string, entries array<struct<key:string,value:string,whole:boolean>>")


def keys(events: DataFrame, m: Mapping) -> DataFrame:
    """key, whole (all its values are integers), n (rows that have it): one row a key and batch, so values stay in the worker."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        paths = Paths(m)
        for b in batches:
            # Events alike in keys and kinds of values are counted together.
            seen = Counter((tuple(flat), tuple(map(type, flat.values()))) for _, _, flat in _flat({c: b.column(c).to_pylist() for c in ("source_file", "raw")}, m, paths))
            n: Counter[str] = Counter()
            text: set[str] = set()
            for (names, kinds), k in seen.items():
                for key, kind in zip(names, kinds):
                    if kind is not type(None):
                        n[key] += k
                        if not issubclass(kind, int):
                            text.add(key)
            yield pa.RecordBatch.from_arrays([pa.array(list(n), pa.string()), pa.array([k not in text for k in n], pa.bool_()), pa.array(list(n.values()), pa.int64())], ["key", "whole", "n"])

    return events.select("source_file", "raw").mapInArrow(run, "key string, whole boolean, n long")


def discover(found: DataFrame) -> list[tuple[str, list[str], bool]]:
    """Columns of keys: the spelling shown, all spellings, and whether all values are integers. One row a key is collected."""
    rows = found.groupBy("key").agg(F.bool_and("whole").alias("whole"), F.sum("n").alias("n")).collect()
    by: dict[str, list] = {}
    for r in sorted(rows, key=lambda r: (-r["n"], r["key"])):
        by.setdefault(r["key"].lower(), []).append(r)
    return [(rs[0]["key"], [r["key"] for r in rs], all(r["whole"] for r in rs)) for _, rs in sorted(by.items())]


def widen(events: DataFrame, m: Mapping, columns: list[tuple[str, list[str], bool]], hashes: bool = False, only: list[str] | None = None) -> DataFrame:
    """source_file and one column a key; only: the columns that are needed. The values are written as columns, some rows at a time."""
    wanted = {c.lower() for c in only} if only is not None else None
    taken = [c for c in columns if wanted is None or c[0].lower() in wanted]
    marked = hashes and wanted is None
    names = ["source_file", *[name for name, _, _ in taken], *(["OriginalLogLinexxHash"] if marked else [])]
    kinds = [pa.string(), *[pa.int64() if whole else pa.string() for _, _, whole in taken], *([pa.string()] if marked else [])]
    rows = max(1, CELLS // len(names))

    def value(flat: dict[str, object], spellings: list[str]) -> object:
        return next((v for s in spellings if (v := flat.get(s)) is not None), None)

    def column(flats: list[dict[str, object]], spellings: list[str], whole: bool) -> list:
        found = [f.get(spellings[0]) for f in flats] if len(spellings) == 1 else [value(f, spellings) for f in flats]
        return [None if v is None else int(v) for v in found] if whole else [None if v is None else _text(v) for v in found]  # type: ignore[call-overload]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        paths = Paths(m)
        for b in batches:
            some = _flat({c: b.column(c).to_pylist() for c in ("source_file", "raw")}, m, paths)
            while part := list(islice(some, rows)):
                flats = [flat for _, _, flat in part]
                data = [[file for file, _, _ in part], *[column(flats, spellings, whole) for _, spellings, whole in taken]]
                if marked:
                    data.append([xxhash.xxh64(raw.encode()).hexdigest() for _, raw, _ in part])
                yield pa.RecordBatch.from_arrays([pa.array(d, k) for d, k in zip(data, kinds)], names)

    fields = [T.StructField(n, T.LongType() if k == pa.int64() else T.StringType()) for n, k in zip(names, kinds)]
    return events.select("source_file", "raw").mapInArrow(run, T.StructType(fields))


def flatten(events: DataFrame, m: Mapping | None = None, hashes: bool = False, only: list[str] | None = None, event_filter: EventFilter | None = None, after: str | None = None, before: str | None = None) -> DataFrame:
    """The log table of events (source_file, raw): filters first, then flattening, transforms and the time range."""
    m = m or Mapping()
    kept = early_filter(events, event_filter, m) if event_filter else events
    logs = widen(kept, m, discover(keys(kept, m)), hashes, only)
    if after or before:
        have = {c.lower(): c for c in logs.columns}
        times = [F.col(f"`{have[t.lower()]}`").cast("string") for t in m.time_fields if t.lower() in have]
        if times:
            logs = logs.where(time_range(F.coalesce(*times), after or "0001-01-01T00:00:00", before or "9999-12-31T23:59:59"))
    return transforms.apply(logs, m.transforms) if m.transforms != [] else logs


def flatten_known(events: DataFrame, paths: dict[str, str], whole: set[str] = frozenset()) -> DataFrame:  # type: ignore[assignment]
    """Path to column with variant expressions only; several paths of one column are coalesced in order."""
    v = events.withColumn("_v", F.try_parse_json("raw"))
    by: dict[str, list[str]] = {}
    for path, name in paths.items():
        by.setdefault(name, []).append(path)
    out = [F.nullif(F.coalesce(*[_get(F.col("_v"), p) for p in ps]), F.lit("")) for ps in by.values()]
    return v.select("source_file", *[(c.try_cast("bigint") if n in whole else c).alias(n) for c, n in zip(out, by)])
