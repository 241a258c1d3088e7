"""Sinks: matches are written by the executors; reports of one entry a rule are made on the driver."""

from __future__ import annotations

import json
from collections.abc import Iterator
from itertools import groupby
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .detect import Detections
from .summarize import COLOURS, navigator

SARIF_LEVELS = {"critical": "error", "high": "error", "medium": "warning"}


def _named(d: Detections) -> tuple[DataFrame, list[str]]:
    data = [c for c in d.matches.columns if c not in ("rule_idx", "query_idx")]
    return d.kept().join(F.broadcast(d.rules), "rule_idx"), data


def ndjson(d: Detections, with_id: bool = False, with_level: bool = False) -> DataFrame:
    """value: one JSON object a match: title, id and level if asked for, description, then the row without NULLs."""
    rows, data = _named(d)
    head = [F.col("title").alias("title"), *([F.col("id").alias("id")] if with_id else []), F.col("description").alias("description"), *([F.col("level").alias("rule_level")] if with_level else [])]
    taken = {"title", "id", "description", "rule_level"}
    return rows.select(F.to_json(F.struct(*head, *[F.col(f"`{c}`") for c in data if c.lower() not in taken])).alias("value"))


def bulk(d: Detections, index: str = "detections") -> DataFrame:
    """Bulk lines: an index line before every document."""
    return ndjson(d, with_level=True).select(F.explode(F.array(F.lit(json.dumps({"index": {"_index": index}})), F.col("value"))).alias("value"))


def timesketch(d: Detections, time_field: str = "SystemTime") -> DataFrame:
    rows, data = _named(d)
    time = F.col(f"`{time_field}`") if time_field in data else F.lit(None).cast("string")
    return rows.select(F.to_json(F.struct(F.col("title").alias("message"), time.alias("datetime"), F.lit("Detection").alias("timestamp_desc"), F.col("level").alias("rule_level"), *[F.col(f"`{c}`") for c in data if c not in ("message", "datetime", "timestamp_desc", "rule_level")])).alias("value"))


def csv(d: Detections) -> DataFrame:
    """rule_title, rule_description, rule_level, rule_count, then all columns by name; line ends are dropped from texts."""
    rows, data = _named(d)
    clean = lambda c: F.coalesce(F.translate(F.col(f"`{c}`").cast("string"), "\r\n", ""), F.lit(""))
    counted = rows.join(F.broadcast(d.counts().select("rule_idx", "count")), "rule_idx")
    return counted.select(clean("title").alias("rule_title"), clean("description").alias("rule_description"), F.col("level").alias("rule_level"), F.col("count").alias("rule_count"), *[clean(c).alias(c) for c in sorted(data)])


def summary_csv(d: Detections) -> DataFrame:
    return d.sorted_counts().select(F.col("title").alias("rule_title"), F.col("level").alias("rule_level"), F.array_join("tags", ",").alias("tags"), "count")


def keepflat(logs: DataFrame) -> DataFrame:
    """value: the flattened events that passed the filters, one JSON object each."""
    return logs.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in logs.columns])).alias("value"))


def sarif(d: Detections) -> dict:
    rows = d.sorted_counts().collect()
    rules = [{"id": r["id"] or r["title"], "name": r["title"], "shortDescription": {"text": r["description"] or r["title"]}, "properties": {"tags": r["tags"]}} for r in rows]
    results = [{"ruleId": r["id"] or r["title"], "level": SARIF_LEVELS.get((r["level"] or "").lower(), "note"), "message": {"text": f"{r['title']}: {r['count']} matches"}} for r in rows]
    return {"version": "2.1.0", "$schema": "https://json.schemastore.org/sarif-2.1.0.json", "runs": [{"tool": {"driver": {"name": "embertrail", "rules": rules}}, "results": results}]}


def layer(d: Detections, name: str = "Detections") -> dict:
    """A technique layer: score, colour and rules of every technique."""
    rows = navigator(d.counts()).collect()
    items = [
        {"techniqueID": r["technique"], "score": r["score"], "color": r["color"], "comment": "; ".join(r["top_rules"]), "enabled": True} | ({"tactic": r["tactic"].lower().replace(" ", "-")} if r["tactic"] else {})
        for r in sorted(rows, key=lambda r: (r["technique"], r["tactic"] or ""))
    ]
    top = max([r["score"] for r in rows], default=1)
    return {"name": name, "versions": {"layer": "4.5"}, "domain": "enterprise-attack", "techniques": items, "gradient": {"colors": [COLOURS["low"], COLOURS["critical"]], "minValue": 0, "maxValue": top}}


def _objects(d: Detections) -> Iterator[tuple[dict, Iterator[str]]]:
    """The head of every rule that matched and its matches as JSON texts, to be taken in turn.

    Matches come sorted by rule and text, and to the driver one partition at a time, so a rule of any number of matches
    is no row, task or list of its own.
    """
    data = [c for c in d.matches.columns if c not in ("rule_idx", "query_idx")]
    heads = {r["rule_idx"]: {"title": r["title"], "id": r["id"], "description": r["description"], "rule_level": r["level"], "tags": r["tags"], "count": r["count"]} for r in d.counts().collect()}
    rows = d.kept().select("rule_idx", F.to_json(F.struct(*[F.col(f"`{c}`") for c in data])).alias("row")).orderBy("rule_idx", "row")
    for rule, found in groupby(rows.toLocalIterator(), key=lambda r: r["rule_idx"]):
        yield heads[rule], (r["row"] for r in found)


def nested_json(d: Detections) -> list[dict]:
    """The detections as objects with their matches, as a list; for small results."""
    return [head | {"matches": [json.loads(m) for m in matches]} for head, matches in _objects(d)]


def write_json(d: Detections, path: str) -> None:
    """The same as a file, written match by match."""
    with open(path, "w", encoding="utf-8") as out:
        out.write("[")
        for i, (head, matches) in enumerate(_objects(d)):
            out.write(("," if i else "") + "\n" + json.dumps(head, indent=4, ensure_ascii=False)[:-2] + ',\n    "matches": [')
            for j, m in enumerate(matches):
                out.write(("," if j else "") + "\n        " + m)
            out.write("\n    ]\n}")
        out.write("\n]\n")


def export(d: Detections, kind: str, path: str) -> None:
    """Write detections: ndjson, splunk, splunk_id, elk, zinc, timesketch, csv, summary_csv (folders), json, sarif, layer (files)."""
    lines = {"ndjson": lambda: ndjson(d, with_level=True), "splunk": lambda: ndjson(d), "elk": lambda: ndjson(d), "splunk_id": lambda: ndjson(d, with_id=True), "zinc": lambda: bulk(d), "timesketch": lambda: timesketch(d)}
    if kind in lines:
        lines[kind]().write.text(path)
    elif kind in ("csv", "summary_csv"):
        (csv(d) if kind == "csv" else summary_csv(d)).write.option("header", "true").option("sep", ";").csv(path)
    elif kind == "json":
        write_json(d, path)
    elif kind in ("sarif", "layer"):
        made = {"sarif": sarif, "layer": layer}[kind](d)
        Path(path).write_text(json.dumps(made, indent=4, ensure_ascii=False))
    else:
        raise ValueError(f"no export {kind}")


def save(logs: DataFrame, path: str) -> None:
    """The log table as Parquet, ordered by log source for pruning; refuses to overwrite.

    A salt from the whole row is the last key of the ranges, so that one frequent log source fills several files.
    """
    keys = [c for c in ("Channel", "EventID") if c in logs.columns]
    salt = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in logs.columns]), F.lit(1024))
    (logs.repartitionByRange(*keys, salt).sortWithinPartitions(*keys) if keys else logs).write.mode("errorifexists").parquet(path)
