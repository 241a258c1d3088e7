"""The library's front: read, flatten, detect, summarise, export."""

from __future__ import annotations

import dataclasses

from pyspark.sql import DataFrame, SparkSession

from .config import Mapping
from .operators import export as sinks
from .operators import rules as R
from .operators.detect import Detections, detect
from .operators.flatten import flatten
from .plans.predicates import run_select
from .sources import formats, readers


class Engine:
    """One run: ``Engine(spark).load("logs/", "json", rules).detect().export("ndjson", "out")``."""

    def __init__(self, spark: SparkSession, mapping: Mapping | None = None, time_field: str | None = None):
        self.spark, self.mapping, self.time_field = spark, mapping or Mapping(), time_field
        self.rules: list[R.Rule] = []
        self.notes: list[str] = []
        self.logs: DataFrame | None = None

    def ruleset(self, *paths: str, pipelines: list[str] | None = None, drop: list[str] | None = None) -> Engine:
        """Add rulesets (JSON) and Sigma files or folders; duplicates go, the order is by severity."""
        found = list(self.rules)
        for p in paths:
            made, note = R.load_json(p) if p.endswith(".json") else R.load_sigma([p], pipelines)
            found += made
            self.notes += [note] if isinstance(note, str) else note or []
        self.rules = R.without(R.by_level(R.dedupe(found)), drop or [])
        return self

    def load(self, path: str | list[str], fmt: str | None = None, after: str | None = None, before: str | None = None, filter_early: bool = True, hashes: bool = False, **options: object) -> Engine:
        """Read and flatten; without a format the files (local ones) are looked at."""
        if fmt is None:
            seen = formats.detect_batch([path] if isinstance(path, str) else path)
            fmt, self.time_field = seen.format, self.time_field or seen.time_field
        events = readers.read(self.spark, path, fmt, **options)
        if fmt == "saved":
            self.logs = events
        else:
            if self.time_field:  # the found or given time field comes first; its column has letters and digits only
                own = self.mapping.fields.get(self.time_field) or "".join(c for c in self.time_field if c.isalnum())
                self.mapping = dataclasses.replace(self.mapping, time_fields=[own, *[t for t in self.mapping.time_fields if t != own]])
            self.logs = flatten(events, self.mapping, hashes, event_filter=R.EventFilter.of(self.rules) if filter_early else None, after=after, before=before)
        return self

    def detect(self, limit: int | None = None, scope: list[str] | None = None, dispatch: str | None = "Channel") -> Detections:
        if self.logs is None:
            raise ValueError("load() comes first")
        return detect(self.logs, self.rules, dispatch, limit, scope=scope, time_field=self.time_field)

    def sql(self, text: str) -> DataFrame:
        """One rule statement over the log table."""
        if self.logs is None:
            raise ValueError("load() comes first")
        return run_select(self.logs, text)

    def save(self, path: str) -> None:
        if self.logs is None:
            raise ValueError("load() comes first")
        sinks.save(self.logs, path)
