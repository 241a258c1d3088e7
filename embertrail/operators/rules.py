"""Rules and rulesets: loading, deduplication, order, title filters, the event filter that a ruleset implies, rule tests."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.strings import ascii_lower, fold
from ..plans import predicates as P
from ..plans import sigma

#: Severities, most severe first.
LEVELS = ["critical", "high", "medium", "low", "informational"]


@dataclass
class Rule:
    title: str = "Unnamed Rule"
    id: str = ""
    level: str = "unknown"
    description: str = ""
    tags: list[str] = field(default_factory=list)
    rule: list[str] = field(default_factory=list)
    filename: str = ""
    channel: list[str] = field(default_factory=list)
    eventid: list[int] = field(default_factory=list)
    status: str = ""
    author: str = ""
    falsepositives: list[str] = field(default_factory=list)
    correlation: sigma.Correlation | None = None
    trees: list[object] | None = None  # of a Sigma rule; SQL is parsed on demand

    def conditions(self) -> list[object]:
        """One tree per statement; a statement without WHERE matches everything."""
        if self.trees is not None:
            return self.trees
        return [s.where if s.where is not None else P.Lit(1) for s in map(P.parse, self.rule)]

    @property
    def plain(self) -> bool:
        """Every statement only filters rows."""
        if self.trees is not None:
            return True
        parsed = [P.parse(s) for s in self.rule]
        return all(s.items is None and not s.distinct and not s.group and s.having is None and s.limit is None for s in parsed)


def rank(level: str | None) -> int:
    level = (level or "informational").lower()
    return LEVELS.index(level) if level in LEVELS else len(LEVELS)


def rank_column(level: Column) -> Column:
    low = F.lower(level)
    out = F.when(level.isNull(), LEVELS.index("informational"))
    for i, x in enumerate(LEVELS):
        out = out.when(low == x, i)
    return out.otherwise(len(LEVELS))


def from_dict(d: dict) -> Rule | None:
    """None for what is no rule: not a map, or without SQL."""
    if not isinstance(d, dict) or not d.get("rule"):
        return None
    sql = [d["rule"]] if isinstance(d["rule"], str) else list(d["rule"])
    known = {k: d[k] for k in ("id", "description", "filename", "status", "author") if d.get(k) is not None}
    return Rule(d.get("title") or "Unnamed Rule", level=d.get("level") or "unknown", tags=list(d.get("tags") or []), rule=sql, channel=[c for c in d.get("channel") or []], eventid=[e for e in d.get("eventid") or []], falsepositives=list(d.get("falsepositives") or []), **known)


def load_json(path: str) -> tuple[list[Rule], str | None]:
    """The rules of a ruleset file; an unreadable file gives none and the reason."""
    try:
        data = json.loads(Path(path).read_text())
    except (OSError, ValueError) as e:
        return [], str(e)
    return [r for r in map(from_dict, data if isinstance(data, list) else [data]) if r], None


def load_sigma(paths: list[str], pipelines: list[str | sigma.Pipeline] | None = None, columns: list[str] | None = None) -> tuple[list[Rule], list[str]]:
    """Sigma rules and correlations. Base rules that are only referred to by a correlation are compiled, not emitted."""
    docs, skipped = sigma.load(paths)
    return compile_docs(docs, pipelines, columns, skipped)


def compile_docs(docs: list[dict], pipelines: list[str | sigma.Pipeline] | None = None, columns: list[str] | None = None, skipped: list[str] | None = None) -> tuple[list[Rule], list[str]]:
    lines = [sigma.PIPELINES[p] if isinstance(p, str) else p for p in pipelines or []]
    skipped = skipped if skipped is not None else []
    made: dict[str, Rule] = {}
    out: list[Rule] = []
    referred: set[str] = set()
    generating: set[str] = set()
    for d in docs:
        if "correlation" in d:
            c = d["correlation"]
            names = c.get("rules") or []
            (generating if c.get("generate") or d.get("generate") else referred).update([names] if isinstance(names, str) else names)
    for d in docs:
        try:
            extra = {k: d[k] for k in ("id", "description", "filename", "status", "author") if isinstance(d.get(k), str)}
            base = Rule(d["title"], level=d.get("level") or "unknown", tags=list(d.get("tags") or []), **extra)
            if "correlation" in d:
                base.correlation = sigma.correlation(d)
                out.append(base)
                continue
            base.trees = sigma.compile_rule(d, lines, columns)
            base.rule = [repr(t) for t in base.trees]
            keys = {str(d.get(k)) for k in ("name", "id") if d.get(k)}
            made |= dict.fromkeys(keys, base)
            if not keys & referred or keys & generating:
                out.append(base)
        except (P.Unsupported, KeyError, TypeError, ValueError) as e:
            skipped.append(f"{d.get('title')}: {e}")
    for r in [r for r in out if r.correlation]:
        missing = [n for n in r.correlation.rules if n not in made]
        if missing:
            skipped.append(f"{r.title}: no rule {', '.join(missing)}")
            out.remove(r)
        else:
            r.correlation.meta = {"base": {n: made[n] for n in r.correlation.rules}}
    return out, skipped


def dedupe(rules: list[Rule]) -> list[Rule]:
    """The first rule of each tuple of statements."""
    seen: set[object] = set()
    out = []
    for r in rules:
        key = tuple(r.rule) if not r.correlation else ("correlation", r.title)
        if key and key not in seen:
            seen.add(key)
            out.append(r)
    return out


def by_level(rules: list[Rule]) -> list[Rule]:
    return sorted(rules, key=lambda r: rank(r.level))


def without(rules: list[Rule], filters: list[str]) -> list[Rule]:
    """Rules whose title holds none of the filters, in the same case."""
    return [r for r in rules if not any(f in r.title for f in filters)]


def save_json(rules: list[Rule], path: str) -> None:
    keys = ("title", "id", "status", "description", "author", "tags", "falsepositives", "level", "rule", "filename", "channel", "eventid")
    Path(path).write_text(json.dumps([{k: getattr(r, k) for k in keys} for r in rules], indent=4))


def column_frequency(rules: list[Rule], top: int) -> list[tuple[str, int]]:
    """The columns that most statements refer to, ties by name."""
    count: dict[str, int] = {}
    for r in rules:
        for c in r.trees if r.trees is not None else [P.parse(s) for s in r.rule]:
            for n in P.names(c) if r.trees is not None else P.names([c.items or [], c.where]):
                count[n] = count.get(n, 0) + 1
    return sorted(count.items(), key=lambda kv: (-kv[1], kv[0]))[:top]


# --- event filter ------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class EventFilter:
    """The channels and event ids that some rule asks for. Enabled only if no rule asks for neither."""

    channels: frozenset[str]
    eventids: frozenset[int]
    enabled: bool

    @staticmethod
    def of(rules: list[Rule]) -> EventFilter:
        plain = [r for r in rules if not r.correlation]
        channels = frozenset(fold(str(c)) for r in plain for c in r.channel)
        ids = frozenset(int(e) for r in plain for e in r.eventid)
        return EventFilter(channels, ids, bool(channels and ids) and all(r.channel or r.eventid for r in plain))

    def keeps(self, channel: Column, eventid: Column) -> Column:
        """True for events to process; a missing channel or id keeps the event. The two checks are independent."""
        if not self.enabled:
            return F.lit(True)
        number = eventid.try_cast("bigint")
        both = F.lower(channel).isin(sorted(self.channels)) & number.isin(sorted(self.eventids))
        return channel.isNull() | number.isNull() | both


# --- rule tests --------------------------------------------------------------------------------------------------


def run_tests(spark: SparkSession, rules: list[Rule], cases: list[dict]) -> list[dict]:
    """Whether each rule finds a true positive and no true negative of its case (by title, else by id); None without a case."""
    by = {str(c["title"]): c for c in cases if c.get("title")} | {str(c["id"]): c for c in cases if c.get("id")}
    out = []
    for r in rules:
        case = by.get(r.title) or by.get(r.id)
        if case is None:
            out.append({"title": r.title, "true_positive": None, "true_negative": None})
            continue
        rows = [("p", e) for e in case.get("true_positive") or []] + [("n", e) for e in case.get("true_negative") or []]
        keys = list(dict.fromkeys(k for _, e in rows for k in e))
        schema = T.StructType([T.StructField("_polarity", T.StringType()), *[T.StructField(k, T.StringType()) for k in keys]])
        try:
            df = spark.createDataFrame([(p, *[None if e.get(k) is None else str(e[k]) for k in keys]) for p, e in rows], schema)
            hit = F.lit(False)
            for tree in r.conditions():
                if P.never(df.schema, tree) is None:
                    hit = hit | F.coalesce(P.Compiler(df.schema).condition(tree), F.lit(False))
            found = {x["_polarity"] for x in df.where(hit).select("_polarity").distinct().collect()}
            out.append({"title": r.title, "true_positive": "p" in found, "true_negative": "n" not in found})
        except P.Unsupported:
            out.append({"title": r.title, "true_positive": False, "true_negative": False})
    return out


def meta_frame(spark: SparkSession, rules: list[Rule]) -> DataFrame:
    """rule_idx, title, id, description, level, tags, n_queries: a small frame, one row a rule."""
    schema = "rule_idx int, title string, id string, description string, level string, tags array<string>, n_queries int"
    return spark.createDataFrame([(i, r.title, r.id, r.description, r.level, list(r.tags), len(r.rule)) for i, r in enumerate(rules)], schema)


def source_keys(tree: object, column: str) -> list[str] | None:
    """The folded values that a column must have for the tree to hold; None if it may have any."""
    if isinstance(tree, P.And):
        for p in tree.parts:
            if (got := source_keys(p, column)) is not None:
                return got
        return None
    if isinstance(tree, P.Or):
        parts = [source_keys(p, column) for p in tree.parts]
        return None if any(p is None for p in parts) else sorted({x for p in parts for x in p or []})
    if isinstance(tree, P.Compare) and tree.op == "=" and isinstance(tree.left, P.Name) and tree.left.name.lower() == column.lower() and isinstance(tree.right, P.Lit) and tree.right.value is not None:
        return [fold(str(tree.right.value))]
    if isinstance(tree, P.In) and isinstance(tree.left, P.Name) and tree.left.name.lower() == column.lower() and all(isinstance(x, P.Lit) and x.value is not None for x in tree.items):
        return [fold(str(x.value)) for x in tree.items]
    return None


def text_key(c: Column) -> Column:
    return ascii_lower(c.cast("string"))


