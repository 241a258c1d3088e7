"""Run a ruleset over the log table in one pass.

Every statement of every rule becomes one Boolean column over the same scan. Rules that require a value of the log
source column are dispatched by it inside the projection: their predicates are evaluated only for rows of that value. The
folded text of each column is computed once, the hits are collected into one string and split into rows. A statement
that cannot match this data (a missing column) is left out and reported.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.strings import ascii_lower
from ..plans import predicates as P
from .correlate import correlate
from .rules import Rule, meta_frame, rank_column, source_keys


@dataclass
class Detections:
    """matches: rule_idx, query_idx and the columns of the log table; rules: the metadata; notes: statements left out."""

    matches: DataFrame
    rules: DataFrame
    ruleset: list[Rule]
    notes: list[str] = field(default_factory=list)
    limit: int | None = None

    def counts(self) -> DataFrame:
        """rule_idx, title, id, description, level, tags, count: the rules that matched, at most limit rows each if one is set."""
        out = self.matches.groupBy("rule_idx").agg(F.count("*").alias("count"))
        if self.limit is not None and self.limit >= 0:
            out = out.where(F.col("count") <= self.limit)
        return out.join(F.broadcast(self.rules), "rule_idx").select("rule_idx", "title", "id", "description", "level", "tags", "count")

    def kept(self) -> DataFrame:
        """The matches of the rules within the limit."""
        if self.limit is None or self.limit < 0:
            return self.matches
        return self.matches.join(F.broadcast(self.counts().select("rule_idx")), "rule_idx", "left_semi")

    def sorted_counts(self) -> DataFrame:
        return self.counts().orderBy(rank_column(F.col("level")), F.desc("count"), "rule_idx")


Statement = tuple[int, int, object]


def _hits(df: DataFrame, groups: list[tuple[Column | None, list[Statement]]], wide: int) -> DataFrame:
    """rule_idx, query_idx and all columns, for the rows of df that match.

    groups: statements (rule, query, tree) with the condition on the log source that they need, if any. It stands in front
    of a chunk of them, so their predicates are not looked at for other rows.
    """
    fields = {f.name.lower(): f for f in df.schema.fields}
    trees = [t for _, ss in groups for _, _, t in ss]
    used = [fields[n.lower()] for n in dict.fromkeys(n for t in trees for n in P.names(t)) if n.lower() in fields]
    folded = {f.name.lower(): f"_low{i}" for i, f in enumerate(used) if isinstance(f.dataType, T.StringType)}
    low = df.select("*", *[ascii_lower(F.col(f"`{f.name}`")).alias(folded[f.name.lower()]) for f in used if f.name.lower() in folded])
    c = P.Compiler(df.schema, folded)
    marks = []
    for source, statements in groups:
        for i in range(0, len(statements), wide):
            mark = F.concat_ws(",", *[F.when(c.condition(t), F.lit(f"{r}:{q}")) for r, q, t in statements[i : i + wide]])
            marks.append(F.nullif(mark if source is None else F.when(source, mark), F.lit("")))
    hit = low.select(*[F.col(f"`{x}`") for x in df.columns], F.nullif(F.concat_ws(",", *marks), F.lit("")).alias("_hits"))
    # The outer form, with the filter behind it: a filter before it would work all predicates out twice.
    out = hit.select(F.explode_outer(F.split("_hits", ",")).alias("_hit"), *[F.col(f"`{x}`") for x in df.columns]).where("_hit is not null")
    return out.select(F.split_part("_hit", F.lit(":"), F.lit(1)).cast("int").alias("rule_idx"), F.split_part("_hit", F.lit(":"), F.lit(2)).cast("int").alias("query_idx"), *[F.col(f"`{x}`") for x in df.columns])


def detect(logs: DataFrame, rules: list[Rule], dispatch: str | None = "Channel", limit: int | None = None, wide: int = 50, scope: list[str] | None = None, time_field: str | None = None) -> Detections:
    """Run all rules. scope: columns added to the groups of correlations (per-file mode). dispatch: the log source column."""
    notes: list[str] = []
    plain: list[Statement] = []
    frames: list[DataFrame] = []
    for i, r in enumerate(rules):
        try:
            if r.correlation:
                found = correlate(logs, r.correlation, scope=scope, time_field=time_field)
                frames.append(found.select(F.lit(i).alias("rule_idx"), F.lit(0).alias("query_idx"), "*"))
            elif not r.plain:
                for q, sql in enumerate(r.rule):
                    frames.append(P.run_select(logs, sql).select(F.lit(i).alias("rule_idx"), F.lit(q).alias("query_idx"), "*"))
            else:
                for q, tree in enumerate(r.conditions()):
                    why = P.never(logs.schema, tree)
                    notes.append(f"{r.title}: {why}") if why else plain.append((i, q, tree))
        except (P.Unsupported, P.NoRows) as e:
            notes.append(f"{r.title}: {e}")
    names = {c.lower(): c for c in logs.columns}
    keyed: dict[str, list[Statement]] = {}
    rest: list[Statement] = []
    for s in plain:
        keys = source_keys(s[2], dispatch) if dispatch and dispatch.lower() in names else None
        if keys is None:
            rest.append(s)
        for k in keys or []:
            keyed.setdefault(k, []).append(s)
    groups: list[tuple[Column | None, list[Statement]]] = [(None, rest)] if rest else []
    if keyed:
        key = ascii_lower(F.col(f"`{names[dispatch.lower()]}`").cast("string"))  # type: ignore[union-attr]
        # Values with the same rules share a group; a statement whose values differ in their rules stands in several, and a
        # row has one value, so nothing is found twice.
        same: dict[tuple, list[str]] = {}
        for k, ss in keyed.items():
            same.setdefault(tuple((r, q) for r, q, _ in ss), []).append(k)
        groups += [(key.isin(ks), keyed[ks[0]]) for ks in same.values()]
    if groups:
        frames.append(_hits(logs, groups, wide))
    empty = logs.select(F.lit(0).alias("rule_idx"), F.lit(0).alias("query_idx"), "*").limit(0)
    matches = frames[0] if frames else empty
    for f in frames[1:]:
        matches = matches.unionByName(f, allowMissingColumns=True)
    return Detections(matches, meta_frame(logs.sparkSession, rules), rules, notes, limit)
