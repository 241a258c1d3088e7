"""Correlation rules as aggregations over the log table.

event_count and value_count group the rows of the base rules; by default over the whole table (the time span is not
enforced), or, windowed, over tumbling spans of time. temporal asks that so many different base rules match within a
span after a row, temporal_ordered that all of them do in their order (at one time, in the order of their names). Group
keys compare without regard to ASCII case and the smallest spelling stands for the group. No list is collected; a hot
group, or the whole table where there is none, is split into cells of one span's length.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.strings import ascii_lower
from ..plans import predicates as P
from ..plans.sigma import Correlation


def holds(value: Column, op: str, number: int) -> Column:
    return {">": value > number, ">=": value >= number, "<": value < number, "<=": value <= number, "=": value == number, "!=": value != number}[op]


def _seconds(logs: DataFrame, time_field: str) -> Column:
    kind = logs.schema[time_field].dataType
    c = F.col(f"`{time_field}`")
    if isinstance(kind, (T.LongType, T.IntegerType, T.DoubleType)):
        return c.cast("double")
    return F.unix_micros(c.try_cast("timestamp")) / 1e6


def _match(logs: DataFrame, trees: list[object]) -> Column:
    c = P.Compiler(logs.schema)
    found = [F.coalesce(c.condition(t), F.lit(False)) for t in trees if P.never(logs.schema, t) is None]
    return reduce(lambda a, b: a | b, found, F.lit(False))


def correlate(logs: DataFrame, rule: Correlation, scope: list[str] | None = None, time_field: str | None = None, windowed: bool = False) -> DataFrame:
    """The groups that meet the condition: group columns, then event_count, value_count or the rules and times of the span."""
    names = {c.lower(): c for c in logs.columns}
    groups = [*(scope or []), *rule.group_by]
    for g in [*groups, *([rule.of] if rule.of else [])]:
        if g.lower() not in names:
            raise P.NoRows(f"no such column: {g}")
    groups = [names[g.lower()] for g in groups]
    base = {n: r.conditions() for n, r in rule.meta["base"].items()}
    text = {f.name for f in logs.schema.fields if isinstance(f.dataType, T.StringType)}
    keys = [(ascii_lower(F.col(f"`{g}`")) if g in text else F.col(f"`{g}`")).alias(f"_k{i}") for i, g in enumerate(groups)]
    shown = [F.min(F.col(f"`{g}`")).alias(g) for g in groups]
    if rule.kind in ("event_count", "value_count"):
        rows = logs.where(_match(logs, [t for ts in base.values() for t in ts]))
        if windowed:
            t = _seconds(logs, names[(time_field or "SystemTime").lower()])
            keys = [*keys, (F.floor(t / rule.timespan) * rule.timespan).cast("long").alias("window_start")]
        if rule.kind == "event_count":
            value = F.count("*").alias("event_count")
        else:
            of = names[str(rule.of).lower()]
            value = F.count_distinct(ascii_lower(F.col(f"`{of}`")) if of in text else F.col(f"`{of}`")).alias("value_count")
        out = rows.groupBy(*keys).agg(*shown, value) if keys else rows.agg(value)
        return out.where(holds(F.col(rule.kind), rule.op, rule.number)).drop(*[f"_k{i}" for i in range(len(groups))])
    t = _seconds(logs, names[(time_field or "SystemTime").lower()])
    tags = F.array_compact(F.array(*[F.when(_match(logs, ts), F.lit(n)) for n, ts in base.items()]))
    rows = logs.select(*[F.col(f"`{g}`") for g in groups], *keys, t.alias("_t"), F.explode(tags).alias("_rule")).where(F.col("_t").isNotNull())
    marks = [f"_k{i}" for i in range(len(groups))]
    # Cells of one span's length: what lies within a span of a row is in its cell or the next one, so every row is dealt to
    # its own cell and, as a follower, to the one before. A hot group is many cells.
    cell = F.floor(F.col("_t") / max(rule.timespan, 1))
    dealt = rows.withColumn("_start", F.explode(F.array(F.lit(True), F.lit(False)))).withColumn("_cell", F.when(F.col("_start"), cell).otherwise(cell - 1))
    # From the end backwards with running minima, which cost one step a row however many rows a span holds.
    back = Window.partitionBy(*marks, "_cell").orderBy(F.desc("_t"), F.desc("_rule")).rowsBetween(Window.unboundedPreceding, 0)
    onward = Window.partitionBy(*marks, "_cell").orderBy(F.desc("_t")).rangeBetween(Window.unboundedPreceding, 0)
    until = F.col("_t") + rule.timespan
    order = list(base)
    ends = F.when(F.col("_rule") == order[-1], F.col("_t"))
    if rule.kind == "temporal_ordered":  # the earliest end of the rules from this row's on, in their order
        for this, after in zip(reversed(order[:-1]), reversed(order[1:])):
            dealt = dealt.withColumn("_end", ends)
            ends = F.when(F.col("_rule") == this, F.min(F.when(F.col("_rule") == after, F.col("_end"))).over(back)).otherwise(F.when(F.col("_rule") == after, F.col("_end")))
    dealt = dealt.withColumn("_end", ends)
    follow = [(F.min(F.when(F.col("_rule") == n, F.col("_t"))).over(onward)).alias(f"_next{i}") for i, n in enumerate(order)]
    seen = dealt.select("*", *follow, F.min(F.when(F.col("_rule") == order[0], F.col("_end"))).over(onward).alias("_done")).where("_start")
    seen = seen.withColumn("_rules", reduce(lambda a, b: a + b, [F.when(F.col(f"_next{i}") <= until, 1).otherwise(0) for i in range(len(order))]))
    good = holds(F.col("_rules"), rule.op, rule.number) if rule.kind == "temporal" else F.col("_done") <= until
    hit = seen.where(good)
    return hit.withColumn("_all", F.lit(1)).groupBy(*(marks or ["_all"])).agg(*shown, F.count("*").alias("event_count"), F.min("_t").cast("long").alias("first_time"), F.max("_rules").alias("rule_count")).select(*[F.col(f"`{g}`") for g in groups], "event_count", "first_time", "rule_count")
