"""Rules over a stream: an extension, since the log table is otherwise a bounded set.

Plain rules are stateless, so each micro-batch goes through the same one-pass detection. Grouped counts run as a
watermarked window aggregation.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.strings import ascii_lower
from ..operators.correlate import holds
from ..operators.detect import detect
from ..operators.rules import Rule
from ..plans import predicates as P
from ..plans.sigma import Correlation


def run(stream: DataFrame, rules: list[Rule], sink: Callable[[DataFrame, int], None], checkpoint: str, dispatch: str | None = "Channel") -> StreamingQuery:
    """Detect in every micro-batch and hand the matches to sink."""
    return stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda df, n: sink(detect(df, rules, dispatch).matches, n)).start()


def event_count(stream: DataFrame, rule: Correlation, time: str, late: str = "10 minutes") -> DataFrame:
    """Groups that meet an event_count condition within tumbling windows of the time span; time must be a timestamp column."""
    c = P.Compiler(stream.schema)
    hit = F.lit(False)
    for base in rule.meta["base"].values():
        for tree in base.conditions():
            hit = hit | F.coalesce(c.condition(tree), F.lit(False))
    keys = [ascii_lower(F.col(f"`{g}`").cast("string")).alias(g) for g in rule.group_by]
    rows = stream.withWatermark(time, late).where(hit).groupBy(F.window(time, f"{rule.timespan} seconds"), *keys).agg(F.count("*").alias("event_count"))
    return rows.where(holds(F.col("event_count"), rule.op, rule.number))
