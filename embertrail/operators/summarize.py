"""Summaries of detections: small aggregates over the per-rule counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .rules import LEVELS, rank_column

# Tactic tags (hyphens for underscores) and the tactics they mean, in the order of the matrix.
TACTICS = {
    "reconnaissance": "Reconnaissance", "resource-development": "Resource Development", "initial-access": "Initial Access", "execution": "Execution", "persistence": "Persistence",
    "privilege-escalation": "Privilege Escalation", "defense-evasion": "Defense Evasion", "credential-access": "Credential Access", "discovery": "Discovery",
    "lateral-movement": "Lateral Movement", "collection": "Collection", "command-and-control": "Command and Control", "c2": "Command and Control", "exfiltration": "Exfiltration", "impact": "Impact",
}
#: Colours of severities in a layer.
COLOURS = {"critical": "#d13b3b", "high": "#e8793a", "medium": "#f2c744", "low": "#6fb06f", "informational": "#7aa7d9"}


def techniques(tags: Column) -> Column:
    """T1234 or T1234.001 of tags such as attack.t1234.001, each once, in order."""
    found = F.transform(tags, lambda t: F.upper(F.regexp_extract(F.lower(t), r"^attack\.(t\d{4}(?:\.\d{3})?)$", 1)))
    return F.array_distinct(F.filter(found, lambda t: t != ""))


def tactics(tags: Column) -> Column:
    names = F.create_map(*[F.lit(x) for kv in TACTICS.items() for x in kv])
    found = F.transform(F.filter(tags, lambda t: F.lower(t).startswith("attack.")), lambda t: F.try_element_at(names, F.translate(F.regexp_replace(F.lower(t), r"^attack\.", ""), "_", "-")))
    return F.array_distinct(F.array_compact(found))


def severity_totals(counts: DataFrame) -> DataFrame:
    """level, detections, total: rules and rows per level; unknown levels stand together as other."""
    low = F.lower("level")
    return counts.groupBy(F.when(low.isin(LEVELS), low).otherwise("other").alias("level")).agg(F.count("*").alias("detections"), F.sum("count").alias("total"))


def attack_tactics(counts: DataFrame) -> DataFrame:
    """tactic, techniques, hits, rules: hits are summed before techniques are counted."""
    rows = counts.select("rule_idx", "count", F.explode(tactics(F.col("tags"))).alias("tactic"), techniques(F.col("tags")).alias("_t"))
    per = rows.groupBy("tactic").agg(F.sum("count").alias("hits"), F.count_distinct("rule_idx").alias("rules"), F.array_distinct(F.flatten(F.collect_set("_t"))).alias("_t"))
    return per.select("tactic", F.size("_t").cast("long").alias("techniques"), "hits", "rules").orderBy(F.desc("hits"), "tactic")


def navigator(counts: DataFrame) -> DataFrame:
    """technique, tactic, score, level, n_rules, first rules and colour of every technique and tactic."""
    rows = counts.select("*", F.explode(techniques(F.col("tags"))).alias("technique"), tactics(F.col("tags")).alias("_ta")).select("*", F.explode_outer("_ta").alias("tactic"))
    per = rows.groupBy("technique", "tactic").agg(
        F.sum("count").alias("score"),
        F.min(F.struct(rank_column(F.col("level")).alias("r"), F.lower("level").alias("level")))["level"].alias("level"),
        F.count_distinct("rule_idx").alias("n_rules"),
        F.slice(F.array_sort(F.collect_set(F.concat_ws(": ", "title", F.col("count").cast("string")))), 1, 5).alias("top_rules"),
    )
    colour = F.create_map(*[F.lit(x) for kv in COLOURS.items() for x in kv])
    return per.withColumn("color", F.coalesce(F.try_element_at(colour, F.col("level")), F.lit(COLOURS["informational"])))


def roll_up(counts: DataFrame) -> DataFrame:
    """By title: the sum of the counts, level and tags of the first rule of that title."""
    first = F.min(F.struct("rule_idx", "level", "tags"))
    return counts.groupBy("title").agg(F.sum("count").alias("count"), first["level"].alias("level"), first["tags"].alias("tags")).orderBy(rank_column(F.col("level")), F.desc("count"), "title")


def file_stats(logs: DataFrame, matches: DataFrame, file: str = "source_file") -> DataFrame:
    """file, events, detections (rules that matched)."""
    found = matches.groupBy(file).agg(F.count_distinct("rule_idx").alias("detections"))
    return logs.groupBy(file).agg(F.count("*").alias("events")).join(found, file, "left").select(file, "events", F.coalesce("detections", F.lit(0)).cast("long").alias("detections"))


def rule_coverage(counts: DataFrame, n_rules: int) -> DataFrame:
    return counts.agg(F.count("*").alias("matched"), F.lit(n_rules).cast("long").alias("total"), (F.count("*") * 100.0 / max(1, n_rules)).alias("percent"))


def filter_efficiency(events: DataFrame, keep: Column) -> DataFrame:
    kept = F.count_if(keep)
    return events.agg(kept.alias("kept"), (F.count("*") - kept).alias("filtered"), (kept * 100.0 / F.greatest(F.count("*"), F.lit(1))).alias("percent_kept"))


def top(counts: DataFrame, n: int = 5) -> DataFrame:
    return counts.orderBy(rank_column(F.col("level")), F.desc("count"), "rule_idx").limit(n)
