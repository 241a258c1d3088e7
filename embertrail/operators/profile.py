"""What single rules cost and find: for tuning and regression, so each rule runs by itself. Production runs them fused."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame

from .detect import detect
from .rules import Rule

#: From how many milliseconds on a rule counts as very slow and as slow.
VERY_SLOW_MS, SLOW_MS = 500, 100


def profile(logs: DataFrame, rules: list[Rule], dispatch: str | None = "Channel") -> list[dict]:
    """title, matches, ms and mark of every rule, slowest first. One job a rule."""
    out: dict[str, dict] = {}
    for r in rules:
        began = time.perf_counter()
        n = detect(logs, [r], dispatch).matches.count()
        ms = 1000 * (time.perf_counter() - began)
        row = out.setdefault(r.title, {"title": r.title, "matches": 0, "ms": 0.0})
        row["matches"] += n
        row["ms"] += ms
    for row in out.values():
        row["mark"] = "very slow" if row["ms"] >= VERY_SLOW_MS else "slow" if row["ms"] >= SLOW_MS else ""
    return sorted(out.values(), key=lambda x: -x["ms"])


def merged(reports: list[list[dict]]) -> list[dict]:
    """Several files' reports as one: matches and times add up by title."""
    out: dict[str, dict] = {}
    for row in (r for rows in reports for r in rows):
        own = out.setdefault(row["title"], {"title": row["title"], "matches": 0, "ms": 0.0})
        own["matches"] += row["matches"]
        own["ms"] += row["ms"]
    return sorted(out.values(), key=lambda x: -x["ms"])


def total(rows: list[dict]) -> dict:
    return {"ms": sum(r["ms"] for r in rows), "rules": len(rows)}


def throughput(events: int, seconds: float) -> float:
    """Events a second; 0 if no time passed."""
    return events / seconds if seconds > 0 else 0.0


def regression(logs: DataFrame, rules: list[Rule], expected: dict[str, int | str], dispatch: str | None = "Channel") -> list[dict]:
    """title, matches, expected, as_expected of every rule that expected names.

    A number must be met; Positive asks for a match at least, Negative for none. All rules run in one pass.
    """
    named = [r for r in rules if r.title in expected]
    counts = {r["rule_idx"]: r["count"] for r in detect(logs, named, dispatch).matches.groupBy("rule_idx").count().collect()}
    out = []
    for i, r in enumerate(named):
        n, want = counts.get(i, 0), expected[r.title]
        ok = n > 0 if want == "Positive" else n == 0 if want == "Negative" else n == want
        out.append({"title": r.title, "matches": n, "expected": want, "as_expected": ok})
    return out
