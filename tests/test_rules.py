import json

import pytest
import yaml

from embertrail.operators import export, rules, summarize
from embertrail.operators.correlate import correlate
from embertrail.operators.detect import detect
from embertrail.plans import sigma

EVENTS = [
    (1, "Security", 4688, "cmd.exe /c whoami", "C:\\Windows\\cmd.exe", "2024-01-01T00:00:00", "a.json"), (2, "Security", 4625, None, None, "2024-01-01T00:01:00", "a.json"),
    (3, "Microsoft-Windows-Sysmon/Operational", 1, "POWERSHELL -enc x", "C:\\ps\\powershell.exe", "2024-01-01T00:02:00", "b.json"), (4, "Security", 4625, None, None, "2024-01-01T00:03:00", "b.json"),
    (5, "Security", 4625, None, "c:\\windows\\CMD.EXE", "2024-01-02T00:03:00", "b.json"),
]


@pytest.fixture(scope="module")
def logs(spark):
    return spark.createDataFrame(EVENTS, "row_id int, Channel string, EventID bigint, CommandLine string, Image string, SystemTime string, source_file string")


def rule(title, *where, level="high", **more):
    return rules.Rule(title, level=level, rule=[f"SELECT * FROM logs WHERE {w}" for w in where], **more)


def ids(d):
    return sorted((r["rule_idx"], r["query_idx"], r["row_id"]) for r in d.matches.collect())


def test_one_pass_equals_rule_by_rule(logs):
    rs = [
        rule("a", "Channel = 'security' AND EventID = 4625"), rule("b", "CommandLine LIKE '%ENC%'"), rule("c", "Channel IN ('Security') AND CommandLine LIKE '%who%'", "EventID = 4688"),
        rule("d", "Channel = 'Microsoft-Windows-Sysmon/Operational' OR EventID = 4688"), rule("e", "nowhere = 1"),
    ]
    want = [(0, 0, 2), (0, 0, 4), (0, 0, 5), (1, 0, 3), (2, 0, 1), (2, 1, 1), (3, 0, 1), (3, 0, 3)]
    for dispatch in ("Channel", None):
        d = detect(logs, rs, dispatch)
        assert ids(d) == want
        assert d.notes == ["e: no such column: nowhere"]


def test_limit_drops_whole_rules(logs):
    d = detect(logs, [rule("many", "EventID = 4625"), rule("one", "EventID = 1")], limit=2)
    assert [r["title"] for r in d.counts().collect()] == ["one"]
    assert {r["rule_idx"] for r in d.kept().collect()} == {1}


def test_order_dedupe_and_filters():
    rs = [rule("i", "a=1", level="informational"), rule("x", "b=1", level="odd"), rule("c", "c=1", level="critical"), rule("again", "a=1")]
    assert [r.title for r in rules.by_level(rules.dedupe(rs))] == ["c", "i", "x"]
    assert [r.title for r in rules.without(rs, ["agai"])] == ["i", "x", "c"]


def test_event_filter(spark):
    f = rules.EventFilter.of([rule("a", "x=1", channel=["Security"], eventid=[1]), rule("b", "y=1", channel=["System"], eventid=[2])])
    assert f.enabled and not rules.EventFilter.of([rule("a", "x=1", channel=["S"], eventid=[1]), rule("b", "y=1")]).enabled
    df = spark.createDataFrame([("SECURITY", "2"), ("other", "1"), (None, "9"), ("Security", "abc"), ("Security", "3")], "c string, e string")
    assert [r[0] for r in df.select(f.keeps(df.c, df.e)).collect()] == [True, False, True, True, False]


def test_rule_tests(spark):
    cases = [{"title": "a", "true_positive": [{"x": "1"}], "true_negative": [{"x": "2"}]}, {"title": "b", "true_positive": [{"x": "2"}], "true_negative": [{"x": "1"}]}]
    got = rules.run_tests(spark, [rule("a", "x = 1"), rule("b", "x = 1"), rule("none", "x = 3")], cases)
    assert [(g["true_positive"], g["true_negative"]) for g in got] == [(True, True), (False, False), (None, None)]


SIGMA = """
title: Base
name: base
logsource: {product: windows, service: security}
detection: {sel: {EventID: 4625}, condition: sel}
---
title: Many
correlation: {type: event_count, rules: [base], group-by: [Channel], timespan: 5m, condition: {gte: 3}}
---
title: Shell
level: high
logsource: {product: windows, category: process_creation}
detection:
  sel: {'CommandLine|contains': ['enc', 'dec'], 'Image|endswith': '\\powershell.exe'}
  not_this: {EventID|gt: 100}
  condition: sel and not 1 of not_*
---
just: text
"""


def test_sigma_and_correlation(tmp_path, logs):
    (tmp_path / "r.yml").write_text(SIGMA)
    made, skipped = rules.load_sigma([str(tmp_path)], ["sysmon", "windows-logsources"])
    assert [r.title for r in made] == ["Many", "Shell"] and len(skipped) == 1
    d = detect(logs, made)
    assert {(r["title"], r["count"]) for r in d.counts().collect()} == {("Many", 1), ("Shell", 1)}
    row = correlate(logs, made[0].correlation).first()
    assert (row["Channel"], row["event_count"]) == ("Security", 3)
    assert correlate(logs, made[0].correlation, windowed=True).count() == 0
    assert correlate(logs, made[0].correlation, scope=["source_file"]).count() == 0


def test_temporal(logs):
    docs = list(yaml.safe_load_all(SIGMA))[:1] + [
        {"title": "P", "name": "proc", "logsource": {"product": "windows"}, "detection": {"s": {"EventID": 4688}, "condition": "s"}},
        {"title": "T", "correlation": {"type": "temporal", "rules": ["base", "proc"], "group-by": ["Channel"], "timespan": "2m"}},
        {"title": "O", "correlation": {"type": "temporal_ordered", "rules": ["proc", "base"], "group-by": ["Channel"], "timespan": "2m"}},
        {"title": "R", "correlation": {"type": "temporal_ordered", "rules": ["base", "proc"], "group-by": ["Channel"], "timespan": "2m"}},
    ]
    made, _ = rules.compile_docs(docs)
    assert [correlate(logs, r.correlation).count() for r in made] == [1, 1, 0]


@pytest.mark.parametrize(("value", "hit"), [("192.168.1.0/24", True), ("192.168.0.0/16", True), ("192.168.0.0/20", True), ("10.0.0.0/8", False), ("192.168.1.7/32", True), ("192.168.1.8/29", False)])
def test_cidr(spark, value, hit):
    trees = sigma.compile_rule({"detection": {"s": {"ip|cidr": value}, "condition": "s"}})
    df = spark.createDataFrame([("192.168.1.7",)], "ip string")
    from embertrail.plans.predicates import Compiler

    assert df.where(Compiler(df.schema).condition(trees[0])).count() == int(hit)


def test_exports(tmp_path, logs):
    d = detect(logs, [rule("a", "EventID = 4625", id="1", tags=["attack.t1110.001", "attack.credential_access"]), rule("b", "EventID = 1", level="critical", tags=["attack.T1059"])])
    lines = [json.loads(r["value"]) for r in export.ndjson(d, with_id=True, with_level=True).collect()]
    assert len(lines) == 4 and all("CommandLine" not in x for x in lines if x["title"] == "a")
    assert export.bulk(d).count() == 8
    assert export.csv(d).columns[:4] == ["rule_title", "rule_description", "rule_level", "rule_count"]
    assert [r["ruleId"] for r in export.sarif(d)["runs"][0]["results"]] == ["b", "1"]
    assert {(t["techniqueID"], t["score"], t.get("tactic")) for t in export.layer(d)["techniques"]} == {("T1110.001", 3, "credential-access"), ("T1059", 1, None)}
    assert [x["count"] for x in sorted(export.nested_json(d), key=lambda x: x["title"])] == [3, 1]
    export.export(d, "json", str(tmp_path / "all.json"))
    assert json.loads((tmp_path / "all.json").read_text()) == export.nested_json(d)
    export.export(detect(logs, [rule("none", "EventID = 77")]), "json", str(tmp_path / "none.json"))
    assert json.loads((tmp_path / "none.json").read_text()) == []
    export.export(d, "ndjson", str(tmp_path / "out"))
    with pytest.raises(Exception, match="already exists"):
        export.export(d, "ndjson", str(tmp_path / "out"))
    assert {r["level"]: r["total"] for r in summarize.severity_totals(d.counts()).collect()} == {"high": 3, "critical": 1}


def brute_temporal(rows, order, span, kind, least):
    """Rows (group, seconds, rule): group to (events, first time, most rules)."""
    out = {}
    for g, t, _ in rows:
        near = sorted((u, r) for h, u, r in rows if h == g and t <= u <= t + span)
        have, n = len({r for _, r in near}), 0
        for _, r in near:
            n += n < len(order) and r == order[n]
        if have >= least if kind == "temporal" else n == len(order):
            k, first, most = out.get(g, (0, t, 0))
            out[g] = (k + 1, min(first, t), max(most, have))
    return out


@pytest.mark.parametrize("kind", ["temporal", "temporal_ordered"])
@pytest.mark.parametrize("grouped", [True, False])
@pytest.mark.parametrize("span", [1, 7, 40])
def test_temporal_against_brute_force(spark, kind, grouped, span):
    import random

    rng = random.Random(span)
    rows = [(rng.choice("xxxxy") if grouped else "", rng.randrange(-20, 300) if rng.random() < 0.9 else 100, rng.choice("bac")) for _ in range(150)]
    df = spark.createDataFrame([(g, t, r) for g, t, r in rows] + [("x", None, "a")], "host string, at long, tag string")
    docs = [{"title": n, "name": n, "logsource": {}, "detection": {"s": {"tag": n}, "condition": "s"}} for n in "bac"]
    corr = {"type": kind, "rules": ["b", "a", "c"], "timespan": f"{span}s", "condition": {"gte": 2}} | ({"group-by": ["host"]} if grouped else {})
    made, _ = rules.compile_docs([*docs, {"title": "T", "correlation": corr}])
    found = correlate(df, next(r for r in made if r.correlation).correlation, time_field="at").collect()
    got = {r["host"] if grouped else "": (r["event_count"], r["first_time"], r["rule_count"]) for r in found}
    assert got == brute_temporal(rows, ["b", "a", "c"], span, kind, 2)
