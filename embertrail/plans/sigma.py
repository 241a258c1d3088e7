"""Sigma YAML to the predicate tree of rules, and correlation documents to correlation plans.

Detections are maps (all must hold), lists (any must hold) and keywords; conditions are the public grammar: and, or,
not, parentheses, ``1 of x*``, ``all of x*``, ``of them``. Modifiers: contains, startswith, endswith, all, re, cidr,
exists, cased is refused, gt, gte, lt, lte, windash, base64 is refused. Wildcards ``*`` and ``?`` in values, with
backslash escapes. A pipeline rewrites fields and adds conditions by log source; pipelines apply in the given order.
"""

from __future__ import annotations

import ipaddress
import base64
import re
from dataclasses import dataclass, field
from pathlib import Path

import yaml

from .predicates import And, Compare, In, IsNull, Like, Lit, Name, Not, Or, Regexp, Unsupported

_TIMES = {"s": 1, "m": 60, "h": 3600, "d": 86400, "w": 604800}


@dataclass
class Pipeline:
    """fields: renames. sources: (logsource entries that must match, conditions to add)."""

    name: str
    fields: dict[str, str] = field(default_factory=dict)
    sources: list[tuple[dict[str, str], dict[str, object]]] = field(default_factory=list)


# Event ids of process and network telemetry by log source category, and channels by service.
SYSMON = Pipeline("sysmon", sources=[({"product": "windows", "category": c}, {"Channel": "Microsoft-Windows-Sysmon/Operational", "EventID": ids}) for c, ids in {
    "process_creation": 1, "file_change": 2, "network_connection": 3, "process_termination": 5, "driver_load": 6, "image_load": 7, "create_remote_thread": 8,
    "raw_access_thread": 9, "process_access": 10, "file_event": 11, "registry_add": 12, "registry_delete": 12, "registry_set": 13, "registry_rename": 14,
    "registry_event": [12, 13, 14], "create_stream_hash": 15, "pipe_created": [17, 18], "wmi_event": [19, 20, 21], "dns_query": 22, "file_delete": [23, 26],
}.items()])
WINDOWS = Pipeline("windows-logsources", sources=[({"product": "windows", "service": s}, {"Channel": c}) for s, c in {
    "security": "Security", "system": "System", "application": "Application", "powershell": ["Microsoft-Windows-PowerShell/Operational", "PowerShellCore/Operational"],
    "powershell-classic": "Windows PowerShell", "taskscheduler": "Microsoft-Windows-TaskScheduler/Operational", "windefend": "Microsoft-Windows-Windows Defender/Operational",
    "wmi": "Microsoft-Windows-WMI-Activity/Operational", "sysmon": "Microsoft-Windows-Sysmon/Operational", "bits-client": "Microsoft-Windows-Bits-Client/Operational",
    "dns-server": "DNS Server", "applocker": ["Microsoft-Windows-AppLocker/MSI and Script", "Microsoft-Windows-AppLocker/EXE and DLL"],
}.items()])
PIPELINES = {p.name: p for p in (SYSMON, WINDOWS)}


def _wild(value: str) -> tuple[str, bool]:
    """A Sigma text as a LIKE pattern with backslash as escape; whether it has wildcards."""
    out, i, wild = "", 0, False
    while i < len(value):
        c = value[i]
        if c == "\\" and i + 1 < len(value) and value[i + 1] in "*?\\":
            c, i = value[i + 1], i + 1
            out += "\\\\" if c == "\\" else c
        elif c in "*?":
            out, wild = out + ("%" if c == "*" else "_"), True
        else:
            out += "\\" + c if c in "%_\\" else c
        i += 1
    return out, wild


def _plain(pattern: str) -> str:
    return re.sub(r"\\(.)", r"\1", pattern, flags=re.DOTALL)


def _cidr(name: Name, text: str) -> object:
    net = ipaddress.ip_network(text, strict=False)
    if net.version != 4:
        return Like(name, _wild(str(net).split("::")[0] + "*")[0], "\\")
    octets = str(net.network_address).split(".")
    whole, rest = divmod(net.prefixlen, 8)
    if whole == 4:
        return Compare("=", name, Lit(text.split("/")[0]))
    head = ".".join(octets[:whole]) + ("." if whole else "")
    if not rest:
        return Like(name, head + "%", None)
    first = int(octets[whole])
    tail = "" if whole == 3 else "."
    return Or(tuple((Like(name, f"{head}{i}.%", None) if tail else Compare("=", name, Lit(f"{head}{i}"))) for i in range(first, first + 2 ** (8 - rest))))


def _one(name: Name, value: object, mods: list[str]) -> object:
    if "exists" in mods:
        return Not(IsNull(name)) if value else IsNull(name)
    if value is None:
        return IsNull(name)
    for mod, op in (("gte", ">="), ("gt", ">"), ("lte", "<="), ("lt", "<")):
        if mod in mods:
            return Compare(op, name, Lit(value))
    if "re" in mods:
        flags = "".join(m for m in mods if m in "ims" and len(m) == 1)
        return Regexp(name, (f"(?{flags})" if flags else "") + str(value))
    if "cidr" in mods:
        return _cidr(name, str(value))
    if isinstance(value, bool):
        return Compare("=", name, Lit(int(value)))
    around = {"contains", "startswith", "endswith"} & set(mods)
    if isinstance(value, (int, float)) and not around:
        return Compare("=", name, Lit(value))
    texts = _encoded(str(value), mods)
    if "cased" in mods:
        return _any([Regexp(name, _as_regexp(_wild(t)[0], around)) for t in texts])
    if "windash" in mods:
        texts += [re.sub(r"(^|(?<=\s))[-/]", lambda m: m[1] + d, texts[0]) for d in "-/–—―"]
    out = []
    for text in dict.fromkeys(texts):
        pattern, wild = _wild(text)
        if around:
            pattern, wild = ("%" if {"contains", "endswith"} & around else "") + pattern + ("%" if {"contains", "startswith"} & around else ""), True
        out.append(Like(name, pattern, "\\") if wild else Compare("=", name, Lit(_plain(pattern))))
    return _any(out)


def _any(nodes: list) -> object:
    return nodes[0] if len(nodes) == 1 else Or(tuple(nodes))


def _encoded(text: str, mods: list[str]) -> list[str]:
    """The texts to look for: the text itself, or its base64 form, for base64offset the three that it has inside a longer one."""
    if not {"base64", "base64offset"} & set(mods):
        return [text]
    charset = next((c for m, c in (("wide", "utf-16-le"), ("utf16le", "utf-16-le"), ("utf16be", "utf-16-be"), ("utf16", "utf-16")) if m in mods), "utf-8")
    data = text.encode(charset)
    if "base64" in mods:
        return [base64.b64encode(data).decode()]
    out = []
    for shift in range(3):
        # Characters that depend on the unknown bytes before and after are left out.
        coded = base64.b64encode(b"\0" * shift + data).decode().rstrip("=")
        first, whole = -(-shift * 8 // 6), (shift + len(data)) * 8 // 6
        out.append(coded[first:whole])
    return out


def _as_regexp(like: str, around: set[str]) -> str:
    """A LIKE pattern with its escapes as a regular expression, which minds the case."""
    body, at = "", 0
    while at < len(like):
        c = like[at]
        if c == "\\" and at + 1 < len(like):
            at += 1
            body += re.escape(like[at])
        else:
            body += ".*" if c == "%" else "." if c == "_" else re.escape(c)
        at += 1
    return "(?s)" + ("" if {"contains", "endswith"} & around else "^") + body + ("" if {"contains", "startswith"} & around else "$")


_KNOWN = {"base64", "base64offset", "wide", "utf16le", "utf16be", "utf16", "cased", "contains", "startswith", "endswith", "all", "re", "i", "m", "s", "cidr", "exists", "gt", "gte", "lt", "lte", "windash", "fieldref"}


def _field(key: str, value: object, rename: dict[str, str]) -> object:
    parts = key.split("|")
    mods = parts[1:]
    if unknown := set(mods) - _KNOWN:
        raise Unsupported(f"modifier {', '.join(sorted(unknown))}")
    name = Name(rename.get(parts[0], parts[0]))
    if "fieldref" in mods:
        return Compare("=", name, Name(rename.get(str(value), str(value))))
    if not isinstance(value, list):
        return _one(name, value, mods)
    if "all" in mods:
        return And(tuple(_one(name, v, mods) for v in value))
    if not set(mods) and all(isinstance(v, (int, str)) and not isinstance(v, bool) and not (isinstance(v, str) and _wild(v)[1]) for v in value):
        return In(name, tuple(Lit(_plain(_wild(v)[0]) if isinstance(v, str) else v) for v in value))
    return Or(tuple(_one(name, v, mods) for v in value))


def _group(node: object, rename: dict[str, str], columns: list[str]) -> object:
    if isinstance(node, dict):
        parts = [_field(k, v, rename) if k.strip("|") and not k.startswith("|") else _keywords(v, k, columns) for k, v in node.items()]
        return parts[0] if len(parts) == 1 else And(tuple(parts))
    if isinstance(node, list):
        parts = [_group(x, rename, columns) if isinstance(x, dict) else _keywords(x, "", columns) for x in node]
        return parts[0] if len(parts) == 1 else Or(tuple(parts))
    return _keywords(node, "", columns)


def _keywords(value: object, key: str, columns: list[str]) -> object:
    """Keywords look into every text column."""
    values = value if isinstance(value, list) else [value]
    each = [Or(tuple(Like(Name(c), "%" + _wild(str(v))[0] + "%", "\\") for c in columns)) if columns else Lit(0) for v in values]
    return each[0] if len(each) == 1 else (And if "all" in key else Or)(tuple(each))


def _condition(text: str, groups: dict[str, object]) -> object:
    tokens = re.findall(r"\(|\)|[\w*.-]+", text)
    at = 0

    def pick(pattern: str) -> list[object]:
        found = [g for n, g in groups.items() if (pattern == "them" and not n.startswith("_")) or re.fullmatch(re.escape(pattern).replace(r"\*", ".*"), n)]
        if not found:
            raise Unsupported(f"no detection {pattern}")
        return found

    def atom() -> object:
        nonlocal at
        if at >= len(tokens):
            raise Unsupported("condition ends early")
        t = tokens[at]
        at += 1
        if t == "(":
            out = either()
            at += 1
            return out
        if t.lower() == "not":
            return Not(atom())
        if t.lower() in ("all", "any") or t.isdigit() and at < len(tokens) and tokens[at].lower() == "of":
            at += 2
            found = pick(tokens[at - 1])
            if t.isdigit() and int(t) > 1:
                raise Unsupported(f"{t} of")
            return found[0] if len(found) == 1 else (And if t.lower() == "all" else Or)(tuple(found))
        return pick(t)[0]

    def both() -> object:
        nonlocal at
        parts = [atom()]
        while at < len(tokens) and tokens[at].lower() == "and":
            at += 1
            parts.append(atom())
        return parts[0] if len(parts) == 1 else And(tuple(parts))

    def either() -> object:
        nonlocal at
        parts = [both()]
        while at < len(tokens) and tokens[at].lower() == "or":
            at += 1
            parts.append(both())
        return parts[0] if len(parts) == 1 else Or(tuple(parts))

    out = either()
    if at < len(tokens):
        raise Unsupported(f"unexpected {tokens[at]} in condition")
    return out


def compile_rule(doc: dict, pipelines: list[Pipeline] | None = None, columns: list[str] | None = None) -> list[object]:
    """One tree per condition of a Sigma rule. columns: the text columns that keywords look into."""
    rename: dict[str, str] = {}
    extra: list[object] = []
    source = {k: str(v).lower() for k, v in (doc.get("logsource") or {}).items()}
    for p in pipelines or []:
        rename |= p.fields
        for want, conditions in p.sources:
            if all(source.get(k) == v for k, v in want.items()):
                extra += [_field(k, v, {}) for k, v in conditions.items()]
    detection = doc["detection"]
    groups = {k: _group(v, rename, columns or []) for k, v in detection.items() if k not in ("condition", "timeframe")}
    conditions = detection.get("condition", "")
    out = []
    for text in conditions if isinstance(conditions, list) else [conditions]:
        if "|" in text:
            raise Unsupported("aggregation in a condition")
        tree = _condition(text, groups)
        out.append(And((*extra, tree)) if extra else tree)
    return out


def seconds(timespan: str | int) -> int:
    m = re.fullmatch(r"(\d+)\s*([smhdw])", str(timespan))
    if not m:
        raise Unsupported(f"timespan {timespan}")
    return int(m[1]) * _TIMES[m[2]]


@dataclass
class Correlation:
    title: str
    kind: str  # event_count, value_count, temporal, temporal_ordered
    rules: list[str]
    group_by: list[str]
    timespan: int
    op: str = ">="
    number: int = 1
    of: str | None = None
    meta: dict = field(default_factory=dict)


def correlation(doc: dict) -> Correlation:
    c = doc["correlation"]
    ops = {"gt": ">", "gte": ">=", "lt": "<", "lte": "<=", "eq": "=", "neq": "!="}
    cond = c.get("condition") or {}
    op, number = next(((ops[k], int(v)) for k, v in cond.items() if k in ops), (">=", 1))
    rules = c["rules"] if isinstance(c["rules"], list) else [c["rules"]]
    if c["type"].startswith("temporal") and not cond:
        number = len(rules)
    if c["type"] not in ("event_count", "value_count", "temporal", "temporal_ordered"):
        raise Unsupported(f"correlation type {c['type']}")
    return Correlation(doc["title"], c["type"], rules, list(c.get("group-by") or []), seconds(c.get("timespan", "5m")), op, number, cond.get("field"), doc)


def is_rule(doc: object) -> bool:
    return isinstance(doc, dict) and "title" in doc and ({"logsource", "detection"} <= doc.keys() or "correlation" in doc)


def load(paths: list[str]) -> tuple[list[dict], list[str]]:
    """All valid documents of YAML files and folders (searched for *.yml and *.yaml), and what was skipped."""
    docs: list[dict] = []
    skipped: list[str] = []
    for p in map(Path, paths):
        for f in sorted([*p.rglob("*.yml"), *p.rglob("*.yaml")]) if p.is_dir() else [p]:
            try:
                got = list(yaml.safe_load_all(f.read_text()))
            except (yaml.YAMLError, OSError, UnicodeDecodeError) as e:
                skipped.append(f"{f}: {e}")
                continue
            for d in got:
                if is_rule(d):
                    docs.append(d | {"filename": f.name})
                elif d is not None:
                    skipped.append(f"{f}: not a rule")
    return docs, skipped
