import bz2
import gzip
import json
import sqlite3
import zipfile

import pytest

from embertrail.config import Mapping, load_mapping
from embertrail.engine import Engine
from embertrail.operators import flatten, rules
from embertrail.sources import formats, readers

EVENT = {"Event": {"#attributes": {"xmlns": "u"}, "System": {"EventID": 1, "Channel": "S", "TimeCreated": {"#attributes": {"SystemTime": "2024-01-01T00:00:00Z"}}}, "EventData": {"CommandLine": "cmd /c x", "Hashes": "MD5=" + "a" * 32 + ",SHA1=b", "E": "", "L": ["a", "b"], "Big": 2**70, "Yes": True}}}
XML = '<Event xmlns="u"><System><Provider Name="P"/><EventID>4624</EventID><Channel>Security</Channel><TimeCreated SystemTime="2024-01-01T00:00:00Z"/></System><EventData><Data Name="User">bob</Data><Data Name="LogonType">3</Data></EventData></Event>'


def raw(df):
    return [json.loads(r["raw"]) for r in df.collect()]


def test_json_lines_array_and_packed(spark, tmp_path):
    lines = "\n".join([json.dumps(EVENT), "", "{broken", "[1]", json.dumps({"a": 1})])
    (tmp_path / "a.json").write_text(lines)
    (tmp_path / "b.json.gz").write_bytes(gzip.compress(lines.encode()))
    (tmp_path / "c.json.bz2").write_bytes(bz2.compress(lines.encode()))
    for n in ("a.json", "b.json.gz", "c.json.bz2"):
        assert raw(readers.read(spark, str(tmp_path / n), "json")) == [EVENT, {"a": 1}]
    with zipfile.ZipFile(tmp_path / "d.zip", "w") as z:
        z.writestr("x.json", lines)
    assert raw(readers.read(spark, str(tmp_path / "d.zip"), "zip")) == [EVENT, {"a": 1}]
    (tmp_path / "e.json").write_text(json.dumps([{"a": 1}, 5, {"b": 2}]))
    assert raw(readers.read(spark, str(tmp_path / "e.json"), "json_array")) == [{"a": 1}, {"b": 2}]
    (tmp_path / "f.7z").write_bytes(b"7z")
    with pytest.raises(Exception, match="7z"):
        readers.read(spark, str(tmp_path / "f.7z"), "json").collect()


def test_zip_of_every_format(spark, tmp_path):
    plain = {
        "json": json.dumps(EVENT) + "\n{bad\n", "json_array": json.dumps([EVENT, 3]), "csv": 'EventID,User\n1,"a,""b"\n', "xml": f"<Events>{XML}\n{XML}</Events>", "evtxtract": "Found at offset " + XML + "\x00",
        "sysmon_linux": "Jan  1 00:00:00 h sysmon: " + XML.replace(' xmlns="u"', "") + "\nnoise\n", "auditd": 'type=A msg=audit(1700000000.1:7): a="x"\n',
    }
    for fmt, text in plain.items():
        (tmp_path / f"p.{fmt}").write_text(text)
        with zipfile.ZipFile(tmp_path / f"z.{fmt}.zip", "w") as z:
            z.writestr(f"p.{fmt}", text)
        want = raw(readers.read(spark, str(tmp_path / f"p.{fmt}"), fmt))
        assert want and raw(readers.read(spark, str(tmp_path / f"z.{fmt}.zip"), fmt)) == want, fmt
    with zipfile.ZipFile(tmp_path / "a.json.zip", "w") as z:
        z.writestr("a.json", json.dumps(EVENT))
    assert Engine(spark).load(str(tmp_path / "a.json.zip")).logs.count() == 1
    with zipfile.ZipFile(tmp_path / "two.zip", "w") as z:
        z.writestr("a", "1"), z.writestr("b", "2")
    with pytest.raises(Exception, match="exactly one"):
        readers.read(spark, str(tmp_path / "two.zip"), "json").collect()


def test_glob_reaches_the_readers(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"a": 1}')
    (tmp_path / "b.txt").write_text('{"b": 1}')
    assert raw(readers.read(spark, str(tmp_path), "json", glob="*.json")) == [{"a": 1}]


def test_raw_times_and_keys(spark):
    texts = ["x 2024-06-15T10:30:00.123Z y", "2024-06-15 10:30:00", "06/15/2024 10:30:00", "Jun 15 10:30:00 host", "133627842000000000", "1718442600", "1718442600000", "none 123", "1718442600 but 2024-06-15 10:30:00"]
    want = ["ISO 8601", "ISO 8601 (space)", "US date-time", "Syslog", "Windows FileTime", "Epoch seconds", "Epoch milliseconds", None, "ISO 8601 (space)"]
    assert [(formats.raw_time(t) or [None])[0] for t in texts] == want
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = {r["i"]: r["x"] for r in df.select("i", formats.raw_time_column(df.t).alias("x")).collect()}
    assert all((got[i] and tuple(got[i])) == formats.raw_time(t) for i, t in enumerate(texts))
    found = formats.detect_bytes("a.json", json.dumps({"when it was": "at 06/15/2024 10:30:00", "n": 1}).encode())
    assert (found.time_field, found.time_format) == ("when it was", "US date-time")
    assert formats.detect_bytes("a.log", b"<x>Found at offset 1 Valid header</x>").format == "evtxtract"
    assert formats.detect_bytes("a.json", b'{"type": "AVC", "a": 1}').details.startswith("audit")


def test_elastic_names_become_the_columns_that_rules_use(spark):
    event = {"@timestamp": "2024-01-01T00:00:00Z", "process": {"executable": "C:\\a.exe", "command_line": "a b", "parent": {"executable": "C:\\p.exe"}}, "dns": {"question": {"name": "x.com"}}, "event": {"code": "1"}, "winlog": {"channel": "S"}}
    df = spark.createDataFrame([("f", json.dumps(event))], "source_file string, raw string")
    row = flatten.flatten(df, Mapping(transforms=[])).first().asDict()
    assert {k: row[k] for k in ("timestamp", "Image", "CommandLine", "ParentImage", "QueryName", "EventID", "Channel")} == {"timestamp": "2024-01-01T00:00:00Z", "Image": "C:\\a.exe", "CommandLine": "a b", "ParentImage": "C:\\p.exe", "QueryName": "x.com", "EventID": "1", "Channel": "S"}


def test_xml_and_relatives(spark, tmp_path):
    (tmp_path / "a.xml").write_text(f"<?xml version='1.0'?><Events>\n{XML}\n{XML.replace('bob', 'eve')}</Events>")
    (tmp_path / "s.log").write_text("Jan  1 00:00:00 h sysmon: " + XML.replace(' xmlns="u"', "") + "\nnoise\n")
    (tmp_path / "t.log").write_bytes(b"Found at offset\n" + XML.encode() + b"\x00\nRecord number <Event bad>")
    got = raw(readers.read(spark, str(tmp_path / "a.xml"), "xml"))
    assert [g["Event"]["EventData"]["User"] for g in got] == ["bob", "eve"]
    assert got[0]["Event"]["System"] == {"Provider": {"#attributes": {"Name": "P"}}, "EventID": 4624, "Channel": "Security", "TimeCreated": {"#attributes": {"SystemTime": "2024-01-01T00:00:00Z"}}}
    assert len(raw(readers.read(spark, str(tmp_path / "s.log"), "sysmon_linux"))) == 1
    assert len(raw(readers.read(spark, str(tmp_path / "t.log"), "evtxtract"))) == 1


def test_auditd_csv_sqlite(spark, tmp_path):
    (tmp_path / "a.log").write_text('type=SYSCALL msg=audit(1700000000.1:7): a="x" exe="/bin/sh" a=2\x1dUID="root"\nnoise\n')
    assert raw(readers.read(spark, str(tmp_path / "a.log"), "auditd")) == [{"host": "offline", "type": "SYSCALL", "timestamp": "2023-11-14 22:13:20", "exe": "/bin/sh", "a": "2", "UID": "root"}, {"host": "offline"}]
    (tmp_path / "a.csv").write_text('EventID,Channel,User\n1,S,"a,""b"\n2,,c\n')
    assert raw(readers.read(spark, str(tmp_path / "a.csv"), "csv")) == [{"EventID": "1", "Channel": "S", "User": 'a,"b'}, {"EventID": "2", "User": "c"}]
    con = sqlite3.connect(tmp_path / "x.db")
    con.execute("CREATE TABLE logs (a, b)")
    con.execute("INSERT INTO logs VALUES (1, NULL)")
    con.commit()
    con.close()
    assert raw(readers.read(spark, str(tmp_path / "x.db"), "db")) == [{"a": 1}]


def test_paths():
    assert readers.select_paths(["/A/x.log", "/b/y.log", "/a/z.tmp"], ["/a/"], [".TMP"]) == ["/A/x.log"]


def test_flatten_event():
    m = Mapping(alias={"CommandLine": ["cmd"]})
    flat = flatten.flatten_event(EVENT, m)
    assert flat == {"EventID": 1, "Channel": "S", "SystemTime": "2024-01-01T00:00:00Z", "CommandLine": "cmd /c x", "cmd": "cmd /c x", "MD5": "a" * 32, "SHA1": "b", "Hashes": EVENT["Event"]["EventData"]["Hashes"], "L": "['a', 'b']", "Big": str(2**70), "Yes": True}
    assert flatten.split_pairs("a=1,b,c=2", ",", "=") == [("a", "1")]


def test_flatten_types_filters_and_transforms(spark):
    rows = [EVENT, {"EventID": "x9", "channel": "T", "commandline": "b", "@timestamp": "2025-01-01T00:00:00"}, {"EventID": 7, "Channel": "U"}]
    events = spark.createDataFrame([("d/a.json", json.dumps(r)) for r in rows] + [("d/a.json", "{bad")], "source_file string, raw string")
    logs = flatten.flatten(events, hashes=True)
    types = dict(logs.dtypes)
    assert types["EventID"] == "string" and types["Yes"] == "bigint" and types["Channel"] == "string"
    got = {r["Channel"]: r.asDict() for r in logs.collect()}
    assert set(got) == {"S", "T", "U"} and got["S"]["CommandLine_Length"] == "SHORT:8" and got["T"]["CommandLine"] == "b" and got["U"]["CommandLine_Length"] is None
    assert got["S"]["OriginalLogfile"] == "a.json" and got["S"]["Hash_MD5"] == "a" * 32
    f = rules.EventFilter(frozenset(["s"]), frozenset([1]), True)
    assert {r["Channel"] for r in flatten.flatten(events, event_filter=f).collect()} == {"S", "T"}
    assert {r["Channel"] for r in flatten.flatten(events, after="2024-06-01T00:00:00").collect()} == {"T", "U"}


def test_split_column(spark):
    df = spark.createDataFrame([("A=1,B=2",), ("A=1,bad,C=3",), ("",)], "h string")
    assert [r[0] for r in df.select(flatten.split_column(df.h, ",", "=")).collect()] == [{"A": "1", "B": "2"}, {"A": "1"}, {}]


def test_formats(tmp_path):
    look = lambda name, text: (d := formats.detect_bytes(name, text.encode()), d.format, d.confidence)[1:]
    assert look("a", json.dumps(EVENT)) == ("json", "high")
    assert look("a", json.dumps([EVENT])) == ("json_array", "high")
    assert look("a", "[" + json.dumps(EVENT) + ", {\"cut") == ("json_array", "high")
    assert look("a", XML) == ("xml", "high")
    assert look("a", "type=SYSCALL msg=audit(1.5:2): a=b\n" * 2) == ("auditd", "high")
    assert look("a", "EventID,Channel\n1,S\n") == ("csv", "high")
    assert look("a.log", "hello") == ("auditd", "low")
    assert formats.detect_bytes("a", b"ElfFile\0").format == "evtx"
    assert formats.time_field({"a": 1, "created": "2024-01-01", "x": {"UtcTime": "2024-01-01 00:00:00"}}) == "UtcTime"
    (tmp_path / "a.json.gz").write_bytes(gzip.compress(json.dumps(EVENT).encode()))
    assert formats.detect_batch([str(tmp_path / "a.json.gz")]).format == "json"


def test_engine_end_to_end(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps(EVENT) + "\n" + json.dumps({"EventID": 2, "Channel": "S"}))
    (tmp_path / "r.json").write_text(json.dumps([{"title": "T", "level": "high", "rule": ["SELECT * FROM logs WHERE CommandLine LIKE '%CMD%'"]}, None, {}, {"title": "no"}]))
    (tmp_path / "m.yaml").write_text("mappings: {Event.System.EventID: EventID}\nexclusions: [xmlns]\ntransforms_enabled: false\n")
    e = Engine(spark, load_mapping(str(tmp_path / "m.yaml"))).ruleset(str(tmp_path / "r.json")).load(str(tmp_path / "a.json"))
    assert [(r["title"], r["count"]) for r in e.detect().counts().collect()] == [("T", 1)]
    e.save(str(tmp_path / "saved"))
    again = Engine(spark).ruleset(str(tmp_path / "r.json")).load(str(tmp_path / "saved"), "saved")
    assert again.detect().matches.count() == 1
    assert again.sql("SELECT COUNT(*) AS n FROM logs WHERE EventID > 0").first()["n"] == 2


def test_flatten_writes_columns_itself_some_rows_at_a_time(spark, monkeypatch):
    """Columns as the keyed values have them: several spellings, kinds that differ by row, rows in small parts, no map on the way."""
    values = [1, True, -(2**63), 2**63, 1.5, "", None, "é", [1, "a"], {"Deep": {"kEy": 7, "Hash": "A=1,B=2,bad"}}, "OriginalLogfile"]
    rows = [{("Key", "key", "KEY")[i % 3]: v, "Whole": i % 2 == 0, "whole": i, "v 1": values[i % 7]} for i, v in enumerate(values * 3)]
    texts = [json.dumps(r) for r in rows] + [" " + json.dumps({"Key": 5}), "{}", "[1]", "{bad", '{"Key": 1} x', ""]
    events = spark.createDataFrame([(f"d/{i % 2}.json", t) for i, t in enumerate(texts)], "source_file string, raw string").coalesce(1)
    m = Mapping(transforms=[])
    columns = flatten.discover(flatten.keys(events, m))
    held = [(r["source_file"], r["row_hash"], {e["key"]: e["value"] for e in r["entries"]}) for r in flatten.keyed(events, m, True).collect()]
    want = []
    for file, mark, entries in held:
        found = [next((entries[s] for s in spellings if s in entries), None) for _, spellings, _ in columns]
        want.append((file, *[int(v) if v is not None and whole else v for v, (_, _, whole) in zip(found, columns)], mark))
    assert len(want) == 35 and {name.lower(): whole for name, _, whole in columns} == {"key": False, "whole": True, "v1": False, "a": False, "b": False, "originallogfile": False}
    monkeypatch.setattr(flatten, "CELLS", 14)  # two rows a part
    logs = flatten.flatten(events, m, hashes=True)
    assert [tuple(r) for r in logs.collect()] == want
    assert "map_from_entries" not in logs._jdf.queryExecution().optimizedPlan().toString()
