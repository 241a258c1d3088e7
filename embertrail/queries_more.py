"""More driver queries: the sources, read back from files that the query writes, detection of times, transforms, correlations and sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import Mapping
from .functions import transforms as TR
from .operators import export, flatten, profile, rules, summarize
from .operators.correlate import correlate
from .operators.detect import detect
from .queries import _COUNTS, _META, _correlation, found, logs, query, raw_events, ruleset, shared_path, table
from .sources import formats, readers

# --- sources -----------------------------------------------------------------------------------------------------

_XML = "concat('<Event xmlns=\"u\"><System><EventID>', user_id, '</EventID><Channel>', event_type, '</Channel><TimeCreated SystemTime=\"', ts, '\"/></System><EventData><Data Name=\"row_no\">', event_id, '</Data></EventData></Event>')"
_PATHS = {"Event.System.Channel": "Channel", "Event.System.EventID": "EventID", "Event.EventData.row_no": "event_id"}
_THREE = "SELECT event_id, event_type AS Channel, user_id AS EventID FROM events"


def _read_back(name: str, line: str | None, fmt: str, sql: str = _THREE, paths: dict[str, str] | None = None, **options: str) -> None:
    """Register: lines made from the events, written as text, read by a source, and the columns of what it yields."""

    def run(spark: SparkSession, sf: str) -> DataFrame:
        path = shared_path(spark, name)
        text = raw_events(spark, sf).select(F.col("raw").alias("value")) if line is None else table(spark, sf, "events").select(F.expr(line).alias("value"))
        text.write.options(**options).text(path)
        return flatten.flatten_known(readers.read(spark, path, fmt), paths or _PATHS, {"EventID", "event_id"}).drop("source_file").select("event_id", *[c for c in dict.fromkeys((paths or _PATHS).values()) if c != "event_id"])

    run.__name__ = name
    query(sql)(run)


_read_back("source_json_lines", None, "json")
_read_back("source_gzip", None, "json", compression="gzip")
_read_back("source_bzip2", None, "json", compression="bzip2")
_read_back("source_json_lines_malformed", "if(event_id % 3 = 0, '{broken', if(event_id % 3 = 1, '', concat('{\"id\": ', event_id, '}')))", "json", "SELECT event_id FROM events WHERE event_id % 3 = 2", {"id": "event_id"})
_read_back("source_xml", _XML, "xml", "SELECT event_id, event_type AS Channel, user_id AS EventID, CAST(ts AS VARCHAR)[1:19] AS t FROM events", _PATHS | {"Event.System.TimeCreated.#attributes.SystemTime": "t"})
_read_back("source_evtxtract", f"concat('Found at offset ', event_id, char(11), '\\n', {_XML}, if(event_id % 2 = 0, '\\n<Event bad', ''))", "evtxtract")
_read_back("source_sysmon_linux", f"if(event_id % 5 = 0, 'noise', concat('Jan  1 00:00:00 h sysmon: ', replace({_XML}, ' xmlns=\"u\"', '')))", "sysmon_linux", _THREE + " WHERE event_id % 5 <> 0")
_read_back(
    "source_auditd", "concat('type=A msg=audit(1700000000.', event_id, ':7): op=\"', event_type, '\" id=', event_id, ' id2=', user_id)", "auditd",
    "SELECT event_id, event_type AS op, CAST(user_id AS VARCHAR) AS u, 'offline' AS host, '2023-11-14 22:13:20' AS stamp FROM events", {"id": "event_id", "op": "op", "id2": "u", "host": "host", "timestamp": "stamp"},
)
# The first query's time has more digits than the table prints; both sides show seconds.
_xml_run = query.__globals__["_queries"]["source_xml"]
query.__globals__["_queries"]["source_xml"] = lambda spark, sf: _xml_run(spark, sf).withColumn("t", F.substring("t", 1, 19))


@query("SELECT event_id, event_type AS Channel FROM events")
def source_json_array(spark: SparkSession, sf: str) -> DataFrame:
    """One array a file; members that are no object are skipped."""
    path = shared_path(spark, "array")
    e = table(spark, sf, "events").select(F.pmod("event_id", F.lit(8)).alias("g"), F.to_json(F.struct("event_id", F.col("event_type").alias("Channel"))).alias("v"))
    e.groupBy("g").agg(F.concat(F.lit("[5, "), F.array_join(F.collect_list("v"), ", "), F.lit(', "x"]')).alias("value")).repartition("g").write.partitionBy("g").text(path)
    return flatten.flatten_known(readers.read(spark, path, "json_array"), {"event_id": "event_id", "Channel": "Channel"}, {"event_id"}).select("event_id", "Channel")


@query("SELECT CAST(event_id AS VARCHAR) AS event_id, event_type AS \"Channel\", props FROM events")
def source_csv(spark: SparkSession, sf: str) -> DataFrame:
    path = shared_path(spark, "csv")
    table(spark, sf, "events").select(F.col("event_id").cast("string").alias("event_id"), F.col("event_type").alias("Channel"), "props").write.option("header", "true").option("escape", '"').csv(path)
    return flatten.flatten_known(readers.read(spark, path, "csv"), {"event_id": "event_id", "Channel": "Channel", "props": "props"}).select("event_id", "Channel", "props")


@query("SELECT event_id, event_type AS channel FROM events WHERE event_id % 4 < 2")
def source_path_filter(spark: SparkSession, sf: str) -> DataFrame:
    """Files selected and avoided by a part of their path, without regard to case."""
    path = shared_path(spark, "parts")
    names = F.array(F.lit("Logs-A"), F.lit("logs-B"), F.lit("other"), F.lit("logs-skip"))
    table(spark, sf, "events").select(F.get(names, F.pmod("event_id", F.lit(4)).cast("int")).alias("kind"), F.to_json(F.struct("event_id", F.col("event_type").alias("channel"))).alias("value")).write.partitionBy("kind").text(path)
    rows = readers.read(spark, path, "json").where(readers.path_filter(F.regexp_extract("source_file", "kind=([^/]*)", 1), ["LOGS"], ["SKIP"]))
    return flatten.flatten_known(rows, {"event_id": "event_id", "channel": "channel"}, {"event_id"}).select("event_id", "channel")


@query("SELECT event_id, event_type AS Image, CAST(user_id AS VARCHAR) AS CommandLine, 'p' AS ParentImage, strftime(ts, '%Y-%m-%d') AS timestamp FROM events")
def flatten_elastic_names(spark: SparkSession, sf: str) -> DataFrame:
    """Names of the Elastic schema become the columns that rules use."""
    e = table(spark, sf, "events")
    process = F.struct(F.col("event_type").alias("executable"), F.col("user_id").cast("string").alias("command_line"), F.struct(F.lit("p").alias("executable")).alias("parent"))
    raw = e.select(F.lit("f").alias("source_file"), F.to_json(F.struct(F.date_format("ts", "yyyy-MM-dd").alias("@timestamp"), process.alias("process"), F.col("event_id").alias("event_id"))).alias("raw"))
    flat = flatten.flatten(raw, Mapping(transforms=[]))
    return flat.select(F.col("eventid").alias("event_id"), "Image", "CommandLine", "ParentImage", "timestamp")


@query("SELECT event_id, [event_type, CAST(user_id AS VARCHAR)] IS NOT NULL AS listed, '[''' || event_type || ''', ' || user_id || ']' AS pair, CASE WHEN user_id % 2 = 0 THEN 1 ELSE 0 END AS even, '9223372036854775808' AS big, event_type AS b FROM events")
def flatten_values(spark: SparkSession, sf: str) -> DataFrame:
    """Lists as their printed form, Booleans as integers, integers beyond 64 bits as text, empty values and excluded paths gone, the last of equal names."""
    raw = table(spark, sf, "events").select(
        F.lit("f").alias("source_file"),
        F.format_string('{"event_id": %s, "pair": ["%s", %s], "even": %s, "big": 9223372036854775808, "gone": "", "xmlns": "u", "nil": null, "b": 1, "a": {"b": "%s"}}', "event_id", "event_type", "user_id", F.when(F.col("user_id") % 2 == 0, "true").otherwise("false"), "event_type").alias("raw"),
    )
    flat = flatten.flatten(raw, Mapping(transforms=[]))
    assert not {"gone", "xmlns", "nil"} & set(flat.columns)
    return flat.select(F.col("eventid").alias("event_id"), F.col("pair").isNotNull().alias("listed"), "pair", "even", "big", "b")


@query("SELECT event_id, event_type AS Channel, event_type AS Source, 'x' AS A, CAST(user_id AS VARCHAR) AS B, 'A=x,B=' || user_id AS Hashes FROM events")
def flatten_alias_and_split(spark: SparkSession, sf: str) -> DataFrame:
    """A copy under a second name; k=v texts in columns of their own, kept beside or dropped."""
    e = table(spark, sf, "events")
    text = F.concat(F.lit("A=x,B="), F.col("user_id").cast("string"))
    raw = e.select(F.lit("f").alias("source_file"), F.to_json(F.struct("event_id", F.col("event_type").alias("Channel"), text.alias("Hashes"), F.lit("C=1").alias("Hash"))).alias("raw"))
    flat = flatten.flatten(raw, Mapping(transforms=[], alias={"Channel": ["Source"]}))
    assert "Hash" not in flat.columns and "C" in flat.columns
    return flat.select(F.col("eventid").alias("event_id"), "Channel", "Source", "A", "B", "Hashes")


# --- times -------------------------------------------------------------------------------------------------------

_TIMES = ["2024-06-15T10:30:00.5Z", "2024-06-15 10:30:00", "06/15/2024 10:30:00", "Jun 15 10:30:00", "133627842000000000", "1718442600", "1718442600000", "123", "word"]
_KINDS = ["ISO 8601", "ISO 8601 (space)", "US date-time", "Syslog", "Windows FileTime", "Epoch seconds", "Epoch milliseconds", None, None]


def _case(values: list, by: str, quote: bool = True) -> str:
    shown = lambda v: "NULL" if v is None else "'" + str(v).replace("'", "''") + "'" if quote else str(v)
    return f"CASE {by} % {len(values)} " + " ".join(f"WHEN {i} THEN {shown(v)}" for i, v in enumerate(values)) + " END"


def _one_of(values: list[str], by: str) -> Column:
    return F.get(F.array(*[F.lit(v) for v in values]), F.pmod(F.col(by), F.lit(len(values))).cast("int"))


@query(f"SELECT event_id, {_case(_KINDS, 'event_id')} AS kind, CASE WHEN event_id % 9 < 7 THEN {_case(_TIMES, 'event_id')} END AS hit FROM events")
def raw_times(spark: SparkSession, sf: str) -> DataFrame:
    text = F.concat(F.col("event_type"), F.lit(" at "), _one_of(_TIMES, "event_id"), F.lit(" by x"))
    hit = formats.raw_time_column(text)
    return table(spark, sf, "events").select("event_id", hit["format"].alias("kind"), hit["match"].alias("hit"))


@query(f"SELECT event_id, {_case([True, True, True, True, True, True, True, False, False], 'event_id', False)} AS is_time FROM events")
def looks_like_timestamp_forms(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select("event_id", formats.looks_like_time_column(_one_of(_TIMES, "event_id")).alias("is_time"))


@query("SELECT event_id, event_type AS Channel FROM events WHERE event_type = 'view' OR (strftime(ts, '%Y-%m-%dT%H:%M:%S') > '2024-01-10T00:00:00' AND strftime(ts, '%Y-%m-%dT%H:%M:%S') < '2024-01-12T12:00:00')")
def time_filter_auto_field(spark: SparkSession, sf: str) -> DataFrame:
    """The time range on whichever known field an event has; events without any are kept."""
    time = F.when(F.col("event_type") != "view", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"))
    raw = table(spark, sf, "events").select(F.lit("f").alias("source_file"), F.to_json(F.struct("event_id", F.col("event_type").alias("Channel"), F.when(F.col("user_id") % 2 == 0, time).alias("SystemTime"), F.when(F.col("user_id") % 2 == 1, time).alias("UtcTime"))).alias("raw"))
    return flatten.flatten(raw, Mapping(transforms=[]), after="2024-01-10T00:00:00", before="2024-01-12T12:00:00").select(F.col("eventid").alias("event_id"), "Channel")


@query("SELECT event_id FROM events WHERE event_type IN ('error', 'click') AND user_id IN (1, 2, 3, 4, 5)")
def event_filter_on_raw(spark: SparkSession, sf: str) -> DataFrame:
    """The filter that a ruleset implies, applied to the raw JSON by paths."""
    implied = rules.EventFilter.of([rules.Rule("a", rule=["x"], channel=["ERROR"], eventid=[1, 2, 3]), rules.Rule("b", rule=["y"], channel=["click"], eventid=[4, 5])])
    kept = flatten.early_filter(raw_events(spark, sf), implied, Mapping())
    return flatten.flatten_known(kept, {"Event.EventData.row_no": "event_id"}, {"event_id"}).select("event_id")


# --- rules -------------------------------------------------------------------------------------------------------


@query(f"{_COUNTS} SELECT title, n AS matches FROM c JOIN meta USING (rule_idx) WHERE title NOT LIKE '%Views%' AND title NOT LIKE '%Click%'")
def ruleset_loaded(spark: SparkSession, sf: str) -> DataFrame:
    """A ruleset saved as JSON and loaded again, with repeats dropped, ordered by severity, titles filtered out."""
    import tempfile
    from pathlib import Path

    with tempfile.TemporaryDirectory() as d:
        path = str(Path(d) / "rules.json")
        rules.save_json([*ruleset(), rules.Rule("Same statements again", rule=ruleset()[0].rule)], path)
        made, _ = rules.load_json(path)
    kept = rules.without(rules.by_level(rules.dedupe(made)), ["Views", "Click"])
    return detect(logs(spark, sf), kept).counts().select("title", F.col("count").alias("matches"))


@query(f"{_COUNTS} SELECT title, n AS matches FROM c JOIN meta USING (rule_idx)")
def rule_profile(spark: SparkSession, sf: str) -> DataFrame:
    """Each rule run and timed by itself: the matches (times differ from run to run and are left out here)."""
    rows = profile.profile(logs(spark, sf), ruleset())
    assert [r["ms"] for r in rows] == sorted((r["ms"] for r in rows), reverse=True) and profile.total(rows)["rules"] == len(rows)
    return spark.createDataFrame([(r["title"], r["matches"]) for r in rows if r["matches"]], "title string, matches long")


@query(f"{_COUNTS} SELECT title, coalesce(n, 0) AS matches, coalesce(n, 0) > 0 AS as_expected FROM meta LEFT JOIN c USING (rule_idx)")
def rule_regression(spark: SparkSession, sf: str) -> DataFrame:
    rows = profile.regression(logs(spark, sf), ruleset(), {r.title: "Positive" for r in ruleset()})
    return spark.createDataFrame([(r["title"], r["matches"], r["as_expected"]) for r in rows], "title string, matches long, as_expected boolean")


@query("WITH x AS (SELECT event_id, event_type, base64(encode(event_type)) AS enc FROM events) SELECT event_id FROM x WHERE contains(enc, 'Y2xpY2') OR event_type = 'view'")
def sigma_modifiers(spark: SparkSession, sf: str) -> DataFrame:
    """Encoded texts, and a comparison that minds the case."""
    docs = [
        {"title": "A", "logsource": {"product": "x"}, "detection": {"s": {"enc|base64offset|contains": "click"}, "condition": "s"}},
        {"title": "B", "logsource": {"product": "x"}, "detection": {"s": {"event_type|cased": "view"}, "t": {"event_type|cased": "VIEW"}, "condition": "s and not t"}},
    ]
    made, notes = rules.compile_docs(docs)
    if len(made) < 2:
        raise ValueError(notes)
    e = table(spark, sf, "events").select("event_id", "event_type", F.base64(F.col("event_type").cast("binary")).alias("enc"))
    return detect(e, made, None).matches.select("event_id")


_NUMBERS = [("gt", ">"), ("gte", ">="), ("lt", "<"), ("lte", "<="), ("eq", "="), ("neq", "<>")]


@query(" UNION ALL ".join(f"SELECT '{name}' AS op, user_id, count(*) AS n FROM events WHERE event_type = 'error' GROUP BY user_id HAVING count(*) {sign} 3" for name, sign in _NUMBERS))
def corr_conditions(spark: SparkSession, sf: str) -> DataFrame:
    out = None
    for name, _ in _NUMBERS:
        docs = [{"title": "e", "name": "e", "logsource": {"product": "x"}, "detection": {"s": {"Channel": "ERROR"}, "condition": "s"}}, {"title": name, "correlation": {"type": "event_count", "rules": ["e"], "group-by": ["EventID"], "timespan": "1h", "condition": {name: 3}}}]
        made, _ = rules.compile_docs(docs)
        one = correlate(logs(spark, sf), next(r.correlation for r in made if r.correlation)).select(F.lit(name).alias("op"), F.col("EventID").alias("user_id"), F.col("event_count").alias("n"))
        out = one if out is None else out.unionByName(one)
    return out  # type: ignore[return-value]


@query("""WITH e AS (SELECT user_id, event_type, CAST(epoch(date_trunc('second', ts)) AS BIGINT) AS t FROM events WHERE event_type IN ('error', 'purchase')),
h AS (SELECT a.user_id, a.t FROM e a WHERE EXISTS (SELECT 1 FROM e x JOIN e y ON y.user_id = x.user_id WHERE x.user_id = a.user_id AND x.event_type = 'error' AND y.event_type = 'purchase' AND x.t >= a.t AND y.t <= a.t + 7200 AND (y.t > x.t OR (y.t = x.t AND 'buy' > 'err'))))
SELECT user_id AS EventID, count(*) AS event_count, min(t) AS first_time FROM h GROUP BY user_id""")
def corr_temporal_ordered(spark: SparkSession, sf: str) -> DataFrame:
    return correlate(logs(spark, sf), _correlation("temporal_ordered", 2, ["EventID"], names=("err", "buy"), span="2h"), time_field="SystemTime").select("EventID", "event_count", "first_time")


# --- summaries and sinks -----------------------------------------------------------------------------------------


@query(f"{_COUNTS} SELECT CASE WHEN level = 'unknown' THEN 'other' ELSE level END AS level, count(*) AS rules FROM c JOIN meta USING (rule_idx) GROUP BY 1")
def rules_per_level(spark: SparkSession, sf: str) -> DataFrame:
    return summarize.severity_totals(found(spark, sf).counts()).select("level", F.col("detections").alias("rules"))


_M = "WITH m AS (SELECT x.*, e.event_type, e.user_id, e.props, e.ts FROM ({0}) x JOIN events e USING (event_id)), meta AS (" + _META + ")"


def _matched(select: str) -> str:
    from .queries import _MATCHES

    return _M.format(_MATCHES) + " " + select


def _fields(df: DataFrame, *names: tuple[str, str]) -> DataFrame:
    return df.select(*[F.get_json_object("value", f"$.{path}").alias(name) for path, name in names])


@query(_matched("SELECT title, level AS rule_level, CAST(event_id AS VARCHAR) AS event_id, event_type AS channel FROM m JOIN meta USING (rule_idx)"))
def export_ndjson_contents(spark: SparkSession, sf: str) -> DataFrame:
    return _fields(export.ndjson(found(spark, sf), with_level=True), ("title", "title"), ("rule_level", "rule_level"), ("event_id", "event_id"), ("Channel", "channel"))


@query(_matched("SELECT 'r' || rule_idx AS id, title, CAST(event_id AS VARCHAR) AS event_id FROM m JOIN meta USING (rule_idx)"))
def export_splunk_with_id(spark: SparkSession, sf: str) -> DataFrame:
    return _fields(export.ndjson(found(spark, sf), with_id=True), ("id", "id"), ("title", "title"), ("event_id", "event_id"))


@query(_matched("SELECT NULL AS to_index, title, CAST(event_id AS VARCHAR) AS event_id FROM m JOIN meta USING (rule_idx) UNION ALL SELECT 'detections', NULL, NULL FROM m"))
def export_bulk(spark: SparkSession, sf: str) -> DataFrame:
    return _fields(export.bulk(found(spark, sf)), ("index._index", "to_index"), ("title", "title"), ("event_id", "event_id"))


@query(_matched("SELECT title AS message, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS datetime, 'Detection' AS timestamp_desc, CAST(event_id AS VARCHAR) AS event_id FROM m JOIN meta USING (rule_idx)"))
def export_timesketch(spark: SparkSession, sf: str) -> DataFrame:
    return _fields(export.timesketch(found(spark, sf)), ("message", "message"), ("datetime", "datetime"), ("timestamp_desc", "timestamp_desc"), ("event_id", "event_id"))


@query(_matched(", k AS (SELECT rule_idx, count(*) AS n FROM m GROUP BY rule_idx) SELECT title AS rule_title, level AS rule_level, n AS rule_count, event_type AS \"Channel\", props FROM m JOIN meta USING (rule_idx) JOIN k USING (rule_idx)").replace(") , k AS", "), k AS"))
def export_csv_contents(spark: SparkSession, sf: str) -> DataFrame:
    return export.csv(found(spark, sf)).select("rule_title", "rule_level", "rule_count", "Channel", "props")


@query(f"{_COUNTS} SELECT title, CASE level WHEN 'critical' THEN 'error' WHEN 'high' THEN 'error' WHEN 'medium' THEN 'warning' ELSE 'note' END AS level, title || ': ' || n || ' matches' AS message FROM c JOIN meta USING (rule_idx)")
def export_sarif(spark: SparkSession, sf: str) -> DataFrame:
    run = export.sarif(found(spark, sf))["runs"][0]
    names = {r["id"]: r["name"] for r in run["tool"]["driver"]["rules"]}
    return spark.createDataFrame([(names[r["ruleId"]], r["level"], r["message"]["text"]) for r in run["results"]], "title string, level string, message string")


@query(f"{_COUNTS} SELECT title, n AS matches, n AS listed FROM c JOIN meta USING (rule_idx) WHERE n <= 100000")
def export_nested_json(spark: SparkSession, sf: str) -> DataFrame:
    """With the limit of its SQL: a rule of more matches is left out whole, as detection with a limit has it."""
    rows = export.nested_json(found(spark, sf, limit=100_000))
    return spark.createDataFrame([(r["title"], r["count"], len(r["matches"])) for r in rows], "title string, matches long, listed long")


@query("SELECT CAST(event_id AS VARCHAR) AS event_id, event_type AS channel, props FROM events")
def keepflat_contents(spark: SparkSession, sf: str) -> DataFrame:
    return _fields(export.keepflat(logs(spark, sf)), ("event_id", "event_id"), ("Channel", "channel"), ("props", "props"))


@query("SELECT event_id, md5(props) AS mark FROM events")
def null_columns_dropped(spark: SparkSession, sf: str) -> DataFrame:
    """Rows as JSON hold no key for a NULL."""
    df = logs(spark, sf).select("event_id", "props", F.lit(None).cast("string").alias("nothing"))
    value = export.keepflat(df)
    return value.where(~F.col("value").contains("nothing")).select(F.get_json_object("value", "$.event_id").cast("long").alias("event_id"), F.md5(F.get_json_object("value", "$.props").cast("binary")).alias("mark"))


# --- transforms: several inputs each, told by the row ------------------------------------------------------------

#: output column -> (input, output); the outputs follow from the label tables, which are fixed values.
CASES: dict[str, list[tuple[str, str]]] = {
    "<cmd>": [("6c73202d6c", "ls -l"), ("zz", "zz"), ("636174002f", "cat /"), ("616", "616")],
    "Payload_b64decoded": [("x SGVsbG8gV29ybGQsIHRoaXMgaXM=", "Hello World, this is"), ("abc", ""), ("////////////////////////", "b64_detected_cannot_decode")],
    "ServiceFileName_b64decoded": [("run SGVsbG8gV29ybGQsIHRoaXMgaXM= now", "Hello World, this is"), ("no run here", "")],
    "ScriptBlockText_b64decoded": [("$x = 'SGVsbG8gV29ybGQsIHRoaXMgaXM='", "Hello World, this is"), ("short", "")],
    "CommandLine_Extracted_Creds": [("net user bob s3cret /add", "bob|s3cret"), ("psexec \\\\h -u adm -p pw1 cmd", "adm|pw1"), ("nothing", "")],
    "CommandLine_XORIndicators": [("foreach ($b) { $b -bxor 0x41 }", "BXOR_OP|XOR_KEY:0x41|XOR_LOOP"), ("$a -bxor 7", "BXOR_OP|XOR_KEY:7"), ("plain", "")],
    "CommandLine_AMSIBypass": [("[Ref].Assembly.GetType('AmsiUtils')", "AMSI_REF|AMSI_REFLECTION"), ("load amsi.dll", "AMSI_REF|AMSI_DLL"), ("dir", "")],
    "CommandLine_HexStrings": [("0x48,0x65,0x6c,0x6c,0x6f", "0x_HEX|DECODED:Hello"), ("none", "")],
    "CommandLine_EnvVarObfuscation": [("%comspec:~0,1% %a% %b% %c% %TEMP%", "ENV_CHAR_EXTRACT|MULTI_ENV_VAR:4|ENV:TEMP"), ("echo", "")],
    "CommandLine_EvasionTechniques": [("NtUnmapViewOfSection in ntdll", "PROCESS_HOLLOWING|SYSCALL"), ("AdjustTokenPrivileges; CreateRemoteThread", "TOKEN_MANIPULATION|REMOTE_THREAD"), ("ping", "")],
    "CommandLine_RegistryPaths": [("reg add HKLM\\A\\b hklm\\a\\B HKCU\\c", "HKLM\\A\\b|HKCU\\c"), ("no key", "")],
    "CommandLine_EntropyScore": [("aabc", "LOW:1.5"), ("a", "LOW:0.00")],
    "CommandLine_LateralMovement": [("psexec \\\\h & wmic /node:h & mstsc /v:h & at \\\\h", "LATERAL:PSEXEC|LATERAL:WMI|LATERAL:RDP"), ("plink h", "LATERAL:SSH"), ("dir", "")],
    "CommandLine_DataStaging": [("rar a x.rar y", "STAGING:ARCHIVE"), ("mysqldump db & copy a.pst d", "STAGING:DB_DUMP|STAGING:EMAIL_COLLECT"), ("ntdsutil", "STAGING:AD_DUMP"), ("dir", "")],
    "CommandLine_C2Indicators": [("run beacon", "C2:COBALT_STRIKE"), ("use multi/handler lport = 1", "C2:METASPLOIT"), ("sliver start", "C2:SLIVER"), ("dir", "")],
    "CommandLine_PersistenceCategory": [("schtasks /create x", "PERSIST:SCHED_TASK"), ("sc create y & crontab -e", "PERSIST:SERVICE|PERSIST:CRON"), ("bcdedit /set z", "PERSIST:BOOT"), ("dir", "")],
    "CommandLine_ReconIndicators": [("whoami", "RECON:USER_ENUM"), ("systeminfo & ipconfig & tasklist", "RECON:SYSINFO|RECON:NETWORK|RECON:PROCESS"), ("net view", "RECON:SHARE"), ("dir", "")],
    "CommandLine_ConcatDeobfuscate": [("'po'+'wer' ^x^y`n", "DEOBF:CARET|DEOBF:CONCAT:power|DEOBF:BACKTICK"), ("dir", "")],
    "CommandLine_CryptoMining": [("xmrig -o stratum+tcp://nanopool --donate-level 1", "MINING:PROTOCOL|MINING:POOL:nanopool|MINING:TOOL:xmrig|MINING:MINER_ARGS"), ("dir", "")],
    "CommandLine_InjectionTechnique": [("WriteProcessMemory VirtualAllocEx", "INJECT:ALLOC_WRITE"), ("QueueUserAPC", "INJECT:APC"), ("dir", "")],
    "TargetFileName_SensitiveFile": [("C:\\x\\NTDS.dit", "SENSITIVE:CREDENTIAL_STORE|SENSITIVE:NTDS"), ("C:\\x\\notes.txt", "")],
    "DestinationIp_ObfuscationCheck": [("0x7f000001", "OBFUSCATED_IP:0x7f000001"), ("10.0.0.1", "")],
    "ParentImage_ExeName": [("C:\\a/b.exe", "b.exe"), ("\\x\\cmd.exe", "cmd.exe"), ("b.exe", "")],
    "Image_PathAnomaly": [("C:\\Users\\b\\AppData\\Local\\Temp\\x.exe", "TEMP_DIR|USER_TEMP"), ("C:\\Users\\b\\Downloads\\x.exe", "DOWNLOADS"), ("C:\\PerfLogs\\x.exe", "PERFLOGS"), ("C:\\x.exe", "")],
    "Image_StagingDirectory": [("C:\\Program Files\\Intel\\x", ""), ("\\\\h\\Intel\\x", "STAGING:VendorFolder|STAGING:UNC_Path"), ("/tmp/x", "STAGING:LinuxTmp"), ("C:\\ProgramData\\x", "STAGING:ProgramData")],
    "Image_MasqueradeDetect": [("C:\\tmp\\svchost.exe", "MASQUERADE:svchost.exe"), ("C:\\Windows\\System32\\svchost.exe", ""), ("C:\\x\\other.exe", "")],
    "ParentImage_SpawnAnomaly": [("C:\\WINWORD.EXE", "ANOMALY:OFFICE_SPAWN"), ("C:\\a\\chrome.exe", "ANOMALY:BROWSER_SPAWN"), ("C:\\a\\x.exe", "")],
    "ScriptBlockText_ObfuscationIndicators": [("x -join y", "JOIN_OP"), ("'a' + 'b' GzipStream", "STR_CONCAT|GZIPSTREAM"), ("${x} FromBase64String", "VAR_SUBST|FROMBASE64"), ("dir", "")],
    "ScriptBlockText_XORPatterns": [("-bxor 35 -bxor 0x10", "XOR_KEY:35|XOR_KEY:0|COMMON_XOR_KEY:35"), ("dir", "")],
    "ScriptBlockText_ReflectionAbuse": [("[System.Reflection.Assembly]::Load(x)", "ASSEMBLY_LOAD|DYNAMIC_LOAD"), ("$x.Invoke(1)", "INVOKE_METHOD"), ("GetField('a')", "GET_MEMBER"), ("dir", "")],
    "ScriptBlockText_ShellcodeIndicators": [("VirtualAlloc 0x40 kernel32", "EXEC_MEMORY_ALLOC|KERNEL32_REF"), ("CreateThread [IntPtr]", "CREATE_THREAD|POINTER_OP"), ("0x90, 0x90", "NOP_SLED"), ("dir", "")],
    "ScriptBlockText_NetworkIOCs": [("10.1.1.1 127.0.0.1 http://a.example.com/x. b.org", "IP:10.1.1.1|URL:http://a.example.com/x|DOMAIN:example.com|DOMAIN:b.org"), ("nothing", "")],
    "ScriptBlockText_StagerDetect": [("amsi; iex(iwr x)", "STAGER:STAGED_IEX|STAGER:AMSI_THEN_EXEC"), ("AppDomain.CurrentDomain", "STAGER:APPDOMAIN"), ("dir", "")],
    "ScriptBlockText_PackerIndicators": [("iex iex FromBase64String MemoryStream", "PACKER:MULTI_ENCODE|PACKER:NESTED_IEX"), ("dir", "")],
    "QueryName_EntropyScore": [("aabb.example.com", "50.0"), ("ab", "50.0"), ("aaaa.x", "0.0")],
    "QueryName_SubdomainAnalysis": [("a.b.c.d.example.com", "DNS:DEEP_SUB:4"), ("1234567.example.co.uk", "DNS:NUMERIC_SUB"), ("www.example.com", "")],
    "Image_LOLBinMatch": [("C:\\CertUtil.exe", "LOLBIN:certutil"), ("C:\\mshta.exe", "LOLBIN:mshta"), ("C:\\x.exe", "")],
    "Image_TyposquatDetect": [("svch0st.exe", "TYPOSQUAT:svchost(HOMOGLYPH)"), ("chromes.exe", "TYPOSQUAT:chrome(CHAR_ADD)"), ("wevtutil.exe", "")],
    "QueryName_TyposquatDetect": [("www.paypa1.com", "TYPOSQUAT_BANK:paypal(HOMOGLYPH,CHAR_SWAP)"), ("www.paypal.com", ""), ("micros0ft.xyz", "TYPOSQUAT_TECH:microsoft(HOMOGLYPH,CHAR_SWAP)|SUSPICIOUS_TLD:xyz"), ("localhost", "")],
    "CommandLine_DownloadCradle": [("certutil -urlcache x", "CERTUTIL_DOWNLOAD"), ("IEX (New-Object Net.WebClient).DownloadString(1)", "DOWNLOADSTRING|WEBCLIENT"), ("curl x", "CURL_WGET"), ("dir", "")],
    "TargetFileName_DoubleExtension": [("C:\\x\\a.pdf.EXE", "DOUBLE_EXT:pdf.exe"), ("a.doc.js", "DOUBLE_EXT:doc.js"), ("a.exe", "")],
    "TargetObject_SuspiciousRegistry": [("HKLM\\Software\\Run\\x\\Winlogon", "RUN_KEY|WINLOGON"), ("HKLM\\Services\\x", "SERVICE_KEY"), ("HKLM\\x", "")],
}


def _transform_cases(alias: str, pairs: list[tuple[str, str]]) -> None:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        e = table(spark, sf, "events").select("event_id", _one_of([a for a, _ in pairs], "event_id").alias("v"))
        return e.select("event_id", TR.REGISTRY[alias][1](F.col("v")).alias("out"))

    run.__name__ = "trv_" + alias.strip("<>").lower()
    query(f"SELECT event_id, {_case([b for _, b in pairs], 'event_id')} AS out FROM events")(run)


for _alias, _pairs in CASES.items():
    _transform_cases(_alias, _pairs)
