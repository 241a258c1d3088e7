"""The driver's queries for the log-detection operators, each with its SQL where SQL can say it."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import Mapping
from .functions import transforms as TR
from .operators import export, flatten, rules, summarize
from .operators.correlate import correlate
from .operators.detect import Detections, detect
from .plans import predicates as P
from .plans import sigma
from .sources import formats, readers

Query = Callable[[SparkSession, str], DataFrame]
_queries: dict[str, Query] = {}
_sql: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        _queries[fn.__name__] = fn
        if sql:
            _sql[fn.__name__] = sql
        return fn

    return add


def queries() -> dict[str, Query]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_sql)


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def logs(spark: SparkSession, sf: str) -> DataFrame:
    """Events as a log table: the type is the channel, the user is the event id, the time is text."""
    e = table(spark, sf, "events")
    time = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    return e.select(F.col("event_id"), F.col("event_type").alias("Channel"), F.col("user_id").alias("EventID"), F.col("value"), F.col("props"), time.alias("SystemTime"))


def shared_path(spark: SparkSession, what: str) -> str:
    """A new folder that all executors share: below spark.checkpoint.dir, or, in a local session without it, a temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="embertrail-")
    return f"{base.rstrip('/')}/{what}-{uuid.uuid4().hex}"


# --- predicates --------------------------------------------------------------------------------------------------


def predicate(name: str, source: str, columns: dict[str, str], where: str, sql_where: str, shown: str) -> None:
    """Register: the ids of a table's rows for which a rule condition holds. columns: name in the rule to Spark SQL expression."""

    def run(spark: SparkSession, sf: str) -> DataFrame:
        df = table(spark, sf, source).select(F.col(shown).alias("id"), *[F.expr(e).alias(n) for n, e in columns.items()])
        tree = P.parse_condition(where)
        if P.never(df.schema, tree):
            return df.select("id").limit(0)
        return df.where(P.Compiler(df.schema).condition(tree)).select("id")

    run.__name__ = name
    query(f"SELECT {shown} AS id FROM {source} WHERE {sql_where}")(run)


_EV = {"event_type": "event_type", "user_id": "user_id"}
predicate("pred_eq_nocase", "events", _EV, "event_type = 'ERROR'", "lower(event_type) = 'error'", "event_id")
predicate("pred_ne", "events", _EV, "event_type != 'View'", "lower(event_type) <> 'view'", "event_id")
predicate("pred_compare", "events", _EV, "user_id >= 100 AND user_id < 120", "user_id >= 100 AND user_id < 120", "event_id")
predicate("pred_like_contains", "part", {"p_name": "p_name"}, "p_name LIKE '%RE%'", "lower(p_name) LIKE '%re%'", "p_partkey")
predicate("pred_like_prefix", "part", {"p_type": "p_type"}, "p_type LIKE 'STANDARD%'", "lower(p_type) LIKE 'standard%'", "p_partkey")
predicate("pred_like_suffix", "part", {"p_type": "p_type"}, "p_type LIKE '%um'", "lower(p_type) LIKE '%um'", "p_partkey")
predicate("pred_like_single", "part", {"p_brand": "p_brand"}, "p_brand LIKE 'brand#_2'", "lower(p_brand) LIKE 'brand#_2'", "p_partkey")
predicate("pred_like_escape", "documents", {"text": "text"}, r"text LIKE '%\%\%\%%' ESCAPE '\'", "contains(text, '%%%')", "doc_id")
predicate("pred_not_like_null", "events", {"t": "nullif(event_type, 'view')"}, "NOT t LIKE '%e%'", "NOT lower(nullif(event_type, 'view')) LIKE '%e%'", "event_id")
predicate("pred_regexp", "documents", {"text": "text"}, "text REGEXP '[0-9]{4} [a-z]'", "regexp_matches(text, '[0-9]{4} [a-z]')", "doc_id")
predicate("pred_not_regexp_null", "orders", {"p": "nullif(o_orderpriority, '1-URGENT')"}, "NOT p REGEXP '^[1-3]'", "NOT coalesce(regexp_matches(nullif(o_orderpriority, '1-URGENT'), '^[1-3]'), false)", "o_orderkey")
predicate("pred_in", "events", _EV, "event_type IN ('CLICK', 'signup') AND user_id IN (1, 2, 3, 5, 8)", "lower(event_type) IN ('click', 'signup') AND user_id IN (1, 2, 3, 5, 8)", "event_id")
predicate("pred_between", "lineitem", {"q": "cast(l_quantity AS double)"}, "q BETWEEN 10 AND 12", "l_quantity BETWEEN 10 AND 12", "l_orderkey")
predicate("pred_is_null", "events", {"t": "nullif(event_type, 'view')"}, "t IS NULL", "nullif(event_type, 'view') IS NULL", "event_id")
predicate("pred_not_null_or", "events", {"t": "nullif(event_type, 'view')", "u": "user_id"}, "t IS NOT NULL AND NOT (u < 50 OR t = 'click')", "event_type <> 'view' AND NOT (user_id < 50 OR event_type = 'click')", "event_id")
predicate("pred_int_text_affinity", "events", {"u": "user_id", "t": "cast(user_id AS string)"}, "u = '7' OR t = 9", "user_id IN (7, 9)", "event_id")
predicate("pred_cast_real", "part", {"t": "cast(p_retailprice AS string)"}, "CAST(t AS REAL) > 950.5 AND t != ''", "p_retailprice > 950.5", "p_partkey")
predicate("pred_missing_column", "events", _EV, "event_type = 'view' OR nowhere = 1", "false", "event_id")


@query("SELECT count(*) AS n, count(DISTINCT lower(event_type)) AS kinds FROM events WHERE lower(event_type) LIKE '%i%'")
def adhoc_distinct_count(spark: SparkSession, sf: str) -> DataFrame:
    return P.run_select(logs(spark, sf), "SELECT COUNT(*) AS n, COUNT(DISTINCT Channel) AS kinds FROM logs WHERE Channel LIKE '%I%'")


@query("SELECT event_type AS channel, count(*) AS n FROM events WHERE user_id < 40 GROUP BY event_type HAVING count(*) > 10")
def adhoc_group_by(spark: SparkSession, sf: str) -> DataFrame:
    return P.run_select(logs(spark, sf), "SELECT Channel AS channel, COUNT(*) AS n FROM logs WHERE EventID < 40 GROUP BY Channel HAVING COUNT(*) > 10")


@query("SELECT DISTINCT event_type AS channel FROM events")
def adhoc_distinct(spark: SparkSession, sf: str) -> DataFrame:
    return P.run_select(logs(spark, sf), "SELECT DISTINCT Channel AS channel FROM logs")


# --- rulesets ----------------------------------------------------------------------------------------------------

#: title, level, tags, statements (condition over logs), the same conditions in SQL over events
RULES: list[tuple[str, str, list[str], list[str], list[str]]] = [
    ("Error by low id", "high", ["attack.t1059.001", "attack.execution"], ["Channel = 'ERROR' AND EventID < 20"], ["event_type = 'error' AND user_id < 20"]),
    ("Click or signup", "medium", ["attack.t1078", "attack.persistence", "attack.initial_access"], ["Channel IN ('click','signup') AND EventID = 7"], ["event_type IN ('click','signup') AND user_id = 7"]),
    ("Key ends in 9", "low", ["attack.t1003", "attack.credential_access"], ["props LIKE '%9}'"], ["props LIKE '%9}'"]),
    ("Two statements", "critical", ["attack.t1059", "attack.execution"], ["Channel = 'purchase' AND EventID < 3", "Channel = 'purchase' AND props LIKE '%1%'"], ["event_type = 'purchase' AND user_id < 3", "event_type = 'purchase' AND props LIKE '%1%'"]),
    ("Missing column", "high", [], ["Channel = 'view' OR Nowhere = 1"], ["false"]),
    ("Views", "informational", ["attack.discovery"], ["Channel LIKE 'VI_W' AND NOT EventID > 3"], ["event_type = 'view' AND NOT user_id > 3"]),
    ("Regular expression", "unknown", ["attack.t1059.001"], ["props REGEXP '\"k\": [0-4]}'"], ["regexp_matches(props, '\"k\": [0-4]}')"]),
]


def ruleset() -> list[rules.Rule]:
    return [rules.Rule(t, id=f"r{i}", level=lv, tags=tags, description=t.lower(), rule=[f"SELECT * FROM logs WHERE {w}" for w in ws]) for i, (t, lv, tags, ws, _) in enumerate(RULES)]


_MATCHES = " UNION ALL ".join(f"SELECT {i} AS rule_idx, {q} AS query_idx, event_id FROM events WHERE {w}" for i, (*_, ws) in enumerate(RULES) for q, w in enumerate(ws))
_META = " UNION ALL ".join(f"SELECT {i} AS rule_idx, '{t}' AS title, '{lv}' AS level" for i, (t, lv, *_) in enumerate(RULES))
_COUNTS = f"WITH m AS ({_MATCHES}), meta AS ({_META}), c AS (SELECT rule_idx, count(*) AS n FROM m GROUP BY rule_idx)"


def found(spark: SparkSession, sf: str, limit: int | None = None) -> Detections:
    return detect(logs(spark, sf), ruleset(), limit=limit)


@query(_MATCHES)
def ruleset_detections(spark: SparkSession, sf: str) -> DataFrame:
    return found(spark, sf).matches.select("rule_idx", "query_idx", "event_id")


@query(f"{_COUNTS} SELECT title, level, n AS matches FROM c JOIN meta USING (rule_idx)")
def ruleset_counts(spark: SparkSession, sf: str) -> DataFrame:
    return found(spark, sf).counts().select("title", "level", F.col("count").alias("matches"))


_RANK = "CASE level WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 WHEN 'low' THEN 3 WHEN 'informational' THEN 4 ELSE 5 END"


@query(f"{_COUNTS} SELECT title, n AS matches, row_number() OVER (ORDER BY {_RANK}, n DESC, rule_idx) AS place FROM c JOIN meta USING (rule_idx)")
def ruleset_severity_sorted(spark: SparkSession, sf: str) -> DataFrame:
    from pyspark.sql import Window

    w = Window.orderBy(rules.rank_column(F.col("level")), F.desc("count"), "rule_idx")
    return found(spark, sf).counts().select("title", F.col("count").alias("matches"), F.row_number().over(w).cast("long").alias("place"))


@query(f"{_COUNTS} SELECT title, n AS matches FROM c JOIN meta USING (rule_idx) ORDER BY {_RANK}, n DESC, rule_idx LIMIT 5")
def top_detections(spark: SparkSession, sf: str) -> DataFrame:
    return summarize.top(found(spark, sf).counts(), 5).select("title", F.col("count").alias("matches"))


@query("SELECT 'Two statements' AS title, count(*) AS matches FROM (SELECT event_id FROM events WHERE event_type = 'purchase' AND user_id < 3 UNION ALL SELECT event_id FROM events WHERE event_type = 'purchase' AND props LIKE '%1%')")
def rule_multi_query(spark: SparkSession, sf: str) -> DataFrame:
    return detect(logs(spark, sf), [ruleset()[3]]).counts().select("title", F.col("count").alias("matches"))


@query(f"{_COUNTS} SELECT rule_idx, n AS matches FROM c WHERE n <= 300")
def rule_limit(spark: SparkSession, sf: str) -> DataFrame:
    return found(spark, sf, limit=300).counts().select("rule_idx", F.col("count").alias("matches"))


@query(f"{_COUNTS} SELECT CASE WHEN level = 'unknown' THEN 'other' ELSE level END AS level, count(*) AS detections, sum(n) AS total FROM c JOIN meta USING (rule_idx) GROUP BY 1")
def severity_totals(spark: SparkSession, sf: str) -> DataFrame:
    return summarize.severity_totals(found(spark, sf).counts())


@query(f"{_COUNTS} SELECT count(*) AS matched, {len(RULES)} AS total, count(*) * 100.0 / {len(RULES)} AS percent FROM c")
def rule_coverage(spark: SparkSession, sf: str) -> DataFrame:
    return summarize.rule_coverage(found(spark, sf).counts(), len(RULES)).withColumn("percent", F.col("percent").cast("double"))


_TACTIC = " UNION ALL ".join(f"SELECT {i} AS rule_idx, '{summarize.TACTICS[x[7:].replace('_', '-')]}' AS tactic, {sum(y.startswith('attack.t1') for y in tags)} AS k, '{next((y[7:].upper() for y in tags if y.startswith('attack.t1')), '')}' AS technique" for i, (_, _, tags, *_) in enumerate(RULES) for x in tags if not x.startswith("attack.t1"))


@query(f"{_COUNTS}, ta AS ({_TACTIC}) SELECT tactic, count(DISTINCT nullif(technique, '')) AS techniques, sum(n) AS hits, count(DISTINCT rule_idx) AS rules FROM c JOIN ta USING (rule_idx) GROUP BY tactic")
def attack_tactics(spark: SparkSession, sf: str) -> DataFrame:
    return summarize.attack_tactics(found(spark, sf).counts())


_TECH = " UNION ALL ".join(
    f"SELECT {i} AS rule_idx, '{x[7:].upper()}' AS technique, {repr(summarize.TACTICS[t[7:].replace('_', '-')]) if t else 'NULL'} AS tactic"
    for i, (_, _, tags, *_) in enumerate(RULES) for x in tags if x.startswith("attack.t1") for t in ([y for y in tags if not y.startswith("attack.t1")] or [""])
)


@query(f"{_COUNTS}, te AS ({_TECH}) SELECT technique, tactic, sum(n) AS score, count(DISTINCT rule_idx) AS n_rules FROM c JOIN te USING (rule_idx) GROUP BY technique, tactic")
def navigator_techniques(spark: SparkSession, sf: str) -> DataFrame:
    return summarize.navigator(found(spark, sf).counts()).select("technique", "tactic", "score", "n_rules")


@query("SELECT source AS source_file, count(*) AS events, count(DISTINCT CASE WHEN contains(text, '%%%') THEN 0 END) + count(DISTINCT CASE WHEN contains(lower(text), 'license') THEN 1 END) AS detections FROM documents GROUP BY source")
def file_stats(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select(F.col("source").alias("source_file"), "text")
    two = [rules.Rule("Symbols", rule=[r"SELECT * FROM logs WHERE text LIKE '%\%\%\%%' ESCAPE '\'"]), rules.Rule("License", rule=["SELECT * FROM logs WHERE text LIKE '%LICENSE%'"])]
    return summarize.file_stats(d, detect(d, two, None).matches)


@query("SELECT title, sum(n) AS matches FROM (SELECT 'Same title' AS title, count(*) AS n FROM events WHERE user_id = 1 UNION ALL SELECT 'Same title', count(*) FROM events WHERE user_id = 2) GROUP BY title")
def cross_file_roll_up(spark: SparkSession, sf: str) -> DataFrame:
    two = [rules.Rule("Same title", level=lv, rule=[f"SELECT * FROM logs WHERE EventID = {i}"]) for i, lv in ((1, "high"), (2, "low"))]
    return summarize.roll_up(detect(logs(spark, sf), two).counts()).select("title", F.col("count").alias("matches"))


@query()
def rule_tests(spark: SparkSession, sf: str) -> DataFrame:
    cases = [{"title": "Error by low id", "true_positive": [{"Channel": "error", "EventID": 3}], "true_negative": [{"Channel": "view", "EventID": 3}]}]
    rows = rules.run_tests(spark, ruleset(), cases)
    return spark.createDataFrame([(r["title"], r["true_positive"], r["true_negative"]) for r in rows], "title string, true_positive boolean, true_negative boolean")


@query("SELECT * FROM (VALUES ('EventID', 4), ('Channel', 6), ('props', 3), ('Nowhere', 1)) t(name, n)")
def column_frequency(spark: SparkSession, sf: str) -> DataFrame:
    return spark.createDataFrame(rules.column_frequency(ruleset(), 10), "name string, n long")


@query("SELECT 0 AS rule_idx, event_id FROM events WHERE event_type IN ('error','click') AND user_id <= 30 AND NOT (contains(props, '1') AND contains(props, '5')) UNION ALL SELECT 1, event_id FROM events WHERE event_type LIKE 'v%w' OR event_type LIKE '%up'")
def sigma_rules(spark: SparkSession, sf: str) -> DataFrame:
    docs = [
        {"title": "A", "level": "high", "logsource": {"product": "x"}, "detection": {"sel": {"Channel": ["ERROR", "Click"], "EventID|lte": 30}, "no": {"props|contains|all": ["1", "5"]}, "condition": "sel and not no"}},
        {"title": "B", "level": "low", "logsource": {"product": "x"}, "detection": {"a": {"Channel": "V*w"}, "b": {"Channel|endswith": "up"}, "condition": "1 of them"}},
    ]
    made, _ = rules.compile_docs(docs)
    return detect(logs(spark, sf), made).matches.select("rule_idx", "event_id")


# --- filters -----------------------------------------------------------------------------------------------------


def _filter() -> rules.EventFilter:
    return rules.EventFilter.of([rules.Rule("a", rule=["x"], channel=["ERROR"], eventid=[1, 2, 3]), rules.Rule("b", rule=["y"], channel=["click"], eventid=[4, 5])])


def _nullable(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select("event_id", F.nullif("event_type", F.lit("view")).alias("channel"), F.nullif("user_id", F.lit(9)).alias("eventid"))


_KEEP = "(nullif(event_type, 'view') IS NULL OR nullif(user_id, 9) IS NULL OR (event_type IN ('error','click') AND user_id IN (1,2,3,4,5)))"


@query(f"SELECT event_id FROM events WHERE {_KEEP}")
def event_filter(spark: SparkSession, sf: str) -> DataFrame:
    return _nullable(spark, sf).where(_filter().keeps(F.col("channel"), F.col("eventid"))).select("event_id")


@query(f"SELECT count(*) FILTER (WHERE {_KEEP}) AS kept, count(*) FILTER (WHERE NOT {_KEEP}) AS filtered FROM events")
def event_filter_stats(spark: SparkSession, sf: str) -> DataFrame:
    return summarize.filter_efficiency(_nullable(spark, sf), _filter().keeps(F.col("channel"), F.col("eventid"))).select("kept", "filtered")


@query("SELECT event_id FROM events WHERE event_type = 'view' OR (strftime(ts, '%Y-%m-%dT%H:%M:%S') > '2024-01-10T00:00:00' AND strftime(ts, '%Y-%m-%dT%H:%M:%S') < '2024-01-12T12:00:00')")
def time_filter_strict(spark: SparkSession, sf: str) -> DataFrame:
    t = F.when(F.col("Channel") != "view", F.col("SystemTime"))
    return logs(spark, sf).where(flatten.time_range(t, "2024-01-10T00:00:00", "2024-01-12T12:00:00")).select("event_id")


@query("SELECT event_type AS name, CASE event_type WHEN 'view' THEN 0 ELSE 0 END AS score, count(*) AS n FROM events GROUP BY event_type UNION ALL SELECT 'created_at', 50, 1 UNION ALL SELECT 'my_timestamp', 90, 1 UNION ALL SELECT 'timeout', 0, 1 UNION ALL SELECT 'date', 70, 1 UNION ALL SELECT 'ts', 60, 1 UNION ALL SELECT 'SystemTime', 100, 1")
def timestamp_score(spark: SparkSession, sf: str) -> DataFrame:
    names = table(spark, sf, "events").groupBy(F.col("event_type").alias("name")).agg(F.count("*").alias("n"))
    more = spark.createDataFrame([(x, 1) for x in ("created_at", "my_timestamp", "timeout", "date", "ts", "SystemTime")], "name string, n long")
    return names.unionByName(more).select("name", formats.time_score_column(F.col("name")).alias("score"), "n")


@query("SELECT count(*) AS n, count(*) AS times, 0 AS texts FROM events")
def looks_like_timestamp(spark: SparkSession, sf: str) -> DataFrame:
    yes = lambda c: F.count_if(formats.looks_like_time_column(F.col(c)))
    return logs(spark, sf).agg(F.count("*").alias("n"), yes("SystemTime").alias("times"), yes("Channel").alias("texts"))


# --- flattening --------------------------------------------------------------------------------------------------


def raw_events(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    event = F.struct(
        F.struct(F.col("user_id").alias("EventID"), F.col("event_type").alias("Channel")).alias("System"),
        F.struct(F.col("event_id").alias("row_no"), F.get_json_object("props", "$.k").cast("long").alias("k-val"), F.lit("").alias("empty"), F.lit("x").alias("xmlns")).alias("EventData"),
    )
    return e.select(F.lit("dir/events.json").alias("source_file"), F.to_json(F.struct(event.alias("Event"))).alias("raw"))


@query("SELECT event_id AS rowno, event_type AS Channel, user_id AS EventID, CAST(json_extract_string(props, '$.k') AS BIGINT) AS kval, 'events.json' AS OriginalLogfile FROM events")
def flatten_json(spark: SparkSession, sf: str) -> DataFrame:
    flat = flatten.flatten(raw_events(spark, sf), Mapping(transforms=[]))
    return flat.select("rowno", "Channel", "EventID", "kval", "OriginalLogfile")


@query("SELECT event_id, event_type AS Channel, user_id AS EventID FROM events")
def flatten_known(spark: SparkSession, sf: str) -> DataFrame:
    paths = {"Event.System.Channel": "Channel", "Event.System.EventID": "EventID", "Event.EventData.row_no": "event_id"}
    return flatten.flatten_known(raw_events(spark, sf), paths, {"EventID", "event_id"}).select("event_id", "Channel", "EventID")


@query("SELECT p_partkey, p_brand AS A, p_type AS B FROM part")
def split_kv(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part").select("p_partkey", F.concat(F.lit("A="), "p_brand", F.lit(",B="), "p_type").alias("h"))
    m = flatten.split_column(F.col("h"), ",", "=")
    return p.select("p_partkey", m["A"].alias("A"), m["B"].alias("B"))


@query("SELECT o_orderkey AS id, o_orderstatus AS status, NULL AS name FROM orders UNION ALL SELECT c_custkey, NULL, c_name FROM customer")
def dynamic_schema_union(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"))
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    return o.unionByName(c, allowMissingColumns=True).select("id", "status", "name")


@query("SELECT event_id, 'audit' AS type, event_type AS op, 'offline' AS host, strftime(ts, '%Y-%m-%d %H:%M:%S') AS stamp FROM events")
def parse_auditd(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    line = F.concat(F.lit("type=audit msg=audit("), F.unix_seconds(F.col("ts").cast("timestamp")).cast("string"), F.lit('.123:7): op="'), "event_type", F.lit('" id='), F.col("event_id").cast("string"))
    m = readers.auditd_fields(F.col("line"))
    return e.select(line.alias("line")).select(m.alias("m")).select(F.col("m")["id"].cast("long").alias("event_id"), F.col("m")["type"].alias("type"), F.col("m")["op"].alias("op"), F.col("m")["host"].alias("host"), F.col("m")["timestamp"].alias("stamp"))


# --- correlations ------------------------------------------------------------------------------------------------


def _correlation(kind: str, number: int, group: list[str], of: str | None = None, names: tuple[str, ...] = ("err",), span: str = "1h") -> sigma.Correlation:
    base = {"err": {"Channel": "ERROR"}, "buy": {"Channel": "purchase"}}
    docs = [{"title": n, "name": n, "logsource": {"product": "x"}, "detection": {"s": base[n], "condition": "s"}} for n in names]
    cond = {"gte": number} | ({"field": of} if of else {})
    made, notes = rules.compile_docs([*docs, {"title": kind, "correlation": {"type": kind, "rules": list(names), "group-by": group, "timespan": span, "condition": cond}}])
    got = [r for r in made if r.correlation]
    if not got:
        raise ValueError(notes)
    return got[0].correlation  # type: ignore[return-value]


@query("SELECT user_id AS EventID, count(*) AS event_count FROM events WHERE event_type = 'error' GROUP BY user_id HAVING count(*) >= 3")
def corr_event_count(spark: SparkSession, sf: str) -> DataFrame:
    return correlate(logs(spark, sf), _correlation("event_count", 3, ["EventID"]))


@query("SELECT user_id AS EventID, count(DISTINCT props) AS value_count FROM events WHERE event_type = 'error' GROUP BY user_id HAVING count(DISTINCT props) >= 2")
def corr_value_count(spark: SparkSession, sf: str) -> DataFrame:
    return correlate(logs(spark, sf), _correlation("value_count", 2, ["EventID"], "props"))


@query("SELECT user_id AS EventID, CAST(floor(epoch(date_trunc('second', ts)) / 3600) * 3600 AS BIGINT) AS window_start, count(*) AS event_count FROM events WHERE event_type = 'error' GROUP BY 1, 2 HAVING count(*) >= 2")
def corr_event_count_window(spark: SparkSession, sf: str) -> DataFrame:
    return correlate(logs(spark, sf), _correlation("event_count", 2, ["EventID"]), windowed=True)


@query("""WITH e AS (SELECT user_id, event_type, CAST(epoch(date_trunc('second', ts)) AS BIGINT) AS t FROM events WHERE event_type IN ('error', 'purchase')),
h AS (SELECT a.user_id, a.t, a.event_type FROM e a WHERE EXISTS (SELECT 1 FROM e b WHERE b.user_id = a.user_id AND b.event_type <> a.event_type AND b.t BETWEEN a.t AND a.t + 3600))
SELECT user_id AS EventID, count(*) AS event_count, min(t) AS first_time, 2 AS rule_count FROM h GROUP BY user_id""")
def corr_temporal(spark: SparkSession, sf: str) -> DataFrame:
    return correlate(logs(spark, sf), _correlation("temporal", 2, ["EventID"], names=("err", "buy")), time_field="SystemTime")


# --- transforms --------------------------------------------------------------------------------------------------


def transform(name: str, alias: str, source: str, key: str, value: str, sql_value: str) -> None:
    """Register: the output of a transform over a column of a table."""

    def run(spark: SparkSession, sf: str) -> DataFrame:
        return table(spark, sf, source).select(F.col(key).alias("id"), TR.REGISTRY[alias][1](F.expr(value)).alias("out"))

    run.__name__ = name
    query(f"SELECT {key} AS id, {sql_value} AS out FROM {source}" if sql_value else None)(run)


_N = "length(text)"
transform("tr_length", "CommandLine_Length", "documents", "doc_id", "text", f"CASE WHEN {_N} < 50 THEN 'SHORT:' WHEN {_N} < 200 THEN 'NORMAL:' WHEN {_N} < 500 THEN 'LONG:' WHEN {_N} < 1000 THEN 'VERY_LONG:' ELSE 'EXTREME:' END || {_N}")
transform("tr_urls", "CommandLine_URLs", "pages", "page_id", "concat('get ', url, ', now')", "rtrim(url, '.,;:)]')")
transform("tr_user_name", "User_Name", "part", "p_partkey", r"concat('CORP\\', p_brand)", "p_brand")
transform("tr_user_domain", "User_Domain", "part", "p_partkey", "concat(p_type, '@', p_brand)", "p_brand")
transform("tr_exe_name", "Image_ExeName", "part", "p_partkey", r"concat('C:\\bin/', p_brand, '.exe')", "p_brand || '.exe'")
transform("tr_tld", "QueryName_TLD", "pages", "page_id", "split_part(url, '/', 3)", "CASE WHEN contains(split_part(url, '/', 3), '.') THEN regexp_extract(split_part(url, '/', 3), '([^.]*)$', 1) ELSE '' END")
transform("tr_hash_md5", "Hash_MD5", "part", "p_partkey", "concat('SHA1=1,MD5=', md5(p_name), ',X=')", "md5(p_name)")
transform("tr_hash_sha256", "Hash_SHA256", "part", "p_partkey", "concat('MD5=0,SHA256=', sha2(p_name, 256))", "sha256(p_name)")
transform("tr_port_category", "DestinationPort_Category", "part", "p_partkey", "cast(p_partkey * 40 AS string)", "CASE p_partkey * 40 WHEN 80 THEN 'HTTP' WHEN 8080 THEN 'ALT_HTTP' WHEN 8000 THEN 'DEV_HTTP' WHEN 9200 THEN 'ELASTICSEARCH' WHEN 1080 THEN 'SOCKS' WHEN 5000 THEN 'DOCKER_REGISTRY' WHEN 6000 THEN 'X11' WHEN 50000 THEN 'SAP' WHEN 1433 THEN 'MSSQL' ELSE CASE WHEN p_partkey * 40 >= 49152 THEN 'EPHEMERAL' WHEN p_partkey * 40 >= 1024 THEN 'HIGH_PORT' ELSE 'WELL_KNOWN' END END")
transform("tr_logon_type", "LogonType_Description", "lineitem", "l_orderkey", "cast(l_linenumber AS string)", "CASE l_linenumber WHEN 2 THEN 'INTERACTIVE' WHEN 3 THEN 'NETWORK' WHEN 4 THEN 'BATCH' WHEN 5 THEN 'SERVICE' WHEN 7 THEN 'UNLOCK' ELSE 'UNKNOWN:' || l_linenumber END")
transform("tr_double_ext", "TargetFileName_DoubleExtension", "part", "p_partkey", "concat('a/', p_brand, '.pdf.EXE')", "'DOUBLE_EXT:pdf.exe'")
transform("tr_lolbin", "Image_LOLBinMatch", "events", "event_id", "concat('C:/', if(event_type = 'view', 'CertUtil', event_type), '.exe')", "CASE WHEN event_type = 'view' THEN 'LOLBIN:certutil' ELSE '' END")
transform("tr_typosquat", "Image_TyposquatDetect", "events", "event_id", "concat('C:/', if(event_type = 'view', 'svch0st', event_type), '.exe')", "CASE WHEN event_type = 'view' THEN 'TYPOSQUAT:svchost(HOMOGLYPH)' ELSE '' END")
transform("tr_query_typosquat", "QueryName_TyposquatDetect", "events", "event_id", "concat('www.', if(event_type = 'view', 'paypa1', 'intranet'), '.com')", "CASE WHEN event_type = 'view' THEN 'TYPOSQUAT_BANK:paypal(HOMOGLYPH,CHAR_SWAP)' ELSE '' END")
transform("tr_indicators", "CommandLine_DownloadCradle", "events", "event_id", "concat('IEX (New-Object Net.WebClient).DownloadString(1); curl ', event_type)", "'DOWNLOADSTRING|WEBCLIENT|CURL_WGET'")
transform("tr_entropy", "CommandLine_EntropyScore", "part", "p_partkey", "p_name", "")
transform("tr_b64decoded", "CommandLine_b64decoded", "part", "p_partkey", "concat('-enc ', base64(cast(rpad(p_name, 30, '.') AS binary)))", "rpad(p_name, 30, '.')")
transform("tr_url_decoded", "TargetFileName_URLDecoded", "part", "p_partkey", "concat(p_brand, '%20x')", "p_brand || ' x'")
transform("tr_hex_ascii", "<proctitle>", "part", "p_partkey", "hex(cast(p_name AS binary))", "p_name")
transform("tr_registry", "TargetObject_SuspiciousRegistry", "events", "event_id", r"concat('HKLM\\Software\\Run\\', event_type)", "'RUN_KEY'")


@query()
def transforms_all(spark: SparkSession, sf: str) -> DataFrame:
    """Every transform over the addresses of the pages: how many get an output, per output column."""
    outputs: list[Column] = [F.count_if(fn(F.col("url")) != "").alias(alias.strip("<>")) for alias, (_, fn) in TR.REGISTRY.items()]
    return table(spark, sf, "pages").select("url").agg(*outputs)


# --- sinks -------------------------------------------------------------------------------------------------------


@query(f"{_COUNTS} SELECT count(*) AS lines FROM m")
def export_ndjson(spark: SparkSession, sf: str) -> DataFrame:
    return export.ndjson(found(spark, sf), with_level=True).agg(F.count_if(F.get_json_object("value", "$.title").isNotNull()).alias("lines"))


@query(f"{_COUNTS} SELECT title AS rule_title, level AS rule_level, n AS matches FROM c JOIN meta USING (rule_idx)")
def export_summary_csv(spark: SparkSession, sf: str) -> DataFrame:
    return export.summary_csv(found(spark, sf)).select("rule_title", "rule_level", F.col("count").alias("matches"))


@query("SELECT count(*) AS lines FROM events")
def keepflat(spark: SparkSession, sf: str) -> DataFrame:
    return export.keepflat(logs(spark, sf)).agg(F.count_if(F.try_parse_json("value").isNotNull()).alias("lines"))


@query()
def line_hash(spark: SparkSession, sf: str) -> DataFrame:
    return flatten.keyed(raw_events(spark, sf), Mapping(), hashes=True).select("row_hash")


@query("SELECT event_id, event_type AS Channel FROM events WHERE event_type = 'error'")
def saved_table(spark: SparkSession, sf: str) -> DataFrame:
    path = shared_path(spark, "saved")
    export.save(logs(spark, sf), path)
    return P.run_select(readers.saved(spark, path), "SELECT event_id, Channel FROM logs WHERE Channel = 'ERROR'")


from . import queries_more  # noqa: E402, F401 (registers its queries)
