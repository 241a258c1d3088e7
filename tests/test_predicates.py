"""Compiled predicates against SQLite on the same table, over a grid of values and operators."""

import itertools
import re
import sqlite3

import pytest
from pyspark.sql import functions as F

from embertrail.functions.strings import like_tokens
from embertrail.plans import predicates as P

ROWS = [
    (1, "cmd.exe", 1), (2, "CMD.EXE", 4688), (3, "", 0), (4, None, None), (5, "a_b%c", -5), (6, "École", 123), (7, "école", 12), (8, "123", 5), (9, "9", 9),
    (10, "C:\\Windows\\cmd.exe", 17), (11, "line\nbreak", 20), (12, "  7 x", 7), (13, "[x]*(y)", 10),
]
CONDITIONS = [
    "t = 'CMD.exe'", "t != 'cmd.exe'", "t <> ''", "t = 123", "n = '1'", "n = 'abc'", "n != 'abc'", "n < 'abc'", "n = 4688", "n IN (1, '17', 'x')", "t IN ('CMD.EXE', '9', 123)", "t < 'b'", "t > 5",
    "t LIKE '%CMD%'", "t LIKE 'c%'", "t LIKE '%.exe'", "t LIKE '_'", "t LIKE 'a\\_b\\%c' ESCAPE '\\'", "t LIKE '%\\W%' ESCAPE '\\'", "t LIKE '%\\\\cmd.exe' ESCAPE '\\'", "t LIKE 'line%break'", "t LIKE 'É%'",
    "t LIKE '%[x]*(%'", "t LIKE ''", "t LIKE '%'", "NOT t LIKE '%e%'", "t NOT LIKE '%e%' OR t IS NULL", "t REGEXP '^c'", "NOT t REGEXP 'c'", "t REGEXP '(unclosed'", "t REGEXP '\\.exe$'", "t IS NULL", "t IS NOT NULL",
    "n BETWEEN 5 AND 17", "n NOT BETWEEN 5 AND 17", "NOT (n > 5 AND t LIKE '%c%')", "CAST(t AS REAL) > 5", "CAST(t AS INTEGER) = 7", "n + 1 = 6", "length(t) > 5", "n IN (5) AND (t = '123' OR t = 'x')", "\"nowhere\" = 'nowhere'",
    "t NOT IN ('9')", "NOT n = 5", "n >= 9 AND n <= 17", "t = 'école'",
]


@pytest.fixture(scope="module")
def both(spark):
    con = sqlite3.connect(":memory:")
    con.execute("CREATE TABLE logs (id INTEGER PRIMARY KEY, t TEXT COLLATE NOCASE, n INTEGER)")
    con.executemany("INSERT INTO logs VALUES (?, ?, ?)", ROWS)

    def regexp(pattern, value):
        try:
            return 0 if value is None else int(bool(re.search(pattern, value)))
        except re.error:
            return 0

    con.create_function("regexp", 2, regexp)
    return con, spark.createDataFrame(ROWS, "id int, t string, n bigint")


def test_conditions_agree_with_sqlite(both):
    con, df = both
    compiler = P.Compiler(df.schema)
    marks = [F.coalesce(compiler.condition(P.parse_condition(c)), F.lit(False)).alias(f"c{i}") for i, c in enumerate(CONDITIONS)]
    got = df.select("id", *marks).collect()
    for i, c in enumerate(CONDITIONS):
        want = {r[0] for r in con.execute(f"SELECT id FROM logs WHERE {c}")}
        assert {r["id"] for r in got if r[f"c{i}"]} == want, c


def test_pairs_of_conditions_keep_three_valued_logic(both):
    con, df = both
    compiler = P.Compiler(df.schema)
    some = ["t LIKE '%c%'", "n > 5", "t IS NULL", "t REGEXP '9'", "n = 'abc'"]
    pairs = [f"NOT ({a} {op} {b})" for a, b in itertools.permutations(some, 2) for op in ("AND", "OR")]
    got = df.select("id", *[F.coalesce(compiler.condition(P.parse_condition(c)), F.lit(False)).alias(f"c{i}") for i, c in enumerate(pairs)]).collect()
    for i, c in enumerate(pairs):
        assert {r["id"] for r in got if r[f"c{i}"]} == {r[0] for r in con.execute(f"SELECT id FROM logs WHERE {c}")}, c


def test_missing_column_and_regexp_of_integer_give_no_rows(both):
    _, df = both
    assert P.never(df.schema, P.parse_condition("t = 'x' OR nowhere = 1"))
    assert P.never(df.schema, P.parse_condition("n REGEXP '1'"))
    assert P.run_select(df, "SELECT * FROM logs WHERE nowhere = 1").count() == 0


def test_select_shapes(both):
    _, df = both
    assert P.run_select(df, "SELECT COUNT(*) AS n FROM logs").first()["n"] == len(ROWS)
    assert P.run_select(df, "SELECT DISTINCT t FROM logs WHERE t LIKE 'cmd.exe'").count() == 1
    assert [r["id"] for r in P.run_select(df, "SELECT id FROM logs WHERE n > 0 ORDER BY n DESC LIMIT 2").collect()] == [2, 6]


def test_unsupported_syntax_is_reported():
    for sql in ("SELECT * FROM logs WHERE EXISTS (SELECT 1)", "SELECT * FROM logs WHERE CASE", "SELECT * FROM logs WHERE a = 1 b"):
        with pytest.raises(P.Unsupported):
            P.parse(sql)


def test_names_and_like_tokens():
    assert P.required_columns('SELECT a FROM logs WHERE "b c" = 1 AND `d` LIKE \'x\' AND [e] IS NULL') == ["a", "b c", "d", "e"]
    assert like_tokens("a%b", None) == ["a", "\0%", "b"]
    assert like_tokens("a\\%b", "\\") == ["a%b"]
