"""Rule SQL to Catalyst columns.

A rule holds statements ``SELECT ... FROM logs WHERE ...``. They are parsed into a small tree shared with the Sigma
front end, and the tree becomes one Boolean column with the semantics of the log table: text compares without regard
to ASCII case, integers compare as numbers with integer columns and as text with text columns, REGEXP of NULL is
false, and a statement that names a column which the data does not have yields no rows.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.strings import ascii_lower, fold, like, regexp


class Unsupported(ValueError):
    """Syntax outside the documented subset."""


class NoRows(ValueError):
    """The statement would fail on this data, so that it yields no rows."""


# --- tree --------------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Name:
    name: str
    quoted: bool = False


@dataclass(frozen=True)
class Lit:
    value: object


@dataclass(frozen=True)
class Cast:
    of: object
    to: str


@dataclass(frozen=True)
class Call:
    name: str
    args: tuple


@dataclass(frozen=True)
class Compare:
    op: str
    left: object
    right: object


@dataclass(frozen=True)
class Like:
    left: object
    pattern: str
    escape: str | None = None


@dataclass(frozen=True)
class Regexp:
    left: object
    pattern: str


@dataclass(frozen=True)
class In:
    left: object
    items: tuple


@dataclass(frozen=True)
class IsNull:
    of: object


@dataclass(frozen=True)
class Not:
    of: object


@dataclass(frozen=True)
class And:
    parts: tuple


@dataclass(frozen=True)
class Or:
    parts: tuple


@dataclass
class Select:
    items: list[tuple[object, str]] | None  # None for *
    where: object | None
    distinct: bool = False
    group: list[object] = field(default_factory=list)
    having: object | None = None
    order: list[tuple[object, bool]] = field(default_factory=list)
    limit: int | None = None


# --- parser ------------------------------------------------------------------------------------------------------

_TOKEN = re.compile(
    r"""\s*(?:--[^\n]*\n)?\s*(?:
    (?P<str>'(?:[^']|'')*')|(?P<quoted>"(?:[^"]|"")*"|`[^`]*`|\[[^\]]*\])|
    (?P<num>\d+\.\d*(?:[eE][-+]?\d+)?|\.\d+|\d+)|(?P<word>[A-Za-z_][\w$]*)|(?P<op><>|!=|==|<=|>=|\|\||[-+*/%<>=(),.;]))""",
    re.VERBOSE,
)
_COMPARE = {"=": "=", "==": "=", "!=": "!=", "<>": "!=", "<": "<", "<=": "<=", ">": ">", ">=": ">="}
_STOP = {"FROM", "WHERE", "AND", "OR", "GROUP", "ORDER", "HAVING", "LIMIT", "AS", "UNION", "THEN", "ELSE", "END", "WHEN"}


class Parser:
    def __init__(self, text: str):
        self.tokens: list[tuple[str, str]] = []
        at = 0
        text = text.rstrip()
        while at < len(text):
            m = _TOKEN.match(text, at)
            if not m:
                raise Unsupported(f"cannot read {text[at : at + 20]!r}")
            kind = str(m.lastgroup)
            self.tokens.append((kind, m[kind]))
            at = m.end()
        self.i = 0

    def word(self, *words: str) -> bool:
        """Take the next words if they are these keywords."""
        for k, w in enumerate(words):
            if self.i + k >= len(self.tokens) or self.tokens[self.i + k][0] != "word" or self.tokens[self.i + k][1].upper() != w:
                return False
        self.i += len(words)
        return True

    def op(self, *ops: str) -> str | None:
        if self.i < len(self.tokens) and self.tokens[self.i][0] == "op" and self.tokens[self.i][1] in ops:
            self.i += 1
            return self.tokens[self.i - 1][1]
        return None

    def need(self, what: str) -> None:
        if not (self.word(what) if what.isalpha() else self.op(what)):
            raise Unsupported(f"{what} expected")

    # WHERE grammar, loosest first
    def expr(self) -> object:
        parts = [self.conjunction()]
        while self.word("OR"):
            parts.append(self.conjunction())
        return parts[0] if len(parts) == 1 else Or(tuple(parts))

    def conjunction(self) -> object:
        parts = [self.negation()]
        while self.word("AND"):
            parts.append(self.negation())
        return parts[0] if len(parts) == 1 else And(tuple(parts))

    def negation(self) -> object:
        return Not(self.negation()) if self.word("NOT") else self.predicate()

    def predicate(self) -> object:
        left = self.value()
        while True:
            if op := self.op(*_COMPARE):
                left = Compare(_COMPARE[op], left, self.value())
            elif self.word("IS", "NOT", "NULL") or self.word("NOTNULL"):
                left = Not(IsNull(left))
            elif self.word("IS", "NULL") or self.word("ISNULL"):
                left = IsNull(left)
            else:
                negative = self.word("NOT")
                made = self.tail(left)
                if made is None:
                    if negative:
                        raise Unsupported("NOT expected before LIKE, IN, BETWEEN or REGEXP")
                    return left
                left = Not(made) if negative else made

    def tail(self, left: object) -> object | None:
        if self.word("LIKE"):
            pattern, escape = self.literal_text(), None
            if self.word("ESCAPE"):
                escape = self.literal_text()
            return Like(left, pattern, escape)
        if self.word("REGEXP"):
            return Regexp(left, self.literal_text())
        if self.word("IN"):
            self.need("(")
            items = []
            while not self.op(")"):
                items.append(self.value())
                self.op(",")
            return In(left, tuple(items))
        if self.word("BETWEEN"):
            low = self.value()
            self.need("AND")
            return And((Compare(">=", left, low), Compare("<=", left, self.value())))
        return None

    def literal_text(self) -> str:
        v = self.value()
        if not isinstance(v, Lit) or not isinstance(v.value, str):
            raise Unsupported("a text literal is expected")
        return v.value

    def value(self) -> object:
        left = self.term()
        while op := self.op("+", "-", "||"):
            left = Call(op, (left, self.term()))
        return left

    def term(self) -> object:
        left = self.primary()
        while op := self.op("*", "/", "%"):
            left = Call(op, (left, self.primary()))
        return left

    def primary(self) -> object:
        if self.i >= len(self.tokens):
            raise Unsupported("a value is expected at the end")
        kind, text = self.tokens[self.i]
        if kind == "op":
            if self.op("("):
                inner = self.expr()
                self.need(")")
                return inner
            if self.op("-"):
                v = self.primary()
                return Lit(-v.value) if isinstance(v, Lit) and not isinstance(v.value, str) else Call("-", (Lit(0), v))
            if self.op("*"):
                return Name("*")
            raise Unsupported(f"{text} is not a value")
        self.i += 1
        if kind == "str":
            return Lit(text[1:-1].replace("''", "'"))
        if kind == "num":
            return Lit(int(text) if text.isdigit() else float(text))
        if kind == "quoted":
            name = text[1:-1].replace('""', '"') if text[0] == '"' else text[1:-1]
            return self.qualified(Name(name, text[0] == '"'))
        upper = text.upper()
        if upper == "NULL":
            return Lit(None)
        if upper == "CAST":
            self.need("(")
            of = self.expr()
            self.need("AS")
            to = self.tokens[self.i][1].upper()
            self.i += 1
            self.need(")")
            return Cast(of, to)
        if upper in ("CASE", "EXISTS", "SELECT"):
            raise Unsupported(f"{upper} is not supported in a rule")
        if self.op("("):
            args = []
            self.word("DISTINCT") and args.append(Lit("DISTINCT"))
            while not self.op(")"):
                args.append(self.expr())
                self.op(",")
            return Call(upper, tuple(args))
        return self.qualified(Name(text))

    def qualified(self, name: Name) -> Name:
        if self.op("."):
            kind, text = self.tokens[self.i]
            self.i += 1
            return Name(text[1:-1] if kind == "quoted" else text)
        return name

    def select(self) -> Select:
        self.need("SELECT")
        out = Select(None, None, self.word("DISTINCT"))
        items = []
        while True:
            start = self.i
            e = self.expr()
            label = self.tokens[start][1] if self.i == start + 1 else "".join(t for _, t in self.tokens[start : self.i])
            if self.word("AS"):
                label = self.tokens[self.i][1].strip('"`[]')
                self.i += 1
            elif isinstance(e, Name):
                label = e.name
            items.append((e, label))
            if not self.op(","):
                break
        out.items = None if len(items) == 1 and items[0][0] == Name("*") else items
        self.need("FROM")
        self.i += 1  # the one relation
        if self.word("WHERE"):
            out.where = self.expr()
        if self.word("GROUP", "BY"):
            out.group = [self.value()]
            while self.op(","):
                out.group.append(self.value())
        if self.word("HAVING"):
            out.having = self.expr()
        if self.word("ORDER", "BY"):
            while True:
                v = self.value()
                down = self.word("DESC")
                self.word("ASC")
                out.order.append((v, down))
                if not self.op(","):
                    break
        if self.word("LIMIT"):
            v = self.value()
            if not isinstance(v, Lit) or not isinstance(v.value, int):
                raise Unsupported("LIMIT takes a number")
            out.limit = v.value
        self.op(";")
        if self.i < len(self.tokens):
            raise Unsupported(f"unexpected {self.tokens[self.i][1]}")
        return out


def parse(sql: str) -> Select:
    return Parser(sql).select()


def parse_condition(text: str) -> object:
    p = Parser(text)
    out = p.expr()
    if p.i < len(p.tokens):
        raise Unsupported(f"unexpected {p.tokens[p.i][1]}")
    return out


def names(node: object) -> list[str]:
    """The columns that a tree refers to, in order, each once."""
    out: list[str] = []

    def walk(x: object) -> None:
        if isinstance(x, Name):
            if x.name != "*" and x.name not in out:
                out.append(x.name)
        elif isinstance(x, (tuple, list)):
            for y in x:
                walk(y)
        elif hasattr(x, "__dataclass_fields__"):
            for f in x.__dataclass_fields__:
                walk(getattr(x, f))

    walk(node)
    return out


def required_columns(sql: str) -> list[str]:
    s = parse(sql)
    return names([s.items or [], s.where, s.group, s.having, s.order])


# --- compiler ----------------------------------------------------------------------------------------------------

_NUMERIC = (T.LongType, T.IntegerType, T.ShortType, T.ByteType, T.BooleanType)
_REAL = (T.DoubleType, T.FloatType, T.DecimalType)
_AGGREGATES = {"COUNT": F.count, "SUM": F.sum, "MIN": F.min, "MAX": F.max, "AVG": F.avg, "TOTAL": F.sum}


def _as_number(c: Column, whole: bool) -> Column:
    """The number that a text begins with, 0 without one."""
    pattern = r"^\s*([-+]?\d+)" if whole else r"^\s*([-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?)"
    return F.when(c.isNotNull(), F.coalesce(F.regexp_extract(c, pattern, 1).try_cast("bigint" if whole else "double"), F.lit(0).cast("bigint" if whole else "double")))


class Compiler:
    """Trees to columns over one schema. folded: names of columns that hold the folded text of a column."""

    def __init__(self, schema: T.StructType, folded: dict[str, str] | None = None):
        self.fields = {f.name.lower(): f for f in schema.fields}
        self.folded = folded or {}

    def field(self, name: str) -> T.StructField:
        if name.lower() not in self.fields:
            raise NoRows(f"no such column: {name}")
        return self.fields[name.lower()]

    def kind(self, e: object) -> str:
        """'int', 'real' or 'text' for columns and casts, 'lit' otherwise."""
        if isinstance(e, Name):
            if e.quoted and e.name.lower() not in self.fields:
                return "lit"
            t = self.field(e.name).dataType
            return "int" if isinstance(t, _NUMERIC) else "real" if isinstance(t, _REAL) else "text"
        if isinstance(e, Cast):
            return "real" if e.to in ("REAL", "DOUBLE", "FLOAT", "NUMERIC") else "int" if e.to.startswith("INT") else "text"
        if isinstance(e, Call):
            return {"LENGTH": "int", "COUNT": "int", "LOWER": "text", "UPPER": "text", "||": "text", "SUBSTR": "text", "TRIM": "text"}.get(e.name, "real")
        return "lit"

    def raw(self, e: object) -> Column:
        if isinstance(e, Lit):
            return F.lit(e.value)
        if isinstance(e, Name):
            if e.quoted and e.name.lower() not in self.fields:
                return F.lit(e.name)  # an unknown double-quoted name is a text
            return F.col(f"`{self.field(e.name).name}`")
        if isinstance(e, Cast):
            c, kind = self.raw(e.of), self.kind(e.of)
            to = self.kind(e)
            if to == "text":
                return c.cast("string")
            if kind in ("int", "real") or isinstance(e.of, Lit) and not isinstance(e.of.value, str):
                return c.cast("bigint" if to == "int" else "double")
            return _as_number(c, to == "int")
        if isinstance(e, Call):
            args = [self.raw(a) for a in e.args if a != Lit("DISTINCT") and a != Name("*")]
            simple = {"LENGTH": F.length, "LOWER": ascii_lower, "UPPER": F.upper, "TRIM": F.trim, "ABS": F.abs, "COALESCE": F.coalesce, "IFNULL": F.coalesce, "SUBSTR": F.substr}
            if e.name in simple:
                return simple[e.name](*args)
            if e.name in ("+", "-", "*", "/", "%"):
                num = [a if self.kind(x) in ("int", "real") or not isinstance(getattr(x, "value", ""), str) else _as_number(a, False) for a, x in zip(args, e.args)]
                return {"+": num[0] + num[1], "-": num[0] - num[1], "*": num[0] * num[1]}.get(e.name) if e.name in "+-*" else F.try_divide(*num) if e.name == "/" else F.try_mod(*num)
            if e.name == "||":
                return F.concat(*[a.cast("string") for a in args])
            if e.name in _AGGREGATES:
                if Lit("DISTINCT") in e.args:
                    return F.count_distinct(self.text(e.args[-1])) if e.name == "COUNT" else _AGGREGATES[e.name](args[0])
                return F.count(F.lit(1)) if not args else _AGGREGATES[e.name](args[0])
            raise Unsupported(f"function {e.name}")
        raise Unsupported(f"{type(e).__name__} is not a value")

    def text(self, e: object) -> Column:
        """The folded text of a value."""
        if isinstance(e, Lit):
            return F.lit(None if e.value is None else fold(str(e.value)))
        if isinstance(e, Name) and e.name.lower() in self.folded:
            return F.col(f"`{self.folded[e.name.lower()]}`")
        if self.kind(e) in ("int", "real"):
            return self.raw(e).cast("string")
        return ascii_lower(self.raw(e))

    def pair(self, a: object, b: object) -> tuple[Column, Column] | None:
        """Both sides as they compare; None where a number meets a text that is none: unequal, and less than it."""
        kinds = {self.kind(a), self.kind(b)} - {"lit"}
        if "int" in kinds or "real" in kinds:
            out = []
            for x in (a, b):
                if isinstance(x, Lit) and isinstance(x.value, str):
                    try:
                        out.append(F.lit(int(x.value) if re.fullmatch(r"\s*[-+]?\d+\s*", x.value) else float(x.value)))
                    except ValueError:
                        return None
                elif self.kind(x) == "text":
                    c = self.raw(x)
                    out.append(F.coalesce(c.try_cast("double"), F.when(c.isNotNull(), F.lit(float("inf")))))
                else:
                    out.append(self.raw(x))
            return out[0], out[1]
        if not kinds and all(isinstance(x, Lit) and not isinstance(x.value, str) for x in (a, b)):
            return self.raw(a), self.raw(b)
        return self.text(a), self.text(b)

    def compare(self, op: str, a: object, b: object) -> Column:
        sides = self.pair(a, b)
        if sides is None:  # any number sorts before any text
            number, flip = (a, False) if self.kind(a) != "lit" else (b, True)
            known = self.raw(number).isNotNull()
            truth = {"=": False, "!=": True, "<": not flip, "<=": not flip, ">": flip, ">=": flip}[op]
            return F.when(known, F.lit(truth))
        x, y = sides
        return {"=": x == y, "!=": x != y, "<": x < y, "<=": x <= y, ">": x > y, ">=": x >= y}[op]

    def condition(self, e: object) -> Column:
        if isinstance(e, (And, Or)):
            out = self.condition(e.parts[0])
            for p in e.parts[1:]:
                out = out & self.condition(p) if isinstance(e, And) else out | self.condition(p)
            return out
        if isinstance(e, Not):
            return ~self.condition(e.of)
        if isinstance(e, Compare):
            return self.compare(e.op, e.left, e.right)
        if isinstance(e, Like):
            return like(self.text(e.left), e.pattern, e.escape)
        if isinstance(e, Regexp):
            if self.kind(e.left) == "int":
                raise NoRows("REGEXP of an integer")
            return regexp(self.raw(e.left), e.pattern)
        if isinstance(e, In):
            if not e.items:
                return F.lit(False)
            kind = self.kind(e.left)
            if kind == "text" and all(isinstance(x, Lit) and x.value is not None for x in e.items):
                return self.text(e.left).isin([fold(str(x.value)) for x in e.items])
            out = self.compare("=", e.left, e.items[0])
            for x in e.items[1:]:
                out = out | self.compare("=", e.left, x)
            return out
        if isinstance(e, IsNull):
            return self.raw(e.of).isNull()
        if isinstance(e, Lit):
            return F.lit(None if e.value is None else bool(e.value) if not isinstance(e.value, str) else False).cast("boolean")
        c = self.raw(e)
        return c != 0 if self.kind(e) in ("int", "real") else _as_number(c, False) != 0


def never(schema: T.StructType, node: object) -> str | None:
    """Why a tree yields no rows over a schema, None if it may yield some."""
    try:
        Compiler(schema).condition(node)
    except NoRows as e:
        return str(e)
    return None


def run_select(df, sql: str):
    """A whole rule statement over a frame: projection, DISTINCT, grouping, ordering and LIMIT included."""
    s = parse(sql)
    c = Compiler(df.schema)
    try:
        out = df if s.where is None else df.where(c.condition(s.where))
        is_agg = lambda e: isinstance(e, Call) and e.name in _AGGREGATES
        if s.group or any(is_agg(e) for e, _ in s.items or []):
            keys = [(c.text(g) if c.kind(g) == "text" else c.raw(g)).alias(f"_g{i}") for i, g in enumerate(s.group)]
            aggs = [c.raw(e).alias(label) if is_agg(e) else F.min(c.raw(e)).alias(label) for e, label in s.items or []]
            if s.having is not None:
                counted: list = []

                def lift(e: object) -> object:
                    if is_agg(e):
                        counted.append(c.raw(e).alias(f"_h{len(counted)}"))
                        return Name(f"_h{len(counted) - 1}")
                    if isinstance(e, tuple):
                        return tuple(map(lift, e))
                    if hasattr(e, "__dataclass_fields__") and not isinstance(e, (Lit, Name)):
                        return type(e)(*[lift(getattr(e, f)) for f in e.__dataclass_fields__])
                    return e

                having = lift(s.having)
                out = out.groupBy(*keys).agg(*aggs, *counted)
                out = out.where(Compiler(out.schema).condition(having))
            else:
                out = out.groupBy(*keys).agg(*aggs)
            out = out.select(*[label for _, label in s.items or []])
        else:
            if s.order:
                out = out.orderBy(*[(c.text(v) if c.kind(v) == "text" else c.raw(v)).desc() if d else (c.text(v) if c.kind(v) == "text" else c.raw(v)).asc() for v, d in s.order])
            if s.items is not None:
                out = out.select(*[c.raw(e).alias(label) for e, label in s.items])
            if s.distinct:
                texts = [f.name for f in out.schema.fields if isinstance(f.dataType, T.StringType)]
                rest = [f.name for f in out.schema.fields if f.name not in texts]
                marks = {f"_d{i}": ascii_lower(F.col(t)) for i, t in enumerate(texts)}
                out = out.withColumns(marks).dropDuplicates([*rest, *marks]).drop(*marks) if marks else out.distinct()
        return out if s.limit is None else out.limit(s.limit)
    except NoRows:
        return df.limit(0)
