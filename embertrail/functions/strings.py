"""Text functions with the comparison semantics of rules: ASCII-only case folding, LIKE with any escape, REGEXP."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_FOLD = str.maketrans(UPPER, LOWER)


def ascii_lower(c: Column) -> Column:
    """Fold A to Z only; other letters keep their case, as the NOCASE collation has it."""
    return F.translate(c, UPPER, LOWER)


def fold(s: str) -> str:
    return s.translate(_FOLD)


def like_tokens(pattern: str, escape: str | None) -> list[str]:
    """A LIKE pattern as literals, '%' and '_' marks; a mark is a tuple-free token of its own, prefixed by NUL."""
    out: list[str] = []
    i = 0
    while i < len(pattern):
        c = pattern[i]
        if escape and c == escape:
            if i + 1 >= len(pattern):
                return ["\0never"]  # an escape at the end matches nothing
            c, i = pattern[i + 1], i + 1
            mark = c
        else:
            mark = "\0" + c if c in "%_" else c
        if out and not mark.startswith("\0") and not out[-1].startswith("\0"):
            out[-1] += mark
        else:
            out.append(mark)
        i += 1
    return out


def like(c: Column, pattern: str, escape: str | None = None) -> Column:
    """c LIKE pattern on text that is folded already: contains, startswith, endswith or equality where they suffice."""
    tokens = like_tokens(fold(pattern), escape)
    if tokens == ["\0never"]:
        return F.when(c.isNotNull(), F.lit(False))
    marks = [t for t in tokens if t.startswith("\0")]
    if "\0_" not in marks:
        lits = [t for t in tokens if not t.startswith("\0")]
        if not marks:
            return c == F.lit("".join(lits))
        if not lits:
            return F.when(c.isNotNull(), F.lit(True))
        if len(lits) == 1:
            first, last = tokens[0].startswith("\0"), tokens[-1].startswith("\0")
            return c.contains(lits[0]) if first and last else c.endswith(lits[0]) if first else c.startswith(lits[0])
    body = "".join(".*" if t == "\0%" else "." if t == "\0_" else re.sub(r"([^A-Za-z0-9_\s])", r"\\\1", t) for t in tokens)
    return c.rlike(f"(?s)^{body}\\z")


def java_regex(pattern: str) -> str | None:
    """A Python pattern as a Java one, None if it does not compile."""
    try:
        re.compile(pattern)
    except re.error:
        return None
    out = re.sub(r"\(\?P<(\w+)>", lambda m: "(?<" + m[1].replace("_", "") + ">", pattern)
    out = re.sub(r"\(\?P=(\w+)\)", lambda m: r"\\k<" + m[1].replace("_", "") + ">", out)
    out = out.replace(r"\Z", r"\z")
    return "(?d)" + out if not pattern.isascii() or not re.search(r"\\[dswb]", pattern) else "(?dU)" + out


def regexp(c: Column, pattern: str) -> Column:
    """c REGEXP pattern: case-sensitive, unanchored; false for NULL and for a pattern that does not compile."""
    java = java_regex(pattern)
    return F.lit(False) if java is None else F.coalesce(c.rlike(java), F.lit(False))


def python_repr(values: list) -> str:
    """How a list is stored: as Python prints it."""
    return str(values)
