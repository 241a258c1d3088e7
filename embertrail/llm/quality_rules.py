"""Quality rules: base counts, then the divergence of a text from the texts of its language.

Two histograms of a text, one over character classes and one over the common words of the language (with a last bin
for all other words), are held against the language's own histograms by Jensen-Shannon distance (square root of the
divergence in bits, 0 to 1). A text is kept unless its base counts fail or a distance exceeds its limit; a distance
counts only where the text is long enough for it (min_chars, min_words).

The references cover all documents, and every count in them is exact: a first pass finds the words that may be common
(every word of a share of ``1/heavy`` or more among them, whatever the partitions), a second one counts them. Texts of no
language, or of one without any word, are held against the reference of all texts together.

Defined cases: a null text counts as empty; its counts are 0 and base_failed is true. Repeated rows are each judged,
a null doc_id stays null. Without any word in the corpus no distance is taken. Columns beyond doc_id, text and lang are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Slice, column, cut, drop, mix, slices, span_hashes

#: The symbols that the base counts name.
SYMBOLS = b"#*$%&|<>"
_K = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63)]


def _classes() -> np.ndarray:
    """Byte to class: lower, upper, digit, space, line end, sentence marks, other marks, symbols, beyond ASCII, none."""
    c = np.full(256, 6, np.int64)
    c[97:123], c[65:91], c[48:58] = 0, 1, 2
    c[[32, 9]], c[[10, 11, 12, 13]] = 3, 4
    c[list(b".,;:!?'\"-")] = 5
    c[list(SYMBOLS)] = 7
    c[128:192], c[192:] = 9, 8
    return c


CLASSES, N_CLASSES = _classes(), 9
ALL, NONE = "all", "none"  # all texts together, and those of no language; a language's name follows a mark, so none clashes


def _group(lang: str | None) -> str:
    return NONE if lang is None else "=" + lang


_SYMBOL = np.isin(np.arange(256), list(SYMBOLS))
_MARK = np.isin(np.arange(256), list(b".,;:!?\"'"))


def class_counts(s: Slice) -> np.ndarray:
    doc = np.repeat(np.arange(s.n), np.diff(s.off))
    return np.bincount(doc * 10 + CLASSES[s.flat], minlength=10 * s.n).reshape(s.n, 10)[:, :N_CLASSES]


def plain_words(s: Slice) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words in lower case without a closing mark: hashes, starts, ends, words before each text."""
    starts, ends, before = s.words()
    ends = ends - (_MARK[s.flat[ends - 1]] & (ends - starts > 1)) if len(ends) else ends
    return span_hashes(s.flat, starts, ends, lower=True), starts, ends, before


def base_counts(s: Slice) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of every text of a slice."""
    starts, ends, before = s.words()
    n_words = np.diff(before)
    per = lambda mask, at: np.diff(np.concatenate([[0], np.cumsum(mask)])[at])
    cp = s.code_points()
    chars = per(cp[ends] - cp[starts], before)
    ls, le, lb = s.lines()
    full = np.searchsorted(starts, le) > np.searchsorted(starts, ls)
    line_doc = np.repeat(np.arange(s.n), np.diff(lb))
    lh = mix(span_hashes(s.flat, ls, le) + line_doc.astype(np.uint64) * _K[0])[full]
    _, first = np.unique(lh, return_index=True)
    again = np.ones(len(lh), bool)
    again[first] = False
    dup = np.bincount(line_doc[full][again], minlength=s.n)
    h = span_hashes(s.flat, starts, ends)
    doc = np.repeat(np.arange(s.n), n_words)
    cover = np.zeros(len(h), np.int64)
    if len(h) >= 5:
        m = len(h) - 4
        w = doc[:m].astype(np.uint64) * _K[4]
        for i in range(5):
            w = mix(w + h[i : i + m] * _K[i])
        at = np.flatnonzero(doc[:m] == doc[4:])
        _, back, count = np.unique(w[at], return_inverse=True, return_counts=True)
        at = at[count[back] > 1]
        edge = np.zeros(len(h) + 6, np.int64)
        np.add.at(edge, at, 1)
        np.add.at(edge, at + 5, -1)
        cover = (np.cumsum(edge)[: len(h)] > 0).astype(np.int64)
    return {"n_words": n_words, "word_chars": chars, "n_symbols": per(_SYMBOL[s.flat], s.off), "n_dup_lines": dup, "n_repeat_words": per(cover, before)}


@dataclass
class Reference:
    classes: np.ndarray
    keys: np.ndarray  # sorted hashes of the common words
    words: np.ndarray  # their shares, in that order, then the share of all others


def js_distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance, in bits, of each row of p (counts) from q (shares)."""
    p = p / np.maximum(p.sum(axis=1, keepdims=True), 1)
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        a = np.where(p > 0, p * np.log2(p / m), 0).sum(axis=1)
        b = np.where(q > 0, q * np.log2(q / m), 0).sum(axis=1)
    return np.sqrt(np.clip((a + b) / 2, 0, 1))


def _counted(s: Slice, of: np.ndarray) -> Iterator[tuple[str, np.ndarray, np.ndarray]]:
    """Per group of texts: its words' distinct hashes and their numbers."""
    h, _, _, before = plain_words(s)
    word_of = np.repeat(of, np.diff(before))
    for g in set(of.tolist()):
        yield g, *np.unique(h[word_of == g], return_counts=True)


_ROWS = "lang string, kind string, key long, n long"


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows)) or [[]] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.string(), pa.int64(), pa.int64()))], ["lang", "kind", "key", "n"])


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, back = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
    return keys, np.bincount(back, np.concatenate([c for _, c in parts]), minlength=len(keys)).astype(np.int64)


def _candidates(docs: DataFrame, heavy: int, chunk: int) -> tuple[dict[str, np.ndarray], dict[str, int], dict[str, np.ndarray]]:
    """Per language, and under ALL for all texts: class counts and number of words, both exact, and the words that may be common.

    Each chunk of words reports those above 1 / (4 heavy) of a language's words in it. What goes unreported of a word is
    at most that share, so every word of a share of 1 / heavy is reported for 3/4 of it, and at most 4/3 heavy words are.
    """

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes: dict[str, np.ndarray] = {}
        words: dict[str, list] = {}
        seen = 0

        def flush() -> pa.RecordBatch:
            rows = [(g, "class", i, int(c)) for g, v in classes.items() for i, c in enumerate(v)]
            for g, parts in words.items():
                keys, count = _merged(parts)
                total = int(count.sum())
                often = count * 4 * heavy > total
                rows.append((g, "all", 0, total))
                rows += [(g, "word", k, c) for k, c in zip(keys[often].view(np.int64).tolist(), count[often].tolist())]
            classes.clear(), words.clear()
            return _rows(rows)

        for b in batches:
            langs = column(b, "lang").to_pylist()
            for s in slices(column(b, "text")):
                of = np.array([_group(x) for x in langs[s.first : s.first + s.n]])
                cc = class_counts(s)
                for g, keys, count in _counted(s, of):
                    classes[g] = classes.get(g, 0) + cc[of == g].sum(axis=0)
                    words.setdefault(g, []).append((keys, count))
                    seen += int(count.sum())
                    if len(words[g]) > 16:
                        words[g] = [_merged(words[g])]
                if seen > chunk:
                    seen = 0
                    yield flush()
        yield flush()

    sums = docs.select("text", "lang").mapInArrow(partial, _ROWS)
    per = cut(sums.groupBy("lang", "kind", "key").agg(F.sum("n").alias("n")), "word-sums")
    total = per.where("kind = 'all'").select("lang", F.col("n").alias("size"))
    near = per.where("kind = 'word'").join(F.broadcast(total), "lang").where(F.expr(f"n * 4 * {heavy} >= 3 * size"))
    everything = total.agg(F.sum("size")).first()[0] or 0
    common = per.where("kind = 'word'").groupBy("key").agg(F.sum("n").alias("n")).where(F.expr(f"n * 4 * {heavy} >= 3L * {everything}L"))
    words: dict[str, list] = {ALL: [r["key"] for r in common.collect()]}
    for r in near.collect():
        words.setdefault(r["lang"], []).append(r["key"])
    classes: dict[str, np.ndarray] = {ALL: np.zeros(N_CLASSES)}
    sizes = {ALL: everything}
    for r in per.where("kind <> 'word'").collect():
        if r["kind"] == "all":
            sizes[r["lang"]] = r["n"]
        else:
            classes.setdefault(r["lang"], np.zeros(N_CLASSES))[r["key"]] = r["n"]
            classes[ALL][r["key"]] += r["n"]
    drop(per)
    return classes, sizes, {g: np.sort(np.array(k, np.int64).view(np.uint64)) for g, k in words.items()}


def _exact(docs: DataFrame, known: dict[str, np.ndarray]) -> dict[str, dict[int, int]]:
    """The exact number of each candidate in its language, and of those under ALL in all texts."""
    shared = docs.sparkSession.sparkContext.broadcast(known)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = {g: np.zeros(len(k) + 1, np.int64) for g, k in shared.value.items()}
        for b in batches:
            langs = column(b, "lang").to_pylist()
            for s in slices(column(b, "text")):
                for g, keys, count in _counted(s, np.array([_group(x) for x in langs[s.first : s.first + s.n]])):
                    for name in {g, ALL}:
                        if name in sums:
                            sums[name] += np.bincount(_place(keys, shared.value[name]), count, minlength=len(sums[name])).astype(np.int64)
        rows = []
        for g, v in sums.items():
            at = np.flatnonzero(v[:-1])
            rows += [(g, "word", k, n) for k, n in zip(shared.value[g][at].view(np.int64).tolist(), v[at].tolist())]
        yield _rows(rows)

    out: dict[str, dict[int, int]] = {}
    for r in docs.select("text", "lang").mapInArrow(partial, _ROWS).groupBy("lang", "key").agg(F.sum("n").alias("n")).collect():
        out.setdefault(r["lang"], {})[int(np.int64(r["key"]).astype(np.uint64))] = r["n"]
    return out


def references(docs: DataFrame, top: int, heavy: int, chunk: int) -> dict[str, Reference]:
    """The histograms of each language, and under ALL those of all texts, from all documents.

    Common words are the ``top`` most frequent of those with a share of 1 / heavy or more, by exact counts, so the
    references do not depend on how the documents are partitioned.
    """
    classes, sizes, known = _candidates(docs, heavy, chunk)
    counts = _exact(docs, known)
    out = {}
    for g, size in sizes.items():
        if size:
            common = sorted(((n, k) for k, n in counts.get(g, {}).items() if n * heavy >= size), key=lambda x: (-x[0], x[1]))[:top]
            keys = np.array(sorted(k for _, k in common), np.uint64)
            shares = np.array([counts[g][int(k)] for k in keys] + [0.0])
            shares[-1] = size - shares.sum()
            out[g] = Reference(classes[g] / max(1, classes[g].sum()), keys, shares / size)
    return out


def _place(h: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Where each hash stands among the sorted keys; their number for those that do not."""
    if not len(keys):
        return np.zeros(len(h), np.int64)
    j = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
    return np.where(keys[j] == h, j, len(keys))


def word_histograms(h: np.ndarray, doc: np.ndarray, n: int, keys: np.ndarray) -> np.ndarray:
    return np.bincount(doc * (len(keys) + 1) + _place(h, keys), minlength=n * (len(keys) + 1)).reshape(n, len(keys) + 1).astype(float)


def judge(
    docs: DataFrame,
    class_limit: float = 0.22,
    word_limit: float = 0.50,
    min_chars: int = 200,
    min_words: int = 50,
    top: int = 64,
    heavy: int = 2000,
    chunk: int = 1_000_000,
) -> DataFrame:
    """Base counts, distances and verdict for every row of docs (doc_id, text, lang)."""
    shared = docs.sparkSession.sparkContext.broadcast(references(docs, top, heavy, chunk))
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        refs = shared.value
        for b in batches:
            n = b.num_rows
            langs = column(b, "lang").to_pylist()
            out = {k: np.zeros(n, np.int64) for k in names}
            dc, dw = np.full(n, np.nan), np.full(n, np.nan)
            for s in slices(column(b, "text")):
                for k, v in base_counts(s).items():
                    out[k][s.first : s.first + s.n] = v
                cc = class_counts(s).astype(float)
                h, _, _, before = plain_words(s)
                n_words = np.diff(before)
                doc = np.repeat(np.arange(s.n), n_words)
                of = np.array([g if x is not None and (g := _group(x)) in refs else ALL for x in langs[s.first : s.first + s.n]])
                for g in set(of.tolist()) if refs else ():
                    ref, own = refs[g], np.flatnonzero(of == g)
                    place = np.full(s.n, -1)
                    place[own] = np.arange(len(own))
                    mine = place[doc] >= 0
                    hist = word_histograms(h[mine], place[doc[mine]], len(own), ref.keys)
                    size = cc[own].sum(axis=1)
                    dc[s.first + own] = np.where(size >= min_chars, js_distance(cc[own], ref.classes), np.nan)
                    dw[s.first + own] = np.where(n_words[own] >= min_words, js_distance(hist, ref.words), np.nan)
            failed = (out["n_words"] < 10) | (100 * out["n_repeat_words"] > 20 * out["n_words"])
            kept = ~failed & ~(dc > class_limit) & ~(dw > word_limit)
            yield pa.RecordBatch.from_arrays(
                [column(b, "doc_id"), *[pa.array(out[k]) for k in names], pa.array(failed), pa.array(kept), pa.array(dc, from_pandas=True), pa.array(dw, from_pandas=True)],
                ["doc_id", *names, "base_failed", "kept", "class_distance", "word_distance"],
            )

    schema = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, class_distance double, word_distance double"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang").mapInArrow(run, schema)
