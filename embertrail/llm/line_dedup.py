"""Line deduplication by winnowing over line hashes.

A gram is the shortest run of lines from a line on that holds ``gram_words`` words; a window is the shortest run that
holds ``window_words``. Every window selects the least hash of the grams inside it, so any repeated run of lines of
``window_words`` words or more shares a fingerprint wherever it stands, and a long line is a gram by itself. By default
a window is one gram: every repeated run of ``gram_words`` words or more goes, a single line of as many among them.

Positions are joined by content: a fingerprint stands for its gram, and for the gram extended line by line to the left
and to the right as far as two windows; each of these has a hash of its own. Where such a hash occurs earlier in the
corpus (by doc_id, hash of the text, then line), the match reaches that far, and the lines of the later run are deleted. The fingerprints
along a run lie closer than two windows, so their extensions cover the whole run, even if different earlier documents
hold different parts of it. A hash meets its first occurrence only, not every other, so rows stay proportional to the
input however often a passage repeats; first occurrences come from a pre-aggregated minimum.

Defined cases: lines are split at line feeds; runs are compared by two independent 64-bit hashes of their bytes (128
bits, so that different runs do not meet at any corpus size); lines without a word count for nothing and
stay. A null text stays null, an empty one empty; a document whose lines all repeat gets an empty text. Rows of a null
doc_id are returned unchanged. Rows that share a doc_id and a text are one document and keep the same lines;
different texts of one doc_id are documents of their own, in the order of their hashes.
All columns of the input are returned, n_lines and n_removed (lines with a word) besides.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Slice, column, cut, mix, slices, span_hashes, unused

GRAM, WINDOW = 6, 6
_K = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63)]


def _lines(s: Slice) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lines with a word: start, end, number of words; and how many stand before each text."""
    ls, le, before = s.lines()
    starts, _, _ = s.words()
    n = np.searchsorted(starts, le) - np.searchsorted(starts, ls)
    full = n > 0
    return ls[full], le[full], n[full], np.concatenate([[0], np.cumsum(full)])[before]


def _selected(cum: np.ndarray, before: np.ndarray, skip: np.ndarray, keys: np.ndarray, ends: np.ndarray, window_words: int, gram_words: int) -> np.ndarray:
    """The grams (by first line) that are the least of a window: windows of window_words, or the whole text if shorter."""
    n = len(ends)
    doc = np.repeat(np.arange(len(before) - 1), np.diff(before))
    stop = np.searchsorted(cum, cum[:-1] + window_words)
    full = (stop <= before[doc + 1]) & ~skip[doc]
    size = cum[before[1:]] - cum[before[:-1]]
    short = np.flatnonzero((size >= gram_words) & (size < window_words) & ~skip)
    first = np.concatenate([np.flatnonzero(full), before[short]])
    last = np.searchsorted(ends, np.concatenate([stop[full], before[short + 1]]), "right")
    if not len(first):
        return first
    order = np.argsort(keys, kind="stable")
    rank = np.empty(n + 1, np.int64)
    rank[order], rank[n] = np.arange(n), n
    least = np.minimum.reduceat(rank, np.column_stack([first, last]).ravel())[::2]
    return np.unique(order[least])


def _grams(lines: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of the run of lines that begins at each line and stops before ends."""
    h = mix((ends - np.arange(len(ends))).astype(np.uint64))
    todo = np.flatnonzero(ends <= len(lines))
    at = 0
    while len(todo := todo[ends[todo] - todo > at]):
        h[todo] = mix(h[todo] + lines[todo + at] * _K[0])
        at += 1
    return h


def _extended(lines: np.ndarray, gram: np.ndarray, lo: np.ndarray, hi: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """key, gram number, begin, end: the grams, and each grown line by line down to left and up to right."""
    i = np.arange(len(lo))
    out = [(gram, i, lo, hi)]
    h, todo, at = gram.copy(), i, 0
    while len(todo := todo[lo[todo] - at > left[todo]]):
        at += 1
        h[todo] = mix((h[todo] + lines[lo[todo] - at] * _K[1]) ^ _K[3])
        out.append((h[todo], todo, lo[todo] - at, hi[todo]))
    h, todo, at = gram.copy(), i, 0
    while len(todo := todo[hi[todo] + at < right[todo]]):
        h[todo] = mix((h[todo] + lines[hi[todo] + at] * _K[2]) ^ _K[4])
        at += 1
        out.append((h[todo], todo, lo[todo], hi[todo] + at))
    return tuple(np.concatenate(x) for x in zip(*out))


def fingerprints(docs: DataFrame, gram_words: int, window_words: int) -> DataFrame:
    """key, check, doc_id, text_hash, lo, hi: every selected gram and its extensions, lines lo to hi (exclusive) among those with a word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = column(b, "doc_id")
            no_id = ids.is_null().to_numpy(zero_copy_only=False)
            text_hash = column(b, "text_hash").to_numpy()
            for s in slices(column(b, "text")):
                ls, le, words, before = _lines(s)
                if not len(ls):
                    continue
                cum = np.concatenate([[0], np.cumsum(words)])
                ends = np.searchsorted(cum, cum[:-1] + gram_words)
                both = [span_hashes(s.flat, ls, le, seed=seed) for seed in (0, 1)]
                grams = [_grams(h, ends) for h in both]
                lo = _selected(cum, before, no_id[s.first : s.first + s.n], grams[0], ends, window_words, gram_words)
                if not len(lo):
                    continue
                hi, doc = ends[lo], np.searchsorted(before, lo, "right") - 1
                left = np.maximum(before[doc], np.searchsorted(cum, cum[lo] - 2 * window_words, "right") - 1)
                right = np.minimum(before[doc + 1], np.searchsorted(cum, cum[hi] + 2 * window_words))
                key, gram, begin, end = _extended(both[0], grams[0][lo], lo, hi, left, right)
                check = _extended(both[1], grams[1][lo], lo, hi, left, right)[0]
                at = doc[gram]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(key.view(np.int64)), pa.array(check.view(np.int64)), ids.take(pa.array(s.first + at)), pa.array(text_hash[s.first + at]),
                        pa.array((begin - before[at]).astype(np.int32)), pa.array((end - before[at]).astype(np.int32)),
                    ],
                    ["key", "check", "doc_id", "text_hash", "lo", "hi"],
                )

    return docs.withColumn("text_hash", F.xxhash64("text")).mapInArrow(run, "key long, check long, doc_id long, text_hash long, lo int, hi int")


def repeated_runs(docs: DataFrame, gram_words: int = GRAM, window_words: int = WINDOW) -> DataFrame:
    """doc_id, text_hash, lo, hi (lines with a word, hi exclusive), first_doc: the later copies of repeated runs."""
    prints = cut(fingerprints(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), gram_words, window_words), "fingerprints")
    first = prints.groupBy("key", "check").agg(F.count("*").alias("_c"), F.min(F.struct("doc_id", "text_hash", "lo")).alias("_f")).where("_c > 1")
    first = cut(first.select("key", "check", F.col("_f.doc_id").alias("first_doc"), F.col("_f.text_hash").alias("_hash"), F.col("_f.lo").alias("_lo")), "first")
    later = prints.join(first.hint("merge"), ["key", "check"]).where("doc_id <> first_doc or text_hash <> _hash or lo <> _lo")
    return later.select("doc_id", "text_hash", "lo", "hi", "first_doc")


def remove_repeats(docs: DataFrame, gram_words: int = GRAM, window_words: int = WINDOW) -> DataFrame:
    """docs with the later runs deleted from text, and n_lines, n_removed."""
    runs = repeated_runs(docs, gram_words, window_words).groupBy("doc_id", "text_hash").agg(F.collect_set(F.struct("lo", "hi")).alias("_runs"))
    own_id, own_hash, own_lo, own_hi = (unused(f"_{x}", docs.columns) for x in ("id", "hash", "lo", "hi"))
    runs = cut(runs.select(F.col("doc_id").alias(own_id), F.col("text_hash").alias(own_hash), F.col("_runs.lo").alias(own_lo), F.col("_runs.hi").alias(own_hi)), "runs")
    names = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    # Texts are dealt by doc_id at every size: a broadcast of the runs would be bounded by nothing.
    same = (docs["doc_id"].cast("long") == runs[own_id]) & (F.xxhash64(docs["text"]) == runs[own_hash])
    joined = docs.select(*names).join(runs.hint("merge"), same, "left").drop(own_id, own_hash)
    schema = T.StructType([*docs.select(*names).schema.fields, T.StructField("n_lines", T.LongType()), T.StructField("n_removed", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = column(b, "text")
            lo, hi = column(b, own_lo).to_pylist(), column(b, own_hi).to_pylist()
            changed: dict[int, str] = {}
            total, gone = np.zeros(b.num_rows, np.int64), np.zeros(b.num_rows, np.int64)
            for s in slices(texts):
                ls, le, _, before = _lines(s)
                total[s.first : s.first + s.n] = np.diff(before)
                for d in range(s.n):
                    row = s.first + d
                    if lo[row]:
                        cut_lines = np.zeros(total[row] + 1, np.int64)
                        np.add.at(cut_lines, lo[row], 1)
                        np.add.at(cut_lines, hi[row], -1)
                        bad = np.flatnonzero(np.cumsum(cut_lines)[:-1] > 0)
                        gone[row] = len(bad)
                        keep, at = [], int(s.off[d])
                        for i in bad + before[d]:
                            keep.append(s.flat[at : ls[i]].tobytes())
                            at = min(int(le[i]) + 1, int(s.off[d + 1]))
                        changed[row] = (b"".join(keep) + s.flat[at : s.off[d + 1]].tobytes()).decode("utf-8", "replace")
            arrays = []
            for name in names:
                arr = column(b, name)
                if name == "text" and changed:
                    values = arr.to_pylist()
                    for row, text in changed.items():
                        values[row] = text
                    arr = pa.array(values, arr.type)
                arrays.append(arr)
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(total), pa.array(gone)], [*names, "n_lines", "n_removed"])

    return joined.mapInArrow(run, schema)
