"""Quality classifier by co-training of two views.

The content view reads the text: hashed words, hashed word shapes (runs of character classes), shares of character
classes and the share of distinct words. The metadata view reads the page's record and nothing of the text: source,
language and the recorded length. Both are logistic regressions in numpy. In each round both views label every document;
of the documents a view is sure about, a bounded number of either label, balanced as the labelled part is, joins the
training rows of the other view. After the rounds each view is calibrated (Platt) on labelled rows kept out of training,
and a last logistic regression on the same rows weighs the two calibrated views. A document is kept from a threshold on
that spares ``spare`` of the good held-out rows (0.5 at most).

What is fitted on is bounded: ``max_labelled`` labelled documents, and ``max_pseudo`` pseudo-labelled ones a view and
round, those of lowest hash. Every document stands as a candidate for a pseudo-label in every round, and every whole text
is scored. Only the features of the rows that are fitted on reach the driver, at most some 33000 numbers a row.

Defined cases: a null text counts as empty; null source, lang and n_chars (or no such column) are values of their own;
several labels of one doc_id count as the lowest, and of several texts under a labelled doc_id the one of lowest hash is
fitted on; a null label or doc_id teaches nothing. Without labels of both kinds everything is kept with score 1. Repeated
rows are each scored. All columns of the input are returned, with p_content, p_meta, score and kept (replaced, should the
input have such columns).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Slice, column, cut, drop, slices, span_hashes
from .quality_rules import CLASSES, N_CLASSES, class_counts, plain_words

BUCKETS, META = 1 << 15, 256


@dataclass
class Rows:
    """Sparse features of a view: row, feature and value of every entry."""

    n: int
    row: np.ndarray
    col: np.ndarray
    val: np.ndarray

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, w[self.col] * self.val, minlength=self.n)

    def take(self, keep: np.ndarray) -> Rows:
        place = np.full(self.n, -1)
        place[keep] = np.arange(len(keep))
        ok = place[self.row] >= 0
        return Rows(len(keep), place[self.row[ok]], self.col[ok], self.val[ok])

    @staticmethod
    def join(parts: list[Rows]) -> Rows:
        at = np.cumsum([0] + [p.n for p in parts])
        return Rows(int(at[-1]), np.concatenate([p.row + a for p, a in zip(parts, at)]), np.concatenate([p.col for p in parts]), np.concatenate([p.val for p in parts]))


def _shapes(s: Slice, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of each word's character classes, runs of one class taken once."""
    cls = np.where(CLASSES[s.flat] == 9, 8, CLASSES[s.flat]).astype(np.uint8)
    first = np.zeros(len(cls) + 1, bool)
    first[starts] = True
    change = np.ones(len(cls), bool)
    change[1:] = cls[1:] != cls[:-1]
    keep = change | first[:-1]
    at = np.concatenate([[0], np.cumsum(keep)])
    return span_hashes(cls[keep], at[starts], at[ends])


def content(s: Slice) -> Rows:
    h, starts, ends, before = plain_words(s)
    raw_starts, raw_ends, _ = s.words()
    doc = np.repeat(np.arange(s.n), np.diff(before))
    word = (h % np.uint64(BUCKETS // 2)).astype(np.int64)
    shape = (_shapes(s, raw_starts, raw_ends) % np.uint64(BUCKETS // 2)).astype(np.int64) + BUCKETS // 2
    n = np.maximum(np.diff(before), 1)
    key, count = np.unique(np.concatenate([doc * BUCKETS + word, doc * BUCKETS + shape]), return_counts=True)
    row, col = key // BUCKETS, key % BUCKETS
    val = np.where(col < BUCKETS // 2, np.sqrt(count / n[row]), 2.0 * count / n[row])
    cc = class_counts(s)
    share = 4.0 * cc / np.maximum(cc.sum(axis=1, keepdims=True), 1)
    distinct = np.bincount(row[col < BUCKETS // 2], minlength=s.n) / n
    dense = np.concatenate([share, 2.0 * distinct[:, None], np.ones((s.n, 1))], axis=1)
    r, c = np.nonzero(dense)
    return Rows(s.n, np.concatenate([row, r]), np.concatenate([col, BUCKETS + c]), np.concatenate([val, dense[r, c]]))


def metadata(source: list, lang: list, n_chars: list) -> Rows:
    """Features of the page's record: one of its source, one of its language, and its recorded length."""
    n = len(source)
    hot = lambda kind, x: crc32(f"{kind}={x}".encode()) % (META - 8)
    known = np.array([x is not None for x in n_chars], float).reshape(n)
    chars = np.log1p(np.array([max(0, x or 0) for x in n_chars], float)).reshape(n) / 4
    cols = [np.array([hot("source", x) for x in source], np.int64), np.array([hot("lang", x) for x in lang], np.int64)]
    dense = [chars, chars**2, 1 - known, np.ones(n)]
    return Rows(n, np.tile(np.arange(n), 6), np.concatenate([*cols, *[np.full(n, META - 8 + k) for k in range(4)]]), np.concatenate([np.ones(2 * n), *dense]))


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def fit(x: Rows, y: np.ndarray, dim: int, steps: int = 120, l2: float = 1e-4, rate: float = 0.15) -> np.ndarray:
    w, m, v = np.zeros(dim), np.zeros(dim), np.zeros(dim)
    for t in range(1, steps + 1):
        g = (_sigmoid(x.dot(w)) - y) / len(y)
        grad = np.bincount(x.col, g[x.row] * x.val, minlength=dim) + l2 * w
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-6)
    return w


def _logistic(z: np.ndarray, y: np.ndarray) -> np.ndarray:
    """A small dense logistic regression with an intercept, by Newton steps with a little shrinkage."""
    x = np.column_stack([z, np.ones(len(z))])
    w = np.zeros(x.shape[1])
    for _ in range(25):
        p = _sigmoid(x @ w)
        h = (x * (p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(x.shape[1])
        w -= np.linalg.solve(h, x.T @ (p - y) + 1e-2 * w)
    return w


@dataclass
class Model:
    views: list[np.ndarray]
    platt: list[np.ndarray]
    mix: np.ndarray
    threshold: float

    def score(self, xs: list[Rows]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        z = [np.column_stack([x.dot(w), np.ones(x.n)]) @ p for x, w, p in zip(xs, self.views, self.platt)]
        return _sigmoid(z[0]), _sigmoid(z[1]), _sigmoid(np.column_stack([*z, np.ones(len(z[0]))]) @ self.mix)


#: Both views of some rows, and their labels.
Marked = tuple[list[Rows], np.ndarray]


def co_train(xs: list[Rows], y: np.ndarray, exchange: Callable[[list[np.ndarray], float], list[Marked]], rounds: int, spare: float) -> Model | None:
    """xs: both views of the labelled rows; every fourth of them only calibrates.

    exchange gives, for both views' weights and the share of good rows, what each of them pseudo-labels.
    """
    held = np.arange(len(y)) % 4 == 3
    if len(set(y[~held])) < 2 or len(set(y[held])) < 2:
        return None
    dims = [BUCKETS + N_CLASSES + 2, META]
    fit_rows = [x.take(np.flatnonzero(~held)) for x in xs]
    train = [(x, y[~held]) for x in fit_rows]
    good = float(y[~held].mean())
    views = [fit(x, t, d) for (x, t), d in zip(train, dims)]
    for _ in range(rounds):
        for i, (rows, marks) in enumerate(exchange(views, good)):
            other = 1 - i
            if len(marks):
                train[other] = (Rows.join([fit_rows[other], rows[other]]), np.concatenate([y[~held], marks]))
        views = [fit(x, t, d) for (x, t), d in zip(train, dims)]
    kept_out = [x.take(np.flatnonzero(held)) for x in xs]
    raw = [x.dot(w) for x, w in zip(kept_out, views)]
    platt = [_logistic(z[:, None], y[held]) for z in raw]
    z = np.column_stack([np.column_stack([r, np.ones(len(r))]) @ p for r, p in zip(raw, platt)])
    model = Model(views, platt, _logistic(z, y[held]), 0.5)
    model.threshold = min(0.5, float(np.quantile(model.score(kept_out)[2][y[held] == 1], 1 - spare)))
    return model


def _views(b: pa.RecordBatch) -> Iterator[tuple[Slice, list[Rows]]]:
    """The slices of a batch with both views of their rows."""
    record = [column(b, c).to_pylist() for c in ("source", "lang", "n_chars")]
    for s in slices(column(b, "text")):
        yield s, [content(s), metadata(*[x[s.first : s.first + s.n] for x in record])]


def _record(docs: DataFrame) -> DataFrame:
    """doc_id, text, source, lang, n_chars and the hash that rows are drawn by."""
    chars = F.col("n_chars").cast("double") if "n_chars" in docs.columns else F.lit(None).cast("double")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"), chars.alias("n_chars"), F.xxhash64("doc_id", "text").alias("_h"))


def _features(rows: DataFrame) -> dict[tuple[int, int], list[tuple[np.ndarray, np.ndarray]]]:
    """Per (doc_id, _h): features and values of both views. rows are few; one of equal ones is taken."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s, views in _views(b):
                cols = [column(b, "doc_id").slice(s.first, s.n), column(b, "_h").slice(s.first, s.n)]
                for x in views:
                    order = np.argsort(x.row, kind="stable")
                    at = np.searchsorted(x.row[order], np.arange(s.n + 1))
                    cols += [pa.array([v[order[i:j]].tobytes() for i, j in zip(at[:-1], at[1:])], pa.binary()) for v in (x.col.astype("<i4"), x.val.astype("<f8"))]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "_h", "c0", "v0", "c1", "v1"])

    one = rows.groupBy("doc_id", "_h").agg(F.first("text").alias("text"), F.first("source").alias("source"), F.first("lang").alias("lang"), F.first("n_chars").alias("n_chars"))
    got = one.mapInArrow(run, "doc_id long, _h long, c0 binary, v0 binary, c1 binary, v1 binary").collect()
    return {(r["doc_id"], r["_h"]): [(np.frombuffer(r[c], "<i4").astype(np.int64), np.frombuffer(r[v], "<f8")) for c, v in (("c0", "v0"), ("c1", "v1"))] for r in got}


def _stack(items: list[list[tuple[np.ndarray, np.ndarray]]]) -> list[Rows]:
    out = []
    for i in (0, 1):
        row = np.repeat(np.arange(len(items)), [len(x[i][0]) for x in items])
        flat = lambda k: np.concatenate([x[i][k] for x in items]) if items else np.zeros(0)  # noqa: B023, E731
        out.append(Rows(len(items), row, flat(0).astype(np.int64), flat(1)))
    return out


def _bounded(ids: DataFrame, most: int) -> DataFrame:
    """About most rows of lowest hash, never more: safe to broadcast."""
    n = ids.count()
    cut_at = -(2**63) + int(min(1.0, 1.2 * most / max(1, n)) * (2**64 - 1))
    return ids.withColumn("_h", F.xxhash64("doc_id")).where(F.col("_h") <= F.lit(min(cut_at, 2**63 - 1))).orderBy("_h", "doc_id").limit(most).drop("_h")


def confident(record: DataFrame, views: list[np.ndarray], known: np.ndarray, sure: float, most: int) -> list[tuple[int, float, int, int]]:
    """view, label, doc_id and hash of the documents a view is sure about: the most of lowest hash, per view and label.

    Every document is scored. A task hands on the rows of lowest hash that it has, as many as are wanted in all, and the
    number of all that it has; so what is left is the lowest of the whole table, and few rows travel.
    """
    shared = record.sparkSession.sparkContext.broadcast((views, np.sort(known)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, skip = shared.value
        best = {(i, y): (np.zeros((0, 2), np.int64), 0) for i in (0, 1) for y in (0, 1)}
        for b in batches:
            ids, h = column(b, "doc_id").fill_null(0).to_numpy(), column(b, "_h").to_numpy()
            free = ~np.isin(ids, skip) & ~column(b, "doc_id").is_null().to_numpy(zero_copy_only=False)
            for s, xs in _views(b):
                at = slice(s.first, s.first + s.n)
                for i in (0, 1):
                    p = _sigmoid(xs[i].dot(weights[i]))
                    for y, ok in ((0, p <= 1 - sure), (1, p >= sure)):
                        ok &= free[at]
                        rows, n = best[i, y]
                        rows = np.unique(np.concatenate([rows, np.column_stack([h[at][ok], ids[at][ok]])]), axis=0)[:most]
                        best[i, y] = (rows, n + int(ok.sum()))
        for (i, y), (rows, n) in best.items():
            k = len(rows)
            yield pa.RecordBatch.from_arrays([pa.array([i] * (k + 1), pa.int32()), pa.array([y] * (k + 1), pa.int32()), pa.array([*rows[:, 1].tolist(), None], pa.int64()), pa.array([*rows[:, 0].tolist(), n], pa.int64())], ["view", "label", "doc_id", "h"])

    table = cut(record.mapInArrow(run, "view int, label int, doc_id long, h long"), "confident")
    totals = {(r["view"], r["label"]): r["n"] for r in table.where("doc_id is null").groupBy("view", "label").agg(F.sum("h").alias("n")).collect()}
    out = []
    for (i, y), n in sorted(totals.items()):
        own = table.where((F.col("view") == i) & (F.col("label") == y) & F.col("doc_id").isNotNull()).select("h", "doc_id").distinct()
        # Hashes are even: this share holds as many as are wanted, unless rows repeat much; then all are looked at.
        limit = -(2**63) + int(min(1.0, (2.0 * most + 64) / max(1, n)) * (2**64 - 1))
        rows = own.where(F.col("h") <= F.lit(min(limit, 2**63 - 1))).orderBy("h", "doc_id").limit(most).collect()
        if len(rows) < min(most, n):
            rows = own.orderBy("h", "doc_id").limit(most).collect()
        out += [(i, float(y), r["doc_id"], r["h"]) for r in rows]
    drop(table)
    return out


def learn(docs: DataFrame, labels: DataFrame, label: str, max_labelled: int, max_pseudo: int, rounds: int, spare: float, sure: float) -> Model | None:
    spark = docs.sparkSession
    record = _record(docs)
    marks = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min(label).cast("double").alias("_y"))
    marks = F.broadcast(_bounded(marks, max_labelled))
    least = record.select("doc_id", "_h").join(marks, "doc_id").groupBy("doc_id").agg(F.min("_h").alias("_h"), F.min("_y").alias("_y")).collect()
    if not least:
        return None
    wanted = lambda rows: F.broadcast(spark.createDataFrame(rows, "doc_id long, _h long"))
    got = _features(record.join(wanted([(r["doc_id"], r["_h"]) for r in least]), ["doc_id", "_h"]))
    order = sorted(least, key=lambda r: (crc32(str(r["doc_id"]).encode()), r["doc_id"]))
    known = np.array([r["doc_id"] for r in order], np.int64)

    def exchange(views: list[np.ndarray], good: float) -> list[Marked]:
        sure_rows = confident(record, views, known, sure, max_pseudo)
        most = {1.0: max(1, int(good * max_pseudo)), 0.0: max(1, int((1 - good) * max_pseudo))}
        taken = [[r for y in (0.0, 1.0) for r in [x for x in sure_rows if x[0] == i and x[1] == y][: int(most[y])]] for i in (0, 1)]
        keys = {(r[2], r[3]) for rows in taken for r in rows}
        if not keys:
            return [([], np.zeros(0))] * 2
        have = _features(record.join(wanted(sorted(keys)), ["doc_id", "_h"]))
        return [(_stack([have[r[2], r[3]] for r in rows]), np.array([r[1] for r in rows])) for rows in taken]

    return co_train(_stack([got[r["doc_id"], r["_h"]] for r in order]), np.array([r["_y"] for r in order]), exchange, rounds, spare)


def classify(
    docs: DataFrame,
    labels: DataFrame,
    label: str = "quality",
    max_labelled: int = 3000,
    max_pseudo: int = 1200,
    rounds: int = 2,
    spare: float = 0.995,
    sure: float = 0.95,
) -> DataFrame:
    """docs (doc_id, text, source, lang, n_chars and more) with p_content, p_meta, score and kept; labels: doc_id and label."""
    shared = docs.sparkSession.sparkContext.broadcast(learn(docs, labels, label, max_labelled, max_pseudo, rounds, spare, sure))
    new = ["p_content", "p_meta", "score", "kept"]
    names = [c for c in docs.columns if c not in new]
    fields = [*docs.select(*names).schema.fields, *[T.StructField(c, T.DoubleType()) for c in new[:3]], T.StructField("kept", T.BooleanType())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for b in batches:
            parts = [np.ones(b.num_rows) for _ in range(3)]
            if model is not None:
                own = pa.RecordBatch.from_arrays([column(b, "text"), *[column(b, c) if c in names else pa.nulls(b.num_rows) for c in ("source", "lang", "n_chars")]], ["text", "source", "lang", "n_chars"])
                for s, xs in _views(own):
                    for p, g in zip(parts, model.score(xs)):
                        p[s.first : s.first + s.n] = g
            kept = parts[2] >= (model.threshold if model is not None else 0.0)
            yield pa.RecordBatch.from_arrays([*[column(b, c) for c in names], *[pa.array(p) for p in parts], pa.array(kept)], [*names, *new])

    return docs.select(*names).mapInArrow(run, T.StructType(fields))
