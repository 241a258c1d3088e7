"""Language identification by interpolated Kneser-Ney character models.

One model per language, of order 5, over the characters of space-padded words. The n-grams of all languages stand in
one sorted array of 64-bit hashes per order, each with the languages that have it and their discounted probabilities; a
second sorted array holds the back-off weights of the contexts. A text goes to the language of lowest cross-entropy per character.

Calibration: a quarter of the training sample is kept out of the counts. It fits the temperature that turns
cross-entropies into a probability, and the highest cross-entropy that still counts as the language (rejection).

Defined cases: a null text, or one without a letter, gives ``und`` and score 0. A null doc_id is never learned from.
Repeated rows are each predicted. Without any training row every text gets ``und``. Other columns, whatever their
names, are ignored. Ties go to the language that sorts first.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import column, mix, slices, span_hashes

ORDER = 5
_K = [np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9), np.uint64(0x27D4EB2F165667C5), np.uint64(0x85EBCA77C2B2AE63)]
_EDGE = np.uint64(0x5851F42D4C957F2D)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def _sequences(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbol hashes of all words, each between two edge symbols; word number and place within the word."""
    text = "".join(words)
    cps = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64)
    lens = np.fromiter(map(len, words), np.int64, len(words)) + 2
    ends = np.cumsum(lens)
    starts = ends - lens
    sym = np.empty(int(ends[-1]) if len(words) else 0, np.uint64)
    inner = np.ones(len(sym), bool)
    inner[starts] = inner[ends - 1] = False
    sym[inner] = mix(cps + _K[0])
    sym[~inner] = _EDGE
    word = np.repeat(np.arange(len(words)), lens)
    return sym, word, np.arange(len(sym)) - np.repeat(starts, lens)


def _grams(sym: np.ndarray, place: np.ndarray, order: int) -> list[np.ndarray]:
    """Hashes of the n-grams that end at each place, n = 1 to order; valid where place >= n - 1."""
    out = [mix(sym + _K[1])]
    for n in range(2, order + 1):
        prev = np.zeros_like(sym)
        prev[n - 1 :] = sym[: max(0, len(sym) - n + 1)]
        out.append(mix(out[-1] + prev * _K[n - 1]))
    return out


@dataclass
class Table:
    """Sorted hashes, and for each the languages that have it with a value each; any other language has ``other``."""

    keys: np.ndarray
    first: np.ndarray  # where a hash's entries begin, and the end of the last
    lang: np.ndarray
    value: np.ndarray
    other: float

    @staticmethod
    def of(parts: list[tuple[np.ndarray, np.ndarray]], other: float) -> Table:
        """parts: hashes and values, one pair a language."""
        keys = np.concatenate([k for k, _ in parts])
        lang = np.repeat(np.arange(len(parts), dtype=np.int32), [len(k) for k, _ in parts])
        order = np.argsort(keys, kind="stable")
        u, first = np.unique(keys[order], return_index=True)
        return Table(u, np.append(first, len(keys)), lang[order], np.concatenate([v for _, v in parts])[order], other)

    def get(self, asked: np.ndarray, n_langs: int) -> np.ndarray:
        """A row of values, one a language, for each hash."""
        u, back = np.unique(asked, return_inverse=True)
        out = np.full((len(u), n_langs), self.other)
        if len(self.keys):
            i = np.minimum(np.searchsorted(self.keys, u), len(self.keys) - 1)
            hit = np.flatnonzero(self.keys[i] == u)
            n = self.first[i[hit] + 1] - self.first[i[hit]]
            at = np.repeat(self.first[i[hit]] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            out[np.repeat(hit, n), self.lang[at]] = self.value[at]
        return out[back]


@dataclass
class Model:
    langs: list[str]
    base: np.ndarray  # log space is entered only at the end: uniform share per language
    probs: list[Table] = field(default_factory=list)  # per order: discounted probabilities
    lams: list[Table] = field(default_factory=list)  # per order: back-off weight of a context, 1 where unseen
    temperature: float = 1.0
    limits: np.ndarray | None = None

    def word_scores(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Per word: minus log probability in each language, and the number of symbols predicted."""
        sym, word, place = _sequences(words)
        g = _grams(sym, place, ORDER)
        at = np.flatnonzero(place >= 1)
        p = np.repeat(self.base[None, :], len(at), axis=0)
        for n in range(1, ORDER + 1):
            ok = place[at] >= n - 1
            pos = at[ok]
            context = g[n - 2][pos - 1] if n > 1 else np.zeros(len(pos), np.uint64)
            p[ok] = p[ok] * self.lams[n - 1].get(context, len(self.langs)) + self.probs[n - 1].get(g[n - 1][pos], len(self.langs))
        out = np.zeros((len(words), len(self.langs)))
        cost = -np.log(np.maximum(p, 1e-12))
        first = np.flatnonzero(np.r_[True, np.diff(word[at]) > 0]) if len(at) else np.zeros(0, np.int64)
        if len(first):
            out[word[at][first]] = np.add.reduceat(cost, first, axis=0)
        return out, np.bincount(word[at], minlength=len(words)).astype(float)


def _one_language(words: Counter) -> list[tuple[np.ndarray, ...]]:
    """Per order: n-grams and discounted probabilities, contexts and back-off weights."""
    sym, word, place = _sequences(list(words))
    weight = np.fromiter(words.values(), float, len(words))[word]
    g = _grams(sym, place, ORDER)
    out: list[tuple[np.ndarray, ...]] = []
    for n in range(1, ORDER + 1):
        at = np.flatnonzero((place >= n - 1) & (place >= 1))
        full = np.unique(g[n - 1][at])
        count = np.zeros(len(full))
        raw = at if n == ORDER else at[place[at] == n - 1]  # nothing stands to the left of these
        np.add.at(count, np.searchsorted(full, g[n - 1][raw]), weight[raw])
        if n < ORDER:  # continuation counts: how many different symbols stand before
            left = np.flatnonzero(place >= max(n, 1))
            _, i = np.unique(g[n][left], return_index=True)
            np.add.at(count, np.searchsorted(full, g[n - 1][left[i]]), 1.0)
        ones, twos = (count == 1).sum(), (count == 2).sum()
        d = ones / (ones + 2 * twos) if ones and twos else 0.5
        i = at[np.unique(g[n - 1][at], return_index=True)[1]]
        ctx = g[n - 2][i - 1] if n > 1 else np.zeros(len(full), np.uint64)
        keys, back = np.unique(ctx, return_inverse=True)
        total = np.bincount(back, count)
        kinds = np.bincount(back, count > 0)
        out.append((full, np.maximum(count - d, 0) / total[back], keys, np.minimum(np.minimum(d, 1) * kinds / total, 1.0)))
    return out


def build(texts: list[tuple[str, str]]) -> Model:
    """texts: pairs of language and text. Every fourth text of a language calibrates."""
    by: dict[str, list[str]] = {}
    for lang, text in texts:
        by.setdefault(lang, []).append(text)
    langs = sorted(by)
    model = Model(langs, np.zeros(len(langs)))
    tables, kept = [], []
    for lang in langs:
        some = by[lang]
        fit = [t for i, t in enumerate(some) if i % 4 != 3 or len(some) < 4]
        kept += [(lang, t) for i, t in enumerate(some) if i % 4 == 3] or [(lang, t) for t in some]
        words: Counter = Counter(w for t in fit for w in t.lower().split() if not w.isascii() or any(map(str.isalpha, w)))
        tables.append(_one_language(words or Counter({"a": 1})))
    alphabet = 1 + len({c for t in texts for c in t[1].lower() if not c.isspace()})
    model.base = np.full(len(langs), 1.0 / alphabet)
    for n in range(ORDER):
        model.probs.append(Table.of([t[n][0:2] for t in tables], 0.0))
        model.lams.append(Table.of([t[n][2:4] for t in tables], 1.0))
    ce, _ = entropies(model, pa.array([t for _, t in kept], pa.string()))
    truth = np.array([langs.index(x) for x, _ in kept])
    ok = np.isfinite(ce[:, 0])
    if ok.any():
        gap, rows = ce[ok] - ce[ok].min(axis=1, keepdims=True), np.arange(int(ok.sum()))
        loss = [(np.mean(np.log(np.exp(-gap * t).sum(axis=1)) + gap[rows, truth[ok]] * t), t) for t in np.geomspace(1, 64, 25)]
        model.temperature = float(min(loss)[1])
    model.limits = np.full(len(langs), np.inf)
    for j in range(len(langs)):
        own = ce[ok & (truth == j), j] if len(truth) else np.zeros(0)
        if len(own):
            model.limits[j] = np.quantile(own, 0.99) + 0.25
    return model


class Cache:
    """Scores of the words seen last, by hash; emptied beyond its size in bytes."""

    def __init__(self, model: Model, size: int = 64 << 20):
        self.model, self.size = model, size // (12 + 4 * len(model.langs))
        self.clear()

    def clear(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.cost = np.zeros((0, len(self.model.langs)), np.float32)
        self.n = np.zeros(0, np.float32)

    def get(self, hashes: np.ndarray, flat: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        u, first, back = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self.keys) > self.size:
            self.clear()
        i = np.searchsorted(self.keys, u)
        hit = np.zeros(len(u), bool)
        inside = i < len(self.keys)
        hit[inside] = self.keys[i[inside]] == u[inside]
        new = np.flatnonzero(~hit)
        if len(new):
            data = flat.tobytes()
            texts = [data[s:e].decode("utf-8", "replace").lower() for s, e in zip(starts[first[new]].tolist(), ends[first[new]].tolist())]
            cost, n = self.model.word_scores(texts)
            plain = np.fromiter((w.isascii() and not any(map(str.isalpha, w)) for w in texts), bool, len(texts))
            cost[plain], n[plain] = 0, 0
            self.keys = np.insert(self.keys, i[new], u[new])
            self.cost = np.insert(self.cost, i[new], cost.astype(np.float32), axis=0)
            self.n = np.insert(self.n, i[new], n.astype(np.float32))
            i = np.searchsorted(self.keys, u)
        return self.cost[i][back], self.n[i][back]


def entropies(model: Model, texts: pa.Array, cache: Cache | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Per text: cross-entropy per symbol in each language (inf without a letter); whether it has a letter."""
    cache = cache or Cache(model)
    out = np.full((len(texts), len(model.langs)), np.inf)
    letters = np.zeros(len(texts), bool)
    for s in slices(texts, 4 << 20):
        starts, ends, before = s.words()
        low = (s.flat | 32) - 97 < 26
        cum = np.zeros(len(s.flat) + 1, np.int64)
        np.cumsum(low, out=cum[1:])
        has = cum[s.off[1:]] > cum[s.off[:-1]]
        for d in np.flatnonzero(~has & (s.off[1:] > s.off[:-1])):
            has[d] = any(map(str.isalpha, s.flat[s.off[d] : s.off[d + 1]].tobytes().decode("utf-8", "replace")))
        letters[s.first : s.first + s.n] = has
        if not len(starts):
            continue
        cost, n = cache.get(span_hashes(s.flat, starts, ends), s.flat, starts, ends)
        full = np.flatnonzero(before[1:] > before[:-1])
        total = np.add.reduceat(n.astype(float), before[full])
        sums = np.add.reduceat(cost.astype(float), before[full], axis=0)
        with np.errstate(divide="ignore", invalid="ignore"):
            ce = np.where(total[:, None] > 0, sums / total[:, None], np.inf)
        out[s.first + full] = ce
    out[~letters] = np.inf
    return out, letters


def training_sample(docs: DataFrame, max_docs: int, max_chars: int) -> list[tuple[str, str]]:
    """Of every language up to max_docs texts of lowest hash, of max_chars characters together for all languages.

    A language's share of max_chars is equal to every other's. If even its first text is longer than that, the language
    is learned from its shortest text alone.
    """
    own = docs.select("doc_id", "text", "lang").where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id")))
    sizes = own.groupBy("lang").agg(F.count("*").alias("count")).collect()
    if not sizes:
        return []
    room = max_chars // len(sizes)
    top = 2.0**63
    share = {r["lang"]: min(2.0, 2.0 * max_docs / r["count"] + 16.0 / r["count"]) for r in sizes}
    spark = docs.sparkSession
    wanted = spark.createDataFrame([(k, v, room) for k, v in share.items()], "_lang string, _share double, _room long")
    picked = own.withColumn("_h", F.xxhash64("doc_id")).join(F.broadcast(wanted), F.col("lang") == F.col("_lang"))
    picked = picked.where("(double(_h) / %r + 1.0) < _share and length(text) <= _room" % top)
    # Hashes first, so that only the texts that are taken reach the driver.
    keys = sorted(picked.select("lang", "_h", "doc_id", F.xxhash64("text").alias("_t"), F.length("text").alias("_n")).collect(), key=lambda r: (r["lang"], r["_h"], r["doc_id"], r["_t"]))
    got, used = Counter(), Counter()
    taken = []
    for r in keys:
        if got[r["lang"]] < max_docs and used[r["lang"]] + r["_n"] <= room:
            got[r["lang"]] += 1
            used[r["lang"]] += r["_n"]
            taken.append((r["lang"], r["doc_id"], r["_t"], got[r["lang"]]))
    out = []
    if taken:
        mine = spark.createDataFrame(taken, "_lang string, _id long, _t long, _at int")
        rows = own.join(F.broadcast(mine), (F.col("lang") == F.col("_lang")) & (F.col("doc_id") == F.col("_id")) & (F.xxhash64("text") == F.col("_t"))).select("lang", "_at", "text").dropDuplicates(["lang", "_at"])
        out = [(r["lang"], r["text"]) for r in sorted(rows.collect(), key=lambda r: (r["lang"], r["_at"]))]
    missing = [r["lang"] for r in sizes if not got[r["lang"]]]
    if missing:
        few = spark.createDataFrame([(x,) for x in missing], "_lang string")
        least = own.join(F.broadcast(few), F.col("lang") == F.col("_lang")).groupBy("lang").agg(F.min(F.struct(F.length("text").alias("n"), "text")).alias("_m"))
        out += [(r["lang"], r["text"]) for r in least.select("lang", "_m.text").collect()]
    return out


def identify(docs: DataFrame, max_docs: int = 400, max_chars: int = 64_000_000) -> DataFrame:
    """doc_id, held_out, lang_pred, score, cross_entropy, rejected for every row of docs (doc_id, text, lang).

    The models learn from a bounded sample: max_docs texts of every language, of max_chars characters in all, none of
    them held out. Every language of the table is learned, and every whole text is predicted.
    """
    spark = docs.sparkSession
    sample = training_sample(docs, max_docs, max_chars)
    shared = spark.sparkContext.broadcast(build(sample) if sample else None)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        cache = Cache(model) if model else None
        for b in batches:
            n = b.num_rows
            pred, score, entropy, rejected = ["und"] * n, np.zeros(n), np.full(n, np.nan), np.ones(n, bool)
            if model:
                ce, letters = entropies(model, column(b, "text"), cache)
                ok = letters & np.isfinite(ce[:, 0])
                best = np.argmin(ce, axis=1)
                for i in np.flatnonzero(letters):
                    pred[i] = model.langs[best[i]]
                gap = ce[ok] - ce[ok].min(axis=1, keepdims=True)
                score[ok] = 1.0 / np.exp(-gap * model.temperature).sum(axis=1)
                entropy[ok] = ce[ok].min(axis=1)
                rejected[ok] = entropy[ok] > model.limits[best[ok]]
            yield pa.RecordBatch.from_arrays(
                [column(b, "doc_id"), column(b, "held_out"), pa.array(pred, pa.string()), pa.array(score), pa.array(entropy, from_pandas=True), pa.array(rejected)],
                ["doc_id", "held_out", "lang_pred", "score", "cross_entropy", "rejected"],
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), F.col("text"))
    return rows.mapInArrow(predict, "doc_id long, held_out boolean, lang_pred string, score double, cross_entropy double, rejected boolean")
