"""Packing documents into sequences by first-fit decreasing over a tournament tree.

Texts are encoded with a public tokenizer and closed with an end id. Words repeat, so each distinct word is encoded
once and the ids of a text are gathered from those of its words (white space never joins two words of this tokenizer).
Words are known by a 64-bit hash; a worker knows about a million at a time, so two of them meet with a chance below 1e-7.
A document is cut at every ``length`` ids; the pieces go to random groups of about ``group`` pieces, and each group is
packed by itself: pieces by falling length, each into the first open sequence with room, which a tournament tree of
remaining capacities finds in logarithmic time. Only the piece table is shuffled, never ids or texts.

Defined cases: a null or empty text is the end id alone. Rows that repeat, doc_id included, are each packed. A null
doc_id stays null. An empty table gives no piece. Columns beyond doc_id and text are ignored.
"""

from __future__ import annotations

import os
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, cut, slices, span_hashes

LENGTH, END, GROUP = 4096, 2, 4096
PIECE = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
_SEPARATOR = "<|startoftext|>"


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


class Encoder:
    """Ids of whole texts from the ids of their distinct words. Beyond size, the words seen in one slice only are forgotten."""

    def __init__(self, path: str, size: int = 1_000_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.between = self.tok.token_to_id(_SEPARATOR)
        self.ends = np.zeros(self.tok.get_vocab_size() + 1, bool)
        for token, i in self.tok.get_vocab().items():
            self.ends[i] = token.endswith("</w>")
        self.size = size
        self.keys, self.start, self.n, self.hits = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.pool, self.used = np.zeros(1 << 20, np.uint32), 0

    def forget(self) -> None:
        keep = self.hits > 1
        if keep.mean() > 0.5:
            keep[:] = False
        self.keys, self.start, self.n = self.keys[keep], self.start[keep], self.n[keep]
        self.hits = np.zeros(len(self.keys), np.int64)
        done = np.cumsum(self.n)
        self.used = int(done[-1]) if len(done) else 0
        pool = self.pool[np.repeat(self.start - (done - self.n), self.n) + np.arange(self.used)]
        self.pool = np.zeros(max(1 << 20, 2 * self.used), np.uint32)
        self.pool[: self.used] = pool
        self.start = done - self.n

    def _encode(self, text: str) -> np.ndarray:
        return np.array(self.tok.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)

    def words(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of many words, end to end, and how many each has."""
        # Letters, or letters and one mark, are one or two runs, and every run ends in a token that says so: such words
        # are encoded joined by spaces. Others are joined by a special token, but those that may hold one stand alone.
        # What counts is the word as the tokenizer sees it: NFC takes some letters apart into a letter and a mark.
        seen = (unicodedata.normalize("NFC", w).lower() for w in texts)
        kinds = np.fromiter((1 if x.isalpha() else 2 if x[-1] in ".,:;!?" and x[:-1].isalpha() else 0 for x in seen), np.int64, len(texts))
        n, parts, order = np.zeros(len(texts), np.int64), [], []
        plain, other = np.flatnonzero(kinds > 0), np.flatnonzero(kinds == 0)
        for i in range(0, len(plain), 4096):
            at = plain[i : i + 4096]
            own = [texts[k] for k in at.tolist()]
            ids = self._encode(" ".join(own))
            runs = np.flatnonzero(self.ends[ids])
            if len(runs) == kinds[at].sum():
                n[at] = np.diff(runs[np.cumsum(kinds[at]) - 1] + 1, prepend=0)
            else:
                each = [self._encode(w) for w in own]
                n[at] = [len(x) for x in each]
                ids = np.concatenate(each)
            parts.append(ids)
            order.append(at)
        for i in range(0, len(other), 1024):
            at = other[i : i + 1024]
            own = [texts[k] for k in at.tolist()]
            if any("<|" in w for w in own):
                each = [self._encode(w) for w in own]
                n[at] = [len(x) for x in each]
                parts.append(np.concatenate(each))
            else:
                ids = self._encode(_SEPARATOR.join(own))
                cuts = np.flatnonzero(ids == self.between)
                n[at] = np.diff(np.concatenate([[-1], cuts, [len(ids)]])) - 1
                parts.append(np.delete(ids, cuts))
            order.append(at)
        if not parts:
            return np.zeros(0, np.uint32), n
        flat, at = np.concatenate(parts), np.concatenate(order)
        start = np.empty(len(texts), np.int64)
        start[at] = np.cumsum(n[at]) - n[at]
        done = np.cumsum(n)
        return flat[np.repeat(start - (done - n), n) + np.arange(len(flat))], n

    def slice_ids(self, s) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a slice without end ids, and the number of them before each text."""
        starts, ends, before = s.words()
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(s.n + 1, np.int64)
        u, first, back = np.unique(span_hashes(s.flat, starts, ends), return_index=True, return_inverse=True)
        if len(self.keys) > self.size:
            self.forget()
        i = np.searchsorted(self.keys, u)
        hit = np.zeros(len(u), bool)
        inside = i < len(self.keys)
        hit[inside] = self.keys[i[inside]] == u[inside]
        new = np.flatnonzero(~hit)
        if len(new):
            data = s.flat.tobytes()
            flat, n = self.words([data[a:b].decode("utf-8", "replace") for a, b in zip(starts[first[new]].tolist(), ends[first[new]].tolist())])
            while self.used + len(flat) > len(self.pool):
                self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
            self.pool[self.used : self.used + len(flat)] = flat
            self.keys = np.insert(self.keys, i[new], u[new])
            self.start = np.insert(self.start, i[new], self.used + np.cumsum(n) - n)
            self.n = np.insert(self.n, i[new], n)
            self.hits = np.insert(self.hits, i[new], 0)
            self.used += len(flat)
            i = np.searchsorted(self.keys, u)
        self.hits[i] += 1
        n, at = self.n[i][back], self.start[i][back]
        done = np.cumsum(n)
        gather = np.repeat(at - (done - n), n) + np.arange(int(done[-1]))
        return self.pool[gather], np.concatenate([[0], done])[before]


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder a Python worker: the words it knows serve the worker's next tasks too."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def pieces(docs: DataFrame, path: str, length: int = LENGTH, end: int = END) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens: every document cut at each length ids; row_no counts them in a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        done = 0
        for b in batches:
            ids = column(b, "doc_id").to_pylist()
            out: list[tuple] = []
            for s in slices(column(b, "text")):
                flat, before = enc.slice_ids(s)
                flat = flat.astype("<u4", copy=False)
                for d in range(s.n):
                    own = np.append(flat[before[d] : before[d + 1]], np.array([end], "<u4"))
                    for at in range(0, len(own), length):
                        part = own[at : at + length]
                        out.append((ids[s.first + d], at, len(part), zlib.crc32(part.tobytes()), len(own)))
            cols = [*(list(zip(*out)) or [[]] * 5), range(done, done + len(out))]
            done += len(out)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], [*PIECE, "row_no"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, ", ".join(f"{c} long" for c in [*PIECE, "row_no"]))


def first_fit_decreasing(lengths: list[int], capacity: int) -> list[tuple[int, int]]:
    """Bin and offset of every item; items by falling length, ties in the order given."""
    leaves = 1
    while leaves < max(1, len(lengths)):
        leaves *= 2
    tree = [capacity] * (2 * leaves)  # the winner of a node is the largest room below it
    out = [(0, 0)] * len(lengths)
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        need, node = lengths[i], 1
        while node < leaves:
            node *= 2
            if tree[node] < need:
                node += 1
        out[i] = (node - leaves, capacity - tree[node])
        tree[node] -= need
        while node > 1:
            node //= 2
            best = max(tree[2 * node], tree[2 * node + 1])
            if tree[node] == best:
                break
            tree[node] = best
    return out


def pack(docs: DataFrame, path: str | None = None, length: int = LENGTH, end: int = END, group: int = GROUP, seed: int = 5) -> DataFrame:
    """Every piece of docs (doc_id, text) with its sequence_id and offset."""
    # Pieces are written once, so that row_no, which spreads rows that repeat over the groups, stays as it is.
    parts = cut(pieces(docs, path or tokenizer_path(), length, end), "pieces")
    n_groups = max(1, -(-parts.count() // group))
    grouped = parts.withColumn("_g", F.pmod(F.xxhash64(F.lit(seed), "doc_id", "start", "ids_crc32", "row_no"), F.lit(n_groups)))

    def run(rows: pa.Table) -> pa.Table:
        own = {c: rows.column(c).fill_null(-1).to_numpy() for c in ("length", "doc_id", "start", "ids_crc32", "_g")}
        order = np.lexsort((own["ids_crc32"], own["start"], own["doc_id"], -own["length"]))
        placed = np.array(first_fit_decreasing(own["length"][order].tolist(), length), np.int64).reshape(-1, 2)
        out = rows.select(PIECE).take(pa.array(order))
        return out.append_column("sequence_id", pa.array(own["_g"] * 2**32 + placed[:, 0])).append_column("offset", pa.array(placed[:, 1]))

    return grouped.groupBy("_g").applyInArrow(run, ", ".join(f"{c} long" for c in [*PIECE, "sequence_id", "offset"]))
