"""Near-duplicate detection by SuperMinHash, banding, verification on full sets, and union-find grouping.

A document's set holds the hashes of its distinct word shingles. SuperMinHash gives every element a random permutation
of the registers and takes ranks from it one after another; an element stops as soon as no register of its document
can still fall, so long documents cost about one rank an element. Signatures are cut into bands; the rows of a band
are as many as keep the chance to miss a pair at the threshold below ``MISS``.

Documents with equal sets form one class first, so copies cost nothing further. Classes that share a band meet in a
bucket; a bucket of k classes gives k - 1 pairs with its leader, not all pairs. Verified pairs are grouped by
alternating large and small stars. The classes of buckets that still hold several groups go through an exact prefix
filter: their elements are ordered by rarity among them, and two sets can only reach the threshold if they share one of
their first elements, as many as the threshold leaves over for their sizes; only pairs of different groups that do are
verified. So near copies that all differ from each other by edits of their own are never paired.
Every pair is confirmed on full sets, as 100 * intersection >= percent * union.

Leader pairs are first held against their signatures; a pair is discarded if its estimate lies below the threshold by
more than six standard deviations of a MinHash estimate. Like the banding this can lose a link with a chance below one
in a million.

Elements are 64-bit hashes of words mixed into shingles; classes are told apart by 128 bits from two independent hashes.

Defined cases: a text without words, or null, has an empty set, links with nothing and is kept. Rows that share a
doc_id are one document: what one of their texts links with, all are linked with. A row of null doc_id takes no part: component_id is null and kept is true. Other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Slice, column, cut, drop, mix, slices, span_hashes

REGISTERS, MISS = 130, 1e-6
_G = np.uint64(0x9E3779B97F4A7C15)
_K = [np.uint64(x) for x in (0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63, 0xD6E8FEB86659FD93)]


def bands_for(percent: int, registers: int = REGISTERS) -> tuple[int, int]:
    """Bands and rows: the most rows a band with a chance under MISS to lose a pair at the threshold."""
    rows = max((r for r in range(1, 13) if (1 - (percent / 100) ** r) ** (registers // r) <= MISS), default=1)
    return registers // rows, rows


def _shingle_hashes(s: Slice, k: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes, hashes of the shingles that begin at each word, and the words before each text."""
    starts, ends, before = s.words()
    h = span_hashes(s.flat, starts, ends, lower=True, seed=seed)
    g = np.zeros(0, np.uint64)
    if len(h) >= k:
        m = len(h) - k + 1
        g = h[:m] * _K[0]
        for i in range(1, k):
            g = mix(g + h[i : i + m] * _K[i % 5] + np.uint64(i))
    return h, g, before


def _short(h: np.ndarray) -> np.ndarray:
    """Fewer words than a shingle has: the whole sequence is the one shingle."""
    x = np.array([len(h)], np.uint64)
    for w in h:
        x = mix(x * _K[4] + w)
    return x


def shingle_sets(s: Slice, k: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of the k-word shingles of every text of a slice."""
    h, g, before = _shingle_hashes(s, k, 0)
    return [np.unique(g[a : b - k + 1]) if b - a >= k else _short(h[a:b]) if b > a else np.zeros(0, np.uint64) for a, b in zip(before[:-1].tolist(), before[1:].tolist())]


def digested_sets(s: Slice, k: int) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """shingle_sets, and per text two digests of its set: from those hashes, and from hashes independent of them."""
    h, g, before = _shingle_hashes(s, k, 0)
    h2, g2, _ = _shingle_hashes(s, k, 1)
    sets, d1, d2 = [], np.zeros(s.n, np.uint64), np.zeros(s.n, np.uint64)
    for d, (a, b) in enumerate(zip(before[:-1].tolist(), before[1:].tolist())):
        if b - a >= k:
            x, first = np.unique(g[a : b - k + 1], return_index=True)
            y = g2[a + first]
        elif b > a:
            x, y = _short(h[a:b]), _short(h2[a:b])
        else:
            x = y = np.zeros(0, np.uint64)
        sets.append(x)
        d1[d], d2[d] = x.sum(dtype=np.uint64), y.sum(dtype=np.uint64)
    return sets, d1, d2


def super_min_hash(sets: list[np.ndarray], m: int = REGISTERS) -> np.ndarray:
    """The signatures of many sets at once, one row each; inf for an empty set."""
    sizes = np.array([len(x) for x in sets])
    reg = np.full((len(sets), m), np.inf)
    if not sizes.sum():
        return reg
    elem = np.concatenate(sets)
    doc = np.repeat(np.arange(len(sets)), sizes)
    flat, perm = reg.reshape(-1), None
    for j in range(m):
        x = mix(elem + np.uint64((j + 1) * int(_G) % 2**64))
        r = (x >> np.uint64(11)).astype(float) * 2.0**-53
        k = j + (mix(x) % np.uint64(m - j)).astype(np.int64)
        if perm is None:
            at = k
        else:
            rows = np.arange(len(elem))
            at = perm[rows, k].astype(np.int64)
            perm[rows, k] = perm[:, j]
        np.minimum.at(flat, doc * m + at, r + j)
        open_docs = np.isinf(reg).any(axis=1)
        keep = open_docs[doc]
        if not keep.any():
            break
        if perm is None:
            elem, doc, k = elem[keep], doc[keep], k[keep]
            perm = np.repeat(np.arange(m, dtype=np.uint8 if m <= 256 else np.int32)[None, :], len(elem), axis=0)
            perm[np.arange(len(elem)), k] = 0
        elif keep.mean() < 0.6:
            elem, doc, perm = elem[keep], doc[keep], perm[keep]
    return reg


def _signatures(docs: DataFrame, shingle: int, percent: int) -> DataFrame:
    """doc_id, n, d1, d2 (digest of the set), bands, sig (two bytes a register)."""
    n_bands, n_rows = bands_for(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = column(b, "doc_id")
            for s in slices(column(b, "text")):
                sets, d1, d2 = digested_sets(s, shingle)
                reg = super_min_hash(sets)
                n = np.array([len(x) for x in sets])
                bits = mix(reg.view(np.uint64))
                keys = np.zeros((s.n, n_bands), np.uint64) + np.arange(n_bands, dtype=np.uint64) * _G
                for i in range(n_rows):
                    keys = mix(keys + bits[:, i : i + n_bands * n_rows : n_rows])
                keys = keys.view(np.int64)
                sig = (bits >> np.uint64(48)).astype(np.uint16).view(np.int16)
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.slice(s.first, s.n), pa.array(n, pa.int64()), pa.array(d1.view(np.int64)), pa.array(d2.view(np.int64)),
                        pa.array([k if c else None for k, c in zip(keys, n)], pa.list_(pa.int64())), pa.ListArray.from_arrays(np.arange(s.n + 1, dtype=np.int32) * REGISTERS, sig.reshape(-1)),
                    ],
                    ["doc_id", "n", "d1", "d2", "bands", "sig"],
                )

    return docs.mapInArrow(run, "doc_id long, n long, d1 long, d2 long, bands array<bigint>, sig array<smallint>")


def _sets(docs: DataFrame, shingle: int) -> DataFrame:
    """rep, elements of every text that has words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = column(b, "doc_id")
            for s in slices(column(b, "text")):
                yield pa.RecordBatch.from_arrays([ids.slice(s.first, s.n), pa.array([x.tobytes() for x in shingle_sets(s, shingle)], pa.binary())], ["rep", "elements"])

    return docs.mapInArrow(run, "rep long, elements binary").where("length(elements) > 0")


def _likely(pairs: DataFrame, percent: int) -> DataFrame:
    """a, b: the pairs (a, b, xa, xb) whose signatures come near the threshold. Without Python: the join before it is split into many tasks."""
    p = percent / 100
    least = p - 6 * (p * (1 - p) / REGISTERS) ** 0.5
    return pairs.where(f"aggregate(zip_with(xa, xb, (x, y) -> int(x = y)), 0, (n, x) -> n + x) / {REGISTERS}D >= {least!r}D").select("a", "b")


def _linked(pairs: DataFrame, percent: int) -> DataFrame:
    """a, b: the pairs (a, b, xa, xb) whose full sets reach the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            xa, xb = column(b, "xa"), column(b, "xb")
            ok = np.zeros(b.num_rows, bool)
            for i in range(b.num_rows):
                u, v = np.frombuffer(xa[i].as_buffer(), np.uint64), np.frombuffer(xb[i].as_buffer(), np.uint64)
                both = len(np.intersect1d(u, v, assume_unique=True))
                ok[i] = 100 * both >= percent * (len(u) + len(v) - both)
            yield b.select(["a", "b"]).filter(pa.array(ok))

    return pairs.mapInArrow(run, "a long, b long")


def _with_both(pairs: DataFrame, values: DataFrame, name: str, end: str = "rep") -> DataFrame:
    """a, b, xa, xb: the column end of both ends of the pairs, and their values. a may be hot, so it is joined last, on its own, where a skewed join splits."""
    v = values.select("rep", F.col(name).alias("x"), F.col(end).alias("end"))
    out = pairs.join(v.toDF("b", "xb", "eb"), "b")
    return out.join(v.toDF("a", "xa", "ea"), "a").select(F.col("ea").alias("a"), F.col("eb").alias("b"), "xa", "xb")


def _stars(edges: DataFrame) -> bool:
    """Whether every u of edges (u, v) has one v, which is no u."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("up")).unionByName(edges.select(F.col("v").alias("node"), F.lit(0).alias("up")))
    per = ends.groupBy("node").agg(F.sum("up").alias("ups"), F.min("up").alias("least"))
    return not per.agg(F.coalesce(F.max(F.expr("ups > 1 or (ups = 1 and least = 0)")), F.lit(False))).first()[0]


def components(edges: DataFrame) -> DataFrame:
    """node, root for every node of edges (a, b): root is the smallest node reachable. Alternating large and small stars."""
    now = cut(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    while not _stars(now):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = cut(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v"), "large")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(least.select("u", F.col("m").alias("v")))
        new = cut(small.distinct(), "small")
        drop(now), drop(large)
        now = new
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))


def _empty(df: DataFrame) -> bool:
    return not df.take(1)


def _elements(sets: DataFrame) -> DataFrame:
    """rep, n, root, sid, e: a row for every element of the sets (rep, root, elements); sid tells sets of one rep apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rep, root, sid, held = (column(b, c) for c in ("rep", "root", "sid", "elements"))
            for i in range(0, b.num_rows, 256):
                parts = [np.frombuffer(x.as_buffer(), np.int64) for x in held.slice(i, 256)]
                n = np.array([len(x) for x in parts])
                of = [np.repeat(c.slice(i, 256).to_numpy(), n) for c in (rep, root, sid)]
                yield pa.RecordBatch.from_arrays([pa.array(of[0]), pa.array(np.repeat(n, n), pa.int64()), pa.array(of[1]), pa.array(of[2]), pa.array(np.concatenate(parts))], ["rep", "n", "root", "sid", "e"])

    return sets.select("rep", "root", F.xxhash64("elements").alias("sid"), "elements").mapInArrow(run, "rep long, n long, root long, sid long, e long")


def prefix_pairs(sets: DataFrame, percent: int) -> DataFrame:
    """a, b: every pair of sets (rep, root, elements) of different roots that may reach the threshold. Exact."""
    rows = cut(_elements(sets), "elements")
    often = rows.groupBy("e").agg(F.count("*").alias("f"), F.min("root").alias("_x"), F.max("root").alias("_y")).where("f > 1")
    # Elements of one set only come first in its order; they match nothing, so only their number counts.
    common = rows.join(often, "e")
    own = Window.partitionBy("rep", "sid")
    order = own.orderBy("f", "e")
    placed = common.select("rep", "n", "root", "e", "_x", "_y", (F.col("n") - F.count("*").over(own) + F.row_number().over(order)).alias("rank"))
    first = cut(placed.where(F.expr(f"rank <= n - (n * {percent} + 99) div 100 + 1 and _x <> _y")).select("rep", "n", "root", "e", "rank"), "prefixes")
    drop(rows)
    x, y = first.toDF("a", "na", "ra", "e", "ka"), first.toDF("b", "nb", "rb", "e", "kb")
    need = f"(({percent} * (na + nb) + {99 + percent}) div {100 + percent})"  # least intersection at the threshold
    fit = f"ra <> rb and (na < nb or (na = nb and a < b)) and na * 100 >= nb * {percent} and ka <= na - {need} + 1 and kb <= nb - {need} + 1"
    return x.join(y, "e").where(fit).select("a", "b").distinct()


def _same_id(own: DataFrame, classes: DataFrame) -> DataFrame:
    """a, b: a doc_id that stands over several sets, and the representatives of their classes."""
    key = ["n", "d1", "d2"]
    low, high = (f(F.struct(*key)) for f in (F.min, F.max))
    several = own.groupBy("doc_id").agg(low.alias("_x"), high.alias("_y")).where("_x <> _y").select("doc_id")
    return own.join(several, "doc_id").select("doc_id", *key).distinct().join(classes, key).select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))


def deduplicate(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of docs (doc_id, text)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sig = cut(_signatures(docs, shingle, percent), "signatures")
    own = sig.where("n > 0 and doc_id is not null")
    repeated = not _empty(own.groupBy("doc_id").count().where("count > 1"))
    classes = cut(own.groupBy("n", "d1", "d2").agg(F.min("doc_id").alias("rep"), F.first("bands").alias("bands"), F.first("sig").alias("sig")), "classes")
    rows = classes.select("rep", F.explode("bands").alias("key"))
    lead = cut(rows.groupBy("key").agg(F.count("*").alias("_c"), F.min("rep").alias("lead")).where("_c > 1").select("key", "lead"), "leads")
    buckets = cut(rows.join(lead, "key"), "buckets")
    drop(lead)
    pairs = buckets.where("rep <> lead").groupBy("rep").agg(F.collect_set("lead").alias("leads")).select(F.explode("leads").alias("a"), F.col("rep").alias("b"))
    likely = cut(_likely(_with_both(pairs, classes, "sig"), percent), "likely")

    def sets_of(ids: DataFrame) -> DataFrame:
        """rep, elements of the documents of ids (doc_id), once each."""
        found = _sets(docs.join(ids, "doc_id", "left_semi"), shingle)
        return found.dropDuplicates(["rep", "elements"]) if repeated else found

    ends = likely.select(F.col("a").alias("doc_id")).unionByName(likely.select(F.col("b").alias("doc_id"))).distinct()
    sets = cut(sets_of(ends), "sets")
    links = _linked(_with_both(likely, sets, "elements"), percent)
    roots = components(links.unionByName(_same_id(own, classes)) if repeated else links)
    drop(likely), drop(sets)

    # Buckets that still hold several groups.
    grouped = cut(buckets.join(roots.withColumnRenamed("node", "rep"), "rep", "left").select("key", "rep", F.coalesce("root", "rep").alias("root")), "grouped")
    several = grouped.groupBy("key").agg(F.min("root").alias("_x"), F.max("root").alias("_y")).where("_x <> _y").select("key")
    open_ = cut(grouped.join(several, "key").select("rep", "root").distinct(), "open")
    drop(buckets), drop(grouped)
    member = classes.withColumnRenamed("rep", "node").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    if not _empty(open_):
        sets = cut(sets_of(open_.select(F.col("rep").alias("doc_id"))).join(open_, "rep"), "open-sets")
        # Links between groups, each by its root.
        more = components(_linked(_with_both(prefix_pairs(sets, percent), sets, "elements", "root"), percent))
        drop(sets)
        member = member.join(more.toDF("root", "_top"), "root", "left").withColumn("root", F.coalesce("_top", "root"))

    member = cut(member.select(*[F.col(c).alias(f"_{c}") for c in ("n", "d1", "d2")], "root"), "members")
    out = sig.select("doc_id", "n", "d1", "d2").join(member, (F.col("n") == F.col("_n")) & (F.col("d1") == F.col("_d1")) & (F.col("d2") == F.col("_d2")), "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("root", "doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))
