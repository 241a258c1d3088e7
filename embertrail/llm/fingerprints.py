"""Order MinHash fingerprints, sensitive to edit distance, with DataFrame functions only.

A text is read as tokens: its words, a word of more than ``PIECE`` characters in pieces of that many. The k-mers of k
tokens are numbered by occurrence, so a k-mer that repeats stands for as many elements. One hash of (k-mer, occurrence)
places every element on a circle that is cut into ``bins`` equal bins. Each bin selects two elements, the first two at or
after its beginning on the circle; they are put back into the order of the text and the ordered pair is hashed. In a long
text those are the two least elements of the bin itself; in a short one, bins without two elements of their own borrow the
next ones, so every bin of every text with two k-mers or more holds an ordered pair. Two texts agree in a bin where the
same two elements stand in the same order: likeness is the share of bins that agree. One hash for all bins keeps the work
at one pass over the tokens and one sort.

Everything is one column expression: k-mers are hashed by position, sorted as (hash, position), their runs give the
occurrence numbers, and a second sort places the elements. Up to ``PACKED`` tokens, hash and position are packed into one
integer (46 and 17 bits); longer texts sort pairs of the same hash and a 32-bit position, so that no order is lost. Inner
values are bound by transform over one-element arrays, so that nothing is evaluated again for every element.

The next document is found by buckets of rising ids: cut points that leave about ``ROWS`` ids a bucket, at most ``CUTS`` of
them, come from a range partition of the ids alone. Texts are dealt once, by bucket; the least id of each bucket is sent
to the bucket before it as well.

Defined cases: a null text counts as empty; the empty text has the empty fingerprint, alike (1.0) to another empty one
only. A text of fewer than k tokens is one k-mer. Every row is returned. Rows that share a doc_id have the same next
document: that of the next greater doc_id, and of several texts under that id the least. After the greatest doc_id comes
the least; a single doc_id is its own next one. Rows of a null doc_id are left out of the succession: they are returned
with their fingerprint and nulls for what needs a next document. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

K, BINS, PIECE = 3, 128, 8
ROWS, CUTS = 1024, 65536
PACKED, PLACE = 1 << 17, 17


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate value once and use it in body."""
    return F.transform(F.array(value), body)[0]


@dataclass(frozen=True)
class _Pairs:
    """How a 46-bit hash and a position are held as one sortable value."""

    make: Callable[[Column, Column], Column]
    name: Callable[[Column], Column]
    place: Callable[[Column], Column]
    kind: str


def _high(h: Column) -> Column:
    """The upper 46 bits of a hash."""
    return F.shiftrightunsigned(h, 64 - 46)


_PACKED = _Pairs(
    lambda h, i: F.shiftleft(_high(h), PLACE).bitwiseOR(i.cast("long")),
    lambda x: F.shiftright(x, PLACE),
    lambda x: x.bitwiseAND(F.lit((1 << PLACE) - 1)),
    "array<bigint>",
)
_WIDE = _Pairs(lambda h, i: F.struct(_high(h).alias("h"), i.cast("int").alias("i")), lambda x: x["h"], lambda x: x["i"], "array<struct<h:bigint,i:int>>")


def sketch(text: Column, k: int = K, bins: int = BINS, packed: int = PACKED) -> Column:
    """array<bigint>: for every bin, bin * 2**32 + 32 bits of the hash of its pair; rising, empty for an empty text."""
    bits = bins.bit_length() - 1
    tokens = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]{1,%d}" % PIECE), F.lit(0))

    def kmers(t: Column, p: _Pairs) -> Column:
        word = F.transform(t, lambda x: F.xxhash64(x))
        many = _let(word, lambda w: F.transform(F.slice(w, 1, F.size(w) - (k - 1)), lambda x, i: p.make(F.xxhash64(x, *[w[i + j] for j in range(1, k)]), i)))
        one = F.array(p.make(F.xxhash64(*[F.coalesce(F.get(t, F.lit(j)), F.lit("")) for j in range(k)]), F.lit(0)))
        return F.when(F.size(t) >= k, many).when(F.size(t) > 0, one).otherwise(F.array().cast(p.kind))

    def elements(s: Column, p: _Pairs) -> Column:
        # Sorted k-mers: where a run of equal hashes begins; the place within the run is the occurrence number.
        first = F.filter(F.transform(s, lambda x, i: F.when((i == 0) | (p.name(F.get(s, i - 1)) != p.name(x)), i)), lambda i: i.isNotNull())
        run = lambda r, a, j: F.transform(F.slice(s, a + 1, F.coalesce(F.get(r, j + 1), F.size(s)) - a), lambda x, o: p.make(F.xxhash64(p.name(x), o), p.place(x)))
        return _let(first, lambda r: F.flatten(F.transform(r, lambda a, j: run(r, a, j))))

    def pairs(q: Column, p: _Pairs) -> Column:
        bin_of = lambda x: F.shiftright(p.name(x), 46 - bits).cast("int")
        # The first two of every bin: no bin before needs more of it.
        two = F.filter(q, lambda x, i: (i < 2) | (bin_of(F.get(q, i - 2)) != bin_of(x)))

        def fold(z: Column) -> Column:
            def value(x: Column, y: Column) -> Column:
                turn = p.place(x) <= p.place(y)
                h = F.when(turn, F.xxhash64(p.name(x), p.name(y))).otherwise(F.xxhash64(p.name(y), p.name(x)))
                return F.shiftrightunsigned(h, 32)

            def served(x: Column, i: Column) -> Column:
                # The bins whose first element x is: those after the bin of the element before, up to its own.
                last = F.when(i == 0, F.lit(-1)).otherwise(bin_of(F.get(z, i - 1)))
                h = value(x, F.coalesce(F.get(z, i + 1), z[0]))
                return F.when(bin_of(x) > last, _let(h, lambda v: F.transform(F.sequence(last + 1, bin_of(x)), lambda b: F.shiftleft(b.cast("long"), 32).bitwiseOR(v))))

            wrap = bin_of(F.element_at(z, -1))
            rest = F.when(wrap < bins - 1, _let(value(z[0], F.coalesce(F.get(z, F.lit(1)), z[0])), lambda v: F.transform(F.sequence(wrap + 1, F.lit(bins - 1)), lambda b: F.shiftleft(b.cast("long"), 32).bitwiseOR(v))))
            own = F.flatten(F.filter(F.transform(z, served), lambda a: a.isNotNull()))
            return F.when(F.size(z) > 0, F.concat(own, F.coalesce(rest, F.array().cast("array<bigint>")))).otherwise(F.array().cast("array<bigint>"))

        return _let(two, fold)

    def made(t: Column, p: _Pairs) -> Column:
        return _let(F.sort_array(kmers(t, p)), lambda s: _let(F.sort_array(elements(s, p)), lambda q: pairs(q, p)))

    return _let(tokens, lambda t: F.when(F.size(t) < min(packed, PACKED), made(t, _PACKED)).otherwise(made(t, _WIDE)))


def written(sk: Column) -> Column:
    """The sketch as text: 8 hexadecimal digits a bin."""
    return F.array_join(F.transform(sk, lambda x: F.lpad(F.lower(F.hex(x.bitwiseAND(F.lit((1 << 32) - 1)))), 8, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """Share of bins that agree, 0 to 1; an empty sketch agrees with an empty one only."""
    most = F.greatest(F.size(a), F.size(b))
    return F.when(most == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / most)


def cut_points(ids: DataFrame, rows: int = ROWS) -> list[int]:
    """The least id of each bucket, rising: about rows ids a bucket, at most CUTS of them. Only ids are shuffled."""
    n = min(CUTS, -(-ids.count() // rows))
    if n < 2:
        first = ids.agg(F.min("doc_id")).first()[0]
        return [] if first is None else [first]
    dealt = ids.select("doc_id").repartitionByRange(n, "doc_id")
    return sorted(r["_least"] for r in dealt.groupBy(F.spark_partition_id().alias("_p")).agg(F.min("doc_id").alias("_least")).collect())


def bucket_of(doc_id: Column, points: list[int]) -> Column:
    """The number of cut points at or below doc_id, less one, by binary search in a constant array."""
    known = F.split(F.lit(",".join(map(str, points))), ",").cast("array<bigint>")
    steps = [1 << i for i in reversed(range(max(1, len(points).bit_length())))]

    def step(at: Column, size: Column) -> Column:
        return F.when(F.coalesce(F.get(known, at + size) <= doc_id, F.lit(False)), at + size).otherwise(at)

    return F.aggregate(F.array(*[F.lit(s) for s in steps]), F.lit(0), step)


def _with_next(docs: DataFrame, rows: int, of: Callable[[Column], Column]) -> DataFrame:
    """docs (distinct doc_id, text) with their sketch as _own and the next document's text and sketch as _text and _next."""
    points = cut_points(docs.select("doc_id"), rows) or [0]
    b = bucket_of(F.col("doc_id"), points)
    firsts = F.get(F.split(F.lit(",".join(map(str, points))), ",").cast("array<bigint>"), b)
    own = docs.select("doc_id", "text", b.alias("_b"), F.lit(False).alias("_edge"))
    edge = docs.where(firsts == F.col("doc_id")).select("doc_id", "text", F.pmod(b - 1, F.lit(len(points))).alias("_b"), F.lit(True).alias("_edge"))
    # An edge comes after all ids of its bucket, that of the first bucket too, which goes around to the last one.
    order = Window.partitionBy("_b").orderBy("_edge", "doc_id")
    both = own.unionByName(edge).repartition("_b").withColumn("_own", of(F.col("text")))
    return both.select("*", F.lead("text").over(order).alias("_text"), F.lead("_own").over(order).alias("_next")).where(~F.col("_edge")).drop("_edge", "_b")


def with_edits(docs: DataFrame, k: int = K, bins: int = BINS, rows: int = ROWS, packed: int = PACKED) -> DataFrame:
    """Fingerprints of docs (doc_id, text) and of their edited texts, and their likeness to those and to the next ones.

    The edited text has the last floor(n_chars / 2) code points replaced by the first as many (or all) of the next
    document.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    known = docs.where("doc_id is not null")
    of = lambda c: sketch(c, k, bins, packed)
    if known.groupBy("doc_id").count().where("count > 1").take(1):
        # Ids repeat: their succession goes by one text an id, and is then joined to every row.
        after = _with_next(known.groupBy("doc_id").agg(F.min("text").alias("text")), rows, of)
        after = cut(after.select(F.col("doc_id").alias("_id"), "_text"), "next")
        both = known.join(after.hint("merge"), F.col("doc_id") == F.col("_id")).withColumns({"_own": of(F.col("text")), "_next": of(F.col("_text"))})
    else:
        both = _with_next(known, rows, of)
    n = F.length("text")
    edited = F.concat(F.expr("substring(text, 1, cast(length(text) - length(text) div 2 as int))"), F.expr("substring(_text, 1, cast(length(text) div 2 as int))"))

    # Plain columns in two steps: each sketch is used several times, so the steps are not merged, and whoever takes only
    # n_chars and edited_sha256 has no sketch worked out at all.
    made = both.select("doc_id", n.cast("long").alias("n_chars"), F.sha2(edited, 256).alias("edited_sha256"), "_own", of(edited).alias("_edit"), "_next")
    own, edit = F.col("_own"), F.col("_edit")
    out = made.select(
        "doc_id", "n_chars", "edited_sha256", written(own).alias("fingerprint"), written(edit).alias("edited_fingerprint"),
        likeness(own, edit).alias("near_edited"), likeness(own, F.col("_next")).alias("near_next"),
    )
    alone = docs.where("doc_id is null").select("doc_id", n.cast("long").alias("n_chars"), written(of(F.col("text"))).alias("fingerprint"))
    return out.unionByName(alone, allowMissingColumns=True)
