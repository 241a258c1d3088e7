"""Mixing sources to target weights by a low-discrepancy schedule, with DataFrame functions only.

Each source's documents are shuffled by a keyed hash and laid end to end; the source is cut into equal-token blocks of
its own size, about ``blocks`` of them, ``largest`` tokens at most. The schedule has one slot per block that the mix
takes. Slot n stands at the point n * phi modulo 1, taken as a Fibonacci lattice so that it is exact in integers; the
sources' shares of all slots, laid end to end, say which source the point belongs to. Slots are ranked per source, and
rank k takes block k modulo the number of blocks: so sources interleave evenly and a source repeats only after it has
been taken whole. A lattice gives each source its number of slots but for a few; the few missing are appended, the few
beyond the target are left out, and the last slot of a source stops at its target.

The points of the lattice that fall into a source's interval are found by the inverse of the lattice, in chunks, so
there is no range join; ranks and running token sums go through bucketed windows, so a hot source is not one task.

Sizes count words; a null text has none. Sources weigh 3, 1, 2 and so on by code point, null last (``WEIGHTS``), and
share ``share`` of all words; a target stops at ``repeats`` times its source's words and the excess is shared again.

Defined cases: an empty table gives an empty mix; a document without words is never taken; rows that repeat, doc_id
included, are separate documents of equal rank, each with its own blocks; a null doc_id is a document like any other.
Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, ranked, word_count

#: The weights, repeated over the sources in order.
WEIGHTS = (3, 1, 2)
CHUNK = 4096


def targets(sized: DataFrame, share: float = 1.5, repeats: float = 2.0) -> DataFrame:
    """Per source: source_size, target. One row a source; the windows run over this small table only."""
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weights = F.array(*[F.lit(float(w)) for w in WEIGHTS])
    per = per.withColumn("_w", weights[(F.row_number().over(order) - 1) % len(WEIGHTS)]).withColumn("_cap", F.col("source_size") * F.lit(float(repeats)))
    # Those whose cap is least for their weight stop first; the others share what is left.
    by = Window.orderBy(F.col("_cap") / F.col("_w"), F.col("source").asc_nulls_last())
    before, after = by.rowsBetween(Window.unboundedPreceding, -1), by.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy(F.lit(1))
    left = F.sum("source_size").over(everything) * F.lit(float(share)) - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))
    per = per.withColumn("_level", left / F.sum("_w").over(after)).withColumn("_stops", F.col("_level") >= F.col("_cap") / F.col("_w"))
    level = F.min(F.when(~F.col("_stops"), F.struct(F.col("_cap") / F.col("_w"), F.col("_level")))).over(everything)["_level"]
    return per.select("source", "source_size", "n_docs", F.coalesce(F.least(F.col("_cap"), F.col("_w") * level), F.col("_cap")).alias("target"))


def _fibonacci(least: int) -> tuple[int, int]:
    a, b = 1, 2
    while b < least:
        a, b = b, a + b
    return a, b


def schedule(plan: DataFrame) -> DataFrame:
    """slot, source_id, rank, from the plan of the sources: source_id, block, quota, n_slots (one row a source)."""
    total = plan.agg(F.sum("n_slots")).first()[0] or 0
    step, period = _fibonacci(max(2, total))
    inverse = pow(step, -1, period)
    order = Window.orderBy("source_id").rowsBetween(Window.unboundedPreceding, -1)
    edge = lambda c: F.floor(c.cast("double") / F.lit(float(max(1, total))) * F.lit(float(period))).cast("long")
    cum = F.coalesce(F.sum("n_slots").over(order), F.lit(0))
    ranges = plan.withColumn("_lo", edge(cum)).withColumn("_hi", edge(cum + F.col("n_slots"))).where("_hi > _lo")
    chunks = ranges.select("source_id", "n_slots", "_hi", F.explode(F.sequence("_lo", F.col("_hi") - 1, F.lit(CHUNK).cast("long"))).alias("_at"))
    points = chunks.repartition("_at").select("source_id", "n_slots", F.explode(F.sequence("_at", F.least(F.col("_hi"), F.col("_at") + CHUNK) - 1)).alias("_j"))
    slots = points.select("source_id", "n_slots", F.expr(f"_j * {inverse}L % {period}L").alias("slot")).where(F.col("slot") < total)
    width = max(1, total // 256)
    slots = ranked(slots, ["source_id"], ["slot"], F.expr(f"slot div {width}L"), {"rank": "1L"}).where("rank < n_slots")
    got = slots.groupBy("source_id").agg(F.count("*").alias("_got"))
    short = plan.join(got, "source_id", "left").select("source_id", "n_slots", F.coalesce("_got", F.lit(0)).alias("_got")).where("_got < n_slots")
    more = short.select("source_id", F.explode(F.sequence("_got", F.col("n_slots") - 1)).alias("rank"))
    return slots.select("slot", "source_id", "rank").unionByName(more.select((F.lit(total) + F.col("rank")).alias("slot"), "source_id", "rank"))


def mix(docs: DataFrame, share: float = 1.5, repeats: float = 2.0, blocks: int = 1024, largest: int = 4096, seed: int = 11) -> tuple[DataFrame, DataFrame]:
    """The mix of docs (doc_id, text, source): the documents, and the schedule's pieces.

    Documents: doc_id, source, size, source_size, target, row_key, taken (words taken, repeats counted). Pieces: slot,
    source_id, block, row_key, begin, end: the words of a document that a slot reads.
    """
    sized = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"))
    sized = sized.withColumn("_h", F.xxhash64(F.lit(seed), "doc_id", "size"))
    sized = cut(sized, "mix-sizes")
    per = targets(sized, share, repeats)
    per = per.withColumn("source_id", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())).cast("long"))
    words = sized.agg(F.sum("size")).first()[0] or 0
    top = max(largest, int(share * words) // (1 << 30))  # the lattice's products stay within 64 bits
    block = F.greatest(F.lit(1), F.least(F.lit(top), F.ceil(F.col("source_size") / blocks))).cast("long")
    quota = F.floor(F.col("target")).cast("long")
    plan = per.withColumn("block", block).withColumn("quota", quota).withColumn("n_blocks", F.ceil(F.col("source_size") / F.col("block")).cast("long"))
    whole, rest = F.expr("quota div greatest(source_size, 1L)"), F.expr("quota % greatest(source_size, 1L)")
    plan = cut(plan.withColumn("n_slots", (whole * F.col("n_blocks") + F.ceil(rest / F.col("block"))).cast("long")), "mix-plan")

    # Documents end to end in shuffled order, the running sum taken by hash range.
    with_plan = _with_sources(sized, plan)
    buckets = F.expr("shiftright(_h, 33) div greatest(1L, (1L << 31) * 4096L div greatest(4096L, n_docs))")
    placed = ranked(with_plan, ["source_id"], ["_h", "doc_id", "size"], buckets, {"begin": "size", "row_no": "1L"})
    placed = placed.withColumn("row_key", F.struct("source_id", "row_no"))
    first, last = F.expr("begin div block"), F.expr("(begin + size - 1) div block")
    parts = placed.where("size > 0").select("source_id", "row_no", "begin", "size", "block", F.explode(F.sequence(first, last)).alias("block_no"))
    parts = parts.select(
        "source_id", "row_no", "block_no", "begin",
        F.greatest(F.col("begin"), F.expr("block_no * block")).alias("lo"),
        F.least(F.col("begin") + F.col("size"), F.expr("(block_no + 1) * block")).alias("hi"),
    )

    slots = schedule(plan.select("source_id", "block", "quota", "n_slots", "n_blocks", "source_size"))
    slots = _on_plan(slots, plan.select("source_id", "block", "quota", "n_blocks", "source_size"))
    slots = slots.withColumn("block_no", F.expr("rank % n_blocks"))
    before = F.expr("(rank div n_blocks) * source_size + block_no * block")
    slots = slots.withColumn("stop", F.expr("block_no * block") + F.least(F.col("block"), F.col("quota") - before)).select("slot", "source_id", "block_no", "stop")

    pieces = parts.join(slots, ["source_id", "block_no"]).withColumn("until", F.least("hi", "stop")).where("until > lo")
    taken = pieces.groupBy("source_id", "row_no").agg(F.sum(F.col("until") - F.col("lo")).alias("_taken"))
    out = placed.join(taken.select(F.col("source_id").alias("_s"), F.col("row_no").alias("_n"), "_taken"), (F.col("source_id") == F.col("_s")) & (F.col("row_no") == F.col("_n")), "left")
    out = out.select("doc_id", "source", "size", "source_size", "target", "row_key", F.coalesce("_taken", F.lit(0)).cast("long").alias("taken"))
    return out, pieces.select("slot", "source_id", "row_no", "block_no", (F.col("lo") - F.col("begin")).alias("begin"), (F.col("until") - F.col("begin")).alias("end"))


def _with_sources(sized: DataFrame, plan: DataFrame) -> DataFrame:
    small = plan.select(F.col("source").alias("_src"), "source_id", "source_size", "n_docs", "target", "block")
    return sized.join(small, F.col("source").eqNullSafe(F.col("_src"))).drop("_src")


def _on_plan(slots: DataFrame, plan: DataFrame) -> DataFrame:
    return slots.join(plan, "source_id")


def word_slice(text: Column, n: Column) -> Column:
    """The text up to its n-th word."""
    return F.array_join(F.slice(F.regexp_extract_all(text, F.lit(r"([\x20\x09-\x0D]*[^\x20\x09-\x0D]+)"), F.lit(1)), F.lit(1), n.cast("int")), "")
