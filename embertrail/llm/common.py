"""What the operators share: tables cut from their lineage, running sums without a hot task, and word and
line hashes straight from Arrow buffers.

A word is a maximal run of characters outside space and U+0009 to U+000D. All six delimiters are single bytes in
UTF-8, so words, lines and their hashes are computed on the bytes of a whole Arrow batch at once.

In all operators doc_id is an integer column (it is cast to long); text ids must be mapped to integers first.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
SLICE_BYTES = 1 << 20
_GOLD = np.uint64(0x9E3779B97F4A7C15)
_ODD = np.uint64(0xD1342543DE82EF97)
_state: dict = {}


# --- tables cut from their lineage -------------------------------------------------------------------------------


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir of the session.

    Where it is unset, a local session (one machine, as in tests) gets a folder of its own; a cluster has none that
    every executor sees, so there it is an error.
    """
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = _state.setdefault("dir", tempfile.mkdtemp(prefix="embertrail-"))
    return where.rstrip("/")


def cut(df: DataFrame, what: str) -> DataFrame:
    """Write df as a Parquet table in the shared folder and read it again, so that a lost executor costs one stage."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/embertrail-{what}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._embertrail_path = path  # type: ignore[attr-defined]
    return out


def drop(df: DataFrame) -> None:
    """Delete a table that cut() wrote and that nothing will read any more."""
    path = getattr(df, "_embertrail_path", None)
    if path:
        sc = df.sparkSession.sparkContext
        p = sc._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(sc._jsc.hadoopConfiguration()).delete(p, True)


def unused(name: str, columns: list[str]) -> str:
    """name, with underscores before it as long as a column has it."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def word_count(text: Column) -> Column:
    """Words of a text; a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def ranked(df: DataFrame, keys: list[str], order: list[str], bucket: Column, sums: dict[str, str]) -> DataFrame:
    """Running sums within keys, for groups of any size.

    bucket must rise with order. Rows of one (key, bucket) are summed in one task; the offsets of the buckets come
    from a second, small window. sums maps a new column to the expression whose sum over all earlier rows it is.
    """
    df = df.withColumn("_b", bucket)
    w = Window.partitionBy(*keys, "_b").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    over = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    per = df.groupBy(*keys, "_b").agg(*[F.sum(F.expr(e)).alias(f"_s{i}") for i, e in enumerate(sums.values())])
    offs = per.select(
        *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)],
        F.col("_b").alias("_ob"),
        *[F.coalesce(F.sum(f"_s{i}").over(over), F.lit(0)).alias(f"_o{i}") for i in range(len(sums))],
    )
    on = F.col("_b").eqNullSafe(F.col("_ob"))
    for i, k in enumerate(keys):
        on = on & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    out = df.select("*", *[F.coalesce(F.sum(F.expr(e)).over(w), F.lit(0)).alias(f"_r{i}") for i, e in enumerate(sums.values())])
    out = out.join(offs, on)
    keep = [c for c in df.columns if c != "_b"]
    return out.select(*keep, *[(F.col(f"_o{i}") + F.col(f"_r{i}")).alias(n) for i, n in enumerate(sums)])


# --- hashes ------------------------------------------------------------------------------------------------------


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_WORD = ~np.isin(np.arange(256), [32, 9, 10, 11, 12, 13])
_KEEP = np.array([(1 << 8 * i) - 1 for i in range(9)], np.uint64)
_LONG = 256


def span_hashes(flat: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each span of bytes; equal bytes give equal hashes wherever they stand.

    Eight bytes at a time are folded into a state that is mixed after each, for all spans at once; spans of more than
    ``_LONG`` bytes go through xxh3. Different seeds give independent hashes.
    """
    if not len(starts):
        return np.zeros(0, np.uint64)
    data = np.zeros(len(flat) + 8, np.uint8)
    data[: len(flat)] = _LOWER[flat] if lower else flat
    eight = np.ndarray((len(flat) + 1,), "<u8", data, strides=(1,))
    size = (ends - starts).astype(np.int64)
    h = mix(size.astype(np.uint64) + np.uint64((2 * seed + 1) * int(_GOLD) % 2**64))
    todo = np.flatnonzero((size > 0) & (size <= _LONG))
    at = 0
    while len(todo):
        left = size[todo] - at
        part = eight[starts[todo] + at] & _KEEP[np.minimum(left, 8)]
        h[todo] = mix(h[todo] ^ (part * _ODD))
        at += 8
        todo = todo[left > 8]
    for i in np.flatnonzero(size > _LONG).tolist():
        h[i] = xxhash.xxh3_64_intdigest(data[starts[i] : ends[i]], seed)
    return h


@dataclass
class Slice:
    """Some whole texts of a batch: their rows, their bytes, and where each begins."""

    first: int
    flat: np.ndarray
    off: np.ndarray

    @property
    def n(self) -> int:
        return len(self.off) - 1

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start and end byte of every word, and for each text the number of words before it."""
        return self._runs(_IS_WORD[self.flat])

    def lines(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start and end byte of every line, empty ones too, split at line feeds; and the number before each text."""
        nl = np.flatnonzero(self.flat == 10)
        starts = np.sort(np.concatenate([self.off[:-1], nl + 1]), kind="stable")
        ends = np.sort(np.concatenate([self.off[1:], nl]), kind="stable")
        before = np.searchsorted(nl, self.off, "left") + np.arange(self.n + 1)
        return starts, ends, before

    def _runs(self, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if not len(w):
            z = np.zeros(0, np.int64)
            return z, z, np.zeros(self.n + 1, np.int64)
        cuts = self.off[(self.off > 0) & (self.off < len(w))]
        prev = np.empty_like(w)
        prev[0], prev[1:] = False, w[:-1]
        prev[cuts] = False
        nxt = np.empty_like(w)
        nxt[-1], nxt[:-1] = False, w[1:]
        nxt[cuts - 1] = False
        starts, ends = np.flatnonzero(w & ~prev), np.flatnonzero(w & ~nxt) + 1
        return starts, ends, np.searchsorted(starts, self.off, "left")

    def code_points(self) -> np.ndarray:
        """Number of code points before each byte."""
        out = np.zeros(len(self.flat) + 1, np.int64)
        np.cumsum((self.flat & 0xC0) != 0x80, out=out[1:])
        return out


def slices(arr: pa.Array, size: int = SLICE_BYTES) -> Iterator[Slice]:
    """The texts of an Arrow string array in runs of about size bytes; a longer text stands alone. Null counts as empty."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    if arr.null_count:
        arr = arr.fill_null("")
    if not len(arr):
        return
    big = pa.types.is_large_string(arr.type)
    bufs = arr.buffers()
    off = np.frombuffer(bufs[1], np.int64 if big else np.int32)[arr.offset : arr.offset + len(arr) + 1].astype(np.int64)
    data = np.frombuffer(bufs[2], np.uint8) if bufs[2] is not None else np.zeros(0, np.uint8)
    i = 0
    while i < len(arr):
        j = max(i + 1, int(np.searchsorted(off, off[i] + size, "right")) - 1)
        yield Slice(i, data[off[i] : off[j]], off[i : j + 1] - off[i])
        i = j


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))
