"""Helpers shared by the operators: input selection, written tables, batches, numpy word hashing."""

from __future__ import annotations

import ctypes
import re
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from dataclasses import dataclass
from functools import cache, reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clashlens.session import ensure_checkpoint_dir

if hasattr(libc := ctypes.CDLL(None), "mallopt"):
    # Spark keeps Python workers for many tasks: let the arrays of a block (M_MMAP_THRESHOLD, from 512 KB) go
    # back to the system when they are freed, not stay with the worker
    libc.mallopt(-3, 1 << 19)

#: Text bytes handled at once inside a task.
BLOCK_BYTES = 1 << 20
#: Bytes of the record batches that go to and from Python workers (a row is never cut).
BATCH_BYTES = 4 << 20

_workspace: ContextVar[str | None] = ContextVar("workspace", default=None)


def bounded_batches(spark: SparkSession, size: int = BATCH_BYTES) -> None:
    """Let the session's record batches be no larger than ``size``: a batch is in memory several times."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = re.match(r"\d+", spark.conf.get(key, None) or "")
    if not now or int(now[0]) > size:
        spark.conf.set(key, str(size))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def columns_only(df: DataFrame, **kinds: str) -> DataFrame:
    """The named columns, cast; every other column (whatever its name) is left out."""
    return df.select(*(F.col(f"`{c}`").cast(k).alias(c) for c, k in kinds.items()))


def shared_path(spark: SparkSession, tag: str) -> str:
    """A new place in the shared folder, inside the workspace that is open."""
    return f"{_workspace.get() or ensure_checkpoint_dir(spark).rstrip('/')}/llm-{tag}-{uuid.uuid4().hex}"


@contextmanager
def workspace(path: str):
    """Tables that ``saved`` writes meanwhile lie under ``path``, so that they can be dropped together."""
    token = _workspace.set(path)
    try:
        yield path
    finally:
        _workspace.reset(token)


def drop(spark: SparkSession, path: str) -> None:
    """Delete a folder of saved tables, on whatever file system it is."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def saved(df: DataFrame, tag: str) -> DataFrame:
    """Write to the shared folder and read back: later jobs start there, also after a lost executor."""
    spark = df.sparkSession
    path = shared_path(spark, tag)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def held_out(doc_id: str = "doc_id"):
    """Rows kept out of any training: crc32 of the id as text leaves 2 modulo 4."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def blocks(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches into slices of about ``limit`` bytes of text (one row at least)."""
    for b in batches:
        n = b.num_rows
        if not n:
            continue
        size = np.zeros(n, np.int64)
        col = b.column(b.schema.get_field_index(text))
        size[:] = pc.fill_null(pc.binary_length(col), 0).to_numpy(zero_copy_only=False)
        group = np.cumsum(size) // limit
        cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), n]
        for a, z in zip(cuts, cuts[1:]):
            if z > a:
                yield b.slice(a, z - a)


def as_batch(schema: pa.Schema, *cols) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, (pa.Array, pa.ChunkedArray)) else pa.array(c, type=f.type)
                                       for c, f in zip(cols, schema)], schema=schema)


def range_splits(df: DataFrame, col: str, buckets: int) -> list[int]:
    """At most ``buckets - 1`` ascending split points of an integer column (one aggregation, one value a bucket)."""
    if buckets < 2:
        return []
    steps = ", ".join(repr(i / buckets) for i in range(1, buckets))
    got = df.agg(F.expr(f"percentile_approx(`{col}`, array({steps}), 10000)").alias("q")).collect()[0]["q"]
    return sorted(set(got or []))


def bucket_of(col: str, splits: list[int], width: int = 64):
    """Number of split points <= the value: coarse steps first, then within the step; null is 0."""
    if not splits:
        return F.lit(0)
    coarse = splits[::width]
    fine = [splits[i:i + width] for i in range(0, len(splits), width)]
    arr = lambda v: F.array(*(F.lit(int(x)).cast("long") for x in v))
    below = lambda a: F.size(F.filter(a, lambda s: s <= F.col(col)))
    if len(fine) == 1:
        return F.coalesce(below(arr(splits)), F.lit(0))
    step = below(arr(coarse))
    return F.coalesce(F.when(step == 0, 0).otherwise(
        (step - 1) * width + below(F.element_at(F.array(*(arr(f) for f in fine)), step))), F.lit(0))


# --- hashing of words in numpy -------------------------------------------------------------------

_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15 | 1)
_BASE_INV = _U(pow(int(_BASE), -1, 1 << 64))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_powers: list[np.ndarray] = []


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A 64-bit finalizer: xor-shifts and odd multipliers."""
    x = x + _U((salt * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_BYTE = mix(_LOWER.astype(np.uint64), 7)


def _pow(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = max(1 << 19, 1 << (n - 1).bit_length())
        _powers[:] = []
        for b in (_BASE, _BASE_INV):
            p = np.full(size, b, np.uint64)
            p[0] = 1
            _powers.append(np.cumprod(p))
    return _powers[0][:n], _powers[1][:n]


def text_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and the n + 1 offsets of its rows (null: empty)."""
    col = col.cast(pa.large_binary()) if not pa.types.is_large_binary(col.type) else col
    if col.null_count:
        col = pc.fill_null(col, b"")
    off = np.frombuffer(col.buffers()[1], np.int64)[col.offset:col.offset + len(col) + 1]
    buf = col.buffers()[2]
    data = np.frombuffer(buf, np.uint8)[off[0]:off[-1]] if buf is not None else np.zeros(0, np.uint8)
    return data, off - off[0]


def range_hashes(values: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of ranges of a sequence of 64-bit values, equal for equal contents."""
    if not len(first):
        return np.zeros(0, np.uint64)
    pw, inv = _pow(len(values))
    run = np.cumsum(values * pw)
    total = run[end - 1] - np.where(first > 0, run[first - 1], _U(0))
    return mix(total * inv[first] + (end - first).astype(np.uint64))


def word_hashes(col: pa.Array, is_break: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the ASCII-lower-cased words of each text, and the n + 1 word offsets of its rows.

    ``is_break``: 256 booleans, bytes that end a word.
    """
    data, off = text_bytes(col)
    n = len(data)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(off), np.int64)
    inside = ~is_break[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    edge = off[1:-1]
    edge = edge[(edge > 0) & (edge < n)]
    first[edge] |= inside[edge]        # a text's first byte begins a word even where the text before has no break
    last[edge - 1] |= inside[edge - 1]
    s, e = np.flatnonzero(first), np.flatnonzero(last)
    return range_hashes(_BYTE[data], s, e + 1), np.searchsorted(s, off)


def run_map(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    return df.mapInArrow(fn, schema)


def checked_broadcast(df: DataFrame, rows: int = 500_000, size: int = 64 << 20) -> DataFrame:
    """``df`` (written) marked for broadcast if it has at most ``rows`` rows and ``size`` bytes, counted, else as it is."""
    wide = [F.octet_length(F.col(f"`{c}`").cast("string")) for c, kind in df.dtypes if kind not in ("bigint", "int", "boolean", "double")]
    own = reduce(lambda a, b: a + b, (F.coalesce(w, F.lit(0)) for w in wide), F.lit(8 * len(df.columns)))
    got = df.agg(F.count("*").alias("n"), F.sum(own.cast("long")).alias("b")).collect()[0]
    return F.broadcast(df) if got["n"] <= rows and (got["b"] or 0) <= size else df


def labelled_sample(labels: DataFrame, label: str, rows: int, salt: str) -> DataFrame:
    """(doc_id, label): about ``rows`` ids at most of every label, of the ids that aren't held out.

    Takes the ids whose salted hash lies below the share that ``rows`` is of the label's ids. An id with
    several labels has the largest. Null ids and labels are left out.
    """
    known = (labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("string").alias("label"))
             .where(F.col("doc_id").isNotNull() & F.col("label").isNotNull() & ~held_out())
             .groupBy("doc_id").agg(F.max("label").alias("label")))
    counts = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    unit = F.shiftrightunsigned(F.xxhash64(F.lit(salt), "doc_id"), 11) / F.lit(float(1 << 53))
    share = F.lit(0.0)
    for k, n in counts.items():
        share = F.when(F.col("label") == k, F.lit(min(1.0, rows / n))).otherwise(share)
    return known.where(unit < share)


class PieceTable:
    """Numbers by 64-bit hash, in arrays: open addressing with all look-ups taking a step at a time.

    Cleared when it is half full, and larger only as long as one block has more than that (a text is never cut).
    """

    def __init__(self, bits: int = 20):
        self.bits = bits
        self.clear()

    def clear(self) -> None:
        self.keys, self.values, self.used = np.zeros(1 << self.bits, _U), np.zeros(1 << self.bits, np.int64), 0

    def full_with(self, more: int) -> bool:
        return 2 * (self.used + more) > len(self.keys)

    def get(self, h: np.ndarray) -> np.ndarray:
        """The numbers; -1 where there is none."""
        mask = _U(len(self.keys) - 1)
        slot = (h & mask).astype(np.int64)
        have = self.keys[slot]
        out = np.where(have == h, self.values[slot], -1)
        open_ = np.flatnonzero((have != h) & (have != 0))
        while len(open_):
            slot[open_] = (slot[open_] + 1) & int(mask)
            have, want = self.keys[slot[open_]], h[open_]
            hit = have == want
            out[open_[hit]] = self.values[slot[open_[hit]]]
            open_ = open_[~hit & (have != 0)]
        return out

    def put(self, h: np.ndarray, values: np.ndarray) -> None:
        """Add distinct hashes that aren't there; the arrays double until half of them is free."""
        if self.full_with(len(h)):
            some = self.keys != 0
            h, values = np.concatenate([self.keys[some], h]), np.concatenate([self.values[some], values])
            size = 1 << (2 * len(h) - 1).bit_length()
            self.keys, self.values, self.used = np.zeros(size, _U), np.zeros(size, np.int64), 0
        mask = len(self.keys) - 1
        slot = (h & _U(mask)).astype(np.int64)
        open_ = np.arange(len(h))
        while len(open_):
            free = open_[self.keys[slot[open_]] == 0]
            self.keys[slot[free]] = h[free]         # of several for one slot the last stays
            won = free[self.keys[slot[free]] == h[free]]
            self.values[slot[won]] = values[won]
            open_ = open_[self.keys[slot[open_]] != h[open_]]
            slot[open_] = (slot[open_] + 1) & mask
        self.used += len(h)


@cache
def code_points(pattern: str) -> np.ndarray:
    """Which code points a one-character pattern of ``regex`` matches."""
    import regex
    known = np.delete(np.arange(0x110000, dtype="<u4"), np.s_[0xD800:0xE000])
    out = np.zeros(0x110000, bool)
    for m in regex.finditer(f"(?:{pattern})+", known.tobytes().decode("utf-32-le")):
        out[known[m.start():m.end()]] = True
    return out


@dataclass
class Words:
    """The words of some texts, in order: where each lies in ``text``, its hash, and each text's word count."""
    text: str
    first: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    sizes: np.ndarray

    def strings(self, which) -> list[str]:
        return [self.text[a:z] for a, z in zip(self.first[which].tolist(), self.end[which].tolist())]

    def numbers(self, known: PieceTable, learn: Callable[[list[str]], np.ndarray], forget: Callable[[], None]) -> np.ndarray:
        """The number that ``known`` has for each word; ``learn`` gives those of new words."""
        got = known.get(self.hash)
        if (got < 0).any():
            h, which = np.unique(self.hash, return_index=True)
            if known.full_with(len(h)):
                known.clear()
                forget()
            which = which[known.get(h) < 0]
            known.put(self.hash[which], learn(self.strings(which)))
            got = known.get(self.hash)
        return got


def words_of(texts: list[str], inside: np.ndarray) -> Words:
    """Maximal runs of the code points marked in ``inside``."""
    text = "\n".join([*texts, ""])
    code = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    size = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    ends = np.cumsum(size) - 1
    is_in = inside[code]
    is_in[ends] = False
    edge = np.diff(np.concatenate([[0], is_in.astype(np.int8), [0]]))
    first, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    return Words(text, first, end, range_hashes(mix(code.astype(_U), 43), first, end), np.bincount(np.searchsorted(ends, first), minlength=len(texts)))
