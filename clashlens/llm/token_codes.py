"""Token ids in directly addressable codes (operator 7).

Documents are encoded in ascending order of their ids into segments. A segment holds its documents' token
ids as directly addressable codes: every id is cut into chunks of 8 bits, level k holds the chunk k of the
ids that have one, a continuation bitmap says which ids go on, and a rank directory counts the set bits
before each block of 512. The token at any place is read by one chunk, one bit and one rank a level; no
other token is decoded.

File format: a table of segments in Parquet, which Spark's committer writes and any Spark file system
holds, with columns ``bucket``, ``seg`` (ascending document order is the order of bucket, seg), ``n_docs``,
``n_tokens`` and ``payload``, the bytes of one segment (little-endian):

    "DAC1"  levels u32  n_docs u64  n_tokens u64
    doc_id i64 [n_docs]   end u64 [n_docs]      token count up to and with each document
    per level: n u64, chunk u8 [n], then but for the last level: bitmap u8 [ceil(n / 8)], rank u32 [ceil(n / 512)]

Defined results: a null text is empty and has the end token only. Documents with a null id come first,
under the smallest 64-bit number in the file. Documents that repeat an id follow each other, ordered by
their text. An empty table gives no segment. Other columns of the input aren't read. Texts are read whole.
"""

from __future__ import annotations

import struct
from functools import cached_property
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from clashlens.llm.common import as_batch, blocks, bucket_of, columns_only, range_splits, saved, shared_path
from clashlens.llm.token_count import compiled_classes, load_tokenizer
from clashlens.llm.transducer import PieceTable, _byte_letters, split_pieces

BLOCK = 512
SEGMENT_TOKENS = 1 << 18
NO_ID = -(1 << 63)


# --- the codes -----------------------------------------------------------------------------------

def encode_segment(doc_ids: np.ndarray, sizes: np.ndarray, ids: np.ndarray) -> bytes:
    levels, rest = [], np.asarray(ids, np.uint32)
    while True:
        more = rest > 0xFF
        levels.append(((rest & 0xFF).astype(np.uint8), more))
        if not more.any():
            break
        rest = rest[more] >> 8
    out = [b"DAC1", struct.pack("<IQQ", len(levels), len(doc_ids), len(ids)), np.asarray(doc_ids, "<i8").tobytes(), np.cumsum(sizes).astype("<u8").tobytes()]
    for k, (chunk, more) in enumerate(levels):
        out += [struct.pack("<Q", len(chunk)), chunk.tobytes()]
        if k + 1 < len(levels):
            ones = np.add.reduceat(more, np.arange(0, len(more), BLOCK), dtype=np.uint32)
            out += [np.packbits(more, bitorder="little").tobytes(), (np.cumsum(ones) - ones).astype("<u4").tobytes()]
    return b"".join(out)


class Segment:
    """A reader of one segment's bytes; arrays are views, nothing is decoded until asked for."""

    def __init__(self, payload: bytes):
        if payload[:4] != b"DAC1":
            raise ValueError("not a segment")
        levels, self.n_docs, self.n_tokens = struct.unpack_from("<IQQ", payload, 4)
        at = 24

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            got = np.frombuffer(payload, kind, n, at)
            at += got.nbytes
            return got

        self.doc_ids, self.ends = take("<i8", self.n_docs), take("<u8", self.n_docs).astype(np.int64)
        self.levels = []
        for k in range(levels):
            n = int(take("<u8", 1)[0])
            chunk = take("u1", n)
            last = k + 1 == levels
            self.levels.append((chunk, None if last else take("u1", -(-n // 8)), None if last else take("<u4", -(-n // BLOCK))))

    def rank(self, k: int, i: int) -> int:
        """Set bits of level k's bitmap before place i."""
        _, bits, ranks = self.levels[k]
        block = i // BLOCK
        if block >= len(ranks):
            block = len(ranks) - 1
        first = block * BLOCK // 8
        inside = np.unpackbits(bits[first:-(-i // 8)], bitorder="little")[:i - block * BLOCK]
        return int(ranks[block]) + int(inside.sum())

    def token(self, i: int) -> int:
        out = 0
        for k, (chunk, bits, _) in enumerate(self.levels):
            out |= int(chunk[i]) << 8 * k
            if bits is None or not bits[i >> 3] >> (i & 7) & 1:
                break
            i = self.rank(k, i)
        return out

    def tokens(self, a: int, z: int, k: int = 0) -> np.ndarray:
        """The ids of places a to z of level k (of the segment, at level 0)."""
        if a >= z:
            return np.zeros(0, np.uint32)
        chunk, bits, _ = self.levels[k]
        out = chunk[a:z].astype(np.uint32)
        if bits is not None:
            more = np.unpackbits(bits[a // 8:-(-z // 8)], bitorder="little")[a % 8:a % 8 + z - a].astype(bool)
            first = self.rank(k, a)
            out[more] |= self.tokens(first, first + int(more.sum()), k + 1) << 8
        return out

    def document(self, k: int) -> np.ndarray:
        return self.tokens(int(self.ends[k - 1]) if k else 0, int(self.ends[k]))


# --- encoding texts ------------------------------------------------------------------------------

class Encoder:
    """The tokenizers library over the distinct pieces of many texts; each piece's ids are kept for reuse."""

    def __init__(self, path: str, classes: np.ndarray):
        self.tokenizer, self.classes = load_tokenizer(path), classes
        special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = regex.compile("|".join(map(regex.escape, special))) if special else None
        self.known = PieceTable()       # number of each piece: where its ids begin in the pool, and how many they are
        self.first, self.size = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.pool, self.used = np.zeros(1 << 20, np.uint32), 0

    def _keep(self, ids: np.ndarray) -> int:
        while self.used + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        self.pool[self.used:self.used + len(ids)] = ids
        self.used += len(ids)
        return self.used - len(ids)

    def _learn(self, hashes: np.ndarray, pieces: list[str]) -> None:
        """Encode new pieces. Words after a space stay apart when they are put together, so the library gets
        all of them as one text; the tokens that begin with the space say where each word begins."""
        plain = np.fromiter((p[0] == " " and p[1:].isascii() and p[1:].isalpha() for p in pieces), bool, len(pieces))
        words = [p for p, k in zip(pieces, plain) if k]
        first, size = np.zeros(len(pieces), np.int64), np.zeros(len(pieces), np.int64)
        for a in range(0, len(words), 4096):
            e = self.tokenizer.encode("".join(words[a:a + 4096]), add_special_tokens=False)
            ids = np.array(e.ids, np.uint32)
            starts = np.flatnonzero(self.begins[ids])
            at = np.flatnonzero(plain)[a:a + 4096]
            if len(starts) != len(at):
                raise ValueError("words did not stay apart")
            first[at] = self._keep(ids) + starts
            size[at] = np.diff(np.append(starts, len(ids)))
        rest = np.flatnonzero(~plain)
        for i, e in zip(rest.tolist(), self.tokenizer.encode_batch_fast([pieces[i] for i in rest], add_special_tokens=False)):
            first[i], size[i] = self._keep(np.array(e.ids, np.uint32)), len(e.ids)
        self.known.put(hashes, np.arange(len(self.first), len(self.first) + len(first)))
        self.first, self.size = np.concatenate([self.first, first]), np.concatenate([self.size, size])

    @cached_property
    def begins(self) -> np.ndarray:
        """Whether each token begins with a space (the letter for it in a byte-level vocabulary)."""
        space = next(c for c, b in _byte_letters().items() if b == 0x20)
        vocab = self.tokenizer.get_vocab()
        out = np.zeros(max(vocab.values()) + 1, bool)
        out[[i for t, i in vocab.items() if t.startswith(space)]] = True
        return out

    def encode(self, texts: list[str], end: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids, each text's followed by ``end``, and the number of ids of each text."""
        odd = {i: t for i, t in enumerate(texts) if self.special and self.special.search(t)}
        pieces = split_pieces([("" if i in odd else t) for i, t in enumerate(texts)], self.classes)
        at = self.known.get(pieces.hash)
        if (at < 0).any():
            h, which = np.unique(pieces.hash, return_index=True)
            if self.known.full_with(len(h)):
                self.known.clear()
                self.first, self.size, self.used = self.first[:0], self.size[:0], 0
            which = which[self.known.get(h) < 0]
            self._learn(pieces.hash[which], pieces.strings(which))
            at = self.known.get(pieces.hash)
        first, n = self.first[at], self.size[at]
        sizes = np.bincount(pieces.part, weights=n, minlength=len(texts)).astype(np.int64) + 1
        ids = np.empty(int(sizes.sum()), np.uint32)
        ends = np.cumsum(sizes) - 1
        ids[ends] = end
        body = np.ones(len(ids), bool)
        body[ends] = False
        if len(n):
            ids[body] = self.pool[np.arange(int(n.sum())) + np.repeat(first - (np.cumsum(n) - n), n)]
        if odd:     # a text with the string of a special token is encoded by itself
            parts = np.split(ids, ends[:-1] + 1)
            for i, t in odd.items():
                parts[i] = np.array([*self.tokenizer.encode(t, add_special_tokens=False).ids, end], np.uint32)
            ids, sizes = np.concatenate(parts), np.array([len(p) for p in parts], np.int64)
        return ids, sizes


_encoders: dict[str, Encoder] = {}


def encoder(path: str, classes: np.ndarray) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path, classes)
    return _encoders[path]


# --- files ---------------------------------------------------------------------------------------

def write(docs: DataFrame, tokenizer: str, path: str, end: int = 2, buckets: int | None = None) -> None:
    """Write the token ids of every row of ``docs`` to ``path`` in ascending order of doc_id.

    Texts are shuffled once, to ``buckets`` ranges of ids (by default the session's shuffle partitions).
    """
    spark = docs.sparkSession
    classes = compiled_classes(tokenizer)
    docs = columns_only(docs, doc_id="long", text="string")
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    splits = range_splits(docs, "doc_id", buckets)
    schema = pa.schema([("bucket", pa.int32()), ("seg", pa.int32()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()), ("payload", pa.binary())])

    def run(batches):
        bucket, seg, held = None, 0, []

        def segment():
            nonlocal seg, held
            ids, sizes, names = (np.concatenate([h[i] for h in held]) for i in range(3))
            held, seg = [], seg + 1
            return as_batch(schema, [bucket], [seg - 1], [len(sizes)], [len(ids)], [encode_segment(names, sizes, ids)])

        for whole in batches:
            numbers = whole.column(0).to_numpy()
            for a, z in _runs(numbers):
                if numbers[a] != bucket:
                    if held:
                        yield segment()
                    bucket, seg = int(numbers[a]), 0
                for b in blocks(iter([whole.slice(a, z - a)]), limit=1 << 20):
                    ids, sizes = encoder(tokenizer, classes).encode(pc.fill_null(b.column(2), "").to_pylist(), end)
                    held.append((ids, sizes, pc.fill_null(b.column(1), NO_ID).to_numpy()))
                    if sum(len(h[0]) for h in held) >= SEGMENT_TOKENS:
                        yield segment()
        if held:
            yield segment()

    (docs.withColumn("bucket", bucket_of("doc_id", splits).cast("int")).select("bucket", "doc_id", "text")
     .repartitionById(len(splits) + 1, F.col("bucket")).sortWithinPartitions("bucket", "doc_id", "text")
     .mapInArrow(run, "bucket int, seg int, n_docs long, n_tokens long, payload binary").write.parquet(path))


def _runs(x: np.ndarray) -> list[tuple[int, int]]:
    cuts = [0, *(np.flatnonzero(np.diff(x)) + 1).tolist(), len(x)]
    return [(a, z) for a, z in zip(cuts, cuts[1:]) if z > a]


def read_segments(spark: SparkSession, path: str) -> DataFrame:
    """The segments with ``start``, the number of ids before each.

    Bucket totals (one number a bucket, as many as ranges were written) go through the driver; inside a
    bucket the starts are a running sum over its segments.
    """
    seg = spark.read.schema("bucket int, seg int, n_docs long, n_tokens long, payload binary").parquet(path)
    sizes = saved(seg.select("bucket", "seg", "n_tokens"), "segments")
    totals = sorted((r["bucket"], r["n"]) for r in sizes.groupBy("bucket").agg(F.sum("n_tokens").alias("n")).collect())
    before, n = [], 0
    for b, k in totals:
        before.append((b, n))
        n += k
    if not before:
        return seg.withColumn("start", F.lit(0).cast("long"))
    offsets = spark.createDataFrame(before, "bucket int, before long")
    earlier = Window.partitionBy("bucket").orderBy("seg").rowsBetween(Window.unboundedPreceding, -1)
    starts = (sizes.withColumn("inside", F.coalesce(F.sum("n_tokens").over(earlier), F.lit(0)))
              .join(offsets, "bucket").select("bucket", "seg", (F.col("inside") + F.col("before")).alias("start")))
    return seg.join(starts, ["bucket", "seg"])


def read_documents(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32[, ids]) of every document in the files."""
    fields = [("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())]
    schema = pa.schema([*fields, ("ids", pa.list_(pa.int64()))] if with_ids else fields)

    def run(batches):
        for b in batches:
            for payload, start in zip(b.column(0), b.column(1).to_pylist()):
                s = Segment(payload.as_py())
                ends = s.ends
                first = np.concatenate([[0], ends[:-1]]).astype(np.int64)
                ids = [s.document(k) for k in range(s.n_docs)]
                names = pa.array(s.doc_ids, mask=s.doc_ids == NO_ID)
                cols = [names, first + start, ends - first, [crc32(x.astype("<u4").tobytes()) for x in ids]]
                yield as_batch(schema, *cols, *([[x.astype(np.int64) for x in ids]] if with_ids else []))

    sql = "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids array<long>" if with_ids else "")
    return read_segments(spark, path).select("payload", "start").mapInArrow(run, sql)


def round_trip(docs: DataFrame, tokenizer: str, end: int = 2, path: str | None = None) -> DataFrame:
    path = path or shared_path(docs.sparkSession, "token-codes")
    write(docs, tokenizer, path, end)
    return read_documents(docs.sparkSession, path)
