"""Near-duplicate groups by SimHash (operator 13), found through pivot distance tables.

A fingerprint has 64 bits; two documents link when theirs differ in at most two. A fixed set of reference
fingerprints (pivots) is compared with every fingerprint, and their Hamming distances are its coordinates.
By the triangle inequality two fingerprints that differ in b bits have no coordinate that differs by more
than b, so a pair with a larger difference anywhere is discarded unseen; what survives all pivots is
verified on the bits.

Distances are tabulated by parts: the bits are cut into five segments, and a table gives each segment
value's distances to the pivots' own values there (a fingerprint's distance is their sum). The pivots
resolve a segment: no two values have equal distances to all of them. Two differing bits lie in at most
two segments, so three of the five have equal coordinates; documents meet under the ten choices of three.
A key with very many fingerprints is cut again, in the same way, by quarters of its two free segments
(two of the four agree); thirteen bits are left free then, so no group holds more than 8,192
fingerprints. Equal fingerprints are one node all along, however many documents have them, and a group
reports a spanning set of its links, not its pairs.

Defined results: words are runs without blank bytes after A-Z became a-z; shingles are three consecutive
words joined by a blank, repeats included; a text with one or two words has one shingle, all its words. A
null text, or one without words, has the fingerprint zero and links like any other. Rows that repeat an id
are told apart by their fingerprints; a null id gets the smallest id of its group, null if there is none.
Ties: the smallest id names a group. Other columns, whatever their names, aren't read.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clashlens.llm.common import as_batch, blocks, checked_broadcast, columns_only, mix, saved
from clashlens.llm.jaccard_join import components

SEED = 42
WORDS = 3
MOST_BITS = 2
CHUNK = 1 << 16         # shingles whose bits are counted at once

#: Bounds of the five segments of a fingerprint, and of the quarters of a free segment pair.
SEGMENTS = ((0, 13), (13, 26), (26, 39), (39, 52), (52, 64))
CHOICES = tuple(combinations(range(5), 3))
HALVES = tuple(combinations(range(4), 2))
PIVOTS = mix(np.arange(24, dtype=np.uint64), 61)

HOT = 2048              # fingerprints under one key from which it is cut again
PAIRS = 1 << 21         # pairs whose coordinates are compared at once


# --- fingerprints --------------------------------------------------------------------------------

def _bit_counts(joined: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """How many of the shingles' hashes have each bit set."""
    out = np.zeros(64, np.int64)
    digest = xxhash.xxh64_intdigest
    for a in range(0, len(starts), CHUNK):
        h = np.array([digest(joined[s:e], SEED) for s, e in zip(starts[a:a + CHUNK].tolist(), ends[a:a + CHUNK].tolist())], "<u8")
        out += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return out


def simhash(text: str | None, n: int = WORDS) -> int:
    """The fingerprint of one text."""
    joined = b" ".join((text or "").encode().lower().split())      # bytes: A-Z and the six blanks only
    if not joined:
        return 0
    blanks = np.flatnonzero(np.frombuffer(joined, np.uint8) == 0x20)
    starts, ends = np.concatenate([[0], blanks + 1]), np.concatenate([blanks, [len(joined)]])
    if len(starts) >= n:
        starts, ends = starts[:len(starts) - n + 1], ends[n - 1:]
    else:
        starts, ends = starts[:1], ends[-1:]
    bits = _bit_counts(joined, starts, ends) * 2 > len(starts)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, n: int = WORDS) -> DataFrame:
    """(doc_id, fp): each row's fingerprint as a signed long."""
    schema = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])

    def run(batches):
        for b in blocks(batches):
            yield as_batch(schema, b.column(0), np.array([simhash(t, n) for t in b.column(1).to_pylist()], np.uint64).view(np.int64))

    return columns_only(docs, doc_id="long", text="string").mapInArrow(run, "doc_id long, fp long")


# --- pivot tables --------------------------------------------------------------------------------

def cut(fps: np.ndarray, lo: int, hi: int) -> np.ndarray:
    """The bits lo to hi - 1 of each fingerprint."""
    return (fps >> np.uint64(lo)) & np.uint64((1 << (hi - lo)) - 1)


def pivot_table(lo: int, hi: int) -> np.ndarray:
    """[value of the segment, pivot]: the segment's Hamming distances."""
    values = np.arange(1 << (hi - lo), dtype=np.uint64)
    return np.bitwise_count(values[:, None] ^ cut(PIVOTS, lo, hi)[None, :]).astype(np.int8)


_tables: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}


def _table(lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
    """The pivot table of a segment and the hash of each of its rows."""
    if (lo, hi) not in _tables:
        t = pivot_table(lo, hi)
        h = np.zeros(len(t), np.uint64)
        for k in range(t.shape[1]):
            h = mix(h ^ t[:, k].astype(np.uint64), k)
        _tables[lo, hi] = t, h
    return _tables[lo, hi]


def coordinates(fps: np.ndarray) -> np.ndarray:
    """[fingerprint, pivot]: whole Hamming distances, summed over the segments' tables."""
    out = np.zeros((len(fps), len(PIVOTS)), np.int8)
    for lo, hi in SEGMENTS:
        out += _table(lo, hi)[0][cut(fps, lo, hi).astype(np.int64)]
    return out


def _named(fps: np.ndarray, parts, start) -> np.ndarray:
    """Keys made of the coordinates that fingerprints have in some segments."""
    h = np.full(len(fps), start, np.uint64) if np.isscalar(start) else start
    for lo, hi in parts:
        h = mix(h ^ _table(lo, hi)[1][cut(fps, lo, hi).astype(np.int64)], lo + 1)
    return h


def keys(fps: np.ndarray) -> list[np.ndarray]:
    """One key for each choice of three segments."""
    return [_named(fps, [SEGMENTS[s] for s in chosen], np.uint64(c)) for c, chosen in enumerate(CHOICES)]


def finer_keys(fps: np.ndarray, key: np.ndarray, choice: int) -> list[np.ndarray]:
    """Six keys within a key of ``choice``, each with two quarters of the free segments."""
    quarters = []
    for s in range(5):
        if s not in CHOICES[choice]:
            lo, hi = SEGMENTS[s]
            quarters += [(lo, (lo + hi) // 2), ((lo + hi) // 2, hi)]
    return [_named(fps, [quarters[i] for i in two], mix(key, 71 + h)) for h, two in enumerate(HALVES)]


# --- links ---------------------------------------------------------------------------------------

def near_pairs(fps: np.ndarray, coords: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Those of the pairs (i, j) that differ in at most MOST_BITS bits.

    Pivot after pivot discards the pairs whose coordinates differ by more; the rest is verified.
    """
    for k in range(coords.shape[1]):
        c = coords[:, k]
        ok = np.abs(c[i] - c[j]) <= MOST_BITS
        i, j = i[ok], j[ok]
    ok = np.bitwise_count(fps[i] ^ fps[j]) <= MOST_BITS
    return i[ok], j[ok]


def _pairs_within(size: np.ndarray):
    """Index pairs (i < j) of members of the same group, groups lying one after another, in bounded parts."""
    end = np.repeat(np.cumsum(size), size)
    at = np.arange(len(end))
    partners = end - at - 1
    done = 0
    while done < len(at):
        total = np.cumsum(partners[done:])
        take = max(1, int(np.searchsorted(total, PAIRS, "right")))
        n = partners[done:done + take]
        i = np.repeat(at[done:done + take], n)
        yield i, i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n)
        done += take


def spanning_links(fps: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(a, b): each linked fingerprint with the first one of its group that it reaches, by the group's own links."""
    coords, first = coordinates(fps), np.arange(len(fps))
    found = [near_pairs(fps, coords, i, j) for i, j in _pairs_within(size)]
    i, j = (np.concatenate([f[k] for f in found]) if found else np.zeros(0, np.int64) for k in (0, 1))
    while len(i):
        low = np.minimum(first[i], first[j])
        before = first.copy()
        np.minimum.at(first, i, low)
        np.minimum.at(first, j, low)
        first = first[first]
        if (first == before).all():
            break
    b = np.flatnonzero(first != np.arange(len(fps)))
    return fps[first[b]], fps[b]


def _links(members: DataFrame) -> DataFrame:
    """(a, b): links of the fingerprints (key, fp) that share a key."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches):
        rest_key, rest_fp = np.zeros(0, np.int64), np.zeros(0, np.int64)

        def part(key, fp):
            edge = np.concatenate([[True], key[1:] != key[:-1]])
            size = np.diff(np.concatenate([np.flatnonzero(edge), [len(key)]]))
            more = np.repeat(size > 1, size)
            a, b = spanning_links(fp[more].view(np.uint64), size[size > 1])
            return as_batch(schema, a.view(np.int64), b.view(np.int64))

        for batch in batches:
            key = np.concatenate([rest_key, batch.column(0).to_numpy()])
            fp = np.concatenate([rest_fp, batch.column(1).to_numpy()])
            if not len(key):
                continue
            last = int(np.searchsorted(key, key[-1]))       # the last group may go on in the next batch
            if last:
                yield part(key[:last], fp[:last])
            rest_key, rest_fp = key[last:], fp[last:]
        if len(rest_key):
            yield part(rest_key, rest_fp)

    return members.repartition("key").sortWithinPartitions("key").mapInArrow(run, "a long, b long").distinct()


def linked_fingerprints(nodes: DataFrame, hot: int = HOT) -> DataFrame:
    """(a, b): links that span the groups of the distinct fingerprints ``nodes`` (fp)."""
    schema = pa.schema([("key", pa.int64()), ("fp", pa.int64()), ("choice", pa.int32())])

    def dealt(batches):
        for b in batches:
            fps = b.column(0).to_numpy().view(np.uint64)
            for c, k in enumerate(keys(fps)):
                yield as_batch(schema, k.view(np.int64), b.column(0), np.full(len(fps), c, np.int32))

    def finer(batches):
        for b in batches:
            key, fps, choice = b.column(0).to_numpy().view(np.uint64), b.column(1).to_numpy().view(np.uint64), b.column(2).to_numpy()
            for c in np.unique(choice).tolist():
                here = choice == c
                for k in finer_keys(fps[here], key[here], c):
                    yield as_batch(schema, k.view(np.int64), fps[here].view(np.int64), choice[here])

    kind = "key long, fp long, choice int"
    members = nodes.select("fp").mapInArrow(dealt, kind)
    crowded = saved(members.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > hot).select("key"), "hot")
    if crowded.isEmpty():
        return _links(members.select("key", "fp"))
    crowded = checked_broadcast(crowded)
    again = members.join(crowded, "key", "left_semi").select("key", "fp", "choice").mapInArrow(finer, kind)
    return _links(members.join(crowded, "key", "left_anti").select("key", "fp").unionByName(again.select("key", "fp")))


def near_duplicates(docs: DataFrame, n: int = WORDS, hot: int = HOT) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row of ``docs`` (doc_id, text)."""
    prints = saved(fingerprints(docs, n), "prints")
    nodes = saved(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "nodes")
    comp = components(saved(linked_fingerprints(nodes, hot), "links"))
    placed = nodes.join(comp.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("comp", "fp").alias("comp"))
    named = placed.groupBy("comp").agg(F.min("least").alias("component_id"))
    known = saved(placed.join(named, "comp").select("fp", "component_id"), "named")
    return (prints.join(checked_broadcast(known), "fp")
            .select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"))
