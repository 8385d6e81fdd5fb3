"""Ranked lexical search (operator 12): the best documents for each query, over range-maximum tables.

Documents are turned into (length, the query terms they hold, how often). A task takes its documents in
shards, sorted by id, and gives each query term a posting list: document positions and impacts, an impact
being what a term occurrence is worth there before the term's weight. A sparse table over the impacts
answers the largest impact, and where it lies, in any range of a list by two look-ups.

A query keeps intervals of documents in a heap, best first. The bound of an interval is the sum, over the
query's terms, of weight times the largest impact inside it; no document in it scores more. The best
interval is split at the document with the maximum impact of the term that adds most: the document is
scored exactly (as an interval of one), the two sides are bounded and put back. The search of a shard ends
when no interval left can enter the query's list, which goes on from shard to shard; the lists of all
tasks are ranked together at the end. Nothing is estimated, so results are those of scoring everything.

Queries are taken in blocks of bounded size, each against all documents; equal texts are one query.

Defined results: terms are maximal runs of ASCII letters, digits and all characters beyond ASCII, with A-Z
as a-z; they are compared by 64-bit hashes. A null or empty text has no terms: as a document it is neither
counted nor found, as an item it finds nothing. Equal scores rank by ascending id, null ids last. Repeated
document rows are documents of their own; item rows that repeat an id are each answered. With no documents
or no items there are no rows. Other columns, whatever their names, aren't read.
"""

from __future__ import annotations

import heapq
import math
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clashlens.llm.common import BLOCK_BYTES, as_batch, blocks, columns_only, saved, text_bytes, word_hashes

BREAKS = np.zeros(256, bool)
BREAKS[[*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]] = True
QUERY_BYTES = 1 << 20       # query text of one block
WIDE = 1024                 # query terms from which an interval keeps the ranges of those it holds only
SHARD = 1 << 18             # postings of one shard
AT_ONCE = 32                # intervals split together
NO_ID = 1 << 63             # where ids are compared, a null is larger than all


# --- documents as counts of query terms ----------------------------------------------------------

def parts(col: pa.Array, limit: int):
    """The words' hashes and row offsets of a column, a text of over ``limit`` bytes in pieces cut between words."""
    data, off = text_bytes(col)
    if len(data) <= limit or len(col) != 1:
        yield word_hashes(col, BREAKS)
        return
    a = 0
    while a < len(data):
        z = min(a + limit, len(data))
        while z < len(data) and not BREAKS[data[z]]:
            near = np.flatnonzero(BREAKS[data[z:z + 4096]])
            z += int(near[0]) if len(near) else min(4096, len(data) - z)
        yield word_hashes(pa.array([data[a:z].tobytes()], pa.large_binary()), BREAKS)
        a = z


def term_counts(docs: DataFrame, terms: np.ndarray, limit: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, n, terms, tfs) of each row: its number of words, which of ``terms`` (sorted hashes) it has, and how often."""
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("terms", pa.list_(pa.int32())), ("tfs", pa.list_(pa.int32()))])
    size = len(terms)

    def run(batches):
        for b in blocks(batches, limit=limit):
            rows = b.num_rows
            n, found = np.zeros(rows, np.int64), [np.zeros(0, np.int64)]
            for h, off in parts(b.column(1), limit):
                words = np.diff(off)
                n += words
                at = np.minimum(np.searchsorted(terms, h), max(size - 1, 0))
                here = terms[at] == h if size else np.zeros(len(h), bool)
                found.append(np.repeat(np.arange(rows), words)[here] * size + at[here])
                if len(found) > 16:      # a long text's pieces so far, each term once
                    found = [np.concatenate(found)]
            key, tf = np.unique(np.concatenate(found), return_counts=True)
            cuts = np.searchsorted(key, np.arange(rows + 1) * size).astype(np.int32)
            lists = (pa.ListArray.from_arrays(cuts, pa.array(v.astype(np.int32))) for v in (key % max(size, 1), tf))
            yield as_batch(schema, b.column(0), n, *lists)

    return docs.mapInArrow(run, "doc_id long, n long, terms array<int>, tfs array<int>")


# --- one shard -----------------------------------------------------------------------------------

class Shard:
    """Posting lists of some documents, with range-maximum tables over their impacts.

    ``ids`` ascend (nulls last); postings are sorted by term, then document position.
    """

    def __init__(self, ids: np.ndarray, null: np.ndarray, n: np.ndarray, count: np.ndarray, term: np.ndarray, tf: np.ndarray,
                 documents: int, words: int):
        order = np.lexsort((ids, null))
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        self.ids, self.null, self.size = ids[order], null[order], max(1, len(ids))
        m = 75 + (25 * n * documents) // max(1, words)
        doc = np.repeat(np.arange(len(ids)), count)
        key = term.astype(np.int64) * self.size + place[doc]
        by = np.argsort(key, kind="stable")
        self.key, tf, doc = key[by], tf[by].astype(np.int64), doc[by]
        self.impact = (1_000_000_000 * tf) // (1000 * tf + 12 * m[doc])
        self._tables()

    def _tables(self) -> None:
        """best[k, i]: where the largest impact of postings i to i + 2^k - 1 lies; the first of equals."""
        total = len(self.key)
        term = self.key // self.size
        longest = int(np.max(np.bincount(np.unique(term, return_inverse=True)[1]))) if total else 1
        levels = [np.arange(total, dtype=np.int32)]
        step = 1
        while 2 * step <= longest:
            below = levels[-1]
            right = np.concatenate([below[step:], np.full(min(step, total), total - 1, np.int32)])[:total]
            levels.append(np.where(self.impact[right] > self.impact[below], right, below))
            step *= 2
        self.best = np.array(levels)
        self.log = np.frexp(np.arange(longest + 1))[1].astype(np.int64) - 1     # floor of the binary logarithm

    def range_maximum(self, a: np.ndarray, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Largest impact of each posting range [a, z) and its posting; 0 for an empty range."""
        some = z > a
        k = self.log[np.where(some, z - a, 1)]
        left = self.best[k, np.where(some, a, 0)]
        right = self.best[k, np.where(some, z - (1 << k), 0)]
        at = np.where(self.impact[right] > self.impact[left], right, left)
        return np.where(some, self.impact[at], 0), at

    def id_at(self, position: int) -> int:
        return NO_ID if self.null[position] else int(self.ids[position])

    def search(self, terms: np.ndarray, weights: np.ndarray, top: list[tuple[int, int]], most: int) -> list[tuple[int, int]]:
        """``top``, sorted pairs (- score, id), with this shard's documents; ``most`` pairs at most."""
        a, z = np.searchsorted(self.key, terms * self.size), np.searchsorted(self.key, (terms + 1) * self.size)
        held = z > a
        terms, weights, a, z = terms[held], weights[held], a[held], z[held]
        if not len(terms):
            return top
        base = terms * self.size

        def bounded(a, z):
            """Bounds of intervals given by their posting ranges, and the documents to split them at."""
            value, at = self.range_maximum(a, z)
            value = value * weights
            lead = value.argmax(axis=1)
            return value.sum(axis=1), self.key[at[np.arange(len(a)), lead]] % self.size

        def may_enter(bound, lo):
            return bound > 0 and (len(top) < most or (-bound, self.id_at(lo)) < top[-1])

        heap, serial, wide = [], 0, len(terms) > WIDE

        def packed(a, z):
            if not wide:
                return a, z, None
            some = np.flatnonzero(z > a)
            return a[some], z[some], some

        def unpacked(entries):
            out = np.zeros((2, len(entries), len(terms)), np.int64)
            for i, (a, z, some) in enumerate(entries):
                out[:, i, slice(None) if some is None else some] = a, z
            return out

        def put(lo, hi, a, z):
            nonlocal serial
            if not len(lo):
                return
            bound, at = bounded(a, z)
            for i, (b, l, h, d) in enumerate(zip(bound.tolist(), lo.tolist(), hi.tolist(), at.tolist())):
                if may_enter(b, l):
                    serial += 1
                    heapq.heappush(heap, (-b, serial, l, h, d, packed(a[i], z[i])))

        put(np.array([0]), np.array([self.size]), a[None], z[None])
        while heap:
            taken = []
            while heap and len(taken) < AT_ONCE:
                it = heapq.heappop(heap)
                if may_enter(-it[0], it[2]):
                    taken.append(it)
            if not taken:
                break
            lo, hi, d = (np.array([it[k] for it in taken]) for k in (2, 3, 4))
            a, z = unpacked([it[5] for it in taken])
            want = base[None] + d[:, None]
            at = np.searchsorted(self.key, want)
            past = at + (self.key[np.minimum(at, len(self.key) - 1)] == want)
            if wide:        # where the interval holds nothing of a term, neither do its parts
                at, past = np.where(z > a, at, 0), np.where(z > a, past, 0)
            score = (self.range_maximum(at, past)[0] * weights).sum(axis=1)
            top = sorted(top + [(-s, self.id_at(x)) for s, x in zip(score.tolist(), d.tolist())])[:most]
            left, right = d > lo, d + 1 < hi
            put(np.concatenate([lo[left], d[right] + 1]), np.concatenate([d[left], hi[right]]),
                np.concatenate([a[left], past[right]]), np.concatenate([at[left], z[right]]))
        return top


# --- the search ----------------------------------------------------------------------------------

def query_terms(texts: list[str]) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """The sorted hashes of all terms of the texts, and for each text its terms (as indices) and their repeats."""
    h, off = word_hashes(pa.array(texts, pa.large_string()), BREAKS)
    terms, at = np.unique(h, return_inverse=True)
    return terms, [np.unique(at[x:y], return_counts=True) for x, y in zip(off[:-1].tolist(), off[1:].tolist())]


def weight(documents: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1)))


def _shards(batches, postings: int):
    """Runs of counted rows with about ``postings`` postings (one row at least)."""
    held, n = [], 0
    for b in batches:
        a = 0
        upto = np.cumsum(pc.list_value_length(b.column(2)).to_numpy(zero_copy_only=False))
        while a < b.num_rows:
            z = max(a + 1, int(np.searchsorted(upto, (upto[a - 1] if a else 0) + postings - n, "right")))
            held.append(b.slice(a, z - a))
            n += int(upto[z - 1] - (upto[a - 1] if a else 0))
            a = z
            if n >= postings or a < b.num_rows:
                yield held
                held, n = [], 0
    if held:
        yield held


def _answers(counted: DataFrame, names: list[str], asked, documents: int, words: int, most: int) -> DataFrame:
    """(query, doc_id, score): for every task its best documents for every query."""
    schema = pa.schema([("query", pa.string()), ("doc_id", pa.int64()), ("score", pa.int64())])

    def shard(held):
        col = lambda i: pa.chunked_array([b.column(i) for b in held]).combine_chunks()
        ids, terms = col(0), col(2)
        return Shard(pc.fill_null(ids, 0).to_numpy(), ids.is_null().to_numpy(zero_copy_only=False), col(1).to_numpy(),
                     pc.list_value_length(terms).to_numpy(), terms.flatten().to_numpy(), col(3).flatten().to_numpy(), documents, words)

    def run(batches):
        tops: list[list[tuple[int, int]]] = [[] for _ in names]
        for held in _shards(batches, SHARD):
            here = shard(held)
            for q, (terms, weights) in enumerate(asked):
                tops[q] = here.search(terms, weights, tops[q], most)
        rows = [(names[q], None if i == NO_ID else i, -s) for q, top in enumerate(tops) for s, i in top]
        if rows:
            yield as_batch(schema, *zip(*rows))

    return counted.mapInArrow(run, "query string, doc_id long, score long")


def search(docs: DataFrame, items: DataFrame, most: int = 20, query_bytes: int = QUERY_BYTES) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``most`` best documents (doc_id, text) of each item (item_id, text)."""
    docs = columns_only(docs, doc_id="long", text="string")
    kind = items.schema["item_id"].dataType
    items = saved(items.select(F.col("`item_id`").alias("item_id"), F.col("`text`").cast("string").alias("text"))
                  .where("text is not null").withColumn("query", F.sha2("text", 256)), "items")
    queries = saved(items.groupBy("query").agg(F.first("text").alias("text")), "queries")
    total = queries.agg(F.sum(F.octet_length("text")).alias("b")).collect()[0]["b"] or 0
    blocks_ = -(-total // query_bytes)
    block = F.pmod(F.xxhash64("query"), F.lit(max(1, blocks_)))

    found = []
    for k in range(blocks_):
        asked = sorted((r["query"], r["text"]) for r in queries.where(block == k).collect())
        if not asked:
            continue
        terms, by_query = query_terms([t for _, t in asked])
        counted = saved(term_counts(docs, terms), "counted")
        facts = counted.agg(F.count_if(F.col("n") > 0).alias("n"), F.sum("n").alias("l")).collect()[0]
        df = np.zeros(len(terms), np.int64)
        for r in counted.select(F.explode("terms").alias("t")).groupBy("t").count().collect():
            df[r["t"]] = r["count"]
        documents, words = facts["n"], facts["l"] or 0
        weights = np.array([weight(documents, d) for d in df.tolist()], np.int64)
        found.append(_answers(counted.where(F.size("terms") > 0), [q for q, _ in asked], [(t, c * weights[t]) for t, c in by_query], documents, words, most))
    if not found:
        return items.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long").select(
            F.col("item_id").cast(kind).alias("item_id"), "rank", "doc_id", "score")
    best = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = reduce(DataFrame.unionByName, found).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= most)
    return items.select("item_id", "query").join(ranked, "query").select("item_id", "rank", "doc_id", "score")
