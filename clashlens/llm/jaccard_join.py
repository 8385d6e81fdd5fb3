"""Exact Jaccard similarity join on word n-gram sets (operator 2).

Candidates come from a partition of the universe of shingles. Sizes are cut into bands. In a band, two
sets that reach the threshold differ in at most H shingles, H growing with the smaller set's size. A hash
deals all shingles into m segments; among any H + 1 of them, two such sets agree on one. Every set is
indexed under its subsets of the first p segments, and in the first d of them also under each subset less
one shingle (which finds a difference of one); p is the smallest number with p + min(p, d) > H, so the
pair agrees within the smaller p of its two sets. Costs choose m and d for each band.

Empty subsets, and those of shingles that very many texts share, would put unrelated texts together. They
are no keys; a set makes up for each by more segments. Only a set that runs out of segments is indexed
under all its subsets. Which shingles are known as frequent changes costs, never results.

A bucket (sets under one key) is not expanded into pairs, and blocks of texts that share a key enter it as one. Each member is compared with the bucket's smallest
id, its hub; links form components. Two other members of a bucket then have a hub in common: the sets that
share a hub and lie in different components are compared in tiles of bounded size by parity sketches
(the bits in which two sketches differ never exceed the shingles in which the sets do), and the pairs
that the sketches leave are verified on the sets themselves. First a tile gives no more pairs than would
span its components, which joins nearly all that belong together whatever set the hub is; then it gives
all pairs that are left between the components that remain. So every linked pair is verified or lies within
one component already: components are those of the full join.

Defined results: words are runs without the given break bytes after ASCII lower-casing. A text with fewer
words than n has one shingle, all its words; a null text or one without words has none and links with
nothing (component: itself). Equal sets link. Ties: the smallest id names a component. A node is a set, not
an id: rows that repeat an id with other texts are compared each by its own. Documents with a null id are
returned with a null component. Other columns of the input, whatever their names, aren't read.
"""

from __future__ import annotations

from functools import cache, partial, reduce
from math import exp

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clashlens.llm.common import _U, as_batch, blocks, checked_broadcast, columns_only, mix, saved, word_hashes

BREAKS = np.zeros(256, bool)
BREAKS[[0x20, *range(0x09, 0x0E)]] = True
BAND_RATIO = 1.6


# --- shingle sets --------------------------------------------------------------------------------

def shingle_sets(col: pa.Array, n: int) -> list[np.ndarray]:
    """The sorted distinct hashes of the word n-grams of every text."""
    words, off = word_hashes(col, BREAKS)
    if len(words) >= n:
        grams = reduce(lambda acc, k: mix(acc ^ words[k:len(words) - n + 1 + k], k), range(1, n), mix(words[:len(words) - n + 1], n))
    out = []
    for a, z in zip(off[:-1].tolist(), off[1:].tolist()):
        if z - a >= n:
            out.append(np.unique(grams[a:z - n + 1]))
        elif z > a:
            out.append(np.array([reduce(lambda acc, w: mix(acc ^ w, 99), words[a + 1:z, None], mix(words[a:a + 1], z - a))[0]], np.uint64))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def _signed(x) -> np.ndarray:
    return np.asarray(x, np.uint64).view(np.int64)


def set_sizes(docs: DataFrame, n: int) -> DataFrame:
    """(doc_id, digest, n_shingles, h1, h2) of rows (doc_id, text, digest): the size of each document's set and 128 bits that name the set."""
    schema = pa.schema([("doc_id", pa.int64()), ("digest", pa.int64()), ("n_shingles", pa.int64()), ("h1", pa.int64()), ("h2", pa.int64())])

    def run(batches):
        for b in blocks(batches):
            sets = shingle_sets(b.column(1), n)
            names = [[mix(s, k).sum(dtype=np.uint64) for s in sets] for k in (11, 12)]
            yield as_batch(schema, b.column(0), b.column(2), [len(s) for s in sets], _signed(names[0]), _signed(names[1]))

    return docs.mapInArrow(run, "doc_id long, digest long, n_shingles long, h1 long, h2 long")


# --- bands and their allocation ------------------------------------------------------------------

def band_start(k: int) -> int:
    """Smallest size of band k; bands cover all sizes from 1."""
    return _starts(k + 1)[k]


@cache
def _starts(n: int) -> list[int]:
    out = [1]
    while len(out) < n:
        out.append(max(out[-1] + 1, int(out[-1] * BAND_RATIO)))
    return out


def band(size: int) -> int:
    k, n = 0, 8
    while _starts(n)[-1] <= size:
        n *= 2
    s = _starts(n)
    while s[k + 1] <= size:
        k += 1
    return k


def most_differences(size: int, num: int, den: int) -> int:
    """The largest symmetric difference of a set of this size and a set at least as large that link with it."""
    return (den - num) * size // num


@cache
def allocation(k: int, num: int, den: int, mean: float) -> tuple[int, int]:
    """(segments m, of them with one-deletion subsets d) of band k, by cost.

    ``mean``: mean size of the sets of this band. Cost of a set: its number of keys, and three more for each
    expected subset of one or two shingles, as unrelated texts can share those. A quarter more segments
    than the largest set needs stand by for subsets that are no keys.
    """
    need = most_differences(band_start(k + 1) - 1, num, den) + 1
    if need == 1:
        return 0, 0         # equal sets only: they are one set here
    mine, best = most_differences(int(mean), num, den) + 1, None
    for d in sorted({0, 1, 2, 3, *range(0, need + 1, max(1, need // 16))}):
        m = max(need - d, -(-need // 2))
        m, d = (1, 1) if m == 1 else (m + 1 + m // 4, min(d, m))
        p, lam = max(mine - d, -(-mine // 2)), mean / m
        cost = p + min(d, p) * lam + 3 * (p * exp(-lam) * (lam + lam * lam / 2) if m > 1 else 0)
        if best is None or cost < best[0]:
            best = cost, (m, d)
    return best[1]


def keys_of(s: np.ndarray, k: int, plan: tuple[int, int], num: int, den: int, frequent: np.ndarray) -> np.ndarray:
    """The index keys of a set under band k.

    A subset without a shingle beyond the frequent ones is no key. Such a segment counts nothing towards
    H + 1; one with a single telling shingle, whose subset less that shingle is no key, counts one. If two
    linked sets met under no key, then in every segment of the shorter index they would differ by at least
    what it counts in the set with the shorter index, together by more than H.
    """
    m, d = plan
    if not m or not len(s):
        return np.zeros(0, np.uint64)
    seg = (mix(s, 21) % _U(m)).astype(np.int64)
    order = np.argsort(seg, kind="stable")
    s, seg = s[order], seg[order]
    telling = np.ones(len(s), bool)
    if len(frequent):
        telling = frequent[np.minimum(np.searchsorted(frequent, s), len(frequent) - 1)] != s
    tell = np.bincount(seg, weights=telling, minlength=m).astype(np.int64)
    two = np.arange(m) < d
    counts = np.cumsum(np.minimum(tell, np.where(two, 2, 1)))
    need = most_differences(len(s), num, den) + 1
    p = int(np.searchsorted(counts, need)) + 1
    every = p > m           # not enough: all subsets are keys
    p = min(p, m)
    inside = seg < p
    s, seg, telling, tell, two = s[inside], seg[inside], telling[inside], tell[:p], two[:p]
    value, size = mix(s, 22), np.bincount(seg, minlength=p)
    total, full = np.zeros(p, np.uint64), np.flatnonzero(size)
    if len(full):
        total[full] = np.add.reduceat(value, (np.cumsum(size) - size)[full])
    where = mix(np.arange(p, dtype=np.uint64) + _U((k * 1_000_003 + m) << 20), 23)
    keep = (tell > 0) | every
    one = two[seg] & ((tell[seg] - telling > 0) | every)
    return np.unique(np.concatenate([mix(total[keep] + where[keep], 24), mix(total[seg[one]] - value[one] + where[seg[one]], 24)]))


def frequent_shingles(docs: DataFrame, n: int, in_block: int = 4, most: int = 200_000) -> np.ndarray:
    """Sorted hashes of shingles that many texts share.

    Every task counts the texts of each shingle in its blocks of texts (some hundred) and reports the
    counts from ``in_block`` up; the ``most`` shingles with the largest sums are taken.
    """
    schema = pa.schema([("shingle", pa.int64()), ("n", pa.int64())])

    def run(batches):
        for b in blocks(batches):
            x, c = np.unique(np.concatenate(shingle_sets(b.column(1), n)), return_counts=True)
            yield as_batch(schema, _signed(x[c >= in_block]), c[c >= in_block].astype(np.int64))

    top = docs.mapInArrow(run, "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "shingle").limit(most)
    return np.sort(np.array(top.toPandas()["shingle"], np.int64).view(np.uint64))


IN_BLOCK = 4        # texts of one block that share a key, from which the block stands behind one of them


def index(docs: DataFrame, n: int, num: int, den: int, means: dict[int, float], frequent: np.ndarray) -> DataFrame:
    """(node, keys, behind): the keys of each set in its band and the bands of smaller partners.

    Pre-aggregated by blocks of some hundred texts: of the texts in a block that share a key, from IN_BLOCK
    up, the smallest id alone has it in ``keys``; the others have (key, that id) in ``behind``.
    """
    pair = pa.struct([("key", pa.int64()), ("rep", pa.int64())])
    schema = pa.schema([("node", pa.int64()), ("keys", pa.list_(pa.int64())), ("behind", pa.list_(pair))])

    def run(batches):
        for b in blocks(batches):
            ids = b.column(0).to_numpy()
            each = []
            for s in shingle_sets(b.column(1), n):
                size, keys = len(s), [np.zeros(0, np.uint64)]
                if size:
                    for k in range(band(-(-num * size // den)), band(size) + 1):
                        if k in means:
                            keys.append(keys_of(s, k, allocation(k, num, den, means[k]), num, den, frequent))
                each.append(np.concatenate(keys))
            size = np.array([len(k) for k in each])
            keys, at, count = np.unique(np.concatenate(each), return_inverse=True, return_counts=True)
            node = np.repeat(ids, size)
            rep = np.full(len(keys), np.iinfo(np.int64).max)
            np.minimum.at(rep, at, node)
            led = (count[at] >= IN_BLOCK) & (rep[at] != node)
            own, behind, a = [], [], 0
            for z in np.cumsum(size).tolist():
                k, r, m = _signed(keys[at[a:z]]), rep[at[a:z]], led[a:z]
                own.append(k[~m])
                behind.append([{"key": x, "rep": y} for x, y in zip(k[m].tolist(), r[m].tolist())])
                a = z
            yield as_batch(schema, b.column(0), own, behind)

    return docs.mapInArrow(run, "node long, keys array<long>, behind array<struct<key: long, rep: long>>")


# --- verification and components -----------------------------------------------------------------

def parity_sketch(s: np.ndarray) -> bytes:
    """One bit for each hash class: whether the set has an odd number of shingles in it."""
    bits = 1 << max(9, int(4 * max(1, len(s)) - 1).bit_length())
    flags = np.bincount((mix(s, 31) % _U(bits)).astype(np.int64), minlength=bits) & 1
    return np.packbits(flags.astype(np.uint8), bitorder="little").tobytes()


def sets_of(docs: DataFrame, n: int) -> DataFrame:
    """(node, size, sketch, shingles) of rows (doc_id, text)."""
    schema = pa.schema([("node", pa.int64()), ("size", pa.int64()), ("sketch", pa.binary()), ("shingles", pa.list_(pa.int64()))])

    def run(batches):
        for b in blocks(batches):
            sets = shingle_sets(b.column(1), n)
            yield as_batch(schema, b.column(0), [len(s) for s in sets], [parity_sketch(s) for s in sets], [_signed(s) for s in sets])

    return docs.mapInArrow(run, "node long, size long, sketch binary, shingles array<long>")


def _words(sketches: list[bytes]) -> np.ndarray:
    """The sketches as rows of 64-bit words, folded to the length of the shortest."""
    short = min(map(len, sketches))
    out = []
    for x in sketches:
        w = np.frombuffer(x, np.uint64)
        out.append(w if len(x) == short else np.bitwise_xor.reduce(w.reshape(-1, short // 8), axis=0))
    return np.array(out)


def may_link(a: np.ndarray, b: np.ndarray, differ: np.ndarray, num: int, den: int) -> np.ndarray:
    """Whether sets of sizes a and b that differ in at least ``differ`` shingles can link."""
    common = (a + b - np.maximum(differ, np.abs(a - b))) // 2
    return den * common >= num * (a + b - common)


def verified(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (a, b) whose sets link: den * |intersection| >= num * |union|, in integers."""
    side = lambda c, what: sets.select(F.col("node").alias(c), *(F.col(x).alias(x + c) for x in what))
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def possible(batches):
        for batch in batches:
            a, b, na, nb = (batch.column(i).to_numpy() for i in range(4))
            differ = np.fromiter((int(np.bitwise_count(np.bitwise_xor(*_words([x, y]))).sum()) for x, y in zip(
                batch.column(4).to_pylist(), batch.column(5).to_pylist())), np.int64, len(a))
            ok = may_link(na, nb, differ, num, den)
            yield as_batch(schema, a[ok], b[ok])

    near = (pairs.join(side("a", ["size", "sketch"]), "a").join(side("b", ["size", "sketch"]), "b")
            .select("a", "b", "sizea", "sizeb", "sketcha", "sketchb").mapInArrow(possible, "a long, b long"))
    both = near.join(side("a", ["shingles"]), "a").join(side("b", ["shingles"]), "b")
    return (both.withColumn("i", F.size(F.array_intersect("shinglesa", "shinglesb")))
            .where(F.col("i") * den >= (F.size("shinglesa") + F.size("shinglesb") - F.col("i")) * num).select("a", "b"))


def compared_in_tiles(grouped: DataFrame, num: int, den: int, block: int = 1000, spanning: bool = False) -> DataFrame:
    """Pairs (a, b) of nodes that share a hub, lie in different components and can link by their sketches.

    ``grouped``: hub, node, comp, size, sketch. A hub's nodes are dealt into blocks of about ``block`` rows,
    and every two blocks meet in one tile, so no task holds a whole hub however many nodes it has. With
    ``spanning`` a tile gives a pair only if those before it don't connect its ends: fewer than it has nodes.
    """
    count = grouped.groupBy("hub").agg(F.count("*").alias("n"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi")
    dealt = (grouped.join(count.select("hub", F.ceil(F.col("n") / block).cast("int").alias("blocks")), "hub")
             .withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
             .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
             .select("hub", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"), "block", "node", "comp", "size", "sketch"))
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def tile(rows):
        block_, node, comp, size = (np.concatenate([r.column(i).to_numpy() for r in rows]) for i in range(3, 7))
        words = _words([x for r in rows for x in r.column(7).to_pylist()])
        x, y = int(rows[0].column(1)[0].as_py()), int(rows[0].column(2)[0].as_py())
        label = np.unique(comp, return_inverse=True)[1]
        largest = np.bincount(label).argmax()
        a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        other = label != largest        # of two components one is not the largest
        for i in np.flatnonzero(other).tolist():
            # later ones, and all of the largest component
            j = np.flatnonzero(~other | (np.arange(len(node)) > i)) if not spanning else np.flatnonzero(label != label[i])
            if x != y:
                j = j[block_[j] != block_[i]]
            ok = may_link(size[i], size[j], np.bitwise_count(words[i] ^ words[j]).sum(axis=1, dtype=np.int64), num, den) & (label[j] != label[i])
            k = j[ok]
            if spanning and len(k):
                met, at = np.unique(label[k], return_index=True)
                k = k[at]
                label[np.isin(label, met)] = label[i]
            a.append(np.minimum(node[k], node[i]))
            b.append(np.maximum(node[k], node[i]))
        return as_batch(schema, np.concatenate(a), np.concatenate(b))

    def run(batches):
        at, held = None, []
        for whole in batches:
            hub, x, y = (whole.column(i).to_numpy() for i in range(3))
            cuts = [0, *(np.flatnonzero((np.diff(hub) != 0) | (np.diff(x) != 0) | (np.diff(y) != 0)) + 1).tolist(), len(hub)]
            for u, v in zip(cuts, cuts[1:]):
                if u == v:
                    continue
                here = int(hub[u]), int(x[u]), int(y[u])
                if here != at and held:
                    yield tile(held)
                    held = []
                at = here
                held.append(whole.slice(u, v - u))
        if held:
            yield tile(held)

    return (dealt.repartition("hub", "x", "y").sortWithinPartitions("hub", "x", "y").mapInArrow(run, "a long, b long").distinct())


def components(edges: DataFrame) -> DataFrame:
    """(node, comp): the smallest node reachable from each node of ``edges`` (a, b).

    Contracts the graph: each node goes to its smallest neighbour, edges are rewritten to those, until
    no edge is left. Every round's tables are written to the shared folder.
    """
    edges = saved(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct(), "edges")
    moved = None
    while not edges.isEmpty():
        both = edges.select(F.col("b").alias("node"), F.col("a").alias("to")).unionByName(edges.select(F.col("a").alias("node"), F.col("b").alias("to")))
        step = saved(both.groupBy("node").agg(F.min("to").alias("to")).select("node", F.least("node", "to").alias("to")), "step")
        for _ in range(2):      # follow the pointers some way now; what is left is contracted next round
            far = step.select(F.col("node").alias("to"), F.col("to").alias("far"))
            step = step.join(far, "to", "left").select("node", F.coalesce("far", "to").alias("to"))
        step = saved(step, "step")
        at = lambda c: step.select(F.col("node").alias(c), F.col("to").alias(f"{c}2"))  # noqa: E731, B023
        edges = saved(edges.join(at("a"), "a").join(at("b"), "b").where("a2 <> b2")
                      .select(F.least("a2", "b2").alias("a"), F.greatest("a2", "b2").alias("b")).distinct(), "edges")
        if moved is None:
            moved = step.withColumnRenamed("to", "comp")
        else:
            moved = moved.join(step.select(F.col("node").alias("comp"), "to"), "comp", "left").select("node", F.coalesce("to", "comp").alias("comp"))
        moved = saved(moved, "comp")
    if moved is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("comp"))
    return moved


def _components(docs: DataFrame, n: int, num: int, den: int) -> tuple[DataFrame, DataFrame]:
    """The sets of the rows ``docs`` (doc_id, text, digest), and (h1, h2, comp) of every set that isn't empty and has an id."""
    sizes = saved(set_sizes(docs, n), "sizes")
    # a set's number is made once, where its row is written; its text is that of its smallest id
    sets_ = sizes.where("n_shingles > 0 and doc_id is not null").groupBy("h1", "h2").agg(
        F.min(F.struct("doc_id", "digest")).alias("at"), F.first("n_shingles").alias("size"))
    nodes = saved(sets_.select("h1", "h2", "at.doc_id", "at.digest", "size", F.monotonically_increasing_id().alias("node")), "nodes")

    top = nodes.agg(F.max("size").alias("m")).collect()[0]["m"] or 1
    starts = [s for s in _starts(band(top) + 2)]
    number = F.size(F.filter(F.array(*map(F.lit, starts)), lambda x: x <= F.col("size"))) - 1
    means = {r["k"]: r["mean"] for r in nodes.groupBy(number.alias("k")).agg(F.avg("size").alias("mean")).collect()}

    def texts_of(some: DataFrame) -> DataFrame:
        """(node, text) of the nodes in ``some`` (node, doc_id, digest)."""
        return docs.join(checked_broadcast(some), ["doc_id", "digest"]).select("node", "text").dropDuplicates(["node"])

    frequent = frequent_shingles(docs, n)
    indexed = saved(index(texts_of(nodes.select("node", "doc_id", "digest")), n, num, den, means, frequent), "index")
    same = Window.partitionBy("key")
    hub = (indexed.select("node", F.explode("keys").alias("key"))
           .select("key", "node", F.min("node").over(same).alias("hub"), F.max("node").over(same).alias("far")))
    behind = indexed.select("node", F.explode("behind").alias("b")).select("node", "b.key", "b.rep")
    led = saved(hub.where((F.col("hub") != F.col("far"))).select("key", "node", "hub"), "led")
    above = behind.join(led.select("key", F.col("node").alias("rep"), "hub"), ["key", "rep"], "left")
    tried = saved(led.where("node <> hub").select("hub", "node").unionByName(
        above.select(F.coalesce("hub", "rep").alias("hub"), "node")).where("hub <> node").distinct(), "tried")

    met = tried.select("node").union(tried.select("hub")).distinct()
    near = saved(nodes.join(met, "node", "left_semi").select("node", "doc_id", "digest"), "near")
    sets = saved(sets_of(texts_of(near), n), "sets")
    check = partial(verified, sets=sets, num=num, den=den)
    links = saved(check(tried.select(F.col("hub").alias("a"), F.col("node").alias("b"))), "links")
    comp = components(links)
    sketched = saved(tried.join(sets.select("node", "size", "sketch"), "node").select("hub", "node", "size", "sketch"), "sketched")
    for spanning in (True, False):
        grouped = (sketched.join(comp, "node", "left").select("hub", "node", F.coalesce("comp", "node").alias("comp"), "size", "sketch"))
        more = saved(check(compared_in_tiles(grouped, num, den, spanning=spanning)), "more")
        if not more.isEmpty():
            links = links.unionByName(more)
            comp = components(links)
    return sizes, nodes.join(comp, "node", "left").select("h1", "h2", "doc_id", F.coalesce("comp", "node").alias("comp"))


def _digested(docs: DataFrame) -> DataFrame:
    return columns_only(docs, doc_id="long", text="string").select("doc_id", "text", F.xxhash64("text").alias("digest"))


def similarity_components(docs: DataFrame, n: int = 4, percent: int = 85) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of ``docs`` (doc_id, text).

    Links documents with 100 * |A and B| >= percent * |A or B| on sets of word n-grams.
    """
    sizes, placed = _components(_digested(docs), n, percent, 100)
    placed = saved(placed, "placed")
    least = placed.groupBy("comp").agg(F.min("doc_id").alias("component_id"))
    named = placed.join(least, "comp").select("h1", "h2", "component_id")
    return sizes.join(named, ["h1", "h2"], "left").select(
        "doc_id", "n_shingles", F.when((F.col("n_shingles") == 0) | F.col("doc_id").isNull(), F.col("doc_id"))
        .otherwise(F.col("component_id")).alias("component_id"))


def one_of_each(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs``, all columns, with one document kept of every group of linked documents.

    Keeps the smallest id of a component (of its texts there the one with the smallest digest, and one row of
    those that repeat both), every row without words and every row with a null id.
    """
    sizes, placed = _components(_digested(docs), n, percent, 100)
    first = (sizes.where("n_shingles > 0 and doc_id is not null").join(placed.select("h1", "h2", "comp"), ["h1", "h2"])
             .groupBy("comp", "doc_id", "digest").agg(F.count("*").alias("n")).groupBy("comp").agg(F.min(F.struct("doc_id", "digest", "n")).alias("k")))
    found = saved(first.select(F.col("k.doc_id").alias("kept_id"), F.col("k.digest").alias("kept"), F.col("k.n").alias("n"))
                  .unionByName(sizes.where("n_shingles = 0 and doc_id is not null").select("doc_id", "digest").distinct()
                               .select(F.col("doc_id").alias("kept_id"), F.col("digest").alias("kept"), F.lit(1).cast("long").alias("n"))), "kept")
    once, more = found.where("n = 1"), found.where("n > 1")
    here = lambda k: (docs["doc_id"].cast("long") == k["kept_id"]) & (F.xxhash64(docs["text"].cast("string")) == k["kept"])
    out = docs.join(checked_broadcast(once), here(once), "left_semi").unionByName(docs.where(F.col("doc_id").isNull()))
    if not more.isEmpty():
        out = out.unionByName(docs.join(checked_broadcast(more), here(more), "left_semi").dropDuplicates(["doc_id", "text"]))
    return out
