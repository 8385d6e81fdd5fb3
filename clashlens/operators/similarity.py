"""Similarity operators (P-2, E-2, E-4, E-5).

Two exact plans for "all pairs (i < j) of a group whose cosine is at least t":

* ``token_candidates``, ``sentence_candidates`` — sparse term vectors. A group's items are cut into blocks
  in their order; each pair of blocks is a tile (lo, hi) of its own, dealt by (group, lo, hi), and one product
  of its term counts. Counts, dot products and norms are exact integers, so ``cos >= t`` is decided identically
  by any engine. Equal sentences are one in a tile: a link, of two different sentences or one with itself, leaves
  it once with its pairs (``sentence_links``), and only those at the threshold do.
* ``dense_candidates`` — dense vectors. Each group is cut into blocks of ``block_rows`` vectors by a
  hash of the id; a vector is copied to every tile (lo, hi) its block belongs to, and each tile is one
  NumPy product of at most ``2 * block_rows`` vectors. No task ever holds a whole group, and only
  pairs at or above the threshold leave the tile.

``aligned_cosine`` scores pairs that are already side by side in one row; it needs no join at all.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from clashlens.operators import terms
from clashlens.operators.terms import aligned_dots, cosines, jaccards, list_items, odd_lists, odd_tokens, term_counts, term_lists, tile_links

cloudpickle.register_pickle_by_value(terms)     # a worker may run without this package


def cosine_from_counts(dot: Column, nsq_a: Column, nsq_b: Column) -> Column:
    """dot / sqrt(|a|^2 |b|^2) with integer inputs; 0 when either side has no token."""
    den = (nsq_a * nsq_b).cast("double")
    return F.when(den > 0, dot.cast("double") / F.sqrt(den)).otherwise(F.lit(0.0))


def jaccard_from_counts(shared: Column, nd_a: Column, nd_b: Column) -> Column:
    den = nd_a + nd_b - shared
    return F.when(den > 0, shared.cast("double") / den.cast("double")).otherwise(F.lit(0.0))


def token_candidates(vectors: DataFrame, threshold: float, group: str = "doc_id", ident: str = "idx",
                     block_rows: int = 256, total: str = "total_sentences") -> DataFrame:
    """(group, i, j, dot, shared, nsq_i, nsq_j, nd_i, nd_j, neg_i, neg_j, cos, jac) for cos >= threshold.

    ``vectors`` holds one row per item with ``terms, neg`` (see ``sentence_vectors``), ``ident`` counting
    from 0 in its group, and the group's item count as ``total`` (counted here if it is missing).
    Items are cut into blocks of ``block_rows``; an item goes to every pair of blocks that its own
    block is part of, so no tile holds more than two blocks, however long the document is.
    """
    _positive(threshold)
    if total not in vectors.columns:
        vectors = vectors.join(vectors.groupBy(group).agg((F.max(ident) + 1).alias(total)), group)
    own = F.floor(F.col(ident) / block_rows).cast("int")
    tiles = (vectors.select(group, F.array(ident).alias("_i"), F.array("terms").alias("_terms"), F.array("neg").alias("_neg"), own.alias("_b"),
                            F.explode(F.sequence(F.lit(0), _last_block(F.col(total), block_rows))).alias("_k"))
             .select(group, F.least("_b", "_k").alias("_lo"), F.greatest("_b", "_k").alias("_hi"), "_i", "_terms", "_neg"))
    links = _tile_links(tiles, vectors.schema[group], threshold, group, block_rows, ("_terms", "_neg"))
    return pairs_of(links, vectors.schema[ident].dataType)


def sentence_candidates(arrays: DataFrame, threshold: float, group: str = "doc_id", block_rows: int = 256,
                        sents: str = "sents", total: str = "total_sentences") -> DataFrame:
    """The same pairs from rows of a document's sentences."""
    return pairs_of(sentence_links(arrays, threshold, group, block_rows, sents, total))


def sentence_links(arrays: DataFrame, threshold: float, group: str = "doc_id", block_rows: int = 256, sents: str = "sents",
                   total: str = "total_sentences", with_pairs: bool = True, with_texts: bool = False) -> DataFrame:
    """(group, n, [pairs], [sentence1, sentence2], dot, ..., jac): a tile's sentences of the same text are one, and ``n`` pairs
    of places (i, j) are one link; ``pairs`` holds them for ``pairs_of``, the sentences are those of i and of j.

    The plain text moves, and a tile's task finds the words. A document of one block is one row; a longer one goes in
    pairs of blocks to as many rows. In a document that stands more than once a link is one pair, without its sentences.
    """
    _positive(threshold)
    block = lambda k: F.slice(F.col(sents), F.col(k) * block_rows + 1, F.lit(block_rows))
    places = lambda k: F.sequence(F.col(k) * block_rows, F.least(F.col(k) * block_rows + block_rows, F.col(total)) - 1)
    both = lambda of: F.when(F.col("_lo") == F.col("_hi"), of("_lo")).otherwise(F.concat(of("_lo"), of("_hi")))
    # outer generators and a filter on what they give: plain ones (or a filter on the count) make Catalyst split a second time
    last = _last_block(F.col(total), block_rows)
    lows = F.when(F.col(total) > 1, F.sequence(F.lit(0), last))
    tiles = (arrays.select(group, sents, total, F.explode_outer(lows).alias("_lo")).where(F.col("_lo").isNotNull())
             .select(group, sents, total, "_lo", F.explode_outer(F.sequence(F.col("_lo"), last)).alias("_hi"))
             .select(group, "_lo", "_hi", both(places).alias("_i"), both(block).alias("_sents")))
    return _tile_links(tiles, arrays.schema[group], threshold, group, block_rows, ("_sents", "_odd"), with_pairs, with_texts)


def pairs_of(links: DataFrame, ident: T.DataType = T.IntegerType()) -> DataFrame:
    """A row (group, i, j, ...) for each pair of the links."""
    rest = [c for c in links.columns[1:] if c not in ("n", "pairs")]
    rows = links.select(links.columns[0], *rest, F.explode("pairs").alias("_p"))
    return rows.select(links.columns[0], F.shiftright("_p", 32).cast(ident).alias("i"),
                       F.col("_p").bitwiseAND(F.lit(0xFFFFFFFF)).cast(ident).alias("j"), *rest)


def _positive(threshold: float) -> None:
    if not threshold > 0:
        raise ValueError("the token plan only forms pairs that share a token; threshold must be > 0")


def _last_block(total: Column, block_rows: int) -> Column:
    return F.floor(F.greatest(total - 1, F.lit(0)) / block_rows).cast("int")


TILE_ITEMS = 50_000     # items whose terms are counted at a time, but a whole tile at least


def _tile_links(tiles: DataFrame, group_field: T.StructField, threshold: float, group: str, block_rows: int,
                of: tuple[str, str], with_pairs: bool = True, with_texts: bool = False) -> DataFrame:
    """Links of tile rows (group, _lo, _hi, _i, and the columns ``of``). Rows of one tile are brought together and sorted,
    so that they are neighbours; each tile is one product of its sentences' terms."""
    keys = (group, "_lo", "_hi")
    rows = tiles.where(F.col(group).isNotNull()).repartition(*keys).sortWithinPartitions(*keys)
    if of[1] == "_odd":
        rows = rows.withColumn("_odd", odd_lists("_sents"))
    long, flag, real = T.LongType(), T.BooleanType(), T.DoubleType()
    schema = T.StructType([T.StructField(group, group_field.dataType), T.StructField("n", long),
                           *([T.StructField("pairs", T.ArrayType(long, False))] if with_pairs else []),
                           *([T.StructField(c, T.StringType()) for c in ("sentence1", "sentence2")] if with_texts else []),
                           *[T.StructField(c, long) for c in ("dot", "shared", "nsq_i", "nsq_j")],
                           *[T.StructField(c, T.IntegerType()) for c in ("nd_i", "nd_j")], *[T.StructField(c, flag) for c in ("neg_i", "neg_j")],
                           *[T.StructField(c, real) for c in ("cos", "jac")]])
    return rows.select(*keys, "_i", *of).mapInArrow(_links_in_tiles(threshold, block_rows, keys, of, to_arrow_schema(schema)), schema)


def _links_in_tiles(threshold: float, block_rows: int, keys, of, schema: pa.Schema):
    def starts(t: pa.Table) -> np.ndarray:
        """Where the rows of a next tile begin."""
        new = np.zeros(max(len(t) - 1, 0), bool)
        for k in keys:
            v = t[k].combine_chunks()
            new |= pc.fill_null(pc.not_equal(v[1:], v[:-1]), True).to_numpy(zero_copy_only=False)
        return np.concatenate([[0], np.flatnonzero(new) + 1])

    def counted(t: pa.Table, n: np.ndarray):
        """(code, names, terms): what each sentence's terms stand under, and the texts of those codes where there are texts."""
        first, second = (list_items(t[c].combine_chunks(), n) for c in of)
        if of[1] != "_odd":
            return np.arange(len(first)), None, term_lists(first, second)
        coded = first.cast(pa.string()).dictionary_encode(null_encoding="encode")
        code, names = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary
        where = np.zeros(len(names), np.int64)
        where[code] = np.arange(len(code))
        return code, names, term_counts(names, second.take(pa.array(where)))

    def links(t: pa.Table, begin: np.ndarray):
        places = t["_i"].combine_chunks()
        n = pc.list_value_length(places).to_numpy(zero_copy_only=False)
        ident = pc.list_flatten(places).to_numpy(zero_copy_only=False)
        code, names, found = counted(t, n)
        lows, highs = (t[k].combine_chunks().to_numpy(zero_copy_only=False) for k in keys[1:])
        in_low = ident // block_rows == np.repeat(lows, n)
        tile = np.repeat(np.repeat(np.arange(len(begin)), np.diff([*begin, len(t)])), n)
        for p in tile_links(found, code, ident, tile, in_low, (lows == highs)[begin], threshold, "pairs" in schema.names):
            yield _batch(t, begin, p, names)

    def _batch(t: pa.Table, begin: np.ndarray, p: dict, names) -> pa.RecordBatch:
        cols = {k: pa.array(v) for k, v in p.items() if k in schema.names and k != "pairs"}
        cols[keys[0]] = t[keys[0]].combine_chunks().take(pa.array(begin[p["tile"]]))
        if "pairs" in schema.names:
            cols["pairs"] = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(p["n"])]).astype(np.int32)), pa.array(p["pairs"]))
        for c, k in (("sentence1", "a"), ("sentence2", "b")):
            if c in schema.names:
                cols[c] = names.take(pa.array(p[k]))
        return pa.RecordBatch.from_arrays([cols[f.name].cast(f.type) for f in schema], schema=schema)

    def run(batches):
        rest = None
        for batch in batches:
            t = pa.Table.from_batches([batch])
            t = t if rest is None else pa.concat_tables([rest, t])
            begin = starts(t)
            yield from in_parts(t.slice(0, begin[-1]), begin[:-1])
            rest = t.slice(begin[-1])       # its tile may go on in the next batch
        if rest is not None and len(rest):
            yield from in_parts(rest, np.zeros(1, np.int64))

    def in_parts(t: pa.Table, begin: np.ndarray):
        if not len(begin):
            return
        edge = np.concatenate([[0], np.cumsum(pc.list_value_length(t["_i"].combine_chunks()).to_numpy(zero_copy_only=False))])
        part = edge[begin] // TILE_ITEMS
        cuts = np.concatenate([[0], np.flatnonzero(part[1:] != part[:-1]) + 1, [len(begin)]])
        for a, b in zip(cuts[:-1], cuts[1:]):
            last = begin[b] if b < len(begin) else len(t)
            yield from links(t.slice(begin[a], last - begin[a]), begin[a:b] - begin[a])

    return run


def aligned_features(pairs: DataFrame, s1: str = "sentence1", s2: str = "sentence2") -> DataFrame:
    """Adds cos, jac, neg (negation on exactly one side) for two sentences held in the same row.

    Aligned pairs need no join: a pass over Arrow batches counts the words of each distinct sentence of a
    batch once (a sentence is often the second of one pair and the first of the next) and looks the words of
    the first sentences up among those of the second ones. A NULL sentence has no words, and no ``neg``.
    """
    out = T.StructType([*pairs.schema.fields, T.StructField("cos", T.DoubleType()), T.StructField("jac", T.DoubleType()),
                        T.StructField("neg", T.BooleanType())])
    kept = pairs.columns

    def run(batches):
        for batch in batches:
            at = lambda c: batch.column(batch.schema.get_field_index(c))
            n = batch.num_rows
            if not n:
                continue
            both = pa.concat_arrays([at(s1).cast(pa.string()), at(s2).cast(pa.string())]).dictionary_encode()
            names, which = both.dictionary, both.indices
            null = which.is_null().to_numpy(zero_copy_only=False)
            which = pc.fill_null(which, len(names)).to_numpy(zero_copy_only=False).astype(np.int64)     # NULL: one more, without words
            where = np.zeros(len(names) + 1, np.int64)
            where[which] = np.arange(2 * n)
            odd = pa.concat_arrays([at("_odd1"), at("_odd2")]).take(pa.array(where))
            t = term_counts(pa.concat_arrays([names, pa.array([""])]), odd)
            a, b = which[:n], which[n:]
            dot, shared = aligned_dots(t, a, b)
            yield pa.RecordBatch.from_arrays(
                [*[at(c) for c in kept], pa.array(cosines(dot, t.nsq[a], t.nsq[b])), pa.array(jaccards(shared, t.nd[a], t.nd[b])),
                 pa.array(t.neg[a] != t.neg[b], mask=null[:n] | null[n:])], names=[*kept, "cos", "jac", "neg"])

    with_odd = pairs.select("*", odd_tokens(F.col(s1)).alias("_odd1"), odd_tokens(F.col(s2)).alias("_odd2"))
    return with_odd.mapInArrow(run, out)


# ---------------------------------------------------------------------------------------------
# dense vectors
# ---------------------------------------------------------------------------------------------

def with_l2_normalized(df: DataFrame, vec: str, out: str = "unit", norm: str = "norm") -> DataFrame:
    """Adds ``norm`` (L2 norm, DOUBLE) and ``out``, the unit-length copy as ARRAY<DOUBLE> (E-2).

    The zero vector stays zero. The norm is its own projection so the per-element division does not
    re-evaluate it.
    """
    d = df.withColumn(out, F.transform(F.col(vec), lambda x: x.cast("double")))
    d = d.withColumn(norm, F.sqrt(F.aggregate(F.col(out), F.lit(0.0), lambda acc, x: acc + x * x)))
    nrm = F.col(norm)
    return d.withColumn(out, F.when(nrm > 0, F.transform(F.col(out), lambda x: x / nrm)).otherwise(F.col(out)))


def _tile_scorer(threshold: float, group: str, ident: str, vector: str):
    def score(pdf: pd.DataFrame) -> pd.DataFrame:
        lo, hi = pdf["_lo"].iat[0], pdf["_hi"].iat[0]
        x = np.stack([np.asarray(v, dtype=np.float64) for v in pdf[vector]])
        norms = np.linalg.norm(x, axis=1)
        x = x / np.where(norms > 0, norms, 1.0)[:, None]
        ids = pdf[ident].to_numpy()
        blk = pdf["_b"].to_numpy()
        if lo == hi:
            s = x @ x.T
            ii, jj = np.nonzero((ids[:, None] < ids[None, :]) & (s >= threshold))
            a_id, b_id, cos = ids[ii], ids[jj], s[ii, jj]
        else:
            ma, mb = blk == lo, blk == hi
            s = x[ma] @ x[mb].T
            ii, jj = np.nonzero(s >= threshold)
            ia, ib = ids[ma][ii], ids[mb][jj]
            a_id, b_id, cos = np.minimum(ia, ib), np.maximum(ia, ib), s[ii, jj]
        return pd.DataFrame({group: np.full(len(cos), pdf[group].iat[0]), "i": a_id, "j": b_id, "cos": cos})
    return score


def _tiles(df: DataFrame, group: str, ident: str, vector: str, block_rows: int) -> DataFrame:
    """(group, ident, vector, _b, _lo, _hi): each vector in every pair of blocks that its own block is part of.

    Group sizes come from a partial-then-final count; their join back is planned by Spark (AQE
    turns it into a broadcast only when the measured size is small, e.g. ten labels).
    """
    sizes = df.groupBy(group).agg(F.count(F.lit(1)).alias("_n"))
    blocks = (df.select(group, ident, vector).join(sizes, group)
              .withColumn("_nb", F.greatest(F.lit(1), F.ceil(F.col("_n") / F.lit(block_rows))).cast("int"))
              .withColumn("_b", F.pmod(F.xxhash64(F.col(ident)), F.col("_nb")).cast("int")))
    return (blocks.withColumn("_k", F.explode(F.sequence(F.lit(0), F.col("_nb") - 1)))
            .select(group, ident, vector, "_b",
                    F.least("_b", "_k").alias("_lo"), F.greatest("_b", "_k").alias("_hi")))


def _pair_schema(df: DataFrame, group: str, ident: str) -> T.StructType:
    itype = df.schema[ident].dataType
    return T.StructType([T.StructField(group, df.schema[group].dataType), T.StructField("i", itype),
                         T.StructField("j", itype), T.StructField("cos", T.DoubleType())])


def dense_candidates(df: DataFrame, threshold: float, group: str = "label", ident: str = "vec_id",
                     vector: str = "embedding", block_rows: int = 2048) -> DataFrame:
    """(group, i, j, cos) for every pair i < j of one group with cosine >= threshold."""
    return _tiles(df, group, ident, vector, block_rows).groupBy(group, "_lo", "_hi").applyInPandas(
        _tile_scorer(threshold, group, ident, vector), _pair_schema(df, group, ident))


def _band_scorer(threshold: float, group: str, ident: str, vector: str, bands: int, bits: int, seed: int):
    """Pairs of a tile that agree on a band: each bucket of a band is a small product, and a pair is that of its first band."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        one = pdf["_lo"].iat[0] == pdf["_hi"].iat[0]
        x = np.stack([np.asarray(v, dtype=np.float64) for v in pdf[vector]])
        some = x.any(axis=1)                    # zero vectors lie on no side
        x, ids, low = x[some], pdf[ident].to_numpy()[some], (pdf["_b"] == pdf["_lo"]).to_numpy()[some]
        planes = np.random.default_rng(seed).standard_normal((x.shape[1], bands * bits))      # the same in every task
        keys = ((x @ planes > 0).reshape(len(x), bands, bits) @ (1 << np.arange(bits))).astype(np.int64)
        x = x / np.linalg.norm(x, axis=1)[:, None]
        first = np.arange(len(x)) if one else np.flatnonzero(low)
        second = first if one else np.flatnonzero(~low)
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        for band in range(bands if len(first) and len(second) else 0):
            a, b = (s[np.argsort(keys[s, band], kind="stable")] for s in (first, second))
            ka, kb, xa, xb = keys[a, band], keys[b, band], x[a], x[b].T
            names, hits = np.intersect1d(ka, kb), []
            for a0, a1, b0, b1 in zip(*(np.searchsorted(k, names, side) for k in (ka, kb) for side in ("left", "right"))):
                for at in range(a0, a1, PART):
                    s = xa[at:min(at + PART, a1)] @ xb[:, b0:b1]
                    ii, jj = (s >= threshold).nonzero()
                    if len(ii):
                        hits.append((a[ii + at], b[jj + b0], s[ii, jj]))
            if hits:
                p, q, cos = (np.concatenate(c) for c in zip(*hits))
                new = ids[p] < ids[q] if one else np.ones(len(p), bool)
                new[new] = ~(keys[p[new], :band] == keys[q[new], :band]).any(axis=1)
                found.append((p[new], q[new], cos[new]))
        p, q, cos = (np.concatenate(c) for c in zip(*found))
        i, j = ids[p], ids[q]
        return pd.DataFrame({group: np.full(len(cos), pdf[group].iat[0]), "i": np.minimum(i, j), "j": np.maximum(i, j), "cos": cos})
    return run


PART = 1024         # vectors of a bucket that meet the other side's at a time


def lsh_candidates(df: DataFrame, threshold: float, group: str = "label", ident: str = "vec_id",
                   vector: str = "embedding", bands: int = 120, bits: int = 8, seed: int = 42, block_rows: int = 4096) -> DataFrame:
    """P-2 (c), opt-in and approximate: (group, i, j, cos) of the pairs that agree on a band and reach the threshold.

    A band is the sides of ``bits`` random hyperplanes on which a vector lies; two vectors at the angle w agree on one
    with probability (1 - w / pi) ^ bits, and zero vectors have none. Only pairs of a group that agree on a band are
    compared; what is missed is a pair that agrees on no band, with probability (1 - (1 - w / pi) ^ bits) ^ bands: at
    most 5 % of the pairs at a cosine of 0.4 with the defaults, and far fewer above it. Groups are cut into tiles as in
    ``dense_candidates`` and bands looked up inside them, so vectors move once for each block of their group, not once
    for each pair that agrees, and only pairs at the threshold are ever written. Memory per task is bounded by rows.
    """
    some = df.where(F.col(group).isNotNull() & F.col(ident).isNotNull())
    return _tiles(some, group, ident, vector, block_rows).groupBy(group, "_lo", "_hi").applyInPandas(
        _band_scorer(threshold, group, ident, vector, bands, bits, seed), _pair_schema(df, group, ident))
