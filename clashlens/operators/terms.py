"""Term counts of sentences over Arrow batches: the built-in encoder (E-1) where pairs are formed inside a task.

The words are those of ``functions.text.tokens``. Arrow's regular expressions and lower case agree with the JVM's on
the characters of ``SIMPLE``; a sentence with any other character comes with its tokens from the JVM (``odd_tokens``).
"""

from __future__ import annotations

from typing import Iterator, NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from clashlens.config import NEGATION_WORDS
from clashlens.functions import text as tx

# Latin letters and general punctuation, less the one letter whose lower case is two characters long.
SIMPLE = r"[\x{0}-\x{12F}\x{131}-\x{17F}\x{2010}-\x{2027}\x{20AC}]"
BETWEEN_RE = r"[^\p{L}\p{N}]+"


def is_simple(text: Column) -> Column:
    return (F.length(text) == F.octet_length(text)) | text.rlike(rf"\A{SIMPLE}*+\z")


def odd_tokens(sentence: Column) -> Column:
    """The tokens of a sentence that holds a character outside ``SIMPLE``, in one string, else NULL.

    No list: to tell how large a batch is, Spark's Arrow writer goes over all lists that are NULL so far, at every row.
    """
    return F.when(~is_simple(sentence), F.array_join(tx.tokens(sentence), " "))


def odd_lists(sentences: str) -> Column:
    """``odd_tokens`` of an array's sentences, empty if none has any: one look at all of them spares one at each."""
    return F.when(~is_simple(F.concat_ws("", sentences)), F.transform(sentences, odd_tokens)).otherwise(F.array().cast("array<string>"))


def list_items(lists: pa.Array, n: np.ndarray) -> pa.Array:
    """The items of lists of n[k] items, an empty list as n[k] NULLs."""
    there = np.repeat(pc.list_value_length(lists).to_numpy(zero_copy_only=False) > 0, n)
    return pc.list_flatten(lists).take(pa.array(np.cumsum(there) - 1, mask=~there))


class Terms(NamedTuple):
    start: np.ndarray     # of a sentence's terms in code and tf; one more than sentences
    code: np.ndarray      # ascending in each sentence
    tf: np.ndarray
    size: int             # codes are below it
    nsq: np.ndarray
    nd: np.ndarray
    neg: np.ndarray


def _flat(lists) -> tuple[np.ndarray, pa.Array]:
    """(row, value) of the values of a list array."""
    lengths = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    return np.repeat(np.arange(len(lists)), lengths), pc.list_flatten(lists)


def _counted(n: int, row: np.ndarray, word: pa.Array, times: np.ndarray | None = None, neg: np.ndarray | None = None) -> Terms:
    """Terms of n sentences from (row, word), each word as often as it stands there, or as ``times`` says."""
    coded = word.dictionary_encode()
    code, names = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary
    size = max(len(names), 1)
    if times is None:
        key, tf = np.unique(row * size + code, return_counts=True)
    else:
        order = np.argsort(row * size + code, kind="stable")
        key, tf = (row * size + code)[order], times[order]
    of, code, tf = key // size, key % size, tf.astype(np.int64)
    nd = np.bincount(of, minlength=n)
    nsq = np.zeros(n, np.int64)
    np.add.at(nsq, of, tf * tf)
    if neg is None:
        neg = np.zeros(n, bool)
        denies = pc.is_in(names, value_set=pa.array(NEGATION_WORDS)).to_numpy(zero_copy_only=False)
        neg[of[denies[code]]] = True
    return Terms(np.concatenate([[0], np.cumsum(nd)]), code, tf, size, nsq, nd, neg)


def term_counts(sentences: pa.Array, odd: pa.Array) -> Terms:
    """The term counts of a batch's sentences; ``odd`` holds the tokens of those that have them from the JVM."""
    plain = pc.fill_null(pc.if_else(pc.is_null(odd), sentences, pa.scalar("", pa.string())), "")
    row, word = _flat(pc.split_pattern_regex(pc.utf8_lower(plain), BETWEEN_RE))
    row_odd, word_odd = _flat(pc.split_pattern(odd.cast(pa.string()), " "))
    row, word = np.concatenate([row, row_odd]), pa.concat_arrays([word.cast(pa.string()), word_odd])
    real = pc.not_equal(word, "")
    return _counted(len(sentences), row[real.to_numpy(zero_copy_only=False)], word.filter(real))


def term_lists(terms: pa.Array, neg: pa.Array) -> Terms:
    """The same from lists of (token, tf) that are there already."""
    row, term = _flat(terms)
    return _counted(len(terms), row, term.field("token"), term.field("tf").to_numpy(zero_copy_only=False),
                    pc.fill_null(neg, False).to_numpy(zero_copy_only=False))


def cosines(dot: np.ndarray, nsq_a: np.ndarray, nsq_b: np.ndarray) -> np.ndarray:
    den = (nsq_a * nsq_b).astype(np.float64)
    return np.where(den > 0, dot / np.sqrt(np.where(den > 0, den, 1.0)), 0.0)


def jaccards(shared: np.ndarray, nd_a: np.ndarray, nd_b: np.ndarray) -> np.ndarray:
    den = nd_a + nd_b - shared
    return np.where(den > 0, shared / np.where(den > 0, den, 1), 0.0)


def aligned_dots(t: Terms, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(dot, shared) of the sentences a[k] and b[k]: each term of a looked up among those of b."""
    n = t.nd[a]
    pair = np.repeat(np.arange(len(a)), n)
    at = np.arange(len(pair)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(t.start[a], n)
    keys = np.repeat(np.arange(len(t.nd)), t.nd) * t.size + t.code
    want = b[pair] * t.size + t.code[at]
    found = np.minimum(np.searchsorted(keys, want), max(len(keys) - 1, 0))
    same = keys[found] == want if len(keys) else np.zeros(0, bool)
    pair, at, found = pair[same], at[same], found[same]
    dot = np.zeros(len(a), np.int64)
    np.add.at(dot, pair, t.tf[at] * t.tf[found])
    return dot, np.bincount(pair, minlength=len(a))


CELLS = 1 << 22         # of a product of two blocks' terms at a time
PAIRS_OUT = 200_000     # pairs of links that leave at a time, but those of a whole link at least


def _spread(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """start[k], start[k] + 1, ... n[k] times for each k, one after another."""
    return np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(start, n)


def tile_links(t: Terms, code: np.ndarray, ident: np.ndarray, tile: np.ndarray, in_low: np.ndarray, one: np.ndarray,
               threshold: float, with_pairs: bool = True) -> Iterator[dict]:
    """The pairs at the threshold among the sentences of tiles (numbered, ascending): i in the lower block and j in the
    upper one, or i < j if a tile's blocks are ``one``. ``code`` says which terms a sentence has. Sentences of one code
    are compared once, and their pairs are one link: its tile, the codes ``a`` of i and ``b`` of j, the number ``n`` of
    its pairs, and ``pairs`` of all links one after another, i in the upper and j in the lower 32 bits. Without
    ``with_pairs`` pairs of both orders are one link, whichever sentence comes first."""
    key = (tile.astype(np.int64) << 32) | ident
    if not (key[1:] > key[:-1]).all():
        order = np.argsort(key, kind="stable")
        key, code, ident, tile, in_low = (v[order] for v in (key, code, ident, tile, in_low))
        copied = np.unique(tile[1:][key[1:] == key[:-1]])
        for k in copied:
            s = slice(*np.searchsorted(tile, [k, k + 1]))
            yield _copied_links(t, code[s], ident[s], in_low[s], one[k], threshold, k)
        rest = ~np.isin(tile, copied)
        code, ident, tile, in_low = (v[rest] for v in (code, ident, tile, in_low))
    # a row for each code of a block, and the places it stands at
    rows, row_of, m = np.unique((tile * 2 + ~in_low) * len(t.nd) + code, return_inverse=True, return_counts=True)
    side, code = rows // len(t.nd), rows % len(t.nd)
    places, first = ident[np.argsort(row_of, kind="stable")].astype(np.int64), np.cumsum(m) - m
    a, b, dot = _close(t, code, side, one, threshold)
    itself = np.flatnonzero((m > 1) & one[side // 2] & (t.nsq[code] > 0))
    a, b, dot = np.concatenate([a, itself]), np.concatenate([b, itself]), np.concatenate([dot, t.nsq[code[itself]]])
    near = np.flatnonzero(cosines(dot, t.nsq[code[a]], t.nsq[code[b]]) >= threshold)
    near = near[np.argsort(side[a[near]], kind="stable")]       # the links of a tile side by side
    a, b, dot = a[near], b[near], dot[near]
    shared, often = dot.copy(), (t.nsq > t.nd)[code]
    often = np.flatnonzero(often[a] | often[b])         # where no word stands twice, dot counts the shared ones
    shared[often] = aligned_dots(t, code[a[often]], code[b[often]])[1]
    cells = m[a] * m[b]
    part = np.cumsum(cells) // PAIRS_OUT
    for s in np.split(np.arange(len(a)), np.flatnonzero(part[1:] != part[:-1]) + 1):
        if not len(s):
            continue
        if not with_pairs:
            n = np.where(a[s] == b[s], cells[s] - m[a[s]], 2 * cells[s]) // 2
            yield _measured(t, side[a[s]] // 2, code[a[s]], code[b[s]], n, None, dot[s], shared[s])
            continue
        of = np.repeat(np.arange(len(s)), cells[s])
        at = _spread(np.zeros(len(s), np.int64), cells[s])
        i, j = places[first[a[s]][of] + at // m[b[s]][of]], places[first[b[s]][of] + at % m[b[s]][of]]
        keep = (a[s] != b[s])[of] | (i < j)
        of, i, j = of[keep], i[keep], j[keep]
        link = of * 2 + (i > j)
        order = np.argsort(link, kind="stable")
        n = np.bincount(link, minlength=2 * len(s))
        some = np.flatnonzero(n)
        k, turned = s[some // 2], some % 2 == 1
        yield _measured(t, side[a[k]] // 2, *(code[np.where(turned, *v)] for v in ((b[k], a[k]), (a[k], b[k]))), n[some],
                        ((np.minimum(i, j) << 32) | np.maximum(i, j))[order], dot[k], shared[k])


def _measured(t: Terms, tile, a, b, n, pairs, dot, shared) -> dict:
    return _with_cosines({"tile": tile, "a": a, "b": b, "n": n, "pairs": pairs, "dot": dot, "shared": shared, "nsq_i": t.nsq[a], "nsq_j": t.nsq[b],
                          "nd_i": t.nd[a], "nd_j": t.nd[b], "neg_i": t.neg[a], "neg_j": t.neg[b]})


def _with_cosines(out: dict) -> dict:
    return {**out, "cos": cosines(out["dot"], out["nsq_i"], out["nsq_j"]), "jac": jaccards(out["shared"], out["nd_i"], out["nd_j"])}


def _close(t: Terms, code: np.ndarray, side: np.ndarray, one: np.ndarray, threshold: float):
    """(a, b, dot) of the rows a < b of a tile, of its two sides if it has them, whose cosine may be at the threshold: a product
    of the counts of the words that stand in two of its rows."""
    n = t.nd[code]
    at, row = _spread(t.start[code], n), np.repeat(np.arange(len(code)), n)
    key = (side[row] // 2) * t.size + t.code[at]
    order = np.argsort(key, kind="stable")
    key = key[order]
    new = np.concatenate([[True], key[1:] != key[:-1]])[:len(key)]
    word = np.cumsum(new) - 1
    twice = np.bincount(word) > 1 if len(word) else np.zeros(0, bool)
    column = np.cumsum(twice) - 1
    kept = twice[word]
    row, column, tf, of = row[order][kept], column[word[kept]], t.tf[at[order]][kept], key[kept] // t.size
    kind = np.float32 if t.nsq[code].max(initial=0) < 1 << 24 else np.float64     # sums of counts are exact in either
    least = np.sqrt(t.nsq[code] * (threshold * 0.9999)).astype(kind)        # a little low: the exact integers decide
    found = [(np.zeros(0, np.int64),) * 3]
    tiles = np.unique(of)
    ends = np.searchsorted(of, tiles, "right")
    sides = np.searchsorted(side, [2 * tiles, 2 * tiles + 1, 2 * tiles + 2])
    for k, s, e, r0, r1, r2 in zip(tiles, [0, *ends[:-1]], ends, *sides):
        c0 = column[s]
        x = np.zeros((r2 - r0, column[e - 1] - c0 + 1), kind)
        x[row[s:e] - r0, column[s:e] - c0] = tf[s:e]
        end, start = (r2, r0) if one[k] else (r1, r1)
        y, step = x[start - r0:].T, max(1, CELLS // max(r2 - start, 1))
        for begin in range(r0, end, step):
            grid = x[begin - r0:min(begin + step, end) - r0] @ y
            a, b = np.nonzero(grid >= np.maximum(least[begin:min(begin + step, end), None] * least[start:r2], kind(0.5)))
            dot, a, b = grid[a, b], a + begin, b + start
            found.append((a[a < b], b[a < b], dot[a < b].astype(np.int64)))
    return (np.concatenate(v) for v in zip(*found))


def _matrix(t: Terms, rows: np.ndarray, names: np.ndarray, kind) -> np.ndarray:
    """The term counts of some sentences, a column for each of ``names`` (codes, ascending)."""
    n = t.nd[rows]
    at = _spread(t.start[rows], n)
    x = np.zeros((len(rows), len(names)), kind)
    x[np.repeat(np.arange(len(rows)), n), np.searchsorted(names, t.code[at])] = t.tf[at]
    return x


def _copied_links(t: Terms, code: np.ndarray, ident: np.ndarray, in_low: np.ndarray, one: bool, threshold: float, tile: int) -> dict:
    """The links of a tile in which an ident stands more than once (copies of a document): they add up, as in a join on
    the words, and each pair is a link of its own."""
    low, high = (np.arange(len(code)),) * 2 if one else (np.flatnonzero(in_low), np.flatnonzero(~in_low))
    names = np.unique(t.code[_spread(t.start[code], t.nd[code])])
    kind = np.float32 if t.nsq[code].max(initial=0) < 1 << 24 else np.float64
    x, y = _matrix(t, code[low], names, kind), _matrix(t, code[high], names, kind)
    step, found = max(1, CELLS // max(len(high), 1)), [(np.zeros(0, np.int64),) * 4]
    for begin in range(0, len(low), step):
        part = low[begin:begin + step]
        grid = x[begin:begin + step] @ y.T
        a, b = np.nonzero(grid)
        keep = ident[part[a]] < ident[high[b]]
        a, b = a[keep], b[keep]
        shared = ((x[begin:begin + step] > 0).astype(kind) @ (y > 0).astype(kind).T)[a, b]
        found.append((part[a], high[b], grid[a, b].astype(np.int64), shared.astype(np.int64)))
    ra, rb, dot, shared = (np.concatenate(v) for v in zip(*found))
    order = np.lexsort((ident[rb], ident[ra]))
    ra, rb = ra[order], rb[order]
    pairs = (ident[ra].astype(np.int64) << 32) | ident[rb]
    new = np.flatnonzero(np.concatenate([[True], pairs[1:] != pairs[:-1]])[:len(pairs)])
    ca, cb, many = code[ra], code[rb], len(pairs) > 0
    summed = {"dot": dot[order], "shared": shared[order]}
    sides = {"nsq_i": t.nsq[ca], "nsq_j": t.nsq[cb], "nd_i": t.nd[ca], "nd_j": t.nd[cb], "neg_i": t.neg[ca], "neg_j": t.neg[cb]}
    out = _with_cosines({"tile": np.full(len(new), tile), "a": ca[new], "b": cb[new], "n": np.ones(len(new), np.int64), "pairs": pairs[new],
                         **{k: np.add.reduceat(v, new) if many else v for k, v in summed.items()},
                         **{k: np.maximum.reduceat(v, new) if many else v for k, v in sides.items()}})
    keep = out["cos"] >= threshold
    return {k: v[keep] for k, v in out.items()}
