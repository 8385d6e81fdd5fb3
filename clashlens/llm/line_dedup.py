"""Line deduplication by content-defined line chunks (operator 10).

A text is a sequence of lines; lines without a word only stand between others. A rolling hash over the
hashes of two neighbouring lines with words decides whether the place between them is a boundary: the more
text the two lines hold, the likelier, and always from CHOOSE characters on. Boundaries depend on those two
lines alone, so a passage has the same ones wherever it stands, whatever comes before and after it.

The chunk of a boundary begins with its two lines. Chunks found anywhere else in the table are seeds; from
a seed the chunk goes on line by line in both directions, through places that are no boundaries up to the
next one that is (which is a seed of its own), as long as another text goes on in the same way. Every step
compares the bytes of its two lines, and a hash of all steps since the seed. Chunks are removed with all
their lines but for the first occurrence (smallest id, then place). A chunk has two lines with words at
least: a single line that is repeated between other neighbours stays.

Defined results: lines end at "\\n"; a text keeps its other lines in order, joined by "\\n". A null text
stays null, an empty one empty. Documents that repeat an id are told apart by their text; rows that repeat
both get equal results (each keeps what the first occurrence keeps). Null ids come before all others. Lines
without a word go only between two lines of one chunk. Of every line with words that is removed an equal one
stays somewhere before it; the lines of a first occurrence can go with a chunk beside it that stands
elsewhere. Other columns, whatever their names, aren't read. Texts are read whole.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clashlens.llm.common import as_batch, blocks, columns_only, mix, saved

CHOOSE = 150        # characters of two lines between which there is always a boundary
NO_ID = -(1 << 63)


class Lines:
    """The lines of a text, those with a word, and the places between the latter."""

    def __init__(self, text: str | None):
        self.all = text.split("\n") if text else []
        self.at = [i for i, x in enumerate(self.all) if x and not x.isspace()]
        h = np.fromiter((xxhash.xxh3_64_intdigest(self.all[i]) for i in self.at), np.uint64, len(self.at))
        size = np.fromiter((len(self.all[i]) for i in self.at), np.int64, len(self.at))
        #: rolling hash over two lines, by place; blank lines between them count
        gap = np.diff(np.asarray(self.at, np.int64)).astype(np.uint64)
        self.hash = mix(mix(h[:-1], 1) + mix(h[1:], 2) + gap) if len(self.at) > 1 else np.zeros(0, np.uint64)
        text_there = np.minimum(size[:-1] + size[1:], CHOOSE) if len(self.at) > 1 else np.zeros(0, np.int64)
        self.boundary = (mix(self.hash, 3) >> np.uint64(40)).astype(np.int64) * CHOOSE < text_there << 24

    def part(self, k: int) -> str:
        """The text from the place's first line to its second one."""
        return "\n".join(self.all[self.at[k]:self.at[k + 1] + 1])

    def steps(self, seeds: list[int]):
        """(place, hash) of each step that the chunks of the seeds may go on by, both ways, up to the next boundary."""
        for k in seeds:
            for way in (1, -1):
                h, j = mix(self.hash[k:k + 1], 5 + way), k + way
                while 0 <= j < len(self.hash) and not self.boundary[j]:
                    h = mix(h + self.hash[j:j + 1], 9)
                    yield j, int(h.view(np.int64)[0])
                    j += way

    def without(self, places: set[int]) -> list[str]:
        """The lines but those of the chunks at these places."""
        gone = {i for k in places for i in range(self.at[k], self.at[k + 1] + 1)}
        return [x for i, x in enumerate(self.all) if i not in gone]


def without(text: str | None, places: set[int]) -> tuple[str | None, int]:
    """The text without the chunks at these places, and the number of lines removed."""
    if not text or not places:
        return text, 0
    lines = Lines(text)
    kept = lines.without(places)
    return "\n".join(kept), len(lines.all) - len(kept)


def _keyed(docs: DataFrame) -> DataFrame:
    return columns_only(docs, doc_id="long", text="string").select(
        "doc_id", F.coalesce("doc_id", F.lit(NO_ID)).alias("id"), F.xxhash64("text").alias("digest"), "text")


def _seed_rows(keyed: DataFrame) -> DataFrame:
    """(id, digest, place, h) of all boundaries."""
    schema = pa.schema([("id", pa.int64()), ("digest", pa.int64()), ("place", pa.int32()), ("h", pa.int64())])

    def run(batches):
        for b in blocks(batches):
            got = [Lines(t) if t and "\n" in t else None for t in b.column(2).to_pylist()]
            some = [i for i, g in enumerate(got) if g is not None and g.boundary.any()]
            if some:
                where = [np.flatnonzero(got[i].boundary) for i in some]
                row = np.repeat(some, [len(w) for w in where])
                yield as_batch(schema, b.column(0).take(pa.array(row)), b.column(1).take(pa.array(row)), np.concatenate(where).astype(np.int32),
                               np.concatenate([got[i].hash[w] for i, w in zip(some, where)]).view(np.int64))

    return keyed.select("id", "digest", "text").mapInArrow(run, "id long, digest long, place int, h long")


def _part_rows(texts: DataFrame) -> DataFrame:
    """(id, digest, place, h, part): of every row (id, digest, text, seeds) the seeds and their steps, with the bytes of their two lines."""
    schema = pa.schema([("id", pa.int64()), ("digest", pa.int64()), ("place", pa.int32()), ("h", pa.int64()), ("part", pa.string())])

    def run(batches):
        for b in blocks(batches):
            rows, size = [], 0
            for i, d, t, seeds in zip(*(b.column(k).to_pylist() for k in range(4))):
                lines = Lines(t)
                h = lines.hash.view(np.int64).tolist()
                for k, x in (*((k, h[k]) for k in seeds), *lines.steps(seeds)):
                    rows.append((i, d, k, x, lines.part(k)))
                    size += len(rows[-1][-1])
                    if size > 1 << 20:
                        yield as_batch(schema, *zip(*rows))
                        rows, size = [], 0
            if rows:
                yield as_batch(schema, *zip(*rows))

    return texts.select("id", "digest", "text", "seeds").mapInArrow(run, "id long, digest long, place int, h long, part string")


def repeated_chunks(docs: DataFrame) -> DataFrame:
    """(id, digest, place): the chunks to remove, seeds and steps, by the place of their two lines.

    Hashes alone are shuffled to find the seeds; only the texts with one of those are cut again, and equal
    bytes decide.
    """
    keyed = _keyed(docs)
    slim = saved(_seed_rows(keyed), "chunks")
    again = saved(slim.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h"), "again")
    where = saved(slim.join(again, "h", "left_semi").groupBy("id", "digest").agg(F.collect_set("place").alias("seeds")), "where")
    # joined by a merge at every size: how many texts hold a repeated chunk isn't bounded
    texts = keyed.join(where.hint("merge"), ["id", "digest"]).dropDuplicates(["id", "digest"])
    parts = saved(_part_rows(texts), "parts")
    # written, so that the join below has exchanges of its own, which a chunk with very many places can split
    first = saved(parts.groupBy("h", "part").agg(F.min(F.struct("id", "digest", "place")).alias("first")), "first")
    return parts.join(first, ["h", "part"]).where(F.struct("id", "digest", "place") != F.col("first")).select("id", "digest", "place")


def deduplicated(docs: DataFrame) -> DataFrame:
    """(doc_id, text, n_lines, n_removed) of every row of ``docs``."""
    found = saved(repeated_chunks(docs).groupBy("id", "digest").agg(F.collect_set("place").alias("places")), "places")
    both = _keyed(docs).join(found.hint("merge"), ["id", "digest"], "left").select("doc_id", "text", "places")
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("n_lines", pa.int64()), ("n_removed", pa.int64())])

    def run(batches):
        for b in blocks(batches):
            texts = b.column(1).to_pylist()
            got = [without(t, set(d or ())) for t, d in zip(texts, b.column(2).to_pylist())]
            yield as_batch(schema, b.column(0), [g[0] for g in got], [t.count("\n") + 1 if t else 0 for t in texts], [g[1] for g in got])

    return both.mapInArrow(run, "doc_id long, text string, n_lines long, n_removed long")
