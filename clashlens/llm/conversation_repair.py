"""Repair of conversation structure (operator 11) by depth-first branch-and-bound.

The turns of a conversation are edited until the initials of their roles read ``(s?(ua)+)?``: a system
turn may open it, then user and assistant alternate and the assistant has the last word. A turn is kept
(K, cost 0), gets the other role (R, 1) or is deleted (D, 2); an empty turn is inserted (I, 5) anywhere.
Blank and duplicate turns must be deleted; a truncated turn that stays costs 5 more. Of the cheapest edits
the one whose letters, the audit, come first in ASCII is wanted.

``solve`` searches a window of turns with an explicit stack. A node is a number of turns dealt with and a
state (nothing yet, after s, after u, after a). The incumbent is the best (cost, audit) so far; a suffix
lower bound (what each turn costs by itself, and half the illegal neighbours among the others) cuts what
cannot beat it, by the audit's prefix where costs tie. Each node's table keeps the best (cost, audit) that
reached a state there and eliminates worse prefixes. An empty stack proves the incumbent. (Of two prefixes
of equal cost at one node neither is the other's beginning, as they differ in inserts then, which cost; so
the smaller prefix stays smaller whatever follows.)

A conversation of one window is solved from its start to its end. Longer ones are cut: every window is
solved from each state to each state, and these tables are joined from left to right. A conversation of
many rows is spread over tasks by ranges of its turns, a table for each, so no task has to hold or work
through a conversation; only its letters, which are part of the result, come together. Texts travel apart
from that and meet their letters in a stream.

Defined results: a row's first fault counts: blank (nothing but the six ASCII blanks), duplicate (role and
text seen earlier in its conversation), truncated (the last other character is not one of ``.!?``). Null
role and text are one space. Rows are taken by turn, null turns first, rows of one turn by the digest of
role and text. A null conversation id is a conversation of its own. A conversation without rows
has zeros, an empty audit and nothing repaired. Roles count by their first character; an empty role has
none and is illegal beside any. Other columns, whatever their names, aren't read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from os.path import commonprefix

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clashlens.llm.common import as_batch, blocks, checked_broadcast, columns_only, saved

BLANKS = " \t\n\x0b\x0c\r"
LEGAL = ("su", "ua", "au")
START, AFTER_S, AFTER_U, AFTER_A = range(4)
STATES = (START, AFTER_S, AFTER_U, AFTER_A)
WHOLE = (START, AFTER_A)                 # states a conversation may end in
NEXT = ((AFTER_U, "user"), (AFTER_U, "user"), (AFTER_A, "assistant"), (AFTER_U, "user"))
RELABEL, DELETE, INSERT, CUT_SHORT = 1, 2, 5, 5
CLEAN, BLANK, DUPLICATE, TRUNCATED = range(4)

WINDOW = 24             # turns of one search
SEGMENT = 512           # rows of a conversation that one table stands for, about


# --- one window ----------------------------------------------------------------------------------

def suffix_bounds(rows: list[tuple[int, str]]) -> list[int]:
    """For each i a cost that rows[i:] need at least, whatever the state before them.

    A blank or duplicate row is deleted; a truncated one is deleted or costs more than that; a row of
    another initial is changed. Of the others, neighbours (once deleted rows are gone) that may not follow
    one another need an edit there, and an edit of cost 1 touches two neighbourhoods at most.
    """
    own = clashes = 0
    after: str | None = None
    out = [0]
    for fault, initial in reversed(rows):
        if fault in (BLANK, DUPLICATE):
            own += DELETE
        elif fault == TRUNCATED:
            own, after = own + DELETE, None
        elif initial not in ("s", "u", "a"):
            own, after = own + RELABEL, None
        else:
            clashes += after is not None and initial + after not in LEGAL
            after = initial
        out.append(own + (clashes + 1) // 2)
    return out[::-1]


def _kept(state: int, initial: str) -> int | None:
    """The state after a row that keeps its role; None if it can't stand there."""
    if initial == "s":
        return AFTER_S if state == START else None
    if initial == "u":
        return AFTER_U if state != AFTER_U else None
    return AFTER_A if initial == "a" and state == AFTER_U else None


def solve(rows: list[tuple[int, str]], entry: int, exits: tuple[int, ...], closing: bool) -> tuple[int, str] | None:
    """The best (cost, audit) that leads from ``entry`` over ``rows`` (fault, initial) to a state of ``exits``.

    ``closing``: turns may be inserted after the last row. None if there is no way.
    """
    bound, end = suffix_bounds(rows), len(rows)
    tables: list[dict[int, tuple[int, str]]] = [{} for _ in range(end + 1)]
    incumbent: tuple[int, str] | None = None
    stack = [(0, entry, 0, "")]
    while stack:
        i, state, cost, audit = stack.pop()
        if incumbent is not None:
            least = cost + bound[i]
            if least > incumbent[0] or (least == incumbent[0] and audit > incumbent[1][:len(audit)]):
                continue
        here = cost, audit
        if tables[i].get(state, (cost + 1, "")) <= here:
            continue
        tables[i][state] = here
        if i == end and state in exits and (incumbent is None or here < incumbent):
            incumbent = here
        children = []
        if i < end:
            fault, initial = rows[i]
            children.append((cost + DELETE + bound[i + 1], "D", i + 1, state, cost + DELETE))
            if fault not in (BLANK, DUPLICATE):
                stays = cost + (CUT_SHORT if fault == TRUNCATED else 0)
                to = _kept(state, initial)
                if to is not None:
                    children.append((stays + bound[i + 1], "K", i + 1, to, stays))
                children.append((stays + RELABEL + bound[i + 1], "R", i + 1, NEXT[state][0], stays + RELABEL))
        if i < end or closing:
            children.append((cost + INSERT + bound[i], "I", i, NEXT[state][0], cost + INSERT))
        for _, letter, j, to, c in sorted(children, reverse=True):      # the most promising one is on top
            stack.append((j, to, c, audit + letter))
    return incumbent


Table = dict[tuple[int, int], tuple[int, str]]


def window_table(rows: list[tuple[int, str]], entries=STATES) -> Table:
    """(entry, exit) -> the best (cost, audit), as far as there is a way."""
    found = {(q, x): solve(rows, q, (x,), False) for q in entries for x in STATES}
    return {k: v for k, v in found.items() if v is not None}


class Joined:
    """The best (cost, audit) to each state, table after table, from one state.

    Letters that all ways have in common are set aside, so what is compared stays short.
    """

    def __init__(self, entry: int):
        self.done: list[str] = []
        self.ways: dict[int, tuple[int, str, str]] = {entry: (0, "", "")}      # cost, letters, states at joints

    def add(self, table: Table) -> None:
        new: dict[int, tuple[int, str, str]] = {}
        for (q, x), (cost, audit) in table.items():
            if q in self.ways:
                c, letters, states = self.ways[q]
                way = c + cost, letters + audit, states + str(q)
                if x not in new or way[:2] < new[x][:2]:
                    new[x] = way
        # a way that another state does better than, whatever follows, goes: what goes on from s goes on
        # from a at the same price, and from the start at 2 less at most (a system turn more to delete)
        if AFTER_A in new:
            a = new[AFTER_A][0]
            new = {q: w for q, w in new.items() if not (q == AFTER_S and w[0] > a or q == START and w[0] > a + DELETE)}
        common = len(commonprefix([w[1] for w in new.values()]))
        if common:
            self.done.append(next(iter(new.values()))[1][:common])
        self.ways = {q: (c, letters[common:], states) for q, (c, letters, states) in new.items()}

    def closed(self) -> tuple[int, str, str]:
        """(cost, audit, states at joints) of the best way that ends here."""
        inserts = {START: 0, AFTER_S: 2, AFTER_U: 1, AFTER_A: 0}
        cost, letters, states = min((c + INSERT * inserts[q], letters + "I" * inserts[q], states) for q, (c, letters, states) in self.ways.items())
        return cost, "".join(self.done) + letters, states

    def table(self, entry: int) -> Table:
        head = "".join(self.done)
        return {(entry, x): (c, head + letters) for x, (c, letters, _) in self.ways.items()}


# --- rows and their faults -----------------------------------------------------------------------

def _same(a: Column, b: Column) -> Column:
    return a.eqNullSafe(b)


def turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text): the columns used, null role and text as one space."""
    c = columns_only(conversations, conv_id="long", turn="long", role="string", text="string")
    return c.withColumns({k: F.coalesce(k, F.lit(" ")) for k in ("role", "text")})


def damaged(rows: DataFrame) -> DataFrame:
    """The turns with faults planted by the hash of their place: dropped, emptied, without stops, twice, as user."""
    place = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    code = F.crc32(place.cast("binary")) % 20
    text = F.when(F.col("code") == 1, F.lit("")).when(F.col("code") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    return (rows.withColumn("code", code).where("code <> 0")
            .select("conv_id", "turn", F.when(F.col("code") == 4, F.lit("user")).otherwise(F.col("role")).alias("role"), text.alias("text"),
                    F.explode(F.when(F.col("code") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"))
            .drop("copy"))


def _digest() -> Column:
    return F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256).alias("digest")


def _marked(rows: DataFrame) -> DataFrame:
    """The turns with ``digest`` (of role and text), ``initial`` and ``kind``: blank, truncated or clean."""
    last = F.substring(F.rtrim(F.col("text"), F.lit(BLANKS)), -1, 1)
    kind = F.when(last == "", BLANK).when(last.isin(".", "!", "?"), CLEAN).otherwise(TRUNCATED)
    return rows.select("conv_id", "turn", _digest(), F.substring("role", 1, 1).alias("initial"), kind.alias("kind"))


def _segments(rows: DataFrame, rows_each: int) -> DataFrame:
    """(conv, least, width): of conversations with more than ``rows_each`` rows, the turns that one segment spans."""
    span = F.col("hi").cast("decimal(20,0)") - F.col("least").cast("decimal(20,0)") + 1
    return (rows.groupBy(F.col("conv_id").alias("conv")).agg(F.count("*").alias("n"), F.min("turn").alias("least"), F.max("turn").alias("hi"))
            .where((F.col("n") > rows_each) & F.col("least").isNotNull())
            .select("conv", "least", F.ceil(span / F.ceil(F.col("n") / rows_each)).alias("width")))


def _placed(rows: DataFrame, segments: DataFrame) -> DataFrame:
    """The rows with their segment, ``seg``: null turns come first, and short conversations have one only."""
    at = F.floor((F.col("turn").cast("decimal(20,0)") - F.col("least").cast("decimal(20,0)")) / F.col("width")).cast("long")
    return (rows.join(segments, _same(rows["conv_id"], segments["conv"]), "left")
            .withColumn("seg", F.coalesce(at, F.lit(0).cast("long")))
            .withColumn("long", F.col("width").isNotNull()).drop("conv", "least", "width"))


def _with_duplicates(rows: DataFrame) -> DataFrame:
    """``seen``: whether the row's role and text stand in an earlier turn of its conversation (null turns are the earliest)."""
    turn = lambda t: F.struct(F.col(t).isNotNull().alias("known"), F.col(t).alias("turn"))
    again = saved(rows.where(F.col("kind") != BLANK).groupBy(F.col("conv_id").alias("conv"), F.col("digest").alias("d"))
                  .agg(F.count("*").alias("n"), F.min(turn("turn")).alias("first")).where("n > 1").select("conv", "d", "first"), "again")
    side = checked_broadcast(again)
    return (rows.join(side, (rows["digest"] == side["d"]) & _same(rows["conv_id"], side["conv"]), "left")
            .withColumn("seen", F.coalesce(F.col("first") < turn("turn"), F.lit(False))).drop("conv", "d", "first"))


# --- searches over the table ---------------------------------------------------------------------

_TABLE = pa.list_(pa.struct([("entry", pa.int32()), ("exit", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())]))


def _runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, Iterator[tuple]]]:
    """Each run of rows with equal first ``keys`` columns, with the rows' other columns, one after another."""
    rows = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns)))
    ahead = next(rows, None)

    def run(key):
        nonlocal ahead
        while ahead is not None and ahead[:keys] == key:
            this, ahead = ahead, next(rows, None)
            yield this[keys:]

    while ahead is not None:
        key = ahead[:keys]
        members = run(key)
        yield key, members
        for _ in members:
            pass


def _searched(rows: Iterator[tuple], alone: bool, window: int):
    """Counts, ends and table of a run of rows (turn, digest, initial, kind, seen); ``alone``: it is a whole conversation."""
    counts, illegal, first, last, before = [0, 0, 0, 0], 0, None, None, None
    joined = {q: Joined(q) for q in ((START,) if alone else STATES)}
    held: list[tuple[int, str]] = []
    windows = 0

    def flush():
        table = window_table(held)
        for j in joined.values():
            j.add(table)

    for turn, digest, initial, kind, seen in rows:
        if len(held) == window:
            flush()
            windows += 1
            held = []
        fault = DUPLICATE if kind != BLANK and (seen or before == (turn, digest)) else kind
        before = turn, digest
        counts[fault] += 1
        illegal += last is not None and last + initial not in LEGAL
        first, last = initial if first is None else first, initial
        held.append((fault, initial))
    if alone and not windows:
        cost, audit = solve(held, START, WHOLE, True)
        table = {(START, -1): (cost, audit)}
    else:
        flush()
        if alone:
            table = {(START, -1): joined[START].closed()[:2]}
        else:
            table = {k: v for q, j in joined.items() for k, v in j.table(q).items()}
    return sum(counts), *counts[1:], illegal, first, last, [{"entry": q, "exit": x, "cost": c, "audit": a} for (q, x), (c, a) in table.items()]


def _tables(rows: DataFrame, window: int) -> DataFrame:
    """A row for each (conv_id, seg): its counts, the initials at its ends, and its table."""
    kinds = "conv_id long, seg long, n long, blank long, duplicate long, truncated long, illegal long, first string, last string"
    schema = pa.schema([(k.split()[0], pa.string() if k.endswith("string") else pa.int64()) for k in kinds.split(", ")] + [("ways", _TABLE)])

    def run(batches):
        out = []
        for (conv, seg, long), members in _runs(batches, 3):
            out.append((conv, seg, *_searched(members, not long, window)))
            if len(out) == 256:
                yield as_batch(schema, *zip(*out))
                out = []
        if out:
            yield as_batch(schema, *zip(*out))

    return (rows.select("conv_id", "seg", "long", "turn", "digest", "initial", "kind", "seen").repartition("conv_id", "seg")
            .sortWithinPartitions("conv_id", "seg", "turn", "digest")
            .mapInArrow(run, f"{kinds}, ways array<struct<entry: int, exit: int, cost: long, audit: string>>"))


def _decided(tables: DataFrame) -> DataFrame:
    """The segments' tables joined: for each conversation a row without ``seg`` (its counts, cost and audit), and for
    each segment its letters, the state before it and the number of turns that the repaired conversation has before it."""
    kinds = "conv_id long, seg long, state long, turns long, audit string, cost long, blank long, duplicate long, truncated long, illegal long"
    schema = pa.schema([(k.split()[0], pa.string() if k.endswith("string") else pa.int64()) for k in kinds.split(", ")])

    def conversation(conv, members):
        segs, sizes, sums, last = [], [], np.zeros(4, np.int64), None
        joined, alone = Joined(START), None
        for seg, n, *counts, first, end, ways in members:
            sums += counts
            sums[3] += last is not None and last + first not in LEGAL
            last = end
            segs.append(seg)
            sizes.append(n)
            if ways[0]["exit"] < 0:
                alone = ways[0]["cost"], ways[0]["audit"], str(START)
            else:
                joined.add({(w["entry"], w["exit"]): (w["cost"], w["audit"]) for w in ways})
        cost, audit, states = alone or joined.closed()
        letters = np.frombuffer(audit.encode(), np.uint8)
        row_ends = np.flatnonzero(letters != ord("I")) + 1
        ends = np.concatenate([[0], row_ends[np.cumsum(sizes) - 1]])
        ends[-1] = len(letters)
        turns = np.concatenate([[0], np.cumsum(letters != ord("D"))])
        yield conv, None, None, int(turns[-1]), audit, cost, *sums.tolist()
        for k, seg in enumerate(segs):
            yield conv, seg, int(states[k]), int(turns[ends[k]]), audit[ends[k]:ends[k + 1]], *[None] * 5

    def run(batches):
        out = []
        for (conv,), members in _runs(batches, 1):
            for row in conversation(conv, members):
                out.append(row)
                if len(out) == 1024:
                    yield as_batch(schema, *zip(*out))
                    out = []
        if out:
            yield as_batch(schema, *zip(*out))

    return tables.repartition("conv_id").sortWithinPartitions("conv_id", "seg").mapInArrow(run, kinds)


def _applied(rows: Iterator[tuple]) -> Iterator[tuple[int, str, str, str]]:
    """(position, edit, role, text) of repaired turns; rows: (seg, turn, digest, role, text, audit, state, turns), a
    segment's letters (a row with an audit) before its turns."""
    letters, at, state, position = "", 0, START, 0

    def inserted():
        nonlocal at, state, position
        while at < len(letters) and letters[at] == "I":
            role = NEXT[state][1]
            at, state = at + 1, NEXT[state][0]
            yield position, "I", role, ""
            position += 1

    for _, _, _, role, text, audit, start, before in rows:
        if audit is not None:
            yield from inserted()
            letters, at, state, position = audit, 0, start, before
            continue
        yield from inserted()
        edit, at = letters[at], at + 1
        if edit == "D":
            continue
        if edit == "R":
            state, role = NEXT[state]
        else:
            state = _kept(state, role[:1])
        yield position, edit, role, text
        position += 1
    yield from inserted()


class Repair:
    """The repair of a table of turns (conv_id, turn, role, text).

    ``summary``: (conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit) of every conversation that has rows.
    """

    def __init__(self, rows: DataFrame, segment: int = SEGMENT, window: int = WINDOW):
        self.rows = rows
        self.segments = saved(_segments(rows, segment), "segments")
        place = checked_broadcast(self.segments)
        marked = _with_duplicates(_placed(_marked(rows), place))
        self.decided = saved(_decided(saved(_tables(marked, window), "tables")), "decided")
        found = self.decided.where("seg is null").select("conv_id", "blank", "duplicate", "truncated", "illegal", "cost", "audit")
        whole = F.col("hi").cast("decimal(20,0)") - F.col("lo").cast("decimal(20,0)") + 1 - F.col("known")
        gaps = (rows.groupBy(F.col("conv_id").alias("conv"), "turn").agg(F.lit(1).alias("one")).groupBy("conv")
                .agg(F.max("turn").alias("hi"), F.min("turn").alias("lo"), F.count("turn").alias("known"))
                .select("conv", F.coalesce(whole, F.lit(0)).cast("long").alias("gaps")))
        self.summary = found.join(gaps, _same(found["conv_id"], gaps["conv"])).select(
            "conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")

    def _stream(self, by: tuple[str, ...]) -> DataFrame:
        """Segments' letters and turns, each segment's letters first."""
        rows = _placed(self.rows, checked_broadcast(self.segments))
        none = lambda k: F.lit(None).cast(k)
        marked = rows.select("conv_id", "seg", F.lit(1).alias("after"), "turn", _digest(), "role", "text",
                             none("string").alias("audit"), none("long").alias("state"), none("long").alias("turns"))
        letters = self.decided.where("seg is not null").select(
            "conv_id", "seg", F.lit(0).alias("after"), none("long").alias("turn"), none("string").alias("digest"), none("string").alias("role"),
            none("string").alias("text"), "audit", "state", "turns")
        return (marked.unionByName(letters).repartition(*by).sortWithinPartitions("conv_id", "seg", "after", "turn", "digest")
                .select("conv_id", "seg", "turn", "digest", "role", "text", "audit", "state", "turns"))

    def turns(self) -> DataFrame:
        """(conv_id, position, edit, role, text): the repaired conversations, positions from 0."""
        schema = pa.schema([("conv_id", pa.int64()), ("position", pa.int64()), ("edit", pa.string()), ("role", pa.string()), ("text", pa.string())])

        def run(batches):
            out, size = [], 0
            for (conv, seg), members in _runs(blocks(batches), 2):
                for turn in _applied((seg, *m) for m in members):
                    out.append((conv, *turn))
                    size += len(turn[3])
                    if size > 1 << 20 or len(out) == 4096:
                        yield as_batch(schema, *zip(*out))
                        out, size = [], 0
            if out:
                yield as_batch(schema, *zip(*out))

        return self._stream(("conv_id", "seg")).mapInArrow(run, "conv_id long, position long, edit string, role string, text string")

    def digests(self) -> DataFrame:
        """(conv_id, repaired_sha256): of each repaired conversation as lines ``role:text``.

        The turns of a conversation pass its digest one by one; none are gathered.
        """
        schema = pa.schema([("conv_id", pa.int64()), ("repaired_sha256", pa.string())])

        def run(batches):
            out = []
            for (conv,), members in _runs(blocks(batches), 1):
                h, sep = hashlib.sha256(), ""
                for _, _, role, text in _applied(members):
                    h.update(f"{sep}{role}:{text}".encode())
                    sep = "\n"
                out.append((conv, h.hexdigest()))
                if len(out) == 1024:
                    yield as_batch(schema, *zip(*out))
                    out = []
            if out:
                yield as_batch(schema, *zip(*out))

        return self._stream(("conv_id",)).mapInArrow(run, "conv_id long, repaired_sha256 string")


def report(conversations: DataFrame, segment: int = SEGMENT, window: int = WINDOW) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of every original conversation,
    whose turns are damaged first."""
    rows = turns(conversations)
    fix = Repair(damaged(rows), segment, window)
    every = rows.select(F.col("conv_id").alias("conv")).distinct()
    s, d = fix.summary, fix.digests().withColumnRenamed("conv_id", "of")
    both = s.join(d, _same(s["conv_id"], d["of"])).drop("of")
    zero = F.lit(0).cast("long")
    return every.join(both, _same(every["conv"], both["conv_id"]), "left").select(
        F.col("conv").alias("conv_id"), *(F.coalesce(k, zero).alias(k) for k in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")),
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"))
