"""Operator 11 against a table over all prefixes, and that against every edit there is."""

import hashlib
import itertools
import random
import re
import zlib

import duckdb
import pytest

from clashlens.llm import conversation_repair as C

SHAPE = re.compile(r"(s?(ua)+)?\Z")


# --- plain version -------------------------------------------------------------------------------

def plain_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        code = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if code == 0:
            continue
        text = "" if code == 1 else re.sub("[.!?]", "", text) if code == 2 else text
        out += [(conv, turn, "user" if code == 4 else role, text)] * (2 if code == 3 else 1)
    return out


def in_order(rows):
    digest = lambda r: hashlib.sha256(f"{len(r[2])}:{r[2]}{r[3]}".encode()).hexdigest()
    return sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, digest(r)))


def plain_faults(rows):
    seen, out = set(), []
    for _, _, role, text in rows:
        left = re.sub(r"[\x20\x09-\x0D]", "", text)
        out.append("blank" if not left else "duplicate" if (role, text) in seen else "truncated" if left[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def plain_best(rows, faults):
    """(cost, audit, lines) by a table: prefix by prefix, the best way to each sequence of role initials so far (shortened to its end)."""
    def nxt(s, c):
        return {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}[s].get(c)

    def better(ways, s, way):
        if s not in ways or way[:2] < ways[s][:2]:
            ways[s] = way

    def inserted(ways):
        for _ in range(2):
            for s, (c, a, said) in list(ways.items()):
                for r in ("user", "assistant"):
                    if nxt(s, r[0]):
                        better(ways, nxt(s, r[0]), (c + 5, a + "I", said + [f"{r}:"]))
        return ways

    ways = inserted({"": (0, "", [])})
    for (_, _, role, text), fault in zip(rows, faults):
        new = {}
        for s, (c, a, said) in ways.items():
            better(new, s, (c + 2, a + "D", said))
            if fault in ("", "truncated"):
                more = 5 if fault else 0
                if nxt(s, role[:1]):
                    better(new, nxt(s, role[:1]), (c + more, a + "K", said + [f"{role}:{text}"]))
                for r in ("user", "assistant"):
                    if nxt(s, r[0]):
                        better(new, nxt(s, r[0]), (c + more + 1, a + "R", said + [f"{r}:{text}"]))
        ways = inserted(new)
    return min(v for s, v in ways.items() if s in ("", "a"))


def plain_report(rows):
    out = []
    for conv in {r[0] for r in rows}:
        mine = in_order([r for r in plain_damage(rows) if r[0] == conv])
        faults = plain_faults(mine)
        cost, audit, said = plain_best(mine, faults)
        known = {r[1] for r in mine if r[1] is not None}
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(mine, mine[1:]))
        out.append((conv, max(known) - min(known) + 1 - len(known) if known else 0, *(faults.count(k) for k in ("blank", "duplicate", "truncated")),
                    illegal, cost, audit, hashlib.sha256("\n".join(said).encode()).hexdigest()))
    return sorted(out, key=str)


NAMES = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
KIND = "conv_id long, turn long, role string, text string"


def got(df):
    assert df.columns == NAMES
    return sorted((tuple(r) for r in df.collect()), key=str)


# --- one window ----------------------------------------------------------------------------------

def every_edit(rows):
    """(cost, audit) of every way to edit a few rows, with up to two inserts anywhere."""
    best = None
    gaps = [""] * (len(rows) + 1)
    for edits in itertools.product("DKR", repeat=len(rows)):
        for inserts in itertools.product(range(3), repeat=len(gaps)):
            if sum(inserts) > 3:
                continue
            options = []
            for k, (fault, initial) in enumerate([*rows, (0, "")]):
                options += [("I", 5, "ua")] * inserts[k]
                if k < len(rows):
                    e = edits[k]
                    stay = 5 if fault == C.TRUNCATED else 0
                    if e != "D" and fault in (C.BLANK, C.DUPLICATE):
                        options = None
                        break
                    options.append(("D", 2, "") if e == "D" else ("K", stay, initial) if e == "K" else ("R", stay + 1, "ua"))
            if options is None:
                continue
            way = sum(o[1] for o in options), "".join(o[0] for o in options)
            if best is not None and way >= best:
                continue
            choices = [o[2] for o in options if o[0] != "D"]
            if all(choices) and any(SHAPE.match("".join(p)) for p in itertools.product(*choices)):
                best = way
    return best


def some_rows(rng, n, initials="suua", clean=0.7):
    return [(C.CLEAN if rng.random() < clean else rng.randrange(1, 4), rng.choice(initials)) for _ in range(n)]


def test_search_equals_every_edit():
    rng = random.Random(4)
    for _ in range(60):
        rows = some_rows(rng, rng.randrange(0, 5), "suat" if rng.random() < 0.3 else "sua")
        assert C.solve(rows, C.START, C.WHOLE, True) == every_edit(rows), rows


def test_bounds_are_bounds_and_windows_join():
    rng = random.Random(5)
    for _ in range(300):
        rows = some_rows(rng, rng.randrange(1, 15), rng.choice(["sua", "ua", "u", "suat", "ss"]), rng.random())
        best = C.solve(rows, C.START, C.WHOLE, True)
        for q in C.STATES:
            whole = C.solve(rows, q, C.STATES, True)
            assert C.suffix_bounds(rows)[0] <= whole[0]
        at = sorted(rng.randrange(len(rows) + 1) for _ in range(2))
        joined = C.Joined(C.START)
        for part in (rows[:at[0]], rows[at[0]:at[1]], rows[at[1]:]):
            if part:
                joined.add(C.window_table(part))
        assert joined.closed()[:2] == best, (rows, at)


# --- the whole operator --------------------------------------------------------------------------

def test_given_conversations(spark):
    from clashlens.llm.queries import QUERIES
    from clashlens.llm.sql import ORACLES
    sf = "/root/testdata/sf0.01"
    out = got(QUERIES["op11_conversation_repair"](spark, sf))
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert out == plain_report(rows)
    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{sf}/conversations.parquet')")
    assert out == sorted(con.sql(ORACLES["op11_conversation_repair"]).fetchall(), key=str)


def odd_turns(rng, convs=(None, 1, 2, 3, 4, 5, 6)):
    said = [None, "", " \n\t", "Yes.", "Yes.", "No", "What?\n ", "a ", "é!", "x" * 5000 + "."]
    rows = [(c, rng.choice([None, 0, 1, 2, 3, 5, 9, 40, -7]), rng.choice([None, "", "user", "assistant", "system", "tool", "User", "uber"]), rng.choice(said))
            for c in convs for _ in range(rng.randrange(1, 14))]
    return rows + [(99, None, None, None)] + [(100, None, "user", "Hm.")] * 3


@pytest.mark.parametrize("seed,segment,window", [(1, 512, 24), (2, 4, 3), (3, 3, 24), (4, 1, 1)])
def test_odd_rows(spark, seed, segment, window):
    rows = odd_turns(random.Random(seed))
    df = spark.createDataFrame(rows, KIND).selectExpr("*", "'x' AS digest", "1 AS seg", "2 AS cost", "'y' AS conv")
    assert got(C.report(df, segment, window)) == plain_report(rows)


def test_no_rows(spark):
    empty = spark.createDataFrame([], KIND)
    assert got(C.report(empty)) == [] and C.Repair(C.turns(empty)).turns().collect() == []
    gone = [(c, 0, "user", "Hm.") for c in range(200) if zlib.crc32(f"{c}:0".encode()) % 20 == 0][:2]
    assert got(C.report(spark.createDataFrame(gone, KIND))) == [(c, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) for c, *_ in gone]


def test_a_long_conversation_in_segments(spark):
    rng = random.Random(8)
    rows = [(7, t, rng.choice(["user", "assistant", "assistant", "user", "system"]), rng.choice([f"Line {t}.", f"Line {t}", "Same."]))
            for t in range(3000) if rng.random() < 0.9] + [(8, 0, "user", "Hm."), (8, 1, "assistant", "Well.")]
    df = spark.createDataFrame(rows, KIND)
    want = plain_report(rows)
    assert got(C.report(df, 100, 8)) == want and got(C.report(df)) == want


def test_repaired_turns_are_the_conversation(spark):
    rows = odd_turns(random.Random(9), range(5)) + [(50, t, "user", f"Turn {t}.") for t in range(40)]
    fix = C.Repair(C.damaged(C.turns(spark.createDataFrame(rows, KIND))), 10, 4)
    said = {}
    for r in fix.turns().orderBy("conv_id", "position").collect():
        said.setdefault(r.conv_id, []).append(r)
    digests = {r.conv_id: r.repaired_sha256 for r in fix.digests().collect()}
    assert {d for c, d in digests.items() if c not in said} <= {hashlib.sha256(b"").hexdigest()}
    for c, turns in said.items():
        assert SHAPE.match("".join(t.role[:1] for t in turns)) and [t.position for t in turns] == list(range(len(turns)))
        assert all(t.text == "" and t.role in ("user", "assistant") for t in turns if t.edit == "I")
        assert hashlib.sha256("\n".join(f"{t.role}:{t.text}" for t in turns).encode()).hexdigest() == digests[c]
