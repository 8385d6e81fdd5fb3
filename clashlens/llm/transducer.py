"""Finite-state form of a byte-level BPE tokenizer: a piece transducer and a token-count transducer.

The piece transducer reads character classes and marks where the tokenizer's word pieces begin. Its input
is cut into equal chunks; each chunk gives a state map (exit state for every entry state), the maps
compose by a parallel prefix scan, and with every chunk's entry state known all chunks run in lockstep.

The count transducer reads the bytes of a piece. Every transition is annotated with the change of the
number of tokens of what was read; their sum is the piece's token count. Its states are made as they are
first reached: the longest suffix that begins some token, and the last token at each position in it. A
token ends a prefix exactly if it and the last token before it stay apart when they are encoded together.
"""

from __future__ import annotations

import json
from dataclasses import dataclass
from functools import cache

import numpy as np
import regex

from clashlens.llm.common import PieceTable, mix, range_hashes  # noqa: F401

# character classes of the pieces; the letters of the contractions 's 't 'm 'd 're 've 'll are classes of their own
END, SPACE, BLANK, LETTER, NUMBER, OTHER, QUOTE, STMD, RV, E, L = range(11)
LETTERS = (LETTER, STMD, RV, E, L)
# states: what the characters since the last certain piece start are
(FRESH, IN_LETTERS, IN_NUMBERS, IN_OTHERS, ONE_SPACE, BLANKS_SPACE, ONE_BLANK, BLANKS_BLANK, AT_QUOTE, QUOTE_RV, QUOTE_L) = range(11)
STATES, WIDTH = 11, 16
HERE, BEFORE = 1, 2     # a piece begins at this character; at the character before it
CHUNK = 128
NEVER = 1 << 60
ONE = [bytes([b]) for b in range(256)]
SHIFT = 128


def compile_pieces() -> tuple[np.ndarray, np.ndarray]:
    """(next state, marks) by state * WIDTH + class."""
    begin = {END: FRESH, SPACE: ONE_SPACE, BLANK: ONE_BLANK, NUMBER: IN_NUMBERS, OTHER: IN_OTHERS, QUOTE: AT_QUOTE}
    begin |= dict.fromkeys(LETTERS, IN_LETTERS)
    nxt, marks = np.zeros(STATES * WIDTH, np.uint8), np.zeros(STATES * WIDTH, np.uint8)

    def rule(state, classes, to, mark):
        for c in classes:
            nxt[state * WIDTH + c], marks[state * WIDTH + c] = begin[c] if to is None else to, mark

    every = range(11)
    for s in range(STATES):
        rule(s, every, None, HERE)
    rule(IN_LETTERS, LETTERS, IN_LETTERS, 0)
    rule(IN_NUMBERS, [NUMBER], IN_NUMBERS, 0)
    rule(IN_OTHERS, [OTHER, QUOTE], IN_OTHERS, 0)
    # one space joins the piece after it; of a longer run of blanks only a last space does
    for s, mark in ((ONE_SPACE, 0), (BLANKS_SPACE, BEFORE)):
        rule(s, LETTERS, IN_LETTERS, mark)
        rule(s, [NUMBER], IN_NUMBERS, mark)
        rule(s, [OTHER, QUOTE], IN_OTHERS, mark)
    rule(BLANKS_BLANK, every[1:], None, HERE | BEFORE)
    for s in (ONE_SPACE, BLANKS_SPACE, ONE_BLANK, BLANKS_BLANK):
        rule(s, [SPACE], BLANKS_SPACE, 0)
        rule(s, [BLANK], BLANKS_BLANK, 0)
    # a quote that begins a piece may begin a contraction
    rule(AT_QUOTE, [OTHER, QUOTE], IN_OTHERS, 0)
    rule(AT_QUOTE, [STMD], FRESH, 0)
    rule(AT_QUOTE, [RV], QUOTE_RV, 0)
    rule(AT_QUOTE, [L], QUOTE_L, 0)
    for s, last in ((QUOTE_RV, E), (QUOTE_L, L)):
        rule(s, every, None, HERE | BEFORE)
        rule(s, LETTERS, IN_LETTERS, BEFORE)
        rule(s, [last], FRESH, 0)
    return nxt, marks


NEXT, MARKS = compile_pieces()


def character_classes(tokenizer) -> np.ndarray:
    """The class of every code point, letters and numbers as this tokenizer's own splitter knows them."""
    every = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
    out = np.full(0x110000, OTHER, np.uint8)
    for c in regex.findall(r"\s", every):
        out[ord(c)] = BLANK
    for pattern, mate, kind in ((r"\p{L}", "a", LETTER), (r"\p{N}", "1", NUMBER)):
        found = regex.findall(pattern, every)
        for a in range(0, len(found), 20_000):     # newer tables have more letters: ask which ones join a known one
            part = found[a:a + 20_000]
            starts = np.zeros(3 * len(part) + 1, bool)
            starts[[s for _, (s, _) in tokenizer.pre_tokenizer.pre_tokenize_str("".join(f"\n{mate}{c}" for c in part))]] = True
            known = ~starts[2:3 * len(part):3]
            out[[ord(c) for c, k in zip(part, known) if k]] = kind
    out[0x20] = SPACE
    out[ord("'")] = QUOTE
    for letters, kind in (("stmd", STMD), ("rv", RV), ("e", E), ("l", L)):
        out[[ord(c) for c in letters]] = kind
    return out


def run_chunks(classes: np.ndarray) -> np.ndarray:
    """The marks of a class sequence whose length is a multiple of CHUNK, from the state FRESH."""
    steps = np.ascontiguousarray(classes.reshape(-1, CHUNK).T).astype(np.int64)
    lanes = steps.shape[1]
    # state maps of the chunks: all entry states at once, one alone from where they have met
    maps = np.repeat(np.arange(STATES, dtype=np.uint8)[:, None], lanes, axis=1)
    t = 0
    while t < CHUNK and not (maps == maps[0]).all():
        maps = NEXT.take(maps.astype(np.int64) * WIDTH + steps[t])
        t += 1
    if t < CHUNK:
        one = maps[0]
        for t in range(t, CHUNK):
            one = NEXT.take(one * np.int64(WIDTH) + steps[t])
        maps = np.repeat(one[None], STATES, axis=0)
    # prefix scan: after the round with shift d, a map covers the 2 d chunks up to its own
    d = 1
    while d < lanes:
        maps[:, d:] = np.take_along_axis(maps[:, d:], maps[:, :-d].astype(np.int64), axis=0)
        d *= 2
    state = np.full(lanes, FRESH, np.uint8)
    state[1:] = maps[FRESH, :-1]
    marks = np.empty((CHUNK, lanes), np.uint8)
    for t in range(CHUNK):
        at = state * np.int64(WIDTH) + steps[t]
        marks[t] = MARKS.take(at)
        state = NEXT.take(at)
    return marks.T.reshape(-1)


@dataclass
class Pieces:
    """The pieces of some text parts: where each lies in ``text``, the part it is of, and a 64-bit hash of it."""
    text: str
    first: np.ndarray
    end: np.ndarray
    part: np.ndarray
    hash: np.ndarray

    def strings(self, which) -> list[str]:
        return [self.text[a:z] for a, z in zip(self.first[which].tolist(), self.end[which].tolist())]


def split_pieces(parts: list[str], table: np.ndarray) -> Pieces:
    text = "\n".join([*parts, ""])
    size = np.fromiter(map(len, parts), np.int64, len(parts)) + 1
    ends = np.cumsum(size) - 1
    n = len(text)
    code = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    classes = np.zeros(-(-(n + 1) // CHUNK) * CHUNK, np.uint8)
    classes[:n] = table[code]
    classes[ends] = END
    marks = run_chunks(classes)
    first = (marks & HERE).astype(bool)
    first[:-1] |= (marks[1:] & BEFORE).astype(bool)
    at = np.flatnonzero(first[:n + 1])
    inner = classes[at] != END
    inner[at >= n] = False
    a, z = at[inner], at[np.flatnonzero(inner) + 1]
    return Pieces(text, a, z, np.searchsorted(ends, a), range_hashes(mix(code.astype(np.uint64), 41), a, z))


class CountTransducer:
    """Deterministic transducer over the bytes of a piece whose transitions carry token counts."""

    LIMIT = 250_000     # states kept at a time

    def __init__(self, path: str):
        model = json.load(open(path, encoding="utf-8"))["model"]
        letter = _byte_letters()
        raw = lambda s: bytes(letter[c] for c in s)
        self.vocab = {raw(t) for t in model["vocab"] if all(c in letter for c in t)}
        pairs = (m.split(" ") if isinstance(m, str) else m for m in model["merges"])
        self.rank = {(raw(a), raw(b)): i for i, (a, b) in enumerate(pairs)}
        self.prefixes = {t[:i] for t in self.vocab for i in range(len(t))}     # of a longer token
        self.parts = {a + b: (i, (a, b)) for (a, b), i in self.rank.items()}
        self.spines: tuple[dict, dict] = {}, {}
        self.whole: dict[bytes, bool] = {}
        self._reset()

    def _reset(self) -> None:
        self.start = b"", (b"",), (0,)
        self.states, self.number = [self.start], {self.start: 0}
        # next state and change of the count, by state and the byte's column
        self.width, self.column, self.bytes = 64, np.full(256, -1, np.int64), []
        self.table = np.full(1024 * self.width, -1, np.int32)

    def merge(self, data: bytes) -> list[bytes]:
        """The tokens of a few bytes by the merge rules themselves."""
        parts = [data[i:i + 1] for i in range(len(data))]
        while len(parts) > 1:
            best = min(((self.rank.get(p, 1 << 30), i) for i, p in enumerate(zip(parts, parts[1:]))))
            if best[0] == 1 << 30:
                break
            pair = parts[best[1]], parts[best[1] + 1]
            out, i = [], 0
            while i < len(parts):
                if i + 1 < len(parts) and (parts[i], parts[i + 1]) == pair:
                    out.append(pair[0] + pair[1])
                    i += 2
                else:
                    out.append(parts[i])
                    i += 1
            parts = out
        return parts

    def spine(self, token: bytes, right: bool) -> list[tuple[bytes, int, int]]:
        """The parts of a token along its right or left edge, from bytes to the whole: (part, rank of the
        merge that makes it, rank of the merge that uses it up)."""
        memo = self.spines[right]
        got = memo.get(token)
        if got is None:
            got, part, used = [], token, NEVER
            while part in self.parts:
                rank, pair = self.parts[part]
                got.append((part, rank, used))
                part, used = pair[right], rank
            got = memo[token] = [(part, -1, used), *reversed(got)]
        return got

    def stay_apart(self, left: bytes, right: bytes) -> bool:
        """No merge ever joins the end of ``left`` with the beginning of ``right``.

        Merges happen in the order of their ranks, and of equal ones the leftmost first. A pair of parts
        that are there at the same time merges if its rank comes before those that use up either part.
        """
        if not left:
            if right not in self.whole:
                self.whole[right] = self.merge(right) == [right]
            return self.whole[right]
        rank = self.rank
        for a, made_a, used_a in self.spine(left, True):
            for b, made_b, used_b in self.spine(right, False):
                if made_a < used_b and made_b < used_a:
                    r = rank.get((a, b))
                    if r is not None and r < used_a and r <= used_b:
                        return False
        return True

    def move(self, state: int, byte: int) -> tuple[int, int]:
        """(next state, change of the token count)."""
        tail, tokens, counts = self.states[state]   # last token, and count less the current one, k bytes back
        tail += ONE[byte]
        vocab, prefixes, n = self.vocab, self.prefixes, len(tail)
        for k in range(n, 0, -1):
            token = tail[n - k:]
            if token in vocab and tokens[k - 1] is not None and self.stay_apart(tokens[k - 1], token):
                break
        else:
            raise ValueError("a byte without a token")
        change = counts[k - 1] + 1
        # a longer token can only begin where the rest of the tail is the beginning of one
        back = [k for k in range(1, n + 1) if tail[n - k:] in prefixes]
        if not back:
            new = b"", (token,), (0,)
        else:
            far = back[-1]
            known: list = [None] * far
            less = [0] * far
            for k in back:
                if tokens[k - 1] is not None:
                    known[k - 1], less[k - 1] = tokens[k - 1], counts[k - 1] - change
            new = tail[n - far:], (token, *known), (0, *less)
        at = self.number.get(new)
        if at is None:
            at = self.number[new] = len(self.states)
            self.states.append(new)
        return at, change

    def _fill(self, keys) -> None:
        """Make the transitions of these places of the table."""
        for key in keys:
            state, column = divmod(int(key), self.width)
            to, change = self.move(state, self.bytes[column])
            self.table[key] = to << 8 | change + SHIFT
        rows = len(self.table) // self.width
        if len(self.states) > rows:
            self.table = np.concatenate([self.table, np.full(max(rows, len(self.states) - rows) * self.width, -1, np.int32)])

    def _columns(self, data: np.ndarray) -> np.ndarray:
        """The table's columns of bytes; bytes that are new get one, and a wider table if there is none left."""
        new = np.unique(data[self.column[data] < 0])
        if len(new):
            if len(self.bytes) + len(new) > self.width:
                old, self.width = self.width, 2 * (len(self.bytes) + len(new))
                table = np.full((len(self.table) // old, self.width), -1, np.int32)
                table[:, :old] = self.table.reshape(-1, old)
                self.table = table.reshape(-1)
            self.column[new] = np.arange(len(self.bytes), len(self.bytes) + len(new))
            self.bytes += new.tolist()
        return self.column[data]

    def counts(self, pieces: list[bytes]) -> list[int]:
        """Token counts; all pieces take a step at a time."""
        if len(self.states) > self.LIMIT:
            self._reset()
        size = np.fromiter(map(len, pieces), np.int64, len(pieces))
        columns = self._columns(np.frombuffer(b"".join(pieces), np.uint8))
        order = np.argsort(-size, kind="stable")
        at, size = (np.cumsum(size) - size)[order], size[order]
        state, total = np.zeros(len(pieces), np.int64), np.zeros(len(pieces), np.int64)
        running = len(pieces) - np.searchsorted(size[::-1], np.arange(int(size[0]) if len(size) else 0), side="right")
        for t, n in enumerate(running.tolist()):
            key = state[:n] * self.width + columns[at[:n] + t]
            got = self.table[key]
            if (got < 0).any():
                self._fill(np.unique(key[got < 0]))
                got = self.table[key]
            state[:n] = got >> 8
            total[:n] += (got & 255) - SHIFT
        out = np.empty_like(total)
        out[order] = total
        return out.tolist()


@cache
def _byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in a byte-level vocabulary file."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}
