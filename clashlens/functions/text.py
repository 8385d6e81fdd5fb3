"""Text expressions: strip, sentence split, word tokens, term counts, pair truncation.

Every function returns a Column built from JVM-side expressions (no Python per row). The regular
expressions are written in the subset shared by Java regex and RE2, so the DuckDB oracle can apply
the very same patterns (see ``clashlens.plans.oracle``).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from clashlens.config import ABBREVIATIONS, NEGATION_WORDS

# Characters for which Python's str.isspace() is true, as one character class.
WS = (r"[\t\n\x{0B}\f\r\x{1C}-\x{1F} \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
      r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]")
STRIP_RE = rf"^{WS}+|{WS}+\z"
BLANKS = ("\t\n\x0b\f\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B)))
          + "\u2028\u2029\u202f\u205f\u3000")      # the same, one by one
# A sentence ends at a run of . ! ? (plus closing quotes or brackets) followed by blanks.
CLOSERS = "[\"'\\x{201D}\\x{2019})\\]]"
BOUNDARY_RE = rf"([.!?]+{CLOSERS}*){WS}+"
_abbrev = "|".join(a.replace(".", r"\.") for a in ABBREVIATIONS)
ABBREV_RE = rf"(?i)(^|[^\p{{L}}\p{{N}}])({_abbrev})\."
# The same, tried at periods only, which is cheap. It differs only where an abbreviation begins right after the period of
# another, which ABBREV_RE has used up. (Half a character of two UTF-16 units is no separator, a whole one may be.)
# The last branch never holds: it has Java look back far enough for a separator of two units.
_apart = r"[^\p{L}\p{N}\p{Cs}]|[\x{10000}-\x{10FFFF}&&[^\p{L}\p{N}]]|(?!)[\x{0}-\x{FF}]{2}"
ABBREV_AT_PERIOD_RE = rf"(?i)\.(?<=(?:^|{_apart})(?:{_abbrev})\.)"
ABBREV_TWICE_RE = rf"(?i)\.(?:{_abbrev})\."
TOKEN_RE = r"[\p{L}\p{N}]+"
# Private-use code points serve as markers: SPLIT_MARK where a sentence ends, GUARD_MARK after an
# abbreviation's period (so the boundary pattern cannot match there); the guard is removed last.
SPLIT_MARK = "\ue000"
GUARD_MARK = "\ue001"


def strip(col: Column) -> Column:
    """Python ``str.strip()``: removes Unicode blanks at both ends (Spark ``trim`` only removes spaces)."""
    return F.btrim(col, F.lit(BLANKS))


def split_sentences(text: Column) -> Column:
    """ARRAY<STRING> of the sentences of ``text``; NULL text gives NULL, blank text an empty array."""
    bare = strip(text)
    guarded = (F.when(bare.rlike(ABBREV_TWICE_RE), F.regexp_replace(bare, ABBREV_RE, "$1$2." + GUARD_MARK))
               .otherwise(F.regexp_replace(bare, ABBREV_AT_PERIOD_RE, "." + GUARD_MARK)))
    marked = F.regexp_replace(guarded, BOUNDARY_RE, "$1" + SPLIT_MARK)
    return F.array_remove(F.split(F.replace(marked, F.lit(GUARD_MARK), F.lit("")), SPLIT_MARK), "")


def tokens(sentence: Column) -> Column:
    """Lower-cased word tokens (letters and digits) of a sentence, in order, duplicates kept."""
    return F.regexp_extract_all(F.lower(sentence), F.lit(TOKEN_RE), 0)


def word_count(sentence: Column) -> Column:
    """Number of word tokens of a sentence as it is written."""
    return F.size(F.regexp_extract_all(sentence, F.lit(TOKEN_RE), 0))


def first_words(sentence: str, n: str) -> Column:
    """The beginning of a sentence up to its n-th word token, with all characters as they are (both are column names)."""
    words = F.concat(F.lit(r"^(?:[^\p{L}\p{N}]*+[\p{L}\p{N}]++){"), F.col(n).cast("string"), F.lit("}"))
    return F.when(F.col(n) <= 0, F.lit("")).otherwise(F.coalesce(F.regexp_substr(F.col(sentence), words), F.lit("")))


def run_starts(s: Column) -> Column:
    """1-based positions where a new run of equal values starts in the sorted array ``s``.

    ``s`` must be a column reference (not an expression): a lambda re-evaluates whatever it
    references for every element, so callers materialize the sorted array first.
    """
    n = F.size(s)
    return F.when(n > 0, F.filter(F.sequence(F.lit(1), F.greatest(n, F.lit(1))),
                                  lambda k: (k == 1) | (F.get(s, k - 1) != F.get(s, k - 2)))
                  ).otherwise(F.array().cast("array<int>"))


def run_lengths(s: Column, starts: Column) -> Column:
    """ARRAY<STRUCT<token, tf>>: each distinct value of sorted ``s`` with its count (both column refs)."""
    n = F.size(s)
    return F.transform(starts, lambda p, r: F.struct(
        F.get(s, p - 1).alias("token"),
        (F.coalesce(F.get(starts, r + 1), n + 1) - p).cast("long").alias("tf")))


def sum_squares(terms: Column) -> Column:
    """Squared L2 norm of a term-count vector, as an exact integer."""
    return F.aggregate(terms, F.lit(0).cast("long"), lambda acc, e: acc + e["tf"] * e["tf"])


def has_negation(toks: Column) -> Column:
    return F.arrays_overlap(toks, F.array(*[F.lit(w) for w in NEGATION_WORDS]))


def truncate_pair(la: Column, lb: Column, budget: int):
    """Kept lengths of two token lists cut to ``budget`` tokens together, longest side first.

    Closed form of removing one token at a time from the longer list (from the second on ties):
    first the longer list shrinks to the shorter one's length, then the two alternate.
    """
    r = la + lb - budget
    d = F.abs(la - lb)
    m = F.least(la, lb)
    rr = r - d
    keep_a = (F.when(r <= 0, la).when(r <= d, F.when(la > lb, la - r).otherwise(la))
              .otherwise(m - F.floor(rr / 2)))
    keep_b = (F.when(r <= 0, lb).when(r <= d, F.when(la > lb, lb).otherwise(lb - r))
              .otherwise(m - F.ceil(rr / 2)))
    return keep_a.cast("int"), keep_b.cast("int")
