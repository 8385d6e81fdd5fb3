"""Token counts by a compiled tokenizer (operator 5).

The tokenizer file is compiled to the transducers of ``transducer.py``; counts are sums of the numbers on
their transitions. Strings of special tokens inside a text are one token each, as the library has it.

Defined results: a null text counts as empty (0 bytes, 0 tokens); repeated rows get equal rows; an empty
table gives an empty table; null ids stay null; other columns of the input aren't read. Texts are read
whole, with no truncation.
"""

from __future__ import annotations

import json
import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from clashlens.llm.common import as_batch, blocks, columns_only
from clashlens.llm.transducer import CountTransducer, PieceTable, character_classes, split_pieces

_counters: dict[str, "Counter"] = {}


def load_tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"      # Spark has a task on each core
    from tokenizers import Tokenizer
    return Tokenizer.from_file(path)


def compiled_classes(path: str) -> np.ndarray:
    """Made once on the driver and sent along with the tasks."""
    return character_classes(load_tokenizer(path))


class Counter:
    def __init__(self, path: str, classes: np.ndarray):
        self.classes = classes
        self.bpe = CountTransducer(path)
        special = sorted((t["content"] for t in json.load(open(path, encoding="utf-8"))["added_tokens"]), key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, special))) if special else None
        self.known = PieceTable()

    def count(self, texts: list[str]) -> np.ndarray:
        parts, of, extra = [], [], np.zeros(len(texts), np.int64)
        for i, t in enumerate(texts):
            cut = self.special.split(t) if self.special else [t]
            extra[i] = len(cut) - 1
            parts += cut
            of += [i] * len(cut)
        pieces = split_pieces(parts, self.classes)
        n = self.known.get(pieces.hash)
        if (n < 0).any():
            h, which = np.unique(pieces.hash, return_index=True)
            if self.known.full_with(len(h)):
                self.known.clear()
            which = which[self.known.get(h) < 0]
            self.known.put(pieces.hash[which], np.array(self.bpe.counts([p.encode() for p in pieces.strings(which)]), np.int64))
            n = self.known.get(pieces.hash)
        total = np.bincount(np.asarray(of, np.int64)[pieces.part], weights=n, minlength=len(texts))
        return (total + extra).astype(np.int64)


def counter(path: str, classes: np.ndarray) -> Counter:
    """One for each file in a Python worker, which Spark uses for many tasks."""
    if path not in _counters:
        _counters[path] = Counter(path, classes)
    return _counters[path]


def token_counts(docs: DataFrame, path: str, limit: int = 1024) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every row of ``docs``."""
    classes = compiled_classes(path)
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("over_limit", pa.bool_())])

    def run(batches):
        for b in blocks(batches):
            text = pc.fill_null(b.column(1), "")
            n = counter(path, classes).count(text.to_pylist())
            yield as_batch(schema, b.column(0), pc.binary_length(text).cast(pa.int64()), n, n > limit)

    return columns_only(docs, doc_id="long", text="string").mapInArrow(
        run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
