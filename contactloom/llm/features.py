"""Numbers that describe a text's form, for many texts at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from contactloom.llm.compression import repeated_words
from contactloom.llm.words import Words, blocks

NAMES = (
    "log_words", "word_bytes", "longest_word", "upper", "digits", "symbols", "marks", "beyond_ascii",
    "distinct_words", "repeated_words", "line_words", "sentence_ends", "capital_words", "odd_endings",
)


def _class(chars: bytes) -> np.ndarray:
    table = np.zeros(256, dtype=bool)
    table[list(chars)] = True
    return table


UPPER = _class(bytes(range(65, 91)))
DIGITS = _class(b"0123456789")
SYMBOLS = _class(b"#*$%&|<>{}[]\\^~=+_@/")
MARKS = _class(b"!?.,;:")
ENDS = _class(b".!?")


def text_features(words: Words) -> np.ndarray:
    """A row per text; all features of a text without words are 0."""
    n, size = words.counts, np.diff(words.bounds)
    texts = len(n)

    def per_text(flags: np.ndarray) -> np.ndarray:
        sums = np.concatenate(([0], np.cumsum(flags)))
        return sums[words.bounds[1:]] - sums[words.bounds[:-1]]

    def per_word(values: np.ndarray) -> np.ndarray:
        sums = np.concatenate(([0], np.cumsum(values)))
        return sums[words.first[1:]] - sums[words.first[:-1]]

    def share(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.where(n > 0, a / np.maximum(b, 1), 0.0)

    lengths = words.end - words.start
    longest = np.zeros(texts)
    some = np.flatnonzero(n)
    if len(some):
        longest[some] = np.maximum.reduceat(lengths, words.first[some])
    order = np.lexsort((words.hashes, words.text_of))
    fresh = np.ones(len(order), dtype=bool)
    hashes, owner = words.hashes[order], words.text_of[order]
    fresh[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
    distinct = np.bincount(owner[fresh], minlength=texts)
    last, first = words.data[words.end - 1], words.data[words.start]
    columns = (
        np.log1p(n), share(per_word(lengths), n), longest, share(per_text(UPPER[words.data]), size),
        share(per_text(DIGITS[words.data]), size), share(per_text(SYMBOLS[words.data]), size),
        share(per_text(MARKS[words.data]), size), share(per_text(words.data >= 128), size),
        share(distinct, n), share(repeated_words(words), n), share(n, 1 + per_text(words.data == 10)),
        share(per_word(ENDS[last]), n), share(per_word(UPPER[first]), n),
        share(per_word(SYMBOLS[last] | (last == 33)), n),
    )
    return np.column_stack(columns)


def map_features(docs: DataFrame, carried: str, use, schema: str) -> DataFrame:
    """Runs ``use(features) -> columns`` on blocks of texts; ``carried`` columns come first in ``schema``."""
    names = [x.split()[0] for x in schema.split(", ")]
    columns = carried.split()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for words in blocks(batch.column(len(columns))):
                kept = [batch.column(k).slice(words.rows.start, len(words.rows)) for k in range(len(columns))]
                yield pa.RecordBatch.from_arrays([*kept, *use(text_features(words))], names=names)

    return docs.select(*columns, "text").mapInArrow(run, schema)
