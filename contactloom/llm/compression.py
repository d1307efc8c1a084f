"""Quality rules by compression: zstandard ratios of whole texts and of fixed chunks.

A ratio is compressed bytes over raw bytes. Repetitive text falls below its band, noise such as
base64 or keys lies above. Small inputs compress worse, so each length class has its own limits.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from contactloom.llm.words import blocks, window_hashes

SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "whole_ratio double, low_chunks long, high_chunks long, n_chunks long, base_failed boolean, kept boolean"
)


@dataclass(frozen=True)
class Limits:
    """Bands by size in bytes: (size below which the row holds, lowest ratio, highest ratio).

    A text is rejected if its whole ratio lies outside its band, or if more than ``share`` of its
    chunks of ``chunk`` bytes do (a last chunk of less than half that size is judged with the text
    alone). A text without bytes has ratio 1 and no chunk. The highest ratios lie between those of the
    texts of sf0.01 and sf0.1 with 50 words or more (0.75 at most from 256 bytes on, 0.48 from 4,096)
    and those of base64 in words of 8 to 16 characters (0.90 at least up to 320 bytes, 0.745 from 4,096).
    """

    bands: tuple[tuple[float, float, float], ...] = (
        (128, 0.30, 1.05),
        (192, 0.30, 0.95),
        (256, 0.30, 0.89),
        (320, 0.22, 0.83),
        (384, 0.22, 0.82),
        (512, 0.22, 0.79),
        (640, 0.22, 0.77),
        (768, 0.22, 0.755),
        (1024, 0.22, 0.73),
        (1536, 0.18, 0.70),
        (2048, 0.18, 0.69),
        (3072, 0.18, 0.68),
        (4096, 0.18, 0.67),
        (float("inf"), 0.15, 0.67),
    )
    chunk: int = 4096
    share: float = 0.5
    level: int = 3
    min_words: int = 50
    symbols: bytes = b"#*$%&|<>"

    def outside(self, size: int, ratio: float) -> int:
        """-1 below, 1 above, 0 inside the band."""
        low, high = next((a, b) for most, a, b in self.bands if size < most)
        return (ratio > high) - (ratio < low)


def repeated_lines(text: str) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [x for x in text.split("\n") if x.strip(" \t\n\v\f\r")]
    return len(lines) - len(set(lines))


def repeated_words(words) -> np.ndarray:
    """For each text of a block: words in 3-word windows that the text has twice or more."""
    text_of, n = words.text_of, len(words.start)
    if n < 3:
        return np.zeros(len(words.rows), dtype=np.int64)
    inside = np.flatnonzero(text_of[:-2] == text_of[2:])
    windows = window_hashes(words.hashes, 3)[inside]
    order = np.lexsort((windows, text_of[inside]))
    same = (windows[order][1:] == windows[order][:-1]) & (text_of[inside][order][1:] == text_of[inside][order][:-1])
    twice = np.zeros(len(inside), dtype=bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    covered = np.zeros(n, dtype=bool)
    for k in range(3):
        covered[inside[twice] + k] = True
    return np.bincount(text_of[covered], minlength=len(words.rows))


def compression_rules(docs: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """One row per document with counts, ratios, ``base_failed`` and ``kept``.

    A null text is empty: no words, so it fails the base rule. Null and repeated ids are carried
    along; other columns are ignored. Ratios exactly on a limit pass.
    """

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(level=limits.level)
        ratio = lambda raw: len(packer.compress(raw)) / len(raw) if len(raw) else 1.0
        symbols = np.zeros(256, dtype=bool)
        symbols[list(limits.symbols)] = True
        for batch in batches:
            ids = batch.column(0)
            for words in blocks(batch.column(1)):
                rows, n = [], words.counts
                starts = (words.data & 0xC0) != 0x80
                chars = np.concatenate(([0], np.cumsum(starts)))
                first = words.first
                in_words = np.concatenate(([0], np.cumsum(chars[words.end] - chars[words.start])))
                marks = np.concatenate(([0], np.cumsum(symbols[words.data])))
                repeats = repeated_words(words)
                for k, row in enumerate(words.rows):
                    a, b = int(words.bounds[k]), int(words.bounds[k + 1])
                    raw = words.data[a:b].tobytes()
                    whole = ratio(raw)
                    parts = (raw[at : at + limits.chunk] for at in range(0, len(raw), limits.chunk))
                    sides = [limits.outside(len(x), ratio(x)) for x in parts if 2 * len(x) >= limits.chunk]
                    low, high = sides.count(-1), sides.count(1)
                    failed = bool(n[k] < limits.min_words or 100 * repeats[k] > 50 * n[k])
                    good = limits.outside(b - a, whole) == 0 and low + high <= limits.share * len(sides)
                    rows.append(
                        (int(n[k]), int(in_words[first[k + 1]] - in_words[first[k]]), int(marks[b] - marks[a]),
                         repeated_lines(raw.decode()), int(repeats[k]), whole, low, high, len(sides), failed,
                         bool(not failed and good))
                    )
                columns = [pa.array(x) for x in zip(*rows)]
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(words.rows.start, len(words.rows)), *columns],
                    names=[part.split()[0] for part in SCHEMA.split(", ")],
                )

    return docs.select("doc_id", "text").mapInArrow(judge, SCHEMA)
