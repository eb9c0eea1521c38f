"""Token counts by section: offset-mapped attribution.

A document is encoded once, as a whole. Byte lengths of its tokens give their character spans, and an interval join (binary
search of token starts among section starts, both ascending) gives each token to a section. A token that crosses a boundary
goes by a stated rule: `first` to the section of its first character, `largest` to the section that holds most of its
characters, of equals the earliest.

Sections are the lines of a text, each with its line feed; any other ascending starts may be given to `attribute`.

Cases. Null and empty texts have one empty section without tokens. Very long texts are encoded whole. Repeated rows are counted each
for itself; a null doc_id stays null. An empty table gives an empty result. Further columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from offerlens.llm.common import portions, text_column
from offerlens.llm.tokens import encoder, tokenizer_path

COUNTS = "doc_id long, section int, start long, end long, n_tokens long, n_crossing long"


def line_starts(text: str) -> np.ndarray:
    out, at = [0], text.find("\n")
    while 0 <= at < len(text) - 1:
        out.append(at + 1)
        at = text.find("\n", at + 1)
    return np.array(out, dtype=np.int64)


def token_spans(text: str, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First character and one past the last character of tokens with these byte lengths, which cover the text."""
    ends = np.cumsum(lengths)
    if text.isascii():
        return ends - lengths, ends
    raw = np.frombuffer(text.encode(), dtype=np.uint8)
    char = np.cumsum((raw & 0xC0) != 0x80) - 1
    return char[ends - lengths], char[ends - 1] + 1


def attribute(starts: np.ndarray, begin: np.ndarray, end: np.ndarray, size: int, rule: str = "first") -> tuple[np.ndarray, np.ndarray]:
    """Section of each token [begin, end), given ascending section starts of a text with `size` characters; and whether it crosses."""
    first = np.searchsorted(starts, begin, "right") - 1
    last = np.searchsorted(starts, end - 1, "right") - 1
    crosses = last > first
    if rule == "largest" and crosses.any():
        edges = np.append(starts, size)
        first = first.copy()
        for k in np.flatnonzero(crosses):
            spans = range(first[k], last[k] + 1)
            first[k] = max(spans, key=lambda s: (min(end[k], edges[s + 1]) - max(begin[k], edges[s]), -s))
    elif rule not in ("first", "largest"):
        raise ValueError(f"no such rule: {rule}")
    return first, crosses


def count_tokens(docs: DataFrame, path: str | None = None, rule: str = "first", sections=line_starts) -> DataFrame:
    """COUNTS: a row for each section of each document."""
    path = path or tokenizer_path()
    attribute(np.zeros(1, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), 0, rule)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        size = np.array([len(t) for t in own.vocabulary.tokens], dtype=np.int64)
        for batch in portions(batches):
            parts = []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                starts = sections(text)
                n = len(starts)
                if not text:
                    parts.append((key, starts, np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)))
                    continue
                section, crosses = attribute(starts, *token_spans(text, size[own.encode(text)]), len(text), rule)
                parts.append((key, starts, np.append(starts[1:], len(text)), np.bincount(section, minlength=n), np.bincount(section[crosses], minlength=n)))
            if parts:
                sizes = [len(p[1]) for p in parts]
                keys = pa.array([p[0] for p in parts], pa.int64()).take(pa.array(np.repeat(np.arange(len(parts)), sizes)))
                number = np.concatenate([np.arange(n, dtype=np.int32) for n in sizes])
                yield pa.RecordBatch.from_arrays([keys, pa.array(number), *(pa.array(np.concatenate([p[k] for p in parts]).astype(np.int64)) for k in range(1, 5))], [c.split()[0] for c in COUNTS.split(", ")])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_column(docs)).mapInArrow(run, COUNTS)
