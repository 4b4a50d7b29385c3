"""Token counts of the sections of a document, from one encoding of the whole document.

Each document is encoded once. The byte widths of its tokens give their character spans, and these are joined to the
spans of the sections by binary search. A token that crosses a boundary goes to one section by the stated rule:
`majority` (the section with most of its characters, the first on ties), `start`, or `end`. So the counts of a
document's sections add up to its tokens.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokens import coder, default_path

RULES = ("majority", "start", "end")
RESULT = "doc_id long, section int, start long, end long, n_tokens long, n_crossing long"


def spans(text: str, widths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first, last) character of each token of text, whose UTF-8 bytes the tokens cut into widths."""
    data = np.frombuffer(text.encode(), np.uint8)
    letter = np.cumsum((data & 0xC0) != 0x80) - 1
    ends = np.cumsum(widths)
    return letter[ends - widths], letter[ends - 1]


def line_starts(text: str) -> np.ndarray:
    """Starts of the lines of text; a line holds its line feed."""
    letters = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    starts = np.concatenate([[0], np.flatnonzero(letters == 10) + 1])
    return starts[starts < max(1, len(letters))]


def allotted(first: np.ndarray, last: np.ndarray, starts: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """The section of each token, and whether it crosses a boundary. starts: where sections begin, the first at 0."""
    a, b = np.searchsorted(starts, first, "right") - 1, np.searchsorted(starts, last, "right") - 1
    crossing = a != b
    if rule == "end":
        return b, crossing
    out = a.copy()
    if rule == "majority":
        for t in np.flatnonzero(crossing):
            cuts = np.concatenate([[first[t]], starts[a[t] + 1 : b[t] + 1], [last[t] + 1]])
            out[t] = a[t] + int(np.diff(cuts).argmax())
    return out, crossing


def attribute(docs: DataFrame, tokenizer: str | None = None, rule: str = "majority", doc_id: str = "doc_id", text: str = "text", starts: str | None = None) -> DataFrame:
    """One row for each section of each row of docs: its character span and its tokens.

    Sections are the lines, or begin at the sorted offsets of the array column `starts` (0 is added). A null or empty
    text has one empty section without tokens. Repeated rows are counted separately; an empty table gives an empty
    result; other columns aren't read.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    path = tokenizer or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = coder(path)
        widths = code.widths()
        for whole in batches:
            for k in range(0, whole.num_rows, 200):
                batch = whole.slice(k, 200)
                ids, texts, given = (batch.column(c).to_pylist() for c in range(3))
                owner, cols = [], []
                for i, t, s in zip(ids, texts, given, strict=True):
                    t = t or ""
                    begin = line_starts(t) if s is None else np.unique([0, *(x for x in s if x is not None and 0 < x < len(t))])
                    n, cross = np.zeros(len(begin), np.int64), np.zeros(len(begin), np.int64)
                    if t:
                        at, crossing = allotted(*spans(t, widths[code.encode(t)]), begin, rule)
                        n, cross = np.bincount(at, minlength=len(begin)), np.bincount(at[crossing], minlength=len(begin))
                    owner += [i] * len(begin)
                    cols.append((np.arange(len(begin)), begin, np.append(begin[1:], len(t)), n, cross))
                if cols:
                    parts = [np.concatenate(c) for c in zip(*cols, strict=True)]
                    kinds = [pa.int32()] + [pa.int64()] * 4
                    yield pa.record_batch([pa.array(owner, pa.int64()), *(pa.array(p, t) for p, t in zip(parts, kinds, strict=True))], [c.split()[0] for c in RESULT.split(", ")])

    given = F.col(starts).cast("array<long>") if starts else F.lit(None).cast("array<long>")
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), given.alias("starts")).mapInArrow(run, RESULT)
