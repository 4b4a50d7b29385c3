"""Readers of form annotations: levelled event tables with repeat shorthand, and bracketed trees.

The rows of one file depend on earlier rows, so a file is parsed by one small function; files spread over tasks.
"""

from __future__ import annotations

import csv
import io
import re
from dataclasses import dataclass, replace

import pandas as pd
from pyspark.sql import DataFrame

# The forms of a measure token.
PLAIN = re.compile(r"\s*(\d+)[a-z]?\s*", re.I)
COPY = re.compile(r"\s*(\d+)(?:-(\d+))?\s*=\s*(\d+)(?:-(\d+))?\s*")
REPEAT = re.compile(r"\s*Repeat:\s*(\d+)(?:-(\d+))?\s*", re.I)

EVENTS = "piece string, measure int, beat string, level int, label string, provenance string, source_measure int, last_measure int, issue string"


@dataclass(frozen=True)
class Line:
    """A line of a form table: what its token says, the measures [to, end] it is about, and its cells."""

    number: int
    kind: str
    to: int = 0
    end: int = 0
    source: tuple[int, int] | None = None
    cells: tuple[str, ...] = ()
    issue: str | None = None

    @property
    def labels(self) -> dict[int, str]:
        """The labels by level; blank ones are none."""
        return {level: c for level, c in enumerate(self.cells[1:], 1) if c and c.lower() != "nan"}


def line_of(number: int, cells: list[str]) -> Line:
    token, rest = cells[0], tuple(cells[1:])
    for kind, pattern in (("plain", PLAIN), ("copy", COPY), ("repeat", REPEAT)):
        if m := pattern.fullmatch(token):
            first, last, *source = (int(x) if x else None for x in (*m.groups(), None)[: 4 if kind == "copy" else 2])
            end = last or first
            if kind != "copy":
                return Line(number, kind, first, end, cells=rest)
            begin, stop = source[0], source[1] or source[0]
            fault = "the ranges differ in length" if stop - begin != end - first else "it copies from itself or later" if begin >= first else None
            return Line(number, kind, first, end, (begin, stop), rest, fault and f"line {number}: {fault}")
    return Line(number, "unknown", issue=f"line {number}: {token!r} names no measure")


def form_events(piece: str, text: str) -> list[tuple]:
    """Events by measure and level; a copied range fills only free places. Tokens that don't parse become issues.

    Lines are parsed first; then each adds a layer to the levels of its measures. Of a copied layer the levels that a
    measure has stay as they are, a line's own labels replace them.
    """
    lines = [line_of(k, row) for k, row in enumerate(([c.strip() for c in row] for row in csv.reader(io.StringIO(text)) if row), 1)]
    if lines and lines[0].kind == "unknown":  # a header
        lines = [replace(x, number=x.number - 1, issue=x.issue and x.issue.replace(f"line {x.number}:", f"line {x.number - 1}:")) for x in lines[1:]]
    measures: dict[int, dict[int, tuple]] = {}
    good = [x for x in lines if not x.issue]
    for x in good:
        if x.source:
            layers = {x.to + m - x.source[0]: {level: (beat, label, "copy", m) for level, (beat, label, *_) in measures[m].items()} for m in range(x.source[0], x.source[1] + 1) if m in measures}
            for m, layer in layers.items():
                measures[m] = layer | measures.get(m, {})
        if x.kind != "repeat":
            beat = x.cells[0] if x.cells else ""
            measures[x.to] = measures.get(x.to, {}) | {level: (beat, label, "explicit", None) for level, label in x.labels.items()}
    last = max((x.end for x in good), default=0)
    rows = [(piece, m, beat, level, label, how, source, last, None) for m in sorted(measures) for level, (beat, label, how, source) in sorted(measures[m].items())]
    return rows + [(piece, None, None, None, None, None, None, last, x.issue) for x in lines if x.issue]


def read_forms(texts: DataFrame) -> DataFrame:
    """Event rows of texts (piece, value), and a row with `issue` for each token that doesn't parse."""

    def run(batches):
        for f in batches:
            rows = [r for p, v in zip(f["piece"], f["value"], strict=True) for r in form_events(p, v)]
            out = pd.DataFrame(rows, columns=[c.split()[0] for c in EVENTS.split(", ")])
            yield out.astype({c: "Int32" for c in ("measure", "level", "source_measure", "last_measure")})

    return texts.select("piece", "value").mapInPandas(run, EVENTS)


TREE = "piece string, node int, parent int, level int, label string, start int, end int"


def form_tree(piece: str, events: list[tuple[int, int, str]], last: int) -> list[tuple]:
    """Preorder nodes of events (measure, level, label): an event closes open nodes of its level and below."""
    rows = [[piece, 0, None, 0, "ROOT", 1, last]]
    open_: list[list] = [rows[0]]
    for measure, level, label in events:
        while open_[-1][3] >= level:
            done = open_.pop()
            done[6] = max(done[5], measure - 1)
        node = [piece, len(rows), open_[-1][1], level, label, measure, last]
        rows.append(node)
        open_.append(node)
    return [tuple(r) for r in rows]


def form_trees(events: DataFrame) -> DataFrame:
    """Node rows of each piece's events; pieces with an issue have no tree."""

    def run(key: tuple, f: pd.DataFrame) -> pd.DataFrame:
        rows = [] if f["issue"].notna().any() else form_tree(key[0], list(f.sort_values(["measure", "level"])[["measure", "level", "label"]].itertuples(index=False, name=None)), int(f["last_measure"].max()))
        return pd.DataFrame(rows, columns=[c.split()[0] for c in TREE.split(", ")]).astype({"parent": "Int32"})

    return events.groupBy("piece").applyInPandas(run, TREE)


def brackets(piece: str, text: str) -> list[tuple]:
    """Preorder (piece, node, parent, level, label) of a bracketed tree; words after a label are its leaves."""
    rows: list[tuple] = []
    stack: list[int] = []
    named = True
    for token in re.findall(r"[\[\]]|[^\s\[\]]+", text):
        if token == "[":
            named = False
        elif token == "]":
            if not stack:
                raise ValueError("a bracket closes that was not opened")
            stack.pop()
        else:
            rows.append((piece, len(rows), stack[-1] if stack else None, len(stack), token))
            if not named:
                stack.append(len(rows) - 1)
                named = True
    if stack:
        raise ValueError("a bracket is not closed")
    return rows


def read_brackets(texts: DataFrame) -> DataFrame:
    """Node rows of bracketed trees (piece, value)."""

    def run(batches):
        for f in batches:
            rows = [r for p, v in zip(f["piece"], f["value"], strict=True) for r in brackets(p, v)]
            yield pd.DataFrame(rows, columns=["piece", "node", "parent", "level", "label"]).astype({"parent": "Int32"})

    return texts.select("piece", "value").mapInPandas(run, "piece string, node int, parent int, level int, label string")
