"""SentencePiece encoding and decoding with the pieces and scores of a public model.

An Aho-Corasick automaton over the pieces reads the text once; at each position its output links name the pieces that
end there, and the Viterbi pass relaxes the best score at that position over them. Pieces never span the place
between a letter and a following space mark, so texts fall into chunks that are encoded independently; equal chunks
are encoded once. The relaxations of many chunks run side by side in NumPy. Letters outside the vocabulary become
byte pieces, so decoding gives back the exact text.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .pieces import default_path, load

MARK = "▁"
#: Stand-ins that no text can hold: between chunks, and for a mark that the text itself holds.
BETWEEN, LITERAL = "\udc80", "\udc81"
#: The first chunks that a worker meets are remembered, up to this number.
MEMO_CHUNKS = 400_000
BATCH = 1000
CELLS = 400_000
CHUNK = re.compile(f"{MARK}+[^{MARK}]*")


class Codec:
    def __init__(self, path: str) -> None:
        import ahocorasick

        v = load(path)
        self.texts, self.bytes_, self.byte_of = v.texts, v.bytes_, v.byte_of
        self.longest = max(map(len, v.ids))
        self.scores = np.full(len(v.texts) + 2, -np.inf)  # the last stands for no piece
        self.automaton = ahocorasick.Automaton()
        for piece, k in v.ids.items():
            self.scores[k] = v.scores[piece]
            self.automaton.add_word(piece, k * 64 + len(piece))
        self.automaton.make_automaton()
        #: The score of a letter outside the vocabulary lies below every ordinary piece's.
        self.unknown = len(v.texts)
        self.scores[self.unknown] = min(s for s in v.scores.values() if s > -1e8) - 10.0
        self.memo: dict[str, bytes] = {}

    def chunks(self, text: str) -> list[str]:
        return CHUNK.findall(MARK + text.replace(MARK, LITERAL).replace(" ", MARK))

    def best(self, chunks: list[str]) -> list[bytes]:
        """Ids (little-endian 32 bits) of the best segmentation of each chunk; a tie takes the longer last piece."""
        lengths = np.array([len(c) for c in chunks])
        starts = np.concatenate([[0], np.cumsum(lengths + 1)])
        longest, width = int(lengths.max()), min(self.longest, int(lengths.max()))
        found = np.fromiter(chain.from_iterable(self.automaton.iter(BETWEEN.join(chunks))), np.int64)
        ids = np.full((width, len(chunks), longest), -1, np.int32)
        ids[0] = np.where(np.arange(longest)[None, :] < lengths[:, None], self.unknown, -1)
        if len(found):
            end, (k, n) = found[::2], np.divmod(found[1::2], 64)
            begin = end - n + 1
            row = np.searchsorted(starts, begin, "right") - 1
            ids[n - 1, row, begin - starts[row]] = k
        present = (ids >= 0).any(axis=1)
        score = np.full((len(chunks), longest + 1), -np.inf)
        score[:, 0] = 0.0
        took = np.zeros((len(chunks), longest + 1), np.int8)
        for e in range(1, longest + 1):
            top, by = score[:, e], took[:, e]
            for n in range(min(width, e), 0, -1):
                if present[n - 1, e - n]:
                    value = score[:, e - n] + self.scores[ids[n - 1, :, e - n]]
                    better = value > top
                    np.copyto(top, value, where=better)
                    by[better] = n
        steps, at, rows = [], lengths.copy(), np.arange(len(chunks))
        while (live := at > 0).any():
            n = took[rows, at]
            steps.append(np.where(live, ids[n - 1, rows, np.maximum(at - n, 0)], -1))
            at = np.where(live, at - n, at)
        path = np.array(steps[::-1]).T
        flat, ends = path[path >= 0].astype("<u4").tobytes(), np.cumsum((path >= 0).sum(axis=1)) * 4
        out = [flat[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]
        for i in np.flatnonzero((path == self.unknown).any(axis=1)):
            out[i] = self.with_bytes(chunks[i], out[i])
        return out

    def with_bytes(self, chunk: str, ids: bytes) -> bytes:
        """ids of a chunk with byte pieces for its letters outside the vocabulary."""
        out, at = [], 0
        for k in np.frombuffer(ids, "<u4").tolist():
            if k == self.unknown:
                letter = MARK if chunk[at] == LITERAL else chunk[at]
                out += [self.bytes_[b] for b in letter.encode()]
                at += 1
            else:
                out.append(k)
                at += len(self.texts[k])
        return np.array(out, "<u4").tobytes()

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text; a null or empty text has none."""
        parts = [self.chunks(t) if t else [] for t in texts]
        memo = self.memo
        new = sorted({c for p in parts for c in p}.difference(memo), key=len)
        k = 0
        while k < len(new):
            n = 6000
            while n > 1 and len(new[min(k + n, len(new)) - 1]) * n > CELLS:
                n //= 2
            some = new[k : k + n]
            memo.update(zip(some, self.best(some), strict=True))
            k += n
        out = [b"".join([memo[c] for c in p]) for p in parts]
        for c in new[max(0, len(new) - max(0, len(memo) - MEMO_CHUNKS)) :]:
            del memo[c]
        return out

    def decode(self, ids: bytes) -> str:
        """The text of ids, whose first space mark stands for no letter."""
        out: list[bytes] = []
        for k in np.frombuffer(ids, "<u4").tolist():
            b = self.byte_of.get(k)
            out.append(self.texts[k].replace(MARK, " ").encode() if b is None else bytes([b]))
        return b"".join(out).decode("utf-8", "replace")[1:]


_CODECS: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    if path not in _CODECS:
        _CODECS[path] = Codec(path)
    return _CODECS[path]


def encode(docs: DataFrame, path: str | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and `ids`, the piece ids of the whole text as an array; null and empty texts have an empty array."""
    path = path or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, BATCH):
                batch = whole.slice(k, BATCH)
                coded = codec(path).encode(batch.column(1).to_pylist())
                ends = np.cumsum([0, *(len(b) // 4 for b in coded)]).astype(np.int32)
                ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(coded), "<i4")))
                yield pa.record_batch([batch.column(0), ids], ["doc_id", "ids"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, ids array<int>")


def decode(coded: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and text of rows (doc_id, ids)."""
    path = path or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [codec(path).decode(np.array(ids or [], "<u4").tobytes()) for ids in batch.column(1).to_pylist()]
            yield pa.record_batch([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return coded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def digests(docs: DataFrame, path: str | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of docs: the number of pieces, the checksum of their ids, and whether decoding gives the text again.

    Null and empty texts have no pieces and decode to the empty text. Repeated rows are coded separately; an empty
    table gives an empty result; other columns aren't read.
    """
    path = path or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for whole in batches:
            for k in range(0, whole.num_rows, BATCH):
                batch = whole.slice(k, BATCH)
                texts = batch.column(1).to_pylist()
                coded = c.encode(texts)
                cols = [pa.array([len(b) // 4 for b in coded], pa.int64()), pa.array([zlib.crc32(b) for b in coded], pa.int64()), pa.array([c.decode(b) == (t or "") for b, t in zip(coded, texts, strict=True)], pa.bool_())]
                yield pa.record_batch([batch.column(0), *cols], ["doc_id", "n_pieces", "ids_crc32", "round_trip"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, n_pieces long, ids_crc32 long, round_trip boolean")
