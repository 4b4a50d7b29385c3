"""SentencePiece vocabularies, read from the model file's public protobuf layout."""

from __future__ import annotations

from dataclasses import dataclass, field


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        b = data[at]
        at += 1
        value |= (b & 127) << shift
        if b < 128:
            return value, at
        shift += 7


def _fields(data: bytes):
    at = 0
    while at < len(data):
        tag, at = _varint(data, at)
        number, kind = tag >> 3, tag & 7
        if kind == 0:
            value, at = _varint(data, at)
        elif kind == 2:
            n, at = _varint(data, at)
            value, at = data[at : at + n], at + n
        else:
            n = 4 if kind == 5 else 8
            value, at = data[at : at + n], at + n
        yield number, value


@dataclass
class Vocabulary:
    """Pieces of a model: ordinary ones by text, the byte pieces by value, and the unknown piece's id."""

    ids: dict[str, int] = field(default_factory=dict)
    scores: dict[str, float] = field(default_factory=dict)
    texts: list[str] = field(default_factory=list)
    bytes_: dict[int, int] = field(default_factory=dict)
    byte_of: dict[int, int] = field(default_factory=dict)


NORMAL, BYTE = 1, 6


def load(path: str) -> Vocabulary:
    import struct

    out = Vocabulary()
    with open(path, "rb") as f:
        data = f.read()
    for number, value in _fields(data):
        if number != 1:
            continue
        text, score, kind = "", 0.0, NORMAL
        for n, v in _fields(value):
            if n == 1:
                text = v.decode()
            elif n == 2:
                score = struct.unpack("<f", v)[0]
            elif n == 3:
                kind = v
        k = len(out.texts)
        out.texts.append(text)
        if kind == BYTE:
            out.bytes_[int(text[3:5], 16)] = k
            out.byte_of[k] = int(text[3:5], 16)
        elif kind == NORMAL:
            out.ids[text] = k
            out.scores[text] = score
    return out


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")
