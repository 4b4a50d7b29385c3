"""Token ids of whole texts by a byte-level BPE."""

from __future__ import annotations

import base64
import functools
import json
import os
import re

import numpy as np

_CODERS: dict[str, "Coder"] = {}


class Coder:
    """Ids of a text as little-endian unsigned 32-bit numbers.

    The vocabulary is a tokenizers file (.json) or a file of ranks (.tiktoken); both give the same ids where they hold
    the same vocabulary, the second faster. Strings of special tokens are ordinary text.
    """

    def __init__(self, path: str) -> None:
        self.path = path
        if path.endswith(".tiktoken"):
            import public_tokenizers
            import tiktoken

            with open(path, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.tokens = {k: len(b) for b, k in ranks.items()}
            self.plain = tiktoken.Encoding("words", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        else:
            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            from tokenizers import Tokenizer

            tokenizer = Tokenizer.from_file(path)
            tokenizer.encode_special_tokens = True
            self.tokens = {k: len(b) for b, k in tokenizer.get_vocab().items()}  # a letter stands for a byte
            self.plain = lambda text: tokenizer.encode(text, add_special_tokens=False).ids

    def encode(self, text: str | None, special: dict[str, int] | None = None) -> np.ndarray:
        """Ids of text; strings in special get the ids given there instead of those of ordinary text."""
        if not text or not special or not any(k in text for k in special):
            return np.array(self.plain(text) if text else [], "<u4")
        ids: list[int] = []
        for k, part in enumerate(re.split(f"({'|'.join(map(re.escape, special))})", text)):
            ids += [special[part]] if k % 2 else self.plain(part) if part else []
        return np.array(ids, "<u4")

    def widths(self) -> np.ndarray:
        """The number of bytes of each token."""
        out = np.zeros(max(self.tokens) + 1, np.int64)
        out[list(self.tokens)] = list(self.tokens.values())
        return out


def coder(path: str) -> Coder:
    if path not in _CODERS:
        _CODERS[path] = Coder(path)
    return _CODERS[path]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


@functools.lru_cache
def special_tokens(path: str | None = None) -> dict[str, int]:
    """The added tokens of a tokenizers file, by default that of the vocabulary of default_path()."""
    import public_tokenizers

    with open(path or public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        return {t["content"]: t["id"] for t in json.load(f)["added_tokens"]}
