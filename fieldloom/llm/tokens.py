"""Token ids in tasks: one tokenizer a worker process, with a bounded memory of the pieces it has met."""

from __future__ import annotations

import json
import re
from functools import lru_cache
from struct import pack

import numpy as np

#: Pieces that a worker remembers at most; later ones are encoded each time.
MEMORY = 200_000
#: The one layout of file for which pieces are known to be encoded independently of their surroundings.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Texts with other characters than these go whole to the tokenizer, which then normalises them itself.
ODD = re.compile(r"[^\t-\r\x20-\x7e¡-įı-ňŊ-ž‐-‧€]|<\|")


#: SPLIT for lower-cased text without odd characters, where it has the same pieces.
PLAIN = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zªµºß-öø-ž]+|[0-9²³¹¼½¾]|[^\sa-zªµºß-öø-ž0-9²³¹¼½¾]+")


def _byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies: itself where it prints, else the next unused one from 256 on."""
    prints = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, free = [""] * 256, 256
    for b in range(256):
        if b in prints:
            out[b] = chr(b)
        else:
            out[b], free = chr(free), free + 1
    return out


class _Pieces(dict):
    def __init__(self, tokenizer) -> None:
        super().__init__()
        self.model, self.letters = tokenizer.model, _byte_letters()

    def __missing__(self, piece: str) -> bytes:
        written = piece if piece.isascii() else "".join(map(self.letters.__getitem__, piece.encode()))
        ids = [t.id for t in self.model.tokenize(written)]
        out = pack(f"<{len(ids)}I", *ids)
        if len(self) < MEMORY:
            self[piece] = out
        return out


class WordPieceMemory:
    """encode(text) gives the ids that the tokenizer gives, as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        spec = json.loads(self.tokenizer.to_str())
        kinds = [n["type"] for n in (spec["normalizer"] or {}).get("normalizers", [])]
        first = ((spec["pre_tokenizer"] or {}).get("pretokenizers") or [{}])[0]
        self.apart = kinds == ["NFC", "Replace", "Lowercase"] and first.get("pattern", {}).get("Regex") == SPLIT and spec["post_processor"] is None
        self.ids = _Pieces(self.tokenizer).__getitem__

    def encode(self, text: str) -> bytes:
        if self.apart and not ODD.search(text):
            return b"".join(map(self.ids, PLAIN.findall(text.lower())))
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


@lru_cache(maxsize=4)
def word_tokenizer(path: str) -> WordPieceMemory:
    return WordPieceMemory(path)


@lru_cache(maxsize=4)
def byte_encoding(path: str, pattern: str):
    """A byte-level encoding of a rank file, and the length in bytes of each id."""
    import base64

    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    lengths = np.zeros(max(ranks.values()) + 1, np.int64)
    for token, i in ranks.items():
        lengths[i] = len(token)
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), lengths
