"""Token ids of whole texts, by the tokenizers library, with words remembered.

The vocabulary's tokenizer is read from a file whose path is a parameter.  Where it is a
word-level BPE (text split at white space, runs of letters apart from everything else, lower
case), the ids of a text are those of its white-space-separated words one after the other, so
each word is encoded once per worker and remembered.  Any other tokenizer encodes whole texts.
"""

from __future__ import annotations

import json
import os
import struct

import numpy as np

# What the word-level tokenizer files declare.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
WORD_NORMALIZERS = ["NFC", "Replace", "Lowercase"]

# Words remembered at a time; as many again from before are kept for those that come back.
REMEMBERED = 500_000


def _is_word_level(described: dict) -> bool:
    normal = described.get("normalizer") or {}
    steps = [x.get("type") for x in normal.get("normalizers", [])]
    parts = (described.get("pre_tokenizer") or {}).get("pretokenizers", [])
    pattern = parts[0].get("pattern", {}).get("Regex") if parts else None
    return (steps == WORD_NORMALIZERS and pattern == WORD_PATTERN
            and [p.get("type") for p in parts] == ["Split", "ByteLevel"]
            and described.get("post_processor") is None)


def _byte_letters() -> dict[int, str]:
    """The letter by which byte-level vocabularies write each byte."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class _Words(dict):
    """word (bytes) -> ids as little-endian bytes; when full, forgets what was long not met."""

    def __init__(self, tokenizer, width: str):
        self.tokenizer, self.width = tokenizer, width
        self.model, self.letters = tokenizer.model, str.maketrans(_byte_letters())
        self.ends: dict[int, bytes] = {}
        self.before: dict[bytes, bytes] = {}
        self.code = {"<u2": "H", "<u4": "I"}[width]

    def __missing__(self, word: bytes) -> bytes:
        ids = self.before.get(word) or self._ids(word)
        if len(self) >= REMEMBERED:
            self.before = dict(self)
            self.clear()
        self[word] = ids
        return ids

    def _packed(self, ids: list[int]) -> bytes:
        return struct.pack(f"<{len(ids)}{self.code}", *ids)

    def _with_end(self, word: bytes) -> bytes:
        end = self.ends.get(word[-1])
        if end is None:
            end = self.ends[word[-1]] = self._packed(
                self.tokenizer.encode(chr(word[-1]), add_special_tokens=False).ids)
        return self[word[:-1]] + end

    def _ids(self, word: bytes) -> bytes:
        # ASCII letters, by far the most, need no decoding: vocabularies write them as they are.
        if word.isalpha():
            low = word.lower()
            if low != word:
                return self[low]
            return self._packed([t.id for t in self.model.tokenize(word.decode("ascii"))])
        # A full stop or comma after a letter is always a piece of its own.
        if word[-1] in b".," and word[-2:-1].isalpha():
            return self._with_end(word)
        text = word.decode("utf-8", "replace")
        # (Not after U+0130, whose lower case ends in a combining dot.)
        if (len(text) > 1 and text[-1] in ".," and text[-2].isalpha() and text[-2] < "ɐ"
                and text[-2] != "\u0130"):
            return self._with_end(word)
        # Letters below U+0100 are composed and have a lower case of one letter: one piece.
        if text.isalpha() and max(text) < "Ā":
            low = text.lower()
            if low != text:
                return self[low.encode()]
            piece = word.decode("latin-1").translate(self.letters)
            return self._packed([t.id for t in self.model.tokenize(piece)])
        return self._packed(self.tokenizer.encode(text, add_special_tokens=False).ids)


class TextEncoder:
    """``encode(text as UTF-8 bytes or None)`` gives ids as little-endian bytes, end id included.

    Ids take two bytes each where the vocabulary has at most 65,536 of them, else four.
    """

    def __init__(self, path: str, end_id: int):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        with open(path, encoding="utf-8") as file:
            described = json.load(file)
        self.tokenizer = Tokenizer.from_file(path)
        size = max(self.tokenizer.get_vocab_size(with_added_tokens=True), end_id + 1)
        self.width = "<u2" if size <= 1 << 16 else "<u4"
        self.end = np.array([end_id], dtype=self.width).tobytes()
        self.words = _Words(self.tokenizer, self.width) if _is_word_level(described) else None

    def encode(self, text: bytes | None) -> bytes:
        if not text:
            return self.end
        if self.words is not None:
            return b"".join(map(self.words.__getitem__, text.split())) + self.end
        ids = self.tokenizer.encode(text.decode("utf-8", "replace"), add_special_tokens=False).ids
        return np.array(ids, dtype=self.width).tobytes() + self.end


_encoders: dict[tuple[str, int], TextEncoder] = {}


def encoder(path: str, end_id: int) -> TextEncoder:
    """The worker's encoder; a Python worker that runs several tasks keeps it."""
    if (path, end_id) not in _encoders:
        _encoders[path, end_id] = TextEncoder(path, end_id)
    return _encoders[path, end_id]
