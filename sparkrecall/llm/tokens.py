"""Encodes whole texts with the tokenizers library.

`Encoder.spans` hands whole texts to the library and takes its tokens' character spans. `Encoder.ids` does so too,
but for the lower-casing word BPE, whose steps are known: it drops white space before it merges, and none of its
normaliser, pattern and merge steps looks across white space, so the ids of a text are the ids of its words in order,
and a word met before need not be encoded again. An encoder looks at its tokenizer's own description and takes the
short way for this one only; `tests/llm/test_tokens.py` holds both against encoding whole texts.

The library holds about 200 bytes for each byte of a text while it encodes it. So a text of more than `PART_CHARS`
goes through in parts where the tokenizer is known not to look over the cut: before a space between two letters, or behind a
full-width punctuation mark, where both kinds of pattern below begin anew. A text without any such place, and every
text of any other tokenizer, goes through in one piece.
"""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Iterator
from contextlib import suppress
from ctypes import CDLL
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa

TOKENIZER = "word_bpe_49k.json"
#: Words and parts of words kept at most by one Python worker (about 300 MB); then it starts anew.
CACHE_WORDS, CACHE_PARTS = 1_000_000, 500_000
#: Longer words are encoded each time.
CACHE_CHARS = 64
PART_CHARS = 1_000_000

#: The description of the word BPE's steps, and the steps of byte-level BPE.
WORD_STEPS = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
}
BYTE_STEPS = {"normalizer": None, "pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}}

#: What the tokenizer counts as white space, U+001C to U+001F not among it, as str.split() has it.
_ODD = "\x1c\x1d\x1e\x1f"
_SPACE = re.compile("[\t-\r \x85\xa0  -     　]+")
#: The tokenizer's own pattern, for lower-case ASCII and the lower-case letters of Latin-1.
_PARTS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^0-9a-zß-öø-ÿ]+")
#: Words made of these alone need no normaliser but lower-casing.
_PLAIN = re.compile("[!-~À-ÖØ-öø-ÿ]+")


def _byte_letters() -> dict[int, str]:
    """The byte-level alphabet: printable Latin-1 stands for itself, other bytes for letters from U+0100 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + k) for k, b in enumerate(rest)}


#: A letter of Latin-1 as its UTF-8 bytes are written in that alphabet.
_LETTERS = {c: "".join(map(_byte_letters().get, chr(c).encode())) for c in range(128, 256)}


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def words_of(text: str) -> list[str]:
    if any(c in text for c in _ODD):
        return [w for w in _SPACE.split(text) if w]
    return text.split()


#: Where a long text may be cut: before a space between two letters of any alphabet, or between visible ASCII and a letter, and
#: behind a full-width punctuation mark before a letter.
_CUT = re.compile(r"(?<=[^\W\d_]) (?=[^\W\d_])|(?<=[!-~]) (?=[A-Za-z])|(?<=[。！？，、；：])(?=[^\W\d_])")


def parts(text: str, most: int) -> Iterator[tuple[int, str]]:
    """(place, part) of a text in parts of about `most` characters, each beginning where it was cut."""
    at = 0
    while len(text) - at > most and (cut := _CUT.search(text, at + most)):
        yield at, text[at : cut.start()]
        at = cut.start()
    yield at, text[at:]


class Encoder:
    """ids(): the ids of a text as little-endian unsigned 32-bit integers; spans(): the character spans of texts' tokens."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        steps = json.loads(self.tokenizer.to_str())
        own = {k: steps[k] for k in ("normalizer", "pre_tokenizer")}
        self.by_word = own == WORD_STEPS and steps["model"]["end_of_word_suffix"] == "</w>"
        self.most = PART_CHARS if self.by_word or own == BYTE_STEPS else None
        self.known: dict[str, bytes] = {}
        self.parts: dict[str, bytes] = {}

    def _part(self, part: str) -> bytes:
        found = self.parts.get(part)
        if found is None:
            plain = part if part.isascii() else part.translate(_LETTERS)
            found = array("I", [t.id for t in self.tokenizer.model.tokenize(plain)]).tobytes()
            if len(part) <= CACHE_CHARS:
                self.parts[part] = found
        return found

    def _whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _word(self, word: str) -> bytes:
        if _PLAIN.fullmatch(word) and "<|" not in word:
            own = _PARTS.findall(word.lower())
            return self._part(own[0]) if len(own) == 1 else b"".join(map(self._part, own))
        return self._whole(word)

    def _words(self, text: str) -> bytes:
        words = words_of(text)
        known = self.known
        found = list(map(known.get, words))
        if None in found:
            if len(known) > CACHE_WORDS:
                known.clear()
            if len(self.parts) > CACHE_PARTS:
                self.parts.clear()
            long: dict[str, bytes] = {}
            for i, ids in enumerate(found):
                if ids is None:
                    w = words[i]
                    ids = known.get(w) or long.get(w)
                    if ids is None:
                        ids = (known if len(w) <= CACHE_CHARS else long)[w] = self._word(w)
                    found[i] = ids
        return b"".join(found)

    def _cut(self, text: str) -> Iterator[tuple[int, str]]:
        return iter([(0, text)]) if self.most is None or len(text) <= self.most else parts(text, self.most)

    def ids(self, text: str) -> bytes:
        one = self._words if self.by_word else self._whole
        return one(text) if len(text) <= PART_CHARS else b"".join(one(part) for _, part in self._cut(text))

    def spans(self, texts: list[str]) -> list[np.ndarray]:
        """An array of (start, end) per token of each text, in characters; all texts in one call but for the parts of long ones."""
        short = [t for t in texts if self.most is None or len(t) <= self.most]
        found = iter(self.tokenizer.encode_batch(short, add_special_tokens=False))
        out = []
        for t in texts:
            if self.most is None or len(t) <= self.most:
                out.append(_offsets(next(found)))
            else:
                out.append(np.concatenate([_offsets(self.tokenizer.encode(part, add_special_tokens=False)) + at for at, part in self._cut(t)]))
        return out


def _offsets(encoding) -> np.ndarray:
    own = encoding.offsets
    return np.fromiter(chain.from_iterable(own), np.int64, 2 * len(own)).reshape(-1, 2)


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One for each Python worker; it lives on over the worker's tasks."""
    return Encoder(path)


def release() -> None:
    """Gives back what this Python worker knows of words, and freed memory that it still holds; called by tasks that need
    none, as workers outlive their stages."""
    encoder.cache_clear()
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):  # the C library may have another allocator
        CDLL(None).malloc_trim(0)
