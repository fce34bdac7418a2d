"""Token ids of whole texts, by the tokenizers library, with a cache of words.

White space never joins or changes tokens of the word-level vocabulary used here, so a text's ids
are the ids of its words in a row. Invented and rare words are encoded once per worker process and
then looked up. The cache is bounded; a text with unusual separators is encoded as a whole.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterable

import numpy as np

#: Words that one worker process remembers (some 150 bytes each).
CACHE_WORDS = 1_000_000
# Separators and format characters that str.split() and the vocabulary may treat differently.
ODD_POINTS = [*range(0x1C, 0x20), 0x85, 0xA0, 0x1680, 0x180E, *range(0x2000, 0x2010), 0x2028, 0x2029, 0x202F, 0x205F, 0x2060, 0x3000, 0xFEFF]
ODD_SPACE = re.compile("[" + "".join(map(chr, ODD_POINTS)) + "]")
# A run of letters that lower-case one by one, then ASCII punctuation: two pre-tokens, the second maybe empty.
PLAIN = re.compile("([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:-@\\[-`{-~]*)")

_encoders: dict[str, Encoder] = {}


class Encoder:
    """Encodes texts to little-endian ids of ``width`` bytes each."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.tokenizer = Tokenizer.from_file(path)
        self.size = self.tokenizer.get_vocab_size()
        self.dtype = np.dtype("<u2" if self.size <= 1 << 16 else "<u4")
        self.words: dict[str, bytes] = {}
        self.parts: dict[str, bytes] = {}
        self.model = self.tokenizer.model
        visible = ByteLevel(add_prefix_space=False, use_regex=False)
        self.visible = {ord(c): visible.pre_tokenize_str(c)[0][0] for c in map(chr, [*range(33, 127), *range(0xC0, 0x100)])}
        self.by_word = self._words_apart()

    def _words_apart(self) -> bool:
        """Whether this vocabulary encodes words apart as together (it drops white space)."""
        probe = ["Ab, cd", "x", "1 2", "É!"]
        ids = lambda t: self.tokenizer.encode(t, add_special_tokens=False).ids
        return ids("\n ".join(probe)) == [i for t in probe for w in t.split() for i in self._part_ids(w)]

    def _part_ids(self, word: str) -> list[int]:
        """Ids of one word, cut into letters and punctuation where that is certain."""
        m = PLAIN.fullmatch(word)
        if not m:
            return self.tokenizer.encode(word, add_special_tokens=False).ids
        ids = [t.id for t in self.model.tokenize(m[1].lower().translate(self.visible))]
        return ids + [t.id for t in self.model.tokenize(m[2])] if m[2] else ids

    def _learn(self, found: Iterable[str]) -> dict[str, bytes]:
        new = {w: np.array(self._part_ids(w), self.dtype).tobytes() for w in found}
        if len(self.words) + len(new) > CACHE_WORDS:
            self.words = {}
        self.words.update(new)
        return new

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if not self.by_word or ODD_SPACE.search(text):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()
        found = text.split()
        try:
            return b"".join([self.words[w] for w in found])
        except KeyError:
            distinct = set(found)
            local = {w: self.words[w] for w in distinct if w in self.words}
            local.update(self._learn(distinct - local.keys()))
            return b"".join([local[w] for w in found])

    def ids(self, text: str | None, end_id: int) -> np.ndarray:
        """Ids of one document with its end id, as unsigned 32-bit integers."""
        return np.append(np.frombuffer(self.encode(text), self.dtype).astype("<u4"), np.uint32(end_id))


def encoder(path: str) -> Encoder:
    """One encoder per worker process and file."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]
