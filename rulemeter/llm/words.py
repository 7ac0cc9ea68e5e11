"""Cutting texts at white space as the tokenizer does, and tables that remember what distinct words gave.

No token of the word-level BPE spans white space, so a text's tokens are those of its white-space-free words, and a word
that was seen before need not be worked out again. The tables live in a Python worker and are emptied when full."""

from __future__ import annotations

from functools import cache

import numpy as np

#: Words and pieces remembered by a worker, about 250 bytes each. Spark deals tasks to its idle workers in turn, so an
#: executor may hold several tables beside each other.
MOST_WORDS, MOST_PIECES = 600_000, 250_000


def split_words(text: str) -> list[str]:
    """Maximal runs without Unicode white space. str.split() also cuts at U+001C to U+001F, which are not white space."""
    if any(c in text for c in "\x1c\x1d\x1e\x1f"):
        import regex

        return regex.findall(r"[^\p{White_Space}]+", text)
    return text.split()


@cache
def tokenizer(path: str):
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@cache
def byte_chars() -> list[str]:
    """The character that stands for each byte in byte-level vocabularies."""
    themselves = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b) if b in themselves else chr(next(rest)) for b in range(256)]


class IdTable:
    """Token ids of pieces, from the tokenizers library's model, as rows of one growing array."""

    def __init__(self, path: str) -> None:
        import json
        import re

        import regex

        self.t = tokenizer(path)
        spec = json.loads(self.t.to_str())
        split, level = spec["pre_tokenizer"]["pretokenizers"]
        kinds = [x["type"] for x in spec["normalizer"]["normalizers"]], split["type"], split["invert"], level["type"], level["add_prefix_space"]
        if kinds != (["NFC", "Replace", "Lowercase"], "Split", True, "ByteLevel", False):
            raise ValueError(f"not a word-level byte-pair tokenizer of the kind that is cut into pieces here: {kinds}")
        self.special = [x["content"] for x in spec["added_tokens"]]
        pattern = split["pattern"]["Regex"]
        self.any = regex.compile(pattern.replace(r"\s", r"\p{White_Space}")).findall
        # the same pattern where all is ASCII: no two alternatives but the last begin alike
        self.ascii = re.compile(pattern.replace(r"[\p{L}]+", "[a-z]+").replace(r"[\p{N}]", "[0-9]").replace(r"[^\s\p{L}\p{N}]", r"[^ \t-\ra-z0-9]")).findall
        self.clear()

    def clear(self) -> None:
        self.at: dict[str, int] = {}
        self.ids, self.used = np.empty(1 << 16, np.uint32), 0
        self.start, self.size = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)

    def pieces(self, text: str) -> list[str]:
        """The normalised text's pieces; a text that holds a special string is one, to be encoded by the whole library."""
        if any(s in text for s in self.special):
            return [text]
        if text.isascii():
            return self.ascii(text.lower())
        import unicodedata

        return self.any(unicodedata.normalize("NFC", text).replace("\u03a3", "\u03c3").lower())  # the library lowers each code point by itself

    def _add(self, pieces: set[str]) -> None:
        if len(self.at) + len(pieces) > MOST_PIECES:
            self.clear()
        chars, tokenize, special = byte_chars(), self.t.model.tokenize, self.special
        for p in pieces:
            if "<|" in p and any(s in p for s in special):
                ids = self.t.encode(p, add_special_tokens=False).ids
            else:
                ids = [x.id for x in tokenize(p if p.isascii() and p.isprintable() and " " not in p else "".join([chars[b] for b in p.encode("utf-8")]))]
            n = len(self.at)
            if n == len(self.start):
                self.start, self.size = np.resize(self.start, 2 * n), np.resize(self.size, 2 * n)
            while self.used + len(ids) > len(self.ids):
                self.ids = np.resize(self.ids, 2 * len(self.ids))
            self.ids[self.used : self.used + len(ids)] = ids
            self.at[p], self.start[n], self.size[n] = n, self.used, len(ids)
            self.used += len(ids)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts one after another, and how many each text has."""
        cut = [self.pieces(t) for t in texts]
        every = [p for c in cut for p in c]
        known = self.at
        if new := set(every).difference(known):
            self._add(new)
            if self.at is not known:  # the table was emptied
                self._add(set(every).difference(self.at))
        at = np.fromiter(map(self.at.__getitem__, every), np.int64, len(every))
        size = self.size[at]
        ends = np.cumsum(size)
        total = int(ends[-1]) if len(ends) else 0
        ids = self.ids[np.arange(total) + np.repeat(self.start[at] - (ends - size), size)]
        upto = np.concatenate(([0], ends))
        stops = upto[np.cumsum([len(c) for c in cut])] if cut else np.empty(0, np.int64)
        return ids, np.diff(np.concatenate(([0], stops)))


@cache
def id_table(path: str) -> IdTable:
    return IdTable(path)
