"""Token counts by a tokenizer compiled to finite-state transducers.

Two deterministic transducers run one after the other. The boundary transducer reads code-point classes and has eight
states; the stream is cut into chunks, each chunk's map from every entry state to its exit state is worked out, and the
maps are composed in a parallel prefix scan, which gives each chunk's entry state and so all piece boundaries. The merge
transducer reads the bytes of a piece. Its states hold, for each suffix that may still grow into a token, the trie node
and the last token before the suffix: a token follows another only if the pair is what byte-pair merging makes of the two
together, so exactly one token can end at each byte, and the transition is annotated with the number of tokens that the
byte adds to (or takes from) the count so far. States are compiled when first reached. Counts of distinct pieces and words
are remembered, within a bound."""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .common import bound_batches
from .words import MOST_WORDS, byte_chars, split_words

LIMIT = 2048
#: Symbols in a chunk of the prefix scan.
CHUNK = 256
#: States of the merge transducer kept at once.
MOST_STATES = 150_000

# code-point classes and boundary states
SPACE, LETTER, NUMBER, OTHER, APOS, STMD, R_, V_, L_, E_, SAME = range(11)
B_GAP, B_LETTERS, B_OTHERS, B_APOS, B_R, B_V, B_L, B_CLOSED = range(8)


@cache
def _classes() -> np.ndarray:
    import regex

    out = np.full(0x110000, OTHER, np.uint8)
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    for kind, what in ((LETTER, r"\p{L}"), (NUMBER, r"\p{N}"), (SPACE, r"\p{White_Space}")):
        out[[ord(c) for c in regex.findall(what, every)]] = kind
    for chars, kind in (("'", APOS), ("stmd", STMD), ("r", R_), ("v", V_), ("l", L_), ("e", E_)):
        out[[ord(c) for c in chars]] = kind
    return out


@cache
def _boundary_table() -> np.ndarray:
    """T[class, state]: the next state. Contractions ('s 't 'm 'd 're 've 'll) need the apostrophe to begin a piece."""
    t = np.zeros((11, 8), np.uint8)
    for state in range(8):
        t[SPACE, state], t[NUMBER, state], t[SAME, state] = B_GAP, B_CLOSED, state
        t[OTHER, state] = B_OTHERS
        t[APOS, state] = B_OTHERS if state in (B_OTHERS, B_APOS) else B_APOS
        for letter in (LETTER, STMD, R_, V_, L_, E_):
            t[letter, state] = B_LETTERS
    t[STMD, B_APOS], t[R_, B_APOS], t[V_, B_APOS], t[L_, B_APOS] = B_CLOSED, B_R, B_V, B_L
    t[E_, B_R] = t[E_, B_V] = t[L_, B_L] = B_CLOSED
    return t


def boundary_states(cls: np.ndarray, chunk: int = CHUNK) -> np.ndarray:
    """The state after each symbol, by composing the chunks' state maps in a prefix scan."""
    table, n = _boundary_table(), len(cls)
    rows = max(1, -(-n // chunk))
    grid = np.full(rows * chunk, SAME, np.uint8)
    grid[:n] = cls
    grid = grid.reshape(rows, chunk)
    maps = np.tile(np.arange(8, dtype=np.uint8), (rows, 1))
    for j in range(chunk):
        maps = table[grid[:, j, None], maps]
    d = 1
    while d < rows:  # after this step row i holds the map of chunks i-2d+1 .. i
        maps[d:] = np.take_along_axis(maps[d:], maps[:-d], axis=1)
        d *= 2
    state = np.concatenate(([B_GAP], maps[:-1, B_GAP])).astype(np.uint8)
    out = np.empty_like(grid)
    for j in range(chunk):
        out[:, j] = state = table[grid[:, j], state]
    return out.reshape(-1)[:n]


def pieces_of(stream: str) -> tuple[list[str], np.ndarray]:
    """The pieces of a normalised stream, and for each the number of spaces before it."""
    cls = _classes()[np.frombuffer(stream.encode("utf-32-le"), np.uint32)]
    st = boundary_states(cls)
    prev = np.concatenate(([B_GAP], st[:-1]))
    following = np.concatenate((cls[1:], [SPACE]))
    held = (st == B_R) | (st == B_V) | (st == B_L)
    contracts = np.where(st == B_L, following == L_, following == E_)
    start = (st == B_APOS) | ((st == B_LETTERS) & ~np.isin(prev, (B_LETTERS, B_R, B_V, B_L))) | ((st == B_OTHERS) & ~np.isin(prev, (B_OTHERS, B_APOS))) | (held & ~contracts) | (cls == NUMBER)
    space = cls == SPACE
    breaks = np.flatnonzero(start | space)
    ends = np.concatenate((breaks[1:], [len(cls)]))
    first = start[breaks]
    owner = np.cumsum(space)[breaks[first]]
    return [stream[s:e] for s, e in zip(breaks[first].tolist(), ends[first].tolist(), strict=True)], owner


class MergeTransducer:
    """Counts the tokens of a piece, byte by byte, without making them."""

    def __init__(self, spec: dict) -> None:
        vocab, suffix = spec["model"]["vocab"], spec["model"]["end_of_word_suffix"] or ""
        char = byte_chars()
        self.inner, self.final = [vocab[char[b]] for b in range(256)], [vocab[char[b] + suffix] for b in range(256)]
        self.ranks: dict[tuple[int, int], tuple[int, int]] = {}
        spell: dict[int, tuple[int, ...]] = {i: (i,) for i in (*self.inner, *self.final)}
        for rank, (a, b) in enumerate(map(tuple, spec["model"]["merges"])):
            x, y = vocab[a], vocab[b]
            made = vocab[a + b]
            self.ranks.setdefault((x, y), (rank, made))
            spell.setdefault(made, spell[x] + spell[y])
        self.spell = spell
        self.child: list[dict[int, int]] = [{}]
        self.token: list[int | None] = [None]
        for t, symbols in spell.items():
            at = 0
            for s in symbols:
                if (to := self.child[at].get(s)) is None:
                    to = self.child[at][s] = len(self.child)
                    self.child.append({})
                    self.token.append(None)
                at = to
            self.token[at] = t
        self.follows: dict[tuple[int, int], bool] = {}
        self.clear()

    def clear(self) -> None:
        self.states: list[tuple] = [((0, -1, 0),)]
        self.number = {self.states[0]: 0}
        self.step: dict[int, tuple[int, int]] = {}

    def merge(self, symbols: list[int]) -> list[int]:
        """Plain byte-pair merging: the best-ranked pair, leftmost first."""
        while len(symbols) > 1:
            rank, at = min(((self.ranks.get(p, (1 << 60,))[0], i) for i, p in enumerate(zip(symbols, symbols[1:], strict=False))), default=(1 << 60, 0))
            if rank == 1 << 60:
                break
            symbols[at : at + 2] = [self.ranks[symbols[at], symbols[at + 1]][1]]
        return symbols

    def _may_follow(self, last: int, token: int) -> bool:
        got = self.follows.get((last, token))
        if got is None:
            whole = list(self.spell[token]) if last < 0 else [*self.spell[last], *self.spell[token]]
            got = self.follows[last, token] = self.merge(whole) == ([token] if last < 0 else [last, token])
        return got

    def _compile(self, state: int, symbol: int) -> tuple[int, int]:
        grown, found = [], None
        for node, last, count in self.states[state]:
            if (to := self.child[node].get(symbol)) is not None:
                token = self.token[to]
                if found is None and token is not None and self._may_follow(last, token):
                    found = token, count + 1
                if self.child[to]:
                    grown.append((to, last, count))
        token, delta = found
        after = (*((node, last, count - delta) for node, last, count in grown), (0, token, 0))
        if (n := self.number.get(after)) is None:
            n = self.number[after] = len(self.states)
            self.states.append(after)
        self.step[state << 16 | symbol] = n, delta
        return n, delta

    def count(self, piece: bytes) -> int:
        if len(self.states) > MOST_STATES or len(self.follows) > 20 * MOST_STATES:
            self.clear()
            self.follows.clear()
        state = total = 0
        step, inner = self.step, self.inner
        for b in piece[:-1]:
            state, delta = step.get(state << 16 | inner[b]) or self._compile(state, inner[b])
            total += delta
        last = self.final[piece[-1]]
        return total + (step.get(state << 16 | last) or self._compile(state, last))[1]


class CountTable:
    """Token counts of words, as the tokenizers library gives them for the file's tokenizer."""

    def __init__(self, path: str) -> None:
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        kinds = [x["type"] for x in spec["normalizer"]["normalizers"]], [x["type"] for x in spec["pre_tokenizer"]["pretokenizers"]], spec["model"]["type"]
        if kinds != (["NFC", "Replace", "Lowercase"], ["Split", "ByteLevel"], "BPE"):
            raise ValueError(f"not a word-level byte-pair tokenizer of the kind that is compiled here: {kinds}")
        self.special = regex.compile("|".join(regex.escape(x["content"]) for x in spec["added_tokens"]))
        self.marks = [x["content"] for x in spec["added_tokens"]]
        self.merges = MergeTransducer(spec)
        self.counts: dict[str, int] = {}
        self.pieces: dict[str, int] = {}

    def learn(self, words: list[str]) -> None:
        if len(self.counts) + len(words) > MOST_WORDS:
            self.counts.clear()
        if len(self.pieces) > MOST_WORDS:
            self.pieces.clear()
        base = np.zeros(len(words), np.int64)
        for i, w in enumerate(words):
            if any(m in w for m in self.marks):  # a special string is one token and cuts the text
                base[i] = len(self.special.findall(w))
        parts = [self.special.split(w) if base[i] else [w] for i, w in enumerate(words)]
        owner = np.repeat(np.arange(len(words)), [len(p) for p in parts])
        stream = " ".join(p for ps in parts for p in ps)
        if not stream.isascii():
            stream = unicodedata.normalize("NFC", stream).replace("Σ", "σ")  # the library lowers each code point by itself
        found, at = pieces_of(stream.lower())
        known, count = self.pieces, self.merges.count
        sizes = np.zeros(len(found), np.int64)
        for k, p in enumerate(found):
            if (n := known.get(p)) is None:
                n = known[p] = count(p.encode("utf-8"))
            sizes[k] = n
        np.add.at(base, owner[at], sizes)
        self.counts.update(zip(words, base.tolist(), strict=True))

    def count(self, texts: list[str]) -> list[int]:
        cut = [split_words(t) for t in texts]
        words = {w for c in cut for w in c}
        if new := words - self.counts.keys():
            self.learn(list(new))
            if missing := words - self.counts.keys():  # the table was emptied
                self.learn(list(missing))
        get = self.counts.__getitem__
        return [sum(map(get, c)) for c in cut]


@cache
def count_table(path: str) -> CountTable:
    return CountTable(path)


def token_counts(docs: DataFrame, tokenizer_path: str, limit: int = LIMIT) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every row of ``docs`` (doc_id, text), without a shuffle.

    A null or empty text has no bytes and no tokens. Repeated rows give repeated rows, an empty table none; a null doc_id
    stays null. Other columns are not read. The number of tokens is that of the whole text."""
    bound_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = count_table(tokenizer_path)
        for b in batches:
            n = np.array(known.count([t or "" for t in b.column(1).to_pylist()]), np.int64)
            size = pc.fill_null(pc.binary_length(b.column(1)), 0).cast(pa.int64())
            yield pa.record_batch([b.column(0), size, pa.array(n), pa.array(n > limit)], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
