import random
import zlib

import numpy as np
import public_tokenizers
import pytest

from rulemeter.llm import token_counts, token_ids, words

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = [
    "", None, "   ", "it's they'll we're I've don't 'tis ''s .'s 'lx 'rx 'r 'v 'l '' 'll'll 's's", "a\x1cb c\x85d e\xa0f", "<|endoftext|>abc<|startoftext|> x<|endoftext|", "İstanbul ΣΑΣ straße ΟΔΟΣ é é Å",
    "123 4x5 ٣٤ ½", "日本語 テスト 🎉🎉 a🎉b", "x" * 3000 + " " + "'" * 50 + "é" * 900, "\x1f \x1c\x1d", "naïve—test…ok",
]


def texts():
    r = random.Random(1)
    alphabet = "abcde'''.-  s t re ve ll d m é ü ñ 1 2 <|> 🎉 \n\t Σ"
    return ODD + ["".join(r.choice(alphabet) for _ in range(r.randint(1, 60))) for _ in range(300)]


def wanted(ts):
    return [e.ids for e in words.tokenizer(PATH).encode_batch([t or "" for t in ts], add_special_tokens=False)]


def test_counts_are_the_librarys(docs):
    ts = texts()
    got = sorted(token_counts.token_counts(docs([(i, t, "s") for i, t in enumerate(ts)]), PATH, limit=20).collect(), key=lambda r: r.doc_id)
    want = [len(x) for x in wanted(ts)]
    assert [r.n_tokens for r in got] == want
    assert [r.n_bytes for r in got] == [len((t or "").encode()) for t in ts]
    assert [r.over_limit for r in got] == [n > 20 for n in want]
    assert token_counts.token_counts(docs([]), PATH).count() == 0


@pytest.mark.parametrize("chunk", [1, 3, 256])
def test_boundary_states_do_not_depend_on_chunks(chunk):
    cls = np.random.default_rng(2).integers(0, 10, 1000).astype(np.uint8)
    table, state, want = token_counts._boundary_table(), 0, []
    for c in cls:
        state = table[c, state]
        want.append(state)
    assert token_counts.boundary_states(cls, chunk).tolist() == want


def test_tables_that_fill_up_change_nothing(monkeypatch):
    ts = [t or "" for t in texts()]
    want = [len(x) for x in wanted(ts)]
    for name in ("MOST_WORDS", "MOST_STATES"):
        monkeypatch.setattr(token_counts, name, 50)
    c = token_counts.CountTable(PATH)
    assert [n for t in ts for n in c.count([t])] == want
    monkeypatch.setattr(words, "MOST_PIECES", 40)
    t = words.IdTable(PATH)
    assert [t.encode([x])[0].tolist() for x in ts] == wanted(ts)


@pytest.mark.parametrize("width", [1, 3, 8, 11, 16, 17, 32])
def test_pack_round_trip_and_random_access(width):
    ids = np.random.default_rng(width).integers(0, 1 << min(width, 31), 1001).astype(np.uint32)
    packed = token_ids.pack(ids, width)
    assert len(packed) == -(-1001 * width // 8)
    for first, n in ((0, 1001), (1, 1000), (513, 77), (1000, 1), (5, 0)):
        assert token_ids.unpack(packed, width, first, n).tolist() == ids[first : first + n].tolist()


def test_files_hold_all_ids_in_order(docs, tmp_path):
    ts = texts()
    rows = [(1000 - i, t, "s") for i, t in enumerate(ts)] + [(None, "null id", "s"), (4, "same", "s"), (4, "same", "s"), (4, "other", "s")]
    got = sorted(token_ids.token_ids(docs(rows), PATH, str(tmp_path / "ids")).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == sorted((r[0] for r in rows), key=lambda x: (x is not None, x))
    start = 0
    for r in got:
        assert r.start == start
        start += r.n_tokens
    want = {1000 - i: [*x, 1] for i, x in enumerate(wanted(ts))}
    for r in got:
        if r.doc_id is not None and r.doc_id != 4:
            assert r.n_tokens == len(want[r.doc_id]) and r.ids_crc32 == zlib.crc32(np.array(want[r.doc_id], "<u4").tobytes())
    assert token_ids.token_ids(docs([]), PATH, str(tmp_path / "none")).count() == 0
