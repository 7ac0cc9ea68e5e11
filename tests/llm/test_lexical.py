import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from rulemeter.llm import lexical as X

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def terms(t):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))


def brute(docs, items, top=10):
    held = [(i, Counter(terms(t))) for i, t, *_ in docs]
    held = [(i, c) for i, c in held if c]
    n, total = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    asked = {}
    for item, t, *_ in items:
        asked.setdefault(item, []).extend(terms(t))
    out = set()
    for item, ts in asked.items():
        found = []
        for i, c in held:
            m, s = 25 + 75 * sum(c.values()) * n // total, 0
            for t in ts:
                if t in c:
                    s += math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m))
            if s > 0:
                found.append((-s, i is None, i or 0))
        out |= {(item, k + 1, None if none else i, -s) for k, (s, none, i) in enumerate(sorted(found)[:top])}
    return out


def some_docs(n=300, seed=1):
    r = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(200)] + ["été", "naïve", "漢字", "co-op", "x_y"]
    weights = [1 / (k + 1) for k in range(len(vocabulary))]
    rows = [(i, " ".join(r.choices(vocabulary, weights, k=r.randint(1, 80))).title(), "s") for i in range(n)]
    return rows + [(n + k, rows[7][1], "s") for k in range(30)] + [(None, rows[9][1], "s"), (5, rows[9][1], "s"), (900, None, "s"), (901, "", "s"), (902, "... !!", "s"), (903, "w150 " * 40_000, "s")]


ITEMS = [(1, "W0 w1 w150 w199"), (2, "w0 w0 w0 w3"), (3, "Été, été naïve? 漢字"), (4, None), (5, "nowhere"), (6, ""), (7, "w7 w8 w9 w10 w11 w12 w13 w0 w1 w2"), (7, "w190"), (None, "w20 w21"), (8, "w0")]


@pytest.fixture
def items(spark):
    return spark.createDataFrame([(*i, 1) for i in ITEMS], "item_id long, text string, score int")


@pytest.mark.parametrize("shard", [50, 3000, X.SHARD])
def test_equals_brute_force(spark, docs, items, shard):
    rows = some_docs()
    index = X.build_index(docs(rows), shard=shard)
    got = [tuple(r) for r in X.search(spark, index, items).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows, ITEMS)


def test_blocks_of_items_change_nothing(docs, items, monkeypatch):
    rows = some_docs(120, 2)
    monkeypatch.setattr(X, "QUERY_ROWS", 5)
    assert {tuple(r) for r in X.ranked_search(docs(rows), items).collect()} == brute(rows, ITEMS)


def test_empty_tables(docs, items):
    assert X.ranked_search(docs([]), items).count() == 0
    assert X.ranked_search(docs([(1, None, "s")]), items).count() == 0
    assert X.ranked_search(docs(some_docs(20)), items.filter("false")).count() == 0


def test_packed_numbers_round_trip():
    v = np.array([0, 1, 127, 128, 16383, 16384, 2**31, 2**40 + 5, 2**62])
    blob, size = X.pack(v)
    assert size.sum() == len(blob) and X.unpack(blob).tolist() == v.tolist()
    assert X.unpack(X.pack(np.array([], np.int64))[0]).tolist() == []


def test_merging_equals_summing():
    r = random.Random(4)
    for _ in range(60):
        lists, sums = [], Counter()
        for _ in range(r.randint(1, 9)):
            at = sorted(r.sample(range(120), r.randint(1, 90)))
            scores = [r.randint(0, r.choice([3, 50])) for _ in at]
            lists.append((at, scores, max(scores)))
            for d, s in zip(at, scores, strict=True):
                sums[d] += s
        want = sorted(((s, -d) for d, s in sums.items() if s > 0), reverse=True)[:10]
        assert sorted(X.best_of_shard(lists, 10), reverse=True) == want
