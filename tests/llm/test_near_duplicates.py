import random

import numpy as np
import pytest
import xxhash

from rulemeter.llm import embeddings, simhash
from rulemeter.llm.components import components


def roots(n, pairs):
    up = list(range(n))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        x, y = root(a), root(b)
        up[max(x, y)] = min(x, y)
    return [root(i) for i in range(n)]


def test_components_equal_union_find(spark):
    r = random.Random(4)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(400, 460)] + [(500, 500 + k) for k in range(80)] + [(7, 7)]
    want = roots(600, edges)
    got = {x.node: x.component for x in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    seen = {v for e in edges if e[0] != e[1] for v in e}
    assert got == {v: want[v] for v in seen}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def fingerprint(text):
    words = (text or "").encode().lower().split()
    k = min(3, len(words))
    h = [xxhash.xxh64_intdigest(b" ".join(words[i : i + k]), 42) for i in range(len(words) - k + 1)] if words else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_fingerprints_and_groups_equal_brute_force(docs):
    r = random.Random(5)
    base = [" ".join(r.choice("alpha Beta gamma delta eps zeta eta theta".split()) for _ in range(r.randint(1, 400))) for _ in range(40)]
    texts = base + [t + " extra" for t in base[:20]] + [base[3]] * 5 + ["", None, "  \t ", "One", "one two", "İ Ä x", "w " * 5000]
    got = sorted(simhash.near_duplicates(docs([(i, t, "s") for i, t in enumerate(texts)])).collect(), key=lambda x: x.doc_id)
    f = [fingerprint(t) for t in texts]
    assert [x.fingerprint for x in got] == [f"{x:016x}" for x in f]
    want = roots(len(f), [(i, j) for i in range(len(f)) for j in range(i) if (f[i] ^ f[j]).bit_count() <= 3])
    assert [x.component_id for x in got] == want


def test_hot_keys_go_to_the_second_pass(spark):
    r = random.Random(6)
    centre = r.getrandbits(64)
    fps = {centre} | {centre ^ sum(1 << b for b in r.sample(range(64), r.randint(1, 6))) for _ in range(300)} | {r.getrandbits(64) for _ in range(50)}
    fps = sorted(x - (x >> 63 << 64) for x in fps)
    df = spark.createDataFrame([(x,) for x in fps], "fp long")
    pairs = [(i, j) for i in range(len(fps)) for j in range(i) if ((fps[i] ^ fps[j]) & (1 << 64) - 1).bit_count() <= 3]
    at = {x: i for i, x in enumerate(fps)}
    for hot in (8, 1 << 16):
        e = simhash.links(df, hot_run=hot).collect()
        assert roots(len(fps), [(at[x.a], at[x.b]) for x in e]) == roots(len(fps), pairs)


def test_keep_first_and_edges(docs):
    t = "a b c d e f g h"
    d = docs([(5, t, "s"), (3, t, "s"), (3, t, "s"), (None, "q r s t", "s"), (9, "other words stand here now", None)])
    assert sorted(x.doc_id or -1 for x in simhash.keep_first(d).collect()) == [-1, 3, 9]
    assert simhash.near_duplicates(docs([])).count() == 0


def brute(rows, threshold=0.93):
    unit = []
    for _, v, label in rows:
        ok = v is not None and label is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)
        x = np.array(v, np.float32).astype(float) if ok else None
        unit.append(x / np.linalg.norm(x) if ok else None)
    pairs = [(i, j) for i in range(len(rows)) for j in range(i) if unit[i] is not None and unit[j] is not None and rows[i][2] == rows[j][2] and len(unit[i]) == len(unit[j]) and float(unit[i] @ unit[j]) >= threshold]
    n = [0] * len(rows)
    for i, j in pairs:
        n[i] += 1
        n[j] += 1
    return n, roots(len(rows), pairs)


@pytest.mark.parametrize("block", [16, 2048])
def test_embeddings_equal_brute_force(vectors, block):
    r = np.random.default_rng(7)
    centres = r.standard_normal((6, 24))
    rows = [(i, (centres[i % 6] + r.standard_normal(24) * r.choice([0.02, 0.15, 0.3, 1.0])).tolist(), int(i % 3)) for i in range(240)]
    same = rows[0][1]
    rows += [(240 + i, same, 0) for i in range(40)]
    rows += [(300, None, 1), (301, [0.0] * 24, 1), (302, [float("nan")] * 24, 1), (303, same, None), (304, [None] + same[1:], 0), (305, [1.0, 2.0], 0), (306, [2.0, 4.0], 0), (307, [], 0), (308, [1e30] * 24, 2), (309, [1e-30] * 24, 2)]
    got = sorted(embeddings.near_duplicates(vectors(rows), block=block, sample=50).collect(), key=lambda x: x.vec_id)
    n, root = brute(rows)
    assert [x.n_links for x in got] == n
    assert [x.component_id for x in got] == [rows[k][0] for k in root]
    assert all(x.kept == (x.vec_id == x.component_id) for x in got)


def test_embeddings_edges(vectors):
    assert embeddings.near_duplicates(vectors([])).count() == 0
    got = embeddings.near_duplicates(vectors([(1, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (None, [1.0, 0.0], 1)])).collect()
    assert sorted((x.vec_id or 0, x.n_links, x.kept) for x in got) == [(0, 0, False), (1, 1, True), (1, 1, True)]
