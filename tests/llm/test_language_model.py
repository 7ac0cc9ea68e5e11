import random

import numpy as np

from rulemeter.llm import lm_score as L


def corpus(r, n):
    cycle = [f"w{i}" for i in range(30)]
    return [" ".join(cycle[(k + i) % 30] for k in [r.randrange(30)] for i in range(120)) for _ in range(n)]


def test_scores_do_not_depend_on_partitions(docs, monkeypatch):
    monkeypatch.setattr(L, "TRAINER_TOKENS", 3000)
    r = random.Random(6)
    rows = [(i, t, "s") for i, t in enumerate(corpus(r, 90))] + [(i + 200, f"rare{i} thing{i % 7} w3", "s") for i in range(60)]
    d = docs(rows)
    got = [{x.doc_id: x.log_prob for x in L.score(d.repartition(n)).collect()} for n in (1, 8, 64)]
    for other in got[1:]:
        assert other.keys() == got[0].keys() and all(abs(other[k] - v) < 1e-6 for k, v in got[0].items())


def test_conditional_probabilities_add_up_to_one():
    r = np.random.default_rng(5)
    known = [(f"w{i}".encode(), 100 - i) for i in range(75)]
    rare = {f"x{i}".encode(): int(r.integers(1, 4)) for i in range(200)}
    mass, types = [0] * L.GROUPS, [0] * L.GROUPS
    for w, n in [*known[70:], *rare.items()]:
        mass[L._group(w)] += n
        types[L._group(w)] += 1
    words = L.Words(known, mass, types, 70)
    net = L.Network(words.size, classes=8)
    for _ in range(30):
        net.step(net.stream([r.integers(1, net.n, 500)]))
    for left, right in (([3, 9], [70, 71]), ([0, 0], [0, 0]), ([80, 1], [0, 0])):
        stream = lambda x: np.array([*left, x, *right])  # noqa: E731, B023
        total = sum(np.exp(net.log_prob(stream(i))[2]) for i in range(1, words.size + 1))
        for g in range(L.GROUPS):
            mine = [n for w, n in [*known[70:], *rare.items()] if L._group(w) == g]
            share = sum(np.exp(words.share(g, n)) for n in mine) + np.exp(words.share(g, 0))
            assert abs(share - 1) < 1e-9
            total += share * np.exp(net.log_prob(stream(words.size + 1 + g))[2])
        assert abs(total - 1) < 1e-4


def test_steps_follow_the_gradient():
    """A small step lowers the mean loss of its own batch, whichever parameters move."""
    r = np.random.default_rng(7)
    net = L.Network(40, classes=5)
    ids = net.stream([r.integers(1, net.n, 200), r.integers(1, net.n, 90)])
    loss = lambda: -net.log_prob(ids).sum()
    before = loss()
    for _ in range(20):
        net.step(ids, 0.1)
    assert loss() < before - 1


def test_context_decides_between_words(docs):
    """A document in the known order scores above its own words shuffled, and twice-seen rare words above once-seen ones."""
    r = random.Random(10)
    rows = [(i, t, "s") for i, t in enumerate(corpus(r, 150))]
    once, twice = " ".join(f"one{i}ly" for i in range(60)), " ".join(f"two{i}ly" for i in range(60))
    shuffled = corpus(r, 1)[0].split()
    r.shuffle(shuffled)
    rows += [(1000, " ".join(shuffled), "s"), (1001, None, "s"), (1002, "", "s"), (1003, once, "s"), (1004, twice, "s"), (1005, twice, "s"), (None, "w1 w2", "s"), (1006, "w1 w2 " * 40_000, "s")]
    got = {x.doc_id: x for x in L.score(docs(rows)).collect()}
    assert len(got) == len(rows)
    assert got[1000].per_token < min(got[i].per_token for i in range(150)) - 0.5
    assert got[1001].n_tokens == 0 and got[1001].log_prob == 0 and got[1001].per_token is None
    assert got[1004].log_prob == got[1005].log_prob > got[1003].log_prob
    assert got[1006].n_tokens == 80_000
    assert L.score(docs([])).count() == 0


def test_reading_equals_a_plain_loop():
    known = [(f"w{i}".encode(), 90 - i) for i in range(40)]
    words = L.Words(known, [500] * L.GROUPS, [7] * L.GROUPS, 30)
    place = {w: i for i, (w, _) in enumerate(known)}
    for text in (None, "", " ", "W1 w39 w2 w35", "w3 new w31 other new ÉT", "new"):
        ids, own, rare = [], 0.0, []
        for w in (text or "").lower().encode().split():
            at = place.get(w)
            ids.append(at + 1 if at is not None and at < 30 else 31 + L._group(w))
            if at is None:
                rare.append(w)
            elif at >= 30:
                own += words.share(L._group(w), known[at][1])
        got = words.read(text)
        assert got[0].tolist() == ids and got[0].dtype == np.uint16 and abs(got[1] - own) < 1e-9 and got[2] == {w: rare.count(w) for w in rare}
