import random
import zlib
from collections import Counter

from rulemeter.llm import spelling as S

LATIN = [chr(c) for c in range(0xC0, 0x100)]


def brute_words(rows):
    out = Counter()
    for i, t, *_ in rows:
        run = ""
        for c in (t or "") + "\n":
            if "a" <= c <= "z" or "A" <= c <= "Z" or "À" <= c <= "ÿ":
                run += c
                continue
            if run:
                run = "".join(x.lower() if "A" <= x <= "Z" else x for x in run)
                h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
                if h % 199 == 0:
                    run = run[: h % len(run)] + run[h % len(run) + 1 :]
                out[run] += 1
            run = ""
    return {w: n for w, n in out.items() if len(w) >= 6 and n >= 5}


def one_edit(a, b):
    a, b = sorted((a, b), key=len)
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) - len(a) == 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def brute_variants(words):
    near = {w: [v for v in words if one_edit(w, v)] for w in words}
    form = {}
    for w, vs in near.items():
        best = min(vs, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 5 * words[w] else None
    root = lambda w: w if form[w] is None else root(form[w])
    return {(w, form[w], root(w), words[w], len(near[w]), words.get(form[w])) for w in words}


def told(df):
    return {(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()}


def some_rows():
    r, stems = random.Random(3), ["spelling", "dictionarÿes", "étésanci", "aaaaaa", "aaaaaaa", "abcdefghijklmnop"]
    words = {}
    for k, s in enumerate(stems):
        words[s] = 700
        for _ in range(40):
            at, c = r.randrange(len(s)), r.choice("abcdexyzéÿÉ")
            v = r.choice([s[:at] + s[at + 1 :], s[:at] + c + s[at:], s[:at] + c + s[at + 1 :]])
            words.setdefault(v, r.choice([4, 5, 9, 30, 140]))
            at = r.randrange(len(v))
            words.setdefault(v[:at] + c + v[at + 1 :], r.choice([5, 6, 28]))
    every = [w for w, n in words.items() for _ in range(n)]
    r.shuffle(every)
    return [(i, " ".join(every[i * 50 : i * 50 + 50]).title() if i % 4 else "1".join(every[i * 50 : i * 50 + 50]), "s") for i in range(len(every) // 50 + 1)]


def test_equals_brute_force(docs):
    rows = [*some_rows(), (None, "Spelling spelling ×spelling÷", "s"), (900, None, "s"), (901, "", "s"), (902, "spelling " * 50_000, "s"), (902, "spelling " * 3, "s"), (902, "spelling " * 3, "s")]
    assert told(S.variants(docs(rows))) == brute_variants(brute_words(rows))


def test_the_size_of_blocks_changes_nothing(spark):
    words = brute_words(some_rows())
    want = {w: sorted((-words[v], v) for v in words if one_edit(w, v)) for w in words}
    want = {(w, len(vs), vs[0][1], -vs[0][0]) for w, vs in want.items() if vs}
    t = spark.createDataFrame(list(words.items()), "word string, n long")
    for block in (1, 5, 10_000):
        assert {tuple(r) for r in S.near_words(t, block=block).collect()} == want


def test_one_hot_prefix(spark):
    r = random.Random(5)
    words = {"prefixes" + "".join(r.choice("abc") for _ in range(r.randint(4, 7))): r.randint(5, 99) for _ in range(600)}
    want = {(w, len(vs)) for w in words if (vs := [v for v in words if one_edit(w, v)])}
    t = spark.createDataFrame(list(words.items()), "word string, n long")
    assert {(x.word, x.n_near) for x in S.near_words(t, block=20).collect()} == want
    assert S.blocks(t, block=20).groupBy("key").count().agg({"count": "max"}).first()[0] < 60


def test_an_empty_table(docs):
    assert S.variants(docs([])).count() == 0


def test_blocks_stay_whole_when_joins_change_while_running(spark):
    """Joins planned as merges become broadcasts once their sides turn out small; words must still meet those of their block."""
    words = brute_words(some_rows())
    want = {w: sorted((-words[v], v) for v in words if one_edit(w, v)) for w in words}
    want = {(w, len(vs), vs[0][1], -vs[0][0]) for w, vs in want.items() if vs}
    t = spark.createDataFrame(list(words.items()), "word string, n long").repartition(4)
    conf = {"spark.sql.autoBroadcastJoinThreshold": "1MB", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "4KB", "spark.sql.adaptive.coalescePartitions.minPartitionSize": "1KB"}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        for _ in range(3):  # the order in which the stages end decides
            assert {tuple(r) for r in S.near_words(t, block=20).collect()} == want
    finally:
        for k in conf:
            spark.conf.unset(k)
