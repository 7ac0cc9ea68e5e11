import random

import corpus_pipeline
from rulemeter.llm import near_copies


def grams(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def wanted(rows):
    """component_id of each row, by comparing all pairs."""
    g = [grams(t) for _, t in rows]
    up = list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if (g[i] == g[j]) if not (g[i] and g[j]) else len(g[i] & g[j]) >= 0.8 * len(g[i] | g[j]):
                a, b = root(i), root(j)
                up[max(a, b)] = min(a, b)
    return [rows[root(i)][0] for i in range(len(rows))]


def some_texts():
    r = random.Random(8)
    words = [f"w{i}" for i in range(300)]
    out = []
    for _ in range(40):
        base = r.choices(words, k=r.choice([3, 12, 60, 300]))
        out.append(" ".join(base))
        for _ in range(r.randint(0, 4)):  # near the similarity of 0.8, on either side
            t = base[:]
            for _ in range(r.randint(1, max(1, len(base) // 40))):
                t[r.randrange(len(t))] = "new"
            out.append(" ".join(t))
    return [*out, "", None, "  ", "One", "one", out[0].upper()]


def test_near_copies_equal_brute_force(docs):
    rows = list(enumerate(some_texts()))
    want = wanted(rows)
    table = docs([(i, t, "s") for i, t in rows])
    for tile in (3, near_copies.TILE):
        got = {r.doc_id: r.component_id for r in near_copies.near_copies(table, tile).collect()}
        assert [got[i] for i, _ in rows] == want
    assert near_copies.near_copies(docs([])).count() == 0


def test_the_stage_drops_copies_of_many_bits(spark, docs):
    words = [f"w{i}" for i in range(200)]
    other = words[:]
    for i in (20, 90, 150):  # 15 of 196 shingles: similarity 0.86
        other[i] = "new"
    rows = [(1, " ".join(words), "s"), (2, " ".join(other), "s"), (None, " ".join(words), "s"), (4, "something else that is quite unlike them", "s"), (4, "a second text under the same id", "s")]
    got = corpus_pipeline.drop_near_duplicates(spark, docs(rows), "").collect()
    assert sorted(r.doc_id or 0 for r in got) == [0, 1, 4]


def test_the_stage_takes_the_links_of_simhash_too(spark, docs, monkeypatch):
    texts = {1: "one two three four", 2: "five six seven eight", 3: "nine ten eleven twelve"}
    rows = [(i, t, "s") for i, t in texts.items()]
    made = []

    def linked(d):
        made.append(d)
        return spark.createDataFrame([(1, "", 1), (2, "", 2), (3, "", 2)], "doc_id long, fingerprint string, component_id long")

    monkeypatch.setattr(corpus_pipeline.simhash, "near_duplicates", linked)
    got = corpus_pipeline.drop_near_duplicates(spark, docs(rows), "").collect()
    assert made and sorted(r.doc_id for r in got) == [1, 2]


def test_a_chain_over_both_kinds_of_links_is_one_group(docs, spark):
    words = [f"w{i}" for i in range(200)]
    rows = [(1, "an unlike text of its own", "s"), (2, " ".join(words), "s"), (3, " ".join([*words[:100], "new", *words[101:]]), "s")]
    links = spark.createDataFrame([(2, 1)], "a long, b long")
    assert [r.doc_id for r in near_copies.keep_first(docs(rows), links).collect()] == [1]
