import hashlib

from rulemeter.llm import line_dedup as L

SPACE = " \t\n\x0b\x0c\r"


def brute(rows, least=10, copies=2):
    lower = str.maketrans(L._UPPER, L._LOWER)
    key = lambda line: line.strip(SPACE).translate(lower)
    holders = {}
    for i, t, _ in rows:
        for line in (t or "").split("\n"):
            holders.setdefault(key(line), set()).add(i)
    order = lambda i: (i is None, i or 0)
    out = []
    for i, t, _ in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(key(x)) < least or len(holders[key(x)]) < copies or min(holders[key(x)], key=order) == i]
        out.append((i, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


def told(df):
    return sorted([(r.doc_id, r.n_lines, r.n_dropped, r.kept_sha256) for r in df.collect()], key=str)


def test_equals_brute_force(docs):
    hot = "  This line stands in EVERY text\t"
    rows = [(i, f"own {i}\n{hot}\nshort\nline of {i % 7} and others\n\n{hot if i % 3 else ''}\nÉté à la mer {i % 5} \x0b", "s") for i in range(80)]
    rows += [(200, None, "s"), (201, "", "s"), (202, "\n\n", "s"), (203, hot.lower().strip() + "\r", "s"), (3, "another version\n" + hot, "s"), (3, rows[3][1], "s")]
    rows += [(None, hot + "\nonly without an id, twice", "s"), (None, "only without an id, twice", "s"), (204, "123456789\n1234567890\n" + "\n".join(["a repeated line of its own"] * 3), "s")]
    rows += [(205, "123456789\n1234567890", "s"), (206, "ÉTÉ À LA MER 1", "s"), (207, " padded by a wide space", "s"), (208, "padded by a wide space", "s")]
    assert told(L.line_dedup(docs(rows))) == brute(rows)


def test_a_very_long_text(docs):
    long = "\n".join(f"line number {i} of many" for i in range(60_000))
    rows = [(1, long, "s"), (2, long + "\nits last line stays", "s")]
    assert told(L.line_dedup(docs(rows))) == brute(rows)


def test_an_empty_table_and_clashing_columns(spark, docs):
    assert L.line_dedup(docs([])).count() == 0
    t = spark.createDataFrame([(1, "a line of ten letters", 7, "p"), (2, "a line of ten letters\nx", 8, "q")], "doc_id int, text string, n_lines int, _pos string")
    out = L.drop_repeated_lines(t)
    assert out.columns == ["doc_id", "text", "_pos", "n_lines", "n_dropped"]
    assert sorted(tuple(r) for r in out.collect()) == [(1, "a line of ten letters", "p", 1, 0), (2, "x", "q", 2, 1)]


def test_other_thresholds(docs):
    rows = [(i, f"three of us\nyes\n{'two of us' if i < 3 else ''}", "s") for i in (1, 2, 3)]
    got = L.drop_repeated_lines(docs(rows), least_chars=3, copies=3).orderBy("doc_id").collect()
    assert [r.text for r in got] == ["three of us\nyes\ntwo of us", "two of us", ""]
