import hashlib
import random
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from rulemeter.functions.rng import MASK, STEP
from rulemeter.operators import isomorphs as X

SCHEMA = "id long, options array<struct<letter:string,text:string>>"
DIGITS = "0123456789"


def scan(text):
    """Numerals read character by character: (start, end)."""
    out, i, n = [], 0, len(text)

    def run(i):
        j = i
        while j < n and text[j] in DIGITS:
            j += 1
        return j

    while i < n:
        start = i
        if text[i] in X.SIGNS and (i == 0 or not (text[i - 1].isalnum() or text[i - 1] == ".")):
            after = i + 1
            if after < n and (text[after] in DIGITS or (text[after] == "." and run(after + 1) > after + 1)):
                i = after
        if text[i] == "." and run(i + 1) > i + 1:
            i = run(i + 1)
            out.append((start, i))
            continue
        if text[i] not in DIGITS:
            i = start + 1
            continue
        i = run(i)
        j, ok = i, i < n and text[i] == ","
        while j < n and text[j] == "," and ok:
            k = run(j + 1)
            ok, j = k == j + 4, k
        if ok and not (j < n and text[j] == "." and run(j + 1) > j + 1):
            i = j
        elif i < n and text[i] == "." and run(i + 1) > i + 1:
            i = run(i + 1)
        else:
            j = i
            while j < n and text[j] in " \t":
                j += 1
            if j < n and text[j] == "/":
                j += 1
                while j < n and text[j] in " \t":
                    j += 1
                if j < n and text[j] in X.SIGNS:
                    j += 1
                k = run(j)
                if k > j and not (k < n and text[k] == "." and run(k + 1) > k + 1):
                    i = k
        out.append((start, i))
    return out


TEXTS = [
    "", "none", "12", "-12", "a-12", "3-4", "(-4)", "−5 and –6", ".5", "-.5", "x.5", "1.5.7", "1,200", "1,200,3", "1,200.5", "1,2000", "12,345,678 km", "1/2", "-3 / -4", "1/2.5", "1/2/3", "3 /x", "5.", "é-7", "1,", "0,123", "7\t/ 8", "- 5", "--5", "1e5", "$3.00%", "9/−2", "2.5/3",
]


def test_scan_equals_a_reader(spark):
    r = random.Random(1)
    texts = TEXTS + ["".join(r.choice("0123456789.,/- −a") for _ in range(r.randint(1, 14))) for _ in range(3000)]
    t = spark.createDataFrame(list(enumerate(texts)), "i int, s string")
    for row in t.select("i", "s", X.numerals(F.col("s")).alias("n")).collect():
        assert row.n == [row.s[a:b] for a, b in scan(row.s)], row.s
    assert spark.range(1).select(X.numerals(F.lit(None).cast("string")).alias("n")).first().n == []


def draw(seed, k):
    a = (seed + k * STEP) & MASK
    t = (a ^ a >> 15) * (a | 1) & MASK
    t ^= (t + ((t ^ t >> 7) * (t | 61) & MASK)) & MASK
    return ((t ^ t >> 14) & MASK) / 4294967296


def form(text):
    sign = text[0] if text[0] in X.SIGNS else ""
    body = text[len(sign) :]
    places = len(body.split(".")[1]) if "." in body else 0
    digits = "".join(c for c in body if c in DIGITS)
    kind = "comma" if "," in body else "decimal" if "." in body else "integer"
    whole = len(digits) - places
    low = 0 if kind == "decimal" and whole <= 1 else (1 if sign else 0) if len(digits) == 1 else 10 ** (len(digits) - 1)
    return sign, kind, whole, places, low, 10 ** len(digits) - 1, Fraction(int(digits) * (-1 if sign else 1), 10**places)


def parts(numeral):
    if "/" not in numeral:
        return [numeral]
    a, b = numeral.split("/")
    return [a.rstrip(" \t"), b.lstrip(" \t")]


def redraw(id_, texts, arm, attempts):
    """The rule written out: the first attempt that holds, as a map of texts; None if none does."""
    spans = [[t[a:b] for a, b in scan(t)] for t in texts if t is not None]
    atoms = list(dict.fromkeys(p for s in spans for x in s for p in parts(x)))
    seed = int(hashlib.sha256(f"{X.SEED}:{arm}:{id_}".encode()).hexdigest()[:8], 16)
    forms = {a: form(a) for a in atoms}
    leads = list(dict.fromkeys(s[0] for s in spans if s))
    fractions = [x for s in spans for x in s if "/" in x]
    if any(forms[parts(x)[1]][6] == 0 for x in fractions):
        return None
    for attempt in range(attempts):
        new = {}
        for j, a in enumerate(atoms):
            sign, *_, low, high, _ = forms[a]
            u = draw(seed, attempt * X.STRIDE + 2 * j + 1) + draw(seed, attempt * X.STRIDE + 2 * j + 2) / 4294967296
            new[a] = (low + min(high - low, int(u * (high - low + 1)))) * (-1 if sign else 1)
        if arm == X.KEPT:
            alone = [a for a in leads if "/" not in a]
            for f in {forms[a][:4] for a in alone}:
                same = [a for a in alone if forms[a][:4] == f]
                values = sorted(new[a] for a in same)
                new |= {a: values[sum(forms[b][6] < forms[a][6] for b in same)] for a in same}
        value = {a: Fraction(v, 10 ** forms[a][3]) for a, v in new.items()}
        whole, decimal = ([value[a] for a in atoms if (forms[a][1] == "decimal") == d] for d in (False, True))
        if any(value[a] == forms[a][6] for a in atoms) or len(set(whole)) < len(whole) or len(set(decimal)) < len(decimal) or any(value[parts(x)[1]] == 0 for x in fractions):
            continue
        if arm == X.KEPT:
            told = lambda x, of: of(parts(x)[0]) / of(parts(x)[1]) if "/" in x else of(x)
            old, fresh = (lambda a: forms[a][6]), value.get
            sign = lambda v: (v > 0) - (v < 0)
            if any(told(x, old) == told(x, fresh) for x in fractions) or any(sign(told(x, old) - told(y, old)) != sign(told(x, fresh) - told(y, fresh)) for x in leads for y in leads):
                continue
        return {a: written(forms[a], v) for a, v in new.items()}
    return None


def written(f, v):
    sign, kind, whole, places, *_ = f
    body = f"{abs(v):,}" if kind == "comma" else str(abs(v))
    if kind == "decimal":
        digits = str(abs(v)).rjust(places + min(whole, 1), "0")
        body = digits[: len(digits) - places] + "." + digits[len(digits) - places :]
    return sign + body


def items():
    r = random.Random(2)
    rows = [["x = 12 and 3/4", "-5.50 cm", "1,200", ".5 of 7-3"], ["none", None], ["3/0", "1"], [], ["1", "2", "3", "4", "5"], ["2", "2.0", "7"], ["1/2", "-1 / 3", "0.50"], ["0", "1", "2", "3", "4", "5", "6", "7", "8", "9"], ["12345678901", "5"], ["1234567890123456"]]
    for _ in range(40):
        kinds = [lambda: str(r.randint(0, 99)), lambda: f"-{r.randint(1, 9)}", lambda: f"{r.random() * 20:.1f} m", lambda: f"{r.randint(1, 9)}/{r.randint(1, 9)}", lambda: f"{r.randint(1000, 99999):,} at {r.randint(1, 9)}"]
        rows.append([r.choice(kinds)() for _ in range(r.randint(2, 5))])
    return rows


@pytest.mark.parametrize("arm", [X.KEPT, X.SCRAMBLED])
def test_redraws_equal_the_rule_written_out(spark, arm):
    rows = items()
    t = spark.createDataFrame([(i, list(zip("ABCDEFGHIJ", o, strict=False))) for i, o in enumerate(rows)], SCHEMA)
    told = X.isomorphs(t.repartition(3), arm, (8, 64)).cache()
    got = {r.id: r for r in told.collect()}
    for i, texts in enumerate(rows):
        spans = [s for x in texts if x for s in scan(x)]
        too_long = any(len("".join(c for c in p if c in DIGITS)) > X.MOST_DIGITS for x in texts if x for a, b in scan(x) for p in parts(x[a:b]))
        want = None if too_long else redraw(i, texts, arm, 64)
        assert got[i].state == ("no numerals" if not spans else "redrawn" if want else "failed"), texts
        if want is None or not spans:
            assert [o.text for o in got[i].options] == texts
            continue
        assert {m.text: m.to for m in got[i].map} == want, texts
        for old, new in zip(texts, got[i].options, strict=True):
            if old is not None:
                built, at = "", 0
                for a, b in scan(old):
                    span = old[a:b]
                    if "/" in span:
                        x, y = parts(span)
                        built += old[at:a] + want[x] + span[len(x) : len(span) - len(y)] + want[y]
                    else:
                        built += old[at:a] + want[span]
                    at = b
                assert new.text == built + old[at:]
    kept = {r.id: r for r in X.checked(t, told).collect()}
    assert all(r.form_kept for r in kept.values())
    if arm == X.KEPT:
        assert all(r.rank_kept for r in kept.values())
        assert got[5].state == "failed" or [o.text for o in got[5].options][0] + ".0" == [o.text for o in got[5].options][1]
    assert kept[1].n_changed == 0 and kept[0].n_changed == 4


def test_no_items(spark):
    assert X.isomorphs(spark.createDataFrame([], SCHEMA), rounds=(4,)).count() == 0
    assert X.isomorphs(spark.createDataFrame([(1, None)], SCHEMA), rounds=(4,)).first().state == "no numerals"


def test_attempts_are_made_where_the_item_is(spark):
    t = spark.createDataFrame([(1, [("A", "12"), ("B", "34")])], SCHEMA)
    plan = X.isomorphs(t)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Generate" not in plan and plan.count("MapInArrow") == 1
