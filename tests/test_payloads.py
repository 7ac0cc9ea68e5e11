import json
import re

import pytest
from pyspark.sql import functions as F

from rulemeter.functions import payloads as P


def told(spark, column, texts):
    t = spark.createDataFrame(list(enumerate(texts)), "i int, s string")
    return {texts[r.i]: r.v for r in t.select("i", column(F.col("s")).alias("v")).collect()}


def test_objects_in_loose_text(spark):
    cases = {
        '{"a": 1}': '{"a": 1}', '```json\n{"a": 1}\n```': '{"a": 1}', 'Here it is: {"a": {"b": 2}} and more }': '{"a": {"b": 2}} and more }', '```\n{"a": "2 \\cdot \\frac{1}{2}"}\n```': '{"a": "2 \\\\cdot \\\\frac{1}{2}"}', '{"a": "\\("}': '{"a": "\\\\("}',
        "no brace": None, '{"a": }': None, "[1, 2]": None, "": None, None: None, '{"a": "x\\ny"}': '{"a": "x\\ny"}',
    }
    assert told(spark, P.json_object, list(cases)) == cases


@pytest.mark.parametrize(
    ("payload", "want"),
    [
        ({"options": {"A": "1", "(b)": "2", " g ": "3", "H": "4", "z": "5", "5": ""}}, {"A": "1", "B": "2", "C": "4"}),
        ({"options": {"F": "first", "A": "second"}}, {"A": "first"}),
        ({"options": {"a": None, "b": "x"}}, {"B": "x"}),
        ({"options": ["p", " ", "r", "s", "t", "u"]}, {"A": "p", "C": "r", "D": "s", "E": "t"}),
        ({"options": [{"label": "2", "text": "x"}, {"key": "A", "content": "y"}, {"value": "z"}, {"label": "B", "text": "later"}, "plain"]}, {"B": "x", "A": "y", "C": "z", "E": "plain"}),
        ({"options": "text"}, {}), ({"other": 1}, {}), ({"options": None}, {}), ({"options": []}, {}),
    ],
)
def test_options(spark, payload, want):
    assert spark.range(1).select(P.options(P.json_object(F.lit(json.dumps(payload)))).alias("m")).first().m == want


def test_no_payload(spark):
    r = spark.range(1).select(P.options(F.lit(None).cast("string")).alias("m"), P.equation_texts(F.lit(None).cast("string")).alias("e")).first()
    assert (r.m, r.e) == (None, [])


def ascii_of(latex):
    """The rewriting written out."""
    t = latex.strip()
    for f in P.FENCES:
        t = t.replace(f, "")
    for a, b in P.SYMBOLS:
        t = t.replace(a, b)
    while (new := re.sub(P.FRAC, r"(\1)/(\2)", t)) != t:
        t = new
    t = re.sub(r"\\sqrt\s*\{([^{}]+)\}", r"sqrt(\1)", t)
    t = re.sub(r"\\sqrt\s*([A-Za-z0-9]+)", r"sqrt(\1)", t)
    t = re.sub(r"\^\{([^{}]+)\}", r"**(\1)", t)
    t = re.sub(r"\^([A-Za-z0-9]+)", r"**\1", t)
    t = re.sub(r"\\([a-zA-Z]+)", lambda m: m[1] if m[1] in P.KEPT_COMMANDS else " ", t)
    return re.sub(r"\s+", " ", t.replace("{", "(").replace("}", ")")).strip()


def test_latex(spark):
    cases = [
        r"\(x = \frac{1}{2}\)", r"\frac{\frac{1}{2}}{\frac{\frac{a}{b}}{3}} \leq 4", r"$$\sqrt{x^2} \cdot \sqrt 9$$", r"x^{2+y} \neq \pi", r"\left( 2 \right) \div 3", r"\frac{1}{", r"\sinh x + \sin x \quad \text{cm}", "", "plain", r"\frac {a} {b}\frac{c}{d}", "\\ge\n 3",
        r"\frac{\sqrt{2}}{3}",
    ]
    assert told(spark, P.latex_to_ascii, cases) == {c: ascii_of(c) for c in cases}


def test_equations(spark):
    payloads = [
        {"equations": ["x + y = 3", {"ascii": " 2x = 4 ", "latex": "no"}, {"latex": r"\frac{1}{2}x = 5"}, {"ascii": ""}, ""]}, {"equations": {"latex": "a = 1"}}, {"equations": None}, {}, {"equations": "x = 1"},
    ]
    got = told(spark, lambda s: P.equation_texts(P.json_object(s)), [json.dumps(p) for p in payloads])
    assert list(got.values()) == [["x + y = 3", "2x = 4", "(1)/(2)x = 5"], ["a = 1"], [], [], []]
