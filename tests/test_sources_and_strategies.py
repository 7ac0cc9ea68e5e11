import json

from pyspark.sql import functions as F

from rulemeter.functions import formulas
from rulemeter.operators import strategies as S
from rulemeter.sources import tables as IO
from rulemeter.streaming import trials as ST


def item(i, **x):
    return {"id": i, "corpus": "c", "authority": "a", "claim": "k", "stem": "s", "key": "A", "responseType": "numeric", "sourceUrl": "u", "licenseNote": "n"} | x


def test_items_are_read_checked_and_quarantined(spark, tmp_path):
    rows = [item("1", choices={"B": "x", "A": "y"}, responseType="selected"), item("2", responseType="selected"), item("3", role="retrieval-pool"), item("4", key=" "), item("4", percentCorrect=130)]
    (tmp_path / "i.jsonl").write_text("\n".join(map(json.dumps, rows)) + "\n{not json\n")
    path = str(tmp_path / "i.jsonl")
    got = IO.read_items(spark, path)
    assert sorted(r.id for r in got.collect()) == ["1", "2", "4", "4"]
    assert [r.line for r in IO.quarantine(spark, path, "item").collect()] == ["{not json"]
    assert {(r.key, r.violation) for r in IO.violations(got, "item").collect()} == {("2", "fewer than two choices"), ("4", "empty key"), ("4", "percentCorrect out of range"), ("4", "repeated key")}
    options = IO.lettered(got).filter("id = '1'").first().options
    assert [(o.letter, o.text) for o in options] == [("A", "y"), ("B", "x")]
    blind = IO.blinded(IO.lettered(got)).filter("id = '1'").first()
    assert len(blind.opaqueId) == 12 and dict((o.letter, o.text) for o in blind.shuffled)[blind.shuffledKey] == "y"


def test_wrapped_and_bare_files(spark, tmp_path):
    claims = [{"authority": "a", "code": "c", "operations": ["x"]}, {"authority": "a", "code": "d"}]
    (tmp_path / "w.json").write_text(json.dumps({"claims": claims}, indent=1))
    (tmp_path / "b.json").write_text(json.dumps(claims))
    for name in "wb":
        assert [r.code for r in IO.read_json_or_lines(spark, str(tmp_path / f"{name}.json"), "claim", "claims").collect()] == ["c", "d"]


def test_log_resumes_and_stream_drops_repeats(spark, tmp_path):
    row = lambda i, p: (f"{i}{p}", i, p, "ch", "A", True, False, None, ["t"], "2024-01-01T00:00:00Z")
    a = spark.createDataFrame([row("1", "x"), row("1", "x"), row("2", "x")], IO.TRIAL)
    assert IO.append_new(a, str(tmp_path / "log")) == 2
    assert IO.append_new(a.unionByName(spark.createDataFrame([row("3", "x")], IO.TRIAL)), str(tmp_path / "log")) == 1
    a.write.json(str(tmp_path / "in"))
    ST.write_log(ST.first_trials(ST.read_trials(spark, str(tmp_path / "in"))), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2


def test_formulas(spark):
    o = [("A", "10"), ("B", "50"), ("C", "3/4"), ("D", "0.2")]
    cases = {
        "What is 25% of 40?": ("percent-of", "A"),
        "A markup of 25 % on 40": ("percent-change", "B"),
        "Compute 1/2 divided by 2/3": ("invert-and-multiply", None),
        "Find the area of a 5 by 10 rectangle": ("area-lw", "B"),
        "The average of 5, 10 and 15": ("mean-of-listed-numbers", "A"),
        "A box of 1 by 5 by 2": ("volume-lwh", "A"),
        "Solve 50x": ("coefficient-adjacent-to-x", "B"),
        "10 for 50 zeds": ("unit-rate", "D"),
    }
    df = spark.createDataFrame([(s, o) for s in cases], "stem string, options array<struct<letter:string,text:string>>")
    told = formulas.answers(F.col("stem"), F.col("options"))
    got = {r.stem: r for r in df.select("stem", *[c.alias(n) for n, c in told.items()]).collect()}
    for stem, (rule, want) in cases.items():
        assert got[stem][rule] == want, (stem, rule)


def test_strategies(spark):
    schema = "id string, stem string, options array<struct<letter:string,text:string>>"
    items = spark.createDataFrame([("1", "with 3 and 4", [("A", "12"), ("B", "24"), ("C", "120"), ("D", "7.7")]), ("2", None, []), ("3", "no numbers", [("A", "x"), ("B", "y")])], schema)
    assert {r.id: r.answer for r in S.hub(items).collect()} == {"1": "A"}
    got = {r.id: (r.answer, r.depth) for r in S.closure_answers(items).collect()}
    assert got == {"1": ("A", 1), "2": (None, None), "3": (None, None)}
    told = {r.id: (r.answer, r.branch) for r in S.portfolio(items, [("s3", S.closure_answers(items)), ("s1", S.hub(items))]).collect()}
    assert told == {"1": ("A", "s3"), "2": ("B", "fallback"), "3": ("B", "fallback")}
