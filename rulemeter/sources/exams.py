"""Exam texts to items: a small state machine over lines, run in Arrow batches, and joins to keys."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

_LETTER = re.compile(r"^\(?([A-HJ]|[1-4])[.)\]]?(?:\s+(.*))?$")
_CHROME = re.compile(r"^(page \d+|go on|stop|use this space)\b", re.I)
# fixed values: letters and digits of choices that other forms call A to D
_RENAMED = {"F": "A", "G": "B", "H": "C", "J": "D", "1": "A", "2": "B", "3": "C", "4": "D"}
# end of fixed values


def parse_block(text: str | None) -> tuple[str, dict[str, str]]:
    """Stem and choices of a question's lines. F-J and 1-4 are renamed to A-D if no A comes first; page furniture is dropped."""
    stem, choices, current = [], {}, None
    for line in re.sub(r"\s(?=\([1-4]\)\s)", "\n", text or "").splitlines():
        s = " ".join(line.split())
        if not s or _CHROME.match(s):
            continue
        m = _LETTER.match(s)
        letter = m and (m[1] if m[1] in "ABCDE" and "F" not in choices else _RENAMED.get(m[1], m[1]))
        expected = chr(65 + len(choices))
        if m and letter == expected:
            current = letter
            choices[letter] = m[2] or ""
        elif current:
            choices[current] = f"{choices[current]} {s}".strip()
        else:
            stem.append(s)
    return " ".join(stem), {k: v for k, v in choices.items() if v}


def questions(pages: DataFrame, doc: str = "doc", text: str = "text") -> DataFrame:
    """(doc, number, stem, choices) of texts whose questions begin with a number and a point."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            out = []
            for d, t in zip(p["doc"], p["text"], strict=True):
                cut = re.split(r"(?m)^\s*(\d{1,3})\.\s+", t or "")
                out += [(d, int(n), *parse_block(body)) for n, body in zip(cut[1::2], cut[2::2], strict=True)]
            yield pd.DataFrame(out, columns=["doc", "number", "stem", "choices"])

    return pages.select(F.col(doc).cast("string").alias("doc"), F.col(text).alias("text")).mapInPandas(run, "doc string, number int, stem string, choices map<string,string>")


def with_keys(found: DataFrame, keys: DataFrame, least: int = 2) -> DataFrame:
    """Questions joined with (doc, number, key); adds reject, null for those that make an item. A repeated key keeps its first letter."""
    one = keys.groupBy("doc", "number").agg(F.min("key").alias("key"))
    t = found.join(one, ["doc", "number"], "left")
    why = F.when(F.trim("stem") == "", "no stem").when(F.size("choices") < least, "too few choices").when(F.col("key").isNull(), "no key").when(~F.map_contains_key("choices", F.coalesce("key", F.lit(""))), "key not in choices")
    return t.withColumn("reject", why)


def responses(lines: DataFrame) -> DataFrame:
    """(file, position, letter, note) of answer files with (file, line_no, line): comments, start and end lines are left out,
    a letter is A to D or R, and what is neither has a null letter."""
    t = lines.withColumn("s", F.trim("line")).filter((F.col("s") != "") & ~F.col("s").rlike(r"(?i)^(#|//|start\b|end\b)"))
    word = F.split("s", r"\s+")
    letter = F.upper(F.get(word, F.lit(0)))
    ok = letter.rlike("^[A-DR]$") & (F.size(word) <= 2)
    return t.select("file", F.row_number().over(W.partitionBy("file").orderBy("line_no")).alias("position"), F.when(ok, letter).alias("letter"), F.when(ok, F.get(word, F.lit(1))).alias("note"))
