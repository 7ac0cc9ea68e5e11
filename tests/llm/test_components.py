"""Components: edges of one task are contracted at once, more in rounds; both give the smallest reachable node."""

from __future__ import annotations

import random

import pytest

from rulemeter.llm import common
from rulemeter.llm.components import components


def _expected(edges: list[tuple[int, int]]) -> dict[int, int]:
    up: dict[int, int] = {}

    def root(x: int) -> int:
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            x, y = root(a), root(b)
            up[max(x, y)] = min(x, y)
    return {x: root(x) for x in up}


def _edges() -> list[tuple[int, int]]:
    rng = random.Random(3)
    chain = [(i, i + 1) for i in range(400)]
    star = [(5000, 5000 + i) for i in range(1, 60)]
    wild = [(rng.randrange(-(1 << 62), 1 << 62), rng.randrange(6000, 6400)) for _ in range(300)]
    return [*chain, *star, *wild, *((b, a) for a, b in chain[:50]), (7, 7), (9999, 9999), (None, 3), (3, None)]


@pytest.mark.parametrize("task_rows", [500_000, 300, 20])
def test_smallest_reachable_node(spark, monkeypatch, task_rows):
    monkeypatch.setattr(common, "TASK_ROWS", task_rows)
    edges = _edges()
    got = components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert len(got) == len({r.node for r in got})
    assert {r.node: r.component for r in got} == _expected(edges)


def test_small_tables_are_few_jobs(spark):
    edges = spark.createDataFrame(_edges(), "a long, b long").localCheckpoint()
    before = len(spark.sparkContext.statusTracker().getJobIdsForGroup(None))
    components(edges).count()
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup(None)) - before <= 12
