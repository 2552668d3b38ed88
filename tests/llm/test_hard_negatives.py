"""Hard negatives against a plain version, and the packing's exactness."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from colloquy.llm import hard_negatives as hn
from colloquy.llm.queries import op11_hard_negatives
from tests.conftest import SF

SCHEMA = "vec_id long, embedding array<double>, label int, score string"


def by_hand(rows, relabel=True, percent=80):
    one = {}
    for i, v, label, *_ in rows:
        if i is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        label = (label + 1) % 10 if relabel and i % 7 == 0 else label
        one[i] = min(one.get(i, (label, v)), (label, v))
    c = {i: (label, [int(x) * 256 if abs(x) > 2**53 else math.floor(256 * x) for x in v]) for i, (label, v) in one.items()}
    out = []
    for a in [i for i in c if i % 100 == 0]:
        score = {i: sum(x * y for x, y in zip(c[a][1], v)) for i, (_, v) in c.items() if i != a}
        order = sorted(score, key=lambda i: (-score[i], i))
        for p in [i for i in order if c[i][0] == c[a][0]][:5]:
            near = [i for i in order if c[i][0] != c[a][0] and percent * score[p] <= 100 * score[i] <= 100 * score[p]]
            out += [(a, p, k + 1, i, score[p], score[i]) for k, i in enumerate(near[:5])]
    return sorted(out)


def run(spark, rows, **more):
    found = hn.hard_negatives(spark.createDataFrame(rows, SCHEMA), relabel=True, **more)
    return sorted(map(tuple, found.collect()))


@pytest.fixture(params=["small blocks", "as given"])
def blocks(request, monkeypatch):
    if request.param == "small blocks":
        monkeypatch.setattr(hn, "BLOCK", 9)
        monkeypatch.setattr(hn, "ANCHORS", 2)


def test_equals_brute_force(spark, blocks):
    draw = random.Random(3)
    rows = [(i, [draw.gauss(0.05, 0.1) for _ in range(draw.choice([0, 3, 8, 8, 8]))], draw.choice([1, 1, 1, 2, 3]), "x") for i in range(-200, 420, 3)]
    rows += [(600, [0.5] * 8, 1, "x"), (601, [0.5] * 8, 1, "x"), (602, [0.5] * 8, 2, "x"), (603, [0.5] * 8, 2, "x"), (600, [0.5] * 8, 1, "x"), (603, [0.4] * 8, 2, "y")]
    rows += [(700, None, 1, "x"), (800, [0.1], None, "x"), (None, [0.1], 1, "x"), (900, [0.1, None], 1, "x"), (1000, [float("nan")], 1, "x"), (1100, [float("-inf"), 1.0], 2, "x")]
    want = by_hand(rows)
    assert want and run(spark, rows) == want


def test_components_of_any_size(spark):
    rows = [(0, [1e18, -3.0, 2.0**70], 0, ""), (1, [1e18, 5.0, 1.0], 1, ""), (2, [1e18, 4.0, 0.0], 2, ""), (3, [9e17, 1.0, 0.5], 2, ""), (4, [1e17, 0.0, 0.0], 2, "")]
    found = run(spark, rows)
    assert found == [(a, p, k, n, ps if abs(ps) < 2**63 else None, ns if abs(ns) < 2**63 else None) for a, p, k, n, ps, ns in by_hand(rows)] and found


def test_packed_products_are_exact():
    draw = np.random.default_rng(1)
    for most in (1, 100, 10**6, 10**30):
        p = hn.Packing(5, most)
        ints = [[int(x * most) for x in draw.uniform(-1, 1, 5)] for _ in range(50)]
        biased = np.array(ints, object) + most
        block = hn.Block(p, np.arange(50), [[0.0] * 5] * 50)
        block.fields, block.sums = p.packed(biased.astype(np.int64) if p.small else biased), biased.sum(axis=1)
        for row in range(0, 50, 7):
            assert list(block.scores(biased[row])) == [sum(x * y for x, y in zip(ints[row], other)) for other in ints]
            assert [p.score(p.order(int(s))) for s in block.scores(biased[row])] == list(block.scores(biased[row]))


def test_nothing_in(spark):
    assert run(spark, []) == []
    assert run(spark, [(1, [0.5], 1, "x")]) == []


def test_query_equals_its_sql(spark, duck):
    from colloquy.llm.queries import OP11_SQL

    want = duck.execute(OP11_SQL).fetchall()
    found = op11_hard_negatives(spark, SF).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
    assert sorted(map(tuple, found.collect())) == sorted(want)
    assert found.where(F.col("rank") > 5).count() == 0
