"""Trained operators against plain versions of what they compute: a step at a time, or all rows at once."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from colloquy.llm import language, quality
from colloquy.llm.common import isotonic, table
from tests.conftest import SF
from tests.llm.test_llm_operators import fold, texts

soft = lambda x: x / (1 + abs(x))


def plain_step(d, code, state):
    """One gated step in Python numbers."""
    h, seen = len(state), d.read[code].tolist()
    gate = [0.5 + 0.5 * soft(seen[k] + sum(state[i] * float(d.gates[i, k]) for i in range(h))) for k in range(2 * h)]
    new = [soft(seen[2 * h + k] + sum(gate[i] * state[i] * float(d.candidate[i, k]) for i in range(h))) for k in range(h)]
    return [s + gate[h + k] * (new[k] - s) for k, s in enumerate(state)]


def plain_probabilities(net, text, core, context):
    """Mean over a text's positions, each labelled from the states of both directions around it."""
    total, longest, h = [0.0] * len(net.languages), min(core, len(text)), len(net.forward.candidate)
    code = lambda i: text[i] if 0 <= i < len(text) else language.EDGE
    for start in range(0, len(text), core):
        ahead, behind = {}, {}
        state = [0.0] * h
        for i in range(start - context, start + longest):
            ahead[i] = state = plain_step(net.forward, code(i), state)
        state = [0.0] * h
        for i in range(start + longest + context - 1, start - 1, -1):
            behind[i] = state = plain_step(net.backward, code(i), state)
        for i in range(start, min(start + core, len(text))):
            both = [*ahead[i], *behind[i]]
            score = [sum(x * float(w) for x, w in zip(both, net.out[:, k])) + float(net.bias[k]) for k in range(len(net.languages))]
            e = [math.exp(s - max(score)) for s in score]
            total = [t + x / sum(e) for t, x in zip(total, e)]
    return [t / max(1, len(text)) for t in total]


def test_language_scores_equal_a_step_at_a_time():
    rng = np.random.default_rng(3)
    net = language.Network(["x", "y", "z"], language.Direction.new(rng, 4), language.Direction.new(rng, 4), rng.standard_normal((8, 3)).astype(np.float32), rng.standard_normal(3).astype(np.float32))
    for text in ["a", "été zor", "word " * 9, "y" * 70]:
        names, score = language.predict(net, [text], 16, 5)
        want = plain_probabilities(net, text.encode(), 16, 5)
        assert names == [net.languages[int(np.argmax(want))]] and score[0] == pytest.approx(max(want), abs=1e-5)


def test_quality_fit_equals_one_solve(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    known = {r["doc_id"]: r["quality"] for r in labels.where("quality IS NOT NULL").collect()}
    every = texts(docs)
    rows = [(i, t) for i, t in every if i in known and fold(i, 5) != 0]
    model = quality.fit_quality(quality.with_statistics(docs), labels)
    stats, y = np.array([quality.statistics(t) for _, t in rows]), np.array([known[i] for i, _ in rows], float)
    assert np.allclose(model.mean, stats.mean(0)) and np.allclose(model.spread[stats.std(0) > 1e-9], stats.std(0)[stats.std(0) > 1e-9])
    x = model.waves(stats)
    weights = np.linalg.solve(x.T @ x + 0.05 * np.eye(x.shape[1]), x.T @ y)
    assert np.allclose(model.weights, weights, atol=1e-6)
    centre = lambda s: (np.clip(np.floor(s * 256 + 128), 0, 511) + 0.5) / 256 - 0.5
    at = centre(x @ weights)
    knots, values = isotonic(np.append(at, [at.min(), at.max()]), np.append(y, [0, 1]))
    got = {r["doc_id"]: r["score"] for r in quality.quality(quality.with_statistics(docs.where(F.col("doc_id") % 7 == 0)), model).collect()}
    for i, t in every:
        if i in got:
            raw = float((model.waves(np.array([quality.statistics(t)])) @ weights)[0])
            assert got[i] == pytest.approx(float(np.clip(np.interp(raw, knots, values), 0, 1)), abs=1e-4)
