"""Components of links, and what a round of them shuffles."""

import random

import numpy as np

from colloquy.llm import components as cc


def by_hand(links):
    label = {x: x for pair in links for x in pair}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            low = min(label[a], label[b])
            changed |= label[a] != low or label[b] != low
            label[a] = label[b] = low
    return {x: c for x, c in label.items() if any(x in pair and pair[0] != pair[1] for pair in links)}


def graphs():
    draw = random.Random(4)
    ids = [draw.randrange(-(2**63), 2**63) for _ in range(400)]
    chain = [*zip(ids[:150], ids[1:150])]
    star = [(ids[200], x) for x in ids[201:300]]
    sparse = [(draw.choice(ids[300:]), draw.choice(ids[300:])) for _ in range(60)]
    return [chain, star, sparse, [*chain, *star, *sparse, (ids[3], ids[250]), *star[:5]], [(5, 5)]]


def test_components_equal_plain_ones(spark, monkeypatch):
    """Chains, stars, repeated links and loops, spread over tasks, and contracted a few links at a time."""
    for most in (1 << 18, 7):
        monkeypatch.setattr(cc, "LINKS", most)
        links = graphs()[3]
        for parts in (1, 5):
            got = cc.connected_components(spark.createDataFrame(links, "a long, b long").repartition(parts)).collect()
            assert len(got) == len({r["node"] for r in got}) and {r["node"]: r["component"] for r in got} == by_hand(links)
    assert not cc.connected_components(spark.createDataFrame([(5, 5)], "a long, b long")).count()


def test_labels_within_a_task():
    for links in graphs():
        nodes, labels = cc.least_labels(*np.array(links, np.int64).T)
        assert {n: c for n, c in zip(nodes.tolist(), labels.tolist()) if links != [(5, 5)]} == by_hand(links)


def test_a_round_shuffles_labels_twice(spark, monkeypatch):
    """Every table that a round writes takes one shuffle to contract and one to drop repeated labels."""
    taken, write = [], cc.written

    def noted(df, name):
        taken.append(df._jdf.queryExecution().executedPlan().toString().count("Exchange "))
        return write(df, name)

    monkeypatch.setattr(cc, "written", noted)
    cc.connected_components(spark.createDataFrame(graphs()[0], "a long, b long")).count()
    assert len(taken) > 2 and max(taken) <= 2
