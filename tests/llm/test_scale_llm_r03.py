"""What the training-data operators move between tasks, and hold in one."""

import random

import numpy as np

from colloquy.llm import attention, lm_scoring, near_duplicates, subwords
from colloquy.llm import ngram_join as nj
from colloquy.llm.near_duplicates import shingle_set
from tests.llm.test_ngram_join import by_hand, edited, run


def test_parity_sketches_never_rule_out_a_link():
    """Sets of any size, at the similarity's very border: bits that differ are no more than tokens that do."""
    draw = np.random.default_rng(3)
    for n in (1, 2, 19, 100, 5000, 60_000):
        same = draw.integers(-(2**63), 2**63 - 1, n, np.int64, endpoint=True)
        for extra in (0, n // 9, n // 2):  # n // 9 more: just within 90 %
            both = np.concatenate([same, draw.integers(-(2**63), 2**63 - 1, extra, np.int64, endpoint=True)])
            differ = int(np.bitwise_count(nj.parity(np.unique(same)) ^ nj.parity(np.unique(both))).sum())
            assert differ <= extra
            assert extra != n // 9 or differ * 190 <= 10 * (2 * n + extra)


def test_sets_of_distant_pairs_are_not_fetched(spark, monkeypatch):
    """Of texts around a common passage only near ones have their full sets shuffled."""
    draw, fetched = random.Random(11), []
    passage = [f"p{k}" for k in range(60)]
    rows = [" ".join(passage + [f"r{draw.randrange(10**9)}" for _ in range(60)]) for _ in range(20)]
    copy = rows[0].split()
    rows = [*enumerate([*rows, " ".join(edited(draw, copy, 1))])]

    def noted(texts, wanted, words):
        fetched.extend(r["node"] for r in wanted.select("node").collect())
        return near_duplicates.full_sets(texts, wanted, words)

    monkeypatch.setattr(nj, "full_sets", noted)
    assert run(spark, rows) == by_hand(rows)
    assert len(fetched) == 2


def test_full_sets_travel_once(spark):
    """One shuffle holds the sets, by node alone; repeated rows and other texts with the same id give one set of each wanted node."""
    rows = spark.createDataFrame([(1, "a b c d"), (1, "a b c d"), (2, "A b c d"), (1, "other words here"), (None, "x y z"), (5, "")], "doc_id long, text string")
    nodes = {t: nj.set_hash(shingle_set(t, 3)) for t in ("a b c d", "x y z")}
    wanted = spark.createDataFrame([(nodes["a b c d"], 1), (nodes["x y z"], None)], "node long, rep long")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        sets = near_duplicates.full_sets(rows, wanted, 3)
        plan = sets._jdf.queryExecution().executedPlan().toString()
        assert plan[: plan.index("MapInArrow")].count("Exchange hashpartitioning") == 1
        assert {r["node"]: r["hashes"] for r in sets.collect()} == {n: shingle_set(t, 3).tobytes() for t, n in nodes.items()} and sets.count() == 2
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_a_task_passes_windows_on(spark):
    """However much a block or a text holds, a row of drawn windows holds 4 MB and no more than a run beyond it, and nothing is lost."""
    path, n = subwords.default_path(), 1_500_000
    df = spark.createDataFrame([(1, "a b c " * (n // 3), False), (2, "held out", True)], "doc_id long, text string, held_out boolean").coalesce(1)
    vocabulary = attention.Vocabulary.of(np.ones(lm_scoring.word_ids(path).end + 1))
    found = lm_scoring.drawn_windows(lm_scoring.in_blocks(df, 50_000), vocabulary, path, 1.0, 1).collect()
    assert len(found) > 1 and max(len(r["windows"]) for r in found) < lm_scoring.HELD_WINDOWS + 10_000
    lines = np.concatenate([np.frombuffer(r["windows"], "<i2").reshape(-1, attention.CONTEXT + attention.CORE + 1) for r in found])
    assert (lines[:, attention.CONTEXT + 1 :] >= 0).sum() == n + 1


def test_runs_cut_from_a_whole_text_are_those_encoded_alone():
    """Every run's ids and context, also of texts with few words, odd white space and ids of special strings."""
    ids = lm_scoring.word_ids(subwords.default_path())
    row, lead = np.arange(ids.end + 1) % 30_000, attention.CONTEXT + attention.CORE
    draw = random.Random(5)
    kinds = ["plain", "Don't", "x\u00e4\u00f6", "\u4e2d\u6587", "1234567", "<|endoftext|>", "\u00a0y", "...!?"]
    for n in (0, 1, 63, 64, 65, 128, 500):
        words = [draw.choice(kinds).encode().lower() for _ in range(n)]
        got = lm_scoring.run_windows(ids, row, -7, words, list(range(n // lm_scoring.RUN + 1)))
        for k, lines in enumerate(got):
            own = ids.of(words[k * lm_scoring.RUN : (k + 1) * lm_scoring.RUN])
            own = own if k == len(got) - 1 else own[:-1]
            known = ids.of(words[: k * lm_scoring.RUN])[:-1][-lead:]
            targets = lines[:, attention.CONTEXT + 1 :].reshape(-1)
            assert (targets[: len(own)] == row[own]).all() and (targets[len(own) :] == -1).all()
            assert k == 0 or not len(own) or (lines[0, : attention.CONTEXT + 1] == row[known[-attention.CONTEXT - 1 :]]).all()
