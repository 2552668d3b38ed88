"""The n-gram join against a plain version, its filters, and its long lists."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from colloquy.llm import near_duplicates
from colloquy.llm import ngram_join as nj
from colloquy.llm.common import table
from colloquy.llm.near_duplicates import shingle_set, shingles
from tests.conftest import SF
from tests.llm.test_llm_operators import ODD

SCHEMA = "doc_id long, text string, node string, component string, n long"


def tokens(text):
    ws = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(ws[i : i + 3]) for i in range(max(1, len(ws) - 2))} if ws else set()


def by_hand(rows, percent=90):
    sets = [tokens(t) for _, t in rows]
    parent = list(range(len(rows)))

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * len(sets[i] | sets[j]):
                parent[top(i)] = top(j)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[top(k)] = min(least.get(top(k), i), i)
    return sorted(((i, len(s), least.get(top(k), i)) for k, ((i, _), s) in enumerate(zip(rows, sets))), key=repr)


def run(spark, rows):
    df = spark.createDataFrame([(i, t, "clash", "clash", 1) for i, t in rows], SCHEMA)
    return sorted(map(tuple, nj.ngram_join(df).collect()), key=repr)


def edited(draw, words, n):
    out = list(words)
    for _ in range(n):
        k = draw.randrange(max(1, len(out)))
        if draw.random() < 0.5 or not out:
            out[k : k + 1] = [ f"e{draw.randrange(10**6)}"]
        else:
            del out[k]
    return out


@pytest.mark.parametrize("short", [48, 2])
def test_equals_brute_force(spark, monkeypatch, short):
    """Chains of edits, texts around a common passage, tiny texts; with lists cut short every list is split by the other orders."""
    monkeypatch.setattr(nj, "SHORT_LIST", short)
    monkeypatch.setattr(nj, "HUBS", 1 if short == 2 else 16)
    draw = random.Random(7)
    vocabulary = [f"w{k}" for k in range(300)]
    passage = [draw.choice(vocabulary) for _ in range(40)]
    rows = []
    for _ in range(6):
        words = [draw.choice(vocabulary) for _ in range(draw.randrange(60, 150))]
        for _ in range(6):
            rows.append(" ".join(words))
            words = edited(draw, words, draw.randrange(0, 3))
    rows += [" ".join(edited(draw, passage, draw.randrange(2)) + [draw.choice(vocabulary) for _ in range(draw.randrange(0, 12))]) for _ in range(40)]
    rows += [" ".join(draw.choice("a b".split()) for _ in range(draw.randrange(1, 14))) for _ in range(40)]
    rows = [(1000 - 3 * k, t) for k, t in enumerate(rows)]
    want = by_hand(rows)
    assert sum(i != c for i, _, c in want) > 20 and run(spark, rows) == want


def test_odd_rows(spark):
    rows = [*enumerate(ODD), (None, "null id"), (None, "one two three four"), (70, "ONE two\tthree four"), (3, "one"), (3, "one")]
    assert run(spark, rows) == by_hand(rows)


def test_nothing_in(spark):
    assert run(spark, []) == []
    assert run(spark, [(1, None), (2, "")]) == [(1, 0, 1), (2, 0, 2)]


def test_pairs_within_the_similarity_share_a_prefix_token_in_every_order():
    draw = random.Random(2)
    classes = np.array([draw.randrange(4) for _ in range(nj.COUNTERS)], np.uint8)
    met = 0
    for _ in range(300):
        words = [f"w{draw.randrange(40)}" for _ in range(draw.randrange(1, 80))]
        x, y = (shingle_set(" ".join(w), 3) for w in (words, edited(draw, words, draw.randrange(0, 3)) or ["x"]))
        both = len(np.intersect1d(x, y))
        if 100 * both >= 90 * (len(x) + len(y) - both):
            met += 1
            for start in nj.ORDERS:
                p, q = (nj.prefix(s, classes[s & (nj.COUNTERS - 1)], 90, start) for s in (x, y))
                assert len(np.intersect1d(p, q))
    assert met > 50


def test_frequency_classes_count_all_documents(spark):
    docs = table(spark, SF, "documents").select("text")
    got = nj.frequency_classes(docs.select(F.coalesce("text", F.lit("")).alias("text")), 3)
    want = np.zeros(nj.COUNTERS, int)
    for r in docs.collect():
        np.add.at(want, shingles(r["text"] or "", 3) & (nj.COUNTERS - 1), 1)
    assert (got == nj.scale(want)).all()


def test_words_are_hashed_as_they_are_split(monkeypatch):
    texts = [t or "" for t in ODD] + ["a\x0bb\x1cc d\x85e\u00a0f", "  x", "same same other same", "ab ba a b"]
    known = {}
    for part in (1 << 20, 3):
        monkeypatch.setattr(near_duplicates, "PART", part)
        for t in texts:
            ws, got = t.encode().lower().split(), near_duplicates.word_hashes(t.encode().lower())
            assert len(ws) == len(got)
            for w, h in zip(ws, got.tolist()):
                assert known.setdefault(w, h) == h
    assert len(set(known.values())) == len(known)
