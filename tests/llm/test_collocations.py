"""Collocations against a plain version: counts from the graph, paths, cuts, order and odd rows."""

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from colloquy.llm import collocations as co
from colloquy.llm.common import table
from tests.conftest import SF
from tests.llm.test_llm_operators import ODD

SCHEMA = "doc_id long, text string, lang string, word string, n string, score int"


def runs_by_hand(rows):
    f = Counter()
    for _, text, lang in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            ws = re.findall(r"[^\x20\x09]+", piece)
            for m in range(1, 5):
                for i in range(len(ws) - m + 1):
                    f["und" if lang is None else lang, tuple(ws[i : i + m])] += 1
    return f


def by_hand(rows, least, percent=80, first=2000):
    f = runs_by_hand(rows)
    around = Counter()
    for (lang, run), n in f.items():
        for m in range(2, len(run)):
            for i in range(len(run) - m + 1):
                around[lang, run[i : i + m]] = max(around[lang, run[i : i + m]], n)
    found = {}
    for (lang, run), a in f.items():
        if len(run) > 1 and a >= least and 100 * around[lang, run] < percent * a:
            cuts = [(2_000_000 * a // (f[lang, run[:k]] + f[lang, run[k:]]), k) for k in range(1, len(run))]
            score, k = min(cuts)
            found.setdefault(lang, []).append((-score, -a, " ".join(run).encode(), f[lang, run[:k]], f[lang, run[k:]]))
    n = Counter()
    for (lang, run), c in f.items():
        n[lang] += c if len(run) == 1 else 0
    return sorted((lang, k + 1, p.decode(), -a, l, r, n[lang], -s) for lang, top in found.items() for k, (s, a, p, l, r) in enumerate(sorted(top)[:first]))


def run(spark, rows, least, **more):
    df = spark.createDataFrame([(i, t, lang, "clash", "clash", 0) for i, t, lang in rows], SCHEMA)
    found = co.collocations(df, least=least, **more)
    return sorted(map(tuple, found.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()))


def made(seed=5):
    draw = random.Random(seed)
    passage = [f"p{k}" for k in range(30)]
    rows = []
    for i in range(120):
        words = []
        for _ in range(draw.randrange(1, 40)):
            words.append(draw.choice(["of", "the", "THE", "a", "x", "y", f"r{draw.randrange(500)}", "é", "new york city"]) + draw.choice(["", "", "", "", ".", ",", "!", "\n", "\t"]))
        if i % 3 == 0:
            words += [":", *passage[: draw.choice([30, 30, 12])]]
        rows.append((i % 50, draw.choice([" ", " ", "  "]).join(words), draw.choice(["en", "en", "en", "de", None])))
    return rows + [(500, "a a a a a a a a a. a a a", "en")] * 3


@pytest.mark.parametrize("least", [3, 30])
def test_equals_brute_force(spark, least):
    rows = made()
    want = by_hand(rows, least)
    assert want and run(spark, rows, least) == want


def test_few_common_words_and_bits(spark, monkeypatch):
    """With codes by rank for three words only, small batches and a full table of bits, all is the same."""
    monkeypatch.setattr(co, "COMMON", 3)
    monkeypatch.setattr(co, "AT_ONCE", 100)
    monkeypatch.setattr(co, "MOST_BITS", 64)
    monkeypatch.setattr(co, "MOST_COUNTERS", 64)
    assert run(spark, made(), 4, first=7, percent=95) == by_hand(made(), 4, 95, 7)


def test_runs_equal_counts(spark):
    docs = table(spark, SF, "documents")
    f = runs_by_hand([(0, r["text"], r["lang"]) for r in docs.select("text", "lang").collect()])
    graph = co.Graph(docs, "lang", "text", 10)
    got = {(r["lang"], tuple(r["phrase"].split(" "))): r["f"] for r in graph.phrases(graph.runs, "run").collect()}
    assert got == {k: n for k, n in f.items() if n >= 10}


def test_passages_are_whole(spark):
    passage = " ".join(f"p{k}" for k in range(40))
    rows = [(k, f"r{k} r{k} {passage} s{k}. {passage if k % 2 else 'other words'}", "en") for k in range(12)]
    found = co.passages(spark.createDataFrame(rows, "doc_id long, text string, lang string"), least=5)
    assert [tuple(r) for r in found.collect()] == [("en", passage, 40, 18)]


def test_odd_rows(spark):
    rows = [(k, t, None) for k, t in enumerate(ODD)] + [(None, "null id null id null id", "en")] * 2
    assert run(spark, rows, 2) == by_hand(rows, 2)


def test_nothing_in(spark):
    assert run(spark, [], 30) == []
    assert run(spark, [(1, None, None), (2, "...", "en")], 1) == []


def test_large_counts_stay_exact(spark):
    big = 10**17
    rows = [([5, 6], big), ([5], 2 * big + 1), ([6], big + 7)]
    runs = spark.createDataFrame(rows, "run array<long>, f long")
    got = co.scored(runs.where(F.size("run") > 1), runs).first()
    assert (got["a"], got["l"], got["r"], got["score"]) == (big, 2 * big + 1, big + 7, 2_000_000 * big // (3 * big + 8))
