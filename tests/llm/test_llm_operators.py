"""Training-data operators against brute force, round trips and held-out accuracy, and their edge cases."""

import random
import zlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from colloquy.llm import attention, decontaminate, language, lm_scoring, near_duplicates, ogg, packing, quality, subwords, token_counts, toxicity, warc
from colloquy.llm.common import isotonic, table
from tests.conftest import SF

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [None, "", " \n\t ", "one", "a b", "a b", "Ünïcode wörds… 日本語 \U0001f600", "x" * 30_000, "word " * 9000, "line\n\nline\n", "\u0000 nul", "<|endoftext|> tail"]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, repeats, very long and empty texts, null and repeated ids, and columns with names used inside."""
    rows = [(k, t, None, "s", 0) for k, t in enumerate(ODD)] + [(None, "null id", None, None, None), (3, "one", "en", "s", 1), (3, "one", "en", "s", 1)]
    df = spark.createDataFrame(rows, DOCS)
    return df.withColumns({"score": F.lit("clash"), "node": F.lit(1), "block": F.lit("b"), "held_out": F.lit(0), "label": F.lit("l")})


@pytest.fixture(scope="module")
def none(odd):
    return odd.where("false")


@pytest.fixture(scope="module")
def docs(spark):
    return table(spark, SF, "documents")


def texts(df):
    return [(r["doc_id"], r["text"] or "") for r in df.select("doc_id", "text").collect()]


def fold(i, n):
    return zlib.crc32(str(i).encode()) % n


def test_ids_equal_the_tokenizers_library(docs):
    mine, theirs = subwords.encoder(subwords.default_path()), Tokenizer.from_file(subwords.default_path())
    for t in [x or "" for x in ODD] + ["a <|endoftext|> b", "<|endoftext|>" * 3] + [t for _, t in texts(docs)[:60]]:
        assert list(mine.encode(t)) == theirs.encode(t, add_special_tokens=False).ids


def spans_by_library(text):
    tok = Tokenizer.from_file(subwords.default_path())
    return tok.encode(text, add_special_tokens=False).offsets


@pytest.mark.parametrize("rule", token_counts.RULES)
def test_token_counts_equal_brute_force(spark, docs, odd, rule):
    df = docs.limit(25).select("doc_id", "text").union(odd.select("doc_id", "text").where("doc_id <> 3").withColumn("doc_id", F.col("doc_id") + 10**6))
    got = {(r["doc_id"], r["section"]): r for r in token_counts.token_counts(df, rule=rule).collect()}
    for i, t in texts(df):
        starts = [0] + [k + 1 for k, c in enumerate(t) if c == "\n"]
        starts = starts[:-1] if len(starts) > 1 and starts[-1] == len(t) else starts
        bounds, want = [*starts, len(t)], [0.0] * len(starts)
        spans = spans_by_library(t)
        for a, b in spans:
            held = [max(0, min(b, bounds[k + 1]) - max(a, bounds[k])) for k in range(len(starts))]
            hit = [k for k, h in enumerate(held) if h]
            if rule == "proportional":
                for k in hit:
                    want[k] += held[k] / sum(held)
            else:
                want[max(hit, key=lambda k: (held[k], -k)) if rule == "majority" else hit[0]] += 1
        mine = [got[i, k] for k in range(len(starts))]
        assert (i, len(starts)) not in got
        assert [(r["char_start"], r["char_end"]) for r in mine] == list(zip(bounds, bounds[1:]))
        assert np.allclose([r["n_tokens"] for r in mine], want)
        assert sum(r["n_tokens"] for r in mine) == pytest.approx(mine[0]["doc_tokens"]) == pytest.approx(len(spans))


def test_best_fit_equals_a_plain_search():
    rng = random.Random(4)
    for _ in range(60):
        lengths = np.array([rng.randint(1, 64) for _ in range(rng.randint(1, 80))])
        bins, offsets = packing.best_fit_decreasing(lengths, 64)
        left: list[int] = []
        for k in sorted(range(len(lengths)), key=lambda k: (-lengths[k], k)):
            fits = [b for b in range(len(left)) if left[b] >= lengths[k]]
            if not fits:
                left.append(64)
                fits = [len(left) - 1]
            left[min(fits, key=lambda b: left[b])] -= lengths[k]
        assert len(set(bins)) == len(left)
        for b in set(bins):
            own = sorted(zip(offsets[bins == b], lengths[bins == b]))
            assert [o for o, _ in own] == [sum(n for _, n in own[:k]) for k in range(len(own))] and sum(n for _, n in own) <= 64


def test_packing_is_whole_and_gapless(docs, odd):
    for df in (docs, odd):
        rows = packing.best_fit_packing(df, shard_pieces=100).toPandas()
        bpe, by_doc = subwords.encoder(subwords.default_path()), rows.groupby("doc_id")
        for i, t in texts(df):
            if i is None or i == 3:
                continue
            ids = np.array([*bpe.encode(t), 0], "<u4")
            own = by_doc.get_group(i).sort_values("piece")
            assert list(own["piece"]) == list(range(len(own))) and own["length"].sum() == len(ids) and (own["length"].iloc[1:] == 2048).all()
            assert [zlib.crc32(ids[a : a + n].tobytes()) for a, n in zip(own["start"], own["length"])] == list(own["ids_crc32"])
        for _, seq in rows.groupby("sequence_id"):
            seq = seq.sort_values("offset")
            assert list(seq["offset"]) == [0, *seq["length"].cumsum()[:-1]] and seq["length"].sum() <= 2048
        least = -(-rows["length"].sum() // 2048)
        assert rows["sequence_id"].nunique() <= least * 1.1 + 3


def test_toxicity_catches_words_and_leaves_the_rest(spark):
    rng = random.Random(0)
    plain = ["".join(rng.choice("bcdfgl") + rng.choice("aeiou") for _ in range(rng.randint(1, 4))) for _ in range(3000)]
    make = lambda bad: " ".join([*rng.choices(plain, k=80), *rng.choices(["grubble", "snark", "vex"], k=3 * bad)])
    model = toxicity.train([(make(k % 3 == 0), int(k % 3 == 0)) for k in range(400)])
    new = [(k, make(k % 2)) for k in range(200)]
    got = toxicity.toxicity(spark.createDataFrame(new, "doc_id long, text string"), model).toPandas()
    assert (got["predicted"] == got["doc_id"] % 2).mean() > 0.97 and got["score"].between(0, 1).all()


def test_toxicity_folds_copies_alone():
    """Documents that share one frequent word of least hash are no copies; those with nearly the same words are."""
    rng = random.Random(4)
    words = ["w%d" % k for k in range(5000)]
    low = min(words, key=lambda w: zlib.crc32(w.encode()))
    apart = [(" ".join([low, *rng.sample(words, 30)]), 1) for _ in range(60)]
    assert len(toxicity.copy_families(apart)) == 60
    near = [(f"{apart[0][0]} more{k}", 1) for k in range(5)]
    assert len(toxicity.copy_families([*apart, *near, (apart[0][0], 0)])) == 61


def test_toxicity_keeps_every_toxic_word():
    rng = random.Random(5)
    word = lambda letters: "".join(rng.choice(letters) + rng.choice("aeiou") for _ in range(5))
    plain, bad = [word("bcdfgl") for _ in range(400)], [word("mnprstvz") for _ in range(200)]
    sample = [(" ".join([*rng.sample(plain, 30), *(rng.sample(bad, 20) if k % 2 else [])]), k % 2) for k in range(800)]
    model = toxicity.train(sample)
    gap = lambda w: model.gaps.of([w])[0].max(initial=0)
    assert sum(gap(w) >= model.hit for w in bad) >= 180 and not any(gap(w) >= model.hit for w in plain)


def test_toxicity_gaps_equal_single_compressions(monkeypatch):
    """Each window's gap is the difference of two compressed lengths, whatever batch it is in."""
    rng = random.Random(6)
    plain = ["".join(rng.choice("bcdfgl") + rng.choice("aeiou") for _ in range(rng.randint(1, 4))) for _ in range(500)]
    texts = [" ".join(rng.choices([*plain, "grubble", "snarkish"], k=n)) for n in [0, 1, 2, 31, 32, 33, 64, 65, 700]]
    gaps = toxicity.dictionaries([(" ".join([*rng.sample(plain, 40), *(["grubble", "snarkish"] if k % 2 else [])]), k % 2) for k in range(200)], 4000, 8.0, 5)
    length = lambda held, part: len(toxicity.compressor(held).compress(part))
    monkeypatch.setattr(toxicity, "AT_ONCE", 50)
    for text, got in zip(texts, gaps.of(texts), strict=True):
        words = text.split()
        parts = [toxicity.wide(words[k : k + 2]) for k in range(max(1, len(words) - 1))] if words else []
        assert list(got) == [length(gaps.ordinary, p) - length(gaps.toxic, p) for p in parts]


def test_toxicity_scores_equal_a_plain_version(spark, docs):
    """Every window of every text, one compression at a time, counted and calibrated without batches."""
    model = toxicity.fit_toxicity(docs, table(spark, SF, "labels"))
    some = docs.where(F.length("text") < 3000).orderBy("doc_id").limit(40)
    got = {r["doc_id"]: r["score"] for r in toxicity.toxicity(some, model).collect()}
    for i, text in texts(some):
        words, hits, top = toxicity.words_of(text), 0, 0
        for k in range(max(1, len(words) - 1) if words else 0):
            part = toxicity.wide(words[k : k + 2])
            gap = len(toxicity.compressor(model.gaps.ordinary).compress(part)) - len(toxicity.compressor(model.gaps.toxic).compress(part))
            hits, top = hits + (gap >= model.hit), max(top, gap)
        stat = hits + min(top / 64, 0.999) if hits else 0.0
        assert got[i] == pytest.approx(min(max(float(np.interp(stat, model.knots, model.values)), 0.0), 1.0))


def test_toxicity_edges(spark, odd, none):
    labels = spark.createDataFrame([(3, 1, 1), (4, 1, 0), (None, 1, 1), (4, None, None)], "doc_id long, quality int, toxic int")
    for df in (odd, none):
        for known in (labels, labels.where("false")):
            model = toxicity.fit_toxicity(df, known)
            assert toxicity.toxicity(df, model).count() == df.count()
            assert toxicity.drop_toxic(df, model).columns == df.columns


def test_language_is_learned(spark):
    rng = random.Random(1)
    vocab = {"xx": ["zor", "blik", "tran", "quo"], "yy": ["ümla", "été", "ñan", "sûr"], "zz": ["каз", "мир", "тут", "да"]}
    make = lambda n: " ".join(rng.choices(vocab[n], k=rng.randint(3, 60)))
    rows = [(k, make(n), n) for k in range(180) for n in [rng.choice(list(vocab))]]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = language.language(df, language.fit_language(df)).toPandas().merge(pd.DataFrame(rows, columns=["doc_id", "text", "lang"]), on="doc_id")
    assert (got[got["held_out"]]["lang_pred"] == got[got["held_out"]]["lang"]).mean() > 0.95
    assert list(got["held_out"]) == [fold(i, 3) == 1 for i in got["doc_id"]]


def test_texts_below_every_language_go(spark):
    """Texts of the learned languages stay, also held-out ones; those of another script, or of single letters, fall below the levels."""
    rng = random.Random(1)
    vocab = {"xx": ["zor", "blik", "tran", "quo"], "yy": ["ümla", "été", "ñan", "sûr"], "zz": ["каз", "мир", "тут", "да"]}
    make = lambda n: " ".join(rng.choices(vocab[n], k=rng.randint(3, 60)))
    df = spark.createDataFrame([(k, make(n), n) for k in range(180) for n in [rng.choice(list(vocab))]], "doc_id long, text string, lang string")
    network = language.fit_language(df)
    assert language.drop_undetermined(df, network).count() >= 178
    other = spark.createDataFrame([(1, "zor " * 40 + "каз " * 20, None), (2, "... 123", None)], "doc_id long, text string, lang string")
    assert (network.levels > 0.4).all() and language.drop_undetermined(other, network).count() == 0


def test_every_labelled_language_is_learned(spark, monkeypatch):
    """Also the 65th, and one that is labelled in long texts alone; and no labelled text is rejected for its score."""
    rows = [(3 * k + j, f"text {k}", f"l{k:02}") for k in range(70) for j in range(3)] + [(1000 + k, "zaq " * 6000, "long") for k in range(6)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    monkeypatch.setattr(language, "train", lambda sample: sample)
    monkeypatch.setattr(language, "with_levels", lambda network, sample: sample)
    sample = language.fit_language(df)
    free = {lang for i, _, lang in rows if fold(i, 3) != 1}
    assert {lang for _, lang in sample} == free and len(free) > 64 and "long" in free
    assert all(len(t) == 20_000 for t, lang in sample if lang == "long")


def test_low_scores_are_not_rejected(spark):
    rng = np.random.default_rng(0)
    net = language.Network(["a", "b", "c", "d", "e"], language.Direction.new(rng, 8), language.Direction.new(rng, 8), np.zeros((16, 5), np.float32), np.zeros(5, np.float32))
    df = spark.createDataFrame([(1, "some text"), (2, "123"), (3, None)], "doc_id long, text string")
    assert [r["doc_id"] for r in language.drop_undetermined(df, net).collect()] == [1]


def test_gradients_through_time_are_right():
    rng = np.random.default_rng(0)
    d = language.Direction.new(rng, 3)
    d = language.Direction(*[w.astype(np.float64) for w in (d.read, d.gates, d.candidate)])
    codes = rng.integers(0, 256, (4, 7)).astype(np.int16)
    target = rng.standard_normal((5, 4, 3))
    loss = lambda: float((d.run(codes, 2) * target).sum())
    language_float, language.FLOAT = language.FLOAT, np.float64
    try:
        _, grads = d.back(codes, 2, lambda states: target)
        for w, g in zip((d.read, d.gates, d.candidate), grads):
            at = np.unravel_index(np.abs(g).argmax(), g.shape)
            w[at] += 1e-6
            up = loss()
            w[at] -= 2e-6
            down = loss()
            w[at] += 1e-6
            assert g[at] == pytest.approx((up - down) / 2e-6, rel=1e-4)
    finally:
        language.FLOAT = language_float


def test_language_edges(spark, odd, none):
    net = language.fit_language(none)
    got = language.language(odd, net).toPandas()
    assert set(got["lang_pred"]) == {"und"} and (got["score"] == 0).all() and len(got) == odd.count()
    assert language.drop_undetermined(odd, net).count() == 0 and language.language(none, net).count() == 0


def words_by_hand(text):
    return (text or "").encode().lower().split()


def classes_by_hand(rows, width=2, percent=80):
    sets = []
    for _, t in rows:
        w = words_by_hand(t)
        sets.append({tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set()))
    parent = list(range(len(rows)))

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                parent[max(x, y, key=lambda k: rows[k][0])] = min(x, y, key=lambda k: rows[k][0])
    return {rows[k][0]: (len(sets[k]), rows[root(k)][0]) for k in range(len(rows))}


@pytest.mark.parametrize("width,k", [(2, 64), (5, 64), (2, 32)])
def test_near_duplicates_equal_brute_force(spark, width, k):
    rng = random.Random(width)
    vocab = [f"w{n}" for n in range(400)] + ["of", "the"] * 60
    rows, base = [], []
    for n in range(60):
        words = rng.choices(vocab, k=rng.choice([1, 2, 3, 8, 40, 200]))
        base.append(words)
        rows.append(" ".join(words))
    passage = " ".join(rng.choices(vocab, k=60))
    for n in range(240):
        words = list(rng.choice(base))
        for _ in range(rng.randint(0, max(1, len(words) // 12))):
            words[rng.randrange(len(words))] = rng.choice(vocab)
        rows.append(" ".join(words) + (" " + passage if n % 9 == 0 else ""))
    rows = [(7 * n % 907, t) for n, t in enumerate(rows)]
    want = classes_by_hand(rows, width)
    got = near_duplicates.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), words=width, k=k).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == want
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_near_duplicates_edges(odd, none):
    got = near_duplicates.near_duplicates(odd).collect()
    by = {r["doc_id"]: r for r in got}
    assert len(got) == odd.count() and by[0]["n_shingles"] == by[1]["n_shingles"] == 0 and by[5]["component_id"] == 4 and by[1]["component_id"] == 1
    assert near_duplicates.near_duplicates(none).count() == 0


def distance_by_hand(p, t):
    row = [0] * (len(t) + 1)
    for i, c in enumerate(p, 1):
        new = [i]
        for j, d in enumerate(t, 1):
            new.append(min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (c != d)))
        row = new
    return min(row)


def test_decontamination_equals_brute_force(spark):
    rng = random.Random(6)
    letters = "abcdefg "
    make = lambda n: "".join(rng.choice(letters) for _ in range(n))
    items = [(k, make(rng.randint(40, 90))) for k in range(8)] + [(8, None), (9, "  ")]
    rows = []
    for n in range(80):
        body = list(rng.choice(items[:8])[1])
        for _ in range(rng.randint(0, 6)):
            k = rng.randrange(len(body))
            body[k : k + 1] = rng.choice(["", "a", "bc"])
        rows.append((n, make(100) + "".join(body) + make(100) if n % 3 else make(300)))
    rows += [(100, None), (101, ""), (102, items[0][1].upper())]
    got = decontaminate.contaminated(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    want = {}
    for i, t in rows:
        for k, item in items:
            a, b = decontaminate.normal(item), decontaminate.normal(t)
            if a and (d := distance_by_hand(a, b)) <= int(len(a) * 0.05):
                want[i, k] = d
    assert {(r["doc_id"], r["item_id"]): r["distance"] for r in got} == want and want
    blocks = decontaminate.contaminated(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), block_chars=100).collect()
    assert sorted(map(tuple, blocks)) == sorted(map(tuple, got))


def test_decontamination_edges(spark, odd, none):
    items = spark.createDataFrame([(None, "word word word"), (1, None)], "item_id long, text string")
    assert {r["doc_id"] for r in decontaminate.contaminated(odd, items).collect()} == {8}
    assert decontaminate.contaminated(odd, items.where("false")).count() == 0 == decontaminate.contaminated(none, items).count()
    assert decontaminate.drop_contaminated(odd, items).count() == odd.count() - 1


def test_ogg_round_trip(docs, odd):
    import hashlib

    for df in (docs, odd):
        got = ogg.ogg_media(df.where("doc_id IS NOT NULL")).toPandas().drop_duplicates("doc_id").set_index("doc_id")
        for i, t in texts(df):
            if i is None:
                continue
            raw = t.encode()
            pad = raw + b"\xff" * (576 * max(1, -(-len(raw) // 576)) - len(raw))
            r = got.loc[i]
            assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(pad), hashlib.sha256(pad).hexdigest(), zlib.crc32(pad[-32:]))
    data = bytearray(ogg.write_ogg(b"x" * 5000))
    data[400] ^= 1
    with pytest.raises(ValueError, match="checksum"):
        ogg.read_ogg(bytes(data))


def test_ogg_times_and_page_ends():
    for size in (0, 1, 576, 577, 90_000):
        payload = random.Random(size).randbytes(size)
        for segments in (1, 3, 250):
            streams = ogg.read_ogg(ogg.write_ogg(payload, segments))
            assert ogg.payload_of(streams) == payload
            assert sum(s.ends[-1] for s in streams.values()) == size


def test_warc_round_trip(spark):
    rows = [(5, "http://a/\r\nx", "same"), (2, "http://b", "same"), (9, None, None), (7, "u", ""), (8, "u", "ünique"), (None, "u", "same"), (2, "http://b", "same"), (11, "u", "z" * 200_000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("sha", F.lit(1))
    got = warc.warc_round_trip(df, archive_bytes=300).collect()
    assert len(got) == len(rows)
    kinds = {(r["page_id"], r["record_type"], r["refers_to"]) for r in got}
    assert kinds == {(5, "revisit", 2), (2, "response", None), (9, "revisit", 7), (7, "response", None), (8, "response", None), (None, "revisit", 2), (11, "response", None)}
    assert all(r["payload_bytes"] == {"same": 4}.get(h, len((h or "").encode())) for r in got for p, _, h in rows if p == r["page_id"])
    assert warc.warc_round_trip(df.where("false")).count() == 0


def test_quality_is_learned(spark):
    rng = random.Random(2)
    good = lambda: " ".join(rng.choices(["plain", "words", "in", "order", "come"], k=60)) + "."
    junk = lambda: " ".join(rng.choice(["%%%", "###", "a|b", "&&&"]) + rng.choice("xyz") for _ in range(60))
    rows = [(k, good() if k % 3 else junk(), int(k % 3 > 0)) for k in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    got = quality.score_quality(df.drop("quality"), df.select("doc_id", "quality")).toPandas().merge(df.toPandas(), on="doc_id")
    assert (got[got["held_out"]]["predicted"] == got[got["held_out"]]["quality"]).mean() > 0.97
    assert list(got["held_out"]) == [fold(i, 5) == 0 for i in got["doc_id"]]


def test_quality_edges(spark, odd, none):
    labels = spark.createDataFrame([(3, 1), (4, 0), (5, None), (None, 1), (3, 1)], "doc_id long, quality int")
    for df in (odd, none):
        for known in (labels, labels.where("false")):
            got = quality.score_quality(df, known).toPandas()
            assert len(got) == df.count() and got["score"].between(0, 1).all()


def test_isotonic_is_the_best_rising_fit():
    knots, values = isotonic(np.array([1, 2, 3, 4, 4]), np.array([0.0, 1.0, 0.0, 1.0, 1.0]))
    assert list(knots) == [1, 2, 3, 4] and list(values) == [0, 0.5, 0.5, 1]


def test_language_model_is_a_distribution():
    counts = np.random.default_rng(0).integers(0, 50, 1500).astype(float)
    vocabulary = attention.Vocabulary.of(counts)
    model = attention.Attention.new(np.bincount(vocabulary.row, counts, minlength=vocabulary.rare + 1))
    before = np.array([5, 900, 77])
    both = attention.log10_probabilities(model, vocabulary, [np.append(before, k) for k in range(1500)])
    alone = attention.log10_probabilities(model, vocabulary, [before])
    assert (10 ** (both - alone[0])).sum() == pytest.approx(1, abs=1e-3)


def test_windows_score_each_id_once():
    docs = [np.arange(n) % 7 for n in (1, 15, 16, 17, 50)]
    lines = attention.windows(docs, 99)
    targets = lines[:, attention.CONTEXT + 1 :]
    assert [int(x) for x in targets[targets >= 0]] == [int(x) for d in docs for x in d]
    assert (targets >= 0).sum() == sum(map(len, docs))


def test_attention_gradients():
    counts = np.ones(attention.CLASSES * attention.MEMBERS + 1)
    model = attention.Attention.new(counts)
    docs = [np.random.default_rng(1).integers(0, 1025, 40)]
    loss = model.gradients(attention.windows(docs, 1025))[0]
    attention.train(model, docs, 1025, steps=40, batch=8)
    assert model.gradients(attention.windows(docs, 1025))[0] < loss / 2


def test_lm_base_and_gain(docs, odd):
    for df in (docs, odd.where("doc_id IS NULL OR doc_id <> 3")):
        got = lm_scoring.lm_scores(df, block_chars=50_000, sample_docs=120).toPandas()
        rows = texts(df)
        known = {}
        for i, t in rows:
            if i is not None and fold(i, 10):
                for w in [*words_by_hand(t), None]:
                    known[w] = known.get(w, 0) + 1
        n, v = sum(known.values()), len(known)
        for i, t in rows:
            if i is None:
                continue
            r = got[got["doc_id"] == i].iloc[0]
            ts = [*words_by_hand(t), None]
            assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(ts), sum(w in known for w in ts), n)
            assert r["base_score"] == pytest.approx(sum(np.log10((known.get(w, 0) + 0.1) / (n + 0.1 * (v + 1))) for w in ts))
        assert np.isfinite(got["score"]).all() and (got["score"] <= 0).all()


def test_lm_of_nothing(none):
    assert lm_scoring.lm_scores(none).count() == 0


def test_lm_learns_from_all_training_documents(spark):
    path = subwords.default_path()
    rng = random.Random(2)
    rows = [(k, " ".join(rng.choices(["one", "two", "antidisestablishment", "four"], k=n)), False) for k, n in enumerate([0, 63, 64, 65, 9000, 3000])]
    ids = lm_scoring.WordIds(path)
    counts = np.bincount(np.concatenate([ids.of(words_by_hand(t)) for _, t, _ in rows]), minlength=ids.bpe.size + 1).astype(float)
    vocabulary = attention.Vocabulary.of(counts)
    targets = []
    for n in (1, 2):
        df = spark.createDataFrame([(k + 10 * c, t, h) for c in range(n) for k, t, h in rows] + [(99, "held out", True)], "doc_id long, text string, held_out boolean")
        blocks = lm_scoring.in_blocks(df, 50_000)
        for share in (1.0, 0.25):
            found = [np.frombuffer(r["windows"], "<i2").reshape(-1, attention.CONTEXT + attention.CORE + 1) for r in lm_scoring.drawn_windows(blocks, vocabulary, path, share, 3).collect()]
            y = np.concatenate(found)[:, attention.CONTEXT + 1 :]
            if share == 1:
                assert np.array_equal(np.bincount(y[y >= 0]), n * np.bincount(vocabulary.row, counts)[: y.max() + 1].astype(int))
            else:
                targets.append((y >= 0).sum() / (n * counts.sum()))
    assert all(0.15 < t < 0.35 for t in targets)


def test_runs_have_their_texts_context():
    ids, words = lm_scoring.WordIds(subwords.default_path()), [b"w%d" % k for k in range(200)]
    row = np.arange(ids.bpe.size + 1)
    first, second = lm_scoring.run_windows(ids, row, -1, words, [0, 1])
    whole = ids.of(words)
    start = len(ids.of(words[:64])) - 1
    assert list(second[0][: attention.CONTEXT + 1]) == list((whole[start - attention.CONTEXT - 1 : start]).astype(np.int16))
    assert (first[0][: attention.CONTEXT + 1] == -1).all()


def test_rare_ids_have_several_classes():
    counts = np.sort(np.random.default_rng(0).zipf(1.3, 4000).clip(max=10**6))[::-1].astype(float)
    vocabulary = attention.Vocabulary.of(counts)
    rare = vocabulary.row[attention.CLASSES * attention.MEMBERS :]
    assert len(set(rare)) > 8 and (np.diff(rare) >= 0).all() and vocabulary.rare == rare.max()
    model = attention.Attention.new(np.bincount(vocabulary.row, counts, minlength=vocabulary.rare + 1))
    both = attention.log10_probabilities(model, vocabulary, [np.array([3999, k]) for k in range(4000)])
    assert (10 ** (both - attention.log10_probabilities(model, vocabulary, [np.array([3999])]))).sum() == pytest.approx(1, abs=1e-3)
