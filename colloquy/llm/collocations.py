"""Phrase collocations from a weighted de Bruijn graph of words.

Texts are cut into pieces and pieces into words. Nodes are runs of three words, edges runs of four
that join the node they begin with to the one they end with; an edge's weight is how often it occurs.

1. Edges: every word of a piece begins one longest gram, its edge. Near the piece's end the gram is
   shorter: such piece-end corrections are edges to END. Equal grams of a batch are added up before
   they are shuffled, by their node, so a node's edges meet without more than one row for each batch.
2. Flow: how often a shorter run occurs is what flows out of it: the sum of the weights, corrections
   included, of all grams that begin with it. Only runs that occur ``least`` times go on.
3. Unary paths: a node whose whole flow goes through one edge is no run of its own; chains of such nodes
   are compacted, by pointer doubling, to one path with its words and weight. Long passages that
   many documents share become one row each. Grams inside a path lie in a longer one as frequent as they are.
4. Candidates are split at every place, scored by the counts of both parts, held against the longer
   runs around them, and ranked in each language.

Words are coded as numbers: the COMMON most frequent ones by their rank, others by a hash of language
and word, and words that are certainly rarer than ``least`` by RARE, since no run around them can reach ``least``.
That they are rare is told by a table of bits, sized by the words that are not; a word it can't rule out is only
counted in vain. In the same way a counted table of the hashes of two and three words tells which of these can't reach ``least``: what
follows them is RARE, too, so that edges that no result needs are added up where they are met, and only flow on. Should two words that reach ``least`` have the same code, the query fails rather than add them up.

Defined results: null texts are empty; a null language is ``und``; pieces and texts of any length are
read whole; repeated rows and null ids count like others; equal scores and counts go by the phrase; without
candidates the result is empty; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colloquy.llm.common import drop_written, sliced, written

#: Words coded by rank; codes of words that are too rare to count and of the end of a piece.
COMMON, RARE, END, HASHED = 1 << 16, 0, 1, 1 << 62
#: Words that a task adds up at a time, and bits of the table of not rare words, per word and at most.
AT_ONCE, BITS_EACH, MOST_BITS = 1_500_000, 16, 1 << 25
#: Most counters of the table that tells which runs may be frequent, and parts of the input that fill one.
MOST_COUNTERS, PARTS = 1 << 24, 8
SPLIT = bytes.maketrans(b".,;:!?\n\x0b\x0c\r\t", b".......... ")
GRAM = ["w1", "w2", "w3", "w4"]


def tokens(text: str) -> list[bytes]:
    """Words of all pieces, lower-cased; a single full stop stands for each end of a piece."""
    return text.encode().lower().translate(SPLIT).replace(b".", b" . ").split()


def word_hash(lang: str, word: bytes) -> int:
    return xxhash.xxh3_64_intdigest(lang.encode() + b"\0" + word)


def batches_by_language(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[str, list[str]]]:
    for batch in sliced(batches, 1024):
        found: dict[str, list[str]] = {}
        for lang, text in zip(batch["lang"].to_pylist(), batch["text"].to_pylist(), strict=True):
            found.setdefault(lang, []).append(text)
        yield from found.items()


def vocabulary(rows: DataFrame) -> DataFrame:
    """(lang, word, f) of all words."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, texts in batches_by_language(batches):
            counts: Counter = Counter()
            for text in texts:
                counts.update(tokens(text))
            counts.pop(b".", None)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(counts), pa.string()), pa.array([w.decode() for w in counts], pa.string()), pa.array(list(counts.values()), pa.int64())], ["lang", "word", "c"])

    return rows.mapInArrow(count, "lang string, word string, c long").groupBy("lang", "word").agg(F.sum("c").alias("f"))


class Coder:
    """Codes of words, from a list of the most frequent ones and a table of bits of all that aren't rare."""

    def __init__(self, common: list[tuple[str, str]], bits: np.ndarray):
        self.common = {(lang, word.encode()): k + 2 for k, (lang, word) in enumerate(common)}
        self.bits = bits
        self.known: dict[str, Codes] = {}

    def of(self, lang: str) -> Codes:
        if len(self.known) > 64 and lang not in self.known:
            self.known.clear()
        return self.known.setdefault(lang, Codes(lang, self))


class Codes(dict):
    """Codes of one language's words, as they are met."""

    def __init__(self, lang: str, coder: Coder):
        super().__init__({b".": END})
        self.lang, self.coder = lang, coder

    def __missing__(self, word: bytes) -> int:
        if len(self) > 300_000:
            self.clear()
            self[b"."] = END
        code = self.coder.common.get((self.lang, word))
        if code is None:
            h = word_hash(self.lang, word)
            at = h % (len(self.coder.bits) * 64)
            code = (h & (HASHED - 1)) | HASHED if int(self.coder.bits[at >> 6]) >> (at & 63) & 1 else RARE
        self[word] = code
        return code


def not_rare(words: DataFrame) -> np.ndarray:
    """Bits of the hashes of ``words`` (lang, word), in 64-bit words; more words, more bits, up to MOST_BITS."""
    size = 1 << 12
    while size < min(BITS_EACH * words.count(), MOST_BITS):
        size *= 2

    def place(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.array([word_hash(lang, w.encode()) % size for lang, w in zip(batch["lang"].to_pylist(), batch["word"].to_pylist(), strict=True)], np.int64)
            bit = np.uint64(1) << (at & 63).astype(np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(at >> 6), pa.array(bit.view(np.int64))], ["at", "bit"])

    bits = np.zeros(size // 64, np.int64)
    for r in words.select("lang", "word").mapInArrow(place, "at long, bit long").groupBy("at").agg(F.bit_or("bit").alias("bits")).toLocalIterator():
        bits[r["at"]] = r["bits"]
    return bits.view(np.uint64)


def longest_grams(codes: np.ndarray) -> list[np.ndarray]:
    """The longest grams that begin at each coded word, by columns. What follows an END or a RARE is the same."""
    codes = np.concatenate([codes, np.full(3, END, np.int64)])
    starts = np.flatnonzero(codes[:-3] > END)
    gram = [codes[starts]]
    for k in range(1, 4):
        gram.append(np.where(gram[-1] > END, codes[starts + k], gram[-1]))
    return gram


def run_hashes(gram: list[np.ndarray]) -> list[np.ndarray]:
    """Hashes of the grams' first one, two, three and four words."""
    out, key = [], np.zeros(len(gram[0]), np.uint64)
    for g in gram:
        key = (key ^ g.view(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        key = key ^ (key >> np.uint64(32))
        out.append(key)
    return out


def added_up(codes: np.ndarray, runs: np.ndarray) -> pa.RecordBatch:
    """The longest grams with how often each occurs. Behind a run that can't reach ``least`` all is RARE."""
    gram = longest_grams(codes)
    for k, h in enumerate(run_hashes(gram)[1:3], 1):
        at = h & np.uint64(len(runs) * 64 - 1)
        rare = (gram[k] > END) & (runs[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63)) & np.uint64(1) == 0)
        for g in gram[k:]:
            g[rare] = RARE
    key = run_hashes(gram)[-1]
    by = np.argsort(key)
    gram = [g[by] for g in gram]
    new = np.ones(len(by), bool)
    new[1:] = np.any([g[1:] != g[:-1] for g in gram], axis=0)
    first = np.flatnonzero(new)
    return pa.RecordBatch.from_arrays([*(pa.array(g[first]) for g in gram), pa.array(np.diff(np.append(first, len(by))))], [*GRAM, "c"])


def coded(batches: Iterable[pa.RecordBatch], coder: Coder) -> Iterator[np.ndarray]:
    """Codes of whole texts, each text ended by END, about AT_ONCE at a time."""
    held, n = [], 0
    for lang, texts in batches_by_language(batches):
        code = coder.of(lang)
        for text in texts:
            a = np.fromiter(map(code.__getitem__, tokens(text)), np.int64)
            held += [a, np.array([END], np.int64)]
            n += len(a)
        if n > AT_ONCE:
            yield np.concatenate(held)
            held, n = [], 0
    if held:
        yield np.concatenate(held)


def not_rare_runs(rows: DataFrame, coder: Coder, least: int, n_words: int) -> np.ndarray:
    """Bits of the hashes of runs of two and three words that may occur ``least`` times, in 64-bit words.

    Hashes are counted in a table of a size that follows the words, up to MOST_COUNTERS: a task passes on counts up to
    ``least``, chunk by chunk, and chunks are added up where they meet. A task takes up to PARTS parts of the input, as each
    passes on a table. A full table only saves less.
    """
    parts = rows.rdd.getNumPartitions()
    rows = rows.coalesce(max(1, min(parts, max(rows.sparkSession.sparkContext.defaultParallelism, parts // PARTS))))
    size = 1 << 12
    while size < min(n_words // 8, MOST_COUNTERS):
        size *= 2
    chunk = min(size, 1 << 16)
    small = np.uint8 if least < 256 else np.int64

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int32)
        for codes in coded(batches, coder):
            gram = longest_grams(codes)
            for k, h in enumerate(run_hashes(gram)[1:3], 1):
                np.add.at(total, (h[gram[k] > END] & np.uint64(size - 1)).astype(np.int64), 1)
        for k in range(0, size, chunk):
            if (part := total[k : k + chunk]).any():
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), pa.array([np.minimum(part, least).astype(small).tobytes()], pa.binary())], ["at", "counts"])

    def add(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for at, counts in zip(batch["at"].to_pylist(), batch["counts"].to_pylist(), strict=True):
                total[at] = np.minimum(total.get(at, 0) + np.frombuffer(counts, small).astype(np.int64), least)
        bits = [np.packbits(t >= least, bitorder="little").tobytes() for t in total.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array(bits, pa.binary())], ["at", "bits"])

    out = np.zeros(size // 8, np.uint8)
    for r in rows.mapInArrow(count, "at long, counts binary").repartition("at").mapInArrow(add, "at long, bits binary").collect():
        out[r["at"] // 8 : (r["at"] + chunk) // 8] = np.frombuffer(r["bits"], np.uint8)
    return out.view(np.uint64)


def edges(rows: DataFrame, coder: Coder, runs: np.ndarray) -> DataFrame:
    """(w1, w2, w3, w4, c): the longest gram that begins at each word, added up in batches."""
    return rows.mapInArrow(lambda batches: (added_up(codes, runs) for codes in coded(batches, coder)), "w1 long, w2 long, w3 long, w4 long, c long")


def frequent_runs(summed: DataFrame, least: int) -> DataFrame:
    """(run, f): runs of one to four words, as arrays of codes, that occur ``least`` times: edges, and what flows out of shorter runs."""
    out = summed.where((F.col("w4") > END) & (F.col("c") >= least)).select(F.array(*GRAM).alias("run"), F.col("c").alias("f"))
    for n in (3, 2, 1):
        sums = summed.where(F.col(GRAM[n - 1]) > END).groupBy(*GRAM[:n]).agg(F.sum("c").alias("f")).where(F.col("f") >= least)
        out = out.union(sums.select(F.array(*GRAM[:n]).alias("run"), "f"))
    return out


def unary_paths(runs: DataFrame) -> DataFrame:
    """(words, f): the edges among ``runs``, chains of unary nodes compacted to one path each.

    A node is unary if one edge brings all of its flow and one takes all of it. Each edge learns the last edge of its chain
    and how far off that is; each round doubles the distance it sees, and is written. There are no rings of unary nodes,
    as every piece ends.
    """
    size = F.size("run")
    edge = runs.where(size == 4).select("run", "f", F.slice("run", 1, 3).alias("at"), F.slice("run", 2, 3).alias("to"))
    node = runs.where(size == 3).select(F.col("run").alias("node"), F.col("f").alias("flow"))
    out = edge.join(node, (F.col("at") == F.col("node")) & (F.col("f") == F.col("flow"))).select(F.col("at").alias("to"), F.col("run").alias("next"), F.col("f").alias("next_f"))
    goes_on = F.col("next_f") == F.col("f")
    hops = edge.join(out, "to", "left").select("run", "f", F.when(goes_on, F.col("next")).otherwise(F.col("run")).alias("last"), F.when(goes_on, 1).otherwise(0).cast("long").alias("off"))
    hops, seen = written(hops, "hops"), -1
    while (total := hops.agg(F.sum("off")).first()[0] or 0) != seen:
        seen = total
        after = hops.select(F.col("run").alias("last"), F.col("last").alias("then"), F.col("off").alias("more"))
        previous, hops = hops, written(hops.join(after, "last").select("run", "f", F.col("then").alias("last"), (F.col("off") + F.col("more")).alias("off")), "hops")
        drop_written(previous)
    chain = hops.groupBy("last", "f").agg(F.sort_array(F.collect_list(F.struct("off", "run")), asc=False).alias("chain"))
    words = F.concat(F.slice(F.element_at("chain", 1)["run"], 1, 3), F.transform("chain", lambda x: x["run"][3]))
    return chain.select(words.alias("words"), "f")


def whole(x: Column) -> Column:
    """As a decimal, so that products beyond 64 bits stay exact."""
    return x.cast("decimal(20,0)")


def scored(candidates: DataFrame, runs: DataFrame) -> DataFrame:
    """(run, a, l, r, score): candidates (run, f) by the cut that scores lowest; ``runs`` has both parts' counts."""
    wide = candidates.select("run", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), F.size("run") - 1)).alias("k"))
    wide = wide.withColumns({"left": F.slice("run", F.lit(1), F.col("k")), "right": F.slice("run", F.col("k") + 1, F.size("run") - F.col("k"))})
    wide = wide.join(runs.select(F.col("run").alias("left"), F.col("f").alias("l")), "left").join(runs.select(F.col("run").alias("right"), F.col("f").alias("r")), "right")
    score = F.call_function("div", F.lit(2_000_000).cast("decimal(18,0)") * whole(F.col("a")), whole(F.col("l")) + whole(F.col("r")))
    best = wide.groupBy("run").agg(F.min(F.struct(score.alias("score"), "k", "a", "l", "r")).alias("cut"))
    return best.select("run", "cut.a", "cut.l", "cut.r", "cut.score")


def not_inside(scores: DataFrame, runs: DataFrame, percent: int) -> DataFrame:
    """Without the runs that lie in a longer one at least ``percent`` % as frequent."""
    longer = runs.where(F.size("run") > 2).withColumn("n", F.explode(F.sequence(F.lit(2), F.size("run") - 1)))
    inside = longer.select("f", "n", F.explode(F.sequence(F.lit(1), F.size("run") - F.col("n") + 1)).alias("k"), "run")
    most = inside.groupBy(F.slice("run", F.col("k"), F.col("n")).alias("run")).agg(F.max("f").alias("around"))
    kept = F.col("around").isNull() | (whole(F.col("around")) * 100 < whole(F.col("a")) * percent)
    return scores.join(most, "run", "left").where(kept).drop("around")


def named(coder: Coder, words: DataFrame) -> DataFrame:
    """(code, lang, word) of the not rare words; fails where two of them have the same code."""

    def code(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = [coder.of(lang)[w.encode()] for lang, w in zip(batch["lang"].to_pylist(), batch["word"].to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(codes, pa.int64()), batch["lang"], batch["word"]], ["code", "lang", "word"])

    coded = words.select("lang", "word").mapInArrow(code, "code long, lang string, word string")
    same = F.when(F.count("*") > 1, F.raise_error(F.lit("two words have the same code"))).otherwise(F.first("word"))
    return coded.groupBy("code").agg(same.cast("string").alias("word"), F.first("lang").alias("lang"))


class Graph:
    """The frequent runs of a table of texts and what names them."""

    def __init__(self, docs: DataFrame, lang_col: str, text_col: str, least: int):
        rows = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
        self.words = written(vocabulary(rows), "vocabulary")
        frequent = self.words.where(F.col("f") >= least)
        common = frequent.orderBy(F.desc("f"), "lang", "word").limit(COMMON).select("lang", "word").collect()
        coder = Coder([tuple(r) for r in common], not_rare(frequent))
        n_words = self.words.agg(F.sum("f")).first()[0] or 0
        found = edges(rows, coder, not_rare_runs(rows, coder, least, n_words))
        summed = written(found.groupBy(*GRAM).agg(F.sum("c").alias("c")), "edges")
        self.runs = written(frequent_runs(summed, least), "runs")
        drop_written(summed)
        self.names = written(named(coder, frequent), "names")

    def phrases(self, rows: DataFrame, column: str) -> DataFrame:
        """``rows`` with ``lang`` and ``phrase`` in place of the codes in ``column``."""
        parts = rows.select(column, F.posexplode(column).alias("place", "code")).join(self.names, "code")
        text = parts.groupBy(column).agg(F.sort_array(F.collect_list(F.struct("place", "word"))).alias("in_order"), F.first("lang").alias("lang"))
        text = text.select(column, "lang", F.array_join("in_order.word", " ").alias("phrase"))
        return rows.join(text, column).drop(column)

    def drop(self) -> None:
        drop_written(self.words, self.runs, self.names)


def collocations(
    docs: DataFrame,
    *,
    lang_col: str = "lang",
    text_col: str = "text",
    least: int = 30,
    percent: int = 80,
    first: int = 2000,
) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's ``first`` phrases of two to four words.

    A phrase occurs ``a`` times, ``least`` or more; of its cuts the one with the lowest floor(2000000 * a / (l + r)) counts.
    Those inside a longer phrase at least ``percent`` % as frequent are dropped. ``n`` counts the language's words.
    """
    graph = Graph(docs, lang_col, text_col, least)
    paths = written(unary_paths(graph.runs), "unary")
    # nodes inside a compacted path lie in an edge as frequent as they are
    inner = paths.where(F.size("words") > 4).select("words", F.explode(F.sequence(F.lit(2), F.size("words") - 3)).alias("k"))
    inner = inner.select(F.slice("words", F.col("k"), F.lit(3)).alias("run")).distinct()
    candidates = graph.runs.where(F.size("run") > 1)
    if percent <= 100:
        candidates = candidates.join(inner, "run", "left_anti")
    kept = not_inside(scored(candidates, graph.runs), graph.runs, percent)
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = graph.phrases(kept, "run").withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= first)
    totals = graph.words.groupBy("lang").agg(F.sum("f").alias("n"))
    out = written(ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", F.col("score").cast("long").alias("score")), "collocations")
    graph.drop()
    drop_written(paths)
    return out


def passages(docs: DataFrame, *, lang_col: str = "lang", text_col: str = "text", least: int = 30) -> DataFrame:
    """lang, phrase, n_words, f: the compacted paths, i.e. passages of four words or more that occur ``least`` times as a whole."""
    graph = Graph(docs, lang_col, text_col, least)
    paths = written(unary_paths(graph.runs), "unary")
    out = written(graph.phrases(paths.select("words", "f", F.size("words").alias("n_words")), "words").select("lang", "phrase", "n_words", "f"), "passages")
    graph.drop()
    drop_written(paths)
    return out
