"""Document quality: kernel ridge regression on document statistics, by random Fourier features.

1. One pass over the texts turns each into a vector of ``STATISTICS``; it is written to the shared
   folder, so texts are read once and only small rows meet the labels.
2. ``waves`` random cosines of the standardised statistics approximate a Gaussian kernel. Every
   partition of the labelled rows sums its part of the normal equations; Spark adds these up, and
   the driver solves one bounded system for the ridge weights.
3. The raw scores of the same rows are counted in ``bins`` bins, and an isotonic fit over the bins
   calibrates them to probabilities of label 1.

All labelled rows outside the held-out fold are learned from. Defined results: null texts count as
empty and get the score of an empty text; without labelled rows every score is 0.5; a null id is
held out; repeated rows are scored each; other columns are ignored; texts of any
length are measured whole; equal statistics get equal scores.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.llm.common import held_out, id_text, isotonic, map_batches, one_label, written

STATISTICS = (
    "log_bytes", "log_words", "mean_word", "spread_word", "long_words", "distinct_words", "top_word", "lines", "mean_line", "distinct_lines",
    "short_lines", "upper", "digits", "blanks", "sentence_marks", "symbols", "brackets", "high_bytes", "symbol_words", "digit_words", "repeated_symbols",
)
SENTENCE, BRACKETS = b".,;:!?'\"-", b"()[]{}<>"
KIND = np.zeros(256, np.int64)
for _b in range(256):
    _c = bytes([_b])
    KIND[_b] = 7 if _b > 127 else 1 if _c.isupper() else 2 if _c.isdigit() else 3 if _c.isspace() else 0 if _c.isalpha() else 4 if _c in SENTENCE else 5 if _c in BRACKETS else 6


def statistics(text: str) -> list[float]:
    """The statistics of one whole text."""
    raw = text.encode()
    n = max(1, len(raw))
    codes = np.frombuffer(raw, np.uint8)
    kind = KIND[codes]
    share = np.bincount(kind, minlength=8) / n
    words, lines = raw.split(), [x for x in raw.split(b"\n") if x.strip()]
    lengths = np.array([len(w) for w in words] or [0])
    starts = np.array([len(x) for x in lines] or [0])
    seen = Counter(words)
    w, m = max(1, len(words)), max(1, len(lines))
    symbol = kind == 6
    return [
        np.log1p(len(raw)), np.log1p(len(words)), lengths.mean(), lengths.std(), (lengths > 20).sum() / w, len(seen) / w, max(seen.values(), default=0) / w,
        np.log1p(len(lines)), np.log1p(starts.mean()), len(set(lines)) / m, (starts < 20).sum() / m, share[1], share[2], share[3], share[4], share[6], share[5], share[7],
        sum(not x.isalnum() and x[-1] < 128 and KIND[x[-1]] == 6 for x in words) / w, sum(x[:1].isdigit() for x in words) / w,
        (symbol[1:] & (codes[1:] == codes[:-1])).sum() / n,
    ]


def with_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    def measure(batch: pa.RecordBatch) -> pa.RecordBatch:
        values = [statistics(t) for t in batch["text"].to_pylist()]
        return pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(values, pa.list_(pa.float64()))], ["doc_id", "stats"])

    return map_batches(id_text(docs, id_col, text_col), measure, "doc_id long, stats array<double>")


@dataclass(frozen=True)
class Model:
    mean: np.ndarray
    spread: np.ndarray
    frequencies: np.ndarray
    phases: np.ndarray
    weights: np.ndarray
    knots: np.ndarray
    values: np.ndarray

    def waves(self, stats: np.ndarray) -> np.ndarray:
        """Random cosines of standardised statistics, and a constant."""
        z = np.clip((stats - self.mean) / self.spread, -8, 8)
        return np.hstack([np.cos(z @ self.frequencies + self.phases) * np.sqrt(2 / len(self.phases)), np.ones((len(z), 1))])

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return self.waves(stats) @ self.weights

    def probability(self, stats: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.raw(stats), self.knots, self.values), 0, 1)


def stats_of(batch: pa.RecordBatch) -> np.ndarray:
    return batch["stats"].flatten().to_numpy().reshape(batch.num_rows, len(STATISTICS))


def normal_equations(rows: DataFrame, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Sums of x x' and x y over all rows: one summed row of each kind per partition, then by place."""

    def sums(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(model.weights), len(model.weights) + 1))
        for batch in batches:
            if batch.num_rows:
                x, y = model.waves(stats_of(batch)), batch["label"].to_numpy().astype(float)
                total += x.T @ np.column_stack([x, y])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(list(total), pa.list_(pa.float64()))], ["place", "sums"])

    parts = rows.mapInArrow(sums, "place int, sums array<double>")
    added = parts.select("place", F.posexplode("sums").alias("other", "v")).groupBy("place", "other").agg(F.sum("v").alias("v"))
    total = np.zeros((len(model.weights), len(model.weights) + 1))
    for r in added.collect():  # its size is that of one matrix, whatever the input
        total[r["place"], r["other"]] = r["v"]
    return total[:, :-1], total[:, -1]


def fit_quality(
    stats: DataFrame,
    labels: DataFrame,
    *,
    id_col: str = "doc_id",
    label_col: str = "quality",
    folds: int = 5,
    held: int = 0,
    waves: int = 96,
    width: float = 4.0,
    ridge: float = 0.05,
    bins: int = 512,
    seed: int = 11,
) -> Model:
    """Fit on every labelled row of ``stats`` (doc_id, stats) outside the held-out fold."""
    d, rng = len(STATISTICS), np.random.default_rng(seed)
    rows = written(stats.join(one_label(labels, label_col, id_col), "doc_id").where(~held_out("doc_id", folds, held)), "labelled")
    moments = rows.select(F.count("*").alias("n"), *[f(F.col("stats")[k]).alias(f"{name}{k}") for k in range(d) for name, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    frequencies, phases = rng.standard_normal((d, waves)) / width, rng.uniform(0, 2 * np.pi, waves)
    if not moments["n"]:
        return Model(np.zeros(d), np.ones(d), frequencies, phases, np.zeros(waves + 1), np.zeros(1), np.full(1, 0.5))
    spread = np.array([moments[f"s{k}"] for k in range(d)])
    model = Model(np.array([moments[f"m{k}"] for k in range(d)]), np.where(spread > 1e-9, spread, 1), frequencies, phases, np.zeros(waves + 1), np.zeros(1), np.zeros(1))
    xx, xy = normal_equations(rows, model)
    model = Model(model.mean, model.spread, frequencies, phases, np.linalg.solve(xx + ridge * np.eye(len(xx)), xy), model.knots, model.values)

    def binned(batch: pa.RecordBatch) -> pa.RecordBatch:
        at = np.clip(np.floor(model.raw(stats_of(batch)) * bins / 2 + bins / 4), 0, bins - 1)  # scores lie about 0 to 1; the bins cover -0.5 to 1.5
        return pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), batch["label"].cast(pa.int32())], ["bin", "label"])

    counts = map_batches(rows, binned, "bin int, label int").groupBy("bin").agg(F.count("*").alias("n"), F.avg("label").alias("share")).orderBy("bin").collect()
    x = np.array([(r["bin"] + 0.5) * 2 / bins - 0.5 for r in counts])
    knots, values = isotonic(np.append(x, [x[0], x[-1]]), np.append([r["share"] for r in counts], [0, 1]), np.append([r["n"] for r in counts], [1, 1]))
    return Model(model.mean, model.spread, frequencies, phases, model.weights, knots, values)


def quality(stats: DataFrame, model: Model, *, folds: int = 5, held: int = 0, threshold: float = 0.3) -> DataFrame:
    """Calibrated score and prediction of every row of ``stats`` (doc_id, stats)."""

    def score(batch: pa.RecordBatch) -> pa.RecordBatch:
        p = model.probability(stats_of(batch))
        return pa.RecordBatch.from_arrays([batch["doc_id"], batch["held_out"], pa.array(p), pa.array((p >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return map_batches(stats.withColumn("held_out", held_out("doc_id", folds, held)), score, "doc_id long, held_out boolean, score double, predicted int")


def score_quality(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Statistics, fit and scores in one call."""
    stats = written(with_statistics(docs, id_col, text_col), "statistics")
    return quality(stats, fit_quality(stats, labels, id_col=id_col))
