"""Toxicity by compression distance: one zstandard dictionary for toxic text, one for ordinary text.

A window is two neighbouring words of the lower-cased text without its punctuation. It is compressed
with each dictionary, and its gap is the number of bytes that the toxic one saves. Every window of every text is
compared. Text is compressed in UTF-16, which doubles what a match is worth.

Both dictionaries hold the most frequent words without such a segment, at the same distances, so that lengths
differ only by what the classes differ in. The toxic one holds besides the segments of words (of ``LENGTHS`` characters) that are clearly more frequent in toxic documents, by ratio, count
and a likelihood-ratio test; a stem that takes many endings is such a segment, though none of its
words may be frequent. (The library's own trainer takes the most frequent segments alone. In trials with it, the toxic
dictionary trained on the windows that the ordinary one compresses worst, gaps told the classes apart hardly
better than chance: AUC 0.37 to 0.58 on held-out documents.) Training documents of a label whose word sets
have a Jaccard of ``COPY`` or more count as one, lest a family of near copies fills a dictionary; ``BANDS`` of
minima find such pairs, and the sets themselves decide.

The gap that counts as a hit is the one of a grid that separates the training documents best (by F 0.5).
A document's statistic is its number of hits plus, if any, a share for its largest gap, and an isotonic fit turns it
into a probability. The classifier is fitted on at most ``sample_per_label`` labelled documents
per label of at most ``sample_chars`` characters; scoring covers every word of every text.

Defined results: null and empty texts have no windows and get the score of statistic 0; without
labelled rows of both classes every score is the smoothed share of label 1; a null id is held
out; repeated rows are scored each; other columns are ignored.
"""

from __future__ import annotations

import functools
import math
import string
import zlib
from collections import Counter
from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard as zstd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.llm.common import bounded_sample, held_out, id_text, isotonic, map_batches

BLANKS = bytes.maketrans(string.punctuation.encode(), b" " * len(string.punctuation))
#: Words of a window, and windows that are compressed at a time.
WORDS, AT_ONCE = 2, 50_000
#: Gaps, in bytes, of which one is chosen to count as a hit.
GRID = (3, 4, 5, 6, 7, 8)
#: Characters of a segment.
LENGTHS = (5, 7, 9)
#: Segments of a word after which others need words of their own.
COVER = 2
#: Of near copies: the least Jaccard of word sets, and how many bands of two minima each look for them.
COPY, BANDS = 0.8, 8
#: How likely any ordinary segment at all is to be taken for a toxic one.
LEVEL = 0.05


def words_of(text: str) -> list[str]:
    return text.lower().encode().translate(BLANKS).decode().split()


def wide(words: Iterable[str]) -> bytes:
    return f" {' '.join(words)} ".encode("utf-16-le")


def segments(words: Iterable[str]) -> set[str]:
    """The segments of some words with the blanks beside them."""
    return {w[a : a + n] for w in (f" {x} " for x in words) for n in LENGTHS for a in range(len(w) - n + 1)}


@functools.lru_cache(maxsize=4)
def compressor(content: bytes) -> zstd.ZstdCompressor:
    wide_enough = max(15, len(content).bit_length() + 1)
    params = zstd.ZstdCompressionParameters(
        window_log=wide_enough, strategy=zstd.STRATEGY_GREEDY, min_match=4, search_log=6, target_length=16, chain_log=wide_enough, hash_log=wide_enough,
        write_content_size=False, write_checksum=False, write_dict_id=False, format=zstd.FORMAT_ZSTD1_MAGICLESS,
    )
    held = zstd.ZstdCompressionDict(content, dict_type=zstd.DICT_TYPE_RAWCONTENT)
    held.precompute_compress(compression_params=params)
    return zstd.ZstdCompressor(dict_data=held, compression_params=params)


def lengths(content: bytes, parts: list[bytes], at_once: int = 4096) -> np.ndarray:
    """Compressed length of each part with a dictionary."""
    found = [compressor(content).multi_compress_to_buffer(parts[a : a + at_once]) for a in range(0, len(parts), at_once)]
    return np.array([len(f[k]) for f in found for k in range(len(f))], np.int64)


@dataclass(frozen=True)
class Gaps:
    """What the toxic dictionary saves of each window."""

    toxic: bytes
    ordinary: bytes

    def saved(self, parts: list[bytes]) -> np.ndarray:
        return lengths(self.ordinary, parts) - lengths(self.toxic, parts)

    def of(self, texts: list[str]) -> list[np.ndarray]:
        """The gaps of each text's windows, all of them; equal windows of the texts are compressed once."""
        return [np.concatenate(parts) if parts else np.zeros(0, np.int64) for parts in self._parts(texts)]

    def _parts(self, texts: list[str]) -> list[list[np.ndarray]]:
        out: list[list[np.ndarray]] = [[] for _ in texts]
        held: list[tuple[int, list[str]]] = []
        n = 0

        def settle() -> None:
            place: dict[str, int] = {}
            at = [np.array([place.setdefault(w, len(place)) for w in windows], np.int64) for _, windows in held]
            gaps = self.saved([f" {w} ".encode("utf-16-le") for w in place])
            for (k, _), x in zip(held, at, strict=True):
                out[k].append(gaps[x])

        for k, text in enumerate(texts):
            words = words_of(text)
            windows = [" ".join(words[i : i + WORDS]) for i in range(max(1, len(words) - WORDS + 1))] if words else []
            for i in range(0, len(windows), AT_ONCE):
                held.append((k, windows[i : i + AT_ONCE]))
                n += len(held[-1][1])
                if n >= AT_ONCE:
                    settle()
                    held, n = [], 0
        if held:
            settle()
        return out


def statistic(gaps: np.ndarray, hit: int) -> float:
    """Hits plus, where there is one, the largest gap as a share of one."""
    hits = int((gaps >= hit).sum())
    return hits + min(float(gaps.max()) / 64, 0.999) if hits else 0.0


@dataclass(frozen=True)
class Model:
    gaps: Gaps
    hit: int
    knots: np.ndarray
    values: np.ndarray

    def probability(self, stats: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(stats, self.knots, self.values), 0.0, 1.0)


def gain(k: int, n: int, k_all: int, n_all: int) -> float:
    """How much likelier k of n is at its own rate than at that of k_all of n_all, as a logarithm."""
    part = lambda a, b: a * math.log(a / (n * b / n_all)) if a else 0.0
    return part(k, k_all) + part(n - k, n_all - k_all)


def pick(own: Counter, n_own: int, other: Counter, n_other: int, words: Counter, ratio: float, level: float) -> list[str]:
    """All segments of one class that pass ``ratio`` and a test, by document frequency, length and log-ratio.

    The test is the likelihood ratio of the segment's two frequencies at ``level``: among thousands of rare
    segments, hundreds pass the ratio by chance. ``words`` has the
    document frequencies of the class's words: a segment is left out if most of what it lies in holds COVER better ones.
    """
    worth, n_all, clear = {}, n_own + n_other, -math.log(level)
    for part, n in own.items():
        r = ((n + 0.5) / (n_own + 1)) / ((other[part] + 0.5) / (n_other + 1))
        if r >= ratio and gain(n, n_own, n + other[part], n_all) + gain(other[part], n_other, n + other[part], n_all) >= clear:
            worth[part] = n * len(part) * math.log(r)
    within: dict[str, list[str]] = {part: [] for part in worth}
    for word in words:
        for part in segments([word]) & worth.keys():
            within[part].append(word)
    kept: list[str] = []
    covered: Counter = Counter()
    for part in sorted(worth, key=lambda w: (-worth[w], w)):
        if sum(words[w] for w in within[part] if covered[w] < COVER) * 2 > sum(words[w] for w in within[part]):
            kept.append(part)
            covered.update(within[part])
    return kept


def copy_families(sample: list[tuple[str, int]]) -> list[tuple[int, set[str], int]]:
    """Label, words and size of each family: documents of a label whose words are nearly those of its first."""
    salts = np.random.default_rng(11).integers(0, 2**31, 2 * BANDS, np.uint32) * np.uint32(2) + np.uint32(1)
    families: list[tuple[int, set[str], int]] = []
    firsts: list[frozenset] = []
    buckets: dict[tuple, list[int]] = {}
    for text, label in sample:
        words = frozenset(words_of(text))
        code = np.fromiter((zlib.crc32(w.encode()) for w in words), np.uint32, len(words))
        least = [int((code * s).min()) if len(code) else 0 for s in salts]
        keys = [(label, k, *least[2 * k : 2 * k + 2]) for k in range(BANDS)]
        like = sorted({f for key in keys for f in buckets.get(key, ())})
        at = next((f for f in like if len(firsts[f] & words) >= COPY * len(firsts[f] | words)), None)
        if at is None:
            at = len(families)
            families.append((label, set(), 0))
            firsts.append(words)
            for key in keys:
                buckets.setdefault(key, []).append(at)
        families[at] = (label, families[at][1] | words, families[at][2] + 1)
    return families


def dictionaries(sample: list[tuple[str, int]], ordinary_bytes: int, ratio: float, least: int) -> Gaps | None:
    """The two dictionaries, or None where no segment marks toxic text."""
    families = copy_families(sample)
    size = Counter(label for label, _, _ in families)
    if not (size[0] and size[1]):
        return None
    own: Counter = Counter()
    held: Counter = Counter()
    for label, words, _ in families:
        if label:
            own.update(segments(words))
            held.update(words)
    own = Counter({part: n for part, n in own.items() if n >= least})
    other: Counter = Counter({part: 0 for part in own})
    common: Counter = Counter()
    for label, words, _ in families:
        common.update(words)
        if not label:
            other.update(own.keys() & segments(words))
    toxic = pick(own, size[1], other, size[0], held, ratio, LEVEL / max(1, sum(n >= least for n in held.values())))  # a word's segments stand and fall together
    if not toxic:
        return None
    frequent = [w for w in sorted(common, key=lambda w: (-common[w], w))[:ordinary_bytes] if not any(t in f" {w} " for t in toxic)]
    shared = wide(reversed(frequent))[-ordinary_bytes:]
    return Gaps(wide(reversed(toxic)) + shared, shared)


def train(sample: list[tuple[str, int]], ordinary_bytes: int = 24_000, ratio: float = 8.0, least: int = 3) -> Model:
    """Dictionaries, hit threshold and calibration from labelled texts."""
    labels = np.array([label for _, label in sample], float)
    gaps = dictionaries(sample, ordinary_bytes, ratio, least)
    if gaps is None:
        rate = (labels.sum() + 0.5) / (len(labels) + 1)
        return Model(Gaps(b"", b""), GRID[-1], np.array([0.0]), np.array([rate]))
    found = gaps.of([text for text, _ in sample])

    def f_half(hit: int) -> float:
        """The F measure that counts precision twice as much as recall: ordinary documents outnumber the sample's."""
        said = np.array([bool((g >= hit).any()) for g in found])
        return 1.25 * (said * labels).sum() / max(1.0, said.sum() + 0.25 * labels.sum())

    hit = max(GRID, key=lambda t: (f_half(t), -t))
    stats = np.array([statistic(g, hit) for g in found])
    # one document of each label at either end keeps the probabilities off 0 and 1
    ends = np.array([0.0, 0.0, stats.max(), stats.max()])
    knots, values = isotonic(np.concatenate([stats, ends]), np.concatenate([labels, [0.0, 1.0, 0.0, 1.0]]))
    return Model(gaps, hit, knots, values)


def fit_toxicity(
    docs: DataFrame,
    labels: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    folds: int = 4,
    held: int = 2,
    sample_per_label: int = 3000,
    sample_chars: int = 20_000,
    ordinary_bytes: int = 24_000,
) -> Model:
    """Fit on a bounded sample of the labelled rows outside the held-out fold.

    ``ordinary_bytes`` bounds what both dictionaries share: the most frequent words of the sample, in UTF-16.
    """
    texts = id_text(docs, id_col, text_col).where(F.length("text") <= sample_chars)
    return train(bounded_sample(texts, labels, label_col, sample_per_label, ~held_out("doc_id", folds, held), id_col), ordinary_bytes)


def toxicity(
    docs: DataFrame,
    model: Model,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    folds: int = 4,
    held: int = 2,
    threshold: float = 0.3,
) -> DataFrame:
    """Score, prediction, hits and largest gap of every document."""

    def score(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = model.gaps.of(batch["text"].to_pylist())
        stats = np.array([statistic(g, model.hit) for g in found])
        p = model.probability(stats)
        return pa.RecordBatch.from_arrays(
            [batch["doc_id"], batch["held_out"], pa.array(p), pa.array((p >= threshold).astype(np.int32)), pa.array(np.array([(g >= model.hit).sum() for g in found], np.int64)), pa.array([float(g.max(initial=0)) for g in found])],
            ["doc_id", "held_out", "score", "predicted", "hits", "largest_gap"],
        )

    rows = id_text(docs, id_col, text_col).withColumn("held_out", held_out("doc_id", folds, held))
    return map_batches(rows, score, "doc_id long, held_out boolean, score double, predicted int, hits long, largest_gap double")


def drop_toxic(docs: DataFrame, model: Model, *, text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs``, all columns, whose text isn't predicted toxic."""

    def keep(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = model.gaps.of([t or "" for t in batch[text_col].to_pylist()])
        p = model.probability(np.array([statistic(g, model.hit) for g in found]))
        return batch.filter(pa.array(p < threshold))

    return map_batches(docs, keep, docs.schema)
