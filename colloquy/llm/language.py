"""Language identification by a bidirectional gated recurrent network over bytes.

The network reads a text's UTF-8 bytes in both directions and labels every position with a
probability for each language; a document's probabilities are the mean over its positions.
It is written in numpy and trained by backpropagation through time.

A text is read in chunks of ``core`` bytes. Each direction warms up on ``context`` bytes before
its chunk, so every position is labelled once, by states that have read its surroundings, and
chunks of all lengths of text run side by side in one batch. The squashing functions are
x / (1 + |x|) and half of that plus a half, which cost a fraction of tanh and the logistic curve.

Learned from at most ``sample_per_language`` documents of each labelled language outside the held-out
fold; of a text over ``sample_chars`` characters one window of that length is taken, placed by a hash.
Defined results: null texts and those without a letter are ``und`` with score 0; so is everything
if there is nothing to learn from; a null id is held out; repeated rows are labelled each; other
columns are ignored; texts of any length are read whole; of equally likely languages the first by name counts.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from colloquy.llm.common import held_out, id_text, map_batches

UNDETERMINED = "und"
#: Stands before and after a text.
EDGE = 256
FLOAT = np.float32


def squash(x: np.ndarray) -> np.ndarray:
    return x / (1 + np.abs(x))


def squash_slope(y: np.ndarray) -> np.ndarray:
    """Slope of ``squash`` where its value is ``y``."""
    return (1 - np.abs(y)) ** 2


@dataclass
class Direction:
    """Weights of one direction. Gates are in the order reset, update, candidate."""

    read: np.ndarray  # 257 x 3h: what a byte adds to the gates, biases included
    gates: np.ndarray  # h x 2h: from the state to reset and update
    candidate: np.ndarray  # h x h: from the reset state to the candidate

    @classmethod
    def new(cls, rng: np.random.Generator, hidden: int) -> Direction:
        draw = lambda *shape: (rng.standard_normal(shape) / np.sqrt(hidden)).astype(FLOAT)
        return cls(draw(EDGE + 1, 3 * hidden), draw(hidden, 2 * hidden), draw(hidden, hidden))

    def step(self, codes: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, ...]:
        """New state, and what the backward pass needs; a gate's sigmoid is (1 + squash) / 2."""
        h = state.shape[1]
        seen = self.read[codes]
        both = seen[:, : 2 * h] + state @ self.gates
        both /= 1 + np.abs(both)
        gate = both * FLOAT(0.5)
        gate += FLOAT(0.5)
        kept = gate[:, :h] * state
        new = seen[:, 2 * h :] + kept @ self.candidate
        new /= 1 + np.abs(new)
        update = gate[:, h:]
        return state + update * (new - state), both, gate, kept, new

    def run(self, codes: np.ndarray, skip: int) -> np.ndarray:
        """States after each column of ``codes`` (batch x time) but the first ``skip``: time x batch x h."""
        h = self.candidate.shape[0]
        state = np.zeros((len(codes), h), FLOAT)
        out = np.empty((codes.shape[1] - skip, len(codes), h), FLOAT)
        for t in range(codes.shape[1]):
            state = self.step(codes[:, t], state)[0]
            if t >= skip:
                out[t - skip] = state
        return out

    def back(self, codes: np.ndarray, skip: int, wanted: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """Run forward, take ``wanted(states)`` as the slope of the loss in each state, and go back in time."""
        h = self.candidate.shape[0]
        state, steps = np.zeros((len(codes), h), FLOAT), []
        for t in range(codes.shape[1]):
            before = state
            state, *kept = self.step(codes[:, t], state)
            steps.append((before, *kept, state))
        states = np.stack([s[-1] for s in steps[skip:]])
        slopes = wanted(states)
        grads = [np.zeros_like(w) for w in (self.read, self.gates, self.candidate)]
        carry = np.zeros((len(codes), h), FLOAT)
        for t in range(len(steps) - 1, -1, -1):
            before, both, gate, kept, new, _ = steps[t]
            d_state = carry + slopes[t - skip] if t >= skip else carry
            update, reset = gate[:, h:], gate[:, :h]
            d_new = d_state * update * squash_slope(new)
            d_update = d_state * (new - before) * 0.5 * squash_slope(both[:, h:])
            d_kept = d_new @ self.candidate.T
            d_reset = d_kept * before * 0.5 * squash_slope(both[:, :h])
            d_both = np.concatenate([d_reset, d_update], 1)
            grads[2] += kept.T @ d_new
            grads[1] += before.T @ d_both
            np.add.at(grads[0], codes[:, t], np.concatenate([d_both, d_new], 1))
            carry = d_state * (1 - update) + d_kept * reset + d_both @ self.gates.T
        return states, grads


@dataclass
class Network:
    """Both directions and the output layer."""

    languages: list[str]
    forward: Direction
    backward: Direction
    out: np.ndarray  # 2h x languages
    bias: np.ndarray
    levels: np.ndarray = field(default_factory=lambda: np.zeros(0))  # the least score of each language that stands

    def positions(self, chunks: np.ndarray, context: int) -> np.ndarray:
        """Probabilities of each core position: batch x core x languages."""
        ahead = self.forward.run(chunks[:, :-context], context)
        behind = self.backward.run(chunks[:, ::-1][:, :-context], context)[::-1]
        h = ahead.shape[2]
        score = (ahead.reshape(-1, h) @ self.out[:h] + behind.reshape(-1, h) @ self.out[h:] + self.bias).reshape(*ahead.shape[:2], -1)
        score -= score.max(2, keepdims=True)
        np.exp(score, out=score)
        score /= score.sum(2, keepdims=True)
        return score.transpose(1, 0, 2)

    def weights(self) -> list[np.ndarray]:
        return [*(w for d in (self.forward, self.backward) for w in (d.read, d.gates, d.candidate)), self.out, self.bias]


def chunked(texts: list[bytes], core: int, context: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All texts' chunks with their context (EDGE beyond a text), each chunk's text and length."""
    counts = np.array([-(-len(t) // core) for t in texts])
    # one long row: every text is followed by edges up to a whole number of cores plus the context on either side
    owner = np.repeat(np.arange(len(texts)), counts)
    rows = np.full((len(owner), core + 2 * context), EDGE, np.int16)
    lengths, k = np.zeros(len(owner), np.int64), 0
    for text, n in zip(texts, counts, strict=True):
        row = np.full((n + 1) * core + 2 * context, EDGE, np.int16)
        row[context : context + len(text)] = np.frombuffer(text, np.uint8)
        view = np.lib.stride_tricks.sliding_window_view(row, core + 2 * context)[: n * core : core]
        rows[k : k + n] = view
        lengths[k : k + n] = np.minimum(core, len(text) - np.arange(n) * core)
        k += n
    return rows, owner, lengths


def pooled(network: Network, texts: list[bytes], core: int, context: int, batch: int = 1024) -> np.ndarray:
    """Mean probabilities of each text's positions; zeros for an empty one. ``batch`` chunks at a time take some 50 MB."""
    rows, owner, lengths = chunked(texts, core, context)
    total = np.zeros((len(texts), len(network.languages)))
    # chunks of a length run together, so that short texts don't wait for padding
    order = np.argsort(lengths, kind="stable")
    for at in range(0, len(order), batch):
        take = order[at : at + batch]
        longest = int(lengths[take].max(initial=0))
        p = network.positions(np.ascontiguousarray(rows[take][:, : longest + 2 * context]), context)
        p[np.arange(longest) >= lengths[take][:, None]] = 0
        np.add.at(total, owner[take], p.sum(1, dtype=np.float64))
    size = np.array([max(1, len(t)) for t in texts], float)
    return total / size[:, None]


def train(
    sample: list[tuple[str, str]],
    *,
    hidden: int = 8,
    length: int = 64,
    context: int = 16,
    batch: int = 128,
    steps: int | None = None,
    rate: float = 0.02,
    seed: int = 7,
) -> Network:
    """Fit on windows of labelled texts by backpropagation through time, with Adam.

    A language has about as many windows however many there are: 260 steps up to eight languages, then in proportion.
    """
    rng = np.random.default_rng(seed)
    languages = sorted({lang for _, lang in sample})
    steps = steps or 260 * max(8, len(languages)) // 8
    texts = [[t.encode() for t, lang in sample if lang == name and t] for name in languages]
    net = Network(languages, Direction.new(rng, hidden), Direction.new(rng, hidden), (rng.standard_normal((2 * hidden, len(languages))) * 0.1).astype(FLOAT), np.zeros(len(languages), FLOAT))
    if len(languages) < 2 or not all(texts):
        return net
    moments = [(np.zeros_like(w), np.zeros_like(w)) for w in net.weights()]
    width = length + 2 * context
    for step in range(1, steps + 1):
        labels = rng.integers(len(languages), size=batch)
        codes = np.full((batch, width), EDGE, np.int16)
        for row, label in zip(codes, labels, strict=True):
            text = texts[label][rng.integers(len(texts[label]))]
            at = int(rng.integers(-context, max(1, len(text) - length)))
            part = np.frombuffer(text[max(0, at) : at + width], np.uint8)
            row[max(0, -at) : max(0, -at) + len(part)] = part
        real = (codes[:, context : context + length] != EDGE).T
        ahead, behind = codes[:, :-context], codes[:, ::-1][:, :-context]
        h, grads = hidden, {}
        back_states = net.backward.run(behind, context)[::-1]

        def slopes(states: np.ndarray, back_states=back_states, labels=labels, real=real, grads=grads) -> np.ndarray:
            both = np.concatenate([states, back_states], 2)
            score = both @ net.out + net.bias
            score -= score.max(2, keepdims=True)
            p = np.exp(score)
            p /= p.sum(2, keepdims=True)
            p[:, np.arange(len(labels)), labels] -= 1
            p *= (real / max(1, real.sum()))[:, :, None]
            flat = p.reshape(-1, p.shape[2])
            grads["out"], grads["bias"] = both.reshape(-1, 2 * h).T @ flat, flat.sum(0)
            d = p @ net.out.T
            grads["behind"] = d[:, :, h:]
            return d[:, :, :h].astype(FLOAT)

        _, g_ahead = net.forward.back(ahead, context, slopes)
        _, g_behind = net.backward.back(behind, context, lambda _, grads=grads: grads["behind"][::-1].astype(FLOAT))
        pace = rate * min(1.0, 2 * (1 - (step - 1) / steps))
        for w, g, (m, v) in zip(net.weights(), [*g_ahead, *g_behind, grads["out"], grads["bias"]], moments, strict=True):
            g = np.clip(g, -1, 1)
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            w -= (pace * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)).astype(FLOAT)
    return net


def fit_language(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    folds: int = 3,
    held: int = 1,
    sample_per_language: int = 400,
    sample_chars: int = 20_000,
) -> Network:
    """Fit on a bounded sample: some documents of every language that is labelled."""
    rows = id_text(docs, id_col, text_col, lang_col).withColumnRenamed(lang_col, "lang")
    rows = rows.where(F.col("lang").isNotNull() & ~held_out("doc_id", folds, held) & (F.length("text") > 0))
    rank = F.row_number().over(Window.partitionBy("lang", "part").orderBy("h", "doc_id"))
    ids = rows.select("lang", "doc_id").distinct().withColumns({"h": F.xxhash64("doc_id"), "part": F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(64))})
    # first within 64 parts, so that no task ranks all of one language
    few = ids.withColumn("r", rank).where(F.col("r") <= sample_per_language)
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("h", "doc_id"))
    chosen = few.withColumn("r", rank).where(F.col("r") <= sample_per_language).select("lang", "doc_id")
    start = F.when(F.length("text") > sample_chars, F.pmod(F.xxhash64("text"), F.length("text") - sample_chars + 1)).otherwise(0)
    window = F.substring("text", (start + 1).cast("int"), F.lit(sample_chars))
    found = rows.join(chosen, ["lang", "doc_id"], "left_semi").groupBy("lang", "doc_id").agg(F.min(window).alias("text")).collect()
    sample = [(r["text"], r["lang"]) for r in sorted(found, key=lambda r: (r["lang"], r["doc_id"]))]
    return with_levels(train(sample), sample)


def with_levels(network: Network, sample: list[tuple[str, str]]) -> Network:
    """The network with the score below which a text isn't taken for a language: halfway between chance and the least score of
    the training texts that it gives that language. Where no training text has it, none is too low."""
    names, score = predict(network, [t for t, _ in sample], 256, 16)
    at = {name: k for k, name in enumerate(network.languages)}
    levels = np.full(len(network.languages), np.inf)
    for name, s in zip(names, score, strict=True):
        if name != UNDETERMINED:
            levels[at[name]] = min(levels[at[name]], s)
    network.levels = np.where(np.isinf(levels), 0.0, (levels + 1 / max(1, len(levels))) / 2)
    return network


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def predict(network: Network, texts: list[str | None], core: int, context: int) -> tuple[list[str], np.ndarray]:
    """Language and score of each text."""
    real = [has_letter(t or "") and bool(network.languages) for t in texts]
    p = pooled(network, [(t or "").encode() if ok else b"" for t, ok in zip(texts, real, strict=True)], core, context) if network.languages else np.zeros((len(texts), 1))
    best = p.argmax(1)
    names = [network.languages[b] if ok else UNDETERMINED for b, ok in zip(best, real, strict=True)]
    return names, np.where(real, np.clip(p[np.arange(len(texts)), best], 0, 1), 0.0)


def language(
    docs: DataFrame,
    network: Network,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    folds: int = 3,
    held: int = 1,
    core: int = 256,
    context: int = 16,
) -> DataFrame:
    """Predicted language of every document, with the mean probability of its positions."""

    def label(batch: pa.RecordBatch) -> pa.RecordBatch:
        names, score = predict(network, batch["text"].to_pylist(), core, context)
        return pa.RecordBatch.from_arrays([batch["doc_id"], batch["held_out"], pa.array(names, pa.string()), pa.array(score)], ["doc_id", "held_out", "lang_pred", "score"])

    rows = id_text(docs, id_col, text_col).withColumn("held_out", held_out("doc_id", folds, held))
    return map_batches(rows, label, "doc_id long, held_out boolean, lang_pred string, score double", rows=512)


def drop_undetermined(docs: DataFrame, network: Network, *, text_col: str = "text", core: int = 256, context: int = 16) -> DataFrame:
    """The rows of ``docs``, all columns, whose text is in one of the learned languages as far as the network can tell.

    Texts without a letter go, and so do those whose score lies below their predicted language's level, which training texts
    set (``with_levels``); a network without languages keeps nothing.
    """
    levels = dict(zip(network.languages, network.levels, strict=True)) if len(network.levels) else {}

    def keep(batch: pa.RecordBatch) -> pa.RecordBatch:
        names, score = predict(network, batch[text_col].to_pylist(), core, context)
        return batch.filter(pa.array([n != UNDETERMINED and s >= levels.get(n, 0.0) for n, s in zip(names, score, strict=True)], pa.bool_()))

    return map_batches(docs, keep, docs.schema, rows=512)


