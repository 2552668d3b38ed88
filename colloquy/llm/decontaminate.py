"""Benchmark decontamination by pigeonhole edit matching.

An item of n characters (lower-cased, white space collapsed) may be off by k = floor(rate * n)
edits. It is split into k + 1 pieces: k edits can't touch them all, so every text within the
budget holds some piece exactly. One Aho-Corasick automaton finds all piece hits in one pass over
a text; each hit fixes where the item would lie, and Myers' bit-parallel algorithm computes the
least edit distance to any part of the text there.

Items reach the tasks in blocks of at most about ``block_chars``; a larger benchmark takes more passes
over the documents, never a larger broadcast. Documents are not shuffled.

Defined results: null or blank items match nothing; null and blank texts match no item; repeated
rows of documents are matched each, repeated items too; ids may be null; other columns are ignored;
texts of any length are searched whole.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property, reduce

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.llm.common import id_text, map_batches

MATCHES = "doc_id long, item_id long, distance int, start long, end long, item_chars int"


def normal(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def search(pattern: str, text: str) -> tuple[int, int]:
    """Least edit distance of ``pattern`` to any substring of ``text``, and that substring's first end."""
    m, full, top = len(pattern), (1 << len(pattern)) - 1, 1 << (len(pattern) - 1)
    masks: dict[str, int] = {}
    for i, c in enumerate(pattern):
        masks[c] = masks.get(c, 0) | 1 << i
    up, down, score = full, 0, m
    best, end = m, 0
    for j, c in enumerate(text, 1):
        eq = masks.get(c, 0)
        vertical = eq | down
        horizontal = (((eq & up) + up) ^ up) | eq
        plus = down | (full & ~(horizontal | up))
        minus = up & horizontal
        if plus & top:
            score += 1
        elif minus & top:
            score -= 1
        if score < best:
            best, end = score, j
        plus, minus = plus << 1, minus << 1
        up = (minus | ~(vertical | plus)) & full
        down = plus & vertical & full
    return best, end


def longest_suffix_start(pattern: str, text: str, distance: int) -> int:
    """Where in ``text`` the shortest suffix within ``distance`` of ``pattern`` starts."""
    n = len(pattern)
    row = list(range(n + 1))
    for j, c in enumerate(reversed(text), 1):
        before, row = row, [j]
        for i, p in enumerate(reversed(pattern), 1):
            row.append(min(before[i] + 1, row[i - 1] + 1, before[i - 1] + (p != c)))
        if row[n] <= distance:
            return len(text) - j
    return 0


@dataclass
class Items:
    """A block of benchmark items, ready to be searched for."""

    ids: list[int | None]
    texts: list[str]
    rate: float

    def budget(self, k: int) -> int:
        return int(len(self.texts[k]) * self.rate)

    @cached_property
    def automaton(self) -> ahocorasick.Automaton:
        """All pieces, each with its length, its items and its places in them."""
        places: dict[str, set[tuple[int, int]]] = {}
        for k, text in enumerate(self.texts):
            n = self.budget(k) + 1
            cuts = [len(text) * i // n for i in range(n + 1)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                places.setdefault(text[a:b], set()).add((k, a))
        found = ahocorasick.Automaton()
        for piece, at in places.items():
            found.add_word(piece, (len(piece), sorted(at)))
        found.make_automaton()
        return found

    def matches(self, text: str) -> list[tuple[int, int, int, int]]:
        """(item, distance, start, end) of the best place of every item within its budget."""
        lies: dict[int, set[int]] = {}
        for last, (size, places) in self.automaton.iter(text):
            for k, offset in places:
                lies.setdefault(k, set()).add(last + 1 - size - offset)
        return [found for k in sorted(lies) if (found := self.verified(k, text, sorted(lies[k])))]

    def verified(self, k: int, text: str, starts: list[int]) -> tuple[int, int, int, int] | None:
        item, budget = self.texts[k], self.budget(k)
        for at in starts:
            if at >= 0 and text.startswith(item, at):
                return k, 0, at, at + len(item)
        spans: list[list[int]] = []
        for at in starts:
            low, high = max(0, at - budget), min(len(text), at + len(item) + budget)
            if spans and low <= spans[-1][2] + budget:
                spans[-1][1:] = [high, at]
            else:
                spans.append([low, high, at])
        best = min(((*search(item, text[low:high]), low) for low, high, _ in spans), key=lambda x: (x[0], x[1] + x[2]))
        distance, end = best[0], best[1] + best[2]
        if distance > budget:
            return None
        low = max(0, end - len(item) - distance)
        return k, distance, low + longest_suffix_start(item, text[low:end], distance), end


def item_blocks(items: DataFrame, rate: float, block_chars: int, id_col: str, text_col: str) -> list[Items]:
    """The items in blocks of about ``block_chars``; each is collected alone, as it is used."""
    rows = id_text(items, id_col, text_col).where(F.trim("text") != "")
    total = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    n = -(-total // block_chars)
    blocks = []
    for b in range(n):
        part = sorted((normal(r["text"]), r["doc_id"]) for r in rows.where(F.pmod(F.xxhash64("text"), F.lit(n)) == b).collect() if normal(r["text"]))
        if part:
            blocks.append(Items([i for _, i in part], [t for t, _ in part], rate))
    return blocks


def contaminated(
    docs: DataFrame,
    items: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
    rate: float = 0.05,
    block_chars: int = 1_000_000,
) -> DataFrame:
    """One row per document and benchmark item that it holds within the item's error budget.

    ``start`` and ``end`` are the item's place in the normalised text.
    """
    rows = id_text(docs, id_col, text_col)

    def of_block(block: Items) -> DataFrame:
        def find(batch: pa.RecordBatch) -> pa.RecordBatch:
            out = []
            for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist(), strict=True):
                out += [(doc_id, block.ids[k], d, a, b, len(block.texts[k])) for k, d, a, b in block.matches(normal(text))]
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32()]
            columns = zip(*out, strict=True) if out else [[]] * len(kinds)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], [f.split()[0] for f in MATCHES.split(", ")])

        return map_batches(rows, find, MATCHES)

    blocks = item_blocks(items, rate, block_chars, item_id_col, item_text_col)
    if not blocks:
        return docs.sparkSession.createDataFrame([], MATCHES)
    return reduce(DataFrame.unionAll, [of_block(b) for b in blocks])


def drop_contaminated(
    docs: DataFrame, items: DataFrame, *, text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", rate: float = 0.05, block_chars: int = 1_000_000
) -> DataFrame:
    """The rows of ``docs``, all columns, that hold no benchmark item within its budget."""
    for block in item_blocks(items, rate, block_chars, item_id_col, item_text_col):

        def keep(batch: pa.RecordBatch, block: Items = block) -> pa.RecordBatch:
            return batch.filter(pa.array([not block.matches(normal(t)) for t in batch[text_col].to_pylist()]))

        docs = map_batches(docs, keep, docs.schema)
    return docs
