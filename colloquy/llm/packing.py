"""Best-fit-decreasing packing of documents into sequences of at most ``capacity`` tokens.

1. Each document is encoded once; its end id is appended; longer ones are cut so that all
   pieces but the first are full. What is kept of a piece is its length and checksum.
2. Pieces that fill a sequence have one to themselves. The others are dealt to shards of
   about ``shard_pieces`` by the place of their row, never by a column, so no hot key matters.
3. Each shard is packed by best-fit decreasing: a segment tree over the remaining capacities
   finds the tightest open bin in logarithmic time. A shard costs at most a bin or so against
   one packing of everything, and the number of shards grows with the data.

Defined results: a null text counts as empty, and an empty text is the end id alone; repeated
rows are packed each; ids may be null; other columns are ignored; an empty table gives none; texts of any
length are cut into whole pieces; equally long pieces of a shard go in the order of their row's key.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.llm import subwords
from colloquy.llm.common import id_text, sliced, written

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, row_key long"
PACKED = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


class OpenBins:
    """Open bins by remaining capacity, in a segment tree that counts them."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.bins: list[list[int]] = [[] for _ in range(capacity + 1)]

    def add(self, remaining: int, bin_id: int) -> None:
        self.bins[remaining].append(bin_id)
        self._change(remaining, 1)

    def _change(self, remaining: int, by: int) -> None:
        at = self.leaves + remaining
        while at:
            self.count[at] += by
            at >>= 1

    def take_tightest(self, need: int) -> tuple[int, int] | None:
        """Remove and return (remaining, bin) of an open bin with the least remaining >= need."""
        count, at = self.count, self.leaves + need
        if not count[at]:
            # climb until a right sibling has an open bin, then go down to its leftmost leaf
            while at > 1 and (at & 1 or not count[at + 1]):
                at >>= 1
            if at <= 1:
                return None
            at += 1
            while at < self.leaves:
                at = 2 * at if count[2 * at] else 2 * at + 1
        remaining = at - self.leaves
        bin_id = self.bins[remaining].pop()
        self._change(remaining, -1)
        return remaining, bin_id


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each item, for items of 1 to ``capacity``."""
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    tree, used = OpenBins(capacity), 0
    for k in np.argsort(-lengths, kind="stable").tolist():
        need = int(lengths[k])
        found = tree.take_tightest(need)
        if found is None:
            found, used = (capacity, used), used + 1
        remaining, bins[k] = found
        offsets[k] = capacity - remaining
        if remaining > need:
            tree.add(remaining - need, int(bins[k]))
    return bins, offsets


def pieces_of(docs: DataFrame, capacity: int, end_id: int, path: str) -> DataFrame:
    """The pieces of all documents: spans of their ids, with checksums."""

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, rows = subwords.encoder(path), TaskContext.get().partitionId() << 40
        for batch in sliced(batches, 512):
            out: list[tuple] = []
            for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist(), strict=True):
                ids = np.array([*bpe.encode(text), end_id], "<u4")
                first = len(ids) % capacity or capacity
                starts = [0, *range(first, len(ids), capacity)]
                for piece, (a, b) in enumerate(zip(starts, [*starts[1:], len(ids)], strict=True)):
                    out.append((doc_id, piece, a, b - a, zlib.crc32(ids[a:b].tobytes()), rows))
                    rows += 1
            if out:
                kinds = [pa.int64(), pa.int32(), *[pa.int64()] * 4]
                names = ["doc_id", "piece", "start", "length", "ids_crc32", "row_key"]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names)

    return docs.mapInArrow(cut, PIECES)


def best_fit_packing(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    capacity: int = 2048,
    end_id: int = 0,
    shard_pieces: int = 8192,
    tokenizer_path: str | None = None,
) -> DataFrame:
    """One row per piece with its sequence and its place there."""
    path = tokenizer_path or subwords.default_path()
    pieces = written(pieces_of(id_text(docs, id_col, text_col), capacity, end_id, path), "pieces")
    full = F.col("length") == capacity
    shards = max(1, -(-pieces.where(~full).count() // shard_pieces))

    def pack(shard: pd.DataFrame) -> pd.DataFrame:
        shard = shard.sort_values("row_key", ignore_index=True)
        bins, offsets = best_fit_decreasing(shard["length"].to_numpy(), capacity)
        return shard.assign(sequence_id=shard["shard"] * 2**32 + bins, offset=offsets)[[c.split()[0] for c in PACKED.split(", ")]]

    alone = pieces.where(full).select("doc_id", "piece", "start", "length", "ids_crc32", (-F.col("row_key") - 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    dealt = pieces.where(~full).withColumn("shard", F.pmod(F.xxhash64("row_key"), F.lit(shards)))
    return alone.unionByName(dealt.groupBy("shard").applyInPandas(pack, PACKED))
