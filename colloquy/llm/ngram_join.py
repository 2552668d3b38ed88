"""N-gram Jaccard join by several global orders of the tokens.

A document's set holds the hashes of its distinct word shingles (its tokens); documents with equal
sets are one node from here on. A token's rank in order o is its frequency class, rare ones first,
then a hash of its own for that order. Frequency classes come from counts of all sets in a table of
fixed size.

1. If two sets are within the similarity, then in EVERY order they share a token of their
   prefixes, the first n - ceil(percent * n) + 1 tokens. Inverted lists of the first order's prefixes
   bring nodes together.
2. A list's members meet hubs of like size in place of each other. A pair goes on only if the parity sketches of
   its sets differ in no more bits than sets within the similarity can differ in tokens, and links are confirmed on the full sets.
3. What is left are lists that still hold several components. Members of short ones meet there. Members of long
   ones meet in the second order's lists instead, made for them alone, and those of long lists among these in the third
   order's: a link is in the lists of every order. All pairs of different components that meet, of sizes and places that allow it,
   are filtered and confirmed in the same way, so no link between components is lost.
4. Components of the links give each document its class.

Links inside a component that is already known aren't looked for, so that a group of copies costs
as many pairs as it has members; hence there is no count of links.

Defined results: null texts and texts without words have an empty set and are linked with nothing; a
text with fewer words than a shingle is one shingle; texts of any length are read whole; repeated rows
are in one class; a row with a null id is in its class but never names it; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.llm.common import drop_written, id_text, map_batches, sliced, written
from colloquy.llm.components import connected_components
from colloquy.llm.near_duplicates import HUBS, SHORT_LIST, bit_place, bitmap, confirmed, full_sets, hub_pairs, mixed, open_members, remaining_pairs, set_hash, shingle_set, shingles, with_components

#: Of each order the number that its hashes start from. The first order makes the lists.
ORDERS = (0x243F6A8885A308D3, 0x13198A2E03707344, 0xA4093822299F31D0)
#: Counters of the table of frequencies, and those that one row carries between tasks.
COUNTERS, CHUNK = 1 << 24, 1 << 16
#: Parts of the input that fill one table.
PARTS = 8
#: Bits of a parity sketch. Sets of up to about 9,000 shingles can differ in more bits than the similarity allows.
PARITIES = 2048
PREFIXED = "doc_id long, n_shingles long, node long, first array<long>, second array<int>, third array<int>, parity array<long>"


def frequency_classes(rows: DataFrame, words: int) -> np.ndarray:
    """For each of COUNTERS hash classes how often its tokens occur in all documents, on a logarithmic scale of 256 steps.

    A task counts in a table of fixed size; chunks of the tables are added up where each chunk's rows
    meet, a row at a time. Counts only order tokens: where many tokens share a counter, lists get longer, not wrong.
    """

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(COUNTERS, np.int32)
        for batch in sliced(batches, 1024):
            for text in batch["text"].to_pylist():
                np.add.at(total, shingles(text, words) & (COUNTERS - 1), 1)
        at = [k for k in range(0, COUNTERS, CHUNK) if total[k : k + CHUNK].any()]
        for k in at:
            part = total[k : k + CHUNK]
            part = part.astype(np.uint8) if part.max() < 256 else part
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), pa.array([part.tobytes()], pa.binary())], ["at", "counts"])

    def add(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for at, counts in zip(batch["at"].to_pylist(), batch["counts"].to_pylist(), strict=True):
                total[at] = total.get(at, 0) + np.frombuffer(counts, np.uint8 if len(counts) == CHUNK else np.int32).astype(np.int64)
        classes = [scale(t).tobytes() for t in total.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array(classes, pa.binary())], ["at", "classes"])

    parts = rows.rdd.getNumPartitions()
    fewer = rows.select("text").coalesce(max(1, min(parts, max(rows.sparkSession.sparkContext.defaultParallelism, parts // PARTS))))
    counted = fewer.mapInArrow(count, "at long, counts binary")
    out = np.zeros(COUNTERS, np.uint8)
    for r in counted.repartition("at").mapInArrow(add, "at long, classes binary").collect():
        out[r["at"] : r["at"] + CHUNK] = np.frombuffer(r["classes"], np.uint8)
    return out


def scale(counts: np.ndarray) -> np.ndarray:
    return np.minimum(np.log2(counts + 1) * 12, 255).astype(np.uint8)


def prefix(values: np.ndarray, classes: np.ndarray, percent: int, start: int) -> np.ndarray:
    """The tokens of the prefix in one order, in that order; equal hashes go by the token itself."""
    n = len(values)
    if not n:
        return values
    size = n - -(-percent * n // 100) + 1
    rank = mixed(values.view(np.uint64) ^ np.uint64(start)) >> np.uint64(8) | classes.astype(np.uint64) << np.uint64(56)
    if size < n:
        within = np.flatnonzero(rank <= np.partition(rank, size - 1)[size - 1])
        values, rank = values[within], rank[within]
    return values[np.argsort(rank, kind="stable")][:size]


def parity(values: np.ndarray) -> np.ndarray:
    """Of each of PARITIES classes of hashes whether the set holds an odd number. Two sets differ in at least as many tokens as their sketches in bits."""
    odd = np.bincount(values.view(np.uint64) >> np.uint64(64 - PARITIES.bit_length() + 1), minlength=PARITIES) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def prefixes(rows: DataFrame, words: int, percent: int, classes: np.ndarray) -> DataFrame:
    """Size, hash, prefixes and parity sketch of every document's set. Only the first order's prefix is kept in full; of the others
    32 bits of each token: where two tokens share them, lists get longer, not wrong."""

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = [shingle_set(t, words) for t in batch["text"].to_pylist()]
        of = [classes[s & (COUNTERS - 1)] for s in sets]
        first, second, third = ([prefix(s, c, percent, start) for s, c in zip(sets, of, strict=True)] for start in ORDERS)
        short = [pa.array([p.astype(np.int32) for p in ps], pa.list_(pa.int32())) for ps in (second, third)]
        return pa.RecordBatch.from_arrays(
            [batch["doc_id"], pa.array([len(s) for s in sets], pa.int64()), pa.array([set_hash(s) for s in sets], pa.int64()), pa.array(first, pa.list_(pa.int64())), *short, pa.array([parity(s) for s in sets], pa.list_(pa.int64()))],
            ["doc_id", "n_shingles", "node", "first", "second", "third", "parity"],
        )

    return map_batches(rows, one, PREFIXED)


def lists(nodes: DataFrame) -> DataFrame:
    """(v, node, n, place, central): the nodes in the inverted lists of their first order's prefix that have several members."""
    postings = nodes.select("node", "n", F.posexplode("first").alias("place", "v"))
    shared = postings.groupBy("v").agg(F.count("*").alias("m")).where("m > 1")
    found = written(postings.join(shared, "v"), "postings")
    central = found.groupBy("node").agg(F.sum("m").alias("central"))
    out = written(found.join(central, "node").select("v", "node", "n", F.col("place").cast("long").alias("place"), "central"), "lists")
    drop_written(found)
    return out


def near_pairs(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose parity sketches don't rule the similarity out; no pair within it is dropped.

    A bitmap of fixed size keeps nodes without pairs out of the shuffle; it only saves work, the joins decide.
    """
    bits = bitmap(pairs.select(F.explode(F.array("a", "b")).alias("node")), "node")

    def some(batch: pa.RecordBatch) -> pa.RecordBatch:
        at = batch["place"].to_numpy()
        return batch.select(["node", "n", "parity"]).filter(pa.array((bits[at >> 6] >> (at & 63)) & 1 == 1))

    held = map_batches(nodes.select("node", "n", "parity", bit_place("node").alias("place")), some, "node long, n long, parity array<long>", 8192)
    for side in ("a", "b"):
        pairs = pairs.join(held.select(F.col("node").alias(side), F.col("n").alias(f"n_{side}"), F.col("parity").alias(f"parity_{side}")), side)
    differ = F.aggregate(F.zip_with("parity_a", "parity_b", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda total, x: total + x)
    return pairs.where(differ * (100 + percent) <= (F.col("n_a") + F.col("n_b")) * (100 - percent)).select("a", "b")


def lists_of(nodes: DataFrame, wanted: DataFrame, order: str) -> DataFrame:
    """As ``lists``, of the wanted nodes alone, by the prefixes of another order."""
    tokens = nodes.join(wanted, "node", "left_semi").select("node", "n", F.posexplode(order).alias("place", "v"))
    return tokens.select(F.col("v").cast("long").alias("v"), "node", "n", F.col("place").cast("long").alias("place"), F.lit(0).cast("long").alias("central"))


def in_long_lists(members: DataFrame) -> DataFrame:
    return members.where(F.col("m") > SHORT_LIST).select("node").distinct()


def linked_nodes(rows: DataFrame, postings: DataFrame, nodes: DataFrame, words: int, percent: int) -> DataFrame | None:
    """(node, component) of the nodes that are linked with others; None where there are none."""
    links = tested = components = None

    def confirm(pairs: DataFrame) -> None:
        """Add the pairs that are links, and work out the components anew."""
        nonlocal links, tested, components
        pairs = written(pairs if tested is None else pairs.join(tested, ["a", "b"], "left_anti"), "pairs")
        tested = pairs if tested is None else tested.union(pairs)
        near = written(near_pairs(pairs, nodes, percent), "near")
        if near.isEmpty():
            return
        wanted = near.select(F.col("a").alias("node")).union(near.select("b")).distinct()
        sets = written(full_sets(rows, nodes.select("node", "rep").join(wanted, "node", "left_semi"), words), "sets")
        new = written(confirmed(near, sets, percent), "links")
        drop_written(near, sets)
        links = new if links is None else links.union(new)
        components = written(connected_components(links), "components")

    confirm(hub_pairs(with_components(postings, None), percent, 1))
    members = open_members(postings, components)
    confirm(hub_pairs(members.where(F.col("m") > SHORT_LIST), percent, HUBS))
    first = open_members(members.drop("component", "m"), components)
    second = open_members(lists_of(nodes, in_long_lists(first), "second"), components)
    third = open_members(lists_of(nodes, in_long_lists(second), "third"), components)
    short = [part.where(F.col("m") <= SHORT_LIST) for part in (first, second)]
    confirm(remaining_pairs(short[0], percent).union(remaining_pairs(short[1], percent)).union(remaining_pairs(third, percent)).distinct())
    drop_written(members, first, second, third)
    return components


def ngram_join(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    words: int = 3,
    percent: int = 90,
) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (the least doc_id of its class, by links of ``percent`` % or more)."""
    rows = id_text(docs, id_col, text_col)
    held = written(prefixes(rows, words, percent, frequency_classes(rows, words)), "prefixes")
    nodes = held.where("node IS NOT NULL").groupBy("node")
    nodes = nodes.agg(F.min("doc_id").alias("rep"), *[F.first(c).alias(c if c != "n_shingles" else "n") for c in ("n_shingles", "first", "second", "third", "parity")])
    nodes = written(nodes, "nodes")
    postings = lists(nodes)
    sharing = written(nodes.select("node", "rep", "n", "second", "third", "parity").join(postings.select("node").distinct(), "node", "left_semi"), "sharing")
    components = linked_nodes(rows, postings, sharing, words, percent)
    named = nodes.select("node", "rep")
    if components is not None:
        named = named.join(components, "node", "left").withColumn("component", F.coalesce("component", "node"))
    else:
        named = named.withColumn("component", F.col("node"))
    names = named.groupBy("component").agg(F.min("rep").alias("component_id"))
    classes = named.join(names, "component").select("node", "component_id")
    out = held.select("doc_id", "n_shingles", "node").join(classes, "node").select("doc_id", "n_shingles", "component_id")
    return out.union(held.where("node IS NULL").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))
