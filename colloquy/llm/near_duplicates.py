"""Near-duplicate groups by bottom-k sketches from one hash function.

1. A document's set holds the hashes of its distinct word shingles. Its sketch holds the k least
   of them. Documents with equal sets are one node from here on.
2. Inverted lists of the values that sketches retain generate candidates. Nodes within the
   wanted similarity share at least ``shared`` values of their sketches (all but certainly; for
   sets that their sketches hold whole, certainly), so by the prefix principle they meet in a list
   of one of their rarest values. Only the lists of those are made; values that half of all
   documents retain thus never generate anything.
3. A list's members are not paired with each other but with hubs of like size, those with most in
   common with others: first one hub for each class of sizes in every list, then HUBS of them in lists
   of more than SHORT_LIST members that still hold several components. Pairs are filtered by size, by
   the similarity that the sketches' union estimates, and confirmed on the full sets.
4. What then is left is worked off whole. Lists of up to SHORT_LIST members give all their pairs
   of different components that size and places allow; these rest on the sketches' bound of five
   standard deviations. Nodes of longer lists meet again by the prefix principle on their full sets,
   which is exact and leaves few pairs.
5. Components of the links give each document its class.

Sketch values are 64-bit hashes, as are the sets' own hashes. Defined results: null texts and
texts without words have an empty set and are linked with nothing; repeated rows are in one class; a row
with a null id is in its class but never names it (its class id is null if no row has an id);
other columns are ignored; texts of any length are read whole.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colloquy.llm.common import drop_written, id_text, map_batches, tasks_for, written
from colloquy.llm.components import connected_components

SKETCHES = "doc_id long, n_shingles long, node long, sketch array<long>"
MIX_A, MIX_B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
#: Bytes of a text that are hashed at a time.
PART = 1 << 20
#: Members up to which an inverted list simply gives its pairs: the pairs stay in proportion to the members.
SHORT_LIST = 48
#: Of the second round: hubs of each class of sizes in a longer list, and lists in which a node meets them, its longest.
HUBS, LISTS = 16, 4
#: Pairs for which a task confirms links, beyond two tasks for every core.
PAIRS = 2000
#: Bits of the filter that keeps texts without candidates out of the second pass; 1 MB whatever the input.
FILTER_BITS = 1 << 23


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * MIX_A
    x = (x ^ (x >> np.uint64(29))) * MIX_B
    return x ^ (x >> np.uint64(32))


#: A number for every byte, which of them separate words, and powers of an odd base and of its inverse modulo 2^64.
BYTES = mixed(np.arange(1, 257, dtype=np.uint64) * MIX_B)
SEPARATES = np.isin(np.arange(256), [32, *range(9, 14)])
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> list[np.ndarray]:
    """The first ``n`` powers, or more; a worker keeps them."""
    if len(_powers[0]) < n:
        n = max(n, 2 * len(_powers[0]))
        for k, base in enumerate((int(MIX_A), pow(int(MIX_A), -1, 1 << 64))):
            _powers[k] = np.concatenate([np.ones(1, np.uint64), np.multiply.accumulate(np.full(n - 1, base, np.uint64))])
    return _powers


def word_hashes(text: bytes) -> np.ndarray:
    """64-bit hashes of a lower-cased text's words: a polynomial of the word's bytes, mixed with its length.

    All words of a part of the text come from one running sum, taken back to each word's start by the inverse base.
    """
    found, at = [], 0
    while at < len(text):
        end = at + PART
        while end < len(text) and not SEPARATES[text[end]]:
            end += 1  # a word isn't cut
        part = np.frombuffer(text, np.uint8)[at:end]
        at = end
        gap = np.concatenate([[True], SEPARATES[part], [True]])
        edges = np.flatnonzero(gap[1:] != gap[:-1])
        starts, ends = edges[::2], edges[1::2]
        up, down = powers(len(part))
        total = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(BYTES[part] * up[: len(part)], out=total[1:])
        found.append(mixed((total[ends] - total[starts]) * down[starts] ^ (ends - starts).astype(np.uint64)))
    return np.concatenate(found) if found else np.zeros(0, np.uint64)


def shingles(text: str, words: int) -> np.ndarray:
    """Hashes of the shingles of a text, repeats included; a text of fewer words is one shingle."""
    h = word_hashes(text.encode().lower())
    if not len(h):
        return np.zeros(0, np.int64)
    width = min(words, len(h))
    value = np.full(len(h) - width + 1, width, np.uint64)
    for i in range(width):
        value = mixed(value ^ h[i : len(h) - width + 1 + i])
    return value.view(np.int64)


def shingle_set(text: str, words: int) -> np.ndarray:
    """Sorted hashes of the distinct shingles."""
    return np.unique(shingles(text, words))


def set_hash(values: np.ndarray) -> int | None:
    return None if not len(values) else xxhash.xxh3_64_intdigest(values.tobytes()) - (1 << 63)


def sketches(rows: DataFrame, words: int, k: int) -> DataFrame:
    def sketch(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = [shingle_set(t, words) for t in batch["text"].to_pylist()]
        return pa.RecordBatch.from_arrays(
            [batch["doc_id"], pa.array([len(s) for s in sets], pa.int64()), pa.array([set_hash(s) for s in sets], pa.int64()), pa.array([s[:k] for s in sets], pa.list_(pa.int64()))],
            ["doc_id", "n_shingles", "node", "sketch"],
        )

    return map_batches(rows, sketch, SKETCHES)


def shared_values(k: int, percent: int) -> Column:
    """Values that the sketches of two nodes within the similarity share at least, given a node's ``n``.

    Up to percent of k shingles, both sets are held whole. Beyond, each value is shared with a
    chance of at least ``percent``; the bound lies five standard deviations lower.
    """
    chance = percent / 100
    sampled = int(k * chance - 5 * (k * chance * (1 - chance)) ** 0.5)
    return F.when(F.col("n") * 100 <= k * percent, F.ceil(F.col("n") * percent / 100)).otherwise(sampled)


def rare_postings(values: DataFrame, size: Column, bound: Column) -> DataFrame:
    """(v, node, n, place, central): each node in the lists of its rarest values that others share.

    ``values`` has a row (node, n, v) for each value of a node; ``size`` is how many it has, and
    ``bound`` how many it shares at least with a node that it is to meet. ``place`` is the value's
    place among the node's values in the order of rarity; those of this node alone come first.
    """
    shared = values.select("v").groupBy("v").agg(F.count("*").alias("df")).where("df > 1")
    ranked = values.join(shared, "v").groupBy("node", "n").agg(F.sort_array(F.collect_list(F.struct("df", "v"))).alias("held"))
    ranked = ranked.withColumn("alone", size - F.size("held"))
    prefix = (size - bound + 1 - F.col("alone")).cast("int")
    central = F.aggregate("held", F.lit(0).cast("long"), lambda total, x: total + x["df"])
    rows = ranked.where(prefix > 0).select("node", "n", "alone", central.alias("central"), F.posexplode(F.slice("held", F.lit(1), prefix)).alias("k", "x"))
    return rows.select("x.v", "node", "n", (F.col("alone") + F.col("k")).alias("place"), "central")


def sketch_postings(nodes: DataFrame, k: int, percent: int) -> DataFrame:
    return rare_postings(nodes.select("node", "n", F.explode("sketch").alias("v")), F.least("n", F.lit(k)), shared_values(k, percent))


def set_postings(sets: DataFrame, percent: int) -> DataFrame:
    """As ``sketch_postings``, over full sets (node, hashes): nothing is left to chance here."""

    def values(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for node, hashes in zip(batch["node"].to_pylist(), batch["hashes"].to_pylist(), strict=True):
                v = np.frombuffer(hashes, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(v), node)), pa.array(np.full(len(v), len(v))), pa.array(v)], ["node", "n", "v"])

    rows = sets.select("node", "hashes").mapInArrow(values, "node long, n long, v long")
    return rare_postings(rows, F.col("n"), F.ceil(F.col("n") * percent / 100))


def bit_place(column: str) -> Column:
    """The place of an id's bit in ``bitmap``."""
    return F.pmod(F.coalesce(F.xxhash64(column), F.lit(0)), F.lit(FILTER_BITS))


def bitmap(ids: DataFrame, column: str) -> np.ndarray:
    """A bit for the hash of every id, as FILTER_BITS / 64 words."""
    words = ids.select((bit_place(column) / 64).cast("int").alias("at"), F.expr("shiftleft(1L, int(pmod(coalesce(xxhash64(%s), 0), 64)))" % column).alias("bit")).groupBy("at").agg(F.bit_or("bit").alias("bits"))
    out = np.zeros(FILTER_BITS // 64, np.int64)
    for r in words.collect():
        out[r["at"]] = r["bits"]
    return out


def full_sets(rows: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """(node, hashes): the full sets of the wanted nodes (node, rep; rows may repeat), from another pass over their texts.

    A fixed-size bitmap keeps most other texts out of the shuffle; it only saves work, the join
    decides. Sets travel once: nodes are joined and repeated ones dropped in the same partitions.
    """
    bits = bitmap(wanted, "rep")

    def some(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch["place"].to_numpy()
            batch = batch.filter(pa.array((bits[at >> 6] >> (at & 63)) & 1 == 1))
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                sets = [shingle_set(t, words) for t in part["text"].to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array([set_hash(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], ["node", "hashes"])

    found = rows.select("doc_id", "text", bit_place("doc_id").alias("place")).mapInArrow(some, "node long, hashes binary")
    return found.join(wanted.select("node"), "node", "left_semi").dropDuplicates(["node"])


def estimate(k: int) -> Column:
    """Similarity of two nodes by the k least values of their sketches' union."""
    union = F.slice(F.array_sort(F.array_union("sketch_a", "sketch_b")), 1, k)
    return F.size(F.array_intersect(union, F.array_intersect("sketch_a", "sketch_b"))) / F.size(union)


def estimated(pairs: DataFrame, sketched: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose sketches don't rule the similarity out, five standard deviations below it, with both nodes' ``rep``."""
    chance = percent / 100
    least = chance - 5 * (chance * (1 - chance) / k) ** 0.5
    for side in ("a", "b"):
        pairs = pairs.join(sketched.select(F.col("node").alias(side), F.col("rep").alias(f"rep_{side}"), F.col("sketch").alias(f"sketch_{side}")), side)
    return pairs.where(estimate(k) >= least).select("a", "b", "rep_a", "rep_b")


def confirmed(near: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are within the similarity."""
    count = near.count()
    for side in ("a", "b"):
        near = near.join(sets.select(F.col("node").alias(side), F.col("hashes").alias(f"hashes_{side}")), side)

    def verify(batch: pa.RecordBatch) -> pa.RecordBatch:
        ok = []
        for x, y in zip(batch["hashes_a"].to_pylist(), batch["hashes_b"].to_pylist(), strict=True):
            x, y = np.frombuffer(x, np.int64), np.frombuffer(y, np.int64)
            both = len(np.intersect1d(x, y, assume_unique=True))
            ok.append(100 * both >= percent * (len(x) + len(y) - both))
        return pa.RecordBatch.from_arrays([batch["a"], batch["b"]], ["a", "b"]).filter(pa.array(ok, pa.bool_()))

    tasks = tasks_for(near.sparkSession, count, PAIRS)
    return map_batches(near.select("a", "b", "hashes_a", "hashes_b").coalesce(tasks), verify, "a long, b long")


def ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).where("a <> b").distinct()


def like_sizes(x: Column, y: Column, percent: int) -> Column:
    return F.least(x, y) * 100 >= F.greatest(x, y) * percent


def with_components(lists: DataFrame, components: DataFrame | None) -> DataFrame:
    if components is None:
        return lists.withColumn("component", F.col("node"))
    return lists.join(components, "node", "left").withColumn("component", F.coalesce("component", "node"))


def open_members(lists: DataFrame, components: DataFrame | None) -> DataFrame:
    """The members of those lists that hold several components, with their component and the list's length ``m``."""
    members = written(with_components(lists, components), "members")
    kinds = members.groupBy("v").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("m"))
    out = written(members.join(kinds.where("low <> high").select("v", "m"), "v"), "open")
    drop_written(members)
    return out


def hub_pairs(members: DataFrame, percent: int, hubs: int) -> DataFrame:
    """Members with the ``hubs`` most central ones of their list that are of like size and of another component.

    Hubs are those of a class of sizes, so that a list of texts of all lengths has hubs for each. Two
    nodes within the similarity are in the same class or in neighbours; each node meets the hubs of its
    own class and of the next lower one, which ties groups on a border together.
    """
    width = float(np.log(100 / percent)) if percent < 100 else 1.0
    rows = members.withColumn("of", F.floor(F.log("n") / width + 1e-9))
    best = F.struct("central", "node", "component", "n")
    if hubs == 1:
        chosen = rows.groupBy("v", "of").agg(F.max(best).alias("hub"))
    else:
        rank = F.row_number().over(Window.partitionBy("v", "of").orderBy(F.desc("central"), F.desc("node")))
        chosen = rows.withColumn("rank", rank).where(F.col("rank") <= hubs).select("v", "of", best.alias("hub"))
        longest = F.row_number().over(Window.partitionBy("node").orderBy(F.desc("m"), "v"))
        rows = rows.withColumn("rank", longest).where(F.col("rank") <= LISTS)
    met = rows.withColumn("of", F.explode(F.array(F.col("of") - 1, "of"))).join(chosen, ["v", "of"])
    met = met.where((F.col("component") != F.col("hub.component")) & like_sizes(F.col("n"), F.col("hub.n"), percent))
    return ordered(met.select(F.col("node").alias("x"), F.col("hub.node").alias("y")))


def remaining_pairs(rest: DataFrame, percent: int, size: Column | None = None, bound: Column | None = None) -> DataFrame:
    """All pairs of different components in the lists of ``rest`` that sizes and places don't rule out.

    From two values' places in the order of rarity follows how much two nodes may share at most:
    of their full sets, or, with ``size`` and ``bound``, of their sketches.
    """
    rest = rest.select("v", "node", "n", "component", ((F.col("n") if size is None else size) - F.col("place")).alias("ahead"), (F.lit(0) if bound is None else bound).alias("bound"))
    x, y = rest.alias("x"), rest.alias("y")
    most = F.least("x.ahead", "y.ahead")
    enough = most * (100 + percent) >= (F.col("x.n") + F.col("y.n")) * percent if bound is None else most >= F.least("x.bound", "y.bound")
    met = x.join(y, (F.col("x.v") == F.col("y.v")) & (F.col("x.component") < F.col("y.component")) & like_sizes(F.col("x.n"), F.col("y.n"), percent) & enough)
    return ordered(met.select(F.col("x.node").alias("x"), F.col("y.node").alias("y")))


def linked_nodes(rows: DataFrame, postings: DataFrame, sketched: DataFrame, words: int, k: int, percent: int) -> DataFrame:
    """(node, component) of the nodes that are linked with others."""
    tested = components = None

    def confirm(pairs: DataFrame) -> None:
        """Unite the components that the links among the pairs tie together."""
        nonlocal tested, components
        pairs = written(pairs if tested is None else pairs.join(tested, ["a", "b"], "left_anti"), "pairs")
        tested = pairs if tested is None else tested.union(pairs)
        near = written(estimated(pairs, sketched, k, percent), "near")
        if near.isEmpty():
            return
        wanted = near.select(F.col("a").alias("node"), F.col("rep_a").alias("rep")).union(near.select("b", "rep_b"))
        sets = written(full_sets(rows, wanted, words), "sets")
        new = written(confirmed(near, sets, percent), "links")
        drop_written(near, sets)
        components = connected_components(new if components is None else new.union(components))

    confirm(hub_pairs(with_components(postings, None), percent, 1))
    members = open_members(postings, components)
    confirm(hub_pairs(members.where(F.col("m") > SHORT_LIST), percent, HUBS))
    rest = open_members(members.drop("component", "m"), components)
    longer = rest.where(F.col("m") > SHORT_LIST).select("node")
    sets = written(full_sets(rows, sketched.select("node", "rep").join(longer, "node", "left_semi"), words), "sets")
    exact = open_members(set_postings(sets, percent), components)
    drop_written(members, sets)
    pairs = remaining_pairs(rest.where(F.col("m") <= SHORT_LIST), percent, F.least("n", F.lit(k)), shared_values(k, percent))
    confirm(pairs.union(remaining_pairs(exact, percent)).distinct())
    drop_written(rest, exact)
    if components is None:
        return postings.select("node", F.col("node").alias("component")).limit(0)
    return components


def near_duplicates(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    words: int = 2,
    percent: int = 80,
    k: int = 64,
) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (the least doc_id of its class), kept."""
    rows = id_text(docs, id_col, text_col)
    docs_sketched = written(sketches(rows, words, k), "sketches")
    nodes = docs_sketched.where("node IS NOT NULL").groupBy("node").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"), F.first("sketch").alias("sketch"))
    nodes = written(nodes, "nodes")
    postings = written(sketch_postings(nodes, k, percent), "postings")
    several = postings.groupBy("v").agg(F.count("*").alias("m")).where("m > 1").select("v")
    every, postings = postings, written(postings.join(several, "v"), "lists")
    drop_written(every)
    sketched = written(nodes.join(postings.select("node").distinct(), "node", "left_semi"), "candidates")
    components = linked_nodes(rows, postings, sketched, words, k, percent)
    named = nodes.select("node", "rep").join(components, "node", "left").withColumn("component", F.coalesce("component", "node"))
    names = named.groupBy("component").agg(F.min("rep").alias("component_id"))
    classes = named.join(names, "component").select("node", "component_id")
    kept = F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)).alias("kept")
    out = docs_sketched.select("doc_id", "n_shingles", "node").join(classes, "node").select("doc_id", "n_shingles", "component_id", kept)
    alone = docs_sketched.where("node IS NULL").withColumn("component_id", F.col("doc_id"))  # empty sets meet nowhere, least of all in one task
    return out.union(alone.select("doc_id", "n_shingles", "component_id", kept))
