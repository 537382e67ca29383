"""SimHash near-duplicates: fingerprints, BK-trees over shards of them, and components of the links.

Fingerprint: bit i is set if it is set in more than half of the XXH64 hashes (seed 42) of the text's word shingles.
Two fingerprints link at ``radius`` or fewer differing bits. Links are found between *distinct* fingerprints, so a
group of exact copies is one row whatever its size.

Shards: the 64 bits are cut into radius + 1 pieces; linked fingerprints agree on one piece at least, and a shard
holds the fingerprints that agree on a piece. Every shard gets a BK-tree (children keyed by their Hamming distance to
the parent); each of its members is looked up and follows only edges within the radius of its own distance. All
trees of a batch are built and searched level by level in numpy. Where a shard has over ``shard_limit`` members (values with
many near copies), the bits on which they need not agree are cut into pieces in turn, and its members go to the finer shards
of those that agree on one of these too, down to ``FREE`` open bits. A tree stands in the task that has its shard: fingerprints
grow with the input, so they are not broadcast.

Null, empty and blank texts have fingerprint zero and are linked like any other; ties and repeated rows are in one
component; texts of any length are hashed in blocks of shingles; an empty table gives no rows; columns other than
doc_id and text are not read. Null ids are left out of the links and get no component.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import components, cut

SEED = 42
#: Shingles hashed at once; 64 bytes of bits each.
BLOCK = 1 << 16


def fingerprint(text: str | None, words_in_shingle: int = 3) -> int:
    """bytes.lower and bytes.split work on ASCII only: A-Z, and \\x20 and \\x09-\\x0D."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    k = min(words_in_shingle, len(words))
    first, last = starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist()
    ones = np.zeros(64, np.int64)
    for at in range(0, len(first), BLOCK):
        h = np.array([xxh64_intdigest(joined[a:b], SEED) for a, b in zip(first[at : at + BLOCK], last[at : at + BLOCK])], dtype="<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * ones > len(first), bitorder="little")
    return int.from_bytes(bits.tobytes(), "little")


def fingerprints(documents: DataFrame, words_in_shingle: int = 3) -> DataFrame:
    """(doc_id, text) to (doc_id, fp): the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([fingerprint(t.as_py(), words_in_shingle) for t in b.column(1)], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp.view(np.int64))], ["doc_id", "fp"])

    return documents.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, fp long")


class BKForest:
    """BK-trees of many shards at once. Values must be distinct within a shard."""

    def __init__(self, shard: np.ndarray, value: np.ndarray):
        """shard: an integer for each value. Nodes are positions of ``value``."""
        self.value = value
        n = len(value)
        self.children_of = np.empty(0, np.int64)  # parent * 65 + distance, sorted
        self.child = np.empty(0, np.int64)
        order = np.argsort(shard, kind="stable")
        fresh = np.r_[True, np.diff(shard[order]) != 0] if n else np.empty(0, bool)
        roots = order[fresh]
        self.root = np.empty(n, np.int64)
        self.root[order] = roots[np.cumsum(fresh) - 1] if n else 0
        waiting, parent = order[~fresh], self.root[order[~fresh]]
        keys, nodes = [], []
        while len(waiting):
            d = np.bitwise_count(value[waiting] ^ value[parent]).astype(np.int64)
            key = parent * 65 + d
            by = np.argsort(key, kind="stable")
            waiting, key = waiting[by], key[by]
            first = np.r_[True, np.diff(key) != 0]
            keys.append(key[first])
            nodes.append(waiting[first])
            parent = waiting[first][np.cumsum(first) - 1][~first]
            waiting = waiting[~first]
        if keys:
            keys, nodes = np.concatenate(keys), np.concatenate(nodes)
            by = np.argsort(keys)
            self.children_of, self.child = keys[by], nodes[by]

    def links(self, radius: int, block: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of positions (query, other), query > other, of one shard within ``radius``."""
        for at in range(0, len(self.value), block):
            query = np.arange(at, min(at + block, len(self.value)))
            node = self.root[query]
            while len(query):
                d = np.bitwise_count(self.value[query] ^ self.value[node]).astype(np.int64)
                near = (d <= radius) & (query > node)
                if near.any():
                    yield query[near], node[near]
                low = np.searchsorted(self.children_of, node * 65 + np.maximum(d - radius, 0))
                high = np.searchsorted(self.children_of, node * 65 + np.minimum(d + radius, 64), side="right")
                count = high - low
                query = np.repeat(query, count)
                node = self.child[np.repeat(low - np.r_[0, np.cumsum(count)[:-1]], count) + np.arange(count.sum())]


ALL = (1 << 64) - 1
#: A shard with so few open bits, which is 2 ** FREE values at most, is cut no finer.
FREE = 14


def pieces(mask: int, n: int) -> list[int]:
    """The bits of a mask cut into n masks."""
    bits = [i for i in range(64) if mask >> i & 1]
    cuts = [round(len(bits) * i / n) for i in range(n + 1)]
    return [sum(1 << i for i in bits[a:b]) for a, b in zip(cuts, cuts[1:])]


def signed(mask: int) -> Column:
    return F.lit(mask - (1 << 64) if mask >> 63 else mask).cast("long")


def links(distinct: DataFrame, radius: int = 2, shard_limit: int = 2048, packs: int = 64) -> DataFrame:
    """Distinct (fp, node) to links (a, b) of nodes within ``radius`` bits.

    ``packs``: groups of shards; each is one Python call.
    """

    def trees(pdf: pd.DataFrame) -> pd.DataFrame:
        shard = pdf.groupby(["mask", "part"], sort=False).ngroup().to_numpy()
        node = pdf["node"].to_numpy()
        found = BKForest(shard, pdf["fp"].to_numpy().astype(np.int64).view(np.uint64)).links(radius)
        return pd.concat([*(pd.DataFrame({"a": node[q], "b": node[o]}) for q, o in found), pd.DataFrame({"a": [], "b": []}, dtype=np.int64)])

    masks, levels = pieces(ALL, radius + 1), []
    rows = distinct.select("fp", "node", F.explode(F.array(*map(signed, masks))).alias("mask"))
    while True:
        keyed = rows.withColumn("part", F.col("fp").bitwiseAND(F.col("mask")))
        sizes = keyed.groupBy("mask", "part").agg(F.count("*").alias("size")).where("size > 1")
        sharded = keyed.join(sizes, ["mask", "part"])
        finest = all(64 - m.bit_count() <= FREE for m in masks)
        levels.append(sharded if finest else sharded.where(F.col("size") <= shard_limit))
        crowded = None if finest else cut(sharded.where(F.col("size") > shard_limit).select("fp", "node", "mask"))
        if crowded is None or crowded.isEmpty():
            break
        finer = {m: [m | p for p in pieces(ALL & ~m, radius + 1)] for m in masks}
        of = F.create_map(*chain.from_iterable((signed(m), F.array(*map(signed, x))) for m, x in finer.items()))
        rows = crowded.select("fp", "node", F.explode(of[F.col("mask")]).alias("mask"))
        masks = [x for made in finer.values() for x in made]
    every = reduce(DataFrame.union, [level.select("fp", "node", "mask", "part") for level in levels])
    # shards of a few members are packed together, so that a Python call has many of them
    packed = every.withColumn("pack", F.pmod(F.xxhash64("mask", "part"), F.lit(packs)))
    return packed.groupBy("pack").applyInPandas(trees, "a long, b long").distinct()


#: Distinct fingerprints for each group of shards, so that a group stays a few MB at any size of the input.
IN_PACK = 8192


def near_duplicates(documents: DataFrame, words_in_shingle: int = 3, radius: int = 2, shard_limit: int = 2048) -> DataFrame:
    """(doc_id, text) to (doc_id, fp long, component_id)."""
    fps = cut(fingerprints(documents, words_in_shingle))
    distinct = fps.groupBy("fp").agg(F.min("doc_id").alias("node")).where("node IS NOT NULL")
    linked = components(links(distinct, radius, shard_limit, max(64, distinct.count() // IN_PACK)))
    roots = distinct.join(linked, "node", "left").select("fp", F.coalesce("root", "node").alias("component_id"))
    return fps.join(roots, "fp", "left").select("doc_id", "fp", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))
