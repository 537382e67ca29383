"""Groups of similar texts for the corpus pipeline: Jaccard of ``least`` or more between sets of word shingles.

At that similarity SimHash fingerprints of 64 bits differ in some eight bits, those of short texts in over 18, which is too far for
shards by equal bits (``simhash.links``) and no bound. Here a shard is what agrees on one of ``BANDS`` combinations of ``ROWS`` smallest hashes of
the shingle set; a pair at 0.8 misses all of them with a probability of 1e-5. In each shard the exact
Jaccard of the whole sets decides on every pair whose sizes allow it. Equal sets count once. Shards of more than ``shard_limit``
different sets, as templates or a passage copied with many small changes make, get the whole sets instead: ``forest`` finds
links that connect whatever pairs of similar sets connect, without listing the pairs. Shards beyond ``CROWD`` sets or ``CROWD_HASHES``
hashes are dealt into blocks, and each two blocks are linked together, so all pairs meet and no task holds more than two blocks.

With ``radius``, texts are first linked by SimHash: fingerprints of 3-word shingles within so many bits, found by the BK-trees of
``simhash``. These links count as they are; pairs of sets that they connect need no look at their Jaccard any more, and all others get it.

Words and normal form as in ``simhash``. Texts without words are one group; texts with fewer words than a shingle are one shingle. Null
ids are in no group and are kept by ``representatives``; rows of one id are one document only where their texts are similar; an empty table gives no rows; other
columns are untouched.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import simhash
from .common import components, cut

BANDS, ROWS = 16, 3
#: Members of a crowded shard that are held against all others before the rest is looked up.
HUBS = 16
CROWD, CROWD_HASHES = 4096, 2 << 20
SEED = 42
IN_PACK = 16_384


def shingles(text: str | None, k: int) -> np.ndarray:
    """Sorted distinct hashes of the k-word shingles."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode().lower().split()
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.r_[0, ends[:-1] + 1]
    k = min(k, len(words))
    pairs = zip(starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist())
    return np.unique(np.fromiter((xxh64_intdigest(joined[a:b], SEED) for a, b in pairs), np.uint64, len(words) - k + 1))


_rng = np.random.default_rng(11)
FACTORS = _rng.integers(1, 1 << 63, BANDS * ROWS, dtype=np.uint64) | np.uint64(1)
SHIFT = np.uint64(29)


def sketch(h: np.ndarray) -> np.ndarray:
    """Band keys of a set of hashes."""
    low = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(h), 1 << 13):
        part = h[at : at + (1 << 13)]
        spread = part[None, :] * FACTORS[:, None]
        spread ^= spread >> SHIFT
        low = np.minimum(low, (spread * FACTORS[::-1, None]).min(axis=1))
    mixed = low.reshape(BANDS, ROWS)
    keys = (mixed * FACTORS[:ROWS]).sum(axis=1, dtype=np.uint64)
    return keys.view(np.int64)


def sketches(documents: DataFrame, k: int, marked: bool = False) -> DataFrame:
    """(doc_id, text) to (doc_id, same, digest, n, keys, fp), same a hash of the text as it is, n the size of the set, fp null
    unless ``marked``."""
    import xxhash

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            digests, sizes, keys, marks = [], [], [], []
            for t in b.column(1):
                h = shingles(t.as_py(), k)
                digests.append(xxhash.xxh128_digest(h.tobytes()))
                sizes.append(len(h))
                keys.append(sketch(h))
                marks.append(simhash.fingerprint(t.as_py()) if marked else None)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, BANDS * len(keys) + 1, BANDS), pa.int32()), pa.array(np.concatenate([*keys, np.empty(0, np.int64)])))
            fp = pa.array(np.array(marks, np.uint64).view(np.int64)) if marked else pa.nulls(len(b), pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(digests, pa.binary()), pa.array(sizes, pa.int64()), lists, fp], ["doc_id", "same", "digest", "n", "keys", "fp"])

    named = documents.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long"), "text", F.xxhash64("text"))
    return named.mapInArrow(run, "doc_id long, same long, digest binary, n long, keys array<long>, fp long")


def forest(sets: list[np.ndarray], least: float) -> list[tuple[int, int]]:
    """Pairs of positions at ``least`` or more that connect all that pairs at ``least`` connect, one fewer than there are sets at most.

    A few hubs are held against all sets, which makes one group of what was copied from one text; then each set outside the
    largest group is. Overlaps are exact: hashes that many sets have are bits of a row, the others have lists of their sets.
    """
    n, length = len(sets), np.array([len(x) for x in sets], np.int64)
    hashes = np.concatenate([np.empty(0, np.uint64), *sets])
    by = np.argsort(hashes, kind="stable").astype(np.int32)
    hashes = hashes[by]
    first = np.r_[True, hashes[1:] != hashes[:-1]] if len(hashes) else np.empty(0, bool)
    del hashes
    token = np.empty(len(by), np.int32)
    token[by] = np.cumsum(first, dtype=np.int32) - 1
    owner = np.repeat(np.arange(n, dtype=np.int32), length)
    lists = np.flatnonzero(first)
    count, who = np.diff(np.append(lists, len(by))), owner[by]
    often = count * 16 > n
    column = np.cumsum(often) - 1
    words = np.zeros((-(-int(often.sum()) // 64), n), np.uint64)  # by word, then set
    there = np.flatnonzero(often[token])
    np.bitwise_or.at(words, (column[token[there]] >> 6, owner[there]), np.uint64(1) << (column[token[there]] & 63).astype(np.uint64))
    end = np.cumsum(length)
    group, out = np.arange(n), []

    def link(x: int) -> None:
        """Joins x with the sets of other groups that are similar to it."""
        own = token[end[x] - length[x] : end[x]]
        own = own[~often[own]]
        size = count[own]
        both = np.bincount(who[np.repeat(lists[own] - np.cumsum(size) + size, size) + np.arange(size.sum())], minlength=n)
        for row in words[words[:, x] != 0]:
            both += np.bitwise_count(row & row[x])
        near = np.flatnonzero((both >= least * (length + length[x] - both) - 1e-9) & (both > 0) & (group != group[x]))
        found, first = np.unique(group[near], return_index=True)
        out.extend((x, y) for y in near[first].tolist())
        group[np.isin(group, found)] = group[x]

    alone = np.ones(n, bool)
    for _ in range(HUBS):
        if alone.any():
            hub = int(np.argmax(alone))
            link(hub)
            alone &= group != group[hub]
    for x in np.flatnonzero(group != np.bincount(group).argmax()).tolist() if n else ():
        link(x)
    return out


def shard_pairs(shard: np.ndarray, n: np.ndarray, least: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of positions of one shard whose sizes ``n`` allow ``least``."""
    by = np.argsort(shard, kind="stable")
    shard, n, last = shard[by], n[by], np.searchsorted(shard[by], shard[by], side="right")
    for step in range(1, int((last - np.arange(len(by))).max(initial=1))):
        a = np.flatnonzero(np.arange(len(by)) + step < last)
        a = a[np.minimum(n[a], n[a + step]) >= least * np.maximum(n[a], n[a + step]) - 1e-9]
        yield by[a], by[a + step]


def shards(sets: DataFrame) -> DataFrame:
    """Distinct (node, n, keys) to the members (node, n, band, key) of shards of two or more, with the shard's size and hashes."""
    spread = sets.select("node", "n", F.posexplode("keys").alias("band", "key"))
    shared = spread.groupBy("band", "key").agg(F.count("*").alias("size"), F.sum("n").alias("held")).where("size > 1")
    return spread.join(shared, ["band", "key"])


def candidate_pairs(members: DataFrame, least: float, packs: int) -> DataFrame:
    """Members of shards to pairs (a, b) with a > b."""

    def run(t: pa.Table) -> pa.Table:
        node, n = t["node"].to_numpy(), t["n"].to_numpy()
        key = t["key"].to_numpy() * np.int64(31) + t["band"].to_numpy()
        shard = np.unique(key, return_inverse=True)[1]
        got = [(node[x], node[y]) for x, y in shard_pairs(shard, n, least)]
        a, b = (np.concatenate([np.empty(0, np.int64), *(g[k] for g in got)]) for k in range(2))
        pairs = np.unique(np.stack([np.maximum(a, b), np.minimum(a, b)], 1)[a != b], axis=0)
        return pa.table({"a": pa.array(pairs[:, 0], pa.int64()), "b": pa.array(pairs[:, 1], pa.int64())})

    packed = members.withColumn("pack", F.pmod(F.xxhash64("band", "key"), F.lit(packs)))
    return packed.select("pack", "node", "n", "band", "key").groupBy("pack").applyInArrow(run, "a long, b long").distinct()


def crowd_links(members: DataFrame, named: DataFrame, documents: DataFrame, k: int, least: float) -> DataFrame:
    """Members of crowded shards to verified links (a, b) that connect what is similar in each shard."""
    blocks = F.greatest(F.ceil(F.col("size") / CROWD), F.ceil(F.col("held") / CROWD_HASHES))
    dealt = members.select("node", "band", "key", blocks.alias("blocks")).withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")))
    met = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    met = met.select("node", "band", "key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))

    def run(t: pa.Table) -> pa.Table:
        node = t["node"].to_numpy()
        got = forest([np.frombuffer(x.as_py(), np.uint64) for x in t["hashes"]], least)
        return pa.table({name: pa.array([node[p[c]] for p in got], pa.int64()) for c, name in enumerate("ab")})

    whole = met.join(hashed_sets(named.join(members.select("node").distinct(), "node", "left_semi"), documents, k), "node")
    return whole.groupBy("band", "key", "i", "j").applyInArrow(run, "a long, b long")


def hashed_sets(nodes: DataFrame, documents: DataFrame, k: int) -> DataFrame:
    """(node, doc_id, same) to (node, hashes): whole sets; only the texts of these are read again."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([shingles(t.as_py(), k).tobytes() for t in b.column(1)], pa.binary())], ["node", "hashes"])

    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("same")).join(nodes, ["doc_id", "same"])
    return texts.dropDuplicates(["doc_id", "same"]).select("node", "text").mapInArrow(hashed, "node long, hashes binary")


def verified(pairs: DataFrame, named: DataFrame, documents: DataFrame, k: int, least: float) -> DataFrame:
    """The pairs whose whole sets reach ``least``; only texts of candidates are read again."""
    wanted = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    sets = hashed_sets(named.join(wanted, "node", "left_semi"), documents, k)

    def alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for x, y in zip(b.column(2), b.column(3)):
                p, q = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                both = len(np.intersect1d(p, q, assume_unique=True)) if min(len(p), len(q)) >= least * max(len(p), len(q)) else 0
                keep.append(both >= least * (len(p) + len(q) - both) - 1e-9)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("hashes").alias("x")), "a").join(sets.select(F.col("node").alias("b"), F.col("hashes").alias("y")), "b")
    return both.select("a", "b", "x", "y").mapInArrow(alike, "a long, b long")


def fingerprint_links(found: DataFrame, sets: DataFrame, radius: int) -> DataFrame:
    """Texts and their sets to (node, root): components of the fingerprints within ``radius``. A set is in the one of any text that has it."""
    marked = cut(found.select("digest", "fp").distinct().join(sets.select("digest", "node"), "digest").select("node", "fp"))
    distinct = cut(marked.groupBy("fp").agg(F.min("node").alias("first")))
    near = simhash.links(distinct.select("fp", F.col("first").alias("node")), radius, packs=max(64, distinct.count() // simhash.IN_PACK))
    return components(near.union(marked.join(distinct, "fp").select("node", "first")))


def grouped(documents: DataFrame, k: int, least: float, shard_limit: int, radius: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Documents as (doc_id, digest), and their sets as (digest, root, doc_id, same): the first text that has the set."""
    found = cut(sketches(documents, k, radius is not None))
    sets = found.groupBy("digest").agg(F.min(F.struct("doc_id", "same")).alias("f"), F.min_by(F.struct("n", "keys"), "doc_id").alias("s"))
    sets = cut(sets.select(F.monotonically_increasing_id().alias("node"), "digest", "f.doc_id", "f.same", "s.n", "s.keys"))
    members, named = shards(sets), sets.select("node", "doc_id", "same")
    pairs = candidate_pairs(members.where(F.col("size") <= shard_limit), least, max(64, BANDS * sets.count() // IN_PACK))
    known = None
    if radius is not None:
        known = cut(fingerprint_links(found, sets, radius))
        a, b = (known.select(F.col("node").alias(c), F.col("root").alias(f"root_{c}")) for c in "ab")
        pairs = pairs.join(a, "a", "left").join(b, "b", "left").where("root_a IS NULL OR root_b IS NULL OR root_a <> root_b").select("a", "b")
    crowded = cut(members.where(F.col("size") > shard_limit))
    links = verified(cut(pairs), named, documents, k, least)
    if not crowded.isEmpty():
        links = links.union(crowd_links(crowded, named, documents, k, least))
    linked = components(links if known is None else links.union(known))
    return found.select("doc_id", "digest"), sets.join(linked, "node", "left").select("digest", F.coalesce("root", "node").alias("root"), "doc_id", "same")


def groups(documents: DataFrame, k: int = 5, least: float = 0.8, shard_limit: int = 128, radius: int | None = None) -> DataFrame:
    """(doc_id, text) to (doc_id, group): the smallest doc_id reachable over pairs of similar texts."""
    found, sets = grouped(documents, k, least, shard_limit, radius)
    lowest = sets.groupBy("root").agg(F.min("doc_id").alias("group"))
    return found.join(sets.select("digest", "root").join(lowest, "root"), "digest").select("doc_id", "group")


def representatives(documents: DataFrame, k: int = 5, least: float = 0.8, shard_limit: int = 128, radius: int | None = None) -> DataFrame:
    """``documents`` without all but one row of each group, one of its smallest doc_id."""
    _, sets = grouped(documents, k, least, shard_limit, radius)
    kept = sets.groupBy("root").agg(F.min(F.struct("doc_id", "same")).alias("f")).select("f.doc_id", F.col("f.same").alias("__same"))
    named = documents.where("doc_id IS NOT NULL").withColumn("__same", F.xxhash64("text"))
    named = named.join(kept, ["doc_id", "__same"], "left_semi").dropDuplicates(["doc_id", "__same"])
    return named.select(*documents.columns).union(documents.where("doc_id IS NULL"))
