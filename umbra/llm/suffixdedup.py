"""Exact removal of byte strings that occur in an earlier document, with suffix arrays of content-routed shards.

A byte goes if a string of ``length`` bytes that covers it also starts in a document with a smaller doc_id; strings are
judged on the input. Where a string can be repeated at all is found first, so that only that reaches a suffix array:

1. Every window of ``length`` bytes has a key, the smallest hash of the shorter grams in it; equal windows have equal
   keys. Blocks of documents send the set of their keys; a key that two blocks sent, or two documents of a block, is shared.
2. Runs of windows with one shared key are cut out. Each block sends every distinct run once, with the smallest doc_id
   that has it, to the shard of its key, so all equal windows of the corpus meet in one shard whatever their number.
3. A shard builds a suffix array over its distinct runs (Larsson-Sadakane refinement) and Kasai's common prefixes; windows
   with a common prefix of ``length`` are one string and get its smallest doc_id. A shard beyond ``shard_bytes`` is cut into
   several with arrays of their own, which are merged by binary search of one's strings in the other's array.
4. The smallest ids go back to the blocks that asked, as runs, and the blocks cut their documents.

What a task holds is bounded by the block and shard sizes and the number of blocks, not by how often a passage occurs.

Null texts count as empty. Rows without doc_id keep all bytes and remove none elsewhere; rows with equal doc_id do not remove
from each other; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .suffix import common_prefixes, suffix_array

LENGTH = 50
GRAM = 24
BLOCK_BYTES, SHARD_BYTES = 6 << 20, 4 << 20
#: Bytes whose keys are computed together.
SLICE = 1 << 20
C1, C2, C3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)
NONE = np.iinfo(np.int64).max


def _mixed(h: np.ndarray) -> np.ndarray:
    h ^= h >> np.uint64(32)
    h *= C2
    h ^= h >> np.uint64(29)
    return h


def window_keys(data: bytes) -> np.ndarray:
    """The key of the window at each position."""
    n = len(data) - LENGTH + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    grams = len(data) - GRAM + 1
    word = lambda at: np.ndarray((grams,), "<u8", data, at, (1,))
    h = _mixed(word(0) * C1 + word(8) * C2 + word(16) * C3)
    # smallest of LENGTH - GRAM + 1 neighbours, by doubling
    wanted, have = LENGTH - GRAM + 1, 1
    while have < wanted:
        step = min(have, wanted - have)
        h = np.minimum(h[: len(h) - step], h[step:])
        have += step
    return _mixed(h[:n] * C3)


class Block:
    """Documents of a block one after the other: their windows as runs of one key."""

    def __init__(self, ids: list[int | None], texts: list[str | None]):
        raw = [(t or "").encode() for t in texts]
        self.order = sorted(range(len(raw)), key=lambda i: (ids[i] is None, ids[i] or 0))
        self.ids = np.array([NONE if ids[i] is None else ids[i] for i in self.order], np.int64)
        self.data = b"".join(raw[i] for i in self.order)
        self.lengths = np.array([len(raw[i]) for i in self.order], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        named = int(self.lengths[self.ids != NONE].sum())  # documents without an id come last and take no part
        doc_ends = self.starts + self.lengths
        # where a document begins, and where the windows that still lie in it end
        bounds = np.unique(np.concatenate([self.starts, np.maximum(self.starts, doc_ends - LENGTH + 1)]))
        run_start, run_key, run_end = [], [], []
        for at in range(0, max(0, named - LENGTH + 1), SLICE):
            key = window_keys(self.data[at : min(named, at + SLICE + LENGTH - 1)])
            change = np.ones(len(key), bool)
            np.not_equal(key[1:], key[:-1], out=change[1:])
            change[bounds[np.searchsorted(bounds, at) : np.searchsorted(bounds, at + len(key))] - at] = True
            first = np.flatnonzero(change)
            run_start.append(at + first)
            run_end.append(at + np.append(first[1:], len(key)))
            run_key.append(key[first])
        join = lambda x, t: np.concatenate([*x, np.empty(0, t)]).astype(t)
        self.start, self.end, self.key = join(run_start, np.int64), join(run_end, np.int64), join(run_key, np.uint64)
        self.doc = np.searchsorted(self.starts, self.start, side="right") - 1
        inside = self.start + LENGTH <= doc_ends[self.doc] if len(self.doc) else np.empty(0, bool)
        self.start, self.end, self.key, self.doc = (x[inside] for x in (self.start, self.end, self.key, self.doc))

    def tags(self, sets: int) -> np.ndarray:
        """The set of each run's key, and 32 bits of it."""
        return ((self.key >> np.uint64(32)) % np.uint64(sets) << np.uint64(32)) | (self.key & np.uint64(0xFFFFFFFF))

    def own_shared(self, tags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct tags, and which of them two documents have."""
        by = np.argsort(tags, kind="stable")
        t, d = tags[by], self.ids[self.doc[by]]
        first = np.flatnonzero(np.r_[True, t[1:] != t[:-1]]) if len(t) else np.empty(0, np.int64)
        low, high = (f.reduceat(d, first) if len(t) else d for f in (np.minimum, np.maximum))
        return t[first], low < high

    def distinct_runs(self, shared: np.ndarray, sets: int, shards: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes]]:
        """Of the runs with a shared key, by shard: places, shards, the first place here with the same text, and the texts.

        Documents come in the order of their ids, so the first that has a text is the smallest.
        """
        tags = self.tags(sets)
        k = np.searchsorted(shared, tags)
        wanted = np.flatnonzero(shared[np.minimum(k, len(shared) - 1)] == tags) if len(shared) else np.empty(0, np.int64)
        # every shard gets whole keys: equal windows meet
        shard = (_mixed(self.key[wanted] * C1) % np.uint64(shards)).astype(np.int64)
        by = np.argsort(shard, kind="stable")
        wanted, shard = wanted[by], shard[by]
        data = self.data
        texts = [data[a:z] for a, z in zip(self.start[wanted].tolist(), (self.end[wanted] + (LENGTH - 1)).tolist())]
        first: dict[bytes, int] = {}
        return wanted, shard, np.fromiter(map(first.setdefault, texts, range(len(texts))), np.int64, len(texts)), texts


def packed(*arrays: np.ndarray) -> bytes:
    parts = [a.tobytes() for a in arrays]
    return np.array([len(p) for p in parts], np.int64).tobytes() + zstandard.ZstdCompressor(level=1).compress(b"".join(parts))


def unpacked(blob: bytes, *types: str) -> list[np.ndarray]:
    sizes = np.frombuffer(blob, np.int64, len(types))
    raw = zstandard.ZstdDecompressor().decompress(blob[8 * len(types) :]) if sizes.sum() else b""
    ends = np.cumsum(sizes)
    return [np.frombuffer(raw[e - n : e], t) for e, n, t in zip(ends, sizes, types)]


# ---- shards -------------------------------------------------------------------------------------------------------


class Shard:
    """A suffix array over distinct runs; its strings are the distinct windows in their order."""

    def __init__(self, texts: list[bytes], docs: np.ndarray):
        self.data = b"".join(texts)
        lengths = np.array([len(t) for t in texts], np.int64)
        seq = np.frombuffer(self.data, np.uint8)
        # a window that crosses two runs is none
        sa = suffix_array(seq, LENGTH, np.repeat(np.cumsum(lengths), lengths) - np.arange(len(seq)))
        first = np.flatnonzero(common_prefixes(seq, sa, LENGTH) < LENGTH)
        self.string = np.full(len(seq), -1, np.int32)
        self.string[sa] = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(sa))))
        self.place = sa[first]
        doc = np.repeat(docs, lengths)[sa]
        self.low = np.minimum.reduceat(doc, first) if len(sa) else np.empty(0, np.int64)
        self.lengths = lengths
        self.words = np.ndarray((max(0, len(self.data) - 7),), ">u8", self.data, 0, (1,))

    #: Words that hold a window between them, the last one overlapping.
    OFFSETS = (*range(0, LENGTH - 7, 8), LENGTH - 8)

    def lookup(self, other: Shard) -> np.ndarray:
        """For each string of ``other`` the place of the first own string that is not smaller, by binary search."""
        low, high = np.zeros(len(other.place), np.int64), np.full(len(other.place), len(self.place))
        while (live := np.flatnonzero(low < high)).size:
            mid = (low[live] + high[live]) // 2
            less = self.compare(mid, other, live) < 0
            low[live] = np.where(less, mid + 1, low[live])
            high[live] = np.where(less, high[live], mid)
        return low

    def compare(self, mine: np.ndarray, other: Shard, theirs: np.ndarray) -> np.ndarray:
        out = np.zeros(len(mine), np.int8)
        a, b, open_ = self.place[mine], other.place[theirs], np.arange(len(mine))
        for o in self.OFFSETS:
            x, y = self.words[a[open_] + o], other.words[b[open_] + o]
            out[open_] = np.where(x < y, -1, np.where(x > y, 1, 0))
            open_ = open_[x == y]
        return out

    def runs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Smallest ids along each text: how many stretches it has, where each starts in it, its id."""
        on = self.string >= 0
        where = np.flatnonzero(on)
        begin = np.cumsum(self.lengths) - self.lengths
        text = np.searchsorted(begin, where, side="right") - 1
        low = self.low[self.string[where]]
        first = np.flatnonzero(np.r_[True, (np.diff(low) != 0) | (np.diff(text) != 0)]) if len(where) else np.empty(0, np.int64)
        return np.bincount(text[first], minlength=len(begin)), where[first] - begin[text[first]], low[first]


def merge(shards: list[Shard]) -> None:
    """Gives equal strings of all shards the smallest id any of them has."""
    before = [s.low.copy() for s in shards]
    for i, a in enumerate(shards):
        for j, b in enumerate(shards[:i]):
            at = b.lookup(a)
            there = np.flatnonzero(at < len(b.place))
            same = there[b.compare(at[there], a, there) == 0]
            a.low[same] = np.minimum(a.low[same], before[j][at[same]])
            b.low[at[same]] = np.minimum(b.low[at[same]], before[i][same])


def smallest_ids(texts: list[bytes], docs: np.ndarray, shard_bytes: int = SHARD_BYTES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Shard.runs() of distinct texts, by as many suffix arrays as their size asks for."""
    shards, begin, size = [], 0, 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= shard_bytes or i == len(texts) - 1:
            shards.append(Shard(texts[begin : i + 1], docs[begin : i + 1]))
            begin, size = i + 1, 0
    merge(shards)
    parts = [s.runs() for s in shards]
    return tuple(np.concatenate([np.empty(0, np.int64), *(p[k] for p in parts)]).astype(np.int64) for k in range(3))


# ---- the dataflow -------------------------------------------------------------------------------------------------


def remove_repeats(documents: DataFrame, with_text: bool = False, block_bytes: int = BLOCK_BYTES, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """(doc_id, text) to (doc_id, n_bytes, n_removed, n_spans, kept_sha256), and ``kept`` binary if asked for."""
    total = documents.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks = max(1, -(-total // block_bytes))
    sets = max(1, -(-total // (8 * block_bytes)))
    # runs with a shared key are about as large as the input at most, with their ends
    shards = max(1, -(-total // shard_bytes))
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    # by text too: rows that share an id need not share a block
    by_block = rows.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks))).groupBy("block")

    def block_of(t: pa.Table) -> Block:
        return Block(t["doc_id"].to_pylist(), t["text"].to_pylist())

    def send_keys(t: pa.Table) -> pa.Table:
        b = block_of(t)
        tags, shared = b.own_shared(b.tags(sets))
        part = np.searchsorted(tags, np.arange(sets + 1, dtype=np.uint64) << np.uint64(32))
        # no message without keys: where sets outnumber the keys of a block, there are no more messages than keys
        sent = [(k, packed(tags[x:y].astype(np.uint32), shared[x:y])) for k, (x, y) in enumerate(zip(part, part[1:])) if x < y]
        return pa.table({"block": pa.array([t["block"][0].as_py()] * len(sent), pa.int64()), "key_set": pa.array([k for k, _ in sent], pa.int64()), "blob": pa.array([x for _, x in sent], pa.binary())})

    def share_keys(t: pa.Table) -> pa.Table:
        got = [unpacked(x.as_py(), "<u4", "?") for x in t["blob"]]
        keys = np.concatenate([k for k, _ in got])
        own = np.concatenate([s for _, s in got])
        by = np.argsort(keys, kind="stable")
        first = np.r_[True, np.diff(keys[by]) != 0] if len(keys) else np.empty(0, bool)
        group = np.cumsum(first) - 1
        shared = np.empty(len(keys), bool)
        shared[by] = ((np.bincount(group) > 1) | (np.bincount(group, own[by]) > 0))[group] if len(keys) else False
        ends = np.cumsum([len(k) for k, _ in got])
        back = [(i, packed(k[shared[e - len(k) : e]])) for i, (e, (k, _)) in enumerate(zip(ends, got)) if shared[e - len(k) : e].any()]
        some = t.take(pa.array([i for i, _ in back], pa.int64()))
        return pa.table({"block": some["block"], "part": some["key_set"], "blob": pa.array([x for _, x in back], pa.binary())})

    def shared_tags(t: pa.Table) -> np.ndarray:
        parts = [unpacked(x.as_py(), "<u4")[0].astype(np.uint64) | (np.uint64(s) << np.uint64(32)) for s, x in sorted(zip(t["part"].to_pylist(), t["blob"]), key=lambda p: p[0])]
        return np.concatenate([np.empty(0, np.uint64), *parts])

    def send_runs(docs: pa.Table, keys: pa.Table) -> pa.Table:
        out = {"block": [], "shard": [], "blob": []}
        if len(docs):
            b = block_of(docs)
            wanted, shard, first, texts = b.distinct_runs(shared_tags(keys), sets, shards)
            own = np.flatnonzero(first == np.arange(len(first)))
            lengths, ids = (b.end - b.start + (LENGTH - 1))[wanted[own]].astype(np.uint32), b.ids[b.doc[wanted[own]]]
            cuts = np.flatnonzero(np.diff(shard[own], prepend=-1)).tolist()
            for x, y in zip(cuts, [*cuts[1:], len(own)]):
                out["block"].append(docs["block"][0].as_py())
                out["shard"].append(int(shard[own[x]]))
                out["blob"].append(packed(lengths[x:y], ids[x:y], np.frombuffer(b"".join(map(texts.__getitem__, own[x:y].tolist())), np.uint8)))
        return pa.table({"block": pa.array(out["block"], pa.int64()), "shard": pa.array(out["shard"], pa.int64()), "blob": pa.array(out["blob"], pa.binary())})

    def judge(t: pa.Table) -> pa.Table:
        known: dict[bytes, int] = {}
        mine, asked = [], []
        for x in t["blob"]:
            lengths, ids, raw = unpacked(x.as_py(), "<u4", "<i8", "u1")
            raw, ends = raw.tobytes(), np.cumsum(lengths, dtype=np.int64)
            # each text has the number of its first place among all; places of texts that came before stay unused
            texts = [raw[a:z] for a, z in zip((ends - lengths).tolist(), ends.tolist())]
            at = sum(map(len, mine))
            mine.append(np.fromiter(map(known.setdefault, texts, range(at, at + len(texts))), np.int64, len(texts)))
            asked.append(ids)
        every = np.concatenate(mine)
        place, number = np.unique(every, return_inverse=True)
        docs = np.full(len(place), NONE)
        np.minimum.at(docs, number, np.concatenate(asked))
        mine = np.split(number, np.cumsum([len(m) for m in mine])[:-1])
        count, offset, low = smallest_ids(list(known), docs, shard_bytes)
        begin = np.cumsum(count) - count
        blobs = []
        for numbers in mine:
            n = count[numbers]
            take = np.repeat(begin[numbers] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            blobs.append(packed(n.astype(np.uint32), offset[take].astype(np.uint32), low[take]))
        return pa.table({"block": t["block"], "part": t["shard"], "blob": pa.array(blobs, pa.binary()), "answer": pa.array([True] * len(blobs))})

    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["kept"] * with_text

    def finish(docs: pa.Table, messages: pa.Table) -> pa.Table:
        out: dict[str, list] = {n: [] for n in names}
        if len(docs):
            b = block_of(docs)
            is_answer = messages["answer"].combine_chunks() if len(messages) else pa.array([], pa.bool_())
            tags = shared_tags(messages.filter(pa.compute.invert(is_answer)))
            answers = messages.filter(is_answer)
            wanted, shard, first, _ = b.distinct_runs(tags, sets, shards)
            # texts are numbered by shard in the order in which they were sent
            sent = first == np.arange(len(first))
            number = np.cumsum(sent) - 1
            begun, ended = [], []
            for s, blob in zip(answers["part"].to_pylist(), answers["blob"]):
                n, offset, low = unpacked(blob.as_py(), "<u4", "<u4", "<i8")
                n, offset = n.astype(np.int64), offset.astype(np.int64)
                here = np.arange(*np.searchsorted(shard, [s, s + 1]))
                mine = number[first[here]] - number[here[0]]
                k = n[mine]
                take = np.repeat((np.cumsum(n) - n)[mine] - (np.cumsum(k) - k), k) + np.arange(k.sum())
                who = np.repeat(wanted[here], k)
                a = b.start[who] + offset[take]
                # a stretch of windows ends where the next of its run begins
                last = np.append(np.repeat(here, k)[1:] != np.repeat(here, k)[:-1], True) if len(who) else np.empty(0, bool)
                z = np.where(last, b.end[who], np.append(a[1:], 0))
                gone = low[take] < b.ids[b.doc[who]]
                begun.append(a[gone])
                ended.append(z[gone] + LENGTH - 1)
            marks = np.zeros(len(b.data) + 1, np.int32)
            for places, sign in ((begun, 1), (ended, -1)):
                if places:
                    marks += sign * np.bincount(np.concatenate(places), minlength=len(marks)).astype(np.int32)
            on = np.cumsum(marks[:-1], dtype=np.int32) > 0
            data = np.frombuffer(b.data, np.uint8)
            for i, (s, n) in enumerate(zip(b.starts.tolist(), b.lengths.tolist())):
                gone = on[s : s + n]
                kept = data[s : s + n][~gone].tobytes()
                out["doc_id"].append(None if b.ids[i] == NONE else int(b.ids[i]))
                out["n_bytes"].append(n)
                out["n_removed"].append(n - len(kept))
                out["n_spans"].append(int(np.count_nonzero(gone[1:] & ~gone[:-1]) + bool(n and gone[0])))
                out["kept_sha256"].append(hashlib.sha256(kept).hexdigest())
                if with_text:
                    out["kept"].append(kept)
        types = [pa.int64()] * 4 + [pa.string()] + [pa.binary()] * with_text
        return pa.table({n: pa.array(out[n], t) for n, t in zip(names, types)})

    sent = by_block.applyInArrow(send_keys, "block long, key_set long, blob binary")
    shared = sent.groupBy("key_set").applyInArrow(share_keys, "block long, part long, blob binary")
    runs = by_block.cogroup(shared.groupBy("block")).applyInArrow(send_runs, "block long, shard long, blob binary")
    answers = runs.groupBy("shard").applyInArrow(judge, "block long, part long, blob binary, answer boolean")
    messages = shared.withColumn("answer", F.lit(False)).unionByName(answers)
    return by_block.cogroup(messages.groupBy("block")).applyInArrow(finish, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_text)


ORACLE = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
-- in pieces, since a substring is found from the start of its string
q AS (SELECT doc_id, q, substr(h, (2 * q + 1)::INT, 698) AS h FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2 - 49, 300)) AS q FROM d)),
k AS (SELECT doc_id, q + p AS p, substr(h, (2 * p + 1)::INT, 100) AS s FROM (SELECT doc_id, q, h, unnest(range(0, length(h) // 2 - 49)) AS p FROM q)),
m AS (SELECT s, min(doc_id) AS low FROM k GROUP BY s HAVING min(doc_id) < max(doc_id)),
c AS (SELECT doc_id, p, p - lag(p) OVER (PARTITION BY doc_id ORDER BY p) AS step FROM k JOIN m USING (s) WHERE low < doc_id),
g AS (SELECT doc_id, p, count(*) FILTER (WHERE coalesce(step, 51) > 50) OVER (PARTITION BY doc_id ORDER BY p) AS span FROM c),
r AS (SELECT doc_id, min(p) AS a, max(p) + 50 AS z FROM g GROUP BY doc_id, span),
l AS (SELECT doc_id, list(a ORDER BY a) AS a, list(z ORDER BY a) AS z, sum(z - a)::BIGINT AS gone, count(*) AS spans FROM r GROUP BY doc_id)
SELECT doc_id, (length(h) // 2)::BIGINT AS n_bytes, coalesce(gone, 0) AS n_removed, coalesce(spans, 0) AS n_spans,
  sha256(unhex(CASE WHEN gone IS NULL THEN h ELSE array_to_string(list_transform(range(0, len(a) + 1), lambda i:
    substr(h, (2 * (CASE WHEN i = 0 THEN 0 ELSE z[i] END) + 1)::INT, (2 * ((CASE WHEN i = len(a) THEN length(h) // 2 ELSE a[i + 1] END) - (CASE WHEN i = 0 THEN 0 ELSE z[i] END)))::INT)), '') END)) AS kept_sha256
FROM d LEFT JOIN l USING (doc_id)
"""
