"""Benchmark decontamination with the q-gram lemma, diagonal bands and banded alignment.

Texts and benchmark items are lower-cased, white space runs become one space, and both are compared character by character
(code points), so an edit costs the same in any script. A region matches an item of m characters if it is within
e = floor(``rate`` * m) edits of the whole item. Such a region shares at least m - q + 1 - q * e q-grams with it, on diagonals
no further apart than e. So shared q-grams are counted in overlapping bands of 2 * e diagonals, one every e; bands that reach
the bound are kept, and a banded alignment of the item with their region decides. Items too short for a positive bound get the
largest e that has one; those under q characters must occur as they are, as whole words.

Documents are read narrowly, segment by segment with overlap, so memory depends on neither a text's nor a table's size. The
benchmark goes to the workers in blocks of at most ``block_bytes``; each block is one pass over the documents.

Null and blank texts match nothing, null and blank items too; repeated rows and repeated items each report their own
matches; the same words in another row of the text's table change nothing; empty tables give no matches (and ``clean`` keeps all);
extra columns pass through ``clean`` untouched and are not read by ``matches``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Q = 10
RATE = 0.06
#: Characters of text that are looked at together.
SEGMENT = 1 << 20
BLOCK_BYTES = 4 << 20
TABLE_BITS = 22
_rng = np.random.default_rng(23)
ODD = _rng.integers(1, 1 << 63, Q // 2, dtype=np.uint64) | np.uint64(1)


def normal(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def points(text: str) -> bytes:
    return text.encode("utf-32-le", "surrogatepass")


def gram_hashes(text: str) -> np.ndarray:
    """A 64-bit hash of the Q characters at each position."""
    data, n = points(text), len(text) - Q + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    h = np.zeros(n, np.uint64)
    for k, odd in enumerate(ODD):  # two characters at a time
        h += np.ndarray((n,), "<u8", data, 8 * k, (4,)) * odd
    h ^= h >> np.uint64(29)
    h *= ODD[0]
    return h


def whole_words(text: str, item: str) -> Iterator[int]:
    """Where the item stands in the text with no letter or digit going on before or after it; of overlapping ones the first."""
    at = text.find(item)
    while at >= 0:
        z = at + len(item)
        if not (at and text[at - 1].isalnum() and item[0].isalnum()) and not (text[z : z + 1].isalnum() and item[-1].isalnum()):
            yield at
            at = text.find(item, z)
        else:
            at = text.find(item, at + 1)


def budget(m: int, rate: float) -> tuple[int, int]:
    """(e, shared q-grams at least) for an item of m characters, m >= Q."""
    e = int(rate * m)
    while e and m - Q + 1 - Q * e < 1:
        e -= 1
    return e, m - Q + 1 - Q * e


@dataclass
class Index:
    """The q-grams of a block of items."""

    ids: list[int | None]
    items: list[str]
    rate: float

    def __post_init__(self):
        long = [i for i, x in enumerate(self.items) if len(x) >= Q]
        self.short = [i for i, x in enumerate(self.items) if 0 < len(x) < Q]
        bounds = [budget(len(x), self.rate) if len(x) >= Q else (0, 1) for x in self.items]
        self.edits = np.array([e for e, _ in bounds], np.int64)
        self.shared = np.array([t for _, t in bounds], np.int64)
        self.overlap = max((len(x) + 4 * int(e) + Q for x, e in zip(self.items, self.edits)), default=0)
        hashes = [gram_hashes(self.items[i]) for i in long]
        h = np.concatenate([*hashes, np.empty(0, np.uint64)])
        item = np.repeat(np.array(long, np.int64), [len(x) for x in hashes])
        place = np.concatenate([*map(np.arange, map(len, hashes)), np.empty(0, np.int64)]).astype(np.int64)
        by = np.argsort(h, kind="stable")
        self.item, self.place = item[by], place[by]
        self.hash, self.first = np.unique(h[by], return_index=True)
        self.count = np.diff(np.append(self.first, len(by)))
        self.there = np.zeros(1 << TABLE_BITS, bool)
        self.there[self.hash >> np.uint64(64 - TABLE_BITS)] = True

    def find(self, texts: list[str]) -> Iterator[tuple[int, int, int, int, int]]:
        """(text, item, start, end, edits) of every match in normalised texts."""
        batch, size = [], 0
        seen: dict[tuple[int, int], list[tuple[int, int, int]]] = {}
        for i, t in enumerate(texts):
            for j in self.short:
                for at in whole_words(t, self.items[j]):
                    yield i, j, at, at + len(self.items[j]), 0
            for at in range(0, max(1, len(t) - self.overlap), SEGMENT):
                part = t[at : at + SEGMENT + self.overlap]
                batch.append((i, at, part))
                size += len(part)
                if size >= SEGMENT:
                    self._in(batch, seen)
                    batch, size = [], 0
        self._in(batch, seen)
        for (i, j), found in seen.items():
            for a, z, d in found:
                yield i, j, a, z, d

    def _in(self, parts: list[tuple[int, int, str]], seen: dict[tuple[int, int], list[tuple[int, int, int]]]) -> None:
        """Adds what the parts hold to ``seen``; of overlapping matches of an item, as two bands or two segments find
        them, the one with the fewest edits stays."""
        if not parts or not len(self.hash):
            return
        h = gram_hashes(("\0" * Q).join(p for _, _, p in parts) + "\0" * Q)
        at = np.flatnonzero(self.there[h >> np.uint64(64 - TABLE_BITS)])
        h = h[at]
        k = np.minimum(np.searchsorted(self.hash, h), len(self.hash) - 1)
        at, k = at[self.hash[k] == h], k[self.hash[k] == h]
        count = self.count[k]
        entry = np.repeat(self.first[k] - np.r_[0, np.cumsum(count)[:-1]], count) + np.arange(count.sum()) if len(k) else np.empty(0, np.int64)
        at = np.repeat(at, count)
        starts = np.cumsum([0] + [len(p) + Q for _, _, p in parts])
        part = np.searchsorted(starts, at, side="right") - 1
        item = self.item[entry]
        step = np.maximum(self.edits[item], 1)
        band = (at - starts[part] - self.place[entry]) // step
        # a band spans two steps: a hit is in the one that begins at its step and in the one before
        lane = np.concatenate([band, band - 1]) + (1 << 30)
        both = np.tile(part * len(self.items) + item, 2)
        order = np.lexsort((lane, both))
        both, lane = both[order], lane[order]
        fresh = np.flatnonzero(np.r_[True, (np.diff(both) != 0) | (np.diff(lane) != 0)]) if len(both) else np.empty(0, np.int64)
        n = np.diff(np.append(fresh, len(both)))
        keep = n >= self.shared[both[fresh] % len(self.items)]
        for b, x in zip(both[fresh[keep]].tolist(), (lane[fresh[keep]] - (1 << 30)).tolist()):
            p, j = divmod(b, len(self.items))
            e = int(self.edits[j])
            w = max(e, 1)
            low = max(0, x * w - e)
            region = parts[p][2][low : max(0, x * w + 2 * w + e + len(self.items[j]) + e)]
            for a, z, d in aligned(self.items[j], region, e):
                found = (parts[p][1] + low + a, parts[p][1] + low + z, d)
                near = seen.setdefault((parts[p][0], j), [])
                for q, (a2, z2, d2) in enumerate(near):
                    if found[0] < z2 and a2 < found[1]:
                        near[q] = min((a2, z2, d2), found, key=lambda f: (f[2], f[0], f[1]))
                        break
                else:
                    near.append(found)


def aligned(item: str, region: str, e: int) -> list[tuple[int, int, int]]:
    """The best (start, end, edits) of the whole item in the region, if within e edits."""
    if (at := region.find(item)) >= 0:
        return [(at, at + len(item), 0)]
    m, n = len(item), len(region)
    if not e or n < m - e:
        return []
    unit = 1 << 24  # a cell holds edits * unit + start
    text = np.frombuffer(points(region), np.uint32)
    width = max(1, n - m + 2 * e + 1)
    # cell c of row i stands for the region's prefix of length i + c - e
    prefix = np.arange(width) - e
    row = np.where((prefix >= 0) & (prefix <= n), prefix, unit * (m + 1))
    ramp = np.arange(width) * unit
    big = unit * (m + 2)
    for i, point in enumerate(map(ord, item), 1):
        j = prefix + i
        inside = (j >= 1) & (j <= n)
        same = np.zeros(width, bool)
        same[inside] = text[j[inside] - 1] == point
        step = np.where(inside, row + np.where(same, 0, unit), big)
        skip = np.append(row[1:], big) + unit
        row = np.minimum(step, np.where((j >= 0) & (j <= n), skip, big))
        row = np.minimum.accumulate(row - ramp) + ramp
        row[(j < 0) | (j > n)] = big
        if row.min() > unit * (e + 1):
            return []
    c = int(np.argmin(row // unit))
    d = int(row[c] // unit)
    return [(int(row[c] % unit), m + c - e, d)] if d <= e else []


def indexes(benchmark: DataFrame, rate: float, block_bytes: int) -> Iterator[Index]:
    """The benchmark in blocks of about ``block_bytes``; only one block is on the driver at a time."""
    items = benchmark.where("text IS NOT NULL").select("item_id", "text")
    total = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks = max(1, -(-total // block_bytes))
    for k in range(blocks):
        rows = sorted((r for r in items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k).collect()), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
        yield Index([r[0] for r in rows], [normal(r[1]) for r in rows], rate)


def matches(documents: DataFrame, benchmark: DataFrame, rate: float = RATE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row for each match: (doc_id, item_id, start, end, edits); offsets count code points of the normalised text."""
    names = ["doc_id", "item_id", "start", "end", "edits"]

    def search(index: Index) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                ids = b.column(0).to_pylist()
                found = [(ids[i], index.ids[j], a, z, d) for i, j, a, z, d in index.find([normal(t.as_py()) for t in b.column(1)])]
                columns = list(zip(*found)) or [[]] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names)

        return documents.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, item_id long, start long, end long, edits long")

    return reduce(DataFrame.unionByName, map(search, indexes(benchmark, rate, block_bytes)))


def clean(documents: DataFrame, benchmark: DataFrame, rate: float = RATE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``documents`` without the rows that match any item."""
    at = documents.columns.index("text")

    def free_of(rows: DataFrame, index: Index) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                free = np.ones(len(b), bool)
                for i, *_ in index.find([normal(t.as_py()) for t in b.column(at)]):
                    free[i] = False
                yield b.filter(pa.array(free))

        return rows.mapInArrow(run, rows.schema)

    return reduce(free_of, indexes(benchmark, rate, block_bytes), documents)
