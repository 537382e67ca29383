"""Byte-level BPE encoding and decoding with the ranks of a public tokenizer.

Texts of more than ``LONG`` characters become rows of overlapping chunks, which go to as many tasks as there are and are
pre-tokenised and merged there in parallel; a text's chunks are then stitched where the pre-token boundaries of neighbours
resynchronise (``pretoken``), which only cuts and joins lists of ids. Equal long texts are encoded once, and the task that stitches
one also makes the result columns from its ids, so no task has two Python workers at once. Other texts are one
chunk, and stay where they are read. Pieces are merged by the library's routine, each distinct short one once per worker, and
decoding concatenates the raw bytes of the ids. A lost task repeats only its own rows.

Null texts count as empty and give no ids; ids of other rows do not depend on ties or repeated rows; an empty table gives no rows;
other columns are not read by ``digests`` and pass through ``encode``, whatever their names.
"""

from __future__ import annotations

import base64
import functools
import hashlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .pretoken import UNSURE, chunk_starts, splitter, stitched

#: Distinct pieces that a worker remembers, and the longest that it remembers.
CACHE, LONGEST = 60_000, 64
#: Characters of a chunk of a long text, and how far it reaches into the next.
LONG, OVERLAP = 32_768, 512


class _Pieces(dict):
    """Pre-token to its ids."""

    def __init__(self, core):
        super().__init__()
        self.core = core

    def __missing__(self, piece: str) -> tuple[int, ...]:
        ids = tuple(self.core.encode_single_piece(piece.encode()))
        if len(piece) <= LONGEST:
            if len(self) >= CACHE:
                self.clear()
            self[piece] = ids
        return ids


@functools.lru_cache(maxsize=2)
def token_bytes(ranks_path: str) -> list[bytes]:
    """The bytes of each id; ids that the file leaves out have none."""
    with open(ranks_path, "rb") as f:
        ranks = {int(i): base64.b64decode(b) for b, i in map(bytes.split, f)}
    return [ranks.get(i, b"") for i in range(max(ranks) + 1)]


def decoded(ids: list[int], raw: list[bytes]) -> bytes:
    return b"".join(map(raw.__getitem__, ids))


class Codec:
    def __init__(self, ranks_path: str, pattern: str):
        import tiktoken

        self.raw = token_bytes(ranks_path)
        self.library = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks={b: i for i, b in enumerate(self.raw) if b}, special_tokens={})
        self.pieces = splitter(pattern)
        self.ids_of = _Pieces(self.library._core_bpe)

    def encode(self, text: str | None) -> list[int]:
        text = text or ""
        if UNSURE.search(text):
            return self.library.encode_ordinary(text)
        return list(chain.from_iterable(map(self.ids_of.__getitem__, self.pieces(text))))

    def decode(self, ids: list[int]) -> bytes:
        return decoded(ids, self.raw)


@functools.lru_cache(maxsize=2)
def codec(ranks_path: str, pattern: str) -> Codec:
    return Codec(ranks_path, pattern)


def small(batches: Iterator[pa.RecordBatch], rows: int = 128) -> Iterator[pa.RecordBatch]:
    """Slices of the batches: ids take several times the memory of their text."""
    for b in batches:
        for at in range(0, len(b), rows):
            yield b.slice(at, rows)


def long_ids(texts: DataFrame, ranks_path: str, pattern: str, made, out: T.StructType, long: int, overlap: int) -> DataFrame:
    """Texts (text) of any length to (key binary, columns of ``out``): what ``made`` makes of the ids of each distinct text, under the
    hash of its bytes."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for x in b.column(0):
                text = x.as_py()
                starts = chunk_starts(len(text), long)
                parts = [text[at : at + long + overlap] for at in starts]
                yield pa.RecordBatch.from_arrays([pa.array([key_of(text)] * len(parts), pa.binary()), pa.array(starts, pa.int64()), pa.array(parts, pa.string())], ["key", "start", "part"])

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(ranks_path, pattern)
        for b in small(batches, 8):
            lengths, counts, ids = [], [], []
            for x in b.column(2):
                found = [] if UNSURE.search(x.as_py()) else c.pieces(x.as_py())
                made = [c.ids_of[p] for p in found]
                lengths.append(np.array([len(p) for p in found], np.uint32).tobytes())
                counts.append(np.array([len(m) for m in made], np.uint32).tobytes())
                ids.append(np.fromiter(chain.from_iterable(made), np.int32).tobytes())
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(x, pa.binary()) for x in (lengths, counts, ids))], ["key", "start", "part", "lengths", "counts", "ids"])

    def join(t: pa.Table) -> pa.Table:
        t = t.sort_by("start")
        starts = t["start"].to_pylist()
        lengths, counts, ids = ([np.frombuffer(x.as_py(), kind) for x in t[name]] for name, kind in (("lengths", np.uint32), ("counts", np.uint32), ("ids", np.int32)))
        taken = stitched(starts, lengths, overlap) if all(map(len, lengths)) else None
        if taken is None:  # neighbours never agree, or the library alone knows its characters: the text is encoded as one
            text = "".join(x.as_py()[:long] for x in t["part"])
            whole = np.array(codec(ranks_path, pattern).encode(text), np.int32)
        else:
            ends = [np.cumsum(np.append(0, n)) for n in counts]
            whole = np.concatenate([x[e[a] : e[z]] for x, e, (a, z) in zip(ids, ends, taken)])
        return pa.Table.from_arrays([t["key"][:1], *made([whole])], ["key", *out.names])

    rows = texts.mapInArrow(cut, "key binary, start long, part string").groupBy("key", "start").agg(F.first("part").alias("part"))
    merged = rows.mapInArrow(pieces, "key binary, start long, part string, lengths binary, counts binary, ids binary")
    return merged.groupBy("key").applyInArrow(join, T.StructType([T.StructField("key", T.BinaryType()), *out.fields]))


def key_of(text: str) -> bytes:
    return hashlib.sha256(text.encode()).digest()


def with_ids(df: DataFrame, ranks_path: str, pattern: str, text: str, made, out: T.StructType, long: int, overlap: int) -> DataFrame:
    """``df`` with the columns of ``out`` in place of a text: what ``made`` makes of a list of arrays of ids, one for each row."""
    others = [f for f in df.schema.fields if f.name != text]
    rows = df.select(F.struct(*[f"`{f.name.replace('`', '``')}`" for f in others]).alias("o") if others else F.struct(F.lit(1).alias("_")).alias("o"), F.col(text).alias("t"))
    is_long = F.coalesce(F.length("t") > long, F.lit(False))
    own = T.StructType([T.StructField(f"__made{i}", f.dataType) for i, f in enumerate(out.fields)])
    names = [*(f.name for f in others), *out.names]

    def here(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(ranks_path, pattern)
        for b in small(batches):
            ids = [np.array(c.encode(t.as_py()), np.int32) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([*b.column(0).flatten()[: len(others)], *made(ids)], names)

    long_rows = rows.where(is_long)
    ids = long_ids(long_rows.select("t"), ranks_path, pattern, made, own, long, overlap)
    joined = long_rows.select("o", F.unhex(F.sha2("t", 256)).alias("__key")).join(ids.withColumnRenamed("key", "__key"), "__key")
    return rows.where(~is_long).mapInArrow(here, T.StructType([*others, *out.fields])).union(joined.select(*["o.*"] * bool(others), *own.names))


def encode(df: DataFrame, ranks_path: str, pattern: str, text: str = "text", ids: str = "token_ids", raw: str | None = None, long: int = LONG, overlap: int = OVERLAP) -> DataFrame:
    """``df`` with ``text`` replaced by its ids under the name ``ids``, and by the bytes that these decode to under ``raw`` if asked for."""
    others = [c for c in df.columns if c not in (text, ids, raw)]
    out = T.StructType([T.StructField(ids, T.ArrayType(T.IntegerType())), *([T.StructField(raw, T.BinaryType())] if raw else [])])

    def made(rows: list[np.ndarray]) -> list[pa.Array]:
        ends = np.cumsum([0, *map(len, rows)]).astype(np.int32)
        columns = [pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*rows, np.empty(0, np.int32)])))]
        if raw:
            table = token_bytes(ranks_path)
            columns.append(pa.array([decoded(x.tolist(), table) for x in rows], pa.binary()))
        return columns

    return with_ids(df.select(*others, text), ranks_path, pattern, text, made, out, long, overlap)


def decode(df: DataFrame, ranks_path: str, ids: str = "token_ids", raw: str = "decoded") -> DataFrame:
    """``df`` with the bytes of ``ids`` in a new column ``raw``; null ids decode to no bytes."""
    others = [c for c in df.columns if c != raw]
    out = T.StructType([*df.select(*others).schema.fields, T.StructField(raw, T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = token_bytes(ranks_path)
        for b in small(batches):
            made = pa.array([decoded(x.values.tolist() if x.is_valid else [], table) for x in b.column(others.index(ids))], pa.binary())
            yield pa.RecordBatch.from_arrays([*b.columns, made], [*others, raw])

    return df.select(*others).mapInArrow(run, out)


@functools.lru_cache(maxsize=2)
def decimals(ranks_path: str) -> list[str]:
    return [str(i) for i in range(len(token_bytes(ranks_path)))]


def digests(documents: DataFrame, ranks_path: str, pattern: str, long: int = LONG, overlap: int = OVERLAP) -> DataFrame:
    """(doc_id, text) to (doc_id, n_tokens, ids_sha256, decoded_sha256), encoded and decoded again."""

    def made(rows: list[np.ndarray]) -> list[pa.Array]:
        table, decimal = token_bytes(ranks_path), decimals(ranks_path)
        n, ids_sha, raw_sha = [], [], []
        for x in rows:
            ids = x.tolist()
            n.append(len(ids))
            ids_sha.append(hashlib.sha256(",".join(map(decimal.__getitem__, ids)).encode()).hexdigest())
            raw_sha.append(hashlib.sha256(decoded(ids, table)).hexdigest())
        return [pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(raw_sha, pa.string())]

    out = T.StructType([T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])
    return with_ids(documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), ranks_path, pattern, "text", made, out, long, overlap)
