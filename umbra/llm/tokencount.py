"""Token counts with a whole-token shortcut.

Offline proof: every vocabulary string is run through the merge routine alone, once, before any text is read; those that
come back as exactly one token are *proven*, and the list of them (no longer than the vocabulary) goes with the tasks. A pre-token
that is a proven string counts as one without merging; only the rest is merged, each distinct short one once per worker. Special
strings inside a text are one token each and end the pre-tokens on either side, as the library does by default.

Null texts count as empty (0 bytes, 0 tokens); texts of any length are read whole; repeated rows are each counted; an empty table gives
no rows. The pass is narrow and keeps every row; other columns are not read.
"""

from __future__ import annotations

import functools
import json
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .pretoken import UNSURE, splitter

#: The split of byte-level vocabularies of this family, as their files name it (ByteLevel with use_regex).
BYTE_LEVEL_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
CACHE, LONGEST = 100_000, 64


def byte_letters() -> dict[int, str]:
    """The printable letter of each byte: itself where printable Latin-1, else the next from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {b: chr(b) for b in own} | {b: chr(0x100 + i) for i, b in enumerate(rest)}


class Counter(dict):
    """Pre-token to its number of tokens; it begins with the proven strings, which are proved here unless they are given."""

    def __init__(self, path: str, proven: list[str] | None = None):
        from tokenizers import Tokenizer

        super().__init__()
        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        split, added = spec["pre_tokenizer"] or {}, spec["added_tokens"]
        if split.get("type") != "ByteLevel" or spec["normalizer"] or split.get("add_prefix_space") or not split.get("use_regex", True):
            raise ValueError("the shortcut holds for byte-level vocabularies with their own split and without a normalizer")
        if any(t.get(flag) for t in added for flag in ("lstrip", "rstrip", "single_word")):
            raise ValueError("the shortcut holds for special strings that take nothing of what is beside them")
        special = [t["content"] for t in added]
        self.special = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True)))) if special else None
        self.letters = byte_letters()
        self.pieces = splitter(BYTE_LEVEL_PATTERN)
        self.update(dict.fromkeys(self.prove(spec["model"]["vocab"]) if proven is None else proven, 1))
        self.whole = len(self)

    def prove(self, vocabulary: dict[str, int]) -> list[str]:
        """The strings that merge to the one token that they are."""
        back = {c: b for b, c in self.letters.items()}
        merge, found = self.library.model.tokenize, []
        for string, token in vocabulary.items():
            if all(c in back for c in string) and [t.id for t in merge(string)] == [token]:
                try:
                    found.append(bytes(back[c] for c in string).decode())
                except UnicodeDecodeError:
                    pass  # part of a character: never a whole pre-token
        return found

    def __missing__(self, piece: str) -> int:
        n = len(self.library.model.tokenize("".join(map(self.letters.__getitem__, piece.encode()))))
        if len(piece) <= LONGEST and len(self) < self.whole + CACHE:
            self[piece] = n
        return n

    def count(self, text: str | None) -> int:
        text = text or ""
        if UNSURE.search(text):
            return len(self.library.encode(text, add_special_tokens=False).ids)
        parts = self.special.split(text) if self.special else [text]
        return len(parts) - 1 + sum(sum(map(self.__getitem__, self.pieces(p))) for p in parts)


@functools.lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    return Counter(path)


_counters: dict[str, Counter] = {}


def counter_of_worker(path: str, proven: list[str]) -> Counter:
    """Made once for each worker; tasks refer to this function by name."""
    if path not in _counters:
        _counters[path] = Counter(path, proven)
    return _counters[path]


def token_counts(documents: DataFrame, path: str, limit: int = 512) -> DataFrame:
    """(doc_id, text) to (doc_id, n_bytes, n_tokens, over_limit)."""
    own = counter(path)
    proven = list(own)[: own.whole]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter_of_worker(path, proven)
        for b in batches:
            n = pa.array([c.count(t.as_py()) for t in b.column(2)], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), n], ["doc_id", "n_bytes", "n_tokens"])

    sized = documents.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), "text")
    return sized.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)
