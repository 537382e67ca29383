"""Pre-tokens of byte-level vocabularies, found in overlapping chunks that are stitched where they agree.

A match of the pattern depends only on the text from its start to a few characters past its end. So two
chunks that both have a boundary at one place agree on all that follows, up to the end of the first.
"""

from __future__ import annotations

import re

import numpy as np
import regex

CHUNK, OVERLAP = 8192, 256
#: A boundary this close to the end of a chunk may be an artefact of the cut (a contraction has two letters).
MARGIN = 3
#: Characters whose Unicode classes are the same in the ``regex`` module and in the tokenizer libraries; the others
#: were assigned recently, and a text that holds one goes to the library whole.
UNSURE = re.compile(
    r"[^\u0000-՗֐-࡟ऀ-௿ഀ-᱿ᴀ-⁰₠-ꟍꠀ-ꭠ가-�"
    r"\U0001F000-\U0001FAFF\U00020000-\U0002B739]"
)


def splitter(pattern: str, chunk: int = CHUNK, overlap: int = OVERLAP):
    """A function from text to its list of pre-tokens; the pattern must cover every character."""
    find = regex.compile(pattern).findall

    def pieces(text: str) -> list[str]:
        n = len(text)
        if n <= chunk + overlap:
            return find(text)
        out: list[str] = []
        end = chunk + overlap
        start, now = 0, find(text[:end])
        while end < n:
            begin = max(start, end - overlap)
            after = min(n, begin + chunk + overlap)
            following = find(text[begin:after])
            known, at, i = {}, end, len(now)
            while i and at > begin:
                i -= 1
                at -= len(now[i])
                if begin <= at <= end - MARGIN:
                    known[at] = i
            at = begin
            for k, piece in enumerate(following):
                if at in known or at > end - MARGIN:
                    break
                at += len(piece)
            if at in known:
                out += now[: known[at]]
                start, now, end = at, following[k:], after
            else:  # the chunks never agree, as in one run longer than the overlap: look at more text at once
                end = min(n, start + 2 * (end - start))
                now = find(text[start:end])
        return out + now

    return pieces


def chunk_starts(n: int, chunk: int) -> range:
    """Where the chunks of a text of n characters begin; each reaches ``overlap`` past the start of the next."""
    return range(0, max(1, n), chunk)


def stitched(starts: list[int], lengths: list[np.ndarray], overlap: int) -> list[tuple[int, int]] | None:
    """Which pieces (first, past the last) of each chunk make up the text, from the lengths of each chunk's pieces.

    Chunks are pre-tokenised apart. From the first boundary that a chunk and the next have in common, far enough from the cut, the
    next one has the right pieces. None if two neighbours have none in common, as in one run longer than the overlap.
    """
    bounds = [s + np.cumsum(np.append(0, x)) for s, x in zip(starts, lengths)]
    out, first = [], 0
    for k, at in enumerate(bounds[:-1]):
        there = at[first:][(at[first:] >= starts[k + 1]) & (at[first:] <= starts[k + 1] + overlap - MARGIN)]
        both = there[np.isin(there, bounds[k + 1])]
        if not len(both):
            return None
        out.append((first, int(np.searchsorted(at, both[0]))))
        first = int(np.searchsorted(bounds[k + 1], both[0]))
    return [*out, (first, len(lengths[-1]))]
