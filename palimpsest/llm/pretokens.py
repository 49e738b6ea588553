"""The pieces into which the byte-level tokenizers' pattern splits texts, found for a whole batch at once."""

from __future__ import annotations

import base64
import functools

import numpy as np
import regex
import tiktoken

SPACE, LETTER, NUMBER, OTHER = 0, 1, 2, 3
#: What follows an apostrophe that begins a piece of its own.
CONTRACTIONS = ("'s", "'t", "'re", "'ve", "'m", "'ll", "'d")


@functools.cache
def classes() -> np.ndarray:
    """Class of every code point."""
    found = np.full(0x110000, OTHER, np.uint8)
    points = "".join(chr(i) for i in range(0x110000) if not 0xD800 <= i < 0xE000)
    for value, pattern in ((SPACE, r"\p{White_Space}"), (LETTER, r"\p{L}"), (NUMBER, r"\p{N}")):
        found[[ord(c) for c in regex.findall(pattern, points)]] = value
    return found


def code_points(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of UTF-8 bytes, and the offsets of the texts in them."""
    before = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=before[1:])
    return np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32), before[offsets]


def piece_starts(points: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sorted starts of all pieces of all texts.

    Runs of one class are pieces; a blank before a run joins it; of several white characters before a run the
    last stands alone or joins; a contraction ends after its letters.
    """
    n = len(points)
    if not n:
        return np.empty(0, np.int64)
    kind = classes()[points]
    border = np.zeros(n + 1, bool)
    border[offsets] = True
    start = border[:n].copy()
    start[1:] |= kind[1:] != kind[:-1]
    space = kind == SPACE
    # the last white character before a run of another class in the same text
    last = np.flatnonzero(space[:-1] & ~space[1:] & ~border[1:n])
    start[last] = True
    start[last[points[last] == 0x20] + 1] = False
    quote = np.flatnonzero((points == 0x27) & start)
    if len(quote):
        padded = np.concatenate([points, np.zeros(2, np.uint32)])
        one, two = padded[quote + 1], padded[quote + 2]
        one = np.where(border[quote + 1], 0, one)
        two = np.where((one == 0) | border[np.minimum(quote + 2, n)], 0, two)
        short = np.isin(one, np.frombuffer("stmd".encode("utf-32-le"), np.uint32))
        long = ((one == ord("r")) & (two == ord("e"))) | ((one == ord("v")) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l")))
        start[quote[short | long] + 1] = False
        ends = np.concatenate([quote[short] + 2, quote[long] + 3])
        start[ends[ends < n]] = True
    return np.flatnonzero(start)


@functools.lru_cache(maxsize=4)
def compiled(pattern: str) -> regex.Pattern:
    """A tokenizer's pattern, its white space being Unicode's (control characters 1C to 1F are none)."""
    return regex.compile(pattern.replace(r"(?!\S)", r"(?!\P{White_Space})").replace(r"\s", r"\p{White_Space}"))


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


@functools.lru_cache(maxsize=4)
def encoding(path: str, pattern: str) -> tuple[tiktoken.Encoding, dict[bytes, int]]:
    """The vocabulary in a rank file, once per worker."""
    ranks = load_ranks(path)
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), ranks
