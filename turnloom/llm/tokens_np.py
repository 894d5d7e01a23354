"""Words of Arrow text columns as numpy arrays, in pieces of bounded size.

A piece holds whole documents, about PIECE_BYTES of text at most unless one document alone is longer.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

PIECE_BYTES = 1 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_GRAM = np.uint64(0xD6E8FEB86659FD93)
_STEP = 1 << 15


def mixed(x: np.ndarray) -> np.ndarray:
    """The finaliser of SplitMix64, element by element."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE_VALUE = mixed(np.arange(1, 257, dtype=np.uint64))
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS.get("up", ())) < n:
        size = n + (1 << 16)  # 16 bytes each, so no more than pieces need
        for name, base in (("up", _BASE), ("down", _BASE_INVERSE)):
            steps = np.full(size, base, dtype=np.uint64)
            steps[0] = 1
            _POWERS[name] = np.multiply.accumulate(steps)
    return _POWERS["up"], _POWERS["down"]


def byte_table(pattern: str) -> np.ndarray:
    """Which bytes belong to words: 'alnum' is 0-9 a-z and all non-ASCII, 'visible' all but the six ASCII spaces."""
    table = np.zeros(256, dtype=bool)
    if pattern == "alnum":
        table[48:58] = table[97:123] = table[128:] = True
    else:
        table[:] = True
        table[[9, 10, 11, 12, 13, 32]] = False
    return table


ALNUM, VISIBLE = byte_table("alnum"), byte_table("visible")
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def run_values(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit value for each run of bytes, equal for equal bytes wherever they stand."""
    if not len(starts):
        return np.zeros(0, dtype=np.uint64)
    up, down = _powers(len(data) + 1)
    prefix = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_BYTE_VALUE[data] * up[: len(data)], out=prefix[1:])
    return mixed((prefix[ends] - prefix[starts]) * down[starts] + (ends - starts).astype(np.uint64))


@dataclass
class Piece:
    """Documents rows[0] to rows[1] of a batch; words[d] to words[d + 1] are the words of the d-th of them."""

    rows: tuple[int, int]
    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    words: np.ndarray

    def hashes(self) -> np.ndarray:
        """A 64-bit value for each word, equal for equal bytes."""
        return run_values(self.data, self.starts, self.ends)

    def owner(self) -> np.ndarray:
        """The document of each word, counted from the piece's first."""
        return np.repeat(np.arange(len(self.words) - 1), np.diff(self.words))

    def word(self, i: int, j: int) -> str:
        """Words i to j - 1, joined by one space."""
        return b" ".join(self.data[s:e].tobytes() for s, e in zip(self.starts[i:j], self.ends[i:j], strict=True)).decode("utf-8", "replace")


def strings(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of a string column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.string()) if column.type != pa.string() else column
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return at, np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)


def pieces(column: pa.Array, table: np.ndarray, lower: bool = False) -> Iterator[Piece]:
    """The words of a text column, piece by piece."""
    if not len(column):
        return
    at, data = strings(column)
    first = 0
    while first < len(column):
        last = max(first + 1, int(np.searchsorted(at, at[first] + PIECE_BYTES, "right")) - 1)
        last = min(last, len(column))
        part = data[at[first] : at[last]]
        part = LOWER[part] if lower else part
        bounds = at[first : last + 1] - at[first]
        inside = table[part]
        begin, end = inside.copy(), inside.copy()
        begin[1:] &= ~inside[:-1]
        end[:-1] &= ~inside[1:]
        heads, tails = bounds[:-1][bounds[:-1] < bounds[1:]], bounds[1:][bounds[:-1] < bounds[1:]] - 1
        begin[heads], end[tails] = inside[heads], inside[tails]
        starts, ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
        yield Piece((first, last), part, starts, ends, np.searchsorted(starts, bounds))
        first = last


def grams(words: np.ndarray, n: int) -> np.ndarray:
    """A value for each run of n words, one for each start (none if there are fewer words); runs may cross documents."""
    total = max(0, len(words) - n + 1)
    out = np.empty(total, dtype=np.uint64)
    for a in range(0, total, _STEP):  # so many at once stay in a core's cache
        b = min(total, a + _STEP)
        some = words[a:b].copy()
        for j in range(1, n):
            some *= _GRAM
            some += words[a + j : b + j]
        out[a:b] = mixed(some)
    return out


def whole_runs(piece: Piece, n: int) -> np.ndarray:
    """For each start of n consecutive words of the piece, whether all are of one document."""
    total = len(piece.starts) - n + 1
    if total <= 0:
        return np.zeros(0, dtype=bool)
    owner = piece.owner()
    return owner[:total] == owner[n - 1 :]
