"""Token counts of an exact encoder that never fall when text is appended.

A text is cut into segments from the front: each ends at the first word start behind its 64th character, or at its 128th. A
boundary depends on nothing behind it, so appended text moves none. A segment counts as the largest number of tokens that
any of its prefixes has; encoders merge, so the count of a longer text can be lower. Segments that start behind the first
LIMIT characters count as their UTF-8 bytes, more than any byte-level encoder gives, unless all are asked for.

The counts of all prefixes come from one pass: pieces that an encoder never merges across (its words) are counted once, and for
a prefix only its last piece is split and counted again, with the one before it where what follows can change that one's end,
as it can after blanks. What a piece adds at most depends on these two alone and is remembered, so a word that comes again costs a lookup.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from functools import lru_cache
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

LIMIT = 262_144
SHORT, LONG = 64, 128
_SEGMENT = re.compile(rf".{{{SHORT},{LONG - 1}}}?(?<=\s)(?=\S)|.{{1,{LONG}}}", re.DOTALL)
_REMEMBERED = 1 << 17


class Encoder:
    """An encoder by its functions: the places where a text's pieces end, the number of tokens of a piece, whether a piece ends
    where it does whatever characters stand behind the first of the next one (no piece, if left out), and, for a piece whose
    prefixes are all pieces, the most tokens that one of them has and its own (None for others)."""

    def __init__(self, ends: Callable[[str], list[int]], count: Callable[[str], int], fixed: Callable[[str], bool] = lambda piece: False, word: Callable[[str], tuple[int, int] | None] = lambda piece: None):
        self.word = word
        self.ends, self.piece, self.fixed = ends, lru_cache(_REMEMBERED)(count), fixed
        self.peak, self.known = lru_cache(_REMEMBERED)(self._peak), lru_cache(_REMEMBERED)(self._known)
        self.largest = lru_cache(_REMEMBERED // 8)(self._largest)

    def count(self, text: str) -> int:
        """The tokens of a text."""
        total, start = 0, 0
        for end in self.ends(text):
            total, start = total + self.piece(text[start:end]), end
        return total

    def _peak(self, text: str, start: int) -> int:
        """The most tokens that a prefix of a text has, of those that end behind `start`."""
        return max([self.count(text[:k]) for k in range(start + 1, len(text) + 1)])

    def _known(self, piece: str) -> tuple[int, int, bool]:
        """The most tokens of a piece's prefixes, its own, and whether its end is fixed."""
        peak, count = self.word(piece) or (self._peak(piece, 0), self.piece(piece))
        return peak, count, self.fixed(piece)

    def _largest(self, segment: str) -> int:
        """The most tokens that a prefix of a segment has."""
        best, done, before, start, closed = 0, 0, 0, 0, True
        for end in self.ends(segment):
            peak, count, fixed = self.known(segment[start:end])
            if not closed:
                # what stands here can change the end of the piece before, which is counted anew with it
                peak = self.peak(segment[before:end], start - before)
                best, done = max(best, done + peak), done + self.piece(segment[before:start])
            elif done + peak > best:
                best = done + peak
            if fixed:
                done += count
            before, start, closed = start, end, fixed
        return best

    def estimate(self, text: str, limit: int | None = LIMIT) -> int:
        """The tokens of a text as they are charged, without a limit by the encoder to its end; an encoder that fails charges every byte."""
        try:
            total = 0
            for segment in _SEGMENT.finditer(text):
                total += self.largest(segment[0]) if limit is None or segment.start() < limit else len(segment[0].encode())
            return total
        except Exception:  # noqa: BLE001  whatever a plugged-in encoder raises
            return len(text.encode())


@lru_cache(maxsize=8)
def bpe(path: str) -> Encoder:
    """An encoder from a file of the tokenizers library with a byte-level model; special tokens count as plain text."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    if tokenizer.normalizer is not None:
        raise ValueError("a tokenizer that changes the text has no counts for parts of it")
    split, model = tokenizer.pre_tokenizer.pre_tokenize_str, tokenizer.model

    def ends(text: str) -> list[int]:
        return [end for _, (_, end) in split(text)]

    @lru_cache(_REMEMBERED)
    def tokens(mapped: str) -> int:
        return len(model.tokenize(mapped))

    def count(piece: str) -> int:
        return sum(tokens(x) for x, _ in split(piece))

    kind = json.loads(tokenizer.to_str())["pre_tokenizer"]
    plain = kind["type"] == "ByteLevel" and kind.get("use_regex", True) and not kind["add_prefix_space"]

    @lru_cache(_REMEMBERED)
    def seen(character: str) -> str:
        return split(character)[0][0]

    def word(piece: str) -> tuple[int, int] | None:
        # A prefix of a word of letters is one piece too, and the model sees it character by character.
        if not plain or not piece[piece[0] == " " :].isalpha():
            return None
        counts = [tokens(x) for x in accumulate(map(seen, piece))]
        return max(counts), counts[-1]

    return Encoder(ends, count, lambda piece: not piece[-1].isspace(), word)


def counted(path: str, load: Callable[[str], Encoder] = bpe, limit: int | None = LIMIT) -> Callable[[Column], Column]:
    """A family's count for functions.tokens: estimates by the encoder of a file that every worker can read."""

    @F.arrow_udf("long")
    def run(texts: pa.Array) -> pa.Array:
        encoder = load(path)
        return pa.array([None if x is None else encoder.estimate(x, limit) for x in texts.to_pylist()], pa.int64())

    return run
