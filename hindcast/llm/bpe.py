"""Byte-pair merges and byte-level spelling, for counting and for checks."""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterable
from itertools import chain

from tokenizers import Tokenizer


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in a byte-level vocabulary."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    spare = iter(range(256, 512))
    return [chr(b) if b in set(plain) else chr(next(spare)) for b in range(256)]


LETTERS = byte_letters()
BYTES = {letter: b for b, letter in enumerate(LETTERS)}
_TABLE = {b: LETTERS[b] for b in range(256)}


def spell(piece: str) -> str:
    """A piece of text in byte letters."""
    return piece.encode("utf-8").decode("latin-1").translate(_TABLE)


def unspell(token: str) -> str | None:
    """The text behind a token, or None where its bytes are not whole characters."""
    try:
        return bytes(BYTES[c] for c in token).decode("utf-8")
    except (KeyError, UnicodeDecodeError):
        return None


class Merges:
    """Ranked merges: the lowest rank first, the leftmost of equals."""

    def __init__(self, merges: Iterable[Iterable[str]], suffix: str = ""):
        self.rank = {tuple(pair): k for k, pair in enumerate(merges)}
        self.suffix = suffix

    def apply(self, piece: str) -> list[str]:
        parts = list(piece)
        if self.suffix and parts:
            parts[-1] += self.suffix
        return self._few(parts) if len(parts) <= 24 else self._many(parts)

    def _few(self, parts: list[str]) -> list[str]:
        rank, none = self.rank.get, len(self.rank)
        while len(parts) > 1:
            ranks = [rank(pair, none) for pair in zip(parts, parts[1:])]
            best = min(ranks)
            if best == none:
                break
            at = ranks.index(best)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _many(self, parts: list[str]) -> list[str]:
        """The same with a heap, for pieces whose length would make rescanning quadratic."""
        n = len(parts)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        waiting = [(r, k, parts[k], parts[k + 1]) for k in range(n - 1) if (r := self.rank.get((parts[k], parts[k + 1]))) is not None]
        heapq.heapify(waiting)
        while waiting:
            _, k, left, right = heapq.heappop(waiting)
            j = after[k]
            if j >= n or parts[k] != left or parts[j] != right:
                continue
            parts[k], parts[j] = left + right, ""
            after[k] = after[j]
            if after[k] < n:
                before[after[k]] = k
            for a in (before[k], k):
                b = after[a] if a >= 0 else n
                if b < n and (r := self.rank.get((parts[a], parts[b]))) is not None:
                    heapq.heappush(waiting, (r, a, parts[a], parts[b]))
        return [p for p in parts if p]


def doubtful(tokenizer: Tokenizer, own_pieces: Callable[[str], list[str]]) -> str:
    """A character class of the code points that the library cuts or normalises otherwise than ``own_pieces``.

    Two Unicode versions differ in newer letters. Each code point of the planes with letters is tried
    once, doubled after a letter, which tells letters, digits, marks and white space apart.
    """
    normal = tokenizer.normalizer.normalize_str if tokenizer.normalizer else str
    cut = tokenizer.pre_tokenizer.pre_tokenize_str
    odd = []
    for code in chain(range(0xD800), range(0xE000, 0x40000), range(0xE0000, 0xE1000)):
        probe = "a" + chr(code) * 2
        if [p for p, _ in cut(normal(probe))] != [spell(p) for p in own_pieces(probe)]:
            odd.append(code)
    runs: list[list[int]] = []
    for code in odd:
        if runs and runs[-1][1] == code - 1:
            runs[-1][1] = code
        else:
            runs.append([code, code])
    return "[" + "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in runs) + "]" if runs else r"(?!)"
