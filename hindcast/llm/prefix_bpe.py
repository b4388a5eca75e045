"""Byte-level BPE encoding and decoding by prefix dynamic programming (operator 13).

For every prefix of a piece exactly one token can end its encoding: the one that fits the last token of the prefix
before it. Two tokens fit if merging their bytes together gives these two tokens again. A table of these last tokens
is therefore filled byte by byte; reading it backwards gives the ids. Nothing before an end ever changes when bytes
are appended, so appends are exact, and after an edit the table is filled anew only until it agrees with the old one
over the length of the longest token.

Which tokens the merges reach, and by which last merge, is proved once on the driver. A piece that is itself a
vocabulary string is that one token, as the library has it, even where the merges would not reach it.

Ids are kept as little-endian unsigned 32-bit integers in one binary value, which is the array that trainers map.

Edge cases: null and empty texts have no tokens; strings of special tokens are ordinary text; repeated rows are encoded one
by one from remembered pieces; characters that the library's Unicode tables class otherwise than ours are cut as
the library cuts them; a very long piece takes time in proportion to its length; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

import base64
import sys
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pandas as pd
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hindcast.llm.common import bounded_batches, id_and_text, table
from hindcast.llm.registry import query

MEMO_PIECES = 400_000
MEMO_PAIRS = 2_000_000
#: characters of a text that are cut into pieces at a time
STRETCH = 1 << 18
#: after this many characters behind a piece nothing can change where it ends
LOOK_AHEAD = 3
NEVER = 1 << 62
_WORKERS: dict[int, "Encoder"] = {}


@dataclass
class Vocabulary:
    """What a worker needs; its size is that of the vocabulary, whatever the corpus."""

    pattern: str
    tokens: dict[int, bytes]
    #: last merge of every token of several bytes that the merges reach
    halves: dict[int, tuple[int, int]]


def merge(piece: bytes, ranks: dict[bytes, int]) -> tuple[list[bytes], tuple[bytes, bytes] | None]:
    """The merges by their definition, lowest rank first and leftmost of equals; and the last merge."""
    parts = [piece[k : k + 1] for k in range(len(piece))]
    last = None
    while len(parts) > 1:
        found = [ranks.get(a + b, NEVER) for a, b in zip(parts, parts[1:])]
        best = min(found)
        if best == NEVER:
            break
        at = found.index(best)
        last = parts[at], parts[at + 1]
        parts[at : at + 2] = [last[0] + last[1]]
    return parts, last


def load_vocabulary(path: str, pattern: str) -> Vocabulary:
    """Reads a rank file on the driver and proves the last merge of every token."""
    with open(path, "rb") as file:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
    halves = {}
    for token, rank in ranks.items():
        if len(token) > 1:
            parts, last = merge(token, ranks)
            if len(parts) == 1:
                halves[rank] = ranks[last[0]], ranks[last[1]]
    if any(max(pair) >= rank for rank, pair in halves.items()):
        raise ValueError("a token is ranked before its parts")
    return Vocabulary(pattern, {rank: token for token, rank in ranks.items()}, halves)


class Merges:
    """Tokens of one vocabulary: which end where in a string of bytes, and which fit each other."""

    def __init__(self, vocabulary: Vocabulary):
        self.tokens = vocabulary.tokens
        self.halves = vocabulary.halves
        self.ranks = {token: rank for rank, token in self.tokens.items()}
        self.sizes = {rank: len(token) for rank, token in self.tokens.items()}
        self.longest = max(self.sizes.values())
        self.ending = ahocorasick.Automaton()
        for rank, token in self.tokens.items():
            if len(token) == 1 or rank in self.halves:
                self.ending.add_word(token.decode("latin-1"), rank)
        self.ending.make_automaton()
        self.edges: tuple[dict[int, list[int]], dict[int, list[int]]] = ({}, {})
        self.pairs: dict[int, bool] = {}

    def edge(self, token: int, side: int) -> list[int]:
        """The tokens that were the first (0) or last (1) part of a token while it was merged, the byte first."""
        known = self.edges[side].get(token)
        if known is None:
            parts = self.halves.get(token)
            known = self.edges[side][token] = [*self.edge(parts[side], side), token] if parts else [token]
        return known

    def fits(self, pair: int) -> bool:
        """Whether nothing merges across the border of two tokens (left << 32 | right) before each is whole.

        Both edges grow by the ranks of their own merges. A merge across wins if it ranks before the
        next merge of the left edge, and not after that of the right edge, whose place is further right.
        """
        ends, starts = self.edge(pair >> 32, 1), self.edge(pair & 0xFFFFFFFF, 0)
        i = j = 0
        while True:
            across = self.ranks.get(self.tokens[ends[i]] + self.tokens[starts[j]], NEVER)
            grow_left = ends[i + 1] if i + 1 < len(ends) else NEVER
            grow_right = starts[j + 1] if j + 1 < len(starts) else NEVER
            if across < grow_left and across <= grow_right or grow_left == grow_right == NEVER:
                break
            if grow_left <= grow_right:
                i += 1
            else:
                j += 1
        if len(self.pairs) >= MEMO_PAIRS:
            self.pairs.clear()
        self.pairs[pair] = across == NEVER
        return across == NEVER


    def extend(self, last: list[int], data: bytes, until: int) -> None:
        """Appends the last tokens of the prefixes of ``data`` up to a length to those known so far."""
        sizes, pairs, add = self.sizes, self.pairs, last.append
        n = len(last)
        start = max(0, n - self.longest)
        for end, token in self.ending.iter(data[start:until].decode("latin-1")):
            if end + start == n:  # else found in an earlier turn or by a longer token
                before = n - sizes[token]
                if before >= 0:
                    pair = last[before] << 32 | token
                    if not (pairs[pair] if pair in pairs else self.fits(pair)):
                        continue
                elif before != -1:
                    continue
                add(token)
                n += 1
        if n != until:
            raise AssertionError("every prefix has a last token")

    def read(self, last: list[int]) -> array:
        """The ids of a whole table, from its end: every last token names the prefix before it."""
        sizes, out, at = self.sizes, [], len(last)
        while at:
            token = last[at - 1]
            out.append(token)
            at -= sizes[token]
        out.reverse()
        return array("I", out)


class PrefixTable:
    """The last token of every prefix of some bytes."""

    def __init__(self, merges: Merges, data: bytes = b""):
        self.merges = merges
        self.data = b""
        self.last: list[int] = []
        #: prefixes whose last token was looked for, over the life of the table
        self.filled = 0
        self.append(data)

    def append(self, more: bytes) -> None:
        """Exact: the entries so far stay as they are."""
        self.data += more
        self._fill(len(self.data))

    def _fill(self, until: int) -> None:
        self.filled += until - len(self.last)
        self.merges.extend(self.last, self.data, until)

    def edit(self, start: int, end: int, new: bytes) -> None:
        """Replaces data[start:end]; fills the table anew from there until it agrees with the old one."""
        old, shift, reach = self.last, start + len(new) - end, self.merges.longest
        self.data = self.data[:start] + new + self.data[end:]
        self.last = old[:start]
        kept = start + len(new)  # from here on the bytes are old ones
        while len(self.last) < len(self.data):
            self._fill(min(len(self.data), max(kept, len(self.last)) + reach))
            at = len(self.last)
            if at - kept >= reach and self.last[at - reach :] == old[at - reach - shift : at - shift]:
                self.last.extend(old[at - shift :])

    def ids(self) -> array:
        return self.merges.read(self.last)


class Cutter:
    """Cuts texts into pieces by the pattern, with the library's own view of what a letter is."""

    def __init__(self, pattern: str):
        self.pieces = regex.compile(pattern)
        # a vocabulary that merges one letter, digit or mark with whatever byte comes next shows what is one piece
        self.probes = {kind: self._probe(pattern, kind) for kind in "a1!"}
        self.known: dict[str, str | None] = {}

    @staticmethod
    def _probe(pattern: str, kind: str) -> tiktoken.Encoding:
        ranks = {bytes([b]): b for b in range(256)} | {kind.encode() + bytes([b]): 256 + b for b in range(256)}
        return tiktoken.Encoding("probe", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def stand_in(self, letter: str) -> str | None:
        """A plain character of the class that the library gives to one that we class otherwise; else None."""
        if letter not in self.known:
            classes = [kind for kind, probe in self.probes.items() if probe.encode_ordinary(kind + letter)[0] >= 256]
            ours = [kind for kind in "a1!" if len(self.pieces.findall(kind + letter)) == 1]
            self.known[letter] = None if classes == ours else {"a": "z", "1": "0", "!": "!"}.get("".join(classes), "\n")
        return self.known[letter]

    def cut(self, text: str) -> list[str]:
        if text.isascii():
            return self.pieces.findall(text)
        other = {ord(c): s for c in set(text) if ord(c) > 127 and (s := self.stand_in(c))}
        if not other:
            return self.pieces.findall(text)
        return [text[m.start() : m.end()] for m in self.pieces.finditer(text.translate(other))]


class Encoder(dict):
    """Packed ids per piece. Two generations: when the young one is full it becomes the old one, and pieces met
    again come back from there, so frequent pieces outlive any number of rare ones."""

    #: where a text may be cut in two: before a space or line end behind an ASCII letter or digit a piece always ends
    BORDER = regex.compile(r"(?<=[0-9A-Za-z])[ \n]")

    def __init__(self, vocabulary: Vocabulary):
        super().__init__()
        self.merges = Merges(vocabulary)
        self.cutter = Cutter(vocabulary.pattern)
        self.old: dict[str, bytes] = {}

    def __missing__(self, piece: str) -> bytes:
        packed = self.old.get(piece)
        if packed is None:
            raw, merges = piece.encode(), self.merges
            whole = merges.ranks.get(raw)
            if whole is None:
                last: list[int] = []
                merges.extend(last, raw, len(raw))
                packed = pack(merges.read(last))
            else:
                packed = pack(array("I", [whole]))
        if len(piece) <= 64:
            if len(self) >= MEMO_PIECES:
                self.old = dict(self)
                self.clear()
            self[piece] = packed
        return packed

    def stretches(self, text: str) -> Iterator[str]:
        at = 0
        while len(text) - at > STRETCH and (border := self.BORDER.search(text, at + STRETCH)):
            yield text[at : border.start()]
            at = border.start()
        yield text[at:]

    def encode(self, text: str) -> bytes:
        return b"".join(
            b"".join(map(self.__getitem__, self.cutter.cut(stretch))) for stretch in self.stretches(text)
        )

    def decode(self, packed: bytes) -> bytes:
        return b"".join(map(self.merges.tokens.__getitem__, unpack(packed)))


def pack(ids: array) -> bytes:
    if sys.byteorder == "big":
        ids = array("I", ids)
        ids.byteswap()
    return ids.tobytes()


def unpack(packed: bytes) -> list[int]:
    return np.frombuffer(packed, dtype="<u4").tolist()


class EditableText:
    """A text with its pieces and their tables, re-encoded only near its edits."""

    def __init__(self, encoder: Encoder, text: str = ""):
        self.encoder = encoder
        self.text = ""
        self.pieces: list[str] = []
        self.tables: dict[int, PrefixTable] = {}
        self.edit(0, 0, text)

    def append(self, more: str) -> None:
        self.edit(len(self.text), len(self.text), more)

    def edit(self, start: int, end: int, new: str) -> None:
        """Replaces text[start:end]. Pieces well before the edit stay, and so do those from a common border behind it."""
        shift = start + len(new) - end
        text = self.text[:start] + new + self.text[end:]
        first = at = 0
        while first < len(self.pieces) and at + len(self.pieces[first]) + LOOK_AHEAD <= start:
            at += len(self.pieces[first])
            first += 1
        borders, place = {}, at
        for k in range(first, len(self.pieces)):
            if place >= end:
                borders[place + shift] = k
            place += len(self.pieces[k])
        rest, fresh = len(self.pieces), []
        if text == self.text:
            return
        began = at
        for stretch in self.encoder.stretches(text[at:]):
            for piece in self.encoder.cutter.cut(stretch):
                if at in borders:
                    rest = borders[at]
                    break
                fresh.append(piece)
                at += len(piece)
            else:
                continue
            break
        self._retable(first, rest, fresh, start - began, end - began, new)
        self.pieces[first:rest] = fresh
        self.text = text

    def _retable(self, first: int, rest: int, fresh: list[str], start: int, end: int, new: str) -> None:
        """A single piece that was edited keeps its table; tables behind the edit move with their pieces."""
        moved = {k + len(fresh) - (rest - first) if k >= rest else k: t for k, t in self.tables.items() if k < first or k >= rest}
        if rest - first == len(fresh) == 1 and end <= len(self.pieces[first]):
            old, kept = self.pieces[first], self.tables.get(first) or PrefixTable(self.encoder.merges, self.pieces[first].encode())
            kept.edit(len(old[:start].encode()), len(old[:end].encode()), new.encode())
            if kept.data == fresh[0].encode():
                moved[first] = kept
        self.tables = moved

    def ids(self) -> bytes:
        """Packed ids of the text as it is now."""
        ranks, out = self.encoder.merges.ranks, []
        for k, piece in enumerate(self.pieces):
            held = self.tables.get(k)
            out.append(pack(held.ids()) if held and held.data not in ranks else self.encoder[piece])
        return b"".join(out)


def _worker(shared, mark: int) -> Encoder:
    known = _WORKERS.get(mark)
    if known is None:
        known = _WORKERS[mark] = Encoder(shared.value)
    return known


def _share(spark, vocabulary: Vocabulary):
    """The vocabulary, bounded by its file, for all workers."""
    bounded_batches(spark)
    return spark.sparkContext.broadcast(vocabulary), hash((vocabulary.pattern, frozenset(vocabulary.tokens.items())))


def encode_documents(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """doc_id and ids (packed), one pass over the texts without a shuffle."""
    shared, mark = _share(docs.sparkSession, vocabulary)

    @F.pandas_udf("binary")
    def encode(texts: pd.Series) -> pd.Series:
        return texts.map(_worker(shared, mark).encode)

    return id_and_text(docs).select("doc_id", encode("text").alias("ids"))


def decode_documents(encoded: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """doc_id, ids and the decoded bytes; a text cut inside a character stays bytes."""
    shared, mark = _share(encoded.sparkSession, vocabulary)

    @F.pandas_udf("binary")
    def decode(ids: pd.Series) -> pd.Series:
        return ids.map(_worker(shared, mark).decode)

    return encoded.select("doc_id", "ids", decode("ids").alias("decoded"))


def encode_edited(edits: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """(doc_id, text, start, end, new) to doc_id and the ids of the text after its edit, re-encoded near the edit.

    Positions are code points and are clipped to the text; a null text or insertion is empty.
    """
    shared, mark = _share(edits.sparkSession, vocabulary)

    @F.pandas_udf("binary")
    def encode(texts: pd.Series, starts: pd.Series, ends: pd.Series, news: pd.Series) -> pd.Series:
        encoder, out = _worker(shared, mark), []
        for text, start, end, new in zip(texts, starts, ends, news):
            held = EditableText(encoder, text)
            start = min(max(0, int(start)), len(text))
            held.edit(start, min(max(start, int(end)), len(text)), new)
            out.append(held.ids())
        return pd.Series(out, dtype="object")

    whole = lambda c: F.coalesce(F.col(c), F.lit(""))
    place = lambda c: F.coalesce(F.col(c).cast("long"), F.lit(0))
    return edits.select("doc_id", encode(whole("text"), place("start"), place("end"), whole("new")).alias("ids"))


@query("op13_byte_bpe")
def op13_byte_bpe(spark, sf_dir):
    import public_tokenizers

    vocabulary = load_vocabulary(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    done = decode_documents(encode_documents(table(spark, sf_dir, "documents"), vocabulary), vocabulary)
    return done.select(
        "doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"),
    )
