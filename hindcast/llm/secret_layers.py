r"""Secret scans through nested encodings (operator 2).

Every text is a worklist of layers. A layer is scanned for the three kinds of secrets, then
unwrapped: percent and Unicode escapes give the whole layer once more with the escapes replaced (bytes outside
UTF-8 by one replacement each) and a layer for compressed data written in them,
base64 runs give a layer each (through any compression found inside), also joined over line breaks and, where a
run does not decode from its first letter, from the other three offsets. New layers join the worklist
until none is left; a layer with a content and place seen before is dropped, which also ends cycles.
Spans found in a layer are mapped back, layer by layer, to code points of the original text.

A span is the whole match (keyword included for ``assign``), end exclusive. ``base`` spans are those
of the text itself; layers only add spans. Spans inside base64 are exact to the letters that carry
them, spans inside compressed data cover the whole run.

Edge cases: null and empty texts have no spans and the hash of the empty string; repeated rows are
scanned one by one; ties in the order of spans go by kind, then by end; an empty table gives an empty
result; other columns are ignored. A decompressed layer is
read to its end, through all its members, in overlapping blocks of about ``max_layer_bytes``, so memory stays
bounded. ``n_cut`` counts layers in which a block had to break a run without white space that is longer than four
blocks, or with more than 64 levels of compression directly inside each other. Damaged compressed data counts
up to the damage; bytes outside UTF-8 are one replacement each, the readable rest of a layer stays.
"""

from __future__ import annotations

import base64
import bz2
import hashlib
import lzma
import re
import zlib
from bisect import bisect_right
from collections import deque
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from itertools import accumulate, chain

import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hindcast.llm.common import bounded_batches, id_and_text, table
from hindcast.llm.registry import query

#: fixed values: kinds in their order, patterns, and the least length of what counts
KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
#: runs are maximal, so a run of 16 or more is the same as a maximal run that is kept for its length
HEX = re.compile(r"[0-9a-f]{16,}")
LEAST_VALUE, LEAST_ACCESS = 12, 18
PERCENT = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
ESCAPE = re.compile(
    r"(?:\\u\{[0-9A-Fa-f]{1,6}\}|\\u[0-9A-Fa-f]{4}|\\U[0-9A-Fa-f]{8}|\\x[0-9A-Fa-f]{2}|&#[xX][0-9A-Fa-f]{1,6};|&#[0-9]{1,7};)+"
)
ONE_ESCAPE = re.compile(r"\\u\{([0-9A-Fa-f]+)\}|\\[uUx]([0-9A-Fa-f]+)|&#[xX]([0-9A-Fa-f]+);|&#([0-9]+);")
#: compression magic of which at least one byte is escaped ("x" and "BZh" are plain letters)
_ONE = r"(?:\\x%02x|\\u00%02x|\\U000000%02x|\\u\{0*%02x\}|&#[xX]0*%02x;|&#0*%d;)"
_ANY_CASE = "(?i:%s)"


def _magic(escaped: Callable[[int], str]) -> re.Pattern:
    one = lambda c: f"(?:{escaped(c)}|{re.escape(chr(c))})" if 32 < c < 127 else escaped(c)
    marks = [(0x1F, 0x8B), (0x78, 0x01), (0x78, 0x5E), (0x78, 0x9C), (0x78, 0xDA), (0x28, 0xB5, 0x2F, 0xFD), tuple(b"BZh"), (0xFD, *b"7zXZ", 0)]
    return re.compile("|".join("".join(map(one, mark)) for mark in marks))


PERCENT_MAGIC = _magic(lambda c: _ANY_CASE % f"%{c:02x}")
ESCAPE_MAGIC = _magic(lambda c: _ANY_CASE % (_ONE % (c, c, c, c, c, c)))
PERCENT_UNIT = re.compile(r"%[0-9A-Fa-f]{2}|[!$&'()*+,./0-9:;=?@A-Z_a-z~\[\]^`{|}-]")
ESCAPE_UNIT = re.compile(ESCAPE.pattern.removesuffix("+") + r"|\\[abfnrtv0/\\'\"]|[\x20-\x5b\x5d-\x7e\x80-\xff]")
SHORT = {"a": 7, "b": 8, "f": 12, "n": 10, "r": 13, "t": 9, "v": 11, "0": 0, "/": 47, "\\": 92, "'": 39, '"': 34}
BASE64 = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
#: lines end in a break, plain or written as an escape, and may be indented
WRAPPED = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}+(?:(?:\r?\n|(?:\\r)?\\n)[ \t]*+[A-Za-z0-9+/_-]++)++={0,2}")
LINE = re.compile(r"(?<!\\)[A-Za-z0-9+/_-]+|(?<=\\[nr])[A-Za-z0-9+/_-]+")
COMPRESSED = (b"\x1f\x8b", b"\x78\x01", b"\x78\x5e", b"\x78\x9c", b"\x78\xda", b"\x28\xb5\x2f\xfd", b"BZh", b"\xfd7zXZ\x00")
MAGIC = re.compile(b"|".join(re.escape(m) for m in COMPRESSED))
MAX_LAYER_BYTES = 16 << 20
LONGEST_MAGIC = max(map(len, COMPRESSED))
#: bytes out of and into a decompressor at a time (zstd has no bound on what comes out, so little goes in)
PIECE_BYTES, FEED_BYTES = 1 << 20, 1 << 9
#: bytes before a broken run that are read again, and levels of compression directly inside each other
OVERLAP, MOST_NESTED = 1 << 10, 64
#: bytes in no encoded run; a space is one unless it indents a line
BETWEEN = [bytes([c]) for c in (*range(9), *range(14, 32), 127, *b"<>(),|")]
LEAST_STRETCH = 16
UNREADABLE = re.compile(r"[\x00-\x08\x0e-\x1f\x7f\ufffd\ud800-\udfff]")
STRETCH = re.compile(r"[^\x00-\x08\x0e-\x1f\x7f\ufffd\ud800-\udfff]{%d}" % LEAST_STRETCH)
INVALID = re.compile(r"[\udc80-\udcff]")

Span = tuple[int, int]


@dataclass
class Layer:
    text: str
    place: Span
    origin: Callable[[int, int], Span]
    path: str = ""
    #: one of several blocks of a large layer
    streamed: bool = False


@dataclass
class Found:
    base: list[tuple[str, int, int]]
    added: dict[tuple[str, int, int], str] = field(default_factory=dict)
    n_layers: int = 0
    n_cut: int = 0


def in_order(spans) -> list[tuple[str, int, int]]:
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def joined(spans) -> str:
    return ",".join(f"{kind}:{start}:{end}" for kind, start, end in spans)


def scan(text: str) -> list[tuple[str, int, int]]:
    """Leftmost matches of each kind that do not overlap, less those that are too short."""
    spans = [("assign", *m.span()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST_VALUE]
    if "AKIA" in text:
        spans += [("access", *m.span()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    spans += [("hex", *m.span()) for m in HEX.finditer(text)]
    return in_order(spans)


def _replaced(parent: Layer, runs: list[tuple[int, int, str]], name: str) -> Layer:
    """The parent with each (start, end, decoded) run replaced, and the way back."""
    pieces, starts, sources, at, done = [], [], [], 0, 0

    def keep(piece: str, start: int, end: int, exact: bool) -> None:
        nonlocal at
        if piece:
            starts.append(at)
            sources.append((start, end, exact))
            pieces.append(piece)
            at += len(piece)

    for start, end, decoded in runs:
        keep(parent.text[done:start], done, start, True)
        keep(decoded, start, end, False)
        done = end
    keep(parent.text[done:], done, len(parent.text), True)

    def origin(a: int, b: int) -> Span:
        i, j = bisect_right(starts, a) - 1, bisect_right(starts, b - 1) - 1
        first, last = sources[i], sources[j]
        start = first[0] + (a - starts[i]) if first[2] else first[0]
        return parent.origin(start, last[0] + (b - starts[j]) if last[2] else last[1])

    return Layer("".join(pieces), parent.place, origin, f"{parent.path}/{name}")


def _percent(layer: Layer) -> Layer | None:
    if "%" not in layer.text:
        return None
    runs = []
    for m in PERCENT.finditer(layer.text):
        at = m.start()
        for c in bytes.fromhex(m[0].replace("%", "")).decode("utf-8", "surrogateescape"):
            width = 3 * len(c.encode("utf-8", "surrogateescape"))
            runs.append((at, at + width, INVALID.sub("\ufffd", c)))
            at += width
    return _replaced(layer, runs, "url") if runs else None


def _escapes(layer: Layer) -> Layer | None:
    if "\\" not in layer.text and "&#" not in layer.text:
        return None
    runs = []
    for run in ESCAPE.finditer(layer.text):
        high = None
        for m in ONE_ESCAPE.finditer(run[0]):
            code = int(m[4]) if m[4] else int(m[1] or m[2] or m[3], 16)
            start, end = run.start() + m.start(), run.start() + m.end()
            if high is not None and 0xDC00 <= code <= 0xDFFF:
                code, start = 0x10000 + ((high[0] - 0xD800) << 10) + (code - 0xDC00), high[1]
                runs.pop()
            high = (code, start) if 0xD800 <= code <= 0xDBFF else None
            runs.append((start, end, chr(code) if code < 0x110000 and not 0xD800 <= code <= 0xDFFF else "\ufffd"))
    return _replaced(layer, runs, "unicode") if runs else None


def _decompressor(head: bytes):
    """A decompressor of one member that begins with ``head``, or none."""
    if head.startswith(b"\x28\xb5\x2f\xfd"):
        return zstandard.ZstdDecompressor().decompressobj()
    if head.startswith(b"BZh"):
        return bz2.BZ2Decompressor()
    if head.startswith(b"\xfd7zXZ\x00"):
        return lzma.LZMADecompressor()
    return zlib.decompressobj(47) if head.startswith(COMPRESSED) else None


def _steps(engine, piece: bytes) -> Iterator[bytes]:
    """What one piece of input gives, in pieces of bounded size where the library allows it."""
    if isinstance(engine, (bz2.BZ2Decompressor, lzma.LZMADecompressor)):
        yield engine.decompress(piece, PIECE_BYTES)
        while not engine.eof and not engine.needs_input:
            yield engine.decompress(b"", PIECE_BYTES)
    elif isinstance(engine, type(zlib.decompressobj())):
        yield engine.decompress(piece, PIECE_BYTES)
        while not engine.eof and engine.unconsumed_tail:
            yield engine.decompress(engine.unconsumed_tail, PIECE_BYTES)
    else:
        yield engine.decompress(piece)


def _inflated(pieces: Iterable[bytes], used: list[int]) -> Iterator[bytes]:
    """The content of all members that follow each other; ``used[0]`` counts the bytes read so far.

    Damaged or foreign data ends it, what came out before is kept. Bytes of zero between members are padding.
    """
    engine, rest, source = None, b"", iter(pieces)
    while True:
        if engine is None:
            while len(rest) < LONGEST_MAGIC and (more := next(source, None)) is not None:
                rest += more
                if used[0]:
                    bare = rest.lstrip(b"\0")
                    used[0] += len(rest) - len(bare)
                    rest = bare
            if used[0] and rest.startswith(b"\0"):
                bare = rest.lstrip(b"\0")
                used[0] += len(rest) - len(bare)
                rest = bare
                continue
            engine = _decompressor(rest[:LONGEST_MAGIC])
            if engine is None:
                return
        elif (more := next(source, None)) is None:
            return
        else:
            rest = more
        for at in range(0, len(rest), FEED_BYTES):
            feed = rest[at : at + FEED_BYTES]
            try:
                for out in _steps(engine, feed):
                    if out:
                        yield out
            except (OSError, ValueError, EOFError, zlib.error, lzma.LZMAError, zstandard.ZstdError):
                return
            if engine.eof:
                used[0] += len(feed) - len(engine.unused_data)
                rest, engine = engine.unused_data + rest[at + FEED_BYTES :], None
                break
            used[0] += len(feed)
        else:
            rest = b""


def _decoded(data: bytes) -> tuple[str, list[int] | None] | None:
    """Text with one replacement per byte outside UTF-8, and the byte each character begins at if they differ.

    None for data without any readable stretch: no secret, plain or encoded, is shorter than ``LEAST_STRETCH``.
    """
    text = data.decode("utf-8", "surrogateescape")
    if not text or (UNREADABLE.search(text) and not STRETCH.search(text)):
        return None
    ends = None
    if len(text) != len(data):
        ends = [0, *accumulate(len(c.encode("utf-8", "surrogateescape")) for c in text)]
    return INVALID.sub("\ufffd", text), ends


def _open_run(data: bytes, overlap: int) -> int:
    """Where the run begins that the end of ``data`` may have broken, with room for a secret before it."""
    at, space = max(data.rfind(c) for c in BETWEEN), data.rfind(b" ")
    while space > at:
        before = len(data[:space].rstrip(b" \t\r\n"))
        if b"\n" not in data[before:space]:
            at = space
            break
        space = data.rfind(b" ", 0, before)
    return max(0, at + 1 - overlap)


def _blocks(pieces: Iterable[bytes], found: Found, limit: int) -> Iterator[bytes]:
    """Overlapping blocks of about ``limit`` bytes that do not break a run shorter than four blocks."""
    held, cut, fresh = b"", False, False
    buffer, size = [], 0
    for piece in pieces:
        buffer.append(piece)
        size += len(piece)
        fresh = True
        if len(held) + size < limit:
            continue
        held, buffer, size = held + b"".join(buffer), [], 0
        while len(held) >= limit:
            keep = _open_run(held, min(OVERLAP, limit // 4))
            if keep < limit // 2:
                # a run fills the block: wait for its end, but not for ever
                if len(held) < 4 * limit:
                    break
                cut, keep = True, max(len(held) - OVERLAP, len(held) // 2)
            yield held
            held, fresh = held[keep:], False
    if fresh and (held or buffer):
        yield held + b"".join(buffer)
    found.n_cut += cut


def _pieces(data: memoryview) -> Iterator[bytes]:
    at, size = 0, FEED_BYTES
    while at < len(data):
        yield bytes(data[at : at + size])
        # most false starts end within the first piece
        at, size = at + size, PIECE_BYTES


def _uncompressed(layer: Layer, data: memoryview, path: str, place: Callable[[int], Span], found: Found, limit: int, used: list[int]) -> Iterator[Layer]:
    """Layers of compressed data, through further compression inside; ``place`` maps bytes used to a span."""
    stream: Iterator[bytes] = _inflated(_pieces(data), used)
    path, stages = f"{path}/compressed", set()
    for depth in range(MOST_NESTED + 1):
        head, more, ended = b"", [], False
        while len(head) < limit and not ended:
            more = next(stream, None)
            ended = more is None
            head += more or b""
        if not head.startswith(COMPRESSED):
            break
        if (stage := hashlib.blake2b(head).digest()) in stages:
            break
        if depth == MOST_NESTED:
            found.n_cut += 1
            break
        stages.add(stage)
        inner = _inflated(chain([head], stream), [0])
        first = next(inner, None)
        if first is None:
            break
        stream, path = chain([first], inner), f"{path}/compressed"
    for block in _blocks(chain([head], stream), found, limit):
        if (decoded := _decoded(block)) is not None:
            span = layer.origin(*place(used[0]))
            yield Layer(decoded[0], span, lambda a, b, s=span: s, path, streamed=True)


def _runs(text: str) -> Iterator[tuple[str, list[int] | None, int, int]]:
    """Letters of each base64 run, their places if they do not follow each other, start and end.

    Runs of one line come first, then those joined over line breaks (also escaped ones) and indentation.
    """
    for m in BASE64.finditer(text):
        yield m[0].rstrip("="), None, *m.span()
    for m in WRAPPED.finditer(text):
        places = [at for line in LINE.finditer(m[0]) for at in range(m.start() + line.start(), m.start() + line.end())]
        yield "".join(line[0] for line in LINE.finditer(m[0])), places, *m.span()


def _base64_layers(layer: Layer, found: Found, limit: int):
    path = f"{layer.path}/base64"
    for run, places, first, last in _runs(layer.text):
        plain = run.translate({45: "+", 95: "/"})
        # a run may begin with letters of something else (a path, a name): what follows decodes at one of four offsets
        for offset in range(4):
            size = len(plain) - offset
            size -= size % 4 == 1
            data = base64.b64decode(plain[offset : offset + size] + "=" * (-size % 4)) if size > 0 else b""

            def chars(x: int, y: int, f=first + offset, offset=offset, places=places) -> Span:
                """The letters that carry bytes x to y."""
                start, end = x * 8 // 6, -(-y * 8 // 6)
                return (places[offset + start], places[offset + end - 1] + 1) if places else (f + start, f + end)

            whole, inflated, done = offset == 0, False, 0
            for magic in MAGIC.finditer(data):
                # letters come in fours, so a payload that begins with a letter at this offset begins with a third byte
                if magic.start() % 3 or magic.start() < done:
                    continue
                at, used = magic.start(), [0]

                def place(n: int, at=at, chars=chars, end=last, size=len(data)) -> Span:
                    start = chars(at, at + 1)[0]
                    return start, end

                for inner in _uncompressed(layer, memoryview(data)[at:], path, place, found, limit, used):
                    inflated = True
                    yield inner
                done = at + used[0] if inflated else 0
            decoded = _decoded(data)
            # inside a payload nothing is text, and a run that is all text needs no other offset
            if decoded is not None and not (inflated and whole and data.startswith(COMPRESSED)):
                text, ends = decoded

                def origin(a: int, b: int, chars=chars, ends=ends) -> Span:
                    return layer.origin(*chars(*((ends[a], ends[b]) if ends else (a, b))))

                yield Layer(text, layer.origin(first, last), origin, path)
            if whole and (inflated and data.startswith(COMPRESSED) or decoded is not None and not UNREADABLE.search(decoded[0])):
                break


def _escaped_bytes(layer: Layer, found: Found, limit: int) -> Iterator[Layer]:
    """Layers of compressed data written as percent or other escapes, with plain letters between them."""
    text = layer.text
    for name, start, unit, quick in (("url", PERCENT_MAGIC, PERCENT_UNIT, "%"), ("unicode", ESCAPE_MAGIC, ESCAPE_UNIT, ("\\", "&#"))):
        if not any(q in text for q in quick):
            continue
        done, places, forms = 0, [0], []
        for begin in start.finditer(text):
            first = begin.start()
            if first < done:
                continue
            if first >= places[-1]:
                # the stretch is decoded once, however many starts are in it; a literal ends at the quote it began with
                quote = text[first - 1] if first and text[first - 1] in "\"'" else ""
                values, places = bytearray(), [first]
                while (m := unit.match(text, places[-1])) is not None and (not quote or m[0] != quote):
                    value = _unit_value(m[0])
                    if value is None:
                        break
                    values.append(value)
                    places.append(m.end())
                # a plus is a space in forms; elsewhere it may be itself
                data = bytes(values)
                forms = [data.replace(b"+", b" "), data] if name == "url" and b"+" in data else [data]
            at = bisect_right(places, first) - 1
            for form in forms:
                if not form.startswith(COMPRESSED, at):
                    continue
                used = [0]
                span = lambda n, f=first, at=at, places=places: (f, places[at + n] if n else places[-1])
                for inner in _uncompressed(layer, memoryview(form)[at:], f"{layer.path}/{name}", span, found, limit, used):
                    yield inner
                    done = max(done, places[at + used[0]])


def _unit_value(unit: str) -> int | None:
    """The byte that a percent escape, another escape or a plain letter stands for."""
    if unit[0] == "%" and len(unit) == 3:
        return int(unit[1:], 16)
    if len(unit) == 1:
        return ord(unit)
    if (m := ONE_ESCAPE.fullmatch(unit)) is not None:
        code = int(m[4]) if m[4] else int(m[1] or m[2] or m[3], 16)
        return code if code < 256 else None
    return SHORT.get(unit[1])


def _inner_layers(layer: Layer, found: Found, limit: int) -> Iterator[Layer]:
    yield from (x for x in (_percent(layer), _escapes(layer)) if x is not None)
    yield from _escaped_bytes(layer, found, limit)
    yield from _base64_layers(layer, found, limit)


def find_secrets(text: str, max_layer_bytes: int = MAX_LAYER_BYTES) -> Found:
    """Base spans and the spans that decoded layers add."""
    found = Found(scan(text))
    base = set(found.base)
    seen: set = set()

    def work(layers: Iterable[Layer]) -> None:
        waiting = deque([layers])
        while waiting:
            for layer in waiting.popleft():
                if layer.path:
                    mark = (hashlib.blake2b(layer.text.encode("utf-8", "surrogatepass"), digest_size=16).digest(), layer.place)
                    if mark in seen:
                        continue
                    seen.add(mark)
                    found.n_layers += 1
                    for kind, a, b in scan(layer.text):
                        span = (kind, *layer.origin(a, b))
                        if span not in base:
                            found.added.setdefault(span, layer.path[1:])
                inner = _inner_layers(layer, found, max_layer_bytes)
                if layer.streamed:
                    # a block is done with before the next one is read
                    work(inner)
                else:
                    waiting.append(inner)

    work([Layer(text, (0, len(text)), lambda a, b: (a, b))])
    return found


def masked(text: str, spans, mark: str = "[SECRET]") -> str:
    """The text with every span (overlapping ones joined) replaced by one mark."""
    out, done, last = [], 0, 0
    for _, start, end in sorted(spans, key=lambda s: s[1]):
        if start >= last:
            out += [text[done:start], mark]
        last = done = max(last, end)
    return "".join(out) + text[done:]


SCHEMA = (
    "n_assign long, n_access long, n_hex long, base_sha256 string, spans string, "
    "n_layers long, n_added long, n_cut long, added_by string, masked string"
)


def scan_secrets(docs: DataFrame, with_masked: bool = False, max_layer_bytes: int = MAX_LAYER_BYTES) -> DataFrame:
    """One row per document; one pass over the texts, no shuffle.

    ``masked`` holds the text without its secrets if ``with_masked``, else null.
    """
    bounded_batches(docs.sparkSession)

    @F.pandas_udf(SCHEMA)
    def secrets(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for text in texts:
            found = find_secrets(text, max_layer_bytes)
            every = in_order([*found.base, *found.added])
            kinds = [kind for kind, _, _ in found.base]
            rows.append(
                (
                    *(kinds.count(kind) for kind in KINDS),
                    hashlib.sha256(joined(found.base).encode()).hexdigest(),
                    joined(every),
                    found.n_layers,
                    len(found.added),
                    found.n_cut,
                    ",".join(found.added[s] for s in in_order(found.added)),
                    (masked(text, every) if every else text) if with_masked else None,
                )
            )
        return pd.DataFrame(rows, columns=[c.split()[0] for c in SCHEMA.split(", ")])

    return id_and_text(docs).select("doc_id", secrets("text").alias("found")).select("doc_id", "found.*")


def mask_documents(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: every document stays, its secrets are replaced, ``n_chars`` follows."""
    bounded_batches(spark)

    @F.pandas_udf("string")
    def without(texts: pd.Series) -> pd.Series:
        def clean(text: str) -> str:
            found = find_secrets(text)
            return masked(text, [*found.base, *found.added])

        return texts.map(clean)

    text = F.when(F.col("text").isNotNull(), without(F.coalesce("text", F.lit(""))))
    return (
        docs.withColumn("text", text)
        .withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars")))
        .select("doc_id", "text", "lang", "source", "n_chars")
    )


@query("op2_secret_scans")
def op2_secret_scans(spark, sf_dir):
    return scan_secrets(table(spark, sf_dir, "documents")).drop("masked")
