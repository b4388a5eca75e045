"""Text column expressions.

Patterns carry ``(?U)`` so that digit and space classes cover every script; word
characters are spelled out as letters, numbers and underscore, because the JVM's
Unicode ``\\w`` also takes in marks and joiners.
"""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from hindcast import fixed_values as fv
from hindcast.functions.numbers import given

ZWNJ = "\u200c"
_WHITE = r"[\s\x1c-\x1f]"
#: a run of white space of any script that is not one blank already
SPACE = rf"(?U){_WHITE}(?:(?<! ){_WHITE}*|{_WHITE}+)"
#: the characters of that class
WHITE = "\t\n\x0b\f\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
LINE_BREAK = r"\r\n|[\n\r\x0B\f\x1c-\x1e\x85\u2028\u2029]"
#: every break but the line feed, and some characters more: few ranges are searched faster
_ODD_BREAK = r"[\x0b-\x1e\x85\u2028\u2029]"
WORD_CHARS = r"\p{L}\p{N}_"
WORD = rf"[{WORD_CHARS}\u0600-\u06ff]+"


def spelled(pattern: str) -> str:
    """A pattern with ``\\w`` spelled out."""
    return pattern.replace(r"[\w", f"[{WORD_CHARS}").replace(r"\w", f"[{WORD_CHARS}]")


def collapse(value: Column) -> Column:
    """Runs of whitespace become one blank; ends are trimmed."""
    return F.trim(F.regexp_replace(value, SPACE, " "))


def strip(value: Column) -> Column:
    return F.btrim(value, F.lit(WHITE))


def search_text(value: Column) -> Column:
    return collapse(F.lower(F.translate(F.coalesce(value, F.lit("")), ZWNJ, " ")))


def python_search_text(value: str) -> str:
    """``search_text`` for configuration literals."""
    return re.sub(r"\s+", " ", value.replace(ZWNJ, " ").lower()).strip()


def any_keyword_pattern(words: list[str]) -> str:
    """Whole-word alternation over normalized keywords."""
    quoted = [r"\Q" + python_search_text(w) + r"\E" for w in words if python_search_text(w)]
    return spelled(r"(?<!\w)(?:" + "|".join(quoted) + r")(?!\w)")


TOKEN = rf"[{WORD_CHARS}]+|[^{WORD_CHARS}]"


def tokens_of(value: Column) -> Column:
    """Runs of word characters and every other character by itself; joined they are the text again."""
    return F.regexp_extract_all(value, F.lit(TOKEN), F.lit(0))


def python_tokens(value: str) -> list[str]:
    """``tokens_of`` for configuration literals."""
    out: list[str] = []
    after_word = False
    for c in value:
        word = c == "_" or unicodedata.category(c)[0] in "LN"
        if word and after_word:
            out[-1] += c
        else:
            out.append(c)
        after_word = word
    return out


def are_words(tokens: Column) -> Column:
    """Per token whether it is a run of word characters."""
    return F.transform(tokens, lambda token: token.rlike(f"^[{WORD_CHARS}]"))


def whole_word_grams(tokens: Column, words: Column, lengths: list[int]) -> Column:
    """Distinct runs of so many tokens that neither begin nor end inside a word.

    A run that begins or ends with another character must not have a word on that side: the same runs that a
    pattern with negative look-arounds for word characters can match. ``words`` is the column of ``are_words``, so that
    every token is judged once and not at each end of each length.
    """
    nothing = F.array().cast("array<string>")

    def runs(n: int) -> Column:
        def edge_free(at: Column, outside: Column) -> Column:
            return F.get(words, at) | ~F.coalesce(F.get(words, outside), F.lit(False))

        starts = F.filter(
            F.sequence(F.lit(0), F.size(tokens) - n), lambda i: edge_free(i, i - 1) & edge_free(i + (n - 1), i + n)
        )
        whole = F.transform(starts, lambda i: F.array_join(F.slice(tokens, i + 1, n), ""))
        return F.when(F.size(tokens) >= n, whole).otherwise(nothing)

    return F.array_distinct(F.concat(nothing, *[runs(n) for n in lengths]))


def normalize_evidence(value: Column) -> Column:
    return collapse(F.translate(value, ZWNJ, " "))


# every decimal digit of Unicode besides 0-9, with its value
_DIGITS = [chr(c) for c in range(128, 0x20000) if unicodedata.category(chr(c)) == "Nd"]
_DIGIT_VALUES = "".join(str(unicodedata.digit(c)) for c in _DIGITS)


def ascii_digits(value: Column) -> Column:
    """Decimal digits of any script as 0-9."""
    foreign = value.rlike(r"[\p{Nd}&&[^0-9]]")
    return F.when(foreign, F.translate(value, "".join(_DIGITS), _DIGIT_VALUES)).otherwise(value)


def lines_of(value: Column) -> Column:
    """Line array; a final line break does not open another line.

    ``value`` should be a plain column: it is referenced repeatedly. A pattern for all line breaks is
    tried at every character, so texts that have only line feeds are split without one.
    """
    last = F.right(value, F.lit(1))
    cut = F.when(value.endswith("\r\n"), 2).when(last.rlike(LINE_BREAK), 1).otherwise(0)
    body = F.substring(value, F.lit(1), F.length(value) - cut)
    lines = F.when(value.rlike(_ODD_BREAK), F.split(body, LINE_BREAK)).otherwise(F.split(body, "\n"))
    return F.when(value == "", F.array().cast("array<string>")).otherwise(lines)


def number_line(position: Column, line: Column) -> Column:
    """``L0001: text`` from a zero-based position."""
    return F.concat(F.format_string("L%04d: ", position + 1), line)


def normalize_horizon(value: Column) -> Column:
    """24, 48 or null; exactly one horizon family must match."""
    text = F.lower(normalize_evidence(ascii_digits(value)))
    matches = {
        hours: text.rlike("(?iU)" + spelled("|".join(patterns))) for hours, patterns in fv.HORIZON_PATTERNS.items()
    }
    return F.when(
        ~text.rlike("(?iU)" + fv.HORIZON_RANGE) & (matches[24] != matches[48]),
        F.when(matches[24], 24).otherwise(48),
    )


def has_text(value: Column) -> Column:
    """Non-null and not only whitespace."""
    return F.coalesce(value.rlike(r"(?U)[^\s\x1c-\x1f]"), F.lit(False))


def strip_line_labels(value: Column) -> Column:
    return F.regexp_replace(value, r"(?mU)^\s*L\d{4}:\s*", "")


def evidence_tokens(value: Column) -> Column:
    return F.regexp_extract_all(
        F.lower(normalize_evidence(strip_line_labels(value))), F.lit(WORD), F.lit(0)
    )


def numeric_tokens(value: Column) -> Column:
    """Distinct canonical decimals in the text, in first-seen order."""
    found = F.regexp_extract_all(ascii_digits(value), F.lit("(?U)" + spelled(fv.NUMBER_PATTERN)), F.lit(0))

    def canonical(raw: Column) -> Column:
        plain = F.translate(F.translate(raw, ",٬+", ""), "٫", ".")
        trimmed = F.regexp_replace(plain, r"^(-?)0+(?=\d)", "$1")
        return F.when(
            trimmed.contains("."), F.regexp_replace(trimmed, r"\.?0+$", "")
        ).otherwise(trimmed)

    return F.array_distinct(F.transform(found, canonical))


def level_numbers(levels: Column) -> Column:
    """Price levels as distinct doubles in first-seen order."""
    marker = "|".join(re.escape(m) for m in fv.NON_PRICE_MARKERS)
    texts = F.filter(
        F.transform(levels, lambda v: F.translate(ascii_digits(v), ",٬", "")),
        lambda v: ~F.lower(v).rlike(marker),
    )
    numbers = F.flatten(
        F.transform(texts, lambda v: F.regexp_extract_all(v, F.lit(r"(?U)-?\d+(?:\.\d+)?"), F.lit(0)))
    )
    return F.array_distinct(F.transform(numbers, lambda v: v.try_cast("double")))


def is_price_level(value: Column) -> Column:
    return ~value.rlike("(?i)" + fv.NON_PRICE_LEVEL)


def instruction_like(value: Column) -> Column:
    return value.rlike("(?iU)" + fv.INSTRUCTION_LIKE)


def clean_caption(value: Column) -> Column:
    """Caption line without tags and style overrides. ``value`` should be a plain column."""
    untagged = F.regexp_replace(F.regexp_replace(value, r"<[^>]+>", ""), r"\{\\.*?\}", "")
    return collapse(F.when(value.contains("<") | value.contains("{"), untagged).otherwise(value))


def cue_seconds(value: Column) -> Column:
    """``[h:]mm:ss[,.]mmm`` -> seconds."""

    def seconds(parts: Column) -> Column:
        number = lambda at: F.try_element_at(parts, F.lit(at)).try_cast("double")
        tail = number(-1) + number(-2) * 60.0
        hours = F.when(F.size(parts) > 2, number(1)).otherwise(0.0)
        return F.round(hours * 3600.0 + tail, 3)

    return given(F.split(F.translate(ascii_digits(value), ",", "."), ":"), seconds)


def srt_time(seconds: Column) -> Column:
    """Seconds -> ``hh:mm:ss,mmm``."""
    ms = F.greatest(F.rint(seconds * 1000.0).cast("bigint"), F.lit(0))
    part = lambda unit, size: F.floor(ms / unit) % size
    return F.format_string(
        "%02d:%02d:%02d,%03d", F.floor(ms / 3600000), part(60000, 60), part(1000, 60), ms % 1000
    )


def format_evidence_numbers(value: Column) -> Column:
    """Decimals with three or more places become ``1,234.57``; a plus sign stays."""
    pattern = "(?U)" + spelled(r"(?<![\w.])([+-]?\d+\.\d{3,})(?![\w.])")
    pieces = F.split(value, pattern, -1)
    numbers = F.regexp_extract_all(value, F.lit(pattern), F.lit(1))

    def shown(piece: Column, number: Column) -> Column:
        sign = F.when(number.startswith("+"), "+").otherwise("")
        return F.concat(piece, F.coalesce(F.concat(sign, F.format_number(ascii_digits(number).try_cast("double"), 2)), F.lit("")))

    return F.array_join(F.zip_with(pieces, numbers, shown), "")


def compact_to_iso(value: Column) -> Column:
    return F.when(value.rlike(r"^\d{8}$"), F.regexp_replace(value, r"^(....)(..)(..)$", "$1-$2-$3"))
