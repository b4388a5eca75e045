"""Numeric and timestamp column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

_NUMBER_TEXT = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"
# a date (calendar or ISO week, basic or extended), any separator, a time with hours at least, an offset or Z
_DATE = r"(\d{4})(?:-(\d{2})-(\d{2})|(\d{2})(\d{2})|-W(\d{2})(?:-(\d))?|W(\d{2})(\d)?)"
_CLOCK = r"(\d{2})(?::(\d{2})(?::(\d{2})(?:[.,](\d*))?)?|(\d{2})(?:(\d{2})(?:[.,](\d*))?)?)?"
_OFFSET = r"(?:(Z)|([+-])(\d{2})(?::(\d{2})(?::(\d{2})(?:[.,](\d*))?)?|(\d{2})(?:(\d{2})(?:[.,](\d*))?)?)?)"
#: what the engine's own cast reads
_USUAL_TS = r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(?::\d{2}(?:[.,]\d{1,6})?)?(?:Z|[+-]\d{2}(?::?\d{2})?)$"
_AWARE_TS = rf"^{_DATE}(?s:.){_CLOCK}{_OFFSET}$"
_NAIVE_TS = rf"^{_DATE}(?:(?s:.){_CLOCK})?$"


def clean_number(value: Column, text: bool = False) -> Column:
    """Finite double rounded to eight places, or null.

    ``text=True`` guards string input: the JVM parser would accept ``1d``.
    """
    number = value.try_cast("double")
    if text:
        number = F.when(value.rlike(_NUMBER_TEXT), number)
    finite = ~F.isnan(number) & (F.abs(number) != F.lit(float("inf")))
    # what the usual rounding leaves as it is has eight places at most
    near = F.round(number, 8)
    return F.when(finite, F.when(near == number, near).otherwise(_eight_places(number)))


def given(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _eight_places(value: Column) -> Column:
    """The double nearest to the value's exact binary expansion rounded to eight places, ties to even.

    From 2**26 on doubles lie farther apart than the places reach. Below, the fraction is cut into
    34, 26 and the last bits, so that each product with 10**8 is exact; the sum of the last two steps
    is only asked for its sign, which floating point gets right.
    """
    scale = F.lit(1e8)
    cut = lambda x, bits: F.floor(x * F.lit(float(2**bits))).cast("double") / F.lit(float(2**bits))

    def whole_part(v: Column) -> Column:
        whole = F.floor(F.abs(v)).cast("double")
        return F.struct(v.alias("v"), whole.alias("whole"), (F.abs(v) - whole).alias("fraction"))

    def pieces(x: Column) -> Column:
        first = cut(x["fraction"], 34)
        return F.struct(x["v"].alias("v"), x["whole"].alias("whole"), first.alias("first"), (x["fraction"] - first).alias("rest"))

    def steps(x: Column) -> Column:
        down = F.floor(x["first"] * scale).cast("double")
        second = cut(x["rest"], 60)
        tie = ((x["first"] * scale - down) - F.lit(0.5) + second * scale) + (x["rest"] - second) * scale
        return F.struct(x["v"].alias("v"), (x["whole"] * scale + down).alias("down"), tie.alias("tie"))

    def result(x: Column) -> Column:
        up = (x["tie"] > 0) | ((x["tie"] == 0) & (x["down"] % 2 == 1))
        rounded = (x["down"] + F.when(up, 1.0).otherwise(0.0)) / scale
        return F.when(F.abs(x["v"]) >= F.lit(float(2**26)), x["v"]).otherwise(F.when(x["v"] < 0, -rounded).otherwise(rounded))

    return given(given(given(given(value, whole_part), pieces), steps), result)


def round_half_even(value: Column, places: int) -> Column:
    """Correctly rounded decimal places with exact binary ties going to even.

    The fraction is split so that both products with ``10**places`` are exact;
    only the sign of their sum decides, hence no double-rounding error. Good to
    six places. ``value`` should be a plain column: it is referenced repeatedly.
    """
    scale = float(10**places)
    whole = F.floor(value).cast("double")
    fraction = value - whole
    high = F.floor(fraction * F.lit(67108864.0)).cast("double") / F.lit(67108864.0)
    low = fraction - high
    scaled = high * F.lit(scale)
    down = F.floor(scaled).cast("double")
    tie = ((scaled - down) - F.lit(0.5)) + low * F.lit(scale)
    up = (tie > 0) | ((tie == 0) & (down % 2 == 1))
    return (whole * F.lit(scale) + down + F.when(up, 1.0).otherwise(0.0)) / F.lit(scale)


def round_half_even_sql(value: str, places: int) -> str:
    """The same arithmetic as SQL text; ``value`` names a DOUBLE column."""
    scale = f"CAST({10**places} AS DOUBLE)"
    split = "CAST(67108864 AS DOUBLE)"
    whole = f"floor({value})"
    high = f"(floor(({value} - {whole}) * {split}) / {split})"
    down = f"floor({high} * {scale})"
    tie = (
        f"((({high} * {scale}) - {down}) - CAST(0.5 AS DOUBLE) "
        f"+ (({value} - {whole}) - {high}) * {scale})"
    )
    return (
        f"(({whole} * {scale} + {down} + CASE WHEN {tie} > 0 OR ({tie} = 0 AND "
        f"CAST({down} AS BIGINT) % 2 = 1) THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END) / {scale})"
    )


def percent(part: Column, total: Column) -> Column:
    """``part / total * 100`` unrounded; 0.0 for an empty total."""
    ratio = part.cast("double") / F.nullif(total.cast("double"), F.lit(0.0)) * F.lit(100.0)
    return F.coalesce(ratio, F.lit(0.0))


def percent_sql(part: str, total: str) -> str:
    return (
        f"coalesce(CAST({part} AS DOUBLE) / nullif(CAST({total} AS DOUBLE), CAST(0 AS DOUBLE)) "
        f"* CAST(100 AS DOUBLE), CAST(0 AS DOUBLE))"
    )


def _groups(text: Column, pattern: str, count: int) -> Column:
    """All groups of a matching text, empty where one took no part."""
    return F.split(F.regexp_replace(text, pattern, "|".join(f"${k}" for k in range(1, count + 1))), r"\|", -1)


def _days(part: Column) -> Column:
    """Days since the epoch of the nine groups of a date, or null."""
    number = lambda k: part[k - 1].try_cast("int")
    calendar = F.concat(part[0], F.lit("-"), part[1], part[3], F.lit("-"), part[2], part[4])
    week, day = F.coalesce(number(6), number(8)), F.coalesce(number(7), number(9), F.lit(1))
    # week 1 holds January 4; the last week of a year holds December 28
    fourth = F.concat(part[0], F.lit("-01-04")).try_cast("date")
    last = F.weekofyear(F.concat(part[0], F.lit("-12-28")).try_cast("date"))
    by_week = F.when((week >= 1) & (week <= last) & day.between(1, 7), F.unix_date(fourth) - F.weekday(fourth) + (week - 1) * 7 + day - 1)
    return F.when(week.isNull(), F.unix_date(calendar.try_cast("date"))).otherwise(by_week)


def _clock_micros(part: Column, at: int) -> Column:
    """Microseconds of the seven groups of a clock, or null; digits beyond six are cut."""
    number = lambda a, b: F.coalesce(F.concat(part[at + a], part[at + b]).try_cast("bigint"), F.lit(0))
    hours = part[at].try_cast("bigint")
    micros_ = F.rpad(F.substring(F.concat(part[at + 3], part[at + 6]), 1, 6), 6, "0").try_cast("bigint")
    total = ((hours * 60 + number(1, 4)) * 60 + number(2, 5)) * 1000000 + micros_
    return F.when((hours <= 23) & (number(1, 4) <= 59) & (number(2, 5) <= 59), total)


def parse_aware_ts(value: Column) -> Column:
    """ISO-8601 text with an explicit offset -> UTC timestamp, else null.

    Basic and extended forms, week dates, hours alone, any one-character separator, fractions of any
    length (cut to microseconds) and offsets with seconds are read. The usual form takes a plain cast.
    """
    text = F.trim(value)
    usual = F.regexp_replace(F.translate(text, ",", "."), r"([T ]\d{2}:\d{2})(Z|[+-])", "$1:00$2").try_cast("timestamp")

    def stamp(part: Column) -> Column:
        sign = F.when(part[17] == "-", -1).otherwise(1)
        shift = F.when(part[16] == "Z", F.lit(0)).otherwise(_clock_micros(part, 18) * sign)
        return F.timestamp_micros(_days(part).cast("bigint") * 86400000000 + _clock_micros(part, 9) - shift)

    other = given(_groups(text, _AWARE_TS, 25), stamp)
    return F.when(text.rlike(_USUAL_TS), usual).otherwise(F.when(text.rlike(_AWARE_TS), other))


def aware_ts_error(value: Column, parsed: Column) -> Column:
    """``empty`` / ``naive`` / ``invalid`` or null when the text was parsed."""
    text = F.trim(value)

    def dated(part: Column) -> Column:
        return _days(part).isNotNull() & ((part[9] == "") | _clock_micros(part, 9).isNotNull())

    naive = F.when(text.rlike(_NAIVE_TS), given(_groups(text, _NAIVE_TS, 16), dated))
    return F.when(
        parsed.isNull(),
        F.when(value.isNull() | (text == ""), "empty").when(naive, "naive").otherwise("invalid"),
    )


def epoch_to_ts(value: Column) -> Column:
    """Epoch integer in s, ms or us -> timestamp; the magnitude tells the unit."""
    return (
        F.when(value >= F.lit(10**14), F.timestamp_micros(value))
        .when(value >= F.lit(10**11), F.timestamp_millis(value))
        .otherwise(F.timestamp_seconds(value))
    )


def micros(ts: Column) -> Column:
    """Microseconds since the epoch; wall-clock columns are UTC."""
    return F.unix_micros(ts.cast("timestamp"))


def seconds_between(later: Column, earlier: Column) -> Column:
    return (micros(later) - micros(earlier)).cast("double") / F.lit(1000000.0)


def time_bucket(ts: Column, width_seconds: Column | int) -> Column:
    """Ordinal of the fixed-width bucket that holds ``ts``."""
    width = width_seconds if isinstance(width_seconds, Column) else F.lit(width_seconds)
    return F.floor(micros(ts).cast("double") / (width.cast("double") * F.lit(1000000.0)))
