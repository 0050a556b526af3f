"""Timestamp parsing and formatting columns (session time zone must be UTC)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from fleetlake.functions.tokens import strip

_OFFSET = r"(?:Z|[+-]\d{2}(?::?\d{2}(?::\d{2})?)?)?"
# What Spark's cast reads as it stands: an extended date, optionally ``T`` or a
# space, HH:MM:SS, a ``.`` fraction of any length, and ``Z`` or an offset ±HH,
# ±HHMM, ±HH:MM, ±HH:MM:SS. Nearly all text is of this form.
FULL_TIMESTAMP_PATTERN = rf"^\d{{4}}-\d{{2}}-\d{{2}}(?:[T ]\d{{2}}:\d{{2}}:\d{{2}}(?:\.\d+)?{_OFFSET})?$"
# All ISO 8601 accepted by the contract, those above included: an extended or
# basic date (20260721), optionally any one character that is not a digit and a
# time, extended or basic, of hours alone, without seconds, or with a ``.``/``,``
# fraction, then ``Z`` or an offset. Week dates are not accepted.
ISO_TIMESTAMP_PATTERN = (
    r"^(?:\d{4}-\d{2}-\d{2}|\d{8})"
    rf"(?:\D(?:\d{{2}}(?::\d{{2}}(?::\d{{2}}(?:[.,]\d+)?)?)?|\d{{4}}(?:\d{{2}}(?:[.,]\d+)?)?){_OFFSET})?$"
)
# The two patterns of the streaming path, tried in order.
STREAM_TIMESTAMP_PATTERNS = ("yyyy-MM-dd HH:mm:ss.SSS", "yyyy-MM-dd'T'HH:mm:ss.SSSXXX")


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


# Spark's cast needs seconds before an offset; Python's parser does not.
_HOUR_ONLY = r"^(\d{4}-\d{2}-\d{2}[T ]\d{2})(?=[Z+-]|$)"
_NO_SECONDS = r"^(\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2})(?=[Z+-]|$)"


def _as_full(text: Column) -> Column:
    """Text of ``ISO_TIMESTAMP_PATTERN`` in the full form."""
    for pattern, form in (
        (r"^(\d{4})(\d{2})(\d{2})", "$1-$2-$3"),
        (r"^(.{10})\D", "$1T"),
        (r"^(.{11}\d{2})(\d{2})(\d{2})", "$1:$2:$3"),
        (r"^(.{11}\d{2})(\d{2})", "$1:$2"),
        (_HOUR_ONLY, "$1:00:00"),
        (_NO_SECONDS, "$1:00"),
    ):
        text = F.regexp_replace(text, pattern, form)
    return F.translate(text, ",", ".")


def iso_to_timestamp(text: Column) -> Column:
    """Already-stripped ISO text → timestamp (see ``ISO_TIMESTAMP_PATTERN``):
    text of another form is first brought to the full one (missing minutes and
    seconds filled in, a ``,`` fraction with ``.``), then one cast reads it
    (offsets applied, naive = session zone). NULL for the year 0000 and for
    instants outside the years 1 to 9999 in UTC, which have no value in Python,
    JSON exports or most databases; an offset can lead out of them only from
    the first and the last year, so only there is the instant looked at."""
    full = F.when(text.rlike(FULL_TIMESTAMP_PATTERN), text).when(text.rlike(ISO_TIMESTAMP_PATTERN), _as_full(text))
    read = full.try_cast("timestamp")
    at_the_ends = text.startswith("0001") | text.startswith("9999")
    inside = ~at_the_ends | (F.year(read) % 10_000 != 0)
    return F.when(~text.startswith("0000") & inside, read)


def parse_iso_timestamp(c: Column | str) -> Column:
    """P5: ISO text → timestamp; naive text is UTC; NULL when not accepted."""
    return iso_to_timestamp(strip(_col(c)))


def parse_with_patterns(c: Column | str, patterns: tuple[str, ...] = STREAM_TIMESTAMP_PATTERNS) -> Column:
    """First pattern that parses wins (``try_to_timestamp`` never raises under ANSI)."""
    c = _col(c)
    return F.coalesce(*[F.try_to_timestamp(c, F.lit(p)) for p in patterns])


MICROS_PER_HOUR = 3_600_000_000


def hour_bucket(c: Column | str) -> Column:
    """Start of the UTC hour.

    Computed on epoch microseconds, so it is a UTC hour whatever the session
    zone (``date_trunc`` would follow the zone the plan was analysed in)."""
    micros = F.unix_micros(_col(c))
    return F.timestamp_micros(micros - F.pmod(micros, F.lit(MICROS_PER_HOUR)))


def iso_text(c: Column | str) -> Column:
    """ISO text as Python's ``isoformat`` writes it for an aware UTC value:
    no fraction when it is zero, else six digits, offset ``+00:00``."""
    c = _col(c)
    whole = F.date_format(c, "yyyy-MM-dd'T'HH:mm:ssxxx")
    with_fraction = F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSSxxx")
    has_fraction = (F.unix_micros(c) % F.lit(1_000_000)) != F.lit(0)
    return F.when(c.isNull(), F.lit(None).cast("string")).when(has_fraction, with_fraction).otherwise(whole)
