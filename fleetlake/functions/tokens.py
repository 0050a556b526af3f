"""Column functions for the text cells of a CSV record (all JVM-side).

Each function takes and returns a ``Column`` so it can sit inside one
whole-stage-codegen projection; nothing here runs Python per row.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from fleetlake.schema import NULL_TOKENS

# Characters removed by ``strip`` around a cell: space, tab, LF, VT, FF, CR.
STRIP_CHARS = " \t\n\x0b\x0c\r"

# Text accepted as a float: sign, digits with single underscores between
# digits, optional fraction and exponent; or inf / infinity / nan.
# Groups repeat possessively: the engine loops over them instead of recursing,
# so a cell of any length is matched in constant stack.
_DIGITS = r"\d++(?:_\d++)*+"
NUMBER_PATTERN = rf"^[+-]?+(?:{_DIGITS}(?:\.(?:{_DIGITS})?+)?+|\.{_DIGITS})(?:[eE][+-]?+{_DIGITS})?+$"
SPECIAL_NUMBER_PATTERN = r"(?i)^[+-]?(?:inf|infinity|nan)$"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Column | str) -> Column:
    """Remove leading/trailing ASCII whitespace (plain ``trim`` only drops spaces)."""
    return F.btrim(_col(c), F.lit(STRIP_CHARS))


def is_null_token(c: Column | str) -> Column:
    """True for NULL or a null token after strip, case-blind. Never NULL itself."""
    c = _col(c)
    return c.isNull() | F.upper(strip(c)).isin(*NULL_TOKENS)


def is_number_text(text: Column) -> Column:
    """True when stripped ``text`` is a float literal in the contract's grammar."""
    return text.rlike(NUMBER_PATTERN) | text.rlike(SPECIAL_NUMBER_PATTERN)


def parse_number(text: Column) -> Column:
    """Already-stripped text → double by the contract's grammar, else NULL.

    ``try_cast`` alone would also take ``1d``, ``1.0f`` and ``0x1p3``, and it
    rejects ``-nan``; special values are therefore mapped explicitly."""
    return (
        F.when(text.rlike(NUMBER_PATTERN), F.replace(text, F.lit("_"), F.lit("")).try_cast("double"))
        .when(text.rlike(r"(?i)^[+-]?nan$"), F.lit(float("nan")))
        .when(text.rlike(r"(?i)^-inf(inity)?$"), F.lit(float("-inf")))
        .when(text.rlike(r"(?i)^\+?inf(inity)?$"), F.lit(float("inf")))
    )


def to_double(c: Column | str) -> Column:
    """Text → double after strip, NULL when it is not a number (see ``parse_number``)."""
    return parse_number(strip(_col(c)))


def nullable_float(c: Column | str) -> Column:
    """Null token → NULL, else the number (NULL also when not numeric; see below)."""
    return F.when(~is_null_token(c), to_double(c))


def nullable_float_error(c: Column | str) -> Column:
    """P2 error flag: not a null token and not a number."""
    return ~is_null_token(c) & to_double(c).isNull()


def nullable_string(c: Column | str) -> Column:
    """Null token → NULL, else the stripped text."""
    return F.when(~is_null_token(c), strip(c))


def is_blank(c: Column | str) -> Column:
    """NULL or only whitespace."""
    c = _col(c)
    return c.isNull() | (strip(c) == F.lit(""))


def required_float(c: Column | str) -> Column:
    """Number, or NULL when blank or not numeric. ``NULL`` text is not a null here."""
    return F.when(~is_blank(c), to_double(c))


def required_float_reason(c: Column | str, name: str) -> Column:
    """P4 reason: ``<name>_empty``, ``<name>_not_numeric`` or NULL when fine."""
    return (
        F.when(is_blank(c), F.lit(f"{name}_empty"))
        .when(to_double(c).isNull(), F.lit(f"{name}_not_numeric"))
    )


def normalise_shift_state(c: Column | str) -> Column:
    """Strip, blank → NULL, upper."""
    return F.upper(F.nullif(strip(c), F.lit("")))
