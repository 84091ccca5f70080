"""Numeric column expressions used by the normaliser and every report.

All of them are plain Catalyst expressions (regex match, cast, round,
divide), so they stay inside whole-stage codegen; no Python runs per row.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The spellings a document leaf may have and still count as a
# number -- plain decimals and scientific notation, plus the NaN / infinity
# words in any case, optionally signed.  Everything else (containers rendered
# as JSON text, booleans, blanks, thousands separators, hex, Java type
# suffixes such as "1d" that a bare cast would accept) is not a number.
NUMBER_PATTERN = r"^\s*[+-]?((\d+\.?\d*|\.\d+)([eE][+-]?\d+)?|(?i:nan|inf|infinity))\s*$"
DECIMAL_PATTERN = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"
NAN_WORDS = ("nan", "+nan", "-nan")
POSITIVE_INFINITY_WORDS = ("inf", "+inf", "infinity", "+infinity")
NEGATIVE_INFINITY_WORDS = ("-inf", "-infinity")


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strict_double(c: Column | str) -> Column:
    """Text -> DOUBLE, NULL unless the whole text is a number (``NUMBER_PATTERN``).

    Plain numbers are cast; the NaN / infinity words map to their values
    directly, so their accepted spellings do not depend on the cast.  Arrays
    and objects reach us as JSON text (``[1,2]``, ``{"x":1}``) and can never
    match, so they are rejected along with every other non-numeric shape.
    """
    c = _col(c)
    word = F.lower(F.regexp_replace(c, r"^\s+|\s+$", ""))
    return (
        F.when(c.rlike(DECIMAL_PATTERN), c.try_cast("double"))
        .when(word.isin(*NAN_WORDS), F.lit(float("nan")))
        .when(word.isin(*POSITIVE_INFINITY_WORDS), F.lit(float("inf")))
        .when(word.isin(*NEGATIVE_INFINITY_WORDS), F.lit(float("-inf")))
    )


def stable_round(c: Column | str) -> Column:
    """Round a double to a whole number, half away from zero.

    Rounding to 4 places first makes the result independent of the order in
    which a float sum was accumulated: a true ``x.50`` total that lands at
    ``x.4999999`` on one run and ``x.5000001`` on another rounds the same way.
    """
    return F.round(F.round(_col(c), 4), 0)


def safe_ratio(numerator: Column | str, denominator: Column | str) -> Column:
    """``numerator / denominator`` as DOUBLE, NULL when the divisor is 0 or NULL."""
    return F.try_divide(_col(numerator).cast("double"), _col(denominator).cast("double"))
