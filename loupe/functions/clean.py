"""Cleaning and typing expressions.

All functions return ``Column`` objects built from Spark SQL built-ins, so they stay inside
whole-stage code generation.  ``spark.sql.ansi.enabled`` is on in Spark 4, hence the
``try_*`` forms everywhere a value may not parse.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Text that counts as a missing cell.
MISSING_TOKENS = ["", "nan", "None", "NaT", "<NA>"]

# The ISO date shape that may turn a column into day ordinals.
ISO_DATE_PATTERN = r"^\d{4}-\d{2}-\d{2}([ T]\d{2}:\d{2}:\d{2}(\.\d+)?)?$"

# date/time formats tried in this order, first match wins.  Single pattern
# letters accept one or two digits, as strptime's %d %m %H %M %S do.
DATETIME_FORMATS = [
    "yyyy-M-d H:m:s", "yyyy-M-d", "yyyy-M-d H:m:s.SSSSSS", "yyyy-M-d H:m:s,SSSSSS",
    "d/M/yyyy H:m:s", "d/M/yyyy", "d/M/yyyy H:m:s.SSSSSS", "d/M/yyyy H:m:s,SSSSSS",
    "M/d/yyyy H:m:s", "M/d/yyyy", "M/d/yyyy H:m:s.SSSSSS", "M/d/yyyy H:m:s,SSSSSS",
]

ORDINAL_EPOCH = "0001-01-01"  # day ordinal 1


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def as_text(c) -> Column:
    return _c(c).cast("string")


def is_missing(c) -> Column:
    """Null, or trimmed text in the missing tokens."""
    s = F.trim(as_text(c))
    return _c(c).isNull() | s.isin(*MISSING_TOKENS) | F.lower(s).isin("nan")


def standardise_decimal(c) -> Column:
    """Drop blanks (thousands separators), decimal comma -> dot."""
    return F.replace(F.replace(as_text(c), F.lit(" "), F.lit("")), F.lit(","), F.lit("."))


def try_double(c) -> Column:
    return _try_cast(standardise_decimal(c), "double")


def _try_cast(col: Column, type_name: str) -> Column:
    return col.try_cast(type_name)


def iso_date_shape(c) -> Column:
    """P4."""
    return as_text(c).rlike(ISO_DATE_PATTERN)


def to_ordinal(c) -> Column:
    """P5: days since 0001-01-01 where that day is 1 (2005-12-09 -> 732289)."""
    return (F.datediff(F.to_date(_c(c)), F.lit(ORDINAL_EPOCH).cast("date")) + 1).cast("bigint")


def parse_datetime_multi(c) -> Column:
    """First of the fixed formats that parses; null when none does."""
    s = F.trim(as_text(c))
    return F.coalesce(*[F.when(s.like(_marks(fmt)), F.try_to_timestamp(s, F.lit(fmt))) for fmt in DATETIME_FORMATS])


def _marks(fmt: str) -> str:
    """What a text of this format is like: its marks in order.  A parser that fails throws, which costs far
    more than a look at the marks."""
    return re.sub(r"[A-Za-z]+", "%", fmt)


def is_float(c) -> Column:
    """The value parses as a float."""
    return _try_cast(F.trim(as_text(c)), "double").isNotNull()


def is_int(c) -> Column:
    """The value is an integer literal."""
    return F.trim(as_text(c)).rlike(r"^[+-]?\d+$")


def is_str(c) -> Column:
    """Text that is neither number, boolean nor date."""
    s = F.trim(as_text(c))
    return ~(is_float(c) | is_int(c) | F.lower(s).isin("true", "false") | parse_datetime_multi(c).isNotNull())


def sanitize_text(c) -> Column:
    """Null -> '', number/bool/date-looking -> '', else whitespace collapsed and trimmed."""
    s = as_text(c)
    return (F.when(_c(c).isNull(), F.lit(""))
            .when(~is_str(c), F.lit(""))
            .otherwise(F.trim(F.regexp_replace(s, r"\s+", " "))))


def sanitize_number(c) -> Column:
    """Null -> 0, date -> ordinal, unparsable -> 0, else double."""
    d = parse_datetime_multi(c)
    return F.coalesce(F.when(_c(c).isNull(), F.lit(0.0)), to_ordinal(d).cast("double"),
                      _try_cast(F.trim(as_text(c)), "double"), F.lit(0.0))


def text_as_string(c, null_token: str = "None") -> Column:
    """Text columns are plain strings; nulls become a token (the reference's 'None')."""
    return F.coalesce(as_text(c), F.lit(null_token))


def normalise_key(c) -> Column:
    """P10: int(round(float(x))) with half-to-even; a non-numeric key raises at run time."""
    d = _c(c).cast("double")  # ANSI cast: a non-numeric key fails the job
    return F.bround(d, 0).cast("bigint")


def clean_label(c) -> Column:
    """Trimmed text label; null when blank (unlabelled)."""
    s = F.trim(as_text(c))
    return F.when(s == "", F.lit(None).cast("string")).otherwise(s)


def is_unlabelled(c) -> Column:
    return _c(c).isNull() | (F.trim(as_text(c)) == "")


def impute_zero(c) -> Column:
    """Missing or NaN -> 0."""
    return F.coalesce(F.nanvl(_c(c).cast("double"), F.lit(0.0)), F.lit(0.0))


def numeric_expr(field: T.StructField, decision: str) -> Column:
    """The P1 conversion for one column once its decision is known."""
    c = F.col(field.name)
    if decision == "ordinal":
        if isinstance(field.dataType, (T.TimestampType, T.TimestampNTZType, T.DateType)):
            return to_ordinal(c)
        return to_ordinal(F.try_to_timestamp(F.trim(as_text(c))))
    if isinstance(field.dataType, T.NumericType):
        return c.cast("double")
    if isinstance(field.dataType, T.BooleanType):
        return c.cast("double")
    # float, with unparsable -> NaN and missing -> null
    return (F.when(is_missing(c), F.lit(None).cast("double"))
            .otherwise(F.coalesce(_try_cast(standardise_decimal(c), "double"), F.lit(float("nan")))))
