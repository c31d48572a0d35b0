"""Cell-level coercions, all built-in JVM expressions.

Every typed view follows one rule: a cell that cannot be read becomes NULL and
never raises, so the expressions are safe under ANSI mode.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F, types as T

# Tokens read as booleans, in natural order.
BOOL_TOKENS = ["true", "false", "yes", "no", "y", "n", "1", "0", "t", "f", "true.", "false."]
TRUE_TOKENS = ["true", "yes", "y", "1", "t"]
FALSE_TOKENS = ["false", "no", "n", "0", "f"]

# Cell texts that delimited readers treat as missing.
NA_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND",
    "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]

# All characters that count as white space, control characters first.
WHITE_SPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)

# Format rules.
NUMBER_PATTERN = r"^[-+]?(\d+\.?\d*|\.\d+)([eE][-+]?\d+)?$"
EMAIL_PATTERN = r"(?i)^[^@\s]+@[^@\s]+\.[^@\s]+$"
PHONE_PATTERN = r"^\+?\d[\d\s().-]{6,}$"

# Notations of dates. Each is rewritten to an ISO date with what follows it, and that is read.
ISO_TIMESTAMP = r"^\d{4}-\d{1,2}-\d{1,2}([ T]\d{1,2}:\d{2}(:\d{2}(\.\d+)?)?(Z|[+-]\d{2}:?\d{2})?)?$"
TWELVE_HOURS = r"^\d{4}-\d{1,2}-\d{1,2} \d{1,2}:\d{2}(:\d{2})? ?[AaPp][Mm]$"
DATE_LENGTHS = (6, 40)  # 1/5/99; a weekday, a month in full and a time of day
DATE_HINT = r"\d{4}|\d[/.]\d{2}(?!\d)|[A-Za-z]{3}[ -]\d{2}(?!\d)"
YEAR_FIRST = r"^(\d{4})[/.](\d{1,2})[/.](\d{1,2})(?!\d)"
YEAR_AND_MONTH = r"^\d{4}[-/]\d{1,2}$"
YEAR_LAST = r"^(\d{1,2})([/-])(\d{1,2})\2(\d{4}|(?<=/)\d{2})(?!\d)"  # day and month in the order of the column
DOTTED_DAY_FIRST = r"^(\d{1,2})\.(\d{1,2})\.(\d{4}|(?<=\d\d\.\d\d\.)\d{2})(?!\d)"
COMPACT = r"^((?:19|20)\d{2})(0[1-9]|1[0-2])(0[1-9]|[12]\d|3[01])([T ]\d{4}(?:\d{2})?)?$"
COMPACT_TIME = r"T(\d{2})(\d{2})(\d{2})?$"
NAMED_DAY_FIRST = r"^(?:[A-Za-z]{3,9},? )?(\d{1,2})[ -]([A-Za-z]{3,9})(?:, |[ -])(\d{4}|\d{2})(?!\d)"
NAMED_MONTH_FIRST = r"^(?:[A-Za-z]{3,9}, )?([A-Za-z]{3,9}) (\d{1,2}),? (\d{4})(?!\d)"
MONTHS = ["january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december"]
LAST_OF_CENTURY = 68  # years 69 to 99 are of the last century


def strip(text: Column) -> Column:
    """Remove leading and trailing white space of every kind, not just spaces."""
    padded = text.rlike(r"(?Us)^(?:[\s\x1c-\x1f]|.*+(?<=[\s\x1c-\x1f]))")
    return F.when(padded, F.btrim(text, F.lit(WHITE_SPACE))).otherwise(text)


def normalise_label(text: Column) -> Column:
    """Lower-case, trimmed label with inner white space collapsed."""
    return F.lower(F.regexp_replace(strip(text), r"(?U)\s+", " "))


def is_nested(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.ArrayType, T.StructType, T.MapType))


def is_temporal(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.TimestampType, T.TimestampNTZType, T.DateType))


def is_float(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.FloatType, T.DoubleType))


def present(col: Column, dtype: T.DataType) -> Column:
    """The cell with NaN folded into NULL."""
    return F.when(~F.isnan(col), col) if is_float(dtype) else col


def text_number(stripped: Column) -> Column:
    """DOUBLE view of stripped text; thousands, currency and percent marks are dropped first."""
    bare = F.translate(stripped, ",$%", "")
    return F.when(bare.rlike(NUMBER_PATTERN), bare.try_cast("double"))


def named(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that it mentions several times but that is computed once."""
    return F.transform(F.array(value), use)[0]


def _with_month_number(text: Column) -> Column:
    """``2024-Jan-5`` as ``2024-1-5``; NULL if the month has no such name."""
    numbers = F.create_map(*[F.lit(x) for i, month in enumerate(MONTHS, 1) for name in dict.fromkeys((month, month[:3])) for x in (name, str(i))])
    number = F.try_element_at(numbers, F.lower(F.regexp_extract(text, "-([A-Za-z]+)-", 1)))
    return F.regexp_replace(text, "-[A-Za-z]+-", F.concat(F.lit("-"), number, F.lit("-")))


def _iso(text: Column, day_first: bool) -> Column:
    """The date of any notation rewritten to an ISO one, what follows it as it is."""
    order = "$4-$3-$1" if day_first else "$4-$1-$3"
    replaced = lambda pattern, by: F.regexp_replace(text, pattern, by)
    compact = F.regexp_replace(F.translate(replaced(COMPACT, "$1-$2-$3$4"), " ", "T"), COMPACT_TIME, "T$1:$2:$3")
    zoned = lambda x: F.regexp_replace(x, " (GMT|UTC)$", "Z")
    view = (
        F.when(text.rlike(r"^\d{4}-\d{1,2}-"), text)
        .when(text.rlike(YEAR_LAST), replaced(YEAR_LAST, order))
        .when(text.rlike(DOTTED_DAY_FIRST), replaced(DOTTED_DAY_FIRST, "$3-$2-$1"))
        .when(text.rlike(YEAR_FIRST), replaced(YEAR_FIRST, "$1-$2-$3"))
        .when(text.rlike(YEAR_AND_MONTH), F.concat(F.translate(text, "/", "-"), F.lit("-01")))
        .when(text.rlike(COMPACT), F.rtrim(compact, F.lit(":")))
        .when(text.rlike(NAMED_DAY_FIRST), named(zoned(replaced(NAMED_DAY_FIRST, "$3-$2-$1")), _with_month_number))
        .when(text.rlike(NAMED_MONTH_FIRST), named(zoned(replaced(NAMED_MONTH_FIRST, "$3-$1-$2")), _with_month_number))
    )
    century = lambda x: F.when(F.substring(x, 1, 2) <= str(LAST_OF_CENTURY), "20").otherwise("19")
    return named(view, lambda x: F.when(x.rlike(r"^\d{2}-"), F.concat(century(x), x)).otherwise(x))


def _read_iso(text: Column) -> Column:
    clock = F.upper(F.regexp_replace(text, r" ?([AaPp][Mm])$", " $1"))
    seconds = F.when(text.rlike(r":\d{2}:"), "yyyy-M-d h:mm:ss a").otherwise("yyyy-M-d h:mm a")
    twelve = F.when(text.rlike(TWELVE_HOURS), F.try_to_timestamp(clock, seconds).cast("timestamp_ntz"))
    return F.when(text.rlike(ISO_TIMESTAMP), text.try_cast("timestamp_ntz")).otherwise(twelve)


def text_timestamp(stripped: Column, day_first: bool = False) -> Column:
    """TIMESTAMP_NTZ view of stripped date-like text; the gate spares other text the patterns.

    ``day_first`` says how slashed and dashed dates with the year last are read; dotted dates begin with the day.
    """
    gate = F.length(stripped).between(*DATE_LENGTHS) & stripped.rlike(DATE_HINT)
    return F.when(gate, named(stripped, lambda text: named(_iso(text, day_first), _read_iso)))


def as_number(col: Column, dtype: T.DataType) -> Column:
    """DOUBLE view of numbers, booleans and number-like text."""
    if is_float(dtype):
        return present(col, dtype).cast("double")
    if isinstance(dtype, T.NumericType):
        return col.cast("double")
    if isinstance(dtype, T.StringType):
        return text_number(strip(col))
    if isinstance(dtype, T.BooleanType):
        return col.cast("int").cast("double")
    return F.lit(None).cast("double")


def as_timestamp(col: Column, dtype: T.DataType, day_first: bool = False) -> Column:
    """TIMESTAMP_NTZ view of dates, timestamps and date-like text."""
    if isinstance(dtype, T.TimestampNTZType):
        return col
    if is_temporal(dtype):
        return col.cast("timestamp_ntz")
    if isinstance(dtype, T.StringType):
        return text_timestamp(strip(col), day_first)
    return F.lit(None).cast("timestamp_ntz")


def as_boolean(col: Column, dtype: T.DataType) -> Column:
    """BOOLEAN view by the true and false token lists."""
    if isinstance(dtype, T.BooleanType):
        return col
    token = F.lower(strip(col.cast("string")))
    return F.when(token.isin(TRUE_TOKENS), F.lit(True)).when(token.isin(FALSE_TOKENS), F.lit(False))


def plain_number(value: Column) -> Column:
    """Decimal text without exponent or trailing zeros, the same on every engine.

    A value that ten decimals do not tell apart from its neighbours keeps its shortest full notation, so that distinct
    values have distinct texts; -0.0 reads as 0.
    """
    fixed = value.try_cast("decimal(38,10)")
    exact = F.when(fixed.cast("double") == value.cast("double"), F.regexp_replace(fixed.cast("string"), r"\.?0+$", ""))
    return F.coalesce(exact, (value + F.lit(0.0)).cast("string"))


def as_text(col: Column, dtype: T.DataType) -> Column:
    """STRING view used for value counts and examples."""
    if isinstance(dtype, T.StringType):
        return col
    if isinstance(dtype, T.MapType):
        return F.to_json(F.array_sort(F.map_entries(col)))
    if is_nested(dtype):
        return F.to_json(col)
    if is_float(dtype):
        return plain_number(present(col, dtype).cast("double"))
    return col.cast("string")


def rounded(value: Column, digits: int) -> Column:
    """Half-up rounding on the decimal expansion, stable for ties such as x.xx5."""
    exact = F.round(value.try_cast("decimal(38,10)"), digits).cast("double")
    return F.coalesce(exact, F.round(value.cast("double"), digits))


def percent(part: Column, whole: Column, digits: int = 2) -> Column:
    """``100 * part / whole`` rounded, NULL when the whole is zero."""
    return rounded(F.try_divide(F.lit(100.0) * part, whole.cast("double")), digits)
