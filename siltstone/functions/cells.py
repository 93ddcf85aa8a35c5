"""Column expressions on cells: text form, normalisation, tokens, patterns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)
FLOATING = (T.FloatType, T.DoubleType)
TEMPORAL = (T.TimestampType, T.TimestampNTZType, T.DateType)
SCALAR = (*NUMERIC, *TEMPORAL, T.StringType, T.BooleanType)

# A number, an integer, and the patterns of the semantic types in order of precedence.
NUMBER = r"^(\+|-)?\d+([\,]\d+)*([\.]\d+)?$"
INTEGER = r"^(\+|-)?\d+$"
_ZONE = r"(?:Z|[+-](?:0\d|1[0-4]):(?:00|30))?$"
SEMANTIC_PATTERNS: list[tuple[str, str, str]] = [
    ("TEMPORAL", "day", r"^\d{4}-\d{2}-\d{2}[T ]00:00:00(\.000)?" + _ZONE),
    ("TEMPORAL", "day", r"^\d{2}-\d{2}-\d{4}[T ]00:00:00(\.000)?" + _ZONE),
    ("TEMPORAL", "day", r"^(?i)(monday|tuesday|wednesday|thursday|friday|saturday|sunday)$"),
    ("TEMPORAL", "hour", r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:00:00(\.000)?" + _ZONE),
    ("TEMPORAL", "hour", r"^\d{2}-\d{2}-\d{4}[T ]\d{2}:00:00(\.000)?" + _ZONE),
    ("TEMPORAL", "minute", r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:00(\.000)?" + _ZONE),
    ("TEMPORAL", "minute", r"^\d{2}-\d{2}-\d{4}[T ]\d{2}:\d{2}:00(\.000)?" + _ZONE),
    ("TEMPORAL", "second", r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(\.000)?" + _ZONE),
    ("TEMPORAL", "second", r"^\d{2}-\d{2}-\d{4}[T ]\d{2}:\d{2}:\d{2}(\.000)?" + _ZONE),
    ("TEMPORAL", "dateTime", r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(\.\d{3})?" + _ZONE),
    ("SPATIAL", "geoCoordinate", r"POINT( )*\(([-+]?[0-9]*\.?[0-9]+)[ ,]+([-+]?[0-9]*\.?[0-9]+)\)"),
    ("SPATIAL", "geoCoordinate", r"\((-?\d+(\.\d+)?(.)?(°)?)[ ,]+(-?\d+(\.\d+)?(.)?(°)?)\)"),
    ("SPATIAL", "street", r"\b[\w0-9]+ (?i)(AVE|BVD|DR|ST|RD)\b"),
    ("SPATIAL", "street", r"^\d+\s*(?i)(N|NORTH|SOUTH|S|EAST|E|WEST|W)\.?\s+.+$"),
    ("SPATIAL", "zipCode", r"\b\d{5}\b"),
    ("SPATIAL", "state", r"\b[A-Z]{2}\b"),
]
# End of fixed values.

TERM = "[a-z0-9]+"


def cell_text(c: Column, kind: T.DataType) -> Column:
    """The same text for a value in every engine: fixed decimals for floating numbers, a fixed form for times."""
    if isinstance(kind, FLOATING):
        return c.try_cast("decimal(38,6)").cast("string")
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    return c.cast("string")


#: how a cell is coded: as its text, or as a whole number that stands for exactly one text
TEXT, WHOLE, MICROS, SECONDS = range(4)


def code_kind(kind: T.DataType) -> int:
    if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return WHOLE
    if isinstance(kind, FLOATING):
        return MICROS
    return SECONDS if isinstance(kind, (T.TimestampType, T.TimestampNTZType)) else TEXT


def raw(c: Column, kind: T.DataType) -> list[Column]:
    """A cell as fields i long, x double, s string, of which one is filled: little code for each column, as a scan has many."""
    how = code_kind(kind)
    i = F.lit(None)
    if how == WHOLE:
        i = c
    if how == SECONDS:
        i = F.unix_date(c.cast("date")).cast("long") * 86400 + F.hour(c) * 3600 + F.minute(c) * 60 + F.second(c)
    return [i.cast("long").alias("i"), (c if how == MICROS else F.lit(None)).cast("double").alias("x"), (cell_text(c, kind) if how == TEXT else F.lit(None).cast("string")).alias("s")]


def coded(i: Column, x: Column, s: Column) -> tuple[Column, Column]:
    """Raw fields as (i long, s text), of which one is null (both, if the cell is missing): cells of a column are equal here
    where their normal texts are, and counting numbers costs a fraction of making their texts. `decoded` gives the text."""
    # below 1e9, a number that is the nearest one to m millionths has m millionths as its six decimals; others go by decimals
    m = F.rint(x * 1e6)
    exact = (F.abs(x) < 1e9) & (m / F.lit(1e6) == x)
    micros = F.when(exact, m.cast("long")).when(F.abs(x) < 9e12, (x.cast("decimal(19,6)") * F.lit(1000000).cast("decimal(7,0)")).cast("long"))
    return F.when(x.isNull(), i).otherwise(micros), F.when(s.isNotNull(), normal(s)).when(F.abs(x) >= 9e12, x.try_cast("decimal(38,6)").cast("string"))


def decoded(i: Column, s: Column, how: Column) -> Column:
    """The normal text of a coded cell; how: its code_kind."""
    micros = F.concat(F.when(i < 0, "-").otherwise(""), F.call_function("div", F.abs(i), F.lit(1000000)).cast("string"), F.lit("."), F.lpad((F.abs(i) % 1000000).cast("string"), 6, "0"))
    second = F.pmod(i, F.lit(86400))
    day = F.expr("timestamp_ntz'1970-01-01 00:00:00'") + F.make_dt_interval(F.call_function("div", i - second, F.lit(86400)).cast("int"), F.lit(0), F.lit(0), second.cast("decimal(18,6)"))
    return F.when(s.isNotNull(), s).when(how == WHOLE, i.cast("string")).when(how == MICROS, micros).when(how == SECONDS, F.date_format(day, "yyyy-MM-dd HH:mm:ss"))


def normal(c: Column) -> Column:
    """Trimmed and in lower case; blank, nan and null count as missing."""
    t = F.lower(F.trim(c))
    return F.when(~t.isin("", "nan", "null"), t)


def terms(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit(TERM), F.lit(0))


def name_terms(c: Column) -> Column:
    """Words of an identifier: camel case and separators split."""
    return terms(F.regexp_replace(c, "([a-z0-9])([A-Z])", "$1 $2"))


def skeleton(c: Column) -> Column:
    """The structure of a string: digits 9, capitals A, small letters a; runs of one class shrink to one sign."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(c, "[a-z]+", "a"), "[A-Z]+", "A"), "[0-9]+", "9")


def number(c: Column) -> Column:
    """A cell as a number, commas dropped; null if it is none."""
    return F.when(F.trim(c).rlike(NUMBER), F.regexp_replace(F.trim(c), ",", "").try_cast("double"))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets; 0 if both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(F.lit(0.0))
