"""Scalar functions of the mapping language, as Column functions.

``register_mapping_functions`` makes the ones Spark SQL lacks available as
temporary SQL functions, so that expression text in a mapping spec can call
them; Catalyst inlines those, nothing leaves the JVM.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

# Strptime directives and the Spark pattern letters they mean.
# Single letters accept one or two digits, as strptime does.
STRPTIME_TO_SPARK = {
    "%d": "d", "%m": "M", "%Y": "yyyy", "%y": "yy", "%b": "MMM", "%B": "MMMM",
    "%H": "H", "%I": "h", "%M": "m", "%S": "s", "%p": "a",
}
# Date layouts tried in turn when a mapping names no format.
COMMON_DATE_FORMATS = ("%d/%m/%Y", "%Y-%m-%d", "%d-%b-%Y")


# Every character that counts as white space, by its Unicode property; the
# separators 0x1C-0x1F count in Python's ``strip`` only.
PYTHON_SPACE = "".join(chr(i) for i in range(0x3001) if chr(i).isspace())
UNICODE_SPACE = "".join(c for c in PYTHON_SPACE if not 0x1C <= ord(c) <= 0x1F)


def spark_pattern(fmt: str) -> str:
    """Spark datetime pattern for a strptime format; other text is passed on."""
    for directive, letters in STRPTIME_TO_SPARK.items():
        fmt = fmt.replace(directive, letters)
    return fmt


def concat_all(*parts: Column | str) -> Column:
    """Concatenation that is null as soon as one part is; strings are literals."""
    return F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])


def cast_or_null(c: Column, dtype: str) -> Column:
    """Cast that turns a value that does not fit into null."""
    return c.try_cast(dtype)


def parse_date(c: Column, fmt: str) -> Column:
    """Date from text in one strptime (or Spark) format, null if it does not match."""
    return F.try_to_date(c, spark_pattern(fmt))


def parse_date_any(c: Column, formats: Sequence[str] = COMMON_DATE_FORMATS) -> Column:
    """First format that parses wins."""
    return F.coalesce(*[parse_date(c, fmt) for fmt in formats])


def parse_datetime(c: Column, fmt: str | None = None) -> Column:
    """Zone-less datetime from text, null if it does not parse."""
    if fmt is None:
        return c.try_cast("timestamp_ntz")
    return F.try_to_timestamp(c, F.lit(spark_pattern(fmt))).cast("timestamp_ntz")


def date_part(c: Column) -> Column:
    """Calendar date of a datetime."""
    return F.to_date(c)


def titlecase(c: Column) -> Column:
    """Capitalise every run of letters and digits, lower-case the rest of it."""
    runs = F.regexp_extract_all(c, F.lit(r"([\p{L}\p{N}]+|[^\p{L}\p{N}]+)"), F.lit(1))
    return F.array_join(F.transform(runs, lambda run: F.concat(
        F.upper(F.substring(run, 1, 1)), F.lower(F.substring(run, 2, 2**31 - 1)))), "")


def strip_chars(c: Column) -> Column:
    """Remove all Unicode white space at both ends (``trim`` keeps tabs)."""
    return F.btrim(c, F.lit(UNICODE_SPACE))


def replace_values(c: Column, mapping: Mapping[str, str]) -> Column:
    """Exchange exact values, keep all others."""
    pairs = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])
    return F.coalesce(F.try_element_at(pairs, c), c)


def extract_first(c: Column, pattern: str, group: int = 1) -> Column:
    """Capture group of the first match, null where nothing matches."""
    return F.when(c.rlike(pattern), F.regexp_extract(c, pattern, group))


def replace_all(c: Column, pattern: str, replacement: str) -> Column:
    """Replace every match."""
    return F.regexp_replace(c, pattern, replacement)


def replace_first(c: Column, pattern: str, replacement: str) -> Column:
    """Replace only the first match (text without groups of its own)."""
    return F.regexp_replace(c, f"(?s)^(.*?)(?:{pattern})", "$1" + replacement)


def money(c: Column, scale: int = 2) -> Column:
    """Half-up rounding on decimals."""
    return F.round(c.try_cast("decimal(38,10)"), scale)


def sum_or_zero(c: Column) -> Column:
    """Sum that is 0, not null, for a group without values."""
    return F.coalesce(F.sum(c), F.lit(0).cast("double"))


def first_by(c: Column, order: Column) -> Column:
    """First value in an explicit order; merges map-side like any aggregate."""
    return F.min_by(c, order)


def last_by(c: Column, order: Column) -> Column:
    """Last value in an explicit order."""
    return F.max_by(c, order)


def snippet(c: Column, n: int = 500) -> Column:
    """First ``n`` characters, for display."""
    return F.substring(c, 1, n)


def normalize_name(c: Column, ordinal: Column) -> Column:
    """Identifier-friendly column name; blank names become ``column_<ordinal>``."""
    text = F.lower(F.coalesce(c, F.lit("")))
    slug = F.regexp_replace(F.regexp_replace(text, "[^0-9a-zA-Z]+", "_"), "^_+|_+$", "")
    return F.coalesce(F.nullif(slug, F.lit("")),
                      F.concat(F.lit("column_"), ordinal.cast("string")))


_SQL_FUNCTIONS = {
    "titlecase(s STRING) RETURNS STRING":
        r"array_join(transform(regexp_extract_all(s, '([\\p{L}\\p{N}]+|[^\\p{L}\\p{N}]+)', 1),"
        r" x -> concat(upper(substring(x, 1, 1)), lower(substring(x, 2)))), '')",
    "strip_chars(s STRING) RETURNS STRING":
        f"btrim(s, '{UNICODE_SPACE}')",
    "parse_date(s STRING, fmt STRING) RETURNS DATE": "try_to_date(s, fmt)",
    "parse_date_any(s STRING) RETURNS DATE":
        "coalesce(" + ", ".join(f"try_to_date(s, '{spark_pattern(f)}')"
                                for f in COMMON_DATE_FORMATS) + ")",
    "extract_first(s STRING, re STRING) RETURNS STRING":
        "CASE WHEN s RLIKE re THEN regexp_extract(s, re, 1) END",
    "replace_first(s STRING, re STRING, r STRING) RETURNS STRING":
        "regexp_replace(s, concat('(?s)^(.*?)(?:', re, ')'), concat('$1', r))",
}


def register_mapping_functions(spark: SparkSession) -> None:
    """Create the SQL-text forms of the functions that Spark SQL lacks."""
    for signature, body in _SQL_FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {signature} RETURN {body}")
