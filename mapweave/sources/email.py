"""Single-part email messages as rows: headers and decoded body."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mapweave.functions.encoding import decode_text

_BLANK_LINE = r"(?s)^(.*?)\r?\n\r?\n(.*)$"


def _from_quoted_printable(text: Column) -> Column:
    """Decode ``=XX`` escapes: all text goes to hex, escapes already are hex."""
    joined = F.regexp_replace(text, "=[ \t]*\r?\n", "")
    parts = F.split(F.regexp_replace(joined, "=(?![0-9A-Fa-f]{2})", "=3D"), "=")
    first = F.hex(F.encode(F.element_at(parts, 1), "UTF-8"))
    rest = F.transform(F.slice(parts, 2, F.size(parts)), lambda p: F.concat(
        F.substring(p, 1, 2), F.hex(F.encode(F.substring(p, 3, 2**31 - 1), "UTF-8"))))
    return decode_text(F.unhex(F.concat(first, F.array_join(rest, ""))))


def header_value(headers: Column, name: str) -> Column:
    """Value of a header; the last one wins if it repeats."""
    return F.try_element_at(F.filter(headers, lambda h: F.lower(h["name"]) == name.lower()), F.lit(-1))["value"]


def parse_messages(messages: DataFrame, raw: str = "raw") -> DataFrame:
    """Add ``headers`` (array of name and value, folded lines joined) and ``body_text``."""
    # A message that starts with a blank line has no headers.
    text = F.concat(F.lit("\n"), raw)
    split = text.rlike(_BLANK_LINE)
    head = F.when(split, F.regexp_extract(text, _BLANK_LINE, 1)).otherwise(text)
    body = F.when(split, F.regexp_extract(text, _BLANK_LINE, 2)).otherwise("")
    lines = F.split(F.regexp_replace(head, r"\r?\n[ \t]+", " "), r"\r?\n")
    pairs = F.transform(F.filter(lines, lambda x: x.contains(":")), lambda x: F.struct(
        F.regexp_extract(x, "^([^:]*):", 1).alias("name"),
        F.trim(F.regexp_extract(x, r"(?s)^[^:]*:\s*(.*)$", 1)).alias("value")))
    parsed = messages.select("*", pairs.alias("headers"), body.alias("_body"))
    coding = F.lower(F.coalesce(header_value(F.col("headers"), "Content-Transfer-Encoding"), F.lit("")))
    text = (F.when(coding == "base64", decode_text(F.try_to_binary(F.regexp_replace("_body", r"\s", ""), F.lit("base64"))))
            .when(coding == "quoted-printable", _from_quoted_printable(F.col("_body"))).otherwise(F.col("_body")))
    return parsed.withColumn("body_text", F.coalesce(text, F.col("_body"))).drop("_body")
