"""Byte-to-text conversion with built-in functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _cp1252_differences() -> tuple[str, str, str]:
    """Latin-1 control characters that cp1252 prints, what it prints, and those it leaves undefined."""
    latin, printed, undefined = "", "", ""
    for byte in range(0x80, 0xA0):
        try:
            printed += bytes([byte]).decode("cp1252")
            latin += chr(byte)
        except UnicodeDecodeError:
            undefined += chr(byte)
    return latin, printed, undefined


_LATIN, _PRINTED, _UNDEFINED = _cp1252_differences()


def cp1252_from_latin1(text: Column) -> Column:
    """cp1252 text from bytes that were read as ISO-8859-1.

    Spark's readers reject cp1252; the two differ in 27 characters only.
    """
    return F.translate(text, _LATIN, _PRINTED)


def has_undefined_cp1252(text: Column) -> Column:
    """True where Latin-1 text holds a byte that cp1252 does not define."""
    return text.rlike(f"[{_UNDEFINED}]")


def decode_text(content: Column) -> Column:
    """UTF-8 text of bytes, invalid sequences dropped."""
    return F.translate(F.make_valid_utf8(content.cast("string")), "�", "")
