"""Text dialect of delimited files: encoding, line ends, delimiter, quoting, cells.

A file is one row with its whole content (the binary file source), so all of
this is row-local array work without a shuffle.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mapweave.functions.encoding import cp1252_from_latin1, has_undefined_cp1252

# Candidate delimiters in order of preference.
DELIMITERS = (",", ";", "\t", "|")

# Stands for a well-formed quoted cell; from the private use area.
QUOTED = chr(0xE000)
# UTF-16 text as hex units, without lone surrogates.
_UTF16_LE = r"^(?:..(?!D[89A-F])..|..D[89AB]..D[C-F])*+$"
_UTF16_BE = r"^(?:(?!D[89A-F])....|D[89AB]..D[C-F]..)*+$"


def is_utf16(units: Column, head: Column) -> Column:
    """Whether bytes in hex are UTF-16 in the byte order of a mark."""
    return (head.startswith("FFFE") & units.rlike(_UTF16_LE)) | (head.startswith("FEFF") & units.rlike(_UTF16_BE))


def encoding(content: Column) -> Column:
    """utf-8-sig, utf-16, utf-8 or cp1252; null if none decodes the bytes."""
    head = F.hex(F.substring(content, 1, 3))
    utf16 = is_utf16(F.hex(content), head)
    valid = F.is_valid_utf8(content.cast("string"))
    return (F.when((head == "EFBBBF") & valid, "utf-8-sig")
            .when(head.rlike("^(FFFE|FEFF)") & utf16, "utf-16").when(valid, "utf-8")
            .when(~has_undefined_cp1252(F.decode(content, "ISO-8859-1")), "cp1252"))


def decode(content: Column, label: Column) -> Column:
    """Text of bytes in a detected encoding, without a byte order mark."""
    return (F.when(label == "utf-16", F.decode(content, "UTF-16"))
            .when(label == "cp1252", cp1252_from_latin1(F.decode(content, "ISO-8859-1")))
            .when(label == "utf-8-sig", F.substring(content.cast("string"), 2, 2**31 - 1))
            .when(label == "utf-8", content.cast("string")))


def newline_style(text: Column) -> Column:
    """CRLF, CR or LF."""
    return F.when(text.contains("\r\n"), "CRLF").when(text.contains("\r"), "CR").otherwise("LF")


def escaped(delimiter: str) -> str:
    return {"\t": r"\t", "|": r"\|"}.get(delimiter, delimiter)


def opening_quote(delimiter: str) -> str:
    """A quote at the start of a cell; quotes within a bare cell are plain text."""
    return rf'"(?<![^{escaped(delimiter)}\r\n]")'


def _quoted_cell(delimiter: str) -> str:
    return opening_quote(delimiter) + r'[^"]*+(?:""[^"]*+)*+"'


def masked(text: Column, delimiter: str) -> Column:
    """Text with every well-formed quoted cell as one stand-in character."""
    return F.when(text.contains('"'), F.regexp_replace(text, _quoted_cell(delimiter), QUOTED)).otherwise(text)


def _problem(masked: Column, delimiter: str) -> Column:
    d = escaped(delimiter)
    return (F.when(masked.contains('"') & masked.rlike(opening_quote(delimiter)),
                   "unexpected end of data in a quoted cell")
            .when(masked.contains(QUOTED) & masked.rlike(rf"{QUOTED}[^{d}\r\n]"), "text after a closing quote")
            .when(masked.contains("\r") & masked.rlike(r"\r(?![\r\n]|\z)"), "new-line character in an unquoted cell"))


def quote_problem(text: Column, delimiter: Column) -> Column:
    """Why the text is not well-formed in a delimiter, null if it is."""
    return _by_delimiter(delimiter, lambda d: _problem(masked(text, d), d))


def once(value: Column, body) -> Column:
    """``body(value)`` with the value computed once; a lambda would redo it per element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _by_delimiter(delimiter: Column, make) -> Column:
    return reduce(lambda acc, d: acc.when(delimiter == d, make(d)), DELIMITERS[1:],
                  F.when(delimiter == DELIMITERS[0], make(DELIMITERS[0])))


def delimiter(text: Column) -> Column:
    """Delimiter with the most rows of one width above 1, null if there is none.

    The whole text is judged. Ties go to the larger width, then to the preferred
    delimiter. One whose quoting is broken is out.
    """
    def score(rank: int, d: str) -> Column:
        def mode(widths: Column) -> Column:
            return F.array_max(F.transform(F.array_distinct(widths), lambda w: F.struct(
                F.size(F.filter(widths, lambda x: x == w)).alias("n"), w.alias("width"),
                F.lit(-rank).alias("rank"), F.lit(d).alias("d"))))

        def of_masked(masked: Column) -> Column:
            lines = F.filter(F.split(masked, r"[\r\n]+"), lambda x: x != "")
            widths = F.filter(F.transform(lines, lambda x: F.size(F.split(x, escaped(d)))), lambda w: w > 1)
            return F.when(_problem(masked, d).isNull(), once(widths, mode))

        return once(masked(text, d), of_masked)

    return F.array_max(F.array(*[score(i, d) for i, d in enumerate(DELIMITERS)]))["d"]


def records(text: Column, delimiter: Column) -> Column:
    """Records of a text; line breaks inside quoted cells do not end one."""
    def make(d: str) -> Column:
        cell = _quoted_cell(d)
        return F.regexp_extract_all(
            F.concat(F.lit("\n"), text), F.lit(rf'(?:\r\n|\n|\r)((?:[^\r\n"]++|{cell}|")*+)'), F.lit(1))

    return _by_delimiter(delimiter, make)


def cells(record: Column, delimiter: Column) -> Column:
    """Cells of a record, unquoted; an empty record has none."""
    def make(d: str) -> Column:
        raw = F.regexp_extract_all(
            F.concat(F.lit(d), record),
            F.lit(rf'{escaped(d)}("[^"]*+(?:""[^"]*+)*+"|[^{escaped(d)}]*+)'), F.lit(1))
        return F.transform(raw, lambda c: F.when(
            c.startswith('"') & c.endswith('"') & (F.length(c) > 1),
            F.replace(F.substring(c, 2, F.length(c) - 2), F.lit('""'), F.lit('"'))).otherwise(c))

    empty = F.array().cast("array<string>")
    return F.when(record == "", empty).otherwise(_by_delimiter(delimiter, make))


def csv_grid(files: DataFrame) -> DataFrame:
    """Cell grid (file_id, row_idx, cells) with the dialect of each file.

    ``files``: file_id, content. A file without a usable encoding or with
    broken quoting has a ``problem`` and one row without cells.
    """
    text = (files.withColumn("encoding", encoding(F.col("content")))
            .withColumn("text", decode(F.col("content"), F.col("encoding"))).drop("content"))
    known = text.withColumn("found", delimiter(F.col("text"))).withColumn(
        "delimiter", F.coalesce("found", F.lit(",")))
    checked = known.withColumn("problem", F.when(F.col("encoding").isNull(), "encoding could not be detected")
                               .otherwise(quote_problem(F.col("text"), F.col("delimiter"))))
    rows = F.when(F.col("problem").isNull(), records(F.col("text"), F.col("delimiter")))
    quoted = F.filter(rows, lambda r: r.contains('"') & r.rlike(r"[\r\n]"))
    return (checked.select("file_id", "encoding", "delimiter", "problem", F.coalesce(F.size(quoted) > 0, F.lit(False)).alias("multi_line"),
                           newline_style(F.col("text")).alias("newline"), F.col("found").isNull().alias("fallback"),
                           F.posexplode_outer(rows).alias("_i", "_record"))
            .select("file_id", "encoding", "delimiter", "newline", "fallback", "problem", "multi_line",
                    (F.col("_i") + 1).cast("bigint").alias("row_idx"),
                    F.coalesce(cells(F.col("_record"), F.col("delimiter")), F.array().cast("array<string>")).alias("cells")))
