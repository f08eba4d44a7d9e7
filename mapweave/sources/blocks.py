"""Lines of raw files in blocks: encoding, line ends and hashes of files of any size.

A file is read by as many tasks as it has blocks, as the bytes between line
feeds. Nothing holds a whole file:

* what a file is as a whole (valid UTF-8, undefined bytes, line ends) merges
  from its lines, since no UTF-8 sequence contains a line feed;
* UTF-16 is read the same way and put together again: whether a line feed byte
  is a line end depends on its offset being even or odd, which is a running sum
  of sizes, and on the zero byte beside it;
* running sums go chunk by chunk, and then over one row for each chunk;
* a SHA-256 of a large file goes over its lines in order, in one task by nature of
  the hash, but a line at a time.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Mapping, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from mapweave.functions.encoding import cp1252_from_latin1, has_undefined_cp1252
from mapweave.operators.dialect import is_utf16
from mapweave.sources.tables import stage

#: Lines of a chunk, as a power of two.
CHUNK_BITS = 16
#: Files up to this size are hashed as one value.
WHOLE_FILE_BYTES = 256 << 20

CHUNK = ["file_id", "block", "chunk"]


def list_files(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """(file_id, size); the file_id is the path. No content is read."""
    found = spark.read.format("binaryFile").load(paths if isinstance(paths, str) else list(paths))
    return found.select(F.col("path").alias("file_id"), F.col("length").alias("size"))


def file_path() -> Column:
    """The path of the file that a row was read from, as listings show it (the reader's own is URL-encoded)."""
    return F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))


def read_bytes(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """(file_id, size, block, chunk, id, line): the bytes between line feeds, in order of block and id.

    The reader leaves out the UTF-8 byte order mark of a file.
    """
    lines = spark.read.option("lineSep", "\n").text(paths if isinstance(paths, str) else list(paths))
    row = F.monotonically_increasing_id()
    return lines.select(
        file_path().alias("file_id"), F.col("_metadata.file_size").alias("size"),
        F.col("_metadata.file_block_start").alias("block"), row.alias("id"), F.col("value").cast("binary").alias("line")).withColumn(
        "chunk", F.shiftright("id", CHUNK_BITS)).select("file_id", "size", "block", "chunk", "id", "line")


def with_file(lines: DataFrame, files: DataFrame) -> DataFrame:
    """``lines`` with the columns of their file (inner join); they stay where they lie.

    The files go to all tasks: they are no more than the driver's listing holds.
    """
    return lines.join(F.broadcast(files), "file_id")


def running_sums(lines: DataFrame, sums: Mapping[str, tuple[Column, bool]]) -> DataFrame:
    """``lines`` with, for each name, the sum of a value over the lines of the file before each, and its own if told so."""
    values, names = lines.withColumns({f"_v_{out}": value.cast("long") for out, (value, _) in sums.items()}), list(sums)
    inside, across = W.partitionBy(*CHUNK).orderBy("id"), W.partitionBy("file_id").orderBy("block", "chunk")
    before = across.rowsBetween(W.unboundedPreceding, -1)
    chunks = values.groupBy(*CHUNK).agg(*[F.sum(f"_v_{out}").alias(f"_s_{out}") for out in names]).select(
        *CHUNK, *[F.coalesce(F.sum(f"_s_{out}").over(before), F.lit(0)).alias(f"_b_{out}") for out in names])
    local = values.withColumns({
        f"_o_{out}": F.coalesce(F.sum(f"_v_{out}").over(inside.rowsBetween(W.unboundedPreceding, 0 if own else -1)), F.lit(0))
        for out, (_, own) in sums.items()})
    return (local.join(chunks, CHUNK).withColumns({out: F.col(f"_o_{out}") + F.col(f"_b_{out}") for out in names})
            .drop(*[f"_{x}_{out}" for x in "vob" for out in names]))


def running(lines: DataFrame, value: Column, out: str, own: bool) -> DataFrame:
    """``lines`` with the sum of ``value`` over the lines of the file before each, and its own if ``own``."""
    return running_sums(lines, {out: (value, own)})


def chunk_runs(lines: DataFrame, number: str, keys: Sequence[str], part: Column) -> DataFrame:
    """(file_id, ``number``, keys, _edge, _parts): lines that follow each other and have one number, put together in their chunk.

    ``_edge`` tells the first and the last run of a chunk, which may go on in others.
    """
    inside, n = W.partitionBy(*CHUNK), F.col(number)
    marked = lines.withColumn("_edge", (n == F.min(n).over(inside)) | (n == F.max(n).over(inside)))
    return marked.groupBy(*CHUNK, number, *keys, "_edge").agg(F.sort_array(F.collect_list(part)).alias("_parts")).drop("block", "chunk")


def whole_runs(runs: DataFrame, number: str, keys: Sequence[str]) -> DataFrame:
    """(file_id, ``number``, keys, _parts): the runs of `chunk_runs`; only those at an edge are dealt out by file and number."""
    parts = F.sort_array(F.flatten(F.collect_list("_parts"))).alias("_parts")
    across = runs.where("_edge").groupBy("file_id", number, *keys).agg(parts)
    return runs.where("NOT _edge").drop("_edge").union(across)


def _zero(line: Column, at: int) -> Column:
    return F.substring(line, at, 1) == F.unhex(F.lit("00"))


def utf16_lines(lines: DataFrame) -> DataFrame:
    """Lines of UTF-16 files, each with the bytes of its text, from those between line feed bytes.

    ``lines`` also has ``head``, FFFE or FEFF. In little endian a line begins
    behind a feed at an even offset with the zero that belongs to the feed; in
    big endian it ends before a feed at an odd offset with that zero.
    """
    # What the sums need is taken here, so that lines themselves are dealt out once.
    known = lines.select("*", F.octet_length("line").alias("_n"), _zero(F.col("line"), 1).alias("_zero"), _zero(F.col("line"), -1).alias("_ends0"))
    placed = running(known, F.col("_n") + 1, "start", own=False)
    little, end = F.col("head") == "FFFE", F.col("start") + F.col("_n")
    begins = little & (F.col("start") > 0) & (F.col("start") % 2 == 1) & F.col("_zero")
    ends = ~little & (end % 2 == 1) & (end < F.col("size")) & F.col("_ends0")
    marked = placed.withColumn("begins", begins).withColumn("ends", ends)
    counted = running_sums(marked, {"n_begun": (F.col("begins"), True), "n_ended": (F.col("ends"), False)})
    # The zero of a feed and the mark at the start are not text.
    trimmed = counted.withColumn("_from", F.expr("1 + int(begins) + if(start = 0, 2, 0)")).withColumn(
        "line", F.expr("substring(line, _from, greatest(_n - _from + 1 - int(ends), 0))")).withColumn(
        "_run", F.col("n_begun") + F.col("n_ended"))
    runs = chunk_runs(trimmed, "_run", ["head"], F.struct("block", "id", "chunk", "line", "ends"))
    found = whole_runs(runs, "_run", ["head"])
    parts = F.col("_parts")
    joined = F.unhex(F.array_join(F.transform(parts, lambda p: F.hex(p["line"])), "0A"))
    return found.select(
        "file_id", "head", parts[0]["block"].alias("block"), parts[0]["chunk"].alias("chunk"), parts[0]["id"].alias("id"),
        F.element_at(parts, -1)["ends"].alias("ends"), F.when(F.size(parts) == 1, parts[0]["line"]).otherwise(joined).alias("line"))


def _utf16_text(line: str = "line") -> Column:
    return F.when(F.col("head") == "FFFE", F.decode(line, "UTF-16LE")).otherwise(F.decode(line, "UTF-16BE"))


def describe(files: DataFrame, lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(file_id, size, encoding, newline, mark, ended, first) of every file, and its lines as text.

    ``encoding`` is utf-8-sig, utf-16, utf-8 or cp1252, or null if none decodes
    the bytes; ``newline`` is CRLF, CR or LF. Lines of a file without an
    encoding are left out.
    """
    latin = F.decode("line", "ISO-8859-1")
    returned = latin.endswith("\r").cast("int")
    place = F.struct("block", "id")
    found = lines.groupBy("file_id").agg(
        F.sum(F.octet_length("line") + 1).alias("total"), F.every(F.is_valid_utf8(F.col("line").cast("string"))).alias("utf8"),
        F.some(has_undefined_cp1252(latin)).alias("undefined"), F.hex(F.min_by(F.substring("line", 1, 2), place)).alias("head"),
        F.some(F.instr(latin, "\r") > 0).alias("any_cr"), F.sum(returned).alias("n_cr"),
        F.max_by(returned, place).alias("last_cr"), F.min(place)["id"].alias("first"))
    # What the reader left out: the mark (3 bytes), and the feed behind the last line where there was none.
    extra = F.col("size") - F.coalesce("total", F.lit(0))
    known = files.join(found, "file_id", "left").withColumn("mark", extra >= 2).withColumn("ended", extra.isin(0, 3))
    wide = F.col("head").isin("FFFE", "FEFF")
    whole = stage(utf16_lines(with_file(lines, known.where(wide).select("file_id", "head"))), "utf16-lines", compact=True)
    text = F.when(F.col("fits"), _utf16_text())
    returned = text.endswith("\r").cast("int")
    # Behind the last line there is no feed, unless a big endian one ends the file.
    last = F.max_by(F.when(F.col("ends"), 0).otherwise(returned), place)
    fits = F.when(F.col("head") == "FFFE", is_utf16(F.hex("line"), F.lit("FFFE"))).otherwise(is_utf16(F.hex("line"), F.lit("FEFF")))
    checked = whole.withColumn("fits", fits).groupBy("file_id").agg(
        F.every("fits").alias("utf16"), F.some(F.instr(text, "\r") > 0).alias("cr16"), (F.sum(returned) > last).alias("crlf16"))
    is_wide = F.col("encoding") == "utf-16"
    crlf = F.when(is_wide, F.col("crlf16")).otherwise(F.col("n_cr") > F.when(F.col("ended"), 0).otherwise(F.col("last_cr")))
    any_cr = F.when(is_wide, F.col("cr16")).otherwise(F.col("any_cr"))
    valid = F.coalesce("utf8", F.lit(True))
    label = (F.when(F.col("mark") & valid, "utf-8-sig").when(F.col("utf16") & (F.col("size") % 2 == 0), "utf-16").when(valid, "utf-8")
             .when(~F.col("undefined"), "cp1252"))
    about = stage(known.join(checked, "file_id", "left").withColumn("encoding", label).select(
        "file_id", "size", "encoding", "mark", "ended", "first",
        F.when(F.col("encoding").isNull(), None).when(crlf, "CRLF").when(any_cr, "CR").otherwise("LF").alias("newline")), "files")
    return about, decoded(about, lines, whole)


def decoded(files: DataFrame, lines: DataFrame, whole16: DataFrame) -> DataFrame:
    """(file_id, block, chunk, id, text) of the files by their encodings."""
    place = ["file_id", "block", "chunk", "id"]
    label = F.col("encoding")
    latin = cp1252_from_latin1(F.decode("line", "ISO-8859-1"))
    marked = F.col("mark") & (F.col("block") == 0) & (F.col("id") == F.col("first"))
    mark = cp1252_from_latin1(F.decode(F.unhex(F.lit("EFBBBF")), "ISO-8859-1"))
    narrow = with_file(lines.drop("size"), files.where(label != "utf-16").select("file_id", "encoding", "mark", "first")).select(
        *place, F.when(label == "cp1252", F.when(marked, F.concat(mark, latin)).otherwise(latin))
        .otherwise(F.col("line").cast("string")).alias("text"))
    wide = with_file(whole16, files.where(label == "utf-16").select("file_id")).select(*place, _utf16_text().alias("text"))
    return narrow.union(wide)


def decoded_as(lines: DataFrame, encoding: str) -> DataFrame:
    """(file_id, block, chunk, id, text) of files in a known encoding."""
    place = ["file_id", "block", "chunk", "id"]
    if encoding == "utf-16":
        head = F.hex(F.min_by(F.substring("line", 1, 2), F.struct("block", "id")))
        heads = lines.groupBy("file_id").agg(head.alias("head"))
        return utf16_lines(with_file(lines, heads)).select(*place, _utf16_text().alias("text"))
    latin = cp1252_from_latin1(F.decode("line", "ISO-8859-1"))
    return lines.select(*place, (latin if encoding == "cp1252" else F.col("line").cast("string")).alias("text"))


def _hash_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of files whose lines come in order, with what stands before and behind each line."""
    name, digest = None, None

    def row():
        return pa.RecordBatch.from_pydict({"file_id": [name], "file_sha256": [digest.hexdigest()]})

    for batch in batches:
        done = []
        for file_id, before, line, behind in zip(*(batch.column(i).to_pylist() for i in range(4))):
            if file_id != name:
                if digest is not None:
                    done.append(row())
                name, digest = file_id, hashlib.sha256()
            digest.update(before + line + behind)
        yield from done
    if digest is not None:
        yield row()


def hash_lines(files: DataFrame, lines: DataFrame) -> DataFrame:
    """(file_id, file_sha256) from the lines of files (size, mark, ended)."""
    at = F.struct("block", "id")
    ends = lines.groupBy("file_id").agg(F.min(at).alias("_first"), F.max(at).alias("_last"))
    nothing, feed, mark = (F.unhex(F.lit(x)) for x in ("", "0A", "EFBBBF"))
    rows = lines.join(files.select("file_id", "mark", "ended").join(ends, "file_id"), "file_id").withColumn(
        "before", F.when(F.col("mark") & (at == F.col("_first")), mark).otherwise(nothing)).withColumn(
        "behind", F.when((at == F.col("_last")) & ~F.col("ended"), nothing).otherwise(feed))
    ordered = rows.repartition("file_id").sortWithinPartitions("file_id", "block", "id").select("file_id", "before", "line", "behind")
    return ordered.mapInArrow(_hash_lines, "file_id string, file_sha256 string")


def file_hashes(spark: SparkSession, paths: Sequence[str], whole: int = WHOLE_FILE_BYTES) -> DataFrame:
    """(file_id, file_sha256) of all files in one job; those above ``whole`` bytes line by line."""
    small = (spark.read.format("binaryFile").load(list(paths)).where(F.col("length") <= whole)
             .select(F.col("path").alias("file_id"), F.sha2("content", 256).alias("file_sha256")))
    large = [r.file_id for r in list_files(spark, paths).where(F.col("size") > whole).toLocalIterator()]
    if not large:
        return small
    about, lines = list_files(spark, large), stage(read_bytes(spark, large), "lines")
    totals = lines.groupBy("file_id").agg(F.sum(F.octet_length("line") + 1).alias("total"))
    extra = F.col("size") - F.col("total")
    known = about.join(totals, "file_id").withColumn("mark", extra >= 2).withColumn("ended", extra.isin(0, 3))
    return small.union(hash_lines(known, lines))
