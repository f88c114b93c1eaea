"""Log files: discovery, decoding, and lines with byte offsets.

Lines leave the reader with number, byte offset, decoded text and time, so that parsing needs no window and no shuffle.
A short file is read once; a long one is read in splits, whose sizes are summed beforehand.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import UTC, datetime
from functools import reduce
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: ``<prefix>log_<Character>_<server>.txt``; the server may hold dots and underscores.
FILE_NAME = r"([a-z]+log)_([A-Za-z]+)_(.+)\.txt"
GLOB = "*log_*_*.txt"
MOST_LINE_BYTES = 1 << 20
LINES = "path string, log_file_id long, line_no long, byte_offset long, byte_length long, raw string, line_ts long, ts long, overflow boolean"

#: Windows-1252 differs from Latin-1 in these code points; the five undefined bytes stay control characters.
CP1252 = {c: bytes([c]).decode("cp1252", "ignore") or chr(c) for c in range(0x80, 0xA0)}


def character_and_server(name: Column) -> tuple[Column, Column]:
    """From a file's name; null where it has another form."""
    return tuple(F.nullif(F.regexp_extract(name, rf"(?:^|/){FILE_NAME}\z", g), F.lit("")) for g in (2, 3))


def discover_logs(spark: SparkSession, folder: str, newest: int | None = None) -> DataFrame:
    """Log files of a folder, not of folders in it, the newest first and ties by path.  A missing folder raises."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", GLOB).load(folder).select("path", "modificationTime", "length")
    character, server = character_and_server(F.col("path"))
    rows = found.filter(F.col("path").rlike(rf"/{FILE_NAME}\z")).select("path", character.alias("character"), server.alias("server"), F.unix_millis("modificationTime").alias("modified_ms"), "length")
    rows = rows.orderBy(F.desc("modified_ms"), "path")
    return rows.limit(newest) if newest else rows


def registered(files: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """``path, log_file_id, character, server``: known files keep their numbers, new ones follow in the order of paths."""
    fresh = files.select("path", "character", "server")
    first = F.lit(0)
    if known is not None:
        fresh = fresh.join(known.select("path"), "path", "left_anti")
        first = F.lit(known.agg(F.coalesce(F.max("log_file_id"), F.lit(0))).first()[0])
    numbered = fresh.withColumn("log_file_id", first + F.row_number().over(Window.orderBy("path"))).select("path", "log_file_id", "character", "server")
    return numbered if known is None else known.select("path", "log_file_id", "character", "server").union(numbered)


def decoded(data: bytes, encoding: str = "windows-1252") -> str:
    return data.decode("latin-1").translate(CP1252) if encoding == "windows-1252" else data.decode(encoding, "replace")


def split_lines(content: bytes, start: int = 0, flush_tail: bool = False, most: int = MOST_LINE_BYTES) -> Iterator[tuple[int, int, bytes, bool]]:
    """(byte offset, bytes with terminator, line without it, overflow) of each line from `start` on.

    Lines end in LF or CR LF.  An unfinished last line is left for later unless `flush_tail` asks for it.  A line longer
    than `most` comes in fragments of that size, all of them flagged.
    """
    at, size = start, len(content)
    while at < size:
        end = content.find(b"\n", at)
        whole = end >= 0
        if not whole:
            end = size
        length = end - at
        if length > most:
            cuts = range(at, end, most)
            if not whole and not flush_tail:
                cuts = range(at, at + length // most * most, most)
            for c in cuts:
                stop = min(c + most, end)
                last = whole and stop == end
                yield c, stop - c + last, content[c:stop].removesuffix(b"\r") if last else content[c:stop], True
            if not whole:
                return
        elif whole or flush_tail:
            line = content[at:end]
            yield at, length + whole, line.removesuffix(b"\r") if whole else line, False
        else:
            return
        at = end + 1


def time_of(prefix: str) -> int | None:
    """Milliseconds of ``[Day Mon DD HH:MM:SS YYYY] ``, read as UTC; the day's name need not agree with the date."""
    if len(prefix) < 27 or prefix[0] != "[" or prefix[25:27] != "] " or prefix[1:4] not in {"Mon", "Tue", "Wed", "Thu", "Fri", "Sat", "Sun"} or prefix[4] != " ":
        return None
    if prefix[14] != ":" or prefix[17] != ":" or prefix[8] + prefix[11] + prefix[20] != "   ":
        return None
    numbers = [prefix[a:b].strip(" ") for a, b in ((9, 11), (12, 14), (15, 17), (18, 20), (21, 25))]
    months = "JanFebMarAprMayJunJulAugSepOctNovDec"
    at = months.find(prefix[5:8])
    if at < 0 or at % 3 or not all(x.isascii() and x.isdigit() for x in numbers):
        return None
    day, hour, minute, second, year = map(int, numbers)
    try:
        return int(datetime(year, at // 3 + 1, day, hour, minute, second, tzinfo=UTC).timestamp()) * 1000
    except ValueError:
        return None


def lines_of(content: bytes, start: int = 0, line_no: int = 0, last_ts: int = 0, flush_tail: bool = False, encoding: str = "windows-1252", most: int = MOST_LINE_BYTES) -> Iterator[tuple]:
    """(line number, offset, bytes, text, own time, carried time, overflow); a line without a time carries the last one."""
    memory: dict[str, int | None] = {}
    for offset, length, line, overflow in split_lines(content, start, flush_tail, most):
        line_no += 1
        text = decoded(line, encoding)
        prefix = text[:27]
        if prefix not in memory:
            memory[prefix] = time_of(prefix)
        ts = None if overflow else memory[prefix]
        last_ts = last_ts if ts is None else ts
        yield line_no, offset, length, text, ts, last_ts, overflow


#: Of a split of a long file: its offset, the length of a byte order mark that the text reader took away, the file's size,
#: where reading starts, the lines before and the time carried into it.
SPLIT = "path string, log_file_id long, block long, at long, mark long, size long, start long, seq long, last_ts long"


def line_batches(rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    """Rows in the form of `LINES`, ten thousand at a time."""
    types = {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_()}
    schema = pa.schema([(f.split()[0], types[f.split()[1]]) for f in LINES.split(", ")])
    while out := list(islice(rows, 10_000)):
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)


def read_lines(spark: SparkSession, files: DataFrame, flush_tail: bool = False, encoding: str = "windows-1252", most: int = MOST_LINE_BYTES, resume: DataFrame | None = None, whole_bytes: int = 64 << 20) -> DataFrame:
    """Lines of registered files.  A file of up to `whole_bytes` is one task's work, a longer one is read in splits.

    `resume` (``path, byte_offset, seq, last_ts``) starts a file where an earlier read ended.  A file shorter than that
    raises: it was truncated or replaced.
    """
    paths = [r["path"] for r in files.select("path").collect()]  # file names, not data
    if not paths:
        return spark.createDataFrame([], LINES).withColumn("seq", F.col("line_no"))
    found = spark.read.format("binaryFile").load(paths)
    long = [r["path"] for r in found.filter(F.col("length") > whole_bytes).select("path").collect()]
    begun = resume.select("path", "byte_offset", "seq", "last_ts") if resume is not None else spark.createDataFrame([], "path string, byte_offset long, seq long, last_ts long")
    begun = files.select("path", "log_file_id").join(begun, "path", "left").select("path", "log_file_id", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("byte_offset", "seq", "last_ts")])
    short = [p for p in paths if p not in set(long)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, data, number, start, seq, last in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if start > len(data):
                    raise ValueError(f"{path} has {len(data)} bytes, fewer than the {start} read before: it was truncated or replaced")
                yield from line_batches((path, number, *x) for x in lines_of(data, start, seq, last, flush_tail, encoding, most))

    parts = []
    if short:
        content = spark.read.format("binaryFile").load(short).select("path", "content").join(F.broadcast(begun), "path")
        parts.append(content.mapInArrow(run, LINES))
    if long:
        parts.append(long_lines(spark, long, begun, flush_tail, encoding, most))
    return reduce(DataFrame.union, parts).withColumn("seq", F.col("line_no"))


def runs_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, bytes]]:
    """(what is known of the split, with ``at`` for these bytes; bytes) of the lines of each split, batch by batch.

    A last line without its end has none here either.  What was read before is left out.
    """
    split, at = None, 0
    for batch in batches:
        known, lines = batch.drop_columns(["line"]), batch.column("line").to_pylist()
        marks = list(zip(known.column("path").to_pylist(), known.column("block").to_pylist(), strict=True))
        a = 0
        while a < len(lines):
            b = next((i for i in range(a + 1, len(lines)) if marks[i] != marks[a]), len(lines))
            data = b"\n".join(lines[a:b]) + b"\n"
            if marks[a] != split:
                info = known.slice(a, 1).to_pylist()[0]
                if info["at"] is None:
                    raise RuntimeError("the splits of long files changed while they were read; set spark.sql.files.minPartitionNum")
                if info["start"] > info["size"]:
                    raise ValueError(f"{info['path']} has {info['size']} bytes, fewer than the {info['start']} read before: it was truncated or replaced")
                split, at = marks[a], info["at"]
                data = b"\xef\xbb\xbf" * (info["mark"] // 3) + data
            start, end = max(at, info["start"]), at + len(data)
            # bytes beyond the listed size came after the listing
            yield info | {"at": start}, data[start - at : max(info["size"] - at, 0)]
            a, at = b, end


def long_lines(spark: SparkSession, paths: list[str], begun: DataFrame, flush_tail: bool, encoding: str, most: int) -> DataFrame:
    """Lines of files of any length, read in splits by as many tasks.

    The text reader gives the lines of a split in order but not their place.  The bytes of all splits, then their lines
    and last times, are summed first, and each split starts from the sums before it.  The sums are broadcast: one row for
    each split, some 100 bytes for every 128 MB.
    """
    names = spark.read.format("binaryFile").load(paths).select("path", F.col("_metadata.file_path").alias("file"))
    meta = names.join(F.broadcast(begun), "path")
    rows = spark.read.option("lineSep", "\n").text(paths)
    rows = rows.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("_metadata.file_size").alias("size"), F.col("value").cast("binary").alias("line"))

    whole, earlier = Window.partitionBy("file"), Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy("file", "block").agg(F.sum(F.length("line").cast("long") + 1).alias("bytes"), F.max("size").alias("size"))
    # every line is counted with an end, so a sum below the size means that a byte order mark is missing
    mark = F.when(F.max("size").over(whole) - F.sum("bytes").over(whole) >= 2, 3).otherwise(0)
    placed = sums.withColumn("lost", mark).withColumn("at", F.coalesce(F.sum("bytes").over(earlier), F.lit(0)) + F.when(F.col("block") > 0, F.col("lost")).otherwise(0))
    placed = placed.join(F.broadcast(meta), "file").select("file", "block", "at", F.when(F.col("block") == 0, F.col("lost")).otherwise(0).cast("long").alias("mark"), "size", "path", "log_file_id", F.col("byte_offset").alias("start"), "seq", "last_ts")
    order = ["path", "log_file_id", "block", "at", "mark", "size", "start", "seq", "last_ts"]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, info, lines, seen = None, None, 0, None

        def told() -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([{c: info[c] for c in order} | {"file": info["file"], "at": info["first"], "lines": lines, "seen": seen}], schema=counted)

        for found, data in runs_of(batches):
            if (found["path"], found["block"]) != key:
                if info is not None:
                    yield told()
                key, info, lines, seen = (found["path"], found["block"]), found, 0, None
            for _, _, _, _, own, _, _ in lines_of(data, 0, 0, 0, flush_tail, encoding, most):
                lines, seen = lines + 1, seen if own is None else own
        if info is not None:
            yield told()

    text, number = pa.string(), pa.int64()
    counted = pa.schema([("file", text), ("path", text), *[(c, number) for c in order[1:]], ("lines", number), ("seen", number)])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found() -> Iterator[tuple]:
            key, no, ts = None, 0, 0
            for info, data in runs_of(batches):
                if (info["path"], info["block"]) != key:
                    key, no, ts = (info["path"], info["block"]), info["seq"], info["last_ts"]
                for line in lines_of(data, 0, no, ts, flush_tail, encoding, most):
                    no, ts = line[0], line[5]
                    yield info["path"], info["log_file_id"], no, info["at"] + line[1], *line[2:]

        return line_batches(found())

    def with_line(known: DataFrame) -> DataFrame:
        return rows.select("file", "block", "line").join(F.broadcast(known), ["file", "block"], "left").select("file", *order, F.col("at").alias("first"), "line")

    heads = with_line(placed).mapInArrow(count, "file string, " + SPLIT + ", lines long, seen long")
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    heads = heads.withColumn("seq", F.col("seq") + F.coalesce(F.sum("lines").over(before), F.lit(0))).withColumn("last_ts", F.coalesce(F.last("seen", ignorenulls=True).over(before), "last_ts"))
    return with_line(heads.drop("lines", "seen")).mapInArrow(write, LINES)
