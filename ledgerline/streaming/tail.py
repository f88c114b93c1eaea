"""A streaming source over growing log files, with resumable offsets.

The offset of the stream is, for each file, how many bytes and lines of it were read and the last time seen.  Spark's
checkpoint keeps it, so a restarted query goes on at the next line; an unfinished last line waits for its end.  A file
that has become shorter fails the query.  With ``maxFiles`` only the newest files are read at a time; one that falls
behind them, or is gone, keeps its place and goes on from there when it comes back.  The source runs on the driver, next
to the files, as a tailer does.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader

from ledgerline.sources.log_files import FILE_NAME, LINES, MOST_LINE_BYTES, lines_of


def logs_in(folder: str, newest: int | None = None) -> list[str]:
    """Paths of log files of a folder, the newest first, ties by path."""
    found = [e for e in os.scandir(folder) if e.is_file() and re.fullmatch(FILE_NAME, e.name)]
    ordered = sorted(found, key=lambda e: (-e.stat().st_mtime_ns, e.path))
    return [e.path for e in ordered[:newest]]


class LogTail(DataSource):
    """``format("log_tail")`` with the folder as path; options ``maxFiles``, ``encoding`` and ``maxBytes`` per file and batch."""

    @classmethod
    def name(cls) -> str:
        return "log_tail"

    def schema(self) -> str:
        return LINES

    def simpleStreamReader(self, schema) -> LogTailReader:
        return LogTailReader(self.options)


class LogTailReader(SimpleDataSourceStreamReader):
    def __init__(self, options):
        self.folder, self.encoding = options["path"], options.get("encoding", "windows-1252")
        self.newest = int(options["maxFiles"]) if "maxFiles" in options else None
        self.most = int(options.get("maxBytes", 64 << 20))

    def initialOffset(self) -> dict:
        return {}

    def _part(self, path: str, number: int, state: dict, stop: int | None) -> tuple[list[tuple], dict]:
        size = os.path.getsize(path)
        if size < state["bytes"]:
            raise ValueError(f"{path} has {size} bytes, fewer than the {state['bytes']} read before: it was truncated or replaced")
        end = min(size, state["bytes"] + self.most) if stop is None else stop
        with open(path, "rb") as f:
            f.seek(state["bytes"])
            data = f.read(end - state["bytes"])
        rows, at = [], dict(state)
        for no, offset, length, text, own, ts, over in lines_of(data, 0, state["lines"], state["ts"], encoding=self.encoding, most=MOST_LINE_BYTES):
            rows.append((path, number, no, state["bytes"] + offset, length, text, own, ts, over))
            at = {"number": number, "bytes": state["bytes"] + offset + length, "lines": no, "ts": ts}
        return rows, at

    def _read(self, start: dict, end: dict | None) -> tuple[list[tuple], dict]:
        """Rows of the newest files, or up to `end`; files that are not among them keep their place and wait."""
        listed = sorted(logs_in(self.folder, self.newest)) if end is None else [p for p in end if end[p]["bytes"] > start.get(p, {}).get("bytes", 0)]
        rows, after = [], dict(start)
        for path in listed:
            number = (end or {}).get(path, start.get(path, {})).get("number") or len(after) + 1
            state = start.get(path, {"number": number, "bytes": 0, "lines": 0, "ts": 0})
            found, after[path] = self._part(path, number, state, end[path]["bytes"] if end is not None else None)
            rows += found
        return rows, after

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        rows, after = self._read(start, None)
        return iter(rows), after

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        return iter(self._read(start, end)[0])

    def commit(self, end: dict) -> None:
        pass


def tail(spark: SparkSession, folder: str, **options):
    """Lines of a folder's logs as a stream."""
    spark.dataSource.register(LogTail)
    return spark.readStream.format("log_tail").options(**options).load(folder)
