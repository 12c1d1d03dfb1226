"""A streaming source that tails growing JSONL files. The driver lists files and looks at their ends; byte ranges are read on executors.

An offset has, for each path, how far its complete lines reach and a fingerprint of what is before. A file whose beginning is no
longer what it was is read from its start again. All executors must see the files at the same paths.
"""

from __future__ import annotations

import glob
import hashlib
import os
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

#: Bytes of a fingerprint's ends, of a range, of a look back for the last line end, and of lines that are handed on together.
WINDOW, RANGE, BACK, HANDED = 256, 16 << 20, 1 << 16, 1 << 20


def fingerprint(path: str, size: int | None = None) -> str:
    """Hashes of the first and last bytes (of the first ``size``) and the size."""
    size = os.path.getsize(path) if size is None else size
    with open(path, "rb") as f:
        head = f.read(min(WINDOW, size))
        f.seek(max(0, size - WINDOW))
        tail = f.read(min(WINDOW, size))
    return f"{hashlib.sha256(head).hexdigest()}:{hashlib.sha256(tail).hexdigest()}:{size}"


def should_resume(path: str, mark: str) -> bool:
    """Whether the file is what it was, or that with more at its end; else reading starts over."""
    size = int(mark.rsplit(":", 1)[1])
    return os.path.getsize(path) >= size and fingerprint(path, size) == mark


def complete_end(path: str) -> int:
    """Where the last complete line ends, found from the end; what follows is a line that is being written."""
    with open(path, "rb") as f:
        at = f.seek(0, os.SEEK_END)
        while at > 0:
            start = max(0, at - BACK)
            f.seek(start)
            if (hit := f.read(at - start).rfind(b"\n")) >= 0:
                return start + hit + 1
            at = start
    return 0


@dataclass
class Range(InputPartition):
    """Lines of ``path`` that begin from ``low`` on and before ``high``; ``first`` is where the batch begins, ``mark`` what it ends in."""

    path: str
    first: int
    low: int
    high: int
    end: int
    mark: str

    def lines(self) -> Iterator[tuple[int, bytes]]:
        """Where each begins, and the line with its end."""
        with open(self.path, "rb") as f:
            at = self.low
            if at > self.first:
                # The line that reaches over the range's beginning is the range's before.
                f.seek(at - 1)
                at += len(f.readline()) - 1
            f.seek(at)
            while at < self.high:
                line = f.readline()
                if not line.endswith(b"\n") or at + len(line) > self.end:
                    return
                yield at, line
                at += len(line)


class TailReader(DataSourceStreamReader):
    def __init__(self, pattern: str, size: int = RANGE):
        self.pattern, self.size = pattern, size

    def initialOffset(self) -> dict:
        return {"files": {}}

    def latestOffset(self) -> dict:
        files = {}
        for path in sorted(glob.glob(self.pattern, recursive=True)):
            end = complete_end(path)
            files[path] = [end, fingerprint(path, end)]
        return {"files": files}

    def partitions(self, start: dict, end: dict) -> list[Range]:
        out = []
        for path, (stop, mark) in sorted(end["files"].items()):
            at, before = start["files"].get(path, (0, ""))
            if before == mark:
                continue
            at = at if before and os.path.exists(path) and should_resume(path, before) else 0
            out += [Range(path, at, low, min(low + self.size, stop), stop, mark) for low in range(at, stop, self.size)]
        return out

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        rows: list[tuple[int, bytes]] = []
        held = 0
        for at, line in partition.lines():
            rows.append((at, line))
            held += len(line)
            if held >= HANDED:
                yield self._batch(partition, rows)
                rows, held = [], 0
        if rows:
            yield self._batch(partition, rows)

    @staticmethod
    def _batch(part: Range, rows: list[tuple[int, bytes]]) -> pa.RecordBatch:
        last = [part.mark if at + len(line) == part.end else None for at, line in rows]
        columns = [[part.path] * len(rows), [at for at, _ in rows], [len(line) for _, line in rows], [line[:-1].decode("utf-8", "replace") for _, line in rows], last]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()))], ["path", "line", "size", "value", "mark"])


class JsonlTail(DataSource):
    """``spark.dataSource.register(JsonlTail)``; then ``readStream.format("jsonl_tail").load(pattern)``.

    Rows: path, line (the byte at which it begins), size (its bytes), value, and mark (the file's fingerprint, on its last line).
    """

    @classmethod
    def name(cls) -> str:
        return "jsonl_tail"

    def schema(self) -> str:
        return "path string, line long, size long, value string, mark string"

    def streamReader(self, schema) -> TailReader:
        return TailReader(self.options.get("path", ""), int(self.options.get("rangebytes", RANGE)))
