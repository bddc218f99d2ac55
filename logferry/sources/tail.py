"""A streaming source that follows the files of a directory as they grow and rotate.

The built-in file source reads a file once and never again. Here the offset of the stream is the end
of the last finished line of each file, kept by content fingerprint, so that a renamed file goes on
where it was. Each micro-batch reads the bytes between two offsets, cut into ranges.
"""

from __future__ import annotations

import json
import os
import re

from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from logferry import settings as S
from logferry.sources.byteranges import complete_end, identity, line_start


class _Range(InputPartition):
    def __init__(self, path, fingerprint, first, length, start, end, block_no):
        self.path, self.fingerprint, self.first, self.length = path, fingerprint, first, length
        self.start, self.end, self.block_no = start, end, block_no


class _TailReader(DataSourceStreamReader):
    def __init__(self, options):
        self._dir = options["path"]
        self._regex = re.compile(options.get("fileregex", "."))
        self._range = int(options.get("rangebytes", 8 << 20))

    def initialOffset(self) -> dict:
        return {"files": "{}"}

    def latestOffset(self) -> dict:
        seen = {}
        for entry in sorted(os.scandir(self._dir), key=lambda e: e.stat().st_mtime):
            if not entry.is_file() or not self._regex.search(entry.name):
                continue
            try:
                with open(entry.path, "rb") as f:
                    head = f.read(S.FINGERPRINT_BYTES)
                    length = os.fstat(f.fileno()).st_size
                    key = identity(head)
                    if key is None:
                        continue
                    seen[key] = [entry.path, complete_end(f, 0, length)]
            except FileNotFoundError:
                continue
        return {"files": json.dumps(seen, sort_keys=True)}

    def partitions(self, start: dict, end: dict) -> list:
        old, new = json.loads(start["files"]), json.loads(end["files"])
        out = []
        for key, (path, stop) in new.items():
            first = old.get(key, [path, 0])[1]
            for n, at in enumerate(range(first, stop, self._range)):
                out.append(_Range(path, key, first, stop, at, at + self._range, n))
        return out or [_Range("", "", 0, 0, 0, 0, 0)]

    def read(self, partition: _Range):
        if not partition.path:
            return
        with open(partition.path, "rb") as f:
            p = partition
            begin = line_start(f, p.start, p.first, p.length)
            end = line_start(f, p.end, p.first, p.length)
            if begin < end and begin < p.end:
                f.seek(begin)
                yield (p.path, p.fingerprint, p.block_no, begin, f.read(end - begin))

    def commit(self, end: dict) -> None:
        pass


class LogTail(DataSource):
    """``spark.readStream.format("logtail").option("path", directory)``; register it first.

    Options: ``path``, ``fileRegex`` (found in the name), ``rangeBytes``. Rows are blocks as in
    :mod:`logferry.operators.records`.
    """

    @classmethod
    def name(cls) -> str:
        return "logtail"

    def schema(self) -> str:
        return "path string, fingerprint string, block_no bigint, block_start bigint, content binary"

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _TailReader({k.lower(): v for k, v in self.options.items()})
