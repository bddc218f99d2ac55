"""Knowing a file by its content, and cutting it at line starts. Plain helpers that run inside tasks."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

from logferry import settings as S

_CHUNK = 1 << 16


def identity(head: bytes) -> str | None:
    """The fingerprint that :func:`logferry.operators.files.fingerprint` gives a file with this beginning."""
    head = head[: S.FINGERPRINT_BYTES]
    cut = head.find(b"\n") + 1
    if not cut and len(head) < S.FINGERPRINT_BYTES:
        return None
    return hashlib.sha256(head[:cut] if cut else head).hexdigest()


def line_start(f, at: int, first: int, length: int) -> int:
    """The first place at or after ``at`` where a line starts; ``length`` if there is none.

    ``first`` is known to be a line start. A line ends with LF, CR or CRLF.
    """
    if at <= first:
        return first
    if at >= length:
        return length
    f.seek(at - 1)
    data = f.read(min(_CHUNK, length - at + 1))
    if data[:1] == b"\n":
        return at
    base = at - 1
    while data:
        ends = [p for p in (data.find(b"\n"), data.find(b"\r")) if p >= 0]
        if ends:
            p = min(ends)
            if data[p : p + 1] == b"\r":
                follow = data[p + 1 : p + 2]
                if not follow and base + p + 1 < length:
                    f.seek(base + p + 1)
                    follow = f.read(1)
                if follow == b"\n":
                    p += 1
            return min(base + p + 1, length)
        base += len(data)
        f.seek(base)
        data = f.read(min(_CHUNK, length - base))
    return length


def complete_end(f, start: int, length: int) -> int:
    """End of the last finished line in [start, length); ``start`` if there is none.

    A CR in the last byte may still become a CRLF, so it does not finish a line.
    """
    end = length
    while end > start:
        begin = max(start, end - _CHUNK)
        f.seek(begin)
        data = f.read(end - begin)
        p = data.rfind(b"\n")
        r = data.rfind(b"\r", 0, len(data) - (1 if end == length else 0))
        if max(p, r) >= 0:
            return begin + max(p, r) + 1
        end = begin
    return start


class Files:
    """Files by path or URI, on the local or any other file system; one is open at a time."""

    def __init__(self) -> None:
        self._path, self._file, self._systems = None, None, {}
        self._moved: dict[tuple, str | None] = {}

    def locate(self, path: str):
        """The file system of a path and the name it uses."""
        from pyarrow import fs

        # file:/x and file:///x mean the same; other schemes go to their own file system.
        scheme, sep, rest = path.partition(":/")
        if sep and scheme != "file":
            if scheme not in self._systems:
                self._systems[scheme] = fs.FileSystem.from_uri(path)[0]
            return self._systems[scheme], fs.FileSystem.from_uri(path)[1]
        return fs.LocalFileSystem(), "/" + rest.lstrip("/") if sep else path

    def open(self, path: str):
        if path != self._path:
            self.close()
            system, name = self.locate(path)
            self._file, self._path = system.open_input_file(name), path
        return self._file

    def inside(self, folder: str) -> Iterator[tuple]:
        """(path, name, mtime, length) of the regular files directly in a directory, under the same kind of path."""
        from pyarrow import fs

        system, name = self.locate(folder.rstrip("/") or "/")
        prefix = folder.rstrip("/").removesuffix(name)
        for info in system.get_file_info(fs.FileSelector(name)):
            if info.type == fs.FileType.File:
                yield prefix + info.path, info.base_name, info.mtime, info.size

    def beside(self, path: str) -> Iterator[str]:
        """The other files in the directory of ``path``."""
        try:
            yield from (other for other, *_ in self.inside(path.rpartition("/")[0] or "/") if other != path)
        except OSError:
            return

    def is_known(self, f, fingerprint: str | None, least: int) -> bool:
        """Is the open file the one that was listed: its beginning is the same, and it isn't shorter."""
        if f.size() < least:
            return False
        return fingerprint is None or identity(f.read_at(min(S.FINGERPRINT_BYTES, f.size()), 0)) == fingerprint

    def open_known(self, path: str, fingerprint: str | None, least: int):
        """The file with this fingerprint and ``least`` bytes or more: the one at ``path`` or, if that shows another
        one by now, one beside it. None if there is none. An open file stays the same whatever its name becomes."""

        def opened(where: str):
            try:
                f = self.open(where)
                if self.is_known(f, fingerprint, least):
                    return f
                self.close()  # another file may lie there by now
                f = self.open(where)
                return f if self.is_known(f, fingerprint, least) else None
            except OSError:
                return None

        key = (path, fingerprint)
        f = opened(self._moved.get(key) or path)
        if f is None and fingerprint is not None and self._moved.get(key, "") is not None:
            self._moved[key] = None  # looked for once per task, not once per range
            for other in self.beside(path):
                f = opened(other)
                if f is not None:
                    self._moved[key] = other
                    break
        return f

    def close(self) -> None:
        if self._file is not None:
            self._file.close()
        self._path, self._file = None, None
