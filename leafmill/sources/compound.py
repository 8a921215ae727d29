"""Compound files, the container of legacy office formats."""

from __future__ import annotations

import struct
import zlib

from leafmill.sources.package import PackageError

MAX_INFLATED = 200 << 20
_END = 0xFFFFFFFA


class Compound:
    """Streams of a compound file by path (folders joined by /)."""

    def __init__(self, content: bytes) -> None:
        if content[:8] != b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1" or len(content) < 512:
            raise PackageError("no compound file")
        self.data = content
        shift, small_shift = struct.unpack_from("<HH", content, 30)
        if shift not in (9, 12) or small_shift > 12:
            raise PackageError("sector sizes are wrong")
        self.size, self.small = 1 << shift, 1 << small_shift
        n_fat, first_dir, _, self.cutoff, first_mini, n_mini, first_difat, n_difat = struct.unpack_from("<I I I I I I I I", content, 44)
        difat = list(struct.unpack_from("<109I", content, 76))
        at, seen = first_difat, set()
        while at < _END and at not in seen and len(seen) < n_difat + 1:
            seen.add(at)
            more = struct.unpack_from(f"<{self.size // 4}I", self.sector(at))
            difat += more[:-1]
            at = more[-1]
        self.fat: list[int] = []
        for s in difat[: max(n_fat, 0)] if n_fat <= len(difat) else difat:
            if s < _END:
                self.fat += struct.unpack_from(f"<{self.size // 4}I", self.sector(s))
        directory = self.chain(first_dir)
        mini = self.chain(first_mini) if n_mini else b""
        self.mini_fat = list(struct.unpack(f"<{len(mini) // 4}I", mini[: len(mini) // 4 * 4]))
        entries = [directory[k : k + 128] for k in range(0, len(directory) - 127, 128)]
        self.streams: dict[str, tuple[int, int]] = {}
        root = entries[0] if entries else b"\0" * 128
        self.mini_data = self.chain(struct.unpack_from("<I", root, 116)[0])
        self._walk(entries, struct.unpack_from("<I", root, 76)[0], "", set())

    def sector(self, k: int) -> bytes:
        at = (k + 1) * self.size
        return self.data[at : at + self.size].ljust(self.size, b"\0")

    def chain(self, start: int) -> bytes:
        out, seen = [], set()
        while start < _END and start not in seen and (start + 1) * self.size < len(self.data):
            seen.add(start)
            out.append(self.sector(start))
            start = self.fat[start] if start < len(self.fat) else _END
        return b"".join(out)

    def _walk(self, entries: list[bytes], start: int, folder: str, seen: set[int]) -> None:
        stack = [(start, folder)]
        while stack:
            k, folder = stack.pop()
            if k >= len(entries) or k in seen:
                continue
            seen.add(k)
            e = entries[k]
            name = e[: max(0, struct.unpack_from("<H", e, 64)[0] - 2)].decode("utf-16-le", "replace")
            kind, left, right, below = e[66], *struct.unpack_from("<III", e, 68)
            stack += [(left, folder), (right, folder)]
            if kind == 1:
                stack.append((below, f"{folder}{name}/"))
            elif kind == 2:
                self.streams[folder + name] = (struct.unpack_from("<I", e, 116)[0], struct.unpack_from("<Q", e, 120)[0] & 0xFFFFFFFF)

    def read(self, name: str) -> bytes:
        if name not in self.streams:
            raise PackageError(f"no stream {name}")
        start, size = self.streams[name]
        if size >= self.cutoff:
            return self.chain(start)[:size]
        out, seen = [], set()
        while start < _END and start not in seen:
            seen.add(start)
            out.append(self.mini_data[start * self.small : (start + 1) * self.small])
            start = self.mini_fat[start] if start < len(self.mini_fat) else _END
        return b"".join(out)[:size]


def inflate(data: bytes, most: int = MAX_INFLATED) -> bytes:
    """Raw deflate with a bound on what comes out."""
    worker = zlib.decompressobj(-15)
    try:
        out = worker.decompress(data, most)
    except zlib.error as e:
        raise PackageError(f"damaged stream: {e}") from e
    if worker.unconsumed_tail:
        raise PackageError(f"stream inflates beyond {most} bytes")
    return out
