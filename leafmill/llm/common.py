"""Primitives shared by the corpus operators.

Text is handled as the UTF-8 bytes of Arrow string arrays: numpy works on the
buffers that Spark hands over, and no Python string is made per word.
"""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

try:
    _LIBC = ctypes.CDLL("libc.so.6")
except OSError:  # not a glibc system
    _LIBC = None

#: Bytes of text that are worked on at once; a longer text is a slice of its own.
SLICE_BYTES = 1 << 20
#: Bytes by which a long run of letters is cut: before one in four characters of three bytes, one in 16 others.
CUT_BYTES = 8

_LETTER = np.zeros(256, bool)
_LETTER[np.r_[48:58, 65:91, 97:123, 128:256]] = True
_FOLD = np.arange(1, 257, dtype=np.uint64)
_FOLD[65:91] += np.uint64(32)
_EXACT = np.arange(1, 257, dtype=np.uint64)
_BASE = 0x9E3779B97F4A7C15
#: Bytes that are hashed at once; the powers of the base are kept for so many.
_BLOCK = 1 << 17
_POWERS = np.full(_BLOCK, _BASE, np.uint64)
_POWERS[0] = 1
_POWERS = np.cumprod(_POWERS, dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit (splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def run_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, fold: bool = True) -> np.ndarray:
    """The hash of each data[start:end] (none empty): the sum of its bytes times powers of a base. Bytes
    are taken in blocks of bounded size, so a long text needs no more memory than its runs."""
    table, out = _FOLD if fold else _EXACT, np.zeros(len(start), np.uint64)
    size = end - start
    upto = np.cumsum(size)
    at = 0
    while at < len(start):
        done = int(upto[at - 1]) if at else 0
        to = int(np.searchsorted(upto, done + _BLOCK, "right"))
        if to == at:  # one run of more than a block
            scale, total = 1, 0
            for k in range(int(start[at]), int(end[at]), _BLOCK):
                part = table[data[k : min(k + _BLOCK, int(end[at]))]]
                total += scale * int((part * _POWERS[: len(part)]).sum(dtype=np.uint64))
                scale = scale * pow(_BASE, _BLOCK, 1 << 64) % (1 << 64)
            out[at] = total % (1 << 64)
            to = at + 1
        else:
            n = size[at:to]
            first = np.cumsum(n) - n
            within = np.arange(int(n.sum())) - np.repeat(first, n)
            out[at:to] = np.add.reduceat(table[data[within + np.repeat(start[at:to], n)]] * _POWERS[within], first)
        at = to
    return out


def trim() -> None:
    """Gives memory that numpy and Arrow have freed back to the system: workers are used again by later stages."""
    pa.default_memory_pool().release_unused()
    if _LIBC is not None:
        _LIBC.malloc_trim(0)


def tidy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches; after the last, freed memory goes back to the system."""
    yield from batches
    trim()


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string array and where each row starts in them; null reads as empty."""
    if column.null_count:
        column = pc.fill_null(column, "")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, where, data = column.buffers()
    offsets = np.frombuffer(where, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Each batch cut into runs of rows with at most so many bytes of text, or one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, offsets = utf8(batch.column(batch.schema.get_field_index(column)))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
            yield batch.slice(at, to - at)
            at = to


class Words:
    """Words of several texts: start and end (bytes), hash, text number; per text, its first word."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, fold: bool = True, longest: int = 0) -> None:
        """A word is a run of letters, digits and non-ASCII characters; each CJK or astral
        character is a word. fold: ASCII case doesn't count. longest: longer words are cut
        where a hash of the CUT_BYTES bytes before a character says so, which is the same wherever
        they stand, and pieces that are still longer (runs of few bytes again and again) at every so
        many bytes from their start."""
        n = len(data)
        word = _LETTER[data]
        first = word.copy()
        first[1:] &= ~word[:-1]
        edges = offsets[:-1][offsets[:-1] < n]
        first[edges] |= word[edges]
        lead = data >= 0xE3
        if lead.any():
            wide = lead.copy()
            for k in (1, 2):
                wide[k:] |= lead[:-k]
            wide[3:] |= data[:-3] >= 0xF0
            first |= lead
            first[1:] |= word[1:] & ~wide[1:] & wide[:-1]
        last = word.copy()
        last[:-1] &= ~word[1:] | first[1:]
        self.start, self.end = np.flatnonzero(first), np.flatnonzero(last) + 1
        if longest and len(self.start) and (size := self.end - self.start).max() > longest:
            size = np.where(size > longest, np.maximum(size - CUT_BYTES, 0), 0)
            at = ragged(self.start + CUT_BYTES, size)
            at = at[data[at] & 0xC0 != 0x80]
            by, table = np.zeros(len(at), np.uint64), _FOLD if fold else _EXACT
            for k in range(CUT_BYTES):
                by += table[data[at - CUT_BYTES + k]] * _POWERS[k]
            cut = at[mix(by) & np.where(data[at] >= 0xE0, 3, 15).astype(np.uint64) == 0]
            self.start, self.end = np.sort(np.append(self.start, cut)), np.sort(np.append(self.end, cut))
            size = self.end - self.start
            parts = -(-size // longest)
            within = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
            self.start, end = np.repeat(self.start, parts) + within * longest, np.repeat(self.end, parts)
            self.end = np.minimum(self.start + longest, end)
        self._data, self._fold = data, fold
        self.hash = mix(run_hashes(data, self.start, self.end, fold))
        self.first = np.searchsorted(self.start, offsets)
        self.count = np.diff(self.first)
        self.text = np.repeat(np.arange(len(offsets) - 1), self.count)

    def prefix(self, size: int) -> np.ndarray:
        """The hash of each word's first bytes; of a shorter word, of all."""
        return mix(run_hashes(self._data, self.start, np.minimum(self.end, self.start + size), self._fold) + np.uint64(1))

    def __len__(self) -> int:
        return len(self.start)


class Remembered:
    """Up to so many values by key: of two generations the older goes when the newer is full."""

    def __init__(self, most: int) -> None:
        self.most, self.new, self.old = most, {}, {}

    def get(self, key: int) -> object | None:
        found = self.new.get(key)
        if found is None and (found := self.old.get(key)) is not None:
            self.put(key, found)
        return found

    def put(self, key: int, value: object) -> None:
        if 2 * len(self.new) >= self.most:
            self.old, self.new = self.new, {}
        self.new[key] = value


def encode_units(text: np.ndarray, start: np.ndarray, encode: Callable[[list[bytes]], list[bytes]], known: Remembered | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Ids of text, cut into units at `start`, and where each unit's begin. Each distinct unit is encoded
    once, as 32-bit ids in bytes; `known`, if given, keeps them by a 64-bit hash for later calls."""
    end = np.append(start[1:], len(text))
    one, where, which = np.unique(mix(run_hashes(text, start, end, False)), return_index=True, return_inverse=True)
    raw, keys = text.tobytes(), one.tolist()
    found = [None] * len(keys) if known is None else [known.get(h) for h in keys]
    new = [k for k, x in enumerate(found) if x is None]
    begins, ends = start[where[new]].tolist(), end[where[new]].tolist()
    for k, ids in zip(new, encode([raw[x:y] for x, y in zip(begins, ends)])):
        found[k] = ids
        if known is not None and len(ids) < 256:
            known.put(keys[k], ids)
    count = np.array([len(x) >> 2 for x in found], np.int64)
    flat = np.frombuffer(b"".join(found), np.int32)
    begin = np.cumsum(count) - count
    return flat[ragged(begin[which], count[which])], np.concatenate([[0], np.cumsum(count[which])])


def suffix_array(symbols: np.ndarray, depth: int = 1 << 60, keep: bool = True) -> tuple[np.ndarray, list[tuple[int, np.ndarray]]]:
    """Suffix array by prefix doubling: the order of all suffixes by their first `depth` symbols at
    least, and for k = 1, 2, 4 ... the rank of every suffix by its first k symbols. Only suffixes
    that are still tied are sorted again. keep: all ranks are returned, else only the last."""
    n = len(symbols)
    order = np.argsort(symbols)
    by = symbols[order]
    new = np.ones(n, bool)
    new[1:] = by[1:] != by[:-1]
    heads, group = np.flatnonzero(new), np.cumsum(new) - 1
    rank = np.empty(n, np.int32)
    rank[order] = heads[group]
    levels, tied, k = [(1, rank)], np.flatnonzero((np.diff(np.append(heads, n)) > 1)[group]), 1
    while len(tied) and k < depth:
        at = order[tied]
        after = at + k
        key = (rank[at].astype(np.int64) << 32) | np.where(after < n, rank[np.minimum(after, n - 1)].astype(np.int64) + 1, 0)
        o = np.argsort(key)
        key, at = key[o], at[o]
        order[tied] = at
        new = np.ones(len(tied), bool)
        new[1:] = key[1:] != key[:-1]
        heads, group = np.flatnonzero(new), np.cumsum(new) - 1
        rank = rank.copy() if keep else rank
        rank[at] = tied[heads][group]
        k *= 2
        levels.append((k, rank))
        tied = tied[(np.diff(np.append(heads, len(tied))) > 1)[group]]
    return order, levels


def neighbour_lcp(order: np.ndarray, levels: list[tuple[int, np.ndarray]]) -> np.ndarray:
    """Longest common prefix of each suffix with the next in suffix order (one fewer than suffixes)."""
    n = len(order)
    lcp = np.zeros(max(n - 1, 0), np.int64)
    first = levels[0][1]
    live = np.flatnonzero(first[order[:-1]] == first[order[1:]])
    a, b = order[:-1][live].copy(), order[1:][live].copy()
    for k, rank in reversed(levels):
        inside = (a < n) & (b < n)
        same = inside & (rank[np.minimum(a, n - 1)] == rank[np.minimum(b, n - 1)])
        lcp[live[same]] += k
        a[same] += k
        b[same] += k
    return lcp


def local_uri(path: str) -> str:
    """A URI that pyarrow opens: Spark writes file:/x where pyarrow wants a plain path, and s3a where it wants s3."""
    return "/" + path[5:].lstrip("/") if path.startswith("file:") else "s3" + path[3:] if path.startswith("s3a:") else path


def ragged(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[0] .. starts[0]+counts[0]-1, starts[1] .. and so on, in one array."""
    total = int(counts.sum())
    return np.repeat(starts - (np.cumsum(counts) - counts), counts) + np.arange(total)


#: All folders made here lie below one of this name.
_TEMPORARY = "_leafmill"


def shared_folder(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir, which all executors share. Where that is unset, a session
    on one machine, as in tests, gets a folder below its warehouse; on a cluster that is an error, as
    executors don't share a machine's folders."""
    folder = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_shared"
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(folder)
    return f"{folder.rstrip('/')}/{_TEMPORARY}/{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written as a table in the shared folder and read again: it cuts lineage and survives the
    loss of executors. Nulls, repeated rows and empty tables come back as they are. forget() deletes it."""
    path = f"{shared_folder(df.sparkSession)}/{name}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, path: str) -> None:
    """Deletes a folder that shared_folder() named, with all in it; no other is touched."""
    if f"/{_TEMPORARY}/" in path:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def folders(*tables: DataFrame) -> list[str]:
    """The folders of stored() tables."""
    return [file.rpartition("/")[0].rpartition("/")[0] for df in tables for file in df.inputFiles()[:1]]


def forget(*tables: DataFrame) -> None:
    """Deletes the files of stored() tables that nothing reads any more."""
    for df in tables:
        for folder in folders(df):
            discard(df.sparkSession, folder)


def free_name(df: DataFrame, name: str) -> str:
    """name, lengthened until no column of df has it (case doesn't count)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
