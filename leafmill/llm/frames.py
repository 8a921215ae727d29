"""Token ids in independent zstandard frames with a seek table.

Each task writes one shard: frames of whole documents' ids (little-endian, two
bytes each where the vocabulary allows), then a skippable frame with a seek
table in zstandard's seekable format: compressed size, decompressed size and
checksum of every frame. Any zstandard tool decompresses a shard; with the index
a reader seeks to the frames of the documents it wants and decompresses only them.
"""

from __future__ import annotations

import base64
import struct
from array import array
from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import tiktoken
import xxhash
import zstandard
from pyarrow.fs import FileSystem
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.llm.common import SLICE_BYTES, encode_units, local_uri, shared_folder, slices, tidy, utf8

#: The vocabulary's file: a line for each token, its bytes in base64 and its id. It must exist on every executor.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: How text is cut before merging, as for the vocabulary above.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Bytes of ids in a frame, about; a document of more is a frame by itself.
FRAME_BYTES = 64 << 10
LEVEL = 3

_SKIPPABLE, _SEEKABLE, _CHECKSUMS = 0x184D2A5E, 0x8F92EAB1, 0x80
_OUT = "shard string, frame int, frame_offset bigint, frame_bytes bigint, frame_checksum bigint, first_token bigint, n_tokens bigint"


@cache
def encoding(path: str = VOCABULARY, pattern: str = PATTERN) -> tiktoken.Encoding:
    """The tokenizer of a vocabulary file; a text's special strings are ordinary text."""
    with open(path) as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}
    return tiktoken.Encoding(path, pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


class FrameWriter:
    """Writes frames to a file that is open for binary writing."""

    def __init__(self, out: object, level: int = LEVEL) -> None:
        self.out, self.at, self.entries = out, 0, []
        self.compressor = zstandard.ZstdCompressor(level=level, write_checksum=True, write_content_size=True)

    def frame(self, data: bytes) -> tuple[int, int, int, int]:
        """Writes a frame; returns its number, offset, compressed size and checksum. The seek table has 32
        bits for a size, so content of 4 GiB and more is refused."""
        if len(data) >= 1 << 32:
            raise ValueError("a frame holds less than 4 GiB")
        packed = self.compressor.compress(data)
        check = xxhash.xxh64_intdigest(data) & 0xFFFFFFFF
        self.out.write(packed)
        self.entries.append((len(packed), len(data), check))
        self.at += len(packed)
        return len(self.entries) - 1, self.at - len(packed), len(packed), check

    def close(self) -> None:
        """Writes the seek table."""
        body = b"".join(struct.pack("<III", *e) for e in self.entries) + struct.pack("<IBI", len(self.entries), _CHECKSUMS, _SEEKABLE)
        self.out.write(struct.pack("<II", _SKIPPABLE, len(body)) + body)


class FrameReader:
    """Reads single frames of a shard. Sizes over 4 GiB don't fit the seek table's format."""

    def __init__(self, file: pa.NativeFile) -> None:
        self.file, size = file, file.size()
        file.seek(size - 9)
        count, descriptor, magic = struct.unpack("<IBI", file.read(9))
        if magic != _SEEKABLE:
            raise ValueError("no seek table at the end of the file")
        width = 12 if descriptor & _CHECKSUMS else 8
        file.seek(size - 9 - width * count)
        raw = file.read(width * count)
        self.sizes = np.array([struct.unpack_from("<II", raw, width * k) for k in range(count)], np.int64).reshape(-1, 2)
        self.checks = [struct.unpack_from("<I", raw, width * k + 8)[0] for k in range(count)] if width == 12 else None
        self.offsets = np.concatenate([[0], np.cumsum(self.sizes[:, 0])])

    def frame(self, number: int) -> bytes:
        """The content of a frame, held against its checksum."""
        self.file.seek(int(self.offsets[number]))
        data = zstandard.ZstdDecompressor().decompress(self.file.read(int(self.sizes[number, 0])), max_output_size=int(self.sizes[number, 1]))
        if self.checks is not None and xxhash.xxh64_intdigest(data) & 0xFFFFFFFF != self.checks[number]:
            raise ValueError(f"checksum of frame {number} is wrong")
        return data


def _units(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where units of text begin that the pattern never goes over: at a text's begin, and at a space after a visible character."""
    first = np.zeros(len(data), bool)
    shown = (data >= 33) & (data <= 126)
    space = data == 0x20
    first[1:] = space[1:] & shown[:-1]
    first[1:-1] |= space[1:-1] & (data[:-2] >= 0x80) & shown[2:]
    first[offsets[:-1][np.diff(offsets) > 0]] = True
    return np.flatnonzero(first)


@cache
def _lengths(name: str, size: int) -> np.ndarray:
    return np.zeros(size, np.int64)


def _many(coder: tiktoken.Encoding, units: list[bytes]) -> list[bytes]:
    """The ids of each unit, as 32-bit ids in bytes. Units that begin at a space and end with a visible
    character are encoded one behind the other in a single call, since nothing goes over their borders."""
    out = [b""] * len(units)
    joined = [k for k, u in enumerate(units) if u[0] == 0x20 and 33 <= u[-1] <= 126]
    lengths = _lengths(coder.name, coder.n_vocab)
    if not lengths.any():
        for i in range(coder.n_vocab):
            try:
                lengths[i] = len(coder.decode_single_token_bytes(i))
            except KeyError:  # an id that is free
                continue
    if joined:
        ids = np.array(coder.encode_ordinary(b"".join(units[k] for k in joined).decode()), np.int32)
        ends = np.searchsorted(np.cumsum(lengths[ids]), np.cumsum([len(units[k]) for k in joined])) + 1
        raw, at = ids.tobytes(), 0
        for k, end in zip(joined, (4 * ends).tolist()):
            out[k], at = raw[at:end], end
    for k in set(range(len(units))).difference(joined):
        out[k] = array("i", coder.encode_ordinary(units[k].decode())).tobytes()
    return out


def token_ids(coder: tiktoken.Encoding, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts, and where each text's begin."""
    if not len(data):
        return np.zeros(0, np.int32), np.zeros(len(offsets), np.int64)
    start = _units(data, offsets)
    ids, upto = encode_units(data, start, lambda units: _many(coder, units))
    return ids, upto[np.searchsorted(start, offsets)]


def _open(folder: str) -> tuple[FileSystem, str]:
    return FileSystem.from_uri(local_uri(folder))


def _shard(batches: Iterator[pa.RecordBatch], folder: str, path: str, pattern: str, frame_bytes: int) -> Iterator[pa.RecordBatch]:
    coder = encoding(path, pattern)
    kind = np.dtype("<u2") if coder.n_vocab <= 1 << 16 else np.dtype("<u4")
    fs, where = _open(folder)
    writer = out = None
    name = f"shard-{TaskContext.get().partitionId():06d}-{TaskContext.get().taskAttemptId()}.zst"  # an attempt that fails leaves a file that no index names
    waiting: list[tuple[int, int, int]] = []  # rows of the batch, first token, tokens
    parts: list[bytes] = []
    size = 0
    for part in slices(batches, "text", 2 * SLICE_BYTES):
        n = part.num_rows
        columns: dict[str, list] = {k: [None] * n for k in ("frame", "frame_offset", "frame_bytes", "frame_checksum", "first_token", "n_tokens")}

        def flush() -> None:
            nonlocal writer, out, size
            if not waiting:
                return
            if writer is None:
                fs.create_dir(where, recursive=True)
                out = fs.open_output_stream(f"{where}/{name}", compression=None)  # else the name makes it compress again
                writer = FrameWriter(out)
            found = writer.frame(b"".join(parts))
            for row, first, count in waiting:
                for k, x in zip(columns, (*found, first, count)):
                    columns[k][row] = x
            waiting.clear()
            parts.clear()
            size = 0

        ids, upto = token_ids(coder, *utf8(part.column(1)))
        ids, upto = ids.astype(kind), upto.tolist()
        for row, null in enumerate(part.column(1).is_null().to_pylist()):
            if null:
                continue
            raw = ids[upto[row] : upto[row + 1]].tobytes()
            if not raw:
                columns["first_token"][row] = columns["n_tokens"][row] = 0
                continue
            if waiting and size + len(raw) > frame_bytes:
                flush()
            waiting.append((row, size // kind.itemsize, len(raw) // kind.itemsize))
            parts.append(raw)
            size += len(raw)
        flush()
        types = dict(x.split() for x in _OUT.split(", "))
        arrays = [pa.array([name if f is not None else None for f in columns["frame"]], pa.string())]
        arrays += [pa.array(columns[k], pa.int32() if types[k] == "int" else pa.int64()) for k in columns]
        yield pa.RecordBatch.from_arrays([part.column(0), *arrays], names=["doc_id", "shard", *columns])
    if writer is not None:
        writer.close()
        out.close()


def write(docs: DataFrame, folder: str | None = None, key: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY, pattern: str = PATTERN, frame_bytes: int = FRAME_BYTES) -> tuple[str, DataFrame]:
    """Writes shards and an index below folder (one in the shared folder by default) and returns the
    folder and the index: doc_id, shard, frame, frame_offset, frame_bytes, frame_checksum, first_token (in
    the frame) and n_tokens of every row of docs.

    A null text has a null n_tokens and an empty one 0, both without a frame; null keys are carried;
    repeated rows are each written; other columns don't matter; an empty table gives an empty index. Spark's
    texts have less than 2 GiB, whose ids fit a frame if they are of two bytes; with a larger vocabulary a
    text of 2**30 ids or more is an error. There is no shuffle."""
    folder = folder or f"{shared_folder(docs.sparkSession)}/tokens"
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return tidy(_shard(batches, f"{folder}/shards", vocabulary, pattern, frame_bytes))

    docs.select(F.col(f"`{key}`").alias("doc_id"), F.col(f"`{text}`").alias("text")).mapInArrow(run, f"doc_id {kind}, {_OUT}").write.parquet(f"{folder}/index")
    return folder, docs.sparkSession.read.schema(f"doc_id {kind}, {_OUT}").parquet(f"{folder}/index")


def read(folder: str, rows: Iterable[dict], vocabulary: str = VOCABULARY, pattern: str = PATTERN) -> Iterator[tuple[object, list[int] | None]]:
    """(doc_id, ids) of rows of the index; a frame is decompressed once for neighbouring rows."""
    coder = encoding(vocabulary, pattern)
    kind = np.dtype("<u2") if coder.n_vocab <= 1 << 16 else np.dtype("<u4")
    fs, where = _open(folder)
    shard, number, reader, data = None, None, None, b""
    for r in rows:
        if not r["n_tokens"]:
            yield r["doc_id"], None if r["n_tokens"] is None else []
            continue
        if r["shard"] != shard:
            reader, shard, number = FrameReader(fs.open_input_file(f"{where}/shards/{r['shard']}")), r["shard"], None
        if r["frame"] != number:
            data, number = reader.frame(r["frame"]), r["frame"]
        at = r["first_token"] * kind.itemsize
        yield r["doc_id"], np.frombuffer(data[at : at + r["n_tokens"] * kind.itemsize], kind).tolist()


def read_back(folder: str, index: DataFrame, vocabulary: str = VOCABULARY, pattern: str = PATTERN) -> DataFrame:
    """(doc_id, ids, text) of the index's rows (all, or those that a filter leaves), read from their
    frames alone, shard by shard. A null text comes back as null ids and text, an empty one empty; null keys
    and repeated rows come back as they are."""
    kind = index.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoding(vocabulary, pattern)
        for b in batches:
            found = list(read(folder, b.to_pylist(), vocabulary, pattern))
            ids = [x for _, x in found]
            texts = [None if x is None else coder.decode(x) for x in ids]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.list_(pa.int32())), pa.array(texts, pa.string())], names=["doc_id", "ids", "text"])

    return index.repartition("shard").sortWithinPartitions("shard", "frame", "first_token").mapInArrow(run, f"doc_id {kind}, ids array<int>, text string")
