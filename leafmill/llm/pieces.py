"""SentencePiece encoding and decoding by a max-plus scan.

A segmentation of a text is what the merges of a byte-pair model give exactly if
every two neighbouring pieces are what the merges give for those two alone. So
a neighbour scores 0 or minus infinity, and the encoding is the one path of
score 0. Where two characters stand side by side that no piece holds together,
nothing merges; there the path has one state, and a unit of text ends. A giant document is cut
at fixed marks into chunks, whatever stands there: the states at a mark are the
pieces that may end at or reach over it, a chunk yields the max-plus matrix
between the states at its two marks, and the matrices of FAN_IN neighbours are
combined associatively, level by level, up to the whole document. Downwards,
every group hands its members the states at their marks, so that each chunk is
traced back by itself; no task holds more than FAN_IN matrices of a document.

The table of pieces is that of a public model, which is given by path.
"""

from __future__ import annotations

import uuid
from array import array
from collections.abc import Iterator
from functools import cached_property, reduce

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.llm.common import Remembered, encode_units, free_name, ragged, slices, stored, tidy, utf8

#: The model's file; the folder must exist wherever the driver runs, executors get the table from it.
MODEL_PATH = "/opt/tokenizers/piece_bpe_32k.model"
#: Characters of a chunk; texts of more are encoded chunk by chunk. It must exceed twice the longest piece.
CHUNK_CHARS = 32768
#: Text units (mostly words) whose pieces a worker remembers.
REMEMBERED = 300_000
#: Neighbouring pieces of which a worker remembers whether they may stand side by side.
PAIRS = 400_000
#: Bytes of text that are worked on at once.
AT_ONCE = 2 << 20
#: Matrices that are combined at once.
FAN_IN = 16

_MARK = "▁"
START, END = -2, -3
State = tuple[int, int]


class Pieces:
    """The pieces of a byte-pair model, and which may stand side by side."""

    def __init__(self, path: str = MODEL_PATH) -> None:
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        names, scores = [model.id_to_piece(i) for i in range(n)], [model.get_score(i) for i in range(n)]
        self.bytes_of: list[bytes] = [b"" if model.is_control(i) or model.is_unknown(i) else bytes([int(p[3:-1], 16)]) if model.is_byte(i) else p.replace(_MARK, " ").encode() for i, p in enumerate(names)]
        self.byte_id = {int(p[3:-1], 16): i for i, p in enumerate(names) if model.is_byte(i)}
        self.unknown = model.unk_id()
        own = [i for i in range(n) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        self.bare = model.piece_to_id(_MARK)
        self.spaces = {len(names[i]): i for i in own if not names[i].strip(_MARK)}
        self.text = {i: names[i].replace(_MARK, " ") for i in own if names[i].strip(_MARK) or i == self.bare}
        self.id = {t: i for i, t in self.text.items()}
        self.rank = {i: -1.0 if len(t) == 1 else -scores[i] for i, t in self.text.items()}
        self.longest = max(map(len, self.id))
        #: Pairs of bytes that stand side by side in some piece, and those in which a character begins second.
        self.pairs = np.zeros((256, 256), bool)
        for t in self.id:
            raw = np.frombuffer(t.encode(), np.uint8)
            self.pairs[raw[:-1], raw[1:]] = True
        self.pairs[:, 0x80:0xC0] = True
        self.left: dict[int, int] = {}
        self.right: dict[int, int] = {}
        for i, t in self.text.items():
            if len(t) > 1:
                self._split(i, t)
        self.made = {t: i for t, i in self.id.items() if len(t) == 1 or i in self.left}
        #: The piece by its text, and -1 by each other end of a piece.
        self.ends = {t[k:]: -1 for t in self.made for k in range(len(t))} | self.made
        self.begins = {t[:k]: -1 for t in self.made for k in range(1, len(t))} | self.made
        self.beside: dict[int, bool] = {}
        self.known = Remembered(REMEMBERED)

    def __getstate__(self) -> dict[str, object]:
        return {k: v for k, v in self.__dict__.items() if k != "table"} | {"beside": {}, "known": Remembered(REMEMBERED)}

    def _split(self, piece: int, text: str) -> None:
        """Remembers the last merge that makes a piece; a piece that merges don't make is never used."""
        parts = list(text)
        while len(parts) > 2:
            at = min(range(len(parts) - 1), key=lambda k: self.rank.get(self.id.get(parts[k] + parts[k + 1], -1), np.inf))
            if parts[at] + parts[at + 1] not in self.id:
                return
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        a, b = (self.id.get(x) for x in parts)
        if a is not None and b is not None:
            self.left[piece], self.right[piece] = a, b

    def allowed(self, a: int, b: int) -> bool:
        """Whether no merge goes over the border of pieces a and b. Their last merges are undone,
        latest first, and each two parts that were beside the border at a time are looked up."""
        if a < 0 or b < 0:  # a border of a unit, or a character that no piece holds
            return True
        found = self.beside.get(a << 32 | b)
        if found is None:
            if len(self.beside) >= PAIRS:
                self.beside.clear()
            found = self.beside[a << 32 | b] = self._allowed(a, b)
        return found

    def _allowed(self, x: int, y: int) -> bool:
        until_x = until_y = np.inf
        while True:
            both = self.id.get(self.text[x] + self.text[y])
            if both is not None and self.rank[both] < until_x and self.rank[both] <= until_y:
                return False
            if self.rank[x] < 0 and self.rank[y] < 0:
                return True
            if self.rank[x] > self.rank[y]:
                until_x, x = self.rank[x], self.right[x]
            else:
                until_y, y = self.rank[y], self.left[y]

    def forward(self, text: str, begin: int, stop: int, state: State) -> dict[int, tuple[int, int]]:
        """For each end up to stop + longest - 1 that pieces beginning in text[begin:stop] reach from
        state (end, piece): the last piece and where it begins. The border at the state may be in text's middle."""
        last: dict[int, tuple[int, int]] = {state[0]: (state[1], -1)}
        self.onward(text, state[0], stop, last)
        return last

    def onward(self, text: str, begin: int, stop: int, last: dict[int, tuple[int, int]]) -> None:
        """Goes on from the borders in `last`, of which `begin` is the last."""
        ends, beside = self.ends.get, self.beside.get
        for p in range(begin + 1, min(len(text), stop + self.longest - 1) + 1):
            at = p - 1
            while at >= 0:
                piece = ends(text[at:p])
                if at == p - 1 and (piece is None or piece < 0):
                    piece = -10 - ord(text[at])  # a character that no piece holds
                elif piece is None:
                    break
                if piece != -1 and at < stop and (before := last.get(at)) is not None:
                    fits = beside(before[0] << 32 | piece) if piece >= 0 else None
                    if self.allowed(before[0], piece) if fits is None else fits:
                        last[p] = (piece, at)
                        break
                at -= 1

    def back(self, last: dict[int, tuple[int, int]], end: int) -> list[int]:
        """The pieces on the path to end; unheld characters as their bytes."""
        out: list[int] = []
        piece, at = last[end]
        while at >= 0:
            out += [piece] if piece >= 0 else reversed(self.bytes_as_ids(piece))
            piece, at = last[at]
        return out[::-1]

    def unit(self, text: str) -> list[int]:
        """The pieces of a text that is a unit by itself. The path is looked for from the left, longest
        piece first; a place from which it doesn't go on is left for good, as only one path leads to it."""
        whole = self.made.get(text)
        if whole is not None:
            return [whole]
        begins, beside, n = self.begins.get, self.beside.get, len(text)
        taken: list[tuple[int, int]] = []
        dead: set[int] = set()
        at, before = 0, START
        while at < n:
            fits, k = [], at + 1
            while k <= n and (piece := begins(text[at:k])) is not None:
                if piece >= 0:
                    fits.append((piece, k))
                k += 1
            if not fits or fits[0][1] > at + 1:
                fits.insert(0, (-10 - ord(text[at]), at + 1))
            for piece, k in reversed(fits):
                if k in dead:
                    continue
                ok = beside(before << 32 | piece) if piece >= 0 else None
                if self.allowed(before, piece) if ok is None else ok:
                    taken.append((piece, at))
                    at, before = k, piece
                    break
            else:
                dead.add(at)
                _, at = taken.pop()
                before = taken[-1][0] if taken else START
        out: list[int] = []
        for piece, _ in taken:
            out += [piece] if piece >= 0 else self.bytes_as_ids(piece)
        return out

    def units(self, texts: list[bytes]) -> list[bytes]:
        """unit() of many texts, as 32-bit ids in bytes."""
        return [array("i", self.unit(t.decode())).tobytes() for t in texts]

    def bytes_as_ids(self, piece: int) -> list[int]:
        """The ids of a character that no piece holds, which a state names by -10 minus its code."""
        return [self.byte_id[b] for b in chr(-10 - piece).encode()] if self.byte_id else [self.unknown]

    def run(self, count: int) -> list[int]:
        """The pieces of so many spaces, which are merged last, from the left."""
        size = max(self.spaces)
        parts = [1] * min(count, count % size + size if count >= 2 * size else count)
        full = (count - sum(parts)) // size
        while True:
            at = next((k for k in range(len(parts) - 1) if parts[k] + parts[k + 1] in self.spaces), None)
            if at is None:
                return [self.spaces[size]] * full + [self.spaces[k] for k in parts]
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    @cached_property
    def table(self) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of all pieces, and where each begins."""
        return np.frombuffer(b"".join(self.bytes_of), np.uint8), np.cumsum([0, *map(len, self.bytes_of)])


def _joined_spaces(pieces: Pieces, ids: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Stretches of lone spaces become pieces of several; offsets of rows are moved along."""
    bare = ids == pieces.bare
    pair = bare[1:] & bare[:-1]
    pair[offsets[1:-1][(offsets[1:-1] > 0) & (offsets[1:-1] < len(ids))] - 1] = False
    if not pair.any():
        return ids, offsets
    second = np.flatnonzero(pair) + 1
    first = np.flatnonzero(np.append(True, np.diff(second) > 1))
    begin, count = second[first] - 1, np.diff(np.append(first, len(second))) + 1
    keep = np.ones(len(ids), bool)
    for b, n in zip(begin.tolist(), count.tolist()):
        new = pieces.run(n)
        ids[b : b + len(new)] = new
        keep[b + len(new) : b + n] = False
    return ids[keep], np.concatenate([[0], np.cumsum(keep)])[offsets]


def encode_texts(pieces: Pieces, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts, and where each text's begin. Each distinct unit is segmented once."""
    if (data == 0xE2).any() and _MARK.encode() in (raw := data.tobytes()):
        rows = [raw[a:b].replace(_MARK.encode(), b" ") for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
        data, offsets = np.frombuffer(b"".join(rows), np.uint8), np.cumsum([0, *map(len, rows)])
    size = np.diff(offsets)
    full = np.flatnonzero(size > 0)
    if not len(full):
        return np.zeros(0, np.int32), np.zeros(len(offsets), np.int64)
    text = np.insert(data, offsets[:-1][full], 0x20)
    begins = offsets[:-1] + np.concatenate([[0], np.cumsum(size > 0)[:-1]])
    first = np.zeros(len(text), bool)
    first[1:] = ~pieces.pairs[text[:-1], text[1:]]
    first[begins[full]] = True
    start = np.flatnonzero(first)
    ids, upto = encode_units(text, start, pieces.units, pieces.known)
    rows = np.searchsorted(start, begins)
    return _joined_spaces(pieces, ids, np.append(upto[rows], upto[-1]))


def decode_ids(pieces: Pieces, ids: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of each row of ids, without the space that encoding puts first, and where they begin."""
    data, at = pieces.table
    count = at[ids + 1] - at[ids]
    out = data[ragged(at[ids], count)]
    upto = np.concatenate([[0], np.cumsum(count)])[offsets]
    keep = np.ones(len(out), bool)
    heads = upto[:-1][np.diff(upto) > 0]
    keep[heads[out[heads] == 0x20]] = False
    return out[keep], np.concatenate([[0], np.cumsum(keep)])[upto]


# giant documents -----------------------------------------------------------------------------------


def _is_cut(text: str, at: int, pieces: Pieces) -> bool:
    """Whether a unit begins at a place, so that nothing merges over it."""
    return not pieces.pairs[text[at - 1].encode()[-1], text[at].encode()[0]]


def states(pieces: Pieces, text: str, mark: int) -> list[State]:
    """What may reach a mark: (end, piece) of pieces that begin before it and end at or after it."""
    found: list[State] = []
    for at in range(mark - 1, max(-1, mark - pieces.longest - 1), -1):
        for end in range(mark, min(len(text), at + pieces.longest) + 1):
            if (piece := pieces.made.get(text[at:end])) is not None:
                found.append((end, piece))
        if at == mark - 1 and text[at] not in pieces.made:
            found.append((mark, -10 - ord(text[at])))
        if at > 0 and _is_cut(text, at, pieces):
            break
    return found


def chunks(text: str, size: int, longest: int) -> Iterator[tuple[int, int, str]]:
    """(number, characters before the chunk's mark, text) of each chunk, with the characters around it
    that its states depend on; the text has its leading space already."""
    for k, a in enumerate(range(0, len(text), size)):
        lead = min(a, longest)
        yield k, lead, text[a - lead : min(len(text), a + size + longest)]


def _bounds(text: str, lead: int, size: int, pieces: Pieces) -> tuple[int, int, int, bool]:
    """Where a chunk's own text ends in `text`, the end of the unit that it begins in, the start of the
    one it ends in, and whether a unit ends with it."""
    stop = min(len(text), lead + size)
    head = next((k for k in range(lead, stop) if k and _is_cut(text, k, pieces)), stop) if lead else lead
    closed = stop == len(text) or _is_cut(text, stop, pieces)
    tail = stop if closed else next((k for k in range(stop - 1, head - 1, -1) if k == 0 or _is_cut(text, k, pieces)), head)
    return stop, head, tail, closed


def _cut_off(text: str, begin: int, pieces: Pieces) -> str:
    """text up to where the unit at begin ends."""
    return text[: next((k for k in range(begin + 1, len(text)) if _is_cut(text, k, pieces)), len(text))]


def matrix(pieces: Pieces, text: str, lead: int, size: int) -> list[tuple[int, int, int, int]]:
    """The finite entries of a chunk's max-plus matrix, all 0: state at its mark, state at the next
    mark, each as (characters past the mark, piece); (0, START) where a unit begins at the mark."""
    stop, head, tail, closed = _bounds(text, lead, size, pieces)
    entries: list[tuple[int, int, int, int]] = []
    free = lead == 0 or _is_cut(text, lead, pieces)
    into = [(lead, START)] if free else states(pieces, _cut_off(text, lead, pieces), lead)
    through = not free and head == stop  # one unit from mark to mark
    if through:
        part = text[:stop] if closed else _cut_off(text, max(lead, stop - 1), pieces)
        seen: list[dict[int, tuple[int, int]]] = []
        for s in into:
            last = _merged(pieces, part, lead, stop, s, seen)
            seen.append(last)
            if closed:
                if stop in last:
                    entries.append((s[0] - lead, s[1], 0, START))
            else:
                entries += [(s[0] - lead, s[1], p - stop, x) for p, (x, at) in last.items() if p >= stop and 0 <= at < stop]
        return entries
    if closed:
        out: list[State] = [(0, START)]
    else:
        last = pieces.forward(_cut_off(text, max(tail, stop - 1), pieces), tail, stop, (tail, START))
        out = [(p - stop, x) for p, (x, at) in last.items() if p >= stop and 0 <= at < stop]
    for s in into:
        if free or head in pieces.forward(text[:head], lead, head, s):
            entries += [(s[0] - lead, s[1], *o) for o in out]
    return entries


def _merged(pieces: Pieces, text: str, begin: int, stop: int, state: State, seen: list[dict[int, tuple[int, int]]]) -> dict[int, tuple[int, int]]:
    """forward(), which soon goes along with an earlier state's path and is then copied from it."""
    if not seen:
        return pieces.forward(text, begin, stop, state)
    window, at = 4 * pieces.longest, state[0]
    last: dict[int, tuple[int, int]] = {state[0]: (state[1], -1)}
    while at < stop:
        upto = min(stop, at + window)
        pieces.onward(text, at, upto, last)
        for other in seen:
            if all(p in last and other.get(p) == last[p] for p in range(upto - pieces.longest + 1, upto + 1) if p in other or p in last) and upto in other:
                return {p: x for p, x in last.items() if p <= upto} | {p: x for p, x in other.items() if p > upto}
        at = upto
    return last


def combine(a: list[tuple[int, int, int, int]], b: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int]]:
    """The max-plus product of two chunks' matrices."""
    by: dict[State, set[State]] = {}
    for q, x, r, y in b:
        by.setdefault((q, x), set()).add((r, y))
    return list(dict.fromkeys((q, x, *o) for q, x, r, y in a for o in by.get((r, y), ())))


def trace(pieces: Pieces, text: str, lead: int, size: int, into: State, out: State) -> list[int]:
    """The pieces of a chunk between the states at its marks; a piece over a mark belongs to the chunk it begins in."""
    stop, head, tail, _ = _bounds(text, lead, size, pieces)
    free = lead == 0 or _is_cut(text, lead, pieces)
    begin, end = (lead + into[0], into[1]), stop + out[0]
    if not free and head == stop:
        part = text[:stop] if out[1] == START else _cut_off(text, max(lead, stop - 1), pieces)
        return [] if begin[0] >= end else pieces.back(pieces.forward(part, lead, stop, begin), end)
    ids: list[int] = []
    if not free:
        ids += pieces.back(pieces.forward(text[:head], lead, head, begin), head)
    if tail > head:
        raw = text[head:tail].encode()
        ids += _raw_units(pieces, raw)
    if tail < stop:
        ids += pieces.back(pieces.forward(_cut_off(text, max(tail, stop - 1), pieces), tail, stop, (tail, START)), end)
    return ids


def _raw_units(pieces: Pieces, raw: bytes) -> list[int]:
    """The pieces of whole units, each space by itself."""
    data = np.frombuffer(raw, np.uint8)
    first = np.append(True, ~pieces.pairs[data[:-1], data[1:]])
    return encode_units(data, np.flatnonzero(first), pieces.units, pieces.known)[0].tolist()


def down(matrices: list[list[tuple[int, int, int, int]]], into: State, out: State) -> list[State]:
    """The states at the marks of neighbours, from the one before the first to that after the last, on the
    one path of score 0 between two states."""
    reach: list[set[State]] = [{into}]
    for m in matrices:
        reach.append({(r, y) for q, x, r, y in m if (q, x) in reach[-1]})
    found: list[State] = [out]
    for m, before in zip(reversed(matrices), reversed(reach[:-1])):
        found.append(next((q, x) for q, x, r, y in m if (r, y) == found[-1] and (q, x) in before))
    return found[::-1]


_MATRIX = "array<struct<q:int,x:int,r:int,y:int>>"
_ENTRY = pa.list_(pa.struct([(k, pa.int32()) for k in "qxry"]))


def _matrices(column: pa.ChunkedArray) -> list[list[tuple[int, int, int, int]]]:
    return [[(e["q"], e["x"], e["r"], e["y"]) for e in m] for m in column.to_pylist()]


def _entries(matrices: list[list[tuple[int, int, int, int]]]) -> pa.Array:
    return pa.array([[dict(zip("qxry", e)) for e in m] for m in matrices], _ENTRY)


def _product(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """The matrix of the neighbours in a group."""
    table = table.sort_by("chunk")
    return pa.table({"row": pa.array([key[0].as_py()]), "chunk": pa.array([key[1].as_py()], pa.int32()), "matrix": _entries([reduce(combine, _matrices(table.column("matrix")))])})


def _handed_down(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """The states at both marks of each member of a group, from those of the group."""
    table = table.sort_by("chunk")
    q, x, r, y = (table.column(c)[0].as_py() for c in "qxry")
    found = down(_matrices(table.column("matrix")), (q, x), (r, y))
    rows = np.array([(*a, *b) for a, b in zip(found, found[1:])], np.int32)
    return pa.table({"row": table.column("row"), "chunk": table.column("chunk"), **{c: pa.array(rows[:, k]) for k, c in enumerate("qxry")}})


def _giants(docs: DataFrame, shared: object, size: int, schema: str) -> DataFrame:
    """encode() of texts (doc_id, text) of more than one chunk. Chunks are told apart by a row name that is
    written with them."""
    spark, kind = docs.sparkSession, docs.schema["doc_id"].dataType.simpleString()

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([uuid.uuid4().hex for _ in range(b.num_rows)], pa.string())], names=["doc_id", "text", "row"])

    rows = stored(docs.mapInArrow(name, f"doc_id {kind}, text string, row string"), "giants")

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        longest = shared.value.longest
        for b in batches:
            for k in range(b.num_rows):
                t = b.column(1)[k].as_py()
                own, marked, some = " " + t.replace(_MARK, " "), _MARK in t, []
                for part in chunks(own, size, longest):
                    some.append(part)
                    if len(some) == 16 or part[0] == (len(own) - 1) // size:
                        same = [pa.repeat(x, len(some)) for x in (b.column(2)[k], pa.scalar(marked))] + [pa.concat_arrays([b.column(0).slice(k, 1)] * len(some))]
                        yield pa.RecordBatch.from_arrays([same[0], pa.array([x[0] for x in some], pa.int32()), pa.array([x[1] for x in some], pa.int32()), pa.array([x[2] for x in some]), same[1], same[2]], names=["row", "chunk", "lead", "text", "marked", "doc_id"])
                        some = []

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text", AT_ONCE):
            made = [matrix(shared.value, t, lead, size) for t, lead in zip(b.column(3).to_pylist(), b.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([*b.columns, _entries(made)], names=[*b.schema.names, "matrix"])

    chunk = f"row string, chunk int, lead int, text string, marked boolean, doc_id {kind}"
    cut = rows.select("doc_id", "text", "row").mapInArrow(split, chunk).repartition("row", "chunk")
    cut = stored(cut.mapInArrow(lambda b: tidy(scored(b)), f"{chunk}, matrix {_MATRIX}"), "chunks")
    last = cut.agg(F.max("chunk")).first()[0]
    if last is None:
        return spark.createDataFrame([], schema)
    levels, n = [cut.select("row", "chunk", "matrix")], last + 1
    group = F.floor(F.col("chunk") / FAN_IN).cast("int")
    while n > FAN_IN:
        levels.append(stored(levels[-1].groupBy("row", group.alias("group")).applyInArrow(_product, f"row string, chunk int, matrix {_MATRIX}"), "products"))
        n = -(-n // FAN_IN)
    ends = [F.lit(k).cast("int").alias(c) for c, k in zip("qxry", (0, START, 0, START))]
    found = None
    for level in reversed(levels):
        members = level.withColumn("group", group)
        members = members.select("*", *ends) if found is None else members.join(found.withColumnRenamed("chunk", "group"), ["row", "group"])
        found = members.groupBy("row", "group").applyInArrow(_handed_down, "row string, chunk int, q int, x int, r int, y int")

    def traced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = shared.value
        data, at = pieces.table
        for b in slices(batches, "text", AT_ONCE):
            lists, same = [], []
            for t, lead, q, x, r, y in zip(*(b.column(b.schema.get_field_index(c)).to_pylist() for c in ("text", "lead", "q", "x", "r", "y"))):
                ids = np.array(trace(pieces, t, lead, size, (q, x), (r, y)), np.int32)
                lists.append(ids)
                same.append(data[ragged(at[ids], at[ids + 1] - at[ids])].tobytes() == t[lead + q : min(len(t), lead + size) + r].encode())
            upto = np.cumsum([0, *map(len, lists)])
            ids = pa.ListArray.from_arrays(pa.array(upto, pa.int32()), pa.array(np.concatenate(lists)))
            own = [b.column(b.schema.get_field_index(c)) for c in ("row", "chunk", "marked", "doc_id")]
            yield pa.RecordBatch.from_arrays([*own, ids, pa.array(same)], names=["row", "chunk", "marked", "doc_id", "ids", "same"])

    def whole(table: pa.Table) -> pa.Table:
        table = table.sort_by("chunk").combine_chunks()
        ids = table.column("ids").chunk(0).flatten().to_numpy().copy()
        ids, upto = _joined_spaces(shared.value, ids, np.array([0, len(ids)]))
        good = not table.column("marked")[0].as_py() and all(table.column("same").to_pylist())
        return pa.table([table.column("doc_id").slice(0, 1), pa.array([len(ids)], pa.int32()), pa.ListArray.from_arrays(pa.array(upto, pa.int32()), pa.array(ids, pa.int32())), pa.array([good])], names=["doc_id", "n_tokens", "ids", "round_trip"])

    parts = cut.drop("matrix").join(found, ["row", "chunk"]).mapInArrow(lambda b: tidy(traced(b)), f"row string, chunk int, marked boolean, doc_id {kind}, ids array<int>, same boolean")
    return parts.groupBy("row").applyInArrow(whole, schema)


def encode(docs: DataFrame, key: str = "doc_id", text: str = "text", model: str = MODEL_PATH, chunk_chars: int = CHUNK_CHARS) -> DataFrame:
    """(doc_id, n_tokens, ids, round_trip) of every row of docs: the ids that the model gives its text,
    and whether decoding them gives the text again (not so for one that holds U+2581, which reads as a space).

    A null text has null ids and an empty one none; null keys are carried; repeated rows are each
    encoded; other columns don't matter. Texts of more than chunk_chars characters are encoded chunk by
    chunk on all executors; there is no shuffle of others."""
    pieces = Pieces(model)
    if chunk_chars <= 2 * pieces.longest:
        raise ValueError(f"chunk_chars must exceed {2 * pieces.longest}")
    shared = docs.sparkSession.sparkContext.broadcast(pieces)  # the model's table, the same for all corpora
    kind = docs.schema[key].dataType.simpleString()
    out = f"doc_id {kind}, n_tokens int, ids array<int>, round_trip boolean"
    rows = docs.select(F.col(f"`{key}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", AT_ONCE):
            column = part.column(1)
            data, offsets = utf8(column)
            ids, upto = encode_texts(shared.value, data, offsets)
            again, where = decode_ids(shared.value, ids, upto)
            same = _same(data, offsets, again, where)
            null = np.array(column.is_null())
            count = pa.array(np.diff(upto), pa.int32(), mask=null)
            lists = pa.ListArray.from_arrays(pa.array(upto, pa.int32()), pa.array(ids, pa.int32()), mask=pa.array(null))
            yield pa.RecordBatch.from_arrays([part.column(0), count, lists, pa.array(same, mask=null)], names=["doc_id", "n_tokens", "ids", "round_trip"])

    large = F.length("text") > chunk_chars
    small = rows.where(~large | F.col("text").isNull()).mapInArrow(lambda b: tidy(run(b)), out)
    return small.unionByName(_giants(rows.where(large), shared, chunk_chars, out))


def _same(data: np.ndarray, offsets: np.ndarray, other: np.ndarray, where: np.ndarray) -> np.ndarray:
    """Which rows hold the same bytes."""
    size = np.diff(offsets)
    same = size == np.diff(where)
    if same.all() and len(data) == len(other):
        wrong = np.flatnonzero(data != other)
        same[np.searchsorted(offsets, wrong, "right") - 1] = False
        return same
    for k in np.flatnonzero(same):
        same[k] = np.array_equal(data[offsets[k] : offsets[k + 1]], other[where[k] : where[k + 1]])
    return same


def decoded(df: DataFrame, shared: object, ids: str) -> F.Column:
    """The text of a column of ids; bytes that form no character become U+FFFD; null ids and those that
    the model doesn't have, like its control ids, give nothing."""

    @F.arrow_udf("string")
    def text_of(lists: pa.Array) -> pa.Array:
        flat = lists.flatten().fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        flat[(flat < 0) | (flat >= len(shared.value.bytes_of))] = shared.value.unknown
        count = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        data, where = decode_ids(shared.value, flat, np.concatenate([[0], np.cumsum(count)]).astype(np.int64))
        raw, null = data.tobytes(), np.array(lists.is_null())
        return pa.array([None if n else raw[a:b].decode("utf-8", "replace") for n, a, b in zip(null, where[:-1].tolist(), where[1:].tolist())], pa.string())

    return text_of(F.col(f"`{ids}`"))


def decode(df: DataFrame, ids: str = "ids", model: str = MODEL_PATH) -> DataFrame:
    """df with the text of its column of ids; a null list gives null, an empty one an empty text, ids that
    the model doesn't have nothing. Repeated rows are each decoded. The new column is `text`, with trailing underscores if df has that name."""
    shared = df.sparkSession.sparkContext.broadcast(Pieces(model))
    return df.withColumn(free_name(df, "text"), decoded(df, shared, ids))
