"""Near duplicates by SimHash: a self-join of binary tries over 128-bit fingerprints.

Fingerprints within MAX_BITS of each other are joined. The bits are cut into
blocks, of which at least one differs in at most its budget in such a pair,
since budgets plus blocks exceed MAX_BITS. Each block has a binary trie that is
joined with itself: pairs of nodes go down together, add up differing bits, and
are dropped as soon as the block's budget is exceeded. A joined pair is held
against the whole fingerprint. Every fingerprint takes part: there is no cap on
partners, and a group of equal fingerprints is one leaf.

The top of each trie is traversed on the plan: every subtree is stored once, and
a task reads the two subtrees of a pair of nodes. The number of blocks only
shares out work (few long ones for many fingerprints): any number finds the same pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from math import comb

import numpy as np
import pyarrow as pa
import pyarrow.dataset as ds
from pyarrow.fs import FileSelector, FileSystem
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leafmill.llm.common import SLICE_BYTES, Words, discard, folders, forget, free_name, local_uri, mix, ragged, shared_folder, stored, tidy, trim, utf8

#: Differing bits, of 128, up to which two documents are near duplicates.
MAX_BITS = 18
#: Blocks among which plan() chooses.
BLOCKS = (4, 5, 6, 7, 8)
#: Words of this many bytes or more weigh LONG_WEIGHT, shorter ones 1: short words are mostly common.
LONG_BYTES, LONG_WEIGHT = 4, 4
#: Fingerprints of a subtree that a task holds (it holds two); a larger one is cut into parts, which are joined by pairs.
TASK_LEAVES = 1 << 18
#: Subtrees of a block at least, so that small inputs give work to all cores; bits of a block by which subtrees are told apart at most.
LEAST_SUBTREES, MOST_BITS = 8, 14
#: Pairs of nodes or of fingerprints that are worked on at once.
PAIRS_AT_ONCE = 1 << 18
#: Rows to drop up to which they are broadcast (24 bytes each); beyond it the join shuffles.
BROADCAST_ROWS = 500_000

_SALTS = np.array([0x243F6A8885A308D3, 0x13198A2E03707344], np.uint64)


#: The bits of each byte, highest first, in eight lanes of a byte.
_LANES = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).view("<u8").ravel()
#: Words whose weights a lane can hold.
_IN_LANE = 255 // LONG_WEIGHT


def fingerprints(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(texts, 16) bytes of fingerprint over each text's distinct words, and whether it has any words."""
    n = len(offsets) - 1
    w = Words(data, offsets)
    out = np.zeros((n, 16), np.uint8)
    if not len(w):
        return out, np.zeros(n, bool)
    salted = mix(w.hash + w.text.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    _, one = np.unique(salted, return_index=True)
    one.sort()
    text, hashes, long = w.text[one], w.hash[one], (w.end - w.start)[one] >= LONG_BYTES
    there, first = np.unique(text, return_index=True)
    # sums of at most _IN_LANE words in lanes of a byte, and of those per text
    size = np.diff(np.append(first, len(text)))
    parts = -(-size // _IN_LANE)
    starts = np.repeat(first, parts) + _IN_LANE * (np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts))
    sums = np.zeros((len(starts), 128), np.uint8)
    at = 0
    while at < len(starts):
        to = min(len(starts), at + 512)
        rows = slice(starts[at], starts[to] if to < len(starts) else len(text))
        two = np.stack([mix(hashes[rows] ^ s) for s in _SALTS], 1).astype(">u8").view(np.uint8).reshape(-1, 16)
        lanes = _LANES[two] * np.where(long[rows], LONG_WEIGHT, 1).astype(np.uint64)[:, None]
        sums[at:to] = np.add.reduceat(lanes, starts[at:to] - starts[at], axis=0).view(np.uint8).reshape(-1, 128)
        at = to
    total = np.add.reduceat(sums, np.cumsum(parts) - parts, axis=0, dtype=np.int64)
    weight = np.add.reduceat(np.where(long, LONG_WEIGHT, 1), first, dtype=np.int64)
    out[there] = np.packbits(2 * total > weight[:, None], axis=1)
    return out, w.count > 0


def _fingerprint_column(texts: pa.Array) -> pa.Array:
    data, offsets = utf8(texts)
    parts, at = [], 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + SLICE_BYTES, "right")) - 1)
        prints, there = fingerprints(data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at])
        parts += [p.tobytes() if t else None for p, t in zip(prints, there)]
        at = to
    return pa.array(parts, pa.binary())


def fingerprint(text: Column | str) -> Column:
    """The 16-byte SimHash of a text; null for a null text and for one without words. Equal texts have
    equal ones, whatever the partitions."""

    @F.arrow_udf("binary")
    def simhash(texts: pa.Array) -> pa.Array:
        found = _fingerprint_column(texts)
        trim()
        return found

    return simhash(text)


_NONE = np.iinfo(np.int32).min


class _Trie:
    """A binary trie over distinct sorted values of so many bits; kids[d] has, for each node of depth d with
    several values, its two children: a node of depth d + 1, the only value below it as -1 - index, or _NONE."""

    def __init__(self, values: np.ndarray, bits: int) -> None:
        self.values, self.bits, self.kids = values.astype(np.uint32), bits, []
        lo, hi = np.array([0]), np.array([len(values)])
        self.root = 0 if len(values) > 1 else -1 if len(values) else _NONE
        for d in range(bits):
            lo, hi = (lo, hi) if d else (lo[hi - lo > 1], hi[hi - lo > 1])
            if not len(lo):
                break
            ones = np.concatenate([[0], np.cumsum((self.values >> np.uint32(bits - 1 - d)) & np.uint32(1), dtype=np.int64)])
            mid = hi - (ones[hi] - ones[lo])
            begin, end = np.stack([lo, mid], 1), np.stack([mid, hi], 1)
            size = end - begin
            inner = size > 1
            kids = np.where(size == 1, -1 - begin, _NONE)
            kids[inner] = np.arange(int(inner.sum()))
            self.kids.append(kids.astype(np.int32))
            lo, hi = begin[inner], end[inner]

    def child(self, d: int, u: np.ndarray, x: int) -> np.ndarray:
        """The x-side child of each node u of depth d; a value goes down on its own side."""
        out = np.full(len(u), _NONE, np.int32)
        inner = u >= 0
        if d < len(self.kids):
            out[inner] = self.kids[d][u[inner], x]
        leaf = u[~inner]
        same = (self.values[-1 - leaf] >> np.uint32(self.bits - 1 - d)) & np.uint32(1) == x
        out[~inner] = np.where(same, leaf, _NONE)
        return out


def trie_join(a: np.ndarray, b: np.ndarray | None, budget: int, bits: int = 32) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of the distinct sorted values a and b of so many bits (b None: a with itself, each pair
    once and each value with itself) that differ in at most `budget` bits."""
    left, own = _Trie(a, bits), b is None
    right, b = (left, a) if own else (_Trie(b, bits), b)
    if left.root == _NONE or right.root == _NONE:
        return
    stack = [(0, np.full(1, left.root, np.int32), np.full(1, right.root, np.int32), np.zeros(1, np.int8))]
    while stack:
        d, u, v, err = stack.pop()
        if len(u) > PAIRS_AT_ONCE:
            half = len(u) // 2
            stack += [(d, u[half:], v[half:], err[half:]), (d, u[:half], v[:half], err[:half])]
            continue
        leaf = (u < 0) & (v < 0)
        if leaf.any():
            i, j = (-1 - u[leaf]).astype(np.int64), (-1 - v[leaf]).astype(np.int64)
            near = np.bitwise_count(a[i] ^ b[j]) <= budget
            if near.any():
                yield i[near], j[near]
            u, v, err = u[~leaf], v[~leaf], err[~leaf]
        if not len(u):
            continue
        ku, kv = [left.child(d, u, x) for x in (0, 1)], [right.child(d, v, x) for x in (0, 1)]
        us, vs, es = [], [], []
        for x in (0, 1):
            for y in (0, 1):
                ok = (ku[x] != _NONE) & (kv[y] != _NONE)
                if x != y:
                    ok &= err < budget
                if own and (x, y) == (1, 0):
                    ok &= u != v  # the mirror image of (0, 1)
                us.append(ku[x][ok])
                vs.append(kv[y][ok])
                es.append(err[ok] + np.int8(x != y))
        stack.append((d + 1, np.concatenate(us), np.concatenate(vs), np.concatenate(es)))


@lru_cache
def widths_and_budgets(blocks: int) -> tuple[tuple[int, int], ...]:
    """(bits, budget) of each block: budgets add up to MAX_BITS + 1 - blocks, the wider blocks have the greater ones."""
    left = MAX_BITS + 1 - blocks
    return tuple((128 // blocks + (k < 128 % blocks), left // blocks + (k < left % blocks)) for k in range(blocks))


def plan(count: int) -> int:
    """The number of blocks that costs least for so many fingerprints, if they are random: pairs of nodes
    of the tries, and pairs of fingerprints that a block lets through (a fourth as dear)."""

    def cost(blocks: int) -> float:
        depth, total = np.log2(max(count, 2)), 0.0
        for bits, budget in widths_and_budgets(blocks):
            at = int(min(np.ceil(depth), bits))
            total += count * sum(comb(at, k) for k in range(budget + 1)) / 2 + count**2 * sum(comb(bits, k) for k in range(budget + 1)) / 2**bits / 8
        return total

    return min((b for b in BLOCKS if max(w for w, _ in widths_and_budgets(b)) <= 32), key=cost)


def _halves(raw: list[bytes]) -> np.ndarray:
    """(n, 2) 64-bit halves of fingerprints."""
    return np.frombuffer(b"".join(raw), ">u8").reshape(-1, 2).astype(np.uint64)


def block_of(prints: np.ndarray, blocks: int, block: int) -> np.ndarray:
    """The bits of a block of each fingerprint (n, 2), as numbers."""
    sizes = [w for w, _ in widths_and_budgets(blocks)]
    begin, size = sum(sizes[:block]), sizes[block]
    end, high, low = begin + size, prints[:, 0], prints[:, 1]
    if end <= 64:
        x = high >> np.uint64(64 - end)
    elif begin >= 64:
        x = low >> np.uint64(128 - end)
    else:
        x = (high << np.uint64(end - 64)) | (low >> np.uint64(128 - end))
    return (x & np.uint64((1 << size) - 1)).astype(np.uint32)


def near_pairs(prints: np.ndarray, blocks: int, block: int, left: np.ndarray, right: np.ndarray | None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows of prints (n, 2), of left with right or of left with itself, within MAX_BITS,
    that this block finds first: no earlier block is within its budget. At most PAIRS_AT_ONCE are looked at at a time."""
    (bits, budget), value = widths_and_budgets(blocks)[block], block_of(prints, blocks, block)
    earlier = [(block_of(prints, blocks, k), widths_and_budgets(blocks)[k][1]) for k in range(block)]

    def grouped(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        values, group = np.unique(value[rows], return_inverse=True)
        count = np.bincount(group, minlength=len(values))
        return values, rows[np.argsort(group, kind="stable")], count, np.cumsum(count) - count

    va, oa, ca, sa = grouped(left)
    vb, ob, cb, sb = (None, oa, ca, sa) if right is None else grouped(right)
    for i, j in trie_join(va, vb, budget, bits):
        upto = np.cumsum(ca[i] * cb[j])
        for begin in range(0, int(upto[-1]), PAIRS_AT_ONCE):
            flat = np.arange(begin, min(begin + PAIRS_AT_ONCE, int(upto[-1])))
            k = np.searchsorted(upto, flat, "right")
            within = flat - (upto[k] - (ca[i] * cb[j])[k])
            x, y = oa[sa[i[k]] + within // cb[j[k]]], ob[sb[j[k]] + within % cb[j[k]]]
            ok = np.bitwise_count(prints[x, 0] ^ prints[y, 0]) + np.bitwise_count(prints[x, 1] ^ prints[y, 1]) <= MAX_BITS
            if right is None:  # of two different values both orders don't come up; of one value they do
                ok &= (i[k] != j[k]) | (x < y)
            x, y = x[ok], y[ok]
            for other, most in earlier:
                ok = np.bitwise_count(other[x] ^ other[y]) > most
                x, y = x[ok], y[ok]
            if len(x):
                yield x, y


class _Forest:
    """Which of n rows are joined so far; of pairs, those that join two trees are kept."""

    def __init__(self, n: int) -> None:
        self.root = np.arange(n)

    def add(self, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        new = self.root[x] != self.root[y]
        x, y = x[new], y[new]
        _, one = np.unique(np.minimum(self.root[x], self.root[y]) * len(self.root) + np.maximum(self.root[x], self.root[y]), return_index=True)
        x, y = x[one], y[one]
        parent: dict[int, int] = {}
        keep = np.zeros(len(x), bool)
        for k, (r, s) in enumerate(zip(self.root[x].tolist(), self.root[y].tolist())):
            while r in parent:
                r = parent[r]
            while s in parent:
                s = parent[s]
            if r != s:
                parent[max(r, s)] = min(r, s)
                keep[k] = True
        if parent:
            to = np.arange(len(self.root))
            to[list(parent)] = list(parent.values())
            while (to[to] != to).any():
                to = to[to]
            self.root = to[self.root]
        return x[keep], y[keep]


def _subtrees(counts: list[tuple[int, int, int]], blocks: int, top: int, most: int) -> list[np.ndarray]:
    """For each block, rows (prefix, depth, fingerprints) of the nodes in which its trie is cut: those of at
    most `most` fingerprints whose parent has more, and those of depth `top`."""
    out = []
    for block in range(blocks):
        leaves = np.zeros(1 << top, np.int64)
        for b, p, n in counts:
            if b == block:
                leaves[p] = n
        upto = np.concatenate([[0], np.cumsum(leaves)])
        nodes, stack = [], [(0, 0)]
        while stack:
            prefix, d = stack.pop()
            n = int(upto[(prefix + 1) << (top - d)] - upto[prefix << (top - d)])
            if not n:
                continue
            if n <= most or d == top:
                nodes.append((prefix, d, n))
            else:
                stack += [(2 * prefix + 1, d + 1), (2 * prefix, d + 1)]
        out.append(np.array(sorted(nodes, key=lambda x: x[0] << (top - x[1])), np.int64).reshape(-1, 3))
    return out


def _partners(nodes: np.ndarray, k: int, budget: int) -> np.ndarray:
    """The nodes from the k-th on that differ from it in at most `budget` of the bits that both have."""
    prefix, depth = nodes[k:, 0], nodes[k:, 1]
    d = np.minimum(depth, depth[0])
    return k + np.flatnonzero(np.bitwise_count(((prefix[0] >> (depth[0] - d)) ^ (prefix >> (depth - d))).astype(np.uint64)) <= budget)


def _read(folder: str, block: int, node: int, part: int) -> list[bytes]:
    fs, where = FileSystem.from_uri(local_uri(f"{folder}/block={block}/node={node}/part={part}"))
    if fs.get_file_info(where).type == 0:
        return []
    return ds.dataset(where, filesystem=fs, format="parquet").to_table(columns=["fp"]).column("fp").to_pylist()


def _join_unit(folder: str, blocks: int, unit: dict[str, int], all_pairs: bool) -> Iterator[pa.RecordBatch]:
    """The pairs of one unit of work: two parts of subtrees of a block, or one with itself."""
    raw = _read(folder, unit["block"], unit["node"], unit["part"])
    own, n = (unit["node"], unit["part"]) == (unit["other"], unit["other_part"]), len(raw)
    if not own:
        raw += _read(folder, unit["block"], unit["other"], unit["other_part"])
    if not n or not own and len(raw) == n:
        return
    prints, forest = _halves(raw), _Forest(len(raw))
    for x, y in near_pairs(prints, blocks, unit["block"], np.arange(n), None if own else np.arange(n, len(raw))):
        x, y = (x, y) if all_pairs else forest.add(x, y)
        a, b = [raw[k] for k in x.tolist()], [raw[k] for k in y.tolist()]
        if a:
            yield pa.RecordBatch.from_arrays([pa.array(map(min, a, b), pa.binary()), pa.array(map(max, a, b), pa.binary())], names=["a", "b"])


def near_fingerprints(leaves: DataFrame, count: int, all_pairs: bool = False, task_leaves: int = TASK_LEAVES, blocks: int | None = None, made: list[str] | None = None) -> DataFrame:
    """Pairs (a, b), a < b, of the distinct fingerprints in leaves.fp that are within MAX_BITS; by
    default only those of a spanning forest of each unit of work, which leave the same groups. The
    forest makes the result of a group of any size no larger than the group. Null fingerprints don't
    take part; no leaves give no pairs.

    Every leaf is written once for each block, below the subtree that it is in; the driver gets the
    subtrees' sizes, at most 2**MOST_BITS of a block. A unit reads two subtrees, or parts of them. made, if given, gets
    the folder that the result is read from."""
    spark = leaves.sparkSession
    leaves = leaves.select("fp").where("fp is not null")
    blocks = blocks or plan(count)
    most = max(1, min(task_leaves, -(-count // LEAST_SUBTREES)))
    top = min(MOST_BITS, max(1, int(np.ceil(np.log2(max(count, 2) / most))) + 3))
    sizes = [w for w, _ in widths_and_budgets(blocks)]

    def prefixes(prints: np.ndarray, block: int) -> np.ndarray:
        return (block_of(prints, blocks, block) >> np.uint32(sizes[block] - top)).astype(np.int64)

    def count_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((blocks, 1 << top), np.int64)
        for batch in batches:
            prints = _halves(batch.column(0).to_pylist())
            for k in range(blocks):
                total[k] += np.bincount(prefixes(prints, k), minlength=1 << top)
        block, prefix = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(block, pa.int32()), pa.array(prefix, pa.int32()), pa.array(total[block, prefix])], names=["block", "prefix", "n"])

    counts = leaves.mapInArrow(count_of, "block int, prefix int, n bigint").groupBy("block", "prefix").agg(F.sum("n").alias("n")).collect()
    nodes = _subtrees([tuple(r) for r in counts], blocks, top, most)
    parts_of = [-(-x[:, 2] // task_leaves) for x in nodes]
    node_of = [_spread(x, top) for x in nodes]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = _halves(batch.column(0).to_pylist())
            for k in range(blocks):
                node = node_of[k][prefixes(prints, k)]
                part = (mix(prints[:, 0] + prints[:, 1] * np.uint64(3)) % parts_of[k][node].astype(np.uint64)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.full(len(node), k), pa.int32()), pa.array(node, pa.int32()), pa.array(part, pa.int32())], names=["fp", "block", "node", "part"])

    folder = f"{shared_folder(spark)}/subtrees"
    if made is not None:
        made.append(folder.rpartition("/")[0])
    placed = leaves.mapInArrow(place, "fp binary, block int, node int, part int")
    placed.repartition("block", "node", "part").write.partitionBy("block", "node", "part").parquet(folder)

    def units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number in batch.column(0).to_pylist():
                block = int(np.searchsorted(starts, number, "right")) - 1
                node = number - starts[block]
                rows = []
                for other in _partners(nodes[block], node, widths_and_budgets(blocks)[block][1]).tolist():
                    for p in range(int(parts_of[block][node])):
                        rows += [(block, node, p, other, q) for q in range(p if other == node else 0, int(parts_of[block][other]))]
                columns = np.array(rows, np.int32).reshape(-1, 5).T
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["block", "node", "part", "other", "other_part"])

    starts = np.concatenate([[0], np.cumsum([len(x) for x in nodes])]).tolist()
    todo = spark.range(0, starts[-1], 1, max(1, min(starts[-1], 64))).mapInArrow(units, "block int, node int, part int, other int, other_part int")
    todo = stored(todo, "units")
    tasks = max(1, min(todo.count(), max(8 * spark.sparkContext.defaultParallelism, count // 20_000)))

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for unit in batch.to_pylist():
                yield from _join_unit(folder, blocks, unit, all_pairs)

    # a key of random numbers spreads units evenly; repartition(n) alone deals rows out per input task
    return todo.repartition(tasks, F.xxhash64("block", "node", "part", "other", "other_part")).mapInArrow(lambda b: tidy(join(b)), "a binary, b binary").distinct()


def _spread(nodes: np.ndarray, top: int) -> np.ndarray:
    """The node of each prefix of `top` bits; prefixes without fingerprints have none, given as 0."""
    out = np.zeros(1 << top, np.int64)
    for k, (prefix, depth, _) in enumerate(nodes.tolist()):
        out[prefix << (top - depth) : (prefix + 1) << (top - depth)] = k
    return out


def components(edges: DataFrame, made: list[str] | None = None) -> DataFrame:
    """(node, root) of every node in edges (a, b): root is the least node that it is connected with.
    Alternating stars; each round is written to the shared folder, and the one before it deleted. Edges
    with a null end or from a node to itself, and repeated ones, don't count; no edges give no rows."""
    edges = stored(edges.select("a", "b").where("a <> b").distinct(), "edges")
    for folder in made or ():  # what the edges came from
        discard(edges.sparkSession, folder)
    before = None
    while True:
        both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        old, edges = edges, both.where("b > a").join(least, "a").select(F.col("m").alias("a"), "b").where("a <> b").distinct()
        large = edges = stored(edges, "large")
        forget(old)
        least = edges.groupBy("b").agg(F.min("a").alias("m"))
        small = edges.join(least, "b")
        edges = small.select(F.col("m").alias("a"), "b").unionAll(small.select(F.col("m").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct()
        old, edges = large, stored(edges, "small")
        forget(old)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            return edges.select(F.col("b").alias("node"), F.col("a").alias("root"))
        before = now


def _row_hash(docs: DataFrame) -> Column:
    """128 bits of hash of a whole row; rows are told apart by it, since keys may be null or repeated. Which
    values are null counts, also inside arrays and structs, which hashes alone skip."""
    nulls = F.concat_ws("", *[F.col(f"`{c}`").isNull().cast("int") for c in docs.columns])
    parts: list[Column] = [nulls]
    for f in docs.schema:
        column, kind = F.col(f"`{f.name}`"), f.dataType.simpleString()
        nested = "<" in kind or kind == "variant"
        parts += [F.xxhash64(column)] * ("map<" not in kind and kind != "variant") + [column.cast("string")] * nested
    return F.struct(F.xxhash64(*parts).alias("a"), F.xxhash64(F.lit("second"), *parts).alias("b"))


def groups(docs: DataFrame, key: str = "doc_id", text: str = "text", temporary: list[str] | None = None) -> DataFrame:
    """(doc_id, row, root, kept_id, kept_row, group_size) for every row of docs that has near or
    exact duplicates: root names the group, kept is its first row by key (null keys last), row is a
    hash of the whole row. Groups are connected components of pairs within MAX_BITS. Rows of equal
    content count one by one in group_size. Texts without words (null, empty, only signs) are in no group.
    temporary, if given, gets the folders that the result is read from."""
    schema = T.StructType([T.StructField("doc_id", docs.schema[key].dataType), T.StructField("row", T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])), T.StructField("fp", T.BinaryType())])
    rows = docs.select(F.col(f"`{key}`").alias("doc_id"), _row_hash(docs).alias("row"), fingerprint(F.col(f"`{text}`")).alias("fp"))
    every = stored(docs.sparkSession.createDataFrame([], schema).unionAll(rows), "prints")
    rows = every.where("fp is not null")
    leaves = stored(rows.select("fp").distinct(), "leaves")
    made: list[str] = []
    labels = components(near_fingerprints(leaves, leaves.count(), made=made), made)
    forget(leaves)
    if temporary is not None:
        temporary += folders(every, labels)
    member = rows.join(labels, rows.fp == labels.node, "left").select("doc_id", "row", F.coalesce("root", "fp").alias("root"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("last"), F.col("doc_id"), F.col("row"))).alias("kept")
    heads = member.groupBy("root").agg(F.count("*").alias("group_size"), first).where("group_size > 1")
    return member.join(heads, "root").select("doc_id", "row", "root", F.col("kept.doc_id").alias("kept_id"), F.col("kept.row").alias("kept_row"), "group_size")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, kept_id, group_size) for every row of a group of near duplicates, the kept row too.
    See groups() for nulls, ties and empty texts; extra columns don't matter."""
    return groups(docs, key, text).select("doc_id", "kept_id", "group_size")


def drop_near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs without near duplicates, and the first row (by key, null keys last) of each
    group; of repeated rows one stays. Texts without words all stay. Columns are those of docs."""
    temporary: list[str] = []
    found = stored(groups(docs, key, text, temporary), "groups")
    for folder in temporary:
        discard(docs.sparkSession, folder)
    gone = found.where("row <> kept_row").select("row").distinct()
    twice = found.where("row = kept_row").groupBy("row").count().where("count > 1").select("row")
    name = free_name(docs, "row")
    out = docs.withColumn(name, _row_hash(docs))

    def table(rows: DataFrame) -> DataFrame:
        rows = rows.select(F.col("row").alias(name))
        return F.broadcast(rows) if rows.count() <= BROADCAST_ROWS else rows

    out = out.join(table(gone), name, "left_anti")
    if not twice.isEmpty():
        repeated = table(twice)
        out = out.join(repeated, name, "left_anti").unionByName(out.join(repeated, name, "left_semi").dropDuplicates([name]))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])
