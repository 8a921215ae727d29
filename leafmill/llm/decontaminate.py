"""Benchmark decontamination with suffix arrays of the training text.

The training text is cut into shards; the suffixes of a shard's words are
sorted as far as the longest test item is long, and every suffix of every test
item is binary-searched in every shard. All its occurrences of the least length
are then followed to their own full length, so a document is found by what it
shares itself, not only where it has the longest match of all.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.dataset as ds
from pyarrow.fs import FileSystem
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.llm.common import Words, local_uri, ragged, shared_folder, slices, suffix_array, tidy, trim, utf8

#: Words of a match that count as contamination; all words of a shorter item.
MIN_WORDS = 13
#: A match of a test item with fewer words can't be told from chance: it is reported as short and removes nothing.
LEAST_ITEM_WORDS = 6
#: Bytes of training text in a shard (or one longer text); bytes of test text that a task holds at once.
SHARD_BYTES = 1 << 20
TEST_BYTES = 4 << 20
#: Occurrences of test suffixes that are followed at once.
AT_ONCE = 1 << 18

_SCHEMA = "item_word bigint, doc_word bigint, n_words bigint, start_byte bigint, end_byte bigint, short boolean"
_pieces: dict[str, list[_Tests]] = {}


class _Tests:
    """Word hashes of some test items, and each suffix that is long enough to count."""

    def __init__(self, ids: pa.Array, texts: pa.Array, least: int, least_item: int, short: int) -> None:
        self.ids = ids
        w = Words(*utf8(texts))
        self.hash, self.item, self.begin = w.hash, w.text, w.first[:-1]
        self.end = np.repeat(w.first[1:], w.count)
        self.need = np.repeat(np.minimum(least, w.count), w.count)
        self.longest = int(w.count.max(initial=0))
        at = np.arange(len(w))
        ok = (self.end - at >= self.need) & (np.repeat(w.count, w.count) >= least_item)
        self.short = w.count < short
        self.suffixes = at[ok]


def _tests(path: str, least: int, least_item: int, short: int = 0) -> Iterator[_Tests]:
    """The test items of a folder with at least least_item words, in pieces; a single piece stays in the
    worker's memory (each folder is read with the same numbers)."""
    if path in _pieces:
        yield from _pieces[path]
        return
    fs, where = FileSystem.from_uri(local_uri(path))
    made = []
    for part in slices(ds.dataset(where, filesystem=fs, format="parquet").to_batches(batch_size=10_000), "text", TEST_BYTES):
        piece = _Tests(part.column(0), part.column(1), least, least_item, short)
        made = [*made, piece][:2]
        yield piece
    if len(made) < 2:
        _pieces.clear()
        _pieces[path] = made


def _bounds(symbols: np.ndarray, order: np.ndarray, depth: int, want: np.ndarray, lo: np.ndarray, hi: np.ndarray, right: bool) -> np.ndarray:
    """For each search, where in order[lo:hi] suffixes whose symbol at `depth` is `want` begin or end."""
    n, lo, hi = len(symbols), lo.copy(), hi.copy()
    while True:
        live = lo < hi
        if not live.any():
            return lo
        mid = (lo + hi) >> 1
        at = order[np.minimum(mid, n - 1)] + depth
        have = symbols[np.minimum(at, n - 1)]
        below = (at >= n) | ((have <= want) if right else (have < want))
        lo = np.where(live & below, mid + 1, lo)
        hi = np.where(live & ~below, mid, hi)


def _intervals(symbols: np.ndarray, order: np.ndarray, tests: _Tests) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Test suffixes of which the least length occurs in a shard, and where in suffix order its occurrences lie."""
    n, s = len(symbols), tests.suffixes
    none = (np.zeros(0, np.int64),) * 3
    if not n or not len(s):
        return none
    heads = symbols[order]
    lo, hi = np.searchsorted(heads, tests.hash[s], "left"), np.searchsorted(heads, tests.hash[s], "right")
    need, depth = tests.need[s], 1
    done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    while True:
        ok = hi > lo
        full = ok & (need <= depth)
        if full.any():
            done.append((s[full], lo[full], hi[full]))
        ok &= ~full
        s, lo, hi, need = s[ok], lo[ok], hi[ok], need[ok]
        if not len(s):
            break
        want = tests.hash[s + depth]
        lo, hi = _bounds(symbols, order, depth, want, lo, hi, False), _bounds(symbols, order, depth, want, lo, hi, True)
        depth += 1
    return tuple(np.concatenate(x) for x in zip(*done)) if done else none


def find(symbols: np.ndarray, order: np.ndarray, doc_end: np.ndarray, tests: _Tests, at_once: int = AT_ONCE) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Left-maximal matches of test suffixes in a shard: test word, training word and length, in blocks
    of at most at_once. doc_end has the end of each training word's document."""
    s, lo, hi = _intervals(symbols, order, tests)
    upto = np.cumsum(hi - lo)
    for begin in range(0, int(upto[-1]) if len(upto) else 0, at_once):
        flat = np.arange(begin, min(begin + at_once, int(upto[-1])))
        of = np.searchsorted(upto, flat, "right")
        at = order[hi[of] - (upto[of] - flat)].astype(np.int64)
        test = s[of]
        length = tests.need[test].astype(np.int64)
        room = np.minimum(doc_end[at] - at, tests.end[test] - test)
        ok = room >= length
        before = (test > tests.begin[tests.item[test]]) & (at > 0)
        same = before & (symbols[np.maximum(at - 1, 0)] == tests.hash[np.maximum(test - 1, 0)]) & (doc_end[np.maximum(at - 1, 0)] == doc_end[at])
        ok &= ~same  # else the suffix one word earlier has it
        at, test, length, room = at[ok], test[ok], length[ok], room[ok]
        live = np.arange(len(at))
        while len(live):
            live = live[length[live] < room[live]]
            live = live[symbols[at[live] + length[live]] == tests.hash[test[live] + length[live]]]
            length[live] += 1
        if len(at):
            yield test, at, length


def affected(symbols: np.ndarray, order: np.ndarray, doc_end: np.ndarray, tests: _Tests) -> np.ndarray:
    """Training words at which a match begins. Suffixes with one place in suffix order are followed once,
    so a passage of many items that occurs often costs no more than the shard's words."""
    s, lo, hi = _intervals(symbols, order, tests)
    if not len(s):
        return np.zeros(0, np.int64)
    need = tests.need[s]
    _, one = np.unique(np.stack([lo, hi, need], 1), axis=0, return_index=True)
    out = []
    for k in np.unique(need[one]).tolist():
        some = one[need[one] == k]
        at = order[ragged(lo[some], (hi - lo)[some])].astype(np.int64)
        out.append(at[doc_end[at] - at >= k])
    return np.unique(np.concatenate(out))


def _shard(column: pa.Array) -> tuple[Words, np.ndarray]:
    w = Words(*utf8(column))
    return w, np.repeat(w.first[1:], w.count)


def _matches(batches: Iterator[pa.RecordBatch], path: str, least: int, short: int) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "item_id", *(c.split()[0] for c in _SCHEMA.split(", "))]
    for part in slices(batches, "text", SHARD_BYTES):
        w, doc_end = _shard(part.column(1))
        _, offsets = utf8(part.column(1))
        order = None
        for tests in _tests(path, least, 1, short):
            if order is None or tests.longest > sorted_to:
                sorted_to = tests.longest
                order, _ = suffix_array(w.hash, sorted_to, False)
            for test, at, length in find(w.hash, order, doc_end, tests):
                doc, item = w.text[at], tests.item[test]
                columns = [part.column(0).take(pa.array(doc)), tests.ids.take(pa.array(item))]
                numbers = [test - tests.begin[item], at - w.first[doc], length, w.start[at] - offsets[doc], w.end[at + length - 1] - offsets[doc]]
                yield pa.RecordBatch.from_arrays([*columns, *(pa.array(x, pa.int64()) for x in numbers), pa.array(tests.short[item])], names=names)


def _store_tests(benchmark: DataFrame, item: str, text: str) -> str:
    path = f"{shared_folder(benchmark.sparkSession)}/tests"
    benchmark.select(F.col(f"`{item}`").alias("item_id"), F.col(f"`{text}`").alias("text")).write.parquet(path)
    return path


def matches(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", min_words: int = MIN_WORDS, least_item_words: int = LEAST_ITEM_WORDS) -> DataFrame:
    """Every maximal verbatim match, of at least min_words words or a whole shorter item, between a
    document and a test item: doc_id, item_id, item_word and doc_word (its first word in either),
    n_words, start_byte and end_byte in the document's UTF-8, and short, which is true for an item under
    least_item_words words. Case of ASCII letters and signs between words don't count.

    Null and empty texts match nothing; null ids are carried; repeated rows are each reported; without test
    items or documents there are no rows; other columns don't matter, whatever their names. The test items lie
    in the shared folder, from which tasks read them in pieces of a bounded size; there is no shuffle of the
    training text."""
    path = _store_tests(benchmark, item, item_text)
    kinds = f"doc_id {docs.schema[key].dataType.simpleString()}, item_id {benchmark.schema[item].dataType.simpleString()}, {_SCHEMA}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return tidy(_matches(batches, path, min_words, least_item_words))

    return docs.select(F.col(f"`{key}`").alias("doc_id"), F.col(f"`{text}`").alias("text")).mapInArrow(run, kinds)


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", min_words: int = MIN_WORDS, least_item_words: int = LEAST_ITEM_WORDS) -> DataFrame:
    """The rows of docs without any match that matches() reports and that isn't short. Columns are those of docs; rows are
    judged one by one, so null or repeated keys don't matter. Null and empty texts stay; without test items all rows do."""
    path = _store_tests(benchmark, item, item_text)

    @F.arrow_udf("boolean")
    def hit(texts: pa.Array) -> pa.Array:
        flags, at = np.zeros(len(texts), bool), 0
        for part in slices(iter([pa.RecordBatch.from_arrays([texts], names=["text"])]), "text", SHARD_BYTES):
            w, doc_end = _shard(part.column(0))
            order = None
            for tests in _tests(path, min_words, least_item_words):
                if order is None or tests.longest > sorted_to:
                    sorted_to = tests.longest
                    order, _ = suffix_array(w.hash, sorted_to, False)
                flags[at + w.text[affected(w.hash, order, doc_end, tests)]] = True
            at += part.num_rows
        trim()
        return pa.array(flags)

    return docs.filter(~hit(F.col(f"`{text}`")))
