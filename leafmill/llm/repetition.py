"""Quality rule: repetition inside a document, from its suffix array.

Every suffix of a document's words is sorted; the longest-common-prefix
intervals of that order are the repeated word sequences. The rule limits the
fraction of the text that repeated sequences cover and the longest of them.
Sequences of few words count if they occur often or several times in a row.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.llm.common import Words, free_name, mix, neighbour_lcp, slices, suffix_array, tidy, utf8

#: Words that a repeated sequence has at least, whatever its occurrences.
MIN_WORDS = 8
#: A shorter one counts from so many occurrences; the least length falls by a word for each further one.
#: In long texts its occurrences must also be 1 / (2 * 4**words) of the words at least: the commonest
#: sequences of ordinary text are about half as frequent or less.
MIN_SHORT = 3
#: One of under MIN_WORDS words also counts where it stands so many times in a row.
MIN_IN_ROW = 3
#: A document is rejected if repeated sequences cover more of it, or if one of them has more words. A
#: single sentence said twice, such as a licence line, is no repetition: of under MIN_REPEATS occurrences
#: beyond the first of each sequence, those of at most MAX_SENTENCE words don't count as covered.
MAX_COVERED = 0.3
MIN_REPEATS = 2
MAX_LONGEST = 100
MAX_SENTENCE = 30
#: Longer runs of letters are cut by content into pieces of at most so many bytes, so that repetition without
#: spaces counts wherever its copies stand.
PIECE_BYTES = 32

_OUT = "n_words bigint, n_repeats bigint, n_extra bigint, longest_words bigint, longest_bytes bigint, covered_fraction double, short_fraction double, repeated_fraction double"


def maximal_repeats(order: np.ndarray, lcp: np.ndarray, before: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """(suffix-array index, length, occurrences) of each maximal repeat of at least `least` symbols:
    the LCP intervals whose occurrences aren't all preceded by the same symbol."""
    found: list[tuple[int, int, int]] = []
    hot = np.flatnonzero(lcp >= least)
    if not len(hot):
        return found
    runs = np.split(hot, np.flatnonzero(np.diff(hot) > 1) + 1)
    for run in runs:
        values = lcp[run].tolist()
        left = before[order[run[0] : run[-1] + 2]]
        base = int(run[0])
        if len(run) == 1:
            if left[0] != left[1]:
                found.append((base, values[0], 2))
            continue
        change = np.concatenate([[0], np.cumsum(left[1:] != left[:-1])]).tolist()
        stack: list[tuple[int, int]] = []
        for i, v in enumerate([*values, 0]):
            lo = i
            while stack and stack[-1][1] > v:
                lo, height = stack.pop()
                if change[i] > change[lo]:
                    found.append((base + lo, height, i - lo + 1))
            if v and (not stack or stack[-1][1] < v):
                stack.append((lo, v))
    return found


def _union(n: int, at: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Which of n words lie in any of the sequences of `length` words from `at`."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, at, 1)
    np.add.at(change, at + length, -1)
    return np.cumsum(change[:-1]) > 0


def short_repeats(symbols: np.ndarray, order: np.ndarray, lcp: np.ndarray, total: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """First word and length of the sequences of under `least` words that occur often, and of the runs
    of one that stands MIN_IN_ROW times in a row or more. total has the words of each word's text."""
    n, at, length = len(symbols), [], []
    for size in range(1, least):
        heads = np.flatnonzero(np.append(True, lcp < size))
        count = np.diff(np.append(heads, n))
        often = (count >= max(MIN_SHORT, least + 1 - size)) & (count * (2.0 * 4.0**size) >= total[order[heads]])
        at.append(order[np.repeat(often, count)])
        length.append(np.full(len(at[-1]), size))
        if n > size:
            edges = np.flatnonzero(np.diff(np.concatenate([[0], symbols[size:] == symbols[:-size], [0]])))
            begin, same = edges[::2], edges[1::2] - edges[::2]
            row = same >= (MIN_IN_ROW - 1) * size
            at.append(begin[row])
            length.append(same[row] + size)
    return (np.concatenate(at), np.concatenate(length)) if at else (np.zeros(0, np.int64),) * 2


def _measure(data: np.ndarray, offsets: np.ndarray, least: int) -> dict[str, np.ndarray]:
    n = len(offsets) - 1
    w = Words(data, offsets, longest=PIECE_BYTES)
    out = {k: np.zeros(n, np.int64) for k in ("n_repeats", "n_extra", "longest_words", "longest_bytes")}
    out |= {"n_words": w.count.astype(np.int64), **{k: np.zeros(n) for k in ("covered_fraction", "short_fraction", "repeated_fraction")}}
    if len(w) < 2:
        return out
    # a word of another document is another symbol, so no repeat crosses documents
    symbols = mix(w.hash + w.text.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order, levels = suffix_array(symbols)
    lcp = neighbour_lcp(order, levels)
    before = np.zeros(len(w), np.uint64)
    before[1:] = symbols[:-1]
    for index, _, count in maximal_repeats(order, lcp, before, least):
        text = w.text[order[index]]
        out["n_repeats"][text] += 1
        out["n_extra"][text] += count - 1
    here = np.zeros(len(w), np.int64)
    here[:-1] = lcp
    here[1:] = np.maximum(here[1:], lcp)
    hit = np.flatnonzero(here >= least)
    at, length = order[hit], here[hit]
    text, size = w.text[at], w.end[at + length - 1] - w.start[at]
    np.maximum.at(out["longest_words"], text, length)
    np.maximum.at(out["longest_bytes"], text, size)
    width = np.append(w.start[1:], 0) - w.start
    ends = w.first[1:][w.count > 0] - 1
    width[ends] = w.end[ends] - w.start[ends]
    total = np.maximum(np.bincount(w.text, width, n), 1)
    covered = _union(len(w), at, length)
    short = _union(len(w), *short_repeats(symbols, order, lcp, w.count[w.text], least))
    for name, which in (("covered_fraction", covered), ("short_fraction", short), ("repeated_fraction", covered | short)):
        out[name] = np.bincount(w.text, width * which, n) / total
    return out


def _run(batches: Iterator[pa.RecordBatch], least: int, text: str, names: list[str]) -> Iterator[pa.RecordBatch]:
    yield from tidy(_measured(batches, least, text, names))


def _measured(batches: Iterator[pa.RecordBatch], least: int, text: str, names: list[str]) -> Iterator[pa.RecordBatch]:
    for part in slices(batches, text):
        found = _measure(*utf8(part.column(part.schema.get_field_index(text))), least)
        columns = [part.column(i) for i in range(part.num_columns)] + [pa.array(found[c.split()[0]]) for c in _OUT.split(", ")]
        yield pa.RecordBatch.from_arrays(columns, names=[*part.schema.names, *names])


def repetition(docs: DataFrame, text: str = "text", min_words: int = MIN_WORDS, max_covered: float = MAX_COVERED, min_repeats: int = MIN_REPEATS, max_longest: int = MAX_LONGEST, max_sentence: int = MAX_SENTENCE) -> DataFrame:
    """docs and, for each row, n_words, n_repeats (maximal repeated sequences of at least min_words
    words), n_extra (their occurrences beyond the first of each), longest_words and longest_bytes of the longest of them, covered_fraction (of the bytes
    between the first and last word, those in the union of repeats), short_fraction (the same of
    shorter sequences that occur often or in a row, see MIN_SHORT), repeated_fraction (the same of
    both) and keep, which is false if repeated_fraction is over max_covered, or one repeat has more
    than max_longest words. If n_extra is under min_repeats and longest_words at most max_sentence,
    it's short_fraction that max_covered limits.

    A null, empty or wordless text has zeros and is kept. Rows are judged one by one: repeated rows
    and null keys don't matter. A column of docs with the name of a new one stays; the new one gets a
    trailing underscore. There is no shuffle."""
    names = [free_name(docs, k) for k in (*(c.split()[0] for c in _OUT.split(", ")), "keep")]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema), *(f"`{n}` {c.split()[1]}" for n, c in zip(names, _OUT.split(", ")))])
    out = docs.mapInArrow(partial(_run, least=min_words, text=text, names=names[:-1]), schema)
    _, _, extra, longest, _, _, short, repeated, keep = names
    judged = F.when((F.col(extra) < min_repeats) & (F.col(longest) <= max_sentence), F.col(short)).otherwise(F.col(repeated))
    return out.withColumn(keep, (judged <= max_covered) & (F.col(longest) <= max_longest))


def keep_unrepetitive(docs: DataFrame, text: str = "text", **limits: float) -> DataFrame:
    """The rows of docs that the rule keeps, with the columns of docs."""
    found = repetition(docs, text, **limits)
    return found.filter(F.col(found.columns[-1])).select(*docs.columns)
