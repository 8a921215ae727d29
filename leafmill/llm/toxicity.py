"""Toxicity by a chain of classifiers.

Categories are predicted one after the other by linear models over the words of
a text and over their beginnings; each model also takes the probabilities of the
categories before it. In training these are out-of-fold predictions, as those of
a model for its own training rows would be too good.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.llm.common import Words, slices, tidy, utf8

#: Labelled documents, the least by a hash of their key, that the chain is fitted on; the sample is bounded by it.
TRAIN_DOCS = 8_000
#: Folds of the out-of-fold predictions.
FOLDS = 5
#: Probability of the last category from which a document counts as toxic; set on held-out documents, where few are clean above it.
THRESHOLD = 0.3
#: Bytes of a word's beginning that is a feature, for words of at least two bytes more.
PREFIX_BYTES = 6
#: Features need a difference between the rates of a category's documents and of others by so many standard errors, and so many documents.
LEAST_Z, LEAST_DOCS = 5.0, 3
#: Features of a document that fitting uses at most (those of the least hashes); scoring uses all.
TRAIN_FEATURES = 20_000
#: Columns of the labels that are links of the chain before the last, if the labels have them.
EARLIER = ("quality",)
#: Categories that the labels don't have are derived from words, within documents that are labelled toxic.
LEXICON = {
    "insult": "idiot moron clown loser scum fool imbecile stupid dumb jerk".split(),
    "contempt": "worthless pathetic disgusting trash garbage useless filth vile".split(),
}


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The text and the hash of every feature of every text, each once in a text."""
    w = Words(data, offsets)
    long = w.end - w.start >= PREFIX_BYTES + 2
    text, found = np.concatenate([w.text, w.text[long]]), np.concatenate([w.hash, w.prefix(PREFIX_BYTES)[long]])
    order = np.lexsort((found, text))
    text, found = text[order], found[order]
    new = np.ones(len(text), bool)
    new[1:] = (text[1:] != text[:-1]) | (found[1:] != found[:-1])
    return text[new], found[new]


def word_hash(word: str) -> int:
    """The hash of a word as a feature."""
    return int(Words(*utf8(pa.array([word]))).hash[0])


@dataclass
class Chain:
    """Fitted models in order: for each, the weights of the kept features (sorted hashes), of the
    probabilities before it, and a bias."""

    names: list[str]
    hashes: np.ndarray
    weights: np.ndarray  # features by categories
    links: np.ndarray  # earlier categories by categories
    bias: np.ndarray

    def score(self, text: np.ndarray, found: np.ndarray, n: int) -> np.ndarray:
        """Probabilities (texts, categories) from the texts' features."""
        at = np.minimum(np.searchsorted(self.hashes, found), max(len(self.hashes) - 1, 0))
        hit = self.hashes[at] == found if len(self.hashes) else np.zeros(len(found), bool)
        text, at = text[hit], at[hit]
        out = np.zeros((n, len(self.names)))
        for k in range(len(self.names)):
            out[:, k] = _sigmoid(np.bincount(text, self.weights[at, k], n) + out[:, :k] @ self.links[:k, k] + self.bias[k])
        return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def fit_linear(row: np.ndarray, column: np.ndarray, dense: np.ndarray, y: np.ndarray, columns: int, steps: int = 300) -> tuple[np.ndarray, np.ndarray, float]:
    """Logistic regression with a ridge, by Adam over all rows: sparse 0/1 features (row, column) and
    dense ones; returns their weights and the bias."""
    n, d = len(y), dense.shape[1]
    x = np.zeros(columns + d + 1)
    m, v = np.zeros_like(x), np.zeros_like(x)
    for t in range(1, steps + 1):
        p = _sigmoid(np.bincount(row, x[column], n) + dense @ x[columns : columns + d] + x[-1])
        slope = (p - y) / n
        g = np.concatenate([np.bincount(column, slope[row], columns), dense.T @ slope, [slope.sum()]])
        g[:-1] += 1e-4 * x[:-1]
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        x -= 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-9)
    return x[:columns], x[columns : columns + d], float(x[-1])


def fit(row: np.ndarray, found: np.ndarray, labels: np.ndarray, names: Sequence[str], folds: int = FOLDS) -> Chain:
    """A chain fitted to labels (texts, categories) and the texts' features. Without a row of either
    kind a category has its smoothed rate as its probability everywhere."""
    n = len(labels)
    every, column = np.unique(found, return_inverse=True)
    count = np.bincount(column, minlength=len(every))
    keep = np.zeros(len(every), bool)
    for y in labels.T:
        a, b = y.sum(), n - y.sum()
        if not a or not b:
            continue
        hits = np.bincount(column, y[row], len(every))
        rate = count / n
        se = np.sqrt(np.maximum(rate * (1 - rate), 1e-12) * (1 / a + 1 / b))
        keep |= (np.abs(hits / a - (count - hits) / b) >= LEAST_Z * se) & (count >= LEAST_DOCS)
    place = np.cumsum(keep) - 1
    inside = keep[column]
    row, column = row[inside], place[column[inside]]
    c, k = int(keep.sum()), labels.shape[1]
    weights, links, bias = np.zeros((c, k)), np.zeros((k, k)), np.zeros(k)
    fold = np.arange(n) % folds
    before = np.zeros((n, 0))
    for j, y in enumerate(labels.T.astype(float)):
        if 0 < y.sum() < n:
            weights[:, j], links[:j, j], bias[j] = fit_linear(row, column, before, y, c)
        else:
            bias[j] = np.log((y.sum() + 0.5) / (n - y.sum() + 0.5))
        if j == k - 1:
            break
        out = np.zeros(n)
        for f in range(folds):  # each row is predicted by a model that didn't see it
            rest, held = fold != f, fold == f
            if not held.any() or not 0 < y[rest].sum() < rest.sum():
                out[held] = (y.sum() + 0.5) / (n + 1)
                continue
            index = np.cumsum(rest) - 1
            some = rest[row]
            w, l, b = fit_linear(index[row[some]], column[some], before[rest], y[rest], c)
            part = ~some
            out[held] = _sigmoid(np.bincount(row[part], w[column[part]], n) + before @ l + b)[held]
        before = np.column_stack([before, out])
    return Chain(list(names), every[keep], weights, links, bias)


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", lexicon: dict[str, list[str]] = LEXICON, most: int = TRAIN_DOCS, earlier: Sequence[str] = EARLIER) -> Chain:
    """A chain over the labels' columns `earlier`, the categories of `lexicon` (which are derived from words, not
    labelled) and, last, `label`, fitted on at most `most` labelled documents. Null labels, keys and texts are
    left out, a null in an earlier column counts as 0; of several labels or texts of a key all count. Without
    labels every probability is small."""
    earlier = [c for c in earlier if c in labels.columns and c != label]
    names = [*earlier, *lexicon, label]
    bits = [F.coalesce(F.col(f"`{c}`").cast("int") > 0, F.lit(False)).cast("int") * 2 ** (k + 1) for k, c in enumerate(earlier)]
    mark = sum(bits, F.when(F.col(f"`{label}`").isNotNull(), (F.col(f"`{label}`").cast("int") > 0).cast("int")))
    chosen = labels.select(F.col(f"`{key}`").alias("k"), mark.alias("y")).where("k is not null and y is not null").orderBy(F.xxhash64("k"), "k", "y").limit(most)

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            row, hashes = features(*utf8(part.column(1)))
            fits = np.arange(len(row)) - np.searchsorted(row, row) < TRAIN_FEATURES
            row, hashes = row[fits], hashes[fits]
            offsets = np.searchsorted(row, np.arange(part.num_rows + 1))
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(hashes.view(np.int64)))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), lists], names=["h", "y", "found"])

    # the labels are bounded by `most`, so they may be broadcast
    rows = docs.select(F.col(f"`{key}`").alias("k"), F.col(f"`{text}`").alias("text")).where("text is not null").join(F.broadcast(chosen), "k").select(F.xxhash64("k", "text").alias("h"), "text", "y")
    got = rows.mapInArrow(lambda b: tidy(found(b)), "h bigint, y int, found array<bigint>").toArrow().combine_chunks()
    if not got.num_rows:
        return Chain(names, np.zeros(0, np.uint64), np.zeros((0, len(names))), np.zeros((len(names),) * 2), np.full(len(names), -5.0))
    got = got.sort_by([("h", "ascending"), ("y", "ascending")]).combine_chunks()
    lists = got.column("found").chunk(0)
    size = lists.value_lengths().to_numpy()
    hashes = lists.flatten().to_numpy().view(np.uint64)
    row = np.repeat(np.arange(len(size)), size)
    marks = got.column("y").to_numpy()
    toxic = marks & 1 > 0
    y = np.zeros((len(size), len(names)), bool)
    y[:, -1] = toxic
    for j in range(len(earlier)):
        y[:, j] = marks & 2 ** (j + 1) > 0
    for j, words in enumerate(lexicon.values(), len(earlier)):
        hit = np.isin(hashes, np.array([word_hash(w) for w in words], np.uint64))
        y[np.unique(row[hit]), j] = True
        y[:, j] &= toxic
    return fit(row, hashes, y, names)


def score(docs: DataFrame, chain: Chain, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, p_<category> for each category in the chain's order) for every row of docs. A null or
    empty text has the probabilities of a text without known words; null keys are carried; repeated
    rows are each scored; other columns don't matter. There is no shuffle."""
    columns = [f"p_{n}" for n in chain.names]
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            p = chain.score(*features(*utf8(part.column(1))), part.num_rows)
            yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(x) for x in p.T)], names=["doc_id", *columns])

    out = ", ".join([f"doc_id {kind}", *(f"`{c}` double" for c in columns)])
    return docs.select(F.col(f"`{key}`").alias("doc_id"), F.col(f"`{text}`").alias("text")).mapInArrow(lambda b: tidy(run(b)), out)


def toxic(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of score() whose last probability is at least `threshold`, by a chain trained on labels."""
    found = score(docs, train(docs, labels, key, text, label), key, text)
    return found.where(F.col(f"`{found.columns[-1]}`") >= threshold)
