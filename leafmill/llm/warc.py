"""External merge of a web archive's capture index.

Captures are sorted locally into runs, one file a task. Runs are merged with a
loser tree: each match decides with one comparison a level which run's next
capture is the least, and a whole stretch of a run is taken at once as long as
it stays below the runner-up. Merging tasks share the work by key ranges: each
finds its range in every run by binary search over row groups and rows, so that
it also knows the global position of its first capture. Above FAN_IN runs there
are several passes.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow.fs import FileSelector, FileSystem
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leafmill.llm.common import local_uri, shared_folder, tidy

#: Runs that a task merges at once; its memory is BATCH_ROWS index rows of each.
FAN_IN = 256
BATCH_ROWS = 2048
#: Captures that a merging task takes, about.
RANGE_ROWS = 1_000_000
#: Sampled keys for each range from which the ranges' borders are chosen. Borders only share out work.
SAMPLES = 256
#: Bytes of a run's row group, the least that a task reads of it.
GROUP_BYTES = 4 << 20

KEY = "sort_key"


def surt(url: Column | str) -> Column:
    """The sort-friendly key of a URL: host labels reversed and joined by commas, `)`, path and query,
    in lower case; without scheme, user, port 80 or 443, a leading www, fragment and trailing slash, and
    with the query's parts in order. A null or empty URL has the empty key."""
    url = F.lower(F.trim(F.col(url) if isinstance(url, str) else url))
    bare = F.regexp_replace(F.regexp_replace(url, r"#.*$", ""), r"^[a-z][a-z0-9+.-]*://", "")
    site = F.regexp_replace(F.regexp_extract(bare, r"^[^/?]*", 0), r"^[^@]*@", "")
    host = F.regexp_replace(F.regexp_replace(site, r":(80|443)$", ""), r"^www[0-9]*\.", "")
    path = F.regexp_replace(F.regexp_extract(bare, r"^[^/?]*([^?]*)", 1), r"/+$", "")
    query = F.array_join(F.array_sort(F.split(F.regexp_extract(bare, r"\?(.*)$", 1), "&")), "&")
    made = F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))
    return F.when(F.coalesce(F.length(bare), F.lit(0)) > 0, made).otherwise("")


def _number(x: Column) -> Column:
    """A number as 16 hexadecimal digits in its order; null comes first."""
    return F.when(x.isNull(), "!").otherwise(F.concat(F.lit("+"), F.lpad(F.hex(x.bitwiseXOR(F.lit(-(2**63)))), 16, "0")))


def captures(pages: DataFrame, url: str = "url", at: str = "timestamp", key: str = "page_id", body: str = "html") -> DataFrame:
    """(sort_key, urlkey, micros (the timestamp), page_id, url, digest, n_bytes) of every capture; digest and n_bytes
    are null for a null body. sort_key orders by urlkey, timestamp, page_id and digest, nulls first. The key
    keeps its type: whole numbers are ordered as such, all others as text."""
    stamp, own = F.col(f"`{at}`").cast("timestamp"), F.col(f"`{key}`")
    rows = pages.select(surt(F.col(f"`{url}`")).alias("urlkey"), F.unix_micros(stamp).alias("micros"), own.alias("page_id"), F.col(f"`{url}`").alias("url"), F.sha1(F.col(f"`{body}`")).alias("digest"), F.octet_length(F.col(f"`{body}`")).cast("bigint").alias("n_bytes"))
    whole = isinstance(pages.schema[key].dataType, (T.ByteType, T.ShortType, T.IntegerType, T.LongType))
    place = _number(F.col("page_id").cast("bigint")) if whole else F.when(F.col("page_id").isNull(), "!").otherwise(F.concat(F.lit("+"), F.col("page_id").cast("string")))
    tail = F.encode(F.concat_ws("\0", _number(F.col("micros")), place, F.coalesce("digest", F.lit("")), F.coalesce("url", F.lit(""))), "utf-8")
    order = F.concat(F.encode("urlkey", "utf-8"), F.lit(b"\0"), tail)
    return rows.select(order.alias(KEY), *rows.columns)


class Run:
    """A sorted file that is read from a key on, a batch at a time."""

    def __init__(self, fs: FileSystem, path: str) -> None:
        self.file = pq.ParquetFile(fs.open_input_file(path))
        self.names = [n for n in self.file.schema_arrow.names if n != KEY]
        meta = self.file.metadata
        self.sizes = [meta.row_group(k).num_rows for k in range(meta.num_row_groups)]
        self.keys: list[bytes] = []
        self.batch: pa.RecordBatch | None = None
        self.at = 0
        self._heads: dict[int, list[bytes]] = {}

    def _keys_of(self, group: int) -> list[bytes]:
        if group not in self._heads:
            self._heads = {group: self.file.read_row_group(group, [KEY]).column(0).to_pylist()}
        return self._heads[group]

    def rank(self, key: bytes) -> tuple[int, int, int]:
        """How many keys are less than a key, and the row group and the row in it where the others begin."""
        lo, hi = 0, len(self.sizes)
        while lo < hi:  # the first row group that doesn't begin below the key
            mid = (lo + hi) // 2
            lo, hi = (mid + 1, hi) if self._first(mid) < key else (lo, mid)
        if lo == 0:
            return 0, 0, 0
        row = bisect_left(self._keys_of(lo - 1), key)
        return sum(self.sizes[: lo - 1]) + row, lo - 1, row

    def _first(self, group: int) -> bytes:
        column = self.file.schema_arrow.get_field_index(KEY)
        stats = self.file.metadata.row_group(group).column(column).statistics
        return stats.min if stats is not None and stats.has_min_max and isinstance(stats.min, bytes) else self._keys_of(group)[0]

    def seek(self, group: int, row: int) -> None:
        self._heads = {}
        groups = list(range(group, len(self.sizes)))
        self.batches = iter(self.file.iter_batches(BATCH_ROWS, row_groups=groups)) if groups else iter(())
        self.skip = row
        self.fill()

    def fill(self) -> bool:
        """Reads the next batch with rows; false at the end."""
        for batch in self.batches:
            if self.skip >= batch.num_rows:
                self.skip -= batch.num_rows
                continue
            batch, self.skip = batch.slice(self.skip), 0
            self.keys, self.batch, self.at = batch.column(batch.schema.get_field_index(KEY)).to_pylist(), batch, 0
            return True
        self.keys, self.batch, self.at = [], None, 0
        return False


class LoserTree:
    """The tournament of k runs: each inner node has the loser of its match, the root the winner. A run
    that is at its end has no key and loses every match; equal keys are won by the earlier run."""

    def __init__(self, heads: list[bytes | None]) -> None:
        self.size = 1 << max(0, (len(heads) - 1).bit_length())
        self.heads = [*heads, *[None] * (self.size - len(heads))]
        self.loser = [0] * self.size
        winner = [0] * self.size + list(range(self.size))
        for node in range(self.size - 1, 0, -1):
            a, b = winner[2 * node], winner[2 * node + 1]
            winner[node], self.loser[node] = (a, b) if self.beats(a, b) else (b, a)
        self.winner = winner[1] if self.size > 1 else 0

    def beats(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        if x is None or y is None:
            return y is None and (x is not None or a < b)
        return x < y or x == y and a < b

    def runner_up(self) -> int | None:
        """The best of those that lost against the winner; all are on its way up."""
        best, node = None, (self.winner + self.size) >> 1
        while node:
            if best is None or self.beats(self.loser[node], best):
                best = self.loser[node]
            node >>= 1
        return best

    def replace(self, head: bytes | None) -> None:
        """The winner's next key; its matches on the way up are played again."""
        own = self.winner
        self.heads[own] = head
        node = (own + self.size) >> 1
        while node:
            if self.beats(self.loser[node], own):
                own, self.loser[node] = self.loser[node], own
            node >>= 1
        self.winner = own


def merge(runs: list[Run], stop: bytes | None) -> Iterator[tuple[pa.Table, list[bytes]]]:
    """The runs' rows from where they stand, in order, up to a key; with their keys, in tables."""
    tree = LoserTree([r.keys[0] if r.keys else None for r in runs])
    window: list[pa.RecordBatch] = []
    base: dict[int, tuple[pa.RecordBatch, int]] = {}
    picked: list[np.ndarray] = []
    keys: list[bytes] = []
    rows = 0

    def flush() -> tuple[pa.Table, list[bytes]]:
        out = pa.Table.from_batches(window).combine_chunks().take(pa.array(np.concatenate(picked)))
        return out, list(keys)

    while runs:
        own = tree.winner
        run = runs[own]
        if tree.heads[own] is None or stop is not None and tree.heads[own] >= stop:
            break
        second = tree.runner_up()
        limit = tree.heads[second] if second is not None else None
        end = len(run.keys) if limit is None else max(run.at + 1, bisect_left(run.keys, limit, run.at))
        if stop is not None and end > run.at + 1:
            end = min(end, bisect_left(run.keys, stop, run.at))
        if own not in base or base[own][0] is not run.batch:
            base[own] = (run.batch, rows)
            window.append(run.batch)
            rows += run.batch.num_rows
        picked.append(np.arange(base[own][1] + run.at, base[own][1] + end))
        keys += run.keys[run.at : end]
        run.at = end
        if end == len(run.keys):
            run.fill()
        tree.replace(run.keys[run.at] if run.keys else None)
        if len(keys) >= 8 * BATCH_ROWS or rows > (len(runs) + 8) * BATCH_ROWS * 2:
            yield flush()
            window, base, picked, keys, rows = [], {}, [], [], 0
    if keys:
        yield flush()


def _open(folder: str, names: list[str]) -> list[Run]:
    fs, where = FileSystem.from_uri(local_uri(folder))
    return [Run(fs, f"{where}/{n}") for n in names]


def _files(folder: str) -> dict[int, str]:
    """The files of a folder by the number of the task that wrote them."""
    fs, where = FileSystem.from_uri(local_uri(folder))
    found = (f.base_name for f in fs.get_file_info(FileSelector(where)) if f.base_name.endswith(".parquet") and f.size)
    return {int(re.match(r"part-(\d+)", n)[1]): n for n in found}


def _borders(spark: SparkSession, folder: str, range_rows: int) -> list[bytes]:
    """Keys that cut the captures of runs into ranges of about range_rows; the driver gets one for each range."""
    runs = spark.read.parquet(folder).select(KEY)
    ranges = max(1, -(-runs.count() // range_rows))
    if ranges == 1:
        return []
    some = runs.where(F.pmod(F.xxhash64(KEY), F.lit(max(1, range_rows // SAMPLES))) == 0).distinct()

    def least(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = min((min(b.column(0).to_pylist()) for b in batches if b.num_rows), default=None)
        yield pa.RecordBatch.from_arrays([pa.array([] if found is None else [found], pa.binary())], names=[KEY])

    return sorted(bytes(r[0]) for r in some.repartitionByRange(ranges, KEY).mapInArrow(least, f"{KEY} binary").collect())[1:]


class _Runs:
    """Sorted runs, each cut at the same edges into files: names[run][k] has the keys from edges[k - 1] to edges[k]."""

    def __init__(self, folder: str, names: list[list[str | None]], edges: list[bytes]) -> None:
        self.folder, self.names, self.edges = folder, names, edges

    def at(self, key: bytes, some: slice = slice(None)) -> tuple[int, list[Run]]:
        """The cut that a key lies in, and that cut's files."""
        k = bisect_right(self.edges, key)
        return k, _open(self.folder, [n[k] for n in self.names[some] if n[k]])


def merged(folder: str, spark: SparkSession, schema: str, fan_in: int = FAN_IN, range_rows: int = RANGE_ROWS) -> DataFrame:
    """All rows of the runs in a folder (columns as in schema, after sort_key) in order, with `position`
    (0 for the least) and `capture` (1 for the first of its urlkey): partition by partition, row by row."""
    runs = _Runs(folder, [[n] for _, n in sorted(_files(folder).items())], [])
    if not runs.names:
        return spark.createDataFrame([], f"position bigint, capture bigint, {schema}")
    borders = _borders(spark, folder, range_rows)
    while len(runs.names) > fan_in:
        groups = -(-len(runs.names) // fan_in)
        # each group's share of the ranges; powers of two, so that a pass cuts where the one before it did
        step = 1 << max(0, ((len(borders) + 1) // max(1, -(-(len(borders) + 1) // groups))).bit_length() - 1)
        edges = borders[step - 1 :: step]
        cuts, folder = len(edges) + 1, f"{shared_folder(spark)}/runs"

        def wider(batches: Iterator[pa.RecordBatch], runs: _Runs = runs, edges: list[bytes] = edges, cuts: int = cuts) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for number in b.column(0).to_pylist():
                    group, k = divmod(number, cuts)
                    begin = edges[k - 1] if k else b""
                    _, own = runs.at(begin, slice(group * fan_in, (group + 1) * fan_in))
                    for r in own:
                        r.seek(*r.rank(begin)[1:])
                    for table, _ in merge(own, edges[k] if k < len(edges) else None):
                        yield from table.to_batches()

        spark.range(0, groups * cuts, 1, groups * cuts).mapInArrow(wider, f"{KEY} binary, {schema}").write.option("parquet.block.size", GROUP_BYTES).parquet(folder)
        files = _files(folder)
        runs = _Runs(folder, [[files.get(g * cuts + k) for k in range(cuts)] for g in range(groups)], edges)
    before = [0]
    if runs.edges:
        cut = F.pmod(F.regexp_extract(F.input_file_name(), r"part-(\d+)", 1).cast("int"), F.lit(len(runs.edges) + 1))
        count = dict(spark.read.parquet(runs.folder).groupBy(cut.alias("cut")).count().collect())
        before = np.cumsum([0, *(count.get(k, 0) for k in range(len(runs.edges)))]).tolist()
    ends: list[bytes | None] = [None, *borders, None]

    def ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in b.column(0).to_pylist():
                yield from _one_range(runs, before, ends[k] or b"", ends[k + 1])

    return spark.range(0, len(borders) + 1, 1, len(borders) + 1).mapInArrow(lambda b: tidy(ranges(b)), f"position bigint, capture bigint, {schema}")


def _one_range(runs: _Runs, before: list[int], begin: bytes, stop: bytes | None) -> Iterator[pa.RecordBatch]:
    cut, own = runs.at(begin)
    places = [r.rank(begin) for r in own]
    position = before[cut] + sum(p[0] for p in places)
    for r, (_, group, row) in zip(own, places):
        r.seek(group, row)
    history, first = None, position  # the urlkey that is being read, and the position of its first capture
    for table, keys in merge(own, stop):
        url = [k[: k.index(b"\0")] for k in keys]
        capture = np.empty(len(url), np.int64)
        for i, u in enumerate(url):
            if u != history:
                first = position + i
                if history is None:  # an earlier range may have captures of this URL
                    cut, others = runs.at(u + b"\0")
                    first = before[cut] + sum(r.rank(u + b"\0")[0] for r in others)
                history = u
            capture[i] = position + i - first + 1
        rows = table.drop_columns([KEY])
        columns = [pa.array(np.arange(position, position + len(url))), pa.array(capture), *(rows.column(n).combine_chunks() for n in rows.column_names)]
        yield from pa.table(columns, names=["position", "capture", *rows.column_names]).to_batches()
        position += len(url)


_SCHEMA = "urlkey string, micros bigint, page_id {key}, url string, digest string, n_bytes bigint"


def capture_index(pages: DataFrame, url: str = "url", at: str = "timestamp", key: str = "page_id", body: str = "html", fan_in: int = FAN_IN, range_rows: int = RANGE_ROWS) -> DataFrame:
    """Every capture in the order of urlkey, timestamp, page_id and digest: position, capture (its
    number in its URL's history), urlkey, timestamp, page_id, url, digest and n_bytes.

    Keys keep their type. Null keys and times come first; a null or empty URL has the empty urlkey; repeated rows stay side by
    side; a null body has a null digest; other columns don't matter. Runs lie in the shared folder."""
    spark = pages.sparkSession
    folder = f"{shared_folder(spark)}/runs"
    captures(pages, url, at, key, body).sortWithinPartitions(KEY).write.option("parquet.block.size", GROUP_BYTES).parquet(folder)
    found = merged(folder, spark, _SCHEMA.format(key=pages.schema[key].dataType.simpleString()), fan_in, range_rows)
    return found.select("position", "capture", "urlkey", F.timestamp_micros("micros").alias("timestamp"), "page_id", "url", "digest", "n_bytes")
