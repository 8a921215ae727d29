"""URL filters by a cascade of Bloom filters.

Level 0 holds the listed keys; level 1 those other keys of the universe that
level 0 takes for listed; level 2 the listed keys that level 1 takes for others;
and so on until a level takes none wrongly. A key is listed if the first level
that doesn't have it is odd. Over the universe that the cascade was built for,
the answer is exact. Keys are cut by hash into shards of a bounded size, each
with a cascade of its own, built in one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.dataset as ds
from pyarrow.fs import FileSystem
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.llm.common import free_name, local_uri, mix, shared_folder

#: Keys of the universe in a shard, about: what the task that builds its cascade holds (17 bytes each).
SHARD_KEYS = 2_000_000
#: Bytes of all cascades up to which each worker keeps them all; beyond it rows go to the shard they ask.
WORKER_BYTES = 64 << 20
#: False positives that level 0 has, and the levels after it.
RATES = (0.02, 0.5)
#: Levels after which keys that are still wrong are stored as they are (two keys of one 128-bit hash).
MOST_LEVELS = 60

_loaded: dict[str, dict[int, Cascade]] = {}


def _places(keys: np.ndarray, level: int, hashes: int, bits: int) -> np.ndarray:
    """(keys, hashes) bit numbers by double hashing of 128-bit keys (n, 2)."""
    a = mix(keys[:, 0] + np.uint64(level * 0x9E3779B97F4A7C15 % 2**64))
    b = mix(keys[:, 1] ^ np.uint64(level)) | np.uint64(1)
    return (a[:, None] + np.arange(hashes, dtype=np.uint64) * b[:, None]) % np.uint64(bits)


class Bloom:
    """One level: a filter of `bits` bits for which each key sets `hashes`."""

    def __init__(self, level: int, hashes: int, bits: int, data: np.ndarray) -> None:
        self.level, self.hashes, self.bits, self.data = level, hashes, bits, data

    @classmethod
    def of(cls, keys: np.ndarray, level: int, rate: float) -> Bloom:
        bits = max(64, int(np.ceil(-len(keys) * np.log(rate) / np.log(2) ** 2)))
        made = cls(level, max(1, round(bits / max(len(keys), 1) * np.log(2))) if len(keys) else 1, bits, np.zeros(-(-bits // 8), np.uint8))
        made.hashes = min(made.hashes, 16)
        for at in range(0, len(keys), 200_000):
            where = _places(keys[at : at + 200_000], level, made.hashes, bits).ravel()
            np.bitwise_or.at(made.data, (where >> np.uint64(3)).astype(np.int64), (np.uint8(1) << (where & np.uint64(7)).astype(np.uint8)))
        return made

    def has(self, keys: np.ndarray) -> np.ndarray:
        where = _places(keys, self.level, self.hashes, self.bits)
        return ((self.data[(where >> np.uint64(3)).astype(np.int64)] >> (where & np.uint64(7)).astype(np.uint8)) & 1).all(1)


class Cascade:
    """The levels of one shard, and the listed keys that no level could tell."""

    def __init__(self, levels: list[Bloom], rest: np.ndarray) -> None:
        self.levels, self.rest = levels, rest

    @classmethod
    def of(cls, keys: np.ndarray, listed: np.ndarray, rates: tuple[float, float] = RATES) -> Cascade:
        """The cascade that tells keys[listed] from the others (all distinct)."""
        inside, outside, levels = keys[listed], keys[~listed], []
        while len(inside) and len(levels) < MOST_LEVELS:
            levels.append(Bloom.of(inside, len(levels), rates[min(len(levels), 1)]))
            wrong = np.concatenate([outside[at : at + 200_000][levels[-1].has(outside[at : at + 200_000])] for at in range(0, len(outside), 200_000)] or [outside])
            inside, outside = wrong, inside
        if not len(inside):
            return cls(levels, np.zeros((0, 2), np.uint64))
        return cls(levels, inside if len(levels) % 2 == 0 else outside)

    def has(self, keys: np.ndarray) -> np.ndarray:
        """Whether each key is listed; exact for keys of the universe."""
        first = np.full(len(keys), len(self.levels))
        live = np.arange(len(keys))
        for k, level in enumerate(self.levels):
            on = level.has(keys[live])
            first[live[~on]] = k
            live = live[on]
        out = first % 2 == 1
        if len(live) and len(self.levels) >= MOST_LEVELS:
            rest = {tuple(x) for x in self.rest.tolist()}
            out[live] = [tuple(x) in rest for x in keys[live].tolist()]
        return out


def url_key(url: Column | str) -> Column:
    """The key that a URL is listed by: host and path in lower case, without scheme, port, www and m
    labels, query, fragment and a trailing slash; null for a null or empty URL."""
    url = F.lower(F.trim(F.col(url) if isinstance(url, str) else url))
    bare = F.regexp_replace(F.regexp_replace(url, r"[?#].*$", ""), r"^[a-z][a-z0-9+.-]*://", "")
    bare = F.regexp_replace(F.regexp_replace(F.regexp_replace(bare, r"^([^/]*@)?(www\.|m\.)?", ""), r"^([^/:]*):[0-9]*", "$1"), r"/+$", "")
    return F.when(F.length(bare) > 0, bare)


_LEVEL = "shard int, level int, hashes int, bits bigint, data binary"


def _hashes(key: Column) -> list[Column]:
    return [F.xxhash64(key).alias("a"), F.xxhash64(F.lit("second"), key).alias("b")]


def _shard_of(a: Column, shards: int) -> Column:
    return F.pmod(F.shiftright(a, 20), F.lit(shards)).cast("int")


def build(universe: DataFrame, key: str, listed: Column, shard_keys: int = SHARD_KEYS, rates: tuple[float, float] = RATES) -> tuple[str, int, int]:
    """Writes the cascades that tell the keys of the rows of universe for which `listed` holds from all
    others; a key is listed if any of its rows is. Returns their folder, the shards and their bytes.
    Null keys take no part, repeated ones count once, an empty universe has no cascades."""
    path = f"{shared_folder(universe.sparkSession)}/cascades"
    keys = universe.select(F.col(f"`{key}`").alias("key"), F.coalesce(listed, F.lit(False)).alias("listed")).where("key is not null").select(*_hashes(F.col("key")), "listed")
    keys = keys.groupBy("a", "b").agg(F.max("listed").alias("listed"))
    shards = max(1, -(-universe.select(F.approx_count_distinct(F.col(f"`{key}`"))).first()[0] // shard_keys))

    def cascade(table: pa.Table) -> pa.Table:
        own = np.stack([table.column(c).to_numpy().view(np.uint64) for c in ("a", "b")], 1)
        made = Cascade.of(own, table.column("listed").to_numpy(), rates)
        rows = [(x.level, x.hashes, x.bits, x.data.tobytes()) for x in made.levels] + [(-1, 0, 0, made.rest.tobytes())]
        return pa.table({"shard": pa.array([table.column("shard")[0].as_py()] * len(rows), pa.int32()), "level": pa.array([r[0] for r in rows], pa.int32()), "hashes": pa.array([r[1] for r in rows], pa.int32()), "bits": pa.array([r[2] for r in rows], pa.int64()), "data": pa.array([r[3] for r in rows], pa.binary())})

    keys.withColumn("shard", _shard_of(F.col("a"), shards)).groupBy("shard").applyInArrow(cascade, _LEVEL).write.partitionBy("shard").parquet(path)
    written = universe.sparkSession.read.schema(_LEVEL).parquet(path)
    return path, shards, written.agg(F.sum(F.length("data"))).first()[0] or 0


def _load(path: str, shard: int | None) -> dict[int, Cascade]:
    """The cascades of a folder, or one of them; a worker keeps those of one folder."""
    have = _loaded.get(path, {})
    if (shard in have) if shard is not None else (-1 in have):
        return have
    fs, where = FileSystem.from_uri(local_uri(path))
    by: dict[int, list[dict]] = {}
    if shard is not None:  # only the folder of this shard is listed
        where = f"{where}/shard={shard}"
        by = {shard: ds.dataset(where, filesystem=fs, format="parquet").to_table().to_pylist()} if fs.get_file_info(where).type else {}
    else:
        found = ds.dataset(where, filesystem=fs, format="parquet", partitioning=ds.partitioning(pa.schema([("shard", pa.int32())]), flavor="hive"))
        for row in found.to_table().to_pylist():
            by.setdefault(row["shard"], []).append(row)
    made: dict[int, Cascade] = {}
    for s, rows in by.items():
        rows.sort(key=lambda r: r["level"])
        rest = np.frombuffer(rows[0]["data"], np.uint64).reshape(-1, 2)
        made[s] = Cascade([Bloom(r["level"], r["hashes"], r["bits"], np.frombuffer(r["data"], np.uint8)) for r in rows[1:]], rest)
    made[-1 if shard is None else shard] = made.get(shard, Cascade([], np.zeros((0, 2), np.uint64)))
    _loaded.clear()
    _loaded[path] = made
    return made


def contains(rows: DataFrame, key: str, built: tuple[str, int, int], name: str = "listed", worker_bytes: int = WORKER_BYTES) -> DataFrame:
    """rows and whether their key is listed, exact for keys of the universe; false for a null key. Up
    to worker_bytes of cascades, rows stay where they are; beyond, each goes to the shard of its key."""
    path, shards, size = built
    a, b = _hashes(F.col(f"`{key}`"))

    def look(a: pa.Array, b: pa.Array, shard: pa.Array) -> pa.Array:
        keys = np.stack([x.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64) for x in (a, b)], 1)
        at, out = shard.to_numpy(zero_copy_only=False), np.zeros(len(keys), bool)
        for s in np.unique(at).tolist():
            if s >= 0:
                found = _load(path, None if size <= worker_bytes else s).get(s)
                if found is not None:
                    out[at == s] = found.has(keys[at == s])
        return pa.array(out)

    shard = F.when(F.col(f"`{key}`").isNull(), F.lit(-1)).otherwise(_shard_of(a, shards))
    if size > worker_bytes:
        spread = F.when(F.col(f"`{key}`").isNull(), F.pmod(F.spark_partition_id(), F.lit(shards))).otherwise(shard)
        rows = rows.repartition(shards, spread)
    return rows.withColumn(name, F.arrow_udf(look, "boolean")(a, b, shard))


def filter_urls(pages: DataFrame, listed_keys: DataFrame | None = None, hosts: list[str] | None = None, url: str = "url", shard_keys: int = SHARD_KEYS, worker_bytes: int = WORKER_BYTES) -> DataFrame:
    """pages with url_key and listed: whether the key is one of listed_keys (a column of that name) or on
    one of the hosts or a part of one. The cascade is built over all keys of pages and the list, so
    every answer is exact. A null or empty URL has a null key and isn't listed; repeated rows stay; a
    column of pages with a new one's name stays and the new one gets a trailing underscore."""
    key, flag = free_name(pages, "url_key"), free_name(pages, "listed")
    rows = pages.withColumn(key, url_key(F.col(f"`{url}`")))
    host = F.regexp_extract(F.col("k"), r"^[^/]*", 0)
    on_host = F.lit(False)
    for h in hosts or []:
        on_host |= (host == h) | host.endswith("." + h)
    universe = rows.select(F.col(f"`{key}`").alias("k")).select("k", on_host.alias("listed"))
    if listed_keys is not None:
        universe = universe.unionAll(listed_keys.select(F.col("url_key").alias("k"), F.lit(True)))
    return contains(rows, key, build(universe, "k", F.col("listed"), shard_keys), flag, worker_bytes)
