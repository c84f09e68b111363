"""Helpers that tasks of several operators share: vectorised hashing of UTF-8 texts held in Arrow columns,
paths in the folder that all executors share, and row hygiene."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cueloom.shared import shared_path, written  # noqa: F401  (operators take them from here)

PRIME = 0x9E3779B97F4A7C15
_INVERSE = pow(PRIME, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}

#: Bytes of text that one vectorised step works on, which bounds a task's memory (a longer document is one step).
SLICE_BYTES = 1 << 21

SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def discard(table: DataFrame) -> None:
    """Removes a written table that nothing reads any more: a later one that was made from it has been written."""
    spark = table.sparkSession
    for folder in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def row_key(doc_id: str = "doc_id", text: str = "text") -> Column:
    """16 bytes that tell rows apart by id and text; equal rows have equal keys, rows that share an id only do not."""
    return F.unhex(F.md5(F.concat(F.coalesce(F.col(doc_id).cast("string"), F.lit("")), F.lit(":"), F.coalesce(F.col(text), F.lit(""))).cast("binary")))


#: A key is hot in `spread_join` if it has more than this share of the rows; so at most 1 / HOT_SHARE keys are.
HOT_SHARE = 1 / 1000
#: Bytes of hot values that are broadcast at most, and shares in which heavier ones are dealt out.
HOT_BYTES, HOT_SHARES = 8 << 20, 32


def spread_join(rows: DataFrame, values: DataFrame, keys: list[str], count: str = "_n", weight: Column | None = None) -> DataFrame:
    """Inner join of rows with values, of which each key has one, on keys; `count` in values is a key's number of rows.

    Hot keys' values (1 / HOT_SHARE of them at most) are broadcast, so that no task gets all rows of one; the others are joined by
    key. weight: bytes of a value, where it isn't a few numbers or ids; if the hot ones come to more than HOT_BYTES, each is sent
    to HOT_SHARES tasks instead, among which its rows are dealt out. Both sides should be written tables: they are read twice.
    """
    total = values.agg(F.sum(count)).head()[0] or 0
    most = max(1, int(total * HOT_SHARE))
    hot = values.filter(F.col(count) > most)
    heavy = 0 if weight is None else hot.agg(F.sum(weight)).head()[0] or 0
    rest = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti")
    if heavy > HOT_BYTES:
        shares = hot.drop(count).withColumn("_share", F.explode(F.sequence(F.lit(0), F.lit(HOT_SHARES - 1))))
        own = rows.join(F.broadcast(hot.select(*keys)), keys, "left_semi").withColumn("_share", F.pmod(F.xxhash64(*rows.columns), F.lit(HOT_SHARES)).cast("int"))
        near = own.join(shares, [*keys, "_share"]).drop("_share")
    else:
        near = rows.join(F.broadcast(hot.drop(count)), keys)
    return near.unionByName(rest.join(values.filter(F.col(count) <= most).drop(count), keys))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def mix(x: np.ndarray) -> np.ndarray:
    """Finalising permutation of 64-bit words."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int, base: int = PRIME) -> np.ndarray:
    """base**i mod 2**64 for i < n."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, SLICE_BYTES + 4096)
        made = np.full(size, base, dtype=np.uint64)
        made[0] = 1
        have = np.cumprod(made, dtype=np.uint64)
        if size <= 4 * SLICE_BYTES:
            _powers[base] = have
    return have[:n]


def prefix_sums(buf: np.ndarray) -> np.ndarray:
    """Sums of byte i times PRIME**i, from which any substring's hash follows."""
    out = np.zeros(len(buf) + 1, dtype=np.uint64)
    np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * powers(len(buf)), out=out[1:])
    return out


def span_hashes(sums: np.ndarray, start: np.ndarray, end: np.ndarray, salt: int = 0) -> np.ndarray:
    """64-bit hashes of the substrings [start, end), alike wherever they stand."""
    back = powers(len(sums), _INVERSE)
    return mix((sums[end] - sums[start]) * back[start] + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) + np.uint64(salt))


def text_slices(column: pa.Array, limit: int = SLICE_BYTES):
    """(first row, last row, bytes, offsets) of runs of rows with about `limit` bytes; a null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offs, data = column.buffers()
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(offs, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1)
        last = min(last, n)
        yield first, last, raw[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


def runs_of(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of maximal runs of True bytes that do not cross a document's edge."""
    n = len(inside)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    edge = np.zeros(n + 1, dtype=bool)
    edge[offsets] = True
    before = np.empty(n, dtype=bool)
    before[0] = False
    before[1:] = inside[:-1]
    start = np.flatnonzero(inside & (~before | edge[:n]))
    after = np.empty(n, dtype=bool)
    after[-1] = False
    after[:-1] = inside[1:]
    end = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return start, end
