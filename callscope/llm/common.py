"""Shared pieces: Arrow batches, word hashes, shared scratch tables."""

from __future__ import annotations

import atexit
import re
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of characters other than ASCII controls, space and punctuation, lower-cased.
DELIMS = bytes(b for b in range(128) if not (48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122))
_TO_SPACE = bytes(32 if b in DELIMS else b for b in range(256))
#: The same words in DuckDB SQL, given a column of text.
WORDS_SQL = r"regexp_extract_all(lower({0}), '[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+')"
MEMO_LIMIT = 100_000
BATCH_BYTES = 8 << 20  # of rows that go to Python at once, at most; a longer row goes alone


class _WordHash(dict):
    """Word -> 64-bit hash; emptied when full, so that its memory is bounded."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMO_LIMIT:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


_HASHES = _WordHash()


def words(text: str | None) -> list[bytes]:
    return (text or "").lower().encode("utf-8", "replace").translate(_TO_SPACE).split()


def word_hashes(texts: Iterable[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Flat hashes of all words, and the offsets of each text in them (one more than texts)."""
    parts, sizes = [], [0]
    get = _HASHES.__getitem__
    for t in texts:
        w = words(t)
        parts.append(np.fromiter(map(get, w), np.uint64, len(w)))
        sizes.append(len(w))
    return (np.concatenate(parts) if parts else np.empty(0, np.uint64)), np.cumsum(np.array(sizes, np.int64))


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    h = h ^ (h >> np.uint64(33))
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


def kgrams(h: np.ndarray, off: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the k words from each place, and the places (flat indices) where k words of one text are left."""
    n = len(h) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    g = h[:n].copy()
    for i in range(1, k):
        g *= np.uint64(0x9E3779B97F4A7C15)
        g ^= h[i : i + n]
        g = (g << np.uint64(23)) | (g >> np.uint64(41))
    g = mix(g)
    ok = np.ones(n, bool)
    for i in range(1, k):  # places whose gram would run over the end of a text
        bad = off[1:-1] - i
        ok[bad[(bad >= 0) & (bad < n)]] = False
    at = np.flatnonzero(ok)
    return g[at], at


def small_batches(batches: Iterable[pa.RecordBatch], column: str = "text", limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about limit bytes of the column, so that no worker holds much at once."""
    for b in batches:
        c = b.column(b.schema.get_field_index(column))
        size = np.array(pc.binary_length(c).fill_null(0), np.int64) + 16
        cut = np.flatnonzero(np.diff(np.cumsum(size) // limit)) + 1
        edges = [0, *cut.tolist(), b.num_rows]
        for a, z in zip(edges, edges[1:]):
            if z > a:
                yield b.slice(a, z - a)


def by_length(batches: Iterable[pa.RecordBatch], column: str = "text", limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The same as small_batches, each batch's rows in the order of their length: texts of like length come together."""
    for b in batches:
        size = pc.fill_null(pc.binary_length(b.column(b.schema.get_field_index(column))), 0)
        order = pc.array_sort_indices(size)
        total = np.cumsum(np.array(size.take(order), np.int64) + 16)
        edges = [0, *(np.flatnonzero(np.diff(total // limit)) + 1).tolist(), b.num_rows]
        for a, z in zip(edges, edges[1:]):
            if z > a:
                yield b.take(order[a:z])


def column(batch: pa.RecordBatch, name: str) -> list:
    return batch.column(batch.schema.get_field_index(name)).to_pylist()


def binary_array(flat: np.ndarray, off: np.ndarray) -> pa.Array:
    """Slices of a flat array as a column of binary."""
    data = np.ascontiguousarray(flat).view(np.uint8)
    o = np.asarray(off, np.int64) * flat.dtype.itemsize
    if o[-1] < 2**31:
        return pa.Array.from_buffers(pa.binary(), len(o) - 1, [None, pa.py_buffer(o.astype(np.int32)), pa.py_buffer(data)])
    raw = data.tobytes()
    return pa.array([raw[a:z] for a, z in zip(o, o[1:])], pa.binary())


_MADE: dict[str, SparkSession] = {}


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder that all executors share, spark.checkpoint.dir.

    Where that is unset, a session of one process takes a folder of its own beside its tables; on a cluster it is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"
    path = f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"
    _MADE[path] = spark
    return path


def kept(spark: SparkSession, name: str) -> str:
    """The same for a table that is part of a result: it isn't deleted."""
    path = scratch(spark, name)
    del _MADE[path]
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows, written to the shared folder and read again: cuts the lineage and survives lost executors.

    The shuffle files of the query that writes go as it ends; discard() drops what is no longer read.
    """
    spark, path, key = df.sparkSession, scratch(df.sparkSession, name), "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(key, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def _remove(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def discard(*tables: DataFrame) -> None:
    """Delete scratch tables that nothing will read any more."""
    for t in tables:
        if (path := getattr(t, "_scratch", None)) and (spark := _MADE.pop(path, None)):
            _remove(spark, path)


@atexit.register
def _leave() -> None:
    """What results may still have been read from goes with the driver, if its session is still there."""
    for path, spark in list(_MADE.items()):
        if spark.sparkContext._jsc is not None:
            _remove(spark, path)


def place(df: DataFrame, name: str) -> int | None:
    """Where a column is: the first of that very name, else the first that differs in case only."""
    same = [i for i, c in enumerate(df.columns) if c == name] or [i for i, c in enumerate(df.columns) if c.lower() == name.lower()]
    return same[0] if same else None


def lean(spark: SparkSession) -> None:
    """Bound the bytes of an Arrow batch in this session: by rows alone, a batch of long texts takes memory in the JVM and in Python."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(key)
    if not re.fullmatch(r"\d+b?", now) or int(now.rstrip("b")) > BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def flat(df: DataFrame) -> DataFrame:
    """The same rows with columns c0, c1 and so on: names that clash or hold dots are no matter; toDF brings them back."""
    lean(df.sparkSession)
    return df.toDF(*[f"c{i}" for i in range(len(df.columns))])


def pick(df: DataFrame, **types: str) -> DataFrame:
    """Only the named columns, in the named types; a column that is missing is null. Of columns that clash see place()."""
    at = {n: place(df, n) for n in types}
    return flat(df).select(*[(F.lit(None) if at[n] is None else F.col(f"c{at[n]}")).cast(t).alias(n) for n, t in types.items()])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sample_ids(df: DataFrame, n: int, salt: int = 7) -> list[int]:
    """n ids of rows, the same at every run: those of the smallest hashes."""
    return [r[0] for r in df.orderBy(F.xxhash64("doc_id", F.lit(salt)), "doc_id").limit(n).select("doc_id").collect()]


Rows = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]
