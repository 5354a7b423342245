"""Shared pieces of the training-data operators: session settings, shared tables, byte kernels.

Every kernel works on a batch of whole texts held as one byte array, so that Python never loops over
characters or words. A batch is cut into blocks of a few megabytes; only a single text may be longer.
"""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters that separate words: space and tab to carriage return.
WHITE = " \t\n\x0b\x0c\r"
#: Text bytes that a kernel handles at once (a longer text is handled alone).
BLOCK = 2 << 20

_U = np.uint64


def prepare(spark: SparkSession) -> None:
    """Small Arrow batches, so that Python workers hold a few megabytes of text at a time."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))
    # Only what is marked with broadcast(), for its proven bound, is broadcast: file sizes say little about rows in memory.
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    # Shuffle files go as soon as the action that made them ends; results that are read again are written tables.
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, from ``spark.checkpoint.dir``; only on a single machine one of our own, where that is unset."""
    home = spark.conf.get("spark.checkpoint.dir", None)
    if not home:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        home = "file://" + tempfile.mkdtemp(prefix="formgrain-")
        spark.conf.set("spark.checkpoint.dir", home)
    return home.rstrip("/")


#: Application -> tables that it has written and not yet deleted.
_WRITTEN: dict[str, list[str]] = {}


def written(spark: SparkSession) -> list[str]:
    return _WRITTEN.setdefault(spark.sparkContext.applicationId, [])


def shared_path(spark: SparkSession, tag: str) -> str:
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    written(spark).append(path)
    return path


def materialise(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage in a way that survives lost executors."""
    spark = df.sparkSession
    path = shared_path(spark, tag)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession, first: int = 0, last: int | None = None) -> None:
    """Delete the intermediate tables that this application has written (of those ``written``, the range); results that read them must be saved before."""
    paths = written(spark)
    for path in paths[first:last]:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    del paths[first:last]


def row_key(docs: DataFrame, tag: str) -> tuple[DataFrame, str]:
    """``docs``, written once with a number for each row, and the name of that column, which no other column has."""
    name, taken = "row", {c.lower() for c in docs.columns}
    while name in taken:
        name += "_"
    return materialise(docs.withColumn(name, F.monotonically_increasing_id()), tag), name


def filter_rows(docs: DataFrame, text_col: str, keep) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose text ``keep`` (of a column of texts, one boolean each) keeps. Nothing is shuffled."""
    at = docs.columns.index(text_col)

    def run(batches):
        for batch in batches:
            yield batch.filter(pa.array(keep(batch.column(at)), pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_mod(column: str, n: int) -> str:
    """SQL for crc32 of an id, as text, modulo ``n``."""
    return f"crc32(cast({column} as string)) % {n}"


# ---------------------------------------------------------------------------------------------- bytes


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column, nulls as empty; no Python string is made."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    _, offsets, data = column.buffers()
    n = len(column)
    if n == 0:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, kind)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.empty(0, np.uint8)
    return raw, at - at[0]


def blocks(offsets: np.ndarray, most: int = BLOCK) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``most`` bytes each."""
    n, at = len(offsets) - 1, 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
        yield at, min(to, n)
        at = min(to, n)


def spaced(raw: np.ndarray, offsets: np.ndarray, a: int, b: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Texts ``a`` to ``b`` with one newline after each, and each text's start and end there."""
    lengths = np.diff(offsets[a : b + 1])
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    out = np.empty(int(ends[-1]) + 1 if b > a else 0, np.uint8)
    keep = np.ones(len(out), bool)
    keep[ends] = False
    out[keep] = raw[offsets[a] : offsets[b]]
    out[ends] = 10
    return out, starts, ends


# ---------------------------------------------------------------------------------------------- words

IS_SPACE = np.zeros(256, bool)
IS_SPACE[[32, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_VALUES = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.int64).astype(_U) | _U(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_POWERS: list[np.ndarray] = []


def give_back() -> None:
    """At the end of a task: memory that its arrays have left goes back to the system, as workers live on."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, BLOCK + 4096)
        for value in (_BASE, pow(_BASE, -1, 2**64)):
            p = np.full(size, value, _U)
            p[0] = 1
            _POWERS.append(np.multiply.accumulate(p))
        _POWERS[:] = _POWERS[-2:]
    return _POWERS[0], _POWERS[1]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    x = x ^ (x >> _U(33))
    x = x * _U(0xFF51AFD7ED558CCD)
    x ^= x >> _U(33)
    x *= _U(0xC4CEB9FE1A85EC53)
    x ^= x >> _U(33)
    return x


def prefix_hash(low: np.ndarray) -> np.ndarray:
    """Running polynomial sums: ``(p[j] - p[i]) * inverse[i]`` is the hash of bytes i to j."""
    up, _ = powers(len(low) + 1)
    p = np.zeros(len(low) + 1, _U)
    np.cumsum(_VALUES[low] * up[: len(low)], out=p[1:])
    return p


def range_hash(p: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    _, down = powers(len(p))
    return mix((p[b] - p[a]) * down[a])


class Words:
    """Words of a block of texts: hash, byte range, and the range of words of each text."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray, a: int, b: int, lower: bool = True):
        self.bytes, self.starts, self.ends = spaced(raw, offsets, a, b)
        low = LOWER[self.bytes] if lower else self.bytes
        space = IS_SPACE[self.bytes]
        edge = np.flatnonzero(space[1:] != space[:-1]) + 1
        if len(space) and not space[0]:
            edge = np.concatenate([[0], edge])
        self.at, self.to = edge[0::2], edge[1::2]  # the last byte is white, so edges pair up
        self.low = low
        self.hash = range_hash(prefix_hash(low), self.at, self.to) if len(edge) else np.empty(0, _U)
        self.first = np.searchsorted(self.at, self.starts)
        self.last = np.searchsorted(self.at, self.ends)


_MULT = mix(np.arange(1, 65, dtype=_U) * _U(0x9E3779B97F4A7C15)) | _U(1)


def shingle_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of ``k`` words (their order counts)."""
    n = len(words) - k + 1
    if n <= 0:
        return np.empty(0, _U)
    out = words[:n] * _MULT[0]
    for i in range(1, k):
        out += words[i : n + i] * _MULT[i]
    return mix(out)


def shingle_set(words: np.ndarray, k: int) -> np.ndarray:
    """Sorted distinct ``k``-word shingles of a text; with fewer words the whole sequence is one; without words none."""
    n = len(words)
    if n == 0:
        return np.empty(0, _U)
    if n < k:
        return shingle_hashes(words, n) ^ _U(n)
    s = np.sort(shingle_hashes(words, k))
    return s[np.concatenate([[True], s[1:] != s[:-1]])]


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
