"""Shared pieces of the training-data operators: shared storage, Arrow access, hashing."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Word separators of the contracts: space, and tab to carriage return.
SPACES = " \\x09-\\x0D"
U64 = np.uint64
_MASK = (1 << 64) - 1


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``. A local one is set only where it is unset and one machine runs
    everything; elsewhere a missing setting raises."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        where = "/tmp/checkpoints"
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def fresh_dir(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; it goes when the session's JVM ends."""
    where = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(where)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(path)
    fs.deleteOnExit(path)
    return fs.makeQualified(path).toString()


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write to the shared folder as Parquet and read back."""
    spark = df.sparkSession
    where = fresh_dir(spark, name)
    df.write.mode("overwrite").option("compression", "zstd").parquet(where)
    return spark.read.schema(df.schema).parquet(where)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def block_count(spark: SparkSession, n_bytes: int, block_bytes: int = 256 << 20) -> int:
    """Into how many blocks a corpus goes that workers hold whole: four a shuffle partition, more where these are too large."""
    return max(4 * shuffle_partitions(spark), -(-n_bytes // block_bytes))


def words_column(text):
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text as an array, JVM-side; null or blank gives an empty array."""
    flat = F.trim(F.coalesce(text, F.lit("")), F.lit(" \t\n\x0b\x0c\r"))
    return F.when(flat == "", F.array().cast("array<string>")).otherwise(F.split(flat, "[ \\x09-\\x0D]+"))


def word_count(text):
    """Number of words without building them: separators inside the trimmed text plus one."""
    flat = F.regexp_replace(F.coalesce(text, F.lit("")), "[^ \\x09-\\x0D]+", "x")
    return F.length(F.regexp_replace(flat, "[ \\x09-\\x0D]+", "")).cast("long")


# ---------------------------------------------------------------- Arrow


def utf8(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts of an Arrow string column, and n + 1 offsets; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    if column.null_count:
        column = column.fill_null("" if not pa.types.is_binary(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    kind = np.int64 if wide else np.int32
    _, offs, data = column.buffers()
    offs = np.frombuffer(offs, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offs[0] : offs[-1]], offs - offs[0]


def chunks(offs: np.ndarray, size: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about ``size`` bytes; a longer text stands alone."""
    at, n = 0, len(offs) - 1
    while at < n:
        end = int(np.searchsorted(offs, offs[at] + size, "right")) - 1
        end = min(max(end, at + 1), n)
        yield at, end
        at = end


# ---------------------------------------------------------------- hashing


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def table(seed: int, fold: bool = False) -> np.ndarray:
    """256 random words made by rule from a seed; fold: A-Z get those of a-z."""
    with np.errstate(over="ignore"):
        t = mix(np.arange(1, 257, dtype=U64) * U64(0x9E3779B97F4A7C15) + U64(seed * 0xD1342543DE82EF95 & _MASK))
    if fold:
        t[65:91] = t[97:123]
    return t


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, U64)
    out[:1] = 1
    return np.multiply.accumulate(out)


_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[32, 9, 10, 11, 12, 13]] = True
_WORD_TABLE = table(11, fold=True)
_WORD_BASE = 0x9E3779B97F4A7C15 | 1
_WORD_POW = powers(_WORD_BASE, 4096)


def word_hashes(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words, A-Z lower-cased, and the n + 1 offsets of each text's words."""
    global _WORD_POW
    n = len(offs) - 1
    solid = ~_IS_SPACE[data]
    first = np.empty(len(data), bool)
    if len(data):
        first[0] = True
        np.logical_not(solid[:-1], out=first[1:])
        starts = offs[:-1]
        first[starts[starts < len(data)]] = True
        first &= solid
    at = np.flatnonzero(first)
    bounds = np.searchsorted(at, offs)
    if not len(at):
        return np.zeros(0, U64), np.zeros(n + 1, np.int64)
    body = data[solid]
    begin = (np.cumsum(solid) - 1)[at]
    lens = np.diff(np.append(begin, len(body)))
    if lens.max() > len(_WORD_POW):
        _WORD_POW = powers(_WORD_BASE, int(lens.max()) * 2)
    place = np.arange(len(body)) - np.repeat(begin, lens)
    h = np.add.reduceat(_WORD_TABLE[body] * _WORD_POW[place], begin)
    return mix(h + lens.astype(U64) * U64(0xC2B2AE3D27D4EB4F)), bounds


def zbytes(array: np.ndarray) -> bytes:
    """A compact copy: each byte plane apart, so high zero bytes vanish."""
    import zstandard

    flat = np.ascontiguousarray(array)
    planes = flat.view(np.uint8).reshape(len(flat), flat.dtype.itemsize).T if len(flat) else flat.view(np.uint8)
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).tobytes())


def unzbytes(raw: bytes, dtype) -> np.ndarray:
    import zstandard

    flat = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8)
    size = np.dtype(dtype).itemsize
    return np.ascontiguousarray(flat.reshape(size, -1).T).reshape(-1).view(dtype) if len(flat) else np.zeros(0, dtype)
