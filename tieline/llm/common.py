"""Helpers shared by the corpus operators: reading tables, checkpoints, Arrow column access, word hashing."""

from __future__ import annotations

import gc
import tempfile
import time
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one NumPy pass handles; bounds a worker's memory whatever the batch size.
CHUNK_BYTES = 1 << 20

_U = np.uint64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which all executors share. Only a local session without one gets a folder of its own."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="tieline-ckpt-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder, compressed and by column, and continue from there; ``drop`` removes it again."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/cut-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    out = spark.read.schema(df.schema).parquet(path)
    out._cut_path = path
    return out


def drop(*cuts: DataFrame) -> None:
    """Remove tables of ``cut`` that nothing reads any more, and let Spark remove the shuffle files of plans that are gone."""
    for df in cuts:
        spark = df.sparkSession
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(df._cut_path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    if cuts:
        sweep(cuts[0].sparkSession)


#: Seconds between two sweeps, at least: small jobs drop many tables in a second.
SWEEP_EVERY = 3.0
_swept = [0.0]


def sweep(spark: SparkSession) -> None:
    """Shuffle files go when the driver's plans that made them are collected; see to it now, not when its heap is full."""
    if time.monotonic() - _swept[0] >= SWEEP_EVERY:
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        _swept[0] = time.monotonic()


#: Rows of a narrow table (ids and numbers) up to which it may be broadcast: some tens of MB.
BROADCAST_ROWS = 1_000_000


def small_side(df: DataFrame) -> DataFrame:
    """``df``, marked for broadcast if it is counted to be small; else left to a shuffled join. ``df`` should be cut before."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def hash_udf_free_key(*cols: str):
    """64-bit key over columns; null-safe because xxhash64 skips nulls, so null flags are added."""
    return F.xxhash64(*[x for c in cols for x in (F.col(c), F.col(c).isNull())])


# ---------------------------------------------------------------- Arrow text

def text_buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string array; a null counts as an empty text."""
    col = col.cast(pa.large_string()).fill_null("")
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    _, off, data = col.buffers()
    offsets = np.frombuffer(off, np.int64)[col.offset: col.offset + len(col) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0]: offsets[-1]] if len(offsets) else raw, offsets - (offsets[0] if len(offsets) else 0)


def doc_chunks(offsets: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges [i, j) of rows with about ``limit`` bytes each; a longer text is a range of its own."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, j
        i = j


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Word bytes: everything but ASCII white space (words ``[^\x20\x09-\x0D]+``).
NON_SPACE = np.ones(256, bool)
NON_SPACE[[0x20, *range(0x09, 0x0E)]] = False

#: Word bytes after lower-casing: digits, a-z and every byte of a non-ASCII character.
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor, shift and multiply)."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _U(0x9E3779B97F4A7C15))
_BASE = 0xD6E8FEB86659FD93
_INV = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        p = np.full(max(n, CHUNK_BYTES + 1), base, np.uint64)
        p[0] = 1
        have = _powers[base] = np.cumprod(p)
    return have


def word_spans(low: np.ndarray, offsets: np.ndarray, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte starts and ends of the words of texts laid end to end; no word crosses a text's border."""
    mask = keep[low]
    first, last = mask.copy(), mask.copy()
    first[1:] &= ~mask[:-1]
    last[:-1] &= ~mask[1:]
    begin = offsets[:-1][offsets[:-1] < len(low)]
    first[begin] = mask[begin]
    stop = offsets[1:][offsets[1:] > 0] - 1
    last[stop] = mask[stop]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def word_hashes(low: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes: a polynomial over random byte values, then a finaliser."""
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        base = starts[i]
        j = max(i + 1, int(np.searchsorted(ends, base + CHUNK_BYTES, "right")))
        span = low[base: ends[j - 1]]
        run = np.zeros(len(span) + 1, np.uint64)
        np.cumsum(_BYTE[span] * _power(_BASE, len(span))[: len(span)], out=run[1:])
        s, e = starts[i:j] - base, ends[i:j] - base
        out[i:j] = mix((run[e] - run[s]) * _power(_INV, len(span) + 1)[s] + (e - s).astype(np.uint64))
        i = j
    return out


def hashed_words(raw: np.ndarray, offsets: np.ndarray, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of a chunk of texts and, for each text, where its words begin (len + 1 entries)."""
    low = LOWER[raw]
    starts, ends = word_spans(low, offsets, keep)
    return word_hashes(low, starts, ends), np.searchsorted(starts, offsets)


_STEP = mix(np.arange(101, 165, dtype=np.uint64) * _U(0x9E3779B97F4A7C15)) | _U(1)


def windows(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hash of each run of ``width`` consecutive word hashes; empty when there are fewer."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.zeros(n, np.uint64)
    for k in range(width):
        total += hashes[k: k + n] * _STEP[k]
    return mix(total + _U(width))


def shingle_set(hashes: np.ndarray, width: int = 5) -> np.ndarray:
    """Sorted distinct shingles; a shorter non-empty sequence is one shingle as a whole."""
    if 0 < len(hashes) < width:
        return windows(hashes, len(hashes))
    return np.unique(windows(hashes, width))


def as_long(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
