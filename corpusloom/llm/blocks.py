"""Text blocks: Arrow string batches viewed as bytes, cut and hashed with numpy.

Every operator here that runs in Python works on blocks of a few hundred kilobytes of UTF-8 (one row at
least, however long), so memory follows the block and not the batch.  A null text is an empty text.
"""

from __future__ import annotations

import ctypes
import os
import re
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

U = np.uint64
_libc = ctypes.CDLL(None)
BLOCK_BYTES = 1 << 19
_BASE = U(0x9E3779B97F4A7C15)
_INVERSE = U(pow(int(_BASE), -1, 1 << 64))
_KEPT = 1 << 20
_powers = [np.ones(1, U), np.ones(1, U)]
#: One fixed random number for each byte value: a polynomial over these is hard to hit by chance.
BYTE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=U) * U(2) + U(1)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes of words that end at white space, and of words of letters, digits and anything beyond ASCII.
SOLID = np.ones(256, bool)
SOLID[[9, 10, 11, 12, 13, 32]] = False
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[97:123] = ALNUM[128:] = True


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit hashes (multiply and shift)."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse, modulo 2^64; no more than ``_KEPT`` are held between calls."""
    if len(_powers[0]) >= n:
        return _powers[0][:n], _powers[1][:n]
    own = []
    for b in (_BASE, _INVERSE):
        p = np.full(max(n, _KEPT), b, U)
        p[0] = 1
        own.append(np.multiply.accumulate(p))
    _powers[:] = [p[:_KEPT].copy() if len(p) > _KEPT else p for p in own]
    return own[0][:n], own[1][:n]


def inverse_powers(n: int) -> np.ndarray:
    """What makes the difference of two prefix sums the same wherever its stretch begins."""
    return _power(n)[1]


def prefix_sums(values: np.ndarray) -> np.ndarray:
    """S with S[j] = sum of values[i] * base^i over i < j; ``span_hash`` reads any stretch from it."""
    out = np.zeros(len(values) + 1, U)
    np.cumsum(values * _power(len(values))[0], out=out[1:])
    return out


def span_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of each stretch [start, end), the same wherever it stands."""
    return mix((sums[end] - sums[start]) * _power(len(sums))[1][start] + (end - start).astype(U) * U(0x632BE59BD9B4E019))


def gram_hash(values: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the n-grams that start at each value; the last n - 1 have none."""
    if len(values) < n:
        return np.zeros(0, U)
    i = np.arange(len(values) - n + 1)
    return span_hash(prefix_sums(values), i, i + n)


class Block:
    """Some rows' texts as one byte array; ``off`` has a row's first byte and, at the end, the length."""

    def __init__(self, texts: pa.Array, lower: bool = False):
        texts = texts.cast(pa.large_string()).fill_null("")
        off = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, 8 * texts.offset)
        data = texts.buffers()[2]
        raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None and off[-1] > off[0] else np.zeros(0, np.uint8)
        self.off = off - off[0]
        self.buf = LOWER[raw] if lower else raw
        self.rows = len(texts)

    def words(self, kind: np.ndarray = SOLID) -> None:
        """Sets start, end (bytes) and row of each word, and ``first``: each row's first word and the total."""
        flag = kind[self.buf]
        edge = np.zeros(len(flag) + 1, bool)
        edge[self.off] = True
        before = np.concatenate([[False], flag[:-1]]) if len(flag) else flag
        after = np.concatenate([flag[1:], [False]]) if len(flag) else flag
        self.start = np.flatnonzero(flag & (~before | edge[:-1]))
        self.end = np.flatnonzero(flag & (~after | edge[1:])) + 1
        self.first = np.searchsorted(self.start, self.off)
        self.row = np.repeat(np.arange(self.rows), np.diff(self.first))

    def word_hashes(self) -> np.ndarray:
        return span_hash(prefix_sums(BYTE[self.buf]), self.start, self.end) if len(self.start) else np.zeros(0, U)

    def grams(self, hashes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(index of the first word, hash) of each n-gram that lies in one row."""
        g = gram_hash(hashes, n)
        at = np.flatnonzero(self.row[: len(g)] == self.row[n - 1 : n - 1 + len(g)]) if len(g) else np.zeros(0, np.int64)
        return at, g[at]

    def text(self, row: int) -> bytes:
        return self.buf[self.off[row] : self.off[row + 1]].tobytes()

    def cut(self, i: int, j: int) -> bytes:
        """Words i to j - 1, joined by a blank."""
        return b" ".join(self.buf[a:b].tobytes() for a, b in zip(self.start[i:j], self.end[i:j], strict=True))


def pieces(texts: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about ``limit`` bytes of text, one row at least."""
    size = texts.cast(pa.large_string()).fill_null("")
    off = np.frombuffer(size.buffers()[1], np.int64, len(size) + 1, 8 * size.offset)
    i = 0
    while i < len(size):
        j = max(i + 1, int(np.searchsorted(off, off[i] + limit, "right")) - 1)
        yield i, j
        i = j


def starts(counts: np.ndarray) -> np.ndarray:
    """Offsets of lists with these lengths."""
    return np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)


def lists(values: pa.Array | np.ndarray, counts: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(starts(counts).astype(np.int32)), pa.array(values))


def tidy() -> None:
    """Give freed memory back, so that a Python worker between tasks holds little."""
    pa.default_memory_pool().release_unused()
    if hasattr(_libc, "malloc_trim"):
        _libc.malloc_trim(0)


def reach(spark) -> None:
    """Let Python workers on this machine find the package; a cluster gets it by --py-files or its image."""
    env, root = spark.sparkContext.environment, str(Path(__file__).resolve().parents[2])
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [env.get("PYTHONPATH"), root]))


def gather(values: np.ndarray, begin: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The stretches [begin, begin + count) of ``values``, one after the other."""
    shift = np.repeat(begin - starts(count)[:-1], count)
    return values[np.arange(len(shift)) + shift]


def map_blocks(df: DataFrame, text: str, keep: list[str], fields: T.StructType, fn: Callable, limit: int = BLOCK_BYTES) -> DataFrame:
    """``keep`` columns of each row and the ``fields`` that ``fn(texts)`` returns as one Arrow array each.

    ``fn`` gets the texts of one block.  A kept column named like a field gives way to the field.
    """
    keep = [c for c in keep if c not in fields.names]
    source = df.select(*(df[c] for c in dict.fromkeys([*keep, text])))
    schema = T.StructType([*(source.schema[c] for c in keep), *fields.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(text)
            for i, j in pieces(texts, limit):
                yield pa.RecordBatch.from_arrays([*(b.column(c).slice(i, j - i) for c in keep), *fn(texts.slice(i, j - i))], names=schema.names)
        tidy()

    reach(df.sparkSession)
    return source.mapInArrow(run, schema)


def explode_blocks(df: DataFrame, text: str, keep: list[str], schema: T.StructType, fn: Callable, limit: int = BLOCK_BYTES) -> DataFrame:
    """Rows of ``schema`` that ``fn(texts, *kept columns)`` returns as a list of Arrow arrays, block by block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(text)
            for i, j in pieces(texts, limit):
                out = fn(texts.slice(i, j - i), *(b.column(c).slice(i, j - i) for c in keep))
                if out is not None and len(out[0]):
                    yield pa.RecordBatch.from_arrays(out, names=schema.names)
        tidy()

    reach(df.sparkSession)
    return df.select(*(df[c] for c in dict.fromkeys([*keep, text]))).mapInArrow(run, schema)


def shared_folder(spark) -> str:
    """The folder that all executors share, as the session names it; one of our own only where a single machine is all there is."""
    import tempfile

    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    return tempfile.mkdtemp(prefix="corpusloom")


def remove_folder(spark, path: str) -> None:
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` with its lineage cut, in the session's shared folder."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()
