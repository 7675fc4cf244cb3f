"""Shared helpers: bounded text chunks, words of a byte buffer, and 64-bit fingerprints, all as numpy columns.

Fingerprints are sums of per-byte (or per-word) random values times powers of an odd base, modulo 2^64, taken from a
prefix sum and then mixed. Equal content gives equal fingerprints in every task; two independent bases give 128 bits.
"""

from __future__ import annotations

import tempfile
import zipfile
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows are worked on in slices of about this many text bytes, so that memory follows the slice and not the batch.
CHUNK_BYTES = 4 << 20

#: Most bytes of an Arrow batch that is sent to a worker (one row may exceed it).
BATCH_BYTES = 8 << 20
_BATCH_CONF = "spark.sql.execution.arrow.maxBytesPerBatch"

#: The word class of the contracts: everything but space, tab, line feed, vertical tab, form feed, carriage return.
WORD = r"[^\x20\x09-\x0D]+"
SPACES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)

U64 = np.uint64
BASES = (U64(0x9E3779B97F4A7C15), U64(0xC2B2AE3D27D4EB4F))


def _inverse(base: np.uint64) -> np.uint64:
    return U64(pow(int(base), -1, 1 << 64))


class Powers:
    """Powers of an odd base and of its inverse, grown on demand and kept by the worker."""

    def __init__(self, base: np.uint64) -> None:
        self.base, self.inv, self.up, self.down = base, _inverse(base), np.ones(1, U64), np.ones(1, U64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up))
            with np.errstate(over="ignore"):
                self.up = np.concatenate(([U64(1)], np.cumprod(np.full(size - 1, self.base, U64))))
                self.down = np.concatenate(([U64(1)], np.cumprod(np.full(size - 1, self.inv, U64))))
        return self.up, self.down


POWERS = tuple(Powers(b) for b in BASES)
_RNG = np.random.Generator(np.random.PCG64(20240229))
#: A random 64-bit value per byte, for each of the two fingerprints.
BYTE_VALUES = tuple(_RNG.integers(1, 1 << 63, 256, dtype=np.uint64) * U64(2) + U64(1) for _ in BASES)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (splitmix)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


class Ranges:
    """Fingerprints of any ranges [s, e) of a sequence of 64-bit values, after one prefix sum."""

    def __init__(self, values: np.ndarray, which: int = 0) -> None:
        self.up, down = POWERS[which].get(len(values) + 1)
        self.sums = np.zeros(len(values) + 1, U64)
        with np.errstate(over="ignore"):
            np.cumsum(values * down[: len(values)], out=self.sums[1:])

    def of(self, s: np.ndarray, e: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mix((self.sums[e] - self.sums[s]) * self.up[s] + (e - s).astype(U64))


def chunks(texts: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges [a, b) of at most `limit` text bytes each; a longer single text is a range of its own."""
    if not len(texts):
        return
    sizes = np.asarray(pc.fill_null(pc.binary_length(texts), 0), dtype=np.int64)
    ends, a = np.cumsum(sizes), 0
    while a < len(sizes):
        base = ends[a - 1] if a else 0
        b = max(a + 1, int(np.searchsorted(ends, base + limit, "right")))
        yield a, b
        a = b


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string array without copying the texts; a null is an empty text."""
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, offs, data = texts.buffers()
    offsets = np.frombuffer(offs, np.int64 if wide else np.int32)[texts.offset: texts.offset + len(texts) + 1].astype(np.int64) if offs else np.zeros(1, np.int64)
    body = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return body[offsets[0]: offsets[-1]], offsets - offsets[0]


_IS_WORD = np.ones(256, bool)
_IS_WORD[list(SPACES)] = False


class Words:
    """The words of a slice of texts: byte starts and ends, and `first`, where each text's words begin."""

    def __init__(self, buf: np.ndarray, offsets: np.ndarray, is_word: np.ndarray = _IS_WORD) -> None:
        self.buf = buf
        inside = is_word[buf]
        starts, ends = inside.copy(), inside.copy()
        starts[1:] &= ~inside[:-1]
        ends[:-1] &= ~inside[1:]
        cut = offsets[1:-1]
        cut = cut[(cut > 0) & (cut < len(buf))]
        starts[cut], ends[cut - 1] = inside[cut], inside[cut - 1]
        self.start, self.end = np.flatnonzero(starts), np.flatnonzero(ends) + 1
        self.first = np.searchsorted(self.start, offsets)

    def names(self, which: int = 0) -> np.ndarray:
        """A 64-bit name per word, equal for equal words."""
        return Ranges(BYTE_VALUES[which][self.buf], which).of(self.start, self.end)

    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


_SHIPPED: set[str] = set()


def ship(spark) -> None:
    """Give every Python worker this package, wherever the executors run: one small zip per application. Batches that go to
    workers are bounded in bytes, unless the cluster has its own bound: they are held in the JVM and in the worker at once."""
    sc = spark.sparkContext
    if _BATCH_CONF not in spark.conf.getAll:
        spark.conf.set(_BATCH_CONF, str(BATCH_BYTES))
    if sc.applicationId in _SHIPPED:
        return
    root = Path(__file__).resolve().parents[2]
    path = Path(tempfile.mkdtemp()) / "lurewatch_workers.zip"
    with zipfile.ZipFile(path, "w") as z:
        for p in sorted((root / "lurewatch").rglob("*.py")):
            z.write(p, p.relative_to(root))
    sc.addPyFile(str(path))
    _SHIPPED.add(sc.applicationId)


def batches(df: DataFrame, fn, schema: str, limit: int = CHUNK_BYTES) -> DataFrame:
    """mapInArrow over whole-slice work: fn(RecordBatch) -> RecordBatch for slices of about `limit` bytes of `text`."""
    ship(df.sparkSession)

    def run(it):
        for batch in it:
            texts = batch.column(batch.schema.names.index("text"))
            for a, b in chunks(texts, limit):
                out = fn(batch.slice(a, b - a))
                if out is not None and out.num_rows:
                    yield out

    return df.mapInArrow(run, schema)


def table(path: str, name: str, spark) -> DataFrame:
    return spark.read.parquet(f"{path}/{name}.parquet")


def n_words(text: Column) -> Column:
    """Words of a text (0 for null), in the JVM."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")
