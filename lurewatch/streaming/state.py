"""Keyed state as a log of deltas: a batch writes what it adds, never what was there before.

Batch n writes one segment, s=n-n, of its own partial aggregates. After every FAN segments of one size they are merged into one of the
next size (s=0-7, s=0-63, ...), so a row is rewritten once per level, and reading meets few segments. What a segment holds is a
function of its batches: a replay overwrites its own segment with the same rows. Rows are filed under a fixed number of hash
buckets of the key, so a lookup of a batch's keys reads the buckets that they fall in.

Segments that a wider one covers are deleted one batch later, when no replay can ask for them. A batch that finds an earlier one
missing fails; it never starts over.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FAN, BUCKETS = 8, 32


class DeltaState:
    """`merge` folds rows of equal keys into one; it must not care how rows were split into segments."""

    def __init__(self, path: str, schema: str, keys: list[str], merge: Callable[[DataFrame], DataFrame], fan: int = FAN, buckets: int = BUCKETS) -> None:
        self.path, self.schema, self.keys, self.merge, self.fan, self.buckets = path, schema, keys, merge, fan, buckets

    def _fs(self, spark: SparkSession, name: str = ""):
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)  # noqa: SLF001
        return path.getFileSystem(spark._jsc.hadoopConfiguration()), path  # noqa: SLF001

    def segments(self, spark: SparkSession) -> list[tuple[int, int]]:
        """All committed segments (first, last batch)."""
        fs, root = self._fs(spark)
        names = [f.getPath().getName() for f in fs.listStatus(root)] if fs.exists(root) else []
        found = [tuple(map(int, m.groups())) for m in map(re.compile(r"s=(\d+)-(\d+)").fullmatch, names) if m]
        return sorted(s for s in found if fs.exists(self._fs(spark, f"s={s[0]}-{s[1]}/_SUCCESS")[1]))

    def cover(self, spark: SparkSession, first: int, last: int) -> list[tuple[int, int]]:
        """Segments that hold batches first..last once each, the widest ones."""
        have, out, at = self.segments(spark), [], first
        while at <= last:
            widest = max((s for s in have if s[0] == at and s[1] <= last), key=lambda s: s[1], default=None)
            if widest is None:
                raise RuntimeError(f"batch {at} is missing in {self.path}")
            out.append(widest)
            at = widest[1] + 1
        return out

    def _read(self, spark: SparkSession, parts: list[tuple[int, int]], buckets: list[int] | None = None) -> DataFrame:
        df = spark.createDataFrame([], self.schema)
        for a, b in parts:
            one = spark.read.schema(f"{self.schema}, bucket int").parquet(f"{self.path}/s={a}-{b}")
            df = df.unionByName((one if buckets is None else one.where(F.col("bucket").isin(buckets))).drop("bucket"))
        return df

    def _bucket(self):
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def read(self, spark: SparkSession, before: int | None = None) -> DataFrame:
        """The whole state, or as it was before a batch."""
        last = max((s[1] for s in self.segments(spark)), default=-1) if before is None else before - 1
        return self.merge(self._read(spark, self.cover(spark, 0, last)))

    def lookup(self, asked: DataFrame, before: int) -> DataFrame:
        """State rows of the asked keys as they were before a batch, from the buckets that hold any of them."""
        spark, asked = asked.sparkSession, asked.select(*self.keys).distinct()
        buckets = [r[0] for r in asked.select(self._bucket()).distinct().collect()]  # at most `buckets` numbers
        return self.merge(self._read(spark, self.cover(spark, 0, before - 1), buckets).join(asked, self.keys, "left_semi"))

    def _write(self, df: DataFrame, a: int, b: int) -> None:
        cols = [c.split()[0] for c in self.schema.split(", ")]
        df.select(*cols).withColumn("bucket", self._bucket()).write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/s={a}-{b}")

    def append(self, delta: DataFrame, n: int) -> None:
        """Commit what batch n adds, then merge segments that are due."""
        spark = delta.sparkSession
        self._forget(spark, n)
        self.cover(spark, 0, n - 1)
        self._write(delta, n, n)
        size = self.fan
        while (n + 1) % size == 0:
            first, step = n + 1 - size, size // self.fan
            parts = [(a, a + step - 1) for a in range(first, n + 1, step)]
            self._write(self.merge(self._read(spark, parts)), first, n)
            size *= self.fan

    def _forget(self, spark: SparkSession, n: int) -> None:
        have = self.segments(spark)
        for a, b in have:
            if any(x <= a and b <= y < n and (x, y) != (a, b) for x, y in have):
                fs, path = self._fs(spark, f"s={a}-{b}")
                fs.delete(path, True)
