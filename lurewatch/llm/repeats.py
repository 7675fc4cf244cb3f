"""Whole-corpus repeats of fixed-width windows, in rounds of shrinking size.

The operators say what an anchor is: for every window a place in it that depends on the window's content alone. Windows
that follow each other mostly share an anchor, so a *piece* is a run of windows with one anchor, a name (what all these
windows hold), and a fingerprint of the whole text they cover. A round is then:

1. Pieces whose name is found once hold no repeated window. They are most of a corpus and go first.
2. Equal (name, whole) met twice: all their windows are repeated, whatever the number of copies. One stands for all.
3. Names with several different wholes go to the next round, one piece of each whole.

The first round takes the anchor's name; the second cuts pieces into bands of equal distance to the anchor, named by the
text that every window of the band holds; the last compares what is left window by window. Copies fold in map-side
aggregates in every round, joins are between written tables so that AQE can split hot keys, and no group is ever
collected: only one text's own places meet in a row. Fingerprints that decide have 128 bits.

A text is known by a 64-bit hash of id and text. Rows with equal id and text share it; they repeat each other anyway, and
their places are collected as a set, so a row never holds more than the places of one of them.
"""

from __future__ import annotations

import gc
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lurewatch.llm.common import CHUNK_BYTES, batches, ship
from lurewatch.session import cut_lineage, ensure_checkpoint_dir

PIECE = "k long, name long, whole long, at int, n int, off int, open boolean"
WINDOW = "lead binary, f1 long, f2 long, k long, at int, open boolean"


def step(df: DataFrame, done: tuple = ()) -> DataFrame:
    """A written table. `done` are tables of earlier steps that nothing reads any more: they are deleted now that what
    follows from them is safe in the shared folder, and their shuffle files are let go."""
    out = cut_lineage(df)
    drop(*done)
    gc.collect()
    df.sparkSession.sparkContext._jvm.System.gc()
    return out


def drop(*tables: DataFrame) -> None:
    """Delete tables that `step` wrote, and nothing else."""
    for t in tables:
        root = ensure_checkpoint_dir(t.sparkSession)
        for folder in {f.rsplit("/", 1)[0] for f in t.inputFiles()}:
            if folder.rsplit("/", 1)[-1].startswith("cut-") and root.rstrip("/").rsplit("/", 1)[-1] in folder:
                path = t.sparkSession._jvm.org.apache.hadoop.fs.Path(folder)  # noqa: SLF001
                path.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(path, True)  # noqa: SLF001


def keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.xxhash64("doc_id", "text").alias("k"), "doc_id", F.coalesce("text", F.lit("")).alias("text"))


def signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.astype(np.uint64).view(np.int64))


def as_pieces(keys, row, name, whole, at, n, off, is_open) -> pa.RecordBatch:
    ints = [pa.array(np.asarray(x).astype(np.int32)) for x in (at, n, off)]
    return pa.RecordBatch.from_arrays([keys.take(pa.array(row)), signed(name), signed(whole), *ints, pa.array(is_open)], ["k", "name", "whole", "at", "n", "off", "open"])


def as_windows(keys, row, lead, f1, f2, at, is_open) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([lead, signed(f1), signed(f2), keys.take(pa.array(row)), pa.array(at.astype(np.int32)), pa.array(is_open)], ["lead", "f1", "f2", "k", "at", "open"])


def by_hash(windows: DataFrame) -> DataFrame:
    """The open windows whose content is met again, by hash aggregation."""
    again = step(windows.groupBy("f1", "f2").agg(F.count("*").alias("c")).where("c > 1").select("f1", "f2"))
    return windows.where("open").join(again, ["f1", "f2"], "left_semi").select("k", "at")


def by_suffix_order(windows: DataFrame) -> DataFrame:
    """The open windows whose content is met again, by sorting suffixes: sampled splitters cut the order of leading bytes
    (then fingerprints) into ranges, each range is sorted where it lies, and a suffix equal to a neighbour is repeated.
    Equal keys never lie on both sides of a splitter, so a boundary needs no second look."""
    ship(windows.sparkSession)
    ranged = windows.repartitionByRange("lead", "f1", "f2").sortWithinPartitions("lead", "f1", "f2").select("f1", "f2", "k", "at", "open")

    def neighbours(it):
        held = None
        for batch in it:
            if not batch.num_rows:
                continue
            t = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held[0], pa.Table.from_batches([batch])])
            f1, f2 = (t.column(c).to_numpy() for c in ("f1", "f2"))
            same = (f1[1:] == f1[:-1]) & (f2[1:] == f2[:-1])
            twin = np.zeros(len(f1), bool)
            twin[1:] |= same
            twin[:-1] |= same
            if held is not None:
                twin[0] |= held[1]
            take = twin & t.column("open").to_numpy()
            held = (t.slice(len(f1) - 1), bool(twin[-1]))
            out = t.slice(0, len(f1) - 1).filter(pa.array(take[:-1])).select(["k", "at"])
            yield from out.to_batches()
        if held is not None and held[1] and held[0].column("open")[0].as_py():
            yield from held[0].select(["k", "at"]).to_batches()

    return ranged.mapInArrow(neighbours, "k long, at int")


def narrowed(pieces: DataFrame) -> tuple[DataFrame, DataFrame, tuple]:
    """One round over written pieces: ((k, at, n) of windows known to repeat, the pieces to look at closer, the tables
    that these still read)."""
    shared = step(pieces.groupBy("name").agg(F.count("*").alias("c")).where("c > 1").select("name"))
    pieces = step(pieces.join(shared, "name", "left_semi"), (pieces, shared))
    wholes = step(pieces.groupBy("name", "whole").agg(F.count("*").alias("copies"), *[F.first(c).alias(c) for c in ("k", "at", "n", "off", "open")]))
    twice = step(wholes.where("copies > 1").select("name", "whole"))
    sure = step(pieces.where("open").join(twice, ["name", "whole"], "left_semi").select("k", "at", "n"), (pieces, twice))
    several = step(wholes.groupBy("name").agg(F.count("*").alias("c")).where("c > 1").select("name"))
    rest = wholes.join(several, "name", "left_semi").select("k", "at", "n", "off", (F.col("open") & (F.col("copies") == 1)).alias("open"))
    return sure, rest, (wholes, several)


def looked_at(texts: DataFrame, rest: DataFrame, read: tuple, work: Callable, schema: str, limit: int) -> DataFrame:
    """work(k, text, todo) over the texts that hold pieces, each with all of its own, as a written table."""
    todo = step(rest.groupBy("k").agg(F.collect_list(F.struct("at", "n", "off", "open")).alias("todo")), read)
    return step(batches(texts.select("k", "text").join(todo, "k"), work, schema, limit), (todo,))


def repeated_spans(texts: DataFrame, pieces: Callable, bands: Callable, windows: Callable, again: Callable = by_hash, limit: int = CHUNK_BYTES) -> DataFrame:
    """(k, spans array<struct<at int, n int>>): the starts of all repeated windows as runs, per text that has any.

    `texts` holds k and text. pieces(k, text), bands(k, text, todo) and windows(k, text, todo) are whole-slice functions, for slices of
    `limit` bytes."""
    sure, rest, read = narrowed(step(batches(texts.select("k", "text"), pieces, PIECE, limit)))
    surer, rest, read = narrowed(looked_at(texts, rest, read, bands, PIECE, limit))
    last = looked_at(texts, rest, read, windows, WINDOW, limit)
    spans = sure.unionByName(surer).unionByName(again(last).withColumn("n", F.lit(1)))
    return step(spans.groupBy("k").agg(F.collect_set(F.struct("at", "n")).alias("spans")), (sure, surer, last))


def banded(base: np.ndarray, at: np.ndarray, n: np.ndarray, off: np.ndarray, band: int):
    """Pieces cut into bands of windows whose distance to the anchor falls into one multiple of `band`.

    base is each piece's text start, at and off count from there. Returns (piece, start, windows, band number)."""
    start = expand(base + at, n)
    piece = np.repeat(np.arange(len(n)), n)
    number = (np.repeat(base + at + off, n) - start) // band
    change = np.ones(len(start), bool)
    change[1:] = (piece[1:] != piece[:-1]) | (number[1:] != number[:-1])
    first = np.flatnonzero(change)
    return piece[first], start[first], np.diff(np.append(first, len(start))), number[first]


def runs(lists: pa.ListArray) -> tuple[np.ndarray, ...]:
    """(row of each entry, *fields) of a list<struct> column, nulls as empty."""
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    flat = lists.flatten()
    sizes = np.asarray(pc.fill_null(pc.list_value_length(lists), 0), np.int64)
    return (np.repeat(np.arange(len(sizes)), sizes), *[np.asarray(flat.field(i)) for i in range(flat.type.num_fields)])


def expand(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """start, start + 1, ... start + n - 1 of each run, one after the other."""
    total = int(n.sum())
    begin = np.cumsum(n) - n
    return np.arange(total) - np.repeat(begin, n) + np.repeat(start, n)


def covered(length: int, start: np.ndarray, n: np.ndarray, width: int) -> np.ndarray:
    """Which of `length` places lie in a window of `width` that begins in one of the runs."""
    edge = np.zeros(length + 1, np.int64)
    np.add.at(edge, start, 1)
    np.add.at(edge, np.minimum(start + n - 1 + width, length), -1)
    return np.cumsum(edge[:-1]) > 0
