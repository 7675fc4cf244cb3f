"""Suffix-order dedup over bytes: 400-byte strings that start anywhere else are removed.

A full suffix array of the corpus would move 400 bytes for each byte of input. Suffixes are therefore sampled by content
first: in each window of `width` bytes the gram with the smallest hash is its anchor (the leftmost in ties), which leaves one
sampled suffix in about width / 2 bytes. `repeats.py` drops suffixes whose anchor gram is unique and folds equal
surroundings. The window starts that remain are suffixes to be sorted: Spark's sampled splitters range-partition them by their
leading bytes, each range is sorted where it lies, and equal neighbours are repeats.

Texts are whole UTF-8 byte sequences; matches never cross texts. Null is empty. Texts shorter than `width` keep all; repeated
rows repeat each other; overlaps count; a cut may split a character, so kept parts are bytes. Empty tables give no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lurewatch.llm.common import BASES, BYTE_VALUES, U64, Ranges, batches, flat, mix, table
from lurewatch.llm.repeats import as_pieces, as_windows, banded, by_suffix_order, covered, expand, keyed, repeated_spans, runs

WIDTH, GRAM, LEAD, BAND = 400, 32, 16, 16
#: Text bytes a worker handles at once; its arrays take some hundred bytes for each.
SLICE_BYTES = 1 << 20
_PLACE_BITS = 27


def _smallest(values: np.ndarray, span: int) -> np.ndarray:
    """The smallest of each `span` values in a row, by doubling."""
    m, w = values, 1
    while 2 * w <= span:
        m = np.minimum(m[:-w], m[w:])
        w *= 2
    return np.minimum(m[: len(values) - span + 1], m[span - w:]) if span > w else m


def _pieces(width: int, gram: int):
    def work(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        buf, offsets = flat(batch.column(1))
        n = len(buf)
        if n < width:
            return None
        if n >= 1 << _PLACE_BITS:
            raise ValueError("a single text of more than 128 MB")
        place = np.arange(n - gram + 1)
        name = Ranges(BYTE_VALUES[0][buf], 0).of(place, place + gram)
        low = U64((1 << _PLACE_BITS) - 1)
        best = _smallest((name & ~low) | place.astype(U64), width - gram + 1)
        long = np.flatnonzero(np.diff(offsets) >= width)
        a, count = offsets[long], np.diff(offsets)[long] - width + 1
        start = expand(a, count)
        row = np.repeat(long, count)
        chosen = best[start]
        change = np.ones(len(start), bool)
        change[1:] = (chosen[1:] != chosen[:-1]) | (row[1:] != row[:-1])
        at = np.flatnonzero(change)
        runs_n = np.diff(np.append(at, len(start)))
        begin, row = start[at], row[at]
        anchor = (chosen[at] & low).astype(np.int64)
        off = anchor - begin
        with np.errstate(over="ignore"):
            whole = mix(Ranges(BYTE_VALUES[1][buf], 1).of(begin, begin + runs_n + width - 1) + off.astype(U64) * BASES[0] + runs_n.astype(U64))
        return as_pieces(batch.column(0), row, name[anchor], whole, begin - offsets[row], runs_n, off, np.ones(len(begin), bool))
    return work


def _bands(width: int, band: int):
    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        buf, offsets = flat(batch.column(1))
        row, at, n, off, is_open = runs(batch.column(2))
        base = offsets[row]
        piece, start, count, number = banded(base, at, n, off, band)
        anchor = (base + at + off)[piece]
        core = anchor - number * band  # the latest start of the band's windows
        with np.errstate(over="ignore"):
            name = mix(Ranges(BYTE_VALUES[0][buf], 0).of(core, core + width - band + 1) + number.astype(U64) * BASES[1])
        whole = Ranges(BYTE_VALUES[1][buf], 1).of(start, start + count + width - 1)
        return as_pieces(batch.column(0), row[piece], name, whole, start - base[piece], count, anchor - start, is_open[piece])
    return work


def _windows(width: int, lead: int):
    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        buf, offsets = flat(batch.column(1))
        row, at, n, _, is_open = runs(batch.column(2))
        start = expand(offsets[row] + at, n)
        row, is_open = np.repeat(row, n), np.repeat(is_open, n)
        a, b = (Ranges(BYTE_VALUES[w][buf], w).of(start, start + width) for w in (0, 1))
        heads = np.lib.stride_tricks.sliding_window_view(buf, lead)[start] if len(start) else np.zeros((0, lead), np.uint8)
        heads = pa.Array.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(np.arange(len(start) + 1, dtype=np.int32) * lead), pa.py_buffer(np.ascontiguousarray(heads))])
        return as_windows(batch.column(0), row, heads, a, b, start - offsets[row], is_open)
    return work


def _cut(width: int, with_bytes: bool):
    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        buf, offsets = flat(batch.column(1))
        row, at, n = runs(batch.column(2))
        gone = covered(len(buf), offsets[row] + at, n, width) if len(row) else np.zeros(len(buf), bool)
        first = gone.copy()
        first[1:] &= ~gone[:-1]
        inner = offsets[:-1][offsets[:-1] < len(buf)]
        first[inner] = gone[inner]

        def per_text(x):
            return np.diff(np.concatenate(([0], np.cumsum(x)))[offsets])
        removed, spans = per_text(gone), per_text(first)
        digests, kept = [], []
        for i in range(batch.num_rows):
            part = buf[offsets[i]: offsets[i + 1]]
            part = (part[~gone[offsets[i]: offsets[i + 1]]] if removed[i] else part).tobytes()
            digests.append(hashlib.sha256(part).hexdigest())
            kept.append(part)
        columns = [batch.column(0), pa.array(np.diff(offsets), pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(digests, pa.string())]
        names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]
        return pa.RecordBatch.from_arrays([*columns, pa.array(kept, pa.binary())] if with_bytes else columns, names[: 5 + with_bytes])
    return work


def remove_repeated_bytes(docs: DataFrame, width: int = WIDTH, gram: int = GRAM, with_bytes: bool = True) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256 [, kept]) of every row of docs(doc_id, text)."""
    texts = keyed(docs)
    spans = repeated_spans(texts, _pieces(width, gram), _bands(width, BAND), _windows(width, min(LEAD, width)), by_suffix_order, SLICE_BYTES)
    joined = texts.join(spans, "k", "left").select("doc_id", "text", "spans")
    schema = f"doc_id {dict(docs.dtypes)['doc_id']}, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_bytes
    return batches(joined, _cut(width, with_bytes), schema, SLICE_BYTES)


def op5(spark, d: str) -> DataFrame:
    return remove_repeated_bytes(table(d, "documents", spark), with_bytes=False)
