"""Substring dedup by recompression: word windows that start anywhere else are removed.

Words get names, rounds of pair and run naming (recompress.py) give symbols that equal substrings share, and every window
of `width` words is tied to a symbol settled inside it. `repeats.py` then lets the corpus decide which windows repeat.

The result holds per row: words, removed words, and the kept words joined by one space. Windows are judged on the input
and overlap freely; a window may repeat inside its own text. Texts of fewer than `width` words keep all. Null texts have no
words. Repeated rows repeat each other. Empty tables give no rows; clashing column names are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lurewatch.llm import recompress
from lurewatch.llm.common import BASES, U64, Ranges, Words, batches, flat, mix, table
from lurewatch.llm.repeats import as_pieces, as_windows, banded, by_hash, covered, expand, keyed, repeated_spans, runs

WIDTH, BAND = 35, 5
#: Text bytes of a slice: all symbol generations of a slice are in memory at once, some 70 bytes for each byte of text.
SLICE_BYTES = 1 << 20


def _pieces(width: int):
    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        words = Words(*flat(batch.column(1)))
        names, doc = words.names(), words.doc()
        found = recompress.symbols(names, words.first[:-1][doc], words.first[1:][doc], width)
        at, n, index = recompress.anchors(found, words.first, width)
        off = found[1][index] - at
        with np.errstate(over="ignore"):
            whole = mix(Ranges(names, 1).of(at, at + n + width - 1) + off.astype(U64) * BASES[0] + n.astype(U64))
        row = doc[at]
        return as_pieces(batch.column(0), row, found[0][index], whole, at - words.first[row], n, off, np.ones(len(at), bool))
    return work


def _bands(width: int, band: int):
    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        words = Words(*flat(batch.column(1)))
        names = words.names()
        row, at, n, off, is_open = runs(batch.column(2))
        base = words.first[row]
        piece, start, count, number = banded(base, at, n, off, band)
        anchor = (base + at + off)[piece]
        core = anchor - number * band  # the latest start of the band's windows
        with np.errstate(over="ignore"):
            name = mix(Ranges(names, 0).of(core, core + width - band + 1) + number.astype(U64) * BASES[1])
        whole = Ranges(names, 1).of(start, start + count + width - 1)
        return as_pieces(batch.column(0), row[piece], name, whole, start - base[piece], count, anchor - start, is_open[piece])
    return work


def _windows(width: int):
    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        words = Words(*flat(batch.column(1)))
        row, at, n, _, is_open = runs(batch.column(2))
        start = expand(words.first[row] + at, n)
        row, is_open = np.repeat(row, n), np.repeat(is_open, n)
        a, b = (Ranges(words.names(w), w).of(start, start + width) for w in (0, 1))
        return as_windows(batch.column(0), row, pa.array([b""], pa.binary()).take(pa.array(np.zeros(len(start), np.int64))), a, b, start - words.first[row], is_open)
    return work


def _kept(words: Words, gone: np.ndarray, removed: np.ndarray) -> list[bytes]:
    """The words that stay of every text, joined by one space."""
    body, kept = words.buf.tobytes(), []
    for i, lost in enumerate(removed):
        a, b = words.first[i], words.first[i + 1]
        pick = slice(a, b) if not lost else np.flatnonzero(~gone[a:b]) + a
        kept.append(b" ".join([body[s:e] for s, e in zip(words.start[pick].tolist(), words.end[pick].tolist())]))
    return kept


def _judged(texts: pa.Array, spans: pa.Array, width: int) -> tuple[Words, np.ndarray, np.ndarray]:
    """(words, removed or not, removed words per text). Starts are windows of their own text, so none leaves it."""
    words = Words(*flat(texts))
    row, at, n = runs(spans)
    total = int(words.first[-1])
    gone = covered(total, words.first[row] + at, n, width) if len(row) else np.zeros(total, bool)
    return words, gone, np.diff(np.concatenate(([0], np.cumsum(gone)))[words.first])


def _cut(width: int, with_text: bool):
    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        words, gone, removed = _judged(batch.column(1), batch.column(2), width)
        kept = _kept(words, gone, removed)
        columns = [batch.column(0), pa.array(np.diff(words.first), pa.int64()), pa.array(removed, pa.int64()), pa.array([hashlib.sha256(t).hexdigest() for t in kept], pa.string())]
        return pa.RecordBatch.from_arrays([*columns, pa.array([t.decode() for t in kept], pa.string())] if with_text else columns, ["doc_id", "n_words", "n_removed", "kept_sha256", "kept"][: 4 + with_text])
    return work


def remove_repeats(docs: DataFrame, width: int = WIDTH, with_text: bool = True) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256 [, kept]) of every row of docs(doc_id, text)."""
    texts = keyed(docs)
    spans = repeated_spans(texts, _pieces(width), _bands(width, BAND), _windows(width), by_hash, SLICE_BYTES)
    joined = texts.join(spans, "k", "left").select("doc_id", "text", "spans")
    schema = f"doc_id {dict(docs.dtypes)['doc_id']}, n_words long, n_removed long, kept_sha256 string" + ", kept string" * with_text
    return batches(joined, _cut(width, with_text), schema)


def cut_documents(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """docs with repeated windows cut from text (and n_chars, if there, set anew); untouched texts stay as they are."""
    texts, names, at = keyed(docs), docs.columns, docs.columns.index("text")
    spans = repeated_spans(texts, _pieces(width), _bands(width, BAND), _windows(width), by_hash, SLICE_BYTES).withColumnsRenamed({"k": "_own_k", "spans": "_own_spans"})
    joined = docs.withColumn("_own_k", F.xxhash64("doc_id", "text")).join(spans, "_own_k", "left").select(*names, "_own_spans")

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        words, gone, removed = _judged(batch.column(at), batch.column(len(names)), width)
        columns = list(batch.columns[: len(names)])
        if removed.any():
            kept = _kept(words, gone, removed)
            texts = [k.decode() if r else t for k, r, t in zip(kept, removed, batch.column(at).to_pylist())]
            columns[at] = pa.array(texts, columns[at].type)
            if "n_chars" in names:
                i = names.index("n_chars")
                columns[i] = pa.array([len(t) if r else n for t, r, n in zip(texts, removed, columns[i].to_pylist())], columns[i].type)
        return pa.RecordBatch.from_arrays(columns, names)
    return batches(joined, work, docs.schema)


def op1(spark, d: str) -> DataFrame:
    return remove_repeats(table(d, "documents", spark), with_text=False)


OP1_SQL = r"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
starts AS (SELECT r, w, unnest(range(1, len(w) - 33)) AS p FROM docs WHERE len(w) >= 35),
win AS (SELECT r, p, md5(array_to_string(w[p:p + 34], ' ')) AS h FROM starts),
twice AS (SELECT h FROM win GROUP BY h HAVING count(*) > 1),
hit AS (SELECT DISTINCT r, unnest(range(p, p + 35)) AS i FROM win WHERE h IN (SELECT h FROM twice)),
words AS (SELECT r, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM docs),
kept AS (
  SELECT r, string_agg(word, ' ' ORDER BY i) AS t, count(*) AS n FROM words ANTI JOIN hit USING (r, i) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM docs LEFT JOIN kept USING (r)
"""
