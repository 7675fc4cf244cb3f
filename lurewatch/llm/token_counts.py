"""Token counts by prefix dynamic programming.

A byte-pair vocabulary with word ends never merges across white space, so the count of a text prefix that ends at a white
space run is count(previous prefix) + tokens(next piece). The running array of these counts holds the exact count at
every such prefix; a prefix that ends inside a piece adds the count of that part of the piece, which is encoded alone
(a count is not monotone in the letters of a word, so it is not interpolated). Totals, "over the limit?", and "the
longest prefix within a budget" are then read off the array, and no text is encoded twice.

Each distinct piece is encoded once per worker (the library encodes batches of unseen pieces); the memory of the worker
is bounded by dropping the table of known pieces when it has grown to KNOWN entries.

Null texts count as empty (0 tokens). Empty tables give no rows; repeated rows each give their own; other columns are not
read. Texts are never cut; a piece without white space may be of any length.
"""

from __future__ import annotations

from bisect import bisect_right
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame

from lurewatch.llm.common import batches, table

LIMIT, KNOWN, VOCABULARY = 2048, 1_000_000, "word_bpe_49k.json"
#: White space that surely separates pieces; other white space stays inside a piece and is left to the library.
_SPACES = str.maketrans("\n\t\r", "   ")
_WORKER: dict = {}


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


class PrefixCounter:
    """Counts of one vocabulary file, with the pieces already seen."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.known: dict[str, int] = {"": 0}

    def learn(self, pieces: set[str]) -> None:
        new = list(pieces - self.known.keys())
        if len(self.known) + len(new) > KNOWN:
            self.known = {"": 0}
            new = list(pieces)
        for a in range(0, len(new), 20_000):
            part = new[a: a + 20_000]
            self.known.update(zip(part, (len(e) for e in self.tokenizer.encode_batch_fast(part, add_special_tokens=False))))

    @staticmethod
    def pieces(text: str) -> list[str]:
        return text.translate(_SPACES).split(" ") if "\n" in text or "\t" in text or "\r" in text else text.split(" ")

    def prefix_counts(self, text: str) -> list[int]:
        """The dynamic programme: counts[i] is the exact count of the text's first i pieces."""
        pieces = self.pieces(text)
        self.learn(set(pieces))
        return list(accumulate(map(self.known.__getitem__, pieces), initial=0))

    def longest_prefix(self, text: str, budget: int) -> tuple[int, int]:
        """(characters, tokens) of the longest prefix of at most `budget` tokens; budget 0 or more."""
        pieces, counts = self.pieces(text), self.prefix_counts(text)
        if counts[-1] <= budget:
            return len(text), counts[-1]
        over = next(i for i, c in enumerate(counts) if c > budget)  # the first prefix above is piece over - 1
        start = sum(map(len, pieces[: over - 1])) + over - 1  # one white space character after each earlier piece
        chars, tokens = self.part_of_piece(pieces[over - 1], budget - counts[over - 1])
        return start + chars, counts[over - 1] + tokens

    def part_of_piece(self, piece: str, room: int) -> tuple[int, int]:
        """(characters, tokens) of the longest start of a piece within `room` tokens, by its own prefix counts."""
        parts = [piece[:n] for n in range(len(piece) + 1)]
        counts = [len(e) for e in self.tokenizer.encode_batch_fast(parts, add_special_tokens=False)]
        return max((n, c) for n, c in enumerate(counts) if c <= room)


def counter(path: str) -> PrefixCounter:
    if path not in _WORKER:
        _WORKER[path] = PrefixCounter(path)
    return _WORKER[path]


def token_counts(docs: DataFrame, limit: int = LIMIT, vocabulary: str = VOCABULARY, prefixes: bool = False) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit, n_within [, prefix_tokens]): the last prefix count is the total, and the
    largest one up to the limit, n_within, is what a cut at the limit keeps in whole pieces. The vocabulary file is named,
    and found by each worker."""
    kind = dict(docs.dtypes)["doc_id"]
    schema = f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean, n_within long" + ", prefix_tokens array<int>" * prefixes

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        c = counter(vocabulary_path(vocabulary))
        texts = [t or "" for t in batch.column(1).to_pylist()]
        split = [c.pieces(t) for t in texts]
        c.learn(set().union(*split) if split else set())
        rows = [list(accumulate(map(c.known.__getitem__, p), initial=0)) for p in split]
        n = [r[-1] for r in rows]
        columns = [batch.column(0), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_()),
                   pa.array([r[bisect_right(r, limit) - 1] for r in rows], pa.int64())]
        names = ["doc_id", "n_bytes", "n_tokens", "over_limit", "n_within"]
        if prefixes:
            columns.append(pa.array(rows, pa.list_(pa.int32())))
            names.append("prefix_tokens")
        return pa.RecordBatch.from_arrays(columns, names)

    return batches(docs.select("doc_id", "text"), work, schema)


def op7(spark, d: str) -> DataFrame:
    return token_counts(table(d, "documents", spark))
