"""SentencePiece encoding and decoding in vectorised merge rounds.

A byte-pair model merges, again and again, the neighbouring pair whose joined piece scores highest, the leftmost of equals.
Here all words of a slice stand in flat numpy arrays of symbols. A round takes the least pair rank of every word by one
segmented minimum, merges all its places from the left at once, and compacts the arrays; a word leaves them when no pair
of it remains. Merging several places at once gives what single merges would as long as no new neighbour ranks at or
before the pair just merged; so in each word the places after the first such one wait for the next round.

A word is a stretch that no piece of the vocabulary can reach across: texts are split before a space that follows something
else, long runs of spaces into the vocabulary's longest run (where a trial shows that this changes nothing), and
words once more wherever two neighbouring characters never stand side by side in any piece. Splits are read off the vocabulary, never
assumed. Equal words are encoded once; a worker keeps the words it knows up to KNOWN entries and KNOWN_IDS ids.

Characters without a piece become their UTF-8 bytes. Decoding looks every id up, joins the bytes, and drops the
space that encoding put in front; bytes that are no UTF-8 become U+FFFD one by one.

Null texts count as empty: only the end id, and an empty text when decoded. Empty tables give no rows, repeated rows each
give their own, other columns are not read. Texts are never cut: a long one is worked on in stretches of words, and a
word may be of any length. Models with another normaliser than "escape spaces, put one in front", or with user-defined or
unused pieces that a text could hold, are refused.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lurewatch.llm.common import batches, table

MODEL = "piece_bpe_32k.model"
KNOWN, KNOWN_IDS = 400_000, 4_000_000
STRETCH = 1 << 20  # characters of a text that are split into words at a time
SPACE, POINTS = "▁", 0x110000
NONE = np.int32(2 ** 31 - 1)
_WORKER: dict = {}


def model_path(name: str = MODEL) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _ranges(first: np.ndarray, pick: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the entries of picked ranges [first[i], first[i + 1]), one after another, and where each range begins."""
    n = (first[1:] - first[:-1])[pick]
    begin = np.zeros(len(pick) + 1, np.int64)
    np.cumsum(n, out=begin[1:])
    return np.arange(begin[-1]) + np.repeat(first[:-1][pick] - begin[:-1], n), begin


class Vocabulary:
    """A byte-pair model: which pairs merge into what, and the bytes of each piece."""

    def __init__(self, path: str) -> None:
        from sentencepiece import SentencePieceProcessor
        model = SentencePieceProcessor(model_file=path)
        if model.normalize(" a  b ") != f"{SPACE}{SPACE}a{SPACE}{SPACE}b{SPACE}":
            raise ValueError("a model with another normaliser")
        self.size, self.end = model.vocab_size(), model.eos_id()
        names = [model.id_to_piece(i) for i in range(self.size)]
        special = np.array([model.is_control(i) or model.is_unknown(i) for i in range(self.size)])
        byte = np.array([model.is_byte(i) for i in range(self.size)])
        plain = np.flatnonzero(~special & ~byte)
        if any(model.is_unused(int(i)) for i in plain):
            raise ValueError("a model with unused pieces")
        self.byte_id = np.zeros(256, np.int32)
        for i in np.flatnonzero(byte):
            self.byte_id[int(names[i][1:-1], 16)] = i
        self.special, self.byte = special, byte

        # symbols: ids of pieces, and size + code point for characters without a piece
        ids = {names[i]: int(i) for i in plain}
        symbol = lambda s: ids.get(s, self.size + ord(s) if len(s) == 1 else -1)
        self.char = np.arange(self.size, self.size + POINTS, dtype=np.int64)
        for s, i in ids.items():
            if len(s) == 1:
                self.char[ord(s)] = i
        steps = sorted({-model.get_score(int(i)) for i in plain})
        rank = {s: r for r, s in enumerate(steps)}
        self.base = self.size + POINTS
        pairs = {}
        for s, i in ids.items():
            for k in range(1, len(s)):
                a, b = symbol(s[:k]), symbol(s[k:])
                if a >= 0 and b >= 0:
                    pairs[a * self.base + b] = (rank[-model.get_score(i)], i)
        self.keys = np.array(sorted(pairs), np.int64)
        self.rank, self.into = (np.array([pairs[k][j] for k in self.keys.tolist()], np.int32) for j in (0, 1))
        side = {ord(a) * POINTS + ord(b) for s in ids for a, b in zip(s, s[1:])}
        self.side_by_side = np.array(sorted(side), np.int64)

        shown = [b"" if special[i] else bytes([int(names[i][1:-1], 16)]) if byte[i] else names[i].replace(SPACE, " ").encode() for i in range(self.size)]
        self.shown = np.frombuffer(b"".join(shown), np.uint8)
        self.shown_first = np.concatenate(([0], np.cumsum([len(b) for b in shown]))).astype(np.int64)
        self.leads = np.array([n.startswith(SPACE) for n in names])

        self.spaced = not any(re.search(f"[^{SPACE}]{SPACE}", s) for s in ids)  # a piece holds spaces at its start only
        run = max((len(s) for s in ids if s.strip(SPACE) == ""), default=1)
        block = self._block(run) if self.spaced else ""
        self.words = re.compile(f"{block}{SPACE}*[^{SPACE}]+|{SPACE}+" if self.spaced else r"(?s:.+)")
        self.known: dict[str, int] = {}
        self._forget()

    def _block(self, run: int) -> str:
        """A pattern that takes one longest run of spaces off a far longer one, if a trial shows that nothing changes."""
        tail = ("", "a", "the", "é", "0", "\n")
        lengths = range(3 * run, 4 * run + 1)
        whole = self.merged([SPACE * n + t for n in lengths for t in tail])
        rest = self.merged([SPACE * (n - run) + t for n in lengths for t in tail])
        one = self.merged([SPACE * run])[0]
        same = all(np.array_equal(whole[0][whole[1][i]: whole[1][i + 1]], np.concatenate((one, rest[0][rest[1][i]: rest[1][i + 1]]))) for i in range(len(whole[1]) - 1))
        return f"{SPACE}{{{run}}}(?={SPACE}{{{2 * run}}})|" if same and run > 1 else ""

    def _forget(self) -> None:
        self.known, self.ids, self.first = {}, np.zeros(0, np.int32), np.zeros(1, np.int64)

    def _look(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rank, joined piece) of pairs; NONE where they do not merge."""
        key = a * self.base + b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        hit = self.keys[at] == key
        return np.where(hit, self.rank[at], NONE), np.where(hit, self.into[at], 0)

    def merged(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, first): the ids of every word, by rounds of merges."""
        length = np.fromiter(map(len, words), np.int64, len(words))
        points = _points("".join(words)).astype(np.int64)
        word = np.repeat(np.arange(len(words)), length)
        new = np.ones(len(points), bool)
        if len(points):
            key = points[:-1] * POINTS + points[1:]
            at = np.minimum(np.searchsorted(self.side_by_side, key), max(len(self.side_by_side) - 1, 0))
            apart = self.side_by_side[at] != key if len(self.side_by_side) else True
            new[1:] = (word[1:] != word[:-1]) | apart
        sym, order, unit_word = self.char[points], np.cumsum(new) - 1, word[new]
        del points, word
        rank, into = np.full(len(sym), NONE, np.int32), np.zeros(len(sym), np.int32)
        if len(sym):
            rank[:-1], into[:-1] = self._look(sym[:-1], sym[1:])
            rank[:-1][order[1:] != order[:-1]] = NONE
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(sym):
            start = np.flatnonzero(np.concatenate(([True], order[1:] != order[:-1])))
            n = np.diff(np.append(start, len(sym)))
            least = np.minimum.reduceat(rank, start)
            if (least == NONE).any():
                out = np.repeat(least == NONE, n)
                done.append((order[out], sym[out]))
                sym, order, rank, into = sym[~out], order[~out], rank[~out], into[~out]
                if not len(sym):
                    break
                n, least = n[least != NONE], least[least != NONE]
            at = np.flatnonzero(rank == np.repeat(least, n))  # the last symbol of a word has rank NONE, so runs end there
            head = np.concatenate(([True], np.diff(at) != 1))
            odd = (at - np.repeat(at[head], np.diff(np.append(np.flatnonzero(head), len(at))))) & 1
            at = at[odd == 0]  # of overlapping places every second one, from the left
            at = at[self._until_surprise(sym, order, rank, into, at)]
            sym[at] = into[at]
            keep = np.ones(len(sym), bool)
            keep[at + 1] = False
            at -= np.arange(len(at))
            sym, order, rank, into = sym[keep], order[keep], rank[keep], into[keep]
            for p in (at, at[at > 0] - 1):
                last = p == len(sym) - 1
                q = np.where(last, p, p + 1)
                r, i = self._look(sym[p], sym[q])
                r[last | (order[p] != order[q])] = NONE
                rank[p], into[p] = r, i
        unit = np.concatenate([o for o, _ in done]) if done else np.zeros(0, np.int64)
        ids = np.concatenate([s for _, s in done]) if done else np.zeros(0, np.int64)
        by = np.argsort(unit, kind="stable")
        return self._as_bytes(ids[by], unit_word[unit[by]], len(words))

    def _until_surprise(self, sym, order, rank, into, at) -> np.ndarray:
        """Of the chosen places those up to the first in each word whose new symbol ranks with a neighbour at or before
        the pair that made it: what follows may be overtaken by that new pair."""
        r, new, end = rank[at], into[at].astype(np.int64), len(sym) - 1
        right = np.minimum(at + 2, end)
        near = self._look(new, sym[right])[0]
        surprise = (at + 2 <= end) & (order[right] == order[at]) & (near <= r)
        left = np.maximum(at - 1, 0)
        before = sym[left]
        if len(at) > 1:
            touching = np.concatenate(([False], at[1:] - at[:-1] == 2))
            before = np.where(touching, np.concatenate((new[:1], new[:-1])), before)
        near = self._look(before, new)[0]
        surprise |= (at > 0) & (order[left] == order[at]) & (near <= r)
        if not surprise.any():
            return np.ones(len(at), bool)
        earlier = np.cumsum(surprise) - surprise
        first = np.concatenate(([True], order[at[1:]] != order[at[:-1]]))
        base = np.repeat(earlier[first], np.diff(np.append(np.flatnonzero(first), len(at))))
        return earlier == base

    def _as_bytes(self, sym: np.ndarray, word: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Characters without a piece as the ids of their bytes; (ids, first) by word."""
        odd = np.flatnonzero(sym >= self.size)
        if len(odd):
            point = sym[odd] - self.size
            size = 1 + (point > 0x7F) + (point > 0x7FF) + (point > 0xFFFF)
            times = np.ones(len(sym), np.int64)
            times[odd] = size
            raw = np.frombuffer("".join(map(chr, point.tolist())).encode(), np.uint8)
            unknown = np.repeat(sym >= self.size, times)
            sym, word = np.repeat(sym, times), np.repeat(word, times)
            sym[unknown] = self.byte_id[raw]
        return sym.astype(np.int32), np.searchsorted(word, np.arange(n + 1))

    def stretches(self, text: str | None):
        """Parts of the escaped text that end where a word ends."""
        text = (SPACE + text.replace(" ", SPACE)) if text else ""
        a = 0
        while a < len(text):
            b = len(text)
            if self.spaced and b - a > 2 * STRETCH:
                b = max(text.find(SPACE, a + STRETCH), a)
                while a < b < len(text) and text[b - 1] == SPACE:
                    b = text.find(SPACE, b + 1)
                b = b if b > a else len(text)
            yield text[a:b]
            a = b

    def encode(self, texts: list[str | None], end: bool = True) -> tuple[np.ndarray, np.ndarray]:
        """(ids, first) of every text, with the end id after each if wanted."""
        if len(self.known) > KNOWN or len(self.ids) > KNOWN_IDS:
            self._forget()
        parts, sizes, held, room = [], [], [], STRETCH
        for text in texts:
            n = 0
            for stretch in self.stretches(text):
                held.append(self.words.findall(stretch))
                n += len(held[-1])
                room -= len(stretch)
                if room < 0:  # the words of some stretches become numbers before more are split
                    parts.append(self._numbers(held))
                    held, room = [], STRETCH
            sizes.append(n)
        parts.append(self._numbers(held))
        place, begin = _ranges(self.first, np.concatenate(parts))
        ids, first = self.ids[place], begin[np.concatenate(([0], np.cumsum(sizes))).astype(np.int64)]
        if end:
            ids = np.insert(ids, first[1:], self.end)
            first = first + np.arange(len(first))
        return ids, first

    def _numbers(self, lists: list[list[str]]) -> np.ndarray:
        """The number of each word among the known ones; new words are encoded, all in the same rounds."""
        new = list(set().union(*lists) - self.known.keys())
        if new:
            ids, first = self.merged(new)
            self.known.update(zip(new, range(len(self.known), len(self.known) + len(new))))
            self.first = np.concatenate((self.first, first[1:] + self.first[-1]))
            self.ids = np.concatenate((self.ids, ids))
        return np.fromiter((self.known[w] for words in lists for w in words), np.int64, sum(map(len, lists)))

    def decoded(self, ids: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bytes, first): every text's bytes, without the space in front."""
        place, begin = _ranges(self.shown_first, ids)
        out, edge = self.shown[place], begin[first]
        said = np.flatnonzero(~self.special[ids])  # the first id that says something decides about the space
        lead = np.searchsorted(said, first[:-1])
        has = lead < len(said)
        has[has] = said[lead[has]] < first[1:][has]
        drop = said[lead[has]]
        drop = drop[self.leads[ids[drop]]]
        keep = np.ones(len(out), bool)
        keep[begin[drop]] = False
        less = np.concatenate(([0], np.cumsum(~keep)))
        return out[keep], edge - less[edge]

    def decode(self, ids: list[int]) -> str:
        """The text of any ids: each run of bytes is read as UTF-8 by itself."""
        ids = np.asarray(ids, np.int64)
        raw, _ = self.decoded(ids, np.array([0, len(ids)]))
        edges = np.concatenate(([0], np.cumsum(np.diff(self.shown_first)[ids])))
        edges -= edges[-1] - len(raw)  # the dropped space is the first byte of all
        turn = np.flatnonzero(np.diff(self.byte[ids], prepend=False, append=False))
        cuts = np.maximum(edges[turn], 0)
        return "".join(_one_by_one(raw[a:b].tobytes()) for a, b in zip(np.append(0, cuts), np.append(cuts, len(raw))))


def _one_by_one(raw: bytes) -> str:
    """Text of bytes, where every byte that begins no character becomes U+FFFD."""
    out, a = [], 0
    while a < len(raw):
        try:
            out.append(raw[a:].decode())
            break
        except UnicodeDecodeError as e:
            out.append(raw[a: a + e.start].decode() + "�")
            a += e.start + 1
    return "".join(out)


def vocabulary(path: str) -> Vocabulary:
    if path not in _WORKER:
        _WORKER[path] = Vocabulary(path)
    return _WORKER[path]


def encode_documents(docs: DataFrame, model: str = MODEL, end: bool = True) -> DataFrame:
    """(doc_id, ids, decoded) of every row: the ids of its whole text and the text that they decode to. The model
    file is named, and found by each worker."""
    schema = f"doc_id {dict(docs.dtypes)['doc_id']}, ids array<int>, decoded string"

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        v = vocabulary(model_path(model))
        ids, first = v.encode(batch.column(1).to_pylist(), end)
        raw, edge = v.decoded(ids, first)
        lists = pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(ids, pa.int32()))
        texts = pa.StringArray.from_buffers(batch.num_rows, pa.py_buffer(edge.astype(np.int32)), pa.py_buffer(raw))
        return pa.RecordBatch.from_arrays([batch.column(0), lists, texts], ["doc_id", "ids", "decoded"])

    return batches(docs.select("doc_id", "text"), work, schema)


def op11(spark, d: str) -> DataFrame:
    df = encode_documents(table(d, "documents", spark))
    shown = F.array_join(F.col("ids").cast("array<string>"), " ")
    return df.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(shown, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
