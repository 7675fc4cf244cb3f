"""N-gram Jaccard join by T-occurrence search in the DivideSkip manner.

A document is its set of word shingles; equal sets are one class, so copies never meet. Two sets of n and m shingles reach the
threshold only if they share T = ceil(t / (1 + t) * (n + m)) of them. As in DivideSkip, the inverted lists are divided:
the n - ceil(t n) + 2 shingles of a set that come first in one fixed order are its short lists, which are merged (a sort-merge
on the shingle); at least two of them must meet. The rest, with all frequent shingles at their end, are the long lists,
which are never merged: a candidate is settled by binary probes of the smaller set in the larger one. The order is
(frequency, hash), where the frequencies come from a hash sample of classes and at most HOT shingles; any order gives
the same links, a good one gives few candidates.

No list is opened into all its pairs unless it is short (SHORT classes). A longer list elects a leader in each size band: the most
central class, which is the one that stands in most long lists (what a copy has of its own comes first in the order and fills its short
lists). A member meets one leader a round, the most central of its lists. In the rounds that follow, a list's main component
rests, and who is outside elects and meets a new leader. What is left then meets pair by pair: members outside the main component
and all others that share a second list, a hashed slice of these pairs first and the rest only where that joined nothing. That leaves
no link between different components unseen, and needs no comparison inside one. Before two whole sets meet, their sketches (counts in
hash slots) do: the sum of the smaller counts is never less than the overlap, so a pair that it rejects is no link. Sketches are made
with the classes, so whole sets are made only for the classes of pairs that are left. Texts are never shuffled for that: a bitmap of
their keys, of one size at any number of rows, says which may be asked, and the exact join runs over the few sets made.

Result: one row per document with its set size and the smallest doc_id reachable by links. Null and wordless texts have no
shingles and no links. Repeated rows are one class; a null doc_id takes part, but is only reported if its component has no
other id. Empty tables give no rows; other columns are not read. Shingles and set names are 64- and 128-bit fingerprints.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lurewatch.llm.common import BASES, U64, Ranges, Words, batches, chunks, flat, mix, ship, table
from lurewatch.llm.repeats import drop, keyed, signed, step

SIZE, PERCENT = 4, 85
SAMPLE, HOT = 8, 1 << 17
SHORT, ROUNDS, SLICE = 16, 2, 16
#: Text bytes of a slice; a set takes some ten bytes for a byte of text while it is made.
BYTES = 1 << 20
#: Bits of the bitmap of asked keys: 131,072 words of 64 bits at most reach the driver. Fuller maps only let more sets be made.
MAP_BITS = 1 << 23
_LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)


def shingles(texts: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(distinct shingles sorted inside each text, first place of each text)."""
    buf, offsets = flat(texts)
    words = Words(_LOWER[buf], offsets)
    count = np.diff(words.first)
    ranges = Ranges(words.names(), 1)
    n = np.where(count >= size, count - size + 1, np.minimum(count, 1))
    doc = np.repeat(np.arange(len(count)), n)
    begin = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n) + words.first[doc]
    name = ranges.of(begin, np.minimum(begin + size, words.first[doc + 1]))
    order = np.argsort(name, kind="stable")
    order = order[np.argsort(doc[order].astype(np.int32), kind="stable")]
    name, doc = name[order], doc[order]
    new = np.ones(len(name), bool)
    new[1:] = (name[1:] != name[:-1]) | (doc[1:] != doc[:-1])
    name, doc = name[new], doc[new]
    return name, np.searchsorted(doc, np.arange(len(count) + 1))


def _sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        sums = np.concatenate((np.zeros(1, U64), np.cumsum(values)))
        return sums[first[1:]] - sums[first[:-1]]


def set_names(name: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A fingerprint per set; both halves of 128 bits are folded over the size."""
    with np.errstate(over="ignore"):
        return mix(_sums(mix(name), first) + mix(_sums(mix(name * BASES[0] + U64(1)), first)) * BASES[1] + np.diff(first).astype(U64))


def _classes(size: int):
    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        name, first = shingles(batch.column(2), size)
        columns = [batch.column(0), batch.column(1), signed(set_names(name, first)), pa.array(np.diff(first), pa.int64()), pa.array(sketches(name, first), pa.binary())]
        return pa.RecordBatch.from_arrays(columns, ["k", "doc_id", "cls", "n", "sketch"])
    return work


def _sampled(size: int, sample: int):
    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        name, first = shingles(batch.column(0), size)
        take = np.flatnonzero(mix(set_names(name, first) + U64(7)) % U64(sample) == 0)
        pick = np.concatenate([name[first[i]: first[i + 1]] for i in take]) if len(take) else name[:0]
        return pa.RecordBatch.from_arrays([signed(pick)], ["s"])
    return work


def _prefixes(size: int, percent: int, hot):
    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        known, rank = hot.value
        name, first = shingles(batch.column(0), size)
        n = np.diff(first)
        doc = np.repeat(np.arange(len(n)), n)
        weight = np.zeros(len(name), np.int64)
        if len(known) and len(name):
            at = np.minimum(np.searchsorted(known, name), len(known) - 1)
            weight = np.where(known[at] == name, rank[at], 0)
        # sorted by name inside a text already; frequent ones go last, by rank
        order = np.argsort(doc * (len(known) + 1) + weight, kind="stable")
        place = np.arange(len(name)) - first[doc]
        keep = np.flatnonzero(place < (n - (percent * n + 99) // 100 + 2)[doc])
        cls = set_names(name, first)
        d = doc[keep]
        return pa.RecordBatch.from_arrays([signed(name[order[keep]]), signed(cls[d]), pa.array(n[d].astype(np.int32)), pa.array(place[keep].astype(np.int32))], ["s", "cls", "n", "pos"])
    return work


def sketches(name: np.ndarray, first: np.ndarray) -> list[bytes]:
    """How many shingles of each set fall into each of 64 to 1,024 hash slots, up to 255 (which stands for any more)."""
    slot, made = (mix(name) % U64(1024)).astype(np.int64), []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        slots = 64 if b - a <= 512 else 256 if b - a <= 4096 else 1024
        made.append(np.minimum(np.bincount(slot[a:b] % slots, minlength=slots), 255).astype(np.uint8).tobytes())
    return made


def bound(a: bytes, b: bytes) -> int:
    """The most that two sets can share by their sketches: never less than their overlap."""
    x, y = (np.where(c == 255, 1 << 40, c) for c in (np.frombuffer(s, np.uint8).astype(np.int64) for s in (a, b)))
    slots = min(len(x), len(y))
    return int(np.minimum(x.reshape(-1, slots).sum(axis=0), y.reshape(-1, slots).sum(axis=0)).sum())


def _sets(size: int, bitmap):
    """(k, members) of the texts whose key is in the bitmap."""
    def run(it):
        for batch in it:
            key = batch.column(0).to_numpy().view(U64) & U64(MAP_BITS - 1)
            held = bitmap.value[(key >> U64(6)).astype(np.int64)] >> (key & U64(63)) & U64(1) == 1
            batch = batch.filter(pa.array(held))
            for a, b in chunks(batch.column(1), BYTES):
                name, first = shingles(batch.column(1).slice(a, b - a), size)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array([name[i:j].tobytes() for i, j in zip(first[:-1], first[1:])], pa.binary())], ["k", "members"])
    return run


def set_rows(texts: DataFrame, asked: DataFrame, size: int) -> DataFrame:
    """(cls, members) with one row a class, as a written table. `asked` are classes with the key of one text each (cls, k, same); only a text
    that stands in the table several times needs to be told apart."""
    ship(texts.sparkSession)
    slot = F.col("k").bitwiseAND(F.lit(MAP_BITS - 1))
    words = asked.groupBy(F.shiftright(slot, 6).alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, cast(k & 63 as int))")).alias("bits")).toPandas()  # at most MAP_BITS / 64 rows
    bitmap = np.zeros(MAP_BITS >> 6, U64)
    bitmap[words["at"].to_numpy(np.int64)] = words["bits"].to_numpy(np.int64).view(U64)
    held = texts.sparkSession.sparkContext.broadcast(bitmap)
    met = texts.select("k", "text").mapInArrow(_sets(size, held), "k long, members binary").join(asked, "k")
    alone = asked.where("same > 1").isEmpty()
    return step(met.select("cls", "members") if alone else met.where("same = 1").select("cls", "members").unionByName(met.where("same > 1").select("cls", "members").dropDuplicates(["cls"])))


def overlap(a: bytes, b: bytes) -> int:
    """Binary probes of the smaller set in the larger one."""
    x, y = np.frombuffer(a, U64), np.frombuffer(b, U64)
    if len(x) > len(y):
        x, y = y, x
    at = np.searchsorted(y, x)
    return int((y[np.minimum(at, len(y) - 1)] == x).sum())


def _linked(percent: int):
    def run(it):
        for batch in it:
            a, b, x, y = (batch.column(i) for i in range(4))
            both = np.array([overlap(p.as_py(), q.as_py()) for p, q in zip(x, y)], np.int64)
            sizes = sum(np.asarray(pc.binary_length(c), np.int64) // 8 for c in (x, y))
            yield pa.RecordBatch.from_arrays([a, b], ["a", "b"]).filter(pa.array(100 * both >= percent * (sizes - both)))
    return run


def _possible(percent: int):
    def run(it):
        for batch in it:
            n, m = (np.asarray(batch.column(i), np.int64) for i in (2, 3))
            most = np.array([bound(p.as_py(), q.as_py()) for p, q in zip(batch.column(4), batch.column(5))], np.int64)
            most = np.minimum(most, np.minimum(n, m))
            yield batch.select(["a", "b"]).filter(pa.array(100 * most >= percent * (n + m - most)))
    return run


def links(pairs: DataFrame, wanted: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs (a, b) of classes that reach the threshold, as a written table. `wanted` holds cls, n, sketch, k and same of every class that
    may be met. Sketches of fixed size settle most pairs that do not reach it, whole sets are made and meet for the rest."""
    small = [wanted.select(F.col("cls").alias(c), F.col("n").alias(f"n{c}"), F.col("sketch").alias(f"s{c}")) for c in ("a", "b")]
    near = step(pairs.join(small[0], "a").join(small[1], "b").select("a", "b", "na", "nb", "sa", "sb").mapInArrow(_possible(percent), "a long, b long"))
    if near.isEmpty():
        return near
    asked = step(wanted.select("cls", "k", "same").join(near.select(F.col("a").alias("cls")).union(near.select("b")).distinct(), "cls", "left_semi"))
    sets = set_rows(texts, asked, size)
    left, right = (sets.select(F.col("cls").alias(c), F.col("members").alias(f"m{c}")) for c in ("a", "b"))
    return step(near.join(left, "a").join(right, "b").select("a", "b", "ma", "mb").mapInArrow(_linked(percent), "a long, b long"), (near, asked, sets))


def components(edges: DataFrame) -> DataFrame:
    """(cls, root) of every class with a link; root is the component's smallest class. A written table a round."""
    both = step(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = step(both.groupBy("a").agg(F.min("b").alias("low")).select(F.col("a").alias("cls"), F.least("a", "low").alias("root")))
    while True:
        near = both.join(labels.withColumnRenamed("cls", "a"), "a").groupBy(F.col("b").alias("cls")).agg(F.min("root").alias("near"))
        stepped = labels.join(near, "cls").select("cls", "root", F.least("root", "near").alias("next"))
        jump = labels.select(F.col("cls").alias("next"), F.col("root").alias("over"))
        labels = step(stepped.join(jump, "next").select("cls", F.least("next", "over").alias("root"), (F.least("next", "over") < F.col("root")).alias("moved")), (labels,))
        if labels.where("moved").isEmpty():
            return labels.select("cls", "root")
        labels = labels.select("cls", "root")


def _fits(x: str, y: str, percent: int):
    """Length and positional bounds of two list entries; a shared shingle may be the pair's first or second."""
    n, m = F.col(f"{x}.n"), F.col(f"{y}.n")
    rest = F.least(n - F.col(f"{x}.pos"), m - F.col(f"{y}.pos")) + 1
    return (100 * F.least(n, m) >= percent * F.greatest(n, m)) & ((100 + percent) * rest >= percent * (n + m))


def _pairs(left: DataFrame, right: DataFrame, keys: list[str], percent: int, more=None) -> DataFrame:
    """(a, b) with a < b for entries of the two sides that meet in `keys` and pass the bounds."""
    on = F.lit(True)
    for c in keys:
        on = on & (F.col(f"x.{c}") == F.col(f"y.{c}"))
    on = on & (F.col("x.cls") != F.col("y.cls")) & _fits("x", "y", percent)
    met = left.alias("x").join(right.alias("y"), on if more is None else on & more)
    return met.select(F.least("x.cls", "y.cls").alias("a"), F.greatest("x.cls", "y.cls").alias("b"))


def _leaders(members: DataFrame, tried: DataFrame | None, percent: int) -> DataFrame:
    """(a, b) of every member and one leader: of its lists' bands, the most central that the bounds let it link with and that it was not
    compared with. `members` are the entries that elect and are led."""
    lead = members.groupBy("s", "band").agg(F.max_by(F.struct("cls", "n", "pos", "lists", "root"), F.struct("lists", "cls")).alias("w")).select("s", "band", "w.*")
    on = (F.col("x.s") == F.col("y.s")) & (F.col("x.band") == F.col("y.band")) & (F.col("x.root") != F.col("y.root")) & _fits("x", "y", percent)
    led = lead.alias("x").join(members.alias("y"), on).select(F.col("x.cls").alias("lead"), F.col("x.lists"), F.col("y.cls").alias("m"), F.least("x.cls", "y.cls").alias("a"), F.greatest("x.cls", "y.cls").alias("b"))
    if tried is not None:
        led = led.groupBy("a", "b", "m").agg(F.max(F.struct("lists", "lead")).alias("w")).join(tried, ["a", "b"], "left_anti").select("a", "b", "m", "w.*")
    return led.groupBy("m").agg(F.max(F.struct("lists", "lead", "a", "b")).alias("w")).select("w.a", "w.b").distinct()


def _placed(long: DataFrame, known: DataFrame) -> DataFrame:
    """The entries of the long lists with their classes' components; `out`: not of the list's main component."""
    placed = long.join(known, "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    main = placed.groupBy("s", "root").agg(F.count("*").alias("size")).groupBy("s").agg(F.max_by("root", F.struct("size", "root")).alias("main"))
    return placed.join(main, "s").withColumn("out", F.col("root") != F.col("main")).drop("main")


def class_components(docs: DataFrame, size: int = SIZE, percent: int = PERCENT) -> DataFrame:
    """(k, doc_id, cls, n, root) of every row: its class, set size and component."""
    texts = keyed(docs)
    kind = dict(docs.dtypes)["doc_id"]
    rows = step(batches(texts.select("k", "doc_id", "text"), _classes(size), f"k long, doc_id {kind}, cls long, n long, sketch binary", BYTES))
    only = texts.select("text")
    seen = batches(only, _sampled(size, SAMPLE), "s long", BYTES).groupBy("s").agg(F.count("*").alias("c")).where("c > 1")
    seen = step(seen.orderBy(F.desc("c"), "s").limit(HOT)).orderBy(F.desc("c"), "s").toPandas()  # at most HOT rows of 16 bytes
    by = np.argsort(seen["s"].to_numpy(np.int64).view(U64))
    rank = np.arange(len(seen), 0, -1)[by]  # the most frequent ranks last
    hot = docs.sparkSession.sparkContext.broadcast((seen["s"].to_numpy(np.int64).view(U64)[by], rank))
    entries = step(batches(only, _prefixes(size, percent, hot), "s long, cls long, n int, pos int", BYTES))
    shared = entries.groupBy("s").agg(F.min("cls").alias("lo"), F.max("cls").alias("hi")).where("lo < hi").select("s")
    shared = step(shared)
    entries = step(entries.join(shared, "s", "left_semi").distinct(), (entries, shared))
    lists = step(entries.groupBy("s").agg(F.count("*").alias("c")))
    entries = step(entries.join(lists, "s").withColumn("band", F.floor(4 * F.log2("n")).cast("int")), (entries, lists))
    short, long = entries.where(F.col("c") <= SHORT), entries.where(F.col("c") > SHORT)
    long = step(long.join(long.groupBy("cls").agg(F.count("*").alias("lists")), "cls"))
    met = step(_pairs(short, short, ["s"], percent, F.col("x.cls") < F.col("y.cls")).groupBy("a", "b").agg(F.count("*").alias("met")), (entries,))
    few = met.where("met > 1").select("a", "b")
    # size, sketch and one text's key of the classes that may be compared
    asked = few.select(F.col("a").alias("cls")).union(few.select("b")).union(long.select("cls")).distinct()
    wanted = rows.join(asked, "cls", "left_semi").groupBy("cls", "n", "sketch", "k").agg(F.count("*").alias("same"))
    wanted = step(wanted.groupBy("cls", "n", "sketch").agg(F.min(F.struct("same", "k")).alias("w")).select("cls", "n", "sketch", "w.k", "w.same"))

    def linked(pairs):
        return links(pairs, wanted, texts, size, percent)

    # long lists in rounds: a member meets one leader at a time, and the main component of a list rests after the first
    turn = _leaders(long.withColumn("root", F.col("cls")), None, percent)
    tried = step(few.unionByName(turn).distinct())
    edges = linked(tried)
    known = components(edges)
    for _ in range(ROUNDS):
        out = step(_placed(long, known).where("out"))
        turn = step(_leaders(out, tried, percent), (out,))
        more = linked(turn)
        tried = step(tried.unionByName(turn), (tried, turn))
        if not more.isEmpty():
            edges = step(edges.unionByName(more), (edges,))
            known = components(edges)

    # whoever is outside a long list's main component meets all others of the list; a pair shares two short or long lists at least
    placed = step(_placed(long, known), (long,))
    on = (F.col("x.s") == F.col("y.s")) & (F.col("x.root") != F.col("y.root")) & _fits("x", "y", percent)
    late = placed.where("out").alias("x").join(placed.alias("y"), on)
    # two outsiders meet from both sides, so each side counts half of a list
    late = late.groupBy(F.least("x.cls", "y.cls").alias("a"), F.greatest("x.cls", "y.cls").alias("b")).agg((F.sum(F.when(F.col("y.out"), 1).otherwise(2)) / 2).alias("seen"))
    late = late.join(met, ["a", "b"], "left").join(tried, ["a", "b"], "left_anti")
    late = step(late.where(F.col("seen") + F.coalesce("met", F.lit(0)) > 1).select("a", "b"), (placed, met, tried))
    first = F.pmod(F.xxhash64("a", "b"), F.lit(SLICE)) == 0
    more = linked(late.where(first))
    if not more.isEmpty():
        edges = step(edges.unionByName(more), (edges,))
        known = components(edges)
    roots = {c: known.select(F.col("cls").alias(c), F.col("root").alias(f"r{c}")) for c in ("a", "b")}
    apart = late.where(~first).join(roots["a"], "a", "left").join(roots["b"], "b", "left").where(F.coalesce("ra", "a") != F.coalesce("rb", "b"))
    more = linked(step(apart.select("a", "b")))
    drop(wanted, late)
    if not more.isEmpty():
        known = components(edges.unionByName(more))
    return rows.join(known, "cls", "left").select("k", "doc_id", "cls", "n", F.coalesce("root", "cls").alias("root"))


def jaccard_components(docs: DataFrame, size: int = SIZE, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id)."""
    df = step(class_components(docs, size, percent))
    least = df.where("n > 0").groupBy("root").agg(F.min("doc_id").alias("component"))
    named = df.join(least, "root", "left")
    return named.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("doc_id")).alias("component_id"))


def one_of_each(docs: DataFrame, size: int = SIZE, percent: int = PERCENT) -> DataFrame:
    """The rows of docs without near copies: of each component the row with the smallest doc_id (null last). Documents
    without shingles all stay. All columns as they are."""
    df = step(class_components(docs, size, percent))
    first = df.where("n > 0").groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "k")).alias("w"))
    kept = first.select("w.k", F.lit(True).alias("one")).unionByName(df.where("n = 0").select("k", F.lit(False).alias("one")).distinct())
    rows = docs.select(F.xxhash64("doc_id", "text").alias("k"), F.struct(*docs.columns).alias("row")).join(kept, "k")
    again = Window.partitionBy("k").orderBy("one")
    return rows.withColumn("copy", F.row_number().over(again)).where("copy = 1 OR NOT one").select("row.*")


def op10(spark, d: str) -> DataFrame:
    return jaccard_components(table(d, "documents", spark))
