"""Conversation structure repair by a rank-convergence parallel Viterbi.

A conversation should give the role initials `(s?(ua)+)?`. Its turns are edited at least cost: Keep 0, Rerole to user or assistant
1, Delete 2 (must, for blank and repeated turns), Insert an empty user or assistant turn 5, and 5 more for a truncated turn
that stays. The state between turns is what stands so far: nothing (0), a system turn (1), a user turn last (2), an assistant turn
last (3). User and assistant turns may follow in one way only, so an edit's letter and the state say what it does.
Two inserts with only deletes between them never pay (they lead back to a state that could do the same), so one
insert before each turn and one at the end are enough.

Turns are put in order by one range shuffle of (conversation, turn, role, text, row), so a conversation of any size spreads over
many tasks; places in that order are cut into blocks of BLOCK. A chunk is the part of a conversation in one block. Its turns
become a string of symbols (role class and fault), and all passes work on these strings:

1. Backward costs. The cost vector behind a chunk is not known before the next chunk is done, so chunks start from
   speculative vectors. Passes fix that up: per conversation the vectors are stitched from the end; where a chunk
   meets a vector it was not started from, that vector is tried in all chunks of the conversation, in step with the known
   ones, until it differs from one of them by a constant only: from there on it is that one. Vectors that differ by a
   constant are one direction, costs differ by 10 at most, so there are few directions and the passes end.
2. Entry states: each chunk, for each state it may be entered in, gives the state it is left in; stitched from the start.
3. Least-audit tracing with the stitched costs: of the edits that keep to the least cost the first in ASCII order.

A stitching row holds one entry a chunk, that is one per BLOCK turns. Repaired turns are streamed in order through the task
of their conversation, which holds one batch; the digest of a whole conversation is sequential by nature.

Order: turn (nulls first), then role, then text. A null role, text or id inside a key is one space (a null turn stays null for order
and gaps). A null conv_id is a conversation of its own. Roles count by their first character; a role without one is of no
class. Repeated rows are repeated turns, so all but the first are deleted. Empty tables give no rows, texts may be of any
length, other columns are not read.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lurewatch.llm.common import ship, table
from lurewatch.session import cut_lineage

BLOCK_BITS = 14  # places of a block: 2^14
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
CLASSES = "suao"  # system, user, assistant, other
#: A turn's symbol: one letter per class, for turns that are fine, truncated, blank, duplicate.
FINE, CUT, BLANK, DUPLICATE = "suao", "SUAO", "bcde", "wxyz"
CLASS = {s: c for group in (FINE, CUT, BLANK, DUPLICATE) for s, c in zip(group, CLASSES)}
LEGAL = {"su", "ua", "au"}
END = (0, 2 * INSERT, INSERT, 0)  # cost of an end in each state
ZERO = (0, 0, 0, 0)
SPACES = " \t\n\x0b\x0c\r"
#: Edits of a turn in one letter: 4 * insert before (none, user, assistant) + (delete, keep, rerole to user, to assistant).
EDIT = "abcdefghijkl"
ROLES = ("", "user", "assistant")


def _after(q: int) -> int:
    """The state after a user or assistant turn, whichever may follow."""
    return 3 if q == 2 else 2


def _kept(cls: str, q: int) -> int | None:
    """The state after a kept turn, or None."""
    if cls == "s":
        return 1 if q == 0 else None
    if cls == "u":
        return None if q == 2 else 2
    return 3 if cls == "a" and q == 2 else None


def _edited(s: str, behind: tuple) -> list[int]:
    """Least cost from each state over a turn's own edits, given the costs behind it."""
    extra = TRUNCATED if s in CUT else 0
    out = []
    for q in range(4):
        best = min(DELETE + behind[q], REROLE + extra + behind[_after(q)])
        k = _kept(CLASS[s], q)
        out.append(best if k is None else min(best, KEEP + extra + behind[k]))
    return out


@lru_cache(1 << 16)
def _before(s: str, behind: tuple) -> tuple:
    """The direction of the costs before a turn, and what was taken off."""
    if s in BLANK or s in DUPLICATE:
        return behind, DELETE
    own = _edited(s, behind)
    out = [min(own[q], INSERT + own[_after(q)]) for q in range(4)]
    low = min(out)
    return tuple(x - low for x in out), low


def vectors(symbols: str, end: tuple) -> list[tuple]:
    """Directions of the costs before each turn, and behind the last."""
    out = [end]
    for s in reversed(symbols):
        out.append(_before(s, out[-1])[0])
    return out[::-1]


def started(symbols: str, wanted: list[tuple], known: dict[tuple, tuple]) -> dict[tuple, tuple]:
    """Directions before a chunk for each wanted direction behind it. All run in step; one that meets another goes its way."""
    live: dict[tuple, list[tuple]] = {}
    for v in (*known, *wanted):
        live.setdefault(v, []).append(v)
    for s in reversed(symbols):
        if all(any(v in known for v in group) for group in live.values()):
            break  # all have converged with known ones
        moved: dict[tuple, list[tuple]] = {}
        for v, group in live.items():
            moved.setdefault(_before(s, v)[0], []).extend(group)
        live = moved
    out = {}
    for v, group in live.items():
        told = next((known[g] for g in group if g in known), v)
        out.update({g: told for g in group if g in wanted})
    return out


def trace(symbols: str, costs: list[tuple], q: int) -> tuple[str, str, int, int]:
    """(edits, audit, cost, state left) of the cheapest way from state q whose audit is least."""
    edits, audit, cost = [], [], 0
    for s, behind in zip(symbols, costs[1:]):
        if s in BLANK or s in DUPLICATE:
            edits.append(EDIT[0])
            audit.append("D")
            cost += DELETE
            continue
        own, put, extra = _edited(s, behind), 0, TRUNCATED if s in CUT else 0
        least = min(own[q], INSERT + own[_after(q)])
        if DELETE + behind[q] != least and INSERT + own[_after(q)] == least:
            q = _after(q)
            put, least, cost = (1 if q == 2 else 2), own[q], cost + INSERT
            audit.append("I")
        k = _kept(CLASS[s], q)
        if DELETE + behind[q] == least:
            op, cost = 0, cost + DELETE
        elif k is not None and KEEP + extra + behind[k] == least:
            op, q, cost = 1, k, cost + KEEP + extra
        else:
            q = _after(q)
            op, cost = (2 if q == 2 else 3), cost + REROLE + extra
        edits.append(EDIT[4 * put + op])
        audit.append("DKRR"[op])
    return "".join(edits), "".join(audit), cost, q


def _ending(q: int) -> tuple[str, int]:
    return {0: ("", 0), 1: ("II", END[1]), 2: ("I", END[2]), 3: ("", 0)}[q]


def _solved(symbols: str, end: tuple, q: int, last: bool) -> tuple:
    """(edits, audit, cost, blank, duplicate, truncated, illegal) of a chunk."""
    edits, audit, cost, left = trace(symbols, vectors(symbols, end), q)
    if last:
        more, price = _ending(left)
        audit, cost = audit + more, cost + price
    cls = "".join(map(CLASS.__getitem__, symbols))
    illegal = sum(a + b not in LEGAL for a, b in zip(cls, cls[1:]))
    return edits, audit, cost, *(sum(map(symbols.count, group)) for group in (BLANK, DUPLICATE, CUT)), illegal


@lru_cache(1 << 16)
def _solved_short(symbols: str, end: tuple, q: int, last: bool) -> tuple:
    return _solved(symbols, end, q, last)


def _rows(fn, names: list[str], types: list[pa.DataType]):
    """mapInArrow over Python rows: fn(**columns of a row) gives lists of tuples."""
    def run(it):
        for batch in it:
            out = [t for row in batch.to_pylist() for t in fn(**row)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)
    return run


def _text(v: tuple) -> str:
    return ",".join(map(str, v))


def _vector(v: str) -> tuple:
    return tuple(map(int, v.split(",")))


def _key(*columns: str) -> Column:
    return F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in columns])


def damaged(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text): rows dropped, emptied, without end marks, repeated or with another role, by a hash."""
    code = F.pmod(F.crc32(_key("conv_id", "turn").cast("binary")), F.lit(20))
    role, text = (F.coalesce(c, F.lit(" ")) for c in ("role", "text"))
    df = conversations.select("conv_id", "turn", role.alias("role"), text.alias("text"), code.alias("code")).where("code <> 0")
    text = F.when(F.col("code") == 1, "").when(F.col("code") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("code") == 4, "user").otherwise(F.col("role"))
    copies = F.explode(F.when(F.col("code") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))
    return df.select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("copy")).drop("copy")


def ordered(turns: DataFrame) -> DataFrame:
    """A written table of all turns in order: (conv, place, turn, role, text, fault, cls, said). `said` is a fingerprint of role
    and text; fault is B (blank), T (truncated) or empty."""
    conv = F.when(F.col("conv_id").isNull(), "n").otherwise(F.concat(F.lit("c"), F.col("conv_id").cast("string")))
    trimmed = F.rtrim(F.col("text"), F.lit(SPACES))
    fault = F.when(F.length(F.ltrim(trimmed, F.lit(SPACES))) == 0, "B").when(~F.substring(trimmed, -1, 1).isin(".", "!", "?"), "T").otherwise("")
    first = F.substring("role", 1, 1)
    df = turns.select(conv.alias("conv"), "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))
    df = cut_lineage(df.withColumn("row", F.monotonically_increasing_id()))
    df = df.select("*", fault.alias("fault"), F.when(first.isin("s", "u", "a"), first).otherwise("o").alias("cls"),
                   F.unhex(F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"))).alias("said"))
    by = [F.col("conv"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text"), F.col("row")]
    df = df.repartitionByRange(*by).sortWithinPartitions(*by)
    return cut_lineage(df.select("conv", F.monotonically_increasing_id().alias("place"), "turn", "role", "text", "fault", "cls", "said"))


def chunks(turns: DataFrame) -> DataFrame:
    """A written table of chunks: (conv, block, start, symbols, low, high), the last two being the conversation's blocks."""
    first = turns.where("fault <> 'B'").groupBy("conv", "said").agg(F.min("place").alias("place")).select("place", F.lit(True).alias("first"))
    kind = F.when(F.col("fault") == "B", BLANK).when(F.col("first").isNull(), DUPLICATE).when(F.col("fault") == "T", CUT).otherwise(F.lit(FINE))
    symbol = F.substring("kind", F.expr(f"locate(cls, '{CLASSES}')"), F.lit(1))
    marked = turns.select("conv", "place", "fault", "cls").join(first, "place", "left").withColumn("kind", kind)
    marked = marked.select("conv", "place", F.shiftright("place", BLOCK_BITS).alias("block"), symbol.alias("s"))
    held = F.sort_array(F.collect_list(F.struct("place", "s")))  # BLOCK turns at most
    df = cut_lineage(marked.groupBy("conv", "block").agg(held.alias("h")).select("conv", "block", F.col("h")[0].place.alias("start"), F.array_join(F.col("h.s"), "").alias("symbols")))
    ends = df.groupBy("conv").agg(F.min("block").alias("low"), F.max("block").alias("high"))
    return df.join(ends, "conv")


def _stitch_back(conv: str, parts: list[dict]) -> list[tuple]:
    """From the last chunk on: (conv, block, vector behind it, None) while the maps reach, else (conv, None, None, the vector to try)."""
    out, v = [], END
    for p in sorted(parts, key=lambda p: -p["block"]):
        out.append((conv, p["block"], _text(v), None))
        at = dict(zip(p["behind"], p["before"])).get(_text(v))
        if at is None:
            return [(conv, None, None, _text(v))]
        v = _vector(at)
    return out


def _stitch_on(conv: str, parts: list[dict]) -> list[tuple]:
    """From the first chunk on: (conv, block, state entered in, illegal pair at its start)."""
    out, q, before = [], 0, None
    for p in sorted(parts, key=lambda p: p["block"]):
        out.append((conv, p["block"], q, int(before is not None and before + p["edge"][0] not in LEGAL)))
        q, before = int(p["left"][q]), p["edge"][1]
    return out


def entries(pieces: DataFrame) -> DataFrame:
    """(conv, block, behind, entered, seam) of the chunks of conversations that have several."""
    many = cut_lineage(pieces.where("low < high").select("conv", "block", "symbols"))
    shape = "conv string, block long, behind string, try string"
    kinds = [pa.string(), pa.int64(), pa.string(), pa.string()]
    tried = many.select("conv").distinct().select("conv", F.array(F.lit(_text(ZERO)), F.lit(_text(END))).alias("wanted"))
    known = many.select("conv", "block", F.expr("CAST(array() AS array<string>)").alias("behind"), F.expr("CAST(array() AS array<string>)").alias("before"))

    def run(conv, block, symbols, behind, before, wanted):
        have = dict(zip(map(_vector, behind), map(_vector, before)))
        new = started(symbols, [v for v in map(_vector, wanted) if v not in have], have)
        have.update(new)
        yield conv, block, [_text(v) for v in have], [_text(v) for v in have.values()]

    while True:
        todo = many.join(known, ["conv", "block"]).join(tried, "conv", "left").withColumn("wanted", F.coalesce("wanted", F.expr("CAST(array() AS array<string>)")))
        known = cut_lineage(todo.mapInArrow(_rows(run, ["conv", "block", "behind", "before"], [pa.string(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.string())]),
                                            "conv string, block long, behind array<string>, before array<string>"))
        whole = known.groupBy("conv").agg(F.collect_list(F.struct("block", "behind", "before")).alias("parts"))  # an entry per chunk
        stitched = cut_lineage(whole.mapInArrow(_rows(_stitch_back, ["conv", "block", "behind", "try"], kinds), shape))
        tried = stitched.where("try IS NOT NULL").select("conv", F.array("try").alias("wanted"))
        if tried.isEmpty():
            break

    def leave(conv, block, symbols, behind):
        costs = vectors(symbols, _vector(behind))
        yield conv, block, "".join(str(trace(symbols, costs, q)[3]) for q in range(4)), CLASS[symbols[0]] + CLASS[symbols[-1]]

    left = many.join(stitched.select("conv", "block", "behind"), ["conv", "block"]).mapInArrow(
        _rows(leave, ["conv", "block", "left", "edge"], [pa.string(), pa.int64(), pa.string(), pa.string()]), "conv string, block long, left string, edge string")
    whole = left.groupBy("conv").agg(F.collect_list(F.struct("block", "left", "edge")).alias("parts"))
    on = whole.mapInArrow(_rows(_stitch_on, ["conv", "block", "entered", "seam"], [pa.string(), pa.int64(), pa.int32(), pa.int64()]), "conv string, block long, entered int, seam long")
    return stitched.select("conv", "block", "behind").join(on, ["conv", "block"])


def solved(pieces: DataFrame) -> DataFrame:
    """A written table of every chunk's edits and figures."""
    names = ["conv", "block", "start", "edits", "audit", "cost", "blank", "duplicate", "truncated", "illegal"]
    types = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()] + [pa.int64()] * 5

    def run(conv, block, start, symbols, behind, entered, seam, last):
        solve = _solved_short if len(symbols) <= 64 else _solved
        edits, audit, cost, blank, duplicate, truncated, illegal = solve(symbols, _vector(behind), entered, last)
        yield conv, block, start, edits, audit, cost, blank, duplicate, truncated, illegal + seam

    one = pieces.where("low = high").select("conv", "block", "start", "symbols", F.lit(_text(END)).alias("behind"), F.lit(0).alias("entered"), F.lit(0).cast("long").alias("seam"), F.lit(True).alias("last"))
    more = pieces.where("low < high").join(entries(pieces), ["conv", "block"]).select("conv", "block", "start", "symbols", "behind", "entered", "seam", (F.col("block") == F.col("high")).alias("last"))
    return cut_lineage(one.unionByName(more).mapInArrow(_rows(run, names, types), "conv string, block long, start long, edits string, audit string, " + ", ".join(f"{n} long" for n in names[5:])))


def _lines(it):
    """(conv, role, text) of repaired turns from rows in order, where a chunk's edits come before its turns; a conversation without
    any gives (conv, None, None). The end of a conversation is repaired when the next begins."""
    now, edits, at, q, empty = None, "", 0, 0, True

    def finish():
        for role in {1: ROLES[1:], 2: ROLES[2:]}.get(q, ()):
            yield now, role, ""
        if empty and now is not None:
            yield now, None, None

    for batch in it:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            conv, _, new, role, text = row
            if conv != now:
                yield from finish()
                now, q, empty = conv, 0, True
            if new is not None:
                edits, at = new, 0
                continue
            put, op = divmod(EDIT.index(edits[at]), 4)
            at += 1
            if put:
                yield conv, ROLES[put], ""
                q, empty = put + 1, False
            if op:
                role = role if op == 1 else ROLES[op - 1]
                yield conv, role, text
                q, empty = {"s": 1, "u": 2}.get(role[0], 3), False
    yield from finish()


def _stream(turns: DataFrame, edits: DataFrame) -> DataFrame:
    rows = turns.select("conv", "place", F.lit(None).cast("string").alias("edits"), "role", "text").unionByName(
        edits.select("conv", F.col("start").alias("place"), "edits", F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text")))
    return rows.repartition("conv").sortWithinPartitions("conv", "place", F.col("edits").isNull())


def _as_rows(it, size: int = 4096):
    held, seq, now = [], 0, None
    for conv, role, text in _lines(it):
        seq, now = (seq + 1 if conv == now else 0), conv
        if role is not None:
            held.append((conv, seq, role, text))
        if len(held) == size:
            yield _batch(held)
            held = []
    if held:
        yield _batch(held)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.int64(), pa.string(), pa.string()))], ["conv", "seq", "role", "text"])


def _as_digests(it):
    now, sha, first, out = None, None, True, []
    for conv, role, text in _lines(it):
        if conv != now:
            if now is not None:
                out.append((now, sha.hexdigest()))
            now, sha, first = conv, hashlib.sha256(), True
            if len(out) == 4096:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*out)], ["conv", "digest"])
                out = []
        if role is not None:
            sha.update((("" if first else "\n") + role + ":" + text).encode())
            first = False
    if now is not None:
        out.append((now, sha.hexdigest()))
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*out)], ["conv", "digest"])


class Repair:
    """Turns (conv_id, turn, role, text) and how they are repaired."""

    def __init__(self, turns: DataFrame) -> None:
        ship(turns.sparkSession)
        self.turns = ordered(turns)
        self.edits = solved(cut_lineage(chunks(self.turns)))

    def repaired(self) -> DataFrame:
        """(conv, seq, role, text): the turns of every conversation after its edits; conv is "c" and the id, "n" for null."""
        return _stream(self.turns, self.edits).mapInArrow(_as_rows, "conv string, seq long, role string, text string")

    def digests(self) -> DataFrame:
        """(conv, digest): SHA-256 of `role:text` lines."""
        return _stream(self.turns, self.edits).mapInArrow(_as_digests, "conv string, digest string")

    def figures(self) -> DataFrame:
        """(conv, gaps, blank, duplicate, truncated, illegal, cost, audit) of every conversation with a turn."""
        sums = [F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated", "illegal", "cost")]
        audit = F.array_join(F.sort_array(F.collect_list(F.struct("block", "audit"))).audit, "").alias("audit")  # an entry per chunk
        gaps = self.turns.select("conv", "turn").distinct().groupBy("conv").agg(F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).cast("long").alias("gaps"))
        return self.edits.groupBy("conv").agg(*sums, audit).join(gaps, "conv")


def repair_report(conversations: DataFrame, turns: DataFrame) -> DataFrame:
    """One row per conv_id of `conversations`, for the turns that are left of them."""
    fixed = Repair(turns)
    named = conversations.select("conv_id").distinct().withColumn("conv", F.when(F.col("conv_id").isNull(), "n").otherwise(F.concat(F.lit("c"), F.col("conv_id").cast("string"))))
    df = named.join(fixed.figures(), "conv", "left").join(fixed.digests(), "conv", "left")
    counts = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return df.select("conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("digest", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))


def op12(spark, d: str) -> DataFrame:
    rows = table(d, "conversations", spark)
    return repair_report(rows, damaged(rows))


OP12_SQL = r"""
WITH RECURSIVE
keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key
  FROM conversations),
-- CRC-32 of the key: per byte one step that mixes it in, and eight that shift
hashed AS (
  SELECT *, xor(list_reduce(
    list_concat([4294967295], flatten(list_transform(string_split(key, ''), lambda c: [CAST(ord(c) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))),
    lambda x, e: CASE WHEN e >= 0 THEN xor(x, e) ELSE xor(x >> 1, 3988292384 * (x & 1)) END), 4294967295) % 20 AS code
  FROM keyed),
turns AS (
  SELECT conv_id, turn, CASE code WHEN 4 THEN 'user' ELSE role END AS role,
         CASE code WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
         unnest(CASE code WHEN 3 THEN [1, 2] ELSE [1] END) AS copy
  FROM hashed WHERE code <> 0),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i,
         regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) AS last_char
  FROM turns),
judged AS (
  SELECT *, count(*) OVER c AS n, lag(role) OVER o AS before,
         CASE WHEN last_char = '' THEN 'b' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'd'
              WHEN last_char NOT IN ('.', '!', '?') THEN 't' ELSE '' END AS fault
  FROM placed WINDOW c AS (PARTITION BY conv_id), o AS (PARTITION BY conv_id ORDER BY i)),
-- least cost from each state (nothing, system, user, assistant last) to the end, before turn i; v0.. as is, w0.. without an insert first
costs AS (
  SELECT conv_id, CAST(n + 1 AS BIGINT) AS i, 0 AS v0, 10 AS v1, 5 AS v2, 0 AS v3, 0 AS w0, 0 AS w1, 0 AS w2, 0 AS w3 FROM (SELECT DISTINCT conv_id, n FROM judged)
  UNION ALL
  SELECT conv_id, i, CASE WHEN must THEN w0 ELSE least(w0, 5 + w2) END, CASE WHEN must THEN w1 ELSE least(w1, 5 + w2) END,
         CASE WHEN must THEN w2 ELSE least(w2, 5 + w3) END, CASE WHEN must THEN w3 ELSE least(w3, 5 + w2) END, w0, w1, w2, w3
  FROM (
    SELECT j.conv_id, j.i, fault IN ('b', 'd') AS must, CASE fault WHEN 't' THEN 5 ELSE 0 END AS e, left(role, 1) AS r,
           CASE WHEN must THEN 2 + v0 ELSE least(2 + v0, 1 + e + v2, CASE r WHEN 's' THEN e + v1 WHEN 'u' THEN e + v2 ELSE 999 END) END AS w0,
           CASE WHEN must THEN 2 + v1 ELSE least(2 + v1, 1 + e + v2, CASE r WHEN 'u' THEN e + v2 ELSE 999 END) END AS w1,
           CASE WHEN must THEN 2 + v2 ELSE least(2 + v2, 1 + e + v3, CASE r WHEN 'a' THEN e + v3 ELSE 999 END) END AS w2,
           CASE WHEN must THEN 2 + v3 ELSE least(2 + v3, 1 + e + v2, CASE r WHEN 'u' THEN e + v2 ELSE 999 END) END AS w3
    FROM costs c JOIN judged j ON j.conv_id IS NOT DISTINCT FROM c.conv_id AND j.i = c.i - 1)),
-- the way along the least costs, first letter in ASCII order; q: state, o: the turn's own letter, p: whether an insert comes first
way AS (
  SELECT DISTINCT conv_id, CAST(0 AS BIGINT) AS i, 0 AS q, '' AS step, '' AS line FROM judged
  UNION ALL
  SELECT conv_id, i, CASE o WHEN 'D' THEN s WHEN 'K' THEN CASE r WHEN 's' THEN 1 WHEN 'u' THEN 2 ELSE 3 END ELSE CASE s WHEN 2 THEN 3 ELSE 2 END END,
         CASE WHEN p THEN 'I' ELSE '' END || o,
         CASE WHEN p THEN CASE q WHEN 2 THEN 'assistant:' ELSE 'user:' END || chr(10) ELSE '' END ||
         CASE o WHEN 'D' THEN '' WHEN 'K' THEN role || ':' || text || chr(10) ELSE CASE s WHEN 2 THEN 'assistant' ELSE 'user' END || ':' || text || chr(10) END
  FROM (
    SELECT *, CASE WHEN must OR 2 + [v0, v1, v2, v3][s + 1] = wanted THEN 'D'
                   WHEN (r = 's' AND s = 0 AND e + v1 = wanted) OR (r = 'u' AND s <> 2 AND e + v2 = wanted) OR (r = 'a' AND s = 2 AND e + v3 = wanted) THEN 'K' ELSE 'R' END AS o
    FROM (
      SELECT j.conv_id, j.i, w.q, j.role, j.text, left(j.role, 1) AS r, j.fault IN ('b', 'd') AS must, CASE j.fault WHEN 't' THEN 5 ELSE 0 END AS e,
             [b.v0, b.v1, b.v2, b.v3][w.q + 1] AS here, [b.w0, b.w1, b.w2, b.w3] AS own, c.v0, c.v1, c.v2, c.v3,
             NOT must AND 2 + [c.v0, c.v1, c.v2, c.v3][w.q + 1] <> here AND 5 + own[CASE w.q WHEN 2 THEN 4 ELSE 3 END] = here AS p,
             CASE WHEN p THEN CASE w.q WHEN 2 THEN 3 ELSE 2 END ELSE w.q END AS s,
             own[s + 1] AS wanted
      FROM way w JOIN judged j ON j.conv_id IS NOT DISTINCT FROM w.conv_id AND j.i = w.i + 1
      JOIN costs b ON b.conv_id IS NOT DISTINCT FROM j.conv_id AND b.i = j.i JOIN costs c ON c.conv_id IS NOT DISTINCT FROM j.conv_id AND c.i = j.i + 1))),
repaired AS (
  SELECT conv_id, string_agg(step, '' ORDER BY i) || CASE arg_max(q, i) WHEN 2 THEN 'I' WHEN 1 THEN 'II' ELSE '' END AS audit,
         string_agg(line, '' ORDER BY i) || CASE arg_max(q, i) WHEN 2 THEN 'assistant:' || chr(10) WHEN 1 THEN 'user:' || chr(10) || 'assistant:' || chr(10) ELSE '' END AS lines
  FROM way GROUP BY conv_id),
counted AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate,
         count(*) FILTER (fault = 't') AS truncated, count(*) FILTER (i > 1 AND left(before, 1) || left(role, 1) NOT IN ('su', 'ua', 'au')) AS illegal
  FROM judged GROUP BY conv_id)
SELECT o.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(blank, 0) AS BIGINT) AS blank, CAST(coalesce(duplicate, 0) AS BIGINT) AS duplicate,
       CAST(coalesce(truncated, 0) AS BIGINT) AS truncated, CAST(coalesce(illegal, 0) AS BIGINT) AS illegal, CAST(coalesce(v0, 0) AS BIGINT) AS cost, coalesce(audit, '') AS audit,
       sha256(coalesce(left(lines, greatest(length(lines) - 1, 0)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o
LEFT JOIN counted c ON c.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN repaired r ON r.conv_id IS NOT DISTINCT FROM o.conv_id
LEFT JOIN costs t ON t.conv_id IS NOT DISTINCT FROM o.conv_id AND t.i = 1
"""
