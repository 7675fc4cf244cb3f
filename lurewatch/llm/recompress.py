"""Recompression of word sequences: rounds that name pairs and runs, the same everywhere in the corpus.

A round splits the names into left and right ones by a hash bit and names every pair (left, right); then it names every
maximal run of one name. A name is a fingerprint of its parts, so all tasks agree on it without a dictionary. What a
symbol becomes depends on its own words and a few beside it. Every symbol therefore carries its context: the word range
that settles it. Wherever a range holds that context, it holds the same symbol, so equal ranges share all symbols that
are settled inside them.
"""

from __future__ import annotations

import numpy as np

from lurewatch.llm.common import BASES, U64, mix

ROUNDS = 5
_INDEX_BITS = 26
#: Longer symbols are not preferred beyond this many words: short contexts leave more windows to each symbol.
PREFER = 3


def symbols(names: np.ndarray, doc_start: np.ndarray, doc_end: np.ndarray, width: int):
    """All symbols settled by at most `width` words: (name, start, end, left, right), in order of round and start.

    doc_start and doc_end give each word's text as a word range; left and right are the context, -1 or +1 beyond the text
    where the end of the text itself took part."""
    n = len(names)
    word = names
    start, end = np.arange(n), np.arange(n) + 1
    left, right = start, end
    ds, de = doc_start, doc_end  # by first word of a symbol
    found = [(names, start, end, left, right)]
    name = names
    with np.errstate(over="ignore"):
        for level in range(ROUNDS):
            if len(name) < 2:
                break
            # pairs
            bit = (mix(name + BASES[0] * U64(2 * level + 1)) >> U64(63)).astype(bool)
            joined = np.zeros(len(name), bool)  # symbol i pairs with i + 1
            joined[:-1] = ~bit[:-1] & bit[1:] & (end[:-1] < de[:-1])
            second = np.zeros(len(name), bool)
            second[1:] = joined[:-1]
            nl = np.where(start > ds, np.concatenate((left[:1], left[:-1])), ds - 1)
            nr = np.where(end < de, np.concatenate((right[1:], right[-1:])), de + 1)
            ll = np.where(start > ds, np.concatenate((right[:1], right[:-1])), right)  # the right context of the left neighbour
            rr = np.where(end < de, np.concatenate((left[1:], left[-1:])), left)
            # a left symbol looks right, a right symbol looks left
            new_left = np.where(bit, np.minimum(left, nl), np.minimum(left, rr))
            new_right = np.where(bit, np.maximum(right, ll), np.maximum(right, nr))
            nxt = np.flatnonzero(joined) + 1
            pair = mix(name[nxt - 1] * BASES[1] + mix(name[nxt] + U64(1)))
            name, end = name.copy(), end.copy()
            name[nxt - 1] = pair
            end[nxt - 1] = end[nxt]
            keep = ~second
            made = joined[keep]
            name, start, end, left, right, ds, de = name[keep], start[keep], end[keep], new_left[keep], new_right[keep], ds[keep], de[keep]
            fresh = made & (right - left <= width)
            found.append((name[fresh], start[fresh], end[fresh], left[fresh], right[fresh]))
            # runs
            same = np.zeros(len(name), bool)  # symbol i equals i + 1
            same[:-1] = (name[:-1] == name[1:]) & (end[:-1] < de[:-1])
            head = np.ones(len(name), bool)
            head[1:] = ~same[:-1]
            at = np.flatnonzero(head)
            last = np.append(at[1:], len(name)) - 1
            long = last > at
            has_l, has_r = start[at] > ds[at], end[last] < de[last]
            before, after = np.maximum(at - 1, 0), np.minimum(last + 1, len(name) - 1)
            lw = word[np.maximum(start[at] - 1, 0)] != word[end[at] - 1]
            rw = word[np.minimum(end[last], n - 1)] != word[start[at]]
            # the next word already tells a neighbour apart, or else the whole neighbour is needed
            part_l, part_r = ~long & has_l & lw, ~long & has_r & rw
            lo = np.where(part_l, np.minimum(left[at], start[at] - 1), np.where(has_l, np.minimum(left[at], left[before]), ds[at] - 1))
            hi = np.where(part_r, np.maximum(right[last], end[last] + 1), np.where(has_r, np.maximum(right[last], right[after]), de[last] + 1))
            lo = np.where(has_r & ~part_r, np.minimum(lo, left[after]), lo)
            hi = np.where(has_l & ~part_l, np.maximum(hi, right[before]), hi)
            lo = np.minimum(lo, np.minimum.reduceat(left, at))
            hi = np.maximum(hi, np.maximum.reduceat(right, at))
            run = name[at]
            run = np.where(long, mix(run * BASES[0] + (last - at).astype(U64)), run)
            name, start, end, left, right, ds, de = run, start[at], end[last], lo, hi, ds[at], de[at]
            fresh = long & (right - left <= width)
            found.append((name[fresh], start[fresh], end[fresh], left[fresh], right[fresh]))
            if not np.any(right - left <= width):
                break
    return tuple(np.concatenate(c) for c in zip(*found))


def anchors(found, first: np.ndarray, width: int):
    """For every window of `width` words inside a text, the longest symbol settled in it (ties: by name, then by round
    and place; a choice that depends on the window's words alone).

    Returns (window start of each run of windows with one anchor, number of windows, index of the symbol in `found`)."""
    name, start, end, left, right = found
    n = int(first[-1])
    fits = right - left <= width
    # windows that hold the context, kept to the windows of the symbol's own text
    text = np.searchsorted(first, start, "right") - 1
    a, b = np.maximum(right - width, first[text]), np.minimum(left, first[text + 1] - width)
    use = np.flatnonzero(fits & (a <= b))
    if not len(use):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    if len(name) >= 1 << _INDEX_BITS:
        raise ValueError("a single text with too many words")
    length = np.minimum(end - start, PREFER).astype(U64)
    value = (length << U64(58)) | ((name >> U64(32)) << U64(_INDEX_BITS)) | (U64((1 << _INDEX_BITS) - 1) - np.arange(len(name), dtype=U64))
    a, b, value = a[use], b[use], value[use]
    span = b - a + 1
    k = np.frexp(span.astype(np.float64))[1] - 1  # floor(log2)
    top = int(k.max())
    layers = [np.zeros(n, U64) for _ in range(top + 1)]
    for j in range(top + 1):
        pick = k == j
        np.maximum.at(layers[j], a[pick], value[pick])
        np.maximum.at(layers[j], b[pick] - (1 << j) + 1, value[pick])
    for j in range(top, 0, -1):
        half = 1 << (j - 1)
        np.maximum(layers[j - 1], layers[j], out=layers[j - 1])
        np.maximum(layers[j - 1][half:], layers[j][:-half], out=layers[j - 1][half:])
    best = layers[0]
    change = np.ones(n, bool)
    change[1:] = best[1:] != best[:-1]
    change[first[:-1][first[:-1] < n]] = True
    at = np.flatnonzero(change)
    count = np.diff(np.append(at, n))
    real = best[at] > 0
    at, count = at[real], count[real]
    return at, count, (U64((1 << _INDEX_BITS) - 1) - (best[at] & U64((1 << _INDEX_BITS) - 1))).astype(np.int64)
