"""Plain versions of the operators, for small inputs."""

import hashlib
import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def cut(units, width):
    """Which units of each text lie in a window that starts anywhere else."""
    seen = Counter(tuple(u[p: p + width]) for u in units for p in range(len(u) - width + 1))
    out = []
    for u in units:
        gone = [False] * len(u)
        for p in range(len(u) - width + 1):
            if seen[tuple(u[p: p + width])] > 1:
                gone[p: p + width] = [True] * width
        out.append(gone)
    return out


def op1(rows, width=35):
    words = [WORD.findall(t or "") for _, t in rows]
    return sorted(((i, len(w), sum(g), sha(" ".join(x for x, y in zip(w, g) if not y).encode()))
                   for (i, _), w, g in zip(rows, words, cut(words, width))), key=repr)


def op5(rows, width=400):
    data = [(t or "").encode() for _, t in rows]
    out = []
    for (i, _), b, g in zip(rows, data, cut(data, width)):
        spans = sum(y and (k == 0 or not g[k - 1]) for k, y in enumerate(g))
        out.append((i, len(b), sum(g), spans, sha(bytes(x for x, y in zip(b, g) if not y))))
    return sorted(out, key=repr)


def op3(text):
    words = WORD.findall(text or "")
    seen = Counter(tuple(words[p: p + 3]) for p in range(len(words) - 2))
    hit = {p + k for p in range(len(words) - 2) if seen[tuple(words[p: p + 3])] > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return (len(words), sum(map(len, words)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(hit))


def op6(rows, items, width=10):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    windows = defaultdict(set)
    for i, t in items:
        w = word.findall((t or "").translate(LOWER))
        for p in range(max(len(w) - width + 1, 1) if w else 0):
            windows[tuple(w[p: p + width])].add(i)
    out = []
    for i, t in rows:
        w = word.findall((t or "").translate(LOWER))
        hit, ids = set(), set()
        for n in {len(x) for x in windows}:
            for p in range(len(w) - n + 1):
                if tuple(w[p: p + n]) in windows:
                    hit |= set(range(p, p + n))
                    ids |= windows[tuple(w[p: p + n])]
        ids = sorted(map(str, ids))
        out.append((i, len(w), len(hit), len(ids), sha(",".join(ids).encode()), bool(hit)))
    return sorted(out, key=repr)


def op10(rows, size=4, percent=85):
    sets = []
    for _, t in rows:
        w = WORD.findall((t or "").translate(LOWER))
        sets.append({tuple(w[p: p + size]) for p in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set()))
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= percent * len(sets[a] | sets[b]):
                root[find(a)] = find(b)
    least = {}
    for a, (i, _) in enumerate(rows):
        if i is not None:
            least[find(a)] = min(i, least.get(find(a), i))
    return sorted(((i, len(s), least.get(find(a)) if s else i) for a, ((i, _), s) in enumerate(zip(rows, sets))), key=repr)
