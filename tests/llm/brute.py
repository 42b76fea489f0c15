"""Direct definitions of the operators, for small inputs."""

import hashlib
import re
from collections import defaultdict

LOWER = {c: c + 32 for c in range(65, 91)}


def sha(x) -> str:
    return hashlib.sha256(x.encode() if isinstance(x, str) else x).hexdigest()


def decontaminate(docs, items):
    word = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
    split = lambda t: word.findall((t or "").translate(LOWER))
    windows = defaultdict(set)
    for i, t in items:
        w = split(t)
        for s in range(max(1, len(w) - 9) if w else 0):
            windows[tuple(w[s:s + 10])].add(i)
    lengths = {len(w) for w in windows}
    out = []
    for d, t in docs:
        w = split(t)
        hit, found = set(), set()
        for n in lengths:
            for s in range(len(w) - n + 1):
                got = windows.get(tuple(w[s:s + n]))
                if got:
                    hit.update(range(s, s + n))
                    found |= got
        ids = sorted(str(i) for i in found if i is not None)
        out.append((d, len(w), len(hit), len(ids), sha(",".join(ids)), bool(hit)))
    return out


def line_dedup(docs):
    strip = " \t\n\r\x0b\x0c"
    key = lambda s: s.strip(strip).translate(LOWER)
    holders = defaultdict(set)
    for d, t in docs:
        for x in (t or "").split("\n"):
            if len(key(x)) >= 20:
                holders[key(x)].add(d)
    out = []
    for d, t in docs:
        lines = (t or "").split("\n")
        keep = [x for x in lines if not (len([h for h in holders.get(key(x), ()) if h is not None]) >= 3
                                         and d != max(h for h in holders[key(x)] if h is not None))]
        out.append((d, len(lines), len(lines) - len(keep), sha("\n".join(keep))))
    return out


def shingles(t):
    w = re.findall("[^\x20\x09-\x0d]+", (t or "").translate(LOWER))
    if not w:
        return set()
    return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))}


def near_duplicates(docs):
    sets = [shingles(t) for _, t in docs]
    parent = list(range(len(docs)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]):
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(docs):
        if d is not None:
            r = find(i)
            least[r] = min(least.get(r, d), d)
    return [(d, len(sets[i]), least.get(find(i)), d is not None and d == least.get(find(i)))
            for i, (d, _) in enumerate(docs)]


def repeats(docs, n=400):
    raw = [(t or "").encode() for _, t in docs]
    seen = defaultdict(int)
    for b in raw:
        for s in range(len(b) - n + 1):
            seen[b[s:s + n]] += 1
    out = []
    for (d, _), b in zip(docs, raw):
        gone = bytearray(len(b))
        for s in range(len(b) - n + 1):
            if seen[b[s:s + n]] > 1:
                gone[s:s + n] = b"\x01" * n
        kept = bytes(x for x, g in zip(b, gone) if not g)
        spans = sum(1 for i in range(len(b)) if gone[i] and (i == 0 or not gone[i - 1]))
        out.append((d, len(b), sum(gone), spans, sha(kept)))
    return out
