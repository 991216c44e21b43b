"""Plain Python versions of the operators' results, for small inputs."""

import collections
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
AZ = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall((text or "").translate(AZ))


def shingles(text, k=5):
    w = words(text)
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def jaccard_components(rows, num=75, den=100):
    """[(id, text)] -> {id: (n_shingles, component)}; every pair is compared through an inverted index."""
    sets = {i: shingles(t) for i, t in rows}
    index = {}
    for i, s in sets.items():
        for g in s:
            index.setdefault(g, []).append(i)
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for i, s in sets.items():
        both = {}
        for g in s:
            for j in index[g]:
                if j > i:
                    both[j] = both.get(j, 0) + 1
        for j, n in both.items():
            if den * n >= num * (len(s) + len(sets[j]) - n):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: (len(s), find(i)) for i, s in sets.items()}


def repeated_words(rows, size=51):
    """[(id, text)] -> [words in strings of ``size`` words that also start elsewhere], row by row."""
    texts = [WORD.findall(t or "") for _, t in rows]
    seen = collections.Counter(tuple(t[p : p + size]) for t in texts for p in range(len(t) - size + 1))
    return [len({k for p in range(len(t) - size + 1) if seen[tuple(t[p : p + size])] > 1 for k in range(p, p + size)}) for t in texts]


def repeated_bytes(rows, length=400):
    """[(id, text)] -> {id: (n_bytes, n_removed, n_spans, kept bytes)} by a dictionary of every window."""
    seen = {}
    raws = [(i, (t or "").encode()) for i, t in rows]
    for _, raw in raws:
        for p in range(len(raw) - length + 1):
            w = hash(raw[p : p + length])
            seen[w] = seen.get(w, 0) + 1
    out = {}
    for i, raw in raws:
        cover = bytearray(len(raw))
        for p in range(len(raw) - length + 1):
            if seen[hash(raw[p : p + length])] > 1:
                cover[p : p + length] = b"\1" * length
        spans = sum(1 for k in range(len(raw)) if cover[k] and (k == 0 or not cover[k - 1]))
        out[i] = (len(raw), sum(cover), spans, bytes(b for b, c in zip(raw, cover, strict=True) if not c))
    return out
