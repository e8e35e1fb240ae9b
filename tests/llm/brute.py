"""Plain versions of the operators, for small inputs."""

import hashlib
import re
from collections import Counter


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def substring(docs, window=35):
    """docs: distinct (doc_id, text); gives (doc_id, n_words, n_removed, kept_sha256)."""
    cut = [(i, words(t)) for i, t in docs]
    seen = Counter(tuple(w[p : p + window]) for _, w in cut for p in range(len(w) - window + 1))
    out = []
    for i, w in cut:
        gone = [False] * len(w)
        for p in range(len(w) - window + 1):
            if seen[tuple(w[p : p + window])] > 1:
                gone[p : p + window] = [True] * window
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out.append((i, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def suffix(docs, size=100):
    """docs: distinct (doc_id, text) in order; gives (doc_id, n_bytes, n_removed, n_spans, kept_sha256)."""
    seen, out = set(), []
    for i, t in docs:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - size + 1):
            if b[p : p + size] in seen:
                gone[p : p + size] = b"\x01" * size
            seen.add(b[p : p + size])
        spans = len(re.findall(b"\x01+", bytes(gone)))
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def fingerprint(text, size=3):
    import xxhash

    w = words(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    s = [" ".join(w[i : i + size]) for i in range(len(w) - size + 1)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def simhash(docs, size=3, radius=2):
    """docs: (doc_id, text); gives (doc_id, fingerprint, component_id)."""
    prints = [(i, fingerprint(t, size)) for i, t in docs]
    root = list(range(len(prints)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(prints)):
        for b in range(a):
            if (prints[a][1] ^ prints[b][1]).bit_count() <= radius:
                root[find(a)] = find(b)
    low = {}
    for k, (i, _) in enumerate(prints):
        low[find(k)] = min(low.get(find(k), i), i)
    return [(i, f"{f:016x}", low[find(k)]) for k, (i, f) in enumerate(prints)]
