"""Plain versions of the operators, for small inputs."""

import hashlib
import re


def shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def components(docs):
    """doc_id -> least id reachable over links of 75 %."""
    sets, parent = {d: shingles(t) for d, t in docs.items()}, {d: d for d in docs}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(docs)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {d: find(d) for d in docs}


def removed(docs, length=50):
    """doc_id -> (n_bytes, n_removed, n_spans, sha of the rest)."""
    first, out = {}, {}
    data = {d: (t or "").encode() for d, t in docs.items()}
    for d in sorted(data):
        for i in range(len(data[d]) - length + 1):
            first.setdefault(data[d][i : i + length], d)
    for d, t in data.items():
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if first[t[i : i + length]] < d:
                gone[i : i + length] = b"\1" * length
        rest = bytes(c for c, g in zip(t, gone) if not g)
        out[d] = len(t), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(rest).hexdigest(), rest
    return out


def prose(rng, words, vocabulary=3000):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(words))
