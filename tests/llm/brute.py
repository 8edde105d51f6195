"""Plain forms of the operators' contracts, for small inputs."""

import hashlib
import re
from collections import Counter

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def sha(b):
    return hashlib.sha256(b).hexdigest()


def key(i):
    return (i is None, i or 0)


def substring(rows, window):
    """{place in rows: (n_words, n_removed, sha)}"""
    words = [WORD.findall((t or "").encode()) for _, t in rows]
    least = {}
    for (i, _), w in zip(rows, words):
        for k in range(len(w) - window + 1):
            x = tuple(w[k : k + window])
            least[x] = min(least.get(x, key(i)), key(i))
    out = []
    for (i, _), w in zip(rows, words):
        gone = {p for k in range(len(w) - window + 1) if least[tuple(w[k : k + window])] < key(i) for p in range(k, k + window)}
        out.append((i, len(w), len(gone), sha(b" ".join(x for p, x in enumerate(w) if p not in gone))))
    return out


def suffixes(rows, match):
    texts = [(t or "").encode() for _, t in rows]
    n = Counter(hash(t[k : k + match]) for t in texts for k in range(len(t) - match + 1))
    out = []
    for (i, _), t in zip(rows, texts):
        gone = bytearray(len(t))
        for k in range(len(t) - match + 1):
            if n[hash(t[k : k + match])] > 1:
                gone[k : k + match] = b"\1" * match
        spans = len(re.findall(rb"\x01+", bytes(gone)))
        out.append((i, len(t), sum(gone), spans, sha(bytes(c for c, g in zip(t, gone) if not g))))
    return out


def shingles(text):
    w = WORD.findall((text or "").encode().lower())
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def near(rows):
    """[(id, n_shingles, component_id, kept)] for rows with ids that differ."""
    sets = {i: shingles(t) for i, t in rows}
    return [(i, len(sets[i]), c, c == i) for i, c in components(sets, lambda a, b: bool(a and b) and 100 * len(a & b) >= 75 * len(a | b))]


def components(items, linked):
    name = {i: i for i in items}
    ids = sorted(items)
    changed = True
    links = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if linked(items[a], items[b])]
    while changed:
        changed = False
        for a, b in links:
            m = min(name[a], name[b])
            if name[a] != m or name[b] != m:
                name[a] = name[b] = m
                changed = True
    return sorted(name.items())


def statistics(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    wins = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
    n = Counter(wins)
    covered = {p for k, x in enumerate(wins) if n[x] > 1 for p in (k, k + 1, k + 2)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered))


def targets(sizes, weights=(3, 1, 2), share=1.5, most=2):
    """{source: target}, by pouring the excess again and again."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[k % 3] for k, s in enumerate(names)}
    full, rest = {}, share * sum(sizes.values())
    while True:
        free = [s for s in names if s not in full]
        level = {s: rest * w[s] / sum(w[x] for x in free) for s in free}
        over = [s for s in free if level[s] >= most * sizes[s]]
        if not over:
            return full | level
        for s in over:
            full[s] = most * sizes[s]
            rest -= full[s]
