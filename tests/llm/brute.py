"""Plain re-statements of the operators, for small inputs."""

from __future__ import annotations

import math
import re
from collections import Counter

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text, width):
    words = text.encode().lower().split() if text else []
    own = min(width, len(words))
    return {tuple(words[i : i + own]) for i in range(len(words) - own + 1)} if own else set()


def components(docs, width, percent):
    """{(doc_id, text): (set size, lowest id reachable)} by comparing all pairs."""
    rows = sorted({(i, t) for i, t in docs if i is not None}, key=lambda r: (r[0], r[1] or ""))
    sets = [shingles(t, width) for _, t in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            common = len(sets[a] & sets[b])
            if common and 100 * common >= percent * len(sets[a] | sets[b]):
                low, high = sorted((root(a), root(b)))
                parent[high] = low
    return {row: (len(s), rows[root(i)][0]) for i, (row, s) in enumerate(zip(rows, sets))}


def contained(docs, items, width=5, percent=80):
    out = set()
    for doc_id, text in docs:
        for item, wanted in items:
            words = wanted.encode().lower().split() if wanted else []
            own = min(width, len(words))
            needle = shingles(wanted, width)
            have = (text or "").encode().lower().split()
            runs = {tuple(have[i : i + own]) for i in range(len(have) - own + 1)} if own else set()
            if needle and doc_id is not None and 100 * len(needle & runs) >= percent * len(needle):
                out.add((doc_id, item))
    return out


def removed_lines(docs, least):
    """{(doc_id, text): removed line numbers}: every run of at least ``least`` words with an earlier occurrence."""
    rows = sorted({(i, t) for i, t in docs if t is not None}, key=lambda r: r[0])
    kept = []
    for _, text in rows:
        lines = text.split("\n")
        kept.append([(i, x, len(WORD.findall(x))) for i, x in enumerate(lines) if WORD.search(x)])
    seen, out = set(), {}
    for row, lines in zip(rows, kept):
        gone = set()
        for p in range(len(lines)):
            words = 0
            for q in range(p, len(lines)):
                words += lines[q][2]
                if words >= least:
                    run = tuple(x for _, x, _ in lines[p : q + 1])
                    if run in seen:
                        gone |= {i for i, _, _ in lines[p : q + 1]}
                    elif q - p > 12:
                        break
                    seen.add(run)
        out[row] = sorted(gone)
    return out


def water_filling(sizes):
    """Targets of sources by name (None last): weights 1, 2, 3, repeating; three times the size at most."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    rest, free, out = float(sum(sizes.values())), set(names), {}
    while free:
        level = rest / sum(weight[s] for s in free)
        full = {s for s in free if level * weight[s] >= 3 * sizes[s]}
        if not full:
            return out | {s: level * weight[s] for s in free}
        for s in full:
            out[s] = 3.0 * sizes[s]
            rest -= out[s]
        free -= full
    return out


def merges_count(text, vocabulary, ranks, pattern, symbols):
    """Tokens by merging the lowest-ranked pair of each pre-token again and again."""
    total = 0
    for word in pattern.findall(text):
        parts = [symbols[b] for b in word.encode()]
        while True:
            pairs = [(ranks.get((a, b), math.inf), i) for i, (a, b) in enumerate(zip(parts, parts[1:]))]
            best = min(pairs, default=(math.inf, 0))
            if best[0] == math.inf:
                break
            i = best[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        total += len(parts)
    return total


def lz_phrases(text):
    phrases, pending = set(), ""
    for char in text:
        pending += char
        if pending not in phrases:
            phrases.add(pending)
            pending = ""
    return phrases


def cosine(a, b, idf, unseen):
    def vector(text):
        return {t: n * idf.get(t, unseen) for t, n in Counter(re.findall(r"[^\W_]+", text.lower())).items()}

    x, y = vector(a), vector(b)
    norms = math.sqrt(sum(v * v for v in x.values())) * math.sqrt(sum(v * v for v in y.values()))
    return sum(v * y[t] for t, v in x.items() if t in y) / norms if norms else 0.0
