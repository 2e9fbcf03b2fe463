"""Plain Python versions of what the operators compute."""

import hashlib
import re
from collections import Counter, defaultdict

WORD = re.compile("[^\x20\x09-\x0d]+")
AZ = {c: c + 32 for c in range(65, 91)}


def words(text):
    return WORD.findall(text or "")


def shingle_set(text, width=5):
    w = words((text or "").translate(AZ))
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())


def components(rows):
    """{doc: smallest doc reachable} for (doc, text) rows."""
    sets = [(d, shingle_set(t)) for d, t in rows]
    root = {d: d for d, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (a, s) in enumerate(sets):
        for b, t in sets[:i]:
            if s and t and 100 * len(s & t) >= 80 * len(s | t):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {d: find(d) for d in root}


def water(sizes, weights=(3, 1, 2), share=1.5, most=2):
    """{source: target} by sharing again and again what stands above a limit."""
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, out, open_ = share * sum(sizes.values()), {}, set(order)
    while open_:
        unit = left / sum(w[s] for s in open_)
        full = {s for s in open_ if unit * w[s] >= most * sizes[s]}
        if not full:
            return out | {s: unit * w[s] for s in open_}
        out |= {s: float(most * sizes[s]) for s in full}
        left -= sum(most * sizes[s] for s in full)
        open_ -= full
    return out


def base_secrets(text):
    text, spans = text or "", []
    assign = r"""((?:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    a = [(m.start(), 0, m.end()) for m in re.finditer(assign, text, re.I | re.A) if len(m[2]) >= 12]
    k = [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    h = [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    spans = sorted(a + k + h)
    listing = ",".join(f"{('assign', 'access', 'hex')[k]}:{s}:{e}" for s, k, e in spans)
    return len(a), len(k), len(h), listing, hashlib.sha256(listing.encode()).hexdigest()


def quality(text):
    text = text or ""
    w = words(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    grams = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    hit = {i + k for i in range(len(w) - 7) if grams[tuple(w[i : i + 8])] > 1 for k in range(8)}
    n = (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), dup, len(hit))
    return *n, n[0] < 20 or 100 * n[4] > 30 * n[0]


def contamination(rows, items):
    """{doc: (n_words, n_hit, ids)} for documents and benchmark items."""
    cut = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
    tok = lambda t: cut.findall((t or "").translate(AZ))
    index = defaultdict(set)
    for i, t in items:
        w = tok(t)
        for k in range(max(1, len(w) - 12) if w else 0):
            index[tuple(w[k : k + 13])].add(str(i))
    sizes, out = {len(k) for k in index}, []
    for d, t in rows:
        w, hit, ids = tok(t), set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                if found := index.get(tuple(w[k : k + n])):
                    hit.update(range(k, k + n))
                    ids |= found
        listing = ",".join(sorted(ids))
        out.append((d, len(w), len(hit), len(ids), hashlib.sha256(listing.encode()).hexdigest(), len(hit) > 0 and 20 * len(hit) >= len(w)))
    return out
