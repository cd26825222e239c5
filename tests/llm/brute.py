"""Plain versions of the operators, for small tables."""

import hashlib
import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sha(data):
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


def components(nodes, links):
    parent = {n: n for n in nodes}

    def root(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def passages(docs, window):
    """{id: (words, removed, kept text)} for (id, text) pairs with distinct ids."""
    words = {i: WORD.findall(t or "") for i, t in docs}
    times = Counter(tuple(w[p : p + window]) for w in words.values() for p in range(len(w) - window + 1))
    out = {}
    for i, w in words.items():
        gone = set()
        for p in range(len(w) - window + 1):
            if times[tuple(w[p : p + window])] > 1:
                gone.update(range(p, p + window))
        out[i] = (len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone))
    return out


def earlier_copies(docs, length):
    """{id: (bytes, removed, spans, kept bytes)} for (id, text) pairs with distinct ids."""
    data = {i: (t or "").encode() for i, t in docs}
    first = {}
    for i in sorted(data):
        for p in range(len(data[i]) - length + 1):
            first.setdefault(data[i][p : p + length], i)
    out = {}
    for i, b in data.items():
        gone = set()
        for p in range(len(b) - length + 1):
            if first[b[p : p + length]] < i:
                gone.update(range(p, p + length))
        spans = sum(p - 1 not in gone for p in gone)
        out[i] = (len(b), len(gone), spans, bytes(x for k, x in enumerate(b) if k not in gone))
    return out


def shingles(text, size=4):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    if len(words) < size:
        return {tuple(words)} if words else set()
    return {tuple(words[k : k + size]) for k in range(len(words) - size + 1)}


def jaccard(docs, percent=85):
    """{id: (shingles, component)} for (id, text) pairs with distinct ids."""
    sets = {i: shingles(t) for i, t in docs}
    holders = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            holders[x].append(i)
    links = []
    for i, s in sets.items():
        for j, both in Counter(j for x in s for j in holders[x] if j > i).items():
            if 100 * both >= percent * (len(s) + len(sets[j]) - both):
                links.append((i, j))
    found = components(sets, links)
    return {i: (len(s), found[i]) for i, s in sets.items()}


PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def personal(text):
    """(start, kind, end) of the fixed patterns."""
    out = []
    for order, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in re.finditer(pattern, text or ""):
            digits = [int(c) for c in re.sub("[^0-9]", "", m.group())]
            if kind == "ip" and any(int(p) > 255 for p in m.group().split(".")):
                continue
            if kind == "card":
                doubled = [d if k % 2 == 0 else 2 * d for k, d in enumerate(reversed(digits))]
                if not 12 <= len(digits) <= 19 or sum(d // 10 + d % 10 for d in doubled) % 10:
                    continue
            if kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            out.append((m.start(), order, m.end()))
    return sorted(out)
