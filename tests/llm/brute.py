"""The operators' contracts in plain Python, text by text."""

import base64
import hashlib
import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(text):
    return hashlib.sha256(text if isinstance(text, bytes) else text.encode()).hexdigest()


def rules(text):
    text = text or ""
    w = WORD.findall(text)
    lines, seen, dup = text.split("\n"), set(), 0
    for x in lines:
        if WORD.search(x):
            dup += x in seen
            seen.add(x)
    n = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    hit = {j for i in range(len(w) - 4) if n[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
    failed = len(w) < 10 or 100 * len(hit) > 20 * len(w)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), dup, len(hit), failed


def lines(rows, min_chars=40, min_docs=5):
    """rows: (id, text). Returns (id, n_lines, n_dropped, kept text)."""
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(LOWER)
    docs = defaultdict(set)
    for i, t in rows:
        for x in (t or "").split("\n"):
            if len(key(x)) >= min_chars and i is not None:
                docs[key(x)].add(i)
    out = []
    for i, t in rows:
        parts = (t or "").split("\n")
        kept = [x for x in parts if i is None or len(docs[key(x)]) < min_docs or max(docs[key(x)]) == i]
        out.append((i, len(parts), len(parts) - len(kept), "\n".join(kept)))
    return out


def shingles(text):
    w = WORD.findall((text or "").translate(LOWER))
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)])


def components(rows):
    """rows: (id, text). Returns (id, shingles, component), by all pairs that share a shingle."""
    sets = [shingles(t) for _, t in rows]
    held, parent = defaultdict(list), list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, s in enumerate(sets):
        for x in s:
            held[x].append(i)
    for i, s in enumerate(sets):
        if rows[i][0] is None:
            continue
        both = Counter(j for x in s for j in held[x] if j < i and rows[j][0] is not None)
        for j, n in both.items():
            if 100 * n >= 75 * (len(s) + len(sets[j]) - n):
                parent[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(d, least.get(root(i), d))
    return [(d, len(sets[i]), least.get(root(i))) for i, (d, _) in enumerate(rows)]


def contamination(text, items, window=13):
    """items: (id, text). Returns n_words, n_hit, ids as sorted strings, verdict."""
    w = ALNUM.findall((text or "").translate(LOWER))
    hit, found = set(), set()
    joined = " " + " ".join(w) + " "
    at = defaultdict(list)
    for i, x in enumerate(w):
        at[x].append(i)
    for name, t in items:
        own = ALNUM.findall((t or "").translate(LOWER))
        k = min(window, len(own))
        for a in range(len(own) - k + 1 if own else 0):
            part = own[a : a + k]
            if " " + " ".join(part) + " " in joined:
                found |= {str(name)} - {"None"}
                for i in at[part[0]]:
                    if w[i : i + k] == part:
                        hit.update(range(i, i + k))
    return len(w), len(hit), sorted(found), bool(hit) and 20 * len(hit) >= len(w)


def warc(rows):
    """rows: (id, html). Returns (id, bytes, digest, type, refers_to) of rows with distinct ids."""
    best = {}
    for i, h in rows:
        p = (h or "").encode()
        best[p] = max(best.get(p, i), i)
    out = []
    for i, h in rows:
        p = (h or "").encode()
        first = best[p]
        out.append((i, len(p), base64.b32encode(hashlib.sha1(p).digest()).decode(), "response" if i == first else "revisit", None if i == first else first))
    return out
