"""Plain Python versions of the operators, for small inputs."""

import collections
import re

SPACE_WORDS = re.compile(r"[^\x20\x09-\x0D]+")
BENCH_WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(s):
    return s.translate({c: c + 32 for c in range(65, 91)})


def components(rows, k, percent):
    """{id: (set size, smallest id reached)} of (id, text) rows."""
    sets = {}
    for i, text in rows:
        w = SPACE_WORDS.findall(lower(text or ""))
        grams = [tuple(w[j : j + k]) for j in range(len(w) - k + 1)] or ([tuple(w)] if w else [])
        sets[i] = frozenset(grams)
    low = {i: i for i in sets}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    for _ in sets:
        for a, b in links:
            low[a] = low[b] = min(low[a], low[b])
    return {i: (len(s), low[i]) for i, s in sets.items()}


def statistics(text):
    text = text or ""
    w = SPACE_WORDS.findall(text)
    seen = collections.Counter(tuple(w[j : j + 8]) for j in range(len(w) - 7))
    hit = {p for j in range(len(w) - 7) if seen[tuple(w[j : j + 8])] > 1 for p in range(j, j + 8)}
    lines = [x for x in text.split("\n") if SPACE_WORDS.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit)


def dedup_lines(rows, min_chars=20, min_docs=3):
    def key(x):
        return lower(x.strip(" \t\n\x0b\x0c\r"))

    held = collections.defaultdict(set)
    for i, text in rows:
        for x in (text or "").split("\n"):
            if len(key(x)) >= min_chars:
                held[key(x)].add(i)
    out = {}
    for i, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if len(held.get(key(x), ())) < min_docs or max(held[key(x)]) == i]
        out[i] = (len(lines), len(lines) - len(kept), "\n".join(kept))
    return out


def contamination(rows, items, window=10):
    windows = collections.defaultdict(set)
    for i, text in items:
        w = BENCH_WORDS.findall(lower(text or ""))
        k = min(window, len(w))
        for j in range(len(w) - k + 1 if k else 0):
            windows[tuple(w[j : j + k])].add(str(i))
    out = {}
    for i, text in rows:
        w = BENCH_WORDS.findall(lower(text or ""))
        hit, found = set(), set()
        for key, names in windows.items():
            for j in range(len(w) - len(key) + 1):
                if tuple(w[j : j + len(key)]) == key:
                    hit.update(range(j, j + len(key)))
                    found |= names
        out[i] = (len(w), len(hit), sorted(found), bool(hit))
    return out
