"""Plain versions of the operators, one text at a time or all pairs."""

from __future__ import annotations

import itertools
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
PLAIN = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def plain_words(text):
    return PLAIN.findall((text or "").translate(LOWER))


def shingles(text, size=5):
    words = WORD.findall((text or "").translate(LOWER))
    size = min(size, len(words))
    return {tuple(words[i : i + size]) for i in range(len(words) - size + 1)} if words else set()


def components(rows, percent=75):
    """{id: least id reachable} over (id, text) rows."""
    sets = {}
    for i, text in rows:
        sets.setdefault(i, []).append(shingles(text))
    least = {i: i for i in sets}

    def root(i):
        while least[i] != i:
            i = least[i]
        return i

    for a, b in itertools.combinations(sorted(sets), 2):
        for x, y in itertools.product(sets[a], sets[b]):
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                a2, b2 = root(a), root(b)
                least[max(a2, b2)] = min(a2, b2)
    return {i: root(i) for i in sets}


def hits(text, items, n=10):
    """(words, hit words, item ids) of a text against (id, text) items."""
    words = plain_words(text)
    hit, found = set(), set()
    for item, body in items:
        own = plain_words(body)
        size = min(n, len(own))
        windows = {tuple(own[i : i + size]) for i in range(len(own) - size + 1)} if own else set()
        for i in range(len(words) - size + 1 if size else 0):
            if tuple(words[i : i + size]) in windows:
                hit.update(range(i, i + size))
                found.add(str(item))
    return len(words), len(hit), sorted(found)


def repeated_words(rows, size=50):
    """{id: words inside a window that an earlier (id, place) has too} over distinct ids."""
    seen, out = set(), {}
    for i, text in sorted(rows):
        words = WORD.findall((text or "").translate(LOWER))
        inside = set()
        for at in range(len(words) - size + 1):
            window = tuple(words[at : at + size])
            if window in seen:
                inside.update(range(at, at + size))
            seen.add(window)
        out[i] = inside
    return out
