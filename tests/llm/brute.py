"""Plain versions of the operators for small tables."""

from __future__ import annotations

import hashlib
import re
from collections import Counter

import numpy as np

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)",
    "card": r"[0-9](?:[\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def words(text: str | None) -> list[bytes]:
    return WORD.findall(bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode()))


def shingles(text: str | None) -> frozenset:
    w = words(text)
    return frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def groups(rows: list[tuple[int, str | None]]) -> dict[int, tuple[int, int]]:
    sets = [(i, shingles(t)) for i, t in rows]
    parent = {i: i for i, _ in rows}

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for x, (i, a) in enumerate(sets):
        for j, b in sets[:x]:
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                p, q = sorted((find(i), find(j)))
                parent[q] = p
    return {i: (len(a), find(i)) for i, a in sets}


def repeats(rows: list[tuple[int, str | None]], length: int = 100) -> dict[int, tuple]:
    seen, out = {}, {}
    for i, t in sorted(rows):
        b = (t or "").encode()
        for k in range(len(b) - length + 1):
            seen.setdefault(b[k : k + length], (i, k))
    for i, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - length + 1):
            if seen[b[k : k + length]] < (i, k):
                gone[k : k + length] = True
        spans = int((gone & ~np.concatenate([[False], gone[:-1]])).sum()) if len(b) else 0
        out[i] = (len(b), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest())
    return out


def luhn(digits: str) -> bool:
    values = [int(c) * (1 + k % 2) for k, c in enumerate(reversed(digits))]
    return sum(v - 9 if v > 9 else v for v in values) % 10 == 0


def base_spans(text: str | None) -> str:
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            good = {
                "email": lambda: True,
                "ip": lambda m=m: all(int(p) <= 255 for p in m.group().split(".")),
                "card": lambda d=digits: 13 <= len(d) <= 19 and luhn(d),
                "phone": lambda d=digits: 9 <= len(d) <= 15,
            }[kind]()
            if good:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return ",".join(out)


def tiling(doc: list, item: list, match: int) -> int:
    """Item words under greedy tiles, by trying every pair of places."""
    used_d, used_i, covered = [False] * len(doc), [False] * len(item), 0
    while True:
        best = (match - 1, 0, 0)
        for x in range(len(doc)):
            for y in range(len(item)):
                n = 0
                while x + n < len(doc) and y + n < len(item) and doc[x + n] == item[y + n] and not used_d[x + n] and not used_i[y + n]:
                    n += 1
                if n > best[0]:
                    best = (n, x, y)
        n, x, y = best
        if n < match:
            return covered
        for k in range(n):
            used_d[x + k] = used_i[y + k] = True
        covered += n


def mix(rows: list[tuple[str | None, int]]) -> dict[str | None, float]:
    """Targets by repeated resharing."""
    size = Counter()
    for source, n in rows:
        size[source] += n
    order = sorted(size, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    target, left, open_ = dict.fromkeys(order, 0.0), 1.5 * sum(size.values()), set(order)
    while left > 1e-9 and open_:
        total = sum(weight[s] for s in open_)
        share = {s: left * weight[s] / total for s in open_}
        left = 0.0
        for s in list(open_):
            target[s] += share[s]
            if target[s] >= 2 * size[s]:
                left += target[s] - 2 * size[s]
                target[s] = 2.0 * size[s]
                open_.discard(s)
    return target
