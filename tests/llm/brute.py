"""Plain restatements of the contracts, for small inputs."""

from __future__ import annotations

import re
from collections import Counter

SPACE_WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text: str | None) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def space_words(text: str | None) -> list[str]:
    return SPACE_WORD.findall(text or "")


def smallest_reachable(nodes, links) -> dict:
    """Node -> smallest node of its component."""
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        if a != b:
            root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def shingles(text: str | None, width: int) -> frozenset:
    w = space_words(lower(text))
    if len(w) < width:
        return frozenset([tuple(w)] if w else [])
    return frozenset(zip(*(w[i:] for i in range(width)), strict=False))


def near_links(sets: dict, percent: int = 80) -> list[tuple]:
    ids = sorted(i for i in sets if sets[i])
    out = []
    for n, a in enumerate(ids):
        for b in ids[n + 1:]:
            same = len(sets[a] & sets[b])
            if 100 * same >= percent * len(sets[a] | sets[b]):
                out.append((a, b))
    return out


def repeated_words(texts: list[str | None], window: int) -> list[list[bool]]:
    """Per text, which words a repeated window covers."""
    words = [space_words(t) for t in texts]
    seen = Counter(tuple(w[i:i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for w in words:
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i:i + window])] > 1:
                gone[i:i + window] = [True] * window
        out.append(gone)
    return out
