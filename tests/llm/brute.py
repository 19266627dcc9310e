"""Plain, slow versions of the operators' contracts, for small tables."""

from __future__ import annotations

import hashlib
import re

import numpy as np
import xxhash

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def words(text: str | None) -> list[bytes]:
    return WORD.findall((text or "").encode())


def shingles(text: str | None, width: int) -> list[bytes]:
    lower = bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode())
    w = WORD.findall(lower)
    if not w:
        return []
    return [b" ".join(w[i : i + width]) for i in range(max(1, len(w) - width + 1))]


def simhash(text: str | None, width: int = 3) -> int:
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles(text, width)]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(ids: list[int], linked) -> dict[int, int]:
    """The smallest id reachable from each, by linked(position, position)."""
    root = list(range(len(ids)))

    def find(x: int) -> int:
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(ids)):
        for j in range(i + 1, len(ids)):
            if linked(i, j):
                a, b = find(i), find(j)
                root[max(a, b, key=lambda k: ids[k])] = min(a, b, key=lambda k: ids[k])
    return {i: ids[find(i)] for i in range(len(ids))}


def repeats(docs: list[tuple[int, str | None]], length: int, units) -> dict[int, tuple[list, list[bool]]]:
    """Each document's units and which of them go: those that a run of so many units covers which also starts earlier."""
    seen: set = set()
    out = {}
    for doc, text in sorted(docs):
        u = units(text)
        gone = [False] * len(u)
        for i in range(len(u) - length + 1):
            run = tuple(u[i : i + length]) if isinstance(u, list) else u[i : i + length]
            if run in seen:
                gone[i : i + length] = [True] * length
            seen.add(run)
        out[doc] = (u, gone)
    return out


def word_dedup(docs: list[tuple[int, str | None]], window: int) -> set[tuple]:
    got = set()
    for doc, (u, gone) in repeats(docs, window, words).items():
        kept = b" ".join(w for w, g in zip(u, gone, strict=True) if not g)
        got.add((doc, len(u), sum(gone), hashlib.sha256(kept).hexdigest()))
    return got


def byte_dedup(docs: list[tuple[int, str | None]], length: int) -> set[tuple]:
    got = set()
    for doc, (u, gone) in repeats(docs, length, lambda t: (t or "").encode()).items():
        kept = bytes(c for c, g in zip(u, gone, strict=True) if not g)
        spans = sum(g and not before for g, before in zip(gone, [False, *gone], strict=False))
        got.add((doc, len(u), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return got


def mix_targets(sizes: dict[str | None, int], weights: list[int], share: float, cap: float) -> dict[str | None, float]:
    """Deal out by weight; who is above the cap stops there, and the excess is dealt anew."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    full: set = set()
    left = share * sum(sizes.values())
    while True:
        rest = [s for s in order if s not in full]
        total = sum(w[s] for s in rest)
        over = {s for s in rest if left * w[s] / total > cap * sizes[s]}
        if not over:
            return {s: cap * sizes[s] if s in full else left * w[s] / total for s in order}
        full |= over
        left -= sum(cap * sizes[s] for s in over)


def cosine_links(vectors: list, labels: list, threshold: float):
    def usable(v) -> bool:
        return v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(x != 0 for x in v)

    ok = [usable(v) and label is not None for v, label in zip(vectors, labels, strict=True)]

    def linked(i: int, j: int) -> bool:
        if not (ok[i] and ok[j]) or labels[i] != labels[j] or len(vectors[i]) != len(vectors[j]):
            return False
        a, b = np.array(vectors[i], float), np.array(vectors[j], float)
        return float(a @ b) / (np.linalg.norm(a) * np.linalg.norm(b)) >= threshold

    return linked
