"""Suffix order with common-prefix lengths by external induced sorting: the work of one task on its own shard.

Suffixes whose first symbol is below their second's are S, the others L; an S after an L is leftmost (LMS). Suffixes in
order are read from a priority queue, and each hands the suffix before it to the queue, if that is of the wanted type: first
LMS suffixes induce the L ones in ascending order, then these the S ones in descending order. Started from LMS suffixes in
any order, this sorts the LMS substrings; these get names, the string of names is sorted in turn by recursion, and that
gives the order from which the suffixes themselves are induced. Recursion ends, and substrings are sorted directly, where
what is to be sorted fits in the memory allowed. The common prefix of a suffix with the one before it in
its bucket is one more than the least of those between the two that handed them over, so the tuples carry it along.

Text, types, names, sorted sequences and the queue's tuples lie in files; a bound on the tuples in memory is a parameter.
"""

from __future__ import annotations

import os
from collections import deque
from collections.abc import Iterator
from pathlib import Path

import numpy as np

CHUNK = 1 << 16
MOST = 1 << 20  # tuples in memory, unless said otherwise
SMALL = 1 << 16  # bytes of an array that isn't worth a file
SHORT = 1 << 15  # so short a text isn't worth an induction
BUCKETS = 128  # ranges of names


class Folder:
    """Arrays in files of one folder. A file has no name any more once it is mapped, so its space is free when its array goes."""

    def __init__(self, path: str):
        self.path, self.made = Path(path), 0

    def name(self) -> str:
        self.made += 1
        return str(self.path / f"a{self.made}")

    def array(self, n: int, dtype) -> np.ndarray:
        """An array in a new file (small ones in memory), zero at first."""
        if n * np.dtype(dtype).itemsize <= SMALL:
            return np.zeros(n, dtype)
        name = self.name()
        made = np.asarray(np.memmap(name, dtype, "w+", shape=n))
        os.unlink(name)
        return made

    def text(self, n: int, dtype) -> np.ndarray:
        """An array followed by zeros, which words_of may read."""
        return self.array(n + 64, dtype)[:n]


def mapped(name: str, dtype) -> np.ndarray:
    """The numbers of a file, which has no name any more then."""
    made = np.asarray(np.memmap(name, dtype, "r"))
    os.unlink(name)
    return made


def places(n: int):
    """The type of positions in a text of n symbols."""
    return np.int32 if n < 1 << 31 else np.int64


class Sequence:
    """Numbers appended to a file, read as one array."""

    def __init__(self, folder: Folder, dtype):
        self.name, self.dtype, self.n = folder.name(), np.dtype(dtype), 0
        self.file = open(self.name, "wb", buffering=1 << 18)  # noqa: SIM115

    def append(self, x: np.ndarray) -> None:
        self.file.write(np.ascontiguousarray(x, self.dtype).data)
        self.n += len(x)

    def array(self) -> np.ndarray:
        self.file.close()
        return mapped(self.name, self.dtype) if self.n else np.empty(0, self.dtype)


class DiskQueue:
    """Tuples (key, suffix, common prefix), the smallest key first and equal keys in the order in which they came.

    No key may come that is below the last one taken. Tuples wait in buckets, by ranges of keys (edges: the first key of
    each); beyond most tuples in memory the fullest bucket goes to a file. The bucket that is read is in order.
    """

    def __init__(self, edges: np.ndarray, folder: Folder, most: int):
        self.edges, self.folder, self.most = edges, folder, most
        self.alone = np.append(np.diff(edges) == 1, False)
        self.direct = bool(self.alone[:-1].all())
        self.parts: list[list] = [[] for _ in edges]
        self.held = np.zeros(len(edges), np.int64)  # in memory
        self.total = self.peak = 0
        self.active = -1
        self.front: deque = deque()

    def put(self, key: np.ndarray, pos: np.ndarray, lcp: np.ndarray) -> None:
        """Adds tuples whose keys ascend, equal ones in the order in which they count as coming."""
        if not len(key):
            return
        bucket = key if self.direct else np.searchsorted(self.edges, key, side="right") - 1
        edge = [0, *(np.flatnonzero(bucket[1:] != bucket[:-1]) + 1).tolist(), len(bucket)]
        for a, b in zip(edge[:-1], edge[1:], strict=True):
            c = int(bucket[a])
            part = (np.broadcast_to(key[a], b - a) if self.direct else key[a:b], pos[a:b], lcp[a:b])
            if c != self.active:
                self.parts[c].append(part)
                self.held[c] += b - a
                self.total += b - a
            elif self.alone[c] or not self.front:
                self.front.append(part)
            else:
                self.front = deque([_by_key([*self.front, part])])
        self.peak = max(self.peak, self.total)
        while self.total > self.most:
            c = int(self.held.argmax())
            key, pos, lcp = _joined([p for p in self.parts[c] if not isinstance(p[0], str)])
            name = self.folder.name()
            with open(name, "wb") as f:
                for x in (pos, lcp) if self.direct else (key, pos, lcp):
                    f.write(x.data)
            self.parts[c] = [*(p for p in self.parts[c] if isinstance(p[0], str)), (name, len(pos), pos.dtype)]
            self.total -= self.held[c]
            self.held[c] = 0

    def head(self, n: int) -> tuple | None:
        """Up to n of the smallest tuples, of one bucket; None if the queue is empty."""
        while not self.front:
            waiting = [c for c in range(self.active + 1, len(self.parts)) if self.parts[c]]
            if not waiting:
                return None
            c = self.active = waiting[0]
            parts, self.parts[c] = [self._loaded(c, *p) if isinstance(p[0], str) else p for p in self.parts[c]], []
            self.total -= self.held[c]
            self.held[c] = 0
            self.front = deque(parts if self.alone[c] else [_by_key(parts)])
            if self.alone[c] and len(parts) > 1 and sum(len(p[0]) for p in parts) <= CHUNK:
                self.front = deque([_joined(parts)])
        return tuple(x[:n] for x in self.front[0])

    def _loaded(self, bucket: int, name: str, n: int, dtype) -> tuple:
        data, at, size = mapped(name, np.uint8), 0 if self.direct else 8 * n, np.dtype(dtype).itemsize * n
        key = np.broadcast_to(np.int64(bucket), n) if self.direct else data[:at].view(np.int64)
        return key, data[at : at + size].view(dtype), data[at + size :]

    def drop(self, n: int) -> None:
        """Takes away the n smallest tuples of the bucket that is read; n is not more than head gave."""
        if n == len(self.front[0][0]):
            self.front.popleft()
        else:
            self.front[0] = tuple(x[n:] for x in self.front[0])


def _joined(parts: list) -> tuple:
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True)) if len(parts) > 1 else tuple(map(np.ascontiguousarray, parts[0]))


def _by_key(parts: list) -> tuple:
    key, pos, lcp = _joined(parts)
    order = np.argsort(key, kind="stable")
    return key[order], pos[order], lcp[order]


def bucket_edges(text: np.ndarray, symbols: int, flip: bool, most: int) -> np.ndarray:
    """First keys of a queue's buckets for a text: one bucket for each key of a small alphabet; ranges of names otherwise, with
    about equally many suffixes, where a name that is more frequent than the bound has buckets of its own."""
    if 2 * symbols <= 4 * BUCKETS + 64:
        return np.arange(2 * symbols + 1)
    step = -(-symbols // (32 * BUCKETS))
    count = np.zeros(-(-symbols // step), np.int64)
    for lo in range(0, len(text), 1 << 20):
        x = text[lo : lo + (1 << 20)].astype(np.int64)
        count += np.bincount((symbols - 1 - x if flip else x) // step, minlength=len(count))
    goal, edges, have = max(1, min(len(text) // BUCKETS, most // 4)), [0], 0
    for i, n in enumerate(count.tolist()):
        if n > 4 * goal and len(edges) < 8 * BUCKETS:
            edges += range(2 * i * step, min(2 * (i + 1) * step, 2 * symbols))
            have = goal  # the next range starts a bucket
        elif have and have + n > goal:
            edges.append(2 * i * step)
            have = n
        else:
            have += n
    return np.unique(np.array([*edges, 2 * symbols]))


def words_of(text: np.ndarray) -> tuple[np.ndarray, int]:
    """The eight bytes from each symbol on as one number, and how many symbols that are; text comes from Folder.text."""
    return np.lib.stride_tricks.as_strided(text.view(np.uint8)[:8].view(np.uint64), (len(text),), (text.itemsize,)), 8 // text.itemsize


def common(text: np.ndarray, a: np.ndarray, b: np.ndarray, cap: np.ndarray) -> np.ndarray:
    """Common-prefix lengths of pairs of suffixes, up to cap of each pair, by comparison. The last symbol of text occurs once."""
    words, per = words_of(text)
    bits = 64 // per
    out, at, k = np.zeros(len(a), np.int64), np.flatnonzero(a != b), 0
    out[a == b] = cap[a == b]
    while len(at):
        x = words[a[at] + k] ^ words[b[at] + k]
        same = np.where(x == 0, per, np.bitwise_count((x & (~x + np.uint64(1))) - np.uint64(1)) // bits)
        out[at] = np.minimum(k + same, cap[at])
        k += per
        at = at[(x == 0) & (cap[at] > k)]
    return out


def lms_positions(text: np.ndarray, folder: Folder) -> tuple[np.ndarray, np.ndarray]:
    """The LMS suffixes of a text, ascending, and whether each suffix is S; found block by block from its end."""
    n = len(text)
    types = folder.array(n, np.uint8)
    found, at, after = folder.array(n // 2 + 2, places(n)), n // 2 + 2, None
    for hi in range(n, 0, -(1 << 20)):
        lo = max(0, hi - (1 << 20))
        step = np.diff(text[lo : hi + 1].astype(np.int64)) if hi < n else np.append(np.diff(text[lo:hi].astype(np.int64)), 1)
        near = np.minimum.accumulate(np.where(step != 0, np.arange(len(step)), len(step))[::-1])[::-1]
        s = np.append(step > 0, after if after is not None else True)[near]
        whole = s if after is None else np.append(s, after)
        lms = lo + 1 + np.flatnonzero(whole[1:] & ~whole[:-1])
        found[at - len(lms) : at] = lms
        at, after = at - len(lms), bool(s[0])
        types[lo:hi] = s
    return found[at:], types


def _range_min(x: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Least of x[first..last] for each pair."""
    size = last - first + 1
    out = np.empty(len(first), x.dtype)
    level, table = 0, x
    top = int(size.max()).bit_length() if len(size) else 0
    which = np.frexp(size)[1] - 1
    while level < top:
        at = which == level
        out[at] = np.minimum(table[first[at]], table[last[at] - (1 << level) + 1])
        if level + 1 < top:
            table = np.minimum(table[: len(table) - (1 << level)], table[1 << level :])
        level += 1
    return out


def induce(text: np.ndarray, symbols: int, flip: bool, queue: DiskQueue, cap: int = 0) -> Iterator[tuple]:
    """Reads the queue to its end and yields (given, suffix, common prefix, handed) chunk by chunk, in order.

    A key is twice the suffix's first symbol, and 1 more for suffixes that were given (the seeds), not induced; flip: symbols
    count from the largest down, so that the same rule induces S suffixes. A suffix of symbol c hands the one before it over
    if its symbol is above c, or is c and the suffix itself was induced. handed: whether it did.
    cap: common prefixes up to this length are carried; 0: none.
    """
    top = symbols - 1
    least = np.full(symbols, -1, np.int16) if cap else None  # of what was read since a bucket last got a suffix; -1: it never did
    last, bucket = -1, -1
    while (got := queue.head(CHUNK)) is not None:
        key, pos, lcp = got
        before = np.maximum(pos - 1, 0)
        symbol = text[before].astype(np.int64)
        if flip:
            symbol = top - symbol
        own = key >> 1
        given = (key & 1).astype(bool)
        new = (pos > 0) & ((symbol > own) | ((symbol == own) & ~given))
        to = 2 * symbol
        if not queue.alone[queue.active]:  # up to where a suffix that is handed over comes first
            least_new = np.minimum.accumulate(np.where(new, to, np.iinfo(np.int64).max))
            late = np.flatnonzero(key[1:] > least_new[:-1])
            if len(late):
                k = int(late[0]) + 1
                pos, lcp, before, symbol, given, new, to = (x[:k] for x in (pos, lcp, before, symbol, given, new, to))
        queue.drop(len(pos))
        hit = np.flatnonzero(new)
        goal = symbol[hit]
        order = np.argsort(goal.astype(np.int16) if symbols < 1 << 15 else goal, kind="stable")
        hit, goal = hit[order], goal[order]
        carried = lcp[: len(hit)]
        if cap:
            if queue.active != bucket:
                lcp = lcp.copy()
                lcp[0] = common(text, np.array([last]), pos[:1], np.array([cap]))[0] if last >= 0 else 0
                bucket = queue.active
            last = int(pos[-1])
            carried = _carried(lcp.astype(np.int16), hit, goal, least, cap)
        queue.put(2 * goal, before[hit], carried)
        yield given, pos, lcp, new


def _carried(lcp: np.ndarray, at: np.ndarray, bucket: np.ndarray, least: np.ndarray, cap: int) -> np.ndarray:
    """The common prefix of each suffix that the suffixes at these places hand over to these buckets, one bucket after another,
    with the one before it in its bucket; updates least."""
    whole = lcp.min()
    if not len(at):
        np.minimum(least, whole, out=least)
        return np.empty(0, np.uint8)
    new = np.append(True, bucket[1:] != bucket[:-1])
    got = _range_min(lcp, np.where(new, 0, np.append(0, at[:-1] + 1)), at)
    got[new] = np.minimum(got[new], least[bucket[new]])
    np.minimum(least, whole, out=least)
    rest = np.append(np.minimum.accumulate(lcp[::-1])[::-1], np.int16(cap))
    ends = np.append(np.flatnonzero(new)[1:], len(at)) - 1
    least[bucket[ends]] = rest[at[ends] + 1]
    return np.minimum(got + 1, cap).astype(np.uint8)


def _both_ways(text: np.ndarray, symbols: int, seeds: np.ndarray, near: np.ndarray | None, folder: Folder, most: int, cap: int) -> Iterator[tuple]:
    """What induce yields of the second, descending way, in which all suffixes come by: L ones are induced from the seeds (LMS
    suffixes) and kept in files, and S ones from those."""
    queue = DiskQueue(bucket_edges(text, symbols, False, most), folder, most)
    for lo in range(0, len(seeds), CHUNK):
        pos = seeds[lo : lo + CHUNK]
        _give(queue, 2 * text[pos].astype(np.int64) + 1, pos, near[lo : lo + CHUNK] if cap else np.zeros(len(pos), np.uint8))
    ls, shared = Sequence(folder, places(len(text))), Sequence(folder, np.uint8)
    for given, pos, lcp, _ in induce(text, symbols, False, queue, cap):
        ls.append(pos[~given])
        shared.append(lcp[~given])
    ls, shared = ls.array(), shared.array()
    queue = DiskQueue(bucket_edges(text, symbols, True, most), folder, most)
    queue.put(np.array([2 * (symbols - 1)]), np.array([len(text) - 1], ls.dtype), np.zeros(1, np.uint8))
    for hi in range(len(ls), 0, -CHUNK):
        lo = max(0, hi - CHUNK)
        pos, lcp = ls[lo:hi][::-1], np.append(shared[lo + 1 : hi], shared[hi : hi + 1] if hi < len(ls) else np.uint8(0)).astype(np.uint8)[::-1]
        _give(queue, 2 * (symbols - 1 - text[pos].astype(np.int64)) + 1, pos, lcp)
    yield from induce(text, symbols, True, queue, cap)


def _give(queue: DiskQueue, key: np.ndarray, pos: np.ndarray, lcp: np.ndarray) -> None:
    order = np.argsort(key, kind="stable")
    queue.put(key[order], pos[order], lcp[order])


def refine(rank: np.ndarray, rows: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Ranks (places of the first of equals) of rows, refined in place by key; the rows that still have equals."""
    order = np.lexsort((key, rank[rows]))
    r, k = rank[rows][order], key[order]
    old = np.append(True, r[1:] != r[:-1])
    new = old | np.append(True, k[1:] != k[:-1])
    place = np.arange(len(r))
    rank[rows[order]] = r + np.maximum.accumulate(np.where(new, place, 0)) - np.maximum.accumulate(np.where(old, place, 0))
    return rows[order][~(new & np.append(new[1:], True))]


def names_in_memory(text: np.ndarray, symbols: int, lms: np.ndarray, types: np.ndarray) -> tuple[np.ndarray, int]:
    """(name of each LMS substring, ascending with it; number of names), by packed symbols and types."""
    bits = (2 * symbols + 1).bit_length()
    each = 62 // bits
    length = np.append(np.diff(lms) + 1, 1)
    rank, open_, off = np.zeros(len(lms), np.int64), np.arange(len(lms)), 0
    while len(open_):
        key = np.zeros(len(open_), np.int64)
        for t in range(off, off + each):
            at = np.minimum(lms[open_] + t, len(text) - 1)
            key = (key << bits) | np.where(t < length[open_], 2 * text[at].astype(np.int64) + types[at] + 1, 0)
        equal = refine(rank, open_, key)
        off += each
        open_ = equal[length[equal] > off]
    first = np.zeros(len(lms), bool)
    first[rank] = True
    return (np.cumsum(first) - 1)[rank], int(first.sum())


def names_by_induction(text: np.ndarray, symbols: int, lms: np.ndarray, folder: Folder, most: int) -> tuple[np.ndarray, int]:
    """The same, by sorting the substrings through the disk queue."""
    order, names = folder.array(len(lms), lms.dtype), folder.array(len(lms), np.int32)
    at = len(lms)
    for given, pos, _, handed in _both_ways(text, symbols, lms, None, folder, most, 0):
        found = pos[~given & ~handed & (pos > 0)]  # S suffixes after an L one, by their substrings, descending
        order[at - len(found) : at] = found[::-1]
        at -= len(found)
    name, before = 0, None
    for lo in range(0, len(order), CHUNK):
        pos = order[lo : lo + CHUNK]
        number = np.searchsorted(lms, pos)
        size = lms[np.minimum(number + 1, len(lms) - 1)] - pos + 1
        p, n = (pos, size) if before is None else (np.append(before[0], pos), np.append(before[1], size))
        new = (n[1:] != n[:-1]) | (common(text, p[:-1], p[1:], n[1:]) < n[1:])
        new = np.append(False, new) if before is None else new
        names[number] = value = name + np.cumsum(new)
        name, before = int(value[-1]), (pos[-1:], size[-1:])
    return names, name + 1


def lms_order(text: np.ndarray, symbols: int, folder: Folder, most: int) -> np.ndarray:
    """The LMS suffixes in ascending order: that of the suffixes of the string of their substrings' names."""
    lms, types = lms_positions(text, folder)
    found, count = names_in_memory(text, symbols, lms, types) if len(lms) <= most else names_by_induction(text, symbols, lms, folder, most)
    order = folder.array(len(lms), lms.dtype)
    if count == len(lms):
        order[found] = lms
        return order
    names = folder.text(len(lms), np.int32)
    names[:] = found
    del found, types
    at = len(lms)
    for pos, _ in suffixes(names, count, folder, most):
        order[at - len(pos) : at] = lms[pos][::-1]
        at -= len(pos)
    return order


def sorted_in_memory(text: np.ndarray) -> np.ndarray:
    """The suffixes of a text in order, by ranks of prefixes twice as long each time, for those that still have equals."""
    rank, k = np.zeros(len(text), np.int64), 1
    left = refine(rank, np.arange(len(text)), text.astype(np.int64))
    while len(left):
        left = refine(rank, left, rank[left + k])  # equals never reach the end, whose symbol occurs once
        k *= 2
    order = np.empty(len(text), np.int64)
    order[rank] = np.arange(len(text))
    return order


def suffixes(text: np.ndarray, symbols: int, folder: Folder, most: int = MOST, cap: int = 0) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Yields (suffixes, common prefixes with the suffix before in this order, up to cap) in descending order, some at a time.

    text: symbols below the given number, from Folder.text; the last one is 0 and the only 0. cap: below 256; 0 if no common
    prefixes are wanted.
    """
    if len(text) <= (most if not cap else min(most, SHORT)):
        order = sorted_in_memory(text)[::-1].copy()
        yield order, np.append(0, common(text, order[:-1], order[1:], np.full(len(order) - 1, cap))).astype(np.uint8)
        return
    seeds = lms_order(text, symbols, folder, most)
    near = None
    if cap:
        near = folder.array(len(seeds), np.uint8)
        for lo in range(1, len(seeds), CHUNK):
            hi = min(lo + CHUNK, len(seeds))
            near[lo:hi] = common(text, seeds[lo - 1 : hi - 1], seeds[lo:hi], np.full(hi - lo, cap))
    for _, pos, lcp, _ in _both_ways(text, symbols, seeds, near, folder, most, cap):
        yield pos, lcp


def repeated_windows(text: np.ndarray, start: np.ndarray, windows: np.ndarray, length: int, folder: Folder, most: int = MOST) -> np.ndarray:
    """Which windows start again, as a file of 0 and 1 by position: for each of the first so many positions of each segment,
    whether the length symbols there also start at an earlier one.

    text: segments of bytes (each 2 higher) from start on, each with a 1 after it, and a 0 at the end; in the order in which
    their windows count as earlier.
    """
    again = folder.array(len(text), np.uint8)
    held = np.empty(0, np.int64)  # the first of the windows that are equal to the latest one
    for pos, lcp in suffixes(text, 258, folder, most, length):
        segment = np.searchsorted(start, pos, side="right") - 1
        group = np.cumsum(lcp < length)
        ok = pos - start[segment] < windows[segment]
        at, last, group = pos[ok], group[-1], group[ok]
        if len(held):
            at, group = np.append(held, at), np.append(np.zeros(len(held), np.int64), group)
        if not len(at):
            continue
        first = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
        least = np.minimum.reduceat(at, first)
        again[at[at != np.repeat(least, np.diff(np.append(first, len(at))))]] = 1
        held = least[-1:].copy() if group[-1] == last else np.empty(0, np.int64)
    return again
