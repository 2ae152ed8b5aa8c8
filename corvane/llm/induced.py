"""Suffix sorting by external induced sorting.

Suffixes are S (smaller than the next) or L (larger); an LMS suffix is an S one
after an L one. LMS substrings are sorted and named; where names repeat, the string
of names, at most half as long, is sorted by the same induction, so it goes until
all names differ or the prefixes asked for are decided. From the sorted LMS suffixes
one ascending pass induces the L suffixes and one descending pass the S suffixes.

A pass is a monotone priority queue: what a suffix induces never sorts before it.
Symbols are dealt into buckets, runs of symbols of bounded count or one frequent
symbol. A bucket's waiting tuples are a suffix and the length of the prefix that it
shares with the tuple before; those of one symbol come first in, first out. When the
pass comes to a bucket it sorts its tuples at once, together with what they induce
into the bucket itself; a frequent symbol's are taken run by run. A tuple's shared
prefix is one more than the least of those between the sources of it and the last.
Prefixes count up to ``limit`` symbols; suffixes that share as many may come in any
order, and names are compared only as far as they decide that.

Arrays and waiting tuples are held in memory up to a budget that follows ``memory``,
a number of tuples, and beyond it in unnamed spill files of the task, which go with
it: nothing else reads them, and a task that is lost starts anew.
"""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterator

import numpy as np


class Store:
    """Arrays in memory up to ``budget`` bytes, beyond it in spill files."""

    def __init__(self, budget: int):
        self.left = budget
        self.spilled = 0

    def file(self):
        """An unnamed file where Spark's own spill files of this executor go."""
        folder = (os.environ.get("SPARK_LOCAL_DIRS") or os.environ.get("LOCAL_DIRS", "")).split(",")[0]  # the latter is YARN's
        return tempfile.TemporaryFile(dir=folder if os.path.isdir(folder) else None)

    def array(self, n: int, kind, fill: int | None = None) -> np.ndarray:
        size = n * np.dtype(kind).itemsize
        if size <= self.left:
            self.left -= size
            out = np.empty(n, kind)
        else:
            self.spilled += size
            with self.file() as f:
                out = np.memmap(f, kind, "w+", shape=n)
        if fill is not None:
            out[:] = fill
        return out

    def free(self, *arrays: np.ndarray) -> None:
        """Arrays made here that are used no more."""
        for a in arrays:
            if not isinstance(a, np.memmap):
                self.left += a.nbytes


class Column:
    """An array that is appended to; beyond the store's budget it goes to a spill file."""

    def __init__(self, store: Store, kind):
        self.store, self.kind, self.n = store, np.dtype(kind), 0
        self.parts: list[np.ndarray] = []
        self.at = None

    def add(self, values: np.ndarray) -> None:
        values = np.ascontiguousarray(values, self.kind)
        self.n += len(values)
        if self.at is None and values.nbytes <= self.store.left:
            self.store.left -= values.nbytes
            self.parts.append(values)
            return
        if self.at is None:
            self.at = self.store.file()
            for p in self.parts:
                self.at.write(p.tobytes())
            self.store.free(*self.parts)
            self.parts = []
        self.store.spilled += values.nbytes
        self.at.write(values.tobytes())

    def done(self) -> np.ndarray:
        if self.at is None:
            out = np.concatenate(self.parts) if self.parts else np.zeros(0, self.kind)
            self.parts = []
            return out
        self.at.flush()
        with self.at:
            return np.memmap(self.at, self.kind, "r+", shape=self.n)


class Waiting:
    """First-in first-out lists of (suffix, shared prefix) tuples by bucket; beyond ``memory`` tuples they go to a spill file."""

    def __init__(self, store: Store, buckets: int, kind, memory: int):
        self.store, self.kind, self.memory = store, np.dtype(kind), memory
        self.parts: list[list[tuple]] = [[] for _ in range(buckets)]
        self.runs: list[list[tuple[int, int, int]]] = [[] for _ in range(buckets)]
        self.held = self.end = 0
        self.at = None

    def push(self, b: int, pos: np.ndarray, lcp: np.ndarray) -> None:
        self.parts[b].append((pos, lcp))
        self.held += len(pos)
        if self.held > self.memory:
            self._spill()

    def _spill(self) -> None:
        if self.at is None:
            self.at = self.store.file()
        self.at.seek(self.end)
        for b, parts in enumerate(self.parts):
            if parts:
                pos, lcp = (np.concatenate(x) for x in zip(*parts, strict=True))
                self.at.write(pos.astype(self.kind).tobytes() + lcp.tobytes())
                self.runs[b].append((self.end, len(pos), 0))
                self.end += (self.kind.itemsize + 1) * len(pos)
                self.parts[b] = []
        self.store.spilled += self.held * (self.kind.itemsize + 1)
        self.held = 0

    def some(self, b: int, most: int) -> tuple[np.ndarray, np.ndarray] | None:
        """The next tuples of a bucket, about ``most``; None when there are no more."""
        if self.runs[b]:
            base, n, first = self.runs[b].pop(0)
            k = min(n - first, most)
            self.at.seek(base + first * self.kind.itemsize)
            pos = np.frombuffer(self.at.read(k * self.kind.itemsize), self.kind)
            self.at.seek(base + n * self.kind.itemsize + first)
            lcp = np.frombuffer(self.at.read(k), np.uint8)
            if first + k < n:
                self.runs[b].insert(0, (base, n, first + k))
            return pos, lcp
        if not self.parts[b]:
            return None
        k, size = 0, 0
        while k < len(self.parts[b]) and (not k or size + len(self.parts[b][k][0]) <= most):
            size += len(self.parts[b][k][0])
            k += 1
        got, self.parts[b] = self.parts[b][:k], self.parts[b][k:]
        self.held -= size
        return got[0] if k == 1 else tuple(np.concatenate(x) for x in zip(*got, strict=True))

    def take(self, b: int) -> tuple[np.ndarray, np.ndarray]:
        """All tuples of a bucket."""
        got = []
        while (x := self.some(b, 1 << 62)) is not None:
            got.append(x)
        if not got:
            return np.zeros(0, self.kind), np.zeros(0, np.uint8)
        return got[0] if len(got) == 1 else tuple(np.concatenate(x) for x in zip(*got, strict=True))

    def close(self) -> None:
        if self.at is not None:
            self.at.close()


def shared(t: np.ndarray, i: np.ndarray, j: np.ndarray, limit: int, known: np.ndarray | None = None) -> np.ndarray:
    """Lengths of the common prefixes of suffix pairs, up to ``limit``; ``known`` many are known to be common.

    No two suffixes are equal up to the end of ``t``. Symbols are compared eight bytes at a time.
    """
    size = t.itemsize
    per, n = 8 // size, len(t)
    out = np.zeros(len(i), np.int64) if known is None else np.minimum(known, limit)
    i, j = i.astype(np.int64), j.astype(np.int64)
    live = np.flatnonzero(out < limit)
    words = np.ndarray((max(0, n - per + 1),), "<u8", t.data, 0, (size,))
    while len(live):
        a, b = i[live] + out[live], j[live] + out[live]
        near = np.flatnonzero(np.maximum(a, b) > n - per)
        if len(near):
            a[near] = b[near] = 0
        x = words[a] ^ words[b] if len(words) else np.zeros(len(a), np.uint64)
        run = sum((x & np.uint64((1 << (8 * size * k)) - 1) == 0).astype(np.int64) for k in range(1, per + 1))
        for k in near.tolist():  # at the end of t
            a, b, r = int(i[live[k]] + out[live[k]]), int(j[live[k]] + out[live[k]]), 0
            while r < per and max(a, b) + r < n and t[a + r] == t[b + r]:
                r += 1
            run[k] = r
        out[live] += run
        live = live[(run == per) & (out[live] < limit)]
    return np.minimum(out, limit)


def least_between(values: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """min(values[low:high + 1]) of every pair, by a table of minima over powers of two."""
    out = np.zeros(len(low), values.dtype)
    level = np.frexp((high - low + 1).astype(np.float64))[1] - 1
    tab = values
    for k in range(int(level.max(initial=-1)) + 1):
        at = np.flatnonzero(level == k)
        if len(at):
            out[at] = np.minimum(tab[low[at]], tab[high[at] - (1 << k) + 1])
        if len(tab) > (1 << k):
            tab = np.minimum(tab[: -(1 << k)], tab[1 << k :])
    return out


def small_kinds(t: np.ndarray, last: bool) -> np.ndarray:
    """True at the S suffixes of t[:-1], given whether the suffix of its last symbol is S."""
    rising, equal = t[:-1] < t[1:], t[:-1] == t[1:]
    m = len(rising)
    # An equal pair takes the kind of the next unequal one.
    nxt = np.minimum.accumulate(np.where(equal, m, np.arange(m))[::-1])[::-1]
    return np.append(rising, last)[nxt]


class Sorter:
    """Sorts the suffixes of symbols t[0..n-1]; t ends with a single least symbol 0."""

    def __init__(self, t: np.ndarray, symbols: int, limit: int, memory: int = 4_000_000, store: Store | None = None):
        self.t, self.symbols, self.limit, self.memory = t, symbols, min(limit, 255), max(1, memory)
        self.store = store or Store(32 * memory)
        self.kind = np.int32 if len(t) < 2**31 else np.int64
        self.symbol = np.uint16 if symbols <= 1 << 16 else np.uint32 if symbols <= 1 << 32 else np.int64  # 16 bits are sorted by radix

    def _slices(self, n: int) -> Iterator[slice]:
        for a in range(0, n, self.memory):
            yield slice(a, min(n, a + self.memory))

    def _lms(self) -> tuple[np.ndarray, int]:
        """The LMS suffixes in text order, and how many suffixes are L."""
        t, n = self.t, len(self.t)
        found, larger = [], 0
        right, end = True, n - 1  # whether the suffix at ``end`` is S
        while end > 0:
            a = max(0, end - self.memory)
            s = small_kinds(np.asarray(t[a : end + 1]), right)
            larger += int((~s).sum())
            own = np.append(s, right)
            at = np.flatnonzero(own[1:] & ~own[:-1]) + 1 + a
            found.append(at)
            right, end = bool(s[0]), a
        total = sum(map(len, found))
        out = self.store.array(total, self.kind)
        k = total
        for at in found:
            out[k - len(at) : k] = at
            k -= len(at)
        return out, larger

    def _deal(self) -> None:
        """Buckets of symbols: of few occurrences together, or one frequent symbol."""
        count = np.zeros(self.symbols, np.int64)
        for s in self._slices(len(self.t)):
            count += np.bincount(self.t[s], minlength=self.symbols)
        most = max(1, min(self.memory // 2, max(4096, len(self.t) // 16)))
        group = np.cumsum(count) // most
        large = count > most
        new = np.ones(self.symbols, bool)
        new[1:] = (group[1:] != group[:-1]) | large[1:] | large[:-1]
        self.first = np.flatnonzero(new)
        self.bucket = self.store.array(self.symbols, np.int32)
        self.bucket[:] = np.cumsum(new) - 1
        self.bounds = np.append(self.first, self.symbols)

    def _word(self, pos: np.ndarray, size: np.ndarray, at: int, per: int, bits: int) -> np.ndarray:
        """Symbols at, at + 1, ... of substrings in one number; what has ended sorts last, as the S suffix it is."""
        key = np.zeros(len(pos), np.int64)
        top = len(self.t) - 1
        for j in range(at, at + per):
            s = np.where(j < size, self.t[np.minimum(pos + j, top)], (1 << bits) - 1)
            key = (key << bits) | s.astype(np.int64)
        return key

    def _refined(self, pos: np.ndarray, size: np.ndarray, at: int) -> np.ndarray:
        """The rank of each of some substrings that are equal before symbol ``at``; equal ones share it."""
        bits = self.symbols.bit_length()
        per = 63 // bits
        rank, began = np.zeros(len(pos), np.int64), at
        live = np.arange(len(pos))
        while len(live):
            key = self._word(pos[live], size[live], at, per, bits)
            order = np.argsort(key) if at == began else np.lexsort((key, rank[live]))
            g, k = rank[live][order], key[order]
            group = np.concatenate([[True], g[1:] != g[:-1]])
            fresh = group | np.concatenate([[True], k[1:] != k[:-1]])
            idx = np.arange(len(order))
            rank[live[order]] = g + np.maximum.accumulate(np.where(fresh, idx, 0)) - np.maximum.accumulate(np.where(group, idx, 0))
            at += per
            # A group goes on while it has several members and one not yet read to its end.
            block = np.cumsum(fresh) - 1
            several = np.bincount(block)[block] > 1
            going = np.bincount(block, size[live[order]] > at)[block] > 0
            live = np.sort(live[order[several & going]])
        return np.unique(rank, return_inverse=True)[1]

    def _ordered(self, part: np.ndarray, lms: np.ndarray, size: np.ndarray, at: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Ascending lots (places in lms, rank in the lot) of substrings that are equal before ``at``.

        More than ``memory`` of them are dealt by their next symbols, as often as it takes.
        """
        if len(part) <= self.memory:
            yield part, self._refined(lms[part].astype(np.int64), size[part], at)
            return
        bits = self.symbols.bit_length()
        per = 63 // bits
        if at >= self.limit:
            yield part, np.zeros(len(part), np.int64)
            return
        words = self.store.array(len(part), np.int64)
        for s in self._slices(len(part)):
            words[s] = self._word(lms[part[s]].astype(np.int64), size[part[s]], at, per, bits)
        some = np.unique(words[:: max(1, len(part) // 4096)])
        some = some[:: max(1, len(some) // 64)]
        split = np.unique(np.concatenate([some, some + 1]))  # a frequent word has a lot of its own
        lots = [Column(self.store, np.int64) for _ in range(len(split) + 1)]
        ends = [[2**63 - 1, -1] for _ in lots]
        for s in self._slices(len(part)):
            w = words[s]
            which = np.searchsorted(split, w, "right")
            for k in np.unique(which).tolist():
                pick = which == k
                lots[k].add(part[s][pick])
                ends[k] = [min(ends[k][0], int(w[pick].min())), max(ends[k][1], int(w[pick].max()))]
        self.store.free(words)
        for lot, (low, high) in zip(lots, ends, strict=True):
            if lot.n:
                sub = lot.done()
                yield from self._ordered(sub, lms, size, at + per if low == high else at)
                self.store.free(sub)

    def _named(self, lms: np.ndarray) -> tuple[np.ndarray, int]:
        """Names of the LMS substrings in text order, and how many differ."""
        size = self.store.array(len(lms), np.int16)
        for s in self._slices(len(lms)):
            ends = np.append(lms[s.start + 1 : s.stop + 1].astype(np.int64), [len(self.t) - 1] * (s.stop == len(lms)))
            size[s] = np.minimum(ends - lms[s] + 1, self.limit)
        names = self.store.array(len(lms), np.uint32 if len(lms) < 2**31 else np.int64)
        total = 0
        every = self.store.array(len(lms), np.int64)
        for s in self._slices(len(lms)):
            every[s] = np.arange(s.start, s.stop)
        for part, rank in self._ordered(every, lms, size, 0):
            names[part] = rank + total
            total += int(rank.max(initial=-1)) + 1
        self.store.free(every, size)
        return names, total

    def _ranked(self, lms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The LMS suffixes in order, and the prefixes that each shares with the one before."""
        m = len(lms)
        names, distinct = self._named(lms)
        need = max(1, self.limit // 2)  # so many names reach over ``limit`` symbols: LMS suffixes are two apart at least
        ranked, common = self.store.array(m, self.kind), self.store.array(m + 1, np.uint8, 0)
        if distinct < m and need > 1:
            reduced = self.store.array(m + 1, names.dtype)
            for s in self._slices(m):
                reduced[s] = names[s] + 1
            reduced[m] = 0
            self.store.free(names)
            inner = Sorter(reduced, distinct + 1, need, self.memory, self.store)
            at = m
            for pos, lcp in inner.descending():
                here = pos < m  # but for the end of the names
                pos, lcp = pos[here], lcp[here]
                ranked[at - len(pos) : at] = pos[::-1]
                common[at - len(pos) + 1 : at + 1] = lcp[::-1]
                at -= len(pos)
            self.store.free(reduced)
        else:
            start = np.zeros(distinct + 1, np.int64)
            for s in self._slices(m):
                start[1:] += np.bincount(names[s], minlength=distinct)
            start = np.cumsum(start)
            for s in self._slices(m):
                own = names[s]
                order = np.argsort(own, kind="stable")
                sorted_ = own[order]
                new = np.flatnonzero(np.concatenate([[True], sorted_[1:] != sorted_[:-1]]))
                size = np.diff(np.append(new, len(order)))
                ranked[np.repeat(start[sorted_[new]] - new, size) + np.arange(len(order))] = order + s.start
                start[sorted_[new]] += size
            for s in self._slices(m):
                a = names[ranked[s]]
                prior = np.concatenate([names[ranked[s.start - 1 : s.start]] if s.start else a[:0], a[:-1]])
                common[s.stop - len(prior) : s.stop] = a[-len(prior) :] == prior if len(prior) else 0
            self.store.free(names)
        near = self.store.array(m + 1, np.uint8, 0)
        for s in self._slices(m - 1):
            i, j, k = ranked[s].astype(np.int64), ranked[s.start + 1 : s.stop + 1].astype(np.int64), common[s.start + 1 : s.stop + 1].astype(np.int64)
            a, b = lms[i].astype(np.int64), lms[j].astype(np.int64)
            # Common names tell the common symbols up to the name that differs.
            known = np.where(k >= need, self.limit, lms[np.minimum(i + k, m - 1)] - a)
            near[s.start + 1 : s.stop + 1] = shared(self.t, a, b, self.limit, known)
        for s in self._slices(m):
            ranked[s] = lms[ranked[s]]
        self.store.free(common)
        return ranked, near

    def _targets(self, pos: np.ndarray, lcp: np.ndarray, head: np.ndarray, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """What the kept of some sources in order induce: first symbols, ascending, suffixes and shared prefixes."""
        sel = np.flatnonzero(keep)
        first = head[sel]
        order = np.argsort(first, kind="stable")
        src, first = sel[order], first[order]
        target = pos[src] - 1
        if not len(src):
            return first, target, np.zeros(0, np.uint8)
        new = np.concatenate([[True], first[1:] != first[:-1]])
        starts = np.flatnonzero(new)
        out = np.zeros(len(src), np.int64)
        rest = np.flatnonzero(~new)
        if len(rest):
            out[rest] = np.minimum(least_between(lcp, src[rest - 1] + 1, src[rest]).astype(np.int64) + 1, self.limit)
        head = first[starts]
        before = self.last[head]
        known = np.flatnonzero(before >= 0)
        out[starts[known]] = shared(self.t, before[known], target[starts[known]], self.limit)
        self.last[head] = target[np.append(starts[1:], len(src)) - 1]
        return first, target, out.astype(np.uint8)

    def _push(self, waiting: Waiting, first: np.ndarray, target: np.ndarray, lcp: np.ndarray) -> None:
        if len(first):
            b = self.bucket[first]
            cut = [0, *(np.flatnonzero(b[1:] != b[:-1]) + 1).tolist(), len(b)]
            for s, e in zip(cut[:-1], cut[1:], strict=True):
                waiting.push(int(b[s]), target[s:e], lcp[s:e])

    def _heads(self, pos: np.ndarray) -> np.ndarray:
        """The symbols before suffixes; any before the first one."""
        return self.t[np.maximum(pos, 1) - 1].astype(self.symbol, copy=False)

    def _pass(self, up: bool, seeds) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Blocks (suffixes, shared prefixes, whether seeded) in order of the pass.

        seeds: gives the seeds of a bucket in lots, in order of the pass; they come
        after all that is induced with the same first symbol.
        """
        t, sign = self.t, 1 if up else -1
        waiting = Waiting(self.store, len(self.first), self.kind, self.memory)
        self.last = self.store.array(self.symbols, self.kind, -1)
        onward = lambda pos, head, sym, seeded: (pos > 0) & ((head > sym if up else head < sym) | ((head == sym) & ~seeded))
        for b in range(len(self.first))[::sign]:
            low, high = int(self.bounds[b]), int(self.bounds[b + 1]) - 1
            if low == high:
                end = None
                while (got := waiting.some(b, self.memory)) is not None:
                    pos, lcp = got
                    yield pos, lcp, np.zeros(len(pos), bool)
                    head = self._heads(pos)
                    self._push(waiting, *self._targets(pos, lcp, head, onward(pos, head, low, np.False_)))
                    end = pos[-1:]
                for pos, lcp in seeds(b):
                    lcp[0] = 0 if end is None else shared(t, end, pos[:1], self.limit)[0]
                    yield pos, lcp, np.ones(len(pos), bool)
                    head = self._heads(pos)
                    self._push(waiting, *self._targets(pos, lcp, head, onward(pos, head, low, np.True_)))
                    end = pos[-1:]
                continue
            pos, lcp = waiting.take(b)
            lots = [*seeds(b)]
            pos, lcp = np.concatenate([pos, *(p for p, _ in lots)]), np.concatenate([lcp, *(x for _, x in lots)])
            if not len(pos):
                continue
            seeded = np.arange(len(pos)) >= len(pos) - sum(len(p) for p, _ in lots)
            pos, lcp, seeded, head = self._settled(pos, lcp, seeded, low, high, sign, onward)
            yield pos, lcp, seeded
            self._push(waiting, *self._targets(pos, lcp, head, onward(pos, head, t[pos], seeded) & ((head < low) | (head > high))))
        waiting.close()
        self.store.free(self.last)

    def _settled(self, pos, lcp, seeded, low: int, high: int, sign: int, onward):
        """A bucket's tuples with all that they induce into it, in order, and the symbols before them."""
        t = self.t
        heads, syms, parts, sources = [], [], [pos], [np.full(len(pos), -1)]
        at, own = 0, seeded
        while True:
            p = parts[-1]
            sym, head = t[p].astype(self.symbol, copy=False), self._heads(p)
            syms.append(sym), heads.append(head)
            pick = np.flatnonzero(onward(p, head, sym, own) & (head >= low) & (head <= high))
            if not len(pick):
                break
            parts.append(p[pick] - 1)
            sources.append(pick + at)
            at, own = at + len(p), np.zeros(len(pick), bool)
        known, n = len(pos), sum(map(len, parts))
        sym, head, source = np.concatenate(syms), np.concatenate(heads), np.concatenate(sources)
        pos = np.concatenate(parts)
        seeded, lcp = np.append(seeded, np.zeros(n - known, bool)), np.append(lcp, np.zeros(n - known, np.uint8))
        place = sym.astype(np.int64)
        main = 2 * (place - low if sign > 0 else high - place) + seeded
        # Of one symbol, what came from before the bucket goes first; the rest follows its sources.
        value = main * (2 * n) + np.arange(n)
        if n > known:
            own, source = main[known:], source[known:]
            order = None
            for _ in range(min(len(parts), self.limit + 1)):  # sources are in place after as many rounds as they are removed
                now = np.lexsort((value[source], own))
                if order is not None and (now == order).all():
                    break
                order = now
                place = np.empty(n - known, np.int64)
                place[order] = np.arange(n - known)
                value[known:] = own * (2 * n) + n + place
        order = np.argsort(value)
        pos, lcp, seeded, sym, head, fresh = pos[order], lcp[order], seeded[order], sym[order], head[order], order >= known
        same = np.concatenate([[False], sym[1:] == sym[:-1]])
        edge = np.flatnonzero(same & (fresh | np.concatenate([[False], seeded[1:] != seeded[:-1]])))
        lcp[~same] = 0
        lcp[edge] = shared(t, pos[edge - 1], pos[edge], self.limit)
        return pos.astype(self.kind), lcp, seeded, head

    def descending(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Blocks (suffixes, shared prefixes) from the largest; each shares its prefix with the one before, of the last block too."""
        n, store = len(self.t), self.store
        lms, larger = self._lms()
        self._deal()
        ranked, near = self._ranked(lms)
        bounds = np.zeros(len(self.first) + 1, np.int64)
        for s in self._slices(len(lms)):
            bounds[1:] += np.bincount(self.bucket[self.t[lms[s]]], minlength=len(self.first))
        bounds = np.cumsum(bounds)
        store.free(lms)

        def smallest(b: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
            for a in range(bounds[b], bounds[b + 1], self.memory):
                e = min(a + self.memory, bounds[b + 1])
                yield ranked[a:e], near[a:e].copy()

        found, share = store.array(larger, self.kind), store.array(larger + 1, np.uint8, 0)
        ends = np.zeros(len(self.first) + 1, np.int64)
        at = 0
        for pos, lcp, seeded in self._pass(True, smallest):
            pos, lcp = pos[~seeded], lcp[~seeded]
            if len(pos):
                found[at : at + len(pos)], share[at : at + len(pos)] = pos, lcp
                ends[1:] += np.bincount(self.bucket[self.t[pos]], minlength=len(self.first))
                at += len(pos)
        store.free(ranked, near)
        ends = np.cumsum(ends)

        def largest(b: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
            for e in range(ends[b + 1], ends[b], -self.memory):
                a = max(e - self.memory, ends[b])
                yield found[a:e][::-1], share[a + 1 : e + 1][::-1].copy()

        for pos, lcp, _ in self._pass(False, largest):
            yield pos, lcp
        store.free(found, share, self.bucket)
        yield np.array([n - 1], self.kind), np.zeros(1, np.uint8)
