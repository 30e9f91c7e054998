"""External induced sorting of suffixes with common-prefix values.

A suffix is of type S when it is smaller than its successor, else of type L; an S suffix behind an L suffix is a seed (S*).  The order of
the seeds induces the order of all L suffixes in one ascending scan, and these induce the S suffixes in one descending scan: a scanned
suffix hands its predecessor to a priority queue keyed by the predecessor's first symbol.

* The queue is monotone, so it is kept as one first-in-first-out file for each symbol: tuples (position, common prefix with the tuple
  before it) are buffered in memory and appended to disk when the buffers exceed a budget.  Scans read tuples in blocks; every step on a
  block is vectorised.
* The common-prefix value of two neighbours handed to one symbol is 1 + the minimum over the scanned values between their sources, which a
  running minimum per symbol carries from block to block.  Values are cut at ``cap``.
* The seeds are sorted by naming the substrings between them (packed words of symbols, refined word by word).  If names repeat, the string
  of names is sorted by recursion: induced again while its alphabet has at most ``MAX_SIGMA`` names (a scan visits symbols one by one),
  else by rank doubling up to ``cap`` names, which is as far as values are needed.
* The text and the scans' tuples can lie in memory-mapped files below ``folder``.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np

from . import textvec as V

MAX_SIGMA = 1024
BLOCK = 1 << 18
BUDGET = 64 << 20
UNIT = V.unit_table(512, 31)
Blocks = Iterator[tuple[np.ndarray, np.ndarray]]


def joined(blocks: list[tuple[np.ndarray, np.ndarray]]) -> Blocks:
    """The same tuples in blocks of about BLOCK: many small blocks would cost a step each."""
    group: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0
    for b in blocks:
        group.append(b)
        size += len(b[0])
        if size >= BLOCK:
            yield (b if len(group) == 1 else (np.concatenate([x[0] for x in group]), np.concatenate([x[1] for x in group])))
            group, size = [], 0
    if group:
        yield (group[0] if len(group) == 1 else (np.concatenate([x[0] for x in group]), np.concatenate([x[1] for x in group])))


class BucketQueue:
    """A disk-backed monotone priority queue: tuples of one key come out in the order they went in (or in reverse)."""

    RECORD = np.dtype([("pos", "<i8"), ("lcp", "<u2")])

    def __init__(self, folder: str, name: str, budget: int):
        self.base, self.budget, self.bytes = os.path.join(folder, name), budget, 0
        self.held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        self.spilled: dict[int, int] = {}

    def push(self, key: int, pos: np.ndarray, lcp: np.ndarray) -> None:
        self.held.setdefault(key, []).append((pos, lcp))
        self.bytes += pos.nbytes + lcp.nbytes
        if self.bytes > self.budget:
            for k, blocks in self.held.items():
                with open(f"{self.base}-{k}", "ab") as f:
                    for p, m in blocks:
                        rec = np.empty(len(p), self.RECORD)
                        rec["pos"], rec["lcp"] = p, m
                        rec.tofile(f)
                        self.spilled[k] = self.spilled.get(k, 0) + len(p)
            self.held, self.bytes = {}, 0

    def pop(self, key: int) -> Blocks:
        """All tuples of ``key`` so far, in order."""
        n, held = self.spilled.pop(key, 0), self.held.pop(key, [])
        self.bytes -= sum(p.nbytes + m.nbytes for p, m in held)
        if n:
            path = f"{self.base}-{key}"
            os.rename(path, path + ".read")
            for a in range(0, n, BLOCK):
                rec = np.fromfile(path + ".read", self.RECORD, min(BLOCK, n - a), offset=a * self.RECORD.itemsize)
                yield rec["pos"].astype(np.int64), rec["lcp"].astype(np.uint16)
            os.remove(path + ".read")
        yield from joined(held)

    def pop_reversed(self, key: int) -> Blocks:
        """All tuples of ``key``, last first."""
        n, held = self.spilled.pop(key, 0), self.held.pop(key, [])
        self.bytes -= sum(p.nbytes + m.nbytes for p, m in held)
        for p, m in reversed(list(joined(held))):
            yield p[::-1], m[::-1]
        if n:
            path = f"{self.base}-{key}"
            for b in range(n, 0, -BLOCK):
                a = max(0, b - BLOCK)
                rec = np.fromfile(path, self.RECORD, b - a, offset=a * self.RECORD.itemsize)
                yield rec["pos"][::-1].astype(np.int64), rec["lcp"][::-1].astype(np.uint16)
            os.remove(path)


def refine(rank: np.ndarray, active: np.ndarray, key: np.ndarray, top: int | None = None) -> np.ndarray:
    """Split groups of equal rank by ``key`` (from -1 to ``top`` - 1, where that is known); rank is the number of smaller items, and whole groups
    are active.  Returns the members of groups that are still shared."""
    own = rank[active]
    if top is not None:
        order = np.argsort(own * np.int64(top + 1) + (key + 1))
    elif own.min() == own.max():
        order = np.argsort(key)
    else:
        order = np.lexsort((key, own))
    who, k, r = active[order], key[order], own[order]
    del own, order
    start = np.append(True, r[1:] != r[:-1])
    fresh = start | np.append(True, k[1:] != k[:-1])
    place = np.arange(len(who), dtype=np.int32 if len(who) < 1 << 31 else np.int64)
    sub = np.maximum.accumulate(np.where(fresh, place, 0))
    sub -= np.maximum.accumulate(np.where(start, place, 0))
    rank[who] = r + sub
    end = np.append(fresh[1:], True)
    return who[~(fresh & end)]


def name_ranks(t: np.ndarray, lms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rank of the substring at each seed, members of shared ranks).  A substring that ends where an equal longer one goes on is larger."""
    m = len(lms)
    size = np.append(lms[1:] - lms[:-1] + 1, 1)
    wide = int(t.max()) + 3 > 511
    bits, per = (31, 2) if wide else (9, 7)
    top = np.uint64((1 << bits) - 1)

    def word(who: np.ndarray, k: int) -> np.ndarray:
        out = np.zeros(len(who), np.uint64)
        for x in range(0, len(who), BLOCK):
            own = out[x : x + BLOCK]
            at, n = lms[who[x : x + BLOCK]], size[who[x : x + BLOCK]]
            for o in range(k * per, k * per + per):
                sym = np.where(o < n, t[np.minimum(at + o, len(t) - 1)].astype(np.uint64) + np.uint64(1), np.where(o == n, top, np.uint64(0)))
                own <<= np.uint64(bits)
                own |= sym
        return out

    rank = np.zeros(m, np.int64)
    active, k = np.arange(m, dtype=np.int32 if m < 1 << 31 else np.int64), 0
    shared = [np.empty(0, active.dtype)]
    while len(active):
        active = refine(rank, active, word(active, k).view(np.int64))
        k += 1
        over = size[active] < k * per  # the end mark was in the word: equal substrings
        shared.append(active[over])
        active = active[~over]
    return rank, np.concatenate(shared)


class SuffixSorter:
    """Suffixes of ``t`` (symbols from 0; the last one is the only 0), largest first, with values cut at ``cap``."""

    def __init__(self, t: np.ndarray, folder: str, cap: int = 400, budget: int = BUDGET, level: int = 0):
        self.t, self.folder, self.cap, self.budget, self.level = t, folder, cap, budget, level
        n = len(t)
        self.small = np.ones(n, bool)  # type S; the last symbol is
        for b in range(n - 1, 0, -BLOCK):  # types of [a, b), from the right: a symbol like its successor has its successor's type
            a = max(0, b - BLOCK)
            here, after = t[a:b], t[a + 1 : b + 1]
            at = np.where(here != after, np.arange(b - a, dtype=np.int32), np.int32(b - a))
            nearest = np.minimum.accumulate(at[::-1])[::-1]
            self.small[a:b] = np.append(here < after, self.small[b])[nearest]
        lead = self.small[1:] & ~self.small[:-1]
        self.lms = np.flatnonzero(lead).astype(np.int32 if n < 1 << 31 else np.int64) + 1
        del lead
        self.sigma = int(t.max()) + 1

    def seed_order(self) -> np.ndarray:
        """The seeds, sorted."""
        rank, shared = name_ranks(self.t, self.lms)
        m = len(rank)
        if len(shared):
            distinct = np.unique(rank)
            if len(distinct) <= MAX_SIGMA and m > 64:
                names = np.searchsorted(distinct, rank).astype(np.int32)
                inner = SuffixSorter(names, self.folder, self.cap, self.budget, self.level + 1)
                order = np.concatenate([p for p, _ in inner.descending()])[::-1]
                return self.lms[order]
            k = 1
            while len(shared) and k <= self.cap // 2:  # a name stands for two symbols at least, so 2 k names reach beyond the cap
                nxt = shared + k
                key = np.where(nxt < m, rank[np.minimum(nxt, m - 1)], -1)
                shared = refine(rank, shared, key, m)
                k *= 2
        return self.lms[np.argsort(rank, kind="stable")]

    def seed_lcp(self, order: np.ndarray) -> np.ndarray:
        """Common prefixes of neighbouring seeds, cut at the cap, by binary search over span hashes."""
        out = np.zeros(len(order), np.uint16)
        if self.level or len(order) < 2:
            return out
        h = V.symbol_hash(self.t, UNIT)
        n = len(self.t)
        for x in range(1, len(order), BLOCK):
            a, b = order[x - 1 : x - 1 + BLOCK][: len(order) - x], order[x : x + BLOCK]
            ha, hb, pa, pb = h[a], h[b], V.power_at(a), V.power_at(b)
            value = np.minimum(self.cap, n - np.maximum(a, b))
            rest = np.flatnonzero((h[a + value] - ha) * pb != (h[b + value] - hb) * pa)  # the others share all there is
            a, b, ha, hb, pa, pb = (v[rest] for v in (a, b, ha, hb, pa, pb))
            lo, hi = np.zeros(len(rest), np.int64), value[rest] - 1
            while (lo < hi).any():
                mid = (lo + hi + 1) // 2
                same = (h[a + mid] - ha) * pb == (h[b + mid] - hb) * pa
                lo, hi = np.where(same, mid, lo), np.where(same, hi, mid - 1)
            value[rest] = lo
            out[x : x + BLOCK] = value
        del h
        return out

    def run_length(self, pos: int) -> int:
        """How often the symbol at ``pos`` repeats there, cut at the cap."""
        part = self.t[pos : pos + self.cap + 1] != self.t[pos]
        return min(self.cap, int(part.argmax()) if part.any() else len(part))

    def induce(self, pos: np.ndarray, lcp: np.ndarray, kind: bool, queue: BucketQueue, least: np.ndarray, seen: np.ndarray) -> None:
        """Hand the predecessors of type ``kind`` of a block of scanned suffixes to the queue."""
        ext = np.append(lcp, np.uint16(0xFFFF))
        behind = np.minimum.accumulate(ext[::-1])[::-1]
        ok = pos > 0
        ok &= self.small[pos - 1] == kind
        idx = np.flatnonzero(ok)
        if not len(idx):
            np.minimum(least, behind[0], out=least)
            return
        prev = pos[idx] - 1
        sym = self.t[prev]
        order = np.argsort(sym, kind="stable")
        idx, prev, sym = idx[order], prev[order], sym[order]
        first = np.flatnonzero(np.append(True, sym[1:] != sym[:-1]))
        last = np.append(first[1:], len(sym)) - 1
        own = sym[first]
        value = np.empty(len(idx), np.uint16)
        value[1:] = np.minimum.reduceat(ext, idx + 1)[:-1]
        value[first] = np.minimum(np.minimum.accumulate(lcp)[idx[first]], least[own])
        value = np.minimum(value.astype(np.int32) + 1, self.cap).astype(np.uint16)
        value[first[~seen[own]]] = 0
        seen[own] = True
        np.minimum(least, behind[0], out=least)
        least[own] = behind[idx[last] + 1]
        for k, a, b in zip(own.tolist(), first.tolist(), (last + 1).tolist(), strict=True):
            queue.push(k, prev[a:b], value[a:b])

    def descending(self) -> Blocks:
        """All suffixes, largest first: (positions, common prefix with the suffix before in this order)."""
        t, name = self.t, f"s{self.level}-{id(self):x}"
        if len(t) == 1:
            yield np.zeros(1, np.int64), np.zeros(1, np.uint16)
            return
        seeds = self.seed_order()
        values = self.seed_lcp(seeds)
        edge = np.searchsorted(t[seeds], np.arange(self.sigma + 1))
        large = BucketQueue(self.folder, f"{name}-l", self.budget)
        done = BucketQueue(self.folder, f"{name}-d", self.budget)
        tail = np.full(self.sigma, -1, np.int64)  # last (largest) L suffix of each symbol
        least, seen = np.full(self.sigma, 0xFFFF, np.uint16), np.zeros(self.sigma, bool)
        for c in range(self.sigma):
            fresh = True
            while c in large.held or c in large.spilled:
                for pos, lcp in list(large.pop(c)) if c not in large.spilled else large.pop(c):
                    done.push(c, pos, lcp)
                    tail[c] = pos[-1]
                    if fresh:
                        lcp = lcp.copy()
                        lcp[0], fresh = 0, False
                    self.induce(pos, lcp, False, large, least, seen)
            a, b = int(edge[c]), int(edge[c + 1])
            for x in range(a, b, BLOCK):
                pos, lcp = seeds[x : min(b, x + BLOCK)], values[x : min(b, x + BLOCK)]
                if x == a:
                    lcp = lcp.copy()
                    lcp[0] = 0 if tail[c] < 0 else min(self.run_length(int(tail[c])), self.run_length(int(pos[0])))
                self.induce(pos, lcp, False, large, least, seen)
        del seeds, values
        small = BucketQueue(self.folder, f"{name}-s", self.budget)
        least[:], seen[:] = 0xFFFF, False
        for c in range(self.sigma - 1, 0, -1):
            head = -1  # last (smallest) S suffix of the symbol
            while c in small.held or c in small.spilled:
                for pos, lcp in list(small.pop(c)) if c not in small.spilled else small.pop(c):
                    if head < 0:
                        lcp = lcp.copy()
                        lcp[0] = 0
                    head = int(pos[-1])
                    self.induce(pos, lcp, True, small, least, seen)
                    yield pos, lcp
            carry = None
            for pos, lcp in done.pop_reversed(c):
                # the value of a suffix with its smaller neighbour becomes that neighbour's value with its larger one
                out = np.empty(len(lcp), np.uint16)
                out[1:] = lcp[:-1]
                if carry is None:
                    out[0] = 0 if head < 0 else min(self.run_length(head), self.run_length(int(pos[0])))
                else:
                    out[0] = carry
                carry = lcp[-1]
                self.induce(pos, out, True, small, least, seen)
                yield pos, out
        yield np.array([len(t) - 1]), np.zeros(1, np.uint16)


def equal_groups(blocks: Blocks, cap: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(positions, group numbers within the piece, common prefix with the position before) of suffixes that share ``cap`` symbols with a
    neighbour; a group is never cut."""
    open_parts: list[tuple[np.ndarray, np.ndarray]] = []

    def closed() -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        pos, lcp = (np.concatenate([x[k] for x in open_parts]) for k in (0, 1)) if open_parts else ((), ())
        if len(pos) > 1:
            yield pos, np.zeros(len(pos), np.int64), lcp

    for pos, lcp in blocks:
        start = np.flatnonzero(lcp < cap)
        if not len(start):
            open_parts.append((pos, lcp))
            continue
        a, keep = int(start[0]), int(start[-1])
        open_parts.append((pos[:a], lcp[:a]))
        yield from closed()
        mid, values = pos[a:keep], lcp[a:keep]
        same = values >= cap
        if same.any():
            chosen = same | np.append(same[1:], False)
            yield mid[chosen], (np.cumsum(~same) - 1)[chosen], values[chosen]
        open_parts = [(pos[keep:], lcp[keep:])]
    yield from closed()
