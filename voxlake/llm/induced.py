"""Suffix arrays with common prefixes by external induced sorting, for texts far larger than memory.

Queues of suffix tuples (position, symbols shared with the tuple before) stand for ranges of first symbols; what exceeds their
memory goes to an unnamed file that ends with the task. The smallest range is taken next: its tuples put the suffixes that begin one
symbol earlier into the queue of that symbol's range, first those of type L upwards, then those of type S downwards. A new tuple
shares one symbol more than the least that was shared since the last tuple with its first symbol was made. The suffixes to begin
with (leftmost S) are sorted by one round over their substrings, and by recursion on the text of the
substrings' ranks where these repeat, which ends with a text of up to `short` symbols, sorted in memory.
Rounds are numpy over blocks of tuples: a block ends before the first symbol for which it makes a tuple itself.

A text that fits into memory needs no queues: `sparse` sorts the suffixes at given places alone, by words of 8 symbols.
"""

from __future__ import annotations

import tempfile
from collections import defaultdict, deque
from collections.abc import Iterator

import numpy as np

Block = tuple[np.ndarray, np.ndarray]


def disk_array(dtype: type, n: int) -> np.ndarray:
    """An array in an unnamed file."""
    with tempfile.TemporaryFile() as f:
        return np.memmap(f, dtype, "w+", shape=(max(n, 1),))


class Queues:
    """FIFO queues of blocks of tuples by range, in memory up to `memory` bytes, beyond that in an unnamed file."""

    def __init__(self, memory: int):
        self.blocks: dict[int, deque] = defaultdict(deque)
        self.memory, self.held, self.file = memory, 0, None

    def put(self, key: int, pos: np.ndarray, lcp: np.ndarray) -> None:
        size = pos.nbytes + lcp.nbytes
        if self.held + size <= self.memory:
            self.held += size
            self.blocks[key].append((pos, lcp))
            return
        self.file = self.file or tempfile.TemporaryFile()
        at = self.file.seek(0, 2)
        self.file.write(pos.tobytes())
        self.file.write(lcp.tobytes())
        self.blocks[key].append((at, len(pos)))

    def gather(self, key: int, size: int) -> Block | None:
        """The next blocks of a queue as one, of about `size` tuples."""
        got, n = [], 0
        while n < size and (block := self.take(key)):
            got.append(block)
            n += len(block[0])
        return got[0] if len(got) == 1 else (np.concatenate([p for p, _ in got]), np.concatenate([v for _, v in got])) if got else None

    def take(self, key: int, last: bool = False) -> Block | None:
        blocks = self.blocks.get(key)
        if not blocks:
            return None
        a, b = blocks.pop() if last else blocks.popleft()
        if isinstance(a, np.ndarray):
            self.held -= a.nbytes + b.nbytes
            return a, b
        self.file.seek(a)
        return np.frombuffer(self.file.read(8 * b), np.int64), np.frombuffer(self.file.read(b), np.uint8)


def shared(text: np.ndarray, n: int, a: np.ndarray, b: np.ndarray, most: np.ndarray | int) -> np.ndarray:
    """How many symbols, up to `most`, the suffixes at a and b share."""
    out, most = np.zeros(len(a), np.int64), np.broadcast_to(most, len(a))
    active, ahead = np.arange(len(a)), np.arange(8)
    while len(active):
        i, j = a[active] + out[active], b[active] + out[active]
        x, y = i[:, None] + ahead, j[:, None] + ahead
        same = (text[np.minimum(x, n - 1)] == text[np.minimum(y, n - 1)]) & (np.maximum(x, y) < n)
        run = np.where(same.all(1), 8, same.argmin(1))
        out[active] += run
        active = active[(run == 8) & (out[active] < most[active])]
    return np.minimum(out, most)


class Since:
    """Least of the values that followed each place of a sequence: their suffix minima, no more than there are values."""

    def __init__(self, cap: int):
        self.at, self.least, self.n, self.cap = np.empty(0, np.int64), np.empty(0, np.int64), 0, cap

    def after(self, place: np.ndarray) -> np.ndarray:
        i = np.searchsorted(self.at, place, "right")
        return np.append(self.least, self.cap)[i]

    def extend(self, values: np.ndarray) -> None:
        low = np.minimum.accumulate(values[::-1])[::-1]
        change = np.flatnonzero(np.append(low[1:] != low[:-1], True))
        keep = self.least < low[0]
        self.at, self.least = np.append(self.at[keep], self.n + change), np.append(self.least[keep], low[change])
        self.n += len(values)


def ranged_least(values: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Least of values[first:last + 1] for each pair."""
    tables = [values.astype(np.uint8)]
    while 2 ** len(tables) <= len(values):
        t, half = tables[-1], 2 ** (len(tables) - 1)
        tables.append(np.minimum(t[:-half], t[half:]))
    level = np.frexp((last - first + 1).astype(np.float64))[1] - 1
    out = np.empty(len(first), values.dtype)
    for k in np.unique(level):
        here = level == k
        out[here] = np.minimum(tables[k][first[here]], tables[k][last[here] - 2**k + 1])
    return out


class Pass:
    """One way through the suffixes, upwards for type L (`up`) or downwards for type S."""

    def __init__(self, text: np.ndarray, n: int, symbols: int, starts: np.ndarray, cap: int, memory: int, block: int, up: bool):
        self.text, self.n, self.cap, self.block, self.up = text, n, cap, block, up
        self.starts = starts  # first symbols of the ranges
        self.queues = Queues(memory)
        self.last = np.full(symbols, -1, np.int64)  # place in the sequence of the last tuple made for a symbol
        self.since, self.place = Since(cap), 0
        self.end: int | None = None  # the suffix before

    def run(self, pos: np.ndarray, lcp: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Takes tuples in their order; `kind` is true for those of this pass's own type. Gives what they share with the one before, and the new tuples."""
        c = self.text[pos]
        lcp = lcp.astype(np.int64)
        # tuples of the other type follow those of this type with the same symbol: they share a run of it, compared here
        before, own = np.append(self.end if self.end is not None else -1, pos[:-1]), np.append(False if self.end is None else self.end_kind, kind[:-1])
        seam = np.flatnonzero(~kind & own & (self.text[before] == c) & (before >= 0))
        if len(seam):
            lcp[seam] = shared(self.text, self.n, before[seam], pos[seam], self.cap)
        self.end, self.end_kind = int(pos[-1]), bool(kind[-1])
        prev = np.maximum(pos - 1, 0)
        pc = self.text[prev]
        makes = (pc >= c if self.up else pc <= c) & (pos > 0) & (kind | (pc != c))
        at = np.flatnonzero(makes)
        to = pc[at]
        order = np.argsort(to, kind="stable")
        at, to = at[order], to[order]
        new = np.empty(0, np.int64)
        if len(at):
            first = np.append(True, to[1:] != to[:-1])
            begin = np.where(first, 0, np.append(0, at[:-1] + 1))
            least = ranged_least(lcp, begin, at).astype(np.int64)
            seen = self.last[to]
            old = first & (seen >= 0)
            least[old] = np.minimum(least[old], self.since.after(seen[old]))
            new = np.where(first & (seen < 0), 0, np.minimum(least + 1, self.cap))
            final = np.append(first[1:], True)
            self.last[to[final]] = self.place + at[final]
        self.since.extend(lcp)
        self.place += len(pos)
        return lcp, prev[at], new.astype(np.uint8)

    def put(self, pos: np.ndarray, lcp: np.ndarray) -> None:
        """Queues new tuples, which come by symbol."""
        if len(pos):
            r = np.searchsorted(self.starts, self.text[pos], "right") - 1
            cuts = np.append(np.flatnonzero(np.append(True, r[1:] != r[:-1])), len(r))
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                self.queues.put(int(r[a]), pos[a:b], lcp[a:b])

    def through(self, r: int, single: bool, others: Iterator[Block]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """The tuples of a range in order: (pos, lcp, kind). `others` are those of the other type."""
        if single:
            while block := self.queues.gather(r, self.block):
                kind = np.ones(len(block[0]), bool)
                lcp, *new = self.run(*block, kind)
                self.put(*new)
                yield block[0], lcp, kind
            for pos, lcp in others:
                kind = np.zeros(len(pos), bool)
                lcp, *new = self.run(pos, lcp, kind)
                self.put(*new)
                yield pos, lcp, kind
            return
        sign = 1 if self.up else -1
        take, kinds = list(others), []
        kinds = [np.zeros(len(p), bool) for p, _ in take]
        pos, lcp, kind = (np.concatenate([np.empty(0, t), *x]) for t, x in ((np.int64, (p for p, _ in take)), (np.uint8, (v for _, v in take)), (bool, kinds)))
        while True:
            if got := self.queues.gather(r, self.n):
                pos, lcp, kind = np.append(pos, got[0]), np.append(lcp, got[1]), np.append(kind, np.ones(len(got[0]), bool))
            if not len(pos):
                return
            c = self.text[pos] * sign
            order = np.lexsort((~kind, c))
            pos, lcp, kind, c = pos[order], lcp[order], kind[order], c[order]
            # up to the first symbol for which these make a tuple within the range
            pc = self.text[np.maximum(pos - 1, 0)] * sign
            made = pc[(pc >= c) & (pos > 0) & (kind | (pc != c))]
            limit = made.min() if len(made) else c[-1] + 1
            now = int(np.searchsorted(c, limit)) or int(np.searchsorted(c + 0.5 * ~kind, limit, "right"))
            shares, *new = self.run(pos[:now], lcp[:now], kind[:now])
            yield pos[:now], shares, kind[:now]
            pos, lcp, kind = pos[now:], lcp[now:], kind[now:]
            self.put(*new)


def induced(text: np.ndarray, n: int, symbols: int, seeds: np.ndarray, lcp: np.ndarray, cap: int, memory: int, block: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """All suffixes downwards as blocks (pos, symbols shared with the one before, type S), from the sorted leftmost S of each run and what each shares with the one before."""
    counts = np.bincount(text[:n], minlength=symbols)
    # ranges of so many suffixes that few of them make others of their own range; a symbol that has more stands alone
    total = np.cumsum(counts) // max(64, int(2 * n**0.5))
    starts = np.flatnonzero(np.append(True, total[1:] != total[:-1])) if symbols > 256 else np.arange(symbols)
    widths = np.diff(np.append(starts, symbols))
    up = Pass(text, n, symbols, starts, cap, memory, block, True)
    kept = Queues(memory)
    cuts = np.append(np.searchsorted(text[seeds], starts), len(seeds))

    def seeded(r: int) -> Iterator[Block]:
        for i in range(cuts[r], cuts[r + 1], block):
            j = min(i + block, cuts[r + 1])
            yield np.asarray(seeds[i:j]), np.asarray(lcp[i:j])

    for r, width in enumerate(widths.tolist()):
        for pos, shares, kind in up.through(r, width == 1, seeded(r)):
            if kind.any():
                kept.put(r, pos[kind], shares[kind].astype(np.uint8))
    down = Pass(text, n, symbols, starts, cap, memory, block, False)

    def reversed_l(r: int) -> Iterator[Block]:
        later = 0  # shared by the next block's first suffix and this one's last, of the same symbol or none
        while got := kept.take(r, last=True):
            pos, shares = got
            yield pos[::-1].copy(), np.append(later, shares[:0:-1]).astype(np.uint8)
            later = shares[0]

    for r in reversed(range(len(starts))):
        yield from down.through(r, widths[r] == 1, reversed_l(r))
    last = np.array([n - 1])
    yield last, shared(text, n, np.array([down.end if down.end is not None else n - 1]), last, cap), np.ones(1, bool)


def in_memory(text: np.ndarray, n: int, cap: int, block: int) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes of a short text upwards, by ranks of prefixes that double, and what each shares with the one before."""
    order = np.argsort(text[:n], kind="stable")
    rank, length = np.empty(n, np.int64), 1
    new = np.append(True, text[order][1:] != text[order][:-1])
    while True:
        head = np.maximum.accumulate(np.where(new, np.arange(n), 0))
        rank[order] = head
        tied = np.flatnonzero(~(new & np.append(new[1:], True)))
        if not len(tied):
            break
        at = order[tied]
        second = np.where(at + length < n, rank[np.minimum(at + length, n - 1)] + 1, 0)
        key = head[tied] * (n + 1) + second
        by = np.argsort(key, kind="stable")
        order[tied], key = at[by], key[by]
        new[tied] = np.append(True, key[1:] != key[:-1])
        length *= 2
    lcp = np.zeros(n, np.int64)
    for i in range(1, n, block):
        lcp[i : i + block] = shared(text, n, order[i - 1 : min(i + block, n) - 1], order[i : i + block], cap)
    return order, lcp


def sparse(text: np.ndarray, at: np.ndarray, cap: int) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes at `at` (each of `cap` bytes at least, 8 or more) upwards by their first `cap` bytes, and whether each shares all of these with the one before.

    Ties are sorted by the first word in which neighbours of their group differ, so what a group shares is read once.
    """
    words = np.ndarray(len(text) - 7, ">u8", np.ascontiguousarray(text), strides=(1,)).astype(np.uint64)
    steps = np.append(np.arange(0, cap - 8, 8), cap - 8)  # the last word overlaps the one before, which is shared by then
    key = words[at]
    order = np.argsort(key)
    at, key = at[order], key[order]
    same = np.zeros(len(at), bool)
    first = np.append(True, key[1:] != key[:-1])[: len(at)]
    slot, depth = np.arange(len(at)), np.ones(len(at), np.int64)  # place in the order, words that a group shares
    while True:
        tied = np.flatnonzero(~(first & np.append(first[1:], True)))
        slot, first, depth = slot[tied], first[tied], depth[tied]
        if not len(slot):
            return at, same
        pos = at[slot]
        alike = depth.copy()
        open_ = np.flatnonzero(~first & (depth < len(steps)))
        while len(open_):
            step = steps[alike[open_]]
            open_ = open_[words[pos[open_] + step] == words[pos[open_ - 1] + step]]
            alike[open_] += 1
            open_ = open_[alike[open_] < len(steps)]
        alike[first] = len(steps)
        begin = np.flatnonzero(first)
        size = np.diff(np.append(begin, len(pos)))
        least = np.repeat(np.minimum.reduceat(alike, begin), size)
        same[slot[(least == len(steps)) & ~first]] = True
        rest = np.flatnonzero(least < len(steps))
        slot, pos, depth = slot[rest], pos[rest], least[rest]
        group = np.cumsum(first[rest])
        key = words[pos + steps[depth]]
        order = np.lexsort((key, group))
        at[slot], key = pos[order], key[order]
        first = np.append(True, (group[1:] != group[:-1]) | (key[1:] != key[:-1]))[: len(slot)]
        depth += 1


def suffixes(text: np.ndarray, n: int, symbols: int, cap: int, memory: int = 1 << 26, block: int = 1 << 16, short: int = 1 << 22) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Suffixes of a text of `n` symbols, the last of which is 0, downwards in blocks (pos, symbols shared with the one before up to `cap`, type S)."""
    if n < 2:
        yield np.zeros(n, np.int64), np.zeros(n, np.int64), np.ones(n, bool)
        return
    # leftmost S: a suffix less than the one before it, of which the next other symbol is greater
    parts, ahead = [], np.int8(-1)
    for j in range(n - 1, 0, -block):
        i = max(1, j - block + 1)
        c = text[i : j + 1].astype(np.int64)
        step = np.sign(np.append(c[1:], int(text[j + 1]) if j + 1 < n else -1) - c).astype(np.int8)  # +1: the next is greater
        if j == n - 1:
            step[-1] = 1
        idx = np.where(step != 0, np.arange(len(c)), len(c))
        idx = np.minimum.accumulate(idx[::-1])[::-1]
        way = np.append(step, ahead)[idx]
        ahead = way[0]
        parts.append(i + np.flatnonzero((way == 1) & (np.append(int(text[i - 1]), c[:-1]) > c)))
    seeds = np.concatenate(parts[::-1])  # by position; the last is n - 1
    if not len(seeds) or seeds[-1] != n - 1:
        seeds = np.append(seeds, n - 1)
    m = len(seeds)
    # sorted by their substrings: one way through from any order of the seeds
    any_order = seeds[np.argsort(text[seeds], kind="stable")]
    any_order = np.append(n - 1, any_order[any_order != n - 1])
    ranked, fill = disk_array(np.int64, m), m
    for pos, _, kind in induced(text, n, symbols, any_order, np.zeros(m, np.uint8), cap, memory, block):
        own = pos[kind & (pos > 0)]
        own = own[(text[own - 1] > text[own])]
        own = own[own != n - 1] if fill == m else own
        ranked[fill - len(own) : fill] = own[::-1]
        fill -= len(own)
    ranked[0] = n - 1
    which = np.searchsorted(seeds, ranked[:m])
    ends = np.append(seeds[1:], n - 1)
    size = ends[which] - seeds[which] + 1
    name = np.zeros(m, np.int64)
    for i in range(1, m, block):
        a, b = which[i - 1 : min(i + block, m) - 1], which[i : i + block]
        same = size[i - 1 : i - 1 + len(b)] == size[i : i + block]
        same[same] = shared(text, n, seeds[a][same], seeds[b][same], size[i : i + block][same]) == size[i : i + block][same]
        if i == 1:
            same[0] = False
        name[i : i + block] = ~same
    names = disk_array(np.int64, m)
    names[which] = np.cumsum(name)
    kinds = int(name.sum()) + 1
    del which, ends, size, name
    order, equal = disk_array(np.int64, m), np.zeros(m, np.int64)
    if kinds == m:
        order[names[:m]] = np.arange(m)
    elif m <= short:
        order[:m], equal = in_memory(np.array(names[:m]), m, cap, block)
    else:
        fill = m
        for pos, lcp, _ in suffixes(names, m, kinds, cap, memory, block, short):
            order[fill - len(pos) : fill] = pos[::-1]
            # downwards, a suffix shares with the one before what that one shares with it upwards
            stop = min(fill + 1, m)
            equal[fill - len(pos) + 1 : stop] = lcp[::-1][: stop - (fill - len(pos) + 1)]
            fill -= len(pos)
    begin = seeds[order[:m]]
    lcp = disk_array(np.uint8, m)
    for i in range(1, m, block):
        a, b, k = order[i - 1 : min(i + block, m) - 1], order[i : i + block], equal[i : i + block]
        skip = np.minimum(seeds[np.minimum(a + k, m - 1)] - seeds[a], cap)
        lcp[i : i + block] = np.minimum(skip + shared(text, n, seeds[a] + skip, seeds[b] + skip, cap - skip), cap)
    yield from induced(text, n, symbols, begin, lcp[:m], cap, memory, block)
