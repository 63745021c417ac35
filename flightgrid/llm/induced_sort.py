"""External suffix sorting by induction, with common-prefix values.

The text is a sequence of numbers.  Suffixes are of type S if smaller than the next
suffix, else L; an S after an L is S*.  The substrings between S* places are sorted in
runs on disk and named; while names repeat, the sequence of names is sorted by the same
method (the recursion), which orders the S* suffixes.  From them the L suffixes are
induced in ascending order, and from those the S suffixes in descending order.  The
queues of induction are priority queues by first symbol: an entry is a suffix and the
number of symbols it shares with the entry before it, one more than the least such
number between the two suffixes that induced them.  Queues beyond ``memory`` entries
go to an unlinked file, so the text may be far larger than what the queues may hold.

Where symbols are few beside the text's length, a queue's entries are taken a batch at
a time with numpy: what a batch induces for its own symbol is the next batch, so the
order is that of taking them one by one.  Sequences of names have many symbols with
few suffixes each; their entries are taken one by one, those of a sequence that is
within ``memory`` from plain lists.
"""

from __future__ import annotations

import heapq
import tempfile
from array import array
from bisect import bisect_right
from collections import deque
from collections.abc import Iterable, Iterator

import numpy as np

#: Suffixes a symbol from which entries are taken by batches.
FEW = 64
BATCH = 1 << 16


class Queue:
    """A monotone priority queue of (symbol, suffix, shared): smallest (or, where
    ``down``, largest) symbol first, then first in, first out."""

    def __init__(self, memory: int, down: bool = False):
        self.memory, self.sign = memory, -1 if down else 1
        self.tails: dict[int, array] = {}
        self.spilled: dict[int, list[tuple[int, int]]] = {}
        self.order: list[int] = []
        self.held, self.file = 0, None

    def push(self, symbol: int, suffix: int, shared: int) -> None:
        tail = self.tails.get(symbol)
        if tail is None:
            tail = self.tails[symbol] = array("q")
            if symbol not in self.spilled:
                heapq.heappush(self.order, self.sign * symbol)
        tail.append(suffix)
        tail.append(shared)
        self.held += 1

    def spill(self, but: int) -> None:
        """Move the queues of all symbols but one to disk."""
        if self.file is None:
            self.file = tempfile.TemporaryFile()
        self.file.seek(0, 2)
        for symbol in [s for s in self.tails if s != but]:
            tail = self.tails.pop(symbol)
            self.spilled.setdefault(symbol, []).append((self.file.tell(), len(tail)))
            tail.tofile(self.file)
            self.held -= len(tail) // 2

    def first(self) -> int | None:
        return self.sign * self.order[0] if self.order else None

    def drain(self) -> Iterator[tuple[int, int]]:
        """The first symbol's (suffix, shared); more may be pushed meanwhile, for this
        symbol or later ones."""
        symbol = self.sign * heapq.heappop(self.order)
        for at, n in self.spilled.pop(symbol, ()):
            for k in range(0, n, 1 << 16):
                part = array("q")
                self.file.seek(at + 8 * k)
                part.fromfile(self.file, min(n - k, 1 << 16))
                yield from zip(part[::2], part[1::2], strict=True)
        tail, i = self.tails.setdefault(symbol, array("q")), 0
        while i < len(tail):
            yield tail[i], tail[i + 1]
            i += 2
            if self.held > self.memory:
                self.spill(symbol)
        del self.tails[symbol]
        self.held -= len(tail) // 2

    def close(self) -> None:
        if self.file is not None:
            self.file.close()


class BatchQueue:
    """Queues of (suffixes, shared) arrays, one a symbol, first in, first out."""

    def __init__(self, memory: int):
        self.memory = memory
        self.parts: dict[int, deque] = {}
        self.held, self.file = 0, None

    def push(self, symbol: int, suffix: np.ndarray, shared: np.ndarray) -> None:
        self.parts.setdefault(symbol, deque()).append((suffix, shared))
        self.held += len(suffix)

    def pop(self, symbol: int) -> tuple[np.ndarray, np.ndarray] | None:
        """The symbol's entries so far, or as many of them as a batch holds."""
        parts = self.parts.get(symbol)
        if parts is None:
            return None
        found, n = [], 0
        while parts and n < BATCH:
            part = parts.popleft()
            if isinstance(part[0], int):  # on disk: place and number
                self.file.seek(part[0])
                raw = np.frombuffer(self.file.read(16 * part[1]), np.int64)
                part = raw[: part[1]], raw[part[1] :]
            else:
                self.held -= len(part[0])
            found.append(part)
            n += len(part[0])
        if not parts:
            del self.parts[symbol]
        return found[0] if len(found) == 1 else tuple(np.concatenate(x) for x in zip(*found, strict=True))

    def spill(self) -> None:
        """Move all arrays in memory to disk, if they are too many."""
        if self.held <= self.memory:
            return
        if self.file is None:
            self.file = tempfile.TemporaryFile()
        at = self.file.seek(0, 2)
        for parts in self.parts.values():
            for k, (suffix, shared) in enumerate(parts):
                if not isinstance(suffix, int):
                    self.file.write(suffix.tobytes() + shared.tobytes())
                    parts[k] = (at, len(suffix))
                    at += 16 * len(suffix)
        self.held = 0

    def close(self) -> None:
        if self.file is not None:
            self.file.close()


def sorted_on_disk(items: Iterable[tuple[bytes, int]], memory: int) -> Iterator[tuple[bytes, int]]:
    """Merge of sorted runs of ``memory`` items."""
    import pickle

    runs, part = [], []

    def read(f) -> Iterator[tuple[bytes, int]]:
        with f:
            while True:
                try:
                    yield from pickle.load(f)
                except EOFError:
                    return

    for x in items:
        part.append(x)
        if len(part) >= memory:
            part.sort()
            f = tempfile.TemporaryFile()
            for i in range(0, len(part), 4096):
                pickle.dump(part[i : i + 4096], f)
            f.seek(0)
            runs.append(read(f))
            part = []
    part.sort()
    return heapq.merge(*runs, part) if runs else iter(part)


class Shared:
    """Least value between two entries of a growing sequence."""

    def __init__(self) -> None:
        self.at: list[int] = []
        self.value: list[int] = []
        self.n = 0

    def add(self, value: int) -> None:
        at, values = self.at, self.value
        while values and values[-1] >= value:
            at.pop()
            values.pop()
        at.append(self.n)
        values.append(value)
        self.n += 1

    def since(self, entry: int) -> int:
        """Least value added after entry number ``entry``."""
        return self.value[bisect_right(self.at, entry)]


def types(t: np.ndarray) -> np.ndarray:
    """True for S; the last symbol, the smallest, is S."""
    n = len(t)
    rising = np.zeros(n, np.int8)
    rising[:-1] = np.sign(t[1:].astype(np.int64) - t[:-1])
    rising[-1] = 1
    # Equal neighbours take the type of the first later place where they differ.
    place = np.where(rising != 0, np.arange(n), n)
    place = np.minimum.accumulate(place[::-1])[::-1]
    return rising[place] > 0


def common(t: np.ndarray, a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
    """Symbols that suffixes a and b share, ``most`` at most."""
    out = np.zeros(len(a), np.int64)
    live = np.arange(len(a))
    for d in range(most):
        x, y = a[live] + d, b[live] + d
        ok = (x < len(t)) & (y < len(t))
        live, x, y = live[ok], x[ok], y[ok]
        live = live[t[x] == t[y]]
        if not len(live):
            break
        out[live] += 1
    return out


def suffix_order(t: np.ndarray, most: int = 0, memory: int = 1_000_000) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes of ``t`` in order and the symbols each shares with the one before it
    (counted up to ``most``).  The last symbol must be the only 0."""
    n = len(t)
    if n == 1:
        return np.zeros(1, np.int64), np.zeros(1, np.int64)
    s = types(t)
    star = np.flatnonzero(s[1:] & ~s[:-1]) + 1
    ordered = star[_star_order(t, star, memory)]
    near = np.zeros(len(ordered), np.int64)
    if most and len(ordered) > 1:
        near[1:] = common(t, ordered[:-1], ordered[1:], most)
    if n >= FEW * (int(t.max()) + 1):
        text, is_s, induce = t, s, _induce_batches
    elif not most and n <= memory:
        text, is_s, induce = t, s, _induce_names
    else:
        text, is_s, induce = t.tolist(), s.tolist(), _induce
    # Ascending: S* suffixes induce L suffixes.
    large, shares = induce(memory, text, is_s, ordered, near, False, most)
    # Descending: L suffixes induce S suffixes.  What an L suffix shares with the one
    # below it is what that one shares with the one above it.
    above = np.append(0, shares[::-1][:-1])
    found, shares = induce(memory, text, is_s, large[::-1], above, True, most)
    # The end of the text follows last; what each shares with the one above is now
    # moved to the upper of the two.
    sa = np.append(found, n - 1)[::-1]
    return sa, np.concatenate([[0, 0], shares[1:][::-1]])


def lowest(v: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least of v[a:b] for each pair, a < b."""
    size = b - a
    out = np.empty(len(a), v.dtype)
    step, width = v, 1
    todo = np.arange(len(a))
    while len(todo):
        now = size[todo] < 2 * width  # two overlapping stretches of ``width``
        i = todo[now]
        out[i] = np.minimum(step[a[i]], step[b[i] - width])
        todo = todo[~now]
        if len(todo):
            step = np.minimum(step[:-width], step[width:])
            width *= 2
    return out


def _induce_batches(memory: int, t: np.ndarray, is_s: np.ndarray, seeds: np.ndarray, near: np.ndarray, want_s: bool, most: int) -> tuple[np.ndarray, np.ndarray]:
    """As _induce, by batches."""
    queue = BatchQueue(memory)
    top = np.int64(1 << 40)
    since = np.full(int(t.max()) + 1, -1, np.int64)  # least shared since a symbol's last entry; -1: none yet
    out, shared_out = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]

    def took(suffix: np.ndarray, shared: np.ndarray) -> None:
        at = np.flatnonzero(suffix > 0)
        at = at[is_s[suffix[at] - 1] == want_s]
        c = t[suffix[at] - 1]
        order = np.argsort(c, kind="stable")
        at, c = at[order], c[order]
        new = np.append(True, c[1:] != c[:-1])[: len(c)]
        heads = np.flatnonzero(new)
        got = np.zeros(len(at), np.int64)
        if most:
            first, here = at[heads], c[heads]
            got[heads] = np.where(since[here] < 0, 0, np.minimum(since[here], np.minimum.accumulate(shared)[first]) + 1)
            rest = np.flatnonzero(~new)
            got[rest] = lowest(shared, at[rest - 1] + 1, at[rest] + 1) + 1
            np.minimum(got, most, out=got)
            np.minimum(since, shared.min(), out=since)
            after = np.append(np.minimum.accumulate(shared[::-1])[::-1], top)
            since[here] = after[at[np.append(heads[1:], len(at))[: len(heads)] - 1] + 1]
        child = suffix[at] - 1
        for a, b in zip(heads.tolist(), [*heads[1:].tolist(), len(at)], strict=False):
            queue.push(int(c[a]), child[a:b], got[a:b])

    def take(suffix: np.ndarray, shared: np.ndarray, keep: bool) -> None:
        for k in range(0, len(suffix), BATCH):
            took(suffix[k : k + BATCH], shared[k : k + BATCH])
        if keep:
            out.append(suffix)
            shared_out.append(shared)
        queue.spill()

    symbols = t[seeds]
    symbols = -symbols if want_s else symbols
    for symbol in range(len(since) - 1, -1, -1) if want_s else range(len(since)):
        previous = -1
        while (part := queue.pop(symbol)) is not None:
            suffix, shared = part
            if previous < 0:
                shared = shared.copy()
                shared[0] = 0  # nothing is shared over symbols
            take(suffix, shared, True)
            previous = int(suffix[-1])
        value = -symbol if want_s else symbol
        a, b = np.searchsorted(symbols, value), np.searchsorted(symbols, value, side="right")
        if a < b:
            shared = near[a:b].copy()
            shared[0] = 0 if previous < 0 else _common_one(t, previous, int(seeds[a]), most)
            take(seeds[a:b], shared, want_s)
    queue.close()
    return np.concatenate(out), np.concatenate(shared_out)


def _induce_names(memory: int, t: np.ndarray, is_s: np.ndarray, seeds: np.ndarray, near: np.ndarray, want_s: bool, most: int) -> tuple[np.ndarray, np.ndarray]:
    """As _induce, for sequences within ``memory`` whose shared symbols aren't asked for."""
    before = np.full(len(t), -1, np.int64)  # the symbol that a suffix induces, if any
    before[1:] = np.where(is_s[:-1] == want_s, t[:-1], -1)
    before = before.tolist()
    size = int(t.max()) + 1
    queues: list[list[int]] = [[] for _ in range(size)]
    cuts = np.searchsorted(t[seeds] if not want_s else -t[seeds], np.arange(size + 1) if not want_s else np.arange(1 - size, 2)).tolist()
    seeds = seeds.tolist()
    out = array("q")
    for k, symbol in enumerate(range(size - 1, -1, -1) if want_s else range(size)):
        queue = queues[symbol]
        for i in queue:  # grows meanwhile
            if (c := before[i]) >= 0:
                queues[c].append(i - 1)
        out.extend(queue)
        queues[symbol] = []
        own = seeds[cuts[k] : cuts[k + 1]]
        for i in own:
            if (c := before[i]) >= 0:
                queues[c].append(i - 1)
        if want_s:
            out.extend(own)
    return np.array(out, np.int64), np.zeros(len(out), np.int64)


def _induce(memory: int, text: list[int], is_s: list[bool], seeds: np.ndarray, near: np.ndarray, want_s: bool, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Merge what is induced with ``seeds``; of a symbol, induced suffixes come first.
    Returns the induced suffixes (want_s: all suffixes) in the order of the queue, with
    the symbols each shares with the one before it."""
    queue = Queue(memory, down=want_s)
    sign, seeds, near = queue.sign, seeds.tolist(), near.tolist()
    out, shared_out = array("q"), array("q")
    least, last = Shared(), {}
    previous, k, n = -1, 0, len(seeds)

    def took(i: int, shared: int) -> None:
        if most:
            least.add(shared)
        if i and is_s[i - 1] == want_s:
            c, got = text[i - 1], 0
            if most:
                if c in last:
                    got = min(most, 1 + least.since(last[c]))
                last[c] = least.n - 1
            queue.push(c, i - 1, got)

    while True:
        symbol = queue.first()
        if k < n and (symbol is None or sign * text[seeds[k]] < sign * symbol):
            symbol = text[seeds[k]]
        elif symbol is None:
            break
        previous = -1  # nothing is shared over symbols
        if queue.first() == symbol:
            for i, shared in queue.drain():
                out.append(i)
                shared_out.append(shared if previous >= 0 else 0)
                took(i, shared_out[-1])
                previous = i
        induced = previous >= 0
        while k < n and text[seeds[k]] == symbol:
            i = seeds[k]
            shared = 0 if previous < 0 else _common_one(text, previous, i, most) if induced else near[k]
            induced = False
            if want_s:
                out.append(i)
                shared_out.append(shared)
            took(i, shared)
            previous = i
            k += 1
    queue.close()
    return np.array(out, np.int64), np.array(shared_out, np.int64)


def _common_one(text: list[int] | np.ndarray, a: int, b: int, most: int) -> int:
    d = 0
    while d < most and max(a, b) + d < len(text) and text[a + d] == text[b + d]:
        d += 1
    return d


def names_in_memory(t: np.ndarray, star: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Names of substrings by refinement of equal ones, several symbols at a time."""
    bits = (int(t.max()) + 1).bit_length()
    per, pad = 63 // bits, (1 << bits) - 1  # the pad is above all symbols
    group, live, d = np.zeros(len(star), np.int64), np.arange(len(star)), 0
    while len(live):
        key = np.zeros(len(live), np.int64)
        for j in range(d, d + per):
            at = star[live] + j
            key = key << bits | np.where(at < ends[live], t[np.minimum(at, len(t) - 1)], pad)
        order = np.lexsort((key, group[live]))
        who, key, old = live[order], key[order], group[live][order]
        spot = np.arange(len(who))
        fresh = np.append(True, old[1:] != old[:-1])
        new = fresh | np.append(True, key[1:] != key[:-1])
        start = np.maximum.accumulate(np.where(new, spot, 0))
        group[who] = old + start - np.maximum.accumulate(np.where(fresh, spot, 0))
        alone = new & np.append(new[1:], True)
        d += per
        live = who[~alone & (star[who] + d <= ends[who])]
    return np.unique(group, return_inverse=True)[1]


def names_on_disk(t: np.ndarray, star: np.ndarray, ends: np.ndarray, memory: int) -> np.ndarray:
    raw = t.astype(">u4").tobytes()
    items = ((raw[4 * a : 4 * b] + b"\xff\xff\xff\xff", k) for k, (a, b) in enumerate(zip(star.tolist(), ends.tolist(), strict=True)))
    names = np.zeros(len(star), np.int64)
    name, before = -1, None
    for key, k in sorted_on_disk(items, memory):
        name += key != before
        before = key
        names[k] = name
    return names


def _star_order(t: np.ndarray, star: np.ndarray, memory: int) -> np.ndarray:
    """The order of the suffixes at S* places."""
    # A substring that another continues is the larger: its last symbol is of type S.
    ends = np.append(star[1:], len(t) - 1) + 1
    names = names_in_memory(t, star, ends) if len(star) <= memory else names_on_disk(t, star, ends, memory)
    if int(names.max()) + 1 == len(star):
        return np.argsort(names)
    return suffix_order(names, 0, memory)[0]
