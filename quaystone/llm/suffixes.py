"""External induced sorting of the suffixes of a shard, with common-prefix values.

A text of several strings, each closed by a 0 that counts as a symbol of its own, is split into
L- and S-type suffixes. The S-suffixes behind an L-suffix are the seeds. From seeds in any order that
respects their first symbol all L-suffixes, and from those all S-suffixes, are induced: a suffix that
leaves the queue puts the one before it into the queue, under the first symbol of that one. Induced
from seeds in text order, the seeds come out in the order of their substrings, which are named;
where names repeat, the string of names is sorted by the same method, and gives the order of the seeds
from which the second induction gets all suffixes.

The queues are priority queues by symbol, first in, first out within a symbol. They hold tuples of text
position and the length of the prefix shared with the tuple before, which is one more than the
smallest such value among the suffixes that left since. Symbols are grouped in ranges; a range's tuples
are kept in blocks, which go to a file when a queue exceeds its share of ``limit``, and are read again when
the order has come to their range. The text, its types, seeds, names and orders lie in files as well once
they take more than ``limit``. What stays in memory are the blocks of one range, and parts of PART symbols.

The values of seeds are compared in the text, up to the length that is asked for. A run of one symbol takes a
step for each of its places, so time, not memory, grows with the longest run.
"""

from __future__ import annotations

import tempfile
from collections import defaultdict
from collections.abc import Iterator

import numpy as np

#: Bytes of arrays, and of queues, that a shard keeps in memory.
LIMIT = 128 << 20
FAR = np.int32(1 << 28)
#: Symbols of a pass over the text that are handled at once.
PART = 1 << 20
#: Ranges of symbols, about, where there are more than twice as many symbols; else each symbol is a range.
RANGES = 128
#: Places of a range, if that makes fewer ranges.
RANGE_PLACES = 1 << 14


class Space:
    """Arrays of one shard: in memory up to ``limit`` bytes, beyond that in unnamed files of the task, which go with it."""

    def __init__(self, limit: int = LIMIT):
        self.limit, self.used = limit, 0
        #: What happened, for tests: bytes of arrays and of queue blocks in files, depth of the recursion.
        self.on_disk, self.spilled, self.depth = 0, 0, 0

    def array(self, n: int, dtype: type) -> np.ndarray:
        size = n * np.dtype(dtype).itemsize
        if not n or self.used + size <= self.limit:
            self.used += size
            return np.zeros(n, dtype)
        self.on_disk += size
        return np.memmap(tempfile.TemporaryFile(), dtype, "w+", shape=(n,))

    def free(self, *arrays: np.ndarray) -> None:
        self.used -= sum(a.nbytes for a in arrays if not isinstance(a, np.memmap))


class Queue:
    """First-in-first-out queues of blocks (positions and, if told, common prefixes) by range of symbols; large ones on disk."""

    def __init__(self, bounds: np.ndarray, top: int, space: Space, rows: int):
        self.bounds, self.space, self.rows = bounds, space, rows
        self.each = len(bounds) == top  # every symbol is a range
        self.limit, self.size, self.end = max(1, space.limit // 4), 0, 0
        self.memory: dict[int, list[np.ndarray]] = defaultdict(list)
        self.disk: dict[int, list[tuple[int, int]]] = defaultdict(list)
        self.file = None

    def push(self, symbols: np.ndarray, block: np.ndarray) -> None:
        """block: rows x n int64, in ascending order of ``symbols``."""
        if not len(symbols):
            return
        of = symbols if self.each else np.searchsorted(self.bounds, symbols, "right") - 1
        new = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
        for a, b in zip(new.tolist(), [*new[1:].tolist(), len(of)], strict=True):
            self.memory[int(of[a])].append(block[:, a:b])
        self.size += block.nbytes
        if self.size > self.limit:
            self._spill()

    def _spill(self) -> None:
        if self.file is None:
            self.file = tempfile.TemporaryFile()
        self.file.seek(self.end)
        for r in sorted(self.memory):
            held = self.memory.pop(r)
            block = np.ascontiguousarray(np.concatenate(held, axis=1) if len(held) > 1 else held[0])
            for a in range(0, block.shape[1], PART):
                part = np.ascontiguousarray(block[:, a : a + PART])
                self.file.write(part.tobytes())
                self.disk[r].append((self.end, part.shape[1]))
                self.end += part.nbytes
                self.space.spilled += part.nbytes
        self.size = 0

    def waiting(self, r: int) -> bool:
        return bool(self.memory.get(r) or self.disk.get(r))

    def pop(self, r: int, backwards: bool = False) -> Iterator[np.ndarray]:
        """The blocks of a range now in the queue, oldest first (newest first: backwards)."""
        stored, held = self.disk.pop(r, []), self.memory.pop(r, [])
        self.size -= sum(b.nbytes for b in held)
        if len(held) > 1:
            held = [np.concatenate(held, axis=1)]

        def read(at: int, n: int) -> np.ndarray:
            self.file.seek(at)
            return np.frombuffer(self.file.read(8 * self.rows * n), np.int64).reshape(self.rows, n)

        if backwards:
            yield from reversed(held)
            for x in reversed(stored):
                yield read(*x)
        else:
            for x in stored:
                yield read(*x)
            yield from held

    def whole(self, r: int, backwards: bool = False) -> np.ndarray:
        """All tuples of a range; backwards: the newest first."""
        got = list(self.pop(r, backwards))
        out = np.concatenate([b[:, ::-1] for b in got] if backwards else got, axis=1) if got else np.zeros((self.rows, 0), np.int64)
        return out


def ranges(t: np.ndarray, top: int) -> np.ndarray:
    """First symbols of the ranges; many symbols are grouped so that a range has about as many places as another."""
    if top <= 2 * RANGES + 1:
        return np.arange(top)
    some = np.sort(np.asarray(t[:: max(1, len(t) // (1 << 18))]))
    count = min(RANGES, max(1, len(t) // RANGE_PLACES))
    cuts, times = np.unique(some[:: max(1, len(some) // count)], return_counts=True)
    cuts = np.concatenate([[0], cuts, cuts[times > 1] + 1])  # a frequent symbol has a range of its own
    return np.unique(cuts[cuts < top])


def types(t: np.ndarray, space: Space) -> np.ndarray:
    """Which suffixes are smaller than the next (S-type); the last one counts as such."""
    out = space.array(len(t), bool)
    b = len(t) - 1
    out[b] = True
    while b > 0:
        a = max(0, b - PART)
        part = np.asarray(t[a : b + 1])
        change = np.flatnonzero(part[1:] != part[:-1])
        smaller = np.append(part[change] < part[change + 1], out[b])
        out[a : b + 1] = np.repeat(smaller, np.diff(np.append(change, b - a), prepend=-1))
        b = a
    return out


def seeds_of(smaller: np.ndarray, space: Space) -> np.ndarray:
    """Places of the S-suffixes behind an L-suffix, in text order."""

    def parts() -> Iterator[np.ndarray]:
        for a in range(1, len(smaller), PART):
            x = np.asarray(smaller[a - 1 : a + PART])
            yield np.flatnonzero(x[1:] & ~x[:-1]) + a

    out, at = space.array(sum(len(x) for x in parts()), np.int64), 0
    for x in parts():
        out[at : at + len(x)] = x
        at += len(x)
    return out


def _push(queue: Queue, t: np.ndarray, block: np.ndarray, wanted: np.ndarray, larger: bool, least: np.ndarray) -> None:
    """Puts the suffixes before those of a block (in order of leaving) into the queue, if they are of the type that is induced.

    least: for each symbol the smallest common prefix since its last tuple.
    """
    pos, common = block
    before = pos - 1
    at = np.flatnonzero((pos > 0) & (wanted[before] != larger))
    symbol = t[before[at]]
    if not larger:  # a 0 is a seed and no more
        at, symbol = at[symbol > 0], symbol[symbol > 0]
    if not len(at):
        np.minimum(least, common.min(), out=least)
        return
    order = np.argsort(symbol, kind="stable")
    at, symbol = at[order], symbol[order]
    new = np.flatnonzero(np.concatenate([[True], symbol[1:] != symbol[:-1]]))
    ends = np.append(new[1:], len(at))
    start = np.concatenate([[0], at[:-1] + 1])
    start[new] = 0
    padded = np.append(common, FAR)
    shared = np.minimum.reduceat(padded, np.stack([start, at + 1], 1).ravel())[::2]
    shared[new] = np.minimum(shared[new], least[symbol[new]])
    shared = np.minimum(shared + 1, FAR)
    np.minimum(least, common.min(), out=least)
    # since a symbol's last tuple only what left after it counts
    suffix_min = np.append(np.minimum.accumulate(common[::-1])[::-1], FAR)
    least[symbol[new]] = suffix_min[at[ends - 1] + 1]
    queue.push(symbol, np.stack([before[at], shared]))


def _put(queue: Queue, t: np.ndarray, pos: np.ndarray, wanted: np.ndarray, larger: bool, ends: tuple[int, int]) -> None:
    """``_push`` without values, for a whole range: what belongs to the range itself is there already."""
    before = pos[pos > 0] - 1
    before = before[wanted[before] != larger]
    symbol = np.asarray(t[before])
    away = ((symbol < ends[0]) | (symbol >= ends[1])) & (symbol > (-1 if larger else 0))
    symbol, before = symbol[away], before[away]
    order = np.argsort(symbol, kind="stable")
    before = before[order]
    queue.push(symbol[order], before[None])


def _changes(t: np.ndarray, space: Space) -> np.ndarray:
    """Where runs of one symbol begin."""

    def parts() -> Iterator[np.ndarray]:
        yield np.zeros(1, np.int64)
        for a in range(1, len(t), PART):
            x = np.asarray(t[a - 1 : a + PART])
            yield np.flatnonzero(x[1:] != x[:-1]) + a

    out, at = space.array(sum(len(x) for x in parts()), np.int64), 0
    for x in parts():
        out[at : at + len(x)] = x
        at += len(x)
    return out


def common_prefix(t: np.ndarray, zero: np.ndarray, a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
    """Length of the common prefix of suffixes of a text of bytes, up to their strings' ends (the zeros) and about ``most``."""
    ends = np.minimum(*(zero[np.searchsorted(zero, x)] - x for x in (a, b)))
    out = np.full(len(a), FAR, np.int64)
    words = np.ndarray((len(t) - 7,), "<u8", t, strides=(1,))  # t ends with spare zeros
    live = np.flatnonzero(ends > 0)
    for at in range(0, most, 8):
        if not len(live):
            break
        x = words[a[live] + at] ^ words[b[live] + at]
        found = np.flatnonzero(x)
        if len(found):
            low = x[found] & (~x[found] + np.uint64(1))
            out[live[found]] = at + (np.bitwise_count(low - np.uint64(1)).astype(np.int64) >> 3)
            live = live[x == 0]
        live = live[ends[live] > at + 8]
    return np.minimum(out, ends)


def _range(queue: Queue, r: int, ends: tuple[int, int], t: np.ndarray, rest: np.ndarray, wanted: np.ndarray, larger: bool) -> tuple[np.ndarray, np.ndarray]:
    """All tuples of a range of several symbols in their order, and which are not from ``rest``.

    rest: tuples that come, within a symbol, after those of the queue. Tuples put others into their own range;
    those stand, within a symbol, in the order of what put them there, behind what came from other ranges.
    """
    sign = 1 if larger else -1
    own = queue.whole(r)
    pos = [own[0], rest[0]]
    key = [2 * sign * np.asarray(t[own[0]]).astype(np.int64), 2 * sign * np.asarray(t[rest[0]]).astype(np.int64) + 1]
    parent, n, latest = [], own.shape[1] + rest.shape[1], np.concatenate(pos)
    first, begin = n, 0
    while len(latest):
        before = latest - 1
        put = np.flatnonzero((before >= 0) & (wanted[before] != larger))
        symbol = np.asarray(t[before[put]]).astype(np.int64)
        inside = (symbol >= max(ends[0], 0 if larger else 1)) & (symbol < ends[1])
        put, symbol = put[inside], symbol[inside]
        parent.append(put + begin)
        begin += len(latest)
        latest = before[put]
        pos.append(latest)
        key.append(2 * sign * symbol)
    pos, key = np.concatenate(pos), np.concatenate(key)
    key -= key.min() if len(key) else 0
    order = np.argsort(key, kind="stable")
    if len(pos) > first:
        parent, n = np.concatenate(parent), len(pos)
        key *= 2 * n
        place = np.arange(n) - first  # what came from outside keeps its order, before all others
        rank = np.empty(n, np.int64)
        rank[order] = np.arange(n)
        while True:
            place[first:] = rank[parent]
            order = np.argsort(key + place, kind="stable")
            now = np.empty(n, np.int64)
            now[order] = np.arange(n)
            if (now == rank).all():
                break
            rank = now
    of_rest = (order >= own.shape[1]) & (order < first)
    return pos[order], ~of_rest


def _runs(block: np.ndarray, t: np.ndarray, changes: np.ndarray) -> np.ndarray:
    """All tuples that those of one symbol put into their own queue: each with those left of it in its run of the symbol."""
    pos = block[0]
    more = np.flatnonzero((t[pos - 1] == t[pos]) & (pos > 0))
    if not len(more):
        return block
    left = np.zeros(len(pos), np.int64)
    left[more] = pos[more] - changes[np.searchsorted(changes, pos[more], "right") - 1]
    of = np.repeat(np.arange(len(pos)), left + 1)
    back = np.arange(len(of)) - np.repeat(np.cumsum(left + 1) - left - 1, left + 1)
    order = np.argsort(back, kind="stable")
    out = pos[of] - back
    return out[order][None]


def induced(t: np.ndarray, smaller: np.ndarray, seeds: np.ndarray, top: int, space: Space, shared: np.ndarray | None = None, border=None) -> Iterator[np.ndarray]:
    """Blocks (positions, common prefix with the one before) of all suffixes but the zeros, from the largest down.

    seeds: in the order that holds within a symbol. shared: common prefixes of neighbouring seeds, and
    border: of two positions; without them blocks are positions alone.
    """
    bounds = ranges(t, top) if shared is None else np.arange(top)
    single = np.append(np.diff(bounds), top - bounds[-1]) == 1
    rows = 1 if shared is None else 2
    queue, found, first = (Queue(bounds, top, space, rows) for _ in range(3))
    for a in range(0, len(seeds), PART):
        pos = np.asarray(seeds[a : a + PART])
        symbol = np.asarray(t[pos])
        order = np.argsort(symbol, kind="stable")
        first.push(symbol[order], np.stack([pos] if shared is None else [pos, np.asarray(shared[a : a + PART])])[:, order])
    edges = np.append(bounds, top).tolist()
    changes = _changes(t, space) if shared is None else None
    # L-suffixes, in ascending order
    least = None if shared is None else np.full(top, FAR, np.int64)
    for r in range(len(bounds)):
        ends = edges[r], edges[r + 1]
        if shared is None:
            if single[r]:
                own, rest = _runs(queue.whole(r), t, changes)[0], first.whole(r)[0]
                found.push(np.full(len(own), bounds[r]), own[None])
                pos = np.concatenate([own, rest])
            else:
                pos, own = _range(queue, r, ends, t, first.whole(r), smaller, True)
                found.push(np.asarray(t[pos[own]]), pos[own][None])
            _put(queue, t, pos, smaller, True, ends)
            continue
        last = -1
        while queue.waiting(r):
            for block in queue.pop(r):
                if last < 0:
                    block = block.copy()
                    block[1, 0] = 0
                last = int(block[0, -1])
                found.push(np.full(block.shape[1], bounds[r]), block)
                _push(queue, t, block, smaller, True, least)
        for k, block in enumerate(first.pop(r)):
            if border and not k:
                block = block.copy()
                block[1, 0] = border(last, int(block[0, 0]))
            _push(queue, t, block, smaller, True, least)
    # S-suffixes from the largest down, with the L-suffixes among them
    queue = Queue(bounds, top, space, rows)
    least = None if shared is None else np.full(top, FAR, np.int64)
    for r in range(len(bounds) - 1, -1, -1):
        ends = edges[r], edges[r + 1]
        if shared is None:
            rest = found.whole(r, backwards=True)
            pos = np.concatenate([_runs(queue.whole(r), t, changes)[0], rest[0]]) if single[r] else _range(queue, r, ends, t, rest, smaller, False)[0]
            yield pos[None]
            _put(queue, t, pos, smaller, False, ends)
            continue
        last = -1
        while queue.waiting(r):
            for block in queue.pop(r):
                if last < 0:
                    block = block.copy()
                    block[1, 0] = 0
                last = int(block[0, -1])
                yield block
                _push(queue, t, block, smaller, False, least)
        after = None  # what the suffix above shares with the next one below
        for block in found.pop(r, backwards=True):
            pos, common = block[0, ::-1], np.empty(block.shape[1], np.int64)
            common[1:] = block[1, :0:-1]
            common[0] = after if after is not None else border(last, int(pos[0])) if border else 0
            after, last = int(block[1, 0]), int(pos[-1])
            down = np.stack([pos, common])
            yield down
            _push(queue, t, down, smaller, False, least)
    if changes is not None:
        space.free(changes)


def same_substrings(t: np.ndarray, seeds: np.ndarray, number: np.ndarray) -> np.ndarray:
    """Whether the substrings of neighbours in ``number`` (numbers of seeds), from a seed to the next one, both included, are equal."""
    begin, end = (np.asarray(seeds[np.minimum(number + k, len(seeds) - 1)]) for k in (0, 1))
    a, b, length = begin[:-1], begin[1:], (end - begin)[:-1]
    same = length == (end - begin)[1:]
    live = np.flatnonzero(same)
    width, at = 4, 0
    while len(live):
        step = np.minimum(np.arange(at, at + width), length[live][:, None])
        differs = (t[a[live][:, None] + step] != t[b[live][:, None] + step]).any(1)
        same[live[differs]] = False
        live = live[~differs]
        at += width
        live = live[length[live] >= at]
        width = min(2 * width, max(4, PART // max(1, len(live))))
    return same


def seed_order(t: np.ndarray, smaller: np.ndarray, seeds: np.ndarray, top: int, space: Space, depth: int) -> np.ndarray:
    """The seeds in the order of their suffixes. Zeros come first, in text order."""
    n, zeros = len(seeds), 0
    out = space.array(n, np.int64)
    for a in range(0, n, PART):
        part = np.asarray(seeds[a : a + PART])
        part = part[np.asarray(t[part]) == 0]
        out[zeros : zeros + len(part)] = part
        zeros += len(part)
    # in the order of their substrings, from the largest down
    at = n
    for block in induced(t, smaller, seeds, top, space):
        pos = block[0]
        pos = pos[smaller[pos] & (pos > 0)]
        pos = pos[~smaller[pos - 1]]
        out[at - len(pos) : at] = pos[::-1]
        at -= len(pos)
    # names: a zero's is its place, equal substrings have one
    names, numbers, new, name, last = space.array(n, np.int64), space.array(n, np.int64), space.array(n + 1, bool), 0, None
    new[n] = True
    for a in range(0, n, PART):
        number = np.searchsorted(seeds, np.asarray(out[a : a + PART]))
        numbers[a : a + PART] = number
        with_last = number if last is None else np.append(last, number)
        first = np.append(np.ones(int(last is None), bool), ~same_substrings(t, seeds, with_last))
        first[: max(0, zeros - a)] = True
        new[a : a + len(first)] = first
        names[number] = name + np.cumsum(first)
        name, last = name + int(first.sum()), number[-1:]
    if name < n:
        _settle(out, names, numbers, new, seeds, name, space, depth)
    space.free(names, numbers, new)
    return out


def _settle(out: np.ndarray, names: np.ndarray, numbers: np.ndarray, new: np.ndarray, seeds: np.ndarray, name: int, space: Space, depth: int) -> None:
    """Puts seeds of equal names in the order of the suffixes of the string of names, in place.

    A name that stands once decides any comparison that reaches it, so of such names only the first behind
    a repeated one is kept in the string.
    """
    n = len(names)
    alone = space.array(n + 1, bool)
    for a in range(0, n, PART):
        x = np.asarray(new[a : a + PART + 1])
        alone[numbers[a : a + PART]] = x[:-1] & x[1:]

    def kept() -> Iterator[np.ndarray]:
        for a in range(0, n, PART):
            x = np.asarray(alone[max(0, a - 1) : min(n, a + PART)])
            before = x[:-1] if a else np.append(True, x[:-1])
            yield np.flatnonzero(~(x[1:] if a else x) | ~before) + a

    size = sum(len(x) for x in kept())
    string, number, at = space.array(size + 1, np.int64), space.array(size, np.int64), 0
    for x in kept():
        string[at : at + len(x)], number[at : at + len(x)] = names[x], x
        at += len(x)
    # places in the order that belong to repeated names, from the last one on
    slots = (np.flatnonzero(~(x[:-1] & x[1:]))[::-1] + a for a in range((n - 1) // PART * PART, -1, -PART) for x in (np.asarray(new[a : min(n, a + PART) + 1]),))
    free = np.zeros(0, np.int64)
    for block in suffixes(string, name + 1, space, depth=depth + 1):
        of = number[block[0]]
        of = of[~alone[of]]
        while len(free) < len(of):
            free = np.concatenate([free, next(slots)])
        out[free[: len(of)]] = seeds[of]
        free = free[len(of) :]
    space.free(alone, string, number)


def suffixes(t: np.ndarray, top: int, space: Space, most: int = 0, depth: int = 0) -> Iterator[np.ndarray]:
    """Blocks (positions, common prefix with the one before) of all suffixes but the zeros, from the largest down.

    t: symbols below ``top``; every 0 closes a string, the last symbol is one. most: common prefixes are told
    up to about so many symbols (0: not at all), for texts of bytes that end with spare zeros for ``most``.
    """
    space.depth = max(space.depth, depth)
    smaller = types(t, space)
    seeds = seeds_of(smaller, space)
    order = seed_order(t, smaller, seeds, top, space, depth)
    space.free(seeds)
    shared = border = None
    if most:
        zero = np.flatnonzero(t == 0)
        shared = space.array(len(order), np.int64)
        for a in range(1, len(order), PART):
            x = np.asarray(order[a - 1 : a + PART])
            shared[a : a + len(x) - 1] = common_prefix(t, zero, x[:-1], x[1:], most)

        def border(a: int, b: int) -> int:
            return int(common_prefix(t, zero, np.array([a]), np.array([b]), most)[0]) if a >= 0 else 0

    yield from induced(t, smaller, order, top, space, shared, border)
    space.free(smaller, order, *([shared] if most else []))


class Strings:
    """Strings of a shard, each closed by a 0: bytes in memory up to the limit, then in a file."""

    def __init__(self, space: Space):
        self.space, self.parts, self.held, self.size, self.file = space, [], 0, 0, None

    def add(self, body: bytes) -> None:
        self.parts += [body, b"\xff"]  # no byte of UTF-8; it becomes 0
        self.held += len(body) + 1
        self.size += len(body) + 1
        if self.held > self.space.limit // 4:
            self._write()

    def _write(self) -> None:
        self.file = self.file or tempfile.TemporaryFile()
        self.file.write(b"".join(self.parts))
        self.parts, self.held = [], 0

    def text(self, spare: int) -> np.ndarray:
        """All strings as symbols (a byte plus one), and spare zeros."""
        out, at = self.space.array(self.size + spare, np.uint8), 0
        if self.file:
            self._write()
            self.file.seek(0)
            while part := self.file.read(PART):
                out[at : at + len(part)] = np.frombuffer(part, np.uint8) + np.uint8(1)
                at += len(part)
        else:
            whole = b"".join(self.parts)
            out[: len(whole)] = np.frombuffer(whole, np.uint8) + np.uint8(1)
        return out


def repeated(strings: Strings, k: int) -> np.ndarray:
    """For the strings' bytes, each string followed by one more place: whether the next k bytes stand twice."""
    space, n = strings.space, strings.size
    out = space.array(n, bool)
    t = strings.text(k + 16)
    last = -1
    for pos, common in suffixes(t, 257, space, k):
        hit = common >= k
        out[pos[hit]] = True
        out[pos[:-1][hit[1:]]] = True
        if hit[0] and last >= 0:
            out[last] = True
        last = int(pos[-1])
    space.free(t)
    return out
