"""External suffix sorting by induction, with common-prefix lengths.

Suffixes are smaller (S) or larger (L) than the next one. The S suffixes behind an L one are sorted by recursion on
the string of their substrings' names; a left-to-right scan then induces the L suffixes from them, a right-to-left scan
all S suffixes from the L ones. A scan draws tuples
(position, common prefix with the one before), by first symbol and then rank of the inducing suffix, from a priority queue and
pushes those of the preceding positions. As each symbol's tuples are counted before, the queue puts a tuple where it will be
read, in arrays that are files beyond ``queue_bytes``. A batch takes all tuples that nothing still to be pushed can come before;
in a range of one symbol they need no sorting. Common prefixes are carried: a pushed tuple's is one more than the least in the
scan since the last push to its symbol. They are exact up to ``limit``. Strings of up to ``base`` symbols are sorted in memory by
doubling, which sorts at each step those that are still alike and may end at ``limit``.
"""

from __future__ import annotations

import os
import tempfile

import numpy as np

BASE = 4 << 20
QUEUE_BYTES = 64 << 20
RANGES = 512


class DiskQueue:
    """Places and common prefixes by symbol; within a symbol in the order pushed, which is that of the inducing ranks.

    ``counts``: how many each symbol will get. A tuple is put where it will be read; beyond ``queue_bytes`` these arrays are files.
    """

    def __init__(self, counts: np.ndarray, folder: str, queue_bytes: int):
        self.low = np.concatenate(([0], np.cumsum(counts)))
        self.free = self.low[:-1].copy()
        self.paths: list[str] = []
        n = int(self.low[-1])
        on_disk = 8 * n > queue_bytes
        self.at, self.lcp = (self._file(folder, k, n) if on_disk else np.empty(n, np.int32) for k in range(2))
        self.at[:] = -1

    def _file(self, folder: str, k: int, n: int) -> np.ndarray:
        self.paths.append(os.path.join(folder, f"queue-{id(self)}-{k}"))
        return np.memmap(self.paths[-1], np.int32, "w+", shape=(n,))

    def push(self, symbols: np.ndarray, sizes: np.ndarray, at: np.ndarray, lcp: np.ndarray) -> None:
        """Tuples of distinct symbols, ``sizes`` of each, one symbol after the other."""
        to = np.arange(at.size) + np.repeat(self.free[symbols] - (np.cumsum(sizes) - sizes), sizes)
        self.at[to], self.lcp[to] = at, lcp
        self.free[symbols] += sizes

    def pop(self, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
        """All tuples pushed so far of the symbols from ``low`` to before ``high``."""
        at, lcp = np.asarray(self.at[self.low[low] : self.low[high]]), np.asarray(self.lcp[self.low[low] : self.low[high]])
        if high == low + 1:
            n = int(self.free[low] - self.low[low])
            return at[:n], lcp[:n]
        there = at >= 0
        return at[there], lcp[there]

    def close(self) -> None:
        self.at = self.lcp = np.zeros(0, np.int32)
        for path in self.paths:
            os.remove(path)


def _range_min(values: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The least of values[low..high], ends included."""
    if not low.size:
        return np.zeros(0, values.dtype)
    span = high - low + 1
    level = np.frexp(span)[1] - 1
    out = np.empty(low.size, values.dtype)
    table, k = values, 0
    while True:
        of = np.flatnonzero(level == k)
        out[of] = np.minimum(table[low[of]], table[high[of] - (1 << k) + 1])
        if k >= level.max():
            return out
        table = np.minimum(table[: -(1 << k)], table[1 << k :])
        k += 1


def _induce(key: np.ndarray, symbols: int, targets: np.ndarray, run: np.ndarray, seeds: np.ndarray, seed_lcp: np.ndarray, limit: int, folder: str, queue_bytes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The scan's positions, common prefixes with the one before, and whether each was induced."""
    queue = DiskQueue(np.bincount(key[targets], minlength=symbols), folder, queue_bytes)
    ranges = min(symbols, RANGES)
    #: the symbol that each place pushes to, or none
    push_to = np.full(key.size, symbols, np.uint16 if symbols < 1 << 16 else np.int32)
    np.copyto(push_to[1:], key[:-1], where=targets[:-1], casting="unsafe")
    seed_key = key[seeds]
    last_batch, rest = np.full(symbols, -1, np.int32), np.zeros(symbols, np.int32)
    stack_at, stack_min = np.zeros(0, np.int64), np.zeros(0, np.int32)  # batches whose least is below all later ones'
    out_at, out_lcp, out_kind = [], [], []
    before = (-1, False, -1)
    batch_number, next_seed = 0, 0
    tops = -(-np.arange(1, ranges + 1) * symbols // ranges)  # first symbol beyond each range
    end_seeds = np.searchsorted(seed_key, tops).tolist()
    bottom = 0
    for top, end_seed in zip(tops.tolist(), end_seeds, strict=True):
        wait_at, wait_lcp = queue.pop(bottom, top)
        while wait_at.size or next_seed < end_seed:
            if top == bottom + 1:
                # one symbol: what was induced comes before the seeds, and these push to other symbols only
                kind = not wait_at.size
                at, lcp = (seeds[next_seed:end_seed], seed_lcp[next_seed:end_seed]) if kind else (wait_at, wait_lcp)
                next_seed = end_seed if kind else next_seed
                wait_at = wait_lcp = wait_at[:0]
                to = push_to[at]
                lcp = lcp.copy()
                if before[0] != bottom:
                    lcp[0] = 0
                elif kind and not before[1]:
                    lcp[0] = min(run[before[2]], run[at[0]])
                before = (bottom, kind, int(at[-1]))
                out_kind.append(np.full(at.size, not kind))
            else:
                s = slice(next_seed, end_seed)
                at = np.concatenate((wait_at, seeds[s]))
                lcp = np.concatenate((wait_lcp, seed_lcp[s]))
                symbol = key[at]
                kind = np.zeros(at.size, bool)
                kind[wait_at.size :] = True
                order = np.argsort(symbol.astype(np.int64) * 2 + kind, kind="stable")
                symbol, at, lcp, kind = symbol[order], at[order], lcp[order], kind[order]
                to = push_to[at]
                least = np.full(at.size, symbols, np.int64)
                np.minimum.accumulate(to[:-1], out=least[1:])
                safe = (least > symbol) | ((least == symbol) & ~kind)
                n = at.size if safe.all() else int(np.argmin(safe))
                taken = int((~kind[:n]).sum())
                next_seed += n - taken
                symbol, at, lcp, kind, to = symbol[:n], at[:n], lcp[:n], kind[:n], to[:n]
                wait_at, wait_lcp = wait_at[taken:], wait_lcp[taken:]
                prev_symbol = np.concatenate(([before[0]], symbol[:-1]))
                prev_kind = np.concatenate(([before[1]], kind[:-1]))
                prev_at = np.concatenate(([before[2]], at[:-1]))
                turn = kind & ~prev_kind & (prev_symbol == symbol)
                lcp = np.where(turn, np.minimum(run[prev_at], run[at]), lcp)
                lcp[prev_symbol != symbol] = 0
                before = (int(symbol[-1]), bool(kind[-1]), int(at[-1]))
                out_kind.append(~kind)
            out_at.append(at)
            out_lcp.append(lcp)
            src = np.flatnonzero(to < symbols)
            if src.size:
                dest = to[src]
                by_dest = np.argsort(dest, kind="stable")
                src, dest = src[by_dest], dest[by_dest]
                first = np.ones(src.size, bool)
                first[1:] = dest[1:] != dest[:-1]
                f = np.flatnonzero(first)
                sizes = np.diff(np.append(f, src.size))
                final = f + sizes - 1
                groups = dest[f].astype(np.int64)
                carried = np.empty(src.size, np.int32)
                inner = np.flatnonzero(~first)
                carried[inner] = _range_min(lcp, src[inner - 1] + 1, src[inner])
                since, value = last_batch[groups], np.minimum(np.minimum.accumulate(lcp)[src[f]], rest[groups])
                place = np.searchsorted(stack_at, since + 1)
                has = place < stack_at.size
                value[has] = np.minimum(value[has], stack_min[place[has]])
                carried[f] = np.where(since >= 0, value, -1)
                after = np.append(np.minimum.accumulate(lcp[::-1])[::-1][1:], limit)
                last_batch[groups] = batch_number
                rest[groups] = after[src[final]]
                pushed_at, pushed_lcp = at[src] - 1, np.minimum(carried + 1, limit)
                here = int(np.searchsorted(groups, top))
                k = int(sizes[:here].sum())
                if k:
                    wait_at, wait_lcp = np.concatenate((wait_at, pushed_at[:k])), np.concatenate((wait_lcp, pushed_lcp[:k]))
                    if top > bottom + 1:
                        order = np.argsort(key[wait_at], kind="stable")
                        wait_at, wait_lcp = wait_at[order], wait_lcp[order]
                if here < groups.size:
                    queue.push(groups[here:], sizes[here:], pushed_at[k:], pushed_lcp[k:])
            low = lcp.min()
            keep = stack_min < low
            stack_at, stack_min = np.append(stack_at[keep], batch_number), np.append(stack_min[keep], low).astype(np.int32)
            batch_number += 1
        bottom = top
    queue.close()
    empty = np.zeros(0, np.int32)
    return (np.concatenate(out_at) if out_at else empty, np.concatenate(out_lcp) if out_lcp else empty, np.concatenate(out_kind) if out_kind else empty.astype(bool))


def _ranks(values: np.ndarray) -> np.ndarray:
    """The place of each value among the distinct ones."""
    order = np.argsort(values)
    new = np.zeros(values.size, np.int64)
    new[1:] = values[order[1:]] != values[order[:-1]]
    out = np.empty(values.size, np.int64)
    out[order] = np.cumsum(new)
    return out


def _in_memory(text: np.ndarray, limit: int, whole: bool) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes by doubling, with common prefixes from the ranks of each step; a step sorts those that share their rank only."""
    n = text.size
    order = np.argsort(text)
    slots, sorted_key = np.arange(n), text[order]
    rank = np.zeros(n + 1, np.int32)  # the first slot of the suffixes that agree so far; nothing is behind the end
    rank[n] = -1
    ranks, step = [], 1
    while True:
        new = np.ones(slots.size, bool)
        new[1:] = sorted_key[1:] != sorted_key[:-1]
        rank[order[slots]] = slots[np.maximum.accumulate(np.where(new, np.arange(slots.size), 0))]
        ranks.append(rank)
        slots = slots[~(new & np.append(new[1:], True))]
        if not slots.size or not whole and step >= limit:
            break
        at = order[slots]
        key = rank[at].astype(np.int64) * (n + 2) + rank[np.minimum(at + step, n)] + 1
        by_key = np.argsort(key)
        order[slots], sorted_key = at[by_key], key[by_key]
        rank = rank.copy()
        step *= 2
    lcp = np.zeros(n, np.int32)
    if n > 1:
        a, b = order[:-1].copy(), order[1:].copy()
        got = lcp[1:]
        for k in range(len(ranks) - 1, -1, -1):
            # two different suffixes of equal rank have all its symbols, so at most one of them comes to the end
            more = (ranks[k][a] == ranks[k][b]).astype(np.int32) << k
            got += more
            a += more
            b += more
        np.minimum(got, limit, out=got)
    return order.astype(np.int32), lcp


def _name(text: np.ndarray, small: np.ndarray, stars: np.ndarray) -> np.ndarray:
    """Ranks of the substrings from each star to the next, by (symbol, type), equal ones alike."""
    n = stars.size
    length = np.append(np.diff(stars) + 1, 1)
    bits = max(1, int(2 * int(text.max()) + 2).bit_length())
    per = max(1, 63 // bits)
    typed = np.zeros(text.size + per, np.int32)
    typed[: text.size] = 2 * text + small + 1
    name, active, done = np.zeros(n, np.int64), np.arange(n), 0
    while active.size:
        word = np.zeros(active.size, np.int64)
        at, left = stars[active] + done, length[active] - done
        for k in range(per):
            word <<= bits
            word |= np.where(left > k, typed[at + k], 0)
        done += per
        order = np.lexsort((word, name[active])) if done > per else np.argsort(word)
        a, w = active[order], word[order]
        old = name[a]
        new = np.ones(a.size, bool)
        new[1:] = (old[1:] != old[:-1]) | (w[1:] != w[:-1])
        # a group's names spread over the places that the group takes
        group_first = np.ones(a.size, bool)
        group_first[1:] = old[1:] != old[:-1]
        start = np.maximum.accumulate(np.where(group_first, np.arange(a.size), 0))
        name[a] = old + np.maximum.accumulate(np.where(new, np.arange(a.size), 0)) - start
        members = np.diff(np.append(np.flatnonzero(new), a.size))
        active = np.sort(a[np.repeat(members > 1, members) & (length[a] > done)])
    return _ranks(name)


def _common(text: np.ndarray, a: np.ndarray, b: np.ndarray, have: np.ndarray, limit: int) -> np.ndarray:
    """Common prefixes of pairs of suffixes that agree on ``have`` symbols already."""
    got = np.minimum(have, limit).astype(np.int64)
    live = np.flatnonzero(got < limit)
    while live.size:
        i, j = a[live] + got[live], b[live] + got[live]
        same = (i < text.size) & (j < text.size)
        same[same] = text[i[same]] == text[j[same]]
        got[live[same]] += 1
        live = live[same]
        live = live[got[live] < limit]
    return got.astype(np.int32)


def suffix_array(text: np.ndarray, limit: int, base: int | None = None, queue_bytes: int | None = None, folder: str | None = None, whole: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Suffix positions in order, and each one's common prefix with the one before, up to ``limit``.

    ``text``: non-negative integers; an end smaller than all of them is implied. Unless ``whole``, suffixes that agree in ``limit`` symbols come in any order.
    """
    base, queue_bytes = BASE if base is None else base, QUEUE_BYTES if queue_bytes is None else queue_bytes
    if folder is None:
        with tempfile.TemporaryDirectory() as own:
            return _sorted(text, limit, base, queue_bytes, own, whole, top=True)
    return _sorted(text, limit, base, queue_bytes, folder, whole, top=True)


def _sorted(text: np.ndarray, limit: int, base: int, queue_bytes: int, folder: str, whole: bool, top: bool = False) -> tuple[np.ndarray, np.ndarray]:
    if text.size < 3 or not top and text.size <= base:
        return _in_memory(text, limit, whole)
    text = np.append(text.astype(np.int32) + 1, np.int32(0))
    n = text.size
    step = np.sign(np.diff(text)).astype(np.int8)
    # an equal symbol has the type of the next position that differs
    place = np.arange(n, dtype=np.int32)
    nxt = np.minimum.accumulate(np.where(np.append(step != 0, True), place, np.int32(n))[::-1])[::-1]
    small = np.append(step, 1)[nxt] > 0
    run = nxt - place + 1
    np.minimum(run, limit, out=run)
    del step, place, nxt
    stars = np.flatnonzero(small[1:] & ~small[:-1]) + 1
    names = _name(text, small, stars)
    if names.max() + 1 == stars.size:
        order = np.empty(stars.size, np.int64)
        order[names] = np.arange(stars.size)
        agree = np.zeros(stars.size, np.int64)
    else:
        order, agree = _sorted(names, limit, base, queue_bytes, folder, whole)
    sorted_stars = stars[order].astype(np.int32)
    prior = np.concatenate((order[:1], order[:-1]))
    shared = np.minimum(agree.astype(np.int64), stars.size - 1 - np.maximum(order, prior))
    star_lcp = _common(text, stars[prior], stars[order], stars[order + shared] - stars[order], limit)
    star_lcp[:1] = 0
    symbols = int(text.max()) + 1
    at, lcp, induced = _induce(text, symbols, ~small, run, sorted_stars, star_lcp, limit, folder, queue_bytes)
    large, large_lcp = at[induced][::-1], np.zeros(int(induced.sum()), np.int32)
    large_lcp[1:] = lcp[induced][::-1][:-1]
    at, lcp, _ = _induce((symbols - 1 - text).astype(np.int32), symbols, small, run, np.ascontiguousarray(large), large_lcp, limit, folder, queue_bytes)
    out = np.zeros(at.size, np.int32)
    out[1:] = lcp[::-1][:-1]
    return np.ascontiguousarray(at[::-1]), out
