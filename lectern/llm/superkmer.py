"""Substring dedup by super-k-mers: words covered by a window of 35 words that occurs anywhere else go.

A window's minimiser is the least hash of its 8-word runs. Consecutive windows that share one form a
super-k-mer, which is known by its minimiser and the hash of its words. First the buckets tell, for each
super-k-mer, whether it occurs elsewhere as a whole, and whether its minimiser has others. Each
distinct super-k-mer of such a minimiser then travels once, as one packed string, to its minimiser's bucket, where
sorting the windows counts them. A minimiser with more than ``HOT`` distinct super-k-mers (the edges
of a passage that very many documents share) has its windows dealt by their own hashes instead, so no
bucket gets more than a bounded share of it.

Windows never cross documents and are judged on the input. Each row is a document of its own, also
where ids repeat. Null and empty texts have no words; texts of fewer than 35 words lose none.
Window identity is a pair of independent 64-bit hashes over word hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.blocks import Block, ask, block_table, bucket_count, cut_by_bucket, join_bodies, opened, pack, split_bodies, squeeze, unpack, unsqueeze
from lectern.llm.common import U64, Scratch, Words, mix, powers, rolling, sliding_min

WIDTH, K = 35, 8
HOT = 2_048
_BITS = 48
_Q = U64(0xA0761D6478BD642F)
_Q_INVERSE = U64(pow(0xA0761D6478BD642F, -1, 1 << 64))


def spans_hash(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of values, independent of ``rolling``."""
    n = values.size
    sums = np.empty(n + 1, U64)
    sums[0] = 0
    np.cumsum(mix(values) * powers(_Q, n), out=sums[1:])
    return mix((sums[ends] - sums[starts]) * powers(_Q_INVERSE, n + 1)[starts] + (ends - starts).astype(U64))


def group_starts(*keys: np.ndarray) -> np.ndarray:
    """Where a new group begins in arrays sorted together."""
    new = np.zeros(keys[0].size, bool)
    if new.size:
        new[0] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return new


class Runs:
    """Super-k-mers of a list of texts."""

    def __init__(self, texts: list[bytes], width: int = WIDTH, k: int = K):
        self.words = w = Words(texts)
        self.width = width
        h = self.hashes = w.hashes()
        counts = np.diff(w.first)
        n_windows = np.maximum(counts - width + 1, 0)
        total = int(n_windows.sum())
        ends = np.cumsum(n_windows)
        self.at = np.arange(total) + np.repeat(w.first[:-1] - (ends - n_windows), n_windows)
        if not total:
            self.m = self.run_hash = np.zeros(0, U64)
            self.start = self.n = self.low = np.zeros(0, np.int64)
            self.selfed = np.zeros(0, bool)
            self.order, self.unique = np.zeros(0, np.int64), np.zeros(0, np.int64)
            return
        m = sliding_min(rolling(h, k), width - k + 1)[self.at]
        new = np.ones(total, bool)
        new[1:] = (m[1:] != m[:-1]) | (self.at[1:] != self.at[:-1] + 1)
        self.low = np.flatnonzero(new)  # index of each run's first window
        self.n = np.diff(np.append(self.low, total))
        self.start = self.at[self.low]
        self.m = mix(m[self.low]) >> U64(64 - _BITS)  # minima lie near zero; buckets are ranges
        self.run_hash = spans_hash(h, self.start, self.start + self.n + width - 1)
        inside = mix(self.window_hashes()[0] ^ mix(np.repeat(np.arange(self.low.size, dtype=U64), self.n)))
        self.selfed = np.zeros(self.low.size, bool)
        check = np.sort(inside)
        if (check[1:] == check[:-1]).any():
            order = np.argsort(inside, kind="stable")
            twice = np.flatnonzero(inside[order][1:] == inside[order][:-1])
            self.selfed[np.searchsorted(self.low, order[twice], "right") - 1] = True
        #: runs by (minimiser, hash), and for each run the number of its distinct (minimiser, hash)
        self.order = np.lexsort((self.run_hash, self.m))
        first = group_starts(self.m[self.order], self.run_hash[self.order])
        self.unique = np.empty(self.low.size, np.int64)
        self.unique[self.order] = np.cumsum(first) - 1
        self.lead = self.order[first]
        self.times = np.diff(np.append(np.flatnonzero(first), self.low.size))

    def window_hashes(self) -> tuple[np.ndarray, np.ndarray]:
        if not self.at.size:
            return np.zeros(0, U64), np.zeros(0, U64)
        return rolling(self.hashes, self.width)[self.at], spans_hash(self.hashes, self.at, self.at + self.width)

    def text(self, run: int) -> bytes:
        s = self.start[run]
        return self.words.buf[self.words.starts[s] : self.words.ends[s + self.n[run] + self.width - 2]].tobytes()


def _codes(block: Block, runs: Runs, buckets: int) -> np.ndarray:
    """The first answers, for each distinct run."""
    codes = np.zeros(runs.times.size if runs.at.size else 0, np.uint8)
    if codes.size:
        for bucket, a, b in cut_by_bucket(runs.m[runs.lead], _BITS, buckets):
            codes[a:b] = unpack(block.answers["runs"][bucket], np.uint8)
    return codes


_ALL, _SHIP, _HOT = 1, 2, 4


def _ask_runs(buckets: int):
    def request(block: Block):
        runs = Runs(block.texts)
        if not runs.at.size:
            return
        m, h = runs.m[runs.lead], runs.run_hash[runs.lead]
        times = np.minimum(runs.times, 2).astype(np.uint8) | (runs.selfed[runs.lead].astype(np.uint8) << 2)
        for bucket, a, b in cut_by_bucket(m, _BITS, buckets):
            yield bucket, join_bodies(pack(m[a:b], True), pack(h[a:b]), pack(times[a:b]))

    return request


def _answer_runs(rows: list[tuple[int, bytes]]) -> list[bytes]:
    bodies = [split_bodies(body) for _, body in rows]
    m = np.concatenate([unpack(b[0], U64, True) for b in bodies])
    h = np.concatenate([unpack(b[1], U64) for b in bodies])
    t = np.concatenate([unpack(b[2], np.uint8) for b in bodies])
    order = np.lexsort((h, m))  # stable: the lowest block comes first
    m, h, t = m[order], h[order], t[order]
    new_m, new = group_starts(m), group_starts(m, h)
    at = np.flatnonzero(new)
    group = np.cumsum(new) - 1
    total = np.add.reduceat((t & 3).astype(np.int64), at)[group]
    distinct = np.add.reduceat(new.astype(np.int64), np.flatnonzero(new_m))[np.cumsum(new_m) - 1]
    ship = new & ((distinct > 1) | ((t & 4) > 0))
    codes = np.empty(m.size, np.uint8)
    codes[order] = (total > 1) * _ALL + ship * _SHIP + (ship & (distinct > HOT)) * _HOT
    cuts = np.cumsum([unpack(b[2], np.uint8).size for b in bodies])[:-1]
    return [pack(c) for c in np.split(codes, cuts)]


def _windows_of(runs: Runs, chosen: np.ndarray) -> np.ndarray:
    """Indices of the windows of chosen runs."""
    n = runs.n[chosen]
    ends = np.cumsum(n)
    return np.arange(int(n.sum())) + np.repeat(runs.low[chosen] - (ends - n), n)


def _plan(block: Block, runs: Runs, buckets: int) -> tuple[np.ndarray, dict[int, np.ndarray], np.ndarray, dict[int, np.ndarray]]:
    """What a block sends in the second question: runs as strings and windows as hashes, by bucket; also its codes."""
    codes = _codes(block, runs, buckets)
    ship = (codes & _SHIP) > 0
    cold, hot = np.flatnonzero(ship & ((codes & _HOT) == 0)), np.flatnonzero((codes & _HOT) > 0)
    strings = {bucket: cold[a:b] for bucket, a, b in cut_by_bucket(runs.m[runs.lead[cold]], _BITS, buckets)} if cold.size else {}
    hashed: dict[int, np.ndarray] = {}
    if hot.size:
        win = _windows_of(runs, runs.lead[hot])
        key = runs.window_hashes()[0][win]
        order = np.argsort(key, kind="stable")
        hashed = {bucket: win[order[a:b]] for bucket, a, b in cut_by_bucket(key[order], 64, buckets)}
    return codes, strings, hot, hashed


def _ask_windows(buckets: int):
    def request(block: Block):
        runs = Runs(block.texts)
        if not runs.at.size:
            return
        codes, strings, hot, hashed = _plan(block, runs, buckets)
        whole = np.zeros(runs.at.size, np.uint8)
        if hashed:
            whole[_windows_of(runs, runs.lead[hot[(codes[hot] & _ALL) > 0]])] = 1
            a, b = runs.window_hashes()
        for bucket in sorted({*strings, *hashed}):
            cold = strings.get(bucket, np.zeros(0, np.int64))
            texts = [runs.text(r) for r in runs.lead[cold]]
            win = hashed.get(bucket, np.zeros(0, np.int64))
            hashes = (pack(a[win]), pack(b[win]), pack(whole[win])) if win.size else (pack(np.zeros(0, U64)), pack(np.zeros(0, U64)), pack(np.zeros(0, np.uint8)))
            yield bucket, join_bodies(squeeze(b"\n".join(texts), 3), pack(np.fromiter(map(len, texts), np.int32, len(texts))), pack(codes[cold] & _ALL), *hashes)

    return request


def _answer_windows(rows: list[tuple[int, bytes]]) -> list[bytes]:
    first, second, whole, sizes = [], [], [], []
    for _, body in rows:
        text, lengths, alls, a, b, w = split_bodies(body)
        lengths, raw = unpack(lengths, np.int32), unsqueeze(text)
        ends = np.cumsum(lengths.astype(np.int64) + 1) - 1
        runs = Runs([raw[e - n : e] for e, n in zip(ends.tolist(), lengths.tolist(), strict=True)])
        counts = np.maximum(np.diff(runs.words.first) - WIDTH + 1, 0)
        x, y = runs.window_hashes()
        first += [x, unpack(a, U64)]
        second += [y, unpack(b, U64)]
        whole += [np.repeat(unpack(alls, np.uint8), counts), unpack(w, np.uint8)]
        sizes.append(x.size + first[-1].size)
    a, b, w = np.concatenate(first), np.concatenate(second), np.concatenate(whole)
    order = np.lexsort((b, a))
    new = group_starts(a[order], b[order])
    group = np.cumsum(new) - 1
    total = np.add.reduceat(1 + w[order].astype(np.int64), np.flatnonzero(new)) if new.size else np.zeros(0, np.int64)
    twice = np.empty(a.size, bool)
    twice[order] = total[group] > 1
    return [squeeze(np.packbits(t).tobytes()) for t in np.split(twice, np.cumsum(sizes)[:-1])]


def _covered(block: Block, runs: Runs, buckets: int) -> np.ndarray:
    """For each word of a block, whether a repeated window covers it."""
    n = runs.words.starts.size
    if not runs.at.size:
        return np.zeros(n, bool)
    codes, strings, hot, hashed = _plan(block, runs, buckets)
    gone = np.repeat((codes[runs.unique] & _ALL) > 0, runs.n)
    for bucket in {*strings, *hashed}:
        win = np.concatenate([_windows_of(runs, runs.lead[strings[bucket]]) if bucket in strings else np.zeros(0, np.int64), hashed.get(bucket, np.zeros(0, np.int64))])
        bits = np.unpackbits(np.frombuffer(unsqueeze(block.answers["windows"][bucket]), np.uint8), count=win.size).astype(bool)
        gone[win[bits]] = True
    edges = np.zeros(n + 1, np.int32)
    starts = runs.at[gone]
    np.add.at(edges, starts, 1)
    np.add.at(edges, starts + WIDTH, -1)
    return np.cumsum(edges[:-1]) > 0


def remove_repeats(df: DataFrame, scratch: Scratch) -> DataFrame:
    """(doc_id, kept, n_words, n_removed) per row: ``kept`` holds the words left, joined by a space."""
    blocks = block_table(df, scratch)
    buckets = bucket_count(blocks)
    told = ask(blocks, "runs", _ask_runs(buckets), _answer_runs, scratch)
    counted = ask(told, "windows", _ask_windows(buckets), _answer_windows, scratch)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in opened(batches):
            runs = Runs(block.texts)
            gone = _covered(block, runs, buckets)
            first, kept, removed = runs.words.first.tolist(), [], []
            for i, text in enumerate(block.texts):
                mask = gone[first[i] : first[i + 1]]
                words = text.split()
                removed.append(int(mask.sum()))
                kept.append(b" ".join(words if not removed[-1] else [w for w, g in zip(words, mask.tolist(), strict=True) if not g]).decode())
            n = np.diff(runs.words.first)
            yield pa.RecordBatch.from_arrays([pa.array(block.ids, pa.int64()), pa.array(kept, pa.string()), pa.array(n, pa.int64()), pa.array(removed, pa.int64())], names=["doc_id", "kept", "n_words", "n_removed"])

    return counted.mapInArrow(finish, "doc_id bigint, kept string, n_words bigint, n_removed bigint")


def digests(df: DataFrame, scratch: Scratch) -> DataFrame:
    return remove_repeats(df, scratch).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
