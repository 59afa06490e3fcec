"""Suffix-array dedup: bytes covered by a 50-byte string that also starts in a document of a smaller id go.

Texts are cut into shards that keep equal strings together: a 50-byte window's minimiser is the least hash of its
24-byte parts, consecutive windows that share one form a run, and a run goes to its minimiser's shard. The shards first tell
the smallest document of each whole run, and whether its minimiser has other runs. Each distinct run of
such a minimiser then travels once, from its smallest document, and the shard's strings are sorted by external
induced sorting with common-prefix lengths (``induced``): neighbours that share 50 bytes are equal windows. A
minimiser with more than ``HOT`` distinct runs has its windows dealt by their own hashes instead.

Windows never cross documents and are judged on the input. Null texts are empty. Rows of one id are one rank: none is
smaller than the other. Rows with a null id lose nothing and take nothing from others. Whole runs are known by 48 and 64 bits
of hashes, windows dealt by hash by 128.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lectern.llm import induced
from lectern.llm.blocks import Block, ask, block_table, bucket_count, cut_by_bucket, join_bodies, opened, pack, split_bodies, squeeze, unpack, unsqueeze
from lectern.llm.common import U64, Scratch, mix, powers, sliding_min
from lectern.llm.superkmer import group_starts

#: A window and the parts whose least hash is its minimiser: few parts of 24 bytes are in different runs by chance.
WIDTH, K = 50, 24
HOT = 2_048
#: Bytes of a block; a block's hashes take about twenty times as much; a shard gets the strings of about three blocks, of which few are sent, and takes about eighty times what it gets.
BLOCK = 2 << 20
_BITS = 48
_Q = U64(0xA0761D6478BD642F)
_C1, _C2, _C3 = U64(0x9E3779B97F4A7C15), U64(0xC2B2AE3D27D4EB4F), U64(0x165667B19E3779F9)
_SHIP, _HOT = 1, 2


def _loads(buf: np.ndarray) -> np.ndarray:
    """The eight bytes from each place, as an integer; ``buf`` has eight spare bytes at its end."""
    return np.ndarray((buf.size - 7,), "<u8", buf, strides=(1,))


def in_order(m: np.ndarray, h: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """The order by minimiser, hash and document; only the few that share a minimiser are sorted by all three."""
    order = np.argsort(m)
    again = m[order[1:]] == m[order[:-1]]
    tied = np.zeros(m.size, bool)
    tied[1:] |= again
    tied[:-1] |= again
    t = np.sort(order[tied])
    order[tied] = t[np.lexsort((doc[t], h[t], m[t]))]
    return order


#: Places that one step of the hashing works on, so that what it makes stays in the processor's cache.
_STEP = 1 << 15


class Runs:
    """Runs of 50-byte windows with one minimiser; a window is known by the place of its first byte."""

    def __init__(self, texts: list[bytes], ids: list[int | None]):
        self.raw = b"".join([*texts, bytes(2 * K)])
        self.buf = np.frombuffer(self.raw, np.uint8)
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        self.offsets = np.concatenate(([0], np.cumsum(sizes)))
        known = np.fromiter((i is not None for i in ids), bool, len(ids))
        ids = np.fromiter((i or 0 for i in ids), np.int64, len(ids))
        beyond = self.offsets[:-1] + np.maximum(sizes - WIDTH + 1, 0) * known  # each text's last window ends before it
        filled = np.flatnonzero(beyond > self.offsets[:-1])
        if not filled.size:
            self.start = self.n = self.doc = self.lead = self.unique = self.least = np.zeros(0, np.int64)
            self.m = self.hash = np.zeros(0, U64)
            return
        change = np.zeros(self.buf.size, np.int8)
        first = np.zeros(self.buf.size, bool)
        first[self.offsets[filled]] = True
        change[self.offsets[filled]] = 1
        change[beyond[filled]] -= 1
        held = np.cumsum(change, dtype=np.int8).view(bool)
        self.start, m = self._minima(first, held, int(beyond.max()))
        of = np.searchsorted(self.offsets[1:], self.start, "right")
        self.n = np.minimum(np.append(self.start[1:], self.buf.size), beyond[of]) - self.start
        self.m = mix(m) >> U64(64 - _BITS)  # minima lie near zero; buckets are ranges
        self.doc = ids[of]
        self.hash = self._hashes()
        order = in_order(self.m, self.hash, self.doc)
        first = group_starts(self.m[order], self.hash[order])
        self.unique = np.empty(order.size, np.int64)
        self.unique[order] = np.cumsum(first) - 1
        #: of each distinct run, its occurrence in the smallest document
        self.lead = order[first]
        self.least = self.doc[self.lead]

    def _minima(self, first: np.ndarray, held: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
        """Where the runs start and their least hash; ``parts`` becomes the hash of the 24 bytes at each place."""
        loads, more = _loads(self.buf), WIDTH - K
        self.parts = np.empty(end + more, U64)
        starts, minima, before = [], [], np.zeros(1, U64)
        for a in range(0, end, _STEP):
            b = min(a + _STEP, end)
            words = np.ascontiguousarray(loads[a : b + more + 16])
            h = self.parts[a : b + more]
            np.multiply(words[:-16], _C1, out=h)
            h ^= h >> U64(29)
            h += words[8:-8] * _C2
            h *= _C3
            h ^= h >> U64(32)
            h += words[16:] * _C1
            h *= _C2
            h ^= h >> U64(31)
            m = np.concatenate((before, sliding_min(h, more + 1)))
            at = np.flatnonzero((first[a:b] | (m[1:] != m[:-1])) & held[a:b])
            starts.append(at + a)
            minima.append(m[at + 1])
            before = m[-1:]
        return np.concatenate(starts), np.concatenate(minima)

    def _hashes(self) -> np.ndarray:
        """Of each run, from the hashes of parts that together are all its bytes."""
        size, last = self.n + WIDTH - 1, self.n + WIDTH - 1 - K
        out = size.astype(U64)
        for k in range(0, 4 * K, K):
            out = mix(out * _C1 + self.parts[self.start + np.minimum(k, last)])
        long = np.flatnonzero(size > 4 * K)
        if long.size:
            n = last[long] + 1
            low = np.cumsum(n) - n
            of = np.arange(int(n.sum())) - np.repeat(low, n)
            sums = np.add.reduceat(self.parts[np.repeat(self.start[long], n) + of] * powers(_Q, int(n.max()))[of], low)
            out[long] = mix(out[long] * _C1 + mix(sums))
        return out

    def window_hashes(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        words = _loads(self.buf)
        one = other = np.zeros(windows.size, U64)
        for k in (0, K, WIDTH - K):
            one = mix(one * _C3 + self.parts[windows + k])
        for k in (0, 8, 16, 24, 32, 40, 42):
            other = mix(other * _C1 + words[windows + k])
        return one, other

    def windows_of(self, runs: np.ndarray) -> np.ndarray:
        n = self.n[runs]
        ends = np.cumsum(n)
        return np.arange(int(n.sum())) + np.repeat(self.start[runs] - (ends - n), n)

    def text(self, run: int) -> bytes:
        return self.raw[self.start[run] : self.start[run] + self.n[run] + WIDTH - 1]


def _ask_runs(buckets: int):
    def request(block: Block):
        runs = Runs(block.texts, block.ids)
        m, h = runs.m[runs.lead], runs.hash[runs.lead]
        for bucket, a, b in cut_by_bucket(m, _BITS, buckets):
            yield bucket, join_bodies(pack(m[a:b], True), pack(h[a:b]), pack(runs.least[a:b]))

    return request


def _answer_runs(rows: list[tuple[int, bytes]]) -> list[bytes]:
    bodies = [split_bodies(body) for _, body in rows]
    m = np.concatenate([unpack(b[0], U64, True) for b in bodies])
    h = np.concatenate([unpack(b[1], U64) for b in bodies])
    doc = np.concatenate([unpack(b[2], np.int64) for b in bodies])
    order = in_order(m, h, doc)
    m, h, sorted_doc = m[order], h[order], doc[order]
    new_m, new = group_starts(m), group_starts(m, h)
    least = sorted_doc[np.flatnonzero(new)][np.cumsum(new) - 1]
    distinct = np.add.reduceat(new.astype(np.int64), np.flatnonzero(new_m))[np.cumsum(new_m) - 1]
    ship = (sorted_doc == least) & (distinct > 1)
    codes, behind = np.empty(m.size, np.uint8), np.empty(m.size, np.int64)
    codes[order] = ship * _SHIP + (ship & (distinct > HOT)) * _HOT
    behind[order] = sorted_doc - least
    cuts = np.cumsum([unpack(b[2], np.int64).size for b in bodies])[:-1]
    return [join_bodies(pack(c), pack(d)) for c, d in zip(np.split(codes, cuts), np.split(behind, cuts), strict=True)]


def _told(block: Block, runs: Runs, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each distinct run: the code, and the smallest document that has it anywhere."""
    codes, least = np.zeros(runs.lead.size, np.uint8), runs.least.copy()
    for bucket, a, b in cut_by_bucket(runs.m[runs.lead], _BITS, buckets):
        code, behind = split_bodies(block.answers["runs"][bucket])
        codes[a:b] = unpack(code, np.uint8)
        least[a:b] -= unpack(behind, np.int64)
    return codes, least


def _plan(runs: Runs, codes: np.ndarray, buckets: int) -> tuple[dict[int, np.ndarray], dict[int, np.ndarray]]:
    """Runs sent as strings and windows sent as hashes, by bucket."""
    cold, hot = np.flatnonzero(codes == _SHIP), np.flatnonzero(codes & _HOT)
    strings = {bucket: cold[a:b] for bucket, a, b in cut_by_bucket(runs.m[runs.lead[cold]], _BITS, buckets)}
    hashed: dict[int, np.ndarray] = {}
    if hot.size:
        win = runs.windows_of(runs.lead[hot])
        key = runs.window_hashes(win)[0]
        order = np.argsort(key, kind="stable")
        hashed = {bucket: win[order[a:b]] for bucket, a, b in cut_by_bucket(key[order], 64, buckets)}
    return strings, hashed


def _doc_of(runs: Runs, windows: np.ndarray) -> np.ndarray:
    return runs.doc[np.searchsorted(runs.start, windows, "right") - 1]


def _ask_windows(buckets: int):
    def request(block: Block):
        runs = Runs(block.texts, block.ids)
        strings, hashed = _plan(runs, _told(block, runs, buckets)[0], buckets)
        none = np.zeros(0, np.int64)
        for bucket in sorted({*strings, *hashed}):
            sent = runs.lead[strings.get(bucket, none)]
            texts = [runs.text(r) for r in sent.tolist()]
            win = hashed.get(bucket, none)
            a, b = runs.window_hashes(win) if win.size else (none.view(U64), none.view(U64))
            yield bucket, join_bodies(squeeze(b"".join(texts), 3), pack(np.fromiter(map(len, texts), np.int32, len(texts))), pack(runs.doc[sent]), pack(a), pack(b), pack(_doc_of(runs, win)))

    return request


def earlier_windows(strings: list[bytes], docs: np.ndarray, width: int = WIDTH) -> np.ndarray:
    """For each window of each string, whether a string of a smaller document holds it too; strings one after the other."""
    lengths = np.fromiter(map(len, strings), np.int64, len(strings))
    raw = np.frombuffer(b"".join(s + b"\0" for s in strings), np.uint8)
    text = raw.astype(np.int32) + 1
    ends = np.cumsum(lengths + 1)
    text[ends - 1] = 0
    n = np.maximum(lengths - width + 1, 0)
    at = np.cumsum(n) - n
    window = np.full(text.size, -1, np.int32)  # number of the window that starts at each place
    place = (np.arange(int(n.sum())) + np.repeat(ends - lengths - 1 - at, n)).astype(np.int32)
    window[place] = np.arange(place.size)
    out = np.zeros(place.size, bool)
    if not place.size:
        return out
    order, lcp = induced.suffix_array(text, width, whole=False)
    kept = np.flatnonzero(window[order] >= 0)
    shared = np.minimum.reduceat(lcp[: kept[-1] + 1], np.concatenate(([0], kept[:-1] + 1)))  # since the window before
    new = shared < width
    new[0] = True
    number = window[order[kept]]
    doc = np.repeat(docs, n)[number]
    least = np.minimum.reduceat(doc, np.flatnonzero(new))[np.cumsum(new) - 1]
    out[number] = least < doc
    return out


def _answer_windows(rows: list[tuple[int, bytes]]) -> list[bytes]:
    strings, docs, first, second, owner, sizes = [], [], [], [], [], []
    for _, body in rows:
        text, lengths, doc, a, b, w = split_bodies(body)
        raw, lengths = unsqueeze(text), unpack(lengths, np.int32).astype(np.int64)
        ends = np.cumsum(lengths)
        strings += [raw[e - n : e] for e, n in zip(ends.tolist(), lengths.tolist(), strict=True)]
        docs.append(unpack(doc, np.int64))
        first.append(unpack(a, U64))
        second.append(unpack(b, U64))
        owner.append(unpack(w, np.int64))
        sizes.append((int((lengths - WIDTH + 1).sum()), first[-1].size))
    cold = earlier_windows(strings, np.concatenate(docs))
    a, b, d = np.concatenate(first), np.concatenate(second), np.concatenate(owner)
    hot = np.zeros(a.size, bool)
    if a.size:
        order = np.lexsort((d, b, a))
        new = group_starts(a[order], b[order])
        hot[order] = d[order][np.flatnonzero(new)][np.cumsum(new) - 1] < d[order]
    out, i, j = [], 0, 0
    for x, y in sizes:
        out.append(squeeze(np.packbits(np.concatenate((cold[i : i + x], hot[j : j + y]))).tobytes()))
        i, j = i + x, j + y
    return out


def _covered(block: Block, runs: Runs, buckets: int) -> np.ndarray:
    """For each byte of a block, whether it goes."""
    n = int(runs.offsets[-1])
    if not runs.start.size:
        return np.zeros(n, bool)
    codes, least = _told(block, runs, buckets)
    behind = runs.doc > least[runs.unique]
    change = np.zeros(n + 1, np.int8)
    change[runs.start[behind]] = 1
    change[(runs.start + runs.n)[behind]] -= 1
    gone = np.cumsum(change, dtype=np.int8).view(bool)  # by the windows' places
    strings, hashed = _plan(runs, codes, buckets)
    own = np.zeros(n + 1, bool)
    none = np.zeros(0, np.int64)
    for bucket in {*strings, *hashed}:
        win = np.concatenate((runs.windows_of(runs.lead[strings.get(bucket, none)]), hashed.get(bucket, none)))
        bits = np.unpackbits(np.frombuffer(unsqueeze(block.answers["windows"][bucket]), np.uint8), count=win.size).astype(bool)
        own[win[bits]] = True
    gone |= own
    # the answer is for the run in its smallest document; other rows of the same document id have it as well
    same = np.flatnonzero(~behind & (runs.lead[runs.unique] != np.arange(runs.start.size)))
    if same.size:
        gone[runs.windows_of(same)] |= own[runs.windows_of(runs.lead[runs.unique[same]])]
    edge = np.diff(gone.view(np.int8), prepend=np.int8(0))
    change = np.zeros(n + 1, np.int8)  # stretches of windows that reach into each other are a byte apart at least
    change[np.flatnonzero(edge == 1)] = 1
    change[np.flatnonzero(edge == -1) + WIDTH - 1] -= 1
    return np.cumsum(change[:-1], dtype=np.int8) > 0


def remove_earlier(df: DataFrame, scratch: Scratch) -> DataFrame:
    """Per row (doc_id, kept, n_bytes, spans): the bytes left, and the removed spans as pairs of byte offsets."""
    blocks = block_table(df, scratch, most=BLOCK)
    buckets = bucket_count(blocks, 3)
    told = ask(blocks, "runs", _ask_runs(buckets), _answer_runs, scratch)
    told = ask(told, "windows", _ask_windows(buckets), _answer_windows, scratch)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in opened(batches):
            runs = Runs(block.texts, block.ids)
            gone = _covered(block, runs, buckets)
            kept, spans, offsets = [], [], runs.offsets.tolist()
            for text, a, b in zip(block.texts, offsets, offsets[1:]):
                mask = gone[a:b]
                if not mask.any():
                    kept.append(text)
                    spans.append([])
                    continue
                kept.append(np.frombuffer(text, np.uint8)[~mask].tobytes())
                edge = np.flatnonzero(np.diff(np.concatenate(([False], mask, [False])).view(np.int8)))
                spans.append(edge.tolist())
            yield pa.RecordBatch.from_arrays([pa.array(block.ids, pa.int64()), pa.array(kept, pa.binary()), pa.array(np.diff(runs.offsets)), pa.array(spans, pa.list_(pa.int64()))], names=["doc_id", "kept", "n_bytes", "spans"])

    return told.mapInArrow(finish, "doc_id bigint, kept binary, n_bytes bigint, spans array<bigint>")


def digests(df: DataFrame, scratch: Scratch) -> DataFrame:
    return remove_earlier(df, scratch).selectExpr("doc_id", "n_bytes", "CAST(n_bytes - octet_length(kept) AS BIGINT) AS n_removed", "CAST(size(spans) DIV 2 AS BIGINT) AS n_spans", "sha2(kept, 256) AS kept_sha256")
