"""Benchmark decontamination: CGK embedding, bit-sampling LSH, exact edit verification.

Texts are lower-cased (A-Z), with runs of ASCII white space as one space. A CGK walk emits the byte under a pointer at each step and
moves on or stays by a random bit of that byte and step, so texts at a small edit distance give sequences at a small
Hamming distance. Items and documents are walked from each of their words, the item's anchors. The first
``SAMPLED`` of ``STEPS`` steps over ``RUN`` bytes are the LSH key: where an item's and a document's word have one key, the
item-sized window around both is walked on to the item's end and back to its beginning, and a candidate is kept if
at least ``AGREE`` of all those steps' bytes are equal (a first look at ``LOOK`` steps each way drops most others), and ``ALL_AGREE`` over
``REPEATS`` walks with other random bits, of which one alone may happen to agree. Its region is then searched for the item with an exact edit distance (Myers' bit vectors, best end anywhere): a hit has at most ``MAX_EDITS`` of the item's characters as edits.

Recall: the anchors are the repeats. An anchor's key is sure to be found where ``RUN`` bytes from its word on are as they were, which with
a share e of edits at random places has a chance of (1 - e) ** RUN; of n words, one at least has it with 1 - (1 - (1 - e) ** RUN) ** n
(``expected_recall``). For ``MAX_EDITS`` that is over 0.95 from ``TARGET_WORDS`` words on; the tests measure it from 15 to 80 words.
Edits at even distances leave no run longer than 1 / e, so those are found up to 0.1, and not from one edit in ``RUN`` bytes on.

Null and empty texts, and items without words, hit nothing. Items shorter than ``RUN`` bytes are anchors as a whole. Repeated rows each give
their hits. Items go out in broadcasts of at most ``ITEM_BYTES`` of text; more items mean more passes over the documents, one after the other.
A text is worked on as a whole, and takes about thirty times its bytes.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.blocks import lean
from lectern.llm.common import _SEPARATOR, BLOCK_BYTES, U64, Scratch, Words, bounded_batches, in_blocks, mix

#: Bytes of an anchor's window, the walk's steps over it and how many of them are sampled.
RUN, STEPS, SAMPLED = 7, 20, 15
#: Steps of the walk each way over the item-sized window, those of the first look, and the shares that must agree.
WALK, LOOK, LOOK_AGREE, AGREE = 96, 32, 0.36, 0.42
#: Walks of the window with other random bits, and the share that must agree in all of them together.
REPEATS, ALL_AGREE = 2, 0.43
MAX_EDITS = 0.2
#: From so many words on an item's recall at ``MAX_EDITS`` is over 0.95 by ``expected_recall``.
TARGET_WORDS = 13
ITEM_BYTES = 1 << 20
_SEED = 7
_RNG = np.random.Generator(np.random.PCG64(_SEED))
#: Whether the pointer moves on at a step from a byte.
_MOVES = _RNG.integers(0, 2, (REPEATS, 2 * WALK, 256)).astype(np.int32)
_SAMPLE = frozenset(_RNG.choice(STEPS, SAMPLED, replace=False).tolist())
_BITMAP = 20
SCHEMA = "doc_id bigint, item_id bigint, distance int, similarity double, first_word bigint, n_words bigint"


def expected_recall(words: int, edits: float) -> float:
    """The chance that one anchor at least of an item of so many words is left alone by that share of edits at random places."""
    return 1 - (1 - (1 - edits) ** RUN) ** words


class Plain:
    """Texts lower-cased with single spaces, one after the other in ``buf``, each word followed by a space."""

    def __init__(self, texts: list[bytes]):
        words = Words(texts, lower=True)
        keep = ~_SEPARATOR[words.buf]
        keep[words.ends] = True
        buf = words.buf.copy()
        buf[words.ends] = 32
        self.buf = buf[keep]
        size = words.ends - words.starts + 1
        #: where each word starts; of each text its first word, first byte and the byte behind its last
        self.starts = np.cumsum(size) - size
        self.first = words.first
        edge = np.append(self.starts, self.buf.size)
        self.low, self.high = edge[words.first[:-1]], np.maximum(edge[words.first[1:]] - 1, edge[words.first[:-1]])
        self.text_of = np.repeat(np.arange(len(texts)), np.diff(words.first))

    def span(self, a: int, b: int) -> str:
        return self.buf[a:b].tobytes().decode(errors="ignore")


def keys(plain: Plain, starts: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The LSH key of the window from each start; it ends at ``high`` at the latest."""
    last = np.minimum(starts + RUN, high).astype(np.int32) - 1
    at, key = starts.astype(np.int32), np.ones(starts.size, U64)
    for step in range(STEPS):
        byte = plain.buf[at]
        if step in _SAMPLE:
            key *= U64(0x9E3779B97F4A7C15)
            key ^= byte
            key ^= key >> U64(29)
        at += _MOVES[0, step][byte]
        np.minimum(at, last, out=at)
    return mix(key)


def walk(buf: np.ndarray, at: np.ndarray, limit: np.ndarray, way: int, steps: int, repeat: int) -> Iterator[np.ndarray]:
    """The byte under each pointer at each step, on (way 1) or back (way -1) to the limit."""
    at, stop = at.astype(np.int32), np.minimum if way > 0 else np.maximum
    for step in range(steps):
        byte = buf[at]
        yield byte
        at += way * _MOVES[repeat, step + (WALK if way < 0 else 0)][byte]
        stop(at, limit, out=at)


def distance(pattern: str, text: str) -> tuple[int, int]:
    """The least edit distance between the pattern and any substring of the text, and that substring's end."""
    m = len(pattern)
    if not m:
        return 0, 0
    peq: dict[str, int] = {}
    for i, c in enumerate(pattern):
        peq[c] = peq.get(c, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score = full, 0, m
    best = (m, 0)
    for j, c in enumerate(text):
        eq = peq.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph, mh = mv | (~(xh | pv) & full), pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph, mh = (ph << 1) & full, (mh << 1) & full
        pv, mv = mh | (~(xv | ph) & full), ph & xv
        if score < best[0]:
            best = (score, j + 1)
    return best


class Index:
    """Items' anchors, by key, with their walks both ways."""

    def __init__(self, items: list[tuple[int, str]]):
        self.ids = [i for i, _ in items]
        plain = Plain([t.encode() for _, t in items])
        self.sizes = np.diff(plain.first).tolist()
        self.norm = [plain.span(a, b) for a, b in zip(plain.low.tolist(), plain.high.tolist())]
        self.bytes = plain.high - plain.low
        item, start = plain.text_of, plain.starts
        # a word too near the end for a whole window is no anchor, but for the first one
        use = (plain.high[item] - start >= RUN) | (start == plain.low[item])
        item, start = item[use], start[use]
        key = keys(plain, start, plain.high[item])
        order = np.argsort(key, kind="stable")
        self.key, self.item, start = key[order], item[order], start[order]
        self.offset = start - plain.low[self.item]
        ahead = self.bytes[self.item] - self.offset
        #: steps that count, on and back
        self.counted = [np.minimum(WALK, 2 * ahead).astype(np.int16), np.minimum(WALK, 2 * self.offset).astype(np.int16)]
        limits = (plain.high[self.item] - 1).astype(np.int32), plain.low[self.item].astype(np.int32)
        none = np.zeros((WALK, 0), np.uint8)
        self.walks = [[np.stack(list(walk(plain.buf, start, limit, way, WALK, r))) if start.size else none for limit, way in zip(limits, (1, -1))] for r in range(REPEATS)]
        self.bitmap = np.zeros(1 << _BITMAP, bool)
        self.bitmap[(self.key & U64((1 << _BITMAP) - 1)).astype(np.int64)] = True

    def agreeing(self, plain: Plain, at: np.ndarray, anchor: np.ndarray, steps: int, repeats: int) -> np.ndarray:
        """The share of the steps over the item-sized window, so many each way at most, at which document and item have one byte."""
        text = plain.text_of[np.searchsorted(plain.starts, at)]
        same, of = np.zeros(at.size, np.int32), np.zeros(at.size, np.int32)
        limits = (plain.high[text] - 1).astype(np.int32), plain.low[text].astype(np.int32)
        for r in range(repeats):
            for known, counted, limit, way in zip(self.walks[r], self.counted, limits, (1, -1)):
                n = np.minimum(counted[anchor], steps)
                for step, byte in enumerate(walk(plain.buf, at, limit, way, steps, r)):
                    same += (byte == known[step][anchor]) & (step < n)
                of += n
        return same / np.maximum(of, 1)


def _candidates(plain: Plain, index: Index) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Words of the texts and anchors of items whose windows agree well enough."""
    high = plain.high[plain.text_of]
    key = keys(plain, plain.starts, high)
    maybe = np.flatnonzero(index.bitmap[(key & U64((1 << _BITMAP) - 1)).astype(np.int64)])
    low, top = np.searchsorted(index.key, key[maybe], "left"), np.searchsorted(index.key, key[maybe], "right")
    n, done = top - low, 0
    total = np.cumsum(n)
    while done < n.size:
        to = max(done + 1, int(np.searchsorted(total, (total[done - 1] if done else 0) + (1 << 17), "right")))
        k = n[done:to]
        at = plain.starts[np.repeat(maybe[done:to], k)]
        anchor = np.arange(int(k.sum())) + np.repeat(low[done:to] - (np.cumsum(k) - k), k)
        for steps, repeats, share in ((LOOK, 1, LOOK_AGREE), (WALK, 1, AGREE), (WALK, REPEATS, ALL_AGREE)):
            good = index.agreeing(plain, at, anchor, steps, repeats) >= share
            at, anchor = at[good], anchor[good]
        yield at, anchor
        done = to


def _hits(texts: list[bytes], index: Index) -> Iterator[tuple[int, int, int, float, int, int]]:
    """(text, item, distance, similarity, first word, words) for each text and item that it holds."""
    plain = Plain(texts)
    if not plain.starts.size or not index.key.size:
        return
    found: set[tuple[int, int, int]] = set()
    for at, anchor in _candidates(plain, index):
        text = plain.text_of[np.searchsorted(plain.starts, at)]
        found.update(zip(text.tolist(), index.item[anchor].tolist(), (at - index.offset[anchor]).tolist()))
    best: dict[tuple[int, int], tuple[int, int]] = {}
    reach: dict[tuple[int, int], int] = {}
    for d, i, at in sorted(found):
        size = int(index.bytes[i])
        slack = int(MAX_EDITS * size) + 8
        if (d, i) in best and best[d, i][0] == 0 or (d, i) in reach and at <= reach[d, i]:
            continue
        reach[d, i] = at + slack
        low, high = int(plain.low[d]), int(plain.high[d])
        pattern = index.norm[i]
        edits, _ = distance(pattern, plain.span(max(low, at - slack), min(high, at + size + 2 * slack)))
        if edits <= MAX_EDITS * len(pattern) and ((d, i) not in best or edits < best[d, i][0]):
            word = int(np.searchsorted(plain.starts, max(at, low), "right")) - 1 - int(plain.first[d])
            best[d, i] = (edits, max(word, 0))
    for (d, i), (edits, word) in sorted(best.items()):
        yield d, i, edits, 1.0 - edits / len(index.norm[i]), word, index.sizes[i]


def _chunks(items: DataFrame, item_id: str, text: str) -> Iterator[list[tuple[int, str]]]:
    """The items in lists of bounded size, one list at a time on the driver."""
    held, size = [], 0
    for r in items.select(item_id, text).where(F.col(text).isNotNull()).toLocalIterator():
        held.append((r[0], r[1]))
        size += len(r[1])
        if size > ITEM_BYTES:
            yield held
            held, size = [], 0
    if held:
        yield held


def find(df: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row per document and item that it holds: doc_id, item_id, distance, similarity, and about where (in words)."""
    spark = df.sparkSession
    bounded_batches(spark)

    def over(shared) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            lean()
            index = Index(shared.value)
            for batch in batches:
                ids = batch.column(0).to_pylist()
                texts = [b"" if v is None else v for v in batch.column(1).cast(pa.binary()).to_pylist()]
                rows = [(ids[a + d], index.ids[i], *rest) for a, b in in_blocks(list(map(len, texts)), BLOCK_BYTES) for d, i, *rest in _hits(texts[a:b], index)]
                kinds = (pa.int64(), pa.int64(), pa.int32(), pa.float64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=["doc_id", "item_id", "distance", "similarity", "first_word", "n_words"])

        return df.select(F.col(doc_id).cast("bigint"), text).mapInArrow(run, SCHEMA)

    done, held, scratch = [], None, None
    for k, chunk in enumerate(_chunks(items, item_id, item_text)):
        if held is not None:
            # more than one broadcast: each pass is written before the next one's items go out
            scratch = scratch or Scratch(spark, "decontamination")
            done.append(scratch.save(over(held), f"pass-{k}"))
            held.destroy()
        held = spark.sparkContext.broadcast(chunk)
    if held is None:
        return spark.createDataFrame([], SCHEMA)
    return reduce(DataFrame.union, [*done, over(held)])
