"""N-gram Jaccard join: documents whose sets of word shingles overlap by a given share of their union.

Words are lower-cased (A-Z) runs without ASCII white space; a document's set holds its distinct shingles of
``shingle`` words, or its whole word sequence where it has fewer. Sets are ordered rare-first, by document frequency over the whole
table (equal from ``MOST`` on) and then by hash. Two sets that reach the threshold share one of their first |x| - ceil(t |x|) + 1
shingles (the prefix), so sets meet on prefix shingles, and only on those that another document has as well. Pairs pass the
length filter, the positional filter (what can still be shared after the place where they meet) and the parity filter
(the bits in which the two sets' parity sketches differ are at most as many as the shingles that only one of them has) where they meet;
before the exact intersection comes the suffix filter (shingles split at a pivot: both halves' difference in size bounds what can be shared).

Equal sets are one node. Only components are asked for, so links are found in rounds. First each prefix shingle's sets meet
its hub alone, its most typical set (of copies their original). Then, where a shingle still holds several components, the sets of different
components meet; a shingle with more than ``ROWS`` of them gets further hubs as long as these halve it, and its sets are then dealt as
pairs of blocks of about ``ROWS``. A pair is verified once: those of earlier rounds are left out. No link between different components
is lost, and groups of copies don't emit all their pairs.

Empty sets (null, empty or blank texts) link with nothing. Repeated rows and null ids are documents like others;
a component's id is its smallest non-null doc_id. Shingles and sets are known by 64-bit hashes. A text is worked on as a whole and takes
about twenty times its bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.blocks import Block, ask, block_table, bucket_count, cut_by_bucket, join_bodies, lean, opened, pack, split_bodies, squeeze, unpack, unsqueeze
from lectern.llm.common import U64, Scratch, Words, mix, packed, parts, rolling
from lectern.llm.components import components
from lectern.llm.superkmer import group_starts, spans_hash

#: Frequencies from here on count as equal in the order of shingles.
MOST = (1 << 20) - 1
#: Bytes of a block; the sets of one take about twenty times as much.
BLOCK = 2 << 20
#: Sets that meet all others of a block at once.
ROWS = 1_024
#: Bytes of a parity sketch.
SKETCH = 64
#: Pairs that are looked at in one vectorised step.
_STEP = 1 << 19


class Sets:
    """The shingle sets of a block: ``h`` holds each document's distinct shingles, document by document."""

    def __init__(self, texts: list[bytes], shingle: int):
        words = Words(texts, lower=True)
        counts = np.diff(words.first)
        hashes = words.hashes()
        n = np.where(counts >= shingle, counts - shingle + 1, np.minimum(counts, 1))
        ends = np.cumsum(n)
        doc = np.repeat(np.arange(len(texts), dtype=np.int32), n)
        at = np.arange(int(n.sum())) + np.repeat(words.first[:-1] - (ends - n), n)
        rolls = rolling(hashes, shingle)
        h = rolls[np.minimum(at, max(rolls.size - 1, 0))] if rolls.size else np.zeros(at.size, U64)
        few = np.flatnonzero(n * (counts < shingle))
        short = words.first[:-1][few]
        h[(ends - n)[few]] = spans_hash(hashes, short, short + counts[few]) ^ U64(0x5DEECE66D)
        order = np.argsort(h)
        same = h[order[1:]] == h[order[:-1]]
        if same.any():
            # of a shingle that a document repeats one is kept
            run = np.zeros(h.size, bool)
            run[1:] = same
            run[:-1] |= same
            some = order[run]
            some = some[np.lexsort((some, doc[some], h[some]))]
            again = some[1:][(h[some][1:] == h[some][:-1]) & (doc[some][1:] == doc[some][:-1])]
            if again.size:
                keep = np.ones(h.size, bool)
                keep[again] = False
                order = (np.cumsum(keep) - 1)[order[keep[order]]]
                h, doc = h[keep], doc[keep]
        self.h, self.doc, self._order = h, doc, order
        self.sizes = np.bincount(doc, minlength=len(texts)).astype(np.int64)
        self.at = np.concatenate(([0], np.cumsum(self.sizes)))
        sums = np.concatenate(([U64(0)], np.cumsum(mix(h ^ U64(0x1F123BB5)))))
        #: a set's name: order-free hash of its shingles
        self.sid = (mix((sums[self.at[1:]] - sums[self.at[:-1]]) + self.sizes.astype(U64) * U64(0x9E3779B97F4A7C15)) >> U64(1)).astype(np.int64)
        #: documents that stand for their set in this block
        self.lead = np.zeros(len(texts), bool)
        self.lead[np.unique(self.sid, return_index=True)[1]] = True
        self.lead &= self.sizes > 0

    def keys(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct shingles of leading documents, where each begins in the last array, and these documents' shingles by hash."""
        order = self._order[self.lead[self.doc[self._order]]]
        first = np.flatnonzero(group_starts(self.h[order]))
        return self.h[order[first]], first, order

    def sketches(self, docs: np.ndarray) -> np.ndarray:
        """Of each of these documents, the parity of its shingles by the high bits of their hashes."""
        number = np.full(self.sizes.size, -1)
        number[docs] = np.arange(docs.size)
        chosen = np.flatnonzero(number[self.doc] >= 0)
        bits = SKETCH * 8
        place = number[self.doc[chosen]] * bits + (mix(self.h[chosen] ^ U64(0x94D049BB133111EB)) % U64(bits)).astype(np.int64)
        return np.packbits(np.bincount(place, minlength=docs.size * bits).reshape(-1, bits) & 1, axis=1)


def _described(shingle: int):
    def describe(texts: list[bytes]) -> list[bytes]:
        sets = Sets(texts, shingle)
        return [packed(sets.sizes, "<i8"), packed(sets.sid, "<i8")]

    return describe


def _documents(blocks: DataFrame) -> DataFrame:
    """(doc_id, block_id, row, n_shingles, sid) of each row, from what the block table says of its texts; no text is read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in batch.to_pylist():
                n, sid, rows = np.frombuffer(b["n"], "<i8"), np.frombuffer(b["sid"], "<i8"), len(b["ids"])
                yield pa.RecordBatch.from_arrays([pa.array(b["ids"], pa.int64()), pa.array(np.full(rows, b["block_id"])), pa.array(np.arange(rows)), pa.array(n), pa.array(sid, mask=n == 0)], names=["doc_id", "block_id", "row", "n_shingles", "sid"])

    return blocks.select("block_id", "ids", "n", "sid").mapInArrow(run, "doc_id bigint, block_id bigint, row bigint, n_shingles bigint, sid bigint")


def prefix_size(n: np.ndarray, percent: int) -> np.ndarray:
    return n - -(-n * percent // 100) + 1


def _ask_frequency(shingle: int, buckets: int):
    def request(block: Block):
        sets = Sets(block.texts, shingle)
        keys, first, order = sets.keys()
        n = np.diff(np.append(first, order.size)).astype(np.uint32)
        for bucket, a, b in cut_by_bucket(keys, 64, buckets):
            yield bucket, join_bodies(pack(keys[a:b], True), pack(n[a:b]))

    return request


def _answer_frequency(rows: list[tuple[int, bytes]]) -> list[bytes]:
    bodies = [split_bodies(body) for _, body in rows]
    keys = [unpack(b[0], U64, True) for b in bodies]
    every = np.concatenate(keys)
    order = np.argsort(every)
    new = group_starts(every[order])
    n = np.concatenate([unpack(b[1], np.uint32) for b in bodies]).astype(np.int64)
    total = np.empty(every.size, np.uint32)
    total[order] = np.minimum(np.add.reduceat(n[order], np.flatnonzero(new)), MOST)[np.cumsum(new) - 1] if every.size else 0
    return [pack(x) for x in np.split(total, np.cumsum([k.size for k in keys])[:-1])]


def _frequencies(block: Block, sets: Sets, buckets: int) -> np.ndarray:
    """Of each shingle of a leading document, its frequency; 0 for other documents' shingles."""
    keys, first, order = sets.keys()
    told = np.zeros(keys.size, np.uint32)
    for bucket, a, b in cut_by_bucket(keys, 64, buckets):
        told[a:b] = unpack(block.answers["frequency"][bucket], np.uint32)
    out = np.zeros(sets.h.size, np.uint32)
    out[order] = np.repeat(told, np.diff(np.append(first, order.size)))
    return out


def _by_frequency(doc: np.ndarray, df: np.ndarray, h: np.ndarray) -> np.ndarray:
    """The order by document, frequency and hash: of one packed key, and where that is equal by the whole hash."""
    key = (doc.astype(U64) << U64(48)) | (df.astype(U64) << U64(28)) | (h >> U64(36))
    order = np.argsort(key)
    same = key[order[1:]] == key[order[:-1]]
    if same.any():
        run = np.zeros(key.size, bool)
        run[1:] = same
        run[:-1] |= same
        at = np.flatnonzero(run)
        some = order[at]
        order[at] = some[np.lexsort((h[some], key[some]))]
    return order


def may_link(percent: int, na, pa_, nb, pb, differ) -> np.ndarray:
    """Length, positional and parity filters for sets of na and nb shingles that meet at places pa_ and pb and whose sketches differ so much.

    All that two sets share lies at or behind the first shingle at which they meet, so a link shows there at least.
    """
    both, reach = na + nb, np.minimum(na - pa_, nb - pb)
    return (100 * np.minimum(na, nb) >= percent * np.maximum(na, nb)) & ((100 + percent) * reach >= percent * both) & ((100 + percent) * differ.astype(np.int64) <= (100 - percent) * both)


def _differ(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(axis=1)


_POSTING = "key bigint, sid bigint, n bigint, pos bigint, typ int, sketch binary, hub bigint"


def _postings(told: DataFrame, shingle: int, percent: int, buckets: int) -> DataFrame:
    """(key, sid, n, pos, typ, sketch, hub) of prefix shingles that several distinct sets hold.

    ``typ`` is a set's mean log frequency of shingles: the text that many others were copied from has the highest.
    ``hub``: the shingle's most typical set, where the filters let the pair through.
    """

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in opened(batches):
            sets = Sets(block.texts, shingle)
            if not sets.h.size:
                continue
            df = _frequencies(block, sets, buckets)
            typ = (np.bincount(sets.doc, (1000 * np.log2(np.maximum(df, 1))).astype(np.int64), len(block.texts)) // np.maximum(sets.sizes, 1)).astype(np.int32)
            once = np.bincount(sets.doc[df == 1], minlength=len(block.texts))
            # a shingle held once comes before all others and meets nothing
            shared = np.flatnonzero((df > 1) & (once < prefix_size(sets.sizes, percent))[sets.doc])
            h, doc = sets.h[shared], sets.doc[shared]
            order = _by_frequency(doc, df[shared], h)
            h, doc = h[order], doc[order]
            pos = np.arange(h.size) - np.searchsorted(doc, doc) + once[doc]
            n = sets.sizes[doc]
            use = np.flatnonzero(pos < prefix_size(n, percent))
            use = use[np.argsort(h[use], kind="stable")]
            h, doc, pos, n = h[use], doc[use], pos[use], n[use]
            met = np.unique(doc)
            sketch = sets.sketches(met)[np.searchsorted(met, doc)] if met.size else np.zeros((0, SKETCH), np.uint8)
            found = [
                (bucket, join_bodies(pack(h[a:b], True), pack(sets.sid[doc[a:b]]), pack(n[a:b].astype(np.int32)), pack(pos[a:b].astype(np.int32)), pack(typ[doc[a:b]]), squeeze(sketch[a:b].tobytes())))
                for bucket, a, b in cut_by_bucket(h, 64, buckets)
            ]
            yield pa.RecordBatch.from_arrays([pa.array([b for b, _ in found], pa.int32()), pa.array([x for _, x in found], pa.binary())], names=["bucket", "body"])

    def meet(table: pa.Table) -> pa.Table:
        lean()
        bodies = [split_bodies(b) for b in table["body"].to_pylist()]
        h = np.concatenate([unpack(b[0], U64, True) for b in bodies])
        sid = np.concatenate([unpack(b[1], np.int64) for b in bodies])
        n, pos, typ = (np.concatenate([unpack(b[i], np.int32) for b in bodies]) for i in (2, 3, 4))
        sketch = np.frombuffer(b"".join(unsqueeze(b[5]) for b in bodies), np.uint8).reshape(-1, SKETCH)
        order = np.lexsort((sid, typ, h))
        order = order[group_starts(h[order], sid[order].view(U64))]  # equal sets have one typ and lie together
        group = np.cumsum(group_starts(h[order])) - 1
        size = np.bincount(group, minlength=1)
        order = order[(size > 1)[group]] if order.size else order
        h, sid, n, pos, typ, sketch = h[order], sid[order], n[order].astype(np.int64), pos[order].astype(np.int64), typ[order], sketch[order]
        new = group_starts(h)
        first = np.flatnonzero(new)
        last = np.append(first[1:], h.size)[np.cumsum(new) - 1] - 1
        good = may_link(percent, n, pos, n[last], pos[last], _differ(sketch, sketch[last])) & (sid != sid[last])
        return pa.table({"key": h.view(np.int64), "sid": sid, "n": n, "pos": pos, "typ": typ, "sketch": pa.array([s.tobytes() for s in sketch], pa.binary()), "hub": pa.array(sid[last], mask=~good)})

    return told.mapInArrow(emit, "bucket int, body binary").groupBy("bucket").applyInArrow(meet, _POSTING)


def _suffix_bound(x: np.ndarray, y: np.ndarray, depth: int = 3) -> int:
    """At least so many elements of sorted x or y are in one of them only."""
    if depth == 0 or not x.size or not y.size:
        return abs(x.size - y.size)
    pivot = y[y.size // 2]
    i, j = int(np.searchsorted(x, pivot)), y.size // 2
    return _suffix_bound(x[:i], y[:j], depth - 1) + _suffix_bound(x[i:], y[j:], depth - 1)


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b), with ``ok`` where their sets reach the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = np.zeros(batch.num_rows, bool)
            for k, (xs, ys) in enumerate(zip(batch.column("xs"), batch.column("ys"), strict=True)):
                x, y = np.frombuffer(xs.as_buffer(), U64), np.frombuffer(ys.as_buffer(), U64)
                both = x.size + y.size
                # 100 i >= p (both - i), where i <= (both - apart) / 2
                if (100 + percent) * (both - _suffix_bound(x, y)) >= 2 * percent * both:
                    merged = np.sort(np.concatenate((x, y)))
                    i = int(np.count_nonzero(merged[1:] == merged[:-1]))
                    ok[k] = (100 + percent) * i >= percent * both
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(ok)], names=["a", "b", "ok"])

    xs = sets.select(F.col("sid").alias("a"), F.col("body").alias("xs"))
    ys = sets.select(F.col("sid").alias("b"), F.col("body").alias("ys"))
    return pairs.join(xs, "a").join(ys, "b").select("a", "b", "xs", "ys").mapInArrow(run, "a bigint, b bigint, ok boolean")


def _mixed(postings: DataFrame, root: DataFrame) -> DataFrame:
    """Postings with ``root``, of the shingles that still hold several components; ``m`` is how many postings a shingle has."""
    placed = postings.drop("hub").join(root.withColumnRenamed("node", "sid"), "sid", "left").withColumn("root", F.coalesce("root", "sid"))
    several = placed.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count(F.lit(1)).alias("m")).where("lo < hi").select("key", "m")
    return placed.join(several, "key")


def _next_hubs(mixed: DataFrame, turn: int, percent: int) -> DataFrame:
    """Pairs of each shingle's hub of this turn, another one each time, with its sets of other components."""
    hub = mixed.groupBy("key").agg(F.max_by(F.struct("sid", "n", "pos", "root"), F.xxhash64("sid", F.lit(turn))).alias("hub")).select("key", "hub.*")
    near = f"100L * least(a.n, b.n) >= {percent}L * greatest(a.n, b.n) AND (100L + {percent}) * least(a.n - a.pos, b.n - b.pos) >= {percent}L * (a.n + b.n)"
    pairs = hub.alias("a").join(mixed.alias("b"), "key").where("a.root <> b.root").where(near)
    return pairs.select(F.least("a.sid", "b.sid").alias("a"), F.greatest("a.sid", "b.sid").alias("b"))


def _across(mixed: DataFrame, percent: int) -> DataFrame:
    """Pairs of sets of different components that meet at a shingle and pass the filters; a pair may come several times."""

    def run(table: pa.Table) -> pa.Table:
        lean()
        key, lo, hi, part, sid, n, pos, root = (table[c].to_numpy() for c in ("key", "lo", "hi", "part", "sid", "n", "pos", "root"))
        sketch = np.frombuffer(b"".join(table["sketch"].to_pylist()), np.uint8).reshape(-1, SKETCH)
        order = np.lexsort((sid, hi, lo, key))
        key, lo, hi, part, sid, n, pos, root, sketch = (x[order] for x in (key, lo, hi, part, sid, n, pos, root, sketch))
        new = group_starts(key, lo, hi)
        before = np.arange(key.size) - np.flatnonzero(new)[np.cumsum(new) - 1] if key.size else np.zeros(0, np.int64)
        done, found = 0, np.zeros((0, 2), np.int64)
        cuts = np.cumsum(before)
        while done < key.size:
            # each set with those before it in its group, some sets at a time
            to = max(done + 1, int(np.searchsorted(cuts, (cuts[done - 1] if done else 0) + _STEP, "right")))
            k = before[done:to]
            j = np.repeat(np.arange(done, to), k)
            i = j - np.repeat(k, k) + np.arange(j.size) - np.repeat(np.cumsum(k) - k, k)
            met = (root[i] != root[j]) & ((lo[i] == hi[i]) | (part[i] != part[j]))
            i, j = i[met], j[met]
            good = may_link(percent, n[i], pos[i], n[j], pos[j], _differ(sketch[i], sketch[j]))
            pairs = np.stack((np.minimum(sid[i], sid[j])[good], np.maximum(sid[i], sid[j])[good]), axis=1)
            found = np.unique(np.concatenate((found, pairs)), axis=0) if pairs.size else found
            done = to
        return pa.table({"a": found[:, 0], "b": found[:, 1]})

    cut = mixed.withColumn("blocks", F.ceil(F.col("m") / ROWS).cast("int")).withColumn("part", F.pmod(F.xxhash64("sid"), F.col("blocks")).cast("int"))
    dealt = cut.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumns({"lo": F.least("part", "other"), "hi": F.greatest("part", "other")})
    bucket = F.pmod(F.xxhash64("key", "lo", "hi"), F.lit(4 * parts(mixed.sparkSession)))
    return dealt.select("key", "lo", "hi", "part", "sid", "n", "pos", "root", "sketch", bucket.alias("bucket")).groupBy("bucket").applyInArrow(run, "a bigint, b bigint")


def join_components(df: DataFrame, scratch: Scratch, shingle: int, percent: int) -> DataFrame:
    """(doc_id, block_id, row, n_shingles, component_id) per row; documents without link are components of their own.

    ``block_id`` and ``row`` number the rows, so that of a component's rows one can be kept.
    """
    blocks = block_table(df, scratch, most=BLOCK, more=("n", "sid"), describe=_described(shingle))
    buckets = bucket_count(blocks)
    docs = _documents(blocks)
    told = ask(blocks.select("block_id", "ids", "sizes", "body"), "frequency", _ask_frequency(shingle, buckets), _answer_frequency, scratch)
    postings = scratch.save(_postings(told, shingle, percent, buckets), "postings")
    scratch.drop("frequency")
    meeting = postings.select(F.col("sid").alias("want")).distinct()

    def give(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in opened(batches):
            rows = sorted(block.answers["wanted"][0])
            sets = Sets([block.texts[i] for i in rows], shingle)
            bodies = [packed(np.sort(sets.h[a:b]), "<u8") for a, b in zip(sets.at, sets.at[1:])]
            yield pa.RecordBatch.from_arrays([pa.array(sets.sid), pa.array(bodies, pa.binary())], names=["sid", "body"])

    # only sets that meet another are written, each by the block that has it first
    holders = docs.where("sid IS NOT NULL").groupBy("sid").agg(F.min(F.struct("block_id", "row")).alias("at")).join(meeting, F.col("sid") == F.col("want"))
    wanted = holders.groupBy("at.block_id").agg(F.expr("array(named_struct('bucket', 0, 'body', collect_list(at.row)))").alias("wanted"))
    sets = scratch.save(blocks.drop("n", "sid").join(wanted, "block_id").mapInArrow(give, "sid bigint, body binary"), "sets")

    first = postings.where("hub IS NOT NULL").select(F.least("sid", "hub").alias("a"), F.greatest("sid", "hub").alias("b")).distinct()
    known = scratch.save(_verified(first, sets, percent), "pairs-0")
    root = components(known.where("ok"), scratch, "round-0")
    turn, before = 1, None
    while True:
        mixed = scratch.save(_mixed(postings, root), f"mixed-{turn}")
        widest = mixed.agg(F.max("m")).first()[0] or 0
        if widest <= ROWS or before is not None and 2 * widest > before:
            break
        turn, before = turn + 1, widest
        more = _next_hubs(mixed, turn, percent).distinct().join(known.select("a", "b"), ["a", "b"], "left_anti")
        found = scratch.save(_verified(more, sets, percent), f"pairs-{turn}")
        known = known.unionByName(found)
        root = _merged(root, found, scratch, f"round-{turn}")
    if widest:
        rest = _across(mixed, percent).distinct().join(known.select("a", "b"), ["a", "b"], "left_anti")
        root = _merged(root, scratch.save(_verified(rest, sets, percent), "pairs-rest"), scratch, "round-rest")

    named = docs.join(root.withColumnRenamed("node", "sid"), "sid", "left").withColumn("root", F.coalesce("root", "sid"))
    least = named.where("root IS NOT NULL").groupBy("root").agg(F.min("doc_id").alias("least"))
    return named.join(least, "root", "left").select("doc_id", "block_id", "row", "n_shingles", F.coalesce("least", "doc_id").alias("component_id"))


def _merged(root: DataFrame, found: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """Components of stars and new links."""
    stars = root.select(F.col("node").alias("a"), F.col("root").alias("b"))
    return components(stars.union(found.where("ok").select("a", "b")), scratch, name)


def result(df: DataFrame, scratch: Scratch, shingle: int = 4, percent: int = 85) -> DataFrame:
    return join_components(df, scratch, shingle, percent).select("doc_id", "n_shingles", "component_id")
