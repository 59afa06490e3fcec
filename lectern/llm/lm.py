"""Language-model scoring by a weighted backoff automaton of word n-grams up to three.

Words are lower-cased (A-Z) runs without ASCII white space; each text ends with an end token. All training
texts are counted: each block of documents asks the corpus for the counts of its own words, bigrams and trigrams, no
more, builds the part of the automaton that its texts can reach, and runs it over them.

States are the root, the start, the words and the bigrams of the training texts. A state's arcs are the n-grams seen behind it: with c(hw) their count
and h' the state without its first word, P(w | h) = (c(hw) + MU * P(w | h')) / (c(h) + MU), and at the root
P(w) = (c + 0.5) / (N + 0.5 (V + 1)); an arc's weight is log10 P, and it leads to the longest state that its text ends with. Where a state has
no arc for a word, its failure arc leads to h' with the weight log10 (MU / (c(h) + MU)); the root has an arc for each word. So each state's
probabilities sum to 1 over the vocabulary and one unknown word. One traversal from left to right carries the state and adds the weights:
all texts of a block step together, those of over ``PIECE`` tokens in pieces, each of which first
walks over the ``ORDER`` - 1 tokens before it, as these settle the state.

Null and empty texts hold only the end token; repeated rows count each. Without training texts
all words are unknown. Words are known by 64-bit hashes, bigrams and trigrams by 48-bit ones. A text is worked on as a whole and takes
about fifty times its bytes.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.blocks import Block, ask, block_table, bucket_count, cut_by_bucket, join_bodies, opened, pack, split_bodies, unpack
from lectern.llm.common import U64, Scratch, Words, mix

ORDER, MU = 3, 50.0
PIECE = 512
#: Bytes of a block.
BLOCK = 3 << 20
_END, _START = U64(0x8F1BBCDC5A827999), U64(0x6ED9EBA1CA62C1D6)
_C1, _C2 = U64(0x9E3779B97F4A7C15), U64(0xC2B2AE3D27D4EB4F)
_BITS = 48


def trains(doc_id: int | None) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 5 != 1


class Tokens:
    """A block's tokens: words and ends, in order."""

    def __init__(self, block: Block, is_training: Callable[[int | None], bool]):
        words = Words(block.texts, lower=True)
        docs = len(block.texts)
        self.counts = np.diff(words.first) + 1
        self.last = np.cumsum(self.counts) - 1
        self.first = self.last - self.counts + 1
        is_end = np.zeros(words.starts.size + docs, bool)
        is_end[self.last] = True
        self.key = np.full(is_end.size, _END, U64)
        self.key[~is_end] = words.hashes()
        self.training = np.fromiter(map(is_training, block.ids), bool, docs)
        self.in_training = np.repeat(self.training, self.counts)
        self.distinct, self.of = np.unique(self.key, return_inverse=True)

    def ngrams(self) -> None:
        """The distinct bigrams and trigrams, where each is met first, and that of each token; a text's first token ends no trigram."""
        before = np.empty_like(self.key)
        before[1:] = self.key[:-1]
        before[self.first] = _START
        earlier = np.empty_like(self.key)
        earlier[1:] = before[:-1]
        self.pairs, self.pair_at, self.pair_of = np.unique(mix(before * _C1 + self.key) >> U64(64 - _BITS), return_index=True, return_inverse=True)
        inner = np.ones(self.key.size, bool)
        inner[self.first] = False
        inner = np.flatnonzero(inner)
        whole = mix(mix(earlier[inner] * _C2 + before[inner]) * _C1 + self.key[inner]) >> U64(64 - _BITS)
        self.triples, at, self.triple_of = np.unique(whole, return_index=True, return_inverse=True)
        self.triple_at, self.inner = inner[at], inner


def _answers(block: Block, name: str, part: int, keys: np.ndarray, bits: int, buckets: int) -> np.ndarray:
    out = np.zeros(keys.size, U64)
    for bucket, a, b in cut_by_bucket(keys, bits, buckets):
        out[a:b] = unpack(split_bodies(block.answers[name][bucket])[part], U64)
    return out


def _asking(sections: list[tuple[np.ndarray, np.ndarray]], bits: int, buckets: int):
    """One message a bucket: of each section its sorted keys there and their counts."""
    cuts = [{bucket: (a, b) for bucket, a, b in cut_by_bucket(keys, bits, buckets)} for keys, _ in sections]
    for bucket in sorted(set().union(*cuts)):
        parts = []
        for cut, (keys, counts) in zip(cuts, sections, strict=True):
            a, b = cut.get(bucket, (0, 0))
            parts += [pack(keys[a:b], True), pack(counts[a:b].astype(np.uint32))]
        yield bucket, join_bodies(*parts)


def _summed(rows: list[tuple[int, bytes]]) -> list[bytes]:
    """Totals of each section's keys in the order asked; with the first body also the sum and number of the first section's counts."""
    bodies = [split_bodies(body) for _, body in rows]
    out: list[list[bytes]] = [[] for _ in rows]
    for k in range(0, len(bodies[0]), 2):
        keys = [unpack(b[k], U64, True) for b in bodies]
        every = np.concatenate(keys)
        total = np.zeros(every.size, U64)
        if every.size:
            order = np.argsort(every)
            new = np.concatenate(([True], every[order][1:] != every[order][:-1]))
            n = np.concatenate([unpack(b[k + 1], np.uint32) for b in bodies]).astype(U64)
            sums = np.add.reduceat(n[order], np.flatnonzero(new))
            total[order] = sums[np.cumsum(new) - 1]
            size = np.array([sums.sum(), (sums > 0).sum()], U64) if k == 0 else size
        elif k == 0:
            size = np.zeros(2, U64)
        for i, t in enumerate(np.split(total, np.cumsum([x.size for x in keys])[:-1])):
            out[i].append(pack(t))
    return [join_bodies(*parts, (size if i == 0 else size * U64(0)).tobytes()) for i, parts in enumerate(out)]


def _sizes(replies: DataFrame) -> tuple[int, int]:
    """Tokens and distinct tokens of the training texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(2, U64)
        for batch in batches:
            for body in batch.column("body").to_pylist():
                total += np.frombuffer(split_bodies(body)[-1], U64)
        yield pa.RecordBatch.from_arrays([pa.array([int(x)], pa.int64()) for x in total], names=["n", "v"])

    row = replies.select("body").mapInArrow(run, "n bigint, v bigint").agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n", "v")]).first()
    return row.n, row.v


ROOT, START = 0, 1


class Automaton:
    """Arcs (state, word) with weight and next state, and a failure arc from each state but the root.

    ``root_weight`` and ``root_to``: the root's arcs, one for each word. ``fail_weight`` and ``fail_to``: by state.
    """

    def __init__(self, state: np.ndarray, word: np.ndarray, weight: np.ndarray, to: np.ndarray, root_weight: np.ndarray, root_to: np.ndarray, fail_weight: np.ndarray, fail_to: np.ndarray):
        self.words = root_weight.size
        key = state.astype(np.int64) * self.words + word
        order = np.argsort(key)
        # a last arc that no state has, so that a search always ends on one
        self.key = np.append(key[order], np.iinfo(np.int64).max)
        self.weight, self.to = np.append(weight[order], 0.0), np.append(to[order], ROOT)
        self.root_weight, self.root_to, self.fail_weight, self.fail_to = root_weight, root_to, fail_weight, fail_to

    def step(self, state: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What reading a word in each state adds, and the states after it; failure arcs are followed until one has the word."""
        added, now, after = np.zeros(state.size), state.copy(), np.empty_like(state)
        open_ = np.flatnonzero(now != ROOT)
        while open_.size:
            want = now[open_].astype(np.int64) * self.words + word[open_]
            arc = np.searchsorted(self.key, want)
            has = self.key[arc] == want
            took, failed = open_[has], open_[~has]
            added[took] += self.weight[arc[has]]
            after[took] = self.to[arc[has]]
            now[took] = -1
            added[failed] += self.fail_weight[now[failed]]
            now[failed] = self.fail_to[now[failed]]
            open_ = failed[now[failed] != ROOT]
        root = np.flatnonzero(now == ROOT)
        added[root] += self.root_weight[word[root]]
        after[root] = self.root_to[word[root]]
        return added, after

    def traverse(self, words: np.ndarray, first: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """The weight that each token adds, texts given by their first token and number of tokens; all start at START."""
        n = -(-counts // PIECE)
        begin = np.repeat(first, n) + PIECE * (np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n))
        end = np.minimum(begin + PIECE, np.repeat(first + counts, n))
        ahead = np.where(begin == np.repeat(first, n), 0, ORDER - 1)
        size = end - begin + ahead
        order = np.argsort(-size, kind="stable")
        begin, ahead, size = begin[order], ahead[order], size[order]
        state = np.where(ahead > 0, ROOT, START).astype(np.int32)
        out = np.zeros(words.size)
        active = np.searchsorted(-size, -np.arange(size.max(initial=0)), "left")  # pieces longer than each step's number
        for k, m in enumerate(active.tolist()):
            at = begin[:m] - ahead[:m] + k
            added, state[:m] = self.step(state[:m], words[at])
            counts_here = k >= ahead[:m]
            out[at[counts_here]] = added[counts_here]
        return out


def automaton(tokens: Tokens, count: np.ndarray, pair_count: np.ndarray, triple_count: np.ndarray, n: int, v: int) -> Automaton:
    """The part that a block's texts can reach; counts are those of its distinct words, bigrams and trigrams in the training texts."""
    t, words = tokens, count.size
    unigram = (count + 0.5) / (n + 0.5 * (v + 1))
    end = int(np.searchsorted(t.distinct, _END))
    starts = float(count[end]) if words else 0.0
    is_first = np.zeros(t.key.size, bool)
    is_first[t.first] = True
    # of each bigram: its words, the count of what is before, its probability
    at = t.pair_at
    word, head = t.of[at], np.where(is_first[at], START, t.of[at - 1] + 2)
    before = np.where(head == START, starts, count[np.maximum(head - 2, 0)])
    bigram = (pair_count + MU * unigram[word]) / (before + MU)
    seen = pair_count > 0
    pair_state = np.arange(t.pairs.size) + words + 2
    at3 = t.triple_at
    context, shorter = t.pair_of[at3 - 1], t.pair_of[at3]
    trigram = (triple_count + MU * bigram[shorter]) / (pair_count[context] + MU)
    seen3 = triple_count > 0
    state = np.concatenate((head[seen], pair_state[context[seen3]]))
    arc_word = np.concatenate((word[seen], t.of[at3][seen3]))
    weight = np.log10(np.concatenate((bigram[seen], trigram[seen3])))
    to = np.concatenate((pair_state[seen], pair_state[shorter[seen3]]))
    # nothing comes behind an end, so its states only fail
    behind = np.concatenate(([0.0, starts], np.where(np.arange(words) == end, 0, count), np.where(word == end, 0, pair_count)))
    fail_weight = np.log10(MU / (behind + MU))
    fail_to = np.concatenate((np.zeros(2 + words, np.int32), word + 2)).astype(np.int32)
    root_to = np.where(count > 0, np.arange(words) + 2, ROOT).astype(np.int32)
    return Automaton(state, arc_word, weight, to.astype(np.int32), np.log10(unigram), root_to, fail_weight, fail_to)


def score(df: DataFrame, scratch: Scratch, is_training: Callable[[int | None], bool] = trains) -> DataFrame:
    """Per row of ``df`` (doc_id, text): tokens, known tokens, the unigram score and the automaton's score."""
    blocks = block_table(df, scratch, most=BLOCK)
    buckets = bucket_count(blocks)

    def ask_words(block: Block):
        t = Tokens(block, is_training)
        yield from _asking([(t.distinct, np.bincount(t.of, t.in_training, t.distinct.size))], 64, buckets)

    def ask_ngrams(block: Block):
        t = Tokens(block, is_training)
        t.ngrams()
        yield from _asking([(t.pairs, np.bincount(t.pair_of, t.in_training, t.pairs.size)), (t.triples, np.bincount(t.triple_of, t.in_training[t.inner], t.triples.size))], _BITS, buckets)

    told = ask(blocks, "words", ask_words, _summed, scratch)
    n, v = _sizes(scratch.load("words"))
    told = ask(told, "ngrams", ask_ngrams, _summed, scratch)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in opened(batches):
            t = Tokens(block, is_training)
            t.ngrams()
            count, pairs, triples = _answers(block, "words", 0, t.distinct, 64, buckets), _answers(block, "ngrams", 0, t.pairs, _BITS, buckets), _answers(block, "ngrams", 1, t.triples, _BITS, buckets)
            auto = automaton(t, count.astype(np.float64), pairs.astype(np.float64), triples.astype(np.float64), n, v)
            per_text = lambda x: np.add.reduceat(x, t.first)
            arrays = [
                pa.array(block.ids, pa.int64()), pa.array(~t.training), pa.array(t.counts, pa.int64()), pa.array(per_text((count > 0)[t.of].astype(np.int64))),
                pa.array(np.full(t.first.size, n, np.int64)), pa.array(per_text(auto.root_weight[t.of])), pa.array(per_text(auto.traverse(t.of, t.first, t.counts))),
            ]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return told.mapInArrow(finish, "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double")
