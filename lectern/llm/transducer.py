"""BPE encoding by a transducer of bounded lookahead, decoding by an incremental byte-to-text machine.

*Lookahead.* Merges happen in the order of their ranks. Let two strings share a beginning x. While they are merged,
what lies left of some place p is the same in both, and p starts at the end of x. Only a merge of a token a that ends
at p with a token b that starts at p, done in one of the two, moves p, by the length of a. The next such merge has a
higher rank (one rank is worked off from left to right), and its right part starts with a: it is a, or has a at the
left end of how it was made. So p moves by at most the greatest sum of left parts over such chains of merges, which
:func:`lookahead` takes from the merge list in one pass from the last merge to the first. A token that ends that
many bytes before the end of what has been read is the same whatever follows: it is emitted and its bytes are dropped.

*Pre-tokens.* :class:`Stream` cuts a text that comes in pieces where the whole text would be cut: runs of letters, of
numbers, of other characters, each with a space before it, contractions, and white space. A run of any length passes
through the transducer as it comes; no more than a window of bytes and a piece of text are held.

Null and empty texts have no ids and decode to the empty text. Every id has its bytes; bytes that are not UTF-8 become U+FFFD
as the Unicode standard advises (one for each maximal part). Ids outside the vocabulary decode to nothing.
"""

from __future__ import annotations

import codecs
import heapq
import json
import struct
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StringType, StructField, StructType

from lectern.llm.common import bounded_batches, sliced

#: What ends a pre-token, in the order in which it is tried.
PRETOKENS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pre-tokens kept encoded per task, twice over, and the longest of them in characters.
CACHE, CACHED = 250_000, 128
#: Bytes that a full buffer of the transducer holds besides its lookahead.
STEP = 2_048
#: Characters of a text that are looked at together; a pre-token still open after RUN of them (more than a contraction has) is passed on as it comes.
PIECE, RUN = 1 << 16, 1_024


def printable(b: int) -> str:
    """The character that stands for a byte in a byte-level vocabulary: itself if it can be seen, else the next above 255."""
    seen = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    return chr(b if b in seen else 0x100 + sum(x not in seen for x in range(b)))


def lookahead(merges: list[tuple[bytes, bytes]]) -> int:
    """Bytes after a token's end that settle it, from the merges in the order of their ranks.

    Each token must be made by one merge only, of bytes or of tokens made before.
    """
    made: dict[bytes, bytes] = {}
    for a, b in merges:
        if a + b in made or not all(len(t) == 1 or t in made for t in (a, b)):
            raise ValueError(f"{a + b!r} is made twice, or of parts that come later")
        made[a + b] = a
    most, reach = 0, {}  # reach: by token, the furthest chain of later merges whose right part starts with it
    for a, b in reversed(merges):
        here = len(a) + reach.get(a, 0)
        most = max(most, here)
        while b is not None:
            reach[b] = max(reach.get(b, 0), here)
            b = made.get(b)
    return most


class Vocabulary:
    """Tokens as bytes, merges and their lookahead. ``special``: strings that are tokens of their own wherever they stand."""

    def __init__(self, ids: dict[bytes, int], merges: list[tuple[bytes, bytes]], special: dict[str, int] | None = None):
        self.ids, self.special = ids, special or {}
        if missing := [b for b in range(256) if bytes([b]) not in ids]:
            raise ValueError(f"bytes without a token: {missing[:5]}")
        self.lookahead = lookahead(merges)
        self.longest = max(map(len, ids))
        self.byte = [ids[bytes([b])] for b in range(256)]
        self.rank = {(ids[a], ids[b]): k for k, (a, b) in enumerate(merges)}
        self.made = [ids[a + b] for a, b in merges]
        self.pieces = [b""] * (max([*ids.values(), *self.special.values()]) + 1)
        for token, i in [*ids.items(), *((s.encode(), i) for s, i in self.special.items())]:
            self.pieces[i] = token

    @classmethod
    def read(cls, path: str, special: bool = True) -> Vocabulary:
        """From a tokenizer's JSON file of the byte-level kind; without ``special``, special strings are plain text."""
        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        model, split = told["model"], told["pre_tokenizer"]
        odd = [k for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges") if model.get(k)]
        if odd or told["normalizer"] or model["type"] != "BPE" or split["type"] != "ByteLevel" or split["add_prefix_space"] or not split["use_regex"]:
            raise ValueError(f"not a plain byte-level BPE: {odd}")
        added = told["added_tokens"]
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in added):
            raise ValueError("added tokens must stand for themselves")
        byte = {printable(b): b for b in range(256)}
        of = lambda token: bytes(map(byte.__getitem__, token))
        pairs = [p.split(" ") if isinstance(p, str) else p for p in model["merges"]]
        names = {t["content"] for t in added}
        return cls({of(t): i for t, i in model["vocab"].items() if t not in names}, [(of(a), of(b)) for a, b in pairs], {t["content"]: t["id"] for t in added} if special else {})


class Transducer:
    """Bytes of one pre-token in, ids out as soon as nothing that follows can change them."""

    def __init__(self, vocabulary: Vocabulary, step: int = STEP):
        self.vocabulary, self.held = vocabulary, b""
        self.window = vocabulary.lookahead + max(step, vocabulary.longest)

    def _merged(self, data: bytes) -> list[int]:
        """The ids of ``data`` as a whole."""
        ids = list(map(self.vocabulary.byte.__getitem__, data))
        return self._short(ids) if len(ids) <= CACHED else self._long(ids)

    def _short(self, ids: list[int]) -> list[int]:
        """Merges by looking for the least rank each time: the quickest for a word."""
        rank, made = self.vocabulary.rank.get, self.vocabulary.made
        none = len(made)
        ranks = [rank(pair, none) for pair in zip(ids, ids[1:])]
        while ranks and (least := min(ranks)) < none:
            i = ranks.index(least)
            ids[i : i + 2] = (made[least],)
            del ranks[i]
            if i < len(ranks):
                ranks[i] = rank((ids[i], ids[i + 1]), none)
            if i:
                ranks[i - 1] = rank((ids[i - 1], ids[i]), none)
        return ids

    def _long(self, ids: list[int | None]) -> list[int]:
        """Merges by a queue of ranks and places."""
        rank, made, n = self.vocabulary.rank.get, self.vocabulary.made, len(ids)
        before, after = list(range(-1, n)), list(range(1, n + 2))
        queue = [(r, i) for i, pair in enumerate(zip(ids, ids[1:])) if (r := rank(pair)) is not None]
        heapq.heapify(queue)
        while queue:
            least, i = heapq.heappop(queue)
            j = after[i]
            if j >= n or ids[i] is None or rank((ids[i], ids[j])) != least:
                continue  # one of the two has been merged since
            ids[i], ids[j] = made[least], None
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (r := rank((ids[i], ids[k]))) is not None:
                    heapq.heappush(queue, (r, i))
            h = before[i]
            if h >= 0 and (r := rank((ids[h], ids[i]))) is not None:
                heapq.heappush(queue, (r, h))
        return [x for x in ids if x is not None]

    def feed(self, data: bytes) -> list[int]:
        self.held += data
        out: list[int] = []
        while len(self.held) >= self.window:
            end, settled = 0, self.window - self.vocabulary.lookahead
            for token in self._merged(self.held[: self.window]):
                if end + (size := len(self.vocabulary.pieces[token])) > settled:
                    break
                out.append(token)
                end += size
            self.held = self.held[end:]
        return out

    def finish(self) -> list[int]:
        held, self.held = self.held, b""
        return self._merged(held)


class Known(dict):
    """Packed ids by part of a text, found when they are first asked for. When it is full, what wasn't asked for since the last time goes."""

    def __init__(self, find: Callable[[str], bytes]):
        super().__init__()
        self.find, self.old = find, {}

    def __missing__(self, part: str) -> bytes:
        packed = self.old.get(part)
        if packed is None:
            packed = self.find(part)
        if len(part) <= CACHED:
            if len(self) >= CACHE:
                self.old = self.copy()
                self.clear()
            self[part] = packed
        return packed


class Encoder:
    """Encodes in one process; short pre-tokens are remembered."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary, self.one, self.known = vocabulary, Transducer(vocabulary), Known(self._find)
        self.split = regex.compile(PRETOKENS).findall
        self.special = regex.compile("|".join(map(regex.escape, sorted(vocabulary.special, key=len, reverse=True)))) if vocabulary.special else None

    def _find(self, pretoken: str) -> bytes:
        ids = self.one.feed(pretoken.encode()) + self.one.finish()
        return struct.pack(f"<{len(ids)}I", *ids)

    def tokens(self, pretokens: list[str]) -> bytes:
        """Packed ids of whole pre-tokens."""
        return b"".join(map(self.known.__getitem__, pretokens))

    def encode(self, text: str) -> bytes:
        """Ids of a whole text, as little-endian unsigned 32-bit integers."""
        out, at = [], 0
        for m in self.special.finditer(text) if self.special else ():
            out += [self._plain(text, at, m.start()), struct.pack("<I", self.vocabulary.special[m.group()])]
            at = m.end()
        return b"".join([*out, self._plain(text, at, len(text))])

    def _plain(self, text: str, at: int, to: int) -> bytes:
        if to - at <= PIECE:
            return self.tokens(self.split(text[at:to]))
        stream = Stream(self)
        return b"".join([*(stream.feed(text[i : min(i + PIECE, to)]) for i in range(at, to, PIECE)), stream.finish()])


class Stream:
    """One text that comes in pieces: ``feed`` gives the packed ids that are settled, ``finish`` the rest."""

    RUNS = tuple(map(regex.compile, (r"\s*", r"\p{L}*", r"\p{N}*", r"[^\s\p{L}\p{N}]*")))

    def __init__(self, encoder: Encoder):
        self.encoder, self.rest, self.run = encoder, "", None
        self.open = Transducer(encoder.vocabulary)

    def _pack(self, ids: list[int]) -> bytes:
        return struct.pack(f"<{len(ids)}I", *ids)

    def feed(self, piece: str) -> bytes:
        text, out, at = self.rest + piece, [], 0
        if self.run is not None:
            at = self.run.match(text).end()
            ended = at < len(text)
            if self.run is self.RUNS[0]:
                at -= 1  # the last white space belongs to what follows, if anything does
            out.append(self._pack(self.open.feed(text[: max(at, 0)].encode())))
            if not ended:
                self.rest = text[max(at, 0) :]
                return b"".join(out)
            out.append(self._pack(self.open.finish()))
            self.run, at = None, max(at, 0)
        found = self.encoder.split(text[at:])
        # what comes may lengthen the last one, and make a contraction of an apostrophe before it
        keep = 2 if len(found) > 1 and found[-2] == "'" and len(found[-1]) == 1 else 1
        last = found[-keep:]
        out.append(self.encoder.tokens(found[:-keep]))
        self.rest = "".join(last)
        if len(self.rest) > RUN:
            end = self.rest[-1]
            self.run = next(r for r in self.RUNS if r.fullmatch(end))
            hold = self.run is self.RUNS[0]
            out.append(self._pack(self.open.feed((self.rest[:-1] if hold else self.rest).encode())))
            self.rest = end if hold else ""
        return b"".join(out)

    def finish(self) -> bytes:
        rest, self.rest = self.rest, ""
        if self.run is None:
            return self.encoder.tokens(self.encoder.split(rest))
        self.run = None
        return self._pack(self.open.feed(rest.encode()) + self.open.finish())


class Decoder:
    """Ids in, text out as soon as its bytes are whole; at most three bytes wait for the next ids."""

    def __init__(self, vocabulary: Vocabulary):
        self.pieces, self.machine = vocabulary.pieces, codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: bytes, last: bool = False) -> str:
        n = len(self.pieces)
        return self.machine.decode(b"".join([self.pieces[i] for i in np.frombuffer(ids, "<u4").tolist() if i < n]), last)

    def decode(self, ids: bytes) -> bytes:
        """The text of all ``ids`` in UTF-8, some thousand ids at a time."""
        self.machine.reset()
        size = 4 * PIECE
        return b"".join(self.feed(ids[i : i + size], i + size >= len(ids)).encode() for i in range(0, len(ids) or 1, size))


_held: dict[str, tuple[Encoder, Decoder]] = {}


def _both(key: str, shared) -> tuple[Encoder, Decoder]:
    """This process's encoder and decoder of a broadcast vocabulary; only the last one used is kept."""
    if key not in _held:
        _held.clear()
        vocabulary = Vocabulary(*shared.value)
        _held[key] = Encoder(vocabulary), Decoder(vocabulary)
    return _held[key]


class StreamingBpe:
    """The operator, for a tokenizer's JSON file that the driver reads (the vocabulary, some megabytes, is broadcast)."""

    def __init__(self, spark, path: str, special: bool = True):
        bounded_batches(spark)
        told = Vocabulary.read(path, special)
        merges = sorted(told.rank, key=told.rank.__getitem__)
        self.lookahead = told.lookahead
        self.shared = spark.sparkContext.broadcast((told.ids, [(told.pieces[a], told.pieces[b]) for a, b in merges], told.special))
        self.key = uuid.uuid4().hex

    def _over(self, df: DataFrame, column: str, work, new: list[StructField], without: tuple = ()) -> DataFrame:
        shared, key, names = self.shared, self.key, {f.name for f in new} | set(without)
        rest = [f for f in df.schema.fields if f.name not in names]
        schema = StructType([*rest, *new])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            machines = _both(key, shared)
            kinds = [pa.string() if f.dataType == StringType() else pa.binary() for f in new]
            for batch in (part for whole in batches for part in sliced(whole, column)):
                made = [work(*machines, v) for v in batch.column(column).to_pylist()]
                columns = [pa.array([row[k] for row in made], pa.binary()).cast(kind) for k, kind in enumerate(kinds)]
                yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in rest), *columns], names=schema.names)

        return df.mapInArrow(run, schema)

    def encode(self, df: DataFrame, text: str = "text", to: str = "ids") -> DataFrame:
        """``df`` with ``to``: the packed ids of the whole text. A column of that name is replaced."""
        return self._over(df, text, lambda e, _, v: (e.encode(v or ""),), [StructField(to, BinaryType())])

    def decode(self, df: DataFrame, ids: str = "ids", to: str = "decoded") -> DataFrame:
        """``df`` with ``to``: the text of the packed ids. A column of that name is replaced."""
        return self._over(df, ids, lambda _, d, v: (d.decode(v or b""),), [StructField(to, StringType())])

    def both(self, df: DataFrame, text: str = "text") -> DataFrame:
        """``df`` with ``ids`` and ``decoded`` of one pass over the rows; the text is left out."""

        def work(encoder: Encoder, decoder: Decoder, value):
            ids = encoder.encode(value or "")
            return ids, decoder.decode(ids)

        return self._over(df, text, work, [StructField("ids", BinaryType()), StructField("decoded", StringType())], (text,))


def digests(df: DataFrame, bpe: StreamingBpe) -> DataFrame:
    """One row per document: n_tokens, SHA-256 of the packed ids and of the decoded text; extra columns are left out."""
    return bpe.both(df.select("doc_id", "text")).select(
        "doc_id",
        F.expr("CAST(octet_length(ids) DIV 4 AS BIGINT)").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
