"""Personal data: fixed rules as seeds, and bootstrapped contextual extraction on top.

Rules find e-mail addresses, IP addresses, card and telephone numbers. Their matches, with long
hexadecimal keys as a fifth kind (``secret``), are the seeds. Instances are identifier-like spans: tokens of at least
``MIN_DIGITS`` digits and ``MIN_LENGTH`` characters, however long; tokens around an @ with or without digits; numbers written in
groups (``GROUP_DIGITS`` digits in all). They are found in lexical patterns: the two lexical units before,
with and without the unit after. Spark scores the pattern-instance graph: a pattern's confidence for a kind is
the summed score of its instances over their number (smoothed), an instance's score is 1 for a seed
and else the best confidence of its patterns. After ``ROUNDS`` rounds each pattern with enough
support and confidence marks the tokens it surrounds, known before or not.

Rule matches always stay; marked tokens never overlap them. Offsets are code points, ends exclusive.
Null and empty texts give no spans. Repeated rows each give a row. The graph holds hashes, not identifiers.
At a text's beginning the beginning itself takes the place of the units before. Names and other identifiers without digits or @ are found by the rules alone.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import Scratch

KINDS = ("email", "ip", "card", "phone", "secret")
ROUNDS = 3
MIN_LENGTH, MIN_DIGITS = 6, 4
GROUP_DIGITS = range(7, 20)
MIN_SUPPORT = 3.0
MIN_CONFIDENCE = 0.8

_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGITS = re.compile(r"[0-9]+")
_AT = re.compile("@")
_SECRET = re.compile(r"(?=[0-9]*[a-f])(?=[a-f]*[0-9])[0-9a-f]{32,}")
#: Two to five digits a group, with one or two marks between; a longer run is a token of its own.
_GROUPED = re.compile(r"(?<![\w.@+-])\(?[0-9]{2,5}(?:\)?[ ./-][ ./(-]?[0-9]{2,5})+(?![\w@])")
_TOKEN_CHARS = frozenset(_LOCAL + "@")
_UNITS = re.compile(r"[^\W\d_]+|[^\w\s]|\d+|_")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Each @ with a local part before it, bounded by the match and the @ before, and a dotted domain behind it."""
    floor, at = 0, text.find("@")
    while at >= 0:
        before = text[floor:at]
        start = floor + len(before.rstrip(_LOCAL))
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
        floor = m.end() if m else at + 1
        at = text.find("@", floor)


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def rule_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind's number, start, end) by kind, then start."""
    found = [(0, s, e) for s, e in _emails(text)]
    for m in _IP.finditer(text):
        if all(len(p := g.lstrip("0")) <= 3 and int(p or 0) <= 255 for g in m.groups()):
            found.append((1, *m.span()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16 and 16 <= len(d := re.sub("[ -]", "", m.group())) <= 19 and _luhn(d):
            found.append((2, *m.span()))
    for m in _PHONE.finditer(text):
        if 8 <= sum(c.isdigit() for c in m.group()) <= 15:
            found.append((3, *m.span()))
    return found


def _runs(text: str, marks: Iterator[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    """The token around each mark, once each, without punctuation at its ends."""
    reach = 0
    for s, e in marks:
        if s < reach:
            continue
        while s > reach and text[s - 1] in _TOKEN_CHARS:
            s -= 1
        while e < len(text) and text[e] in _TOKEN_CHARS:
            e += 1
        reach = e
        token = text[s:e].strip(".-%+@")
        s = text.index(token, s) if token else s
        yield s, s + len(token)


def _digits(text: str, s: int, e: int) -> int:
    return sum(c.isdigit() for c in text[s:e])


def tokens(text: str, taken: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """Identifier-like spans, in order, that overlap no span of ``taken`` nor each other; a token goes before a number in groups."""
    found = {(s, e) for s, e in _runs(text, (m.span() for m in _DIGITS.finditer(text))) if e - s >= MIN_LENGTH and _digits(text, s, e) >= MIN_DIGITS}
    if "@" in text:
        found |= {(s, e) for s, e in _runs(text, (m.span() for m in _AT.finditer(text))) if e - s >= MIN_LENGTH and "@" in text[s:e]}
    grouped = [m.span() for m in _GROUPED.finditer(text) if _digits(text, *m.span()) in GROUP_DIGITS]
    out = _apart(sorted(found), sorted((s, e) for _, s, e in taken))
    return sorted(out + _apart(grouped, sorted([(s, e) for _, s, e in taken] + out))) if grouped else out


def _apart(spans: list[tuple[int, int]], others: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Those of the sorted spans that overlap none of the sorted others nor the one kept before."""
    out, k, last, reach = [], 0, 0, 0
    for s, e in spans:
        while k < len(others) and others[k][0] < e:
            reach = max(reach, others[k][1])
            k += 1
        if reach <= s and last <= s:
            out.append((s, e))
            last = e
    return out


def _before(text: str, start: int) -> list[str]:
    """The two lexical units before a place; the text's beginning stands for those that are not there."""
    reach = 64
    while True:
        low = max(0, start - reach)
        units = _UNITS.findall(text[low:start])
        if low == 0:
            return ["\x02", "\x02", *units][-2:]
        if len(units) > 2:  # the first may be cut
            return units[-2:]
        reach *= 4


def contexts(text: str, start: int, end: int) -> list[int]:
    """Hashes of the patterns around a span."""
    left = "\x1f".join(_before(text, start)).lower()
    after = _UNITS.findall(text[end : end + 32])[:1]
    return [_hash(left), _hash(left + "\x1e" + "".join(after).lower())]


def _hash(s: str) -> int:
    return xxhash.xxh64_intdigest(s) - (1 << 63)


_SCAN = "doc_id bigint, base array<struct<k: int, s: int, e: int>>, seen array<struct<k: int, s: int, e: int, inst: bigint, pats: array<bigint>>>"


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    span = pa.struct([("k", pa.int32()), ("s", pa.int32()), ("e", pa.int32())])
    seen_type = pa.list_(pa.struct([*span, ("inst", pa.int64()), ("pats", pa.list_(pa.int64()))]))
    for batch in batches:
        base, seen = [], []
        for text in batch.column("text").to_pylist():
            text = text or ""
            spans = rule_spans(text)
            base.append([{"k": k, "s": s, "e": e} for k, s, e in spans])
            more = [(4 if _SECRET.fullmatch(text, s, e) else None, s, e) for s, e in tokens(text, spans)]
            seen.append([{"k": k, "s": s, "e": e, "inst": _hash(text[s:e].lower()), "pats": pats} for k, s, e in [*spans, *more] if (pats := contexts(text, s, e))])
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(base, pa.list_(span)), pa.array(seen, seen_type)], names=["doc_id", "base", "seen"])


def confident_patterns(edges: DataFrame, rounds: int = ROUNDS, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """(pat, kind, conf) of the patterns that stay, one kind per pattern, from distinct (pat, inst, seed kind or null)."""
    sizes = edges.groupBy("pat").agg(F.countDistinct("inst").alias("n"))
    scores = edges.where("k IS NOT NULL").groupBy("inst").agg(F.min("k").alias("kind")).withColumn("score", F.lit(1.0))
    seeds, pairs, kept = scores, edges.select("pat", "inst").distinct(), None
    for _ in range(rounds):
        summed = pairs.join(scores, "inst").groupBy("pat", "kind").agg(F.sum("score").alias("sum"))
        rated = summed.where(F.col("sum") >= min_support).join(sizes, "pat").withColumn("conf", F.col("sum") / (F.col("n") + 0.5)).where(F.col("conf") >= min_confidence)
        kept = rated.groupBy("pat").agg(F.max_by("kind", F.struct("conf", -F.col("kind"))).alias("kind"), F.max("conf").alias("conf"))
        spread = pairs.join(kept, "pat").groupBy("inst").agg(F.max_by("kind", F.struct("conf", -F.col("kind"))).alias("kind"), F.max("conf").alias("score"))
        scores = seeds.unionByName(spread.join(seeds, "inst", "left_anti"))
    return kept


def extract(df: DataFrame, scratch: Scratch) -> DataFrame:
    """One row per row of ``df``: doc_id, ``base`` and ``spans`` as arrays of (k, s, e), k the kind's number."""
    scanned = df.select("doc_id", "text").mapInArrow(_scan, _SCAN).withColumn("uid", F.monotonically_increasing_id())
    rows = scratch.save(scanned, "scanned")
    seen = rows.select("uid", F.explode("seen").alias("x")).select("uid", "x.*")
    edges = scratch.save(seen.select(F.explode("pats").alias("pat"), "inst", "k").distinct(), "edges")
    patterns = scratch.save(confident_patterns(edges), "patterns")
    open_tokens = seen.where("k IS NULL OR k = 4").select("uid", "s", "e", F.explode("pats").alias("pat"))
    marked = open_tokens.join(patterns, "pat").groupBy("uid", "s", "e").agg(F.max_by("kind", F.struct("conf", -F.col("kind"))).alias("k"))
    added = marked.groupBy("uid").agg(F.collect_list(F.struct("k", "s", "e")).alias("added"))
    all_spans = F.array_sort(F.concat("base", F.coalesce("added", F.expr("CAST(array() AS array<struct<k: int, s: int, e: int>>)"))))
    return rows.select("uid", "doc_id", "base").join(added, "uid", "left").select("doc_id", "base", all_spans.alias("spans"))


def _listed(spans: str) -> F.Column:
    names = F.array(*map(F.lit, KINDS))
    return F.concat_ws(",", F.transform(spans, lambda x: F.concat_ws(":", F.element_at(names, x.k + 1), x.s, x.e)))


def digests(df: DataFrame, scratch: Scratch) -> DataFrame:
    """Per document: rule matches by kind, their digest, and all spans as text."""
    found = extract(df, scratch)
    counts = [F.expr(f"CAST(size(filter(base, x -> x.k = {i})) AS BIGINT)").alias(f"n_{kind}") for i, kind in enumerate(KINDS[:4])]
    return found.select("doc_id", *counts, F.sha2(_listed("base"), 256).alias("base_sha256"), _listed("spans").alias("spans"))
