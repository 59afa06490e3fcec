"""Ids of titles by how they are read: phrases of a table of readings, the longest first."""

from __future__ import annotations

import hashlib
import re
import unicodedata

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Entries that a table of readings may have: it is sent to every task.
MOST_READINGS = 1_000_000
#: The longest id, what is left of a longer one, and digits of its hash; the front of an id of nothing readable, and its digits.
LONGEST, CUT, TAIL, NAMELESS, NAMELESS_TAIL = 80, 71, 8, "book-", 12


class Readings:
    """A trie of phrases, each with its reading in syllables; a phrase given twice has the reading of the smallest rank."""

    def __init__(self, rows: list[tuple[str, str]]):
        self.root: dict = {}
        for phrase, reading in rows:
            node = self.root
            for c in phrase:
                node = node.setdefault(c, {})
            node.setdefault("", reading.lower().split())

    def read(self, text: str) -> list[str]:
        """Syllables of known phrases, the longest at each place, and runs of what is not known between them."""
        out, run, i = [], "", 0
        while i < len(text):
            node, k, best = self.root, i, None
            while k < len(text) and (node := node.get(text[k])) is not None:
                k += 1
                if "" in node:
                    best = (k, node[""])
            if best is None:
                run, i = run + text[i], i + 1
                continue
            out += [run] if run else []
            run, i = "", best[0]
            out += best[1]
        return out + ([run] if run else [])

    def title_id(self, title: str) -> str:
        """Lower-case syllables joined by -; long ids are cut and end in a hash, ids of nothing readable are a hash alone."""
        title = " ".join(unicodedata.normalize("NFKC", title).split())
        slug = re.sub(r"[^a-z0-9]+", "-", "-".join(self.read(title)).lower()).strip("-")
        digest = hashlib.sha256(title.encode()).hexdigest()
        if not slug:
            return NAMELESS + digest[:NAMELESS_TAIL]
        return slug if len(slug) <= LONGEST else f"{slug[:CUT].rstrip('-')}-{digest[:TAIL]}"


def title_ids(readings: DataFrame):
    """A function of a title column by readings(phrase, reading, rank); null titles are null. The table is read once, here; one of too many entries is an error."""
    rows = readings.where("phrase <> '' AND trim(reading) <> ''").select("phrase", "reading", "rank").orderBy("rank", "reading").limit(MOST_READINGS + 1).toArrow()
    if rows.num_rows > MOST_READINGS:
        raise ValueError(f"more than {MOST_READINGS} readings")
    shared = readings.sparkSession.sparkContext.broadcast(list(zip(rows["phrase"].to_pylist(), rows["reading"].to_pylist(), strict=True)))
    held: dict[str, Readings] = {}

    @F.arrow_udf(StringType())
    def ids(titles: pa.Array) -> pa.Array:
        if not held:
            held["trie"] = Readings(shared.value)
        return pa.array([None if t is None else held["trie"].title_id(t) for t in titles.to_pylist()], pa.string())

    def of(title: Column | str) -> Column:
        return ids(title)

    return of
