"""Language identification by compression.

Each language has a raw-content zstandard dictionary made of its own text. A text is encoded with
each dictionary, and the language whose encoding is smallest is chosen; where the smallest and the
next are closer than ``min_margin`` (as a share of the next), the choice is rejected.

Whole texts are encoded, with case folded, in blocks of ``BLOCK`` bytes so that a long text leans on the
dictionary in each block rather than on its own beginning. Of equal sizes the language with more
training rows comes first, then the alphabetical order.

Null texts and texts without a letter are ``und`` with score 0 and are rejected; with one learned
language the margin is 1. The training sample is bounded: the ``pieces`` distinct texts of a
language with the smallest hashes, of each one piece of ``piece_chars`` characters at a place given by the text's hash.
"""

from __future__ import annotations

from dataclasses import dataclass

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm.common import bounded_batches

UNKNOWN = "und"
BLOCK = 4_096
LEVEL = 6
#: More languages than this are an error: the dictionaries are broadcast.
MAX_LANGUAGES = 1_000
MIN_MARGIN = 0.002
_SHARES = 256


@dataclass
class Model:
    """Dictionaries by language; ``MAX_LANGUAGES * pieces * piece_chars`` characters at most."""

    dictionaries: dict[str, bytes]
    rows: dict[str, int]


def fit(labelled: DataFrame, text: str = "text", lang: str = "lang", pieces: int = 160, piece_chars: int = 400) -> Model:
    """Dictionaries from rows with text and language; other columns are not looked at."""
    rows = labelled.select(F.col(text).alias("t"), F.col(lang).alias("l")).where("t IS NOT NULL AND l IS NOT NULL AND t RLIKE '\\\\p{L}'")
    counts = rows.groupBy("l").agg(F.count(F.lit(1)).alias("n")).limit(MAX_LANGUAGES + 1)
    sizes = {r.l: r.n for r in counts.collect()}
    if len(sizes) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    if not sizes:
        return Model({}, {})
    hashed = rows.withColumn("h", F.xxhash64("t"))
    # copies go before the ranks, so that a language of many rows and few texts keeps all of those
    # the smallest hashes of each share of a language's texts first, so that no task gets all texts of one language
    shares = hashed.select("l", "h", F.pmod("h", F.lit(_SHARES)).alias("s")).distinct()
    first = shares.withColumn("n", F.row_number().over(Window.partitionBy("l", "s").orderBy("h"))).where(F.col("n") <= pieces)
    ranked = first.withColumn("n", F.row_number().over(Window.partitionBy("l").orderBy("h")))
    chosen = ranked.where(F.col("n") <= pieces).select("l", "h")
    place = F.pmod(F.xxhash64("h", F.lit("place")), F.greatest(F.lit(1), F.length("t") - piece_chars + 1)).cast("int") + 1
    first = hashed.join(F.broadcast(chosen), ["l", "h"]).groupBy("l", "h").agg(F.min(F.substring(F.col("t"), place, F.lit(piece_chars))).alias("piece"))
    found: dict[str, list[str]] = {}
    for r in sorted(first.collect(), key=lambda r: (r.l, r.h)):
        found.setdefault(r.l, []).append(r.piece.casefold())
    return Model({k: "\n".join(v).encode() for k, v in found.items()}, sizes)


class Coder:
    """One compressor per language, with its dictionary digested once."""

    def __init__(self, model: Model):
        self.langs, self.coders = sorted(model.dictionaries, key=lambda k: (-model.rows[k], k)), []
        for lang in self.langs:
            held = zstandard.ZstdCompressionDict(model.dictionaries[lang], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            held.precompute_compress(level=LEVEL)
            self.coders.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=held, write_checksum=False, write_content_size=False, write_dict_id=False))

    def sizes(self, text: bytes) -> list[int]:
        blocks = [text[i : i + BLOCK] for i in range(0, len(text), BLOCK)]
        return [sum(len(c.compress(b)) for b in blocks) for c in self.coders]

    def predict(self, text: str | None) -> tuple[str, float]:
        """Language and margin; the margin is also the score."""
        if not self.langs or text is None or not any(map(str.isalpha, text)):
            return UNKNOWN, 0.0
        sizes = self.sizes(text.casefold().encode())
        best = min(range(len(sizes)), key=sizes.__getitem__)
        rest = min((s for i, s in enumerate(sizes) if i != best), default=None)
        return self.langs[best], 1.0 if rest is None else (rest - sizes[best]) / rest


def classify(df: DataFrame, model: Model, text: str = "text", min_margin: float = MIN_MARGIN) -> DataFrame:
    """``df`` with ``lang_pred``, ``score`` (the margin, 0 to 1) and ``accepted``; columns of these names in ``df`` are replaced, any others stay."""
    bounded_batches(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(model)
    held: list[Coder] = []

    @F.arrow_udf("struct<lang_pred: string, score: double>")
    def predicted(texts: pa.Array) -> pa.Array:
        if not held:
            held.append(Coder(shared.value))
        found = [held[0].predict(t) for t in texts.to_pylist()]
        return pa.StructArray.from_arrays([pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], names=["lang_pred", "score"])

    told = predicted(F.col(text))
    # a row's columns travel as one struct, so that none can clash with the prediction
    named = df.select(F.struct(*df.columns).alias("row"), told.alias("told"))
    pred, score = F.col("told.lang_pred"), F.col("told.score")
    own = [F.col("row")[c].alias(c) for c in df.columns if c not in ("lang_pred", "score", "accepted")]
    return named.select(*own, pred.alias("lang_pred"), score.alias("score"), ((pred != UNKNOWN) & (score >= min_margin)).alias("accepted"))
