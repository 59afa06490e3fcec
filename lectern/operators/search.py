"""Search-side operators: exclusion lists, literal matching, scoring and best hit per group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.text import fuzzy_score, phrase_key, phrase_key_of


def exclude(hits: DataFrame, superseded: DataFrame, key: str) -> DataFrame:
    """Hits whose key is not in ``superseded``; applied before paging so that totals stay right."""
    return hits.join(superseded.select(key).distinct(), key, "left_anti")


def occurrences(text: Column, term: str) -> Column:
    """Non-overlapping occurrences of a literal term; 0 for a blank term or null text."""
    if not term:
        return F.lit(0)
    return F.coalesce((F.length(text) - F.length(F.replace(text, F.lit(term)))) / F.lit(len(term)), F.lit(0)).cast("int")


def best_per_group(hits: DataFrame, group: str, order: list[Column]) -> DataFrame:
    """The first row of each group by ``order``; rows whose group is null are all kept."""
    ranked = hits.where(F.col(group).isNotNull()).withColumn("_rn", F.row_number().over(Window.partitionBy(group).orderBy(*order)))
    return ranked.where("_rn = 1").drop("_rn").unionByName(hits.where(F.col(group).isNull()))


def latest_state(changes: DataFrame, key: str = "logical_id", version: str = "version", seq: str = "seq") -> DataFrame:
    """Per key the row of the highest version; of equal versions the last seen by ``seq``."""
    rest = [c for c in changes.columns if c != key]
    best = changes.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(version, seq)).alias("_best"))
    return best.select(key, *[F.col(f"_best.{c}").alias(c) for c in rest])


def overlay_merge(base: DataFrame, delta: DataFrame, state: DataFrame, key: str = "logical_id") -> DataFrame:
    """Hits of both sides merged: a key's current version alone, no deleted keys, one hit per key.

    The winner of a key has the highest version, then score, then comes first (delta before base, then ``seq``). Hits
    without a key are all kept; a key without state is live in each version.
    """
    both = delta.withColumn("side", F.lit(0)).unionByName(base.withColumn("side", F.lit(1)))
    known = state.select(F.col(key).alias("_key"), F.col("version").alias("_version"), F.col("deleted").alias("_deleted"))
    live = both.join(known, F.col(key) == F.col("_key"), "left").where("_key IS NULL OR (NOT _deleted AND version >= _version)").drop("_key", "_version", "_deleted")
    order = Window.partitionBy(key).orderBy(F.desc("version"), F.desc("score"), "side", "seq")
    named = live.where(F.col(key).isNotNull()).withColumn("_rn", F.row_number().over(order)).where("_rn = 1").drop("_rn")
    return named.unionByName(live.where(F.col(key).isNull()))


def in_dates(column: Column, start: str | None, end: str | None) -> Column:
    """Inclusive range that holds only where both bounds are given."""
    return column.between(start, end) if start and end else F.lit(True)


def wildcard(text: str) -> str:
    """A regular expression for a quoted query: * and ? are wildcards, all else is literal."""
    import re

    return "".join({"*": "(?s:.*)", "?": "(?s:.)"}.get(c, re.escape(c)) for c in text)


def is_quoted_only(query: str) -> bool:
    q = query.strip().replace("“", '"').replace("”", '"')
    return len(q) > 2 and q[0] == q[-1] == '"' and '"' not in q[1:-1]


def keyword_condition(query: str, *fields: Column) -> Column:
    """A boolean keyword query as one condition: AND, OR, NOT, brackets, quoted phrases; words side by side mean OR.

    Terms match case-insensitively as substrings of any field. NOT binds most, then AND, then OR.
    """
    import re

    words = re.findall(r'"[^"]*"|[()]|[^\s()"]+', query.replace("“", '"').replace("”", '"'))
    at = 0

    def term(word: str) -> Column:
        needle = word.strip('"').lower()
        found = F.lit(False)
        for f in fields:
            found = found | F.coalesce(F.contains(F.lower(f), F.lit(needle)), F.lit(False))
        return found

    def unary() -> Column:
        nonlocal at
        word = words[at] if at < len(words) else '""'
        at += 1
        if word.upper() == "NOT":
            return ~unary()
        if word == "(":
            inner = either()
            if at < len(words):
                at += 1
            return inner
        return term(word)

    def both() -> Column:
        nonlocal at
        left = unary()
        while at < len(words) and words[at].upper() == "AND":
            at += 1
            left = left & unary()
        return left

    def either() -> Column:
        nonlocal at
        left = both()
        while at < len(words) and words[at] != ")":
            if words[at].upper() == "OR":
                at += 1
            left = left | both()
        return left

    return either() if words else F.lit(True)


def multi_match(tokens: list[str], boosts: list[tuple[Column, float]], phrase: str | None = None, phrase_boost: float = 8.0) -> Column:
    """Score of the best field that holds all tokens, plus a boost where a field holds the phrase; null for no match."""
    best = F.greatest(*[F.when(_all_in(c, tokens), F.lit(b)).otherwise(F.lit(0.0)) for c, b in [*boosts, (F.lit(None).cast("string"), 0.0)]])
    extra = F.lit(0.0)
    if phrase:
        held = F.lit(False)
        for c, _ in boosts:
            held = held | F.coalesce(F.contains(F.lower(c), F.lit(phrase.lower())), F.lit(False))
        extra = F.when(held, F.lit(phrase_boost)).otherwise(F.lit(0.0))
    return F.when(best > 0, best + extra)


def _all_in(column: Column, tokens: list[str]) -> Column:
    held = F.lit(True)
    for t in tokens:
        held = held & F.coalesce(F.contains(F.lower(column), F.lit(t.lower())), F.lit(False))
    return held


def page(hits: DataFrame, order: list[Column], number: int, size: int, window: int = 10_000, largest: int = 50) -> DataFrame:
    """A page of ordered hits; pages start at 1 and must end within the result window."""
    if number < 1 or not 1 <= size <= largest or number * size > window:
        raise ValueError("page out of range")
    return hits.orderBy(*order).offset((number - 1) * size).limit(size)


def hit_rows(hits: DataFrame, key: str, internal: tuple[str, ...] = (), fields: tuple[str, ...] = ("title", "content"), score: str | None = None) -> DataFrame:
    """Hits as they are shown: internal columns gone, ``documentId`` from the key, each of ``fields`` replaced by its first highlight, no score as 0.

    hits may have ``highlight``, a struct of arrays by field; fields and highlights that are not there don't matter.
    """
    lit_up = hits.schema["highlight"].dataType.fieldNames() if "highlight" in hits.columns else []
    shown = []
    for c in hits.columns:
        if c in (*internal, key, "highlight"):
            continue
        value = F.col(c)
        if c in fields and c in lit_up:
            value = F.coalesce(F.try_element_at(F.col("highlight")[c], F.lit(1)), value)
        shown.append((F.coalesce(value, F.lit(0.0)) if c == score else value).alias(c))
    return hits.select(F.col(key).alias("documentId"), *shown)


def listed(hits: DataFrame, fields: list[str]) -> DataFrame:
    """The columns of a list of fields that hits have, in the list's order."""
    return hits.select(*[c for c in fields if c in hits.columns])


def overlay_page(base: DataFrame, delta: DataFrame, state: DataFrame, order: list[Column], number: int, size: int, factor: int = 5, most: int = 500) -> DataFrame:
    """A page of both sides merged, with ``total``: the merged hits among the first fetched of each side, so an approximation.

    Each side gives its first ``number * size * factor`` hits by ``order``, at most ``most``; what is merged is bounded by that.
    """
    if number < 1 or size < 1:
        raise ValueError("page out of range")
    fetch = min(max(number * size * factor, size), most)
    merged = overlay_merge(base.orderBy(*order).limit(fetch), delta.orderBy(*order).limit(fetch), state)
    total = merged.agg(F.count(F.lit(1)).alias("total"))
    return merged.orderBy(*order).offset((number - 1) * size).limit(size).join(F.broadcast(total), F.lit(True))


def in_book(blocks: DataFrame, order: list[Column], text: str, query: str, size: int = 30) -> DataFrame:
    """The first blocks in the book's order whose text holds the query, both normalised and lower-cased; none for a blank query."""
    key = phrase_key_of(query)
    return blocks.where((key != "") & F.contains(phrase_key(F.col(text)), key)).orderBy(*order).limit(size)


def closest_titles(books: DataFrame, title: str, query: str, tie: str, k: int = 6) -> DataFrame:
    """The k books whose titles fit the query best, with ``score``; none for a blank query. Equal scores come by ``tie``."""
    scored = books.withColumn("score", fuzzy_score(F.col(title), query)).where("score IS NOT NULL")
    return scored.where(F.lit(bool(query.strip()))).orderBy("score", tie).limit(k)


def term_totals(chapters: DataFrame, text: str, terms: list[str], most: int = 12) -> DataFrame:
    """(term, total): occurrences of each of the first ``most`` distinct terms over all chapters; one pass, whatever the terms."""
    kept = list(dict.fromkeys(t.strip() for t in terms if t.strip()))[:most]
    if not kept:
        raise ValueError("no term is given")
    sums = chapters.agg(*[F.coalesce(F.sum(occurrences(F.col(text), t).cast("bigint")), F.lit(0)).alias(f"t{i}") for i, t in enumerate(kept)])
    pairs = F.array(*[F.struct(F.lit(t).alias("term"), F.col(f"t{i}").alias("total")) for i, t in enumerate(kept)])
    return sums.select(F.inline(pairs))


def distinct_targets(hits: DataFrame, target: str, order: list[Column], size: int = 8) -> DataFrame:
    """Best hit per target (hits without target are all kept), first ``size`` (blank: 8, 1 to 20)."""
    return best_per_group(hits, target, order).orderBy(*order).limit(min(max(size or 8, 1), 20))


def with_fallback(matched: DataFrame, everything: DataFrame, order: list[Column], k: int) -> DataFrame:
    """The first k matches, or the first k of everything if nothing matches. The matches, k at most, are found once."""
    k = min(max(k, 1), 12)
    found = matched.orderBy(*order).limit(k).withColumn("_own", F.lit(True))
    both = found.unionByName(everything.orderBy(*order).limit(k).withColumn("_own", F.lit(False)))
    any_own = F.max("_own").over(Window.partitionBy(F.lit(0)))  # 2k rows
    return both.withColumn("_any", any_own).where(F.col("_own") == F.col("_any")).drop("_own", "_any")


def search_condition(
    query: str, title: Column, content: Column, source: tuple[Column, str] | None = None, dates: tuple[Column, str | None, str | None] | None = None, strict_reference: bool = False
) -> Column:
    """One condition for a search of title and content, within a ``source`` (column, value) and ``dates`` (column, first, last).

    A query that is one quoted text matches it with its wildcards, within the case of its letters, if there is no source; with a source it is a phrase like any other. Dates
    hold for every query; with ``strict_reference`` a quoted text alone is searched in all dates.
    """
    held = F.lit(True) if dates is None else in_dates(*dates)
    if source is None and is_quoted_only(query):
        text = wildcard(query.strip()[1:-1])
        found = F.coalesce(title.rlike(text), F.lit(False)) | F.coalesce(content.rlike(text), F.lit(False))
        return found if strict_reference else found & held
    found = keyword_condition(query, title, content) & held
    return found if source is None else found & (source[0] == source[1])
