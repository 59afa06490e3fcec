"""Items and their parts: visibility, scopes, links, assets, names, import rules."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.text import phrase_key


def between_issues(issues: DataFrame, issue: str, first: str | None, last: str | None) -> DataFrame:
    """Distinct issues from ``first`` to ``last`` (each may be open), sorted; a first after the last is an error."""
    if first and last and first > last:
        raise ValueError("the first issue comes after the last")
    some = issues.select(issue).distinct()
    some = some.where(F.col(issue) >= first) if first else some
    return (some.where(F.col(issue) <= last) if last else some).orderBy(issue)


def visible(rows: DataFrame, status: str = "status") -> DataFrame:
    """All but drafts; a missing status is visible."""
    return rows.where(F.coalesce(F.col(status), F.lit("")) != "draft")


def within_scope(rows: DataFrame, dataset: str, objects: str, allowed: DataFrame | None = None, item: str = "item_id") -> DataFrame:
    """Rows whose object lies below the dataset's folder and, with ``allowed``, whose item is on that list."""
    own = rows.where(F.col(objects).startswith(f"datasets/{dataset}/"))
    return own if allowed is None else own.join(allowed.select(item).distinct(), item, "left_semi")


def permitted_asset(url: Column, hosts: list[str]) -> Column:
    """Base64 media data, or https from one of the hosts or below it."""
    host = F.lower(F.regexp_extract(url, r"^https://([^/:?#]+)", 1))
    on_list = reduce(lambda a, b: a | b, [(host == h) | host.endswith(f".{h}") for h in hosts], F.lit(False))
    return url.rlike(r"^data:(image|audio|video)/[\w.+-]+;base64,") | on_list


def title_filter(rows: DataFrame, title: str, query: str) -> DataFrame:
    """Rows whose title holds the query, both in normal form and lower case; all rows for a blank query."""
    return rows if not query.strip() else rows.where(F.contains(phrase_key(F.col(title)), phrase_key(F.lit(query))))


def chapter_count(toc: DataFrame, item: str, title: str, pattern: str) -> DataFrame:
    """(item, n): top-level entries that look like chapters; null for none."""
    return toc.where("depth = 0").groupBy(item).agg(F.nullif(F.count_if(F.col(title).rlike(pattern)), F.lit(0)).alias("n"))


def spine(refs: DataFrame, manifest: DataFrame) -> DataFrame:
    """refs(book, pos, idref) with what manifest(book, id, href) has, in order of the spine; unknown refs go."""
    return refs.join(manifest.withColumnRenamed("id", "idref"), ["book", "idref"]).orderBy("book", "pos")


def resolve_links(links: DataFrame, files: DataFrame, anchors: DataFrame) -> DataFrame:
    """links(book, file, anchor) with ``state``: ok, no_file, no_anchor, or unreadable where nothing is linked."""
    f = files.select("book", "file").distinct().withColumn("_f", F.lit(True))
    a = anchors.select("book", "file", "anchor").distinct().withColumn("_a", F.lit(True))
    both = links.join(f, ["book", "file"], "left").join(a, ["book", "file", "anchor"], "left")
    empty = (F.coalesce("file", F.lit("")) == "") & (F.coalesce("anchor", F.lit("")) == "")
    state = F.when(empty, "unreadable").when(F.col("_f").isNull(), "no_file").when((F.coalesce("anchor", F.lit("")) != "") & F.col("_a").isNull(), "no_anchor").otherwise("ok")
    return both.withColumn("state", state).drop("_f", "_a")


def with_lookup(rows: DataFrame, names: DataFrame, key: str, value: str, default: str) -> DataFrame:
    return rows.join(names.select(key, value), key, "left").withColumn(value, F.coalesce(value, F.lit(default)))


def stage(mapped: DataFrame, existing: DataFrame, key: str) -> DataFrame:
    """``mapped`` with ``action``: new, or skipped where the key is there already."""
    return mapped.join(existing.select(key).distinct().withColumn("_e", F.lit(True)), key, "left").withColumn("action", F.when(F.col("_e"), "skipped").otherwise("new")).drop("_e")


def used_assets(chapters: DataFrame, assets: DataFrame) -> DataFrame:
    """Assets(asset_id, role) that a chapter(assetRefs) names, and all covers."""
    refs = chapters.select(F.explode("assetRefs").alias("asset_id")).distinct()
    return assets.where(F.col("role") != "cover").join(refs, "asset_id", "left_semi").unionByName(assets.where("role = 'cover'"))


def replaced(rows: DataFrame, again: DataFrame, key: str) -> DataFrame:
    """Rows, with those matched again by key in their new form."""
    both = rows.alias("o").join(again.withColumn("_new", F.lit(True)).alias("n"), key, "left")
    return both.select(key, *[F.when(F.col("n._new"), F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c) for c in rows.columns if c != key])


def append_page(shown: DataFrame, page: DataFrame, key: str = "id") -> DataFrame:
    """Rows shown and those of the next page that aren't among them."""
    return shown.unionByName(page.join(shown.select(key), key, "left_anti").select(*shown.columns))


def quotas(names: DataFrame, kind: str, name: str, short: int, n_short: int, n_long: int) -> DataFrame:
    """Per kind the first ``n_short`` names of up to ``short`` characters and ``n_long`` longer ones, by SHA-256; names once each.

    A name in several kinds stays with the first kind. Kinds with too few names are an error of ``shortages``.
    """
    once = names.groupBy(name).agg(F.min(kind).alias(kind)).withColumn("stratum", F.when(F.length(name) <= short, "short").otherwise("long"))
    rank = F.row_number().over(Window.partitionBy(kind, "stratum").orderBy(F.sha2(name, 256)))
    return once.withColumn("_n", rank).where(F.col("_n") <= F.when(F.col("stratum") == "short", n_short).otherwise(n_long)).drop("_n")


def shortages(chosen: DataFrame, kind: str, n_short: int, n_long: int) -> DataFrame:
    counts = chosen.groupBy(kind).agg(F.count_if(F.col("stratum") == "short").alias("short"), F.count_if(F.col("stratum") == "long").alias("long"))
    return counts.where((F.col("short") < n_short) | (F.col("long") < n_long))


def merge_spine(spine_rows: DataFrame, book: str, pos: str) -> DataFrame:
    """``part``: for books cut into very many small files, all files from one navigation target to before the next.

    spine_rows(book, pos, is_target, chars). Merged only with 24 files and 2 targets at least, 3 files a target, and a median under 1,200 characters.
    """
    stats = spine_rows.groupBy(book).agg(F.count(F.lit(1)).alias("n"), F.count_if("is_target").alias("t"), F.median("chars").alias("m"))
    small = stats.select(book, ((F.col("n") >= 24) & (F.col("t") >= 2) & (F.col("n") >= 3 * F.col("t")) & (F.col("m") < 1200)).alias("_merge"))
    w = Window.partitionBy(book).orderBy(pos).rowsBetween(Window.unboundedPreceding, 0)
    start = F.coalesce(F.max(F.when(F.col("is_target"), F.col(pos))).over(w), F.min(pos).over(w))
    return spine_rows.join(small, book).withColumn("part", F.when(F.col("_merge"), start).otherwise(F.col(pos))).drop("_merge")


def import_gate(found: DataFrame, allow_partial: bool) -> DataFrame:
    """(item, code, level): a warning where partial items are allowed, else a rejection.

    found(item, truncated_toc, missing_chapters, decode_failures, unresolved_links).
    """
    checks = {"truncated_toc": F.col("truncated_toc"), "missing_chapters": F.col("missing_chapters") > 0, "decode_failures": F.col("decode_failures") > 0, "unresolved_links": F.col("unresolved_links") > 0}
    codes = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(k)) for k, c in checks.items()]))
    return found.select("item", F.explode(codes).alias("code")).withColumn("level", F.lit("warning" if allow_partial else "reject"))


def of_version(rows: DataFrame, version: str, legacy: tuple[str, ...] = (), column: str = "formatVersion") -> tuple[DataFrame, DataFrame]:
    """(rows of the version, with legacy labels brought up to it; rows of any other)."""
    ok = F.coalesce(F.col(column).isin(version, *legacy), F.lit(False))
    return rows.where(ok).withColumn(column, F.lit(version)), rows.where(~ok)


def unique_names(users: DataFrame, pool: DataFrame, taken: DataFrame) -> DataFrame:
    """(user_id, name): free names dealt to users in order of hashes; users beyond the pool get a hash at the end of their name.

    Both sides are numbered within hash ranges and met on (range, number), so no single task orders all.
    """
    free = pool.select("name").distinct().join(taken.select("name"), "name", "left_anti")
    part = lambda c: F.pmod(F.xxhash64(c), F.lit(1024))
    number = lambda c: F.row_number().over(Window.partitionBy("_p").orderBy(F.sha2(c, 256)))
    n = free.withColumn("_p", part("name")).withColumn("_n", number(F.col("name")))
    u = users.select("user_id").distinct().withColumn("_p", part("user_id")).withColumn("_n", number(F.col("user_id").cast("string")))
    spare = F.concat(F.lit("reader-"), F.substring(F.sha2(F.col("user_id").cast("string"), 256), 1, 16))
    return u.join(n, ["_p", "_n"], "left").select("user_id", F.coalesce("name", spare).alias("name"))


def rotate_invitations(personal: DataFrame, now: Column, days: int = 7) -> DataFrame:
    """Each owner's invitation after a request: blocked if disabled or used up, kept if not expired, else with a new end and ``rotated``."""
    blocked = F.col("disabled_at").isNotNull() | (F.col("use_count") >= F.coalesce("max_uses", F.lit(2**31 - 1)))
    live = F.col("expires_at").isNull() | (F.col("expires_at") > now)
    action = F.when(blocked, "blocked").when(live, "reused").otherwise("rotated")
    return personal.withColumn("action", action).withColumn("expires_at", F.when(F.col("action") == "rotated", now + F.expr(f"INTERVAL {days} DAYS")).otherwise(F.col("expires_at")))


#: Levels of headings that are told apart; deeper ones count as the last.
LEVELS = 6


def nth_note(notes: DataFrame, blocks: DataFrame, group: str) -> DataFrame:
    """``block`` of each note(group, heading, label): the label-th marker between the heading and the next of its level or above, else null.

    blocks(group, ord, level or null, markers): a heading has a level; markers in headings don't count. Markers are numbered through a
    group, so a note asks for one number and nothing is paired with all that follows it.
    """
    up = Window.partitionBy(group).orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    after = Window.partitionBy(group).orderBy(F.desc("ord")).rowsBetween(Window.unboundedPreceding, -1)
    level = F.greatest(F.lit(1), F.least(F.lit(LEVELS), F.col("level")))
    own = F.when(F.col("level").isNull(), F.greatest(F.coalesce("markers", F.lit(0)), F.lit(0))).otherwise(0)
    placed = blocks.select(group, "ord", level.alias("level"), own.alias("_m")).withColumn("_c", F.sum("_m").over(up))
    ends = F.array(*[F.min(F.when(F.col("level") <= k, F.col("ord"))).over(after) for k in range(1, LEVELS + 1)])
    heads = placed.withColumn("_ends", ends).where("level IS NOT NULL").select(group, F.col("ord").alias("heading"), F.element_at("_ends", F.col("level").cast("int")).alias("_end"), F.col("_c").alias("_base"))
    marked = placed.where("_m > 0").select(group, F.col("ord").alias("block"), F.explode(F.sequence(F.col("_c") - F.col("_m") + 1, F.col("_c"))).alias("_k"))
    asked = notes.join(heads, [group, "heading"], "left").withColumn("_k", F.when(F.col("label") >= 1, F.col("_base") + F.col("label")))
    found = asked.join(marked, [group, "_k"], "left")
    inside = F.col("_end").isNull() | (F.col("block") < F.col("_end"))
    return found.select(*notes.columns, F.when(inside, F.col("block")).alias("block"))
