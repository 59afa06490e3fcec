"""What the book writer takes: chapters of a catalogue with links, files and notes put in place, and chapters of block projects."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from lectern.sources.bookfiles import escape

_ATTRIBUTE = re.compile(r"""\s+([\w:-]+)=(?:"([^"]*)"|'([^']*)')""")
_TAG = re.compile(r"""<a\b((?:\s+[\w:-]+=(?:"[^"]*"|'[^']*'))*)\s*>""", re.I)
_FIGURE = re.compile(r"<figure\b([^>]*)>(.*?)</figure>", re.I | re.S)
_INLINE = re.compile(r"<span\b([^>]*\bdata-asset-id=[^>]*)></span>", re.I)
_CAPTION = re.compile(r"<figcaption>(.*?)</figcaption>", re.I | re.S)
_NOTE = re.compile(r"""<sup\s+data-annotation-id=["']([^"']*)["']\s*></sup>""", re.I)
#: Roles that a figure keeps; alternative texts of roles; how a note without a label is marked.
ROLES = ("signature", "cover", "full-width", "table-image")
ALT = {"cover": "封面", "table-image": "表格"}
UNLABELLED = "注"


def _attributes(tag: str) -> dict[str, str]:
    return {m[1].lower(): m[2] if m[2] is not None else m[3] for m in _ATTRIBUTE.finditer(tag)}


def chapter_body(body: str, own: str, names: dict[str, str], assets: dict[str, dict], notes: list[dict]) -> str:
    """A chapter's body for a book of files: links to known chapters by file, images by path, notes at its end.

    ``names``: the files of linked chapters by id. Links to unknown chapters and images of unknown assets stay as they are.
    """

    def link(m: re.Match) -> str:
        told = _attributes(m[1])
        target, anchor = told.pop("data-target-id", None), told.pop("data-anchor-id", None)
        if target not in names:
            return m[0]
        told["href"] = ("" if target == own else names[target].rsplit("/", 1)[-1]) + (f"#{anchor}" if anchor else "#" if target == own else "")
        return "<a" + "".join(f' {k}="{v}"' for k, v in told.items()) + ">"

    def figure(m: re.Match) -> str:
        told = _attributes(m[1])
        if (asset := assets.get(told.get("data-asset-id"))) is None:
            return m[0]
        width, role, caption = told.get("data-width", ""), told.get("data-role"), _CAPTION.search(m[2])
        keep = (f' data-width="{width}"' if re.fullmatch(r"\d{1,3}", width) else "") + (f' data-role="{role}"' if role in ROLES else "")
        alt = asset["alt"] if asset["alt"] is not None else ALT.get(role, "")
        return f'<figure{keep}><img src="../{escape(asset["path"])}" alt="{escape(alt)}"/>{caption[0] if caption and caption[1] else ""}</figure>'

    def inline(m: re.Match) -> str:
        asset = assets.get(_attributes(m[1]).get("data-asset-id"))
        return m[0] if asset is None else f'<img class="inline-image" src="../{escape(asset["path"])}" alt="{escape(asset["alt"])}"/>'

    plain = lambda name: re.sub(r"[^A-Za-z0-9_.-]", "-", name)
    mine = {n["id"]: n for n in notes}
    mark = lambda m: m[0] if m[1] not in mine else f'<a epub:type="noteref" href="#{plain(m[1])}">[{escape(mine[m[1]]["label"] or UNLABELLED)}]</a>'
    body = _NOTE.sub(mark, _INLINE.sub(inline, _FIGURE.sub(figure, _TAG.sub(link, body))))
    if not notes:
        return body
    return body + "<hr/><section>" + "".join(f'<aside epub:type="footnote" id="{plain(n["id"])}"><p>{escape(n["body"])}</p></aside>' for n in notes) + "</section>"


@F.arrow_udf(StringType())
def _body(body: pa.Array, own: pa.Array, names: pa.Array, assets: pa.Array, notes: pa.Array) -> pa.Array:
    rows = zip(*(x.to_pylist() for x in (body, own, names, assets, notes)), strict=True)
    return pa.array([chapter_body(b or "", o, dict(n or ()), {a["id"]: a for a in s or ()}, t or []) for b, o, n, s, t in rows], pa.string())


def catalogue_books(chapters: DataFrame, assets: DataFrame, notes: DataFrame) -> DataFrame:
    """Rows for ``write_books`` of kind ``epub``.

    chapters(book, title, authors, language, pos, chapter_id, chapter, body[, toc]), assets(book, id, path, type, media_type, alt, data): images with a
    path are put into the book; notes(book, target_id, pos, id, label, body). Links, images and notes meet their chapters by joins, so a
    chapter carries only what it names itself.
    """
    number = F.row_number().over(Window.partitionBy("book").orderBy("pos"))
    named = chapters.withColumn("_file", F.format_string("chapters/chapter-%04d.xhtml", number))
    names = named.select("book", F.col("chapter_id").alias("_id"), F.col("_file").alias("_name"))
    values = lambda attribute: F.array_distinct(F.regexp_extract_all("body", F.lit(rf"""\b{attribute}=["']([^"']*)["']"""), 1))
    links = named.select("book", "chapter_id", F.explode(values("data-target-id")).alias("_id")).join(names, ["book", "_id"])
    links = links.groupBy("book", "chapter_id").agg(F.map_from_entries(F.collect_set(F.struct("_id", "_name"))).alias("_names"))
    images = assets.where("type = 'image' AND path IS NOT NULL AND path <> ''")
    told = named.select("book", "chapter_id", F.explode(values("data-asset-id")).alias("id")).join(images.select("book", "id", "path", "alt"), ["book", "id"])
    told = told.groupBy("book", "chapter_id").agg(F.collect_list(F.struct("id", "path", "alt")).alias("_assets"))
    held = notes.groupBy("book", F.col("target_id").alias("chapter_id")).agg(F.array_sort(F.collect_list(F.struct("pos", "id", "label", "body"))).alias("_notes"))
    whole = named.join(links, ["book", "chapter_id"], "left").join(told, ["book", "chapter_id"], "left").join(held, ["book", "chapter_id"], "left")
    rows = whole.withColumn("body", _body("body", "chapter_id", "_names", "_assets", "_notes")).drop("_file", "_names", "_assets", "_notes")
    heads = chapters.groupBy("book").agg(*[F.min_by(c, "pos").alias(c) for c in ("title", "authors", "language")])
    files = images.join(heads, "book").select("book", "title", "authors", "language", F.col("path").alias("asset_path"), "media_type", "data")
    return rows.unionByName(files, allowMissingColumns=True)


def _clean(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), r"\r\n?", "\n"), r"[ \t]+", " "), r"^\s+|\s+$", "")


def _escaped(text: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def project_books(blocks: DataFrame, projects: DataFrame, kind: str) -> DataFrame:
    """Rows for ``write_books`` of the kinds ``markdown``, ``rag``, ``html`` and ``project_epub``.

    blocks(book, order, type, level, text), projects(book, title, authors, language, subtitle). A run of headings opens a
    chapter, and its first three make the title (95 characters and … at most); a chapter without one has the first 80 characters of
    its text. A heading is a block of that type, or of any level above 0 with at most 90 characters. Page numbers and blank
    blocks are left out, and so is a block that says what the title says. A project without blocks has one empty chapter of its title.
    """
    text = _clean(F.col("text"))
    readable = blocks.withColumn("text", text).where("text <> '' AND coalesce(type, '') <> 'page_number'")
    heading = (F.coalesce("type", F.lit("")) == "heading") | ((F.coalesce("level", F.lit(0)) > 0) & (F.length("text") <= 90))
    w = Window.partitionBy("book").orderBy("order")
    lines = readable.withColumn("_h", heading).withColumn("_opens", F.col("_h") & ~F.coalesce(F.lag("_h").over(w), F.lit(False)) | (F.row_number().over(w) == 1))
    lines = lines.withColumn("pos", F.sum(F.col("_opens").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("int") - 1)
    # within a chapter headings stand only at its front
    held = lines.groupBy("book", "pos").agg(F.array_sort(F.collect_list(F.struct("order", F.col("_h").alias("h"), F.coalesce("type", F.lit("")).alias("type"), "text"))).alias("_b"))
    joined = F.array_join(F.slice(F.transform(F.filter("_b", lambda b: b["h"]), lambda b: b["text"]), 1, 3), " - ")
    title = F.when(joined == "", F.substring(F.get("_b", F.lit(0))["text"], 1, 80)).when(F.length(joined) > 96, F.concat(F.regexp_replace(F.substring(joined, 1, 95), r"\s+$", ""), F.lit("…"))).otherwise(joined)
    chapters = held.withColumn("chapter", title).withColumn("_b", F.filter("_b", lambda b: b["text"] != F.col("chapter")))

    def html(b: Column) -> Column:
        inner = F.replace(_escaped(b["text"]), F.lit("\n"), F.lit("<br>"))
        tag = F.when(b["type"] == "heading", "h3").when(b["type"] == "footnote", "blockquote").when(b["type"] == "table", "pre").otherwise("p")
        return F.concat(F.lit("  <"), tag, F.lit(">"), inner, F.lit("</"), tag, F.lit(">"))

    def markdown(b: Column) -> Column:
        return F.when(b["type"] == "heading", F.concat(F.lit("### "), b["text"])).when(b["type"] == "footnote", F.concat(F.lit("> "), b["text"])).when(b["type"] == "table", F.concat(F.lit("```\n"), b["text"], F.lit("\n```"))).otherwise(b["text"])

    if kind in ("html", "project_epub"):
        body = F.array_join(F.transform("_b", html), "\n")
    else:
        body = F.regexp_replace(F.array_join(F.transform("_b", markdown), "\n\n"), r"\n{3,}", "\n\n")
    rows = chapters.select("book", "pos", "chapter", body.alias("body"), F.coalesce(F.substring(F.get("_b", F.lit(0))["text"], 1, 120), F.lit("")).alias("summary"))
    whole = projects.join(rows, "book", "left")
    pos = F.coalesce("pos", F.lit(0))
    return whole.select(*[c for c in projects.columns if c in ("book", "title", "authors", "language", "subtitle")], pos.alias("pos"), F.format_string("chapter-%03d", pos + 1).alias("chapter_id"), F.coalesce("chapter", "title").alias("chapter"), F.coalesce("body", F.lit("")).alias("body"), F.coalesce("summary", F.lit("")).alias("summary"))
