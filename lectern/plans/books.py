"""Queries of book files: whole tables are written as books into the shared folder and read back."""

from __future__ import annotations

import html

import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F

from lectern.operators import export
from lectern.registry import Registry, table
from lectern.session import shared_folder
from lectern.sources import bookfiles, books, mobi, places, readers

#: Documents of a book in these queries.
SHELF = 25
MODIFIED = "2024-01-01T00:00:00Z"
_ESCAPED = "replace(replace(replace(coalesce(text, ''), '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"

#: Chapters of conversations as block projects: what a user says is a heading, the longest answers are notes.
_PROJECT = r"""
t AS (SELECT conv_id, turn, role, CASE WHEN role = 'user' THEN 'heading' WHEN turn % 4 = 3 THEN 'footnote' WHEN turn % 4 = 1 THEN 'table' ELSE 'text' END AS type,
      regexp_replace(regexp_replace(regexp_replace(coalesce(text, ''), '\r\n?', chr(10), 'g'), '[ \t]+', ' ', 'g'), '^\s+|\s+$', '', 'g') AS text FROM conversations),
o AS (SELECT *, CAST(sum(CASE WHEN opens THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS INT) - 1 AS pos FROM
      (SELECT *, (type = 'heading' AND coalesce(lag(type) OVER w, '') <> 'heading') OR row_number() OVER w = 1 AS opens FROM t WHERE text <> '' WINDOW w AS (PARTITION BY conv_id ORDER BY turn))),
h AS (SELECT conv_id, pos, array_to_string(list(text ORDER BY turn) FILTER (type = 'heading')[1:3], ' - ') AS j, list(text ORDER BY turn)[1] AS f FROM o GROUP BY 1, 2),
c AS (SELECT conv_id, pos, CASE WHEN coalesce(j, '') = '' THEN substr(f, 1, 80) WHEN length(j) > 96 THEN regexp_replace(substr(j, 1, 95), '\s+$', '') || '…' ELSE j END AS chapter FROM h),
b AS (SELECT o.conv_id, o.pos, turn, type, text, chapter FROM o JOIN c ON c.conv_id = o.conv_id AND c.pos = o.pos)
"""
_MARKDOWN = "CASE type WHEN 'heading' THEN '### ' || text WHEN 'footnote' THEN '> ' || text WHEN 'table' THEN '```' || chr(10) || text || chr(10) || '```' ELSE text END"
_BODY = rf"regexp_replace(coalesce(string_agg({_MARKDOWN}, chr(10) || chr(10) ORDER BY turn) FILTER (text <> chapter), ''), '\n{{3,}}', chr(10) || chr(10), 'g')"
_HTML = "replace(replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#39;'), chr(10), '<br>')"


def _projects(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    kind = F.when(F.col("role") == "user", "heading").when(F.col("turn") % 4 == 3, "footnote").when(F.col("turn") % 4 == 1, "table").otherwise("text")
    blocks = c.select(F.col("conv_id").cast("string").alias("book"), F.col("turn").alias("order"), kind.alias("type"), F.lit(0).alias("level"), "text")
    heads = c.select(F.col("conv_id").cast("string").alias("book")).distinct()
    return blocks, heads.select("book", F.concat(F.lit("Conversation "), "book").alias("title"), F.array(F.lit("A"), F.lit("B")).alias("authors"), F.lit("en").alias("language"), F.lit("sub").alias("subtitle"))


def _written(spark, sf_dir, kind):
    at = shared_folder(spark, kind)
    blocks, heads = _projects(spark, sf_dir)
    bookfiles.write_books(export.project_books(blocks, heads, kind), at, kind, MODIFIED)
    return spark.read.format("binaryFile").load(f"{at}/*.{bookfiles.KINDS[kind].ending}").withColumn("conv_id", F.regexp_extract("path", r"/([^/]*)\.\w+$", 1).cast("bigint"))


def register(r: Registry) -> None:
    @r.query(
        "mobi_chapters",
        f"""SELECT doc_id, 'Book ' || doc_id // {SHELF} AS book_title, 'Author ' || doc_id // {SHELF} AS author, CAST(row_number() OVER (PARTITION BY doc_id // {SHELF} ORDER BY doc_id) - 1 AS INT) AS pos, 1 AS level,
            sha256('<p>' || {_ESCAPED} || '</p>') AS digest, CAST(NULL AS VARCHAR) AS error FROM documents""",
    )
    def mobi_chapters(spark, sf_dir):
        at = shared_folder(spark, "mobi")

        def shelve(key: tuple, rows: pa.Table) -> pa.Table:
            parts = sorted(zip(rows["doc_id"].to_pylist(), rows["text"].to_pylist(), strict=True))
            k = key[0].as_py()
            data = mobi.packed_book(f"Book {k}", [f"Author {k}"], [(str(d), f"<p>{html.escape(t or '', quote=False)}</p>") for d, t in parts])
            places.put(f"{at}/{k}.mobi", data)
            return pa.table({"book": pa.array([k], pa.int64())})

        docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.expr(f"doc_id div {SHELF}").alias("book"))
        docs.groupBy("book").applyInArrow(shelve, "book long").write.format("noop").mode("overwrite").save()
        got = mobi.chapters(mobi.records(spark, at, 1 << 16))
        return got.select(F.col("title").cast("bigint").alias("doc_id"), "book_title", F.get("authors", F.lit(0)).alias("author"), "pos", "level", F.sha2("html", 256).alias("digest"), "error")

    @r.query(
        "epub_round_trip",
        f"""WITH d AS (SELECT doc_id, doc_id // {SHELF} AS book, {_ESCAPED} AS t, row_number() OVER w AS n, count(*) OVER (PARTITION BY doc_id // {SHELF}) AS last FROM documents WINDOW w AS (PARTITION BY doc_id // {SHELF} ORDER BY doc_id))
            SELECT doc_id, 'Shelf & ' || book AS book_title, CAST(n - 1 AS INT) AS pos, 'Text ' || doc_id AS title, 'OEBPS/chapters/chapter-' || lpad(CAST(n AS VARCHAR), 4, '0') || '.xhtml' AS href,
            sha256('<p>' || t || '</p><a href="' || CASE WHEN n < last THEN 'chapter-' || lpad(CAST(n + 1 AS VARCHAR), 4, '0') || '.xhtml#top' ELSE '#top' END || '">on</a>'
              || '<figure data-role="cover"><img src="../assets/c.png" alt="封面"/></figure><a epub:type="noteref" href="#n' || doc_id || '">[注]</a><hr/><section><aside epub:type="footnote" id="n' || doc_id || '"><p>note &lt;' || doc_id || '&gt;</p></aside></section>') AS digest FROM d""",
    )
    def epub_round_trip(spark, sf_dir):
        at = shared_folder(spark, "epub")
        d = table(spark, sf_dir, "documents").select("doc_id", F.expr(f"CAST(doc_id div {SHELF} AS STRING)").alias("book"), "text")
        text = F.coalesce("text", F.lit(""))
        for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
            text = F.replace(text, F.lit(a), F.lit(b))
        w = Window.partitionBy("book").orderBy("doc_id")
        following = d.select("book", "doc_id", text.alias("t"), F.coalesce(F.lead("doc_id").over(w), "doc_id").alias("to"))
        body = F.format_string('<p>%s</p><a data-target-id="c%s" data-anchor-id="top">on</a><figure data-asset-id="x" data-role="cover"></figure><sup data-annotation-id="n%s"></sup>', "t", "to", "doc_id")
        chapters = following.select("book", F.concat(F.lit("Shelf & "), "book").alias("title"), F.array(F.lit("A"), F.lit("B & C")).alias("authors"), F.lit("en").alias("language"), F.col("doc_id").cast("int").alias("pos"), F.concat(F.lit("c"), "doc_id").alias("chapter_id"), F.concat(F.lit("Text "), "doc_id").alias("chapter"), body.alias("body"))
        assets = d.select("book").distinct().select("book", F.lit("x").alias("id"), F.lit("assets/c.png").alias("path"), F.lit("image").alias("type"), F.lit("image/png").alias("media_type"), F.lit(None).cast("string").alias("alt"), F.lit("png").cast("binary").alias("data"))
        notes = d.select("book", F.concat(F.lit("c"), "doc_id").alias("target_id"), F.lit(1).alias("pos"), F.concat(F.lit("n"), "doc_id").alias("id"), F.lit(None).cast("string").alias("label"), F.format_string("note <%s>", "doc_id").alias("body"))
        bookfiles.write_books(export.catalogue_books(chapters, assets, notes), at, "epub", MODIFIED)
        parts = books.epub_parts(spark.read.format("binaryFile").load(f"{at}/*.epub").select("content"))
        inner = F.regexp_extract("html", r"(?s)</h1>(.*)</body>", 1)
        return parts.select(F.regexp_extract("title", r"(\d+)", 1).cast("bigint").alias("doc_id"), "book_title", "pos", "title", "href", F.sha2(inner, 256).alias("digest"))

    @r.query(
        "project_markdown",
        f"WITH {_PROJECT}, m AS (SELECT conv_id, pos, '## ' || chapter || CASE WHEN {_BODY} <> '' THEN chr(10) || chr(10) || {_BODY} ELSE '' END AS part FROM b GROUP BY conv_id, pos, chapter) "
        "SELECT conv_id, sha256('# Conversation ' || conv_id || chr(10) || chr(10) || string_agg(part, chr(10) || chr(10) ORDER BY pos) || chr(10)) AS digest FROM m GROUP BY conv_id",
    )
    def project_markdown(spark, sf_dir):
        return _written(spark, sf_dir, "markdown").select("conv_id", F.sha2("content", 256).alias("digest"))

    @r.query(
        "project_html",
        f"""WITH {_PROJECT}, l AS (SELECT *, CASE type WHEN 'heading' THEN 'h3' WHEN 'footnote' THEN 'blockquote' WHEN 'table' THEN 'pre' ELSE 'p' END AS tag, {_HTML} AS e FROM b)
            SELECT conv_id, CAST(pos AS INT) AS pos, sha256(coalesce(string_agg('  <' || tag || '>' || e || '</' || tag || '>', chr(10) ORDER BY turn) FILTER (text <> chapter), '')) AS digest FROM l GROUP BY conv_id, pos""",
    )
    def project_html(spark, sf_dir):
        pages = _written(spark, sf_dir, "html").select("conv_id", F.col("content").cast("string").alias("page"))
        found = F.regexp_extract_all("page", F.lit(r'(?s)<section id="chapter-\d+">\n  <h2>[^<]*</h2>\n(.*?)\n</section>'), 1)
        return pages.select("conv_id", F.posexplode(found).alias("pos", "body")).select("conv_id", "pos", F.sha2("body", 256).alias("digest"))

    @r.query(
        "rag_packages",
        f"WITH {_PROJECT} SELECT conv_id, CAST(pos + 1 AS BIGINT) AS ord, chapter AS title, 'chapters/chapter-' || lpad(CAST(pos + 1 AS VARCHAR), 3, '0') || '.md' AS path, coalesce(substr(list(text ORDER BY turn) FILTER (text <> chapter)[1], 1, 120), '') AS summary, "
        f"sha256('# ' || chapter || CASE WHEN {_BODY} <> '' THEN chr(10) || chr(10) || {_BODY} ELSE '' END || chr(10)) AS digest FROM b GROUP BY conv_id, pos, chapter",
    )
    def rag_packages(spark, sf_dir):
        entries = readers.archive_entries(_written(spark, sf_dir, "rag").select("conv_id", "content"))
        chapter = "struct<title:string,`order`:bigint,path:string,summary:string>"
        told = entries.where("name = 'manifest.json'").select("conv_id", F.explode(F.from_json(F.col("data").cast("string"), f"chapters array<{chapter}>")["chapters"]).alias("c"))
        files = entries.where("name LIKE 'chapters/%'").select("conv_id", F.col("name").alias("path"), F.sha2("data", 256).alias("digest"))
        return told.select("conv_id", F.col("c.order").alias("ord"), "c.title", "c.path", "c.summary").join(files, ["conv_id", "path"])

    @r.query(
        "project_epub",
        f"WITH {_PROJECT} SELECT conv_id, CAST(pos AS INT) AS pos, chapter AS title, 'OEBPS/chapters/chapter-' || lpad(CAST(pos + 1 AS VARCHAR), 3, '0') || '.xhtml' AS href FROM c",
    )
    def project_epub(spark, sf_dir):
        parts = books.epub_parts(_written(spark, sf_dir, "project_epub").select("conv_id", "content"))
        title = F.regexp_extract("html", r"(?s)<h1>(.*?)</h1>", 1)
        for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
            title = F.replace(title, F.lit(a), F.lit(b))
        return parts.select("conv_id", "pos", title.alias("title"), "href")
