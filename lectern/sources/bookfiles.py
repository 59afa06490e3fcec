"""A data source that writes books: one file a book, from rows that stand together and in order.

Rows are chapters (``pos`` from 0) or files that a book holds (``pos`` null, before its chapters). A task writes a chapter when its row comes and
keeps only what the book's lists need, ids and titles, so a book's size doesn't matter. Files are written into a folder of
the task's own below ``_staged``; its commit message names the folder and counts. The commit moves the files of the tasks that
succeeded to their places and writes ``_SUCCESS`` with the totals last; an abort removes what was staged. A task that runs again
begins a new folder, whose like is left behind with ``_staged``.

Kinds: ``epub`` (chapters by number, a flat table of contents that may point into chapters, files), ``project_epub`` (chapters by id,
a style sheet), ``rag`` (a zip of Markdown chapters and ``manifest.json``), ``html`` and ``markdown`` (one text file).
"""

from __future__ import annotations

import json
import re
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import UTC, datetime
from hashlib import sha256

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from lectern.sources import places

#: What a row has; missing columns are null.
COLUMNS = {
    "book": "string", "title": "string", "authors": "array<string>", "language": "string", "subtitle": "string", "pos": "int", "chapter_id": "string", "chapter": "string", "body": "string",
    "summary": "string", "toc": "array<struct<title:string,anchor:string>>", "asset_path": "string", "media_type": "string", "data": "binary",
}
#: Rows that are Python objects at once.
ROWS = 64

CONTAINER = '<?xml version="1.0" encoding="UTF-8"?><container version="1.0" xmlns="urn:oasis:names:tc:opendocument:xmlns:container"><rootfiles><rootfile full-path="OEBPS/content.opf" media-type="application/oebps-package+xml"/></rootfiles></container>'
XHTML = '<?xml version="1.0" encoding="UTF-8"?>\n<!DOCTYPE html>\n<html xmlns="http://www.w3.org/1999/xhtml" xmlns:epub="http://www.idpf.org/2007/ops"'
STYLE = 'body{font-family:serif;line-height:1.8}h1,h2,h3{line-height:1.35}p{margin:0 0 1em}pre{white-space:pre-wrap}blockquote{margin:1em 1.5em}[data-align="center"]{text-align:center}[data-align="right"]{text-align:right}[data-indent="none"]{text-indent:0}figure img{max-width:100%}.inline-image{height:1em}'


def escape(text: str | None, apostrophe: str = "&apos;") -> str:
    return (text or "").replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;").replace('"', "&quot;").replace("'", apostrophe)


def file_name(book: str) -> str:
    """A book's file: its id if that is plain, else what is left of it with a hash, so that two ids never share one."""
    plain = re.sub(r"[^\w.-]", "-", book)[:100]
    return plain if plain == book and not book.startswith((".", "_")) else f"{plain.lstrip('._')}-{sha256(book.encode()).hexdigest()[:12]}"


class Archive:
    """A zip file that is written from front to end; equal contents give equal bytes."""

    def __init__(self, stream):
        self.zip = zipfile.ZipFile(stream, "w", zipfile.ZIP_DEFLATED)

    def add(self, name: str, data: str | bytes, packed: bool = True) -> None:
        entry = zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0))
        entry.compress_type = zipfile.ZIP_DEFLATED if packed else zipfile.ZIP_STORED
        self.zip.writestr(entry, data)

    def close(self) -> None:
        self.zip.close()


class Epub:
    """``chapters/chapter-0001.xhtml`` and so on, further files, contents and package."""

    ending = "epub"

    def __init__(self, stream, book: dict, modified: str):
        self.out, self.book, self.modified = Archive(stream), book, modified
        self.items, self.spine, self.nav, self.files = [], [], [], set()
        self.out.add("mimetype", "application/epub+zip", packed=False)
        self.out.add("META-INF/container.xml", CONTAINER)

    def asset(self, row: dict) -> None:
        if row["asset_path"] not in self.files:
            self.files.add(row["asset_path"])
            self.out.add(f"OEBPS/{row['asset_path']}", row["data"] or b"")
            self.items.append(f'<item id="asset-{len(self.files)}" href="{escape(row["asset_path"])}" media-type="{escape(row["media_type"])}"/>')

    def chapter(self, row: dict) -> None:
        n = len(self.spine) + 1
        name = f"chapters/chapter-{n:04d}.xhtml"
        head = f'{XHTML} lang="{escape(self.book["language"])}">\n<head><meta charset="utf-8"/><title>{escape(row["chapter"])}</title><style>{STYLE}</style></head>\n'
        self.out.add(f"OEBPS/{name}", f"{head}<body><h1>{escape(row['chapter'])}</h1>{row['body'] or ''}</body></html>")
        self.items.append(f'<item id="chapter-{n}" href="{name}" media-type="application/xhtml+xml"/>')
        self.spine.append(f'<itemref idref="chapter-{n}"/>')
        for entry in [{"title": row["chapter"], "anchor": None}] if row["toc"] is None else row["toc"]:
            anchor = "#" + escape(entry["anchor"]) if entry["anchor"] else ""
            self.nav.append(f'<li><a href="{name}{anchor}">{escape(entry["title"])}</a></li>')

    def close(self) -> None:
        book, language = self.book, escape(self.book["language"])
        self.out.add("OEBPS/nav.xhtml", f'{XHTML} lang="{language}">\n<head><meta charset="utf-8"/><title>{escape(book["title"])}</title></head><body><nav epub:type="toc"><ol>{"".join(self.nav)}</ol></nav></body></html>')
        creators = "".join(f"<dc:creator>{escape(a)}</dc:creator>" for a in book["authors"] or () if a)
        meta = f'<dc:identifier id="book-id">{escape(book["book"])}</dc:identifier><dc:title>{escape(book["title"])}</dc:title><dc:language>{language}</dc:language>{creators}<meta property="dcterms:modified">{self.modified}</meta>'
        nav = '<item id="nav" href="nav.xhtml" media-type="application/xhtml+xml" properties="nav"/>'
        self.out.add(
            "OEBPS/content.opf",
            f'<?xml version="1.0" encoding="UTF-8"?>\n<package xmlns="http://www.idpf.org/2007/opf" version="3.0" unique-identifier="book-id" xml:lang="{language}">\n'
            f'<metadata xmlns:dc="http://purl.org/dc/elements/1.1/">{meta}</metadata>\n<manifest>{nav}{"".join(self.items)}</manifest>\n<spine>{"".join(self.spine)}</spine></package>',
        )
        self.out.close()


class ProjectEpub(Epub):
    """The same with chapters named by id and one style sheet."""

    def __init__(self, stream, book: dict, modified: str):
        super().__init__(stream, book, modified)
        self.out.add("OEBPS/styles.css", STYLE)
        self.items.append('<item id="styles" href="styles.css" media-type="text/css"/>')

    def chapter(self, row: dict) -> None:
        name, title = f"chapters/{row['chapter_id']}.xhtml", escape(row["chapter"], "&#39;")
        self.out.add(f"OEBPS/{name}", f'{XHTML}><head><title>{title}</title><link rel="stylesheet" href="../styles.css"/></head><body><h1>{title}</h1>{row["body"] or ""}</body></html>')
        self.items.append(f'<item id="{row["chapter_id"]}" href="{name}" media-type="application/xhtml+xml"/>')
        self.spine.append(f'<itemref idref="{row["chapter_id"]}"/>')
        self.nav.append(f'<li><a href="{name}">{title}</a></li>')


class Rag:
    """Markdown chapters and a manifest."""

    ending = "zip"

    def __init__(self, stream, book: dict, modified: str):
        self.out, self.book, self.chapters = Archive(stream), book, []

    def asset(self, row: dict) -> None:
        self.out.add(row["asset_path"], row["data"] or b"")

    def chapter(self, row: dict) -> None:
        path = f"chapters/{row['chapter_id']}.md"
        self.out.add(path, "\n\n".join(x for x in (f"# {row['chapter']}", row["body"]) if x) + "\n")
        self.chapters.append({"id": row["chapter_id"], "title": row["chapter"], "order": len(self.chapters) + 1, "path": path, "summary": row["summary"] or ""})

    def close(self) -> None:
        book = self.book
        toc = [{"id": c["id"], "title": c["title"], "chapter_id": c["id"], "level": 1, "order": c["order"]} for c in self.chapters]
        told = {"id": book["book"], "title": book["title"], "authors": book["authors"] or [], "language": book["language"]}
        whole = {"schema_version": "1.0", "title": book["title"], "description": book["subtitle"] or "", "book": told, "chapters": self.chapters, "toc": toc, "assets": [], "annotations": [], "reader_config": {"default_theme": "paper"}}
        self.out.add("manifest.json", json.dumps(whole, ensure_ascii=False, indent=2))
        self.out.close()


class Text:
    """One text file: a head, chapters parted by a separator, a foot."""

    def __init__(self, stream, book: dict, modified: str):
        self.out, self.book, self.n = stream, book, 0
        self.put(self.head())

    def put(self, text: str) -> None:
        self.out.write(text.encode())

    def asset(self, row: dict) -> None:
        """A text file holds no further files."""

    def chapter(self, row: dict) -> None:
        self.put((self.between if self.n else "") + self.one(row))
        self.n += 1

    def close(self) -> None:
        self.put(self.foot)


class Markdown(Text):
    ending, between, foot = "md", "\n\n", "\n"

    def head(self) -> str:
        return f"# {self.book['title']}\n\n"

    def one(self, row: dict) -> str:
        return "\n\n".join(x for x in (f"## {row['chapter']}", row["body"]) if x)


class Html(Text):
    ending, between, foot = "html", "\n", "\n</body>\n</html>\n"

    def head(self) -> str:
        title = escape(self.book["title"], "&#39;")
        return f'<!doctype html>\n<html lang="{escape(self.book["language"])}">\n<head>\n  <meta charset="utf-8">\n  <title>{title}</title>\n  <style>{STYLE}</style>\n</head>\n<body>\n  <h1>{title}</h1>\n'

    def one(self, row: dict) -> str:
        return f'<section id="{row["chapter_id"]}">\n  <h2>{escape(row["chapter"], "&#39;")}</h2>\n{row["body"] or ""}\n</section>'


KINDS = {"epub": Epub, "project_epub": ProjectEpub, "rag": Rag, "html": Html, "markdown": Markdown}


@dataclass
class Staged(WriterCommitMessage):
    folder: str
    books: int
    chapters: int


class BookWriter(DataSourceArrowWriter):
    def __init__(self, path: str, kind: str, modified: str, overwrite: bool):
        self.path, self.kind, self.modified, self.overwrite = path.rstrip("/"), kind, modified, overwrite
        self.staging = f"{self.path}/_staged/{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Staged:
        folder = f"{self.staging}/{uuid.uuid4().hex}"
        fs, at = places.place(folder)
        fs.create_dir(at, recursive=True)
        layout, now, pos, done, chapters, stream = KINDS[self.kind], None, -1, set(), 0, None
        for batch in iterator:
            for row in (r for i in range(0, batch.num_rows, ROWS) for r in batch.slice(i, ROWS).to_pylist()):
                if now is None or row["book"] != now.book["book"]:
                    if now is not None:
                        now.close()
                        stream.close()
                    if row["book"] is None or row["book"] in done:
                        raise ValueError(f"rows of book {row['book']!r} do not stand together")
                    done.add(row["book"])
                    stream, pos = fs.open_output_stream(f"{at}/{file_name(row['book'])}.{layout.ending}"), -1
                    now = layout(stream, row, self.modified)
                if row["pos"] is None:
                    now.asset(row)
                    continue
                if row["pos"] <= pos:
                    raise ValueError(f"chapters of book {row['book']!r} are not in order at {row['pos']}")
                pos = row["pos"]
                now.chapter(row)
                chapters += 1
        if now is not None:
            now.close()
            stream.close()
        return Staged(folder, len(done), chapters)

    def commit(self, messages: list[Staged | None]) -> None:
        fs, at = places.place(self.path)
        ending = KINDS[self.kind].ending
        staged = [f for m in messages if m is not None for f in fs.get_file_info(pafs.FileSelector(places.place(m.folder)[1]))]
        names = [f.base_name for f in staged]
        if len(set(names)) != len(names):
            self.abort(messages)
            raise ValueError("rows of one book came to two tasks")
        if self.overwrite:
            for old in fs.get_file_info(pafs.FileSelector(at)):
                if old.extension == ending and old.base_name not in set(names):
                    fs.delete_file(old.path)
        for f in staged:
            fs.move(f.path, f"{at}/{f.base_name}")
        fs.delete_dir(places.place(self.staging)[1])
        total = {"books": sum(m.books for m in messages if m), "chapters": sum(m.chapters for m in messages if m)}
        places.put(f"{self.path}/_SUCCESS", json.dumps(total).encode())

    def abort(self, messages: list[Staged | None]) -> None:
        fs, at = places.place(self.staging)
        if fs.get_file_info(at).type == pafs.FileType.Directory:
            fs.delete_dir(at)


class Books(DataSource):
    """``df.write.format("books").option("kind", ...).save(folder)``; :func:`write_books` brings rows together and in order first."""

    @classmethod
    def name(cls) -> str:
        return "books"

    def schema(self) -> str:
        return ", ".join(f"{c} {t}" for c, t in COLUMNS.items())

    def writer(self, schema, overwrite: bool) -> BookWriter:
        kind = self.options.get("kind", "epub")
        if kind not in KINDS:
            raise ValueError(f"kind must be one of {', '.join(KINDS)}")
        return BookWriter(self.options["path"], kind, self.options.get("modified") or datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ"), overwrite)


def write_books(df: DataFrame, path: str, kind: str = "epub", modified: str | None = None, mode: str = "append") -> None:
    """Writes a file for each ``book`` below ``path``. A book is one task's work; tasks hold one chapter at a time.

    Other columns than those of :data:`COLUMNS` are left out; ``modified`` is now by default.
    """
    df.sparkSession.dataSource.register(Books)
    rows = df.select(*[(F.col(c) if c in df.columns else F.lit(None)).cast(t).alias(c) for c, t in COLUMNS.items()])
    together = rows.repartition("book").sortWithinPartitions("book", F.col("pos").asc_nulls_first(), "asset_path")
    writer = together.write.format("books").mode(mode).option("kind", kind)
    (writer.option("modified", modified) if modified else writer).save(path)
