"""MOBI (KF7) books: a Python data source that reads their record tables by ranges of records, and the chapters of a book.

``palm_records`` gives one row for each record. A large file is dealt to several partitions by shares of its record table, small ones
share a partition; each task reads the table, the first record and its own records only, and unpacks text records. Files
are listed and read by ``pyarrow.fs``, so a path may be local or a URI that it knows.

A file that is no such book, is locked, is of a later format or packed in an unknown way gives one row with ``error``
(``short``, ``records``, ``container``, ``locked``, ``format``, ``packing``); a text record that can't be unpacked gives a row with ``damaged``.
The format holds at most 65,535 records of 64 KB a book, and text records unpack to 4 KB: what :func:`chapters` gathers for one book is bounded by it.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from lectern.functions import codecs
from lectern.sources import places

#: Bytes of a file for each share of its record table, and of the small files that share a partition.
SHARE_BYTES = 4 << 20
#: Bytes of records in an Arrow batch.
BATCH_BYTES = 4 << 20
#: Endings of such files; EXTH records by what they hold; places in the first record; what a TOC entry loses at its front; the title of a text without one.
ENDINGS = ("azw", "mobi", "prc")
EXTH = {"author": 100, "publisher": 101, "description": 103, "isbn": 104, "published": 106, "asin": 113, "title": 503, "language": 524}
COVER = 201
NUMBERED = re.compile(r"^\d{1,3}[、.．]\s*")
UNTITLED, LANGUAGE = "正文", "zh-CN"

HEADER = pa.struct([
    ("title", pa.string()), ("author", pa.string()), ("authors", pa.list_(pa.string())), ("publisher", pa.string()), ("isbn", pa.string()), ("language", pa.string()), ("description", pa.string()),
    ("published", pa.string()), ("book_id", pa.string()), ("version", pa.int32()), ("packing", pa.int32()), ("utf8", pa.bool_()), ("text_length", pa.int64()), ("text_records", pa.int32()),
    ("trailing", pa.int32()), ("first_image", pa.int32()), ("cover", pa.int32()),
])
SCHEMA = pa.schema([("path", pa.string()), ("record", pa.int32()), ("kind", pa.string()), ("media_type", pa.string()), ("data", pa.binary()), ("header", HEADER), ("error", pa.string())])


class BadBook(ValueError):
    """Why a book can't be read, in a word."""


def record_table(head: bytes, size: int) -> list[int]:
    """Where records start, and the file's end, from the file's first bytes."""
    if size < 86:
        raise BadBook("short")
    n = struct.unpack_from(">H", head, 76)[0]
    if not n or len(head) < 78 + 8 * n:
        raise BadBook("records")
    at = [struct.unpack_from(">I", head, 78 + 8 * k)[0] for k in range(n)] + [size]
    if any(b < a for a, b in zip(at, at[1:])):
        raise BadBook("records")
    return at


def exth(first: bytes) -> dict[int, list[bytes]]:
    """The first record's further records by number; one that runs over the end and what follows it are left out."""
    found: dict[int, list[bytes]] = {}
    length = struct.unpack_from(">I", first, 20)[0]
    start = 16 + length
    if not struct.unpack_from(">I", first, 0x80)[0] & 0x40 or first[start : start + 4] != b"EXTH" or start + 12 > len(first):
        return found
    at = start + 12
    for _ in range(struct.unpack_from(">I", first, start + 8)[0]):
        if at + 8 > len(first):
            break
        kind, size = struct.unpack_from(">II", first, at)
        if size < 8 or at + size > len(first):
            break
        found.setdefault(kind, []).append(first[at + 8 : at + size])
        at += size
    return found


def decoded(data: bytes, utf8: bool) -> str:
    """Text in UTF-8 or Windows-1252, whose five empty places are control characters."""
    if utf8:
        return data.decode("utf-8", "replace")
    return "".join(bytes([b]).decode("cp1252") if b not in (0x81, 0x8D, 0x8F, 0x90, 0x9D) else chr(b) for b in data) if any(0x7F < b < 0xA0 for b in data) else data.decode("latin-1")


def header(first: bytes, digest: str, name: str) -> dict:
    """What the first record tells of a book; ``digest`` of the record and ``name`` of the file serve where it tells nothing."""
    if len(first) < 248 or first[16:20] != b"MOBI":
        raise BadBook("container")
    packing, length, records, locked = struct.unpack_from(">HxxIHxxH", first, 0)
    encoding, unique = struct.unpack_from(">II", first, 28)
    version = struct.unpack_from(">I", first, 36)[0]
    if locked:
        raise BadBook("locked")
    if version >= 8:
        raise BadBook("format")
    if packing not in (1, 2):
        raise BadBook("packing")
    more = exth(first)
    text = {k: (more.get(n) or [b""])[0].decode("utf-8", "replace").rstrip("\0").strip() for k, n in EXTH.items()}
    title_at, title_size = struct.unpack_from(">II", first, 0x54)
    utf8 = encoding != 1252
    own = decoded(first[title_at : title_at + title_size], utf8).rstrip("\0").strip() if title_at + title_size <= len(first) else ""
    cover = (more.get(COVER) or [b""])[0]
    return {
        "title": text["title"] or own or name, "author": text["author"], "authors": [a.decode("utf-8", "replace").rstrip("\0").strip() for a in more.get(EXTH["author"], [])],
        "publisher": text["publisher"], "isbn": text["isbn"], "language": text["language"] or LANGUAGE, "description": text["description"], "published": text["published"][:10] or None,
        "book_id": text["asin"] or f"mobi:{unique}:{digest[:12]}", "version": version, "packing": packing, "utf8": utf8, "text_length": length, "text_records": records,
        "trailing": struct.unpack_from(">H", first, 0xF2)[0], "first_image": struct.unpack_from(">I", first, 0x6C)[0], "cover": struct.unpack(">I", cover[:4])[0] if len(cover) >= 4 else None,
    }


def trimmed(record: bytes, flags: int) -> bytes:
    """A text record without its trailing entries: one for each higher bit of the flags, then the bytes of a cut character."""
    end = len(record)
    for bit in range(1, 16):
        if flags >> bit & 1:
            size = 0
            for k, b in enumerate(reversed(record[max(end - 4, 0) : end])):
                size |= (b & 0x7F) << 7 * k
                if b & 0x80:
                    break
            end -= size
    if flags & 1 and end > 0:
        end -= (record[end - 1] & 3) + 1
    if end < 0:
        raise BadBook("damaged")
    return record[:end]


def image_type(data: bytes) -> str | None:
    for kind, fits in (("image/jpeg", data[:2] == b"\xff\xd8"), ("image/png", data[:8] == b"\x89PNG\r\n\x1a\n"), ("image/gif", data[:6] in (b"GIF87a", b"GIF89a")), ("image/webp", data[:4] == b"RIFF" and data[8:12] == b"WEBP")):
        if fits:
            return kind
    return None


@dataclass
class Shares(InputPartition):
    """Shares of files: (path, k, of) stands for the k-th of ``of`` equal shares of the record table."""

    files: list[tuple[str, int, int]]


class PalmReader(DataSourceReader):
    def __init__(self, path: str, share: int):
        self.path, self.share = path, share

    def partitions(self) -> list[Shares]:
        """By sizes alone: no file is opened before the tasks run."""
        files = places.listed(self.path, ENDINGS)
        share = max(self.share, -(-sum(size for _, size in files) // places.MOST_PARTS))
        out, small, room = [], [], share
        for file, size in files:
            n = -(-size // share)
            if n > 1:
                out += [Shares([(file, k, n)]) for k in range(n)]
                continue
            if small and size > room:
                out.append(Shares(small))
                small, room = [], share
            small.append((file, 0, 1))
            room -= size
        return out + ([Shares(small)] if small else [])

    def read(self, partition: Shares | None) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for path, k, of in partition.files if partition else ():
            for row in self._records(path, k, of):
                rows.append(row)
                held += len(row["data"] or b"")
                if held > BATCH_BYTES:
                    yield pa.RecordBatch.from_pylist(rows, SCHEMA)
                    rows, held = [], 0
        yield pa.RecordBatch.from_pylist(rows, SCHEMA)

    def _records(self, path: str, k: int, of: int) -> Iterator[dict]:
        empty = dict.fromkeys(SCHEMA.names) | {"path": path}
        with places.opened(path) as f:
            try:
                size = f.size()
                head = f.read(78)
                n = struct.unpack_from(">H", head, 76)[0] if len(head) == 78 else 0
                at = record_table(head + f.read(8 * n), size)
                first = f.read_at(at[1] - at[0], at[0])
                book = header(first, hashlib.sha256(first).hexdigest(), path.rsplit("/", 1)[-1].rsplit(".", 1)[0])
            except BadBook as e:
                if k == 0:
                    yield empty | {"error": str(e)}
                return
            n = len(at) - 1
            for i in range(n * k // of, n * (k + 1) // of):
                data = f.read_at(at[i + 1] - at[i], at[i])
                if i == 0:
                    yield empty | {"record": 0, "kind": "header", "header": book}
                elif i <= book["text_records"]:
                    try:
                        text = trimmed(data, book["trailing"])
                        yield empty | {"record": i, "kind": "text", "data": codecs.palmdoc(text) if book["packing"] == 2 else text}
                    except ValueError:
                        yield empty | {"record": i, "kind": "text", "error": "damaged"}
                else:
                    kind = image_type(data) if 0 < book["first_image"] <= i else None
                    yield empty | {"record": i, "kind": "image" if kind else "other", "media_type": kind, "data": data}


class PalmRecords(DataSource):
    """``spark.read.format("palm_records").load(folder or file)``; option ``shareBytes``: a task's bytes, or more where that would be over 2,000 tasks."""

    @classmethod
    def name(cls) -> str:
        return "palm_records"

    def schema(self) -> str:
        book = ", ".join(f"{f.name}: {_sql(f.type)}" for f in HEADER)
        return f"path string, record int, kind string, media_type string, data binary, header struct<{book}>, error string"

    def reader(self, schema) -> PalmReader:
        return PalmReader(self.options["path"], int(self.options.get("sharebytes", SHARE_BYTES)))


def _sql(kind: pa.DataType) -> str:
    return {pa.string(): "string", pa.int32(): "int", pa.int64(): "bigint", pa.bool_(): "boolean"}.get(kind, "array<string>")


def records(spark: SparkSession, path: str, share: int = SHARE_BYTES) -> DataFrame:
    """One row per record of the books below ``path``."""
    spark.dataSource.register(PalmRecords)
    return spark.read.format("palm_records").option("shareBytes", share).load(path)


# --- chapters --------------------------------------------------------------------------------------

_TOC = re.compile(rb"""<reference\b(?=[^>]*\btype=["']?toc)[^>]*\bfilepos=["']?(\d+)""", re.I)
_LINK = re.compile(rb"""<a\b[^>]*?\bfilepos=["']?(\d+)""", re.I)
_LINKED = re.compile(r"""(<a\b[^>]*?)\s*\bfilepos=["']?(\d+)["']?""", re.I)
_IMAGE = re.compile(r"""(<img\b[^>]*?)\s*\brecindex=["']?(\d+)["']?""", re.I)


class _Entries(HTMLParser):
    """Links of a table of contents: (target, title, level); each quotation around one makes it a level deeper."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.depth, self.open, self.found = 0, None, []

    def handle_starttag(self, tag, attrs):
        if tag == "blockquote":
            self.depth += 1
        elif tag == "a":
            self.close_link()
            target = dict(attrs).get("filepos") or ""
            self.open = [int(target), "", self.depth + 1] if target.isdigit() else None

    def handle_endtag(self, tag):
        if tag == "blockquote":
            self.depth = max(0, self.depth - 1)
        elif tag == "a":
            self.close_link()

    def handle_data(self, data):
        if self.open is not None:
            self.open[1] += data

    def close_link(self):
        if self.open is not None:
            self.found.append(tuple(self.open))
        self.open = None


def contents(text: bytes, at: int, utf8: bool, title: str) -> list[tuple[int, str, int]]:
    """(start, title, level) of chapters by the table of contents at ``at``: the first entry of a place counts; one chapter where there is none."""
    parser = _Entries()
    parser.feed(decoded(text[at:], utf8))
    parser.close_link()
    found: dict[int, tuple[int, str, int]] = {}
    for target, words, level in parser.found:
        words = NUMBERED.sub("", " ".join(words.split()))
        if target < at and words:
            found.setdefault(target, (target, words, level))
    return sorted(found.values()) or [(0, title or UNTITLED, 1)]


def book_chapters(book: dict, text: bytes, images: dict[int, tuple[str, bytes]]) -> Iterator[dict]:
    """A book's chapters: targets of inner links become anchors, links name chapter and anchor, and images are data URLs."""
    text = text[: book["text_length"]]
    told = _TOC.search(text)
    end = min(int(told[1]), len(text)) if told else len(text)
    entries = contents(text, end, book["utf8"], book["title"])
    targets = sorted({t for m in _LINK.finditer(text[:end]) if (t := int(m[1])) < end})
    ids = ["chapter:" + hashlib.sha256(f"{start}:{title}".encode()).hexdigest()[:16] for start, title, _ in entries]
    starts = [start for start, _, _ in entries]

    def holder(target: int) -> str:
        return ids[max(0, sum(s <= target for s in starts) - 1)]

    def link(m: re.Match) -> str:
        target = int(m[2])
        if target not in targets:
            return m[0]
        return f'{m[1]} href="#mobi-filepos-{target}" data-target-id="{holder(target)}" data-anchor-id="mobi-filepos-{target}"'

    def image(m: re.Match) -> str:
        kind, data = images.get(int(m[2]), (None, b""))
        return m[1] + (f' src="data:{kind};base64,{base64.b64encode(data).decode()}"' if kind else "")

    for k, (start, title, level) in enumerate(entries):
        stop, parts, at = (starts[k + 1] if k + 1 < len(starts) else end), [], start
        for t in (t for t in targets if start <= t < stop):
            parts += [decoded(text[at:t], book["utf8"]), f'<span id="mobi-filepos-{t}"></span>']
            at = t
        html = "".join([*parts, decoded(text[at:stop], book["utf8"])])
        yield {"pos": k, "id": ids[k], "title": title, "level": level, "start": start, "html": _IMAGE.sub(image, _LINKED.sub(link, html))}


CHAPTERS = "path string, book_title string, authors array<string>, book_id string, language string, error string, pos int, id string, title string, level int, start bigint, html string"
_CHAPTERS = pa.schema([("path", pa.string()), ("book_title", pa.string()), ("authors", pa.list_(pa.string())), ("book_id", pa.string()), ("language", pa.string()), ("error", pa.string()), ("pos", pa.int32()), ("id", pa.string()), ("title", pa.string()), ("level", pa.int32()), ("start", pa.int64()), ("html", pa.string())])


def _assembled(table: pa.Table) -> Iterator[dict]:
    rows = sorted(table.to_pylist(), key=lambda r: -1 if r["record"] is None else r["record"])
    bad = next((r for r in rows if r["error"]), None)
    empty = dict.fromkeys(_CHAPTERS.names) | {"path": rows[0]["path"]}
    book = rows[0]["header"]
    if book:
        empty |= {"book_title": book["title"], "authors": book["authors"], "book_id": book["book_id"], "language": book["language"]}
    if bad:
        yield empty | {"error": bad["error"]}
        return
    images = {r["record"] - book["first_image"] + 1: (r["media_type"], r["data"]) for r in rows if r["kind"] == "image"}
    for chapter in book_chapters(book, b"".join(r["data"] for r in rows if r["kind"] == "text"), images):
        yield empty | chapter


def chapters(records: DataFrame) -> DataFrame:
    """One row per chapter in the order of the text; a book that can't be read, or has a damaged record, is one row with its error."""

    def gather(table: pa.Table) -> pa.Table:
        return pa.Table.from_pylist(list(_assembled(table)), _CHAPTERS)

    return records.where("kind IS NULL OR kind <> 'other'").groupBy("path").applyInArrow(gather, CHAPTERS)


# --- writing, for tests and round trips ------------------------------------------------------------------


def palmdoc_packed(data: bytes) -> bytes:
    """PalmDOC compression of one record: what was seen in the last 2,047 bytes, a space with a letter, or literals."""
    out, seen, i, n = bytearray(), {}, 0, len(data)
    while i < n:
        key = data[i : i + 3]
        back = seen.get(key)
        if len(key) == 3:
            seen[key] = i
        if back is not None and i - back < 2048:
            size = 3
            while size < 10 and i + size < n and data[back + size] == data[i + size]:
                size += 1
            pair = 0x8000 | (i - back) << 3 | size - 3
            out += bytes((pair >> 8, pair & 255))
            i += size
        elif data[i] == 32 and i + 1 < n and 0x40 <= data[i + 1] < 0x80:
            out.append(data[i + 1] | 0x80)
            i += 2
        elif data[i] == 0 or 9 <= data[i] < 0x80:
            out.append(data[i])
            i += 1
        else:
            size = next((k for k in range(1, min(8, n - i)) if data[i + k] == 0 or 9 <= data[i + k] < 0x80), min(8, n - i))
            out += bytes([size]) + data[i : i + size]
            i += size
    return bytes(out)


def packed_book(title: str, authors: list[str], parts: list[tuple[str, str]], packing: int = 2, version: int = 6, locked: int = 0, images: tuple = (), trailing: int = 0) -> bytes:
    """A book of ``parts`` (title, HTML) with a table of contents, as the bytes of a file."""
    front = b'<html><head><guide><reference type="toc" title="TOC" filepos=%010d /></guide></head><body>'
    bodies, at, starts = [], len(front % 0), []
    for _, html in parts:
        starts.append(at)
        bodies.append(html.encode())
        at += len(bodies[-1])
    links = "".join(f"<p><a filepos={s:010d}>{t}</a></p>" for s, (t, _) in zip(starts, parts, strict=True))
    text = front % at + b"".join(bodies) + links.encode() + b"</body></html>"
    pieces = [text[i : i + 4096] for i in range(0, len(text), 4096)]
    more = [(EXTH["author"], a) for a in authors] + [(EXTH["title"], title)]
    further = b"".join(struct.pack(">II", k, 8 + len(v.encode())) + v.encode() for k, v in more)
    first = bytearray(248)
    struct.pack_into(">HxxIHHH", first, 0, packing, len(text), len(pieces), 4096, locked)
    struct.pack_into(">4sIIIII", first, 16, b"MOBI", 232, 2, 65001, 1, version)
    first[0x54:0x5C] = struct.pack(">II", 248 + 12 + len(further), len(title.encode()))
    struct.pack_into(">I", first, 0x6C, 1 + len(pieces))
    struct.pack_into(">I", first, 0x80, 0x40)
    struct.pack_into(">H", first, 0xF2, trailing)
    first += struct.pack(">4sII", b"EXTH", 12 + len(further), len(more)) + further + title.encode()
    tail = b"\x81" * (trailing >> 1 & 1) + b"\x00" * (trailing & 1)
    made = [bytes(first), *((palmdoc_packed(p) if packing == 2 else p) + tail[::-1] for p in pieces), *images]
    at, table = 78 + 8 * len(made) + 2, b""
    for k, r in enumerate(made):
        table += struct.pack(">II", at, k)
        at += len(r)
    return title.encode()[:31].ljust(32, b"\0") + bytes(28) + b"BOOKMOBI" + bytes(8) + struct.pack(">H", len(made)) + table + bytes(2) + b"".join(made)
