"""EPUB books as rows: one per chapter file of the spine."""

from __future__ import annotations

import io
import posixpath
import xml.etree.ElementTree as ET
import zipfile
import zlib
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructType


def _local(tag: str) -> str:
    return tag.rsplit("}", 1)[-1]


def _all(root: ET.Element, name: str) -> list[ET.Element]:
    return [e for e in root.iter() if isinstance(e.tag, str) and _local(e.tag) == name]


def read_epub(data: bytes) -> dict:
    """Title, authors and parts (pos, href, title, html); ``error`` and nothing else for a broken book."""
    try:
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            opf = _all(ET.fromstring(z.read("META-INF/container.xml")), "rootfile")[0].get("full-path")
            package, folder = ET.fromstring(z.read(opf)), posixpath.dirname(opf)
            at = lambda href, base=folder: posixpath.normpath(posixpath.join(base, unquote(href.split("#")[0])))
            manifest = {i.get("id"): i for i in _all(package, "item")}
            titles: dict[str, str] = {}
            nav = next((i for i in manifest.values() if "nav" in (i.get("properties") or "").split()), None)
            ncx = next((i for i in manifest.values() if i.get("media-type") == "application/x-dtbncx+xml"), None)
            if nav is not None:
                place = at(nav.get("href"))
                for a in _all(ET.fromstring(z.read(place)), "a"):
                    if a.get("href"):
                        titles.setdefault(at(a.get("href"), posixpath.dirname(place)), " ".join("".join(a.itertext()).split()))
            elif ncx is not None:
                place = at(ncx.get("href"))
                for p in _all(ET.fromstring(z.read(place)), "navPoint"):
                    src, label = _all(p, "content"), _all(p, "text")
                    if src and label:
                        titles.setdefault(at(src[0].get("src"), posixpath.dirname(place)), " ".join("".join(label[0].itertext()).split()))
            parts, names = [], set(z.namelist())
            for ref in _all(package, "itemref"):
                if (item := manifest.get(ref.get("idref"))) is not None and at(item.get("href")) in names:
                    href = at(item.get("href"))
                    parts.append({"pos": len(parts), "href": href, "title": titles.get(href), "html": z.read(href).decode("utf-8", "replace")})
            text = lambda name: [" ".join("".join(e.itertext()).split()) for e in _all(package, name)]
            return {"title": next(iter(text("title")), None), "authors": text("creator"), "parts": parts, "error": None}
    except (KeyError, IndexError, ValueError, AttributeError, TypeError, RuntimeError, NotImplementedError, EOFError, zlib.error, zipfile.BadZipFile, ET.ParseError) as e:
        return {"title": None, "authors": [], "parts": [], "error": type(e).__name__}


_PART = StructType().add("pos", IntegerType()).add("href", StringType()).add("title", StringType()).add("html", StringType())
_BOOK = StructType().add("title", StringType()).add("authors", ArrayType(StringType())).add("parts", ArrayType(_PART)).add("error", StringType())


@F.arrow_udf(_BOOK)
def _epub(data: pa.Array) -> pa.Array:
    text = pa.string()
    part = pa.struct([("pos", pa.int32()), ("href", text), ("title", text), ("html", text)])
    return pa.array([read_epub(d or b"") for d in data.to_pylist()], pa.struct([("title", text), ("authors", pa.list_(text)), ("parts", pa.list_(part)), ("error", text)]))


def epub_parts(books: DataFrame, content: str = "content") -> DataFrame:
    """``books`` (say of the binaryFile source) with one row per part; a broken book is one row with its error."""
    rest = [c for c in books.columns if c != content]
    opened = books.select(*rest, _epub(F.col(content)).alias("b"))
    return opened.select(*rest, F.col("b.title").alias("book_title"), F.col("b.authors").alias("authors"), F.col("b.error").alias("error"), F.explode_outer("b.parts").alias("p")).select(*rest, "book_title", "authors", "error", "p.*")
