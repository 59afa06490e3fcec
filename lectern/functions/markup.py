"""HTML as blocks and articles, by the standard library's parser inside Arrow functions."""

from __future__ import annotations

import json
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructType

from lectern.functions.text import by_steps

BLOCKS = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote", "li", "pre"}
SKIPPED = {"script", "style", "iframe", "noscript", "template", "head", "title"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
BODY_NOISE = SKIPPED | {"aside", "nav", "footer", "form", "button", "figure"}


class _Blocks(HTMLParser):
    """Outermost blocks with their ids."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out, self.open, self.depth, self.skip = [], None, 0, 0

    def handle_starttag(self, tag, attrs):
        if tag in VOID:
            if self.open is not None and tag == "br":
                self.open[1].append(" ")
            return
        if tag in SKIPPED:
            self.skip += 1
        elif self.open is None and tag in BLOCKS:
            self.open, self.depth = (dict(attrs).get("id"), [], tag), 1
        elif self.open is not None and tag == self.open[2]:
            self.depth += 1

    def handle_endtag(self, tag):
        if tag in SKIPPED:
            self.skip = max(0, self.skip - 1)
        elif self.open is not None and tag == self.open[2]:
            self.depth -= 1
            if not self.depth:
                self.finish()

    def handle_data(self, data):
        if self.open is not None and not self.skip:
            self.open[1].append(data)

    def finish(self):
        if self.open is not None:
            text = " ".join("".join(self.open[1]).split())
            if text:
                self.out.append((self.open[0], text))
        self.open = None


def blocks_of(markup: str | None) -> list[tuple[str | None, str]]:
    p = _Blocks()
    p.feed(markup or "")
    p.close()
    p.finish()
    return p.out


@F.arrow_udf(ArrayType(StructType().add("anchor", StringType()).add("text", StringType())))
def _html_blocks(markup: pa.Array) -> pa.Array:
    kind = pa.list_(pa.struct([("anchor", pa.string()), ("text", pa.string())]))
    return by_steps(markup, lambda m: [{"anchor": a, "text": t} for a, t in blocks_of(m)], kind)


def html_blocks(df: DataFrame, markup: str) -> DataFrame:
    """``df`` with one row per outermost block: ``pos`` from 1, ``anchor``, ``block_text``; blank blocks don't count."""
    return df.withColumn("_b", _html_blocks(F.col(markup))).select(*df.columns, F.posexplode("_b").alias("_p", "_x")).select(*df.columns, (F.col("_p") + 1).alias("pos"), F.col("_x.anchor").alias("anchor"), F.col("_x.text").alias("block_text"))


def text_blocks(df: DataFrame, text: str) -> DataFrame:
    """As ``html_blocks`` for plain text, which blank lines split."""
    parts = F.filter(F.transform(F.split(text, r"\n\s*\n"), lambda p: F.trim(F.regexp_replace(p, r"\s+", " "))), lambda p: p != "")
    return df.select(*df.columns, F.posexplode(parts).alias("_p", "block_text")).select(*df.columns, (F.col("_p") + 1).alias("pos"), F.lit(None).cast("string").alias("anchor"), "block_text")


def find_article(value, depth: int = 0):
    """The first object of type NewsArticle or Article in nested JSON, depth first."""
    if depth > 32:
        return None
    if isinstance(value, dict):
        kind = value.get("@type")
        if {"NewsArticle", "Article"} & set(kind if isinstance(kind, list) else [kind] if isinstance(kind, str) else []):
            return value
    for x in value.values() if isinstance(value, dict) else value if isinstance(value, list) else ():
        if (found := find_article(x, depth + 1)) is not None:
            return found
    return None


def names(value) -> list[str]:
    """Author names of a scalar, an object with a name, or a list of these; each once, in order."""
    out = []
    for v in value if isinstance(value, list) else [value]:
        name = v.get("name") if isinstance(v, dict) else v
        if isinstance(name, str) and name.strip() and name.strip() not in out:
            out.append(name.strip())
    return out


class _Article(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.meta, self.json, self.h1, self.parts, self.stack, self.images = {}, [], [], [], [], []
        self.article_depth = None

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        if tag == "meta" and (key := a.get("property") or a.get("name")):
            self.meta.setdefault(key.lower(), a.get("content") or "")
        if tag == "img" and a.get("src"):
            self.images.append(a["src"])
        if tag in VOID:
            return
        self.stack.append((tag, a.get("type")))
        if tag == "article" and self.article_depth is None:
            self.article_depth, self.parts = len(self.stack), []

    def handle_endtag(self, tag):
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i][0] == tag:
                del self.stack[i:]
                break
        if tag in BLOCKS | {"div"}:
            self.parts.append("\n")

    def handle_data(self, data):
        tags = [t for t, _ in self.stack]
        if tags and tags[-1] == "script":
            if (self.stack[-1][1] or "").lower() == "application/ld+json":
                self.json.append(data)
        elif "h1" in tags:
            self.h1.append(data)
        elif not BODY_NOISE & set(tags) and (self.article_depth is None or "article" in tags):
            self.parts.append(data)


def article_of(markup: str | None) -> dict:
    """Title, description, authors, date, body and images: from JSON-LD, else h1, else meta tags."""
    p = _Article()
    p.feed(markup or "")
    p.close()
    found = {}
    for text in p.json:
        try:
            found = find_article(json.loads(text)) or found
        except ValueError:
            continue
        if found:
            break
    one = lambda *vs: next((" ".join(v.split()) for v in vs if isinstance(v, str) and v.strip()), None)
    body = "\n".join(x for x in (" ".join(line.split()) for line in "".join(p.parts).split("\n")) if x)
    return {
        "title": one(found.get("headline"), "".join(p.h1), p.meta.get("og:title")), "description": one(found.get("description"), p.meta.get("og:description"), p.meta.get("description")),
        "authors": names(found.get("author")) or names(p.meta.get("author")), "published": one(found.get("datePublished"), p.meta.get("article:published_time")), "body": body, "images": list(dict.fromkeys(p.images)),
    }


_MANY = ArrayType(StringType())
_ARTICLE = StructType().add("title", StringType()).add("description", StringType()).add("authors", _MANY).add("published", StringType()).add("body", StringType()).add("images", _MANY)


@F.arrow_udf(_ARTICLE)
def extract_article(markup: pa.Array) -> pa.Array:
    text, many = pa.string(), pa.list_(pa.string())
    kind = pa.struct([("title", text), ("description", text), ("authors", many), ("published", text), ("body", text), ("images", many)])
    return by_steps(markup, article_of, kind)
