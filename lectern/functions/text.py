"""Text functions. Column expressions where Spark has them, Arrow functions for Unicode normal forms and entities."""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


#: Texts of an Arrow batch that are Python objects at a time.
STEP = 100


def by_steps(texts: pa.Array, of: Callable, kind: pa.DataType) -> pa.Array:
    """``of`` each text as one array, a few texts at a time: a batch may hold thousands of long ones."""
    parts = [pa.array([of(t) for t in texts.slice(i, STEP).to_pylist()], kind) for i in range(0, len(texts), STEP)]
    return pa.concat_arrays(parts) if parts else pa.array([], kind)


@F.arrow_udf(StringType())
def _nfkc(texts: pa.Array) -> pa.Array:
    return by_steps(texts, lambda t: t if t is None else unicodedata.normalize("NFKC", t), pa.string())


def nfkc(text: Column) -> Column:
    """Unicode normal form NFKC; ASCII passes as it is and isn't sent to Python."""
    plain = F.octet_length(text) == F.length(text)
    return F.when(plain, text).otherwise(_nfkc(F.when(~plain, text)))


@F.arrow_udf(StringType())
def unescape(texts: pa.Array) -> pa.Array:
    """HTML entities as their characters."""
    return by_steps(texts, lambda t: t if t is None or "&" not in t else html.unescape(t), pa.string())


def collapse(text: Column) -> Column:
    """White space runs as one space, none at the ends."""
    return F.trim(F.regexp_replace(text, r"[\s 　]+", " "))


def normalise(text: Column) -> Column:
    return collapse(nfkc(text))


def phrase_key(text: Column) -> Column:
    return F.lower(normalise(text))


def phrase_key_of(phrase: str) -> Column:
    """The key of one given phrase, which no row needs Python for."""
    return F.lower(collapse(F.lit(unicodedata.normalize("NFKC", phrase))))


def trim_spaces(text: Column) -> Column:
    """Without the spaces of any width at the ends."""
    return F.regexp_replace(text, r"^\p{Zs}+|\p{Zs}+\z", "")


def strip_tags(markup: Column, entities: tuple[str, ...] | None = None) -> Column:
    """Tags as spaces, entities as characters, white space collapsed.

    With ``entities`` only these are replaced, each as a whole with its semicolon and amp last, so that a cut "&amp" stays; then ASCII white space alone collapses.
    """
    plain = F.regexp_replace(markup, "<[^>]*>", " ")
    if entities is None:
        return collapse(unescape(plain))
    for name in sorted(entities, key=lambda e: e == "amp"):
        plain = F.replace(plain, F.lit(f"&{name};"), F.lit(html.unescape(f"&{name};")))
    return trim_spaces(F.regexp_replace(plain, r"[ \t\n\f\r]+", " "))


def html_lines(markup: Column) -> Column:
    """Plain text with a line end at <br> and block ends, the common entities, at most one blank line."""
    t = F.regexp_replace(markup, r"(?i)<br\s*/?>|</(p|div|li|h[1-6]|tr|blockquote)\s*>", "\n")
    t = F.regexp_replace(t, "<[^>]*>", "")
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
        t = F.replace(t, F.lit(entity), F.lit(char))
    return F.trim(F.regexp_replace(t, "\n{3,}", "\n\n"))


def escape(text: Column, quotes: bool = True) -> Column:
    """& < > and, with ``quotes``, both quotes as entities."""
    pairs = [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")] + ([('"', "&quot;"), ("'", "&#39;")] if quotes else [])
    for char, entity in pairs:
        text = F.replace(text, F.lit(char), F.lit(entity))
    return text


def excerpt(text: Column, terms: list[str], size: int = 200, lead: float = 0.3) -> Column:
    """``size`` characters around the first place where any term is, a share of them before it, with … where text is left out."""
    at = F.array_min(F.filter(F.array(*[F.instr(F.lower(text), t.lower()) for t in terms]), lambda p: p > 0))
    start = F.greatest(F.lit(1), F.coalesce(at, F.lit(1)) - int(size * lead))
    cut = F.substring(text, start, F.lit(size))
    return F.concat(F.when(start > 1, "…").otherwise(""), cut, F.when(start + size - 1 < F.length(text), "…").otherwise(""))


def highlight(text: Column, terms: list[str], before: str = "<mark>", after: str = "</mark>") -> Column:
    """The text with all occurrences of the terms, in any case, in marks; of terms that overlap the longest wins."""
    found = "|".join(re.escape(t) for t in sorted(terms, key=len, reverse=True))
    return F.regexp_replace(text, f"(?i)({found})", f"{before}$1{after}")


def split_marks(text: Column) -> Column:
    """(text, marked) parts of a highlighted text, in order; empty ones left out."""
    parts = F.split(text, "</?mark>")
    return F.filter(F.transform(parts, lambda p, i: F.struct(p.alias("text"), (i % 2 == 1).alias("marked"))), lambda x: x["text"] != "")


def safe_file_name(name: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(normalise(name), r'[\\/:*?"<>|\x00-\x1f]+', "-"), r"[. ]+$", "")


def slug(text: Column) -> Column:
    """Letters, digits, _, - and CJK characters stay, runs of others are one -, at most 100 characters."""
    return F.substring(F.regexp_replace(text, r"[^0-9A-Za-z_\-一-鿿]+", "-"), 1, 100)


#: Chinese digits and units.
DIGITS = {"零": 0, "〇": 0, "一": 1, "二": 2, "两": 2, "三": 3, "四": 4, "五": 5, "六": 6, "七": 7, "八": 8, "九": 9}
TEN, HUNDRED = "十", "百"


def chinese_number(text: Column) -> Column:
    """Arabic digits, positional Chinese digits, or Chinese numbers up to 999 as an integer; null for anything else."""
    as_digits = F.translate(text, "".join(DIGITS), "".join(str(v) for v in DIGITS.values()))
    part = lambda pattern: F.regexp_extract(as_digits, pattern, 1)
    unit = lambda pattern, mark: F.when(F.contains(as_digits, F.lit(mark)), F.when(part(pattern) == "", 1).otherwise(part(pattern).cast("int"))).otherwise(0)
    hundreds, tens = unit(f"([0-9]?){HUNDRED}", HUNDRED), unit(f"([1-9]?){TEN}", TEN)
    ones = F.regexp_extract(as_digits, f"(?:{TEN}|{HUNDRED}0?)([1-9])$", 1)
    composed = hundreds * 100 + tens * 10 + F.when(ones == "", 0).otherwise(ones.cast("int"))
    return F.when(as_digits.rlike("^[0-9]{1,9}$"), as_digits.cast("int")).when(as_digits.rlike(f"^(?:[1-9]{HUNDRED}0?)?(?:[1-9]?{TEN})?[1-9]?$") & (as_digits != ""), composed)


def to_chinese(n: Column) -> Column:
    """0 to 99 in Chinese; null beyond."""
    digits = "零一二三四五六七八九"
    digit = lambda c: F.substring(F.lit(digits), c + 1, F.lit(1))
    tens, ones = F.floor(n / 10).cast("int"), (n % 10).cast("int")
    many = F.concat(F.when(tens > 1, digit(tens)).otherwise(""), F.lit(TEN), F.when(ones > 0, digit(ones)).otherwise(""))
    return F.when(n.between(0, 9), digit(n.cast("int"))).when(n.between(10, 99), many)


def invitation_code(code: Column) -> Column:
    return F.upper(F.regexp_replace(F.trim(code), "[^a-zA-Z0-9]", ""))


def with_discussion(url: Column, key: Column, most: int = 1024) -> Column:
    """The url with a ``discussion`` parameter, or as it was if that would be too long."""
    new = F.concat(url, F.when(F.instr(url, "?") > 0, "&").otherwise("?"), F.lit("discussion="), key)
    return F.when(F.length(new) > most, url).otherwise(new)


def fuzzy_score(title: Column, query: str) -> Column:
    """Lower is better: place of the query in the title, else 100 and the gaps of it as a subsequence; null for no match, 0 for no query."""
    q = query.strip().lower()
    if not q:
        return F.lit(0.0)
    t = F.lower(title)
    spare = (F.length(t) - len(q)) / 100.0
    chars = F.array(*[F.lit(c) for c in q])
    start = F.struct(F.lit(0).alias("at"), F.lit(0).alias("gaps"))

    def step(acc, c):
        near = F.instr(F.substring(t, acc["at"] + 1, F.length(t)), c)
        gap = F.when(acc["at"] > 0, near - 1).otherwise(0)
        return F.when((acc["at"] < 0) | (near == 0), F.struct(F.lit(-1).alias("at"), F.lit(0).alias("gaps"))).otherwise(F.struct((acc["at"] + near).alias("at"), (acc["gaps"] + gap).alias("gaps")))

    walked = F.aggregate(chars, start, step)
    return F.when(F.instr(t, q) > 0, F.instr(t, q) - 1 + spare).when(walked["at"] > 0, 100.0 + walked["gaps"] + spare)


def local_path(path: Column) -> Column:
    """Whether it is a path of this site: starts with one /, no backslash or line end, at most 1,024 characters."""
    return path.startswith("/") & ~path.startswith("//") & ~path.rlike(r"[\\\r\n]") & (F.length(path) <= 1024)


def srcset_urls(srcset: Column) -> Column:
    return F.filter(F.transform(F.split(srcset, ","), lambda p: F.split(F.trim(p), r"\s+")[0]), lambda u: u != "")


def reading_minutes(text: Column, per_minute: int = 450) -> Column:
    return F.greatest(F.lit(1), F.ceil(F.length(F.regexp_replace(text, r"\s", "")) / per_minute)).cast("int")


def issue_label(issue: Column) -> Column:
    return F.when(issue.rlike("^[0-9]{8}$"), F.regexp_replace(issue, "^(....)(..)(..)$", "$1-$2-$3")).when(issue.rlike("^[0-9]{6}$"), F.concat(F.substring(issue, 1, 4), F.lit(" no. "), F.substring(issue, 5, 2).cast("int").cast("string"))).otherwise(issue)


def markdown_cell(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" "))


def isbn(identifier: Column) -> Column:
    """10 or 13 digits of an ISBN in an identifier, without hyphens; null where there is none."""
    return F.nullif(F.regexp_extract(F.replace(identifier, F.lit("-")), r"(97[89][0-9]{10}|[0-9]{9}[0-9Xx])(?![0-9])", 1), F.lit(""))


def is_page_mark(text: Column, bare: bool = False) -> Column:
    """Nothing but a page number, in digits or Roman numerals, perhaps with dots or dashes around it; ``bare``: with nothing around it, as "Vi." may be a sentence."""
    if bare:
        return text.rlike(r"(?i)^([0-9]{1,4}|[ivxlc]{1,7})\z")
    return text.rlike(r"(?i)^[\s.·\-–—]*([0-9]{1,4}|[ivxlc]{1,7})[\s.·\-–—]*$")


def chinese_date(text: Column) -> Column:
    """Year, month and day in Chinese or Arabic digits as YYYY-MM-DD; 廿 is twenty and 卅 thirty; null for anything else."""
    n = "[零〇一二三四五六七八九十廿卅0-9]+"
    pattern = f"({n})年({n})月({n})日"
    plain = lambda i: F.replace(F.replace(F.regexp_extract(text, pattern, i), F.lit("廿"), F.lit("二十")), F.lit("卅"), F.lit("三十"))
    y, m, d = (chinese_number(plain(i)) for i in (1, 2, 3))
    told = F.concat_ws("-", F.lpad(y.cast("string"), 4, "0"), F.lpad(m.cast("string"), 2, "0"), F.lpad(d.cast("string"), 2, "0"))
    return F.when(text.rlike(pattern) & y.isNotNull() & m.isNotNull() & d.isNotNull(), F.date_format(F.try_to_date(told), "yyyy-MM-dd"))


def author_in_name(name: Column, ignored: str = r"(?i)library|archive|\d") -> Column:
    """The last bracketed part of a file name that isn't one of the ignored kind; null without one."""
    found = F.filter(F.transform(F.regexp_extract_all(name, F.lit(r"[(（]([^()（）]+)[)）]"), F.lit(1)), lambda x: F.trim(x)), lambda x: ~x.rlike(ignored))
    return F.try_element_at(found, F.lit(-1))


def chosen_title(package: Column, file_name: Column) -> Column:
    """The package's title, or the file's where that is missing or only the beginning of it."""
    cut = (F.length(package) < F.length(file_name)) & file_name.startswith(package)
    return F.when((F.coalesce(F.trim(package), F.lit("")) == "") | cut, file_name).otherwise(package)


def code_from_seed(seed: Column, length: int = 8, alphabet: str = "ABCDEFGHJKLMNPQRSTUVWXYZ23456789") -> Column:
    """Characters that the bytes of the seed's SHA-256 choose."""
    digits = F.sha2(seed, 256)
    one = lambda i: F.substring(F.lit(alphabet), (F.conv(F.substring(digits, 2 * i + 1, 2), 16, 10).cast("int") % len(alphabet)) + 1, F.lit(1))
    return F.concat(*[one(i) for i in range(length)])


def canonical_url(url: Column) -> Column:
    """https, with a scheme, without a web archive's prefix or &amp;."""
    u = F.replace(F.trim(url), F.lit("&amp;"), F.lit("&"))
    u = F.regexp_replace(u, r"^https?://[^/]*/web/[0-9]+[a-z_]*/", "")
    return F.regexp_replace(F.regexp_replace(u, "^//", "https://"), "^http://", "https://")


def image_widths(width: Column, height: Column, widths: tuple[int, ...]) -> Column:
    """(width, height) of each of the widths up to the image's own, in its ratio."""
    kept = F.filter(F.array(*map(F.lit, widths)), lambda w: w <= width)
    return F.transform(kept, lambda w: F.struct(w.alias("width"), F.round(height * w / width).cast("int").alias("height")))


def supplement(number: Column, ordinary: int = 90) -> Column:
    return F.when(number > ordinary, F.concat(F.lit("supplement "), (number % ordinary).cast("string"))).otherwise(F.concat(F.lit("no. "), number.cast("string")))


@F.arrow_udf(StringType())
def resolve_path(base: pa.Array, path: pa.Array) -> pa.Array:
    """``path`` from the folder of ``base``; null where it leaves the root."""
    import posixpath

    out = []
    for b, p in zip(base.to_pylist(), path.to_pylist(), strict=True):
        full = None if p is None else posixpath.normpath(posixpath.join(posixpath.dirname(b or ""), p))
        out.append(None if full is None or full.startswith(("/", "..")) else full)
    return pa.array(out, pa.string())


def anchor_key(*parts: Column) -> Column:
    """SHA-256 of the parts as a JSON array."""
    return F.sha2(F.to_json(F.array(*[p.cast("string") for p in parts])), 256)


def source_page(number: Column, index: Column, offset: Column) -> Column:
    """A page number of at least 1 plus the offset, else the index from 0, else the first page."""
    return F.coalesce(F.when(number >= 1, number + offset), index + 1 + offset, offset + 1)


def without_assets(markup: Column, missing: Column) -> Column:
    """Markup without the figures and spans of missing assets."""
    gone = lambda i: F.concat(F.lit(r'(?s)<(figure|span)[^>]*data-asset="'), i, F.lit(r'"[^>]*>.*?</\1>'))
    return F.aggregate(missing, markup, lambda m, i: F.regexp_replace(m, gone(i), ""))


def item_id(dataset: Column, key: Column) -> Column:
    return F.concat_ws(":", dataset, key)
