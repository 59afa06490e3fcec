import base64
import hashlib

import pytest
from pyspark.sql import functions as F

from lectern.functions import codecs, dates, hashing, markup, text


def one(spark, column, **values):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()] or [F.lit(1).alias("_")])
    return row.select(column.alias("x")).first().x


@pytest.mark.parametrize("given,want", [("四", 4), ("二十八", 28), ("一百二十", 120), ("37", 37), ("十", 10), ("十二", 12), ("一百零三", 103), ("二百", 200), ("一九四六", 1946), ("卷", None), ("", None)])
def test_chinese_number(spark, given, want):
    assert one(spark, text.chinese_number(F.col("v")), v=given) == want


@pytest.mark.parametrize("n,want", [(0, "零"), (7, "七"), (10, "十"), (12, "十二"), (30, "三十"), (99, "九十九"), (100, None)])
def test_to_chinese(spark, n, want):
    assert one(spark, text.to_chinese(F.col("v")), v=n) == want


def test_text(spark):
    assert one(spark, text.normalise(F.col("v")), v="  Ａ　b\n c ") == "A b c"
    assert one(spark, text.strip_tags(F.col("v")), v="<p>a&amp;b</p><p>c</p>") == "a&b c"
    assert one(spark, text.html_lines(F.col("v")), v="<p>a</p>b<br/>c &lt;d") == "a\nb\nc <d"
    assert one(spark, text.safe_file_name(F.col("v")), v="a/b: c?. ") == "a-b- c-"
    assert one(spark, text.local_path(F.col("v")), v="/a/b") and not one(spark, text.local_path(F.col("v")), v="//a")
    assert one(spark, text.isbn(F.col("v")), v="urn:isbn:978-7-02-000220-7") == "9787020002207"
    assert one(spark, text.srcset_urls(F.col("v")), v="a.jpg 1x, b.jpg 2x") == ["a.jpg", "b.jpg"]
    assert [tuple(r) for r in one(spark, text.split_marks(F.col("v")), v="a <mark>b</mark> c")] == [("a ", False), ("b", True), (" c", False)]
    assert one(spark, text.is_page_mark(F.col("v")), v="- xii -") and not one(spark, text.is_page_mark(F.col("v")), v="chapter 2")
    assert one(spark, text.fuzzy_score(F.col("v"), "ace"), v="abcde") == pytest.approx(102.02)
    assert one(spark, text.fuzzy_score(F.col("v"), "xyz"), v="abcde") is None


@pytest.mark.parametrize(("given", "want"), [("<b>x</b> and&amp y&amp;&am", "x and&amp y&&am"), ("&amp;lt; &lt;&gt;&#39;\n z&nbsp; ", "&lt; <>&#39; z"), (None, None)])
def test_entities_of_their_names_alone(spark, given, want):
    """As the SQL of strip_tags_plain has it; with all entities a cut one is one too."""
    import duckdb

    from lectern.plans.functions import STRIP_TAGS

    assert one(spark, text.strip_tags(F.col("v"), ("amp", "lt", "gt", "nbsp")), v=given or F.lit(given).cast("string")) == want
    con = duckdb.connect()
    con.execute("CREATE TABLE pages AS SELECT 1 AS page_id, CAST(? AS VARCHAR) AS html", [given])
    assert con.sql(STRIP_TAGS).fetchall() == [(1, want)]


def test_dates(spark):
    told = lambda v: str(one(spark, dates.feed_time(F.col("v")).cast("string"), v=v))
    assert told("Wed, 02 Oct 2024 13:00:00 GMT") == "2024-10-02 13:00:00"
    assert told("02 Oct 2024 13:00:00 +0800") == "2024-10-02 05:00:00"
    assert told("2024-10-02T13:00:00+08:00") == "2024-10-02 05:00:00"
    assert told("soon") == "None"
    assert one(spark, dates.compact_date(F.col("v")), v="19460515") == "1946-05-15"


def test_hashing(spark):
    import hashlib

    want = int.from_bytes(hashlib.sha256(b"s:u").digest()[:4], "big") % 100
    assert one(spark, hashing.bucket(F.col("v")), v="s:u") == want
    assert one(spark, hashing.canonical_hash("r-", 8, b=F.lit("x"), a=F.lit(1))) == "r-" + hashlib.sha256(b'{"a":1,"b":"x"}').hexdigest()[:8]


def test_codecs(spark):
    data = bytes(range(256)) * 3
    assert codecs.mask(codecs.mask(data, "k"), "k") == data
    assert codecs.mask(data, "k")[100:] == codecs.mask(data[100:], "k", 100)
    assert codecs.fnv1a(b"a") == 0xE40C292C
    assert codecs.palmdoc(b"abc" + bytes([0x80, 0x18 | 2]) + bytes([0xC1, 2]) + b"\x80\x81") == b"abcabcab A\x80\x81"
    with pytest.raises(ValueError):
        codecs.palmdoc(b"\x80")
    assert one(spark, codecs.media_type(F.col("v")), v=bytearray(b"%PDF-1.7")) == "application/pdf"
    assert one(spark, codecs.percent_text(F.lit(0.667))) == "66.7%"


def test_markup(spark):
    page = '<h1 id="a">One</h1><p> two  x </p><blockquote><p>three</p></blockquote><p> </p><script>no</script>'
    assert markup.blocks_of(page) == [("a", "One"), (None, "two x"), (None, "three")]
    ld = '<html><head><script type="application/ld+json">{"@graph": [{"@type": ["NewsArticle"], "headline": "H", "author": [{"name": "A"}, "B", {"name": "A"}]}]}</script></head><body><h1>X</h1><article><p>Body</p><aside>no</aside></article><p>out</p></body></html>'
    a = markup.article_of(ld)
    assert (a["title"], a["authors"], a["body"]) == ("H", ["A", "B"], "Body")
    assert markup.article_of(None)["body"] == ""


def test_masks_byte_by_byte():
    """Both masks against the rule position by position in plain integers."""

    def byte(position, seed):
        x = (position + 0x9E3779B9) % 2**32 ^ seed
        x = (x ^ x >> 16) * 0x7FEB352D % 2**32
        x = (x ^ x >> 15) * 0x846CA68B % 2**32
        return (x ^ x >> 16) & 255

    data = bytes(range(256)) * 3
    for offset in (0, 5, 2**32 - 100):
        seed = codecs.fnv1a(b"a/b.json") ^ 0x4A4F5831
        want = bytes(d ^ byte((offset + i) % 2**32, seed) for i, d in enumerate(data))
        assert codecs.mask(data, "a/b.json", offset) == codecs.mask(data, "\\a\\b.json", offset) == want
        assert codecs.page_mask(data, offset) == bytes(d ^ byte((offset + i) % 2**32, 0x4A4F4A4F) for i, d in enumerate(data))


def test_source_ids_and_parts(spark):
    rows = spark.createDataFrame([("36",), ("12345678901234567890",), ("b-1",), ("é",), ("",), (None,)], "v string")
    got = [r.x for r in rows.select(codecs.source_id(F.col("v")).alias("x")).collect()]

    def plain(v):
        d = hashlib.md5(v.encode()).hexdigest()
        digits = all(c in "0123456789" for c in v)
        parts = [f"{int(v[i : i + 9]):x}" for i in range(0, len(v), 9)] if digits else ["".join(f"{ord(c):x}" for c in v)]
        head = f"{d[:3]}{3 if digits else 4}2{d[-2:]}" + "g".join(f"{len(p):02x}{p}" for p in parts)
        head += d[: max(0, 20 - len(head))]
        return head + hashlib.md5(head.encode()).hexdigest()[:3]

    assert got[0] == "19c3222022419ca14e7eef7" and got == [*map(plain, ["36", "12345678901234567890", "b-1", "é", ""]), None]
    assert codecs.unwrapped_parts(["A" * 32 + "xSGk"]) == "Hi"
    told = spark.createDataFrame([(["A" * 32 + "xSGk"],), ([None],), ([],)], "p array<string>").select(codecs.parts_text("p").alias("t")).collect()
    assert [r.t for r in told] == ["Hi", None, None]


def swapped(text):
    """A body of parts made by the rule's own inverse: the swaps are found from the characters at the end, which they don't move, and done forwards."""
    body = list(base64.b64encode(text.encode()).decode().rstrip("="))
    n = len(body)
    tail = min(4, -(-n // 10))
    code = "".join(str(int(f"{ord(c):b}", 4)) for c in reversed(body[n - tail :]))
    room = n - tail - 2
    width, places, at = len(str(room)), [], 0
    while len(places) < 10 and at + width < len(code):
        places += [int(code[at : at + width]) % room, int(code[at + 1 : at + 1 + width]) % room]
        at += width
    for i in range(1, len(places), 2):
        for k in (0, 1):
            a, b = places[i] + k, places[i - 1] + k
            body[a], body[b] = body[b], body[a]
    return "x" + "".join(body)


def test_parts_with_swaps():
    for text in ("a text of some length that needs its swaps undone", "第一章 开始" * 30, "0123456789" * 7):
        body = swapped(text)
        cut = len(body) // 2
        assert codecs.unwrapped_parts(["S" * 32 + body[:cut], "T" * 32 + body[cut:]]) == text


def test_a_few_texts_at_a_time():
    """A batch's texts are not all Python objects at once, whatever is made of them."""
    import pyarrow as pa

    seen, sizes = [], []

    def of(t):
        seen.append(t)
        return t

    class Texts:
        def __len__(self):
            return 1234

        def slice(self, at, n):
            sizes.append(n)
            return pa.array([str(i) for i in range(at, min(at + n, 1234))])

    assert text.by_steps(Texts(), of, pa.string()).to_pylist() == [str(i) for i in range(1234)]
    assert len(seen) == 1234 and max(sizes) <= 100
    assert text.by_steps(pa.array([], pa.string()), of, pa.string()).to_pylist() == []


def test_ascii_is_not_sent_to_python(spark):
    df = spark.createDataFrame([("  LICENSE b",), ("Ｌicense　x",), (None,), ("lic",)], "v string")
    assert [r.k for r in df.select(text.phrase_key(F.col("v")).alias("k")).collect()] == ["license b", "license x", None, "lic"]
    from lectern.operators import search

    found = search.in_book(df, [F.col("v")], "v", " ＬICENSE ")
    assert sorted(r.v for r in found.collect()) == ["  LICENSE b", "Ｌicense　x"] and search.in_book(df, [F.col("v")], "v", " 　 ").count() == 0
    assert found._jdf.queryExecution().optimizedPlan().toString().count("_nfkc(") == 1  # the phrase itself needs no Python
