"""Sanitised chapters and footnotes of plain text."""

import random
import re

from pyspark.sql import functions as F

from lectern.functions.sanitise import sanitised
from lectern.operators import notes


def test_tags_classes_and_roles():
    clean = lambda m: sanitised("c", m)["html"]
    assert clean("<head><title>x</title></head><script>1<2</script><p onclick='x' style='color:red'>a &amp; <b>b</b><i>c</i></p>") == "<p>a &amp; <strong>b</strong><em>c</em></p>"
    assert clean('<div><span class="super">1</span><span>x</span></div>') == "<sup>1</sup>x"
    assert clean('<p class="author">me</p>') == '<p data-role="attribution" data-indent="none" data-align="right">me</p>'
    assert clean('<p style="text-align: center">x<br/>y') == '<p data-align="center">x<br>y</p>'
    assert clean('<div class="border"><p>x</p></div>') == '<blockquote data-role="aside"><p>x</p></blockquote>'
    assert clean('<p class="quotation-1">x</p>') == '<blockquote data-font="kai">x</blockquote>'
    assert clean('<a href="javascript:x">a</a><a href="https://x.org/">b</a>') == 'a<a href="https://x.org/">b</a>'
    assert sanitised(None, None) == {"html": "", "notes": [], "assets": []}


def test_images_and_notes():
    out = sanitised("c", '<h1 class="chapterTitle">T<img class="qqreader-footnote" alt="on the title"></h1><p>a<span data-wr-footernote="first  note">x</span>b<img src="https://x.org/a.png" alt="A map"><img src="a.png" alt="lost"><img src="https://x.org/h.png" class="h-pic"></p>')
    assert [(n["label"], n["body"]) for n in out["notes"]] == [("*", "on the title"), ("1", "first note")]
    assert [a["url"] for a in out["assets"]] == ["https://x.org/a.png", "https://x.org/h.png"]
    assert "<figcaption>A map</figcaption></figure><p>lost<span data-asset-id=" in out["html"] and 'data-role="inline-image"' in out["html"]
    assert out["html"].count("<sup data-annotation-id=") == 2


def plain(blocks):
    """Definitions in order, each taking the last marker before it that is left."""
    found = {o: re.match(r"\[(\d+)\] ([^—].*)", t) for o, t in blocks}
    left = [(o, m.start(), m[1]) for o, t in blocks if not found[o] for m in re.finditer(r"\[(\d+)\]", t)]
    out = {}
    for o, m in found.items():
        if m:
            before = [x for x in left if x[0] < o and x[2] == m[1]]
            out[o] = before[-1][0] if before else None
            if before:
                left.remove(before[-1])
    return out


def test_footnotes_against_a_plain_search(spark):
    rng, rows, want = random.Random(5), [], {}
    for g in range(30):
        texts = [rng.choice(["see [1] and [2]", "[1] one", "[2] two", "x [1] y [1]", "none", "[1] ——"]) for _ in range(rng.randrange(1, 25))]
        blocks = list(enumerate(texts))
        rows += [(g, o, t) for o, t in blocks]
        want |= {(g, o): m for o, m in plain(blocks).items()}
    got = {(r.g, r.o): r.marker for r in notes.footnotes(spark.createDataFrame(rows, "g int, o int, t string"), "g", "o", "t").collect()}
    assert {k: got[k] for k in want} == want and len(want) > 20


def test_stars_round_marks_and_nulls(spark):
    rows = [(0, "head (3) x"), (1, "* by the editor"), (2, "(3) round"), (3, None), (4, "***")]
    df = spark.createDataFrame([("g", *r) for r in rows], "g string, o int, t string")
    assert {(r.label, r.body, r.kind, r.marker) for r in notes.footnotes(df, "g", "o", "t", F.col("o") == 2).collect()} == {("*", "by the editor", "editor-note", 0), ("3", "round", "footnote", 0)}
    assert notes.footnotes(df.limit(0), "g", "o", "t").count() == 0
