import html
import random
import struct

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lectern.functions import codecs
from lectern.sources import mobi, places

PNG = b"\x89PNG\r\n\x1a\n" + b"x" * 9


@settings(max_examples=200, deadline=None)
@given(st.binary(max_size=300), st.integers(1, 4))
def test_packing_round_trip(data, times):
    assert codecs.palmdoc(mobi.palmdoc_packed(data * times)) == data * times


def write(folder, **books):
    for name, data in books.items():
        (folder / f"{name}.mobi").write_bytes(data)
    return str(folder)


@pytest.mark.parametrize("share", [1 << 22, 3000])
def test_round_trip(spark, tmp_path, share):
    """The same rows whether a book's records are in one partition or in many."""
    r = random.Random(3)
    parts = [(f"Part {i} & é", f"<h1>{i}</h1>" + "".join(f"<p>{html.escape(' '.join(r.choice(['wort', 'été', '日本', '<b>']) for _ in range(200)))}</p>" for _ in range(6))) for i in range(7)]
    at = write(tmp_path, a=mobi.packed_book("Ein Buch", ["A. B", "C"], parts), b=mobi.packed_book("Roh", [], parts[:2], packing=1, trailing=3))
    records = mobi.records(spark, at, share)
    assert (records.rdd.getNumPartitions() > 3) == (share == 3000)
    got = mobi.chapters(records).orderBy("path", "pos").collect()
    assert [(c.book_title, c.authors, c.pos, c.title, c.html) for c in got] == [("Ein Buch", ["A. B", "C"], i, t, h) for i, (t, h) in enumerate(parts)] + [("Roh", [], i, t, h) for i, (t, h) in enumerate(parts[:2])]
    assert all(c.error is None and c.level == 1 for c in got)


def test_error_rows(spark, tmp_path):
    good = mobi.packed_book("T", ["A"], [("t", "<p>x</p>")])
    damaged = bytearray(mobi.packed_book("T", [], [("t", "<p>abcabcabcabc</p>")]))
    at = struct.unpack_from(">I", damaged, 78 + 8)[0]
    damaged[at : at + 2] = b"\xbf\xf8"  # reaches back before the start
    table = bytearray(good)
    struct.pack_into(">I", table, 78 + 8, 1)
    book = lambda **k: mobi.packed_book("T", [], [("t", "x")], **k)
    folder = write(
        tmp_path, short=b"x" * 20, empty=b"", records=bytes(table), container=good.replace(b"MOBI\0", b"NONE\0"), locked=book(locked=2), format=book(version=8), packing=book(packing=17480), damaged=bytes(damaged), good=good
    )
    got = {r.path.rsplit("/", 1)[1][:-5]: r for r in mobi.chapters(mobi.records(spark, folder)).collect()}
    want = {k: k for k in ("short", "records", "container", "locked", "format", "packing", "damaged")} | {"empty": "short", "good": None}
    assert {k: r.error for k, r in got.items()} == want
    assert got["good"].html == "<p>x</p>" and got["damaged"].html is None


def test_links_images_levels(spark, tmp_path):
    """Inner links name the chapter of their target; images are found by number; quoted entries lie deeper; entries of one place count once."""
    text = '<html><guide><reference type="toc" filepos=0000000000></guide><p>one <a filepos={b:010d}>go</a></p><p>two <img recindex="00001"> <img recindex="9"></p>'
    b = text.index("<p>two") + 6  # the number is six characters longer than its place here
    body = text.format(b=b)
    b = body.index("<p>two")
    body = text.format(b=b).replace("filepos=0000000000", f"filepos={len(body):010d}")
    toc = f'<a filepos={body.index("<p>one"):010d}>1、 One</a><blockquote><a filepos="{b}">Two <i>x</i></a></blockquote><a filepos={b}>again</a><a filepos=99999>far</a>'
    whole = (body + toc).encode()
    data = bytearray(mobi.packed_book("T", [], [("t", "x" * 500)], packing=1, images=(PNG,)))
    first, record, image = (struct.unpack_from(">I", data, 78 + 8 * k)[0] for k in range(3))
    data[record:image] = whole + b" " * (image - record - len(whole))
    struct.pack_into(">I", data, first + 4, len(whole))
    one, two = mobi.chapters(mobi.records(spark, write(tmp_path, a=bytes(data)))).orderBy("pos").collect()
    assert (one.title, one.level, two.title, two.level) == ("One", 1, "Two x", 2)
    assert f'href="#mobi-filepos-{b}" data-target-id="{two.id}" data-anchor-id="mobi-filepos-{b}"' in one.html and "filepos=0" not in one.html
    assert two.html.startswith(f'<span id="mobi-filepos-{b}"></span><p>two <img src="data:image/png;base64,') and two.html.count("src=") == 1


def test_no_contents():
    book = {"text_length": 99, "utf8": False, "title": "", "first_image": 0}
    assert list(mobi.book_chapters(book, b"caf\xe9 \x93x\x81", {}))[0] | {"id": ""} == {"pos": 0, "id": "", "title": mobi.UNTITLED, "level": 1, "start": 0, "html": "café “x\x81"}


def test_places(tmp_path):
    places.put(f"file:{tmp_path}/a/b.mobi", b"1")
    places.put(f"{tmp_path}/a/c.TXT", b"22")
    assert [(p.rsplit("/", 1)[1], n) for p, n in places.listed(str(tmp_path))] == [("b.mobi", 1), ("c.TXT", 2)]
    assert places.listed(f"file:{tmp_path}", ("mobi",)) == [(f"file:{tmp_path}/a/b.mobi", 1)]
    assert places.opened(f"file://{tmp_path}/a/b.mobi").read() == b"1"
    with pytest.raises(FileNotFoundError):
        places.listed(f"{tmp_path}/none")


def test_no_books(spark, tmp_path):
    assert mobi.chapters(mobi.records(spark, str(tmp_path))).count() == 0


def test_partitions_of_books_are_bounded(tmp_path, monkeypatch):
    from lectern.sources import mobi, places

    monkeypatch.setattr(places, "MOST_PARTS", 6, raising=False)
    for k in range(40):
        (tmp_path / f"{k}.mobi").write_bytes(bytes(1000 if k else 9000))
    shares = mobi.PalmReader(str(tmp_path), 500).partitions()
    assert len(shares) <= 2 * 6 + 1
    assert len({f[0] for s in shares for f in s.files}) == 40
