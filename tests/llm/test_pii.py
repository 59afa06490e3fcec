import hashlib
import random
import re

import pytest

from lectern.llm import pii
from lectern.llm.common import Scratch

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def plain(text):
    out = [(0, *m.span()) for m in EMAIL.finditer(text)]
    out += [(1, *m.span()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m.group().split("."))]
    for m in CARD.finditer(text):
        d = re.sub("[ -]", "", m.group())
        if 16 <= len(d) <= 19 and sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(d[::-1])) % 10 == 0:
            out.append((2, *m.span()))
    return out + [(3, *m.span()) for m in PHONE.finditer(text) if 8 <= sum(c.isdigit() for c in m.group()) <= 15]


def test_rules_against_plain_patterns():
    rng = random.Random(3)
    bits = ["a@b.co", "@", ".", "x", "1.2.3.4", "999.1.1.1", "4111 1111 1111 1111", "+1 (555) 555-1234", " ", "-", "7", "_", "é", "+", "%", "\n", "0", "("]
    for _ in range(4000):
        text = "".join(rng.choice(bits) for _ in range(rng.randrange(1, 14)))
        assert pii.rule_spans(text) == plain(text), text


def test_long_runs_are_linear():
    for text in ("a" * 300_000, "1" * 300_000, "1 " * 150_000, "+" * 300_000, "a@" * 150_000, "1." * 150_000):
        pii.rule_spans(text)
        list(pii.tokens(text, []))


@pytest.fixture
def found(spark):
    rows = [(i, f'word{i}x said key id = "{"%040x" % (i * 7919 + (0xabcdef << 130))}" ok', "s") for i in range(6)]
    rows += [(10, 'and key id = "AB-12345-XYZ" ok', "s"), (11, "plain 12345678 words", "s"), (12, None, "s"), (13, "", "s"), (14, "é mail a@b.co now", "s"), (14, "é mail a@b.co now", "s")]
    df = spark.createDataFrame(rows, "doc_id long, text string, spans string")
    return [r.asDict() for r in pii.digests(df, Scratch(spark, "t")).collect()]


def test_patterns_find_unseen_identifiers(found):
    by = {r["doc_id"]: r for r in found}
    assert by[10]["spans"] == "secret:14:26"
    assert by[11]["spans"] == by[12]["spans"] == by[13]["spans"] == ""
    assert all(by[i]["spans"].startswith("secret:") for i in range(6))
    assert by[14]["spans"] == "email:7:13" and by[14]["n_email"] == 1
    assert by[14]["base_sha256"] == hashlib.sha256(b"email:7:13").hexdigest()
    assert len(found) == 12


def test_empty_table(spark):
    assert pii.digests(spark.createDataFrame([], "doc_id long, text string"), Scratch(spark, "t")).count() == 0


def plain_graph(edges, rounds=pii.ROUNDS):
    """The scores of patterns and instances with dictionaries, edge by edge."""
    pairs = {(p, i) for p, i, _ in edges}
    seeds = {}
    for _, i, k in edges:
        if k is not None:
            seeds[i] = (min(k, seeds.get(i, (k, 1.0))[0]), 1.0)
    scores, kept = dict(seeds), {}
    for _ in range(rounds):
        kept = {}
        for p in {p for p, _ in pairs}:
            held = [i for q, i in pairs if q == p]
            sums = {}
            for i in held:
                if i in scores:
                    k, x = scores[i]
                    sums[k] = sums.get(k, 0.0) + x
            rated = [(x / (len(held) + 0.5), -k) for k, x in sums.items() if x >= pii.MIN_SUPPORT and x / (len(held) + 0.5) >= pii.MIN_CONFIDENCE]
            if rated:
                conf, k = max(rated)
                kept[p] = (-k, conf)
        scores = dict(seeds)
        for i in {i for _, i in pairs} - set(seeds):
            rated = [(kept[p][1], -kept[p][0]) for p, j in pairs if j == i and p in kept]
            if rated:
                conf, k = max(rated)
                scores[i] = (-k, conf)
    return kept


def test_graph_against_plain_scores(spark):
    rng, found = random.Random(3), 0
    for size in (40, 200):
        kind = {i: rng.choice([0] * 8 + [1] * 8 + [None]) for i in range(size)}
        edges = set()
        for p in range(size // 4):
            likes = rng.choice([0, 1, 0, 1, None])
            for i in rng.sample(range(size), rng.randrange(4, 25)):
                if likes is None or kind[i] in (likes, None) or rng.random() < 0.02:
                    edges.add((p, i, kind[i]))
        df = spark.createDataFrame(sorted(edges, key=str), "pat long, inst long, k int")
        got = {r.pat: (r.kind, round(r.conf, 9)) for r in pii.confident_patterns(df).collect()}
        assert got == {p: (k, round(c, 9)) for p, (k, c) in plain_graph(edges).items()}
        found += len(got)
    assert found > 5


def test_long_secrets_and_the_beginning():
    key = "0a1b2c3d" * 64
    spans = list(pii.tokens(f"key {key} end", []))
    assert spans == [(4, 4 + len(key))] and pii._SECRET.fullmatch(key)
    assert pii._before("call 123456", 5) == ["\x02", "call"] and pii._before("123456", 0) == ["\x02", "\x02"]
    assert pii._before("one two three" + " " * 500 + "123456", 513) == ["two", "three"]


def test_numbers_in_groups_and_addresses_without_a_dot(spark):
    rows = [(i, f"w{i} please call me: +49 171 55512{i}0 ok") for i in range(6)] + [(i + 10, f"w{i} write to - u{i}@mail.example now") for i in range(6)]
    rows += [(20, "é call me: (0171) 555 1234 ok"), (21, "call me: 2024 ok"), (22, "write to - jane.doe@localhost now"), (23, "room 555 12 34 and x@y"), (24, "call me: 0171 555 1234")]
    got = {r.doc_id: r.spans for r in pii.digests(spark.createDataFrame(rows, "doc_id long, text string"), Scratch(spark, "t")).collect()}
    assert got[20] == "phone:11:26" and got[24] == "phone:9:22" and got[22] == "email:11:29"
    assert got[21] == got[23] == ""


def test_spans_stay_apart():
    assert pii.tokens("ab123456@c 0171 555 1234, 12-345-678901 x", [(3, 11, 15)]) == [(0, 10), (26, 39)]
    assert pii.tokens("a@" * 4 + " 12 34 56 78", []) == [(0, 7), (9, 20)]
    for text in ("12 " * 100_000, "12-" * 100_000 + "a", "(12)" * 100_000, "@" * 300_000):
        pii.tokens(text, [])
