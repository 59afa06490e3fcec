import hashlib
import random

import pytest

from lectern.operators import assign


def key(s):
    return hashlib.sha256(s.encode()).hexdigest()


def plain(rows):
    """Turn after turn, group after group."""
    names = {}
    for g, n in set(rows):
        names.setdefault(g, []).append(n)
    left = {g: sorted(ns, key=key) for g, ns in names.items()}
    used, out, turn = set(), [], 0
    while True:
        turn, some = turn + 1, False
        for g in sorted(left, key=key):
            while left[g] and left[g][-1] in used:
                left[g].pop()
            if left[g]:
                some = True
                used.add(left[g][-1])
                out.append((g, left[g].pop(), turn, len(out) + 1))
        if not some:
            return out


@pytest.mark.parametrize(("seed", "groups", "names", "n"), [(3, 6, 20, 70)])
def test_as_dealt_one_by_one(spark, seed, groups, names, n):
    r = random.Random(seed)
    rows = [(f"g{r.randrange(groups)}", f"n{r.randrange(names)}") for _ in range(n)]
    got = assign.deal_in_turn(spark.createDataFrame([*rows, (None, "x"), ("g0", None)], "g string, n string"), "g", "n").collect()
    assert sorted((r.g, r.n, r.turn, r.ord) for r in got) == sorted(plain(rows))


def test_every_name_in_every_group(spark):
    rows = [(f"g{g}", f"n{n}") for g in range(2) for n in range(5)]
    got = assign.deal_in_turn(spark.createDataFrame(rows, "g string, n string"), "g", "n").collect()
    assert sorted((r.g, r.n, r.turn, r.ord) for r in got) == sorted(plain(rows))


def test_many_claims_in_few_jobs(spark, monkeypatch, tmp_path):
    """Names that many groups want, by blocks; as many tables are written as blocks need, not as turns do."""
    monkeypatch.setattr(assign, "shared_folder", lambda *_: str(tmp_path / "at"))
    r = random.Random(11)
    rows = [(f"g{g}", f"n{n}") for g in range(12) for n in range(60) if r.random() < 0.8] + [(f"g{g}", f"own{g}-{n}") for g in range(0, 12, 3) for n in range(9)]
    got = assign.deal_in_turn(spark.createDataFrame(rows, "g string, n string"), "g", "n", block=200).collect()
    assert sorted((x.g, x.n, x.turn, x.ord) for x in got) == sorted(plain(rows))
    assert len(list((tmp_path / "at").iterdir())) <= 12


def test_few_tables_for_few_rows(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(assign, "shared_folder", lambda *_: str(tmp_path / "at"))
    rows = [(f"g{g}", f"n{n}") for g in range(4) for n in range(12)]
    got = assign.deal_in_turn(spark.createDataFrame(rows, "g string, n string"), "g", "n").collect()
    assert sorted((x.g, x.n, x.turn, x.ord) for x in got) == sorted(plain(rows))
    assert len(list((tmp_path / "at").iterdir())) <= 6


def test_nothing_to_deal(spark):
    assert assign.deal_in_turn(spark.createDataFrame([], "g string, n string"), "g", "n").count() == 0


def test_quotas(spark):
    r = random.Random(7)
    rows = [(k, f"{k}{r.randrange(3)}", "".join(r.choice("abc") for _ in range(r.choice([2, 3, 5, 6])))) for k in ("animal", "plant") for _ in range(80)]
    curated = [("animal", "abab", 1), ("plant", "cc", 1)]
    frames = spark.createDataFrame(rows, "kind string, group string, name string"), spark.createDataFrame(curated, "kind string, name string, ord int")
    got = assign.quotas(*frames, ["animal", "plant"], 4, 9).collect()
    used, want = {c[1] for c in curated}, {k: [c[1] for c in curated if c[0] == k] for k in ("animal", "plant")}
    for k in ("animal", "plant"):
        for few in (True, False):
            due = 4 - sum(len(n) <= 3 for n in want[k]) if few else 9 - len(want[k])
            dealt = [d[1] for d in plain([(g, n) for kind, g, n in rows if kind == k and (len(n) <= 3) == few and n not in used])][:due]
            used |= set(dealt)
            want[k] += dealt
    assert {k: [x.name for x in sorted(got, key=lambda x: x.ord) if x.kind == k] for k in want} == want
    with pytest.raises(ValueError, match="missing"):
        assign.quotas(*frames, ["animal"], 4, 500)
