import numpy as np
import pytest

from lectern.llm import induced


def brute(text, limit):
    order = sorted(range(len(text)), key=lambda i: text[i:])
    lcp = [0]
    for a, b in zip(order, order[1:]):
        k = 0
        while max(a, b) + k < len(text) and text[a + k] == text[b + k]:
            k += 1
        lcp.append(min(k, limit))
    return order, lcp[: len(text)]


@pytest.mark.parametrize("seed", range(60))
def test_against_plain_sort(seed, monkeypatch):
    rng = np.random.Generator(np.random.PCG64(seed))
    monkeypatch.setattr(induced, "RANGES", int(rng.integers(1, 40)))
    n = int(rng.integers(1, 400))
    kind = seed % 4
    if kind == 0:
        text = rng.integers(0, 3, n)
    elif kind == 1:
        text = rng.integers(0, 300, n)
    elif kind == 2:
        text = np.tile(rng.integers(0, 4, 7), 60)[:n]
    else:
        part = rng.integers(0, 20, 60)
        text = np.concatenate([part, rng.integers(0, 20, 30), part, part, np.zeros(40, np.int64), part[5:]])
    limit = int(rng.integers(1, 60))
    order, lcp = induced.suffix_array(text, limit, base=4, queue_bytes=200)
    want, want_lcp = brute(text.tolist(), limit)
    assert order.tolist() == want
    assert lcp.tolist() == want_lcp


def test_larger_in_memory_base_agrees():
    rng = np.random.Generator(np.random.PCG64(5))
    part = rng.integers(0, 26, 5_000)
    text = np.concatenate([part, rng.integers(0, 26, 20_000), part[100:4_000], part])
    a = induced.suffix_array(text, 50, base=16, queue_bytes=10_000)
    b = induced.suffix_array(text, 50)
    assert all((x == y).all() for x, y in zip(a, b, strict=True))


@pytest.mark.parametrize("base", [4, 1 << 22])
@pytest.mark.parametrize("seed", range(10))
def test_ties_beyond_the_limit_in_any_order(seed, base):
    rng = np.random.Generator(np.random.PCG64(seed))
    part = rng.integers(0, 1 + seed % 4 * 3, 80)
    text = np.concatenate([part, rng.integers(0, 3, 30), part, part, part[: 40 + seed], np.zeros(30, np.int64)])
    limit = 5 + seed
    order, lcp = induced.suffix_array(text, limit, base=base, queue_bytes=200, whole=False)
    assert sorted(order.tolist()) == list(range(text.size))
    heads = [text[i : i + limit].tolist() for i in order]
    assert heads == sorted(heads)
    assert lcp.tolist() == brute(text.tolist(), limit)[1]


class Counting:
    """numpy, with the sum of what it sorts."""

    def __init__(self):
        self.total = 0

    def __getattr__(self, name):
        of = getattr(np, name)
        if name not in ("argsort", "lexsort"):
            return of

        def counted(keys, *args, **kwargs):
            self.total += keys[0].size if name == "lexsort" else keys.size
            return of(keys, *args, **kwargs)

        return counted


def test_little_is_sorted(monkeypatch):
    rng = np.random.Generator(np.random.PCG64(7))
    parts = [rng.integers(97, 123, 70) for _ in range(500)]
    text = np.concatenate([np.append(p[k:], 0) for p in parts for k in (0, 3, 9)])
    counting = Counting()
    monkeypatch.setattr(induced, "np", counting)
    induced.suffix_array(text, 50, whole=False)
    assert counting.total < 5 * text.size  # 7.5 when every step sorted all
