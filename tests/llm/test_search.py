"""Search and hard negatives against all pairs in plain Python integers."""

import math
import random

import numpy as np
import pytest

from scorefield.llm import negatives, scores, search

MOST = (1 << 63) - 1
KIND = "vec_id long, embedding array<double>, label int, row string, tile int"


def vectors(seed=11, n=260, dim=9):
    r = random.Random(seed)
    rows = [(i, [r.gauss(0, 0.3) + (0.8 if j == i % 3 else 0) for j in range(dim)], i % 4) for i in range(n)]
    rows += [(n, None, 1), (n + 1, [0.1, None], 1), (n + 2, [float("nan")] * dim, 1), (n + 3, [float("inf")] * dim, 2), (n + 4, [0.0] * dim, None), (n + 5, [], 3), (50 * 40, [], 3)]
    rows += [rows[50], rows[50], rows[7], (None, rows[9][1], 1), (None, rows[50][1], None), (n + 6, rows[50][1], 0), (n + 7, rows[50][1][:4], 2), (-50, rows[3][1] + [0.25], 3)]
    return rows + [(n + 8, [1 / 512] * dim, -3), (7 * 1000, [0.7] * dim, -1)]


def clamp(x):
    return max(-MOST, min(MOST, x))


def weights(rows):
    good = [(v, e, l) for v, e, l in rows if e is not None and all(x is not None and math.isfinite(x) for x in e)]
    return [(v, [clamp(math.floor(256 * x)) if math.isfinite(256 * x) else int(math.copysign(MOST, x)) for x in e], l) for v, e, l in good]


def product(a, b):
    return clamp(sum(x * y for x, y in zip(a, b)))


def order(item):
    return (-item[0], item[1] is None, item[1] or 0)


def brute_search(rows, every, most):
    w, out = weights(rows), []
    for i, (v, e, _) in enumerate(w):
        if v is not None and v % every == 0:
            found = sorted(((product(e, f), u) for j, (u, f, _) in enumerate(w) if j != i), key=order)[:most]
            out += [(v, k + 1, u, s) for k, (s, u) in enumerate(found)]
    return out


def brute_negatives(rows, every):
    w, out = [], []
    for v, e, l in weights(rows):
        if l is not None:
            w.append((v, e, int(math.fmod(l + 1, 10)) if v is not None and v % 7 == 0 else l))
    for i, (v, e, l) in enumerate(w):
        if v is None or v % every:
            continue
        met = [(product(e, f), u, m) for j, (u, f, m) in enumerate(w) if j != i]
        for p, u, _ in sorted((x for x in met if x[2] == l), key=order)[:5]:
            fit = sorted((x for x in met if x[2] != l and 50 * p <= 100 * x[0] <= 95 * p), key=order)[:3]
            out += [(v, u, k + 1, x[1], p, x[0]) for k, x in enumerate(fit)]
    return out


def same(got, want):
    key = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted((tuple(r) for r in got), key=key) == sorted(want, key=key)


@pytest.mark.parametrize("tile, lanes, block", [(scores.TILE, 4, scores.BLOCK), (3, 5, 8), (1000, 1, 1)])
def test_search(spark, tile, lanes, block):
    rows = vectors()
    given = spark.createDataFrame([(*r, "x", 5) for r in rows], KIND).repartition(4)
    same(search.top_k(given, 50, 5, tile, lanes, block).collect(), brute_search(rows, 50, 5))


@pytest.mark.parametrize("tile, lanes, block", [(scores.TILE, 4, scores.BLOCK), (3, 5, 8)])
def test_negatives(spark, tile, lanes, block):
    rows = vectors()
    given = spark.createDataFrame([(*r, "x", 5) for r in rows], KIND).repartition(4)
    want = brute_negatives(rows, 10)
    assert len(want) > 200
    same(negatives.hard_negatives(given, 10, tile=tile, lanes=lanes, block=block).collect(), want)


@pytest.mark.parametrize("scale", [1e-3, 3e3, 1e7, 1e14, 1e19, 1e300])
def test_sizes_of_components(spark, scale):
    rows = [(v, e and [x if x is None else x * scale for x in e], l) for v, e, l in vectors(n=60)]
    given = spark.createDataFrame([(*r, "x", 5) for r in rows], KIND)
    same(search.top_k(given, 50, 5, lanes=2).collect(), brute_search(rows, 50, 5))
    same(negatives.hard_negatives(given, 50, lanes=2).collect(), brute_negatives(rows, 50))


def test_residue_products_are_exact():
    r = np.random.default_rng(1)
    for bits, terms in ((3, 1), (9, 200), (20, 64), (31, 130)):
        a, b = (r.integers(-(1 << bits), 1 << bits, (n, terms)) for n in (5, 7))
        a[0], b[0] = -(1 << bits), -(1 << bits)
        most = float(terms) * 4.0**bits
        moduli = negatives.primes(most)
        assert all(scores.HIGHEST > p > 2 and negatives.STRIP * (p // 2) ** 2 < 1 << 24 for p in moduli)
        want = [[clamp(sum(int(x) * int(y) for x, y in zip(u, v))) for v in b] for u in a]
        assert negatives.product([negatives.residues(a, p) for p in moduli], [negatives.residues(b, p) for p in moduli], moduli).tolist() == want


def test_windows_are_exact():
    for p in [*range(-50, 200), MOST, MOST - 1, -MOST]:
        low, high = negatives.window(p)
        assert 50 * p <= 100 * low and 50 * p > 100 * (low - 1) and 100 * high <= 95 * p < 100 * (high + 1)


def test_partition_selection_takes_the_first_of_equal_scores():
    r = random.Random(2)
    for _ in range(200):
        s = [r.randint(0, 4) for _ in range(r.randint(0, 12))]
        want = sorted(range(len(s)), key=lambda i: (-s[i], i))[:3]
        assert sorted(scores.first_of(np.array(s, np.int64), 3).tolist()) == sorted(want)


def test_few_rows(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    one = spark.createDataFrame([(50, [1.0, 2.0], 3)], "vec_id long, embedding array<float>, label int")
    two = spark.createDataFrame([(50, [1.0, 2.0], 3), (None, [1.0], None)], "vec_id long, embedding array<float>, label int")
    for given in (empty, one):
        assert search.top_k(given).count() == negatives.hard_negatives(given).count() == 0
    assert [tuple(r) for r in search.top_k(two).collect()] == [(50, 1, None, 65536)]
    assert negatives.hard_negatives(two).count() == 0


def test_one_label_holds_most_rows(spark):
    r = random.Random(4)
    rows = [(i, [r.gauss(1, 1) for _ in range(4)], 1 if i % 3 else 2) for i in range(1500)]
    given = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    same(negatives.hard_negatives(given, lanes=8, tile=10, block=64).collect(), brute_negatives(rows, 50))
