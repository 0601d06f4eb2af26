"""Hard negatives against plain integer arithmetic."""

import math

import numpy as np
import pytest

from pagecensus.llm import residues

SCHEMA = "vec_id long, embedding array<float>, label int"


@pytest.mark.parametrize("largest", [0, 1, 160, 10**5, 2**27])
@pytest.mark.parametrize("dims", [0, 3, 700])
def test_products_are_exact(largest, dims):
    draw = np.random.default_rng(dims + largest)
    a, b = (draw.integers(-largest, largest + 1, (n, dims)) for n in (5, 9))
    a[0], b[0], b[1] = largest, largest, -largest
    primes = residues.moduli(max(dims, 1) * largest**2) if dims * largest**2 < 2**63 else None
    if primes is None:
        pytest.skip("does not fit")
    got = residues.products(residues.Residues(a, primes)[:], residues.Residues(b, primes)[:], primes)
    assert got.tolist() == (a.astype(object) @ b.T.astype(object)).astype(np.int64).tolist()


def test_moduli_are_enough():
    for bound in (0, 1, 254, 255, 10**6, 2**62):
        primes = residues.moduli(bound)
        assert math.prod(primes) > 2 * bound and len(set(primes)) == len(primes)
        assert all(p % q for p in primes for q in range(2, p))
    with pytest.raises(ValueError):
        residues.moduli(2**63)


def brute(rows):
    """Rows as (vec_id, vector, label), null ids last."""
    usable = [r for r in rows if r[2] is not None and r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    usable.sort(key=lambda r: (r[0] is None, r[0] or 0))
    whole = [[math.floor(256 * float(np.float32(x))) for x in r[1]] for r in usable]
    out = []
    for i, anchor in enumerate(usable):
        if anchor[0] is None or anchor[0] % 50:
            continue
        scores = [sum(x * y for x, y in zip(whole[i], v)) for v in whole]
        order = sorted(range(len(usable)), key=lambda j: -scores[j])
        for p in [j for j in order if j != i and usable[j][2] == anchor[2]][:5]:
            fit = [j for j in order if usable[j][2] != anchor[2] and 50 * scores[p] <= 100 * scores[j] <= 95 * scores[p]][:3]
            out += [(anchor[0], usable[p][0], n, usable[j][0], scores[p], scores[j]) for n, j in enumerate(fit, 1)]
    return sorted(out, key=repr)


def found(spark, rows, schema=SCHEMA):
    mined = residues.hard_negatives(spark.createDataFrame(rows, schema).repartition(3), "vec_id % 50 = 0")
    return sorted((tuple(r) for r in mined.collect()), key=repr)


def vectors(n, dims, seed, spread=1.0):
    draw = np.random.default_rng(seed)
    return [(i, [float(np.float32(x)) for x in spread * draw.normal(0.3, 1, dims)], int(draw.integers(0, 3))) for i in range(n)]


def test_against_brute_force(spark):
    rows = vectors(400, 8, 1)
    assert found(spark, rows) == brute(rows) != []


def test_ties_repeats_nulls_and_lengths(spark):
    rows = vectors(120, 2, 2, spread=0.02)  # few distinct scores
    rows += rows[:60] + rows[50:51] * 3 + [(50, [0.5, 0.5], 2)]
    rows += [(None, [0.4, 0.3], 1), (None, [0.4, 0.2], 2), (100, None, 1), (150, [0.1, None], 1), (200, [0.1, float("nan")], 1),
             (250, [float("inf"), 0.1], 1), (300, [0.3, 0.1], None), (350, [], 1), (400, [0.5], 0), (450, [0.3, 0.1, 0.7], 1)]
    assert found(spark, rows) == brute(rows) != []


def test_more_columns_and_no_rows(spark):
    rows = [(*r, 1, "x", 2.0) for r in vectors(120, 4, 3)]
    got = found(spark, rows, SCHEMA + ", uid int, a string, score double")
    assert got == brute([r[:3] for r in rows]) != []
    assert found(spark, []) == []
    assert found(spark, [(1, [0.1], 1), (2, [0.2], 2)]) == []  # no anchor


def test_blocks_do_not_matter(spark, monkeypatch):
    rows = vectors(300, 4, 4)
    for name in ("FEWER_ROWS", "FEWER_ANCHORS", "TILE_ROWS", "TILE_ANCHORS"):
        monkeypatch.setattr(residues, name, 2)
    assert found(spark, rows) == brute(rows)


def test_scores_that_do_not_fit(spark):
    with pytest.raises(ValueError):
        residues.hard_negatives(spark.createDataFrame([(0, [1e30, 1e30], 1)], SCHEMA), "vec_id % 50 = 0")
