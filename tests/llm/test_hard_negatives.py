"""Hard negatives against plain loops over all pairs."""

import math
import random

import numpy as np
import pytest

from echogrid.llm import hard_negatives

SCHEMA = "vec_id long, embedding array<float>, label int, block int, q string"


def brute(rows):
    kept = set()
    for i, v, k, *_ in rows:
        if i is not None and v is not None and k is not None and all(x is not None and math.isfinite(x) for x in v):
            kept.add((i, (k + 1) % 10 if i % 7 == 0 else k, tuple(math.floor(256 * float(np.float32(x))) for x in v)))
    out, kept = [], sorted(kept)
    for a in (r for r in kept if r[0] % 50 == 0):
        every = sorted((-sum(x * y for x, y in zip(a[2], r[2])), r[0], r[1]) for r in kept if r != a)
        for s, p, _ in [x for x in every if x[2] == a[1]][:5]:
            fit = [x for x in every if x[2] != a[1] and 50 * -s <= 100 * -x[0] <= 95 * -s][:3]
            out += [(a[0], p, n + 1, x[1], -s, -x[0]) for n, x in enumerate(fit)]
    return sorted(out)


def sample(n=400, width=12, seed=4):
    r = random.Random(seed)
    centres = [[r.gauss(0, 1) for _ in range(width)] for _ in range(6)]
    rows = []
    for i in range(n):
        c = r.choice(centres)
        rows.append((i, [x + r.gauss(0, 0.4) for x in c], r.randrange(4), i, "z"))
    # many rows of one vector: ties; repeated rows; one id with two vectors; lengths 0 and short; what takes no part
    rows += [(i, rows[0][1], i % 2, 0, None) for i in range(600, 660)] + rows[:60] + [(50, rows[3][1], 1, 0, ""), (700, [0.0] * width, 1, 0, ""), (701, [], 2, 0, ""), (702, [1.0, 2.0], 1, 0, "")]
    rows += [(None, rows[0][1], 1, 0, ""), (710, None, 1, 0, ""), (711, rows[0][1], None, 0, ""), (712, [float("nan")] * width, 1, 0, ""), (713, [None] + rows[0][1][1:], 1, 0, ""), (750, [float("inf")] * width, 1, 0, ""), (800, [3e38] * width, 1, 0, "")]
    return rows


def test_equals_all_pairs_whatever_the_blocks(spark):
    rows = sample()
    df = spark.createDataFrame(rows, SCHEMA)
    want = brute([r for r in rows if r[0] != 800])
    assert len(want) > 100
    for block, directions in ((1 << 16, 32), (40, 3)):
        assert sorted(map(tuple, hard_negatives.mine(df, block=block, directions=directions).collect())) == want


def test_large_components_and_empty_tables(spark):
    r = random.Random(1)
    rows = [(i, [r.uniform(-1, 1) * 4e4 for _ in range(8)], i % 3, 0, "") for i in range(0, 300, 5)]
    rows += [(i + 1, [x / 1e4 for x in v], k, b, q) for i, v, k, b, q in rows]
    assert sorted(map(tuple, hard_negatives.mine(spark.createDataFrame(rows, SCHEMA)).collect())) == brute(rows)
    assert hard_negatives.mine(spark.createDataFrame([], SCHEMA)).collect() == []
    assert hard_negatives.mine(spark.createDataFrame(rows[:1], SCHEMA)).collect() == []


@pytest.mark.parametrize("size", [1, 3e3, 5e6])
def test_scores_are_exact_at_every_size(size):
    r = np.random.default_rng(3)
    a, x = (r.integers(-size, size + 1, (5, 64)) for _ in range(2))
    most = float(np.linalg.norm(a, axis=1).max() * np.linalg.norm(x, axis=1).max())
    assert hard_negatives.scores(a, x, most).tolist() == [[sum(p * q for p, q in zip(m, n)) for n in x.tolist()] for m in a.tolist()]


def test_windows_that_cannot_hold_a_score_are_not_read(spark):
    """Bounds hold for every pair, and spare windows where vectors lie in groups."""
    r = np.random.default_rng(5)
    centres = r.normal(size=(8, 32))
    rows = [(int(i), [float(x) for x in centres[i % 8] + r.normal(size=32) * 0.02], int(i % 8), 0, "") for i in range(4096)]
    kept = hard_negatives.with_angles(hard_negatives.whole_vectors(spark.createDataFrame(rows, SCHEMA)), 8).orderBy("near", "toward")
    side = hard_negatives.Side(kept.toArrow().combine_chunks().to_batches()[0])
    windows = hard_negatives.Windows(side)
    bottom, top = windows.bounds(side)
    s = hard_negatives.scores(side.q, side.q, 2.0**40)
    for w in range(len(windows.first)):
        own = s[:, windows.first[w] : windows.end[w]]
        assert (own >= bottom[:, w, None]).all() and (own <= top[:, w, None]).all()
    assert (top[0] >= np.sort(s[0])[-6]).sum() <= len(windows.first) // 4
