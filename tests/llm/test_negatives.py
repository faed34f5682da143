"""Hard negatives against plain scores."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from compare import difference, duck
from eventlane.llm import negatives, queries
from eventlane.llm.oracle import ORACLE

SCHEMA = "vec_id long, embedding array<float>, label int"


def test_look_ups_are_inner_products():
    draw = np.random.default_rng(3)
    for width, bits in ((1, 2), (7, 5), (64, 9), (65, 12), (0, 3)):
        low, high = -(1 << (bits - 1)), (1 << (bits - 1)) - 1
        a = draw.integers(low, high, (9, width), endpoint=True)
        c = draw.integers(low, high, (14, width), endpoint=True)
        a[0], c[0], c[1] = low, low, high
        got = negatives.scores(negatives.subset_sums(a), negatives.planes(c, bits))
        assert (got == a @ c.T).all()


def plain(rows, every=50):
    """The contract over (vec_id, vector, label) rows with distinct ids."""
    own = []
    for i, v, label in rows:
        if label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        if i is not None and i % 7 == 0:
            label = (label + 1) % 10
        own.append((i, label, [math.floor(256 * float(np.float32(x))) for x in v]))
    out = []
    for i, label, v in own:
        if i is None or i % every:
            continue
        scored = [(-sum(a * b for a, b in zip(v, w)), math.inf if j is None else j, other) for j, other, w in own if j != i and len(w) == len(v)]
        scored.sort()
        for p, j, _ in [s for s in scored if s[2] == label][:5]:
            good = [s for s in scored if s[2] != label and 50 * -p <= 100 * -s[0] <= 95 * -p][:3]
            out += [(i, None if j == math.inf else j, n, None if k == math.inf else k, -p, -s) for n, (s, k, _) in enumerate(good, 1)]
    return sorted(out, key=repr)


def mined(df):
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    found = negatives.mine(df.withColumn("label", moved), F.col("vec_id") % 50 == 0)
    return sorted((tuple(r) for r in found.collect()), key=repr)


def vectors(seed, n, width, labels, coarse=False):
    draw = np.random.default_rng(seed)
    centre = draw.standard_normal((4, width))
    rows = []
    for i in range(n):
        v = centre[draw.integers(4)] + draw.standard_normal(width)
        v = np.round(v) / 4 if coarse else v / np.linalg.norm(v)
        rows.append((i, [float(np.float32(x)) for x in v], int(draw.choice(labels))))
    return rows


@pytest.mark.parametrize("blocks", [(8192, 65_536, 256, 512), (3, 40, 2, 16)])
def test_against_plain_scores(spark, monkeypatch, blocks):
    for name, value in zip(("ANCHORS", "CANDIDATES", "_AT_ONCE", "_MET"), blocks):
        monkeypatch.setattr(negatives, name, value)
    rows = vectors(1, 700, 12, [0, 0, 0, 1, 2, 9])
    odd = [(1000, None, 1), (1050, [0.5] * 12, None), (1100, [float("nan")] + [0.1] * 11, 1), (1150, [None] + [0.1] * 11, 1), (1200, [0.0] * 12, 1)]
    odd += [(1250, [float("inf")] * 12, 1), (1300, [0.25] * 8, 1), (1301, [0.25] * 8, 1), (1302, [0.2] * 8, 3), (1350, [], 1), (1351, [], 1), (1400, [1000.5] * 12, 4)]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows + odd], SCHEMA + ", rank int, item string")
    want = plain(rows + odd)
    assert want and mined(df) == want


def test_ties_and_hot_label(spark, monkeypatch):
    """Coarse vectors: many equal scores, equal vectors and a label of nearly all rows."""
    monkeypatch.setattr(negatives, "CANDIDATES", 64)
    rows = vectors(2, 500, 3, [5] * 9 + [6], coarse=True)
    assert mined(spark.createDataFrame(rows, SCHEMA)) == plain(rows)


def test_null_ids_and_repeated_rows(spark):
    rows = vectors(4, 120, 4, [1, 2, 3], coarse=True)
    nulls = [(None, [0.5, 0.5, 0.5, 0.5], 1), (None, [1.0, 0.0, 0.25, 0.0], 2)]
    assert mined(spark.createDataFrame(rows + nulls + rows[:60], SCHEMA)) == plain(rows + nulls)


def test_nothing_to_mine(spark):
    assert mined(spark.createDataFrame([], SCHEMA)) == []
    assert mined(spark.createDataFrame([(1, [0.5], 1), (2, [0.5], 2)], SCHEMA)) == []
    assert mined(spark.createDataFrame([(50, [0.5], 1), (2, [0.5], 2)], SCHEMA)) == []


def test_scores_beyond_a_long_are_refused(spark):
    with pytest.raises(ArithmeticError):
        mined(spark.createDataFrame([(50, [1e9], 1), (2, [0.5], 2)], SCHEMA))


@pytest.mark.parametrize("sf", ["0.001", "0.01"])
def test_query(spark, sf):
    folder = f"/root/testdata/sf{sf}"
    assert difference(queries.op11_hard_negatives(spark, folder), duck(folder), ORACLE["op11_hard_negatives"]) is None
