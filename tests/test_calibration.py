import random

import pytest

from stopflow.operators import calibration as K


def max_min(points):
    """Isotonic values by the max-min formula on ascending (score, n, pos)."""
    n = len(points)
    out = {}
    for k in range(n):
        best = -1.0
        for lo in range(k + 1):
            least = 2.0
            rows = pos = 0
            for hi in range(lo, n):
                rows, pos = rows + points[hi][1], pos + points[hi][2]
                if hi >= k:
                    least = min(least, pos / rows)
            best = max(best, least)
        out[points[k][0]] = best
    return out


@pytest.mark.parametrize("seed, together", [(1, 2), (2, 3), (3, 16)])
def test_blocks_are_the_isotonic_fit(spark, seed, together):
    rng = random.Random(seed)
    scores = [rng.randint(0, 60) / 64 for _ in range(400)]
    rows = [(p, int(rng.random() < (p * p if seed != 3 else 1 - p))) for p in scores] + [(None, 1), (0.5, None)]
    df = spark.createDataFrame(rows, "p double, y int")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        fitted = K.blocks(df, "p", "y", together)
        got = {r["p"]: r["c"] for r in K.apply(df.select("p").distinct(), "p", fitted, "c").collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    known = [(p, y) for p, y in rows if p is not None and y is not None]
    points = [(p, sum(q == p for q, _ in known), sum(y for q, y in known if q == p)) for p in sorted({q for q, _ in known})]
    want = max_min(points)
    assert got.pop(None) is None
    assert got == pytest.approx(want)
    values = [r["value"] for r in fitted.orderBy("lo").collect()]
    assert all(a < b for a, b in zip(values, values[1:]))


def test_lines_between_blocks_and_ends(spark):
    fitted = spark.createDataFrame([(0.2, 0.4, 0.1), (0.6, 0.6, 0.5)], "lo double, hi double, value double")
    asked = spark.createDataFrame([(x,) for x in (0.0, 0.2, 0.3, 0.4, 0.5, 0.6, 0.9, 0.5)], "s double")
    got = sorted((r["s"], round(r["v"], 9)) for r in K.apply(asked, "s", fitted, "v").collect())
    assert got == [(0.0, 0.1), (0.2, 0.1), (0.3, 0.1), (0.4, 0.1), (0.5, 0.3), (0.5, 0.3), (0.6, 0.5), (0.9, 0.5)]


def test_nothing_to_fit(spark):
    empty = spark.createDataFrame([], "p double, y int")
    fitted = K.blocks(empty, "p", "y")
    assert fitted.collect() == []
    assert K.apply(spark.createDataFrame([(0.3,)], "p double"), "p", fitted, "c").collect()[0]["c"] is None
