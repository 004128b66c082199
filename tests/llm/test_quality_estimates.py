"""Robust estimates against a plain search for the least determinant, and ends of the concentration steps."""

import numpy as np
from pyspark.sql import functions as F

from lintel.llm import quality_rules as q

SIZE = len(q.STATS)
RIDGE = np.diag(np.square(q.FLOORS))


def frame(spark, groups):
    rows = [(g, *map(float, x)) for g, points in groups.items() for x in points]
    return spark.createDataFrame(rows, "g string, " + ", ".join(f"{x} double" for x in q.STATS)).repartition(3)


def estimate(points):
    center = points.mean(0)
    spread = np.cov(points.T, bias=True) + RIDGE
    return center, spread, np.linalg.slogdet(spread)[1]


def distances(points, center, spread):
    left = points - center
    return np.einsum("ij,jk,ik->i", left, np.linalg.inv(spread), left)


def plain(points, starts=60):
    """The least determinant that concentration steps on whole sorted distances reach from random subsets."""
    random, keep, best = np.random.default_rng(8), int(round(q.SHARE * len(points))), None
    for _ in range(starts):
        found = estimate(points[random.choice(len(points), SIZE + 5, replace=False)])
        while True:
            new = estimate(points[np.argsort(distances(points, *found[:2]), kind="stable")[:keep]])
            if abs(new[2] - found[2]) < 1e-9:
                break
            found = new
        if best is None or found[2] < best[2]:
            best = found
    return best


def clouds():
    random = np.random.default_rng(5)
    turn = random.normal(size=(SIZE, SIZE)) * 0.3
    inner = random.normal(size=(400, SIZE)) @ turn + 4
    far = random.normal(size=(60, SIZE)) * 0.2 + np.array([9, 1, 4, 8, 2])
    skewed = np.column_stack([random.gamma(2, 0.5, 300), random.normal(2, 0.1, 300), np.zeros(300), random.choice([0, 0, 0, 0.7], 300), random.exponential(0.2, 300)])
    return {"far": np.vstack([inner, far]), "skewed": skewed}


def test_estimates_reach_the_plain_determinant(spark):
    groups = clouds()
    got = {r["g"]: r for r in q.estimates(frame(spark, groups)).collect()}
    assert set(got) == set(groups)
    for g, points in groups.items():
        center, spread, det = plain(points)
        r = got[g]
        assert r["det"] <= det + 0.1 and abs(r["det"] - det) < 0.3, (g, r["det"], det)
        lower = np.array([[r[f"l{i}{j}"] if j <= i else 0.0 for j in range(SIZE)] for i in range(SIZE)])
        mine = distances(points, np.array([r[f"m{i}"] for i in range(SIZE)]), lower @ lower.T) / r["scale"]
        theirs = distances(points, center, spread)
        theirs /= max(1.0, np.median(theirs) / q.MEDIAN)
        assert np.mean((mine > q.CUT) == (theirs > q.CUT)) >= 0.99, g
    assert got["far"]["m0"] < 5  # not drawn to the far points


def test_steps_end_on_ties_and_constants(spark):
    """Few different vectors, all of them equal, and as many on one side of the share as on the other."""
    random = np.random.default_rng(6)
    few = random.integers(0, 3, (300, SIZE)) * 0.5
    halves = np.vstack([np.zeros((90, SIZE)), np.ones((30, SIZE)), np.full((1, SIZE), 5.0)])
    got = {r["g"]: r for r in q.estimates(frame(spark, {"few": few, "one": np.ones((80, SIZE)), "halves": halves})).collect()}
    assert set(got) == {"few", "one", "halves"} and all(np.isfinite(r["det"]) for r in got.values())
    assert abs(got["one"]["det"] - np.linalg.slogdet(RIDGE)[1]) < 1e-6


def test_weights_add_up_to_the_share(spark):
    random = np.random.default_rng(7)
    rows = spark.createDataFrame([(g, 1, float(v)) for g in "ab" for v in np.round(random.exponential(2, 237), 1)], "g string, start int, d2 double")
    found = q._nearest(rows).groupBy("g").agg(F.sum("w").alias("w"), F.max("d2").alias("last"), F.min("w").alias("least")).collect()
    assert len(found) == 2 and all(abs(r["w"] - q.SHARE * 237) < 1e-6 and 0 < r["least"] <= 1 for r in found)
