"""k-means against loops by hand, and its objective against Spark's own."""

import numpy as np
import pytest
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from corpusloom.operators import kmeans as K
from corpusloom.plans.scratch import Scratch


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(7)
    centres = rng.normal(size=(6, 5))
    points = centres[rng.integers(0, 6, 400)] + rng.normal(size=(400, 5)) * 0.6
    points[:20] = points[0]
    return spark.createDataFrame([(k, p.tolist()) for k, p in enumerate(points)], "id long, vec array<double>").repartition(5)


def in_order(vectors, seed=42):
    rows = vectors.withColumn("h", F.xxhash64("id", F.lit(seed))).orderBy("h", "id").collect()
    points = np.array([r.vec for r in rows])
    return [r.id for r in rows], np.array([[x / np.sqrt(sum(y * y for y in p)) for x in p] for p in points])


def test_rounds_are_the_loop(spark, vectors):
    ids, points = in_order(vectors)
    made = []
    for s in range(3):
        centres = K.spread(points[: 6 * K.CANDIDATES], 6, 42 + s)
        for _ in range(50):
            at = K.nearest(points, centres)[0]
            sums = np.array([K.whole(points[at == c]).sum(0) for c in range(6)])
            centres = K.moved(centres, sums, np.bincount(at, minlength=6))
        made.append((round(K.nearest(points, centres)[1].sum(), 9), s, centres))
    best = min(made)[2] if len({m[0] for m in made}) == 3 else min(made, key=lambda m: m[:2])[2]
    want = dict(zip(ids, K.nearest(points, best)[0].tolist(), strict=True))
    got = {r.id: r.cluster for r in K.kmeans(vectors, 6, Scratch(spark, "k")).collect()}
    assert got == want
    # dealt otherwise, the same
    assert got == {r.id: r.cluster for r in K.kmeans(vectors.coalesce(1), 6, Scratch(spark, "k")).collect()}
    frame = spark.createDataFrame([(i, p.tolist()) for i, p in zip(ids, points, strict=True)], "id long, vec array<double>").select("id", array_to_vector("vec").alias("features"))
    assert min(made)[0] <= KMeans(k=6, seed=42, maxIter=50).fit(frame).summary.trainingCost * 1.001


def test_batches_are_the_loop(spark, vectors):
    ids, points = in_order(vectors)
    had, centres = np.zeros(4), K.spread(points[: 4 * K.CANDIDATES], 4, 42)
    for _ in range(3):
        for a in range(0, 200, 50):
            part = points[a : a + 50]
            at = K.nearest(part, centres)[0]
            for c in range(4):
                own = part[at == c]
                if len(own):
                    had[c] += len(own)
                    centres[c] += len(own) / had[c] * (own.mean(0) - centres[c])
    want = dict(zip(ids, K.nearest(points, centres)[0].tolist(), strict=True))
    assert {r.id: r.cluster for r in K.mini_batch(vectors, 4, Scratch(spark, "k"), 50, 4, 3, 1).collect()} == want


def test_few_and_none(spark, vectors):
    scratch = Scratch(spark, "k")
    assert K.kmeans(vectors.limit(0), 3, scratch).collect() == [] and K.mini_batch(vectors.limit(0), 3, scratch).collect() == []
    assert [r.cluster for r in K.kmeans(vectors.limit(1), 3, scratch).collect()] == [0]
    assert {r.cluster for r in K.kmeans(vectors.limit(5), 9, scratch).collect()} <= {0, 1}
    assert sorted(r.cluster for r in K.sequential(vectors.limit(7), 3, scratch).collect()) == [0, 0, 0, 1, 1, 1, 2]
    assert K.sequential(vectors.limit(0), 3, scratch).collect() == []
