"""The map keeps more neighbourhoods than principal components do, and comes out the same again."""

import numpy as np
import pytest

from corpusloom.operators import cluster, layout
from corpusloom.plans.scratch import Scratch


def test_weights_sum_alike():
    far = np.sort(np.random.default_rng(1).random((50, 15)), axis=1)
    w = layout.neighbour_weights(far)
    assert np.allclose(w.sum(1), np.log2(15), atol=1e-6) and (w[:, 0] == 1).all() and (np.diff(w, axis=1) <= 0).all()
    assert np.isfinite(layout.neighbour_weights(np.zeros((2, 15)))).all()


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(5)
    points = rng.normal(size=(40, 16))[rng.integers(0, 40, 320)] + rng.normal(size=(320, 16)) * 0.35
    return points, spark.createDataFrame([(k, p.tolist()) for k, p in enumerate(points)], "id long, vec array<double>")


def flat(frame):
    return np.array([[r.x, r.y] for r in frame.orderBy("id").collect()])


def test_map_keeps_neighbours(spark, vectors, monkeypatch):
    points, frame = vectors
    monkeypatch.setattr(layout, "BLOCK_ROWS", 100)
    made = flat(cluster.map_2d(frame, Scratch(spark, "m")))
    plain = flat(cluster.components_2d(frame))
    kept, before = layout.kept_neighbours(points, made), layout.kept_neighbours(points, plain)
    assert kept > 1.5 * before
    assert np.allclose(made, flat(cluster.map_2d(frame.repartition(3), Scratch(spark, "m"))), atol=1e-6)


def test_graph_is_the_same_both_ways(spark, vectors):
    _, frame = vectors
    rows = {(r.a, r.b): r.w for r in layout.fuzzy_graph(frame, 5, Scratch(spark, "m")).collect()}
    assert all(0 < w <= 1 + 1e-9 and abs(rows[b, a] - w) < 1e-12 for (a, b), w in rows.items())


def test_maps_of_few(spark):
    frame = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, None), (4, [0.0, 0.0])], "id long, vec array<double>")
    assert [r.id for r in cluster.map_2d(frame, Scratch(spark, "m")).orderBy("id").collect()] == [1, 2]
    assert cluster.map_2d(frame.where("id > 2"), Scratch(spark, "m")).collect() == []
