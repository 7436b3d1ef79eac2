"""Density clusters, trees and groups against loops by hand, with bounds so small that every way is taken."""

import json
import random
from pathlib import Path

import numpy as np
import pytest

from corpusloom.operators import cluster, density, graph, tree, vector
from corpusloom.operators.order import numbered
from corpusloom.plans.scratch import Scratch
from corpusloom.sources import sinks

SMALL = [density.Sizes(), density.Sizes(50, 1 << 18, 64), density.Sizes(50, 100, 40)]


def sections(seed=3):
    rng = np.random.default_rng(seed)
    out = {}
    for g, n in {"few": 3, "a": 40, "b": 150, "c": 301}.items():
        centres = rng.normal(size=(6, 8))
        points = centres[rng.integers(0, 6, n)] + rng.normal(size=(n, 8)) * rng.choice([0.1, 0.3, 0.8], (n, 1))
        if n > 100:  # copies, with distances of zero
            points[:7] = points[0]
        out[g] = dict(zip(sorted(rng.choice(10_000, n, replace=False).tolist()), points, strict=True))
    return out


def by_edges(points, least, samples):
    """Excess of mass from all edges in their order, top down over plain sets."""
    n = len(points)
    d = density.distances(points, points)
    core = np.sort(d, axis=1)[:, min(samples, n) - 1]
    edges = sorted((max(core[a], core[b], d[a, b]), a, b) for a in range(n) for b in range(a + 1, n))
    sets, made = {k: {k} for k in range(n)}, []
    of = list(range(n))
    for w, a, b in edges:
        if of[a] != of[b]:
            x, y = of[a], of[b]
            new = n + len(made)
            made.append((w, x, y))
            sets[new] = sets[x] | sets[y]
            for k in sets[new]:
                of[k] = new

    # the root is never chosen
    def walk(node, born):
        w, x, y = made[node - n]
        level = density.level_of(w)
        big = [k for k in (x, y) if len(sets[k]) >= least]
        if len(big) == 2:
            return [s for k in big for s in best(k, level)[1]]
        return walk(big[0], born) if big and big[0] >= n else []

    def best(node, born):
        start, mass, below = node, 0.0, None
        while node >= n:
            w, x, y = made[node - n]
            level = density.level_of(w)
            big = [k for k in (x, y) if len(sets[k]) >= least]
            mass += (len(sets[node]) - (0 if len(big) == 2 else sum(len(sets[k]) for k in big))) * (level - born)
            if len(big) == 2:
                below = [best(k, level) for k in big]
                break
            if not big:
                break
            node = big[0]
        if below is None or mass >= sum(m for m, _ in below) * (1 - density.SLACK):
            return mass, [sets[start]]
        return sum(m for m, _ in below), [s for _, x in below for s in x]

    labels = np.full(n, -1)
    if n >= max(least, 2):
        for k, members in enumerate(sorted(walk(n + len(made) - 1, 0.0), key=min)):
            labels[sorted(members)] = k
    return labels


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_hdbscan_is_the_definition(seed):
    for own in sections(seed).values():
        points = np.array(list(own.values()))
        for least, samples in ((5, 3), (2, 1), (2, 2)):
            assert density.hdbscan(points, least, samples).tolist() == by_edges(points, least, samples).tolist()


@pytest.mark.parametrize("sizes", SMALL)
def test_labels_in_every_way(spark, monkeypatch, sizes):
    monkeypatch.setattr(vector, "BLOCK_ROWS", 30 if sizes != SMALL[0] else 2048)
    rows, want = [], {}
    for k, (g, own) in enumerate(sections().items()):
        labels = density.hdbscan(np.array(list(own.values())), 5, 3)
        for (i, p), x in zip(own.items(), labels.tolist(), strict=True):
            rows.append((g, i + 10_000 * k, p.tolist(), 5, 3))
            want[i + 10_000 * k] = x
    frame = spark.createDataFrame(rows, "g string, id long, vec array<double>, least int, samples int")
    assert {r.id: r.cluster for r in density.density_labels(frame, Scratch(spark, "d"), sizes).collect()} == want


def copies_and_heaps(seed):
    """Far heaps of more points than the nearest that are kept, copies and near copies among them."""
    rng = np.random.default_rng(seed)
    points = np.concatenate([rng.normal(size=8) * 3 + rng.normal(size=(n, 8)) * s for n, s in ((60, 0.1), (45, 0.5), (80, 1.0), (25, 1e-7))])
    points[100:140] = points[3]
    return points[rng.permutation(len(points))]


@pytest.mark.parametrize("seed", [1, 2])
def test_trees_from_nearest_others_are_the_whole_tree(seed):
    points = copies_and_heaps(seed)
    n = len(points)
    ids = np.arange(n) * 3 + 1
    d = density._apart(points, np.repeat(np.arange(n), n), points, np.tile(np.arange(n), n)).reshape(n, n)
    for k, samples in ((2, 1), (4, 3), (9, 5)):
        place, near, far = density.nearest_others(ids, points, ids, points, k)
        want = [sorted((d[x, y], ids[y]) for y in range(n) if y != x)[:k] for x in range(n)]
        assert list(zip(far.tolist(), near.tolist(), strict=True)) == [p for own in want for p in own] and place.tolist() == np.repeat(np.arange(n), k).tolist()
        far, near = far.reshape(n, k), (near.reshape(n, k) - 1) // 3
        core = far[:, samples - 2] if samples > 1 else np.zeros(n)
        reach = np.maximum(np.maximum(core[:, None], core), d)
        x = np.repeat(np.arange(n), k)
        w, a, b = reach[x, near.ravel()], np.minimum(x, near.ravel()), np.maximum(x, near.ravel())
        part, bound, to, tree, turns = np.arange(n), far[:, -1].copy(), np.full(n, -1), [], 0
        while True:
            part, edges, asked = density.grown(part, w, a, b, bound, to)
            tree += [(w[e], a[e], b[e]) for e in edges]
            if not part.max():
                break
            turns += 1
            found = density.ways_out(ids[asked], points[asked], core[asked], part[asked], ids, points, core, part)
            outside = [min((reach[p, q], min(p, q), max(p, q)) for q in range(n) if part[q] != part[p]) for p in asked]
            assert [(w, (a - 1) // 3, (b - 1) // 3) for _, w, a, b in zip(*found, strict=True)] == outside
            more = [np.array(c) for c in zip(*outside, strict=True)]
            bound[asked], to[asked] = more[0], more[1] + more[2] - asked
            w, a, b = np.append(w, more[0]), np.append(a, more[1]), np.append(b, more[2])
        assert sorted(tree) == sorted(zip(*density.spanning_tree(points, core), strict=True)) and turns > 0


def test_a_group_of_middle_size_leaves_no_more_edges_than_its_tree(spark, monkeypatch):
    monkeypatch.setattr(vector, "BLOCK_ROWS", 30)
    own = {f"h{seed}": copies_and_heaps(seed) for seed in (3, 4)}
    rows = [(g, 1000 * k + i, p.tolist(), 5, 3) for k, (g, points) in enumerate(own.items()) for i, p in enumerate(points)]
    want = {1000 * k + i: x for k, points in enumerate(own.values()) for i, x in enumerate(density.hdbscan(points).tolist())}
    scratch = Scratch(spark, "d")
    frame = spark.createDataFrame(rows, "g string, id long, vec array<double>, least int, samples int")
    assert {r.id: r.cluster for r in density.density_labels(frame, scratch, density.Sizes(50)).collect()} == want
    written = [spark.read.parquet(f.as_uri()) for f in Path(scratch.root.removeprefix("file://")).iterdir()]
    edges = sum(t.where("a IS NOT NULL").count() for t in written if {"w", "a", "b"} <= set(t.columns))
    assert edges == sum(len(points) - 1 for points in own.values())


def by_recursion(ids, points, most=5):
    out, todo = {}, [("", ids, points)]
    while todo:
        path, own, at = todo.pop()
        if len(own) <= most:
            out |= {i: path for i in own}
            continue
        labels = density.hdbscan(at, 2, 1 if len(own) < 20 else 2)
        parts = [np.flatnonzero(labels == k) for k in range(labels.max() + 1)]
        if len(parts) <= 1 or max(map(len, parts)) == len(own):
            parts = [np.arange(k, min(k + most, len(own))) for k in range(0, len(own), most)]
        elif (labels < 0).any():
            parts.append(np.flatnonzero(labels < 0))
        todo += [(f"{path}/{k}", [own[i] for i in part], at[part]) for k, part in enumerate(parts)]
    return out


def test_levels_are_the_recursion(spark, monkeypatch):
    monkeypatch.setattr(vector, "BLOCK_ROWS", 30)
    rows, want = [], {}
    for k, (g, own) in enumerate(sections().items()):
        ids, points = [i + 10_000 * k for i in own], np.array(list(own.values()))
        labels = density.hdbscan(points) if len(ids) >= 5 else np.zeros(len(ids), int)
        for c in set(labels.tolist()):
            part = np.flatnonzero(labels == c)
            want |= {i: (g, c, f"{c}{p}") for i, p in by_recursion([ids[x] for x in part], points[part]).items()}
        rows += [(i, g, p.tolist()) for i, p in zip(ids, points, strict=True)]
    frame = spark.createDataFrame([*rows, (99_999, None, [1.0] * 8)], "id long, section string, vec array<double>")
    scratch = Scratch(spark, "d")
    got = scratch.table(cluster.density_clusters(frame, "section", scratch, sizes=density.Sizes(60, 1 << 18, 1 << 16)), "got")
    assert {r.id: (r.section, r.cluster, r.leaf) for r in got.collect()} == want
    # the tree: every page once, below its leaf
    nodes = tree.intervals(cluster.tree_nodes(got, "section"), scratch)
    pages = [r for r in nodes.collect() if r.path[-1].startswith("p")]
    assert sorted(int(r.name) for r in pages) == sorted(want) and all(r.size == 1 and r.place == r.last for r in pages)
    root = nodes.where("depth = 0").first()
    assert (root.place, root.last, root.size) == (0, nodes.count() - 1, len(want))


def test_tree_files_are_one_document(spark, tmp_path):
    rng = random.Random(1)
    leaves = [(["site", rng.choice("ab\"é"), rng.choice("xyz"), f"p{k}"], f"n{k}") for k in range(60)] + [(["site", "q"], "leaf"), (["site", "b", "deep", "er", "p"], "last")]
    scratch = Scratch(spark, "tree")
    nodes = tree.with_ancestors(spark.createDataFrame(leaves, "path array<string>, name string"))
    sinks.write_tree(tree.intervals(nodes, scratch), (tmp_path / "out").as_uri())
    files = sorted((tmp_path / "out" / "tree").glob("part-*"))
    found = []

    def walk(node, depth):
        found.append((node.get("name"), node["size"], depth))
        for kid in node["children"]:
            walk(kid, depth + 1)

    walk(json.loads("".join(f.read_text() for f in files).replace("\n", "")), 0)
    want = {}
    for path, name in leaves:
        for k in range(1, len(path) + 1):
            own = want.setdefault(tuple(path[:k]), [None, 0])
            own[1] += 1
            own[0] = name if k == len(path) else own[0]
    assert found == [(want[p][0], want[p][1], len(p) - 1) for p in sorted(want, key=lambda p: [x.encode() for x in p])] and len(files) > 1
    index = {r.place: r for r in spark.read.json((tmp_path / "out" / "index").as_uri()).collect()}
    assert len(index) == len(want) and all(a.last >= a.place for a in index.values())
    empty = tree.intervals(nodes.limit(0), scratch)
    sinks.write_tree(empty, (tmp_path / "none").as_uri())
    assert empty.count() == 0


def one_by_one(pairs, n):
    near = {k: {k} for k in range(n)}
    for a, b in pairs:
        near[a].add(b)
        near[b].add(a)
    single = {a for a, b in pairs if a == b}
    done, out = set(), []
    for k in range(n):
        if k not in done and (len(near[k]) > 1 or k in single) and not done & near[k]:
            out += [(k, m) for m in near[k]]
            done |= near[k]
    return sorted(out)


@pytest.mark.parametrize("seed", range(4))
def test_greedy_groups_are_the_loop(spark, seed):
    rng = random.Random(seed)
    n = 40
    pairs = [(rng.randrange(n), rng.randrange(n)) for _ in range(rng.choice([5, 25, 60]))]
    if seed == 3:
        pairs = [(k, k + 1) for k in range(20)] + [(30, 30)]
    frame = spark.createDataFrame(pairs, "a long, b long")
    want = one_by_one(pairs, n)
    assert sorted(map(tuple, graph.greedy_groups(frame, Scratch(spark, "g"), None).collect())) == want
    two = sorted({g for g, _ in want})[:2]
    assert sorted(map(tuple, graph.greedy_groups(frame, Scratch(spark, "g"), 2).collect())) == [x for x in want if x[0] in two]


def test_components_in_one_task_and_by_rounds(spark):
    rng = random.Random(9)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(None, 1), (5, 5)]
    frame = spark.createDataFrame(pairs, "a long, b long")
    by_rounds = sorted(map(tuple, graph.components(frame, Scratch(spark, "c")).collect()))
    assert sorted(map(tuple, graph.components(frame, Scratch(spark, "c"), 1000).collect())) == by_rounds and len(by_rounds) > 100
    assert sorted(map(tuple, graph.components(frame, Scratch(spark, "c"), 10).collect())) == by_rounds
    assert graph.components(frame.limit(0), Scratch(spark, "c"), 10).collect() == []


def test_greedy_groups_of_nothing(spark):
    assert graph.greedy_groups(spark.createDataFrame([], "a long, b long"), Scratch(spark, "g")).collect() == []


def test_numbers_without_a_window_over_all(spark):
    rows = [(rng % 3 or None, (rng * 37) % 101) for rng in range(100)]
    got = numbered(spark.createDataFrame(rows, "k long, v long"), ["k"], ["v"], "place", Scratch(spark, "n")).collect()
    want = {k: sorted(v for x, v in rows if x == k) for k in {x for x, _ in rows}}
    assert len(got) == 100 and all(want[r.k][r.place] == r.v for r in got)


def test_blocks_follow_their_group(spark, monkeypatch):
    monkeypatch.setattr(vector, "BLOCK_ROWS", 10)
    frame = spark.createDataFrame([(k, k // 5, [1.0, float(k)]) for k in range(200)] + [(1000 + k, 99, [1.0, float(k)]) for k in range(30)], "id long, section long, vec array<double>")
    dealt = vector.block_pairs(frame, "section", True)
    assert dealt.where("g <> '99'").count() == 200 and dealt.where("g = '99'").count() == 90
    near = vector.top_neighbours(frame, 3, "section").collect()
    assert len(near) == 230 * 3
