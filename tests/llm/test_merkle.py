"""The manifest against a tree built by hand."""

import hashlib

import pytest
from pyspark.sql import functions as F

from corpusloom.llm import merkle as M


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        n = out[-1]
        out.append([H(*n[k : k + 2]) for k in range(0, len(n), 2)])
    return out


def proof(tree, i):
    out = []
    for n in tree[:-1]:
        j = i ^ 1
        out.append(("L" if i & 1 else "R") + n[j] if j < len(n) else "-")
        i >>= 1
    return out


@pytest.mark.parametrize("n", [1, 2, 3, 7, 8, 9, 33])
def test_traversal_is_the_tree(n):
    leaves = [H(str(i)) for i in range(n)]
    tree = levels(leaves)
    assert list(M.traverse(leaves, len(tree) - 1)) == [proof(tree, i) for i in range(n)]
    # a block of a larger tree goes on to the full height
    high = list(M.traverse(leaves, M.HEIGHT))
    assert all(p == proof(tree, i) + ["-"] * (M.HEIGHT + 1 - len(tree)) for i, p in enumerate(high))
    assert M.block_root(leaves, len(tree) - 1) == tree[-1][0]


def test_stacks_stay_small(monkeypatch):
    most = []
    stepped = M._Stack.step
    monkeypatch.setattr(M._Stack, "step", lambda self: (stepped(self), most.append(len(self.nodes)))[0])
    for _ in M.traverse([str(i) for i in range(1024)], 10):
        pass
    assert max(most) <= 11


@pytest.mark.parametrize("height", [1, 2, 10])
def test_manifest_by_hand(spark, height):
    rows = [(i, f"t{i}", ["de", "en", None, "", "é", "z"][i * i % 6], "x") for i in range(60)]
    rows += [(None, "a", "de", "y"), (7, "t7", rows[7][2], "x"), (7, None, rows[7][2], ""), (500, "", "lone", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, leaf string")
    got = M.verified(M.manifest(docs, ["doc_id", "text", "leaf"], keep={"text": F.col("text")}, height=height), F.col("leaf")).collect()
    by_lang = {}
    for r in rows:
        by_lang.setdefault(r[2], []).append((r[0] is not None, r[0] or 0, H(field(r[0]), field(r[1]), field(r[3]))))
    trees = {k: levels([x[2] for x in sorted(v)]) for k, v in by_lang.items()}
    names = sorted(trees, key=lambda k: (k is not None, (k or "").encode()))
    top = levels([trees[k][-1][0] for k in names])
    want = sorted((x[2], trees[k][-1][0], top[-1][0], tuple(proof(trees[k], i) + proof(top, names.index(k)))) for k, v in by_lang.items() for i, x in enumerate(sorted(v)))
    assert sorted((r.leaf, r.subroot, r.root, tuple(r.proof)) for r in got) == want
    assert all(r.verified and r.folded_root == r.root for r in got) and len(got) == len(rows)
    wrong = M.verified(M.manifest(docs, ["doc_id", "text", "leaf"]), F.sha2(F.lit("x").cast("binary"), 256))
    assert wrong.where("verified").count() == 0


def test_leaf_alone_and_nothing(spark):
    docs = spark.createDataFrame([(1, "a", None)], "doc_id long, text string, lang string")
    (row,) = M.manifest(docs, ["doc_id", "text"]).collect()
    assert row.leaf == row.subroot == row.root == H("1:1", "1:a") and row.proof == []
    assert M.manifest(docs.limit(0), ["doc_id"]).collect() == []
