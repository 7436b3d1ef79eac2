"""Names in texts against ``name in text``."""

import hashlib
import random

import pytest

from corpusloom.operators import crawl
from corpusloom.plans.scratch import Scratch
from corpusloom.sources import tables

NAMES = ["a.png", "my photo.png", "a(1).png", "ba.png", "png", ".", "[x] {y}.jpg", "é ü.png", "日本.gif", "a", "aa", "", "never.png", "nul\x00.png", "line\nbreak.png", None, "'q\".svg"]


@pytest.mark.parametrize("most", [1 << 20, 60])
def test_mentions_are_substrings(spark, most):
    rng = random.Random(1)
    texts = [(f"p{k}", "".join(rng.choice([*[n for n in NAMES[:-3] if n and n != "never.png"], " ", "x", "ba", "\n"]) for _ in range(rng.randint(0, 6)))) for k in range(80)]
    texts += [("none", None), ("empty", ""), ("long", "aab" * 100_000 + "my photo.png"), (None, "a(1).png")]
    images = spark.createDataFrame([(n, 1) for n in NAMES + NAMES[:3]], "name string, path int")
    bodies = spark.createDataFrame([(p, t, "x") for p, t in texts], "path string, body string, name string")
    got = [tuple(r) for r in crawl.image_mentions(images, bodies, most).collect()]
    want = {(n, p) for n in NAMES if n is not None for p, t in texts if t is not None and n in t}
    assert set(got) == want and len(got) == len(want)
    unused = {r.name for r in crawl.unused_images(images, bodies).collect()}
    assert unused == {n for n in NAMES if n is None or not any(t is not None and n in t for _, t in texts)}


def test_no_images_or_texts(spark):
    images, bodies = spark.createDataFrame([], "name string"), spark.createDataFrame([("p", "x")], "path string, body string")
    assert crawl.image_mentions(images, bodies).collect() == []
    assert crawl.image_mentions(spark.createDataFrame([("x",)], "name string"), bodies.limit(0)).collect() == []


def test_equal_files(spark):
    rows = [("d1", "b", 5), ("d1", "a", 5), ("d1", "c", None), ("d2", "x", 1)]
    got = [tuple(r) for r in crawl.duplicate_files(spark.createDataFrame(rows, "digest string, path string, pixels long"), Scratch(spark, "f")).collect()]
    assert sorted(got) == [("d1", "a", 1), ("d1", "b", 2), ("d1", "c", 3)]


def test_files_of_a_tree(spark, tmp_path):
    """Only images outside of processed folders are opened: the others here cannot be read."""
    want = {}
    for name, data in {"a.PNG": b"x", "de/b.jpeg": b"", "de/deep/c.gif": b"y" * 3_000_000, "de/é ü%20.webp": b"z", "a.txt": None, "processed/p.png": None, "de/processed/q.png": None, ".h.png": None, "_s.png": None, "de/_t/u.png": None, "_k=1.png": b"k", "reprocessed/r.bmp": b"r"}.items():
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        # a link to nothing fails for whoever opens it
        path.symlink_to(tmp_path / "nothing") if data is None else path.write_bytes(data)
        if data is not None:
            want[name] = (len(data), hashlib.sha256(data).hexdigest())
    got = tables.read_images(spark, f"file://{tmp_path}")
    assert {r.path.removeprefix(f"file://{tmp_path}/"): (r.length, r.digest) for r in got.collect()} == want
    assert "binaryFile" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert tables.read_images(spark, f"file://{tmp_path}/none").collect() == []
