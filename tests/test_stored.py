"""Published results, trees of files, archives and the polled source: what a failure, a second run or a corrupt file leaves."""

import datetime
import io
import json
import os
import zipfile

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from corpusloom.plans.scratch import Scratch
from corpusloom.sources import npz, stores
from corpusloom.sources.content import read_markdown
from corpusloom.sources.published import drop_versions, publish, read_published
from corpusloom.streaming.polled import polled


def files_below(path):
    return sorted(str(p.relative_to(path)) for p in path.rglob("*") if p.is_file() and not p.name.endswith(".crc"))


@pytest.mark.parametrize("kind", ["json", "csv", "parquet"])
def test_second_run_writes_nothing(spark, tmp_path, kind):
    rows = [(1, "a", 'x "quoted", é\nnext line'), (2, "b/c", ""), (3, None, None), (4, "a", "  spaces "), (4, "a", "  spaces ")]
    frame = spark.createDataFrame(rows, "id long, folder string, text string")
    root = (tmp_path / kind).as_uri()
    assert publish(frame, root, kind, ["folder"], ["id"])
    before = files_below(tmp_path / kind)
    assert not publish(frame.repartition(7), root, kind, ["folder"], ["id"]) and files_below(tmp_path / kind) == before
    got = sorted(map(tuple, read_published(spark, root).collect()), key=str)
    assert got == sorted(rows, key=str)
    # other rows are another version, and the one before stays until it is dropped
    assert publish(frame.where("id > 1"), root, kind, ["folder"]) and read_published(spark, root).count() == 4
    assert len([f for f in os.listdir(tmp_path / kind) if f.startswith("v-")]) == 2
    drop_versions(spark, root)
    assert len([f for f in os.listdir(tmp_path / kind) if f.startswith("v-")]) == 1 and read_published(spark, root).count() == 4


def test_a_failed_task_publishes_nothing(spark, tmp_path):
    root = (tmp_path / "out").as_uri()
    good = spark.range(10).withColumn("x", F.col("id"))
    publish(good, root, "parquet")

    calls = tmp_path / "digested"

    def fails(batches):
        for batch in batches:
            if calls.exists():
                raise ValueError("lost")
            yield batch

    bad = spark.range(100, 120).withColumn("x", F.col("id")).mapInPandas(fails, "id long, x long")
    from corpusloom.sources import published

    whole = published.content_digest

    def digest(rows):
        out = whole(rows)
        calls.write_text("now tasks fail")
        return out

    published.content_digest = digest
    try:
        with pytest.raises(Exception, match="lost"):
            publish(bad, root, "parquet")
    finally:
        published.content_digest = whole
    assert sorted(r.id for r in read_published(spark, root).collect()) == list(range(10))
    drop_versions(spark, root)
    assert sorted(r.id for r in read_published(spark, root).collect()) == list(range(10))


def test_nothing_is_published_too(spark, tmp_path):
    empty = spark.createDataFrame([], "id long, text string")
    for kind in ("json", "csv", "parquet"):
        root = (tmp_path / kind).as_uri()
        assert publish(empty, root, kind) and read_published(spark, root).collect() == [] and not publish(empty, root, kind)
    with pytest.raises(FileNotFoundError):
        read_published(spark, (tmp_path / "none").as_uri())


def test_trees_are_listed_by_level(spark, tmp_path):
    for name in ("en/a.md", "en/_index.md", "en/deep/er/b.md", "de/c.md", "de/.hidden/d.md", "de/x.txt", "fr/e.md"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(name.encode() + b"\xff")
    scratch = Scratch(spark, "list")
    root = str(tmp_path)
    assert sorted(r.inside for r in stores.list_files(spark, root, scratch).collect()) == ["de/c.md", "de/x.txt", "en/_index.md", "en/a.md", "en/deep/er/b.md", "fr/e.md"]
    got = {(r.lang, r.rel_path): r.raw for r in read_markdown(spark, tmp_path.as_uri(), scratch, ["en", "no"]).collect()}
    assert got == {("en", p): f"en/{p}�" for p in ("a.md", "_index.md", "deep/er/b.md")}
    os.utime(tmp_path / "fr/e.md", (2_000_000_000, 2_000_000_000))
    since = datetime.datetime.fromtimestamp(1_900_000_000, datetime.UTC)
    assert [r.rel_path for r in read_markdown(spark, root, scratch, since=since).collect()] == ["e.md"]
    assert stores.list_files(spark, str(tmp_path / "none"), scratch).collect() == []


def test_written_texts(spark, tmp_path):
    rows = spark.createDataFrame([("a/b.md", "x"), ("a/b.md", "y"), ("c.md", None), ("d/é f.md", "é")], "inside string, text string")
    root = (tmp_path / "t").as_uri()
    for _ in range(2):
        assert sorted(map(tuple, stores.write_texts(rows, root).collect())) == [("a/b.md", 1), ("c.md", 0), ("d/é f.md", 2)]
    assert files_below(tmp_path / "t") == ["a/b.md", "c.md", "d/é f.md"] and (tmp_path / "t/a/b.md").read_text() == "x"
    gone = spark.createDataFrame([("no.md",), ("c.md",)], "inside string")
    assert {r.inside: r.raw for r in stores.read_texts(gone, root).collect()} == {"no.md": None, "c.md": ""}


def test_small_negative_components_keep_their_sign(spark, tmp_path):
    import duckdb

    from corpusloom.plans import stored_queries

    values = [-1e-7, 1e-7, -4.9e-7, 0.0078125, -0.0078125, -0.5, 0.0]
    path = tmp_path / "embeddings.parquet"
    pq.write_table(pa.table({"vec_id": pa.array([1], pa.int64()), "embedding": pa.array([values], pa.list_(pa.float32())), "label": pa.array([0], pa.int32())}), path)
    got = stored_queries.QUERIES["npz_vectors"](spark, str(tmp_path)).first().vec
    connection = duckdb.connect()
    connection.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{path}'")
    assert str(got) == str(connection.execute(stored_queries.ORACLES["npz_vectors"]).fetchone()[1])


def test_archives(spark, tmp_path):
    rng = np.random.default_rng(1)
    rows = [(k, [float(np.float32(x)) for x in rng.normal(size=3 if k % 3 else 5)]) for k in range(100)] + [(None, [1.0]), (200, None), (201, [1.0, None]), (202, [])]
    frame = spark.createDataFrame(rows, "id long, vec array<double>")
    root = (tmp_path / "npz").as_uri()
    written = Scratch(spark, "n").table(npz.write_npz(frame, root, 7), "written")
    want = {i: v for i, v in rows if i is not None and v is not None and None not in v}
    for size in (3, 1000):
        assert {r.id: r.vec for r in npz.read_npz(written, root, size).collect()} == want
    one = tmp_path / "npz"
    np.savez(one / "other.npz", ids=np.arange(3), vectors=np.zeros((2, 4)))
    np.savez_compressed(one / "packed.npz", ids=np.arange(3), vectors=np.zeros((3, 4)))
    np.savez(one / "names.npz", x=np.arange(3))
    np.savez(one / "objects.npz", ids=np.array([None, 1], object), vectors=np.zeros((2, 1)))
    np.savez(one / "good.npz", ids=np.arange(5, dtype=np.int32), vectors=np.ones((5, 2), np.float64))
    whole = (one / "good.npz").read_bytes()
    (one / "cut.npz").write_bytes(whole[:200])
    (one / "noise.npz").write_bytes(b"no archive at all")
    (one / "none.npz").write_bytes(b"")
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w") as archive:
        archive.writestr("ids.npy", b"junk")
        archive.writestr("vectors.npy", b"junk")
    (one / "junk.npz").write_bytes(held.getvalue())
    names = [(n,) for n in ("other.npz", "packed.npz", "names.npz", "objects.npz", "cut.npz", "noise.npz", "none.npz", "junk.npz", "missing.npz", "good.npz")]
    got = npz.read_npz(spark.createDataFrame(names, "inside string"), root, 2).collect()
    assert sorted((r.id, tuple(r.vec)) for r in got) == [(k, (1.0, 1.0)) for k in range(5)]


def test_a_killed_batch_comes_again(spark, tmp_path):
    start = datetime.datetime(2024, 1, 1)
    schema = "id long, ts timestamp_ntz"

    def events(ids, hours):
        return spark.createDataFrame([(k, start + datetime.timedelta(hours=h)) for k, h in zip(ids, hours, strict=True)], schema).coalesce(1)

    path = tmp_path / "events"
    events(range(10), range(0, 100, 10)).write.parquet(str(path))
    seen, done = [], []

    def run(killed):
        def sink(batch, number):
            rows = sorted(r.id for r in batch.collect())
            seen.append((number, rows))
            if number == killed:
                raise RuntimeError("killed")
            done.extend(rows)

        stream = polled(spark, str(path), schema, (tmp_path / "progress").as_uri(), step_seconds=30 * 3600)
        drain = stream.writeStream.foreachBatch(sink).option("checkpointLocation", str(tmp_path / "checkpoint")).start()
        try:
            drain.processAllAvailable()
        finally:
            drain.stop()

    with pytest.raises(Exception, match="killed"):
        run(2)
    run(None)
    batches = [rows for number, rows in seen if number == 2]
    assert len(batches) == 2 and batches[0] == batches[1] and sorted(done) == list(range(10))
    assert max(n for n, _ in seen) > 2 and all(len(rows) <= 4 for _, rows in seen)
    # what comes later is polled from where the cursor is, and nothing twice
    events([20, 21], [200, 201]).write.mode("append").parquet(str(path))
    run(None)
    assert sorted(done) == [*range(10), 20, 21]
    assert json.loads((tmp_path / "progress" / "planned").read_text()) > 0
