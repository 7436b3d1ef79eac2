"""Vectors kept in npz archives: rows of two arrays, ids and vectors, read by byte ranges."""

from __future__ import annotations

import struct
import zipfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.plans.scratch import partitions
from corpusloom.sources.stores import open_store

#: Rows of an archive that a task reads at a time.
ROWS = 65_536


def write_npz(vectors: DataFrame, root: str, rows: int = ROWS) -> DataFrame:
    """Writes (id, vec) as archives of at most ``rows`` rows with the members ids and vectors; gives (inside, n). All vectors of an archive have one length.

    A task's archives are named after it, so one that is run again leaves the same files.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = open_store(root)
        store.create_dir(base, recursive=True)
        task, count = TaskContext.get().partitionId(), 0
        for batch in batches:
            ids, lengths = np.asarray(batch.column("id")), np.asarray(batch.column("n"))
            for size in np.unique(lengths).tolist():
                own = np.flatnonzero(lengths == size)
                for a in range(0, len(own), rows):
                    part = own[a : a + rows]
                    name = f"part-{task:06d}-{count:06d}.npz"
                    count += 1
                    with store.open_output_stream(f"{base}/{name}") as file:
                        np.savez(file, ids=ids[part], vectors=np.array(batch.column("vec").take(pa.array(part)).to_pylist(), np.float32).reshape(len(part), size))
                    yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([len(part)], pa.int64())], names=["inside", "n"])

    kept = vectors.where(F.col("id").isNotNull() & F.forall("vec", lambda x: x.isNotNull()))
    return kept.select(F.col("id").cast("long").alias("id"), F.col("vec").cast("array<float>").alias("vec"), F.size("vec").alias("n")).mapInArrow(run, "inside string, n long")


def _member(file, info: zipfile.ZipInfo) -> tuple[int, tuple, np.dtype] | None:
    """Place of an uncompressed member's first value, shape and type; None for a member of another form."""
    file.seek(info.header_offset)
    head = file.read(30)
    if info.compress_type != zipfile.ZIP_STORED or len(head) < 30:
        return None
    name, extra = struct.unpack("<HH", head[26:30])
    file.seek(info.header_offset + 30 + name + extra)
    version = np.lib.format.read_magic(file)
    read = np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0
    shape, fortran, kind = read(file)
    return None if fortran or kind.hasobject else (file.tell(), shape, kind)


def _layout(store, path: str) -> dict[str, tuple[int, tuple, np.dtype]] | None:
    """The archive's arrays by name; None where it is corrupt or its arrays don't fit each other."""
    try:
        with store.open_input_file(path) as file, zipfile.ZipFile(file) as archive:
            found = {i.filename.removesuffix(".npy"): _member(file, i) for i in archive.infolist()}
    except (OSError, ValueError, zipfile.BadZipFile, struct.error, EOFError):
        return None
    ids, vectors = found.get("ids"), found.get("vectors")
    if ids is None or vectors is None or len(ids[1]) != 1 or len(vectors[1]) != 2 or ids[1][0] != vectors[1][0]:
        return None
    return {"ids": ids, "vectors": vectors}


def read_npz(files: DataFrame, root: str, rows: int = ROWS) -> DataFrame:
    """(id, vec) of the archives named in files (inside) below ``root``.

    Tasks read the archives' directories first, then ranges of rows by their bytes, so one
    large archive is many tasks' work. A corrupt archive, or one without an id for each
    vector, gives no rows; neither do compressed members, which can't be entered midway.
    """

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = open_store(root)
        for batch in batches:
            names = batch.column("inside").to_pylist()
            found = [_layout(store, f"{base}/{n}") for n in names]
            counts = [0 if x is None else x["ids"][1][0] for x in found]
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(counts, pa.int64())], names=["inside", "n"])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = open_store(root)
        for batch in batches:
            for inside, start in zip(batch.column("inside").to_pylist(), batch.column("start").to_pylist(), strict=True):
                layout = _layout(store, f"{base}/{inside}")
                if layout is None:
                    continue
                made = []
                with store.open_input_file(f"{base}/{inside}") as file:
                    for name in ("ids", "vectors"):
                        place, shape, kind = layout[name]
                        width = kind.itemsize * (shape[1] if len(shape) > 1 else 1)
                        n = min(rows, shape[0] - start)
                        file.seek(place + start * width)
                        data = file.read(n * width)
                        if len(data) < n * width:
                            break
                        made.append(np.frombuffer(data, kind).reshape(n, *shape[1:]))
                if len(made) == 2:
                    ids, vectors = made[0].astype(np.int64), made[1].astype(np.float32)
                    offsets = pa.array(np.arange(0, vectors.size + 1, max(vectors.shape[1], 1))[: len(ids) + 1] if vectors.shape[1] else np.zeros(len(ids) + 1), pa.int32())
                    yield pa.RecordBatch.from_arrays([pa.array(ids), pa.ListArray.from_arrays(offsets, pa.array(vectors.ravel()))], names=["id", "vec"])

    count = partitions(files.sparkSession)
    held = files.select("inside").repartition(count).mapInArrow(look, "inside string, n long").where("n > 0")
    ranges = held.select("inside", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(rows).cast("long"))).alias("start"))
    return ranges.repartition(count, "inside", "start").mapInArrow(read, "id long, vec array<float>")
