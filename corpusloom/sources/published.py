"""Results as files, published whole: written aside, moved to a place named by their content, then named by a manifest.

A reader sees the result before or the result after, never parts: the manifest is replaced
in one step. A run that makes what is there already writes nothing. Versions before the
last stay until they are dropped, so a reader that began with one can end.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

MANIFEST = "_manifest.json"
#: Options with which each format is written and read again. Null is \\N in CSV, as an empty cell is an empty text.
OPTIONS = {
    "csv": {"header": "true", "multiLine": "true", "escape": '"', "nullValue": "\\N", "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"},
    "json": {"ignoreNullFields": "false"},
    "parquet": {},
}


class _Folder:
    """A folder of the store that Spark writes to, by Spark's own file systems."""

    def __init__(self, spark: SparkSession, root: str):
        self.jvm, self.root = spark.sparkContext._jvm, root.rstrip("/")
        self.hadoop = self.jvm.org.apache.hadoop.fs
        conf = spark.sparkContext._jsc.hadoopConfiguration()
        self.files = self.path("").getFileSystem(conf)
        self.context = self.hadoop.FileContext.getFileContext(self.path("").toUri(), conf)
        self.replace = spark.sparkContext._gateway.new_array(self.hadoop.Options.Rename, 1)
        self.replace[0] = self.hadoop.Options.Rename.OVERWRITE

    def path(self, name: str):
        return self.hadoop.Path(f"{self.root}/{name}" if name else self.root)

    def text(self, name: str) -> str | None:
        if not self.files.exists(self.path(name)):
            return None
        stream = self.files.open(self.path(name))
        try:
            return bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()

    def put(self, name: str, text: str) -> None:
        """The text under the name, in one step."""
        part = f"_{uuid.uuid4().hex}"
        stream = self.files.create(self.path(part))
        stream.write(bytearray(text.encode()))
        stream.close()
        self.context.rename(self.path(part), self.path(name), self.replace)


def content_digest(rows: DataFrame) -> str:
    """The same for equal rows in any order: their number, and two sums of hashes."""
    held = F.to_json(F.struct(*[F.col(f"`{c}`") for c in rows.columns]), {"ignoreNullFields": "false"})
    sums = [F.sum(F.xxhash64(F.lit(k), held).cast("decimal(38,0)")).alias(f"s{k}") for k in range(2)]
    n, one, two = rows.agg(F.count("*"), *sums).first()
    return f"{n}-{int(one or 0) % (1 << 64):016x}{int(two or 0) % (1 << 64):016x}"


def publish(rows: DataFrame, root: str, kind: str = "json", by: list[str] | None = None, order: list[str] | None = None) -> bool:
    """Publishes the rows below ``root`` as ``kind``, a folder for each value of ``by``, in ``order`` within files; False if they are there already.

    An empty result is published too. Null folders are one of their own.
    """
    spark, by = rows.sparkSession, by or []
    folder = _Folder(spark, root)
    now = json.loads(folder.text(MANIFEST) or "{}")
    layout = {"kind": kind, "by": by, "schema": rows.schema.jsonValue()}
    digest = content_digest(rows)
    if now and now["digest"] == digest and {k: now[k] for k in layout} == layout:
        return False
    version = f"v-{digest}-{uuid.uuid4().hex[:8]}"
    dealt = rows.repartition(*by) if by else rows
    dealt = dealt.sortWithinPartitions(*by, *(order or [])) if by or order else dealt
    writer = dealt.write.format(kind).options(**OPTIONS[kind])
    (writer.partitionBy(*by) if by else writer).save(f"{folder.root}/_{version}")
    folder.files.rename(folder.path(f"_{version}"), folder.path(version))
    folder.put(MANIFEST, json.dumps({"digest": digest, "version": version, "before": now.get("version"), **layout}))
    return True


def read_published(spark: SparkSession, root: str) -> DataFrame:
    """The rows that the manifest names."""
    folder = _Folder(spark, root)
    text = folder.text(MANIFEST)
    if text is None:
        raise FileNotFoundError(f"nothing is published at {root}")
    now = json.loads(text)
    schema = T.StructType.fromJson(now["schema"])
    return spark.read.format(now["kind"]).options(**OPTIONS[now["kind"]]).schema(schema).load(f"{folder.root}/{now['version']}").select(*schema.names)


def drop_versions(spark: SparkSession, root: str) -> None:
    """Deletes all versions but the published one, and what runs that failed have left."""
    folder = _Folder(spark, root)
    kept = json.loads(folder.text(MANIFEST) or "{}").get("version")
    for status in folder.files.listStatus(folder.path("")):
        name = status.getPath().getName()
        if name not in (kept, MANIFEST):
            folder.files.delete(status.getPath(), True)
