"""Cases that earlier versions got wrong: an index opened with other settings, maps, repeated ids, labels of other types, malformed headers."""

import gzip
import zlib

import pytest

from corpusloom.llm import toxicity
from corpusloom.llm.embedding_dedup import link_vectors
from corpusloom.llm.exact_dedup import DigestIndex, exact_dedup, keep_first
from corpusloom.llm.warc import parse, read_archives, whole_number


def test_index_keeps_its_buckets(spark, tmp_path):
    path = (tmp_path / "index").as_uri()
    docs = spark.createDataFrame([(k, f"text {k}") for k in range(200)], "doc_id long, text string")
    setting = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for turn, count in enumerate(["8", "8", "4", "16", "1"]):
            spark.conf.set("spark.sql.shuffle.partitions", count)
            index = DigestIndex(spark, path)
            assert index.buckets == 8
            kept = exact_dedup(docs, index=index, batch=f"b{turn}").where("kept").count()
            assert kept == (0 if turn else 200)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", setting)
    with pytest.raises(ValueError, match="8 buckets"):
        DigestIndex(spark, path, 4)
    index = DigestIndex(spark, path, 8)
    assert index.rows().count() == 200
    with pytest.raises(ValueError, match="b0"):
        exact_dedup(docs, index=index, batch="b0")


def test_map_columns_stay(spark):
    docs = spark.createDataFrame([(1, "a", {"x": 1}, [{"y": 2}]), (1, "a", {"x": 2}, [{"y": 2}]), (2, "a", None, None), (3, "b", {}, [])], "doc_id long, text string, m map<string,int>, n array<map<string,int>>")
    got = sorted(keep_first(docs).collect())
    assert [r.doc_id for r in got] == [1, 3] and got[1].m == {} and got[0].n == [{"y": 2}]


def test_sample_is_bounded(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "SAMPLE_ROWS", {1: 2, 0: 2})
    ids = [k for k in range(1, 60) if zlib.crc32(str(k).encode()) % 5]
    docs = spark.createDataFrame([(k, f"t{k} {n}") for k in ids for n in range(300 if k == ids[0] else 2)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in ids], "doc_id long, toxic int")
    rows = toxicity.sample(docs, labels, "doc_id", "text", "toxic").collect()
    assert len(rows) == 4 and all(r.text.endswith(" 0") for r in rows)


@pytest.mark.parametrize("kind, labels", [("string", ["a", "b"]), ("double", [1.2, 1.7]), ("date", None)])
def test_labels_of_any_type(spark, kind, labels):
    import datetime

    one, two = labels or [datetime.date(2020, 1, 1), datetime.date(2020, 1, 2)]
    rows = [(1, [1.0, 0.0], one), (2, [1.0, 0.01], one), (3, [1.0, 0.0], two), (4, [1.0, 0.0], None)]
    got = {r.vec_id: (r.n_links, r.component_id) for r in link_vectors(spark.createDataFrame(rows, f"vec_id long, embedding array<float>, label {kind}")).collect()}
    assert got == {1: (1, 1), 2: (1, 1), 3: (0, 3), 4: (0, 4)}


def test_malformed_headers(spark, tmp_path):
    head = "WARC/1.0\r\nWARC-Type: response\r\nX-Page-Id: {}\r\nContent-Length: {}\r\n\r\nbody\r\n\r\n"
    records = [head.format(*x) for x in [(1, 4), (2, "x"), (3, "-4"), ("9" * 30, 4), ("²", "4"), (5, "")]]
    path = tmp_path / "a.warc.gz"
    path.write_bytes(b"".join(gzip.compress(r.encode()) for r in records))
    manifest = spark.createDataFrame([(path.as_uri(), path.stat().st_size)], "path string, bytes long")
    got = [(r.page_id, r.payload_bytes) for r in read_archives(spark, manifest).collect()]
    assert sorted(got, key=str) == [(1, 4), (None, 4), (None, 4)]
    assert parse(records[1].encode()) is None and whole_number("12") == 12 and whole_number("1.5") is None


def test_a_byte_bpe_piece_is_encoded_when_it_is_asked_for():
    """The memo stays bounded while one text has more new pieces than it holds, and pieces over 64 characters are not kept."""
    import numpy as np
    import public_tokenizers
    from tokenizers import Tokenizer

    from corpusloom.llm.byte_bpe import BpeModel

    path = public_tokenizers.path("byte_bpe_50k.json")
    tokenizer, model = Tokenizer.from_file(path), BpeModel(path, memo=20)
    texts = ["", " ".join(f"w{k} abc{'d' * (k % 9)}," for k in range(200)), "x" * 80 + ", y" + "z" * 90, "<|endoftext|>, x", "a\0b c", "  a\n\nb ", "é, ü. 日本, ٣ it's"]
    got = [np.frombuffer(ids, "<u4").tolist() for ids in model.encode(texts)]
    assert got == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    assert 0 < len(model.memo) <= 20 and max(map(len, model.memo)) <= 64
