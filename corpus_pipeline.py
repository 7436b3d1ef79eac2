"""From raw documents to packed training sequences, one operator a stage.

Each stage works on all rows that the one before kept. Rows go through the operators as
one struct beside id and text, so columns of any name pass unchanged. Every stage gives no
rows for an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.exact_dedup import keep_first
from corpusloom.llm.ngram_join import Similarity, link_documents
from corpusloom.llm.packing import pack_documents
from corpusloom.llm.queries import tokenizer_path
from corpusloom.plans.scratch import Scratch
from corpusloom.llm.substring_dedup import remove_repeats
from corpusloom.llm.toxicity import fit, score


def _held(docs: DataFrame) -> DataFrame:
    """Id, text and the rest of the row."""
    rest = [F.col(f"`{c}`") for c in docs.columns if c != "text"]
    return docs.select("doc_id", "text", F.struct(*rest).alias("__row"))


def _columns(docs: DataFrame, new: dict | None = None) -> list:
    """The columns of the documents, out of text and the rest of the row."""
    new = new or {}
    return [(new[c] if c in new else F.col("text") if c == "text" else F.col(f"__row.`{c}`")).alias(c) for c in docs.columns]


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the classifier, trained on the labelled ones, rejects.

    Null and empty texts get the score of a text without features. Without labels of both
    kinds nothing is rejected. Repeated rows share their fate.
    """
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(_held(docs), model, keep=["text", "__row"]).where("predicted = 0").select(*_columns(docs))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the smallest id stays.

    A null text equals an empty one. Of repeated rows exactly one stays; null ids come last.
    """
    return keep_first(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents connected by five-word shingle sets of a similarity of 0.8 or more the one with the smallest id stays.

    Null and empty texts, and rows without an id, are linked with nothing and stay. Rows
    that share an id are one document: all stay or go.
    """
    gone = link_documents(docs, Similarity(words=5, least=80, scale=100)).where("doc_id <> component_id").select("doc_id").distinct()
    gone = Scratch(spark, "near").table(gone, "gone")
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words and more that start in an earlier document go; other texts stay as they are.

    Null stays null and empty empty; n_chars follows the text where something went. A text
    of which nothing is left stays as an empty one. Rows that share an id take nothing from
    each other.
    """
    done = remove_repeats(_held(docs), window=50, keep=["__row"])
    new = {"text": F.col("kept_text")}
    if "n_chars" in docs.columns:
        n = F.length("kept_text").cast(dict(docs.dtypes)["n_chars"])
        new["n_chars"] = F.when(F.col("n_removed") > 0, n).otherwise(F.col("__row.n_chars"))
    return done.select(*_columns(docs, new))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sequences that the documents are packed into, piece by piece.

    A null text is an empty one, with the end mark alone. Repeated rows are packed each.
    """
    return pack_documents(docs, tokenizer_path("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", toxicity),
    ("exact dedup", exact),
    ("n-gram Jaccard join", near),
    ("substring dedup", substrings),
    ("best-fit packing", packing),
]

#: A trained classifier, a genetic algorithm and a tokenizer are in it: SQL can't express it.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written and read again."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        new = scratch.table(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        if k:
            scratch.drop(docs)
        docs = new
    return docs


QUERIES = {"pipeline": run}
ORACLES: dict[str, str] = {}
