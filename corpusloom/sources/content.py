"""Content trees as tables: one row a file, front matter parsed beside the body."""

from __future__ import annotations

import datetime
import json
import re
import tomllib

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.plans.scratch import Scratch
from corpusloom.sources.stores import list_files, read_texts

_FRONT = re.compile(r"\A\+\+\+[ \t]*\r?\n(.*?)\r?\n?^\+\+\+[ \t]*(?:\r?\n|\Z)", re.DOTALL | re.MULTILINE)
_YAML = re.compile(r"\A---[ \t]*\r?\n(.*?)\r?\n?^---[ \t]*(?:\r?\n|\Z)", re.DOTALL | re.MULTILINE)
_LINE = re.compile(r"^\s*([A-Za-z_][\w-]*)\s*=+\s*(.+?)\s*$")


def read_markdown(spark: SparkSession, root: str, scratch: Scratch, languages: list[str] | None = None, since: datetime.datetime | None = None) -> DataFrame:
    """All markdown files below ``root``/<lang>: path, lang, rel_path, raw, modified.

    Folders are listed by tasks, only those of the ``languages`` wanted, and texts are read of
    files changed at or after ``since`` alone. Folders that start with a dot are passed over.
    """
    files = list_files(spark, root, scratch, languages).where(F.col("inside").endswith(".md"))
    wanted = files if since is None else files.where(F.col("modified") >= F.lit(since))
    lang = F.split("inside", "/")[0]
    rows = read_texts(wanted, root).where("raw IS NOT NULL")
    return rows.select(F.concat(F.lit(root.rstrip("/") + "/"), "inside").alias("path"), lang.alias("lang"), F.regexp_replace("inside", r"\A[^/]*/", "").alias("rel_path"), "raw", "modified")


def modified_within(files: DataFrame, seconds: int) -> DataFrame:
    """Files changed in the last ``seconds`` seconds."""
    return files.where(F.col("modified") >= F.current_timestamp() - F.make_dt_interval(secs=F.lit(float(seconds))))


def only_paths(files: DataFrame, wanted: DataFrame) -> DataFrame:
    """Files named in a list (column path)."""
    return files.join(wanted.select("path").distinct(), "path", "left_semi")


def languages(files: DataFrame, rule: str = "plain", known: list[str] | None = None) -> DataFrame:
    """Language folders: all, not starting with an underscore or dot (plain), of a list (known), or but English (other)."""
    found = files.select("lang").distinct()
    if rule == "plain":
        return found.where(~F.col("lang").rlike(r"\A[._]"))
    if rule == "known":
        return found.where(F.col("lang").isin(known or []))
    return found.where("lang <> 'en'") if rule == "other" else found


def _plain(value: object) -> object:
    """Values of TOML and YAML that JSON has too; dates as ISO text."""
    if isinstance(value, dict):
        return {str(k): _plain(v) for k, v in value.items()}
    if isinstance(value, list | tuple):
        return [_plain(v) for v in value]
    if isinstance(value, datetime.datetime | datetime.date | datetime.time):
        return value.isoformat()
    return value


def _recovered(block: str) -> dict:
    """What single lines of a malformed block state."""
    out: dict = {}
    for line in block.splitlines():
        found = _LINE.match(line)
        if found is None:
            continue
        try:
            out.update(tomllib.loads(f"{found[1]} = {found[2]}"))
        except tomllib.TOMLDecodeError:
            out[found[1]] = found[2].strip("\"'")
    return out


def parse_front_matter(raw: str | None, yaml_too: bool = False, recover: bool = False) -> tuple[dict, str]:
    """Metadata and body. Without front matter, or where it can't be parsed, all of the text is the body."""
    text = (raw or "").removeprefix("﻿")
    found = _FRONT.match(text)
    if found:
        try:
            return _plain(tomllib.loads(found[1])), text[found.end() :]
        except tomllib.TOMLDecodeError:
            return (_recovered(found[1]), text[found.end() :]) if recover else ({}, text)
    found = _YAML.match(text) if yaml_too else None
    if found:
        import yaml

        try:
            loaded = yaml.safe_load(found[1])
        except yaml.YAMLError:
            return {}, text
        return (_plain(loaded), text[found.end() :]) if isinstance(loaded, dict) else ({}, text)
    return {}, text


def front_matter(raw: Column, yaml_too: bool = False, recover: bool = False) -> Column:
    """Struct of meta (JSON text) and body.

    Only the block between the marks goes to Python; bodies of any length stay in the JVM.
    """

    @F.pandas_udf("meta string, parsed boolean")
    def run(heads: pd.Series) -> pd.DataFrame:
        parsed = [parse_front_matter(h, yaml_too, recover) for h in heads]
        return pd.DataFrame({"meta": [json.dumps(m, ensure_ascii=False) for m, _ in parsed], "parsed": [b == "" for _, b in parsed]})

    text = F.regexp_replace(F.coalesce(raw, F.lit("")), r"\A\x{FEFF}", "")
    # lines end at line feeds alone, as in Python; marks and block of _FRONT or _YAML, nothing where there are none
    block = lambda mark: F.regexp_extract(text, rf"(?dms)\A{mark}[ \t]*\r?\n(.*?)\r?\n?^{mark}[ \t]*(?:\r?\n|\z)", 0)
    head = F.when(F.startswith(text, F.lit("+++")), block(r"\+\+\+"))
    head = (head.when(F.startswith(text, F.lit("---")), block("---")) if yaml_too else head).otherwise("")
    found = run(head)
    return F.struct(found["meta"].alias("meta"), F.when(found["parsed"], F.substring(text, F.length(head) + 1, F.length(text))).otherwise(text).alias("body"))


def field(raw: Column, name: str) -> Column:
    """A text field of the front matter by pattern alone, without parsing it; null if absent."""
    block = F.regexp_extract(raw, r"(?s)\A\x{FEFF}?\+\+\+(.*?)\n\+\+\+", 1)
    return F.nullif(F.regexp_extract(block, rf"(?m)^{name}\s*=\s*[\"']([^\"'\n]*)[\"']", 1), F.lit(""))


def aliases(raw: Column) -> Column:
    """The list of former addresses, by pattern alone."""
    block = F.regexp_extract(raw, r"(?s)\A\x{FEFF}?\+\+\+(.*?)\n\+\+\+", 1)
    return F.regexp_extract_all(F.regexp_extract(block, r"(?ms)^aliases\s*=\s*\[(.*?)\]", 1), F.lit(r"[\"']([^\"']*)[\"']"), 1)


def pages(files: DataFrame) -> DataFrame:
    """Page records: metadata of the front matter as columns, section and body."""
    parsed = files.withColumn("__f", front_matter(F.col("raw")))
    meta = F.from_json("__f.meta", "title string, description string, url string, date string, draft boolean, image string, keywords array<string>, tags array<string>, categories array<string>, faq array<struct<question string, answer string>>")
    parts = F.split("rel_path", "/")
    return (
        parsed.withColumn("__m", meta)
        .select(*files.columns, "__m.*", F.col("__f.body").alias("body"), F.col("__f.meta").alias("meta"))
        .withColumn("section", F.when(F.size(parts) > 1, parts[0]).otherwise(F.lit("")))
        .withColumn("is_index", F.col("rel_path").rlike(r"(\A|/)_index\.md\z"))
    )


# ---- writing front matter ----


def toml_value(value: object) -> str:
    """One TOML value; none is the empty text."""
    if value is None:
        return '""'
    if isinstance(value, str):
        return json.dumps(value, ensure_ascii=False)
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, int | float):
        return repr(value)
    if isinstance(value, list | tuple):
        return "[" + ", ".join(toml_value(v) for v in value) + "]"
    if isinstance(value, dict):
        return "{" + ", ".join(f"{_key(k)} = {toml_value(v)}" for k, v in value.items()) + "}"
    return json.dumps(str(value), ensure_ascii=False)


def _key(name: str) -> str:
    return name if re.fullmatch(r"[A-Za-z0-9_-]+", name) else json.dumps(name, ensure_ascii=False)


def toml_text(data: dict) -> str:
    """A table as TOML: plain keys first, then tables and arrays of tables; keys without a value are left out."""
    plain, nested = [], []

    def emit(table: dict, prefix: str, out: list[str]) -> None:
        late = []
        for k, v in table.items():
            if v is None:
                continue
            if isinstance(v, dict):
                late.append((k, v, False))
            elif isinstance(v, list) and v and all(isinstance(x, dict) for x in v):
                late.append((k, v, True))
            else:
                out.append(f"{_key(k)} = {toml_value(v)}")
        for k, v, many in late:
            name = f"{prefix}{_key(k)}"
            for item in v if many else [v]:
                block: list[str] = []
                emit(item, name + ".", block)
                nested.append("\n".join([f"[[{name}]]" if many else f"[{name}]", *block]))

    emit(data, "", plain)
    return "\n\n".join(["\n".join(plain), *nested]).strip() + "\n"


def set_fields(raw: Column, values: Column) -> Column:
    """The file's text with front matter fields replaced or added; the body stays byte for byte.

    values: JSON object text. A file without front matter gets some.
    """

    @F.pandas_udf("string")
    def run(texts: pd.Series, new: pd.Series) -> pd.Series:
        out = []
        for text, change in zip(texts, new, strict=True):
            text = text or ""
            wanted = json.loads(change) if change else {}
            if not wanted:
                out.append(text)
                continue
            meta, body = parse_front_matter(text)
            out.append("+++\n" + toml_text({**meta, **wanted}) + "+++\n" + body)
        return pd.Series(out)

    return run(raw, values)
