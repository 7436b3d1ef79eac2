"""Values of pages and parameters: defaults, strings, maps, lists, nested attributes, dates, JSON."""

from __future__ import annotations

import json
import re
import tomllib

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- strings ----


def humanize(text: Column) -> Column:
    """Hyphens and underscores as spaces, the first letter large."""
    plain = F.lower(F.trim(F.translate(text, "-_", "  ")))
    return F.concat(F.upper(F.left(plain, F.lit(1))), F.substring(plain, F.lit(2), F.length(plain)))


def trim_prefix(text: Column, prefix: str) -> Column:
    return F.when(F.startswith(text, F.lit(prefix)), F.substring(text, F.lit(len(prefix) + 1), F.length(text))).otherwise(text)


def replace_pattern(text: Column, pattern: str, new: str) -> Column:
    return F.regexp_replace(text, pattern, new)


def any_in(text: Column, parts: list[str]) -> Column:
    """Whether the text has any of the parts in it; a null text has none."""
    return F.exists(F.array(*[F.lit(p) for p in parts]), lambda p: F.contains(F.coalesce(text, F.lit("")), p))


# ---- maps and lists ----


def merged(base: Column, over: Column) -> Column:
    """Both maps as one; where they share a key, the second's value counts."""
    return F.map_concat(F.map_filter(base, lambda k, v: ~F.map_contains_key(over, k)), over)


def subset(attributes: Column, names: list[str]) -> Column:
    """The map's entries of the given names."""
    return F.map_filter(attributes, lambda k, v: k.isin(names))


def appended(items: Column, *new: Column) -> Column:
    """The list with more at its end; no list counts as an empty one."""
    return F.concat(F.coalesce(items, F.array().cast("array<string>")), F.array(*new))


def item(items: Column, at: int) -> Column:
    """The item at a position from zero, null beyond the ends."""
    return F.get(items, F.lit(at))


# ---- nested attributes of JSON ----


def nested_get(value: Column, path: str) -> Column:
    """Texts at ``a.b`` (a list of one) or at ``a[].b`` (one of each item that has it) of a JSON object; null where there is none.

    value: JSON text. Numbers and truth values come as their JSON text, objects and lists too.
    """
    whole = F.try_parse_json(value)
    if "[]" not in path:
        found = F.try_variant_get(whole, "$." + path, "string")
        return F.when(found.isNotNull(), F.array(found))
    array, key = (part.strip(".") for part in path.split("[]", 1))
    items = F.try_variant_get(whole, "$" + ("." + array if array else ""), "array<variant>")
    found = F.filter(F.transform(items, lambda x: F.try_variant_get(x, "$." + key, "string")), lambda x: x.isNotNull())
    return F.when(F.size(found) > 0, found)


def _put(value: str | None, path: str, new: str, index: int | None) -> str | None:
    """The JSON text with a text at a path; objects on the way are made, an item beyond the list's end is not."""
    try:
        whole = json.loads(value or "{}")
    except ValueError:
        return value
    if not isinstance(whole, dict):
        return value
    array, bracket, last = path.rpartition("[]")
    *way, end = [k for k in (array if bracket else path).split(".") if k] or [""]
    if bracket:
        way, end = [*way, end] if end else way, last.strip(".")
    at: object = whole
    for key in way:
        if not isinstance(at, dict):
            return value
        at = at.setdefault(key, {})
    if bracket:
        at = at[index] if isinstance(at, list) and index is not None and 0 <= index < len(at) else None
    if isinstance(at, dict):
        at[end] = new
    return json.dumps(whole, ensure_ascii=False)


def nested_set(value: Column, path: str, new: Column, index: int | None = None) -> Column:
    """JSON text with a new text at ``a.b``, or at ``a[].b`` of the item at a position from zero. What is no JSON object stays."""

    @F.pandas_udf("string")
    def run(values: pd.Series, news: pd.Series) -> pd.Series:
        return pd.Series([_put(v, path, n, index) for v, n in zip(values, news, strict=True)])

    return run(value, new)


def parsed(value: Column, schema: str) -> Column:
    """A JSON parameter as a value of the schema; null where it does not parse."""
    return F.from_json(value, schema)


def jsonified(value: Column) -> Column:
    return F.to_json(value)


# ---- dates ----

# Parts of a date layout that shows a reference day, and the same parts as letters; longer ones first.
_LAYOUT = {"January": "MMMM", "Monday": "EEEE", "2006": "yyyy", "Jan": "MMM", "Mon": "EEE", "MST": "zzz", "PM": "a", "pm": "a", "01": "MM", "02": "dd", "03": "hh", "04": "mm", "05": "ss", "06": "yy", "15": "HH", "1": "M", "2": "d", "3": "h", "4": "m", "5": "s"}


def date_pattern(layout: str) -> str:
    """Spark's pattern of a layout that shows how 2 January 2006, 15:04:05 is written."""
    out = []
    for part in re.findall("|".join([*_LAYOUT, r"[A-Za-z]+", r"."]), layout, re.DOTALL):
        out.append(_LAYOUT.get(part) or (f"'{part}'" if part.isalpha() else part.replace("'", "''")))
    return "".join(out)


def format_date(date: Column, layouts: dict[str, str] | None = None, lang: Column | None = None, fallback: str = "Jan 2, 2006") -> Column:
    """A date by its language's layout, else by the fallback."""
    out = F.date_format(date, date_pattern(fallback))
    for code, layout in (layouts or {}).items():
        out = F.when(lang == code, F.date_format(date, date_pattern(layout))).otherwise(out)
    return out


def iso_stamp(moment: Column) -> Column:
    return F.date_format(moment, "yyyy-MM-dd'T'HH:mm:ssXXX")


def default_date(date: Column, hours: int = 6) -> Column:
    """The date, or some hours ago."""
    return F.coalesce(date, F.current_timestamp() - F.make_interval(hours=F.lit(hours)))


# ---- front matter ----


def front_matter_problem(raw: Column, required: bool = False) -> Column:
    """Null where the TOML between ``+++`` marks parses, else what is wrong; a file without the marks is wrong only if they are required.

    Only what stands between the marks goes to Python.
    """

    def problem(block: str | None) -> str | None:
        if block is None:
            return "no front matter between +++ marks" if required else None
        try:
            tomllib.loads(block)
        except tomllib.TOMLDecodeError as error:
            return str(error)
        return None

    @F.pandas_udf("string")
    def run(blocks: pd.Series) -> pd.Series:
        return pd.Series([problem(b) for b in blocks], dtype=object)

    parts = F.split(F.coalesce(raw, F.lit("")), r"\+\+\+", 3)
    return run(F.when((F.size(parts) == 3) & (F.get(parts, F.lit(0)) == ""), F.get(parts, F.lit(1))))
