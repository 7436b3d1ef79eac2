"""Slugs: folding of letters to ASCII, and brand words."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Letters that a language writes as two in addresses.
LETTERS = {
    "de": {"ä": "ae", "ö": "oe", "ü": "ue", "ß": "ss"},
    "sv": {"å": "aa", "ä": "ae", "ö": "oe"},
    "da": {"æ": "ae", "ø": "oe", "å": "aa"},
    "no": {"æ": "ae", "ø": "oe", "å": "aa"},
    "fi": {"ä": "ae", "ö": "oe"},
}
# Letters that are no base letter with a mark.
WHOLE_LETTERS = {"ł": "l", "ø": "o", "æ": "ae", "œ": "oe", "đ": "d", "ð": "d", "þ": "th", "ß": "ss", "ı": "i", "ħ": "h", "ŋ": "n"}

# Ordinary words in names of product pages.
NO_BRANDS = (
    "alternative alternatives migration integration integrations software app apps plugin free vs and for the chat live help "
    "desk email mail phone call sms crm api cloud web online best top new to of business virtual assistant agent agents center "
    "centre service services support customer ticket ticketing system systems tool tools marketing social media video voice voip "
    "sales team inbox form forms"
).split()


def fold(raw: str | None, lang: str | None, most: int = 80) -> str:
    """A slug of ASCII letters, digits and hyphens; empty where letters remain that have none."""
    text = (raw or "").strip().lower()
    text = text.translate(str.maketrans(LETTERS.get(lang or "", {}))).translate(str.maketrans(WHOLE_LETTERS))
    text = "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))
    if not text.isascii():
        return ""
    text = "-".join(re.findall("[a-z0-9]+", text))
    if most and len(text) > most:
        text = text[:most].rsplit("-", 1)[0].strip("-")
    return text


def slug(raw: Column, lang: Column, most: int = 80) -> Column:
    @F.pandas_udf("string")
    def run(texts: pd.Series, langs: pd.Series) -> pd.Series:
        return pd.Series([fold(t, g, most) for t, g in zip(texts, langs, strict=True)])

    return run(raw, lang)


def brand_words(pages: DataFrame, sections: list[str], suffixes: list[str], extra: list[str] | None = None) -> DataFrame:
    """(word) of product names in English file names: all of the given sections, and those before the given endings at the root.

    pages: lang, rel_path.
    """
    english = pages.where("lang = 'en'")
    parts = F.split("rel_path", "/")
    stem = F.lower(F.regexp_replace(F.element_at(parts, -1), r"\.md\z", ""))
    named = english.where((F.size(parts) == 2) & parts[0].isin(sections) & (stem != "_index")).select(stem.alias("s"))
    ending = "|".join(re.escape(s) for s in suffixes) or r"(?!)"
    versus = english.where((F.size(parts) == 1) & stem.rlike(f"(?:{ending})\\z")).select(F.regexp_replace(stem, f"(?:{ending})\\z", "").alias("s"))
    found = named.union(versus).select(F.explode(F.split("s", "-")).alias("word")).where((F.length("word") > 2) & ~F.col("word").isin(NO_BRANDS))
    if extra:
        found = found.union(pages.sparkSession.createDataFrame([(w.lower(),) for w in extra], "word string"))
    return found.distinct()
