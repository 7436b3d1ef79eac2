"""Text scalars as Column expressions; each takes and returns Columns and runs inside generated code.

Patterns use ``(?U)`` where letters and spaces of all scripts count.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that carry no topic, in anchors and n-grams.
STOPWORDS = (
    "the a an and or but of to in on at for with by from as is was are were be been this that these those it its our your "
    "their you we they i us them if so than then do does did have has had will would could should can may might into out up "
    "down very more most some any no not only also other such about over under all learn click here text title image images "
    "alt url link links try now free schedule demo"
).split()

# Words too general to tell one page from another (a site adds its own brands), and anchors that are none.
GENERIC_TERMS = (
    "copilot ai mcp llm tool tools agent agents automation workflow workflows platform chatbot chatbots ready use using help helps key "
    "point points inside paste better best create build make content page pages guide learn need needs feature features text title "
    "image images link links button"
).split()
BRAND_TERMS = "ai mcp llm".split()
BAD_ANCHORS = ["link text", "learn more", "read more", "try now", "try it now", "try it free", "schedule a demo", "book a demo", "get started", "click here"]

# Phrases of calls to action, and terms of interface data.
CTA_TERMS = ["try it free", "get started", "book a demo", "schedule a demo", "sign up"]
UI_TERMS = ["imaged", "imagealt", "linktext", "categorycolor", "primarycta"]

# Single words that are no keyword.
COMMON_WORDS = ["the", "a", "an", "and", "or", "but", "in", "on", "at", "to", "for", "of", "with", "give", "get", "use", "make"]

_EDGE = ".,;:!?()[]{}\"“”"


def words(values: list[str]) -> Column:
    """A list of strings as an array literal."""
    return F.array(*[F.lit(v) for v in values]) if values else F.array().cast("array<string>")


def normalize_space(text: Column) -> Column:
    """White space runs become one space, ends are trimmed, null becomes empty."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s+", " "))


def clip(text: Column, limit: int) -> Column:
    """At most ``limit`` characters of the normalised text, cut back to a word's end where there is one; 0 is no limit."""
    clean = normalize_space(text)
    if limit <= 0:
        return clean
    head = F.substring(clean, 1, limit)
    back = F.regexp_replace(head, r" [^ ]*\z", "")
    return F.when(F.length(clean) <= limit, clean).otherwise(F.when(back == "", head).otherwise(back))


def hard_clip(text: Column, limit: int = 2000) -> Column:
    return F.substring(text, 1, limit)


def strip_chars(text: Column, chars: str) -> Column:
    """Without the given characters at both ends."""
    inside = "".join("\\" + c for c in chars)
    return F.regexp_replace(text, rf"\A[{inside}]+|[{inside}]+\z", "")


def tokens(text: Column) -> Column:
    """Words that begin with a letter, inner apostrophes, dots and hyphens kept, edge punctuation dropped."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"(?U)([\w&&[^\d_]][\w'’.\-]*)"), 1)
    return F.filter(F.transform(found, lambda t: strip_chars(t, _EDGE)), lambda t: t != "")


def sentences(text: Column) -> Column:
    """Parts after full stops, exclamation and question marks."""
    return F.split(F.coalesce(text, F.lit("")), r"(?U)(?<=[.!?])\s+")


def word_count(text: Column) -> Column:
    """Words between white space."""
    clean = normalize_space(text)
    return F.when(clean == "", 0).otherwise(F.size(F.split(clean, " ")))


def ngrams(items: Column, n: int) -> Column:
    """Runs of n neighbours, joined by a space."""
    # neighbours come from shifted copies: a slice inside a lambda would evaluate ``items`` for each of them
    length = F.greatest(F.size(items) - F.lit(n - 1), F.lit(0))
    out = F.slice(items, F.lit(1), length)
    for k in range(1, n):
        out = F.zip_with(out, F.slice(items, F.lit(k + 1), length), lambda a, b: F.concat(a, F.lit(" "), b))
    return out


def keyword_words(text: Column) -> Column:
    """The lower-cased words of more than two characters."""
    plain = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"(?U)[^\w\s]", " ")
    return F.filter(F.split(normalize_space(plain), " "), lambda w: F.length(w) > 2)


def keyword_ngrams(text: Column, least: int = 2, most: int = 4) -> Column:
    """n-grams of the lower-cased words of more than two characters, shorter ones first."""
    kept = keyword_words(text)
    return F.flatten(F.array(*[ngrams(kept, n) for n in range(least, most + 1)]))


def keyword_ngram_ok(phrase: Column, stop: list[str], noise: list[str]) -> Column:
    """No word is markup noise, and some word is neither stop word nor noise."""
    parts = F.split(phrase, " ")
    return ~F.exists(parts, lambda w: w.isin(noise)) & F.exists(parts, lambda w: ~w.isin(stop + noise))


def embed_text(*parts: Column) -> Column:
    """The parts that are not empty, joined by a full stop and a space."""
    return F.concat_ws(". ", *[F.nullif(p, F.lit("")) for p in parts])


def page_label(url: Column, title: Column, description: Column, keywords: Column, most: int = 10) -> Column:
    """Url, its words, title, description and the first keywords as one text."""
    return normalize_space(F.concat_ws(" ", url, slug_words(url), title, description, F.array_join(F.slice(keywords, 1, most), " ")))


def slug_words(url: Column) -> Column:
    """Slashes, hyphens and underscores as spaces."""
    path = F.regexp_replace(url, r"\A[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*", "")
    path = F.regexp_replace(path, r"[?#].*", "")
    return F.translate(F.when(path == "", url).otherwise(path), "/-_", "   ")


def structured_data(text: Column) -> Column:
    """Whether a paragraph looks like data: no text, many braces and quotes, or interface terms."""
    bare = F.translate(text, '{}[]=:"', "")
    share = (F.length(text) - F.length(bare)) / F.greatest(F.length(text), F.lit(1))
    hits = sum((F.lower(text).contains(t).cast("int") for t in UI_TERMS), F.lit(0))
    return F.coalesce(text == "", F.lit(True)) | (share > 0.08) | (hits >= 2)


def paragraph_eligible(text: Column, least: int = 18, cta_least: int = 35) -> Column:
    """Long enough, and longer still if it calls to action."""
    n = F.size(tokens(text))
    cta = F.exists(words(CTA_TERMS), lambda t: F.lower(text).contains(t))
    return (n >= least) & ~(cta & (n < cta_least))


def keyword_pattern(keyword: Column) -> Column:
    """Pattern of a keyword between word borders where a hyphen counts as part of a word."""
    quoted = F.concat(F.lit(r"\Q"), F.replace(F.trim(keyword), F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))
    return F.concat(F.lit(r"(?iuU)(?<![\w-])"), quoted, F.lit(r"(?![\w-])"))


def mentions(text: Column, keyword: Column) -> Column:
    return F.regexp_like(text, keyword_pattern(keyword))


def clean_keywords(items: Column, most: int = 8) -> Column:
    """Keywords in lower case without quotes, short ones, numbers, single common words and repetitions."""
    bare = F.transform(items, lambda k: normalize_space(F.regexp_replace(F.lower(k), "[\"'“”«»]", "")))
    kept = F.filter(bare, lambda k: (F.length(k) >= 3) & ~F.regexp_like(k, F.lit(r"(?U)\A[\d\s]+\z")) & ~k.isin(COMMON_WORDS))
    return F.slice(F.array_distinct(kept), 1, most)


def split_badges(text: Column) -> Column:
    """Comma-separated items, trimmed."""
    return F.transform(F.split(text, ","), lambda b: F.trim(b))


def section_title(section: Column) -> Column:
    return F.initcap(F.translate(section, "-_", "  "))


def escape_html(text: Column) -> Column:
    for plain, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        text = F.replace(text, F.lit(plain), F.lit(safe))
    return text


def squeeze_markup(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"(?U)\s+", " "), r">\s+<", "><")


def safe_filename(text: Column, most: int = 100) -> Column:
    # runs of hyphens are the same before other characters become signs one by one, so only the end needs the signs
    short = F.when(F.contains(text, F.lit("--")), F.regexp_replace(text, "-{2,}", "-")).otherwise(text)
    return F.regexp_replace(F.right(short, F.lit(most)), r"[^A-Za-z0-9_-]", "_")


def unwrap_fence(text: Column) -> Column:
    """Without a code fence around the whole text."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.trim(text), r"\A```(?:markdown|md)?[ \t]*\n?", ""), r"\n?```\z", ""))


def headers(body: Column) -> Column:
    """Titles of the headings of the first three levels."""
    return F.transform(F.regexp_extract_all(body, F.lit(r"(?m)^#{1,3}[ \t]+(.+)$"), 1), lambda h: F.trim(h))


def clean_body(body: Column) -> Column:
    """Markdown without shortcodes, data, tags, link targets, code and marks."""
    steps = [
        (r"(?s)\{\{<\s*(\w+)[^>]*>\}\}.*?\{\{<\s*/\1\s*>\}\}", " "),
        (r"\{\{<[^>]*>\}\}", " "),
        (r"(?s)\[\s*\{[^\]]*\}\s*\]", " "),
        (r"\{[^{}]*\"[^\"]*\"[^{}]*\}", " "),
        (r"<[^>]+>", " "),
        (r"\[([^\]]+)\]\([^)]+\)", "$1"),
        (r"(?s)```.*?```", ""),
        (r"`[^`]+`", ""),
        (r"[#*_~]", ""),
    ]
    for pattern, new in steps:
        body = F.regexp_replace(body, pattern, new)
    return normalize_space(body)


def link_targets(body: Column) -> Column:
    """Targets of inline links within the site, canonical and distinct."""
    from corpusloom.functions.urls import canonical_path

    found = F.transform(F.regexp_extract_all(F.coalesce(body, F.lit("")), F.lit(r"\[[^\]]+\]\(([^)]+)\)"), 1), lambda t: F.trim(t))
    inside = F.filter(found, lambda t: ~F.regexp_like(t, F.lit(r"\A(?:https?://|#|mailto:|tel:)")))
    return F.array_distinct(F.transform(inside, canonical_path))


def heading_counts(body: Column) -> Column:
    """Map from level (2 to 6) to the number of headings; levels without any are left out."""
    found = F.regexp_extract_all(F.coalesce(body, F.lit("")), F.lit(r"(?m)^(#{2,6})\s+\S"), 1)
    levels = F.array_sort(F.array_distinct(F.transform(found, lambda h: F.length(h))))
    return F.map_from_entries(F.transform(levels, lambda n: F.struct(n.alias("level"), F.size(F.filter(found, lambda h: F.length(h) == n)).alias("n"))))


def shortcode_counts(body: Column, closing: bool = False) -> Column:
    """Map from shortcode name to how often it opens or closes."""
    pattern = r"\{\{[<%]\s*/\s*([a-zA-Z0-9_-]+)" if closing else r"\{\{[<%]\s*(?!/)([a-zA-Z0-9_-]+)"
    found = F.regexp_extract_all(F.coalesce(body, F.lit("")), F.lit(pattern), 1)
    names = F.array_sort(F.array_distinct(found))
    return F.map_from_entries(F.transform(names, lambda n: F.struct(n.alias("name"), F.size(F.filter(found, lambda f: f == n)).alias("n"))))


# Lengths from which on a title gets a smaller size, the largest length first.
SIZE_STEPS = [120, 100, 85, 70, 60, 50, 40]


def font_class(text: Column) -> Column:
    """Size class of a title by its length: the longer, the smaller."""
    steps = F.array(*[F.lit(n) for n in SIZE_STEPS])
    return F.concat(F.lit("size-"), (F.size(F.filter(steps, lambda n: n >= F.length(text))) + 1).cast("string"))


# Countries whose visitors are asked for consent.
CONSENT_COUNTRIES = "AT BE BG HR CY CZ DE DK EE ES FI FR GB GR HU IE IS IT LI LT LU LV MT NL NO PL PT RO SE SI SK CH UK EL".split()


def consent_region(country: Column) -> Column:
    return F.when(country.isNull(), F.lit(None)).when(F.upper(country).isin(CONSENT_COUNTRIES), "eu").otherwise("row")


def unset(value: Column) -> Column:
    """Whether a template value counts as unset: null, an empty text or list, or a zero."""
    return value.isNull() | value.cast("string").isin("", "0", "0.0", "[]", "{}")


def default(value: Column, other: Column) -> Column:
    return F.when(unset(value), other).otherwise(value)
