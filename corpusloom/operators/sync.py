"""Relational synchronisation of languages: what is missing, what differs, who owns an address."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions.slugs import slug
from corpusloom.functions.urls import ensure_slashes, split_slug


def missing_translations(english: DataFrame, languages: DataFrame, existing: DataFrame, force: bool = False) -> DataFrame:
    """(rel_path, lang) of every English file and target language that has no file; all of them if forced.

    All files meet all languages, as asked; Spark ships the languages only while they are small.
    """
    every = english.select("rel_path").distinct().crossJoin(languages.select("lang").distinct().where("lang <> 'en'"))
    return every if force else every.join(existing.select("rel_path", "lang"), ["rel_path", "lang"], "left_anti")


def counterparts(pages: DataFrame) -> DataFrame:
    """Pairs of an English page and the page of the same path in another language."""
    english = pages.where("lang = 'en'").select([F.col(c) if c == "rel_path" else F.col(c).alias(f"en_{c}") for c in pages.columns])
    return english.join(pages.where("lang <> 'en'"), "rel_path")


def missing_keys(i18n: DataFrame, source: str = "en") -> DataFrame:
    """(lang, key, value): keys that a language lacks, with the source's value. i18n: lang, key, value."""
    base = i18n.where(F.col("lang") == source).groupBy("key").agg(F.first("value").alias("value"))
    langs = i18n.select("lang").distinct().where(F.col("lang") != source)
    return base.crossJoin(langs).join(i18n.select("lang", "key"), ["lang", "key"], "left_anti").select("lang", "key", "value")


def synced_keys(i18n: DataFrame, source: str = "en") -> DataFrame:
    return i18n.select("lang", "key", "value").unionByName(missing_keys(i18n, source))


def attribute_changes(pages: DataFrame, attributes: list[str]) -> DataFrame:
    """(rel_path, lang, changes): attributes of the English page that the translation has otherwise.

    pages: rel_path, lang, attrs (map of texts). A missing English date counts as six hours ago.
    """
    pairs = counterparts(pages.select("rel_path", "lang", "attrs"))
    now = F.date_format(F.current_timestamp() - F.expr("INTERVAL 6 HOURS"), "yyyy-MM-dd HH:mm:ss")
    english = F.when(F.map_contains_key("en_attrs", "date"), F.col("en_attrs")).otherwise(F.map_concat("en_attrs", F.create_map(F.lit("date"), now)))
    wanted = F.map_filter(english, lambda k, v: k.isin(attributes))
    changes = F.map_filter(wanted, lambda k, v: ~v.eqNullSafe(F.try_element_at(F.col("attrs"), k)))
    return pairs.select("rel_path", "lang", changes.alias("changes")).where(F.size("changes") > 0)


def translation_map(pages: DataFrame) -> DataFrame:
    """(folder, rel_path, urls): a map from language to address. pages: folder, rel_path, lang, url, with one url a language."""
    one = pages.groupBy("folder", "rel_path", "lang").agg(F.min("url").alias("url"))
    return one.groupBy("folder", "rel_path").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("lang", "url")))).alias("urls"))


def translation_pivot(pages: DataFrame, languages: list[str]) -> DataFrame:
    """One column a language with the address there."""
    return pages.groupBy("folder", "rel_path").pivot("lang", languages).agg(F.min("url"))


def folder_stats(urls: DataFrame) -> DataFrame:
    """(folder, n_pages, n_urls), the folders with most addresses first."""
    return urls.groupBy("folder").agg(F.count("*").alias("n_pages"), F.sum(F.size("urls")).alias("n_urls")).orderBy(F.col("n_urls").desc(), "folder")


def directory_urls(indexes: DataFrame, directories: DataFrame, prefixed: bool = True) -> DataFrame:
    """(lang, dir, url): address of each folder from the slugs that the index pages of it and of its ancestors state.

    indexes: lang, dir, slug. directories: lang, dir (without slashes at the ends). A folder
    whose index states none keeps its name; with ``prefixed`` other languages than English
    begin with their code.
    """
    parts = directories.select("lang", "dir", F.posexplode(F.split("dir", "/")).alias("i", "name"))
    prefix = F.array_join(F.slice(F.split("dir", "/"), F.lit(1), F.col("i") + 1), "/")
    steps = parts.withColumn("prefix", prefix).join(indexes.select("lang", F.col("dir").alias("prefix"), "slug"), ["lang", "prefix"], "left")
    named = steps.withColumn("part", F.coalesce(F.nullif(F.trim("slug"), F.lit("")), F.col("name")))
    joined = named.groupBy("lang", "dir").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("i", "part"))), lambda x: x["part"]), "/").alias("p"))
    start = F.when(F.lit(prefixed) & (F.col("lang") != "en"), F.concat(F.col("lang"), F.lit("/"))).otherwise(F.lit(""))
    return joined.select("lang", "dir", ensure_slashes(F.concat(start, F.col("p"))).alias("url"))


def url_status(pages: DataFrame) -> DataFrame:
    """The rows with status: added where no address is stated, correct where it is the expected one, else fixed. pages: url, expected."""
    clean = F.trim(F.coalesce("url", F.lit("")))
    return pages.withColumn("status", F.when(clean == "", "added").when(clean == F.col("expected"), "correct").otherwise("fixed"))


def redirects(indexes: DataFrame) -> DataFrame:
    """(source, target, status): two rules for each folder index whose address is not its folder's.

    indexes: lang, dir, url; English and the root have none.
    """
    folder = F.concat(F.lit("/"), F.col("lang"), F.lit("/"), F.col("dir"), F.lit("/"))
    rows = indexes.where("lang <> 'en' AND coalesce(dir, '') <> '' AND coalesce(url, '') <> ''").select(folder.alias("f"), "url").where("f <> url")
    cut = lambda c: F.substring(c, F.lit(1), F.length(c) - 1)
    rules = F.array(
        F.struct(F.col("f").alias("source"), F.col("url").alias("target")),
        F.struct(F.concat(cut(F.col("f")), F.lit("/*")).alias("source"), F.concat(cut(F.col("url")), F.lit("/:splat")).alias("target")),
    )
    return rows.select(F.explode(rules).alias("r")).select("r.*", F.lit("301").alias("status"))


def owners(pages: DataFrame) -> DataFrame:
    """(lang, address, owner): the first page in scan order that has an address as its own or a former one.

    pages: lang, rel_path, pos, url, aliases.
    """
    claims = pages.select("lang", "rel_path", "pos", F.explode(F.array_union(F.array("url"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("address"))
    return claims.where("coalesce(address, '') <> ''").groupBy("lang", "address").agg(F.min(F.struct("pos", "rel_path")).alias("o")).select("lang", "address", F.col("o.rel_path").alias("owner"))


def distinct_host_policy(urls: DataFrame) -> DataFrame:
    """Whether languages have hosts of their own: (prefix) true for one host, false for more, null for none. urls: host."""
    n = F.countDistinct(F.nullif("host", F.lit("")))
    return urls.agg(F.when(n == 0, F.lit(None).cast("boolean")).otherwise(n == 1).alias("prefix"))


#: Brand names that a site may have.
BRAND_ROWS = 10_000


def resolve_urls(pages: DataFrame, owned: DataFrame, history: DataFrame, brands: DataFrame, passthrough: list[str], english_languages: list[str], language_prefix: bool = True, aliases: bool = True, longest: int = 80) -> DataFrame:
    """(rel_path, lang, url, alias, reason): the address of each translated page.

    pages: rel_path, lang, en_url, translated_url, section_prefix. owned: lang, address,
    owner. history: rel_path, lang, previous. brands: word. A formerly published address
    wins unless another page owns it now; then sections and languages that keep the English
    slug; then the translated slug, unless nothing of it is left or it lost a brand name.
    An address that another page owns falls back to the English slug, or to none where that
    is owned too. Pages that claim one address in the same run: the first by path has it.
    """
    if brands.limit(BRAND_ROWS + 1).count() > BRAND_ROWS:
        raise ValueError(f"more than {BRAND_ROWS} brand names: every address would be searched for each")
    words = brands.agg(F.collect_set("word").alias("brands"))
    rows = pages.join(history, ["rel_path", "lang"], "left").crossJoin(F.broadcast(words))
    en = split_slug(ensure_slashes(F.col("en_url")))
    join = lambda *parts: ensure_slashes(F.array_join(F.filter(F.array(*parts), lambda p: F.coalesce(p, F.lit("")) != ""), "/"))
    rows = rows.withColumns({"section": F.when(F.contains("rel_path", F.lit("/")), F.split("rel_path", "/")[0]).otherwise(F.lit("")), "en": en})
    rows = rows.withColumn("own", slug(split_slug(F.col("translated_url"))["slug"], F.col("lang"), longest))
    prefix = F.coalesce("section_prefix", F.when(F.lit(language_prefix), F.array_join(F.filter(F.array("lang", "en.prefix"), lambda p: p != ""), "/")).otherwise(F.col("en.prefix")))
    english_prefix = F.when(F.lit(language_prefix) & (F.split("en.prefix", "/")[0] != F.col("lang")), F.array_join(F.filter(F.array("lang", "en.prefix"), lambda p: p != ""), "/")).otherwise(F.col("en.prefix"))
    lost = F.array_sort(F.array_except(F.array_intersect(F.split("en.slug", "-"), "brands"), F.split("own", "-")))
    rows = rows.withColumns({"fallback": join(prefix, F.col("en.slug")), "english_path": join(english_prefix, F.col("en.slug")), "lost": lost})
    kept = F.col("section").isin(passthrough) | F.col("lang").isin(english_languages)
    use_own = (F.col("own") != "") & (F.col("own") != F.col("en.slug")) & (F.size("lost") == 0)
    fresh = F.when(kept | ~use_own, F.col("fallback")).otherwise(join(prefix, F.col("own")))
    why = (
        F.when(F.col("section").isin(passthrough), F.format_string('section "%s" keeps the english slug', "section"))
        .when(F.col("lang").isin(english_languages), F.format_string('language "%s" keeps the english slug', "lang"))
        .when(F.col("own") == "", "flow returned no usable slug, fell back to english")
        .when(F.col("own") == F.col("en.slug"), "flow returned the english slug unchanged")
        .when(F.size("lost") > 0, F.concat(F.lit("translated slug dropped brand name(s) "), F.array_join("lost", ", "), F.lit(", fell back to english")))
        .otherwise("translated slug")
    )

    def owner_of(frame: DataFrame, address: str, name: str) -> DataFrame:
        mine = owned.select("lang", F.col("address").alias(address), F.col("owner").alias(name))
        other = frame.join(mine, ["lang", address], "left")
        return other.withColumn(name, F.when(F.col(name) != F.col("rel_path"), F.col(name)))

    rows = owner_of(rows, "previous", "previous_owner")
    restore = F.col("previous").isNotNull() & F.col("previous_owner").isNull()
    rows = rows.withColumns({"wish": F.when(restore, F.col("previous")).otherwise(fresh), "reason": F.when(restore, "restored previously published url").otherwise(why)})
    rows = owner_of(owner_of(owner_of(rows, "wish", "wish_owner"), "fallback", "fallback_owner"), "english_path", "alias_owner")
    # claims of the same run
    first = Window.partitionBy("lang", "wish").orderBy("rel_path")
    rows = rows.withColumn("wish_owner", F.coalesce("wish_owner", F.when(F.row_number().over(first) > 1, F.first("rel_path").over(first))))
    free = F.col("wish_owner").isNull()
    second = ~free & (F.col("fallback") != F.col("wish")) & F.col("fallback_owner").isNull()
    no_url, is_index = F.trim(F.coalesce("en_url", F.lit(""))) == "", F.col("rel_path").rlike(r"(\A|/)_index\.md\z")
    url = F.when(no_url | is_index, F.lit(None)).when(free, F.col("wish")).when(second, F.col("fallback"))
    reason = (
        F.when(no_url, "english page has no explicit url")
        .when(is_index, "section index, url left for a human to decide")
        .when(free, F.col("reason"))
        .when(second, F.concat("reason", F.lit("; collided with "), "wish_owner", F.lit(", used english slug")))
        .otherwise(F.concat(F.lit("url "), "wish", F.lit(" collides with "), "wish_owner", F.lit(" and the english slug is taken too")))
    )
    alias = F.when(F.lit(aliases) & url.isNotNull() & (url != F.col("english_path")) & F.col("alias_owner").isNull(), F.col("english_path"))
    return rows.select("rel_path", "lang", url.alias("url"), alias.alias("alias"), reason.alias("reason"))


def faq_rows(pages: DataFrame) -> DataFrame:
    """(file, text): question and answer side by side, where both have text. pages: file, faq."""
    rows = pages.select("file", F.explode("faq").alias("q")).select("file", F.trim("q.question").alias("q"), F.trim("q.answer").alias("a"))
    return rows.where("coalesce(q, '') <> '' AND coalesce(a, '') <> ''").select("file", F.concat_ws(" ", "q", "a").alias("text"))


def changed_bodies(staged: DataFrame, head: DataFrame) -> DataFrame:
    """Staged files (path, body) that are new or whose body is another than the head's."""
    old = head.select("path", F.col("body").alias("head_body"))
    return staged.join(old, "path", "left").where("head_body IS NULL OR body <> head_body").drop("head_body")


def nearest_titles(lines: DataFrame) -> DataFrame:
    """The lines (file, line, title or null) with the title at or above each; ``untitled`` where there is none."""
    above = Window.partitionBy("file").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    return lines.withColumn("nearest", F.coalesce(F.last("title", ignorenulls=True).over(above), F.lit("untitled")))
