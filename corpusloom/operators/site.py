"""Lookups and filters of a site's pages: exclusions, authors, ancestors, terms, menus, assets, questions.

Every lookup is a join by key, so a side of any size will do; small sides are Spark's to broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Names of languages by code.
LANGUAGES = {
    "af": "Afrikaans", "ar": "Arabic", "bg": "Bulgarian", "bn": "Bengali", "ca": "Catalan", "cs": "Czech", "da": "Danish", "de": "German", "el": "Greek",
    "en": "English", "es": "Spanish", "et": "Estonian", "fa": "Persian", "fi": "Finnish", "fr": "French", "he": "Hebrew", "hi": "Hindi", "hr": "Croatian",
    "hu": "Hungarian", "id": "Indonesian", "is": "Icelandic", "it": "Italian", "ja": "Japanese", "ko": "Korean", "lt": "Lithuanian", "lv": "Latvian",
    "ms": "Malay", "nl": "Dutch", "no": "Norwegian", "pl": "Polish", "pt": "Portuguese", "ro": "Romanian", "ru": "Russian", "sk": "Slovak", "sl": "Slovenian",
    "sq": "Albanian", "sr": "Serbian", "sv": "Swedish", "sw": "Swahili", "ta": "Tamil", "th": "Thai", "tr": "Turkish", "uk": "Ukrainian", "ur": "Urdu",
    "vi": "Vietnamese", "zh": "Chinese", "us": "American English", "pt-br": "Brazilian Portuguese", "zh-cn": "Simplified Chinese",
    "zh-tw": "Traditional Chinese", "en-gb": "British English", "en-us": "American English", "es-mx": "Mexican Spanish", "ch": "Swiss German",
    "cy": "Welsh", "gl": "Galician", "mt": "Maltese", "eu": "Basque",
}
# Marks of embedded videos.
VIDEO_MARKS = ["data-video-url", "data-video-id", "data-video-embed"]


def without_excluded(pages: DataFrame, exclusions: list[str], path: str = "rel_path") -> DataFrame:
    """Pages that are neither one of the paths nor below one of them; a null path is below nothing."""
    names = [e.rstrip("/") for e in exclusions if e.strip("/")]
    hit = F.lit(False)
    for name in names:
        hit = hit | F.startswith(F.col(path), F.lit(name + "/"))
    return pages.where(~F.coalesce(hit | F.col(path).isin(names), F.lit(False))) if names else pages


def titled(pages: DataFrame, or_described: bool = False) -> DataFrame:
    """Pages with a title, or, if that is enough, with a description."""
    filled = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))) != ""
    return pages.where(filled("title") | filled("description") if or_described else filled("title"))


def latest(pages: DataFrame, kind: str, most: int) -> DataFrame:
    """The first pages of a type: by weight (none or 0 last), then the newest, then by title and path."""
    weight = F.coalesce(F.nullif(F.col("weight"), F.lit(0)), F.lit(2**31 - 1))
    return pages.where(F.col("type") == kind).orderBy(weight, F.col("date").desc_nulls_last(), "title", "path").limit(most)


def needs_video(pages: DataFrame, menus: DataFrame) -> DataFrame:
    """(path, video): whether a page, or any entry of the site's menus, carries a mark of an embedded video.

    pages: path, content. menus: data_attr. The menus come down to one row before they meet pages.
    """
    marked = lambda c: F.exists(F.array(*[F.lit(m) for m in VIDEO_MARKS]), lambda m: F.contains(F.coalesce(c, F.lit("")), m))
    anywhere = menus.agg(F.coalesce(F.max(marked(F.col("data_attr"))), F.lit(False)).alias("menu"))
    return pages.crossJoin(F.broadcast(anywhere)).select("path", (marked(F.col("content")) | F.col("menu")).alias("video"))


def with_author(pages: DataFrame, authors: DataFrame) -> DataFrame:
    """The pages with name, role, image and description of their author (null without one, or where no role is stated).

    pages: author (key). authors: path (``author/<key>``), title, role, image, description.
    """
    known = authors.where("coalesce(trim(role), '') <> ''").select(F.regexp_replace("path", r"\Aauthor/", "").alias("author"), F.struct(F.col("title").alias("name"), "role", "image", "description").alias("by"))
    return pages.join(known.dropDuplicates(["author"]), "author", "left")


def folder_translations(folders: DataFrame, data: DataFrame) -> DataFrame:
    """(folder, urls): the map of a folder's data file, whose name has underscores for hyphens; an empty map without one."""
    held = data.select(F.col("key").alias("__key"), "urls")
    found = folders.select("folder", F.translate("folder", "-", "_").alias("__key")).join(held, "__key", "left")
    return found.select("folder", F.coalesce("urls", F.create_map().cast("map<string,string>")).alias("urls"))


def breadcrumbs(pages: DataFrame, home: str = "Home") -> DataFrame:
    """(url, crumbs): home, the ancestors of a page that exist, from the top, and the page. pages: url (slash at both ends), title.

    A page's ancestors are the prefixes of its address, so no walk from parent to parent is needed.
    """
    parts = F.filter(F.split("url", "/"), lambda p: p != "")
    upto = F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts), F.lit(1))), lambda k: F.concat(F.lit("/"), F.array_join(F.slice(parts, 1, k), "/"), F.lit("/")))
    steps = pages.where("url <> '/'").select("url", F.posexplode(upto).alias("depth", "at"))
    names = pages.select(F.col("url").alias("at"), F.col("title").alias("name"))
    found = steps.join(names, "at").groupBy("url").agg(F.sort_array(F.collect_list(F.struct("depth", "name", "at"))).alias("s"))
    first = F.struct(F.lit(home).alias("name"), F.lit("/").alias("url"))
    crumbs = F.concat(F.array(first), F.transform("s", lambda x: F.struct(x["name"].alias("name"), x["at"].alias("url"))))
    return found.select("url", crumbs.alias("crumbs")).unionByName(pages.where("url = '/'").select("url", F.array(first).alias("crumbs")))


def page_terms(pages: DataFrame, terms: DataFrame, taxonomy: str) -> DataFrame:
    """(path, term, title, url) of each term of a page, in the page's order. pages: path and an array column of the taxonomy's name."""
    rows = pages.select("path", F.posexplode(F.col(taxonomy)).alias("position", "name")).withColumn("term", F.lower(F.trim("name"))).where("term <> ''")
    rows = rows.groupBy("path", "term").agg(F.min("position").alias("position"))
    own = terms.where(F.col("taxonomy") == taxonomy).select("term", "title", "url")
    return rows.join(own, "term").select("path", "position", "term", "title", "url")


def language_name(code: Column, names: dict[str, str] | None = None, upper: bool = False) -> Column:
    """Name of a language; the code itself, or in upper case, where it has none."""
    names = LANGUAGES if names is None else names
    table = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    return F.coalesce(F.try_element_at(table, F.lower(code)), F.upper(code) if upper else code)


def asset_paths(wanted: DataFrame, files: DataFrame) -> DataFrame:
    """(path, found, actual): each wanted path below ``static``, else, without ``/images/``, below ``cdn-assets``. files: name."""
    names = files.select("name").distinct()
    rows = wanted.withColumns({"__a": F.concat(F.lit("static"), "path"), "__b": F.concat(F.lit("cdn-assets/"), F.regexp_replace("path", r"\A/images/", ""))})
    rows = rows.join(names.select(F.col("name").alias("__a"), F.lit(True).alias("__in_a")), "__a", "left").join(names.select(F.col("name").alias("__b"), F.lit(True).alias("__in_b")), "__b", "left")
    asked = F.coalesce("path", F.lit("")) != ""
    actual = F.when(asked & F.col("__in_a"), F.col("__a")).when(asked & F.col("__in_b"), F.col("__b")).otherwise("")
    return rows.select("path", (actual != "").alias("found"), actual.alias("actual"))


def menu_entries(pages: DataFrame, menus: DataFrame, menu: str) -> DataFrame:
    """(path, name, url, active) for each page and entry of one menu; active is the page's own entry.

    Pages meet the entries of that menu, as asked; Spark ships them only while they are small.
    """
    own = menus.where(F.col("menu") == menu).select(F.struct("weight", "name", "url").alias("e"))
    rows = pages.select("path").crossJoin(own)
    return rows.select("path", "e.name", "e.url", F.col("path").eqNullSafe(F.col("e.url")).alias("active"))


def page_faqs(pages: DataFrame, shown: DataFrame) -> DataFrame:
    """(path, faq): questions shown on a page, in order, or those of its front matter where none is shown; pages with none are left out.

    pages: path, faq (array). shown: path, position, question, answer.
    """
    item = F.struct("position", "question", "answer")
    gathered = shown.groupBy("path").agg(F.sort_array(F.collect_list(item)).alias("s")).select("path", F.transform("s", lambda x: F.struct(x["question"].alias("question"), x["answer"].alias("answer"))).alias("__shown"))
    return pages.join(gathered, "path", "left").select("path", F.coalesce("__shown", "faq").alias("faq")).where(F.size("faq") > 0)


def similarity_lines(members: DataFrame, counts: DataFrame, best: DataFrame, most: int = 10) -> DataFrame:
    """Lines (group_id, part, rank, line) of a report of similar pages: of each group its head, its members and its first pairs.

    members: group_id, id, section, url, title. counts: group_id, n_pairs, most (the largest
    similarity). best: group_id, a, b, sim, rank, the first ``most`` pairs. The rows sort into
    the report; a group without a pair has none.
    """
    members = members.join(counts.select("group_id"), "group_id", "left_semi")
    place = members.select(F.col("id").alias("a"), F.col("url").alias("a_url"))
    inside = best.join(place, "a").join(members.select(F.col("id").alias("b"), F.col("url").alias("b_url")), "b")
    percent = lambda c: F.format_string("%.1f%%", c * 100)
    shown = inside.select("group_id", F.lit(2).alias("part"), F.col("rank").cast("long").alias("rank"), F.concat(percent(F.col("sim")), F.lit(": "), "a_url", F.lit(" <-> "), "b_url").alias("line"))
    more = counts.where(F.col("n_pairs") > most).select("group_id", F.lit(3).alias("part"), F.lit(0).cast("long").alias("rank"), F.format_string("... and %d more pairs", F.col("n_pairs") - most).alias("line"))
    sizes = members.groupBy("group_id").agg(F.count("*").alias("n"), F.array_join(F.sort_array(F.collect_set(F.coalesce(F.nullif(F.col("section"), F.lit("")), F.lit("root")))), ", ").alias("sections"))
    head = sizes.join(counts, "group_id").select("group_id", F.lit(0).alias("part"), F.lit(0).cast("long").alias("rank"), F.concat(F.format_string("%d pages | ", "n"), percent(F.col("most")), F.lit(" max | Sections: "), "sections").alias("line"))
    listed = members.select("group_id", F.lit(1).alias("part"), F.col("id").alias("rank"), F.concat(F.lit("["), "section", F.lit("] "), "url", F.lit(" | "), "title").alias("line"))
    return head.unionByName(listed).unionByName(shown).unionByName(more)


def top_recommendations(links: DataFrame, most: int = 10) -> DataFrame:
    """The recommendations of highest lift, then anchor score, for a report."""
    return links.orderBy(F.col("lift").desc(), F.col("anchor_score").desc(), "source", "paragraph_index").limit(most)
