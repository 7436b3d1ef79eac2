"""Scalar functions on small hand-made rows."""

import json
import re

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import html as H
from corpusloom.functions import slugs as S
from corpusloom.functions import text as X
from corpusloom.functions import urls as U
from corpusloom.functions import vectors as V


def values(spark, rows, column, schema="x string"):
    return [r[0] for r in spark.createDataFrame([(r,) for r in rows], schema).select(column(F.col("x"))).collect()]


def test_spaces_and_clipping(spark):
    assert values(spark, [" a \t b c ", None, ""], X.normalize_space) == ["a b c", "", ""]
    assert values(spark, ["one two three", "onetwothree", "one"], lambda c: X.clip(c, 6)) == ["one", "onetwo", "one"]
    assert values(spark, ["one two"], lambda c: X.clip(c, 0)) == ["one two"]


def test_tokens_and_sentences(spark):
    assert values(spark, ["Don't stop, 3 e-mails (now)! _x Élan"], X.tokens) == [["Don't", "stop", "e-mails", "now", "x", "Élan"]]
    assert values(spark, ["One. Two!  Three? four", None], X.sentences) == [["One.", "Two!", "Three?", "four"], [""]]
    assert values(spark, ["a  b\nc", "", None], X.word_count) == [3, 0, 0]


def test_ngrams(spark):
    assert values(spark, ["big red dogs, run"], X.keyword_ngrams) == [["big red", "red dogs", "dogs run", "big red dogs", "red dogs run", "big red dogs run"]]
    assert values(spark, ["a b", ""], X.keyword_ngrams) == [[], []]


def test_keyword_borders(spark):
    rows = ["a chat-bot", "the bot.", "robots", "BOT", "C++ code"]
    assert values(spark, rows, lambda c: X.mentions(c, F.lit("bot"))) == [False, True, False, True, False]
    assert values(spark, rows, lambda c: X.mentions(c, F.lit("c++"))) == [False, False, False, False, True]


def test_cleaning(spark):
    assert values(spark, [["The", "AI “Tools”", "12 3", "ai tools", "ok", "give"]], X.clean_keywords, "x array<string>") == [["ai tools"]]
    assert values(spark, ["<a href='x'>&</a>"], X.escape_html) == ["&lt;a href=&#39;x&#39;&gt;&amp;&lt;/a&gt;"]
    assert values(spark, ["```markdown\nx\n```", "y"], X.unwrap_fence) == ["x", "y"]
    assert values(spark, ["de", "us", None], X.consent_region) == ["eu", "row", None]
    assert values(spark, ["# A\ntext\n### B b \n#### c"], X.headers) == [["A", "B b"]]
    assert values(spark, ["x [a](/p/q) [b](http://z/) [c](r)"], X.link_targets) == [["/p/q/", "/r/"]]
    assert values(spark, ["## a\n### b\n## c"], X.heading_counts) == [{2: 2, 3: 1}]
    assert values(spark, ["{{< a >}}{{< /a >}}{{< a >}}"], X.shortcode_counts) == [{"a": 2}]


def test_addresses(spark):
    rows = ["https://h.com/a/b?q#f", "x/y", "", "https://h.com", None]
    assert values(spark, rows, U.canonical_path) == ["/a/b/", "/x/y/", "/", "/https://h.com/", "/"]
    assert values(spark, ["blog/_index.md", "indexing/a.md", "index.md", "p/index.md"], U.url_from_path) == ["/blog/", "/indexing/a/", "/", "/p/"]
    assert values(spark, ["indexing/a.md"], lambda c: U.url_from_path(c, anchored=False)) == ["/ing/a/"]
    assert values(spark, ["https://b.co/football/x", "/b.co/tennis/y", "/other", None], U.sitemap_section) == ["football", "tennis", "general", "general"]
    assert values(spark, ["a/b", "/", "http://x/y"], U.ensure_slashes) == ["/a/b/", "/", "http://x/y"]
    assert [tuple(v) for v in values(spark, ["/a/b/c/", "/c/", ""], U.split_slug)] == [("a/b", "c"), ("", "c"), ("", "")]
    assert values(spark, [200, 301, 404, -1], U.broken, "x int") == [False, False, True, True]
    assert values(spark, [-3, 310, 404], U.status_label, "x int") == ["Timeout", "Too Many Redirects", "404"]
    assert values(spark, ["mailto:a", "#x", "/ok", "/cdn/x"], lambda c: U.skipped(c, ["/cdn/"])) == [True, True, False, True]


def test_slugs(spark):
    assert [S.fold(*c) for c in [("Über Größe", "de"), ("Zgłoszeń", "pl"), ("αβγ", "el"), ("日本", "ja"), ("", "en"), (None, "en"), ("a" * 50 + " " + "b" * 50, "en")]] == ["ueber-groesse", "zgloszen", "", "", "", "", "a" * 50]
    pages = spark.createDataFrame([("en", "integrations/zoom-phone.md"), ("en", "acme-talk-alternative.md"), ("de", "integrations/xyz.md"), ("en", "integrations/_index.md")], "lang string, rel_path string")
    assert {r.word for r in S.brand_words(pages, ["integrations"], ["-alternative"], ["Own"]).collect()} == {"zoom", "acme", "talk", "own"}


def test_vectors(spark):
    rows = [[3.0, 4.0], [0.0, 0.0], [float("nan"), 1.0], None]
    assert values(spark, rows, V.finite, "x array<float>") == [True, True, False, False]
    assert values(spark, rows[:2], V.normalize, "x array<float>") == [[0.6, 0.8], [0.0, 0.0]]
    assert values(spark, rows[2:3], V.repaired, "x array<float>") == [[0.0, 0.0]]


def test_page_links():
    page = '<a href="/a#f">x<br><a href="mailto:q"><img src=b.png srcset="c.png 1x, d.png 2x"><meta property="og:image" content="/m.png"><meta name="x" content="/no"><p style="background:url(\'e.png\')"><a href="https://o.org/z"><base href="/b/">'
    assert H.page_links(page, "https://h.com/p/") == sorted(f"https://h.com{p}" for p in ["/a", "/p/b.png", "/p/c.png", "/p/d.png", "/m.png", "/p/e.png", "/b/"]) + ["https://o.org/z"]
    assert H.page_links(None, None) == []


def test_markdown(spark):
    body = "# Head\n\nSome *bold* [link](/x) text\nin two lines.\n\n- item one\n- item `code` two\n\n```\ncode\n```\n{{< box >}}\nhidden\n{{< /box >}}\n{{< open >}}\nshown\n"
    assert H.markdown_blocks(body) == [("h", "Head"), ("p", "Some bold link text in two lines."), ("li", "item one"), ("li", "item two"), ("p", "shown")]
    assert H.html_text("<p>a&amp;b</p><script>x</script>c") == "a&b c"


def test_body_problems(spark):
    english = '## A\n### B\n{{< t >}}{{< /t >}}\n{ "k": 1 }'
    cases = [(0, english, english), (1, '## A\n{{< t >}}\n{ "k": }', english), (2, "{{< x > %}", None), (3, "{{< /y >}}", None), (4, "{{< y >}}{{< /y >}}{{< /y >}}", None), (5, None, None), (6, '{ "k": }', "no parameters")]
    rows = spark.createDataFrame(cases, "id int, text string, reference string")
    got = {r.id: r.p for r in rows.select("id", H.check_body(F.col("text"), F.col("reference")).alias("p")).collect()}
    assert got[0] == got[5] == got[6] == []
    assert got[1][:2] == ["0 headings of level 3, the source has 1", "shortcode t closes 0 times, in the source 1"] and got[1][2].startswith("line 3: ")
    assert got[2] == ["malformed shortcode {{< x > %}"] and got[3] == ["shortcode y closes 1 times and opens 0"] and got[4] == ["shortcode y closes 2 times and opens 1"]
    cut = rows.where("reference IS NOT NULL").select("id", H.truncated(F.col("text"), F.col("reference")).alias("t"))
    assert {r.id: r.t for r in cut.collect()} == {0: False, 1: True, 6: False}


def test_json_blocks():
    assert H.json_blocks('x " {"a": {"b": "}"}} {no} \n{ "c": 1}') == [(1, '{"a": {"b": "}"}}'), (1, '{"b": "}"}'), (2, '{ "c": 1}')]
    assert H.json_blocks('{"open": ') == []


def test_date_patterns():
    from corpusloom.functions.values import date_pattern

    assert [date_pattern(x) for x in ("Jan 2, 2006", "2. January 2006", "02/01/06 15:04", "2006-01-02T15:04:05")] == ["MMM d, yyyy", "d. MMMM yyyy", "dd/MM/yy HH:mm", "yyyy-MM-dd'T'HH:mm:ss"]


def test_nested_values(spark):
    from corpusloom.functions import values as W

    rows = spark.createDataFrame([(1, '{"a": {"b": 2}, "l": [{"k": "x"}, 3, {"j": 1}]}'), (2, "[1]"), (3, "no json"), (4, None), (5, "{}")], "id int, j string")
    got = {r.id: (r.one, r.many) for r in rows.select("id", W.nested_get(F.col("j"), "a.b").alias("one"), W.nested_get(F.col("j"), "l[].k").alias("many")).collect()}
    assert got == {1: (["2"], ["x"]), 2: (None, None), 3: (None, None), 4: (None, None), 5: (None, None)}
    put = {r.id: r.p for r in rows.select("id", W.nested_set(F.col("j"), "l[].k", F.lit("new"), 0).alias("p")).collect()}
    assert put[1] == '{"a": {"b": 2}, "l": [{"k": "new"}, 3, {"j": 1}]}' and put[2] == "[1]" and put[3] == "no json"


@pytest.mark.parametrize("raw,meta,body", [("+++\ntitle = 'a'\n+++\nB", {"title": "a"}, "B"), ("﻿+++\nx = 1\n+++\n", {"x": 1}, ""), ("+++\nbad = = 1\n+++\nB", {}, "+++\nbad = = 1\n+++\nB"), ("plain", {}, "plain"), (None, {}, "")])
def test_front_matter(raw, meta, body):
    from corpusloom.sources.content import parse_front_matter

    assert parse_front_matter(raw) == (meta, body)


def test_front_matter_writing(spark):
    from corpusloom.sources.content import parse_front_matter, set_fields, toml_text

    data = {"title": 'q"x', "n": 3, "ok": True, "none": None, "tags": ["a"], "faq": [{"question": "q", "answer": "a"}], "t": {"u": {"v": 1}}}
    again, _ = parse_front_matter("+++\n" + toml_text(data) + "+++\n")
    assert again == {k: v for k, v in data.items() if v is not None}
    rows = spark.createDataFrame([("+++\ntitle = 'a'\n+++\nB\n", json.dumps({"url": "/x/"})), ("B", None)], "raw string, new string")
    first, second = [r[0] for r in rows.select(set_fields(F.col("raw"), F.col("new"))).collect()]
    assert parse_front_matter(first) == ({"title": "a", "url": "/x/"}, "B\n") and second == "B"


def sent_to_python(frame):
    """Bytes that a collected frame without shuffles sent to Python workers."""

    def add(plan):
        sent = plan.metrics().get("pythonDataSent")
        children = plan.children()
        return (sent.get().value() if sent.isDefined() else 0) + sum(add(children.apply(k)) for k in range(children.size()))

    return add(frame._jdf.queryExecution().executedPlan())


BOM = "﻿"
HEADS = [
    "", "+++", "+++\n", "+++\n+++", "+++\n+++\n", '+++\na = "1"\n+++\n', '+++ \t\r\na = "1"\r\n+++\r\n', '+++\na = "1"\n +++\n', '+++\na = "1"\n+++x\n+++\n', '+++\na = "+++"\n+++', '+++\na == 1\n+++\n', '+++\na = "1"\r+++\r',
    '+++\na = "1" +++\n+++\n', "---\na: 1\n---\n", "---\na: [\n---\n", "---\n- a\n---\n", BOM + '+++\na = "é😀"\n+++\n', BOM + BOM + '+++\na = 1\n+++\n', " +++\na = 1\n+++\n", '+++\na = "1"+++\nb', '+++a = "1"\n+++\n', "+++\na = 1\n\n+++   \n",
]


def test_front_matter_leaves_bodies_in_the_jvm(spark):
    """The blocks alone go to Python (F17: its memory grew with whole texts), and results are those of the whole texts."""
    import json

    from corpusloom.sources.content import front_matter, parse_front_matter

    raws = [h + end for h in HEADS for end in ("", "body\n+++\n", "é😀 body\r\n  long " * 2000)] + [None]
    rows = spark.createDataFrame(list(enumerate(raws)), "id int, raw string").coalesce(1)
    size = sum(len((r or "").encode()) for r in raws)
    for yaml_too, recover in ((False, False), (True, False), (True, True)):
        frame = rows.select("id", front_matter(rows["raw"], yaml_too, recover).alias("f"))
        got = {r.id: (json.loads(r.f.meta), r.f.body) for r in frame.collect()}
        assert got == {k: parse_front_matter(raw, yaml_too, recover) for k, raw in enumerate(raws)}
        assert 0 < sent_to_python(frame) < size / 20


def test_front_matter_problems_leave_texts_in_the_jvm(spark):
    """What stands between the marks alone goes to Python (F21: its memory grew with whole texts)."""
    from corpusloom.functions.values import front_matter_problem

    raws = [h + end for h in HEADS for end in ("", "body\n+++\n", "é😀 body\r\n  long " * 2000)] + [None]
    rows = spark.createDataFrame(list(enumerate(raws)), "id int, raw string").coalesce(1)
    size = sum(len((r or "").encode()) for r in raws)
    frame = rows.select("id", front_matter_problem(rows["raw"], True).alias("wrong"))
    got = {r.id: r.wrong for r in frame.collect()}
    for k, raw in enumerate(raws):
        parts = (raw or "").split("+++", 2)
        assert (got[k] == "no front matter between +++ marks") == (bool(parts[0]) or len(parts) < 3)
    # one block reaches from the first mark to one behind a long body
    assert 0 < sent_to_python(frame) < size / 5


def test_safe_names_take_signs_only_at_the_end(spark):
    texts = ["a b", "--", "x" * 99 + "--" * 80, "-" * 300 + "é/" + "-" * 5, "😀-- -" * 60, "", None, "a - - b\n\t--c"]
    want = [None if t is None else re.sub("-{2,}", "-", re.sub(r"[^A-Za-z0-9_-]", "_", t))[-100:] for t in texts]
    assert values(spark, texts, X.safe_filename) == want
    # the signs of a long text are replaced in its last characters alone
    assert "regexp_replace(right(" in spark.createDataFrame([("a",)], "t string").select(X.safe_filename(F.col("t"))).columns[0]


def test_bodies_are_dealt_as_facts(spark, tmp_path):
    """The query of body checks joins what was found in bodies, not bodies; a source whose first body is null has no reference."""
    from corpusloom.plans.site_queries import body_checks

    rows = [(1, "a", "x the y", "en"), (2, "a", "x", "en"), (3, "b", None, "en"), (4, "b", "{{< /q >}}{{< q >}}{{< /q >}} the z", "de"), (5, None, "x", "en"), (6, "a", '{"k": 1,} {{< q >}}', "fr")]
    spark.createDataFrame(rows, "doc_id long, source string, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    found = body_checks(spark, str(tmp_path))
    got = {r.doc_id: r.problems for r in found.collect()}
    none = "0 headings of level 2, the source has 1"
    assert {k: v for k, v in got.items() if k != 6} == {1: [], 2: [none], 3: [], 4: ["shortcode q closes 2 times and opens 1"]}
    assert got[6] == [none, "shortcode q opens 1 times, in the source 0"]
    assert "body" not in found._jdf.queryExecution().optimizedPlan().toString()
