"""Odd rows for every operator: nulls, empty and very long texts, ties, repeated rows, empty tables and clashing column names."""

import pytest
from pyspark.sql import functions as F

from disfluo.llm import decontam, langid, lm, mixing, neardup, pagetext, quality, suffixdup, toxicity, urls

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"word{i % 997}" for i in range(60_000))
ROWS = [
    (1, "The quick brown fox jumps over the lazy dog again and again.", "en", "a", 10), (2, None, "en", "a", None), (3, "", None, None, 0), (4, "   \n\t ", "de", "b", 5), (5, LONG, "en", "a", None),
    (6, "The quick brown fox jumps over the lazy dog again and again.", "en", None, 10), (7, "...!!! ### 123", "fr", "b", None), (7, "...!!! ### 123", "fr", "b", None), (None, "an id is missing here but the text is not", "en", "c", 3),
]
CLASHING = {"block": 1, "bucket": 2, "words": "x", "score": 0.5, "host": "h", "id": 9, "size": 3, "taken": 4, "kept": True, "item_id": 5, "lang_pred": "q"}


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(ROWS, DOCS)
    for name, value in CLASHING.items():
        df = df.withColumn(name, F.lit(value))
    return df


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (5, 0, 1), (6, None, None), (7, 1, 1), (None, 1, 1)], "doc_id long, quality int, toxic int")


def ids(df):
    return sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in df.select("doc_id").collect())


ALL = sorted((r[0] is None, r[0] or 0) for r in ROWS)
ONE_ROW_EACH = {
    "mix": lambda d, l: mixing.mix(d), "classes": lambda d, l: neardup.classes(d), "digests": lambda d, l: suffixdup.digests(d), "divergences": lambda d, l: quality.divergences(d), "lm": lambda d, l: lm.score(d),
    "langid": lambda d, l: langid.predict(d, langid.fit(d)), "toxicity": lambda d, l: toxicity.score(d, toxicity.train(d, l)),
}


@pytest.mark.parametrize("name", ONE_ROW_EACH)
def test_every_row_gets_its_row_and_empty_tables_give_none(docs, none, labels, name):
    assert ids(ONE_ROW_EACH[name](docs, labels)) == ALL
    assert ONE_ROW_EACH[name](none, labels).count() == 0


def rows_of(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_defined_results(docs, labels, spark):
    m = rows_of(mixing.mix(docs))
    assert m[2]["size"] == m[2]["taken"] == m[4]["size"] == 0 and m[5]["size"] == 60_000
    assert all(r["taken"] <= 3 * r["size"] for r in mixing.mix(docs).collect())
    c = rows_of(neardup.classes(docs))
    assert c[6]["class_id"] == 1 and [c[k]["class_id"] for k in (2, 3, 4, 7)] == [2, 3, 4, 7] and c[None]["class_id"] is None
    s = rows_of(suffixdup.digests(docs))
    assert (s[6]["n_removed"], s[6]["n_spans"]) == (60, 1) and s[1]["n_removed"] == 0 and s[2]["n_bytes"] == 0 and s[7]["n_removed"] == 0
    q = rows_of(quality.divergences(docs))
    assert q[2]["base_failed"] and q[2]["n_words"] == 0 and q[7]["n_symbols"] == 3 and q[4]["n_words"] == 0
    g = rows_of(langid.predict(docs, langid.fit(docs)))
    assert [g[k]["lang_pred"] for k in (2, 3, 4, 7)] == ["und"] * 4 and g[2]["score"] == 0 and g[1]["lang_pred"] == "en"
    assert rows_of(langid.predict(docs, langid.Model()))[1]["lang_pred"] == "und"
    t = rows_of(toxicity.score(docs, toxicity.NoisyOr()))
    assert all(r["score"] == 0 and r["predicted"] == 0 for r in t.values())
    p = rows_of(lm.score(docs))
    assert p[2]["n_tokens"] == 1 and p[5]["n_tokens"] == 60_001 and all(r["score"] <= 0 for r in p.values())


def test_overlaps_on_odd_rows(spark, docs, none):
    items = spark.createDataFrame([(1, "the quick brown fox jumps over the lazy dog"), (2, None), (3, "too short"), (4, "The QUICK brown fox, jumps over the lazy dog!"), (None, "jumps over the lazy dog again and again")], "item_id long, text string")
    got = sorted((r["doc_id"], r["item_id"] or 0) for r in decontam.overlaps(docs, items).collect())
    assert got == [(1, 0), (1, 1), (1, 4), (6, 0), (6, 1), (6, 4)]  # an item without an id is an item
    assert decontam.overlaps(none, items).count() == 0 and decontam.overlaps(docs, items.filter("false")).count() == 0
    assert sorted((r["doc_id"], r["item_id"] or 0) for r in decontam.overlaps(docs, items, decontam.Overlap(small_seeds=0)).collect()) == got


PAGES = "page_id long, url string, html string"
ODD_PAGES = [
    (1, None, None), (2, "no scheme", ""), (3, "http://A.Example.NET/en/1?x", "<p>one<p>two"), (4, "http://a.example.net/en/2", "<p>one<p>three"), (4, "http://a.example.net/en/2", "<p>one<p>three"), (None, "x://y", "<article>kept</article>"),
    (5, "http://b.net", "<div " * 3000), (6, "http://example.com/de/", "<b>&lt;&amp;&nbsp; &#233;</b"),
]


def test_pages(spark, labels):
    pages = spark.createDataFrame(ODD_PAGES, PAGES).withColumn("text", F.lit("x")).withColumn("host", F.lit("y")).withColumn("verdict", F.lit("z"))
    got = pagetext.extract(pages).collect()
    text = {r["page_id"]: r["text"] for r in got}
    assert len(got) == len(ODD_PAGES) and text[1] == text[2] == "" and text[None] == "kept" and text[6] == "<& é</b" and all(r["n_chars"] == len(r["text"]) for r in got)
    assert pagetext.extract(pages.filter("false")).count() == 0
    judged = {r["page_id"]: r for r in urls.judge(pages, spark.createDataFrame([], "host string, good int")).collect()}
    assert (judged[1]["host"], judged[1]["path"], judged[1]["rule"]) == ("", "", None) and judged[2]["host"] == ""
    assert (judged[3]["host"], judged[3]["path"], judged[3]["rule"], judged[3]["verdict"]) == ("a.example.net", "/en/1", "example.net/en/", "allow")
    assert (judged[5]["path"], judged[5]["rule"]) == ("", None) and judged[6]["verdict"] == "block"
    assert urls.judge(pages.filter("false"), urls.page_outcomes(pages, labels)).count() == 0


def test_page_outcomes_ignore_rows_without_number_or_label(spark, labels):
    pages = spark.createDataFrame([(1, "http://h/en/1", ""), (2, "http://h/en/x", ""), (3, "http://h/5.html", ""), (4, None, ""), (5, "http://h/99", ""), (6, "http://h/6/", "")], PAGES)
    assert sorted(map(tuple, urls.page_outcomes(pages, labels).collect())) == [("h", 0), ("h", 1)]


BIG = (1 << 53) + 1


def test_large_ids_beside_a_null_stay_whole(spark, labels):
    rows = [(BIG, "one two three four five six seven eight nine ten.", "en", "a", 1), (None, "one two three four five six seven eight nine eleven.", "en", "a", 1), (BIG + 2, "Other words in this text, as you can see.", "en", "b", 1)]
    docs = spark.createDataFrame(rows, DOCS).coalesce(1)
    for name, run in ONE_ROW_EACH.items():
        assert ids(run(docs, labels)) == [(False, BIG), (False, BIG + 2), (True, 0)], name
    assert ids(toxicity.drop_toxic_by(docs, toxicity.NoisyOr())) == [(False, BIG), (False, BIG + 2), (True, 0)]
    pages = spark.createDataFrame([(r[0], f"http://h/{k}", f"<p>{r[1]}") for k, r in enumerate(rows)], PAGES).coalesce(1)
    assert sorted((r["page_id"] or 0) for r in pagetext.extract(pages).collect()) == [0, BIG, BIG + 2]


def test_ids_that_differ_only_past_float_precision(spark):
    twice = spark.createDataFrame([(BIG, "a b c d e f g h", "en", "a", 1), (BIG - 1, "a b c d e f g h", "en", "a", 1), (None, "a b c d e f g h", "en", "a", 1)], DOCS).coalesce(1)
    assert {r["class_id"] for r in neardup.classes(twice).collect()} == {BIG - 1}


def test_very_long_pages_and_urls(spark, labels):
    story = "\n".join(f"<p>Paragraph {k} tells what happened on day {k}.</p>" for k in range(20_000))
    path = "/" + "part/" * 40_000 + "1"
    pages = spark.createDataFrame([(1, "http://h.net" + path, f"<nav>menu</nav><article>{story}</article>"), (2, "http://h.net/en/2", "<p>short"), (3, "http://h.net/en/3", "<" * 300_000 + "&" * 300_000)], PAGES)
    got = {r["page_id"]: r["text"] for r in pagetext.extract(pages).collect()}
    assert got[1].count("\n") == 19_999 and got[1].startswith("Paragraph 0 tells") and "menu" not in got[1] and len(got) == 3
    judged = {r["page_id"]: r for r in urls.judge(pages, urls.page_outcomes(pages, labels)).collect()}
    assert judged[1]["path"] == path and judged[1]["rule"] == "net/" and judged[1]["verdict"] == "block"


def test_clashing_helper_names(spark, labels):
    """Operators take tables that already have the columns that they add or use on the way."""
    names = {"n": 1, "order": "x", "row": 2, "slice": 3, "cum": 4, "offset": 5, "target": 6.0, "source_size": 7, "copies": 8, "k": "y", "words": "z", "item": 9, "seed": 10, "mask": 11, "content": "c", "bands": 12, "chars": 13, "u": 0.1, "toxic": 1, "lens": 14, "kind": 15}
    docs = spark.createDataFrame(ROWS, DOCS)
    for name, value in names.items():
        docs = docs.withColumn(name, F.lit(value))
    for name, run in ONE_ROW_EACH.items():
        assert ids(run(docs, labels)) == ALL, name
    items = spark.createDataFrame([(1, "the quick brown fox jumps over the lazy dog", "q")], "item_id long, text string, words string")
    assert sorted(r["doc_id"] for r in decontam.overlaps(docs, items).collect()) == [1, 6]
