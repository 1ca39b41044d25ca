"""Names and links on company pages, alias tables, resolved gold, and what explanations say."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from jobloom.functions import sites
from jobloom.operators import extraction, matching


def values(spark, rule, *texts):
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string")
    return [r["out"] for r in df.select("k", rule(F.col("t")).alias("out")).orderBy("k").collect()]


def test_titles_name_a_company_by_their_framing(spark):
    titles = ["Jobs at Pinpoint | Pinpoint Careers", "Careers at  Blue River ", "Acme Careers", "ACME jobs", "Home", " ", None, "Careers at", "Jobs at X"]
    assert values(spark, sites.stated_name, *titles) == ["Pinpoint", "Blue River", "Acme", "ACME", None, None, None, None, None]
    pages = ["<html><TITLE lang='de'> A &amp; B\nCareers </TITLE><title>x</title>", "<title> </title>", "no title", None, "<title>x"]
    assert values(spark, sites.careers_site_name, *pages) == ["A & B\nCareers", None, None, None, None]


def test_links_name_tenants_of_one_host_only(spark):
    page = """<a href="https://Acme.hq.com/x"> <iframe SRC='http://blue-river.hq.com'> <a href="https://www.hq.com/"> <a href="https://acme.hq.com?y">
      <a href="https://x.nothq.com/"> <a href="https://x.hq.com.evil.test/"> <a href="https://a.b.hq.com/"> <a href="https://x.hqxcom/">"""
    assert values(spark, lambda c: sites.linked_subdomains(c, "hq.com"), page, "", None) == [["acme", "blue-river"], [], None]


def test_plain_rules(spark):
    assert values(spark, sites.document_text, "ﬁrst  line\x00x \n\n \t\r\nlast", "", None) == ["first line x\nlast", "", None]
    assert values(spark, sites.email_key, " A@B.de ", None) == ["a@b.de", None]


def test_alias_tables_are_checked(spark):
    concepts = spark.createDataFrame([("a",), ("b",)], "concept string")
    schema = "entry int, surface_form string, concepts array<string>"
    good = spark.createDataFrame([(1, "SQL", ["a"]), (2, "Go", ["a", "b"])], schema)
    assert sorted(tuple(r) for r in extraction.checked_aliases(concepts, good).collect()) == [("go", None, 1), ("sql", "a", 1)]
    bad = spark.createDataFrame([(1, "SQL", ["a", "a"]), (2, "sql.", ["c"]), (3, " - ", ["b"]), (4, None, []), (5, "x", None)], schema)
    assert sorted(tuple(r) for r in extraction.alias_problems(concepts.union(concepts.limit(1)), bad).collect()) == [
        ("concept_repeated", "a"), ("entry_repeats_concept", "1"), ("entry_without_concept", "4"), ("entry_without_concept", "5"), ("form_blank", "3"), ("form_blank", "4"),
        ("form_repeated", "sql"), ("unknown_concept", "c"),
    ]
    with pytest.raises(ValueError, match="form_repeated: sql"):
        extraction.checked_aliases(concepts, spark.createDataFrame([(1, "SQL", ["a"]), (2, "(sql)", ["b"])], schema))


def test_gold_resolves_by_any_label(spark):
    vocabulary = spark.createDataFrame([("sql", "a", 1), ("go", None, 1)], "form string, concept string, words int")
    gold = spark.createDataFrame([(1, ["x", "SQL"]), (2, ["go"]), (3, ["rust"]), (4, None), (5, [])], "mention int, labels array<string>")
    assert tuple(extraction.gold_resolution(gold, vocabulary).first()) == (5, 2, 0.4)
    assert tuple(extraction.gold_resolution(gold.limit(0), vocabulary).first()) == (0, 0, 0.0)


def test_explanations_are_summed_up(spark):
    top = spark.createDataFrame([(1, 2, 0.5), (0, 4, 0.0), (3, 3, 1.0)], "matched long, required long, score double")
    assert tuple(matching.explanation_summary(top).first()) == (2, 2.5, 1.0)
    assert tuple(matching.explanation_summary(top.limit(0)).first()) == (0, 0.0, 0.0)


def test_forms_keep_symbols_that_are_no_punctuation():
    assert [extraction.plain_form(x) for x in ("(C#)", "§5 Law", "data‐Base_x", "'.NET'", "...", " - ")] == ["c#", "§5 law", "data base x", "net", "", ""]


def test_a_page_title_keeps_references_that_markup_does_not_need(spark):
    pages = ["<TITLE x='1'> a &amp;&lt;b&gt; &quot;c&quot; &amp;amp </TITLE>", "<title> d&amp</title>", "<title> </title>", "none", None]
    assert values(spark, sites.markup_title, *pages) == ['a &<b> &quot;c&quot; &amp', "d&amp", None, None, None]
