"""Clashing column names, empty tables, ties and very long inputs of operators whose own tests have none."""

import time

import pytest
from pyspark.sql import functions as F

from leafspan.llm import decontam, html_wrapper, license_scan, quality_rules, url_filter


def same(got, want):
    key = lambda r: tuple(map(str, r))
    return sorted(map(key, got.collect())) == sorted(map(key, want.collect()))


def clashing(df, *names):
    """df with more columns of the names that operators use inside."""
    return df.select("*", *[F.lit(-1).alias(n) for n in names if n not in df.columns])


TEXTS = [(1, "one two three four five six seven eight nine ten eleven", "en"), (1, "one two three four five six seven eight nine ten eleven", "en"), (2, None, None), (3, "", "xx"), (None, "All rights reserved. " * 30, "en")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(TEXTS, "doc_id long, text string, lang string")


def test_decontamination(spark, docs):
    bench = spark.createDataFrame([(5, "two three four five six seven eight nine ten eleven"), (5, "all rights"), (None, "one two"), (6, None), (7, " ")], "item_id long, text string")
    plain = decontam.contamination(docs, bench)
    assert same(decontam.contamination(clashing(docs, "id", "place", "terms", "starts", "n_words", "items"), clashing(bench, "i", "t", "id")), plain)
    got = sorted((str(r["id"]), r["n_words"], r["n_hit"], r["items"], r["contaminated"]) for r in plain.collect())
    assert got == [("1", 11, 10, ["5"], True), ("1", 11, 10, ["5"], True), ("2", 0, 0, [], False), ("3", 0, 0, [], False), ("None", 90, 60, ["5"], True)]


def test_decontamination_of_a_very_long_text(spark):
    text = " ".join(f"w{k}" for k in range(400_000))
    bench = spark.createDataFrame([(1, " ".join(f"w{k}" for k in range(399_980, 399_995))), (2, "w0 w399999")], "item_id long, text string")
    (r,) = decontam.contamination(spark.createDataFrame([(1, text)], "doc_id long, text string"), bench).collect()
    assert (r["n_words"], r["n_hit"], r["items"]) == (400_000, 15, ["1"])


def test_license_scan(spark, docs):
    plain = license_scan.scan(docs)
    assert same(license_scan.scan(clashing(docs, "id", "n_words", "licenses", "matches")), plain)
    assert license_scan.scan(docs.limit(0)).collect() == []
    began = time.time()
    (r,) = license_scan.scan(spark.createDataFrame([(1, "word other " * 500_000 + "Licensed under the Apache License, Version 2.0.")], "doc_id long, text string")).collect()
    assert r["licenses"] == ["Apache-2.0"] and r["matches"][0]["first_word"] == 1_000_000 and time.time() - began < 60


def test_quality_rules(spark, docs):
    plain = quality_rules.quality_rules(docs)
    assert same(quality_rules.quality_rules(clashing(docs, "id", "words", "lines", "n_words", "kept", "char_distance", "_common", "_chars")), plain)
    assert quality_rules.quality_rules(docs.limit(0)).collect() == []
    (r,) = quality_rules.quality_rules(spark.createDataFrame([(1, "some of the words and more of it\n" * 20_000, "en")], "doc_id long, text string, lang string")).collect()
    assert (r["n_words"], r["n_dup_lines"], r["base_failed"], r["kept"]) == (160_000, 19_999, True, False)


def test_urls(spark):
    """Equal splits give the longer last word; a URL of a megabyte and one of nothing but its mark are judged like others."""
    counts = spark.createDataFrame([("ab", 4), ("c", 4), ("a", 4), ("bc", 4)], "word string, n long")
    assert url_filter.split_labels(spark.createDataFrame([("abc",)], "label string"), counts, 16.0).first()["words"] == ["a", "bc"]
    rows = [(1, "http://free-bets.test/" + "a" * 1_000_000), (2, "://"), (3, None), (4, "no mark"), (4, "no mark"), (None, "HTTP://ORG/es/x")]
    df = spark.createDataFrame(rows, "page_id long, url string")
    plain = url_filter.judge(df)
    got = {(r["id"], r["host"], len(r["path"]), r["rule"], r["verdict"]) for r in plain.collect()}
    assert got == {(1, "free-bets.test", 1_000_001, None, "block"), (2, "", 0, None, "allow"), (3, "", 0, None, "allow"), (4, "", 0, None, "allow"), (None, "org", 5, "org/es/", "block")}
    assert same(url_filter.judge(clashing(df, "id", "host", "path", "rule", "says", "words", "spam", "example", "token")), plain)
    assert url_filter.judge(df.limit(0)).collect() == []


def test_very_long_pages(spark):
    """Two pages of one host with 20,000 blocks each, of which the menu's are alike."""
    page = lambda k: "<body>" + "".join(f"<div><i>menu {n}</i></div>" for n in range(4000)) + "<section>" + "".join(f"<p>own {k} {n}</p><h3>part {k} {n}</h3>" for n in range(8000)) + "</section></body>"
    rows = [(k, "http://h.test/", page(k)) for k in range(2)] + [(9, None, None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    began = time.time()
    plain = html_wrapper.extract(df)
    got = {r["id"]: r["text"] for r in plain.collect()}
    assert time.time() - began < 120
    assert got == {k: " ".join(f"own {k} {n} part {k} {n}" for n in range(8000)) for k in range(2)} | {9: ""}
    assert same(html_wrapper.extract(clashing(df, "id", "host", "slots", "texts", "n")), plain)
