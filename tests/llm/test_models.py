"""Classifier, URL filter, quality rules, license scan."""

import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from leafspan.llm import license_scan, quality_model, quality_rules, url_filter


def test_additive_model_learns_an_interaction():
    r = np.random.default_rng(0)
    x = r.random((4000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = quality_model.fit(x, y, n_pairs=2)
    assert (((model.score(x) > 0.5) == y).mean()) > 0.95
    assert (1, 0) in model.pairs


def test_classifier_on_held_out_rows(spark):
    rows = [(k, ("The plan of the house is in the garden. " * (3 + k % 5)) if k % 3 else "BUY!! NOW!! $$$ ### " * (3 + k % 4)) for k in range(300)]
    docs = spark.createDataFrame([*rows, (300, None), (301, ""), (None, "text")], "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k % 3 > 0)) for k in range(300)] + [(1, None), (None, 1)], "doc_id long, quality int")
    model = quality_model.train(docs, labels)
    got = quality_model.score(docs, model).collect()
    assert len(got) == 303 and all(0 <= r["quality_score"] <= 1 for r in got)
    assert all(r["predicted"] == int(r["doc_id"] % 3 > 0) for r in got if r["doc_id"] is not None and r["doc_id"] < 300)
    assert quality_model.score(docs.limit(0), quality_model.fit(np.zeros((0, 18)), np.zeros(0))).collect() == []


def test_host_words_are_split(spark):
    counts = spark.createDataFrame([("cheap", 50), ("pills", 40), ("he", 5)], "word string, n long")
    labels = spark.createDataFrame([("cheappills",), ("zzqqx",), ("xcheap",)], "label string")
    got = {r["label"]: r["words"] for r in url_filter.split_labels(labels, counts, 1000.0).collect()}
    assert got == {"cheappills": ["cheap", "pills"], "zzqqx": ["zzqqx"], "xcheap": ["x", "cheap"]}


def test_url_rules_and_verdicts(spark):
    urls = [
        "https://WWW.Example.com/en/5", "http://a.example.com/en/7x", "http://b.net/de/1", "http://example.net/de/8#x", "http://x.org/es/", "http://notorg/es/1",
        "http://cheappills.test/a", "http://fine.test/a", None, "no scheme", "http://h?q=/p", "http://cheappills.test/a",
    ]
    df = spark.createDataFrame([(k, u, "x") for k, u in enumerate([*urls, *(f"http://site{k}.test/a" for k in range(20))])], "page_id long, url string, host string")
    got = {r["id"]: r for r in url_filter.judge(df).collect()}
    assert [(got[k]["rule"], got[k]["verdict"]) for k in range(6)] == [
        ("com/en/", "block"), ("example.com/en/7", "allow"), ("net/de/", "allow"), ("example.net/de/8", "block"), ("org/es/", "block"), (None, "allow"),
    ]
    assert got[0]["host"] == "www.example.com" and got[0]["path"] == "/en/5" and got[3]["path"] == "/de/8"
    assert got[6]["verdict"] == got[11]["verdict"] == "block" and got[7]["verdict"] == "allow"
    assert (got[8]["host"], got[8]["path"], got[8]["verdict"]) == ("", "", "allow") and (got[10]["host"], got[10]["path"]) == ("h", "")
    assert url_filter.judge(df.limit(0)).collect() == []


def repeat_words(words):
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    counts, hit = Counter(grams), set()
    for i, g in enumerate(grams):
        if counts[g] > 1:
            hit |= {i, i + 1, i + 2}
    return len(hit)


@pytest.mark.parametrize("text", [None, "", " \n\t", "a b c", "a a a a a", "x y z x y z", "a b c\na b c\n\na b c d", "one\x0btwo\x0cthree # * $", "ä ö ü " * 40, "w " * 5000])
def test_base_counts(spark, text):
    df = spark.createDataFrame([(1, text, None, "z")], "doc_id long, text string, lang string, words string")
    (r,) = quality_rules.quality_rules(df).collect()
    words = [w for w in re.split("[\x20\x09-\x0d]+", text or "") if w]
    lines = [x for x in (text or "").split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    n = repeat_words(words)
    assert (r["n_words"], r["word_chars"], r["n_symbols"]) == (len(words), sum(map(len, words)), len(re.findall("[#*$%&|<>]", text or "")))
    assert (r["n_dup_lines"], r["n_repeat_words"]) == (len(lines) - len(set(lines)), n)
    assert r["base_failed"] == (len(words) < 50 or 100 * n > 50 * len(words))


def test_js_distance(spark):
    p, q = [0.5, 0.25, 0.25], [0.2, 0.3, 0.5]
    m = [(a + b) / 2 for a, b in zip(p, q)]
    wanted = math.sqrt(sum(a * math.log2(a / c) for a, c in zip(p, m)) / 2 + sum(b * math.log2(b / c) for b, c in zip(q, m)) / 2)
    df = spark.createDataFrame([(p,)], "p array<double>")
    assert abs(df.select(quality_rules.js_distance(F.col("p"), q)).first()[0] - wanted) < 1e-12


def test_symbols_are_far_from_a_language(spark):
    clean = "The house of the king is in the garden and it was built for a friend on the hill, that is known. " * 2
    clean += " ".join(f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60))
    loud = " ".join(f"W{chr(65 + i % 26)}{chr(65 + i // 26)}!!" for i in range(150))
    df = spark.createDataFrame([(1, clean, "en"), (2, loud, "en"), (3, loud, "xx"), (4, clean, None)], "doc_id long, text string, lang string")
    got = {r["id"]: r["kept"] for r in quality_rules.quality_rules(df).collect()}
    assert got == {1: True, 2: False, 3: False, 4: True}


def test_license_spans(spark):
    text = "some code here. Licensed under the Apache License, Version 2.0. more words follow\nReleased under the MIT licence!! Released under the MIT License."
    df = spark.createDataFrame([(1, text), (2, None), (3, ""), (4, "nothing licensed of the kind"), (5, "ALL RIGHTS RESERVED")], "doc_id long, text string")
    got = {r["id"]: r for r in license_scan.scan(df).collect()}
    assert got[1]["licenses"] == ["Apache-2.0", "MIT"] and got[5]["licenses"] == ["All-Rights-Reserved"]
    first = got[1]["matches"][0]
    assert (first["first_word"], first["end_word"], first["coverage"]) == (3, 11, 1.0)
    assert [got[k]["licenses"] for k in (2, 3, 4)] == [[], [], []]


def test_license_alignment_survives_edits(spark):
    name, template = license_scan.TEMPLATES[1]
    words = template.split()
    words[20:21] = ["REALLY", "new", "words"]
    del words[40]
    df = spark.createDataFrame([(1, "head " * 30 + " ".join(words) + " tail" * 30)], "doc_id long, text string")
    (r,) = license_scan.scan(df).collect()
    assert r["licenses"] == [name] and r["matches"][0]["coverage"] > 0.9 and r["matches"][0]["first_word"] == 30


def test_every_license_line_is_reported(spark):
    text = "All rights reserved. All rights reserved. Copyright 2019 A. All rights reserved. Released under the MIT License. x Released under the MIT License."
    df = spark.createDataFrame([(1, text), (2, "All rights reserved. " * 8000)], "doc_id long, text string")
    got = {r["id"]: [(m["name"], m["first_word"], m["end_word"]) for m in r["matches"]] for r in license_scan.scan(df).collect()}
    assert got[1] == [("All-Rights-Reserved", 0, 3), ("All-Rights-Reserved", 3, 6), ("All-Rights-Reserved", 9, 12), ("MIT", 12, 17), ("MIT", 18, 23)]
    assert got[2] == [("All-Rights-Reserved", 3 * k, 3 * k + 3) for k in range(8000)]


def longest_common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], last + 1 if x == y else max(row[j + 1], row[j])
    return row[-1]


def test_licenses_against_alignment_everywhere():
    """Templates with words changed, left out and put in, of any length: found where an exhaustive alignment finds them."""
    import random

    r = random.Random(2)
    index = license_scan.Index(license_scan.TEMPLATES, 5, 4)
    lost = tried = 0
    for _ in range(150):
        t = r.randrange(len(index.texts))
        own = index.texts[t].tolist()
        for _ in range(r.randrange(0, 1 + len(own) // 5)):
            k = r.randrange(len(own))
            own[k : k + 1] = r.choice([[], [-1], [-1, own[k]]])
        text = np.array([-1] * r.randrange(30) + own + [-1] * r.randrange(30), np.int64)
        full = longest_common(text.tolist(), index.texts[t].tolist()) / len(index.texts[t])
        got = license_scan.matches_in(index, text, 0.8, 8)
        if full >= 0.8 and len(own) <= len(index.texts[t]) + 8:
            tried += 1
            name = index.names[t]
            lost += not any(index.names[g[0]] == name or g[4] >= 0.8 * len(index.texts[t]) for g in got)
    assert tried > 60 and lost == 0


@pytest.mark.parametrize("seed", range(4))
def test_banded_alignment_is_the_longest(seed):
    r = np.random.default_rng(seed)
    text, template = r.integers(0, 4, 25), r.integers(0, 4, 12)
    pairs = license_scan.banded(text, template, -12, 40)
    assert all(text[i] == template[j] for i, j in pairs) and all(a < c and b < d for (a, b), (c, d) in zip(pairs, pairs[1:]))
    assert len(pairs) == longest_common(text.tolist(), template.tolist())


def test_url_words_of_any_length_and_given_labels(spark):
    long = "pneumonoultramicroscopicsilicovolcanoconiosis"
    counts = spark.createDataFrame([(long, 5), ("cure", 9)], "word string, n long")
    got = {r["label"]: r["words"] for r in url_filter.split_labels(spark.createDataFrame([(long + "cure",), ("x" * 5000,)], "label string"), counts, 100.0).collect()}
    assert got == {long + "cure": [long, "cure"], "x" * 5000: ["x" * 5000]}
    urls = [f"http://{kind}{k}.test/{path}/{k}" for k in range(30) for kind, path in (("good", "news"), ("bad", "win"))]
    df = spark.createDataFrame([(k, u) for k, u in enumerate(urls)], "page_id long, url string")
    known = spark.createDataFrame([(u, "bad" in u) for u in urls[:30]] + [("http://x.test/", None)], "url string, blocked boolean")
    got = {r["id"]: r["verdict"] for r in url_filter.judge(df, rules=(), labelled=known).collect()}
    assert got == {k: "block" if "bad" in u else "allow" for k, u in enumerate(urls)}


def test_hosts_without_examples_are_judged(spark):
    """Verdicts on hosts that no example came from, planted among ordinary ones."""
    urls = [f"http://{'casino' if k % 6 == 0 else 'garden'}{chr(97 + k % 26)}{chr(97 + k // 26)}.test/{'bonus' if k % 6 == 0 else 'plants'}/{k}" for k in range(240)]
    df = spark.createDataFrame([(k, u) for k, u in enumerate(urls)], "page_id long, url string")
    got = {(r["spam"], r["blocked"]): r["urls"] for r in url_filter.held_out(df).collect()}
    assert set(got) == {(True, True), (False, False)} and sum(got.values()) > 25


def judged_by_hand(urls, rules):
    """Host, path and the longest rule that fits, character by character."""
    out = []
    for u in urls:
        rest = u.split("://", 1)[1] if u and "://" in u else ""
        cut = min([rest.index(c) for c in "/?#" if c in rest] or [len(rest)])
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
        tail = rest[cut:]
        path = tail[: min([tail.index(c) for c in "?#" if c in tail] or [len(tail)])]
        fits = [r for r in rules if (host == r[0].split("/")[0] or host.endswith("." + r[0].split("/")[0])) and path.startswith("/" + r[0].split("/", 1)[1])]
        out.append((host, path, max(fits, key=lambda r: len(r[0]))[0] if fits else None))
    return out


def test_url_parts_and_rules_against_brute_force(spark):
    import random

    r = random.Random(6)
    urls = [None, "", "://", "x"] + [
        r.choice(["http://", "HTTPS://", "", "://"]) + r.choice(["", "a.", "B.İ."]) + r.choice(["example", "Example", "x"]) + r.choice([".com", ".net", ".org", ".COM:80", "com"])
        + r.choice(["", "/", "/en/", "/en/7", "/de/8x", "/es/" + "y" * 20_000]) + r.choice(["", "?a=/en/", "#/de/", "?x#y"])
        for _ in range(300)
    ]
    df = spark.createDataFrame([(k, u) for k, u in enumerate(urls)], "page_id long, url string")
    got = {x["id"]: (x["host"], x["path"], x["rule"]) for x in url_filter.judge(df).collect()}
    assert [got[k] for k in range(len(urls))] == judged_by_hand(urls, url_filter.RULES)


def test_the_sample_is_bounded_by_rows(spark, monkeypatch):
    """A thousand rows of one labelled id are one row of the sample, the same on every run; other columns and long texts don't matter."""
    docs = [(1, f"text number {k} of a hot id, {'word ' * (k % 50)}", "x") for k in range(1000)] + [(k, f"clean sentence number {k}. It has words.", "y") for k in range(2, 9)] + [(9, "long words " * 200_000, "z"), (None, "no id", None)]
    labels = [(k, k % 2, 0) for k in range(1, 10)] + [(None, 1, 0), (1, None, 0)]
    df = spark.createDataFrame(docs, "doc_id long, text string, id string").withColumnsRenamed({"id": "y"}).selectExpr("*", "1 AS h", "2 AS x")
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    seen = []
    monkeypatch.setattr(quality_model, "fit", lambda x, y: seen.append((x.tolist(), y.tolist())))
    for parts in (2, 5):
        quality_model.train(df.repartition(parts), known, max_train=4)
        quality_model.train(df.repartition(parts), known)
    import zlib

    taught = [k for k in range(1, 10) if zlib.crc32(str(k).encode()) % 5]
    assert [len(y) for _, y in seen] == [4, len(taught)] * 2 and seen[0] == seen[2] and seen[1] == seen[3]


def brute_split(label, counts, total):
    """The greatest likelihood of a split into known words and unknown stretches, over all of them."""
    from functools import lru_cache

    @lru_cache(None)
    def best(k, unknown):
        """From k on; unknown: the character before ends an unknown stretch, which the next one then carries on."""
        if k == len(label):
            return 0.0
        ways = [math.log(counts[label[k:j]] / total) + best(j, False) for j in range(k + 1, len(label) + 1) if label[k:j] in counts]
        ways.append((0.0 if unknown else math.log(10 / total)) - math.log(10) + best(k + 1, True))
        return max(ways)

    return best(0, False)


def likelihood(words, counts, total):
    """Of a split; what is no known word is an unknown stretch, unless unknown costs less."""
    return sum(max(math.log(counts[w] / total) if w in counts else -math.inf, math.log(10 / total) - len(w) * math.log(10)) for w in words)


def test_splits_against_all_splits(spark):
    import random

    r = random.Random(8)
    counts = {"".join(r.choice("abc") for _ in range(r.randrange(1, 6))): r.randrange(1, 400) for _ in range(25)}
    total = float(sum(counts.values()))
    labels = sorted({"".join(r.choice("abcx") for _ in range(r.randrange(1, 12))) for _ in range(80)})
    table = spark.createDataFrame(list(counts.items()), "word string, n long")
    got = {x["label"]: x["words"] for x in url_filter.split_labels(spark.createDataFrame([(x,) for x in labels], "label string"), table, total).collect()}
    for label in labels:
        assert "".join(got[label]) == label
        assert likelihood(got[label], counts, total) == pytest.approx(brute_split(label, counts, total)), label


def test_log_odds_against_plain_counts(spark):
    """Every token of every URL counted and weighed in plain Python."""
    pages = [(k, f"http://{h}.test/{p}") for k, (h, p) in enumerate([("casino-win", "a/1"), ("casino-win", "b/2"), ("free-bets", "a/3"), ("good-news", "b/4"), ("garden", "c"), ("garden", "c"), ("", "")] * 2)] + [(99, None)]
    known = [(u, "casino" in u) for _, u in pages[:6]]
    judged = url_filter.judge(spark.createDataFrame(pages, "page_id long, url string"), labelled=spark.createDataFrame(known, "url string, blocked boolean"), rules=(), alpha=0.5)
    got = {(x["host"], x["path"]): x["log_odds"] for x in judged.collect()}
    listed = {*url_filter.SPAM_WORDS, *url_filter.HOST_WORDS}

    def tokens(host, path):
        words = [w for w in re.split(r"[^a-z0-9]+", host) if w]
        return [f"h:{w}" for w in words] + ["s:listed" if w in listed else "s:other" for w in words] + ["s:hyphen"] * ("-" in host) + [f"p:{'#' if w.isdigit() else w}" for w in re.split(r"[^a-z0-9]+", path) if w]

    parts = [url_filter_parts(u) for _, u in pages]
    rows = Counter(parts)
    spam = {url_filter_parts(u): bad for u, bad in known}
    bad, good = Counter(), Counter()
    for at, is_bad in spam.items():
        for t in tokens(*at):
            (bad if is_bad else good)[t] += rows[at]
    n_bad, n_all = sum(rows[at] for at, b in spam.items() if b), sum(rows[at] for at in spam)
    v = len({*bad, *good}) + 1
    for at in rows:
        own = [t for t in tokens(*at)]
        if not own:
            assert got[at] is None
            continue
        odds = [math.log((bad[t] + 0.5) / (bad.total() + 0.5 * v)) - math.log((good[t] + 0.5) / (good.total() + 0.5 * v)) if t in bad or t in good else 0.0 for t in own]
        assert got[at] == pytest.approx(sum(odds) + math.log((n_bad + 0.5) / (n_all - n_bad + 0.5)), abs=1e-6), at


def url_filter_parts(url):
    found = re.match(r"http://([^/]*)(.*)", url or "")
    return (found[1], found[2]) if found else ("", "")


@pytest.mark.parametrize(("half", "least"), [(0, 0.7), (1, 0.2)])
def test_hosts_of_words_that_are_not_listed(spark, half, least):
    """Half of the spam words are taken off the list, and the hosts that have them, and a third of the others, out of the examples: what is blocked of hosts that nothing is known of.

    The tables have six spam hosts, so the second half leaves one host to learn
    from, and of five unseen spam hosts one is blocked: the floors are what is
    measured, not what would be wished for. No other host is blocked either way.
    """
    import zlib
    from pathlib import Path

    data = "/root/testdata/sf0.1/pages.parquet"
    if not Path(data).exists():
        pytest.skip("no test tables")
    pages = spark.read.parquet(data).select("page_id", "url")
    urls = [r["url"] for r in pages.distinct().collect() if r["url"]]
    host = lambda u: re.search(r"://([^/?#]*)", u)[1].lower()
    words = lambda u: set(re.split(r"[^a-z]+", host(u)))
    hidden = set(url_filter.SPAM_WORDS[half::2])
    shown = [w for w in url_filter.SPAM_WORDS if w not in hidden]
    unseen = {host(u) for u in urls if words(u) & hidden or zlib.crc32(host(u).encode()) % 3 == 0}
    known = [(u, bool(words(u) & set(shown))) for u in urls if host(u) not in unseen]
    judged = url_filter.judge(pages, rules=(), spam_words=tuple(shown), labelled=spark.createDataFrame(known, "url string, blocked boolean"))
    verdicts = {}
    for x in judged.collect():
        verdicts.setdefault(x["host"], []).append(x["verdict"] == "block")
    spam = {h for h in unseen if set(re.split(r"[^a-z]+", h)) & set(url_filter.SPAM_WORDS)}
    recall = sum(2 * sum(verdicts[h]) > len(verdicts[h]) for h in spam) / len(spam)
    false = sum(any(verdicts[h]) for h in unseen - spam)
    print(f"unseen hosts: {len(spam)} of spam, {recall:.2f} of them blocked; {len(unseen - spam)} others, {false} of them blocked")
    assert any(b for _, b in known) and len(spam) >= 3 and len(unseen - spam) > 10
    assert recall >= least and false == 0
