"""URL filters: rules first, then words of hosts and paths under naive Bayes.

Hosts run words together. A unigram model, counted over all the table's URLs
and the word list below, splits every distinct host label by Viterbi: labels
are exploded into substrings, substrings meet their counts in a join, and each
label's best split is a fold over its own (few) candidates. Multinomial naive
Bayes then scores the words of host and path, and what the host's name is made
of: listed words, others, hyphens. It learns from labelled URLs where
the caller has some, else from weak labels: a URL whose split host has a word
that only such hosts have is an example to block, any other an example to allow;
a fifth of the hosts never serve as examples, and held_out() reports on these.
Nothing is broadcast but what Spark finds small.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import cut

RULES = (("com/en/", "block"), ("example.com/en/7", "allow"), ("net/de/", "allow"), ("example.net/de/8", "block"), ("org/es/", "block"))

# Words that hosts of gambling, pills, pornography, counterfeits, loan sharks, advert and malware networks have, and hardly others do.
SPAM_WORDS = (
    "spam", "casino", "casinos", "poker", "bets", "betting", "slots", "jackpot", "lottery", "pills", "viagra", "cialis", "porn", "porno", "xxx",
    "sex", "sexy", "adult", "escort", "escorts", "replica", "replicas", "payday", "ads", "adserver", "popunder", "clickbait", "torrent", "warez", "keygen", "malware", "phishing",
)

# Words that host names are made of.
HOST_WORDS = (
    "the", "and", "for", "my", "your", "our", "best", "top", "free", "online", "news", "blog", "shop", "store", "web", "site", "net", "home",
    "world", "daily", "post", "times", "health", "care", "med", "tech", "data", "cloud", "soft", "ware", "book", "books", "music", "video",
    "game", "games", "sport", "sports", "travel", "food", "cook", "recipe", "car", "auto", "house", "garden", "art", "design", "photo",
    "school", "learn", "science", "history", "law", "bank", "money", "finance", "market", "trade", "job", "jobs", "work", "kids", "baby",
    "pet", "dog", "cat", "love", "date", "life", "style", "fashion", "beauty", "city", "live", "mail", "chat", "forum", "wiki", "info", "hub",
    "link", "page", "host", "buy", "farm", "cheap", "bet", "pill", "pharmacy", "loan", "loans", "crack", "track", "sale", "deal", "deals", "price", "discount", "offer", "win", "prize", "bonus", "click", "fast", "easy",
)

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def with_parts(pages: DataFrame, url_col: str = "url") -> DataFrame:
    """Adds host and path of the URL (both empty for a null, or without ``://``)."""
    rest = F.when(F.instr(url_col, "://") > 0, F.expr(f"substring(`{url_col}`, instr(`{url_col}`, '://') + 3)")).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return pages.withColumn("host", F.translate(host, UPPER, LOWER)).withColumn("path", path)


def _fits(rule: str) -> Column:
    host, _, path = rule.partition("/")
    fits = (F.col("host") == host) | F.col("host").endswith("." + host)
    return fits & F.col("path").startswith("/" + path)


def rule_of(rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits (of equal length the first), and what it says; nulls if none does."""
    rule = verdict = None
    for text, says in sorted(rules, key=lambda r: -len(r[0])):
        rule = F.when(_fits(text), text) if rule is None else rule.when(_fits(text), text)
        verdict = F.when(_fits(text), says) if verdict is None else verdict.when(_fits(text), says)
    return (rule, verdict) if rule is not None else (F.lit(None).cast("string"), F.lit(None).cast("string"))


def _tokens(text: Column) -> Column:
    return F.array_remove(F.split(F.translate(text, UPPER, LOWER), r"[^\p{L}\p{N}]+"), "")


def split_labels(labels: DataFrame, counts: DataFrame, total: float) -> DataFrame:
    """(label, words): the likeliest split of each label under the unigram counts.

    Substrings of every length that a word has are looked up, however long. An unknown stretch of n characters has the likelihood 10 / (total * 10**n),
    so that it is split only where known words make up for it. Of equally
    likely splits the one with the longer last words is taken.
    """
    lengths = counts.agg(F.sort_array(F.collect_set(F.length("word"))).alias("n")).first()["n"]  # lengths of words: a short list, however many words
    sizes = F.array(*[F.lit(n) for n in lengths]).cast("array<int>")
    at = labels.select("label", F.explode(sizes).alias("n")).where("n <= length(label)").select("label", "n", F.explode(F.expr("sequence(1, length(label) - n + 1)")).alias("a"))
    pieces = at.select("label", "a", (F.col("a") + F.col("n") - 1).alias("b"), F.expr("substring(label, a, n)").alias("word"))
    known = pieces.join(counts, "word")
    found = known.groupBy("label").agg(F.collect_list(F.struct("a", "b", F.log(F.col("n") / total).alias("p"))).alias("known"))
    base = math.log(10 / total)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for label, known_ in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ends: dict[int, list] = {}
                for k in known_ or []:
                    ends.setdefault(k["b"], []).append((k["a"], k["p"]))
                # Behind each character the best split that ends in a known word and the one that ends in an unknown stretch, which may grow: (likelihood, start of its last part, whether a known word ends there).
                best = [((0.0, 0, True), (-math.inf, 0, True))]
                for b in range(1, len(label) + 1):
                    (k, *_), (u, start, before) = best[b - 1]
                    stretch = max((u - math.log(10), start, before), (k + base - math.log(10), b - 1, True), key=lambda t: (t[0], -t[1]))
                    known_ends = [(best[a - 1][at][0] + p, a - 1, at == 0) for a, p in ends.get(b, []) for at in (0, 1)]
                    best.append((max(known_ends, key=lambda t: (t[0], -t[1]), default=(-math.inf, 0, True)), stretch))
                words, b, at = [], len(label), int(best[-1][1][0] > best[-1][0][0])
                while b > 0:
                    _, start, ended = best[b][at]
                    words.append(label[start:b])
                    b, at = start, int(not ended)
                out.append(words[::-1])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.string()))], ["label", "words"])

    return labels.join(found, "label", "left").select("label", "known").mapInArrow(run, "label string, words array<string>")


def judge(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES, spam_words=SPAM_WORDS, host_words=HOST_WORDS, alpha: float = 0.5, labelled: DataFrame | None = None) -> DataFrame:
    """Per row of pages: (id, host, path, rule, verdict, log_odds).

    labelled: URLs of pages that are known, as (url, blocked boolean); without it,
    weak labels serve. A URL labelled either way is blocked. verdict is the rule's; without one it is block where the log odds of naive
    Bayes (add-alpha) are over 0, else allow. log_odds is null for a URL without
    words, which is allowed; so are nulls and empty URLs. Repeated rows are judged
    alike, ties of rules go to the first of equal length, and an empty table
    gives an empty table.
    """
    return _judged(pages, id_col, url_col, rules, spam_words, host_words, alpha, labelled)[0]


def held_out(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", **options) -> DataFrame:
    """(spam, blocked, urls) over the URLs of hosts that no example came from: weak label, verdict of naive Bayes, number of distinct URLs."""
    options = {"rules": RULES, "spam_words": SPAM_WORDS, "host_words": HOST_WORDS, "alpha": 0.5, "labelled": None} | options
    _, scored = _judged(pages, id_col, url_col, *[options[k] for k in ("rules", "spam_words", "host_words", "alpha", "labelled")])
    return scored.where("NOT example").groupBy("spam", (F.col("log_odds") > 0).alias("blocked")).agg(F.count("*").alias("urls"))


def _judged(pages: DataFrame, id_col: str, url_col: str, rules, spam_words, host_words, alpha: float, labelled: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """What judge() returns, and (host, path, spam, example, log_odds) of every distinct URL."""
    rows = with_parts(pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url")), "url")
    rule, says = rule_of(rules)
    rows = rows.select("id", "host", "path", rule.alias("rule"), says.alias("says"))
    urls = cut(rows.groupBy("host", "path").agg(F.count("*").alias("rows")))  # one row each from here on
    hosts = urls.select("host").distinct()
    labels = hosts.select("host", F.posexplode(_tokens(F.col("host"))).alias("k", "label"))
    # Words that stand alone: in paths, and host labels in parts joined by hyphens or with listed words.
    listed = F.explode(F.array(*[F.lit(w) for w in sorted({*spam_words, *host_words})]))
    spark = pages.sparkSession
    seen = (
        urls.select(F.explode(_tokens(F.col("path"))).alias("word"))
        .unionByName(hosts.select(F.explode(F.filter(F.split("host", r"[.:]"), lambda x: x.contains("-"))).alias("x")).select(F.explode(_tokens(F.col("x"))).alias("word")))
        .where(F.col("word").rlike(r"^\p{L}+$") & (F.length("word") > 1))
        .groupBy("word")
        .agg(F.count("*").alias("n"))
    )
    fixed = spark.range(1).select(listed.alias("word"), F.lit(100).cast("bigint").alias("n"))
    counts = cut(seen.unionByName(fixed).groupBy("word").agg(F.sum("n").alias("n")))
    total = float(counts.agg(F.sum("n")).first()[0])
    splits = split_labels(labels.select("label").distinct(), counts, total)
    host_words_of = cut(
        labels.join(splits, "label").groupBy("host").agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("k", "words"))), lambda x: x["words"])).alias("words"))
    )
    spam = F.coalesce(F.arrays_overlap("words", F.array(*[F.lit(w) for w in spam_words])), F.lit(False))
    examples = urls.join(host_words_of, "host", "left")
    if labelled is None:
        examples = examples.withColumn("spam", spam).withColumn("example", F.crc32("host") % 5 != 0)
    else:
        known = with_parts(labelled.select(F.col("url").cast("string").alias("url"), F.col("blocked").alias("spam")).where("spam is not null"), "url").groupBy("host", "path").agg(F.bool_or("spam").alias("spam"))
        examples = examples.join(known, ["host", "path"], "left").withColumn("example", F.col("spam").isNotNull()).withColumn("spam", F.coalesce("spam", F.lit(False)))
    # Numbers in paths are pages, not words: they count as one. Beside the words stands what a name is made of, which names of other words share: listed words or none, and hyphens.
    words = F.coalesce("words", F.array().cast("array<string>"))
    common = F.array(*[F.lit(w) for w in sorted({*spam_words, *host_words})])
    tokens = F.concat(
        F.transform(words, lambda w: F.concat(F.lit("h:"), w)),
        F.transform(words, lambda w: F.when(F.array_contains(common, w), "s:listed").otherwise("s:other")),
        F.when(F.instr("host", "-") > 0, F.array(F.lit("s:hyphen"))).otherwise(F.array().cast("array<string>")),
        F.transform(_tokens(F.col("path")), lambda w: F.concat(F.lit("p:"), F.regexp_replace(w, r"^\p{N}+$", "#"))),
    )
    examples = examples.select("host", "path", "rows", "spam", "example", tokens.alias("tokens"))
    by_word = (
        examples.where("example").select("spam", "rows", F.explode("tokens").alias("token"))
        .groupBy("token")
        .agg(F.sum(F.when(F.col("spam"), F.col("rows")).otherwise(0)).alias("bad"), F.sum(F.when(~F.col("spam"), F.col("rows")).otherwise(0)).alias("good"))
    )
    by_word = cut(by_word)
    sums = by_word.agg(F.count("*").alias("v"), F.sum("bad").alias("bad"), F.sum("good").alias("good")).first()
    classes = examples.where("example").agg(F.sum(F.when(F.col("spam"), F.col("rows")).otherwise(0)).alias("bad"), F.sum("rows").alias("all")).first()
    bad, all_ = float(classes["bad"] or 0), float(classes["all"] or 0)
    prior = math.log((bad + alpha) / (all_ - bad + alpha))
    v = (sums["v"] or 0) + 1
    odds = F.log((F.col("bad") + alpha) / ((sums["bad"] or 0) + alpha * v)) - F.log((F.col("good") + alpha) / ((sums["good"] or 0) + alpha * v))
    scored = (
        examples.select("host", "path", F.explode("tokens").alias("token"))
        .join(by_word.select("token", odds.alias("odds")), "token", "left")
        .select("host", "path", F.coalesce("odds", F.lit(0.0)).alias("odds"))  # a word that no example has says nothing
        .groupBy("host", "path")
        .agg((F.sum("odds") + prior).alias("log_odds"))
    )
    judged = examples.select("host", "path", "spam", "example").join(scored, ["host", "path"], "left")
    verdict = F.coalesce("says", F.when(F.col("log_odds") > 0, "block").otherwise("allow"))
    return rows.join(scored, ["host", "path"], "left").select("id", "host", "path", "rule", verdict.alias("verdict"), F.round("log_odds", 9).alias("log_odds")), judged


def op2_url_filter(spark, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet")).withColumnRenamed("id", "page_id")
