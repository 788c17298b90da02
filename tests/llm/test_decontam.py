import random
import re

import pytest

from leafspan.llm import decontam


def words(text):
    low = (text or "").translate({i: i + 32 for i in range(65, 91)})
    return [w for w in re.split("[\x00-\x2f\x3a-\x60\x7b-\x7f]+", low) if w]


def brute(docs, items, size):
    windows = {}
    for i, t in items:
        w = words(t)
        if i is not None:
            for k in range(max(1, len(w) - size + 1) if w else 0):
                windows.setdefault(tuple(w[k : k + size]), set()).add(str(i))
    out = []
    for i, t in docs:
        w, hit, found = words(t), set(), set()
        for own, ids in windows.items():
            for k in range(len(w) - len(own) + 1):
                if tuple(w[k : k + len(own)]) == own:
                    hit |= set(range(k, k + len(own)))
                    found |= ids
        out.append((i if i is not None else -1, len(w), len(hit), tuple(sorted(found)), bool(hit)))
    return sorted(out)


@pytest.mark.parametrize("block_words", [500_000, 30])
def test_against_brute_force(spark, block_words):
    r = random.Random(3)
    vocabulary = ["the", "of", "Größe", "a1", *[f"v{i}" for i in range(12)]]
    items = [(k, " ".join(r.choice(vocabulary) for _ in range(r.choice([2, 5, 9, 14])))) for k in range(12)]
    items += [(12, ""), (13, None), (14, items[0][1]), (0, items[0][1]), (None, "v1 v2")]
    docs = []
    for k in range(60):
        w = [r.choice(vocabulary) for _ in range(r.choice([0, 3, 40, 200]))]
        if k % 3 == 0:
            w[len(w) // 2 : len(w) // 2] = r.choice(items)[1].upper().split() if r.random() < 0.5 else ["the", "of"]  if items[k % 12][1] is None else items[k % 12][1].split()
        docs.append((k, ", ".join(w)))
    docs += [(60, None), (61, "---"), (61, "---"), (None, items[1][1])]
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumnRenamed("doc_id", "doc_id")
    b = spark.createDataFrame(items, "item_id long, text string")
    got = decontam.contamination(d, b, 5, block_words=block_words).collect()
    mine = sorted((x["id"] if x["id"] is not None else -1, x["n_words"], x["n_hit"], tuple(x["items"]), x["contaminated"]) for x in got)
    assert mine == brute(docs, items, 5)


def test_empty_tables(spark):
    d, b = spark.createDataFrame([(1, "a b")], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    assert [tuple(r) for r in decontam.contamination(d, b).collect()] == [(1, 2, 0, 0, [], False)]
    assert decontam.contamination(d.limit(0), spark.createDataFrame([(1, "a")], "item_id long, text string")).collect() == []


def test_proximity(spark):
    d = spark.createDataFrame([(1, "gamma x alpha y beta"), (2, "alpha " + "x " * 50 + "beta gamma"), (3, "alpha beta gamma")], "doc_id long, text string")
    b = spark.createDataFrame([(9, "alpha beta gamma")], "item_id long, text string")
    got = {r["id"]: (r["items"], r["near_items"]) for r in decontam.matches(d, b, 3, slop=4).collect()}
    assert got == {1: ([], ["9"]), 2: ([], []), 3: (["9"], ["9"])}
