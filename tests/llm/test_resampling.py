"""Importance resampling: checksums, gains and draws against plain Python."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pyarrow as pa

from leafspan.llm import resampling

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def features(text):
    w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return [x.encode() for x in [*w, *map(" ".join, zip(w, w[1:]))]], len(w)


def drawn(docs, target, buckets, percent, least, seed):
    """The whole operator, row by row."""
    s, t = (Counter(zlib.crc32(f) % buckets for _, x in rows for f in features(x)[0]) for rows in (docs, target))
    big_s, big_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (big_s + buckets) / ((s[b] + 1) * (big_t + buckets))))
    out = []
    for k, x in docs:
        own, n = features(x)
        weight = sum(gain(zlib.crc32(f) % buckets) for f in own) // len(own) if own else 0
        h = int(hashlib.sha256(f"{seed}:{'' if k is None else k}".encode()).hexdigest()[:8], 16)
        out.append([k, len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), n])
    able = sorted((r for r in out if r[4] >= least), key=lambda r: (-r[3], r[0] is not None, r[0] or 0, r[1]))
    rank = {id(r): i + 1 for i, r in enumerate(able[: len(able) * percent // 100])}
    return sorted([(*map(str, r[:4]), str(rank.get(id(r)))) for r in out])


def texts(seed, n):
    r = random.Random(seed)
    letters = "abcXYZ09 ,.\n é中 \x00-_\U0001f600"
    return [None, "", "  ", "a", "A-b c", " x", "x ", "a" * 127, "a" * 128, "a" * 129, "b" * 300 + " " + "c" * 5, "d " + "e" * 5000 + " f",
            *("".join(r.choice(letters) for _ in range(r.randrange(90))) for _ in range(n)), "many words " * 4000]


def test_every_feature_has_the_checksum_of_its_bytes():
    all_ = texts(1, 400) + ["".join(random.Random(k).choice("abcé") for _ in range(120 + 7 * k)) + " tail" for k in range(40)]
    for at in range(0, len(all_), 7):
        part = all_[at : at + 7]
        got = resampling.Features(pa.array(part, pa.string()))
        for k, t in enumerate(part):
            want, n = features(t)
            assert sorted(got.crc[got.of == k].tolist()) == sorted(map(zlib.crc32, want)) and got.n_words[k] == n
    assert not len(resampling.Features(pa.array([], pa.string())).crc)


def test_draws_equal_those_of_plain_python(spark):
    docs = [*enumerate(texts(2, 300)), (None, "null ids too " * 9), (None, "null ids too " * 9), (5, "same id again " * 9), (5, "same id again " * 9)]
    target = list(enumerate(texts(3, 30)))
    schema = "doc_id long, text string"
    df = spark.createDataFrame(docs, schema).selectExpr("*", "1 AS id", "2 AS score", "3 AS n_words", "4 AS part").repartition(3)
    got = resampling.resample(df, spark.createDataFrame(target, schema), 50, 40, 3, 9)
    assert got.columns == ["id", "n_features", "weight", "score", "rank"]
    assert sorted(tuple(map(str, r)) for r in got.collect()) == drawn(docs, target, 50, 40, 3, 9)


def test_empty_tables(spark):
    some, none = spark.createDataFrame([(1, "a b c"), (2, None)], "doc_id long, text string"), spark.createDataFrame([], "doc_id long, text string")
    assert resampling.resample(none, some).collect() == []
    rows = sorted(resampling.resample(some, none, percent=100, least_words=0).collect())
    assert [tuple(map(str, r)) for r in rows] == [x for x in drawn([(1, "a b c"), (2, None)], [], 10_000, 100, 0, 7)]
