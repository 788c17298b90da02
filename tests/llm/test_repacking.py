"""Certified packing into sequences."""

import itertools
import random
import zlib
from collections import defaultdict
from pathlib import Path

import numpy as np
import pytest

from leafspan.llm import repacking

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"
pytestmark = pytest.mark.skipif(not Path(VOCABULARY).exists(), reason="no tokenizer files")
TEXTS = ["", None, " ", "  two  blanks ", "plain words here", "Größe 中文 \U0001f600 <|endoftext|> x", "a\n\nb \n c\t", "\x00a \x00b", "word " * 3000, "word word " * 700 + "end", "I'll 12 34!! x", "plain words here"]


def fewest(lengths, capacity):
    """Sequences of the best packing, by trying every place for every piece."""

    def place(k, rooms):
        if k == len(lengths):
            return len(rooms)
        tried = {r: i for i, r in enumerate(rooms) if r >= lengths[k]}
        ways = [place(k + 1, [*rooms[:i], r - lengths[k], *rooms[i + 1 :]]) for r, i in tried.items()]
        return min([*ways, place(k + 1, [*rooms, capacity - lengths[k]])])

    return place(0, [])


def test_lower_bound_is_never_above_the_best_packing():
    r, met = random.Random(3), 0
    for _ in range(120):
        capacity = r.choice([6, 10, 13, 24])
        lengths = [r.randint(1, capacity) for _ in range(r.randrange(1, 8))]
        bound = repacking.lower_bound(np.bincount(lengths, minlength=capacity + 1), capacity)
        best = fewest(lengths, capacity)
        assert -(-sum(lengths) // capacity) <= bound <= best
        met += bound == best
    assert met > 100
    halves = np.bincount([6] * 9, minlength=11)
    assert repacking.lower_bound(halves, 10) == 9 and repacking.lower_bound(np.zeros(11, np.int64), 10) == 0
    assert repacking.lower_bound(np.bincount([4] * 9, minlength=11), 10) == 5  # u_2: three do not fit


def whole(rows, docs, capacity):
    """Every id of every document once, in pieces that fill their sequences without a gap."""
    words, of, seq = repacking.WordIds(VOCABULARY), defaultdict(list), defaultdict(list)
    for r in rows:
        of[r["id"]].append(r)
        seq[r["sequence_id"]].append(r)
    assert of.keys() == docs.keys()
    for k, t in docs.items():
        ids, at = [*words.tokenizer.encode(t or "", add_special_tokens=False).ids, 0], 0
        for i, r in enumerate(sorted(of[k], key=lambda r: r["piece"])):
            assert (r["piece"], r["start"]) == (i, at) and (r["length"] == capacity or i == 0)
            assert r["ids_crc32"] == zlib.crc32(np.array(ids[at : at + r["length"]], "<u4").tobytes())
            at += r["length"]
        assert at == len(ids)
    for own in seq.values():
        own = sorted(own, key=lambda r: r["offset"])
        assert [r["offset"] for r in own] == [0, *itertools.accumulate(r["length"] for r in own)][:-1]
        assert sum(r["length"] for r in own) <= capacity
    return len(seq)


@pytest.mark.parametrize(("capacity", "block"), [(16, 5), (16, 1_000_000), (2048, 1_000_000)])
def test_nothing_is_lost(spark, capacity, block):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").withColumnRenamed("text", "body")
    packed = repacking.repack(df.selectExpr("doc_id", "body AS text", "'x' AS id", "1 AS open", "2 AS length").repartition(3), VOCABULARY, capacity, block_pieces=block)
    n = whole(packed.collect(), dict(enumerate(TEXTS)), capacity)
    said = repacking.certificate(packed, capacity)
    assert said["sequences"] == n >= said["lower_bound"] and said["tokens"] == sum(r["length"] for r in packed.collect())


def test_gaps_are_closed_by_exchange(spark):
    """Texts of 11 ids in one partition and of 5 in another: each alone meets its bound, together they fill each other's room."""
    long, short = [(k, " ".join(["a"] * 10)) for k in range(24)], [(100 + k, " ".join(["b"] * 4)) for k in range(24)]
    apart = spark.sparkContext.parallelize([long, short], 2).flatMap(lambda x: x)
    packed = repacking.repack(spark.createDataFrame(apart, "doc_id long, text string"), VOCABULARY, 16)
    assert repacking.certificate(packed, 16) == {"sequences": 24, "lower_bound": 24, "tokens": 384, "pieces": 48}
    whole(packed.collect(), dict(long + short), 16)


def test_rounding_of_many_partitions_goes(spark):
    df = spark.range(64).selectExpr("id AS doc_id", "repeat('a ', cast(id % 7 as int)) || 'a' AS text").repartition(16)
    packed = repacking.repack(df, VOCABULARY, 64)
    said = repacking.certificate(packed, 64)
    assert said["sequences"] == said["lower_bound"] < 16
    whole(packed.collect(), {r["doc_id"]: r["text"] for r in df.collect()}, 64)


def test_repeats_nulls_and_no_rows(spark):
    df = spark.createDataFrame([(None, "x y"), (None, "x y"), (None, None), (3, "x"), (3, "x")], "doc_id string, text string")
    rows = repacking.repack(df, VOCABULARY, 8).collect()
    assert len(rows) == 5 and sum(r["length"] for r in rows) == 3 + 3 + 1 + 2 + 2
    assert repacking.repack(df.limit(0), VOCABULARY).collect() == []


def test_words_by_rank_and_whole_texts_agree():
    words = repacking.WordIds(VOCABULARY)
    assert words.word != words._whole
    for t in TEXTS:
        ids = words.tokenizer.encode(t or "", add_special_tokens=False).ids
        assert np.array(ids, "<u4").tobytes() == words.of(t)
    words.keep = 2
    assert words.of("one two three four") == np.array(words._whole("one two three four"), "<u4").tobytes()
