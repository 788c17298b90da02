"""Importance resampling of documents towards a target corpus, by hashed n-gram counts.

A feature is a run of one or two words. Its bucket is the CRC of its bytes, and
a bucket's gain is the logarithm of how much likelier it is in the target than
in the corpus. A document weighs the mean gain of its features; with Gumbel
noise from a hash of its id added, the highest scores are a sample without
replacement in proportion to the exponentials of the weights.

The CRC of a span is an exclusive or of one number for each byte, which hangs on
the byte and on its distance from the span's end, and of one number for the
length. Both come from tables, so all features of a batch take two lookups a
byte, one as part of the word and one as part of the pair, and one
``bitwise_xor.reduceat``. Spans longer than the tables go blockwise.

Two scans of the texts: one sums the buckets within each task before its
counts travel, one scores with the gains, of which there are as many as
buckets. Ranks come from one sort by range of short rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import cut, table

SPAN = 128  # bytes of a span that the tables cover
_SEPARATOR = 32

#: Bytes that part words become 0, A-Z become a-z; bytes of other code points stay.
_PLAIN = np.array([c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 0 for c in range(256)], np.uint8)


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """(by_place, by_length): the CRC's part of each byte at each distance from the end, flat, and the CRC of so many zero bytes."""
    step = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        step = np.where(step & 1, (step >> 1) ^ np.uint32(0xEDB88320), step >> 1)
    place = np.empty((SPAN + 4, 256), np.uint32)
    place[0] = step
    for d in range(1, SPAN + 4):
        place[d] = (place[d - 1] >> 8) ^ step[place[d - 1] & 255]
    length = np.empty(SPAN + 1, np.uint32)
    state = 0xFFFFFFFF
    for n in range(SPAN + 1):
        length[n] = state ^ 0xFFFFFFFF
        state = (state >> 8) ^ int(step[state & 255])
    return place.ravel(), length


def crc_of_long(data: np.ndarray) -> int:
    """CRC of a span of four bytes or more, block by block: the state so far joins the first four bytes of the next block."""
    place, _ = _tables()
    first = (len(data) - 4) % SPAN + 4
    state, at, size = 0xFFFFFFFF, 0, first
    while at < len(data):
        block = data[at : at + size].copy()
        block[:4] ^= np.frombuffer(int(state).to_bytes(4, "little"), np.uint8)
        state = int(np.bitwise_xor.reduce(place[np.arange(size - 1, -1, -1) * 256 + block]))
        at, size = at + size, SPAN
    return state ^ 0xFFFFFFFF


class Features:
    """CRCs of the features of a batch of texts: words, then pairs of words, each with the text it is of."""

    def __init__(self, texts: pa.Array):
        self.n = len(texts)
        of, data, starts, ends = self._words(texts)
        self.n_words = np.bincount(of, minlength=self.n)
        if not len(starts):
            self.crc, self.of = np.zeros(0, np.uint32), np.zeros(0, np.int64)
            return
        place, length = _tables()
        size = ends - starts
        reach = np.append(starts[1:], len(data)) - starts  # a word and its separator
        last = np.repeat(ends - 1, reach)
        at = np.arange(len(data), dtype=np.int64)
        # A separator lies one past its word's end, where the tables have nothing to say.
        far = last - at
        raw = place[np.clip(far, 0, SPAN - 1) * 256 + data]
        raw[far < 0] = 0
        single = np.bitwise_xor.reduceat(raw, starts)
        words = single ^ length[np.minimum(size, SPAN)]
        pair = np.flatnonzero(of[1:] == of[:-1])
        both = size[pair] + 1 + size[pair + 1]
        ahead = np.zeros(len(size), np.int64)
        ahead[:-1] = size[1:] + 1
        head = place[np.clip(far + np.repeat(ahead, reach), 0, SPAN - 1) * 256 + data]
        pairs = np.bitwise_xor.reduceat(head, starts)[pair] ^ single[pair + 1] ^ length[np.minimum(both, SPAN)]
        for k in np.flatnonzero(size > SPAN):
            words[k] = crc_of_long(data[starts[k] : ends[k]])
        for k in np.flatnonzero(both > SPAN):
            pairs[k] = crc_of_long(data[starts[pair[k]] : ends[pair[k] + 1]])
        self.crc = np.concatenate([words, pairs])
        self.of = np.concatenate([of, of[pair]])

    @staticmethod
    def _words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(text of each word, bytes with one separator after each word, starts, ends)."""
        parts = [b if b is not None else b"" for b in texts.cast(pa.binary()).to_pylist()]
        plain = _PLAIN[np.frombuffer(b"\0".join([*parts, b""]), np.uint8)]
        inside = plain != 0
        after = np.zeros(len(plain), bool)  # the first separator behind a word
        after[1:] = inside[:-1] & ~inside[1:]
        keep = inside | after
        doc_at = np.cumsum([0, *[len(b) + 1 for b in parts]])
        kept = plain[keep]
        ends = np.flatnonzero(kept == 0)
        starts = np.concatenate([[0], ends[:-1] + 1]) if len(ends) else ends
        of = np.searchsorted(doc_at, np.flatnonzero(after), "right") - 1
        # The separator that ends a text's last word may stand at the start of nothing: it is the joint behind the text.
        kept = kept.copy()
        kept[ends] = _SEPARATOR
        return of.astype(np.int64), kept, starts.astype(np.int64), ends.astype(np.int64)


def _slices(batch: pa.RecordBatch, column: int, most: int = 4 << 20) -> Iterator[tuple[int, pa.Array]]:
    """Runs of rows of about so many bytes; (first row, texts)."""
    sizes = np.array([len(x) if x is not None else 0 for x in batch.column(column).cast(pa.binary()).to_pylist()], np.int64)
    cuts = np.flatnonzero(np.diff(np.cumsum(sizes) // most)) + 1
    for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(sizes)], strict=True):
        if b > a:
            yield a, batch.column(column).slice(a, b - a)


def bucket_counts(docs: DataFrame, buckets: int, text_col: str = "text") -> DataFrame:
    """(bucket, n): features of all texts by bucket; a task sends one row a bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, texts in _slices(batch, 0):
                n += np.bincount(Features(texts).crc % np.uint32(buckets), minlength=buckets)
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(n[some])], ["bucket", "n"])

    counts = docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(run, "bucket int, n bigint")
    return counts.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(docs: DataFrame, target: DataFrame, buckets: int = 10_000, text_col: str = "text") -> np.ndarray:
    """Each bucket's gain in thousandths; the driver holds one number a bucket."""
    s, t = np.zeros(buckets), np.zeros(buckets)
    for out, df in ((s, docs), (t, target)):
        for r in bucket_counts(df, buckets, text_col).collect():
            out[r["bucket"]] = r["n"]
    return np.floor(1000 * np.log((t + 1) * (s.sum() + buckets) / ((s + 1) * (t.sum() + buckets)))).astype(np.int64)


def weighed(docs: DataFrame, gain: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, n_features, weight) of every row: the floored mean gain of its features, 0 without any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, features, weight = (np.zeros(batch.num_rows, np.int64) for _ in range(3))
            for a, texts in _slices(batch, 1):
                own = Features(texts)
                b = a + own.n
                words[a:b] = own.n_words
                features[a:b] = np.bincount(own.of, minlength=own.n)
                # Sums of whole numbers below 2 ** 53 are exact.
                total = np.bincount(own.of, gain[own.crc % np.uint32(len(gain))], own.n).astype(np.int64)
                weight[a:b] = np.where(features[a:b] > 0, total // np.maximum(features[a:b], 1), 0)
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, (words, features, weight))], ["id", "n_words", "n_features", "weight"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"id {kind}, n_words bigint, n_features bigint, weight bigint")


def gumbel(id_: Column, seed: int) -> Column:
    """Noise in thousandths from a hash of the seed and the id; a null id counts as an empty one."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def resample(docs: DataFrame, target: DataFrame, buckets: int = 10_000, percent: int = 25, least_words: int = 20, seed: int = 7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_features, weight, score, rank) of every row; rank counts what is drawn from 1, the best first, and is null for the rest.

    Of the rows with least_words words, percent in a hundred are drawn, rounded
    down: the highest scores, ties to the smaller id (null before any), then to
    fewer features. Nulls and empty texts have no features and weigh 0.
    Repeated rows are each of their own; where id and features are equal too,
    the order is that of the scored table, which is written before it is
    ranked. An empty table gives no rows, an empty target gains of the corpus
    against nothing.
    """
    gain = gains(docs, target, buckets, text_col)
    scored = cut(weighed(docs, gain, id_col, text_col).withColumn("score", F.col("weight") + gumbel(F.col("id"), seed)).withColumn("row", F.monotonically_increasing_id()))
    # A partition number and a place in it, which are frozen as they are written.
    order = [F.col("score").desc(), F.col("id").asc_nulls_first(), F.col("n_features"), F.col("row")]
    able = scored.where(F.col("n_words") >= least_words)
    placed = cut(able.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("place", F.monotonically_increasing_id()))
    part, at = F.shiftright("place", 33), F.col("place").bitwiseAND((1 << 33) - 1)
    parts = placed.groupBy(part.alias("part")).agg(F.count("*").alias("n"))
    # One row a partition of the sort, so one window over all of them is small.
    before = parts.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"), F.sum("n").over(Window.partitionBy()).alias("all"))
    rank = F.col("before") + at + 1
    ranked = placed.withColumn("part", part).join(F.broadcast(before), "part").withColumn("rank", F.when(rank <= F.floor(F.col("all") * percent / 100), rank))
    own = ["id", "n_features", "weight", "score"]
    return ranked.select(*own, "rank").unionByName(scored.where(F.col("n_words") < least_words).select(*own, F.lit(None).cast("bigint").alias("rank")))


def op13_importance_resampling(spark, sf_dir: str) -> DataFrame:
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).withColumnRenamed("id", "doc_id")
