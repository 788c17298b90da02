"""Benchmark decontamination with a positional inverted index of the training texts.

The index is cut into segments, each over a run of documents: for every term
that a benchmark item has, the positions where it stands. Segments are written
to the shared checkpoint folder; a search reads them and not the texts. A
window of item words is looked up from its rarest term (by its count over all
documents): the term's positions, less its offset in the window, are the
candidates, and the lists of the other terms, adjusted by their offsets, are
intersected with them, the rarer first.

A benchmark is searched in blocks of items, so what is sent to every task is
bounded by ``block_words`` however long the benchmark is.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .common import cut

#: Bytes that part words become blanks, A-Z become a-z; bytes of other code points stay.
_PLAIN = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)
_GAP = 1_000_000  # positions between documents of a segment: no window or span reaches across


def words(text: bytes | None) -> list[bytes]:
    return text.translate(_PLAIN).split() if text else []


def _pack(x: np.ndarray) -> bytes:
    return zstandard.compress(np.ascontiguousarray(x).tobytes(), 1)


def _unpack(x: bytes, kind) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(x), kind)


SEGMENT = "place string, ids binary, starts binary, n_words binary, terms binary, counts binary, positions binary"


def build_index(docs: DataFrame, terms: list[bytes], id_col: str = "doc_id", text_col: str = "text", segment_words: int = 2_000_000) -> DataFrame:
    """Segments of the positional index of docs, for the given terms.

    place is the partition and the segment's number in it; ids is an Arrow stream of the documents' ids, in order, with their kind and
    nulls; starts and n_words are each document's first position and number of
    words; terms, counts and positions are the posting lists, one after another.
    """
    vocabulary = {t: i for i, t in enumerate(terms)}

    def segment(place: str, ids: list, kind: pa.DataType, lengths: list[int], parts: list[np.ndarray]) -> pa.RecordBatch:
        n = np.array(lengths, np.int64)
        starts = np.cumsum(n + _GAP) - n - _GAP
        term = np.concatenate(parts) if parts else np.zeros(0, np.int32)
        at = np.arange(len(term)) + np.repeat(starts - (np.cumsum(n) - n), n)
        known = term >= 0
        term, at = term[known], at[known]
        order = np.argsort(term, kind="stable")
        have, count = np.unique(term, return_counts=True)
        deltas = np.diff(at[order], prepend=0)
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, pa.schema([("id", kind)])) as out:
            out.write_batch(pa.RecordBatch.from_arrays([pa.array(ids, kind)], ["id"]))
        row = [place, zstandard.compress(sink.getvalue().to_pybytes(), 1), _pack(starts), _pack(n), _pack(have.astype(np.int32)), _pack(count.astype(np.int64)), _pack(deltas)]
        names = ["place", "ids", "starts", "n_words", "terms", "counts", "positions"]
        return pa.RecordBatch.from_arrays([pa.array([x], pa.string() if i == 0 else pa.binary()) for i, x in enumerate(row)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, lengths, parts, kind, held = [], [], [], pa.int64(), 0
        partition, made = TaskContext.get().partitionId(), 0
        for batch in batches:
            kind = batch.column(0).type
            for i, t in zip(batch.column(0), batch.column(1).cast(pa.binary()), strict=True):
                w = words(t.as_py())
                ids.append(i.as_py())
                lengths.append(len(w))
                parts.append(np.fromiter((vocabulary.get(x, -1) for x in w), np.int32, len(w)))
                held += len(w)
                if held >= segment_words or len(ids) >= 100_000:
                    yield segment(f"{partition}-{made}", ids, kind, lengths, parts)
                    ids, lengths, parts, held, made = [], [], [], 0, made + 1
        if ids:
            yield segment(f"{partition}-{made}", ids, kind, lengths, parts)

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, SEGMENT)


def term_counts(index: DataFrame) -> DataFrame:
    """(term INT, n): occurrences of each term over all segments."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for batch in batches:
            for t, n in zip(batch.column(0), batch.column(1), strict=True):
                total.update(dict(zip(_unpack(t.as_py(), np.int32).tolist(), _unpack(n.as_py(), np.int64).tolist(), strict=True)))
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array(list(total.values()), pa.int64())], ["term", "n"])

    return index.select("terms", "counts").mapInArrow(run, "term int, n bigint").groupBy("term").agg(F.sum("n").alias("n"))


class _Segment:
    """A segment as read: posting lists by term, and documents by position."""

    def __init__(self, ids: bytes, starts: bytes, n_words: bytes, terms: bytes, counts: bytes, positions: bytes):
        self.ids = pa.ipc.open_stream(zstandard.decompress(ids)).read_all().column(0).combine_chunks()
        self.starts, self.n_words = _unpack(starts, np.int64), _unpack(n_words, np.int64)
        self.terms, counts = _unpack(terms, np.int32), _unpack(counts, np.int64)
        self.positions = np.cumsum(_unpack(positions, np.int64))
        self.ends = np.cumsum(counts)
        self.begins = self.ends - counts

    def postings(self, term: int) -> np.ndarray:
        at = int(np.searchsorted(self.terms, term))
        if at == len(self.terms) or self.terms[at] != term:
            return np.zeros(0, np.int64)
        return self.positions[self.begins[at] : self.ends[at]]

    def document(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.starts, at, "right") - 1


def _within(sorted_: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Whether each wanted position is in a sorted list."""
    if not len(sorted_):
        return np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(sorted_, wanted), len(sorted_) - 1)
    return sorted_[at] == wanted


def phrase_hits(segment: _Segment, windows: list[tuple[int, ...]], rank: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(window number, positions where it starts) of the windows that occur in a segment."""
    for number, window in enumerate(windows):
        order = sorted(range(len(window)), key=lambda o: (rank[window[o]], o))
        found = segment.postings(window[order[0]]) - order[0]
        for o in order[1:]:
            if not len(found):
                break
            found = found[_within(segment.postings(window[o]), found + o)]
        if len(found):
            yield number, found


def near_hits(segment: _Segment, window: tuple[int, ...], rank: np.ndarray, span: int) -> np.ndarray:
    """Positions of the rarest term with every other term of the window at most span words away."""
    terms = sorted(set(window), key=lambda t: (rank[t], t))
    found = segment.postings(terms[0])
    for t in terms[1:]:
        if not len(found):
            break
        own = segment.postings(t)
        found = found[np.searchsorted(own, found + span, "right") > np.searchsorted(own, found - span, "left")]
    return found


class Queries:
    """Windows of benchmark items, as term numbers, with the items that have them."""

    def __init__(self, items: list[tuple[object, bytes | None]], size: int):
        texts = [(i, words(t)) for i, t in items]
        self.terms = sorted({x for _, w in texts for x in w})
        number = {t: k for k, t in enumerate(self.terms)}
        owners: dict[tuple[int, ...], set] = {}
        for i, w in texts:
            ids = [number[x] for x in w]
            for at in range(max(1, len(ids) - size + 1) if ids else 0):
                owners.setdefault(tuple(ids[at : at + size]), set()).add(i)
        self.windows = list(owners)
        self.owners = [sorted(owners[w], key=str) for w in self.windows]


def blocks(benchmark: DataFrame, item_col: str, text_col: str, block_words: int) -> Iterator[list]:
    """Items in runs of about block_words words at most (one item at least); rows without an id are no items."""
    rows = benchmark.select(F.col(item_col).alias("i"), F.col(text_col).cast("binary").alias("t")).where(F.col("i").isNotNull())
    held, size = [], 0
    for row in rows.toLocalIterator():  # a partition at a time
        t = bytes(row["t"]) if row["t"] is not None else None
        n = len(words(t))
        if held and size + n > block_words:
            yield held
            held, size = [], 0
        held.append((row["i"], t))
        size += n
    yield held


def matches(docs: DataFrame, benchmark: DataFrame, window: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", slop: int | None = None, block_words: int = 500_000) -> DataFrame:
    """One row per row of docs: (id, n_words, starts, lengths, items).

    starts and lengths are the exact occurrences (word offset and words) of any
    window; items holds, as sorted text, the ids of the items with one. With
    slop, near_items has the items of which all terms of a window stand within
    len(window) + slop words of its rarest term, in any order.

    A benchmark of more than block_words words is searched in several blocks.
    The texts are then written out first, so that each block's index has the
    same rows in the same places, and the blocks' finds meet by place.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    dealt = lambda: blocks(benchmark, item_col, item_text, block_words)
    found = dealt()
    first, second = next(found), next(found, None)
    hidden = ["place"] if slop is not None else ["place", "near_items"]
    if second is None:
        return _block(docs, first, window, id_col, text_col, kind, slop).drop(*hidden)
    held = cut(docs.select(id_col, text_col))
    return _meet([_block(held, items, window, id_col, text_col, kind, slop) for items in dealt()]).drop(*hidden)


def _meet(parts: list[DataFrame]) -> DataFrame:
    """Puts the finds of all blocks of one row together; only rows with finds are moved for it."""
    everything = parts[0]
    for part in parts[1:]:
        everything = everything.unionByName(part.where((F.size("starts") > 0) | (F.size("near_items") > 0)))
    flat = {c: F.flatten(F.collect_list(c)) for c in ("starts", "lengths", "items", "near_items")}
    return everything.groupBy("place").agg(
        F.min("id").alias("id"), F.max("n_words").alias("n_words"), flat["starts"].alias("starts"), flat["lengths"].alias("lengths"),
        *[F.array_sort(F.array_distinct(flat[c])).alias(c) for c in ("items", "near_items")],
    )


def _block(docs: DataFrame, items: list, window: int, id_col: str, text_col: str, kind: str, slop: int | None) -> DataFrame:
    q = Queries(items, window)
    index = cut(build_index(docs, q.terms, id_col, text_col))
    rank = np.zeros(len(q.terms), np.int64)  # one number a term of this block: bounded by block_words
    for row in term_counts(index).toLocalIterator():
        rank[row["term"]] = row["n"]
    windows, owners = q.windows, [[str(o) for o in own] for own in q.owners]

    def search(s: _Segment, place: str, kind: pa.DataType) -> pa.RecordBatch:
        n = len(s.starts)
        at, long, found_items, near = [[] for _ in range(n)], [[] for _ in range(n)], [set() for _ in range(n)], [set() for _ in range(n)]
        for number, found in phrase_hits(s, windows, rank):
            own = s.document(found)
            for d, p in zip(own.tolist(), (found - s.starts[own]).tolist(), strict=True):
                at[d].append(p)
                long[d].append(len(windows[number]))
                found_items[d].update(owners[number])
        if slop is not None:
            for number, w in enumerate(windows):
                for d in s.document(near_hits(s, w, rank, len(w) + slop)).tolist():
                    near[d].update(owners[number])
        longs, strings = pa.list_(pa.int64()), pa.list_(pa.string())
        return pa.RecordBatch.from_arrays(
            [pa.array([f"{place}-{d}" for d in range(n)]), s.ids, pa.array(s.n_words), pa.array(at, longs), pa.array(long, longs), pa.array([sorted(x) for x in found_items], strings), pa.array([sorted(x) for x in near], strings)],
            ["place", "id", "n_words", "starts", "lengths", "items", "near_items"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                place = row.pop("place")
                s = _Segment(**row)
                yield search(s, place, s.ids.type)

    cols = ["place", "ids", "starts", "n_words", "terms", "counts", "positions"]
    return index.select(*cols).mapInArrow(run, f"place string, id {kind}, n_words bigint, starts array<bigint>, lengths array<bigint>, items array<string>, near_items array<string>")


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", block_words: int = 500_000) -> DataFrame:
    """Per row of docs: (id, n_words, n_hit, n_items, items, contaminated).

    A word is hit if it stands in an occurrence of a window; items are the ids,
    as sorted text. A null or blank text has no words and no hit; blank items
    have no window; an empty benchmark hits nothing. Repeated documents are
    judged row by row, repeated items count once.
    """
    found = matches(docs, benchmark, window, id_col, text_col, item_col, item_text, None, block_words)
    covered = F.aggregate(
        F.array_sort(F.arrays_zip("starts", "lengths")),
        F.struct(F.lit(0).cast("bigint").alias("end"), F.lit(0).cast("bigint").alias("n")),
        lambda acc, x: F.struct(
            F.greatest(acc["end"], x["starts"] + x["lengths"]).alias("end"),
            (acc["n"] + F.greatest(F.lit(0), x["starts"] + x["lengths"] - F.greatest(acc["end"], x["starts"]))).alias("n"),
        ),
        lambda acc: acc["n"],
    )
    return found.select("id", "n_words", covered.alias("n_hit"), F.size("items").cast("bigint").alias("n_items"), "items", (F.size("starts") > 0).alias("contaminated"))


def op8_benchmark_decontamination(spark, sf_dir: str) -> DataFrame:
    docs, benchmark = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return contamination(docs, benchmark).select(
        F.col("id").alias("doc_id"), "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated"
    )
