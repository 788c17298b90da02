"""Best-fit packing into sequences, certified by lower bounds and repacked until they hold or nothing is gained.

Every partition packs the pieces of its own documents, best fit decreasing, and
compares the number of its sequences with a lower bound: dual feasible
functions map lengths so that what fits into one sequence still fits, so the
sum of the mapped lengths, rounded up, is a number of sequences that no packing
goes below. A partition at its bound is certified. Where that bound is no more
than its tokens ask for, its sequences stay, but for the emptiest, which is
rounding. Any other partition has a gap, above its bound or in the room that
its long pieces leave: all of its sequences that have room are opened. What is
open is dealt out anew over fewer partitions, packed again and certified again,
until the open sequences meet the bound of all that is open, or a round over
the fewest partitions that memory allows is done. If all sequences together are
then still above the bound of all pieces, everything is dealt out once, and the
better packing stays.

Only lengths and keys travel between partitions, never texts or ids, and each
round is written to the shared checkpoint folder before the next reads it.
"""

from __future__ import annotations

import json
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles, TaskContext
from pyspark.sql import DataFrame, functions as F

from .common import cut, table
from .packing import PATTERN, best_fit_decreasing

END_ID = 0  # closes every document


class WordIds:
    """Ids of whole texts under a byte-level vocabulary of the tokenizers library; each distinct word of a blank and what follows it is encoded once.

    Where the vocabulary's merges are in the order of their ids, words go
    through the ranks of the same vocabulary, which gives the same ids in a third
    of the time; in any other order they go through the tokenizers library.
    """

    def __init__(self, path: str, keep: int = 1_500_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # a special token's name in a text is text
        self.keep, self.after_blank = keep, {}
        self.word = self._ranked(json.loads(Path(path).read_bytes())["model"]) or self._whole

    def _ranked(self, model: dict):
        import tiktoken

        vocab, pairs = model["vocab"], [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        made = [vocab[a + b] for a, b in pairs]
        if made != sorted(set(made)) or len(made) + 256 > len(vocab):
            return None
        byte = {c: b for b, c in enumerate(_byte_letters())}
        single = [t for t in vocab if len(t) == 1 and t in byte]
        if len(single) != 256 or max(vocab[t] for t in single) > made[0]:
            return None
        ranks = {bytes(byte[c] for c in t): vocab[t] for t in [*single, *(a + b for a, b in pairs)]}
        coder = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        return coder.encode_ordinary

    def _whole(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def of(self, text: str | None) -> bytes:
        """Unsigned 32-bit ids, the lowest byte first.

        A blank before anything but white space begins a word of the tokenizer,
        and nothing joins across it; texts with other runs of blanks go whole.
        """
        if not text:
            return b""
        if "  " in text or text[-1] == " " or "\n " in text or " \n" in text or not text.isprintable() and any(c.isspace() and c not in "\n " for c in set(text)):
            return array("I", self._whole(text)).tobytes()
        known, word, (first, *rest) = self.after_blank, self.word, text.split(" ")
        new = [w for w in set(rest) if w not in known]
        if len(known) + len(new) > self.keep:
            known.clear()
            new = set(rest)
        for w in new:
            known[w] = array("I", word(" " + w)).tobytes()
        return b"".join([array("I", word(first)).tobytes(), *map(known.__getitem__, rest)])


def _byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies: printable bytes for themselves, the others from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b if b in plain else next(rest)) for b in range(256)]


@lru_cache(maxsize=2)
def _word_ids(path: str) -> WordIds:
    return WordIds(path if Path(path).exists() else SparkFiles.get(Path(path).name))


def lower_bound(counts: np.ndarray, capacity: int, thresholds: int = 512) -> int:
    """Sequences that pieces need at least; counts has the number of pieces of each length from 0 to capacity.

    The greatest bound of three families of dual feasible functions, all in
    whole numbers: lengths as they are; ``u_k``, which rounds multiples of
    1 / (k + 1) down; for thresholds e among the lengths up to a half, ``U_e``
    (over capacity - e is whole, under e nothing) and ``phi_e`` (a half and less
    in steps of e, above a half what is left of it). More than ``thresholds``
    lengths are thinned out evenly, which only lowers the bound.
    """
    x = np.flatnonzero(counts)
    x = x[x > 0]
    if not len(x):
        return 0
    n = counts[x].astype(np.int64)
    best = -(-int((n * x).sum()) // capacity)
    for k in range(1, 33):
        whole = x * (k + 1) % capacity == 0
        best = max(best, -(-int((n * np.where(whole, x * k, (k + 1) * x // capacity * capacity)).sum()) // (k * capacity)))
    for e in _thinned(x[2 * x <= capacity], thresholds):
        full = np.where(x > capacity - e, capacity, np.where(x < e, 0, x))
        best = max(best, -(-int((n * full).sum()) // capacity))
        steps = capacity // e
        part = np.where(2 * x > capacity, 2 * (steps - (capacity - x) // e), np.where(2 * x == capacity, steps, 2 * (x // e)))
        best = max(best, -(-int((n * part).sum()) // (2 * steps)))
    return best


def _thinned(values: np.ndarray, most: int) -> np.ndarray:
    return values if len(values) <= most else values[np.linspace(0, len(values) - 1, most).astype(int)]


_OWN = "piece int, start bigint, length bigint, ids_crc32 bigint"
_PLACE = "sequence_id bigint, offset bigint, certified boolean, open boolean, bins bigint, bound bigint"


def _block(pieces: pa.Table, capacity: int, first: int) -> pa.Table:
    """The pieces of one block in their sequences, numbered from first, with the block's certificate."""
    order = pieces.sort_by([("length", "descending"), *[(c, "ascending") for c in ("id", "piece", "start", "ids_crc32")]])
    lengths = order["length"].to_numpy()
    packed = best_fit_decreasing(lengths.tolist(), capacity)
    bound = lower_bound(np.bincount(lengths, minlength=capacity + 1), capacity)
    certified = len(packed) == bound
    of, offset, fill = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64), np.zeros(len(packed), np.int64)
    for row, items in enumerate(packed):
        of[items] = row
        own = lengths[items]
        offset[items] = np.cumsum(own) - own
        fill[row] = own.sum()
    loose = fill < capacity
    if len(packed) == -(-int(lengths.sum()) // capacity):
        loose &= np.arange(len(packed)) == int(np.argmin(fill))
    once = [None] * (len(lengths) - 1)
    cells = [pa.array(of + first), pa.array(offset), pa.array(np.full(len(lengths), certified)), pa.array(loose[of]), pa.array([len(packed), *once], pa.int64()), pa.array([bound, *once], pa.int64())]
    for field, cell in zip(_PLACE.split(", "), cells, strict=True):
        order = order.append_column(field.split()[0], cell)
    return order


def _sequences(tables: Iterator[pa.Table], capacity: int, round_: int, block_pieces: int) -> Iterator[pa.RecordBatch]:
    """Packs a partition's pieces in blocks of so many."""
    first, held, n = round_ << 58 | TaskContext.get().partitionId() << 30, [], 0

    def done() -> Iterator[pa.RecordBatch]:
        nonlocal first, held, n
        out = _block(pa.concat_tables(held).combine_chunks(), capacity, first)
        first, held, n = first + out["bins"][0].as_py(), [], 0
        yield from out.to_batches()

    for own in tables:
        for at in range(0, own.num_rows, block_pieces):
            held.append(own.slice(at, block_pieces))
            n += held[-1].num_rows
            if n >= block_pieces:
                yield from done()
    if n:
        yield from done()


def _cut_up(batches: Iterator[pa.RecordBatch], capacity: int, tokenizer: str) -> Iterator[pa.Table]:
    """Every document's pieces: lengths and checksums of the ids, which go no further."""
    words, end = _word_ids(tokenizer), np.array([END_ID], np.uint32).tobytes()
    for batch in batches:
        doc, piece, start, length, crc = [], [], [], [], []
        for d, text in enumerate(batch.column(1)):
            ids = words.of(text.as_py()) + end
            n, at, k = len(ids) // 4, 0, 0
            while at < n:
                size = ((n - at) % capacity or capacity) if at == 0 else capacity
                doc.append(d)
                piece.append(k)
                start.append(at)
                length.append(size)
                crc.append(zlib.crc32(ids[4 * at : 4 * (at + size)]))
                at, k = at + size, k + 1
        yield pa.table({"id": batch.column(0).take(pa.array(doc, pa.int64())), "piece": pa.array(piece, pa.int32()), "start": pa.array(start, pa.int64()), "length": pa.array(length, pa.int64()), "ids_crc32": pa.array(crc, pa.int64())})


def _lengths(pieces: DataFrame) -> np.ndarray:
    """Number of pieces of each length, of which there are capacity at most."""
    rows = pieces.groupBy("length").count().collect()
    counts = np.zeros(max([r["length"] for r in rows], default=0) + 1, np.int64)
    for r in rows:
        counts[r["length"]] = r["count"]
    return counts


def repack(docs: DataFrame, tokenizer: str, capacity: int = 2048, id_col: str = "doc_id", text_col: str = "text", block_pieces: int = 1_000_000, fan: int = 8) -> DataFrame:
    """Pieces in sequences of at most capacity tokens: (id, piece, start, length, ids_crc32, sequence_id, offset, certified).

    A document is its ids and END_ID; one longer than capacity is cut into
    pieces of capacity, of which the first has what is left over. Nulls and
    empty texts are END_ID alone, so every row has a place; repeated rows and
    null ids are packed each. certified says that the partition which made the
    sequence met its lower bound. An empty table gives no rows. A task holds
    block_pieces pieces; fan partitions at most exchange what is open in one.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, {_OWN}, {_PLACE}"

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _sequences(_cut_up(batches, capacity, tokenizer), capacity, 0, block_pieces)

    def again(round_: int):
        return lambda batches: _sequences((pa.Table.from_batches([b]) for b in batches), capacity, round_, block_pieces)

    own = ["id", *[f.split()[0] for f in _OWN.split(", ")]]

    def dealt(pieces: DataFrame, width: int, round_: int) -> DataFrame:
        return cut(pieces.select(*own).repartition(width).mapInArrow(again(round_), schema))

    def settled(now: DataFrame, round_: int) -> tuple[DataFrame, int]:
        """Rounds of exchange over what is open; the pieces in their places, and the next round's number."""
        width, closed = now.agg(F.count("bins")).first()[0], []
        for round_ in range(round_, round_ + 12):
            loose = now.where("open")
            counts, sequences = _lengths(loose), loose.where("offset = 0").count()
            least = -(-int(counts.sum()) // block_pieces)
            if sequences <= lower_bound(counts, capacity) or width <= least and closed:
                break
            width = max(least, -(-width // fan))
            then = dealt(loose, width, round_)
            if then.agg(F.sum("bins")).first()[0] < sequences:
                closed.append(now.where("not open"))
                now = then
            elif width <= least:
                break
        for part in closed:
            now = now.unionByName(part)
        return now, round_ + 1

    now, round_ = settled(cut(docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(first, schema)), 1)
    said = certificate(now, capacity)
    if said["sequences"] > said["lower_bound"]:
        width = max(1, -(-said["pieces"] // block_pieces), now.agg(F.count("bins")).first()[0] // fan)
        mixed, _ = settled(dealt(now, width, round_), round_ + 1)
        if certificate(mixed, capacity)["sequences"] < said["sequences"]:
            now = mixed
    return now.select(*own, "sequence_id", "offset", "certified")


def certificate(packed: DataFrame, capacity: int = 2048) -> dict[str, int]:
    """Sequences of a packing, and what no packing of all its pieces goes below."""
    counts = _lengths(packed)
    return {"sequences": packed.where("offset = 0").count(), "lower_bound": lower_bound(counts, capacity), "tokens": int((counts * np.arange(len(counts))).sum()), "pieces": int(counts.sum())}


def op11_bestfit_repacking(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return repack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json")).withColumnRenamed("id", "doc_id")
