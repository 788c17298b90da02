"""Packing of token ids into rows of one length, best fit decreasing.

Every partition packs what it reads, in blocks of so many tokens: nothing is
shuffled, and memory is bounded by the block. A document longer than a row is
split into pieces that are put together again by their offsets. Pieces go, the
longest first, into the open row with the least room that holds them; a segment
tree over the room that rows have left finds it.

Documents are tokenised on the way: a byte-level BPE whose words start at a
blank, so that equal words are encoded once and found in a table after that.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles, TaskContext
from pyspark.sql import DataFrame, functions as F

DEFAULT_VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"

# Fixed value: how the vocabulary's byte-level BPE splits a text into words.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""


class _Words(dict):
    """Word to its ids as bytes; words are encoded when they are first met."""

    def __init__(self, encode, keep: int):
        super().__init__()
        self.encode, self.keep = encode, keep

    def __missing__(self, word: str) -> bytes:
        if len(self) >= self.keep:
            self.clear()
        ids = self[word] = np.array(self.encode(word), np.uint32).tobytes()
        return ids


class ByteBpe:
    """Ids of a text under a vocabulary of ranks."""

    def __init__(self, path: str, keep: int = 300_000):
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, Path(path).read_bytes().splitlines())}
        self.coder = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.words = _Words(self.coder.encode_ordinary, keep)

    def ids(self, text: str | None) -> np.ndarray:
        """A word and the blank before it encode alone, unless blanks follow each other."""
        if not text:
            return np.zeros(0, np.uint32)
        if "  " in text or not text.isprintable() and any(c.isspace() and c not in "\n " for c in set(text)) or "\n " in text or " \n" in text:
            return np.array(self.coder.encode_ordinary(text), np.uint32)
        first, *rest = text.split(" ")
        data = b"".join([self.words[first], *map(self.words.__getitem__, [" " + w for w in rest])])
        return np.frombuffer(data, np.uint32)


@lru_cache(maxsize=2)
def _bpe(path: str) -> ByteBpe:
    return ByteBpe(path if Path(path).exists() else SparkFiles.get(Path(path).name))


class RoomTree:
    """Segment tree over amounts of room: the open rows with each amount, and the least amount that is enough."""

    def __init__(self, size: int):
        self.leaves = 1 << size.bit_length()
        self.some = bytearray(2 * self.leaves)
        self.rows: list[list[int]] = [[] for _ in range(size + 1)]

    def put(self, room: int, row: int) -> None:
        self.rows[room].append(row)
        at = room + self.leaves
        while at and not self.some[at]:
            self.some[at] = 1
            at >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """(room, row) with the least room of at least need, removed; None if no row has it."""
        at = need + self.leaves
        if not self.some[at]:
            while at > 1 and not (at % 2 == 0 and self.some[at + 1]):
                at >>= 1
            if at <= 1:
                return None
            at += 1
            while at < self.leaves:
                at = 2 * at if self.some[2 * at] else 2 * at + 1
        room = at - self.leaves
        row = self.rows[room].pop()
        if not self.rows[room]:
            self.some[at] = 0
            at >>= 1
            while at and not (self.some[2 * at] or self.some[2 * at + 1]):
                self.some[at] = 0
                at >>= 1
        return room, row


def best_fit_decreasing(lengths: list[int], capacity: int) -> list[list[int]]:
    """Rows of item numbers; lengths are from 1 to capacity. Equal lengths go in their order."""
    tree, rows = RoomTree(capacity), []
    for item in sorted(range(len(lengths)), key=lambda k: (-lengths[k], k)):
        found = tree.take(lengths[item])
        room, row = found or (capacity, len(rows))
        if not found:
            rows.append([])
        rows[row].append(item)
        if room > lengths[item]:
            tree.put(room - lengths[item], row)
    return rows


PACKED = "pack_id string, input_ids binary, n_tokens int, cu_seqlens array<int>, position_ids binary, doc_ids array<{kind}>, offsets array<bigint>"


def pack(docs: DataFrame, capacity: int = 2048, vocabulary: str = DEFAULT_VOCABULARY, id_col: str = "doc_id", text_col: str = "text", block_tokens: int = 4_000_000, pad_id: int = 0) -> DataFrame:
    """Rows of capacity token ids: (pack_id, input_ids, n_tokens, cu_seqlens, position_ids, doc_ids, offsets).

    input_ids is little-endian UINT16 (UINT32 if an id needs it), padded with
    pad_id to capacity: the rows one below the other are the id matrix.
    cu_seqlens are the ends of the pieces, from 0; position_ids (UINT16, or
    UINT32 for rows of over 65,536) count from 0 in each piece; doc_ids and
    offsets say which document a piece is of and at which token of it it
    starts. Nulls and empty texts have no tokens and are in no row; repeated
    rows are packed each. An empty table gives no rows.
    """
    kind = docs.schema[id_col].dataType

    def rows_of(place: str, ids: list, tokens: list[np.ndarray], wide: type, arrow: pa.DataType) -> pa.RecordBatch:
        pieces = [(d, at, min(capacity, len(t) - at)) for d, t in enumerate(tokens) for at in range(0, len(t), capacity)]
        packed = best_fit_decreasing([n for *_, n in pieces], capacity)
        positions = np.arange(capacity, dtype=np.uint16 if capacity <= 1 << 16 else np.uint32)
        out = {k: [] for k in ("pack_id", "input_ids", "n_tokens", "cu_seqlens", "position_ids", "doc_ids", "offsets")}
        for number, items in enumerate(packed):
            own = [pieces[k] for k in items]
            ends = np.cumsum([0, *[n for *_, n in own]])
            pad = capacity - int(ends[-1])
            out["pack_id"].append(f"{place}-{number}")
            out["input_ids"].append(np.concatenate([*[tokens[d][at : at + n] for d, at, n in own], np.full(pad, pad_id)]).astype(wide).tobytes())
            out["n_tokens"].append(int(ends[-1]))
            out["cu_seqlens"].append(ends.tolist())
            out["position_ids"].append(b"".join([*[positions[:n].tobytes() for *_, n in own], positions[:pad].tobytes()]))
            out["doc_ids"].append([ids[d] for d, *_ in own])
            out["offsets"].append([at for _, at, _ in own])
        kinds = [pa.string(), pa.binary(), pa.int32(), pa.list_(pa.int32()), pa.binary(), pa.list_(arrow), pa.list_(pa.int64())]
        return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out.values(), kinds, strict=True)], list(out))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _bpe(vocabulary)
        wide = np.uint16 if max(bpe.coder.max_token_value, pad_id) < 1 << 16 else np.uint32
        partition, block, ids, tokens, held, arrow = TaskContext.get().partitionId(), 0, [], [], 0, pa.int64()
        for batch in batches:
            arrow = batch.column(0).type
            for i, t in zip(batch.column(0), batch.column(1), strict=True):
                own = bpe.ids(t.as_py())
                if len(own):
                    ids.append(i.as_py())
                    tokens.append(own.astype(wide))
                    held += len(own)
                if held >= block_tokens:
                    yield rows_of(f"{partition}-{block}", ids, tokens, wide, arrow)
                    block, ids, tokens, held = block + 1, [], [], 0
        if ids:
            yield rows_of(f"{partition}-{block}", ids, tokens, wide, arrow)

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, PACKED.format(kind=kind.simpleString()))


def write_matrices(packed: DataFrame, path: str) -> None:
    """Writes packed rows below path as Parquet: part files, each a block of the id matrix."""
    packed.write.mode("errorifexists").parquet(path)


def unpack(packed: DataFrame, wide: str = "uint16") -> DataFrame:
    """(doc_id, offset, input_ids ARRAY<INT>): the pieces of packed rows, for putting documents together again."""
    kind = packed.schema["doc_ids"].dataType.elementType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs, offsets, ids = [], [], []
            for row in batch.to_pylist():
                all_ids = np.frombuffer(row["input_ids"], wide)
                for k, (d, o) in enumerate(zip(row["doc_ids"], row["offsets"], strict=True)):
                    docs.append(d)
                    offsets.append(o)
                    ids.append(all_ids[row["cu_seqlens"][k] : row["cu_seqlens"][k + 1]].astype(np.int32))
            yield pa.RecordBatch.from_arrays([pa.array(docs, batch.column(2).type.value_type), pa.array(offsets, pa.int64()), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "offset", "input_ids"])

    return packed.select("input_ids", "cu_seqlens", "doc_ids", "offsets").mapInArrow(run, f"doc_id {kind}, offset bigint, input_ids array<int>")


def op7_pack_tokens(spark, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
