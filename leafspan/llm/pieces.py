"""SentencePiece models on the tokenizers library: encode, decode, verify.

The model's protobuf is read field by field. From it come the normaliser (the
compiled character map if there is one, blanks, the marker of word starts),
the pieces with their scores (a unigram model as it stands, a BPE model as
merges in the order of the scores) and the byte fallback.

Where no piece holds a word-start marker after another character, a text falls
apart at the markers and its words encode one by one, exactly. A batch is then
its distinct words, encoded in one multithreaded call and kept for the next.
Other models get whole texts.

Decoding joins the bytes of all ids of a batch at once; to verify, what every
text's ids decode to is held against the text.
"""

from __future__ import annotations

import re
import struct
from array import array
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, functions as F
from tokenizers import Regex, Tokenizer, decoders, models, normalizers

MARK = "▁"
NORMAL, UNKNOWN, CONTROL, USER, BYTE = 1, 2, 3, 4, 6
DEFAULT_MODEL = "/opt/tokenizers/piece_bpe_32k.model"


def _fields(data: bytes) -> Iterator[tuple[int, object]]:
    """(number, value) of a protobuf message's fields: whole numbers, floats or bytes."""

    def varint(at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            value |= (data[at] & 127) << shift
            at, shift = at + 1, shift + 7
            if data[at - 1] < 128:
                return value, at

    at = 0
    while at < len(data):
        tag, at = varint(at)
        kind = tag & 7
        if kind == 0:
            value, at = varint(at)
        elif kind == 5:
            (value,) = struct.unpack_from("<f", data, at)
            at += 4
        elif kind == 1:
            (value,) = struct.unpack_from("<d", data, at)
            at += 8
        else:
            n, at = varint(at)
            value, at = data[at : at + n], at + n
        yield tag >> 3, value


class PieceModel:
    """A parsed model: pieces as (text, score, kind), and the settings that encoding heeds."""

    def __init__(self, data: bytes):
        self.pieces: list[tuple[str, float, int]] = []
        self.bpe, self.byte_fallback, self.unk = False, False, 0
        self.charsmap, self.dummy_prefix, self.squeeze, self.escape = b"", True, True, True
        for number, value in _fields(data):
            if number == 1:
                own = dict(_fields(value))
                self.pieces.append((own.get(1, b"").decode(), own.get(2, 0.0), own.get(3, NORMAL)))
            elif number == 2:
                own = dict(_fields(value))
                self.bpe, self.byte_fallback, self.unk = own.get(3, 1) == 2, bool(own.get(35, 0)), own.get(40, 0)
            elif number == 3:
                own = dict(_fields(value))
                self.charsmap = own.get(2, b"")
                self.dummy_prefix, self.squeeze, self.escape = (bool(own.get(k, 1)) for k in (3, 4, 5))
        self.by_word = all(not re.search(f"[^{MARK}]{MARK}", p) for p, _, kind in self.pieces if kind in (NORMAL, USER))

    def tokenizer(self) -> Tokenizer:
        """The same encoding on the tokenizers library; the marker of the start is left to normalise()."""
        vocab = {p: i for i, (p, _, _) in enumerate(self.pieces)}
        if self.bpe:
            plain = {p: s for p, s, kind in self.pieces if kind in (NORMAL, USER)}
            merges = [(s, vocab[p], p[:k], p[k:]) for p, s in plain.items() for k in range(1, len(p)) if p[:k] in plain and p[k:] in plain]
            merges.sort(key=lambda m: (-m[0], m[1]))
            model = models.BPE(vocab, [(a, b) for *_, a, b in merges], unk_token=self.pieces[self.unk][0], fuse_unk=not self.byte_fallback, byte_fallback=self.byte_fallback)
        else:
            model = models.Unigram([(p, s) for p, s, _ in self.pieces], self.unk, self.byte_fallback)
        out = Tokenizer(model)
        steps = [normalizers.Precompiled(self.charsmap)] if self.charsmap else []
        if self.squeeze:
            steps += [normalizers.Strip(), normalizers.Replace(Regex(" {2,}"), " ")]
        self.normalizer = normalizers.Sequence(steps) if steps else None
        out.decoder = decoders.Sequence([decoders.ByteFallback(), decoders.Fuse()])
        return out

    def normalise(self, text: str) -> str:
        if self.normalizer is not None:
            text = self.normalizer.normalize_str(text)
        if self.dummy_prefix and text:
            text = " " + text
        return text.replace(" ", MARK) if self.escape else text


class Codec:
    """Encodes and decodes lists of texts; words seen before are kept, up to ``keep``."""

    def __init__(self, path: str, keep: int = 400_000, verify: bool = False):
        data = Path(path).read_bytes()
        self.model = PieceModel(data)
        self.tokenizer = self.model.tokenizer()
        self.keep, self.known = keep, {}
        self.sp, self.differ = None, set()
        if verify:
            import sentencepiece

            self.sp = sentencepiece.SentencePieceProcessor(model_proto=data)
        self.bytes = [
            bytes([int(p[3:5], 16)]) if kind == BYTE else b"" if kind == CONTROL else p.replace(MARK, " ").encode() if kind != UNKNOWN else " ⁇ ".encode()
            for p, _, kind in self.model.pieces
        ]
        self.sizes = np.array([len(b) for b in self.bytes], np.int64)

    def _learn(self, words: set[str]) -> None:
        new = [w for w in words if w not in self.known]  # a difference would go through all known words
        if len(self.known) + len(new) > self.keep:
            self.known, self.differ = {}, set()
            new = list(words)
        ids = [e.ids for e in self.tokenizer.encode_batch_fast(new, add_special_tokens=False)]
        for word, own in zip(new, ids, strict=True):
            self.known[word] = array("i", own).tobytes()
        if self.sp is None:
            return
        if self.word_parity:
            # The library puts a marker before each text: a word without its own is a text whose pieces are that word's.
            usual = [k for k, w in enumerate(new) if w[:1] == MARK and w[1:2] not in ("", MARK)]
            for k, own in zip(usual, self.sp.encode([new[k][1:] for k in usual], num_threads=1), strict=True):
                if own != ids[k]:
                    self.differ.add(new[k])
            # Words of several markers stand behind a letter instead, whose pieces are taken off again; a word without any is in no normalised text.
            lone = self.sp.encode("a")
            for w, own in zip(new, ids, strict=True):
                if w[:1] != MARK or (w[1:2] in ("", MARK) and self.sp.encode("a" + w.replace(MARK, " ")) != lone + own):
                    self.differ.add(w)

    @property
    def word_parity(self) -> bool:
        """Whether words can be held against the library one by one: where blanks aren't squeezed and each text gets a marker."""
        return self.model.by_word and self.model.dummy_prefix and not self.model.squeeze and not self.model.charsmap and self.model.escape

    def encode(self, texts: list[str], step: int = 256) -> list[np.ndarray]:
        return [ids for ids, *_ in self.encoded(texts, step)]

    def encoded(self, texts: list[str], step: int = 256) -> list[tuple[np.ndarray, bool | None, bool | None]]:
        """Ids, whether they are those of the sentencepiece library, and whether they decode to the text as normalised; nulls without verify.

        Every distinct word is compared where words can be, else every whole text.
        """
        out = []
        for at in range(0, len(texts), step):
            part = [t or "" for t in texts[at : at + step]]
            plain = [self.model.normalise(t) if t else "" for t in part]
            cut = [_words(t) if self.model.by_word else [t] for t in plain]
            self._learn(set().union(*cut))
            ids = [np.frombuffer(b"".join(map(self.known.__getitem__, words)), np.int32) for words in cut]
            if self.sp is None:
                alike = [None] * len(part)
            elif self.word_parity:
                alike = [not self.differ or self.differ.isdisjoint(words) for words in cut]
            else:
                alike = [np.array_equal(x, np.array(y, np.int32)) for x, y in zip(ids, self.sp.encode(part, num_threads=1), strict=True)]
            whole = [None] * len(part) if self.sp is None else self._whole(ids, plain)
            out += zip(ids, alike, whole, strict=True)
        return out

    def _bytes_of(self, ids: np.ndarray) -> bytes:
        """The bytes of all pieces, one after the other."""
        return b"".join(map(self.bytes.__getitem__, ids.tolist()))

    def _whole(self, ids: list[np.ndarray], plain: list[str], most: int = 1 << 20) -> list[bool]:
        """Whether the ids of each text decode to it; about most ids are decoded at once."""
        out: list[bool] = []
        cuts = np.flatnonzero(np.diff(np.cumsum([len(x) for x in ids]) // most)) + 1
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(ids)], strict=True):
            if b == a:
                continue
            own = np.concatenate(ids[a:b])
            data = self._bytes_of(own)
            wanted = [t.replace(MARK, " ").encode("utf-8", "replace") for t in plain[a:b]]
            lengths = [len(w) for w in wanted]
            ends = np.cumsum(np.append(0, self.sizes[own]))[np.cumsum([0, *[len(x) for x in ids[a:b]]])].tolist()
            if data == b"".join(wanted) and np.array_equal(np.diff(ends), lengths):
                out += [True] * (b - a)
            else:
                out += [data[i:j] == w for i, j, w in zip(ends, ends[1:], wanted)]
        return out

    def decode(self, ids: np.ndarray) -> str:
        text = self._bytes_of(np.asarray(ids)).decode("utf-8", "replace")
        return text[1:] if self.model.dummy_prefix and text[:1] == " " else text


def _words(text: str) -> list[str]:
    """The parts of a normalised text that no piece reaches across: runs of markers with what follows."""
    if MARK + MARK not in text:
        parts = text.split(MARK)
        return ([parts[0]] if parts[0] else []) + [MARK + p for p in parts[1:]]
    return re.findall(f"{MARK}+[^{MARK}]*|[^{MARK}]+", text)


@lru_cache(maxsize=2)
def _codec(path: str, verify: bool) -> Codec:
    return Codec(path, verify=verify)


def _local(path: str) -> str:
    """The model's place on this machine: the path itself, or what addFile() has brought."""
    return path if Path(path).exists() else SparkFiles.get(Path(path).name)


def encode(docs: DataFrame, model: str = DEFAULT_MODEL, id_col: str = "doc_id", text_col: str = "text", verify: bool = False) -> DataFrame:
    """Per row of docs: (id, n_tokens, input_ids); with verify also parity and round_trip.

    model: a path that exists on every machine, or else of a file given to
    SparkContext.addFile(). A null or empty text has no ids. parity: the
    sentencepiece library gives the same ids, compared for every distinct word, or,
    where a model joins or drops blanks, for every whole text. round_trip: the ids decode
    to the text as normalised, in which a marker is a blank. Repeated rows and null ids stay; an
    empty table gives an empty table.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(_local(model), verify)
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                texts = part.column(1).to_pylist()
                got = codec.encoded(texts)
                ids = [x for x, *_ in got]
                ends = np.concatenate(([0], np.cumsum([len(x) for x in ids]))).astype(np.int32)
                flat = np.concatenate(ids) if ids else np.zeros(0, np.int32)
                cols = [part.column(0), pa.array(np.diff(ends).astype(np.int64)), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat, pa.int32()))]
                names = ["id", "n_tokens", "input_ids"]
                if verify:
                    cols += [pa.array([x for _, x, _ in got], pa.bool_()), pa.array([x for *_, x in got], pa.bool_())]
                    names += ["parity", "round_trip"]
                yield pa.RecordBatch.from_arrays(cols, names)

    more = ", parity boolean, round_trip boolean" if verify else ""
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"id {kind}, n_tokens bigint, input_ids array<int>{more}")


def decode(tokens: DataFrame, model: str = DEFAULT_MODEL, id_col: str = "id", ids_col: str = "input_ids") -> DataFrame:
    """(id, text) of every row; null ids give a null text. Bytes that aren't UTF-8 become U+FFFD."""
    kind = tokens.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(_local(model), False)
        for batch in batches:
            texts = [None if x is None else codec.decode(np.array(x, np.int64)) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["id", "text"])

    return tokens.select(F.col(id_col).alias("id"), F.col(ids_col).cast("array<int>").alias("ids")).mapInArrow(run, f"id {kind}, text string")


def op6_sentencepiece(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return encode(docs, verify=True).withColumnRenamed("id", "doc_id")
