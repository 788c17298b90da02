"""Quality classifier: a generalised additive model with pairwise interactions.

Features of a text are cut into bins. Shallow trees, boosted in a cycle over
the features at a low rate, add up to one table of scores per feature; the
strongest pairs of features then get tables of their own, boosted on what is
left. A text's score is a sum of table entries, looked up by bin for a whole
batch at once.

Training takes at most ``max_train`` labelled texts (those with the smallest
hash of their id), so what comes to the driver is bounded: a row of numbers
for each of them. Scoring covers every row and whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

FEATURES = (
    "log_chars", "log_words", "upper", "digit", "blank", "newline", "stop", "shout", "symbol", "bar", "non_ascii",
    "word_length", "distinct_words", "short_words", "function_words", "repeated_lines", "line_words", "symbol_variety",
)

# Frequent function words of four languages.
FUNCTION_WORDS = frozenset(
    w.encode()
    for w in (
        "the of and to in is that it for on was are as with be by at this from or an not but have "
        "de la le et les des en un du une que est pour dans qui sur pas au par avec "
        "der die und den von zu das mit sich auf für dem ein eine nicht als auch "
        "el los se del las por con para una su al lo como más"
    ).split()
)


def _share(of: bytes) -> np.ndarray:
    mask = np.zeros(256)
    mask[list(of)] = 1
    return mask


_CLASSES = np.stack(
    [
        _share(bytes(range(65, 91))), _share(b"0123456789"), _share(b" \t\r\x0b\x0c"), _share(b"\n"), _share(b".,;:?'\"-()"),
        _share(b"!"), _share(b"#*$%&<>@^~_=+/\\{}[]"), _share(b"|"), _share(bytes(range(128, 256))),
    ],
    axis=1,
)


def features_of(text: bytes | None) -> list[float]:
    """The numbers in FEATURES for a text in UTF-8; a null counts as empty."""
    text = text or b""
    counts = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    shares = (counts @ _CLASSES) / max(1, len(text))
    words, lines = text.split(), [x for x in text.split(b"\n") if x.strip()]
    n = max(1, len(words))
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    return [
        float(np.log1p(len(text))), float(np.log1p(len(words))), *shares.tolist(),
        float(lengths.mean()) if len(words) else 0.0, len(set(words)) / n, float((lengths <= 3).sum()) / n,
        sum(map(FUNCTION_WORDS.__contains__, words)) / n, 1 - len(set(lines)) / max(1, len(lines)), len(words) / max(1, len(lines)),
        float((counts[[35, 36, 37, 38, 42, 60, 62, 124]] > 0).sum()),
    ]


@dataclass
class AdditiveModel:
    """Bin edges and score tables; pairs look two bins up at once."""

    base: float = 0.0
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int]] = field(default_factory=list)
    coarse: list[np.ndarray] = field(default_factory=list)
    pair_tables: list[np.ndarray] = field(default_factory=list)

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], "right") for j, e in enumerate(self.edges)], axis=1) if len(x) else np.zeros(x.shape, np.int64)

    def score(self, x: np.ndarray) -> np.ndarray:
        bins = self.bins(x)
        total = np.full(len(x), self.base)
        for j, t in enumerate(self.tables):
            total += t[bins[:, j]]
        for (a, b), t in zip(self.pairs, self.pair_tables, strict=True):
            total += t[self.coarse[a][bins[:, a]], self.coarse[b][bins[:, b]]]
        return 1 / (1 + np.exp(-total))


def _tree(g: np.ndarray, h: np.ndarray, leaves: int, l2: float) -> np.ndarray:
    """Best-first tree of one feature: values per bin, from gradient and weight sums per bin."""
    cg, ch = np.concatenate(([0], np.cumsum(g))), np.concatenate(([0], np.cumsum(h)))
    gain = lambda a, b: (cg[b] - cg[a]) ** 2 / (ch[b] - ch[a] + l2)
    parts = [(0, len(g))]
    for _ in range(leaves - 1):
        best = (1e-9, None, None)
        for k, (a, b) in enumerate(parts):
            if b - a > 1:
                cut = np.arange(a + 1, b)
                won = gain(a, cut) + gain(cut, b) - gain(a, b)
                i = int(won.argmax())
                if won[i] > best[0]:
                    best = (won[i], k, int(cut[i]))
        if best[1] is None:
            break
        a, b = parts.pop(best[1])
        parts += [(a, best[2]), (best[2], b)]
    out = np.zeros(len(g))
    for a, b in parts:
        out[a:b] = (cg[b] - cg[a]) / (ch[b] - ch[a] + l2)
    return out


def _pair_tree(g: np.ndarray, h: np.ndarray, l2: float) -> tuple[float, np.ndarray]:
    """Gain and values of the best cross cut (four leaves) of a grid of gradient and weight sums."""
    cg, ch = (np.pad(x, ((1, 0), (1, 0))).cumsum(0).cumsum(1) for x in (g, h))
    corner = lambda c: (c[1:-1, 1:-1], c[1:-1, -1:] - c[1:-1, 1:-1], c[-1:, 1:-1] - c[1:-1, 1:-1], c[-1, -1] - c[1:-1, -1:] - c[-1:, 1:-1] + c[1:-1, 1:-1])
    if min(g.shape) < 2:
        return 0.0, np.zeros(g.shape)
    gs, hs = corner(cg), corner(ch)
    won = sum(a**2 / (b + l2) for a, b in zip(gs, hs, strict=True))
    i, j = np.unravel_index(int(won.argmax()), won.shape)
    out = np.zeros(g.shape)
    v = [float(a[i, j] / (b[i, j] + l2)) for a, b in zip(gs, hs, strict=True)]
    out[: i + 1, : j + 1], out[: i + 1, j + 1 :], out[i + 1 :, : j + 1], out[i + 1 :, j + 1 :] = v
    return float(won[i, j] - cg[-1, -1] ** 2 / (ch[-1, -1] + l2)), out


def fit(x: np.ndarray, y: np.ndarray, n_bins: int = 32, rounds: int = 120, rate: float = 0.1, leaves: int = 3, n_pairs: int = 6, pair_bins: int = 8, l2: float = 1.0) -> AdditiveModel:
    """Fits the tables. Without rows of both labels the score is the share of label 1 (0.5 without rows)."""
    p = (y.sum() + 0.5) / (len(y) + 1)
    model = AdditiveModel(base=float(np.log(p / (1 - p))))
    if len(np.unique(y)) < 2:
        return model
    for j in range(x.shape[1]):
        model.edges.append(np.unique(np.quantile(x[:, j], np.linspace(0, 1, n_bins + 1)[1:-1])))
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    bins, total = model.bins(x), np.full(len(y), model.base)
    for _ in range(rounds):
        for j, t in enumerate(model.tables):
            q = 1 / (1 + np.exp(-total))
            step = rate * _tree(np.bincount(bins[:, j], y - q, len(t)), np.bincount(bins[:, j], q * (1 - q), len(t)), leaves, l2)
            t += step
            total += step[bins[:, j]]
    model.coarse = [np.arange(len(t)) * pair_bins // max(len(t), 1) if len(t) > pair_bins else np.arange(len(t)) for t in model.tables]
    q = 1 / (1 + np.exp(-total))
    own = [c[bins[:, j]] for j, c in enumerate(model.coarse)]
    size = [int(c.max()) + 1 for c in model.coarse]

    def grid(a: int, b: int, w: np.ndarray) -> np.ndarray:
        return np.bincount(own[a] * size[b] + own[b], w, size[a] * size[b]).reshape(size[a], size[b])

    ranked = sorted(((_pair_tree(grid(a, b, y - q), grid(a, b, q * (1 - q)), l2)[0], a, b) for a in range(x.shape[1]) for b in range(a)), key=lambda r: (-r[0], r[1:]))
    model.pairs = [(a, b) for _, a, b in ranked[:n_pairs]]
    model.pair_tables = [np.zeros((size[a], size[b])) for a, b in model.pairs]
    for _ in range(rounds // 4):
        for (a, b), t in zip(model.pairs, model.pair_tables, strict=True):
            q = 1 / (1 + np.exp(-total))
            step = rate * _pair_tree(grid(a, b, y - q), grid(a, b, q * (1 - q)), l2)[1]
            t += step
            total += step[own[a], own[b]]
    return model


def held_out(id_col: str) -> F.Column:
    """Whether a row is kept from training: crc32 of its id as text is divisible by 5."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_train: int = 20_000) -> AdditiveModel:
    """Fits a model on labelled texts that aren't held out.

    Labels of null and rows without an id are left out; an id labelled twice
    counts as 1 if at least half of its labels are 1. Of the rows of one id one
    text serves, that of the least hash, so max_train bounds the rows that come
    to the driver, and a repeated id weighs no more than others.
    """
    known = (
        labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & ~held_out(id_col))
        .groupBy(F.col(id_col).alias("id"))
        .agg((F.avg(label_col) >= 0.5).cast("double").alias("y"))
        .orderBy(F.xxhash64("id"), "id")
        .limit(max_train)  # the documented bound of the sample
    )
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(known), "id")  # at most max_train rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [features_of(t.as_py()) for t in batch.column(1).cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:1], *batch.columns[2:], pa.array(rows, pa.list_(pa.float64()))], ["id", "y", "h", "x"])

    kind = texts.schema["id"].dataType.simpleString()
    read = texts.select("id", "text", "y", F.xxhash64(F.coalesce("text", F.lit(""))).alias("h")).mapInArrow(run, f"id {kind}, y double, h bigint, x array<double>")
    # Counted down to a row an id within tasks first.
    got = read.groupBy("id").agg(F.first("y").alias("y"), F.min_by("x", "h").alias("x")).select("y", "x").toPandas()
    x = np.array(got["x"].tolist(), float).reshape(len(got), len(FEATURES))
    order = np.lexsort((*x.T, got["y"].to_numpy(float)))  # rows arrive in any order
    return fit(x[order], got["y"].to_numpy(float)[order])


def scored(docs: DataFrame, model: AdditiveModel, text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """(row, quality_score, predicted) of every row; row is a struct of all columns, so that none of their names clashes."""
    wanted = docs.select(F.struct("*").alias("row"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                x = np.array([features_of(t.as_py()) for t in part.column(1).cast(pa.binary())]).reshape(-1, len(FEATURES))
                s = model.score(x)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(s), pa.array((s >= threshold).astype(np.int32))], ["row", "quality_score", "predicted"])

    return wanted.mapInArrow(run, f"row {wanted.schema['row'].dataType.simpleString()}, quality_score double, predicted int")


def score(docs: DataFrame, model: AdditiveModel, id_col: str = "doc_id", text_col: str = "text", columns: list[str] | None = None, threshold: float = 0.3) -> DataFrame:
    """The given columns of every row (its id if none are given), and quality_score and predicted.

    Given columns of these two names give way. A null or empty text is scored
    like any other, as one without words; repeated rows and null ids stay, and
    rows that are equal get equal scores. An empty table gives an empty table.
    """
    wanted = [F.col(f"`{c}`") for c in columns or [id_col]]
    own = docs.select(*wanted, F.col(text_col).cast("string").alias("_scored_text"))
    return scored(own, model, "_scored_text", threshold).select(
        *[F.col(f"row.`{c}`") for c in columns or [id_col] if c not in ("quality_score", "predicted")], "quality_score", "predicted"
    )


def op1_quality_classifier(spark, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return score(docs, train(docs, labels)).select("doc_id", held_out("doc_id").alias("held_out"), F.col("quality_score").alias("score"), "predicted")
