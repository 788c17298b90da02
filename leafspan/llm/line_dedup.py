"""Line de-duplication by pairwise alignment.

Documents meet through lines they share, and through the shortest runs of lines
that reach the least size of a block. A line or run that documents hold in common
names its earliest holder, and each later document is paired with these holders:
at most three pairs for a shared line, however many documents hold it, no line
is too frequent, and every line of a shared block has a partner with a whole
block around it. The two are aligned with patience diff:
lines found once in either, then what lies between. Runs of aligned lines are
deleted from the later document.

What moves is a digest (MD5, 128 bits), a position and a word count for each
shared line; texts move once, to meet the deletions. Equal texts are one text
until then. A text's lines go once to the task that aligns it with its holders.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .common import cut


def _rising(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest run of pairs that rises in both places; pairs are sorted by the first."""
    tops, ends, back = [], [], []
    for k, (_, b) in enumerate(pairs):
        at = bisect_left(tops, b)
        back.append(ends[at - 1] if at else -1)
        if at == len(tops):
            tops.append(b)
            ends.append(k)
        else:
            tops[at], ends[at] = b, k
    out, k = [], ends[-1] if ends else -1
    while k >= 0:
        out.append(pairs[k])
        k = back[k]
    return out[::-1]


def patience(a: list, b: list) -> list[tuple[int, int]]:
    """Aligned places (i, j) with a[i] == b[j], rising in both.

    Lines found once in either part are the anchors; the parts between them are
    aligned in turn. Where a part has no such line, its equal ends are aligned,
    and then the n-th copies of a line in either.
    """
    out, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        na, nb = Counter(a[a0:a1]), Counter(b[b0:b1])
        where = {b[j]: j for j in range(b0, b1) if nb[b[j]] == 1 == na.get(b[j])}
        found = _rising([(i, where[a[i]]) for i in range(a0, a1) if a[i] in where])
        if found:
            out += found
            for (i, j), (k, m) in zip([(a0 - 1, b0 - 1), *found], [*found, (a1, b1)], strict=True):
                todo.append((i + 1, k, j + 1, m))
            continue
        seen: Counter = Counter()
        places = {}
        for j in range(b0, b1):
            places[b[j], seen[b[j]]] = j
            seen[b[j]] += 1
        seen.clear()
        numbered = []
        for i in range(a0, a1):
            if (key := (a[i], seen[a[i]])) in places:
                numbered.append((i, places[key]))
            seen[a[i]] += 1
        out += _rising(numbered)
    return sorted(out)


def run_ends(lines: list[tuple], min_words: int) -> list[tuple[int, int]]:
    """(first, last) of the shortest runs of lines that reach min_words, one from each line on and one up to it.

    Lines are (number, hash, words), sorted; a run's numbers follow each other.
    Each line of any run that reaches min_words is in one of these within it.
    """
    start, total = 0, 0
    ends: list[tuple[int, int]] = []
    for k, (n, _, w, *_) in enumerate(lines):
        if k and n != lines[k - 1][0] + 1:
            start, total = k, 0
        total += w
        while start < k and total - lines[start][2] >= min_words:
            total -= lines[start][2]
            start += 1
        if total >= min_words:
            ends.append((start, k))
    total, last = 0, len(lines) - 1
    for k in range(len(lines) - 1, -1, -1):
        if k < len(lines) - 1 and lines[k][0] != lines[k + 1][0] - 1:
            last, total = k, 0
        total += lines[k][2]
        while last > k and total - lines[last][2] >= min_words:
            total -= lines[last][2]
            last -= 1
        if total >= min_words:
            ends.append((k, last))
    return ends


def runs(lines: list[tuple], min_words: int) -> set[int]:
    """Hashes of the runs of run_ends() that have two lines or more."""
    return {xxhash.xxh64_intdigest(b"".join(x[1] for x in lines[a : b + 1])) - (1 << 63) for a, b in run_ends(lines, min_words) if a < b}


def common_blocks(mine: list[tuple], other: list[tuple], min_words: int) -> list[int]:
    """Places of mine in aligned blocks of at least min_words words.

    Lines are (number, hash, words); those of mine end in their place in the
    text, blank lines included. A block is a run of lines whose numbers follow
    each other in either document. Lines that the alignment leaves out, because
    their block has changed places or a line has several copies, are in a block if
    one of their shortest runs is a run of the other: what is found is all that
    the two have in common, in time that grows with their lines.
    """
    out: set[int] = set()
    block: list[tuple[int, int]] = []
    for i, j in [*patience([x[1] for x in mine], [x[1] for x in other]), (-1, -1)]:
        if block and not (i >= 0 and mine[i][0] == mine[block[-1][0]][0] + 1 and other[j][0] == other[block[-1][1]][0] + 1):
            if sum(mine[k][2] for k, _ in block) >= min_words:
                out.update(k for k, _ in block)
            block = []
        block.append((i, j))
    if len(out) < len(mine):
        held = {tuple(x[1] for x in other[a : b + 1]) for a, b in run_ends(other, min_words)}
        for a, b in run_ends(mine, min_words):
            if tuple(x[1] for x in mine[a : b + 1]) in held:
                out.update(range(a, b + 1))
    return [mine[k][3] for k in sorted(out)]


def deletions(docs: DataFrame, id_col: str, text_col: str, min_words: int) -> tuple[DataFrame, DataFrame]:
    """(key, first, gone): per distinct text its earliest id and the numbers of the lines that earlier texts have."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    blank = F.lit("\x20\x09\x0b\x0c\x0d")
    rows = docs.select(F.col(id_col).alias("id"), F.md5(text).alias("key"), F.transform(F.split(text, "\n"), lambda x: F.btrim(x, blank)).alias("lines"))
    full = F.filter(
        F.transform("lines", lambda x, n: F.struct(F.when(x != "", n).alias("n"), F.unhex(F.md5(x)).alias("h"), (F.length(x) - F.length(F.replace(x, F.lit(" "), F.lit(""))) + 1).alias("w"))),
        lambda x: x["n"].isNotNull(),
    )
    # Blank lines don't count: numbers run over the others.
    numbered = F.transform(full, lambda x, k: F.struct(k.cast("int").alias("n"), x["n"].cast("int").alias("r"), x["h"].alias("h"), x["w"].cast("int").alias("w")))
    texts = cut(
        rows.select("id", "key", numbered.alias("lines"))
        .groupBy("key")
        .agg(F.min("id").alias("first"), F.any_value("lines").alias("lines"))
    )
    texts = texts.withColumn("rank", F.struct(F.col("first").isNull().alias("z"), "first", "key"))
    lines = texts.select("key", "rank", F.explode("lines").alias("l")).select("key", "rank", "l.*")
    # Written out, so that the join below has an exchange on either side and Spark can split a frequent line.
    holder = cut(lines.groupBy("h").agg(F.min("rank").alias("holder"), F.max("rank").alias("last")).where("holder <> last").select("h", "holder"))
    shared = cut(
        lines.join(holder, "h")
        .groupBy("key")
        .agg(F.first("rank").alias("rank"), F.sort_array(F.collect_list(F.struct("n", "r", "h", "w", F.col("holder.key").alias("holder")))).alias("shared"))
    )
    own = F.transform("shared", lambda x: F.struct(*[x[c].alias(c) for c in ("n", "r", "h", "w")]))
    partners = F.array_distinct(F.transform(F.filter("shared", lambda x: x["holder"] != F.col("key")), lambda x: x["holder"]))

    def run_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [sorted(runs([(x["n"], x["h"], x["w"]) for x in row], min_words)) for row in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(got, pa.list_(pa.int64()))], ["key", "rank", "runs"])

    # Lines that no other text has are in no shared run.
    thin = shared.select("key", "rank", F.transform("shared", lambda x: F.struct(x["n"].alias("n"), x["h"].alias("h"), x["w"].alias("w"))).alias("lines"))
    held_runs = cut(thin.mapInArrow(run_hashes, f"key string, rank {thin.schema['rank'].dataType.simpleString()}, runs array<bigint>").select("key", "rank", F.explode("runs").alias("run")))
    run_holder = cut(held_runs.groupBy("run").agg(F.min("rank").alias("holder"), F.max("rank").alias("last")).where("holder <> last").select("run", F.col("holder.key").alias("holder")))
    by_run = held_runs.select("key", "run").join(run_holder, "run").where("key <> holder").select("key", "holder")
    met = shared.select("key", F.explode(partners).alias("holder")).unionByName(by_run).distinct()
    held = shared.select(F.col("key").alias("holder"), own.alias("lines"))
    # A text's own lines come first, then those of its holders, so that neither is repeated for the other.
    rows = shared.select("key", F.lit(0).alias("turn"), own.alias("lines")).unionByName(met.join(held, "holder").select("key", F.lit(1).alias("turn"), "lines"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, mine = None, []
        for batch in batches:
            keys, gone = [], []
            for key, turn, lines in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                lines = [(x["n"], x["h"], x["w"], x["r"]) for x in lines.as_py()]
                if not turn:
                    at, mine = key, lines
                elif key == at and (got := common_blocks(mine, lines, min_words)):
                    keys.append(key)
                    gone.append(got)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(gone, pa.list_(pa.int32()))], ["key", "gone"])

    aligned = rows.repartition("key").sortWithinPartitions("key", "turn").mapInArrow(run, "key string, gone array<int>")
    gone = aligned.groupBy("key").agg(F.array_distinct(F.flatten(F.collect_list("gone"))).alias("gone"))
    return gone, texts.select("key", "first", F.aggregate("lines", F.lit(0), lambda a, x: a + x["w"]).alias("words"))


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = 10) -> DataFrame:
    """docs with text_col cleaned, and n_lines and n_removed (lines that aren't blank).

    Blocks of fewer than min_words words stay. The earlier of two documents is
    the one of the smaller id (null ids last; then the smaller MD5 of the
    text); a later copy of a whole text of min_words words or more becomes
    empty, an empty table stays empty. Rows that repeat both id and text are one
    document and are treated alike. Texts of which nothing is deleted stay as they are, nulls too; in
    others the deleted lines go, with their line breaks. Columns of docs called
    n_lines or n_removed give way.
    """
    names = docs.columns
    gone, texts = deletions(docs, id_col, text_col, min_words)
    # Written out, so that the join below is an exchange away from the grouping and Spark can split a frequent text.
    plan = cut(texts.join(gone, "key", "left").select("key", "first", "words", F.coalesce("gone", F.array().cast("array<int>")).alias("gone")))
    # All of a row is one struct meanwhile, so that names of docs clash with none of these.
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    df = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("id"), text.alias("text"), F.md5(text).alias("key")).join(plan, "key", "left")
    df = df.withColumn("copy", ~F.col("id").eqNullSafe(F.col("first")) & (F.col("words") >= min_words))
    split = F.split("text", "\n")
    full = lambda x: F.btrim(x, F.lit("\x20\x09\x0b\x0c\x0d")) != ""
    df = df.withColumn("n", F.size(F.filter(split, full)))
    walked = F.array_join(F.filter(split, lambda x, i: ~F.array_contains("gone", i)), "\n")
    cleaned = F.when(F.col("copy"), F.lit("")).when(F.size("gone") > 0, walked).otherwise(F.col(f"row.`{text_col}`"))
    return df.select(
        *[(cleaned if c == text_col else F.col(f"row.`{c}`")).alias(c) for c in names if c not in ("n_lines", "n_removed")],
        F.col("n").alias("n_lines"),
        F.when(F.col("copy"), F.col("n")).otherwise(F.size("gone")).alias("n_removed"),
    )


def op3_line_dedup(spark, sf_dir: str) -> DataFrame:
    """Every document with its text as it is after the deletions."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return line_dedup(docs).select("doc_id", "n_lines", "n_removed", "text")
