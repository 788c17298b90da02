"""SimHash near-duplicates: fingerprints joined with themselves in a binary trie.

Two fingerprints that differ in at most ``max_bits`` bits agree in one of
``max_bits + 1`` blocks of bits. Every fingerprint is dealt out once a block,
rotated so that the block comes first: the block is the part of the trie where
the error budget is nought, and it is the shuffle key. Below it the trie is
traversed by pairs of nodes, level by level: each pair carries the bits that
differ so far, and is dropped once they exceed the budget.

Equal fingerprints are one leaf, so copies never meet as pairs. A task keeps a
spanning forest of the links it finds. A block value with more than
``hot_block`` distinct fingerprints isn't put into one task: those
fingerprints are linked through the values half the budget away, which two
fingerprints share exactly if they are near enough. That path is exact too.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .common import cut
from .graph import components

BITS = 64


def shingle_hashes(text: bytes | None, shingle: int) -> np.ndarray:
    """XXH64 (seed 42) of a text's word shingles, in order, repeats included.

    Words are split at ASCII white space after lower-casing A-Z. Fewer words
    than a shingle make one shingle; no words make none.
    """
    words = text.lower().split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    k = min(shingle, len(words))
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[: len(words) - k + 1]
    digest = xxhash.xxh64_intdigest
    spans = zip(starts.tolist(), ends[k - 1 :].tolist(), strict=True)
    return np.fromiter((digest(joined[a:b], 42) for a, b in spans), np.uint64, len(starts))


def simhash_of(hashes: np.ndarray) -> int:
    """The bits that over half of the hashes have; nought without hashes."""
    total = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at : at + (1 << 16)]
        total += np.unpackbits(part.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * total > len(hashes)).tobytes(), "big")


def fingerprint(text: bytes | None, shingle: int) -> int:
    """The 64-bit SimHash of a text in UTF-8, as an unsigned number."""
    return simhash_of(shingle_hashes(text, shingle))


def fingerprints(docs: DataFrame, shingle: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp BIGINT) of every row. A null or blank text has the fingerprint 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.binary())
            fps = np.array([fingerprint(t.as_py(), shingle) for t in texts], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps)], ["id", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"id {kind}, fp bigint")


def trie_steps(
    keys: np.ndarray, group: np.ndarray, first_bit: int, max_bits: int, width: int = 500_000, root: np.ndarray | None = None
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions (i, j), i < j, of the keys of a group that differ in at most max_bits bits, a step at a time.

    keys: distinct within a group, unsigned, sorted by (group, key), and equal
    within a group above first_bit. A node is a range of positions, a pair of
    nodes a row of the arrays below. A level of more than width pairs goes on
    in halves, one after the other, so memory is bounded however dense a group is.
    root: labels of what is joined already, which the caller may change in place
    between steps; a pair of nodes that have one label throughout is dropped.
    """
    cuts = np.flatnonzero(np.diff(group)) + 1
    lo, hi = np.concatenate(([0], cuts)), np.concatenate((cuts, [len(keys)]))
    big = hi - lo > 1
    stack = [(first_bit, (lo[big], hi[big], lo[big], hi[big], np.zeros(int(big.sum()), np.int8)))]
    while stack:
        bit, level = stack.pop()
        if root is not None and len(level[0]):
            turns = np.concatenate(([0], np.cumsum(root[1:] != root[:-1])))
            a_lo, a_hi, b_lo, b_hi, _ = level
            joined = (turns[a_lo] == turns[a_hi - 1]) & (turns[b_lo] == turns[b_hi - 1]) & (root[a_lo] == root[b_lo])
            level = tuple(x[~joined] for x in level)
        if not len(level[0]):
            continue
        if len(level[0]) > width:
            half = len(level[0]) // 2
            stack += [(bit, tuple(x[half:] for x in level)), (bit, tuple(x[:half] for x in level))]
            continue
        a_lo, a_hi, b_lo, b_hi, err = level
        small = (a_hi - a_lo) * (b_hi - b_lo) <= (16 if bit < BITS else np.iinfo(np.int64).max)
        if small.any():
            nb = (b_hi - b_lo)[small]
            n = (a_hi - a_lo)[small] * nb
            at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            i = np.repeat(a_lo[small], n) + at // np.repeat(nb, n)
            j = np.repeat(b_lo[small], n) + at % np.repeat(nb, n)
            near = (i < j) & (np.bitwise_count(keys[i] ^ keys[j]) <= max_bits)
            yield i[near], j[near]
            a_lo, a_hi, b_lo, b_hi, err = (x[~small] for x in level)
            if not len(a_lo):
                continue
        # Zeros come first in a node: a bit's count of zeros is where its children part.
        zeros = lambda x, y: _first_one(keys, x, y, bit)
        a_mid, b_mid = zeros(a_lo, a_hi), zeros(b_lo, b_hi)
        far = a_lo != b_lo
        level = tuple(
            np.concatenate(x)
            for x in (
                (a_lo, a_mid, a_lo, a_mid[far]),
                (a_mid, a_hi, a_mid, a_hi[far]),
                (b_lo, b_mid, b_mid, b_lo[far]),
                (b_mid, b_hi, b_hi, b_mid[far]),
                (err, err, err + 1, err[far] + 1),
            )
        )
        a_lo, a_hi, b_lo, b_hi, err = level
        live = (err <= max_bits) & (a_lo < a_hi) & (b_lo < b_hi) & ~((a_lo == b_lo) & (a_hi - a_lo < 2))
        stack.append((bit + 1, tuple(x[live] for x in level)))


def _first_one(keys: np.ndarray, lo: np.ndarray, hi: np.ndarray, bit: int) -> np.ndarray:
    """First position in each node whose key has the bit, by halving: a node's keys are sorted and equal above the bit."""
    lo, hi, shift = lo.copy(), hi.copy(), np.uint64(BITS - 1 - bit)
    while (lo < hi).any():
        mid = (lo + hi) // 2
        open_ = lo < hi
        one = ((keys[np.minimum(mid, len(keys) - 1)] >> shift) & np.uint64(1)).astype(bool)
        hi = np.where(open_ & one, mid, hi)
        lo = np.where(open_ & ~one, mid + 1, lo)
    return lo


def trie_pairs(keys: np.ndarray, group: np.ndarray, first_bit: int, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """All steps of trie_steps() at once."""
    steps = list(trie_steps(keys, group, first_bit, max_bits))
    if not steps:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    i, j = zip(*steps, strict=True)
    return np.concatenate(i), np.concatenate(j)


def forest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest position that each of n positions reaches through the pairs (i, j)."""
    label = np.arange(n)
    while len(i):
        low = np.minimum(label[i], label[j])
        before = label.copy()
        np.minimum.at(label, i, low)
        np.minimum.at(label, j, low)
        np.minimum.at(label, before[i], low)
        np.minimum.at(label, before[j], low)
        label = label[label]
        open_ = label[i] != label[j]
        i, j = i[open_], j[open_]
    while (label != label[label]).any():
        label = label[label]
    return label


def _rotated(fp, by: int):
    return fp if by == 0 else F.shiftleft(fp, by).bitwiseOR(F.shiftrightunsigned(fp, BITS - by))


def _trie_task(max_bits: int, starts: list[int], widths: list[int], chunk: int):
    def links(rot: np.ndarray, keys: np.ndarray) -> pa.RecordBatch:
        found_a, found_b = [], []
        for r in np.unique(rot):
            own = np.sort(keys[rot == r])
            block = own >> np.uint64(BITS - widths[r])
            i, j = trie_pairs(own, block, widths[r], max_bits)
            label = forest(len(own), i, j)
            moved = np.flatnonzero(label != np.arange(len(own)))
            by = np.uint64(starts[r])
            back = own if not by else (own >> by) | (own << np.uint64(BITS - int(by)))
            found_a.append(back[moved])
            found_b.append(back[label[moved]])
        a, b = (np.concatenate(x) if x else np.zeros(0, np.uint64) for x in (found_a, found_b))
        return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rots, blocks, keys, held = [], [], [], 0
        for batch in batches:  # sorted by (rot, block)
            rots.append(batch.column(0).to_numpy())
            blocks.append(batch.column(1).to_numpy())
            keys.append(batch.column(2).to_numpy().view(np.uint64))
            held += batch.num_rows
            if held < chunk:
                continue
            rot, block, key = map(np.concatenate, (rots, blocks, keys))
            last = (rot == rot[-1]) & (block == block[-1])  # may go on in the next batch
            yield links(rot[~last], key[~last])
            rots, blocks, keys = [rot[last]], [block[last]], [key[last]]
            held = int(last.sum())
        if held:
            yield links(np.concatenate(rots), np.concatenate(keys))

    return run


def _masks(radius: int) -> list[int]:
    """All 64-bit masks of at most radius bits, as signed numbers."""
    masks = {0}
    for _ in range(radius):
        masks |= {m ^ (1 << b) for m in masks for b in range(BITS)}
    return sorted(m - (1 << BITS) if m >> (BITS - 1) else m for m in masks)


def _hub_links(fps: DataFrame, max_bits: int) -> DataFrame:
    """Links through the values between two fingerprints: linear in the fingerprints."""
    masks = F.array(*[F.lit(m) for m in _masks((max_bits + 1) // 2)])
    hubs = fps.select("fp", F.explode(masks).alias("mask")).select("fp", F.col("fp").bitwiseXOR(F.col("mask")).alias("hub"))
    met = hubs.groupBy("hub").agg(F.sort_array(F.collect_set("fp")).alias("near")).where(F.size("near") > 1)
    if max_bits % 2 == 0:  # all that share a hub are near enough
        return met.select(F.explode("near").alias("a"), F.col("near")[0].alias("b")).where("a <> b")
    pairs = met.select(F.explode("near").alias("a"), "near").select("a", F.explode("near").alias("b"))
    return pairs.where((F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits))


def links(fps: DataFrame, max_bits: int = 3, hot_block: int = 20_000) -> DataFrame:
    """(a, b): links that connect exactly the distinct fingerprints that chains of near ones connect.

    fps: distinct column fp. Every link joins two fingerprints that a chain of
    steps of at most max_bits bits connects; not every such pair is a row.
    """
    n = max_bits + 1
    starts = [BITS * r // n for r in range(n + 1)]
    widths = [starts[r + 1] - starts[r] for r in range(n)]
    dealt = fps.select(
        F.explode(
            F.array(
                *[
                    F.struct(F.lit(r).alias("rot"), _rotated(F.col("fp"), starts[r]).alias("key"), F.shiftrightunsigned(_rotated(F.col("fp"), starts[r]), BITS - widths[r]).alias("block"))
                    for r in range(n)
                ]
            )
        ).alias("x"),
        "fp",
    ).select("x.rot", "x.block", "x.key", "fp")
    counts = dealt.groupBy("rot", "block").agg(F.count("*").alias("n"))
    hot = cut(counts.where(F.col("n") > hot_block).select("rot", "block"))
    calm, more = dealt, None
    if not hot.isEmpty():
        calm = dealt.join(hot, ["rot", "block"], "left_anti")
        more = _hub_links(dealt.join(hot, ["rot", "block"], "left_semi").select("fp").distinct(), max_bits)
    found = (
        calm.select("rot", "block", "key")
        .repartition("rot", "block")
        .sortWithinPartitions("rot", "block")
        .mapInArrow(_trie_task(max_bits, starts, widths, 200_000), "a bigint, b bigint")
    )
    return found if more is None else found.unionByName(more)


def near_duplicates(docs: DataFrame, shingle: int = 5, max_bits: int = 3, id_col: str = "doc_id", text_col: str = "text", hot_block: int = 20_000) -> DataFrame:
    """(id, fp BIGINT, component_id) of every row of docs.

    component_id is the smallest id that links reach, the row's own included;
    nulls don't count, so it is null only where the whole component has null
    ids. Rows with a null or blank text share the fingerprint 0. Repeated rows
    stay, in the component of the first. An empty table gives an empty table.
    """
    fps = cut(fingerprints(docs, shingle, id_col, text_col))
    return _grouped(fps, links(fps.select("fp").distinct(), max_bits, hot_block))


def _grouped(rows: DataFrame, edges: DataFrame, key: str = "fp") -> DataFrame:
    """rows (id, fp and the key) with component_id, the smallest id that edges between keys reach."""
    leaves = rows.groupBy(key).agg(F.min("id").alias("first"))
    joined = components(edges)
    rooted = leaves.join(joined.withColumnRenamed("node", key), key, "left")
    linked = rooted.where(F.col("component").isNotNull())
    low = linked.groupBy("component").agg(F.min("first").alias("low"))
    named = (
        linked.join(low, "component")
        .select(key, F.col("low").alias("component_id"))
        .unionByName(rooted.where(F.col("component").isNull()).select(key, F.col("first").alias("component_id")))
    )
    return rows.join(named, key, "left").select("id", "fp", "component_id")


def _multipliers(n: int) -> np.ndarray:
    """Odd multipliers that turn one hash of a shingle into several, by a rule (SplitMix64)."""
    out, state, full = [], 0, (1 << 64) - 1
    for _ in range(n):
        state = (state + 0x9E3779B97F4A7C15) & full
        z = ((state ^ (state >> 30)) * 0xBF58476D1CE4E5B9) & full
        z = ((z ^ (z >> 27)) * 0x94D049BB133111EB) & full
        out.append((z ^ (z >> 31)) | 1)
    return np.array(out, np.uint64)


def band_keys(hashes: np.ndarray, bands: int, rows: int) -> list[int]:
    """A key per band: the first shingles of a text under so many orders each, as a signed number; of no shingles, of the band alone."""
    least = np.full(bands * rows, np.iinfo(np.uint64).max, np.uint64)
    by = _multipliers(bands * rows)[:, None]
    for at in range(0, len(hashes), 4096):
        mixed = hashes[None, at : at + 4096] * by
        mixed ^= mixed >> np.uint64(31)
        least = np.minimum(least, mixed.min(axis=1))
    least = least.reshape(bands, rows)
    return [xxhash.xxh64_intdigest(least[k].tobytes(), k) - (1 << 63) for k in range(bands)]


def set_key(shingles: np.ndarray) -> bytes:
    """128 bits that tell sets of shingles, sorted and without repeats, apart."""
    return xxhash.xxh3_128_digest(shingles.tobytes())


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Similarity of two sets, sorted and without repeats; 1 for two empty ones."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    at = np.minimum(np.searchsorted(b, a), len(b) - 1)
    both = int((b[at] == a).sum())
    return both / (len(a) + len(b) - both)


def _whole_groups(batches: Iterator[pa.RecordBatch], keys: int, most: int, size) -> Iterator[tuple[np.ndarray, pa.Table]]:
    """Rows sorted by their first columns, in tables that hold whole groups: (number of each row's group, table)."""

    def numbered(table: pa.Table) -> np.ndarray:
        columns = [table.column(k).to_numpy() for k in range(keys)]
        new = np.any([c[1:] != c[:-1] for c in columns], axis=0) if table.num_rows > 1 else np.zeros(0, bool)
        return np.concatenate(([0], np.cumsum(new)))

    held, total = [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        total += size(batch)
        if total < most:
            continue
        table = pa.Table.from_batches(held).combine_chunks()
        group = numbered(table)
        last = int(np.searchsorted(group, group[-1]))  # the last group may go on in the next batch
        if last:
            yield group[:last], table.slice(0, last)
        held = table.slice(last).to_batches()
        total = sum(size(x) for x in held)
    if held:
        table = pa.Table.from_batches(held).combine_chunks()
        yield numbered(table), table


def _candidate_task(max_bits: int, most: int = 100_000):
    """A spanning forest of the near fingerprints within buckets, from rows (bucket, part_a, part_b, fp, key) sorted by the first three."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group, table in _whole_groups(batches, 3, most, lambda b: b.num_rows):
            fps = table.column(3).to_numpy().view(np.uint64)
            order = np.lexsort((fps, group))
            fps, group = fps[order], group[order]
            new = np.diff(group, prepend=-1) != 0
            first = np.flatnonzero(new)[np.cumsum(new) - 1]
            # What is near the first of its bucket is joined at once: a bucket of near copies takes no pairs.
            root = np.where(np.bitwise_count(fps ^ fps[first]) <= max_bits, first, np.arange(len(fps)))
            for i, j in trie_steps(fps, group, 0, max_bits, root=root):
                apart = root[i] != root[j]
                if apart.any():
                    root[:] = forest(len(fps), root[i[apart]], root[j[apart]])[root]
            moved = np.flatnonzero(root != np.arange(len(fps)))
            names = table.column(4)
            yield pa.RecordBatch.from_arrays([names.take(pa.array(order[x])).combine_chunks() for x in (moved, root[moved])], ["a", "b"])

    return run


def similar_links(fps: np.ndarray, sets: list[np.ndarray], max_bits: int, similarity: float, part: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Links (i, j) that connect what chains of similar sets connect, among those whose fingerprints differ in at most max_bits bits.

    All are compared with the first. The trie names the other pairs; those that
    links found so far already join aren't looked at again, all others are
    compared in full. With part, only pairs of different parts count beyond the
    first.
    """
    order = np.argsort(fps, kind="stable")
    keys, size = fps[order], np.array([len(x) for x in sets], np.int64)[order]
    least = similarity * np.maximum(size, size[0])
    like = np.array([jaccard(sets[order[0]], sets[x]) >= similarity if k and ok else False for k, (x, ok) in enumerate(zip(order, np.minimum(size, size[0]) >= least, strict=True))], bool)
    root = np.where(like, 0, np.arange(len(fps)))
    out_a, out_b = [order[like]], [np.repeat(order[:1], int(like.sum()))]
    for i, j in trie_steps(keys, np.zeros(len(keys), np.int64), 0, max_bits, root=root):
        near = np.minimum(size[i], size[j]) >= similarity * np.maximum(size[i], size[j])
        if part is not None:
            near &= part[order[i]] != part[order[j]]
        i, j = i[near], j[near]
        while len(i):
            apart = root[i] != root[j]
            i, j = i[apart], j[apart]
            _, first = np.unique(i, return_index=True)  # a pair for each text at a time
            like = np.array([jaccard(sets[order[x]], sets[order[y]]) >= similarity for x, y in zip(i[first], j[first], strict=True)], bool)
            won = first[like] if len(first) else first
            out_a.append(order[i[won]])
            out_b.append(order[j[won]])
            root[:] = forest(len(root), root[i[won]], root[j[won]])[root]
            i, j = np.delete(i, first), np.delete(j, first)
    return np.concatenate(out_a), np.concatenate(out_b)


def _confirm_task(max_bits: int, similarity: float, most: int = 1 << 25):
    """Links between similar texts, from rows (group, part_a, part_b, own, key, fp, shingles) sorted by the first three."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group, table in _whole_groups(batches, 3, most, lambda b: b.nbytes):
            table = table.combine_chunks()
            fps, own = table.column(5).to_numpy().view(np.uint64), table.column(3).to_numpy()
            mixed = table.column(1).to_numpy() != table.column(2).to_numpy()
            lists = table.column(6).combine_chunks()
            flat, at = lists.flatten().to_numpy().view(np.uint64), np.concatenate(([0], np.cumsum(lists.value_lengths().to_numpy())))
            starts = np.concatenate((np.flatnonzero(np.diff(group, prepend=-1)), [len(group)]))
            found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
            for lo, hi in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
                sets = [flat[at[k] : at[k + 1]] for k in range(lo, hi)]
                i, j = similar_links(fps[lo:hi], sets, max_bits, similarity, own[lo:hi] if mixed[lo] else None)
                found.append((i + lo, j + lo))
            i, j = (np.concatenate(x) for x in zip(*found, strict=True))
            names = table.column(4)
            yield pa.RecordBatch.from_arrays([names.take(pa.array(x)).combine_chunks() for x in (i, j)], ["a", "b"])

    return run


def _led_task(similarity: float):
    """Links of a component's texts to its leader, from rows (component, part, other, key, shingles) sorted by the first three; the leader comes first in each part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lead = np.zeros(0, np.uint64)
        for batch in batches:
            like = []
            for k, (other, shingles) in enumerate(zip(batch.column(2).to_pylist(), batch.column(4), strict=True)):
                own = shingles.values.to_numpy().view(np.uint64)
                if not other:
                    lead = own
                elif min(len(own), len(lead)) >= similarity * max(len(own), len(lead)) and jaccard(own, lead) >= similarity:
                    like.append(k)
            at = pa.array(like, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(3).take(at), batch.column(0).take(at)], ["a", "b"])

    return run


def _led_links(hot: DataFrame, limit: int, similarity: float) -> DataFrame:
    """(a, b): texts of hot (component, key, shingles, n) that are similar to their component's leader, which is the text whose key names it."""
    other = F.col("key") != F.col("component")
    parts = F.ceil(F.col("n") / limit).cast("int")
    own = F.pmod(F.xxhash64("key"), parts).cast("int")
    dealt = hot.select("component", F.explode(F.when(other, F.array(own)).otherwise(F.sequence(F.lit(0), parts - 1))).alias("part"), other.alias("other"), "key", "shingles")
    return dealt.repartition("component", "part").sortWithinPartitions("component", "part", "other").mapInArrow(_led_task(similarity), "a binary, b binary")


def _met(rows: DataFrame, hot: DataFrame | None, group: str, key: str, limit: int) -> DataFrame:
    """Rows of groups for one task each, and those of hot groups in parts that meet two by two, sorted by (group, part_a, part_b).

    hot has the columns of rows and weight and led. What is led is joined to its
    group's leader already and meets only what isn't: a group grows with its
    rows times those that its leader hasn't, not with its square.
    """
    met = rows.select("*", *[F.lit(0).alias(c) for c in ("own", "part_a", "part_b")])
    if hot is not None:
        parts = lambda led: F.ceil(F.coalesce(F.sum(F.when(F.col("led") == led, F.col("weight"))), F.lit(0)) / limit).cast("int")
        counted = hot.join(hot.groupBy(group).agg(parts(False).alias("_free"), parts(True).alias("_led")).where("_free > 0"), group)
        own = F.when(F.col("led"), F.col("_free") + F.pmod(F.xxhash64(key), F.greatest("_led", F.lit(1)))).otherwise(F.pmod(F.xxhash64(key), F.col("_free"))).cast("int")
        last = F.when(F.col("led"), F.col("_free")).otherwise(F.col("_free") + F.col("_led")) - 1
        dealt = counted.withColumn("own", own).withColumn("_other", F.explode(F.sequence(F.lit(0), last)))
        met = met.unionByName(dealt.select(*rows.columns, "own", F.least("own", "_other").alias("part_a"), F.greatest("own", "_other").alias("part_b")))
    return met.repartition(group, "part_a", "part_b").sortWithinPartitions(group, "part_a", "part_b")


def similar_documents(
    docs: DataFrame, shingle: int = 5, similarity: float = 0.8, max_bits: int = 20, bands: int = 12, rows: int = 3,
    id_col: str = "doc_id", text_col: str = "text", hot_block: int = 20_000, hot_shingles: int = 4_000_000,
) -> DataFrame:
    """(id, fp BIGINT, component_id): components of texts whose sets of shingles have a Jaccard similarity of at least ``similarity``.

    Five-word SimHashes of texts of similarity 0.8 differ in about 10 of 64
    bits: too many for blocks of bits as keys. So fingerprints meet in buckets, by the
    first shingles under ``rows`` orders, ``bands`` times over; two texts of
    similarity s share none with a chance of (1 - s**rows)**bands, 0.0002 at 0.8.
    A trie join within the bucket, with a budget of max_bits, names the
    candidates, and a second one within each component of candidates the pairs
    whose whole sets are compared: no link stands on an estimate.

    Texts with equal sets are one from the start. In a bucket of more than
    hot_block texts, or a component of more than hot_shingles shingles, all are
    compared with one leader; those that it doesn't join meet all others, split
    by hash, every two parts in a task of their own: nothing is left out.

    component_id is the smallest id of the component (nulls only where it has no
    other). Texts without words are alike; repeated rows stay; an empty table
    gives an empty table.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps, sets, keys = [], [], []
            for t in batch.column(1).cast(pa.binary()):
                h = shingle_hashes(t.as_py(), shingle)
                own = np.unique(h)
                fps.append(simhash_of(h))
                sets.append(set_key(own))
                keys.append(band_keys(own, bands, rows))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(fps, np.uint64).view(np.int64)), pa.array(sets, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], ["id", "fp", "key", "buckets"])

    sketches = cut(texts.mapInArrow(sketch, f"id {kind}, fp bigint, key binary, buckets array<bigint>"))
    one_each = cut(sketches.groupBy("key").agg(F.min("id").alias("id"), F.min("fp").alias("fp"), F.first("buckets").alias("buckets")))
    dealt = one_each.select("key", "fp", F.explode("buckets").alias("bucket"))
    sizes = cut(dealt.groupBy("bucket").agg(F.count("*").alias("n"), F.min("fp").alias("lead")).where("n > 1"))
    met, hot, led = dealt.join(sizes.where(F.col("n") <= hot_block).select("bucket"), "bucket"), None, None
    large = sizes.where(F.col("n") > hot_block)
    if not large.isEmpty():
        near = F.bit_count(F.col("fp").bitwiseXOR(F.col("lead"))) <= max_bits
        hot = cut(dealt.join(large, "bucket").select("bucket", "key", "fp", F.lit(1).alias("weight"), near.alias("led"), (F.col("fp") == F.col("lead")).alias("leads")))
        leaders = hot.where("leads").groupBy("bucket").agg(F.min("key").alias("b"))
        led = hot.where("led").join(leaders, "bucket").select(F.col("key").alias("a"), "b")
    found = _met(met.select("bucket", "key", "fp"), hot, "bucket", "key", hot_block).select("bucket", "part_a", "part_b", "fp", "key").mapInArrow(_candidate_task(max_bits), "a binary, b binary")
    candidates = components(found if led is None else found.unionByName(led))

    def shingles_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [np.unique(shingle_hashes(t.as_py(), shingle)) for t in batch.column(3).cast(pa.binary())]
            same = [k for k, x in enumerate(sets) if set_key(x) == batch.column(1)[k].as_py()]  # other texts of the same id drop out
            part = batch.take(pa.array(same, pa.int64()))
            ends = np.concatenate(([0], np.cumsum([len(sets[k]) for k in same]))).astype(np.int32)
            flat = np.concatenate([sets[k] for k in same]) if same else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.ListArray.from_arrays(pa.array(ends), pa.array(flat.view(np.int64)))], ["component", "key", "fp", "shingles"])

    wanted = one_each.select(F.col("id").alias("_id"), "key", "fp").join(candidates.withColumnRenamed("node", "key"), "key")
    known = texts.join(wanted, F.col("id").eqNullSafe(F.col("_id"))).select("component", "key", "fp", "text")
    sets = cut(known.mapInArrow(shingles_of, "component binary, key binary, fp bigint, shingles array<bigint>"))
    large = cut(sets.groupBy("component").agg(F.sum(F.size("shingles")).alias("n")).where(F.col("n") > hot_shingles))
    calm, hot, led = sets, None, None
    if not large.isEmpty():
        calm = sets.join(large, "component", "left_anti")
        known = sets.join(large, "component")
        led = cut(_led_links(known, hot_shingles, similarity))
        joined = led.select(F.col("a").alias("key"), F.lit(True).alias("_joined")).distinct()
        hot = known.join(joined, "key", "left").withColumn("weight", F.size("shingles")).withColumn("led", F.col("_joined").isNotNull() | (F.col("key") == F.col("component")))
    pairs = _met(calm, hot, "component", "key", hot_shingles)
    edges = pairs.select("component", "part_a", "part_b", "own", "key", "fp", "shingles").mapInArrow(_confirm_task(max_bits, similarity), "a binary, b binary")
    edges = edges if led is None else edges.unionByName(led)
    return _grouped(sketches.select("id", "fp", "key"), edges, "key")


def op5_simhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return near_duplicates(docs, shingle=3, max_bits=2).select(
        F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )
