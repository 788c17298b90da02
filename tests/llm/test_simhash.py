import random

import numpy as np
import pytest
import xxhash

from leafspan.llm import graph, simhash


def brute_fingerprint(text, k):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    grams = [b" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))]
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(fps, bits):
    group = list(range(len(fps)))

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= bits:
                group[root(i)] = root(j)
    return [root(i) for i in range(len(fps))]


@pytest.mark.parametrize("text", ["", None, "  \n", "one", "One two", "a b c d e", "Ünïcode WORDS stay\tas they\x0bare", "x " * 3000])
def test_fingerprint(text):
    assert simhash.fingerprint(text.encode() if text is not None else None, 3) == brute_fingerprint(text, 3)


@pytest.mark.parametrize("bits", [0, 1, 2, 3, 5])
def test_trie_finds_every_pair(bits):
    r = random.Random(bits)
    base = [r.getrandbits(64) for _ in range(60)]
    keys = {*base, *(b ^ (1 << r.randrange(64)) ^ (1 << r.randrange(64)) ^ (1 << r.randrange(64)) for b in base for _ in range(6))}
    own = np.array(sorted(keys), np.uint64)
    i, j = simhash.trie_pairs(own, np.zeros(len(own), np.int64), 0, bits)
    wanted = {(a, b) for a in range(len(own)) for b in range(a + 1, len(own)) if (int(own[a]) ^ int(own[b])).bit_count() <= bits}
    assert sorted(zip(i.tolist(), j.tolist())) == sorted(wanted)


@pytest.mark.parametrize(("bits", "hot"), [(2, 20_000), (2, 3), (3, 20_000), (3, 3)])
def test_components_match_brute_force(spark, bits, hot):
    r = random.Random(7)
    words = [f"w{i}" for i in range(400)]
    rows = []
    for g in range(25):
        text = [r.choice(words) for _ in range(80)]
        for _ in range(r.choice([1, 1, 4, 9])):
            own = list(text)
            if r.random() < 0.7:
                own[r.randrange(80)] = r.choice(words)
            rows.append((len(rows) * 3 + 1, " ".join(own)))
    rows += [(5000, ""), (5001, None), (5002, " "), (5003, "single"), (5004, "single"), (5004, "single"), (None, "single")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = simhash.near_duplicates(df, 3, bits, hot_block=hot).collect()
    fps = [brute_fingerprint(t, 3) for _, t in rows]
    groups = brute_components(fps, bits)
    lowest = {g: min(i for (i, _), h in zip(rows, groups) if h == g and i is not None) for g in groups}
    wanted = sorted((i if i is not None else -1, f if f < 1 << 63 else f - (1 << 64), lowest[g]) for (i, _), f, g in zip(rows, fps, groups))
    assert sorted((x["id"] if x["id"] is not None else -1, x["fp"], x["component_id"]) for x in got) == wanted


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_duplicates(df).collect() == []


def test_long_chains_are_one_component(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7), (None, 3)], "a long, b long")
    got = {r["node"]: r["component"] for r in graph.components(edges).collect()}
    assert got == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100}


@pytest.mark.parametrize("hot", [20_000, 4])
def test_similar_documents_meet(spark, hot):
    """Copies with a few words changed are one group, others alone, whether or not buckets are split."""
    r = random.Random(11)
    words = [f"w{i}" for i in range(3000)]
    rows = []
    for g in range(12):
        text = [r.choice(words) for _ in range(300)]
        for c in range(5):
            own = list(text)
            for _ in range(2 * (c > 0)):
                own[r.randrange(300)] = "new"
            rows.append((g * 10 + c, " ".join(own)))
    rows += [(900, ""), (901, None), (902, "one two"), (902, "one two"), (None, "one two")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = [(x["id"], x["component_id"]) for x in simhash.similar_documents(df, hot_block=hot).collect()]
    assert sorted(got, key=str) == sorted([(i, (i // 10 * 10 if i < 900 else 900 if i < 902 else 902) if i is not None else 902) for i, _ in rows], key=str)
    assert simhash.similar_documents(df.limit(0)).collect() == []


def test_trie_steps_are_bounded_and_whole():
    r = random.Random(4)
    base = r.getrandbits(64)
    keys = np.array(sorted({base ^ (1 << r.randrange(64)) ^ (1 << r.randrange(64)) ^ (1 << r.randrange(64)) for _ in range(400)}), np.uint64)
    group = np.zeros(len(keys), np.int64)
    steps = list(simhash.trie_steps(keys, group, 0, 10, width=50))
    found = {p for i, j in steps for p in zip(i.tolist(), j.tolist())}
    assert found == {(a, b) for a in range(len(keys)) for b in range(a + 1, len(keys))}
    assert max(len(i) for i, _ in steps) <= 50 * 16


def test_trie_drops_what_is_joined():
    """Pairs of nodes with one label throughout are not gone into; all others are."""
    r = random.Random(9)
    base = r.getrandbits(64)
    keys = np.array(sorted({base ^ sum(1 << b for b in r.sample(range(64), 3)) for _ in range(500)}), np.uint64)
    group = np.zeros(len(keys), np.int64)
    assert list(simhash.trie_steps(keys, group, 0, 10, root=group.copy())) == []
    root = np.arange(len(keys)) // 100
    found = {p for i, j in simhash.trie_steps(keys, group, 0, 10, root=root) for p in zip(i.tolist(), j.tolist())}
    assert {(a, b) for a in range(len(keys)) for b in range(a + 1, len(keys)) if root[a] != root[b]} <= found


def test_set_similarity():
    a, b = np.array([1, 2, 3, 4, 5], np.uint64), np.array([2, 3, 4, 5, 6], np.uint64)
    none = np.zeros(0, np.uint64)
    assert simhash.jaccard(a, b) == pytest.approx(4 / 6)
    assert (simhash.jaccard(a, a), simhash.jaccard(none, none), simhash.jaccard(a, none), simhash.jaccard(none, a)) == (1, 1, 0, 0)


@pytest.mark.parametrize(("hot", "shingles"), [(20_000, 4_000_000), (5, 400), (2, 60)])
def test_similar_documents_match_brute_force(spark, hot, shingles):
    """Texts on either side of a similarity of 0.8, among them equal sets with other repeats, against all pairs."""
    r = random.Random(5)
    words = [f"w{i}" for i in range(5000)]
    rows = []
    for g in range(40):
        text = [r.choice(words) for _ in range(r.choice([30, 120, 400]))]
        for c in range(6):
            own = list(text)
            for _ in range(c * len(text) // 110):
                own[r.randrange(len(own))] = r.choice(words)
            rows.append((len(rows), " ".join(own)))
    rows += [(900, "a b c d e a b c d e a b c d e"), (901, "a b c d e a b c d e a b c d e a b c d e"), (902, "zz"), (903, None)]
    sets = [set(simhash.shingle_hashes(t.encode() if t is not None else None, 5).tolist()) for _, t in rows]
    group = list(range(len(rows)))

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    near = 0
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                near += 0.8 <= len(sets[i] & sets[j]) / len(sets[i] | sets[j]) < 0.9
                group[max(root(i), root(j))] = min(root(i), root(j))
    assert near > 30
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {x["id"]: x["component_id"] for x in simhash.similar_documents(df, hot_block=hot, hot_shingles=shingles).collect()}
    assert got == {rows[i][0]: rows[root(i)][0] for i in range(len(rows))}


def test_similar_texts_of_null_and_repeated_ids(spark):
    """Rows of one id, or of none, are told apart by their texts; rows that repeat both are one."""
    base = [" ".join(f"w{k}x{j}" for j in range(60)) for k in range(6)]
    near = [b.replace("x30 ", "y30 ") for b in base]
    rows = [(None, t) for t in base] + [(7, t) for t in near] + [(7, near[0])] * 3 + [(None, base[1])] * 3 + [(8, None), (None, "")]
    got = simhash.similar_documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert len(got) == len(rows)
    assert sorted((r["component_id"] is None, r["component_id"]) for r in got) == [(False, 7)] * 18 + [(False, 8)] * 2
