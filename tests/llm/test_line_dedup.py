import random

from leafspan.llm import line_dedup

LONG = [f"line number {i} holds quite a few more words than the least" for i in range(30)]


def run(spark, rows, **kw):
    df = spark.createDataFrame(rows, "doc_id long, text string, n_lines int")
    return {r["doc_id"]: (r["text"], r["n_lines"], r["n_removed"]) for r in line_dedup.line_dedup(df, **kw).collect()}


def test_patience_is_a_common_subsequence():
    r = random.Random(1)
    for _ in range(200):
        a, b = ([r.randrange(8) for _ in range(r.randrange(12))] for _ in range(2))
        pairs = line_dedup.patience(a, b)
        assert all(a[i] == b[j] for i, j in pairs)
        assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:]))
    assert line_dedup.patience(list("abcde"), list("abXde")) == [(0, 0), (1, 1), (3, 3), (4, 4)]


def test_blocks_go_from_the_later_document(spark):
    a, b = "\n".join(["start", *LONG[:3], "end"]), "\n".join(["own words", "", LONG[0], "  " + LONG[1], LONG[2], "last"])
    got = run(spark, [(2, b, 0), (1, a, 0), (3, "nothing shared", 0)])
    assert got[1] == (a, 5, 0)
    assert got[2] == ("own words\n\nlast", 5, 3)
    assert got[3] == ("nothing shared", 1, 0)


def test_short_blocks_stay_and_moved_blocks_go(spark):
    a, b = "\n".join([LONG[0], "x", LONG[1]]), "\n".join([LONG[1], "y", LONG[0]])
    assert run(spark, [(1, a, 0), (2, b, 0)])[2] == ("y", 3, 2)
    assert run(spark, [(1, "a b c\nd", 0), (2, "a b c\ne", 0)])[2] == ("a b c\ne", 2, 0)


def test_copies_nulls_and_repeats(spark):
    text = "\n".join(LONG[:4])
    rows = [(1, text, 0), (2, text, 0), (3, None, 0), (4, "", 0), (5, "short", 0), (6, "short", 0)]
    got = run(spark, rows)
    assert got[1][0] == text and got[2] == ("", 4, 4)
    assert got[3] == (None, 0, 0) and got[4] == ("", 0, 0) and got[6] == ("short", 1, 0)
    df = spark.createDataFrame([(1, text), (1, text)], "doc_id long, text string")
    assert [r["text"] for r in line_dedup.line_dedup(df).collect()] == [text, text]
    assert line_dedup.line_dedup(df.limit(0)).collect() == []


def test_no_line_is_too_frequent(spark):
    rows = [(k, f"{LONG[0]}\nown line {k}", 0) for k in range(300)]
    got = run(spark, rows)
    assert got[0][0] == rows[0][1] and all(got[k][0] == f"own line {k}" for k in range(1, 300))


def all_pairs(texts, min_words=10):
    """Lines that go from each text if it is aligned with every earlier one."""
    lines = [[(n, x, len(x.split()), n) for n, x in enumerate(t.split("\n"))] for t in texts]
    return [sorted({n for other in lines[:k] for n in line_dedup.common_blocks(own, [x[:3] for x in other], min_words)}) for k, own in enumerate(lines)]


def test_blocks_of_short_lines_name_a_partner(spark):
    """A block is found although each of its lines, and parts of it, have earlier holders."""
    short = [f"verse {k} ends" for k in range(60)]
    texts = ["\n".join(short[:3]), "\n".join(short[3:6]), "\n".join(short[:6]), "\n".join(short[:6])]
    assert run(spark, [(k, t, 0) for k, t in enumerate(texts)])[3] == ("", 6, 6)
    texts[3] += "\nown"
    r = random.Random(3)
    for _ in range(40):
        own, left = [], list(range(60))
        while len(own) < 15:
            at, n = r.choice(left), r.randrange(1, 9)
            own += [k for k in range(at, min(60, at + n)) if k in left]
            left = [k for k in left if not at <= k < at + n]
        texts.append("\n".join(short[k] + " x" * (k % 7 == 0) * 9 for k in own))
    got = run(spark, [(k, t, 0) for k, t in enumerate(texts)])
    wanted = all_pairs(texts)
    assert wanted[3] == [0, 1, 2, 3, 4, 5]
    for k, t in enumerate(texts):
        assert got[k][0] == "\n".join(x for n, x in enumerate(t.split("\n")) if n not in wanted[k]), k
        assert got[k][2] == len(wanted[k])


def test_names_clash_with_nothing_and_long_texts_are_read_to_the_end(spark):
    names = ["_key", "_first", "_words", "_gone", "_n", "_copy", "row", "key", "id", "first", "words", "gone", "n", "copy", "lines"]
    body = "\n".join(f"filler {k} of a long text with words enough for a block of its own" for k in range(20_000))
    rows = [(1, body + "\n" + LONG[3], *names), (2, "own\n" + LONG[3], *names), (2, "own\n" + LONG[3], *names)]
    df = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"`{c}` string" for c in names))
    got = line_dedup.line_dedup(df)
    assert got.columns == [*df.columns, "n_lines", "n_removed"]
    got = sorted(tuple(r) for r in got.collect())
    assert got[0][:2] == (1, rows[0][1]) and got[1] == got[2] == (2, "own", *names, 2, 1)


def test_random_documents_against_all_pairs(spark):
    """Lines of any length, repeats, ties and shared blocks, aligned with every earlier text."""
    for seed in range(3):
        r = random.Random(seed)
        pool = [" ".join(f"w{r.randrange(50)}" for _ in range(r.choice([1, 2, 4, 12]))) for _ in range(30)]
        texts = []
        for _ in range(30):
            at = r.randrange(25)
            texts.append("\n".join([*(r.choice(pool) for _ in range(r.randrange(4))), *pool[at : at + r.randrange(6)], *(f"own {len(texts)} {k}" for k in range(r.randrange(3)))]))
        first = {}
        for k, t in enumerate(texts):
            first.setdefault(t, k)
        got = run(spark, [(k, t, 0) for k, t in enumerate(texts)])
        wanted = all_pairs(list(first))
        for t, k in first.items():
            lost = wanted[list(first).index(t)]
            kept = "\n".join(x for n, x in enumerate(t.split("\n")) if n not in lost)
            assert len(got[k][0].split("\n")) <= len(t.split("\n"))
            assert got[k][0] == kept, (seed, k)
