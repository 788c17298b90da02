"""Repair of conversations against a search over all edits."""

import hashlib
import random
import re
from functools import lru_cache

import pytest

from leafspan.llm import conversations as C

SPACE = " \t\n\v\f\r"
GOOD = re.compile(r"(s?(ua)+)?")


def faults(rows):
    out, seen = [], set()
    for _, role, text in rows:
        body = text.strip(SPACE)
        out.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def searched(rows):
    """(cost, audit, lines) by trying every edit; inserts go up to three in a row."""
    marks = faults(rows)

    @lru_cache(None)
    def rest(k, roles, run):
        """Least (cost, audit, lines) of rows from k on, given the first letters so far (at most the last two matter, and whether any are)."""
        ways = []
        if k == len(rows) and GOOD.fullmatch(roles):
            ways.append((0, "", ()))
        after = {"": "u", "s": "u"}.get(roles, "a" if roles.endswith("u") else "u")
        short = lambda x: x if len(x) < 3 else {"su": "u", "ua": "ua", "au": "u"}.get(x[-2:], x)
        name = {"u": "user", "a": "assistant"}
        if run < 3:
            c, a, t = rest(k, short(roles + after), run + 1)
            ways.append((c + 2, "I" + a, (f"{name[after]}:", *t)))
        if k < len(rows):
            _, role, text = rows[k]
            c, a, t = rest(k + 1, roles, 0)
            ways.append((c + 3, "D" + a, t))
            if marks[k] not in ("blank", "duplicate"):
                late = marks[k] == "truncated"
                c, a, t = rest(k + 1, short(roles + after), 0)
                ways.append((c + 2 + late, "R" + a, (f"{name[after]}:{text}", *t)))
                if role[:1] == after or role[:1] == "s" and not roles:
                    c, a, t = rest(k + 1, short(roles + role[:1]), 0)
                    ways.append((c + late, "K" + a, (f"{role}:{text}", *t)))
        return min(ways, default=(10**9, "", ()))

    return rest(0, "", 0)


def expected(rows):
    if not rows:
        return (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
    turns = {t for t, *_ in rows if t is not None}
    marks = faults(rows)
    cost, audit, lines = searched(tuple(rows))
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    return (max(turns) - min(turns) + 1 - len(turns) if turns else 0, *(marks.count(m) for m in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())


def made(seed, n, longest):
    r, out = random.Random(seed), {}
    for k in range(n):
        roles = r.choice(["uuaas", "ua", "s", "sx", "uu", "aa"])
        rows = [(None if r.random() < 0.05 else r.randrange(12) - 2, {"u": "user", "a": "assistant", "s": "system", "x": ""}[r.choice(roles)], r.choice(["Yes.", "no", " \n", "", "Why? ", "Größe!", "so ", "a b."] + [f"t{i}." for i in range(9)])) for _ in range(r.randrange(longest))]
        out[k if k else None] = rows
    return out


def table(spark, rows):
    flat = [(k, t, role, text, 1, 2) for k, own in rows.items() for t, role, text in own] + [(k, 3, None, None, 1, 2) for k in rows]
    random.Random(1).shuffle(flat)
    return spark.createDataFrame(flat, "conv_id long, turn long, role string, text string, key int, audit int").repartition(3)


@pytest.mark.parametrize(("seed", "limit", "longest"), [(1, 200_000, 12), (2, 3, 16), (3, 1, 9)])
def test_repair_against_every_edit(spark, seed, limit, longest):
    """With a small limit most conversations don't fit and are traced back from chunks."""
    rows = made(seed, 120, longest)
    got = {r["id"]: tuple(r)[1:] for r in C.repair(table(spark, rows), most_rows=limit).collect()}
    assert got.keys() == rows.keys()
    for k, own in rows.items():
        assert got[k] == expected(own), (k, own)


def test_long_conversations_and_texts(spark):
    long = [(t, "user" if t % 2 == 0 else "assistant", f"turn {t}.") for t in range(5001)]
    wide = [(0, "user", "x" * 3_000_000 + "."), (1, "assistant", "y.")]
    rows = {7: long, 8: wide, 9: [(t, "system", f"s {t}") for t in range(700)]}
    whole = {r["id"]: tuple(r)[1:] for r in C.repair(table(spark, rows)).collect()}
    parts = {r["id"]: tuple(r)[1:] for r in C.repair(table(spark, rows), most_rows=64, most_bytes=10_000).collect()}
    assert whole == parts
    assert whole[7][5:7] == (2, "K" * 5001 + "I") and whole[8][5:7] == (0, "KK")


def test_damage(spark):
    import zlib

    rows = [(c, t, "assistant", f"Is it {c}? Yes! {t}.") for c in range(40) for t in range(5)] + [(None, None, None, None)]
    got = {}
    for r in C.damaged(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect():
        got.setdefault((r["conv_id"], r["turn"]), []).append((r["role"], r["text"]))
    for c, t, role, text in rows:
        k = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        role, text = role or " ", text or " "
        want = {0: (None, None), 1: (role, ""), 2: (role, re.sub("[.!?]", "", text)), 4: ("user", text)}.get(k, (role, text))
        assert got[c, t] == [want] * (2 if k == 3 else 1)


def test_nothing(spark):
    assert C.repair(table(spark, {}).limit(0)).collect() == []
    (row,) = C.repair(table(spark, {4: []})).collect()
    assert tuple(row) == (4, *expected([]))
