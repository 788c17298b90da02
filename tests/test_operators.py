"""Literal cases for the rules, and invariants of trees, coverage, mapping and edits."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from leafspan.functions import text as T
from leafspan.operators import audit, catalog, coverage, hierarchy, mapping, numbering, tables
from leafspan.sources import trees
from leafspan.streaming import streams

C = F.col


def values(spark, rule, *rows):
    df = spark.createDataFrame([(r,) for r in rows], "x string")
    return [r[0] for r in df.select(rule(C("x"))).collect()]


@pytest.mark.parametrize(
    ("rule", "given", "wanted"),
    [
        (T.estimate_tokens, "第一章abcdefgh", 1 + 2),
        (T.estimate_tokens, None, None),
        (T.clean_leaders, "Intro......12", "Intro: 12"),
        (T.normalise_chapter, "第 3 章 总则", "第3章 总则"),
        (T.strip_footers, "text Page 3 of 12 - 4 -", "text  "),
        (T.first_int, "p. 12-14", 12),
        (T.first_int, "none", None),
        (T.physical_index, "<physical_index_7>", 7),
        (T.physical_index, "12", 12),
        (T.physical_index, "x", None),
        (T.first_tag, "a<start_index_3>b<start_index_9>", 3),
        (T.first_tag, "a", -1),
        (T.drop_first_section, "a<physical_index_1>x<physical_index_2>b", "ab"),
        (T.title_key, " A b\tC", "abc"),
        (T.strip_numbering, "1.2 Scope", "Scope"),
        (T.is_chapter, "Chapter IV", True),
        (T.is_chapter, "Scope", False),
        (T.is_valid_title, "G.", True),
        (T.is_valid_title, "G. rest", False),
        (T.is_valid_title, "A.附录", True),
        (T.is_valid_title, "Name:", True),
        (T.is_valid_title, "Name  :", False),
        (T.is_valid_title, "地址：", False),
        (T.is_valid_title, "序号 项目 内容", False),
        (T.is_valid_title, "（一）适用，范围", True),
        (T.is_valid_title, "适用，范围", False),
        (T.is_valid_title, "　x　", False),
        (T.is_appendix, "附件 2：表", True),
        (T.is_appendix, "技术偏离表", True),
        (T.is_appendix, "Appendix A", False),
        (T.toc_score, "\nContents\n\n1. Introduction - 5\n2. Background - 12\n3. Methods - 25\n4. Results - 40\n5. Discussion - 55\n", 60),
        (T.is_valid_title, "Scope of work", True),
        (T.repaired_json, '{"table_of_contents": [{"t": "A}", "p": 1}, {"t": "B"', '{"table_of_contents": [{"t": "A}", "p": 1}]}'),
        (T.repaired_json, '{"a": 1, "b": "tru', '{"a": 1}'),
        (T.repaired_json, '{"a": {"b": [1, 2', '{"a": {"b": [1]}}'),
        (T.repaired_json, 'So: {"a": "x \\" ] } y", "b": [', '{"a": "x \\" ] } y", "b": []}'),
        (T.repaired_json, '[{"a": [{"b": 1}, {"c', "[]"),
        (T.repaired_json, '{"a": [1]} and more }', '{"a": [1]}'),
        (T.repaired_json, "{", "{}"),
        (T.repaired_json, "none", None),
        (T.repaired_json, "", None),
        (T.repaired_json, None, None),
        (T.numbering_system, "第三章 总则", "chapter"),
        (T.numbering_system, "附（二）表", "bracket"),
        (T.numbering_system, "12、报价", "number"),
        (T.numbering_system, "3.4 范围", "section"),
        (T.numbering_system, "De tion", None),
        (T.title_number, "第三章 总则", 3),
        (T.title_number, "二十一、报价", 21),
        (T.title_number, "第一百零五章 表", 105),
        (T.title_number, "（百）表", 100),
        (T.title_number, "3.14 范围", 14),
        (T.title_number, "Part", None),
        (T.strip_numbering, "第一章 概述", "概述"),
        (T.strip_numbering, "第二节 定义", "定义"),
        (T.strip_numbering, "（一）适用范围", "适用范围"),
        (T.strip_numbering, "一、总则", "总则"),
        (T.strip_numbering, "1. 投标须知", "投标须知"),
        (T.strip_numbering, "1、投标须知", "投标须知"),
        (T.strip_numbering, "1 投标须知", "投标须知"),
        (T.strip_numbering, "1.1 基本要求", "基本要求"),
        (T.strip_numbering, "1.1基本要求", "基本要求"),
        (T.strip_numbering, "b) scope", "scope"),
        (T.strip_numbering, "第三款 付款", "付款"),
        (T.strip_numbering, None, ""),
        (T.clean_title, "1 / 前言", "前言"),
        (T.clean_title, "（一）（试行）管理办法", "管理办法"),
        (T.clean_title, "第一章 总则", "总则"),
        (T.clean_title, "一、总", "一、总"),
        (T.clean_title, "1、", "1、"),
        (T.is_noise, "- 3 -", True),
        (T.is_noise, "温馨提示", True),
        (T.is_noise, "第 12 页", True),
        (T.is_noise, "项目编号：x : jjwl-1", True),
        (T.is_noise, "某采购项目", True),
        (T.is_noise, "", True),
        (T.is_noise, None, True),
        (T.is_noise, "一、总", True),
        (T.is_noise, "Page 12", False),
        (T.is_chapter, "CHAPTER 1", True),
        (T.is_chapter, "CHAPTER IV", True),
        (T.is_chapter, "chapter7", True),
        (T.is_chapter, "第2章", True),
        (T.is_chapter, "第三部分", True),
        (T.is_chapter, "10 / 招标公告", True),
        (T.is_chapter, "2 投标人须知", True),
        (T.is_chapter, "2投标人须知", False),
        (T.is_chapter, " Chapter 1", False),
        (T.is_fatal, "Connection error, retrying", False),
        (T.is_fatal, "403 items", False),
        (T.is_fatal, "Error code: 403", True),
        (T.is_fatal, "Rate limit exceeded", True),
        (T.is_fatal, "Forbidden", True),
        (T.is_fatal, "account suspended", True),
        (T.asks_for_list, "How many are there", True),
        (T.asks_for_list, "有多少项", True),
        (T.asks_for_list, "Which one", False),
        (T.asked_tool, "截止日期和预算", "extract_dates"),
        (T.asked_tool, "项目总价", "extract_budget"),
        (T.asked_tool, "加入时间线", "add_to_timeline"),
        (T.asked_tool, "budget?", None),
        (T.is_noise, "Scope", False),
        (T.answer_json, 'x\n```json\n[{"a": None,},]\n```', '[{"a": null}]'),
        (T.repaired_json, '[{"a": 1}, {"a"', '[{"a": 1}]'),
        (T.language, "总则 abc", "en"),
    ],
)
def test_text_rules(spark, rule, given, wanted):
    assert values(spark, rule, given) == [wanted]


def test_timeline_status(spark):
    rows = [("1997-01-01", None), ("1997-01-01", "1997-05-31"), ("1997-01-01", "1997-06-20"), ("1997-07-01", "1997-12-01"), ("1997-01-01", "1997-12-01")]
    df = spark.createDataFrame(rows, "s string, e string")
    got = df.select(T.timeline_status(C("s").cast("date"), C("e").cast("date"), F.lit(dt.date(1997, 6, 1)))).collect()
    assert [r[0] for r in got] == ["active", "expired", "expiring_soon", "future", "active"]


def test_structure_codes_skip_absent_levels(spark):
    df = spark.createDataFrame([(1, i, level) for i, level in enumerate([1, 3, 2, 3, 1, 2])], "doc_id long, list_index int, level int")
    got = hierarchy.structure_codes(df).orderBy("list_index").collect()
    assert [r["structure"] for r in got] == ["1", "1.1", "1.1", "1.1.1", "2", "2.1"]


def test_small_tree_end_pages(spark):
    starts = [(0, 1, 21), (1, 2, 24), (2, 2, 32), (3, 2, 52), (4, 2, 78), (5, 1, 87)]
    nodes = spark.createDataFrame([(1, *s) for s in starts], "doc_id long, pre int, depth int, start_page int")
    totals = spark.createDataFrame([(1, 200)], "doc_id long, total_pages int")
    got = hierarchy.end_pages(hierarchy.parents(nodes), totals, max_leaf=50).orderBy("pre").collect()
    assert [(r["start_page"], r["end_page"]) for r in got] == [(21, 86), (24, 32), (32, 52), (52, 78), (78, 86), (87, 200)]


def test_coverage_and_gaps_add_up(spark):
    leaves = spark.createDataFrame([(1, 1, 3), (1, 6, 7), (2, 1, 1)], "doc_id long, start_page int, end_page int")
    totals = spark.createDataFrame([(1, 10), (2, 1), (3, 2)], "doc_id long, total_pages int")
    lost = coverage.missing_pages(leaves, totals)
    assert {tuple(r) for r in coverage.gaps(lost).collect()} == {(1, 4, 5), (1, 8, 10), (3, 1, 2)}
    assert all(r["covered"] + r["missing"] == r["total_pages"] for r in coverage.coverage(leaves, totals).collect())
    assert [r["title"] for r in coverage.gap_nodes(coverage.gaps(lost), 3).collect()] == ["Pages 8-10"]


def test_chapters_repeat_and_appendices_move_down(spark):
    rows = [(1, "Chapter 1 A"), (2, "Scope of it"), (1, "Chapter 1 A"), (2, "Scope again"), (1, "附件1 X"), (1, "x")]
    df = spark.createDataFrame([(1, i, level, t, i) for i, (level, t) in enumerate(rows)], "doc_id long, pos int, level int, title string, page int")
    got = hierarchy.promote_chapters(df).orderBy("pos").collect()
    assert [(r["pos"], r["level"]) for r in got] == [(0, 1), (1, 2), (4, 2)]


def test_markdown_headings_ignore_fences(spark):
    lines = ["# One", "text", "```", "# no", "```", "## Two", "more"]
    df = spark.createDataFrame([(1, i, x) for i, x in enumerate(lines)], "doc_id long, line_num int, line string")
    heads = hierarchy.headings(df)
    assert [(r["level"], r["title"]) for r in heads.orderBy("line_num").collect()] == [(1, "One"), (2, "Two")]
    assert hierarchy.section_lines(df).orderBy("line_num").collect()[1]["text"] == "## Two\nmore"


def test_interpolation(spark):
    def filled(*pages):
        df = spark.createDataFrame([(1, i, p) for i, p in enumerate(pages)], "doc_id long, list_index int, physical int")
        return [r["filled"] for r in mapping.interpolate(df).orderBy("list_index").collect()]

    assert filled(10, None, None) == [10, 11, 12]
    a, b = filled(10, None, None, 20)[1:3]
    assert 10 < a < b < 20
    assert filled(None, None, 20)[:2] == [18, 19]


def test_relocate_within_bounds(spark):
    pages = spark.createDataFrame([(1, p, f"page {p} " + ("Target" if p in (2, 5) else "")) for p in range(1, 8)], "doc_id long, page_no int, text string")
    items = spark.createDataFrame([(1, 0, "Target", 3, 7), (1, 1, "Absent", 1, 7)], "doc_id long, list_index int, title string, prev_page int, next_page int")
    assert [r["fixed"] for r in mapping.relocate(items, pages).orderBy("list_index").collect()] == [5, None]


def test_deletes_take_subtrees(spark):
    nodes = spark.createDataFrame([(1, 0, 1), (1, 1, 2), (1, 2, 3), (1, 3, 2)], "doc_id long, pre int, depth int")
    ends = hierarchy.subtree_ends(nodes)
    assert [r["last_pre"] for r in ends.orderBy("pre").collect()] == [3, 2, 2, 3]
    assert sorted(r["pre"] for r in audit.apply_deletes(nodes, ends.where("pre = 1")).collect()) == [0, 3]


def test_conflicts(spark):
    df = spark.createDataFrame([(1, "a", "DELETE", "pending"), (1, "a", "MODIFY_PAGE", "pending"), (1, "b", "DELETE", "pending"), (1, "b", "MODIFY_PAGE", "rejected")], "doc_id long, node_id string, action string, status string")
    assert [r["node_id"] for r in audit.conflicts(df).collect()] == ["a"]


def test_latest_wins_keeps_what_is_not_given(spark):
    base = spark.createDataFrame([(1, "a", 1), (2, "b", 2)], "id int, title string, n int")
    changes = spark.createDataFrame([(1, "x", None, 1), (1, None, 9, 2), (3, "c", 3, 1)], "id int, title string, n int, at int")
    assert {tuple(r) for r in catalog.latest_wins(base, changes, "id", "at").collect()} == {(1, "x", 9), (2, "b", 2), (3, "c", 3)}


def test_best_match(spark):
    a = spark.createDataFrame([(1, 0, "the big plan"), (1, 1, "other")], "pair int, pre int, title string")
    b = spark.createDataFrame([(1, 0, "the big idea plan"), (1, 1, "The Big Plan "), (1, 2, "none")], "pair int, pre int, title string")
    assert [tuple(r) for r in catalog.best_matches(a, b).collect()] == [(1, 0, 1, 1.0)]


def test_trees_out_and_in(spark, tmp_path):
    path = tmp_path / "a.json"
    path.write_text('{"result": {"structure": [{"title": "A", "node_id": "1", "start_index": 1, "end_index": 4, "nodes": [{"title": "B", "id": "1.1", "ps": 2, "pe": 3}]}]}}')
    got = trees.read_trees(spark, str(path)).orderBy("depth").collect()
    assert [(r["path"], r["node_id"], r["start_page"], r["end_page"]) for r in got] == [([0], "1", 1, 4), ([0, 0], "1.1", 2, 3)]
    nodes = spark.createDataFrame([(1, 0, None, 1, "1", "A", 1, 4), (1, 1, 0, 2, "1.1", "B", 2, 3)], "doc_id long, pre int, parent_pos int, depth int, node_id string, title string, start_page int, end_page int")
    (row,) = trees.nested_trees(nodes).collect()
    import json

    assert json.loads(row["tree"])["children"][0]["children"][0]["id"] == "1.1"


def test_trees_are_read_in_one_pass(spark):
    """All layouts and depths as a walk gives them; levels beyond the depth go. No union of levels, each of which would read the input again."""
    import json
    import random

    r, want, values = random.Random(3), set(), []

    def grown(doc, path, kids):
        out = []
        for i in range(r.randrange(0, 4) if path else 3):
            here = [*path, i]
            names = r.choice([("node_id", "start_index", "end_index", "nodes"), ("id", "ps", "pe", "children"), ("id", "page_start", "page_end", "children")])
            if len(here) <= 3:
                want.add((doc, tuple(here), len(here), f"n{here}", f"t{here}", i, i + 1))
            node = {"title": f"t{here}", names[0]: f"n{here}", names[1]: i, names[2]: i + 1}
            if len(here) < 5 and (below := grown(doc, here, names[3])) or r.random() < 0.5:
                node[names[3]] = below if len(here) < 5 else None
            out.append(node)
        return out

    for doc, wrap in enumerate([lambda x: x, lambda x: {"structure": x}, lambda x: {"children": x}, lambda x: {"result": {"structure": x}}] * 3):
        values.append((doc, json.dumps(wrap(grown(doc, [], "nodes")))))
    values += [(90, "[]"), (91, "no tree"), (92, None), (93, '{"structure": null}')]
    got = trees.flat_trees(spark.createDataFrame(values, "d long, value string").repartition(2), "d", 3)
    rows = got.collect()
    assert {(x["d"], tuple(x["path"]), *x[2:]) for x in rows} == want and len(rows) == len(want)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" not in plan and plan.count("Generate") == 1


def test_streams_agree_with_batches(spark, tmp_path):
    rows = [(i, dt.datetime(2024, 1, 1, i // 4, i % 60), i % 3, "error" if i % 5 == 0 else "view") for i in range(40)]
    df = spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string")
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    got = streams.run_available(streams.latest_status(stream), "status", str(tmp_path / "c1"), "complete")
    assert {tuple(r) for r in got.collect()} == {tuple(r) for r in streams.latest_status(df).collect()}
    seen = streams.run_available(streams.progress(stream), "progress", str(tmp_path / "c2"))
    assert seen.count() == 40
    calls = lambda x: x.select(C("ts").alias("created_at"), C("event_type").alias("operation"), (C("event_type") != "error").alias("success"), F.lit(1).alias("tokens"), F.lit(1.0).alias("duration_ms"))
    timed = streams.run_available(streams.call_metrics(calls(stream)), "metrics", str(tmp_path / "c3"), "complete")
    assert {tuple(r) for r in timed.collect()} == {tuple(r) for r in streams.call_metrics(calls(df)).collect()}


def brute_ends(rows, total, max_leaf):
    """end pages of (pre, depth, start) by recursion over the tree, and where each subtree ends."""
    n = len(rows)
    up = [max((j for j in range(i) if rows[j][1] < rows[i][1]), default=None) for i in range(n)]
    kids = {i: [j for j in range(n) if up[j] == i] for i in [None, *range(n)]}
    ends = {}

    def walk(own, boundary):
        for k, i in enumerate(own):
            after = rows[own[k + 1]][2] if k + 1 < len(own) else None
            edge = after - 1 if after is not None else boundary
            if kids[i]:
                walk(kids[i], edge)
                ends[i] = max(ends[kids[i][-1]], rows[i][2])
            else:
                ends[i] = max(rows[i][2], after if after is not None else total if rows[i][1] == 1 else min(boundary, rows[i][2] + max_leaf - 1))

    walk(kids[None], total)
    last = [max([i, *(j for j in range(n) if i < j and all(rows[k][1] > rows[i][1] for k in range(i + 1, j + 1)))]) for i in range(n)]
    return [ends[i] for i in range(n)], last, up


def test_trees_of_any_depth_against_brute_force(spark):
    """Random trees down to depth 7: parents, ends, ids, paths, rollup, deletes and nested JSON."""
    import json
    import random

    r = random.Random(1)
    docs = {}
    for d in range(12):
        depth, page, rows = 0, 1, []
        for i in range(r.randrange(1, 40)):
            depth = r.randrange(1, min(depth + 1, 7) + 1)
            rows.append((i, depth, page))
            page += r.randrange(0, 4)
        docs[d] = (rows, page + 5)
    df = spark.createDataFrame([(d, *x, f"n{x[0]}", "t", total, x[0] + 1) for d, (rows, total) in docs.items() for x in rows], "doc_id long, pre int, depth int, start_page int, node_id string, title string, total_pages int, tokens int")
    tree = hierarchy.end_pages(hierarchy.parents(df.drop("node_id").withColumn("node_id", C("pre").cast("string"))), max_leaf=2)
    got = hierarchy.rollup(hierarchy.hierarchical_ids(hierarchy.paths(tree)))
    seen = {(x["doc_id"], x["pre"]): x for x in got.collect()}
    nested = {x["doc_id"]: json.loads(x["tree"]) for x in trees.nested_trees(tree).collect()}
    gone = {(x["doc_id"], x["pre"]) for x in audit.apply_deletes(tree, hierarchy.subtree_ends(tree).where("pre % 4 = 1")).collect()}
    for d, (rows, total) in docs.items():
        ends, last, up = brute_ends(rows, total, 2)
        left = []
        for i in range(len(rows)):
            x, path, at = seen[d, i], [i], i
            while up[at] is not None:
                at = up[at]
                path.insert(0, at)
            ranks = [sum(up[j] == up[k] for j in range(k + 1)) for k in path]
            assert (x["parent_pos"], x["end_page"], x["last_pre"], x["path"]) == (up[i], ends[i], last[i], [str(k) for k in path])
            assert x["id"] == ".".join(map(str, ranks)) and x["subtree"] == sum(range(i + 1, last[i] + 2))
            here = nested[d]
            for k in ranks:
                here = here["children"][k - 1]
            assert here["id"] == str(i) and here["pe"] == ends[i] and len(here.get("children", [])) == up.count(i)
            if not any(k % 4 == 1 for k in path):
                left.append((d, i))
        assert {g for g in gone if g[0] == d} == set(left)


def test_contents_pages_score_over_others(spark):
    leader = " " + "." * 20 + " "
    high = "Table of Contents\n" + "\n".join(f"Chapter {k}{leader}{k * 9}\n  {k}.1 Part{leader}{k * 9 + 1}" for k in range(1, 7))
    nested = "Contents\n" + "\n".join(f"{k}. Part{leader}{k}\n    {k}.1 Below{leader}{k + 1}" for k in range(1, 5))
    figures = "List of Figures\n" + "\n".join(f"Figure 1.{k}: Shape{leader}{k}" for k in range(4))
    plain = "It holds no\ntable of contents structure or page numbers.\n" * 3
    got = values(spark, T.toc_score, high, nested, figures, plain, "Abstract\n\nThis paper shows a way to learn, with uses in many fields of work.", "Contents\nChapter 1")
    assert got[0] >= 70 and got[1] >= 70 and got[2] < 70 and all(x < 50 for x in got[3:])


@pytest.mark.parametrize(
    ("title", "page", "least", "most"),
    [
        ("Introduction to Learning", "x Introduction to Learning\n\nmore", 100, 100),
        ("Data Collection Methods", "DATA COLLECTION METHODS\n\nWe did", 100, 100),
        ("Background and Motivation", "Background, and: Motivation!", 95, 95),
        ("Experimental Methodology", "Expermental Methodolgy\n\nWe designed", 80, 94),
        ("thequickbrownfox", "zzxthequickbrownfoxjumps", 100, 100),
        ("Quantum Computing Fundamentals", "Classical ideas\n\nThe past was other", 0, 0),
        ("!!", "??", 0, 0),
    ],
)
def test_title_confidence(spark, title, page, least, most):
    df = spark.createDataFrame([(title, page)], "t string, p string")
    assert least <= df.select(T.title_confidence(C("t"), C("p"))).first()[0] <= most


def test_title_confidence_is_exact(spark, monkeypatch):
    """The bit-parallel search against all windows by a table of distances; titles of one to three words of 64 bits, lanes of a few windows. An unlike page is not measured window by window."""
    import random

    import pandas as pd

    from leafspan.functions import nearest

    def distance(a, b):
        row = range(len(b) + 1)
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            row = new
        return row[-1]

    def brute(t, p):
        if t is None or p is None:
            return 0
        if t in p:
            return 100
        best = min(distance(p[i : i + len(t)], t) for i in range(max(1, len(p) - len(t) + 1)))
        return min(94, 100 * (len(t) - best) // len(t)) if best <= len(t) * 3 // 10 else 0

    r, rows = random.Random(5), [(None, "abc"), ("abcd", None), ("", "abc"), ("abcd", ""), (None, None)]
    for _ in range(150):
        letters = r.choice(["ab", "abcdefghijkl", "ab漢字𠀀é"])
        word = lambda n: "".join(r.choices(letters, k=n))  # noqa: B023, E731
        t, p = word(r.choice([1, 3, 4, 9, 20, 63, 64, 65, 130])), word(r.choice([0, 2, 30, 90]))
        like = list(t)
        for _ in range(r.randrange(len(t) // 3 + 2)):
            at = r.randrange(len(like) + 1)
            like[at : at + r.randrange(2)] = word(r.randrange(2))
        rows.append((t, p + "".join(like) + word(5) if r.random() < 0.7 else p))
    df = spark.createDataFrame(rows, "t string, p string").repartition(1)
    got = [tuple(x) for x in df.select("t", "p", T.title_confidence(C("t"), C("p"))).collect()]
    assert sorted(map(str, got)) == sorted(str((t, p, brute(t, p))) for t, p in rows) and len({x[2] for x in got}) > 10
    monkeypatch.setattr(nearest, "LANE", 3)
    few = pd.DataFrame([x for x in rows if x[0] and x[1]])
    assert [95 if x == 100 else x for x in map(brute, few[0], few[1])] == nearest.confidence(few[0], few[1]).tolist()

    measured, walk = [], nearest._walk
    monkeypatch.setattr(nearest, "_walk", lambda *a: (measured.append(len(a[2]) * a[5]), walk(*a))[1])
    page = "".join(r.choices("etaoinshrdlu", k=20_000))
    assert nearest.confidence(pd.Series(["quickjumpingfoxesvexbigwhiskyboxers", page[500:520] + "#" + page[521:540]]), pd.Series([page, page])).tolist() == [0, 94]
    assert sum(measured) < 10


def test_duplicates_shift_and_steps_back(spark):
    df = spark.createDataFrame([(1, i, p) for i, p in enumerate([10, 15, 15, 15, 20, None, 16])], "doc_id long, list_index int, physical int")
    assert {r["list_index"]: r["shifted"] for r in mapping.shift_duplicates(df).collect()} == {0: 10, 1: 15, 2: 16, 3: 17, 4: 20, 5: None, 6: 18}
    assert [tuple(r) for r in mapping.backward_steps(df).collect()] == [(1, 6, 20, 16)]


def test_restoring_keeps_what_was_current(spark):
    first = spark.createDataFrame([(1, 1, "a"), (1, 1, "b"), (2, 1, "c")], "doc_id long, version int, title string")
    edited = spark.createDataFrame([(1, "x"), (3, "new")], "doc_id long, title string")
    got = audit.restore(audit.snapshot(first, edited), spark.createDataFrame([(1, 1)], "doc_id long, version int"))
    assert sorted(map(tuple, got.collect())) == [(1, 1, "a"), (1, 1, "b"), (1, 2, "x"), (1, 3, "a"), (1, 3, "b"), (2, 1, "c"), (3, 1, "new")]


def test_rows_are_appended_by_bucket(spark, tmp_path):
    df = spark.createDataFrame([(1, None), (2, "done")], "doc_id long, status string")
    for _ in range(2):
        trees.append_rows(df, str(tmp_path / "t"))
    assert sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "t")).select("doc_id", "status").collect()) == [(1, "pending"), (1, "pending"), (2, "done"), (2, "done")]


def test_deep_titles_go_to_their_ancestor(spark):
    rows = [("d", p, u, n, f"t{p}") for p, (u, n) in enumerate([(None, 1), (0, 2), (1, 3), (2, 4), (3, 5), (1, 3), (0, 2), (None, 1), (7, 2), (8, 3)])]
    df = spark.createDataFrame(rows, "doc_id string, pre int, parent_pos int, depth int, title string")
    got = {r["pre"]: r["sub_items"] for r in hierarchy.merge_deep(df, 2).collect()}
    assert got == {0: [], 1: ["t2", "t3", "t4", "t5"], 6: [], 7: [], 8: ["t9"]}
    assert {r["pre"]: r["sub_items"] for r in hierarchy.merge_deep(df, 5).collect()} == {p: [] for p in range(10)}


def test_equal_first_children_are_promoted(spark):
    """Chapter 2 has itself as its first child, whose children move up; chapter 3 only itself, which goes; a chain goes as a whole."""
    rows = [("第一章 总则", 1, 1), ("范围", 2, 2), ("第二章供应商须知", 1, 4), ("第二章 供应商须知", 2, 4), ("说明", 3, 5), ("报价", 3, 7), ("附件", 2, 9), ("Ch 3", 1, 10), ("CH3", 2, 10), ("a", 1, 12), ("A", 2, 12), (" a ", 3, 12), ("leaf", 4, 13), (" ", 1, 14), ("", 2, 14)]
    df = hierarchy.parents(spark.createDataFrame([("d", k, t, n, p) for k, (t, n, p) in enumerate(rows)], "doc_id string, pre int, title string, depth int, start_page int"))
    totals = spark.createDataFrame([("d", 16)], "doc_id string, total_pages int")
    got = [(r["title"], r["node_id"], r["parent_pos"], r["depth"], r["end_page"]) for r in sorted(hierarchy.promote_equal_children(df, totals).collect(), key=lambda r: r["pre"])]
    assert got == [
        ("第一章 总则", "1", None, 1, 3), ("范围", "1.1", 0, 2, 3), ("第二章供应商须知", "2", None, 1, 9), ("说明", "2.1", 2, 2, 7), ("报价", "2.2", 2, 2, 9), ("附件", "2.3", 2, 2, 9),
        ("Ch 3", "3", None, 1, 12), ("a", "4", None, 1, 13), ("leaf", "4.1", 9, 2, 13), (" ", "5", None, 1, 15), ("", "5.1", 13, 2, 15),
    ]


def test_tables_become_markdown(spark):
    text = "intro\n| a | b\n|---|:--:|\n1|2|3\n\nx\n---|---\nlone | pipe"
    df = spark.createDataFrame([(1, text), (2, "no table\n"), (3, None), (4, ""), (5, "|\n" * 3000)], "doc_id int, text string")
    got = {r["doc_id"]: r["text"] for r in tables.with_markdown(df).collect()}
    assert got[1] == "intro\n[TABLE]\n| a | b |  |\n| --- | --- | --- |\n| 1 | 2 | 3 |\n[/TABLE]\n\nx\n[TABLE]\n| lone | pipe |\n| --- | --- |\n[/TABLE]"
    assert (got[2], got[3], got[4]) == ("no table\n", None, "") and got[5].count("\n") == 3003
    assert sorted(tuple(r)[:5] for r in tables.table_regions(df.where("doc_id = 1")).collect()) == [(1, 1, 3, 3, 2), (1, 6, 7, 2, 1)]


def test_nested_contents(spark):
    lines = lambda n, form: "\n".join(form.format(k) for k in range(n))
    pages = [(1, p, t) for p, t in enumerate(["", lines(12, "1.{0} One .... {0}"), lines(2, "1.{0} One .... {0}"), lines(3, " 第一章 总 .... {0} "), lines(3, "1.{0} One .... {0}") + "\n" + lines(3, "第一章 总 .... {0}"), "", None] + [lines(4, "2.{0} x .... {0}")] * 5)] + [(2, 1, lines(9, "1.{0} One .... {0}"))]
    learned = [(1, 0, "dots", r"^\d+(\.\d+)*\s+.+?\s*\.{3,}\s*\d+"), (1, 1, "bad", "(("), (1, 2, "chapter", r"^第(?P<n>[一二])章"), (1, 3, None, None)]
    got = tables.nested_contents(spark.createDataFrame(pages, "doc_id int, page_no int, text string"), spark.createDataFrame(learned, "doc_id int, position int, name string, regex string"), after_page=0)
    assert sorted(tuple(r) for r in got.collect()) == [(1, 1, ["dots"], 12, "high"), (1, 3, ["chapter"], 3, "low"), (1, 4, ["dots", "chapter"], 6, "medium"), (1, 7, ["dots"], 4, "low"), (1, 8, ["dots"], 4, "low")]


def test_first_run_of_contents(spark):
    flags = {1: [3, 4, 7], 2: [19, 20, 21, 22], 3: [25], 4: [1]}
    pages = spark.createDataFrame([(d, p, p in own) for d, own in flags.items() for p in range(1, 31)], "doc_id int, page_no int, toc boolean")
    assert {tuple(r) for r in tables.first_run(pages, C("toc")).collect()} == {(1, 3, 4), (2, 19, 22), (4, 1, 1)}
    assert {tuple(r) for r in tables.first_run(pages, C("toc"), beyond=False).collect()} == {(1, 3, 4), (2, 19, 20), (4, 1, 1)}


def test_numbering_holes(spark):
    titles = ["一、a", "二、b", "二、c", "五、d", "（三）e", "（一）f", "g", None, "1.2 h", "1.4 i"]
    df = spark.createDataFrame([("d", 0, t) for t in titles], "doc_id string, parent_pos int, title string")
    got = {r["system"]: (r["lo"], r["hi"], r["missing"], r["repeated"]) for r in numbering.numbering_holes(df).collect()}
    assert got == {"item": (1, 5, [3, 4], [2]), "bracket": (1, 3, [2], []), "section": (2, 4, [3], [])}


def test_quality_and_sample(spark):
    nodes = spark.createDataFrame([(1, k) for k in range(10)] + [(2, 0)], "doc_id int, pre int")
    done = spark.createDataFrame([(1, "DELETE")] * 7 + [(1, "MODIFY_PAGE")], "doc_id int, action string")
    got = {r["doc_id"]: tuple(r)[1:] for r in audit.quality(done, nodes, nodes.where("pre < 4 AND doc_id = 1")).collect()}
    assert got == {1: (85, 10, 4, 0.6), 2: (60, 1, 0, 1.0)}
    items = spark.range(4000).selectExpr("id", "id % 7 AS g", "id % 5 > 0 AS passed")
    took = [sorted(tuple(r) for r in mapping.sampled_accuracy(df, ["g"], ["id"], 25).collect()) for df in (items, items.repartition(7))]
    assert took[0] == took[1] and len(took[0]) == 7
    for _, n, accuracy, low, high in took[0]:
        assert 90 < n < 200 and low < accuracy < high and high - low < 0.2


def test_silence_is_told_when_the_timer_fires(spark, tmp_path):
    """Three files are three batches: a pause across batches, one within, one that only the timer sees, and none for who talked last."""
    at = lambda h, m=0: dt.datetime(2024, 1, 1, h, m)
    batches = [[(1, at(1)), (1, at(1, 20)), (2, at(1)), (3, at(1)), (None, at(1))], [(1, at(1, 40)), (2, at(2)), (2, at(2, 45)), (4, None)], [(1, at(9)), (5, at(8, 50))]]
    schema = "user_id long, ts timestamp"
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / f"in{k}"))
    (tmp_path / "in").mkdir()
    for k in range(3):
        (part,) = (tmp_path / f"in{k}").glob("part-*")
        part.rename(tmp_path / "in" / f"{k}.parquet")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = streams.run_to_table(streams.silences(stream, delay="10 minutes"), str(tmp_path / "out"))
    utc = lambda t: t.astimezone(dt.timezone.utc).replace(tzinfo=None) if t.tzinfo else t
    rows = sorted(((r["user_id"], utc(r["last_seen"]), r["silent_at"] - r["last_seen"]) for r in got.collect()), key=str)
    half = dt.timedelta(minutes=30)
    assert rows == sorted([(1, at(1, 40), half), (2, at(1), half), (2, at(2), half), (2, at(2, 45), half), (3, at(1), half), (None, at(1), half)], key=str)


def test_title_hits(spark):
    items = spark.createDataFrame([(1, 0, "alpha", 1, 3000), (1, 1, "alpha beta", 2, 2), (1, 2, "", 2, 3), (1, 3, None, 1, 9), (1, 4, "pha b", 1, 9), (2, 0, "alpha", 1, 2), (1, 5, "alpha", 2500, 2600), (1, 6, "x", 5, 4)], "doc_id int, list_index int, title string, lo int, hi int")
    pages = spark.createDataFrame([(1, 1, "alpha"), (1, 2, "an alpha beta, alpha"), (1, 3, None), (1, 4, ""), (1, 2500, "alpha"), (1, 2700, "alpha"), (3, 1, "alpha")], "doc_id int, page_no int, text string")
    got = {tuple(r) for r in mapping.title_hits(items, pages).collect()}
    assert got == {(1, 0, 1, 5), (1, 0, 2, 8), (1, 0, 2500, 5), (1, 0, 2700, 5), (1, 1, 2, 13), (1, 2, 2, 0), (1, 4, 2, 10), (1, 5, 2500, 5)}


def test_exact_parents_among_repeated_codes(spark):
    import random

    r = random.Random(3)
    rows = [(d, k, r.choice(["1", "2", "1.1", "1.2", "2.1", "1.1.1", "x.", "", None]), "e") for d in (1, 2) for k in range(60)]
    df = spark.createDataFrame(rows, "doc_id int, list_index int, structure string, parent_code string").repartition(3)
    got = {(x["doc_id"], x["list_index"]): x["parent_pos"] for x in hierarchy.exact_parents(df).collect()}
    for d, k, code, _ in rows:
        up = code.rsplit(".", 1)[0] if code and "." in code else None
        assert got[d, k] == max((i for e, i, c, _ in rows if e == d and i < k and c == up and up is not None), default=None)
