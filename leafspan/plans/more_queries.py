"""Further queries over trees, answers, pages and versions, each with its SQL where SQL can say it."""

from __future__ import annotations

import re
import string

from pyspark.sql import DataFrame, Window as W, functions as F

from leafspan.functions import text as T
from leafspan.operators import audit as A, coverage as G, hierarchy as H
from leafspan.plans import derive as D
from leafspan.plans.derive import sql
from leafspan.plans.text_queries import _answers, answers, cut_items
from leafspan.plans.tree_queries import GAPS, GROUPED, J1, LEAVES, NODE_TEXT, SCORE, SUB, leaves, rolled, tsql, validated

C = F.col
QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, text: str | None):
    def add(f):
        QUERIES[name] = f
        if text:
            SQL[name] = text
        return f

    return add


@query("b40_oversized_nodes", tsql(NODE_TEXT, "SELECT doc_id, pre, tokens FROM node_text WHERE tokens > 300", "nodes", "doc_pages"))
def b40(spark, d) -> DataFrame:
    return H.node_text(D.nodes(spark, d), D.doc_pages(spark, d)).where("tokens > 300").select("doc_id", "pre", "tokens")


@query("b41_summaries", tsql(LEAVES, """SELECT n.doc_id, n.pre, CASE WHEN p.tokens < 200 THEN p.text ELSE 'summary of ' || n.node_id END AS summary, l.pre IS NOT NULL AS is_leaf FROM nodes n
    JOIN doc_pages p ON p.doc_id = n.doc_id AND p.page_no = n.start_page LEFT JOIN leaves l ON l.doc_id = n.doc_id AND l.pre = n.pre""", "nodes", "doc_pages"))
def b41(spark, d):
    p = D.doc_pages(spark, d).select("doc_id", C("page_no").alias("start_page"), "text", "tokens")
    answers = D.nodes(spark, d).select("doc_id", "pre", F.concat(F.lit("summary of "), C("node_id")).alias("answer"))
    n = D.nodes(spark, d).withColumn("is_leaf", H.is_leaf()).join(p, ["doc_id", "start_page"]).join(answers, ["doc_id", "pre"], "left")
    return n.select("doc_id", "pre", F.when(C("tokens") < 200, C("text")).otherwise(C("answer")).alias("summary"), "is_leaf")


@query("w11_flatten_codes", sql("SELECT doc_id, pre, list_transform(string_split(node_id, '.'), lambda x: CAST(x AS INT)) AS path FROM nodes", "nodes"))
def w11(spark, d):
    return D.nodes(spark, d).select("doc_id", "pre", T.code_key(C("node_id")).alias("path"))


THIN = SUB + """, rolled AS (SELECT s.doc_id, s.pre, any_value(s.last_pre) AS last_pre, sum(p.tokens) AS tokens FROM sub s JOIN nodes k ON k.doc_id = s.doc_id AND k.pre BETWEEN s.pre AND s.last_pre
    JOIN doc_pages p ON p.doc_id = k.doc_id AND p.page_no = k.start_page GROUP BY ALL)"""


@query("w17_tree_thinning", tsql(THIN, """SELECT n.doc_id, n.pre, tokens FROM rolled n WHERE NOT EXISTS (SELECT 1 FROM rolled a WHERE a.doc_id = n.doc_id AND a.tokens < 150 AND n.pre > a.pre AND n.pre <= a.last_pre)""", "nodes", "doc_pages"))
def w17(spark, d):
    """Nodes whose subtree has too few tokens swallow what is below them; a running maximum finds what goes."""
    order = W.partitionBy("doc_id").orderBy("pre").rowsBetween(W.unboundedPreceding, -1)
    until = F.max(F.when(C("subtree") < 150, C("last_pre"))).over(order)
    return rolled(spark, d).withColumn("until", until).where("until is null OR pre > until").select("doc_id", "pre", C("subtree").alias("tokens"))


@query("w23_section_text", tsql(LEAVES, r"""SELECT l.doc_id, l.pre, left(substr(p.text, greatest(1, instr(p.text, trim(regexp_replace(l.title, ' zzq$', ''))))), 2000) AS text FROM leaves l JOIN doc_pages p ON p.doc_id = l.doc_id AND p.page_no = l.start_page""", "nodes", "doc_pages"))
def w23(spark, d):
    p = D.doc_pages(spark, d).select("doc_id", C("page_no").alias("start_page"), C("text").alias("page_text"))
    title = F.trim(F.regexp_replace("title", " zzq$", ""))
    at = F.greatest(F.lit(1), F.instr("page_text", title))
    return leaves(spark, d).join(p, ["doc_id", "start_page"]).select("doc_id", "pre", F.left(F.substring("page_text", at, F.length("page_text")), F.lit(2000)).alias("text"))


@query("j9_peer_codes", sql("""SELECT doc_id, pre FROM (SELECT k.doc_id, k.pre, k.parent_pos, starts_with(k.node_id, p.node_id || '.') AS own, bool_or(starts_with(k.node_id, p.node_id || '.')) OVER (PARTITION BY k.doc_id, k.parent_pos) AS any_own
    FROM (SELECT doc_id, pre, parent_pos, CASE WHEN pre % 4 = 1 THEN 'x' || node_id ELSE node_id END AS node_id FROM nodes) k JOIN nodes p ON p.doc_id = k.doc_id AND p.pre = k.parent_pos) WHERE own OR NOT any_own""", "nodes"))
def j9(spark, d):
    kids = D.nodes(spark, d).select("doc_id", "pre", "parent_pos", F.when(C("pre") % 4 == 1, F.concat(F.lit("x"), C("node_id"))).otherwise(C("node_id")).alias("code"))
    up = D.nodes(spark, d).select("doc_id", C("pre").alias("parent_pos"), C("node_id").alias("up"))
    own = kids.join(up, ["doc_id", "parent_pos"]).withColumn("own", C("code").startswith(F.concat("up", F.lit("."))))
    return own.withColumn("any_own", F.bool_or("own").over(W.partitionBy("doc_id", "parent_pos"))).where("own OR NOT any_own").select("doc_id", "pre")


def _again(query: str) -> str:
    """The chain of tables from a list of levels to nodes once more, over p_raw."""
    names = ("toc_raw", "toc_groups", "toc_items", "flat", "tree", "bounded", "bounds", "ends", "nodes")
    ctes = [f"p_raw AS ({query})", *(f"{n} AS ({D.SQL[n][1]})" for n in names[1:])]
    return ",\n".join(re.sub(rf"\b({'|'.join(names)})\b", lambda m: "p_" + m[1].removeprefix("toc_"), x) if k else x for k, x in enumerate(ctes))


# Every third node has its neighbour's title laid over its own, in capitals and with blanks in it.
_ECHO = "CASE WHEN (doc_id + pre) % 3 = 1 THEN coalesce(translate(replace(lag(title) OVER (PARTITION BY doc_id ORDER BY pre), 'e', 'e '), 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ'), title) ELSE title END"
_KEY = r"lower(regexp_replace({0}.title, '\s+', '', 'g'))"


@query("j11_promote_equal_child", sql("", "nodes").rstrip() + f""",
    echo AS (SELECT * REPLACE ({_ECHO} AS title) FROM nodes), span AS (SELECT *, coalesce((SELECT min(k.pre) FROM echo k WHERE k.doc_id = n.doc_id AND k.pre > n.pre AND k.depth <= n.depth) - 1, max(pre) OVER (PARTITION BY doc_id)) AS last_pre FROM echo n),
    firsts AS (SELECT *, row_number() OVER (PARTITION BY doc_id, parent_pos ORDER BY pre) AS rn FROM span WHERE parent_pos IS NOT NULL),
    gone AS (SELECT k.doc_id, k.pre, k.last_pre FROM firsts k JOIN echo p ON p.doc_id = k.doc_id AND p.pre = k.parent_pos WHERE rn = 1 AND {_KEY.format("k")} = {_KEY.format("p")} AND {_KEY.format("k")} <> ''),
    """ + _again("""SELECT doc_id, pre AS list_index, CAST(depth - (SELECT count(*) FROM gone g WHERE g.doc_id = n.doc_id AND n.pre BETWEEN g.pre AND g.last_pre) AS INT) AS level, title, start_page AS page, start_page AS physical_index FROM echo n WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE g.doc_id = n.doc_id AND g.pre = n.pre)""")
    + " SELECT doc_id, pre, node_id, parent_pos, depth, title, start_page, end_page FROM p_nodes")
def j11(spark, d):
    echo = F.translate(F.replace(F.lag("title").over(H.by_doc()), F.lit("e"), F.lit("e ")), string.ascii_lowercase, string.ascii_uppercase)
    n = D.nodes(spark, d).withColumn("title", F.when((C("doc_id") + C("pre")) % 3 == 1, F.coalesce(echo, C("title"))).otherwise(C("title")))
    return H.promote_equal_children(n, D.page_totals(spark, d), D.MAX_LEAF, D.LEVELS)


# Phrases laid over the data, which has none of a type's: of tenders, contracts, papers, manuals and laws.
PHRASES = ("", "招标公告 采购需求 第一章", "甲方与乙方 第一条 违约责任", "Abstract. Introduction, Chapter 3", "安装步骤 常见问题", "2023年度报告 总结", "第3条 中华人民共和国 总则", "记者 张三 报道 2024年1月2日")


def _scores_sql() -> dict[str, str]:
    hits = lambda tests, points: [f"CASE WHEN {t} THEN {points} ELSE 0 END" for t in tests]
    return {
        t: " + ".join(hits([f"contains(lower(body), '{w}')" for w in words], T.KEYWORD) + hits([f"regexp_matches(body, '{x}')" for x in patterns], T.PATTERN) + hits([f"contains(titles, '{h}')" for h in hints], T.HINT))
        for t, (words, patterns, hints) in T.DOCUMENT_TYPES.items()
    }


@query("g5_classify", sql("", "toc_items").rstrip() + f""", shown AS (SELECT d.doc_id, coalesce(text, '') || ' ' || p AS body, coalesce(t.titles, '') || ' ' || p AS titles FROM (SELECT *, (['{"', '".join(PHRASES)}'])[CAST(doc_id % {len(PHRASES)} + 1 AS INT)] AS p FROM documents) d
    LEFT JOIN (SELECT doc_id, string_agg(title, ' ' ORDER BY list_index) AS titles FROM toc_items GROUP BY doc_id) t USING (doc_id)),
    scored AS (SELECT doc_id, {", ".join(f"{x} AS {t}" for t, x in _scores_sql().items())} FROM shown), best AS (SELECT *, greatest({", ".join(T.DOCUMENT_TYPES)}) AS best, {" + ".join(T.DOCUMENT_TYPES)} AS total FROM scored)
    SELECT doc_id, CASE WHEN best = 0 THEN 'general' {" ".join(f"WHEN {t} = best THEN '{t}'" for t in T.DOCUMENT_TYPES)} END AS type, CASE WHEN best = 0 THEN 0.5 ELSE least(0.95, best / total) END AS confidence FROM best""")
def g5(spark, d):
    """Types of whole documents by rule: words, patterns, and hints in all their titles; ties go to the first type."""
    phrase = F.get(F.array(*[F.lit(x) for x in PHRASES]), (C("doc_id") % len(PHRASES)).cast("int"))
    titles = D.toc_items(spark, d).groupBy("doc_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("list_index", "title"))), lambda x: x["title"]), " ").alias("titles"))
    shown = D.table(spark, d, "documents").select("doc_id", F.concat(F.coalesce("text", F.lit("")), F.lit(" "), phrase).alias("body"), phrase.alias("p")).join(titles, "doc_id", "left")
    names = list(T.DOCUMENT_TYPES)
    scored = shown.select("doc_id", *[c.alias(t) for t, c in T.type_scores(C("body"), F.concat(F.coalesce("titles", F.lit("")), F.lit(" "), "p")).items()])
    best, total = F.greatest(*names), sum((C(t) for t in names[1:]), C(names[0]))
    kind = F.coalesce(*[F.when(C(t) == C("best"), F.lit(t)) for t in names])
    scored = scored.withColumn("best", best).withColumn("total", total)
    return scored.select("doc_id", F.when(C("best") == 0, "general").otherwise(kind).alias("type"), F.when(C("best") == 0, 0.5).otherwise(F.least(F.lit(0.95), C("best") / C("total"))).alias("confidence"))


# The advice.
ADVICE = ("检测到大量无效节点被删除，建议优化TOC提取阶段以减少误识别", "多个节点的页码范围需要修正，建议改进页面映射算法", "较多建议未通过PDF验证，可能需要提高建议生成的准确性", "文档结构质量良好，无重大问题")


@query("g10_recommendations", sql(f"""SELECT doc_id, CASE WHEN len(a) = 0 THEN ['{ADVICE[3]}'] ELSE a END AS advice FROM (SELECT doc_id, list_filter([CASE WHEN deleted > 5 THEN '{ADVICE[0]}' END, CASE WHEN pages > 3 THEN '{ADVICE[1]}' END, CASE WHEN rejected > verified THEN '{ADVICE[2]}' END], lambda x: x IS NOT NULL) AS a FROM (
    SELECT doc_id, sum(CAST(action = 'DELETE' AS INT)) AS deleted, sum(CAST(action = 'MODIFY_PAGE' AS INT)) AS pages, sum(CAST(status = 'rejected' AS INT)) AS rejected, sum(CAST(status = 'accepted' AS INT)) AS verified FROM suggestions GROUP BY doc_id))""", "suggestions"))
def g10(spark, d):
    n = lambda c, v: F.sum((C(c) == v).cast("int"))
    own = D.suggestions(spark, d).groupBy("doc_id").agg(n("action", "DELETE").alias("deleted"), n("action", "MODIFY_PAGE").alias("pages"), n("status", "rejected").alias("rejected"), n("status", "accepted").alias("verified"))
    found = F.array_compact(F.array(F.when(C("deleted") > 5, ADVICE[0]), F.when(C("pages") > 3, ADVICE[1]), F.when(C("rejected") > C("verified"), ADVICE[2])))
    return own.select("doc_id", F.when(F.size(found) == 0, F.array(F.lit(ADVICE[3]))).otherwise(found).alias("advice"))


@query("g16_mapping_rate", tsql(J1, "SELECT count(*) AS total, sum(CAST(passed AS INT)) AS validated, avg(CAST(passed AS INT)) AS rate, doc_id % 4 AS printed_offset FROM j1 GROUP BY doc_id % 4", "toc_items", "doc_pages"))
def g16(spark, d):
    ok = C("passed").cast("int")
    return validated(spark, d).groupBy((C("doc_id") % 4).alias("printed_offset")).agg(F.count("*").alias("total"), F.sum(ok).alias("validated"), F.avg(ok).alias("rate"))


@query("p6_page_chunks", tsql(GAPS, "SELECT doc_id, gap_start, (p - gap_start) // 2 AS chunk, min(p) AS first_page, max(p) AS last_page FROM (SELECT doc_id, gap_start, unnest(generate_series(gap_start, gap_end)) AS p FROM gaps) GROUP BY ALL", "nodes", "totals"))
def p6(spark, d):
    gaps = G.gaps(G.missing_pages(leaves(spark, d), D.page_totals(spark, d)))
    pages = gaps.select("doc_id", "gap_start", F.explode(F.sequence("gap_start", "gap_end")).alias("p"))
    return pages.groupBy("doc_id", "gap_start", F.floor((C("p") - C("gap_start")) / 2).alias("chunk")).agg(F.min("p").alias("first_page"), F.max("p").alias("last_page"))


CAP = "CASE WHEN sum(tokens) OVER (PARTITION BY doc_id) <= {0} THEN 1099511627776 ELSE CAST((CAST(floor(sum(tokens) OVER (PARTITION BY doc_id) / ceil(sum(tokens) OVER (PARTITION BY doc_id) / {0})) AS BIGINT) + {0}) // 2 AS BIGINT) END"


def _groups(spark, d, limit: int, overlap: int) -> DataFrame:
    """Greedy groups of pages by tokens, each starting with the last pages of the one before: a fold over a document's pages."""
    pages = D.doc_pages(spark, d).groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("page_no", "tokens"))).alias("pages"), F.sum("tokens").alias("total"))
    cap = F.when(C("total") <= limit, F.lit(1 << 40)).otherwise(F.floor((F.floor(C("total") / F.ceil(C("total") / limit)) + limit) / 2)).cast("bigint")
    folded = F.expr(
        f"""aggregate(pages, named_struct('open', cast(array() as array<struct<page_no:int,tokens:int>>), 'sum', 0L, 'done', cast(array() as array<array<int>>)),
        (a, p) -> if(a.sum + p.tokens > cap AND size(a.open) > 0,
            named_struct('open', array_append(slice(a.open, greatest(size(a.open) - {overlap} + 1, 1), {overlap}), p),
                'sum', aggregate(slice(a.open, greatest(size(a.open) - {overlap} + 1, 1), {overlap}), 0L, (s, x) -> s + x.tokens) + p.tokens, 'done', array_append(a.done, transform(a.open, x -> x.page_no))),
            named_struct('open', array_append(a.open, p), 'sum', a.sum + p.tokens, 'done', a.done)),
        a -> array_append(a.done, transform(a.open, x -> x.page_no)))"""
    )
    return pages.withColumn("cap", cap).select("doc_id", F.posexplode(folded).alias("group_no", "pages"))


@query("p2_overlapping_groups", tsql(GROUPED.format(cap=CAP.format(400), full="len(a.open) > 0", keep="least(1, len(a.open))"), "SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY n) - 1 AS INT) AS group_no, pages FROM groups", "doc_pages"))
def p2(spark, d):
    return _groups(spark, d, 400, 1)


@query("p3_overlapping_groups_two", tsql(GROUPED.format(cap=CAP.format(600), full="len(a.open) > 0", keep="least(2, len(a.open))"), "SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY n) - 1 AS INT) AS group_no, pages FROM groups", "doc_pages"))
def p3(spark, d):
    return _groups(spark, d, 600, 2)


@query("e10_apply_log", sql(f"SELECT doc_id, sum(CAST({SCORE} >= 0.7 AND action <> 'ADD' AS INT)) AS applied, sum(CAST(action = 'ADD' AS INT)) AS warnings, count(*) AS marked FROM suggestions GROUP BY doc_id", "suggestions"))
def e10(spark, d):
    n = lambda v: F.sum((C("outcome") == v).cast("int"))
    return A.plan(D.suggestions(spark, d)).groupBy("doc_id").agg(n("run").alias("applied"), n("skipped").alias("warnings"), F.count("*").alias("marked"))


@query("e13_restore", sql("""SELECT doc_id, CAST(version AS INT) AS version, version = max(version) OVER (PARTITION BY doc_id) AS current, pre, title FROM (SELECT *, dense_rank() OVER (PARTITION BY doc_id ORDER BY stage) AS version FROM (
    SELECT doc_id, 1 AS stage, pre, title FROM nodes UNION ALL SELECT doc_id, 2, pre, CASE WHEN pre % 4 = 1 THEN 'edited' ELSE title END FROM nodes WHERE pre % 3 <> 0 UNION ALL SELECT doc_id, 3, pre, title FROM nodes WHERE doc_id % 2 = 0))""", "nodes"))
def e13(spark, d):
    """Versions of trees: a snapshot before the edits, the edited tree, and for even documents the first snapshot restored."""
    n = D.nodes(spark, d).select("doc_id", "pre", "title")
    first = n.withColumn("version", F.lit(1))
    edited = n.where("pre % 3 <> 0").withColumn("title", F.when(C("pre") % 4 == 1, "edited").otherwise(C("title")))
    backups = A.restore(A.snapshot(first, edited), n.where("doc_id % 2 = 0").select("doc_id", F.lit(1).alias("version")).distinct())
    latest = F.max("version").over(W.partitionBy("doc_id"))
    return backups.withColumn("current", C("version") == latest).select("doc_id", "version", "current", "pre", "title")


@query("e16_node_info", sql("SELECT suggestion_id, '{\"parent_id\":\"' || node_id || '\",\"position\":' || pre || ',\"page_start\":' || start_page || ',\"page_end\":' || end_page || '}' AS node_info FROM suggestions WHERE action = 'ADD'", "suggestions"))
def e16(spark, d):
    info = F.to_json(F.struct(C("node_id").alias("parent_id"), C("pre").alias("position"), C("start_page").alias("page_start"), C("end_page").alias("page_end")))
    return D.suggestions(spark, d).where("action = 'ADD'").select("suggestion_id", info.alias("node_info"))


@query("k7_set_listing", "SELECT source, count(*) AS documents, max(n_chars) AS largest FROM documents GROUP BY source ORDER BY documents DESC, source LIMIT 10")
def k7(spark, d):
    return D.table(spark, d, "documents").groupBy("source").agg(F.count("*").alias("documents"), F.max("n_chars").alias("largest")).orderBy(F.desc("documents"), "source").limit(10)


_TYPO = "CASE list_index % 4 WHEN 1 THEN translate(title, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ') WHEN 2 THEN replace(title, ' ', '--') WHEN 3 THEN left(title, 3) || 'q' || substr(title, 5) ELSE title END"
_NORM = "regexp_replace(lower({0}), '[^\\p{{L}}\\p{{N}}]+', '', 'g')"


# DuckDB counts bytes in a distance, so letters of the tables that have two become ones that lower case leaves free.
_BYTES = "translate({0}, 'àâäáåæçèéêëìíîïñòóôöøùúûüß', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ')"


@query("q8_fuzzy_titles", sql(f'''SELECT doc_id, list_index, CASE WHEN contains(lower(page), lower(title)) THEN 100 WHEN n = 0 THEN 0 WHEN contains(p, t) THEN 95
    ELSE (SELECT CASE WHEN best <= floor(n * 3 / 10) THEN CAST(least(94, floor(100 * (n - best) / n)) AS INT) ELSE 0 END FROM (SELECT list_min(list_transform(generate_series(1, greatest(1, length(p) - n + 1)), lambda i: levenshtein(substr(q, i, n), u))) AS best)) END AS confidence
    FROM (SELECT *, {_BYTES.format(_NORM.format("title"))} AS u, {_BYTES.format(_NORM.format("page"))} AS q, {_NORM.format("title")} AS t, {_NORM.format("page")} AS p, length({_NORM.format("title")}) AS n FROM (
    SELECT t.doc_id, list_index, {_TYPO} AS title, p.text AS page FROM toc_items t JOIN doc_pages p ON p.doc_id = t.doc_id AND p.page_no = t.physical_index))''', "toc_items", "doc_pages"))
def q8(spark, d):
    p = D.doc_pages(spark, d).select("doc_id", C("page_no").alias("physical_index"), C("text").alias("page"))
    df = D.toc_items(spark, d).select("doc_id", "list_index", "physical_index", F.expr(_TYPO).alias("title")).join(p, ["doc_id", "physical_index"])
    return df.select("doc_id", "list_index", T.title_confidence(C("title"), C("page")).alias("confidence"))


@query("s7_answers", _answers("SELECT doc_id, sum(length(t)) AS title_chars, count(*) AS items FROM whole GROUP BY doc_id"))
def s7(spark, d):
    schema = "array<struct<i:int,title:string>>"
    whole = answers(spark, d).where("doc_id % 4 <> 1").select("doc_id", F.inline(F.from_json(T.answer_json(C("raw")), schema)))
    return whole.unionByName(cut_items(spark, d, schema)).groupBy("doc_id").agg(F.sum(F.length("title")).alias("title_chars"), F.count("*").alias("items"))
