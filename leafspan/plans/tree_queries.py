"""Queries over section trees, mappings, coverage and edits (ids W, J, G1 to G5, Q, E, K, P), each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from leafspan.functions import text as T
from leafspan.operators import audit as A, coverage as G, hierarchy as H, mapping as M, numbering as Q
from leafspan.plans import derive as D
from leafspan.plans.derive import sql, strip_sql
from leafspan.plans.text_queries import _VALID

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


def leaves(spark, d) -> DataFrame:
    return D.nodes(spark, d).withColumn("leaf", H.is_leaf()).where("leaf").drop("leaf")


LEAVES = "leaves AS (SELECT * FROM (SELECT *, coalesce(lead(depth) OVER (PARTITION BY doc_id ORDER BY pre) <= depth, true) AS leaf FROM nodes) WHERE leaf)"
MISSING = LEAVES + """, missing AS (SELECT doc_id, CAST(unnest(generate_series(1, total_pages)) AS INT) AS page_no FROM totals EXCEPT SELECT doc_id, CAST(unnest(generate_series(start_page, end_page)) AS INT) FROM leaves)"""
GAPS = MISSING + """, gaps AS (SELECT doc_id, min(page_no) AS gap_start, max(page_no) AS gap_end FROM (SELECT *, page_no - row_number() OVER (PARTITION BY doc_id ORDER BY page_no) AS island FROM missing) GROUP BY doc_id, island)"""


def tsql(ctes: str, body: str, *needs: str, more: bool = False) -> str:
    """body with derived tables and further ones in front; more: body goes on with tables of its own."""
    return sql("", *needs).rstrip() + ",\n" + ctes + (",\n" if more else "\n") + body


@query("w1_structure_codes", sql("SELECT doc_id, list_index, level, structure FROM toc_items", "toc_items"))
def w1(spark, d):
    return D.toc_items(spark, d).select("doc_id", "list_index", "level", "structure")


def outline(spark, d) -> DataFrame:
    t = D.toc_items(spark, d)
    title = F.when(C("level") == 1, F.concat(F.lit("Chapter "), ((C("list_index") / 5).cast("int") % 7 + 1).cast("string"), F.lit(" "), F.left("title", F.lit(8)))).when(C("list_index") % 9 == 4, F.concat(F.lit("附件1 "), C("title"))).otherwise(C("title"))
    return t.select("doc_id", C("list_index").alias("pos"), "level", title.alias("title"), "page")


OUTLINE = """outline AS (SELECT doc_id, list_index AS pos, level, CASE WHEN level = 1 THEN 'Chapter ' || (list_index // 5 % 7 + 1) || ' ' || left(title, 8) WHEN list_index % 9 = 4 THEN '附件1 ' || title ELSE title END AS title, page FROM toc_items),
    valid AS (SELECT *, regexp_matches(title, '""" + T.CHAPTER + """') AS chapter FROM outline WHERE """ + _VALID.format("title") + """),
    marked AS (SELECT *, chapter AND row_number() OVER (PARTITION BY doc_id, title ORDER BY pos) > 1 AS again FROM valid),
    grouped AS (SELECT *, sum(CAST(again AS INT)) OVER (PARTITION BY doc_id ORDER BY pos) AS grp FROM marked),
    headed AS (SELECT *, first_value(level) OVER g AS head, row_number() OVER g AS rn FROM grouped WINDOW g AS (PARTITION BY doc_id, grp ORDER BY pos)),
    passed AS (SELECT *, min(CASE WHEN rn > 1 THEN level END) OVER (PARTITION BY doc_id, grp ORDER BY pos) AS least_level FROM headed),
    kept AS (SELECT *, coalesce(bool_or(chapter) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS seen FROM passed WHERE NOT (grp > 0 AND (rn = 1 OR coalesce(least_level > head, false))))"""


@query("w2_promote_chapters", tsql(OUTLINE, "SELECT doc_id, pos, CASE WHEN chapter THEN 1 WHEN level = 1 AND regexp_matches(title, '^附件\\s*[0-9]') AND seen THEN 2 ELSE level END AS level, title, page FROM kept", "toc_items"))
def w2(spark, d):
    return H.promote_chapters(outline(spark, d))


@query("w3_list_to_tree", sql("SELECT doc_id, pre, node_id, parent_pos FROM tree", "tree"))
def w3(spark, d):
    return D.nodes(spark, d).select("doc_id", "pre", "node_id", "parent_pos")


@query("w4_exact_parents", sql(r"""SELECT t.doc_id, t.list_index, t.structure, (SELECT max(u.list_index) FROM toc_items u WHERE u.doc_id = t.doc_id AND u.list_index < t.list_index
    AND contains(t.structure, '.') AND u.structure = regexp_replace(t.structure, '\.[^.]*$', '')) AS parent_pos FROM toc_items t""", "toc_items"))
def w4(spark, d):
    return H.exact_parents(D.toc_items(spark, d)).select("doc_id", "list_index", "structure", "parent_pos")


def md_lines(spark, d) -> DataFrame:
    """Markdown from sections: a heading, the page's lines, and every third page a fenced block."""
    t = D.toc_items(spark, d).join(D.doc_pages(spark, d).select("doc_id", C("page_no").alias("physical_index"), "text"), ["doc_id", "physical_index"])
    body = F.concat(F.repeat(F.lit("#"), C("level")), F.lit(" "), C("title"), F.lit("\n"), C("text"), F.when(C("physical_index") % 3 == 0, F.lit("\n```\n# no heading\n```")).otherwise(""))
    return t.select("doc_id", "list_index", F.posexplode(F.split(body, "\n")).alias("n", "line")).select("doc_id", (C("list_index") * 1000 + C("n")).alias("line_num"), "line")


MD = r"""md AS (SELECT doc_id, list_index, string_split(repeat('#', level) || ' ' || title || chr(10) || p.text || CASE WHEN physical_index % 3 = 0 THEN chr(10) || '```' || chr(10) || '# no heading' || chr(10) || '```' ELSE '' END, chr(10)) AS l
    FROM toc_items t JOIN doc_pages p USING (doc_id) WHERE t.physical_index = p.page_no),
    md_lines AS (SELECT doc_id, list_index * 1000 + n - 1 AS line_num, l[n] AS line FROM (SELECT doc_id, list_index, l, unnest(generate_series(1, len(l))) AS n FROM md)),
    fenced AS (SELECT *, starts_with(ltrim(line), '```') AS fence, sum(CAST(starts_with(ltrim(line), '```') AS INT)) OVER (PARTITION BY doc_id ORDER BY line_num) % 2 = 1 AS inside FROM md_lines),
    heads AS (SELECT doc_id, line_num, length(regexp_extract(line, '^(#{1,6})', 1)) AS level, trim(regexp_extract(line, '^#{1,6}\s+(.+)$', 1)) AS title FROM fenced WHERE NOT fence AND NOT inside AND regexp_matches(line, '^#{1,6}\s+.+$'))"""


@query("w6_markdown_headings", tsql(MD, "SELECT * FROM heads", "toc_items", "doc_pages"))
def w6(spark, d):
    return H.headings(md_lines(spark, d))


@query("w5_markdown_sections", tsql(MD, """SELECT doc_id, owner AS line_num, trim(string_agg(line, chr(10) ORDER BY line_num), ' ' || chr(10) || chr(9) || chr(13)) AS text FROM (
    SELECT m.*, max(h.line_num) OVER (PARTITION BY m.doc_id ORDER BY m.line_num) AS owner FROM md_lines m LEFT JOIN heads h ON m.doc_id = h.doc_id AND m.line_num = h.line_num) WHERE owner IS NOT NULL GROUP BY doc_id, owner""", "toc_items", "doc_pages"))
def w5(spark, d):
    return H.section_lines(md_lines(spark, d))


@query("w7_end_pages", sql("SELECT doc_id, pre, start_page, end_page FROM nodes", "nodes"))
def w7(spark, d):
    return D.nodes(spark, d).select("doc_id", "pre", "start_page", "end_page")


@query("w8_list_order_ends", sql("""SELECT doc_id, list_index, coalesce(lead(CASE WHEN list_index % 2 = 0 THEN physical_index - 1 ELSE physical_index END) OVER (PARTITION BY doc_id ORDER BY list_index), total_pages) AS end_page FROM toc_items JOIN totals USING (doc_id)""", "toc_items", "totals"))
def w8(spark, d):
    own = F.when(C("list_index") % 2 == 0, C("physical_index") - 1).otherwise(C("physical_index"))  # the next section starts its page, or not
    items = D.toc_items(spark, d).join(D.page_totals(spark, d), "doc_id")
    return items.select("doc_id", "list_index", F.coalesce(F.lead(own).over(W.partitionBy("doc_id").orderBy("list_index")), "total_pages").alias("end_page"))


RANKED = "ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY doc_id, parent_pos ORDER BY pre) AS VARCHAR) AS r FROM nodes)"


@query("w9_hierarchical_ids", tsql(RANKED, """ids AS (SELECT doc_id, pre, r AS id FROM ranked WHERE parent_pos IS NULL UNION ALL SELECT a.doc_id, a.pre, u.id || '.' || a.r FROM ranked a JOIN ids u ON u.doc_id = a.doc_id AND u.pre = a.parent_pos)
    SELECT doc_id, pre, id FROM ids""", "nodes", more=True))
def w9(spark, d):
    return H.hierarchical_ids(D.nodes(spark, d), D.LEVELS).select("doc_id", "pre", "id")


@query("w10_sequential_ids", sql("SELECT doc_id, pre, lpad(CAST(row_number() OVER (PARTITION BY doc_id ORDER BY pre) - 1 AS VARCHAR), 4, '0') AS id FROM nodes", "nodes"))
def w10(spark, d):
    return H.sequential_ids(D.nodes(spark, d)).select("doc_id", "pre", "id")


@query("w12_bounded_flatten", sql("""SELECT doc_id, pre, title, EXISTS (SELECT 1 FROM nodes k WHERE k.doc_id = n.doc_id AND k.parent_pos = n.pre) AS has_children FROM (
    SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pre) AS rn FROM nodes WHERE depth <= 2) n WHERE rn <= 50""", "nodes"))
def w12(spark, d):
    return H.flatten(D.nodes(spark, d), 2, 50).select("doc_id", "pre", "title", "has_children")


@query("w13_depth_check", sql("SELECT doc_id, max(depth) AS max_depth, sum(CAST(depth > 2 AS INT)) AS deeper FROM nodes GROUP BY doc_id", "nodes"))
def w13(spark, d):
    return D.nodes(spark, d).groupBy("doc_id").agg(F.max("depth").alias("max_depth"), F.sum((C("depth") > 2).cast("int")).alias("deeper"))


@query("w15_leaves", tsql(LEAVES, "SELECT doc_id, pre FROM leaves", "nodes"))
def w15(spark, d):
    return leaves(spark, d).select("doc_id", "pre")


SUB = """sub AS (SELECT *, coalesce((SELECT min(k.pre) FROM nodes k WHERE k.doc_id = n.doc_id AND k.pre > n.pre AND k.depth <= n.depth) - 1, max(pre) OVER (PARTITION BY doc_id)) AS last_pre FROM nodes n)"""


@query("w14_merge_deep", tsql(SUB, """SELECT n.doc_id, n.pre, coalesce(string_agg(k.title, '|' ORDER BY k.pre), '') AS sub_items FROM sub n LEFT JOIN nodes k ON n.depth = 2 AND k.doc_id = n.doc_id AND k.pre > n.pre AND k.pre <= n.last_pre WHERE n.depth <= 2 GROUP BY ALL""", "nodes"))
def w14(spark, d):
    return H.merge_deep(D.nodes(spark, d), 2, D.LEVELS).select("doc_id", "pre", F.array_join("sub_items", "|").alias("sub_items"))


@query("w16_subtree_rollup", tsql(SUB, """SELECT s.doc_id, s.pre, sum(p.tokens) AS tokens FROM sub s JOIN nodes k ON k.doc_id = s.doc_id AND k.pre BETWEEN s.pre AND s.last_pre JOIN doc_pages p ON p.doc_id = k.doc_id AND p.page_no = k.start_page GROUP BY ALL""", "nodes", "doc_pages"))
def w16(spark, d):
    return rolled(spark, d).select("doc_id", "pre", C("subtree").alias("tokens"))


def rolled(spark, d) -> DataFrame:
    """Nodes with last_pre and subtree, the tokens of their pages and of all below."""
    n = D.nodes(spark, d).join(D.doc_pages(spark, d).select("doc_id", C("page_no").alias("start_page"), "tokens"), ["doc_id", "start_page"])
    return H.rollup(n, "tokens", D.LEVELS)


@query("w18_preface", sql("SELECT doc_id, 'Preface' AS title, 1 AS start_page, arg_min(start_page, pre) - 1 AS end_page FROM nodes GROUP BY doc_id HAVING arg_min(start_page, pre) > 1", "nodes"))
def w18(spark, d):
    first = D.nodes(spark, d).groupBy("doc_id").agg(F.min_by("start_page", "pre").alias("first"))
    return first.where("first > 1").select("doc_id", F.lit("Preface").alias("title"), F.lit(1).alias("start_page"), (C("first") - 1).alias("end_page"))


@query("w19_tree_statistics", sql("SELECT doc_id, sum(CAST(depth = 1 AS INT)) AS root_nodes, count(*) AS total_nodes, max(depth) AS max_depth, count(*) / sum(CAST(depth = 1 AS INT)) AS avg_per_root, sum(length(title)) AS title_chars FROM nodes GROUP BY doc_id", "nodes"))
def w19(spark, d):
    roots = F.sum((C("depth") == 1).cast("int"))
    return D.nodes(spark, d).groupBy("doc_id").agg(roots.alias("root_nodes"), F.count("*").alias("total_nodes"), F.max("depth").alias("max_depth"), F.try_divide(F.count("*"), roots).alias("avg_per_root"), F.sum(F.length("title")).alias("title_chars"))


@query("w20_paths", tsql("""p AS (SELECT doc_id, pre, node_id AS path FROM nodes WHERE parent_pos IS NULL UNION ALL SELECT a.doc_id, a.pre, p.path || ' > ' || a.node_id FROM nodes a JOIN p ON p.doc_id = a.doc_id AND p.pre = a.parent_pos)""", "SELECT doc_id, pre, path FROM p", "nodes"))
def w20(spark, d):
    return H.paths(D.nodes(spark, d), D.LEVELS).select("doc_id", "pre", F.array_join("path", " > ").alias("path"))


@query("w21_api_layout", sql("SELECT doc_id, node_id AS id, title, start_page AS ps, end_page AS pe FROM nodes", "nodes"))
def w21(spark, d):
    return D.nodes(spark, d).select("doc_id", "node_id", "title", "start_page", "end_page").withColumnsRenamed({"node_id": "id", "start_page": "ps", "end_page": "pe"})


NODE_TEXT = """node_text AS (SELECT n.doc_id, n.pre, string_agg(p.text, chr(10) || chr(10) ORDER BY page_no) AS full_text, CAST(sum(tokens) AS INT) AS tokens, any_value(end_page - start_page + 1) AS span FROM nodes n JOIN doc_pages p ON p.doc_id = n.doc_id AND p.page_no BETWEEN start_page AND end_page GROUP BY n.doc_id, n.pre)"""


@query("w22_node_text", tsql(NODE_TEXT, "SELECT doc_id, pre, CASE WHEN length(full_text) > 5000 THEN left(full_text, 5000) || '...' ELSE full_text END AS text, tokens FROM node_text", "nodes", "doc_pages"))
def w22(spark, d):
    return H.node_text(D.nodes(spark, d), D.doc_pages(spark, d))


@query("w24_admitted_rows", sql("""SELECT doc_id, list_index FROM (SELECT *, bool_or(keep) OVER (PARTITION BY doc_id) AS any_keep FROM (SELECT doc_id, list_index, list_index % 3 <> 1 OR list_index % 4 <> 3 AS keep FROM toc_items)) WHERE keep OR NOT any_keep""", "toc_items"))
def w24(spark, d):
    keep = (C("list_index") % 3 != 1) | (C("list_index") % 4 != 3)  # verification passed, or a page is known
    own = D.toc_items(spark, d).select("doc_id", "list_index", keep.alias("keep")).withColumn("any_keep", F.bool_or("keep").over(W.partitionBy("doc_id")))
    return own.where("keep OR NOT any_keep").select("doc_id", "list_index")


FOUND = r"""(contains(p.text, title) OR contains(regexp_replace(p.text, '\s+', '', 'g'), regexp_replace(title, '\s+', '', 'g')))"""
J1 = f"j1 AS (SELECT t.doc_id, t.list_index, title, t.page, CASE WHEN page >= 1 THEN page + t.doc_id % 4 END AS physical, coalesce({FOUND}, false) AS passed FROM toc_items t LEFT JOIN doc_pages p ON p.doc_id = t.doc_id AND p.page_no = CASE WHEN page >= 1 THEN page + t.doc_id % 4 END)"


def validated(spark, d) -> DataFrame:
    return M.validate_mapping(D.toc_items(spark, d).drop("physical_index"), D.doc_pages(spark, d), D.page_totals(spark, d), (C("doc_id") % 4).cast("int"))


@query("j1_validate_mapping", tsql(J1, "SELECT doc_id, list_index, physical, passed FROM j1", "toc_items", "doc_pages"))
def j1(spark, d):
    return validated(spark, d).select("doc_id", "list_index", "physical", "passed")


@query("g15_accuracy", tsql(J1, "SELECT doc_id, sum(CAST(passed AS INT)) AS validated, count(*) AS total, avg(CAST(passed AS INT)) AS accuracy FROM j1 GROUP BY doc_id", "toc_items", "doc_pages"))
def g15(spark, d):
    ok = C("passed").cast("int")
    return validated(spark, d).groupBy("doc_id").agg(F.sum(ok).alias("validated"), F.count("*").alias("total"), F.avg(ok).alias("accuracy"))


_TAKEN = "('0x' || substr(md5(doc_id || '-' || list_index), 1, 8))::BIGINT % 100 < 30"


@query("g15_sampled_accuracy", tsql(J1, f"""SELECT doc_id, n AS sampled, accuracy, round((p + z2 / (2 * n) - 1.96 * sqrt(p * (1 - p) / n + z2 / (4 * n * n))) / (1 + z2 / n), 6) AS low, round((p + z2 / (2 * n) + 1.96 * sqrt(p * (1 - p) / n + z2 / (4 * n * n))) / (1 + z2 / n), 6) AS high FROM (
    SELECT doc_id, 1.96 * 1.96 AS z2, count(*) FILTER ({_TAKEN}) AS n, avg(CAST(passed AS INT)) AS accuracy, avg(CAST(passed AS INT)) FILTER ({_TAKEN}) AS p FROM j1 GROUP BY doc_id) WHERE n > 0""", "toc_items", "doc_pages"))
def g15_sampled(spark, d):
    found = M.sampled_accuracy(validated(spark, d), ["doc_id"], ["doc_id", "list_index"], 30)
    return found.withColumns({c: F.round(c, 6) for c in ("low", "high")})


@query("j2_search_offsets", tsql("""firsts AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY list_index) AS rn FROM toc_items) WHERE rn <= 5 AND length(title) > 0),
    contents AS (SELECT f.doc_id, page_no FROM firsts f JOIN doc_pages p USING (doc_id) WHERE contains(left(p.text, 5000), title) GROUP BY ALL HAVING count(*) >= 3),
    found AS (SELECT f.doc_id, list_index, f.page, min(page_no) AS hit FROM firsts f JOIN doc_pages p USING (doc_id) WHERE contains(left(p.text, 3000), title) AND NOT EXISTS (SELECT 1 FROM contents c WHERE c.doc_id = p.doc_id AND c.page_no = p.page_no) GROUP BY ALL),
    votes AS (SELECT doc_id, hit - page AS v, count(*) AS n, min(list_index) AS seen FROM found GROUP BY ALL)""", 'SELECT doc_id, v AS "offset" FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, seen) AS rk FROM votes) WHERE rk = 1', "toc_items", "doc_pages"))
def j2(spark, d):
    return M.search_offsets(D.toc_items(spark, d), D.doc_pages(spark, d))


@query("j3_pair_offsets", tsql("""votes AS (SELECT t.doc_id, a.physical_index - t.page AS v, count(*) AS n, min(t.list_index) AS seen FROM toc_items t JOIN toc_items a ON t.doc_id = a.doc_id AND t.title = a.title AND a.list_index % 2 = 0 WHERE a.physical_index >= 2 GROUP BY ALL)""",
    'SELECT doc_id, v AS "offset" FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, seen) AS rk FROM votes) WHERE rk = 1', "toc_items"))
def j3(spark, d):
    t = D.toc_items(spark, d)
    return M.pair_offsets(t.drop("physical_index"), t.where("list_index % 2 = 0").select("doc_id", "title", "physical_index"), 2)


@query("j4_estimate_pages", sql("""SELECT doc_id, list_index, coalesce(phys, CASE WHEN page + o > 0 THEN page + o END) AS physical, phys IS NULL AND page + o > 0 AS estimated FROM (SELECT *, arg_min(phys - page, list_index) FILTER (phys IS NOT NULL) OVER (PARTITION BY doc_id) AS o FROM (
    SELECT *, CASE WHEN list_index % 3 = 1 THEN physical_index END AS phys FROM toc_items)) WHERE o IS NOT NULL""", "toc_items"))
def j4(spark, d):
    t = D.toc_items(spark, d).withColumn("phys", F.when(C("list_index") % 3 == 1, C("physical_index")))
    first = t.where("phys is not null").groupBy("doc_id").agg(F.min_by(C("phys") - C("page"), "list_index").alias("o"))
    guess = F.when(C("page") + C("o") > 0, C("page") + C("o"))
    return t.join(first, "doc_id").select("doc_id", "list_index", F.coalesce("phys", guess).alias("physical"), (C("phys").isNull() & (C("page") + C("o") > 0)).alias("estimated"))


BOUNDS = J1 + """, bounds AS (SELECT j1.*, coalesce(max(CASE WHEN passed THEN list_index END) OVER b, -1) AS pi, coalesce(min(CASE WHEN passed THEN list_index END) OVER a, -1) AS ni, total_pages FROM j1 JOIN totals USING (doc_id)
    WINDOW b AS (PARTITION BY doc_id ORDER BY list_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), a AS (PARTITION BY doc_id ORDER BY list_index ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)),
    j5 AS (SELECT b.doc_id, b.list_index, b.title, b.passed, coalesce(p.physical, 1) AS prev_page, coalesce(n.physical, total_pages) AS next_page FROM bounds b LEFT JOIN j1 p ON p.doc_id = b.doc_id AND p.list_index = b.pi LEFT JOIN j1 n ON n.doc_id = b.doc_id AND n.list_index = b.ni)"""


def bounded(spark, d) -> DataFrame:
    return M.neighbour_bounds(validated(spark, d), C("passed"), C("total_pages"))


@query("j5_neighbour_bounds", tsql(BOUNDS, "SELECT doc_id, list_index, prev_page, next_page FROM j5", "toc_items", "doc_pages", "totals"))
def j5(spark, d):
    return bounded(spark, d).select("doc_id", "list_index", "prev_page", "next_page")


@query("j6_relocate", tsql(BOUNDS, f"""SELECT j.doc_id, j.list_index, min(CASE WHEN {FOUND} THEN p.page_no END) AS fixed FROM j5 j LEFT JOIN doc_pages p ON p.doc_id = j.doc_id AND p.page_no BETWEEN prev_page AND next_page WHERE NOT passed GROUP BY ALL""", "toc_items", "doc_pages", "totals"))
def j6(spark, d):
    return M.relocate(bounded(spark, d).where("NOT passed"), D.doc_pages(spark, d))


@query("j7_fill_mapping", sql("""SELECT l.doc_id, l.list_index, coalesce(l.physical, r.physical) AS physical FROM (SELECT doc_id, list_index, CASE WHEN list_index % 3 = 0 THEN physical_index END AS physical FROM toc_items) l
    LEFT JOIN (SELECT doc_id, list_index, physical_index + 1 AS physical FROM toc_items WHERE list_index % 2 = 0) r ON r.doc_id = l.doc_id AND r.list_index = l.list_index""", "toc_items"))
def j7(spark, d):
    t = D.toc_items(spark, d)
    left = t.select("doc_id", "list_index", F.when(C("list_index") % 3 == 0, C("physical_index")).alias("physical"))
    return M.fill_mapping(left, t.where("list_index % 2 = 0").select("doc_id", "list_index", (C("physical_index") + 1).alias("physical")), ["doc_id", "list_index"], "physical")


@query("j8_merge_structures", sql("SELECT doc_id, list_index, structure, title FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, structure, title ORDER BY list_index) AS rn FROM toc_items) WHERE rn = 1", "toc_items"))
def j8(spark, d):
    t = D.toc_items(spark, d).select("doc_id", "list_index", "structure", "title")
    return M.merge_first_wins([t.where("list_index < 5"), t.where("list_index >= 3")], ["doc_id", "structure", "title"], "list_index")


@query("j10_peer_titles", sql(r"""SELECT DISTINCT doc_id, list_index FROM toc_items t WHERE list_index % 2 = 1 AND lower(regexp_replace(title, '\s+', '', 'g')) NOT IN (SELECT lower(regexp_replace(title, '\s+', '', 'g')) FROM nodes n WHERE n.doc_id = t.doc_id AND n.pre % 2 = 0)""", "toc_items", "nodes"))
def j10(spark, d):
    t = D.toc_items(spark, d).where("list_index % 2 = 1").select("doc_id", "list_index", T.title_key(C("title")).alias("k"))
    return t.join(D.nodes(spark, d).where("pre % 2 = 0").select("doc_id", T.title_key(C("title")).alias("k")), ["doc_id", "k"], "left_anti").select("doc_id", "list_index")


@query("j22_merge_verification", tsql(J1, """SELECT doc_id, list_index, CASE WHEN list_index % 4 = 0 THEN passed WHEN list_index % 4 = 1 THEN true ELSE passed END AS verified, list_index % 4 = 1 AS skipped FROM j1""", "toc_items", "doc_pages"))
def j22(spark, d):
    v = validated(spark, d)
    return v.select("doc_id", "list_index", F.when(C("list_index") % 4 == 1, F.lit(True)).otherwise(C("passed")).alias("verified"), (C("list_index") % 4 == 1).alias("skipped"))


@query("j23_version_diff", sql("""SELECT DISTINCT doc_id, title, 'removed' AS side FROM (SELECT doc_id, title FROM nodes EXCEPT SELECT doc_id, CASE WHEN pre % 4 = 1 THEN reverse(title) ELSE title END FROM nodes WHERE pre % 5 <> 2)
    UNION ALL SELECT DISTINCT doc_id, title, 'added' FROM (SELECT doc_id, CASE WHEN pre % 4 = 1 THEN reverse(title) ELSE title END AS title FROM nodes WHERE pre % 5 <> 2 EXCEPT SELECT doc_id, title FROM nodes)""", "nodes"))
def j23(spark, d):
    old = D.nodes(spark, d)
    new = old.where("pre % 5 <> 2").select("doc_id", F.when(C("pre") % 4 == 1, F.reverse("title")).otherwise(C("title")).alias("title"))
    old = old.select("doc_id", "title")
    return old.subtract(new).withColumn("side", F.lit("removed")).unionByName(new.subtract(old).withColumn("side", F.lit("added")))


@query("j24_pages_of_nodes", sql("SELECT DISTINCT doc_id, CAST(unnest(generate_series(start_page, end_page)) AS INT) AS page_no FROM nodes WHERE pre % 4 = 0", "nodes"))
def j24(spark, d):
    return D.nodes(spark, d).where("pre % 4 = 0").select("doc_id", F.explode(F.sequence("start_page", "end_page")).alias("page_no")).distinct()


@query("g1_coverage", tsql(MISSING, """SELECT doc_id, total_pages, count(page_no) AS missing, total_pages - count(page_no) AS covered, CASE WHEN total_pages > 0 THEN (total_pages - count(page_no)) / total_pages * 100 ELSE 0 END AS pct FROM totals LEFT JOIN missing USING (doc_id) GROUP BY doc_id, total_pages""", "nodes", "totals"))
def g1(spark, d):
    return G.coverage(leaves(spark, d), D.page_totals(spark, d))


@query("g1_gaps", tsql(GAPS, "SELECT * FROM gaps", "nodes", "totals"))
def g1_gaps(spark, d):
    return G.gaps(G.missing_pages(leaves(spark, d), D.page_totals(spark, d)))


@query("g2_gap_nodes", tsql(GAPS, "SELECT *, 'Pages ' || gap_start || '-' || gap_end AS title FROM gaps WHERE gap_end - gap_start + 1 >= 2", "nodes", "totals"))
def g2(spark, d):
    return G.gap_nodes(g1_gaps(spark, d))


@query("g3_overlap", tsql(LEAVES, """SELECT n.doc_id, n.start_page AS gap_start, n.total_pages AS gap_end, avg(CASE WHEN EXISTS (SELECT 1 FROM leaves l WHERE l.doc_id = n.doc_id AND n.p BETWEEN l.start_page AND l.end_page) THEN 1 ELSE 0 END) AS share FROM (
    SELECT doc_id, start_page, total_pages, unnest(generate_series(start_page, total_pages)) AS p FROM nodes JOIN totals USING (doc_id) WHERE pre = 3) n GROUP BY ALL""", "nodes", "totals"))
def g3(spark, d):
    ranges = D.nodes(spark, d).where("pre = 3").join(D.page_totals(spark, d), "doc_id").select("doc_id", C("start_page").alias("gap_start"), C("total_pages").alias("gap_end"))
    return G.overlap_share(ranges, leaves(spark, d))


@query("g4_insert_gaps", tsql(GAPS, """SELECT doc_id, title, start_page, row_number() OVER (PARTITION BY doc_id ORDER BY start_page, is_gap DESC, pre) AS position FROM (
    SELECT doc_id, title, start_page, 0 AS is_gap, pre FROM nodes WHERE depth = 1 UNION ALL SELECT doc_id, 'Pages ' || gap_start || '-' || gap_end, gap_start, 1, 0 FROM gaps WHERE gap_end > gap_start)""", "nodes", "totals"))
def g4(spark, d):
    roots = D.nodes(spark, d).where("depth = 1").select("doc_id", "title", "start_page", F.lit(0).alias("is_gap"), "pre")
    both = roots.unionByName(g2(spark, d).select("doc_id", "title", C("gap_start").alias("start_page"), F.lit(1).alias("is_gap"), F.lit(0).alias("pre")))
    return both.withColumn("position", F.row_number().over(W.partitionBy("doc_id").orderBy("start_page", F.desc("is_gap"), "pre"))).drop("is_gap", "pre")


@query("g17_level_histogram", sql("SELECT doc_id, level, count(*) AS n FROM toc_items GROUP BY ALL", "toc_items"))
def g17(spark, d):
    return D.toc_items(spark, d).groupBy("doc_id", "level").agg(F.count("*").alias("n"))


@query("g19_outline_gate", sql(f"SELECT doc_id, count(*) AS raw_rows, sum(CAST({_VALID.format('title')} AS INT)) AS kept, count(*) >= 5 AND NOT (sum(CAST({_VALID.format('title')} AS INT)) / count(*) < 0.5 AND sum(CAST({_VALID.format('title')} AS INT)) < 5) AS accepted FROM toc_items GROUP BY doc_id", "toc_items"))
def g19(spark, d):
    own = D.toc_items(spark, d).groupBy("doc_id").agg(F.count("*").alias("raw_rows"), F.sum(T.is_valid_title(C("title")).cast("int")).alias("kept"))
    return own.withColumn("accepted", (C("raw_rows") >= 5) & ~((C("kept") / C("raw_rows") < 0.5) & (C("kept") < 5)))


@query("q1_sibling_gaps", sql("""SELECT doc_id, pre, next_start - end_page - 1 AS gap FROM (SELECT *, lead(start_page) OVER (PARTITION BY doc_id, parent_pos ORDER BY pre) AS next_start FROM nodes) WHERE next_start - end_page - 1 <> 0""", "nodes"))
def q1(spark, d):
    n = D.nodes(spark, d).withColumn("next_start", F.lead("start_page").over(H.siblings()))
    return n.select("doc_id", "pre", (C("next_start") - C("end_page") - 1).alias("gap")).where("gap <> 0")


@query("q2_shared_pages", sql("""SELECT doc_id, pre FROM (SELECT *, lead(start_page) OVER (PARTITION BY doc_id, parent_pos ORDER BY pre) AS next_start FROM nodes) WHERE end_page = next_start - 1""", "nodes"))
def q2(spark, d):
    return D.nodes(spark, d).withColumn("next_start", F.lead("start_page").over(H.siblings())).where("end_page = next_start - 1").select("doc_id", "pre")


@query("q3_child_ends", sql("SELECT k.doc_id, k.pre, CASE WHEN k.start_page > k.end_page THEN 'inverted' ELSE 'ends_with_parent' END AS issue FROM nodes k JOIN nodes p ON p.doc_id = k.doc_id AND p.pre = k.parent_pos WHERE k.end_page = p.end_page OR k.start_page > k.end_page", "nodes"))
def q3(spark, d):
    n = D.nodes(spark, d)
    up = n.select("doc_id", C("pre").alias("parent_pos"), C("end_page").alias("up_end"))
    bad = n.join(up, ["doc_id", "parent_pos"]).where("end_page = up_end OR start_page > end_page")
    return bad.select("doc_id", "pre", F.when(C("start_page") > C("end_page"), "inverted").otherwise("ends_with_parent").alias("issue"))


# Marks of five systems of numbering laid over siblings, which count on, with holes and repeats; every sixth title has none.
_CJK = "('', '一', '二', '三', '四', '五', '六', '七', '八', '九', '十')"
_SAYS = """CASE WHEN k >= 100 THEN element_at(dg, CAST(k DIV 100 + 1 AS INT)) || '百' || CASE WHEN k % 100 = 0 THEN '' WHEN k % 100 < 10 THEN '零' || element_at(dg, CAST(k % 100 + 1 AS INT)) ELSE element_at(dg, CAST(k % 100 DIV 10 + 1 AS INT)) || '十' || element_at(dg, CAST(k % 10 + 1 AS INT)) END
    WHEN k >= 20 THEN element_at(dg, CAST(k DIV 10 + 1 AS INT)) || '十' || element_at(dg, CAST(k % 10 + 1 AS INT)) WHEN k >= 10 THEN '十' || element_at(dg, CAST(k % 10 + 1 AS INT)) ELSE element_at(dg, CAST(k + 1 AS INT)) END"""
_MARK = "CASE WHEN (doc_id + pre) % 6 = 5 THEN '' WHEN doc_id % 5 = 0 THEN '第' || s || '章 ' WHEN doc_id % 5 = 1 THEN s || '、' WHEN doc_id % 5 = 2 THEN '（' || s || '）' WHEN doc_id % 5 = 3 THEN k || '、' ELSE '7.' || k || ' ' END || title"
_PLACE = "rk + rk DIV 3 - rk DIV 7 + doc_id % 90"


def numbered_nodes(spark, d) -> DataFrame:
    n = D.nodes(spark, d).withColumn("rk", F.row_number().over(H.siblings())).withColumn("k", F.expr(f"CAST({_PLACE} AS INT)")).withColumn("dg", F.expr(f"array{_CJK}"))
    return n.withColumn("s", F.expr(_SAYS)).withColumn("title", F.expr(_MARK)).select("doc_id", "pre", "parent_pos", "depth", "title")


NUMBERED = f"""numbered AS (SELECT doc_id, pre, parent_pos, depth, {_MARK} AS title FROM (SELECT *, {_SAYS.replace("DIV", "//").replace("element_at(dg, ", "list_extract(dg, ")} AS s FROM (
    SELECT *, CAST({_PLACE.replace("DIV", "//")} AS INT) AS k, list_value{_CJK} AS dg FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, parent_pos ORDER BY pre) AS rk FROM nodes)))),
    digits AS (SELECT * FROM (VALUES ('一', 1), ('二', 2), ('三', 3), ('四', 4), ('五', 5), ('六', 6), ('七', 7), ('八', 8), ('九', 9)) t(c, v)),
    words AS (SELECT * FROM (SELECT h.c || '百' || '零' || u.c AS w, h.v * 100 + u.v AS v FROM digits h, digits u UNION ALL SELECT h.c || '百' || t.c || '十' || u.c, h.v * 100 + t.v * 10 + u.v FROM digits h, digits t, (SELECT * FROM digits UNION ALL VALUES ('', 0)) u
    UNION ALL SELECT h.c || '百', h.v * 100 FROM digits h UNION ALL SELECT t.c || '十' || u.c, t.v * 10 + u.v FROM digits t, (SELECT * FROM digits UNION ALL VALUES ('', 0)) u UNION ALL SELECT '十' || u.c, 10 + u.v FROM (SELECT * FROM digits UNION ALL VALUES ('', 0)) u UNION ALL SELECT c, v FROM digits)),
    systems AS (SELECT *, CASE {" ".join(f"WHEN regexp_matches(title, '{p}') THEN '{name}'" for name, p in T.SYSTEMS.items())} END AS system, CASE {" ".join(f"WHEN regexp_matches(title, '{p}') THEN regexp_extract(title, '{p}', 1)" for p in T.SYSTEMS.values())} END AS said FROM numbered)"""


@query("q4_numbering", tsql(NUMBERED, "SELECT doc_id, depth, count(system) AS numbered, count(*) AS nodes FROM systems WHERE depth <= 3 GROUP BY doc_id, depth HAVING count(system) < count(*)", "nodes"))
def q4(spark, d):
    """Levels to the third on which fewer titles are numbered than there are nodes."""
    own = numbered_nodes(spark, d).where("depth <= 3").groupBy("doc_id", "depth").agg(F.count(T.numbering_system(C("title"))).alias("numbered"), F.count("*").alias("nodes"))
    return own.where("numbered < nodes")


@query("q4_numbering_holes", tsql(NUMBERED, """SELECT doc_id, parent_pos, system, lo, hi, list_sort(list_filter(list_transform(range(lo, hi + 1), lambda x: CASE WHEN NOT list_contains(seen, x) THEN x END), lambda x: x IS NOT NULL)) AS missing, list_sort(repeated) AS repeated FROM (
    SELECT doc_id, parent_pos, system, min(v)::INT AS lo, max(v)::INT AS hi, list(DISTINCT v::INT) AS seen, coalesce(list(DISTINCT v::INT) FILTER (again), []) AS repeated FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, parent_pos, system, v) > 1 AS again FROM (
    SELECT s.*, coalesce(TRY_CAST(said AS INT), w.v) AS v FROM systems s LEFT JOIN words w ON w.w = s.said WHERE depth <= 3)) WHERE v IS NOT NULL GROUP BY ALL)""", "nodes"))
def q4_holes(spark, d):
    return Q.numbering_holes(numbered_nodes(spark, d).where("depth <= 3"))


@query("q5_index_bounds", sql("SELECT doc_id, list_index, CASE WHEN physical_index + 2 <= total_pages THEN physical_index + 2 END AS physical FROM toc_items JOIN totals USING (doc_id)", "toc_items", "totals"))
def q5(spark, d):
    t = D.toc_items(spark, d).join(D.page_totals(spark, d), "doc_id")
    return t.select("doc_id", "list_index", F.when(C("physical_index") + 2 <= C("total_pages"), C("physical_index") + 2).alias("physical"))


@query("q6_interpolate", tsql("""given AS (SELECT doc_id, list_index, CASE WHEN list_index % 4 = 1 THEN physical_index * 2 + list_index % 3 END AS physical FROM toc_items),
    rows AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY list_index) AS rn FROM given),
    around AS (SELECT r.*, (SELECT max(a.rn) FROM rows a WHERE a.doc_id = r.doc_id AND a.rn <= r.rn AND a.physical IS NOT NULL) AS ar, (SELECT min(b.rn) FROM rows b WHERE b.doc_id = r.doc_id AND b.rn >= r.rn AND b.physical IS NOT NULL) AS br FROM rows r)""",
    """SELECT r.doc_id, r.list_index, CAST(CASE WHEN r.physical IS NOT NULL THEN r.physical WHEN ar IS NULL THEN greatest(1, b.physical - (br - r.rn)) WHEN br IS NULL THEN a.physical + r.rn - ar ELSE a.physical + floor((b.physical - a.physical) * (r.rn - ar) / (br - ar)) END AS INT) AS filled
    FROM around r LEFT JOIN rows a ON a.doc_id = r.doc_id AND a.rn = ar LEFT JOIN rows b ON b.doc_id = r.doc_id AND b.rn = br WHERE ar IS NOT NULL OR br IS NOT NULL""", "toc_items"))
def q6(spark, d):
    t = D.toc_items(spark, d).select("doc_id", "list_index", F.when(C("list_index") % 4 == 1, C("physical_index") * 2 + C("list_index") % 3).alias("physical"))
    return M.interpolate(t).where("filled is not null").select("doc_id", "list_index", "filled")


TWICE = "given AS (SELECT doc_id, list_index, CASE WHEN list_index % 7 <> 3 THEN CAST(physical_index // 3 * 3 + list_index % 2 AS INT) END AS physical FROM toc_items)"


def repeated(spark, d) -> DataFrame:
    return D.toc_items(spark, d).select("doc_id", "list_index", F.when(C("list_index") % 7 != 3, (F.floor(C("physical_index") / 3) * 3 + C("list_index") % 2).cast("int")).alias("physical"))


@query("q6_shift_duplicates", tsql(TWICE, """numbered AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY physical, list_index) AS n FROM given WHERE physical IS NOT NULL),
    walk AS (SELECT doc_id, list_index, n, physical AS shifted FROM numbered WHERE n = 1 UNION ALL SELECT b.doc_id, b.list_index, b.n, greatest(b.physical, a.shifted + 1) FROM walk a JOIN numbered b ON b.doc_id = a.doc_id AND b.n = a.n + 1)
    SELECT doc_id, list_index, CAST(shifted AS INT) AS shifted FROM walk UNION ALL SELECT doc_id, list_index, NULL FROM given WHERE physical IS NULL""", "toc_items", more=True))
def q6_shift(spark, d):
    return M.shift_duplicates(repeated(spark, d)).select("doc_id", "list_index", "shifted")


@query("q6_backward_steps", tsql(TWICE, """known AS (SELECT * FROM given WHERE physical IS NOT NULL),
    pairs AS (SELECT b.doc_id, b.list_index, b.physical AS page, (SELECT max(a.list_index) FROM known a WHERE a.doc_id = b.doc_id AND a.list_index < b.list_index) AS at FROM known b)
    SELECT p.doc_id, p.list_index, a.physical AS previous, p.page FROM pairs p JOIN known a ON a.doc_id = p.doc_id AND a.list_index = p.at WHERE p.page < a.physical""", "toc_items", more=True))
def q6_backward(spark, d):
    return M.backward_steps(repeated(spark, d))


@query("q7_parent_child", sql("SELECT k.doc_id, p.pre, min(k.start_page) AS first_child FROM nodes k JOIN nodes p ON p.doc_id = k.doc_id AND p.pre = k.parent_pos GROUP BY k.doc_id, p.pre, p.start_page HAVING p.start_page + k.doc_id % 3 > min(k.start_page)", "nodes"))
def q7(spark, d):
    n = D.nodes(spark, d)
    kids = n.where("parent_pos is not null").groupBy("doc_id", C("parent_pos").alias("pre")).agg(F.min("start_page").alias("first_child"))
    return n.join(kids, ["doc_id", "pre"]).where("start_page + doc_id % 3 > first_child").select("doc_id", "pre", "first_child")


ON_PAGE = "pages AS (SELECT s.*, p.text AS page_text FROM suggestions s LEFT JOIN doc_pages p ON p.doc_id = s.doc_id AND p.page_no = s.start_page)"
_PAREN = r"length(title) - length(replace(replace(title, '.', ''), '。', ''))"
E1 = f"""least(0.95, 0.3 + CASE confidence WHEN 'high' THEN 0.5 ELSE 0 END + CASE WHEN length(title) > 80 THEN 0.2 ELSE 0 END + CASE WHEN {_PAREN} >= 2 THEN 0.2 ELSE 0 END
    + CASE WHEN instr(page_text, title) > 100 THEN 0.1 ELSE 0 END + CASE WHEN regexp_matches(title, '^[0-9]+') AND length(title) > 50 THEN 0.1 ELSE 0 END)"""
E2 = f"CASE WHEN {strip_sql('title')} = {strip_sql('suggested_title')} OR rtrim(title) = rtrim(suggested_title) THEN 0.7 ELSE 0.4 END"
# Every other proposal shortens a range, the others lengthen it by a page.
NEW_END = "CASE WHEN pre % 2 = 0 THEN start_page ELSE end_page + 1 END"
E3 = f"CASE WHEN ((end_page - start_page + 1 > 15 AND {NEW_END} - start_page < end_page - start_page) OR (end_page - start_page + 1 < 3 AND {NEW_END} > end_page)) AND contains(page_text, left(title, 20)) THEN 0.6 ELSE 0.3 END"
E4 = "CASE WHEN start_page > end_page THEN 0.0 WHEN contains(page_text, left(title, 15)) THEN 0.8 ELSE 0.2 END"


VERIFY = {"DELETE": ("e1_verify_delete", E1), "MODIFY_FORMAT": ("e2_verify_format", E2), "MODIFY_PAGE": ("e3_verify_page", E3), "ADD": ("e4_verify_add", E4)}


def evidence(spark, d) -> DataFrame:
    """Proposals with the text of their start page and, by action, their score."""
    p = D.doc_pages(spark, d).select("doc_id", C("page_no").alias("start_page"), C("text").alias("page_text"))
    t, page, a, b = C("title"), C("page_text"), C("start_page"), C("end_page")
    new_end = F.when(C("pre") % 2 == 0, a).otherwise(b + 1)
    return D.suggestions(spark, d).join(p, ["doc_id", "start_page"], "left").select(
        "suggestion_id", "action", A.delete_evidence(t, page, C("confidence")).alias("DELETE"), A.format_evidence(t, C("suggested_title")).alias("MODIFY_FORMAT"),
        A.page_evidence(a, b, a, new_end, t, page).alias("MODIFY_PAGE"), A.add_evidence(t, a, b, page).alias("ADD"),
    )


def _verify(action: str, name: str, score: str) -> None:
    @query(name, tsql(ON_PAGE, f"SELECT suggestion_id, {score} AS score FROM pages WHERE action = '{action}'", "suggestions", "doc_pages"))
    def one(spark, d):
        return evidence(spark, d).where(C("action") == action).select("suggestion_id", C(action).alias("score"))


for _action, (_name, _score) in VERIFY.items():
    _verify(_action, _name, _score)


@query("e5_verify_advice", tsql(ON_PAGE, f"SELECT suggestion_id, action, CASE action WHEN 'DELETE' THEN {E1} WHEN 'MODIFY_FORMAT' THEN {E2} WHEN 'MODIFY_PAGE' THEN {E3} WHEN 'ADD' THEN {E4} END AS score FROM pages", "suggestions", "doc_pages"))
def e5(spark, d):
    score = F.coalesce(*[F.when(C("action") == a, C(a)) for a in VERIFY], F.lit(0.0))
    return evidence(spark, d).select("suggestion_id", "action", score.alias("score"))


SCORE = "CASE confidence WHEN 'high' THEN 0.9 WHEN 'medium' THEN 0.7 ELSE 0.5 END"


@query("e6_plan", sql(f"""SELECT suggestion_id, row_number() OVER (PARTITION BY doc_id ORDER BY CASE action WHEN 'DELETE' THEN 1 WHEN 'MODIFY_PAGE' THEN 2 WHEN 'MODIFY_FORMAT' THEN 3 ELSE 4 END, {SCORE} DESC, pre) AS step,
    CASE WHEN action = 'ADD' THEN 'skipped' WHEN {SCORE} >= 0.7 THEN 'run' ELSE 'below_threshold' END AS outcome FROM suggestions""", "suggestions"))
def e6(spark, d):
    return A.plan(D.suggestions(spark, d)).select("suggestion_id", "step", "outcome")


@query("e7_apply_deletes", tsql(SUB, """SELECT n.doc_id, n.pre FROM nodes n WHERE NOT EXISTS (SELECT 1 FROM sub s WHERE s.doc_id = n.doc_id AND s.pre % 5 = 3 AND s.depth > 1 AND n.pre BETWEEN s.pre AND s.last_pre)""", "nodes"))
def e7(spark, d):
    n = D.nodes(spark, d)
    return A.apply_deletes(n, H.subtree_ends(n, D.LEVELS).where("pre % 5 = 3 AND depth > 1")).select("doc_id", "pre")


@query("e8_apply_edits", sql("""SELECT n.doc_id, n.pre, CASE WHEN s.action = 'MODIFY_FORMAT' THEN s.suggested_title ELSE n.title END AS title, CASE WHEN s.action = 'MODIFY_PAGE' THEN n.end_page + 1 ELSE n.end_page END AS end_page FROM nodes n LEFT JOIN suggestions s ON s.doc_id = n.doc_id AND s.pre = n.pre""", "nodes", "suggestions"))
def e8(spark, d):
    s = A.latest_per_node(D.suggestions(spark, d), "suggestion_id").select("doc_id", "pre", "action", "suggested_title")
    title = F.when(C("action") == "MODIFY_FORMAT", C("suggested_title")).otherwise(C("title"))
    return D.nodes(spark, d).join(s, ["doc_id", "pre"], "left").select("doc_id", "pre", title.alias("title"), (C("end_page") + (F.coalesce(C("action"), F.lit("")) == "MODIFY_PAGE").cast("int")).alias("end_page"))


@query("e9_apply_inserts", sql("""SELECT doc_id, title, row_number() OVER (PARTITION BY doc_id ORDER BY place, title) AS position FROM (SELECT doc_id, title, pre * 2 AS place FROM nodes UNION ALL SELECT doc_id, suggested_title, pre * 2 + 1 FROM suggestions WHERE action = 'ADD')""", "nodes", "suggestions"))
def e9(spark, d):
    new = D.suggestions(spark, d).where("action = 'ADD'").select("doc_id", C("suggested_title").alias("title"), (C("pre") * 2 + 1).alias("at"))
    both = D.nodes(spark, d).select("doc_id", "title", (C("pre") * 2).alias("at")).unionByName(new)
    return both.select("doc_id", "title", F.row_number().over(W.partitionBy("doc_id").orderBy("at", "title")).alias("position"))


# A second reviewer's proposals for every other of the nodes that have one, another action each.
ACTIONS = ("DELETE", "MODIFY_FORMAT", "MODIFY_PAGE", "ADD")


@query("e11_conflicts", sql("""SELECT doc_id, node_id, list_sort(list(DISTINCT action)) AS actions FROM (SELECT doc_id, node_id, action FROM suggestions WHERE status = 'pending'
    UNION ALL SELECT doc_id, node_id, (['DELETE', 'MODIFY_FORMAT', 'MODIFY_PAGE', 'ADD'])[CAST((doc_id * 31 + pre + 1 + pre % 3) % 4 + 1 AS INT)] FROM suggestions WHERE pre % 2 = 0 AND status = 'pending')
    GROUP BY doc_id, node_id HAVING list_contains(list(DISTINCT action), 'DELETE') AND len(list_filter(list(DISTINCT action), lambda x: starts_with(x, 'MODIFY'))) > 0""", "suggestions"))
def e11(spark, d):
    first = D.suggestions(spark, d).select("doc_id", "node_id", "pre", "action", "status")
    other = F.get(F.array(*[F.lit(a) for a in ACTIONS]), ((C("doc_id") * 31 + C("pre") + 1 + C("pre") % 3) % 4).cast("int"))
    return A.conflicts(first.unionByName(first.where("pre % 2 = 0").withColumn("action", other)))


@query("e12_batch_review", sql("SELECT CASE WHEN status = 'pending' AND confidence = 'high' THEN 'accepted' ELSE status END AS status, count(*) AS n FROM suggestions GROUP BY 1", "suggestions"))
def e12(spark, d):
    new = F.when((C("status") == "pending") & (C("confidence") == "high"), "accepted").otherwise(C("status"))
    return D.suggestions(spark, d).groupBy(new.alias("status")).agg(F.count("*").alias("n"))


@query("e14_expand", sql("""SELECT doc_id, 'expand_' || pre || '_' || k AS id, least(greatest(start_page + k * 2 - 3, start_page), end_page) AS start_page, greatest(least(start_page + k * 2, end_page), least(greatest(start_page + k * 2 - 3, start_page), end_page)) AS end_page FROM nodes, (SELECT unnest([0, 1, 2]) AS k) WHERE end_page - start_page >= 2""", "nodes"))
def e14(spark, d):
    kids = D.nodes(spark, d).where("end_page - start_page >= 2").select("*", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("k"))
    a = F.least(F.greatest(C("start_page") + C("k") * 2 - 3, "start_page"), "end_page")
    return kids.select("doc_id", F.concat(F.lit("expand_"), C("pre").cast("string"), F.lit("_"), C("k").cast("string")).alias("id"), a.alias("start_page"), F.greatest(F.least(C("start_page") + C("k") * 2, "end_page"), a).alias("end_page"))


@query("g7_audit_facets", sql("SELECT action, confidence, count(*) AS n FROM suggestions GROUP BY GROUPING SETS ((action), (confidence))", "suggestions"))
def g7(spark, d):
    s = D.suggestions(spark, d).select("action", "confidence")
    return s.groupingSets([["action"], ["confidence"]], "action", "confidence").agg(F.count("*").alias("n"))


@query("g9_quality_score", tsql(SUB + """, done AS (SELECT doc_id, pre, action FROM suggestions WHERE status = 'accepted'), changes AS (SELECT doc_id, sum(CAST(action = 'DELETE' AS INT)) AS deleted, sum(CAST(action = 'MODIFY_FORMAT' AS INT)) AS formats, sum(CAST(action = 'MODIFY_PAGE' AS INT)) AS pages FROM done GROUP BY doc_id),
    sizes AS (SELECT doc_id, count(*) AS original_nodes, count(*) FILTER (NOT EXISTS (SELECT 1 FROM sub s JOIN done USING (doc_id, pre) WHERE action = 'DELETE' AND s.doc_id = n.doc_id AND n.pre BETWEEN s.pre AND s.last_pre)) AS optimized_nodes FROM nodes n GROUP BY doc_id)""",
    """SELECT doc_id, least(100, 60 + least(20, 4 * coalesce(deleted, 0)) + least(10, 3 * coalesce(formats, 0)) + least(10, 5 * coalesce(pages, 0))) AS score, original_nodes, optimized_nodes, (original_nodes - optimized_nodes) / original_nodes AS removal_rate FROM sizes LEFT JOIN changes USING (doc_id)""", "nodes", "suggestions"))
def g9(spark, d):
    """Points for accepted edits, and the share of nodes that the deletes among them take, with all below."""
    done = D.suggestions(spark, d).where("status = 'accepted'")
    nodes = H.subtree_ends(D.nodes(spark, d), D.LEVELS)
    left = A.apply_deletes(nodes, nodes.join(done.where("action = 'DELETE'").select("doc_id", "pre"), ["doc_id", "pre"], "left_semi"))
    return A.quality(done, nodes, left)


@query("k3_verification_budget", tsql(LEAVES, "SELECT doc_id, pre, row_number() OVER (PARTITION BY doc_id ORDER BY depth DESC, pre) <= 4 AS verify FROM leaves", "nodes"))
def k3(spark, d):
    return leaves(spark, d).select("doc_id", "pre", (F.row_number().over(W.partitionBy("doc_id").orderBy(F.desc("depth"), "pre")) <= 4).alias("verify"))


@query("k8_expand_candidates", sql("SELECT doc_id, pre, depth + 2 AS target_depth FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pre) AS rn FROM nodes n WHERE end_page - start_page + 1 > 2 AND depth <= 2) WHERE rn <= 10", "nodes"))
def k8(spark, d):
    big = D.nodes(spark, d).where("end_page - start_page + 1 > 2 AND depth <= 2").withColumn("rn", F.row_number().over(H.by_doc()))
    return big.where("rn <= 10").select("doc_id", "pre", (C("depth") + 2).alias("target_depth"))


@query("p4_chunk_size", "SELECT doc_id, CASE WHEN length(text) // 4 < 1000 THEN 50000 WHEN length(text) // 4 < 3000 THEN 100000 ELSE 150000 END AS chunk FROM documents")
def p4(spark, d):
    n = T.estimate_tokens_simple(C("text"))
    return D.table(spark, d, "documents").select("doc_id", F.when(n < 1000, 50000).when(n < 3000, 100000).otherwise(150000).alias("chunk"))


@query("p5_text_chunks", "SELECT doc_id, CAST(k AS INT) AS k, substr(text, k * 8000 + 1, 8000) AS chunk FROM (SELECT doc_id, text, unnest(generate_series(0, (length(text) - 1) // 8000)) AS k FROM documents WHERE length(text) > 0)")
def p5(spark, d):
    docs = D.table(spark, d, "documents").where("length(text) > 0")
    return docs.select("doc_id", "text", F.explode(F.sequence(F.lit(0), F.floor((F.length("text") - 1) / 8000).cast("int"))).alias("k")).select("doc_id", "k", F.substring("text", C("k") * 8000 + 1, F.lit(8000)).alias("chunk"))


GROUPED = """numbered AS (SELECT doc_id, page_no, tokens, row_number() OVER (PARTITION BY doc_id ORDER BY page_no) AS n, {cap} AS cap FROM doc_pages),
    step AS (SELECT doc_id, n, [{{'p': page_no, 't': tokens}}] AS open, CAST(tokens AS BIGINT) AS s, CAST(NULL AS INT[]) AS closed, cap FROM numbered WHERE n = 1
    UNION ALL SELECT a.doc_id, b.n, CASE WHEN a.s + b.tokens > a.cap AND {full} THEN list_append(a.open[len(a.open) - {keep} + 1 : len(a.open)], {{'p': b.page_no, 't': b.tokens}}) ELSE list_append(a.open, {{'p': b.page_no, 't': b.tokens}}) END,
    CASE WHEN a.s + b.tokens > a.cap AND {full} THEN b.tokens + CAST(coalesce(list_sum(list_transform(a.open[len(a.open) - {keep} + 1 : len(a.open)], lambda x: x.t)), 0) AS BIGINT) ELSE a.s + b.tokens END,
    CASE WHEN a.s + b.tokens > a.cap AND {full} THEN list_transform(a.open, lambda x: x.p) END, a.cap FROM step a JOIN numbered b ON b.doc_id = a.doc_id AND b.n = a.n + 1),
    groups AS (SELECT doc_id, n, closed AS pages FROM step WHERE closed IS NOT NULL UNION SELECT doc_id, n + 1, list_transform(open, lambda x: x.p) FROM (SELECT *, max(n) OVER (PARTITION BY doc_id) AS last FROM step) WHERE n = last)"""


@query("p1_group_pages", tsql(GROUPED.format(cap=400, full="a.s > 0", keep=0), "SELECT doc_id, CAST(unnest(pages) AS INT) AS page_no, CAST(group_no AS INT) AS group_no FROM (SELECT doc_id, pages, row_number() OVER (PARTITION BY doc_id ORDER BY n) AS group_no FROM groups)", "doc_pages"))
def p1(spark, d):
    """Greedy groups of pages by tokens: a fold over each document's own array, in the JVM, that notes only where groups start."""
    pages = D.doc_pages(spark, d).groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("page_no", "tokens"))).alias("pages"))
    starts = F.expr(
        """aggregate(pages, named_struct('sum', 0L, 'at', 0, 'starts', array(1)), (a, p) -> if(a.sum + p.tokens > 400 AND a.sum > 0,
            named_struct('sum', cast(p.tokens as bigint), 'at', a.at + 1, 'starts', array_append(a.starts, a.at + 1)),
            named_struct('sum', a.sum + p.tokens, 'at', a.at + 1, 'starts', a.starts)), a -> a.starts)"""
    )
    groups = pages.select("doc_id", "pages", starts.alias("starts")).select("doc_id", "pages", "starts", F.posexplode("starts").alias("g", "start"))
    own = F.expr("slice(pages, start, coalesce(get(starts, g + 1), size(pages) + 1) - start)")
    return groups.select("doc_id", (C("g") + 1).alias("group_no"), F.inline(own)).select("doc_id", "page_no", "group_no")


@query("p7_large_nodes", tsql(NODE_TEXT, "SELECT doc_id, pre, tokens FROM node_text WHERE span >= 15 OR tokens > 2500", "nodes", "doc_pages"))
def p7(spark, d):
    big = H.node_text(D.nodes(spark, d), D.doc_pages(spark, d)).join(D.nodes(spark, d).select("doc_id", "pre", (C("end_page") - C("start_page") + 1).alias("span")), ["doc_id", "pre"])
    return big.where("span >= 15 OR tokens > 2500").select("doc_id", "pre", "tokens")
