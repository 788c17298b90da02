"""Queries over the catalog, logs, sets and streams (ids S, J12 to J21, G6 to G18, K, R, T), each with its SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window as W, functions as F

from leafspan.functions import text as T
from leafspan.operators import catalog as O, tables as X
from leafspan.plans import derive as D
from leafspan.plans.derive import sql
from leafspan.plans.text_queries import STATUS
from leafspan.streaming import streams as ST

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


@query("s1_catalog_page", "SELECT doc_id, lang, source FROM documents WHERE lang = 'en' ORDER BY n_chars DESC, doc_id LIMIT 20 OFFSET 10")
def s1(spark, d):
    return D.table(spark, d, "documents").where("lang = 'en'").orderBy(F.desc("n_chars"), "doc_id").select("doc_id", "lang", "source").offset(10).limit(20)


@query("s2_pages", sql("SELECT * FROM doc_pages", "doc_pages"))
def s2(spark, d):
    return D.doc_pages(spark, d)


@query("s3_file_types", """SELECT doc_id, CASE WHEN regexp_matches(name, '(?i)\\.pdf$') THEN 'pdf' WHEN regexp_matches(name, '(?i)\\.(md|markdown)$') THEN 'markdown' END AS file_type FROM (
    SELECT doc_id, 'f' || doc_id || (['.PDF', '.md', '.Markdown', '.txt'])[CAST(doc_id % 4 + 1 AS INT)] AS name FROM documents)""")
def s3(spark, d):
    name = F.concat(F.lit("f"), C("doc_id").cast("string"), F.element_at(F.array(*[F.lit(x) for x in (".PDF", ".md", ".Markdown", ".txt")]), (C("doc_id") % 4 + 1).cast("int")))
    kind = F.when(F.lower(name).rlike(r"\.pdf$"), "pdf").when(F.lower(name).rlike(r"\.(md|markdown)$"), "markdown")
    return D.table(spark, d, "documents").select("doc_id", kind.alias("file_type"))


@query("s5_nested_trees", sql("", "nodes").rstrip() + """, seen AS (SELECT *, lag(depth) OVER w AS above, lead(depth) OVER w AS below, substr(to_json({'id': node_id, 'title': title, 'ps': start_page, 'pe': end_page}), 1) AS j FROM nodes WINDOW w AS (PARTITION BY doc_id ORDER BY pre))
    SELECT doc_id, '{"id":"root","children":[' || string_agg(CASE WHEN above >= depth THEN ',' ELSE '' END || CASE WHEN below > depth THEN left(j, length(j) - 1) || ',"children":[' ELSE j || repeat(']}', depth - coalesce(below, 1)) END, '' ORDER BY pre) || ']}' AS tree FROM seen GROUP BY doc_id""")
def s5(spark, d):
    from leafspan.sources.trees import nested_trees

    return nested_trees(D.nodes(spark, d), D.LEVELS)


@query("s4_trees_read_back", sql("SELECT doc_id, node_id, depth, title, start_page, end_page FROM nodes", "nodes"))
def s4(spark, d):
    """The trees as nested JSON, read again by the reader of tree files."""
    from leafspan.sources.trees import flat_trees, nested_trees

    own = nested_trees(D.nodes(spark, d), D.LEVELS).select("doc_id", C("tree").alias("value"))
    return flat_trees(own, "doc_id", D.LEVELS).select("doc_id", "node_id", "depth", "title", "start_page", "end_page")


@query("s6_sink_suggestions", sql("SELECT doc_id, suggestion_id, action, coalesce(nullif(status, 'rejected'), 'pending') AS status FROM suggestions", "suggestions"))
def s6(spark, d):
    """Suggestions appended to a table by buckets of their document, those without a status as pending, and read again."""
    from leafspan.sources.trees import with_bucket

    own = D.suggestions(spark, d).select("doc_id", "suggestion_id", "action", F.when(C("status") != "rejected", C("status")).alias("status"))
    return with_bucket(own).where("bucket BETWEEN 0 AND 15").select("doc_id", "suggestion_id", "action", "status")


BACKUPS = "backups AS (SELECT o_orderkey AS backup_id, o_custkey AS doc_id, o_orderdate AS created_at FROM orders)"


def backups(spark, d) -> DataFrame:
    return D.table(spark, d, "orders").select(C("o_orderkey").alias("backup_id"), C("o_custkey").alias("doc_id"), C("o_orderdate").alias("created_at"))


@query("j12_orphans", f"WITH {BACKUPS} SELECT doc_id, count(*) AS orphans FROM backups WHERE doc_id NOT IN (SELECT doc_id FROM documents) GROUP BY doc_id")
def j12(spark, d):
    return backups(spark, d).join(D.table(spark, d, "documents").select("doc_id"), "doc_id", "left_anti").groupBy("doc_id").agg(F.count("*").alias("orphans"))


@query("j13_cascade_delete", "SELECT 'documents' AS \"table\", count(*) AS removed FROM documents WHERE doc_id % 10 = 3 UNION ALL SELECT 'labels', count(*) FROM labels WHERE doc_id % 10 = 3")
def j13(spark, d):
    docs, labels = D.table(spark, d, "documents"), D.table(spark, d, "labels")
    return O.cascade_delete(docs.where("doc_id % 10 = 3").select("doc_id"), {"documents": docs, "labels": labels})[1]


def pairs(spark, d) -> tuple[DataFrame, DataFrame]:
    """The sections of each tree, and of a version of it in which titles have changed."""
    n = D.nodes(spark, d).select(C("doc_id").alias("pair"), "pre", "title")
    changed = F.when(C("pre") % 3 == 0, F.concat(C("title"), F.lit(" extra"))).when(C("pre") % 3 == 1, F.reverse("title")).otherwise(C("title"))
    return n, n.withColumn("title", changed)


MATCHES = """versions AS (SELECT doc_id AS pair, pre, 0 AS side, title FROM nodes UNION ALL SELECT doc_id, pre, 1, CASE pre % 3 WHEN 0 THEN title || ' extra' WHEN 1 THEN reverse(title) ELSE title END FROM nodes),
    titles AS (SELECT pair, pre, side, lower(trim(title)) AS t, list_distinct(list_filter(string_split(lower(trim(title)), ' '), lambda x: x <> '')) AS w FROM versions),
    scored AS (SELECT a.pair, a.pre, b.pre AS other_pre, CASE WHEN a.t = b.t THEN 1.0 ELSE len(list_intersect(a.w, b.w)) / len(list_distinct(list_concat(a.w, b.w))) END AS similarity
    FROM titles a JOIN titles b ON a.pair = b.pair AND a.side = 0 AND b.side = 1 WHERE len(list_intersect(a.w, b.w)) > 0),
    matched AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY pair, pre ORDER BY similarity DESC, other_pre) AS rn FROM scored WHERE similarity > 0.5) WHERE rn = 1)"""


@query("j14_best_matches", sql("", "nodes").rstrip() + ",\n" + MATCHES + " SELECT pair, pre, other_pre, similarity FROM matched")
def j14(spark, d):
    return O.best_matches(*pairs(spark, d))


@query("j15_difference_notes", sql("", "nodes").rstrip() + ",\n" + MATCHES + """ SELECT m.pair, m.pre, list_filter([CASE WHEN length(a.s) > length(b.s) THEN '文档1的摘要更详细' WHEN length(b.s) > length(a.s) THEN '文档2的摘要更详细' WHEN a.s <> b.s THEN '摘要内容不同' END,
    CASE WHEN abs(a.p - b.p) > 5 THEN '起始页码差异较大: ' || a.p || ' vs ' || b.p END], lambda x: x IS NOT NULL) AS notes FROM matched m
    JOIN (SELECT doc_id AS pair, pre, title AS s, start_page AS p FROM nodes) a USING (pair, pre)
    JOIN (SELECT doc_id AS pair, pre AS other_pre, CASE pre % 4 WHEN 0 THEN '' WHEN 1 THEN title || ' more' WHEN 2 THEN reverse(title) ELSE title END AS s, start_page + pre % 9 AS p FROM nodes) b USING (pair, other_pre)""")
def j15(spark, d):
    """What differs between matched sections of two versions: which summary says more, and starts over five pages apart."""
    left, right = pairs(spark, d)
    own = lambda s, p: [s.alias("summary"), p.alias("start_page")]
    n = D.nodes(spark, d)
    k = C("pre") % 4
    other = F.when(k == 0, F.lit(None)).when(k == 1, F.concat("title", F.lit(" more"))).when(k == 2, F.reverse("title")).otherwise(C("title"))
    a = n.select(C("doc_id").alias("pair"), "pre", *own(C("title"), C("start_page")))
    b = n.select(C("doc_id").alias("pair"), C("pre").alias("other_pre"), *own(other, C("start_page") + C("pre") % 9))
    return O.difference_notes(O.best_matches(left, right), a, b).select("pair", "pre", "notes")


@query("g11_comparison", sql("", "nodes").rstrip() + ",\n" + MATCHES + " SELECT pair, avg(similarity) AS mean, count(*) FILTER (similarity > 0.8) AS high, count(*) FILTER (similarity > 0.5 AND similarity <= 0.8) AS middle FROM matched GROUP BY pair")
def g11(spark, d):
    n = lambda c: F.sum(c.cast("int"))
    s = C("similarity")
    return O.best_matches(*pairs(spark, d)).groupBy("pair").agg(F.avg(s).alias("mean"), n(s > 0.8).alias("high"), n((s > 0.5) & (s <= 0.8)).alias("middle"))


@query("j16_set_search", sql("""SELECT source, doc_id, pre, relevance FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pre) AS rn FROM (
    SELECT source, n.doc_id, pre, CASE WHEN contains(lower(n.title), 'the') THEN 0.8 ELSE 0 END + CASE WHEN contains(lower(p.text), 'that') THEN 0.4 ELSE 0 END AS relevance
    FROM nodes n JOIN documents USING (doc_id) JOIN doc_pages p ON p.doc_id = n.doc_id AND p.page_no = n.start_page) WHERE relevance > 0) WHERE rn <= 5""", "nodes", "doc_pages"))
def j16(spark, d):
    n = D.nodes(spark, d).join(D.table(spark, d, "documents").select("doc_id", "source"), "doc_id").join(D.doc_pages(spark, d).select("doc_id", C("page_no").alias("start_page"), "text"), ["doc_id", "start_page"])
    score = F.when(F.contains(F.lower("title"), F.lit("the")), 0.8).otherwise(0.0) + F.when(F.contains(F.lower("text"), F.lit("that")), 0.4).otherwise(0.0)
    hits = n.select("source", "doc_id", "pre", score.alias("relevance")).where("relevance > 0")
    return O.newest(hits, "doc_id", 5, "pre")


@query("j17_merged_tree", sql("SELECT source, doc_id || ':' || node_id AS id, title, start_page FROM nodes JOIN documents USING (doc_id)", "nodes"))
def j17(spark, d):
    n = D.nodes(spark, d).join(D.table(spark, d, "documents").select("doc_id", "source"), "doc_id")
    return n.select("source", F.concat_ws(":", "doc_id", "node_id").alias("id"), "title", "start_page")


@query("j18_catalog_results", "SELECT d.doc_id, d.source, l.quality, l.toxic FROM documents d LEFT JOIN labels l USING (doc_id)")
def j18(spark, d):
    return D.table(spark, d, "documents").join(D.table(spark, d, "labels"), "doc_id", "left").select("doc_id", "source", "quality", "toxic")


@query("j19_page_fetch", sql("SELECT doc_id, page_no, CASE WHEN length(trim(text)) < 50 AND page_no % 2 = 0 THEN 'ocr ' || page_no ELSE text END AS text FROM doc_pages WHERE page_no BETWEEN 2 AND 5", "doc_pages"))
def j19(spark, d):
    p = D.doc_pages(spark, d).where("page_no BETWEEN 2 AND 5")
    ocr = p.where("page_no % 2 = 0").select("doc_id", "page_no", F.concat(F.lit("ocr "), C("page_no").cast("string")).alias("ocr"))
    text = F.when((F.length(F.trim("text")) < 50) & C("ocr").isNotNull(), C("ocr")).otherwise(C("text"))
    return p.join(ocr, ["doc_id", "page_no"], "left").select("doc_id", "page_no", text.alias("text"))


@query("j20_metadata_search", "SELECT doc_id, source, n_chars FROM documents JOIN labels USING (doc_id) WHERE lang = 'en' AND quality = 1 AND n_chars > 1000")
def j20(spark, d):
    labels = D.table(spark, d, "labels").where("quality = 1").select("doc_id")
    return D.table(spark, d, "documents").where("lang = 'en' AND n_chars > 1000").join(labels, "doc_id").select("doc_id", "source", "n_chars")


@query("j21_title_update", sql("SELECT doc_id, pre, CASE WHEN pre = (SELECT min(pre) FROM nodes m WHERE m.doc_id = n.doc_id AND m.node_id = '1') THEN 'Updated' ELSE title END AS title FROM nodes n", "nodes"))
def j21(spark, d):
    n = D.nodes(spark, d)
    first = O.newest(n.where("node_id = '1'"), "doc_id", 1, "pre").select("doc_id", "pre", F.lit("Updated").alias("new"))
    return n.join(first, ["doc_id", "pre"], "left").select("doc_id", "pre", F.coalesce("new", "title").alias("title"))


@query("g6_performance", sql("SELECT operation, count(*) AS calls, sum(CAST(NOT success AS INT)) AS errors, sum(tokens) AS tokens, sum(duration_ms) AS duration_ms FROM call_log GROUP BY ROLLUP (operation)", "call_log"))
def g6(spark, d):
    return D.call_log(spark, d).rollup("operation").agg(F.count("*").alias("calls"), F.sum((~C("success")).cast("int")).alias("errors"), F.sum("tokens").alias("tokens"), F.sum("duration_ms").alias("duration_ms"))


@query("g8_advice_summary", sql("SELECT action, sum(CAST(confidence = 'high' AS INT)) AS high, sum(CAST(confidence = 'medium' AS INT)) AS medium, sum(CAST(confidence NOT IN ('high', 'medium') AS INT)) AS low FROM suggestions GROUP BY action", "suggestions"))
def g8(spark, d):
    n = lambda c: F.sum(c.cast("int"))
    k = C("confidence")
    return D.suggestions(spark, d).groupBy("action").agg(n(k == "high").alias("high"), n(k == "medium").alias("medium"), n(~k.isin("high", "medium")).alias("low"))


@query("g12_backups", f"WITH {BACKUPS} SELECT doc_id, count(*) AS n FROM backups GROUP BY doc_id")
def g12(spark, d):
    return backups(spark, d).groupBy("doc_id").agg(F.count("*").alias("n"))


@query("g13_document_score", """SELECT label, round(sum(s) / sqrt(count(*) + 1), 5) AS score FROM (SELECT label, list_dot_product(embedding::DOUBLE[], q) / (sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) * sqrt(list_dot_product(q, q))) AS s
    FROM embeddings, (SELECT embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id = 0) WHERE vec_id <> 0) GROUP BY label""")
def g13(spark, d):
    e = D.table(spark, d, "embeddings").withColumn("e", C("embedding").cast("array<double>"))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    q = F.broadcast(e.where("vec_id = 0").select(C("e").alias("q")).limit(1))  # one vector
    scored = e.where("vec_id <> 0").join(q).select("label", (dot("e", "q") / (F.sqrt(dot("e", "e")) * F.sqrt(dot("q", "q")))).alias("s"))
    return scored.groupBy("label").agg(F.round(F.sum("s") / F.sqrt(F.count("*") + 1), 5).alias("score"))


@query("g14_timeline", sql(f"SELECT {STATUS} AS status, count(*) AS n, min(start_date) AS first_start FROM timeline WHERE CASE budget_unit WHEN '元' THEN budget / 10000 WHEN '亿元' THEN budget * 10000 ELSE budget END BETWEEN 1 AND 200000 GROUP BY 1", "timeline"))
def g14(spark, d):
    t = D.timeline(spark, d).where(T.budget_in_wan(C("budget"), C("budget_unit")).between(1, 200000))
    return t.groupBy(T.timeline_status(C("start_date"), C("end_date"), F.lit("1997-06-01").cast("date")).alias("status")).agg(F.count("*").alias("n"), F.min("start_date").alias("first_start"))


@query("g18_section_words", "SELECT source, count(*) AS sections, sum(length(text)) AS word_count, max(doc_id) AS last_doc FROM documents GROUP BY source")
def g18(spark, d):
    return D.table(spark, d, "documents").groupBy("source").agg(F.count("*").alias("sections"), F.sum(F.length("text")).alias("word_count"), F.max("doc_id").alias("last_doc"))


@query("g20_ocr_coverage", sql("SELECT doc_id, count(*) AS total, sum(CAST(page_no % 3 <> 0 AS INT)) AS cached, sum(CAST(page_no % 3 <> 0 AS INT)) >= count(*) AS all_cached FROM doc_pages GROUP BY doc_id", "doc_pages"))
def g20(spark, d):
    hit = F.sum((C("page_no") % 3 != 0).cast("int"))
    return D.doc_pages(spark, d).groupBy("doc_id").agg(F.count("*").alias("total"), hit.alias("cached"), (hit >= F.count("*")).alias("all_cached"))


@query("k1_latest_report", f"WITH {BACKUPS} SELECT doc_id, max(created_at) AS created_at FROM backups GROUP BY doc_id")
def k1(spark, d):
    return backups(spark, d).groupBy("doc_id").agg(F.max("created_at").alias("created_at"))


@query("k2_retention", f"WITH {BACKUPS} SELECT doc_id, backup_id FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY created_at DESC, backup_id DESC) AS rn FROM backups) WHERE rn <= 3")
def k2(spark, d):
    return O.newest(backups(spark, d), "doc_id", 3, F.desc("created_at"), F.desc("backup_id")).select("doc_id", "backup_id")


@query("k4_conversation_history", "SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS rn FROM conversations) WHERE rn <= 4")
def k4(spark, d):
    return O.newest(D.table(spark, d, "conversations"), "conv_id", 4, "turn", "role", "text").select("conv_id", "turn", "role")


@query("k5_call_log", sql("SELECT log_id, operation, tokens FROM (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY created_at, log_id) AS rn FROM call_log WHERE operation <> 'error') WHERE rn <= 10", "call_log"))
def k5(spark, d):
    return O.newest(D.call_log(spark, d).where("operation <> 'error'"), "document_id", 10, "created_at", "log_id").select("log_id", "operation", "tokens")


@query("k6_suggestions", sql("SELECT suggestion_id FROM suggestions WHERE action = 'DELETE' AND status = 'pending' AND confidence = 'high'", "suggestions"))
def k6(spark, d):
    return D.suggestions(spark, d).where("action = 'DELETE' AND status = 'pending' AND confidence = 'high'").select("suggestion_id")


# What was learned of each document's own contents: named patterns, two or three a document, one of which is broken.
LEARNED = (
    ("dotted", r"^\d+(\.\d+)*\s+.+?\s*\.{3,}\s*\d+"),
    ("chapter", r"^第[一二三四五六七八九十\d]+章\s+.+?\s+\.{3,}\s*\d+"),
    ("spaced", r"^\d+(\.\d+)*\s+.+?\s{2,}\d+\s*$"),
    ("broken", r"^(\d+"),
    ("part", r"^Part\s+\d+.*\d+$"),
)
# Lines of contents laid behind the pages, none to thirteen, in the forms in turn.
_LINES = """transform(sequence(1, CAST((doc_id + page_no * 5) % 14 AS INT)), k -> CASE CAST((doc_id + k) % 4 AS INT) WHEN 0 THEN k || '.' || (k + 1) || ' ' || replace(left(text, 8), '\n', ' ') || ' .... ' || (page_no + k) WHEN 1 THEN '第三章 ' || k || ' .... ' || k WHEN 2 THEN '  ' || k || ' x   ' || (page_no + k) ELSE 'Part ' || k || ' on ' || page_no END)"""


def listed_pages(spark, d) -> DataFrame:
    """(doc_id, page_no, text) of pages with lines of contents laid behind; pages without any stay."""
    more = F.when((C("doc_id") + C("page_no") * 5) % 14 > 0, F.concat(F.lit("\n"), F.array_join(F.expr(_LINES), "\n"))).otherwise("")
    return D.doc_pages(spark, d).select("doc_id", "page_no", F.concat("text", more).alias("text"))


def learned(spark, d) -> DataFrame:
    forms = F.array(*[F.struct(F.lit(k).alias("position"), F.lit(name).alias("name"), F.lit(regex).alias("regex")) for k, (name, regex) in enumerate(LEARNED)])
    return D.table(spark, d, "documents").select("doc_id", F.inline(F.filter(forms, lambda f: (C("doc_id") + f["position"]) % 3 != 0)))


_LISTED = "listed AS (SELECT doc_id, page_no, text || CASE WHEN (doc_id + page_no * 5) % 14 > 0 THEN chr(10) || array_to_string(" + _LINES.replace("transform(sequence(", "list_transform(generate_series(").replace("k -> ", "lambda k: ").replace("'\\n'", "chr(10)") + ", chr(10)) ELSE '' END AS text FROM doc_pages)"
_KNOWN = ", ".join(f"({k}, '{name}', '{regex}')" for k, (name, regex) in enumerate(LEARNED) if name != "broken")


@query("k9_nested_toc", sql("", "doc_pages").rstrip() + ",\n" + _LISTED + f""", known AS (SELECT * FROM (VALUES {_KNOWN}) t(position, name, regex)),
    lines AS (SELECT doc_id, page_no, trim(unnest(string_split(text, chr(10)))) AS line FROM listed WHERE page_no > 1),
    hits AS (SELECT doc_id, page_no, position, name, count(*) AS n FROM lines, known WHERE (doc_id + position) % 3 <> 0 AND line <> '' AND regexp_matches(line, regex) GROUP BY ALL HAVING count(*) >= 3),
    found AS (SELECT doc_id, page_no, list(name ORDER BY position) AS matched_patterns, sum(n)::INT AS match_count FROM hits GROUP BY ALL)
    SELECT * EXCLUDE (rn) FROM (SELECT *, CASE WHEN match_count >= 10 THEN 'high' WHEN match_count >= 5 THEN 'medium' ELSE 'low' END AS confidence, row_number() OVER (PARTITION BY doc_id ORDER BY page_no) AS rn FROM found) WHERE rn <= 5""")
def k9(spark, d):
    return X.nested_contents(listed_pages(spark, d), learned(spark, d), after_page=1)


_LAID = "CASE page_no % 5 WHEN 0 THEN 'Contents' || chr(10) || '1. One ..... 3' || chr(10) || '1.1 Two ..... 4' || chr(10) || text WHEN 1 THEN 'List of Figures' || chr(10) || text WHEN 2 THEN 'Abstract' || chr(10) || text ELSE text END"


_SCORED = r"""CASE WHEN regexp_matches(t, '(?im)^\s*(?:table of contents|contents|目\s*录)\s*$') THEN 35 WHEN regexp_matches(t, '(?i)contents|目录') THEN 15 ELSE 0 END
    + CASE WHEN cited > 10 THEN 40 WHEN cited >= 5 THEN 25 WHEN cited >= 2 THEN 15 ELSE 0 END + CASE WHEN regexp_matches(t, '(?m)^\s*[0-9]+\.[0-9]+(?:\s|\.)') THEN 15 ELSE 0 END
    + CASE WHEN contains(t, '....') OR contains(t, '. . . . ') OR contains(t, '……') THEN 10 ELSE 0 END - CASE WHEN regexp_matches(t, '(?i)list of (?:figures|tables)|图目录|表目录') THEN 30 ELSE 0 END
    - CASE WHEN regexp_matches(t, '(?im)^\s*(?:abstract|摘要)\s*$') THEN 30 ELSE 0 END - CASE WHEN length(t) < 50 OR length(t) > 10000 THEN 10 ELSE 0 END"""
_CITED = r"""len(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '\S[\s.\-–—…·:：]+(?:第|p\.)?\s*[0-9]{1,4}\s*页?\s*$')))"""


@query("k11_toc_score", sql(f"SELECT doc_id, page_no, {_SCORED} AS score FROM (SELECT *, {_CITED} AS cited FROM (SELECT doc_id, page_no, {_LAID} AS t FROM doc_pages))", "doc_pages"))
def k11(spark, d):
    laid = F.expr(_LAID.replace("chr(10)", "'\\n'"))
    return D.doc_pages(spark, d).select("doc_id", "page_no", laid.alias("t")).select("doc_id", "page_no", T.toc_score(C("t")).alias("score"))


# Runs of contents pages laid over the documents: one from the second to the fifth page on, another from the ninth, and in long ones one over the twentieth page.
_RUNS = "CASE WHEN page_no BETWEEN 2 + doc_id % 4 AND 3 + doc_id % 6 OR page_no BETWEEN 9 AND 10 OR (doc_id % 6 = 3 AND page_no BETWEEN 19 AND 24) THEN 'Contents' || chr(10) || '1.1 One ..... 3' || chr(10) || '1.2 Two ..... 4' || chr(10) || text ELSE text END"


@query("k10_first_run", sql("", "doc_pages").rstrip() + f""",
    laid AS (SELECT doc_id, page_no, {_RUNS} AS t FROM doc_pages), scored AS (SELECT doc_id, page_no, {_SCORED} AS score FROM (SELECT *, {_CITED} AS cited FROM laid)),
    runs AS (SELECT doc_id, page_no, page_no - row_number() OVER (PARTITION BY doc_id ORDER BY page_no) AS run FROM scored WHERE score >= 70)
    SELECT doc_id, arg_min(a, a) AS first_page, arg_min(b, a) AS last_page FROM (SELECT doc_id, min(page_no) AS a, max(page_no) AS b FROM runs GROUP BY doc_id, run) WHERE a <= 20 GROUP BY doc_id""")
def k10(spark, d):
    """The first run of pages that score as contents."""
    laid = F.expr(_RUNS.replace("chr(10)", "'\\n'"))
    return X.first_run(D.doc_pages(spark, d).select("doc_id", "page_no", laid.alias("t")), T.toc_score(C("t")) >= 70)


@query("r1_split_debug", "SELECT conv_id, turn, left(text, 500) AS output FROM conversations WHERE role = 'assistant' AND text IS NOT NULL")
def r1(spark, d):
    return D.table(spark, d, "conversations").where("role = 'assistant' AND text IS NOT NULL").select("conv_id", "turn", F.left("text", F.lit(500)).alias("output"))


@query("r2_schema_evolution", "SELECT conv_id, turn, NULL::VARCHAR AS model FROM conversations UNION ALL SELECT conv_id, turn, 'm1' FROM conversations WHERE turn = 0")
def r2(spark, d):
    c = D.table(spark, d, "conversations").select("conv_id", "turn")
    return c.unionByName(c.where("turn = 0").withColumn("model", F.lit("m1")), allowMissingColumns=True)


@query("r3_latest_wins", """SELECT doc_id, arg_max(source, step) AS source, arg_max(n_chars, step) AS n_chars FROM (SELECT doc_id, source, n_chars, 0 AS step FROM documents UNION ALL SELECT doc_id, 'a', NULL, 1 FROM documents WHERE doc_id % 2 = 0
    UNION ALL SELECT doc_id, 'b', NULL, 2 FROM documents WHERE doc_id % 3 = 0) GROUP BY doc_id""")
def r3(spark, d):
    docs = D.table(spark, d, "documents").select("doc_id", "source", "n_chars")
    a = docs.where("doc_id % 2 = 0").select("doc_id", F.lit("a").alias("source"), F.lit(1).alias("at"))
    b = docs.where("doc_id % 3 = 0").select("doc_id", F.lit("b").alias("source"), F.lit(2).alias("at"))
    return O.latest_wins(docs, a.unionByName(b), "doc_id", "at")


@query("r4_tags", "SELECT tag, count(*) AS n FROM (SELECT unnest([lang, source]) AS tag FROM documents) GROUP BY tag")
def r4(spark, d):
    stored = D.table(spark, d, "documents").select(F.to_json(F.array("lang", "source")).alias("tags"))
    return stored.select(F.explode(F.from_json("tags", "array<string>")).alias("tag")).groupBy("tag").agg(F.count("*").alias("n"))


@query("t1_latest_status", "SELECT user_id, arg_max(event_type, (ts, event_id)) AS status, max(ts) AS updated FROM events GROUP BY user_id")
def t1(spark, d):
    return ST.latest_status(D.table(spark, d, "events"))


@query("t2_progress", "SELECT event_id, user_id AS document_id, event_id % 7 + 1 AS phase, (event_id % 7 + 1) / 7 * 100 AS pct FROM (SELECT DISTINCT event_id, user_id FROM events)")
def t2(spark, d):
    return ST.progress(D.table(spark, d, "events"))


@query("t3_call_metrics", sql("SELECT date_trunc('hour', created_at) AS window_start, operation, count(*) AS calls, sum(CAST(NOT success AS INT)) AS failures, sum(tokens) AS tokens, sum(duration_ms) AS duration_ms FROM call_log GROUP BY 1, 2", "call_log"))
def t3(spark, d):
    return ST.call_metrics(D.call_log(spark, d))


@query("t4_sessions", """SELECT user_id, min(ts) AS started, max(ts) + INTERVAL 30 MINUTE AS ended, count(*) AS events FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM (
    SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) >= INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS new FROM events)) GROUP BY user_id, s""")
def t4(spark, d):
    return ST.sessions(D.table(spark, d, "events"))


@query("t4_silences", """SELECT user_id, ts AS last_seen, ts + INTERVAL 30 MINUTE AS silent_at FROM (SELECT *, lead(ts) OVER (PARTITION BY user_id ORDER BY ts) AS later, max(ts) OVER () AS newest FROM events)
    WHERE later - ts >= INTERVAL 30 MINUTE OR (later IS NULL AND ts + INTERVAL 30 MINUTE < newest - INTERVAL 2 HOUR)""")
def t4_silences(spark, d):
    """Runs as a stream over the events that are there, with timers."""
    schema = D.table(spark, d, "events").schema
    # A pattern, as a stream takes a file itself for a folder.
    stream = spark.readStream.schema(schema).parquet(f"{d}/event[s].parquet")
    found = ST.run_to_table(ST.silences(stream), f"{D.shared_folder(spark)}/t4-{uuid.uuid4().hex}")
    return found.select("user_id", *[C(c).cast("timestamp_ntz").alias(c) for c in ("last_seen", "silent_at")])


@query("e15_set_members", "SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) = 1 AS is_primary FROM documents WHERE doc_id % 7 <> 0")
def e15(spark, d):
    """Sets by source; removing a primary document promotes the next one: the smallest id a set, found before the shuffle, not a sort of each set."""
    left = D.table(spark, d, "documents").where("doc_id % 7 <> 0").select("source", "doc_id")
    return left.join(left.groupBy("source").agg(F.min("doc_id").alias("first")), "source").select("source", "doc_id", (C("doc_id") == C("first")).alias("is_primary"))


@query("e17_budget_upsert", sql("SELECT entry_id, CASE WHEN rn = 1 AND document_id % 2 = 0 THEN 42.5 ELSE budget END AS budget FROM (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY start_date, entry_id) AS rn FROM timeline)", "timeline"))
def e17(spark, d):
    t = D.timeline(spark, d).withColumn("rn", F.row_number().over(W.partitionBy("document_id").orderBy("start_date", "entry_id")))
    raw = F.lit('```json\n{"budget": 42.5, "unit": "万元",}\n```')
    found = t.where("rn = 1 AND document_id % 2 = 0").select("entry_id", F.from_json(T.answer_json(raw), "budget double, unit string").alias("a")).select("entry_id", C("a.budget").alias("new"))
    return t.join(found, "entry_id", "left").select("entry_id", F.coalesce("new", "budget").alias("budget"))
