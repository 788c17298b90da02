"""Queries of the per-row text rules (ids B1 to B41), each with its SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from leafspan.functions import text as T
from leafspan.operators import tables as X
from leafspan.plans import derive as D
from leafspan.plans.derive import sql

C = F.col
QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, text: str):
    def add(f):
        QUERIES[name] = f
        SQL[name] = text
        return f

    return add


_TOK = D._TOKENS


@query("b1_estimate_tokens", f"SELECT doc_id, {_TOK.format('text')} AS tokens FROM documents WHERE text IS NOT NULL")
def b1(spark, d) -> DataFrame:
    return D.table(spark, d, "documents").where("text is not null").select("doc_id", T.estimate_tokens(C("text")).alias("tokens"))


@query("b2_estimate_tokens_simple", "SELECT doc_id, length(text) // 4 AS tokens FROM documents")
def b2(spark, d) -> DataFrame:
    return D.table(spark, d, "documents").select("doc_id", T.estimate_tokens_simple(C("text")).alias("tokens"))


@query(
    "b3_clean_leaders",
    sql(
        r"""SELECT doc_id, list_index, regexp_replace(regexp_replace(line, '\.{5,}', ': ', 'g'), '(?:\. ){5,}\.?', ': ', 'g') AS cleaned,
        regexp_replace(regexp_replace(line, '\.{4,}', ': ', 'g'), '(?:\. )\.{3,}', ': ', 'g') AS cleaned_detector
        FROM (SELECT doc_id, list_index, title || CASE list_index % 3 WHEN 0 THEN '........' WHEN 1 THEN '. . . . . . ' ELSE '. ....' END || page AS line FROM toc_items)""",
        "toc_items",
    ),
)
def b3(spark, d) -> DataFrame:
    leader = F.when(C("list_index") % 3 == 0, "........").when(C("list_index") % 3 == 1, ". . . . . . ").otherwise(". ....")
    line = F.concat("title", leader, C("page").cast("string"))
    return D.toc_items(spark, d).select("doc_id", "list_index", T.clean_leaders(line).alias("cleaned"), T.clean_leaders(line, "detector").alias("cleaned_detector"))


@query(
    "b4_normalise_chapter",
    sql(r"""SELECT doc_id, list_index, regexp_replace('第 ' || page || ' 章 ' || title, '第\s*([一二三四五六七八九十百千零〇0-9]+)\s*章', '第\1章', 'g') AS title FROM toc_items""", "toc_items"),
)
def b4(spark, d) -> DataFrame:
    return D.toc_items(spark, d).select("doc_id", "list_index", T.normalise_chapter(F.concat(F.lit("第 "), C("page").cast("string"), F.lit(" 章 "), C("title"))).alias("title"))


@query(
    "b5_strip_footers",
    sql(
        r"""SELECT doc_id, page_no, regexp_replace(regexp_replace(regexp_replace(text || chr(10) || 'Page ' || page_no || ' of 99 - ' || page_no || ' - 第 ' || page_no || ' 页 共 9 页',
        '第\s*[0-9]+\s*页\s*共\s*[0-9]+\s*页', '', 'g'), '(?i)page\s+[0-9]+\s+of\s+[0-9]+', '', 'g'), '-\s*[0-9]+\s*-', '', 'g') AS text FROM doc_pages""",
        "doc_pages",
    ),
)
def b5(spark, d) -> DataFrame:
    footed = F.format_string("%s\nPage %d of 99 - %d - 第 %d 页 共 9 页", "text", "page_no", "page_no", "page_no")
    return D.doc_pages(spark, d).select("doc_id", "page_no", T.strip_footers(footed).alias("text"))


@query("b6_page_to_int", sql("SELECT doc_id, list_index, CASE WHEN list_index % 4 = 3 THEN NULL ELSE abs(page) END AS page FROM toc_items", "toc_items"))
def b6(spark, d) -> DataFrame:
    shown = F.when(C("list_index") % 4 == 3, F.lit("n/a")).otherwise(F.concat(F.lit("p. "), C("page").cast("string"), F.lit(" ff")))
    return D.toc_items(spark, d).select("doc_id", "list_index", T.first_int(shown).alias("page"))


@query("b7_physical_index", sql("SELECT doc_id, list_index, CASE list_index % 4 WHEN 3 THEN NULL ELSE physical_index END AS physical_index FROM toc_items", "toc_items"))
def b7(spark, d) -> DataFrame:
    p = C("physical_index").cast("string")
    raw = F.when(C("list_index") % 4 == 0, F.concat(F.lit("<physical_index_"), p, F.lit(">"))).when(C("list_index") % 4 == 1, p).when(C("list_index") % 4 == 2, F.concat(F.lit("physical_index_"), p)).otherwise("none")
    return D.toc_items(spark, d).select("doc_id", "list_index", T.physical_index(raw).alias("physical_index"))


@query(
    "b8_label_pages",
    sql("""SELECT doc_id, string_agg('<physical_index_' || page_no || '>' || chr(10) || text, chr(10) || chr(10) ORDER BY page_no) AS labelled FROM doc_pages GROUP BY doc_id""", "doc_pages"),
)
def b8(spark, d) -> DataFrame:
    pages = D.doc_pages(spark, d).select("doc_id", "page_no", T.label_page(C("page_no"), C("text")).alias("x"))
    return pages.groupBy("doc_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("page_no", "x"))), lambda p: p["x"]), "\n\n").alias("labelled"))


@query(
    "b9_first_last_tag",
    sql("""SELECT doc_id, page_no, CASE WHEN page_no % 3 = 0 THEN -1 ELSE page_no END AS first_tag, CASE WHEN page_no % 3 = 0 THEN -1 ELSE page_no + 1 END AS last_tag FROM doc_pages""", "doc_pages"),
)
def b9(spark, d) -> DataFrame:
    tagged = F.when(C("page_no") % 3 == 0, C("text")).otherwise(F.concat(F.lit("<start_index_"), C("page_no").cast("string"), F.lit(">"), C("text"), F.lit("<start_index_"), (C("page_no") + 1).cast("string"), F.lit(">")))
    return D.doc_pages(spark, d).select("doc_id", "page_no", T.first_tag(tagged).alias("first_tag"), T.first_tag(tagged, True).alias("last_tag"))


@query("b10_drop_first_section", sql("SELECT doc_id, page_no, chr(10) || text AS rest FROM doc_pages", "doc_pages"))
def b10(spark, d) -> DataFrame:
    labelled = F.concat(F.lit("<physical_index_1>\nold\n<physical_index_2>\n"), C("text"))
    return D.doc_pages(spark, d).select("doc_id", "page_no", T.drop_first_section(labelled).alias("rest"))


@query("b11_title_key", sql(r"SELECT doc_id, list_index, lower(regexp_replace(title, '\s+', '', 'g')) AS title_key FROM toc_items", "toc_items"))
def b11(spark, d) -> DataFrame:
    return D.toc_items(spark, d).select("doc_id", "list_index", T.title_key(C("title")).alias("title_key"))


# Marks laid over the titles, a row each in turn: numbering, and what is no title.
MARKS = ("第三章 ", "(2) ", "一、", "1.2 ", "A. ", "IV. ", "1、", "1.1", "1) ", "（三）", "第五条：", "b)", "第十二款", "7 / ", "part / 2 ", "Chapter 4 ", "CHAPTER IV ", "12 ", "3 总则 ", "第二部分 ", "Chapters ", "")
WHOLE = ("温馨提示", "- 3 -", "第 12 页", "项目编号 : jjwl-7", "某采购项目", "， ·", "0a1b2c3d-0000-1111-2222-333344445555", "AB", "一、总", "1、")


def _marked(title: str) -> str:
    marks, whole = (", ".join(f"'{x}'" for x in names) for names in (MARKS, WHOLE))
    return f"CASE WHEN list_index % 7 = 6 THEN ([{whole}])[CAST((doc_id + list_index) % {len(WHOLE)} + 1 AS INT)] ELSE ([{marks}])[CAST((doc_id + list_index) % {len(MARKS)} + 1 AS INT)] || {title} END"


def numbered() -> Column:
    pick = lambda names: F.get(F.array(*[F.lit(x) for x in names]), ((C("doc_id") + C("list_index")) % len(names)).cast("int"))
    return F.when(C("list_index") % 7 == 6, pick(WHOLE)).otherwise(F.concat(pick(MARKS), C("title")))


_NUMBERED = f"(SELECT doc_id, list_index, {_marked('title')} AS t FROM toc_items)"


@query("b12_strip_numbering", sql(f"SELECT doc_id, list_index, {D.strip_sql('t')} AS core FROM {_NUMBERED}", "toc_items"))
def b12(spark, d) -> DataFrame:
    return D.toc_items(spark, d).select("doc_id", "list_index", T.strip_numbering(numbered()).alias("core"))


def _without(text: str, *patterns: str) -> str:
    for p in patterns:
        text = f"regexp_replace({text}, '{p}', '')"
    return f"trim({text}, '、，,．.·: -—_' || chr(9) || chr(10))"


@query("b13_clean_title", sql(f"""SELECT doc_id, list_index, CASE WHEN t = '' THEN '' WHEN instr(t, ' / ') > 0 AND trim(substr(t, instr(t, ' / ') + 3)) <> '' THEN trim(substr(t, instr(t, ' / ') + 3)) WHEN core = '' THEN t
    WHEN length(short) >= 3 THEN short WHEN more <> '' THEN more WHEN short <> '' THEN short ELSE t END AS clean FROM (SELECT *, {_without('core', T.IN_BRACKETS)} AS short, {_without('trim(t)', *T.PLAIN_NUMBERS)} AS more FROM (
    SELECT *, {D.strip_sql('t')} AS core FROM {_NUMBERED}))""", "toc_items"))
def b13(spark, d) -> DataFrame:
    return D.toc_items(spark, d).select("doc_id", "list_index", T.clean_title(numbered()).alias("clean"))


def _noise(title: str) -> str:
    named = " OR ".join(f"regexp_matches(trim({title}), '(?i){p}')" for p in T.NOISE)
    return f"({named} OR (length({D.strip_sql(title)}) <= 2 AND NOT regexp_matches({D.strip_sql(title)}, '[0-9]')))"


@query("b14_display_title", sql(f"SELECT doc_id, pre, node_id || ' ' || title AS display_title, {_noise('title')} AS is_noise FROM nodes", "nodes"))
def b14(spark, d) -> DataFrame:
    return D.nodes(spark, d).select("doc_id", "pre", F.concat_ws(" ", "node_id", "title").alias("display_title"), T.is_noise(C("title")).alias("is_noise"))


@query("b15_noise_titles", sql(f"SELECT doc_id, list_index, {_noise('t')} AS noise FROM {_NUMBERED}", "toc_items"))
def b15(spark, d) -> DataFrame:
    return D.toc_items(spark, d).select("doc_id", "list_index", T.is_noise(numbered()).alias("noise"))


@query("b16_chapter_titles", sql(f"SELECT doc_id, list_index, regexp_matches(t, '{T.CHAPTER}') AS is_chapter FROM {_NUMBERED}", "toc_items"))
def b16(spark, d) -> DataFrame:
    return D.toc_items(spark, d).select("doc_id", "list_index", T.is_chapter(numbered()).alias("is_chapter"))


def labelled(title: str) -> str:
    """SQL for titles with marks of appendices, forms, tables and sentences laid over them, as shown() has them."""
    return f"CASE list_index % 12 WHEN 0 THEN '附件 1 ' || {title} WHEN 1 THEN {title} || ' 偏离表' WHEN 2 THEN '序号 项目 内容' WHEN 3 THEN '地址 ' || left({title}, 6) || '：' WHEN 4 THEN 'G. ' || {title} WHEN 5 THEN 'A.附录 ' || {title} WHEN 6 THEN {title} || '，更多' WHEN 7 THEN '（一）' || {title} || '，更多' WHEN 8 THEN '....' WHEN 9 THEN left({title}, 8) || ':' ELSE {title} END"


def shown(title) -> Column:
    k = C("list_index") % 12
    forms = [F.concat(F.lit("附件 1 "), title), F.concat(title, F.lit(" 偏离表")), F.lit("序号 项目 内容"), F.concat(F.lit("地址 "), F.left(title, F.lit(6)), F.lit("：")), F.concat(F.lit("G. "), title), F.concat(F.lit("A.附录 "), title)]
    forms += [F.concat(title, F.lit("，更多")), F.concat(F.lit("（一）"), title, F.lit("，更多")), F.lit("...."), F.concat(F.left(title, F.lit(8)), F.lit(":"))]
    out = F.when(k == 0, forms[0])
    for n, f in enumerate(forms[1:], 1):
        out = out.when(k == n, f)
    return out.otherwise(title)


_APPENDIX = "regexp_matches({0}, '^附件\\s*[0-9０-９一二三四五六七八九十]') OR regexp_matches({0}, '" + "|".join(T.APPENDIX_WORDS) + "')"


@query("b17_appendix_titles", sql(f"SELECT doc_id, list_index, {_APPENDIX.format('t')} AS is_appendix FROM (SELECT *, {labelled('title')} AS t FROM toc_items)", "toc_items"))
def b17(spark, d) -> DataFrame:
    return D.toc_items(spark, d).select("doc_id", "list_index", T.is_appendix(shown(C("title"))).alias("is_appendix"))


_BARE = r"regexp_replace({0}, '^[\s　]+|[\s　]+$', '', 'g')"
_WORDS = "list_filter(regexp_split_to_array({0}, '[\\s　]+'), lambda x: x <> '')"
_VALID = rf"""(SELECT CASE WHEN length(b) <= 1 OR length(b) > 80 THEN false WHEN regexp_matches(b, '[。，！？]') AND NOT regexp_matches(b, '^(第|（|\(|附件|表|图)') THEN false
 WHEN NOT regexp_matches(b, '[\p{{{{L}}}}\p{{{{N}}}}]') THEN false WHEN regexp_matches(b, '[:：]$') AND (contains(b, '  ') OR regexp_matches(b, '{"|".join(T.FORM_WORDS)}')) THEN false
 WHEN length(b) > 2 AND regexp_matches(b, '^\p{{{{L}}}}\.') AND NOT regexp_matches(b, '^\p{{{{L}}}}\.[\s　]*[附补表图]') THEN false
 WHEN len({_WORDS.format("b")}) >= 2 AND list_max(list_transform({_WORDS.format("b")}, lambda x: length(x))) <= 4 AND list_has_any({_WORDS.format("b")}, [{", ".join(f"'{w}'" for w in T.HEAD_WORDS)}]) THEN false ELSE true END FROM (SELECT {_BARE} AS b))"""


@query("b18_valid_titles", sql(f"SELECT doc_id, list_index, {_VALID.format('t')} AS is_valid FROM (SELECT *, {labelled('title')} AS t FROM toc_items)", "toc_items"))
def b18(spark, d) -> DataFrame:
    return D.toc_items(spark, d).select("doc_id", "list_index", T.is_valid_title(shown(C("title"))).alias("is_valid"))


def items_on_pages(spark, d) -> DataFrame:
    pages = D.doc_pages(spark, d).select("doc_id", C("page_no").alias("physical_index"), C("text").alias("page_text"))
    return D.toc_items(spark, d).join(pages, ["doc_id", "physical_index"])


@query("b19_title_in_page", sql(r"""SELECT t.doc_id, list_index, contains(p.text, title) OR contains(regexp_replace(p.text, '\s+', '', 'g'), regexp_replace(title, '\s+', '', 'g')) AS found
    FROM toc_items t JOIN doc_pages p ON t.doc_id = p.doc_id AND t.physical_index = p.page_no""", "toc_items", "doc_pages"))
def b19(spark, d) -> DataFrame:
    return items_on_pages(spark, d).select("doc_id", "list_index", T.title_in_page(C("title"), C("page_text")).alias("found"))


@query("b20_title_appearance", sql(r"""SELECT doc_id, list_index, contains(page, t) OR (len(w) > 2 AND len(list_filter(w, lambda x: contains(page, x))) >= 0.7 * len(w)) AS appears FROM (
    SELECT t.doc_id, list_index, lower(p.text) AS page, lower(title) AS t, list_distinct(list_filter(regexp_split_to_array(lower(title), '\s+'), lambda x: x <> '')) AS w
    FROM toc_items t JOIN doc_pages p ON t.doc_id = p.doc_id AND t.physical_index = p.page_no)""", "toc_items", "doc_pages"))
def b20(spark, d) -> DataFrame:
    return items_on_pages(spark, d).select("doc_id", "list_index", T.title_appears(C("title"), C("page_text")).alias("appears"))


def answers(spark, d) -> DataFrame:
    """(doc_id, raw): contents tables as a model writes them: fenced, with Python literals; of every fourth document cut off somewhere, half of these inside of an object."""
    item = F.format_string('{"i": %d, "title": "%s", "page": %s, "ok": True,}', "list_index", F.regexp_replace("title", r'["\\\x00-\x1f]', ""), F.when(C("list_index") % 4 == 3, F.lit("None")).otherwise(C("page").cast("string")))
    rows = D.toc_items(spark, d).groupBy("doc_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("list_index", item.alias("x")))), lambda r: r["x"]), ", ").alias("body"))
    # What is cut off is a share of the items' length that hangs on the document.
    kept = F.left("body", F.floor(F.length("body") * (C("doc_id") % 97) / 97).cast("int"))
    cut = F.concat(F.when(C("doc_id") % 8 == 1, F.lit('{"note": "a \\\\\\"list\\\\\\" [of] {", "table_of_contents": [')).otherwise(F.lit("[")), kept)
    return rows.select("doc_id", F.when(C("doc_id") % 4 == 1, cut).otherwise(F.concat(F.lit("Here it is:\n```json\n["), C("body"), F.lit("]\n```\nDone"))).alias("raw"))


def cut_items(spark, d, schema: str) -> DataFrame:
    """(doc_id, x): the items of cut answers, of lists and of objects that hold one."""
    whole = T.repaired_json(T.answer_json(C("raw")))
    rows = answers(spark, d).where("doc_id % 4 = 1").select("doc_id", whole.alias("j"))
    items = F.when(C("j").startswith("{"), F.from_json("j", f"table_of_contents {schema}")["table_of_contents"]).otherwise(F.from_json("j", schema))
    return rows.select("doc_id", F.inline(items))


_RAW = r"""raw AS (SELECT doc_id, list_index, t, page, '{"i": ' || list_index || ', "title": "' || t || '", "page": ' || CASE WHEN list_index % 4 = 3 THEN 'None' ELSE page::VARCHAR END || ', "ok": True,}' AS x FROM (SELECT *, regexp_replace(title, '["\\\x00-\x1f]', '', 'g') AS t FROM toc_items)),
    ended AS (SELECT *, sum(length(x) + 2) OVER (PARTITION BY doc_id ORDER BY list_index) - 2 AS ends, sum(length(x) + 2) OVER (PARTITION BY doc_id) - 2 AS size FROM raw),
    whole AS (SELECT * FROM ended WHERE doc_id % 4 <> 1 OR ends <= floor(size * (doc_id % 97) / 97))"""


def _answers(body: str) -> str:
    return sql("", "toc_items").rstrip() + ",\n" + _RAW + "\n" + body


@query("b21_answer_items", sql(r"""SELECT doc_id, list_index AS i, regexp_replace(title, '["\\\x00-\x1f]', '', 'g') AS title, CASE WHEN list_index % 4 <> 3 THEN page END AS page, true AS ok FROM toc_items WHERE doc_id % 4 <> 1""", "toc_items"))
def b21(spark, d) -> DataFrame:
    parsed = F.from_json(T.answer_json(C("raw")), "array<struct<i:int,title:string,page:int,ok:boolean>>")
    return answers(spark, d).where("doc_id % 4 <> 1").select("doc_id", F.inline(parsed))


@query("b22_cut_answers", _answers("SELECT doc_id, list_index AS i, t AS title, CASE WHEN list_index % 4 <> 3 THEN page END AS page FROM whole WHERE doc_id % 4 = 1"))
def b22(spark, d) -> DataFrame:
    """Items that end before their answer is cut off, and no others."""
    return cut_items(spark, d, "array<struct<i:int,title:string,page:int>>")


@query("b23_validate_items", sql("""SELECT doc_id, list_index, trim(title) AS title, rtrim(structure || '..', '.') AS structure, CASE WHEN list_index % 4 <> 3 THEN page END AS page FROM toc_items WHERE trim(title) <> ''""", "toc_items"))
def b23(spark, d) -> DataFrame:
    raw = D.toc_items(spark, d).withColumn("structure", F.concat("structure", F.lit(".."))).withColumn("page", F.when(C("list_index") % 4 == 3, "x").otherwise(C("page").cast("string")))
    return raw.where(F.trim("title") != "").select("doc_id", "list_index", F.trim("title").alias("title"), F.rtrim("structure", F.lit(".")).alias("structure"), C("page").try_cast("int").alias("page"))


@query("b24_language", "SELECT doc_id, CASE WHEN length(regexp_replace(left(text, 500), '[^一-鿿]', '', 'g')) > length(regexp_replace(left(text, 500), '[^A-Za-z]', '', 'g')) THEN 'zh' ELSE 'en' END AS language FROM documents")
def b24(spark, d) -> DataFrame:
    return D.table(spark, d, "documents").select("doc_id", T.language(C("text")).alias("language"))


@query("b25_poor_extraction", sql(r"""SELECT doc_id, page_no, CASE WHEN length(text) < 100 OR len(w) < 20 THEN false ELSE len(list_filter(w, lambda x: length(x) = 1)) > 0.8 * len(w) OR list_sum(list_transform(w, lambda x: length(x))) / len(w) < 1.5 END AS poor
    FROM (SELECT *, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') AS w FROM doc_pages)""", "doc_pages"))
def b25(spark, d) -> DataFrame:
    return D.doc_pages(spark, d).select("doc_id", "page_no", T.poor_extraction(C("text")).alias("poor"))


@query("b26_scanned", sql("""SELECT doc_id, sum(CAST(length(trim(text)) < 50 AS INT)) >= greatest(1, CAST(floor(0.8 * count(*)) AS INT)) AS scanned FROM doc_pages WHERE page_no <= 5 GROUP BY doc_id""", "doc_pages"))
def b26(spark, d) -> DataFrame:
    short = F.sum((F.length(F.trim("text")) < 50).cast("int"))
    return D.doc_pages(spark, d).where("page_no <= 5").groupBy("doc_id").agg((short >= F.greatest(F.lit(1), F.floor(F.count("*") * 0.8))).alias("scanned"))


# White space is doubled, as a match takes the one before it and the one behind it.
_MARKED = r"""regexp_replace(CASE page_no % 4 WHEN 0 THEN '一、' || text || ' A. B. ' WHEN 1 THEN '1. 2.3 ' || text || ' 12、 x.5 ' ELSE text END, '(\s)', '\1\1', 'g')"""


@query("b27_numbering_profile", sql(rf"""SELECT doc_id, page_no, tokens, cjk, arabic, letter, cjk + arabic + letter AS list_items, cjk + arabic + letter > 0 AS has_numbering, {{preview}} AS preview FROM (SELECT doc_id, page_no, length(shown) AS tokens, shown,
    len(regexp_extract_all(shown, '[一二三四五六七八九十]+[、．.]')) AS cjk, len(regexp_extract_all(doubled, '(^|[^\p{{L}}\p{{N}}_])\p{{Nd}}+[.、](\p{{Nd}}+[.、]?)?[\s\x{{85}}\x{{a0}}　]')) AS arabic,
    len(regexp_extract_all(doubled, '(^|[^\p{{L}}\p{{N}}_])[A-Z][.、][\s\x{{85}}\x{{a0}}　]')) AS letter FROM (SELECT *, {_MARKED} AS doubled, CASE page_no % 4 WHEN 0 THEN '一、' || text || ' A. B. ' WHEN 1 THEN '1. 2.3 ' || text || ' 12、 x.5 ' ELSE text END AS shown FROM doc_pages))""", "doc_pages").replace("{preview}", _BARE.format("replace(left(shown, 300), chr(10), ' ')")))
def b27(spark, d) -> DataFrame:
    k = C("page_no") % 4
    own = F.when(k == 0, F.concat(F.lit("一、"), "text", F.lit(" A. B. "))).when(k == 1, F.concat(F.lit("1. 2.3 "), "text", F.lit(" 12、 x.5 "))).otherwise(C("text"))
    return D.doc_pages(spark, d).select("doc_id", "page_no", own.alias("shown")).select("doc_id", "page_no", *[c.alias(n) for n, c in T.numbering_profile(C("shown")).items()])


# Questions' ends laid over the data, which is in no language of the tools' words.
ASKED = ("", " 截止日期是哪天？", " 预算是多少？", " 请加入项目管理", " 报价的有效期？", " How many are there?", " Enumerate them", " 包括什么？")
_ASKED = "(SELECT conv_id, turn, text || (['" + "', '".join(ASKED) + f"'])[CAST((conv_id + turn) % {len(ASKED)} + 1 AS INT)] AS q FROM conversations WHERE role = 'user')"
_any = lambda text, words: "(" + " OR ".join(f"contains({text}, '{w}')" for w in words) + ")"


@query("b28_question_intent", f"SELECT conv_id, turn, {_any('lower(q)', T.LIST_WORDS)} AS is_list, CASE " + " ".join(f"WHEN {_any('q', words)} THEN '{tool}'" for tool, words in T.TOOL_WORDS.items()) + f" END AS tool FROM {_ASKED}")
def b28(spark, d) -> DataFrame:
    q = F.concat("text", F.get(F.array(*[F.lit(x) for x in ASKED]), ((C("conv_id") + C("turn")) % len(ASKED)).cast("int")))
    return D.table(spark, d, "conversations").where("role = 'user'").select("conv_id", "turn", T.asks_for_list(q).alias("is_list"), T.asked_tool(q).alias("tool"))


# Tables laid behind the texts: rows of words of the text, ragged, and behind a line of prose a second one with bars around and a rule.
def _words(k: str) -> str:
    return f"slice(w, 1, CAST(1 + (doc_id + {k}) % 4 AS INT))"


_FIRST = "array_join(transform(sequence(1, CAST(doc_id % 4 AS INT)), k -> array_join(" + _words("k") + ", ' | ') || ' |'), '\n')"
_SECOND = "'| ' || array_join(" + _words("1") + ", ' |') || ' |\n|---|:--|\n' || '|' || array_join(" + _words("2") + ", '|') || '||'"


def with_tables(spark, d) -> DataFrame:
    """(doc_id, text) with tables laid behind."""
    docs = D.table(spark, d, "documents").where("text is not null").select("doc_id", "text", F.split(F.left("text", F.lit(90)), r"[\s|]+").alias("w"))
    return docs.select("doc_id", F.concat("text", F.when(C("doc_id") % 4 > 0, F.concat(F.lit("\n"), F.expr(_FIRST))).otherwise(""), F.lit("\nAnd then:\n"), F.expr(_SECOND), F.when(C("doc_id") % 3 == 0, "").otherwise("\nend")).alias("text"))


def _duck_words(k: str) -> str:
    return f"w[1 : CAST(1 + (doc_id + {k}) % 4 AS INT)]"


_TABLES = rf"""laid AS (SELECT doc_id, text || CASE WHEN doc_id % 4 > 0 THEN chr(10) || array_to_string(list_transform(generate_series(1, doc_id % 4), lambda k: array_to_string({_duck_words("k")}, ' | ') || ' |'), chr(10)) ELSE '' END || chr(10) || 'And then:' || chr(10)
    || '| ' || array_to_string({_duck_words("1")}, ' |') || ' |' || chr(10) || '|---|:--|' || chr(10) || '|' || array_to_string({_duck_words("2")}, '|') || '||' || CASE WHEN doc_id % 3 = 0 THEN '' ELSE chr(10) || 'end' END AS text
    FROM (SELECT doc_id, text, regexp_split_to_array(left(text, 90), '[\s|]+') AS w FROM documents WHERE text IS NOT NULL)),
    lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS n FROM laid),
    runs AS (SELECT *, n - row_number() OVER (PARTITION BY doc_id ORDER BY n) AS run FROM lines WHERE contains(line, '|')),
    cells AS (SELECT *, list_transform(string_split(regexp_replace(trim(line), '^\||\|$', '', 'g'), '|'), lambda c: trim(c)) AS c FROM runs),
    body AS (SELECT *, len(list_filter(c, lambda x: NOT regexp_matches(x, '^:?-{{2,}}:?$'))) = 0 AS rule FROM cells),
    sized AS (SELECT *, max(len(c)) FILTER (NOT rule) OVER (PARTITION BY doc_id, run) AS width, min(n) FILTER (NOT rule) OVER (PARTITION BY doc_id, run) AS head FROM body),
    regions AS (SELECT doc_id, min(n)::INT AS first_line, max(n)::INT AS last_line, any_value(width)::INT AS columns, count(*) FILTER (NOT rule)::INT AS rows,
    string_agg('| ' || array_to_string(list_resize(c, width, ''), ' | ') || ' |' || CASE WHEN n = head THEN chr(10) || '|' || array_to_string(list_transform(range(width), lambda x: ' --- '), '|') || '|' ELSE '' END, chr(10) ORDER BY n) FILTER (NOT rule) AS markdown
    FROM sized WHERE width IS NOT NULL GROUP BY doc_id, run)"""


@query("b29_table_regions", f"WITH {_TABLES} SELECT * FROM regions")
def b29_regions(spark, d) -> DataFrame:
    return X.table_regions(with_tables(spark, d))


@query("b29_tables_to_markdown", f"""WITH {_TABLES} SELECT doc_id, string_agg(x, chr(10) ORDER BY n) AS text FROM (SELECT l.doc_id, n, line AS x FROM lines l WHERE NOT EXISTS (SELECT 1 FROM regions r WHERE r.doc_id = l.doc_id AND l.n BETWEEN first_line AND last_line)
    UNION ALL SELECT doc_id, first_line, '[TABLE]' || chr(10) || markdown || chr(10) || '[/TABLE]' FROM regions) GROUP BY doc_id""")
def b29(spark, d) -> DataFrame:
    return X.with_markdown(with_tables(spark, d))


# Messages of failed calls laid over the events: fatal ones as providers word them, and others that look like them.
MESSAGES = (*(f"Request failed: {w.capitalize()}." for w in T.FATAL), "Connection error, retrying", "403 items returned", "Rate limit reached, slow down", "Timeout after 404 ms", "authentication ok", "balance checked", "", "quota at 80 percent")


@query("b30_fatal_errors", f"SELECT event_type, message, count(*) AS n, {_any('lower(message)', T.FATAL)} AS fatal FROM (SELECT event_type, (['" + "', '".join(MESSAGES) + f"'])[CAST(event_id % {len(MESSAGES)} + 1 AS INT)] AS message FROM events) GROUP BY event_type, message")
def b30(spark, d) -> DataFrame:
    message = F.get(F.array(*[F.lit(x) for x in MESSAGES]), (C("event_id") % len(MESSAGES)).cast("int"))
    return D.table(spark, d, "events").groupBy("event_type", message.alias("message")).agg(F.count("*").alias("n")).withColumn("fatal", T.is_fatal(C("message")))


@query("b31_budget", sql("SELECT entry_id, CASE budget_unit WHEN '元' THEN budget / 10000 WHEN '亿元' THEN budget * 10000 ELSE budget END AS budget_wan FROM timeline", "timeline"))
def b31(spark, d) -> DataFrame:
    return D.timeline(spark, d).select("entry_id", T.budget_in_wan(C("budget"), C("budget_unit")).alias("budget_wan"))


STATUS = "CASE WHEN end_date IS NULL THEN 'active' WHEN end_date < DATE '1997-06-01' THEN 'expired' WHEN end_date <= DATE '1997-07-01' THEN 'expiring_soon' WHEN start_date > DATE '1997-06-01' THEN 'future' ELSE 'active' END"


@query("b32_timeline_status", sql(f"SELECT entry_id, {STATUS} AS status FROM timeline", "timeline"))
def b32(spark, d) -> DataFrame:
    return D.timeline(spark, d).select("entry_id", T.timeline_status(C("start_date"), C("end_date"), F.lit("1997-06-01").cast("date")).alias("status"))


@query("b33_code_keys", sql("SELECT doc_id, list_index, len(string_split(structure, '.')) AS level, list_transform(string_split(structure, '.'), lambda x: coalesce(TRY_CAST(x AS INT), 999)) AS sort_key FROM toc_items", "toc_items"))
def b33(spark, d) -> DataFrame:
    return D.toc_items(spark, d).select("doc_id", "list_index", T.code_level(C("structure")).alias("level"), T.code_key(C("structure")).alias("sort_key"))


@query("b34_content_groups", "SELECT min(doc_id) AS first_doc, count(*) AS copies, md5(length(text) || '_' || sha256(text)) AS key FROM documents GROUP BY key")
def b34(spark, d) -> DataFrame:
    return D.table(spark, d, "documents").groupBy(T.content_key(C("text")).alias("key")).agg(F.min("doc_id").alias("first_doc"), F.count("*").alias("copies"))


@query("b35_progress", "SELECT event_id, event_id % 7 + 1 AS step, event_type AS stage, (event_id % 7) / 7.0 * 100 AS progress FROM events")
def b35(spark, d) -> DataFrame:
    message = F.format_string("[%d/7] %s", C("event_id") % 7 + 1, "event_type")
    part = lambda n: F.regexp_extract("m", r"^\[([0-9]+)/([0-9]+)\]\s*(.*)$", n)
    return D.table(spark, d, "events").select("event_id", message.alias("m")).select(
        "event_id", part(1).cast("bigint").alias("step"), part(3).alias("stage"), ((part(1).cast("int") - 1) / part(2).cast("int") * 100).alias("progress")
    )


@query("b36_history", "SELECT conv_id, string_agg(CASE role WHEN 'user' THEN 'User: ' ELSE 'Assistant: ' END || text, chr(10) ORDER BY turn) AS history FROM conversations WHERE role IN ('user', 'assistant') AND text IS NOT NULL GROUP BY conv_id")
def b36(spark, d) -> DataFrame:
    line = F.concat(F.when(C("role") == "user", "User: ").otherwise("Assistant: "), C("text"))
    turns = D.table(spark, d, "conversations").where("role IN ('user', 'assistant') AND text IS NOT NULL").select("conv_id", "turn", line.alias("x"))
    return turns.groupBy("conv_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", "x"))), lambda t: t["x"]), "\n").alias("history"))


@query("b37_section_context", sql("""SELECT doc_id, string_agg('【' || title || '】' || chr(10) || node_id, chr(10) || chr(10) ORDER BY pre) AS context FROM (
    SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pre) AS rn FROM nodes WHERE depth <= 2) WHERE rn <= 10 GROUP BY doc_id""", "nodes"))
def b37(spark, d) -> DataFrame:
    from pyspark.sql import Window as W

    top = D.nodes(spark, d).where("depth <= 2").withColumn("rn", F.row_number().over(W.partitionBy("doc_id").orderBy("pre"))).where("rn <= 10")
    shown = F.concat(F.lit("【"), C("title"), F.lit("】\n"), C("node_id"))
    return top.groupBy("doc_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pre", shown.alias("x")))), lambda t: t["x"]), "\n\n").alias("context"))


@query("b38_page_ranges", sql("SELECT suggestion_id, CASE doc_id % 3 WHEN 2 THEN NULL ELSE start_page END AS first, CASE doc_id % 3 WHEN 0 THEN end_page WHEN 1 THEN start_page END AS last FROM suggestions", "suggestions"))
def b38(spark, d) -> DataFrame:
    text = F.when(C("doc_id") % 3 == 0, F.concat_ws("-", "start_page", "end_page")).when(C("doc_id") % 3 == 1, C("start_page").cast("string")).otherwise("a-b")
    return D.suggestions(spark, d).select("suggestion_id", T.page_range(text).alias("r")).select("suggestion_id", "r.first", "r.last")


@query("b39_tree_projection", sql("SELECT doc_id, pre, node_id, title FROM nodes", "nodes"))
def b39(spark, d) -> DataFrame:
    return D.nodes(spark, d).select("doc_id", "pre", "node_id", "title")
