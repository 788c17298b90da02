"""Text rules as Column expressions: titles, pages, numbering, answers.

Python's \\s and \\d know Unicode; the patterns that need it say (?U).
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F, types as S

from leafspan.functions import nearest

CJK = r"[一-鿿]"


def _len_without(text: Column, pattern: str) -> Column:
    return F.length(text) - F.length(F.regexp_replace(text, pattern, ""))


def estimate_tokens(text: Column) -> Column:
    """Half a token a CJK character, a quarter any other, each rounded down."""
    cjk = _len_without(text, CJK)
    return (F.floor(cjk / 2) + F.floor((F.length(text) - cjk) / 4)).cast("int")


def estimate_tokens_simple(text: Column) -> Column:
    return F.floor(F.length(text) / 4).cast("int")


def clean_leaders(text: Column, mode: str = "helpers") -> Column:
    """Dot leaders of a contents page become a colon."""
    if mode == "helpers":
        return F.regexp_replace(F.regexp_replace(text, r"\.{5,}", ": "), r"(?:\. ){5,}\.?", ": ")
    return F.regexp_replace(F.regexp_replace(text, r"\.{4,}", ": "), r"(?:\. )\.{3,}", ": ")


def normalise_chapter(text: Column) -> Column:
    """Blanks inside a CJK chapter marker go."""
    return F.regexp_replace(text, r"第\s*([一二三四五六七八九十百千零〇0-9]+)\s*章", "第$1章")


def strip_footers(text: Column) -> Column:
    text = F.regexp_replace(text, r"第\s*[0-9]+\s*页\s*共\s*[0-9]+\s*页", "")
    text = F.regexp_replace(text, r"(?i)page\s+[0-9]+\s+of\s+[0-9]+", "")
    return F.regexp_replace(text, r"-\s*[0-9]+\s*-", "")


def first_int(text: Column) -> Column:
    """The first run of digits as a number; null without one."""
    return F.regexp_extract(text, r"([0-9]+)", 1).try_cast("int")


def physical_index(text: Column) -> Column:
    tagged = F.regexp_extract(text, r"<?physical_index_([0-9]+)>?", 1)
    return F.coalesce(tagged.try_cast("int"), F.when(text.rlike(r"^\s*[0-9]+\s*$"), F.trim(text).try_cast("int")))


def label_page(number: Column, text: Column) -> Column:
    return F.concat(F.lit("<physical_index_"), number.cast("string"), F.lit(">\n"), text)


def first_tag(text: Column, last: bool = False) -> Column:
    tags = F.regexp_extract_all(text, F.lit(r"<start_index_([0-9]+)>"), 1)
    return F.coalesce(F.try_element_at(tags, F.lit(-1 if last else 1)).try_cast("int"), F.lit(-1))


def drop_first_section(text: Column) -> Column:
    """Takes out the first stretch from a page tag to the next one, tags included, once."""
    section = F.regexp_extract(text, r"(?s)(<physical_index_[0-9]+>.*?<physical_index_[0-9]+>)", 1)
    at = F.instr(text, section)
    cut = F.concat(F.substring(text, F.lit(1), at - 1), F.substring(text, at + F.length(section), F.length(text)))
    return F.when(section == "", text).otherwise(cut)


def title_key(title: Column, lower: bool = True) -> Column:
    key = F.regexp_replace(title, r"\s+", "")
    return F.lower(key) if lower else key


# Prefixes of numbering, in the order they go, and what goes around what is left.
NUMBERING = (
    r"^第[零一二三四五六七八九十百千万\d]+[章节条款项部分篇]\s*[、.．·:\s]*",
    r"^[（(][零一二三四五六七八九十百千万\d]+[）)]\s*[、.．·:\s]*",
    r"^[零一二三四五六七八九十百千万]+[、，,．.·:\s]+",
    r"^\d+(?:\.\d+)*\s*[、，,．.·:\s]*",
    r"^[A-Za-z]+\s*[、，,．.·:)\s]+",
    r"^[IVXivx]+\s*[、，,．.·:\s]+",
)
AROUND_TITLE = "、，,．.·: \t"
# What a display title loses besides.
IN_BRACKETS = r"^[（(][^）)]*[）)]\s*"
AROUND_DISPLAY = "、，,．.·: \t\n-—_"
PLAIN_NUMBERS = (r"^第[^章节条款]*[章节条款]\s*", r"^\d+(?:\.\d+)*\s*[、/／]*\s*", IN_BRACKETS)


def stripped(text: Column) -> Column:
    """Without white space around, as Unicode has it; a null is empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)^\s+|\s+$", "")


def strip_numbering(title: Column) -> Column:
    """Numbering prefixes go, in a set order; then blanks and punctuation around. A null is empty."""
    title = stripped(title)
    for pattern in NUMBERING:
        title = F.regexp_replace(title, "(?U)" + pattern, "")
    return F.btrim(title, F.lit(AROUND_TITLE))


def clean_title(title: Column) -> Column:
    """A title for display: what follows a first slash between blanks, else the title without its numbering; what is shorter than three characters keeps more of it."""
    behind = stripped(F.regexp_extract(title, "(?s)^.*? / (.*)$", 1))
    core = strip_numbering(title)
    short = F.btrim(F.regexp_replace(core, "(?U)" + IN_BRACKETS, ""), F.lit(AROUND_DISPLAY))
    more = stripped(title)
    for pattern in PLAIN_NUMBERS:
        more = F.regexp_replace(more, "(?U)" + pattern, "")
    more = F.btrim(more, F.lit(AROUND_DISPLAY))
    shown = F.when(F.length(short) >= 3, short).when(more != "", more).when(short != "", short).otherwise(title)
    return F.when(F.coalesce(title, F.lit("")) == "", "").when(behind != "", behind).when(core == "", title).otherwise(shown)


# Titles that are none, in any case: page marks, tender metadata, marks alone, ids.
NOISE = (
    r"^(?:温馨提示|页码|第\s*\d+\s*页|-\s*\d+\s*-$)",
    r"^.*项目编号.*:.*JJWL.*$",
    r"^.*采购.*$",
    r"^.*报价文件.*$",
    r"^[、，,．.·:\s]*$",
    r"^[a-f0-9]{8}-[a-f0-9]{4}-[a-f0-9]{4}-[a-f0-9]{4}-[a-f0-9]{12}$",
)


def is_noise(title: Column) -> Column:
    """Titles of a noise pattern, and those of which two characters or fewer are left without numbering, none of them a digit."""
    t, core = stripped(title), strip_numbering(title)
    named = [t.rlike("(?idU)" + p) for p in NOISE]
    return F.coalesce(named[0] | named[1] | named[2] | named[3] | named[4] | named[5], F.lit(True)) | ((F.length(core) <= 2) & ~core.rlike(r"\p{Nd}"))


# How chapters begin.
CHAPTER = r"^(?:第[一二三四五六七八九十0-9]+章|(?i:chapter)\s*[0-9IVXivx]|[0-9]{1,2}\s*/\s*[^\n]|[0-9]{1,2}\s+[一-龥]{2,}|第[一二三四五六七八九十百0-9]+[部节])"


def is_chapter(title: Column) -> Column:
    return title.rlike(CHAPTER)


# Words of appendices of tenders, of form labels and of table heads.
APPENDIX_WORDS = ("投标函", "开标一览表", "报价明细表", "偏离表", "声明书", "承诺书", "授权委托书", "证明书", "自评表", "基本情况表", "业绩一览表", "情况表", "清单", "一览表", "证书一览表")
FORM_WORDS = ("地址", "时间", "日期", "名称", "公章", "签字", "盖章", "电话", "传真", "邮编")
HEAD_WORDS = ("序号", "项目", "内容", "名称", "规格", "数量", "单价", "合价", "金额", "备注", "编号", "类别", "单位", "要求", "说明")

APPENDIX = r"^附件\s*[0-9０-９一二三四五六七八九十]|" + "|".join(APPENDIX_WORDS)
AROUND = r"^[\s\u3000]+|[\s\u3000]+$"


def is_appendix(title: Column) -> Column:
    return title.rlike(APPENDIX)


def is_valid_title(title: Column) -> Column:
    """Ordered rejections; what none of them names is a title."""
    t = F.regexp_replace(title, AROUND, "")
    words = F.array_remove(F.split(t, r"[\s\u3000]+"), "")
    short = (F.size(words) >= 2) & F.forall(words, lambda w: F.length(w) <= 4)
    return (
        F.when(F.length(t) <= 1, False)
        .when(F.length(t) > 80, False)
        .when(t.rlike("[。，！？]") & ~t.rlike(r"^(?:第|（|\(|附件|表|图)"), False)
        .when(~t.rlike(r"[\p{L}\p{N}]"), False)
        .when(t.rlike("[:：]$") & t.rlike("|".join(FORM_WORDS) + "|  "), False)
        .when(t.rlike(r"^\p{L}\.(?s:.)") & ~t.rlike(r"^\p{L}\.[\s\u3000]*[附补表图]"), False)
        .when(short & F.arrays_overlap(words, F.array(*[F.lit(w) for w in HEAD_WORDS])), False)
        .otherwise(True)
    )


def numbering_profile(text: Column) -> dict[str, Column]:
    """Enumerators by kind: Chinese, Arabic and letters, with a mark and, but for the first, white space behind; how many in all, and the page's start."""
    edge = r"(?U)(?<![\p{L}\p{N}_])"
    kinds = {"cjk": r"[一二三四五六七八九十]+[、．.]", "arabic": edge + r"\p{Nd}+[.、](?:\p{Nd}+[.、]?)?\s", "letter": edge + r"[A-Z][.、]\s"}
    counts = {k: F.regexp_count(text, F.lit(p)) for k, p in kinds.items()}
    total = counts["cjk"] + counts["arabic"] + counts["letter"]
    preview = F.regexp_replace(F.translate(F.left(text, F.lit(300)), "\n", " "), AROUND, "")
    return counts | {"tokens": F.length(text), "list_items": total, "has_numbering": total > 0, "preview": preview}


def toc_score(text: Column) -> Column:
    """How like a contents page a text is: a heading, lines that end in a page, numbers below numbers and leaders, less what lists of figures and abstracts have.

    From 70 on it is one, from 50 on it may be.
    """
    cited = F.size(F.filter(F.split(text, "\n"), lambda x: x.rlike(r"\S[\s.\-–—…·:：]+(?:第|p\.)?\s*[0-9]{1,4}\s*页?\s*$")))
    return (
        F.when(text.rlike(r"(?im)^\s*(?:table of contents|contents|目\s*录)\s*$"), 35).when(text.rlike("(?i)contents|目录"), 15).otherwise(0)
        + F.when(cited > 10, 40).when(cited >= 5, 25).when(cited >= 2, 15).otherwise(0)
        + F.when(text.rlike(r"(?m)^\s*[0-9]+\.[0-9]+(?:\s|\.)"), 15).otherwise(0)
        + F.when(text.rlike(r"\.{4,}|(?:\. ){4,}|…{2,}"), 10).otherwise(0)
        - F.when(text.rlike(r"(?i)list of (?:figures|tables)|图目录|表目录"), 30).otherwise(0)
        - F.when(text.rlike(r"(?im)^\s*(?:abstract|摘要)\s*$"), 30).otherwise(0)
        - F.when(F.length(text) < 50, 10).when(F.length(text) > 10000, 10).otherwise(0)
    )


def title_confidence(title: Column, page: Column) -> Column:
    """100 where the page has the title in any case, 95 where it has its letters and digits, else how near the nearest stretch of its length comes.

    Stretches start at every character; what differs in over three tenths of its
    length counts as nought. Only pages without the title go to Python.
    """
    norm = lambda c: F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", "")
    # A null says that the page has the title.
    left = F.when(F.contains(F.lower(page), F.lower(title)), F.lit(None)).otherwise(F.coalesce(norm(page), F.lit("")))
    return F.pandas_udf(nearest.confidence, S.IntegerType())(norm(title), left)


# What tells types of documents apart: words of the text, patterns of it, and hints in titles.
DOCUMENT_TYPES = {
    "tender": (("招标", "投标", "采购", "竞标", "评标", "开标"), ("招标公告", "投标须知", "评分标准", "采购需求"), ("第一章", "第二章", "附件", "评标办法")),
    "bid": (("投标函", "报价", "技术方案", "商务响应", "资质证明"), ("投标函", "开标一览表", "技术响应", "商务响应"), ("技术部分", "商务部分", "资格证明")),
    "contract": (("甲方", "乙方", "合同", "协议", "违约", "条款"), ("第[一二三四五六七八]条", "甲乙双方", "违约责任"), ("总则", "权利义务", "违约责任", "争议解决")),
    "academic": (
        ("abstract", "introduction", "methodology", "conclusion", "references", "摘要", "引言", "结论", "参考文献"),
        ("Abstract", "Introduction", "Chapter [0-9]+", "References"),
        ("Abstract", "Introduction", "Methodology", "Results", "Discussion", "Conclusion"),
    ),
    "technical": (
        ("api", "function", "class", "method", "parameter", "return", "接口", "函数"),
        ("API Reference", r"Class [\p{L}\p{N}_]+", r"function [\p{L}\p{N}_]+", r"\.get\(", r"\.post\("),
        ("Getting Started", "API Reference", "Examples", "Configuration"),
    ),
    "news": (("记者", "报道", "消息", "通讯员", "本报讯"), ("[0-9]{4}年[0-9]{1,2}月[0-9]{1,2}日", r"记者\s+[\p{L}\p{N}_]+\s+报道", "本报讯"), ()),
    "report": (("年度报告", "研究报告", "调查报告", "财务报告", "总结"), ("[0-9]{4}年.*报告", "Executive Summary", "财务数据"), ("概述", "背景", "分析", "结论", "建议")),
    "manual": (("使用说明", "操作指南", "用户手册", "安装", "配置"), ("安装步骤", "操作流程", "注意事项", "常见问题"), ("产品介绍", "安装", "使用", "维护", "故障排除")),
    "legal": (("法律", "法规", "条例", "规定", "办法"), ("第[一二三四五六七八九十]+章", "第[0-9]+条", "中华人民共和国"), ("总则", "分则", "附则")),
}
KEYWORD, PATTERN, HINT = 10, 15, 20  # points


def type_scores(text: Column, titles: Column) -> dict[str, Column]:
    """Points by type: what the text has of a type's words, in lower case, and patterns, and the titles of its hints."""
    hits = lambda found, points: sum((F.when(c, points).otherwise(0) for c in found), F.lit(0))
    return {
        t: hits([F.contains(F.lower(text), F.lit(w)) for w in words], KEYWORD) + hits([text.rlike(x) for x in patterns], PATTERN) + hits([F.contains(titles, F.lit(h)) for h in hints], HINT)
        for t, (words, patterns, hints) in DOCUMENT_TYPES.items()
    }


def title_in_page(title: Column, page: Column) -> Column:
    """Whether the page has the title, as it is or without white space."""
    return F.contains(page, title) | F.contains(title_key(page, False), title_key(title, False))


def title_appears(title: Column, page: Column) -> Column:
    """Lower-case substring, or of three distinct words and more seven tenths."""
    page, title = F.lower(page), F.lower(title)
    words = F.array_distinct(F.array_remove(F.split(title, r"\s+"), ""))
    hits = F.size(F.filter(words, lambda w: F.contains(page, w)))
    return F.contains(page, title) | ((F.size(words) > 2) & (hits >= 0.7 * F.size(words)))


def answer_json(raw: Column) -> Column:
    """The JSON of a model answer: what a fence holds, with Python's literals and trailing commas repaired."""
    fenced = F.regexp_extract(raw, r"(?s)```(?:json)?\s*(.*?)```", 1)
    body = F.btrim(F.when(fenced != "", fenced).otherwise(raw), F.lit(" \t\r\n"))
    for pattern, to in ((r"\bNone\b", "null"), (r"\bTrue\b", "true"), (r"\bFalse\b", "false"), (r",\s*([}\]])", "$1")):
        body = F.regexp_replace(body, pattern, to)
    return body


def repaired_json(body: Column) -> Column:
    """JSON that breaks off, cut behind its last whole value and closed; whole JSON without what stands around it. Null where none begins.

    A fold over tokens keeps a stack of open brackets and the last place where
    all before it is whole: behind a bracket, or before a comma. Objects that
    are elements of a list are whole or not at all, so a record that breaks
    off goes.
    """
    # On the stack: o an object, e an object in a list, l a list.
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("open"), F.lit(False).alias("inside"), F.lit(0).alias("cut"), F.lit("").alias("closing"), F.lit(False).alias("over"))

    def step(s: Column, t: Column) -> Column:
        inside, opens, closes = s["inside"], (t == "{") | (t == "["), (t == "}") | (t == "]")
        kind = F.when(t == "[", "l").when(F.right(s["open"], F.lit(1)) == "l", "e").otherwise("o")
        stack = F.when(inside | ~(opens | closes), s["open"]).when(opens, F.concat(s["open"], kind)).otherwise(F.left(s["open"], F.length(s["open"]) - 1))
        safe = ~inside & (opens | closes | ((t == ",") & (stack != ""))) & ~F.contains(stack, F.lit("e"))
        end = s["at"] + F.length(t)
        new = F.struct(
            end.alias("at"), stack.alias("open"), F.when(t == '"', ~inside).otherwise(inside).alias("inside"), F.when(safe, F.when(t == ",", s["at"]).otherwise(end)).otherwise(s["cut"]).alias("cut"),
            F.when(safe, stack).otherwise(s["closing"]).alias("closing"), (~inside & closes & (stack == "")).alias("over"),
        )
        return F.when(s["over"], s).otherwise(new)

    def close(s: Column) -> Column:
        return F.struct(s["cut"].alias("cut"), F.translate(F.reverse(s["closing"]), "oel", "}}]").alias("closing"))

    begun = F.regexp_extract(body, r"(?s)[\[{].*", 0)
    # An array of one, so that the fold runs once.
    found = F.transform(F.array(begun), lambda x: F.struct(x.alias("x"), F.aggregate(F.regexp_extract_all(x, F.lit(r'(?s)\\.|[^"\\{}\[\],]+|["{}\[\],\\]'), F.lit(0)), start, step, close).alias("s")))
    return F.get(F.transform(found, lambda f: F.when(f["s"]["cut"] > 0, F.concat(F.left(f["x"], f["s"]["cut"]), f["s"]["closing"]))), F.lit(0))


def table_cells(line: Column) -> Column:
    """The cells of a line of a table, without the bars around it; an empty array for the line below the head."""
    cells = F.transform(F.split(F.regexp_replace(F.trim(line), r"^\||\|$", ""), r"\|"), lambda c: F.trim(c))
    return F.when(F.forall(cells, lambda c: c.rlike("^:?-{2,}:?$")), F.array().cast("array<string>")).otherwise(cells)


def markdown_table(rows: Column) -> Column:
    """Rows of cells as a Markdown table: the first is the head; short rows are filled up."""
    width = F.array_max(F.transform(rows, lambda r: F.size(r)))
    lines = F.transform(rows, lambda r: F.concat(F.lit("| "), F.array_join(F.concat(r, F.array_repeat(F.lit(""), width - F.size(r))), " | "), F.lit(" |")))
    rule = F.concat(F.lit("|"), F.array_join(F.array_repeat(F.lit(" --- "), width), "|"), F.lit("|"))
    return F.array_join(F.concat(F.slice(lines, 1, 1), F.array(rule), F.slice(lines, F.lit(2), F.size(lines))), "\n")


def language(text: Column) -> Column:
    head = F.substring(text, 1, 500)
    return F.when(_len_without(head, CJK) > _len_without(head, "[A-Za-z]"), "zh").otherwise("en")


def poor_extraction(text: Column) -> Column:
    """Whether a page of some length is broken into single characters."""
    words = F.array_remove(F.split(text, r"\s+"), "")
    n = F.size(words)
    single = F.size(F.filter(words, lambda w: F.length(w) == 1))
    mean = F.aggregate(words, F.lit(0), lambda a, w: a + F.length(w)) / F.greatest(n, F.lit(1))
    return F.when((F.length(text) < 100) | (n < 20), False).otherwise((single > 0.8 * n) | (mean < 1.5))


# What messages of errors that no repeat mends have, in lower case.
FATAL = (
    "insufficient balance", "error code: 402", "invalid api key", "invalid_api_key", "error code: 401", "unauthorized", "authentication failed", "authentication error",
    "error code: 403", "forbidden", "api key not valid", "invalid authentication", "account deactivated", "account suspended", "rate limit exceeded", "quota exceeded",
)


def has_any(text: Column, words) -> Column:
    """Whether the text has one of the words, as they are."""
    return text.rlike("|".join(rf"\Q{w}\E" for w in words))


def is_fatal(message: Column) -> Column:
    return has_any(F.lower(message), FATAL)


# Words of questions that ask for a whole list, and of questions that ask for a tool, by tool in order.
LIST_WORDS = ("列出", "列表", "采购清单", "所有", "全部", "都有哪些", "有哪些", "多少", "几个", "几项", "包含", "包括", "list", "all", "every", "what are", "how many", "enumerate")
TOOL_WORDS = {
    "extract_dates": ("有效时间", "关键日期", "提取日期", "截止日期", "投标时间", "有效期", "时间信息", "日期信息"),
    "extract_budget": ("预算", "价格", "报价", "费用", "成本", "总价", "金额", "采购金额", "预算价", "控制价", "标底"),
    "add_to_timeline": ("添加到时间线", "添加该项目到", "加入时间线", "项目管理时间线", "添加到项目管理", "加入项目管理"),
}


def asks_for_list(question: Column) -> Column:
    return has_any(F.lower(question), LIST_WORDS)


def asked_tool(question: Column) -> Column:
    """The first tool whose words a question has; null for none."""
    return F.coalesce(*[F.when(has_any(question, words), F.lit(tool)) for tool, words in TOOL_WORDS.items()])


def budget_in_wan(budget: Column, unit: Column) -> Column:
    return F.when(unit == "元", budget / 10000).when(unit == "亿元", budget * 10000).otherwise(budget)


def timeline_status(start: Column, end: Column, today: Column) -> Column:
    return (
        F.when(end.isNull(), "active").when(end < today, "expired").when(end <= F.date_add(today, 30), "expiring_soon")
        .when(start > today, "future").otherwise("active")
    )


def code_level(code: Column) -> Column:
    return F.size(F.split(code, r"\."))


def code_key(code: Column) -> Column:
    """The parts of a dotted code as numbers, 999 for what is none: sorts as the sections do."""
    return F.transform(F.split(code, r"\."), lambda p: F.coalesce(p.try_cast("int"), F.lit(999)))


def content_key(text: Column) -> Column:
    """Equal for equal content: MD5 of the length and the SHA-256 of the whole text."""
    return F.md5(F.concat(F.length(text).cast("string"), F.lit("_"), F.sha2(text, 256)))


def page_range(text: Column) -> Column:
    """'1-5' and '10' as (first, last); nulls for anything else."""
    first, last = F.regexp_extract(text, r"^\s*([0-9]+)", 1), F.regexp_extract(text, r"([0-9]+)\s*$", 1)
    fits = text.rlike(r"^\s*[0-9]+\s*(?:-\s*[0-9]+\s*)?$")
    return F.struct(F.when(fits, first.try_cast("int")).alias("first"), F.when(fits, last.try_cast("int")).alias("last"))


# Systems of numbering of titles, in the order they are tried; the last group is the number.
SYSTEMS = {
    "chapter": r"第([零一二三四五六七八九十百]+)章",
    "item": r"^([一二三四五六七八九十百]+)、",
    "bracket": r"（([一二三四五六七八九十百]+)）",
    "number": r"^(\d+)、",
    "section": r"^\d+\.(\d+)",
}


def numbering_system(title: Column) -> Column:
    """The first system of numbering that a title has; null for none."""
    return F.coalesce(*[F.when(title.rlike("(?U)" + p), F.lit(name)) for name, p in SYSTEMS.items()])


def cjk_number(text: Column) -> Column:
    """Chinese numerals below a thousand as a number; null for anything else."""
    parts = r"^(?:([一二三四五六七八九])?(百))?零?(?:([一二三四五六七八九])?(十))?([一二三四五六七八九])?$"
    part = lambda n: F.regexp_extract(text, parts, n)
    digit = lambda c: F.translate(c, "一二三四五六七八九", "123456789").try_cast("int")
    place = lambda n, worth: F.when(part(n + 1) != "", worth * F.when(part(n) != "", digit(part(n))).otherwise(1)).otherwise(0)
    value = place(1, 100) + place(3, 10) + F.when(part(5) != "", digit(part(5))).otherwise(0)
    return F.when(value > 0, value)


def title_number(title: Column) -> Column:
    """The number of a title in its system of numbering."""
    found = F.coalesce(*[F.when(title.rlike("(?U)" + p), F.regexp_extract(title, "(?U)" + p, 1)) for p in SYSTEMS.values()])
    # An array of one, so that the number is sought once, not for every place of it.
    return F.get(F.transform(F.array(found), lambda x: F.coalesce(x.try_cast("int"), cjk_number(x))), F.lit(0))
