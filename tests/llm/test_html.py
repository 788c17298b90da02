"""HTML reading and alignment: broken markup, names, depth, and the aligner against brute force."""

import random
import re
import time
import tracemalloc
from pathlib import Path

import pytest

from leafspan.llm import html_wrapper as H


def text_of(page):
    return H.text_of(page, H.main_slots(list(H.expression(page))))


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("", ""),
        ("<article><h1>T</h1><svg/><p>Hello body</p></article>", "T Hello body"),
        ('<article><h1>T</h1><iframe src="x"/><p>Hello</p></article>', "T Hello"),
        ('<article><h1>T</h1><iframe src="x"><p>Hello</p></article>', "T Hello"),
        ("<article><p>a</p><svg><text>no</text></svg><script>if (a<b) no()</script><p>b</p></article>", "a b"),
        ("<article><p>a</p><script>never closed <p>b</p>", "a"),
        ("<article><p>a</p><figure><img><figcaption>caption</figcaption></figure></article>", "a caption"),
        ('<article><section id="related-work"><p>r</p></section><div class="article-header"><h1>x</h1></div><h2 id="comments-on-it">y</h2></article>', "r x y"),
        ('<article><p class="x>one two</p><p>three</p></article>', "one two three"),
        ('<p class="x>one two', "one two"),
        ('<article><p title="a > b" data-x="<b>q</b>" data-hidden="is hidden">t</p></article>', "t"),
        ('<article><p>a</p><div class="readercomments"><p>c</p></div><div id="discussion">d</div><section class="comments-area">e</section></article>', "a"),
        ('<article><p>a</p><div class="related-posts">r</div><p class="ad">z</p><p hidden>h</p><p style="display: none">n</p></article>', "a"),
        ('<div><p>x</p><div class="siteHeader">h</div><div class="sidebar-left">s</div><div role="navigation">n</div></div>', "x"),
        ("<article><p>1 &lt; 2 &amp;amp; &#233;<br>next</p><textarea>no</textarea></article>", "1 < 2 &amp; é next"),
        ("<article><header><h1>Title</h1></header><p>a<p>b<ul><li>c<li>d</ul><footer>f</footer></article><footer>g</footer>", "Title a b c d"),
    ],
)
def test_pages(page, text):
    assert text_of(page) == text


@pytest.mark.parametrize(
    "page",
    ["<div>" * 20_000 + "x<p>y" * 20_000, "<article>" + "<iframe>" * 50_000, "<p a='>" * 50_001, '<p a=">' * 50_001, "<b>x</i>" * 50_000, "<article><p>" + "word " * 1_000_000],
)
def test_time_grows_with_the_page(page):
    began = time.time()
    text_of(page)
    assert time.time() - began < 20


def brute_common(a, b):
    if not a or not b:
        return 0
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], last + 1 if x == y else max(row[j + 1], row[j])
    return row[-1]


def test_aligner_against_brute_force():
    """What both have once is the longest common subsequence; each expression is what is left without some optional slots."""
    r = random.Random(3)
    for _ in range(200):
        a, b = (tuple(r.choice("abcde") for _ in range(r.randrange(14))) for _ in range(2))
        got = H.align(a, b)
        assert sum("\x02" not in x for x in got) == brute_common(a, b)
        for own in (a, b):
            at = iter(got)
            assert all(any(y.rstrip("\x02") == x for y in at) for x in own)
        assert len(got) == len(a) + len(b) - brute_common(a, b)


def test_parts_of_a_large_host_give_one_wrapper(spark):
    """Expressions of one host in many parts; the template's constants go, fields stay."""
    r = random.Random(4)
    kinds = ["p", "h2", "li", "blockquote", "dd"]
    pages = []
    for k in range(120):
        body = "".join(f"<{t}>own {k} {n} with enough words to be the longest of the page</{t}>" for n, t in enumerate(r.choices(kinds, k=r.randrange(1, 7))))
        pages.append((k, "http://h.test/x", f"<div class=top>Always here</div><div>{body}</div><div><span>Never changes</span></div>"))
    df = spark.createDataFrame([*pages, (500, None, None), (501, "x", "")], "page_id long, url string, html string").repartition(3)
    assert {r["host"] for r in H.wrappers(df.selectExpr("'h' as host", "html"), most=3).collect()} == {"h"}
    got = {x["id"]: x["text"] for x in H.extract(df).collect()}
    assert got[500] == got[501] == "" and all("Always" not in got[k] and "Never" not in got[k] and f"own {k} 0" in got[k] for k in range(120))


def unfolded(e, rounds):
    """A text that an expression stands for: groups repeat so often."""
    out = []
    for token in e:
        own = unfolded(H._content(token), rounds) if token.startswith("\x03") else [H.bare(token)]
        out += own * (rounds if "\x01" in token[len(H.bare(token)) :] else 1)
    return out


@pytest.mark.parametrize("period", [1, 2, 3, 4, 5, 8, 13, 40])
def test_groups_of_any_period(period):
    """Runs fold whatever their length, also of tokens that come twice in one, also within other runs."""
    r = random.Random(period)
    for _ in range(20):
        run = [r.choice("abcdefgh") + str(k % 5) for k in range(period)]
        for times in (2, 3, 7):
            e = tuple(["x", *run * times, "y"])
            got = H.fold(e)
            assert len(got) <= 2 + period and got[0] == "x" and got[-1] == "y"
            assert H.fold(got) == got
    assert len(H.fold(("h2", "p", "ul") * 500)) == 1
    assert [H.bare(t) for t in H.tokens_of(H.fold(("h2", "p", "ul") * 500)[0])] == ["h2", "p", "ul"]
    assert len(H.fold(("t", *("a", "b") * 3, "c") * 4)) == 1


def test_folding_keeps_what_there_is():
    r = random.Random(9)
    for _ in range(300):
        e = tuple(r.choice("abc") for _ in range(r.randrange(30)))
        got = H.fold(e)
        assert {H.bare(t) for x in got for t in H.tokens_of(x)} == set(e)
        # The expression is a pattern that the sequence matches.
        pattern = lambda t: "(?:" + ("".join(map(pattern, H._content(t))) if t.startswith("\x03") else H.bare(t)) + ")" + "+" * ("\x01" in t[len(H.bare(t)) :])
        assert re.fullmatch("".join(map(pattern, got)), "".join(e)), (e, got)
    began = time.time()
    H.fold(tuple(f"s{r.randrange(300)}" for _ in range(50_000)))
    H.fold(tuple("ab"[k.bit_count() % 2] for k in range(20_000)))
    assert time.time() - began < 30


def test_a_group_meets_what_it_repeats():
    many, once = H.fold(("h", "p", "q", "p", "q", "f")), ("h", "p", "q", "x", "f")
    for a, b in ((many, once), (once, many)):
        assert H.align(a, b) == ("h", H.group(["p", "q"]), "x\x02", "f")
    assert H.main_slots(list(H.align(many, ("f",)))) == {"h", "p", "q", "f"}


def test_alignment_takes_memory_by_length():
    """Two sequences of 20,000 slots that share a tenth of them."""
    r = random.Random(6)
    a, b = (tuple(f"{side}{k}" if r.random() > 0.1 else f"same{k}" for k in range(20_000)) for side in "ab")
    tracemalloc.start()
    got = H.align(a, b)
    assert tracemalloc.get_traced_memory()[1] < 60 << 20
    tracemalloc.stop()
    assert sum("\x02" not in x for x in got) == len(set(a) & set(b))


@pytest.mark.parametrize("n", [1, 2, 3, 5])
def test_an_article_stays_whole_whatever_repeats(spark, n):
    """Headings and closing words that all pages of a host have are main text, with or without an article element."""
    for tag in ("article", "div"):
        pages = [(k, f"http://h.test/{k}", f"<body><div><b>Menu</b></div><{tag}><h2>Introduction</h2><p>unique words of page {k} and more of them</p><p>Results were measured twice.</p></{tag}></body>") for k in range(n)]
        got = {r["id"]: r["text"] for r in H.extract(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
        menu = "Menu " if tag == "div" and n == 1 else ""  # one page alone says nothing of what repeats
        assert got == {k: f"{menu}Introduction unique words of page {k} and more of them Results were measured twice." for k in range(n)}


DATA = "/root/testdata/sf0.01/pages.parquet"


@pytest.mark.skipif(not Path(DATA).exists(), reason="no test tables")
def test_what_the_wrapper_changes_on_the_tables(spark):
    """Pages of the tables with divs for articles and a notice of no telling name: without the host's wrapper the notice stays on all pages of hosts that have two and more; with it, on none, and no article loses a word."""
    import html as entities

    rows = spark.read.parquet(DATA).select("page_id", "url", "html").toPandas()
    article = rows["html"].str.extract(r"(?s)<article>(.*)</article>")[0]
    host = rows["url"].str.extract(r"://([^/?#]*)")[0].str.lower()
    rows["html"] = [h.replace("<article>", f'<div class="k1">Hosted by {o} since 2019</div><div class="k2">').replace("</article>", "</div>").replace('class="ad"', 'class="sidebar"') for h, o in zip(rows["html"], host)]
    own = {k: text_of(page) for k, page in zip(rows["page_id"], rows["html"])}
    got = {r["id"]: r["text"] for r in H.extract(spark.createDataFrame(rows)).collect()}
    several = set(host[host.duplicated(keep=False)])
    changed = {k for k in got if got[k] != own[k]}
    plain = lambda x: " ".join(re.sub(r"<[^>]*>", " ", x).split())
    for k, o, x in zip(rows["page_id"], host, article):
        assert f"Hosted by {o}" in own[k]
        assert (f"Hosted by {o}" in got[k]) == (o not in several), k
        assert entities.unescape(plain(x)) in got[k], k
    assert len(changed) == sum(o in several for o in host) > 200
