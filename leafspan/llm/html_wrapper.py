"""Main text of HTML by wrappers: regular expressions without unions, inferred per host.

A page is a stream of tags and texts. Texts become slots, named by the block
tags around them, and what repeats side by side becomes a repeated group,
however long its period is, so that a page is a small expression. A text that
most of a host's distinct pages with its slot have there is a constant of the
template and a token of its own; all other slots are fields, whose texts vary.
Expressions of a host are aligned, two at a time, in memory that grows with
their lengths: where one has a repeated group and the other what the group
repeats, both get the group, and what only one of them has becomes optional.
Pages with the same expression count once, and a host's expressions are first
merged in salted parts and then together, so a large host is no large task.

An article's text is main text, whatever of it repeats on a host. Elsewhere the
wrapper decides: the fields of a page show which element holds most of what
varies, and constants outside of it go. Fields inside menus, headers, footers,
sidebars, notices, adverts, forms and comments, by the tags around them, serve
only where a host's template has no other field. Extraction reads a page's tags
again and keeps the texts in slots of the main text.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .common import cut

# A quoted value that runs on over tags up to the next tag's "=" was never closed: then the tag ends at its first ">".
_VALUES = r"(?:[^>\"']++|\"(?![^\"]*>[^\"]*<[a-zA-Z][^\"<>]*=\s*\")[^\"]*+\"|'(?![^']*>[^']*<[a-zA-Z][^'<>]*=\s*')[^']*+')*+"
_TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<!\[CDATA\[(.*?)(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    rf"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)(?:({_VALUES})>|([^>]*)(?:>|\Z))|([^<]+|<)",
    re.S,
)
_ATTRIBUTE = re.compile(r"([^\s\"'>/=]+)\s*(?:=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")

# Elements without an end, elements whose content is no text, elements inside a block, and what isn't main text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea svg iframe title".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
ASIDE_TAGS = frozenset("nav header footer aside form button select option menu dialog head object audio video canvas fieldset".split())
ASIDE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog form menu menubar toolbar".split())

# Words of class names and ids. ASIDE_WORDS say by themselves that a part isn't main text; WEAK_WORDS do
# only where no word but FRAME_WORDS stands beside them; inside an article that, or OWNER_WORDS, is asked of all.
ASIDE_WORDS = frozenset(
    "nav navbar navigation menu menus breadcrumb breadcrumbs sidebar sidebars aside footer masthead advert adverts advertisement advertising sponsor sponsored sponsors promo promos promotion "
    "banner banners cookie cookies consent gdpr popup modal overlay newsletter subscribe subscription comment comments respond disqus pagination pager login signup signin".split()
)
WEAK_WORDS = frozenset("ad ads adv header related recommended recommendations recommend notice notices share sharing social search widget widgets reply replies discussion".split())
FRAME_WORDS = frozenset(
    "site page top bottom left right side global main box bar block list items item links link posts articles stories news content contents container wrapper wrap inner outer area section unit slot label "
    "button buttons icon icons form field row col column group panel primary secondary first last new more also you may like sticky fixed small large responsive mobile desktop".split()
)
OWNER_WORDS = frozenset("article post entry blog story reader readers user users visitor visitors your the".split())
MAIN_TAGS = frozenset(("article", "main"))
# Blocks that hold text and aren't what holds a page's blocks together.
TEXT_BLOCKS = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd td th tr pre blockquote figcaption caption".split())


def _aside_name(value: str, inside: bool, title_like: bool) -> bool:
    """Whether a class, an id or a label names a part outside the main text; inside: within an article; title_like: of a section or heading."""
    for token in value.split():
        words = {w.lower() for w in _PARTS.findall(token)}
        strong = {w for w in words if w in ASIDE_WORDS or w.endswith(("comments", "sidebar", "navbar", "breadcrumbs"))}
        weak = words & WEAK_WORDS
        rest = {w for w in words - strong - weak - FRAME_WORDS if not w.isdigit()}
        if strong and (not inside or not rest - OWNER_WORDS):
            return True
        if weak and not rest and not (title_like and inside):
            return True
    return False


@lru_cache(maxsize=20_000)
def _place_of(above: str, tag: str) -> str:
    """A place is the number of its block tags from the root, so a deep one is no longer than others."""
    return f"{tag}.{xxhash.xxh64_hexdigest(above + '/' + tag)}"


@lru_cache(maxsize=20_000)
def _aside_of(tag: str, attributes: str, inside: bool) -> int:
    """Whether a tag with its attributes looks like (1), or is hidden and so lies (2) outside the main text."""
    aside = int(tag in ASIDE_TAGS and not (tag == "header" and inside))
    for name, value in _ATTRIBUTE.findall(attributes) if attributes else ():
        value, name = value.strip("\"'"), name.lower()
        if name == "hidden" or (name == "style" and re.search(r"display\s*:\s*none", value)):
            aside = 2
        elif aside or tag in ("html", "body", "article", "main"):
            continue
        elif name == "role":
            aside = int(value.lower() in ASIDE_ROLES)
        elif name in ("class", "id", "aria-label"):
            aside = int(_aside_name(html.unescape(value), inside, tag in ("section", "h1", "h2", "h3", "h4", "h5", "h6")))
    return aside


class _Place:
    """Open elements: their tags, the place's number, and whether they, or one around them, look like (1) or are hidden and so lie (2) outside the main text."""

    def __init__(self):
        self.open: list[tuple[str, int, bool, str, int]] = []
        self.times: dict[str, int] = {}
        self.begun = 0

    def start(self, tag: str, attributes: str) -> None:
        if tag in VOID:
            return
        above = self.open[-1] if self.open else ("", 0, False, "", 0)
        aside = (_aside_of if len(attributes) < 200 else _aside_of.__wrapped__)(tag, attributes, above[2])
        if tag in ("p", "li", "tr", "td", "th", "dt", "dd", "option"):
            self._imply(tag)
            above = self.open[-1] if self.open else ("", 0, False, "", 0)
        self.begun += 1
        place = above[3] if tag in INLINE else _place_of(above[3], tag)
        self.open.append((tag, max(above[1], aside), above[2] or tag in MAIN_TAGS, place, self.begun))
        self.times[tag] = self.times.get(tag, 0) + 1

    def _cut(self, k: int) -> None:
        for tag, *_ in self.open[k:]:
            self.times[tag] -= 1
        del self.open[k:]

    def _imply(self, tag: str) -> None:
        """A new paragraph or item ends an open one of its kind, with the inline elements in it."""
        for k in range(len(self.open) - 1, -1, -1) if self.times.get(tag) else ():
            if self.open[k][0] == tag:
                self._cut(k)
                return
            if self.open[k][0] not in INLINE:
                return

    def end(self, tag: str) -> None:
        for k in range(len(self.open) - 1, -1, -1) if self.times.get(tag) else ():
            if self.open[k][0] == tag:
                self._cut(k)
                return
            if self.open[k][0] in MAIN_TAGS | {"nav", "aside", "footer", "form"} and tag in INLINE | {"p", "div"}:
                return  # a stray end tag doesn't close a section

    def slot(self) -> str:
        """The place as the wrapper knows it: a number of its block tags, + in the main part, - outside the text, ~ hidden."""
        above = self.open[-1] if self.open else ("", 0, False, "", 0)
        return above[3] + ("~" if above[1] > 1 else "-" if above[1] else "+" if above[2] else "")


_ENDS = {tag: re.compile(rf"</{tag}\s*>", re.I) for tag in RAW}


def read(page: str, place: _Place | None = None) -> Iterator[tuple[str, str]]:
    """(slot, text) of the texts of a page, and (slot, "\\n") where a block begins or ends.

    An element that closes itself (<x/>) is empty. One whose content is no text
    goes with it; without an end it is a tag alone, but for scripts and styles,
    which reach to the end of the page.
    """
    place, at, endless = place or _Place(), 0, set()
    while m := _TOKEN.match(page, at):
        at = m.end()
        if m[6] is not None:
            yield place.slot(), " " if m[6] == "\n" else m[6]
        elif m[1] is not None:
            yield place.slot(), m[1].replace("&", "&amp;")
        elif m[3] is not None:
            tag, attributes = m[3].lower(), m[4] if m[4] is not None else m[5]
            if tag not in INLINE or tag == "br":
                yield place.slot(), "\n"
            if m[2]:
                place.end(tag)
            elif attributes.rstrip().endswith("/"):
                continue
            elif tag in RAW:
                end = None if tag in endless else _ENDS[tag].search(page, at)
                if end:
                    at = end.end()
                elif tag in ("script", "style"):
                    at = len(page)
                else:
                    endless.add(tag)
            else:
                place.start(tag, attributes)


def _number(text: str) -> int:
    """A signed 64-bit hash."""
    h = xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass"))
    return h - (1 << 64) if h >> 63 else h


def keyed(page: str) -> Iterator[tuple[str, str, int]]:
    """read() with a number for slot and text. It is that of all text that a slot has in its block, so words between inline tags have none of their own."""
    block: list[tuple[str, str]] = []

    def numbered() -> Iterator[tuple[str, str, int]]:
        whole: dict[str, str] = {}
        for slot, text in block:
            whole[slot] = whole.get(slot, "") + text
        numbers = {slot: _number(slot + "\x00" + " ".join(text.split())) for slot, text in whole.items()}
        yield from ((slot, text, numbers[slot]) for slot, text in block)
        block.clear()

    for slot, text in read(page):
        if text == "\n":
            yield from numbered()
            yield slot, text, 0
        else:
            block.append((slot, text))
    yield from numbered()


def blocks_of(page: str) -> tuple[int, list[dict]]:
    """The page's number and its blocks: slot, number of slot and text, and times on the page; text 0 stands for the slot itself.

    The page's number is that of its longest block outside of menus and the
    like, so that near copies of a page are one and don't make its text a constant.
    Pages whose longest block is a constant are one too: that keeps text, it loses none.
    """
    lengths: dict[tuple[str, int], int] = {}
    times: dict[tuple[str, int], int] = {}
    last = None
    for slot, text, number in keyed(page):
        if text == "\n":
            last = None
            continue
        if text.isspace():
            continue
        at = (slot, number)
        if last != at:
            times[at] = times.get(at, 0) + 1
            lengths[at] = 0
        lengths[at] += len(text)
        last = at
    likely = [at for at in lengths if not at[0].endswith(("-", "~"))]
    longest = max(likely, key=lambda at: (lengths[at], at[1]))[1] if likely else _number(page)
    slots = {s: _number(s) for s, _ in times if not s.endswith("+")}
    rows = [{"slot": slots[s], "text": number, "times": n} for (s, number), n in times.items() if s in slots]
    return longest, rows + [{"slot": n, "text": 0, "times": 0} for n in slots.values()]


def _parts(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Batches in parts of so many pages, as what is made of a page is larger than the page."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def constants(pages: DataFrame) -> DataFrame:
    """(host, texts): numbers of a host's constants, over the table (host, html).

    A constant repeats: it stands on more than half of the distinct pages that have
    its slot, the same number of times, and on more than one; so a host has at
    most twice as many as an average page has blocks. Texts in articles are none.
    """
    block = pa.list_(pa.struct([("slot", pa.int64()), ("text", pa.int64()), ("times", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _parts(batches):
            got = [blocks_of(page.as_py() or "") for page in batch.column(1)]
            whole = [_number(page.as_py() or "") for page in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([n for n, _ in got], pa.int64()), pa.array(whole, pa.int64()), pa.array([b for _, b in got], block)], ["host", "page", "whole", "blocks"])

    read_ = pages.select("host", "html").mapInArrow(run, "host string, page bigint, whole bigint, blocks array<struct<slot:bigint,text:bigint,times:int>>")
    distinct = read_.groupBy("host", "page").agg(F.min(F.struct("whole", "blocks")).alias("one"))
    counts = cut(distinct.select("host", F.inline("one.blocks")).groupBy("host", "slot", "text", "times").agg(F.count("*").alias("n")).where("n > 1"))
    slots = counts.where("times = 0").select("host", "slot", F.col("n").alias("with_slot"))
    most = counts.where("times > 0").join(slots, ["host", "slot"]).where("2 * n > with_slot")
    return most.groupBy("host").agg(F.sort_array(F.collect_set("text")).alias("texts"))


def expression(page: str, fixed: frozenset[int] | set[int] = frozenset()) -> tuple[str, ...]:
    """The page as a sequence of slots with text, neighbours of one kind folded into a repeated group (+); fixed texts are tokens, a slot and a number."""
    out: list[str] = []
    for slot, text, number in keyed(page):
        if text != "\n" and not text.isspace():
            token = f"{slot}\x00{number}" if number in fixed else slot
            if out and out[-1].rstrip("\x01") == token:
                out[-1] = token + "\x01"
            else:
                out.append(token)
    return tuple(out)


REPEATED, OPTIONAL = "\x01", "\x02"  # marks behind a token
_GROUP = re.compile("[\x03\x04\x05]")  # around and between the tokens of a group
_PRIME, _BASE = (1 << 61) - 1, 1_000_003


def bare(token: str) -> str:
    return token.rstrip("\x01\x02")


def marked(token: str, *others: str) -> str:
    """A token with the marks of others too."""
    marks = {m for x in (token, *others) for m in x[len(bare(x)) :]}
    return bare(token) + "".join(sorted(marks))


def group(tokens: list[str]) -> str:
    return "\x03" + "\x04".join(tokens) + "\x05" + REPEATED


def tokens_of(token: str) -> list[str]:
    """The slots of a token, those of a group from within it, with their marks; optional groups make them optional."""
    if not token.startswith("\x03"):
        return [token]
    own = [t for t in _GROUP.split(bare(token)) if t.strip("\x01\x02")]
    return [marked(t, OPTIONAL) for t in own] if OPTIONAL in token[len(bare(token)) :] else own


def fold(e: tuple[str, ...]) -> tuple[str, ...]:
    """Runs that stand twice or more one after the other, of any length, become one repeated group; marks of their tokens are put together.

    A run that ends at the last token has its period from where the last 1, 2,
    4, ... tokens stood before; hashes of prefixes compare runs at once.
    """
    out: list[str] = []
    prefix, power, last = [0], [1], {}
    due: dict[int, tuple[int, list[str], int, str]] = {}  # the length at which a group could have come once more: its place, tokens, their hash, itself

    def run(i: int, j: int) -> int:
        return (prefix[j] - prefix[i] * power[j - i]) % _PRIME

    def push(token: str) -> None:
        out.append(token)
        prefix.append((prefix[-1] * _BASE + hash(bare(token))) % _PRIME)
        if len(power) <= len(out):
            power.append(power[-1] * _BASE % _PRIME)

    def together(n: int, content: list[str], more: list[str]) -> None:
        content = [marked(x, y) for x, y in zip(content, more, strict=True)]
        del out[n:], prefix[n + 1 :]
        push(content[0] if len(content) == 1 and content[0].startswith("\x03") else marked(content[0], REPEATED) if len(content) == 1 else group(content))
        if len(content) > 1:
            h = 0
            for x in content:
                h = (h * _BASE + hash(bare(x))) % _PRIME
            due[n + 1 + len(content)] = n, content, h, out[n]

    def shrink() -> bool:
        n = len(out)
        if n in due:
            at, content, h, token = due[n]
            if out[at] == token and run(at + 1, n) == h:
                together(at, content, out[at + 1 :])
                return True
        k = 1
        while k <= n:
            key = (k, run(n - k, n))
            p = n - last.get(key, n)
            last[key] = n
            if k <= p and 2 * p <= n and run(n - 2 * p, n - p) == run(n - p, n):
                together(n - 2 * p, out[n - 2 * p : n - p], out[n - p :])
                return True
            k *= 2
        return False

    for token in e:
        push(token)
        while shrink():
            pass
    return tuple(out)


def grouped(e: tuple[str, ...], other: tuple[str, ...]) -> tuple[str, ...]:
    """e with the groups of the other expression where it has what they repeat once: a mismatch of a group and its content."""
    starts: dict[str, list[tuple[list[str], str]]] = {}
    for token in set(other) - set(e):
        if token.startswith("\x03"):
            content = [bare(t) for t in _content(token)]
            starts.setdefault(content[0], []).append((content, marked(bare(token), REPEATED)))
    if not starts:
        return e
    names, out, at = [bare(t) for t in e], [], 0
    while at < len(e):
        for content, token in sorted(starts.get(names[at], ()), key=lambda x: (-len(x[0]), x[1])):
            if names[at : at + len(content)] == content:
                out.append(token)
                at += len(content)
                break
        else:
            out.append(e[at])
            at += 1
    return tuple(out)


def _content(token: str) -> list[str]:
    """The tokens of a group, groups within it whole."""
    out, depth, start = [], 0, 1
    for k, c in enumerate(token):
        if c == "\x03":
            depth += 1
        elif c == "\x05":
            depth -= 1
        if (c == "\x04" and depth == 1) or (c == "\x05" and depth == 0):
            out.append(token[start:k])
            start = k + 1
    return out


def _common(left: np.ndarray, right: np.ndarray) -> list[tuple[int, int]]:
    """Pairs of places of a longest common subsequence, in memory that grows with the lengths: halves of left meet parts of right."""

    def ahead(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        row = np.zeros(len(b) + 1, np.int32)
        for x in a:
            row[1:] = np.maximum.accumulate(np.maximum(row[1:], row[:-1] + (b == x)))
        return row

    out, todo = [], [(0, len(left), 0, len(right))]
    while todo:
        i, n, j, m = todo.pop()
        while i < n and j < m and left[i] == right[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        while i < n and j < m and left[n - 1] == right[m - 1]:
            n, m = n - 1, m - 1
            out.append((n, m))
        if i == n or j == m:
            continue
        if n - i == 1:
            at = np.flatnonzero(right[j:m] == left[i])
            if len(at):
                out.append((i, j + int(at[0])))
            continue
        half = (i + n) // 2
        split = j + int(np.argmax(ahead(left[i:half], right[j:m]) + ahead(left[half:n][::-1], right[j:m][::-1])[::-1]))
        todo += [(i, half, j, split), (half, n, split, m)]
    return sorted(out)


def align(a: tuple[str, ...], b: tuple[str, ...]) -> tuple[str, ...]:
    """The union-free expression of two: what both have once, what one has marked optional.

    A repeated group matches what it repeats, and stays repeated.
    """
    a, b = grouped(a, b), grouped(b, a)
    numbers = {x: k for k, x in enumerate({bare(x) for x in (*a, *b)})}
    left, right = (np.array([numbers[bare(x)] for x in e], np.int64) for e in (a, b))
    out: list[str] = []
    i = j = 0
    for x, y in [*_common(left, right), (len(a), len(b))]:
        out += [marked(t, OPTIONAL) for t in (*a[i:x], *b[j:y])]
        if x < len(a):
            out.append(marked(a[x], b[y]))
        i, j = x + 1, y + 1
    return tuple(out)


def _merge(table: pa.Table) -> pa.Table:
    """One expression for all of a group's."""
    merged, n = None, 0
    for row in sorted(table.to_pylist(), key=lambda r: (-r["n"], r["slots"])):
        own = tuple(row["slots"])
        merged = own if merged in (None, own) else align(merged, own)
        n += row["n"]
    return pa.table({"host": pa.array([table["host"][0].as_py()], pa.string()), "slots": pa.array([list(merged or ())], pa.list_(pa.string())), "n": pa.array([n], pa.int64())})


BROADCAST_BYTES = 32 << 20


def _small(df: DataFrame, column: str, each, most: int) -> bool:
    """Whether all arrays of a column are at most so many bytes together; each is an element's."""
    size = df.agg(F.sum(64 + F.aggregate(column, F.lit(0).cast("bigint"), lambda a, x: a + each(x))).alias("n")).first()["n"]
    return (size or 0) <= most


def wrappers(pages: DataFrame, most: int = 256, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """(host, slots, n): the wrapper of every host, over the table (host, html).

    A task merges about most expressions: a host's are dealt into so many parts,
    in two rounds, that a host of most**3 expressions has no larger task.
    """
    fixed = cut(constants(pages))
    small = _small(fixed, "texts", lambda x: F.lit(8), broadcast_bytes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: dict[tuple, int] = {}
            for host, page, texts in zip(*batch.columns, strict=True):
                key = (host.as_py(), fold(expression(page.as_py() or "", set(texts.as_py() or ()))))
                counts[key] = counts.get(key, 0) + 1
            yield pa.RecordBatch.from_arrays(
                [pa.array([h for h, _ in counts], pa.string()), pa.array([list(e) for _, e in counts], pa.list_(pa.string())), pa.array(list(counts.values()), pa.int64())], ["host", "slots", "n"]
            )

    kind = "host string, slots array<string>, n bigint"
    read_ = pages.select("host", "html").join(F.broadcast(fixed) if small else fixed, "host", "left").select("host", "html", "texts").mapInArrow(run, kind)
    one_each = cut(read_.groupBy("host", "slots").agg(F.sum("n").alias("n")))
    counts = one_each.groupBy("host").agg(F.count("*").alias("k"))
    salted = one_each.join(counts, "host").select("host", "slots", "n", F.pmod(F.xxhash64("slots"), F.ceil(F.col("k") / most)).alias("salt"))
    partial = cut(salted.groupBy("host", "salt").applyInArrow(_merge, kind))
    again = partial.groupBy("host").agg(F.count("*").alias("k"))
    salted = partial.join(again, "host").select("host", "slots", "n", F.pmod(F.xxhash64("slots"), F.ceil(F.col("k") / most)).alias("salt"))
    return salted.groupBy("host", "salt").applyInArrow(_merge, kind).groupBy("host").applyInArrow(_merge, kind)


def main_slots(slots: list[str]) -> set[str]:
    """The fields of a wrapper that hold main text: those in its article; without one on every page, also all that aren't aside.

    Where a template, known by its constants, has fields only in places that look like none of the main text, these are the main text.
    """
    tokens = [t for s in slots for t in tokens_of(s)]
    fields = [s for s in tokens if "\x00" not in s]
    names = {bare(s) for s in fields}
    inside = {s for s in names if s.endswith("+")}
    if any(bare(s).endswith("+") and OPTIONAL not in s for s in fields):
        return inside
    likely = inside | {s for s in names if not s.endswith(("+", "-", "~"))}
    return likely or ({s for s in names if s.endswith("-")} if len(fields) < len(tokens) else set())


def fixed_texts(slots: list[str]) -> set[int]:
    """The constants of a wrapper."""
    return {int(bare(t).split("\x00")[1]) for s in slots for t in tokens_of(s) if "\x00" in t}


def _kept_constants(page: str, parts: list[tuple[str, str, int]], wanted: set[str], fixed: set[int] | frozenset[int]) -> set[int]:
    """Places among parts of constants inside the element that holds most of the text that varies."""
    place, lengths, around, tags, own = _Place(), {}, [], {0: ""}, []
    for (slot, text, number), _ in zip(parts, read(page, place), strict=True):
        path = [(tag, n) for tag, *_, n in place.open] if text != "\n" else []
        around.append([n for _, n in path])
        if text == "\n" or text.isspace():
            continue
        tags.update({n: tag for tag, n in path})
        if number not in fixed and slot in wanted:
            own.append((len(text), around[-1]))
            for n in around[-1]:
                lengths[n] = lengths.get(n, 0) + len(text)
    total = sum(n for n, _ in own)
    # Elements are numbered as they begin, so the last with most of the text is the innermost.
    most = max((n for n, size in lengths.items() if 2 * size > total), default=0)
    path = next((p for _, p in own if most in p), [])
    above = [n for n in path[: path.index(most) + 1] if tags[n] not in TEXT_BLOCKS | INLINE] if most else []
    holder = above[-1] if above else 0
    return {k for k, p in enumerate(around) if not holder or holder in p}


def text_of(page: str, wanted: set[str], fixed: set[int] | frozenset[int] = frozenset()) -> str:
    """The texts in wanted slots: white space within a block is one blank, and so is what joins blocks.

    A page that has such a text in an article takes none from outside of it, and
    all of it. On other pages fixed texts outside of what holds the page's fields go.
    """
    parts = list(keyed(page))
    if any(s.endswith("+") and s in wanted and not t.isspace() for s, t, _ in parts):
        wanted = {s for s in wanted if s.endswith("+")}
    elif any(n in fixed for *_, n in parts):
        inside = _kept_constants(page, parts, wanted, fixed)
        places = wanted | {s for s, *_ in parts if not s.endswith(("+", "-", "~"))}
        parts = [x for k, x in enumerate(parts) if x[1] == "\n" or x[2] not in fixed or (k in inside and x[0] in places)]
        wanted = places if any(n in fixed for *_, n in parts) else wanted
    kept = [t if t == "\n" else html.unescape(t) for s, t, _ in parts if t == "\n" or s in wanted]
    return " ".join("".join(kept).split())


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Per row of pages: (id, url, text, n_chars); text is empty where there is none.

    Null and empty pages have an empty text, and pages with a null url share a
    wrapper; the same holds for repeated rows, which are extracted alike. An
    empty table gives an empty table. The wrappers are
    broadcast if they are at most broadcast_bytes together, else joined by host.
    """
    host = F.coalesce(F.lower(F.regexp_extract(F.col(url_col).cast("string"), r"://([^/?#]*)", 1)), F.lit(""))
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), host.alias("host"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html"))
    found = cut(wrappers(rows, broadcast_bytes=broadcast_bytes)).select("host", "slots")
    small = _small(found, "slots", lambda x: F.octet_length(x).cast("bigint") + 16, broadcast_bytes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[tuple, tuple] = {}
        for batch in _parts(batches):
            texts = []
            for page, slots in zip(batch.column(2), batch.column(3), strict=True):
                key = tuple(slots.as_py() or ())
                if key not in known:
                    known = known if len(known) < 10_000 else {}
                    known[key] = main_slots(list(key)), fixed_texts(list(key))
                texts.append(text_of(page.as_py(), *known[key]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["id", "url", "text", "n_chars"])

    joined = rows.join(F.broadcast(found) if small else found, "host", "left").select("id", "url", "html", "slots")
    kinds = [joined.schema[c].dataType.simpleString() for c in ("id", "url")]
    return joined.mapInArrow(run, f"id {kinds[0]}, url {kinds[1]}, text string, n_chars bigint")


def op4_html_extraction(spark, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet")).withColumnRenamed("id", "page_id")
