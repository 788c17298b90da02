"""Tokenizer, packing, HTML extraction, pipeline."""

import random
import re
from pathlib import Path

import numpy as np
import pytest

from leafspan.llm import html_wrapper, packing, pieces

TEXTS = ["", None, " ", "  two  blanks ", "plain words here", "Größe 中文 \U0001f600 <s> <0x0A>", "a\n\nb \n c\t", "▁x▁▁y", "é" * 500, "word " * 3000, "I'll 12 34!! x"]
needs_models = pytest.mark.skipif(not Path(pieces.DEFAULT_MODEL).exists(), reason="no tokenizer files")


@needs_models
def test_parity_with_the_library(spark):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.DEFAULT_MODEL)
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    got = {r["id"]: r for r in pieces.encode(df, verify=True).collect()}
    for i, t in enumerate(TEXTS):
        assert got[i]["input_ids"] == sp.encode(t or "") and got[i]["n_tokens"] == len(got[i]["input_ids"])
        assert got[i]["parity"] and got[i]["round_trip"]
    back = {r["id"]: r["text"] for r in pieces.decode(pieces.encode(df)).collect()}
    assert back == {i: (t or "").replace(pieces.MARK, " ") for i, t in enumerate(TEXTS)}
    assert pieces.encode(df.limit(0)).collect() == []


def model_file(path, pieces_, bpe, prefix, squeeze, bytes_):
    """A model as the library reads it, written field by field; nothing is trained."""
    import struct

    def varint(n):
        out = bytearray()
        while n > 127:
            out.append(n & 127 | 128)
            n >>= 7
        return bytes([*out, n])

    field = lambda k, v: varint(k << 3 | 2) + varint(len(v)) + v if isinstance(v, bytes) else varint(k << 3) + varint(v)
    body = b""
    for text, score, kind in pieces_:
        body += field(1, field(1, text.encode()) + varint(2 << 3 | 5) + struct.pack("<f", score) + field(3, kind))
    body += field(2, field(3, 2 if bpe else 1) + field(35, int(bytes_)) + field(40, 0))
    body += field(3, field(1, b"identity") + field(3, int(prefix)) + field(4, int(squeeze)) + field(5, 1))
    path.write_bytes(body)
    return str(path)


@pytest.mark.parametrize(("prefix", "squeeze", "bytes_"), [(True, False, True), (True, True, True), (False, False, False), (True, True, False)])
def test_unigram_models_agree_with_the_library(spark, tmp_path, prefix, squeeze, bytes_):
    import sentencepiece

    r = random.Random(1)
    own = {pieces.MARK, *"abcde", *(pieces.MARK * r.randrange(2) + "".join(r.choice("abcde") for _ in range(r.randrange(2, 5))) for _ in range(60))}
    rows = [("<unk>", 0.0, 2), ("<s>", 0.0, 3)] + [(f"<0x{b:02X}>", 0.0, 6) for b in range(256 * bytes_)] + [(w, -r.random() * 9 - 1, 1) for w in sorted(own)]
    path = model_file(tmp_path / "uni.model", rows, False, prefix, squeeze, bytes_)
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    codec = pieces.Codec(path)
    texts = ["", None, " ", "  ", "abc  de ", "a", " bad  cafe", "zz é", "edabc" * 400, *(" ".join("".join(r.choice("abcdez") for _ in range(r.randrange(6))) for _ in range(12)) for _ in range(40))]
    got = {x["id"]: x for x in pieces.encode(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), path, verify=True).collect()}
    for k, t in enumerate(texts):
        assert (got[k]["input_ids"] == sp.encode(t or "")) == got[k]["parity"], (k, t)
        assert got[k]["parity"], (t, got[k]["input_ids"], sp.encode(t or ""))
        normal = " ".join((t or "").split(" ")).strip(" ") if squeeze else t or ""
        normal = re.sub(" +", " ", normal) if squeeze else normal
        assert got[k]["round_trip"] == (codec.decode(np.array(got[k]["input_ids"])) == normal), t


def test_parity_is_false_where_ids_differ(tmp_path):
    rows = [("<unk>", 0.0, 2), *((c, -2.0, 1) for c in "ab" + pieces.MARK), ("ab", -1.0, 1), (pieces.MARK + "a", -1.5, 1)]
    for squeeze in (False, True):
        codec = pieces.Codec(model_file(tmp_path / f"m{squeeze}", rows, True, True, squeeze, False), verify=True)
        assert [ok for _, ok, _ in codec.encoded(["ab a", "b"])] == [True, True]
        codec.tokenizer = type("Wrong", (), {"encode_batch_fast": lambda self, words, **_: [type("E", (), {"ids": [1]})() for _ in words]})()
        codec.known = {}
        assert [ok for _, ok, _ in codec.encoded(["ab a", "", "b  "])] == [False, True, False]


def test_best_fit_decreasing_against_a_plain_search():
    r = random.Random(5)
    for _ in range(100):
        capacity = r.choice([1, 7, 64, 100])
        lengths = [r.randint(1, capacity) for _ in range(r.randrange(60))]
        rooms, rows = [], []
        for item in sorted(range(len(lengths)), key=lambda k: (-lengths[k], k)):
            fits = [x for x in rooms if x >= lengths[item]]
            if fits:
                k = rooms.index(min(fits))
                rooms[k] -= lengths[item]
                rows[k].append(item)
            else:
                rooms.append(capacity - lengths[item])
                rows.append([item])
        got = packing.best_fit_decreasing(lengths, capacity)
        assert sorted(i for row in got for i in row) == list(range(len(lengths)))
        assert all(sum(lengths[i] for i in row) <= capacity for row in got)
        assert sorted(sum(lengths[i] for i in row) for row in got) == sorted(capacity - x for x in rooms)


@needs_models
@pytest.mark.parametrize("capacity", [16, 2048])
def test_packing_loses_nothing(spark, capacity):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").repartition(2)
    rows = packing.pack(df, capacity).collect()
    bpe, found = packing.ByteBpe(packing.DEFAULT_VOCABULARY), {}
    for r in rows:
        ids, positions = np.frombuffer(r["input_ids"], np.uint16), np.frombuffer(r["position_ids"], np.uint16)
        assert len(ids) == capacity == len(positions) and r["cu_seqlens"][-1] == r["n_tokens"]
        for k, (d, o) in enumerate(zip(r["doc_ids"], r["offsets"])):
            part = slice(r["cu_seqlens"][k], r["cu_seqlens"][k + 1])
            assert positions[part].tolist() == list(range(part.stop - part.start))
            found[d, o] = ids[part].tolist()
    for i, t in enumerate(TEXTS):
        whole = sum((v for (d, _), v in sorted(found.items()) if d == i), [])
        assert whole == (bpe.coder.encode_ordinary(t) if t else [])
    again = {(r["doc_id"], r["offset"]): r["input_ids"] for r in packing.unpack(packing.pack(df, capacity)).collect()}
    assert again == found


def page(body, head="<title>t</title>"):
    return f"<!DOCTYPE html><html><head>{head}</head><body>{body}</body></html>"


PAGES = [
    (1, page('<nav><ul><li><a href="/">Home</a></li></ul></nav><div class="ad">Buy</div><article><h1>A &amp; B</h1><p>One <b>bold</b>\n  text.<br>More</p></article><footer>foot</footer>'), "A & B One bold text. More"),
    (2, page('<header>Head</header><main><p>Main&nbsp;part</p><script>var x="</p>";</script><form>Name <input></form><p>end<p>open</main><aside>side</aside>'), "Main part end open"),
    (3, page('<article><p>Text</p><div class="comments"><p>first!</p></div><style>p{}</style></article><div id="cookie-notice">ok?</div>'), "Text"),
    (4, page("<div><p>No article</p><p>here</p></div><footer>f</footer>"), "No article here"),
    (5, None, ""),
    (6, "", ""),
    (7, page("<article></article>"), ""),
]


def test_extraction(spark):
    df = spark.createDataFrame([(i, f"https://h{i % 2}.test/{i}", h, "x") for i, h, _ in PAGES] + [(8, None, PAGES[0][1], "x")], "page_id long, url string, html string, text string")
    for rows in (20_000, 0):
        got = {r["id"]: (r["text"], r["n_chars"]) for r in html_wrapper.extract(df, broadcast_bytes=rows).collect()}
        assert got == {**{i: (t, len(t)) for i, _, t in PAGES}, 8: (PAGES[0][2], len(PAGES[0][2]))}
    assert html_wrapper.extract(df.limit(0)).collect() == []


def test_the_wrapper_decides(spark):
    """Constants of a host go where they stand outside of what holds the fields, articles stay whole, fields stay even where only a form holds them; a single page of a host is read by its places."""
    menu, advert = "<div><span>Home</span> <span>News</span></div>", "<section>Buy <b>our</b> things</section>"
    plain = [page(f"{menu}<div><p>Own words {k}, and</p><p>more of {k}</p>{advert if k % 2 else ''}</div>") for k in range(8)]
    article = [page(f"<article><p>Text number {k} of the article</p><p>Sent by our <a>team</a></p></article>") for k in range(4)] + [page("<article><p>Sent by our <a>team</a></p></article><div>Alone outside of the article</div>")]
    form = [page(f'<form>{menu}<p>Said {k}</p><p style="display:none">state {k}</p></form>') for k in range(4)]
    copies = [page(f"<div><p>The same long text on every page</p></div><nav>{k}</nav>") for k in range(5)]
    hosts = {"plain": plain, "article": article, "form": form, "copies": copies, "single": plain[1:2]}
    rows = [(f"{h}{k}", f"http://{h}.test/{k}", p) for h, pages in hosts.items() for k, p in enumerate(pages)]
    df = spark.createDataFrame(rows, "page_id string, url string, html string")
    wanted = {f"plain{k}": f"Own words {k}, and more of {k}" + " Buy our things" * (k % 2) for k in range(8)} | {f"article{k}": f"Text number {k} of the article Sent by our team" for k in range(4)} | {f"form{k}": f"Said {k}" for k in range(4)}
    wanted |= {f"copies{k}": "The same long text on every page" for k in range(5)} | {"article4": "Sent by our team", "single0": "Home News Own words 1, and more of 1 Buy our things"}
    for n in (20_000, 0):
        assert {r["id"]: r["text"] for r in html_wrapper.extract(df, broadcast_bytes=n).collect()} == wanted


def test_wrappers_align(spark):
    assert html_wrapper.align(("a", "b\x01"), ("a", "b", "c")) == ("a", "b\x01", "c\x02")
    assert html_wrapper.fold(("a", "b", "a", "b", "a", "b", "c")) == (html_wrapper.group(["a", "b"]), "c")


@needs_models
def test_pipeline_against_its_stages(spark, tmp_path):
    """run() over planted documents: junk, copies, shared passages and leaks go, the rest stays whole."""
    import corpus_pipeline

    r = random.Random(2)
    vocabulary = ["the", "of", "and", *[f"{a}{b}an" for a in "bcdfg" for b in "aeiou"]]
    clean = [". ".join(" ".join(r.choice(vocabulary) for _ in range(12)).capitalize() for _ in range(6)) + "." for _ in range(60)]
    passage = " ".join(r.choice(vocabulary) for _ in range(60))
    leak = " ".join(f"leak{k}" for k in range(12))
    rows = [(k, t) for k, t in enumerate(clean)]
    rows += [(100 + k, "WIN!! CASH!! $$$ ### " * 12 + f"A{k}") for k in range(30)]
    rows += [(200, clean[3]), (201, clean[4] + " extra ending"), (202, f"{passage}\nown words of the first"), (203, f"other words of the second\n{passage}"), (204, clean[9][:150] + " " + leak)]
    spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i < 100), 0) for i, _ in rows if i < 130], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {x["doc_id"]: x["input_ids"] for x in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert set(got) >= set(range(60)) and not set(got) & {200, 201, 204, *range(100, 130)}
    codec = pieces.Codec(pieces.DEFAULT_MODEL)
    assert codec.decode(np.array(got[203])) == "other words of the second"
    assert all(codec.decode(np.array(got[k])) == clean[k] for k in range(60))


def test_rows_without_an_id_of_their_own_stay(spark, tmp_path):
    """Null and shared ids: one row of each group stays, contaminated rows go and only they."""
    import corpus_pipeline

    r = random.Random(8)
    words = [f"w{k}" for k in range(4000)]
    a, b, c, d, e = (" ".join(r.choice(words) for _ in range(60)) for _ in range(5))
    leak = " ".join(f"leak{k}" for k in range(12))
    rows = [(None, a), (None, b), (None, a), (1, a), (7, c), (7, d), (2, c), (7, f"{e} {leak}"), (None, f"{leak} {e[:100]}")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    alone = corpus_pipeline.keep_one_of_each(spark, df, str(tmp_path))
    assert sorted(map(tuple, alone.collect()), key=str) == sorted([(None, b), (1, a), (2, c), (7, d), *rows[-2:]], key=str)
    clean = corpus_pipeline.drop_contaminated(spark, df, str(tmp_path))
    assert sorted(map(tuple, clean.collect()), key=str) == sorted(rows[:-2], key=str)
