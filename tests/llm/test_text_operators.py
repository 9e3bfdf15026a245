"""Piece codec, chat formatting, HTML rendering and the quality classifier."""

import hashlib
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from foliospark.llm import chat_format, html_render, piece_codec, quality_classifier

ODD = " ▁ab\nthe<>s/0x\x00é日🙂\t…ñThe in"


@pytest.fixture(scope="module")
def codecs():
    sentencepiece = pytest.importorskip("sentencepiece")
    path = piece_codec.default_model()
    with open(path, "rb") as f:
        return piece_codec.PieceCodec(f.read(), most_cached=500), sentencepiece.SentencePieceProcessor(model_file=path)


def test_encodes_and_decodes_as_the_library(codecs):
    own, library = codecs
    rng = random.Random(1)
    texts = ["".join(rng.choice(ODD) for _ in range(rng.randint(0, 60))) for _ in range(3000)]
    texts += [" " * n + "a" for n in range(70)] + ["a" + " " * n for n in range(70)] + ["x" * 3000, "日" * 50, "aé" * 400, " ▁" * 40, "", " ", "</s><0x0A>"]
    texts += ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz  ,.") for _ in range(400)) for _ in range(100)]
    for text in texts:
        ids = library.encode(text, add_eos=True)
        assert own.encode(text) == ids
        assert own.decode(ids) == library.decode(ids)


def test_decodes_any_ids(codecs):
    own, library = codecs
    rng = random.Random(2)
    for _ in range(5000):
        ids = [rng.randrange(32_000) if rng.random() < 0.6 else rng.choice([0, 1, 2, 3, 200, 230, 150, 259, 28705]) for _ in range(rng.randint(0, 8))]
        assert own.decode(ids) == library.decode(ids)


def test_encode_documents(spark, codecs):
    _, library = codecs
    rows = [(1, None, "x"), (2, "", "y"), (3, "Hello  world\n" * 300, "z"), (3, "a", None), (None, "b", "w")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    made = piece_codec.encode_documents(docs, piece_codec.default_model(), outputs=tuple(piece_codec.OUTPUTS)).collect()
    assert len(made) == len(rows)
    for r in made:
        ids = library.encode(r.text or "", add_eos=True)
        assert (list(r.ids), r.n_tokens, r.decoded) == (ids, len(ids), r.text or "")
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(r.decoded.encode()).hexdigest()
    assert piece_codec.encode_documents(docs.limit(0), piece_codec.default_model()).collect() == []


PARTS = st.lists(st.sampled_from(["\\", "\\\\", "### ", "###", "</turn>", ": ", ":", "\n", "a", "assistant", " ", "é", "</turn"]), max_size=9).map("".join)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.tuples(PARTS, PARTS), max_size=4))
def test_chat_round_trip(turns):
    made = [chat_format.render_turn(*t) for t in turns]
    assert chat_format.parse("".join(m[0] for m in made)) == turns


@settings(max_examples=200, deadline=None)
@given(PARTS)
def test_loss_span(text):
    rendered, start, end = chat_format.render_turn("assistant", text)
    assert rendered[:start].endswith(": ") and rendered[end:].startswith("</turn>")
    assert chat_format.parse(f"### : {rendered[start:end]}</turn>\n") == [("", text)]


def test_format_conversations(spark):
    rows = [(1, 1, "assistant", "b </turn>"), (1, 0, "user", "a"), (1, 1, "assistant", "a"), (2, 0, None, None), (None, 0, "assistant", "x"), (3, None, "assistant", "y" * 200_000), (3, None, "assistant", "y" * 200_000)]
    turns = spark.createDataFrame([(*r, "q") for r in rows], "conv_id long, turn long, role string, text string, formatted string")
    made = {r.conv_id: r for r in chat_format.read_back(chat_format.format_turns(turns)).collect()}
    digest = lambda text: hashlib.sha256(text.encode()).hexdigest()
    assert made[1].turns_sha256 == digest("user\na\nassistant\na\nassistant\nb </turn>\n") and made[1].loss_sha256 == digest("ab </turn>") and made[1].loss_chars == 10
    assert made[2].n_turns == 1 and made[2].turns_sha256 == digest("\n\n") and made[2].loss_chars == 0
    assert made[None].loss_sha256 == digest("x")
    assert made[3].n_turns == 2 and made[3].loss_chars == 400_000
    assert chat_format.read_back(chat_format.format_turns(turns.limit(0))).collect() == []


CASES = {
    "<p>One<p>Two": "One\n\nTwo",
    "a<br>b<br><br>c": "a\nb\n\nc",
    "<ul><li>x<li>y<ul><li>z</ul></ul>t": "- x\n- y\n  - z\n\nt",
    "<ol start=3><li>x</li><li><p>y</p><p>w</p></li></ol>": "3. x\n4. y\n\n   w",
    "<table><tr><th>Name<th>N<tr><td>a<td>100<tr><td colspan=2>wide</table>": "Name | N\na    | 100\nwide |",
    "<div>a</div><div>b <b> c</b></div>": "a\nb c",
    "<script>x</p></script><style>p{}</style><p hidden>h</p><p style='color:red; display : none'>n</p><p>v": "v",
    "<head><title>t</title></head><body>b": "b",
    "<pre>\n a\n  b</pre>c": " a\n  b\n\nc",
    "x &amp; y &lt;z&gt; &copy;&nbsp;k": "x & y <z> ©\u00a0k",
    "<details><summary>s</summary>hidden</details><details open><summary>s</summary>shown</details>": "s\ns\nshown",
    "<!-- c --><![CDATA[ d ]]><?p x?>t": "t",
    "a<noscript>n</noscript><template><p>t</p></template>b": "ab",
    "a<textarea>\n u\n  v</textarea>b<select><option>o<optgroup label=g><option selected>p</select>": "a\n\n u\n  v\n\nb\no\ng\np",
    "<input value=Go type=submit> <input type=hidden value=no><input type=password value=no>": "Go",
    "<blockquote>q<p>r</blockquote>s": "  q\n\n  r\n\ns",
    "<dl><dt>t<dd>d<dt>u</dl>": "t\n  d\nu",
    "<a href=x>l</a> <img alt='pic'> <": "l pic <",
    "": "",
    "<table><tr><td><table><tr><td>in</table><td>out</table>": "in | out",
    "<h1>a<h2>b": "a\n\nb",
}


@pytest.mark.parametrize("markup", CASES)
def test_render(markup):
    assert html_render.render(markup) == CASES[markup]


#: Broken or unusual markup, as browsers show it.
BROWSERS = {
    "<p title=it's>Hello world, it's fine</p>": "Hello world, it's fine",
    '<a href="x"">text "q" more</a> end': 'text "q" more end',
    "<p class=a'>one two</p><p>three</p>": "one two\n\nthree",
    "<p a='>'>x</p><p b=\">\" c>y": "x\n\ny",
    "x<p": "x",
    "a < b </ c> d </": "a < b d </",
    "<table><tr><td rowspan=2>a<td>b<tr><td>c</table>": "a | b\n  | c",
    "<table><tr><td>1<td rowspan=0>2<tr><td>3<tr><td>4<td>5</table>": "1 | 2\n3 |\n4 |   | 5",
    "<table><tr><td colspan=2>wide<td>z<tr><td>1<td>2<td>3</table>": "wide |   | z\n1    | 2 | 3",
    "<table><tfoot><tr><td>f<tbody><tr><td>b<thead><tr><td>h</table>": "h\nb\nf",
    "<dialog open>o</dialog><dialog>n</dialog><dialog style='display:block'>d</dialog>": "o\nd",
    "<div style='visibility:hidden'>no<b style='visibility:visible'>yes</b>no</div>z": "yes\nz",
    "<p style='display:none;display:block'>a</p><p style='display:none!important;display:block'>b</p><p style='display:block;display:wrong'>c</p>": "a\n\nc",
    "<p hidden style='display:block'>a</p><p hidden>b</p><p style='x:\";display:none\"'>c</p>": "a\n\nc",
    "<ol><li value=7>a<li>b</ol>": "7. a\n8. b",
    "<ol reversed><li>a<li>b</ol>": "2. a\n1. b",
    "<ol start=-1><li>a<li>b<li>c</ol><ol start=12345678901><li>z</ol>": "-1. a\n0. b\n1. c\n\n12345678901. z",
    "<plaintext>a</p>": "a</p>",
    "<xmp><b>x</b></xmp>": "<b>x</b>",
}


@pytest.mark.parametrize("markup", BROWSERS)
def test_render_as_browsers_do(markup):
    assert html_render.render(markup) == BROWSERS[markup]


def plain_tokens(markup):
    """Character by character, by the states of the HTML standard."""
    space, i, n, out = " \t\n\f\r", 0, len(markup), []

    def text(t):
        if t:
            out.append(("text", t, None))

    while i < n:
        if markup[i] != "<":
            text(markup[i])
            i += 1
            continue
        if markup.startswith("<!--", i):
            i += 4
            if markup.startswith(">", i) or markup.startswith("->", i):
                i += 1 + markup.startswith("->", i)
                continue
            while i < n and not markup.startswith("-->", i) and not markup.startswith("--!>", i):
                i += 1
            i += 3 + markup.startswith("--!>", i)
            continue
        following = markup[i + 1 : i + 2]
        close = following == "/"
        first = markup[i + 2 : i + 3] if close else following
        if following in ("!", "?") and following or close and first and not (first.isascii() and first.isalpha()):
            while i < n and markup[i] != ">":
                i += 1
            i += 1
            continue
        if not (first and first.isascii() and first.isalpha()):
            text("<")
            i += 1
            continue
        i += 2 if close else 1
        name = ""
        while i < n and markup[i] not in space + "/>":
            name += markup[i]
            i += 1
        own = {}
        while i < n and markup[i] != ">":
            if markup[i] in space + "/":
                i += 1
                continue
            key, i = markup[i], i + 1
            while i < n and markup[i] not in space + "/>=":
                key += markup[i]
                i += 1
            j = i
            while j < n and markup[j] in space:
                j += 1
            value = ""
            if j < n and markup[j] == "=":
                i = j + 1
                while i < n and markup[i] in space:
                    i += 1
                if i < n and markup[i] in "'\"":
                    quote, i = markup[i], i + 1
                    while i < n and markup[i] != quote:
                        value += markup[i]
                        i += 1
                    i += 1
                else:
                    while i < n and markup[i] not in space + ">":
                        value += markup[i]
                        i += 1
            own.setdefault(key.lower(), value)
        if i >= n:
            break
        i += 1
        out.append(("end", name.lower(), None) if close else ("start", name.lower(), own))
    return joined(out)


def joined(tokens):
    """With texts beside each other as one."""
    out = []
    for kind, value, own in tokens:
        if kind == "text" and out and out[-1][0] == "text":
            out[-1] = (kind, out[-1][1] + value, None)
        else:
            out.append((kind, value, own))
    return out


MARKUP = st.lists(st.sampled_from(["<", "</", "<a", "<b ", "</b", "a", "B", " ", "=", '"', "'", "/", ">", ">", "<!--", "-->", "!", "-", "?", "\n", "x=1", "é"]), max_size=25).map("".join)


@settings(max_examples=3000, deadline=None)
@given(MARKUP)
def test_tokens_by_the_standard(markup):
    assert joined(html_render.tokens(markup)) == plain_tokens(markup)


#: Markup made to take long, about 1 MB each.
CRAFTED = ["<a><td>" + "<b>" * 20_000 + "</a>" * 20_000, "<p a='" * 150_000, "<!--" * 250_000, "<div x=" * 140_000, "<" * 1_000_000, "<title>" * 120_000, "<p style='" + "a:(" * 300_000 + "'>x", "<a " + " b=c" * 250_000 + ">t", "&" * 1_000_000, "<table><tr><td>" + "x<br>" * 100_000 + "<td>" * 10 + "y", "<table>" + "<tr><td rowspan=0 colspan=1000>a" * 10_000]


@pytest.mark.parametrize("markup", CRAFTED, ids=range(len(CRAFTED)))
def test_work_grows_with_the_page(markup):
    import time

    began = time.process_time()
    made = html_render.render(markup)
    assert time.process_time() - began < 8 and len(made) < 4 * len(markup)


def test_render_keeps_all_words():
    rng = random.Random(3)
    names = ["p", "div", "ul", "li", "table", "tr", "td", "b", "i", "span", "h1", "section", "br", "dl", "dt", "dd", "ol", "blockquote", "a", "tbody", "th"]
    for _ in range(1500):
        parts, words = [], []
        for i in range(rng.randint(1, 25)):
            kind = rng.random()
            if kind < 0.4:
                words.append(f"w{i}")
                parts.append(f" w{i} ")
            elif kind < 0.75:
                parts.append(f"<{rng.choice(names)}>")
            else:
                parts.append(f"</{rng.choice(names)}>")
        shown = [w for w in html_render.render("".join(parts)).split() if w.startswith("w")]
        assert sorted(shown) == sorted(words), parts


STRAYS = {
    "<table><tbody><tr><form><td>Name</td></form></tr></tbody></table>": "Name",
    "<table><tbody><tr><a href=x><td>a<td>b</a><tr><td>c<td>d</table>": "a | b\nc | d",
    "<table><thead><tr>x<div>y</div><td>z</table>": "x\ny\nz",
    "<table><tfoot><tr><form>l<td>v</form></table>": "l\nv",
    "<table><div><tr><td>a</div></table>": "a",
    "<table><colgroup><col><b>k</b></colgroup><tr><td>a</table>": "k\na",
    "<table><tbody hidden><tr>x<td>y</tbody><tr hidden>z<tr><td>a</table>": "a",
}


@pytest.mark.parametrize("markup", STRAYS)
def test_render_keeps_what_stands_outside_cells(markup):
    assert html_render.render(markup) == STRAYS[markup]


def test_render_shows_formulas_drawings_and_open_dialogs():
    assert html_render.render("a <math><mi>x</mi><mo>=</mo><mn>2</mn><annotation>T</annotation></math>") == "a x=2"
    assert html_render.render("<svg><title>t</title><desc>d</desc><text>label</text></svg>") == "label"
    assert html_render.render("<svg/>b<svg viewBox='0'><path d='M0'/><text>c</text></svg>d") == "bcd"
    assert html_render.render("<dialog open>o</dialog><dialog>n</dialog>p") == "o\np"


def test_render_keeps_all_words_of_broken_tables():
    rng = random.Random(5)
    names = ["table", "thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup", "form", "a", "div", "p", "b", "li"]
    for _ in range(3000):
        parts = ["<table>"]
        for i in range(rng.randint(1, 25)):
            parts.append(f" w{i} " if rng.random() < 0.35 else f"<{rng.choice(('', '', '/'))}{rng.choice(names)}>")
        shown = [w for w in html_render.render("".join(parts)).split() if w.startswith("w")]
        assert sorted(shown) == sorted(x.strip() for x in parts if x.startswith(" w")), parts


def test_render_deep_and_long(spark):
    assert html_render.render("<div>" * 50_000 + "x") == "x"
    assert "x" in html_render.render("<table><tr><td>" * 3000 + "x")
    assert len(html_render.render("<p>word " * 100_000)) == 600_000 - 2
    pages = spark.createDataFrame([(1, None, "k"), (2, "<p>a", None), (2, "<p>a", None)], "page_id long, html string, text string")
    made = sorted(html_render.extract_text(pages).select("page_id", "text").collect())
    assert made == [(1, ""), (2, "a"), (2, "a")]
    assert html_render.extract_text(pages.limit(0)).collect() == []


def prose(rng, n):
    return " ".join(rng.choice(["Alpha", "beta", "gamma,", "delta.", "epsilon", "of", "the"]) for _ in range(n))


def junk(rng, n):
    return " ".join(rng.choice(["BUY!!", "NOW!!", "$$$", "win***", "||"]) for _ in range(n))


def test_classifier_on_held_out_rows(spark):
    rng = random.Random(5)
    rows = [(i, (junk if i % 5 == 0 else prose)(rng, rng.randint(20, 80))) for i in range(1500)]
    docs = spark.createDataFrame([(i, t, 1.0) for i, t in rows], "doc_id long, text string, log_weight double")
    labels = spark.createDataFrame([(i, int(i % 5 != 0)) for i in range(400)], "doc_id long, quality int")
    made = {r.doc_id: r for r in quality_classifier.classify(docs, labels).collect()}
    assert len(made) == 1500 and all(made[i].kept == (i % 5 != 0) for i in range(400, 1500))
    again = {r.doc_id: r.draw for r in quality_classifier.classify(docs.repartition(5), labels).collect()}
    assert all(abs(again[i] - made[i].draw) < 1e-5 for i in made)


def test_features_tell_texts_apart():
    ours = lambda t: set(quality_classifier.features(t, 1 << 16).tolist())
    a, b = "это хороший текст про науку", "купи дешёвые таблетки прямо сейчас"
    assert not ours(a) & ours(b) and len(ours(a)) == 9
    assert len(ours("The committee met.") & ours("the casino met!")) == 2
    assert quality_classifier.TOKEN.findall("日本語 ok, 漢字!? a_b") == ["日", "本", "語", "ok", ",", "漢", "字", "!?", "a", "_", "b"]
    assert len(quality_classifier.features("w " * 100, 1 << 16)) == 199 and len(ours("w " * 100)) == 2


def test_classifier_by_brute_force(spark):
    import math
    import re
    from collections import Counter

    rng = random.Random(9)
    rows = [(i, (junk if i % 4 == 0 else prose)(rng, rng.choice([0, 1, 5, 40, 3000 if i % 100 == 1 else 30]))) for i in range(400)]
    rows[7] = (7, None)
    quality = {i: int(i % 4 != 0) for i in range(0, 400, 2)} | {i: 1 for i in range(1, 200, 4)}
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame(list(quality.items()), "doc_id long, quality int")
    number = lambda t: int(hashlib.md5(t.encode()).hexdigest()[:8], 16)
    seeded = lambda seed, key: int(hashlib.md5(f"{seed}:{key}".encode()).hexdigest()[:13], 16)

    def grams(text):
        own = [number(t) for t in re.findall(r"\w+|[^\w\s]+", (text or "").lower())]
        pairs = [0x5BD1E995 if a == b else a * 0x2545F491 + b for a, b in zip(own, own[1:])]
        return [x % 65536 for x in own] + [(x >> 24) % 65536 for x in pairs]

    half = {i for i in quality if seeded("half", i) % 2 == 0}
    raw = Counter(g for _, t in rows for g in grams(t))
    target = Counter(g for i, t in rows if i in half and quality[i] for g in grams(t))
    scale = sum(target.values()) / sum(raw.values())
    ratio = {g: math.log((target[g] + 10) / (n * scale + 10)) for g, n in raw.items()}
    weight = {i: sum(ratio[g] for g in grams(t)) * min(1, 64 / max(1, len(grams(t)))) for i, t in rows}
    held = sorted((weight[i] for i in quality if quality[i] and i not in half), reverse=True)
    floor = math.floor(held[max(1, len(held) - int(0.001 * len(held))) - 1] * 2**20) / 2**20 - 3
    k = sum(w >= floor for w in weight.values())
    draw = {i: math.floor((w - math.log(-math.log((seeded(11, i) + 0.5) / 2**52))) * 2**20) for i, w in weight.items()}
    least = sorted(draw.values(), reverse=True)[k - 1]
    made = {r.doc_id: r for r in quality_classifier.classify(docs, labels).collect()}
    assert all(abs(made[i].log_weight - w) < 1e-9 for i, w in weight.items())
    assert {i for i in made if made[i].kept} == {i for i in draw if draw[i] >= least} and 0 < k < 400


def test_classifier_passes_columns_on(spark):
    docs = spark.createDataFrame([(1, "a b", 5, "x", 7, True)], "doc_id long, text string, quality int, half string, target int, kept boolean")
    labels = spark.createDataFrame([(1, 1)], "doc_id long, quality int")
    made = quality_classifier.classify(docs, labels).first()
    assert (made.quality, made.half, made.target, made.text) == (5, "x", 7, "a b")


def test_classifier_edges(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (None, "a b"), (3, "a b"), (3, "a b")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert [r.kept for r in quality_classifier.classify(docs, none).collect()] == [True] * 5
    assert quality_classifier.classify(docs.limit(0), none).collect() == []
    labels = spark.createDataFrame([(3, 1), (3, None), (None, 1), (9, 0)], none.schema)
    assert len(quality_classifier.classify(docs, labels).collect()) == 5


def test_kth_largest(spark):
    rng = random.Random(6)
    values = [rng.uniform(-1e6, 1e6) for _ in range(300)] + [0.0] * 20 + [float("inf"), float("-inf"), 1e-9]
    keys = spark.createDataFrame([(v,) for v in values], "v double").select(quality_classifier.as_integer(F.col("v")).alias("key"))
    ordered = sorted((r.key for r in keys.collect()), reverse=True)
    for k in (1, 2, 100, 160, 323):
        assert quality_classifier.kth_largest(keys, k) == ordered[k - 1]
    assert quality_classifier.kth_largest(keys, 324) == -1
