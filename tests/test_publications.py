"""Functions, policies, trees, checks and whole conversions."""

import io
import os
import posixpath
import random
import zipfile
from urllib.parse import unquote

import pytest
from pyspark.sql import functions as F

from foliospark import functions as f
from foliospark.functions import paths
from foliospark.operators import assemble, assets, documents, tree, validate
from foliospark.plans import convert, inspect_books
from foliospark.plans.convert import publish
from foliospark.policy import ArchiveLimits, Options, PolicyError, check_directory_name, parse_css_vars, parse_spine_range, read_css
from foliospark.samples import PIXEL, Binder, small
from foliospark.sinks.publish import PublishError, reject_links
from foliospark.sinks.publish import publish as move_files
from foliospark.sources import archives
from foliospark.watch import Cancelled, Watch


def books(spark, *packed):
    return spark.createDataFrame([(f"b{i}", i, f"in/b{i}.epub", len(c), bytearray(c)) for i, c in enumerate(packed)], "book_id string, input_ord int, path string, length long, content binary")


def html_of(spark, packed, **options):
    done = convert(books(spark, packed), Options(**options))
    row = done.results.first()
    assert row.error is None, row.error
    return done.outputs.first().html, row, done


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


# functions


@pytest.mark.parametrize("text", ["Å", "a//b", "", "--", "İx", "ß", "日本", "A b", None])
def test_anchor(spark, text):
    import hashlib
    import re

    made = one(spark, f.stable_anchor(F.lit(text).cast("string")))
    if text is None:
        assert made is None
    else:
        slug = re.sub("[^a-z0-9]+", "-", text.lower()).strip("-") or "item"
        assert made == f"{slug}-{hashlib.sha256(text.encode()).hexdigest()[:10]}"


@pytest.mark.parametrize("name,stem,suffix", [("a/b.png", "b", ".png"), ("x", "x", ""), (".hid", ".hid", ""), ("a.tar.gz", "a.tar", ".gz"), ("a.b/c", "c", ""), ("x.", "x.", ""), ("a.p", "a", ".p")])
def test_names(spark, name, stem, suffix):
    assert one(spark, F.array(f.file_stem(F.lit(name)), f.file_suffix(F.lit(name)))) == [stem, suffix]


@pytest.mark.parametrize("path", ["./images\\cover%20art.png", "a/./b/../c", "../x", "100%.png", "a+b", "/r"])
def test_normalize(spark, path):
    wanted = posixpath.normpath(unquote(path).replace("\\", "/"))
    assert one(spark, f.normalize_path(F.lit(path))) == wanted and paths.plain_normalize(path) == wanted


def test_decoding(spark):
    rows = spark.createDataFrame([(bytearray("ü".encode()),), (bytearray(b"\xfc"),)], "content binary")
    assert [r.x for r in rows.select(f.text_or_null(F.col("content")).alias("x")).collect()] == ["ü", None]
    assert rows.select(f.decode_text("content").alias("x")).collect()[1].x


# policies


@pytest.mark.parametrize("bad", [{"newline": "x"}, {"exclude_content": frozenset(["zzz"])}, {"navigation_depth": 7}, {"deadline_seconds": 0}, {"spine_range": (3, 2)}, {"spine_range": (0, None)}, {"css_vars": (("a", " "),)}, {"images_dir_name": "../x"}, {"stable_mime_types": False}, {"limits": ArchiveLimits(max_images=0)}])
def test_bad_policies(bad):
    with pytest.raises(PolicyError):
        Options(**bad).check()


@pytest.mark.parametrize("name", ["../assets", "CON", "lpt1", "out.html", "a/b", "", "{stem}{stem}", "{x}"])
def test_directory_names(name):
    with pytest.raises(PolicyError):
        check_directory_name(name, output="out.html")


def test_parsing_of_options():
    assert [parse_spine_range(x) for x in ("2:3", "2:", ":3")] == [(2, 3), (2, None), (None, 3)]
    assert parse_css_vars(["a=b", "c = d=e"]) == (("a", "b"), ("c", "d=e"))
    for bad in ("x", "1", ":", "a:b"):
        with pytest.raises(PolicyError):
            parse_spine_range(bad)
    assert Options(css="x").wrapped and Options(navigation=True).wrapped and not Options().wrapped


# trees


def documents_of(spark, *html):
    return spark.createDataFrame([("a", i, f"d{i}.xhtml", h) for i, h in enumerate(html, 1)], "book_id string, doc_ord int, path string, text string")


def test_tree_rules():
    rows = tree.parse_rows("<p>a<br>b<p>c</div></p><script>x</p></script><i/>d &amp; &copy;")
    assert [(r[0], r[1], r[2], r[5] or r[7]) for r in rows] == [(0, -1, 9, "p"), (1, 0, 1, "a"), (2, 0, 2, "br"), (3, 0, 3, "b"), (4, 0, 5, "p"), (5, 4, 5, "c"), (6, 0, 7, "script"), (7, 6, 7, "x</p>"), (8, 0, 8, "i"), (9, 0, 9, "d & ©")]


def test_serialize_round_trip(spark):
    rng = random.Random(1)
    names = ["p", "div", "b", "br", "img", "section"]
    pages = ["".join(rng.choice([f"<{rng.choice(names)} a='{rng.choice(['x', '&quot;', '&amp;lt;'])}'>", f"</{rng.choice(names)}>", "t &lt; ", "<!-- c -->"]) for _ in range(30)) for _ in range(40)]
    nodes = tree.parse_nodes(documents_of(spark, *pages))
    first = {r.doc_ord: r.inner for r in tree.serialize(nodes).collect()}
    again = tree.parse_nodes(spark.createDataFrame([("a", k, v) for k, v in first.items()], "book_id string, doc_ord int, text string"))
    assert {r.doc_ord: r.inner for r in tree.serialize(again).collect()} == first


def test_sanitizer_is_idempotent(spark):
    page = "<div onclick=x style=y><script>a</script><a href='javascript:x'>t</a><a href='https://x'>u</a><img src='a.png' srcset='a.png 1x, http://h/b 2x'><form><input></form>keep<math>m</math></div>"
    clean, removed = documents.sanitize(tree.parse_nodes(documents_of(spark, page)))
    assert tree.serialize(clean).first().inner == '<div><a>t</a><a>u</a><img src="a.png"/>keep</div>'
    assert removed.first().removed == 8
    again, more = documents.sanitize(clean)
    assert more.first().removed == 0 and tree.serialize(again).first().inner == tree.serialize(clean).first().inner


def test_url_heads_judge_as_split_urls_do(spark):
    rng = random.Random(3)
    parts = ["http", "HTTPS", "data", "javascript", "mailto", "tel", ":", ":", "/", "//", "///", "?", "#", "[", "]", "[::1]", "image/png", "Image/GIF", ";", ",", "\t", "\n", "\r", "\x01", " ", "a", "1", "+", ".", "-", "é", "\u2100", "\u212a", "@", "%2f", "\\"]
    values = ["", "//", "a:", "//[", "data:///image/png", *["".join(rng.choice(parts) for _ in range(rng.randint(1, 6))) for _ in range(5_000)]]
    own = spark.createDataFrame([(t, a, v) for v in values for t, a in (("a", "href"), ("img", "src"))], "tag string, name string, value string").withColumn("url", f.strip_space(F.col("value")))
    own = own.withColumn("split", f.split_url("url")).withColumn("native", f.url_head(F.col("url")))
    judged = own.select("value", f.safe_url(F.col("tag"), F.col("name"), F.col("split")).alias("split"), f.safe_url(F.col("tag"), F.col("name"), F.col("native")).alias("native")).collect()
    assert {r.split for r in judged} == {True, False}
    assert [r for r in judged if r.split != r.native] == []


def test_documents_are_parsed_once_for_sections(spark):
    pages = ["<body onload=x><p>a<h2> T <b>u </b></h2><h1>v</h1><script>h</script></body>z", "<h3> </h3>x &lt; y", "no heading", "<h1>out</h1><body>in<a href='javascript:x'>l</a></body>", "<svg><h1>gone</h1></svg><h4>kept<svg>s</svg> too</h4>", ""]
    own = documents_of(spark, *pages)
    clean, removed = documents.sanitize(tree.parse_nodes(own))
    sections = documents.sections(clean, documents.allocate_targets(own), Options())
    made = {r.doc_ord: (r.title, r.html[r.html.index(">") + 1 : -len("</section>")]) for r in sections.collect()}
    assert made == {
        1: ("T u", "<p>a<h2> T <b>u </b></h2><h1>v</h1></p>"), 2: ("", "<h3> </h3>x &lt; y"), 3: (None, "no heading"),
        4: (None, "in<a>l</a>"), 5: ("kept too", "<h4>kept too</h4>"), 6: (None, ""),
    }
    assert {r.doc_ord: r.title for r in tree.first_headings(tree.inner_of(clean)).collect()} == {k: v for k, (v, _) in made.items() if v is not None}
    assert {r.doc_ord: r.removed for r in removed.collect()} == {1: 2, 2: 0, 3: 0, 4: 1, 5: 2}
    # what is made from nodes neither makes nor deals them again
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert [plan(df).count("MapInArrow") for df in (sections, removed, tree.first_headings(tree.parse_nodes(own)))] == [1, 1, 1]
    assert plan(sections).count("Join ") == 1


def test_outermost_removal_wins(spark):
    nodes = tree.parse_nodes(documents_of(spark, "<section class='toc'><div class='Cover'>x</div></section><div class='toc2'>y</div>"))
    assert tree.serialize(documents.filter_content(nodes, Options(remove_toc=True, remove_cover=True))).first().inner == '<div class="toc2">y</div>'


def test_media_follow_their_own_policy(spark):
    nodes = tree.parse_nodes(documents_of(spark, "<svg>s</svg><audio>a</audio>"))
    assert tree.serialize(documents.filter_content(nodes, Options(media_policy="preserve"))).first().inner == "<audio>a</audio>"


def test_plain_names():
    assert assets.plain_names(["a.png", "a.png", "a_2.png", "A.png", "x", "x", ".h", ".h"]) == ["a.png", "a_2.png", "a_2_2.png", "A_3.png", "x", "x_2", ".h", ".h_2"]


def test_dead_links(spark):
    nodes = tree.parse_nodes(documents_of(spark, "<a href='#x'>1</a><p id='x'>"))
    assert validate.dangling_fragments(nodes).collect() == [] and validate.duplicate_ids(nodes).collect() == []


# conversions


def test_navigation_and_metadata(spark):
    packed = Binder("La <Mer>", "fr-CA").leaf("One", "<p>1</p>").leaf("Two", "<h2>Sub</h2>")
    for fact in (("publisher", "P & Q"), ("rights", "all"), ("date", "2020"), ("description", "d"), ("subject", "s")):
        packed.fact(*fact)
    packed = packed.register().pack()
    html, row, _ = html_of(spark, packed, navigation=True, remove_toc=True, newline="crlf", css_vars=(("k", "v"),), reader_theme="dark")
    for part in ('lang="fr-CA"', "<title>La &lt;Mer&gt;</title>", 'aria-label="Table of contents"', ">One</a>", ">Two</a>", 'content="P &amp; Q"', "color-scheme: dark", "--k: v", "Skip to content", "Back to top", "\r\n"):
        assert part in html, part
    assert html.count("<meta name=") == 9 and row.chapters[1:] == ["One", "Two"]


def test_links_and_ids(spark):
    packed = Binder().leaf("One", '<p id="x">a</p><p id="x">b</p><a href="leaf-b.xhtml#y">l</a><a href="leaf-b.xhtml">m</a>').leaf("Two", '<p id="y">c</p>').pack()
    html, _, _ = html_of(spark, packed)
    import re

    ids = re.findall(r'id="([^"]*)"', html)
    assert len(ids) == len(set(ids)) and all(h in ids for h in re.findall(r'href="#([^"]*)"', html)) and html.count('href="#') == 2


@pytest.mark.parametrize("strategy", ["embed", "extract"])
def test_images(spark, strategy):
    packed = Binder().leaf("One", '<img src="../plates/p.png" srcset="../plates/p.png 1x, ../plates/none.png 2x"/>').plate("p.png").pack()
    html, row, done = html_of(spark, packed, image_strategy=strategy)
    assert row.images_processed == 1 and [w.code for w in row.warnings] == ["unresolved-image"]
    if strategy == "embed":
        assert html.count("data:image/png;base64,iVBOR") == 2
    else:
        assert 'src="b0_files/p.png"' in html and [(r.path, bytes(r.content)) for r in done.files.collect()] == [("b0_files/p.png", PIXEL)]


def test_safe_and_filters(spark):
    body = '<script>x</script><p onclick="x">keep</p><section class="appendix">gone</section><svg>s</svg><math>m</math>'
    html, row, _ = html_of(spark, Binder().leaf("One", body).pack(), safe_html=True, exclude_content=frozenset(["appendices"]))
    assert "keep" in html and not any(x in html for x in ("script", "onclick", "gone", "svg", "math"))
    assert [w.code for w in row.warnings] == ["unsafe-content-removed"]


def test_range_css_and_chunks(spark):
    packed = Binder().plate("p.png").look("q{background:url(../plates/p.png)}")
    for i in range(1, 5):
        packed.leaf(f"C{i}", "<p>t</p>")
    packed = packed.pack()
    html, _, _ = html_of(spark, packed, spine_range=(2, 3), chunked=True)
    assert "C2" in html and "C3" in html and "C1" not in html and "C4" not in html and html.endswith("</section>\n")
    html, _, _ = html_of(spark, packed, wrap_html=True, preserve_internal_css=True)
    assert "q{background:url('data:image/png" in html


def test_failures_are_rows(spark):
    packed = [small().pack(), b"junk", small().pack("mimetype"), small().stray("../x", b"1").pack(), small().pack(kind=b"application/epub+zip" + b" " * 3000), small().pack(kind=b"application/epub+zip" + b" " * 3000 + b"x"), small().stray("bomb", bytes(3_000_000)).pack(), small().pack("bound/all.opf")]
    done = convert(books(spark, *packed))
    rows = {r.book_id: (r.error_type, r.error) for r in done.results.collect()}
    assert rows["b0"] == (None, None) and {r.book_id for r in done.outputs.collect()} == {"b0"}
    says = ["", "not a ZIP", "missing members: mimetype", "unsafe member", "white space", "wrong mimetype", "ratio", "KeyError"]
    assert all(s in rows[f"b{i}"][1] for i, s in enumerate(says) if s) and rows["b6"][0] == "limit"


def test_fail_on_warning_and_size(spark):
    packed = Binder().leaf("One", '<img src="none.png"/>').pack()
    assert convert(books(spark, packed), Options(fail_on_warning=True, validate_output=False)).results.first().error_type == "warning"
    assert convert(books(spark, packed), Options(validate_output=False, limits=ArchiveLimits(max_output_bytes=10))).results.first().error_type == "limit"
    assert "none.png" in convert(books(spark, packed)).results.first().error


def test_inspection(spark):
    packed = Binder("T", "de").leaf("A", "a").plate("p.png").look("x").register().pack()
    row = inspect_books(books(spark, packed, b"junk")).collect()
    assert len(row) == 1 and row[0].title == "T" and row[0].language == "de" and row[0].spine == ["bound/leaves/register.xhtml", "bound/leaves/leaf-a.xhtml"] and row[0].media_types == {"application/xhtml+xml": 2, "image/png": 1, "text/css": 1}
    assert row[0].asset_bytes == sum(e.file_size for e in zipfile.ZipFile(io.BytesIO(packed)).infolist())


def test_equal_names_are_rows(spark):
    again = spark.createDataFrame([(f"{d}/b", i, f"{d}/b.epub", 1, bytearray(c)) for i, (d, c) in enumerate([("x", b"junk"), ("y", small().pack()), ("z", small().pack())])], "book_id string, input_ord int, path string, length long, content binary")
    done = convert(again, Options(validate_output=False))
    rows = {r.book_id: r for r in done.results.collect()}
    assert rows["y/b"].error is None and rows["z/b"].error_type == "output" and rows["x/b"].error_type == "invalid"
    assert [r.book_id for r in done.outputs.collect()] == ["y/b"] and rows["z/b"].output_path is None
    assert rows["y/b"].duration_seconds > 0 and rows["y/b"].images_path is None


def test_watching(spark):
    seen = []

    class Seen:
        def phase(self, description, total=None, unit=""):
            seen.append(description)

        def advance(self):
            seen.append(1)

        def phase_complete(self):
            seen.append(2)

    own = books(spark, small().pack())
    convert(own, Options(validate_output=False), observer=Seen())
    assert seen[:3] == ["preflight", 1, 2] and "sections" in seen and seen.count(1) == seen.count(2) > 8
    with pytest.raises(Cancelled, match="cancelled"):
        convert(own, cancelled=lambda: True)
    with pytest.raises(Cancelled, match="deadline"):
        convert(own, Options(deadline_seconds=0.2))


def test_deadline_ends_a_running_job(spark):
    def slow(batches):
        import time

        for batch in batches:
            time.sleep(20)
            yield batch

    with pytest.raises(Cancelled), Watch(spark, 1.0) as watch:
        spark.range(1).mapInArrow(slow, "id long").collect()
    assert watch.seconds < 15


def test_reader_can_be_replaced(spark):
    class Titled:
        zip_status, zip_entries, zip_members = staticmethod(archives.zip_status), staticmethod(archives.zip_entries), staticmethod(archives.zip_members)

        @staticmethod
        def package_rows(books):
            return archives.package_rows(books).withColumn("value", F.when((F.col("part") == "metadata") & (F.col("key") == "title"), "Other").otherwise(F.col("value")))

    made = convert(books(spark, small().pack()), Options(wrap_html=True, validate_output=False), reader=Titled)
    assert "<title>Other</title>" in made.outputs.first().html


def test_estimate_of_embedded_images(spark):
    packed = Binder().leaf("A", "a").plate("p.png", PIXEL + bytes(range(256)) * 40).pack()
    row = convert(books(spark, packed), Options(validate_output=False, limits=ArchiveLimits(max_output_bytes=5000))).results.first()
    assert row.error_type == "limit" and row.documents_processed == 0


def test_overlays_and_switches(spark):
    body = '<epub:switch xmlns:epub="http://www.idpf.org/2007/ops"><epub:case required-namespace="http://www.w3.org/1999/xhtml">kept</epub:case><epub:default>gone</epub:default></epub:switch>'
    binder = Binder().leaf("A", body)
    plain = binder.package()
    binder.package = lambda: plain.replace(b' id="l0"', b' id="l0" media-overlay="m1"')
    html, row, _ = html_of(spark, binder.pack(), preserve_media_overlays=True, wrap_html=True)
    assert 'data-media-overlays="{&quot;bound/leaves/leaf-a.xhtml&quot;:[&quot;m1&quot;]}"' in html and row.switches_resolved == 1 and "kept" in html and "gone" not in html


def test_legacy_shell(spark):
    made = assemble.legacy_shell(spark.createDataFrame([("a", "T", "<p>x</p>")], "book_id string, title string, html string"), "q{}").first()
    assert "<title>T</title>" in made.html and "q{}" in made.html and 'lang="en"' in made.html


def test_sheets_from_files(tmp_path):
    (tmp_path / "a.css").write_text("p{}")
    assert read_css(str(tmp_path / "a.css")) == "p{}"
    with pytest.raises(PolicyError):
        read_css(str(tmp_path / "b.css"))


def test_contents_match_by_the_end_of_a_path(spark):
    links = spark.createDataFrame([("a", 1, "x.xhtml#f"), ("a", 2, "t/x.xhtml"), ("a", 3, "z.xhtml"), ("b", 1, "x.xhtml"), ("a", 4, "#k")], "book_id string, at int, href string")
    sections = spark.createDataFrame([("a", 2, "two", "t/x.xhtml"), ("a", 1, "one", "s/x.xhtml"), ("b", 1, "b1", "y.xhtml")], "book_id string, doc_ord int, anchor string, path string")
    made = {(r.book_id, r.at): r.target for r in assemble.match_sections(links, sections).collect()}
    assert made == {("a", 1): "#one", ("a", 2): "#two", ("a", 3): "z.xhtml", ("b", 1): "x.xhtml", ("a", 4): "#k"}


# sources and sinks


def test_read_and_publish(spark, tmp_path):
    (tmp_path / "in" / "sub").mkdir(parents=True)
    (tmp_path / "in" / "one.epub").write_bytes(small().pack())
    (tmp_path / "in" / "sub" / "TWO.EPUB").write_bytes(small().pack())
    (tmp_path / "in" / "note.txt").write_text("x")
    found = archives.read_books(spark, [str(tmp_path / "in"), str(tmp_path / "in" / "one.epub")])
    assert sorted(os.path.basename(r.path) for r in found.select("path").collect()) == ["TWO.EPUB", "one.epub"]
    with pytest.raises(archives.MissingInput):
        archives.read_books(spark, [str(tmp_path / "nowhere")])
    done, out = convert(found), tmp_path / "out"
    publish(done, str(out))
    assert sorted(p.name for p in out.iterdir()) == ["TWO.html", "one.html"] and "harbour is empty" in (out / "one.html").read_text()
    assert [p.name for p in tmp_path.iterdir() if p.name.startswith(".")] == []
    (out / "one.html").write_text("old")
    with pytest.raises(Exception, match="exists"):
        publish(done, str(out))
    assert (out / "one.html").read_text() == "old"
    publish(done, str(out), Options(force=True))
    assert "harbour" in (out / "one.html").read_text()


def test_rollback(tmp_path):
    (tmp_path / "a").write_text("new")
    (tmp_path / "final").write_text("old")
    with pytest.raises(OSError):
        move_files([(str(tmp_path / "a"), str(tmp_path / "final")), (str(tmp_path / "none"), str(tmp_path / "f2"))], str(tmp_path / "backup"))
    assert (tmp_path / "final").read_text() == "old" and not (tmp_path / "f2").exists()


def test_links_are_refused(tmp_path):
    (tmp_path / "real").mkdir()
    (tmp_path / "link").symlink_to(tmp_path / "real")
    reject_links(str(tmp_path / "real" / "x"))
    with pytest.raises(PublishError):
        reject_links(str(tmp_path / "link" / "x"))


def test_arrivals(spark, tmp_path):
    from foliospark.streaming import convert_arrivals

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "one.epub").write_bytes(small().pack())
    for _ in range(2):
        convert_arrivals(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination(240)
    assert [str(p.relative_to(tmp_path / "out")) for p in (tmp_path / "out").rglob("*.html")] == ["batch-0/one.html"]
