"""Assembly: stylesheets, navigation, the document shell and the ordered merge."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import escape_html, language_or_default
from ..policy import Options
from .tree import KEYS, attribute, texts_of, tokens

#: The colours of each theme.
THEMES = {
    "auto": ":root { color-scheme: light dark; --page-bg: Canvas; --page-fg: CanvasText; }",
    "light": ":root { color-scheme: light; --page-bg: #fff; --page-fg: #171717; }",
    "dark": ":root { color-scheme: dark; --page-bg: #171717; --page-fg: #f5f5f5; }",
}
#: Navigations by marker, with label, heading and list element.
NAVIGATIONS = {"toc": ("Table of contents", "Contents", "ol"), "landmarks": ("Landmarks", "Landmarks", "ul"), "page-list": ("Page list", "Page List", "ol")}


def ordered_text(df: DataFrame, value: str, order: list[str], separator: str, name: str, by: list[str] = ["book_id"]) -> DataFrame:  # noqa: B006
    """(by, name): values of a group in order, joined."""
    parts = F.array_sort(F.collect_list(F.struct(*order, F.col(value).alias("__v"))))
    return df.groupBy(*by).agg(F.array_join(F.transform(parts, lambda x: x["__v"]), separator).alias(name))


def merge_sections(sections: DataFrame, chunked: bool = False) -> DataFrame:
    """(book_id, html): a book's sections in order; chunked output ends each with a newline, other output parts them by one."""
    merged = ordered_text(sections, "html", ["doc_ord"], "\n", "html")
    return merged.withColumn("html", F.concat("html", F.lit("\n"))) if chunked else merged


def theme_css(options: Options) -> str:
    own = THEMES[options.reader_theme]
    if options.css_vars:
        own += " :root { " + "; ".join(f"--{k}: {v}" for k, v in options.css_vars) + "; }"
    return own


def default_css(options: Options) -> str:
    """A sheet for documents that bring none: one column, links back out of the way, nothing but the text in print."""
    return f"""
@layer page {{
  html {{ font: 100%/1.55 {options.reader_font_family}; color: var(--page-fg); background-color: var(--page-bg); }}
  main, .document-navigation {{ width: min({options.reader_max_width}, 92vw); margin-inline: auto; }}
  main :is(img, svg, video) {{ height: auto; max-inline-size: 100%; }}
  main section + section {{ margin-block-start: 4rem; }}
  .document-navigation {{ margin-block: 1rem 3rem; font-size: smaller; }}
  .skip-link:not(:focus) {{ clip-path: inset(100%); position: fixed; }}
  .back-to-top {{ float: inline-end; font-size: small; }}
}}
@media print {{ .document-navigation, .skip-link, .back-to-top {{ visibility: hidden; position: absolute; }} }}
""".strip()


def styles(options: Options, internal: Column) -> Column:
    """The theme, then the policy's and the book's sheets; the default sheet where there is neither."""
    own = F.array_join(F.array_compact(F.array(F.lit(options.css or None), F.nullif(internal, F.lit("")))), "\n")
    return F.concat(F.lit(theme_css(options) + "\n"), F.coalesce(F.nullif(own, F.lit("")), F.lit(default_css(options))))


#: Ids and words of the shell, and the title of a document without one.
TOP, MAIN, SKIP, UNTITLED = "top", "main-content", "Skip to content", "EPUB Document"


def navigation_links(nodes: DataFrame, marker: str) -> DataFrame:
    """(book_id, at, href, label): the links of a book's first nav of this marker, one by type before one by role."""
    kinds = [F.array_contains(F.transform(tokens(attribute(n)), F.lower), marker) for n in ("epub:type", "role")]
    navs = nodes.filter(F.col("tag") == "nav").withColumn("way", F.when(kinds[0], 0).when(kinds[1], 1)).filter("way is not null")
    first = navs.groupBy("book_id").agg(F.min(F.struct("way", "doc_ord", "node_id", "subtree_end")).alias("n")).select("book_id", "n.doc_ord", F.col("n.node_id").alias("first"), F.col("n.subtree_end").alias("last"))
    links = nodes.filter(F.col("tag") == "a").withColumn("href", attribute("href")).filter("href is not null")
    inside = links.join(first, KEYS).filter("node_id between first and last")
    labelled = inside.join(texts_of(nodes, inside), [*KEYS, "node_id"], "left")
    return labelled.select("book_id", F.col("node_id").alias("at"), "href", F.coalesce("content", F.lit("")).alias("label"))


def match_sections(links: DataFrame, sections: DataFrame) -> DataFrame:
    """links with target: the anchor of the first section whose source ends with what stands before #, or the href itself.

    Links meet the endings of their own book's paths, by equality."""
    own = links.withColumn("__p", F.regexp_extract("href", "^([^#]*)", 1))
    wanted = own.filter("__p <> ''").select("book_id", F.col("__p").alias("ending")).distinct()
    # a path's endings that some link of the book can have: those of the lengths that the book's links have
    lengths = wanted.groupBy("book_id").agg(F.collect_set(F.length("ending")).alias("lengths"))
    endings = sections.select("book_id", "doc_ord", "anchor", "path").join(lengths, "book_id")
    endings = endings.withColumn("n", F.explode("lengths")).filter("n <= length(path)")
    endings = endings.select("book_id", "doc_ord", "anchor", F.expr("substring(path, length(path) - n + 1)").alias("__p"))
    best = endings.groupBy("book_id", "__p").agg(F.min_by("anchor", "doc_ord").alias("__a"))
    return own.join(best, ["book_id", "__p"], "left").select(*links.columns, F.coalesce(F.concat(F.lit("#"), "__a"), "href").alias("target"))


def entries_html(entries: DataFrame, marker: str, href: str = "target") -> DataFrame:
    """(book_id, nav): entries (book_id, at, target, label) as a list."""
    label, heading, kind = NAVIGATIONS[marker]
    item = F.concat(F.lit('<li><a href="'), escape_html(F.col(href)), F.lit('">'), escape_html(F.col("label")), F.lit("</a></li>"))
    listed = ordered_text(entries.withColumn("__i", item), "__i", ["at"], "", "items")
    return listed.select("book_id", F.concat(F.lit(f'<nav class="document-navigation" aria-label="{label}"><h2>{heading}</h2><{kind}>'), "items", F.lit(f"</{kind}></nav>")).alias("nav"))


def contents(nodes: DataFrame, sections: DataFrame, headings: DataFrame) -> DataFrame:
    """(book_id, nav): the table of contents, from the book's own nav or else from headings (keys, title); sections without one are numbered."""
    own = match_sections(navigation_links(nodes, "toc"), sections)
    made = sections.join(headings.select(*KEYS, F.col("title").alias("__h")), KEYS, "left")
    made = made.select("book_id", F.col("doc_ord").alias("at"), F.concat(F.lit("#"), "anchor").alias("target"), F.coalesce("__h", F.concat(F.lit("Chapter "), F.col("doc_ord"))).alias("label"))
    made = made.join(own.select("book_id").distinct(), "book_id", "left_anti")
    return entries_html(own.select("book_id", "at", "target", "label").unionByName(made), "toc")


def shell(books: DataFrame, options: Options) -> DataFrame:
    """books (book_id, title, language, tags, internal_css, navs, html) with html as a whole document; overlays, if there, is the JSON of its media overlays."""
    overlays = F.coalesce(F.concat(F.lit(' data-media-overlays="'), escape_html(F.col("overlays")), F.lit('"')), F.lit("")) if "overlays" in books.columns else F.lit("")
    head = F.concat(
        F.lit('<!DOCTYPE html>\n<html lang="'), language_or_default(F.col("language")), F.lit('"><head><meta charset="UTF-8"><meta name="viewport" content="width=device-width, initial-scale=1.0"><title>'),
        escape_html(F.coalesce(F.nullif("title", F.lit("")), F.lit(UNTITLED))), F.lit("</title>"), F.coalesce("tags", F.lit("")), F.lit("<style>"), styles(options, F.col("internal_css")), F.lit("</style></head>"),
    )
    body = F.concat(F.lit(f'<body id="{TOP}"><a class="skip-link" href="#{MAIN}">{SKIP}</a>'), F.coalesce("navs", F.lit("")), F.lit(f'<main id="{MAIN}" tabindex="-1"'), overlays, F.lit(">"), F.coalesce("html", F.lit("")), F.lit("</main></body></html>\n"))
    return books.withColumn("html", F.concat(head, body))


def legacy_shell(books: DataFrame, css: str | None = None) -> DataFrame:
    """books (book_id, title, html) with html as a whole document in English without navigation or metadata."""
    plain = {"language": F.lit("en"), "tags": F.lit(""), "internal_css": F.lit(""), "navs": F.lit("")}
    return shell(books.withColumns(plain), Options(css=css)).select(*books.columns)


def newlines(html: Column, options: Options) -> Column:
    return F.replace(html, F.lit("\n"), F.lit("\r\n")) if options.newline == "crlf" else html
