"""Transforming documents: anchors and ids, links, switches, content filters, the sanitizer, sections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import escape_html, percent_decode, resolve_path, safe_url, split_url, stable_anchor, strip_space, url_head
from ..policy import Options
from .tree import KEYS, attribute, drop_subtrees, inner_of, serialize, tokens, with_top_marked

#: The markers of each selector, and the elements that can bear them.
MARKERS = {"toc": ("toc",), "cover": ("cover",), "navigation": ("toc", "landmarks", "nav"), "front-matter": ("frontmatter", "front-matter", "titlepage"), "endnotes": ("endnotes", "endnote", "footnotes"), "appendices": ("appendix", "appendices")}
MARKED_ELEMENTS = ("nav", "div", "section", "article")
#: Active elements, and attributes that hold references.
ACTIVE = ("base", "button", "canvas", "embed", "form", "iframe", "input", "link", "meta", "object", "style", "svg", "template", "video", "audio")
REFERENCES = ("href", "src", "poster", "xlink:href", "srcset")
#: Namespaces a switch's case may ask for, the best first.
CASES = ("http://www.w3.org/1999/xhtml", "http://www.idpf.org/2007/ops", "http://www.w3.org/2000/svg", "http://www.w3.org/1998/Math/MathML")


# anchors and ids


def allocate_targets(documents: DataFrame) -> DataFrame:
    """(book_id, doc_ord, path, anchor): an anchor of the path, later ones of equal anchors numbered from 2."""
    base = F.concat(F.lit("epub-"), stable_anchor(F.col("path")))
    n = F.row_number().over(Window.partitionBy("book_id", "base").orderBy("doc_ord"))
    numbered = documents.select("book_id", "doc_ord", "path", base.alias("base")).withColumn("n", n)
    return numbered.select("book_id", "doc_ord", "path", F.when(F.col("n") > 1, F.concat("base", F.lit("-"), "n")).otherwise(F.col("base")).alias("anchor"))


def last_target_by_path(targets: DataFrame) -> DataFrame:
    """(book_id, path, anchor, doc_ord): the last document of a path is the one that links mean."""
    return targets.groupBy("book_id", "path").agg(F.max_by(F.struct("anchor", "doc_ord"), "doc_ord").alias("t")).select("book_id", "path", "t.*")


def allocate_ids(nodes: DataFrame, targets: DataFrame) -> DataFrame:
    """(keys, node_id, original_id, new_id, rank): namespaced ids; ones that fall together in a document are numbered from 2."""
    own = nodes.filter("kind = 'element'").select(*KEYS, "node_id", attribute("id").alias("original_id")).filter("original_id is not null and original_id <> ''")
    named = own.join(targets.select(*KEYS, "anchor"), KEYS).withColumn("candidate", F.concat("anchor", F.lit("--"), stable_anchor(F.col("original_id"))))
    rank = F.row_number().over(Window.partitionBy(*KEYS, "candidate").orderBy("node_id"))
    new = F.when(F.col("rank") > 1, F.concat("candidate", F.lit("-"), "rank")).otherwise(F.col("candidate"))
    return named.withColumn("rank", rank).select(*KEYS, "node_id", "original_id", new.alias("new_id"), "rank")


def id_map(ids: DataFrame) -> DataFrame:
    """(keys, original_id, new_id): links to an id mean its first element."""
    return ids.groupBy(*KEYS, "original_id").agg(F.min_by("new_id", "node_id").alias("new_id"))


# rewriting attributes


def apply_changes(nodes: DataFrame, changes: DataFrame) -> DataFrame:
    """Nodes with the attributes of changes (keys, node_id, name, value); a null value takes the attribute away."""
    by_node = changes.groupBy(*KEYS, "node_id").agg(F.map_from_entries(F.collect_list(F.struct("name", "value"))).alias("__new"))
    joined = nodes.join(by_node, [*KEYS, "node_id"], "left")
    named = lambda a: F.array_contains(F.map_keys("__new"), a["name"])
    value = lambda a: F.when(named(a), F.element_at("__new", a["name"])).otherwise(a["value"])
    changed = F.filter(F.transform("attrs", lambda a: F.struct(a["name"].alias("name"), value(a).alias("value"))), lambda a: a["value"].isNotNull())
    return joined.withColumn("attrs", F.when(F.col("__new").isNotNull(), changed).otherwise(F.col("attrs"))).drop("__new")


def attributes_of(nodes: DataFrame, tags: tuple[str, ...], names: tuple[str, ...]) -> DataFrame:
    own = nodes.filter(F.col("tag").isin(*tags)) if tags else nodes.filter("kind = 'element'")
    return own.select(*KEYS, "node_id", "tag", F.explode("attrs").alias("a")).select(*KEYS, "node_id", "tag", "a.name", "a.value").filter(F.col("name").isin(*names))


def id_changes(ids: DataFrame) -> DataFrame:
    return ids.select(*KEYS, "node_id", F.lit("id").alias("name"), F.col("new_id").alias("value"))


def resolve_links(links: DataFrame, by_path: DataFrame, ids: DataFrame) -> DataFrame:
    """links (book_id, doc_ord, path, node_id, href) with target: #id or #anchor of the document meant, or the link itself.

    Only links without scheme, host and query to a relative path or a fragment are resolved."""
    cut = links.withColumn("__u", split_url("href"))
    local = F.coalesce((F.col("__u.scheme") == "") & (F.col("__u.netloc") == "") & (F.col("__u.query") == "") & ~F.startswith("__u.path", F.lit("/")), F.lit(False))
    wanted = F.when(local, F.when(F.col("__u.path") == "", F.col("path")).otherwise(resolve_path("path", "__u.path")))
    own = cut.withColumns({"__to": wanted, "__id": percent_decode("__u.fragment")})
    found = own.join(by_path.select("book_id", F.col("path").alias("__to"), "anchor", F.col("doc_ord").alias("__ord")), ["book_id", "__to"], "left")
    keyed = ids.select("book_id", F.col("doc_ord").alias("__ord"), F.col("original_id").alias("__id"), "new_id")
    found = found.join(keyed, ["book_id", "__ord", "__id"], "left")
    return found.select(*links.columns, F.coalesce(F.concat(F.lit("#"), F.coalesce("new_id", "anchor")), "href").alias("target"))


def link_changes(nodes: DataFrame, targets: DataFrame, ids: DataFrame) -> DataFrame:
    links = attributes_of(nodes, ("a",), ("href",)).join(targets.select(*KEYS, "path"), KEYS).select(*KEYS, "path", "node_id", F.col("value").alias("href"))
    return resolve_links(links, last_target_by_path(targets), id_map(ids)).filter("target <> href").select(*KEYS, "node_id", F.lit("href").alias("name"), F.col("target").alias("value"))


# choosing and dropping content


def is_switch(tag: Column) -> Column:
    return tag.isin("switch", "epub:switch")


def resolve_switches(nodes: DataFrame) -> DataFrame:
    """Keeps the best case of each switch, or its default, and drops the other branches; the switch itself and the branch element go, their content stays."""
    cases = nodes.filter(F.col("tag").isin("case", "epub:case", "default", "epub:default"))
    switches = nodes.filter(is_switch(F.col("tag"))).select(*KEYS, F.col("node_id").alias("parent_id"))
    space = attribute("required-namespace")
    order = F.when(F.col("tag").endswith("default"), len(CASES)).otherwise(F.array_position(F.array(*map(F.lit, CASES)), F.coalesce(space, F.lit(CASES[0]))) - 1)
    own = cases.join(switches, [*KEYS, "parent_id"], "left_semi").withColumn("__order", order)
    best = own.filter("__order >= 0").groupBy(*KEYS, "parent_id").agg(F.min(F.struct("__order", "node_id"))["node_id"].alias("node_id"))
    chosen = best.select(*KEYS, "node_id", F.lit(True).alias("__chosen"))
    branches = own.select(*KEYS, "node_id", F.lit(True).alias("__branch"))
    marked = nodes.join(branches, [*KEYS, "node_id"], "left").join(chosen, [*KEYS, "node_id"], "left")
    left = drop_subtrees(marked, F.coalesce(F.col("__branch") & F.col("__chosen").isNull(), F.lit(False)))
    return left.filter(~F.coalesce(is_switch(F.col("tag")), F.lit(False)) & F.col("__branch").isNull()).drop("__branch", "__chosen")


def switch_counts(nodes: DataFrame) -> DataFrame:
    """(keys, switches): how many switches a document has, before they are resolved."""
    return nodes.groupBy(*KEYS).agg(F.count_if(is_switch(F.col("tag"))).alias("switches"))


def markers() -> Column:
    """The lower-cased classes and the tokens of three type attributes."""
    parts = [F.transform(tokens(attribute("class")), F.lower), *[tokens(attribute(n)) for n in ("epub:type", "role", "data-epub-type")]]
    out = parts[0]
    for p in parts[1:]:
        out = F.array_union(out, p)
    return out


def excluded_section(options: Options) -> Column:
    wanted = {m for s in options.exclude_content for m in MARKERS[s]} | ({"toc"} if options.remove_toc else set()) | ({"cover"} if options.remove_cover else set())
    if not wanted:
        return F.lit(False)
    return F.col("tag").isin(*MARKED_ELEMENTS) & F.arrays_overlap(markers(), F.array(*map(F.lit, sorted(wanted))))


def filter_content(nodes: DataFrame, options: Options) -> DataFrame:
    """Drops the sections, drawings, formulas and media that the policy leaves out; one pass for all of them."""
    tags = []
    if options.svg_policy == "omit" or options.safe_html:
        tags.append("svg")
    if options.mathml_policy == "omit":
        tags.append("math")
    if options.media_policy == "omit" or options.safe_html:
        tags += ["audio", "video"]
    gone = excluded_section(options) | (F.col("tag").isin(*tags) if tags else F.lit(False))
    return drop_subtrees(nodes, F.coalesce(gone, F.lit(False)))


def unsafe_reference(tag: Column, a: Column) -> Column:
    """Whether an attribute holds a reference that is not inert; every URL of a srcset must be."""
    urls = F.when(a["name"] == "srcset", F.transform(F.split(a["value"], ","), lambda x: F.get(F.split(strip_space(x), r"\s+"), F.lit(0)))).otherwise(F.array(strip_space(a["value"])))
    return a["name"].isin(*REFERENCES) & F.exists(F.transform(urls, url_head), lambda u: ~safe_url(tag, a["name"], u))


def sanitize(nodes: DataFrame, preserve_scripts: bool = False) -> tuple[DataFrame, DataFrame]:
    """(nodes without active content, (keys, removed) counts of outermost elements and of attributes taken away).

    One window over a document; nothing is joined, so that the nodes are made and dealt once."""
    tags = [*ACTIVE, "math", *([] if preserve_scripts else ["script"])]
    active = F.coalesce(F.col("tag").isin(*tags), F.lit(False))
    marked = with_top_marked(nodes, active, "__top", inside="__inside")
    bad = lambda a: F.lower(a["name"]).startswith("on") | (F.lower(a["name"]) == "style") | F.coalesce(unsafe_reference(F.col("tag"), a), F.lit(False))
    left = ~(active | F.col("__inside"))
    checked = marked.withColumn("__kept", F.when(left, F.filter("attrs", lambda a: ~bad(a))))
    taken = F.sum(F.when(F.col("__kept").isNotNull(), F.size("attrs") - F.size("__kept")).otherwise(0))
    removed = checked.groupBy(*KEYS).agg((F.count_if("__top") + taken).alias("removed"))
    return checked.filter(left).withColumn("attrs", F.col("__kept")).drop("__kept", "__top", "__inside"), removed


# sections


def sections(nodes: DataFrame, targets: DataFrame, options: Options) -> DataFrame:
    """(keys, path, anchor, title, html): each document's body as a section, with a link back to the top in navigated output."""
    body = targets.join(serialize(inner_of(nodes), title="title"), KEYS, "left")
    back = '<a class="back-to-top" href="#top">Back to top</a>' if options.navigation else ""
    html = F.concat(F.lit('<section id="'), escape_html(F.col("anchor")), F.lit('" data-epub-source="'), escape_html(F.col("path")), F.lit('">'), F.coalesce("inner", F.lit("")), F.lit(back), F.lit("</section>"))
    return body.select(*KEYS, "path", "anchor", "title", html.alias("html"))
