"""Document trees as rows.

A document's nodes are numbered in document order, and each row has the number of the
last node of its subtree. So a subtree is an interval, and every tree step is a filter,
a join or an ordered aggregate. Only the lenient parser needs Python.
"""

from __future__ import annotations

from html.parser import HTMLParser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions import escape_html, strip_space

KEYS = ["book_id", "doc_ord"]
ATTRS = T.ArrayType(T.StructType([T.StructField("name", T.StringType()), T.StructField("value", T.StringType())]))
NODE_FIELDS = [("node_id", T.IntegerType()), ("parent_id", T.IntegerType()), ("subtree_end", T.IntegerType()), ("depth", T.IntegerType()), ("kind", T.StringType()), ("tag", T.StringType()), ("attrs", ATTRS), ("text", T.StringType())]
#: Elements without content.
VOID = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr")


class _Builder(HTMLParser):
    """Numbers nodes; an end tag closes up to the nearest open element of its name, and is ignored if there is none."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.rows: list[list] = []
        self.open: list[int] = []

    def _add(self, kind, tag=None, attrs=None, text=None):
        parent = self.open[-1] if self.open else -1
        self.rows.append([len(self.rows), parent, len(self.rows), len(self.open), kind, tag, attrs, text])

    def handle_starttag(self, tag, attrs):
        seen: dict[str, str] = {}
        for name, value in attrs:
            seen.setdefault(name, value or "")
        self._add("element", tag, [{"name": k, "value": v} for k, v in seen.items()])
        if tag not in VOID:
            self.open.append(len(self.rows) - 1)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.open.pop()

    def handle_endtag(self, tag):
        for i in range(len(self.open) - 1, -1, -1):
            if self.rows[self.open[i]][5] == tag:
                self._close(i)
                return

    def _close(self, to):
        for node in self.open[to:]:
            self.rows[node][2] = len(self.rows) - 1
        del self.open[to:]

    def handle_data(self, data):
        self._add("text", text=data)

    def handle_comment(self, data):
        self._add("comment", text=data)

    def handle_decl(self, decl):
        self._add("decl", text=decl)

    def handle_pi(self, data):
        self._add("pi", text=data)

    def unknown_decl(self, data):
        self._add("decl", text=f"[{data}")

    def finish(self):
        self.close()
        self._close(0)
        return self.rows


def parse_rows(markup: str | None) -> list[list]:
    builder = _Builder()
    builder.feed(markup or "")
    return builder.finish()


def parse_nodes(documents: DataFrame, markup: str = "text", keys: list[str] = KEYS) -> DataFrame:
    """A row for each node of each document, with the documents' keys."""
    schema = T.StructType([*[documents.schema[k] for k in keys], *[T.StructField(n, t) for n, t in NODE_FIELDS]])

    def run(batches):
        import pyarrow as pa

        kinds = [pa.int32()] * 4 + [pa.string()] * 2 + [pa.list_(pa.struct([("name", pa.string()), ("value", pa.string())])), pa.string()]
        names = [*keys, *[n for n, _ in NODE_FIELDS]]
        for batch in batches:
            which, rows = [], []

            def flush():
                at = pa.array(which, pa.int64())
                return pa.RecordBatch.from_arrays([*[batch.column(k).take(at) for k in keys], *[pa.array(x, t) for x, t in zip(zip(*rows), kinds)]], names=names)

            for i, value in enumerate(batch.column(markup).to_pylist()):
                own = parse_rows(value)
                which += [i] * len(own)
                rows += own
                if len(rows) > 20_000:
                    yield flush()
                    which, rows = [], []
            if rows:
                yield flush()

    return documents.select(*keys, markup).mapInArrow(run, schema)


def attribute(name: str, attrs: str | Column = "attrs") -> Column:
    """An attribute's value, or null."""
    attrs = F.col(attrs) if isinstance(attrs, str) else attrs
    return F.get(F.filter(attrs, lambda a: a["name"] == name), F.lit(0))["value"]


def tokens(value: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(value, F.lit("")), r"\s+"), "")


def drop_subtrees(nodes: DataFrame, marked: Column, keys: list[str] = KEYS) -> DataFrame:
    """Nodes that are in no marked node's subtree. One window over a document; nothing is joined."""
    before = Window.partitionBy(*keys).orderBy("node_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    end = F.max(F.when(marked, F.col("subtree_end"))).over(before)
    return nodes.withColumn("__gone", F.coalesce(end >= F.col("node_id"), F.lit(False))).filter("not __gone").drop("__gone")


def with_top_marked(nodes: DataFrame, marked: Column, name: str, keys: list[str] = KEYS, inside: str | None = None) -> DataFrame:
    """Adds whether a node is marked and in no other marked node's subtree; under the name inside, whether it is in one."""
    above = Window.partitionBy(*keys).orderBy("node_id").rowsBetween(Window.unboundedPreceding, -1)
    within = F.coalesce(F.max(F.when(marked, F.col("subtree_end"))).over(above) >= F.col("node_id"), F.lit(False))
    held = nodes.withColumn(inside or "__inside", within)
    top = held.withColumn(name, F.coalesce(marked, F.lit(False)) & ~F.col(inside or "__inside"))
    return top if inside else top.drop("__inside")


def texts_of(nodes: DataFrame, elements: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """elements (keys, node_id, subtree_end) with content: their stripped strings in order, joined by spaces."""
    own = elements.select(*keys, F.col("node_id").alias("of"), F.col("subtree_end").alias("last"))
    strings = nodes.filter("kind = 'text'").select(*keys, "node_id", strip_space(F.col("text")).alias("piece")).filter("piece <> ''")
    inside = own.join(strings, keys).filter("node_id between of and last").select(*keys, "of", "node_id", "piece")
    held = own.select(*keys, "of", F.lit(None).cast("int").alias("node_id"), F.lit(None).cast("string").alias("piece")).unionByName(inside)
    pieces = F.array_sort(F.collect_list(F.when(F.col("piece").isNotNull(), F.struct("node_id", "piece"))))
    return held.groupBy(*keys, "of").agg(F.array_join(F.transform(pieces, lambda x: x["piece"]), " ").alias("content")).withColumnRenamed("of", "node_id")


def with_heading(nodes: DataFrame, depth: int = 6, keys: list[str] = KEYS) -> DataFrame:
    """Adds __heading, node_id and subtree_end of the document's first heading of a level up to depth, and __piece, the stripped string of a text in it. One window over a document; nothing is joined."""
    first = F.min(F.when(F.col("tag").isin(*[f"h{n}" for n in range(1, depth + 1)]), F.struct("node_id", "subtree_end"))).over(Window.partitionBy(*keys))
    within = (F.col("kind") == "text") & F.col("node_id").between(F.col("__heading.node_id"), F.col("__heading.subtree_end"))
    return nodes.withColumn("__heading", first).withColumn("__piece", F.when(within, F.nullif(strip_space(F.col("text")), F.lit(""))))


def first_headings(nodes: DataFrame, depth: int = 6, keys: list[str] = KEYS) -> DataFrame:
    """(keys, title): the text of a document's first heading of a level up to depth."""
    own = nodes.filter(F.col("tag").isin(*[f"h{n}" for n in range(1, depth + 1)]) | (F.col("kind") == "text")).select(*keys, "node_id", "subtree_end", "kind", "tag", "text")
    pieces = F.sort_array(F.collect_list(F.when(F.col("__piece").isNotNull(), F.struct("node_id", "__piece"))))
    inside = with_heading(own, depth, keys).filter(F.col("node_id").between(F.col("__heading.node_id"), F.col("__heading.subtree_end")))
    return inside.groupBy(*keys).agg(F.array_join(F.transform(pieces, lambda x: x["__piece"]), " ").alias("title"))


def inner_of(nodes: DataFrame, tag: str = "body", keys: list[str] = KEYS) -> DataFrame:
    """The nodes inside the first element of this name, or all nodes where there is none."""
    whole = Window.partitionBy(*keys)
    first = F.min(F.when(F.col("tag") == tag, F.struct("node_id", "subtree_end"))).over(whole)
    return nodes.withColumn("__in", first).filter("__in is null or (node_id > __in.node_id and node_id <= __in.subtree_end)").drop("__in")


def serialize(nodes: DataFrame, keys: list[str] = KEYS, name: str = "inner", title: str | None = None) -> DataFrame:
    """(keys, inner): the markup of each document's nodes. An element opens at its number and closes after its subtree's last.

    Under the name title also the text of the first heading, as first_headings gives it, but from the same pass over the nodes."""
    attrs = F.array_join(F.transform("attrs", lambda a: F.concat(F.lit(" "), a["name"], F.lit('="'), F.replace(F.replace(a["value"], F.lit("&"), F.lit("&amp;")), F.lit('"'), F.lit("&quot;")), F.lit('"'))), "")
    void = F.col("tag").isin(*VOID)
    opening = F.concat(F.lit("<"), F.col("tag"), attrs, F.when(void, "/>").otherwise(">"))
    # script and style hold raw text
    parent = F.last(F.when(F.col("kind") == "element", F.struct("tag", "subtree_end")), ignorenulls=True).over(Window.partitionBy(*keys).orderBy("node_id").rowsBetween(Window.unboundedPreceding, -1))
    raw = F.coalesce(parent["tag"].isin("script", "style") & (parent["subtree_end"] >= F.col("node_id")), F.lit(False))
    shown = (
        F.when(F.col("kind") == "element", opening)
        .when(F.col("kind") == "text", F.when(F.col("__raw"), F.col("text")).otherwise(escape_html(F.col("text"), quote=False)))
        .when(F.col("kind") == "comment", F.concat(F.lit("<!--"), F.col("text"), F.lit("-->")))
        .when(F.col("kind") == "pi", F.concat(F.lit("<?"), F.col("text"), F.lit(">")))
        .otherwise(F.concat(F.lit("<!"), F.col("text"), F.lit(">")))
    )
    nothing = F.lit(None).cast("string")
    piece, headed = nothing, F.lit(False)
    if title:
        nodes = with_heading(nodes, keys=keys)
        piece, headed = F.col("__piece"), F.col("__heading").isNotNull()
    part = lambda at, k, tie, s, piece=nothing: F.struct(at.alias("at"), F.lit(k).alias("k"), tie.alias("tie"), s.alias("s"), piece.alias("piece"))
    close = F.when((F.col("kind") == "element") & ~void, part(F.col("subtree_end"), 1, -F.col("node_id"), F.concat(F.lit("</"), F.col("tag"), F.lit(">"))))
    events = nodes.withColumn("__raw", raw).select(*keys, headed.alias("headed"), F.explode(F.array_compact(F.array(part(F.col("node_id"), 0, F.col("node_id"), shown, piece), close))).alias("e"))
    whole = events.groupBy(*keys).agg(F.sort_array(F.collect_list("e")).alias("e"), F.first("headed").alias("headed"))
    join = lambda field, by: F.array_join(F.transform("e", lambda e: e[field]), by)
    return whole.select(*keys, join("s", "").alias(name), *([F.when(F.col("headed"), join("piece", " ")).alias(title)] if title else []))
