"""Packages: item kinds, reading order, ranges, limits, metadata, inspection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import escape_html, yes
from ..policy import ArchiveLimits, Options

#: Metadata names and the tags they become, in order.
META_TAGS = (("creator", "author"), ("publisher", "publisher"), ("date", "dcterms.date"), ("identifier", "dcterms.identifier"), ("rights", "dcterms.rights"), ("description", "description"), ("subject", "keywords"), ("language", "dcterms.language"))
#: Features that a conversion does not carry over, by media type.
UNSUPPORTED = (("image/svg+xml", "SVG"), ("application/font", "fonts"), ("font/", "fonts"), ("audio/", "audio"), ("video/", "video/"))


def kind_of(media_type: Column) -> Column:
    """document, image, stylesheet, resource or other; an SVG is an image of its own kind."""
    kind = F.lower(media_type)
    return (
        F.when(yes(kind.isin("application/xhtml+xml", "text/html")), "document")
        .when(yes(kind == "image/svg+xml"), "svg")
        .when(yes(F.startswith(kind, F.lit("image/"))), "image")
        .when(yes(kind == "text/css"), "stylesheet")
        .when(yes(F.startswith(media_type, F.lit("audio/")) | F.startswith(media_type, F.lit("video/")) | F.startswith(media_type, F.lit("font/")) | F.startswith(media_type, F.lit("application/font"))), "resource")
        .otherwise("other")
    )


def classify_items(items: DataFrame) -> DataFrame:
    return items.withColumn("kind", kind_of(F.col("media_type")))


def reading_order(items: DataFrame, spine: DataFrame) -> DataFrame:
    """(book_id, doc_ord, item_id, name): the spine's documents, or all documents in manifest order where the spine has none."""
    documents = items.filter("kind = 'document'")
    in_spine = spine.select("book_id", "spine_ord", F.col("idref").alias("item_id")).join(documents, ["book_id", "item_id"]).select("book_id", F.lit(0).alias("way"), F.col("spine_ord").alias("at"), "item_id", "name")
    both = in_spine.unionByName(documents.select("book_id", F.lit(1).alias("way"), F.col("item_ord").alias("at"), "item_id", "name"))
    best = both.withColumn("best", F.min("way").over(Window.partitionBy("book_id"))).filter("way = best")
    return best.select("book_id", F.row_number().over(Window.partitionBy("book_id").orderBy("at")).alias("doc_ord"), "item_id", "name")


def spine_slice(documents: DataFrame, options: Options) -> DataFrame:
    """Documents from the first to the last place of the range, both included, either open."""
    start, end = options.spine_range or (None, None)
    return documents.filter(F.col("doc_ord").between(start or 1, end or 2_147_483_647))


def count_faults(documents: DataFrame, items: DataFrame, limits: ArchiveLimits = ArchiveLimits()) -> DataFrame:
    """(book_id, error, message) of books with too many documents or images."""
    n = documents.groupBy("book_id").agg(F.count("*").alias("documents")).join(items.groupBy("book_id").agg(F.count_if(F.col("kind").isin("image", "svg")).alias("images")), "book_id", "full")
    return n.filter((F.col("documents") > limits.max_documents) | (F.col("images") > limits.max_images)).select("book_id", F.lit("limit").alias("error"), F.when(F.col("documents") > limits.max_documents, "too many documents").otherwise("too many images").alias("message"))


def first_metadata(metadata: DataFrame, name: str, column: str, default: str | None = None) -> DataFrame:
    """(book_id, column): the first value of a name."""
    one = metadata.filter(F.col("name") == name).groupBy("book_id").agg(F.min_by("value", "value_ord").alias(column))
    return one if default is None else one.withColumn(column, F.coalesce(column, F.lit(default)))


def metadata_tags(metadata: DataFrame) -> DataFrame:
    """(book_id, tags): a meta tag for each value, by name in a fixed order."""
    order = F.array_position(F.array(*[F.lit(n) for n, _ in META_TAGS]), F.col("name"))
    known = F.create_map(*[F.lit(x) for pair in META_TAGS for x in pair])
    tag = F.concat(F.lit('<meta name="'), F.element_at(known, F.col("name")), F.lit('" content="'), escape_html(F.col("value")), F.lit('">'))
    listed = metadata.filter(F.col("name").isin(*[n for n, _ in META_TAGS])).select("book_id", F.struct(order.alias("o"), F.col("value_ord").alias("v"), tag.alias("tag")).alias("t"))
    return listed.groupBy("book_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("t")), lambda t: t["tag"]), "\n").alias("tags"))


def media_types(items: DataFrame) -> DataFrame:
    """(book_id, media_type, n), unknown where there is none."""
    return items.groupBy("book_id", F.coalesce(F.nullif("media_type", F.lit("")), F.lit("unknown")).alias("media_type")).agg(F.count("*").alias("n"))


def inspect(items: DataFrame, spine_documents: DataFrame, entries: DataFrame, metadata: DataFrame) -> DataFrame:
    """A row for each book: title, language, spine, media_types, asset_bytes, fixed_layout, unsupported. Sizes come from headers; no content is read."""
    name = F.lower("name")
    probes = [F.bool_or(yes(F.startswith("media_type", F.lit(p)))) for p, _ in UNSUPPORTED]
    found = F.array_distinct(F.array_compact(F.array(*[F.when(p, F.lit(label)) for p, (_, label) in zip(probes, UNSUPPORTED)], F.when(F.bool_or(F.contains(name, F.lit("mathml"))), F.lit("MathML")))))
    facts = items.groupBy("book_id").agg(found.alias("unsupported"), F.bool_or(F.contains(name, F.lit("rendition:layout")) | F.contains(name, F.lit("fixed"))).alias("fixed_layout"))
    types = media_types(items).groupBy("book_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("media_type", "n")))).alias("media_types"))
    spine = spine_documents.groupBy("book_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("doc_ord", "name"))), lambda x: x["name"]).alias("spine"))
    size = entries.groupBy("book_id").agg(F.sum("file_size").alias("asset_bytes"))
    out = facts
    for part in (types, spine, size, first_metadata(metadata, "title", "title"), first_metadata(metadata, "language", "language", "en")):
        out = out.join(part, "book_id", "left")
    return out.select("book_id", "title", F.coalesce("language", F.lit("en")).alias("language"), F.coalesce("spine", F.array().cast("array<string>")).alias("spine"), "media_types", F.coalesce("asset_bytes", F.lit(0)).alias("asset_bytes"), "fixed_layout", "unsupported")
