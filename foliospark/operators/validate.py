"""Output checks: equal ids, links to nowhere, missing files, sizes and warnings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .assemble import MAIN, TOP
from .tree import attribute


def duplicate_ids(nodes: DataFrame) -> DataFrame:
    """(book_id, id, n) of ids that a book has more than once."""
    ids = nodes.filter("kind = 'element'").select("book_id", attribute("id").alias("id")).filter("id is not null")
    return ids.groupBy("book_id", "id").agg(F.count("*").alias("n")).filter("n > 1")


def dangling_fragments(nodes: DataFrame) -> DataFrame:
    """(book_id, fragment) of links within a book to an id that it does not have."""
    own = nodes.filter("kind = 'element'")
    links = own.select("book_id", attribute("href").alias("href")).filter("startswith(href, '#') and length(href) > 1").select("book_id", F.expr("substring(href, 2)").alias("fragment")).distinct()
    ids = own.select("book_id", attribute("id").alias("fragment")).filter("fragment is not null").distinct()
    return links.join(ids, ["book_id", "fragment"], "left_anti")


def missing_sources(nodes: DataFrame, files: DataFrame) -> DataFrame:
    """(book_id, src) of relative sources that are none of the emitted files (book_id, url)."""
    own = nodes.filter("kind = 'element'").select("book_id", attribute("src").alias("src")).filter("src <> ''").distinct()
    away = F.lit(False)
    for start in ("data:", "http:", "https:", "//"):
        away = away | F.startswith("src", F.lit(start))
    return own.filter(~away).join(files.select("book_id", F.col("url").alias("src")).distinct(), ["book_id", "src"], "left_anti")


def output_faults(nodes: DataFrame, files: DataFrame, extra_ids: tuple[str, ...] = (TOP, MAIN)) -> DataFrame:
    """(book_id, error, message): a book's first failing check, with what failed in order."""
    shell_ids = dangling_fragments(nodes).filter(~F.col("fragment").isin(*extra_ids))
    parts = [
        (1, "duplicate HTML ID(s): ", duplicate_ids(nodes).select("book_id", F.col("id").alias("what"))),
        (2, "unresolved local link(s): ", shell_ids.select("book_id", F.col("fragment").alias("what"))),
        (3, "unresolved local resource(s): ", missing_sources(nodes, files).select("book_id", F.col("src").alias("what"))),
    ]
    out = None
    for order, says, found in parts:
        one = found.groupBy("book_id").agg(F.array_join(F.array_sort(F.collect_set("what")), ", ").alias("what")).select("book_id", F.struct(F.lit(order).alias("o"), F.concat(F.lit(says), "what").alias("message")).alias("f"))
        out = one if out is None else out.unionByName(one)
    return out.groupBy("book_id").agg(F.min("f").alias("f")).select("book_id", F.lit("validation").alias("error"), "f.message")


def oversized(books: DataFrame, limit: int) -> DataFrame:
    """(book_id, error, message) for books (book_id, output_bytes) above the limit."""
    return books.filter(F.col("output_bytes") > limit).select("book_id", F.lit("limit").alias("error"), F.lit("output too large").alias("message"))


def warned(warnings: DataFrame) -> DataFrame:
    """(book_id, error, message) for books with any warning."""
    return warnings.select("book_id").distinct().select("book_id", F.lit("warning").alias("error"), F.lit("warnings are not allowed").alias("message"))
