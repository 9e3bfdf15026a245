"""Reports: a row for each book, a summary of a batch, JSON and HTML."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import escape_html, number_with_commas
from ..policy import Options

VERSION = "1.0.0"


def as_json(*columns: Column | str) -> Column:
    """A JSON object that keeps nulls."""
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})


def batch_summary(results: DataFrame) -> DataFrame:
    """(succeeded, failed, items) over results (input_ord, book_id, output_path, error, error_type)."""
    item = F.struct("input_ord", "book_id", "output_path", "error", "error_type")
    return results.agg(F.count_if(F.col("error").isNull()).alias("succeeded"), F.count_if(F.col("error").isNotNull()).alias("failed"), F.array_sort(F.collect_list(item)).alias("items"))


def batch_json(results: DataFrame) -> DataFrame:
    return batch_summary(results).select(as_json("succeeded", "failed", "items").alias("json"))


def json_report(results: DataFrame, options: Options) -> DataFrame:
    """(book_id, json) with the facts of results and the policy."""
    policy = F.struct(F.lit(options.image_strategy).alias("image_strategy"), F.lit(options.safe_html).alias("safe_mode"), F.lit(options.chunked).alias("chunked"), F.lit(options.navigation).alias("navigation"), F.lit(options.validate_output).alias("validate_output"), F.lit(options.newline).alias("newline"))
    facts = ["input_path", "output_path", "images_path", "documents_processed", "images_processed", "skipped_images", "skipped_documents", "decode_fallbacks", "duration_seconds", "input_bytes", "output_bytes", "warnings"]
    known = [F.col(c) if c in results.columns else F.lit(None).cast("string").alias(c) for c in facts]
    return results.select("book_id", as_json(F.when(F.col("error").isNull(), "success").otherwise("failed").alias("status"), F.lit(VERSION).alias("tool_version"), *known, policy.alias("policy")).alias("json"))


def html_report(results: DataFrame) -> DataFrame:
    """(book_id, html): escaped facts, chapters and warnings; None where a list is empty."""
    items = lambda values: F.coalesce(F.nullif(F.array_join(F.transform(values, lambda v: F.concat(F.lit("<li>"), v, F.lit("</li>"))), ""), F.lit("")), F.lit("<li>None</li>"))
    place = lambda w: F.when(w["location"].isNotNull(), F.concat(F.lit(" ("), escape_html(w["location"]), F.lit(")"))).otherwise(F.lit(""))
    warnings = F.transform("warnings", lambda w: F.concat(F.lit("<strong>"), escape_html(w["code"]), F.lit("</strong>: "), escape_html(w["message"]), place(w)))
    chapters = F.transform("chapters", lambda c: escape_html(c))
    counts = F.concat(F.lit("<p>"), F.col("documents_processed"), F.lit(" chapters; "), F.col("images_processed"), F.lit(" images; "), number_with_commas(F.col("output_bytes")), F.lit(" bytes.</p>"))
    html = F.concat(F.lit('<!DOCTYPE html><html lang="en"><meta charset="utf-8"><title>Conversion report</title><h1>Conversion report</h1><p><strong>Output:</strong> <code>'), escape_html(F.col("output_path")), F.lit("</code></p>"), counts, F.lit("<h2>Chapters</h2><ol>"), items(chapters), F.lit("</ol><h2>Warnings and policy findings</h2><ul>"), items(warnings), F.lit("</ul></html>"))
    return results.select("book_id", html.alias("html"))


def inspection_json(inspected: DataFrame) -> DataFrame:
    return inspected.select("book_id", as_json(*[c for c in inspected.columns if c != "book_id"]).alias("json"))


def collect_warnings(*parts: DataFrame) -> DataFrame:
    """(book_id, warnings): all stages' warnings (book_id, phase, doc_ord, node_id, code, message, location) in order."""
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    listed = F.array_sort(F.collect_list(F.struct("phase", "doc_ord", "node_id", "code", "message", "location")))
    return whole.groupBy("book_id").agg(F.transform(listed, lambda w: F.struct(w["code"].alias("code"), w["message"].alias("message"), w["location"].alias("location"))).alias("warnings"))


def first_warnings(warnings: DataFrame, most: int = 10) -> DataFrame:
    """(book_id, shown, more): the first warnings of a book and how many are left."""
    return warnings.select("book_id", F.slice("warnings", 1, most).alias("shown"), F.greatest(F.size("warnings") - most, F.lit(0)).alias("more"))


def overlay_json(overlays: DataFrame) -> DataFrame:
    """(book_id, json): overlay files by document, in order, from (book_id, document, at, audio)."""
    by_document = overlays.groupBy("book_id", "document").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "audio"))), lambda x: x["audio"]).alias("files"))
    return by_document.groupBy("book_id").agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("document", "files"))))).alias("json"))
