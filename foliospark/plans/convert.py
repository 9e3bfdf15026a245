"""The conversion plan: every step runs for all books at once, and what fails in a book is a row."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import basename, decode_text, file_stem, text_or_null
from ..operators import assemble, assets, documents, package, preflight, reports, tree, validate
from ..policy import Options, check_directory_name
from ..sources import archives
from ..watch import Observer, Watch, WatchedTables

WARNING = "book_id string, phase int, doc_ord int, node_id int, code string, message string, location string"


@dataclass
class Conversion:
    """results has a row for each book: its facts, or its error; outputs (book_id, path, html) and files (book_id, path, content) are for publishing."""

    results: DataFrame
    outputs: DataFrame
    files: DataFrame
    warnings: DataFrame


def passed(books: DataFrame, options: Options, reader=archives) -> tuple[DataFrame, DataFrame]:
    """(books that pass preflight, faults of the others)."""
    faults = preflight.preflight(reader.zip_status(books, options.limits.max_entry_bytes), reader.zip_entries(books), options.limits).filter("rule is not null")
    faults = faults.select("book_id", "error", "message")
    return books.join(faults, "book_id", "left_anti"), faults


def warning(df: DataFrame, phase: int, code, message, location) -> DataFrame:
    node = F.col("node_id") if "node_id" in df.columns else F.lit(-1)
    order = F.col("doc_ord") if "doc_ord" in df.columns else F.lit(-1)
    return df.select("book_id", F.lit(phase).alias("phase"), order.cast("int").alias("doc_ord"), node.cast("int").alias("node_id"), code.alias("code"), message.alias("message"), location.alias("location"))


def convert(books: DataFrame, options: Options = Options(), reader=archives, observer: Observer | None = None, cancelled: Callable[[], bool] | None = None) -> Conversion:
    """books (book_id, input_ord, path, length, content), as from read_books, to documents of one file each.

    reader gives the tables of archives: zip_status, zip_entries, zip_members and
    package_rows, each of them from books; by default those of sources.archives. The
    observer is told of each table that is written. cancelled is asked between tables;
    options.deadline_seconds ends running jobs too. Both raise Cancelled."""
    options.check()
    with Watch(books.sparkSession, options.deadline_seconds, cancelled, observer) as watch:
        return _convert(books, options, reader, watch)


def _convert(books: DataFrame, options: Options, reader, watch: Watch) -> Conversion:
    tables = WatchedTables(books.sparkSession, watch)
    good, faults = passed(books, options, reader)
    faults = tables.write(faults, "preflight")
    good = books.join(faults, "book_id", "left_anti")
    rows = tables.write(reader.package_rows(good), "packages")
    faults = faults.unionByName(rows.filter("part = 'error'").select("book_id", F.lit("invalid").alias("error"), F.concat_ws(": ", "key", "value").alias("message")))
    items = package.classify_items(archives.items(rows))
    metadata = archives.metadata(rows)
    ordered = package.spine_slice(package.reading_order(items, archives.spine(rows)), options)
    faults = faults.unionByName(package.count_faults(ordered, items, options.limits))

    # members are decompressed once
    members = tables.write(reader.zip_members(good, options.limits.max_entry_bytes), "members")
    held = items.join(members.select("book_id", "name", "content"), ["book_id", "name"])
    images = assets.accept_images(held.filter("kind in ('image', 'svg')"), options)
    if options.image_strategy == "embed":
        # what is too large by its embedded images alone is given up before it is built
        estimate = images.filter("accepted").groupBy("book_id").agg(F.sum(assets.embedded_bytes(F.col("content"))).alias("output_bytes"))
        large = tables.write(validate.oversized(estimate, options.limits.max_output_bytes), "estimates")
        faults = faults.unionByName(large)
        images, ordered = (df.join(large.select("book_id"), "book_id", "left_anti") for df in (images, ordered))

    raw = ordered.join(members.select("book_id", "name", "content"), ["book_id", "name"]).withColumn("valid", text_or_null(F.col("content")))
    texts = raw.withColumn("text", F.coalesce("valid", F.when(F.col("valid").isNull(), decode_text("content"))))
    texts = texts.select("book_id", "doc_ord", F.col("name").alias("path"), "text", F.col("valid").isNull().alias("fallback"))
    texts = tables.write(texts, "texts")
    warnings = [
        warning(texts.filter("fallback and text is not null"), 1, F.lit("decode-fallback"), F.lit("not UTF-8"), F.col("path")),
        warning(texts.filter("text is null"), 1, F.lit("skipped-document"), F.lit("not readable"), F.col("path")),
    ]
    readable = texts.filter("text is not null")
    nodes = tables.write(tree.parse_nodes(readable), "nodes")
    targets = tables.write(documents.allocate_targets(readable), "targets")
    ids = tables.write(documents.allocate_ids(nodes, targets), "ids")

    stem = file_stem(basename(F.col("path")))
    names = books.select("book_id", stem.alias("stem"))
    directory = F.replace(F.lit(options.images_dir_name), F.lit("{stem}"), F.col("stem"))
    accepted = images.filter("accepted")
    files = None
    if options.image_strategy == "embed":
        index = tables.write(assets.embed(accepted), "assets")
    else:
        check_directory_name(options.images_dir_name)
        resources = held.filter("kind = 'resource'").withColumn("action", assets.resource_action(F.col("media_type"), options))
        code = F.when(F.col("action") == "preserve", "preserved-resource-reference").otherwise("omitted-resource")
        warnings.append(warning(resources.filter("action <> 'extract'"), 2, code, F.lit("resource left out"), F.col("name")))
        out = accepted.select("book_id", "item_ord", "name", "content").unionByName(resources.filter("action = 'extract'").select("book_id", "item_ord", "name", "content"))
        placed = assets.extracted(out.join(names, "book_id"), F.lit("__dir__")).join(names, "book_id")
        placed = tables.write(placed.withColumn("url", F.replace("url", F.lit("__dir__"), assets.percent_encode(directory))), "assets")
        index = placed.select("book_id", "asset_ord", "path", "url")
        files = placed.join(out.withColumnRenamed("item_ord", "asset_ord").select("book_id", "asset_ord", "content"), ["book_id", "asset_ord"]).select("book_id", F.concat(directory, F.lit("/"), "file").alias("path"), "url", "content")
    warnings.append(warning(images.filter("not accepted"), 2, F.lit("skipped-image"), F.lit("no type, or not what its type says"), F.col("name")))

    sheets = assets.stylesheets(held)
    if options.preserve_internal_css and not options.safe_html:
        warnings.append(warning(sheets.filter("css is null"), 2, F.lit("skipped-stylesheet"), F.lit("not UTF-8"), F.col("path")))
        css = assemble.ordered_text(assets.rewrite_css(sheets.filter("css is not null"), index), "css", ["item_ord"], "\n", "internal_css")
    else:
        css = sheets.limit(0).select("book_id", F.lit("").alias("internal_css"))

    # the order of the steps matters: warnings for images are given before content is left out
    changed = documents.apply_changes(nodes, documents.id_changes(ids).unionByName(documents.link_changes(nodes, targets, ids)))
    changed = tables.write(changed, "linked")
    switches = None
    if options.resolve_switch:
        switches = documents.switch_counts(nodes).groupBy("book_id").agg(F.sum("switches").alias("switches_resolved"))
        changed = tables.write(documents.resolve_switches(changed), "switched")
    references = assets.image_references(changed, targets)
    resolved = tables.write(assets.resolve_assets(references, index), "resolved")
    changed = documents.apply_changes(changed, assets.image_changes(resolved))
    warnings.append(assets.image_warnings(resolved).select(*[c.split()[0] for c in WARNING.split(", ")]))
    changed = tables.write(documents.filter_content(changed, options), "filtered")
    if options.safe_html:
        changed, removed = documents.sanitize(changed, options.preserve_scripts)
        changed, removed = tables.write(changed, "clean"), tables.write(removed, "removed")
        found = removed.filter("removed > 0").join(targets.select(*tree.KEYS, "path"), tree.KEYS)
        warnings.append(warning(found, 4, F.lit("unsafe-content-removed"), F.concat("removed", F.lit(" unsafe items")), F.col("path")))
    sections = tables.write(documents.sections(changed, targets, options), "sections")
    merged = assemble.merge_sections(sections, options.chunked)

    whole = names.join(faults.select("book_id").distinct(), "book_id", "left_anti").join(merged, "book_id", "left")
    for part in (package.first_metadata(metadata, "title", "title"), package.first_metadata(metadata, "language", "language", "en"), package.metadata_tags(metadata), css):
        whole = whole.join(part, "book_id", "left")
    if options.navigation:
        headings = tree.first_headings(tree.inner_of(changed), options.navigation_depth)
        navs = [assemble.contents(changed, sections, headings).withColumn("o", F.lit(0))]
        navs += [assemble.entries_html(assemble.navigation_links(changed, m), m, "href").withColumn("o", F.lit(i)) for i, (m, on) in enumerate((("landmarks", options.landmarks), ("page-list", options.page_list)), 1) if on]
        union = navs[0]
        for nav in navs[1:]:
            union = union.unionByName(nav)
        whole = whole.join(assemble.ordered_text(union, "nav", ["o"], "", "navs"), "book_id", "left")
    else:
        whole = whole.withColumn("navs", F.lit(""))
    if options.preserve_media_overlays:
        whole = whole.join(reports.overlay_json(archives.overlays(rows)).withColumnRenamed("json", "overlays"), "book_id", "left")
    shown = assemble.shell(whole, options) if options.wrapped else whole.withColumn("html", F.coalesce("html", F.lit("")))
    outputs = shown.select("book_id", F.concat("stem", F.lit(".html")).alias("path"), assemble.newlines(F.col("html"), options).alias("html"))
    outputs = tables.write(outputs, "outputs")

    sizes = outputs.select("book_id", F.octet_length("html").alias("bytes"))
    if files is not None:
        sizes = sizes.unionByName(files.select("book_id", F.octet_length("content").alias("bytes")))
    else:
        files = outputs.limit(0).select("book_id", "path", F.lit("").alias("url"), F.lit(None).cast("binary").alias("content"))
    sizes = sizes.groupBy("book_id").agg(F.sum("bytes").alias("output_bytes"))
    warned = warnings[0]
    for part in warnings[1:]:
        warned = warned.unionByName(part)
    warned = tables.write(warned, "warnings")
    late = [validate.oversized(sizes, options.limits.max_output_bytes)]
    if options.validate_output:
        # what is written is read again part by part, so that no task holds a whole book
        parts = sections.select("book_id", "doc_ord", "html").join(whole.select("book_id"), "book_id", "left_semi")
        if options.wrapped:
            parts = parts.unionByName(whole.select("book_id", F.lit(0).alias("doc_ord"), F.coalesce("navs", F.lit("")).alias("html")))
        checked = tables.write(tree.parse_nodes(parts, "html"), "checked")
        late.append(validate.output_faults(checked, files))
    if options.fail_on_warning:
        late.append(validate.warned(warned))
    for part in late:
        faults = faults.unionByName(part)
    faults = tables.write(faults, "faults")
    fault = faults.groupBy("book_id").agg(F.min_by(F.struct("error", "message"), "error").alias("f")).select("book_id", F.col("f.message").alias("error"), F.col("f.error").alias("error_type"))

    counts = texts.groupBy("book_id").agg(F.count("*").alias("documents_processed"), F.count_if(F.col("text").isNull()).alias("skipped_documents"), F.count_if("fallback").alias("decode_fallbacks"))
    pictures = images.groupBy("book_id").agg(F.count_if("accepted").alias("images_processed"), F.count_if(~F.col("accepted")).alias("skipped_images"))
    chapter = F.coalesce("title", file_stem(F.col("path")))
    chapters = sections.groupBy("book_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("doc_ord", chapter.alias("t")))), lambda x: x["t"]).alias("chapters"))
    results = books.select("book_id", "input_ord", F.col("path").alias("input_path"), F.col("length").alias("input_bytes")).join(outputs.select("book_id", F.col("path").alias("output_path")), "book_id", "left")
    more = [switches] if switches is not None else []
    for part in (counts, pictures, sizes, chapters, reports.collect_warnings(warned), fault, *more):
        results = results.join(part, "book_id", "left")
    if switches is None:
        results = results.withColumn("switches_resolved", F.lit(0))
    for c in ("documents_processed", "skipped_documents", "decode_fallbacks", "images_processed", "skipped_images", "switches_resolved"):
        results = results.withColumn(c, F.coalesce(c, F.lit(0)))
    # of books with one output, the first that has no fault of its own keeps it
    place = F.row_number().over(Window.partitionBy("output_path", F.col("error").isNull()).orderBy("input_ord", "input_path", "book_id"))
    taken = F.col("error").isNull() & F.col("output_path").isNotNull() & (place > 1)
    results = results.withColumn("taken", taken).withColumns({"error": F.when(F.col("taken"), F.concat(F.lit("another book of the run is written to "), "output_path")).otherwise(F.col("error")), "error_type": F.when(F.col("taken"), "output").otherwise(F.col("error_type"))}).drop("taken")
    if options.image_strategy == "extract":
        results = results.join(files.groupBy("book_id").agg(F.first(F.regexp_extract("path", "^([^/]*)/", 1)).alias("images_path")), "book_id", "left")
    else:
        results = results.withColumn("images_path", F.lit(None).cast("string"))
    # books are converted together, so what is told is the time until all are
    results = results.withColumn("duration_seconds", F.lit(watch.seconds))
    results = results.withColumns({"warnings": F.coalesce("warnings", F.from_json(F.lit("[]"), "array<struct<code:string,message:string,location:string>>")), "chapters": F.coalesce("chapters", F.array().cast("array<string>"))})
    results = results.withColumns({c: F.when(F.col("error").isNull(), F.col(c)) for c in ("output_path", "images_path")})
    fine = results.filter("error is null").select("book_id")
    return Conversion(results, outputs.join(fine, "book_id", "left_semi"), files.join(fine, "book_id", "left_semi"), warned)


def inspect_books(books: DataFrame, options: Options = Options(), reader=archives) -> DataFrame:
    """An inspection row for each book that passes preflight; contents stay packed."""
    good, _ = passed(books, options, reader)
    rows = reader.package_rows(good)
    items = package.classify_items(archives.items(rows))
    return package.inspect(items, package.reading_order(items, archives.spine(rows)), reader.zip_entries(good), archives.metadata(rows))


def publish(conversion: Conversion, root: str, options: Options = Options()) -> None:
    """Writes the documents and extracted files of all good books below root, all or none."""
    from ..sinks.publish import write_files

    whole = conversion.outputs.select("path", F.encode("html", "UTF-8").alias("content")).unionByName(conversion.files.select("path", "content"))
    write_files(whole, root, options.force)
