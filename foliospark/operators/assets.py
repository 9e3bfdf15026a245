"""Assets: the index of images, the three ways a reference finds one, embedding and extraction, CSS and srcset."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import basename, data_url, media_type_of, normalize_path, percent_encode, raster_signature, resolve_path, split_url, srcset_entries, text_or_null
from ..policy import Options
from .tree import KEYS

#: Elements and attributes that refer to images and media.
IMAGE_ATTRIBUTES = (("img", "src"), ("image", "href"), ("image", "xlink:href"), ("source", "src"), ("audio", "src"), ("video", "src"), ("video", "poster"))
CSS_URL = re.compile(r"url\(([^)]*)\)", re.I)


def accept_images(items: DataFrame, options: Options) -> DataFrame:
    """Adds type and accepted: images need a media type, and in safe mode a raster format that their bytes show."""
    own = items.withColumn("type", media_type_of(F.col("media_type"), F.col("name")))
    fine = F.col("type").isNotNull()
    return own.withColumn("accepted", fine & (raster_signature(F.col("type"), F.col("content")) if options.safe_html else F.lit(True)))


def resource_action(media_type: Column, options: Options) -> Column:
    """extract, preserve or omit, by the font or the media policy."""
    return F.when(F.contains(media_type, F.lit("font")), options.font_policy).otherwise(options.media_policy)


def embedded_bytes(content: Column) -> Column:
    """Bytes that content takes in base64."""
    return (F.ceil(F.octet_length(content) / 3) * 4).cast("long")


def embed(items: DataFrame) -> DataFrame:
    """(book_id, asset_ord, path, url) with the content in the URL."""
    return items.select("book_id", F.col("item_ord").alias("asset_ord"), normalize_path("name").alias("path"), data_url(F.col("type"), F.col("content")).alias("url"))


def plain_names(names: list[str]) -> list[str]:
    """File names in order: a name that is taken, by letters of either case, gets the first free number from 2 on."""
    taken, out = set(), []
    for name in names:
        stem, dot, suffix = name.rpartition(".")
        stem, suffix = (stem, dot + suffix) if stem else (name, "")
        n, made = 2, name
        while made.lower() in taken:
            made, n = f"{stem}_{n}{suffix}", n + 1
        taken.add(made.lower())
        out.append(made)
    return out


def extract_names(items: DataFrame) -> DataFrame:
    """(book_id, item_ord, name, file): collision-free file names. A numbered name can itself collide, so this goes book by book; limits bound a book's items."""
    schema = T.StructType([items.schema[c] for c in ("book_id", "item_ord", "name")] + [T.StructField("file", T.StringType())])

    def one(book: pd.DataFrame) -> pd.DataFrame:
        book = book.sort_values("item_ord")
        return book.assign(file=plain_names([n.rpartition("/")[2] for n in book["name"]]))

    return items.select("book_id", "item_ord", "name").groupBy("book_id").applyInPandas(one, schema)


def extracted(items: DataFrame, directory: Column) -> DataFrame:
    """(book_id, asset_ord, path, url, file) with URLs into the directory."""
    named = extract_names(items)
    return named.select("book_id", F.col("item_ord").alias("asset_ord"), normalize_path("name").alias("path"), F.concat(percent_encode(directory), F.lit("/"), percent_encode(F.col("file"))).alias("url"), "file")


def by_path(assets: DataFrame) -> DataFrame:
    """(book_id, path, url): the last asset of a path wins."""
    return assets.groupBy("book_id", "path").agg(F.max_by("url", "asset_ord").alias("url"))


def by_basename(assets: DataFrame) -> DataFrame:
    """(book_id, base, n, url) by lower-cased base name."""
    return assets.groupBy("book_id", F.lower(basename(F.col("path"))).alias("base")).agg(F.count("*").alias("n"), F.max_by("url", "asset_ord").alias("url"))


def resolve_assets(references: DataFrame, assets: DataFrame) -> DataFrame:
    """references (book_id, path, reference, ...) with url and warning.

    A reference is looked up by the path it resolves to, then by its own path, then by
    its base name if one asset only has it; more are ambiguous. References to other hosts find nothing."""
    own = references.withColumn("__u", split_url("reference"))
    inside = F.coalesce((F.col("__u.scheme") == "") & (F.col("__u.netloc") == "") & (F.col("__u.path") != ""), F.lit(False))
    plain = F.when(inside, normalize_path(F.coalesce("__u.path", F.lit(""))))
    own = own.withColumns({"__1": resolve_path("path", "reference"), "__2": plain, "__3": F.lower(basename(plain))})
    paths, bases = by_path(assets), by_basename(assets)
    for way in ("__1", "__2"):
        own = own.join(paths.select("book_id", F.col("path").alias(way), F.col("url").alias(f"{way}_url")), ["book_id", way], "left")
    own = own.join(bases.select("book_id", F.col("base").alias("__3"), F.col("n").alias("__n"), F.col("url").alias("__3_url")), ["book_id", "__3"], "left")
    url = F.coalesce("__1_url", "__2_url", F.when(F.col("__n") == 1, F.col("__3_url")))
    warning = F.when(url.isNull(), F.when(F.col("__n") > 1, "ambiguous-image").otherwise("unresolved-image"))
    return own.select(*references.columns, url.alias("url"), warning.alias("warning"))


def image_references(nodes: DataFrame, targets: DataFrame) -> DataFrame:
    """(keys, path, node_id, name, part, reference, descriptor): references of images and media, and each entry of a srcset; part is -1 for plain attributes."""
    flat = nodes.filter("kind = 'element'").select(*KEYS, "node_id", "tag", F.explode("attrs").alias("a")).select(*KEYS, "node_id", "tag", "a.name", "a.value")
    fits = F.lit(False)
    for tag, name in IMAGE_ATTRIBUTES:
        fits = fits | ((F.col("tag") == tag) & (F.col("name") == name))
    plain = flat.filter(fits).select(*KEYS, "node_id", "name", F.lit(-1).alias("part"), F.col("value").alias("reference"), F.lit("").alias("descriptor"))
    sets = flat.filter(F.col("tag").isin("img", "source") & (F.col("name") == "srcset"))
    parts = sets.select(*KEYS, "node_id", "name", F.posexplode(srcset_entries(F.col("value"))).alias("part", "e")).select(*KEYS, "node_id", "name", "part", F.col("e.url").alias("reference"), F.col("e.descriptor").alias("descriptor"))
    return plain.unionByName(parts).join(targets.select(*KEYS, "path"), KEYS)


def image_changes(resolved: DataFrame) -> DataFrame:
    """Attribute changes (keys, node_id, name, value) from resolved references; srcset entries are put together again."""
    entry = F.concat(F.coalesce("url", "reference"), F.when(F.col("descriptor") != "", F.concat(F.lit(" "), "descriptor")).otherwise(F.lit("")))
    whole = resolved.groupBy(*KEYS, "node_id", "name").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", entry.alias("s")))), lambda x: x["s"]), ", ").alias("value"))
    return whole


def image_warnings(resolved: DataFrame) -> DataFrame:
    """(book_id, phase, doc_ord, seq, code, message, location)."""
    return resolved.filter("warning is not null").select("book_id", F.lit(3).alias("phase"), "doc_ord", "node_id", F.col("warning").alias("code"), F.concat(F.lit("no single asset for "), "reference").alias("message"), F.col("path").alias("location"))


def css_references(sheets: DataFrame) -> DataFrame:
    """(book_id, item_ord, path, part, reference) of each url(...) in css."""
    from ..functions import css_urls

    return sheets.select("book_id", "item_ord", "path", F.posexplode(css_urls(F.col("css"))).alias("part", "reference"))


@F.pandas_udf(T.StringType())
def _put_urls(css: pd.Series, urls: pd.Series) -> pd.Series:
    def one(text, found):
        parts = iter(found if found is not None else [])
        return CSS_URL.sub(lambda m: m[0] if (u := next(parts, None)) is None else f"url('{u}')", text)

    return pd.Series([one(*x) for x in zip(css, urls)], dtype=object)


def rewrite_css(sheets: DataFrame, assets: DataFrame) -> DataFrame:
    """sheets (book_id, item_ord, path, css) with resolved references; others stay as they are, without a warning."""
    found = resolve_assets(css_references(sheets), assets)
    listed = found.groupBy("book_id", "item_ord").agg(F.transform(F.array_sort(F.collect_list(F.struct("part", "url"))), lambda x: x["url"]).alias("__urls"))
    joined = sheets.join(listed, ["book_id", "item_ord"], "left")
    return joined.withColumn("css", F.when(F.col("__urls").isNull(), F.col("css")).otherwise(_put_urls("css", "__urls"))).drop("__urls")


def stylesheets(items: DataFrame) -> DataFrame:
    """(book_id, item_ord, path, css): sheets as text; css is null for those that are not UTF-8."""
    return items.filter("kind = 'stylesheet'").select("book_id", "item_ord", F.col("name").alias("path"), text_or_null(F.col("content")).alias("css"))
