"""Native column expressions; all of them stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

__all__ = [
    "anchor_component", "base64_plain", "basename", "css_urls", "dirname", "escape_html", "data_url", "file_suffix", "file_stem",
    "first_value", "keep_references", "language_or_default", "media_type_of", "number_with_commas", "percent_encode", "raster_signature",
    "srcset_entries", "stable_anchor", "strip_space", "text_or_null", "yes",
]

#: Media types by suffix.
MEDIA_TYPES = {".jpg": "image/jpeg", ".jpeg": "image/jpeg", ".png": "image/png", ".gif": "image/gif", ".webp": "image/webp", ".svg": "image/svg+xml"}
#: Characters that markup needs as references, the ampersand first.
REFERENCES = {"&": "&amp;", "<": "&lt;", ">": "&gt;", '"': "&quot;", "'": "&#x27;"}
#: Signatures of raster images.
SIGNATURES = {"image/png": ["89504E470D0A1A0A"], "image/jpeg": ["FFD8FF"], "image/gif": ["474946383761", "474946383961"]}


def yes(condition: Column) -> Column:
    """A condition in which unknown counts as false."""
    return F.coalesce(condition, F.lit(False))


def strip_space(value: Column) -> Column:
    """Without white space at both ends."""
    return F.regexp_replace(value, r"(?U)^\s+|\s+$", "")


def anchor_component(value: Column) -> Column:
    """Lower case; runs of anything but a-z and 0-9 become one dash, none at the ends; item if nothing is left."""
    dashed = F.regexp_replace(F.lower(value), "[^a-z0-9]+", "-")
    return F.coalesce(F.nullif(F.regexp_replace(dashed, "^-+|-+$", ""), F.lit("")), F.lit("item"))


def stable_anchor(value: Column) -> Column:
    """The slug and ten hex digits of the value's SHA-256."""
    return F.concat(anchor_component(value), F.lit("-"), F.substring(F.sha2(value, 256), 1, 10))


def escape_html(value: Column, quote: bool = True) -> Column:
    for plain, reference in REFERENCES.items():
        if quote or plain not in "\"'":
            value = F.replace(value, F.lit(plain), F.lit(reference))
    return value


def keep_references(markup: Column, but: tuple[str, ...]) -> Column:
    """Markup whose parsed text has all character references as they are written, but those of these names that end with a semicolon."""
    return F.regexp_replace(markup, f"&(?!(?:{'|'.join(but)});)", "&amp;")


def language_or_default(value: Column) -> Column:
    return F.when(yes(value.rlike(r"\A[A-Za-z0-9]+(?:-[A-Za-z0-9]+)*\z")), value).otherwise(F.lit("en"))


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def dirname(path: Column) -> Column:
    return F.regexp_extract(path, "^(.*)/[^/]*$", 1)


def file_suffix(path: Column) -> Column:
    """The last dot and what follows in the base name; empty if the name only starts with the dot, or ends with it."""
    return F.regexp_extract(basename(path), r"^.*[^.].*?(\.[^.]+)$|^[^.](\.[^.]+)$", 1)


def file_stem(path: Column) -> Column:
    name = basename(path)
    return F.substring(name, F.lit(1), F.length(name) - F.length(file_suffix(path)))


def media_type_of(media_type: Column, name: Column) -> Column:
    """The declared type, or one known by the name's suffix; null otherwise, on any machine."""
    known = F.create_map(*[F.lit(x) for pair in MEDIA_TYPES.items() for x in pair])
    return F.coalesce(F.nullif(media_type, F.lit("")), F.get(F.map_values(F.map_filter(known, lambda k, _: k == F.lower(file_suffix(name)))), F.lit(0)))


def base64_plain(content: Column) -> Column:
    """One line, whatever line length the session's base64 has."""
    return F.regexp_replace(F.base64(content), r"[\r\n]", "")


def data_url(media_type: Column, content: Column) -> Column:
    return F.concat(F.lit("data:"), media_type, F.lit(";base64,"), base64_plain(content))


def raster_signature(media_type: Column, content: Column) -> Column:
    """Whether the bytes begin as the media type says; false for all other types."""
    kind, held = F.lower(media_type), F.lit(False)
    for name, starts in SIGNATURES.items():
        for start in starts:
            held = held | ((kind == name) & F.startswith(content, F.to_binary(F.lit(start), F.lit("hex"))))
    webp = (kind == "image/webp") & F.startswith(content, F.to_binary(F.lit("52494646"), F.lit("hex"))) & (F.substring(content, 9, 4) == F.to_binary(F.lit("57454250"), F.lit("hex")))
    return yes(held | webp)


def percent_encode(value: Column) -> Column:
    """Everything but letters, digits and _.-~ as percent sequences."""
    formed = F.url_encode(value)
    for own, wanted in (("+", "%20"), ("*", "%2A"), ("%7E", "~")):
        formed = F.replace(formed, F.lit(own), F.lit(wanted))
    return formed


def srcset_entries(value: Column) -> Column:
    """[(url, descriptor)] of a srcset: parts between commas, cut at white space; a missing descriptor is empty."""
    parts = F.filter(F.transform(F.split(value, ","), strip_space), lambda x: x != "")
    halves = F.transform(parts, lambda x: F.split(x, r"(?U)\s+", 2))
    return F.transform(halves, lambda x: F.struct(F.get(x, F.lit(0)).alias("url"), F.coalesce(F.get(x, F.lit(1)), F.lit("")).alias("descriptor")))


def css_urls(css: Column) -> Column:
    """The references in url(...), without white space and quotes round them."""
    found = F.regexp_extract_all(css, F.lit(r"(?i)url\(([^)]*)\)"), F.lit(1))
    return F.transform(found, lambda x: F.regexp_replace(strip_space(x), "^[\"']+|[\"']+$", ""))


def first_value(values: Column, default: str | None = None) -> Column:
    """The first of a list of metadata values."""
    first = F.get(values, F.lit(0))
    return first if default is None else F.coalesce(first, F.lit(default))


def number_with_commas(value: Column) -> Column:
    return F.format_number(value, 0)


def text_or_null(content: Column) -> Column:
    """Bytes as text if they are valid UTF-8; null otherwise."""
    return F.try_validate_utf8(content.cast("string"))
