"""Archives: discovery, central directories, members, packages. One archive is read by one task; no driver loop."""

from __future__ import annotations

import io
import posixpath
import zipfile
from urllib.parse import unquote

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..policy import ArchiveLimits

ENTRY = "book_id string, entry_ord int, name string, compressed_size long, file_size long, unix_mode int"
STATUS = "book_id string, is_zip boolean, mimetype string"


#: File names that end in .epub, letters of either case.
NAMES = "*.[eE][pP][uU][bB]"


class MissingInput(FileNotFoundError):
    """An input path that leads nowhere."""


def read_books(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(book_id, input_ord, path, length, content) of all .epub files, letters of either case, in or below the given files, folders and globs; each once, at its first input.

    Other files are left out when files are listed, and a file that a former input has is
    not read again, so contents are neither read for nothing nor shuffled. An input that
    leads nowhere raises MissingInput, which names it."""
    files = lambda where: spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", NAMES).load(where)
    out, seen = None, set()
    for i, path in enumerate(paths):
        try:
            found = files(path)
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            raise MissingInput(path) from e
        listed = found.inputFiles() if len(paths) > 1 else []  # the driver has the list in any case
        left = [f for f in listed if f not in seen]
        if len(left) < len(listed):
            if not left:
                continue
            found = files(left)
        seen.update(left)
        part = found.select(F.col("path").alias("book_id"), F.lit(i).alias("input_ord"), "path", "length", "content")
        out = part if out is None else out.unionByName(part)
    if out is None:
        raise ValueError("there must be an input")
    return out


def expand_inputs(found: DataFrame) -> DataFrame:
    """(input_ord, path) with each path once, at its first input, from candidates (input_ord, path)."""
    return found.filter(F.lower("path").endswith(".epub")).groupBy("path").agg(F.min("input_ord").alias("input_ord")).select("input_ord", "path")


def _scan(rows, make, schema_names, kinds):
    import pyarrow as pa

    for batch in rows:
        out: list[list] = [[] for _ in schema_names]
        for book, content in zip(batch.column("book_id").to_pylist(), batch.column("content").to_pylist()):
            for row in make(book, content):
                for column, value in zip(out, row):
                    column.append(value)
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names=schema_names)


def _open(content):
    try:
        return zipfile.ZipFile(io.BytesIO(content))
    except (zipfile.BadZipFile, ValueError, OSError, TypeError):
        return None


def zip_entries(books: DataFrame) -> DataFrame:
    """A row for each central-directory entry; no member is decompressed. An unreadable archive has none."""

    def make(book, content):
        archive = _open(content)
        for i, e in enumerate(archive.infolist() if archive else []):
            yield book, i, e.filename, e.compress_size, e.file_size, e.external_attr >> 16 & 0xFFFF

    def run(batches):
        import pyarrow as pa

        yield from _scan(batches, make, ["book_id", "entry_ord", "name", "compressed_size", "file_size", "unix_mode"], [pa.string(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int32()])

    return books.select("book_id", "content").mapInArrow(run, ENTRY)


def zip_status(books: DataFrame, most: int = ArchiveLimits.max_entry_bytes) -> DataFrame:
    """(book_id, is_zip, mimetype): whether the archive opens, and its whole mimetype member, null if it is larger than a member may be."""

    def make(book, content):
        archive, kind = _open(content), None
        if archive:
            try:
                if archive.getinfo("mimetype").file_size <= most:
                    kind = archive.read("mimetype").decode("utf-8", "replace")
            except (KeyError, zipfile.BadZipFile, RuntimeError, NotImplementedError, OSError):
                kind = None
        yield book, archive is not None, kind

    def run(batches):
        import pyarrow as pa

        yield from _scan(batches, make, ["book_id", "is_zip", "mimetype"], [pa.string(), pa.bool_(), pa.string()])

    return books.select("book_id", "content").mapInArrow(run, STATUS)


def zip_members(books: DataFrame, most_bytes: int, suffixes: tuple[str, ...] | None = None) -> DataFrame:
    """(book_id, entry_ord, name, content) of members, decompressed up to a bound; suffixes, if given, tell which are wanted, and no other is decompressed. Use after preflight."""

    def make(book, content):
        archive = _open(content)
        for i, e in enumerate(archive.infolist() if archive else []):
            if e.is_dir() or suffixes is not None and not e.filename.lower().endswith(suffixes):
                continue
            try:
                with archive.open(e) as f:
                    yield book, i, e.filename, f.read(most_bytes)
            except (zipfile.BadZipFile, RuntimeError, NotImplementedError, OSError):
                yield book, i, e.filename, None

    def run(batches):
        import pyarrow as pa

        yield from _scan(batches, make, ["book_id", "entry_ord", "name", "content"], [pa.string(), pa.int32(), pa.string(), pa.binary()])

    return books.select("book_id", "content").mapInArrow(run, "book_id string, entry_ord int, name string, content binary")


def _package(book: str, content: bytes):
    """Rows (kind, at, id, value, more) of a package: items, spine places and metadata values."""
    from xml.etree import ElementTree

    local = lambda e: e.tag.rpartition("}")[2] if isinstance(e.tag, str) else ""
    archive = _open(content)
    if not archive:
        return
    try:
        container = ElementTree.fromstring(archive.read("META-INF/container.xml"))
        path = next(e.get("full-path") for e in container.iter() if local(e) == "rootfile")
        package = ElementTree.fromstring(archive.read(path))
    except (KeyError, StopIteration, ElementTree.ParseError, zipfile.BadZipFile, RuntimeError, NotImplementedError) as e:
        yield book, "error", 0, type(e).__name__, str(e), None
        return
    base, counts = posixpath.dirname(path), {}
    for part in package:
        for i, e in enumerate(part):
            if local(part) == "manifest" and local(e) == "item":
                name = posixpath.normpath(posixpath.join(base, unquote(e.get("href") or "")))
                yield book, "item", i, e.get("id"), name, e.get("media-type")
                if e.get("media-overlay") and not (e.get("properties") or "").split():
                    yield book, "overlay", i, name, e.get("media-overlay"), None
            elif local(part) == "spine" and local(e) == "itemref":
                yield book, "spine", i, e.get("idref"), e.get("linear") or "yes", None
            elif local(part) == "metadata" and (e.text or "").strip():
                n = counts[local(e)] = counts.get(local(e), -1) + 1
                yield book, "metadata", n, local(e), e.text.strip(), None


def package_rows(books: DataFrame) -> DataFrame:
    """(book_id, part, at, key, value, more); items(), spine() and metadata() read it."""

    def run(batches):
        import pyarrow as pa

        yield from _scan(batches, _package, ["book_id", "part", "at", "key", "value", "more"], [pa.string(), pa.string(), pa.int32(), pa.string(), pa.string(), pa.string()])

    return books.select("book_id", "content").mapInArrow(run, "book_id string, part string, at int, key string, value string, more string")


def items(package: DataFrame) -> DataFrame:
    return package.filter("part = 'item'").select("book_id", F.col("at").alias("item_ord"), F.col("key").alias("item_id"), F.col("value").alias("name"), F.col("more").alias("media_type"))


def spine(package: DataFrame) -> DataFrame:
    return package.filter("part = 'spine'").select("book_id", F.col("at").alias("spine_ord"), F.col("key").alias("idref"), F.col("value").alias("linear"))


def overlays(package: DataFrame) -> DataFrame:
    """(book_id, document, at, audio): the overlay that a document without properties names."""
    return package.filter("part = 'overlay'").select("book_id", F.col("key").alias("document"), "at", F.col("value").alias("audio"))


def metadata(package: DataFrame) -> DataFrame:
    return package.filter("part = 'metadata'").select("book_id", F.col("key").alias("name"), F.col("at").alias("value_ord"), "value")
