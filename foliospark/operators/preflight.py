"""Archive preflight as a set computation: every rule that fails gives a row, and the first in order is a book's error."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import strip_space, yes
from ..policy import ArchiveLimits

#: Members an archive needs, and what the first of them says.
REQUIRED = ("META-INF/container.xml", "mimetype")
MIMETYPE = "application/epub+zip"
LAST = 2_147_483_647


def preflight(books: DataFrame, entries: DataFrame, limits: ArchiveLimits = ArchiveLimits()) -> DataFrame:
    """(book_id, rule, error, message) of each book's first failing rule; nulls for books that pass.

    books: (book_id, is_zip, mimetype) with mimetype as text, null where there is none;
    entries: (book_id, entry_ord, name, compressed_size, file_size, unix_mode)."""
    own = entries.withColumn("name", F.replace("name", F.lit("\\"), F.lit("/")))
    again = F.row_number().over(Window.partitionBy("book_id", "name").orderBy("entry_ord")) > 1
    unsafe = (F.col("name") == "") | F.startswith("name", F.lit("/")) | F.array_contains(F.split("name", "/"), "..") | F.contains("name", F.lit("\0"))
    link = F.col("unix_mode").bitwiseAND(61440) == 40960
    ratio = ((F.col("compressed_size") == 0) & (F.col("file_size") > 0)) | (F.try_divide(F.col("file_size"), F.col("compressed_size")) > limits.max_compression_ratio)
    rules = [
        (4, unsafe, "invalid", F.concat(F.lit("unsafe member name: "), "name")),
        (5, link, "invalid", F.concat(F.lit("symbolic link: "), "name")),
        (6, F.col("again"), "invalid", F.concat(F.lit("duplicate member: "), "name")),
        (7, F.col("file_size") > limits.max_entry_bytes, "limit", F.concat(F.lit("member too large: "), "name")),
        (8, ratio, "limit", F.concat(F.lit("compression ratio too high: "), "name")),
    ]
    fault = lambda at, rule, error, message: F.struct(at.alias("at"), F.lit(rule).alias("rule"), F.lit(error).alias("error"), message.alias("message"))
    each = own.withColumn("again", again).select("book_id", F.explode(F.array_compact(F.array(*[F.when(yes(c), fault(F.col("entry_ord"), n, e, m)) for n, c, e, m in rules]))).alias("f"))
    first = each.groupBy("book_id").agg(F.min("f").alias("first"))
    whole = own.groupBy("book_id").agg(F.count("*").alias("n"), F.sum("compressed_size").alias("compressed"), F.sum("file_size").alias("expanded"), F.array_sort(F.array_except(F.array(*map(F.lit, REQUIRED)), F.collect_set(F.when(F.col("name").isin(*REQUIRED), F.col("name"))))).alias("missing"))
    joined = books.join(whole, "book_id", "left").join(first, "book_id", "left").withColumn("missing", F.coalesce("missing", F.array(*map(F.lit, REQUIRED))))
    declared = F.coalesce("mimetype", F.lit(""))
    checks = [
        F.when(yes(~F.col("is_zip")), fault(F.lit(-2), 2, "invalid", F.lit("not a ZIP archive"))),
        F.when(yes(F.col("n") > limits.max_entries), fault(F.lit(-1), 3, "limit", F.lit("too many members"))),
        F.col("first"),
        F.when(yes((F.col("compressed") > limits.max_compressed_bytes) | (F.col("expanded") > limits.max_expanded_bytes)), fault(F.lit(LAST), 9, "limit", F.lit("archive too large"))),
        F.when(F.size("missing") > 0, fault(F.lit(LAST), 10, "invalid", F.concat(F.lit("missing members: "), F.array_join("missing", ", ")))),
        F.when(strip_space(declared) != MIMETYPE, fault(F.lit(LAST), 11, "invalid", F.lit("wrong mimetype"))),
        F.when(declared != MIMETYPE, fault(F.lit(LAST), 12, "invalid", F.lit("mimetype has white space"))),
    ]
    # an unreadable archive has no entries, so nothing else is said of it
    found = joined.withColumn("f", F.array_min(F.array_compact(F.array(*checks))))
    return found.select("book_id", "f.rule", "f.error", "f.message")
