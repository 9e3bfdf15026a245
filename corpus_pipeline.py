"""The corpus pipeline: classify, drop near copies, cut repeats, mix sources, encode."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.llm import mixing, piece_codec, quality_classifier, simhash, suffix_dedup
from foliospark.llm.common import SharedTables, read

#: The columns of documents, which all stages but the last return.
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


#: Units whose tokens the encoder keeps; fewer than by default, beside what an executor holds of the stages before.
CACHED = 150_000

#: Bits in which fingerprints of near copies may differ, and the Jaccard similarity of shingle sets that the exact check asks for.
BITS, ALIKE = 6, 0.5


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier takes.

    Null, empty and blank texts weigh 0, as an average text does, and are kept by that; rows
    that repeat, or tie with the last one taken, are taken alike. Texts are whole. Other
    columns than those of documents go. No documents give none."""
    labels = read(spark, sf_dir, "labels").select("doc_id", "quality")
    return quality_classifier.classify(docs.select(*COLUMNS), labels).filter("kept").select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest doc_id, null first, of each group of near copies by SimHash.

    Fingerprints of distinct three-word shingles link at BITS or fewer differing bits, found by
    pigeonring filtering; an exact check then parts texts whose shingle sets are not alike. Null, empty and blank texts are one group. Of rows with the smallest doc_id, that of the
    least hash stays, and of rows that repeat one. Texts are whole; one text's shingles must
    fit a task. Other columns than those of documents go. No documents give none."""
    row = F.struct("doc_id", F.xxhash64(*COLUMNS).alias("hash"))
    marked = docs.select(*COLUMNS, row.alias("row"))
    groups = simhash.near_duplicates(marked.select("row", "text"), key="row", distance=BITS, similarity=ALIKE)
    gone = groups.filter(~F.col("row").eqNullSafe(F.col("component_id"))).select(F.col("row").alias("gone")).distinct()
    left = marked.join(gone, F.col("row").eqNullSafe(F.col("gone")), "left_anti")
    if not groups.groupBy("row").count().filter("count > 1").isEmpty():
        left = left.dropDuplicates(["row"])
    return left.select(*COLUMNS)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the strings of 100 bytes that an earlier document, or the same before, has too.

    Null texts stay null, and empty ones empty; every row stays, and n_chars follows the text.
    Rows that repeat are one document, so they stay whole alike; texts of one doc_id are
    ordered by their hash. Texts are whole. Other columns than those of documents go. No
    documents give none."""
    left = suffix_dedup.remove_repeats(docs.select(*COLUMNS), outputs=("kept_text",))
    return left.select("doc_id", F.when(F.col("text").isNotNull(), F.col("kept_text")).alias("text"), "lang", "source", F.when(F.col("text").isNotNull(), F.length("kept_text").cast("long")).alias("n_chars"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as its source's target asks for.

    Texts that are null or without a word count as nothing, and a source of only these is
    left out; a null source is the last one. Rows of one doc_id share their draw, repeated
    rows are mixed each. Texts are counted whole. Other columns than those of documents go.
    No documents give none."""
    return mixing.mix_documents(docs.select(*COLUMNS))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, with counts and digests of ids and decoded text.

    Null and empty texts have the end id only. Every row stays, repeated ones too, and there
    are no ties. Texts are whole. Other columns than doc_id, source and the text's are left
    out. No documents give none."""
    coded = piece_codec.encode_documents(docs.select("doc_id", "source", "text"), piece_codec.default_model(), outputs=("n_tokens", "ids", "ids_sha256", "decoded_sha256"), most_cached=CACHED)
    return coded.drop("text")


STAGES = [
    ("quality classifier", keep_quality),
    ("SimHash near-dedup", drop_near_copies),
    ("suffix-array dedup", cut_repeats),
    ("mixing sources to target weights", mix_sources),
    ("SentencePiece encoding and decoding", encode),
]

#: SQL has no fitted classifier, minimum hashes or tokenizer; the stages are tested one by one instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written to the shared folder and reread."""
    tables, docs = SharedTables(spark), read(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = tables.write(docs, f"stage-{i}")
            if i:
                tables.drop(f"stage-{i - 1}")
    return docs
