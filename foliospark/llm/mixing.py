"""Mixing sources to target weights: tokens per source give repetition rates, and rates give whole copies plus one seeded Bernoulli copy."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import fresh, words


@dataclass(frozen=True)
class Mix:
    """weights repeat over the sources in code-point order, null last; budget is the share of all sizes to take."""

    weights: tuple[int, ...] = (3, 1, 2)
    budget: float = 1.5
    most: float = 2.0
    seed: int = 7


def word_count(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def source_targets(sizes: DataFrame, mix: Mix) -> DataFrame:
    """(source, source_size, target) from rows (source, size).

    With weights w and caps c, the reshared targets are least(c, x * w) for the x at which
    they add up to the budget; x is the greatest (budget - C) / W over the sources in
    order of c / w, where C sums the caps before and W the weights from there on."""
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(mix.weights)
    listed = by_source.select("source", "source_size", F.get(F.array(*map(F.lit, mix.weights)), place).alias("weight"))
    everything, before = Window.partitionBy(F.lit(0)), Window.orderBy(F.col("source_size") / F.col("weight"), "source").rowsBetween(Window.unboundedPreceding, -1)
    cap = mix.most * F.col("source_size")
    listed = listed.withColumn("__level", (mix.budget * F.sum("source_size").over(everything) - F.coalesce(F.sum(cap).over(before), F.lit(0.0))) / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0))))
    return listed.select("source", "source_size", F.least(cap, F.max("__level").over(everything) * F.col("weight")).alias("target"))


def uniform(key: Column, seed: int) -> Column:
    """A number in [0, 1) that depends on key and seed only: 52 bits of an MD5."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("null")))
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def _planned(docs: DataFrame, names: list[str], text: str, source: str, key: str, mix: Mix) -> DataFrame:
    """The documents with their size, their source's size and target, and their copies, in columns of these names."""
    size, source_size, target, copies = names
    (of,) = fresh([*docs.columns, *names], "of")
    own = docs.withColumn(size, word_count(F.col(text)))
    targets = source_targets(own.select(F.col(source).alias("source"), F.col(size).alias("size")), mix)
    targets = targets.select(F.col("source").alias(of), F.col("source_size").alias(source_size), F.col("target").alias(target))
    joined = own.join(targets, F.col(source).eqNullSafe(F.col(of)), "left").drop(of)
    rate = F.when(F.col(source_size) > 0, F.col(target) / F.col(source_size)).otherwise(F.lit(0.0))
    drawn = F.floor(rate) + F.when(uniform(F.col(key), mix.seed) < rate - F.floor(rate), 1).otherwise(0)
    return joined.withColumn(copies, drawn.cast("long"))


ADDED = ["size", "source_size", "target", "copies"]


def plan_mix(docs: DataFrame, text: str = "text", source: str = "source", key: str = "doc_id", mix: Mix = Mix()) -> DataFrame:
    """Adds size, source_size, target and copies to every document.

    Null texts and texts without a word have size 0; a source without words has target 0
    and no copies. A null source is a source of its own, the last one. Texts are counted
    whole, however long. Rows with the same key, or none, share their draw; repeated rows
    count as often as they occur. Sources that tie in size for their weight are ordered by
    name. Columns of the input with an added name are replaced, all others pass through. An
    empty table gives an empty table. The targets, one row per source, join by source: Spark
    broadcasts them only if they measure below its threshold, and splits a hot source
    otherwise; one task orders the sources, a row each."""
    return _planned(docs.drop(*ADDED), ADDED, text, source, key, mix)


def mix_documents(docs: DataFrame, text: str = "text", source: str = "source", key: str = "doc_id", mix: Mix = Mix()) -> DataFrame:
    """The mixed corpus: every document as often as planned, with the columns it came with, whatever their names."""
    *names, copy = fresh(docs.columns, *ADDED, "copy")
    planned = _planned(docs, names, text, source, key, mix).filter(F.col(names[3]) > 0)
    return planned.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(names[3])))).select(*docs.columns)


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    return plan_mix(docs).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> ''))::BIGINT AS size FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size, [3, 1, 2][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS weight FROM d GROUP BY source
), levels AS (
  SELECT (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(2.0::DOUBLE * source_size) OVER p, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER p, 0)) AS level
  FROM s WINDOW p AS (ORDER BY source_size::DOUBLE / weight, source NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), t AS (
  SELECT source, source_size, least(2.0::DOUBLE * source_size, (SELECT max(level) FROM levels) * weight) AS target FROM s
), r AS (
  SELECT doc_id, size, source_size, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate,
         ('0x' || substr(md5('7:' || doc_id), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS u
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target, (size * (floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END))::BIGINT AS taken FROM r
"""
