"""Quality classifier by importance resampling.

Two hashed n-gram models, of a target (texts labelled good) and of the raw corpus, give
every document a log weight: the sum of log target / raw over its n-grams, which are its
lower-cased words, runs of marks, and adjacent pairs of these. Gumbel noise, seeded by
the document's key, is added, and the top k documents are taken, which draws k documents
without replacement by their weights.

The weight of a long text is brought to that of a text of `span` n-grams. A sum over
thousands of n-grams would leave the noise no say, and would make every small difference
between the models' samples as large as one likes.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import SharedTables, fresh, lean, small_batches


@dataclass(frozen=True)
class Resampling:
    #: Hash buckets of the models, a power of two of at most 2**24.
    buckets: int = 1 << 16
    #: N-grams whose average log ratio a longer text's weight is made of.
    span: int = 64
    #: Labelled rows used at most; those with the least hash of their key.
    most_labels: int = 20_000
    #: Counts of the raw distribution added to the target's.
    smoothing: float = 10.0
    #: k is the number of documents whose log weight is at least this; by default found with half the labelled rows.
    floor: float | None = None
    #: Share of the good ones of that half that may lie below the floor, and how far the floor is set below that.
    lose: float = 0.001
    margin: float = 3.0
    seed: int = 11


#: Scripts without spaces between words; each of their characters is a token. Fixed ranges of Unicode: Thai to Lao, Myanmar, Khmer, kana, Han.
UNSPACED = r"\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff"
MARKS = r"!-/:-@\[-`{-~"
SPACE = r" \t\n\x0b\x0c\r"
TOKEN = re.compile(f"[{UNSPACED}]|[{MARKS}]+|[^{SPACE}{MARKS}{UNSPACED}]+")
#: A pair of equal tokens, whichever they are, is one n-gram; pairs of others are told by their tokens' numbers.
SAME, PAIR = 0x5BD1E995, 0x2545F491
#: Words whose numbers a task keeps.
KNOWN = 100_000


class _Numbers(dict):
    """A number of 32 bits for each token, the first of its MD5; a bounded number of them kept."""

    def __missing__(self, token: str) -> int:
        if len(self) >= KNOWN:
            self.clear()
        found = int.from_bytes(hashlib.md5(token.encode("utf-8", "replace"), usedforsecurity=False).digest()[:4], "big")
        if len(token) <= 64:
            self[token] = found
        return found


def features(text: str, buckets: int, numbers: dict | None = None):
    """Bucket numbers of all tokens and adjacent pairs of a whole text."""
    import numpy as np

    own = TOKEN.findall(text.lower())
    one = np.fromiter(map((_Numbers() if numbers is None else numbers).__getitem__, own), np.int64, len(own))
    two = np.where(one[:-1] == one[1:], SAME, one[:-1] * PAIR + one[1:])
    return np.concatenate([one, two >> 24]) & (buckets - 1)


def bucket_counts(docs: DataFrame, text: str, buckets: int) -> DataFrame:
    """(bucket, raw, target) over all documents; target over those with the column target. A task adds up its own first."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        raw, target, numbers = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64), _Numbers()
        for batch in batches:
            for value, good in zip(batch.column(text).to_pylist(), batch.column("target").to_pylist()):
                found, n = np.unique(features(value or "", buckets, numbers), return_counts=True)
                raw[found] += n
                if good:
                    target[found] += n
        some = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(raw[some]), pa.array(target[some])], names=["bucket", "raw", "target"])

    made = docs.select(text, "target").mapInArrow(lean(run), "bucket long, raw long, target long")
    return made.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))


def log_ratio(counts: DataFrame, how: Resampling):
    """The log of target over raw probability for each bucket; as many numbers as buckets."""
    import numpy as np

    raw, target = np.zeros(how.buckets), np.zeros(how.buckets)
    for r in counts.collect():  # a row for each bucket
        raw[r.bucket], target[r.bucket] = r.raw, r.target
    if not target.sum():
        return np.zeros(how.buckets)
    return np.log((target + how.smoothing) / (raw * (target.sum() / raw.sum()) + how.smoothing))


def add_log_weight(docs: DataFrame, text: str, ratio, how: Resampling, keep_text: bool = True) -> DataFrame:
    """Adds log_weight, 0 for a text without words, and n_features."""
    added = {"log_weight": T.DoubleType(), "n_features": T.LongType()}
    kept = [c for c in docs.columns if c not in added and (keep_text or c != text)]
    ratio = ratio.astype("float64")

    def run(batches):
        import pyarrow as pa

        numbers = _Numbers()
        for batch in batches:
            found = [features(v or "", how.buckets, numbers) for v in batch.column(text).to_pylist()]
            weights = [float(ratio[f].sum()) * min(1.0, how.span / max(1, len(f))) for f in found]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], pa.array(weights, pa.float64()), pa.array([len(f) for f in found], pa.int64())], names=[*kept, *added])

    schema = T.StructType([*[docs.schema[c] for c in kept], *[T.StructField(n, t) for n, t in added.items()]])
    return docs.select(*dict.fromkeys([*kept, text])).mapInArrow(lean(run), schema)


def seeded(key: Column, seed: int | str) -> Column:
    """52 bits of the MD5 of seed and key, as an integer."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))).cast("binary")), 1, 13), 16, 10).cast("long")


def gumbel(key: Column, seed: int) -> Column:
    """Standard Gumbel noise that depends on key and seed only."""
    return -F.log(-F.log((seeded(key, seed) + 0.5) / F.lit(float(1 << 52))))


def as_integer(value: Column) -> Column:
    """A double in steps of 2**-20 as an integer from 0 to below 2**63, in the same order; infinite ones at the ends."""
    inside = F.least(F.greatest(value, F.lit(-(2.0**41))), F.lit(2.0**41))
    return F.floor(inside * F.lit(float(1 << 20))).cast("long") + F.lit(1 << 62)


def kth_largest(values: DataFrame, k: int) -> int:
    """The k-th largest of the integers in column key, from 0 to below 2**63; -1 for k above their number.

    Four counts by 16 bits each, from the highest on, close in on it. A count gives
    65,536 rows at most, and so does what the driver gets."""
    prefix = 0
    for shift in (48, 32, 16, 0):
        here = values if shift == 48 else values.filter(F.shiftright("key", shift + 16) == F.lit(prefix))
        part = F.shiftright("key", shift).bitwiseAND(F.lit(0xFFFF)).cast("int")
        for r in sorted(here.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect(), reverse=True):
            if r.n >= k:
                prefix = prefix << 16 | r.part
                break
            k -= r.n
        else:
            return -1
    return prefix


def label_sample(labels: DataFrame, key: str, most: int) -> DataFrame:
    """(key, quality, half) of a bounded number of labelled documents, those with the least hash."""
    known = labels.filter(F.col(key).isNotNull() & F.col("quality").isNotNull()).groupBy(F.col(key).alias("key")).agg(F.max("quality").alias("quality"))
    return known.orderBy(seeded(F.col("key"), "label"), "key").limit(most).withColumn("half", seeded(F.col("key"), "half") % 2 == 0)


def classify(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", how: Resampling = Resampling(), keep_text: bool = True) -> DataFrame:
    """Adds log_weight, n_features, draw (log weight with noise, in steps of 2**-20) and kept.

    The raw model counts all documents, and each is drawn from. The target model counts
    the documents of quality 1 in half of a bounded sample of labels; labels is (key, quality).
    k is the number of documents whose log weight reaches the floor, by default one
    that nearly all good ones of the labelled rows reach which the target doesn't count.

    Null, empty and blank texts have log weight 0. Texts are read whole, however long; one
    is the most that a task holds of tokens. Repeated rows with one key, or none, share
    their noise; rows that tie with the k-th are all kept. With no label that fits, all
    log weights are 0 and all rows are kept. Columns of the input with an added name are
    replaced, all others pass through. An empty table gives an empty table. Texts are
    read twice: for the models, and for the weights, which are written with the rows."""
    spark = docs.sparkSession
    tables = SharedTables(spark)
    small_batches(spark)
    docs = docs.drop("log_weight", "n_features", "draw", "kept")
    sample = tables.write(label_sample(labels, key, how.most_labels), "labels")
    target = sample.filter("quality = 1 and half").select("key", F.lit(True).alias("target"))
    # the sample is bounded by most_labels
    marked = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).join(F.broadcast(target), "key", "left")
    ratio = log_ratio(bucket_counts(marked, "text", how.buckets), how)
    weighed = tables.write(add_log_weight(docs, text, ratio, how, keep_text).withColumn("draw", as_integer(F.col("log_weight") + gumbel(F.col(key), how.seed))), "weighed")
    floor = how.floor
    if floor is None:
        held = sample.filter("quality = 1 and not half").select("key")
        good = weighed.select(F.col(key).alias("key"), as_integer(F.col("log_weight")).alias("w")).join(F.broadcast(held), "key", "left_semi").select(F.col("w").alias("key"))
        n = good.count()
        floor = (kth_largest(good, max(1, n - int(how.lose * n))) - (1 << 62)) / (1 << 20) - how.margin if n else float("-inf")
    k = weighed.filter(F.col("log_weight") >= F.lit(floor)).count()
    least = kth_largest(weighed.select(F.col("draw").alias("key")), k) if k else 1 << 62
    return weighed.withColumn("kept", (F.col("draw") >= F.lit(least)) & F.lit(k > 0)).withColumn("draw", (F.col("draw") - F.lit(1 << 62)) / F.lit(float(1 << 20)))


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    return classify(docs, labels, keep_text=False).select("doc_id", "n_features", F.round("log_weight", 6).alias("log_weight"), "kept")


_CLASS = re.sub(r"\\[uU]0*([0-9a-f]{4,})", r"\\x{\1}", UNSPACED)
SQL = f"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(lower(coalesce(text, '')), '[{_CLASS}]|[{MARKS}]+|[^{SPACE}{MARKS}{_CLASS}]+') AS t FROM documents
), w AS (
  SELECT r, doc_id, unnest(t) AS t, generate_subscripts(t, 1) AS i FROM d
), h AS (
  SELECT t, ('0x' || substr(md5(t), 1, 8))::BIGINT AS h FROM (SELECT DISTINCT t FROM w)
), n AS (
  SELECT r, doc_id, h, lead(h) OVER (PARTITION BY r ORDER BY i) AS g FROM w JOIN h USING (t)
), f AS (
  SELECT r, doc_id, h & 65535 AS b FROM n
  UNION ALL SELECT r, doc_id, (CASE WHEN h = g THEN {SAME} ELSE h * {PAIR} + g END >> 24) & 65535 FROM n WHERE g IS NOT NULL
), lab AS (
  SELECT doc_id, max(quality) AS quality, ('0x' || substr(md5('half:' || doc_id::VARCHAR), 1, 13))::BIGINT % 2 = 0 AS half
  FROM labels WHERE doc_id IS NOT NULL AND quality IS NOT NULL GROUP BY doc_id
  ORDER BY ('0x' || substr(md5('label:' || doc_id::VARCHAR), 1, 13))::BIGINT, doc_id LIMIT 20000
), c AS (
  SELECT b, count(*)::DOUBLE AS raw, count(*) FILTER (lab.quality = 1 AND lab.half)::DOUBLE AS target FROM f LEFT JOIN lab USING (doc_id) GROUP BY b
), m AS (
  SELECT b, CASE WHEN sum(target) OVER () = 0 THEN 0 ELSE ln((target + 10) / (raw * (sum(target) OVER () / sum(raw) OVER ()) + 10)) END AS ratio FROM c
), s AS (
  SELECT r, sum(ratio) * least(1.0, 64.0 / count(*)) AS x, count(*) AS n FROM f JOIN m USING (b) GROUP BY r
), v AS (
  SELECT r, doc_id, coalesce(n, 0) AS n_features, coalesce(x, 0) AS x,
    coalesce(x, 0) - ln(-ln((('0x' || substr(md5('11:' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT + 0.5) / 4503599627370496)) AS draw
  FROM d LEFT JOIN s USING (r)
), held AS (
  SELECT x, row_number() OVER (ORDER BY x DESC) AS rank, count(*) OVER () AS n FROM v JOIN lab USING (doc_id) WHERE quality = 1 AND NOT half
), bound AS (
  SELECT coalesce(max(floor(x * 1048576) / 1048576) - 3, '-infinity'::DOUBLE) AS least FROM held WHERE rank = greatest(1, n - floor(0.001 * n))
), k AS (SELECT count(*) AS k FROM v, bound WHERE x >= least),
o AS (SELECT floor(draw * 1048576) AS draw, row_number() OVER (ORDER BY draw DESC) AS rank FROM v)
SELECT doc_id, n_features, round(x, 6) AS log_weight, coalesce(floor(v.draw * 1048576) >= (SELECT o.draw FROM o, k WHERE rank = k), false) AS kept FROM v
"""
