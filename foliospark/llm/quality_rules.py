"""Line-first cleaning: rules judge every line, failing lines go, and documents that lose too much text are rejected.

Everything is a DataFrame expression over one row, so nothing is shuffled.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, fresh, words

#: Phrases that mark a boilerplate line, in lower case.
BOILERPLATE = (
    "all rights reserved", "licensed under", "general public license", "creative commons", "privacy policy", "cookie policy",
    "terms of use", "terms of service", "enable javascript", "lorem ipsum", "click here", "sign in", "log in", "subscribe to",
    "copyright (c)",
)
#: A phrase stands between other characters than letters and digits; the sign anywhere.
PHRASES = r"(?:^|[^\p{L}\p{N}])(?:" + "|".join(p.replace("(", r"\(").replace(")", r"\)") for p in BOILERPLATE) + r")(?:$|[^\p{L}\p{N}])|©"


@dataclass(frozen=True)
class LineRules:
    """Thresholds; a line fails if any of the three rules fits it."""

    #: Punctuation: more than this many marks, and this share of the line's visible characters.
    free_marks: int = 2
    mark_share: float = 0.15
    #: Punctuation: a line of fewer words than this needs a sentence mark somewhere.
    bare_words: int = 6
    #: Navigation: so many separators, and at most so many words for each part between them.
    separators: int = 3
    part_words: int = 4
    #: Boilerplate: a phrase or more for so many words of the line.
    phrase_words: int = 20
    #: Documents that keep a smaller share of their lines' characters are rejected.
    least_kept: float = 0.5
    #: Base rules.
    least_words: int = 10
    repeat_percent: int = 20


def _line_fails(line: Column, rules: LineRules) -> Column:
    visible = F.length(F.regexp_replace(line, SPACE + "+", ""))
    marks = F.length(F.regexp_replace(line, r"[\p{L}\p{M}\p{N}\x20\x09-\x0D]+", ""))
    n_words = F.size(words(line))
    separators = F.length(F.regexp_replace(line, "[^|»›·•>]+", ""))
    heavy = marks > F.lit(rules.free_marks) + F.lit(rules.mark_share) * visible
    bare = (n_words < rules.bare_words) & ~line.rlike(r"[.!?…:;。！？]")
    navigation = (separators >= rules.separators) & (n_words <= rules.part_words * (separators + 1))
    phrases = F.regexp_count(F.lower(line), F.lit(PHRASES))
    boilerplate = (phrases > 0) & (rules.phrase_words * phrases >= n_words)
    return heavy | bare | navigation | boilerplate


def _windows(w: str, n: str) -> Column:
    """A 64-bit chained hash of every window of five words."""
    parts = lambda i: F.xxhash64(*[F.get(F.col(w), i + k) for k in range(5)])
    return F.when(F.col(n) >= 6, F.transform(F.sequence(F.lit(0), F.col(n) - 5), parts)).otherwise(F.array().cast("array<bigint>"))


def _covered(hashes: str) -> Column:
    """Words in windows whose hash is found twice or more."""
    ordered = F.sort_array(F.transform(F.col(hashes), lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def count(s: Column) -> Column:
        same = lambda i, j: F.get(s, i)["h"] == F.get(s, j)["h"]
        twice = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda j: F.coalesce(same(j, j - 1), F.lit(False)) | F.coalesce(same(j, j + 1), F.lit(False)))
        starts = F.transform(twice, lambda j: F.get(s, j)["i"])
        return F.size(F.array_distinct(F.flatten(F.transform(starts, lambda i: F.sequence(i, i + 4)))))

    # the one-element array binds the sorted windows once
    return F.get(F.transform(F.array(ordered), count), F.lit(0))


ADDED = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "lost_share", "clean_text", "kept")


def apply_quality_rules(docs: DataFrame, text: str = "text", rules: LineRules = LineRules()) -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, lost_share, clean_text and kept.

    Null and empty texts have no words: all counts are 0, base_failed is true, kept false
    and clean_text empty. A text is judged whole, however long; its words and their windows
    must fit a task. Repeated rows are judged alike and all stay; there are no ties to
    break. Columns of the input with one of the added names are replaced; all others pass
    through, whatever their names. An empty table gives an empty table. Windows are
    compared by 64-bit hashes within a document."""
    t, w, n, lines, h, clean, whole, left = fresh([*docs.columns, *ADDED], "t", "w", "n", "lines", "h", "clean", "whole", "left")
    own = docs.withColumn(t, F.coalesce(F.col(text), F.lit("")))
    own = own.withColumns({w: words(F.col(t)), lines: F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))})
    own = own.withColumns({n: F.size(w), clean: F.filter(lines, lambda x: ~_line_fails(x, rules))}).withColumn(h, _windows(w, n))
    own = own.withColumns({
        "n_words": F.col(n).cast("long"),
        "word_chars": F.length(F.array_join(w, "")).cast("long"),
        "n_symbols": F.length(F.regexp_replace(t, r"[^#*$%&|<>]+", "")).cast("long"),
        "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
        "n_repeat_words": F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(_covered(h)).cast("long"),
        "clean_text": F.array_join(clean, "\n"),
        whole: F.length(F.array_join(lines, "")),
        left: F.length(F.array_join(clean, "")),
    })
    own = own.withColumn("base_failed", (F.col("n_words") < rules.least_words) | (100 * F.col("n_repeat_words") > rules.repeat_percent * F.col("n_words")))
    own = own.withColumn("lost_share", F.when(F.col(whole) > 0, 1 - F.col(left) / F.col(whole)).otherwise(F.lit(0.0)))
    own = own.withColumn("kept", ~F.col("base_failed") & (F.col(left) >= rules.least_kept * F.col(whole)))
    return own.drop(t, w, n, lines, h, clean, whole, left)


COLUMNS = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def query(spark, sf_dir: str) -> DataFrame:
    return apply_quality_rules(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")).select(*COLUMNS)


SQL = r"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS r, coalesce(text, '') AS t FROM documents
), w AS (
  SELECT doc_id, r, t, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d
), g AS (
  SELECT r, i, array_to_string(ws[i:i+4], ' ') AS five FROM (SELECT r, ws, unnest(range(1, greatest(len(ws) - 3, 1))) AS i FROM w WHERE len(ws) >= 5)
), twice AS (
  SELECT r, i FROM g QUALIFY count(*) OVER (PARTITION BY r, five) > 1
), covered AS (
  SELECT r, count(DISTINCT i + k) AS n FROM twice, (SELECT unnest([0, 1, 2, 3, 4]) AS k) GROUP BY r
), l AS (
  SELECT r, line, length(regexp_replace(line, '[\x20\x09-\x0D]+', '', 'g')) AS visible,
         length(regexp_replace(line, '[\p{L}\p{M}\p{N}\x20\x09-\x0D]+', '', 'g')) AS marks,
         len(list_filter(regexp_split_to_array(line, '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS n,
         length(regexp_replace(line, '[^|»›·•>]+', '', 'g')) AS seps
  FROM (SELECT r, unnest(lines) AS line FROM w)
), judged AS (
  SELECT r, sum(length(line)) AS whole, sum(CASE WHEN
      marks > 2 + 0.15::DOUBLE * visible OR (n < 6 AND NOT regexp_matches(line, '[.!?…:;。！？]'))
      OR (seps >= 3 AND n <= 4 * (seps + 1)) OR (regexp_matches(lower(line), '{phrases}') AND 20 * len(regexp_extract_all(lower(line), '{phrases}')) >= n)
    THEN 0 ELSE length(line) END) AS remains FROM l GROUP BY r
), f AS (
  SELECT doc_id, r, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
         length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
         (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(c.n, 0)::BIGINT AS n_repeat_words
  FROM w LEFT JOIN covered c USING (r)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed,
       (NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND coalesce(remains, 0) >= 0.5 * coalesce(whole, 0)) AS kept
FROM f LEFT JOIN judged USING (r)
""".replace("{phrases}", PHRASES)
