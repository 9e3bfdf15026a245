"""URL filters: rules first, then trust and distrust that flow over the links between hosts.

DataFrame operations only. Trust is a personalised PageRank from the hosts of allowed
pages along links; distrust is the same from the hosts of blocked pages against them.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SharedTables, fresh

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: (verdict, host, path)
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))


@dataclass(frozen=True)
class Propagation:
    damping: float = 0.85
    rounds: int = 10
    #: Where given, the rounds go on instead until the ranks' changes add up to no more than this and no new host is reached.
    tolerance: float | None = None
    #: A host is blocked if its distrust is above this times its trust.
    threshold: float = 1.0


#: The query's. Ranks of a kind add up to one at most, and each round's changes to 0.85 of the last one's.
SETTLED = Propagation(tolerance=1e-9)


def after_scheme(url: Column) -> Column:
    """What follows the first ://, or null."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + 3))


def host_of(url: Column) -> Column:
    """Up to the first of / ? #, with A-Z lower-cased; empty where there is no ://."""
    return F.coalesce(F.translate(F.regexp_extract(after_scheme(url), r"^([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(after_scheme(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_for(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, or nulls; the first of equally long ones."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for how, h, p in sorted(reversed(rules), key=lambda r: len(r[1] + r[2])):  # the longest is the outermost
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, how).otherwise(verdict)
    return rule, verdict


#: Comments and scripts, whose links are none, and links: an attribute href of its own in an a tag.
NO_LINKS = r"(?is)<!--.*?(?:-->|\z)|<script[\s>].*?(?:</script|\z)"
LINKS = r"""(?i)<a\s(?:[^>]*?\s)?href\s*=\s*["']?\s*((?:[a-z][a-z0-9+.-]*:)?//[^"'\s>]+)"""


def host_edges(pages: DataFrame) -> DataFrame:
    """(src, dst, n): links between different hosts, counted; relative links stay on their host and give none."""
    links = F.regexp_extract_all(F.regexp_replace("html", NO_LINKS, ""), F.lit(LINKS), F.lit(1))
    out = pages.filter(F.col("html").contains("//")).select(F.col("host").alias("src"), F.explode(links).alias("link"))
    target = F.when(F.col("link").startswith("//"), F.concat(F.lit("x:"), F.col("link"))).otherwise(F.col("link"))
    out = out.select("src", host_of(target).alias("dst")).filter("src <> dst and src <> '' and dst <> ''")
    return out.groupBy("src", "dst").agg(F.count("*").alias("n"))


def propagate(seeds: DataFrame, edges: DataFrame, tables: SharedTables, how: Propagation = Propagation()) -> DataFrame:
    """(host, trust, distrust) of all hosts that some seed reaches. seeds: (host, allowed, blocked) page counts."""
    whole = seeds.agg(F.sum("allowed").alias("a"), F.sum("blocked").alias("b")).first()
    kinds = F.explode(F.array(F.struct(F.lit(0).alias("kind"), (F.col("allowed") / F.lit(float(whole.a or 1))).alias("seed")), F.struct(F.lit(1).alias("kind"), (F.col("blocked") / F.lit(float(whole.b or 1))).alias("seed"))))
    seeds = tables.write(seeds.select("host", kinds.alias("k")).select("host", "k.*").filter("seed > 0"), "seeds")
    moves = edges.select(F.explode(F.array(F.struct(F.lit(0).alias("kind"), F.col("src"), F.col("dst")), F.struct(F.lit(1).alias("kind"), F.col("dst").alias("src"), F.col("src").alias("dst")))).alias("e"), "n").select("e.*", "n")
    out = moves.groupBy(F.struct("kind", "src").alias("k")).agg(F.sum("n").alias("total")).select("k.*", "total")
    moves = tables.write(moves.join(out, ["kind", "src"]).select("kind", F.col("src").alias("host"), "dst", (F.col("n") / F.col("total")).alias("share")), "moves")
    base = seeds.select("kind", "host", ((1 - how.damping) * F.col("seed")).alias("rank"))
    ranks = base
    if not moves.isEmpty():
        size = None
        for i in range(how.rounds) if how.tolerance is None else count():
            flow = ranks.join(moves, ["kind", "host"]).select("kind", F.col("dst").alias("host"), (how.damping * F.col("rank") * F.col("share")).alias("rank"))
            before, ranks = ranks, tables.write(base.unionByName(flow).groupBy("kind", "host").agg(F.sum("rank").alias("rank")), f"ranks-{i}")
            settled = False
            if how.tolerance is not None:
                moved = ranks.unionByName(before.withColumn("rank", -F.col("rank"))).groupBy("kind", "host").agg(F.sum("rank").alias("by"))
                now = moved.agg(F.count("*").alias("n"), F.sum(F.abs("by")).alias("by")).first()
                size, settled = now.n, now.n == size and now.by <= how.tolerance
            if i:
                tables.drop(f"ranks-{i - 1}")
            if settled:
                break
    one = lambda k: F.sum(F.when(F.col("kind") == k, F.col("rank")).otherwise(0.0))
    return ranks.groupBy("host").agg(one(0).alias("trust"), one(1).alias("distrust"))


def filter_urls(pages: DataFrame, rules=RULES, how: Propagation = Propagation()) -> DataFrame:
    """Adds host, path, rule, verdict, trust and distrust to pages with url and html.

    Null urls and urls without :// have empty host and path, no rule and no trust, and are
    allowed. Null html has no links. Repeated rows stay and count as links and seeds as
    often as they occur. Pages are read whole, however long. Links are those of a tags by
    patterns, outside comments and scripts. Columns of the input with an added name are
    replaced, all others but html pass through. An empty table gives an empty table. A host
    that no seed reaches is allowed; so is a tie."""
    spark = pages.sparkSession
    own = pages.drop("host", "path", "rule", "verdict", "trust", "distrust").withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    rule, verdict = rule_for(F.col("host"), F.col("path"), rules)
    (ruled,) = fresh([*own.columns, "rule", "verdict", "trust", "distrust"], "ruled")
    own = own.withColumns({"rule": rule, ruled: verdict})
    count = lambda v: F.count_if(F.col(ruled) == v)
    seeds = own.groupBy("host").agg(count("allow").alias("allowed"), count("block").alias("blocked")).filter("allowed + blocked > 0")
    ranks = propagate(seeds, host_edges(own), SharedTables(spark), how)
    judged = own.drop("html").join(ranks, "host", "left").withColumns({"trust": F.coalesce("trust", F.lit(0.0)), "distrust": F.coalesce("distrust", F.lit(0.0))})
    method = F.when(F.col("distrust") > how.threshold * F.col("trust"), "block").otherwise("allow")
    return judged.withColumn("verdict", F.coalesce(ruled, method)).drop(ruled)


def query(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return filter_urls(pages, how=SETTLED).select("page_id", "host", "path", "rule", "verdict")


def _sql(rules=RULES, how: Propagation = Propagation()) -> str:
    fits = "\n".join(f"    WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{{{i}}}'" for i, (_, h, p) in sorted(enumerate(rules), key=lambda x: -len(x[1][1] + x[1][2])))
    case = lambda of: fits.format(*[of(r) for r in rules])
    rounds = "".join(f""", r{i + 1} AS (SELECT kind, host, sum(rank) AS rank FROM (SELECT * FROM base UNION ALL
  SELECT kind, dst, {how.damping}::DOUBLE * rank * share FROM r{i} JOIN moves USING (kind, host)) GROUP BY kind, host)
""" for i in range(how.rounds))
    quoted = LINKS.replace("'", "''")
    return rf"""
WITH p AS (
  SELECT page_id, html, url, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) END AS rest FROM pages
), h AS (
  SELECT page_id, html, coalesce(translate(regexp_extract(rest, '^([^/?#]*)', 1), '{UPPER}', '{LOWER}'), '') AS host,
         coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM p
), j AS (
  SELECT *, CASE
{case(lambda r: r[1] + r[2])}
    END AS rule, CASE
{case(lambda r: r[0])}
    END AS ruled FROM h
), l AS (
  SELECT host AS src, unnest(regexp_extract_all(regexp_replace(html, '{NO_LINKS}', '', 'g'), '{quoted}', 1)) AS link FROM j
), e AS (
  SELECT src, dst, count(*) AS n FROM (SELECT src, translate(regexp_extract(substr(link, instr(link, '//') + 2), '^([^/?#]*)', 1), '{UPPER}', '{LOWER}') AS dst FROM l)
  WHERE src <> dst AND src <> '' AND dst <> '' GROUP BY src, dst
), way AS (
  SELECT 0 AS kind, src AS host, dst, n FROM e UNION ALL SELECT 1, dst, src, n FROM e
), moves AS (
  SELECT kind, host, dst, n / sum(n) OVER (PARTITION BY kind, host) AS share FROM way
), base AS (
  SELECT CASE ruled WHEN 'allow' THEN 0 ELSE 1 END AS kind, host, {1 - how.damping}::DOUBLE * count(*) / sum(count(*)) OVER (PARTITION BY ruled) AS rank
  FROM j WHERE ruled IS NOT NULL GROUP BY ruled, host
), r0 AS (SELECT * FROM base)
{rounds}, t AS (
  SELECT host, sum(CASE WHEN kind = 0 THEN rank ELSE 0 END) AS trust, sum(CASE WHEN kind = 1 THEN rank ELSE 0 END) AS distrust FROM r{how.rounds} GROUP BY host
)
SELECT page_id, host, path, rule, coalesce(ruled, CASE WHEN coalesce(distrust, 0) > coalesce(trust, 0) THEN 'block' ELSE 'allow' END) AS verdict
FROM j LEFT JOIN t USING (host)
"""


SQL = _sql()
