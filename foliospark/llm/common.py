"""Shared pieces: the word alphabet, shared-folder tables, connected components."""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..tables import SharedTables, shared_dir

__all__ = ["SPACE", "SPACES", "SharedTables", "connected_components", "free", "fresh", "lean", "read", "shared_dir", "small_batches", "words"]

#: Characters between words; a word is a maximal run of anything else.
SPACE = r"[\x20\x09-\x0D]"
#: The same characters for Python code.
SPACES = " \t\n\x0b\x0c\r"


def words(text: Column) -> Column:
    """The words of a text as an array; null and blank texts give an empty array."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE + "+"), "")


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def small_batches(spark: SparkSession, most: str = "1m") -> None:
    """Bounds the bytes of a batch that Python gets, where the session doesn't, since texts can be very long. Rows and results of other queries stay as they are."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name, None) is None:
        spark.conf.set(name, most)


def free(spark) -> None:
    """Lets Spark delete the shuffle files of jobs that are done; only saves disk, and does nothing where the session has no JVM gateway."""
    import gc

    gc.collect()
    if (context := getattr(spark, "sparkContext", None)) is not None:
        context._jvm.System.gc()


def fresh(taken, *names: str) -> list[str]:
    """The names, with underscores before those that are taken, whatever the case of their letters."""
    used, out = {t.lower() for t in taken}, []
    for name in names:
        while name.lower() in used:
            name = f"_{name}"
        used.add(name.lower())
        out.append(name)
    return out


#: What workers hold beyond a task, by name: functions that let go of it.
HELD: dict = {}


def lean(run, holds: str | None = None):
    """The same function over batches, in a worker that holds little beside.

    Workers are used again by other stages: what those hold in HELD under another name is
    let go before, and what this one has freed goes back to the system after."""

    def lean_run(batches):
        import ctypes
        import gc

        import pyarrow as pa

        from foliospark.llm.common import HELD as held  # the worker's own, not one that came with this function

        for name, let_go in held.items():
            if name != holds:
                let_go()
        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL(None).malloc_trim(0)
            except (AttributeError, OSError):  # not every C library can
                pass

    return lean_run


def least_neighbour(edges: DataFrame) -> DataFrame:
    """(u, m): the least node among u and its neighbours v.

    The key is wrapped, so that a join on u deals the rows anew and a node with
    very many neighbours can be split by the adaptive skew join."""
    return edges.groupBy(F.struct("u").alias("k")).agg(F.min("v").alias("m")).select(F.col("k.u").alias("u"), F.least("k.u", "m").alias("m"))


def connected_components(edges: DataFrame, tables: SharedTables) -> DataFrame:
    """(node, component) for every node of the undirected edges (u, v); component is the least node reachable.

    Alternates two star contractions until nothing changes: first every node ties its
    larger neighbours to the least node it sees, then its smaller ones. Both keep
    components and end in stars, after a number of rounds that grows with the
    logarithm of the longest path. All steps are joins and partial aggregates."""
    edges = edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    edges, before = tables.write(edges, "edges-0"), None
    for i in count(1):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # each larger neighbour v of u is tied to the least node u sees
        wide = both.join(least_neighbour(both), "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        wide = wide.distinct()
        # each smaller neighbour of u, and u itself, is tied to the least of them
        near = wide.join(least_neighbour(wide), "u")
        near = near.select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("e")).select(F.col("e.v").alias("u"), F.col("e.m").alias("v"))
        old, edges = edges, tables.write(near.filter("u <> v").distinct(), f"edges-{i}")
        # sums of hashes tell most rounds apart; whether nothing has changed, the edges themselves
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        settled = state == before and edges.join(old, ["u", "v"], "left_anti").isEmpty()
        tables.drop(f"edges-{i - 1}")
        if settled:
            break
        before = state
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
