"""Embedding near-dedup by an exact metric range join.

Unit vectors link if their distance is at most r, which is the cosine in other terms.
Each belongs to the cell of its nearest pivot; pivots are the means of a clustered
sample. Two cells meet once, in one of them: a vector of the other cell is copied there
only if it can have a link in it. By the triangle inequality it then is no farther from
the cell's pivot than the cell's radius and r, and no nearer than the least distance in
the cell less r; and it lies within r of the plane between both pivots. So cells join
independently. A cell's own vectors are dealt out in chunks, which meet each other in
the same way, so that no cell is one task; a task holds one chunk and a block of what
it meets.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SharedTables, connected_components, lean, small_batches


@dataclass(frozen=True)
class RangeJoin:
    cosine: float = 0.9
    #: Vectors for each pivot, but no more pivots than this; a cell of more vectors than a chunk is dealt out in several.
    cell: int = 4096
    pivots: int = 4096
    #: Cells for fewer vectors, so that there is more than one task, of so many vectors at least.
    few: int = 12
    small: int = 512
    #: A cell's own vectors in one chunk, and vectors met at a time.
    chunk: int = 8192
    block: int = 1024
    #: Sampled vectors for each pivot, no more than this in all, and rounds of their clustering.
    sample: int = 64
    most_sampled: int = 65_536
    rounds: int = 4


def _unit(rows):
    """Unit vectors in double precision of an (n, d) array."""
    import numpy as np

    rows = rows.astype(np.float64)
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)  # no overflow in squares
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


def _matrix(column, d: int, kind: str):
    """The vectors as they came, of a column of their bytes."""
    import numpy as np

    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(-1, d)


def spread_pivots(sample, count: int, rounds: int):
    """The means of so many clusters of the unit vectors of a sample, from starts far from each other."""
    import numpy as np

    at = np.empty(count, np.int64)
    at[0], far = 0, np.full(len(sample), np.inf)
    rng = np.random.RandomState(5)
    for i in range(1, count):  # each start is drawn by its squared distance from those before
        far = np.minimum(far, np.maximum(0, 2 - 2 * sample @ sample[at[i - 1]]))
        total = far.sum()
        at[i] = min(np.searchsorted(np.cumsum(far), rng.uniform() * total), len(sample) - 1) if total > 0 else i
    pivots = sample[at].copy()
    for _ in range(rounds):
        own = np.concatenate([_nearest(sample[i : i + 4096], pivots)[1] for i in range(0, len(sample), 4096)])
        sums, n = np.zeros_like(pivots), np.bincount(own, minlength=count)
        np.add.at(sums, own, sample)
        pivots[n > 0] = sums[n > 0] / n[n > 0, None]
    return pivots


def _nearest(rows, pivots):
    """(distances from all pivots, nearest) of some unit vectors."""
    import numpy as np

    apart = np.sqrt(np.maximum(0, 1 + (pivots * pivots).sum(axis=1)[None, :] - 2 * rows @ pivots.T))
    return apart, apart.argmin(axis=1)


def usable(vector):
    """Whether a vector has components, all finite, and not all zero."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(fine & F.exists(vector, lambda x: x != 0), F.lit(False))


def _cells(distinct: DataFrame, pivots, d: int, kind: str) -> DataFrame:
    """(id, n, raw, cell, at): vectors as bytes with their nearest pivot and its distance."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            if not batch.num_rows:
                continue
            raw = np.array(batch.column("vector").to_pylist(), kind).reshape(-1, d)
            apart, cell = _nearest(_unit(raw), pivots)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("n"), pa.array([r.tobytes() for r in raw], pa.binary()), pa.array(cell, pa.int32()), pa.array(apart[np.arange(len(cell)), cell])], names=["id", "n", "raw", "cell", "at"])

    return distinct.select("id", "n", "vector").mapInArrow(lean(run), "id long, n long, raw binary, cell int, at double")


def _deal(cells: DataFrame, pivots, near, radius, chunks, reach: float, d: int, kind: str) -> DataFrame:
    """(cell, chunk, role, id, n, raw): role 0 for a chunk's own vectors, 1 for those that visit it. Two chunks meet in one of them."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        between = np.sqrt(np.maximum(0, (pivots * pivots).sum(axis=1)[:, None] + (pivots * pivots).sum(axis=1)[None, :] - 2 * pivots @ pivots.T))
        cell_numbers = np.arange(len(pivots))
        slack = reach + 1e-6
        for batch in batches:
            if not batch.num_rows:
                continue
            own, at, ids = batch.column("cell").to_numpy(), batch.column("at").to_numpy(), batch.column("id").to_numpy()
            apart, _ = _nearest(_unit(_matrix(batch.column("raw"), d, kind)), pivots)
            # of two cells, the one in which they meet depends on their numbers, so that all get alike many
            here = ((own[:, None] + cell_numbers) % 2 == 0) == (own[:, None] < cell_numbers)
            meets = here & (own[:, None] != cell_numbers) & (chunks[None, :] > 0)
            meets &= (apart <= radius[None, :] + slack) & (apart >= near[None, :] - slack)
            meets &= apart * apart - (at * at)[:, None] <= 2 * slack * between[own] + 1e-6
            chunk = ((ids.astype(np.uint64) ^ np.uint64(0x5BD1E995)) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64) % chunks[own]
            row, cell = np.nonzero(meets)
            times = chunks[cell]
            row, cell = np.repeat(row, times), np.repeat(cell, times)
            there = np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times)
            # chunks of the own cell with lower numbers
            lower = np.repeat(np.arange(len(own)), chunk)
            least = np.arange(len(lower)) - np.repeat(np.cumsum(chunk) - chunk, chunk)
            everyone = np.arange(len(own))
            row, role = np.concatenate([everyone, row, lower]), np.concatenate([np.zeros(len(own), np.int32), np.ones(len(row) + len(lower), np.int32)])
            cell, there = np.concatenate([own, cell, own[lower]]), np.concatenate([chunk, there, least])
            for i in range(0, len(row), 2048):
                at_rows = pa.array(row[i : i + 2048])
                yield pa.RecordBatch.from_arrays([pa.array(cell[i : i + 2048], pa.int32()), pa.array(there[i : i + 2048], pa.int32()), pa.array(role[i : i + 2048]), *[batch.column(c).take(at_rows) for c in ("id", "n", "raw")]], names=["cell", "chunk", "role", "id", "n", "raw"])

    return cells.mapInArrow(lean(run), "cell int, chunk int, role int, id long, n long, raw binary")


class _Chunk:
    """A chunk's own vectors, and their links with those met."""

    def __init__(self, how: RangeJoin, d: int):
        self.how, self.margin = how, max(1e-5, 4e-7 * d)
        self.parts: list = []
        self.rows = None

    def close(self):
        """All own vectors are there: they meet each other."""
        import numpy as np

        self.ids, self.n, self.rows = (np.concatenate(x) for x in zip(*self.parts))
        self.parts.clear()
        self.small, self.label, self.links = self.rows.astype(np.float32), np.arange(len(self.ids)), np.zeros(len(self.ids), np.int64)
        for i in range(0, len(self.ids), self.how.block):
            self.meet(self.ids[i : i + self.how.block], self.n[i : i + self.how.block], self.rows[i : i + self.how.block], False)

    def meet(self, ids, n, rows, visit: bool):
        """One block against the own vectors: (u, v, links) of the block's, or none. Visitors get links, too."""
        import numpy as np

        from .simhash import _roots

        cosine = self.small @ rows.astype(np.float32).T
        linked = cosine >= self.how.cosine - self.margin
        q, w = np.nonzero(linked)
        unsure = np.flatnonzero(cosine[q, w] < self.how.cosine + self.margin)
        for i in range(0, len(unsure), 65536):
            a, b = q[unsure[i : i + 65536]], w[unsure[i : i + 65536]]
            linked[a, b] = np.einsum("ij,ij->i", self.rows[a], rows[b]) >= self.how.cosine
        if len(unsure):
            q, w = np.nonzero(linked)
        if not len(q):
            return None
        np.add.at(self.links, q, n[w])
        some, first = np.unique(w, return_index=False), linked.argmax(axis=0)
        self.label = _roots(len(self.label), np.concatenate([np.arange(len(self.label)), q]), np.concatenate([self.label, first[w]]))
        if not visit:
            return None
        links = np.zeros(len(ids), np.int64)
        np.add.at(links, w, self.n[q])
        return np.repeat(ids[some], 2), np.stack([self.ids[first[some]], np.zeros(len(some), np.int64)], axis=1).ravel(), np.stack([np.full(len(some), -1), links[some]], axis=1).ravel()

    def found(self):
        import numpy as np

        tied = np.flatnonzero(self.label != np.arange(len(self.label)))
        u = np.concatenate([self.ids[tied], self.ids])
        return u, np.concatenate([self.ids[self.label[tied]], np.zeros(len(self.ids), np.int64)]), np.concatenate([np.full(len(tied), -1), self.links])


def _join_chunks(how: RangeJoin, d: int, kind: str):
    """Streams sorted chunks and gives rows (u, v, links): a tie of two vectors of one component, with links -1, or a number of rows linked to u, u's own among them."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        key, chunk = None, None
        waiting: list = []

        def out(found):
            if found is not None and len(found[0]):
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in found], names=["u", "v", "links"])

        def visit(least: int):
            """Lets those that wait meet the chunk, if they are so many."""
            if not waiting or sum(len(x[0]) for x in waiting) < least:
                return
            ids, n, rows = (np.concatenate(x) for x in zip(*waiting))
            waiting.clear()
            for i in range(0, len(ids), how.block):
                yield from out(chunk.meet(ids[i : i + how.block], n[i : i + how.block], rows[i : i + how.block], True))

        def finish():
            if chunk is not None and (chunk.parts or chunk.rows is not None):
                if chunk.rows is None:
                    chunk.close()
                yield from visit(1)
                yield from out(chunk.found())
            waiting.clear()

        for batch in batches:
            if not batch.num_rows:
                continue
            cell, number, role, ids, n = (batch.column(c).to_numpy() for c in ("cell", "chunk", "role", "id", "n"))
            rows = _unit(_matrix(batch.column("raw"), d, kind))
            change = np.flatnonzero((cell[1:] != cell[:-1]) | (number[1:] != number[:-1]) | (role[1:] != role[:-1])) + 1
            for i, j in zip([0, *change], [*change, len(cell)]):
                if (cell[i], number[i]) != key:
                    yield from finish()
                    key, chunk = (cell[i], number[i]), _Chunk(how, d)
                if role[i] == 0:
                    chunk.parts.append((ids[i:j], n[i:j], rows[i:j]))
                elif chunk.parts or chunk.rows is not None:  # else no vector was dealt to this chunk
                    if chunk.rows is None:
                        chunk.close()
                    waiting.append((ids[i:j], n[i:j], rows[i:j]))
                    yield from visit(how.block)
        yield from finish()

    return lean(run)


def near_duplicates(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", how: RangeJoin = RangeJoin()) -> DataFrame:
    """(key, n_links, component_id, kept) for every row of vectors.

    n_links counts the other rows linked directly, equal vectors included; component_id is
    the smallest key reachable. Null, empty and zero vectors and those with a null or
    non-finite component link with nothing, equal ones included; vectors of different
    length don't link. Rows are compared whatever their keys; rows with a null key stay,
    with kept null where their component has no other key. Repeated rows and ties of keys
    need no order. Other columns are dropped, whatever their names. An empty table gives
    an empty table. Memory of a task is bounded by chunk and block, and by one batch of
    vectors, however long these are."""
    import numpy as np

    spark = rows.sparkSession
    tables = SharedTables(spark)
    small_batches(spark)
    element = rows.schema[vector].dataType.elementType.typeName()
    kind = "float32" if element == "float" else "float64"
    own = rows.select(F.col(key).alias("key"), F.col(vector).alias("vector")).withColumn("fine", usable(F.col("vector"))).withColumn("hash", F.xxhash64("vector"))
    grouped = own.filter("fine").groupBy("vector").agg(F.min("key").alias("least"), F.count("*").alias("n"))
    distinct = tables.write(grouped.withColumns({"id": F.monotonically_increasing_id(), "hash": F.xxhash64("vector")}), "distinct")
    # rows find their vector again by its hash, or by itself should two of one hash exist
    by = ["hash"] if distinct.groupBy("hash").count().filter("count > 1").isEmpty() else ["hash", "vector"]
    lengths = [r.d for r in distinct.groupBy(F.size("vector").alias("d")).count().orderBy("d").collect()]
    ties, reach = None, math.sqrt(2 - 2 * how.cosine)
    for d in lengths:
        same = distinct.filter(F.size("vector") == d)
        count = same.count()
        wanted = max(1, min(how.pivots, max(-(-count // how.cell), min(how.few, count // how.small))))
        # a bounded number of rows, in an order that says nothing about the vectors
        picked = same.select("vector", "hash").orderBy("hash", "vector").limit(min(how.most_sampled, how.sample * wanted)).collect() if wanted > 1 else same.select("vector").limit(1).collect()
        sample = _unit(np.array([r.vector for r in picked], np.float64).reshape(-1, d))
        pivots = spread_pivots(sample, min(wanted, len(sample)), how.rounds)
        cells = tables.write(_cells(same, pivots, d, kind), f"cells-{d}")
        near, radius, chunks = np.zeros(len(pivots)), np.zeros(len(pivots)), np.zeros(len(pivots), np.int64)
        for r in cells.groupBy("cell").agg(F.min("at").alias("near"), F.max("at").alias("far"), F.count("*").alias("n")).collect():
            near[r.cell], radius[r.cell], chunks[r.cell] = r.near, r.far, -(-r.n // how.chunk)
        dealt = _deal(cells, pivots, near, radius, chunks, reach, d, kind)
        ordered = dealt.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(int(chunks.sum()), 100_000)), "cell", "chunk").sortWithinPartitions("cell", "chunk", "role")
        found = tables.write(ordered.mapInArrow(_join_chunks(how, d, kind), "u long, v long, links long"), f"found-{d}")
        ties = found if ties is None else ties.unionByName(found)
    if ties is None:
        ties = spark.createDataFrame([], "u long, v long, links long")
    components = connected_components(ties.filter("links < 0").select("u", "v"), tables)
    counts = ties.filter("links >= 0").groupBy(F.col("u").alias("id")).agg((F.sum("links") - 1).alias("links"))
    placed = distinct.select("id", *by, "least").join(counts, "id", "left").join(components, F.col("id") == F.col("node"), "left")
    placed = placed.select(*by, "least", F.coalesce("links", F.lit(0)).alias("n_links"), F.coalesce("component", "id").alias("component"))
    lowest = placed.groupBy(F.struct("component").alias("c")).agg(F.min("least").alias("component_id")).select("c.component", "component_id")
    named = placed.join(lowest, "component").select(*(F.col(c).alias(f"of_{c}") for c in by), "n_links", "component_id")
    matches = F.col("fine")
    for c in by:
        matches &= F.col(c) == F.col(f"of_{c}")
    out = own.select("key", "fine", *by).join(named, matches, "left")
    component = F.when(F.col("fine"), F.col("component_id")).otherwise(F.col("key"))
    return out.select(F.col("key").alias(key), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), (F.col("key") == component).alias("kept"))


def query(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))


SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
), ok AS (
  SELECT vec_id, e FROM v WHERE e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.vec_id AS u, b.vec_id AS w FROM ok a JOIN ok b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.9
), reach AS (
  SELECT u, w FROM links UNION SELECT r.u, l.w FROM reach r JOIN links l ON r.w = l.u
), n AS (SELECT u, count(*) AS n FROM links GROUP BY u), c AS (SELECT u, least(u, min(w)) AS c FROM reach GROUP BY u)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, coalesce(c, vec_id) AS component_id, coalesce(c, vec_id) = vec_id AS kept
FROM v LEFT JOIN n ON vec_id = n.u LEFT JOIN c ON vec_id = c.u
"""
