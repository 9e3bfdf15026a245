"""SimHash near-dedup with pigeonring filtering.

A document's fingerprint is the bitwise majority of the hashes of its word shingles.
Fingerprints are cut into segments, at least one more than the number of bits in which
linked ones may differ. Linked fingerprints agree in all segments but as many as these
bits, and the ring of segments can be entered so that every chain from there on stays
within its share of the budget; so fingerprints meet by their equal segments, and a pair
that overspends on chains from everywhere is dropped before the full check. With more
fingerprints there are more segments, so that more of their bits must be equal: a value
of the bits by which they meet stays rare at every size, and no link is lost at any.

Only distinct fingerprints are compared. A value that very many of them share in spite
of that is left to exact ways that emit no pairs: with two bits, fingerprints are linked
if and only if one bit or none, flipped in each, makes them meet; with other numbers,
all meet a few connected ones, and those that these don't reach meet all in blocks.

The near-copy stage of the pipeline is near_duplicates with more bits, over distinct
shingles, and an exact comparison of the shingle sets of what is linked.
similar_documents finds its candidates by minimum hashes instead.
"""

from __future__ import annotations

import math
from itertools import combinations, repeat

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SharedTables, connected_components, free, lean, small_batches

#: Segment values shared by more distinct fingerprints than this go the other exact way.
CROWD = 512
#: Fingerprints of such a value that a task compares with as many others, and those that all are compared with first.
CHUNK, LEADERS = 4096, 256


def fingerprint(text: bytes, shingle: int = 3, seed: int = 42) -> int:
    """Of UTF-8 bytes; A-Z count as a-z. A bit is set if it is in over half the hashes; 0 if there is no word."""
    import numpy as np
    import xxhash

    words = text.lower().split()
    if not words:
        return 0
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), seed)
    shingles = map(b" ".join, zip(*(words[i:] for i in range(shingle))))
    return majority(np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(seed)), np.uint64, len(words) - shingle + 1))


def majority(hashes) -> int:
    """The bits that are set in over half the hashes; none if there are no hashes."""
    import numpy as np

    count = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 65536):
        count += np.unpackbits(hashes[i : i + 65536].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * count > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, text: str = "text", shingle: int = 3, seed: int = 42, distinct: bool = False) -> DataFrame:
    """Replaces the text by its fingerprint fp, a signed 64-bit integer. If distinct, a shingle counts once, and id is a hash of the text's shingle set, 0 if it is empty."""
    from pyspark.sql import types as T

    made = ("fp", "id") if distinct else ("fp",)
    kept = [c for c in docs.columns if c not in (text, *made)]

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            values = batch.column(text).cast(pa.large_binary()).to_pylist()
            if distinct:
                sets = (shingle_set(v or b"", shingle, seed) for v in values)
                columns = zip(*((majority(s), set_id(s)) for s in sets))
            else:
                columns = [[fingerprint(v or b"", shingle, seed) for v in values]]
            columns = [pa.array(np.array(c, np.uint64).view(np.int64)) for c in columns] or [pa.array([], pa.int64())] * len(made)
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in kept] + columns, names=[*kept, *made])

    return docs.mapInArrow(lean(run), T.StructType([*[docs.schema[c] for c in kept], *[T.StructField(c, T.LongType()) for c in made]]))


def segment_bounds(parts: int) -> list[tuple[int, int]]:
    """(shift, width) of each segment; widths differ by one at most."""
    widths = [64 // parts + (i < 64 % parts) for i in range(parts)]
    return [(sum(widths[:i]), widths[i]) for i in range(parts)]


def segments_for(count: int, distance: int) -> int:
    """The least number of segments with which the equal ones have a value for about every 64 fingerprints."""
    parts = distance + 1
    while 64 * (parts - distance) / parts < math.log2(max(1, count)) - 6 and parts < distance + 6:
        parts += 1
    return parts


def meeting_masks(bounds, distance: int) -> list[tuple[tuple[int, ...], int]]:
    """(segments, mask of their bits) of all choices of segments that linked fingerprints may agree in."""
    full = [((1 << w) - 1) << s for s, w in bounds]
    return [(chosen, sum(full[k] for k in chosen)) for chosen in combinations(range(len(bounds)), len(bounds) - distance)]


def _chain_holds(x, start: int, bounds, distance: int):
    """Whether each chain of segments from start on has at most its share of the differing bits x. The share of l of m segments is distance * l / m."""
    import numpy as np

    at, spent = np.arange(len(x)), np.zeros(len(x), np.int64)
    for n in range(1, len(bounds) + 1):
        shift, width = bounds[(start + n - 1) % len(bounds)]
        spent += np.bitwise_count(x[at] >> np.uint64(shift) & np.uint64((1 << width) - 1))
        holds = spent * len(bounds) <= distance * n
        at, spent = at[holds], spent[holds]
    held = np.zeros(len(x), bool)
    held[at] = True
    return held


def _ring_holds(x, starts, bounds, distance: int):
    """Whether chains hold from one of some segments."""
    import numpy as np

    held = np.zeros(len(x), bool)
    for start in starts:
        held |= _chain_holds(x, start, bounds, distance)
    return held


def _roots(n: int, a, b):
    """The least index of each index's component under links a-b."""
    import numpy as np

    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _link_sorted(bounds, distance: int):
    """For rows (seg, value, fp) sorted by seg and value: a row (u, v) that ties each linked fingerprint to the least of its group's component."""
    chosen = [c for c, _ in meeting_masks(bounds, distance)]

    def links(rows):
        import numpy as np

        seg, value, fp = rows
        a, b = [], []
        for d in range(1, len(fp)):
            i = np.flatnonzero((value[d:] == value[:-d]) & (seg[d:] == seg[:-d]))
            if not len(i):
                break
            x = fp[i] ^ fp[i + d]
            held = np.zeros(len(i), bool)
            for k in np.unique(seg[i]):
                at = np.flatnonzero(seg[i] == k)
                # chains start at an equal segment; a pair that holds from another than these is met by that one too
                held[at] = _ring_holds(x[at], chosen[k], bounds, distance)
            i, x = i[held], x[held]
            i = i[np.bitwise_count(x) <= distance]
            a.append(i)
            b.append(i + d)
        if not a:
            return None
        root = _roots(len(fp), np.concatenate(a), np.concatenate(b))
        tied = np.flatnonzero(root != np.arange(len(fp)))
        return fp[tied], fp[root[tied]]

    def run(batches):
        import numpy as np
        import pyarrow as pa

        rest = None

        def emit(rows):
            if len(rows[2]) > 1 and (found := links(rows)) is not None and len(found[0]):
                yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in found], names=["u", "v"])

        for batch in batches:
            rows = [batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2).to_numpy().view(np.uint64)]
            if rest is not None:
                rows = [np.concatenate(x) for x in zip(rest, rows)]
            if not len(rows[2]):
                continue
            open_from = np.flatnonzero((rows[0] != rows[0][-1]) | (rows[1] != rows[1][-1]))
            cut = open_from[-1] + 1 if len(open_from) else 0  # the last group may go on
            yield from emit([x[:cut] for x in rows])
            rest = [x[cut:] for x in rows]
        if rest is not None:
            yield from emit(rest)

    return run


def _link_leaders(distance: int):
    """For rows (seg, value, chunk, role, fp) sorted by the first four, role 0 the leaders: (seg, value, chunk, fp, root) of the others, root the least of the leaders' largest component if one of this is linked, else null."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for key, (lead, own) in _dealt(batches, 3):
            lead = np.unique(lead)
            a, b = np.nonzero(np.bitwise_count(lead[:, None] ^ lead) <= distance)
            label = _roots(len(lead), a, b)
            first = np.bincount(label, minlength=1).argmax()
            core = lead[label == first]
            tied = np.zeros(len(own), bool)
            for x in core:
                tied |= np.bitwise_count(own ^ x) <= distance
            root = pa.array(np.full(len(own), core[0] if len(core) else 0, np.uint64).view(np.int64), mask=~tied)
            same = [pa.array([k] * len(own), t) for k, t in zip(key, (pa.int32(), pa.int64(), pa.int32()))]
            yield pa.RecordBatch.from_arrays([*same, pa.array(own.view(np.int64)), root], names=["seg", "value", "chunk", "fp", "root"])

    return run


def _link_blocks(distance: int):
    """For rows (seg, value, chunk, block, role, fp) sorted by the first five: ties (u, v) that connect what links those of role 1 to those of role 0."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for _, (chunk, block) in _dealt(batches, 4):
            both = np.concatenate([chunk, block])
            root = np.arange(len(both))
            for i in range(0, len(block), 64):
                a, b = np.nonzero(np.bitwise_count(block[i : i + 64, None] ^ chunk) <= distance)
                root = _roots(len(both), np.concatenate([a + len(chunk) + i, np.arange(len(both))]), np.concatenate([b, root]))
            tied = np.flatnonzero(both != both[root])
            if len(tied):
                yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in (both[tied], both[root[tied]])], names=["u", "v"])

    return run


def _dealt(batches, keys: int):
    """(key, (fps of role 0, fps of role 1)) of each key, for rows of so many key columns, role and fp, sorted by all but the last."""
    import numpy as np

    key, parts = None, ([], [])
    for batch in batches:
        rows = [batch.column(k).to_numpy() for k in range(keys + 2)]
        if not len(rows[0]):
            continue
        changes = np.any([x[1:] != x[:-1] for x in rows[: keys + 1]], axis=0)
        cuts = [0, *(np.flatnonzero(changes) + 1).tolist(), len(rows[0])]
        for begin, end in zip(cuts, cuts[1:]):
            own = tuple(x[begin].item() for x in rows[:keys])
            if own != key:
                if key is not None:
                    yield key, tuple(np.concatenate([np.zeros(0, np.uint64), *p]) for p in parts)
                key, parts = own, ([], [])
            parts[rows[keys][begin]].append(rows[keys + 1][begin:end].view(np.uint64))
    if key is not None:
        yield key, tuple(np.concatenate([np.zeros(0, np.uint64), *p]) for p in parts)


def link_crowds(met: DataFrame, crowded: DataFrame, tables: SharedTables, distance: int, chunk: int, leaders: int) -> DataFrame:
    """Edges (u, v) that connect what is linked among the fingerprints (seg, value, fp) of each crowded (seg, value, n).

    Those of a value are dealt out in chunks. All meet about so many of them, drawn by hash, in
    their chunk; what is linked to the largest component of these is connected, and needn't
    meet each other. The rest, in blocks, meet every chunk. A task holds a chunk and a block."""
    unit = ["seg", "value"]
    part = lambda seed, of: F.pmod(F.xxhash64(F.lit(seed), "fp"), of).cast("int")
    every = lambda of: F.explode(F.sequence(F.lit(0), of - 1))
    known = crowded.withColumn("chunks", F.ceil(F.col("n") / chunk).cast("int"))
    own = met.join(known, unit)
    lead = own.filter(F.pmod(F.xxhash64(F.lit(5), "fp"), F.col("n")) < leaders).select(*unit, every(F.col("chunks")).alias("chunk"), F.lit(0).alias("role"), "fp")
    own = own.select(*unit, part(6, F.col("chunks")).alias("chunk"), F.lit(1).alias("role"), "fp")
    dealt = own.unionByName(lead).repartition(*unit, "chunk").sortWithinPartitions(*unit, "chunk", "role")
    star = tables.write(dealt.mapInArrow(lean(_link_leaders(distance)), "seg int, value long, chunk int, fp long, root long"), "fp-star")
    ties = star.filter("root <> fp").select(F.col("fp").alias("u"), F.col("root").alias("v"))
    left = star.filter("root is null").groupBy(*unit).agg(F.count("*").alias("left"))
    blocks = known.join(left, unit).select(*unit, "chunks", F.ceil(F.col("left") / chunk).cast("int").alias("blocks"))
    all_ = star.join(blocks, unit).select(*unit, "chunk", every(F.col("blocks")).alias("block"), F.lit(0).alias("role"), "fp")
    rest = star.filter("root is null").join(blocks, unit).select(*unit, every(F.col("chunks")).alias("chunk"), part(7, F.col("blocks")).alias("block"), F.lit(1).alias("role"), "fp")
    dealt = all_.unionByName(rest).repartition(*unit, "chunk", "block").sortWithinPartitions(*unit, "chunk", "block", "role")
    return ties.unionByName(dealt.mapInArrow(lean(_link_blocks(distance)), "u long, v long"))


def link_fingerprints(prints: DataFrame, tables: SharedTables, distance: int = 2, crowd: int = CROWD, parts: int | None = None, *, chunk: int = CHUNK, leaders: int = LEADERS) -> DataFrame:
    """Edges (u, v) with the same components as all links between the distinct fingerprints fp."""
    parts = parts or segments_for(prints.count(), distance)
    bounds = segment_bounds(parts)
    masks = meeting_masks(bounds, distance)
    signed = lambda mask: mask - (1 << 64) if mask >> 63 else mask
    cut = [F.struct(F.lit(k).alias("seg"), F.col("fp").bitwiseAND(F.lit(signed(mask))).alias("value")) for k, (_, mask) in enumerate(masks)]
    met = prints.select("fp", F.explode(F.array(*cut)).alias("s")).select("s.seg", "s.value", "fp")
    crowded = tables.write(met.groupBy("seg", "value").agg(F.count("*").alias("n")).filter(F.col("n") > crowd), f"crowded-{parts}")
    own = met
    if some := not crowded.isEmpty():
        own = met.join(crowded, ["seg", "value"], "left_anti")
    dealt = own.select("seg", "value", "fp").repartition("seg", "value").sortWithinPartitions("seg", "value")
    edges = dealt.mapInArrow(lean(_link_sorted(bounds, distance)), "u long, v long")
    if some:
        if distance != 2:
            return edges.unionByName(link_crowds(met, crowded, tables, distance, chunk, leaders))
        many = met.join(crowded, ["seg", "value"], "left_semi").select("fp").distinct()
        near = F.array(F.col("fp"), *[F.col("fp").bitwiseXOR(F.lit((1 << b) - (1 << 64 if b == 63 else 0))) for b in range(64)])
        near = many.select("fp", F.explode(near).alias("h")).groupBy("h").agg(F.collect_set("fp").alias("fps"))  # 65 at most
        star = near.filter(F.size("fps") > 1).select(F.explode("fps").alias("u"), F.array_min("fps").alias("v")).filter("u <> v").distinct()
        edges = edges.unionByName(star)
    return edges


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 3, distance: int = 2, similarity: float | None = None) -> DataFrame:
    """(key, fp, component_id) for every row; component_id is the smallest key reachable by links of at most so many bits.

    Null, empty and blank texts have fingerprint 0 and link like any other. Texts of fewer
    words than a shingle are hashed whole. Texts are hashed whole, however long; one text's
    shingles must fit a task. Repeated rows link to each other, and components need no ties
    broken; rows with a null key stay, and a component of only such rows has a null
    component_id. Other columns are dropped, whatever their names. An empty table gives an
    empty table.

    With a similarity, a shingle that a text repeats counts once, and an exact check follows:
    texts of a component stay together as far as links of at least this Jaccard similarity of
    their shingle sets reach. Null, empty and blank texts are then linked only to each other."""
    tables = SharedTables(docs.sparkSession)
    small_batches(docs.sparkSession)
    if similarity is not None:
        return _checked_duplicates(docs.select(F.col(key).alias("key"), F.col(text).alias("text")), tables, shingle, distance, similarity).withColumnRenamed("key", key)
    marked = tables.write(fingerprints(docs.select(F.col(key).alias("key"), F.col(text).alias("text")), shingle=shingle), "marked")
    prints = tables.write(marked.groupBy("fp").agg(F.min("key").alias("least")), "prints")
    found = connected_components(link_fingerprints(prints, tables, distance), tables)
    placed = prints.join(found, prints.fp == found.node, "left").select("fp", "least", F.coalesce("component", "fp").alias("component"))
    lowest = placed.groupBy(F.struct("component").alias("c")).agg(F.min("least").alias("component_id")).select("c.component", "component_id")
    named = placed.select("fp", "component").join(lowest, "component").select("fp", "component_id")
    return marked.join(named, "fp").select(F.col("key").alias(key), "fp", "component_id")


def _checked_duplicates(docs: DataFrame, tables: SharedTables, shingle: int, distance: int, similarity: float) -> DataFrame:
    """near_duplicates of (key, text) with its exact check. The shingle sets of texts that no fingerprint links to another are not moved."""
    marked = tables.write(fingerprints(docs, shingle=shingle, distinct=True), "marked")
    # equal sets, of which there may be very many, go on as one
    texts = tables.write(marked.groupBy("id", "fp").agg(F.min("key").alias("least")), "texts")
    prints = tables.write(texts.select("fp").distinct(), "prints")
    met = connected_components(link_fingerprints(prints, tables, distance), tables)
    placed = texts.filter("id <> 0").join(met, texts.fp == met.node, "left").select("id", "least", F.coalesce("component", "fp").alias("unit"))
    placed = tables.write(placed, "placed")
    many = placed.groupBy(F.struct("unit").alias("c")).agg(F.count("*").alias("n")).filter("n > 1").select("c.unit")
    linked = tables.write(placed.join(many, "unit", "left_semi"), "linked")
    wanted = linked.select("least").distinct()

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            sets = [shingle_set(v or b"", shingle) for v in batch.column("text").cast(pa.large_binary()).to_pylist()]
            ids = np.array([set_id(s) for s in sets], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array([s.tobytes() for s in sets], pa.binary())], names=["id", "hashes"])

    sets = docs.join(wanted, F.col("key").eqNullSafe(F.col("least")), "left_semi").select("text").mapInArrow(lean(run), "id long, hashes binary")
    sets = tables.write(sets.groupBy("id").agg(F.first("hashes").alias("hashes")), "sets")
    units = linked.select("unit", "id")
    free(docs.sparkSession)
    found = connected_components(tables.write(exact_ties(units, sets, tables, similarity, WHOLE), "ties"), tables)
    for name in ("sets", "star", "linked", "placed"):
        tables.drop(name)
    return name_groups(marked, found).select("key", "fp", "component_id")


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return near_duplicates(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


#: Minimum hashes in a band, and bands. Sets of similarity s agree in some band with probability 1 - (1 - s**8)**48, whatever the number of texts: all but 0.00015 at 0.8.
BAND, BANDS = 8, 48
#: Candidate components of more sets than this are compared band group by band group, and groups of more, or of more hashes, in chunks.
WHOLE = 2048
HELD_HASHES = 4_000_000


def shingle_set(text: bytes, shingle: int, seed: int = 42):
    """The distinct hashes of a text's word shingles, sorted; texts of fewer words are one shingle, and those without a word have none."""
    import numpy as np
    import xxhash

    own = text.lower().split()
    if not own:
        return np.zeros(0, np.uint64)
    shingles = map(b" ".join, zip(*(own[i:] for i in range(shingle)))) if len(own) > shingle else [b" ".join(own)]
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(seed)), np.uint64))


def set_id(hashes) -> int:
    """A hash of a shingle set; 0 if it is empty."""
    import xxhash

    return xxhash.xxh3_64_intdigest(hashes.tobytes()) if len(hashes) else 0


def _factors():
    """Random odd multipliers, one for each minimum hash."""
    import numpy as np

    return np.random.RandomState(42).randint(0, 1 << 63, BAND * BANDS, np.uint64) * np.uint64(2) + np.uint64(1)


def band_values(hashes, factors):
    """A value for each band of the minimum hashes of a set."""
    import numpy as np

    least = np.full(len(factors), (1 << 64) - 1, np.uint64)
    for i in range(0, len(hashes), 64):
        np.minimum(least, (hashes[i : i + 64, None] * factors).min(axis=0), out=least)
    value = np.arange(BANDS, dtype=np.uint64)
    for part in least.reshape(BANDS, BAND).T:
        value = (value ^ part) * np.uint64(0xD6E8FEB86659FD93)
        value ^= value >> np.uint64(32)
    return value.view(np.int64)


def _band_groups(batches):
    """For rows (value, id) sorted by both: (grp, id, least) of the ids of each value that two or more have. Equal groups of ids have equal names grp."""
    import numpy as np
    import pyarrow as pa
    import xxhash

    def emit(value, ids):
        new = np.r_[True, (value[1:] != value[:-1]) | (ids[1:] != ids[:-1])]
        value, ids = value[new], ids[new]
        begin = np.flatnonzero(np.r_[True, value[1:] != value[:-1]])
        size = np.diff(np.r_[begin, len(value)])
        begin, size = begin[size > 1], size[size > 1]
        if len(begin):
            names = np.array([xxhash.xxh3_64_intdigest(ids[b : b + n].tobytes()) for b, n in zip(begin.tolist(), size.tolist())], np.uint64).view(np.int64)
            at = np.concatenate([np.arange(b, b + n) for b, n in zip(begin.tolist(), size.tolist())])
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(names, size)), pa.array(ids[at]), pa.array(np.repeat(ids[begin], size))], names=["grp", "id", "least"])

    rest = None
    for batch in batches:
        rows = [batch.column(0).to_numpy(), batch.column(1).to_numpy()]
        if rest is not None:
            rows = [np.concatenate(x) for x in zip(rest, rows)]
        if not len(rows[0]):
            continue
        before = np.flatnonzero(rows[0] != rows[0][-1])
        cut = before[-1] + 1 if len(before) else 0  # the last group may go on
        if cut:
            yield from emit(*(x[:cut] for x in rows))
        rest = [x[cut:] for x in rows]
    if rest is not None:
        yield from emit(*rest)


def similar_roots(sets: list, similarity: float):
    """For each of some sets the index of its component's first under links of at least this exact Jaccard similarity."""
    import numpy as np

    sizes = np.array([len(s) for s in sets])
    tokens, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
    order = np.argsort(tokens, kind="stable")
    tokens, owner = tokens[order], owner[order]
    root, listed, left = np.full(len(sets), -1), len(sets), len(sets)
    for first in range(len(sets)):
        if root[first] >= 0:
            continue
        root[first], queue, left = first, [first], left - 1
        while queue and left:
            if left < listed / 2:  # those reached need not be met again
                open_ = root[owner] < 0
                tokens, owner, listed = tokens[open_], owner[open_], left
            i = queue.pop()
            low, high = np.searchsorted(tokens, sets[i]), np.searchsorted(tokens, sets[i], "right")
            n = high - low
            at = np.arange(n.sum()) + np.repeat(low - np.r_[0, np.cumsum(n)[:-1]], n)
            shared = np.bincount(owner[at], minlength=len(sets))
            near = np.flatnonzero((root < 0) & (shared >= similarity * (sizes + sizes[i] - shared) - 1e-9))
            root[near] = first
            left -= len(near)
            queue += near.tolist()
    return root


def _link_sets(similarity: float):
    """For rows (unit, id, hashes) sorted by unit: ties (u, v) of each set to the first of its component in the unit."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        unit, ids, sets = None, [], []

        def emit():
            if len(ids) > 1:
                root = similar_roots(sets, similarity)
                tied = np.flatnonzero(root != np.arange(len(ids)))
                own = np.array(ids, np.int64)
                if len(tied):
                    yield pa.RecordBatch.from_arrays([pa.array(own[tied]), pa.array(own[root[tied]])], names=["u", "v"])

        for batch in batches:
            for at, i, hashes in zip(*(batch.column(k).to_pylist() for k in range(3))):
                if at != unit:
                    yield from emit()
                    unit, ids, sets = at, [], []
                ids.append(i)
                sets.append(np.frombuffer(hashes, np.uint64))
        yield from emit()

    return run


def _leader_links(similarity: float):
    """For rows (unit, chunk, role, id, hashes) sorted by the first three, the leader of role 0 first: (unit, chunk, id, linked) of the others."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        leader = np.zeros(0, np.uint64)
        for batch in batches:
            out: list[list] = [[], [], [], []]
            for unit, chunk, role, i, hashes in zip(*(batch.column(k).to_pylist() for k in range(5))):
                own = np.frombuffer(hashes, np.uint64)
                if not role:
                    leader = own
                    continue
                at = np.searchsorted(leader, own)
                shared = int((leader[np.minimum(at, len(leader) - 1)] == own).sum())
                for column, value in zip(out, (unit, chunk, i, shared >= similarity * (len(leader) + len(own) - shared) - 1e-9)):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int32()), pa.array(out[2], pa.int64()), pa.array(out[3], pa.bool_())], names=["unit", "chunk", "id", "linked"])

    return run


def _block_links(similarity: float):
    """For rows (unit, chunk, block, role, id, hashes) sorted by the first four: ties (u, v) that connect what links the sets of role 1 to those of role 0."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        key, ids, sets = None, ([], []), ([], [])

        def emit():
            if not ids[0] or not ids[1]:
                return
            sizes = np.array([len(x) for x in sets[0]])
            tokens, owner = np.concatenate(sets[0]), np.repeat(np.arange(len(sizes)), sizes)
            order = np.argsort(tokens, kind="stable")
            tokens, owner = tokens[order], owner[order]
            nodes = np.array([*ids[0], *ids[1]], np.int64)
            a, b = [], []
            for k, own in enumerate(sets[1]):
                low, high = np.searchsorted(tokens, own), np.searchsorted(tokens, own, "right")
                n = high - low
                at = np.arange(n.sum()) + np.repeat(low - np.r_[0, np.cumsum(n)[:-1]], n)
                shared = np.bincount(owner[at], minlength=len(sizes))
                near = np.flatnonzero(shared >= similarity * (sizes + len(own) - shared) - 1e-9)
                a.append(near)
                b.append(np.full(len(near), len(sizes) + k))
            root = _roots(len(nodes), np.concatenate(a), np.concatenate(b))
            tied = np.flatnonzero((root != np.arange(len(nodes))) & (nodes != nodes[root]))
            if len(tied):
                yield pa.RecordBatch.from_arrays([pa.array(nodes[tied]), pa.array(nodes[root[tied]])], names=["u", "v"])

        for batch in batches:
            for unit, chunk, block, role, i, hashes in zip(*(batch.column(k).to_pylist() for k in range(6))):
                if (unit, chunk, block) != key:
                    yield from emit()
                    key, ids, sets = (unit, chunk, block), ([], []), ([], [])
                ids[role].append(i)
                sets[role].append(np.frombuffer(hashes, np.uint64))
        yield from emit()

    return run


def crowd_ties(units: DataFrame, sets: DataFrame, sizes: DataFrame, tables: SharedTables, similarity: float, whole: int) -> DataFrame:
    """Ties (u, v) that connect what is linked within units (unit, id) too large for one task.

    The sets of a unit are dealt out in chunks. All meet its leader, the least, in their chunk;
    those linked to it are connected, and needn't meet each other. The rest, in blocks,
    meet every chunk. A task holds a chunk and a block. sizes is (unit, n, hashes)."""
    chunks = F.greatest(F.ceil(F.col("n") / whole), F.ceil(F.col("hashes") / HELD_HASHES)).cast("int")
    known = sizes.select("unit", "n", chunks.alias("chunks"))
    part = lambda of: F.pmod(F.xxhash64(F.lit(3), "id"), of).cast("int")
    every = lambda of: F.explode(F.sequence(F.lit(0), of - 1))
    own = units.join(known, "unit").select("unit", part(F.col("chunks")).alias("chunk"), F.lit(1).alias("role"), "id")
    least = tables.write(units.groupBy("unit").agg(F.min("id").alias("least")), "leaders")
    lead = least.join(known, "unit").select("unit", every(F.col("chunks")).alias("chunk"), F.lit(0).alias("role"), F.col("least").alias("id"))
    dealt = own.unionByName(lead).join(sets, "id").select("unit", "chunk", "role", "id", "hashes")
    dealt = dealt.repartition("unit", "chunk").sortWithinPartitions("unit", "chunk", "role")
    star = tables.write(dealt.mapInArrow(lean(_leader_links(similarity)), "unit long, chunk int, id long, linked boolean"), "star")
    ties = star.filter("linked").join(least, "unit").filter("id <> least").select(F.col("id").alias("u"), F.col("least").alias("v"))
    left = star.filter("not linked").groupBy("unit").agg(F.count("*").alias("left"))
    # blocks of the rest are about as large as chunks
    blocks = known.join(left, "unit").select("unit", "chunks", F.ceil(F.col("chunks") * F.col("left") / F.col("n")).cast("int").alias("blocks"))
    met = star.join(blocks, "unit").select("unit", "chunk", every(F.col("blocks")).alias("block"), F.lit(0).alias("role"), "id")
    rest = star.filter("not linked").join(blocks, "unit").select("unit", every(F.col("chunks")).alias("chunk"), F.pmod(F.xxhash64(F.lit(4), "id"), F.col("blocks")).cast("int").alias("block"), F.lit(1).alias("role"), "id")
    dealt = met.unionByName(rest).join(sets, "id").select("unit", "chunk", "block", "role", "id", "hashes")
    dealt = dealt.repartition("unit", "chunk", "block").sortWithinPartitions("unit", "chunk", "block", "role")
    return ties.unionByName(dealt.mapInArrow(lean(_block_links(similarity)), "u long, v long"))


def similar_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 5, similarity: float = 0.8, whole: int = WHOLE) -> DataFrame:
    """(key, component_id) for every row: groups of texts linked by an exact Jaccard similarity of their shingle sets of at least this.

    Sets that agree in one of a fixed number of bands of minimum hashes are candidates; their layout is the same for
    every number of texts. The candidates' connected components, or the band groups of
    components of more sets than whole, are compared set by set, in one task each or, where
    they are larger, in chunks; only exact links count. Equal sets are one, known by a hash
    of 64 bits. Null and blank texts are one group. Texts are whole; one text's shingles
    must fit a task. Repeated rows are linked, and components need no ties broken. Rows with
    a null key stay. Other columns are dropped. An empty table gives an empty table."""
    spark = docs.sparkSession
    tables = SharedTables(spark)
    small_batches(spark)

    def run(batches):
        import numpy as np
        import pyarrow as pa

        factors = _factors()
        for batch in batches:
            sets = [shingle_set(v or b"", shingle) for v in batch.column("text").cast(pa.large_binary()).to_pylist()]
            ids = np.array([set_id(s) for s in sets], np.uint64).view(np.int64)
            bands = pa.array([band_values(s, factors) if len(s) else [] for s in sets], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(ids), pa.array([s.tobytes() for s in sets], pa.binary()), bands], names=["key", "id", "hashes", "bands"])

    own = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    marked = tables.write(own.mapInArrow(lean(run), f"key {dict(own.dtypes)['key']}, id long, hashes binary, bands array<long>"), "marked")
    # equal sets, of which there may be very many, go on as one
    each = marked.filter(F.size("bands") > 0).groupBy("id").agg(F.first("bands").alias("bands"))
    rows = each.select(F.explode("bands").alias("value"), "id").repartition("value").sortWithinPartitions("value", "id")
    groups = tables.write(rows.mapInArrow(lean(_band_groups), "grp long, id long, least long").distinct(), "groups")
    met = connected_components(groups.select(F.col("id").alias("u"), F.col("least").alias("v")), tables)
    met = tables.write(met, "met")
    large = met.groupBy(F.struct("component").alias("c")).agg(F.count("*").alias("n")).filter(F.col("n") > whole).select("c.component")
    large = tables.write(large, "large")
    units = met.join(large, "component", "left_anti").select(F.col("component").alias("unit"), F.col("node").alias("id"))
    if not large.isEmpty():
        many = met.join(large, "component", "left_semi").select(F.col("node").alias("id"))
        units = units.unionByName(groups.join(many, "id", "left_semi").select(F.col("grp").alias("unit"), "id"))
    sets = marked.select("id", "hashes").join(met.select(F.col("node").alias("id")), "id", "left_semi").groupBy("id").agg(F.first("hashes").alias("hashes"))
    sets, units = tables.write(sets, "sets"), tables.write(units, "units")
    marked = tables.write(marked.select("key", "id"), "keys")
    for name in ("marked", "groups", "met", "large"):  # the sets are large
        tables.drop(name)
    free(spark)
    ties = tables.write(exact_ties(units, sets, tables, similarity, whole), "ties")
    for name in ("sets", "units", "star"):
        tables.drop(name)
    free(spark)
    return name_groups(marked, connected_components(ties, tables)).select(F.col("key").alias(key), "component_id")


def exact_ties(units: DataFrame, sets: DataFrame, tables: SharedTables, similarity: float, whole: int) -> DataFrame:
    """Ties (u, v) that connect what is linked within units (unit, id) by the exact similarity of sets (id, hashes)."""
    weights = sets.select("id", (F.octet_length("hashes") / 8).cast("long").alias("hashes"))
    weights = units.join(weights, "id").groupBy("unit").agg(F.count("*").alias("n"), F.sum("hashes").alias("hashes"))
    crowds = tables.write(weights.filter((F.col("n") > whole) | (F.col("hashes") > HELD_HASHES)), "crowds")
    alone = units
    if some := not crowds.isEmpty():
        alone = units.join(crowds.select("unit"), "unit", "left_anti")
    placed = alone.join(sets, "id").select("unit", "id", "hashes").repartition("unit").sortWithinPartitions("unit")
    ties = placed.mapInArrow(lean(_link_sets(similarity)), "u long, v long")
    if some:
        ties = ties.unionByName(crowd_ties(units.join(crowds.select("unit"), "unit", "left_semi"), sets, crowds, tables, similarity, whole))
    return ties


def name_groups(marked: DataFrame, found: DataFrame) -> DataFrame:
    """The rows (key, id and others), each with the smallest key of its component as component_id; what has no component (node, component) is one."""
    least = marked.groupBy("id").agg(F.min("key").alias("least"))
    placed = least.join(found, least.id == found.node, "left").select("id", "least", F.coalesce("component", "id").alias("component"))
    lowest = placed.groupBy(F.struct("component").alias("c")).agg(F.min("least").alias("component_id")).select("c.component", "component_id")
    named = placed.select("id", "component").join(lowest, "component").select("id", "component_id")
    return marked.join(named, "id")
