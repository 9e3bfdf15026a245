"""Suffix-array dedup of byte strings that repeat anywhere in a corpus.

Every byte goes that is covered by a window (a string of `length` bytes) found at an
earlier place too. The suffix array is a sampled one: each window has an anchor, its
least hashed gram, which depends on the window's content only, so equal windows have
their anchors at the same offset, and the suffixes that start at anchors are enough to
find all of them. Hashes choose anchors; they never decide what is equal.

1. Neighbouring windows of one anchor make a stretch, which carries all bytes of its
   windows. Splitters, sampled from the leading bytes of suffixes at anchors (with a
   number for the place as last token, so that a very frequent suffix is split as well),
   deal the stretches out into ranges.
2. Each range sorts its suffixes by multikey quicksort. Suffixes whose gram nothing
   shares are done. Of those that share it, whole stretches are compared byte by byte:
   all but the first of equal ones go. Windows of the stretches left are sorted and
   compared in the range, too.
3. The first and last gram of a range may go on in the next one, and a gram may have
   more windows than are sorted at once. Stretches of these grams are cut into pieces,
   each with the leading bytes that all its windows share; pieces are range-partitioned
   by these and sorted likewise, and the outer groups of each bucket compare their first
   windows across the boundaries.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import SharedTables, free, fresh, lean, small_batches


@dataclass(frozen=True)
class Repeats:
    #: Bytes of a window.
    length: int = 100
    #: Bytes of a gram, a power of two, eight at least.
    gram: int = 32
    #: Windows of an anchor are cut into pieces of at most so many.
    piece: int = 17
    #: Bytes of text for each range of stretches, and no more ranges than this.
    range_bytes: int = 6_000_000
    ranges: int = 16_384
    #: Sampled suffixes for each range.
    sample: int = 32
    #: Pieces for each bucket.
    bucket_pieces: int = 40_000
    #: Bytes looked at in one go, stretches kept before they are sent, and windows sorted at once.
    block: int = 1_000_000
    held: int = 250_000
    windows: int = 1_000_000


#: Odd multipliers of the hashes.
M1, M2, M3 = 0xFF51AFD7ED558CCD, 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
#: Text is sampled by slabs of so many bytes.
SLAB = 1024


def _mixed(h):
    import numpy as np

    h = h * np.uint64(M2)
    h ^= h >> np.uint64(32)
    h *= np.uint64(M3)
    h ^= h >> np.uint64(29)
    return h


def gram_hashes(data, gram: int):
    """A hash of the gram that starts at each byte."""
    import numpy as np

    h, factor, step = (data.astype(np.uint64) + np.uint64(1)) * np.uint64(M1), 0x100000001B3, 1
    while step < gram:
        h = h[:-step] * np.uint64(factor) + h[step:]
        factor, step = factor * factor % (1 << 64), 2 * step
    return _mixed(h)


def least_in_windows(h, width: int):
    """The place of the least of each width neighbouring hashes, the leftmost of equals."""
    import numpy as np

    value, place, step = h, np.arange(len(h), dtype=np.int32), 1
    while step < width:
        by = min(step, width - step)
        right = value[by:] < value[:-by]
        value = np.where(right, value[by:], value[:-by])
        place = np.where(right, place[by:], place[:-by])
        step += by
    return place


def stretches(parts: list[tuple[int, int, bytes]], how: Repeats):
    """Stretches of parts (order, offset, bytes): their joined bytes, and arrays order, start, windows, anchor - start, place in the bytes. None without a window."""
    import numpy as np

    raw = b"".join(p[2] for p in parts)
    data = np.frombuffer(raw, np.uint8)
    sizes = np.array([len(p[2]) for p in parts])
    ends = np.cumsum(sizes)
    windows = len(data) - how.length + 1
    if windows <= 0:
        return None
    place = least_in_windows(gram_hashes(data, how.gram), how.length - how.gram + 1)
    part = np.repeat(np.arange(len(parts), dtype=np.int32), sizes)[:windows]
    inside = np.flatnonzero(np.arange(windows) + how.length <= ends[part])
    if not len(inside):
        return None
    own = place[inside]
    first = np.flatnonzero(np.concatenate([[True], (own[1:] != own[:-1]) | (inside[1:] != inside[:-1] + 1)]))
    count = np.diff(np.concatenate([first, [len(inside)]]))
    begin = inside[first]
    orders, shift = np.array([p[0] for p in parts], np.int64), np.array([p[1] for p in parts], np.int64) - (ends - sizes)
    at = part[begin]
    return raw, orders[at], begin + shift[at], count.astype(np.uint8), (own[first] - begin).astype(np.uint8), begin


def text_blocks(rows, how: Repeats):
    """Lists of parts (order, offset, bytes) of about a block's bytes; long texts are cut so that no window is lost or doubled."""
    parts, held = [], 0
    for order, text in rows:
        for at in range(0, max(1, len(text) - how.length + 1), how.block):
            piece = text[at : at + how.block + how.length - 1] if len(text) > how.block else text
            if len(piece) < how.length:
                continue
            parts.append((order, at, piece))
            held += len(piece)
            if held >= how.block:
                yield parts
                parts, held = [], 0
    if parts:
        yield parts


def _texts(batches):
    for batch in batches:
        yield from zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())


def suffix_keys(raw: bytes, anchor, order, start, how: Repeats):
    """Sort keys of suffixes: the gram's bytes, and a number that depends on the place."""
    import numpy as np

    gram = np.lib.stride_tricks.sliding_window_view(np.frombuffer(raw, np.uint8), how.gram)[anchor]
    place = _mixed(_mixed(order.astype(np.uint64)) + start.astype(np.uint64)).astype(">u8").view(np.uint8).reshape(-1, 8)
    return np.ascontiguousarray(np.concatenate([gram, place], axis=1)).view(f"S{how.gram + 8}").ravel()


def _sample_keys(how: Repeats, share: float):
    """Keys of the suffixes in slabs of text, a share of all slabs that is chosen by hash."""

    def run(batches):
        import pyarrow as pa
        import xxhash

        def slabs():
            for order, text in _texts(batches):
                for at in range(0, len(text) - how.length + 1, SLAB):
                    if xxhash.xxh64_intdigest(b"%d %d" % (order, at)) < share * 2.0**64:
                        yield order, text[at : at + SLAB + how.length - 1]

        for parts in text_blocks(slabs(), how):
            if (found := stretches(parts, how)) is not None:
                raw, order, start, _, lead, begin = found
                keys = suffix_keys(raw, begin + lead, order, start, how).tobytes()
                size = how.gram + 8
                yield pa.RecordBatch.from_arrays([pa.array([keys[i : i + size] for i in range(0, len(keys), size)], pa.binary())], names=["key"])

    return lean(run)


def sampled_splitters(docs: DataFrame, ranges: int, whole: int, how: Repeats):
    """Keys that part the suffixes into about equal ranges; a bounded sample of keys comes to the driver."""
    import numpy as np

    share = min(1.0, how.sample * ranges * (how.length - how.gram + 2) / 2 / max(1, whole))
    keys = np.sort(np.array([bytes(r.key) for r in docs.mapInArrow(_sample_keys(how, share), "key binary").collect()], f"S{how.gram + 8}"))
    return keys[np.arange(1, ranges) * len(keys) // ranges] if len(keys) else keys


_COLUMNS = (("order", "int64"), ("start", "int64"), ("count", "uint8"), ("lead", "uint8"))


def _deal_stretches(how: Repeats, splitters):
    """Rows (range, n, size, packed) of each range's stretches, sorted by their suffixes and compressed."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        codec = pa.Codec("zstd", compression_level=1)
        kept: list = []

        def send():
            raw = b"".join(k[0] for k in kept)
            shift = np.cumsum([0, *(len(k[0]) for k in kept[:-1])])
            order, start, count, lead = (np.concatenate([k[i] for k in kept]) for i in range(1, 5))
            begin = np.concatenate([k[5] + s for k, s in zip(kept, shift)])
            kept.clear()
            keys = suffix_keys(raw, begin + lead, order, start, how)
            by = np.argsort(keys)
            edges = np.concatenate([[0], np.searchsorted(keys[by], splitters), [len(by)]])
            end = begin + count + how.length - 1
            for b in np.flatnonzero(edges[1:] > edges[:-1]).tolist():
                here = by[edges[b] : edges[b + 1]]
                packed = b"".join([*(x[here].tobytes() for x in (order, start, count, lead)), *(raw[i:j] for i, j in zip(begin[here].tolist(), end[here].tolist()))])
                yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), pa.array([len(here)], pa.int32()), pa.array([len(packed)], pa.int64()), pa.array([codec.compress(packed, asbytes=True)], pa.binary())], names=["range", "n", "size", "packed"])

        held = 0
        for parts in text_blocks(_texts(batches), how):
            if (found := stretches(parts, how)) is not None:
                kept.append(found)
                held += len(found[1])
            if held >= how.held:
                yield from send()
                held = 0
        if kept:
            yield from send()

    return lean(run)


def multikey_quicksort(n: int, word, depth, group=None):
    """Sorts rows 0 to n-1 by their words, within groups that are next to each other, and keeps equal ones in order.

    All open parts take a step at once: each is split three ways by a pivot's word, the
    median of three, into lesser, equal and greater rows. The equal part goes on to the
    next word; a part of one row, or of equal rows at their depth, is done.
    word(rows, at) gives the rows' words number at, depth the number of words: one for
    all rows, or one for each, which rows of equal first words share. Returns (rows in
    order, whether each equals the row before)."""
    import numpy as np

    rows, same = np.arange(n), np.zeros(n, bool)
    if not n:
        return rows, same
    deep = depth if isinstance(depth, np.ndarray) else np.full(n, depth)
    first = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])) if group is not None else np.zeros(1, np.int64)
    size, at = np.diff(np.concatenate([first, [n]])), np.zeros(len(first), np.int64)
    open_ = size > 1
    first, size, at = first[open_], size[open_], at[open_]
    words = np.zeros(n, np.uint64)  # the current word of each row
    if len(first):
        where = np.repeat(first - np.cumsum(size) + size, size) + np.arange(size.sum())
        words[where] = word(where, np.zeros(len(where), np.int64))
    while len(first):
        part = np.repeat(np.arange(len(first)), size)
        offset = np.cumsum(size) - size
        where = np.repeat(first - offset, size) + np.arange(len(part))
        own = rows[where]
        value = words[own]
        a, b, c = value[offset], value[offset + size // 2], value[offset + size - 1]
        pivot = np.maximum(np.minimum(a, b), np.minimum(np.maximum(a, b), c))[part]
        kind = (value >= pivot).astype(np.int64) + (value > pivot)
        counts = np.bincount(part * 3 + kind, minlength=3 * len(first)).reshape(-1, 3)
        starts = first[:, None] + np.cumsum(counts, axis=1) - counts
        to = np.empty(len(part), np.int64)
        for k in range(3):
            mine = np.flatnonzero(kind == k)
            before = np.cumsum(counts[:, k]) - counts[:, k]
            to[mine] = starts[part[mine], k] + np.arange(len(mine)) - before[part[mine]]
        rows[to] = own
        middle = counts[:, 1] > 1
        first, size, at = np.concatenate([starts[:, 0], starts[middle, 1], starts[:, 2]]), np.concatenate([counts[:, 0], counts[middle, 1], counts[:, 2]]), np.concatenate([at, at[middle] + 1, at])
        fresh_ = np.zeros(len(first), bool)
        fresh_[len(counts) : len(counts) + middle.sum()] = True
        done = fresh_ & (at >= deep[rows[np.minimum(first, n - 1)]])
        for i, m in ((first[done], size[done]),):
            run = np.repeat(i - np.cumsum(m) + m, m) + np.arange(m.sum())
            same[run] = True
            same[i] = False
        open_ = (size > 1) & ~done
        first, size, at, fresh_ = first[open_], size[open_], at[open_], fresh_[open_]
        by = np.argsort(first)
        first, size, at, fresh_ = first[by], size[by], at[by], fresh_[by]
        if fresh_.any():
            i, m = first[fresh_], size[fresh_]
            own = rows[np.repeat(i - np.cumsum(m) + m, m) + np.arange(m.sum())]
            words[own] = word(own, np.repeat(at[fresh_], m))
    return rows, same


def _words_of(data):
    """A function that gives the big-endian word at each of some places of bytes."""
    import numpy as np

    eight = np.lib.stride_tricks.sliding_window_view(data, 8)
    return lambda at: eight[at].view(">u8").ravel().astype(np.uint64)


def _later(same, order, start):
    """Of rows sorted by group, order and start, those that stand later than their group's first; same tells whether a row continues a group."""
    import numpy as np

    head = np.maximum.accumulate(np.where(same, 0, np.arange(len(same))))
    return same & ((order != order[head]) | (start != start[head]))


def _span(start, end):
    return start << 32 | end


def _repeated_windows(word, begin, windows, order, at, group, how: Repeats):
    """Of all windows of pieces (their bytes' place, number of windows, document, place there, group): (piece, place within it, repeated), by piece; repeated ones are equal to an earlier window of the group."""
    import numpy as np

    piece = np.repeat(np.arange(len(windows)), windows)
    within = np.arange(len(piece)) - np.repeat(np.cumsum(windows) - windows, windows)
    of, place, where = order[piece], at[piece] + within, begin[piece] + within
    by = np.lexsort((place, of, group[piece]))
    tail, sorted_where = how.length - 8, where[by]
    rows, same = multikey_quicksort(len(by), lambda r, k: word(sorted_where[r] + np.minimum(8 * k, tail)), -(-how.length // 8), group[piece][by])
    rows = by[rows]
    repeated = np.zeros(len(piece), bool)
    repeated[rows[_later(same, of[rows], place[rows])]] = True
    return piece, within, repeated


def _runs(piece, within, repeated):
    """(piece, first, last) of repeated windows that are neighbours in a piece."""
    import numpy as np

    begins = repeated & np.concatenate([[True], ~repeated[:-1] | (piece[1:] != piece[:-1])])
    ends = repeated & np.concatenate([~repeated[1:] | (piece[1:] != piece[:-1]), [True]])
    a, b = np.flatnonzero(begins), np.flatnonzero(ends)
    return piece[a], within[a], within[b]


def _unpacked(batches):
    """Columns and bytes of a range's stretches; None if there are none."""
    import numpy as np
    import pyarrow as pa

    codec = pa.Codec("zstd")
    columns: list[list] = [[] for _ in _COLUMNS]
    texts: list = []
    for batch in batches:
        for n, size, packed in zip(batch.column("n").to_pylist(), batch.column("size").to_pylist(), batch.column("packed")):
            raw, at = codec.decompress(packed.as_buffer(), size, asbytes=True), 0
            for column, (_, kind) in zip(columns, _COLUMNS):
                column.append(np.frombuffer(raw, kind, n, at))
                at += n * np.dtype(kind).itemsize
            texts.append(memoryview(raw)[at:])
    if not texts:
        return None
    data = b"".join([*texts, bytes(8)])
    return [np.concatenate(c) for c in columns], data


def _sort_range(how: Repeats):
    """Rows (order, span) of bytes to go, and (order, at, windows, lead, bytes) of pieces that must be compared beyond the range. Bytes from lead on, as many as shared, are in all windows of a piece."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        names = ["order", "span", "at", "windows", "lead", "bytes"]

        def spans(order, span):
            for i in range(0, len(order), 65536):
                a, b = pa.array(order[i : i + 65536]), pa.array(span[i : i + 65536])
                yield pa.RecordBatch.from_arrays([a, b, *(pa.nulls(len(a), k) for k in (pa.int64(), pa.int32(), pa.int32(), pa.binary()))], names=names)

        if (found := _unpacked(batches)) is None:
            return
        (order, start, count, lead), raw = found
        data = np.frombuffer(raw, np.uint8)
        size = count.astype(np.int64) + how.length - 1
        begin = np.cumsum(size) - size
        by = np.lexsort((start, order))
        order, start, count, lead, size, begin = order[by], start[by], count[by].astype(np.int64), lead[by].astype(np.int64), size[by], begin[by]
        word = _words_of(data)
        anchor = begin + lead
        rows, same = multikey_quicksort(len(by), lambda r, k: word(anchor[r] + 8 * k), how.gram // 8)
        group = np.cumsum(~same) - 1
        some = np.flatnonzero((np.bincount(group)[group] > 1) | (group == 0) | (group == group[-1]))
        last = group[-1]
        rows, group = rows[some], group[some]
        # whole stretches, with the anchor's place as their first word
        sort, same = multikey_quicksort(len(rows), lambda r, k: np.where(k == 0, (lead[rows[r]] << 8 | count[rows[r]]).astype(np.uint64), word(begin[rows[r]] + np.minimum(8 * np.maximum(k - 1, 0), size[rows[r]] - 8))), 1 - (-size[rows] // 8), group)
        rows, group = rows[sort], group[sort]
        gone = rows[_later(same, order[rows], start[rows])]
        yield from spans(order[gone], _span(start[gone], start[gone] + size[gone]))
        rows, group = rows[~same], group[~same]
        if not len(rows):
            return
        total = np.bincount(group, weights=count[rows])[group]
        beyond = (group == 0) | (group == last) | (total > how.windows)
        inner = np.flatnonzero(~beyond & (np.bincount(group)[group] > 1))
        block = (np.cumsum(count[rows[inner]]) - 1) // how.windows
        block = block[np.maximum.accumulate(np.where(np.concatenate([[True], group[inner][1:] != group[inner][:-1]]), np.arange(len(inner)), 0))] if len(inner) else block
        for b in np.unique(block):  # whole groups
            here = inner[block == b]
            own = rows[here]
            piece, first, end = _runs(*_repeated_windows(word, begin[own], count[own], order[own], start[own], group[here], how))
            at = start[own][piece]
            yield from spans(order[own][piece], _span(at + first, at + end + how.length))
        out: list[list] = [[], [], [], [], []]

        def pieces():
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary())
            columns = [pa.array(x, k) for x, k in zip(out, kinds)]
            for x in out:
                x.clear()
            return pa.RecordBatch.from_arrays([columns[0], pa.nulls(len(columns[0]), pa.int64()), *columns[1:]], names=names)

        far = rows[beyond]
        near = lead[far] - count[far] + 1  # a window starts from lead to near before the anchor
        for low in range(0, how.length - how.gram + 1, how.piece):
            high = low + how.piece - 1
            meets = np.flatnonzero((lead[far] >= low) & (near <= high))
            own = far[meets]
            a, b = np.minimum(lead[own], high), np.maximum(near[meets], low)
            skip = lead[own] - a
            for o, x, n, s, i in zip(order[own].tolist(), (start[own] + skip).tolist(), (a - b + 1).tolist(), (a - low).tolist(), (begin[own] + skip).tolist()):
                for column, value in zip(out, (o, x, n, s, raw[i : i + n + how.length - 1])):
                    column.append(value)
                if len(out[0]) >= 16384:
                    yield pieces()
        if out[0]:
            yield pieces()

    return lean(run)


def _sort_bucket(how: Repeats, shared: int):
    """Rows (order, span, window, at): spans to go, and the first windows of a bucket's outer groups, for a look across its boundaries."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        columns: list[list] = [[], [], [], []]
        texts: list[bytes] = []
        for batch in batches:
            for i, name in enumerate(("order", "at", "windows", "lead")):
                columns[i].append(batch.column(name).to_numpy())
            texts += batch.column("bytes").to_pylist()
        if not texts:
            return
        order, at, windows, lead = (np.concatenate(x).astype(np.int64) for x in columns)
        begin = np.cumsum(windows + how.length - 1) - (windows + how.length - 1)
        raw = b"".join([*texts, bytes(8)])
        texts.clear()
        word = _words_of(np.frombuffer(raw, np.uint8))
        core, tail = begin + lead, shared - 8
        rows, same = multikey_quicksort(len(order), lambda r, k: word(core[r] + np.minimum(8 * k, tail)), -(-shared // 8))
        group = np.cumsum(~same) - 1
        outer = (group == 0) | (group == group[-1])
        use = (np.bincount(group)[group] > 1) | outer
        rows, group, outer = rows[use], group[use], outer[use]
        order, at, begin = order[rows], at[rows], begin[rows]
        piece, within, repeated = _repeated_windows(word, begin, windows[rows], order, at, group, how)
        which, first, end = _runs(piece, within, repeated)
        span = _span(at[which] + first, at[which] + end + how.length)
        for i in range(0, len(which), 65536):
            m = len(span[i : i + 65536])
            yield pa.RecordBatch.from_arrays([pa.array(order[which[i : i + 65536]]), pa.array(span[i : i + 65536]), pa.nulls(m, pa.binary()), pa.nulls(m, pa.int64())], names=["order", "span", "window", "at"])
        edge = np.flatnonzero(outer[piece] & ~repeated)
        for i in range(0, len(edge), 8192):
            e = edge[i : i + 8192]
            where = begin[piece[e]] + within[e]
            yield pa.RecordBatch.from_arrays([pa.array(order[piece[e]]), pa.nulls(len(e), pa.int64()), pa.array([raw[x : x + how.length] for x in where.tolist()], pa.binary()), pa.array(at[piece[e]] + within[e])], names=["order", "span", "window", "at"])

    return lean(run)


def ordered_documents(docs: DataFrame, key: str, text: str, order: str, tables: SharedTables) -> DataFrame:
    """The documents with a column of the name given by order, a number that orders them by key, null first.

    It is the key itself where keys are unique. Otherwise texts of one key are ordered
    by their hash, and rows that repeat key and text share a number."""
    keys = docs.select(F.col(key).cast("long").alias("k")).groupBy("k").agg(F.count("*").alias("n"))
    if keys.filter("n > 1 or k is null").isEmpty():
        return docs.withColumn(order, F.col(key).cast("long"))
    k, h = fresh(docs.columns, "k", "h")
    named = docs.withColumns({k: F.col(key).cast("long"), h: F.xxhash64(F.coalesce(F.col(text), F.lit("")))})
    ranks = named.select(F.col(k).alias("rank_k"), F.col(h).alias("rank_h")).distinct().orderBy(F.col("rank_k").asc_nulls_first(), "rank_h")
    ranks = tables.write(ranks.select("rank_k", "rank_h", F.monotonically_increasing_id().alias("rank")), "ranks")
    r_k, r_h, r = fresh([*docs.columns, k, h, order], "rank_k", "rank_h", "rank")
    ranks = ranks.select(F.col("rank_k").alias(r_k), F.col("rank_h").alias(r_h), F.col("rank").alias(r))
    return named.join(ranks, F.col(k).eqNullSafe(F.col(r_k)) & (F.col(h) == F.col(r_h))).select(*docs.columns, F.col(r).alias(order))


def repeated_spans(docs: DataFrame, tables: SharedTables, how: Repeats = Repeats()) -> DataFrame:
    """(order, span): bytes to go, as start << 32 | end, for rows (order, text) with text as bytes."""
    spark = docs.sparkSession
    docs = docs.filter(F.octet_length("text") >= how.length)
    whole = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(how.ranges, -(-whole // how.range_bytes)))
    splitters = sampled_splitters(docs, ranges, whole, how)
    dealt = docs.mapInArrow(_deal_stretches(how, splitters), "range int, n int, size long, packed binary")
    first = tables.write(dealt.repartitionById(ranges, "range").mapInArrow(_sort_range(how), "order long, span long, at long, windows int, lead int, bytes binary"), "first")
    free(spark)
    pieces = first.filter("span is null").drop("span")
    shared = how.length - how.piece + 1
    parts = max(1, -(-pieces.count() // how.bucket_pieces))
    core = F.substring("bytes", F.col("lead") + 1, F.lit(shared))
    dealt = pieces.repartitionByRange(parts, core, "order", "at")
    sorted_ = tables.write(dealt.mapInArrow(_sort_bucket(how, shared), "order long, span long, window binary, at long"), "sorted")
    free(spark)
    # a window comes once at most from each bucket that its group reaches into
    met = sorted_.filter("window is not null").groupBy("window").agg(F.sort_array(F.collect_set(F.struct("order", "at"))).alias("places"))
    across = met.filter(F.size("places") > 1).select(F.explode(F.slice("places", F.lit(2), F.size("places"))).alias("p"))
    across = across.select("p.order", F.shiftleft("p.at", 32).bitwiseOR(F.col("p.at") + how.length).alias("span"))
    return first.filter("span is not null").select("order", "span").unionByName(sorted_.filter("span is not null").select("order", "span")).unionByName(across)


def merged(spans):
    """Sorted, merged (start, end) arrays of spans coded start << 32 | end."""
    import numpy as np

    if not len(spans):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    spans = np.sort(spans)
    start, end = spans >> 32, np.maximum.accumulate(spans & 0xFFFFFFFF)
    head = np.concatenate([[True], start[1:] > end[:-1]])
    return start[head], end[np.concatenate([head[1:], [True]])]


#: What remove_repeats can add.
OUTPUTS = {
    "n_bytes": T.LongType(), "n_removed": T.LongType(), "n_spans": T.LongType(), "kept_sha256": T.StringType(), "kept_bytes": T.BinaryType(), "kept_text": T.StringType(),
    "spans": T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])),
}


def _remove(kept: list[str], value_name: str, spans_name: str, outputs: tuple[str, ...]):
    def run(batches):
        import pyarrow as pa

        kinds = {"n_bytes": pa.int64(), "n_removed": pa.int64(), "n_spans": pa.int64(), "kept_bytes": pa.binary(), "spans": pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))}
        for whole in batches:
            for i in range(0, whole.num_rows, 32):  # texts can be long
                batch = whole.slice(i, 32)
                columns: dict[str, list] = {n: [] for n in outputs}
                for value, codes in zip(batch.column(value_name), batch.column(spans_name)):
                    value = value.as_py()
                    start, end = merged(codes.values.to_numpy()) if codes.is_valid else merged([])
                    at, left = 0, []
                    for a, b in zip(start.tolist(), end.tolist()):
                        left.append(value[at:a])
                        at = b
                    left = b"".join([*left, value[at:]]) if at else value
                    made = {"n_bytes": len(value), "n_removed": len(value) - len(left), "n_spans": len(start)}
                    for n in outputs:
                        if n == "kept_sha256":
                            made[n] = hashlib.sha256(left).hexdigest()
                        elif n == "kept_bytes":
                            made[n] = left
                        elif n == "kept_text":
                            made[n] = left.decode("utf-8", "ignore")
                        elif n == "spans":
                            made[n] = [{"start": a, "end": b} for a, b in zip(start.tolist(), end.tolist())]
                        columns[n].append(made[n])
                yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], *[pa.array(columns[n], kinds.get(n, pa.string())) for n in outputs]], names=[*kept, *outputs])

    return lean(run)


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", outputs: tuple[str, ...] = ("n_bytes", "n_removed", "n_spans", "spans", "kept_text"), how: Repeats = Repeats(), keep_source: bool = True) -> DataFrame:
    """Adds to every document what is left of its bytes, as named in outputs.

    A byte goes if a window over it also starts earlier: in a document with a smaller key
    (an integer; null is smallest), or before in the same one. Windows are judged on the
    input. Null texts count as empty and short ones have no window. Texts may be very long
    (below 2 GB): they are looked at in blocks that overlap, and one document's text is the
    most that a row holds. Rows that repeat key and text are one document, so neither is
    the other's earlier place; ties between different texts of one key are broken by their
    hash. kept_text leaves out characters that lost a part of their bytes. Columns of the
    input with the name of an output are replaced, all others pass through, whatever their
    names. An empty table gives an empty table."""
    spark = docs.sparkSession
    tables = SharedTables(spark)
    small_batches(spark)
    kept = [c for c in docs.columns if c not in outputs and (keep_source or c != text)]
    source = docs.select(*dict.fromkeys([*kept, text, key]))
    order, value, spans_name, other = fresh([*docs.columns, *outputs], "order", "bytes", "spans", "key")
    own = ordered_documents(source, key, text, order, tables)
    whole = own.select(F.col(order).alias("order"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("text"))
    spans = repeated_spans(whole, tables, how).groupBy("order").agg(F.collect_list("span").alias("spans"))
    spans = tables.write(spans.select(F.col("order").alias(other), F.col("spans").alias(spans_name)), "spans")
    free(spark)
    tables.drop("first")
    tables.drop("sorted")
    joined = own.withColumn(value, F.coalesce(F.col(text), F.lit("")).cast("binary"))
    joined = joined.select(*kept, value, order).join(spans, F.col(order) == F.col(other), "left").select(*kept, value, spans_name)
    schema = T.StructType([*[docs.schema[c] for c in kept], *[T.StructField(n, OUTPUTS[n]) for n in outputs]])
    return joined.mapInArrow(_remove(kept, value, spans_name, outputs), schema)


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return remove_repeats(docs, outputs=("n_bytes", "n_removed", "n_spans", "kept_sha256"), keep_source=False)


#: All windows by their MD5, for tables as small as the tests'.
SQL = """
WITH d AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents
), c AS (
  SELECT doc_id, o * 1000 AS base, length(h) // 2 AS n, substr(h, 2000 * o + 1, 2198) AS piece FROM (SELECT doc_id, h, unnest(range((length(h) // 2 + 999) // 1000)) AS o FROM d)
), w AS (
  SELECT doc_id, base + i AS p, md5(substr(piece, 2 * i + 1, 200)) AS k FROM (SELECT *, unnest(range(least(1000, n - 99 - base))) AS i FROM c)
), again AS (
  SELECT doc_id, p FROM w QUALIFY row_number() OVER (PARTITION BY k ORDER BY doc_id, p) > 1
), runs AS (
  SELECT doc_id, p, sum(CASE WHEN p <= before + 100 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY p) AS run FROM (SELECT *, lag(p) OVER (PARTITION BY doc_id ORDER BY p) AS before FROM again)
), spans AS (
  SELECT doc_id, min(p) AS a, max(p) + 100 AS b FROM runs GROUP BY doc_id, run
), cuts AS (
  SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS since, lead(a) OVER (PARTITION BY doc_id ORDER BY a) IS NULL AS last FROM spans
), kept AS (
  SELECT doc_id, sum(b - a)::BIGINT AS n_removed, count(*) AS n_spans,
    string_agg(substr(h, 2 * since + 1, 2 * (a - since)) || CASE WHEN last THEN substr(h, 2 * b + 1) ELSE '' END, '' ORDER BY a) AS hex
  FROM cuts JOIN d USING (doc_id) GROUP BY doc_id
)
SELECT doc_id, (length(h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(hex, h))) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""
