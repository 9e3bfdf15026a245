"""SimHash and embedding near-dedup, and components, against plain Python."""

import random

import numpy as np
import pytest
import xxhash

from foliospark.llm import embedding_dedup, simhash
from foliospark.llm.common import SharedTables, connected_components


def components(nodes, edges):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize("shape", ["path", "star", "random", "none"])
def test_components(spark, shape):
    rng = random.Random(1)
    edges = {"path": [(i, i + 1) for i in range(60)], "star": [(500, i) for i in range(100)], "random": [(rng.randrange(300), rng.randrange(300)) for _ in range(150)], "none": []}[shape]
    rng.shuffle(edges)
    found = connected_components(spark.createDataFrame(edges, "u long, v long"), SharedTables(spark)).collect()
    nodes = {x for a, b in edges if a != b for x in (a, b)}
    assert {r.node: r.component for r in found} == components(nodes, edges) and len(found) == len(nodes)


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [b" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@pytest.mark.parametrize("crowd,parts", [(512, None), (2, None), (512, 4), (2, 5)])
def test_near_duplicates(spark, monkeypatch, crowd, parts):
    rng = random.Random(2)
    base = [" ".join(rng.choice(["Ab", "cD", "é", "x", "yz"]) for _ in range(rng.randint(1, 30))) for _ in range(80)]
    texts = base + base[:10] + [t + " tail" for t in base[:40]] + [None, "", "  ", "a", "A", "a b", "A B"] + ["w " * 30_000]
    long = [f"t{i}" for i in range(400)]
    for i in range(60):
        other = long[:]
        other[rng.randrange(400)] = "changed"
        texts.append(" ".join(other))
    rows = [(i * 2, t) for i, t in enumerate(texts)]
    prints = {k: plain_fingerprint(t) for k, t in rows}
    edges = [(a, b) for a in prints for b in prints if a < b and (prints[a] ^ prints[b]).bit_count() <= 2]
    assert len(edges) > 100
    monkeypatch.setattr(simhash.link_fingerprints, "__defaults__", (2, crowd, parts))
    docs = spark.createDataFrame([(k, t, "f") for k, t in rows], "doc_id long, text string, fp string")
    found = {r.doc_id: (r.fp % (1 << 64), r.component_id) for r in simhash.near_duplicates(docs.repartition(3)).collect()}
    assert found == {k: (prints[k], c) for k, c in components(list(prints), edges).items()}


def test_pigeonring_chains_lose_nothing():
    rng = random.Random(3)
    bounds = simhash.segment_bounds(3)
    for _ in range(3000):
        x = sum({1 << rng.randrange(64) for _ in range(rng.randint(0, 2))})
        held = [simhash._chain_holds(np.array([x], np.uint64), s, bounds, 2)[0] for s in range(3)]
        assert any(held)
    assert simhash._chain_holds(np.array([0b111], np.uint64), 0, bounds, 2)[0] == False  # noqa: E712


@pytest.mark.parametrize("distance,crowd", [(1, 512), (3, 512), (3, 3)])
def test_links_at_other_distances(spark, distance, crowd):
    rng = random.Random(distance)
    prints = {rng.getrandbits(64) for _ in range(60)}
    for p in list(prints):
        for n in range(1, 5):
            prints.add(p ^ sum({1 << rng.randrange(64) for _ in range(n)}))
    edges = [(a, b) for a in prints for b in prints if a < b and (a ^ b).bit_count() <= distance]
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    tables = SharedTables(spark)
    df = spark.createDataFrame([(signed(p),) for p in prints], "fp long")
    found = simhash.link_fingerprints(df, tables, distance, crowd).collect()
    same = lambda pairs: {frozenset(g) for g in groups_of(prints, pairs)}
    assert same([(r.u % (1 << 64), r.v % (1 << 64)) for r in found]) == same(edges) and len(edges) > 50


@pytest.mark.parametrize("crowd,chunk,leaders,parts", [(512, 4096, 256, None), (3, 40, 4, None), (3, 7, 1, 7), (3, 4096, 256, 9), (30, 20, 0, None)])
def test_links_at_six_bits(spark, crowd, chunk, leaders, parts):
    """Chains, a crowd of near copies that few leaders don't reach, and texts apart, by brute force."""
    rng = random.Random(crowd + chunk)
    flip = lambda p, n: p ^ sum(1 << b for b in rng.sample(range(64), n))
    centre = rng.getrandbits(64)
    prints = {rng.getrandbits(64) for _ in range(40)}
    for p in list(prints):
        prints |= {flip(p, n) for n in (1, 3, 5, 6, 7, 8)}
    prints |= {flip(centre, rng.choice([1, 2, 4, 6, 9])) for _ in range(300)}
    prints = sorted(prints)
    edges = [(a, b) for a in prints for b in prints if a < b and (a ^ b).bit_count() <= 6]
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    df = spark.createDataFrame([(signed(p),) for p in prints], "fp long").repartition(3)
    found = simhash.link_fingerprints(df, SharedTables(spark), 6, crowd, parts, chunk=chunk, leaders=leaders).collect()
    same = lambda pairs: {frozenset(g) for g in groups_of(prints, pairs)}
    assert same([(r.u % (1 << 64), r.v % (1 << 64)) for r in found]) == same(edges) and len(edges) > 1000


def groups_of(nodes, edges):
    out = {}
    for n, c in components(nodes, edges).items():
        out.setdefault(c, set()).add(n)
    return out.values()


def test_segments_grow_with_the_fingerprints():
    assert [simhash.segments_for(n, 2) for n in (0, 10**6, 10**8, 10**9, 10**11, 10**13)] == [3, 3, 3, 4, 4, 5]
    for parts in (3, 4, 5, 8):
        masks = simhash.meeting_masks(simhash.segment_bounds(parts), 2)
        for a in range(64):
            for b in range(a):
                assert any(not (1 << a | 1 << b) & m for _, m in masks)


def test_near_duplicates_edges(spark):
    docs = spark.createDataFrame([(None, "a b c d"), (5, "a b c d"), (5, "a b c d"), (None, "q r s t u")], "doc_id long, text string")
    made = sorted((r.doc_id or 0, r.component_id or 0) for r in simhash.near_duplicates(docs).collect())
    assert made == [(0, 0), (0, 5), (5, 5), (5, 5)]
    assert simhash.near_duplicates(docs.limit(0)).collect() == []


def test_similar_documents(spark):
    rng = random.Random(4)
    groups = []
    for g in range(40):
        words = [f"w{rng.randrange(3000)}" for _ in range(250)]
        for c in range(3):
            other = words[:]
            for _ in range(2 * c):  # each change touches five shingles
                other[rng.randrange(250)] = f"n{rng.randrange(10**6)}"
            groups.append((g, " ".join(other)))
    rows = [(i, t) for i, (_, t) in enumerate(groups)] + [(1000, None), (1001, " "), (1002, "short text")]
    made = {r.doc_id: r.component_id for r in simhash.similar_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert made[1000] == made[1001] == 1000 and made[1002] == 1002
    assert all(groups[made[i]][0] == g for i, (g, _) in enumerate(groups))  # nothing else is joined
    assert sum(made[i] == 3 * g for i, (g, _) in enumerate(groups)) >= 0.97 * len(groups)
    assert simhash.similar_documents(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def jaccard(a, b):
    a, b = ({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in (a.split(), b.split()))
    return len(a & b) / len(a | b)


@pytest.mark.parametrize("whole", [simhash.WHOLE, 2, 1])
def test_similar_documents_by_exact_sets(spark, monkeypatch, whole):
    rng = random.Random(6)
    words = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    texts = []
    for times in (5, 10):  # a near copy that repeats one of its own lines
        own = words(300)
        texts += [" ".join(own), " ".join(own + own[40:60] * times)]
    for times in (10, 30):  # different texts that share a line
        line = words(20) * times
        texts += [" ".join(words(200) + line), " ".join(words(200) + line)]
    for n in range(5, 13):  # short texts and the same with one word more
        own = words(n)
        texts += [" ".join(own), " ".join(own + ["more"])]
    for k in range(60):  # similarities on both sides of the bound
        own = words(200)
        texts += [" ".join(own), " ".join(own[: 160 + k // 2] + words(40 - k // 2))]
    links = [(a, a + 1) for a in range(0, len(texts), 2) if jaccard(texts[a], texts[a + 1]) >= 0.8]
    assert 20 < len(links) < len(texts) // 2 - 20
    monkeypatch.setattr(simhash.similar_documents, "__defaults__", (*simhash.similar_documents.__defaults__[:-1], whole))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    assert {r.doc_id: r.component_id for r in simhash.similar_documents(docs).collect()} == components(range(len(texts)), links)


def test_crowd_of_near_copies(spark):
    """Ten thousand documents in one group, a third of them too far from its leader; and two texts of very many words."""
    rng = random.Random(10)
    own = [f"w{rng.randrange(10**6)}" for _ in range(120)]
    texts = []
    for i in range(10_000):
        other = own[:]
        for k in range(rng.choice([1, 2, 3, 5])):
            other[(17 * i + 31 * k) % 120] = f"n{i}-{k}"
        texts.append(" ".join(other))
    long = " ".join(f"x{rng.randrange(10**6)}" for _ in range(60_000))
    texts += [long, long + " end"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    made = {r.doc_id: r.component_id for r in simhash.similar_documents(docs, whole=1000).collect()}
    sets = [set(zip(*(t.split()[i:] for i in range(5)))) for t in texts[:10_000]]
    # all that are linked to the first of one change are in its group; the others are checked against samples
    core = [i for i in range(10_000) if len(sets[i] & sets[0]) >= 0.8 * len(sets[i] | sets[0])]
    assert len({made[i] for i in core}) == 1 and 2000 < len(core) < 8000
    for i in range(0, 10_000, 97):
        near = next((j for j in core if j != i and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])), None)
        assert near is None or made[i] == made[near]
    assert made[10_001] == made[10_000] == 10_000


def test_band_layout_misses_few():
    rng = np.random.RandomState(8)
    factors, lost = simhash._factors(), 0
    for _ in range(3000):
        x = rng.randint(0, 1 << 63, 180, np.uint64)
        a, b = x[:160], np.r_[x[:142], x[160:178]]  # 142 of 178: 0.798
        lost += not (simhash.band_values(a, factors) == simhash.band_values(b, factors)).any()
    assert lost <= 6


def test_similar_roots():
    rng = random.Random(9)
    sets = [np.unique(np.array([rng.randrange(14) for _ in range(rng.randint(4, 14))], np.uint64)) for _ in range(120)]
    links = [(a, b) for a in range(120) for b in range(a) if 5 * len(set(sets[a].tolist()) & set(sets[b].tolist())) >= 4 * len(set(sets[a].tolist()) | set(sets[b].tolist()))]
    found = simhash.similar_roots(sets, 0.8).tolist()
    assert found == [components(range(120), links)[i] for i in range(120)] and len(set(found)) > 5


@pytest.mark.parametrize("how", [embedding_dedup.RangeJoin(), embedding_dedup.RangeJoin(cell=20, chunk=7, block=5), embedding_dedup.RangeJoin(cell=9, chunk=100, block=64)])
def test_range_join(spark, how):
    rng = np.random.RandomState(5)
    rows = list(rng.normal(size=(60, 8)))
    for c in range(6):
        centre = rng.normal(size=8)
        rows += [centre * rng.uniform(0.1, 9) + rng.normal(size=8) * rng.choice([0.05, 0.3, 0.6]) for _ in range(25)]
    rows += [rows[3]] * 12 + [rows[4] * 2, -rows[3]]
    vectors = [[float(x) for x in r] for r in rows]
    odd = [None, [], [0.0] * 8, [float("nan")] + [1.0] * 7, [float("inf")] + [1.0] * 7, [None] + [1.0] * 7, [1.0, 2.0], [1.0, 2.0, 0.0], [1e200] * 8, [1e-200] * 8, [0.0] * 8]
    ids = list(range(7, 7 + len(vectors) + len(odd)))
    docs = spark.createDataFrame([(i, v, "x") for i, v in zip(ids, vectors + odd)], "vec_id long, embedding array<double>, kept string").repartition(3)
    usable = {i: np.array(v) for i, v in zip(ids, vectors + odd) if v and all(x is not None and np.isfinite(x) for x in v) and any(v)}

    def cosine(a, b):
        a, b = a / np.abs(a).max(), b / np.abs(b).max()
        return a @ b / np.sqrt((a @ a) * (b @ b))

    edges = [(a, b) for a in usable for b in usable if a < b and len(usable[a]) == len(usable[b]) and cosine(usable[a], usable[b]) >= 0.9]
    links = {i: sum(i in e for e in edges) for i in ids}
    whole = components(ids, edges)
    found = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embedding_dedup.near_duplicates(docs, how=how).collect()}
    assert found == {i: (links[i], whole[i], whole[i] == i) for i in ids} and len(edges) > 300


def test_range_join_of_nothing(spark):
    assert embedding_dedup.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).collect() == []
