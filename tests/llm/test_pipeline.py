"""The stages one by one, and the llm queries against their SQL."""

import os
import random

import pytest

import __spark_entry__ as entry
import corpus_pipeline
from foliospark.llm import mixing

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = random.Random(7)
    words = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8))) for _ in range(n))
    passage = words(60)
    rows, labels = [], []
    for i in range(300):
        text = words(150 if i == 2 else rng.randint(30, 90)) + "."
        if i % 6 == 1:
            text = " ".join(f"{w}***" for w in text.split())
        if i % 10 == 0:
            text += " " + passage
        rows.append((i, text, "en", f"s{i % 3}", len(text)))
        if i % 2 == 0 or i % 3 == 1:
            labels.append((i, int(i % 6 != 1), 0))
    rows += [(1000 + i, rows[i][1], "en", "s0", rows[i][4]) for i in range(0, 60, 4)]
    for i in range(4):  # near copies, each with another word changed
        rows.append((2000 + i, " ".join("z" if k == 11 + i else w for k, w in enumerate(rows[2][1].split())), "de", None, 1))
    folder = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder, {r[0]: r for r in rows}, passage


def test_stages(spark, corpus):
    folder, rows, passage = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = corpus_pipeline.keep_quality(spark, docs, folder)
    assert tuple(kept.columns) == corpus_pipeline.COLUMNS
    ids = {r.doc_id for r in kept.collect()}
    junk = {i for i in rows if "***" in rows[i][1]}
    assert ids == set(rows) - junk

    single = corpus_pipeline.drop_near_copies(spark, docs, folder)
    left = {r.doc_id for r in single.collect()}
    assert not any(1000 <= i < 2000 for i in left) and {i for i in rows if i < 1000} <= left
    assert not left & {2000, 2001, 2002, 2003}

    cut = {r.doc_id: r for r in corpus_pipeline.cut_repeats(spark, docs, folder).collect()}
    assert set(cut) == set(rows) and passage in cut[0].text
    assert all(passage not in cut[i].text and len(cut[i].text) == cut[i].n_chars for i in range(10, 300, 10))
    assert all(cut[i].text == rows[i][1] for i in range(300) if i % 10)

    planned = {r.doc_id: r.copies for r in mixing.plan_mix(docs).collect()}
    mixed = [r.doc_id for r in corpus_pipeline.mix_sources(spark, docs, folder).collect()]
    assert {i: mixed.count(i) for i in rows} == planned

    coded = corpus_pipeline.encode(spark, docs, folder).collect()
    assert len(coded) == len(rows) and all(len(r.ids) == r.n_tokens for r in coded)


def test_stages_take_odd_rows(spark, corpus):
    """Null and blank texts, null and repeated keys, repeated rows, and a column too many."""
    folder, rows, _ = corpus
    text, other = rows[4][1], rows[8][1]
    odd = [(1, text, "en", "a", 5, "x"), (1, text, "en", "a", 5, "x"), (1, other, "en", "a", 5, "x"), (2, None, None, None, None, None), (3, "  ", "en", "a", 2, "x"), (None, text, "en", None, 1, "x"), (None, None, "en", None, 1, "x"), (9, other, "en", "b", 1, "x")]
    docs = spark.createDataFrame(odd, "doc_id long, text string, lang string, source string, n_chars long, order string")
    made = {}
    for name, stage in corpus_pipeline.STAGES:
        made[name] = stage(spark, docs, folder).collect()
    kept = made["quality classifier"]
    assert len(kept) == 8 and len(kept[0]) == 5
    # one row for each group: the blank ones, text, and other
    assert sorted((r.doc_id or 0, (r.text or "").strip()) for r in made["SimHash near-dedup"]) == sorted([(0, ""), (0, text), (1, other)])
    cut = made["suffix-array dedup"]
    assert len(cut) == 8 and sum(r.text is None for r in cut) == 2 and {r.n_chars for r in cut if r.text is None} == {None}
    assert all(len(r.text) == r.n_chars for r in cut if r.text is not None)
    copies = [r.copies for r in mixing.plan_mix(docs).collect()]
    assert len(made["mixing sources to target weights"]) == sum(copies) and set(copies) <= {0, 1, 2}
    assert len(made["SentencePiece encoding and decoding"]) == 8


def test_near_copies_are_those_of_simhash(spark, corpus):
    """The groups, by brute force: fingerprints of distinct shingles at most six bits apart, then texts that share half of their shingles."""
    import xxhash

    rng = random.Random(11)
    word = lambda: f"w{rng.randrange(10**6)}"
    texts = [None, "", " \t", "one two", "One  two", "one two three four", "one two three five"]
    for k in range(60):  # near copies, of which many have less than 0.8 of their five-word shingles in common
        own = [word() for _ in range(150)]
        other = own[:]
        for _ in range(k // 6):
            other[rng.randrange(150)] = word()
        texts += [" ".join(own), " ".join(other)]
    for _ in range(4):  # different texts that share a line many times
        line = [word() for _ in range(20)] * 30
        texts += [" ".join([word() for _ in range(200)] + line) for _ in range(2)]
    texts += [f"{word()} {word()} {word()} {word()}" for _ in range(200)]

    def shingles(text):
        own = (text or "").lower().split()
        return {" ".join(own[i : i + 3]) for i in range(max(1, len(own) - 2))} if own else set()

    def fingerprint(sh):
        hashes = [xxhash.xxh64_intdigest(x, 42) for x in sh]
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))

    sets = [shingles(t) for t in texts]
    prints = [fingerprint(s) for s in sets]

    def grouped(nodes, linked):
        groups = []
        for n in nodes:
            met = [g for g in groups if any(linked(n, m) for m in g)]
            groups = [g for g in groups if g not in met] + [{n}.union(*met)]
        return groups

    close = grouped(range(len(texts)), lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 6)
    alike = lambda a, b: sets[a] == sets[b] or 2 * len(sets[a] & sets[b]) >= len(sets[a] | sets[b])
    wanted = {min(g) for c in close for g in grouped(sorted(c), alike)}
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long").repartition(5)
    assert {r.doc_id for r in corpus_pipeline.drop_near_copies(spark, docs, corpus[0]).collect()} == wanted
    assert 20 < len(texts) - len(wanted) < 60


def test_run(spark, corpus):
    folder, rows, _ = corpus
    made = corpus_pipeline.run(spark, folder).collect()
    assert made and {r.doc_id for r in made} <= {i for i in rows if i < 1000 and "***" not in rows[i][1]}


def test_stages_take_nothing(spark, corpus):
    folder, _, _ = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, folder).count() == 0


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the driver's tables")
@pytest.mark.parametrize("name", [n for n in entry.queries() if n.startswith("op")])
def test_query(spark, name):
    import duckdb

    made = entry.queries()[name](spark, DATA).toPandas()
    assert len(made)
    if name not in entry.oracle_sql():
        return
    connection = duckdb.connect()
    for file in os.listdir(DATA):
        connection.execute(f"CREATE VIEW {file.split('.')[0]} AS SELECT * FROM '{DATA}/{file}'")
    wanted = connection.execute(entry.oracle_sql()[name]).df()
    columns = sorted(made.columns)
    assert columns == sorted(wanted.columns)
    plain = lambda v: repr(round(v, 6)) if isinstance(v, float) else "null" if v is None or v != v else str(v)
    rows = lambda d: sorted(tuple(map(plain, r)) for r in d[columns].itertuples(index=False))
    assert rows(made) == rows(wanted)
