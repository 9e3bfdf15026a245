import hashlib
import random

import pytest

from foliospark.llm.suffix_dedup import OUTPUTS, Repeats, _deal_stretches, multikey_quicksort, remove_repeats, sampled_splitters

SCHEMA = "doc_id long, text string"
DIGESTS = ("n_bytes", "n_removed", "n_spans", "kept_sha256")


def brute(texts, length=100):
    """By doc_id: what each window that also starts earlier takes away."""
    seen, out = set(), {}
    for key, text in sorted(texts.items()):
        data = (text or "").encode()
        gone = bytearray(len(data))
        for p in range(len(data) - length + 1):
            if data[p : p + length] in seen:
                gone[p : p + length] = b"\1" * length
            seen.add(data[p : p + length])
        left = bytes(x for x, g in zip(data, gone) if not g)
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out[key] = (len(data), sum(gone), spans, hashlib.sha256(left).hexdigest())
    return out


def words(rng, n):
    return " ".join("".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 8))) for _ in range(n))


def corpus():
    rng = random.Random(3)
    passages = [words(rng, 40) for _ in range(4)]
    line = "A line that very many of the documents share, of less than a window."
    texts = {}
    for i in range(150):
        parts = [words(rng, rng.randint(0, 60))]
        if i % 3:
            whole = passages[rng.randrange(4)]
            cut = rng.randint(0, 120)
            parts.append(whole[cut : cut + rng.randint(90, 200)])
        parts += [line] * (i % 2) + [words(rng, 20)]
        texts[i * 3] = "\n".join(parts)
    copy = list(words(rng, 120))
    for i in range(60):  # near copies
        other = copy[:]
        other[rng.randrange(len(other))] = "z"
        texts[1000 + i] = "".join(other)
    texts |= {2000 + i: "".join(copy) for i in range(20)}
    texts |= {3000: "a" * 1000, 3001: "a" * 99, 3002: "ab" * 300, 3003: "", 3004: None, 3005: "xyz" * 200 + words(rng, 30) + "xyz" * 200, 3006: words(rng, 900)}
    texts[3007] = texts[3006][500:2500] * 2
    return texts


@pytest.mark.parametrize("how", [Repeats(), Repeats(range_bytes=3000, bucket_pieces=15, block=700, held=50, windows=300)])
def test_matches_brute_force(spark, how):
    texts = corpus()
    rows = list(texts.items())
    random.Random(5).shuffle(rows)
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
    found = {r.doc_id: tuple(r[n] for n in DIGESTS) for r in remove_repeats(docs, outputs=DIGESTS, how=how).collect()}
    assert found == brute(texts)


def test_outputs_and_extra_columns(spark):
    text = "é" * 80 + "x" + "é" * 80
    docs = spark.createDataFrame([(1, text, "a", 5), (2, text, "b", 6)], "doc_id long, text string, order string, n_bytes int")
    rows = {r.doc_id: r for r in remove_repeats(docs, outputs=tuple(OUTPUTS)).collect()}
    assert rows[2].n_removed == rows[2].n_bytes == len(text.encode()) and rows[2].kept_text == ""
    assert [tuple(s) for s in rows[2].spans] == [(0, len(text.encode()))]
    assert (rows[1].order, rows[2].order) == ("a", "b")
    other = docs.withColumnRenamed("order", "bytes").withColumnRenamed("n_bytes", "spans")
    assert [(r.bytes, r.spans) for r in remove_repeats(other, outputs=DIGESTS).orderBy("doc_id").collect()] == [("a", 5), ("b", 6)]
    assert rows[1].kept_bytes.decode("utf-8", "ignore") == rows[1].kept_text


def test_repeated_and_null_keys(spark):
    a, b = words(random.Random(1), 80), words(random.Random(2), 80)
    docs = spark.createDataFrame([(1, a), (1, a), (1, b), (2, a), (None, b), (None, None)], SCHEMA)
    rows = sorted((r.doc_id or 0, r.n_removed > 0, r.n_bytes) for r in remove_repeats(docs, outputs=DIGESTS).collect())
    n = lambda t: len(t.encode())
    # the null key is the smallest, so its text is found again under 1; the repeated row is no earlier place
    assert rows == sorted([(0, False, 0), (0, False, n(b)), (1, False, n(a)), (1, False, n(a)), (1, True, n(b)), (2, True, n(a))])


@pytest.mark.parametrize("seed", range(8))
def test_multikey_quicksort(seed):
    import numpy as np

    rng = random.Random(seed)
    group = sorted(rng.randrange(rng.choice([1, 4, 30])) for _ in range(300))
    keys = [tuple(rng.choice([0, 1, 2, 2**63, 2**64 - 1]) for _ in range(g % 3 + 1)) for g in group]
    depth = np.array([len(k) for k in keys])
    table = np.array([k + (0,) * (3 - len(k)) for k in keys], np.uint64)
    rows, same = multikey_quicksort(300, lambda r, at: table[r, at], depth, np.array(group))
    assert rows.tolist() == sorted(range(300), key=lambda i: (group[i], keys[i]))
    assert same.tolist() == [bool(i) and (group[a], keys[a]) == (group[b], keys[b]) for i, (a, b) in enumerate(zip([0, *rows.tolist()], rows.tolist()))]
    assert multikey_quicksort(0, None, 3)[0].tolist() == []


def test_a_frequent_line_is_spread(spark):
    """A line below a window's length in every document, and no repeated window: equal to brute force, over ranges of about one size."""
    rng = random.Random(11)
    line = "A line of sixty-two bytes which all of these documents have.\n\n"
    texts = {i: "".join(rng.choice("abcdefgh ") for _ in range(60)) + line + "".join(rng.choice("abcdefgh ") for _ in range(60)) for i in range(3000)}
    docs = spark.createDataFrame(list(texts.items()), SCHEMA).repartition(4)
    how = Repeats(range_bytes=20_000, sample=64)
    whole = docs.selectExpr("doc_id as `order`", "cast(text as binary) as text")
    splitters = sampled_splitters(whole, 25, sum(map(len, texts.values())), how)
    sizes = [r.n for r in whole.mapInArrow(_deal_stretches(how, splitters), "range int, n int, size long, packed binary").groupBy("range").agg({"n": "sum"}).toDF("range", "n").collect()]
    assert len(sizes) == 25 and max(sizes) < 3 * sorted(sizes)[12]
    found = {r.doc_id: tuple(r[n] for n in DIGESTS) for r in remove_repeats(docs, outputs=DIGESTS, how=how).collect()}
    assert found == brute(texts)


def test_long_text(spark):
    """One text over several blocks, with a repeat across their bounds."""
    rng = random.Random(12)
    text = words(rng, 60_000)
    texts = {1: text, 2: text[100_000:160_000], 3: "x" * 99 + text[-300:]}
    docs = spark.createDataFrame(list(texts.items()), SCHEMA)
    found = {r.doc_id: tuple(r[n] for n in DIGESTS) for r in remove_repeats(docs, outputs=DIGESTS, how=Repeats(block=50_000)).collect()}
    assert found == brute(texts)


def test_empty(spark):
    assert remove_repeats(spark.createDataFrame([], SCHEMA), outputs=DIGESTS).collect() == []
