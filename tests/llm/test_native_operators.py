"""Quality rules, mixing and URL filters against plain Python."""

import random
import re

from pyspark.sql import functions as F

from foliospark.llm import mixing, quality_rules, url_filter

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base_rules(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    covered = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(5)}
    failed = len(words) < 10 or 100 * len(covered) > 20 * len(words)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered), failed


def texts():
    rng = random.Random(1)
    out = [None, "", " \t\n\x0b\x0c\r", "a", "one two three four five " * 3, "a\u00a0b\u2003c d", "é " * 50, "x" * 5000, "\n\n a\n a\n\na\n", "a b c d e f a b c d e g", "😀 #*$%&|<> " * 4]
    for _ in range(60):
        out.append("".join(rng.choice(["a", "b", "the", " ", " ", "\n", ". ", "#"]) for _ in range(rng.randint(0, 120))))
    return out


def test_base_rules(spark):
    rows = list(enumerate(texts()))
    docs = spark.createDataFrame([(i, t, "q", True) for i, t in rows], "doc_id long, text string, n_words string, kept boolean")
    made = quality_rules.apply_quality_rules(docs).collect()
    found = {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in made}
    assert found == {i: base_rules(t) for i, t in rows}
    assert not any(r.kept for r in made if r.base_failed)
    assert len(made[0]) == 11  # two of the nine added replace columns


def test_line_rules(spark):
    prose = "The quick brown fox jumps over the lazy dog, and then it sleeps."
    menu = "Home | News | Sport | Weather | About | Contact"
    docs = {1: prose, 2: f"{prose}\n{menu}\n{menu} | More", 3: "\n".join([menu] * 4), 4: "LOUD!! WORDS!! ARE!! ALL!! THERE!! IS!! IN!! THIS!! JUNK!! TEXT!! HERE!!", 5: f"{prose}\nAll rights reserved."}
    made = {r.doc_id: r for r in quality_rules.apply_quality_rules(spark.createDataFrame(list(docs.items()), "doc_id long, text string")).collect()}
    assert made[1].kept and made[1].clean_text == prose and made[1].lost_share == 0
    assert made[2].clean_text == prose and not made[2].kept
    assert not made[3].kept and not made[4].kept
    assert made[5].kept and made[5].clean_text == prose


def test_phrases_are_weighed_and_bounded(spark):
    prose = "The design in the blog interested them, and nobody had to be told about it twice. " * 3
    docs = {1: prose, 2: prose + "Please sign in. " + prose, 3: "You can log in here, or subscribe to our letters."}
    made = {r.doc_id: r for r in quality_rules.apply_quality_rules(spark.createDataFrame(list(docs.items()), "doc_id long, text string")).collect()}
    assert made[1].clean_text == prose and made[2].clean_text == docs[2] and made[3].clean_text == ""


def test_other_columns_pass_through(spark):
    docs = spark.createDataFrame([(1, "a b c.", 1, 2, 3, 4, "s")], "doc_id long, text string, t int, w int, __lines int, size int, source string")
    made = quality_rules.apply_quality_rules(docs.withColumnRenamed("size", "clean")).first()
    assert (made.t, made.w, made["__lines"], made.clean) == (1, 2, 3, 4)
    mixed = mixing.mix_documents(docs.withColumn("copies", F.lit(77)).withColumn("target", F.lit(78)).withColumn("of", F.lit(79)), mix=mixing.Mix(budget=2.0)).collect()
    assert len(mixed) == 2 and {(r["size"], r.copies, r.target, r.of) for r in mixed} == {(4, 77, 78, 79)}
    pages = docs.select(F.lit("http://a.org/").alias("url"), F.lit("").alias("html"), F.lit(5).alias("ruled"), F.lit(6).alias("__ruled"))
    made = url_filter.filter_urls(pages).first()
    assert (made.ruled, made["__ruled"], made.verdict) == (5, 6, "allow")


def test_long_texts(spark):
    long = "word " * 300_000
    docs = spark.createDataFrame([(1, long, "a"), (2, "x y", "a")], "doc_id long, text string, source string")
    made = {r.doc_id: r for r in quality_rules.apply_quality_rules(docs).collect()}
    assert made[1].n_words == made[1].n_repeat_words == 300_000 and made[1].base_failed
    assert {r.doc_id: r["size"] for r in mixing.plan_mix(docs).collect()} == {1: 300_000, 2: 2}
    pages = spark.createDataFrame([(1, "http://a.org/" + "p" * 500_000, "<p>" * 500_000 + '<a href="http://b.net/">')], "page_id long, url string, html string")
    assert len(url_filter.filter_urls(pages).first().path) == 500_001


def test_links(spark):
    html = """<a href="http://one.net/x">1</a><A class=q HREF='//two.net'>2</A><a data-href="http://evil.com/">3</a><!-- <a href="http://evil.com/">4</a> --><script>"<a href='http://evil.com/'>"</script><a href=https://three.net/>5</a><a href="/here">6</a><abbr href="http://evil.com/"><!-- <a href="http://evil.com/">"""
    pages = spark.createDataFrame([("me.org", html)], "host string, html string")
    assert sorted((r.dst, r.n) for r in url_filter.host_edges(pages).collect()) == [("one.net", 1), ("three.net", 1), ("two.net", 1)]


def test_quality_rules_of_nothing(spark):
    assert quality_rules.apply_quality_rules(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def reshared(sizes, weights, budget, most):
    """Targets by resharing what is above the caps until nothing is."""
    free, targets, left = set(sizes), {}, budget * sum(sizes.values())
    while free:
        share = {s: left * weights[s] / sum(weights[x] for x in free) for s in free}
        over = {s for s in free if share[s] > most * sizes[s]}
        if not over:
            return targets | share
        for s in over:
            targets[s] = most * sizes[s]
            left -= targets[s]
        free -= over
    return targets


def test_mixing(spark):
    rng = random.Random(2)
    rows = []
    for i in range(3000):
        source = rng.choice(["b"] * 8 + ["a", "c", "Z", "é", None])
        rows.append((i, " ".join(["w"] * rng.randint(0, 40)) if i % 50 else None, source, i))
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, size int")
    sizes, counts = {}, {}
    for i, t, s, _ in rows:
        counts[i] = len((t or "").split())
        sizes[s] = sizes.get(s, 0) + counts[i]
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None]
    targets = reshared(sizes, {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}, 1.5, 2.0)
    planned = mixing.plan_mix(docs).collect()
    taken = dict.fromkeys(sizes, 0)
    for r in planned:
        assert r["size"] == counts[r.doc_id] and r.source_size == sizes[r.source] and abs(r.target - targets[r.source]) < 1e-6 * (1 + r.target)
        assert r.copies * r["size"] <= 2 * r["size"]
        taken[r.source] += r.copies * r["size"]
    for s in sizes:
        assert abs(taken[s] - targets[s]) < 0.15 * targets[s] + 1
    again = mixing.plan_mix(docs.repartition(7)).collect()
    assert {r.doc_id: r.copies for r in planned} == {r.doc_id: r.copies for r in again}
    mixed = mixing.mix_documents(docs)
    assert mixed.columns == docs.columns and mixed.count() == sum(r.copies for r in planned)


def test_mixing_edges(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mixing.plan_mix(empty).collect() == []
    blank = spark.createDataFrame([(1, None, "a"), (None, " ", None), (None, "x y", "b"), (3, "x", "b"), (3, "x", "b")], empty.schema)
    made = mixing.plan_mix(blank).collect()
    assert len(made) == 5 and all(r.target == 0 and r.copies == 0 for r in made if r.source_size == 0)


def test_url_parts_and_rules(spark):
    urls = {1: "http://A.Example.ORG/es/x?y#z", 2: "https://example.org/en/12", 3: "http://org/", 4: "http://borg.com/fr/", 5: "http://x.com/de/", 6: "http://x.com/xx", 7: None, 8: "no scheme", 9: "a://b?c/d", 10: "x://", 11: "http://example.org", 12: "q://h#/fr/"}
    made = {r.page_id: (r.host, r.path, r.rule) for r in url_filter.filter_urls(spark.createDataFrame([(k, v, None) for k, v in urls.items()], "page_id long, url string, html string")).collect()}
    assert made == {
        1: ("a.example.org", "/es/x", "example.org/es/"), 2: ("example.org", "/en/12", "example.org/en/1"), 3: ("org", "/", "org/"), 4: ("borg.com", "/fr/", "com/fr/"), 5: ("x.com", "/de/", "com/de/"), 6: ("x.com", "/xx", None),
        7: ("", "", None), 8: ("", "", None), 9: ("b", "", None), 10: ("", "", None), 11: ("example.org", "", None), 12: ("h", "", None),
    }


def test_propagation(spark):
    rng = random.Random(4)
    hosts = [f"h{i}.net" for i in range(12)] + ["good.org", "other.org", "x.com"]
    pages = []
    for i in range(120):
        host = rng.choice(hosts)
        path = "/de/" if host == "x.com" else "/a"
        links = "".join(f'<a class="q" href="{rng.choice(["http:", "https:", ""])}//{rng.choice(hosts).upper()}/p?q">l</a>' for _ in range(rng.randint(0, 4)))
        pages.append((i, f"http://{host}{path}", links + '<a href="/local">x</a>' if i % 9 else None))
    made = url_filter.filter_urls(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()
    # plain personalised PageRank, the same number of rounds
    edges, seeds = {}, [{}, {}]
    for (_, _, html), r in zip(sorted(pages), sorted(made, key=lambda r: r.page_id)):
        for target in re.findall(r'//([^/"]+)/p', html or ""):
            if target.lower() != r.host:
                edges[r.host, target.lower()] = edges.get((r.host, target.lower()), 0) + 1
        if r.rule:
            kind = seeds[r.verdict == "block"]
            kind[r.host] = kind.get(r.host, 0) + 1
    ranks = []
    for kind, seed in enumerate(seeds):
        moves = {(b, a) if kind else (a, b): n for (a, b), n in edges.items()}
        out = {}
        for (a, _), n in moves.items():
            out[a] = out.get(a, 0) + n
        base = {h: 0.15 * n / sum(seed.values()) for h, n in seed.items()}
        rank = dict(base)
        for _ in range(10):
            new = dict(base)
            for (a, b), n in moves.items():
                new[b] = new.get(b, 0) + 0.85 * rank.get(a, 0) * n / out[a]
            rank = new
        ranks.append(rank)
    for r in made:
        assert abs(r.trust - ranks[0].get(r.host, 0)) < 1e-9 and abs(r.distrust - ranks[1].get(r.host, 0)) < 1e-9
        if r.rule is None:
            assert r.verdict == ("block" if r.distrust > r.trust else "allow")
    assert {r.verdict for r in made if r.rule is None} == {"allow", "block"}


def test_query_follows_links_to_their_end(spark, tmp_path):
    hosts = [f"h{i}.net" for i in range(13)] + ["x.com"]  # each links to the next one; distrust flows back
    pages = [(i, f"http://{h}/de/", f'<a href="//{hosts[i + 1]}/">l</a>' if i < 13 else None) for i, h in enumerate(hosts)]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    made = url_filter.query(spark, str(tmp_path)).collect()
    assert {r.host: r.verdict for r in made} == dict.fromkeys(hosts, "block")


def test_propagation_settles(spark):
    pages = [(0, "http://x.com/de/", None), *[(i, f"http://{a}.net/", f'<a href="//{b}/">l</a>') for i, (a, b) in enumerate([("a", "x.com"), ("a", "b.net"), ("b", "a.net")], 1)]]
    made = url_filter.filter_urls(spark.createDataFrame(pages, "page_id long, url string, html string"), how=url_filter.SETTLED).collect()
    found = {r.host: r.distrust for r in made}
    a = 0.85 * 0.15 / (1 - 0.85 * 0.85)  # a gets all that x.com and b pass back, b all that a does
    assert abs(found["x.com"] - 0.15) < 1e-8 and abs(found["a.net"] - a) < 1e-8 and abs(found["b.net"] - 0.85 * a) < 1e-8


def test_url_filter_of_nothing(spark):
    assert url_filter.filter_urls(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []
