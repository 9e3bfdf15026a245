"""Each query of the base package against its SQL on the smallest tables."""

import os

import pytest

from foliospark.queries import QUERIES, SQL

DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the driver's tables")
@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, name):
    import duckdb

    made = QUERIES[name](spark, DATA).toPandas()
    if name not in SQL:
        assert len(made)
        return
    connection = duckdb.connect()
    for file in os.listdir(DATA):
        connection.execute(f"CREATE VIEW {file.split('.')[0]} AS SELECT * FROM '{DATA}/{file}'")
    wanted = connection.execute(SQL[name]).df()
    columns = sorted(made.columns)
    assert columns == sorted(wanted.columns)

    def plain(v):
        if hasattr(v, "__len__") and not isinstance(v, str):
            return repr(list(v))
        return "null" if v is None or v != v else repr(round(v, 6)) if isinstance(v, float) and v != int(v) else str(int(v)) if isinstance(v, float) else str(v)

    rows = lambda d: sorted(tuple(map(plain, r)) for r in d[columns].itertuples(index=False))
    assert rows(made) == rows(wanted)


def test_chapter_titles_decode_what_their_sql_decodes(spark, tmp_path):
    import duckdb

    titles = ["token = &quot;1a2b&quot;", "cut &quot", "a&&amp;&amp;b &amp", "&lt;b&gt; &copy; x &middot; y", "&copy 1 &lt2 &amp;quot; &amp;lt; &amp;amp;", "&AMP; &#39;&#x27; &nbsp; &eacute;é &", "&amp;&amp", " &middot; ", "plain"]
    pages = [(i, f"http://h/{i}", f"<html><head><title>{t}</title><script>a && b &quot;</script></head><body><a href='/x?a=1&lt=2'>&quot;</a><h1>{t}</h1><p>&quot;{t}</p></body></html>") for i, t in enumerate(titles)]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    made = {r.page_id: r.title for r in QUERIES["chapter_titles"](spark, str(tmp_path)).collect()}
    connection = duckdb.connect()
    connection.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    assert made == dict(connection.execute(SQL["chapter_titles"]).fetchall())
    assert made[0] == titles[0] and made[2] == "a&&&b &amp"


def test_entry_works_without_the_subpackage():
    import subprocess
    import sys
    import textwrap

    code = textwrap.dedent("""
        import sys
        class Gone:
            def find_spec(self, name, path=None, target=None):
                if name == "foliospark.llm" or name == "corpus_pipeline":
                    raise ImportError(name)
        sys.meta_path.insert(0, Gone())
        import __spark_entry__ as e
        names = e.queries()
        assert names and not any(n.startswith("op") or n == "pipeline" for n in names)
        assert set(e.oracle_sql()) <= set(names)
    """)
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    subprocess.run([sys.executable, "-c", code], cwd=root, check=True)
