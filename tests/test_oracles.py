"""Every registered query runs, isn't empty, and agrees with its SQL in DuckDB."""

import decimal
import math

import duckdb
import pytest

import __spark_entry__ as entry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
LIBRARY = [q for q in entry.queries() if not (q == "pipeline" or q[2:3].isdigit() and q.startswith("op"))]
#: Empty at this scale only.
MAY_BE_EMPTY = {"d9_address_rt_documents", "o1_all_detectors_rt", "o1_all_detectors_strict", "scan_pages_report", "scan_pages_table"}


def plain(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    return tuple(map(plain, v)) if isinstance(v, list | tuple) else v


def tables(folder):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{folder}/{t}.parquet'")
    return con


@pytest.fixture(scope="module")
def duck(small):
    return tables(small)


def check(spark, folder, con, name):
    """Number of rows; they are those of the SQL."""
    df = entry.queries()[name](spark, folder)
    columns = sorted(df.columns)
    got = sorted(repr(tuple(plain(r[c]) for c in columns)) for r in df.collect())
    spark.catalog.clearCache()
    if sql := entry.oracle_sql().get(name):
        result = con.execute(sql)
        names = [d[0] for d in result.description]
        assert sorted(names) == columns
        rows = [dict(zip(names, r, strict=True)) for r in result.fetchall()]
        assert got == sorted(repr(tuple(plain(r[c]) for c in columns)) for r in rows)
    return len(got)


@pytest.mark.parametrize("name", sorted(LIBRARY))
def test_query(spark, small, duck, name):
    assert check(spark, small, duck, name) or name in MAY_BE_EMPTY


@pytest.mark.parametrize("name", sorted(MAY_BE_EMPTY))
def test_on_larger_tables(spark, name):
    folder = "/root/testdata/sf0.01"
    assert check(spark, folder, tables(folder), name)


def test_pages_cut_within_a_reference(spark, tmp_path):
    """Page 16468 of check_l has ``&quot`` at the end of its title and heading: text in the SQL, a quotation mark to browsers."""
    cuts = "&quot &quo & &a &am &amp &lt &gt &copy &nbsp &middot &#39 &#x27 &quotx; &amp;quot &amp;quot; &ampquot &ampquot; &l&lt; &quot; &#39; &lt;b&gt;".split()
    page = "<html><head><title>token = {0}</title></head><body><h1>token = {0}</h1><p>Write to ann{1}@postbox.net</p><p>{0}, or {0}.</p></body></html>"
    spark.createDataFrame([(i, f"https://site.test/{i}", page.format(c, i)) for i, c in enumerate(cuts)], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{tmp_path}/pages.parquet/*.parquet'")
    assert check(spark, str(tmp_path), con, "scan_pages_safe_texts") == len(cuts)


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_sql_names_are_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())
