"""Queries against their SQL on rows where the two could part."""

import os

import duckdb
import pytest
from oracle import TABLES, duck, rows

from linkloom.plans import registry

registry.load()


@pytest.fixture
def tables(sf, tmp_path):
    """The test tables, some of them replaced by the rows of a SQL query."""

    def make(**replaced):
        for t in TABLES:
            if t in replaced:
                duckdb.connect().execute(f"COPY (SELECT * FROM ({replaced[t].format(old=f'{sf}/{t}.parquet')})) TO '{tmp_path}/{t}.parquet' (FORMAT parquet)")
            else:
                os.symlink(f"{sf}/{t}.parquet", tmp_path / f"{t}.parquet")
        return str(tmp_path)

    return make


def same(spark, sf, name):
    got, want = registry.QUERIES[name](spark, sf).toPandas(), duck(sf, registry.ORACLES[name])
    assert rows(got) == rows(want)


def test_search_rounds_halves_to_even(spark, tables):
    suppliers = "SELECT CAST(i AS BIGINT) AS s_suppkey, 'Supplier#' || lpad(CAST(i AS VARCHAR), 9, '0') AS s_name, 1 AS s_nationkey, i % 13 - 6.5::DOUBLE AS s_acctbal FROM range(40) r(i)"
    same(spark, tables(supplier=suppliers), "search_ranked")


#: Titles and headings that end within a reference, and references of all kinds.
CUT_PAGES = """SELECT page_id, url, replace(replace(html, '</title>', CASE page_id % 3 WHEN 0 THEN ' a&amp</title>' WHEN 1 THEN ' "x&quot; &lt;b&gt; &#39;&copy;&middot;</title>' ELSE ' &eacute;&#233;&amp;lt;</title>' END),
 '<article>', '<article><p>Al. Coé&amp</p><p>one&ltwo &quot;Ël. Coñ&quot; &eacute;</p>') AS html FROM '{old}'"""


def test_references_in_page_text(spark, tables):
    same(spark, tables(pages=CUT_PAGES), "html_text_hash")


def test_references_in_titles(spark, tables):
    same(spark, tables(pages=CUT_PAGES), "homepage_fields")


def test_references_and_borders_on_legal_pages(spark, tables):
    same(spark, tables(pages=CUT_PAGES), "legal_page_signals")
