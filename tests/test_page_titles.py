"""page_titles is what its SQL says, on titles that a parser reads otherwise too."""

import duckdb

from quillon.operators import parse
from quillon.plans import carriers

PAGES = [
    "<title>Ants &amp; bees &amp</title><style>p{}</style>",
    "<title>token = &quot;0b96&quot;</title>",
    "<title>&amp;quot; &amp;amp; &lt;b&gt; &#233;</title>",
    "<title> \t two\n lines\r\n\f</title><title>second</title>",
    "<title> 　 wide  \u0085</title>",
    "<title>\x0b a\x0bb  </title>",
    "</title>before <title>after <title>inner</title>",
    "<title>never closed",
    "<TITLE>upper</TITLE>",
    "<title lang=en>named</title>",
    "<title></title>",
    "no title",
    "",
    None,
]


def test_titles_are_those_of_the_sql(spark, tmp_path):
    rows = list(enumerate(PAGES))
    spark.createDataFrame(rows, "page_id long, html string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    want = dict(con.execute(carriers.oracle_sql()["page_titles"]).fetchall())
    got = {r.page_id: r.title for r in carriers.queries()["page_titles"](spark, str(tmp_path)).collect()}
    assert got == want and want[0] == "Ants & bees &amp" and want[13] is None


def test_the_parser_still_gives_the_title_that_html_means(spark):
    df = spark.createDataFrame([(PAGES[0],), (PAGES[1],)], "html string").select(parse.html_signals("html")["title"].alias("t"))
    assert [r.t for r in df.collect()] == ["Ants & bees &", 'token = "0b96"']
