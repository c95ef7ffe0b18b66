"""Page parse job and markdown clean-up (FIXTURES B5, B6)."""
from pyspark.sql import functions as F

from vetline.operators import pages as pg

LONG = "word " * 60


def test_b5_pages(spark):
    pages = [
        (1, "u1", f"<h1 class='top-card__job-title'>Head of Finance</h1><div id='job-details'><p>{LONG}</p></div>"),
        (2, "u2", "<div><div><p>A real title here</p><a href='/company/x/life/'>X Co</a></div></div>"),
        (3, "u3", "<h1>T</h1><div id='job-details'>" + "x" * 200 + f"</div><article><p>{LONG}</p></article>"),
        (4, "u4", f"<h1>T</h1><div><p>{'a' * 250}</p></div><div><p>{'b' * 250}</p></div>"),
        (5, "u5", "<h1>Broken <b>markup</h1><p>unclosed <div>"),
        (6, "u6", "<ul><li><a href='/jobs/view/1/?x'>First card\nsecond line</a><span class='company-name'>Acme</span></li>"
                  "<li><a href='/jobs/view/2/'>  </a></li><li><a href='/jobs/view/3/'>No co</a></li></ul>"
                  "<span>12 results</span><p>Are these results helpful</p>"),
    ]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = {r.page_id: r for r in pg.parse_pages(df).collect()}
    assert got[1].title_sel == "Head of Finance" and got[1].desc_md.startswith("word")
    assert got[2].title_sel == "" and got[2].title_anchor == "A real title here" and got[2].company == "X Co"
    assert got[3].desc_html.startswith("<p>word")
    assert "a" * 250 in got[4].desc_html
    assert got[5].title_sel == "Broken markup"
    cards = [(c.title, c.company, c.url) for c in got[6].cards]
    assert cards == [("First card", "Acme", "https://www.linkedin.com/jobs/view/1/"),
                     ("No co", "LinkedIn", "https://www.linkedin.com/jobs/view/3/")]
    assert got[6].results_end and got[6].expected == 12
    docs = {r.page_id: r for r in pg.listing_fields(pg.parse_pages(df)).collect()}
    assert docs[1].body_md.startswith("# Head of Finance\n\n**URL:** u1")
    assert docs[5].quarantine


def test_b6_markdown(spark):
    rows = [
        (1, "\n".join(["# A", "x", "## Use AI to assess how you fit", "y", "### deep", "z", "## B", "w"])),
        (2, "\n".join(["nav", "", "* * *", "", "body", "Set alert for similar jobs", "tail"])),
        (3, "head\n---\nmid\n* * *\nend"),
        (4, "\n".join(["## People you can reach out to", "p", "### Use AI to assess how you fit", "q", "### C", "r"])),
    ]
    df = spark.createDataFrame(rows, "i int, md string")
    got = {r.i: r.m for r in df.select("i", pg.clean_markdown(F.col("md")).alias("m")).collect()}
    assert got[1] == "# A\nx\n## B\nw"
    assert got[2] == "body"
    assert got[3] == "end"
    assert got[4] == "### C\nr"  # nested listed heading resets the skip level (Q20)


def test_html_to_markdown_forms():
    md = pg.html_to_markdown("<h2>Role</h2><p>Lead <b>finance</b> and <i>ops</i>.<br>Next</p>"
                             "<ul><li>one</li><li>two</li></ul><hr><p><a href='x'>link text</a>"
                             "<img src='i.png'></p><script>var x;</script>")
    assert md.split("\n") == ["## Role", "", "Lead **finance** and _ops_.  ", "Next", "",
                              "  * one", "  * two", "", "* * *", "", "link text"]


def test_html_to_markdown_blocks():
    md = pg.html_to_markdown("<blockquote><p>quoted</p></blockquote><pre>a  b\n  c</pre>"
                             "<ol><li>first<ul><li>inner</li></ul></li><li>second</li></ol>"
                             "<p>run <code>x()</code></p><table><tr><th>A</th><th>B</th></tr>"
                             "<tr><td>1</td><td>2</td></tr></table>")
    assert md.split("\n") == ["> quoted", "", "    a  b", "      c", "", "  1. first", "    * inner",
                              "  2. second", "", "run `x()`", "", "A | B", "1 | 2"]
